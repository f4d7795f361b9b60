"""A folder for intermediate files that every executor sees."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_RUNS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, which all executors share.

    Where the setting is absent a local master gets a temporary folder; a cluster an error.
    The folder goes when Python ends; what it holds only serves to build a result."""
    sc = spark.sparkContext
    if sc.applicationId not in _RUNS:
        root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not root:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="slowscope-")
        _RUNS[sc.applicationId] = f"{root.rstrip('/')}/slowscope-{uuid.uuid4().hex}"
        atexit.register(_remove, sc, _RUNS[sc.applicationId])
    return _RUNS[sc.applicationId]


def _remove(sc, path: str) -> None:
    if sc._jsc is not None and sc._gateway is not None:
        try:
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the JVM may be gone by now; the folder is then left to its owner
            pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in shared_dir(), removed with it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
