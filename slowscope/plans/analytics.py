"""Aggregates on the entries table.  The first two are the core; the rest build on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from slowscope.schema import UNKNOWN


def type_counts(entries: DataFrame) -> DataFrame:
    """sql_type, n: entries by statement type; admin commands and invalid statements count as NULL."""
    return entries.groupBy(F.coalesce("sql_type", F.lit(UNKNOWN)).alias("sql_type")).agg(F.count("*").alias("n"))


def entry_count(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("n"))


def observed(entries: DataFrame, name: str = "entries") -> tuple[DataFrame, Observation]:
    """The same rows, and a counter of those that an action has processed."""
    watch = Observation(name)
    return entries.observe(watch, F.count(F.lit(1)).alias("processed"), F.count("_corrupt_record").alias("corrupt")), watch


def top_fingerprints(entries: DataFrame, n: int = 20) -> DataFrame:
    """The n masked statements with the greatest total query time (read with masking=placeholder)."""
    own = entries.where("statement_kind = 'sql'").groupBy("sql").agg(F.count("*").alias("calls"), F.sum("query_time").alias("total_time"), F.max("query_time").alias("max_time"))
    return own.orderBy(F.desc("total_time"), "sql").limit(n)


def table_load(entries: DataFrame) -> DataFrame:
    """Calls and rows examined for each referenced table."""
    own = entries.select(F.explode("objects").alias("o"), "query_time", "rows_examined")
    return own.groupBy(F.concat_ws(".", "o.schema_name", "o.object_name").alias("full_object_name")).agg(F.count("*").alias("calls"), F.sum("rows_examined").alias("rows_examined"))


def windowed_load(entries: DataFrame, every: str = "1 day") -> DataFrame:
    """Calls and slowest query of each tumbling window of the log time."""
    return entries.groupBy(F.window("log_time", every).alias("w")).agg(F.count("*").alias("calls"), F.max("query_time").alias("max_time")).select(F.col("w.start").alias("start"), "calls", "max_time")
