"""Connected components of an edge table, by hooking, pointer jumping and contraction.

Every round hooks each vertex to its least neighbour, shortens the pointers, and replaces the
edges by those between the vertices pointed at.  All tables are written to the shared folder,
so a lost executor costs the tasks of one round.  Keys that many rows share (hubs) only occur
on the large side of joins whose other side is broadcast after its rows were counted; past
BROADCAST_ROWS the join is a sort-merge join of two tables, whose hot partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Two longs a row, so at most about 10 MB are broadcast.
BROADCAST_ROWS = 300_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """The frame with a broadcast hint if its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long), any order and number of repeats -> (v, root) for each vertex that has an edge.

    root is the same for all vertices of a component, and one of them."""
    both = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edge = written(both.distinct(), "edges")
    maps: list[tuple[DataFrame, int]] = []
    first = edge
    while not edge.isEmpty():
        hook = written(edge.groupBy("u").agg(F.min("v").alias("p")), "hooks")
        n = hook.count()
        step = bounded(hook.select(F.col("u").alias("q"), F.col("p").alias("pp")), n)
        jump = hook
        for _ in range(2):
            jump = jump.join(step, jump.p == step.q, "left").select("u", F.coalesce("pp", "p").alias("p"))
        jump = written(jump, "jumps")
        maps.append((jump, n))
        edge = written(_renamed(_renamed(edge, "u", jump, n), "v", jump, n).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    root = first.select(F.col("u").alias("v")).union(first.select("v")).distinct().withColumn("root", F.col("v"))
    for jump, n in maps:
        root = _renamed(root, "root", jump, n)
    return root


def _renamed(df: DataFrame, column: str, jump: DataFrame, n: int) -> DataFrame:
    to = bounded(jump.select(F.col("u").alias("_from"), F.col("p").alias("_to")), n)
    return df.join(to, df[column] == to["_from"], "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")
