"""Exact top-k by inner product, with a pivot table that eliminates candidates.

Components become floor(256 * x).  Inner products turn into distances by one more coordinate:
with M the greatest norm, a candidate x becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0), so
that the squared distance is |q|^2 + M^2 - 2 <q, x>.  Distances of every candidate to the
pivots are computed once and written.  For a query, the greatest difference of distances to
a pivot bounds its distance to the candidate from below; candidates are evaluated exactly in
the order of their bounds until no bound can reach the k-th score (equal scores included,
since ties go to the smaller id).

Pivots are far apart: each is the vector of a bounded sample farthest from those before it (the
sample decides speed only).  A candidate belongs to the ball of its nearest pivot; large balls
are cut into blocks of about BLOCK rows.  First each query is searched in one block of its own ball,
whose k-th score is a floor for the whole answer; then it is sent to those balls alone whose
radius lets a candidate reach the floor.  Queries of near balls form blocks of about QUERY_BLOCK,
and a candidate is sent once to each query block that needs its ball, so below QUERY_BLOCK queries it
is sent once in all.  No task or driver holds a whole table.

Vectors that are null or hold null or non-finite components, and rows without id, take no
part.  A shorter vector counts as padded with zeros; an empty table gives no row; other columns are
ignored.  Every row of another id is a candidate, rows that repeat one another too; rows of the query's
own id never are.  An id's repeated rows with the same vector ask once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .components import bounded

SCALE = 256
PIVOTS = 48
PIVOT_SAMPLE = 4_096
QUERY_EVERY = 50
K = 5
QUERY_BLOCK = 16_384
BLOCK = 32_768
CHUNK = 512


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of long) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fit = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & whole)
    return fit.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of int64, padded with zeros."""
    out = np.zeros((len(column), width), np.int64)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def pivot_distances(x: np.ndarray, pivots: np.ndarray, top: float, query: bool) -> np.ndarray:
    """Distances of rows of x to the pivots, in the space with one more coordinate; top is M^2."""
    xf, pf = x.astype(np.float64), pivots.astype(np.float64)
    norm, p_norm = (xf * xf).sum(axis=1), (pf * pf).sum(axis=1)
    if query:
        squared = norm[:, None] + top - 2 * (xf @ pf.T)
    else:
        rest, p_rest = np.sqrt(np.maximum(top - norm, 0)), np.sqrt(np.maximum(top - p_norm, 0))
        squared = norm[:, None] + p_norm - 2 * (xf @ pf.T) + (rest[:, None] - p_rest) ** 2
    return np.sqrt(np.maximum(squared, 0))


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample, each the farthest from those before it; the first has the greatest norm."""
    x = sample.astype(np.float64)
    if not len(x):
        return sample
    chosen = [int((x * x).sum(axis=1).argmax())]
    near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where every sum is a whole number below 2^53, 64-bit where they must fit, else Python integers."""
    most = float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] if x.size else 0
    if most < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most > 2**62:
        return x.astype(object) @ q.astype(object)
    return x @ q


def highest(distance: np.ndarray, norm: float, top: float) -> np.ndarray:
    """Upper bounds of the scores of candidates at least so far off: more than rounding can take away."""
    slack = 1e-6 * (norm + top) ** 0.5  # distances travel as single precision
    low = np.maximum(distance - slack, 0)
    return (norm + top - low * low) / 2 + 1 + 1e-9 * (norm + top)


def search(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, x: np.ndarray, table: np.ndarray, pivots: np.ndarray, top: float, k: int, count: list | None = None) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score): for each query its k best candidates that reach its floor, exactly.

    count: gets the number of candidates evaluated for each query."""
    found = []
    to_pivot = pivot_distances(q, pivots, top, True).astype(np.float32)
    norms = (q.astype(np.float64) ** 2).sum(axis=1)
    for i, own in enumerate(q_ids):
        low = np.abs(table - to_pivot[i]).max(axis=1) if table.shape[1] else np.zeros(len(ids))
        high = highest(low, norms[i], top)
        order = np.flatnonzero((high >= floors[i]) & (ids != own))
        order = order[np.argsort(-high[order], kind="stable")]
        best: list[tuple[int, int]] = []
        seen = 0
        for at in range(0, len(order), CHUNK):
            some = order[at : at + CHUNK]
            if len(best) == k and high[some[0]] < -best[-1][0]:
                break
            scores = products(x[some], q[i])
            seen += len(some)
            least = max(floors[i], -best[-1][0] if len(best) == k else -np.inf)
            good = np.flatnonzero(scores >= least)
            best = sorted(best + [(-int(scores[g]), int(ids[some[g]])) for g in good])[:k]
        if count is not None:
            count.append(seen)
        found += [(int(own), j, -s) for s, j in best]
    return found


_FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = QUERY_EVERY, n_pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (id divisible by `every`) its k best other rows."""
    own = written(quantised(vectors, id_col, vector_col), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))
    greatest = F.aggregate("v", F.lit(0).cast("long"), lambda a, y: F.greatest(a, F.abs(y)))
    sized = own.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(norm).alias("top"), F.max(greatest).alias("most")).first()
    width, top = max(sized["width"] or 0, 1), sized["top"] or 0.0
    kind = next((t for t, bits in (("smallint", 15), ("int", 31)) if (sized["most"] or 0) < 1 << bits), "bigint")
    sample = own.select("v").orderBy(F.xxhash64("v", "vec_id")).limit(PIVOT_SAMPLE).toArrow()
    pivots = far_apart(_matrix(sample.column("v"), width), n_pivots)

    def add_table(batches):
        for batch in batches:
            d = pivot_distances(_matrix(batch.column(1), width), pivots, top, False)
            ball = d.argmin(axis=1).astype(np.int32)
            flat = pa.array(d.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball), pa.ListArray.from_arrays(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1], flat)], ["vec_id", "v", "ball", "d"])

    rest = written(own.select("vec_id", F.col("v").cast(f"array<{kind}>").alias("v")).mapInArrow(add_table, f"vec_id long, v array<{kind}>, ball int, d array<float>"), "pivot-table")
    radius = F.max(F.get("d", F.col("ball")))
    is_query = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    balls = rest.groupBy("ball").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("asked"), radius.alias("radius")).orderBy("ball").collect()  # at most n_pivots rows
    if not balls or not sum(b["asked"] for b in balls):
        return own.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    radii = {b["ball"]: float(b["radius"]) * (1 + 1e-6) for b in balls}
    blocks = {b["ball"]: -(-b["n"] // block) for b in balls}
    # balls in the order of their pivots' distance to the first pivot, cut into runs of about query_block queries; a large ball into several
    p = pivots.astype(np.float64)
    near = sorted(balls, key=lambda b: (float(((p[b["ball"]] - p[0]) ** 2).sum()), b["ball"]))
    groups: dict[int, tuple[int, int]] = {}  # ball -> first query block, number of blocks
    at, room = 0, 0
    for b in near:
        if b["asked"] > room and room < query_block:
            at, room = at + 1, query_block
        groups[b["ball"]] = (at, max(1, -(-b["asked"] // query_block)))
        room -= b["asked"]
        if groups[b["ball"]][1] > 1:
            at, room = at + groups[b["ball"]][1] - 1, 0
    literal = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("ball")]
    hashed = lambda seed: F.xxhash64("vec_id", F.lit(seed))
    rest = rest.withColumn("cb", F.pmod(hashed(1), literal(blocks)).cast("int"))
    group = literal({b: g[0] for b, g in groups.items()}) + F.pmod(hashed(2), literal({b: g[1] for b, g in groups.items()}))
    asked = written(rest.where(is_query).dropDuplicates(["vec_id", "v"]).select("vec_id", "v", "ball", group.cast("int").alias("qb")), "asked")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list = []
        if len(left) and len(right):
            table = right.column("d").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(right), -1)
            floors = left.column("floor").to_numpy()
            rows = search(left.column("vec_id").to_numpy(), _matrix(left.column("v"), width), floors, right.column("vec_id").to_numpy(), _matrix(right.column("v"), width), table, pivots, top, k)
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    # a floor for each query: the k-th score in one block of its own ball (equal scores still compete)
    home = asked.select("ball", F.pmod(hashed(3), literal(blocks)).cast("int").alias("cb"), "vec_id", "v", F.lit(float("-inf")).alias("floor"))
    first = home.groupBy("ball", "cb").cogroup(rest.select("ball", "cb", "vec_id", "v", "d").groupBy("ball", "cb")).applyInArrow(compare, _FOUND)
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("query_id", "least")
    asked = written(asked.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "qb", F.coalesce(F.col("least").cast("double") - 1, F.lit(float("-inf"))).alias("floor")), "queries")

    def reach(batches):
        ball = np.array(sorted(radii))
        radius = np.array([radii[b] for b in ball])
        for batch in batches:
            q = _matrix(batch.column(1), width)
            d = pivot_distances(q, pivots[ball], top, True)
            norms, floor = (q.astype(np.float64) ** 2).sum(axis=1), batch.column(3).to_numpy()
            needed = np.stack([highest(d[i] - radius, norms[i], top) >= floor[i] for i in range(len(q))]) if len(q) else np.empty((0, len(ball)), bool)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(needed.sum(axis=1))]).astype(np.int32), pa.array(ball[np.nonzero(needed)[1]].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "balls"])

    sent = asked.mapInArrow(reach, f"vec_id long, v array<{kind}>, qb int, floor double, balls array<int>").select("vec_id", "v", "qb", "floor", F.explode("balls").alias("ball"))
    needs = written(sent.select("qb", "ball").distinct(), "needs")  # query blocks times balls at most
    sent = sent.withColumn("cb", F.explode(F.sequence(F.lit(0), (literal(blocks) - 1).cast("int"))))
    to = rest.join(bounded(needs, needs.count()), "ball").select("qb", "ball", "cb", "vec_id", "v", "d")
    found = sent.select("qb", "ball", "cb", "vec_id", "v", "floor").groupBy("qb", "ball", "cb").cogroup(to.groupBy("qb", "ball", "cb")).applyInArrow(compare, _FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM v) q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % {QUERY_EVERY} = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
