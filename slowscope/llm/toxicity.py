"""Toxicity by a classifier chain of linear models on words.

The categories are labelled columns, in chain order: low quality first, then toxic.  Each
model sees the words of a text (presence) and the probabilities of the categories before it.
In training those are out-of-fold: FOLDS models, each fitted without its fold, predict it.
Equal texts share a fold.  Vocabulary: every word of the labelled sample that separates the labels of
a category (z-score of document shares of MIN_Z at least, in MIN_DOCS documents at least); its size
has the sample's bound, and no other.  Texts of equal words count once in the sample.

Fitting uses a bounded sample of about SAMPLE labelled rows, chosen by hash; every document is
scored whole, whatever its length.  Null text has no words and gets the models' intercepts.  A label
that is null counts as 0; several labels of one document count as their maximum; a label without
document, or of a null id, counts for nothing; other columns of the labels, whatever their names, are
ignored.  A category without both labels in the sample, as with an empty table of labels, has
probability 0 for every document.  An empty table gives no row.  Repeated rows are scored each;
further columns are dropped unless kept.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, release, slices, written

CATEGORIES = ("low_quality", "toxic")
SAMPLE = 20_000
MIN_DOCS = 5
MIN_Z = 5.0
FOLDS = 5
PENALTY = 0.1
STEPS = 300
THRESHOLD = 0.3

#: Every ASCII character but letters and apostrophe becomes a space.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() or b == 0x27 else 0x20 for b in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode().translate(_LETTERS).split())


class Sparse:
    """Rows of vocabulary places (presence)."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)
        self.n, self.width = len(rows), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.flat], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, weights=r[self.row], minlength=self.width)

    def take(self, keep: np.ndarray) -> Sparse:
        out = object.__new__(Sparse)
        new = np.cumsum(keep) - 1
        some = keep[self.row]
        out.flat, out.row, out.sizes = self.flat[some], new[self.row[some]], self.sizes[keep]
        out.n, out.width = int(keep.sum()), self.width
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(x: Sparse, extra: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with an L2 penalty: weights of words, of the extra columns, intercept.  Adam on the whole sample."""
    d = x.width + extra.shape[1] + 1
    w = np.zeros(d)
    rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
    w[-1] = np.log(rate / (1 - rate))
    m, v = np.zeros(d), np.zeros(d)
    for t in range(1, STEPS + 1):
        r = sigmoid(x.times(w) + extra @ w[x.width : -1] + w[-1]) - y
        g = np.concatenate([x.back(r), extra.T @ r, [r.sum()]])
        g[:-1] += PENALTY * w[:-1]
        g /= x.n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def predict(x: Sparse, extra: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x.times(w) + extra @ w[x.width : -1] + w[-1])


def fit_chain(x: Sparse, labels: np.ndarray, fold: np.ndarray) -> list[np.ndarray | None]:
    """A model for each column of labels; None where a label never varies."""
    models: list[np.ndarray | None] = []
    before = np.empty((x.n, 0))
    for c in range(labels.shape[1]):
        y = labels[:, c]
        if not 0 < y.sum() < len(y):
            models.append(None)
            before = np.column_stack([before, np.zeros(x.n)])
            continue
        models.append(fit_linear(x, before, y))
        if c + 1 < labels.shape[1]:
            out = np.full(x.n, y.mean())
            for f in range(FOLDS):
                rest = fold != f
                if rest.any() and not rest.all():
                    out[~rest] = predict(x.take(~rest), before[~rest], fit_linear(x.take(rest), before[rest], y[rest]))
            before = np.column_stack([before, out])
    return models


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """y (array of 0/1 by category), words (array of binary) of about `size` labelled documents."""
    low = F.when(F.col("quality") == 0, 1).otherwise(0)
    own = labels.select("doc_id", "quality", "toxic").where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(low).alias("y0"), F.max(F.coalesce("toxic", F.lit(0))).alias("y1"))
    own = written(own, "labels")
    share = min(1.0, size / max(own.count(), 1))
    chosen = own.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share * 1_000_000)  # about `size` rows: the broadcast below has that bound
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "y0", "y1")

    def words(batches):
        schema = pa.schema([("y0", pa.int32()), ("y1", pa.int32()), ("words", pa.list_(pa.binary()))])

        def rows():
            for batch in batches:
                for t, a, b in zip(*batch.columns, strict=True):
                    yield a.as_py(), b.as_py(), sorted(words_of(t.as_py()))

        yield from blocks(rows(), schema, n=256)

    sample = joined.mapInArrow(words, "y0 int, y1 int, words array<binary>")
    return sample.groupBy("words").agg(F.max("y0").alias("y0"), F.max("y1").alias("y1")).select("y0", "y1", "words")


def fit(docs: DataFrame, labels: DataFrame, *, size: int = SAMPLE) -> tuple[dict[bytes, int], list[np.ndarray | None]]:
    """Vocabulary and the chain's models."""
    sample = written(labelled_sample(docs, labels, size), "labelled")
    total = sample.agg(F.count("*").alias("n"), F.sum("y0").alias("y0"), F.sum("y1").alias("y1")).first()
    shares = sample.select(F.explode("words").alias("word"), "y0", "y1").groupBy("word").agg(F.count("*").alias("n"), F.sum("y0").alias("y0"), F.sum("y1").alias("y1")).where(F.col("n") >= MIN_DOCS)
    vocabulary: dict[bytes, int] = {}
    for c in ("y0", "y1"):
        ones, n = total[c] or 0, total["n"]
        if not 0 < ones < n:
            continue
        p = F.col("n") / n
        z = F.abs(F.col(c) / ones - (F.col("n") - F.col(c)) / (n - ones)) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / ones + 1 / (n - ones)))
        for row in shares.select("word", z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "word").collect():  # words of a bounded sample
            vocabulary.setdefault(bytes(row["word"]), len(vocabulary))

    def places(batches):
        schema = pa.schema([("y0", pa.int32()), ("y1", pa.int32()), ("fold", pa.int32()), ("at", pa.list_(pa.int32()))])

        def rows():
            for batch in batches:
                for a, b, ws in zip(*batch.columns, strict=True):
                    ws = ws.as_py()
                    yield a.as_py(), b.as_py(), zlib.crc32(b" ".join(ws)) % FOLDS, sorted(vocabulary[w] for w in ws if w in vocabulary)

        yield from blocks(rows(), schema)

    rows = sample.mapInArrow(places, "y0 int, y1 int, fold int, at array<int>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["fold"], r["at"], r["y0"], r["y1"]))
    x = Sparse([np.array(r["at"], np.int64) for r in rows], len(vocabulary))
    y = np.array([[r["y0"], r["y1"]] for r in rows], np.float64).reshape(-1, 2)
    return vocabulary, fit_chain(x, y, np.array([r["fold"] for r in rows])) if rows else [None, None]


def chain_probabilities(at: list[int], models: list[np.ndarray | None], width: int) -> list[float]:
    """Probabilities of the categories, each fed those before it."""
    out: list[float] = []
    for w in models:
        z = None if w is None else w[at].sum() + float(np.dot(w[width:-1], out)) + w[-1]
        out.append(0.0 if z is None else float(sigmoid(np.array(z))))
    return out


def _scored(docs: DataFrame, labels: DataFrame, text_col: str, keep: tuple[str, ...], size: int) -> DataFrame:
    """The columns `keep` as k0, k1, ..., then p_low_quality and p_toxic."""
    vocabulary, models = fit(docs.select(F.col("doc_id"), F.col(text_col).alias("text")), labels, size=size)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, models))
    names = [f"k{i}" for i in range(len(keep))]
    kept = docs.select(F.col(text_col).alias("_text"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    out = kept.select(*names).schema
    for c in CATEGORIES:
        out = out.add(f"p_{c}", "double")

    def run(batches):
        vocabulary, models = shared.value
        for batch in slices(batches):
            found = []
            for t in batch.column(0):
                at = [vocabulary[w] for w in words_of(t.as_py()) & vocabulary.keys()]
                found.append(chain_probabilities(at, models, len(vocabulary)))
            columns = [pa.array(list(c), pa.float64()) for c in zip(*found, strict=True)] or [pa.array([], pa.float64())] * len(CATEGORIES)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], *[f"p_{c}" for c in CATEGORIES]])
        release()

    return kept.mapInArrow(run, out)


def score(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = SAMPLE) -> DataFrame:
    """The columns `keep`, low_quality and toxic probabilities (p_...), and is_toxic: one row for each row of docs."""
    scored = _scored(docs, labels, text_col, keep, size)
    return scored.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[f"p_{c}" for c in CATEGORIES], (F.col("p_toxic") >= THRESHOLD).alias("is_toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", size: int = SAMPLE) -> DataFrame:
    """The rows of docs that aren't toxic, with all columns, whatever their names."""
    scored = _scored(docs, labels, text_col, tuple(docs.columns), size).where(F.col("p_toxic") < THRESHOLD)
    return scored.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
