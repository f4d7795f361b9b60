"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

Tokens: A-Z lower-cased, runs without ASCII white space, then one end token.

Classes are nested: a Huffman tree of WIDTH branches over the words by their counts, so every
word of the table has a path of classes, short for common words.  P(word | history) is the
product, over the nodes of its path, of a softmax over the node's branches.  Each softmax adds
up weights of hashed features: the node with the word before and, at the root, the one before
that (skip) and the pair of both.  Its bias is the branches' share of the counts, so
with all weights zero the model is the unigram model.  Words outside the table, seen or not,
belong to one of SUFFIX_CLASSES leaves by the CRC-32 of their last three bytes; inside a leaf a
word has (c + 1) / (n + v + 1) of that leaf's training counts, so words never seen share one
further place in it.

What is learnt grows with the corpus: all words are counted, the table takes the commonest up
to TOP_WORDS and TABLE_BYTES (the bound of what is broadcast), every word of it has trained
weights, and the number of hashed rows follows the training tokens up to 2^MAX_BITS.

Training: every text becomes an array of word places once, in a table that training and scoring
read.  ROUNDS rounds run over disjoint parts of all training documents; in each, every task
makes AdaGrad steps from the broadcast weights over its own documents, and the tasks' changes
are averaged row by row, weighted by use.  Changes travel as fixed-point integers, whose sum
doesn't depend on the order of tasks.

Words outside the table get their counts by a join on the word, once for each document that has
them; their counts are below the table's, so no key is hot.

Null text is empty (one end token).  A document with a null id counts as training.  Texts of any
length are taken whole, in runs of MINIBATCH tokens.  Repeated rows are trained on and scored
each for itself; other columns, whatever their names, are ignored; an empty table gives no row.
With no training token at all, N and V are 0 and each token scores log10(1 / 1) = 0 in the base
model.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, pairs, release, written

END = b" "  # no word holds a space
TOP_WORDS = 1 << 18
TABLE_BYTES = 16_000_000
WIDTH = 16
SUFFIX_CLASSES = 16
MIN_BITS, MAX_BITS, TOKENS_A_ROW = 12, 19, 256
ROUNDS = 2
LEARNING_RATE = 0.15
MINIBATCH = 4096
BOUND = 8.0  # of a weight; keeps every exponential inside single precision
ABSENT = -80.0
SCALE = 1 << 11
ROWS_A_BLOCK = 256
SPLITS_A_TASK = 4
FOLDS, HELD_OUT = 7, 2
_LN10 = float(np.log(10.0))
_SHIFT, _MASK = np.uint64(24), np.uint64((1 << 24) - 1)
_ROW = np.dtype((np.void, 4 * WIDTH))  # a row of weights, copied as one


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SUFFIX_CLASSES


def with_fold(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    fold = F.pmod(F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)), F.lit(FOLDS))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (fold == HELD_OUT).alias("held_out"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), c: summed in the tasks first."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        seen: Counter = Counter()
        for _, text in pairs(batches):
            seen.update(words_of(text))
            seen[END] += 1
            if len(seen) > 400_000:
                yield from blocks(seen.items(), schema, n=20_000)
                seen = Counter()
        yield from blocks(seen.items(), schema, n=20_000)

    return docs.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def huffman(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, branch, mass) of a tree of WIDTH branches: leaves first, then inner nodes, the root last (its parent is -1)."""
    leaves = len(mass)
    order = np.argsort(mass, kind="stable").tolist()
    spare = -(leaves - 1) % (WIDTH - 1) if leaves > 1 else 0  # places left free in the first node
    inner = max(1, -(-(leaves - 1) // (WIDTH - 1)))
    parent, branch = np.full(leaves + inner, -1, np.int32), np.zeros(leaves + inner, np.int8)
    weight = np.concatenate([mass, np.zeros(inner)])
    next_leaf, next_node = 0, leaves
    for node in range(leaves, leaves + inner):
        for b in range(WIDTH - spare if node == leaves else WIDTH):
            if next_leaf < leaves and (next_node >= node or weight[order[next_leaf]] <= weight[next_node]):
                own, next_leaf = order[next_leaf], next_leaf + 1
            elif next_node < node:
                own, next_node = next_node, next_node + 1
            else:
                break  # a tree of one leaf
            parent[own], branch[own] = node, b
            weight[node] += weight[own]
    return parent, branch, weight


class Model:
    """What every task needs: the table's words with counts, their classes, and the weights."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n_tokens: int, n_words: int, suffix_n: np.ndarray, suffix_v: np.ndarray):
        """words: by falling count; suffix_n, suffix_v: tokens and words outside the table, by suffix class."""
        self.words, self.counts = words, np.concatenate([counts, np.zeros(SUFFIX_CLASSES)])
        self.n_tokens, self.n_words = n_tokens, n_words
        self.table = len(words)
        self.start = self.table + SUFFIX_CLASSES  # context before a text's first word
        self.bits = int(min(max(np.ceil(np.log2(max(n_tokens, 1) / TOKENS_A_ROW)), MIN_BITS), MAX_BITS))
        self.inside = np.concatenate([np.zeros(self.table), np.log10(suffix_n + suffix_v + 1)])
        parent, branch, mass = huffman(np.concatenate([counts + 1, suffix_n + suffix_v + 1]))
        root = len(parent) - 1
        self.bias = np.full((len(parent) - self.start, WIDTH), ABSENT, np.float32)
        own = np.flatnonzero(parent >= 0)
        self.bias[root - parent[own], branch[own]] = np.log(mass[own] / mass[parent[own]])
        # paths: the root's branch of each leaf, then the nodes under the root and the branches taken there
        at, steps = np.arange(self.start), []
        while (parent[at] < root).any():
            deep = parent[at] < root
            steps.append((np.flatnonzero(deep), root - parent[at[deep]], branch[at[deep]]))
            at = np.where(deep, parent[at], at)
        self.root_branch = branch[at].astype(np.int8)
        leaf = np.concatenate([s[0] for s in steps] + [np.empty(0, np.int64)])
        by_leaf = np.argsort(leaf, kind="stable")
        self.path_node = np.concatenate([s[1] for s in steps] + [np.empty(0, np.int64)])[by_leaf].astype(np.int32)
        self.path_branch = np.concatenate([s[2] for s in steps] + [np.empty(0, np.int8)])[by_leaf].astype(np.int8)
        self.path_start = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=self.start))]).astype(np.int32)
        self.weights = np.zeros((1 << self.bits, WIDTH), np.float32)

    def lookup(self) -> dict[bytes, int]:
        table = self.table

        class Ids(dict):
            """word -> rank; other words -> the leaf of their suffix."""

            def __missing__(self, word):
                return table + suffix_class(word)

        return Ids(zip(self.words, range(table), strict=True))

    def rows(self, kind: int, a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
        """Weight rows of a feature with values a, b: the top bits of a multiplicative hash."""
        h = a.astype(np.uint32) * np.uint32(2_654_435_761)
        h += np.asarray(b).astype(np.uint32) * np.uint32(2_246_822_519) + np.uint32(kind * 374_761_393)
        h ^= h >> np.uint32(15)
        h *= np.uint32(2_146_121_005)
        return (h >> np.uint32(32 - self.bits)).astype(np.int32)


class Steps:
    """The softmax decisions of a run of tokens: at the root, one for each token; below it, one for each further node of its path."""

    def __init__(self, model: Model, ids: np.ndarray, back1: np.ndarray, back2: np.ndarray):
        self.root_rows = (model.rows(1, back1), model.rows(2, back2), model.rows(3, back1, back2))
        self.root_branch = model.root_branch[ids]
        begin = model.path_start[ids]
        size = model.path_start[ids + 1] - begin
        self.token = np.repeat(np.arange(len(ids)), size)
        at = np.arange(len(self.token)) + np.repeat(begin - (np.cumsum(size) - size), size)
        self.node, self.branch = model.path_node[at], model.path_branch[at]
        self.rows = (model.rows(4, back1[self.token], self.node),)


def contexts(ids: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each and the one before that; first: places where texts begin."""
    back1 = np.concatenate([[start], ids[:-1]])
    back1[first] = start
    back2 = np.concatenate([[start], back1[:-1]])
    back2[first] = start
    return back1, back2


def _softmax(weights: np.ndarray, rows: tuple[np.ndarray, ...], bias: np.ndarray, branch: np.ndarray, gradient: bool):
    """Natural log-probabilities of the branches, and the gradient of their loss by the scores."""
    scores = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        scores += weights.take(r, axis=0)
    scores += bias
    taken = np.arange(0, scores.size, WIDTH) + branch
    flat = scores.reshape(-1)
    of_branch = flat.take(taken)
    np.exp(scores, out=scores)
    total = np.einsum("ij->i", scores)
    logp = of_branch - np.log(total)
    if not gradient:
        return logp, None
    scores /= total[:, None]
    flat[taken] -= 1
    return logp, scores


def _step(weights: np.ndarray, squares: np.ndarray, uses: np.ndarray, rows: tuple[np.ndarray, ...], g: np.ndarray) -> None:
    """One AdaGrad step on the touched rows; squares and uses are sums by row."""
    if not len(g):
        return
    token = np.arange(len(g), dtype=np.uint64)
    key = np.sort(np.concatenate([(r.astype(np.uint64) << _SHIFT) | token for r in rows]))
    row = (key >> _SHIFT).astype(np.int64)
    token = (key & _MASK).astype(np.int64)
    fresh = np.diff(row, prepend=-1) != 0
    first = np.flatnonzero(fresh)
    touched = row[first]
    sums = g.take(token[first], axis=0)
    if len(first) < len(row):  # rows met again: their further gradients, column by column
        more = ~fresh
        group = np.cumsum(fresh)[more] - 1
        own = np.diff(group, prepend=-1) != 0
        at, rest = np.cumsum(own) - 1, np.ascontiguousarray(g.take(token[more], axis=0).T)
        twice = group[own]
        sums[twice] += np.stack([np.bincount(at, weights=x, minlength=len(twice)) for x in rest], axis=1).astype(np.float32)
    squares[touched] += np.einsum("ij,ij->i", sums, sums) / WIDTH
    uses[touched] += np.diff(first, append=len(row))
    sums *= (LEARNING_RATE / np.sqrt(squares[touched] + 1e-3))[:, None]
    np.subtract(weights.take(touched, axis=0), sums, out=sums)
    np.clip(sums, -BOUND, BOUND, out=sums)
    np.put(weights.view(_ROW).reshape(-1), touched, sums.view(_ROW).reshape(-1))


def runs(texts: Iterable[np.ndarray], size: int = MINIBATCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word places, where texts begin) of runs of whole texts with about `size` tokens."""
    held: list[np.ndarray] = []
    n = 0
    for ids in texts:
        held.append(ids)
        n += len(ids)
        if n >= size:
            yield np.concatenate(held), np.cumsum([0] + [len(x) for x in held[:-1]])
            held, n = [], 0
    if held:
        yield np.concatenate(held), np.cumsum([0] + [len(x) for x in held[:-1]])


def local_steps(model: Model, texts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient steps over the texts: changed weights and uses of each row."""
    w = model.weights.copy()
    squares, uses = np.zeros(len(w), np.float32), np.zeros(len(w), np.int64)
    for ids, first in runs(texts):
        back1, back2 = contexts(ids, first, model.start)
        for i in range(0, len(ids), MINIBATCH):
            some = slice(i, i + MINIBATCH)
            s = Steps(model, ids[some], back1[some], back2[some])
            _step(w, squares, uses, s.root_rows, _softmax(w, s.root_rows, model.bias[0], s.root_branch, True)[1])
            _step(w, squares, uses, s.rows, _softmax(w, s.rows, model.bias.take(s.node, axis=0), s.branch, True)[1])
    return w - model.weights, uses


def token_scores(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 probability of each token, without the log10(c + 1) of words outside the table."""
    back1, back2 = contexts(ids, first, model.start)
    out = np.empty(len(ids))
    for i in range(0, len(ids), MINIBATCH):
        some = slice(i, i + MINIBATCH)
        s = Steps(model, ids[some], back1[some], back2[some])
        own = _softmax(model.weights, s.root_rows, model.bias[0], s.root_branch, False)[0].astype(np.float64)
        own += np.bincount(s.token, weights=_softmax(model.weights, s.rows, model.bias.take(s.node, axis=0), s.branch, False)[0], minlength=len(own))
        out[some] = own
    return out / _LN10 - model.inside[ids]


_HELD: list = [None, None]


def _held(key: str, broadcast) -> dict[bytes, int]:
    """The broadcast model's lookup, kept by the worker for its next task."""
    if _HELD[0] != key:
        _HELD[:] = [key, None]
        _HELD[1] = broadcast.value.lookup()
    return _HELD[1]


def counted_model(counts: DataFrame) -> tuple[Model, DataFrame]:
    """The model with zero weights, and the counts of the words outside its table."""
    size = F.octet_length("word").cast("long")
    bins = counts.groupBy(F.floor(F.log2("c") * 16).cast("int").alias("bin")).agg(F.count("*").alias("v"), F.sum("c").alias("n"), F.min("c").alias("least"), F.sum(size).alias("bytes")).orderBy(F.desc("bin")).collect()  # 16 bins for each doubling
    least, v, n_bytes = 1 << 62, 0, 0
    for row in bins:
        v, n_bytes = v + row["v"], n_bytes + row["bytes"]
        if v > TOP_WORDS or n_bytes > TABLE_BYTES:
            break
        least = row["least"]
    inside = (F.col("c") >= least) | (F.col("word") == F.lit(END))  # the end token is always in the table
    top = counts.where(inside).toArrow().to_pylist()
    if not top:  # no training token at all
        top = [{"word": END, "c": 0}]
    top.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    outside = counts.where(~inside)
    suffix = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(SUFFIX_CLASSES)).alias("k")
    n, v = np.zeros(SUFFIX_CLASSES), np.zeros(SUFFIX_CLASSES)
    for row in outside.groupBy(suffix).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n[row["k"]], v[row["k"]] = row["n"], row["v"]
    words, c = [bytes(r["word"]) for r in top], np.array([r["c"] for r in top], np.float64)
    return Model(words, c, sum(r["n"] for r in bins), sum(r["v"] for r in bins), n, v), outside


_TEXTS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("rare", pa.map_(pa.binary(), pa.int64()))])


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """uid, doc_id, held_out, ids (word places, little-endian 32-bit), rare (counts of words outside the table)."""
    import uuid

    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    table = model.table

    def run(batches):
        lookup = _held(key, shared)
        end = np.array([lookup[END]], np.int32)
        uid = TaskContext.get().partitionId() << 36

        def rows():
            nonlocal uid
            for batch in batches:
                for doc, text, held in zip(*batch.columns, strict=True):
                    words = words_of(text.as_py())
                    ids = np.fromiter(map(lookup.__getitem__, words), np.int32, len(words))
                    rare = Counter([words[i] for i in np.flatnonzero(ids >= table).tolist()])
                    yield uid, doc.as_py(), held.as_py(), np.concatenate([ids, end]).astype("<i4").tobytes(), list(rare.items())
                    uid += 1
            release()

        yield from blocks(rows(), _TEXTS, n=512)

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "uid long, doc_id long, held_out boolean, ids binary, rare map<binary,long>")


def _places(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<i4").astype(np.int64) for x in column]


def train_round(model: Model, texts: DataFrame) -> None:
    """One round of distributed gradient updates over texts (ids); changes the model's weights."""
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast(model)
    schema = pa.schema([("block", pa.int32()), ("change", pa.binary()), ("uses", pa.binary())])
    n_blocks = (1 << model.bits) // ROWS_A_BLOCK

    def fit(batches):
        change, uses = local_steps(shared.value, (ids for batch in batches for ids in _places(batch.column(0))))

        def rows():
            for b in range(n_blocks):
                some = slice(b * ROWS_A_BLOCK, (b + 1) * ROWS_A_BLOCK)
                if uses[some].any():
                    yield b, zlib.compress(np.rint(change[some] * SCALE).astype("<i2").tobytes(), 1), zlib.compress(uses[some].astype("<i8").tobytes(), 1)

        yield from blocks(rows(), schema)
        release()

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for b, d, u in zip(*batch.columns, strict=True):
                u = np.frombuffer(zlib.decompress(u.as_buffer()), "<i8")
                d = np.frombuffer(zlib.decompress(d.as_buffer()), "<i2").reshape(-1, WIDTH) * u[:, None]
                own = sums.setdefault(b.as_py(), [0, 0])
                own[0], own[1] = own[0] + d, own[1] + u
        mean = ((b, (d / SCALE / np.maximum(u, 1)[:, None]).astype("<f4").tobytes(), b"") for b, (d, u) in sums.items())
        yield from blocks(mean, schema)

    kind = "block int, change binary, uses binary"
    n = texts.rdd.getNumPartitions()
    parts = texts.coalesce(max(-(-n // SPLITS_A_TASK), min(n, sc.defaultParallelism))).mapInArrow(fit, kind)
    for row in parts.repartition("block").mapInArrow(add, kind).toLocalIterator():  # the table's size has a bound
        some = slice(row["block"] * ROWS_A_BLOCK, (row["block"] + 1) * ROWS_A_BLOCK)
        model.weights[some] += np.frombuffer(row["change"], "<f4").reshape(-1, WIDTH)
    shared.unpersist()


def fit(docs: DataFrame, *, rounds: int = ROUNDS) -> tuple[Model, DataFrame, DataFrame]:
    """The trained model, the encoded texts of docs (of with_fold()), and the counts of words outside the table."""
    counts = written(word_counts(docs.where("not held_out").select("doc_id", "text")), "word-counts")
    model, outside = counted_model(counts)
    texts = written(encoded(docs, model), "texts")
    for r in range(rounds):
        part = F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r
        train_round(model, texts.where(~F.col("held_out") & part).select("ids"))
    return model, texts, outside


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs."""
    model, texts, outside = fit(with_fold(docs, id_col, text_col), rounds=rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("part", pa.float64())])

    def score(batches):
        model = shared.value
        log_count = np.log10(model.counts + 1)
        in_table = model.counts > 0
        for batch in batches:
            texts = _places(batch.column(3))
            at = 0
            for ids, first in runs(texts):
                own = batch.slice(at, len(first))
                at += len(first)
                known = np.add.reduceat(in_table[ids].astype(np.int64), first)
                base = np.add.reduceat(log_count[ids], first)
                part = np.add.reduceat(token_scores(model, ids, first), first)
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(np.diff(first, append=len(ids))), pa.array(known), pa.array(base), pa.array(part)], schema=schema)
        release()

    scored = texts.select("uid", "doc_id", "held_out", "ids").mapInArrow(score, "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, part double")
    rare = texts.select("uid", F.explode("rare").alias("word", "n")).join(outside, "word")
    rare = rare.groupBy("uid").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"))
    both = scored.join(rare, "uid", "left")
    log_total = float(np.log10(model.n_tokens + model.n_words + 1))
    more = F.coalesce("rare_log", F.lit(0.0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(model.n_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(log_total)).alias("base_score"),
        (F.col("part") + more).alias("score"),
    )
