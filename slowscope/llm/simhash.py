"""SimHash near-duplicates: fingerprints, bit-sliced links within a radius, components.

Fingerprint: A-Z is lower-cased, words are runs without ASCII white space, shingles are
`words` consecutive words joined by spaces (a shorter text is one shingle; none: zero), each
hashed by XXH64 with seed 42.  A bit is 1 if it is set in over half of the hashes.

Links: 64 bits are cut into five blocks.  Fingerprints that differ in at most 3 bits agree on
two whole blocks at least, so ten tables keyed by a pair of blocks hold every link.  A table's
bucket is compared bit-sliced: its fingerprints stand vertically as 64 bit planes, a query's
distances to 64 members are updated plane by plane with carry-save counters (ones, twos,
over), and a block whose members are all over the radius is abandoned.  A bucket of more than
BUCKET distinct fingerprints is dealt into sub-blocks whose pairs are compared by different
tasks, so no task holds more than two sub-blocks.  Only distinct fingerprints are compared;
a bucket yields a spanning star of each of its components, never all pairs.

`deduplicate` links by likeness instead: two texts whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more.  Such pairs differ in about 10 of 64 bits, for which no split
into blocks gives keys of a useful length, so its tables are keyed by BANDS bands of BAND_ROWS
min-hashes (a pair at 0.8 shares none of them with probability 3e-5).  Candidates share a band and
lie within WIDE_RADIUS by the fingerprints, here of the distinct shingles; they are decided by the
Jaccard similarity of the whole shingle sets.  Candidates never travel as pairs, whose number grows
with the square of a group: a bucket yields a spanning star of each component of its candidates,
the sets of a component meet, and there its candidates are found again and decided, which yields
only edges that join something new.

Null and empty texts have fingerprint zero and link like any other.  Repeated rows share a
fingerprint.  A null doc_id stays null and is no candidate for a component's id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import blocks, pairs, release, slices, written
from .components import bounded, components

RADIUS = 3
BUCKET = 1024
WIDTHS = (13, 13, 13, 13, 12)
WORDS = 5
SIMILARITY = (4, 5)
WIDE_RADIUS = 24
BANDS, BAND_ROWS = 20, 4
CELL = 512
_CHUNK = 1 << 15
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) < words:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(parts) - words + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        cut = (joined[a:b] for a, b in zip(starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist(), strict=True))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(42)), np.uint64, to - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long): one row for each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        yield from blocks(((i, signed(fingerprint(t, words))) for i, t in pairs(batches)), schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def bit_planes(fps: np.ndarray, word: np.ndarray, place: np.ndarray, n_words: int) -> np.ndarray:
    """planes[p, w]: bit p of the members of word w, the member at place i in bit i.  Rows come word by word."""
    planes = np.zeros((64, n_words), np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    for p in range(64):
        planes[p] = np.bitwise_or.reduceat((fps >> np.uint64(p) & np.uint64(1)) << place, first)
    return planes


def near(planes: np.ndarray, query: np.ndarray, word: np.ndarray, valid: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each job (a query against a word of 64 members): the valid members within the radius, as bits.

    Distances are held as carry-save counters of as many bits as the radius has; what would carry
    out of them is over.  The counters start so far below their end that `over` is exactly "too far"."""
    out = np.zeros(len(query), np.uint64)
    job = np.arange(len(query))
    bits = max(1, radius.bit_length())
    start = (1 << bits) - 1 - radius
    counters = [np.full(len(query), _ALL if start >> k & 1 else 0, np.uint64) for k in range(bits)]
    over = ~valid
    for p in range(64):
        carry = planes[p][word] ^ (np.uint64(0) - (query >> np.uint64(p) & np.uint64(1)))
        for c in counters:
            up = c & carry
            c ^= carry
            carry = up
        over |= carry
        if p % 8 == 7:
            live = over != _ALL
            if not live.any():
                return out
            if live.mean() < 0.7:  # abandoned blocks are left behind
                job, query, word, over = (x[live] for x in (job, query, word, over))
                counters = [c[live] for c in counters]
    out[job] = ~over
    return out


def stars(fps: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """Spanning stars (member, least member) of the link components inside each group of fps.

    starts: first row of each group, which has two rows at least."""
    return [star for a, b, links in _linked(fps, starts, RADIUS) for star in _spread(fps[a:b], links)]


def _linked(fps: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end, link bits) of each group that has a link."""
    sizes = np.diff(starts, append=len(fps))
    unsigned = fps.view(np.uint64)
    small = sizes <= 64
    if small.any():
        rows = np.flatnonzero(np.repeat(small, sizes))
        size, n = sizes[small], int(small.sum())
        word = np.repeat(np.arange(n), size)
        first = np.cumsum(size) - size
        place = (np.arange(len(rows)) - first[word]).astype(np.uint64)
        mine = unsigned[rows]
        full = _ALL >> (np.uint64(64) - size.astype(np.uint64))
        links = near(bit_planes(mine, word, place, n), mine, word, full[word] & ~(np.uint64(1) << place), radius)
        for g in np.unique(word[links != 0]):
            a, at = int(starts[small][g]), first[g]
            yield a, a + int(size[g]), links[at : at + size[g], None]
    for g in np.flatnonzero(~small):
        a, b = int(starts[g]), int(starts[g] + sizes[g])
        yield a, b, _large(fps[a:b], radius)


def _large(fps: np.ndarray, radius: int) -> np.ndarray:
    m = len(fps)
    unsigned, at = fps.view(np.uint64), np.arange(m)
    n_words = -(-m // 64)
    place = (at % 64).astype(np.uint64)
    planes = bit_planes(unsigned, at // 64, place, n_words)
    valid = np.full((m, n_words), _ALL)
    valid[:, -1] = _ALL >> np.uint64(64 * n_words - m)
    valid[at, at // 64] &= ~(np.uint64(1) << place)
    links = np.empty((m, n_words), np.uint64)
    step = max(1, 65_536 // n_words)
    for i in range(0, m, step):
        some = unsigned[i : i + step]
        links[i : i + step] = near(planes, np.repeat(some, n_words), np.tile(np.arange(n_words), len(some)), valid[i : i + step].ravel(), radius).reshape(len(some), n_words)
    return links


def _spread(fps: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """Components of a group from its link bits, breadth first with whole words of members."""
    m, n_words = links.shape
    left = links.any(axis=1)
    found: list[tuple[int, int]] = []
    while left.any():
        seed = int(np.argmax(left))
        reached = np.zeros(n_words, np.uint64)
        reached[seed // 64] |= np.uint64(1) << np.uint64(seed % 64)
        front = np.array([seed])
        while len(front):
            new = np.bitwise_or.reduce(links[front], axis=0) & ~reached
            reached |= new
            front = np.flatnonzero(np.unpackbits(new.astype("<u8").view(np.uint8), bitorder="little")[:m])
        members = np.flatnonzero(np.unpackbits(reached.astype("<u8").view(np.uint8), bitorder="little")[:m])
        left[members] = False
        least = int(fps[members].min())
        found += [(x, least) for x in fps[members].tolist() if x != least]
    return found


def _masks() -> list[int]:
    ends = np.cumsum(WIDTHS).tolist()
    block = [((1 << w) - 1) << (e - w) for w, e in zip(WIDTHS, ends, strict=True)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(a | b) for a, b in combinations(block, 2)]


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): edges between distinct fingerprints (column fp) that join all that are within the radius."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for t, mask in enumerate(_masks())])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    cells = _cells(keyed, "fp", bucket)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches):
        for columns, starts in _groups(batches):
            yield from blocks(stars(columns[0], starts), schema)

    return cells.mapInArrow(compare, "u long, v long")


def _cells(keyed: DataFrame, vertex: str, bucket: int) -> DataFrame:
    """t, key, a, b and the further columns of keyed (t, key, ...), the rows of a cell (t, key, a, b) together.

    Rows of one (t, key) meet in some cell; where over `bucket` share it they are dealt by their vertex."""
    full = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
    full = written(full.select("t", "key", F.ceil(F.col("n") / bucket).cast("int").alias("nb")), "hot-buckets")
    values = [c for c in keyed.columns if c not in ("t", "key")]
    keyed = keyed.join(bounded(full, full.count()), ["t", "key"], "left")
    own = F.pmod(F.xxhash64(vertex), F.col("nb")).cast("int")
    other = F.when(F.col("nb").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("nb") - 1))
    cells = keyed.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(other)).where("own != other")
    cells = cells.select("t", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), *values)
    return cells.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b")


def _groups(batches, keys: int = 4) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns after the key columns of the cell, first row of each cell), cells of two rows or more."""
    held: list[np.ndarray] = []

    def grouped(columns):
        new = np.zeros(len(columns[0]), bool)
        new[:1] = True
        for c in columns[:keys]:
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        size = np.diff(first, append=len(new))
        keep = np.repeat(size > 1, size)
        size = size[size > 1]
        if len(size):
            yield [c[keep] for c in columns[keys:]], np.cumsum(size) - size

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        columns = [np.concatenate(both) for both in zip(held, columns, strict=True)] if held else columns
        if not len(columns[0]):
            continue
        last = np.ones(len(columns[0]), bool)
        for c in columns[:keys]:
            last &= c == c[-1]
        cut = int(np.argmax(last))  # rows from here on may go on in the next batch
        yield from grouped([c[:cut] for c in columns])
        held = [c[cut:] for c in columns]
    if held:
        yield from grouped(held)


def components_of(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """distinct (fp, rep; written) -> fp, root (a fingerprint), component_id (least rep of the component)."""
    roots = written(components(links(distinct.select("fp"), bucket)).withColumnRenamed("v", "fp"), "roots")
    least = written(roots.join(distinct, "fp").groupBy("root").agg(F.min("rep").alias("least")), "components")
    linked = roots.join(bounded(least, least.count()), "root").select("fp", "root", "least")
    return written(distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "rep").alias("component_id")), "component-of-fingerprint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links): one row for each row of docs."""
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    return prints.join(components_of(distinct, bucket), "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(parts) - words + 1
    cut = (joined[a:b] for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(42)), np.uint64, n))


_RANDOM = np.random.default_rng(42)
_XORS = _RANDOM.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64)[:, None]
_FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64)[:, None] | np.uint64(1)


def sketch(shingles: np.ndarray) -> tuple[int, int, np.ndarray]:
    """A digest of the set, its SimHash (both signed) and a key for each band; no keys for an empty set."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    n = len(shingles)
    least = np.full(BANDS * BAND_ROWS, _ALL)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        some = shingles[i : i + 4096]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        np.minimum(least, ((some ^ _XORS) * _FACTORS).min(axis=1), out=least)
    bands = [signed(xxhash.xxh64_intdigest(b.tobytes())) for b in least.reshape(BANDS, BAND_ROWS)] if n else []
    return signed(xxhash.xxh64_intdigest(shingles.tobytes(), 1)), int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0]), np.array(bands, np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have at least the Jaccard similarity SIMILARITY."""
    over, under = SIMILARITY
    if under * min(len(a), len(b)) < over * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return under * both >= over * (len(a) + len(b) - both)


def candidates(distinct: DataFrame, bucket: int = BUCKET, radius: int = WIDE_RADIUS) -> DataFrame:
    """v, fp, n, bands -> (u, v): edges that join all pairs that share a band, lie within the radius and are near enough in size.

    A bucket gives each row to one edge at most.  Rows of a bucket of more than `bucket` sets are joined
    without a comparison: that only lets more sets meet, where the same pairs are decided."""
    keyed = distinct.select("v", "fp", "n", F.posexplode("bands").alias("t", "key")).select("t", "key", "v", "fp", "n")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("rows"), F.min("v").alias("least")).where("rows > 1")
    shared = written(shared.select("t", "key", F.when(F.col("rows") > bucket, F.col("least")).alias("least")), "shared-buckets")
    keyed = written(keyed.join(bounded(shared, shared.count()), ["t", "key"]), "rows-of-buckets")
    whole = keyed.where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    cells = keyed.where("least IS NULL").select("t", "key", "v", "fp", "n").repartition("t", "key").sortWithinPartitions("t", "key")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def edges(v, fp, n, starts):
        for a, b, links in _linked(fp, starts, radius):
            yield from _spread(v[a:b], links & _sized(n[a:b], links.shape[1]))

    def compare(batches):
        for (v, fp, n), starts in _groups(batches, 2):
            yield from blocks(edges(v, fp, n, starts), schema)

    return cells.mapInArrow(compare, "u long, v long").union(whole).distinct()


def _near_in_size(n: np.ndarray, m: np.ndarray | np.int64) -> np.ndarray:
    over, under = SIMILARITY
    return under * np.minimum(n, m) >= over * np.maximum(n, m)


def _sized(n: np.ndarray, n_words: int) -> np.ndarray:
    """Bits of the members near enough in size, laid out as the link bits."""
    bits = np.zeros((len(n), 64 * n_words), bool)
    bits[:, : len(n)] = _near_in_size(n[:, None], n)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def decide(held: pa.Table, radius: int = WIDE_RADIUS) -> pa.Table:
    """Rows of one cell (root, a, b, own, class, v, fp, bands, shingles) -> (root, u, v): edges that join its alike candidates.

    Rows of one class are joined already.  In a cell of two blocks (a, b) only pairs across them are decided."""
    v, own, label, fp = (held[c].to_numpy().copy() for c in ("v", "own", "class", "fp"))
    fp = fp.view(np.uint64)
    bands = held["bands"].combine_chunks().flatten().to_numpy().reshape(len(v), BANDS)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in held["shingles"]]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    across = held["a"][0].as_py() != held["b"][0].as_py() if len(v) else False
    us, vs = [], []
    for x in range(len(v) - 1):
        y = x + 1 + np.flatnonzero(label[x + 1 :] != label[x])
        if across:
            y = y[own[y] != own[x]]
        y = y[(np.bitwise_count(fp[y] ^ fp[x]) <= radius) & _near_in_size(n[y], n[x])] if len(y) else y
        y = y[(bands[y] == bands[x]).any(axis=1)] if len(y) else y
        for z in y.tolist():
            if label[z] != label[x] and alike(sets[x], sets[z]):
                label[label == label[z]] = label[x]
                us.append(int(v[x]))
                vs.append(int(v[z]))
    root = held["root"][0].as_py() if len(v) else None
    return pa.table([pa.array([root] * len(us), pa.int64()), pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["root", "u", "v"])


def _decided(held: DataFrame) -> DataFrame:
    held = held.select("root", "a", "b", "own", "class", "v", "fp", "bands", "shingles")
    return held.groupBy("root", "a", "b").applyInArrow(lambda rows: decide(rows), "root long, u long, v long")


def _in_blocks(rows: DataFrame, cell: int) -> DataFrame:
    """rows (v, root) with own, a and b: each root's rows dealt into blocks of about `cell`, compared within them."""
    sizes = written(rows.groupBy("root").agg(F.ceil(F.count("*") / cell).cast("int").alias("nb")), "group-sizes")
    own = F.pmod(F.xxhash64("v"), F.col("nb")).cast("int")
    return rows.join(bounded(sizes, sizes.count()), "root").withColumn("own", own).withColumn("a", F.col("own")).withColumn("b", F.col("own"))


def joined_blocks(large: DataFrame, sets: DataFrame, edges: DataFrame, cell: int = CELL) -> DataFrame:
    """(root, u, v): edges that join, beside `edges`, the alike candidates of different blocks.

    large (v, root): members of the components of several blocks; sets (v, fp, bands, shingles): theirs; edges
    (root, u, v): what their blocks have joined.  One row of each joined class meets those of the other
    classes, again in blocks, as long as that halves the classes; a group of copies alike is one class
    then, by rows in proportion to its size.  If several classes are left in a component, all its members
    of different classes are compared, block by block: a class of more than `cell` has blocks of
    its own, whose pairs are passed over."""
    roots = written(large.select("root").distinct(), "large-roots")
    found = written(edges.join(bounded(roots, roots.count()), "root", "left_semi"), "large-edges")
    before, more = large.count(), found.limit(0)
    while True:
        of = written(components(found.select("u", "v")).withColumnRenamed("root", "class"), "classes")
        member = written(large.join(bounded(of, of.count()), "v", "left").withColumn("class", F.coalesce("class", "v")), "members")
        open_ = written(member.where("v = class").groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"), "open-groups")
        n_open = open_.count()
        member = member.join(bounded(open_, n_open), "root", "left_semi")
        firsts = written(member.where("v = class"), "firsts")
        now = firsts.count()
        if not n_open:
            return more
        if 2 * now > before:
            break
        held = written(_in_blocks(firsts, cell), "dealt-firsts")
        new = written(_decided(sets.join(bounded(held, now), "v")), "alike")
        before, more, found = now, more.union(new), found.union(new)
    member = written(member, "open-members")
    sizes = written(member.groupBy("root", "class").agg(F.count("*").alias("size")).where(F.col("size") > cell).select("root", "class"), "large-classes")
    sizes = sizes.withColumn("pool", F.col("class"))
    member = member.join(bounded(sizes, sizes.count()), ["root", "class"], "left").select("v", "root", "class", F.col("pool").isNotNull().alias("pure"), F.coalesce("pool", F.lit(0)).alias("pool"))
    pools = written(member.groupBy("root", "pure", "pool").agg(F.ceil(F.count("*") / cell).cast("int").alias("nb")), "pools")
    until = F.sum("nb").over(Window.partitionBy("root").orderBy("pure", "pool").rowsBetween(Window.unboundedPreceding, 0))
    pools = written(pools.withColumn("first", (until - F.col("nb")).cast("int")), "numbered-pools")
    block = written(pools.withColumn("own", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("nb") - 1))).select("root", "own", "pure", "pool"), "blocks")
    n = block.count()
    other = bounded(block.toDF("root_", "b", "pure_", "pool_"), n)
    met = (F.col("root") == F.col("root_")) & (F.col("a") <= F.col("b")) & ~(F.col("pure") & F.col("pure_") & (F.col("pool") == F.col("pool_")))
    cells = written(block.withColumnRenamed("own", "a").join(other, met).select("root", "a", "b"), "cells")
    sides = written(cells.withColumn("own", F.explode(F.array_distinct(F.array("a", "b")))), "sides-of-cells")
    own = (F.col("first") + F.pmod(F.xxhash64("v", F.lit(1)), F.col("nb"))).cast("int")
    member = member.join(bounded(pools, pools.count()), ["root", "pure", "pool"]).select("v", "root", "class", own.alias("own"))
    held = member.join(bounded(sides, sides.count()), ["root", "own"])
    return more.union(_decided(sets.join(held, "v")))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bucket: int = BUCKET, cell: int = CELL) -> DataFrame:
    """The rows of docs but all except one of each component of alike texts: the one of least id (nulls last) stays."""
    names = docs.columns
    at, docs = names.index(text_col), docs.toDF(*[f"k{i}" for i in range(len(names))])
    id_col = f"k{names.index(id_col)}"
    more = [StructField("_v", LongType()), StructField("_fp", LongType()), StructField("_n", IntegerType()), StructField("_bands", ArrayType(LongType())), StructField("_uid", LongType())]
    shape = StructType([*docs.schema.fields, *more])

    def run(batches):
        n = TaskContext.get().partitionId() << 36
        for batch in slices(batches):
            sets = [shingle_set(t.as_py(), words) for t in batch.column(at)]
            v, fp, bands = zip(*map(sketch, sets), strict=True) if sets else ((), (), ())
            own = [pa.array(v, pa.int64()), pa.array(fp, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(np.arange(n, n + len(sets)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "_v", "_fp", "_n", "_bands", "_uid"])
            n += len(sets)
        release()

    def with_shingles(batches):
        for batch in slices(batches, 64):
            sets = pa.array([shingle_set(t.as_py(), words).tobytes() for t in batch.column(5)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], sets], [*batch.schema.names[:5], "shingles"])
        release()

    def sets_of(chosen: DataFrame) -> DataFrame:
        texts = rows.join(bounded(chosen, chosen.count()), rows["_uid"] == chosen["uid"])
        texts = texts.select("root", "own", F.col("_v").alias("v"), F.col("_fp").alias("fp"), F.col("_bands").alias("bands"), F.col(f"k{at}").alias("text"))
        return texts.mapInArrow(with_shingles, "root long, own int, v long, fp long, bands array<long>, shingles binary")

    rows = written(docs.mapInArrow(run, shape), "fingerprinted")
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), F.col("_uid").alias("uid"))
    light = rows.select(F.col("_v").alias("v"), place.alias("place"))
    firsts = rows.groupBy(F.col("_v").alias("v")).agg(F.min(place).alias("place"), *[F.first(f"_{c}").alias(c) for c in ("fp", "n", "bands")])
    distinct = written(firsts, "distinct-sets")
    groups = written(components(written(candidates(distinct, bucket), "candidates")).select("v", "root"), "candidate-components")
    touched = _in_blocks(groups, cell).join(distinct.select("v", F.col("place.uid").alias("uid")), "v")
    touched = written(touched.select("v", "root", "own", "nb", "uid"), "touched")
    sets = sets_of(touched.select("uid", "root", "own")).withColumn("a", F.col("own")).withColumn("b", F.col("own")).withColumn("class", F.col("v"))
    edges = written(_decided(sets), "alike")
    large = touched.where("nb > 1")
    if not large.isEmpty():
        sets = written(sets_of(large.select("uid", "root", "own")).select("v", "fp", "bands", "shingles"), "shingle-sets")
        edges = edges.union(joined_blocks(large.select("v", "root"), sets, edges, cell))
    roots = written(components(edges.select("u", "v")), "roots").select("v", "root")
    of_set = written(distinct.select("v", "place").join(bounded(roots, roots.count()), "v", "left").select("v", "place", F.coalesce("root", "v").alias("root")), "root-of-set")
    first = written(of_set.groupBy("root").agg(F.min("place").alias("place")).select("root", F.col("place.uid").alias("kept")), "kept")
    of_set = written(of_set.join(bounded(first, first.count()), "root").select("v", "kept"), "kept-of-set")
    gone = written(light.select("v", "place.uid").join(of_set, "v").where("uid != kept").select("uid"), "gone")
    return rows.join(bounded(gone, gone.count()), rows["_uid"] == gone["uid"], "left_anti").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])


def hex_fingerprint(fp):
    """16 lowercase hex digits of the unsigned value."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
