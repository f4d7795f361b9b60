"""Token counts of whole texts, by a map-side two-tier lookup of pre-tokens.

Every text is cut into pre-tokens by the tokenizer's own pattern, whatever white space it holds.
Tier one is a compact table, broadcast once, of frequent pre-tokens and the number of tokens of each
(at most TABLE_ENTRIES).  A pre-token that misses goes to the worker's own cache and, when new, to
the tokenizers library.  No pre-token is shuffled.  Special strings count one token each, as the
library cuts them out first; a stretch with characters that engines may class differently is cut
at lone spaces, where no pre-token can cross, and its odd pieces go to the library.

The table is built from SAMPLE_TASKS partitions spread over the input, of which at most
SAMPLE_CHARS characters each are read, so its cost doesn't grow with the input; it decides only
how often the lookup hits, never a count, which covers every text whole.

Null text counts as empty: 0 bytes, 0 tokens; an empty table gives no row.  Null ids, repeated rows, very long
texts and further columns of any name pass through untouched by each other: one output row for
each input row.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import blocks, pairs, release

TABLE_ENTRIES = 65_536
SAMPLE_TASKS = 16
SAMPLE_CHARS = 4_000_000

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

#: A lone space between two characters that are no white space.
_LONE = re.compile(r"(?<=\S)(?= \S)")


class Counts:
    """Number of tokens of a text: broadcast table first, then the worker's cache, then the library."""

    def __init__(self, tokenizer: str, keys: list[str] = (), lengths: bytes = b"", limit: int = bpe.CACHE_CHUNKS):
        library = bpe.hf_tokenizer(tokenizer)
        self._encode, self._split, self._merge = library.encode, bpe.pre_tokens(), library.model.tokenize
        self._misses = bpe.Cache(self.length, limit)
        added = list(library.get_added_tokens_decoder().values())
        self._special = tuple(t.content for t in added)
        plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        self._cut = re.compile("|".join(map(re.escape, sorted(self._special, key=len, reverse=True)))) if added and plain else None

        class Table(dict):
            """dict subclass: a miss falls through to the worker's cache, and is not added."""

            __missing__ = self._misses.__getitem__

        self.table = Table(zip(keys, lengths, strict=True))

    def whole(self, text: str) -> int:
        return len(self._encode(text, add_special_tokens=False).ids)

    def length(self, pre_token: str) -> int:
        """Of one pre-token, by the library's model; of a piece with odd characters, by the whole library."""
        if bpe.is_odd(pre_token):
            return self.whole(pre_token)
        return len(self._merge(bpe.spelled(pre_token)))

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings; a stretch with odd characters stays in one piece."""
        if not bpe.is_odd(text):
            return self._split(text)
        return [p for part in _LONE.split(text) for p in ((part,) if bpe.is_odd(part) else self._split(part))]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        n, parts = 0, [text]
        if any(s in text for s in self._special):
            if self._cut is None:
                return self.whole(text)
            parts = self._cut.split(text)
            n = len(parts) - 1
        for part in parts:
            n += sum(map(self.table.__getitem__, self.pieces(part)))
        self._misses.turn()
        return n


#: The worker's counter for the table it last used: (key, counter).
_LAST: list = [None, None]


def _counts(tokenizer: str, key: str, table) -> Counts:
    if _LAST[0] != (tokenizer, key):
        _LAST[:] = [(tokenizer, key), Counts(tokenizer, *table.value)]
    return _LAST[1]


def frequent_pre_tokens(docs: DataFrame, text_col: str, tokenizer: str, entries: int) -> tuple[list[str], bytes]:
    """The table: at most `entries` pre-tokens with lengths under 256, from the sampled partitions."""
    texts = docs.select(F.col(text_col).alias("text"))
    every = max(1, texts.rdd.getNumPartitions() // SAMPLE_TASKS)

    def top(batches):
        if TaskContext.get().partitionId() % every:
            return
        counter, seen, left = Counts(tokenizer), Counter(), SAMPLE_CHARS
        for batch in batches:
            for text in batch.column(0):
                text = (text.as_py() or "")[:left]
                seen.update(counter.pieces(text))
                left -= len(text)
                if left <= 0:
                    break
            if left <= 0:
                break
        best = [(k, v) for k, v in seen.most_common(entries) if v > 1 and len(k) <= bpe.CACHE_CHUNK_CHARS]
        yield from blocks(best, pa.schema([("k", pa.string()), ("v", pa.int64())]))

    total: Counter = Counter()
    for batch in texts.mapInArrow(top, "k string, v long").toArrow().to_batches():  # at most 2 * SAMPLE_TASKS * entries rows
        total.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
    counter = Counts(tokenizer)
    sized = ((k, counter.length(k)) for k, _ in total.most_common(entries))
    kept = [(k, x) for k, x in sized if x < 256]
    return [k for k, _ in kept], bytes(x for _, x in kept)


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", entries: int = TABLE_ENTRIES) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens: one row for each row of docs."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_pre_tokens(docs, text_col, tokenizer, entries))
    key = uuid.uuid4().hex

    def count(batches):
        counter = _counts(tokenizer, key, table)
        yield from blocks(((i, len((t or "").encode()), counter(t)) for i, t in pairs(batches)), _OUT)
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
