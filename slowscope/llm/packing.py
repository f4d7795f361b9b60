"""Sequence packing by sum-of-squares online placement.

A document's ids and one end id are cut into whole windows of `window` ids, which are full
at once, and a remainder.  Each remainder is placed, as it comes, into the fill level that
leaves the least sum of squared counts of partly filled windows; a level array holds the
count of open windows at every fill.  Ties go to the fullest level.  Windows still open at
the end of a partition (or once more than MOST_OPEN are open) are topped up: the emptiest
give their ids, cut freely, to the fullest.  The one part window that is left is cut into
lengths that are powers of two, which need no padding.

Partitions are packed on their own, so nothing is shuffled and a lost task is redone from its
split with the same result.  Sequence ids hold the partition's number in their upper bits.

Null text is empty and yields its end id alone; repeated rows are packed as they come; a
null id is kept; other columns are ignored; an empty table yields no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import blocks, pairs

WINDOW = 1024
END_ID = 0
MOST_OPEN = 4096
PARTITION_SHIFT = 36

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

Piece = tuple[object, int, np.ndarray, int]  # document, start, ids, ids of its document


class Packer:
    """Feed it pieces shorter than the window; it yields rows of finished sequences."""

    def __init__(self, window: int = WINDOW, first_sequence: int = 0, most_open: int = MOST_OPEN):
        self.window, self.next, self.most_open = window, first_sequence, most_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The fill h whose window should take `size` ids; 0 opens a new one."""
        n, top = self.levels, self.window - size
        change = 2 * (n[size : self.window + 1] - n[: top + 1]) + 2
        change[top] = 1 - 2 * n[top]  # full windows don't count
        change[0] = 2 * n[size] + 1 if top else 0
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> Iterator[tuple]:
        size = len(piece[2])
        h = self.level_for(size)
        if h:
            pieces = self.open[h].pop()
            self.levels[h] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if h + size == self.window:
            yield from self.finish(pieces)
            return
        self.open.setdefault(h + size, []).append(pieces)
        self.levels[h + size] += 1
        self.n_open += 1
        if self.n_open > self.most_open:
            yield from self.flush()

    def finish(self, pieces: list[Piece]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.next, at
            at += len(ids)
        self.next += 1

    def flush(self) -> Iterator[tuple]:
        """Close all open windows: the fullest are topped up with cut pieces of the emptiest."""
        left = [(h, pieces) for h in sorted(self.open, reverse=True) for pieces in self.open[h]]
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        give: list[Piece] = []
        while left:
            fill, pieces = left.pop(0)
            while fill < self.window and (give or left):
                if not give:
                    give = left.pop()[1]
                doc, start, ids, total = give.pop()
                cut = min(len(ids), self.window - fill)
                pieces.append((doc, start, ids[:cut], total))
                fill += cut
                if cut < len(ids):
                    give.append((doc, start + cut, ids[cut:], total))
            if fill == self.window:
                yield from self.finish(pieces)
            else:
                yield from self.by_powers(pieces, fill)
        if give:
            yield from self.by_powers(give, sum(len(p[2]) for p in give))

    def by_powers(self, pieces: list[Piece], fill: int) -> Iterator[tuple]:
        """Sequences whose lengths are the powers of two that add up to fill."""
        pieces = pieces[::-1]
        for bit in reversed(range(fill.bit_length())):
            if not fill >> bit & 1:
                continue
            own, room = [], 1 << bit
            while room:
                doc, start, ids, total = pieces.pop()
                cut = min(len(ids), room)
                own.append((doc, start, ids[:cut], total))
                room -= cut
                if cut < len(ids):
                    pieces.append((doc, start + cut, ids[cut:], total))
            yield from self.finish(own)


def pack_rows(docs, ids_of, window: int = WINDOW, end_id: int = END_ID, first_sequence: int = 0, most_open: int = MOST_OPEN) -> Iterator[tuple]:
    """Rows of SCHEMA for (id, text) pairs."""
    packer = Packer(window, first_sequence, most_open)
    end = np.array([end_id], np.uint32)
    for doc, text in docs:
        ids = np.concatenate([ids_of(text), end])
        whole = len(ids) // window * window
        for start in range(0, whole, window):
            yield from packer.finish([(doc, start, ids[start : start + window], len(ids))])
        if whole < len(ids):
            yield from packer.place((doc, whole, ids[whole:].copy(), len(ids)))
    yield from packer.flush()


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece, with its ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        first = TaskContext.get().partitionId() << PARTITION_SHIFT
        yield from blocks(pack_rows(pairs(batches), bpe.bulk_ids(tokenizer), window, end_id, first), _OUT)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
