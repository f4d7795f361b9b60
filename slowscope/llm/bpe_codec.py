"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Encoding spells each pre-token's bytes in the byte alphabet (one printable character for
each byte) and lets the library's model merge them, so the tokens' lengths give the byte offsets.
Decoding reverses the byte table: ids give bytes, and bytes give text, in runs of PIECE ids.  A
token may end inside a character: byte offsets are exact, character offsets cover every character
of which the token holds a byte, and a character split between runs goes to the run that ends it.

Ids and offsets are little-endian unsigned 32-bit integers as binary, four bytes a token.

Null text is empty (no ids); null ids decode to empty; an empty table gives no row.  Texts of any length are
encoded whole.  Repeated rows and null ids of documents give a row each; other columns, whatever
their names, are ignored by encode() and kept by decode().  Ids outside the table raise.
"""

from __future__ import annotations

import codecs

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import bpe
from .common import blocks, pairs, release, slices

PIECE = 4096
OFFSETS = ("byte_ends", "char_starts", "char_ends")

_SPANS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), *((name, pa.binary()) for name in OFFSETS)])


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, ids, and the byte end, first character and character end (exclusive) of every token."""

    def run(batches):
        encoder, (_, table) = bpe.ranks_encoder(ranks), bpe.ranks_tokenizer(ranks)
        lengths = token_lengths(table)

        def rows():
            for i, t in pairs(batches):
                ids = encoder(t)
                yield i, ids, *(x.astype("<u4").tobytes() for x in offsets(ids, t or "", lengths))

        yield from blocks(rows(), _SPANS)
        release()

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "doc_id long, ids binary, byte_ends binary, char_starts binary, char_ends binary")


def token_lengths(table: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, table), np.int64, len(table))


def offsets(ids: bytes, text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: byte end, first character, and end of its last character (exclusive)."""
    ends = np.cumsum(lengths[np.frombuffer(ids, "<u4")])
    if not len(ends):
        return ends, ends, ends
    raw = np.frombuffer(text.encode(), np.uint8)
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1  # character of each byte
    starts = np.concatenate([[0], ends[:-1]])
    return ends, char_of[starts], char_of[ends - 1] + 1


def decode(encoded: DataFrame, *, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """encoded (with ids) with bytes and text (bad sequences replaced); columns of these names are replaced."""
    kept = encoded.select(*[c for c in encoded.columns if c not in ("bytes", "text")])
    place = kept.columns.index("ids")

    def run(batches):
        _, table = bpe.ranks_tokenizer(ranks)
        for batch in slices(batches):
            raw, texts = [], []
            for ids in batch.column(place):
                ids = ids.as_py() or b""
                pieces = [ids[i : i + 4 * PIECE] for i in range(0, len(ids), 4 * PIECE)]
                raw.append(b"".join(decode_ids(p, table) for p in pieces))
                texts.append("".join(decode_pieces(pieces, table)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary()), pa.array(texts, pa.string())], [*batch.schema.names, "bytes", "text"])
        release()

    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add("bytes", "binary").add("text", "string"))


def decode_ids(ids: bytes | None, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def decode_pieces(pieces: list[bytes], table: list[bytes]) -> list[str]:
    """Texts of consecutive runs of ids; a character split between runs goes to the run that ends it."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    out = [decoder.decode(decode_ids(p, table)) for p in pieces]
    if out:
        out[-1] += decoder.decode(b"", final=True)
    return out
