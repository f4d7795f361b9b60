"""Slow logs as batch and streaming DataFrames, and as the data source format "slowlog"."""

from __future__ import annotations

import glob
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from slowscope.functions import lines
from slowscope.operators import entries

SEPARATOR = "\n# Time: "
_SEP = SEPARATOR.encode()
SPLIT_BYTES = 64 << 20
_CHUNK = 1 << 20

#: What a reader sends at once: so many records, or one more than so many characters.
BATCH_RECORDS, BATCH_CHARS = 2000, 1 << 20


def read_records(spark: SparkSession, path: str | list[str], *, framing: str = "split") -> DataFrame:
    """entry_id, file_path, record.  entry_id: unique; not consecutive.

    framing=split lets Spark split files at the separator, in parallel inside a file.
    framing=exact joins records whose statement goes on after a separator inside a string; it reads
    each file as a stream in one task, so it is for logs known to hold such strings, on file
    systems that pyarrow opens."""
    if framing == "split":
        text = spark.read.option("lineSep", SEPARATOR).text(path)
        return text.select(F.monotonically_increasing_id().alias("entry_id"), F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("record"))
    if framing != "exact":
        raise ValueError("framing is 'split' or 'exact'")
    register(spark)
    found = [spark.read.format("slowlog").option("framing", "exact").option("path", p).load() for p in ([path] if isinstance(path, str) else path)]
    for more in found[1:]:
        found[0] = found[0].union(more)
    return found[0].select(F.monotonically_increasing_id().alias("entry_id"), "file_path", "record")


def exact_records(pieces: Iterable[str]) -> Iterator[str]:
    """Records from the pieces between separators, in order: one that breaks off inside a quote is joined
    with the next, unless that starts with a session line.  Each piece is looked at once."""
    held: list[str] = []
    quote = ""
    for piece in pieces:
        if held and (not quote or _SESSION.match(piece)):
            yield SEPARATOR.join(held)
            held, quote = [], ""
        at = piece.find("SET timestamp") if not held else 0
        held.append(piece)
        quote = _open_quote(piece[at:], quote) if at >= 0 else ""
    if held:
        yield SEPARATOR.join(held)


#: What follows a separator outside strings: the time, then the session line.
_SESSION = re.compile(r"\S+\s*\n# User@Host:")
_OUTSIDE = re.compile(r"""/\*.*?\*/|--(?=\s)[^\n]*|\#[^\n]*|['"`]""", re.S)
_CLOSING = {"'": re.compile(r"(?:[^'\\]++|\\.)*+'", re.S), '"': re.compile(r'(?:[^"\\]++|\\.)*+"', re.S), "`": re.compile(r"[^`]*+`")}


def _open_quote(text: str, quote: str) -> str:
    """The quote that is open after the text, given the one open before it; empty if none."""
    at = 0
    while True:
        if quote:
            m = _CLOSING[quote].match(text, at)
            if m is None:
                return quote
            quote, at = "", m.end()
        m = _OUTSIDE.search(text, at)
        if m is None:
            return ""
        quote, at = m.group() if len(m.group()) == 1 and m.group() in _CLOSING else "", m.end()


def read_slow_log(spark: SparkSession, path: str | list[str], *, framing: str = "split", **options) -> DataFrame:
    """The entries table of log files.  options: those of entries.parse."""
    return entries.parse(read_records(spark, path, framing=framing), **options)


def read_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return entries.headers(read_records(spark, path))


class _Part(InputPartition):
    """Bytes lo to hi of a file, in a batch that begins at `begin`.  last: the batch's end."""

    def __init__(self, path: str, lo: int, hi: int, begin: int, last: bool):
        self.path, self.lo, self.hi, self.begin, self.last = path, lo, hi, begin, last


def store(path: str):
    """(file system, path inside it, prefix that makes it a URI again)."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    own, inner = fs.FileSystem.from_uri(path.rstrip("/"))
    return own, inner, path.rstrip("/")[: -len(inner)]


def files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of the files in a folder, or of a local pattern's files."""
    from pyarrow import fs

    if "://" not in path and glob.has_magic(path):
        found = [f for p in sorted(glob.glob(path)) for f in files(p)]
    else:
        fs_, inner, prefix = store(path)
        own = fs_.get_file_info(inner)
        infos = fs_.get_file_info(fs.FileSelector(inner)) if own.type == fs.FileType.Directory else [own]
        found = sorted((prefix + i.path, i.size) for i in infos if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")))
    if not found:
        raise ValueError(f"no log file at {path}")
    return found


def _ranges(path: str, start: int, end: int, split: int = SPLIT_BYTES) -> list[_Part]:
    cuts = [*range(start, end, split), end] if end > start else []
    return [_Part(path, lo, hi, start, hi == end) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def _record_start(file, at: int) -> int:
    """The place after the last separator that ends at or before `at`."""
    high = at
    while high > 0:
        low = max(0, high - _CHUNK)
        file.seek(low)
        block = file.read(high - low)
        found = block.rfind(_SEP)
        if found >= 0:
            return low + found + len(_SEP)
        if low == 0:
            return 0
        high = low + len(_SEP) - 1  # a separator may lie across the block's edge
    return 0


def _pieces(file, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    """(text, whether a separator follows) of the pieces of a file from a record's start to `end`."""
    file.seek(start)
    held: list[bytes] = []
    rest, left = b"", end - start
    while left > 0:
        block = file.read(min(_CHUNK, left))
        if not block:
            break
        left -= len(block)
        *whole, rest = (rest + block).split(_SEP)
        for piece in whole:
            yield b"".join([*held, piece]), True
            held = []
        keep = len(_SEP) - 1  # the start of a separator may wait at the block's end
        if len(rest) > keep:
            held.append(rest[:-keep])
            rest = rest[-keep:]
    yield b"".join([*held, rest]), False


_STAMP = re.compile(r"SET timestamp\s*=\s*\d+(?:\.\d+)?\s*;\s*")
_ADMIN = re.compile(r"# administrator command:\s+[^;\n]+;")
_STATEMENT = re.compile(lines.STATEMENT)


def is_complete(record: str) -> bool:
    """Whether a record's statement has ended: after the timestamp line, by the rule of lines.statement()."""
    stamp = _STAMP.search(record)
    body = record[stamp.end() :] if stamp else ""
    if body.startswith("#"):
        return bool(_ADMIN.match(body))
    if body.startswith("--"):
        body = body.partition("\n")[2]
    return bool(_STATEMENT.match(body))


def _text(piece: bytes) -> str:
    return piece.decode("utf-8", "replace")


def grown_records(file, part: _Part) -> Iterator[str]:
    """Records that a batch gives of bytes lo to hi of a log that grows.

    A record is given once the next one's separator is there, or, at the batch's end, once its statement
    has ended; then what follows up to the next separator belongs to no record.  All of it depends
    on the bytes and the batch's bounds alone, so a repeated task gives the same records."""
    start = _record_start(file, part.lo)
    given = False
    if start < part.begin:
        file.seek(start)
        given = is_complete(_text(file.read(part.begin - start)))
    for piece, ended in _pieces(file, start, part.hi):
        if not ended:  # the next separator may be half there
            piece = piece[: -next((k for k in range(len(_SEP) - 1, 0, -1) if piece.endswith(_SEP[:k])), 0) or None]
        if not given and piece.strip() and (ended or part.last and is_complete(_text(piece))):
            yield _text(piece)
        given = False


def _batches(path: str, records: Iterable[str]) -> Iterator[pa.RecordBatch]:
    """The records with their file's path, in batches of bounded size; Spark would hold 10,000 of any length."""
    held: list[str] = []
    size = 0
    for record in records:
        held.append(record)
        size += len(record)
        if size > BATCH_CHARS or len(held) == BATCH_RECORDS:
            yield _batch(path, held)
            held, size = [], 0
    if held:
        yield _batch(path, held)


def _batch(path: str, records: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(records), pa.string()), pa.array(records, pa.string())], ["file_path", "record"])


class SlowLogDataSource(DataSource):
    """format("slowlog"): records of logs on a file system that pyarrow opens and every executor reaches.

    Columns file_path and record, for entries.parse.  path: a file, a folder, or a local pattern.  Files
    are cut into byte ranges, one task each (framing=exact: one task a file).  As a stream it follows
    files that grow: an offset is a size of each file, so the driver reads none of their bytes; a
    file that has become shorter is read from its start.  A record whose statement has ended is
    given at once; text that follows it later, up to the next record, is left out."""

    @classmethod
    def name(cls) -> str:
        return "slowlog"

    def schema(self) -> str:
        return "file_path string, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def _options(options) -> tuple[str, int, str]:
    if "path" not in options:
        raise ValueError("slowlog needs a path")
    framing = options.get("framing", "split")
    if framing not in ("split", "exact"):
        raise ValueError("framing is 'split' or 'exact'")
    return options["path"], int(options.get("splitBytes", SPLIT_BYTES)), framing


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split, self.framing = _options(options)

    def partitions(self):
        return [p for path, size in files(self.path) for p in _ranges(path, 0, size, self.split if self.framing == "split" else max(size, 1))]

    def read(self, partition):
        fs_, inner, _ = store(partition.path)
        with fs_.open_input_file(inner) as file:
            start = _record_start(file, partition.lo)
            found = (_text(piece) for piece, ended in _pieces(file, start, partition.hi) if ended or partition.last)
            yield from _batches(partition.path, exact_records(found) if self.framing == "exact" else found)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.split, framing = _options(options)
        if framing != "split":
            raise ValueError("a stream is framed by 'split'")

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return dict(files(self.path))

    def partitions(self, start, end):
        from_byte = lambda path, size: start.get(path, 0) if start.get(path, 0) <= size else 0
        return [p for path, size in end.items() for p in _ranges(path, from_byte(path, size), size, self.split)]

    def read(self, partition):
        fs_, inner, _ = store(partition.path)
        with fs_.open_input_file(inner) as file:
            yield from _batches(partition.path, grown_records(file, partition))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SlowLogDataSource)
