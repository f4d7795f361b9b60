"""From log records to the entries table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slowscope.functions import comments, lines, sql_analysis
from slowscope.schema import ADMIN, INVALID, SQL

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


def split_records(df: DataFrame, log: str = "log") -> DataFrame:
    """df with each log text (a whole log in a column) split into rows: record_id, record."""
    return df.select(*[c for c in df.columns if c != log], F.posexplode(F.split(F.col(log), "\n# Time: ")).alias("record_id", "record"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each computed once a row: the optimizer copies no expression through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def parse(
    records: DataFrame,
    *,
    record: str = "record",
    masking: str = "none",
    mode: str = "PERMISSIVE",
    compat: bool = False,
    map_context: Callable[[Column], Column] | None = comments.context,
    strip_identifier_quotes: bool = False,
) -> DataFrame:
    """records with the columns of an entry for each record; server header records are dropped.

    masking: none, or placeholder (literals become ?).  mode: what becomes of a record that is no
    entry: a row whose _corrupt_record holds it, no row, or an error.  compat: administrator
    commands of several words are invalid statements.  map_context: from the comment's map
    to any column, or None.  strip_identifier_quotes: names of objects without backticks.

    Fields and the statement's end are found in the JVM, once a row; the SQL analysis in
    Python is pruned from plans that don't read it.

    Differences from a strict reader, all on purpose: malformed and truncated entries
    become corrupt records instead of ending the read; text after a statement stays in _trailing;
    a comment that holds no pairs is left out of the statement; quotes of one kind don't
    nest in the other; masked output never falls back to the raw text."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    own = [c for c in records.columns if c != record]
    text = F.col(record)
    f = lambda name: lines.field(F.col("_f"), name)
    start = lines.has_header(text) & ~text.contains("# User@Host:")
    df = once(records.where(text.rlike(r"\S") & ~start), _f=lines.fields(text))
    body = f("body")
    admin = lines.admin_command(body)
    df = once(df, _time=lines.instant(f("time")), _admin=admin, _own=lines.without_comment(body), _comment=lines.leading_comment(body))
    df = once(df, _raw=F.when(F.col("_admin").isNull(), F.regexp_extract("_own", lines.STATEMENT, 1)), _pairs=comments.comment_map(F.col("_comment")))
    df = df.withColumn("_raw", F.nullif("_raw", F.lit("")))
    good = F.col("_time").isNotNull() & (F.col("_admin").isNotNull() | F.col("_raw").isNotNull())
    df = df.withColumn("_good", F.coalesce(good, F.lit(False)))
    if mode == "DROPMALFORMED":
        df = df.where("_good")
    elif mode == "FAILFAST":  # a filter, so that no pruned column takes the check with it
        df = df.where(F.when(F.col("_good"), True).otherwise(F.raise_error(F.concat(F.lit("malformed log record: "), F.substring(text, 1, 200))).cast("boolean")))
    ok = F.col("_good")
    df = df.withColumn("_a", F.when(ok & F.col("_raw").isNotNull(), sql_analysis.analysis(F.col("_raw"), masking)))
    bare_admin = F.col("_admin").isNotNull() & (F.lit(not compat) | F.col("_admin").rlike("^[A-Za-z0-9]+$"))
    kind = F.when(bare_admin, ADMIN).when(F.col("_a.valid"), SQL).otherwise(INVALID)
    pairs = F.when(ok, F.col("_pairs"))
    objects = F.col("_a.objects")
    if strip_identifier_quotes:
        bare = lambda c: F.regexp_replace(c, "^`(.*)`$", "$1")
        objects = F.transform(objects, lambda o: F.struct(bare(o["schema_name"]).alias("schema_name"), bare(o["object_name"]).alias("object_name")))
    when_ok = lambda c: F.when(ok, c)
    numbers = {c: f(c).try_cast("bigint") for c in ("set_timestamp", "thread_id", "rows_sent", "rows_examined")}
    times = {c: f(c).try_cast("double") for c in ("query_time", "lock_time")}
    texts = {c: f(c) for c in ("host_name", "ip_address", "extra")} | {c: F.coalesce(f(c), F.lit("")) for c in ("user_name", "sys_user_name")}
    rest = F.regexp_extract(F.col("_admin"), r"^\S*(.*)$", 1)  # what a strict reader leaves of a command of several words
    return df.select(
        *own,
        when_ok(F.date_trunc("MILLISECOND", "_time")).alias("log_time"),
        when_ok(lines.offset_minutes(f("time"))).alias("log_time_offset_minutes"),
        *[when_ok(c).alias(k) for k, c in (numbers | times | texts).items()],
        when_ok(F.regexp_replace(f("use_database"), "`", "")).alias("use_database"),
        when_ok(F.when(bare_admin, F.col("_admin")).when(F.col("_admin").isNotNull(), F.concat(rest, F.lit(";"))).otherwise(F.col("_a.sql"))).alias("sql"),
        when_ok(kind).alias("statement_kind"),
        F.col("_a.sql_type").alias("sql_type"),
        objects.alias("objects"),
        F.when(F.col("_a.valid"), map_context(pairs) if map_context else F.lit(None).cast("struct<request_id:string,caller:string,function:string,line:bigint>")).alias("context"),
        pairs.alias("comment_map"),
        F.col("_a.masked_values").alias("masked_values"),
        when_ok(lines.after_statement(body, F.col("_raw"), F.col("_own"))).alias("_trailing"),
        F.when(~ok, text).alias("_corrupt_record"),
        F.when(~ok, lines.corrupt_reason(text, F.col("_f"))).alias("_corrupt_reason"),
    )


def headers(records: DataFrame, *, record: str = "record") -> DataFrame:
    """One row for each server start found in the records: path, version, tcp_port, socket."""
    own = [c for c in records.columns if c != record]
    return records.select(*own, lines.header(F.col(record)).alias("h")).where("h is not null").select(*own, "h.*")
