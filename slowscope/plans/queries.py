"""One query for each operator, over logs rendered from events, and the SQL that gives the same from events alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slowscope import workdir
from slowscope.functions import lines
from slowscope.operators import entries
from slowscope.plans import analytics, rendering
from slowscope.sources import slowlog
from slowscope.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]

#: Bytes of a log that the driver copies at once.
_COPIED = 1 << 20


def _ms() -> Column:
    return F.unix_millis("log_time").alias("log_time_ms")


def _entries(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return entries.parse(rendering.records(spark, sf_dir), **options)


def _logs(spark: SparkSession, sf_dir: str) -> str:
    """Log files of the rendered entries."""
    path = workdir.new_path(spark, "logs")
    rendering.records(spark, sf_dir).select("record").write.text(path)
    return path


def p1_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.concat(F.lit("/usr/sbin/mysqld, Version: 5.7."), F.col("event_id").cast("string"), F.lit("-log (MySQL). started with:\nTcp port: "), (F.col("event_id") % 65536).cast("string"), F.lit("  Unix socket: /tmp/mysql.sock\nTime                 Id Command    Argument\n"))
    records = rendering.records(spark, sf_dir).withColumn("record", F.when(F.col("event_id") % 10 == 0, F.concat(start, "record")).otherwise(F.col("record")))
    return entries.headers(records).select("event_id", "path", "version", "tcp_port", "socket")


def p2_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("event_id", _ms(), "log_time_offset_minutes")


def p3_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("event_id", "user_name", "sys_user_name", "host_name", "ip_address", "thread_id")


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("event_id", "query_time", "lock_time", "rows_sent", "rows_examined")


def p10_use_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("event_id", "use_database")


def p11_set_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("event_id", "set_timestamp")


def p12_admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).where("statement_kind = 'admin'").select("event_id", "sql")


def p13_comment_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("event_id", F.explode("comment_map").alias("key", "value"))


def f2_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = rendering.records(spark, sf_dir).withColumn("record", F.when(F.col("event_id") % 10 == 0, F.substring("record", 1, 60)).otherwise(F.col("record")))
    return entries.parse(records).select("event_id", F.col("_corrupt_record").isNotNull().alias("corrupt"), F.coalesce("thread_id", F.lit(-1)).alias("thread_id"))


def f5_terminator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every record that holds no administrator command."""
    found = entries.once(rendering.records(spark, sf_dir), body=lines.field(lines.fields(F.col("record")), "body")).where(lines.admin_command(F.col("body")).isNull())
    body = F.concat("body", F.lit("\nleft over"))
    return found.select("event_id", F.trim(lines.statement(lines.without_comment(body))).alias("statement"))


def _varied(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return entries.parse(rendering.varied(spark, sf_dir), **options)


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered records, five of ten broken, each in its way."""
    way, record = F.pmod(F.col("event_id"), F.lit(10)), F.col("whole")
    bad = F.when(way == 0, F.regexp_replace(record, "^# Time: ....", "# Time: then")).when(way == 1, F.regexp_replace(record, r"\[app\]", "app")).when(way == 2, F.replace(record, F.lit("Lock_time"), F.lit("Lock")))
    bad = bad.when(way == 3, F.substring_index(record, "SET timestamp", 1)).when(way == 4, F.concat(F.substring_index(record, "SET timestamp", 1), F.lit("SET timestamp=1;\nSELECT 'open"))).otherwise(record)
    return entries.once(rendering.records(spark, sf_dir), whole=F.col("record")).select("event_id", bad.alias("record"))


def p2_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _varied(spark, sf_dir).select("event_id", F.unix_seconds("log_time").alias("log_time_s"), F.coalesce("log_time_offset_minutes", F.lit(-9999)).alias("offset_minutes"))


def p3_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _varied(spark, sf_dir).select("event_id", "user_name", "sys_user_name", F.coalesce("host_name", F.lit("none")).alias("host_name"), F.coalesce("ip_address", F.lit("none")).alias("ip_address"), "thread_id")


def p9_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _varied(spark, sf_dir).select("event_id", "query_time", F.coalesce("extra", F.lit("none")).alias("extra"), "set_timestamp", F.coalesce("use_database", F.lit("none")).alias("use_database"))


def p12_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Administrator commands of two words, as a strict reader takes them."""
    records = rendering.records(spark, sf_dir).withColumn("record", F.replace("record", F.lit("command: Quit;"), F.lit("command: Init DB;")))
    return entries.parse(records, compat=True).where("sql_type is null").select("event_id", "statement_kind", "sql")


def f2_dropmalformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.parse(_broken(spark, sf_dir), mode="DROPMALFORMED").select("event_id", "thread_id")


def f2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.parse(_broken(spark, sf_dir)).where("_corrupt_record is not null").select("event_id", F.col("_corrupt_reason").alias("reason"))


def f2_failfast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entries of whole logs, and whether a broken record ends the read."""
    read = lambda records: entries.parse(records, mode="FAILFAST").count()
    n, ended = read(rendering.records(spark, sf_dir)), False
    try:
        read(_broken(spark, sf_dir))
    except Exception as e:  # noqa: BLE001  Spark wraps the error by where it was raised
        ended = "malformed log record" in str(e)
    return spark.createDataFrame([(n, ended)], "n bigint, ended boolean")


def a2_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _entries(spark, sf_dir, masking="placeholder").where("statement_kind = 'sql'")
    return own.select("event_id", "sql", F.array_join("masked_values", "|").alias("masked_values"))


def a3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).where("statement_kind = 'sql'").select("event_id", "sql")


def a4_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("event_id", "statement_kind")


def a5_sql_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("event_id", "sql_type")


def a5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _varied(spark, sf_dir).select("event_id", "statement_kind", "sql_type")


def a6_bare_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without backticks, of the queries among the statements."""
    own = _varied(spark, sf_dir, strip_identifier_quotes=True).where("sql_type in ('INSERT', 'UPDATE', 'DELETE')")
    return own.select("event_id", F.explode("objects").alias("o")).select("event_id", "o.object_name")


def a6_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("event_id", F.posexplode("objects").alias("place", "o")).select("event_id", "place", "o.schema_name", "o.object_name")


def a7_full_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("event_id", F.explode("objects").alias("o")).select("event_id", F.concat_ws(".", "o.schema_name", "o.object_name").alias("full_object_name"))


def a8_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).where("context is not null").select("event_id", "context.request_id", "context.caller", "context.function", "context.line")


def g1_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.type_counts(_entries(spark, sf_dir))


def g2_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.entry_count(_entries(spark, sf_dir))


def g3_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    watched, watch = analytics.observed(_entries(spark, sf_dir))
    watched.write.format("noop").mode("overwrite").save()
    got = watch.get
    return spark.createDataFrame([(got["processed"], got["corrupt"])], "processed bigint, corrupt bigint")


def s1_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = slowlog.read_slow_log(spark, _logs(spark, sf_dir))
    return own.select("user_name", "thread_id", _ms(), "rows_sent", "rows_examined", "statement_kind", "sql_type")


def s1_exact_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = slowlog.read_slow_log(spark, _logs(spark, sf_dir), framing="exact")
    return own.select("user_name", "thread_id", _ms(), "rows_sent", "rows_examined", "statement_kind", "sql_type")


def s2_memory_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of eight entries each, held in a column."""
    own = rendering.records(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 8).alias("log_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "record"))), lambda x: x["record"]), "\n").alias("log"))
    return entries.parse(entries.split_records(own)).select("log_id", "record_id", "thread_id", "statement_kind")


def s3_stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stream.stream_files(spark, _logs(spark, sf_dir)).select("user_name", "thread_id", _ms(), "rows_sent", "rows_examined", "statement_kind", "sql_type")
    out, state = workdir.new_path(spark, "stream-out"), workdir.new_path(spark, "stream-state")
    own.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def _grow(source: str, target: str, share: float) -> None:
    """Leaves the first part of each log in the target folder, as a server would at some time."""
    for path, size in slowlog.files(source):
        store, inner, _ = slowlog.store(path)
        folder = slowlog.store(target)[1]
        store.create_dir(folder)
        with store.open_input_stream(inner) as a, store.open_output_stream(f"{folder}/{inner.rsplit('/', 1)[-1]}") as b:
            left = int(size * share)
            while left > 0 and (block := a.read(min(_COPIED, left))):
                b.write(block)
                left -= len(block)


def s3_tail_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that grow: the first half of their bytes, then the rest, in two batches."""
    own, grows = _logs(spark, sf_dir), workdir.new_path(spark, "grows")
    out, state = workdir.new_path(spark, "stream-out"), workdir.new_path(spark, "stream-state")
    for share in (0.5, 1.0):
        _grow(own, grows, share)
        found = stream.stream_tail(spark, grows).select("user_name", "thread_id", _ms(), "rows_sent", "rows_examined", "statement_kind", "sql_type")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def x1_top_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the limit is the feature."""
    own = analytics.top_fingerprints(_entries(spark, sf_dir, masking="placeholder"), 10)
    return own.select("sql", "calls", F.round("total_time", 3).alias("total_time"), "max_time")


def x2_table_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.table_load(_entries(spark, sf_dir))


def x3_windowed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.windowed_load(_entries(spark, sf_dir)).select(F.unix_seconds("start").alias("start_s"), "calls", "max_time")


def queries() -> dict[str, Query]:
    own = [
        p1_headers, p2_time, p2_offsets, p3_session, p3_hosts, p9_stats, p9_extra, p10_use_db, p11_set_timestamp, p12_admin, p12_compat, p13_comment_map, f2_corrupt, f2_dropmalformed, f2_reasons, f2_failfast, f5_terminator,
        a2_mask, a3_canonical, a4_kind, a5_sql_type, a5_labels, a6_bare_names,
        a6_objects, a7_full_name, a8_context, g1_type_counts, g2_count, g3_observed, s1_file_roundtrip, s1_exact_framing, s2_memory_log, s3_stream_roundtrip, s3_tail_roundtrip, x1_top_fingerprints, x2_table_load, x3_windowed_load,
    ]
    return {f.__name__: f for f in own}


_KIND = "CASE event_id % 8 WHEN 4 THEN 'admin' WHEN 5 THEN 'invalid' ELSE 'sql' END"
_TYPE = "CASE event_id % 8 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' WHEN 3 THEN 'DELETE' WHEN 6 THEN 'SELECT' WHEN 7 THEN 'DROP TABLE' END"
_TIME = "CAST(printf('%.6f', value / 1000) AS DOUBLE)"
_ROWS = f"SELECT event_type AS user_name, user_id AS thread_id, epoch_us(ts) // 1000 AS log_time_ms, event_id % 100 AS rows_sent, event_id % 1000 AS rows_examined, {_KIND} AS statement_kind, {_TYPE} AS sql_type FROM events"
_CANONICAL = """CASE event_id % 8
  WHEN 0 THEN 'SELECT * FROM shop.' || event_type || ' WHERE user_id = ' || user_id || ' AND k = ''v' || event_id || ''''
  WHEN 1 THEN 'INSERT INTO ' || event_type || ' VALUES (' || user_id || ', ''a;b'')'
  WHEN 2 THEN 'UPDATE ' || event_type || ' SET v = ' || event_id || ' WHERE id = 1'
  WHEN 3 THEN 'DELETE FROM ' || event_type || ' WHERE id = ' || event_id
  WHEN 5 THEN '/*!40101 SET NAMES utf8 */'
  WHEN 6 THEN 'SELECT a FROM ' || event_type || ' LEFT JOIN other.film ON 1 = 1'
  WHEN 7 THEN 'DROP TABLE IF EXISTS t' || (user_id % 7) END"""
_MASKED = """CASE event_id % 8
  WHEN 0 THEN 'SELECT * FROM shop.' || event_type || ' WHERE user_id = ? AND k = ?'
  WHEN 1 THEN 'INSERT INTO ' || event_type || ' VALUES (?, ?)'
  WHEN 2 THEN 'UPDATE ' || event_type || ' SET v = ? WHERE id = ?'
  WHEN 3 THEN 'DELETE FROM ' || event_type || ' WHERE id = ?'
  WHEN 6 THEN 'SELECT a FROM ' || event_type || ' LEFT JOIN other.film ON ? = ?'
  WHEN 7 THEN 'DROP TABLE IF EXISTS t' || (user_id % 7) END"""
_HIDDEN = """CASE event_id % 8
  WHEN 0 THEN user_id || '|''v' || event_id || ''''
  WHEN 1 THEN user_id || '|''a;b'''
  WHEN 2 THEN event_id || '|1'
  WHEN 3 THEN CAST(event_id AS VARCHAR)
  WHEN 6 THEN '1|1'
  WHEN 7 THEN '' END"""
_OBJECTS = """(
  SELECT event_id, 0 AS place, CASE WHEN event_id % 8 = 0 THEN 'shop' END AS schema_name, event_type AS object_name, event_id % 1000 AS rows_examined FROM events WHERE event_id % 8 IN (0, 1, 2, 3, 6)
  UNION ALL SELECT event_id, 1, 'other', 'film', event_id % 1000 FROM events WHERE event_id % 8 = 6)"""


def _turn(values: list[str | None]) -> str:
    """SQL of the value of each event: by its id, in turn."""
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"([{', '.join(quoted)}])[event_id % {len(values)} + 1]"


def _varied_sql() -> dict[str, str]:
    session = lambda i, empty: f"coalesce(nullif({_turn([s[i] for s in rendering.SESSIONS])}, ''), '{empty}')"
    changed = _turn([label if label in ("INSERT", "UPDATE", "DELETE") else None for _, label in rendering.STATEMENTS])
    return {
        "p2_offsets": f"SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS log_time_s, coalesce(CAST({_turn([None if m is None else str(m) for _, m in rendering.OFFSETS])} AS INTEGER), -9999) AS offset_minutes FROM events",
        "p3_hosts": f"SELECT event_id, {session(0, '')} AS user_name, {session(1, '')} AS sys_user_name, {session(2, 'none')} AS host_name, {session(3, 'none')} AS ip_address, user_id AS thread_id FROM events",
        "p9_extra": f"SELECT event_id, {_TIME} AS query_time, CASE WHEN event_id % 3 = 0 THEN 'Thread_id: ' || user_id || '  Errno: 0' ELSE 'none' END AS extra, CAST(floor(epoch(ts)) AS BIGINT) AS set_timestamp, {_turn(['shop', 'my shop', 'none', 's2'])} AS use_database FROM events",
        "p12_compat": "SELECT event_id, 'invalid' AS statement_kind, CASE event_id % 8 WHEN 4 THEN ' DB;' ELSE '/*!40101 SET NAMES utf8 */;' END AS sql FROM events WHERE event_id % 8 IN (4, 5)",
        "f2_dropmalformed": "SELECT event_id, user_id AS thread_id FROM events WHERE event_id % 10 > 4",
        "f2_reasons": "SELECT event_id, (['time', 'user', 'stats', 'incomplete log', 'incomplete sql'])[event_id % 10 + 1] AS reason FROM events WHERE event_id % 10 < 5",
        "f2_failfast": "SELECT count(*) AS n, true AS ended FROM events",
        "a5_labels": f"SELECT event_id, 'sql' AS statement_kind, {_turn([label for _, label in rendering.STATEMENTS])} AS sql_type FROM events",
        "a6_bare_names": f"SELECT event_id, event_type AS object_name FROM events WHERE {changed} IS NOT NULL",
    }


def oracle_sql() -> dict[str, str]:
    return _varied_sql() | {
        "p1_headers": "SELECT event_id, '/usr/sbin/mysqld' AS path, '5.7.' || event_id || '-log (MySQL).' AS version, event_id % 65536 AS tcp_port, '/tmp/mysql.sock' AS socket FROM events WHERE event_id % 10 = 0",
        "p2_time": "SELECT event_id, epoch_us(ts) // 1000 AS log_time_ms, CAST(0 AS INTEGER) AS log_time_offset_minutes FROM events",
        "p3_session": "SELECT event_id, event_type AS user_name, 'app' AS sys_user_name, CASE WHEN event_id % 3 <> 0 THEN 'localhost' END AS host_name, CASE WHEN event_id % 2 <> 0 THEN '10.0.0.' || (user_id % 256) END AS ip_address, user_id AS thread_id FROM events",
        "p9_stats": f"SELECT event_id, {_TIME} AS query_time, CAST(0 AS DOUBLE) AS lock_time, event_id % 100 AS rows_sent, event_id % 1000 AS rows_examined FROM events",
        "p10_use_db": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'shop' END AS use_database FROM events",
        "p11_set_timestamp": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS set_timestamp FROM events",
        "p12_admin": "SELECT event_id, 'Quit' AS sql FROM events WHERE event_id % 8 = 4",
        "p13_comment_map": "SELECT event_id, unnest(['request_id', 'file', 'method', 'line']) AS key, unnest(['r' || event_id, 'f' || (user_id % 7) || '.rs', 'm()', CAST(event_id % 500 AS VARCHAR)]) AS value FROM events WHERE event_id % 8 = 6",
        "f2_corrupt": "SELECT event_id, event_id % 10 = 0 AS corrupt, CASE WHEN event_id % 10 <> 0 THEN user_id ELSE -1 END AS thread_id FROM events",
        "f5_terminator": f"SELECT event_id, {_CANONICAL} || ';' AS statement FROM events WHERE event_id % 8 <> 4",
        "a2_mask": f"SELECT event_id, {_MASKED} AS sql, {_HIDDEN} AS masked_values FROM events WHERE event_id % 8 NOT IN (4, 5)",
        "a3_canonical": f"SELECT event_id, {_CANONICAL} AS sql FROM events WHERE event_id % 8 NOT IN (4, 5)",
        "a4_kind": f"SELECT event_id, {_KIND} AS statement_kind FROM events",
        "a5_sql_type": f"SELECT event_id, {_TYPE} AS sql_type FROM events",
        "a6_objects": f"SELECT event_id, CAST(place AS INTEGER) AS place, schema_name, object_name FROM {_OBJECTS}",
        "a7_full_name": f"SELECT event_id, concat_ws('.', schema_name, object_name) AS full_object_name FROM {_OBJECTS}",
        "a8_context": "SELECT event_id, 'r' || event_id AS request_id, 'f' || (user_id % 7) || '.rs' AS caller, 'm()' AS function, event_id % 500 AS line FROM events WHERE event_id % 8 = 6",
        "g1_type_counts": f"SELECT coalesce({_TYPE}, 'NULL') AS sql_type, count(*) AS n FROM events GROUP BY 1",
        "g2_count": "SELECT count(*) AS n FROM events",
        "g3_observed": "SELECT count(*) AS processed, CAST(0 AS BIGINT) AS corrupt FROM events",
        "s1_file_roundtrip": _ROWS,
        "s1_exact_framing": _ROWS,
        "s2_memory_log": f"SELECT event_id // 8 AS log_id, CAST(row_number() OVER (PARTITION BY event_id // 8 ORDER BY event_id) - 1 AS INTEGER) AS record_id, user_id AS thread_id, {_KIND} AS statement_kind FROM events",
        "s3_stream_roundtrip": _ROWS,
        "s3_tail_roundtrip": _ROWS,
        "x1_top_fingerprints": f"SELECT sql, count(*) AS calls, round(sum(t), 3) AS total_time, max(t) AS max_time FROM (SELECT {_MASKED} AS sql, {_TIME} AS t FROM events WHERE event_id % 8 NOT IN (4, 5)) GROUP BY sql ORDER BY sum(t) DESC, sql LIMIT 10",
        "x2_table_load": f"SELECT concat_ws('.', schema_name, object_name) AS full_object_name, count(*) AS calls, CAST(sum(rows_examined) AS BIGINT) AS rows_examined FROM {_OBJECTS} GROUP BY 1",
        "x3_windowed_load": f"SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start_s, count(*) AS calls, max({_TIME}) AS max_time FROM events GROUP BY 1",
    }
