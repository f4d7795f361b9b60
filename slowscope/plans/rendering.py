"""Slow-log text made from the events table, one entry for each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slowscope.operators.entries import once


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, dealt out anew: a Parquet file is read in as many tasks as it has row groups, which may be one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    return events.repartition(2 * spark.sparkContext.defaultParallelism)


def _body() -> Column:
    e, u, i = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id").cast("string")
    bodies = [
        F.concat(F.lit("SELECT * FROM shop."), e, F.lit(" WHERE user_id = "), u, F.lit(" AND k = 'v"), i, F.lit("';")),
        F.concat(F.lit("INSERT INTO "), e, F.lit(" VALUES ("), u, F.lit(", 'a;b');")),
        F.concat(F.lit("UPDATE "), e, F.lit(" SET v = "), i, F.lit(" WHERE id = 1;")),
        F.concat(F.lit("DELETE FROM "), e, F.lit(" WHERE id = "), i, F.lit(";")),
        F.lit("# administrator command: Quit;"),
        F.lit("/*!40101 SET NAMES utf8 */;"),
        F.concat(F.lit("-- request_id: r"), i, F.lit(", file: f"), (F.col("user_id") % 7).cast("string"), F.lit(".rs, method: m(), line: "), (F.col("event_id") % 500).cast("string"), F.lit("\nSELECT a FROM "), e, F.lit(" LEFT JOIN other.film ON 1 = 1;")),
        F.concat(F.lit("DROP TABLE IF EXISTS t"), (F.col("user_id") % 7).cast("string"), F.lit(";")),
    ]
    out = F.when(F.col("event_id") % 8 == 0, bodies[0])
    for k, body in enumerate(bodies[1:], 1):
        out = out.when(F.col("event_id") % 8 == k, body)
    return out


#: Statements and the labels that they must get; {e} stands for the event's type.
STATEMENTS = [
    ("select * from {e} where a = 'x;y'", "SELECT"), ("WITH c AS (SELECT 1) SELECT * FROM {e}", "SELECT"), ("(select 1) union (select 2)", "SELECT"), ("INSERT IGNORE INTO {e} VALUES (1)", "INSERT"),
    ("Replace Into {e} Set a = 1", "INSERT"), ("UPDATE {e} SET a = 1", "UPDATE"), ("DELETE FROM {e} LIMIT 1", "DELETE"), ("CREATE TABLE IF NOT EXISTS {e} (a INT)", "CREATE TABLE"), ("CREATE TEMPORARY TABLE {e} (a INT)", "CREATE TABLE"),
    ("create unique index i on {e} (a)", "CREATE INDEX"), ("CREATE OR REPLACE VIEW v AS SELECT 1", "CREATE VIEW"), ("ALTER TABLE {e} ADD COLUMN b INT", "ALTER TABLE"), ("ALTER INDEX i RENAME TO j", "ALTER INDEX"),
    ("DROP TABLE {e}", "DROP TABLE"), ("DROP VIEW v", "DROP TABLE"), ("drop database d", "DROP TABLE"), ("DROP FUNCTION f", "DROP FUNCTION"), ("SET @a = 1", "SET"), ("set names utf8mb4", "SET"), ("SHOW ENGINES", "SHOW VARIABLE"),
    ("SHOW GLOBAL VARIABLES LIKE 'x%'", "SHOW VARIABLES"), ("SHOW CREATE TABLE {e}", "SHOW CREATE TABLE"), ("SHOW FULL COLUMNS FROM {e}", "SHOW COLUMNS"), ("SHOW TABLES", "SHOW TABLES"), ("SHOW COLLATION", "SHOW COLLATION"),
    ("USE shop", "USE"), ("START TRANSACTION", "BEGIN TRANSACTION"), ("BEGIN", "BEGIN TRANSACTION"), ("commit", "COMMIT TRANSACTION"), ("ROLLBACK", "ROLLBACK TRANSACTION"), ("CREATE SCHEMA s", "CREATE SCHEMA"),
    ("CREATE DATABASE IF NOT EXISTS d", "CREATE DATABASE"), ("GRANT SELECT ON {e} TO u", "GRANT"), ("REVOKE SELECT ON {e} FROM u", "REVOKE"), ("KILL 12", "KILL"), ("DESCRIBE {e}", "EXPLAIN TABLE"), ("EXPLAIN SELECT 1 FROM {e}", "EXPLAIN"),
    ("SAVEPOINT s1", "SAVEPOINT"), ("LOCK TABLES {e} READ", "LOCK TABLES"), ("UNLOCK TABLES", "LOCK TABLES"), ("FLUSH LOGS", "FLUSH"), ("TRUNCATE TABLE {e}", "NULL"),
]

#: User, system user, host and address of a session line as written (user[system] @ host [address]).
SESSIONS = [
    ("root", "root", "localhost", ""), ("a-b.c", "", "db-1_x.host2", "10.1.2.3"), ("app", "app", "", "::1"), ("", "", "", "192.168.56.1"), ("svc_1", "svc", "10.0.0.7", "10.0.0.7"), ("u", "s", "local.tests.rs", "fe80::1"),
]

#: Offsets as written, and their minutes east of UTC.
OFFSETS = [("Z", 0), ("+0200", 120), ("-03:30", -210), ("", None), ("+05:45", 345)]


def chosen(values: list[str | None]) -> Column:
    """The value of each event: by its id, in turn."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(F.col("event_id"), F.lit(len(values))).cast("int"))


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, record: statements, sessions, offsets, databases and further statistics of many forms."""
    events = _events(spark, sf_dir)
    ts = F.col("ts").cast("timestamp")
    minutes = F.coalesce(chosen([str(m or 0) for _, m in OFFSETS]).cast("int"), F.lit(0))
    local = F.timestamp_seconds(F.unix_micros(ts) / 1_000_000 + minutes * 60)
    part = lambda i: chosen([s[i] for s in SESSIONS])
    text = F.concat(
        F.lit("# Time: "), F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), chosen([o for o, _ in OFFSETS]),
        F.lit("\n# User@Host: "), part(0), F.lit("["), part(1), F.lit("] @ "), part(2), F.lit(" ["), part(3), F.lit("]  Id: "), F.col("user_id").cast("string"),
        F.lit("\n# Query_time: "), F.format_string("%.6f", F.col("value") / 1000), F.lit("  Lock_time: 0.000000 Rows_sent: 1  Rows_examined: 2"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("  Thread_id: "), F.col("user_id").cast("string"), F.lit("  Errno: 0"))).otherwise(""),
        F.lit("\n"), chosen(["use shop;\n", "USE `my shop`;\n", "", "Use s2 ;\n"]),
        F.lit("SET timestamp="), F.unix_seconds(ts).cast("string"), F.when(F.col("event_id") % 7 == 0, ".250").otherwise(""), F.lit(";\n"),
        F.replace(chosen([s for s, _ in STATEMENTS]), F.lit("{e}"), F.concat(F.lit("`"), F.col("event_type"), F.lit("`"))), F.lit(";"),
    )
    return once(events, record=text).select("event_id", "record")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, record."""
    events = _events(spark, sf_dir)
    ts = F.col("ts").cast("timestamp")
    user = F.col("user_id").cast("string")
    text = F.concat(
        F.lit("# Time: "), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        F.lit("\n# User@Host: "), F.col("event_type"), F.lit("[app] @ "), F.when(F.col("event_id") % 3 == 0, "").otherwise("localhost"),
        F.lit(" ["), F.when(F.col("event_id") % 2 == 0, "").otherwise(F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"))),
        F.lit("]  Id: "), F.lpad(user, F.greatest(F.lit(5), F.length(user)), F.lit(" ")),
        F.lit("\n# Query_time: "), F.format_string("%.6f", F.col("value") / 1000),
        F.lit("  Lock_time: 0.000000 Rows_sent: "), (F.col("event_id") % 100).cast("string"), F.lit("  Rows_examined: "), (F.col("event_id") % 1000).cast("string"),
        F.lit("\n"), F.when(F.col("event_id") % 5 == 0, "use shop;\n").otherwise(""),
        F.lit("SET timestamp="), F.unix_seconds(ts).cast("string"), F.lit(";\n"), _body(),
    )
    return once(events, record=text).select("event_id", "record")
