import datetime as dt
import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import functions as F

from slowscope.functions import comments
from slowscope.operators import entries
from slowscope.plans import analytics, queries, rendering
from slowscope.sources import slowlog
from slowscope.streaming import stream

#: Inputs that stand for the format.
SELECT = "SELECT film.film_id AS FID, category.name AS category FROM category LEFT JOIN film ON 1 = 1 GROUP BY film.film_id, category.name"
HEADER = "/opt/my-5.7/bin/mysqld, Version: 5.7.20-log (MySQL Community Server (GPL)). started with:\nTcp port: 12345  Unix socket: /tmp/12345/mysql.sock\nTime                 Id Command    Argument\n"


def entry(body, time="2018-02-05T02:46:47.273786Z", user="msandbox[msandbox] @ localhost []  Id:    10", use="", stats="Query_time: 0.000352  Lock_time: 0.000000 Rows_sent: 0  Rows_examined: 0", stamp="SET timestamp=1517798807;"):
    return f"# Time: {time}\n# User@Host: {user}\n# {stats}\n{use}{stamp}\n{body}\n"


def parse(spark, *records, **options):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "entry_id bigint, record string")
    return entries.parse(df, **options).orderBy("entry_id").collect()


def test_full_entry(spark):
    comment = "-- request_id: apLo5w, file: src/original/mod.rs, method: notifications(), line: 38"
    (row,) = parse(spark, entry(f"{comment}\n{SELECT};\n,", use="use mysql;\n"))
    assert row.log_time == dt.datetime(2018, 2, 5, 2, 46, 47, 273000)
    assert (row.log_time_offset_minutes, row.set_timestamp, row.use_database) == (0, 1517798807, "mysql")
    assert (row.user_name, row.sys_user_name, row.host_name, row.ip_address, row.thread_id) == ("msandbox", "msandbox", "localhost", None, 10)
    assert (row.query_time, row.lock_time, row.rows_sent, row.rows_examined) == (0.000352, 0.0, 0, 0)
    assert (row.sql, row.statement_kind, row.sql_type) == (SELECT, "sql", "SELECT")
    assert tuple(row.context) == ("apLo5w", "src/original/mod.rs", "notifications()", 38)
    assert row._trailing == "," and row._corrupt_record is None


def test_sessions_and_stats(spark):
    users = ["lobster[lobster] @ [192.168.56.1]  Id:   190", "a-b.c[] @ db-1_x.host2 [::1]  Id: 4294967295", "u[s] @ local.tests.rs [127.0.0.2]  Id: 1"]
    rows = parse(spark, *[entry("SELECT 1;", user=u, stats="Query_time: 1.000016  Lock_time: 2.000000 Rows_sent: 3  Rows_examined: 4  Bytes_sent: 7") for u in users])
    assert [(r.user_name, r.sys_user_name, r.host_name, r.ip_address, r.thread_id) for r in rows] == [("lobster", "lobster", None, "192.168.56.1", 190), ("a-b.c", "", "db-1_x.host2", "::1", 4294967295), ("u", "s", "local.tests.rs", "127.0.0.2", 1)]
    assert {(r.query_time, r.lock_time, r.rows_sent, r.rows_examined, r.extra) for r in rows} == {(1.000016, 2.0, 3, 4, "Bytes_sent: 7")}


def test_time_offset_and_stamp(spark):
    a, b = parse(spark, entry("SELECT 1;", time="2015-06-26T16:43:23+0200"), entry("SELECT 1;", time="2015-06-26T16:43:23", stamp="SET timestamp = 12.75 ;", use="USE `my db`;\n"))
    assert (a.log_time, a.log_time_offset_minutes) == (dt.datetime(2015, 6, 26, 14, 43, 23), 120)
    assert (b.log_time, b.log_time_offset_minutes, b.set_timestamp, b.use_database) == (dt.datetime(2015, 6, 26, 16, 43, 23), None, 12, "my db")


def test_admin_commands(spark):
    bodies = [entry("# administrator command: Quit;"), entry("# administrator command: Init DB;", use="use mysql;\n")]
    assert [(r.statement_kind, r.sql, r.sql_type) for r in parse(spark, *bodies)] == [("admin", "Quit", None), ("admin", "Init DB", None)]
    assert [(r.statement_kind, r.sql) for r in parse(spark, *bodies, compat=True)] == [("admin", "Quit"), ("invalid", " DB;")]


def test_comments(spark):
    texts = [
        " Id: 123; long: some kind of details here; caller: hello_world()", " Id: 123, long: some kind of details here, caller : hello_world()", " Id= 123, long = some kind of details here, caller= hello_world()",
        " Id: 1, caller: hello_world(): 52", " a: 1,", "", " no pairs", " a: 1, a: 2",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    maps = [r.m for r in df.select("i", comments.comment_map(F.col("c")).alias("m")).orderBy("i").collect()]
    same = {"Id": "123", "long": "some kind of details here", "caller": "hello_world()"}
    assert maps == [same, same, same, {"Id": "1", "caller": "hello_world(): 52"}, {"a": "1"}, None, None, None]


def test_comment_without_pairs_is_left_out(spark):
    (row,) = parse(spark, entry("-- just words\nSELECT 1;"))
    assert (row.sql, row.statement_kind, row.comment_map, row.context) == ("SELECT 1", "sql", None, None)


def test_terminator(spark):
    bodies = ["SELECT CONCAT(a, '; ', \"it's;\") FROM `x;y`;", "SELECT '\\'\\\"; ' FROM t;", "SELECT 'it''s;' FROM t; SELECT 2;", "/*!40101 SET NAMES utf8 */;", "SELECT /* it's; */ 1;"]
    rows = parse(spark, *map(entry, bodies))
    assert [r.statement_kind for r in rows] == ["sql", "sql", "sql", "invalid", "sql"]
    assert rows[2]._trailing == "SELECT 2;" and rows[3].sql == "/*!40101 SET NAMES utf8 */;"


def test_long_statement(spark):
    (row,) = parse(spark, entry("SELECT '" + "x;" * 500_000 + "';"))
    assert row.statement_kind == "sql" and len(row.sql) == 1_000_009


def test_corrupt_records(spark):
    bad = [entry("SELECT 'never ends"), entry("SELECT 1;")[:40], entry("SELECT 1;", time="yesterday")]
    rows = parse(spark, entry("SELECT 1;"), *bad, "  \n")
    assert [r._corrupt_record is not None for r in rows] == [False, True, True, True]
    assert all(r.statement_kind is None and r.thread_id is None for r in rows[1:])
    assert len(parse(spark, entry("SELECT 1;"), *bad, mode="DROPMALFORMED")) == 1
    with pytest.raises(Exception, match="malformed log record"):
        parse(spark, *bad, mode="FAILFAST")
    with pytest.raises(ValueError, match="mode"):
        parse(spark, mode="LAX")


def test_masked_entries(spark):
    rows = parse(spark, entry("SELECT 1 FROM t WHERE a = 'secret';"), entry("what 'secret';"), masking="placeholder")
    assert rows[0].sql == "SELECT ? FROM t WHERE a = ?" and rows[0].masked_values == ["1", "'secret'"]
    assert rows[1].sql == "what ?;"


LOG = HEADER + entry("SELECT 1;") + entry("/*!40101 SET NAMES utf8 */;") + HEADER + entry(f"-- ID: 456, caller: hello_world()\n{SELECT};") + entry("# administrator command: Ping;")


def test_files_and_splits(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    path = f"file://{tmp_path}/a.log"
    kinds = lambda df: sorted((r.statement_kind, r.sql_type or "", r.sql) for r in df.collect())
    whole = kinds(slowlog.read_slow_log(spark, path))
    assert [k for k, _, _ in whole] == ["admin", "invalid", "sql", "sql"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        assert kinds(slowlog.read_slow_log(spark, path)) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert kinds(slowlog.read_slow_log(spark, path, framing="exact")) == whole
    heads = slowlog.read_headers(spark, path).collect()
    assert [(h.version, h.tcp_port, h.socket) for h in heads] == [("5.7.20-log (MySQL Community Server (GPL)).", 12345, "/tmp/12345/mysql.sock")] * 2
    counts = {r.sql_type: r.n for r in analytics.type_counts(slowlog.read_slow_log(spark, path)).collect()}
    assert counts == {"NULL": 2, "SELECT": 2}


def test_exact_framing_joins_strings(spark, tmp_path):
    (tmp_path / "b.log").write_text(entry("SELECT 'a\n# Time: not a record' FROM t;") + entry("SELECT 2;"))
    rows = slowlog.read_slow_log(spark, f"file://{tmp_path}/b.log", framing="exact").collect()
    assert [r.statement_kind for r in rows] == ["sql", "sql"]


def test_log_in_a_column(spark):
    df = spark.createDataFrame([(7, LOG)], "id int, log string")
    rows = entries.parse(entries.split_records(df)).collect()
    assert [r.statement_kind for r in sorted(rows, key=lambda r: r.record_id)] == ["sql", "invalid", "sql", "admin"] and {r.id for r in rows} == {7}


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    own = stream.stream_files(spark, f"file://{tmp_path}")
    own.writeStream.format("memory").queryName("files").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r.statement_kind for r in spark.table("files").collect()) == ["admin", "invalid", "sql", "sql"]


def test_stream_of_a_growing_file(spark, tmp_path):
    file = tmp_path / "a.log"
    cuts = [len(HEADER) + 150, len(LOG) // 2, LOG.index("SET timestamp", 900) + len("SET timestamp=1517798807;"), len(LOG)]
    query = None
    try:
        for cut in cuts:
            file.write_text(LOG[:cut])
            query = query or stream.stream_tail(spark, str(file)).writeStream.format("memory").queryName("tail").start()
            query.processAllAvailable()
        found = spark.table("tail").collect()
        assert sorted((r.statement_kind, r.sql) for r in found if r._corrupt_record is None) == sorted((r.statement_kind, r.sql) for r in slowlog.read_slow_log(spark, f"file://{file}").collect())
        assert [r for r in found if r._corrupt_record is not None] == []
    finally:
        query.stop()


GROWING = LOG + entry("SELECT 'a;\n# x', 'open; \\' still' FROM `t;`;") + entry("-- a: 1; b: 2\nSELECT 'é';") + entry("SELECT 1")[:-1] + "\n" + entry("SELECT 2;") + entry("SELECT 3")


@pytest.mark.parametrize("split", [7, 1 << 20])
@pytest.mark.parametrize("step", [1, 2, 3, 53, 211])
def test_tail_gives_each_record_once(tmp_path, step, split):
    """The log is read at every cut of its bytes; no record is lost, given twice, or given before its statement ends."""
    data = GROWING.encode()
    want = [p for p in GROWING.split(slowlog.SEPARATOR)]
    want = want[:-1]  # the last statement never ends
    file = tmp_path / "grows.log"
    file.write_bytes(data)
    found = []
    for lo in range(0, len(data), step):
        for part in slowlog._ranges(str(file), lo, min(lo + step, len(data)), split):
            with open(file, "rb") as f:
                found += list(slowlog.grown_records(f, part))
    # given before the next separator is there, a record lacks what follows its statement: a newline, the lines of a restarted server
    assert len(found) == len(want) and all(b.startswith(a) for a, b in zip(found, want, strict=True))
    entries_of = [r for r in found if "# User@Host" in r]
    assert [slowlog.is_complete(r) for r in entries_of] == [not r.rstrip().endswith("SELECT 1") for r in entries_of]


def test_byte_ranges_give_the_whole_file(spark, tmp_path):
    (tmp_path / "a.log").write_text(GROWING)
    slowlog.register(spark)
    for split in (1, 64, 1 << 20):
        for path in (str(tmp_path), f"file://{tmp_path}/a.log", f"{tmp_path}/*.log"):
            found = spark.read.format("slowlog").option("splitBytes", split).load(path) if split > 1 or path == str(tmp_path) else None
            if found is not None:
                assert sorted(r.record for r in found.collect()) == sorted(GROWING.split(slowlog.SEPARATOR))


def test_pieces_across_blocks(tmp_path, monkeypatch):
    file = tmp_path / "a.log"
    file.write_text(GROWING)
    for size in (1, 5, 9, 64):
        monkeypatch.setattr(slowlog, "_CHUNK", max(size, len(slowlog._SEP)))
        with open(file, "rb") as f:
            assert [p.decode() for p, _ in slowlog._pieces(f, 0, len(GROWING.encode()))] == GROWING.split(slowlog.SEPARATOR)
            at = GROWING.encode().index(slowlog._SEP) + len(slowlog._SEP)
            assert slowlog._record_start(f, at + 100) == at and slowlog._record_start(f, at - 1) == 0 and slowlog._record_start(f, at) == at


def test_exact_records_end_at_session_lines():
    whole = entry("SELECT 'a\n# Time: not a record' FROM t;") + entry("SELECT 'never ends") + entry("SELECT 2;")
    assert len(list(slowlog.exact_records(whole.split(slowlog.SEPARATOR)))) == 3
    assert len(list(slowlog.exact_records(["SET timestamp=1; select 'a"] + ["x"] * 50_000))) == 1  # each piece is looked at once


def test_fields_hold_any_character(spark):
    a, b = parse(spark, entry("SELECT '\x01';", user="u\x01x[s] @ h [::1]  Id: 7"), entry("SELECT '\x01\x01';"))
    assert (a.user_name, a.host_name, a.thread_id, a.sql) == ("u\x01x", "h", 7, "SELECT '\x01'")
    assert b.sql == "SELECT '\x01\x01'"


def test_times_without_offset_are_utc_in_any_session(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(entry("SELECT 1;", time="2015-06-26T16:43:23"),)], "record string")
        assert entries.parse(df).select(F.unix_seconds("log_time").alias("s")).first().s == 1435337003
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_reasons_of_corrupt_records(spark):
    good = entry("SELECT 1;")
    bad = [good.replace("2018", "then"), good.replace("[msandbox]", ""), good.replace("Lock_time", "Lock"), good[: good.index("SET")], good[: good.index("# Query")], good.replace("SELECT 1;", "SELECT 'a")]
    assert [r._corrupt_reason for r in parse(spark, good, *bad)] == [None, "time", "user", "stats", "incomplete log", "incomplete log", "incomplete sql"]


def test_names_without_quotes(spark):
    (row,) = parse(spark, entry("SELECT 1 FROM `a b`.`c`, d;"), strip_identifier_quotes=True)
    assert [tuple(o) for o in row.objects] == [(None, "d"), ("a b", "c")]


@pytest.mark.parametrize("name", ["g2_count", "p2_time", "p3_session", "p9_stats", "p10_use_db", "f2_corrupt"])
def test_unused_analysis_is_pruned(spark, name):
    plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "ArrowEvalPython" in queries.a4_kind(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def small_log():
    """A session dump's log: server lines, then 22 entries of three threads."""
    settings = [f"/*!40{n} SET @OLD_V{n}=@@V{n}, V{n}='x;y' */;" for n in range(101, 113)]
    table = "CREATE TABLE `columns_priv` (\n  `Host` char(60) COLLATE utf8_bin NOT NULL DEFAULT '',\n  `Timestamp` timestamp NOT NULL DEFAULT CURRENT_TIMESTAMP,\n  PRIMARY KEY (`Host`)\n) ENGINE=MyISAM DEFAULT CHARSET=utf8 COMMENT='Column; privileges';"
    #: The statements in order; kinds and types are in the test.
    bodies = [
        "# administrator command: Ping;", "# administrator command: Quit;", "select @@version_comment limit 1;", "SHOW /*!40100 ENGINE*/ INNODB STATUS;", "# administrator command: Quit;", "select @@version_comment limit 1;",
        "SELECT DATABASE();", "# administrator command: Init DB;", *settings[:10], "DROP TABLE IF EXISTS `columns_priv`;", *settings[10:], table,
    ]
    threads = [3] * 2 + [4] * 3 + [5] * 17
    return HEADER + "".join(entry(b, user=f"msandbox[msandbox] @ localhost []  Id:     {t}", use="use mysql;\n" if "Init DB" in b else "") for b, t in zip(bodies, threads, strict=True))


@pytest.mark.parametrize("framing", ["split", "exact"])
def test_small_log(spark, tmp_path, framing):
    (tmp_path / "small.log").write_text(small_log())
    rows = slowlog.read_slow_log(spark, f"file://{tmp_path}/small.log", framing=framing).orderBy("entry_id").collect()
    assert len(rows) == 22 and all(r._corrupt_record is None for r in rows)
    kinds = {1: "admin", 2: "admin", 5: "admin", 8: "admin", 3: "sql", 4: "sql", 6: "sql", 7: "sql", 19: "sql", 22: "sql"}
    assert [r.statement_kind for r in rows] == [kinds.get(i, "invalid") for i in range(1, 23)]
    assert Counter(r.sql_type or "NULL" for r in rows) == {"NULL": 16, "SELECT": 3, "SHOW VARIABLE": 1, "DROP TABLE": 1, "CREATE TABLE": 1}
    assert Counter(r.thread_id for r in rows) == {3: 2, 4: 3, 5: 17}
    assert rows[7].sql == "Init DB" and rows[7].use_database == "mysql"
    assert [(h.tcp_port, h.socket) for h in slowlog.read_headers(spark, f"file://{tmp_path}/small.log").collect()] == [(12345, "/tmp/12345/mysql.sock")]


def test_rows_processed(spark):
    df = spark.createDataFrame([(entry("SELECT 1;"),), ("broken",)], "record string")
    watched, watch = analytics.observed(entries.parse(df))
    watched.write.format("noop").mode("overwrite").save()
    assert watch.get == {"processed": 2, "corrupt": 1}


def test_empty_table(spark):
    df = entries.parse(spark.createDataFrame([], "record string"))
    assert df.count() == 0 and analytics.type_counts(df).count() == 0


def test_null_records_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "x"), (entry("SELECT 1;"), "y")], "record string, note string")
    assert sorted((r.note, r.sql) for r in entries.parse(df).collect() if r.sql) == [("y", "SELECT 1")]


NOTE = "SELECT 1;"
#: quirk of the format -> (record, what its entry must hold)
QUIRKS = {
    "Q1 versioned comment": (entry("/*!40101 SET NAMES utf8 */;"), {"statement_kind": "invalid", "sql": "/*!40101 SET NAMES utf8 */;", "sql_type": None}),
    "Q2 admin command of two words": (entry("# administrator command: Init DB;"), {"statement_kind": "admin", "sql": "Init DB"}),
    "Q3 comment without pairs": (entry("-- note to self; really\nSELECT 1;"), {"statement_kind": "sql", "sql": "SELECT 1", "comment_map": None}),
    "Q3 comment with a key twice": (entry("-- a: 1, a: 2\nSELECT 1;"), {"statement_kind": "sql", "sql": "SELECT 1", "comment_map": None}),
    "Q4 comment ends at its line": (entry("-- a: 1,\nSELECT b: 2;"), {"comment_map": {"a": "1"}}),
    "Q4 bare comment": (entry("--\nSELECT 1;"), {"statement_kind": "sql", "sql": "SELECT 1"}),
    "Q5 other quote inside a string": (entry("SELECT \"it's\", 'say \"';\nSELECT 2;"), {"statement_kind": "sql", "_trailing": "SELECT 2;"}),
    "Q6 second statement": (entry("SELECT 1; SELECT 2;"), {"sql": "SELECT 1", "_trailing": "SELECT 2;"}),
    "Q7 truncated in the session line": (entry(NOTE)[:50], {"statement_kind": None, "_corrupt_reason": "user"}),
    "Q7 truncated in the statement": (entry("SELECT 'open"), {"statement_kind": None, "_corrupt_reason": "incomplete sql"}),
    "Q8 hosts of any form": (entry(NOTE, user="a-b.c[] @ db-2_x.h9 [fe80::1]  Id: 1"), {"user_name": "a-b.c", "sys_user_name": "", "host_name": "db-2_x.h9", "ip_address": "fe80::1"}),
    "Q9 further statistics": (entry(NOTE, stats="Query_time: 1.5  Lock_time: 0.0 Rows_sent: 3  Rows_examined: 4 Thread_id: 9 Errno: 0"), {"rows_examined": 4, "extra": "Thread_id: 9 Errno: 0"}),
    "Q10 fraction and backticks": (entry(NOTE, use="use `a b`;\n", stamp="SET timestamp=12.9;"), {"set_timestamp": 12, "use_database": "a b"}),
    "Q12 backticks stay": (entry("SELECT 1 FROM `t`, t;"), {"objects": [(None, "`t`"), (None, "t")]}),
    "Q13 names of WITH count": (entry("WITH c AS (SELECT 1 FROM t) SELECT * FROM c;"), {"objects": [(None, "c"), (None, "t")]}),
    "Q14 three parts": (entry("SELECT 1 FROM a.b.c;"), {"objects": [(None, "c")]}),
    "Q15 unlock": (entry("UNLOCK TABLES;"), {"sql_type": "LOCK TABLES"}),
    "Q15 every drop": (entry("DROP VIEW v;"), {"sql_type": "DROP TABLE"}),
    "Q16 milliseconds are cut": (entry(NOTE, time="2018-02-05T02:46:47.999999Z"), {"log_time": dt.datetime(2018, 2, 5, 2, 46, 47, 999000)}),
    "Q17 other comments aren't read": (entry("/* a: 1 */ SELECT 1; -- b: 2"), {"sql": "SELECT 1", "comment_map": None}),
    "Q18 no context without a valid statement": (entry("-- request_id: r1\nnot sql;"), {"statement_kind": "invalid", "context": None, "comment_map": {"request_id": "r1"}}),
    "Q18 context of a valid one": (entry("-- request_id: r1, line: x\nSELECT 1;"), {"context": ("r1", None, None, None)}),
}


@pytest.fixture(scope="module")
def quirks(spark):
    return dict(zip(QUIRKS, parse(spark, *[record for record, _ in QUIRKS.values()]), strict=True))


@pytest.mark.parametrize("name", QUIRKS)
def test_quirks(quirks, name):
    plain = lambda v: [tuple(o) for o in v] if isinstance(v, list) else v
    assert {k: plain(quirks[name][k]) for k in QUIRKS[name][1]} == QUIRKS[name][1]


def test_quirk_11_masking_never_falls_back(spark):
    (row,) = parse(spark, entry("CREATE TABLE t (a char(10) DEFAULT 'secret'"), masking="placeholder")
    assert row.sql is None or "secret" not in row.sql
    (row,) = parse(spark, entry("gibberish 'secret' 12;"), masking="placeholder")
    assert (row.statement_kind, row.sql) == ("invalid", "gibberish ? ?;")


def test_quirk_19_port_is_optional(spark):
    df = spark.createDataFrame([(HEADER.replace("Tcp port: 12345  ", ""),)], "record string")
    (row,) = entries.headers(df).collect()
    assert (row.tcp_port, row.socket) == (None, "/tmp/12345/mysql.sock")


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [queries.a8_context, queries.a2_mask, queries.x1_top_fingerprints])
def test_a_filter_on_the_analysis_does_not_run_it_again(spark, query):
    plan = executed(query(spark, "/root/testdata/sf0.001"))
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("date_format(") == 1  # the rendered text too is made once a row


def test_comment_pairs_and_statements_are_found_once_a_row(spark):
    plan = executed(queries.a8_context(spark, "/root/testdata/sf0.001"))
    assert plan.count("map_from_entries(") == 1
    assert plan.count(r"`[^`]*+`|/\*.*?\*/") == 1


def test_events_of_one_row_group_are_rendered_in_many_tasks(spark):
    for df in (rendering.records(spark, "/root/testdata/sf0.001"), rendering.varied(spark, "/root/testdata/sf0.001")):
        tasks = df.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 4 and max(n for _, n in tasks) < 2 * sum(n for _, n in tasks) / len(tasks)


def test_the_time_is_read_and_the_comment_cut_off_once_for_all_columns(spark):
    plan = executed(entries.parse(spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("record"))).select("log_time", "_trailing"))
    top = plan[: plan.index("Generate")]
    assert "date_trunc(MILLISECOND, _time" in top and "as timestamp" not in top.split("FileScan")[0]
    assert r"(?:\r?\n|\r|$)" not in top


def test_readers_send_batches_of_bounded_size(tmp_path):
    n, long = 3 * slowlog.BATCH_RECORDS, slowlog.BATCH_CHARS // 4
    (tmp_path / "a.log").write_text("".join(entry(f"SELECT {i};") for i in range(n)) + "".join(entry(f"SELECT '{'x' * long}';") for _ in range(20)))
    options = {"path": str(tmp_path)}
    stream_reader, size = slowlog._StreamReader(options), dict(slowlog.files(str(tmp_path)))
    readers = [(stream_reader, stream_reader.partitions({}, size)), *[(r, r.partitions()) for r in (slowlog._Reader(options), slowlog._Reader(options | {"framing": "exact"}))]]
    for reader, parts in readers:
        found = [b for p in parts for b in reader.read(p)]
        assert sum(b.num_rows for b in found) == n + 20
        assert max(b.num_rows for b in found) <= slowlog.BATCH_RECORDS
        assert max(b.nbytes for b in found) < 2 * slowlog.BATCH_CHARS


def test_a_growing_log_is_copied_in_pieces(tmp_path):
    (tmp_path / "own").mkdir()
    text = bytes(range(256)) * 4096 * 32
    (tmp_path / "own" / "a.log").write_bytes(text)
    tracemalloc.start()
    queries._grow(str(tmp_path / "own"), str(tmp_path / "grows"), 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (tmp_path / "grows" / "a.log").read_bytes() == text[: len(text) // 2]
    assert peak < len(text) // 4
