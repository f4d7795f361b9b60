"""Fields of one log record, by one regular expression, as Column expressions.

Wider than the strict grammar on purpose: users and hosts may hold dashes, dots and digits or
be empty, addresses may be IPv6, statistics may be followed by further fields (kept as `extra`),
the database may be in backticks, and the timestamp may have a fraction, which is cut.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the record pattern's groups, in order.
FIELDS = ("time", "user_name", "sys_user_name", "host_name", "ip_address", "thread_id", "query_time", "lock_time", "rows_sent", "rows_examined", "extra", "use_database", "set_timestamp", "body")

_TIME_LINE = r"(?s)^\s*(?:# Time:\s+)?(\S+)\s+"
_USER_LINE = _TIME_LINE + r"# User@Host:\s+([^\[\]\n]*?)\[([^\]\n]*)\]\s+@\s+([^\s\[\]]*)\s*\[\s*([^\]\s]*)\s*\]\s+Id:\s+(\d+)\s+"
_STATS_LINE = _USER_LINE + r"#\s+Query_time:\s+(\S+)\s+Lock_time:\s+(\S+)\s+Rows_sent:\s+(\d+)\s+Rows_examined:\s+(\d+)([^\n]*)\s+"
RECORD = _STATS_LINE + r"(?:(?i:use)\s+(`[^`]+`|[^\s;`]+)\s*;\s*)?SET timestamp\s*=\s*(\d+)(?:\.\d+)?\s*;\s*(.*)$"

HEADER = r"(?s)(?:^|\n)([^\n]+?), Version: ([^\n]+?) started with:\s+(?:Tcp port:\s+(\d*)\s+)?(?:Unix socket: ([^\n]*))?"

#: Possessive runs: no recursion on long texts.  Comments and quotes may hold semicolons.
STATEMENT = r"""(?s)^((?:[^'"`;\\/#-]++|\\.|'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|`[^`]*+`|/\*.*?\*/|--(?=\s)[^\n]*+|#[^\n]*+|[/-])*+;)(.*)$"""
_ADMIN = r"(?s)^# administrator command:\s+([^;\n]+);(.*)$"
_COMMENT = r"(?s)^--([^\r\n]*)(?:\r?\n|\r|$)(.*)$"

_CUT = "\x01"


def fields(text: Column) -> Column:
    """array<string> for field(): an empty first item, then FIELDS; of one item where the text is no record.

    One pass over the text.  Only a text that holds the mark itself takes a pass for each field."""
    groups = range(1, len(FIELDS) + 1)
    quick = F.split(F.regexp_replace(text, RECORD, "".join(f"{_CUT}${i}" for i in groups)), _CUT, len(FIELDS) + 1)
    slow = F.when(text.rlike(RECORD), F.array(F.lit(""), *[F.regexp_extract(text, RECORD, i) for i in groups]))
    return F.when(text.contains(_CUT), slow).otherwise(quick)


def field(parts: Column, name: str) -> Column:
    own = F.get(parts, F.lit(FIELDS.index(name) + 1))
    return F.nullif(F.trim(own), F.lit("")) if name != "body" else own


def instant(text: Column) -> Column:
    """ISO-8601 text to a timestamp; without an offset it is taken as UTC, whatever the session's time zone.  Null if malformed."""
    return F.when(text.endswith("Z") | text.rlike(r"[+-]\d{2}:?\d{2}$"), text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")


def corrupt_reason(text: Column, parts: Column) -> Column:
    """Why a text that isn't blank is no entry: time, user, stats, incomplete sql or incomplete log; parts: its fields()."""
    cut = F.lit("incomplete log")
    reason = F.when(~text.rlike(_TIME_LINE) | instant(F.regexp_extract(text, _TIME_LINE, 1)).isNull(), "time")
    reason = reason.when(~text.rlike(_USER_LINE), F.when(text.contains("# User@Host:"), "user").otherwise(cut))
    reason = reason.when(~text.rlike(_STATS_LINE), F.when(text.contains("Query_time:"), "stats").otherwise(cut))
    return reason.when(field(parts, "body").isNull(), cut).otherwise("incomplete sql")


def offset_minutes(text: Column) -> Column:
    """Minutes east of UTC; null without an offset."""
    sign = F.when(F.regexp_extract(text, r"([+-])\d{2}:?\d{2}$", 1) == "-", -1).otherwise(1)
    hours, minutes = (F.regexp_extract(text, r"[+-](\d{2}):?(\d{2})$", i).try_cast("int") for i in (1, 2))
    return F.when(text.endswith("Z"), 0).otherwise(sign * (hours * 60 + minutes)).cast("int")


def admin_command(body: Column) -> Column:
    """The command's name; null for other statements."""
    return F.nullif(F.regexp_extract(body, _ADMIN, 1), F.lit(""))


def leading_comment(body: Column) -> Column:
    """What follows -- on a first comment line; null without one."""
    return F.when(body.startswith("--"), F.regexp_extract(body, _COMMENT, 1))


def without_comment(body: Column) -> Column:
    return F.when(body.startswith("--"), F.regexp_extract(body, _COMMENT, 2)).otherwise(body)


def statement(body: Column) -> Column:
    """Up to and with the first semicolon outside quotes and comments; null if there is none."""
    return F.nullif(F.regexp_extract(body, STATEMENT, 1), F.lit(""))


def after_statement(body: Column, statement: Column, uncommented: Column) -> Column:
    """What follows the administrator command, or else the statement(), of the body; null if blank.  uncommented: without_comment(body)."""
    rest = F.when(statement.isNull(), F.regexp_extract(body, _ADMIN, 2)).otherwise(F.substring(uncommented, F.char_length(statement) + 1, F.char_length(body)))
    return F.nullif(F.btrim(rest, F.lit(" \t\r\n")), F.lit(""))


def has_header(text: Column) -> Column:
    return text.contains(", Version: ") & text.rlike(HEADER)


def header(text: Column) -> Column:
    """struct<path, version, tcp_port, socket> of server start lines; null where there are none."""
    part = lambda i: F.nullif(F.regexp_extract(text, HEADER, i), F.lit(""))
    return F.when(has_header(text), F.struct(part(1).alias("path"), part(2).alias("version"), part(3).try_cast("bigint").alias("tcp_port"), part(4).alias("socket")))
