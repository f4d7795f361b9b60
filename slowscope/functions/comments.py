"""Key/value comments before a statement, and the context made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIR = r"(?s)^\s*([A-Za-z0-9_]+)\s*[:=]\s*(.*)$"


def comment_map(comment: Column) -> Column:
    """map<string,string> of pairs split by , or ;, each at its first : or =.

    Null if there is no pair, if a part is no pair, or if a key occurs twice; blank parts don't count."""
    parts = F.filter(F.split(comment, "[,;]"), lambda p: F.trim(p) != "")
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, _PAIR, 1).alias("key"), F.regexp_extract(p, _PAIR, 2).alias("value")))
    keys = F.transform(pairs, lambda p: p["key"])
    good = (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(_PAIR)) & (F.size(F.array_distinct(keys)) == F.size(keys))
    return F.when(good, F.map_from_entries(F.when(good, pairs)))


def context(pairs: Column) -> Column:
    """struct<request_id, caller, function, line> of the keys request_id, file, method and line; null if all are."""
    line = F.try_element_at(pairs, F.lit("line")).try_cast("bigint")
    get = lambda k: F.try_element_at(pairs, F.lit(k))
    made = F.struct(get("request_id").alias("request_id"), get("file").alias("caller"), get("method").alias("function"), line.alias("line"))
    return F.when(F.coalesce(get("request_id"), get("file"), get("method"), line.cast("string")).isNotNull(), made)
