"""License scans by diagonal voting, with DataFrame functions only.

Words: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII characters.  Each text is cut into
words once.  Every rolling K-word hash is joined to the positions of the same K words in license
texts and notices (license_texts, a constant of this package, so its broadcast has a proven bound); a
bit map of the hashes, also a constant, drops most that can join nothing before they leave their row.
Hits are summed by offset diagonal (place in the text minus place in the template), diagonals at
most GAP apart and near in the text are merged into spans, and a span is verified by the share of the
template's distinct K-word places that it covers, and by having no overlapping span with more hits.

Base rules: places where the words of a phrase of PHRASES stand consecutively.

Null text is empty: no words, no labels, score 0; an empty table gives no row.  Texts of any length are
taken whole, whatever the number of their hits.  Equal rows give equal results, one row each, and
rows that share an id stay apart; a null doc_id is kept; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, written
from .components import bounded
from .license_texts import TEXTS

K = 3
GAP = 3
REACH = 40
MIN_COVERAGE = 0.6
MAP_BITS = 16

#: Phrases and labels of the base rules.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KELVIN = "\u212a"  # the one other character whose lower case is an ASCII letter


def template_words() -> dict[str, tuple[str, list[str]]]:
    """name -> (label, words) of each template."""
    return {name: (label, [w for w in re.split(_BREAK, text.lower()) if w]) for name, (label, text) in TEXTS.items()}


def words(text: Column) -> Column:
    """The text's words, A-Z lower-cased (other letters in either case: templates and phrases are ASCII)."""
    lowered = F.when(F.contains(text, F.lit(_KELVIN)), lower_ascii(text)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, _BREAK), "")


def _hash(*words: Column) -> Column:
    return F.xxhash64(*words)


def templates(spark: SparkSession) -> DataFrame:
    """h, template, label, at, n_grams: each place of K words in each template."""
    rows = [(*parts[i : i + K], name, label, i, len(parts) - K + 1) for name, (label, parts) in template_words().items() for i in range(len(parts) - K + 1)]
    df = spark.createDataFrame(rows, "w1 string, w2 string, w3 string, template string, label string, at int, n_grams int")
    return df.select(_hash(*map(F.col, ("w1", "w2", "w3"))).alias("h"), "template", "label", "at", "n_grams")


_MAPS: dict[str, tuple[int, ...]] = {}


def _bit_map(spark: SparkSession) -> tuple[int, ...]:
    """Longs of 64 bits: bit h mod 2^MAP_BITS is set for each template hash h."""
    if not _MAPS:
        bits = [0] * (1 << MAP_BITS - 6)
        for row in templates(spark).select("h").collect():  # a constant: some 2,000 rows
            k = row["h"] & (1 << MAP_BITS) - 1
            bits[k >> 6] |= 1 << (k & 63)
        _MAPS[""] = tuple(b - (1 << 64) if b >> 63 else b for b in bits)
    return _MAPS[""]


def read_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid, doc_id, n_words, places of each phrase (p_...), likely (place and hash of K words that may stand in a template)."""
    bits = F.split(F.lit(",".join(map(str, _bit_map(docs.sparkSession)))), ",").cast("array<bigint>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), words(text).alias("w"))
    tail = lambda i: F.slice("w", i, F.greatest(F.size("w"), F.lit(1)))
    three = F.when(F.size("w") >= K, F.arrays_zip(F.col("w").alias("a"), tail(2).alias("b"), tail(3).alias("c")))
    df = df.withColumn("h", F.transform(three, lambda x: _hash(x["a"], x["b"], x["c"])))
    mapped = lambda h: F.getbit(F.get(bits, F.shiftright(h.bitwiseAND((1 << MAP_BITS) - 1), 6).cast("int")), h.bitwiseAND(63).cast("int")) == 1
    likely = F.filter(F.transform("h", lambda h, i: F.when(mapped(h), F.struct(i.alias("place"), h.alias("h")))), lambda x: x.isNotNull())
    some = F.array_contains("w", "license")  # of every phrase

    def starts(phrase: list[str]) -> Column:
        wanted = F.array(*map(F.lit, phrase))
        marked = F.transform("w", lambda x, i: F.when(x == phrase[0], F.when(F.slice("w", i + 1, len(phrase)) == wanted, i)))
        return F.coalesce(F.when(some, F.filter(marked, lambda i: i.isNotNull())), F.array().cast("array<int>"))

    return df.select("uid", "doc_id", F.size("w").cast("long").alias("n_words"), *[starts(p.split()).alias(f"p_{label}") for p, label in PHRASES.items()], likely.alias("likely"))


def verdicts(read: DataFrame) -> DataFrame:
    """uid, found (labels), score, spans for those of read_words() where a template is found."""
    rolled = read.select("uid", F.explode("likely").alias("x")).select("uid", "x.place", "x.h")
    hits = rolled.join(F.broadcast(templates(read.sparkSession)), "h")
    diagonals = hits.withColumn("diagonal", F.col("place") - F.col("at")).groupBy("uid", "template", "label", "n_grams", "diagonal").agg(F.count("*").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"), F.collect_set("at").alias("at"))
    own = Window.partitionBy("uid", "template").orderBy("diagonal", "first")
    before = F.lag("diagonal").over(own)
    fresh = before.isNull() | (F.col("diagonal") - before > GAP) | (F.col("first") - F.lag("last").over(own) > REACH)
    spans = diagonals.withColumn("span", F.sum(fresh.cast("int")).over(own)).groupBy("uid", "template", "label", "n_grams", "span").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.flatten(F.collect_set("at")).alias("at"))
    spans = spans.withColumn("coverage", F.size(F.array_distinct("at")) / F.col("n_grams")).where(F.col("coverage") >= MIN_COVERAGE)
    one = F.struct(F.col("first").cast("long").alias("first_word"), (F.col("last") + K).cast("long").alias("end_word"), "template", "coverage", "label", "votes")
    every = spans.groupBy("uid").agg(F.array_sort(F.collect_list(one)).alias("every"))
    beaten = lambda s: F.exists("every", lambda t: (t["first_word"] < s["end_word"]) & (s["first_word"] < t["end_word"]) & (t["votes"] > s["votes"]))
    every = every.select("uid", F.filter("every", lambda s: ~beaten(s)).alias("spans"))
    return every.select("uid", F.array_distinct(F.transform("spans", lambda s: s["label"])).alias("found"), F.array_max(F.transform("spans", lambda s: s["coverage"])).alias("score"), "spans")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans: one row for each row of docs."""
    read = written(read_words(docs, id_col, text_col), "words")
    found = written(verdicts(read), "licenses")
    size = found.agg(F.coalesce(F.sum(F.size("spans") + 2), F.lit(0)).alias("n")).first()["n"]  # spans, not rows, bound what a broadcast holds
    both = read.drop("likely").join(bounded(found, size * 8), "uid", "left")
    labels = list(PHRASES.values())
    every = F.concat(*[F.col(f"p_{k}") for k in labels])
    named = F.filter(F.array(*[F.when(F.size(f"p_{k}") > 0, F.lit(k)) for k in labels]), lambda x: x.isNotNull())
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return both.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        join(named).alias("base_labels"),
        join(F.concat(named, F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )


def oracle_sql() -> str:
    """The query's rows in DuckDB, from the texts: the same votes, diagonals, spans and coverage by joins of words."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    places = ", ".join(f"({quoted(' '.join(p[i : i + K]))}, {quoted(name)}, {quoted(label)}, {i}, {len(p) - K + 1})" for name, (label, p) in template_words().items() for i in range(len(p) - K + 1))
    phrases = ", ".join(f"({quoted(p)}, {len(p.split())}, {quoted(label)})" for p, label in PHRASES.items())
    return f"""
WITH t(gram, template, label, tpos, n_grams) AS (VALUES {places}),
ph(phrase, n, label) AS (VALUES {phrases}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), i AS (
  SELECT rid, w, unnest(range(len(w))) AS place FROM d
), b AS (
  SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS named
  FROM i JOIN ph ON array_to_string(w[place + 1 : place + n], ' ') = phrase
  GROUP BY rid
), h AS (
  SELECT rid, template, label, n_grams, tpos, place, place - tpos AS diagonal
  FROM i JOIN t ON array_to_string(w[place + 1 : place + {K}], ' ') = gram
), g AS (
  SELECT rid, template, label, n_grams, diagonal, count(*) AS votes, min(place) AS lo, max(place) AS hi, list(tpos) AS tpos FROM h GROUP BY ALL
), m AS (
  SELECT *, lag(diagonal) OVER o AS pd, lag(hi) OVER o AS pl FROM g WINDOW o AS (PARTITION BY rid, template ORDER BY diagonal, lo)
), s AS (
  SELECT *, sum(CASE WHEN pd IS NULL OR diagonal - pd > {GAP} OR lo - pl > {REACH} THEN 1 ELSE 0 END) OVER (PARTITION BY rid, template ORDER BY diagonal, lo) AS span FROM m
), c AS (
  SELECT * FROM (
    SELECT rid, label, sum(votes) AS votes, min(lo) AS lo, max(hi) + {K} AS hi, len(list_distinct(flatten(list(tpos)))) / CAST(n_grams AS DOUBLE) AS coverage FROM s GROUP BY rid, template, label, n_grams, span
  ) WHERE coverage >= {MIN_COVERAGE}
), v AS (
  SELECT rid, list(DISTINCT label) AS found, max(coverage) AS score FROM c a
  WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.rid = a.rid AND b.lo < a.hi AND a.lo < b.hi AND b.votes > a.votes) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(named), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(named, []), coalesce(found, [])))), ','), '') AS labels,
       coalesce(score, 0.0) AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN v USING (rid)
"""
