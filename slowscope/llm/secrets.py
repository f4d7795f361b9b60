"""Secret scans: base patterns, and character Markov models of random strings and ordinary identifiers.

All of it is DataFrame functions.  Both models are first-order chains over the 68 characters
of ALPHABET, trained on labelled samples that a rule makes: digests in the shapes of public token
formats (random), and words of code and of four languages in the shapes of identifiers, paths, hosts,
versions, dates, numbers and ruled lines (ordinary).  Samples of other numbers than those trained
on are held out for tests.  A token of MIN_TOKEN or more characters (fewer carry too little
evidence) is a secret if its log-likelihood ratio exceeds MIN_RATIO in total and MIN_RATE for
each character.  Tokens that overlap a base span are left to it.  Places are found by cutting
the text at the matches and summing the lengths.

Null text is empty; an empty table gives no row; texts of any length are scanned whole, whatever
the number of their hits.  Rows are told apart by a key of id and text hash, so equal rows give
equal results, one row each; a null doc_id is kept; other columns, whatever their names, are
ignored or kept as asked.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .components import bounded

#: Kinds and patterns of the base rules, in the order in which they are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=-_."
MIN_TOKEN = 16
TOKEN = r"[A-Za-z0-9+/=_.-]{16,}"
MIN_RATIO = 14.0
MIN_RATE = 0.6
SAMPLES = 4_000
SMOOTHING = 0.5

#: Common words of code and of four languages.
WORDS = (
    "get set user name list item count index value data type file path read write open close config default request response server client session handler manager "
    "service factory builder parser string number array object result error message create update delete select insert table column query engine stream buffer "
    "the and that with this from have other their there which would about people water through because between information government development understanding "
    "und nicht eine werden haben sein durch zwischen gesellschaft freundlichkeit wissenschaft arbeit möglich jahr immer wieder schon menschen leben zeit welt "
    "les dans pour que avec sur elle entre nous vous leur cette toujours aujourd gouvernement maison monde jamais encore beaucoup homme femme enfant travail "
    "los una por para con como entre desde hasta tambien cuando porque gobierno ciudad mundo siempre persona trabajo momento palabra historia mujer hombre"
)

def _codes(token: Column) -> Column:
    """Places in the alphabet of a token's characters."""
    places = [0] * 128
    for i, c in enumerate(ALPHABET):
        places[ord(c)] = i
    table = F.split(F.lit(",".join(map(str, places))), ",").cast("array<int>")
    return F.transform(F.split(token, ""), lambda c: F.get(table, F.ascii(c)))


def samples(spark: SparkSession, first: int = 0, n: int = SAMPLES) -> DataFrame:
    """token, random: n labelled samples of each kind made by rule, from number `first` on."""
    i = F.col("id")
    raw = F.unhex(F.sha2(F.concat(F.lit("sample "), i.cast("string")), 256))
    more = F.unhex(F.sha2(F.concat(F.lit("further "), i.cast("string")), 256))
    words = F.split(F.lit(" ".join(w for w in WORDS.split() if w.isascii())), " ")
    pick = lambda k, values: F.get(values, F.pmod(F.xxhash64(i, F.lit(k)), F.size(values)).cast("int"))
    word = lambda k: pick(k, words)
    digits = lambda k, size: F.lpad(F.pmod(F.xxhash64(i, F.lit(k)), F.lit(10**size)).cast("string"), size, "0")
    base64 = F.regexp_replace(F.base64(raw), "=", "")
    url64 = F.translate(base64, "+/", "-_")
    plain = F.regexp_replace(base64, "[+/]", "")
    size = 16 + F.pmod(F.xxhash64(i, F.lit(9)), F.lit(24)).cast("int")
    cut = lambda c: F.substring(c, F.lit(1), size)
    shapes = [
        F.lower(F.hex(raw)), base64, url64, cut(plain), F.upper(plain), F.concat(F.substring(word(1), 1, 3), F.lit("_"), plain), F.concat(F.substring(word(1), 1, 2), F.lit("-"), cut(url64)),
        F.concat(cut(url64), F.lit("."), F.translate(F.regexp_replace(F.base64(more), "=", ""), "+/", "-_")),
    ]
    four = [word(k) for k in (1, 2, 3, 4)]
    date = F.concat_ws("-", digits(5, 4), digits(6, 2), digits(7, 2))
    ordinary = [
        F.concat(four[0], *[F.initcap(w) for w in four[1:]]), F.concat(*[F.initcap(w) for w in four]), F.concat_ws("_", *four), F.concat_ws("-", *four), F.concat_ws(".", *four), F.concat_ws("/", *four),
        F.concat(F.lit("www."), four[0], four[1], F.lit(".org/"), four[2], F.lit("-"), four[3], F.lit(".html")), F.upper(F.concat_ws("_", *four)), F.concat(*four), F.upper(F.concat(*four)),
        digits(5, 16), F.concat(date, F.lit("T"), digits(8, 2), F.lit("."), digits(9, 6)), F.concat(four[0], four[1], F.lit("-"), digits(5, 1), F.lit("."), digits(6, 2), F.lit("."), digits(7, 1), F.lit(".x86_64")),
        F.repeat(pick(5, F.split(F.lit("- = _ . + /"), " ")), F.lit(20)), F.concat(four[0], F.lit("."), F.initcap(four[1]), F.lit("-"), four[2], digits(5, 2)), F.concat_ws("_", four[0], four[1], digits(5, 4), digits(6, 4)),
    ]
    shape = lambda values: F.get(F.array(*values), F.pmod(i, F.lit(len(values))).cast("int"))
    base = spark.range(first, first + n, 1, 4)
    return base.select(shape(shapes).alias("token"), F.lit(True).alias("random")).union(base.select(shape(ordinary).alias("token"), F.lit(False).alias("random")))


@lru_cache(maxsize=4)
def _ratios(spark: SparkSession) -> tuple[float, ...]:
    """log P(b | a, random) - log P(b | a, ordinary) for all a, b; the row after the last letter is the start."""
    n = len(ALPHABET)
    codes = samples(spark).select("random", F.concat(F.array(F.lit(n)), _codes(F.col("token"))).alias("c"))
    two = F.zip_with("c", F.slice("c", 2, F.size("c")), lambda a, b: a * n + b)
    counts = codes.select("random", F.explode(two).alias("ab")).where("ab is not null").groupBy("random", "ab").count().collect()  # at most 2 * 69 * 68 rows
    table = {True: [SMOOTHING] * ((n + 1) * n), False: [SMOOTHING] * ((n + 1) * n)}
    for row in counts:
        table[row["random"]][row["ab"]] += row["count"]
    out = []
    for a in range(n + 1):
        own = {k: t[a * n : (a + 1) * n] for k, t in table.items()}
        out += [math.log(own[True][b] / sum(own[True])) - math.log(own[False][b] / sum(own[False])) for b in range(n)]
    return tuple(round(x, 6) for x in out)


def is_secret(spark: SparkSession, token: Column) -> Column:
    return ratio(spark, token) >= F.greatest(F.lit(MIN_RATIO), F.char_length(token) * MIN_RATE)


def ratio(spark: SparkSession, token: Column) -> Column:
    """Log-likelihood ratio of a token: random against ordinary."""
    n = len(ALPHABET)
    table = F.split(F.lit(",".join(map(repr, _ratios(spark)))), ",").cast("array<double>")
    codes = F.concat(F.array(F.lit(n)), _codes(token))
    # the ratio of two neighbours; what zip_with adds at the end is null and adds nothing
    return F.aggregate(codes, F.struct(F.lit(n).alias("a"), F.lit(0.0).alias("sum")), lambda s, c: F.struct(c.alias("a"), F.when(s["a"] < 0, s["sum"]).otherwise(s["sum"] + F.coalesce(F.get(table, s["a"] * n + c), F.lit(0.0))).alias("sum")), lambda s: s["sum"])


def spans(keyed: DataFrame) -> DataFrame:
    """id, th, kind (place in KINDS), start, end of keyed (id, th, text), for base and model spans."""
    spark = keyed.sparkSession
    text = F.col("text")
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    lower = F.lower(text)
    named = F.contains(lower, F.lit("passw")) | F.contains(lower, F.lit("secret")) | F.contains(lower, F.lit("token")) | F.contains(lower, F.lit("api"))
    judged = F.transform(tokens, lambda t: F.struct(t.alias("m"), is_secret(spark, t).alias("ok")))
    whole = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    sized = lambda kind, m, v: F.zip_with(m, v, lambda a, b: F.struct(a.alias("m"), (F.char_length(b) >= LEAST[kind]).alias("ok")))
    df = keyed.select(
        "id",
        "th",
        "text",
        F.when(named, sized("assign", whole(ASSIGN), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))).alias("f0"),
        F.when(F.contains(text, F.lit("AKIA")), sized("access", whole(ACCESS), whole(ACCESS))).alias("f1"),
        F.transform(whole(r"[0-9a-f]{32,}"), lambda m: F.struct(m.alias("m"), F.lit(True).alias("ok"))).alias("f2"),  # as HEX and its least length: a match is a whole run
        judged.alias("f3"),
    )
    cut = {0: ASSIGN, 1: ACCESS, 2: r"[0-9a-f]{32,}", 3: TOKEN}
    some = lambda k: F.exists(F.col(f"f{k}"), lambda x: x["ok"])
    placed = [F.when(some(k), F.struct(F.lit(k).alias("kind"), F.transform(F.split(text, p, -1), lambda x: F.char_length(x)).alias("gaps"), F.transform(F.col(f"f{k}"), lambda x: F.struct(F.char_length(x["m"]).alias("n"), x["ok"].alias("ok"))).alias("found"))) for k, p in cut.items()]
    df = df.select("id", "th", F.explode(F.filter(F.array(*placed), lambda x: x.isNotNull())).alias("p")).distinct()
    df = df.select("id", "th", "p.kind", F.posexplode(F.zip_with("p.gaps", "p.found", lambda g, f: F.struct(g.alias("gap"), f["n"].alias("n"), f["ok"].alias("ok")))).alias("i", "x"))
    own = Window.partitionBy("id", "th", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("x.gap") + F.coalesce("x.n", F.lit(0))).over(own), F.lit(0))
    df = df.select("id", "th", "kind", (before + F.col("x.gap")).cast("long").alias("start"), "x.n", "x.ok").where("ok")
    df = df.select("id", "th", "kind", "start", (F.col("start") + F.col("n")).alias("end"))
    ordered = Window.partitionBy("id", "th").orderBy("start", "kind")
    base = F.col("kind") < 3
    left = F.max(F.when(base, F.col("end"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(F.when(base, F.col("start"))).over(ordered.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(left, F.lit(-1)) <= F.col("start")) & (F.coalesce(right, F.lit((1 << 62))) >= F.col("end"))
    return df.withColumn("free", base | free).where("free").drop("free")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns of keep (prefixed k_), spans array<struct<start, kind, end>> in order: one row for each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("th"), *[F.col(c).alias(f"k_{c}") for c in keep])
    found = spans(keyed.select("id", "th", "text")).groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    found = written(found, "secrets")
    size = found.agg(F.coalesce(F.sum(F.size("spans") + 2), F.lit(0)).alias("n")).first()["n"]  # spans, not rows, bound what a broadcast holds
    found = bounded(found.select(F.col("id").alias("vid"), F.col("th").alias("vth"), "spans"), size * 2)
    both = keyed.drop("text").join(found, F.col("id").eqNullSafe(F.col("vid")) & (F.col("th") == F.col("vth")), "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return both.select(F.col("id").alias("doc_id"), *[f"k_{c}" for c in keep], F.coalesce("spans", none).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span replaced by the mark; spans may overlap.  Null text stays null."""
    merged = F.aggregate(
        spans,
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.when(x["end"] <= s["at"], s).when(x["start"] < s["at"], F.struct(s["out"].alias("out"), x["end"].alias("at"))).otherwise(F.struct(F.concat(s["out"], F.array(F.concat(F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark)))).alias("out"), x["end"].alias("at"))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(merged["out"], ""), F.substring(text, (merged["at"] + 1).cast("int"), F.char_length(text))))
