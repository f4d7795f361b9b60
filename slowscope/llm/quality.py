"""Quality rules: word, symbol and repetition statistics, base rules, and robust outliers.

All of it is DataFrame functions; nothing runs in Python on the executors.

Statistics of a text are computed inside its row: windows of eight words are compared by
hashes of hashes, and only a text that holds two equal ones is sorted for their places.

Outliers: per language and source, the minimum covariance determinant.  STARTS first guesses (about
the medians, the quartiles and the mean, with scales of their own) each take C_STEPS concentration
steps, which keep the SUBSET share of least distances; the guess whose covariance has the least
determinant is kept and takes LAST_STEPS more.  Each step is one aggregation by group, guess and
binned distance, whose size has a bound per group.  Transformed statistics are rounded to thousandths,
so sums are exact integers and don't depend on the order of rows.  FLOORS are added to the variances,
scaled to what a statistic can attain, so that one that hardly varies in a group rejects only what
lies sqrt(CUTOFF) floors off: mean word length 1.9 times or half the group's, half of all lines
repeated, or a symbol in four words.  Repeated words, of which the base rule leaves 30 % at most, reject
only together with another statistic (labelled documents with 20 to 30 % of them are good ones).

Sources with fewer than MIN_GROUP documents of a language are pooled by language, and a pool
under MIN_FIT documents, which has no covariance of its own, rejects nothing: stated rules, the same in
a table of any size.  Only documents that pass the base rules are fitted or rejected; a document is
rejected if its squared distance exceeds CUTOFF.

Null text has no words and fails the base rules.  Null language or source counts as ''.  Texts of
any length are taken whole; an empty table gives no row.  Repeated rows each count.  Further columns,
whatever their names, are kept or ignored as asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .components import bounded

SPACE = " \t\n\x0b\f\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
STATS = ("x0", "x1", "x2", "x3")
FLOORS = (0.10, 0.08, 0.08, 0.07)  # standard deviations added for: log word length, root symbols a word, repeated lines, repeated words
UNIT = 1000
SUBSET = 0.75
CONSISTENCY = 1.486  # SUBSET / P(chi2 with 6 <= the SUBSET quantile of chi2 with 4)
STARTS = 4
C_STEPS = 2
LAST_STEPS = 2
MIN_GROUP = 50
MIN_FIT = 8
CUTOFF = 40.0  # chi2 with 4: upper tail 4e-8
BINS = 16


def statistics(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.split(F.btrim(text, F.lit(SPACE)), r"[\x20\x09-\x0D]+")
    words = F.when(F.btrim(text, F.lit(SPACE)) == "", F.array().cast("array<string>")).otherwise(words)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    df = docs.withColumns({"_words": words, "_lines": lines, "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")})
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_words", "_lines")
    for step in (1, 2, 4):  # hash of 2, 4 and then 8 words from each place; the tail has no partner and is cut below
        df = df.withColumn("_h", F.zip_with("_h", F.slice("_h", step + 1, F.greatest(F.size("_h"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_h", F.when(F.col("n_words") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.slice("_h", 1, F.greatest(F.col("n_words") - WINDOW + 1, F.lit(0)).cast("int"))))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_h", F.when(twice, F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    equal = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
    places = F.transform("_h", lambda x, i: F.when(equal(x, F.get("_h", i - 1)) | equal(x, F.get("_h", i + 1)), x["i"]))
    df = df.withColumn("_p", F.sort_array(F.filter(places, lambda p: p.isNotNull())))
    gaps = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return df.withColumn("n_repeat_words", covered).drop("_h", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _fixed(x: Column) -> Column:
    return F.floor(x * UNIT + 0.5).cast("long")


def transformed(df: DataFrame) -> DataFrame:
    """Adds x0..x3: transformed statistics in thousandths."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return df.withColumns(
        {
            "x0": _fixed(F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n)),
            "x1": _fixed(F.sqrt(F.col("n_symbols") / n)),
            "x2": _fixed(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
            "x3": _fixed(F.col("n_repeat_words") / n),
        }
    )


def squared_distance(mean: list[Column], low: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance of x0..x3 by forward substitution in the Cholesky factor `low`."""
    ys: list[Column] = []
    for i, x in enumerate(STATS):
        y = F.col(x) - mean[i]
        for j in range(i):
            y = y - low[i, j] * ys[j]
        ys.append(y / low[i, i])
    total = ys[0] * ys[0]
    for y in ys[1:]:
        total = total + y * y
    return total


def _estimates(kept: DataFrame, keys: tuple[str, ...] = ("grp", "st")) -> DataFrame:
    """keys, m0.., l00..: mean and Cholesky factor of the regularised covariance from exact sums."""
    d = range(len(STATS))
    df = kept.select(*keys, "n", *[(F.col(f"s{i}").cast("double") / F.col("n")).alias(f"m{i}") for i in d], *[F.col(f"s{i}{j}") for i in d for j in range(i + 1)])
    df = df.withColumns({f"c{i}{j}": F.lit(CONSISTENCY) * (F.col(f"s{i}{j}").cast("double") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) + (F.lit((UNIT * FLOORS[i]) ** 2) if i == j else F.lit(0.0)) for i in d for j in range(i + 1)})
    for i in d:
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return df.select(*keys, *[f"m{i}" for i in d], *[f"l{i}{j}" for i in d for j in range(i + 1)])


def _sums() -> dict[str, Column]:
    """Exact sums of the statistics and of their products."""
    d = range(len(STATS))
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    return {f"s{i}": exact(F.col(f"x{i}")) for i in d} | {f"s{i}{j}": exact(F.col(f"x{i}") * F.col(f"x{j}")) for i in d for j in range(i + 1)}


def _starts(fit: DataFrame) -> DataFrame:
    """grp, st, m0.., l00..: the first guesses of each group."""
    d = range(len(STATS))
    quartiles = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    whole = fit.groupBy("grp").agg(F.count("*").alias("n"), *[F.percentile(x, quartiles).alias(f"q{i}") for i, x in enumerate(STATS)], *[c.alias(k) for k, c in _sums().items()]).where(F.col("n") >= MIN_FIT)
    whole = written(whole, "quartiles")
    floor = [F.lit(UNIT * FLOORS[i]) for i in d]
    spread = [F.sqrt(F.pow((F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 1.349, 2) + F.pow(floor[i], 2)) for i in d]
    guess = lambda st, at, scale: whole.select("grp", F.lit(st).alias("st"), *[F.get(f"q{i}", F.lit(at)).alias(f"m{i}") for i in d], *[(scale[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in d for j in range(i + 1)])
    classical = _estimates(whole.withColumn("st", F.lit(3)))
    return guess(0, 1, floor).union(guess(1, 0, spread)).union(guess(2, 2, spread)).union(classical)


def _least_determinant(estimates: DataFrame) -> DataFrame:
    """Of each group's guesses the one whose covariance has the least determinant; ties to the first."""
    det = F.col("l00")
    for i in range(1, len(STATS)):
        det = det * F.col(f"l{i}{i}")
    place = F.row_number().over(Window.partitionBy("grp").orderBy(det, "st"))  # at most STARTS rows a group
    return estimates.withColumn("_place", place).where("_place = 1").drop("_place")


def _with_distance(df: DataFrame, estimates: DataFrame) -> DataFrame:
    """Left join of each document to the estimates of its group, one row for each guess; d2 is null where there are none."""
    d = range(len(STATS))
    both = df.join(bounded(estimates, estimates.count()), "grp", "left")
    both = both.withColumn("d2", squared_distance([F.col(f"m{i}") for i in d], {(i, j): F.col(f"l{i}{j}") for i in d for j in range(i + 1)}))
    return both.drop(*[f"m{i}" for i in d], *[f"l{i}{j}" for i in d for j in range(i + 1)])


def _concentrate(fitted: DataFrame) -> DataFrame:
    """Estimates from the SUBSET share of least distances of each group and guess."""
    bins = fitted.where("d2 is not null").withColumn("bin", F.floor(F.log2(F.col("d2") + 1) * BINS).cast("int")).groupBy("grp", "st", "bin").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in _sums().items()])
    whole = Window.partitionBy("grp", "st")
    up_to = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumns({"before": F.coalesce(F.sum("n").over(up_to), F.lit(0)), "all": F.sum("n").over(whole)}).where(F.col("before") < F.lit(SUBSET) * F.col("all"))
    return _estimates(bins.groupBy("grp", "st").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in _sums()]))


def robust_outliers(stats: DataFrame, *, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """stats (of statistics(), written) with d2: squared robust distance, null where there is no estimate."""
    df = transformed(stats).withColumns({"_l": F.coalesce(F.col(lang_col), F.lit("")), "_s": F.coalesce(F.col(source_col), F.lit(""))})
    fit = df.where(~base_failed())
    large = written(fit.groupBy("_l", "_s").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_GROUP), "groups").select("_l", "_s", F.lit(True).alias("large"))
    df = df.join(bounded(large, large.count()), ["_l", "_s"], "left")
    df = df.withColumn("grp", F.struct(F.col("_l").alias("lang"), F.when(F.col("large"), F.col("_s")).alias("source"))).withColumn("grp", F.to_json("grp")).drop("_l", "_s", "large")
    fit = df.where(~base_failed()).select("grp", *STATS)
    fit = written(fit, "fit")
    estimates = written(_starts(fit), "starts")
    for _ in range(C_STEPS):
        estimates = written(_concentrate(_with_distance(fit, estimates)), "estimates")
    estimates = written(_least_determinant(estimates), "estimates")
    for _ in range(LAST_STEPS):
        estimates = written(_concentrate(_with_distance(fit, estimates)), "estimates")
    return _with_distance(df, estimates).drop("grp", "st", *STATS)


def assess(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: the columns `keep`, the statistics, base_failed, d2 and kept."""
    names = {c: f"k{i}" for i, c in enumerate(keep)}
    own = docs.select(*[F.col(c).alias(a) for c, a in names.items()], F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    stats = statistics(own)
    if text_col not in keep:
        stats = stats.drop("text")
    stats = written(stats, "statistics")
    judged = robust_outliers(stats).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF))
    return judged.select(*[F.col(a).alias(c) for c, a in names.items()], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "d2", "base_failed", "kept")


def kept_rows(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that are kept, with all columns, whatever their names."""
    names = docs.columns
    own = {c: f"c{i}" for i, c in enumerate(names)}
    judged = assess(docs.toDF(*own.values()), text_col=own[text_col], lang_col=own[lang_col], source_col=own[source_col], keep=tuple(own.values()))
    return judged.where("kept").select(*[F.col(a).alias(c) for c, a in own.items()])


def oracle_sql() -> str:
    """The query's rows in DuckDB, from the texts, with the same steps."""
    d = range(len(STATS))
    pairs = [(i, j) for i in d for j in range(i + 1)]

    def distance(lo: str) -> list[str]:
        """Columns y0.. of a document joined to estimates; each uses those before it."""
        out = []
        for i in d:
            minus = "".join(f" - {lo}.l{i}{j} * y{j}" for j in range(i))
            out.append(f"(x{i} - {lo}.m{i}{minus}) / {lo}.l{i}{i} AS y{i}")
        return out

    def measured(name: str, rows: str, estimates: str) -> str:
        columns = f"SELECT f.*, e.st, {', '.join(f'e.m{i}' for i in d)}, {', '.join(f'e.l{i}{j}' for i, j in pairs)} FROM {rows} f LEFT JOIN {estimates} e USING (grp)"
        for y in distance("e"):
            columns = f"SELECT *, {y.replace('e.', '')} FROM ({columns})"
        return f"{name} AS (SELECT *, {' + '.join(f'y{i} * y{i}' for i in d)} AS d2 FROM ({columns}))"

    sums = ", ".join([f"sum(CAST(x{i} AS HUGEINT)) AS s{i}" for i in d] + [f"sum(CAST(x{i} AS HUGEINT) * x{j}) AS s{i}{j}" for i, j in pairs])

    def estimated(rows: str) -> str:
        cov = f"SELECT grp, st, n, {', '.join(f'CAST(s{i} AS DOUBLE) / n AS m{i}' for i in d)}, {', '.join(f's{i}{j}' for i, j in pairs)} FROM {rows}"
        cov = f"SELECT *, {', '.join(f'{CONSISTENCY} * (CAST(s{i}{j} AS DOUBLE) / n - m{i} * m{j}) + {(UNIT * FLOORS[i]) ** 2 if i == j else 0.0} AS c{i}{j}' for i, j in pairs)} FROM ({cov})"
        for i, j in pairs:
            rest = f"c{i}{j}" + "".join(f" - l{i}{q} * l{j}{q}" for q in range(j))
            cov = f"SELECT *, {f'sqrt(greatest({rest}, 1e-9))' if i == j else f'({rest}) / l{j}{j}'} AS l{i}{j} FROM ({cov})"
        return f"SELECT grp, st, {', '.join(f'm{i}' for i in d)}, {', '.join(f'l{i}{j}' for i, j in pairs)} FROM ({cov})"

    def step(k: int, best: bool) -> list[str]:
        again = ", ".join([f"sum(s{i}) AS s{i}" for i in d] + [f"sum(s{i}{j}) AS s{i}{j}" for i, j in pairs])
        new = estimated(f"k{k}")
        if best:
            new = f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {' * '.join(f'l{i}{i}' for i in d)}, st) AS place FROM ({new})) WHERE place = 1"
        return [
            measured(f"q{k}", "fit", f"e{k}"),
            f"b{k} AS (SELECT grp, st, CAST(floor(log2(d2 + 1) * {BINS}) AS INTEGER) AS bin, count(*) AS n, {sums} FROM q{k} WHERE d2 IS NOT NULL GROUP BY 1, 2, 3)",
            f"w{k} AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY grp, st ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY grp, st) AS total FROM b{k})",
            f"k{k} AS (SELECT grp, st, sum(n) AS n, {again} FROM w{k} WHERE before < {SUBSET} * total GROUP BY grp, st)",
            f"e{k + 1} AS MATERIALIZED ({new})",
        ]

    quartiles = ", ".join(f"quantile_cont(x{i}, [0.25, 0.5, 0.75]) AS q{i}" for i in d)
    floors = [str(float(UNIT * FLOORS[i])) for i in d]
    spread = [f"sqrt(pow((q{i}[3] - q{i}[1]) / 1.349, 2) + pow({floors[i]}, 2))" for i in d]
    guess = lambda st, at, scale: f"SELECT grp, {st} AS st, {', '.join(f'CAST(q{i}[{at}] AS DOUBLE) AS m{i}' for i in d)}, {', '.join(f'CAST({scale[i] if i == j else 0.0} AS DOUBLE) AS l{i}{j}' for i, j in pairs)} FROM u"
    fixed = lambda x: f"CAST(floor({x} * {UNIT} + 0.5) AS BIGINT)"
    ctes = [
        "d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents)",
        f"i AS (SELECT rid, place, array_to_string(w[place + 1 : place + {WINDOW}], ' ') AS gram FROM (SELECT rid, w, unnest(range(len(w) - {WINDOW - 1})) AS place FROM d))",
        "r AS (SELECT rid, place FROM (SELECT rid, place, count(*) OVER (PARTITION BY rid, gram) AS times FROM i) WHERE times > 1)",
        f"v AS (SELECT rid, sum(least({WINDOW}, coalesce(ahead - place, {WINDOW}))) AS n FROM (SELECT rid, place, lead(place) OVER (PARTITION BY rid ORDER BY place) AS ahead FROM r) GROUP BY rid)",
        "a AS (SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN v USING (rid))",
        f"x AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {fixed('ln(greatest(word_chars, 1) / CAST(greatest(n_words, 1) AS DOUBLE))')} AS x0, {fixed('sqrt(n_symbols / CAST(greatest(n_words, 1) AS DOUBLE))')} AS x1, {fixed('(n_dup_lines / CAST(greatest(n_lines, 1) AS DOUBLE))')} AS x2, {fixed('(n_repeat_words / CAST(greatest(n_words, 1) AS DOUBLE))')} AS x3 FROM a)",
        f"g AS (SELECT lang, source FROM x WHERE NOT base_failed GROUP BY 1, 2 HAVING count(*) >= {MIN_GROUP})",
        "y AS (SELECT x.*, x.lang || chr(1) || CASE WHEN g.lang IS NULL THEN '' ELSE chr(2) || x.source END AS grp FROM x LEFT JOIN g ON x.lang = g.lang AND x.source = g.source)",
        "fit AS MATERIALIZED (SELECT grp, x0, x1, x2, x3 FROM y WHERE NOT base_failed)",
        f"u AS (SELECT grp, 3 AS st, count(*) AS n, {quartiles}, {sums} FROM fit GROUP BY grp HAVING count(*) >= {MIN_FIT})",
        f"e0 AS MATERIALIZED ({guess(0, 2, floors)} UNION ALL {guess(1, 1, spread)} UNION ALL {guess(2, 3, spread)} UNION ALL {estimated('u')})",
    ]
    for k in range(C_STEPS + LAST_STEPS):
        ctes += step(k, k == C_STEPS - 1)
    ctes.append(measured("z", "y", f"e{C_STEPS + LAST_STEPS}"))
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2, 0.0) <= {CUTOFF} AS kept FROM z"
