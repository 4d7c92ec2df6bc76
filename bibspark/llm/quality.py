r"""Quality rules with robust multivariate outliers (native).

Statistics of a whole text, in one pass with no shuffle: words, their characters, symbols, repeated lines, and words
that stand in a 3-word window found twice or more in the text. Windows are compared by XXH64 of their words.

A document fails the base rules with fewer than ``MIN_WORDS`` (50) words, or more than half of its words in repeated
windows. The others have a vector: log of the mean word length, square roots of symbols per word, of the share of words
in repeated windows, and of the share of repeated lines. Per language and source, the minimum covariance determinant
estimate of centre and scatter comes from concentration steps: mean and covariance of the half of the documents with the
least Mahalanobis distance. They begin from four starts: medians scaled by median absolute deviations, medians alone, mean and
covariance, medians with the covariance of directions; the one with the least determinant after two steps goes on until no step
lowers it. A document with a squared distance above ``CUTOFF`` goes. ``FLOORS`` are added to the scatter (as
standard deviations): most texts have no symbols or repeated lines at all, and without a floor any text that has one would be
infinitely far. In a group without repeats the floors reject a text for repeated words alone or for repeated lines alone above
a share of 19 % (``CUTOFF`` times the floor's square).

Quantiles are by counts over fixed bins, combined map-side: a language and source that holds a third of all documents is some
thousand counts, not a group of rows. So the half is the half up to a bin's end, which is 0.6 % of a distance; medians are
exact to a 128th. All is the same on each run. Parameters are a row for each language and source, and start.

A language and source with fewer than ``MIN_GROUP`` documents (five for each statistic, the least that the estimate is
recommended for) is pooled with the others such of its language, and if these are too few, with those of all languages; if
these are too few too, there is nothing to tell outliers by, and the method keeps the document.

Defined results: null text has zero words and fails; null lang and null source are groups of their own; an empty table
gives no rows; repeated rows count as often as they stand and get equal results; documents at equal distances stand on the same
side of the half; a very long text is a document like others, of which the arrays of words and window hashes are held at once.
Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, materialize

P = 4
MIN_WORDS, MIN_GROUP, HALF = 50, 5 * P, 0.5
FLOORS = (0.08, 0.12, 0.09, 0.09)
#: The 1 - 1e-4 quantile of chi-square with four degrees of freedom.
CUTOFF = 23.51
SYMBOLS = r"[#*$%&|<>]"
FEW = 64
FINE, STEP = 128.0, 128.0  # bins for a unit of a feature, and for a doubling of a distance


LEAST = 1e-6  # what a step has to take off the logarithm of the determinant
TRIED, TASKS = 2, 8  # steps from each start; tasks that write parameters


def consistency(half: float = HALF) -> float:
    """What the covariance of the nearest ``half`` of a normal sample is multiplied by, for four dimensions."""
    lo, hi = 0.0, 100.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - exp(-mid / 2) * (1 + mid / 2) < half else (lo, mid)
    return half / (1 - exp(-lo / 2) * (1 + lo / 2 + lo * lo / 8))


def _covered(h: Column) -> Column:
    """Words in windows whose hash stands twice or more in ``h`` (a hash for each window, in order)."""

    def places(s: Column) -> Column:
        return let(F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))), few_or_many)

    def few_or_many(d: Column) -> Column:
        few = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(d, F.get(h, i)))
        return F.when(F.size(d) <= FEW, few).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), many))

    def many(e: Column) -> Column:
        twice = F.filter(e, lambda v, k: F.coalesce(v["x"] == F.get(e, k - 1)["x"], F.lit(False)) | F.coalesce(v["x"] == F.get(e, k + 1)["x"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda v: v["i"]))

    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    add = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
    return F.aggregate(let(F.sort_array(h), places), start, add, lambda acc: acc["n"])


def repeated(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more."""
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(some)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of each row of ``docs`` (doc_id, text, lang, source)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = let(F.array_remove(F.split(text, SPACE), ""), lambda w: F.struct(F.size(w).alias("n"), repeated(w).alias("again")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"), words.alias("w"), lines.alias("l"))
    long = lambda c: c.cast("long")
    out = rows.select("doc_id", "lang", "source", long(F.col("w.n")).alias("n_words"), long(F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).alias("word_chars"), long(F.regexp_count("text", F.lit(SYMBOLS))).alias("n_symbols"), long(F.col("l.dup")).alias("n_dup_lines"), long(F.col("w.again")).alias("n_repeat_words"), long(F.col("l.n")).alias("n_lines"))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vectors(stats: DataFrame) -> DataFrame:
    n = F.col("n_words").cast("double")
    xs = [F.log(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))]
    return stats.where("NOT base_failed").select("lang", "source", *[x.alias(f"x{i}") for i, x in enumerate(xs)])


def _groups(rows: DataFrame) -> DataFrame:
    """lang, source, g: the group of each language and source (null if all pools are too small)."""
    null_safe = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    n = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("small", F.col("n") < MIN_GROUP)
    n = n.withColumn("pool", F.sum(F.when(F.col("small"), F.col("n")).otherwise(0)).over(Window.partitionBy("lang")))
    n = n.withColumn("tiny", F.col("small") & (F.col("pool") < MIN_GROUP))
    n = n.withColumn("all", F.sum(F.when(F.col("tiny"), F.col("n")).otherwise(0)).over(Window.partitionBy()))
    g = F.when(~F.col("small"), F.concat(null_safe("lang"), F.lit("\n"), null_safe("source"))).when(~F.col("tiny"), F.concat(null_safe("lang"), F.lit("\n")))
    return n.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), g.when(F.col("all") >= MIN_GROUP, F.lit("\n")).alias("g"))


def _in_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left").drop("g_lang", "g_source")


def _middle(rows: DataFrame, keys: list[str], bin_: Column, share: float) -> DataFrame:
    """keys, cut: the least bin up to which ``share`` of the rows lie, rounded up."""
    n = rows.withColumn("bin", bin_).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*keys)
    n = n.withColumn("upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("all", F.sum("n").over(whole))
    return n.where(F.col("upto") >= F.ceil(F.col("all") * F.lit(share))).groupBy(*keys).agg(F.min("bin").alias("cut"))


def _medians(rows: DataFrame, values: list[Column]) -> DataFrame:
    """g and the medians m0, m1, ... of ``values``."""
    wide = rows.select("g", F.posexplode(F.array(*values)).alias("i", "x"))
    m = _middle(wide, ["g", "i"], F.floor(F.col("x") * FINE), 0.5)
    return m.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, (F.col("cut") + 0.5) / FINE)).alias(f"m{i}") for i in range(P)])


def _cholesky(params: DataFrame) -> DataFrame:
    """Add the factor l{i}{j} of the scatter c{i}{j}, and the log of its determinant."""
    for i in range(P):
        for j in range(i + 1):
            rest = reduce(lambda a, b: a - b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.col(f"c{i}{j}"))
            params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return params.withColumn("log_det", reduce(lambda a, b: a + b, [2 * F.log(F.col(f"l{i}{i}")) for i in range(P)]))


def _distance(rows: DataFrame, out: str) -> DataFrame:
    """Add the squared Mahalanobis distance of x0, x1, ... under m0, m1, ... and l{i}{j}."""
    for i in range(P):
        rest = reduce(lambda a, b: a - b, [F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)], F.col(f"x{i}") - F.col(f"m{i}"))
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn(out, reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)]))


def _with_scatter(params: DataFrame, scatter) -> DataFrame:
    """Add c{i}{j} = scatter(i, j) for j <= i, and its factor."""
    return _cholesky(params.withColumns({f"c{i}{j}": scatter(i, j) for i in range(P) for j in range(i + 1)}))


KEYS = ["g", "start"]
SHAPE = [*KEYS, *[f"m{i}" for i in range(P)], *[f"{c}{i}{j}" for c in "cl" for i in range(P) for j in range(i + 1)], "log_det"]


def _starts(rows: DataFrame) -> DataFrame:
    """The four starts of each group. Only the order of distances under a start matters."""
    x = [F.col(f"x{i}") for i in range(P)]
    centre = materialize(_medians(rows, x), "mcd")
    far = rows.join(centre, "g")
    spread = _medians(far, [F.abs(x[i] - F.col(f"m{i}")) for i in range(P)]).select("g", *[F.greatest(1.4826 * F.col(f"m{i}"), F.lit(FLOORS[i])).alias(f"s{i}") for i in range(P)])
    both = materialize(centre.join(spread, "g"), "mcd")
    s = [F.col(f"s{i}") for i in range(P)]
    z = [(x[i] - F.col(f"m{i}")) / s[i] for i in range(P)]
    size = F.greatest(F.sqrt(reduce(lambda a, b: a + b, [v * v for v in z])), F.lit(1e-9))
    turned = [F.avg(z[i] / size * z[j] / size).alias(f"u{i}{j}") for i in range(P) for j in range(i + 1)]
    plain = [F.avg(x[i]).alias(f"a{i}") for i in range(P)] + [F.covar_pop(x[i], x[j]).alias(f"v{i}{j}") for i in range(P) for j in range(i + 1)]
    seen = rows.join(both, "g").groupBy("g").agg(*turned, *plain)
    seen = both.join(seen, "g")
    zero = F.lit(0.0)
    ways = [
        (lambda i: F.col(f"m{i}"), lambda i, j: s[i] * s[i] if i == j else zero),
        (lambda i: F.col(f"m{i}"), lambda i, j: F.lit(1.0) if i == j else zero),
        (lambda i: F.col(f"a{i}"), lambda i, j: F.col(f"v{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)),
        (lambda i: F.col(f"m{i}"), lambda i, j: s[i] * s[j] * (F.col(f"u{i}{j}") + (1e-6 if i == j else 0.0))),
    ]
    out = []
    for k, (centre_of, scatter) in enumerate(ways):
        made = _with_scatter(seen, scatter).withColumns({f"m{i}": centre_of(i) for i in range(P)} | {"start": F.lit(k), "log_det": F.lit(float("inf"))})
        out.append(made.select(*SHAPE))
    return reduce(DataFrame.unionByName, out)


def _concentrate(rows: DataFrame, params: DataFrame) -> DataFrame:
    """A step: mean and covariance of the nearer half."""
    far = _distance(rows.join(params, "g"), "d").select(*KEYS, *[f"x{i}" for i in range(P)], F.floor(F.log2(F.col("d") + 1e-9) * STEP).alias("at"))
    cut = _middle(far, KEYS, F.col("at"), HALF)
    near = far.join(cut, KEYS).where(F.col("at") <= F.col("cut"))
    sums = [F.avg(f"x{i}").alias(f"m{i}") for i in range(P)] + [F.covar_pop(f"x{i}", f"x{j}").alias(f"v{i}{j}") for i in range(P) for j in range(i + 1)]
    new = near.groupBy(*KEYS).agg(*sums)
    c = consistency()
    return _with_scatter(new, lambda i, j: F.col(f"v{i}{j}") * c + (FLOORS[i] ** 2 if i == j else 0.0)).select(*SHAPE)


def _step(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``params`` after a step of the rows that still move; ``moves`` says whether it lowered the determinant."""
    new = _concentrate(rows, params.where("moves").drop("moves")).select(F.struct(*SHAPE).alias("new"))
    both = params.join(new, (F.col("g") == F.col("new.g")) & (F.col("start") == F.col("new.start")), "left")
    lower = F.coalesce(F.col("new.log_det") < F.col("log_det") - LEAST, F.lit(False))
    told = both.select(*KEYS, *[F.when(lower, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in SHAPE[2:]], lower.alias("moves"))
    return materialize(told.coalesce(TASKS), "mcd")  # a row for each group and start


def estimate(rows: DataFrame) -> DataFrame:
    """g and its centre and scatter. ``rows``: g, x0, x1, ...

    ``TRIED`` steps from each start; of each group the start with the least determinant then goes on until no step lowers it. Each
    step that is taken lowers a determinant that the floors bound from below, so steps end.
    """
    params = materialize(_starts(rows).withColumn("moves", F.lit(True)).coalesce(TASKS), "mcd")
    for _ in range(TRIED):
        params = _step(rows, params)
    best = Window.partitionBy("g").orderBy("log_det", "start")
    params = materialize(params.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n").coalesce(TASKS), "mcd")
    while params.where("moves").limit(1).count():
        params = _step(rows, params)
    return params.drop("start", "moves")


def rules(docs: DataFrame) -> DataFrame:
    """The statistics of each row, base_failed, distance (null if the base rules fail) and kept."""
    stats = materialize(statistics(docs), "quality")
    groups = materialize(_groups(_vectors(stats)), "quality-groups")
    rows = materialize(_in_group(_vectors(stats), groups).where(F.col("g").isNotNull()).select("g", *[f"x{i}" for i in range(P)]), "quality-vectors")
    params = materialize(estimate(rows), "mcd")
    one = [c for c in params.columns if c != "g"]
    told = stats.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    told = told.join(params.withColumnRenamed("g", "p"), F.col("g") == F.col("p"), "left")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    told = told.withColumns({"x0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), "x1": F.sqrt(F.col("n_symbols") / n), "x2": F.sqrt(F.col("n_repeat_words") / n), "x3": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))})
    told = _distance(told, "d").withColumn("distance", F.when(~F.col("base_failed"), F.col("d")))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    return told.withColumn("kept", kept).drop(*one, *[f"x{i}" for i in range(P)], *[f"z{i}" for i in range(P)], "d", "p", "g", "g_lang", "g_source")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    told = rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
