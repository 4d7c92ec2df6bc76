"""Mixing sources to target weights (native).

Capped water-filling: every source has a weight and a cap (``max_epochs`` times its size). The budget is shared by
weight; sources above their cap are clamped to it and the excess is shared among the others by weight, until none is
above. The fixed point of those rounds is found in one pass: with the sources sorted by cap / weight, the clamped ones
are a prefix, and one level (words per unit of weight) holds for the rest.

Sampling: a document is taken ``whole`` times (the whole epochs of its source), and once more if it falls among the
fractional ones. Those are the first documents in a seeded order, as many as fit the source's remaining words; further
passes fill what is left with smaller documents. What decides is a threshold per source and pass, so that documents
are neither shuffled nor joined with each other: a source is cut into buckets of the seeded order, the buckets are
summed, and only the bucket in which the words run out is looked at key by key. A source that holds a third of all rows
is thereby spread like any other.

The order is by a hash of seed, doc_id and text, so rows that share an id, or have none, stand apart. Rows that share both are
copies with one key; if the words run out among them, as many copies are taken as fit, the first by their place in the
table, which is found by counts per part of the table. So it takes no group in one place, and how many are taken is the same
on each run.

Defined results: null text has size 0 and is taken 0 words; sources that are null form the last source; an empty table
gives no rows; rows that repeat (doc_id and text) are each a document; a source without words has target 0; very long texts
are documents like others, and one that is larger than what is left of its source's words is passed over for smaller ones;
columns besides those named below are not looked at, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

PASSES = 3
BUCKET = 3  # hex digits: 4096 buckets a source


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    said = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), said))


def water_fill(sizes: DataFrame, weights: Sequence[float], budget: float, max_epochs: float) -> DataFrame:
    """Columns mix_source, source_size, weight, target. ``sizes`` has a row for each source, with mix_source and
    source_size; ``weights`` go to the sources by code point, null last, and repeat."""
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (rank + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    # one row a source, so these windows are small
    before = Window.orderBy("ratio", F.col("mix_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", F.col("mix_source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything).cast("double") * F.lit(float(budget))
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("clamped", F.col("level") >= F.col("ratio"))
    # the first source that isn't clamped has the level of all that follow
    level = F.min(F.when(~F.col("clamped"), F.struct("ratio", "level"))).over(everything)["level"]
    return rows.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(level * F.col("weight"))).select("mix_source", "source_size", "weight", "target")


def _edge(rows: DataFrame, plan: DataFrame, left: str, out: str) -> DataFrame:
    """Add to ``plan`` the key (column ``out``) of the seeded order at which the words run out of what is ``left``, how many
    copies of that key still fit (``out``_copies), and what is left then (``out``_left). ``rows``: mix_source, size, key."""
    prefix = F.substring("key", 1, BUCKET)
    sums = rows.groupBy("mix_source", prefix.alias("bucket")).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("mix_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    edge = sums.withColumnRenamed("mix_source", "s").join(plan.select(F.col("mix_source").alias("p"), left), F.col("s").eqNullSafe(F.col("p")))
    edge = edge.groupBy("s").agg(F.min(F.when(F.col("before") + F.col("words") > F.col(left), F.struct("bucket", "before"))).alias("edge"), F.sum("words").alias("all_words"))
    edge = edge.select("s", "all_words", F.col("edge.bucket").alias("at"), F.col("edge.before").alias("before"))
    near = rows.join(edge.withColumnRenamed("s", "p"), F.col("mix_source").eqNullSafe(F.col("p")) & (prefix == F.col("at")))
    near = near.groupBy("mix_source", "key", "before").agg(F.max("size").alias("size"), F.sum("size").alias("words"))  # copies are one row
    near = near.join(plan.select(F.col("mix_source").alias("q"), left), F.col("mix_source").eqNullSafe(F.col("q")))
    upto = Window.partitionBy("mix_source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("sum", F.col("before") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
    near = near.where(F.col("sum") + F.col("words") > F.col(left)).groupBy(F.col("mix_source").alias("n")).agg(F.min(F.struct("key", "sum", "size")).alias("first"))
    plan = plan.join(edge, F.col("mix_source").eqNullSafe(F.col("s")), "left").join(near, F.col("mix_source").eqNullSafe(F.col("n")), "left")
    # without an edge, all fit: "g" is above every hex digit
    key = F.when(F.col("s").isNull(), F.lit("")).when(F.col("at").isNull(), F.lit("g")).otherwise(F.col("first.key"))
    copies = F.when(F.col("at").isNotNull(), F.floor((F.col(left) - F.col("first.sum")) / F.col("first.size"))).otherwise(F.lit(0)).cast("long")
    words = F.when(F.col("s").isNull(), F.lit(0)).when(F.col("at").isNull(), F.col("all_words")).otherwise(F.col("first.sum") + copies * F.col("first.size"))
    plan = plan.withColumns({out: key, f"{out}_copies": copies, f"{out}_left": F.col(left) - words})
    return plan.drop("s", "all_words", "at", "before", "n", "first")


def _copies(rows: DataFrame, plan: DataFrame, out: str) -> DataFrame:
    """Add to ``plan`` the last place (``out``_place) of the copies that fit, of the key at which the words run out."""
    want = plan.where(F.col(f"{out}_copies") > 0).select(F.col("mix_source").alias("p"), F.col(out).alias("k"), F.col(f"{out}_copies").alias("want"))
    met = rows.join(want, F.col("mix_source").eqNullSafe(F.col("p")) & (F.col("key") == F.col("k")))
    met = met.select("mix_source", "want", "place", F.shiftright("place", 33).alias("part"))  # a part of the table as it was written
    order = Window.partitionBy("mix_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = met.groupBy("mix_source", "want", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("seen", F.coalesce(F.sum("n").over(order), F.lit(0)))
    last = parts.where((F.col("seen") < F.col("want")) & (F.col("seen") + F.col("n") >= F.col("want"))).select(F.col("mix_source").alias("l"), F.col("part").alias("last"), "seen")
    inside = met.join(last, F.col("mix_source").eqNullSafe(F.col("l")) & (F.col("part") == F.col("last")))
    nth = F.row_number().over(Window.partitionBy("mix_source").orderBy("place"))  # one part of the table
    end = inside.withColumn("nth", nth + F.col("seen")).where(F.col("nth") == F.col("want")).select(F.col("mix_source").alias("e"), F.col("place").alias("end"))
    return plan.join(end, F.col("mix_source").eqNullSafe(F.col("e")), "left").withColumn(f"{out}_place", F.coalesce("end", F.lit(-1))).drop("e", "end")


def extra(key: Column, size: Column, place: Column, passes: int) -> Column:
    """Whether a document is taken once more; the columns of the plan of its source are in scope."""
    taken = F.lit(False)
    for p in range(passes):
        fits = (key < F.col(f"cut{p}")) | ((key == F.col(f"cut{p}")) & (place <= F.col(f"cut{p}_place")))
        taken = taken | (fits & (size <= F.col(f"cut{p - 1}_left")) if p else fits)
    return taken


def plan_mix(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0, passes: int = PASSES) -> DataFrame:
    """A row for each source with its target and the thresholds of sampling. ``rows`` as of ``_sized``."""
    sizes = rows.groupBy("mix_source").agg(F.sum("size").alias("source_size"))
    plan = water_fill(sizes, weights, budget, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialize(plan, "mix-plan")
    for p in range(passes):
        rest = rows
        left = "left" if p == 0 else f"cut{p - 1}_left"
        if p:
            seen = plan.select(F.col("mix_source").alias("p"), *[c for c in plan.columns if c.startswith("cut")])
            rest = rows.join(seen, F.col("mix_source").eqNullSafe(F.col("p")))
            rest = rest.where((F.col("size") <= F.col(left)) & ~extra(F.col("key"), F.col("size"), F.col("place"), p)).select("mix_source", "size", "key", "place")
        plan = materialize(_edge(rest, plan, left, f"cut{p}"), "mix-plan")
        if plan.where(F.col(f"cut{p}_copies") > 0).limit(1).count():
            plan = materialize(_copies(rest, plan, f"cut{p}"), "mix-plan")
        else:
            plan = plan.withColumn(f"cut{p}_place", F.lit(-1).cast("long"))
    return plan


def _sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """mix_source, size, key and place (in the table as it is written here) of each row, and ``more``."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("source").alias("mix_source"), size_of(text).alias("size"), order_key(F.col("doc_id"), text, seed).alias("key"), F.monotonically_increasing_id().alias("place"), *more)
    return materialize(rows, "mix-sizes")


def _repeats(passes: int) -> Column:
    more = extra(F.col("key"), F.col("size"), F.col("place"), passes).cast("long")
    return F.when(F.col("size") > 0, F.col("whole") + more).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 7, passes: int = PASSES) -> DataFrame:
    """doc_id, size, source_size, target, taken, repeats for each row of ``docs`` (doc_id, text, source)."""
    rows = _sized(docs, seed, F.col("doc_id"))
    plan = plan_mix(rows, weights, budget, max_epochs, passes).withColumnRenamed("mix_source", "p")
    out = rows.join(plan, F.col("mix_source").eqNullSafe(F.col("p"))).withColumn("repeats", _repeats(passes))
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


def sample(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 7, passes: int = PASSES) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with the columns of ``docs``."""
    rows = _sized(docs, seed, F.struct(*[docs[c] for c in docs.columns]).alias("mix_row"))
    plan = plan_mix(rows, weights, budget, max_epochs, passes).withColumnRenamed("mix_source", "p")
    out = rows.join(plan, F.col("mix_source").eqNullSafe(F.col("p")))
    out = out.select("mix_row", F.explode(F.array_repeat(F.lit(1), _repeats(passes).cast("int"))).alias("again"))
    return out.select(*[F.col("mix_row").getField(c).alias(c) for c in docs.columns])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, text, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT min({'r': ratio, 'v': level}) AS first FROM l WHERE level < ratio),
t AS (SELECT source, source_size, CASE WHEN level >= ratio THEN cap ELSE (SELECT first.v FROM f) * weight END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r0 AS (SELECT d.doc_id, d.source, d.key, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS room
       FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
a0 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) <= room AS t0 FROM r0),
r1 AS (SELECT *, room - coalesce(sum(size) FILTER (t0) OVER (PARTITION BY source), 0) AS room1 FROM a0),
a1 AS (SELECT *, NOT t0 AND size <= room1 AND coalesce(sum(size) FILTER (NOT t0 AND size <= room1) OVER (PARTITION BY source ORDER BY key), 0) <= room1 AS t1 FROM r1),
r2 AS (SELECT *, room1 - coalesce(sum(size) FILTER (t1) OVER (PARTITION BY source), 0) AS room2 FROM a1),
a2 AS (SELECT *, NOT t0 AND NOT t1 AND size <= room2 AND coalesce(sum(size) FILTER (NOT t0 AND NOT t1 AND size <= room2) OVER (PARTITION BY source ORDER BY key), 0) <= room2 AS t2 FROM r2)
SELECT doc_id, size, source_size, target, CAST(size * (CASE WHEN size > 0 THEN whole + CAST(t0 OR t1 OR t2 AS BIGINT) ELSE 0 END) AS BIGINT) AS taken,
    CAST(CASE WHEN size > 0 THEN whole + CAST(t0 OR t1 OR t2 AS BIGINT) ELSE 0 END AS BIGINT) AS repeats FROM a2
"""
