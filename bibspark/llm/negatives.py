"""Hard negatives: rows of other labels that are nearly as close to an anchor as its positives, by one-dimensional distance keys.

Vectors are integers, and so are their scores (inner products). Of each vector x a component sqrt(M - |x|^2) more, with M the
largest squared norm, makes all norms equal, so that the distance between an anchor q (with a zero there) and x falls as their
score rises: |q|^2 + M - 2 qx. A row is stored by its nearest pivot and its distance from it, in that order: slabs of ``SLAB``
rows, each a key interval of one pivot, in blocks that are ranges of the order.

By the triangle inequality rows within a radius of an anchor lie in an annulus around each pivot, which is an interval of keys. A
score that is wanted at least is a radius; the intervals that its annuli meet are all that is read:

1. An anchor's own slab gives a first bound on the score of its last positive, if it holds that many rows of its label.
2. Positives: blocks whose key intervals the annuli meet are joined with the anchor. A task scans slabs outward from where the
   anchor's keys are, and raises the bound by what it finds, until no interval that is left can hold a better row.
3. Negatives: a positive's score bounds those of its negatives from above, and a share of it from below: an annulus with an inner
   radius too. All positives of an anchor are scanned for at once.

A bound never excludes what it doesn't prove to be worse, so results are exact whatever the pivots are; they decide about the
work alone. Pivots are centres of a sample of ``SAMPLE`` rows at most (least hashes of vec_id); every row is indexed. In data
without structure, such as independent directions of 64 components, annuli meet nearly all slabs, and the work is that of all
anchors by all rows, in products of matrices; with clusters most slabs are left out.

What a task holds is one block (``BLOCK`` rows) and ``ASKED`` anchors at once. Copies are told apart by vec_id, so neither equal
vectors nor a frequent label or pivot makes a block larger; very many anchors of one block are dealt to several tasks.

Defined results: rows with a null vec_id or label, and vectors that are null or hold a null or non-finite component, take no
part; nor do those with another number of components than most (of equally many, the shorter), or with a scaled component of
2^26 or more, whose scores might not fit a long. Of repeated rows with one vec_id the least by label and components counts.
Equal scores go by smaller vec_id. An anchor without another row of its label, and a positive without negatives in range, gives
no rows; a negative score of a positive leaves none in range. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, only

SLAB, BLOCK, ASKED, PART = 1024, 8192, 256, 65536
SAMPLE, PER_PIVOT, PIVOTS, STEPS = 2048, 2048, 256, 8
TASKS = 20_000
LARGE = 1 << 26
NONE = 1 << 62  # no bound


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v: floor(scale * x) of each component, as longs, of the rows that take part."""
    v = F.transform(F.col("embedding"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(F.lit(float(scale)) * x.cast("double")) < LARGE)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", number) & (F.size("embedding") > 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))


class Space:
    """The augmented space: its largest squared norm, its pivots, and how scores are computed without rounding."""

    def __init__(self, rows: np.ndarray, largest: float, most: int, n: int) -> None:
        self.largest, self.d = largest, rows.shape[1]
        #: Sums of products stay exact in double precision below 2^53; beyond, they are taken in longs.
        self.kind = np.dtype("<f8") if self.d * most * most < 1 << 53 else np.dtype("<i8")
        self.pad = 1e-6 * np.sqrt(largest) + 1e-9
        x = self.augmented(rows)
        count = max(1, min(PIVOTS, n // PER_PIVOT, len(x)))
        self.pivots = x[np.linspace(0, len(x) - 1, count).astype(int)]
        for _ in range(STEPS if count > 1 else 0):
            near = self.distances(x).argmin(axis=1)
            for p in np.unique(near):
                self.pivots[p] = x[near == p].mean(axis=0)

    def augmented(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(0, self.largest - (x * x).sum(axis=1)))[:, None]])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From points of the augmented space to the pivots."""
        square = (x * x).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(0, square))

    def asked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared norms of anchors, and their distances from the pivots."""
        q = q.astype(np.float64)
        return (q * q).sum(axis=1), self.distances(np.hstack([q, np.zeros((len(q), 1))]))

    def most(self, norms: np.ndarray, away: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The largest score that a row with a key in [low, high] can have with an anchor that is ``away`` from the pivot."""
        gap = np.maximum(0, np.maximum(low - away, away - high) - self.pad)
        return (norms + self.largest - gap * gap) / 2 + 1e-9 * (1 + self.largest)

    def least(self, norms: np.ndarray, away: np.ndarray, high: np.ndarray) -> np.ndarray:
        far = away + high + self.pad
        return (norms + self.largest - far * far) / 2 - 1e-9 * (1 + self.largest)

    def numbers(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, "<i8").reshape(-1, self.d)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _key(v: Column, space: Space) -> Column:
    @F.arrow_udf("struct<pivot: int, away: double>")
    def run(rows: pa.Array) -> pa.Array:
        only("negatives")
        away = space.distances(space.augmented(_matrix(rows)))
        pivot = away.argmin(axis=1)
        return pa.StructArray.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(away[np.arange(len(pivot)), pivot])], ["pivot", "away"])

    return run(v)


_SLABS = "block int, pivot int, low double, high double, ids binary, labels binary, asked binary, xs binary"


def _slabs(batches, size: int):
    """Sorted rows as slabs: up to ``size`` rows of one pivot."""
    from pyspark import TaskContext

    block, now, parts, n = TaskContext.get().partitionId(), None, [], 0

    def out():
        away, ids, labels, asked, xs = (np.concatenate(c) for c in zip(*parts))
        cells = [block, now, float(away[0]), float(away[-1]), ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), asked.astype("?").tobytes(), xs.astype("<i8").tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], ["block", "pivot", "low", "high", "ids", "labels", "asked", "xs"])

    for batch in batches:
        if not batch.num_rows:
            continue
        pivot, *cells = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pivot", "away", "vec_id", "label", "asked"))
        cells.append(_matrix(batch.column("v")))
        cut = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
        for a, b in zip(cut, cut[1:]):
            while a < b:
                if n and (pivot[a] != now or n >= size):
                    yield out()
                    parts, n = [], 0
                now, take = int(pivot[a]), min(b - a, size - n)
                parts.append([c[a : a + take] for c in cells])
                n, a = n + take, a + take
    if n:
        yield out()


def scan(space: Space, slabs: list, own: np.ndarray, labels: np.ndarray, q: np.ndarray, cut: np.ndarray, top: np.ndarray, same: bool, k: int):
    """(anchor, target, id, score) of the best ``k`` rows for each anchor and target: scores from cut to top, of the anchor's label
    (``same``) or of others. cut, top: anchors x targets; a target with its cut above its top isn't one."""
    norms, away = space.asked(q)
    matrix = q.astype(space.kind)
    cut = cut.copy()
    wide = cut.shape[1]
    bounds = np.stack([space.most(norms, away[:, p], lo, hi) for p, lo, hi, *_ in slabs])  # outward from the anchors' keys
    found = np.zeros((4, 0), np.int64)
    for i in np.argsort(-bounds.max(axis=1), kind="stable"):
        pivot, _, high, ids, their, xs = slabs[i]
        lowest, highest = cut.min(axis=1), np.where(cut <= top, top, -NONE).max(axis=1)
        act = np.flatnonzero((bounds[i] >= lowest) & (space.least(norms, away[:, pivot], high) <= highest))
        if not len(act):
            continue
        score = matrix[act] @ xs.astype(space.kind).T
        hit = (score >= lowest[act, None]) & (score <= highest[act, None])
        hit &= (their[None, :] == labels[act, None]) == same
        hit &= ids[None, :] != own[act, None]
        a, c = np.nonzero(hit)
        if not len(a):
            continue
        s, a, new = score[a, c].astype(np.int64), act[a], ids[c]
        more = [found]
        for t in range(wide):
            fit = (s >= cut[a, t]) & (s <= top[a, t])
            more.append(np.stack([a[fit], np.full(fit.sum(), t, np.int64), new[fit], s[fit]]))
        found = np.concatenate(more, axis=1)
        found = found[:, np.lexsort((found[2], -found[3], found[1], found[0]))]
        group = found[0] * wide + found[1]
        first = np.searchsorted(group, group)
        place = np.arange(len(group)) - first
        found, place = found[:, place < k], place[place < k]
        last = found[:, place == k - 1]
        cut[last[0], last[1]] = last[3]
    return found


def _seeds(batches, space: Space, k: int):
    """Of each anchor, within its slab: the score of its kth row of the same label, if there are so many."""
    only("negatives")
    for batch in batches:
        for pivot, low, high, ids, labels, asked, xs in zip(*(batch.column(c).to_pylist() for c in ("pivot", "low", "high", "ids", "labels", "asked", "xs"))):
            at = np.flatnonzero(np.frombuffer(asked, "?"))
            if not len(at):
                continue
            ids, labels, xs = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), space.numbers(xs)
            got = scan(space, [(pivot, low, high, ids, labels, xs)], ids[at], labels[at], xs[at], np.full((len(at), 1), -NONE), np.full((len(at), 1), NONE), True, k)
            n, worst = np.bincount(got[0], minlength=len(at)), np.full(len(at), NONE)
            np.minimum.at(worst, got[0], got[3])
            worst[n < k] = -NONE
            away = space.asked(xs[at])[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at]), pa.array(labels[at]), pa.array([x.astype("<i8").tobytes() for x in xs[at]]), pa.array(away.tolist()), pa.array((xs[at].astype(np.float64) ** 2).sum(axis=1)), pa.array([[w] for w in worst.tolist()]), pa.array([[NONE]] * len(at))],
                ["vec_id", "label", "x", "away", "norm", "cut", "top"],
            )


_ANCHORS = "vec_id long, label long, x binary, away array<double>, norm double, cut array<long>, top array<long>"


def _search(batches, space: Space, same: bool, k: int, most: int):
    """Rows sorted by block, group and kind: slabs (kind 0), then anchors (kind 1)."""
    only("negatives")
    now, slabs, waiting = None, [], []

    def answered():
        ids = np.array([w[0] for w in waiting], np.int64)
        wide = max(len(w[3]) for w in waiting)
        fill = lambda i, none: np.array([list(w[i]) + [none] * (wide - len(w[i])) for w in waiting], np.int64)
        got = scan(space, slabs, ids, np.array([w[1] for w in waiting], np.int64), space.numbers(b"".join(w[2] for w in waiting)), fill(3, NONE), fill(4, -NONE), same, k)
        return pa.RecordBatch.from_arrays([pa.array(ids[got[0]]), pa.array(got[1].astype(np.int32)), pa.array(got[2]), pa.array(got[3])], ["anchor_id", "target", "vec_id", "score"])

    for batch in batches:
        names = ("block", "grp", "kind", "pivot", "low", "high", "ids", "labels", "xs", "vec_id", "label", "cut", "top")
        for block, grp, kind, pivot, low, high, ids, labels, xs, vec_id, label, cut, top in zip(*(batch.column(c).to_pylist() for c in names)):
            if waiting and (now != (block, grp) or len(waiting) == most):
                yield answered()
                waiting = []
            if now != (block, grp):
                now, slabs = (block, grp), []
            if kind == 0:
                slabs.append((pivot, low, high, np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), space.numbers(xs)))
            else:
                waiting.append((vec_id, label, xs, cut, top))
    if waiting:
        yield answered()


def _found(index: DataFrame, anchors: DataFrame, space: Space, blocks: int, groups: int, same: bool, k: int) -> DataFrame:
    """anchor_id, target, rank, vec_id, score: the best ``k`` for each target of an anchor (cut and top, arrays)."""
    reach = index.groupBy("block", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    lowest = F.array_min("cut")
    asked = anchors.select("vec_id", "norm", lowest.alias("lowest"), F.posexplode("away").alias("pivot", "from"))
    gap = F.greatest(F.lit(0.0), F.greatest(F.col("low") - F.col("from"), F.col("from") - F.col("high")) - space.pad)
    met = (F.col("norm") + space.largest - gap * gap) / 2 + 1e-9 * (1 + space.largest) >= F.col("lowest")
    routes = asked.join(reach, "pivot").where(met).select("vec_id", "block").distinct()
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    names = ["block", "grp", "kind", "pivot", "low", "high", "ids", "labels", "xs", "vec_id", "label", "cut", "top"]
    no = lambda kind: F.lit(None).cast(kind)
    held = index.select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(0).alias("kind"), "pivot", "low", "high", "ids", "labels", "xs", no("long").alias("vec_id"), no("long").alias("label"), no("array<long>").alias("cut"), no("array<long>").alias("top"))
    sent = anchors.join(routes, "vec_id").select("block", group.alias("grp"), F.lit(1).alias("kind"), no("int").alias("pivot"), no("double").alias("low"), no("double").alias("high"), no("binary").alias("ids"), no("binary").alias("labels"), F.col("x").alias("xs"), "vec_id", "label", "cut", "top")
    tasks = min(TASKS, blocks * groups)
    task = F.pmod(F.col("block") * groups + F.col("grp"), F.lit(tasks)).cast("int")
    both = held.select(*names).unionByName(sent.select(*names)).repartitionById(tasks, task).sortWithinPartitions("block", "grp", "kind")
    got = both.mapInArrow(partial(_search, space=space, same=same, k=k, most=ASKED), "anchor_id long, target int, vec_id long, score long")
    best = Window.partitionBy("anchor_id", "target").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5, share: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are the rows that ``is_anchor`` (a condition
    on vec_id) picks. Positives: the best other rows of the same label; negatives of one: the best rows of other labels with
    at least ``share`` percent of its score, and no more than it."""
    spark = vectors.sparkSession
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = scaled(vectors, scale).withColumn("d", F.size("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    sizes = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("largest"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], kind)
    rows = rows.where(F.col("d") == sizes["d"])
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").collect()
    space = Space(np.array([p["v"] for p in picked], np.int64), float(sizes["largest"]), sizes["most"], sizes["n"])
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v", F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    keyed = one.withColumn("key", _key(F.col("v"), space)).select("key.pivot", "key.away", "vec_id", "label", "asked", "v")
    order = ["pivot", "away", "vec_id"]
    index = materialize(keyed.repartitionByRange(-(-sizes["n"] // BLOCK), *order).sortWithinPartitions(*order).mapInArrow(partial(_slabs, size=SLAB), _SLABS), "slabs")
    anchors = materialize(index.mapInArrow(partial(_seeds, space=space, k=positives), _ANCHORS), "anchors")
    blocks = (index.agg(F.max("block")).first()[0] or 0) + 1
    groups = -(-anchors.count() // PART)
    if not groups:
        return spark.createDataFrame([], kind)
    own = materialize(_found(index, anchors, space, blocks, groups, True, positives), "positives")
    # the least whole number that is the share of a score or more
    own = own.where("score >= 0").withColumn("floor", F.expr(f"(score div 100) * {share} + (score % 100 * {share} + 99) div 100"))
    lists = own.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "floor"))).alias("p"))
    asked = anchors.drop("cut", "top").join(lists, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "x", "away", "norm", F.col("p.floor").alias("cut"), F.col("p.score").alias("top"), "p")
    asked = materialize(asked, "targets")
    got = _found(index, asked.drop("p"), space, blocks, groups, False, negatives)
    told = asked.select(F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("target", "p"))
    return told.join(got, ["anchor_id", "target"]).select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"))
    return mine(rows, F.col("vec_id") % 100 == 0)


ORACLE = """WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5"""
