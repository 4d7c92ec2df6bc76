"""Nearest neighbours by collision-counting hashing with query-centred windows.

Each of ``M`` random projections is a table of its own: the projections of all directions, sorted. A query uses the
``TABLES`` arrays in which its own projection lies furthest out: there its window holds few vectors, and those near it are
many among them. In each of these a window around the query's projection is expanded round by round (virtual rehashing:
a round's window holds the one before, so only what is new at both ends is read from the sorted array), and every vector
met gets a collision. A vector with as many collisions as one at the round's cosine has (but for one in six of those) is
verified by its inner product. No array is read beyond its windows.

A round stands for a cosine; they fall from ``FIRST`` by ``SHRINK``. A vector of norm v has an inner product of v times the
cosine with a unit query, so once the k-th best is v times the round's cosine or more, vectors up to that norm are done: those
above the cosine have been verified, those below can't reach. Vectors stand in the order of their norms, longest first, so
what is open is the front of them. Only directions are hashed; uneven norms, and single vectors of a very large norm, leave
windows and counts as they are. When few vectors are open, they are verified one and all. The last round's cosine is chosen
so that it meets the k-th best. The search works alike at any size: the share that is verified falls as there are more
vectors, since the k-th neighbour comes nearer. Where rounds end with less than k found, the rest is verified: a query always
gets k neighbours if there are k.

The rows are cut into blocks of about ``BLOCK`` vectors by a hash of vec_id (exact copies are spread like any others), and
queries into parts of ``QUERIES``. A block's tables are built in the task that searches it and the parts of the query set
stream past them; every row is indexed, nothing is sampled, and no window or bucket has a cap. What a task holds is one block of
vectors with its tables, and one part of the queries. Each query's best k of each block meet in one small list.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null
vec_id or with another number of components than most; of repeated rows with one vec_id the first by components counts;
equal scores go by smaller vec_id; fewer than k candidates give all; an empty table gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

from functools import partial
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, only

BLOCK, SLAB, QUERIES = 49152, 1024, 256
M, TABLES = 320, 40
FIRST, SHRINK, LAST = 0.9, 0.85, 0.02  # cosines of the rounds
BOUND = 1.0  # deviations: a sixth of the vectors at a round's cosine has fewer collisions than are asked for
SPREAD = 12  # tasks that a small number of blocks is spread over
SEED = 20_240_601


def _phi(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * (1 + erf(v / sqrt(2))) for v in x.tolist()])


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision; the sum's order depends on nothing but the number of components."""
    return (x * q).sum(axis=1)


class Tables:
    """The sorted arrays of a block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, m: int = M) -> None:
        most = np.abs(x).max(axis=1)
        unit = x / most[:, None]
        length = np.sqrt((unit * unit).sum(axis=1))
        norms = most * length
        o = np.lexsort((ids, -norms))
        self.ids, self.x, self.norms = ids[o], x[o], norms[o]
        unit = (unit / length[:, None])[o].astype(np.float32)
        self.by_id = np.argsort(self.ids, kind="stable")
        n, d = x.shape
        self.m = m
        self.a = np.random.default_rng(SEED).standard_normal((d, m)).astype(np.float32)
        self.sorted = np.empty((m, n), np.float32)
        self.order = np.empty((m, n), np.uint16 if n <= 1 << 16 else np.int32)
        for j in range(m):
            p = unit @ self.a[:, j]
            o = np.argsort(p, kind="stable")
            self.sorted[j], self.order[j] = p[o], o
        self.searched = self.verified = 0  # what searches cost

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k but ``own``, best first."""
        n = len(self.ids)
        unit = q / np.abs(q).max()
        size = np.abs(q).max() * sqrt(float((unit * unit).sum()))
        unit = unit / sqrt(float((unit * unit).sum()))
        done = np.zeros(n, bool)
        where = np.searchsorted(self.ids, own, sorter=self.by_id)
        if where < n and self.ids[self.by_id[where]] == own:
            done[self.by_id[where]] = True
        best, scores = np.zeros(0, np.int64), np.zeros(0)

        def verify(found: np.ndarray) -> None:
            nonlocal best, scores
            done[found] = True
            self.verified += len(found)
            both, s = np.concatenate([best, found]), np.concatenate([scores, exact(self.x[found], q)])
            if len(both) > 4 * k:
                few = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                both, s = both[few], s[few]
            o = np.lexsort((self.ids[both], -s))[:k]
            best, scores = both[o], s[o]

        at = unit.astype(np.float32) @ self.a
        tables = np.argsort(-np.abs(at), kind="stable")[: min(TABLES, self.m)]
        t = at[tables].astype(np.float64)
        far = np.abs(t)
        rows, count = tables.tolist(), np.zeros(n, np.int64)
        low = high = None

        def ends(cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Where the windows of rounds begin and end in each array. The near end is where the projections of vectors at the
            round's cosine have their mean."""
            half = far[:, None] * (1 - cosines)
            edge = np.concatenate([t[:, None] - half, t[:, None] + half], axis=1).astype(np.float32)
            got = np.stack([np.searchsorted(self.sorted[j], e) for j, e in zip(rows, edge)])
            return got[:, : len(cosines)].T.copy(), got[:, len(cosines) :].T.copy()

        steps = FIRST * SHRINK ** np.arange(int(np.log(LAST / FIRST) / np.log(SHRINK)) + 1)
        known = dict(zip(steps.tolist(), zip(*ends(steps))))
        cosine = float(steps[0])
        while True:
            begin, end = known[cosine] if cosine in known else (e[0] for e in ends(np.array([cosine])))
            if low is None:
                low = high = begin
            end = np.maximum(end, begin)
            met = [self.order[j, a:b] for j, a, b in zip(rows, begin.tolist(), low.tolist()) if a < b]
            met += [self.order[j, a:b] for j, a, b in zip(rows, high.tolist(), end.tolist()) if a < b]
            if met:
                count += np.bincount(np.concatenate(met), minlength=n)
            low, high = np.minimum(low, begin), np.maximum(high, end)
            spread = sqrt(1 - cosine * cosine)
            p = float((0.5 - _phi(-2 * far * (1 - cosine) / spread)).mean())
            need = max(1, int(len(rows) * p - BOUND * sqrt(len(rows) * p * (1 - p))))
            reach = scores[-1] / size if len(best) == k else -np.inf
            open_ = n if reach <= 0 else int(np.searchsorted(-self.norms, -reach / min(1.0, cosine / SHRINK), "left"))
            hit = count[:open_] >= need
            hit &= ~done[:open_]
            verify(np.flatnonzero(hit))
            if len(best) == k:
                reach = scores[-1] / size
                if reach > 0:
                    open_ = int(np.searchsorted(-self.norms, -reach / cosine, "left"))
                    rest = np.flatnonzero(~done[:open_])
                    if len(rest) <= n >> 6:
                        verify(rest)
                        break
                    # no further than where the longest vector that is open ends
                    nearer = reach / self.norms[rest[0]] * (1 - 1e-9)
                    later = steps[steps < cosine]
                    cosine = max(float(later[0]) if len(later) else 0.0, nearer)
                    if cosine < LAST:
                        verify(rest)
                        break
                    continue
            later = steps[steps < cosine]
            if not len(later):
                verify(np.flatnonzero(~done))
                break
            cosine = float(later[0])
        self.searched += 1
        return self.ids[best], scores


def _slabs(batches, per_block: int):
    """Rows of up to SLAB vectors of one cell, packed; a partition's rows are sorted by cell, of which a block has ``per_block``."""
    now, ids, xs, n = None, [], [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now // per_block], pa.int64()), pa.array([np.concatenate(ids).astype("<i8").tobytes()]), pa.array([np.concatenate(xs).astype("<f8").tobytes()])], ["block", "ids", "xs"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cell, i = batch.column("cell").to_numpy(), batch.column("vec_id").to_numpy()
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(i), -1)
        for b in dict.fromkeys(cell.tolist()):
            mine = np.flatnonzero(cell == b)
            for at in range(0, len(mine), SLAB):
                if now is not None and (b != now or n >= SLAB):
                    yield out()
                    ids, xs, n = [], [], 0
                now = b
                part = mine[at : at + SLAB]
                ids.append(i[part])
                xs.append(x[part])
                n += len(part)
    if now is not None:
        yield out()


def _search(batches, k: int, d: int, m: int):
    """Rows sorted by block, group and kind: the block's vectors (kind 0), then the queries (kind 1)."""
    only("ann")
    now, held, tables = None, [], None
    unpack = lambda ids, xs: (np.frombuffer(ids, "<i8"), np.frombuffer(xs, "<f8").reshape(-1, d))
    for batch in batches:
        for block, group, kind, ids, xs in zip(*(batch.column(c).to_pylist() for c in ("block", "grp", "kind", "ids", "xs"))):
            if now != (block, group):
                now, held, tables = (block, group), [], None
            if kind == 0:
                held.append(unpack(ids, xs))
                continue
            if not held and tables is None:
                continue  # an empty block
            if tables is None:
                tables, held = Tables(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), m), []
            got = [(q, *tables.search(v, q, k)) for q, v in zip(*(a.tolist() if a.ndim == 1 else a for a in unpack(ids, xs)))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(i), q, np.int64) for q, i, _ in got])), pa.array(np.concatenate([i for _, i, _ in got]).astype(np.int64)), pa.array(np.concatenate([s for *_, s in got]))], ["query_id", "vec_id", "score"])


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, v (array of double) of the vectors that take part, and the number of components."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0)).withColumn("d", F.size("v"))
    sizes = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return rows.select("vec_id", "v"), 0
    return rows.where(F.col("d") == sizes["d"]).groupBy("vec_id").agg(F.min("v").alias("v")), sizes["d"]


def nearest(vectors: DataFrame, is_query, k: int = 20, m: int = M, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of ``vectors`` that ``is_query`` (a condition on
    vec_id) picks, by largest inner product."""
    spark = vectors.sparkSession
    rows, d = usable(vectors)
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = materialize(rows, "vectors")
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks, parts = -(-n // block), max(1, -(-asked // QUERIES))
    groups = min(parts, -(-SPREAD // blocks))

    def packed(x: DataFrame, count: int, size: int, seed: int) -> DataFrame:
        """A block is packed by several tasks: it is dealt out in cells of about SLAB rows."""
        cells = max(1, -(-size // (count * SLAB)))
        h = F.xxhash64(F.lit(seed), "vec_id")
        cell = F.pmod(h, F.lit(count)) * cells + F.pmod(F.xxhash64(F.lit(-seed), "vec_id"), F.lit(cells))
        x = x.withColumn("cell", cell.cast("long"))
        return x.repartition(F.col("cell")).sortWithinPartitions("cell", "vec_id").mapInArrow(partial(_slabs, per_block=cells), "block long, ids binary, xs binary")

    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    base = packed(rows, blocks, n, 1).select("block", every(groups).alias("grp"), F.lit(0).alias("kind"), "ids", "xs")
    queries = packed(rows.where(is_query), parts, asked, 2).select(every(blocks).alias("b"), F.pmod("block", F.lit(groups)).alias("grp"), F.lit(1).alias("kind"), "ids", "xs").withColumnRenamed("b", "block")
    # a task for each block and group, and no two in one
    task = (F.col("block") * groups + F.col("grp")).cast("int")
    both = base.unionByName(queries).repartitionById(blocks * groups, task).sortWithinPartitions("block", "grp", "kind")
    got = both.mapInArrow(partial(_search, k=k, d=d, m=m), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    got = got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return got.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
