"""Sharding by size-tiered compaction (native).

Arrivals are appended as small immutable shards. Compaction merges runs of similarly sized shards, in order of arrival,
into files of a target size, and commits a manifest version. A manifest is a small table (shard, path, tier, arrivals,
documents, bytes), kept as changes: a version is a folder with the shards ``added`` and the paths ``gone`` since the one before,
or a checkpoint, which changes nothing and holds ``all``. A manifest is read from its last checkpoint and the changes after it. So
a commit writes rows for what it moves, however large the manifest is; a compaction ends with a checkpoint, and appends write one
after ``EVERY`` versions without. A version is written as a draft and renamed to its number by a rename that never replaces
anything (``rename_new``), so of two writers that prepare the same version one wins and the other gets an error and may try
again; readers see one whole version or the one before.

Files that a version names are never changed or moved. Inputs of a merge stay until ``vacuum`` takes away the versions
that name them, so a reader of version n outlives the commit of n + 1. ``vacuum`` keeps the last versions, with the checkpoint
that they are read from, and removes what none of them names: older manifests, merged inputs, and what jobs that died have
left, drafts and data alike.

The plan is made on the manifest alone, by windows over blocks of arrivals, so each window is bounded: shards of a block
that are in the same size tier (a factor of four) are added up in order of arrival and cut at the target. A second round
does the same with what came out small. Data are then moved once: each merged shard is a partition of its own that reads its
inputs and writes one file, with no shuffle, in waves of bounded size that commit one after another.

Defined results: rows are kept as they are, with all their columns, repeated rows too; null text counts 0 bytes; rows
with a null doc_id arrive in 1024 arrivals of their own, by a hash of their text; an empty table gives an empty manifest.
Texts are moved whole: a very long one makes its shard larger than the target, which then stays as it is. Ties in size don't
matter, as runs follow the order of arrival, and no two shards share that.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import delete, materialize, release, shared_dir

ARRIVAL = 256  # documents
TARGET = 64 << 20  # bytes of text
BASE = 64 << 10
BLOCK = 4096  # arrivals
WAVE = 256  # merged shards that a commit holds
EVERY = 64  # versions of appends from one checkpoint to the next
MANIFEST = "shard long, path string, tier int, first_arrival long, last_arrival long, n_docs long, n_bytes long"
COLUMNS = [c.split()[0] for c in MANIFEST.split(", ")]


def arrival_of(doc_id: Column, text: Column, size: int) -> Column:
    alone = -1 - F.pmod(F.xxhash64(text), F.lit(1024))
    return F.when(doc_id.isNull(), alone).otherwise(F.floor(doc_id / F.lit(size))).cast("long")


def tier_of(n_bytes: Column, base: int = BASE) -> Column:
    """0 below ``base`` bytes, then one more for each factor of four."""
    units = F.floor(n_bytes / F.lit(base)).cast("long")
    return F.when(units == 0, F.lit(0)).otherwise(F.floor((F.length(F.bin(units)) + 1) / 2)).cast("int")


def plan(shards: DataFrame, target: int = TARGET, rounds: int = 2) -> DataFrame:
    """shard, into: the merged shard that each shard goes to (itself if it stays).

    ``shards``: shard (the order of arrival), n_bytes. A merged shard is named by the first that it holds.
    """
    rows = shards.select("shard", F.col("shard").alias("into"), "n_bytes")
    for _ in range(rounds):
        now = rows.groupBy("into").agg(F.sum("n_bytes").alias("b"))
        near = Window.partitionBy(F.floor(F.col("into") / BLOCK), tier_of(F.col("b"))).orderBy("into").rowsBetween(Window.unboundedPreceding, -1)
        now = now.withColumn("small", F.col("b") * 2 < target)
        now = now.withColumn("run", F.floor(F.coalesce(F.sum("b").over(near), F.lit(0)) / F.lit(target)))
        group = Window.partitionBy(F.floor(F.col("into") / BLOCK), tier_of(F.col("b")), "run", "small")
        now = now.withColumn("next", F.when(F.col("small"), F.min("into").over(group)).otherwise(F.col("into")))
        rows = rows.join(now.select(F.col("into").alias("i"), "next"), F.col("into") == F.col("i")).select("shard", F.col("next").alias("into"), "n_bytes")
    return rows


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename the folder ``source``, which isn't empty, to ``target``; False, and nothing done, if that is there.

    Atomic: the store itself refuses to replace a folder that has something in it. Of local and mounted file systems the
    system call is asked, as Hadoop's class for them looks first and renames then.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    a, b, conf = path(source), path(target), spark.sparkContext._jsc.hadoopConfiguration()
    fs = b.getFileSystem(conf)
    fs.mkdirs(b.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            os.rename(a.toUri().getPath(), b.toUri().getPath())
        except OSError:
            if os.path.exists(b.toUri().getPath()):
                return False
            raise
        return True
    try:
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(a), fs.makeQualified(b), none)
    except Exception:  # noqa: BLE001  each store has its own
        if fs.exists(b):
            return False
        raise
    return True


@contextmanager
def _own_partitions(spark: SparkSession) -> Iterator[None]:
    """Unions keep the partitions of their sides. Spark would put sides of one partition each into one."""
    name = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _key(names) -> str:
    """A name for the column of folders that none of ``names`` has."""
    taken, key = {n.lower() for n in names}, "shard"
    while key in taken:
        key += "_"
    return key


class ShardStore:
    """Shards under ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _in(self, folder: str) -> list:
        where = self._path(f"{self.root}/{folder}")
        return list(self._fs.listStatus(where)) if self._fs.exists(where) else []

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()[1:]) for s in self._in("manifests") if s.getPath().getName().startswith("v"))

    def _at(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:08d}"

    def since(self, version: int) -> tuple[int, list[int]]:
        """The last checkpoint up to ``version`` (0: none), and the versions after it up to ``version``."""
        later = [v for v in self.versions() if v <= version]
        base = next((v for v in reversed(later) if self._fs.exists(self._path(f"{self._at(v)}/all"))), 0)
        return base, [v for v in later if v > base]

    def manifest(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known and version is None:
            return self.spark.createDataFrame([], MANIFEST)
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"there is no version {version}")
        base, later = self.since(version)
        read = lambda name, of, schema: self.spark.read.schema(schema).parquet(*[f"{self._at(v)}/{name}" for v in of])
        sides = [read("all", [base], MANIFEST)] if base else []
        if not later:
            return sides[0]
        rows = reduce(DataFrame.union, [*sides, read("added", later, MANIFEST)])
        # a path is added once and goes once, so the order of the changes doesn't matter
        return rows.join(read("gone", later, "path string"), "path", "left_anti").select(COLUMNS)

    def draft(self, added: DataFrame, gone: DataFrame | None = None) -> str:
        """Write a change that isn't a version yet: shards that are new, and the paths of those that are no more."""
        path = f"{self.root}/drafts/{uuid.uuid4().hex}"
        gone = self.spark.createDataFrame([], "path string") if gone is None else gone
        added.select(COLUMNS).write.parquet(f"{path}/added")
        gone.select("path").coalesce(1).write.parquet(f"{path}/gone")
        return path

    def publish(self, draft: str, after: int) -> int:
        """Make a draft the version that follows ``after`` (0: none)."""
        if not rename_new(self.spark, draft, self._at(after + 1)):
            delete(self.spark, draft)
            raise RuntimeError(f"version {after + 1} was committed by another writer")
        return after + 1

    def commit(self, added: DataFrame, after: int, gone: DataFrame | None = None) -> int:
        return self.publish(self.draft(added, gone), after)

    def checkpoint(self, after: int) -> int:
        """Write the manifest of ``after`` whole, as the next version. Nothing is done if another writer was first: a checkpoint
        changes nothing, and a later one does as well."""
        draft = f"{self.root}/drafts/{uuid.uuid4().hex}"
        self.manifest(after).repartition("shard").write.parquet(f"{draft}/all")
        try:
            return self.publish(draft, after)
        except RuntimeError:
            return after

    def append(self, rows: DataFrame, arrival: Column, n_bytes: Column) -> int:
        """Write a shard for each arrival and commit them. Arrivals are new: none has the number of a shard that is there."""
        before = (self.versions() or [0])[-1]
        folder, key = f"data/{uuid.uuid4().hex}", _key(rows.columns)
        rows.withColumn(key, arrival).repartition(F.col(key)).write.partitionBy(key).parquet(f"{self.root}/{folder}")
        sizes = rows.groupBy(arrival.alias("shard")).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(n_bytes), F.lit(0)).cast("long").alias("n_bytes"))
        new = sizes.select("shard", F.concat(F.lit(f"{folder}/{key}="), F.col("shard")).alias("path"), tier_of(F.col("n_bytes")).alias("tier"), F.col("shard").alias("first_arrival"), F.col("shard").alias("last_arrival"), "n_docs", "n_bytes")
        if before and self.manifest(before).join(new.select("shard"), "shard", "left_semi").limit(1).count():
            raise ValueError("an arrival has the number of a shard that is there")
        now = self.commit(new, before)
        return self.checkpoint(now) if len(self.since(now)[1]) >= EVERY else now

    def read(self, paths: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def _folder(self, folder: str, shards: list[int] | None, schema: StructType, key: str) -> DataFrame:
        """The rows of a folder, of ``shards`` alone if given, with the shard's number as the column ``key``."""
        where = f"{self.root}/{folder}"
        paths = [where] if shards is None else [f"{where}/{key}={n}" for n in shards]
        return self.spark.read.schema(StructType([*schema.fields, *StructType().add(key, LongType()).fields])).option("basePath", where).parquet(*paths)

    def compact(self, schema: StructType, target: int = TARGET, wave: int = WAVE) -> int:
        """Merge as planned; ``schema``: of the rows. Returns the version that is current afterwards."""
        version = (self.versions() or [0])[-1]
        shards = self.manifest()
        moves = shards.join(plan(shards, target).select("shard", "into"), "shard")
        merged = moves.groupBy("into").agg(F.count(F.lit(1)).alias("parts"), F.array_sort(F.collect_list(F.struct("shard", "path"))).alias("from"), F.min("first_arrival").alias("first_arrival"), F.max("last_arrival").alias("last_arrival"), F.sum("n_docs").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))
        merged = merged.where("parts > 1").select("into", "from.path", "first_arrival", "last_arrival", "n_docs", "n_bytes")
        merged = materialize(merged, "merges")
        # what is on the driver at a time is a wave's part of the plan: names of folders and sums
        pending, done = [], version
        for row in merged.orderBy("into").toLocalIterator():
            pending.append(row)
            if len(pending) == wave:
                done, pending = self._wave(pending, schema, done), []
        if pending:
            done = self._wave(pending, schema, done)
        return self.checkpoint(done) if done > version else done

    def merged(self, rows: list, schema: StructType) -> DataFrame:
        """The data of a wave: a partition for each of ``rows`` (into, path: of its inputs), under ``_own_partitions``."""
        key = _key(schema.names)
        asked: dict[str, list[int]] = {}
        for row in rows:
            for p in row["path"]:
                folder, _, n = p.rpartition("/")
                asked.setdefault(folder, []).append(int(n.split("=")[1]))
        # each folder is listed once; what a merged shard reads of it is pruned
        known = {folder: self._folder(folder, shards, schema, key) for folder, shards in asked.items()}

        def part(row) -> DataFrame:
            mine: dict[str, list[int]] = {}
            for p in row["path"]:
                folder, _, n = p.rpartition("/")
                mine.setdefault(folder, []).append(int(n.split("=")[1]))
            sides = [known[folder].where(F.col(key).isin(shards)) for folder, shards in mine.items()]
            return reduce(DataFrame.union, sides).coalesce(1).withColumn(key, F.lit(row["into"]))

        parts = [part(row) for row in rows]
        while len(parts) > 1:  # a flat tree of unions: the plan's depth grows with the logarithm
            parts = [parts[i].union(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def _wave(self, rows: list, schema: StructType, version: int) -> int:
        """Write the merged shards of ``rows`` and commit them: a change of a row for each of them and for each of their inputs."""
        folder, key = f"data/{uuid.uuid4().hex}", _key(schema.names)
        with _own_partitions(self.spark):
            self.merged(rows, schema).write.partitionBy(key).parquet(f"{self.root}/{folder}")
        new = [(r["into"], f"{folder}/{key}={r['into']}", None, r["first_arrival"], r["last_arrival"], r["n_docs"], r["n_bytes"]) for r in rows]
        added = self.spark.createDataFrame(new, MANIFEST).withColumn("tier", tier_of(F.col("n_bytes"))).coalesce(1)
        return self.commit(added, version, self.spark.createDataFrame([(p,) for r in rows for p in r["path"]], "path string"))

    def vacuum(self, keep: int = 1, age: float = 86_400) -> None:
        """Keep the last ``keep`` versions and what they name. What is younger than ``age`` seconds stays if it may belong to a
        writer that has yet to commit: drafts and data that no version names."""
        young = (time.time() - age) * 1000
        old = lambda s: s.getModificationTime() <= young
        for s in self._in("drafts"):
            if old(s):
                delete(self.spark, s.getPath().toString())
        kept = self.versions()[-keep:]
        if kept:
            named = reduce(DataFrame.union, [self.manifest(v) for v in kept]).select("path").distinct()
            named = named.select(F.substring_index("path", "/", 2).alias("folder"), F.substring_index("path", "/", -1).alias("name"))
            used = {r["folder"]: r["n"] for r in named.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}  # one for each commit
        else:
            used = {}
        for s in self._in("data"):
            folder = f"data/{s.getPath().getName()}"
            if folder not in used:
                if old(s):
                    delete(self.spark, s.getPath().toString())
                continue
            there = [x.getPath() for x in self._in(folder) if x.isDirectory()]
            if len(there) > used[folder]:  # a committed folder, part of which was merged into others
                names = {r["name"] for r in named.where(F.col("folder") == folder).toLocalIterator()}
                for path in there:
                    if path.getName() not in names:
                        delete(self.spark, path.toString())
        base, later = self.since(kept[0]) if kept else (0, [])
        needed = base or min(later, default=0)
        for v in self.versions():
            if v < needed:
                delete(self.spark, self._at(v))


def shard(docs: DataFrame, root: str, arrival: int = ARRIVAL, target: int = TARGET, wave: int = WAVE) -> tuple[ShardStore, int]:
    """Append the rows of ``docs`` by arrival, compact, and give the store and the version committed last."""
    store = ShardStore(docs.sparkSession, root)
    store.append(docs, arrival_of(docs["doc_id"], docs["text"], arrival), F.octet_length(docs["text"]).cast("long"))
    release(docs.sparkSession)
    return store, store.compact(docs.schema, target, wave)


def placed(store: ShardStore, schema: StructType) -> DataFrame:
    """doc_id, doc_bytes and its shard's columns of the manifest, as read from the files that the manifest names."""
    known = store.manifest()
    at = known.select(F.substring_index("path", "/", 2).alias("folder")).distinct()
    folders = [f"{store.root}/{r['folder']}" for r in at.toLocalIterator()]  # one for each commit
    if not folders:
        return known.drop("path").select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("doc_bytes"), "*").where("false")
    # one scan, whatever the number of commits; a row's shard is the folder that its file lies in
    files = store.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*folders)
    rows = files.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("doc_bytes"), F.substring_index(F.substring_index("_metadata.file_path", "/", -4), "/", 3).alias("path"))
    return rows.join(known, "path").drop("path")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store, _ = shard(docs, f"{shared_dir(spark)}/bibspark/shards-{uuid.uuid4().hex}")
    store.vacuum(age=0)  # no one else writes to this store
    return placed(store, docs.schema)


_SQL = r"""
WITH a AS (SELECT CAST(floor(doc_id / {arrival}) AS BIGINT) AS shard, CAST(count(*) AS BIGINT) AS n_docs, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS n_bytes FROM documents GROUP BY 1),
t1 AS (SELECT *, CASE WHEN n_bytes < 65536 THEN 0 ELSE (length(bin(n_bytes // 65536)) + 1) // 2 END AS tier, n_bytes * 2 < {target} AS small, CAST(floor(shard / 4096) AS BIGINT) AS block FROM a),
r1 AS (SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY block, tier ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {target} AS run FROM t1),
i1 AS (SELECT shard, n_docs, n_bytes, CASE WHEN small THEN min(shard) OVER (PARTITION BY block, tier, run, small) ELSE shard END AS into1 FROM r1),
b AS (SELECT into1, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM i1 GROUP BY into1),
t2 AS (SELECT *, CASE WHEN n_bytes < 65536 THEN 0 ELSE (length(bin(n_bytes // 65536)) + 1) // 2 END AS tier, n_bytes * 2 < {target} AS small, CAST(floor(into1 / 4096) AS BIGINT) AS block FROM b),
r2 AS (SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY block, tier ORDER BY into1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {target} AS run FROM t2),
i2 AS (SELECT into1, CASE WHEN small THEN min(into1) OVER (PARTITION BY block, tier, run, small) ELSE into1 END AS into2 FROM r2),
m AS (SELECT i1.shard, i2.into2 AS dest, i1.n_docs, i1.n_bytes FROM i1 JOIN i2 USING (into1)),
s AS (SELECT dest, min(shard) AS first_arrival, max(shard) AS last_arrival, CAST(sum(n_docs) AS BIGINT) AS n_docs, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM m GROUP BY dest)
SELECT d.doc_id, CAST(coalesce(strlen(d.text), 0) AS BIGINT) AS doc_bytes, s.dest AS shard,
    CAST(CASE WHEN s.n_bytes < 65536 THEN 0 ELSE (length(bin(s.n_bytes // 65536)) + 1) // 2 END AS INTEGER) AS tier, s.first_arrival, s.last_arrival, s.n_docs, s.n_bytes
FROM documents d JOIN m ON m.shard = CAST(floor(d.doc_id / {arrival}) AS BIGINT) JOIN s ON s.dest = m.dest
"""


def oracle(arrival: int = ARRIVAL, target: int = TARGET) -> str:
    return _SQL.format(arrival=arrival, target=target)


ORACLE = oracle()
