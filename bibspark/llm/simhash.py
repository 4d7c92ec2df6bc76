"""Near-duplicates by SimHash with multi-index hashing.

Fingerprints: the words of the text (A-Z lower-cased) make shingles of ``size`` words; bit i of the fingerprint is 1 if
it is set in over half of the shingles' XXH64 values. Texts are taken whole, in blocks of shingles, so a very long text
needs no more memory than its words.

Links: two fingerprints link at ``radius`` (3) or fewer differing bits. They are cut into two segments of 32 bits. If
two differ in at most 3 bits, they differ in at most one bit of some segment, so each fingerprint looks up the ball of
radius one around its own segments: the segment itself and its flips. Of two segments that differ in one bit, one has a
0 there, so it is enough to flip zeros. Whatever is found is verified over all 64 bits. Segments of 32 bits keep chance
matches rare up to billions of fingerprints.

Only distinct fingerprints take part; copies are attached by the fingerprint. A table entry that many fingerprints meet
(a large group of near copies) is cut by a hash into chunks of bounded size; every pair of chunks is verified in a task
of its own by blocks of exclusive-or and bit counts, and gives the edges of a spanning forest, never all its pairs.
Components are then found by rounds of joins. Nothing is dropped or capped. No join is broadcast, so the driver holds none of it.

Defined results: null text is a text without words; its fingerprint is zero and links like any other. An empty table
gives no rows. Rows that repeat a doc_id give a row each. Null doc_ids get a row, and a component if a row with an id is
within reach (else null). Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialize, only, shuffled
from .components import components

BLOCK = 1 << 16
CHUNK = 4096
SEED = 42


def fingerprint(text: str | None, size: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hash_of, ones, n = partial(xxhash.xxh64_intdigest, seed=SEED), np.zeros(64, np.int64), max(1, len(words) - size + 1)
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]
        h = np.fromiter(map(hash_of, shingles), np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches, size):
    only("simhash")
    for batch in batches:
        got = np.fromiter((fingerprint(x.as_py(), size) for x in batch.column("text")), np.uint64, batch.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row. A doc_id that is a struct stays one, others become long."""
    key = F.col("doc_id") if isinstance(docs.schema["doc_id"].dataType, StructType) else F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_fingerprints, size=size), StructType([rows.schema["doc_id"], StructField("fp", LongType())]))


def _balls(batches):
    """For each fingerprint the table entries that it is in (own) and that it looks up (the flips of zeros)."""
    flips = np.uint64(1) << np.arange(32, dtype=np.uint64)
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 8192):
            x = fp[at : at + 8192]
            keys, owners, own = [], [], []
            for high in (0, 1):
                seg = (x >> np.uint64(32)) if high else (x & np.uint64(0xFFFFFFFF))
                ball = seg[:, None] | flips
                row, bit = np.nonzero(ball != seg[:, None])
                for part, who, flag in ((seg, x, 1), (ball[row, bit], x[row], 0)):
                    # a mixed key: the segment's number and value
                    keys.append((part << np.uint64(1) | np.uint64(high)).view(np.int64))
                    owners.append(who.view(np.int64))
                    own.append(np.full(len(who), flag, np.int8))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(own))], ["entry", "fp", "own"])


def _forest(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what links between two lists, at most one less than there are fingerprints."""
    nodes = np.unique(np.concatenate([left, right]))
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out, ri = [], np.searchsorted(nodes, right)
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        a, b = np.nonzero(np.bitwise_count(rows[:, None] ^ right[None, :]) <= radius)
        for i, j in zip(np.searchsorted(nodes, rows[a]).tolist(), ri[b].tolist()):
            p, q = root(i), root(j)
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _verify(batches, radius):
    for batch in batches:
        a, b = [], []
        for mine, met in zip(batch.column("members"), batch.column("lookups")):
            x = np.asarray(mine.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            y = np.asarray(met.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            if len(x) and len(y):
                for i, j in _forest(x, y, radius):
                    a.append(i)
                    b.append(j)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], ["a", "b"])


def links(prints: DataFrame, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """a, b: edges between distinct fingerprints (column fp) that give the components of all links."""
    if radius > 3:
        raise ValueError("two segments and balls of radius one find up to 3 differing bits")
    rows = prints.mapInArrow(_balls, "entry long, fp long, own byte")
    sums = rows.groupBy("entry").agg(F.sum("own").alias("n_own"), F.count(F.lit(1)).alias("n"))
    sums = sums.where((F.col("n_own") > 0) & (F.col("n") > 1))
    # the entries that something meets, with the number of chunks that members and lookups are cut into
    parts = lambda c: F.ceil(c / F.lit(chunk)).cast("int")
    sums = sums.select(F.col("entry").alias("e"), parts(F.col("n_own")).alias("k_own"), parts(F.col("n")).alias("k_all"))
    met = rows.join(shuffled(sums), F.col("entry") == F.col("e")).withColumn("h", F.xxhash64("fp"))
    mine = F.pmod("h", F.col("k_own")).cast("int")
    other = F.pmod("h", F.col("k_all")).cast("int")
    # a member goes to its chunk of members, against each chunk of lookups, and is also a lookup; lookups meet all chunks
    as_member = met.where("own = 1").select("entry", mine.alias("p"), F.explode(F.sequence(F.lit(0), F.col("k_all") - 1)).alias("q"), F.col("fp").alias("member"), F.lit(None).cast("long").alias("lookup"))
    as_lookup = met.select("entry", F.explode(F.sequence(F.lit(0), F.col("k_own") - 1)).alias("p"), other.alias("q"), F.lit(None).cast("long").alias("member"), F.col("fp").alias("lookup"))
    pairs = as_member.unionByName(as_lookup).groupBy("entry", "p", "q").agg(F.collect_list("member").alias("members"), F.collect_list("lookup").alias("lookups"))
    pairs = pairs.where((F.size("members") > 0) & (F.size("lookups") > 0)).select("members", "lookups")
    return pairs.mapInArrow(partial(_verify, radius=radius), "a long, b long").distinct()


def classes(prints: DataFrame, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """fp, component_id for each distinct fingerprint of ``prints`` (doc_id, fp)."""
    first = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    edges = links(first.select("fp"), radius, chunk)
    # Fingerprints are the nodes of the graph; the component of a node is named by a fingerprint first.
    found = components(edges)
    groups = first.join(shuffled(found), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("class"))
    least = groups.groupBy("class").agg(F.min("first").alias("component_id"))
    return groups.join(shuffled(least), "class").select("fp", "component_id")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id within reach) for each row of ``docs``."""
    prints = materialize(fingerprints(docs, size), "simhash")
    named = classes(prints, radius, chunk).withColumnRenamed("fp", "f")
    return prints.join(shuffled(named), F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
