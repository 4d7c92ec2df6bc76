"""Ranked lexical search of a document table for each item of a list, exact.

A document's score for an item is the sum of its impacts over the item's terms: w * ((10^9 tf) div (1000 tf + 8 m)), where m grows
with the document's number of terms. The search is a join whose thresholds are known before it:

1. *Index.* A row for each document: its number of terms, and how often it has each term that some item has.
2. *Seeds.* Of each term the ``k`` largest impacts are stored, with their documents. The kth of a term is a score that k documents
   reach by that term alone, so the largest of its terms' bounds an item's kth score from below. The documents stored with
   its terms, at most k for each, are scored exactly; the kth best of these bounds it more closely.
3. *Pruning.* An item's terms are put in order of their largest impacts. Where the sum of these from some term on is below the
   bound, no document that has only terms from there on can be among the best: they generate no candidates.
4. *Candidates.* Documents that have one of the terms left, if what they get from these and the most that the pruned ones can add
   reach the bound.
5. *Rescoring.* Candidates are scored over all terms, and the best k stay.

Bounds are of whole numbers and exclude only what is strictly below them, so ties are decided as if all had been scored.

What workers hold of the items are their distinct terms, ``VOCABULARY`` at a time: with more, the documents are read once for each
part of them, and the index has a row for each document and part. Everything else is joined. A term that most documents have
is ranked by tasks, each of which sends on its best k alone, and is counted by partial sums.

Defined results: null and empty texts have no terms, and documents without terms count nowhere. Rows with one item_id are one
item with the terms of all of them; null is an item_id too. Every row of the documents is a document, also one that shares its
doc_id or has none: equal scores go by doc_id (nulls last), then by the table's order. Items of which no term is found give no
rows, nor do empty tables. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, only

#: What separates terms: all of ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VOCABULARY = 1 << 18
INDEX = "at long, doc_id long, n long, first boolean, ids array<long>, tfs array<long>"


def terms(text: Column) -> Column:
    """The terms of a text column, in order."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda t: t != "")


def terms_of(text: str | None) -> list[bytes]:
    """The same in Python; bytes are lowered in A-Z only."""
    return (text or "").encode().lower().translate(_TABLE).split()


def _counted(batches, vocabulary: dict[bytes, int], first: bool):
    only("lexical")
    get = vocabulary.get
    for batch in batches:
        rows = []
        for at, doc_id, text in zip(*(batch.column(c) for c in ("at", "doc_id", "text"))):
            found = terms_of(text.as_py())
            if found:
                tf = Counter(map(get, found))
                tf.pop(None, None)
                if tf or first:
                    rows.append((at.as_py(), doc_id.as_py(), len(found), first, list(tf), list(tf.values())))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["at", "doc_id", "n", "first", "ids", "tfs"])


def index(docs: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """at (a number for each row), doc_id, n, first, ids, tfs: a row for each document that has terms, and for each part of
    ``vocabulary`` (term, id) of ``size`` terms; the first part's rows are there even if they have none of its terms."""
    # a number for each row of the scan, which reads the same files in the same order if a task is repeated
    rows = docs.select(F.monotonically_increasing_id().alias("at"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts, out = max(1, -(-size // VOCABULARY)), None
    for p in range(parts):
        known = {r["term"].encode(): r["id"] for r in vocabulary.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == p).collect()}
        made = rows.mapInArrow(partial(_counted, vocabulary=known, first=p == 0), INDEX)
        out = made if out is None else out.unionByName(made)
    return materialize(out, "lexical-index")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents (doc_id, text) with the highest scores above 0 of each item (item_id, text)."""
    spark = docs.sparkSession
    asked = items.select("item_id", F.explode(terms(F.col("text"))).alias("term")).distinct()
    vocabulary = materialize(asked.select("term").distinct().withColumn("id", F.monotonically_increasing_id()), "lexical-terms")
    size = vocabulary.count()
    held = index(docs, vocabulary, size)
    n, total = held.where("first").agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n or not size:
        item = next(f.dataType for f in items.schema if f.name == "item_id")
        return spark.createDataFrame([], "rank int, doc_id long, score long").select(F.lit(None).cast(item).alias("item_id"), "rank", "doc_id", "score")
    postings = held.select("at", "doc_id", "n", F.explode(F.arrays_zip("ids", "tfs")).alias("t")).select("at", "doc_id", "n", F.col("t.ids").alias("id"), F.col("t.tfs").alias("tf"))
    part = F.expr(f"(1000000000 * tf) div (1000 * tf + 8 * (10 + (90 * n * {n}) div {total}))")
    postings = postings.select("at", "doc_id", "id", part.alias("part"))

    # of each term: how many have it, its weight, the k largest impacts
    best = Window.partitionBy("id").orderBy(F.desc("part"), "at")
    seeds = materialize(postings.select("id", "at", "part").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "lexical-seeds")
    weight = F.floor(1000 * F.ln(F.lit(2 * n + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    counted = postings.groupBy("id").agg(F.count(F.lit(1)).alias("df")).select("id", weight.alias("w"))
    stored = seeds.groupBy("id").agg(F.max("part").alias("most"), F.max(F.when(F.col("rank") == k, F.col("part"))).alias("kth"))
    told = vocabulary.join(counted, "id").join(stored, "id").select("term", "id", "w", (F.col("w") * F.col("most")).alias("most"), (F.col("w") * F.col("kth")).alias("kth"))
    # items and their terms; a number for an item, which may be null
    numbered = materialize(asked.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "lexical-items")
    asked = asked.join(numbered, asked["item_id"].eqNullSafe(numbered["item_id"])).select("item", "term")
    asked = materialize(asked.join(told, "term").select("item", "id", "w", "most", "kth"), "lexical-asked")

    def scored(pairs: DataFrame) -> DataFrame:
        """item, at, doc_id, score of pairs (item, at), over all terms of the item."""
        rows = held.select("at", "doc_id", "n", "ids", "tfs").join(pairs, "at").select("item", "at", "doc_id", "n", F.explode(F.arrays_zip("ids", "tfs")).alias("t"))
        rows = rows.select("item", "at", "doc_id", "n", F.col("t.ids").alias("id"), F.col("t.tfs").alias("tf")).select("item", "at", "doc_id", "id", part.alias("part"))
        return rows.join(asked.select("item", "id", "w"), ["item", "id"]).groupBy("item", "at", "doc_id").agg(F.sum(F.col("w") * F.col("part")).alias("score"))

    # lower bounds of the items' kth scores
    alone = asked.groupBy("item").agg(F.max("kth").alias("alone"))
    near = scored(asked.select("item", "id").join(seeds.select("id", "at"), "id").select("item", "at").distinct())
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    near = near.select("item", "score", rank.alias("rank")).where(F.col("rank") == k).select("item", F.col("score").alias("met"))
    bound = F.greatest(F.coalesce("alone", F.lit(1)), F.coalesce("met", F.lit(1)), F.lit(1)).cast("long")
    bounds = alone.join(near, "item", "left").select("item", bound.alias("bound"))

    # the terms that generate candidates, and what the others can add
    later = Window.partitionBy("item").orderBy(F.desc("most"), "id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = asked.join(bounds, "item").withColumn("from_here", F.sum("most").over(later))
    pruned = F.sum(F.when(F.col("from_here") < F.col("bound"), F.col("most"))).over(Window.partitionBy("item"))
    needed = ranked.withColumn("rest", F.coalesce(pruned, F.lit(0))).where(F.col("from_here") >= F.col("bound"))
    needed = materialize(needed.select("item", "id", "w", "bound", "rest"), "lexical-needed")

    met = postings.select("at", "id", "part").join(needed, "id").groupBy("item", "at", "bound", "rest").agg(F.sum(F.col("w") * F.col("part")).alias("got"))
    candidates = met.where(F.col("got") + F.col("rest") >= F.col("bound")).select("item", "at")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "at")
    top = scored(candidates).where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return numbered.join(top, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT rid, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM d WHERE len(terms) > 0), g AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM s),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, n, unnest(terms) AS term FROM s) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
r AS (SELECT item_id, doc_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), g GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id, rid) QUALIFY row_number() OVER o <= 10"""
