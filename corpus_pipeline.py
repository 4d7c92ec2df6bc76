"""The corpus pipeline: language ID, line dedup, near-dedup, mixing to target weights, token ids.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and but for the last one returns
the columns of documents. ``n_chars`` follows the text. Rows that are null, empty or repeated are handled as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.llm import langid, lines, mixing, pieces, simhash
from bibspark.llm.common import materialize, shuffled
from bibspark.storage import scratch

#: Below this score a text is rejected, along with those without a letter. The votes alone give 0.25 or more; what falls
#: below is the resemblance. Of 7,728 held-out texts of sf0.1, 3 did (two of them junk), of 13 junk and foreign texts all.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose text has no letter or resembles no language learnt; ``lang`` becomes the one predicted."""
    model = langid.train(docs)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    told = langid.predict(rows, model).where((F.col("language.lang_pred") != langid.UNKNOWN) & (F.col("language.score") >= LEAST_SCORE))
    return told.select(*[F.col("language.lang_pred").alias(c) if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns])


def own_key(docs: DataFrame) -> Column:
    """What tells each row from all that differ from it, in the order of doc_id (nulls first): 128 bits of hashes follow it."""
    cells = [docs[c] for c in docs.columns]
    # the nulls' places too, as a hash skips them
    cells.append(F.array(*[c.isNull() for c in cells]))
    return F.struct(docs["doc_id"].alias("id"), F.xxhash64(*cells).alias("h1"), F.xxhash64(F.lit(1), *cells).alias("h2"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that stand earlier in the corpus, alike or nearly so. Rows that differ are documents of their own,
    with whatever doc_id; those without one come first."""
    out = lines.dedupe_lines(docs, own_key(docs))
    text = F.col("line_dedup.text")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the least doc_id of each group of near copies; of rows that share it or have none (these come
    last), that with the least hash. Other rows stay, with whatever doc_id."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"), own_key(docs).alias("key"))
    none = F.col("key.id").isNull().alias("none")
    prints = materialize(simhash.fingerprints(rows.select(F.struct(none, "key.id", "key.h1", "key.h2").alias("doc_id"), "text")), "simhash")
    first = simhash.classes(prints).select("component_id.h1", "component_id.h2").distinct()
    kept = rows.join(shuffled(first), (F.col("key.h1") == first["h1"]) & (F.col("key.h2") == first["h2"]), "left_semi")
    # rows that are equal in all columns are one
    kept = kept.select("row", F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2")).dropDuplicates(["h1", "h2"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample documents so that sources have their target weights."""
    return mixing.sample(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_ids and ids of each document of the mix."""
    out = pieces.encode(docs.select("doc_id", "source", "lang", "text"))
    return out.select("doc_id", "source", "lang", "encoded.n_ids", "encoded.ids")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", token_ids),
]

#: SQL can't train the language models; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents. What each returns is written to the shared folder and read again; what a stage wrote on its
    way, and its input, are deleted once its output stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(docs) as keep:
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
