"""Streaming ingestion: new files are parsed as they come, and kept entries are added to a table.

The record format has no streams; this lets a folder of files be followed. Each micro-batch is judged against the keys and
title signatures that the table holds, so what was kept first stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bibspark.functions.text import title_signature
from bibspark.operators import dedupe, parse


def stream_entries(spark: SparkSession, folder: str) -> DataFrame:
    """source_path, ord, type, key, raw of each file that comes into ``folder``."""
    files = spark.readStream.format("text").option("wholetext", "true").schema("value string").load(folder)
    return parse.entries(files.select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("content")))


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep ``table`` (a Parquet folder: entries with their signature and batch) up to date. A batch that is repeated after a
    failure replaces what it wrote."""

    def add(batch: DataFrame, number: int) -> None:
        rows = parse.fields(batch, "title").withColumn("signature", title_signature(F.col("title"))).drop("title")
        try:
            old = spark.read.parquet(table).where(F.col("batch") != number)
            rows = rows.join(old.select("key").distinct(), "key", "left_anti").join(old.where("signature IS NOT NULL").select("signature").distinct(), "signature", "left_anti")
        except Exception as e:  # the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new = dedupe.judged(rows, scope="corpus").where("reason IS NULL").drop("kept_key", "reason")
        new.write.mode("overwrite").parquet(f"{table}/batch={number}")

    query = stream_entries(spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
