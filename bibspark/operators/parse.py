"""Parsing: texts into entries, errors and fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.functions import scanner


def parsed(sources: DataFrame, strict_keys: bool = False) -> DataFrame:
    """source_path, parsed (entries, errors) of source_path, content."""
    return sources.select("source_path", scanner.parse_text(F.col("content"), strict_keys).alias("parsed"))


def entries(sources: DataFrame, strict_keys: bool = False) -> DataFrame:
    """source_path, ord, type, key, raw; ``ord`` is the place in the source, which counts: the first wins."""
    return parsed(sources, strict_keys).select("source_path", F.inline("parsed.entries"))


def errors(sources: DataFrame, strict_keys: bool = False) -> DataFrame:
    """source_path, ord, code (UNCLOSED or NO_KEY), start, type, message."""
    return parsed(sources, strict_keys).select("source_path", F.inline("parsed.errors"))


def counts(sources: DataFrame, strict_keys: bool = False) -> DataFrame:
    """source_path, parse_errors of every source."""
    return parsed(sources, strict_keys).select("source_path", F.size("parsed.errors").cast("long").alias("parse_errors"))


def fields(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` (with raw) and a column for each field; one crossing into Python for all of them."""
    got = rows.withColumn("__fields", scanner.extract_fields(F.col("raw"), *names))
    return got.select(*rows.columns, *[F.col("__fields").getField(n).alias(n) for n in names])


def field_rows(rows: DataFrame) -> DataFrame:
    """source_path, ord, pos, name, value: all fields of each entry, in order."""
    return rows.select("source_path", "ord", F.posexplode(scanner.parse_fields(F.col("raw"))).alias("pos", "f")).select("source_path", "ord", "pos", "f.name", "f.value")
