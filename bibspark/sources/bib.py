"""Sources: files of records, inline text, document text, and snapshots of catalogue responses."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RESPONSE = "source string, lookup_kind string, lookup_key string, status int, body string"


def read_bib(spark: SparkSession, path: str | list[str], suffix: str = ".bib") -> DataFrame:
    """source_path, content: a row for each file whose name ends in ``suffix``, in any case; other files are passed over."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("content"))
    return rows.where(F.endswith(F.lower("source_path"), F.lit(suffix)))


#: Fixed value: what a user is told of a file that can't be read.
NOT_READ = "Failed to load file."


def readable(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of source_path, content, ...: the sources whose texts are UTF-8 throughout, and the others' source_path and message. Nothing is
    read with replacement characters in place of what was there. Of sources in pieces (``read_pieces``) all pieces of a
    source go, if one isn't UTF-8. Texts that aren't UTF-8 can't be parsed."""
    pieces = "readable" in sources.columns
    bad = sources.where(~F.col("readable") if pieces else ~F.is_valid_utf8("content")).select("source_path").distinct()
    kept = sources.join(bad, "source_path", "left_anti").select(*sources.columns) if pieces else sources.where(F.coalesce(F.is_valid_utf8("content"), F.lit(True)))
    return kept, bad.withColumn("message", F.lit(NOT_READ))


def read_documents(spark: SparkSession, path: str | list[str], suffix: str = ".txt") -> DataFrame:
    """source_path, content of document texts. Binary formats need a decoder that the caller brings (``decode_binary``)."""
    return read_bib(spark, path, suffix)


def decode_binary(spark: SparkSession, path: str | list[str], decoder: Callable[[bytes], str], suffix: str = ".pdf") -> DataFrame:
    """source_path, content of binary documents, by a function from bytes to text."""
    files = spark.read.format("binaryFile").load(path).where(F.endswith(F.lower("path"), F.lit(suffix)))

    @F.arrow_udf("string")
    def text(raw: pa.Array) -> pa.Array:
        return pa.array([None if x.as_py() is None else decoder(x.as_py()) for x in raw], pa.string())

    return files.select(F.col("path").alias("source_path"), text(F.col("content")).alias("content"))


def inline(spark: SparkSession, texts: Iterable[tuple[str, str | None]]) -> DataFrame:
    """source_path, content of pairs of a name and a text."""
    return spark.createDataFrame(list(texts), "source_path string, content string")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of catalogue responses (Parquet): source, lookup_kind, lookup_key, status, body."""
    return spark.read.schema(RESPONSE).parquet(path)


def write_snapshot(responses: DataFrame, table: str, buckets: int = 200, path: str | None = None) -> DataFrame:
    """A snapshot as a table, bucketed by what is looked up: joins with it move the other side only."""
    keys = ("lookup_kind", "lookup_key")
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(RESPONSE)]
    out = responses.select(*columns).repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite")
    (out.option("path", path) if path else out).saveAsTable(table)
    return responses.sparkSession.table(table)


def fetch(requests: DataFrame, get: Callable[[str], tuple[int, str]]) -> DataFrame:
    """Make a snapshot with a function from a URL to (status, body). ``requests``: source, lookup_kind, lookup_key, url.

    Nothing here opens a connection. Write the result before joining it, so that no request is repeated.
    """

    def run(batches):
        for b in batches:
            got = [get(u) for u in b.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("lookup_kind"), b.column("lookup_key"), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string())], ["source", "lookup_kind", "lookup_key", "status", "body"])

    return requests.select("source", "lookup_kind", "lookup_key", "url").mapInArrow(run, RESPONSE)


def _pieces(batches, size: int):
    """Lines of files' blocks, in order, as pieces: of one block each, of about ``size`` characters."""
    now, lines, n, k, good = None, [], 0, 0, True

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1] + k], pa.int64()), pa.array(["".join(lines)]), pa.array([good])], ["source_path", "at", "content", "readable"])

    for batch in batches:
        for path, start, line, fine in zip(*(batch.column(c).to_pylist() for c in ("source_path", "block", "line", "fine"))):
            if now is not None and (now != (path, start) or n >= size):
                yield out()
                k, lines, n, good = (k + 1 if now == (path, start) else 0), [], 0, True
            now = (path, start)
            for at in range(0, len(line) + 1, size):  # a line may be longer than a piece
                if n and at:
                    yield out()
                    k, lines, n, good = k + 1, [], 0, True
                lines.append(line[at : at + size])
                n, good = n + len(lines[-1]), good and fine
            lines.append("\n")
            n += 1
    if now is not None:
        yield out()


def read_pieces(spark: SparkSession, path: str | list[str], suffix: str = ".bib", size: int = 1 << 22) -> DataFrame:
    """source_path, at, content, readable: files of any size in pieces (``operators.splits``). Spark reads a file in byte ranges that
    begin and end with lines; ``at`` is the range's first byte and the piece's number in it. A line break is added at a file's
    end. A piece with bytes that aren't UTF-8 isn't ``readable`` (see ``readable``)."""
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("line"), F.is_valid_utf8("value").alias("fine"))
    return lines.where(F.endswith(F.lower("source_path"), F.lit(suffix))).mapInArrow(partial(_pieces, size=size), "source_path string, at long, content string, readable boolean")
