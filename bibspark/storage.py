"""Tables that are written to the folder that the driver and all executors share, and read back.

That cuts the lineage: a lost executor makes nothing be computed anew. Unlike a checkpoint of rows it keeps statistics and
column pruning. What was written is deleted at exit, or as soon as the caller says that it is over.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. One of our own is made only where that is unset, as it is
    in tests on a single machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="bibspark-shared-")
            _written.append((spark, _own[app]))
        found = _own[app]
    return found


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bibspark/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(source: DataFrame | None = None) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What is written inside is deleted in the end, and ``source`` too if it was written here; but for the tables that the function
    given keeps: ``keep(df, name)`` writes ``df`` and reads it back like ``materialize``."""
    start, kept = len(_written), set()

    def keep(df: DataFrame, name: str = "t") -> DataFrame:
        out = materialize(df, name)
        kept.add(_written[-1][1])
        return out

    done = False
    try:
        yield keep
        done = True
    finally:  # of what failed nothing is kept
        over = [item for item in _written[start:] if not (done and item[1] in kept) and item[1] not in _own.values()]
        over += [item for item in _written[:start] if done and source is not None and item[1] == vars(source).get("written_to")]
        for item in over:
            delete(*item)
            _written.remove(item)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended first
            return
