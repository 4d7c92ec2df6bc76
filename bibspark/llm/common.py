"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bibspark.functions.chars import let
from bibspark.storage import delete, materialize, shared_dir

__all__ = ["SPACE", "WORD", "delete", "holds", "let", "materialize", "only", "release", "shared_dir", "shuffled", "trim"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast. A table that grows with the input may look small as it is compressed, and
    the driver would hold it several times over."""
    return df.hint("merge")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of queries that are over, so that they don't pile up on disk."""
    import gc

    gc.collect()
    spark.range(1).count()  # the scheduler holds on to the last job
    spark.sparkContext._jvm.System.gc()


_held: dict[str, Callable[[], None]] = {}


def holds(name: str, clear: Callable[[], None]) -> None:
    """Tell how to drop what an operator keeps in a Python worker."""
    _held[name] = clear


def only(name: str) -> None:
    """Drop what other operators have left in this worker, which is used again and stays up between stages."""
    for other, clear in _held.items():
        if other != name:
            clear()


def trim() -> None:
    """Give freed memory back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
