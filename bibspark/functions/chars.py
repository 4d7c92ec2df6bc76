"""Character classes and trimming with the semantics that the record format needs.

White space for trimming is everything up to U+0020; for collapsing it is the ASCII class of regular expressions; between
tokens it is what counts as white space in Unicode but for no-break spaces, with the four ASCII separators.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between tokens.
TOKEN_SPACE = r"\t-\r\x1c-\x20\u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000"
_RUN = re.compile(r"[ \t\n\x0b\f\r]+")
CONTROL = "".join(map(chr, range(33)))
#: Bytes of texts that a Python worker holds as objects at a time. A batch from Spark may be of 64 MB, and texts as objects, with what is
#: found in them, take several times that.
HELD = 1 << 20


def _sizes(c: pa.Array) -> np.ndarray:
    """Bytes of each row of texts; of lists by their lengths; none of other columns."""
    if pa.types.is_list(c.type):
        return pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) * (c.nbytes / max(1, len(c.flatten())))
    texts = pa.types.is_string(c.type) or pa.types.is_binary(c.type)
    return pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) if texts else np.zeros(len(c))


def bounded(batches: Iterator, held: int = HELD) -> Iterator:
    """Record batches, arrays or tuples of arrays cut into parts of about ``held`` bytes of texts and lists, of one row at least."""
    for batch in batches:
        columns = batch.columns if isinstance(batch, pa.RecordBatch) else batch if isinstance(batch, tuple) else (batch,)
        ends = np.cumsum(sum(map(_sizes, columns), np.zeros(len(columns[0]))))
        at = 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + held, "right")))
            yield tuple(c.slice(at, stop - at) for c in batch) if isinstance(batch, tuple) else batch.slice(at, stop - at)
            at = stop


def trim(c: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def collapse(c: Column) -> Column:
    """Each run of white space as one space, trimmed."""
    return trim(F.regexp_replace(c, r"\s+", " "))


def py_trim(s: str) -> str:
    return s.strip(CONTROL)


def py_collapse(s: str) -> str:
    return py_trim(_RUN.sub(" ", s))


def some(c: Column) -> Column:
    """Whether a string is there and not empty."""
    return c.isNotNull() & (c != "")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without a match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def utf16(key: Column) -> Column:
    """What sorts texts by their UTF-16 units: a character beyond the first 65,536 comes before U+E000 and later ones."""
    return F.encode(key, "UTF-16BE")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), body)[0]
