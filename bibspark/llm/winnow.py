"""Document fingerprints by winnowing.

Every run of ``K`` code points has a rolling hash. Of each window of ``WINDOW`` runs the least hash is chosen, the rightmost of
equal ones, and kept with its position. So any two texts that have ``K + WINDOW - 1`` code points in a row in common share a
fingerprint entry (the window that lies inside the match is the same in both), and no match under ``K`` is ever seen.
``spans`` reads such matches back from the positions.

A fingerprint is a string of ten hex digits an entry, in order: eight of the hash, two of the step from the entry before (from
the start, for the first); a step is never longer than a window. The likeness of two is the share of their distinct hashes that
both have (Jaccard); of two empty ones it is 1.

``neighbours`` compares each document with the next by descending doc_id, which is no window over the whole table: rows are cut
into ranges of the order at rows that a hash picks (a part of the keys, of bounded number, goes to the driver; every row goes to
its range). A range is sorted and streamed through one task, and the first row of each range goes to the range before too.

Defined results: a null text is empty; an empty text has an empty fingerprint; a text of fewer than ``K`` code points is one
run, one of fewer than ``WINDOW`` runs is one window. Null doc_ids come last in the order; rows that share a doc_id follow each
other by a hash of their text, then by text; rows equal in both are each other's next ones, and stream through one task. The
only row of a table is its own next one. An empty table gives no rows. Texts are hashed in pieces, so a very long one needs little but itself. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

K, WINDOW = 16, 17
PIECE = 1 << 15  # runs hashed at once
#: A bound on the keys that the driver gets, and how many of them make a range.
KEYS, THIN, LEAST = 1 << 18, 8, 32
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_LOW = np.uint64(0xFFFFFFFF)


def run_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all runs of ``k`` code points; runs are put together from runs of half the length."""
    n, left = len(codes), k
    out, have = None, 0
    part, size, power = codes.astype(np.uint64) + np.uint64(1), 1, _BASE
    with np.errstate(over="ignore"):
        while True:
            if left & 1:  # behind what is put together so far
                m = n - have - size + 1
                out = part if out is None else out[:m] * power + part[have : have + m]
                have += size
            left >>= 1
            if not left:
                break
            part = part[:-size] * power + part[size:]
            size, power = 2 * size, power * power
        out = (out ^ (out >> np.uint64(30))) * _MIX[0]
        out = (out ^ (out >> np.uint64(27))) * _MIX[1]
    return (out >> np.uint64(32)).astype(np.uint32)


def _chosen(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash of each window, of equal ones the rightmost; each place once, in order."""
    n = len(hashes)
    w = min(w, n)
    least = hashes.astype(np.uint64) << np.uint64(32) | (_LOW - np.arange(n, dtype=np.uint64))
    size = 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: n - w + 1], least[w - size :][: n - w + 1])
    at = (_LOW - (least & _LOW)).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def winnow(text: str, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the entries chosen, in order."""
    n = len(text)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    k = min(k, n)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found, last = [], -1
    for at in range(0, max(1, n - k + 1 - (w - 1)), PIECE):
        piece = run_hashes(codes[at : at + PIECE + w - 1 + k - 1], k)
        place = _chosen(piece, w)
        place = place[place + at > last]
        found.append((piece[place], place + at))
        if len(place):
            last = int(place[-1]) + at
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def written(hashes: np.ndarray, places: np.ndarray) -> str:
    entries = np.empty((len(hashes), 5), np.uint8)
    entries[:, :4] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    entries[:, 4] = np.diff(places, prepend=0)
    return entries.tobytes().hex()


def read_back(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    entries = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    return entries[:, :4].copy().view(">u4").ravel().astype(np.uint32), np.cumsum(entries[:, 4], dtype=np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct hashes, sorted."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def spans(a: str, b: str, k: int = K) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of what two fingerprints have in common: entries met along a diagonal, merged where their
    runs touch or overlap."""
    (ha, pa_), (hb, pb) = read_back(a), read_back(b)
    where: dict[int, list[int]] = {}
    for h, p in zip(hb.tolist(), pb.tolist()):
        where.setdefault(h, []).append(p)
    met = sorted((p - q, p) for h, p in zip(ha.tolist(), pa_.tolist()) for q in where.get(h, ()))
    out: list[list[int]] = []
    for d, p in met:
        if out and out[-1][0] == d and p <= out[-1][1] + out[-1][2]:
            out[-1][2] = p + k - out[-1][1]
        else:
            out.append([d, p, k])
    return [(p, p - d, n) for d, p, n in out]


def fingerprint(text: Column, k: int = K, w: int = WINDOW) -> Column:
    """The fingerprint of a text column, as a string."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        only("winnow")
        return pa.array([written(*winnow(t.as_py() or "", k, w)) for t in texts], pa.string())

    return run(text)


def _ordered(docs: DataFrame) -> DataFrame:
    """none, id, h, text: the order is by them, the largest id first, and nulls last."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.col("doc_id").cast("long")
    return docs.select(key.isNull().alias("none"), F.coalesce(key, F.lit(0)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _ranges(rows: DataFrame) -> np.ndarray:
    """The first keys of the ranges, in order, the very first row's among them. Never more than ``KEYS`` / ``THIN`` or so: the share
    of rows that a hash picks falls as there are more."""
    n = rows.count()
    each = max(LEAST, -(-n // KEYS))
    key = F.struct("none", F.bitwise_not("id").alias("back"), "h")
    picked = rows.where(F.pmod(F.xxhash64("none", "id", "h", F.lit(13)), F.lit(each)) == 0).select(key.alias("key")).distinct().sort("key").collect()
    first = rows.agg(F.min(key).alias("key")).first()["key"]
    keys = [tuple(first)] + [tuple(p["key"]) for p in picked[THIN - 1 :: THIN]] if first is not None else []
    return np.array(sorted(set(keys)), dtype=[("none", "?"), ("back", "<i8"), ("h", "<i8")])


def _range_of(rows: DataFrame, keys: np.ndarray) -> Column:
    """The ranges of a row: its own, and for the first row of one also the range before it."""

    @F.arrow_udf("array<int>")
    def run(none: pa.Array, id_: pa.Array, h: pa.Array) -> pa.Array:
        asked = np.zeros(len(id_), keys.dtype)
        asked["none"], asked["back"], asked["h"] = none.to_numpy(zero_copy_only=False), ~id_.to_numpy(), h.to_numpy()
        own = np.searchsorted(keys, asked, "right") - 1
        starts = keys[own] == asked
        return pa.array([[o, (o or len(keys)) - 1] if s else [o] for o, s in zip(own.tolist(), starts.tolist())], pa.list_(pa.int32()))

    return run("none", "id", "h")


def _compared(batches, k: int, w: int):
    """Rows of ranges, each in order and followed by the first of the range after it (``copy``)."""
    only("winnow")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    before, out, size = None, [], 0

    def told(now: tuple, next_text: str, next_hashes: np.ndarray) -> dict:
        _, none, id_, text, print_, hashes = now
        cut = len(text) // 2
        edited = text[: len(text) - cut] + next_text[:cut]
        other = winnow(edited, k, w) if edited != text else None
        return {
            "doc_id": None if none else id_, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": print_,
            "edited_fingerprint": written(*other) if other else print_, "near_edited": likeness(hashes, np.unique(other[0])) if other else 1.0, "near_next": likeness(hashes, next_hashes),
        }

    for batch in batches:
        for part, copy, none, id_, text in zip(*(batch.column(c) for c in ("part", "copy", "none", "id", "text"))):
            part, text = part.as_py(), text.as_py()
            if before and before[0] != part:
                before = None  # what stood before is a copy, or the second of equal ones
            chosen = winnow(text, k, w)
            hashes = np.unique(chosen[0])
            if before:
                out.append(told(before, text, hashes))
                size += len(out[-1]["fingerprint"]) + len(out[-1]["edited_fingerprint"])
            # a copy closes its range; there may be more, of equal rows
            before = None if copy.as_py() else (part, none.as_py(), id_.as_py(), text, written(*chosen), hashes)
            if size > 1 << 22 or len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def neighbours(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document: of its text, and of
    its text with the second half replaced by the beginning of the next document's."""
    if not 0 < w < 256:
        raise ValueError("a step between entries is written in two hex digits")
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = _ordered(docs)
    keys = _ranges(rows)
    if not len(keys):
        return docs.sparkSession.createDataFrame([], kind)
    dealt = rows.select(F.posexplode(_range_of(rows, keys)).alias("copy", "part"), "none", "id", "h", "text")
    dealt = dealt.withColumn("copy", F.col("copy") > 0)
    order = ["part", "copy", "none", F.desc("id"), "h", "text"]
    return dealt.repartition("part").sortWithinPartitions(*order).drop("h").mapInArrow(partial(_compared, k=k, w=w), kind)


def op13_winnowing(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
