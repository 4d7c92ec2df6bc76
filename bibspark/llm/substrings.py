"""Removal of repeated passages by column-wise construction of a suffix order over many documents.

A byte goes if a string of ``LENGTH`` (50) bytes that covers it also starts in a document with a smaller doc_id. Strings are
judged on the input. Exact, over all documents and whole texts; matches don't cross documents.

1. Anchors. Of each 50-byte string, the position whose 24 bytes hash least stands for it (all positions of equal hash
   do), so equal strings have equal anchors at equal places. Around an anchor, its context holds every string that it can
   stand for: 26 bytes before it, 50 from it on. A scan gives each anchor's hash, the hash of its context, document and
   position. Of a context that a task meets in several documents, the least document goes on and the others are covered
   whole (a combine on the map side, so that a passage of a third of all documents comes to a row for each task, not for each
   document). What goes on is packed into blobs by a part of the hash, so the shuffle moves a few large rows.
2. Matching. Anchors in one document only are dropped. Of the others, equal contexts are one string with a list of places (its
   owners); the bytes of each string are fetched from the least document that has it.
3. Column-wise construction (``columns``). The strings of a part are a collection that is aligned at the anchors. Each of 76
   rounds inserts one symbol of every string, from the last column to the first. The transform of a round is the symbol in
   front of each string's newest suffix, in the order of these; its stable order by symbol is that of the suffixes that they
   make. Common prefixes follow: one more than the least between two neighbours of the same symbol, in the order before. As equal
   strings stand at equal places of their anchors, only suffixes of one column have to be compared, and a round reads and writes
   transform, order and prefixes once, front to back. From the 50th round on, neighbours with a common prefix of 50 bytes are
   equal strings, and each owner in a later document than the least of theirs is covered there. An anchor with more than
   ``HOT`` contexts is dealt out by its 50-byte strings instead, each a string of a collection on its own, so that it doesn't
   meet in one task.
4. Spans. What is covered is collected by document and joined with the texts.

Hashes of contexts (64 bits, mixed) stand for equality in steps 1 and 2; step 3 compares bytes. The files that are read and
written in sequence on disk are the shuffles and tables between the steps; the columns of a part are arrays in memory, some MB.

Defined results: null text is empty; texts under 50 bytes lose nothing; very long texts are scanned in pieces, whose anchors
are those of the whole; rows with a null doc_id neither lose nor cover anything; of rows with one doc_id none covers another,
and each is judged by its own text, equal rows alike; an empty table gives no rows. Columns besides doc_id and text are not
looked at.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

LENGTH, K = 50, 24
W = LENGTH - K + 1  # anchors' positions in a string: 27
BEFORE = W - 1
CONTEXT = BEFORE + LENGTH
SLICE = 1 << 20  # bytes that a scan holds at once, about; longer texts are scanned in pieces
MARGIN = 128  # bytes on either side of a piece: more than what an anchor and its context depend on
PER_PART = 400_000  # anchors in a part, about
TEXT_PART = 16 << 20  # bytes of text in a part of the join, about
HOT = 65_536
HELD = 250_000  # anchors that a scan combines at once, about
MOST = 1 << 15  # partitions of a shuffle; beyond that, parts share them
BASE = 0x9E3779B97F4A7C15
MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(29))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


_bytes = _mixed(np.arange(1, 257, dtype=U64) * U64(BASE))
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(b))])) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for each i (the last ones over what there is)."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = op(out[:-step], out[step:])
        have += step
    return out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position, hash and hash of the context of each anchor of ``texts``."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    number = np.repeat(np.arange(len(texts)), sizes)
    room = ends[number] - np.arange(n)  # bytes to the end of the text
    power, inverse = _power(n + 1)
    upto = np.concatenate([[U64(0)], np.cumsum(_bytes[raw] * power[:n])])
    v = np.full(n, MAX)
    some = np.flatnonzero(room >= K)
    v[some] = _mixed((upto[some + K] - upto[some]) * inverse[some]) >> U64(1)  # below MAX
    least = _sliding(v, W, np.minimum)
    least[room < LENGTH] = 0  # no string starts here
    # p is an anchor if it is least in a string that holds it: the largest of the least values of those strings is its own
    back = np.concatenate([np.zeros(BEFORE, U64), least])
    at = np.flatnonzero((_sliding(back, W, np.maximum)[:n] == v) & (v < MAX))
    lo = np.maximum(at - BEFORE, (ends - sizes)[number[at]])
    hi = np.minimum(at + LENGTH, ends[number[at]])
    context = _mixed((upto[hi] - upto[lo]) * inverse[lo] + (at - lo).astype(U64) * U64(0xD6E8FEB86659FD93) + (hi - at).astype(U64) * U64(0xA0761D6478BD642F))
    return number[at], at - (ends - sizes)[number[at]], v[at], context


def _tag(text: bytes) -> int:
    """Tells texts of one doc_id apart, together with it; ``_with_texts`` has the same."""
    return xxhash.xxh64_intdigest(text, 42) & 0xFFFFFFFF


#: Odd multipliers below 2^32, so that products with 31 bits fit a signed long.
MIX = (2654435761, 2246822519, 3266489917)


def _bucket(doc: np.ndarray, tag: np.ndarray, parts: int) -> np.ndarray:
    x = doc.astype(np.int64).view(U64)
    low, high = x & U64(0x7FFFFFFF), (x >> U64(31)) & U64(0x7FFFFFFF)
    h = (low * U64(MIX[0])) ^ (high * U64(MIX[1])) ^ ((tag.astype(U64) & U64(0x7FFFFFFF)) * U64(MIX[2]))
    return ((h >> U64(17)) % U64(parts)).astype(np.int64)


def _deal(where: np.ndarray, columns: list[np.ndarray]):
    """(part, bytes of each column) for each part in ``where``."""
    order = np.argsort(where, kind="stable")
    where = where[order]
    cuts = np.flatnonzero(np.diff(where)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(where)]):
        if b > a:
            yield int(where[a]), [np.ascontiguousarray(c[order[a:b]]).tobytes() for c in columns]


def _batch(rows: list, names: list[str]):
    cols = list(zip(*((*r, *[b""] * (len(names) - len(r))) for r in rows)))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names)


PACKED = "part long, a binary, b binary, c binary, d binary, e binary"
NAMES = ["part", "a", "b", "c", "d", "e"]


def _slices(batches):
    """Document, tag, place, first and last place to report, and bytes of texts that can match, or of pieces of them."""
    rows, held = [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if i is None or t is None or len(t) < LENGTH // 4:
                continue
            raw = t.encode("utf-8", "surrogatepass")
            if len(raw) < LENGTH:
                continue
            tag = _tag(raw)
            for a in range(0, len(raw), SLICE):
                base = max(0, a - MARGIN)
                rows.append((i, tag, base, a, a + SLICE, raw[base : a + SLICE + MARGIN]))
                held += len(rows[-1][-1])
                if held >= SLICE:
                    yield rows
                    rows, held = [], 0
    if rows:
        yield rows


def _scan(batches, parts: int, text_parts: int):
    """Anchors by part; and, by -1 - the text's part, what is covered by a smaller document of the same task."""
    held, n = [], 0

    def out():
        h, context, doc, tag, at = (np.concatenate(c) for c in zip(*held))
        o = np.lexsort((at, tag, doc, context, h))
        h, context, doc, tag, at = (x[o] for x in (h, context, doc, tag, at))
        first = _starts(h, context)
        later = doc > doc[np.flatnonzero(first)][np.cumsum(first) - 1]
        once = _starts(h, context, doc, tag, at)  # rows that are equal are one
        i, j = np.flatnonzero(once & ~later), np.flatnonzero(once & later)
        rest = (h // U64(parts)).astype(np.uint32)
        rows = list(_deal((h[i] % U64(parts)).astype(np.int64), [rest[i], context[i], doc[i], tag[i], at[i]]))
        rows += [(-1 - p, c) for p, c in _covers(doc[j], tag[j], at[j], text_parts)]
        return _batch([(p, *c) for p, c in rows], NAMES)

    for pieces in _slices(batches):
        number, at, h, context = anchors([p[-1] for p in pieces])
        ids, tags, base, lo, hi = (np.array(x) for x in list(zip(*pieces))[:5])
        at = at + base[number]
        own = np.flatnonzero((at >= lo[number]) & (at < hi[number]))
        number = number[own]
        held.append((h[own], context[own], ids.astype(np.int64)[number], tags.astype(np.uint32)[number], at[own].astype(np.uint32)))
        n += len(own)
        if n > HELD:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _covers(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, text_parts: int):
    """The contexts of anchors, as spans that are covered whole, dealt out by text."""
    start = np.maximum(at.astype(np.int64) - BEFORE, 0).astype(np.uint32)
    return _deal(_bucket(doc, tag, text_parts), [doc, tag, start, at + np.uint32(LENGTH)])


def _by_part(batches, kinds: list):
    """Part and columns of each part of a partition that is sorted by part; a negative part's rows as they are."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in NAMES)):
            if row[0] < 0:
                yield row[0], row[1:]
                continue
            if now is not None and row[0] != now:
                yield now, [np.concatenate([np.frombuffer(x, k) for x in col]) for col, k in zip(zip(*held), kinds)]
                held = []
            now = row[0]
            held.append(row[1:])
    if now is not None:
        yield now, [np.concatenate([np.frombuffer(x, k) for x in col]) for col, k in zip(zip(*held), kinds)]


ANCHOR = [np.uint32, U64, np.int64, np.uint32, np.uint32]
#: document, tag, first byte covered and end
COVER = [np.int64, np.uint32, np.uint32, np.uint32]
#: string, document, tag and position of an owner
OWNER = [np.uint32, np.int64, np.uint32, np.uint32]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its group, for sorted keys."""
    first = np.ones(len(keys[0]), bool)
    if len(first):
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return first


def _match(batches, text_parts: int, hot: int):
    """By 3 * part + kind. Kind 0: covered whole (``COVER``); kind 1: contexts to fetch (document, tag, position, the anchor's part
    and the string's number there, whether the anchor is hot); kind 2: owners (``OWNER``), by the anchor's part."""
    for part, columns_ in _by_part(batches, ANCHOR):
        if part < 0:
            yield _batch([(3 * (-1 - part), *columns_)], NAMES)
            continue
        rest, context, doc, tag, at = columns_
        o = np.lexsort((doc, context, rest))
        rest, context, doc, tag, at = (x[o] for x in (rest, context, doc, tag, at))
        group, same = _starts(rest), _starts(rest, context)
        g = np.cumsum(group) - 1
        g_at, s_at = np.flatnonzero(group), np.flatnonzero(same)
        several = (np.minimum.reduceat(doc, g_at) < np.maximum.reduceat(doc, g_at))[g]
        many = (np.bincount(g[s_at], minlength=len(g_at)) > hot)[g]
        first = doc[s_at][np.cumsum(same) - 1]  # the context's least document
        made = []
        # a hot anchor's contexts: copies are covered whole, and each that is left is asked for
        i = np.flatnonzero(several & many & (doc > first))
        made += [(3 * p, *c) for p, c in _covers(doc[i], tag[i], at[i], text_parts)]
        i = np.flatnonzero(several & ~many)
        number = (np.cumsum(same[i]) - 1).astype(np.uint32)
        if len(i):
            made.append((3 * part + 2, *(np.ascontiguousarray(c).tobytes() for c in (number, doc[i], tag[i], at[i]))))
        one = np.flatnonzero(same[i])
        alone = np.flatnonzero(several & many & (doc == first))
        ask = np.concatenate([i[one], alone])
        number = np.concatenate([number[one], np.zeros(len(alone), np.uint32)])
        # the anchor's part goes along, in front of the numbers
        here = np.full(1, part, np.int64).tobytes()
        made += [(3 * p + 1, a, b, c, here + d, e) for p, (a, b, c, d, e) in _deal(_bucket(doc[ask], tag[ask], text_parts), [doc[ask], tag[ask], at[ask], number, many[ask].astype(np.uint8)])]
        if made:
            yield _batch(made, NAMES)


JOINED = "bucket long, kind int, doc_id long, text string, a binary, b binary, c binary, d binary, e binary"


def _with_texts(docs: DataFrame, packed: DataFrame, parts: int) -> DataFrame:
    """Rows of a bucket of documents: first what is packed for it, then the texts."""
    empty = [F.lit(None).cast("binary").alias(c) for c in NAMES[1:]]
    d, bits = F.col("doc_id"), F.lit(0x7FFFFFFF).cast("long")
    low, high, tag = d.bitwiseAND(bits), F.shiftrightunsigned(d, 31).bitwiseAND(bits), F.xxhash64("text").bitwiseAND(bits)
    mixed = reduce(lambda a, b: a.bitwiseXOR(b), [x * F.lit(m).cast("long") for x, m in zip((low, high, tag), MIX)])
    # texts without an id have no notes
    bucket = F.when(d.isNull(), F.pmod(F.xxhash64("text"), F.lit(parts))).otherwise(F.shiftrightunsigned(mixed, 17) % F.lit(parts)).cast("long")
    texts = docs.select(bucket.alias("bucket"), F.lit(1).alias("kind"), "doc_id", "text", *empty)
    notes = packed.select(F.col("part").alias("bucket"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), *NAMES[1:])
    return texts.unionByName(notes).repartition(min(parts, MOST), "bucket").sortWithinPartitions("bucket", "kind")


class _Notes:
    """What is packed for a bucket, looked up by document and tag."""

    def __init__(self, rows: list[list[np.ndarray]]) -> None:
        cols = [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 2
        o = np.argsort(cols[0], kind="stable")
        self.cols = [c[o] for c in cols]

    def of(self, doc: int, tag: int) -> list[np.ndarray]:
        a, b = np.searchsorted(self.cols[0], [doc, doc + 1])
        mine = self.cols[1][a:b] == tag
        return [c[a:b][mine] for c in self.cols[2:]]


def _stream(batches, unpack):
    """Notes of the bucket and (doc_id, text) of each row with a text part."""
    now, held, notes = None, [], None
    for batch in batches:
        for bucket, kind, doc, text, *blobs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "doc_id", "text", *NAMES[1:]))):
            if bucket != now:
                now, held, notes = bucket, [], None
            if kind == 0:
                held.append(unpack(blobs))
                continue
            if notes is None:
                notes = _Notes(held)
            yield notes, doc, text


def _fetch(batches, parts: int):
    """The contexts (or single strings, of hot anchors, their own owners) asked for, by 3 * the anchor's part + 1."""

    def unpack(blobs):
        doc, tag, at = np.frombuffer(blobs[0], np.int64), np.frombuffer(blobs[1], np.uint32), np.frombuffer(blobs[2], np.uint32)
        part, number = np.frombuffer(blobs[3][:8], np.int64), np.frombuffer(blobs[3][8:], np.uint32)
        return [doc, tag, at, np.repeat(part, len(doc)), number, np.frombuffer(blobs[4], np.uint8)]

    held, n = [], 0

    def out():
        where, number, doc, tag, at, lo, hi, own, text = (np.concatenate(c) for c in zip(*held))
        head = np.zeros(len(doc), HEAD)
        for name, values in zip(HEAD.names, (number, doc, tag, at, lo, hi, own)):
            head[name] = values
        return _batch([(3 * p + 1, a, b) for p, (a, b) in _deal(where, [head, text])], NAMES)

    for notes, doc, text in _stream(batches, unpack):
        if doc is None or text is None or not len(notes.cols[0]):
            continue
        raw = text.encode("utf-8", "surrogatepass")
        tag = _tag(raw)
        at, part, number, hot = notes.of(doc, tag)
        if not len(at):
            continue
        at = at.astype(np.int64)
        lo, hi = np.maximum(BEFORE - at, 0), np.minimum(BEFORE + len(raw) - at, CONTEXT)
        own = hot
        if hot.any():
            i, cold = np.flatnonzero(hot), np.flatnonzero(hot == 0)
            base = (at[i] - BEFORE)[:, None] + np.arange(W)
            single = np.unique(base[(base >= 0) & (base + LENGTH <= len(raw))])
            h = np.array([xxhash.xxh64_intdigest(raw[s : s + LENGTH]) for s in single.tolist()], U64)
            part, number = np.concatenate([part[cold], (h % U64(parts)).astype(np.int64)]), np.concatenate([number[cold], np.zeros(len(single), np.uint32)])
            # a string on its own stands in the first columns
            lo, hi = np.concatenate([lo[cold], np.zeros(len(single), np.int64)]), np.concatenate([hi[cold], np.full(len(single), LENGTH)])
            at, own = np.concatenate([at[cold], single + BEFORE]), np.concatenate([hot[cold], np.ones(len(single), np.uint8)])
        codes = np.zeros(len(raw) + BEFORE + CONTEXT, np.uint8)
        codes[BEFORE : BEFORE + len(raw)] = np.frombuffer(raw, np.uint8)
        cells = codes[at[:, None] + np.arange(CONTEXT)]
        held.append((part, number, np.full(len(at), doc, np.int64), np.full(len(at), tag, np.uint32), at.astype(np.uint32), lo.astype(np.uint8), hi.astype(np.uint8), own, cells))
        n += len(at)
        if n * CONTEXT > SLICE:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def columns(cells: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """For each column from the last to the first: the column, the order of the strings' suffixes from there on, and each one's
    common prefix with the one before.

    ``cells``: a row of bytes for each string, aligned; of which those from ``lo`` up to ``hi`` count. What doesn't count is a symbol
    of its own, before all others and equal to none.
    """
    m, width = cells.shape
    by_column = np.ascontiguousarray(cells.T)
    order, prefix = np.arange(m), np.zeros(m, np.uint8)
    for c in range(width - 1, -1, -1):
        symbol = by_column[c].astype(np.uint16) + np.uint16(1)
        symbol[(lo > c) | (hi <= c)] = 0
        bwt = symbol[order]
        # the stable order by symbol is that of what a symbol in front of a suffix makes
        step = np.argsort(bwt, kind="stable")
        order, bwt = order[step], bwt[step]
        pair = np.flatnonzero((bwt[1:] == bwt[:-1]) & (bwt[1:] > 0))
        a, b = step[pair], step[pair + 1]
        least = prefix[b]
        apart = np.flatnonzero(b > a + 1)
        if len(apart):  # the least between two that were no neighbours
            o = apart[np.argsort(a[apart], kind="stable")]
            ends = np.empty(2 * len(o), np.int64)
            ends[::2], ends[1::2] = a[o] + 1, b[o] + 1
            least[o] = np.minimum.reduceat(np.append(prefix, np.uint8(255)), ends)[::2]
        prefix = np.zeros(m, np.uint8)
        prefix[pair + 1] = least + np.uint8(1)
        yield c, order, prefix


def least(cells: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each string and each of its ``W`` places, the least of the documents (``doc``: one of each string) that have the same
    LENGTH bytes there; the largest number where the string has no such bytes."""
    place = np.arange(W)
    out = np.where((lo[:, None] <= place) & (hi[:, None] >= place + LENGTH), doc[:, None], np.iinfo(np.int64).max)
    for c, order, prefix in columns(cells, lo, hi):
        if c >= W:
            continue
        long = prefix >= LENGTH
        some = np.flatnonzero(long | np.append(long[1:], False))  # alike with the one before or the one after
        if len(some):
            mine = order[some]
            start = np.flatnonzero(~long[some])
            out[mine, c] = np.repeat(np.minimum.reduceat(doc[mine], start), np.diff([*start, len(mine)]))
    return out


#: A string: number, document, tag, position of the anchor, the columns that the text fills, and whether it is its own owner.
HEAD = np.dtype([("number", "<u4"), ("doc", "<i8"), ("tag", "<u4"), ("at", "<u4"), ("lo", "u1"), ("hi", "u1"), ("own", "u1")])
PIECE = 1 << 15  # owners that are told at once


def _collections(batches):
    """Strings, their cells and the owners (``OWNER``) of each part; a partition is sorted by part, strings before owners."""
    now, strings, owners = None, [], []

    def out():
        head = np.concatenate([np.frombuffer(r[0], HEAD) for r in strings])
        cells = np.concatenate([np.frombuffer(r[1], np.uint8).reshape(-1, CONTEXT) for r in strings])
        return head, cells, [np.concatenate([np.frombuffer(r[i], k) for r in owners] or [np.zeros(0, k)]) for i, k in enumerate(OWNER)]

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in NAMES)):
            if now is not None and row[0] // 3 != now and strings:
                yield out()
            if row[0] // 3 != now:
                now, strings, owners = row[0] // 3, [], []
            (owners if row[0] % 3 == 2 else strings).append(row[1:])
    if strings:
        yield out()


def _construct(batches, text_parts: int):
    """What is covered (kind 0) of the owners of each part's strings."""
    for head, cells, owners in _collections(batches):
        table = least(cells, head["lo"].astype(np.int64), head["hi"].astype(np.int64), head["doc"].astype(np.int64))
        normal, single = np.flatnonzero(head["own"] == 0), np.flatnonzero(head["own"])
        where = np.zeros(int(head["number"].max(initial=0)) + 1, np.int64)
        where[head["number"][normal]] = normal
        number, doc, tag, at = owners
        string = np.concatenate([where[number], single])
        doc, tag, at = (np.concatenate([x, head[n][single]]) for x, n in ((doc, "doc"), (tag, "tag"), (at, "at")))
        found = []
        for a in range(0, len(string), PIECE):
            hit = table[string[a : a + PIECE]] < doc[a : a + PIECE, None]
            edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            who, begin = np.nonzero(edge > 0)
            end = np.nonzero(edge < 0)[1]  # as many in each row, in order
            if len(who):
                who = who + a
                base = at[who].astype(np.int64) - BEFORE
                # neighbouring strings of one context are one span
                found.append((doc[who], tag[who], (base + begin).astype(np.uint32), (base + end - 1 + LENGTH).astype(np.uint32)))
        if found:
            doc, tag, begin, end = (np.concatenate(c) for c in zip(*found))
            yield _batch([(3 * p, *c) for p, c in _deal(_bucket(doc, tag, text_parts), [doc, tag, begin, end])], NAMES)


def _cut(batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    ids, rows, held = [], [], 0

    def out():
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], names)

    for notes, doc, text in _stream(batches, lambda blobs: [np.frombuffer(x, k) for x, k in zip(blobs, COVER)]):
        raw = (text or "").encode("utf-8", "surrogatepass")
        kept, removed, spans = raw, 0, 0
        if doc is not None and len(notes.cols[0]):
            lo, hi = notes.of(doc, _tag(raw))
            if len(lo):
                step = np.zeros(len(raw) + 1, np.int32)
                np.add.at(step, lo, 1)
                np.add.at(step, np.minimum(hi, len(raw)), -1)
                gone = np.cumsum(step[:-1]) > 0
                removed = int(gone.sum())
                spans = int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        ids.append(doc)
        rows.append((len(raw), removed, spans, kept))
        held += len(kept)
        if held > SLICE or len(ids) >= 5000:
            yield out()
            ids, rows, held = [], [], 0
    if ids:
        yield out()


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    parts, text_parts = max(1, total // (PER_PART * (W + 1) // 2)), max(1, total // TEXT_PART)
    scan = docs.mapInArrow(partial(_scan, parts=parts, text_parts=text_parts), PACKED)
    by_part = lambda x: x.repartition(min(parts, MOST), "part").sortWithinPartitions("part")
    found = materialize(by_part(scan).mapInArrow(partial(_match, text_parts=text_parts, hot=hot), PACKED), "anchors")
    release(spark)
    whole = lambda x: x.withColumn("part", F.floor(F.col("part") / 3).cast("long"))
    strings = _with_texts(docs, whole(found.where("part % 3 = 1")), text_parts).mapInArrow(partial(_fetch, parts=parts), PACKED)
    both = strings.unionByName(found.where("part % 3 = 2")).repartition(min(parts, MOST), F.floor(F.col("part") / 3)).sortWithinPartitions("part")
    more = materialize(both.mapInArrow(partial(_construct, text_parts=text_parts), PACKED), "covers")
    release(spark)
    covers = whole(found.where("part % 3 = 0").unionByName(more))
    return _with_texts(docs, covers, text_parts).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_array(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
