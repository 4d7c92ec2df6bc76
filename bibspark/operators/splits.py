"""Parsing of sources of any size, in pieces.

A source is rows (source_path, at, content): its text in pieces, cut anywhere, in the order of ``at`` (``sources.bib.read_pieces``
makes them of files by byte ranges). Entries and errors are those of the whole text:

1. Each piece alone gives the function from the scanner's state before it to that after it.
2. Functions of ``WIDTH`` pieces of a source are put together, and so on until one is left for each source; then the states go
   back down. So a source of n pieces takes log(n) small joins, and no task more than ``WIDTH`` functions.
3. With the states before them pieces are cut, each by itself. What belongs to an entry that began earlier is sent to it, unless that
   entry never ends.
4. A key may lie behind its entry's end, as far as the next comma: such ones look into the pieces behind, one more each round.
5. Places are counted in the piece, and the pieces before are summed up from a row for each.

Texts stay in their tasks but for what crosses a cut. A source without ``content`` (null) is empty.
"""

from __future__ import annotations

import json
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bibspark.functions import splits
from bibspark.functions.chars import bounded, py_trim
from bibspark.functions.scanner import _HEAD, NO_RECORD
from bibspark.storage import materialize, scratch

WIDTH = 256

_CHANGES = "source_path string, at long, units long, change string"
_ITEMS = "source_path string, at long, i int, kind string, type string, opener string, start long, raw string, key string, behind string, next_at long, owner long"


def _units(text: str) -> int:
    """UTF-16 units."""
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def _changes(batches):
    for batch in bounded(batches):
        rows = []
        for path, at, text in zip(*(batch.column(c).to_pylist() for c in ("source_path", "at", "content"))):
            text = text or ""
            rows.append((path, at, _units(text), json.dumps(splits.change(text, at).packed())))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["source_path", "at", "units", "change"])


def _together(rows: pd.DataFrame) -> pd.DataFrame:
    """The function of a group, in order."""
    rows = rows.sort_values("place")
    out = splits.unpacked(json.loads(rows["change"].iloc[0]))
    for c in rows["change"].iloc[1:]:
        out = out.then(splits.unpacked(json.loads(c)))
    return pd.DataFrame([(rows["source_path"].iloc[0], rows["group"].iloc[0], json.dumps(out.packed()))], columns=["source_path", "place", "change"])


def _down(rows: pd.DataFrame) -> pd.DataFrame:
    """The state before each of a group, from that before the group."""
    rows = rows.sort_values("place")
    state, out = splits.State(*json.loads(rows["before"].iloc[0])), []
    for c in rows["change"]:
        out.append(json.dumps(list(state)))
        state = splits.unpacked(json.loads(c)).of(state)
    return pd.DataFrame({"source_path": rows["source_path"], "place": rows["place"], "before": out, "after": json.dumps(list(state))})


def _states(changes: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """source_path, at, before: the states before pieces; and source_path, after: those at the ends of sources."""
    # a number for each piece, from those of its source in order: a row for each piece, without its text
    number = F.row_number().over(Window.partitionBy("source_path").orderBy("at")) - 1
    numbered = materialize(changes.select("source_path", "at", number.cast("long").alias("place"), "change"), "splits-changes")
    levels = [numbered.select("source_path", "place", "change")]
    while levels[-1].where("place > 0").limit(1).count():
        grouped = levels[-1].withColumn("group", F.expr(f"place DIV {WIDTH}"))
        levels.append(materialize(grouped.groupBy("source_path", "group").applyInPandas(_together, "source_path string, place long, change string"), "splits-level"))
    before = levels[-1].select("source_path", "place", F.lit(json.dumps(list(splits.START))).alias("before"))
    start = splits.START

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"source_path": rows["source_path"], "after": [json.dumps(list(splits.unpacked(json.loads(c)).of(start))) for c in rows["change"]]})

    ends = levels[-1].mapInPandas(lambda parts: map(last, parts), "source_path string, after string")
    for level in reversed(levels[:-1]):
        rows = level.withColumn("group", F.expr(f"place DIV {WIDTH}")).join(before.withColumnRenamed("place", "group"), ["source_path", "group"])
        before = rows.groupBy("source_path", "group").applyInPandas(_down, "source_path string, place long, before string, after string").drop("after")
    states = numbered.select("source_path", "place", "at").join(before, ["source_path", "place"]).select("source_path", "at", "before")
    return keep(states, "splits-states"), keep(ends, "splits-ends")


def _cut(batches, strict: bool):
    """What is in each piece: entries (i counts them), and parts of entries that cross its ends: ``open`` begins one, ``within`` is the
    whole piece, ``close`` ends one."""
    names = [c.split()[0] for c in _ITEMS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    for batch in bounded(batches):
        rows = []
        for path, here, text, before, next_at in zip(*(batch.column(c).to_pylist() for c in ("source_path", "at", "content", "before", "next_at"))):
            text, state = text or "", splits.State(*json.loads(before))
            end, at, after = splits.resume(text, state)
            units, counted = 0, 0

            def row(i, kind, start, raw, type_=None, opener=None, key=None, behind=None, owner=None):
                rows.append((path, here, i, kind, type_, opener, start, raw, key, behind, next_at, owner))  # noqa: B023

            if state.mode and at < 0:
                row(-1, "within", None, text, owner=state.owner)
                continue
            if end >= 0:
                row(-1, "close", None, text[:end], behind=text[end:], owner=state.owner)
            i = 0
            for x in splits.top(text, at, here):
                start = x.start if isinstance(x, splits.Found) else x[0]
                units, counted = units + _units(text[counted:start]), start
                if not isinstance(x, splits.Found):
                    if x[1].mode:
                        row(i, "open", units, text[start:], owner=here)
                    break
                type_, opener = py_trim(x.kind).lower(), text[x.body - 1]
                if type_ not in NO_RECORD:
                    key = splits.key_of(text[x.body : x.end] if strict else text[x.body :], opener, x.end - 1 - x.body if strict else None)
                    row(i, "entry", units, py_trim(text[x.start : x.end]), type_, opener, key, text[x.body :] if key is None else None, here)
                    i += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _joined(rows: pd.DataFrame, strict: bool) -> pd.DataFrame:
    """An entry of parts, in order; the last one closes it and has what is behind."""
    rows = rows.sort_values("at")
    first, last = rows.iloc[0], rows.iloc[-1]
    raw = "".join(rows["raw"])
    head = _HEAD.match(raw, 0)
    type_, body = py_trim(head["type"]).lower(), head.end() + 1
    names = [c.split()[0] for c in _ITEMS.split(", ")]
    if type_ in NO_RECORD:
        return pd.DataFrame([], columns=names)
    text = raw[body:] if strict else raw[body:] + last["behind"]
    key = splits.key_of(text, raw[body - 1], len(raw) - 1 - body if strict else None)
    cells = [first["source_path"], first["at"], first["i"], "entry", type_, raw[body - 1], first["start"], py_trim(raw), key, text if key is None else None, last["next_at"], first["at"]]
    return pd.DataFrame([cells], columns=names)


def _looked(batches):
    """Keys that end in the piece that was added to what is behind."""
    for rows in batches:
        behind = [b + (t or "") for b, t in zip(rows["behind"], rows["content"])]
        keys = [splits.key_of(b, o, None) for b, o in zip(behind, rows["opener"])]
        # a source's end is a key's end
        keys = [splits.key_of(b, o, len(b)) if k is None and pd.isna(n) else k for k, b, o, n in zip(keys, behind, rows["opener"], rows["later"])]
        yield pd.DataFrame({"source_path": rows["source_path"], "at": rows["at"], "i": rows["i"], "opener": rows["opener"], "key": keys, "behind": [b if k is None else None for k, b in zip(keys, behind)], "next_at": rows["later"]})


def parsed(pieces: DataFrame, strict_keys: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entries (source_path, ord, type, key, raw) and errors (source_path, ord, code, start, type, message) of sources in pieces."""
    with scratch() as keep:
        changes = materialize(pieces.select("source_path", F.col("at").cast("long").alias("at"), "content").mapInArrow(_changes, _CHANGES), "splits")
        by_place = Window.partitionBy("source_path").orderBy("at")
        sizes = keep(changes.select("source_path", "at", (F.sum("units").over(by_place) - F.col("units")).alias("units_before"), F.lead("at").over(by_place).alias("next_at")), "splits-sizes")
        states, ends = _states(changes, keep)
        texts = pieces.select("source_path", F.col("at").cast("long").alias("at"), "content")
        cut = texts.join(states, ["source_path", "at"]).join(sizes.drop("units_before"), ["source_path", "at"]).mapInArrow(partial(_cut, strict=strict_keys), _ITEMS)
        items = materialize(cut, "splits-items")

        closed = items.where("kind = 'close'").select("source_path", "owner")
        parts = items.where("kind <> 'entry'").join(closed, ["source_path", "owner"], "left_semi")
        joined = parts.groupBy("source_path", "owner").applyInPandas(lambda rows: _joined(rows, strict_keys), _ITEMS)
        rows = materialize(items.where("kind = 'entry'").unionByName(joined), "splits-entries")

        # keys that end in a later piece
        known, waiting = [], rows.where("key IS NULL").select("source_path", "at", "i", "opener", "behind", "next_at")
        later = sizes.select("source_path", F.col("at").alias("next_at"), F.col("next_at").alias("later"))
        while waiting.limit(1).count():
            more = waiting.join(texts.withColumnRenamed("at", "next_at"), ["source_path", "next_at"], "left").join(later, ["source_path", "next_at"], "left")
            more = more.mapInPandas(_looked, "source_path string, at long, i int, opener string, key string, behind string, next_at long")
            more = materialize(more, "splits-keys")
            known.append(more.where("key IS NOT NULL").select("source_path", "at", "i", F.col("key").alias("found")))
            waiting = more.where("key IS NULL").select("source_path", "at", "i", "opener", "behind", "next_at")
        for k in known[1:]:
            known[0] = known[0].unionByName(k)
        rows = rows.select("source_path", "at", "i", "type", "start", "raw", "key")
        if known:
            rows = rows.join(known[0], ["source_path", "at", "i"], "left").withColumn("key", F.coalesce("key", "found")).drop("found")
        rows = keep(rows, "splits-told")

        # what never ends: its head is in the parts up to its opener
        state = F.from_json("after", "array<string>")
        never = ends.where(state[0] == str(splits.ENTRY)).select("source_path", state[5].cast("long").alias("owner"))
        heads = items.where("kind IN ('open', 'within')").join(never, ["source_path", "owner"]).join(states, ["source_path", "at"])
        in_head = (F.col("kind") == "open") | F.from_json("before", "array<string>")[0].isin(*map(str, (splits.AT, splits.TYPE, splits.GAP)))
        heads = heads.where(in_head).groupBy("source_path").agg(F.min("owner").alias("at"), F.max("i").alias("i"), F.max("start").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "raw"))), lambda r: r["raw"]), "").alias("raw"))
        kind = F.arrow_udf(lambda raw: pa.array([py_trim(_HEAD.match(r.as_py(), 0)["type"]).lower() for r in raw], pa.string()), "string")
        unclosed = keep(heads.select("source_path", "at", "i", "start", kind("raw").alias("type")), "splits-unclosed")

    def placed(rows: DataFrame) -> DataFrame:
        """With ord: the place in the piece, and the rows of the pieces before."""
        here = rows.groupBy("source_path", "at").agg(F.count(F.lit(1)).alias("n"))
        before = here.select("source_path", "at", (F.sum("n").over(by_place) - F.col("n")).alias("before"))
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("source_path", "at").orderBy("i")) - 1)
        return rows.join(before, ["source_path", "at"]).withColumn("ord", (F.col("before") + F.col("place")).cast("int"))

    entries = placed(rows.where("key <> ''")).select("source_path", "ord", "type", "key", "raw")
    bad = rows.where("key = ''").select("source_path", "at", "i", "start", "type", F.lit("NO_KEY").alias("code"), F.lit("Entry without key").alias("said"))
    bad = bad.unionByName(unclosed.select("source_path", "at", "i", "start", "type", F.lit("UNCLOSED").alias("code"), F.lit("Unclosed entry starting").alias("said")))
    bad = placed(bad).join(sizes.select("source_path", "at", "units_before"), ["source_path", "at"]).withColumn("start", F.col("start") + F.col("units_before"))
    message = F.format_string("%s at index %d (@%s)", "said", "start", "type")
    return entries, bad.select("source_path", "ord", "code", "start", "type", message.alias("message"))
