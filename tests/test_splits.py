"""Sources in pieces give what they give as a whole."""

import functools
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bibspark.functions import scanner, splits
from bibspark.operators import parse
from bibspark.operators import splits as in_pieces
from bibspark.sources import bib

PARTS = ["@", "@a{", "{", "}", "(", ")", '"', "\\", ",", "x", "  ", "\n", "@comment{", "-", "é", "@b (", "k", "@c{k, t={", "}}", "\U0001f600"]


def text(r, n):
    return "".join(r.choice(PARTS) for _ in range(n))


def cut(r, t, n):
    at = sorted(r.randrange(len(t) + 1) for _ in range(n))
    return [t[a:b] for a, b in zip([0, *at], [*at, len(t)])]


def test_functions_of_pieces():
    r = random.Random(0)
    for _ in range(2000):
        t = text(r, r.randrange(1, 40))
        pieces = cut(r, t, r.randrange(6))
        changes = [splits.change(p, i) for i, p in enumerate(pieces)]
        states = [splits.START]
        for c in changes:
            states.append(c.of(states[-1]))
        found = list(splits.top(t, 0, 0))
        assert states[-1]._replace(owner=None) == found[-1][1]._replace(owner=None)
        # in any order of putting together, from any state
        k = r.randrange(len(changes))
        sides = [functools.reduce(lambda a, b: a.then(b), x) for x in (changes[:k], changes[k:]) if x]
        both = functools.reduce(lambda a, b: a.then(b), sides)
        both = splits.unpacked(json.loads(json.dumps(both.packed())))
        for s in (splits.START, *(splits.State(m, owner=97) for m in (splits.AT, splits.TYPE, splits.GAP)), *(splits.State(splits.ENTRY, o, d, q, e, 98) for o in "{(" for d in (1, 2, 5) for q in (True, False) for e in (True, False))):
            assert both.of(s) == functools.reduce(lambda s, c: c.of(s), changes, s)


def split_rows(spark, texts):
    return spark.createDataFrame([(p, i * 10 + 5, x) for p, pieces in texts.items() for i, x in enumerate(pieces)], "source_path string, at long, content string")


def compared(spark, pieces, texts, strict=False):
    entries, errors = in_pieces.parsed(pieces, strict)
    whole = {p: scanner.parse(t, strict) for p, t in texts.items()}
    got = sorted((r["source_path"], r["ord"], r["type"], r["key"], r["raw"]) for r in entries.collect())
    assert got == sorted((p, e["ord"], e["type"], e["key"], e["raw"]) for p, (es, _) in whole.items() for e in es)
    got = sorted((r["source_path"], r["ord"], r["code"], r["start"], r["type"], r["message"]) for r in errors.collect())
    assert got == sorted((p, e["ord"], e["code"], e["start"], e["type"], e["message"]) for p, (_, es) in whole.items() for e in es)
    return len(got)


@pytest.mark.parametrize("strict", [False, True])
def test_pieces_equal_the_whole(spark, monkeypatch, strict):
    monkeypatch.setattr(in_pieces, "WIDTH", 4)
    r = random.Random(1)
    cuts = {f"s{i}": cut(r, text(r, r.randrange(1, 120)), r.randrange(20)) for i in range(150)}
    cuts |= {"empty": [""], "one letter each": list('@Book ( k"(" , t = {a@b} )@x{q} @y{,}@misc{v, t={w}'), "head": ["@", "mi", "sc", " ", "\n", "{", "k", ",a=1", "}"], "no comma": ["@a{k}", " x", "", "y", "@b{", "z} "], "never": ["@st", "ring ", "{ a,", "b"], "none": ["", "no entry", "@"]}
    texts = {p: "".join(c) for p, c in cuts.items()}
    assert compared(spark, split_rows(spark, cuts), texts, strict) > 20


def test_a_file_in_ranges(spark, tmp_path):
    """One file is read by several tasks, and its entries cross their ranges."""
    docs = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    t = "\n\n".join(f"@Article{{d{i},\n  title = {{{x.replace('{', '').replace('}', '')}}},\n  year = 2000\n}}" for i, x in enumerate(docs)) + "\n@misc{end, x={"
    (tmp_path / "big.BIB").write_text(t, encoding="utf-8", newline="")
    (tmp_path / "other.txt").write_text("@a{b,c=1}")
    size = len(t.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 7))
    try:
        pieces = bib.read_pieces(spark, f"file://{tmp_path}", size=3000)
        assert pieces.rdd.getNumPartitions() >= 7
        rows = pieces.orderBy("at").collect()
        assert "".join(r["content"] for r in rows) == t + "\n" and max(len(r["content"]) for r in rows) < 200_000 and len(rows) > 50
        path = rows[0]["source_path"]
        assert compared(spark, pieces, {path: t}) == 1
        whole = parse.entries(bib.read_bib(spark, f"file://{tmp_path}"))
        assert whole.exceptAll(in_pieces.parsed(pieces)[0]).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tables_are_deleted(spark):
    from bibspark import storage

    before = len(storage._written)
    entries, errors = in_pieces.parsed(split_rows(spark, {"a": ["@x{a,b=", "1}@y{"]}))
    assert entries.count() == errors.count() == 1
    assert all("splits-" in p and any(n in p for n in ("sizes", "states", "ends", "told", "unclosed")) for _, p in storage._written[before:])
    none = spark.createDataFrame([], "source_path string, at long, content string")
    assert [d.count() for d in in_pieces.parsed(none)] == [0, 0]
    assert in_pieces.parsed(none.unionByName(none.select(F.lit("p").alias("source_path"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("content"))))[0].columns == ["source_path", "ord", "type", "key", "raw"]


def test_workers_hold_little_of_a_batch():
    """F5 to F10 and others: a batch from Spark may be of 64 MB; what Python makes of it is made in parts."""
    import tracemalloc

    text = "@misc{k, title={" + "x" * 40_000 + "}}\n"
    n = 400
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["s"] * n), pa.array(range(n)), pa.array([text] * n), pa.array([json.dumps(list(splits.START))] * n), pa.array([*range(1, n), None])], ["source_path", "at", "content", "before", "next_at"]
    )
    for run in (in_pieces._changes, lambda batches: in_pieces._cut(batches, False)):
        tracemalloc.start()
        rows = sum(b.num_rows for b in run([batch]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n and peak < batch.nbytes / 2


def test_bounded_parts():
    from bibspark.functions.chars import bounded

    texts = pa.array(["ab", None, "c" * 10, "", "d"])
    assert [len(x) for x in bounded([texts, texts[:0]], 4)] == [2, 1, 2]
    assert [[len(x), len(y)] for x, y in bounded([(texts, texts)], 4)] == [[2, 2], [1, 1], [2, 2]]
    assert [x.num_rows for x in bounded([pa.RecordBatch.from_arrays([pa.array(range(5)), texts], ["a", "b"])], 4)] == [2, 1, 2]
    lists = pa.array([["a"] * 3, None, ["b"] * 3, []])
    assert pa.concat_arrays(list(bounded([lists], 1))).equals(lists) and len(list(bounded([lists], 1))) > 1
    assert [len(x) for x in bounded([pa.array([1, 2])], 4)] == [2]
