"""Winnowed fingerprints, against the definition."""

import hashlib
import random
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibspark.llm import winnow

M64 = (1 << 64) - 1


def run_hash(run):
    x = 0
    for c in run:
        x = (x * 0x9E3779B97F4A7C15 + ord(c) + 1) & M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x >> 32


@cache
def by_definition(text, k=winnow.K, w=winnow.WINDOW):
    """[(hash, position)]: the least of each window, the rightmost of equal ones."""
    if not text:
        return []
    k = min(k, len(text))
    hashes = [run_hash(text[i : i + k]) for i in range(len(text) - k + 1)]
    w = min(w, len(hashes))
    out = []
    for i in range(len(hashes) - w + 1):
        least = min(hashes[i : i + w])
        p = max(j for j in range(i, i + w) if hashes[j] == least)
        if not out or out[-1][1] != p:
            out.append((least, p))
    return out


def as_text(entries):
    before, out = 0, []
    for h, p in entries:
        out.append(f"{h:08x}{p - before:02x}")
        before = p
    return "".join(out)


@pytest.mark.parametrize(("k", "w", "piece"), [(16, 17, 1 << 15), (5, 4, 7), (7, 9, 64), (1, 1, 5), (3, 200, 50), (13, 8, 1)])
def test_entries_are_those_of_the_definition(monkeypatch, k, w, piece):
    monkeypatch.setattr(winnow, "PIECE", piece)
    r = random.Random(k)
    for n in (0, 1, 2, 5, 15, 16, 17, 31, 32, 33, 34, 100, 400):
        for letters in ("ab é\U0001f600", "a"):  # of one letter all hashes are ties
            t = "".join(r.choice(letters) for _ in range(n))
            want = by_definition(t, k, w)
            hashes, places = winnow.winnow(t, k, w)
            assert list(zip(hashes.tolist(), places.tolist())) == want
            assert winnow.written(hashes, places) == as_text(want)
            back = winnow.read_back(as_text(want))
            assert list(zip(back[0].tolist(), back[1].tolist())) == want


def test_each_match_of_the_guaranteed_length_is_found():
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    least = winnow.K + winnow.WINDOW - 1
    for _ in range(200):
        n = least + r.randrange(40)
        shared, a, b = text(n), text(r.randrange(200)), text(r.randrange(200))
        one, two = a + shared + text(50), b + shared + text(70)
        found = winnow.spans(winnow.written(*winnow.winnow(one)), winnow.written(*winnow.winnow(two)))
        mine = [s for s in found if s[0] - s[1] == len(a) - len(b)]
        assert mine and all(one[i : i + m] == two[j : j + m] for i, j, m in found)
        assert winnow.spans(winnow.written(*winnow.winnow(a)), "") == []


def expected(rows):
    """By doc_id descending, nulls last; rows of one doc_id by Spark's hash of the text, which the caller adds."""
    rows = sorted(((i is None, -(i or 0), h, t or "", i) for i, t, h in rows))
    out = []
    for at, (_, _, _, t, i) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][3]
        cut = len(t) // 2
        edited = t[: len(t) - cut] + after[:cut]
        sets = [{h for h, _ in by_definition(x)} for x in (t, edited, after)]
        like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_text(by_definition(t)), as_text(by_definition(edited)), like(sets[0], sets[1]), like(sets[0], sets[2])))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def told(docs):
    return sorted((tuple(r[c] for c in COLUMNS) for r in winnow.neighbours(docs).collect()), key=repr)


@pytest.mark.parametrize("least", [winnow.LEAST, 1])
def test_neighbours_against_brute_force(spark, docs, odd, none, monkeypatch, least):
    """In one range, and in many: a range's last row meets the first one of the next."""
    monkeypatch.setattr(winnow, "LEAST", least)
    monkeypatch.setattr(winnow, "THIN", 8 if least > 1 else 2)
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    for rows in (docs, odd, docs.where("doc_id = 5"), odd.where("doc_id = 12")):
        want = expected([tuple(r) for r in rows.select("doc_id", "text", hashed).collect()])
        assert told(rows) == want
    assert told(none) == [] and [f.name for f in winnow.neighbours(none).schema] == COLUMNS
    if least == 1:
        assert len(winnow._ranges(winnow._ordered(docs))) > 40


def test_rows_without_an_id_and_extreme_ids(spark):
    rows = [(None, "a" * 50), (None, "b" * 50), (2**63 - 1, "c" * 40), (-(2**63), "d" * 40), (0, ""), (0, None), (0, "e")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected([tuple(r) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()])
    assert told(docs) == want


def test_copies_are_alike_and_others_are_not(docs):
    rows = winnow.neighbours(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {}
    for r in rows:
        prints.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in rows if r["n_chars"] > 500]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.2


def test_column(spark, odd):
    got = odd.select("text", winnow.fingerprint(F.col("text")).alias("f")).collect()
    assert all(r["f"] == as_text(by_definition(r["text"] or "")) for r in got)
