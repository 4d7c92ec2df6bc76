"""Ranked lexical search, against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bibspark.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, k=10):
    """docs: (doc_id, text) in the table's order; items: (item_id, text)."""
    counted = [(i, at, Counter(terms(t))) for at, (i, t) in enumerate(docs) if terms(t)]
    n, total = len(counted), sum(sum(c.values()) for *_, c in counted)
    df = Counter(t for *_, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for doc_id, at, c in counted:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0, at, doc_id))
        out += [(item, r + 1, d, -s) for r, (s, *_, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(docs, items, **kw):
    return sorted((tuple(r) for r in lexical.search(docs, items, **kw).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("vocabulary", [1 << 18, 40])
def test_against_brute_force(spark, docs, odd, monkeypatch, vocabulary):
    """Also with a vocabulary in many parts."""
    monkeypatch.setattr(lexical, "VOCABULARY", vocabulary)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    asked = [tuple(r) for r in items.select("item_id", "text").collect()]
    for rows in (docs, odd.orderBy(F.desc("n_chars"))):
        rows = rows.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("at", "n", "ids", "tfs", "item", "first", "item_id", "score")]).coalesce(1)
        have = [(r["doc_id"], r["text"]) for r in rows.collect()]
        assert found(rows, items) == expected(have, asked)


def test_ties_and_documents_that_share_an_id(spark):
    r = random.Random(2)
    words = "alpha beta gamma Delta épsilon 日本 x1".split()
    docs = [(r.choice([None, 5, *range(20)]), " ".join(r.choice(words) for _ in range(r.randrange(1, 4)))) for _ in range(300)]
    items = [(None, "alpha BETA"), (None, "delta"), (1, "DELTA, delta; x1/ÉPSILON épsilon"), (2, None), (3, ""), (4, "nowhere"), (5, "--"), (1, "日本")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(i, t, "x", 2) for i, t in items], "item_id long, text string, term string, w int")
    for k in (1, 3, 10, 1000):
        assert found(df, asked, k=k) == expected(docs, items, k)


def test_empty_tables(spark, docs, none):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert found(none, items) == [] and found(docs, items.where("false")) == []
    wordless = spark.createDataFrame([(1, "!!"), (2, None)], "doc_id long, text string")
    assert found(wordless, items) == []
    assert dict(lexical.search(none, items).dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_few_documents_become_candidates(spark, docs, monkeypatch):
    """What the bounds leave is a small part of the documents that have some term of an item."""
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = {}
    real = lexical.materialize

    def kept(df, name):
        seen[name] = real(df, name)
        return seen[name]

    monkeypatch.setattr(lexical, "materialize", kept)
    lexical.search(rows, items).collect()
    held = seen["lexical-index"].select("at", F.explode("ids").alias("id"))
    all_ = held.join(seen["lexical-asked"], "id").select("item", "at")
    left = held.join(seen["lexical-needed"], "id").select("item", "at")
    assert left.count() < 0.15 * all_.count()  # 11 %
    assert left.distinct().count() < 0.5 * all_.distinct().count()


def test_query_against_brute_force(spark):
    from bibspark.llm import queries

    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").select(c, "text").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op12_lexical_search"](spark, "/root/testdata/sf0.001").collect()), key=repr) == expected(read("documents", "doc_id"), read("benchmark", "item_id"))


def test_terms(spark):
    texts = ["", "A-b_C9é", "ÀÉ x y \x7f~Z", "İI"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", lexical.terms(F.col("text")).alias("terms"))
    for r in df.collect():
        assert r["terms"] == terms(r["text"]) == [t.decode() for t in lexical.terms_of(r["text"])]
