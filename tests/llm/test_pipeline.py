"""The pipeline's stages, each against brute force on its own input."""

import random
from collections import Counter

import sentencepiece
from helpers import prose
from test_operators import dedupe_by_hand, hash_by_hand

import corpus_pipeline as p
from bibspark.llm import langid, mixing, pieces
from bibspark.llm.common import materialize


def test_stages(spark, docs):
    seen = materialize(docs)
    columns = docs.columns
    before = {r["doc_id"]: r for r in seen.collect()}
    out = materialize(p.language_id(spark, seen, ""))
    assert out.columns == columns
    now = {r["doc_id"]: r for r in out.collect()}
    model = langid.train(seen)
    for d, r in before.items():
        lang, score = model.predict(r["text"])
        assert (d in now) == (lang != "und" and score >= p.LEAST_SCORE)
        assert d not in now or (now[d]["lang"] == lang and now[d]["text"] == r["text"])

    seen = out
    out = materialize(p.line_dedup(spark, seen, ""))
    assert out.columns == columns
    short = [(r["doc_id"], r["text"]) for r in seen.collect() if len(r["text"]) < 2000]
    small = spark.createDataFrame(short, "doc_id long, text string").join(seen.drop("text"), "doc_id").select(*columns)
    assert {r["doc_id"]: r["text"] for r in p.line_dedup(spark, small, "").collect()} == dedupe_by_hand(short)

    seen = out
    out = materialize(p.near_dedup(spark, seen, ""))
    assert out.columns == columns
    prints = {r["doc_id"]: hash_by_hand(r["text"]) for r in seen.collect()}
    group = {d: d for d in prints}
    for _ in prints:
        new = {d: min(group[o] for o, q in prints.items() if (prints[d] ^ q).bit_count() <= 3) for d in prints}
        if new == group:
            break
        group = new
    assert {r["doc_id"] for r in out.collect()} == set(group.values())

    seen = out
    out = materialize(p.mix_sources(spark, seen, ""))
    assert out.columns == columns
    want = Counter({r["doc_id"]: r["repeats"] for r in mixing.mix(seen).collect()})
    assert Counter(r["doc_id"] for r in out.collect()) == +want

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    last = p.token_ids(spark, out, "").collect()
    assert len(last) == out.count() and all(r["ids"] == sp.encode(text[r["doc_id"]]) for r in last)


def test_each_stage_on_odd_rows(spark, odd, none):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names; each stage by itself."""
    texts = Counter(r["text"] for r in odd.collect())
    for name, stage in p.STAGES:
        assert stage(spark, none, "").count() == 0, name
    out = p.language_id(spark, odd, "")
    assert out.columns == odd.columns
    kept = Counter(r["text"] for r in out.collect())
    assert kept <= texts and all(t and any(c.isalpha() for c in t) for t in kept) and kept[prose(7, 3000)] == 2

    out = p.line_dedup(spark, odd, "")
    rows = out.collect()
    assert out.columns == odd.columns and len(rows) == odd.count()
    # of equal rows each is a document of its own only if it differs: both rows 12 lose the lines that row 1 has
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in rows if r["doc_id"] == 12) and sum(r["text"] is None for r in rows) == 2

    out = p.near_dedup(spark, odd, "")
    assert out.columns == odd.columns
    left = sorted((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] is not None)
    by = {d: t for d, t in left}
    assert len(by) == len(left) and {1, 3, 7} <= set(by) and not {4, 5, 8, 9, 12} & set(by)  # the least of each group
    assert prose(3, 60) in {r["text"] for r in out.collect()}  # without an id, and like nothing else

    out = p.mix_sources(spark, odd, "")
    assert out.columns == odd.columns
    want = Counter()
    for r in mixing.mix(odd).collect():
        want[r["doc_id"]] += r["repeats"]
    assert Counter(r["doc_id"] for r in out.collect()) == +want

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out = p.token_ids(spark, odd, "").collect()
    ids = lambda t: None if t is None else sp.encode(t)
    assert sorted((r["doc_id"], r["ids"]) for r in out if r["doc_id"]) == sorted((r["doc_id"], ids(r["text"])) for r in odd.collect() if r["doc_id"])
    assert len(out) == odd.count()


def test_run(spark):
    assert p.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [n for n, _ in p.STAGES][0] == "language ID" and len(p.STAGES) == 5


def test_texts_unlike_any_language_learnt_are_dropped(spark, docs):
    rng = random.Random(5)
    odd = {
        -1: "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        -2: "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete.",
        -3: "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        -4: "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        -5: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)),
        -6: "xqzj " * 60,
    }
    more = spark.createDataFrame([(d, t, None, "s", len(t)) for d, t in odd.items()], docs.schema)
    out = {r["doc_id"] for r in p.language_id(spark, docs.unionByName(more), "").collect()}
    assert not out & set(odd)
    with_letters = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert out == with_letters


def test_rows_without_an_id_or_with_a_shared_one(spark):
    texts = [prose(i, 90) + f" end{i}" for i in range(12)]
    rows = [(None, t, "en", "s", 1) for t in texts[:5]]  # unrelated, without an id
    rows += [(7, t, "en", "s", 1) for t in texts[5:8]]  # unrelated, with one id
    rows += [(3, texts[8], "en", "s", 1), (None, texts[8], "en", "s", 1), (4, texts[8], "en", "s", 1)]  # copies
    rows += [(None, texts[9], "en", "s", 1)] * 2 + [(None, texts[9], "en", "t", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    prints = [hash_by_hand(t) for t in texts]
    assert min((a ^ b).bit_count() for i, a in enumerate(prints) for b in prints[:i]) > 3
    for _ in range(2):
        out = sorted(((r["doc_id"], r["text"]) for r in p.near_dedup(spark, df.repartition(3), "").collect()), key=str)
        assert out == sorted([(None, t) for t in texts[:5]] + [(7, t) for t in texts[5:8]] + [(3, texts[8]), (None, texts[9])], key=str)

    line = "A line that stands in several of the rows, word for word as it is here."
    rows = [(d, f"{line}\nonly in row {i}", "en", "s", 1) for i, d in enumerate([None, None, None, 5, 5])]
    out = [r["text"] for r in p.line_dedup(spark, spark.createDataFrame(rows, df.schema), "").collect()]
    assert len(out) == 5 and sum(line in t for t in out) == 1 and sorted(t.split("\n")[-1] for t in out) == [f"only in row {i}" for i in range(5)]
