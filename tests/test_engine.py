import math
import random

import pytest
from pyspark.sql import functions as F

from bibspark.functions import jsonx, months
from bibspark.functions import text as tx
from bibspark.operators import dedupe, enrich, parse, refs, render
from bibspark.sources import bib


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_months(spark):
    said = ["Sep. 12", "{Feb.}", "Marathon", "13", " ", None, "Mayor", "06", "99999999999", "\tjune"]
    assert column(spark, said, months.month_number) == [12, 2, 3, None, None, None, 5, 6, None, 6]
    f = lambda s: column(spark, ["sep", "May", "x"], lambda c: months.format_month(months.month_number(c), s, c))
    assert f("ABBREV_DOT") == ["Sep.", "May", "x"]
    assert f("FULL_NAME") == ["September", "May", "x"]
    assert f("KEEP_ORIGINAL") == ["sep", "May", "x"]
    with pytest.raises(ValueError):
        f("SHORT")
    assert column(spark, ["2020-03-01", "2020-13", "2020", None], months.iso_month) == ["March", None, None, None]


def test_text(spark):
    assert column(spark, ["A title: 12345", "Short", "Über alles", None], tx.title_signature) == ["atitle12345", None, None, None]
    assert column(spark, ["a&b_{c}~^", None], tx.escape_bibtex) == [r"a\&b\_\{c\}\~{}\^{}", ""]
    assert column(spark, ["@a{k ,x", "none"], tx.display_key) == ["k", "unknown"]
    assert column(spark, ["Ann B Cee", "Plato", "Name "], tx.invert_name) == ["Cee, Ann B", "Plato", "Name "]
    assert column(spark, ["Smith, A and B, C", "Plato", "", None, "Optimal, X", "A, B and "], tx.plausible_authors) == [True, False, False, False, False, True]
    assert column(spark, ["Book", "thesis", "odd", None], tx.entry_type) == ["book", "phdthesis", "misc", None]
    assert column(spark, ["{Ann} Lee and X Y", "Lee, Ann and B", "Plato"], tx.surname) == ["Lee", "Lee", "Plato"]


def test_json(spark):
    j = ['{"Title":["a \\"b\\""],"title":"c"}', '{"title": 12}', "{}", None]
    assert column(spark, j, lambda c: jsonx.json_value(c, "title")) == ['a "b"', "12", None, None]
    # an inner array ends the list of authors
    cut = '{"author":[{"family":"A","given":"B","affiliation":[]},{"family":"C","given":"D"}]}'
    assert column(spark, [cut], jsonx.crossref_authors) == ["A, B"]


def test_dedupe_is_greedy(spark):
    raw = "@misc{%s, title={%s title of many letters}}"
    text = "\n".join(raw % x for x in (("k1", "first"), ("k2", "first"), ("k2", "second"), ("k3", "third"), ("k1", "fourth")))
    entries = parse.entries(bib.inline(spark, [("s", text), ("none", ""), ("null", None)]))
    for scope in ("source", "corpus"):
        got = sorted((r["ord"], r["key"], r["kept_key"], r["reason"]) for r in dedupe.judged(entries, scope=scope).collect())
        assert got == [(0, "k1", None, None), (1, "k2", "k1", dedupe.TITLE), (2, "k2", None, None), (3, "k3", None, None), (4, "k1", "k1", dedupe.KEY)]


def test_summary_has_a_row_for_empty_sources(spark):
    got = {r[0]: tuple(r)[1:] for r in dedupe.summary(bib.inline(spark, [("a", "@b{c,d=1}@b{c,d=2}@misc()"), ("e", ""), ("n", None)])).collect()}
    assert got == {"a": (2, 1, 1, 1), "e": (0, 0, 0, 0), "n": (0, 0, 0, 0)}


def test_outcomes_and_reports_of_sources_without_entries_or_duplicates(spark):
    sources = bib.inline(spark, [("dup", "@b{c,d=1}@b{c,d=2}"), ("one", "@b{c,d=1}"), ("none", "% nothing"), ("null", None)])
    said = {r["source_path"]: r["message"] for r in dedupe.outcome(dedupe.summary(sources)).collect()}
    assert said == {"dup": None, "one": None, "none": dedupe.NO_ENTRIES, "null": dedupe.NO_ENTRIES}
    entries = parse.entries(sources)
    told = {r["source_path"]: (r["report"], r["message"]) for r in render.duplicates_report(dedupe.duplicates(entries), sources).collect()}
    assert told["dup"] == ("References - Duplicates Report\n\nTotal duplicates removed: 1\n\n- dropped=c kept=c reason=KEY_DUPLICATE\n", None)
    assert {k: v for k, v in told.items() if k != "dup"} == dict.fromkeys(("one", "none", "null"), (None, dedupe.NO_DUPLICATES))
    out = {r["source_path"]: r["output"] for r in render.processed_output(dedupe.summary(sources), dedupe.unique(entries)).collect()}
    assert out["none"] == out["null"] == "" and out["one"].endswith("@b{c,d=1}\n\n")


@pytest.mark.parametrize("finish", [dedupe.FINISH, 5])
def test_rounds_equal_the_fold(spark, finish):
    rng = random.Random(5)
    rows = [("s", i, f"k{rng.randint(0, 40)}", f"@m{{x, title={{some long title {rng.randint(0, 40)}}}}}") for i in range(300)]
    # a chain that takes many rounds: each entry meets the one before by key or by title
    rows += [("t", i, f"c{(i + 1) // 2}", f"@m{{x, title={{chained title number {1000 + i // 2}}}}}") for i in range(10)]
    rows += [("u", i, f"k{rng.randint(0, 9)}", "@m{x, title={short}}") for i in range(20)]
    entries = spark.createDataFrame(rows, "source_path string, ord int, key string, raw string")

    def by_hand(rows):
        keys, titles, out = set(), {}, []
        for path, i, key, raw in rows:
            title = raw.split("{")[2].rstrip("}").replace(" ", "")
            if key in keys:
                out.append((path, i, key, dedupe.KEY))
            elif len(title) >= 10 and title in titles:
                out.append((path, i, titles[title], dedupe.TITLE))
            else:
                keys.add(key)
                titles[title] = key
                out.append((path, i, None, None))
        return out

    keep = lambda scope: sorted(map(tuple, dedupe.judged(entries, scope=scope, finish=finish).select("source_path", "ord", "kept_key", "reason").collect()))
    assert keep("corpus") == by_hand(rows)
    assert keep("source") == [x for p in "stu" for x in by_hand([r for r in rows if r[0] == p])]
    first = {}
    for path, i, key, _ in rows:
        first.setdefault(key, (path, i))
    told = dedupe.judged(entries, smart=False, scope="corpus").collect()
    assert all((r["reason"] is None) == (first[r["key"]] == (r["source_path"], r["ord"])) for r in told) and len(told) == len(rows)


def _chain(spark, n):
    """Each entry meets the one before, by key or by title."""
    raw = F.concat(F.lit("@m{x, title={chained title number "), (F.col("id") / 2).cast("long").cast("string"), F.lit("}}"))
    key = F.concat(F.lit("c"), ((F.col("id") + 1) / 2).cast("long").cast("string"))
    return spark.range(n).select(F.lit("s").alias("source_path"), F.col("id").cast("int").alias("ord"), key.alias("key"), raw.alias("raw"))


@pytest.mark.parametrize("n", [3000, 100_000])
def test_chains_take_a_logarithm_of_jobs(spark, monkeypatch, n):
    from bibspark import storage

    written = []
    real = dedupe.materialize
    monkeypatch.setattr(dedupe, "materialize", lambda df, name="t": written.append(name) or real(df, name))
    before, tables = storage._written[:], len(storage._written)
    for scope in ("corpus", "source") if n < 10_000 else ("corpus",):
        written.clear()
        told = dedupe.judged(_chain(spark, n), scope=scope, finish=1000)
        # all but every second go
        got = told.groupBy((F.col("ord") % 2).alias("odd"), F.col("reason").isNull().alias("stays")).count().collect()
        assert sorted(tuple(r) for r in got) == [(0, True, n // 2), (1, False, n // 2)]
        assert len(written) <= 10 + math.ceil(math.log2(n))
    left = storage._written[tables:]
    assert storage._written[:tables] == before and len(left) == (6 if n < 10_000 else 3) and not any("round" in p or "roots" in p or "links" in p for _, p in left)


@pytest.mark.parametrize("kind", ["near", "any", "far"])
def test_roots_of_long_chains_are_found_by_ranges(spark, monkeypatch, kind):
    """A chain of neighbours is moved a fixed number of times, not once for each doubling; links that lead far away are followed too."""
    n, rng = 2000, random.Random(7)
    before = {i: i - 1 for i in range(1, n)} if kind == "near" else {i: rng.randrange(i) for i in range(1, n) if i % 50} if kind == "any" else {i: i - 500 for i in range(500, n)}
    want = {}
    for i, b in before.items():
        root, flips = want.get(b, (b, False))
        want[i] = root, not flips
    written, real = [], dedupe.materialize
    monkeypatch.setattr(dedupe, "materialize", lambda df, name="t": written.append(name) or real(df, name))
    monkeypatch.setattr(dedupe, "NEAR", 64)
    linked = spark.createDataFrame([("g", ("s", i), ("s", b), True) for i, b in before.items()], "group string, at struct<source_path: string, ord: int>, root struct<source_path: string, ord: int>, flips boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r["at"]["ord"]: (r["root"]["ord"], r["flips"]) for r in dedupe._rooted(linked).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert kind != "near" or written.count("dedupe-roots") <= 2


def test_tangles_equal_the_fold(spark):
    """Few keys and titles, so that nearly all entries hang together, in chains and in knots; also titles that only one has."""
    for seed, keys, titles in ((1, 60, 60), (2, 250, 250), (3, 3, 300), (4, 300, 2), (5, 500, 140)):
        rng = random.Random(seed)
        rows = [("s", i, f"k{rng.randrange(keys)}", f"@m{{x, title={{some long title {rng.randrange(titles)}}}}}" if rng.random() < 0.9 else "@m{x, title={t}}") for i in range(600)]
        # two long chains, crossed
        rows += [("s", 600 + i, f"c{(i + 1) // 2}", f"@m{{x, title={{chained title number {i // 2}}}}}") for i in range(120)]
        rows += [("s", 720 + i, f"c{i}", f"@m{{x, title={{chained title number {119 - i}}}}}") for i in range(120)]
        entries = spark.createDataFrame(rows, "source_path string, ord int, key string, raw string")
        told = lambda finish: sorted(tuple(r) for r in dedupe.judged(entries, finish=finish).select("ord", "kept_key", F.coalesce("reason", F.lit(""))).collect())
        assert told(2) == told(10_000)


def test_tables_of_a_failed_stage_are_deleted(spark):
    from bibspark import storage

    start = len(storage._written)
    with pytest.raises(ZeroDivisionError), storage.scratch() as keep:
        keep(spark.range(3), "kept")
        storage.materialize(spark.range(3), "lost")
        raise ZeroDivisionError
    assert len(storage._written) == start


def test_blocks_are_the_output(spark, tmp_path):
    """Written in order by several tasks, and searched, they are what one text for each source gives."""
    texts = [("a", "@x{k2, t={one\n\ntwo here}}\n@misc()@x{k1, t={Needle}}@x{k2,u=1}"), ("b", "@x{\U0001f600,d=needle}@x{\ufffd,d=1}@x{z,d={\n\n\n%needle\n\n}}"), ("none", "% nothing"), ("null", None)]
    texts += [("many", "".join(f"@y{{k{i * 7919 % 400}, n={{{i}}}}}" for i in range(400)))]
    sources = bib.inline(spark, texts)
    rows = dedupe.processed(sources)
    summary, stay = dedupe.summary_of_processed(rows), rows.where("ord IS NOT NULL AND reason IS NULL")
    assert sorted(map(tuple, summary.collect())) == sorted(map(tuple, dedupe.summary(sources).collect()))
    for by_key in (False, True):
        whole = {r["source_path"]: r["output"] for r in render.processed_output(summary, dedupe.unique(parse.entries(sources)), "ABBREV_DOT", by_key).collect()}
        blocks = render.output_blocks(summary, stay, "ABBREV_DOT", by_key)
        path = render.save_blocks(blocks, f"file://{tmp_path}/out{by_key}", 5)
        for name, text in whole.items():
            files = sorted((tmp_path / f"out{by_key}" / f"source_path={name}").glob("part-*"))
            assert "".join(f.read_bytes().decode() for f in files) == text, name
            assert len(files) > 1 or name != "many"
        assert path.endswith(str(by_key))
        for needle in ("needle", " ONE ", "", "absent", "%"):
            found = {r["source_path"]: (r["output"], r["matches"]) for r in render.search(render.processed_output(summary, stay, "ABBREV_DOT", by_key), needle).collect()}
            parts: dict = {}
            for r in render.search_blocks(blocks, needle).orderBy("source_path", "part", "by_key", "ord").collect():
                old = parts.get(r["source_path"], ("", 0))
                parts[r["source_path"]] = (old[0] + r["block"], None if r["matches"] is None else old[1] + r["matches"])
            assert {k: v for k, v in found.items() if v[0]} == parts
    keys = [r["key"] for r in dedupe.unique(parse.entries(sources), sort_by_key=True).where("source_path = 'b'").collect()]
    assert keys == ["z", "\U0001f600", "\ufffd"]


def test_verified_blocks_are_the_output(spark):
    entries = spark.createDataFrame([("s", 0, "@misc{a,title={x}}"), ("s", 1, None), ("s", 2, "@misc{b}")], "source_path string, ord int, raw string")
    told = enrich.verify(entries, spark.createDataFrame([], bib.RESPONSE))
    summary = render.status_summary(told, spark.createDataFrame([], "source_path string"))
    want = render.verified_output(summary, told).first()["output"]
    assert "".join(r["block"] for r in render.verified_blocks(summary, told).orderBy("part", "ord").collect()) == want


def test_files_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "good.bib").write_bytes("@a{é,b={\U0001f600}}".encode())
    (tmp_path / "bad.bib").write_bytes(b"@a{x,b={\xff}}\n" + b"@a{y,b=1}\n" * 400)
    for rows in (bib.read_bib(spark, f"file://{tmp_path}"), bib.read_pieces(spark, f"file://{tmp_path}", size=100)):
        kept, bad = bib.readable(rows)
        assert {r["source_path"].rpartition("/")[2] for r in kept.collect()} == {"good.bib"}
        assert [(r["source_path"].rpartition("/")[2], r["message"]) for r in bad.collect()] == [("bad.bib", bib.NOT_READ)]


def test_a_section_is_split_by_authors(spark, monkeypatch):
    """Against the rule by hand, also with places put together for few lines; a section of 100,000 lines takes seconds."""
    import re
    import time

    def by_hand(section):
        held, out = "", []
        for line in (x.strip("".join(map(chr, range(33)))) for x in section.split("\n")):
            if not line:
                continue
            if re.match(refs.STARTS.replace(r"\z", r"\Z"), line) and len(held) > 40:
                out.append(held)
                held = line
            else:
                held = f"{held} {line}" if held else line
        return [re.sub(r"[ \t\n\x0b\f\r]+", " ", x).strip() for x in out + [held] * (len(held) > 40)]

    rng = random.Random(3)
    pieces = ["Smith, John. A long title about many things in Journal.", "Lee AB, Short.", "  continued here and there", "", "12. Title of it", "x" * 39, "Doe, Jane", "y" * 41]
    sections = ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", "\n\n", "x" * 40, "x" * 41]
    for width in (refs.LINES, 1, 3):
        monkeypatch.setattr(refs, "LINES", width)
        got = column(spark, sections, refs.by_author)
        assert [[r["text"] for r in g] for g in got] == [by_hand(s) for s in sections]
        assert all([r["number"] for r in g] == list(range(1, len(g) + 1)) for g in got)
    monkeypatch.undo()
    large = "\n".join(["Smith, John. A long title about many things in some Journal, 2001."] * 100_000)
    began = time.monotonic()
    n = spark.createDataFrame([(large,), ("a line of nothing\n" * 100_000,)], "t string").select(F.size(refs.by_author(F.col("t"))).alias("n")).collect()
    assert [r["n"] for r in n] == [100_000, 1]
    assert time.monotonic() - began < 40


def test_sorting_is_by_key(spark):
    e = parse.entries(bib.inline(spark, [("b", "@x{c,d=1}@x{a,d=1}@x{b,d=1}"), ("a", "@x{z,d=1}@x{y,d=1}")]))
    assert [(r["source_path"], r["key"]) for r in dedupe.unique(e, sort_by_key=True).collect()] == [("a", "y"), ("a", "z"), ("b", "a"), ("b", "b"), ("b", "c")]
    assert [r["key"] for r in dedupe.unique(e).collect()] == ["z", "y", "c", "a", "b"]


def test_months_in_entries(spark):
    e = parse.entries(bib.inline(spark, [("s", '@a{k, title={the month of}, month = "jan", x={y}}@a{l, month={?}}')]))
    assert [r["raw"] for r in dedupe.normalize_months(e, "FULL_NAME").orderBy("ord").collect()] == ["@a{k, title={the month of}, month = {January}, x={y}}", "@a{l, month={?}}"]
    assert dedupe.normalize_months(e, "KEEP_ORIGINAL") is e


def test_reference_details(spark):
    got = column(spark, ["Smith, J. (2020). A study on ML.", "Anderson TW (1973) Asymptotically efficient estimation. J 1", "No year, doi: 10.1234/ab.c)."], refs.reference_details)
    assert [(r["year"], r["title"], r["doi"]) for r in got] == [("2020", "", None), ("1973", "Asymptotically efficient estimation", None), (None, "/ab", "10.1234/ab.c)")]


def test_sections(spark):
    texts = ["x\nReferences\n[1] a\nAppendix\nb", "no section", None, "a\n WORKS  cited \nz"]
    assert column(spark, texts, refs.find_section) == ["[1] a", None, None, "z"]
    dense = "x" * 40 + "\n".join(f"[{i}] item" for i in range(1, 9))
    assert column(spark, [dense], refs.find_section)[0].count("[") >= 3
    two = '[1] Smith, J. "A title of one". 2001.\n[2] Jones, K. "A title of two". 2002.'
    assert len(column(spark, [two], refs.split_references)[0]["refs"]) == 1


def test_index_reads_what_single_look_ups_do(spark):
    keys = ["title", "DOI", "container-title", "year", "k", "absent", "a b"]
    rng = random.Random(9)
    bits = ['"title"', '"Title"', '"doi"', '"DOI"', '"year"', '"k"', '"a b"', '"container-title"', ":", " : ", "[", "]", "{", "}", ",", '"x"', '""', "12", "7a", '"q \\" w"', '"\\\\"', "\\", '"', "null", "-3", "\n"]
    bodies = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(3000)] + [None, ""]
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").withColumn("ix", jsonx.index(F.col("b")))
    rows = rows.select("b", *[jsonx.json_value(F.col("b"), k).alias(f"w{i}") for i, k in enumerate(keys)], *[jsonx.indexed(F.col("ix"), k).alias(f"g{i}") for i, k in enumerate(keys)])
    some = 0
    for r in rows.collect():
        for i in range(len(keys)):
            assert r[f"w{i}"] == r[f"g{i}"], (r["b"], keys[i])
            some += r[f"w{i}"] is not None
    assert some > 100


def test_only_what_is_asked_for_is_decoded(spark):
    """The decoders' expressions stand above the semi-join, and a bucketed snapshot isn't moved."""
    answers = spark.range(4000).select(F.lit("OpenAlex").alias("source"), F.lit("doi").alias("lookup_kind"), F.concat(F.lit("10.1/"), F.col("id").cast("string")).alias("lookup_key"), F.lit(200).alias("status"), F.concat(F.lit('{"title":"T'), F.col("id").cast("string"), F.lit('"}')).alias("body"))
    entries = spark.range(0, 8000, 400).select(F.lit("s").alias("source_path"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("10.1/"), F.col("id").cast("string")).alias("doi"), *[F.lit(None).cast("string").alias(c) for c in ("title", "author", "year")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sql("DROP TABLE IF EXISTS snapshot_test")
    try:
        table = bib.write_snapshot(answers, "snapshot_test", 4)
        asked = enrich.lookups(entries)
        assert enrich.wanted(table, asked).count() == 10
        decoded = enrich.candidates(enrich.wanted(table, asked))
        plan = decoded._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("LeftSemi") > plan.index("AS candidate")  # below it
        moved = decoded._jdf.queryExecution().executedPlan().toString()
        scan = moved[: moved.index("snapshot_test")].rstrip().splitlines()
        assert "SortMergeJoin" in moved and "Exchange" not in scan[-1] and "Exchange" not in scan[-2]
        exchanges = [x for x in moved.splitlines() if "Exchange hashpartitioning" in x]
        assert exchanges and not any("body" in x for x in exchanges)
        got = {r["ord"]: r["candidate"]["title"] for r in enrich.hits(entries, table).collect()}
        assert got == {i: f"T{i}" for i in range(0, 4000, 400)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS snapshot_test")


def test_cascade_modes(spark):
    entries = spark.createDataFrame([("s", 0, "@misc{a, doi={10.1/x}, year={1999}, title={Old}}"), ("s", 1, "@misc{b, title={Title not known to anyone}}"), ("s", 2, "@misc{c, note={n}}")], "source_path string, ord int, raw string")
    body = '{"title":["New"],"DOI":"10.1/x","type":"journal-article","volume":"7","published-print":{"date-parts":[[2000,3]]}}'
    answers = spark.createDataFrame([("CrossRef", "doi", "10.1/x", 200, body), ("OpenAlex", "doi", "10.1/x", 500, "{}")], bib.RESPONSE)
    run = lambda mode: {r["ord"]: (r["status"], r["corrected"]) for r in enrich.verify(entries, answers, mode, "ABBREV_DOT").collect()}
    safe = run("SAFE")
    assert safe[0] == ("CORRECTED", "@article{a,\n  title = {Old},\n  year = {1999},\n  month = {Mar.},\n  volume = {7},\n  doi = {10.1/x},\n}")
    assert safe[1][0] == "NOT_FOUND" and safe[2][0] == "SKIPPED"
    assert "year = {2000}" in run("AGGRESSIVE_DOI_ONLY")[0][1]
    again = entries.where("ord = 0").withColumn("raw", F.lit(safe[0][1]))
    assert [r["status"] for r in enrich.verify(again, answers, "SAFE", "ABBREV_DOT").collect()] == ["VERIFIED"]


def test_entries_and_responses_that_cant_be_read(spark):
    entries = spark.createDataFrame([("s", 0, None), ("s", 1, ""), ("s", 2, "@misc{a, doi={10.1/x}, title={A title of letters}}")], "source_path string, ord int, raw string")
    answers = spark.createDataFrame([("CrossRef", "doi", "10.1/x", 200, None), ("OpenAlex", "doi", "10.1/x", 0, None), ("Semantic Scholar", "title", "A title of letters", 429, "{}")], bib.RESPONSE)
    told = {r["ord"]: (r["status"], r["corrected"], r["message"]) for r in enrich.verify(entries, answers).collect()}
    assert told[0] == ("ERROR", None, "Error: no entry") and told[1][0] == "SKIPPED" and told[2][0] == "NOT_FOUND"
    none = spark.createDataFrame([], "source_path string")
    assert [r["errors"] for r in render.status_summary(enrich.verify(entries, answers), none).collect()] == [1]


def test_fetching_makes_a_snapshot(spark):
    rows = spark.createDataFrame([(f"10.1/{i}", f"Title number {i}") for i in range(4)], "doi string, title string")
    asked = rows.select(F.inline(tx.request_urls(F.col("doi"), F.col("title"))), "doi", "title")
    asked = asked.select("source", "lookup_kind", F.when(F.col("lookup_kind") == "doi", F.col("doi")).otherwise(F.col("title")).alias("lookup_key"), "url").where("source = 'CrossRef' AND lookup_kind = 'doi'")

    def get(url):
        n = int(url[-1])
        return (200, '{"title":["T%d"],"DOI":"10.1/%d"}' % (n, n)) if n < 2 else ((404, "none") if n == 2 else (500, None))

    got = bib.fetch(asked, get)
    assert got.columns == [c.split()[0] for c in bib.RESPONSE.split(", ")] and sorted(r["status"] for r in got.collect()) == [200, 200, 404, 500]
    # what isn't 200 is no candidate, and nothing is asked for twice
    assert sorted(r["candidate"]["title"] for r in enrich.candidates(got).collect()) == ["T0", "T1"] and got.count() == 4


def test_extraction_from_files(spark, tmp_path):
    lines = [f'[{i}] Smith, J. "A title with number {i}." Annals ({1990 + i}), doi:10.1234/x{i}.' for i in range(1, 7)]
    (tmp_path / "a.PDF").write_bytes("\n".join(["Text.", "References", *lines]).encode("utf-16"))
    (tmp_path / "b.pdf").write_bytes("No such section.".encode("utf-16"))
    (tmp_path / "c.txt").write_bytes(b"References")
    answers = spark.createDataFrame([("CrossRef", "doi", "10.1234/x1", 200, '{"title":["A title with number 1"],"publisher":"House"}')], bib.RESPONSE)
    out = {r["doc_id"][-5:].lower(): r for r in refs.extract_from_files(spark, str(tmp_path), lambda b: b.decode("utf-16"), answers).collect()}
    assert set(out) == {"a.pdf", "b.pdf"}
    a = out["a.pdf"]
    assert (a["total_found"], a["converted"], a["errors"]) == (6, 1, 5)
    blocks = a["bibtex_output"].split("\n\n")
    assert blocks[0] == "% References extracted from PDF\n% Generated by bibspark" and blocks[1].startswith("@misc{ref1,") and "House" in blocks[1]
    assert [x.startswith("% WARNING: Could not verify this reference\n@misc{smith") for x in blocks[2:7]] == [True] * 5 and blocks[7] == ""
    assert out["b.pdf"]["bibtex_output"] == "" and out["b.pdf"]["messages"] == ["Could not locate references section in the document."]


def test_whole_files_come_back(spark):
    """Entries keep their text byte for byte, and rebuilt ones keep every field and value."""
    text = "\n % a comment\n @inproceedings{a1,\n  title={Cats \\& dogs: {A {nested} one}},\n  organization = \"Some {\\\"o}rg\",\n  month = sep,\n  note={x, y = z}\n}\n@string{s = {t}}\n@article(b2, title={Paren (s)}, pages={1--2})\n"
    rows = parse.entries(bib.inline(spark, [("f", text)])).orderBy("ord").collect()
    assert [(r["type"], r["key"]) for r in rows] == [("inproceedings", "a1"), ("article", "b2")]
    assert all(r["raw"] in text for r in rows)
    for r in rows:
        one = spark.createDataFrame([("f", 0, r["type"], r["key"], r["raw"])], "source_path string, ord int, type string, key string, raw string")
        fields = lambda df: {x["name"]: x["value"] for x in parse.field_rows(df).collect()}
        from bibspark.functions import scanner

        again = one.withColumn("raw", render.rebuild_entry(F.col("type"), F.col("key"), scanner.parse_fields(F.col("raw"))))
        assert fields(again) == fields(one) and len(fields(one)) >= 2


def test_search(spark):
    out = spark.createDataFrame([("s", "% head\n\n@a{x}\n\n@b{y}\n\n")], "source_path string, output string")
    assert [tuple(r)[1:] for r in render.search(out, " @A ").collect()] == [("@a{x}\n\n", 1)]
    assert render.search(out, " ").collect()[0]["output"] == "% head\n\n@a{x}\n\n@b{y}\n\n"


def test_sources(spark, tmp_path):
    (tmp_path / "a.BIB").write_text("@a{k,\n x={1}}")
    (tmp_path / "b.txt").write_text("@a{z, x={1}}")
    got = parse.entries(bib.read_bib(spark, str(tmp_path))).collect()
    assert [r["key"] for r in got] == ["k"]
    path = render.save(spark.createDataFrame([("@a{k}",)], "output string"), str(tmp_path / "out"))
    assert path.endswith("out.bib") and spark.read.text(path).count() == 1


def test_stream(spark, tmp_path):
    from bibspark.streaming import ingest

    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    (folder / "1.bib").write_text("@a{k, title={some title of length}}@a{l, title={another title here}}")
    ingest.follow(spark, str(folder), table, str(tmp_path / "c")).awaitTermination()
    (folder / "2.bib").write_text("@a{m, title={Some title of LENGTH}}@a{n, title={a third title here}}@a{k, title={x}}")
    ingest.follow(spark, str(folder), table, str(tmp_path / "c")).awaitTermination()
    assert sorted(r["key"] for r in spark.read.parquet(table).collect()) == ["k", "l", "n"]
