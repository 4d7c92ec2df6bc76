"""The queries of the engine, and the SQL that each is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from bibspark.functions import jsonx, months, scanner
from bibspark.functions import text as tx
from bibspark.operators import dedupe, enrich, parse, refs, render, splits
from bibspark.plans import corpus
from bibspark.plans.corpus import BIB, ESCAPED, FILES, LIBRARIES, LIBRARY, REFS, SIGNED, UNSEEN, UNSEEN_NOTE, fold, table
from bibspark.sources import bib, pdf
from bibspark.storage import materialize, shared_dir

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _entries(spark, sf_dir):
    return parse.entries(corpus.bib_sources(spark, sf_dir))


def _numbers(df, *cols):
    return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


# Parsing


@query(f"WITH {BIB} SELECT source_path, CAST(ord AS BIGINT) AS ord, 'article' AS type, key FROM bib")
def parse_entries(spark, sf_dir):
    return _numbers(_entries(spark, sf_dir).select("source_path", "ord", "type", "key"))


@query(f"WITH {BIB} SELECT source_path, CAST(row_number() OVER (PARTITION BY source_path ORDER BY ord) - 1 AS BIGINT) AS ord, 'NO_KEY' AS code, 'misc' AS type FROM bib WHERE doc_id % 23 = 0")
def parse_errors(spark, sf_dir):
    return _numbers(parse.errors(corpus.bib_sources(spark, sf_dir)).select("source_path", "ord", "code", "type"))


@query(f"WITH {BIB} SELECT source_path, count(*) AS entries, CAST(count(*) FILTER (doc_id % 23 = 0) AS BIGINT) AS errors FROM bib GROUP BY source_path")
def parse_skip_constructs(spark, sf_dir):
    rows = parse.parsed(corpus.bib_sources(spark, sf_dir))
    return _numbers(rows.select("source_path", F.size("parsed.entries").alias("entries"), F.size("parsed.errors").alias("errors")))


@query(f"WITH {BIB} SELECT source_path, CAST(ord AS BIGINT) AS ord, title, CASE WHEN NOT {UNSEEN} THEN year END AS year, CASE WHEN NOT {UNSEEN} THEN month END AS month, CASE WHEN NOT {UNSEEN_NOTE} THEN 'n' || CAST(doc_id AS VARCHAR) END AS note FROM bib")
def extract_fields(spark, sf_dir):
    return _numbers(parse.fields(_entries(spark, sf_dir), "title", "year", "month", "note").select("source_path", "ord", "title", "year", "month", "note"))


@query(f"""WITH {BIB} SELECT source_path, CAST(ord AS BIGINT) AS ord, CAST(i - 1 AS BIGINT) AS pos, ['title', 'year', 'month', 'note'][CAST(i AS INT)] AS name,
  [title, year, month, 'n' || CAST(doc_id AS VARCHAR)][CAST(i AS INT)] AS value FROM bib, range(1, 5) g(i)""")
def parse_all_fields(spark, sf_dir):
    return _numbers(parse.field_rows(_entries(spark, sf_dir)))


@query(f"WITH {BIB} SELECT source_path, CAST(ord AS BIGINT) AS ord, key AS shown FROM bib")
def display_key(spark, sf_dir):
    return _numbers(_entries(spark, sf_dir).select("source_path", "ord", tx.display_key(F.col("raw")).alias("shown")))


@query(f"""WITH p AS (SELECT doc_id, {ESCAPED} AS t FROM documents) SELECT CAST(doc_id AS VARCHAR) AS source_path, 1::BIGINT AS entries, 'UNCLOSED' AS code,
  CAST(length('@misc{{u' || doc_id || ', title={{' || t || '}}}} ') AS BIGINT) AS start, 'book' AS type, 'Unclosed entry starting at index ' || length('@misc{{u' || doc_id || ', title={{' || t || '}}}} ') || ' (@book)' AS message FROM p""")
def parse_unclosed(spark, sf_dir):
    """An entry that doesn't end is an error, and ends the source."""
    rows = corpus.escaped_texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_path"), "t")
    content = F.concat(F.lit("@misc{u"), "source_path", F.lit(", title={"), "t", F.lit("}} @Book{v, title={"), "t", F.lit("} @misc{w, title={never reached}}"))
    told = parse.parsed(rows.select("source_path", content.alias("content")))
    return _numbers(told.select("source_path", F.size("parsed.entries").alias("entries"), F.inline("parsed.errors")).drop("ord"))


@query(f"WITH p AS (SELECT doc_id, {ESCAPED} AS t FROM documents) SELECT doc_id, 'u' || doc_id AS key, '@misc{{u' || doc_id || ', t={{' || t || '}}}}' AS raw FROM p WHERE doc_id % 3 > 0")
def parse_false_starts(spark, sf_dir):
    """An ``@`` that begins no entry is passed over, and so is the character behind the word that follows it: where that is the ``@`` of
    an entry (every third text), the entry is lost."""
    rows = corpus.escaped_texts(spark, sf_dir)
    lost = F.when(F.col("doc_id") % 3 == 0, F.lit("@lost ")).otherwise(F.lit(""))
    content = F.concat(F.lit("write to mail@host, @ or @book title @@ \n"), lost, F.lit("@misc{u"), F.col("doc_id").cast("string"), F.lit(", t={"), "t", F.lit("}} and @ @(x) @end"))
    told = parse.entries(rows.select(F.col("doc_id").cast("string").alias("source_path"), content.alias("content")))
    return told.select(F.col("source_path").cast("long").alias("doc_id"), "key", "raw")


@query(f"WITH {BIB} SELECT source_path, CAST(ord AS BIGINT) AS ord, key FROM bib")
def read_files(spark, sf_dir):
    """The files written and read again, each as a whole; their names are escaped as folders, and folders as addresses."""
    path = f"{shared_dir(spark)}/bibspark/files-{uuid.uuid4().hex}"
    rows = corpus.bib_sources(spark, sf_dir)
    rows.select("source_path", F.col("content").alias("value")).write.partitionBy("source_path").text(path)
    read = bib.read_bib(spark, path, suffix=".txt").withColumn("name", F.regexp_extract("source_path", "source_path=([^/]*)", 1))
    return _numbers(parse.entries(read.select(F.url_decode(F.url_decode("name")).alias("source_path"), "content")).select("source_path", "ord", "key"))


# De-duplication


def _library(spark, sf_dir):
    return corpus.library(_entries(spark, sf_dir))


@query(f"WITH {BIB} SELECT source AS source_path, CAST({LIBRARY} AS BIGINT) AS ord, key FROM bib QUALIFY row_number() OVER (PARTITION BY source, key ORDER BY doc_id) = 1")
def dedupe_key(spark, sf_dir):
    return _numbers(dedupe.unique(_library(spark, sf_dir), smart=False).select("source_path", "ord", "key"))


@query(f"WITH RECURSIVE {LIBRARIES} SELECT source_path, CAST(place AS BIGINT) AS ord, key FROM fold WHERE reason IS NULL")
def dedupe_smart(spark, sf_dir):
    return _numbers(dedupe.unique(_library(spark, sf_dir)).select("source_path", "ord", "key"))


@query(f"WITH RECURSIVE {fold("'all'", LIBRARY)} SELECT s.source AS source_path, CAST(fold.place AS BIGINT) AS ord, fold.key, fold.kept_key, fold.reason FROM fold JOIN s USING (doc_id)")
def dedupe_smart_corpus(spark, sf_dir):
    """By rounds, but for the last hundred."""
    return _numbers(dedupe.judged(_library(spark, sf_dir), scope="corpus", finish=100).select("source_path", "ord", "key", "kept_key", "reason"))


@query("""WITH RECURSIVE s AS (SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS ord, p_brand || CAST(p_size % 7 AS VARCHAR) AS key, CASE WHEN length(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')) >= 10 THEN regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') END AS sig FROM part),
fold AS (SELECT ord, [key] AS ks, CASE WHEN sig IS NULL THEN []::VARCHAR[] ELSE [sig] END AS ss, true AS kept FROM s WHERE ord = 0 UNION ALL
  SELECT ord, CASE WHEN x THEN ks ELSE list_append(ks, key) END, CASE WHEN x OR sig IS NULL THEN ss ELSE list_append(ss, sig) END, NOT x FROM
  (SELECT s.*, f.ks, f.ss, list_contains(f.ks, s.key) OR coalesce(list_contains(f.ss, s.sig), false) AS x FROM fold f JOIN s ON s.ord = f.ord + 1))
SELECT count(*) AS total, CAST(count(*) FILTER (kept) AS BIGINT) AS kept, CAST(sum(ord) FILTER (kept) AS BIGINT) AS places FROM fold""")
def dedupe_rounds_on_part(spark, sf_dir):
    """The rounds over a table with few titles: many entries hang together."""
    part = table(spark, sf_dir, "part")
    least = part.agg(F.min("p_partkey").alias("m"))
    rows = part.crossJoin(F.broadcast(least)).select(F.lit("part").alias("source_path"), (F.col("p_partkey") - F.col("m")).cast("int").alias("ord"), F.concat("p_brand", (F.col("p_size") % 7).cast("string")).alias("key"), F.concat(F.lit("@misc{k, title={"), "p_name", F.lit("}}")).alias("raw"))
    told = dedupe.judged(rows, scope="corpus", finish=100)
    return told.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("reason").isNull()).alias("kept"), F.sum(F.when(F.col("reason").isNull(), F.col("ord"))).alias("places"))


@query("SELECT o_orderkey AS ord, 'c' || CAST((o_orderkey + 1) // 2 AS VARCHAR) AS key, CASE WHEN o_orderkey % 2 = 1 THEN 'c' || CAST(o_orderkey // 2 AS VARCHAR) END AS kept_key, CASE WHEN o_orderkey % 2 = 1 THEN 'TITLE_DUPLICATE' END AS reason FROM orders")
def dedupe_chain_on_orders(spark, sf_dir):
    """One chain of all orders: each meets the one before, by key or by title, so that every second stays."""
    number = F.col("o_orderkey")
    raw = F.concat(F.lit("@misc{k, title={Chained order number "), F.expr("CAST(o_orderkey DIV 2 AS STRING)"), F.lit("}}"))
    rows = table(spark, sf_dir, "orders").select(F.lit("orders").alias("source_path"), number.cast("int").alias("ord"), F.concat(F.lit("c"), F.expr("CAST((o_orderkey + 1) DIV 2 AS STRING)")).alias("key"), raw.alias("raw"))
    return _numbers(dedupe.judged(rows, scope="corpus").select("ord", "key", "kept_key", "reason"))


@query(f"WITH RECURSIVE {LIBRARIES} SELECT source_path, CAST(place AS BIGINT) AS ord, key AS dropped_key, kept_key, reason FROM fold WHERE reason IS NOT NULL")
def duplicates_log(spark, sf_dir):
    return _numbers(dedupe.duplicates(_library(spark, sf_dir)))


@query(f"""WITH RECURSIVE {LIBRARIES} SELECT source_path, count(*) AS total, CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS "unique", CAST(count(*) FILTER (reason IS NOT NULL) AS BIGINT) AS duplicates,
  (SELECT CAST(count(*) AS BIGINT) FROM bib b WHERE b.source = fold.source_path AND b.doc_id % 23 = 0) AS parse_errors FROM fold GROUP BY source_path
  UNION ALL SELECT 'empty', 0, 0, 0, 0""")
def dedupe_summary(spark, sf_dir):
    """With a source that holds nothing."""
    sources = corpus.bib_sources(spark, sf_dir).unionByName(spark.createDataFrame([("empty/0", "% nothing here")], "source_path string, content string"))
    counts = corpus.library(parse.counts(sources)).groupBy("source_path").agg(F.sum("parse_errors").alias("parse_errors"))
    return dedupe.summary_of(corpus.library(parse.entries(sources)), counts)


@query(f"WITH RECURSIVE {LIBRARIES} SELECT source_path, count(*) AS total, NULL::VARCHAR AS message FROM fold GROUP BY source_path UNION ALL SELECT 'empty', 0, 'No reference entries found.'")
def no_entries_outcome(spark, sf_dir):
    return dedupe.outcome(dedupe_summary(spark, sf_dir)).select("source_path", "total", "message")


@query(f"WITH RECURSIVE {LIBRARIES} SELECT row_number() OVER (ORDER BY source_path, key, place) - 1 AS pos, source_path, key FROM fold WHERE reason IS NULL")
def sorted_output(spark, sf_dir):
    """``pos`` is a row's place in the result as it is sorted: parts of it follow each other, and rows within a part."""
    rows = dedupe.unique(_library(spark, sf_dir), sort_by_key=True).select("source_path", "key").withColumn("at", F.monotonically_increasing_id())
    parts = rows.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each part
    placed = rows.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(before), "part")
    return placed.select((F.col("before") + F.col("at") - F.shiftleft("part", 33)).alias("pos"), "source_path", "key")


@query("SELECT row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END, lpad(CAST(c_custkey AS VARCHAR), 9, '0')) - 1 AS pos, 'nation' || c_nationkey AS source_path, CASE c_custkey % 3 WHEN 0 THEN chr(128512) WHEN 1 THEN chr(65533) ELSE 'a' END || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS key FROM customer")
def sorted_by_utf16(spark, sf_dir):
    """Keys that begin with U+1F600, whose first unit is less than U+FFFD."""
    first = F.when(F.col("c_custkey") % 3 == 0, F.lit("\U0001f600")).when(F.col("c_custkey") % 3 == 1, F.lit("\ufffd")).otherwise(F.lit("a"))
    key = F.concat(first, F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    path = F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select(path.alias("source_path"), F.col("c_custkey").cast("int").alias("ord"), key.alias("key"), F.lit("@misc{x}").alias("raw"))
    out = dedupe.unique(rows, smart=False, sort_by_key=True).select("source_path", "key").withColumn("at", F.monotonically_increasing_id())
    return out.select((F.row_number().over(Window.partitionBy("source_path").orderBy("at")) - 1).cast("long").alias("pos"), "source_path", "key")


@query("SELECT CAST(doc_id AS VARCHAR) AS source_path, doc_id % 3 > 0 AS whole, CASE WHEN doc_id % 3 = 0 THEN 'Failed to load file.' END AS message FROM documents")
def rejected_sources(spark, sf_dir):
    """Every third text ends in a byte that begins a character, or has one that is none."""
    odd = F.when(F.col("doc_id") % 6 == 0, F.unhex(F.lit("C3"))).when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("41FF42"))).otherwise(F.unhex(F.lit("41")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_path"), F.concat(F.coalesce("text", F.lit("")).cast("binary"), odd).cast("string").alias("content"), F.concat(F.coalesce("text", F.lit("")), F.lit("A")).alias("was"))
    kept, bad = bib.readable(rows)
    told = kept.select("source_path", (F.col("content") == F.col("was")).alias("whole"), F.lit(None).cast("string").alias("message"))
    return told.unionByName(bad.select("source_path", F.lit(False).alias("whole"), "message"))


# Months

_SPELL = "CASE o_orderkey % 6 WHEN 0 THEN monthname(o_orderdate) WHEN 1 THEN lower(left(monthname(o_orderdate), 3)) WHEN 2 THEN CAST(month(o_orderdate) AS VARCHAR) WHEN 3 THEN '{' || left(monthname(o_orderdate), 3) || '.}' WHEN 4 THEN 'x' ELSE left(monthname(o_orderdate), 3) || '. 12' END"
_SPELL_N = "CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN 12 ELSE month(o_orderdate) END"


def _spelled(spark, sf_dir):
    full = F.get(F.array(*map(F.lit, months.FULL)), F.month("o_orderdate") - 1)
    short = F.left(full, F.lit(3))
    k = F.col("o_orderkey") % 6
    said = F.when(k == 0, full).when(k == 1, F.lower(short)).when(k == 2, F.month("o_orderdate").cast("string")).when(k == 3, F.concat(F.lit("{"), short, F.lit(".}"))).when(k == 4, F.lit("x")).otherwise(F.concat(short, F.lit(". 12")))
    return table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))


@query(f"SELECT o_orderkey, {_SPELL} AS said, CAST({_SPELL_N} AS BIGINT) AS number FROM orders")
def month_parse(spark, sf_dir):
    return _spelled(spark, sf_dir).withColumn("number", months.month_number(F.col("said")).cast("long"))


_NAMES = ", ".join(f"'{m}'" for m in months.FULL)
_SHORT = ", ".join(f"'{m}'" for m in months.ABBREV_DOT)


@query(f"SELECT o_orderkey, coalesce([{_NAMES}][{_SPELL_N}], {_SPELL}) AS full_name, coalesce([{_SHORT}][{_SPELL_N}], {_SPELL}) AS short_name, {_SPELL} AS kept FROM orders")
def month_format(spark, sf_dir):
    rows, n = _spelled(spark, sf_dir), months.month_number(F.col("said"))
    style = lambda s: months.format_month(n, s, F.col("said"))
    return rows.select("o_orderkey", style("FULL_NAME").alias("full_name"), style("ABBREV_DOT").alias("short_name"), style("KEEP_ORIGINAL").alias("kept"))


@query(f"SELECT o_orderkey, [{_NAMES}][month(o_orderdate)] AS name FROM orders")
def month_from_iso(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", months.iso_month(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("name"))


@query(f"""WITH {BIB} SELECT source_path, CAST(ord AS BIGINT) AS ord, CASE WHEN NOT {UNSEEN} THEN ['Jan.', 'Feb.', 'Mar.', 'Apr.', 'May', 'Jun.', 'Sep.', 'Mar.', '13', 'Dec.'][CAST(doc_id % 10 + 1 AS INT)] END AS month, title FROM bib""")
def month_rewrite(spark, sf_dir):
    rows = dedupe.normalize_months(_entries(spark, sf_dir), "ABBREV_DOT")
    return _numbers(parse.fields(rows, "month", "title").select("source_path", "ord", "month", "title"))


# Text


@query(f"WITH {SIGNED} SELECT doc_id, sig AS signature FROM s")
def title_signature(spark, sf_dir):
    return corpus.bib_rows(spark, sf_dir).select("doc_id", tx.title_signature(F.col("title")).alias("signature"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[\s\x0B]+', ' ', 'g'), '[{}]', '', 'g')) AS form FROM documents")
def compare_normal_form(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.compare_form(F.col("text")).alias("form"))


@query(r"""SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '\&'), '%', '\%'), '$', '\$'), '#', '\#'), '_', '\_'), '{', '\{'), '}', '\}'), '~', '\~{}'), '^', '\^{}') AS safe FROM documents""")
def escape_bibtex(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.escape_bibtex(F.col("text")).alias("safe"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '^[A-Z][a-z]+') THEN lower(regexp_extract(text, '^[A-Z][a-z]+')) ELSE 'ref' END
  || CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE CAST(2000 + doc_id % 25 AS VARCHAR) END
  || coalesce(lower(list_filter(regexp_split_to_array(text, '[\s\x0B]+'), lambda w: regexp_full_match(w, '[A-Za-z]{5,}'))[1]), '') AS key FROM documents""")
def generate_key(spark, sf_dir):
    year = F.when(F.col("doc_id") % 3 != 0, (2000 + F.col("doc_id") % 25).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.generate_key(F.col("text"), year, F.col("doc_id"), F.col("text")).alias("key"))


_KINDS = ["journal-article", "Article", "book", "book-chapter", "chapter", "proceedings-article", "proceedings", "dissertation", "thesis", "report", "dataset"]
_KIND_LIST = ", ".join(f"'{k}'" for k in _KINDS)


@query(f"SELECT p_partkey, ['article', 'article', 'book', 'incollection', 'incollection', 'inproceedings', 'inproceedings', 'phdthesis', 'phdthesis', 'techreport', 'misc'][CAST(p_partkey % 11 + 1 AS INT)] AS type FROM part")
def type_mapping(spark, sf_dir):
    kind = F.expr(f"element_at(array({_KIND_LIST}), CAST(p_partkey % 11 + 1 AS INT))")
    return table(spark, sf_dir, "part").select("p_partkey", tx.entry_type(kind).alias("type"))


_AUTHORS = "CASE c_custkey % 7 WHEN 0 THEN 'Smith, Ann and Bo Li' WHEN 1 THEN 'Single' WHEN 2 THEN '' WHEN 3 THEN 'Optimal Control, A' WHEN 4 THEN 'Doe, J (ed)' WHEN 5 THEN repeat('Doe, Jane and ', 21) || 'Doe, Jane' ELSE repeat('x', 79) || ', y' END"


@query("SELECT c_custkey, c_custkey % 7 = 0 AS ok FROM customer")
def author_valid(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_AUTHORS} AS a").select("c_custkey", tx.plausible_authors(F.col("a")).alias("ok"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Customer' || CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'C, Ann B' ELSE 'Lee, Kim' END AS inverted, CASE c_custkey % 3 WHEN 1 THEN 'C' WHEN 0 THEN 'Customer' || CAST(c_custkey AS VARCHAR) ELSE 'Lee' END AS surname FROM customer")
def authors_invert(spark, sf_dir):
    name = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('Customer', CAST(c_custkey AS STRING)) WHEN 1 THEN 'Ann B C' ELSE 'Kim Lee' END")
    authors = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('{Customer', CAST(c_custkey AS STRING), '}') WHEN 1 THEN 'Ann B C and Bo Li' ELSE 'Lee, Kim and Bo Li' END")
    return table(spark, sf_dir, "customer").select("c_custkey", tx.invert_name(name).alias("inverted"), tx.surname(authors).alias("surname"))


_ASKED = {
    "crossref_doi": "'https://api.crossref.org/works/10.5555%2F' || s_suppkey",
    "s2_doi": "'https://api.semanticscholar.org/graph/v1/paper/DOI:10.5555%2F' || s_suppkey || '?fields=title,authors,year,venue,publicationDate,externalIds,journal,volume,pages'",
    "openalex_doi": "'https://api.openalex.org/works/https://doi.org/10.5555/' || s_suppkey",
    "crossref_title": "'https://api.crossref.org/works?query.title=On+supplier+' || s_suppkey || '&rows=1'",
    "s2_title": "'https://api.semanticscholar.org/graph/v1/paper/search?query=On+supplier+' || s_suppkey || '&fields=title,authors,year,venue,publicationDate,externalIds,journal,volume,pages&limit=1'",
    "openalex_title": "'https://api.openalex.org/works?filter=title.search:On+supplier+' || s_suppkey || '&per_page=1'",
    "crossref_author_year": "'https://api.crossref.org/works?query.author=Lovelace&filter=from-pub-date:' || (1990 + s_suppkey % 9) || ',until-pub-date:' || (1990 + s_suppkey % 9) || '&query.title=On+supplier+' || s_suppkey || '&rows=3'",
}


@query(f"SELECT s_suppkey, {', '.join(f'{v} AS {k}' for k, v in _ASKED.items())} FROM supplier")
def request_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat('10.5555/', CAST(s_suppkey AS STRING)) AS doi", "concat('On {supplier} ', CAST(s_suppkey AS STRING)) AS title", "CAST(1990 + s_suppkey % 9 AS STRING) AS year")
    urls = tx.request_urls(F.col("doi"), F.col("title"))
    pick = lambda s, k: F.filter(urls, lambda u: (u["source"] == s) & (u["lookup_kind"] == k))[0]["url"]
    short = {"CrossRef": "crossref", "Semantic Scholar": "s2", "OpenAlex": "openalex"}
    last = tx.author_year_url(F.lit("Ada Lovelace and Alan Turing"), F.col("year"), F.col("title"))
    return rows.select("s_suppkey", *[pick(s, k).alias(f"{n}_{k}") for k in ("doi", "title") for s, n in short.items()], last.alias("crossref_author_year"))


# JSON


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS absent FROM events")
def json_string(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", jsonx.json_value(F.col("props"), "K").alias("k"), jsonx.json_value(F.col("props"), "absent").alias("absent"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind FROM events")
def json_nested(spark, sf_dir):
    body = F.concat(F.lit('{"k":"no","outer":{"inner": "'), "event_type", F.lit('", "k": ['), F.lit('"'), jsonx.json_value(F.col("props"), "k"), F.lit('"]}}'))
    rows = table(spark, sf_dir, "events").select("event_id", body.alias("b"))
    return rows.select("event_id", jsonx.nested_value(F.col("b"), "outer", "k").alias("k"), jsonx.nested_value(F.col("b"), "outer", "inner").alias("kind"))


def _decoded(source):
    cols = ", ".join(f"CAST({corpus.ANSWERS[source].get(f, 'NULL')} AS VARCHAR) AS {f}" for f in corpus.FIELDS)
    sql = f"SELECT '10.5555/' || CAST(p_partkey AS VARCHAR) AS lookup_key, {cols} FROM part WHERE ({corpus.ANSWERS[source]['when']}) AND p_partkey % 4 <> 0"

    def run(spark, sf_dir):
        rows = corpus.responses(spark, sf_dir).where(f"source = '{source}' AND lookup_kind = 'doi'")
        return enrich.candidates(rows).select("lookup_key", *[f"candidate.{f}" for f in corpus.FIELDS])

    return run, sql


for _name, _source in (("crossref_decode", "CrossRef"), ("s2_decode", "Semantic Scholar"), ("openalex_decode", "OpenAlex")):
    QUERIES[_name], ORACLES[_name] = _decoded(_source)

# References


def _sections(spark, sf_dir):
    return corpus.ref_documents(spark, sf_dir).select("doc_id", refs.find_section(F.col("content")).alias("section"))


_BODY = """string_agg(CASE style WHEN 'bracket' THEN '[' || CAST(number AS VARCHAR) || '] ' WHEN 'dot' THEN CAST(number AS VARCHAR) || '. ' WHEN 'plain' THEN CAST(number AS VARCHAR) || ' ' ELSE '' END || text || CASE WHEN style = 'blank' AND pos + 1 < n THEN chr(10) ELSE '' END,
  chr(10) ORDER BY number)"""


@query(f"WITH {REFS} SELECT doc_id, {_BODY} AS section FROM r GROUP BY doc_id, style UNION ALL SELECT DISTINCT CAST((c_custkey - c_custkey % 10) / 10 AS BIGINT), NULL FROM customer WHERE CAST((c_custkey - c_custkey % 10) / 10 AS BIGINT) % 11 = 10")
def find_section(spark, sf_dir):
    return _sections(spark, sf_dir)


@query(r"""SELECT page_id, regexp_matches(html, '(?im)^\s*(?:References|Bibliography|Works\s+Cited|Literature\s+Cited|Citations)\s*$')
  OR len(regexp_extract_all(substr(html, CAST(floor(length(html) * 2 / 3) AS BIGINT) + 1), '(?m)^\s*\[\d+\]\s*[^\s]')) >= 3 AS has_references FROM pages""")
def find_section_in_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", refs.find_section(F.col("html")).isNotNull().alias("has_references"))


@query(f"""WITH {REFS}, b AS (SELECT doc_id, string_agg('[' || number || '] ' || text, chr(10) ORDER BY number) AS body, count(*) AS n FROM refs GROUP BY doc_id)
SELECT doc_id, CASE WHEN n >= 3 THEN body END AS section FROM b""")
def find_section_fallback(spark, sf_dir):
    """Without a heading, the last third of a text counts if it has three references in brackets."""
    rows = corpus.ref_rows(spark, sf_dir).where("doc_id % 11 <> 10")
    line = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), "text")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("t")))), lambda r: r["t"]), "\n")
    docs = rows.groupBy("doc_id").agg(body.alias("body"))
    content = F.concat(F.repeat(F.lit("on "), ((F.length("body") * 2 - 1) / 3).cast("int")), F.repeat(F.lit("."), ((F.length("body") * 2 - 1) % 3).cast("int")), F.lit("\n"), "body")
    return docs.select("doc_id", refs.find_section(content).alias("section"))


_LEAD = "CASE style WHEN 'bracket' THEN '[' || CAST(number AS VARCHAR) || '] ' WHEN 'dot' THEN CAST(number AS VARCHAR) || '. ' WHEN 'plain' THEN CAST(number AS VARCHAR) || ' ' ELSE '' END"
_OWN = "SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST({number} AS BIGINT) AS number, {text} AS text FROM r WHERE style IN ({styles})"
_ONE = f"SELECT doc_id, 0::BIGINT, 1::BIGINT, string_agg({_LEAD} || text, ' ' ORDER BY number) FROM r WHERE style {{styles}} GROUP BY doc_id"
#: What each way gives of sections of all five styles.
_WAYS = {
    "bracket": _OWN.format(number="number", text="text", styles="'bracket'"),
    "dot": _OWN.format(number="number", text="text", styles="'dot'"),
    "plain": _OWN.format(number="number", text="text", styles="'plain', 'dot'"),
    "blank": _OWN.format(number="pos + 1", text="text", styles="'blank'") + " UNION ALL " + _ONE.format(styles="<> 'blank'"),
    "author": _OWN.format(number="pos + 1", text=f"{_LEAD} || text", styles="'author', 'blank', 'dot', 'plain'") + " UNION ALL " + _ONE.format(styles="= 'bracket'"),
}


def _split(style):
    def run(spark, sf_dir):
        rows = _sections(spark, sf_dir).select("doc_id", F.posexplode(refs.WAYS[style](F.col("section"))).alias("pos", "r"))
        return _numbers(rows.select("doc_id", "pos", "r.number", "r.text"))

    return run, f"WITH {REFS} {_WAYS[style]}"


for _style in refs.STRATEGIES:
    QUERIES[f"split_{_style}"], ORACLES[f"split_{_style}"] = _split(_style)


@query(f"""WITH {REFS} SELECT doc_id, CASE WHEN style = 'blank' AND n < 3 THEN 'author' WHEN style NOT IN ('blank', 'author') AND n < 5 THEN 'author' ELSE style END AS strategy, n AS refs FROM r GROUP BY ALL""")
def strategy_choice(spark, sf_dir):
    """Sections of ten references; shorter ones are at the ends of the table."""
    rows = _sections(spark, sf_dir).where("section IS NOT NULL").select("doc_id", refs.split_references(F.col("section")).alias("s"))
    return rows.select("doc_id", "s.strategy", F.size("s.refs").cast("long").alias("refs"))


@query(f"WITH {REFS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, text, doi, year, title FROM r")
def reference_details(spark, sf_dir):
    return _numbers(refs.raw_references(corpus.ref_documents(spark, sf_dir)).select("doc_id", "pos", "text", "doi", "year", "title"))


@query(f"WITH {REFS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, text, doi, year, title FROM r")
def pdf_references(spark, sf_dir):
    """``reference_details`` of the same documents as PDF files, whose references cross pages. There are no blank lines in these."""
    files = corpus.ref_documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_path"), corpus.as_pdf(F.col("content")).alias("content"))
    docs = pdf.text(files).select(F.col("source_path").cast("long").alias("doc_id"), "content")
    return _numbers(refs.raw_references(docs).select("doc_id", "pos", "text", "doi", "year", "title"))


_BASIC = "'@misc{' || lower(surname) || year || 'accounts,' || chr(10) || '  title = {' || title || '},' || chr(10) || '  year = {' || year || '},' || chr(10) || '  doi = {' || doi || '},' || chr(10) || '  note = {Extracted from PDF - needs manual verification}' || chr(10) || '}'"


@query(f"WITH {REFS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, {_BASIC} AS entry FROM r")
def render_basic_entry(spark, sf_dir):
    rows = refs.raw_references(corpus.ref_documents(spark, sf_dir))
    return _numbers(rows.select("doc_id", "pos", refs.basic_entry(*[F.col(c) for c in ("number", "text", "doi", "year", "title")]).alias("entry")))


def _ref_answers(spark, sf_dir):
    rows = corpus.ref_rows(spark, sf_dir).where("c_custkey % 2 = 0")
    return rows.selectExpr("'CrossRef' AS source", "'doi' AS lookup_kind", "doi AS lookup_key", "200 AS status", "concat('{\"title\":[\"', title, '\"],\"publisher\":\"House\"}') AS body")


_CONVERTED = f"""{REFS}, v AS (SELECT doc_id, pos, number % 2 = 1 AS verified, CASE WHEN number % 2 = 1 THEN '@misc{{ref' || CASE WHEN style IN ('blank', 'author') THEN CAST(pos + 1 AS VARCHAR) ELSE CAST(number AS VARCHAR) END
  || ',' || chr(10) || '  title = {{' || title || '}},' || chr(10) || '  year = {{' || year || '}},' || chr(10) || '  publisher = {{House}},' || chr(10) || '  doi = {{' || doi || '}},' || chr(10) || '  note = {{Extracted from PDF}},' || chr(10) || '}}'
  ELSE {_BASIC} END AS entry, CASE WHEN number % 2 = 1 THEN 'Reference corrected from CrossRef' ELSE 'Could not find reference in any online source' END AS message FROM r)"""


@query(f"WITH {_CONVERTED} SELECT doc_id, CAST(pos AS BIGINT) AS pos, verified, entry, message FROM v")
def convert_references(spark, sf_dir):
    raw = refs.raw_references(corpus.ref_documents(spark, sf_dir))
    return _numbers(refs.convert(raw, _ref_answers(spark, sf_dir)).select("doc_id", "pos", "verified", "entry", "message"))


@query(f"""WITH {_CONVERTED}, b AS (SELECT doc_id, length({_BODY}) AS size FROM r GROUP BY doc_id, style)
SELECT doc_id, '% References extracted from PDF' || chr(10) || '% Generated by bibspark' || chr(10) || chr(10) || string_agg(CASE WHEN verified THEN '' ELSE '% WARNING: Could not verify this reference' || chr(10) END || entry || chr(10) || chr(10), '' ORDER BY pos) AS bibtex_output,
  count(*) AS total_found, CAST(count(*) FILTER (verified) AS BIGINT) AS converted, CAST(count(*) FILTER (NOT verified) AS BIGINT) AS errors,
  'Found references section (' || any_value(size) || ' characters)|Parsed ' || count(*) || ' raw references|Successfully converted: ' || count(*) FILTER (verified) || '|Verification errors: ' || count(*) FILTER (NOT verified) AS messages FROM v JOIN b USING (doc_id) GROUP BY doc_id
  UNION ALL SELECT DISTINCT CAST((c_custkey - c_custkey % 10) / 10 AS BIGINT) AS d, '', 0, 0, 0, 'Could not locate references section in the document.' FROM customer WHERE CAST((c_custkey - c_custkey % 10) / 10 AS BIGINT) % 11 = 10""")
def extraction_result(spark, sf_dir):
    out = refs.extract(corpus.ref_documents(spark, sf_dir), _ref_answers(spark, sf_dir))
    return out.select("doc_id", "bibtex_output", "total_found", "converted", "errors", F.array_join("messages", "|").alias("messages"))


# Enrichment


def _hits(spark, sf_dir):
    return enrich.hits(corpus.catalogue_entries(spark, sf_dir), corpus.responses(spark, sf_dir))


_PART = "'parts/' || CAST(p_partkey // 1000 AS VARCHAR) AS source_path, CAST(p_partkey % 1000 AS BIGINT) AS ord"


@query(f"WITH {corpus.hits_sql()} SELECT {_PART}, source, CAST(score AS BIGINT) AS score FROM h")
def completeness_score(spark, sf_dir):
    return _numbers(_hits(spark, sf_dir).select("source_path", "ord", "source", enrich.score(F.col("candidate")).alias("score")))


@query(f"WITH {corpus.hits_sql()} SELECT {_PART}, source, CAST(score AS BIGINT) AS score FROM h QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, src) = 1")
def best_candidate(spark, sf_dir):
    return _numbers(enrich.best_candidate(_hits(spark, sf_dir)).select("source_path", "ord", "source", "score"))


_MERGE = f"{corpus.hits_sql()}, o AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, src) = 1 THEN 0 ELSE src END AS o FROM h), m AS (SELECT p_partkey, min(strategy) AS strategy, arg_min(source, o) AS source, {corpus.MERGED_SQL} FROM o GROUP BY p_partkey)"


@query(f"WITH {_MERGE} SELECT {_PART}, source, {', '.join(corpus.FIELDS)} FROM m")
def merge_candidates(spark, sf_dir):
    return _numbers(enrich.merged(_hits(spark, sf_dir)).select("source_path", "ord", "data.source", *[f"data.{f}" for f in corpus.FIELDS]))


@query(f"WITH {corpus.hits_sql()} SELECT {_PART}, CAST(strategy AS BIGINT) AS strategy, count(*) AS hits FROM h GROUP BY ALL")
def lookup_cascade(spark, sf_dir):
    return _numbers(_hits(spark, sf_dir).groupBy("source_path", "ord", "strategy").agg(F.count(F.lit(1)).alias("hits")))


@query(f"WITH {corpus.hits_sql()} SELECT {_PART}, source, CAST(strategy AS BIGINT) AS strategy, title, doi FROM h WHERE p_partkey % 50 < 20")
def lookup_in_snapshot(spark, sf_dir):
    """Two fifths of the entries, in a snapshot that is a bucketed table and holds the answers to all."""
    name = f"snapshot_{uuid.uuid4().hex}"
    snapshot = bib.write_snapshot(corpus.responses(spark, sf_dir), name, 8, f"{shared_dir(spark)}/bibspark/{name}")
    rows = corpus.catalogue_entries(spark, sf_dir).where("p_partkey % 50 < 20")
    return _numbers(enrich.hits(rows, snapshot).select("source_path", "ord", "source", "strategy", "candidate.title", "candidate.doi"))


def _verified(spark, sf_dir, mode, style="FULL_NAME"):
    return enrich.verify(corpus.catalogue_entries(spark, sf_dir), corpus.responses(spark, sf_dir), mode, style)


_KIND = "CASE m.type WHEN 'journal-article' THEN 'article' WHEN 'article' THEN 'article' WHEN 'book-chapter' THEN 'incollection' ELSE 'misc' END"


def _corrected_cte(aggressive: bool) -> str:
    """CTEs up to c: type and fields of the corrected entry of each part that was found."""
    year = "CASE WHEN e.doi IS NOT NULL THEN coalesce(nullif(m.year, ''), e.year) ELSE coalesce(e.year, m.year) END" if aggressive else "coalesce(e.year, m.year)"
    return f"""{_MERGE}, c AS (SELECT m.p_partkey, {_KIND} AS type, e.doi IS NULL AND m.doi IS NOT NULL AS doi_added, coalesce(e.doi, m.doi) AS doi, coalesce(e.author, m.authors) AS author, coalesce(e.title, m.title) AS title, {year} AS year, m.month AS month, m.volume AS volume,
  m.pages AS pages, m.issue AS number, m.publisher AS publisher, CASE WHEN {_KIND} = 'incollection' THEN m.container_title END AS booktitle, CASE WHEN {_KIND} <> 'incollection' THEN m.container_title END AS journal
FROM m JOIN e USING (p_partkey))"""


def _corrected_sql(aggressive: bool) -> str:
    return f"WITH {_corrected_cte(aggressive)} SELECT {_PART}, * EXCLUDE (p_partkey, doi) FROM c"


def _corrected(spark, sf_dir, mode):
    rows = _verified(spark, sf_dir, mode).where("status IN ('CORRECTED', 'VERIFIED')")
    names = ("author", "title", "year", "month", "volume", "pages", "number", "publisher", "booktitle", "journal")
    had = scanner.extract_fields(F.col("original"), "doi")["doi"].isNull()
    got = rows.select("source_path", "ord", had.alias("had"), scanner.read_entry(F.col("corrected"), "doi", *names).alias("r"))
    return _numbers(got.select("source_path", "ord", F.col("r.entry_type").alias("type"), (F.col("had") & F.col("r.doi").isNotNull()).alias("doi_added"), *[F.col(f"r.{n}").alias(n) for n in names]))


@query(_corrected_sql(False))
def corrected_safe(spark, sf_dir):
    return _corrected(spark, sf_dir, "SAFE")


@query(_corrected_sql(True))
def corrected_aggressive(spark, sf_dir):
    return _corrected(spark, sf_dir, "AGGRESSIVE_DOI_ONLY")


_FOUND = f"{corpus.hits_sql()}, st AS (SELECT p_partkey, CASE WHEN p_partkey IN (SELECT p_partkey FROM h) THEN 'CORRECTED' WHEN title IS NOT NULL THEN 'NOT_FOUND' ELSE 'SKIPPED' END AS status FROM e)"


@query(f"WITH {_FOUND} SELECT 'parts/' || CAST(p_partkey // 1000 AS VARCHAR) AS source_path, 0::BIGINT AS duplicates_removed, 0::BIGINT AS verified, CAST(count(*) FILTER (status = 'CORRECTED') AS BIGINT) AS corrected, CAST(count(*) FILTER (status = 'NOT_FOUND') AS BIGINT) AS not_found, 0::BIGINT AS errors, CAST(count(*) FILTER (status = 'SKIPPED') AS BIGINT) AS skipped FROM st GROUP BY 1")
def verify_status_summary(spark, sf_dir):
    none = spark.createDataFrame([], "source_path string")
    return render.status_summary(_verified(spark, sf_dir, "SAFE"), none)


@query(f"""WITH {_FOUND}, w AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'ERROR' WHEN p_partkey % 7 = 1 AND p_partkey % 4 <> 0 AND status = 'CORRECTED' THEN 'VERIFIED' ELSE status END AS status FROM st)
SELECT 'parts/' || CAST(p_partkey // 1000 AS VARCHAR) AS source_path, CAST(count(*) FILTER (p_partkey % 5 = 0) AS BIGINT) AS duplicates_removed, {', '.join(f"CAST(count(*) FILTER (status = '{x}') AS BIGINT) AS {n}" for n, x in (('verified', 'VERIFIED'), ('corrected', 'CORRECTED'), ('not_found', 'NOT_FOUND'), ('errors', 'ERROR'), ('skipped', 'SKIPPED')))} FROM w GROUP BY 1""")
def verify_again(spark, sf_dir):
    """All five outcomes: entries with a DOI that were corrected before are verified, and entries that are null are errors."""
    before = materialize(_verified(spark, sf_dir, "SAFE").select("source_path", "ord", "original", "corrected"), "verified")  # used thrice
    key = F.split("source_path", "/")[1].cast("long") * 1000 + F.col("ord")
    raw = F.when(key % 7 == 0, F.lit(None).cast("string")).when((key % 7 == 1) & (key % 4 != 0), F.col("corrected")).otherwise(F.col("original"))
    told = enrich.verify(before.select("source_path", "ord", raw.alias("raw")), corpus.responses(spark, sf_dir), "SAFE", "FULL_NAME")
    return render.status_summary(told, before.where(key % 5 == 0))


# Output

_RAW = r"""'@Article{' || key || ',' || chr(10) || '  title = {' || title || '},' || chr(10) || '  year = {' || year || '},' || chr(10) || '  month = ' || CASE doc_id % 3 WHEN 0 THEN '{' || month || '}' WHEN 1 THEN '"' || month || '"' ELSE month END || ',' || chr(10) || '  note = {n' || CAST(doc_id AS VARCHAR) || '}' || chr(10) || '}'"""
_COUNTS = """c AS (SELECT source_path, count(*) AS total, count(*) FILTER (reason IS NULL) AS uniq, (SELECT count(*) FROM bib b WHERE b.source_path = fold.source_path AND b.doc_id % 23 = 0) AS bad FROM fold GROUP BY source_path)"""
_OUT = f"""{FILES}, {_COUNTS}, out AS (SELECT c.source_path, '% Total entries parsed: ' || total || chr(10) || '% Unique kept: ' || uniq || chr(10) || '% Duplicates removed: ' || (total - uniq) || chr(10) || '% Parse issues: ' || bad || chr(10)
  || '% ' || repeat('=', 50) || chr(10) || chr(10) || (SELECT string_agg({_RAW.replace("key", "b.key").replace("title ||", "b.title ||").replace("year ||", "b.year ||").replace("doc_id", "b.doc_id")} || chr(10) || chr(10), '' ORDER BY b.ord) FROM bib b JOIN fold f ON f.source_path = b.source_path AND f.ord = b.ord WHERE f.reason IS NULL AND b.source_path = c.source_path) AS output FROM c)"""


#: All records as one file, with places in UTF-16 units.
_FILE = rf"""{BIB}, t AS (SELECT *, {_RAW} AS raw, CASE WHEN doc_id % 17 = 0 THEN 26 ELSE 0 END AS skipped, CASE WHEN doc_id % 23 = 0 THEN 8 ELSE 0 END AS bad FROM bib),
f AS (SELECT *, skipped + bad + length(raw) + length(regexp_replace(raw, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) + 2 AS units FROM t)"""


@query(f"WITH {_FILE} SELECT 'library' AS source_path, row_number() OVER (ORDER BY doc_id) - 1 AS ord, 'article' AS type, key, md5(raw) AS raw FROM f")
def parse_one_file(spark, sf_dir):
    """A file of all records, read in pieces."""
    entries, _ = splits.parsed(corpus.bib_pieces(spark, sf_dir))
    return _numbers(entries.withColumn("raw", F.md5(F.col("raw").cast("binary"))))


@query(f"""WITH {_FILE}, s AS (SELECT doc_id, bad, CAST(sum(units) OVER (ORDER BY doc_id) - units + skipped AS BIGINT) AS start FROM f)
SELECT 'library' AS source_path, row_number() OVER (ORDER BY doc_id) - 1 AS ord, 'NO_KEY' AS code, start, 'misc' AS type, 'Entry without key at index ' || start || ' (@misc)' AS message FROM s WHERE bad > 0""")
def parse_one_file_errors(spark, sf_dir):
    return _numbers(splits.parsed(corpus.bib_pieces(spark, sf_dir))[1])


def _output(spark, sf_dir):
    rows = dedupe.processed(corpus.bib_sources(spark, sf_dir))
    return render.processed_output(dedupe.summary_of_processed(rows), rows.where("ord IS NOT NULL AND reason IS NULL"))


_LIBRARY = rf"""{_FILE}, k AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1),
b AS (SELECT 0::BIGINT AS part, 0::BIGINT AS ord, '% Total entries parsed: ' || (SELECT count(*) FROM f) || chr(10) || '% Unique kept: ' || (SELECT count(*) FROM k) || chr(10) || '% Duplicates removed: ' || ((SELECT count(*) FROM f) - (SELECT count(*) FROM k)) || chr(10)
  || '% Parse issues: ' || (SELECT count(*) FROM f WHERE bad > 0) || chr(10) || '% ' || repeat('=', 50) || chr(10) || chr(10) AS block
  UNION ALL SELECT 1, n, raw || chr(10) || chr(10) FROM k)"""


def _library_blocks(spark, sf_dir):
    """The output of all records as one source, as blocks."""
    entries, errors = splits.parsed(corpus.bib_pieces(spark, sf_dir))
    rows = dedupe.judged_once(entries, smart=False)
    bad = errors.groupBy("source_path").agg(F.count(F.lit(1)).alias("bad"))
    counts = dedupe.summary_of_processed(rows.withColumn("parse_errors", F.lit(0).cast("long"))).drop("parse_errors").join(bad, "source_path", "left")
    return render.output_blocks(counts.withColumn("parse_errors", F.coalesce("bad", F.lit(0))), rows.where("reason IS NULL"))


@query(f"WITH {_LIBRARY} SELECT 'library' AS source_path, part, ord, block FROM b")
def render_blocks(spark, sf_dir):
    """A source of all documents, block by block."""
    return _numbers(_library_blocks(spark, sf_dir).drop("by_key"))


@query(f"WITH {_LIBRARY} SELECT 'library' AS source_path, part, ord, block, 1::BIGINT AS matches FROM b WHERE contains(lower(block), 'month = {{sept}}')")
def search_blocks(spark, sf_dir):
    return _numbers(render.search_blocks(_library_blocks(spark, sf_dir), " Month = {SEPT} ").drop("by_key"))


@query(f"WITH RECURSIVE {_OUT} SELECT source_path, output FROM out")
def render_output(spark, sf_dir):
    return _output(spark, sf_dir)


@query(f"""WITH RECURSIVE {_OUT}, p AS (SELECT source_path, unnest(string_split(rtrim(output, chr(10)), chr(10) || chr(10))) AS b, generate_subscripts(string_split(rtrim(output, chr(10)), chr(10) || chr(10)), 1) AS i FROM out),
h AS (SELECT * FROM p WHERE contains(lower(b), 'month = {{sept}}') OR contains(lower(b), 'month = {{sept}}'))
SELECT out.source_path, coalesce((SELECT string_agg(b || chr(10) || chr(10), '' ORDER BY i) FROM h WHERE h.source_path = out.source_path), '') AS output,
  (SELECT CAST(count(*) FILTER (b NOT LIKE '\\%%' ESCAPE '\\') AS BIGINT) FROM h WHERE h.source_path = out.source_path) AS matches FROM out""")
def search_filter(spark, sf_dir):
    return render.search(_output(spark, sf_dir), " Month = {SEPT} ")


@query(f"WITH RECURSIVE {_OUT} SELECT source_path, md5(output) AS output FROM out")
def save_outputs(spark, sf_dir):
    """Outputs are saved block by block; the files of each, in the order of their names, are ``render_output``'s texts."""
    rows = dedupe.processed(corpus.bib_sources(spark, sf_dir))
    blocks = render.output_blocks(dedupe.summary_of_processed(rows), rows.where("ord IS NOT NULL AND reason IS NULL"))
    path = render.save_blocks(blocks, f"{shared_dir(spark)}/bibspark/saved-{uuid.uuid4().hex}")
    read = spark.read.text(path, wholetext=True).select(F.col("source_path").cast("string").alias("source_path"), F.col("_metadata.file_name").alias("file"), "value")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "value"))), lambda r: r["value"]), "")
    return read.groupBy("source_path").agg(F.md5(whole.cast("binary")).alias("output"))


_GONE = "'References - Duplicates Report' || chr(10) || chr(10) || 'Total duplicates removed: ' || count(*) FILTER (reason IS NOT NULL) || chr(10) || chr(10) || string_agg('- dropped=' || key || ' kept=' || kept_key || ' reason=' || reason || chr(10), '' ORDER BY ord) FILTER (reason IS NOT NULL)"


@query(f"WITH RECURSIVE {FILES} SELECT source_path, CASE WHEN count(*) FILTER (reason IS NOT NULL) > 0 THEN {_GONE} END AS report, CASE WHEN count(*) FILTER (reason IS NOT NULL) = 0 THEN 'No duplicates were detected.' END AS message FROM fold GROUP BY source_path UNION ALL SELECT 'empty/0', NULL, 'No duplicates were detected.'")
def duplicates_report(spark, sf_dir):
    sources = corpus.bib_sources(spark, sf_dir)
    empty = spark.createDataFrame([("empty/0", "")], "source_path string, content string")
    return render.duplicates_report(dedupe.duplicates(parse.entries(sources)), sources.unionByName(empty))


@query(f"""WITH RECURSIVE {FILES}, {_COUNTS} SELECT source_path, 'References - Summary' || chr(10) || chr(10) || 'Total entries: ' || total || chr(10) || 'Unique entries: ' || uniq || chr(10) || 'Duplicates removed: ' || (total - uniq) || chr(10) || 'Parse errors: ' || bad || chr(10)
  || 'Sort by key: false' || chr(10) || 'Smart dedupe: true' || chr(10) || 'Verification mode: SAFE' || chr(10) || 'Month style: KEEP_ORIGINAL' || chr(10) AS report FROM c""")
def summary_report(spark, sf_dir):
    return render.summary_report(dedupe.summary(corpus.bib_sources(spark, sf_dir)))


_NL = "chr(10)"
_LINES = " || ".join(f"coalesce('  {n} = {{{{' || c.{n} || '}}}},' || {_NL}, '')" for n in ("author", "title", "journal", "booktitle", "year", "month", "volume", "number", "pages", "publisher", "doi")).replace("{{", "{").replace("}}", "}")
_PLAIN = " || ".join(f"coalesce('  {n} = {{' || e.{n} || '}},' || {_NL}, '')" for n in corpus.ENTRY)
_RULED = f"'% ' || repeat('{render.DOUBLE[0]}', 55) || {_NL}"


@query(f"""WITH {_corrected_cte(False)}, x AS (SELECT e.p_partkey, CASE WHEN c.p_partkey IS NOT NULL THEN 'CORRECTED' WHEN e.title IS NOT NULL THEN 'NOT_FOUND' ELSE 'SKIPPED' END AS status,
  CASE WHEN c.p_partkey IS NOT NULL THEN '@' || c.type || '{{p' || e.p_partkey || ',' || {_NL} || {_LINES} || '}}' ELSE '@misc{{p' || e.p_partkey || ',' || {_NL} || {_PLAIN} || '}}' END AS entry FROM e LEFT JOIN c USING (p_partkey))
SELECT 'parts/' || CAST(p_partkey // 1000 AS VARCHAR) AS source_path, {_RULED} || '% VERIFICATION & DEDUPLICATION SUMMARY' || {_NL} || {_RULED} || '% Duplicates removed: 0' || {_NL} || '% Verified (already correct): 0' || {_NL}
  || '% Corrected/completed: ' || count(*) FILTER (status = 'CORRECTED') || {_NL} || '% Not found online: ' || count(*) FILTER (status = 'NOT_FOUND') || {_NL} || '% Errors during lookup: 0' || {_NL} || '% Skipped (no DOI/title): ' || count(*) FILTER (status = 'SKIPPED') || {_NL}
  || {_RULED} || {_NL} || string_agg(entry || {_NL} || {_NL}, '' ORDER BY p_partkey) AS output FROM x GROUP BY 1""")
def verified_output(spark, sf_dir):
    told = _verified(spark, sf_dir, "SAFE")
    none = spark.createDataFrame([], "source_path string")
    return render.verified_output(render.status_summary(told, none), told).select("source_path", "output")


@query(f"WITH {BIB} SELECT source_path, CAST(ord AS BIGINT) AS ord, '@article{{' || key || ',' || chr(10) || '  title = {{' || title || '}},' || chr(10) || '  year = {{' || year || '}},' || chr(10) || '  month = {{' || month || '}},' || chr(10) || '  note = {{n' || CAST(doc_id AS VARCHAR) || '}},' || chr(10) || '}}' AS text FROM bib")
def rebuild_entry(spark, sf_dir):
    rows = _entries(spark, sf_dir).withColumn("f", scanner.parse_fields(F.col("raw")))
    return _numbers(rows.select("source_path", "ord", render.rebuild_entry(F.col("type"), F.col("key"), F.col("f")).alias("text")))
