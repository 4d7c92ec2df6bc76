"""Record corpora rendered from the test tables, so that the engine's results can be held against the rows themselves.

SQL expressions here are in what Spark and DuckDB share, and both sides use the same ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibspark.functions.chars import bounded, collapse

MONTHS = ["January", "feb", "Mar.", "apr.", "5", "06", "Sept", "Marathon", "13", "Dec"]
MONTH_LIST = ", ".join(f"'{m}'" for m in MONTHS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILE = 1000  # ids of a source that make a file


def _escaped() -> Column:
    return collapse(F.regexp_replace(F.coalesce("text", F.lit("")), r'(["\\{}])', r"\\$1"))


def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, t: whole texts with escapes."""
    return table(spark, sf_dir, "documents").select("doc_id", _escaped().alias("t"))


def bib_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_path, source, doc_id, ord, key, title, year, month: a record for each document, whose whole text is the title, with
    escapes and for every other one in braces of its own. A file holds ``FILE`` ids of a source, so no file grows with the
    table; a source's files are a library (``library``)."""
    docs = table(spark, sf_dir, "documents")
    text = _escaped()
    rows = docs.select(
        F.concat("source", F.lit("/"), F.expr(f"CAST(doc_id DIV {FILE} AS STRING)")).alias("source_path"),
        "source",
        "doc_id",
        F.concat(F.lit("d"), F.expr("CAST(doc_id % 400 AS STRING)")).alias("key"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("{"), text, F.lit("}"))).otherwise(text).alias("title"),
        F.expr("CAST(2000 + doc_id % 25 AS STRING)").alias("year"),
        F.expr(f"element_at(array({MONTH_LIST}), CAST(doc_id % 10 + 1 AS INT))").alias("month"),
    )
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("source_path").orderBy("doc_id")) - 1)


def library(rows: DataFrame) -> DataFrame:
    """The files of a source as one source: their path without the file's number, and places that follow each other."""
    number = F.substring_index("source_path", "/", -1).cast("int")
    rows = rows.withColumn("ord", (number * FILE + F.col("ord")).cast("int")) if "ord" in rows.columns else rows
    return rows.withColumn("source_path", F.regexp_replace("source_path", r"/\d+$", ""))


def bib_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bib_rows`` with text, the record. Some follow a construct that is none, or an entry without a key."""
    month = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('{', month, '}') WHEN 1 THEN concat('\"', month, '\"') ELSE month END")
    before = F.expr(r"concat(CASE WHEN doc_id % 17 = 0 THEN '@comment{no record, here}\n' ELSE '' END, CASE WHEN doc_id % 23 = 0 THEN '@misc()\n' ELSE '' END)")
    text = F.concat(before, F.lit("@Article{"), "key", F.lit(",\n  title = {"), "title", F.lit("},\n  year = {"), "year", F.lit("},\n  month = "), month, F.lit(",\n  note = {n"), F.col("doc_id").cast("string"), F.lit("}\n}"))
    return bib_rows(spark, sf_dir).withColumn("text", text)


def bib_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_path, content: the files."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda r: r["text"])
    return bib_texts(spark, sf_dir).groupBy("source_path").agg(F.array_join(blocks, "\n\n").alias("content"))


def bib_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_path, at, content: all records as one file, in pieces of about sixteen that are cut within a record."""
    half = F.expr("CAST(length(text) DIV 2 AS INT)")
    halves = F.array(F.left("text", half), F.concat(F.substring(F.col("text"), half + 1, F.length("text")), F.lit("\n\n")))
    rows = bib_texts(spark, sf_dir).select("doc_id", F.posexplode(halves).alias("pos", "half")).withColumn("number", 2 * F.col("doc_id") + F.col("pos"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("number", "half"))), lambda r: r["half"])
    return rows.groupBy(F.expr("(number + 1) DIV 32").alias("at")).agg(F.array_join(parts, "").alias("content")).select(F.lit("library").alias("source_path"), "at", "content")


ESCAPED = r"""trim(regexp_replace(regexp_replace(coalesce(text, ''), '(["\\{}])', '\\\1', 'g'), '[\s\x0B]+', ' ', 'g'))"""
BIB = rf"""bib AS (SELECT source || '/' || CAST(doc_id // {FILE} AS VARCHAR) AS source_path, source, doc_id,
  CAST(row_number() OVER (PARTITION BY source, doc_id // {FILE} ORDER BY doc_id) - 1 AS INTEGER) AS ord,
  'd' || CAST(doc_id % 400 AS VARCHAR) AS key,
  CASE WHEN doc_id % 2 = 0 THEN '{{' || {ESCAPED} || '}}' ELSE {ESCAPED} END AS title,
  CAST(2000 + doc_id % 25 AS VARCHAR) AS year, [{MONTH_LIST}][CAST(doc_id % 10 + 1 AS INT)] AS month FROM documents)"""
#: Fields are looked for at the first level, where the character behind a word is passed over unseen. If that is the backslash of
#: an escaped quote in a title without braces of its own, the quote opens a string, and no field behind it is found. An opening
#: brace met so hides what follows it in the title. The first quote of a month closes that string; its last one is seen after a dot.
UNSEEN = r"""(doc_id % 2 = 1 AND regexp_extract(regexp_replace(title, '[\p{L}\p{Nd}_][\p{L}\p{Nd}_-]*.|\\.', '', 'g'), '["{]') = '"')"""
UNSEEN_NOTE = rf"({UNSEEN} AND NOT (doc_id % 3 = 1 AND month NOT LIKE '%.'))"
SIGNED = BIB + r""", s AS (SELECT *, CASE WHEN length(regexp_replace(lower(title), '[^a-z0-9]', '', 'g')) >= 10
  THEN regexp_replace(lower(title), '[^a-z0-9]', '', 'g') END AS sig FROM bib)"""


def fold(path: str, at: str) -> str:
    """CTEs: the fold, record by record, with lists of what was kept. ``path``: what is judged as one; ``at``: the place shown."""
    return SIGNED + rf""", o AS (SELECT {path} AS source_path, {at} AS place, doc_id, key, md5(sig) AS sig, CAST(row_number() OVER (PARTITION BY {path} ORDER BY s.source, doc_id) - 1 AS INTEGER) AS ord FROM s),
fold AS (
  SELECT source_path, place, doc_id, ord, key, [key] AS ks, CASE WHEN sig IS NULL THEN []::VARCHAR[] ELSE [sig] END AS ss, CASE WHEN sig IS NULL THEN []::VARCHAR[] ELSE [key] END AS os,
    NULL::VARCHAR AS kept_key, NULL::VARCHAR AS reason FROM o WHERE ord = 0
  UNION ALL
  SELECT o.source_path, o.place, o.doc_id, o.ord, o.key, CASE WHEN k OR t THEN ks ELSE list_append(ks, o.key) END, CASE WHEN k OR t OR sig IS NULL THEN ss ELSE list_append(ss, sig) END,
    CASE WHEN k OR t OR sig IS NULL THEN os ELSE list_append(os, o.key) END,
    CASE WHEN k THEN o.key WHEN t THEN os[list_position(ss, sig)] END, CASE WHEN k THEN 'KEY_DUPLICATE' WHEN t THEN 'TITLE_DUPLICATE' END
  FROM (SELECT o.*, f.ks, f.ss, f.os, list_contains(f.ks, o.key) AS k, o.sig IS NOT NULL AND list_contains(f.ss, o.sig) AS t
        FROM fold f JOIN o ON o.source_path = f.source_path AND o.ord = f.ord + 1) o)"""


LIBRARY = f"(doc_id // {FILE}) * {FILE} + ord"
#: Within each file; within each source's library.
FILES, LIBRARIES = fold("s.source_path", "ord"), fold("source", LIBRARY)

# References

SURNAMES = ["Anderson", "Baker", "Chen", "Diaz", "Evans", "Fischer", "Garcia", "Hansen", "Ito", "Jensen"]
NAME_LIST = ", ".join(f"'{n}'" for n in SURNAMES)
STYLES = ["bracket", "dot", "plain", "blank", "author"]
#: doc_id, number, surname, year, title, doi of a reference for each customer; ten make a document.
REF_COLUMNS = {
    "doc_id": "CAST((c_custkey - c_custkey % 10) / 10 AS BIGINT)",
    "number": "CAST(c_custkey % 10 + 1 AS INTEGER)",
    "year": "CAST(1950 + c_custkey % 70 AS STRING)",
    "title": "'Accounts of segment ' || lower(c_mktsegment) || ' no' || CAST(c_custkey AS STRING)",
    "doi": "'10.1234/acc.' || CAST(c_custkey AS STRING)",
}


def ref_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", *[f"{v} AS {k}" for k, v in REF_COLUMNS.items()], f"element_at(array({NAME_LIST}), CAST(c_custkey % 10 + 1 AS INT)) AS surname")
    return rows.withColumn("text", F.expr("concat(surname, ', J. \"', title, '.\" Annals of Ledgers (', year, '), doi:', doi, '.')"))


def ref_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: documents whose section of references is in one of five styles; those of every eleventh have none."""
    rows = ref_rows(spark, sf_dir).withColumn("style", F.col("doc_id") % 5)
    lead = F.expr("CASE style WHEN 0 THEN concat('[', number, '] ') WHEN 1 THEN concat(number, '. ') WHEN 2 THEN concat(number, ' ') ELSE '' END")
    rows = rows.groupBy("doc_id", "style").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", F.concat(lead, "text").alias("t")))), lambda r: r["t"]).alias("lines"))
    body = F.when(F.col("style") == 3, F.array_join("lines", "\n\n")).otherwise(F.array_join("lines", "\n"))
    head = F.when(F.col("doc_id") % 11 == 10, F.lit("Nothing is cited here")).otherwise(F.lit("REFERENCES"))
    content = F.concat(F.lit("On ledgers.\n\nText.\n"), head, F.lit("\n"), body, F.lit("\nAcknowledgments\nThanks."))
    none = F.col("doc_id") % 11 == 10
    return rows.select("doc_id", F.when(none, F.lit("On ledgers.\nNothing is cited here.")).otherwise(content).alias("content"))


def as_pdf(content: Column, lines: int = 6) -> Column:
    """A text column as PDF files: pages of ``lines`` lines, of which every second is shown first, in two parts. Every
    second page shows its lines through a form that moves them to their place."""

    def made(text: str) -> bytes:
        said = text.split("\n")
        parts = [said[i : i + lines] for i in range(0, len(said), lines)]
        objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count %d/Kids[%s]/Resources<</Font<</F1 3 0 R>>>>>>" % (len(parts), b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(parts)))), b"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding/WinAnsiEncoding/FirstChar 0/Widths[" + b"600 " * 256 + b"]>>"]
        for i, part in enumerate(parts):
            shown, form = [], i % 2
            for n in [*range(1, len(part), 2), *range(0, len(part), 2)]:
                half = len(part[n]) // 2
                for start, x in ((0, part[n][:half]), (half, part[n][half:])):
                    escaped = x.encode("cp1252", "replace").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)")
                    shown.append(b"BT /F1 10 Tf %d %d Td (%s) Tj ET" % ((0 if form else 50) + 6 * start, 700 - 12 * n, escaped))
            data = zlib.compress(b"\n".join(shown))
            kind, named = (b"/Type/XObject/Subtype/Form/BBox[0 0 600 800]/Matrix[1 0 0 1 50 0]", b"/Contents %d 0 R/Resources<</Font<</F1 3 0 R>>/XObject<</X %d 0 R>>>>" % (4 + 2 * len(parts), 5 + 2 * i)) if form else (b"", b"/Contents %d 0 R" % (5 + 2 * i))
            objects += [b"<</Type/Page/Parent 2 0 R%s>>" % named, b"<</Length %d/Filter/FlateDecode%s>>\nstream\n%s\nendstream" % (len(data), kind, data)]
        objects.append(b"<</Length 10>>\nstream\nq /X Do Q \nendstream")
        return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (i + 1, o) for i, o in enumerate(objects)) + b"\ntrailer\n<</Root 1 0 R>>\n%%EOF"

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in bounded(batches):
            yield pa.array([None if t is None else made(t) for t in texts.to_pylist()], pa.binary())

    return run(content)


REFS = f"""refs AS (SELECT *, surname || ', J. "' || title || '." Annals of Ledgers (' || year || '), doi:' || doi || '.' AS text,
  list_extract(['bracket', 'dot', 'plain', 'blank', 'author'], CAST(doc_id % 5 + 1 AS INT)) AS style FROM
  (SELECT {", ".join(f"{v} AS {k}" for k, v in REF_COLUMNS.items())}, [{NAME_LIST}][CAST(c_custkey % 10 + 1 AS INT)] AS surname FROM customer) WHERE doc_id % 11 <> 10),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY number) - 1 AS INTEGER) AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM refs)"""

# Catalogues

_ID = "CAST(p_partkey AS STRING)"
TITLE = f"p_name || ' volume {{No}} ' || {_ID}"
#: doi, title, author, year of the entries to look up.
ENTRY = {
    "doi": f"CASE WHEN p_partkey % 4 <> 0 THEN '10.5555/' || {_ID} END",
    "title": f"CASE WHEN p_partkey % 32 <> 4 THEN p_name || ' volume ' || {_ID} END",
    "author": "CASE WHEN p_partkey % 3 <> 1 THEN 'Ada Lovelace and Alan Turing' END",
    "year": "CASE WHEN p_partkey % 5 <> 2 THEN CAST(1960 + p_size AS STRING) END",
}
#: What each catalogue answers: when, and which fields.
ANSWERS = {
    "CrossRef": {
        "when": "p_partkey % 2 = 0",
        "title": f"p_name || ' volume ' || {_ID}",
        "doi": f"'10.5555/' || {_ID}",
        "type": "CASE p_partkey % 6 WHEN 0 THEN 'journal-article' WHEN 2 THEN 'book-chapter' ELSE 'dataset' END",
        "container_title": "'Journal of ' || p_brand",
        "volume": "CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS STRING) END",
        "publisher": "'House ' || CAST(p_size % 7 AS STRING)",
        "authors": "'Lovelace, Ada and Turing, Alan'",
        "year": "CAST(1960 + p_size AS STRING)",
        "month": "CASE WHEN p_partkey % 10 = 0 THEN 'September' END",
    },
    "Semantic Scholar": {
        "when": "p_partkey % 3 = 0",
        "title": f"p_name || ' volume ' || {_ID}",
        "doi": f"'10.5555/' || {_ID}",
        "container_title": "'Venue ' || p_brand",
        "volume": "CAST(p_size + 1 AS STRING)",
        "pages": "'1-' || CAST(p_size + 1 AS STRING)",
        "authors": "p_brand || ', Venue and Lovelace, Ada'",  # any name with a space counts, the journal's too
        "year": "CAST(1960 + p_size AS STRING)",
        "month": "'May'",
    },
    "OpenAlex": {
        "when": "p_partkey % 5 = 0",
        "title": f"p_name || ' volume ' || {_ID}",
        "doi": f"'10.5555/' || {_ID}",
        "type": "'article'",
        "issue": "CAST(p_size % 4 + 1 AS STRING)",
        "pages": "CAST(p_size AS STRING) || '-' || CAST(p_size + 9 AS STRING)",
        "authors": "'Lovelace, Ada'",
        "year": "CAST(1961 + p_size AS STRING)",
        "month": "'June'",
    },
}
FIELDS = ("title", "doi", "type", "container_title", "volume", "issue", "pages", "publisher", "authors", "year", "month")


def catalogue_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_path, ord, raw of an entry for each part, spread over sources of a thousand."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat('parts/', CAST(p_partkey DIV 1000 AS STRING)) AS source_path", "CAST(p_partkey % 1000 AS INT) AS ord", *[f"{v} AS {k}" for k, v in ENTRY.items()])
    line = lambda n: F.when(F.col(n).isNotNull(), F.concat(F.lit(f"  {n} = {{"), F.col(n), F.lit("},\n")))
    raw = F.concat_ws("", F.concat(F.lit("@misc{p"), F.col("p_partkey").cast("string"), F.lit(",\n")), *map(line, ENTRY), F.lit("}"))
    return rows.select("source_path", "ord", "p_partkey", raw.alias("raw"), *ENTRY)


def _body(source: str) -> str:
    """A response of a catalogue, as an SQL expression."""
    a = ANSWERS[source]
    pair = lambda k, v: f"CASE WHEN {v} IS NOT NULL THEN concat('\"{k}\":\"', {v}, '\"') END"
    if source == "CrossRef":
        month = f"CASE WHEN {a['month']} IS NOT NULL THEN ',9' ELSE '' END"
        inner = [pair("DOI", a["doi"]), pair("type", a["type"]), f"concat('\"title\":[\"', {a['title']}, '\"]')", f"concat('\"container-title\":[\"', {a['container_title']}, '\"]')", pair("volume", a["volume"]), pair("publisher", a["publisher"]), "'\"author\":[{\"family\":\"Lovelace\",\"given\":\"Ada\"},{\"family\":\"Turing\",\"given\":\"Alan\"}]'", f"concat('\"published-print\":{{\"date-parts\":[[', {a['year']}, {month}, ']]}}')"]
    elif source == "Semantic Scholar":
        inner = [pair("title", a["title"]), f"concat('\"year\":', {a['year']})", "'\"venue\":\"ignored\"'", "'\"publicationDate\":\"2001-05-03\"'", f"concat('\"externalIds\":{{\"DOI\":\"', {a['doi']}, '\"}}')", f"concat('\"journal\":{{\"name\":\"', {a['container_title']}, '\",\"volume\":\"', {a['volume']}, '\",\"pages\":\"', {a['pages']}, '\"}}')", "'\"authors\":[{\"name\":\"Ada Lovelace\"}]'"]
    else:
        inner = [pair("title", a["title"]), f"concat('\"doi\":\"https://doi.org/', {a['doi']}, '\"')", pair("type", a["type"]), f"concat('\"publication_date\":\"', {a['year']}, '-06-01\"')", "'\"authorships\":[{\"author\":{\"display_name\":\"Ada Lovelace\"}}]'", f"concat('\"biblio\":{{\"issue\":\"', {a['issue']}, '\",\"first_page\":\"', CAST(p_size AS STRING), '\",\"last_page\":\"', CAST(p_size + 9 AS STRING), '\"}}')"]
    return f"concat('{{', concat_ws(',', {', '.join(inner)}), '}}')"


LIST = {"CrossRef": '{"message":{"items":[', "Semantic Scholar": '{"data":[', "OpenAlex": '{"results":['}


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot: by DOI for parts that have one, by title for every eighth, by author and year for others."""
    parts = table(spark, sf_dir, "part").selectExpr("*", *[f"{v} AS e_{k}" for k, v in ENTRY.items()])
    out = None
    for source, a in ANSWERS.items():
        body = _body(source)
        listed = f"concat('{LIST[source]}', {body}, ',{{}}]}}')"
        by_doi = parts.where(f"({a['when']}) AND e_doi IS NOT NULL").selectExpr(f"'{source}' AS source", "'doi' AS lookup_kind", "e_doi AS lookup_key", "200 AS status", f"{body} AS body")
        by_title = parts.where(f"({a['when']}) AND p_partkey % 8 = 0").selectExpr(f"'{source}' AS source", "'title' AS lookup_kind", "e_title AS lookup_key", "CASE WHEN p_partkey % 48 = 0 THEN 404 ELSE 200 END AS status", f"{listed} AS body")
        both = by_doi.unionByName(by_title)
        if source == "CrossRef":
            key = "concat_ws('|', 'Lovelace', e_year, CASE WHEN length(e_title) > 5 THEN left(e_title, 50) END)"
            rows = parts.where("p_partkey % 8 = 4 AND p_partkey % 3 = 0 AND e_year IS NOT NULL")
            first = rows.selectExpr("p_partkey", f"{key} AS lookup_key", f"{listed} AS body").groupBy("lookup_key").agg(F.min_by("body", "p_partkey").alias("body"))
            both = both.unionByName(first.selectExpr("'CrossRef' AS source", "'author_year' AS lookup_kind", "lookup_key", "200 AS status", "body"))
        out = both if out is None else out.unionByName(both)
    return out


def _answers_sql() -> str:
    parts = []
    for i, (source, a) in enumerate(ANSWERS.items()):
        cols = ", ".join(f"CAST({a.get(f, 'NULL')} AS STRING) AS {f}" for f in FIELDS)
        parts.append(f"SELECT p_partkey, '{source}' AS source, {i + 1} AS src, {cols}, ({a['when']}) AND p_partkey % 4 <> 0 AS by_doi, ({a['when']}) AND p_partkey % 8 = 0 AND p_partkey % 48 <> 0 AND p_partkey % 32 <> 4 AS by_title FROM part")
    return " UNION ALL ".join(parts)


def scored() -> str:
    from bibspark.operators.enrich import WEIGHTS

    return " + ".join(f"CASE WHEN {f} IS NOT NULL AND {f} <> '' THEN {w} ELSE 0 END" for f, w in WEIGHTS.items())


def hits_sql() -> str:
    """CTEs: e (entries), a (all answers), k (answers by author and year, that of the first part that has a key), h (hits of the
    first strategy that has any, with score)."""
    entry = ", ".join(f"{v} AS {k}" for k, v in ENTRY.items())
    key = "'Lovelace|' || year || coalesce('|' || left(title, 50), '')"
    fields = ", ".join(f"a.{f}" for f in FIELDS)
    score = f"CAST({scored()} AS INTEGER) AS score"
    return f"""e AS (SELECT p_partkey, {entry} FROM part), a AS ({_answers_sql()}),
k AS (SELECT {key} AS key, min(p_partkey) AS answer FROM e WHERE p_partkey % 8 = 4 AND p_partkey % 3 = 0 AND year IS NOT NULL GROUP BY 1),
g AS (SELECT p_partkey, source, src, CASE WHEN by_doi THEN 1 ELSE 2 END AS strategy, {", ".join(FIELDS)} FROM a WHERE by_doi OR by_title
  UNION ALL SELECT q.p_partkey, a.source, a.src, 3, {fields} FROM (SELECT p_partkey, {key} AS key FROM e WHERE author IS NOT NULL AND year IS NOT NULL) q JOIN k USING (key) JOIN a ON a.p_partkey = k.answer AND a.source = 'CrossRef'
  WHERE q.p_partkey NOT IN (SELECT p_partkey FROM a WHERE by_doi OR by_title)),
h AS (SELECT *, {score} FROM g)"""


MERGED_SQL = ", ".join(f"coalesce(arg_min({f}, o) FILTER ({f} IS NOT NULL AND {f} <> ''), arg_min({f}, o) FILTER (o = 0)) AS {f}" for f in FIELDS if f != "type") + ", arg_min(type, o) FILTER (o = 0 AND type IS NOT NULL) AS type"
