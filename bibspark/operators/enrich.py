"""Looking entries up in a snapshot of catalogue responses, choosing and merging candidates, and rewriting entries.

The cascade (DOI; else title; else author and year) is one join: each entry gives a row for each way that it may be looked
up, and of the rows that hit, those of the first way count. Of a snapshot only the responses that some entry asks for are decoded
(``wanted``); if it is bucketed by what is looked up (``sources.bib.write_snapshot``), they are found without moving it. Candidates
are merged, and entries rewritten, as columns, which Spark compiles; functions on arrays it would interpret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.functions import jsonx, months, scanner
from bibspark.functions.chars import let, some
from bibspark.functions.text import author_year_key, clean_title, compare_form, entry_type, plausible_authors
from bibspark.operators.render import ORDER, rebuilt
from bibspark.storage import materialize

MODES = ("SAFE", "AGGRESSIVE_DOI_ONLY")
SOURCES = ("CrossRef", "Semantic Scholar", "OpenAlex")
#: What each field that is there counts.
WEIGHTS = {"title": 10, "authors": 10, "year": 5, "month": 5, "container_title": 5, "volume": 3, "issue": 2, "pages": 3, "doi": 8, "publisher": 2}
#: What candidates fill in for each other, and the fields that may be overwritten.
MERGED = ("title", "authors", "year", "month", "container_title", "volume", "issue", "pages", "doi", "publisher", "isbn", "issn")
OVERWRITE = ("doi", "url", "year", "month", "volume", "number", "pages", "journal", "booktitle")


def score(c: Column) -> Column:
    """The completeness of a candidate."""
    return sum((F.when(some(c[f]), F.lit(w)).otherwise(F.lit(0)) for f, w in WEIGHTS.items()), F.lit(0))


def candidates(responses: DataFrame) -> DataFrame:
    """source, lookup_kind, lookup_key, candidate of the responses that are usable."""
    ok = responses.where("status = 200 AND body IS NOT NULL")
    by = Window.partitionBy("source", "lookup_kind", "lookup_key").orderBy("body")
    ok = ok.withColumn("__n", F.row_number().over(by)).where("__n = 1")
    parts = []
    for source in SOURCES:
        rows = ok.where(F.col("source") == source)
        search = F.col("lookup_kind") != "doi"
        if source == "CrossRef":  # a search without results is none; any response may hold a list
            rows = rows.where(~search | F.contains("body", F.lit(jsonx.ITEMS[source])))
            body = jsonx.searched(F.col("body"), source)
        else:
            body = F.when(search, jsonx.searched(F.col("body"), source)).otherwise(F.col("body"))
        rows = rows.withColumn("__body", body)
        # bound as a whole: else each use of a field would read it from the text anew
        parts.append(rows.select("source", "lookup_kind", "lookup_key", let(F.col("__body"), jsonx.DECODERS[source]).alias("candidate")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def lookups(rows: DataFrame) -> DataFrame:
    """source_path, ord, strategy, lookup_kind, lookup_key of entries with their doi, title, author and year."""
    none = F.lit(None).cast("string")
    ways = [
        ("doi", F.when(some(F.col("doi")), F.col("doi"))),
        ("title", F.when(F.length("title") > 10, clean_title(F.col("title")))),
        ("author_year", F.when(some(F.col("author")) & F.col("year").isNotNull(), author_year_key(*[F.col(c) for c in ("author", "year", "title")]))),
    ]
    all_ = F.array(*[F.struct(F.lit(i + 1).alias("strategy"), F.lit(k).alias("lookup_kind"), F.coalesce(v, none).alias("lookup_key")) for i, (k, v) in enumerate(ways)])
    return rows.select("source_path", "ord", F.inline(F.filter(all_, lambda w: w["lookup_key"].isNotNull())))


def _rank(source: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SOURCES)), source)


def _first_hits(asked: DataFrame, found: DataFrame) -> DataFrame:
    hits = asked.join(found, ["lookup_kind", "lookup_key"])
    hits = hits.where((F.col("lookup_kind") != "author_year") | (F.col("source") == "CrossRef"))
    first = F.min("strategy").over(Window.partitionBy("source_path", "ord"))
    return hits.withColumn("__first", first).where(F.col("strategy") == F.col("__first")).select("source_path", "ord", "strategy", "source", "candidate")


def cascade(rows: DataFrame, found: DataFrame) -> DataFrame:
    """source_path, ord, strategy, source, candidate: the hits of the first strategy that has any."""
    return _first_hits(lookups(rows), found)


def wanted(responses: DataFrame, asked: DataFrame) -> DataFrame:
    """The responses that ``asked`` (lookup_kind, lookup_key) names."""
    keys = asked.select("lookup_kind", "lookup_key").distinct()
    return responses.join(keys, ["lookup_kind", "lookup_key"], "left_semi").select(*responses.columns)


def hits(rows: DataFrame, responses: DataFrame) -> DataFrame:
    """``cascade`` of responses, of which only those asked for are decoded. What is asked is written once: a row for each way."""
    asked = materialize(lookups(rows), "asked")
    return _first_hits(asked, candidates(wanted(responses, asked)))


def best_candidate(hits: DataFrame) -> DataFrame:
    """source_path, ord, strategy, source, score, candidate of the most complete hit; ties go to the earlier catalogue."""
    rows = hits.withColumn("score", score(F.col("candidate")))
    by = Window.partitionBy("source_path", "ord").orderBy(F.desc("score"), _rank(F.col("source")))
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").select("source_path", "ord", "strategy", "source", "score", "candidate")


def merged(hits: DataFrame) -> DataFrame:
    """source_path, ord, strategy, data: the best candidate, its empty fields filled from the others in order."""
    c = lambda f: F.col("candidate").getField(f)
    rank = _rank(F.col("source"))
    by = Window.partitionBy("source_path", "ord").orderBy(F.desc(score(F.col("candidate"))), rank)
    rows = hits.withColumn("__n", F.row_number().over(by))
    rows = rows.withColumn("__at", F.struct(F.when(F.col("__n") == 1, F.lit(0)).otherwise(rank).alias("r"), F.col("__n").alias("n")))

    def of(f: str) -> Column:
        best = F.max(F.when(F.col("__n") == 1, c(f)))
        return F.coalesce(F.min_by(c(f), F.when(some(c(f)), F.col("__at"))), best) if f in MERGED else best

    told = rows.groupBy("source_path", "ord").agg(F.min("strategy").alias("strategy"), *[of(f).alias(f"__{f}") for f in jsonx.CANDIDATE])
    return told.select("source_path", "ord", "strategy", F.struct(*[F.col(f"__{f}").alias(f) for f in jsonx.CANDIDATE]).alias("data"))


def _corrected(rows: DataFrame, month_style: str) -> DataFrame:
    """``rows`` (kind, key, all, data, overwrite) with text: the entry with what a candidate adds, and overwrites where that is
    allowed; null without a candidate. All fields are columns, each worked out once."""
    data, overwrite, kind = F.col("data"), F.col("overwrite"), F.col("kind")
    rows = rows.withColumn("__had", F.map_from_entries("all"))
    rows = rows.select("*", *[F.col("__had")[n].alias(f"__old_{n}") for n in ORDER], F.lower(data["authors"]).alias("__low"), months.month_number(data["month"]).alias("__month"))
    old = lambda n: F.col(f"__old_{n}")
    has = lambda n: old(n).isNotNull()
    in_book = kind.isin("inproceedings", "incollection")
    no_place = ~has("journal") & ~has("booktitle")
    book = kind.isin("book", "incollection")
    month = months.format_month(F.col("__month"), month_style, data["month"])
    offers = {
        "author": F.when(plausible_authors(data["authors"], F.col("__low")), data["authors"]),
        "title": data["title"],
        "journal": F.when(~in_book & (no_place | (overwrite & has("journal"))), data["container_title"]),
        "booktitle": F.when(in_book & (no_place | (overwrite & has("booktitle"))), data["container_title"]),
        "year": data["year"],
        "month": F.when((overwrite | ~some(F.coalesce(old("month"), F.lit("")))) & some(data["month"]), month),
        "volume": data["volume"],
        "number": data["issue"],
        "pages": data["pages"],
        "publisher": data["publisher"],
        "doi": data["doi"],
        "isbn": F.when(book, data["isbn"]),
        "issn": F.when(kind == "article", data["issn"]),
        "url": data["url"],
    }
    # what the entry has is looked at first: what can't count isn't worked out
    usable = lambda n: F.lit(True) if n == "month" else (overwrite & F.lit(n in OVERWRITE)) | ~has(n)
    rows = rows.select("*", *[F.when(usable(n), v).alias(f"__new_{n}") for n, v in offers.items()])
    value = lambda n: F.when(some(F.col(f"__new_{n}")), F.col(f"__new_{n}")).otherwise(old(n)) if n in offers else old(n)
    text = rebuilt(kind, F.col("key"), {n: value(n) for n in ORDER}, F.col("all"))
    return rows.withColumn("text", F.when(data.isNotNull(), text)).drop("__had", "__low", "__month", *[f"__old_{n}" for n in ORDER], *[f"__new_{n}" for n in offers])


def verify(entries: DataFrame, responses: DataFrame, mode: str = "SAFE", month_style: str = "KEEP_ORIGINAL", keep_type: bool = False) -> DataFrame:
    """source_path, ord, original, corrected, status, message of each entry (source_path, ord, raw). An entry that can't be read,
    as it is null, is an ERROR; a response that can't be used is none.

    ``keep_type`` keeps the entry's type where the catalogue has another; by default the catalogue's counts, in either mode.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    read = scanner.read_entry(F.col("raw"), "doi", "title", "author", "year")
    rows = entries.select("source_path", "ord", "raw").withColumn("read", read)
    names = [F.col(f"read.{n}").alias(n) for n in ("doi", "title", "author", "year")]
    rows = rows.select("source_path", "ord", "raw", *names, F.col("read.all_fields").alias("all"), F.coalesce("read.entry_type", F.lit("article")).alias("kind"), F.coalesce("read.entry_key", F.lit("unknown")).alias("key"))
    rows = materialize(rows, "read")  # entries are read once, for what they ask and for what becomes of them
    data = merged(hits(rows, responses)).select(F.col("source_path").alias("s"), F.col("ord").alias("o"), "data")
    rows = rows.join(data, (F.col("source_path") == F.col("s")) & (F.col("ord") == F.col("o")), "left")
    overwrite = some(F.coalesce("doi", F.lit(""))) & F.lit(mode == "AGGRESSIVE_DOI_ONLY")
    kind = F.col("kind") if keep_type else F.coalesce(entry_type(F.col("data.type")), F.col("kind"))
    rows = rows.withColumn("kind", kind).withColumn("overwrite", overwrite)
    rows = _corrected(rows, month_style)
    changed = compare_form(F.col("text")) != compare_form(F.col("raw"))
    hit = F.col("data").isNotNull()
    status = F.when(F.col("raw").isNull(), "ERROR").when(hit & changed, "CORRECTED").when(hit, "VERIFIED").when(some(F.coalesce("title", F.lit(""))), "NOT_FOUND").otherwise("SKIPPED")
    rows = rows.withColumn("status", status)
    by = F.when(F.col("overwrite"), F.lit("Reference corrected (aggressive) from ")).otherwise(F.lit("Reference corrected from "))
    message = F.when(F.col("status") == "ERROR", F.lit("Error: no entry")).when(F.col("status") == "CORRECTED", F.concat(by, F.col("data.source"))).when(F.col("status") == "VERIFIED", F.concat(F.lit("Reference verified via "), F.col("data.source"))).when(F.col("status") == "NOT_FOUND", F.lit("Could not find reference in any online source")).otherwise(F.lit("No DOI, title, or author+year found to verify"))
    return rows.select("source_path", "ord", F.col("raw").alias("original"), F.when(F.col("status") == "CORRECTED", F.col("text")).otherwise(F.col("raw")).alias("corrected"), "status", message.alias("message"))
