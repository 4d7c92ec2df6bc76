r"""References in document text: the section, five ways of splitting it, the details of each reference, and entries.

All of it is expressions on columns; a document is one row until its references are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions.chars import collapse, found, let, trim
from bibspark.functions.text import escape_bibtex, generate_key

#: Headings, and the patterns of references.
HEADING = r"^\s*(?:References|Bibliography|Works\s+Cited|Literature\s+Cited|Citations)\s*$"
NEXT = r"^\s*(?:Appendix|Acknowledgments?|About\s+the\s+Authors?|Author\s+Bio|Supplementary)\s*$"
BRACKET = r"(?ms)^\s*\[(\d+)]\s*(.+?)(?=^\s*\[\d+]|\z)"
DOT = r"(?s)(?:^|\n)\s*(\d{1,3})\.\s+(.+?)(?=\n\s*\d{1,3}\.\s|$)"
PLAIN = r"(?m)(?:^|\n)\s*(\d{1,3})\.?\s+([A-Z][a-zA-Z]+[^\n]*(?:\n(?!\s*\d{1,3}\.?\s+[A-Z])[^\n]*)*+)"
BLANK = r"\n\s*\n+"
STARTS = r"^(?:\d{1,3}\.?\s+[A-Z][a-z]+.*|[A-Z][a-z]+\s+[A-Z]{1,2}[,.]?\s.*|[A-Z][a-z]+,\s+[A-Z].*)\z"
DOI = r"(?i)(?:doi[:\s]*|https?://(?:dx\.)?doi\.org/)?(10\.\d{4,}/[^\s]+)"
YEAR = r"\b((?:19|20)\d{2})\b"
_QUOTES = "“”\"‘’'"
TITLE = rf"[{_QUOTES}]([^{_QUOTES}]+)[{_QUOTES}]|(?:\d{{4}}[a-z]?[.,]?\s*)([^.]+\.)"
#: Lines of a section whose places are put together at once.
LINES = 256
STRATEGIES = ("bracket", "dot", "plain", "blank", "author")


def find_section(text: Column) -> Column:
    """What follows the first heading, up to the next of the headings that end it; else the last third of the text if it
    has three references in brackets; else null."""
    after = trim(F.regexp_extract(text, rf"(?ims){HEADING}(.*?)(?={NEXT}|\z)", 1))
    start = F.floor(F.length(text) * 2 / 3).cast("int")
    end = F.substr(text, start + 1)
    return F.when(text.rlike(f"(?im){HEADING}"), after).when(F.regexp_count(end, F.lit(BRACKET)) >= 3, end)


def _numbered(section: Column, pattern: str, least: int, clean) -> Column:
    get = lambda g: F.regexp_extract_all(section, F.lit(pattern), F.lit(g))
    rows = F.zip_with(get(1), get(2), lambda n, t: F.struct(n.try_cast("int").alias("number"), clean(t).alias("text")))
    return F.filter(rows, lambda r: F.length(r["text"]) > least)


def _in_order(texts: Column) -> Column:
    return F.transform(texts, lambda t, i: F.struct((i + 1).alias("number"), t.alias("text")))


def by_bracket(section: Column) -> Column:
    return _numbered(section, BRACKET, 20, trim)


def by_dot(section: Column) -> Column:
    return _numbered(section, DOT, 30, collapse)


def by_plain(section: Column) -> Column:
    return _numbered(section, PLAIN, 30, collapse)


def by_blank(section: Column) -> Column:
    blocks = F.transform(F.split(section, BLANK), collapse)
    return _in_order(F.filter(blocks, lambda t: (F.length(t) > 40) & t.rlike(YEAR)))


def by_author(section: Column) -> Column:
    """Lines are gathered until one starts like a reference and more than 40 characters are held.

    Only places and lengths are carried from line to line, and places are put together for ``LINES`` lines at once; the texts are cut
    at them in the end. So the time is in proportion to the lines, but for a copy of the places for each ``LINES``."""
    lines = F.filter(F.transform(F.split(section, "\n"), trim), lambda x: x != "")
    none = F.array().cast("array<int>")

    def within(acc: Column, line: Column) -> Column:
        flush = (acc["held"] > 40) & line["starts"]
        places = F.when(flush, F.concat(acc["places"], F.array(acc["at"]))).otherwise(acc["places"])
        held = F.when(flush | (acc["held"] == 0), line["size"]).otherwise(acc["held"] + 1 + line["size"])
        return F.struct(places.alias("places"), held.alias("held"), (acc["at"] + 1).alias("at"))

    def over(acc: Column, part: Column) -> Column:
        start = F.struct(none.alias("places"), acc["held"].alias("held"), acc["at"].alias("at"))
        return let(F.aggregate(part, start, within), lambda r: F.struct(F.concat(acc["places"], r["places"]).alias("places"), r["held"].alias("held"), r["at"].alias("at")))

    def cut(lines: Column, told: Column) -> Column:
        ends = F.concat(told["places"], F.when(told["held"] > 40, F.array(told["at"])).otherwise(none))
        text = lambda start, end: F.array_join(F.slice(lines, start + 1, end - start), " ")
        return let(ends, lambda e: F.when(F.size(e) > 0, F.zip_with(F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1)), e, text)).otherwise(F.array().cast("array<string>")))

    def split(lines: Column) -> Column:
        marked = F.transform(lines, lambda x: F.struct(x.rlike(STARTS).alias("starts"), F.length(x).alias("size")))

        def parts(marked: Column) -> Column:
            count = F.ceil(F.size(marked) / LINES).cast("int")
            return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda p: F.slice(marked, p * LINES + 1, F.lit(LINES)))).otherwise(F.slice(F.array(marked), 1, 0))

        start = F.struct(none.alias("places"), F.lit(0).alias("held"), F.lit(0).alias("at"))
        return let(F.aggregate(let(marked, parts), start, over), lambda told: let(told, lambda t: cut(lines, t)))

    return _in_order(F.transform(let(lines, split), collapse))


WAYS = {"bracket": by_bracket, "dot": by_dot, "plain": by_plain, "blank": by_blank, "author": by_author}
LEAST = {"bracket": 5, "dot": 5, "plain": 5, "blank": 3, "author": 0}


def split_references(section: Column) -> Column:
    """struct(strategy, refs): the first way that gives enough references, the last one in any case."""

    def enough(s: str):
        return lambda r: F.when(F.size(r) >= LEAST[s], F.struct(F.lit(s).alias("strategy"), r.alias("refs")))

    tried = [let(WAYS[s](section), enough(s)) for s in STRATEGIES]
    return F.when(section.isNotNull(), F.coalesce(*tried))


def reference_details(text: Column) -> Column:
    """struct(text, doi, year, title); title is empty where one was found and nothing but punctuation stood in it."""
    clean = collapse(text)
    quoted = F.regexp_extract(clean, TITLE, 1)
    title = F.when(clean.rlike(TITLE), F.when(quoted != "", quoted).otherwise(F.regexp_extract(clean, TITLE, 2)))
    title = F.regexp_replace(trim(title), r"\.$", "")
    title = trim(F.regexp_replace(title, r"^[)\]}>.,;:\s]+", ""))
    doi = F.regexp_replace(found(clean, DOI), r"[.,;:\s]+$", "")
    return F.struct(clean.alias("text"), doi.alias("doi"), found(clean, YEAR).alias("year"), title.alias("title"))


def raw_references(docs: DataFrame) -> DataFrame:
    """doc_id, pos, number, text, doi, year, title of each reference of ``docs`` (doc_id, content)."""
    rows = docs.select("doc_id", find_section(F.col("content")).alias("section")).where(F.col("section").rlike(r"\S"))
    rows = rows.select("doc_id", F.posexplode(split_references(F.col("section"))["refs"]).alias("pos", "r"))
    rows = rows.select("doc_id", "pos", "r.number", reference_details(F.col("r.text")).alias("d"))
    return rows.select("doc_id", "pos", "number", "d.*")


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"  {name} = {{"), value, F.lit("},\n")))


def probe_entry(number: Column, doi: Column, year: Column, title: Column) -> Column:
    """The entry that a reference is looked up by."""
    head = F.concat(F.lit("@misc{ref"), F.coalesce(number.cast("string"), F.lit("null")), F.lit(",\n"))
    return F.concat_ws("", head, F.when(title.isNotNull(), _line("title", escape_bibtex(title))), _line("doi", doi), _line("year", year), F.lit("  note = {Extracted from PDF}\n}"))


def basic_entry(number: Column, text: Column, doi: Column, year: Column, title: Column) -> Column:
    """The entry of a reference that isn't verified."""
    short = F.when(F.length(text) > 100, F.concat(F.left(text, F.lit(100)), F.lit("..."))).otherwise(text)
    head = F.concat(F.lit("@misc{"), generate_key(text, year, number, title), F.lit(",\n"))
    return F.concat_ws("", head, _line("title", escape_bibtex(F.coalesce(title, short))), _line("year", year), _line("doi", doi), F.lit("  note = {Extracted from PDF - needs manual verification}\n}"))


def convert(refs: DataFrame, responses: DataFrame, mode: str = "SAFE", month_style: str = "KEEP_ORIGINAL") -> DataFrame:
    """doc_id, pos, number, text, entry, verified, message of each raw reference, looked up in a snapshot."""
    from bibspark.operators import enrich

    query = F.coalesce("doi", "title")
    rows = refs.withColumn("asked", F.coalesce(query.rlike(r"\S"), F.lit(False)))
    probes = rows.where("asked").select(F.col("doc_id").cast("string").alias("source_path"), F.col("pos").alias("ord"), probe_entry(*[F.col(c) for c in ("number", "doi", "year", "title")]).alias("raw"))
    told = enrich.verify(probes, responses, mode, month_style).select(F.col("source_path").alias("d"), F.col("ord").alias("o"), "status", "corrected", F.col("message").alias("said"))
    out = rows.join(told, (F.col("doc_id").cast("string") == F.col("d")) & (F.col("pos") == F.col("o")), "left")
    good = F.coalesce(F.col("status").isin("VERIFIED", "CORRECTED"), F.lit(False))
    basic = basic_entry(*[F.col(c) for c in ("number", "text", "doi", "year", "title")])
    message = F.when(F.col("asked"), F.col("said")).otherwise(F.lit("Could not extract enough information to verify"))
    return out.select("doc_id", "pos", "number", "text", F.when(good, F.col("corrected")).otherwise(basic).alias("entry"), good.alias("verified"), message.alias("message"))


def extraction(docs: DataFrame, converted: DataFrame, generator: str = "bibspark") -> DataFrame:
    """doc_id, bibtex_output, total_found, converted, errors, messages for every document."""
    note = F.when(~F.col("verified"), F.lit("% WARNING: Could not verify this reference\n")).otherwise(F.lit(""))
    block = F.concat(note, F.col("entry"), F.lit("\n\n"))
    per = converted.groupBy(F.col("doc_id").alias("d")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda r: r["b"]), "").alias("body"), F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("ok"))
    section = find_section(F.col("content"))
    rows = docs.select("doc_id", section.alias("section")).join(per, F.col("doc_id") == F.col("d"), "left")
    there = F.coalesce(F.col("section").rlike(r"\S"), F.lit(False))
    n, ok = F.coalesce("n", F.lit(0)), F.coalesce("ok", F.lit(0))
    head = F.lit(f"% References extracted from PDF\n% Generated by {generator}\n\n")
    said = lambda text, v: F.concat(F.lit(text), v.cast("string"))
    parsed = [F.concat(F.lit("Found references section ("), F.length("section").cast("string"), F.lit(" characters)")), F.concat(F.lit("Parsed "), n.cast("string"), F.lit(" raw references"))]
    messages = F.when(~there, F.array(F.lit("Could not locate references section in the document."))).when(n == 0, F.array(*parsed, F.lit("No references could be parsed from the section."))).otherwise(F.array(*parsed, said("Successfully converted: ", ok), said("Verification errors: ", n - ok)))
    return rows.select("doc_id", F.when(n > 0, F.concat(head, F.col("body"))).otherwise(F.lit("")).alias("bibtex_output"), n.alias("total_found"), ok.alias("converted"), (n - ok).alias("errors"), messages.alias("messages"))


def extract(docs: DataFrame, responses: DataFrame, mode: str = "SAFE", month_style: str = "KEEP_ORIGINAL", generator: str = "bibspark") -> DataFrame:
    """``extraction`` of documents (doc_id, content), looked up in a snapshot."""
    return extraction(docs, convert(raw_references(docs), responses, mode, month_style), generator)


def extract_from_files(spark, path: str | list[str], decoder, responses: DataFrame, suffix: str = ".pdf", **how) -> DataFrame:
    """``extract`` of the documents in files; doc_id is the path. Their text is what ``decoder`` makes of their bytes, or with None what
    ``sources.pdf`` reads."""
    from bibspark.sources import bib, pdf

    docs = pdf.read(spark, path, suffix) if decoder is None else bib.decode_binary(spark, path, decoder, suffix)
    return extract(docs.select(F.col("source_path").alias("doc_id"), "content"), responses, **how)
