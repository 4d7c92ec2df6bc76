"""Rendering: entries from fields, outputs with their headers, reports, and the search over an output.

An output may be one text for each source, or rows of blocks (``output_blocks``, ``verified_blocks``): the header and each entry with
the blank line behind it, and their order. Blocks are never gathered, so that a source may be of any size; written in order
(``save_blocks``) they are the same text, and a search over them (``search_blocks``) finds the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions.chars import utf16

#: The fields that come first, in this order.
ORDER = ["author", "title", "journal", "booktitle", "year", "month", "volume", "number", "pages", "publisher", "organization", "doi", "isbn", "issn", "url", "note", "keywords", "abstract"]
RULE = "=" * 50
DOUBLE = "═" * 55


def rebuild_entry(kind: Column, key: Column, fields: Column) -> Column:
    """An entry of ``fields`` (array of struct(name, value)): those of ORDER first, the others as they stand."""
    known = F.array(*map(F.lit, ORDER))

    def ranked(f: Column, i: Column) -> Column:
        at = F.array_position(known, f["name"])
        return F.struct(F.when(at > 0, at).otherwise(F.lit(len(ORDER) + 1)).alias("rank"), i.alias("i"), f["name"].alias("name"), f["value"].alias("value"))

    rows = F.array_sort(F.transform(fields, ranked))
    lines = F.transform(rows, lambda r: F.concat(F.lit("  "), r["name"], F.lit(" = {"), r["value"], F.lit("},\n")))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ""), F.lit("}"))


def rebuilt(kind: Column, key: Column, values: dict[str, Column], fields: Column) -> Column:
    """``rebuild_entry`` of an entry whose fields of ORDER are the columns ``values`` (null: none); of ``fields`` only the others count."""
    line = lambda n, v: F.concat(F.lit("  "), n, F.lit(" = {"), v, F.lit("},\n"))
    others = F.filter(fields, lambda f: ~f["name"].isin(*ORDER))
    rest = F.when(F.size(others) > 0, F.array_join(F.transform(others, lambda f: line(f["name"], f["value"])), ""))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.concat_ws("", *[line(F.lit(n), values[n]) for n in ORDER], rest), F.lit("}"))


def _bodies(entries: DataFrame, text: str, by: str) -> DataFrame:
    blocks = F.transform(F.array_sort(F.collect_list(F.struct(by, text))), lambda r: F.concat(r[text], F.lit("\n\n")))
    return entries.groupBy(F.col("source_path").alias("s")).agg(F.array_join(blocks, "").alias("body"))


def _processed_head(month_style: str) -> Column:
    style = "" if month_style == "KEEP_ORIGINAL" else f"% Month style: {month_style}\n"
    head = F.format_string("% Total entries parsed: %d\n% Unique kept: %d\n% Duplicates removed: %d\n% Parse issues: %d\n".replace("% ", "%% "), "total", "unique", "duplicates", "parse_errors")
    return F.concat(head, F.lit(f"{style}% {RULE}\n\n"))


def processed_output(summary: DataFrame, entries: DataFrame, month_style: str = "KEEP_ORIGINAL", sort_by_key: bool = False) -> DataFrame:
    """source_path, output: a header with four counters and the entries that stay (source_path, ord, key, raw); nothing for a
    source without entries."""
    by = utf16(F.col("key")) if sort_by_key else F.col("ord")
    rows = summary.join(_bodies(entries.withColumn("__by", by), "raw", "__by"), F.col("source_path") == F.col("s"), "left")
    text = F.concat(_processed_head(month_style), F.coalesce("body", F.lit("")))
    return rows.select("source_path", F.when(F.col("total") == 0, F.lit("")).otherwise(text).alias("output"))


def _blocks(heads: DataFrame, entries: DataFrame, text: str, sort_by_key: bool) -> DataFrame:
    by = utf16(F.col("key")) if sort_by_key else F.lit(None).cast("binary")
    first = heads.select("source_path", F.lit(0).alias("part"), F.lit(None).cast("binary").alias("by_key"), F.lit(0).alias("ord"), "block")
    rest = entries.where(F.col(text).isNotNull()).select("source_path", F.lit(1).alias("part"), by.alias("by_key"), "ord", F.concat(text, F.lit("\n\n")).alias("block"))
    return first.unionByName(rest)


def output_blocks(summary: DataFrame, entries: DataFrame, month_style: str = "KEEP_ORIGINAL", sort_by_key: bool = False) -> DataFrame:
    """source_path, part, by_key, ord, block: ``processed_output`` as rows, in the order of these columns; no rows for a source
    without entries."""
    heads = summary.where("total > 0").select("source_path", _processed_head(month_style).alias("block"))
    return _blocks(heads, entries, "raw", sort_by_key)


def verified_blocks(summary: DataFrame, verified: DataFrame) -> DataFrame:
    """``verified_output`` as rows, like ``output_blocks``."""
    return _blocks(summary.select("source_path", _verified_head().alias("block")), verified, "corrected", False)


def status_summary(verified: DataFrame, duplicates: DataFrame) -> DataFrame:
    """source_path, duplicates_removed, verified, corrected, not_found, errors, skipped."""
    names = {"verified": "VERIFIED", "corrected": "CORRECTED", "not_found": "NOT_FOUND", "errors": "ERROR", "skipped": "SKIPPED"}
    told = verified.groupBy("source_path").agg(*[F.count_if(F.col("status") == s).alias(c) for c, s in names.items()])
    gone = duplicates.groupBy(F.col("source_path").alias("s")).agg(F.count(F.lit(1)).alias("gone"))
    rows = told.join(gone, F.col("source_path") == F.col("s"), "left")
    return rows.select("source_path", F.coalesce("gone", F.lit(0)).alias("duplicates_removed"), *names)


def _verified_head() -> Column:
    labels = ["Duplicates removed", "Verified (already correct)", "Corrected/completed", "Not found online", "Errors during lookup", "Skipped (no DOI/title)"]
    counts = "".join(f"%% {x}: %d\n" for x in labels)
    rule = f"%% {DOUBLE}\n"
    return F.format_string(f"{rule}%% VERIFICATION & DEDUPLICATION SUMMARY\n{rule}{counts}{rule}\n", "duplicates_removed", "verified", "corrected", "not_found", "errors", "skipped")


def verified_output(summary: DataFrame, verified: DataFrame) -> DataFrame:
    """source_path, output: a header with six counters and the entries as verified (source_path, ord, corrected)."""
    rows = summary.join(_bodies(verified, "corrected", "ord"), F.col("source_path") == F.col("s"), "left")
    return rows.select("source_path", F.concat(_verified_head(), F.coalesce("body", F.lit(""))).alias("output"))


def summary_report(summary: DataFrame, sort_by_key: bool = False, smart: bool = True, mode: str = "SAFE", month_style: str = "KEEP_ORIGINAL", title: str = "References - Summary") -> DataFrame:
    """source_path, report. ``title`` is its first line."""
    flag = lambda b: str(bool(b)).lower()
    rest = f"Sort by key: {flag(sort_by_key)}\nSmart dedupe: {flag(smart)}\nVerification mode: {mode}\nMonth style: {month_style}\n"
    numbers = F.format_string("Total entries: %d\nUnique entries: %d\nDuplicates removed: %d\nParse errors: %d\n", "total", "unique", "duplicates", "parse_errors")
    return summary.select("source_path", F.concat(F.lit(f"{title}\n\n"), numbers, F.lit(rest)).alias("report"))


def duplicates_report(duplicates: DataFrame, sources: DataFrame | None = None, title: str = "References - Duplicates Report") -> DataFrame:
    """source_path, report, message. With ``sources`` (source_path), a row for each of them: the report is null, and the message
    says so, for one without duplicates."""
    from bibspark.operators.dedupe import NO_DUPLICATES

    line = F.format_string("- dropped=%s kept=%s reason=%s\n", "dropped_key", "kept_key", "reason")
    rows = duplicates.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))), lambda r: r["t"]), "").alias("body"))
    if sources is not None:
        rows = sources.select("source_path").distinct().join(rows, "source_path", "left")
    report = F.concat(F.format_string(f"{title}\n\nTotal duplicates removed: %d\n\n", "n"), F.col("body"))
    return rows.select("source_path", F.when(F.col("n").isNotNull(), report).alias("report"), F.when(F.col("n").isNull(), F.lit(NO_DUPLICATES)).alias("message"))


def _needle(needle: str) -> str:
    return needle.lower().strip("".join(map(chr, range(33))))


def _matching(text: Column, needle: str) -> Column:
    """The blocks of a text (between blank lines) that hold ``needle``."""
    return F.filter(F.split(F.regexp_replace(text, r"(?:\n\n)+\z", ""), "\n\n"), lambda b: F.contains(F.lower(b), F.lit(needle)))


def _no_comments(blocks: Column) -> Column:
    return F.size(F.filter(blocks, lambda b: ~F.startswith(b, F.lit("%")))).cast("long")


def _spaced(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: F.concat(b, F.lit("\n\n"))), "")


def search(outputs: DataFrame, needle: str) -> DataFrame:
    """source_path, output, matches: the blocks (between blank lines) that hold ``needle`` in any case, and how many of them are
    no comments; everything for an empty needle."""
    needle = _needle(needle)
    if not needle:
        return outputs.select("source_path", "output", F.lit(None).cast("long").alias("matches"))
    told = outputs.select("source_path", _matching(F.col("output"), needle).alias("b"))
    return told.select("source_path", _spaced(F.col("b")).alias("output"), _no_comments(F.col("b")).alias("matches"))


def search_blocks(blocks: DataFrame, needle: str) -> DataFrame:
    """The rows of ``output_blocks`` that hold ``needle`` in any case, without what doesn't, and matches: how many blocks of each row are
    no comments. An entry with blank lines inside is several blocks, as in ``search``."""
    needle = _needle(needle)
    if not needle:
        return blocks.withColumn("matches", F.lit(None).cast("long"))
    met = blocks.where(F.contains(F.lower("block"), F.lit(needle))).withColumn("__b", _matching(F.col("block"), needle)).where(F.size("__b") > 0)
    return met.select(*[c for c in blocks.columns if c != "block"], _spaced(F.col("__b")).alias("block"), _no_comments(F.col("__b")).alias("matches"))


def save_blocks(blocks: DataFrame, path: str, parts: int | None = None) -> str:
    """Write blocks as text: a folder for each source, whose files, in the order of their names, are its output. Blocks are dealt out by
    ranges of their order, so that a large source is written by many tasks."""
    order = ["source_path", "part", "by_key", "ord"]
    dealt = blocks.repartitionByRange(parts, *order) if parts else blocks.repartitionByRange(*order)
    # the writer ends each row with a line break
    rows = dealt.sortWithinPartitions(*order).select("source_path", F.regexp_replace("block", r"\n\z", "").alias("value"))
    rows.write.partitionBy("source_path").mode("overwrite").text(path)
    return path


def save(blocks: DataFrame, path: str, column: str = "output", suffix: str = ".bib") -> str:
    """Write a text column as text files; the path gets ``suffix`` if it lacks it."""
    path = path if path.lower().endswith(suffix) else path + suffix
    blocks.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
    return path
