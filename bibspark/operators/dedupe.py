"""De-duplication in order: by key, or by key and title.

An entry goes if an entry that was kept has its key, or else its title signature; what goes registers nothing. That is a
greedy choice along the order and no window function. ``scope="source"`` looks for duplicates within each source,
``scope="corpus"`` over all of them.

Small groups, of at most ``FINISH`` entries, are folded in order, as arrays of small rows (key and a hash of the signature, no
texts); all others are decided without an order, by rounds over the entries that are still open:

* What is first both of its key and of its signature stays. An entry that only one open entry stands before (being the second of its
  key, or of its signature, or both, and the first otherwise) stays if and only if that one goes. These links make trees, along
  which all is decided whose root stays; and what has a key or a signature of what stays goes.
* Of any other root it is known which entries of its tree go together, so that the first two of a key that are opposites of each
  other take it, whatever the root does: all later ones go.

Entries find their roots by ranges of the order: a task walks along its entries, of which it knows up to ``NEAR`` at a time, so that
each stands on an entry outside. What others stand on, few entries in chains of neighbours, is a smaller task of the same kind; so a chain
is moved a fixed number of times, however long it is. Only links that lead far away, which this leaves over half of, go by pointer jumping:
about log2(n) joins for a chain of n entries.

Aggregates are combined map-side, so that a key of very many entries is two rows for each task. What is open falls in each round, as its
first entry is decided; only entries with two open ones before them, which have two more each, and so on, make a number of rounds that
grows. When at most ``FINISH`` are open, these are folded. No task ever folds more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.functions.chars import bounded, utf16
from bibspark.functions.text import title_signature
from bibspark.operators import parse
from bibspark.storage import materialize, scratch

FINISH = 1000
NEAR = 1 << 16
KEY, TITLE = "KEY_DUPLICATE", "TITLE_DUPLICATE"
#: A reason that the order of the tests never gives: equal titles are found before equal titles and years.
TITLE_YEAR = "TITLE_YEAR_DUPLICATE"

_VERDICT = pa.list_(pa.struct([("i", pa.int32()), ("owner", pa.string()), ("reason", pa.string())]))


def _fold(keys: list, signatures: list) -> list[dict]:
    by_key: set = set()
    by_title: dict = {}
    out = []
    for i, (k, s) in enumerate(zip(keys, signatures)):
        if k in by_key:
            out.append({"i": i, "owner": k, "reason": KEY})
        elif s is not None and s in by_title:
            out.append({"i": i, "owner": by_title[s], "reason": TITLE})
        else:
            by_key.add(k)
            if s is not None:
                by_title[s] = k
            out.append({"i": i, "owner": None, "reason": None})
    return out


def _verdicts(keys: Column, signatures: Column) -> Column:
    @F.arrow_udf("array<struct<i: int, owner: string, reason: string>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, signatures in bounded(batches):
            yield pa.array([_fold(k, s) for k, s in zip(keys.to_pylist(), signatures.to_pylist())], _VERDICT)

    return run(keys, signatures)


def _folded(rows: DataFrame) -> DataFrame:
    """group, at, kept_key, reason by the fold; each group is an array in one task."""
    one = rows.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("at", "key", "signature"))).alias("r"))
    told = one.select("group", "r.at", _verdicts(F.col("r.key"), F.col("r.signature")).alias("v"))
    told = told.select("group", F.inline(F.arrays_zip("at", "v")))
    return told.select("group", "at", F.col("v.owner").alias("kept_key"), F.col("v.reason").alias("reason"))


def _links(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` (group, at, key, signature) and before_key, before_title: the entry before, for the second of a key or of
    a signature; later_key, later_title: whether two or more stand before."""

    def ranked(rows: DataFrame, by: str) -> DataFrame:
        order = Window.partitionBy("group", by).orderBy("at")
        # the first two of a key are all that is sent on from any task
        two = rows.where(F.col(by).isNotNull()).select("group", by, "at", F.row_number().over(order).alias("n")).where("n <= 2")
        return two.groupBy("group", by).agg(F.min("at").alias("one"), F.when(F.count(F.lit(1)) == 2, F.max("at")).alias("two"))

    for by, name in (("key", "key"), ("signature", "title")):
        rows = rows.join(ranked(rows, by), ["group", by], "left")
        rows = rows.withColumn(f"before_{name}", F.when(F.col("at") == F.col("two"), F.col("one"))).withColumn(f"later_{name}", F.coalesce(F.col("at") > F.col("two"), F.lit(False))).drop("one", "two")
    return rows


def _near(linked: DataFrame) -> DataFrame:
    """``linked`` (group, at, root, flips) with roots that are none of the ``NEAR`` entries that a task knows with theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            at, root = (list(zip(*(c.to_pylist() for c in batch.column(name).flatten()))) for name in ("at", "root"))
            flips = batch.column("flips").to_pylist()
            for i, (a, r) in enumerate(zip(at, root)):
                if r in known:
                    root[i], more = known[r]
                    flips[i] = flips[i] != more
                known[a] = root[i], flips[i]
            kind = batch.schema.field("root").type
            fields = [kind.field(i) for i in range(kind.num_fields)]
            roots = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*root), fields)], fields=fields) if root else batch.column("root")
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("at"), roots, pa.array(flips, pa.bool_())], ["group", "at", "root", "flips"])
            if len(known) >= NEAR:
                known = {}

    # an entry's root stands before it
    return linked.repartitionByRange("group", "at").sortWithinPartitions("group", "at").mapInArrow(run, linked.schema)


def _up(linked: DataFrame, roots: DataFrame) -> DataFrame:
    """``linked`` (group, at, root, flips) with the roots of their roots, and moved: whether these have any."""
    up = roots.select("group", F.col("at").alias("root"), F.col("root").alias("next"), F.col("flips").alias("more"))
    met = linked.join(up, ["group", "root"], "left")
    return met.select("group", "at", F.coalesce("next", "root").alias("root"), (F.col("flips") != F.coalesce("more", F.lit(False))).alias("flips"), F.col("next").isNotNull().alias("moved"))


def _jumped(linked: DataFrame) -> DataFrame:
    """``_rooted`` by pointer jumping."""
    while True:
        new = materialize(_up(linked, linked), "dedupe-roots")
        linked = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return linked


def _rooted(linked: DataFrame) -> DataFrame:
    """``linked`` (group, at, root: the entry before, flips: true) with root, and whether an entry does the opposite of its root."""
    near = materialize(_near(linked), "dedupe-near")
    met = materialize(near.select("group", F.col("root").alias("at")).distinct(), "dedupe-met")
    between = materialize(near.join(met, ["group", "at"], "left_semi").select(*near.columns), "dedupe-between")
    left = between.count()
    if not left:
        return near
    roots = _jumped(between) if left > near.count() // 2 else _rooted(between)
    return materialize(_up(near, roots).drop("moved"), "dedupe-roots")


def _round(rows: DataFrame) -> DataFrame:
    """What stays (``stays`` true) or is still open of ``rows``; what goes is left out."""
    alone, by_key, by_title = ~F.col("later_key") & ~F.col("later_title"), F.col("before_key"), F.col("before_title")
    before = F.when(alone & by_title.isNull(), by_key).when(alone & (by_key.isNull() | (by_key == by_title)), by_title)
    rows = _links(rows).select("group", "at", "key", "signature", before.alias("root"), (alone & by_key.isNull() & by_title.isNull()).alias("sure"))
    rows = materialize(rows, "dedupe-links")
    roots = _rooted(rows.where("root IS NOT NULL").select("group", "at", "root", F.lit(True).alias("flips")))
    # a root that nothing stands before stays
    unsure = materialize(rows.where("root IS NULL AND NOT sure").select("group", F.col("at").alias("root"), F.lit(False).alias("known")), "dedupe-unsure")
    roots = roots.join(unsure, ["group", "root"], "left").withColumn("known", F.coalesce("known", F.lit(True)))
    told = rows.drop("root").join(roots, ["group", "at"], "left")
    told = told.select("group", "at", "key", "signature", F.coalesce("root", "at").alias("root"), F.coalesce("flips", F.lit(False)).alias("flips"), F.coalesce("known", "sure").alias("sure"))
    told = materialize(told, "dedupe-told")
    # in the tree of a root that stays all is decided
    stay = told.where("sure AND NOT flips").select("group", "at", "key", "signature", F.lit(True).alias("stays"))
    left = told.where("NOT sure")
    for by in ("key", "signature"):
        have = left.where(F.col(by).isNotNull())
        # opposites: one of them stays, so what comes after both goes
        each = have.groupBy("group", by, "root").agg(F.min(F.when(F.col("flips"), F.col("at"))).alias("odd"), F.min(F.when(~F.col("flips"), F.col("at"))).alias("even"))
        both = each.where("odd IS NOT NULL AND even IS NOT NULL").groupBy("group", by).agg(F.min(F.greatest("odd", "even")).alias("until"))
        mine = stay.where(F.col(by).isNotNull()).select("group", by, F.lit(True).alias("met")).distinct()
        left = left.join(both, ["group", by], "left").join(mine, ["group", by], "left")
        left = left.withColumn(f"out_{by}", F.coalesce("met", F.lit(False)) | F.coalesce(F.col("at") > F.col("until"), F.lit(False))).drop("until", "met")
    return stay.unionByName(left.where("NOT (out_key OR out_signature)").select("group", "at", "key", "signature", F.lit(False).alias("stays")))


def _by_rounds(rows: DataFrame, finish: int) -> DataFrame:
    """group, at, kept_key, reason by rounds."""
    with scratch() as keep:
        open_, kept, left = rows, [], rows.count()
        while left > finish:
            now = materialize(_round(open_), "dedupe-round")
            kept.append(now.where("stays").drop("stays"))
            open_ = now.where("NOT stays").drop("stays")
            left = open_.count()
        # what is open has no neighbour that stays, so the fold needs nothing but itself
        last = _folded(open_).where("reason IS NULL").select("group", "at")
        kept.append(open_.join(last, ["group", "at"], "left_semi"))
        stay = keep(reduce(DataFrame.unionByName, kept), "dedupe-kept")
    by_key = stay.select("group", "key", F.col("at").alias("key_at"))
    by_title = stay.where("signature IS NOT NULL").select("group", "signature", F.col("key").alias("owner"))
    told = rows.join(by_key, ["group", "key"], "left").join(by_title, ["group", "signature"], "left")
    reason = F.when(F.coalesce(F.col("at") == F.col("key_at"), F.lit(False)), F.lit(None).cast("string")).when(F.col("key_at") < F.col("at"), F.lit(KEY)).otherwise(F.lit(TITLE))
    told = told.withColumn("reason", reason)
    owner = F.when(F.col("reason") == KEY, F.col("key")).when(F.col("reason") == TITLE, F.col("owner"))
    return told.select("group", "at", owner.alias("kept_key"), "reason")


def _decided(rows: DataFrame, scope: str, finish: int) -> DataFrame:
    """source_path, ord, kept_key, reason of ``rows`` (source_path, ord, key, signature)."""
    group = F.col("source_path") if scope == "source" else F.lit("")
    rows = materialize(rows.select(group.alias("group"), F.struct("source_path", "ord").alias("at"), "key", F.unhex(F.md5(F.col("signature").cast("binary"))).alias("signature")), "dedupe")
    sizes = rows.groupBy("group").agg((F.count(F.lit(1)) > finish).alias("large"))
    if sizes.where("large").limit(1).count():
        rows = rows.join(sizes, "group")
        large = materialize(rows.where("large").drop("large"), "dedupe-large")
        told = _folded(rows.where("NOT large").drop("large")).unionByName(_by_rounds(large, finish))
    else:
        told = _folded(rows)
    return told.select("at.source_path", "at.ord", "kept_key", "reason")


def judged(entries: DataFrame, smart: bool = True, scope: str = "source", finish: int = FINISH) -> DataFrame:
    """The columns of ``entries`` (source_path, ord, key, raw, ...) with kept_key and reason, null for what stays."""
    if not smart:  # the first of each key
        same = ["source_path", "key"] if scope == "source" else ["key"]
        first = entries.groupBy(*same).agg(F.min(F.struct("source_path", "ord")).alias("__first"))
        again = F.struct("source_path", "ord") != F.col("__first")
        told = entries.join(first, same)
        return told.select(*entries.columns, F.when(again, F.col("key")).alias("kept_key"), F.when(again, F.lit(KEY)).alias("reason"))
    rows = parse.fields(entries.select("source_path", "ord", "key", "raw"), "title")
    rows = rows.select("source_path", "ord", "key", title_signature(F.col("title")).alias("signature"))
    return entries.join(_decided(rows, scope, finish), ["source_path", "ord"])


def unique(entries: DataFrame, smart: bool = True, scope: str = "source", sort_by_key: bool = False) -> DataFrame:
    """The entries that stay, in order of source and place, or of key."""
    stays = judged(entries, smart, scope).where("reason IS NULL").drop("kept_key", "reason")
    return stays.orderBy("source_path", utf16(F.col("key")) if sort_by_key else "ord")


def duplicates(entries: DataFrame, smart: bool = True, scope: str = "source") -> DataFrame:
    """source_path, ord, dropped_key, kept_key, reason of each entry that goes."""
    return judged(entries, smart, scope).where("reason IS NOT NULL").select("source_path", "ord", F.col("key").alias("dropped_key"), "kept_key", "reason")


#: What a user is told of a source without entries, and of one without duplicates.
NO_ENTRIES, NO_DUPLICATES = "No reference entries found.", "No duplicates were detected."


def summary(sources: DataFrame, smart: bool = True) -> DataFrame:
    """source_path, total, unique, duplicates, parse_errors; a row for every source, empty ones too."""
    return summary_of(parse.entries(sources), parse.counts(sources), smart)


def summary_of(entries: DataFrame, counts: DataFrame, smart: bool = True) -> DataFrame:
    """``summary`` of entries, and of source_path, parse_errors for every source."""
    told = judged(entries, smart).groupBy("source_path").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("reason").isNull()).alias("unique"))
    rows = counts.join(told, "source_path", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("source_path", n(F.col("total")).alias("total"), n(F.col("unique")).alias("unique"), n(F.col("total") - F.col("unique")).alias("duplicates"), "parse_errors")


def processed(sources: DataFrame, smart: bool = True) -> DataFrame:
    """source_path, parse_errors, ord, type, key, raw, kept_key, reason: every entry and what became of it; a row without ``ord`` for a
    source that has none. Sources are parsed once and judged once; both are written."""
    told = parse.parsed(sources).select("source_path", F.size("parsed.errors").cast("long").alias("parse_errors"), F.explode_outer("parsed.entries").alias("e"))
    return judged_once(told.select("source_path", "parse_errors", "e.ord", "e.type", "e.key", "e.raw"), smart)


def judged_once(rows: DataFrame, smart: bool = True, scope: str = "source", finish: int = FINISH) -> DataFrame:
    """``rows`` (source_path, ord, key, raw, ...; ord null for what is no entry) with kept_key and reason, written."""
    rows = materialize(rows, "parsed")
    reasons = judged(rows.where("ord IS NOT NULL").select("source_path", "ord", "key", "raw"), smart, scope, finish).drop("key", "raw")
    return rows.join(materialize(reasons, "reasons"), ["source_path", "ord"], "left").select(*rows.columns, "kept_key", "reason")


def summary_of_processed(rows: DataFrame) -> DataFrame:
    """``summary`` of what ``processed`` gives."""
    n, stays = F.count("ord"), F.count_if(F.col("ord").isNotNull() & F.col("reason").isNull())
    out = rows.groupBy("source_path").agg(n.alias("total"), stays.alias("unique"), F.coalesce(F.max("parse_errors"), F.lit(0)).alias("parse_errors"))
    return out.select("source_path", "total", "unique", (F.col("total") - F.col("unique")).alias("duplicates"), "parse_errors")


def outcome(summary: DataFrame) -> DataFrame:
    """The columns of ``summary`` and message: null for a source that has entries."""
    return summary.withColumn("message", F.when(F.col("total") == 0, F.lit(NO_ENTRIES)))


def normalize_months(entries: DataFrame, style: str) -> DataFrame:
    """Rewrite the month field of each raw entry in a style; entries without a readable month, or in style, stay."""
    from bibspark.functions import months, scanner

    if style == "KEEP_ORIGINAL":
        return entries
    rows = parse.fields(entries, "month")
    new = months.format_month(months.month_number(F.col("month")), style, F.col("month"))
    rows = rows.withColumn("__new", F.when(months.month_number(F.col("month")).isNotNull() & (new != F.col("month")), new))
    return rows.withColumn("raw", scanner.replace_field(F.col("raw"), "month", F.col("__new"))).drop("month", "__new")
