r"""Line dedup by a segment-partition edit join (native).

Lines are the \n-separated pieces of a text that hold a word; the other pieces stay as they are. A line goes if an equal
line stands earlier (by doc_id, then line number), or if its first occurrence comes after the first occurrence of
another line within reach of it. Two lines are within reach if they are an edit apart for each ``PER_EDIT`` (24) bytes of the
shorter one, ``EDITS`` (2) at most; so one of under 24 bytes, of which an edit is a large part, goes only with equal ones.
Edits count in UTF-8 bytes. The rule looks at all lines of the input and not at what is left: of a chain of lines, each
within reach of the one before, the first stays.

Candidates: a line of n bytes is of class L (n rounded down to 16; to 8 below 48) and gives one disjoint segment more than
there may be edits, each of a = L / 3 bytes (L / 2 below 48): its first a bytes, its last a bytes, and from 48 bytes on the a
bytes after the first. One of them is left untouched. If it is the first, the other line starts with it; if the last, the
other ends with it; else both have an edit and the middle one has moved by -1, 0 or 1. So a line looks up 5 keys (2 below 48)
for its own class, and for the class below if a shorter line within reach would be in it. The longer line of a pair looks up
the shorter.

Only distinct lines take part, so that one line with very many copies counts once; they are counted by map-side
combined sums, as are the lines of a key. Keys that a single line has are dropped. Pairs are formed inside the join, whose
condition compares lengths and letter counts (an edit changes these by two at most), so what comes out is little more than
the links themselves. A key that very many distinct lines share (``CHUNK``) is cut by the lines' exact length, which the
other line has but for the edits, and by a salt that the lookups repeat: no key meets in one task. Pairs are verified by
bit-parallel edit distance within a band of five diagonals: one integer for each number of errors, updated byte by byte.

Texts are fetched for candidate lines only. The scan that fetches them is thinned by a bitmap of fixed size (2^24 bits,
broadcast: 2^18 rows at most), then joined exactly.

Defined results: null text has no lines and stays null; an empty text stays empty; a text all of whose lines go becomes
empty. Rows that share a doc_id, or have none (these come first), are documents of their own if their texts differ, in the order
of a hash of the text; if these are equal too, they count as one and get the same result. Very long texts and lines are
handled whole. An empty table gives no rows. Columns with any other names are kept by ``dedupe_lines`` and not looked at;
one named ``line_dedup`` is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, materialize, release

EDITS, PER_EDIT = 2, 24
LONG = EDITS * PER_EDIT  # bytes from which all edits are allowed
CHUNK = 2048  # lines of a key that meet in one place
#: Frequent letters, whose counts are compared.
LETTERS = "entaiorshdul"
BITMAP = 1 << 24


def _right(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by)


def _bytes(line: Column) -> Column:
    """A string with a character for each byte."""
    return F.decode(line.cast("binary"), "ISO-8859-1")


def _hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def reach(n: Column) -> Column:
    """The edits that a line of n bytes allows, if it is the shorter one."""
    return F.least(F.floor(n / F.lit(PER_EDIT)), F.lit(EDITS)).cast("int")


def _keys(b: Column, n: Column) -> Column:
    """Array of struct(key, role) of a line; role: 1 to be found, 2 to look up, 3 both."""

    def of(level: Column, own: bool) -> Column:
        both = F.lit(3 if own else 2)

        def pieces(a: Column) -> list[tuple[int, Column, Column]]:
            return [(1, b.substr(F.lit(1), a), both), (3, b.substr(n - a + 1, a), both)]

        def keys(parts: list[tuple[int, Column, Column]]) -> Column:
            return F.array(*[F.struct(F.xxhash64(level, F.lit(p), t).alias("key"), r.cast("byte").alias("role")) for p, t, r in parts])

        half, third = (level / 2).cast("int"), (level / 3).cast("int")
        middle = [(2, b.substr(third + 1 + shift, third), both if shift == 0 else F.lit(2)) for shift in (-1, 0, 1)]
        return F.when(level < LONG, keys(pieces(half))).otherwise(keys(pieces(third) + middle))

    level = F.when(n < LONG, n - n % 8).otherwise(n - n % 16).cast("int")
    below = F.when(level <= LONG, level - 8).otherwise(level - 16)
    lower = (below >= PER_EDIT) & (n - reach(below) < level)
    none = F.array().cast("array<struct<key: bigint, role: tinyint>>")
    return F.when(n >= PER_EDIT, F.concat(of(level, True), F.when(lower, of(below, False)).otherwise(none))).otherwise(none)


def within_edits(s: Column, t: Column, edits: int = EDITS) -> Column:
    """Whether two strings are within ``edits`` edits: a band of 2 * edits + 1 diagonals, bit-parallel.

    Bit d + edits of state e says that the first j + d characters of s match the first j of t with e errors at most.
    """
    band, full = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    start = [1 << edits]
    for _ in range(edits):
        start.append((start[-1] | start[-1] << 1) & full)

    def run(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]

        def step(acc: Column, j: Column) -> Column:
            def with_char(c: Column) -> Column:
                hit = reduce(lambda p, q: p.bitwiseOR(q), [F.when(F.get(x, j + (d - edits)) == c, F.lit(1 << d)).otherwise(F.lit(0)) for d in range(band)])

                def with_hit(h: Column) -> Column:
                    new = [acc["r0"].bitwiseAND(h)]
                    for e in range(1, edits + 1):
                        old = acc[f"r{e - 1}"]
                        moved = acc[f"r{e}"].bitwiseAND(h).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1))
                        new.append(moved.bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(full)))
                    return F.struct(*[v.alias(f"r{e}") for e, v in enumerate(new)])

                return let(hit, with_hit)

            return let(F.get(y, j), with_char)

        init = F.struct(*[F.lit(v).alias(f"r{e}") for e, v in enumerate(start)])
        last = F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), init, step, lambda acc: acc[f"r{edits}"])
        return _right(F.when(F.size(y) > 0, last).otherwise(F.lit(start[-1])), F.size(x) - F.size(y) + edits).bitwiseAND(F.lit(1)) == 1

    near = F.abs(F.length(s) - F.length(t)) <= edits
    chars = lambda v: F.filter(F.split(v, ""), lambda c: c != "")
    return F.when(near, let(F.struct(chars(s).alias("x"), chars(t).alias("y")), run)).otherwise(F.lit(False))


def _lines(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))
    h1, h2 = _hashes(F.col("line"))
    return rows.where(F.col("line").rlike(WORD)).select("doc_id", "line_no", "line", h1.alias("h1"), h2.alias("h2"), F.octet_length("line").alias("n"))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """h1, h2, first (doc_id, line_no), copies, n, keys for each distinct line."""
    rows = _lines(docs)
    rows = rows.select("h1", "h2", F.struct("doc_id", "line_no").alias("at"), "n", _keys(_bytes(F.col("line")), F.col("n")).alias("keys"))
    return rows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h1, h2, b (bytes), n, counts of the lines whose h1 is in ``wanted``, each once or more."""
    spot = F.pmod(F.col("h1"), F.lit(BITMAP))
    bits = wanted.select((spot / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    lines = _lines(docs).where(F.col("n") >= PER_EDIT).withColumn("spot", spot)
    lines = lines.join(F.broadcast(bits), (F.col("spot") / 64).cast("int") == F.col("word"))
    lines = lines.where(_right(F.col("bits"), (F.col("spot") % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    lines = lines.select("h1", "h2", "line").dropDuplicates(["h1", "h2"])
    found = lines.join(wanted, "h1", "left_semi")
    b = _bytes(F.col("line"))
    counts = F.array(*[(F.length(b) - F.length(F.replace(b, F.lit(c), F.lit("")))).cast("short") for c in LETTERS])
    return found.select("h1", "h2", b.alias("b"), F.length(b).alias("n"), counts.alias("counts"))


def links(docs: DataFrame, lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """s1, s2, t1, t2: the hashes of the lines of each pair within reach, each pair once."""
    rows = lines.where(F.size("keys") > 0).select("h1", "n", F.explode("keys").alias("k")).select("h1", "n", F.col("k.key").alias("key"), F.col("k.role").alias("role"))
    own = F.col("role").bitwiseAND(F.lit(1).cast("byte")) > 0
    sums = rows.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.count_if(own).alias("own"))
    sums = sums.where((F.col("lo") != F.col("hi")) & (F.col("own") > 0)).select(F.col("key").alias("k"), F.ceil(F.col("own") / F.lit(chunk)).cast("int").alias("chunks"))
    met = materialize(rows.join(sums, F.col("key") == F.col("k")).select("key", "h1", "role", "chunks"), "line-keys")
    release(docs.sparkSession)
    text = materialize(_fetch(docs, met.select("h1").distinct()), "line-texts")
    known = met.join(text.select("h1", "h2", "n", "counts"), "h1")
    # a hot key's lines are cut by length and salt; the longer line looks for its own length and those within reach below it
    hot = F.col("chunks") > 1
    a = known.where(own).select("key", F.when(hot, F.col("n")).otherwise(F.lit(0)).alias("size"), F.pmod("h1", "chunks").cast("int").alias("salt"), *[F.col(c).alias(f"s_{c}") for c in ("h1", "h2", "n", "counts")])
    sizes = F.when(hot, F.sequence(F.col("n") - EDITS, F.col("n"))).otherwise(F.array(F.lit(0)))
    b = known.where(F.col("role") >= 2).withColumn("size", F.explode(sizes)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    b = b.select(*[F.col(c).alias(f"{c}_t") for c in ("key", "size", "salt")], *[F.col(c).alias(f"t_{c}") for c in ("h1", "h2", "n", "counts")])
    gap, most = F.col("t_n") - F.col("s_n"), reach(F.col("s_n"))
    ordered = (gap > 0) | (F.struct("s_h1", "s_h2") < F.struct("t_h1", "t_h2"))
    apart = reduce(lambda x, y: x + y, [F.abs(F.col("s_counts")[i] - F.col("t_counts")[i]) for i in range(len(LETTERS))])
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"{c}_t") for c in ("key", "size", "salt")])
    pairs = a.join(b, same & (gap >= 0) & (gap <= most) & ordered & (apart <= 2 * most))
    pairs = pairs.select("s_h1", "s_h2", "t_h1", "t_h2").distinct()
    s = text.select(F.col("h1").alias("s_h1"), F.col("h2").alias("s_h2"), F.col("b").alias("s"))
    t = text.select(F.col("h1").alias("t_h1"), F.col("h2").alias("t_h2"), F.col("b").alias("t"))
    pairs = pairs.join(s, ["s_h1", "s_h2"]).join(t, ["t_h1", "t_h2"])
    near = reduce(lambda x, e: x.when(reach(F.length("s")) == e, within_edits(F.col("s"), F.col("t"), e)), range(1, EDITS + 1), F.when(F.lit(False), F.lit(False)))
    pairs = pairs.where(near.otherwise(F.lit(False)))
    return pairs.select(F.col("s_h1").alias("s1"), F.col("s_h2").alias("s2"), F.col("t_h1").alias("t1"), F.col("t_h2").alias("t2"))


def line_verdicts(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, kept (line numbers that stay), n_first, n_near, n_links for each document that is the first to hold a line.

    n_first: lines whose first occurrence is in the document; n_near: those of them that go as near copies; n_links: the
    links that they have to other lines.
    """
    lines = materialize(distinct_lines(docs), "lines")
    release(docs.sparkSession)
    pairs = materialize(links(docs, lines, chunk), "line-links")
    both = pairs.unionByName(pairs.select(F.col("t1").alias("s1"), F.col("t2").alias("s2"), F.col("s1").alias("t1"), F.col("s2").alias("t2")))
    first = lines.select("h1", "h2", "first")
    other = first.select(F.col("h1").alias("t1"), F.col("h2").alias("t2"), F.col("first").alias("other"))
    reached = both.join(other, ["t1", "t2"]).groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n_links"), F.min("other").alias("earliest"))
    rows = first.join(reached, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")), "left")
    near = F.coalesce(F.col("earliest") < F.col("first"), F.lit(False))
    rows = rows.select(F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"), near.alias("near"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.groupBy("doc_id").agg(F.collect_list(F.when(~F.col("near"), F.col("line_no"))).alias("kept"), F.count(F.lit(1)).alias("n_first"), F.count_if("near").alias("n_near"), F.sum("n_links").alias("n_links"))


def dedupe_lines(docs: DataFrame, key: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """The rows and columns of ``docs`` (doc_id, text, ...), with a struct column ``line_dedup``: text without the lines
    that go, n_lines, n_removed, n_near, n_links. ``key``: what tells documents apart and orders them, if not doc_id
    and then a hash of the text."""
    if key is None:
        key = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2"))
    told = line_verdicts(docs.select(key.alias("doc_id"), "text"), chunk).select(F.struct("*").alias("__told"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), key.alias("__key"))
    rows = rows.join(told, F.col("__key").eqNullSafe(F.col("__told.doc_id")), "left")

    def rebuilt(p: Column) -> Column:
        bare = F.filter(F.sequence(F.lit(0), F.size(p["l"]) - 1), lambda i: ~F.get(p["l"], i).rlike(WORD))
        stay = F.array_sort(F.array_union(bare, p["k"]))
        gone = F.size(p["l"]) - F.size(stay)
        # of a text that loses lines and keeps none with a word, nothing is left
        text = F.when((F.size(p["k"]) == 0) & (gone > 0), F.lit("")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(p["l"], i)), "\n"))
        words = F.size(p["l"]) - F.size(bare)
        return F.struct(text.alias("text"), words.cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"))

    pieces = F.split(F.col("__row.text").cast("string"), "\n")
    kept = F.coalesce(F.col("__told.kept"), F.array().cast("array<int>"))
    new = let(F.struct(pieces.alias("l"), kept.alias("k")), rebuilt)
    rows = rows.withColumn("__new", F.when(F.col("__row.text").isNotNull(), new))
    zero = F.lit(0).cast("long")
    done = F.struct(F.col("__new.text").alias("text"), *[F.coalesce(c, zero).alias(n) for c, n in ((F.col("__new.n_lines"), "n_lines"), (F.col("__new.n_removed"), "n_removed"), (F.col("__told.n_near"), "n_near"), (F.col("__told.n_links"), "n_links"))])
    return rows.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns if c != "line_dedup"], done.alias("line_dedup"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedupe_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", "line_dedup.n_near", "line_dedup.n_links", F.sha2(F.col("line_dedup.text").cast("binary"), 256).alias("text_sha256"))


ORACLE = r"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
l AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS has FROM p),
f AS (SELECT line, min({'d': doc_id, 'n': line_no}) AS at, strlen(line) AS n FROM l WHERE has GROUP BY line),
c AS (SELECT *, strlen(replace(line, 'e', '')) AS e, strlen(replace(line, 't', '')) AS t, strlen(replace(line, 'a', '')) AS a, strlen(replace(line, 'n', '')) AS o, n + 1 AS n1, n + 2 AS n2 FROM f WHERE n >= 24),
j AS (SELECT s.line AS s, t.line AS t, s.at AS sa, t.at AS ta, s.n AS n FROM c s JOIN c t ON t.n = s.n AND s.line < t.line AND abs(s.e - t.e) <= 4 AND abs(s.t - t.t) <= 4 AND abs(s.a - t.a) <= 4 AND abs(s.o - t.o) <= 4
      UNION ALL SELECT s.line, t.line, s.at, t.at, s.n FROM c s JOIN c t ON t.n = s.n1 AND abs(s.e - t.e) <= 4 AND abs(s.t - t.t) <= 4 AND abs(s.a - t.a) <= 4 AND abs(s.o - t.o) <= 4
      UNION ALL SELECT s.line, t.line, s.at, t.at, s.n FROM c s JOIN c t ON t.n = s.n2 AND abs(s.e - t.e) <= 4 AND abs(s.t - t.t) <= 4 AND abs(s.a - t.a) <= 4 AND abs(s.o - t.o) <= 4),
k AS (SELECT s, t, sa, ta FROM j WHERE levenshtein(s, t) <= least(2, n // 24)),
b AS (SELECT s AS line, ta AS other FROM k UNION ALL SELECT t, sa FROM k),
r AS (SELECT line, count(*) AS n_links, min(other) AS earliest FROM b GROUP BY line),
v AS (SELECT f.line, f.at, coalesce(r.n_links, 0) AS n_links, coalesce(r.earliest < f.at, false) AS near FROM f LEFT JOIN r ON r.line = f.line),
o AS (SELECT l.*, v.at = {'d': l.doc_id, 'n': l.line_no} AS first, v.near, v.n_links FROM l LEFT JOIN v ON l.has AND l.line = v.line)
SELECT doc_id, count(*) FILTER (has) AS n_lines, count(*) FILTER (has AND (NOT first OR near)) AS n_removed, count(*) FILTER (first AND near) AS n_near,
    CAST(coalesce(sum(n_links) FILTER (first), 0) AS BIGINT) AS n_links,
    sha256(CASE WHEN count(*) FILTER (has AND first AND NOT near) = 0 AND count(*) FILTER (has) > 0 THEN ''
        ELSE coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT has OR (first AND NOT near)), '') END) AS text_sha256
FROM o GROUP BY doc_id
"""
