"""PDF files are read as they are laid out."""

import zlib

import pytest
from pyspark.sql import functions as F

from bibspark.operators import refs
from bibspark.plans import corpus
from bibspark.sources import bib, pdf


def file(*objects, root=1, tail=b""):
    body = b"\n".join(b"%d 0 obj\n%s\nendobj" % (i + 1, o) for i, o in enumerate(objects))
    return b"%PDF-1.7\n" + body + b"\ntrailer <</Root " + (b"%d 0 R" % root) + b">>" + tail


def stream(data, more=b"", length=None):
    return b"<</Length %s%s>>\nstream\n%s\nendstream" % (length or b"%d" % len(data), more, data)


FONT = b"<</Type/Font/Subtype/Type1/BaseFont/Courier/FirstChar 0/Widths[" + b"600 " * 256 + b"]>>"
TREE = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Kids [3 0 R]/Resources<</Font<</F 4 0 R>>>>>>", b"<</Parent 2 0 R/Contents 5 0 R>>"]


def shown(content, font=FONT, *more):
    return file(*TREE, font, stream(content), *more)


def texts(spark, files):
    rows = spark.createDataFrame([(n, f) for n, f in files.items()], "source_path string, content binary")
    return {r["source_path"]: (r["content"], r["message"]) for r in pdf.text(rows).collect()}


def test_operators_and_encodings(spark):
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <0079007A>] endbfrange"
    files = {
        "order": shown(b"BT /F 10 Tf 1 0 0 1 50 600 Tm (below) Tj 1 0 0 1 50 700 Tm (above) Tj ET BT /F 10 Tf 110 700 Td (right) Tj ET"),
        "lines": shown(b"BT /F 10 Tf 12 TL 50 700 Td (one) Tj T* (two) Tj (three) \' 1 0 (four) \" 0 -30 TD (five) Tj T* (six) Tj ET"),
        "array": shown(b"BT /F 10 Tf 50 700 Td [(He) -20 (llo) -900 (there) 300 (!)] TJ ET"),
        "strings": shown(rb"BT /F 10 Tf 50 700 Td (a\(b\)(c) \101\53 \\ ) Tj <4869> Tj % (no) Tj" + b"\n(\\\nx) Tj ET"),
        "matrices": shown(b"q 2 0 0 2 100 0 cm BT /F 10 Tf 0 100 Td (large) Tj ET Q BT /F 10 Tf 10 200 Td (left) Tj ET BT /F 5 Tf 60 203 Td (near) Tj ET"),
        "differences": shown(b"BT /F 10 Tf 50 700 Td (A\001\002) Tj ET", FONT.replace(b"/Type/Font", b"/Encoding<</Differences[1/uni00E9 66/x 2/B]>>")),
        "two bytes": shown(b"BT /F 10 Tf 50 700 Td <0001000200100012002000210099> Tj ET", b"<</Subtype/Type0/ToUnicode 6 0 R>>", stream(zlib.compress(cmap), b"/Filter/FlateDecode")),
        "filters": file(*TREE, FONT, stream(b"<~" + __import__("base64").a85encode(zlib.compress(b"BT /F 10 Tf (packed) Tj ET")) + b"~>", b"/Filter[/ASCII85Decode/FlateDecode]")),
        "pictures": shown(b"BT /F 10 Tf 50 700 Td (a) Tj ET BI /W 2 /H 1 ID \x00( EIx [<\xff EI BT /F 10 Tf 50 600 Td (b) Tj ET"),
        "names": shown(b"BT /F 10 Tf 50 700 Td (\001\002\003\004\005\006\007) Tj ET", FONT.replace(b"/Type/Font", b"/Encoding<</Differences[1/ffi/eacute/f_i.alt/quotedblleft/Scaron/unknown/u1F600]>>")),
        "parts": file(*TREE[:2], b"<</Contents [5 0 R 6 0 R]>>", FONT, stream(b"BT /F 10 Tf (in ", length=b"7 0 R"), stream(b"two) Tj ET"), b"16"),
        "no text": shown(b"0 0 m 10 10 l S"),
        "odd": shown(b"BT Tj /F Tf ( ) Tj 1 Td [ (x Tj"),
        "object stream": b"%PDF-1.5\n5 0 obj\n" + stream(b"BT /F 10 Tf (inside) Tj ET") + b"\nendobj\n9 0 obj\n" + stream(zlib.compress(b"1 0 2 29 3 88 4 120 " + (b"<</Type/Catalog/Pages 2 0 R>> " + b"<</Kids [3 0 R]/Resources<</Font<</F 4 0 R>>>>>>".ljust(59) + b"<</Contents 5 0 R>>".ljust(32) + FONT)), b"/Filter/FlateDecode/Type/ObjStm/N 4/First 20") + b"\nendobj\n8 0 obj\n<</Type/XRef/Root 1 0 R>>\nendobj",
        "encrypted": shown(b"BT (x) Tj ET").replace(b"trailer <<", b"trailer <</Encrypt 9 0 R"),
        "junk": b"not a file of pages",
        "empty": b"",
        "null": None,
        "bad filter": file(*TREE, FONT, stream(b"x", b"/Filter/JPXDecode")),
        "broken": shown(b"x").replace(b"/Kids [3 0 R]", b"/Kids [33 0 R 2 0 R]"),
    }
    got = texts(spark, files)
    bad = (None, pdf.NOT_READ)
    want = {
        "order": "above right\nbelow", "lines": "one\ntwo\nthree\nfour\nfive\nsix", "array": "Hello there!", "strings": "a(b)(c) A+ \\ Hix", "matrices": "left near large",
        "differences": "A\u00e9B", "two bytes": "A\U0001f600acxyz", "filters": "packed", "parts": "in \ntwo", "pictures": "a\nb", "names": "ffi\u00e9fi\u201c\u0160\x06\U0001f600", "no text": "", "odd": " ", "object stream": "inside",
    }
    assert {k: v[0] for k, v in got.items() if v != bad} == want and all(got[k] == bad for k in ("encrypted", "junk", "empty", "null", "bad filter", "broken"))


def test_forms(spark):
    form = lambda content, more=b"": stream(content, b"/Subtype/Form" + more)
    page = lambda content, forms, *objects: file(TREE[0], b"<</Kids[3 0 R]/Resources<</Font<</F 4 0 R>>/XObject<<%s>>>>>>" % forms, TREE[2], FONT, stream(content), *objects)
    said = b"BT /F 10 Tf 0 0 Td (%s) Tj ET"
    other = FONT.replace(b"/Type/Font", b"/Encoding<</Differences[97/z]>>")
    files = {
        "places": page(b"q 1 0 0 1 0 500 cm /A Do Q /A Do q 2 0 0 2 0 100 cm /A Do Q", b"/A 6 0 R", form(said % b"again", b"/Matrix[1 0 0 1 50 100]")),
        "fonts": page(b"/A Do BT /F 10 Tf 0 50 Td (a) Tj ET", b"/A 6 0 R", form(said % b"a", b"/Resources<</Font<</F 7 0 R>>>>"), other),
        "nested": page(b"/A Do", b"/A 6 0 R", form(said % b"out" + b" 1 0 0 1 0 -20 cm /B Do", b"/Resources<</Font<</F 4 0 R>>/XObject<</B 7 0 R>>>>"), form(said % b"in")),
        "within itself": page(b"/A Do", b"/A 6 0 R", form(said % b"once" + b" /B Do", b"/Resources<</Font<</F 4 0 R>>/XObject<</B 7 0 R>>>>"), form(b"/A Do", b"/Resources<</XObject<</A 6 0 R>>>>")),
        "not read": page(b"/A Do /B Do /C Do /D Do " + said % b"left", b"/A 6 0 R/B 7 0 R/C 99 0 R", form(b"x", b"/Filter/JPXDecode"), stream(said % b"picture", b"/Subtype/Image")),
    }
    got = texts(spark, files)
    assert got == {"places": ("again\nagain\nagain", None), "fonts": ("a\nz", None), "nested": ("out\nin", None), "within itself": ("once", None), "not read": ("left", None)}


def test_names_of_characters():
    named = {"A": "A", "one": "1", "equal": "=", "backslash": "\\", "underscore": "_", "space": " ", "quotedbl": '"', "oslash": "\u00f8", "Lslash": "\u0141", "udieresis": "\u00fc", "Aring": "\u00c5", "ccedilla": "\u00e7",
             "ohungarumlaut": "\u0151", "zdotaccent": "\u017c", "uni00410042": "AB", "uniD83DDE00": "\U0001f600", "uniD83D": "\ufffd", "uD83D": None, "u110000": None, "T_h": "Th", "a.sc": "a", "": None, ".notdef": None, "_": None, "g12": None, "f_g12": None}
    assert {n: pdf.glyph(n) for n in named} == named


def test_files_on_disk_give_their_references(spark, tmp_path):
    docs = corpus.ref_documents(spark, "/root/testdata/sf0.001").select("doc_id", "content", corpus.as_pdf(F.col("content")).alias("pdf")).collect()
    for r in docs:
        (tmp_path / f"{r['doc_id']}.{'PDF' if r['doc_id'] % 2 else 'pdf'}").write_bytes(r["pdf"])
    (tmp_path / "other.txt").write_bytes(b"x")
    got = pdf.read(spark, f"file://{tmp_path}").withColumn("doc_id", F.regexp_extract("source_path", r"(\d+)\.[a-zA-Z]+$", 1).cast("long"))
    squeezed = {r["doc_id"]: "\n".join(x for x in r["content"].split("\n") if x) for r in docs}
    assert {r["doc_id"]: r["content"] for r in got.collect()} == squeezed
    found = refs.raw_references(got.select("doc_id", "content"))
    cited = {i for i in squeezed if i % 11 != 10}
    assert {r["doc_id"] for r in found.collect()} == cited and found.count() > 9 * len(cited)


def test_files_are_extracted(spark, tmp_path):
    docs = corpus.ref_documents(spark, "/root/testdata/sf0.001").where("doc_id IN (0, 5)").select("doc_id", corpus.as_pdf(F.col("content")).alias("pdf")).collect()
    for r in docs:
        (tmp_path / f"{r['doc_id']}.pdf").write_bytes(r["pdf"])
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    out = {r["doc_id"].rpartition("/")[2]: r for r in refs.extract_from_files(spark, f"file://{tmp_path}", None, spark.createDataFrame([], bib.RESPONSE)).collect()}
    assert {k: r["total_found"] for k, r in out.items()} == {"0.pdf": 10, "5.pdf": 10, "bad.pdf": 0}
    assert out["0.pdf"]["errors"] == 10 and "@misc{" in out["0.pdf"]["bibtex_output"]


@pytest.mark.parametrize("n", [1, 40])
def test_pages_in_order(spark, n):
    told = "\n".join(f"line {i}" for i in range(n * 6))
    rows = spark.createDataFrame([("f", told)], "source_path string, t string").select("source_path", corpus.as_pdf(F.col("t")).alias("content"))
    assert pdf.text(rows).first()["content"] == told
