r"""Reading values from the JSON of catalogues by first textual occurrence, and the three decoders.

This is no JSON parser, on purpose: a key counts wherever it first stands in the text, at any depth and in any case. First
the first string of an array is looked for in the whole text, then a string, then an unsigned integer.

The decoders read a body's keys once (``index``), in one scan for the keys and one for each kind of value, and look all fields up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import found, let
from .months import iso_month, month_name
from .scanner import item_of
from .text import invert_name, strip_doi_url

STRING = r'"((?:[^"\\]|\\.)*+)"'
#: The fields of a candidate, in the order of its struct.
CANDIDATE = ("source", "title", "doi", "type", "container_title", "volume", "issue", "pages", "publisher", "authors", "year", "month", "issn", "isbn", "url")
#: The arrays that hold search results.
ITEMS = {"CrossRef": '"items":[{', "Semantic Scholar": '"data":[{', "OpenAlex": '"results":[{'}
DATES = ("published-print", "published-online", "published", "issued")


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))


def json_value(json: Column, key: str) -> Column:
    at = rf'(?i)"\Q{key}\E"\s*:\s*'
    return F.coalesce(unescape(found(json, at + r"\[\s*" + STRING)), unescape(found(json, at + STRING)), found(json, at + "([0-9]+)"))


#: A key, and a value of one of the three kinds behind it. Only the key is passed over, so that none is missed behind an odd value.
_PAIR = rf'"([^"\\]*)"\s*:\s*(?=(?:\[\s*({STRING})|({STRING})|([0-9]+))?)'
_KINDS = {"array": 2, "string": 4, "number": 6}  # groups
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def index(json: Column) -> Column:
    """For each kind of value the keys that have one, in lower case, in order (null for other keys), and the values."""
    get = lambda g: F.regexp_extract_all(json, F.lit(_PAIR), F.lit(g))

    def by_kind(keys: Column) -> Column:
        parts = []
        for name, group in _KINDS.items():
            values = get(group)  # in quotes, so that an empty string isn't none
            parts += [F.zip_with(keys, values, lambda k, v: F.when(v != "", k)).alias(f"{name}_keys"), values.alias(name)]
        return F.struct(*parts)

    return let(F.transform(get(1), lambda k: F.translate(k, _UPPER, _LOWER)), by_kind)


def indexed(index: Column, key: str) -> Column:
    """What ``json_value`` gives of the text."""
    at = lambda kind: F.get(index[kind], (F.array_position(index[f"{kind}_keys"], key.translate(str.maketrans(_UPPER, _LOWER))) - 1).cast("int"))
    plain = lambda v: unescape(F.substring(v, F.lit(2), F.length(v) - 2))
    return F.coalesce(plain(at("array")), plain(at("string")), at("number"))


def nested_value(json: Column, parent: str, key: str) -> Column:
    """A key of the first object of name ``parent``, up to that object's first closing brace."""
    return json_value(found(json, rf'"\Q{parent}\E"\s*:\s*\{{([^}}]+)\}}'), key)


def _joined(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.array_join(names, " and "))


def _pairs(text: Column, pattern: str, last: int, first: int) -> Column:
    get = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    return _joined(F.zip_with(get(last), get(first), lambda a, b: F.concat(a, F.lit(", "), b)))


def crossref_authors(json: Column) -> Column:
    text = found(json, r'(?s)"author"\s*:\s*\[(.*?)]')
    part = lambda k: rf'"{k}"\s*:\s*"([^"]+)"'
    return F.coalesce(_pairs(text, part("family") + "[^}]*" + part("given"), 1, 2), _pairs(text, part("given") + "[^}]*" + part("family"), 2, 1))


def _all(json: Column, key: str) -> Column:
    return F.regexp_extract_all(json, F.lit(rf'"{key}"\s*:\s*"([^"]+)"'), F.lit(1))


def s2_authors(json: Column) -> Column:
    return _joined(F.transform(F.filter(_all(json, "name"), lambda n: F.contains(n, F.lit(" "))), invert_name))


def openalex_authors(json: Column) -> Column:
    """Up to 20 names that don't look like a journal or an institution."""

    def person(n: Column) -> Column:
        no = [~F.contains(n, F.lit(w)) for w in ("Journal", "Conference", "University", "Institute")]
        return (F.length(n) <= 50) & F.contains(n, F.lit(" ")) & no[0] & no[1] & no[2] & no[3]

    return _joined(F.transform(F.slice(F.filter(_all(json, "display_name"), person), 1, 20), invert_name))


def crossref_date(json: Column) -> tuple[Column, Column]:
    """Year and month (name) of the first kind of date that is there."""
    number = lambda m: F.when(m != "", m.try_cast("int"))  # noqa: E731  (a cast that fails is an exception for each row)
    pick = lambda g: F.coalesce(*[F.when(json.rlike(p), F.struct(F.regexp_extract(json, p, 1).alias("y"), number(F.regexp_extract(json, p, 2)).alias("m"))) for p in g])
    got = pick([rf'"{f}"\s*:\s*\{{[^}}]*"date-parts"\s*:\s*\[\s*\[\s*(\d{{4}})(?:\s*,\s*(\d{{1,2}}))?' for f in DATES])
    return got["y"], month_name(got["m"])


def _candidate(**values: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(*[values.get(c, none).alias(c) for c in CANDIDATE])


def decode_crossref(json: Column) -> Column:
    year, month = crossref_date(json)

    def told(ix: Column) -> Column:
        v = lambda k: indexed(ix, k)
        return _candidate(source=F.lit("CrossRef"), title=v("title"), doi=v("DOI"), type=v("type"), container_title=v("container-title"), volume=v("volume"), issue=v("issue"), pages=v("page"), publisher=v("publisher"), authors=crossref_authors(json), year=year, month=month, issn=v("ISSN"), isbn=v("ISBN"), url=v("URL"))

    return let(index(json), told)


def decode_s2(json: Column) -> Column:
    journal = F.contains(json, F.lit('"journal"'))
    in_journal = lambda k: F.when(journal, nested_value(json, "journal", k))

    def told(ix: Column) -> Column:
        v = lambda k: indexed(ix, k)
        return _candidate(source=F.lit("Semantic Scholar"), title=v("title"), doi=found(json, r'"DOI"\s*:\s*"([^"]+)"'), container_title=F.coalesce(in_journal("name"), v("venue")), volume=in_journal("volume"), pages=in_journal("pages"), authors=s2_authors(json), year=v("year"), month=iso_month(v("publicationDate")))

    return let(index(json), told)


def decode_openalex(json: Column) -> Column:
    place = F.when(F.contains(json, F.lit('"primary_location"')), nested_value(json, "source", "display_name"))

    def told(ix: Column) -> Column:
        v = lambda k: indexed(ix, k)
        date, pages = v("publication_date"), F.concat_ws("-", v("first_page"), v("last_page"))
        return _candidate(source=F.lit("OpenAlex"), title=v("title"), doi=strip_doi_url(v("doi")), type=v("type"), container_title=place, volume=v("volume"), issue=v("issue"), pages=F.when(v("first_page").isNotNull(), pages), authors=openalex_authors(json), year=F.when(F.length(date) >= 4, F.left(date, F.lit(4))), month=iso_month(date))

    return let(index(json), told)


DECODERS = {"CrossRef": decode_crossref, "Semantic Scholar": decode_s2, "OpenAlex": decode_openalex}


def searched(json: Column, source: str) -> Column:
    """The first search result of a response, or the response if it is none of a search."""
    return item_of(json, ITEMS[source])
