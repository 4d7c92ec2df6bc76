"""Text functions on columns: normal forms, escaping, keys, types and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import found, trim

#: Words of an author string that is no list of names.
NO_NAMES = [
    "variance", "estimation", "method", "statistical", "probability", "science", "research", "management", "decision", "monitoring",
    "uncertainty", "function", "accounting", "biology", "optimal", "advanced", "physical", "social", "operations", "process", "(", ")",
]
#: Catalogue types and the entry types that they become.
TYPES = {
    "journal-article": "article",
    "article": "article",
    "book": "book",
    "book-chapter": "incollection",
    "chapter": "incollection",
    "proceedings-article": "inproceedings",
    "proceedings": "inproceedings",
    "dissertation": "phdthesis",
    "thesis": "phdthesis",
    "report": "techreport",
}
#: What is escaped, in this order.
ESCAPES = [("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\~{}"), ("^", r"\^{}")]
DOI_URL = "https://doi.org/"
MIN_SIGNATURE = 10


def title_signature(title: Column) -> Column:
    """a-z and 0-9 of the lower-cased title; null if fewer than ten are left."""
    s = F.regexp_replace(F.lower(title), "[^a-z0-9]", "")
    return F.when(F.length(s) >= MIN_SIGNATURE, s)


def compare_form(c: Column) -> Column:
    """What two entries are compared by: case, white space and braces don't count."""
    return trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), "[{}]", ""))


def escape_bibtex(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for plain, safe in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def display_key(entry: Column) -> Column:
    return F.coalesce(trim(found(entry, r"@\w+\{([^,]+),")), F.lit("unknown"))


def generate_key(text: Column, year: Column, number: Column, title: Column) -> Column:
    """First word if capitalised (else ``ref``), year (else number), first title word of more than four letters."""
    first = F.coalesce(F.lower(found(text, r"^([A-Z][a-z]+)")), F.lit("ref"))
    words = F.filter(F.split(title, r"\s+"), lambda w: w.rlike(r"^[A-Za-z]{5,}\z"))
    return F.concat(first, F.coalesce(year, number.cast("string"), F.lit("null")), F.coalesce(F.lower(F.get(words, F.lit(0))), F.lit("")))


def entry_type(kind: Column) -> Column:
    """The entry type of a catalogue's type."""
    low = F.lower(kind)
    return reduce(lambda c, t: c.when(low == t[0], F.lit(t[1])), TYPES.items(), F.when(F.lit(False), F.lit(""))).when(kind.isNotNull(), F.lit("misc"))


def invert_name(name: Column) -> Column:
    """"First Mid Last" as "Last, First Mid"; a name of one part stays."""
    parts = F.split(F.regexp_replace(name, " +$", ""), " ")
    turned = F.concat(F.element_at(parts, -1), F.lit(", "), F.array_join(F.slice(parts, 1, F.size(parts) - 1), " "))
    return F.when(F.size(parts) >= 2, turned).otherwise(name)


def strip_doi_url(doi: Column) -> Column:
    return F.when(F.startswith(doi, F.lit(DOI_URL)), F.substr(doi, F.lit(len(DOI_URL) + 1))).otherwise(doi)


def plausible_authors(a: Column, low: Column | None = None) -> Column:
    """Whether an author string reads as a list of names; ``low`` is the same in lower case, where that is at hand."""
    low = F.lower(a) if low is None else low
    parts = F.split(F.regexp_replace(a, "(?: and )+$", ""), " and ")
    fits = F.forall(parts, lambda p: (F.length(trim(p)) <= 80) & (F.contains(trim(p), F.lit(",")) | F.contains(trim(p), F.lit(" "))))
    clean = ~reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in NO_NAMES])
    ok = a.rlike(r"\S") & (F.length(a) <= 500) & (F.regexp_count(a, F.lit(" and ")) <= 20) & clean & fits
    return F.coalesce(ok, F.lit(False))


def clean_title(title: Column) -> Column:
    """A title as it is searched by."""
    return trim(F.regexp_replace(title, "[{}]", ""))


def surname(author: Column) -> Column:
    """The surname that the first author is searched by."""
    name = clean_title(author)
    comma = trim(F.substring_index(name, ",", 1))
    first = trim(F.substring_index(name, " and ", 1))
    return F.when(F.contains(name, F.lit(",")), comma).when(F.contains(name, F.lit(" and ")), F.substring_index(first, " ", -1)).otherwise(name)


def author_year_key(author: Column, year: Column, title: Column) -> Column:
    """Surname, year and the first 50 characters of a title of more than five, as one lookup key."""
    short = F.when(F.length(title) > 5, F.left(clean_title(title), F.lit(50)))
    return F.concat_ws("|", surname(author), year, short)


CROSSREF, S2, OPENALEX = "https://api.crossref.org/works", "https://api.semanticscholar.org/graph/v1/paper", "https://api.openalex.org/works"
S2_FIELDS = "fields=title,authors,year,venue,publicationDate,externalIds,journal,volume,pages"


def request_urls(doi: Column, title: Column) -> Column:
    """array of struct(source, lookup_kind, url): what a fetcher would ask the three catalogues for, by DOI and by title."""
    t = F.url_encode(clean_title(title))
    d = F.url_encode(doi)
    rows = [
        ("CrossRef", "doi", F.concat(F.lit(CROSSREF + "/"), d)),
        ("Semantic Scholar", "doi", F.concat(F.lit(S2 + "/DOI:"), d, F.lit("?" + S2_FIELDS))),
        ("OpenAlex", "doi", F.concat(F.lit(OPENALEX + "/" + DOI_URL), doi)),
        ("CrossRef", "title", F.concat(F.lit(CROSSREF + "?query.title="), t, F.lit("&rows=1"))),
        ("Semantic Scholar", "title", F.concat(F.lit(S2 + "/search?query="), t, F.lit(f"&{S2_FIELDS}&limit=1"))),
        ("OpenAlex", "title", F.concat(F.lit(OPENALEX + "?filter=title.search:"), t, F.lit("&per_page=1"))),
    ]
    all_ = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(k).alias("lookup_kind"), u.alias("url")) for s, k, u in rows])
    return F.filter(all_, lambda r: r["url"].isNotNull())


def author_year_url(author: Column, year: Column, title: Column) -> Column:
    short = F.when(F.length(title) > 5, F.concat(F.lit("&query.title="), F.url_encode(F.left(clean_title(title), F.lit(50)))))
    return F.concat(F.lit(CROSSREF + "?query.author="), F.url_encode(surname(author)), F.lit("&filter=from-pub-date:"), year, F.lit(",until-pub-date:"), year, F.coalesce(short, F.lit("")), F.lit("&rows=3"))


