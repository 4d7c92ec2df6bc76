import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bibspark.functions import scanner as s


def shown(text, **kw):
    entries, errors = s.parse(text, **kw)
    return [(e["type"], e["key"]) for e in entries], [(e["code"], e["start"]) for e in errors]


@pytest.mark.parametrize(
    ("text", "entries", "errors"),
    [
        ("", [], []),
        (None, [], []),
        ("@misc()", [], [("NO_KEY", 0)]),
        ("@misc{,a={b}}", [], [("NO_KEY", 0)]),
        ('@a{k, t={5" disk}} @b{z, t={y}}', [], [("UNCLOSED", 0)]),
        ("% @a{k, t={1}}", [("a", "k")], []),
        ("@misc{solo}\n@book{b, title={x}}", [("misc", "solo}\n@book{b, title={x}}"), ("book", "b")], []),
        ("@misc{}", [("misc", "}")], []),
        ("@article(k, t={)})", [("article", "k")], []),
        ("@ Book {k, a=1}", [("book", "k")], []),
        ("a@b.c @{x} @x y @b{c,d=1}", [("b", "c")], []),
        ("@comment{x, y}@preamble{a}@string{s={t}}@b{c,d=1}", [("b", "c")], []),
        ("@", [], []),
        ("@  ", [], []),
        ("@a", [], []),
        ("\U0001f600@misc()", [], [("NO_KEY", 2)]),
        (r"@a{k, t={\}}}", [("a", "k")], []),
    ],
)
def test_hand_cases(text, entries, errors):
    assert shown(text) == (entries, errors)


def test_strict_keys():
    assert shown("@misc{solo}\n@book{b, title={x}}", strict_keys=True) == ([("misc", "solo"), ("book", "b")], [])
    assert shown("@misc{}", strict_keys=True) == ([], [("NO_KEY", 0)])


def test_fields():
    raw = '@article{k, title={proof that year=1999 matters}, year={2020}}'
    assert s.fields_of(raw, ["year"]) == ["1999 matters"]
    assert s.fields_of(raw.replace("e{k", "e {k"), ["year"]) == ["2020"]
    assert s.fields_of("@a{k, booktitle={B}, title = {T\n  {U}}}", ["title", "booktitle", "doi"]) == ["T {U}", "B", None]
    assert s.fields_of("@a{k, doi={}, x={y", ["doi", "x"]) == ["", None]
    assert s.fields_of(None, ["x"]) == [None]


def test_all_fields_keep_order_and_the_first():
    got = s.all_fields('@a{k, title = "A \\"b\\" c" , year=2020 , Year={1}, note={x {y}  z}, zzz}')
    assert [(f["name"], f["value"]) for f in got] == [("title", 'A \\"b\\" c'), ("year", "2020"), ("note", "x {y}  z")]
    assert s.all_fields(None) == s.all_fields("@a{k}") == []


def test_replacing_leaves_other_fields_alone():
    assert s.replaced("@a{k, title={in the month of May}, month = jan, year=1}", "month", "Jan.") == "@a{k, title={in the month of May}, month = {Jan.}, year=1}"
    assert s.replaced('@a{k, month="feb"}', "month", "Feb.") == "@a{k, month={Feb.}}"
    assert s.replaced("@a{k, x={y}}", "month", "Feb.") == "@a{k, x={y}}"


def test_first_item():
    assert s.first_item('x"items":[{"a":{"b":1}},{}]', '"items":[{') == '{"a":{"b":1}}'
    assert s.first_item('x"items":[{"a":', '"items":[{') == ""
    assert s.first_item("x", '"items":[{') == "x"


name = st.text("abcdefgh", min_size=1, max_size=6)
value = st.text("abc {}é,=@", max_size=12).filter(lambda v: v.count("{") == v.count("}") and all(v[:i].count("{") >= v[:i].count("}") for i in range(len(v))))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(name, st.dictionaries(name, value, max_size=4)), min_size=1, max_size=5))
def test_round_trip(records):
    text = "\n".join(f"@misc {{{k},\n" + "".join(f"  {n} = {{{v}}},\n" for n, v in f.items()) + "}" for k, f in records)
    entries, errors = s.parse(text)
    assert not errors
    assert [e["key"] for e in entries] == [k for k, _ in records]
    for e, (_, f) in zip(entries, records):
        assert {x["name"]: x["value"] for x in s.all_fields(e["raw"])} == {n: v.strip() for n, v in f.items()}


@settings(max_examples=200, deadline=None)
@given(st.text('@{}(),"\\=a \n', max_size=60))
def test_any_text_is_scanned_to_its_end(text):
    entries, errors = s.parse(text)
    for e in entries:
        s.all_fields(e["raw"])
        s.fields_of(e["raw"], ["a"])
        s.replaced(e["raw"], "a", "b")


def by_the_loop(raw, target):
    """The reference's loop, character by character (``BibTeXParser.extractField``): ``i = nameEnd`` and the loop's own step pass over
    the character behind a word."""
    n, i, quoted, escaped, depth = len(raw), -1, False, False, 0
    while (i := i + 1) < n:
        c = raw[i]
        if escaped:
            escaped = False
            continue
        if c == "\\":
            escaped = True
            continue
        if c == '"':
            quoted = not quoted
            continue
        if not quoted:
            depth = depth + 1 if c == "{" else max(0, depth - 1) if c == "}" else depth
        if quoted or depth > 1 or not (c.isalnum() or c == "_"):
            continue
        end = i
        while end < n and (raw[end].isalnum() or raw[end] in "_-"):
            end += 1
        j = end
        while j < n and raw[j] == " ":
            j += 1
        if raw[i:end].lower() != target or j >= n or raw[j] != "=":
            i = end
            continue
        j += 1
        while j < n and raw[j] == " ":
            j += 1
        return j
    return None


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["@a{k, ", "t = {", "y = ", "m={1},", "{", "}", '"', "\\", "\\\"", "w", " ", ",", "-", "="]), max_size=14).map("".join))
def test_fields_are_found_where_the_reference_finds_them(raw):
    """what a quote behind a word hides is hidden in the reference too."""
    for name in ("y", "m"):
        assert next((at for n, at in s.named_values(raw) if n == name), None) == by_the_loop(raw, name)


def test_a_quote_behind_a_word_hides_fields():
    raw = '@a{k, title = {he said\\" so}, year = {2001}}'
    assert by_the_loop(raw, "year") is None and s.fields_of(raw, ["year"]) == [None]
    assert s.fields_of(raw.replace("said", "said "), ["year"]) == ["2001"]


def test_words_before_no_field_are_passed_in_one_match():
    words = 'some words, (and more) café x-y z'
    assert s._WORDS.match(words).end() == len(words)
    assert s._WORDS.match("a b　=").end() == 2 and s._WORDS.match('ab"c"').end() == 5 and s._WORDS.match('ab {').end() == 3
    assert s.fields_of("@misc{k, " + words + ' year 　= {1}, title="q"}', ["year", "title"]) == ["1", "q"]
