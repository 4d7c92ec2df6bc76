r"""Scanning of entries and fields, whose nested delimiters no regular expression describes.

One pass over a text looks at structural marks only. ``_plain`` yields those that count: neither escaped by a backslash nor
inside double quotes. Everything else is expressed by it. The kernels are plain Python; the functions on columns wrap them
as Arrow UDFs, so that a raw entry crosses into Python once for all fields asked for. They give their results in small parts
(``bounded``), so that a worker holds little beside the batch that it has from Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import TOKEN_SPACE, bounded, py_collapse, py_trim

_LETTER = r"[\p{L}\p{Nd}]--[\U00010000-\U0010ffff]"
_IDENT = rf"[[{_LETTER}]||[_\-]]"
_SPACE = f"[{TOKEN_SPACE}]*"
_MARK = regex.compile(r'[\\"{}(),]')
_HEAD = regex.compile(rf"(?V1)@{_SPACE}(?P<type>{_IDENT}*)(?P<gap>{_SPACE})")


def _ranges(found: list[str]) -> str:
    """A set's content that has these characters, which are in order."""
    out: list[list[str]] = []
    for c in found:
        if out and ord(c) == ord(out[-1][1]) + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(a if a == b else f"{a}-{b}" for a, b in out)


# as a plain set, which ``re`` looks up faster than properties
_LETTERS = _ranges(regex.findall(f"(?V1)[{_LETTER}]", "".join(map(chr, range(1 << 16)))))
_NAME = re.compile(rf"[{_LETTERS}_\-]+")
#: All up to what counts: no mark and no name before a ``=``. Of a name before anything else the character behind it is passed over.
_WORDS = re.compile(rf'(?s)(?:[^\\"{{}}_{_LETTERS}]++|[{_LETTERS}_\-]++(?!{_SPACE}=)(?:.|\Z))*+')
_STATE = re.compile(r'[\\"{}]')
_GAP = re.compile(_SPACE)
_COMMAS = re.compile(f"[,{TOKEN_SPACE}]*")
_SET = re.compile(f"{_SPACE}(=)?{_SPACE}")
_QUOTED = re.compile(r'(?s)(?:[^"\\]++|\\.)*+"')
_BARE = re.compile(r"[^,})]*")
#: What is escaped, what is quoted, and the marks of one kind that are neither.
_NESTED = {o: re.compile(rf'(?s)\\.?|"(?:[^"\\]++|\\.)*+"?|[{re.escape(o + c)}]') for o, c in (("{", "}"), ("(", ")"))}

#: Constructs that are no records.
NO_RECORD = ("comment", "preamble", "string")
CLOSER = {"{": "}", "(": ")"}


def _plain(text: str, at: int):
    """(position, mark) from ``at`` on, of the marks that aren't escaped or quoted."""
    free, quoted = at, False
    for m in _MARK.finditer(text, at):
        p, c = m.start(), m[0]
        if p < free:
            continue
        if c == "\\":
            free = p + 2
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            yield p, c


def _balanced(text: str, at: int, opener: str) -> int:
    """The position after the closer that matches an opener just before ``at``; -1 if there is none."""
    depth, closer = 1, CLOSER[opener]
    for m in _NESTED[opener].finditer(text, at):
        c = m[0]
        if c == opener:
            depth += 1
        elif c == closer:
            depth -= 1
            if not depth:
                return m.end()
    return -1


def _key_end(text: str, at: int, closer: str, stop: int | None) -> int:
    """Where a key ends: at a comma outside braces, or at the ``)`` of an entry in parentheses. A ``}`` ends none, unless
    ``stop`` says where the entry ends."""
    nested = 0
    for p, c in _plain(text, at):
        if stop is not None and p >= stop:
            return stop
        if c == "{":
            nested += 1
        elif c == "}":
            nested = max(0, nested - 1)
        elif c == "," and not nested or c == closer:
            return p
    return len(text) if stop is None else stop


def parse(text: str | None, strict_keys: bool = False) -> tuple[list[dict], list[dict]]:
    """Entries (ord, type, key, raw) and errors (ord, code, start, type, message) of a text, in order."""
    entries: list[dict] = []
    errors: list[dict] = []
    text, at = text or "", 0

    def wrong(code: str, said: str, start: int, kind: str) -> None:
        unit = len(text[:start].encode("utf-16-le", "surrogatepass")) // 2
        errors.append({"ord": len(errors), "code": code, "start": unit, "type": kind, "message": f"{said} at index {unit} (@{kind})"})

    while (at := text.find("@", at)) >= 0:
        head = _HEAD.match(text, at)
        body = head.end()
        if not head["type"]:
            if head.end("type") >= len(text):
                break
            at += 1
            continue
        if body >= len(text):
            break
        opener = text[body]
        if opener not in CLOSER:
            at = body + 1
            continue
        kind, end = py_trim(head["type"]).lower(), _balanced(text, body + 1, opener)
        first = _GAP.match(text, body + 1).end()
        if end < 0:
            wrong("UNCLOSED", "Unclosed entry starting", at, kind)
            break
        key = py_trim(text[first : _key_end(text, first, CLOSER[opener], end - 1 if strict_keys else None)])
        if kind not in NO_RECORD:
            if key:
                entries.append({"ord": len(entries), "type": kind, "key": key, "raw": py_trim(text[at:end])})
            else:
                wrong("NO_KEY", "Entry without key", at, kind)
        at = end
    return entries, errors


def _value(text: str, at: int) -> tuple[str, int] | None:
    """A field's value that starts at ``at`` and the position after it; None if it doesn't end."""
    if text[at] == "{":
        end = _balanced(text, at + 1, "{")
        return None if end < 0 else (text[at + 1 : end - 1], end)
    if text[at] == '"':
        m = _QUOTED.match(text, at + 1)
        return None if m is None else (text[at + 1 : m.end() - 1], m.end())
    m = _BARE.match(text, at)
    return m[0], m.end()


def named_values(raw: str):
    """(name, where its value starts) of what reads as a field at the top of an entry, in order.

    After an identifier the character behind it is passed over unseen; so the brace behind ``@type`` isn't counted, and names
    in values of the first level are found too.
    """
    at, depth, quoted = 0, 0, False
    while True:
        if quoted or depth > 1:
            m = _STATE.search(raw, at)
            if m is None:
                return
            at = m.start()
        else:
            at = _WORDS.match(raw, at).end()
            if at >= len(raw):
                return
        c, here, at = raw[at], at, at + 1
        if c == "\\":
            at += 1
        elif c == '"':
            quoted = not quoted
        elif c == "{":
            depth += not quoted
        elif c == "}":
            depth = max(0, depth - (not quoted))
        else:
            name = _NAME.match(raw, here)
            yield name[0].lower(), _SET.match(raw, name.end()).end()
            at = name.end() + 1


def fields_of(raw: str | None, names: list[str]) -> list[str | None]:
    """The values of fields, white space collapsed; None if a field isn't there or doesn't end. The first of a name counts."""
    seen: dict[str, str | None] = {}
    want = set(names)
    for name, at in named_values(raw or ""):
        if name in want and name not in seen:
            got = _value(raw, at) if at < len(raw) else None
            seen[name] = None if got is None else py_collapse(got[0])
            if len(seen) == len(want):
                break
    return [seen.get(n) for n in names]


def all_fields(raw: str | None) -> list[dict]:
    """All fields after the first comma, in order, the first of a name; values trimmed, their inner white space kept."""
    out: dict[str, str] = {}
    raw = raw or ""
    at = raw.find(",") + 1
    while at:
        at = _COMMAS.match(raw, at).end()
        if at >= len(raw) or raw[at] in "})":
            break
        name = _NAME.match(raw, at)
        if name is None:
            at += 1
            continue
        after = _SET.match(raw, name.end())
        if not after[1]:
            at = after.end()
            continue
        got = _value(raw, after.end()) if after.end() < len(raw) else None
        if got is None:
            break
        out.setdefault(name[0].lower(), py_trim(got[0]))
        at = got[1]
    return [{"name": n, "value": v} for n, v in out.items()]


def replaced(raw: str | None, name: str, new: str | None) -> str | None:
    """The entry with the value of a field replaced by ``{new}``. The field is the one that ``fields_of`` reads, so words in
    other values are left alone. The end of a value in braces is found by counting braces only."""
    if raw is None or new is None:
        return raw
    start = next((at for n, at in named_values(raw) if n == name), None)
    if start is None or start >= len(raw):
        return raw
    end = start
    if raw[start] == "{":
        depth, end = 1, start + 1
        while end < len(raw) and depth:
            depth += (raw[end] == "{") - (raw[end] == "}")
            end += 1
    elif raw[start] == '"':
        end = raw.find('"', start + 1) + 1
        if not end:
            return raw
    else:
        end = _BARE.match(raw, start).end()
    return f"{raw[:start]}{{{new}}}{raw[end:]}"


def first_item(json: str | None, marker: str) -> str | None:
    """The first object of an array that ``marker`` opens (such as ``"items":[{``), by counting braces; the whole text
    without the marker, an empty one if the object doesn't end."""
    if json is None or marker not in json:
        return json
    start = json.index(marker) + len(marker) - 1
    depth = 0
    for m in regex.finditer(r"[{}]", json[start:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return json[start : start + m.end()]
    return ""


ENTRIES = "array<struct<ord: int, type: string, key: string, raw: string>>"
ERRORS = "array<struct<ord: int, code: string, start: int, type: string, message: string>>"
PAIRS = "array<struct<name: string, value: string>>"


def parse_text(c: Column, strict_keys: bool = False) -> Column:
    """struct(entries, errors) of a text column."""
    entry = pa.list_(pa.struct([("ord", pa.int32()), ("type", pa.string()), ("key", pa.string()), ("raw", pa.string())]))
    error = pa.list_(pa.struct([("ord", pa.int32()), ("code", pa.string()), ("start", pa.int32()), ("type", pa.string()), ("message", pa.string())]))

    @F.arrow_udf(f"struct<entries: {ENTRIES}, errors: {ERRORS}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in bounded(batches):
            got = [parse(t.as_py(), strict_keys) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], entry), pa.array([g[1] for g in got], error)], ["entries", "errors"])

    return run(c)


def extract_fields(raw: Column, *names: str) -> Column:
    """struct of the named fields' values."""
    low = [n.strip().lower() for n in names]
    kind = ", ".join(f"`{n}`: string" for n in low)

    @F.arrow_udf(f"struct<{kind}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for raws in bounded(batches):
            got = [fields_of(r.as_py(), low) for r in raws]
            yield pa.StructArray.from_arrays([pa.array([g[i] for g in got], pa.string()) for i in range(len(low))], low)

    return run(raw)


def parse_fields(raw: Column) -> Column:
    """array of struct(name, value), in order."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))

    @F.arrow_udf(PAIRS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for raws in bounded(batches):
            yield pa.array([all_fields(r.as_py()) for r in raws], kind)

    return run(raw)


def read_entry(raw: Column, *names: str) -> Column:
    """struct of the named fields' values, all fields, and type and key of the first entry; one crossing into Python."""
    low = [n.strip().lower() for n in names]
    pairs = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))

    @F.arrow_udf("struct<" + "".join(f"`{n}`: string, " for n in low) + f"all_fields: {PAIRS}, entry_type: string, entry_key: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for raws in bounded(batches):
            texts = raws.to_pylist()
            named = [fields_of(t, low) for t in texts]
            first = [next(iter(parse(t)[0]), {}) for t in texts]
            columns = [pa.array([g[i] for g in named], pa.string()) for i in range(len(low))]
            columns += [pa.array([all_fields(t) for t in texts], pairs), *(pa.array([f.get(k) for f in first], pa.string()) for k in ("type", "key"))]
            yield pa.StructArray.from_arrays(columns, [*low, "all_fields", "entry_type", "entry_key"])

    return run(raw)


def replace_field(raw: Column, name: str, new: Column) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for raws, news in bounded(batches):
            yield pa.array([replaced(r.as_py(), name, n.as_py()) for r, n in zip(raws, news)], pa.string())

    return run(raw, new)


def item_of(json: Column, marker: str) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in bounded(batches):
            yield pa.array([first_item(t.as_py(), marker) for t in texts], pa.string())

    return run(json)
