"""Scanning a text in pieces, each without the ones before it.

What a piece does to the scanner is a function from the state before it to the state after it. A state is where the scanner
stands: between entries, in the head of one (behind its ``@``, in its type, behind that), or in an entry: its opener, the depth of
openers, and whether a quote or a backslash is open. Functions are put together associatively, so that the states before all
pieces of a text are known after a scan over small tables, and the pieces can be cut alone.

Only the depth is unbounded. From an opener, a quote and a backslash it is known at which place of a piece each depth would reach
zero first, and what follows from there on, which soon is the same for all; deeper entries stay open and are deeper or shallower by
the same number. So the function of an entry is a short table of depths, and a difference.
"""

from __future__ import annotations

from typing import NamedTuple

from . import scanner
from .scanner import _GAP, _HEAD, _IDENT, _MARK, CLOSER, regex

TOP, AT, TYPE, GAP, ENTRY = range(5)
_NAMED = regex.compile(rf"(?V1){_IDENT}*")


class State(NamedTuple):
    """``owner``: the piece in which the entry or its head began; None: in none of the pieces looked at."""

    mode: int = TOP
    opener: str = ""
    depth: int = 0
    quoted: bool = False
    escaped: bool = False
    owner: int | None = None


START = State()


def _marks(text: str, at: int, quoted: bool, escaped: bool):
    """(position, mark, quoted) of marks that no backslash precedes, from ``at`` on, and at last (None, escaped, quoted)."""
    free = at + escaped
    for m in _MARK.finditer(text, at):
        p, c = m.start(), m[0]
        if p < free:
            continue
        if c == "\\":
            free = p + 2
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            yield p, c, quoted
    yield None, free > len(text), quoted


def _inside(text: str, at: int, s: State) -> tuple[int, State]:
    """(where the entry ends, state) from ``at`` on; -1 if it doesn't."""
    depth, closer = s.depth, CLOSER[s.opener]
    for p, c, quoted in _marks(text, at, s.quoted, s.escaped):
        if p is None:
            return -1, s._replace(depth=depth, quoted=quoted, escaped=c)
        depth += (c == s.opener) - (c == closer)
        if not depth:
            return p + 1, START
    raise AssertionError


class Found(NamedTuple):
    """An entry from ``start`` to ``end``, its type, and where its body begins (behind the opener)."""

    start: int
    end: int
    kind: str
    body: int


def top(text: str, at: int, here: int):
    """Entries from ``at`` on, and at last (where what is open began, state)."""
    while (at := text.find("@", at)) >= 0:
        head = _HEAD.match(text, at)
        body = head.end()
        if not head["type"]:
            if body >= len(text):
                yield at, State(AT, owner=here)
                return
            at += 1
            continue
        if body >= len(text):
            yield at, State(GAP if head["gap"] else TYPE, owner=here)
            return
        opener = text[body]
        if opener not in CLOSER:
            at = body + 1
            continue
        end, state = _inside(text, body + 1, State(ENTRY, opener, 1, owner=here))
        if end < 0:
            yield at, state
            return
        yield Found(at, end, head["type"], body + 1)
        at = end
    yield len(text), START


def resume(text: str, s: State) -> tuple[int, int, State]:
    """What comes of the state before a piece: (where its entry ends, where the scanner goes on between entries, state). The first is
    -1 without an entry that ends here, the second -1 if all of the piece belongs to what was open before."""
    at, mode = 0, s.mode
    if mode == AT:
        at = _GAP.match(text, 0).end()
        if at == len(text):
            return -1, -1, s
        mode = TYPE
        if not _NAMED.match(text, at).end() > at:
            return -1, at, START
    if mode == TYPE:
        at = _NAMED.match(text, at).end()
        if at == len(text):
            return -1, -1, s._replace(mode=TYPE)
        mode = GAP
    if mode == GAP:
        end = _GAP.match(text, at).end()
        if end == len(text):
            return -1, -1, s._replace(mode=GAP)
        if text[end] not in CLOSER:
            return -1, end + 1, START
        s, at, mode = State(ENTRY, text[end], 1, owner=s.owner), end + 1, ENTRY
    if mode == ENTRY:
        end, state = _inside(text, at, s)
        return (end, end, START) if end >= 0 else (-1, -1, state)
    return -1, 0, START


class Change(NamedTuple):
    """The function of one or more pieces. ``heads``: the state after each mode but ENTRY; ``entries``: by opener, quoted and escaped,
    ([(depth up to which, state after it)], difference of depths, quoted, escaped)."""

    heads: list[State]
    entries: dict[str, tuple[list[tuple[int, State]], int, bool, bool]]

    def of(self, s: State) -> State:
        if s.mode != ENTRY:
            out = self.heads[s.mode]
        else:
            ends, more, quoted, escaped = self.entries[f"{s.opener}{s.quoted:d}{s.escaped:d}"]
            out = next((t for d, t in ends if s.depth <= d), None) or State(ENTRY, s.opener, s.depth + more, quoted, escaped)
        return out._replace(owner=s.owner) if out.owner is None and out.mode else out

    def then(self, other: Change) -> Change:
        entries = {}
        for name, (ends, more, quoted, escaped) in self.entries.items():
            later, further, q, e = other.entries[f"{name[0]}{quoted:d}{escaped:d}"]
            new = [(d, other.of(t)) for d, t in ends]
            last = ends[-1][0] if ends else 0
            new += [(d - more, t) for d, t in later if d - more > last]
            entries[name] = (_short(new), more + further, q, e)
        return Change([other.of(s) for s in self.heads], entries)

    def packed(self) -> list:
        return [[list(s) for s in self.heads], {k: [[[d, list(s)] for d, s in ends], *rest] for k, (ends, *rest) in self.entries.items()}]


def unpacked(x: list) -> Change:
    return Change([State(*s) for s in x[0]], {k: ([(d, State(*s)) for d, s in v[0]], *v[1:]) for k, v in x[1].items()})


def _short(ends: list[tuple[int, State]]) -> list[tuple[int, State]]:
    """Depths with the same state after them as one."""
    return [x for i, x in enumerate(ends) if i + 1 == len(ends) or ends[i + 1][1] != x[1]]


def change(text: str, here: int) -> Change:
    """The function of a piece."""
    known: dict[int, State] = {}

    def after(at: int) -> State:
        """The state at the end if the scanner is between entries at ``at``."""
        met = []
        while (first := text.find("@", at)) >= 0 and first not in known:
            met.append(first)
            step = next(top(text, first, here))
            if not isinstance(step, Found):
                known[first] = step[1]
                break
            at = step.end
        end = known[first] if first >= 0 else START
        known.update(dict.fromkeys(met, end))
        return end

    heads = []
    for mode in (TOP, AT, TYPE, GAP):
        _, at, state = resume(text, State(mode))
        heads.append(after(at) if at >= 0 else state)
    entries = {}
    for opener, closer in CLOSER.items():
        for quoted in (False, True):
            for escaped in (False, True):
                if escaped and text[:1] not in _ESCAPABLE:
                    entries[f"{opener}{quoted:d}1"] = entries[f"{opener}{quoted:d}0"]
                    continue
                depth, least, ends = 0, 0, []
                for p, c, q in _marks(text, 0, quoted, escaped):
                    if p is None:
                        break
                    depth += (c == opener) - (c == closer)
                    if depth < least:
                        least = depth
                        ends.append((-depth, after(p + 1)))
                entries[f"{opener}{quoted:d}{escaped:d}"] = (_short(ends), depth, q, bool(c))
    return Change(heads, entries)


_ESCAPABLE = ("", "\\", '"', "{", "}", "(", ")", ",")


def key_of(text: str, opener: str, stop: int | None) -> str | None:
    """The key at the start of an entry's body; None if it doesn't end in ``text`` (without ``stop``)."""
    first = _GAP.match(text, 0).end()
    end = scanner._key_end(text, first, CLOSER[opener], stop)
    return None if stop is None and end >= len(text) else scanner.py_trim(text[first:end])
