r"""SentencePiece encoding and decoding by a max-plus scan.

A text is a lattice: its nodes are positions, its edges are pieces (and single characters). An encoding is a best path
under (max, +). For unigram models an edge weighs its score. For byte-pair models the merges decide instead, and they are
local: a sequence of pieces is the encoding exactly if merging any two neighbours' text gives these two pieces again. So
edges weigh 0, two edges may follow each other only if they pass that test (else minus infinity), and one path is left.

A giant text is cut into chunks anywhere. The state at a boundary is the edge that covers the character before it, so
there are few of them: the pieces that match the text there. A chunk yields the transfer matrix from the states at its
start to those at its end, each chunk on its own; paths from different states run together after a few pieces, and are
followed no further. Matrices are combined associatively: those of a block of ``FAN`` chunks by a tree of (max, +) products,
each block in a task of its own, into one. The blocks' matrices of a text (at most 2^31 / (CHUNK FAN) of them) give the states
at the blocks' ends; each block then finds the states at its chunks' ends between its own two, and each chunk is traced back
independently between its two states. A text that one task holds (of ``CHUNK`` characters at most) goes the same way in there, in
chunks of ``PART``: matrices, their tree of products, the states at all boundaries, and a trace for each chunk. Inside a chunk, positions that no
piece crosses (the end of a word) have a single state too: from the first to the last of them the matrix is the same for all
states, and what lies between two of them is looked up in a bounded cache, and scanned only once.

Nothing is cut off: chunks only bound what a task holds. Long texts are many rows until their ids are put together.

Decoding puts the pieces' bytes together, ``▁`` as a space, without the space that encoding puts in front.

Defined results: null text gives null ids, an empty text none; repeated rows are encoded each; an empty table gives no
rows; characters that the model lacks become byte pieces (or the unknown id, in models without bytes); ``▁`` in a text
reads as a space, and ``lossless`` is then false. Other columns are kept, whatever
their names; one named ``encoded`` is replaced.
"""

from __future__ import annotations

import re
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import holds, materialize, only, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 15  # characters
PART = 1 << 12  # characters of a chunk of a text that is encoded in one task
FAN = 512  # chunks whose matrices are combined in one task
MARK, SPACE = "▁", " "  # what models write for a space, and what stands for both in here
CACHE, HEADS, PAIRS = 200_000, 50_000, 200_000  # entries that a worker keeps for speed; results don't depend on them
NEVER = float("-inf")
LONG, HEAD = 64, 5  # characters of what is cached, and of the starts that are
OUT = 2 << 20  # ids that a batch of results holds, about


def _fields(raw: bytes):
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def number():
        nonlocal at
        n = shift = 0
        while True:
            n |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                return n

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}[key & 7] if key & 7 != 2 else number()
            yield key >> 3, raw[at : at + n]
            at += n


class Model:
    """The pieces of a model, and the scan."""

    def __init__(self, pieces: dict[str, int], scores: dict[str, float], bpe: bool, byte_ids: list[int] | None = None, unknown: int = 0, prefix: bool = True) -> None:
        pieces, scores = ({p.replace(MARK, SPACE): v for p, v in x.items()} for x in (pieces, scores))
        self.ids, self.scores, self.bpe, self.byte_ids, self.unknown, self.prefix = pieces, scores, bpe, byte_ids, unknown, prefix
        self.longest = max(map(len, pieces), default=1)
        self.worst = min(scores.values(), default=0.0) - 10.0
        many = [p for p in pieces if len(p) > 1]
        inside = set("".join(many))
        pairs = {p[i : i + 2] for p in many for i in range(len(p) - 1)}
        alone = "".join(c for c in map(chr, range(128)) if c not in inside)
        # before a mark there is a position that no piece crosses, but after the few characters that some piece has before one
        marks = {c for c in map(chr, range(33, 127)) if c in inside and not c.isalnum()}
        glue = {x[0] for x in pairs if x[1] in marks and x[0] not in marks and x[0] != SPACE}
        any_of = lambda cs: "[" + re.escape("".join(sorted(cs))) + "]" if cs else r"(?!)"
        plain = f"[^{SPACE}{re.escape(alone + ''.join(sorted(marks)))}]"
        lead = f"{any_of(marks)}*" if marks else ""
        glued = f"(?:(?<={any_of(glue)}){any_of(marks)}+{plain}*)*" if glue and marks else ""
        # where no piece has a space mark after another character, the end of a word is such a position too
        words = not any(SPACE in p.lstrip(SPACE) for p in many)
        runs = [f"{SPACE}*{lead}{plain}+{glued}", f"{SPACE}*{any_of(marks)}+", f"{SPACE}+", any_of(alone)]
        self.cut = re.compile("|".join(runs) if words else r"(?s).+")
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        # pieces that merging gives at all, with the stages of their merging
        self.edges = {p: x for p in pieces if (x := self.stages(p))} if bpe else dict.fromkeys(pieces, [])
        self.packed_of = {p: i.to_bytes(4, "little") for p, i in pieces.items()}
        self.cache = _Cache(self)
        self.text_of = {i: p.encode() for p, i in pieces.items()}
        for b, i in enumerate(byte_ids or []):
            self.text_of[i] = bytes([b])
        self.all_texts = pa.array([self.text_of.get(i, b"") for i in range(max(self.text_of, default=0) + 1)], pa.binary())

    @staticmethod
    def load(path: str = MODEL) -> Model:
        import sentencepiece

        raw = open(path, "rb").read()
        top = list(_fields(raw))
        trainer = dict(x for n, v in top if n == 2 for x in _fields(v))
        normal = dict(x for n, v in top if n == 3 for x in _fields(v))
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only models that change nothing but spaces are supported")
        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        kinds = [(i, sp.id_to_piece(i)) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = {p: i for i, p in kinds if not sp.is_byte(i)}
        byte_ids = [i for i, _ in kinds if sp.is_byte(i)]
        return Model(pieces, {p: sp.get_score(i) for p, i in pieces.items()}, trainer.get(3, 1) == 2, byte_ids if len(byte_ids) == 256 else None, sp.unk_id(), bool(normal.get(3, 1)))

    # The edges

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: the best pair first, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stages(self, text: str) -> list[tuple[str, str, float]]:
        """First part, last part and score of the next merge of each stage of merging ``text`` (-inf when it is over)."""
        parts, out = list(text), []
        while True:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1], NEVER)
                if s > best:
                    best, at = s, i
            out.append((parts[0], parts[-1], best))
            if at < 0:
                return out if len(parts) == 1 else []
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def is_edge(self, text: str) -> bool:
        return len(text) == 1 or text in self.edges

    def follows(self, a: str, b: str) -> bool:
        """Whether merging the text of both gives ``a`` and ``b``: whether no merge across their border ever comes first."""
        if not a or not self.bpe:
            return True
        known = self.pairs.get(a)
        if known is None:
            known = self.pairs[a] = {}
        got = known.get(b)
        if got is None:
            self.n_pairs += 1
            if self.n_pairs > PAIRS:
                self.pairs.clear()
                known, self.n_pairs = {}, 0
            got = known[b] = self._apart(self.edges.get(a) or [(a, a, NEVER)], self.edges.get(b) or [(b, b, NEVER)])
        return got

    def _apart(self, left: list, right: list) -> bool:
        scores, i, j = self.scores, 0, 0
        while True:
            _, end, own = left[i]
            start, _, other = right[j]
            across = scores.get(end + start, NEVER)
            # of equal scores the leftmost merges first: one inside the left, then the one across
            if across > own and across >= other and across > NEVER:
                return False
            if own == other == NEVER:
                return True
            if own >= other:
                i += 1
            else:
                j += 1

    def weight(self, text: str) -> float:
        return 0.0 if self.bpe else self.scores.get(text, self.worst)

    # The scan

    def forward(self, text: str, start: int, stop: int, edge: str, like: dict | None = None) -> tuple[dict, int | None]:
        """Nodes (weight, last edge) from a node at ``start`` whose last edge is ``edge``, up to ``stop``.

        With ``like``, nodes from another state: ends where the two have run together, and tells where."""
        nodes, same, gap = {start: (0.0, edge)}, 0, None
        for p in range(start + 1, stop + 1):
            best = None
            for i in range(p - 1, max(start, p - self.longest) - 1, -1):
                at = nodes.get(i)
                if at is None:
                    continue
                t = text[i:p]
                if self.is_edge(t) and self.follows(at[1], t):
                    w = at[0] + self.weight(t)
                    if best is None or w >= best[0]:
                        best = (w, t)
                    if self.bpe:
                        break
            if best is not None:
                nodes[p] = best
            if like is not None:
                other = like.get(p)
                if other is None and best is None:
                    same += 1
                elif other is not None and best is not None and other[1] == best[1]:
                    d = best[0] - other[0]
                    same = same + 1 if gap is None or abs(d - gap) < 1e-9 else 1
                    gap = d
                else:
                    same = 0
                if same > self.longest and best is not None:
                    return nodes, p
        return nodes, None

    def back(self, text: str, nodes: dict, at: int, start: int) -> list[str]:
        out = []
        while at > start:
            out.append(nodes[at][1])
            at -= len(out[-1])
        return out[::-1]

    def states(self, text: str, b: int) -> list[tuple[int, int]]:
        """Edges over the character before ``b``, as (start, end) relative to ``b``."""
        return [(i - b, e - b) for i in range(max(0, b - self.longest), b) for e in range(b, min(len(text), i + self.longest) + 1) if self.is_edge(text[i:e])]

    def cuts(self, text: str, b0: int, b1: int) -> tuple[int, int] | None:
        """The first and the last position between ``b0`` and ``b1`` that no piece crosses."""
        one = self.cut.match(text, b0, b1)
        if one is None or one.end() >= b1:
            return None
        # where a stretch ends and another begins is told by the characters there, wherever the search began; the last one
        # found ends where the chunk does, or not
        near = [m.end() for m in self.cut.finditer(text, max(one.end(), b1 - 128), b1)][:-1]
        if not near:
            near = [one.end(), *(m.end() for m in self.cut.finditer(text, one.end(), b1))][:-1]
        return one.end(), near[-1]

    def transfer(self, text: str, b0: int, b1: int, cuts: tuple | None | bool = False) -> list[tuple[int, int, int, int, float]]:
        """The matrix of the chunk from ``b0`` to ``b1`` of ``text``: (start, end) of the states at both, and the weight. ``cuts``: those
        of the chunk, if they are known.

        What lies between the first and the last cut weighs the same on all paths, and is left out."""
        enter = [(0, 0)] if b0 == 0 else self.states(text, b0)
        leave = [(s + b1, e + b1) for s, e in self.states(text, b1)]

        def ends(nodes: dict) -> list[tuple[int, int, float]]:
            return [(i - b1, j - b1, nodes[i][0] + self.weight(text[i:j])) for i, j in leave if i in nodes and self.follows(nodes[i][1], text[i:j])]

        cuts = self.cuts(text, b0, b1) if cuts is False else cuts
        if cuts:
            after = ends(self.forward(text, cuts[1], b1, "")[0])
            before = [(s, e, self.forward(text, b0 + e, cuts[0], text[b0 + s : b0 + e])[0].get(cuts[0])) for s, e in enter]
            return [(s, e, i, j, node[0] + w) for s, e, node in before if node is not None for i, j, w in after]
        out, first = [], None
        for s, e in enter:
            nodes, met = self.forward(text, b0 + e, b1, text[b0 + s : b0 + e], first)
            if met is not None:  # the rest is the first state's, with another weight
                gap = nodes[met][0] - first[met][0]
                nodes |= {p: (w + gap, t) for p, (w, t) in first.items() if p > met}
            elif first is None:
                first = nodes
            out += [(s, e, i, j, w) for i, j, w in ends(nodes)]
        return out

    def trace(self, text: str, b0: int, b1: int, enter: tuple[int, int], leave: tuple[int, int], cuts: tuple | None | bool = False) -> tuple[list[str], str, list[str]]:
        """The edges after the state ``enter`` at ``b0``, up to and with the state ``leave`` at ``b1``: up to the first cut, the
        text from there to the last cut, and the edges after it."""
        start, end, edge = b0 + enter[1], b1 + leave[0], text[b0 + enter[0] : b0 + enter[1]]
        cuts = self.cuts(text, b0, b1) if cuts is False else cuts
        head, middle = [], ""
        if cuts:
            head = self.back(text, self.forward(text, start, cuts[0], edge)[0], cuts[0], start)
            middle, start, edge = text[cuts[0] : cuts[1]], cuts[1], ""
        return head, middle, [*self.back(text, self.forward(text, start, end, edge)[0], end, start), text[end : b1 + leave[1]]]

    def traced(self, *chunk) -> bytes:
        """The packed ids of ``trace``."""
        head, middle, tail = self.trace(*chunk)
        return self.packed(head) + b"".join(map(self.cache.__getitem__, self.cut.findall(middle))) + self.packed(tail)

    # Texts

    def normal(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(MARK, SPACE)

    def packed(self, edges: list[str]) -> bytes:
        try:
            return b"".join(map(self.packed_of.__getitem__, edges))
        except KeyError:
            return b"".join(self.packed_of.get(t) or self._lacking(t) for t in edges)

    def _lacking(self, t: str) -> bytes:
        if not self.byte_ids:
            return self.unknown.to_bytes(4, "little")
        return b"".join(self.byte_ids[b].to_bytes(4, "little") for b in t.encode("utf-8", "surrogatepass"))

    def bounds(self, n: int, size: int) -> list[int]:
        """Where chunks of about ``size`` of a text of ``n`` characters begin, and its end."""
        return [0, *range(size, n - max(size // 2, self.longest), size), n]

    def encode(self, text: str, size: int = PART) -> np.ndarray:
        """The ids of a text that a task holds: its chunks' matrices are combined, and each chunk is traced between its states."""
        text = self.normal(text)
        if not text:
            return np.zeros(0, "<i4")
        bounds = self.bounds(len(text), size)
        chunks = [(a, b, self.cuts(text, a, b)) for a, b in zip(bounds, bounds[1:])]
        matrices = [[dict(zip("seijw", row)) for row in self.transfer(text, *c)] for c in chunks]
        states = combine(matrices, *combine([block_matrix(matrices)]))
        return np.frombuffer(b"".join(self.traced(text, a, b, x, y, c) for (a, b, c), x, y in zip(chunks, states, states[1:])), "<i4")

    def raw(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        got = self.all_texts.take(pa.array(ids[(ids >= 0) & (ids < len(self.all_texts))]))
        return got.buffers()[2].to_pybytes() if got.nbytes and got.buffers()[2] else b""

    def decode(self, ids) -> str:
        return self.raw(ids).decode("utf-8", "replace")[1 if self.prefix else 0 :]


class _Cache(dict):
    """Packed ids of a stretch of text between two positions that no piece crosses."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.heads: dict[str, list] = {}
        self.before: dict[str, bytes] = {}  # what was in here until it was full; what is still asked for comes back

    def __missing__(self, text: str) -> bytes:
        out = self.before.get(text)
        if out is None:
            out = self._encoded(text)
        if len(text) <= LONG:
            if len(self) >= CACHE:
                self.before = dict(self)
                self.clear()
            self[text] = out
        return out

    def _encoded(self, text: str) -> bytes:
        model = self.model
        if model.bpe and len(text) <= LONG:
            edges = self._one_path(text)
        else:
            nodes, _ = model.forward(text, 0, len(text), "")
            edges = model.back(text, nodes, len(text), 0)
        return model.packed(edges)

    def _one_path(self, text: str) -> list[str]:
        """``forward`` and ``back`` for a short text and a byte-pair model, of which each prefix has one encoding."""
        model, n = self.model, len(text)
        known, pairs, follows, longest = model.edges, model.pairs, model.follows, model.longest
        head = self.heads.get(text[:HEAD]) if n > HEAD else None  # what stands for all texts that start alike
        last: list = [*head, *[None] * (n - HEAD)] if head else ["", *[None] * n]
        for p in range(HEAD + 1 if head else 1, n + 1):
            for i in range(p - 1, max(-1, p - longest - 1), -1):
                a = last[i]
                if a is None:
                    continue
                t = text[i:p]
                if t not in known and i + 1 < p:
                    continue
                if a:
                    try:
                        ok = pairs[a][t]
                    except KeyError:
                        ok = follows(a, t)
                    if not ok:
                        continue
                last[p] = t
                break
        if head is None and n > HEAD:
            if len(self.heads) >= HEADS:
                self.heads.clear()
            self.heads[text[:HEAD]] = last[: HEAD + 1]
        out = []
        while n:
            out.append(last[n])
            n -= len(out[-1])
        return out[::-1]


_models: dict[str, Model] = {}


def _drop() -> None:
    if _models:
        _models.clear()
        trim()


holds("pieces", _drop)


def model_at(path: str) -> Model:
    """The model of this process."""
    only("pieces")
    if path not in _models:
        _models[path] = Model.load(path)
    return _models[path]


RESULT = pa.schema([("n_ids", pa.int64()), ("ids", pa.list_(pa.int32())), ("lossless", pa.bool_())])


def _result(ids: list[np.ndarray | None], texts: list[str | None], model: Model) -> pa.StructArray:
    sizes = [0 if x is None else len(x) for x in ids]
    flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)]).astype(np.int32)
    none = pa.array([x is None for x in ids])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat), mask=none) if ids else pa.array([], pa.list_(pa.int32()))
    same = pa.array([None if x is None else model.decode(x) == t for x, t in zip(ids, texts)], pa.bool_())
    n = pa.array([None if x is None else len(x) for x in ids], pa.int64())
    return pa.StructArray.from_arrays([n, lists, same], fields=list(RESULT))


def _encode_short(batches, path: str, size: int = PART):
    """Texts that a task holds, each in chunks of ``size``."""
    model = model_at(path)
    for batch in batches:
        texts = batch.column("text")
        at, held, ids, said = 0, 0, [], []
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            ids.append(None if text is None else model.encode(text, size))
            said.append(text)
            held += len(ids[-1]) if text is not None else 0
            if held > OUT or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, i + 1 - at), _result(ids, said, model)], ["row", "encoded"])
                at, held, ids, said = i + 1, 0, [], []


def _chunks(batches, path: str, size: int):
    """A row for each chunk, with enough text on either side for the states at its ends."""
    model = model_at(path)
    side = model.longest
    for batch in batches:
        for i in range(batch.num_rows):
            text = model.normal(batch.column("text")[i].as_py())
            bounds = model.bounds(len(text), size)
            rows = [(k, max(0, a - side), a, b, text[max(0, a - side) : b + side]) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            for k, at, a, b, part in rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("uid")[i].as_py()], pa.int64()), pa.array([k], pa.int64()), pa.array([a - at], pa.int64()), pa.array([b - at], pa.int64()), pa.array([part])], ["uid", "chunk", "b0", "b1", "part"])


MATRIX = "array<struct<s: int, e: int, i: int, j: int, w: double>>"
KIND = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("w", pa.float64())]))


def _matrices(batches, path: str):
    model = model_at(path)
    for batch in batches:
        got = [[dict(zip("seijw", row)) for row in model.transfer(part, b0, b1)] for b0, b1, part in zip(*(batch.column(c).to_pylist() for c in ("b0", "b1", "part")))]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("chunk"), pa.array(got, KIND)], ["uid", "chunk", "matrix"])


def product(a: list[dict], b: list[dict]) -> list[dict]:
    """The (max, +) product of two neighbours' matrices."""
    by_start: dict = {}
    for r in b:
        by_start.setdefault((r["s"], r["e"]), []).append(r)
    best: dict = {}
    for r in a:
        for t in by_start.get((r["i"], r["j"]), ()):
            k, w = (r["s"], r["e"], t["i"], t["j"]), r["w"] + t["w"]
            if w > best.get(k, NEVER):
                best[k] = w
    return [dict(zip("seijw", (*k, w))) for k, w in best.items()]


def block_matrix(matrices: list[list[dict]]) -> list[dict]:
    """One matrix for those of neighbouring chunks, by a tree of products."""
    while len(matrices) > 1:
        matrices = [product(matrices[i], matrices[i + 1]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def combine(matrices: list[list[dict]], enter: tuple[int, int] = (0, 0), leave: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """The states at all boundaries on the best path from ``enter`` to ``leave`` (the end of the text, if not given), these two
    included."""
    ahead = [{enter: 0.0}]
    for m in matrices:
        now: dict = {}
        for r in m:
            w = ahead[-1].get((r["s"], r["e"]))
            if w is not None and w + r["w"] > now.get((r["i"], r["j"]), NEVER):
                now[r["i"], r["j"]] = w + r["w"]
        ahead.append(now)
    state = leave or max((k for k in ahead[-1] if k[1] == 0), key=lambda k: ahead[-1][k])
    out = [state]
    for m, before in zip(matrices[::-1], ahead[-2::-1]):
        state = max(((before[r["s"], r["e"]] + r["w"], (r["s"], r["e"])) for r in m if (r["i"], r["j"]) == state and (r["s"], r["e"]) in before))[1]
        out.append(state)
    return out[::-1]


def _blocks(batches):
    """The matrix of each block of chunks."""
    for batch in batches:
        got = [block_matrix([r["matrix"] for r in rows]) for rows in batch.column("rows").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("block"), pa.array(got, KIND)], ["uid", "block", "matrix"])


def _between(batches, name: str):
    """Of rows with the matrices of neighbours (``name``: their number) the states at the ends of each; between ``enter`` and
    ``leave``, if the rows have them."""
    for batch in batches:
        cols = [[] for _ in range(6)]
        known = "s0" in batch.schema.names
        ends = zip(*(batch.column(c).to_pylist() for c in ("s0", "e0", "s1", "e1"))) if known else repeat((0, 0, None, None))
        for uid, rows, (s0, e0, s1, e1) in zip(batch.column("uid").to_pylist(), batch.column("rows").to_pylist(), ends):
            states = combine([r["matrix"] for r in rows], (s0, e0), (s1, e1) if known else None)
            for r, x, y in zip(rows, states, states[1:]):
                for to, v in zip(cols, (uid, r[name], *x, *y)):
                    to.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["uid", name, "s0", "e0", "s1", "e1"])


def _traces(batches, path: str):
    model = model_at(path)
    for batch in batches:
        got = [model.traced(part, b0, b1, (s0, e0), (s1, e1)) for b0, b1, part, s0, e0, s1, e1 in zip(*(batch.column(c).to_pylist() for c in ("b0", "b1", "part", "s0", "e0", "s1", "e1")))]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("chunk"), pa.array(got, pa.binary())], ["uid", "chunk", "ids"])


def _checked(batches, path: str):
    model = model_at(path)
    for batch in batches:
        for i in range(batch.num_rows):
            ids = np.frombuffer(b"".join(x["ids"] for x in batch.column("packed")[i].as_py()), "<i4")
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, 1), _result([ids], [batch.column("text")[i].as_py()], model)], ["row", "encoded"])


def encode(docs: DataFrame, path: str = MODEL, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """The rows and columns of ``docs`` (text, ...) with a struct column ``encoded``: n_ids, ids, lossless."""
    others = [c for c in docs.columns if c not in ("text", "encoded")]
    row = F.struct(*[docs[c] for c in others]) if others else F.struct(F.lit(0).alias("none"))
    rows = docs.select(F.col("text").cast("string").alias("text"), row.alias("row"))
    kind = dict(rows.dtypes)["row"]
    result = f"row {kind}, encoded struct<n_ids: bigint, ids: array<int>, lossless: boolean>"
    giant = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = rows.where(~giant).mapInArrow(partial(_encode_short, path=path, size=min(PART, chunk)), result)
    # the ids of rows hold for what has been written
    long = materialize(rows.where(giant).withColumn("uid", F.monotonically_increasing_id()), "giant")
    parts = materialize(long.select("uid", "text").mapInArrow(partial(_chunks, path=path, size=chunk), "uid long, chunk long, b0 long, b1 long, part string"), "chunks")
    # some chunks a task, whatever their number; a fixed number of partitions is left as it is by adaptive execution
    tasks = max(1, -(-parts.count() // 8))
    spread = parts.repartition(tasks, "uid", "chunk")
    matrices = spread.mapInArrow(partial(_matrices, path=path), f"uid long, chunk long, matrix {MATRIX}")
    rows_of = lambda by: F.array_sort(F.collect_list(F.struct(by, "matrix"))).alias("rows")
    blocks = materialize(matrices.groupBy("uid", F.floor(F.col("chunk") / fan).alias("block")).agg(rows_of("chunk")), "matrices")
    ends = blocks.mapInArrow(_blocks, f"uid long, block long, matrix {MATRIX}").groupBy("uid").agg(rows_of("block"))
    ends = ends.mapInArrow(partial(_between, name="block"), "uid long, block long, s0 long, e0 long, s1 long, e1 long")
    paths = blocks.join(ends, ["uid", "block"]).mapInArrow(partial(_between, name="chunk"), "uid long, chunk long, s0 long, e0 long, s1 long, e1 long")
    traced = spread.join(paths.repartition(tasks, "uid", "chunk"), ["uid", "chunk"]).mapInArrow(partial(_traces, path=path), "uid long, chunk long, ids binary")
    # packed: arrays of numbers would be an object for each number in the aggregate
    whole = traced.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("packed"))
    done = long.join(whole, "uid").select("row", "text", "packed").mapInArrow(partial(_checked, path=path), result)
    out = short.unionByName(done)
    return out.select(*[F.col("row").getField(c).alias(c) for c in others], "encoded")


def decode(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """``rows`` with a column ``decoded``: the text of its column ids (null for null)."""

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        model = model_at(path)
        return pa.array([None if x.as_py() is None else model.decode(x.as_py()) for x in ids], pa.string())

    return rows.withColumn("decoded", text(F.col("ids")))


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "encoded.n_ids", "encoded.ids", "encoded.lossless")
