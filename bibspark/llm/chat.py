r"""Chat formatting by event-sourced reconstruction.

Logs of events are partitioned by conversation and sorted by sequence; a fold turns streamed deltas, edits and
regenerations into the final messages, which are then rendered. The fold goes through a partition row by row and holds
the messages of one conversation at a time, so memory is bounded by the longest conversation and not by a partition or
a batch.

Events (columns conv_id, seq, kind, msg, role, text):

* ``message``: the whole text of message ``msg``; a new one goes to the end.
* ``delta``: text to append to ``msg``, which it opens if need be.
* ``edit``: replaces the text (and the role, if given) of ``msg``; opens it if it is unknown.
* ``regenerate``: drops all messages after ``msg`` and empties it; the deltas that follow fill it again.
* ``delete``: removes ``msg``.

Unknown kinds count as ``message``. A null ``msg`` is a message of its own. Null text and null role are empty. Nulls in
``seq`` come first; ties go by msg, kind, role and text, so a rerun gives the same result. Null conv_id is a
conversation of its own. A conversation of which no message is left gives no row, nor does an empty table. Other columns
are not looked at.

Template: ``<|turn|>role\n`` text ``<|end|>\n`` for each message. Inside roles and texts a backslash is doubled, and one
is put after the first character of each control string (of this template, and those of other common ones), so that no
control string is left in the content; the end of a line in a role is written ``\n``. Reading back undoes this exactly.
The loss mask holds the escaped texts of the assistant, as spans (start, length) in code points.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: What templates use to mark turns.
CONTROL = ["<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "<unk>", "<pad>"]
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\(.?)", re.DOTALL)
BATCH = 4 << 20  # code points that a batch of results holds, about

RENDERED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" if m[1] == "\\" else m[1], text)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else "\\" if m[1] == "\\" else m[1], role)


def render(messages: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{_escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append({"start": at + len(head), "length": len(body)})
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The messages of a rendered conversation."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line)
        out.append((_unescape_role(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(CLOSE)
    return out


class Fold:
    """The state of one conversation."""

    def __init__(self) -> None:
        self.order: dict = {}  # msg -> [role, parts of the text]; in order of the first event
        self.alone = 0

    def add(self, kind: str | None, msg, role: str | None, text: str | None) -> None:
        if msg is None:
            self.alone += 1
            msg = ("alone", self.alone)
        known = self.order.get(msg)
        if kind == "delete":
            self.order.pop(msg, None)
        elif kind == "delta" and known is not None:
            known[1].append(text or "")
        elif kind == "edit" and known is not None:
            self.order[msg] = [known[0] if role is None else role, [text or ""]]
        elif kind == "regenerate":
            if known is not None:
                keys = list(self.order)
                for later in keys[keys.index(msg) + 1 :]:
                    del self.order[later]
            self.order[msg] = [role if role is not None else known[0] if known else "assistant", [text or ""]]
        elif known is not None:
            self.order[msg] = [role or "", [text or ""]]
        else:
            self.order[msg] = [role or "", [text or ""]]

    def messages(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts in self.order.values()]


def _reconstruct(batches):
    rows, held, now, fold = [], 0, (), None

    def close():
        nonlocal held
        if fold is not None and fold.order:
            text, spans = render(fold.messages())
            rows.append({"conv_id": now[0], "formatted": text, "loss_spans": spans})
            held += len(text)

    for batch in batches:
        for conv, kind, msg, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "msg", "role", "text"))):
            if fold is None or now != (conv,):
                close()
                now, fold = (conv,), Fold()
            fold.add(kind, msg, role, text)
            if held > BATCH:
                yield pa.RecordBatch.from_pylist(rows, RENDERED)
                rows, held = [], 0
    close()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, RENDERED)


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans for each conversation of ``events``."""
    log = events.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("seq", "long"), ("kind", "string"), ("msg", "long"), ("role", "string"), ("text", "string"))))
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "msg", "kind", "role", "text")
    return log.mapInArrow(_reconstruct, "conv_id long, formatted string, loss_spans array<struct<start: long, length: long>>")


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches):
    for batch in batches:
        rows = []
        for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans"))):
            turns = read_back(text)
            under = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(DIGEST), DIGEST.types)], schema=DIGEST)


def digest(rendered: DataFrame) -> DataFrame:
    """What is read back from the rendered conversations."""
    return rendered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(turns: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as events. Repeated rows and equal turns are messages of their own."""
    return turns.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("long").alias("msg"), "role", "text")


def op10_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digest(format_chats(as_events(turns.unionByName(extra))))


# formatted_chars counts the template and the escapes: 8 + 1 + 8 for the marks of each turn, and what escaping adds.
ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, 17 + length(role) + length(text) + len(regexp_extract_all(text, '\\|<\|turn\|>|<\|end\|>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|user\|>|<\|assistant\|>|<\|system\|>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<s>|</s>|<unk>|<pad>')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""
