"""Chat formatting by incremental black-box rendering.

A template is any function from a list of {"role", "content"} to a string. It is
rendered for successive prefixes of the turns; consecutive outputs are compared,
and what the later one adds is the turn's span. An output that does not begin with
the one before shows a template that rewrites history: its turns are then located
in the last output by what all later outputs agree on, and ``rewrites_history`` is
set. Within a span the content is found by rendering the turn with another content.

A template that declares ``append_only`` (this module's own does, being a join of
turns) is rendered in windows of BLOCK turns, each beginning with the last turn of the
one before, whose own output is left out: work is linear in the number of turns, and
the output is that of rendering all turns at once. Any other template is rendered for
every prefix of the whole conversation, whatever its length, so its output and
rewritten history do not depend on windows.

The escaping template marks turns with control strings. Its escape character and
every bracket that could begin a control string are escaped inside texts, so
``parse`` gets back roles and texts exactly.

Rows are sorted by conversation and turn and streamed: memory follows a window, not a
conversation, where the template appends only. The digest of a conversation's turns in
order is one running hash, so a conversation is one task by nature. Null texts and
roles are empty; a null turn comes first; equal turns go by role and text; rows of a
null conv_id are one conversation; an empty table gives none. Very long texts are held
one window at a time. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import os.path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import partitions

BLOCK = 32
START, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What marks turns in well-known templates, and may not stay as it is inside a text.
FOREIGN = ("[INST]", "[/INST]", "<s>", "</s>")


def escape(text: str) -> str:
    """No control string, own or foreign, is left; unescape() is its inverse."""
    return text.replace("\\", "\\\\").replace("<", "\\(").replace("[", "\\{")


def unescape(text: str) -> str:
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        out.append(text[at:k])
        out.append({"\\": "\\", "(": "<", "{": "["}[text[k + 1]])
        at = k + 2
    out.append(text[at:])
    return "".join(out)


def template(messages: list[dict]) -> str:
    return "".join(f"{START}{escape(m['role'])}{TEXT}{escape(m['content'])}{END}\n" for m in messages)


template.append_only = True


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of what template() made."""
    out = []
    for turn in formatted.split(START)[1:]:
        role, text = turn.split(TEXT)
        out.append((unescape(role), unescape(text[: text.index(END)])))
    return out


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


def spans(messages: list[dict], render) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """(output, [(turn start, content start, content end, turn end)], rewrites_history)."""
    outputs = [render(messages[:i]) if i else "" for i in range(len(messages) + 1)]
    ends, rewrites = [len(outputs[-1])] * (len(messages) + 1), False
    for i in range(len(messages) - 1, -1, -1):
        agreed = min(ends[i + 1], _common(outputs[i], outputs[i + 1]))
        rewrites |= agreed < len(outputs[i]) and not outputs[i + 1].startswith(outputs[i])
        ends[i] = agreed
    out = []
    for i, m in enumerate(messages):
        own = outputs[i + 1][ends[i] :]
        found = []
        for mark in ("x", "yy"):  # the content lies between what two other contents leave alike
            probe = render([*messages[:i], {**m, "content": mark}])[ends[i] :]
            found.append(probe)
        head = _common(found[0], found[1])
        tail = _common(found[0][head:][::-1], found[1][head:][::-1])
        begin, end = ends[i] + min(head, len(own)), ends[i] + max(min(head, len(own)), len(own) - tail)
        out.append((ends[i], begin, min(end, ends[i + 1]) if not rewrites else end, ends[i + 1]))
    return outputs[-1], out, rewrites


class _Conversation:
    def __init__(self, conv_id, render):
        self.conv_id, self.render = conv_id, render
        self.turns, self.held, self.carry = 0, [], None
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.loss_chars = self.chars = 0
        self.rewrites = False

    def add(self, role: str, text: str) -> None:
        self.held.append({"role": role, "content": text})
        if len(self.held) == BLOCK and getattr(self.render, "append_only", False):
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        window = ([self.carry] if self.carry else []) + self.held
        output, found, rewrites = spans(window, self.render)
        self.rewrites |= rewrites
        skip = 1 if self.carry else 0
        base = found[0][3] if skip else 0
        self.chars += len(output) - base
        for (role, text), (_, begin, end, _), _m in zip(parse(output)[skip:], found[skip:], self.held, strict=True):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                learned = unescape(output[begin:end])
                self.loss.update(learned.encode("utf-8", "surrogatepass"))
                self.loss_chars += len(learned)
        self.carry, self.held = self.held[-1], []

    def row(self) -> tuple:
        self.flush()
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.rewrites


_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]


def _stream(batches):
    now, key, done = None, None, []

    def table():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [()] * 7, _TYPES, strict=True)], names=_NAMES)

    for batch in batches:
        for added, conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("added", "conv_id", "role", "text")), strict=True):
            if now is None or (added, conv_id) != key:
                if now is not None:
                    done.append(now.row())
                now, key = _Conversation(conv_id, template), (added, conv_id)
            now.add(role, text)
        yield table()
        done = []
    if now is not None:
        done.append(now.row())
    yield table()


def _turns(conversations: DataFrame, added: bool) -> DataFrame:
    return conversations.select(F.lit(added).alias("added"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))


def digests(conversations: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """A row for each conversation, read back from its formatted output. Those of
    ``more`` are others, even where they have the same conv_id."""
    turns = _turns(conversations, False)
    turns = turns if more is None else turns.union(_turns(more, True))
    ordered = turns.repartition(partitions(turns), "added", "conv_id").sortWithinPartitions("added", F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(_stream, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")


def format_rows(conversations: DataFrame, *, render=template) -> DataFrame:
    """(conv_id, formatted, rewrites_history, loss_spans) with whole outputs, for
    conversations that fit into a row: loss_spans is a flat list of character
    ranges of assistant contents."""

    def run(batches):
        def row(key, messages):
            output, found, rewrites = spans(messages, render)
            loss = [x for m, f in zip(messages, found, strict=True) if m["role"] == "assistant" for x in f[1:3]]
            return key, output, rewrites, loss

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64())))], names=["conv_id", "formatted", "rewrites_history", "loss_spans"])

        held, key, any_yet = [], None, False
        for batch in batches:
            rows = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if any_yet and conv_id != key:
                    rows.append(row(key, held))
                    held = []
                key, any_yet = conv_id, True
                held.append({"role": role, "content": text})
            yield table(rows)
        if any_yet:
            yield table([row(key, held)])

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    ordered = turns.repartition(partitions(turns), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(run, "conv_id long, formatted string, rewrites_history boolean, loss_spans array<long>")


def extra(spark) -> DataFrame:
    """Conversation -1 of contract 10: both turns say what other templates use as control strings."""
    hard = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")


def report(conversations: DataFrame) -> DataFrame:
    """The columns of contract 10, and rewrites_history."""
    return digests(conversations, extra(conversations.sparkSession))


ORACLE = """
WITH t AS (
  SELECT 0 AS added, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT 1, -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), e AS (
  SELECT *, length(role) + length(text) + 24
    + (length(role) - length(replace(role, chr(92), ''))) + (length(role) - length(replace(role, '<', ''))) + (length(role) - length(replace(role, '[', '')))
    + (length(text) - length(replace(text, chr(92), ''))) + (length(text) - length(replace(text, '<', ''))) + (length(text) - length(replace(text, '[', ''))) AS size
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars, false AS rewrites_history
FROM e GROUP BY added, conv_id
"""
