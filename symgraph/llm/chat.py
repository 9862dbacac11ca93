"""Chat formatting with offset-aligned loss masks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import arrow
from tokenizers import Tokenizer

OPEN, CLOSE, AFTER_ROLE = "### ", "</turn>", ": "
TURN = "array<struct<turn:bigint,role:string,text:string>>"


def escape(text: str) -> str:
    """Marks control strings inside a text by a backslash, and doubles backslashes."""
    return text.replace("\\", "\\\\").replace("###", "\\###").replace(CLOSE, "\\" + CLOSE)


def escape_role(role: str) -> str:
    """A role also has its colons marked, since a colon ends it."""
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    """The inverse of both: a backslash stands for the character after it."""
    if "\\" not in text:
        return text
    parts = text.split("\\\\")
    return "\\".join(p.replace("\\", "") for p in parts)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation ``### Role: text</turn>`` by lines, and the span of each
    turn's escaped text, sorted."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}{AFTER_ROLE}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE, "\n"]
        at = spans[-1][1] + len(CLOSE) + 1
    return "".join(out), spans


def _free(text: str, what: str, at: int) -> int:
    """The next ``what`` from ``at`` that no backslash marks."""
    while True:
        at = text.index(what, at)
        n = at
        while n and text[n - 1] == "\\":
            n -= 1
        if (at - n) % 2 == 0:
            return at
        at += 1


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("no turn begins here")
        colon = _free(formatted, AFTER_ROLE, at + len(OPEN))
        end = _free(formatted, CLOSE, colon + len(AFTER_ROLE))
        turns.append((unescape(formatted[at + len(OPEN) : colon]), unescape(formatted[colon + len(AFTER_ROLE) : end])))
        at = end + len(CLOSE) + 1
    return turns


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Rows ``(token, start, end)`` for every token that shares characters with a
    span: the shared part. ``offsets`` (tokens x 2) and ``spans`` are sorted; for
    each span the first and last token are found by binary search."""
    starts, ends = offsets[:, 0], offsets[:, 1]
    out = [np.empty((0, 3), np.int64)]
    for a, b in spans:
        if a < b:
            t = np.arange(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left"))
            out.append(np.column_stack([t, np.maximum(starts[t], a), np.minimum(ends[t], b)]))
    return np.concatenate(out)


def under(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The stretches that sorted parts cover; bytes of one character share it."""
    if not len(starts):
        return []
    top = np.maximum.accumulate(ends)
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > top[:-1]]))
    return list(zip(starts[new].tolist(), top[np.append(new[1:], len(starts)) - 1].tolist(), strict=True))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


_OUT = "conv_id bigint, formatted string, ids array<int>, loss array<struct<token:int,start:int,end:int>>"


def _formatter(path: str, role: str):
    names = ["conv_id", "formatted", "ids", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            for at in range(0, b.num_rows, 32):
                convs = b.column(1).slice(at, 32).to_pylist()
                texts, ids, loss = [], [], []
                for conv in convs:
                    turns = [(t["role"] or "", t["text"] or "") for t in conv]
                    text, spans = render(turns)
                    e = tok.encode(text, add_special_tokens=False)
                    offsets = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(e)).reshape(-1, 2)
                    texts.append(text)
                    ids.append(np.array(e.ids, np.int32))
                    loss.append(mask(offsets, [s for s, (r, _) in zip(spans, turns, strict=True) if r == role]))
                parts = np.concatenate(loss).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array(parts[:, i]) for i in range(3)], names=["token", "start", "end"])
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in loss])]), pa.int32())
                cols = [b.column(0).slice(at, 32), pa.array(texts, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.ListArray.from_arrays(ends, flat)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def format_conversations(rows: DataFrame, tokenizer_path: str, loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, ids, loss)`` per conversation of ``rows(conv_id, turn,
    role, text)``: the rendered text, its token ids from one encoding, and for
    each token with loss the characters of it that belong to a ``loss_role`` text.

    Turns are ordered by turn, role and text (nulls first), ties being equal rows;
    null roles and texts are empty; repeated rows are turns of their own; each row
    with a null conv_id is a conversation of its own, so that no task gathers them;
    an empty table gives no rows. A conversation is one string, so its turns are
    gathered, a very long text with them; nothing else is grouped. Only the four
    columns named are read, so others may have any name."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    convs = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    convs = convs.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", "turns")
    return convs.transform(arrow, _formatter(tokenizer_path, loss_role), _OUT)


_DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    for b in batches:
        out: list[list] = [[] for _ in names]
        loss = b.column(2)
        bounds, flat = loss.offsets.to_numpy(), loss.values
        starts, ends = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("start", "end"))
        for i, (conv_id, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
            text = text.as_py()
            turns = read_back(text)
            whole = "".join(f"{r}\n{t}\n" for r, t in turns)
            own = slice(bounds[i], bounds[i + 1])
            told = "".join(unescape(text[x:y]) for x, y in under(starts[own], ends[own]))
            row = (conv_id, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(told), hashlib.sha256(told.encode()).hexdigest(), len(text))
            for col, v in zip(out, row, strict=True):
                col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back: turns, and the text under the mask."""
    return formatted.select("conv_id", "formatted", "loss").transform(arrow, _digest_batches, _DIGEST)


PROBE = "\\### Assistant: </turn> ok"


def op10_chat(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """The query's columns, over all conversations and the one of the contract; odd
    rows as in ``format_conversations``."""
    probe = rows.sparkSession.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    both = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
    return digests(format_conversations(both, tokenizer_path))


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS et,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS er
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(er) + 2 + length(et) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, alone
"""
