"""Line deduplication by pairwise patience alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import arrow, cut, fresh, shared_filter

#: Words of a line, and places of which one begins a line: texts that share
#: LINE_WORDS + PLACES - 1 words in a row share a line.
LINE_WORDS, PLACES = 25, 8
#: Bytes of text that are hashed at once.
HASHED_BYTES = 1 << 18
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Lead bytes of the characters of scripts without spaces: a word each.
_ALONE = (np.arange(256) >= 0xE3) & (np.arange(256) <= 0xE9)
_BYTE = np.random.default_rng(7).integers(1, 1 << 64, 256, dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The powers 0 to n - 1 of a number modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        new = np.full(max(n, HASHED_BYTES + 2), base, np.uint64)
        new[0] = 1
        if len(new) > HASHED_BYTES * 4:  # a very long text: not kept
            return np.cumprod(new)
        _powers[base] = np.cumprod(new)
    return _powers[base][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashed(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of each of the stretches of ``values``, wherever they lie."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values)), out=sums[1:])
    return _mixed((sums[end] - sums[start]) * _power(pow(base, -1, 1 << 64), len(values) + 1)[start])


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and byte after the last, of each word: a run of anything but the
    six ASCII white-space characters, but an ideograph or a kana is a word itself."""
    space = _SPACE[buf]
    edge = np.diff(space, prepend=True, append=True)
    if len(buf) and buf.max() >= 0xE3:
        alone = np.flatnonzero(_ALONE[buf])
        if len(alone):
            edge[alone] = edge[np.minimum(alone + 3, len(buf))] = True
            at = np.flatnonzero(edge)
            solid = ~space[at[:-1]]
            return at[:-1][solid], at[1:][solid]
    at = np.flatnonzero(edge)
    return at[::2], at[1::2]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, and the text each is of."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    start, end = word_bounds(buf)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    of = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, ends), prepend=0))
    return _hashed(_BYTE[buf], start, end, _BASES[0]), of


def _long_hashes(text: bytes) -> np.ndarray:
    """The word hashes of a long text, by parts that end at white space."""
    out, at = [], 0
    while at < len(text):
        to = at + HASHED_BYTES
        while to < len(text) and not _SPACE[text[to]]:
            to += 1
        out.append(word_hashes([text[at:to]])[0])
        at = to
    return np.concatenate(out)


def _slices(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the first text, hashes of words and their texts, by HASHED_BYTES."""
    some: list[bytes] = []
    size = at = 0
    for i, t in enumerate(texts):
        t = t or b""
        if some and size + len(t) > HASHED_BYTES:
            yield at, *word_hashes(some)
            some, size, at = [], 0, i
        if len(t) > HASHED_BYTES:
            h = _long_hashes(t)
            yield i, h, np.zeros(len(h), np.int64)
            at = i + 1
            continue
        some.append(t)
        size += len(t)
    if some:
        yield at, *word_hashes(some)


def lines_in(words: np.ndarray, of: np.ndarray, n: int = LINE_WORDS, places: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    """The word at which each line begins, and its hash. In each text, of ``places``
    neighbouring places (fewer at its ends) the one whose ``n`` words have the
    least hash, the last of equal ones, begins a line. The m-th occurrence of a
    line in a text has another hash than the first."""
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(words) - n + 1)
    h = _hashed(words, at, at + n, _BASES[1])
    inside = of[: len(h)] == of[n - 1 :]
    top = np.uint64((1 << 64) - 1)
    h[~inside] = top
    low = np.concatenate([np.full(places - 1, top), h, np.full(places - 1, top)])
    place = np.arange(len(low))
    have = 1
    while have < places:
        step = min(have, places - have)
        right = low[step:] <= low[:-step]
        low, place = np.where(right, low[step:], low[:-step]), np.where(right, place[step:], place[:-step])
        have += step
    place = place[np.diff(place, prepend=-1) > 0] - (places - 1)
    place = place[(place >= 0) & (place < len(h))]
    place = place[inside[place]]
    h, doc = h[place], of[place]
    order = np.lexsort((h, doc))
    same = np.zeros(len(order), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    if same.any():
        count = np.arange(len(order))
        nth = np.empty(len(order), np.uint64)
        nth[order] = count - np.maximum.accumulate(np.where(same, 0, count))
        h = np.where(nth > 0, _mixed(h + nth * np.uint64(_BASES[0])), h)
    return place, h


def _short(words: np.ndarray) -> np.ndarray:
    """16 bits of each word's hash, none of them 0."""
    return np.maximum(words >> np.uint64(48), 1).astype(np.uint16)


def _key(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of a place in a text."""
    return _mixed(doc.astype(np.int64).view(np.uint64) * np.uint64(_BASES[0]) + at.astype(np.int64).view(np.uint64) * np.uint64(_BASES[1]))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some texts after others (columns doc_id, t, text): the document of each line,
    the hash of its text and its place (as one number), its hash, its first word,
    the hashes of all words and the text each is of."""
    for b in batches:
        ids, marks = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
        for first, words, of in _slices(b.column(2).to_pylist()):
            place, h = lines_in(words, of)
            row = first + of[place]
            at = (marks[row] << 32) | (place - np.searchsorted(of, of[place], "left"))
            yield ids.take(pa.array(row)), at, h, place, words, of


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, _, h, *_ in _lines(batches):
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids], names=["h", "doc_id"])


def _place_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, at, h, *_ in _lines(batches):
            held = np.flatnonzero(shared.holds(h))
            yield pa.RecordBatch.from_arrays([pa.array(h[held].view(np.int64)), ids.take(pa.array(held)), pa.array(at[held])], names=["h", "doc_id", "at"])

    return run


def _side_batches(asked):
    """(key, side): PLACES words before and after the lines at the places asked for, 0
    beyond the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, at, _, place, words, of in _lines(batches):
            key = _key(ids.to_numpy(zero_copy_only=False), at)
            held = np.flatnonzero(asked.holds(key))
            place = place[held]
            begin, end = (np.searchsorted(of, of[place], x)[:, None] for x in ("left", "right"))
            near = place[:, None] + np.concatenate([np.arange(-PLACES, 0), np.arange(LINE_WORDS, LINE_WORDS + PLACES)])
            some = _short(words[np.clip(near, 0, max(0, len(words) - 1))]) if len(place) else np.zeros((0, 2 * PLACES), np.uint16)
            side = np.where((near >= begin) & (near < end), some, np.uint16(0))
            packed = pa.array([x.tobytes() for x in side], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key[held].view(np.int64)), packed], names=["key", "side"])

    return run


def patience(other: np.ndarray) -> np.ndarray:
    """The indexes of a longest increasing run of ``other`` (distinct numbers), by piles."""
    if len(other) < 2 or (np.diff(other) > 0).all():
        return np.arange(len(other))
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for n, y in enumerate(other.tolist()):
        p = bisect_left(tops, y)
        back.append(last[p - 1] if p else -1)
        if p == len(tops):
            tops.append(y)
            last.append(n)
        else:
            tops[p], last[p] = y, n
    out, n = [], last[-1]
    while n >= 0:
        out.append(n)
        n = back[n]
    return np.array(out[::-1])


def align(pos: np.ndarray, other: np.ndarray) -> list[tuple[int, int, int]]:
    """The common blocks of a document and a partner, from their common lines at
    word ``pos`` and ``other``: ``(first line, last line, pass)``, by index.

    Lines occur once on either side (a repeated line by its number), so all are
    anchors of the patience diff: a longest run of lines in the order of both is
    aligned, overlapping neighbours at one distance make a block. What is left has
    moved; it is aligned again (the next pass), until no common line is left."""
    rest, turn, out = np.argsort(pos, kind="stable"), 0, []
    while len(rest):
        hit = patience(other[rest])
        i = rest[hit]
        new = np.ones(len(i), bool)
        new[1:] = (np.diff(other[i] - pos[i]) != 0) | (np.diff(pos[i]) > LINE_WORDS)
        start = np.flatnonzero(new)
        out += [(int(i[x]), int(i[y - 1]), turn) for x, y in zip(start, np.append(start[1:], len(i)), strict=True)]
        rest = np.delete(rest, hit)
        turn += 1
    return out


_BLOCK = {"a": pa.int32(), "b": pa.int32(), "o": pa.int64(), "other": pa.int64(), "turn": pa.int32(), "lk": pa.int64(), "rk": pa.int64()}
_BLOCKS = "array<struct<a:int,b:int,o:long,other:long,turn:int,lk:long,rk:long>>"


def _align_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blocks, counts = [], []
        col = b.column(2)
        bounds = col.offsets.to_numpy()
        flat = [col.values.field(i).to_numpy(zero_copy_only=False) for i in range(3)]
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            o, pos, there = (f[x:y] for f in flat)
            key = _key(o, there).view(np.int64)
            found = []
            for p in np.unique(o):
                k = np.flatnonzero(o == p)
                for i, j, turn in align(pos[k], there[k] & 0xFFFFFFFF):
                    i, j = k[i], k[j]
                    found.append({"a": pos[i], "b": pos[j] + LINE_WORDS, "o": p, "other": there[i] & 0xFFFFFFFF, "turn": turn, "lk": key[i], "rk": key[j]})
            blocks.append(sorted(found, key=lambda f: (f["a"], f["b"], f["o"])))
            counts.append(y - x)
        kind = pa.list_(pa.struct(list(_BLOCK.items())))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int32()), pa.array(blocks, kind)], names=["doc_id", "t", "n", "blocks"])


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    own = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return own.select(F.col(id_col).cast("long").alias("doc_id"), mark(text).alias("t"), text.cast("binary").alias("text"))


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, t, n, blocks array<struct<a, b, o, other, turn, lk, rk>>)`` for the texts
    that hold lines of an earlier document (smaller id): by id and hash of the text,
    the number of such lines, and the blocks of lines that align with partner ``o``,
    from word a to before word b, in the partner from word ``other``; ``lk`` and
    ``rk`` are keys of the partner's lines at both ends (see ``ends``).

    A line is ``LINE_WORDS`` words at a place that the words choose, wherever
    sentences and line ends are; white space doesn't count. A line is thus rare by
    itself. The first holder of a line stands for all, so a line costs one row for
    each document that holds it however many do, and none is capped; the partners
    of a document are the first holders of its lines. Lines of one document are
    held back by a filter before the second shuffle. The first holder is found by
    a minimum that is pre-aggregated; the join that distributes it has one row per
    line on the right, so adaptive execution may split a line of a third of all
    documents."""
    own = _own(docs, id_col, text_col)
    every = own.transform(arrow, _hash_batches, "h long, doc_id long")
    shared = shared_filter(every.groupBy("h").agg(F.min("doc_id").alias("o"), F.max("doc_id").alias("m")).where("o < m").select("h"))
    occ = own.transform(arrow, _place_batches(shared), "h long, doc_id long, at long")
    first = occ.groupBy(F.col("h").alias("g")).agg(F.min(F.struct("doc_id", "at")).alias("f"))
    pairs = occ.join(first.hint("merge"), F.col("h") == F.col("g")).where(F.col("doc_id") > F.col("f.doc_id"))
    line = F.struct(F.col("f.doc_id").alias("o"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"), F.col("f.at").alias("there"))
    each = pairs.groupBy("doc_id", F.shiftright("at", 32).alias("t")).agg(F.collect_list(line).alias("lines"))
    return each.transform(arrow, _align_batches, f"doc_id long, t long, n int, blocks {_BLOCKS}")


def ends(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, found array<struct<t, n, a, b, o, turn, left, right>>)``: the blocks of
    ``found`` (as from ``blocks``) of each document, with the PLACES words before
    and after them in the partner, 16 bits each. A run goes on for fewer beyond its
    last line, so what is compared with these finds where the equal words end: every
    run of LINE_WORDS + PLACES - 1 words that an earlier document holds goes, shorter
    ones where they hold a line; only where the first holder of the line at an end
    goes on differently than another holder, up to PLACES - 1 words may stay there.

    Only lines asked for, found by a filter of their places, are shuffled."""
    rows = found.select("doc_id", "t", "n", F.explode("blocks").alias("k")).select("doc_id", "t", "n", "k.*")
    asked = shared_filter(rows.select(F.explode(F.array("lk", "rk")).alias("h")))
    sides = _own(docs, id_col, text_col).transform(arrow, _side_batches(asked), "key long, side binary").dropDuplicates(["key"])
    left = sides.select(F.col("key").alias("lk"), F.substring("side", 1, 2 * PLACES).alias("left"))
    right = sides.select(F.col("key").alias("rk"), F.substring("side", 2 * PLACES + 1, 2 * PLACES).alias("right"))
    told = rows.join(left.hint("merge"), "lk", "left").join(right.hint("merge"), "rk", "left")
    return told.groupBy("doc_id").agg(F.collect_list(F.struct("t", "n", "a", "b", "o", "turn", "left", "right")).alias("found"))


def mark(text):
    """31 bits of the hash of a text, by which texts under one id are told apart."""
    return F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1))


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """``text`` without the words in ``spans`` (from word a to before word b, in any
    order), and the number of words that went. Of the white space around a
    deletion that before it stays, or that after it if only it holds a line end;
    white space at the ends of the text stays."""
    raw = text.encode("utf-8", "surrogatepass")
    start, end = word_bounds(np.frombuffer(raw, np.uint8))
    n, gone, low, out = len(start), 0, 0, []
    merged: list[list[int]] = []
    for a, b in sorted((a, min(b, n)) for a, b in spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        elif a < b:
            merged.append([a, b])
    for a, b in merged:
        gone += b - a
        if a == 0:
            out.append(raw[: start[0]])
        elif b == n:
            out.append(raw[low : end[a - 1]])
        else:
            before, after = raw[end[a - 1] : start[a]], raw[end[b - 1] : start[b]]
            out.append(raw[low : end[a - 1]] + (after if b"\n" in after and b"\n" not in before else before))
        low = start[b] if b < n else end[n - 1]
    out.append(raw[low:])
    return b"".join(out).decode("utf-8", "surrogatepass"), gone


def _beyond(own: np.ndarray, theirs: bytes | None) -> int:
    """Equal words from the start of both."""
    side = np.frombuffer(theirs or b"", np.uint16)[: len(own)]
    same = own[: len(side)] == side
    return len(side) if same.all() else int(same.argmin())


def _rebuilt(text: pd.Series, t: pd.Series, found: pd.Series) -> pd.DataFrame:
    out = []
    for x, h, sets in zip(text, t, found, strict=True):
        mine = [s for s in ([] if x is None or sets is None else sets) if s["t"] == h]
        if not mine:
            out.append((x, 0, 0, 0, 0, 0))
            continue
        raw = x.encode("utf-8", "surrogatepass")
        words = _short(_long_hashes(raw))
        spans = []
        for r in mine:
            a, b = int(r["a"]), int(r["b"])
            back = np.frombuffer(r["left"] or b"", np.uint16)[::-1].tobytes()
            spans.append((a - _beyond(words[max(0, a - PLACES) : a][::-1], back), b + _beyond(words[b : b + PLACES], r["right"])))
        new, gone = without(x, spans)
        out.append((new, int(mine[0]["n"]), gone, len(mine), sum(r["turn"] > 0 for r in mine), len({r["o"] for r in mine})))
    return pd.DataFrame(out, columns=["text", "lines", "words", "blocks", "moved", "partners"])


_LOST = {"lines": "int", "words": "long", "blocks": "int", "moved": "int", "partners": "int"}


def dedup_flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """All rows and columns of ``docs``, the text without the blocks that align with
    earlier documents, and a struct column ``(lines, words, blocks, moved, partners)``
    of what went, whose name, the second result, no column of ``docs`` has.

    Only changed texts go to Python; the texts are shuffled once, by id.

    Null ids, null texts, empty and blank texts and texts of fewer than LINE_WORDS
    words stay as they are. Rows with one id are one place in the order: neither
    is earlier, each is judged by its own text; equal rows fare alike. Of equal
    lines the smallest id keeps its own. A very long text is hashed by parts; it
    takes about 60 bytes a word of a worker. An empty table gives none. Other
    columns are untouched, whatever their names."""
    found = cut(ends(docs, cut(blocks(docs, id_col, text_col)), id_col, text_col))
    lost, key, sets, new = (fresh(docs, x) for x in ("lost", "key", "sets", "new"))
    both = docs.join(found.select(F.col("doc_id").alias(key), F.col("found").alias(sets)), F.col(id_col).cast("long") == F.col(key), "left")
    changed = F.col(sets).isNotNull() & F.col(text_col).isNotNull()
    text = F.col(text_col).cast("string")
    rebuild = F.pandas_udf(_rebuilt, "text string, " + ", ".join(f"{k} {v}" for k, v in _LOST.items()))
    both = both.withColumn(new, F.when(changed, rebuild(F.when(changed, text), mark(text), F.col(sets))))
    cols = [F.when(changed, F.col(new)["text"]).otherwise(F.col(c)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    one = F.when(changed, F.struct(*[F.col(new)[k].cast(v).alias(k) for k, v in _LOST.items()]))
    return both.select(*cols, one.alias(lost)), lost


def dedup(docs: DataFrame) -> DataFrame:
    """The documents after deletion, same columns (``n_chars`` counted again). A
    document of which only blanks are left goes; one blank from the start stays."""
    out, lost = dedup_flagged(docs)
    words = F.coalesce(F.col(lost)["words"], F.lit(0))
    out = out.where(~((words > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(words > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    """Per document what was deleted (lines held by an earlier document, words, blocks,
    those of them that had moved, and the documents it was aligned with), and the
    digest of what is left. See ``dedup_flagged`` for odd rows; a null text is
    left as an empty one, and a row with a null id keeps its text."""
    out, lost = dedup_flagged(docs.select("doc_id", "text"))
    n = lambda k: F.coalesce(F.col(lost)[k], F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        n("lines").alias("removed_lines"),
        n("words").alias("removed_words"),
        n("blocks").alias("n_blocks"),
        n("moved").alias("n_moved"),
        n("partners").alias("n_partners"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
