"""I-Match document fingerprints over randomised lexicon subsets."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from symgraph.llm.common import arrow, cut

#: Terms are hashed into this many cells; document frequencies are exact counts
#: per cell, and what all workers get is one bit per cell (4 MB).
CELLS = 1 << 25
#: The band: terms in at least this many documents, and in at most this share.
LEAST_DF, MOST_SHARE = 2, 0.01
#: Hash functions, and the classes of each that serve as lexicon subsets.
FUNCTIONS, CLASSES = 8, 16
#: Cells of a counting range; documents of an order range, of which there are
#: MAX_RANGES at most (8 MB of ids; ranges of more documents beyond it, which are
#: sorted and streamed, never held).
RANGE_CELLS, RANGE_DOCS, MAX_RANGES = 1 << 17, 2_000, 1 << 20


def terms(text: bytes) -> set[bytes]:
    """The distinct terms: words, A-Z lower-cased."""
    return set(text.lower().split())


def _cells(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))


def _df_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            if t:
                counts.update(terms(t))
        if len(counts) > 250_000:
            yield from _df_rows(counts)
            counts = Counter()
    yield from _df_rows(counts)


def _df_rows(counts: Counter[bytes]) -> Iterator[pa.RecordBatch]:
    """Counts by cell, packed: a row per range with its cells and their counts."""
    cells = (_cells(list(counts)) & np.uint64(CELLS - 1)).astype(np.int64)
    order = np.argsort(cells, kind="stable")
    cells, n = cells[order], np.fromiter(counts.values(), np.int64, len(counts))[order]
    ranges = np.unique(cells // RANGE_CELLS)
    bounds = np.searchsorted(cells, np.append(ranges * RANGE_CELLS, CELLS))
    low, n = (cells % RANGE_CELLS).astype(np.uint32), n.astype(np.uint32)
    spans = list(zip(bounds[:-1], bounds[1:], strict=True))
    cols = [pa.array(ranges.astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (low, n))]
    yield pa.RecordBatch.from_arrays(cols, names=["range", "cells", "counts"])


def _band_bits(least: int, most: int):
    """From packed counts, sorted by range, a bit per cell of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            bits = np.packbits((total >= least) & (total <= most), bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([bits], pa.binary())], names=["range", "bits"])

        at, total = None, np.zeros(RANGE_CELLS, np.int64)
        for b in batches:
            for r, cells, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if r != at:
                    if at is not None:
                        yield close()
                    at, total = r, np.zeros(RANGE_CELLS, np.int64)
                np.add.at(total, np.frombuffer(cells.as_py(), np.uint32), np.frombuffer(counts.as_py(), np.uint32))
        if at is not None:
            yield close()

    return run


def band(docs: DataFrame, text_col: str = "text", least: int = LEAST_DF, most: float = MOST_SHARE) -> np.ndarray:
    """A bit per cell: whether its document frequency (of all terms in the cell; with
    far more distinct terms than cells rare terms that share one come into the band), over all rows of ``docs``,
    lies in the band of ``least`` documents to a share ``most`` of them, that is,
    its inverse document frequency in ln(1/most) to ln(N/least). Counts are
    summed in the workers first, and travel packed by range of cells; a range is
    added up in an array of fixed size, and so is the result."""
    n = docs.count()
    packed = docs.select(F.col(text_col).cast("binary").alias("t")).transform(arrow, _df_batches, "range int, cells binary, counts binary")
    ordered = packed.repartition("range").sortWithinPartitions("range")
    rows = ordered.transform(arrow, _band_bits(least, max(least, math.floor(most * n))), "range int, bits binary").collect()
    bits = np.zeros(CELLS // 8, np.uint8)  # as much as comes to the driver
    for r in rows:
        at = r["range"] * RANGE_CELLS // 8
        bits[at : at + RANGE_CELLS // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits


class Lexicon:
    """The band, and its randomised subsets. At density 2^-l, each of FUNCTIONS
    hash functions cuts the lexicon into 2^l classes, of which the first CLASSES
    are subsets; so a term costs the same however many subsets there are."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.salts = np.array([xxh64_intdigest(f"function {s}", 9) for s in range(FUNCTIONS)], np.uint64)

    def keep(self, found: set[bytes]) -> np.ndarray:
        """Hashes of the terms within the band, sorted; none within: of all."""
        h = _cells(list(found))
        cell = (h & np.uint64(CELLS - 1)).astype(np.int64)
        inside = h[(self.bits[cell >> 3] >> (cell & 7)) & 1 == 1]
        return np.sort(inside if len(inside) else h)

    def subsets(self, h: np.ndarray, level: int) -> np.ndarray:
        """A hash for each subset at density 2^-level, 0 where it holds no term of
        the text: the sum over its sorted distinct terms of their mixed hashes, which
        stands for a hash of their sequence, since sorted terms have but one."""
        out = np.zeros(FUNCTIONS * CLASSES, np.uint64)
        m = h[None, :] ^ self.salts[:, None]
        m = (m ^ (m >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        m ^= m >> np.uint64(29)
        m *= np.uint64(0xBF58476D1CE4E5B9)
        m ^= m >> np.uint64(32)
        row, col = np.nonzero(m >> np.uint64(64 - level) < CLASSES) if level else np.nonzero(np.ones(m.shape, bool))
        some = m[row, col]
        cls = (some >> np.uint64(64 - level)).astype(np.int64) if level else 0
        np.add.at(out, row * CLASSES + cls, (some ^ np.uint64(0xD1B54A32D192ED03)) * np.uint64(0x94D049BB133111EB) | np.uint64(1))
        return out


class Print:
    """A text's terms within the band, and its subset hashes by density."""

    def __init__(self, lexicon: Lexicon, text: bytes):
        self.lexicon, self.h, self.tables = lexicon, lexicon.keep(terms(text)), {}
        self.n = len(self.h)

    def table(self, level: int) -> np.ndarray:
        if level not in self.tables:
            self.tables[level] = self.lexicon.subsets(self.h, level)
        return self.tables[level]

    @property
    def hex(self) -> str:
        """The fingerprint: the density and a digest of all subset hashes at it."""
        level = level_of(self.n)
        return f"{level:02x}-" + hashlib.sha256(self.table(level).tobytes() + self.n.to_bytes(8, "little")).hexdigest()[:32]


def level_of(n: int) -> int:
    """The density at which a subset holds a half to one of n terms on average, so
    that one changed term spoils few subsets."""
    return n.bit_length()


def likeness(a: Print, b: Print) -> float:
    """Share of equal hashes among the subsets that hold a term of either text, at
    the density that suits the larger; both without terms: 1."""
    if not a.n or not b.n:
        return float(a.n == b.n)
    level = level_of(max(a.n, b.n))
    x, y = a.table(level), b.table(level)
    some = (x != 0) | (y != 0)
    return float((x[some] == y[some]).mean()) if some.any() else float(a.n == b.n)


def edited(text: str, following: str) -> str:
    """``text``, its last quarter replaced by as much of the start of the next."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_terms, level, subsets array<long>)`` per row: the terms within the
    band, the density that suits their number, and a hash for each subset at it
    (0: the subset holds no term of the text). Documents match where subset hashes
    at one place and level are equal. Odd rows as in ``compare_neighbours``."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bits = docs.sparkSession.sparkContext.broadcast(band(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(bits.value)
        for b in batches:
            found = [Print(lexicon, (t or "").encode()) for t in b.column(1).to_pylist()]
            levels = [level_of(p.n) for p in found]
            subsets = [p.table(n).view(np.int64) for p, n in zip(found, levels, strict=True)]
            cols = [b.column(0), pa.array([p.n for p in found], pa.int64()), pa.array(levels, pa.int32()), pa.array(subsets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_terms", "level", "subsets"])

    return own.transform(arrow, run, "doc_id long, n_terms long, level int, subsets array<long>")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(shared):
    names = [x.split()[0] for x in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        last: tuple | None = None
        rows: list[tuple] = []
        for b in batches:
            for rid, extra, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is None and extra:
                    continue  # a repeated id at the boundary
                if last is not None and last[0] != rid:
                    raise ValueError("a range without the document after it")
                text = text or ""
                own = Print(lexicon, text.encode())
                if last is not None:
                    rows.append(_pair(lexicon, last, text, own))
                last = None if extra else (rid, doc_id, text, own)
                if len(rows) == 2000:
                    yield _batch(rows, names)
                    rows = []
        if last is not None:
            raise ValueError("a range without the document after it")
        yield _batch(rows, names)

    return run


def _pair(lexicon: Lexicon, last: tuple, text: str, own: Print) -> tuple:
    _, doc_id, mine, p = last
    new = edited(mine, text)
    raw = new.encode()
    q = p if new == mine else Print(lexicon, raw)
    return (doc_id, len(mine), hashlib.sha256(raw).hexdigest(), p.hex, q.hex, likeness(p, q), likeness(p, own))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def compare_neighbours(docs: DataFrame, range_docs: int = RANGE_DOCS) -> DataFrame:
    """Per row of ``docs(doc_id, text)`` its fingerprint, that of its edited text
    (see ``edited``) and their likeness, and the likeness to the next document's.

    Null texts are empty; null ids come after all others; repeated ids are ordered
    by text, equal rows in any order; a single document is its own next; an empty
    table gives no rows. A very long text is held whole by one worker, with its
    terms. Only the two columns are read, so others may have any name.

    The order is cut at exact ids into ranges of about ``range_docs`` documents.
    Each text is shuffled once, to its range; the first document of a range goes
    also to the one before (that of the first range to the last), so that every
    document meets its next."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = spark.sparkContext.broadcast(band(own))
    ids = cut(own.select("doc_id"))
    n = ids.count()
    if not n:
        return spark.createDataFrame([], _OUT)
    top = (1 << 63) - 1
    order = F.coalesce("doc_id", F.lit(top))
    parts = min(MAX_RANGES, max(1, -(-n // range_docs)))
    held = spark.sparkContext.broadcast(np.array(_cuts(ids.select(order.alias("o")), parts), np.int64))

    @F.pandas_udf("array<int>")
    def ranges_of(o: pd.Series) -> pd.Series:
        v, cuts = o.to_numpy(np.int64), held.value
        r = np.searchsorted(cuts, v, "right") - 1
        first = cuts[np.clip(r, 0, None)] == v
        return pd.Series([[int(a), int(a - 1) % len(cuts)] if f else [int(a)] for a, f in zip(r, first, strict=True)])

    spread = own.select(F.posexplode(ranges_of(order)).alias("extra", "rid"), "doc_id", "text")
    spread = spread.select("rid", (F.col("extra") == 1).alias("extra"), "doc_id", "text")
    ordered = spread.repartition("rid").sortWithinPartitions("rid", "extra", F.coalesce("doc_id", F.lit(top)), "text")
    return ordered.transform(arrow, _compare(bits), _OUT)


def _cuts(ids: DataFrame, parts: int) -> list[int]:
    """About ``parts`` ids that occur, the smallest first: every k-th of the sorted
    distinct ids, k being n / parts."""
    ranked = ids.distinct()
    n = ranked.count()
    step = max(1, n // parts)
    spread = cut(ranked.repartitionByRange("o").select("o", F.spark_partition_id().alias("p")))
    counts = {r.p: r.n for r in spread.groupBy("p").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    off = F.broadcast(spread.sparkSession.createDataFrame(offsets, "p int, off long"))
    at = F.row_number().over(Window.partitionBy("p").orderBy("o")) - 1 + F.col("off")
    return sorted(r.o for r in spread.join(off, "p").select("o", at.alias("at")).where(F.col("at") % step == 0).collect())


def op9_imatch(docs: DataFrame) -> DataFrame:
    """The query's columns; odd rows as in ``compare_neighbours``."""
    return compare_neighbours(docs)
