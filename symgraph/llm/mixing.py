"""Mixing sources to target weights by blocks, drawn counts and permutations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.llm.common import WORD, arrow, cut

#: Words of a block, block slots of an output shard, documents of a lane.
BLOCK, SHARD_SLOTS, LANE_DOCS = 512, 4096, 50_000
WEIGHTS, MAX_REPEAT = (5, 2, 1), 3
#: One row per source comes to the driver; more than this is refused.
MAX_SOURCES = 1_000_000
#: Sources of up to this number (about 100 bytes each) are broadcast.
BROADCAST_SOURCES = 10_000


def targets(sizes: list[int], weights: list[int], repeat: int = MAX_REPEAT) -> list[float]:
    """Shares of sum(sizes) by weight; none above ``repeat`` times its size, the
    excess reshared by weight among the others until none is above."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(repeat * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        if not weight:
            break
        over = [i for i, w in enumerate(weights) if i not in capped and w * rest > repeat * sizes[i] * weight]
        if not over:
            break
        capped.update(over)
    return [float(repeat * s) if i in capped else float(Fraction(weights[i] * rest, weight)) for i, s in enumerate(sizes)]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _feistel(x: np.ndarray, half: int, keys: list[int], back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left, k) & mask), left
        else:
            left, right = right, left ^ (_mix(right, k) & mask)
    return left << np.uint64(half) | right


def permute(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 (or its inverse) at ``index``: a
    four-round Feistel network over the next even power of two, walked along
    until it lands within n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    keys = [xxhash.xxh64_intdigest(f"{key}:{r}", 0) for r in range(4)]
    with np.errstate(over="ignore"):
        out = _feistel(index.astype(np.uint64), half, keys, back)
        while (far := out >= np.uint64(n)).any():
            out[far] = _feistel(out[far], half, keys, back)
    return out.astype(np.int64)


def _key(seed: int, sid: int, epoch: int) -> int:
    return xxhash.xxh64_intdigest(f"{seed}/{sid}/{epoch}", 7)


def slots_needed(size: int, words: int, block: int, seed: int, sid: int) -> tuple[int, int]:
    """Slots that give ``words`` words of a source of ``size``, and the words that
    the last of them takes: whole passes over its blocks, then blocks in the order
    of the next permutation, the last one cut short."""
    if not size or not words:
        return 0, 0
    nb = -(-size // block)
    short = nb * block - size
    passes, rest = divmod(words, size)
    if not rest:
        return passes * nb, block - (short if int(permute(np.array([nb - 1]), nb, _key(seed, sid, passes - 1))[0]) == nb - 1 else 0)
    at = int(permute(np.array([nb - 1]), nb, _key(seed, sid, passes), back=True)[0])
    n = -(-rest // block)
    if n > at:
        n = max(at + 1, -(-(rest + short) // block))
    before = (n - 1) * block - (short if n - 1 > at else 0)
    return passes * nb + n, rest - before


def _draws(quota: list[int], shards: int, slots: int, seed: int):
    """Multinomial counts per source of each shard, from a generator of its own."""
    p = np.array(quota, float)
    p /= p.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h in b.column(0).to_pylist():
                n = np.random.default_rng([seed, h]).multinomial(slots, p)
                some = np.flatnonzero(n)
                cols = [pa.array(np.full(len(some), h), pa.int64()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "sid", "n"])

    return run


def _place(blocks: list[int], quota: list[int], last: list[int], block: int, sizes: list[int], seed: int):
    """From (shard, sid, k), the k-th slot of a source, to its block and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, k = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            at, words, epoch = (np.zeros(len(k), np.int64) for _ in range(3))
            for s in np.unique(sid):
                mine = np.flatnonzero(sid == s)
                nb = blocks[s]
                e, j = np.divmod(k[mine], nb)
                epoch[mine] = e
                for x in np.unique(e):
                    here = mine[e == x]
                    at[here] = permute(j[e == x], nb, _key(seed, int(s), int(x)))
                words[mine] = np.where(k[mine] == quota[s] - 1, last[s], np.where(at[mine] == nb - 1, sizes[s] - (nb - 1) * block, block))
            cols = [b.column(0), b.column(1), pa.array(epoch, pa.int32()), pa.array(at), pa.array(words)]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "sid", "epoch", "block", "words"])

    return run


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 20, ranges: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, thash, source, size, source_size,
    target, taken, shards)``, with ``ranges`` also the taken word ranges
    ``array<struct<shard, epoch, first, n>>``; ``shards`` are the output shards, in
    order, that take words of it.

    The words of a source form one stream of documents, cut into blocks of
    ``block`` words. A source takes round(target) words in slots of one block. Each
    output shard draws how many of its slots a source gets (multinomial counts by
    the sources' shares); what the draws miss or exceed of a source's slots is
    settled in a last shard, so that sources meet their targets. The k-th slot of
    a source, in the order of the shards, is mapped by a permutation of its blocks,
    a new one for each pass, and joined with the documents of that block: the
    draws decide in which shard the words of a document come.

    Null and blank texts have size 0 and give nothing; null sources form a source
    of their own, last; rows with a null id and repeated rows are documents of
    their own (of equal rows any may be the one that is taken); an empty table
    gives no rows; a very long text spans many blocks. Only the three columns named
    are read, so others may have any name.

    A source's stream is numbered by lanes of about LANE_DOCS documents (hash of
    id and text), so a source with a third of all rows is still many groups.
    """
    spark = docs.sparkSession
    each = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(text_col).alias("thash"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
    )
    per = each.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    rows = per.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes, n_docs = [r["size"] for r in rows], sum(r.n for r in rows)
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    need = [slots_needed(s, round(t), block, seed, i) for i, (s, t) in enumerate(zip(sizes, goal, strict=True))]
    quota, last, blocks = [n for n, _ in need], [w for _, w in need], [max(1, -(-s // block)) for s in sizes]

    table = spark.createDataFrame([(i, r.source, r["size"], g) for i, (r, g) in enumerate(zip(rows, goal, strict=True))], "sid int, source string, source_size long, target double")
    if len(rows) <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    lanes = -(-n_docs // LANE_DOCS) or 1
    t = table.select("sid", F.col("source").alias("_s"))
    base = each.join(t, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "thash", "size", "sid", F.pmod(F.xxhash64("doc_id", "thash"), F.lit(lanes)).alias("lane"))
    w = Window.partitionBy("sid", "lane").orderBy("doc_id", "thash").rowsBetween(Window.unboundedPreceding, 0)
    base = base.select("*", (F.sum("size").over(w) - F.col("size")).alias("within"), F.row_number().over(w).alias("rn"))
    before = base.groupBy("sid", "lane").agg(F.sum("size").alias("s"))
    before = before.select("sid", "lane", (F.sum("s").over(Window.partitionBy("sid").orderBy("lane")) - F.col("s")).alias("off"))
    placed = base.join(before, ["sid", "lane"]).withColumn("start", F.col("off") + F.col("within"))
    spans = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    spread = placed.select("*", F.explode_outer(spans).alias("block"))

    total = sum(quota)
    if total:
        shards = -(-total // SHARD_SLOTS)
        drawn = spark.range(shards).transform(arrow, _draws(quota, shards, min(SHARD_SLOTS, total), seed), "shard long, sid int, n long")
        due = spark.createDataFrame([(shards, i, q, q) for i, q in enumerate(quota) if q], "shard long, sid int, n long, quota long")
        due = F.broadcast(due) if len(rows) <= BROADCAST_SOURCES else due
        drawn = drawn.join(due.select("sid", "quota"), "sid").select("shard", "sid", "n", "quota").unionByName(due)
        first = F.sum("n").over(Window.partitionBy("sid").orderBy("shard")) - F.col("n")
        drawn = drawn.select("shard", "sid", first.alias("first"), F.least(F.col("n"), F.col("quota") - first).alias("n")).where("n > 0")
        slots = drawn.repartition("shard", "sid").select("shard", "sid", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("k"))
        slots = slots.transform(arrow, _place(blocks, quota, last, block, sizes, seed), "shard long, sid int, epoch int, block long, words long")
    else:
        slots = spark.createDataFrame([], "shard long, sid int, epoch int, block long, words long")
    # what the planner expects of generated slots is far too little: it must not broadcast them
    joined = spread.join(slots.hint("merge"), ["sid", "block"], "left")
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    n = F.when(F.col("words").isNotNull(), F.greatest(high - low, F.lit(0))).otherwise(F.lit(0))
    joined = joined.select("sid", "lane", "rn", "doc_id", "thash", "size", "shard", "epoch", (low - F.col("start")).alias("first"), n.alias("n"))
    found = [F.sum("n").alias("taken"), F.sort_array(F.collect_set(F.when(F.col("n") > 0, F.col("shard")))).alias("shards")]
    if ranges:
        found.append(F.collect_list(F.when(F.col("n") > 0, F.struct("shard", "epoch", "first", "n"))).alias("ranges"))
    out = joined.groupBy("sid", "lane", "rn", "doc_id", "thash", "size").agg(*found)
    return out.join(table, "sid").select("doc_id", "thash", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "shards", *["ranges"] * ranges)


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def pieces(text: str, size: int, ranges: list[dict]) -> list[tuple[int, str]]:
    """A text with its shard for each shard and pass that takes words: whole where
    all are taken, else the taken stretches in order, joined by a line end."""
    out, spans = [], None
    by: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in ranges:
        by.setdefault((r["shard"], r["epoch"]), []).append((r["first"], r["first"] + r["n"]))
    for (shard, _), mine in sorted(by.items()):
        mine.sort()
        if sum(b - a for a, b in mine) == size:
            out.append((shard, text))
            continue
        spans = spans or [m.span() for m in _WORDS.finditer(text)]
        merged: list[list[int]] = []
        for a, b in mine:
            if merged and merged[-1][1] == a:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        out.append((shard, "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in merged)))
    return out


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = 20) -> DataFrame:
    """The mix as documents, columns as in ``docs``, whole shards in each partition:
    a row for each shard and pass that takes words of a document (whole, or cut to
    them, ``n_chars`` counted again). Documents without words have nothing to give
    and go; for other odd rows see ``plan``. Texts are shuffled by id and text,
    then by shard. Columns travel in a struct, so they may have any name."""
    names = docs.columns
    p = plan(docs, block=block, seed=seed, ranges=True).select(
        F.coalesce(F.col("doc_id").cast("long"), F.col("thash")).alias("pkey"), F.col("thash").alias("phash"), "source", "size", "taken", "ranges"
    )
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    thash = F.xxhash64("text")
    d = docs.select(own.alias("doc"), thash.alias("thash"), F.coalesce(F.col("doc_id").cast("long"), thash).alias("key"), F.col("source").cast("string").alias("from"))
    # numbered with the rows that give nothing
    p = p.withColumn("pord", F.row_number().over(Window.partitionBy("pkey", "phash").orderBy("source"))).where("taken > 0")
    d = d.withColumn("ord", F.row_number().over(Window.partitionBy("key", "thash").orderBy("from")))
    # the ordinal is no join key, so that the rows stay where the window put them
    both = d.join(p, (F.col("key") == F.col("pkey")) & (F.col("thash") == F.col("phash")) & (F.col("ord") - F.col("pord") == 0))
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None
    kind = "shard long, " + ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column(0)
            cols = doc.flatten()
            take, shards, texts, held = [], [], [], 0
            for i, (t, size, ranges) in enumerate(zip(cols[at].to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for shard, some in pieces(t or "", size, ranges):
                    take.append(i)
                    shards.append(shard)
                    texts.append(some)
                    held += len(some)
                    if held > 1 << 24:  # copies of very long texts go out at once
                        yield _rows(cols, take, shards, texts, at, count)
                        take, shards, texts, held = [], [], [], 0
            yield _rows(cols, take, shards, texts, at, count)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = both.select("doc", "size", "ranges").transform(arrow, run, kind).repartitionById(parts, (F.col("shard") % parts).cast("int"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def _rows(own: list[pa.Array], take: list[int], shards: list[int], texts: list[str], at: int, count: int | None) -> pa.RecordBatch:
    index, text = pa.array(take, pa.int64()), pa.array(texts, pa.string())
    cols = [c.take(index) if i not in (at, count) else text for i, c in enumerate(own)]
    if count is not None:
        cols[count] = pc.cast(pc.utf8_length(text), own[count].type)
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), *cols], names=["shard", *(f"c{i}" for i in range(len(cols)))])


def op6_mixing(docs: DataFrame) -> DataFrame:
    """The query's columns; odd rows as in ``plan``."""
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")
