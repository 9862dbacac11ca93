"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.llm.common import arrow

#: Candidates of a tile and queries of a block; at 64 components 4 and 1 MB.
TILE, BLOCK = 8192, 2048
#: Lists that are merged into one at each level of the tree.
FAN = 16
_PACKED = "dim int, n int, ids binary, nths binary, vectors binary"


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """``(vec_id, v array<double>)``: floor(scale * x) of each component as double, a
    whole number. Null ids and vectors, and vectors with a null component or one that
    isn't finite once scaled, are left out; empty vectors stay. Only the two columns
    named are read."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") * F.lit(scale))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    picked = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    whole = F.transform("v", lambda x: F.when(F.abs(x) < F.lit(float(1 << 53)), F.floor(x).cast("double")).otherwise(x))
    return picked.select("vec_id", whole.alias("v"))


def _pack(size: int):
    """Rows into matrices of up to ``size`` vectors of one length, by id."""

    def emit(dim: int, ids: list[np.ndarray], nths: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
        i, n, m = np.concatenate(ids), np.concatenate(nths), np.concatenate(vectors)
        order = np.lexsort((n, i))
        cols = [pa.array([dim], pa.int32()), pa.array([len(i)], pa.int32()), *(pa.array([np.ascontiguousarray(x[order]).tobytes()], pa.binary()) for x in (i, n, m))]
        return pa.RecordBatch.from_arrays(cols, names=["dim", "n", "ids", "nths", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        for b in batches:
            ids, nths, col = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            dims = np.diff(col.offsets.to_numpy())
            flat = col.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(dims)])[:-1]
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                m = flat[starts[rows][:, None] + np.arange(d)[None, :]] if d else np.empty((len(rows), 0))
                for at in range(0, len(rows), size):
                    some = rows[at : at + size]
                    mine = held.setdefault(int(d), ([], [], []))
                    for kept, new in zip(mine, (ids[some], nths[some], m[at : at + size]), strict=True):
                        kept.append(new)
                    if sum(map(len, mine[0])) >= size:
                        yield emit(int(d), *held.pop(int(d)))
        for d, mine in held.items():
            yield emit(d, *mine)

    return run


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers (as doubles), exact: by floating point
    where no sum can reach 2^53, else by Python's integers, held within 64 bits."""
    top = lambda m: float(np.abs(m).max(initial=0))
    if top(q) * top(c) * max(1, q.shape[1]) < 1 << 53:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(c).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def top_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest of a row of scores, ties to the first."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > kth)
        return np.sort(np.concatenate([above, np.flatnonzero(scores == kth)[: k - len(above)]]))
    return np.arange(len(scores))


def select(s: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores of each row, ties to the first column;
    column ``own`` of a row (-1: none) is left out. A row without ties at the k-th
    is selected with the others at once."""
    has = np.flatnonzero(own >= 0)
    n = s.shape[1]
    if n > k + 1:
        low = s[has, own[has]].copy()
        s[has, own[has]] = np.iinfo(np.int64).min
        kth = np.partition(s, n - k, axis=1)[:, n - k]
        over = s >= kth[:, None]
        plain = over.sum(axis=1) == k
        rows, cols = np.nonzero(over & plain[:, None])
        s[has, own[has]] = low
        rest = np.flatnonzero(~plain)
    else:
        rows, cols, rest = np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(len(s))
    more_rows, more_cols = [rows], [cols]
    for r in rest:
        open_ = np.delete(np.arange(n), own[r]) if own[r] >= 0 else np.arange(n)
        best = open_[top_of(s[r, open_], k)]
        more_rows.append(np.full(len(best), r))
        more_cols.append(best)
    return np.concatenate(more_rows), np.concatenate(more_cols)


def _search(k: int):
    names = ["query_id", "query_row", "part", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                qi, qn, ci, cn = (np.frombuffer(r[x], np.int64) for x in ("q_ids", "q_nths", "ids", "nths"))
                d = r["dim"]
                s = products(np.frombuffer(r["q_vectors"], np.float64).reshape(len(qi), d), np.frombuffer(r["vectors"], np.float64).reshape(len(ci), d))
                asks = np.flatnonzero(cn)
                where = dict(zip(zip(ci[asks].tolist(), cn[asks].tolist(), strict=True), asks.tolist(), strict=True))
                own = np.array([where.get(x, -1) for x in zip(qi.tolist(), qn.tolist(), strict=True)], np.int64)
                rows, cols = select(s, own, k)
                out = [qi[rows], qn[rows], np.full(len(rows), r["group"]), ci[cols], s[rows, cols]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

    return run


def search(queries: DataFrame, candidates: DataFrame, k: int = 10, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score, query_row)``: for each row of ``queries(vec_id,
    nth, v)`` its ``k`` largest inner products with ``candidates(vec_id, nth, v)`` of
    the same length, ties to the smaller id, from rank 1. Its own row, the candidate
    of its id and ``nth`` (0: of no query), is left out, other rows with its id aren't;
    ``query_row`` is the query's ``nth``. Fewer than ``k`` candidates: all of them.
    Either table empty: no rows. Scores beyond 64 bits are held at its ends.

    Candidates are packed where they lie into tiles, queries into blocks; every
    block meets every tile in one matrix product with a partial selection. Tiles
    are dealt to groups, blocks are sent to each group, so neither side is ever
    whole in one place. The lists of a query are merged by a tree: those of a task,
    then FAN groups at each level, until one is left; each task cuts its own to ``k``
    before the shuffle (window group limit)."""
    spark = queries.sparkSession
    n = queries.count()
    groups = max(1, spark.sparkContext.defaultParallelism)
    packed = queries.repartition(-(-n // block) or 1).transform(arrow, _pack(block), _PACKED)
    blocks = packed.select(*(F.col(x).alias(f"q_{x}") for x in ("dim", "ids", "nths", "vectors")), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("q_group"))
    tiles = candidates.transform(arrow, _pack(tile), _PACKED).withColumn("group", F.pmod(F.xxhash64("ids", "nths"), F.lit(groups)).cast("int"))
    met = tiles.join(blocks, (F.col("group") == F.col("q_group")) & (F.col("dim") == F.col("q_dim")))
    lists = met.select("dim", "group", "ids", "nths", "vectors", "q_ids", "q_nths", "q_vectors").transform(arrow, _search(k), "query_id long, query_row long, part long, vec_id long, score long")
    while True:
        groups = -(-groups // FAN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN))
        of = Window.partitionBy("query_id", "query_row", *["part"] * (groups > 1)).orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(of)).where(F.col("rank") <= k)
        if groups == 1:
            return lists.select("query_id", "rank", "vec_id", "score", "query_row")


def op5_topk(table: DataFrame) -> DataFrame:
    """The query's rows: queries are the rows whose id is divisible by 100. Rows that
    repeat such an id are queries of their own, told apart by ``query_row`` (1 for the
    smallest vector), and candidates of each other; equal rows too. See
    ``valid_vectors`` and ``search`` for other odd rows."""
    v = valid_vectors(table)
    asks = F.col("vec_id") % 100 == 0
    q = v.where(asks).withColumn("nth", F.row_number().over(Window.partitionBy("vec_id").orderBy("v")).cast("long")).select("vec_id", "nth", "v")
    return search(q, v.where(~asks).select("vec_id", F.lit(0).cast("long").alias("nth"), "v").unionByName(q))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (
  SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS nth FROM v
), s AS (
  SELECT q.vec_id AS query_id, q.nth AS query_row, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM n q JOIN n c ON q.vec_id % 100 = 0 AND (q.vec_id <> c.vec_id OR q.nth <> c.nth) AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, query_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score, query_row FROM s
)
SELECT query_id, rank, vec_id, score, query_row FROM r WHERE rank <= 10
"""
