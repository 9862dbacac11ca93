"""Upserts and deletes as new table versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.schema import EDGE_COLS, EDGE_KEY, NODE_COLS


def _pick(rows: DataFrame, key: Sequence[str], order: Sequence[str], best) -> DataFrame:
    """One row per key by the largest or smallest order; aggregated before the
    shuffle, so a hot key costs one row per task. Equal orders: by evidence-free
    content, i.e. the whole row."""
    rest = [c for c in rows.columns if c not in key]
    first = [c for c in order if c in rest]
    struct = F.struct(*first, *[c for c in rest if c not in first])
    got = rows.groupBy(*key).agg(best(struct).alias("_row"))
    return got.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def last_wins(rows: DataFrame, order: Sequence[str], key: Sequence[str] = EDGE_KEY) -> DataFrame:
    """The last written row of each key."""
    return _pick(rows, key, order, F.max)


def first_wins(rows: DataFrame, order: Sequence[str], key: Sequence[str] = EDGE_KEY) -> DataFrame:
    """The first written row of each key."""
    return _pick(rows, key, order, F.min)


def upsert(stored: DataFrame, rows: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``stored`` with ``rows`` (one per key) in place of those of equal key."""
    return stored.join(rows.select(*key), list(key), "left_anti").select(*columns).unionByName(rows.select(*columns))


def upsert_nodes(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(nodes, rows, ["id"], NODE_COLS)


def upsert_edges(edges: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(edges, rows, EDGE_KEY, EDGE_COLS)


def delete_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select(*EDGE_KEY), EDGE_KEY, "left_anti").select(*EDGE_COLS)


def delete_files(nodes: DataFrame, edges: DataFrame, hashes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without ``files(file)``. Edges that touch a node of these
    files go, those by an agent stay. Two anti-joins, since one with OR would be a
    nested loop; edges are matched against the nodes as they were."""
    gone = nodes.join(files.select("file").distinct(), "file", "left_semi").select(F.col("id").alias("_gone"))
    agent = edges.where("provenance_source = 'agent'")
    rest = edges.where("provenance_source <> 'agent'")
    rest = rest.join(gone, rest["source"] == gone["_gone"], "left_anti")
    rest = rest.join(gone, rest["target"] == gone["_gone"], "left_anti")
    kept = nodes.join(files.select("file").distinct(), "file", "left_anti").select(*NODE_COLS)
    return kept, agent.unionByName(rest).select(*EDGE_COLS), hashes.join(files.select("file").distinct(), "file", "left_anti")
