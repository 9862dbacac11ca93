"""Index plans, counters, anchors and staleness over file tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions import anchor, is_stale


def index_plan(current: DataFrame, stored: DataFrame) -> DataFrame:
    """``(file, hash, action)``: new, changed, unchanged or error for each file of
    ``current(file, content, error)``, removed for stored files that are away. A
    file that can't be read still counts as present."""
    c = current.select("file", F.sha2("content", 256).alias("hash"), F.col("error").isNotNull().alias("bad"))
    s = stored.select("file", F.col("hash").alias("old"))
    action = F.when(F.col("bad"), "error").when(F.col("old").isNull(), "new").when(F.col("old") == F.col("hash"), "unchanged").otherwise("changed")
    now = c.join(s, "file", "left").select("file", F.when(~F.col("bad"), F.col("hash")).alias("hash"), action.alias("action"))
    gone = removed_files(current, stored).select("file", F.lit(None).cast("string").alias("hash"), F.lit("removed").alias("action"))
    return now.unionByName(gone)


def removed_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.select("file").join(current.select("file"), "file", "left_anti")


def counters(plan: DataFrame) -> DataFrame:
    """One row: indexed, skipped, removed, errors."""
    a = F.col("action")
    return plan.agg(F.count_if(a.isin("new", "changed")).alias("indexed"), F.count_if(a == "unchanged").alias("skipped"), F.count_if(a == "removed").alias("removed"), F.count_if(a == "error").alias("errors"))


def anchors(nodes: DataFrame, current: DataFrame) -> DataFrame:
    """Nodes with ``anchor`` and ``stale``, against the files as they are now."""
    c = current.select("file", "content")
    line = F.col("start_line")
    return nodes.join(c, "file", "left").select(*nodes.columns, anchor(F.col("file"), line, F.col("content")).alias("anchor"), is_stale(line, F.col("content"), F.col("content_hash")).alias("stale"))


def agent_stale(nodes: DataFrame, edges: DataFrame, hashes: DataFrame) -> DataFrame:
    """Agent edges with ``stale``: whether their source's file has another stored
    hash by now, or source or file are unknown. Hashes meet the nodes first: edges by
    file would be as few tasks as files."""
    e = edges.where("provenance_source = 'agent'")
    n = nodes.select(F.col("id").alias("source"), "file").join(hashes.select("file", "hash"), "file", "left")
    out = e.join(n, "source", "left")
    return out.select(*edges.columns, F.coalesce(F.col("hash") != F.col("content_hash"), F.lit(True)).alias("stale"))
