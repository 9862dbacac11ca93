"""Edges from structural pattern rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.functions import meta_value, render_template, strip_quotes
from symgraph.operators.dml import first_wins, last_wins
from symgraph.operators.resolve import enclosing_functions
from symgraph.schema import EDGE_COLS, NODE_COLS


def _named(nodes: DataFrame) -> DataFrame:
    """The first node by line and id of each (file, name)."""
    n = first_wins(nodes.select("file", "name", "start_line", "id", "content_hash"), ["start_line", "id"], ["file", "name"])
    return n.select("file", F.col("name").alias("item"), F.col("id").alias("node_id"), F.col("content_hash").alias("node_hash"))


def _evidence(rule: Mapping) -> Column:
    return F.concat(F.lit(f"{rule['name']}@"), "file", F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("col").cast("string"))


def routes(rule: Mapping, matches: DataFrame, nodes: DataFrame, now: int = 0) -> tuple[DataFrame, DataFrame]:
    """Endpoint nodes and routes_to edges of ``matches``: the method upper-cased, the
    path without its quotes, matches without either skipped; an edge for each
    handler that names a node of the same file. The last match writes an endpoint
    or an edge; matches are in order of file, line, column and handler."""
    made = rule["produces"]
    none = nodes.where("false")
    if "to_template" not in made or "from_capture" not in made:
        return none.select(*NODE_COLS), none.select(*[F.lit(None).alias(c) for c in EDGE_COLS])
    m = matches.select("file", "line", "col", "captures", F.upper(meta_value(F.col("captures"), "METHOD")).alias("method"), strip_quotes(meta_value(F.col("captures"), "PATH")).alias("path"))
    m = m.where("method <> '' and path <> ''")
    target = render_template(made["to_template"], F.col("captures"), {"METHOD": F.col("method"), "PATH": F.col("path")})
    m = m.withColumn("target", target)
    each = m.select("file", "line", "col", "target", F.posexplode(F.col("captures")[F.lit(made["from_capture"])]).alias("seq", "item"))
    met = each.join(_named(nodes), ["file", "item"])
    e = met.select(F.col("node_id").alias("source"), "target", F.lit("routes_to").alias("kind"), F.lit("ast-grep").alias("provenance_source"), F.lit(float(made["confidence"])).alias("confidence"), _evidence(rule).alias("evidence"), F.col("node_hash").alias("content_hash"), F.lit(now).cast("long").alias("created_at"), "file", "line", "col", "seq")
    n = met.select(F.col("target").alias("id"), F.lit("endpoint").alias("kind"), F.col("target").alias("name"), "file", F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.col("node_hash").alias("content_hash"), "col", "seq")
    return last_wins(n, ["file", "start_line", "col", "seq"], ["id"]).select(*NODE_COLS), last_wins(e, ["file", "line", "col", "seq"]).select(*EDGE_COLS)


def renders(rule: Mapping, matches: DataFrame, nodes: DataFrame, now: int = 0) -> DataFrame:
    """renders edges of ``matches``: from the smallest enclosing function to the node
    of the same file that the capture names."""
    made = rule["produces"]
    if "to_capture" not in made:
        return nodes.where("false").select(*[F.lit(None).alias(c) for c in EDGE_COLS])
    m = matches.select("file", "line", "col", meta_value(F.col("captures"), made["to_capture"]).alias("item")).where("item <> ''")
    met = enclosing_functions(nodes, m).join(_named(nodes).select("file", "item", F.col("node_id").alias("target")), ["file", "item"])
    h = nodes.select(F.col("id").alias("function_id"), "content_hash")
    e = met.join(h, "function_id").select(F.col("function_id").alias("source"), "target", F.lit("renders").alias("kind"), F.lit("ast-grep").alias("provenance_source"), F.lit(float(made["confidence"])).alias("confidence"), _evidence(rule).alias("evidence"), "content_hash", F.lit(now).cast("long").alias("created_at"), "file", "line", "col")
    return last_wins(e, ["file", "line", "col"]).select(*EDGE_COLS)
