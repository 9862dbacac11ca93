"""The three tools and their texts."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions import line_at, number_text, symbol_column
from symgraph.operators import dml, files, graph, resolve
from symgraph.plans.index import ensure_indexed
from symgraph.plans.store import GraphStore
from symgraph.schema import AGENT_CONFIDENCE, EDGE_COLS, EDGE_KINDS, IMPACT_DEPTH, NODE_COLS, SECTION_LIMIT
from symgraph.sources import tree

#: From requests ``(kind, file, line, col)`` to answers (see ``schema.LOOKUPS``).
Lookups = Callable[[DataFrame], DataFrame]
_stores: dict[str, GraphStore] = {}


def store_of(spark: SparkSession, root: str) -> GraphStore:
    """The store of a project, in a folder of its own there; one per root."""
    at = str(Path(root).resolve())
    if at not in _stores or _stores[at].spark is not spark:
        _stores[at] = GraphStore(spark, str(Path(at) / tree.STORE_DIR))
    return _stores[at]


def _now(now: int | None) -> int:
    return int(time.time() * 1000) if now is None else now


def look_up(store: GraphStore, root: str, node, lookups: Lookups, now: int) -> None:
    """Looks up the callers of a node, and the implementers of an interface, unless a
    marker says that this was done; stores what was found, and the markers."""
    spark = store.spark
    one = spark.createDataFrame([(node.id, node.file)], "id string, file string")
    kinds = [("references", "callers"), *([("implementations", "implementations")] if node.kind == "interface" else [])]
    todo = [(ask, mark) for ask, mark in kinds if not resolve.unmarked(store.nodes, store.edges, one.select("id"), mark).isEmpty()]
    if not todo:
        return
    line = line_at(F.col("content"), F.lit(node.start_line))
    at = tree.read_files(one, root).select(F.coalesce(symbol_column(line, F.lit(node.name)), F.lit(1)).alias("col")).first().col
    work = spark.createDataFrame([(ask, node.file, node.start_line, at) for ask, _ in todo], "kind string, file string, line int, col int")
    told = graph.cut(lookups(work).join(work, ["kind", "file", "line", "col"], "left_semi"))
    for ask, mark in todo:
        own = told.where(F.col("kind") == ask)
        if mark == "callers":
            answers = own.select(F.lit(node.id).alias("symbol_id"), "status", F.col("def_file").alias("ref_file"), F.col("def_line").alias("ref_line"), F.col("def_col").alias("ref_col"))
            n, e = resolve.caller_flow(store.nodes, store.edges, one, answers, now)
        else:
            answers = own.select(F.lit(node.id).alias("symbol_id"), "status", "def_file", "def_line", "def_col")
            held = store.nodes.where("kind = 'class'").select("file").distinct()
            n, e = resolve.implementer_flow(store.nodes, store.edges, one, answers, tree.read_files(held, root), now)
        if not e.isEmpty():
            store.publish(dml.upsert_nodes(store.nodes, n).select(*NODE_COLS), dml.upsert_edges(store.edges, e).select(*EDGE_COLS))


def _mark(row) -> str:
    return row.anchor + (" [stale]" if row.stale else "")


def _current(store: GraphStore, root: str, wanted: DataFrame) -> DataFrame:
    """The present text of the files of the rows that are shown."""
    return tree.read_files(wanted.select("file").distinct(), root).where("error is null").select("file", "content")


def neighborhood(store: GraphStore, node_id: str, limit: int = SECTION_LIMIT) -> DataFrame:
    """Ranked neighbours of a node by section; agent edges whose source file has
    changed since are marked."""
    found = graph.ranked(graph.sections(store.neighbors(node_id)), limit)
    hashes = store.file_hashes.select(F.col("file").alias("_sf"), "hash")
    sources = store.nodes.select(F.col("id").alias("source"), F.col("file").alias("_sf"))
    out = found.join(sources, "source", "left").join(hashes, "_sf", "left")
    agent = (F.col("provenance_source") == "agent") & F.coalesce(F.col("hash") != F.col("edge_hash"), F.lit(True))
    return out.select(*found.columns, agent.alias("agent_stale"))


def symbol_graph(store: GraphStore, root: str, name: str, file: str | None = None, limit: int = SECTION_LIMIT, lookups: Lookups | None = None, now: int | None = None) -> str:
    """The neighbourhood of a symbol as text; a list where several match. A project
    without an index is indexed first; a single match is looked up by ``lookups``, if
    given (see ``look_up``)."""
    ensure_indexed(store, root, _now(now))
    if lookups is not None and len(few := store.find_nodes(name, file).limit(2).collect()) == 1:
        look_up(store, root, few[0], lookups, _now(now))
    hits = store.find_nodes(name, file)
    shown = files.anchors(hits, _current(store, root, hits)).orderBy("file", "start_line", "id").collect()
    if not shown:
        return f'Symbol "{name}" not found'
    if len(shown) > 1:
        return "\n".join([f'Multiple matches for "{name}":\n', *(f"  {r.anchor}  {r.name} ({r.kind})  {r.file}{' [stale]' if r.stale else ''}" for r in shown)]) + "\n"
    node = shown[0]
    found = neighborhood(store, node.id, limit)
    rows = files.anchors(found, _current(store, root, found)).orderBy("section", "rn").collect()
    out = f"## {node.name} ({node.kind})\n{_mark(node)}"
    parts = []
    for title in ("Callers", "Callees", "Imports", "Unresolved"):
        mine = [r for r in rows if r.section == title]
        if mine:
            lines = [f"\n### {title}"]
            for r in mine:
                stale = " [stale]" if r.stale or r.agent_stale else ""
                lines.append(f"  {r.anchor}  {r.name}  {r.edge_kind}  confidence:{number_text(r.confidence)}  {r.provenance_source}{stale}")
            if mine[0].omitted:
                lines.append(f"  ({mine[0].omitted} more omitted)")
            parts.append("\n".join(lines))
    out += "\n".join(parts) + "\n"
    if node.kind == "interface":
        impl = store.neighbors(node.id, "in", "implements")
        rows = files.anchors(impl, _current(store, root, impl)).orderBy("source", "provenance_source").collect()
        if rows:
            out += "\n".join(["", "### Implementations", *(f"  {r.anchor}  {r.name}  implements  confidence:{number_text(r.confidence)}  {r.provenance_source}" for r in rows)]) + "\n"
    return out


def resolve_edge(store: GraphStore, root: str, source: str, target: str, kind: str, evidence: str, source_file: str | None = None, target_file: str | None = None, now: int | None = None) -> str:
    """Writes an agent's edge; texts say what was wrong, first things first. A project
    without an index is indexed first."""
    ensure_indexed(store, root, _now(now))
    ends = []
    for label, name, file in (("source", source, source_file), ("target", target, target_file)):
        rows = store.find_nodes(name, file).collect()
        if not rows:
            return f'{label.capitalize()} symbol "{name}" not found'
        if len(rows) > 1:
            return "\n".join([f"Ambiguous {label} — multiple matches:", *(f"  {r.file}  {r.kind}  line {r.start_line}" for r in rows), f"\nSpecify {label}File to disambiguate."])
        ends.append(rows[0])
    if kind not in EDGE_KINDS:
        return f'Invalid edge kind "{kind}". Valid kinds: {", ".join(EDGE_KINDS)}'
    s, t = ends
    digest = store.file_hash(s.file) or s.content_hash
    existed = not store.neighbors(s.id, "out", kind).where((F.col("target") == t.id) & (F.col("provenance_source") == "agent")).isEmpty()
    store.add_edges([(s.id, t.id, kind, "agent", AGENT_CONFIDENCE, evidence, digest, _now(now))])
    both = store.nodes.where(F.col("id").isin(s.id, t.id))
    at = {r.id: r.anchor for r in files.anchors(both, _current(store, root, both)).collect()}
    return "\n".join([f"Edge {'updated' if existed else 'created'}:", f"  source: {at[s.id]}  {s.name}", f"  target: {at[t.id]}  {t.name}", f"  kind: {kind}", f"  provenance: agent  confidence:{number_text(AGENT_CONFIDENCE)}"])


def impact(store: GraphStore, root: str, symbols: Sequence[str], change: str, max_depth: float = IMPACT_DEPTH, now: int | None = None) -> str:
    """What a change touches, by depth, file and name; empty if nothing. A project
    without an index is indexed first."""
    ensure_indexed(store, root, _now(now))
    hit = graph.impact(store.nodes, store.edges, symbols, change, max_depth)
    full = graph.cut(hit.join(store.nodes.select(F.col("id").alias("node_id"), "start_line", "content_hash"), "node_id"))
    rows = files.anchors(full, _current(store, root, full)).orderBy(*graph.impact_order()).collect()
    return "".join(f"{r.anchor}  {r.name}  {r.classification}  depth:{r.depth}{' [stale]' if r.stale else ''}\n" for r in rows)
