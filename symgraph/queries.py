"""The driver's queries over the fixture graph, one per operator."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph import functions as C
from symgraph.fixture import SNIPPETS, Graph
from symgraph.operators import dml, files, graph, resolve, rules
from symgraph.schema import CHANGES, EDGE_COLS, NODE_COLS
from symgraph.sources import extract
from symgraph.sources import rules as rule_files
from symgraph.sources import tree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ROUTE, RENDER = rule_files.BUNDLED


def _q(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
    return f


def _smallest(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.min(c).alias("_min"))


def _impact(name: str, symbols: list[str], change: str, depth: float) -> None:
    QUERIES[name] = lambda spark, d: graph.impact(Graph(spark, d).nodes, Graph(spark, d).edges, symbols, change, depth)


_impact("impact_signature", ["red bolt"], "signature_change", 5)
_impact("impact_removal", ["red bolt"], "removal", 2)
_impact("impact_behavior", ["red bolt"], "behavior_change", 1.5)
_impact("impact_depth1", ["red bolt"], "signature_change", 1)
_impact("impact_multi", ["red bolt", "blue gear", "NATION_3"], "removal", 2)


@_q
def impact_ordered(g: Graph) -> DataFrame:
    return graph.impact(g.nodes, g.edges, ["red bolt"], "removal", 2).orderBy(*graph.impact_order())


@_q
def impact_summary(g: Graph) -> DataFrame:
    return graph.impact(g.nodes, g.edges, ["red bolt"], "removal", 2).groupBy("classification", "depth").agg(F.count("*").alias("n"))


@_q
def impact_matrix(g: Graph) -> DataFrame:
    rows = g.spark.createDataFrame([(c, d) for c in CHANGES for d in range(1, 6)], "change string, depth int")
    return rows.select("change", "depth", C.classify(F.col("change"), F.col("depth")).alias("classification"))


@_q
def get_node(g: Graph) -> DataFrame:
    n = g.nodes
    return n.join(F.broadcast(_smallest(n, "id")), F.col("id") == F.col("_min")).select(*NODE_COLS)


@_q
def find_nodes(g: Graph) -> DataFrame:
    return g.nodes.where("name = 'red bolt'").orderBy("file", "start_line", "id")


@_q
def find_nodes_in_file(g: Graph) -> DataFrame:
    n = g.nodes.where("name = 'red bolt'")
    return n.join(F.broadcast(_smallest(n, "file")), F.col("file") == F.col("_min")).select(*NODE_COLS)


@_q
def nodes_by_file(g: Graph) -> DataFrame:
    return g.nodes.where("file = 'events.ts'").orderBy("start_line", "id")


@_q
def edges_by_source(g: Graph) -> DataFrame:
    return g.edges.join(F.broadcast(_smallest(g.sentinels, "source")), F.col("source") == F.col("_min")).select(*EDGE_COLS)


@_q
def unresolved_edges(g: Graph) -> DataFrame:
    return g.edges.where(C.is_unresolved(F.col("target"))).orderBy("created_at", "source", "target")


@_q
def unresolved_names(g: Graph) -> DataFrame:
    e = g.edges.where(C.is_unresolved(F.col("target")))
    return e.groupBy(C.unresolved_name(F.col("target")).alias("name")).agg(F.count("*").alias("n"))


@_q
def unresolved_candidates(g: Graph) -> DataFrame:
    e = g.sentinels.select("source", "target", C.unresolved_name(F.col("target")).alias("name"))
    n = g.nodes.where("kind <> 'module'").groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("candidates"))
    return e.join(n, "name").select("source", "target", "candidates")


@_q
def list_files(g: Graph) -> DataFrame:
    return g.file_hashes.select("file").orderBy("file")


@_q
def name_cardinality(g: Graph) -> DataFrame:
    return g.nodes.groupBy("name").agg(F.count("*").alias("n")).select("name", "n", F.when(F.col("n") == 1, "one").otherwise("many").alias("verdict"))


@_q
def node_id(g: Graph) -> DataFrame:
    return g.nodes.where("kind <> 'endpoint'").select("id", C.node_id(F.col("file"), F.col("name"), F.col("start_line")).alias("made"))


def _near(g: Graph, direction: str, kind: str | None = None) -> DataFrame:
    """Neighbours of all nodes in one direction; either table is too large to broadcast."""
    n = g.nodes.hint("merge")
    return graph.neighbors(n, g.edges, n.select("id"), direction, kind)


def _sections(g: Graph) -> DataFrame:
    return graph.sections(graph.neighbors_of_all(g.nodes, g.edges, ["id", "file"]))


@_q
def neighbors_out(g: Graph) -> DataFrame:
    return _near(g, "out")


@_q
def neighbors_in(g: Graph) -> DataFrame:
    return _near(g, "in")


@_q
def neighbors_both(g: Graph) -> DataFrame:
    return graph.neighbors_of_all(g.nodes, g.edges)


@_q
def neighbors_kind(g: Graph) -> DataFrame:
    return graph.neighbors_of_all(g.nodes, g.edges.where("kind = 'routes_to'"))


@_q
def neighborhood_sections(g: Graph) -> DataFrame:
    return _sections(g).select("center", "section", "dir", "id", "source", "target", "edge_kind", "provenance_source")


@_q
def neighborhood_topk(g: Graph) -> DataFrame:
    keys = ["id", "source", "target", "edge_kind", "provenance_source", "confidence"]
    found = _sections(g).select("center", "section", "dir", "created_at", *keys)
    return graph.ranked(found).select("center", "section", "rn", "id", "source", "target", "provenance_source", "confidence")


@_q
def neighborhood_omitted(g: Graph) -> DataFrame:
    return graph.omitted(_sections(g))


@_q
def neighborhood_depth2(g: Graph) -> DataFrame:
    return graph.reach(g.nodes, g.edges, g.nodes.where("name = 'red bolt'").select("id"), 2, direction="out")


@_q
def implementers_listing(g: Graph) -> DataFrame:
    return graph.implementers_listing(g.nodes, g.edges).select("center", "id", "provenance_source", "confidence")


@_q
def edge_dedup_first(g: Graph) -> DataFrame:
    return g.sentinels.select(*EDGE_COLS)


@_q
def edge_dedup_last(g: Graph) -> DataFrame:
    return g.calls.select(*EDGE_COLS)


@_q
def upsert_nodes(g: Graph) -> DataFrame:
    return dml.upsert_nodes(g.nodes, g.nodes.where("kind = 'class'").withColumn("content_hash", F.lit("new")))


@_q
def delete_edge(g: Graph) -> DataFrame:
    return dml.delete_edges(g.edges, g.edges.where("kind = 'calls' and provenance_source = 'lsp'"))


def _deleted(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    return dml.delete_files(g.nodes, g.edges, g.file_hashes, _smallest(g.functions, "file").withColumnRenamed("_min", "file"))


@_q
def delete_file_edges(g: Graph) -> DataFrame:
    return _deleted(g)[1]


@_q
def delete_file_nodes(g: Graph) -> DataFrame:
    return _deleted(g)[0]


@_q
def agent_upsert(g: Graph) -> DataFrame:
    c = g.classes.select(F.col("id").alias("source"), "file", F.col("s_nationkey").alias("k")).join(g.file_hashes, "file")
    w = c.join(g.interfaces.select(F.col("id").alias("target"), F.col("n_nationkey").alias("k")), "k")
    rows = w.select("source", "target", F.lit("extends").alias("kind"), F.lit("agent").alias("provenance_source"), F.lit(0.7).alias("confidence"), F.lit("seen").alias("evidence"), F.col("hash").alias("content_hash"), F.lit(1).cast("long").alias("created_at"))
    return dml.upsert_edges(g.edges, rows)


@_q
def agent_stale(g: Graph) -> DataFrame:
    low = F.broadcast(_smallest(g.functions, "file"))
    h = g.file_hashes.join(low, F.col("file") == F.col("_min"), "left")
    h = h.select("file", F.when(F.col("_min").isNotNull(), "x").otherwise(F.col("hash")).alias("hash"))
    return files.agent_stale(g.nodes, g.edges, h)


@_q
def file_hash(g: Graph) -> DataFrame:
    return g.files.select("file", F.sha2("content", 256).alias("hash"))


@_q
def line_count(g: Graph) -> DataFrame:
    return g.files.select("file", C.line_count(F.col("content")).alias("lines"))


@_q
def anchors(g: Graph) -> DataFrame:
    return files.anchors(g.document_nodes, g.files).select("id", "anchor", "stale")


@_q
def anchor_missing(g: Graph) -> DataFrame:
    gone = g.document_nodes.join(g.files.select("file"), "file", "left_anti")
    return files.anchors(gone, g.files).select("id", "anchor")


@_q
def index_plan(g: Graph) -> DataFrame:
    return files.index_plan(g.files, g.stored_hashes)


@_q
def index_removed(g: Graph) -> DataFrame:
    return files.removed_files(g.files, g.stored_hashes)


@_q
def index_counters(g: Graph) -> DataFrame:
    return files.counters(files.index_plan(g.files, g.stored_hashes))


@_q
def symbol_column(g: Graph) -> DataFrame:
    return g.files.select("file", C.symbol_column(C.line_at(F.col("content"), F.lit(1)), F.lit("the")).alias("col"))


@_q
def parse_evidence(g: Graph) -> DataFrame:
    return g.sentinels.select("source", "target", C.parse_evidence(F.col("evidence")).alias("e")).select("source", "target", "e.name", "e.line", "e.col")


@_q
def resolve_calls(g: Graph) -> DataFrame:
    out = resolve.resolve_calls(g.nodes, g.sentinels, g.file_hashes, g.lookups)
    return out.where("not confirm").select("source", "target", "evidence", "old_target")


@_q
def confirm_calls(g: Graph) -> DataFrame:
    e = g.calls.where("provenance_source = 'tree-sitter'")
    n = g.functions.select(F.col("id").alias("target"), F.col("file").alias("def_file"), F.col("start_line").alias("def_line"))
    s = g.functions.select(F.col("id").alias("source"), "file")
    ev = C.parse_evidence(F.col("evidence"))
    a = e.join(n.hint("merge"), "target").join(s.hint("merge"), "source").select("file", ev["line"].alias("line"), ev["col"].alias("col"), "def_file", "def_line", "source", "target")
    answers = a.select(F.lit("definition").alias("kind"), "file", "line", "col", F.lit("ok").alias("status"), "def_file", "def_line", F.lit(1).alias("def_col")).distinct()
    out = resolve.resolve_calls(g.nodes, e, g.file_hashes, answers).where("confirm")
    return out.select("source", "target", F.split("evidence", ":")[1].cast("int").alias("def_line"))


@_q
def missing_callers(g: Graph) -> DataFrame:
    return resolve.missing_callers(g.nodes, g.edges, g.references).select("source", "target", "evidence")


@_q
def enclosing_fn(g: Graph) -> DataFrame:
    places = g.functions.select("file", F.col("start_line").alias("line")).distinct()
    return resolve.enclosing_functions(g.nodes, places)


@_q
def caller_flow(g: Graph) -> DataFrame:
    """Edges after the callers of the smallest function of each name were looked up; a
    third of the symbols was looked up before, of every fifth the lookup failed."""
    key = F.element_at(F.split("symbol_id", ":"), -1).cast("int")
    status = F.when(key % 5 == 0, "error").otherwise("ok")
    answers = g.references.withColumn("status", status)
    symbols = answers.select(F.col("symbol_id").alias("id")).distinct()
    n, e = resolve.markers(answers.where(key % 3 == 0).select(F.col("symbol_id").alias("id")).distinct(), "callers")
    _, new = resolve.caller_flow(g.nodes.unionByName(n), g.edges.unionByName(e), symbols, answers)
    return new.select("source", "target", "kind", "evidence")


@_q
def implementers(g: Graph) -> DataFrame:
    i = g.interfaces.select(F.col("id").alias("symbol_id"), ((F.col("n_nationkey") + 24) % 25).alias("s_nationkey"))
    a = g.classes.join(i, "s_nationkey").select("symbol_id", F.col("file").alias("def_file"), (F.col("start_line") + 1).alias("def_line"), F.lit(1).alias("def_col"))
    return resolve.implementers(g.nodes, g.edges, a).select("source", "target", "evidence")


@_q
def implementers_regex(g: Graph) -> DataFrame:
    nodes = g.class_nodes.unionByName(g.interfaces.select(*NODE_COLS))
    return resolve.implementers_by_text(nodes, g.edges, g.class_files).select("source", "target", "evidence")


@_q
def resolver_pending(g: Graph) -> DataFrame:
    done = g.functions.where("p_partkey % 3 = 0")
    n, e = resolve.markers(done, "callers")
    return resolve.unmarked(g.nodes.unionByName(n), g.edges.unionByName(e), g.functions.select("id"), "callers")


@_q
def rule_routes(g: Graph) -> DataFrame:
    return rules.routes(ROUTE, g.route_matches, g.nodes)[1].select("source", "target", "evidence")


@_q
def rule_endpoints(g: Graph) -> DataFrame:
    return rules.routes(ROUTE, g.route_matches, g.nodes)[0].select("id", "file", "start_line")


@_q
def rule_renders(g: Graph) -> DataFrame:
    return rules.renders(RENDER, g.render_matches, g.nodes).select("source", "target", "evidence")


def _snippets(g: Graph) -> DataFrame:
    return g.spark.createDataFrame(SNIPPETS, "file string, content string")


@_q
def extract_demo(g: Graph) -> DataFrame:
    n, e = extract.extract_files(_snippets(g))
    return n.select("id", "kind", F.lit(None).cast("string").alias("target")).unionByName(e.select(F.col("source").alias("id"), "kind", "target"))


@_q
def rule_scan(g: Graph) -> DataFrame:
    s = _snippets(g)
    return rule_files.scan(s, ROUTE).unionByName(rule_files.scan(s, RENDER)).select("file", "line", "col", F.array_join(F.array_sort(F.map_keys("captures")), ",").alias("names"))


@_q
def src_scan(g: Graph) -> DataFrame:
    """Reads a tree that it writes to the folder all executors share: the snippets, and
    files and folders that the walk leaves out."""
    base = Path(graph.shared_path(g.spark)) / f"tree-{uuid.uuid4().hex}"
    for path, text in [*SNIPPETS, ("node_modules/m.ts", "x"), (".git/g.ts", "x"), (f"{tree.STORE_DIR}/s.ts", "x"), ("src/readme.md", "x")]:
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)
    os.symlink(base / "src" / "a.ts", base / "src" / "link.ts")
    read = graph.cut(tree.read_tree(g.spark, str(base)).select("file", F.sha2("content", 256).alias("hash"), "error"))
    shutil.rmtree(base)
    return read


@_q
def trace_static(g: Graph) -> DataFrame:
    entry = _smallest(g.functions, "id").withColumnRenamed("_min", "id")
    return graph.call_paths(g.nodes, g.edges, entry, 2).select(F.array_join("path", " > ").alias("path"), "depth")


@_q
def pattern_2hop(g: Graph) -> DataFrame:
    return graph.two_hop(g.nodes, g.edges, "imports", "routes_to")


@_q
def co_change(g: Graph) -> DataFrame:
    return graph.co_change(g.t("orders").select(F.col("o_custkey").alias("commit"), F.col("o_orderpriority").alias("symbol")))


@_q
def co_change_parts(g: Graph) -> DataFrame:
    """Orders as commits, parts as symbols; the share is low, as parts meet seldom."""
    return graph.co_change(g.t("lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("symbol")), 0.03)


@_q
def co_executes(g: Graph) -> DataFrame:
    """Pairs of functions whose spans hold lines that a test covered, with the number
    of such tests; a user's number stands for file and line."""
    f = g.functions.select("id", "file", "start_line", "end_line")
    user = F.col("user_id")
    file = F.concat(F.lit("part/Brand#"), (user % 25 + 1).cast("string"), F.lit(".ts"))
    lines = g.t("events").select(F.col("event_type").alias("test"), file.alias("file"), user.cast("int").alias("line")).distinct()
    return graph.met_together(resolve.spanning(f, lines, "id"))


@_q
def graph_stats(g: Graph) -> DataFrame:
    return graph.stats(g.nodes, g.edges)
