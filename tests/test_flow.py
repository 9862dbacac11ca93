"""Index runs, the store, and the tools on small trees."""

import pytest
from pyspark.sql import functions as F

from symgraph.functions import parse_evidence
from symgraph.operators import graph
from symgraph.plans import tools
from symgraph.plans.index import ensure_indexed, index_project
from symgraph.plans.store import GraphStore
from symgraph.schema import EDGES, LOOKUPS, NODES
from symgraph.sources.tree import SKIPPED, walk
from symgraph.streaming import index_stream

A = "import { b } from './b'\nexport function a() {\n  b()\n}\napp.get('/x', a)\n"
B = "export function b() {\n  return 1\n}\n"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "src" / "a.ts").write_text(A)
    (root / "src" / "b.ts").write_text(B)
    (root / "node_modules" / "c.ts").write_text(B)
    (root / "readme.md").write_text("x")
    return root


def answers(spark):
    rows = [("definition", "src/a.ts", 3, 3, "ok", "src/b.ts", 1, 17)]
    return lambda work: spark.createDataFrame(rows, LOOKUPS)


def test_walk(tree):
    assert walk(str(tree)) == ["src/a.ts", "src/b.ts"]
    assert walk(str(tree), SKIPPED | {"src"}) == []


def test_index_resolve_change_remove(spark, tree, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    got = index_project(store, str(tree), 1, lookups=answers(spark))
    assert tuple(got) == (2, 0, 0, 0)
    calls = store.edges.where("kind = 'calls'").collect()
    assert [(r.source, r.target, r.provenance_source, r.evidence) for r in calls] == [("src/a.ts::a:2", "src/b.ts::b:1", "lsp", "src/b.ts:1:17")]
    route = store.edges.where("kind = 'routes_to'").first()
    assert (route.source, route.target) == ("src/a.ts::a:2", "endpoint:GET:/x")
    assert tuple(index_project(store, str(tree), 2)) == (0, 2, 0, 0)
    assert not ensure_indexed(store, str(tree), 3)

    text = tools.impact(store, str(tree), ["b"], "removal")
    assert text.startswith("src/a.ts:2:") and text.endswith("  a  breaking  depth:1\n")
    assert tools.impact(store, str(tree), ["b"], "addition") == ""
    shown = tools.symbol_graph(store, str(tree), "b")
    assert shown.startswith("## b (function)\nsrc/b.ts:1:") and "### Callers\n  src/a.ts:2:" in shown and "confidence:0.9  lsp" in shown
    assert tools.symbol_graph(store, str(tree), "zz") == 'Symbol "zz" not found'

    (tree / "src" / "b.ts").write_text("\n" + B)
    assert "[stale]" in tools.symbol_graph(store, str(tree), "b")
    assert tuple(index_project(store, str(tree), 4)) == (1, 1, 0, 0)
    assert store.edges.where("kind = 'calls'").count() == 0  # the call into the changed file is gone (H1)
    (tree / "src" / "a.ts").unlink()
    assert tuple(index_project(store, str(tree), 5)) == (0, 1, 1, 0)
    assert store.list_files() == ["src/b.ts"] and GraphStore(spark, str(tmp_path / "g")).version == store.version


def test_agent_edges(spark, tree, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    index_project(store, str(tree), 1, rule_list=[])
    args = dict(store=store, root=str(tree), source="a", target="b", evidence="seen", now=9)
    assert tools.resolve_edge(kind="sees", **args).startswith('Invalid edge kind "sees". Valid kinds: calls, imports')
    assert tools.resolve_edge(kind="calls", **args).startswith("Edge created:\n  source: src/a.ts:2:")
    assert tools.resolve_edge(kind="calls", **args).startswith("Edge updated:")
    assert tools.resolve_edge(kind="calls", **(args | {"source": "q"})) == 'Source symbol "q" not found'
    (tree / "src" / "a.ts").write_text(A + "\n")
    index_project(store, str(tree), 2, rule_list=[])
    assert store.edges.where("provenance_source = 'agent'").count() == 1
    assert "a  calls  confidence:0.7  agent [stale]" in tools.symbol_graph(store, str(tree), "b")


def asked(spark, rows):
    """Lookups that answer from rows, and the requests they got."""
    got = []

    def run(work):
        got.extend(sorted((r.kind, r.file, r.line, r.col) for r in work.collect()))
        return spark.createDataFrame(rows, LOOKUPS)

    return run, got


def test_tools_index_and_look_up_callers_once(spark, tree):
    store = tools.store_of(spark, str(tree))
    assert tools.store_of(spark, str(tree)) is store and store.version == 0
    lookups, got = asked(spark, [("references", "src/b.ts", 1, 17, "ok", "src/a.ts", 3, 3), ("references", "src/b.ts", 1, 17, "ok", "src/b.ts", 1, 17)])
    shown = tools.symbol_graph(store, str(tree), "b", lookups=lookups, now=1)
    assert "### Callers\n  src/a.ts:2:" in shown and "confidence:0.9  lsp" in shown and got == [("references", "src/b.ts", 1, 17)]
    assert [(r.source, r.evidence) for r in store.edges.where("target = 'src/b.ts::b:1' and kind = 'calls'").collect()] == [("src/a.ts::a:2", "src/a.ts:3:3")]
    marker = store.edges.where("evidence = 'resolved:callers'").first()
    assert (marker.target, marker.confidence) == ("src/b.ts::b:1", 1.0)
    assert tools.symbol_graph(store, str(tree), "b", lookups=lookups, now=2) == shown and len(got) == 1
    (tree / "src" / "b.ts").write_text("\n" + B)
    index_project(store, str(tree), 3)
    lookups, got = asked(spark, [])
    tools.symbol_graph(store, str(tree), "b", lookups=lookups, now=4)
    assert got == [("references", "src/b.ts", 2, 17)]


@pytest.mark.parametrize("status, marked", [("error", False), ("startup_error", True), ("none", True)])
def test_markers_by_status(spark, tree, tmp_path, status, marked):
    store = GraphStore(spark, str(tmp_path / "g"))
    lookups, _ = asked(spark, [("references", "src/b.ts", 1, 17, status, None, None, None)])
    tools.symbol_graph(store, str(tree), "b", lookups=lookups, now=1)
    assert (store.edges.where("evidence = 'resolved:callers'").count() == 1) == marked
    assert store.edges.where("provenance_source = 'lsp' and kind = 'calls'").count() == 0


@pytest.mark.parametrize("good", [True, False])
def test_implementers_of_an_interface(spark, tmp_path, good):
    root = tmp_path / "p"
    root.mkdir()
    (root / "i.ts").write_text("export interface Shape {}\n")
    (root / "c.ts").write_text("class A implements Shape {\n}\nclass B extends A {\n}\n")
    store = GraphStore(spark, str(tmp_path / "g"))
    lookups, got = asked(spark, [("implementations", "i.ts", 1, 18, "ok", "c.ts", 3, 7)] if good else [("implementations", "i.ts", 1, 18, "error", None, None, None)])
    shown = tools.symbol_graph(store, str(root), "Shape", lookups=lookups, now=1)
    assert [x[0] for x in got] == ["implementations", "references"]
    assert f"### Implementations\n  c.ts:{3 if good else 1}:" in shown and shown.count("implements  confidence:0.9  lsp") == 1
    assert store.edges.where("evidence = 'resolved:implementations'").count() == 1


def test_rule_error_stores_nothing(spark, tree, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    with pytest.raises(ValueError):
        index_project(store, str(tree), 1, rule_list=[{"name": "r", "pattern": "???", "lang": "typescript", "produces": {}}], scan=_fail)
    assert store.version == 0


def _fail(files, rule):
    raise ValueError("matcher")


def test_stream(spark, tree, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    spark.createDataFrame([("a.ts", A, None), ("b.ts", B, None)], "file string, content string, error string").write.parquet(str(tmp_path / "in"))
    changes = spark.readStream.schema("file string, content string, error string").parquet(str(tmp_path / "in"))
    index_stream(store, changes, str(tmp_path / "ck"), 1).awaitTermination(120)
    assert store.list_files() == ["a.ts", "b.ts"]


def test_bfs_edges_of_meaning(spark):
    n = spark.createDataFrame([(x, "function", x, "f", 1, 1, "h") for x in "abcd"], NODES)
    e = spark.createDataFrame([(s, t, "calls", "lsp", 0.9, "", "h", 0) for s, t in ("ab", "bc", "ca", "da", "za")], EDGES)
    got = {r.id: r.depth for r in graph.reach(n, e, spark.createDataFrame([("a",)], "id string"), 5).collect()}
    assert got == {"c": 1, "d": 1, "b": 2}
    assert graph.reach(n, e, n.select("id").limit(1), 0).count() == 0
    assert graph.reach(n, e, spark.createDataFrame([("a",)], "id string"), 1.5).count() == 3


def test_self_loops_and_ties(spark):
    n = spark.createDataFrame([(x, "function", x, "f", 1, None, "h") for x in "ab"], NODES)
    e = spark.createDataFrame([("a", "a", "calls", "lsp", 0.9, "", "h", 0), ("a", "b", "calls", "lsp", 0.9, "", "h", 0)], EDGES)
    near = graph.neighbors(n, e, n.where("id = 'a'").select("id"))
    assert sorted((r.dir, r.id) for r in near.collect()) == [("in", "a"), ("out", "a"), ("out", "b")]
    top = graph.ranked(graph.sections(near), 1).collect()
    assert sorted((r.section, r.id, r.omitted) for r in top) == [("Callees", "b", 0), ("Callers", "a", 1)]


@pytest.mark.parametrize("text, want", [("a:1:2", ("a", 1, 2)), ("a:1", None), (":1:2", None), ("a:x:2", None), ("a::2", ("a", 0, 2)), (None, None), ("a:1:2:3", None)])
def test_evidence(spark, text, want):
    got = spark.createDataFrame([(text,)], "e string").select(parse_evidence(F.col("e")).alias("x")).first().x
    assert (tuple(got) if got else None) == want
