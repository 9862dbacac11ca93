"""Plans and results that must hold on tables far larger than these."""

import re
from pathlib import Path

import pytest

from symgraph.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
tables = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@tables
@pytest.mark.parametrize("name", ["edge_dedup_last", "edge_dedup_first"])
def test_calls_are_deduplicated_before_ids_are_joined(spark, name):
    text = plan(QUERIES[name](spark, str(DATA)))
    assert "BroadcastHashJoin" not in text
    keys = re.findall(r"SortAggregate\(key=\[([^\]]*)\]", text)
    assert keys and all("l_partkey" in k and "source" not in k.replace("provenance_source", "") for k in keys)


@tables
@pytest.mark.parametrize("name", ["neighbors_out", "neighbors_both", "neighborhood_topk", "neighborhood_omitted"])
def test_edges_are_made_once_and_not_written(spark, name):
    text = plan(QUERIES[name](spark, str(DATA)))
    assert "ExistingRDD" not in text  # no checkpoint
    assert text.count("lineitem.parquet") == 2  # calls and unresolved calls


def test_neighbors_of_all_are_those_of_each(spark):
    from symgraph.operators import graph
    from symgraph.schema import EDGES, NODES

    n = spark.createDataFrame([(x, "function", x, "f", 1, None, "h") for x in "abcc"], NODES)
    e = spark.createDataFrame([(s, t, "calls", "lsp", 0.9, "", "h", 0) for s, t in ("aa", "ab", "bc", "ca", "za", "az")], EDGES)
    got, want = graph.neighbors_of_all(n, e), graph.neighbors(n, e, n.select("id"))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_ranks_with_nulls_ties_and_hubs(spark):
    from pyspark.sql import functions as F

    from symgraph.operators import graph

    nan = float("nan")
    rows = [(c, t, d, s) for c in (0.5, 0.9, None, nan) for t in (3, None, 1) for d in ("in", "out") for s in "ba"]
    found = spark.createDataFrame([("x", "Callers", d, c, t, s, "x", "calls", "lsp") for c, t, d, s in rows], "center string, section string, dir string, confidence double, created_at long, source string, target string, edge_kind string, provenance_source string")
    order = [F.desc("confidence"), F.desc("created_at"), F.desc("dir"), "source"]
    want = [str(r) for r in found.orderBy(*order).collect()]
    got = graph.ranked(found.repartition(3), 30).orderBy("rn").drop("rn", "omitted")
    assert [str(r) for r in got.select(*found.columns).collect()] == want[:30]
    assert {r.omitted for r in graph.ranked(found, 30).collect()} == {len(rows) - 30} == {r.omitted for r in graph.omitted(found, 30).collect()}
    assert len(re.findall("Exchange hashpartitioning", plan(graph.ranked(found.repartition(3))))) == 1


def test_least_spanning_against_all_pairs(spark):
    """Nested, equal, single-line and very long spans, at any place of the line numbers."""
    from pyspark.sql import functions as F

    from symgraph.operators import resolve

    spans = [("f" if i % 3 else "g", a, a + n, f"s{i}") for i, (a, n) in enumerate([(x * 7 % 61, x * x % 45) for x in range(80)] + [(0, 2**31 - 1), (5, -3), (2**31 - 2, 1), (64, 0), (-4, 9)])]
    lines = [*range(-6, 70), 2**31 - 1, 2**31 - 2, 4000]
    s = spark.createDataFrame(spans, "file string, start_line int, end_line int, id string")
    p = spark.createDataFrame([(f, x) for f in ("f", "g", "h") for x in lines] + [("f", None), (None, 3), ("f", 3)], "file string, line int")
    got = resolve.least_spanning(s, p, F.struct(F.expr("cast(end_line as long) - start_line").alias("n"), "start_line", "id"))
    want = {(f, x): min(m) for f in ("f", "g") for x in lines if (m := [(b - a, a, i) for g, a, b, i in spans if g == f and a <= x <= b])}
    rows = got.collect()
    assert {(r.file, r.line): tuple(r.best) for r in rows} == want and len(rows) == len(want)
    all_of = sorted((r.file, r.line, r.id) for r in resolve.spanning(s, p.distinct(), "id").collect())
    assert all_of == sorted((f, x, i) for f in ("f", "g") for x in lines for g, a, b, i in spans if g == f and a <= x <= b)


def test_lookups_of_spans_do_not_pair_a_file_with_itself(spark):
    """The rows between join and result grow as the file, not as its square."""
    from pyspark.sql import functions as F

    from symgraph.operators import resolve
    from symgraph.schema import NODES

    n = spark.range(4000).select(F.format_string("c%05d", "id").alias("id"), F.lit("class").alias("kind"), F.lit("c").alias("name"), F.lit("f").alias("file"), F.col("id").cast("int").alias("start_line"), F.when(F.col("id") >= 2000, F.col("id").cast("int") + 9).alias("end_line"), F.lit("h").alias("content_hash"))
    a = spark.range(4000).select(F.lit("i").alias("symbol_id"), F.lit("f").alias("def_file"), F.col("id").cast("int").alias("def_line"), F.lit(1).alias("def_col"))
    e = spark.createDataFrame([], "source string, target string, kind string")
    out = resolve.implementers(n, e, a)
    assert [r.source for r in out.collect()] == ["c00000"]
    closed = n.where("end_line is not null")
    assert {r.source for r in resolve.implementers(closed, e, a).collect()} == {f"c{i:05d}" for i in range(2000, 3991)}
    text = plan(out)
    assert "def_file" not in "".join(x for x in text.splitlines() if "Join" in x and "def_line" not in x)
    f = n.withColumns({"kind": F.lit("function"), "end_line": F.lit(5000)})
    assert resolve.enclosing_functions(f, a.select(F.col("def_file").alias("file"), F.col("def_line").alias("line"))).where("substring(function_id, 2) <> lpad(line, 5, '0')").count() == 0


def test_pairs_of_a_test_are_not_shuffled(spark):
    from symgraph.operators import graph

    hits = [(f"t{t}", f"i{i:03d}") for t in range(4) for i in range(60) if (i >> t) & 1 or i % 7 == t] + [("t1", "i001")]
    df = spark.createDataFrame(hits, "test string, id string")
    by = {}
    for t, i in hits:
        by.setdefault(i, set()).add(t)
    want = sorted((a, b, len(by[a] & by[b])) for a in by for b in by if a < b and by[a] & by[b])
    for block in (3, 1000):
        out = graph.met_together(df, block)
        assert sorted(map(tuple, out.collect())) == want
        assert plan(out).partition("Exchange")[0].count("Generate explode") == 2  # blocks become pairs after the last shuffle


def test_few_files_are_not_the_keys_of_edges(spark):
    from symgraph.operators import files, resolve
    from symgraph.schema import EDGES, NODES

    n = spark.createDataFrame([(x, "function", x, f, 1, 2, f"h{x}") for x, f in ("af", "bg", "ch")], NODES)
    e = spark.createDataFrame([(s, t, "calls", p, 0.5, f"{t}:1:2", "h", 0) for s, t, p in (("a", "b", "tree-sitter"), ("b", "__unresolved__::q:0", "tree-sitter"), ("c", "a", "tree-sitter"), ("z", "a", "tree-sitter"), ("a", None, "tree-sitter"), ("a", "c", "agent"), ("z", "c", "agent"))], EDGES)
    h = spark.createDataFrame([("f", "h"), ("g", "x"), ("f", "h")], "file string, hash string")
    got = resolve.pending(n, e, h.union(h))
    assert sorted((r.source, r.confirm, r.node_hash) for r in got.collect()) == [("a", True, "ha"), ("b", False, "hb")]
    stale = files.agent_stale(n, e, h.distinct())
    assert sorted((r.source, r.stale) for r in stale.collect()) == [("a", False), ("z", True)]
    for out, key in ((got, "_file"), (stale, "file")):
        side = [x for x in plan(out).splitlines() if "Join" in x and "source" in x]
        first = next(x for x in plan(out).splitlines() if "Join" in x)
        assert side and first in side  # the last join is by source


def test_paths_take_their_steps_first(spark):
    from symgraph.operators import graph
    from symgraph.schema import EDGES, NODES

    n = spark.createDataFrame([(x, "function", x, "f", 1, 1, "h") for x in "abcd"], NODES)
    e = spark.createDataFrame([(s, t, "calls", p, 0.9, "", "h", 0) for s, t in ("ab", "bc", "ca", "bd", "dz", "ad") for p in ("lsp", "agent")], EDGES)
    got = graph.call_paths(n, e, n.where("id = 'a'").select("id")).collect()
    assert sorted(("".join(r.path), r.depth) for r in got) == [("a", 0), ("ab", 1), ("abc", 2), ("abd", 2), ("ad", 1)]


@tables
def test_routes_do_not_gather_all_parts(spark):
    from symgraph.fixture import Graph

    text = plan(Graph(spark, str(DATA)).routes)
    assert "BuildRight" in text and "part.parquet" not in text[text.index("BroadcastExchange"):]
    assert not re.search(r"Exchange hashpartitioning\(p_partkey#\d+L, \d+\)", text)


@tables
def test_unresolved_calls_keep_their_tasks(spark):
    """Adaptive execution would merge the narrow rows of unresolved calls to one task."""
    df = QUERIES["edge_dedup_first"](spark, str(DATA))
    assert "REPARTITION_BY_NUM" in plan(df)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
