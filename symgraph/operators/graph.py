"""Neighbourhoods, their ranking, and traversal."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symgraph.functions import UNRESOLVED, classify
from symgraph.schema import EDGE_COLS, IMPACT_DEPTH, NODE_COLS, SECTION_LIMIT

#: Frontiers of up to this number of ids (about 100 bytes each) are broadcast.
BROADCAST_IDS = 20_000


def _shared(spark: SparkSession) -> None:
    """Sets Spark's checkpoint folder to the one that the cluster shares
    (``spark.checkpoint.dir``); a folder of this machine only on a local master."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="symgraph-"))


def shared_path(spark: SparkSession) -> str:
    """The shared folder as a path, for files that aren't tables; it must be mounted."""
    _shared(spark)
    where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if "://" in where and not where.startswith("file:"):
        raise ValueError("the shared folder isn't mounted as a path")
    return where.removeprefix("file:").replace("//", "/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the folder that the cluster shares."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def _edge_side(edges: DataFrame) -> DataFrame:
    names = {"kind": "edge_kind", "content_hash": "edge_hash"}
    return edges.select(*[F.col(c).alias(names.get(c, c)) for c in EDGE_COLS])


def neighbors(nodes: DataFrame, edges: DataFrame, centers: DataFrame, direction: str = "both", kind: str | None = None) -> DataFrame:
    """Rows ``(center, dir, node columns, edge columns)`` for ``centers(id)``: nodes
    that edges lead to (out), then nodes they come from (in). Edges to ids without
    a node are dropped; a self-loop comes in both directions."""
    e = _edge_side(edges)
    if kind is not None:
        e = e.where(F.col("edge_kind") == kind)
    c = centers.select(F.col("id").alias("center"))
    parts = []
    for name, near, far in (("out", "source", "target"), ("in", "target", "source")):
        if direction in ("both", name):
            own = e.join(c, F.col(near) == F.col("center"))
            parts.append(own.join(nodes, own[far] == nodes["id"]).select("center", F.lit(name).alias("dir"), *NODE_COLS, *e.columns))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def neighbors_of_all(nodes: DataFrame, edges: DataFrame, columns: Sequence[str] = NODE_COLS) -> DataFrame:
    """``neighbors`` with every node as a center, in both directions, with these node
    columns. Edges are shuffled once by each end and take along what either direction
    needs. Ids are shuffled by themselves after they are gathered, so that a join can
    split the edges of a hub."""
    e = _edge_side(edges)
    names = e.columns
    for end in ("source", "target"):
        at = nodes.groupBy(F.col("id").alias(end)).agg(F.collect_list(F.struct(*columns)).alias(f"_{end}"))
        e = e.join(at.repartition(end).hint("merge"), end)

    def rows(name: str, near: str, far: str) -> Column:
        row = lambda n: F.struct(F.col(near).alias("center"), F.lit(name).alias("dir"), *[n[c].alias(c) for c in columns])
        return F.flatten(F.transform(f"_{near}", lambda _: F.transform(f"_{far}", row)))

    both = F.concat(rows("out", "source", "target"), rows("in", "target", "source"))
    return e.select(F.inline(both), *names)


def sections(found: DataFrame) -> DataFrame:
    """Adds ``section`` to neighbours: Unresolved by file, calls into the center
    Callers, other calls Callees, outgoing imports Imports; the rest goes."""
    s = (
        F.when(F.col("file").startswith(UNRESOLVED.rstrip(":")), "Unresolved")
        .when((F.col("edge_kind") == "calls") & (F.col("target") == F.col("center")), "Callers")
        .when(F.col("edge_kind") == "calls", "Callees")
        .when((F.col("edge_kind") == "imports") & (F.col("source") == F.col("center")), "Imports")
    )
    return found.withColumn("section", s).where("section is not null")


def ranked(found: DataFrame, limit: int = SECTION_LIMIT) -> DataFrame:
    """The best ``limit`` of each section by confidence, then age (newest first),
    then out before in, then edge key; with ``rn`` and ``omitted``. ``found`` is made
    and shuffled once, for ranks and sizes together. Where ``omitted`` isn't read, each
    task cuts a section to its own best ``limit`` before the shuffle (window group
    limit); where it is, the task that gets a hub sorts all its rows and spills."""
    order = [F.desc("confidence"), F.desc("created_at"), F.desc("dir"), "source", "target", "edge_kind", "provenance_source"]
    w = Window.partitionBy("center", "section")
    out = found.withColumn("_n", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(*order))).where(F.col("rn") <= limit)
    return out.select(*found.columns, "rn", _over(F.col("_n"), limit))


def omitted(found: DataFrame, limit: int = SECTION_LIMIT) -> DataFrame:
    """How many of each section ``ranked`` leaves out."""
    return found.groupBy("center", "section").agg(F.count("*").alias("_n")).select("center", "section", _over(F.col("_n"), limit))


def _over(n: Column, limit: int) -> Column:
    return F.greatest(n - limit, F.lit(0)).alias("omitted")


def implementers_listing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that implement each interface, by any provenance, unranked."""
    return neighbors(nodes, edges, nodes.where("kind = 'interface'").select("id"), "in", "implements")


def _near(frontier: DataFrame) -> tuple[DataFrame, int]:
    n = frontier.count()
    return (F.broadcast(frontier) if n <= BROADCAST_IDS else frontier), n


def reach(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: float, kinds: Sequence[str] = ("calls",), direction: str = "in") -> DataFrame:
    """``(id, depth)`` of the nodes that a breadth-first walk from ``seeds(id)``
    meets within ``max_depth`` hops, seeds left out, depth the fewest hops.

    One join, distinct and anti-join per level; each level's new ids are
    checkpointed and the loop ends with an empty frontier. Edges are narrowed
    once to two columns with both ends alive. A small frontier is broadcast."""
    near, far = ("target", "source") if direction == "in" else ("source", "target")
    steps = edges.where(F.col("kind").isin(*kinds)).select(F.col(near).alias("at"), F.col(far).alias("to")).distinct()
    steps = cut(steps.join(nodes.select(F.col("id").alias("to")), "to", "left_semi").select("at", "to"))
    level = cut(seeds.select("id").distinct())
    seen = level.select("id", F.lit(0).alias("depth"))
    for depth in range(1, math.ceil(max_depth) + 1 if max_depth > 0 else 1):
        front, n = _near(level.select(F.col("id").alias("at")))
        if not n:
            break
        new = steps.join(front, "at").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti")
        level = cut(new)
        seen = seen.unionByName(level.select("id", F.lit(depth).alias("depth")))
    return seen.where("depth > 0")


def impact(nodes: DataFrame, edges: DataFrame, symbols: Sequence[str], change: str, max_depth: float = IMPACT_DEPTH) -> DataFrame:
    """``(node_id, name, file, depth, classification)`` of what a change of the named
    symbols touches through calls; an addition touches nothing."""
    seeds = nodes.where(F.col("name").isin(*symbols)).select("id")
    hit = reach(nodes, edges, seeds, 0 if change == "addition" else max_depth)
    out = hit.join(nodes, "id").select(F.col("id").alias("node_id"), "name", "file", "depth", classify(F.lit(change), F.col("depth")).alias("classification"))
    return out.where("classification is not null")


def impact_order() -> list[Column]:
    """Depth, then file and name as ICU's root locale compares them."""
    return [F.col("depth"), F.collate("file", "UNICODE"), F.collate("name", "UNICODE"), F.col("node_id")]


def call_paths(nodes: DataFrame, edges: DataFrame, entry: DataFrame, max_depth: int = 20) -> DataFrame:
    """``(path, depth)``: simple call paths from ``entry(id)`` up to ``max_depth``
    edges, each extended path once (a trace). Cycles end a path. The number of
    paths grows with the out-degree, so bound the depth on dense graphs. Each level
    takes the steps from its ends first; only those are made distinct and held
    against the nodes."""
    steps = edges.where("kind = 'calls'").select("source", "target")
    ids = nodes.select(F.col("id").alias("target"))
    level = cut(entry.select(F.array("id").alias("path")))
    out = level
    for _ in range(max_depth):
        ends, n = _near(level.select(F.element_at("path", -1).alias("source")).distinct())
        own = cut(steps.join(ends, "source").select("source", "target").distinct().join(ids, "target", "left_semi"))
        nxt = level.withColumn("source", F.element_at("path", -1)).join(own, "source").where(~F.array_contains("path", F.col("target")))
        level = cut(nxt.select(F.array_append("path", F.col("target")).alias("path")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("path", (F.size("path") - 1).alias("depth"))


def two_hop(nodes: DataFrame, edges: DataFrame, first: str, second: str) -> DataFrame:
    """The pattern (a)-[first]->(b)-[second]->(c) over existing nodes."""
    n = nodes.select("id")
    a = edges.where(F.col("kind") == first).select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    b = edges.where(F.col("kind") == second).select(F.col("source").alias("b"), F.col("target").alias("c")).distinct()
    out = a.join(b, "b")
    for c in ("a", "b", "c"):
        out = out.join(n.withColumnRenamed("id", c), c, "left_semi")
    return out.select("a", "b", "c")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes by kind and of edges by kind and provenance, with totals."""
    n = nodes.cube("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", F.lit(None).cast("string").alias("provenance_source"), "n")
    e = edges.cube("kind", "provenance_source").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "provenance_source", "n")
    return n.unionByName(e)


def co_change(commits: DataFrame, share: float = 0.6) -> DataFrame:
    """Pairs of symbols of ``commits(commit, symbol)`` that are together in more than
    ``share`` of the commits in which either is. A symbol that shares no commit is in
    no pair, so commits of one symbol take no part in the join."""
    c = commits.select("commit", "symbol").distinct()
    each = c.groupBy("symbol").agg(F.count("*").alias("n"))
    c = c.join(c.groupBy("commit").agg(F.count("*").alias("_k")).where("_k > 1").select("commit"), "commit", "left_semi")
    both = c.withColumnRenamed("symbol", "a").join(c.withColumnRenamed("symbol", "b"), "commit").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    out = both.join(each.select(F.col("symbol").alias("a"), F.col("n").alias("na")), "a").join(each.select(F.col("symbol").alias("b"), F.col("n").alias("nb")), "b")
    return out.where(F.col("both") > share * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b", "both", (F.col("na") + F.col("nb") - F.col("both")).alias("either"))


#: Symbols of one block of ``met_together``: a task holds two blocks at a time.
BLOCK = 1000


def met_together(hits: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(a, b, tests)``: each pair of ids of ``hits(test, id)`` that a test has in common,
    with the number of such tests.

    The pairs are the result and may be the square of the input; nothing else is. Ids
    of equal tests form blocks, pairs of blocks that share a test are found by that,
    and each pair of blocks is spelled out where it lies: no pair of ids is shuffled,
    counted or held, and a hot test is many pairs of blocks."""
    h = hits.select("test", "id").where("test is not null and id is not null").distinct()
    h = h.groupBy("id").agg(F.sort_array(F.collect_list("test")).alias("tests"))
    sizes = h.groupBy("tests").agg(F.ceil(F.count("*") / block).alias("_n"))
    units = h.join(sizes, "tests").withColumn("part", F.pmod(F.xxhash64("id"), F.col("_n"))).groupBy("tests", "part").agg(F.collect_list("id").alias("ids"))
    units = cut(units)
    keys = units.select("tests", "part", F.explode("tests").alias("test"))
    x, y = (keys.select("test", F.struct("tests", "part").alias(c)) for c in ("x", "y"))
    common = F.array_intersect("x.tests", "y.tests")
    both = x.join(y, "test").where(F.col("x") <= F.col("y")).where(F.col("test") == F.array_min(common)).select("x", "y", F.size(common).cast("long").alias("n"))
    named = lambda c: units.select(F.struct("tests", "part").alias(c), F.col("ids").alias(f"{c}_ids"))
    both = both.join(named("x"), "x").join(named("y"), "y").withColumn("same", F.col("x") == F.col("y"))
    # a number of tasks, since their rows are few and their results aren't
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.select("n", "same", "x_ids", "y_ids").repartition(tasks, F.xxhash64("x_ids", "y_ids"))
    each = both.select("n", "same", "y_ids", F.explode("x_ids").alias("x")).select("n", "same", "x", F.explode("y_ids").alias("y"))
    return each.where("not same or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("n").alias("tests"))
