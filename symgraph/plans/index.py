"""The index run: from a source tree to the next snapshot."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.operators import dml, files, resolve, rules
from symgraph.operators.graph import cut
from symgraph.plans.store import GraphStore
from symgraph.schema import EDGE_COLS, NODE_COLS
from symgraph.sources import extract, tree
from symgraph.sources import rules as rule_files

Lookups = Callable[[DataFrame], DataFrame]


def index_files(store: GraphStore, current: DataFrame, now: int, lookups: Lookups | None = None, rule_list: Sequence[Mapping] | None = None, scan: Callable[[DataFrame, Mapping], DataFrame] = rule_files.scan):
    """One run over ``current(file, content, error)``: unchanged files are skipped,
    changed and vanished ones taken out, new and changed ones extracted; calls are
    resolved by ``lookups`` (a function from work list to answers) over the whole
    graph, rules applied to the changed files; one snapshot is published at the
    end. Returns the counters row. Rule errors propagate, nothing is then stored."""
    current = cut(current)
    plan = cut(files.index_plan(current, store.file_hashes))
    todo = current.join(plan.where("action in ('new', 'changed')").select("file"), "file", "left_semi")
    nodes, edges, hashes = dml.delete_files(store.nodes, store.edges, store.file_hashes, plan.where("action in ('changed', 'removed')"))
    n, e = extract.extract_files(todo, now)
    nodes = cut(dml.upsert_nodes(nodes, dml.last_wins(n, [], ["id"])))
    edges = cut(dml.upsert_edges(edges, dml.first_wins(e, ["created_at"])))
    fresh = plan.where("action in ('new', 'changed')").select("file", "hash", F.lit(now).cast("long").alias("indexed_at"))
    hashes = dml.upsert(hashes, fresh, ["file"], ["file", "hash", "indexed_at"])
    if lookups is not None:
        work = resolve.pending(nodes, edges, hashes)
        edges = cut(resolve.apply_resolved(edges, resolve.resolve_calls(nodes, edges, hashes, lookups(work), now)))
    if not todo.isEmpty():
        for rule in rule_list if rule_list is not None else rule_files.load():
            matches = scan(todo, rule)
            if rule["produces"]["edge_kind"] == "routes_to":
                rn, re_ = rules.routes(rule, matches, nodes, now)
                nodes, edges = cut(dml.upsert_nodes(nodes, rn)), cut(dml.upsert_edges(edges, re_))
            else:
                edges = cut(dml.upsert_edges(edges, rules.renders(rule, matches, nodes, now)))
    store.publish(nodes.select(*NODE_COLS), edges.select(*EDGE_COLS), hashes)
    return files.counters(plan).first()


def index_project(store: GraphStore, root: str, now: int, **options):
    """Indexes a source tree; see ``index_files``. The project's own rules are read
    from its rule folder unless ``rule_list`` is given."""
    options.setdefault("rule_list", rule_files.load(root))
    return index_files(store, tree.read_tree(store.spark, root), now, **options)


def ensure_indexed(store: GraphStore, root: str, now: int, **options) -> bool:
    """Indexes only where no file hash is stored."""
    if not store.file_hashes.isEmpty():
        return False
    index_project(store, root, now, **options)
    return True
