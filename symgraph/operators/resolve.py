"""Resolution of calls, callers and implementers from lookup answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions import MARKER, is_unresolved, parse_evidence, span
from symgraph.operators.dml import delete_edges, upsert_edges
from symgraph.schema import EDGE_COLS, EDGE_KEY, LOOKUP_CONFIDENCE, MARKER_CONFIDENCE


def _first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def pending(nodes: DataFrame, edges: DataFrame, hashes: DataFrame) -> DataFrame:
    """Parsed calls to look up: unresolved ones, and those from an indexed file
    whose target is known (``confirm``); with file and hash of the source node."""
    parsed = edges.where("kind = 'calls' and provenance_source = 'tree-sitter'")
    files = hashes.select(F.col("file").alias("_file")).distinct().withColumn("_indexed", F.lit(True))
    own = nodes.select(F.col("id").alias("source"), F.col("file").alias("_file"), F.col("content_hash").alias("node_hash"))
    # files meet the nodes: edges by file would be as few tasks as files
    e = parsed.join(own.join(files, "_file", "left"), "source").withColumn("confirm", ~is_unresolved(F.col("target")))
    return e.where("not confirm or (confirm and _indexed)").drop("_indexed")


def resolve_calls(nodes: DataFrame, edges: DataFrame, hashes: DataFrame, lookups: DataFrame, now: int = 0) -> DataFrame:
    """``(old key columns, new edge columns)``: what a definition answer replaces. An
    unresolved call becomes a call to the node at the answer with the called name
    (first by line and id); a known call is confirmed where its target stands at
    the answer. Provenance lsp, evidence the answer's place."""
    p = pending(nodes, edges, hashes).withColumn("ev", parse_evidence(F.col("evidence"))).where("ev is not null")
    a = lookups.where("kind = 'definition' and status = 'ok'").select(F.col("file").alias("_file"), F.col("line").alias("_line"), F.col("col").alias("_col"), "def_file", "def_line", "def_col")
    hit = p.join(a, (p["_file"] == a["_file"]) & (F.col("ev.line") == F.col("_line")) & (F.col("ev.col") == F.col("_col"))).drop(a["_file"])
    n = nodes.select(F.col("id").alias("to"), F.col("name").alias("to_name"), F.col("file").alias("to_file"), F.col("start_line").alias("to_line"))
    met = hit.join(n, (F.col("def_file") == F.col("to_file")) & (F.col("def_line") == F.col("to_line")))
    met = met.where("(confirm and to = target) or (not confirm and to_name = ev.name)")
    met = _first(met, EDGE_KEY, ["to_line", "to"])
    evidence = F.concat_ws(":", "def_file", F.col("def_line").cast("string"), F.col("def_col").cast("string"))
    return met.select(
        *[F.col(c).alias(f"old_{c}") for c in EDGE_KEY], "source", F.col("to").alias("target"), F.lit("calls").alias("kind"), F.lit("lsp").alias("provenance_source"),
        F.lit(LOOKUP_CONFIDENCE).alias("confidence"), evidence.alias("evidence"), F.col("node_hash").alias("content_hash"), F.lit(now).cast("long").alias("created_at"), "confirm",
    )


def apply_resolved(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """The edge table after replacement; several calls that resolve to one edge
    leave one."""
    rest = delete_edges(edges, resolved.select(*[F.col(f"old_{c}").alias(c) for c in EDGE_KEY]))
    one = _first(resolved.select(*EDGE_COLS), EDGE_KEY, ["evidence", "content_hash"])
    return upsert_edges(rest, one)


def _blocks(start: Column, end: Column) -> Column:
    """The dyadic blocks ``(level, block)`` that make up a span of lines: two of each
    level at most, and each line in one of them (the nodes of a segment tree)."""
    low, high = start.cast("long"), end.cast("long") + 1
    shift = lambda way, x, k: F.call_function(f"shift{way}", x, k)

    def of(k: Column) -> Column:
        a, b = shift("right", low + shift("left", F.lit(1).cast("long"), k) - 1, k), shift("right", high, k)
        ends = (F.when((a < b) & (x % 2 != 0), F.struct(k.alias("level"), y.alias("block"))) for x, y in ((a, a), (b, b - 1)))
        return F.array_compact(F.array(*ends))

    return F.flatten(F.transform(F.sequence(F.lit(0), _level(high - low)), of))


def _level(lines: Column) -> Column:
    """The level of the largest block in a span of so many lines."""
    return F.length(F.bin(lines)) - 1


def _in_blocks(spans: DataFrame, columns: list[Column]) -> DataFrame:
    s = spans.where("start_line <= end_line")
    return s.select("file", *columns, F.explode(_blocks(F.col("start_line"), F.col("end_line"))).alias("b")).select("*", "b.level", "b.block").drop("b")


def _meet(spans: DataFrame, blocks: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` with what the blocks hold that are around them, one of each level."""
    longest = F.max(F.col("end_line").cast("long") - F.col("start_line") + 1)
    top = spans.where("start_line <= end_line").agg(_level(longest).alias("top")).where("top is not null")
    up = places.crossJoin(F.broadcast(top)).select(*places.columns, F.explode(F.sequence(F.lit(0), "top")).alias("level"))
    up = up.withColumn("block", F.call_function("shiftright", F.col("line").cast("long"), F.col("level")))
    return up.hint("merge").join(blocks, ["file", "level", "block"]).drop("level", "block")


def spanning(spans: DataFrame, places: DataFrame, *columns: str) -> DataFrame:
    """``places(file, line, ...)`` with these columns of each of the ``spans(file,
    start_line, end_line, ...)`` that holds the line, ends included: spans as dyadic
    blocks, so that only what meets is ever paired, each pair once."""
    return _meet(spans, _in_blocks(spans, [F.col(c) for c in columns]), places)


def least_spanning(spans: DataFrame, places: DataFrame, best: Column) -> DataFrame:
    """``(file, line, best)``: for each line of ``places(file, line)`` the least ``best`` of
    the ``spans(file, start_line, end_line, ...)`` that hold it, ends included.

    Spans are cut into dyadic blocks, each of which keeps its least, and a line meets
    the one block of each level that holds it. So rows grow as spans and lines times
    the logarithm of the longest span, however spans nest and however many share a file."""
    blocks = _in_blocks(spans, [best.alias("best")]).groupBy("file", "level", "block").agg(F.min("best").alias("best"))
    return _meet(spans, blocks, places.select("file", "line").distinct()).groupBy("file", "line").agg(F.min("best").alias("best"))


def _first_spanning(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """``(file, line, source, content_hash)``: the first of ``nodes`` by line and id that
    holds a line of ``places(file, line)``. An open end reaches on, so that of a file's
    open nodes the first is the only one to ask."""
    best = F.struct("start_line", F.col("id").alias("source"), "content_hash")
    found = least_spanning(nodes.where("end_line is not null"), places, best)
    ahead = nodes.where("end_line is null and start_line is not null").groupBy("file").agg(F.min(best).alias("best"))
    found = found.unionByName(places.select("file", "line").distinct().join(ahead, "file").where("best.start_line <= line").select("file", "line", "best"))
    return found.groupBy("file", "line").agg(F.min("best").alias("best")).select("file", "line", "best.source", "best.content_hash")


def missing_callers(nodes: DataFrame, edges: DataFrame, references: DataFrame, now: int = 0) -> DataFrame:
    """New calls edges from ``references(symbol_id, ref_file, ref_line, ref_col)``: the
    caller is the first node by line and id (not a module) that spans the place,
    an open end reaching on; none from a symbol to itself, none where a call of
    any provenance is known."""
    r = references.select("symbol_id", "ref_file", "ref_line", "ref_col").distinct()
    at = _first_spanning(nodes.where("kind <> 'module'"), r.select(F.col("ref_file").alias("file"), F.col("ref_line").alias("line")))
    met = r.join(at.withColumnsRenamed({"file": "ref_file", "line": "ref_line"}), ["ref_file", "ref_line"]).where("source <> symbol_id")
    known = edges.where("kind = 'calls'").select("source", F.col("target").alias("symbol_id")).distinct()
    met = met.join(known, ["source", "symbol_id"], "left_anti")
    met = _first(met, ["source", "symbol_id"], ["ref_file", "ref_line", "ref_col"])
    evidence = F.concat_ws(":", "ref_file", F.col("ref_line").cast("string"), F.col("ref_col").cast("string"))
    return met.select("source", F.col("symbol_id").alias("target"), F.lit("calls").alias("kind"), F.lit("lsp").alias("provenance_source"), F.lit(LOOKUP_CONFIDENCE).alias("confidence"), evidence.alias("evidence"), "content_hash", F.lit(now).cast("long").alias("created_at"))


def enclosing_functions(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """``places(file, line, ...)`` with the id of the function of smallest span that
    holds the line (then by line and id), ends included; an open end is the start."""
    end = F.coalesce("end_line", "start_line")
    f = nodes.where("kind = 'function'").select("file", F.col("id").alias("function_id"), "start_line", end.alias("end_line"), span(F.col("start_line"), F.col("end_line")).alias("span"))
    found = least_spanning(f, places, F.struct("span", "start_line", "function_id")).select("file", "line", "best.function_id")
    if set(places.columns) != {"file", "line"}:
        found = places.distinct().join(found, ["file", "line"])
    return found.select(*places.columns, "function_id")


def implementers(nodes: DataFrame, edges: DataFrame, answers: DataFrame, now: int = 0) -> DataFrame:
    """New implements edges from ``answers(symbol_id, def_file, def_line, def_col)``:
    the class that spans the place, first by line and id, unless one is known."""
    a = answers.select("symbol_id", "def_file", "def_line", "def_col").distinct()
    at = _first_spanning(nodes.where("kind = 'class'"), a.select(F.col("def_file").alias("file"), F.col("def_line").alias("line")))
    met = a.join(at.withColumnsRenamed({"file": "def_file", "line": "def_line"}), ["def_file", "def_line"])
    evidence = F.concat_ws(":", "def_file", F.col("def_line").cast("string"), F.col("def_col").cast("string"))
    return _implements(met.withColumn("evidence", evidence), edges, now)


def implementers_by_text(nodes: DataFrame, edges: DataFrame, files: DataFrame, now: int = 0) -> DataFrame:
    """The fallback without answers: classes whose text says ``class C ... implements
    ... I`` before the brace. The (class, word) pairs are drawn from each text
    once and joined by equality, instead of a pattern per class and interface."""
    form = r"\bclass\s+([A-Za-z0-9_$]+)\b([^{]*?)\bimplements\b([^{]*)"
    heads = files.select("file", F.explode(F.regexp_extract_all("content", F.lit(form), F.lit(0))).alias("head"))
    words = F.regexp_extract_all(F.regexp_extract("head", form, 3), F.lit(r"\w+"), F.lit(0))
    pairs = heads.select("file", F.regexp_extract("head", form, 1).alias("class_name"), F.explode(words).alias("word")).distinct()
    c = nodes.where("kind = 'class'").select(F.col("id").alias("source"), "file", F.col("name").alias("class_name"), "start_line", "content_hash")
    i = nodes.where("kind = 'interface'").select(F.col("id").alias("symbol_id"), F.col("name").alias("word"))
    met = c.join(pairs, ["file", "class_name"]).join(i, "word")
    evidence = F.concat_ws(":", "file", F.col("start_line").cast("string"), F.lit("1"))
    return _implements(met.withColumn("evidence", evidence), edges, now)


def _implements(met: DataFrame, edges: DataFrame, now: int) -> DataFrame:
    known = edges.where("kind = 'implements'").select("source", F.col("target").alias("symbol_id")).distinct()
    met = _first(met.join(known, ["source", "symbol_id"], "left_anti"), ["source", "symbol_id"], ["evidence"])
    return met.select("source", F.col("symbol_id").alias("target"), F.lit("implements").alias("kind"), F.lit("lsp").alias("provenance_source"), F.lit(LOOKUP_CONFIDENCE).alias("confidence"), "evidence", "content_hash", F.lit(now).cast("long").alias("created_at"))


def markers(symbols: DataFrame, kind: str, now: int = 0) -> tuple[DataFrame, DataFrame]:
    """Marker nodes and edges that say ``symbols(id)`` were looked up for ``kind``
    (callers or implementations). They belong to no source file, so the node stays
    when the symbol's file is indexed again, while the edge goes."""
    mid = F.concat(F.lit(f"{MARKER}{kind}::"), "id")
    meta = F.lit("meta").alias("content_hash")
    n = symbols.select(mid.alias("id"), F.lit("module").alias("kind"), mid.alias("name"), F.lit("__meta__/resolver").alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), meta)
    e = symbols.select(mid.alias("source"), F.col("id").alias("target"), F.lit("imports").alias("kind"), F.lit("lsp").alias("provenance_source"), F.lit(MARKER_CONFIDENCE).alias("confidence"), F.lit(f"resolved:{kind}").alias("evidence"), meta, F.lit(now).cast("long").alias("created_at"))
    return n, e


def unmarked(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, kind: str) -> DataFrame:
    """``symbols(id)`` still to look up: no marker node, or its edge leads elsewhere."""
    mid = F.concat(F.lit(f"{MARKER}{kind}::"), "id")
    s = symbols.withColumn("_mid", mid)
    has_node = nodes.select(F.col("id").alias("_mid"))
    has_edge = edges.where("kind = 'imports' and provenance_source = 'lsp'").select(F.col("source").alias("_mid"), F.col("target").alias("id"))
    done = s.join(has_node, "_mid", "left_semi").join(has_edge, ["_mid", "id"], "left_semi").select("id")
    return symbols.join(done, "id", "left_anti")


def should_mark(kind: str, status: Column) -> Column:
    """Callers: after a success (also an empty one), or when lookups could not start;
    not after a passing error. Implementations: always, the fallback having run."""
    return F.lit(True) if kind == "implementations" else F.coalesce(status, F.lit("none")).isin("ok", "none", "startup_error")


def caller_flow(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, answers: DataFrame, now: int = 0) -> tuple[DataFrame, DataFrame]:
    """New nodes and edges after the callers of ``symbols(id)`` were looked up, where no
    valid marker says that they have been: calls from missing callers, and markers.
    ``answers(symbol_id, status, ref_file, ref_line, ref_col)``; a symbol without a row
    has no references. The worst status of a symbol counts, its good answers stay out
    then, as the lookup failed as a whole."""
    todo = unmarked(nodes, edges, symbols.select("id").distinct(), "callers")
    failed = answers.where("status not in ('ok', 'none')").groupBy(F.col("symbol_id").alias("id")).agg(F.max("status").alias("status"))
    told = todo.join(failed, "id", "left")
    fine = told.where("status is null").select(F.col("id").alias("symbol_id"))
    calls = missing_callers(nodes, edges, answers.where("status = 'ok'").join(fine, "symbol_id", "left_semi"), now)
    n, e = markers(told.where(should_mark("callers", F.col("status"))).select("id"), "callers", now)
    return n, calls.select(*EDGE_COLS).unionByName(e.select(*EDGE_COLS))


def implementer_flow(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, answers: DataFrame, files: DataFrame, now: int = 0) -> tuple[DataFrame, DataFrame]:
    """The same for the implementers of ``symbols(id)``: from ``answers(symbol_id, status,
    def_file, def_line, def_col)``; for an interface without a good answer (error or
    empty) from ``files(file, content)`` by text. Both leave a marker."""
    todo = unmarked(nodes, edges, symbols.select("id").distinct(), "implementations")
    bad = answers.where("status not in ('ok', 'none')").select(F.col("symbol_id").alias("id"))
    good = answers.where("status = 'ok'").select(F.col("symbol_id").alias("id")).distinct().join(bad, "id", "left_anti").join(todo, "id", "left_semi")
    first = implementers(nodes, edges, answers.where("status = 'ok'").join(good.withColumnRenamed("id", "symbol_id"), "symbol_id", "left_semi"), now)
    rest = nodes.where("kind = 'class'").unionByName(nodes.join(todo.join(good, "id", "left_anti"), "id", "left_semi").select(*nodes.columns))
    n, e = markers(todo, "implementations", now)
    new = first.select(*EDGE_COLS).unionByName(implementers_by_text(rest, edges, files, now).select(*EDGE_COLS))
    return n, new.unionByName(e.select(*EDGE_COLS))
