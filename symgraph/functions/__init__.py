"""Scalar column functions of the graph: ids, evidence, anchors, templates."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

UNRESOLVED = "__unresolved__::"
MARKER = "__meta__::resolver::"
LINE_END = r"\r?\n"
#: White space that is trimmed from a line before its hash.
_EDGES = r"^[\s ﻿]+|[\s ﻿]+$"


def node_id(file: Column, name: Column, line: Column) -> Column:
    return F.concat(file, F.lit("::"), name, F.lit(":"), line.cast("string"))


def unresolved_id(name: Column) -> Column:
    return F.concat(F.lit(UNRESOLVED), name, F.lit(":0"))


def is_unresolved(target: Column) -> Column:
    """A prefix test; LIKE would read the underscores as wildcards."""
    return target.startswith(UNRESOLVED)


def unresolved_name(target: Column) -> Column:
    """The name in a sentinel id, else null."""
    return F.when(is_unresolved(target) & target.endswith(":0"), F.substring(target, len(UNRESOLVED) + 1, 1 << 30).substr(F.lit(1), F.length(target) - len(UNRESOLVED) - 2))


def line_count(content: Column) -> Column:
    """Lines by CRLF or LF; a last empty one counts."""
    return F.size(F.split(content, LINE_END, -1))


def line_at(content: Column, line: Column) -> Column:
    """The 1-based line, null out of range."""
    return F.get(F.split(content, LINE_END, -1), (line - 1).cast("int"))


def parse_evidence(evidence: Column) -> Column:
    """struct(name, line, col) of ``name:line:col``; null unless there are three
    parts, a name, and two numbers (an empty number counts as 0)."""
    p = F.split(evidence, ":", -1)
    number = lambda i: F.when(F.trim(F.get(p, i)) == "", F.lit(0.0)).otherwise(F.trim(F.get(p, i)).try_cast("double"))
    fine = (F.size(p) == 3) & (F.get(p, 0) != "") & number(1).isNotNull() & number(2).isNotNull()
    return F.when(fine, F.struct(F.get(p, 0).alias("name"), number(1).cast("int").alias("line"), number(2).cast("int").alias("col")))


def anchor(file: Column, line: Column, content: Column) -> Column:
    """``file:line:h4``, h4 the first four hex digits of the SHA-256 of the trimmed
    line; ``?`` where the file or the line is missing."""
    text = F.regexp_replace(line_at(content, line), _EDGES, "")
    return F.concat(file, F.lit(":"), line.cast("string"), F.lit(":"), F.coalesce(F.substring(F.sha2(text, 256), 1, 4), F.lit("?")))


def is_stale(line: Column, content: Column, content_hash: Column) -> Column:
    """Whether an anchor can't be trusted: no such line, or another file hash."""
    return line_at(content, line).isNull() | F.coalesce(F.sha2(content, 256) != content_hash, F.lit(True))


def symbol_column(text: Column, name: Column) -> Column:
    """1-based first place of a name in its line, else 1."""
    return F.coalesce(F.greatest(F.instr(text, name), F.lit(1)), F.lit(1))


def classify(change: Column, depth: Column) -> Column:
    """breaking / behavioral, null for an addition or an unknown change."""
    return F.when(change == "behavior_change", F.lit("behavioral")).when(
        change.isin("signature_change", "removal"), F.when(depth == 1, F.lit("breaking")).otherwise(F.lit("behavioral"))
    )


def meta_value(captures: Column, key: str) -> Column:
    """The first item of a capture, null if absent or empty."""
    return F.get(captures[F.lit(key)], 0)


def render_template(template: str, captures: Column, values: Mapping[str, Column] | None = None) -> Column:
    """Literals and captures of a ``{NAME}`` template; a missing one is empty."""
    out: list[Column] = []
    for text, name in re.findall(r"([^{]+|\{(?![A-Z_]+\}))|\{([A-Z_]+)\}", template):
        out.append(F.lit(text) if text else F.coalesce((values or {}).get(name, meta_value(captures, name)), F.lit("")))
    return F.concat(*out) if out else F.lit("")


def strip_quotes(x: Column) -> Column:
    """Without one leading and one trailing ' or \"."""
    return F.regexp_replace(x, "^['\"]|['\"]$", "")


def span(start: Column, end: Column) -> Column:
    return F.coalesce(end, start) - start


def number_text(x: float) -> str:
    """A number as JavaScript prints it: 1, not 1.0."""
    return str(int(x)) if float(x).is_integer() else repr(float(x))
