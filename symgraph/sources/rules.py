"""Rule files, and the structural matcher for their patterns."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Mapping

import pandas as pd
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.schema import MATCHES
from symgraph.sources.lexer import SyntaxProblem, Token, tokens

#: Where a project keeps rules of its own.
RULE_DIR = os.path.join(".symgraph", "rules")

BUNDLED = [
    {"name": "express-route", "pattern": "$APP.$METHOD($PATH, $$$HANDLERS)", "lang": "typescript",
     "produces": {"edge_kind": "routes_to", "from_capture": "HANDLERS", "to_template": "endpoint:{METHOD}:{PATH}", "confidence": 0.9}},
    {"name": "react-render", "pattern": "<$COMPONENT $$$ATTRS />", "lang": "tsx",
     "produces": {"edge_kind": "renders", "from_context": "enclosing_function", "to_capture": "COMPONENT", "confidence": 0.8}},
]


def validate(path: str, raw: object) -> list[dict]:
    """The rules of a parsed file, or an error that names it."""

    def bad(what: str) -> ValueError:
        return ValueError(f"Invalid rule file {path}: {what}")

    if not isinstance(raw, list):
        raise bad("expected YAML array")
    for r in raw:
        if not isinstance(r, dict):
            raise bad("expected object item")
        for key in ("name", "pattern", "lang"):
            if not r.get(key):
                raise bad(f"missing {key}")
        p = r.get("produces") if isinstance(r.get("produces"), dict) else {}
        if not p.get("edge_kind"):
            raise bad("missing produces.edge_kind")
        if p["edge_kind"] not in ("routes_to", "renders"):
            raise bad(f"unsupported produces.edge_kind {p['edge_kind']}")
        if isinstance(p.get("confidence"), bool) or not isinstance(p.get("confidence"), (int, float)):
            raise bad("missing produces.confidence")
        for one, two in (("from_capture", "from_context"), ("to_capture", "to_template")):
            if isinstance(p.get(one), str) == isinstance(p.get(two), str):
                raise bad(f"specify exactly one of produces.{one} or produces.{two}")
        if isinstance(p.get("from_context"), str) and p["from_context"] != "enclosing_function":
            raise bad(f"unsupported produces.from_context {p['from_context']}")
    return raw


def load_dir(path: str) -> list[dict]:
    """Rules of the .yaml and .yml files directly in a folder; none if it is away."""
    out: list[dict] = []
    for n in sorted(os.listdir(path)) if os.path.isdir(path) else []:
        if n.endswith((".yaml", ".yml")):
            with open(os.path.join(path, n), encoding="utf-8") as f:
                try:
                    raw = yaml.safe_load(f)
                except yaml.YAMLError as e:
                    raise ValueError(f"Invalid rule file {path}/{n}: {e}") from e
            out += validate(os.path.join(path, n), raw)
    return out


def load(root: str | None = None) -> list[dict]:
    """Bundled rules, then the project's, by name; equal names are both kept."""
    return sorted([*BUNDLED, *(load_dir(os.path.join(root, RULE_DIR)) if root else [])], key=lambda r: r["name"].casefold())


def from_json(text: str) -> list[tuple]:
    """Match rows of an external matcher's JSON: places become 1-based. Empty text
    is no match."""
    rows = []
    for m in json.loads(text) if text.strip() else []:
        v = m.get("metaVariables") or {}
        captures = {k: [x["text"]] for k, x in (v.get("single") or {}).items()}
        captures |= {k: [y["text"] for y in x if y["text"] != ","] for k, x in (v.get("multi") or {}).items()}
        at = m["range"]["start"]
        rows.append((m["file"].replace("\\", "/"), at["line"] + 1, at["column"] + 1, captures))
    return rows


_CALL = re.compile(r"^(?:(\$?\w+)\.)?(\$?\w+)\((.*)\)$", re.S)
_TAG = re.compile(r"^<(\$?\w+)\s*(\$\$\$\w+)?\s*/>$")


def _split(t: list[Token], i: int, j: int) -> list[tuple[int, int]]:
    """Ranges between the commas of t[i:j] that no bracket holds."""
    out, start = [], i
    while i < j:
        if t[i].text in ("(", "[", "{", "${") and t[i].mate > i:
            i = t[i].mate
        elif t[i].text == ",":
            out.append((start, i))
            start = i + 1
        i += 1
    return [*out, (start, j)] if start < j else out


def find(source: str, pattern: str, jsx: bool) -> list[tuple[int, int, dict[str, list[str]]]]:
    """``(line, column, captures)`` of a call pattern ``[recv.]name(args)`` or a
    self-closing element ``<Name $$$ATTRS />``. ``$X`` is one balanced expression,
    ``$$$X`` the rest of a list; other words stand for themselves. Texts that
    can't be cut into tokens have no match."""
    try:
        t = tokens(source, jsx)
    except (SyntaxProblem, RecursionError):
        return []
    text = lambda i, j: source[t[i].start : t[j - 1].end] if j > i else ""
    out = []
    if m := _TAG.match(pattern.strip()):
        for i, x in enumerate(t):
            if x.kind != "jsx" or t[i - 1].text != "<" or not (m[1].startswith("$") or m[1] == x.text):
                continue
            j = i + 1
            while j < len(t) and t[j].text not in (">", "/>"):
                j = t[j].mate + 1 if t[j].text == "{" else j + 1
            if j < len(t) and t[j].text == "/>":
                captures = {m[1][1:]: [x.text]} if m[1].startswith("$") else {}
                if m[2]:
                    captures[m[2][3:]] = [text(k, k + 1) for k in range(i + 1, j) if t[k].kind == "text"]
                out.append((t[i - 1].line, t[i - 1].col, captures))
        return out
    m = _CALL.match(pattern.strip())
    if not m:
        raise ValueError(f"unsupported pattern {pattern!r}")
    wanted = [a.strip() for a in m[3].split(",")] if m[3].strip() else []
    for i, x in enumerate(t):
        if x.text != "(" or i == 0 or t[i - 1].kind != "name":
            continue
        name, first, captures = t[i - 1], i - 1, {}
        dotted = i >= 3 and t[i - 2].text == "."
        if bool(m[1]) != dotted:
            continue
        if m[1]:
            first = k = i - 3
            while k >= 0:
                if t[k].text in (")", "]") and t[k].mate >= 0:
                    k = t[k].mate - 1
                    first = k + 1
                    if k >= 0 and (t[k].kind == "name" or t[k].text in (")", "]")):
                        continue
                    break
                first = k
                if k >= 2 and t[k - 1].text in (".", "?."):
                    k -= 2
                    continue
                break
            recv = text(first, i - 2)
            if m[1].startswith("$"):
                captures[m[1][1:]] = [recv]
            elif recv != m[1]:
                continue
        if m[2].startswith("$"):
            captures[m[2][1:]] = [name.text]
        elif name.text != m[2]:
            continue
        args = _split(t, i + 1, x.mate)
        if _args(wanted, [text(a, b) for a, b in args], captures):
            out.append((t[first].line, t[first].col, captures))
    return out


def _args(wanted: list[str], args: list[str], captures: dict[str, list[str]]) -> bool:
    for n, w in enumerate(wanted):
        if w.startswith("$$$"):
            captures[w[3:]] = args[n:]
            return len(args) >= n
        if n >= len(args):
            return False
        if w.startswith("$"):
            captures[w[1:]] = [args[n]]
        elif w != args[n]:
            return False
    return len(args) == len(wanted)


def scan(files: DataFrame, rule: Mapping) -> DataFrame:
    """Matches of a rule in ``files(file, content)``, as the table MATCHES. A rule for
    tsx reads .tsx files only, one for typescript both."""
    own = files.where("content is not null")
    own = own.where(F.col("file").endswith(".tsx")) if rule["lang"] == "tsx" else own
    pattern = rule["pattern"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, line, col, list(c.items())) for f, s in zip(b["file"], b["content"], strict=True) for line, col, c in find(s, pattern, f.endswith(".tsx"))]
            yield pd.DataFrame([(f, line, col, dict(c)) for f, line, col, c in rows], columns=["file", "line", "col", "captures"])

    return own.select("file", "content").mapInPandas(run, MATCHES)
