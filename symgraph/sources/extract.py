"""Structure of TypeScript files: functions, classes, interfaces, imports, calls."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions import UNRESOLVED
from symgraph.schema import EDGE_COLS, EDGES, NODE_COLS, NODES, PARSE_CONFIDENCE
from symgraph.sources.lexer import SyntaxProblem, Token, tokens

_KEYWORDS = set("if for while switch catch return typeof function new super import await async yield in of do else case throw void delete instanceof with class interface extends const let var export default constructor this".split())
_EXPRESSION = set("= ( , : ? => && || ?? ! [ + - * / % & | ^ < > == === != !== += ...".split()) | {"return", "new", "typeof", "await", "yield", "case", "in", "of", "throw", "void", "delete"}
_MODIFIERS = set("public private protected static async get set readonly override abstract declare *".split())


@dataclass
class Found:
    """A named piece with its token range."""

    kind: str
    name: str
    first: int
    last: int
    line: int
    end: int


class Extractor:
    def __init__(self, file: str, source: str):
        self.t = tokens(source, file.endswith(".tsx"))
        self.found: list[Found] = []
        self.class_bodies: set[int] = set()
        self.type_bodies: list[tuple[int, int]] = []

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def statement(self, i: int) -> bool:
        """Whether a declaration may begin at token i."""
        p = self.text(i - 1)
        return i == 0 or p not in _EXPRESSION or self.t[i - 1].kind == "string"

    def angle(self, i: int) -> int:
        """Past type arguments that begin at i, or i if there are none."""
        if self.text(i) != "<":
            return i
        depth = 0
        for j in range(i, min(len(self.t), i + 400)):
            x = self.t[j]
            if x.text == "<":
                depth += 1
            elif x.text == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif x.text in (";", "&&", "||", "==", "===") or (x.text in (")", "]", "}") and x.mate < i):
                return i
        return i

    def parameters(self, i: int) -> bool:
        """Whether the parenthesis at i holds parameters, not a type."""
        j = i + 1
        if self.text(j) == ")" or self.text(j) == "...":
            return True
        after = self.t[j].mate + 1 if self.text(j) in ("{", "[") else j + 1
        return self.text(after) in (":", "?", ",")

    def past_type(self, i: int) -> int:
        """Past a type that begins at i: up to a brace, arrow or end after it. An arrow
        goes on with the type only where parameters stand before it."""
        need, params = True, False
        while i < len(self.t):
            x = self.t[i]
            if need and x.text in ("{", "(", "["):
                params = x.text == "(" and self.parameters(i)
                i, need = x.mate + 1, False
            elif x.text == "[" or (x.text == "(" and self.text(i - 1) in (">", "new", "import")):
                params = x.text == "(" and self.text(i - 1) != "import"
                i, need = x.mate + 1, False
            elif x.text == "<" and self.angle(i) > i:
                i, need, params = self.angle(i), False, False
            elif x.text == "=>":
                if need or not params:
                    return i
                i, need, params = i + 1, True, False
            elif x.text in ("|", "&", ".", "keyof", "typeof", "is", "asserts", "readonly", "extends", "infer"):
                i, need, params = i + 1, True, False
            elif need and x.kind in ("name", "string", "number"):
                i, need, params = i + 1, False, False
            else:
                return i
        return i

    def body_after(self, i: int) -> int:
        """The opening brace of the body of a function whose parameters begin at or
        after i (type parameters first), or -1."""
        i = self.angle(i)
        if self.text(i) != "(":
            return -1
        i = self.t[i].mate + 1
        if self.text(i) == ":":
            i = self.past_type(i + 1)
        return i if self.text(i) == "{" else -1

    def expression_end(self, i: int) -> int:
        """The last token of the expression that begins at i."""
        depth_end = len(self.t)
        last = i
        while i < depth_end:
            x = self.t[i]
            if x.text in (";", ",") or (x.text in (")", "]", "}") and x.mate < i):
                break
            if i > last and x.line > self.t[last].line and self.text(last) not in _EXPRESSION and x.text not in (".", "?.", "?", ":", "&&", "||", "??", "+", "-", "*", "/", "(", "[", "=", "=>"):
                break
            last = x.mate if x.text in ("(", "[", "{", "${") else i
            i = last + 1
        return last

    def arrow(self, i: int) -> int:
        """The last token of an arrow function that begins at i, or -1."""
        if self.text(i) == "async" and self.text(i + 1) != "=>":
            i += 1
        i = self.angle(i)
        if self.text(i) == "(":
            j = self.t[i].mate + 1
            if self.text(j) == ":":
                j = self.past_type(j + 1)
        elif i < len(self.t) and self.t[i].kind == "name":
            j = i + 1
        else:
            return -1
        if self.text(j) != "=>":
            return -1
        return self.t[j + 1].mate if self.text(j + 1) == "{" else self.expression_end(j + 1) if j + 1 < len(self.t) else -1

    def declare(self) -> None:
        for i, x in enumerate(self.t):
            if x.kind != "name" or self.text(i - 1) in (".", "?."):
                continue
            if x.text == "function" and i + 1 < len(self.t) and self.t[i + 1].kind == "name":
                first = i - 1 if self.text(i - 1) == "async" else i
                if self.statement(first) and (body := self.body_after(i + 2)) >= 0:
                    self._put("function", i + 1, first, self.t[body].mate)
            elif x.text in ("class", "interface") and i + 1 < len(self.t):
                body = next((j for j in range(i + 1, min(len(self.t), i + 300)) if self.t[j].text == "{" and self.text(j - 1) not in ("<", ",", ":")), -1)
                named = self.t[i + 1].kind == "name" and self.t[i + 1].text != "extends"
                if body < 0 or (x.text == "interface" and not named):
                    continue
                if x.text == "class":
                    self.class_bodies.add(body)
                else:
                    self.type_bodies.append((body, self.t[body].mate))
                if named and self.statement(i) and self.text(i - 1) != "abstract":
                    self._put(x.text, i + 1, i, self.t[body].mate)
            elif x.text in ("const", "let", "var") and self.text(i + 1) != "enum":
                self._declarators(i + 1)

    def _put(self, kind: str, name: int, first: int, last: int) -> None:
        self.found.append(Found(kind, self.t[name].text, first, last, self.t[first].line, self.t[last].line))

    def _declarators(self, i: int) -> None:
        while i < len(self.t):
            x = self.t[i]
            j = x.mate + 1 if x.text in ("{", "[") else i + 1
            if self.text(j) == "!":
                j += 1
            if self.text(j) == ":":
                j = self.past_type(j + 1)
            if self.text(j) != "=":
                if self.text(j) != ",":
                    return
                i = j + 1
                continue
            if x.kind == "name" and (end := self.arrow(j + 1)) >= 0:
                self._put("function", i, i, end)
            last = self.expression_end(j + 1) if j + 1 < len(self.t) else j
            if self.text(last + 1) != ",":
                return
            i = last + 2

    def imports(self) -> Iterator[tuple[str, str]]:
        """(imported name, quoted module) pairs."""
        for i, x in enumerate(self.t):
            if x.text != "import" or x.kind != "name" or not self.statement(i) or self.text(i + 1) in ("(", "."):
                continue
            j = i + 1
            if self.t[j].kind == "string":
                continue
            if self.text(j) == "type" and self.text(j + 1) not in (",", "from"):
                j += 1
            names: list[str] = []
            if self.t[j].kind == "name":
                names.append("default")
                j += 1 + (self.text(j + 1) == ",")
            if self.text(j) == "{":
                k, end = j + 1, self.t[j].mate
                while k < end:
                    if self.text(k) == "type" and self.t[k + 1].kind == "name" and self.text(k + 1) != "as":
                        k += 1
                    names.append(self.text(k))
                    while k < end and self.text(k) != ",":
                        k += 1
                    k += 1
                j = end + 1
            elif self.text(j) == "*":
                j += 3
            if self.text(j) == "from" and j + 1 < len(self.t) and self.t[j + 1].kind == "string":
                yield from ((n, self.t[j + 1].text) for n in names)

    def calls(self) -> Iterator[tuple[int, Token]]:
        """(token index, callee) of calls and constructions by a bare name."""
        parent, stack = [-1] * len(self.t), []
        for i, x in enumerate(self.t):
            parent[i] = stack[-1] if stack else -1
            if x.mate > i:
                stack.append(i)
            elif 0 <= x.mate < i and stack:
                stack.pop()
                parent[i] = stack[-1] if stack else -1
        for i, x in enumerate(self.t):
            if x.kind != "name" or x.text in _KEYWORDS or self.text(i - 1) in (".", "?.", "function", "class", "interface", "#"):
                continue
            if any(a < i < b for a, b in self.type_bodies):
                continue
            if self.text(i - 1) == "new":
                if self.text(i + 1) != ".":
                    yield i, x
                continue
            if self.text(i - 1) == "*" and self.text(i - 2) == "function":
                continue
            j = self.angle(i + 1)
            if self.text(j) == "?." and self.text(j + 1) == "(":
                j += 1
            if self.text(j) != "(":
                continue
            after = self.text(self.t[j].mate + 1)
            before = self.text(i - 1)
            if parent[i] in self.class_bodies and (before in ("{", "}", ";") or before in _MODIFIERS or self.t[i - 1].line < x.line and before not in _EXPRESSION):
                continue
            if after == "{" and (before in ("{", ",") or before in _MODIFIERS) and parent[i] >= 0:
                continue  # a method of an object
            yield i, x

    def caller(self, i: int) -> Found | None:
        inside = [f for f in self.found if f.kind == "function" and f.first <= i <= f.last]
        return max(inside, key=lambda f: (f.first, -f.last), default=None)


def extract(file: str, content: str, now: int = 0) -> tuple[list[tuple], list[tuple]]:
    """Node and edge rows of a file: the module always; nothing else where the text
    can't be cut into balanced tokens."""
    digest = hashlib.sha256(content.encode()).hexdigest()
    module = (f"{file}::{file}:1", "module", file, file, 1, len(re.split(r"\r?\n", content)), digest)
    try:
        x = Extractor(file, content)
        x.declare()
        nodes = [module, *((f"{file}::{f.name}:{f.line}", f.kind, f.name, file, f.line, f.end, digest) for f in sorted(x.found, key=lambda f: f.first))]
        edges: dict[tuple, tuple] = {}

        def put(source: str, name: str, kind: str, evidence: str) -> None:
            row = (source, f"{UNRESOLVED}{name}:0", kind, "tree-sitter", PARSE_CONFIDENCE, evidence, digest, now)
            edges.setdefault(row[:4], row)

        for name, where in x.imports():
            put(module[0], name, "imports", where)
        for i, t in x.calls():
            if f := x.caller(i):
                put(f"{file}::{f.name}:{f.line}", t.text, "calls", f"{t.text}:{t.line}:{t.col}")
        return nodes, list(edges.values())
    except (SyntaxProblem, IndexError, RecursionError):
        return [module], []


def extract_files(files: DataFrame, now: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``files(file, content)``; files without content give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, content in zip(b["file"], b["content"], strict=True):
                if content is not None:
                    n, e = extract(file, content, now)
                    rows.append({"nodes": [dict(zip(NODE_COLS, r, strict=True)) for r in n], "edges": [dict(zip(EDGE_COLS, r, strict=True)) for r in e]})
            yield pd.DataFrame(rows, columns=["nodes", "edges"])

    node = ",".join(f"{a}:{b}" for a, b in (c.split() for c in NODES.split(", ")))
    edge = ",".join(f"{a}:{b}" for a, b in (c.split() for c in EDGES.split(", ")))
    out = files.select("file", "content").mapInPandas(run, f"nodes array<struct<{node}>>, edges array<struct<{edge}>>")
    return out.select(F.inline("nodes")), out.select(F.inline("edges"))
