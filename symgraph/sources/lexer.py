"""A lexer for TypeScript and TSX: tokens with places and matched brackets."""

from __future__ import annotations

import re
from dataclasses import dataclass

_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[^\W\d][\w$]*|[$_][\w$]*|#[\w$]+")
_NUMBER = re.compile(r"\d[\w.]*")
_PUNCT = re.compile(r"=>|\?\.(?!\d)|\.\.\.|[=!]==?|[<>]=|&&=?|\|\|=?|\?\?=?|\*\*=?|\+\+|--|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
#: After these a slash begins a regular expression and < may begin an element.
_OPERATORS = set("( , = : [ ! & | ? { } ; + - * % ~ ^ => && || ?? == != === !== += -= < > <= >= ...".split())
_WORDS = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "instanceof", "await", "yield", "default"}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")", "]", "}"}


class SyntaxProblem(ValueError):
    """A text that can't be cut into balanced tokens."""


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, regex, punct, jsx, text
    text: str
    line: int
    col: int
    start: int
    end: int
    mate: int = -1


class Lexer:
    def __init__(self, source: str, jsx: bool):
        self.s, self.jsx, self.at, self.out = source, jsx, 0, []
        self.stack: list[int] = []
        self.starts = [0, *(m.end() for m in re.finditer(r"\n", source))]
        self.row = 0

    def run(self) -> list[Token]:
        self._code(None)
        if self.stack:
            raise SyntaxProblem("unclosed bracket")
        return self.out

    def _add(self, kind: str, end: int) -> Token:
        while self.row + 1 < len(self.starts) and self.starts[self.row + 1] <= self.at:
            self.row += 1
        t = Token(kind, self.s[self.at : end], self.row + 1, self.at - self.starts[self.row] + 1, self.at, end)
        self.out.append(t)
        self.at = end
        return t

    def _open(self, end: int) -> None:
        self._add("punct", end)
        self.stack.append(len(self.out) - 1)

    def _shut(self) -> None:
        if not self.stack or OPEN[self.out[self.stack[-1]].text] != self.s[self.at]:
            raise SyntaxProblem("brackets don't match")
        t, o = self._add("punct", self.at + 1), self.stack.pop()
        self.out[o].mate, t.mate = len(self.out) - 1, o

    def _before_operand(self) -> bool:
        if not self.out:
            return True
        p = self.out[-1]
        return (p.kind == "punct" and p.text in _OPERATORS or p.text == "${") or (p.kind == "name" and p.text in _WORDS)

    def _code(self, until: str | None) -> None:
        """Tokens up to the closing brace of the depth it began at, if ``until``."""
        s, depth = self.s, len(self.stack)
        while self.at < len(s):
            if m := _SPACE.match(s, self.at):
                self.at = m.end()
                continue
            c = s[self.at]
            if s.startswith("//", self.at):
                end = s.find("\n", self.at)
                self.at = len(s) if end < 0 else end
            elif s.startswith("/*", self.at):
                end = s.find("*/", self.at + 2)
                if end < 0:
                    raise SyntaxProblem("comment without end")
                self.at = end + 2
            elif self.at == 0 and s.startswith("#!"):
                self.at = max(s.find("\n"), 0) or len(s)
            elif c in "'\"":
                self._string(c)
            elif c == "`":
                self._template()
            elif c == "/" and self._before_operand() and (m := _REGEX.match(s, self.at)):
                self._add("regex", m.end())
            elif c == "<" and self.jsx and self._before_operand() and re.match(r"<(?:[A-Za-z_$]|>)", s[self.at : self.at + 2]) and not re.match(r"<\w+\s*(?:,|extends\b)", s[self.at : self.at + 80]):
                self._element()
            elif m := _NAME.match(s, self.at):
                self._add("name", m.end())
            elif m := _NUMBER.match(s, self.at):
                self._add("number", m.end())
            elif c in OPEN:
                self._open(self.at + 1)
            elif c in CLOSE:
                if until and len(self.stack) == depth and c == until:
                    return
                self._shut()
            elif m := _PUNCT.match(s, self.at):
                self._add("punct", m.end())
            else:
                raise SyntaxProblem(f"character {c!r}")
        if until:
            raise SyntaxProblem("unclosed brace")

    def _string(self, quote: str) -> None:
        m = re.compile(rf"{quote}(?:[^\\{quote}\n]|\\[\s\S])*{quote}").match(self.s, self.at)
        if not m:
            raise SyntaxProblem("string without end")
        self._add("string", m.end())

    def _template(self) -> None:
        part = re.compile(r"(?:[^\\`$]|\\[\s\S]|\$(?!\{))*")
        end = part.match(self.s, self.at + 1).end()
        self._add("string", end)
        while self.s.startswith("${", self.at):
            self._open(self.at + 2)
            self._code("}")
            self._shut()
            self._add("text", part.match(self.s, self.at).end())
        if not self.s.startswith("`", self.at):
            raise SyntaxProblem("template without end")
        self.at += 1

    def _element(self) -> None:
        """<Name attrs /> or <Name attrs>children</Name>; kind jsx marks the name."""
        self._add("punct", self.at + 1)
        name = ""
        if m := _JSX_NAME.match(self.s, self.at):
            name = m.group()
            self._add("jsx", m.end())
        while True:
            if m := _SPACE.match(self.s, self.at):
                self.at = m.end()
            if self.s.startswith("/>", self.at):
                self._add("punct", self.at + 2)
                return
            if self.at >= len(self.s):
                raise SyntaxProblem("tag without end")
            c = self.s[self.at]
            if c == ">":
                self._add("punct", self.at + 1)
                break
            if c == "{":
                self._open(self.at + 1)
                self._code("}")
                self._shut()
            elif c in "'\"":
                end = self.s.find(c, self.at + 1)
                if end < 0:
                    raise SyntaxProblem("attribute without end")
                self._add("string", end + 1)
            elif c == "=":
                self._add("punct", self.at + 1)
            elif m := _JSX_NAME.match(self.s, self.at):
                self._add("text", m.end())
            else:
                raise SyntaxProblem("tag")
        while True:
            m = re.compile(r"[^<{]*").match(self.s, self.at)
            if m.end() > self.at:
                self._add("text", m.end())
            if self.at >= len(self.s):
                raise SyntaxProblem("element without end")
            if self.s[self.at] == "{":
                self._open(self.at + 1)
                self._code("}")
                self._shut()
            elif m := re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>").match(self.s, self.at):
                if (m.group(1) or "") != name:
                    raise SyntaxProblem("tags don't match")
                self._add("text", m.end())
                return
            else:
                self._element()


def tokens(source: str, jsx: bool) -> list[Token]:
    return Lexer(source, jsx).run()
