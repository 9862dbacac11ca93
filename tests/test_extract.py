from hypothesis import given, settings
from hypothesis import strategies as st

from symgraph.sources.extract import extract
from symgraph.sources.lexer import SyntaxProblem, tokens
from symgraph.sources.rules import find


def names(source, file="a.ts"):
    n, e = extract(file, source)
    return [(r[1], r[2], r[4], r[5]) for r in n[1:]], [(r[0].split("::")[1], r[1].split("::")[1], r[2], r[5]) for r in e]


def test_declarations_and_lines():
    n, _ = names("function a() {\n}\nclass B {\n  m() {}\n}\ninterface I { f(): void }\nconst c = (x: number) =>\n  x + 1\nabstract class D {}\nfunction* g() {}\nconst h = function () {}\n")
    assert n == [("function", "a", 1, 2), ("class", "B", 3, 5), ("interface", "I", 6, 6), ("function", "c", 7, 8)]


def test_arrows_with_return_types():
    n, e = names(
        "const a = (x: number): void => { g(x) }\nconst b = async (): Promise<Map<string, void>> => { g2() }\nconst c = (x): { y: number } => h(x)\n"
        "const d = (x: A): x is B => k(x)\nconst f = (x): (y: number) => void => (y) => m(y)\nconst o = (x): (A | B) => { p(x) }\nconst q = <T,>(x: T): T[] => r(x)\n"
        "const s = (): (() => void) => { t() }\nconst u = (x: (y: A) => B): typeof x => { v() }\nconst w = (): readonly string[] | null => z()\n"
    )
    assert [x[1] for x in n] == ["a", "b", "c", "d", "f", "o", "q", "s", "u", "w"] and all(x[0] == "function" for x in n)
    assert [(s.split(":")[0], t.split(":")[0]) for s, t, *_ in e] == [("a", "g"), ("b", "g2"), ("c", "h"), ("d", "k"), ("f", "m"), ("o", "p"), ("q", "r"), ("s", "t"), ("u", "v"), ("w", "z")]


def test_calls_belong_to_the_nearest_function():
    _, e = names("function a() {\n  b(); o.m();\n  new K();\n  const f = () => d();\n  [1].map((x) => e(x));\n}\ntop();\n")
    assert e == [("a:1", "b:0", "calls", "b:2:3"), ("a:1", "K:0", "calls", "K:3:7"), ("f:4", "d:0", "calls", "d:4:19"), ("a:1", "e:0", "calls", "e:5:18")]


def test_first_call_of_a_pair_counts():
    assert names("function a() { b();\nb(); }")[1] == [("a:1", "b:0", "calls", "b:1:16")]


def test_imports():
    _, e = names("import d, { x as y, type T } from 'm'\nimport * as n from 'k'\nimport 's'\n")
    assert [(t, ev) for _, t, _, ev in e] == [("default:0", "'m'"), ("x:0", "'m'"), ("T:0", "'m'")]


def test_broken_text_gives_the_module_only():
    for source in ("function a( {", "const s = 'x", "/* open", "`${a`"):
        assert extract("a.ts", source)[0][0][1] == "module" and len(extract("a.ts", source)[0]) == 1


def test_strings_templates_regexes_hide_calls():
    _, e = names("function a() { return 'b()' + /c()'/.source + `d() ${f(`${g()}`)}` } // h()")
    assert [t for _, t, *_ in e] == ["f:0", "g:0"]


def test_tsx_text_may_hold_quotes():
    n, e = names("const A = () => <div a='1'>don't {b()} <C d={e()} /></div>\nfunction f() { g() }\n", "a.tsx")
    assert [x[1] for x in n] == ["A", "f"] and [t for _, t, *_ in e] == ["b:0", "e:0", "g:0"]


def test_line_count_of_the_module():
    assert extract("a.ts", "a\r\nb\n")[0][0][5] == 3


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab(){}[]<>=;:,.'\"`$/\\ \n*", max_size=60))
def test_any_text_is_cut_or_refused(source):
    try:
        t = tokens(source, True)
        assert all(x.mate < 0 or t[x.mate].mate == i for i, x in enumerate(t))
    except SyntaxProblem:
        pass
    assert extract("x.tsx", source)[0]


def test_matcher():
    got = find("app.get('/x', a, b)\nexpress.Router().post(p)\nget(1)", "$APP.$METHOD($PATH, $$$HANDLERS)", False)
    assert got == [(1, 1, {"APP": ["app"], "METHOD": ["get"], "PATH": ["'/x'"], "HANDLERS": ["a", "b"]}), (2, 1, {"APP": ["express.Router()"], "METHOD": ["post"], "PATH": ["p"], "HANDLERS": []})]
    assert find("const a = <B c={1} />", "<$COMPONENT $$$ATTRS />", True) == [(1, 11, {"COMPONENT": ["B"], "ATTRS": ["c"]})]
