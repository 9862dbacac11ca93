import pytest

from symgraph.sources.rules import BUNDLED, RULE_DIR, from_json, load, load_dir, validate


def rule(**produces):
    base = {"edge_kind": "routes_to", "from_capture": "H", "to_template": "x", "confidence": 0.9}
    return {"name": "n", "pattern": "p", "lang": "typescript", "produces": {k: v for k, v in (base | produces).items() if v is not None}}


@pytest.mark.parametrize(
    "raw, said",
    [
        ({}, "expected YAML array"),
        ([1], "expected object item"),
        ([{"pattern": "p"}], "missing name"),
        ([{"name": "n"}], "missing pattern"),
        ([{"name": "n", "pattern": "p"}], "missing lang"),
        ([{"name": "n", "pattern": "p", "lang": "l"}], "missing produces.edge_kind"),
        ([rule(edge_kind="calls")], "unsupported produces.edge_kind calls"),
        ([rule(confidence="high")], "missing produces.confidence"),
        ([rule(from_context="enclosing_function")], "exactly one of produces.from_capture or produces.from_context"),
        ([rule(to_capture="C")], "exactly one of produces.to_capture or produces.to_template"),
        ([rule(from_capture=None, from_context="file")], "unsupported produces.from_context file"),
    ],
)
def test_each_error_names_the_file(raw, said):
    with pytest.raises(ValueError, match="Invalid rule file r.yaml: ") as e:
        validate("r.yaml", raw)
    assert said in str(e.value)


def test_directories(tmp_path):
    assert load_dir(str(tmp_path / "none")) == []
    d = tmp_path / RULE_DIR
    d.mkdir(parents=True)
    (d / "a.yml").write_text("- {name: a, pattern: 'f($X)', lang: typescript, produces: {edge_kind: renders, from_context: enclosing_function, to_capture: X, confidence: 1}}")
    (d / "b.txt").write_text("[")
    assert [r["name"] for r in load(str(tmp_path))] == ["a", *(r["name"] for r in BUNDLED)]
    (d / "bad.yaml").write_text("[")
    with pytest.raises(ValueError, match="bad.yaml"):
        load(str(tmp_path))


def test_matcher_json():
    text = '[{"file": "a\\\\b.ts", "range": {"start": {"line": 0, "column": 2}}, "metaVariables": {"single": {"X": {"text": "x"}}, "multi": {"Y": [{"text": "1"}, {"text": ","}, {"text": "2"}]}}}]'
    assert from_json(text) == [("a/b.ts", 1, 3, {"X": ["x"], "Y": ["1", "2"]})] and from_json(" ") == []
