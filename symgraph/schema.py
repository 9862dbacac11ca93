"""Tables, enumerations and constants of the graph."""

from __future__ import annotations

NODES = "id string, kind string, name string, file string, start_line int, end_line int, content_hash string"
EDGES = "source string, target string, kind string, provenance_source string, confidence double, evidence string, content_hash string, created_at bigint"
FILE_HASHES = "file string, hash string, indexed_at bigint"
#: Answers of symbol lookups, by request.
LOOKUPS = "kind string, file string, line int, col int, status string, def_file string, def_line int, def_col int"
#: Matches of structural patterns; a single capture is a list of one.
MATCHES = "file string, line int, col int, captures map<string,array<string>>"
FILES = "file string, content string, error string"

EDGE_KEY = ["source", "target", "kind", "provenance_source"]
NODE_COLS = [c.split()[0] for c in NODES.split(", ")]
EDGE_COLS = [c.split()[0] for c in EDGES.split(", ")]
NODE_KINDS = ("function", "class", "interface", "module", "endpoint", "test")
EDGE_KINDS = ("calls", "imports", "implements", "extends", "tested_by", "co_changes_with", "renders", "routes_to")
PROVENANCES = ("tree-sitter", "lsp", "ast-grep", "coverage", "git", "agent")
CHANGES = ("signature_change", "removal", "behavior_change", "addition")
PARSE_CONFIDENCE, LOOKUP_CONFIDENCE, AGENT_CONFIDENCE, MARKER_CONFIDENCE = 0.5, 0.9, 0.7, 1.0
SECTION_LIMIT, IMPACT_DEPTH = 10, 5
SCHEMA_VERSION = 1
