import json

import pytest

from lintlake import api
from lintlake.__main__ import main


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "a.py").write_text("import os\ndef token_for(u):\n    return eval(u)\ndef other():\n    token_for(1)\n")
    (tmp_path / "b.go").write_text("package b\n")
    return str(tmp_path)


def test_review_code(spark):
    got = api.review_code(spark, "q = input()\neval(q)\n")
    assert {f["category"] for f in got["findings"]} == {"security"} and got["findings"][0]["severity"] == "critical"
    # One finding of 20 points, and 10 points for flat code with short functions.
    assert got["score"] == 90 and got["n_critical"] == 1
    assert api.review_code(spark, "", "rust")["findings"] is None


def test_command_line(spark, tree, tmp_path, capsys):
    assert main([tree, "--json", str(tmp_path / "out")]) == 1
    said = capsys.readouterr().out
    assert "PY003" in said and "1 critical" in said
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.txt") for x in f.read_text().splitlines()]
    assert {"PY003", "PY009"} <= {x["rule_id"] for x in lines}
    assert main([tree, "--disable", "PY003", "--min-severity", "high"]) == 0
    assert main([tree, "--fail-on", "never", "--quiet", "--rules-only"]) == 0
    said = capsys.readouterr().out
    assert "PY003" in said and "1 critical" not in said


def test_settings_act(spark, tree, tmp_path, monkeypatch):
    import sys
    import types

    from lintlake.__main__ import _glob

    (tmp_path / "lintlake.yaml").write_text("x")
    raw = {"ignore": {"paths": ["b.*"], "rules": ["PY003"]}, "review": {"severity_threshold": "high"}}
    monkeypatch.setitem(sys.modules, "yaml", types.SimpleNamespace(safe_load=lambda text: raw, YAMLError=ValueError))
    assert main([tree]) == 0  # no finding is left that is high
    raw["ignore"] = {"paths": ["*.py"], "rules": []}
    assert main([tree]) == 0
    import re

    cases = [("a/*.py", "x/a/b.py", True), ("a/*.py", "x/a/c/b.py", False), ("a/**", "x/a/c/b.py", True), ("a?.py", "ab.py", True), ("a.py", "xa.py", False)]
    assert all(bool(re.search(_glob(p), t)) == want for p, t, want in cases)


def test_fixed_values():
    from lintlake.sources import files

    assert set(files.SKIPPED) == {"node_modules", "vendor", "__pycache__", ".git", "dist", "build", ".venv", "venv", ".tox", ".mypy_cache"}
    assert dict(files.BY_SHEBANG) == {"python": "python", "node": "javascript", "bun": "javascript", "deno": "typescript"}


def test_query_codebase(spark, tree):
    found = api.query_codebase(spark, tree, ["token_for"])
    assert [r["name"] for r in found["siblings"].collect()] == ["other"]
    assert [r["kind"] for r in found["callers"].collect()] == ["module"]
