"""Custom rules, model-based reviewers, stored results, reports, settings, and calls."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lintlake import api
from lintlake.functions import rulebook
from lintlake.functions.predicates import Has
from lintlake.operators import agents, pulls, review, rules, store, structure
from lintlake.sources import config, files as sources



def now(hours=0):
    return F.lit(dt.datetime(2026, 1, 1) + dt.timedelta(hours=hours))


def _files(spark, *rows):
    return spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(rows)], "file_id bigint, language string, code string")


@pytest.fixture
def custom():
    def check(code, language):
        if "boom" in code:
            raise ValueError
        return [(i + 1, None, "low" if language == "go" else None) for i, line in enumerate(code.split("\n")) if "frobnicate" in line]

    rulebook.register(rulebook.Rule("X001", ("python",), "high", "quality", 0.7, "Uses frotz", Has("frotz")))
    rulebook.register(rulebook.Rule("X002", ("python", "go"), "medium", "style", 0.6, "Frobnicates", kind="function", check=check))
    yield
    rulebook.unregister("X001")
    rulebook.unregister("X002")


def test_custom_rules(spark, custom):
    with pytest.raises(ValueError):
        rulebook.register(rulebook.Rule("X001", ("python",), "low", "style", 0.5, "again"))
    files = _files(spark, ("python", "a = frotz\nfrobnicate()"), ("go", "frobnicate()"), ("python", "boom frobnicate"), ("rust", "frotz frobnicate"))
    got = rules.raw_findings(files).where("rule_id like 'X%'").select("file_id", "rule_id", "line_start", "severity", "title", "category").collect()
    assert sorted(map(tuple, got)) == [(0, "X001", 1, "high", "Uses frotz", "quality"), (0, "X002", 2, "medium", "Frobnicates", "style"), (1, "X002", 1, "low", "Frobnicates", "style")]
    assert rules.raw_findings(files, disabled=("X001", "X002")).where("rule_id like 'X%'").count() == 0


def test_agents(spark):
    files = _files(spark, ("python", "x = 1"), ("go", "package a"))
    answer = {"findings": [{"severity": "High", "category": "performance", "title": "slow", "line_start": 1, "confidence": 7}, {"severity": "odd", "title": "no"}]}

    def model(rows):
        return rows.withColumn("answer", F.when(F.col("language") == "python", F.lit("```json\n" + json.dumps(answer) + "\n```")).otherwise("no json"))

    got = agents.run_agents(files, {a: model for a in agents.AGENTS}).collect()
    assert sorted((r["agent"], r["file_id"], r["severity"], r["category"], r["confidence"]) for r in got) == [("docs", 0, "high", "documentation", 1.0), ("quality", 0, "high", "performance", 1.0), ("security", 0, "high", "security", 1.0)]
    assert agents.run_agents(files, {}).count() == agents.run_agents(files, {"docs": agents.offline}).count() == 0


def test_summary_of_pull_requests(spark):
    heads = spark.createDataFrame([(1, "Add x", None), (2, "Other", "why")], "pull_id bigint, title string, body string")
    changed = spark.createDataFrame([(1, i, f"f{i}.py", 1, 0, "\n".join(map(str, range(50))) if i else None) for i in range(20)], "pull_id bigint, ord int, filename string, additions int, deletions int, patch string")
    prompt = {r["pull_id"]: r["prompt"] for r in agents.summary_prompt(heads, changed).collect()}
    assert prompt[1].count("File ") == 15 and "no patch" in prompt[1] and "\n29\n\n" in prompt[1] and "\n30\n" not in prompt[1] and "none given" in prompt[1]
    plain = {r["pull_id"]: r for r in agents.summarise_pulls(heads, changed).collect()}
    assert plain[1]["summary"] == "PR modifies 20 file(s)." and len(plain[1]["walkthrough"]) == 10 and plain[2]["summary"] == "PR modifies 0 file(s)."
    said = agents.summarise_pulls(heads, changed, lambda rows: rows.withColumn("answer", F.lit('{"summary": "s", "change_type": "docs", "risk": "low", "walkthrough": [{"file": "a", "change": "b"}]}')))
    assert {(r["summary"], r["change_type"], len(r["walkthrough"])) for r in said.collect()} == {("s", "docs", 1)}


def test_reports_and_posts(spark, tmp_path):
    scored = spark.createDataFrame([(1, 0, "a.py", 90, 2, 1, 0, 0, 1), (1, 1, "b.py", None, 0, 0, 0, 0, 0)], "pull_id bigint, ord int, filename string, score int, n_findings int, n_critical int, n_high int, n_medium int, n_low int")
    found = spark.createDataFrame([(1, 0, "a.py", "critical", "security", "t", "d", "do", None, 0.9), (1, 0, "a.py", "low", "quality", "u", "e", None, 3, 0.5)], "pull_id bigint, ord int, filename string, severity string, category string, title string, description string, suggestion string, line_start int, confidence double")
    summary = agents.summarise_pulls(spark.createDataFrame([(1, "x", "y")], "pull_id bigint, title string, body string"), scored.withColumns({"additions": F.lit(1), "deletions": F.lit(0), "patch": F.lit("")}))
    body = pulls.report(scored, found, summary, spark.createDataFrame([(1, 4)], "pull_id bigint, skipped bigint")).first()["body"]
    for part in ("| `a.py` | 🟢 90/100 | 1 | — | — | 1 |", "| `b.py` | — | — | — | — | — |", "**2 finding(s)** across 1 file(s)", "**`a.py`** 🔴 **t**", "> 💡 do", "*4 more file(s) were not reviewed.*", "**Type:** unknown", "| `b.py` | Modified |"):
        assert part in body, part
    comments = pulls.inline_comments(found.withColumn("file_id", F.col("ord")))
    assert [r["body"] for r in comments.collect()] == ["🔵 **[LOW/QUALITY]** u\n\ne\n\n*Confidence: 50%*"]
    bodies = spark.createDataFrame([(1, "sha", "hello")], "pull_id bigint, commit_sha string, body string")
    lines = comments.select(F.lit(1).cast("bigint").alias("pull_id"), F.lit("a.py").alias("path"), F.col("line_start").alias("line"), "body")
    sent = json.loads(pulls.review_payloads(bodies, lines).first()["json"])
    assert (sent["event"], sent["commit_id"], sent["comments"][0]["line"], sent["comments"][0]["side"]) == ("COMMENT", "sha", 3, "RIGHT")
    out = str(tmp_path)

    def send(pull_id, payload):
        with open(f"{out}/{pull_id}", "w") as f:
            f.write(payload)

    pulls.post(pulls.comment_payloads(bodies), send)
    assert json.loads((tmp_path / "1").read_text()) == {"body": "hello"}


def test_store(spark, tmp_path):
    at = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, payload string")
    store.save(rows, at, now(), 7200)
    store.save(rows.where("key = 'a'").withColumn("payload", F.lit("3")), at, now(1), 7200)
    assert {(r["key"], r["payload"]) for r in store.load(spark, at, now(1)).collect()} == {("a", "3"), ("b", "2")}
    assert [r["review_id"] for r in store.recent(spark, at, now(1), 1).collect()] == ["a"]
    store.delete(spark, at, ["b"], now(1))
    assert [r["key"] for r in store.load(spark, at, now(1)).collect()] == ["a"]
    assert store.load(spark, at, now(3)).count() == 0
    store.compact(spark, at, at + "2", now(1))
    assert spark.read.parquet(at + "2").count() == 1


def test_cache(spark, tmp_path):
    at = str(tmp_path / "cache")
    files = _files(spark, ("python", "x"), ("python", "x"), ("go", "x"))
    store.cache_reviews(files.where("language = 'python'").withColumn("score", F.lit(7)), at, now())
    got = {r["file_id"]: (r["cached"], r["payload"]) for r in store.cached_reviews(files, at, now()).collect()}
    assert got[0] == got[1] == (True, '{"language":"python","score":7}') and got[2] == (False, None)
    assert not any(r["cached"] for r in store.cached_reviews(files, at, now(2)).collect())


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.delenv(config.VARIABLE, raising=False)
    assert config.load_config(str(tmp_path)) is None
    (tmp_path / ".lintlake.yaml").write_text("review:\n  max_findings: 5\nignore:\n  rules: [PY001]\n")
    found = config.load_config(str(tmp_path))
    assert found["review"] == {"agents": [], "severity_threshold": "low", "max_findings": 5} and found["ignore"]["rules"] == ["PY001"]
    (tmp_path / "lintlake.yaml").write_text("- no mapping")
    assert config.load_config(str(tmp_path)) is None
    (tmp_path / "named.yaml").write_text("review: {max_findings: many}")
    monkeypatch.setenv(config.VARIABLE, str(tmp_path / "named.yaml"))
    assert config.load_config(str(tmp_path)) is None
    (tmp_path / "named.yaml").write_text("rules: [")
    assert config.load_config(str(tmp_path)) is None


def test_calls(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = eval(y)\n")
    got = api.analyze_file(spark, str(tmp_path / "a.py"))
    assert got["score"] < 100 and got["file_path"].endswith("a.py") and got["findings"]
    assert "not found" in api.analyze_file(spark, str(tmp_path / "b.py"))["error"] and "Not a file" in api.analyze_file(spark, str(tmp_path))["error"]
    assert {f["severity"] for f in api.get_findings(spark, "x = eval(y)\n", "klingon", "CRITICAL")} == {"critical"}
    assert api.get_findings(spark, "x = eval(y)\n", severity="info") == []


def test_summaries_and_rows(spark):
    rows = structure.with_structure(_files(spark, ("python", "import os\n\nclass A:\n    def f(self, x):\n        return x\n"), ("rust", "")))
    text = rows.select(structure.summary_text(F.col("structure")).alias("t")).collect()
    assert "  - f(params=2) lines 4-5 (2 lines, NO docstring)" in text[0]["t"] and "  - A lines 3-5 (1 methods, NO docstring)" in text[0]["t"] and text[0]["t"].endswith("\nImports: import os")
    assert "Functions:\n" not in text[1]["t"]
    found = rules.raw_findings(_files(spark, ("python", "x = eval(y)")))
    assert review.plain_rows(found).columns == ["file_id", "severity", "category", "title", "description", "line_start", "line_end", "suggestion", "rule_id", "confidence", "source"]
    scores, seen = agents.observed(spark.createDataFrame([(3, 1), (0, 0)], "n_findings bigint, n_critical bigint"))
    scores.collect()
    assert seen.get == {"reviews_total": 2, "findings_total": 3, "critical_reviews": 1}
    heads = spark.createDataFrame([('{"title": "t", "user": {"login": "u"}}',), ("{}",)], "json string")
    assert [r["author"] for r in sources.read_pull(heads).collect()] == ["u", ""]
    names = spark.createDataFrame([("a/b/c",), ("x",)], "n string").select(sources.owner_and_name(F.col("n")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in names] == [("a", "b/c"), ("x", "")]


def test_every_rule_has_advice(spark):
    from lintlake.functions.advice import ADVICE
    from lintlake.functions.rulebook import RULES

    assert set(ADVICE) == {r.id for r in RULES}
    rows = spark.createDataFrame([(1, r.id, r.severity) for r in RULES] + [(2, "OWN1", "low"), (2, None, "low")], "file_id int, rule_id string, severity string")
    plain = {r.rule_id: (r.description, r.suggestion) for r in review.plain_rows(rows).collect()}
    assert all(plain[k] == v for k, v in ADVICE.items()) and plain["OWN1"] == plain[None] == (None, None)
    own = review.with_advice(rows.withColumn("description", F.lit("mine"))).where("rule_id = 'PY001'").first()
    assert (own.description, own.suggestion) == ("mine", ADVICE["PY001"][1])
