import base64
import datetime as dt
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from lintlake.operators import bench, feedback, graph, pulls, review, rules, structure, taint
from lintlake.sources import files as sources, samples
from lintlake.streaming import jobs


def _files(spark, *rows):
    return spark.createDataFrame([(i, language, code) for i, (language, code) in enumerate(rows)], "file_id bigint, language string, code string")


def test_taint_flows(spark):
    files = _files(
        spark,
        ("python", "q = request.form['q']\nr = q + 'x'\ncursor.execute(r)\n"),
        ("python", "q = request.form['q']\nr = int(q)\ncursor.execute(r)\n"),
        ("python", "q = 'fixed'\ncursor.execute(q)\n"),
        ("javascript", "const b = req.query.x\nconst t = `a ${b}`\neval(t)\n"),
        ("python", "v = input()\n" + "eval(v)\n" * 30),
        ("python", None),
    )
    rows = taint.taint_candidates(files).collect()
    by = {}
    for r in rows:
        by.setdefault(r["file_id"], []).append(r)
    assert [(r["source_kind"], r["sink_kind"], r["source_line"], r["sink_line"], len(r["hops"])) for r in by[0]] == [("http_body", "sql_query", 1, 3, 2)]
    assert 1 not in by and 2 not in by and 5 not in by
    assert [r["sink_kind"] for r in by[3]] == ["code_exec"]
    assert len(by[4]) == 20
    first = by[0][0]
    made = hashlib.sha256(f"{first['source_sig']}:{first['sink_sig']}:None:3".encode()).hexdigest()[:16]
    assert first["candidate_id"] == made
    assert "  3 >> cursor.execute(r)" in first["snippet"]


def test_suppressed_pairs_never_add_rows(spark):
    found = taint.taint_candidates(_files(spark, ("python", "q = input()\neval(q)\nexec(q)\n")))
    pair = found.limit(1).select("source_sig", "sink_sig")
    assert taint.without_suppressed(found, pair).count() == found.count() - 1


def test_triage_and_verdicts(spark):
    found = taint.taint_candidates(_files(spark, ("python", "q = input()\neval(q)\n")))
    assert [r["severity"] for r in taint.triage(found).collect()] == ["critical"]
    silent = lambda df: df.withColumn("answer", F.lit("no json"))
    assert taint.triage(found, silent).count() == 0
    v = spark.sql("select '```json\n{\"exploitable\": true, \"confidence\": 7}\n```' as t").select(taint.parse_verdict(F.col("t")).alias("v")).first()["v"]
    assert v["exploitable"] and v["confidence"] == 1.0


def test_structure_counts():
    s = structure.scan('import os\nfrom a import b\n# note\nclass A:\n    """Doc."""\n    def f(self, x):\n        if x and y:\n            return [i for i in x]\n\ndef g(a, b=1, *args):\n    pass\n', "python")
    assert [(f["name"], f["params"], f["line_start"], f["line_end"]) for f in s["functions"]] == [("f", 2, 6, 8), ("g", 2, 10, 11)]
    assert [(c["name"], c["methods"], c["has_docstring"]) for c in s["classes"]] == [("A", 1, True)]
    assert s["imports"] == ["import os", "from a import b"]
    assert s["complexity"] == 4 and s["max_nesting"] == 3
    js = structure.scan("import x from 'x'\nfunction a(b, c) {\n  if (b) {\n    for (;;) { d() }\n  }\n}\nconst e = (f) => f + 1\nclass K {\n  m(n) {\n  }\n}\n", "javascript")
    assert [(f["name"], f["params"]) for f in js["functions"]] == [("a", 2), ("e", 1), ("m", 1)]
    assert js["complexity"] == 3 and js["max_nesting"] == 3
    go = structure.scan("package a\nfunc F(a int, b int) {\n\tif a > 0 && b > 0 {\n\t}\n}\n", "go")
    assert [(f["name"], f["params"]) for f in go["functions"]] == [("F", 2)] and go["complexity"] == 3
    assert structure.scan(None, "java")["complexity"] == 1 and structure.scan("'''open", "python")["functions"] == []


def test_scanner_holds_few_rows_at_a_time():
    """A batch of ten thousand whole texts never becomes Python objects at once, nor do its results."""
    import pyarrow as pa

    sizes = []
    got = structure.in_slices(lambda a, b: sizes.append(len(a)) or [x + y for x, y in zip(a, b, strict=True)], pa.int64(), pa.array(range(10_000)), pa.array(range(10_000)))
    assert got.to_pylist() == [2 * x for x in range(10_000)] and max(sizes) <= 64
    assert structure.in_slices(lambda a: a, pa.int64(), pa.array([], pa.int64())).to_pylist() == []


def test_scanner_reads_equal_lines_once():
    before = structure._known_line.cache_info().misses
    s = structure.scan("def grow(a):\n" + "    a = a + 1\n" * 500, "python")
    assert s["max_function_length"] == 501 and structure._known_line.cache_info().misses - before <= 3


def test_graph(spark):
    code = "import os\ndef a():\n    b()\ndef b():\n    pass\nclass C:\n    pass\n"
    files = structure.with_structure(_files(spark, ("python", code))).withColumn("path", F.lit("m.py"))
    nodes, edges = graph.extract(files)
    nodes = graph.upsert_nodes(nodes.withColumn("ord", F.lit(1)))
    assert {(r["kind"], r["name"]) for r in nodes.collect()} == {("module", "m.py"), ("module", "os"), ("function", "a"), ("function", "b"), ("class", "C")}
    kinds = sorted(r["relationship"] for r in edges.collect())
    assert kinds == ["CALLS", "CONTAINS", "CONTAINS", "CONTAINS", "IMPORTS"]
    edges = graph.upsert_edges(edges.unionAll(spark.createDataFrame([("x", "y", "CALLS")], edges.schema)), nodes)
    assert edges.count() == 5
    assert [r["name"] for r in graph.callers(nodes, edges, ["b"]).collect()] == ["m.py"]
    assert {r["name"] for r in graph.siblings(nodes, edges, ["a"]).collect()} == {"b"}
    assert [r["name"] for r in graph.imports_of(nodes, edges, ["m.py"]).collect()] == ["os"]
    assert graph.parents(nodes, edges, ["C"]).collect() == []  # a module is no class
    held = nodes.where("name = 'C'").selectExpr("id as source_id").crossJoin(nodes.where("name = 'a'").selectExpr("id as target_id")).withColumn("relationship", F.lit("CONTAINS"))
    more = edges.unionByName(held)
    assert [r["name"] for r in graph.parents(nodes, more, ["a"]).collect()] == ["C"]
    assert graph.parents(nodes, more, ["a"], "other.py").collect() == []
    text = graph.file_context(nodes, more, ["b"], "m.py").first()["context"]
    assert text.startswith("Called by:\n  - m.py (module) in m.py\n") and "Sibling functions in file: a" in text
    assert graph.file_context(nodes, edges, ["none"], "none.py").first()["context"] == ""


def test_beside_keeps_classes_and_named_nodes(spark):
    code = "def a():\n    pass\ndef b():\n    pass\nclass C:\n    pass\n"
    files = structure.with_structure(_files(spark, ("python", code))).withColumn("path", F.lit("m.py"))
    nodes, edges = graph.extract(files)
    got = sorted((r["queried"], r["name"], r["kind"]) for r in graph.beside(nodes, edges, ["a", "b"]).collect())
    assert got == [("a", "C", "class"), ("a", "b", "function"), ("b", "C", "class"), ("b", "a", "function")]


def test_siblings_query_does_the_whole_job(spark):
    """The functions asked for are beside each other too, and what stands beside them has its kind."""
    from lintlake.plans.queries import QUERIES

    from .conftest import SF

    got = QUERIES["graph_siblings"](spark, SF).where("file_path = 'file0'").select("queried", "name", "kind").collect()
    assert sorted(map(tuple, got)) == [("run", "load", "function"), ("run", "token_for", "function"), ("token_for", "load", "function"), ("token_for", "run", "function")]


def test_graph_queries_scan_structures_once(spark):
    """Nodes and edges are read from what was written: no query's plan holds the scanner, which would run for each of them."""
    from lintlake.plans.queries import QUERIES

    from .conftest import SF

    for name in ("graph_edges", "graph_siblings", "graph_callers", "graph_context", "graph_table_edges"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "structure_of" not in plan and "CodeGraph" not in plan, name


def test_queries_run_the_rules_once(spark):
    """What reads findings more than once reads what was written; no text is read beside it."""
    from lintlake.plans.queries import QUERIES

    from .conftest import SF

    for name in ("eval_match", "review_events", "review_states"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema" in plan and "text:string" not in plan, name


T0 = dt.datetime(2026, 1, 1)


def test_feedback_thresholds(spark):
    rows = [("security", "t", "go", "false_positive", T0 + dt.timedelta(hours=i)) for i in range(3)] + [("quality", "u", "go", "false_positive", T0)] * 2
    rows += [("style", "w", "go", "false_positive", T0)] * 3 + [("style", "w", "go", "helpful", T0 + dt.timedelta(days=1, hours=i)) for i in range(98)]
    events = spark.createDataFrame(rows, "category string, title string, language string, action string, ts timestamp")
    kept = feedback.finding_suppressions(events).collect()
    assert len(kept) == 1 and kept[0]["n_hits"] == 3
    assert kept[0]["active_until"] == T0 + dt.timedelta(hours=2, days=90)
    findings = spark.createDataFrame([("security", "t", "go"), ("quality", "u", "go")], "category string, title string, language string")
    assert [r["title"] for r in feedback.apply_suppressions(findings, feedback.finding_suppressions(events)).collect()] == ["u"]


def test_pull_requests(spark):
    names = ["a.py", "b.min.js", "go.mod", "vendor/x.go", "c.TSX", "README.md", "x/node_modules/y.js", "noext"]
    df = spark.createDataFrame([(n, "added") for n in names] + [("z.py", "removed")], "filename string, status string")
    assert [r[0] for r in df.where(pulls.reviewable(F.col("filename"), F.col("status"))).collect()] == ["a.py", "c.TSX"]
    patch = "@@ -1,2 +3,4 @@ def f\n+x\n@@ -9 +12 @@\n+y\n@@ -20,2 +30,0 @@\n-z"
    got = spark.createDataFrame([(patch,), (None,), ("",)], "p string").select(pulls.hunk_ranges(F.col("p")).alias("r")).collect()
    assert [[(x["first"], x["last"]) for x in r["r"]] for r in got] == [[(3, 6), (12, 12)], [], []]
    body = '{"a": 1}'
    good = "sha256=" + hmac.new(b"key", body.encode(), hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([(body, good), (body, "sha256=0"), (None, None)], "p string, s string").select(pulls.signed(F.col("p"), F.col("s"), "key").alias("ok")).collect()
    assert [r["ok"] for r in rows] == [True, False, False]


def test_gate(spark):
    none = spark.createDataFrame([], "score int, n_critical bigint, n_high bigint")
    row = review.quality_gate(none, 90, 0, 0).first()
    assert row["passed"] and row["score"] == 100 and row["reasons"] == []
    some = spark.createDataFrame([(80, 1, 0), (91, 0, 3)], none.schema)
    row = review.quality_gate(some, 90, 0, 3).first()
    assert not row["passed"] and row["score"] == 85 and row["reasons"] == ["Score 85 is below minimum 90", "1 critical finding(s) (max: 0)"]


def test_bench_metrics(spark):
    samples = spark.createDataFrame([(i, "vulnerable" if i < 14 else "clean", "t") for i in range(74)], "sample_id int, label string, tool string")
    found = spark.createDataFrame([(i, 0.9) for i in range(12)], "sample_id int, confidence double")
    m = bench.metrics(bench.classify(samples, found), ["tool"]).first()
    assert (m["tp"], m["fn"], m["fp"], m["tn"]) == (12, 2, 0, 60)
    assert round(m["recall"], 3) == 0.857 and m["precision"] == 1.0 and round(m["f1"], 3) == 0.923
    golden = sources.read_golden(spark.createDataFrame([("a", json.dumps([{"category": "security", "severity": "high", "title_pattern": "^sql"}])), ("b", json.dumps({"expected_findings": [{"category": "quality", "severity": "low", "title_pattern": "x", "min_count": 2}]}))], "sample_id string, json string"))
    got = spark.createDataFrame([("a", "security", "high", "SQL injection"), ("b", "quality", "low", "x")], "sample_id string, category string, severity string, title string")
    assert {(r["sample_id"], r["passed"]) for r in bench.golden(golden, got).collect()} == {("a", True), ("b", False)}
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id string")
    scored = bench.golden(golden, got, ids)
    assert [(r["precision"], r["recall"], r["f1"]) for r in scored.where("sample_id = 'c'").collect()] == [(1.0, 1.0, 1.0)]
    total = bench.eval_summary(scored).first()
    assert (total["n_passed"], total["n_samples"], total["ok"]) == (2, 3, True)


def test_harness_parity(spark, tmp_path):
    """The published confusion counts, from rules over samples of our own."""
    files = samples.samples(spark)
    assert files.groupBy("dataset").count().orderBy("dataset").collect() == [("clean", 60), ("weaknesses", 14)]
    found = rules.raw_findings(files).join(files.select("file_id", "sample_id"), "file_id")
    rows = {r["dataset"]: r for r in bench.run_harness(files, {"rules": lambda _: found}).collect()}
    assert [(rows[d]["tp"], rows[d]["fn"], rows[d]["fp"], rows[d]["tn"]) for d in ("weaknesses", "clean")] == [(12, 2, 0, 0), (0, 0, 0, 60)]
    bench.write_results(bench.run_harness(files, {"none": lambda s: s.limit(0).select("sample_id", F.lit(1.0).alias("confidence"))}), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).agg(F.sum("fn")).first()[0] == 14


def test_readers(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x = 1\xff\n")
    (tmp_path / "src" / "run").write_text("#!/usr/bin/env python\n")
    (tmp_path / "src" / "b.txt").write_text("no")
    (tmp_path / "node_modules" / "c.js").write_text("var a")
    rows = sources.scan_tree(spark, str(tmp_path)).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["language"]) for r in rows) == [("a.py", "python"), ("run", "python")]
    assert {r["path"].rsplit("/", 1)[1]: r["code"] for r in rows}["a.py"] == "x = 1\n"
    assert [r["path"].rsplit("/", 1)[1] for r in sources.scan_tree(spark, str(tmp_path), only=["src/a.py"]).collect()] == ["a.py"]
    prop = lambda s: {"properties": {"problem.severity": s}}
    place = [{"physicalLocation": {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": 3}}}]
    results = [{"ruleId": "r1", "message": {"text": "m"}, "locations": place}, {"ruleId": "r1", "message": {}} | prop("note"), {"ruleId": "r2"}, {"ruleId": "r3", "level": "error"}, {"ruleId": "r3"}]
    sarif = {"runs": [{"tool": {"driver": {"name": "q", "rules": [{"id": "r1"} | prop("ERROR"), {"id": "r2"}]}}, "results": results}, {"results": results}]}
    got = sources.read_sarif(spark.createDataFrame([(json.dumps(sarif),), ("{}",)], "json string")).collect()
    assert [(r["severity"], r["title"], r["line_start"], r["line_end"]) for r in got] == [("critical", "m", 3, 3), ("medium", "r1", None, None), ("high", "r2", None, None), ("critical", "r3", None, None), ("high", "r3", None, None)]
    result = lambda s: {"check_id": "c", "path": "p", "start": {"line": 1}, "end": {"line": 2}, "extra": {"message": "m"} | ({"severity": s} if s else {})}
    semgrep = {"results": [result(s) for s in ("ERROR", "Warning", "INFO", "NOTE", "other", None)]}
    assert [r["severity"] for r in sources.read_semgrep(spark.createDataFrame([(json.dumps(semgrep),)], "json string")).collect()] == ["critical", "high", "medium", "low", "medium", "medium"]
    shebang = spark.createDataFrame([("run", "#!/usr/bin/env PYTHON3\nx"), ("b", "echo")], "path string, code string")
    assert [r[0] for r in shebang.select(sources.detect_language(F.col("path"), F.col("code"))).collect()] == ["python", None]
    bad = spark.createDataFrame([(b"a\xffb\xef\xbf\xbdc\xc3",)], "b binary").select(sources.decoded(F.col("b"))).first()[0]
    assert bad == "ab\ufffdc" == b"a\xffb\xef\xbf\xbdc\xc3".decode("utf-8", "ignore")
    content = spark.createDataFrame([(base64.b64encode("é".encode()).decode(), 2), ("!!", 2), (base64.b64encode(b"\xff").decode(), 1), ("YQ==", 200_000)], "c string, n int")
    assert [r[0] for r in content.select(sources.decode_content(F.col("c"), F.col("n"))).collect()] == ["é", None, None, None]


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"user_id": 1, "ts": f"2026-01-01T0{i}:00:00", "event_type": "error", "value": 1.0} for i in range(4)] + [{"user_id": 2, "ts": "2026-01-01T00:00:00", "event_type": "error", "value": 2.0}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    schema = "user_id bigint, ts timestamp, event_type string, value double"
    stream = jobs.read_stream(spark, str(tmp_path / "in"), schema)
    batch = spark.read.schema(schema).json(str(tmp_path / "in"))
    got = jobs.run_to_table(jobs.event_windows(stream), "windows", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.event_windows(batch).collect()))
    kept = jobs.run_to_table(jobs.suppression_stream(stream, "user_id", F.col("event_type") == "error"), "kept", "update").collect()
    want = feedback.suppressions(batch, ["user_id"], ["ts"], F.col("event_type") == "error", 100, 3, "ts").collect()
    assert [(r["user_id"], r["n_hits"], r["active_until"]) for r in kept] == [(r["user_id"], r["n_hits"], r["active_until"]) for r in want]


def test_webhooks_and_reviews(spark, tmp_path):
    hook = lambda action, sha: json.dumps({"ts": "2026-01-01T00:00:00", "json": json.dumps({"action": action, "pull_request": {"number": 1, "head": {"sha": sha}}, "repository": {"full_name": "o/r"}})})
    (tmp_path / "hooks").mkdir()
    (tmp_path / "hooks" / "a.json").write_text("\n".join([hook("opened", "s"), hook("opened", "s"), hook("closed", "t"), hook("reopened", "u")]))
    stream = jobs.read_stream(spark, str(tmp_path / "hooks"), "ts timestamp, json string")
    assert sorted(r["sha"] for r in jobs.run_to_table(jobs.pull_events(stream), "hooks").collect()) == ["s", "u"]
    events = jobs.review_events(_files(spark, ("python", "x = eval(y)\n"), ("go", "")))
    types = {}
    for r in events.orderBy("review_id", "seq").collect():
        types.setdefault(r["review_id"], []).append(r["type"])
    assert types == {0: ["agent_start", "finding", "complete"], 1: ["agent_start", "complete"]}
    state = {r["review_id"]: (r["status"], r["n_findings"], r["score"]) for r in jobs.fold_events(events).collect()}
    assert state == {0: ("complete", 1, 80), 1: ("complete", 0, 100)}
