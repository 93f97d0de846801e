"""Raw results of reports, prompts of the reviewers, an app's deliveries, the graph as a table function."""

import hashlib
import hmac
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lintlake.operators import agents, feedback, graph, graph_table, pulls, structure
from lintlake.plans import queries
from lintlake.sources import files as readers
from lintlake.streaming import jobs


def test_raw_results_keep_what_no_reader_names(spark):
    result = {"ruleId": "r", "level": None, "codeFlows": [{"threadFlows": []}], "properties": {"tags": ["a", "b"], "problem.severity": "ERROR"}, "locations": []}
    reports = [json.dumps({"runs": [{"results": [result, {"ruleId": 7}, {}]}]}), "{}", "not json", None, json.dumps({"runs": []})]
    got = readers.read_sarif(spark.createDataFrame([(r,) for r in reports], "json string"))
    rows = got.select("rule_id", "title", "severity", "line_start", F.to_json("raw").alias("raw"), F.try_variant_get("raw", "$.properties.tags[1]", "string").alias("tag")).collect()
    assert [(r["rule_id"], r["title"], r["severity"], r["line_start"], r["tag"]) for r in rows] == [("r", "r", "critical", None, "b"), ("7", "7", "high", None, None), (None, "", "high", None, None)]
    assert json.loads(rows[0]["raw"]) == result
    fields = {r["field"]: r["n"] for r in readers.raw_fields(got).collect()}
    assert fields == {"ruleId": 2, "level": 1, "codeFlows": 1, "properties": 1, "locations": 1}
    other = readers.read_semgrep(spark.createDataFrame([(json.dumps({"results": [{"check_id": "c", "extra": {"metadata": {"cwe": ["CWE-1"]}}}]}),)], "json string"))
    assert other.select(F.try_variant_get("raw", "$.extra.metadata.cwe[0]", "string")).first()[0] == "CWE-1"


def test_prompts_hold_each_part_once_and_in_order(spark):
    schema = "file_id bigint, language string, code string, title string, body string, diff string, ranges array<struct<first:int,last:int>>, summary string, context string"
    full = (1, "go", "package a", "T", "b" * 600, "+" * 5000, [(3, 3), (5, 9)], "S", "C")
    bare = (2, "python", None, None, "unseen", " \n", [(1, 2)], "", None)
    got = {r["file_id"]: r["prompt"] for r in agents.review_prompt("docs", spark.createDataFrame([full, bare], schema)).collect()}
    parts = ["pull request: T", "b" * 500, "```diff\n" + "+" * 4000 + "\n(the rest", "Changed lines: 3, 5-9", "```go\npackage a\n```", "structure:\nS", "knows of it:\nC", "Judge the changed lines first"]
    places = [got[1].index(p) for p in parts]
    assert places == sorted(places) and "b" * 501 not in got[1] and "+" * 4001 not in got[1]
    assert got[2].startswith("The whole file:\n```python\n\n```\n\nYou review python code for docs.") and "unseen" not in got[2] and "hanged" not in got[2]
    plain = agents.review_prompt("docs", spark.createDataFrame([(1, "go", "x")], "file_id int, language string, code string")).first()["prompt"]
    assert plain.count("\n\n") == 1
    assert agents.review_prompt("docs", spark.createDataFrame([], schema)).count() == 0


def test_signatures_by_their_definition(spark):
    row = spark.createDataFrame([("päyload",), ("",)], "json string")
    for r in row.select("json", queries._signature(F.col("json")).alias("s"), pulls.signed(F.col("json"), queries._signature(F.col("json")), queries._SECRET).alias("ok")).collect():
        assert r["ok"] and r["s"] == "sha256=" + hmac.new(queries._SECRET.encode(), r["json"].encode(), hashlib.sha256).hexdigest()


def _delivery(at, event, payload, secret=b"s"):
    text = json.dumps(payload)
    return (at, event, "sha256=" + hmac.new(secret, text.encode(), hashlib.sha256).hexdigest(), text)


def test_app_deliveries(spark):
    install = lambda action, i, **more: {"action": action, "installation": {"id": i} | more}
    head = lambda sha="c", name="o/r", number=1, action="opened": {"action": action, "pull_request": {"number": number, "head": {"sha": sha}}, "repository": {"full_name": name}}
    sent = [
        _delivery(1, "installation", install("created", 1, account={"login": "a", "type": "User"}) | {"repositories": [{"full_name": "a/x"}, {}]}),
        _delivery(2, "installation", install("unsuspend", 1)), _delivery(1, "installation", install("created", 2)), _delivery(3, "installation", install("suspend", 2)),
        _delivery(1, "installation", {"action": "created"}), _delivery(1, "installation", install("created", 9), b"other"), (1, "installation", None, "{}"), _delivery(1, "installation", {}), _delivery(1, "push", {}),
        _delivery(1, "pull_request", head()), _delivery(2, "pull_request", head()), _delivery(1, "pull_request", head("d", action="closed")),
        *(_delivery(1, "pull_request", h) for h in (head("", "o/r"), head("e", "norepo"), head("f", number=0), head("g", "o/"), {"action": "opened"})),
    ]
    rows = spark.createDataFrame(sent, "at int, event string, signature string, json string").withColumn("ts", F.timestamp_seconds("at"))
    told = jobs.app_deliveries(rows, "s")
    assert {r["status"]: r["count"] for r in told.groupBy("status").count().collect()} == {"rejected": 2, "ignored": 1, "accepted": len(sent) - 3}
    assert jobs.app_deliveries(rows, "").where("status <> 'rejected'").count() == 0
    accepted = told.where("status = 'accepted'")
    kept = {r["installation_id"]: (r["account_login"], r["account_type"], r["repos"]) for r in feedback.installations(jobs.installation_events(accepted)).collect()}
    assert kept == {1: ("a", "User", ["a/x", ""]), 0: ("unknown", "unknown", [])}
    assert [(r["repo"], r["number"], r["sha"]) for r in jobs.app_pull_events(accepted).collect()] == [("o/r", 1, "c")]


def test_app_installations_of_a_stream(spark, tmp_path):
    sent = [_delivery(1, "installation", {"action": "created", "installation": {"id": i}}) for i in range(3)] + [_delivery(2, "installation", {"action": "deleted", "installation": {"id": 1}})]
    rows = spark.createDataFrame(sent, "at int, event string, signature string, json string").withColumn("ts", F.timestamp_seconds("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.app_deliveries(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "s").where("status = 'accepted'")
    q = feedback.installations(jobs.installation_events(stream)).writeStream.outputMode("complete").format("memory").queryName("installed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["installation_id"] for r in spark.table("installed").collect()) == [0, 2]


CODE = "import os\nfrom a.b import c\n\nclass K:\n    def f(self):\n        return g(1)\n\ndef g(x):\n    return x\n"


def test_graph_as_a_table_function(spark):
    files = spark.createDataFrame([("a.py", "python", CODE), ("b.js", "javascript", "import x from './x';\nfunction h() { h(); }\n"), ("c.rs", "rust", "fn main() {}"), ("d.py", "python", None)], "path string, language string, code string")
    files = structure.with_structure(files)
    both = [graph.extract(files), graph_table.extract_by_table(files)]
    order = [[sorted(map(str, df.distinct().collect())) for df in (nodes, edges.select("source_id", "target_id", "relationship"))] for nodes, edges in both]
    assert order[0] == order[1] and len(order[0][0]) > 7
    spark.udtf.register("code_graph", graph_table.CodeGraph)
    graph_table.entities(files).createOrReplaceTempView("entities")
    assert spark.sql("select relationship, count(*) as n from code_graph(table(entities)) where part = 'edge' group by 1 order by 1").collect() == [("CALLS", 2), ("CONTAINS", 4), ("IMPORTS", 3)]
    assert graph_table.extract_by_table(files.limit(0))[0].count() == 0
    with pytest.raises(AnalysisException):
        spark.sql("select * from code_graph(table(select 1 as path))")
