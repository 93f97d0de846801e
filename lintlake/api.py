"""Reviews as plain calls: one text, a tree of files, questions about findings and the code graph."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators import graph, review, rules, structure, taint
from lintlake.sources.files import HINTS, read_file, scan_tree


def review_files(files: DataFrame, disabled: tuple[str, ...] = (), suppressed: DataFrame | None = None, rules_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scores, findings) of files (file_id, language, code): rules and triaged taint, merged and deduplicated.

    suppressed: (source_sig, sink_sig) pairs that aren't reported.  rules_only: no taint.
    """
    files = structure.with_structure(files)
    if rules_only:
        found = review.dedup_ranges(rules.findings(files, disabled).withColumn("source", F.lit("rule")))
        return review.file_scores(files, found, structured=True), found
    flows = taint.taint_candidates(files.drop("structure"))
    if suppressed is not None:
        flows = taint.without_suppressed(flows, suppressed)
    found = review.merge(rules.findings(files, disabled).withColumn("source", F.lit("rule")), taint.triage(flows))
    found = review.dedup_ranges(found)
    return review.file_scores(files, found, structured=True), found


def review_code(spark: SparkSession, code: str, language: str = "python") -> dict:
    """Score, summary and findings of one text."""
    files = spark.createDataFrame([(0, language, code)], "file_id bigint, language string, code string")
    scores, found = review_files(files)
    return review.review_rows(scores, found).first().asDict(recursive=True)


def analyze_file(spark: SparkSession, path: str) -> dict:
    """Score, summary and findings of one file, or an error."""
    if not os.path.exists(path):
        return {"error": f"File not found: {path}"}
    if not os.path.isfile(path):
        return {"error": f"Not a file: {path}"}
    row = read_file(spark, os.path.abspath(path)).first()
    return review_code(spark, row["code"], row["language"]) | {"file_path": os.path.abspath(path)}


def get_findings(spark: SparkSession, code: str, language: str = "python", severity: str | None = None) -> list[dict]:
    """Findings of one text, of one severity if it is given; languages that aren't known count as python."""
    found = review_code(spark, code, language if language in HINTS else "python")["findings"] or []
    return [f for f in found if severity is None or f["severity"] == severity.lower()]


def review_tree(spark: SparkSession, root: str, only: list[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(scores, findings) of all files below a folder, or of those named; findings have their path."""
    files = scan_tree(spark, root, only=only)
    scores, found = review_files(files, **options)
    paths = files.select("file_id", "path")
    return scores.join(paths, "file_id"), found.join(paths, "file_id")


def query_codebase(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """callers, callees, siblings, imports and parents of the named nodes of a tree's code graph."""
    nodes, edges = graph.extract(structure.with_structure(scan_tree(spark, root)))
    nodes = graph.upsert_nodes(nodes.withColumn("ord", F.coalesce("line_start", F.lit(0))))
    edges = graph.upsert_edges(edges, nodes)
    ask = {"callers": graph.callers, "callees": graph.callees, "siblings": graph.siblings, "imports": graph.imports_of, "parents": graph.parents}
    return {k: f(nodes, edges, names) for k, f in ask.items()}


def codebase_context(spark: SparkSession, root: str, path: str) -> str:
    """What a tree's code graph knows about the functions of one of its files, as text."""
    files = structure.with_structure(scan_tree(spark, root))
    own = files.where(F.col("path") == path).select(F.explode("structure.functions.name").alias("name")).where("name <> '<anonymous>'")
    names = sorted({r["name"] for r in own.collect()})  # of one file
    nodes, edges = graph.extract(files)
    nodes = graph.upsert_nodes(nodes.withColumn("ord", F.coalesce("line_start", F.lit(0))))
    return graph.file_context(nodes, graph.upsert_edges(edges, nodes), names, path).first()["context"] if names else ""
