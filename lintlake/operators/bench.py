"""Score detectors against labelled samples: confusion counts, precision, recall, golden files, leaderboards."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(samples: DataFrame, findings: DataFrame, least: float = 0.0) -> DataFrame:
    """samples (sample_id, label, ...) with flagged and the four outcomes; a sample is flagged by any finding of at least `least`."""
    hits = findings.where(F.col("confidence") >= least).select("sample_id").distinct().withColumn("hit", F.lit(True))
    rows = samples.join(hits, "sample_id", "left").withColumn("flagged", F.coalesce("hit", F.lit(False))).drop("hit")
    bad = F.col("label") == "vulnerable"
    f = F.col("flagged")
    return rows.withColumns({"true_positive": bad & f, "false_negative": bad & ~f, "false_positive": ~bad & f, "true_negative": ~bad & ~f})


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def metrics(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_samples, n_vuln, n_clean, tp, fn, fp, tn, precision, recall, f1, fp_rate, and avg_latency_ms where results have latency_ms; 0 where a denominator is."""
    n = results.groupBy(*keys).agg(
        F.count("*").alias("n_samples"), F.count_if(F.col("label") == "vulnerable").alias("n_vuln"), F.count_if(F.col("label") != "vulnerable").alias("n_clean"),
        *(F.count_if(c).alias(a) for c, a in (("true_positive", "tp"), ("false_negative", "fn"), ("false_positive", "fp"), ("true_negative", "tn"))),
        *([F.coalesce(F.sum("latency_ms") / F.count("*"), F.lit(0.0)).alias("avg_latency_ms")] if "latency_ms" in results.columns else []),
    )
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    n = n.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fp_rate": ratio(fp, fp + tn)})
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def golden(expected: DataFrame, found: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """sample_id, expected_count, actual_count, satisfied, precision, recall, f1, passed.

    expected: (sample_id, ord, category, severity, title_pattern, min_count); found: (sample_id, category, severity,
    title); samples: (sample_id), all that were run, by default those with expectations or findings.  An expectation is met
    by `min_count` findings of its category and severity, whatever the case, whose title the pattern finds anywhere; an
    empty or null field holds for all findings.  Without expectations recall is 1, and precision too if nothing was found.
    """
    e, f = expected.alias("e"), found.alias("f")
    same = lambda c: (F.coalesce(F.col(f"e.{c}"), F.lit("")) == "") | (F.lower(f"e.{c}") == F.lower(f"f.{c}"))
    pattern = F.coalesce("e.title_pattern", F.lit(""))
    titled = (pattern == "") | F.regexp_like(F.coalesce("f.title", F.lit("")), F.concat(F.lit("(?iU)"), pattern))
    met = e.join(f, (F.col("e.sample_id") == F.col("f.sample_id")) & same("category") & same("severity") & titled, "left")
    met = met.groupBy("e.sample_id", "e.ord", "e.min_count").agg((F.count("f.sample_id") >= F.col("e.min_count")).alias("met"))
    want = met.groupBy("sample_id").agg(F.count("*").alias("expected_count"), F.count_if("met").alias("satisfied"))
    got = found.groupBy("sample_id").agg(F.count("*").alias("actual_count"))
    ids = (samples if samples is not None else expected.select("sample_id").unionAll(found.select("sample_id"))).select("sample_id").distinct()
    rows = ids.join(want, "sample_id", "left").join(got, "sample_id", "left").na.fill(0)
    n, m, ok = (F.col(c) for c in ("expected_count", "actual_count", "satisfied"))
    precision = F.when(m > 0, ok / m).otherwise(F.when(n == 0, 1.0).otherwise(0.0))
    recall = F.when(n > 0, ok / n).otherwise(F.lit(1.0))
    rows = rows.select("sample_id", "expected_count", "actual_count", "satisfied", precision.alias("precision"), recall.alias("recall"))
    rows = rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return rows.withColumn("passed", F.col("recall") >= 0.7)


def eval_summary(results: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: means of precision, recall and f1, samples passed and in all, and ok: whether the mean f1 reaches `least`."""
    return results.agg(
        *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.count_if("passed").alias("n_passed"), F.count("*").alias("n_samples"), (F.coalesce(F.avg("f1"), F.lit(1.0)) >= least).alias("ok")
    )


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines in a folder."""
    results.write.mode("overwrite").json(path)


def run_harness(samples: DataFrame, tools: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """metrics by tool and dataset; samples: (sample_id, dataset, language, code, label), tools: findings (sample_id, confidence) of samples.

    Each tool sees all samples at once; a tool that takes its time itself adds latency_ms to samples of its own accord.
    """
    runs = [classify(samples, tool(samples)).withColumn("tool", F.lit(name)) for name, tool in tools.items()]
    return metrics(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs), ["tool", "dataset"])


def leaderboard(rows: DataFrame) -> DataFrame:
    return rows.orderBy("fp_rate", F.desc("recall"))


def leaderboard_text(rows: DataFrame, keys: list[str]) -> DataFrame:
    """line: a Markdown row for each result."""
    cells = [*(F.col(k) for k in keys), *(F.format_number(c, 3) for c in ("precision", "recall", "f1", "fp_rate"))]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
