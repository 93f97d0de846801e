"""Merge findings of a file into a review: deduplicate, order, score, summarise; roll reviews up to gates and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.advice import ADVICE

#: Severities in order, and what each takes off the score.
PENALTY = {"critical": 20, "high": 10, "medium": 5, "low": 2, "info": 0}
SEVERITIES = list(PENALTY)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), severity) - 1


def penalty(severity: Column) -> Column:
    out = F.lit(0)
    for s, p in PENALTY.items():
        out = F.when(severity == s, p).otherwise(out)
    return out


def merge(*branches: DataFrame) -> DataFrame:
    """One relation of findings; a branch's number orders equals."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (b.withColumn("branch", F.lit(i)) for i, b in enumerate(branches)))


def dedup_ranges(findings: DataFrame) -> DataFrame:
    """Of findings of a file with equal line range and category the most confident, the first of equals."""
    keys = ["file_id", "line_start", "line_end", "category"]
    rest = [c for c in findings.columns if c not in keys]
    ties = [-F.col(c) for c in ("branch", "rule_ord", "seq", "ord") if c in findings.columns]
    best = findings.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("confidence", *ties)).alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}").alias(c) for c in rest))


def position() -> list[Column]:
    """Sort keys: severity, then line (none last)."""
    line = F.when(F.coalesce("line_start", F.lit(0)) == 0, 999_999).otherwise(F.col("line_start"))
    return [severity_rank(F.col("severity")), line, F.coalesce("rule_id", F.lit(""))]


def file_scores(files: DataFrame, findings: DataFrame, structured: bool = False) -> DataFrame:
    """file_id, n_findings, a count for each severity, score 0..100, summary; files without findings too."""
    counts = findings.groupBy("file_id").agg(
        F.count("*").alias("n_findings"), F.sum(penalty(F.col("severity"))).alias("off"), *(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES)
    )
    rows = files.join(counts, "file_id", "left").na.fill(0, ["n_findings", "off", *(f"n_{s}" for s in SEVERITIES)])
    bonus = F.lit(0)
    if structured:
        m = F.col("structure")
        for good in (m["comment_ratio"] > 0.15, m["max_nesting"] <= 3, m["avg_function_length"] < 30):
            bonus = bonus + F.when(good, 5).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("off") + bonus)).cast("int")
    rows = rows.withColumn("score", score)
    return rows.select("file_id", "language", *("n_findings", *(f"n_{s}" for s in SEVERITIES)), "score", summary().alias("summary"))


def summary() -> Column:
    """A sentence or three about a scored row."""
    n = F.col("n_findings")
    parts = [
        F.concat(F.lit("Found "), n.cast("string"), F.when(n == 1, " issue.").otherwise(" issues.")),
        F.when(F.col("n_critical") > 0, F.concat(F.col("n_critical").cast("string"), F.lit(" critical."))),
        F.when(F.col("score") >= 80, "Overall the code is in good shape with minor improvements needed.")
        .when(F.col("score") >= 50, "Several issues should be addressed before production use.")
        .otherwise("Significant issues found that require immediate attention."),
    ]
    return F.when(n == 0, "No issues found. Code looks clean and well-structured.").otherwise(F.concat_ws(" ", *parts))


def quality_gate(scores: DataFrame, min_score: int = 0, max_critical: int = -1, max_high: int = -1) -> DataFrame:
    """passed, score (average, floored), reasons; without files it passes with 100.  0 and -1 switch a test off."""
    total = scores.agg(
        F.coalesce(F.floor(F.sum("score") / F.count("*")), F.lit(100)).cast("int").alias("score"),
        F.coalesce(F.sum("n_critical"), F.lit(0)).alias("critical"), F.coalesce(F.sum("n_high"), F.lit(0)).alias("high"), F.count("*").alias("n"),
    )
    say = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    reasons = F.array_compact(F.array(
        F.when((F.col("n") > 0) & F.lit(min_score > 0) & (F.col("score") < min_score), say("Score ", F.col("score"), " is below minimum ", min_score)),
        F.when((F.col("n") > 0) & F.lit(max_critical >= 0) & (F.col("critical") > max_critical), say(F.col("critical"), " critical finding(s) (max: ", max_critical, ")")),
        F.when((F.col("n") > 0) & F.lit(max_high >= 0) & (F.col("high") > max_high), say(F.col("high"), " high finding(s) (max: ", max_high, ")")),
    ))
    return total.select((F.size(reasons) == 0).alias("passed"), "score", reasons.alias("reasons"))


def at_least(findings: DataFrame, severity: str = "low", confidence: float = 0.0) -> DataFrame:
    """Findings of at least a severity and a confidence."""
    return findings.where((severity_rank(F.col("severity")) <= SEVERITIES.index(severity)) & (F.col("confidence") >= confidence))


def of_severity(findings: DataFrame, severity: str | None) -> DataFrame:
    """Findings of one severity, whatever its case; all without one."""
    return findings.where(F.col("severity") == severity.lower()) if severity else findings


#: Words in a category that give a finding to the security or the documentation agent; quality has the rest.
AGENT_WORDS = {"security": ("security", "vulnerab", "injection", "auth"), "docs": ("doc", "comment", "readme")}


def agent_of(category: Column) -> Column:
    out = F.lit("quality")
    for agent, words in reversed(AGENT_WORDS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(category).contains(w)
        out = F.when(hit, agent).otherwise(out)
    return out


def agent_counts(findings: DataFrame) -> DataFrame:
    """agent, n: findings by the agent that their category points to."""
    return findings.groupBy(agent_of(F.col("category")).alias("agent")).agg(F.count("*").alias("n"))


def with_advice(findings: DataFrame) -> DataFrame:
    """findings with `description` and `suggestion`: their own, else those of their rule."""
    known = F.create_map(*(x for rule, texts in ADVICE.items() for x in (F.lit(rule), F.array(*map(F.lit, texts)))))
    of_rule = F.try_element_at(known, F.col("rule_id")) if "rule_id" in findings.columns else F.lit(None).cast("array<string>")
    own = lambda c: F.col(c).cast("string") if c in findings.columns else F.lit(None).cast("string")
    return findings.withColumns({c: F.coalesce(own(c), F.get(of_rule, i)) for i, c in enumerate(("description", "suggestion"))})


def plain_rows(findings: DataFrame) -> DataFrame:
    """The fields that a report on the command line shows, in its order; what a finding lacks is null."""
    fields = {"severity": "string", "category": "string", "title": "string", "description": "string", "line_start": "int", "line_end": "int", "suggestion": "string", "rule_id": "string", "confidence": "double", "source": "string"}
    findings = with_advice(findings)
    return findings.select("file_id", *((F.col(c) if c in findings.columns else F.lit(None)).cast(k).alias(c) for c, k in fields.items()))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def severity_pivot(findings: DataFrame) -> DataFrame:
    return findings.groupBy("file_id").pivot("severity", SEVERITIES).agg(F.count(F.lit(1))).na.fill(0, SEVERITIES)


def as_json(findings: DataFrame) -> DataFrame:
    """file_id, finding: each finding as a JSON object."""
    return findings.select("file_id", F.to_json(F.struct(*(c for c in findings.columns if c != "file_id"))).alias("finding"))


def review_rows(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each file with its findings as an ordered array: the shape in which reviews are stored and cached."""
    cols = [c for c in ("rule_id", "severity", "category", "title", "confidence", "line_start", "line_end") if c in findings.columns]
    keyed = findings.withColumn("sort", F.struct(*(k.alias(f"k{i}") for i, k in enumerate(position()))))
    lists = keyed.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("sort", *cols))).alias("f"))
    lists = lists.select("file_id", F.transform("f", lambda x: F.struct(*(x[c].alias(c) for c in cols))).alias("findings"))
    return scores.join(lists, "file_id", "left")
