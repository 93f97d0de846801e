"""Pull requests: which files to review, changed line ranges, roll-up reports, and checks on events."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators.review import SEVERITIES, severity_rank

#: Reviewable extensions, lock files, folders, actions.
EXTENSIONS = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go"}
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "go.sum", "Cargo.lock", "go.mod")
VENDORED = ("vendor", "node_modules")
ACTIONS = ("opened", "synchronize", "reopened")
MOST_FILES = 20


def extension(filename: Column) -> Column:
    """The last suffix in lower case, '' if the name has none."""
    name = F.element_at(F.split(filename, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def language_of(filename: Column, extensions: dict[str, str] = EXTENSIONS) -> Column:
    out = F.lit(None).cast("string")
    for suffix, language in extensions.items():
        out = F.when(extension(filename) == suffix, language).otherwise(out)
    return out


def reviewable(filename: Column, status: Column) -> Column:
    parts = F.split(F.replace(filename, F.lit("\\"), F.lit("/")), "/")
    name = F.element_at(F.split(filename, "/"), -1)
    return (
        status.isin("added", "modified") & language_of(filename).isNotNull() & ~name.isin(*LOCK_FILES)
        & ~filename.endswith(".min.js") & ~filename.endswith(".min.ts") & ~F.arrays_overlap(parts, F.array(*(F.lit(v) for v in VENDORED)))
    )


def top_files(files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """The most changed files."""
    return files.orderBy(F.desc("changes"), "filename").limit(most)


def chosen_files(files: DataFrame, most: int = MOST_FILES) -> tuple[DataFrame, DataFrame]:
    """Of each pull request (pull_id) its most changed files, with their place ord; and (pull_id, skipped), the number of the others."""
    order = Window.partitionBy("pull_id").orderBy(F.desc("changes"), "filename")
    kept = files.withColumn("ord", F.row_number().over(order) - 1).where(F.col("ord") < most)
    return kept, files.groupBy("pull_id").agg(F.greatest(F.lit(0), F.count("*") - most).alias("skipped"))


def hunk_ranges(patch: Column) -> Column:
    """New line ranges (first, last) of a unified diff's hunks; a count of 0 gives none."""
    starts = F.regexp_extract_all(patch, F.lit(r"(?m)^@@[^+\n]*\+(\d+)(?:,(\d+))?"), F.lit(1))
    counts = F.regexp_extract_all(patch, F.lit(r"(?m)^@@[^+\n]*\+(\d+)(?:,(\d+))?"), F.lit(2))
    pairs = F.zip_with(starts, counts, lambda s, c: F.struct(s.cast("int").alias("first"), (s.cast("int") + F.when(c == "", 1).otherwise(c.cast("int")) - 1).alias("last")))
    return F.coalesce(F.filter(pairs, lambda p: p["last"] >= p["first"]), F.expr("cast(array() as array<struct<first:int,last:int>>)"))


def on_changed_lines(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings without a line or on a changed line; files: (file_id, ranges)."""
    rows = findings.join(files.select("file_id", "ranges"), "file_id", "left")
    return rows.where(F.col("line_start").isNull() | F.exists("ranges", lambda r: F.col("line_start").between(r["first"], r["last"]))).drop("ranges")


def file_report(scores: DataFrame) -> DataFrame:
    """file_id, line: a Markdown table row for each file."""
    cells = ["file_id", "score", *(f"n_{s}" for s in SEVERITIES)]
    return scores.select("file_id", F.concat(F.lit("| "), F.concat_ws(" | ", *(F.col(c).cast("string") for c in cells)), F.lit(" |")).alias("line"))


#: Signs of severities, risks and kinds of change, and how many findings without a line a report shows.
SEVERITY_SIGNS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵"}
RISK_SIGNS = {"low": "🟢", "medium": "🟡", "high": "🔴"}
CHANGE_SIGNS = {"feature": "✨", "bugfix": "🐛", "refactor": "♻️", "docs": "📚", "tests": "🧪", "security": "🔒", "chore": "🔧"}
SHOWN = 10


def _sign(value: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def _score(score: Column) -> Column:
    return F.concat(F.when(score >= 80, "🟢 ").when(score >= 60, "🟡 ").otherwise("🔴 "), score.cast("string"), F.lit("/100"))


def report(files: DataFrame, findings: DataFrame, summaries: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """pull_id, body: the Markdown report of each pull request.

    files: (pull_id, ord, filename, score, n_findings, n_critical, n_high, n_medium, n_low), score null for files that
    could not be reviewed; findings: (pull_id, ord, filename, severity, title, description, suggestion, line_start);
    summaries: as of agents.summarise_pulls; skipped: (pull_id, skipped).  A pull request has at most MOST_FILES files.
    """
    some = lambda n: F.when(n > 0, n.cast("string")).otherwise("—")
    name = F.concat(F.lit("| `"), F.col("filename"), F.lit("` | "))
    counts = F.concat_ws(" | ", *(some(F.col(f"n_{s}")) for s in ("critical", "high", "medium", "low")))
    row = F.when(F.col("score").isNull(), F.concat(name, F.lit("— | — | — | — | — |"))).otherwise(F.concat(name, _score(F.col("score")), F.lit(" | "), counts, F.lit(" |")))
    done = F.count("score")
    table = files.groupBy("pull_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", row.alias("line")))).alias("rows"), F.floor(F.sum("score") / done).cast("int").alias("mean"), done.alias("done"),
        F.sum(F.when(F.col("score").isNotNull(), F.col("n_findings"))).alias("found"),
    )
    entry = F.concat(
        F.lit("**`"), F.col("filename"), F.lit("`** "), _sign(F.col("severity"), SEVERITY_SIGNS, "⚪"), F.lit(" **"), F.col("title"), F.lit("**\n\n"), F.coalesce("description", F.lit("")), F.lit("\n"),
        F.when(F.coalesce("suggestion", F.lit("")) != "", F.concat(F.lit("\n> 💡 "), F.col("suggestion"), F.lit("\n"))).otherwise(""),
    )
    first = Window.partitionBy("pull_id").orderBy("ord", severity_rank(F.col("severity")), "title")
    general = findings.where("line_start is null").withColumn("place", F.row_number().over(first)).where(F.col("place") <= SHOWN)
    general = general.groupBy("pull_id").agg(F.array_sort(F.collect_list(F.struct("place", entry.alias("text")))).alias("general"))
    rows = table.join(general, "pull_id", "left")
    top = F.lit(None).cast("string")
    if summaries is not None:
        rows = rows.join(summaries, "pull_id", "left")
        risk = F.concat(_sign(F.col("risk"), RISK_SIGNS, "🟡"), F.lit(" "), F.col("risk"))
        steps = F.transform("walkthrough", lambda w: F.concat(F.lit("| `"), w["file"], F.lit("` | "), F.coalesce(w["change"], F.lit("")), F.lit(" |")))
        walk = F.when(F.size("walkthrough") > 0, F.concat(F.lit("<details>\n<summary>📋 Walkthrough</summary>\n\n| File | Change |\n|------|--------|\n"), F.array_join(steps, "\n"), F.lit("\n</details>\n")))
        reason = F.when(F.coalesce("risk_reason", F.lit("")) != "", F.concat(F.lit("  \n*"), F.col("risk_reason"), F.lit("*")))
        top = F.when(F.col("summary").isNotNull(), F.concat_ws("\n", F.concat(F.lit("### "), _sign(F.col("change_type"), CHANGE_SIGNS, "📦"), F.lit(" Summary")), F.concat(F.col("summary"), F.lit("\n")), F.concat(F.lit("**Type:** "), F.col("change_type"), F.lit(" &nbsp; **Risk:** "), risk), reason, F.lit(""), walk))
    lines = lambda c, field: F.array_join(F.transform(c, lambda x: x[field]), "\n")
    overall = F.when(F.col("done") > 0, F.concat(F.lit("\n**Overall Score: "), _score(F.col("mean")), F.lit("** &nbsp; | &nbsp; **"), F.col("found").cast("string"), F.lit(" finding(s)** across "), F.col("done").cast("string"), F.lit(" file(s)\n")))
    rest = F.when(F.col("general").isNotNull(), F.concat(F.lit("<details>\n<summary>📝 General Findings</summary>\n\n"), lines("general", "text"), F.lit("\n</details>\n")))
    left = F.lit(None).cast("string")
    if skipped is not None:
        rows = rows.join(skipped, "pull_id", "left")
        left = F.when(F.col("skipped") > 0, F.concat(F.lit("*"), F.col("skipped").cast("string"), F.lit(" more file(s) were not reviewed.*")))
    head = F.lit("### 📊 File Review Summary\n\n| File | Score | Critical | High | Medium | Low |\n|------|-------|----------|------|--------|-----|")
    return rows.select("pull_id", F.concat_ws("\n", F.lit("## Code Review\n"), top, head, lines("rows", "line"), overall, rest, left).alias("body"))


def inline_comments(findings: DataFrame) -> DataFrame:
    """file_id, line_start, body: most severe first; only findings with a line, each with what it has of its description, attack scenario, fix or suggestion, and confidence."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in findings.columns else F.lit("")
    part = lambda c, *around: F.when(text(c) != "", F.concat(F.lit(around[0]), text(c), F.lit(around[1])))
    title = F.concat(_sign(F.col("severity"), SEVERITY_SIGNS, "⚪"), F.lit(" **["), F.upper("severity"), F.lit("/"), F.upper("category"), F.lit("]** "), F.col("title"))
    fix = F.coalesce(part("fix_code", "\n```suggestion\n", "\n```"), part("suggestion", "\n> 💡 **Suggestion:** ", ""))
    sure = F.concat(F.lit("\n*Confidence: "), F.format_string("%.0f%%", F.col("confidence") * 100), F.lit("*"))
    body = F.concat_ws("\n", title, part("description", "\n", ""), part("attack_scenario", "\n<details>\n<summary>⚠️ Attack scenario</summary>\n\n", "\n</details>"), fix, sure)
    return findings.where("line_start is not null").orderBy(severity_rank(F.col("severity")), "file_id", "line_start").select("file_id", "line_start", body.alias("body"))


def review_payloads(bodies: DataFrame, comments: DataFrame) -> DataFrame:
    """pull_id, json: a review to post, which comments and never blocks; bodies: (pull_id, commit_sha, body), comments: (pull_id, path, line, body)."""
    made = comments.groupBy("pull_id").agg(F.array_sort(F.collect_list(F.struct("path", "line", F.lit("RIGHT").alias("side"), "body"))).alias("comments"))
    rows = bodies.join(made, "pull_id", "left")
    none = F.expr("cast(array() as array<struct<path:string,line:int,side:string,body:string>>)")
    return rows.select("pull_id", F.to_json(F.struct(F.col("commit_sha").alias("commit_id"), "body", F.lit("COMMENT").alias("event"), F.coalesce(F.col("comments").cast("array<struct<path:string,line:int,side:string,body:string>>"), none).alias("comments"))).alias("json"))


def comment_payloads(bodies: DataFrame) -> DataFrame:
    """pull_id, json: plain comments to post."""
    return bodies.select("pull_id", F.to_json(F.struct("body")).alias("json"))


def post(payloads: DataFrame, send: Callable[[int, str], object]) -> None:
    """Hand every row (pull_id, json) to send, on the executors; a row that is sent again after a lost task is the sender's to tell."""

    def each(rows) -> None:
        for r in rows:
            send(r["pull_id"], r["json"])

    payloads.select("pull_id", "json").foreachPartition(each)


def event_command(body: Column, name: str) -> Column:
    """help, review or mention for a comment that names the bot; null otherwise."""
    text = F.lower(body)
    return F.when(~text.contains(f"@{name}"), None).when(text.contains("help"), "help").when(text.contains("review"), "review").otherwise("mention")


def signed(payload: Column, signature: Column, secret: str) -> Column:
    """Whether a payload's signature is its HMAC-SHA256 under the secret."""

    def check(payloads: pa.Array, signatures: pa.Array) -> pa.Array:
        made = ("sha256=" + hmac.new(secret.encode(), (p or "").encode(), hashlib.sha256).hexdigest() for p in payloads.to_pylist())
        return pa.array([hmac.compare_digest(m, s or "") for m, s in zip(made, signatures.to_pylist(), strict=True)])

    return F.arrow_udf(check, "boolean")(payload, signature)
