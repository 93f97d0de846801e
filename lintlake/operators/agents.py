"""Model-based reviewers as functions that are passed in: three agents, the summary of a pull request, observed runs.

A model is a function from a DataFrame with a column `prompt` to the same rows with `answer`, its JSON.  What can't be
read as the JSON asked for, and a null answer, count as no answer.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

Model = Callable[[DataFrame], DataFrame]
#: The agents, and the categories that the quality agent may give (others become the first).
AGENTS = ("security", "quality", "docs")
CATEGORY = {"security": ("security",), "quality": ("quality", "performance", "maintainability"), "docs": ("documentation",)}
_ANSWER = "findings array<struct<severity:string,category:string,title:string,description:string,line_start:int,line_end:int,suggestion:string,fix_code:string,attack_scenario:string,confidence:double>>"
_SUMMARY = "summary string, change_type string, risk string, risk_reason string, walkthrough array<struct<file:string,change:string>>"
#: Files and patch lines that a summary's prompt shows, and files that a summary without a model lists.
SHOWN_FILES, SHOWN_LINES, LISTED_FILES = 15, 30, 10


#: Characters of a pull request's description and of a file's diff that a prompt shows.
SHOWN_BODY, SHOWN_DIFF = 500, 4000


def review_prompt(agent: str, files: DataFrame) -> DataFrame:
    """files (file_id, language, code) with column `prompt`, in parts: the pull request, the diff, the file, its shape, its surroundings.

    More columns, where there are any, add to it: title and body of the pull request, diff, ranges (changed lines, array of
    first and last), summary (of the structure), context (of the code graph).  A part whose column is missing, null or
    blank is left out; changed lines are told only beside a diff.
    """
    has = set(files.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in has else F.lit("")
    said = lambda c: F.regexp_replace(text(c), r"\s", "") != ""
    cut = lambda c, most, note: F.when(F.length(text(c)) < most, text(c)).otherwise(F.concat(F.substring(text(c), 1, most), F.lit(note)))
    body = F.when(said("body"), F.concat(F.lit("\nIts author writes: "), F.substring(text("body"), 1, SHOWN_BODY)))
    pull = F.when(text("title") != "", F.concat(F.lit("Part of the pull request: "), text("title"), F.coalesce(body, F.lit(""))))
    diff = F.when(said("diff"), F.concat(F.lit("The change:\n```diff\n"), cut("diff", SHOWN_DIFF, "\n(the rest isn't shown)"), F.lit("\n```")))
    lines = F.lit(None).cast("string")
    if "ranges" in has:
        shown = F.transform("ranges", lambda r: F.when(r["first"] == r["last"], r["first"].cast("string")).otherwise(F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))))
        lines = F.when(said("diff") & (F.size("ranges") > 0), F.concat(F.lit("Changed lines: "), F.array_join(shown, ", ")))
    whole = F.concat(F.lit("The whole file:\n```"), text("language"), F.lit("\n"), text("code"), F.lit("\n```"))
    shape = F.when(said("summary"), F.concat(F.lit("Its structure:\n"), text("summary")))
    around = F.when(said("context"), F.concat(F.lit("What the code base knows of it:\n"), text("context")))
    task = F.concat(
        F.lit("You review "), text("language"), F.lit(f" code for {agent}. "), F.when(said("diff"), "Judge the changed lines first. ").otherwise(""),
        F.lit("Answer with one JSON object, findings: a list of severity, category, title, description, line_start, line_end, suggestion and confidence."),
    )
    return files.withColumn("prompt", F.concat_ws("\n\n", pull, diff, lines, whole, shape, around, task))


def offline(rows: DataFrame) -> DataFrame:
    """A stand-in for a model, which has nothing to add."""
    return rows.withColumn("answer", F.lit('{"findings": []}'))


def _json(answer):
    """What stands within code fences, else all of it."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?(.*?)```", 1)
    return F.trim(F.when(F.trim(fenced) != "", fenced).otherwise(answer))


def run_agent(agent: str, files: DataFrame, model: Model = offline) -> DataFrame:
    """Findings of one agent over files; a file whose answer can't be read has none."""
    rows = model(review_prompt(agent, files)).withColumn("f", F.explode(F.from_json(_json(F.col("answer")), _ANSWER)["findings"])).select("file_id", "language", "f.*")
    allowed = CATEGORY[agent]
    category = F.when(F.lower("category").isin(*allowed), F.lower("category")).otherwise(F.lit(allowed[0]))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.8))))
    return rows.where(F.col("title").isNotNull() & F.lower("severity").isin("critical", "high", "medium", "low", "info")).select(
        "file_id", "language", F.lower("severity").alias("severity"), category.alias("category"), "title", "description", "line_start", "line_end", "suggestion", "fix_code", "attack_scenario", sure.alias("confidence"), F.lit("ai").alias("source"), F.lit(agent).alias("agent"),
    )


def run_agents(files: DataFrame, models: dict[str, Model]) -> DataFrame:
    """Findings of the agents that models are given for, united."""
    found = None
    for agent in AGENTS:
        if agent in models:
            own = run_agent(agent, files, models[agent])
            found = own if found is None else found.unionByName(own)
    return run_agent("security", files.limit(0)) if found is None else found


def summary_prompt(pulls: DataFrame, files: DataFrame) -> DataFrame:
    """pulls (pull_id, title, body) with prompt: the first files (pull_id, ord, filename, additions, deletions, patch) with the first lines of their patches."""
    lines = F.slice(F.split("patch", "\n"), 1, SHOWN_LINES)
    patch = F.when(F.coalesce("patch", F.lit("")) == "", "no patch").otherwise(F.array_join(lines, "\n"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    block = F.concat(F.lit("File "), "filename", F.lit(": "), number("additions"), F.lit(" lines in, "), number("deletions"), F.lit(" lines out\n"), patch)
    shown = files.where(F.col("ord") < SHOWN_FILES).groupBy("pull_id").agg(F.array_sort(F.collect_list(F.struct("ord", block.alias("block")))).alias("b"))
    rows = pulls.join(shown, "pull_id", "left")
    told = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "none given").otherwise(F.col(c))
    asked = "Read the pull request below and answer with one JSON object: summary, change_type, risk (low, medium or high), risk_reason, and walkthrough, a list of file and change."
    text = F.concat_ws("\n\n", F.lit(asked), F.concat(F.lit("Its title: "), told("title")), F.concat(F.lit("What its author says: "), told("body")), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"))
    return rows.withColumn("prompt", text).drop("b")


def summarise_pulls(pulls: DataFrame, files: DataFrame, model: Model | None = None) -> DataFrame:
    """pull_id, summary, change_type, risk, risk_reason, walkthrough; where there is no answer, plain facts stand in."""
    counts = files.groupBy("pull_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("ord") < LISTED_FILES, F.struct("ord", "filename")))).alias("first"))
    rows = (model or (lambda x: x.withColumn("answer", F.lit(None).cast("string"))))(summary_prompt(pulls, files)).join(counts, "pull_id", "left")
    v = F.from_json(_json(F.col("answer")), _SUMMARY)
    plain = F.struct(
        F.concat(F.lit("PR modifies "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" file(s).")).alias("summary"), F.lit("unknown").alias("change_type"), F.lit("medium").alias("risk"),
        F.lit("Unable to assess — review required").alias("risk_reason"),
        F.coalesce(F.transform("first", lambda f: F.struct(f["filename"].alias("file"), F.lit("Modified").alias("change"))), F.expr("cast(array() as array<struct<file:string,change:string>>)")).alias("walkthrough"),
    )
    return rows.select("pull_id", F.when(v["summary"].isNotNull(), v).otherwise(plain).alias("s")).select("pull_id", "s.*")


def observed(scores: DataFrame, name: str = "reviews") -> tuple[DataFrame, Observation]:
    """scores, and what is counted while they are first worked out: reviews, findings, and reviews with critical ones."""
    seen = Observation(name)
    return scores.observe(seen, F.count(F.lit(1)).alias("reviews_total"), F.coalesce(F.sum("n_findings"), F.lit(0)).alias("findings_total"), F.count_if(F.col("n_critical") > 0).alias("critical_reviews")), seen


def concurrent(call: Callable[[str], str], most: int = 4, tasks: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """A scorer from a function that takes a prompt and waits for its answer: at most `most` calls of a task are in flight.

    Answers keep their prompts' order; a null prompt, and a call that raises, give a null answer.  tasks: at most so many
    tasks call at once, so that tasks * most bounds all calls in flight.
    """

    def answered(prompts: pa.Array) -> pa.Array:
        def one(prompt: str | None) -> str | None:
            try:
                return None if prompt is None else call(prompt)
            except Exception:  # noqa: BLE001  an answer that fails is no answer
                return None

        with ThreadPoolExecutor(most) as pool:
            return pa.array(list(pool.map(one, prompts.to_pylist())), pa.string())

    def scorer(prompts: DataFrame) -> DataFrame:
        rows = prompts if tasks is None else prompts.coalesce(tasks)
        # What a call gives may differ the next time: the optimizer must not repeat it.
        return rows.withColumn("answer", F.arrow_udf(answered, "string").asNondeterministic()("prompt"))

    return scorer
