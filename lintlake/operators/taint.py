"""Taint: which values from outside reach dangerous calls, by an order-dependent fold over each file's lines.

The registries are small tables, so matches of lines to patterns are broadcast joins; the fold itself depends on the
order of lines and runs in one Arrow UDF a file.  Suppression is an anti join, triage a pluggable scorer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import taintbook as book
from lintlake.functions.textops import split_lines
from lintlake.functions.triggers import gram_counts, indexed_matches, trigger_index
from lintlake.operators.structure import in_slices

MOST = 20
HOP = pa.struct([("line", pa.int32()), ("col", pa.int32()), ("variable", pa.string()), ("operation", pa.string()), ("snippet", pa.string())])
CANDIDATE = pa.struct([
    ("candidate_id", pa.string()), ("source_sig", pa.string()), ("sink_sig", pa.string()), ("source_kind", pa.string()), ("sink_kind", pa.string()),
    ("source_line", pa.int32()), ("sink_line", pa.int32()), ("sink_col", pa.int32()), ("hops", pa.list_(HOP)), ("snippet", pa.string()),
])
CANDIDATE_DDL = (
    "struct<candidate_id:string,source_sig:string,sink_sig:string,source_kind:string,sink_kind:string,source_line:int,sink_line:int,sink_col:int,"
    "hops:array<struct<line:int,col:int,variable:string,operation:string,snippet:string>>,snippet:string>"
)


def _table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    def put(v) -> str:
        return "cast(null as string)" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "\\'") + "'"

    values = ", ".join("(" + ", ".join(put(v) for v in r.values()) + ")" for r in rows)
    return spark.sql(f"select * from values {values} as t({', '.join(rows[0])})")


def source_specs(spark: SparkSession) -> DataFrame:
    return _table(spark, book.sources())


def sink_specs(spark: SparkSession) -> DataFrame:
    return _table(spark, book.sinks())


def spec_matches(files: DataFrame, specs: DataFrame) -> DataFrame:
    """file_id, line_no, kind, signature: lines that hold a spec's pattern.  specs: a fixed list, read as an index by each pattern's rarest gram."""
    index = trigger_index(specs, gram_counts(files, specs, "language"), "language")
    met = indexed_matches(files.select("file_id", "language", "code"), split_lines(F.col("code")), index, "language")
    return met.select("file_id", (F.col("i") + 1).alias("line_no"), "kind", "signature")


class Line(NamedTuple):
    """What the fold needs to know of a line; lines without an assignment and without a sink aren't read."""

    no: int
    text: str
    words: frozenset[str]
    clean: bool
    name: str | None
    source: dict | None
    given: frozenset[str]
    given_clean: bool
    embeds: bool
    sinks: list[dict]


class Reader:
    """Turns a file's lines into facts, by the registries of one language."""

    def __init__(self, language: str, strict_shell: bool = False):
        own = lambda rows: [r for r in rows if r["language"] == language]
        one = lambda patterns: re.compile("|".join(map(re.escape, patterns)) or r"(?!)")
        self.sources, self.sinks, self.strict = own(book.sources()), own(book.sinks()), strict_shell
        self.some_source, self.some_sink = one(r["pattern"] for r in self.sources), one(r["pattern"] for r in self.sinks)
        self.cleaner = one(book.SANITIZERS.get(language, []))
        self.assignment = re.compile(book.ASSIGNMENT.get(language, book.ASSIGNMENT["other"]))
        self.embedding = re.compile(book.INTERPOLATED.get(language, r"(?!)"))

    def read(self, lines: list[str]) -> Iterator[Line]:
        for no, text in enumerate(lines, 1):
            bare = text.strip()
            if not bare or bare[0] == "#" or bare[:2] == "//":
                continue
            assigned = self.assignment.match(bare)
            name = assigned[1] if assigned and assigned[1] not in book.RESERVED else None
            sinks = [r for r in self.sinks if r["pattern"] in text and self._dangerous(r, text)] if self.some_sink.search(text) else []
            if not name and not sinks:
                continue
            # Of several sources the one last in the registry counts.
            source = next((r for r in reversed(self.sources) if r["pattern"] in text), None) if name and self.some_source.search(text) else None
            given = text.partition("=")[2] if "=" in text else text
            yield Line(no, text, _words(text), bool(self.cleaner.search(text)), name, source, _words(given), bool(self.cleaner.search(given)), bool(self.embedding.search(text)), sinks)

    def _dangerous(self, sink: dict, text: str) -> bool:
        return not (self.strict and sink["shell_only"]) or bool(re.search(r"shell\s*=\s*True", text))


def _words(text: str) -> frozenset[str]:
    """A name stands in a text as a whole word just if it is one of these."""
    return frozenset(re.findall(r"\w+", text))


def flows(facts: Iterable[Line]) -> Iterator[tuple[Line, dict, tuple[dict, list[dict]]]]:
    """(line, sink, (source, hops)) for each value from outside that a sink's line names, in order of discovery.

    The state is what each name holds, in the order in which names came to hold anything; nothing is ever forgotten.
    """
    held: dict[str, tuple[dict, list[dict]]] = {}
    for at in facts:
        if at.name and (at.source or at.name not in held):
            hop = {"line": at.no, "col": at.text.find(at.name), "variable": at.name, "operation": "assign", "snippet": at.text.rstrip()}
            if at.source:
                held[at.name] = at.source, [hop]
            elif not at.given_clean:
                passed = (t for v, t in held.items() if v in at.given or at.embeds and v in at.text)
                if trail := next(passed, None):
                    held[at.name] = trail[0], [*trail[1], hop]
        if at.sinks and not at.clean:
            reaching = [t for v, t in held.items() if v in at.words]
            yield from ((at, sink, trail) for sink in at.sinks for trail in reaching)


def candidates_of(lines: list[str], reader: Reader, most: int, function: str | None = None) -> list[dict]:
    """The first `most` different candidates of a file."""
    found: dict[str, dict] = {}
    for at, sink, (source, hops) in flows(reader.read(lines)):
        key = hashlib.sha256(f"{source['signature']}:{sink['signature']}:{function}:{at.no}".encode()).hexdigest()[:16]
        if key not in found:
            found[key] = {
                "candidate_id": key, "source_sig": source["signature"], "sink_sig": sink["signature"], "source_kind": source["kind"], "sink_kind": sink["kind"],
                "source_line": hops[0]["line"], "sink_line": at.no, "sink_col": at.text.find(sink["pattern"]), "hops": hops, "snippet": excerpt(lines, {at.no, *(h["line"] for h in hops)}),
            }
        if len(found) == most:
            break
    return list(found.values())


def excerpt(lines: list[str], marked: set[int], around: int = 2) -> str:
    """Numbered lines from a little before the first marked one to a little after the last, the marked ones pointed out."""
    shown = range(max(1, min(marked) - around), min(len(lines), max(marked) + around) + 1)
    return "\n".join(f"{no:3d}{' >> ' if no in marked else '    '}{lines[no - 1]}" for no in shown)


def taint_candidates(files: DataFrame, most: int = MOST, strict_shell: bool = False) -> DataFrame:
    """file_id, language, ord and the candidate's fields; at most `most` a file, in order of discovery."""

    def fold(lines: pa.Array, language: pa.Array) -> pa.Array:
        readers = {k: Reader(k, strict_shell) for k in language.unique().to_pylist()}
        return in_slices(lambda owns, kinds: [candidates_of(own or [], readers[k], most) for own, k in zip(owns, kinds, strict=True)], pa.list_(CANDIDATE), lines, language)

    run = F.arrow_udf(fold, f"array<{CANDIDATE_DDL}>")
    rows = files.select("file_id", "language", run(split_lines(F.col("code")), F.col("language")).alias("found"))
    return rows.select("file_id", "language", F.posexplode("found").alias("ord", "c")).select("file_id", "language", "ord", "c.*")


def without_suppressed(candidates: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Candidates whose (source_sig, sink_sig) isn't suppressed."""
    return candidates.join(suppressed, ["source_sig", "sink_sig"], "left_anti")


def parse_verdict(text: Column) -> Column:
    """A scorer's JSON answer, code fences removed: struct(exploitable, confidence in 0..1 or 0.5, ...); null if it is none."""
    body = F.regexp_replace(F.trim(text), r"^```[a-z]*\s*|\s*```$", "")
    v = F.from_json(body, "exploitable boolean, confidence double, exploit_scenario string, suggested_sanitizer string, reasoning string")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v["confidence"], F.lit(0.5))))
    return F.when(v["exploitable"].isNotNull(), F.struct(v["exploitable"].alias("exploitable"), sure.alias("confidence"), v["exploit_scenario"].alias("exploit_scenario"), v["suggested_sanitizer"].alias("suggested_sanitizer"), v["reasoning"].alias("reasoning")))


def prompt(candidates: DataFrame) -> Column:
    return F.format_string("Language: %s\nSource: %s (line %d)\nSink: %s (line %d)\n\n%s\n\nAnswer in JSON: is this exploitable?", *(candidates[c] for c in ("language", "source_kind", "source_line", "sink_kind", "sink_line", "snippet")))


def offline_scorer(prompts: DataFrame) -> DataFrame:
    """A deterministic stand-in for a model: direct flows are likelier exploitable.  prompts: candidate columns."""
    sure = F.when(F.size("hops") <= 1, F.lit(0.9)).when(F.size("hops") <= 3, F.lit(0.7)).otherwise(F.lit(0.5))
    return prompts.withColumn("answer", F.to_json(F.struct(F.lit(True).alias("exploitable"), sure.alias("confidence"))))


def triage(candidates: DataFrame, scorer: Callable[[DataFrame], DataFrame] = offline_scorer, least: float = 0.6, critical: float = 0.85) -> DataFrame:
    """Findings for candidates that the scorer holds exploitable with confidence `least`; no answer counts as 0.4."""
    rows = scorer(candidates.withColumn("prompt", prompt(candidates))).withColumn("v", parse_verdict(F.col("answer")))
    sure = F.coalesce(F.col("v.confidence"), F.lit(0.4))
    kept = rows.where(F.coalesce(F.col("v.exploitable"), F.lit(True)) & (sure >= least))
    return kept.select(
        "file_id", "language", "candidate_id", "ord",
        F.when(sure >= critical, "critical").otherwise("high").alias("severity"), F.lit("security").alias("category"),
        F.concat(F.lit("Tainted data flow: "), "source_kind", F.lit(" to "), "sink_kind").alias("title"), sure.alias("confidence"),
        F.col("sink_line").alias("line_start"), F.col("sink_line").alias("line_end"), F.lit("dataflow").alias("source"),
        F.coalesce("v.exploit_scenario", F.concat("source_kind", F.lit(" data of line "), F.col("source_line").cast("string"), F.lit(" reaches "), "sink_kind")).alias("description"),
        F.coalesce("v.suggested_sanitizer", F.lit("Check or escape the value before it is used there.")).alias("suggestion"),
    )
