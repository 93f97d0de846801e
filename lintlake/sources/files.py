"""Readers: source trees, language detection, reports of other tools, pull-request and review files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.textops import matches

#: Folders that are passed over, and languages by extension and by the first line.
SKIPPED = ("node_modules", "vendor", "__pycache__", ".git", "dist", "build", ".venv", "venv", ".tox", ".mypy_cache")
BY_EXTENSION = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java"}
#: By extension for a path beside a caller's hint, and the languages a hint may name.
BY_HINTED_EXTENSION = {"py": "python", "js": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go"}
HINTS = ("python", "javascript", "typescript", "go", "rust", "java")
BY_SHEBANG = (("python", "python"), ("node", "javascript"), ("bun", "javascript"), ("deno", "typescript"))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over all cores, where they come from fewer files than there are cores: a small file is read by one task, which
    the work on each row would keep busy alone.  Tables of many files stay as they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(2 * cores, *keys)


def detect_language(path: Column, code: Column) -> Column:
    """By the extension, else by a #! line; null if neither tells."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in BY_EXTENSION.items() for x in pair))
    first = F.lower(F.split_part(code, F.lit("\n"), F.lit(1)))
    bang = F.lit(None).cast("string")
    for word, language in reversed(BY_SHEBANG):
        bang = F.when(first.startswith("#!") & first.contains(word), language).otherwise(bang)
    return F.coalesce(F.try_element_at(known, suffix), bang)


def hinted_language(path: Column, hint: Column) -> Column:
    """By the extension, else the hint if it names a language, else python."""
    suffix = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in BY_HINTED_EXTENSION.items() for x in pair))
    return F.coalesce(F.try_element_at(known, suffix), F.when(hint.isin(*HINTS), hint), F.lit("python"))


def decoded(content: Column) -> Column:
    """Bytes as text; those that are no UTF-8 are dropped, replacement characters that the text holds itself are kept."""
    own, kept = "\uFFFD", "\uFFFE"
    text = F.replace(content.cast("string"), F.lit(own), F.lit(kept))
    return F.replace(F.replace(F.make_valid_utf8(text), F.lit(own), F.lit("")), F.lit(kept), F.lit(own))


def scan_tree(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED, only: list[str] | None = None) -> DataFrame:
    """file_id, path, language, code of all files below root whose language is known; bytes that are no UTF-8 are dropped.

    Paths are listed first, without reading a byte; only folders that aren't skipped are read then.  only: names below root.
    """
    if only is not None:
        paths = [f"{root.rstrip('/')}/{name}" for name in only]
        raw = spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], "path string, content binary")
    else:
        names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
        inside = F.split(F.substring_index("path", root.rstrip("/") + "/", -1), "/")
        kept = names.where(~F.arrays_overlap(inside, F.array(*(F.lit(s) for s in skipped))))
        folders = sorted(r[0] for r in kept.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).distinct().collect())  # the driver lists them anyway
        raw = spark.read.format("binaryFile").load(folders) if folders else names.withColumn("content", F.lit(b"")).limit(0)
    rows = raw.select("path", decoded(F.col("content")).alias("code"))
    rows = rows.withColumn("language", detect_language(F.col("path"), F.col("code"))).where("language is not null")
    return rows.select(F.xxhash64("path").alias("file_id"), "path", "language", "code")


def read_file(spark: SparkSession, path: str, hint: str = "python") -> DataFrame:
    """file_id, path, language, code of one file, bytes that are no UTF-8 replaced; no row if there is none."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", path.rsplit("/", 1)[-1]).load(path.rsplit("/", 1)[0] if "/" in path else ".")
    code = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.select(F.xxhash64("path").alias("file_id"), "path", hinted_language(F.col("path"), F.lit(hint)).alias("language"), code.alias("code"))


def valid_requests(requests: DataFrame, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) review requests by the length of their code."""
    ok = F.coalesce(F.length("code").between(1, most), F.lit(False))
    return requests.where(ok), requests.where(~ok)


#: A run's rules are few and typed; each result is a variant of its own, so that fields which aren't read stay with it.
_PROPERTIES = "properties:struct<`problem.severity`:string>"
_SARIF = f"runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,{_PROPERTIES}>>>>,results:array<variant>>>"
#: Severities of the reports' own words.
SARIF_SEVERITY = {"error": "critical", "warning": "high", "recommendation": "medium", "note": "medium"}
SEMGREP_SEVERITY = {"ERROR": "critical", "WARNING": "high", "INFO": "medium", "NOTE": "low"}


def _mapped(value: Column, table: dict[str, str], default: str | None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def read_sarif(reports: DataFrame) -> DataFrame:
    """tool, rule_id, title, severity, category, confidence, file_path, line_start, line_end, raw of the first run of SARIF reports (column json).

    Severity: the result's own problem severity if it is a known one, else its rule's (warning where the rule has none),
    else, for rules that aren't listed, the result's level (warning where it has none); words that aren't known are high.
    raw: the whole result as a variant, what is read from it and what isn't.
    """
    run = reports.select(F.get(F.from_json("json", _SARIF)["runs"], F.lit(0)).alias("run"))
    rows = run.select(F.col("run.tool.driver.name").alias("tool"), F.col("run.tool.driver.rules").alias("rules"), F.explode("run.results").alias("raw"))
    field = lambda path, kind="string": F.try_variant_get("raw", path, kind)
    rows = rows.withColumn("rule_id", field("$.ruleId"))
    # Of rules listed twice the last one counts.
    own = F.element_at(F.filter("rules", lambda x: x["id"] == F.col("rule_id")), -1)
    rows = rows.withColumn("own", F.when(F.exists("rules", lambda x: x["id"] == F.col("rule_id")), own))
    word = lambda c: F.lower(F.coalesce(c, F.lit("warning")))
    severity = F.coalesce(
        _mapped(F.lower(field("$.properties['problem.severity']")), SARIF_SEVERITY, None),
        F.when(F.col("own").isNotNull(), _mapped(word(F.col("own.properties.`problem.severity`")), SARIF_SEVERITY, "high")),
        _mapped(word(field("$.level")), SARIF_SEVERITY, "high"),
    )
    place = "$.locations[0].physicalLocation"
    first, last = (field(f"{place}.region.{c}", "int") for c in ("startLine", "endLine"))
    return rows.select(
        "tool", "rule_id", F.coalesce(field("$.message.text"), "rule_id", F.lit("")).alias("title"), severity.alias("severity"),
        F.lit("security").alias("category"), F.lit(1.0).alias("confidence"), field(f"{place}.artifactLocation.uri").alias("file_path"),
        first.alias("line_start"), F.coalesce(last, first).alias("line_end"), "raw",
    )


def read_semgrep(reports: DataFrame) -> DataFrame:
    """tool, rule_id, title, severity, category, confidence, file_path, line_start, line_end, raw of JSON reports (column json)."""
    rows = reports.select(F.explode(F.from_json("json", "results array<variant>")["results"]).alias("raw"))
    field = lambda path, kind="string": F.try_variant_get("raw", path, kind)
    severity = _mapped(F.upper(F.coalesce(field("$.extra.severity"), F.lit("INFO"))), SEMGREP_SEVERITY, "medium")
    title = F.coalesce(field("$.extra.message"), field("$.check_id"), F.lit(""))
    return rows.select(
        F.lit("semgrep").alias("tool"), field("$.check_id").alias("rule_id"), title.alias("title"), severity.alias("severity"),
        F.lit("security").alias("category"), F.lit(1.0).alias("confidence"), field("$.path").alias("file_path"),
        field("$.start.line", "int").alias("line_start"), field("$.end.line", "int").alias("line_end"), "raw",
    )


def raw_fields(findings: DataFrame) -> DataFrame:
    """tool, field, n: how many findings hold a top-level field of their raw results, whether a reader uses it or not."""
    keys = F.map_keys(F.try_variant_get("raw", "$", "map<string,variant>"))
    return findings.select("tool", F.explode(keys).alias("field")).groupBy("tool", "field").agg(F.count("*").alias("n"))


_GOLDEN = "array<struct<category:string,severity:string,title_pattern:string,min_count:int>>"


def read_golden(files: DataFrame) -> DataFrame:
    """sample_id, ord, category, severity, title_pattern, min_count (1 by default) of golden files (sample_id, json): a list, or an object with expected_findings."""
    listed = F.when(matches(F.col("json"), r"^\s*\["), F.from_json("json", _GOLDEN)).otherwise(F.from_json("json", f"expected_findings {_GOLDEN}")["expected_findings"])
    rows = files.select("sample_id", F.posexplode(listed).alias("ord", "e"))
    return rows.select("sample_id", "ord", "e.category", "e.severity", "e.title_pattern", F.coalesce("e.min_count", F.lit(1)).alias("min_count"))


_CONTENT = "filename:string,status:string,additions:int,deletions:int,changes:int,raw_url:string,patch:string"


def read_pull_files(pages: DataFrame) -> DataFrame:
    """The files of pull requests from stored response pages (column json, each an array of files)."""
    return pages.select(F.explode(F.from_json("json", f"array<struct<{_CONTENT}>>")).alias("f")).select("f.*")


_PULL = "title string, body string, user struct<login:string>, base struct<ref:string>, head struct<ref:string>, additions int, deletions int, changed_files int"


def read_pull(pages: DataFrame) -> DataFrame:
    """title, body, author, base_branch, head_branch, additions, deletions, changed_files of stored pull requests (column json); what is missing is empty or 0."""
    p = F.from_json("json", _PULL)
    text = lambda c: F.coalesce(c, F.lit(""))
    counts = [F.coalesce(p[c], F.lit(0)).alias(c) for c in ("additions", "deletions", "changed_files")]
    return pages.select(text(p["title"]).alias("title"), text(p["body"]).alias("body"), text(p["user"]["login"]).alias("author"), text(p["base"]["ref"]).alias("base_branch"), text(p["head"]["ref"]).alias("head_branch"), *counts)


def owner_and_name(full_name: Column) -> Column:
    """struct(owner, name) of a repository's full name, cut at the first slash."""
    cut = F.instr(full_name, "/")
    owner = F.when(cut > 0, F.substring(full_name, F.lit(1), cut - 1)).otherwise(full_name)
    return F.struct(owner.alias("owner"), F.when(cut > 0, F.substring(full_name, cut + 1, F.length(full_name))).otherwise("").alias("name"))


def decode_content(content: Column, size: Column, most: int = 100_000) -> Column:
    """Text of base64 file content; null if it is too large, no base64 or no UTF-8."""
    data = F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64"))
    return F.when((size <= most) & F.is_valid_utf8(data.cast("string")), data.cast("string"))
