"""Named queries over the driver's tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import rulebook as book
from lintlake.functions import taintbook
from lintlake.functions.predicates import quote
from lintlake.functions.rulebook import RULES
from lintlake.functions.textops import line_count, split_lines
from lintlake.operators import agents, bench, blocks, feedback, graph, graph_table, metrics, pulls, review, rules, store, structure, taint, temporal
from lintlake.operators.parking import park
from lintlake.sources import files as readers
from lintlake.sources import samples
from lintlake.sources.corpus import TEMPLATES, code_files, code_files_sql, code_keys, noted_files, repeated_files, repeated_files_sql, shaped_files, shaped_scripts
from lintlake.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Rules that both sides can run; the others keep state that SQL can't, or read the structure.
SHARED = [r for r in RULES if rules.has_sql(r)]


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Lines and rules ---

_LINES = "with " + rules.lines_sql(code_files_sql(), [])


@_query(_LINES + " select file_id, i as line_no, line from lines")
def line_explode(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return files.select("file_id", F.posexplode(split_lines(F.col("code"))).alias("i", "line")).select("file_id", (F.col("i") + 1).alias("line_no"), "line")


@_query(f"with files as ({code_files_sql()}) select file_id, length(code) - length(replace(code, chr(10), '')) + 1 as n_lines from files")
def line_count_file(spark, sf_dir):
    return code_files(spark, sf_dir).select("file_id", line_count(F.col("code")).alias("n_lines"))


#: The rules that the templates never break run over other files made from the same documents.
_MADE = {"PY006": shaped_files, "PY007": shaped_files, "PY008": shaped_files, "JS004": shaped_scripts, "CL002": repeated_files}
_SHAPED = "select doc_id as file_id, doc_id % 13 as deep, doc_id % 130 + 1 as long from documents"


def _rule_query(rule_id: str) -> Query:
    def run(spark, sf_dir):
        files = _MADE.get(rule_id, code_files)(spark, sf_dir)
        if any(r.kind in ("complexity", "long_function", "nesting") for r in RULES if r.id == rule_id):
            files = structure.with_structure(files)
        return rules.raw_findings(files, only=(rule_id,)).select("file_id", "rule_id", "line_start")

    return run


for _id in dict.fromkeys(r.id for r in RULES):
    _own = [r for r in RULES if r.id == _id]
    QUERIES[f"rule_{_id.lower()}"] = _rule_query(_id)
    if all(rules.has_sql(r) for r in _own):
        ORACLES[f"rule_{_id.lower()}"] = "with " + rules.lines_sql(repeated_files_sql() if _id == "CL002" else code_files_sql(), _own) + " " + " union all ".join(rules.rule_sql(r) for r in _own)

ORACLES["rule_py006"] = f"select file_id, 'PY006' as rule_id, cast(null as integer) as line_start from ({_SHAPED}) where deep + 1 > 10"
ORACLES["rule_py007"] = f"select file_id, 'PY007' as rule_id, 1 as line_start from ({_SHAPED}) where 1 + deep + long > 50"
ORACLES["rule_py008"] = f"select file_id, 'PY008' as rule_id, cast(null as integer) as line_start from ({_SHAPED}) where deep + 1 > 6"

ORACLES["rule_js004"] = f"select file_id, 'JS004' as rule_id, cast(null as integer) as line_start from ({_SHAPED}) where deep + 1 > 5"


def _loop_body_sql() -> str:
    """PERF001 without a fold: a line is inside a loop before it if all lines between are indented deeper than that loop."""
    compiles = " or ".join(f"(language = {quote(k)} and regexp_matches(line, {quote(v)}) and not starts_with(stripped, '#') {'' if k != 'python' else _UNQUOTED})" for k, v in book.COMPILE_CALL.items())
    return (
        "with " + rules.lines_sql(code_files_sql(), []) + ", code_lines as (select file_id, language, i, line, stripped, length(line) - length(regexp_replace(line, '^\\s+', '')) as depth from lines where stripped <> '' and not starts_with(stripped, '#') and not starts_with(stripped, '//')),"
        f" loops as (select * from code_lines where regexp_matches(line, {quote(book.LOOP_LINE)})),"
        f" hits as (select * from code_lines where ({compiles}) and not regexp_matches(line, {quote(book.LOOP_LINE)}))"
        " select file_id, 'PERF001' as rule_id, i as line_start from hits h where exists (select 1 from loops l where l.file_id = h.file_id and l.i < h.i and l.depth < h.depth"
        " and not exists (select 1 from code_lines m where m.file_id = l.file_id and m.i > l.i and m.i <= h.i and m.depth <= l.depth))"
    )


_UNQUOTED = "and not regexp_matches(stripped, '^(''|\"|f''|f\"|`)')"
ORACLES["rule_perf001"] = _loop_body_sql()


def _numbers_sql() -> str:
    """CL003 without looking around: a line is cut at its runs of three and more digits, and each run judged by its neighbours."""
    listed = lambda values: ", ".join(map(str, values))
    apart = " and ".join(f"not starts_with(stripped, '{x}')" for x in ("#", "//", "*")) + " and " + " and ".join(f"not contains(stripped, {quote(x)})" for x in ("import", '"' * 3, "'" * 3))
    return (
        "with " + rules.lines_sql(code_files_sql(), []) + ", pieces as (select file_id, i, line, string_split(regexp_replace(line, '(\\d{3,})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) as ps from lines where regexp_matches(line, '\\d{3}') and " + apart + "),"
        " runs as (select *, unnest(range(2, len(ps) + 1, 2)) as j from pieces), placed as (select *, ps[j] as digits, length(array_to_string(ps[1:j - 1], '')) as start from runs),"
        " told as (select *, lower(substring(line, greatest(0, start - 30) + 1, start + length(digits) + 30 - greatest(0, start - 30))) as context, ltrim(digits, '0') as value from placed"
        " where not regexp_matches(ps[j - 1], '[\"''.\\pL\\pM\\p{Nd}\\p{Pc}]$') and not regexp_matches(ps[j + 1], '^[\"''\\pL\\pM\\p{Nd}\\p{Pc}]'))"
        f" select file_id, 'CL003' as rule_id, cast(i as integer) as line_start from told where {' and '.join(f'not contains(context, {quote(w)})' for w in book.NUMBER_CONTEXT)}"
        f" and (length(value) > 6 or (coalesce(try_cast(value as integer), 0) not in ({listed(book.PLAIN_NUMBERS)}, {listed(book.KNOWN_PORTS)}) and coalesce(try_cast(value as integer), 0) not between {book.HTTP_STATUS[0]} and {book.HTTP_STATUS[1]}))"
    )


ORACLES["rule_cl003"] = _numbers_sql()

_META = "(values " + ", ".join(f"({quote(r.id)}, {quote(r.key)}, {i}, {quote(r.severity)}, {quote(r.category)}, {r.confidence}::double)" for i, r in enumerate(RULES)) + ") as m(rule_id, key, rule_ord, severity, category, confidence)"


def _all_sql() -> str:
    """CTEs up to `found`: file_id, line_start, rule_ord and the rule's attributes, for all shared rules."""
    parts = [f"select file_id, {quote(r.key)} as key, line_start from ({rules.rule_sql(r)})" for r in SHARED]
    union = " union all ".join(parts)
    return "with " + rules.lines_sql(code_files_sql(), SHARED) + f", hits as ({union}), found as (select file_id, m.rule_id, m.rule_ord, m.severity, m.category, m.confidence, line_start from hits join {_META} on hits.key = m.key)"


_DEDUP = ", best as (select * from (select *, row_number() over (partition by file_id, line_start, category order by confidence desc, rule_ord) as rn from found) where rn = 1)"
_SCORES = (
    ", counted as (select file_id, count(*) as n_findings, "
    + ", ".join(f"count(*) filter (severity = '{s}') as n_{s}" for s in review.SEVERITIES)
    + ", sum(case severity " + " ".join(f"when '{s}' then {p}" for s, p in review.PENALTY.items()) + " end) as off from best group by file_id)"
    ", scores as (select f.file_id, f.language, coalesce(n_findings, 0) as n_findings, " + ", ".join(f"coalesce(n_{s}, 0) as n_{s}" for s in review.SEVERITIES)
    + ", cast(greatest(0, least(100, 100 - coalesce(off, 0))) as integer) as score from files f left join counted c on f.file_id = c.file_id)"
)


def _shared_findings(spark, sf_dir) -> DataFrame:
    return rules.raw_findings(code_files(spark, sf_dir), only=tuple(r.key for r in SHARED))


def _stored_findings(spark, sf_dir) -> DataFrame:
    """The deduplicated findings, written once where a query reads them more than once: the rules aren't run again."""
    return park(rules.dedup(_shared_findings(spark, sf_dir)), "findings")


def _scores(spark, sf_dir) -> DataFrame:
    return review.file_scores(code_keys(spark, sf_dir), rules.dedup(_shared_findings(spark, sf_dir)))


@_query(_all_sql() + " select file_id, rule_id, line_start, severity, category, confidence from found")
def rules_shared_findings(spark, sf_dir):
    return _shared_findings(spark, sf_dir).select("file_id", "rule_id", "line_start", "severity", "category", "confidence")


@_query()
def rules_all_findings(spark, sf_dir):
    """Every rule, structural ones too; state and structure have no SQL twin."""
    files = structure.with_structure(code_files(spark, sf_dir))
    return rules.raw_findings(files).drop("language")


@_query(_all_sql() + _DEDUP + " select file_id, line_start, category, rule_id, severity, confidence from best")
def dedup_line_category(spark, sf_dir):
    return rules.dedup(_shared_findings(spark, sf_dir)).select("file_id", "line_start", "category", "rule_id", "severity", "confidence")


@_query(_all_sql() + _DEDUP + " select file_id, line_start, line_start as line_end, category, rule_id from best")
def dedup_line_range(spark, sf_dir):
    return review.dedup_ranges(review.merge(_shared_findings(spark, sf_dir))).select("file_id", "line_start", "line_end", "category", "rule_id")


@_query(_all_sql() + _DEDUP + _SCORES + " select * from scores")
def review_score(spark, sf_dir):
    return _scores(spark, sf_dir).drop("summary")


@_query(
    _all_sql() + _DEDUP + _SCORES + " select file_id, case when n_findings = 0 then 'No issues found. Code looks clean and well-structured.' else concat_ws(' ', 'Found ' || n_findings || case when n_findings = 1 then ' issue.' else ' issues.' end,"
    " case when n_critical > 0 then n_critical || ' critical.' end, case when score >= 80 then 'Overall the code is in good shape with minor improvements needed.' when score >= 50 then 'Several issues should be addressed before production use.'"
    " else 'Significant issues found that require immediate attention.' end) end as summary from scores"
)
def review_summary(spark, sf_dir):
    return _scores(spark, sf_dir).select("file_id", "summary")


@_query(_all_sql() + _DEDUP + " select severity, count(*) as n from best group by severity")
def severity_counts(spark, sf_dir):
    return review.severity_counts(rules.dedup(_shared_findings(spark, sf_dir)))


@_query(_all_sql() + _DEDUP + " select file_id, " + ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in review.SEVERITIES) + " from best group by file_id")
def file_severity_pivot(spark, sf_dir):
    return review.severity_pivot(rules.dedup(_shared_findings(spark, sf_dir)))


@_query(
    _all_sql() + _DEDUP + _SCORES + ", t as (select cast(sum(score) // count(*) as integer) as score, sum(n_critical) as critical, sum(n_high) as high from scores) select"
    " not (score < 90 or critical > 0 or high > 5) as passed, score, concat_ws('; ', case when score < 90 then 'Score ' || score || ' is below minimum 90' end, case when critical > 0 then critical || ' critical finding(s) (max: 0)' end,"
    " case when high > 5 then high || ' high finding(s) (max: 5)' end) as reasons from t"
)
def quality_gate(spark, sf_dir):
    gate = review.quality_gate(_scores(spark, sf_dir), min_score=90, max_critical=0, max_high=5)
    return gate.withColumn("reasons", F.array_join("reasons", "; "))


@_query(_all_sql() + _DEDUP + " select file_id, rule_id, line_start from best where severity in ('critical', 'high') and confidence >= 0.85")
def blocking_findings(spark, sf_dir):
    return review.at_least(rules.dedup(_shared_findings(spark, sf_dir)), "high", 0.85).select("file_id", "rule_id", "line_start")


@_query(
    _all_sql() + _DEDUP + " select file_id, rule_id, line_start from best order by case severity " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(review.SEVERITIES)) + " end, coalesce(nullif(line_start, 0), 999999), rule_id, file_id limit 20"
)
def sorted_findings_topk(spark, sf_dir):
    """The twenty findings at the head of a report; the limit is the feature."""
    found = rules.dedup(_shared_findings(spark, sf_dir))
    return found.orderBy(*review.position(), "file_id").limit(20).select("file_id", "rule_id", "line_start")


#: Files of known shape, every second one with two comments before each line: their tokens and lines are counted by hand.
_NOTED = (
    f"select *, case when file_id % 2 = 0 then 2 * long else 0 end as notes, 6 + 3 * deep + 5 * long as words, 1 + deep + long * case when file_id % 2 = 0 then 3 else 1 end as height, cast(file_id % 9 as integer) as n from ({_SHAPED})"
)


@_query(
    f"select file_id, n as n_findings, cast(greatest(0, least(100, 100 - (10 * (n // 2) + 5 * (n - n // 2)) + case when notes::double / (words + notes) > 0.15 then 5 else 0 end"
    f" + case when deep + 1 <= 3 then 5 else 0 end + case when height < 30 then 5 else 0 end)) as integer) as score from ({_NOTED})"
)
def review_bonuses(spark, sf_dir):
    """Scores with what comments, flat nesting and short functions add: a file's findings are medium and high by turns."""
    files = structure.with_structure(noted_files(spark, sf_dir))
    each = F.explode(F.sequence(F.lit(0), F.pmod("file_id", F.lit(9)).cast("int")))
    found = files.select("file_id", each.alias("i")).where("i > 0").select("file_id", F.when(F.col("i") % 2 == 0, "high").otherwise("medium").alias("severity"))
    return review.file_scores(files, found, structured=True).select("file_id", F.col("n_findings").cast("int").alias("n_findings"), "score")


#: What rules find that need no structure: the shared rules' findings, magic numbers and regular expressions in loops.
_TEXT_RULES = " union all ".join([
    f"select * from ({_all_sql()} select file_id, rule_id, line_start, severity, category, confidence from found)",
    *(f"select h.file_id, h.rule_id, h.line_start, m.severity, m.category, m.confidence from ({ORACLES[q]}) h join {_META} on h.rule_id = m.rule_id" for q in ("rule_cl003", "rule_perf001")),
])


@_query(_TEXT_RULES)
def rules_text_findings(spark, sf_dir):
    """Every rule that reads text alone, those with state too, over all files: what is found and where."""
    return rules.raw_findings(code_files(spark, sf_dir)).select("file_id", "rule_id", "line_start", "severity", "category", "confidence")


# --- Structure and taint ---


@_query()
def file_metrics(spark, sf_dir):
    s = F.col("structure")
    rows = structure.with_structure(code_files(spark, sf_dir))
    return rows.select("file_id", "language", F.size(s["functions"]).alias("n_functions"), F.size(s["classes"]).alias("n_classes"), F.size(s["imports"]).alias("n_imports"), *(s[c].alias(c) for c in ("lines_of_code", "complexity", "max_nesting", "comment_ratio", "avg_function_length", "max_function_length")))


@_query(f"select file_id, deep + 1 as max_nesting, deep + 1 as complexity, 2 + deep + long as lines_of_code, 1 + deep + long as max_function_length, 1 as n_functions, 1 as n_params from ({_SHAPED})")
def shaped_metrics(spark, sf_dir):
    """Metrics of files whose shape is known."""
    s = F.col("structure")
    rows = structure.with_structure(shaped_files(spark, sf_dir))
    return rows.select("file_id", *(s[c].alias(c) for c in ("max_nesting", "complexity", "lines_of_code", "max_function_length")), F.size(s["functions"]).alias("n_functions"), F.get(s["functions"], F.lit(0))["params"].alias("n_params"))


@_query()
def summary_texts(spark, sf_dir):
    return structure.with_structure(code_files(spark, sf_dir)).select("file_id", structure.summary_text(F.col("structure")).alias("summary"))


def _specs_sql(rows: list[dict]) -> str:
    return "(values " + ", ".join(f"({quote(r['language'])}, {quote(r['kind'])}, {quote(r['pattern'])}, {quote(r['signature'])})" for r in rows) + ") as s(language, kind, pattern, signature)"


@_query(_LINES + f" select file_id, i as line_no, kind, signature from lines join {_specs_sql(taintbook.sources())} on lines.language = s.language and contains(line, pattern)")
def source_line_matches(spark, sf_dir):
    return taint.spec_matches(code_files(spark, sf_dir), taint.source_specs(spark))


@_query(_LINES + f" select file_id, i as line_no, kind, signature from lines join {_specs_sql(taintbook.sinks())} on lines.language = s.language and contains(line, pattern)")
def sink_line_matches(spark, sf_dir):
    return taint.spec_matches(code_files(spark, sf_dir), taint.sink_specs(spark))


@_query(
    "select signature, substring(sha256(concat_ws(':', kind, language, coalesce(call_pattern, 'None'), coalesce(attr_pattern, 'None'))), 1, 12) as computed from (values "
    + ", ".join(f"({quote(r['kind'])}, {quote(r['language'])}, {quote(r['call_pattern']) if r['call_pattern'] else 'null'}, {quote(r['attr_pattern']) if r['attr_pattern'] else 'null'}, {quote(r['signature'])})" for r in taintbook.sources())
    + ") as s(kind, language, call_pattern, attr_pattern, signature)"
)
def spec_signatures(spark, sf_dir):
    s = taint.source_specs(spark)
    made = F.substring(F.sha2(F.concat_ws(":", "kind", "language", F.coalesce("call_pattern", F.lit("None")), F.coalesce("attr_pattern", F.lit("None"))), 256), 1, 12)
    return s.select("signature", made.alias("computed"))


#: The flows of the templates, by reading: template, order, source's kind, call and attribute, sink's kind and call, line of
#: the source, line of the sink, assignments on the way.
_FLOWS = [
    (0, 0, "http_param", None, "request.args", "ssrf_fetch", "requests.get(", 15, 16, 1),
    (0, 1, "deserialized", "yaml.load", None, "deserialized", "yaml.load(", 18, 18, 1),
    (1, 0, "http_body", None, "request.form", "sql_query", ".execute(", 13, 15, 2),
    (1, 1, "argv", None, "sys.argv", "path_traversal", "open(", 16, 17, 1),
    (1, 2, "file_read", "open(", None, "path_traversal", "open(", 17, 17, 1),
    (3, 0, "http_body", None, "req.body", "sql_query", ".query(", 13, 14, 1),
]


def _flows_sql() -> str:
    put = lambda x: str(x) if isinstance(x, int) else quote(str(x))
    rows = ", ".join(f"({k}, {quote(TEMPLATES[k][0])}, {', '.join(map(put, rest))})" for k, *rest in _FLOWS)
    source = "substring(sha256(concat_ws(':', source_kind, language, call, attribute)), 1, 12)"
    sink = "substring(sha256(concat_ws(':', sink_kind, language, sink)), 1, 12)"
    return (
        f"select doc_id as file_id, ord, {source} as source_sig, {sink} as sink_sig, substring(sha256(concat_ws(':', {source}, {sink}, 'None', sink_line)), 1, 16) as candidate_id, source_kind, sink_kind, source_line, sink_line, n_hops from documents"
        f" join (values {rows}) as v(k, language, ord, source_kind, call, attribute, sink_kind, sink, source_line, sink_line, n_hops) on doc_id % {len(TEMPLATES)} = k"
    )


@_query(f"select file_id, ord, candidate_id, source_kind, sink_kind, source_line, sink_line, n_hops from ({_flows_sql()})")
def taint_candidates(spark, sf_dir):
    return taint.taint_candidates(code_files(spark, sf_dir)).select("file_id", "ord", "candidate_id", "source_kind", "sink_kind", "source_line", "sink_line", F.size("hops").alias("n_hops"))


_READS = [r["signature"] for r in taintbook.sources() if r["kind"] == "file_read"]
_ENDS = [r["signature"] for r in taintbook.sinks()]


def _triaged_sql() -> str:
    """The flows whose pair has fewer than two reports, judged by their number of assignments."""
    listed = lambda values: "[" + ", ".join(map(quote, values)) + "]"
    pair = f"{listed(_READS)}[user_id % {len(_READS)} + 1] as source_sig, {listed(_ENDS)}[event_id % {len(_ENDS)} + 1] as sink_sig"
    return (
        f"with told as (select source_sig, sink_sig from (select {pair} from events) group by all having count(*) >= 2), kept as (select * from ({_flows_sql()}) c where not exists (select 1 from told t where t.source_sig = c.source_sig and t.sink_sig = c.sink_sig)),"
        " judged as (select *, case when n_hops <= 1 then 0.9 when n_hops <= 3 then 0.7 else 0.5 end::double as confidence from kept)"
        " select file_id, candidate_id, ord, case when confidence >= 0.85 then 'critical' else 'high' end as severity, 'security' as category, 'Tainted data flow: ' || source_kind || ' to ' || sink_kind as title, confidence,"
        " sink_line as line_start, sink_line as line_end, 'dataflow' as source, source_kind || ' data of line ' || source_line || ' reaches ' || sink_kind as description, 'Check or escape the value before it is used there.' as suggestion from judged where confidence >= 0.6"
    )


@_query(_triaged_sql())
def taint_findings(spark, sf_dir):
    """Candidates whose pair isn't suppressed, triaged by the offline scorer; events stand for the reports of pairs of file reads."""
    pick = lambda values, k: F.get(F.array(*(F.lit(v) for v in values)), F.pmod(k, F.lit(len(values))).cast("int"))
    reports = _table(spark, sf_dir, "events").select(pick(_READS, F.col("user_id")).alias("source_sig"), pick(_ENDS, F.col("event_id")).alias("sink_sig"), "ts")
    found = taint.taint_candidates(code_files(spark, sf_dir))
    return taint.triage(taint.without_suppressed(found, feedback.pair_suppressions(reports).select("source_sig", "sink_sig"))).drop("language")


# --- Graph ---


#: In SQL: both kinds of quote, to be trimmed.
_QUOTES = "'''" + '"' + "'"


@_query(
    _LINES + " select distinct file_id, language, case when starts_with(stripped, 'from ') then split_part(stripped, ' ', 2) when language = 'python' then split_part(split_part(stripped, ' ', 2), '.', 1)"
    f" else trim(trim(trim(string_split(stripped, 'from')[-1]), {_QUOTES}), ';') end as module from lines where (language = 'python' and regexp_matches(stripped, '^(import|from) ')) or (language = 'javascript' and regexp_matches(stripped, '^import .*from'))"
)
def import_edges(spark, sf_dir):
    lines = code_files(spark, sf_dir).select("file_id", "language", F.explode(split_lines(F.col("code"))).alias("line"))
    text = F.trim("line")
    statement = ((F.col("language") == "python") & text.rlike("^(import|from) ")) | text.rlike("^import .*from")
    named = lines.where(statement).select("file_id", "language", graph.import_name(text, F.col("language")).alias("module"))
    return named.where("module is not null").distinct()


def _structures(spark, sf_dir) -> DataFrame:
    """path, language, structure of all files, read once and written: the graph's nodes and edges come from it many times."""
    files = structure.with_structure(code_files(spark, sf_dir)).withColumn("path", F.concat(F.lit("file"), F.col("file_id").cast("string")))
    return park(files.select("path", "language", "structure"), "structures")


def _stored_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last version of each node, and the edges between them, written: queries join them with each other."""
    nodes = park(graph.upsert_nodes(nodes.withColumn("ord", F.struct(F.coalesce("line_start", F.lit(0)).alias("l"), "language"))), "nodes")
    return nodes, park(graph.upsert_edges(edges, nodes), "edges")


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all files."""
    return _stored_graph(*graph.extract(_structures(spark, sf_dir)))


#: What a reader finds in the templates, written down by hand: template, name, first line, last line, parameters, docstring.
_FUNCTIONS = [
    (0, "load", 2, 6, 2, False), (0, "token_for", 7, 10, 1, False), (0, "run", 12, 21, 3, False),
    (1, "scan", 3, 18, 1, False),
    (2, "area", 4, 6, 2, True), (2, "__init__", 8, 9, 2, False),
    (3, "go", 9, 11, 0, False),
    (4, "f", 4, 4, 0, False),
    (6, "Save", 2, 13, 2, False),
    (7, "main", 2, 10, 0, False),
]
#: Classes: template, name, first line, last line.  Imported modules of Python (the first word after import, as it stands).
_CLASSES = [(2, "Box", 7, 9)]
_IMPORTS = [(0, "os,"), (1, "re,"), (1, "xml.dom"), (2, "defusedxml")]
#: Functions that their own file calls: yaml.load counts as a call of load.
_CALLED = [(0, "load"), (0, "token_for")]


def _functions_sql() -> str:
    """The templates' functions; prose after them has none."""
    rows = ", ".join(f"({k}, {quote(name)}, {first}, {last}, {params}, {last - first + 1}, {str(doc).lower()})" for k, name, first, last, params, doc in _FUNCTIONS)
    return f"select doc_id as file_id, name, line_start, line_end, params, length, has_docstring from documents join (values {rows}) as v(k, name, line_start, line_end, params, length, has_docstring) on doc_id % {len(TEMPLATES)} = k where length > 5"


@_query(_functions_sql())
def functions_long(spark, sf_dir):
    rows = structure.with_structure(code_files(spark, sf_dir)).select("file_id", F.explode_outer("structure.functions").alias("f"))
    return rows.select("file_id", "f.*").where("length > 5")


def _template_graph_sql() -> str:
    """CTEs `nodes` and `edges`, from what the templates hold, written down by hand: prose after them adds nothing to a graph."""
    made = [(k, "function", name, first, last) for k, name, first, last, _, _ in _FUNCTIONS] + [(k, "class", *c) for k, *c in _CLASSES]
    imports, calls = _IMPORTS, _CALLED
    rows = lambda values, names: "(select * from (values " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else quote(v) for v in r) + ")" for r in values) + f") as v({names}))"
    node = lambda kind, name, path: f"substring(sha256(concat_ws(':', {kind}, {name}, {path})), 1, 16)"
    languages = rows([(k, x) for k, (x, _) in enumerate(TEMPLATES)], "k, language")
    return f"""with f as (select 'file' || doc_id as path, language, t.k from documents join {languages} t on doc_id % {len(TEMPLATES)} = t.k),
fn as (select {node("kind", "name", "path")} as id, name, kind, path, first, last, language, f.k from f join {rows(made, "k, kind, name, first, last")} m on f.k = m.k),
im as (select {node("'module'", "name", "name")} as id, name, path, language from f join {rows(imports, "k, name")} i on f.k = i.k),
raw as (select {node("'module'", "path", "path")} as id, path as name, 'module' as kind, path as file_path, null as line_start, null as line_end, language from f
union all select id, name, kind, path, first, last, language from fn union all select id, name, 'module', name, null, null, language from im),
nodes as (select id, name, kind, file_path, line_start, line_end, language from (select *, row_number() over (partition by id order by coalesce(line_start, 0) desc, language desc) as rn from raw) where rn = 1),
edges as (select distinct {node("'module'", "path", "path")} as source_id, id as target_id, 'CONTAINS' as relationship from fn union select {node("'module'", "path", "path")}, id, 'IMPORTS' from im
union select {node("'module'", "path", "path")}, id, 'CALLS' from fn join {rows(calls, "k, name")} c on fn.k = c.k and fn.name = c.name where kind = 'function')"""


_GRAPH = _template_graph_sql()


@_query(_GRAPH + " select * from nodes")
def graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0]


@_query(_GRAPH + " select * from edges")
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


def _table_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The same by the table function, called once a file."""
    rows = park(graph_table.rows(_structures(spark, sf_dir)), "graph_rows")
    return _stored_graph(*graph_table.parts(rows))


@_query(_GRAPH + " select * from nodes")
def graph_table_nodes(spark, sf_dir):
    return _table_graph(spark, sf_dir)[0]


@_query(_GRAPH + " select * from edges")
def graph_table_edges(spark, sf_dir):
    return _table_graph(spark, sf_dir)[1]


_ASKED = ["token_for", "run", "area", "go", "Save"]


@_query(
    _GRAPH + ", inside as (select source_id, target_id from edges where relationship = 'CONTAINS'), asked as (select id, name from nodes where name in (" + ", ".join(map(quote, _ASKED)) + "))"
    " select distinct asked.name as queried, n.id, n.name, n.kind, n.file_path from asked join inside i on i.target_id = asked.id join inside j on i.source_id = j.source_id and j.target_id <> asked.id join nodes n on n.id = j.target_id"
)
def graph_siblings(spark, sf_dir):
    """What stands beside the functions that are asked for, in all files that have them."""
    return graph.beside(*_graph(spark, sf_dir), _ASKED)


def _context_sql() -> str:
    """The context of the functions of file0 by its parts, each from the hand-written nodes and edges."""
    first = lambda rows, shown, order, title, sep: f"(select {quote(title)} || string_agg({shown}, {sep} order by {order}) as t from (select distinct * from ({rows}) order by {order} limit 10))"
    names, line = "'load', 'run', 'token_for'", "chr(10)"
    calls = "from edges e join nodes a on a.id = e.source_id join nodes b on b.id = e.target_id where relationship = 'CALLS'"
    inside = "from edges e join nodes a on a.id = e.source_id join nodes b on b.id = e.target_id where a.kind = 'module' and a.file_path = 'file0'"
    parts = [
        first(f"select a.name, a.kind, a.file_path {calls} and b.name in ({names})", "'  - ' || name || ' (' || kind || ') in ' || file_path", "name, kind, file_path", "Called by:\n", line),
        first(f"select b.name, b.file_path {calls} and a.name in ({names})", "'  - ' || name", "name, file_path", "Calls:\n", line),
        first(f"select b.name {inside} and relationship = 'CONTAINS' and b.kind = 'function' and b.name not in ({names})", "name", "name", "Sibling functions in file: ", "', '"),
        first(f"select b.name {inside} and relationship = 'IMPORTS'", "name", "name", "Module imports: ", "', '"),
    ]
    return _GRAPH + " select concat_ws(chr(10), " + ", ".join(parts) + ") as context"


@_query(_context_sql())
def graph_context(spark, sf_dir):
    """What the graph tells about the functions of file0."""
    return graph.file_context(*_graph(spark, sf_dir), ["load", "run", "token_for"], "file0")


@_query(
    _GRAPH + ", asked as (select id, name from nodes where name in (" + ", ".join(map(quote, _ASKED)) + ")) select distinct asked.name as queried, n.id, n.name, n.kind, n.file_path from asked join edges e on e.target_id = asked.id and relationship = 'CALLS' join nodes n on n.id = e.source_id"
)
def graph_callers(spark, sf_dir):
    return graph.callers(*_graph(spark, sf_dir), _ASKED)


@_query("select user_id as id, event_type as name, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def node_upsert_last(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), "value", F.struct("ts", "event_id").alias("ord"))
    return graph.upsert_nodes(e)


@_query("select distinct c.c_custkey as target_id, e.user_id as source_id from events e join customer c on e.event_id = c.c_custkey where e.user_id in (select c_custkey from customer)")
def edge_endpoints_exist(spark, sf_dir):
    nodes = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    edges = _table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("target_id"))
    return graph.upsert_edges(edges, nodes).select("target_id", "source_id")


# --- Feedback and caches ---


@_query("select doc_id, substring(sha256(concat_ws(':', lang, substring(text, 1, 50), source)), 1, 16) as fingerprint from documents")
def finding_fingerprint(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", feedback.fingerprint(F.col("lang"), F.col("text"), F.col("source")).alias("fingerprint"))


_RECENT = "select user_id, event_type, ts, event_id, row_number() over (partition by {keys} order by ts desc, event_id desc) as rn from events"


@_query(f"select user_id, count(*) filter (event_type = 'error') as n_hits from ({_RECENT.format(keys='user_id')}) where rn <= 100 group by user_id having count(*) filter (event_type = 'error') >= 3")
def fp_suppressions(spark, sf_dir):
    return feedback.suppressions(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", feedback.FINDING_LAST, feedback.FINDING_LEAST)


@_query(f"select user_id, event_type, count(*) as n_hits from ({_RECENT.format(keys='user_id, event_type')}) where rn <= 50 group by all having count(*) >= 2")
def pair_suppressions(spark, sf_dir):
    return feedback.suppressions(_table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], F.lit(True), feedback.PAIR_LAST, feedback.PAIR_LEAST)


_BY_DAY = "select *, 'u' || user_id as category, event_type || dayofyear(ts) % 5 as title, 'go' as language from events"
_PRINTS = f"select event_id, ts, event_type, value, substring(sha256(concat_ws(':', category, substring(title, 1, 50), language)), 1, 16) as fingerprint from ({_BY_DAY})"
_MARKED = f"select fingerprint from (select *, row_number() over (partition by fingerprint order by ts desc) as rn from ({_PRINTS})) where rn <= 100 group by fingerprint having count(*) filter (value > 30) >= 3"


def _reports(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "value", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("category"), F.concat("event_type", (F.dayofyear("ts") % 5).cast("string")).alias("title"), F.lit("go").alias("language"))


@_query(f"select event_id from ({_PRINTS}) where fingerprint not in ({_MARKED})")
def apply_suppressions(spark, sf_dir):
    """Findings, one an event, without those whose kind was marked three times; a mark is an event of a high value."""
    found = _reports(spark, sf_dir)
    marked = feedback.finding_suppressions(found.withColumn("action", F.when(F.col("value") > 30, "false_positive").otherwise("helpful")))
    return feedback.apply_suppressions(found, marked).select("event_id")


@_query("select fingerprint from (select case when user_id % 3 = 0 then 'taint:' else '' end || event_type || user_id as fingerprint from events group by all) where not starts_with(fingerprint, 'taint:')")
def listed_suppressions(spark, sf_dir):
    key = F.concat(F.when(F.col("user_id") % 3 == 0, feedback.PAIRS).otherwise(""), "event_type", F.col("user_id").cast("string"))
    return feedback.listed(_table(spark, sf_dir, "events").select(key.alias("fingerprint")).distinct())


_NOW = "2100-01-01 00:00:00"


@_query(
    "with t as (select user_id % 500 as key, ts as saved_at, case when event_type = 'error' then null else event_type end as payload, ts + to_days(cast(365 * 100 * (value % 1) as integer)) as expires_at from events),"
    f" r as (select *, row_number() over (partition by key order by saved_at desc, (payload is null) desc, expires_at desc, payload desc) as rn from t) select cast(key as varchar) as key, payload from r where rn = 1 and payload is not null and expires_at > timestamp '{_NOW}'"
)
def stored_current(spark, sf_dir):
    """What a store of results still holds: the last write of a key counts, a write without payload deletes, and time runs out."""
    days = (365 * 100 * (F.col("value") % 1)).cast("decimal(20,6)")
    e = _table(spark, sf_dir, "events")
    table = e.select((F.col("user_id") % 500).cast("string").alias("key"), F.col("ts").alias("saved_at"), (F.col("ts") + F.make_dt_interval(F.round(days).cast("int"))).alias("expires_at"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("payload"))
    return store.current(table, F.lit(_NOW).cast("timestamp")).select("key", "payload")


@_query("select event_id as review_id, ts as saved_at from events order by ts desc, event_id limit 20 offset 40")
def recent_reviews_page(spark, sf_dir):
    return feedback.page(_table(spark, sf_dir, "events").select(F.col("event_id").alias("review_id"), F.col("ts").alias("saved_at")), 40, 20)


@_query("with s as (select doc_id, sha256(concat_ws(':', text, lang)) as key from documents) select doc_id, key from s where key in (select key from s group by key having count(*) > 1)")
def content_hash_semi(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", feedback.content_key(F.col("text"), F.col("lang")).alias("key"))
    return d.join(d.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key", "left_semi").select("doc_id", "key")


@_query("select sha256(text) as key, count(*) as n_files, min(doc_id) as first_file from documents group by 1 having count(*) > 1")
def exact_duplicate_files(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("n_files"), F.min("doc_id").alias("first_file")).where("n_files > 1")


# --- Pull requests ---

_ENDINGS = [".py", ".min.js", ".lock", "/vendor/a.go", ".TS", ".txt", ".jsx", "/go.mod"]
_STATUSES = ["added", "modified", "removed"]


def _pr_files(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(
        F.concat(F.replace("p_brand", F.lit("#"), F.lit("/")), F.lit("f"), k.cast("string"), F.get(F.array(*(F.lit(e) for e in _ENDINGS)), (k % len(_ENDINGS)).cast("int"))).alias("filename"),
        F.get(F.array(*(F.lit(e) for e in _STATUSES)), (k % len(_STATUSES)).cast("int")).alias("status"),
        (F.col("p_size") * 10).alias("changes"),
        F.concat(F.lit("@@ -1,2 +"), k.cast("string"), F.lit(","), F.col("p_size").cast("string"), F.lit(" @@ x\n+a\n@@ -9 +"), (k + 100).cast("string"), F.lit(" @@\n+b\n@@ -20,1 +7,0 @@\n-c")).alias("patch"),
    )


_PR_SQL = (
    "select replace(p_brand, '#', '/') || 'f' || p_partkey || ([" + ", ".join(map(quote, _ENDINGS)) + f"])[p_partkey % {len(_ENDINGS)} + 1] as filename, ([" + ", ".join(map(quote, _STATUSES)) + f"])[p_partkey % {len(_STATUSES)} + 1] as status, p_size * 10 as changes, p_partkey, p_size from part"
)
_REVIEWABLE = (
    f"with f as ({_PR_SQL}) select filename, status, changes from f where status in ('added', 'modified') and regexp_extract(lower(filename), '(\\.[^./]+)$', 1) in ("
    + ", ".join(map(quote, pulls.EXTENSIONS)) + ") and not ends_with(filename, '.min.js') and not contains(filename, '/vendor/') and not ends_with(filename, '/go.mod')"
)


@_query(_REVIEWABLE)
def pr_file_filter(spark, sf_dir):
    return _pr_files(spark, sf_dir).where(pulls.reviewable(F.col("filename"), F.col("status"))).select("filename", "status", "changes")


@_query(f"select * from ({_REVIEWABLE}) order by changes desc, filename limit 20")
def pr_top20(spark, sf_dir):
    """At most twenty files of a pull request are reviewed; the limit is the feature."""
    return pulls.top_files(pr_file_filter(spark, sf_dir))


@_query("select p_partkey as file_id, p_partkey as first, p_partkey + p_size - 1 as last from part where p_size > 0 union all select p_partkey, p_partkey + 100, p_partkey + 100 from part")
def diff_hunk_ranges(spark, sf_dir):
    k = F.regexp_extract("filename", r"f(\d+)\D", 1).cast("bigint")
    return _pr_files(spark, sf_dir).select(k.alias("file_id"), F.explode_outer(pulls.hunk_ranges(F.col("patch"))).alias("r")).where("r is not null").select("file_id", F.col("r.first").cast("bigint").alias("first"), F.col("r.last").cast("bigint").alias("last"))


# --- Benchmarks ---

_CONFUSED = "select l.doc_id % 3 as tool, case when l.quality = 0 then 'vulnerable' else 'clean' end as label, l.toxic = 1 as flagged from labels l"
_METRICS = (
    f"with c as ({_CONFUSED}), n as (select tool, count(*) filter (label = 'vulnerable' and flagged) as tp, count(*) filter (label = 'vulnerable' and not flagged) as fn, count(*) filter (label = 'clean' and flagged) as fp,"
    " count(*) filter (label = 'clean' and not flagged) as tn from c group by tool), p as (select *, case when tp + fp = 0 then 0 else tp / (tp + fp) end::double as precision, case when tp + fn = 0 then 0 else tp / (tp + fn) end::double as recall, case when fp + tn = 0 then 0 else fp / (fp + tn) end::double as fp_rate from n)"
    " select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end::double as f1 from p"
)


@_query(_METRICS)
def confusion_matrix(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    rated = labels.select(F.col("doc_id").alias("sample_id"), (F.col("doc_id") % 3).alias("tool"), F.when(F.col("quality") == 0, "vulnerable").otherwise("clean").alias("label"))
    found = labels.where("toxic = 1").select(F.col("doc_id").alias("sample_id"), F.lit(1.0).alias("confidence"))
    return bench.metrics(bench.classify(rated, found), ["tool"]).drop("n_samples", "n_vuln", "n_clean")


def _golden_sql(found: str, wanted: str, ids: str) -> str:
    return (
        f"with f as ({found}), e as ({wanted}), ids as ({ids}), m as (select e.sample_id, e.ord, count(f.sample_id) >= any_value(e.min_count) as met from e left join f on e.sample_id = f.sample_id"
        " and (coalesce(e.category, '') = '' or lower(e.category) = lower(f.category)) and (coalesce(e.severity, '') = '' or lower(e.severity) = lower(f.severity)) and (coalesce(e.title_pattern, '') = '' or regexp_matches(f.title, e.title_pattern, 'i')) group by all),"
        " w as (select sample_id, count(*) as n, count(*) filter (met) as ok from m group by 1), g as (select sample_id, count(*) as m from f group by 1),"
        " r as (select ids.sample_id, coalesce(n, 0) as expected_count, coalesce(m, 0) as actual_count, coalesce(ok, 0) as satisfied from ids left join w on ids.sample_id = w.sample_id left join g on ids.sample_id = g.sample_id),"
        " p as (select *, case when actual_count > 0 then satisfied / actual_count when expected_count = 0 then 1.0 else 0.0 end::double as precision, case when expected_count > 0 then satisfied / expected_count else 1.0 end::double as recall from r)"
        " select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end::double as f1, recall >= 0.7 as passed from p"
    )


#: What the patterns look for stands in the rules' own titles, whatever fills them.
_TITLES = "(values " + ", ".join(f"({i}, {quote(r.title)})" for i, r in enumerate(RULES)) + ") as t(rule_ord, title)"
_EXPECTED = [("security", "critical", "^dangerous use", 1), ("security", "critical", "hardcoded|credential", 1), ("quality", "high", "bare except", 1)]


@_query(
    _golden_sql(
        _all_sql() + _DEDUP + f" select file_id as sample_id, category, severity, title from best join {_TITLES} on best.rule_ord = t.rule_ord",
        "select doc_id as sample_id, x.* from documents, (values " + ", ".join(f"({i}, {quote(c)}, {quote(v)}, {quote(p)}, {n})" for i, (c, v, p, n) in enumerate(_EXPECTED)) + ") as x(ord, category, severity, title_pattern, min_count)",
        "select doc_id as sample_id from documents",
    )
)
def eval_match(spark, sf_dir):
    """Golden expectations against what all files give, by title pattern."""
    found = _stored_findings(spark, sf_dir).select(F.col("file_id").alias("sample_id"), "category", "severity", "title")
    fields = ("category", "severity", "title_pattern", "min_count")
    wanted = F.array(*(F.struct(F.lit(i).alias("ord"), *(F.lit(v).alias(k) for k, v in zip(fields, e, strict=True))) for i, e in enumerate(_EXPECTED)))
    ids = code_keys(spark, sf_dir).select(F.col("file_id").alias("sample_id"), F.explode(wanted).alias("e"))
    return bench.golden(ids.select("sample_id", "e.*"), found)


_FOUND = "select user_id as sample_id, case when event_id % 2 = 0 then 'BUILDING' else 'security' end as category, case when value > 60 then 'High' else 'low' end as severity, event_type as title from events"
_WANTED = (
    "select c_custkey as sample_id, 0 as ord, case when c_custkey % 4 = 0 then '' else lower(c_mktsegment) end as category, case when c_custkey % 5 = 0 then null else 'high' end as severity, '^(E|c)' as title_pattern, c_custkey % 3 + 1 as min_count from customer where c_custkey % 7 <> 0"
    " union all select c_custkey, 1, 'Security', 'LOW', case when c_custkey % 2 = 0 then 'rr' end, 1 from customer where c_custkey % 3 = 0"
)


@_query(_golden_sql(_FOUND, _WANTED, "select c_custkey as sample_id from customer"))
def golden_scores(spark, sf_dir):
    """Golden expectations with empty fields, other cases, and samples that expect or give nothing."""
    e, c = _table(spark, sf_dir, "events"), _table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    found = e.select(F.col("user_id").alias("sample_id"), F.when(F.col("event_id") % 2 == 0, "BUILDING").otherwise("security").alias("category"), F.when(F.col("value") > 60, "High").otherwise("low").alias("severity"), F.col("event_type").alias("title"))
    one = c.where(k % 7 != 0).select(k.alias("sample_id"), F.lit(0).alias("ord"), F.when(k % 4 == 0, "").otherwise(F.lower("c_mktsegment")).alias("category"), F.when(k % 5 != 0, "high").alias("severity"), F.lit("^(E|c)").alias("title_pattern"), (k % 3 + 1).alias("min_count"))
    two = c.where(k % 3 == 0).select(k.alias("sample_id"), F.lit(1).alias("ord"), F.lit("Security").alias("category"), F.lit("LOW").alias("severity"), F.when(k % 2 == 0, "rr").alias("title_pattern"), F.lit(1).cast("bigint").alias("min_count"))
    return bench.golden(one.unionAll(two), found, c.select(k.alias("sample_id")))


_SAMPLES = "select file_id, sample_id, dataset, language, code, label from (values " + ", ".join("(" + ", ".join([str(r[0]), *map(quote, r[1:])]) + ")" for r in samples.rows()) + ") as s(file_id, sample_id, dataset, language, code, label)"


@_query(
    "with " + rules.lines_sql(f"select file_id, language, code from ({_SAMPLES})", SHARED) + ", hits as (" + " union all ".join(f"select file_id from ({rules.rule_sql(r)})" for r in SHARED) + f"), c as (select dataset, label, file_id in (select file_id from hits) as flagged from ({_SAMPLES}))"
    " select 'rules' as tool, dataset, count(*) filter (label = 'vulnerable' and flagged) as tp, count(*) filter (label = 'vulnerable' and not flagged) as fn, count(*) filter (label = 'clean' and flagged) as fp, count(*) filter (label = 'clean' and not flagged) as tn from c group by dataset"
)
def parity(spark, sf_dir):
    """The line rules over the labelled samples."""
    files = samples.samples(spark)
    found = rules.raw_findings(files, only=tuple(r.key for r in SHARED)).join(files.select("file_id", "sample_id"), "file_id")
    return bench.run_harness(files, {"rules": lambda _: found}).select("tool", "dataset", "tp", "fn", "fp", "tn")


@_query(f"select tool, fp_rate, recall, row_number() over (order by fp_rate, recall desc, tool) as place from ({_METRICS})")
def leaderboard(spark, sf_dir):
    from pyspark.sql import Window

    # One row a tool: a handful of rows may be ranked by one task.
    return confusion_matrix(spark, sf_dir).select("tool", "fp_rate", "recall", F.row_number().over(Window.orderBy("fp_rate", F.desc("recall"), "tool")).alias("place"))


# --- Scans of the driver's own tables ---


@_query("select page_id, count(*) as n from (select page_id, unnest(string_split(html, chr(10))) as line from pages) where regexp_matches(line, '\\bvar\\s+\\w+') group by page_id")
def pages_var_usage(spark, sf_dir):
    lines = _table(spark, sf_dir, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("line"))
    return lines.where(F.col("line").rlike(r"(?U)\bvar\s+\w+")).groupBy("page_id").agg(F.count("*").alias("n"))


@_query("select doc_id, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where regexp_matches(line, '(?i)token\\s*[=:]\\s*[\"''][^\"'']{8,}[\"'']') group by doc_id")
def documents_secrets(spark, sf_dir):
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.col("line").rlike("(?iU)token\\s*[=:]\\s*[\"'][^\"']{8,}[\"']")).groupBy("doc_id").agg(F.count("*").alias("n"))


# --- Events ---


@_query("select time_bucket(interval 1 hour, ts, timestamp '1970-01-01') as window_start, event_type, count(*) as n, sum(value) as total from events group by all")
def event_windows(spark, sf_dir):
    return jobs.event_windows(_table(spark, sf_dir, "events"))


@_query(
    "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events),"
    " s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as session_start, count(*) as n from s group by user_id, k"
)
def event_sessions(spark, sf_dir):
    return jobs.sessions(_table(spark, sf_dir, "events"))


_POSITION = "case severity " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(review.SEVERITIES)) + " end, coalesce(nullif(line_start, 0), 999999), rule_id"
_EVENTS = (
    _all_sql() + _DEDUP + _SCORES + ", e as (select file_id as review_id, 0 as step, 'agent_start' as type, null as rule_id, null as score, 0 as place from files"
    f" union all select file_id, 1, 'finding', rule_id, null, row_number() over (partition by file_id order by {_POSITION}) from best union all select file_id, 2, 'complete', null, score, 0 from scores),"
    " numbered as (select review_id, row_number() over (partition by review_id order by step, place) - 1 as seq, type, rule_id, score from e)"
)


def _events(spark, sf_dir) -> DataFrame:
    return jobs.review_events(code_keys(spark, sf_dir), _stored_findings(spark, sf_dir))


@_query(_EVENTS + " select * from numbered")
def review_events(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return rows.select("review_id", "seq", "type", F.get_json_object("payload", "$.rule_id").alias("rule_id"), F.get_json_object("payload", "$.score").cast("int").alias("score"))


@_query(_all_sql() + _DEDUP + _SCORES + " select file_id as review_id, 'complete' as status, n_findings, score from scores")
def review_states(spark, sf_dir):
    return jobs.fold_events(_events(spark, sf_dir))


# --- Reports of other tools, requests and pull requests, written as JSON from the driver's tables ---

_PART = "select *, p_partkey as k from part"


@_query(
    "select 'q' as tool, 'r' || k % 4 as rule_id, case when k % 6 = 0 then 'r' || k % 4 else p_name end as title,"
    " case when k % 5 = 0 then 'high' when k % 5 = 1 then 'medium' else case k % 4 when 0 then 'critical' when 1 then 'high' when 2 then 'high' else case k % 3 when 0 then 'critical' when 1 then 'medium' else 'high' end end end as severity,"
    " 'security' as category, 1.0::double as confidence, p_brand as file_path, cast(k % 100 as integer) as line_start, cast(case when k % 2 = 0 then k % 100 + 1 else k % 100 end as integer) as line_end from "
    f"({_PART})"
)
def sarif_findings(spark, sf_dir):
    return readers.read_sarif(_sarif_reports(spark, sf_dir)).drop("raw")


def _sarif_reports(spark, sf_dir, *more) -> DataFrame:
    """Reports made from the parts, a result each; more: further fields of the results, which the reader doesn't know."""
    k = F.col("p_partkey")
    sev = lambda c: F.struct(c.alias("problem.severity"))
    pick = lambda n, *values: F.get(F.array(*(F.lit(v) for v in values)), (k % n).cast("int"))
    rule = lambda i, s: F.struct(F.lit(i).alias("id"), sev(F.lit(s).cast("string")).alias("properties"))
    region = F.struct((k % 100).alias("startLine"), F.when(k % 2 == 0, k % 100 + 1).alias("endLine"))
    result = F.struct(
        F.concat(F.lit("r"), (k % 4).cast("string")).alias("ruleId"), pick(3, "error", "note").alias("level"), F.struct(F.when(k % 6 != 0, F.col("p_name")).alias("text")).alias("message"),
        sev(pick(5, "warning", "NOTE", "odd")).alias("properties"), F.array(F.struct(F.struct(F.struct(F.col("p_brand").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))).alias("locations"), *more,
    )
    driver = F.struct(F.lit("q").alias("name"), F.array(rule("r0", "Error"), rule("r1", None), rule("r2", "odd")).alias("rules"))
    run = lambda results: F.struct(F.struct(driver.alias("driver")).alias("tool"), results.alias("results"))
    # A second run, which isn't read.
    return _table(spark, sf_dir, "part").select(F.to_json(F.struct(F.array(run(F.array(result)), run(F.array(result, result))).alias("runs"))).alias("json"))


def _unread(spark, sf_dir) -> DataFrame:
    """Findings of reports with fields that the reader doesn't know."""
    k = F.col("p_partkey")
    prints = F.when(k % 3 != 0, F.struct(F.concat(F.lit("p"), k.cast("string")).alias("primary/v1")))
    return readers.read_sarif(_sarif_reports(spark, sf_dir, prints.alias("partialFingerprints"), F.col("p_retailprice").cast("double").alias("rank")))


@_query(f"select p_brand as file_path, 'r' || k % 4 as rule_id, case when k % 3 <> 0 then 'p' || k end as fingerprint, p_retailprice::double as rank from ({_PART})")
def report_unread_fields(spark, sf_dir):
    """Fields of reports that no reader names, asked for later, from the results as they came."""
    raw = lambda path, kind: F.try_variant_get("raw", path, kind)
    return _unread(spark, sf_dir).select("file_path", "rule_id", raw("$.partialFingerprints['primary/v1']", "string").alias("fingerprint"), raw("$.rank", "double").alias("rank"))


@_query(
    f"select 'q' as tool, field, count(*) as n from ({_PART}), (values ('ruleId', 3), ('level', 2), ('message', 3), ('properties', 3), ('locations', 3), ('rank', 3), ('partialFingerprints', -1)) as v(field, below)"
    " where k % 3 < below or (below < 0 and k % 3 <> 0) group by all"
)
def report_fields(spark, sf_dir):
    """Which fields the results of reports hold, and how often."""
    return readers.raw_fields(_unread(spark, sf_dir))


@_query(
    "select 'semgrep' as tool, 'c' || k as rule_id, case when k % 4 = 0 then 'c' || k else p_name end as title, case k % 6 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' else 'medium' end as severity,"
    f" 'security' as category, 1.0::double as confidence, p_brand as file_path, cast(p_size as integer) as line_start, cast(p_size + 2 as integer) as line_end from ({_PART})"
)
def semgrep_findings(spark, sf_dir):
    k, line = F.col("p_partkey"), lambda n: F.struct((F.col("p_size") + n).alias("line"))
    severity = F.get(F.array(*(F.lit(v) for v in ("ERROR", "warning", "INFO", "Note", "odd"))), (k % 6).cast("int"))
    result = F.struct(F.concat(F.lit("c"), k.cast("string")).alias("check_id"), F.col("p_brand").alias("path"), line(0).alias("start"), line(2).alias("end"), F.struct(F.when(k % 4 != 0, F.col("p_name")).alias("message"), severity.alias("severity")).alias("extra"))
    return readers.read_semgrep(_table(spark, sf_dir, "part").select(F.to_json(F.struct(F.array(result).alias("results"))).alias("json"))).drop("raw")


@_query(
    "select 'Order ' || o_orderkey as title, case when o_orderkey % 3 = 0 then '' else o_orderstatus end as body, case when o_orderkey % 4 = 0 then '' else 'u' || o_custkey end as author, 'main' as base_branch, o_orderpriority as head_branch, cast(o_orderkey % 50 as integer) as additions, 0 as deletions, 1 as changed_files from orders"
)
def pull_metadata(spark, sf_dir):
    k = F.col("o_orderkey")
    user = F.struct(F.when(k % 4 != 0, F.concat(F.lit("u"), F.col("o_custkey").cast("string"))).alias("login"))
    ref = lambda c: F.struct(c.alias("ref"))
    fields = [F.concat(F.lit("Order "), k.cast("string")).alias("title"), F.when(k % 3 != 0, F.col("o_orderstatus")).alias("body"), user.alias("user"), ref(F.lit("main")).alias("base"), ref(F.col("o_orderpriority")).alias("head"), (k % 50).alias("additions"), F.lit(1).alias("changed_files")]
    return readers.read_pull(_table(spark, sf_dir, "orders").select(F.to_json(F.struct(*fields)).alias("json")))


@_query("select k, case when k % 3 = 0 then p_brand else split_part(p_brand || '/' || p_size || '/x', '/', 1) end as owner, case when k % 3 = 0 then '' else p_size || '/x' end as name from " + f"({_PART})")
def owners_and_names(spark, sf_dir):
    full = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit("/x")))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), readers.owner_and_name(full).alias("r")).select("k", "r.*")


_NAMES, _GIVEN = ["a.py", "x/b.JS", "c.tsx", "d.rs", "e", ".py", "f.go"], ["rust", "perl", "", "java"]


@_query(
    f"select k, case k % 7 when 0 then 'python' when 1 then 'javascript' when 2 then 'typescript' when 6 then 'go' else case k % 4 when 0 then 'rust' when 3 then 'java' else 'python' end end as language from ({_PART})"
)
def hinted_languages(spark, sf_dir):
    k, pick = F.col("p_partkey"), lambda values, n: F.get(F.array(*(F.lit(v) for v in values)), n.cast("int"))
    return _table(spark, sf_dir, "part").select(k.alias("k"), readers.hinted_language(pick(_NAMES, k % 7), pick(_GIVEN, k % 4)).alias("language"))


_CATEGORIES = ["Security", "vulnerability-x", "code doc", "Comments", "style", "AUTH doc", "readme", "performance"]


@_query("select case when k % 8 in (0, 1, 5) then 'security' when k % 8 in (2, 3, 6) then 'docs' else 'quality' end as agent, count(*) as n from " + f"({_PART}) group by 1")
def agent_counts(spark, sf_dir):
    return review.agent_counts(_table(spark, sf_dir, "part").select(F.get(F.array(*(F.lit(c) for c in _CATEGORIES)), (F.col("p_partkey") % 8).cast("int")).alias("category")))


@_query(_all_sql() + _DEDUP + " select file_id, rule_id, line_start from best where severity = 'high'")
def findings_of_severity(spark, sf_dir):
    return review.of_severity(rules.dedup(_shared_findings(spark, sf_dir)), "High").select("file_id", "rule_id", "line_start")


_SIGN = "case when {0} >= 80 then '🟢 ' when {0} >= 60 then '🟡 ' else '🔴 ' end || {0} || '/100'"
_SOME = "case when {0} > 0 then {0}::varchar else '—' end"


@_query(
    f"with f as (select k // 30 as pull_id, k % 30 as ord, 'f' || k as filename, case when k % 5 <> 0 then p_size * 2 end as score, k % 3 as c, k % 4 as h, 1 as m, 0 as l, p_name, k from ({_PART})),"
    " kept as (select * from (select *, row_number() over (partition by pull_id order by ord) as rn from f) where rn <= 20),"
    f" t as (select pull_id, string_agg('| `' || filename || '` | ' || case when score is null then '— | — | — | — | — |' else {_SIGN.format('score')} || ' | ' || {_SOME.format('c')} || ' | ' || {_SOME.format('h')} || ' | ' || {_SOME.format('m')} || ' | ' || {_SOME.format('l')} || ' |' end, chr(10) order by ord) as lines,"
    " cast(floor(sum(score) / count(score)) as integer) as mean, count(score) as done, sum(case when score is not null then c + h + m + l end) as found, string_agg(case when k % 2 = 0 then '**`' || filename || '`** ' || case when k % 4 = 0 then '🔴' else '⚪' end || ' **' || p_name || '**' || chr(10) || chr(10) || 'd' || k || chr(10) || case when k % 6 = 0 then chr(10) || '> 💡 fix' || chr(10) else '' end end, chr(10) order by ord) filter (where k % 2 = 0 and g <= 10) as general"
    " from (select *, sum(case when k % 2 = 0 then 1 else 0 end) over (partition by pull_id order by ord) as g from kept) group by pull_id), s as (select pull_id, greatest(0, count(*) - 20) as skipped from f group by 1)"
    " select t.pull_id, concat_ws(chr(10), '## Code Review' || chr(10), '### 📊 File Review Summary' || chr(10) || chr(10) || '| File | Score | Critical | High | Medium | Low |' || chr(10) || '|------|-------|----------|------|--------|-----|', lines,"
    f" case when done > 0 then chr(10) || '**Overall Score: ' || {_SIGN.format('mean')} || '** &nbsp; | &nbsp; **' || found || ' finding(s)** across ' || done || ' file(s)' || chr(10) end,"
    " case when general is not null then '<details>' || chr(10) || '<summary>📝 General Findings</summary>' || chr(10) || chr(10) || general || chr(10) || '</details>' || chr(10) end, case when skipped > 0 then '*' || skipped || ' more file(s) were not reviewed.*' end) as body from t join s on t.pull_id = s.pull_id"
)
def pull_reports(spark, sf_dir):
    """Reports of pull requests of thirty files each, of which twenty are reviewed."""
    k = F.col("p_partkey")
    p = _table(spark, sf_dir, "part").withColumns({"pull_id": F.floor(k / 30), "filename": F.concat(F.lit("f"), k.cast("string"))})
    files, skipped = pulls.chosen_files(p.withColumn("changes", 30 - k % 30))
    counts = {"n_critical": k % 3, "n_high": k % 4, "n_medium": F.lit(1), "n_low": F.lit(0)}
    scored = files.select("pull_id", "ord", "filename", F.when(k % 5 != 0, F.col("p_size") * 2).alias("score"), (k % 3 + k % 4 + 1).alias("n_findings"), *(v.alias(c) for c, v in counts.items()))
    general = files.where(k % 2 == 0).select("pull_id", "ord", "filename", F.when(k % 4 == 0, "critical").otherwise("info").alias("severity"), F.col("p_name").alias("title"), F.concat(F.lit("d"), k.cast("string")).alias("description"), F.when(k % 6 == 0, "fix").alias("suggestion"), F.lit(None).cast("int").alias("line_start"))
    return pulls.report(scored, general, skipped=skipped)


_TASK = "Answer with one JSON object, findings: a list of severity, category, title, description, line_start, line_end, suggestion and confidence."


@_query(
    "with f as (select file_id, language, coalesce(code, '') as code, case when file_id % 3 <> 0 then 'Change ' || file_id end as title, repeat('why ', cast(file_id % 170 as integer)) as body,"
    f" case when file_id % 4 <> 0 then repeat('+ a' || chr(10), cast(file_id % 1100 as integer)) end as diff, file_id % 5 = 0 as known, file_id % 7 as k from ({code_files_sql()})),"
    " p as (select file_id, concat_ws(chr(10) || chr(10), 'Part of the pull request: ' || title || case when trim(body) <> '' then chr(10) || 'Its author writes: ' || substring(body, 1, 500) else '' end,"
    " case when diff <> '' then 'The change:' || chr(10) || '```diff' || chr(10) || case when length(diff) < 4000 then diff else substring(diff, 1, 4000) || chr(10) || '(the rest isn''t shown)' end || chr(10) || '```' end,"
    " case when diff <> '' then 'Changed lines: 1, 3-' || (4 + k) end, 'The whole file:' || chr(10) || '```' || language || chr(10) || code || chr(10) || '```',"
    " case when known then 'What the code base knows of it:' || chr(10) || 'Calls: f' || file_id end,"
    f" 'You review ' || language || ' code for security. ' || case when diff <> '' then 'Judge the changed lines first. ' else '' end || {quote(_TASK)}) as prompt from f)"
    " select file_id, length(prompt) as n_chars, sha256(prompt) as prompt_sha256 from p"
)
def agent_prompts(spark, sf_dir):
    """Prompts of the security reviewer over files of pull requests: with and without title, diff, changed lines and surroundings."""
    k = F.col("file_id")
    pair = lambda a, b: F.struct(F.lit(a).cast("int").alias("first"), b.cast("int").alias("last"))
    files = code_files(spark, sf_dir).withColumns({
        "title": F.when(k % 3 != 0, F.concat(F.lit("Change "), k.cast("string"))), "body": F.repeat(F.lit("why "), (k % 170).cast("int")),
        "diff": F.when(k % 4 != 0, F.repeat(F.lit("+ a\n"), (k % 1100).cast("int"))), "ranges": F.array(pair(1, F.lit(1)), pair(3, 4 + k % 7)),
        "context": F.when(k % 5 == 0, F.concat(F.lit("Calls: f"), k.cast("string"))),
    })
    rows = agents.review_prompt("security", files)
    return rows.select("file_id", F.length("prompt").cast("bigint").alias("n_chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


_SECRET = "of the tests"


def _signature(payload):
    """A payload's HMAC-SHA256 under _SECRET in built-in functions, from its definition."""
    pad = lambda byte: F.lit(bytes(b ^ byte for b in _SECRET.encode().ljust(64, b"\0")))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), payload.cast("binary")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(pad(0x5C), inner), 256))


def _deliveries(spark, sf_dir) -> DataFrame:
    """A delivery for each event: of eight one has a wrong signature, one tells of a push, two of pull requests, four of installations."""
    e, k, user = _table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id").cast("string")
    action = F.get(F.array(*(F.lit(a) for a in ("created", "deleted", "created", "unsuspend"))), (k % 4).cast("int"))
    account = F.struct(F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("u"), user)).alias("login"), F.lit("User").alias("type"))
    installed = F.struct(action.alias("action"), F.struct(F.col("user_id").alias("id"), account.alias("account")).alias("installation"), F.array(F.struct(F.concat(F.lit("o/"), user).alias("full_name"))).alias("repositories"))
    head = F.struct(F.lit("opened").alias("action"), F.struct((k % 5).alias("number"), F.struct(F.concat(F.lit("c"), F.floor(k / 64).cast("string")).alias("sha")).alias("head")).alias("pull_request"), F.struct(F.when(k % 3 == 0, user).otherwise(F.concat(F.lit("o/"), user)).alias("full_name")).alias("repository"))
    kind = F.when(k % 8 < 5, "installation").when(k % 8 < 7, "pull_request").otherwise("push")
    rows = e.select("ts", kind.alias("event"), F.when(k % 8 < 5, F.to_json(installed)).otherwise(F.to_json(head)).alias("json"), k)
    sealed = rows.withColumn("signature", F.when(k % 8 != 4, _signature(F.col("json"))).otherwise("sha256=0"))
    return jobs.app_deliveries(sealed.drop("event_id"), _SECRET)


@_query("select case when event_id % 8 = 4 then 'rejected' when event_id % 8 = 7 then 'ignored' else 'accepted' end as status, count(*) as n from events group by 1")
def app_delivery_counts(spark, sf_dir):
    return _deliveries(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@_query(
    "with e as (select user_id, ts, case when event_id % 4 = 1 then 'deleted' else 'created' end as action from events where event_id % 8 in (0, 1, 2)), l as (select *, row_number() over (partition by user_id order by ts desc, action desc) as rn from e)"
    " select user_id as installation_id, case when user_id % 3 <> 0 then 'u' || user_id else 'unknown' end as account_login, 'User' as account_type, 'o/' || user_id as repos from l where rn = 1 and action = 'created'"
)
def app_installations(spark, sf_dir):
    """What is installed after all accepted deliveries."""
    found = feedback.installations(jobs.installation_events(_deliveries(spark, sf_dir).where("status = 'accepted'")))
    return found.select("installation_id", "account_login", "account_type", F.array_join("repos", ",").alias("repos"))


@_query("select distinct 'o/' || user_id as repo, cast(event_id % 5 as integer) as number, 'c' || event_id // 64 as sha from events where event_id % 8 in (5, 6) and event_id % 3 <> 0 and event_id % 5 <> 0")
def app_pulls(spark, sf_dir):
    """The head commits to review, once each."""
    return jobs.app_pull_events(_deliveries(spark, sf_dir).where("status = 'accepted'")).select("repo", "number", "sha")


# --- Joins by order ---


@_query(
    "with l as (select event_id, user_id, ts from events where event_type = 'purchase'),"
    " r as (select user_id, ts, value, event_id from events where event_type = 'click' qualify row_number() over (partition by user_id, ts order by event_id desc) = 1)"
    " select l.event_id, l.user_id, r.event_id as click_id, r.value as click_value from l asof left join r on l.user_id = r.user_id and l.ts >= r.ts"
)
def asof_clicks(spark, sf_dir):
    """Each purchase with the user's last click before it."""
    e = _table(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return temporal.asof_join(bought, clicks, "user_id", "ts", ["click_id", "click_value"], 86_400, "click_id").drop("ts")


@_query(
    "with days as (select l_orderkey, l_linenumber, l_suppkey, l_shipdate::date - date '1970-01-01' as ship, l_quantity::bigint as days from lineitem)"
    " select r.l_suppkey, r.l_orderkey, r.l_linenumber, count(*) as n_shipped, min(p.ship)::bigint as first_ship from days p join days r on p.l_suppkey = r.l_suppkey and p.ship between r.ship and r.ship + r.days where r.l_linenumber = 1 group by all"
)
def shipped_in_ranges(spark, sf_dir):
    """For each first line of an order: how many lines its supplier shipped within as many days after it as it has pieces."""
    lines = _table(spark, sf_dir, "lineitem").withColumn("day", F.unix_date(F.to_date("l_shipdate")).cast("bigint"))
    ranges = lines.where("l_linenumber = 1").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("day").alias("low"), (F.col("day") + F.col("l_quantity").cast("bigint")).alias("high"))
    hits = temporal.in_ranges(lines.select("l_suppkey", F.col("day").alias("ship")), ranges, "l_suppkey", F.col("ship"), F.col("low"), F.col("high"), 32)
    return hits.groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.count("*").alias("n_shipped"), F.min("ship").alias("first_ship"))


@_query(
    "select a.event_id as finding_id, b.event_id as feedback_id, a.user_id, a.ts, b.ts as feedback_ts from events a join events b on a.user_id = b.user_id"
    " and b.ts between a.ts and a.ts + interval 6 hours where a.event_type = 'click' and b.event_type = 'purchase'"
)
def feedback_within(spark, sf_dir):
    """Pairs of a click and a purchase of the same user within six hours; the batch form of a stream-stream join."""
    e = _table(spark, sf_dir, "events")
    side = lambda kind, name: e.where(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias(name))
    return jobs.feedback_of(side("click", "finding_id"), side("purchase", "feedback_id"), "user_id", "6 hours")


# --- Blocks of Python by indentation ---

#: Blocks of the templates, by reading: template, keyword, name, first and last line, depth, name of the function or class around.
_BLOCKS = [
    (0, "def", "load", 2, 6, 1, None), (0, "try", None, 3, 6, 2, "load"), (0, "def", "token_for", 7, 10, 1, None), (0, "def", "run", 12, 21, 1, None),
    (1, "def", "scan", 3, 18, 1, None), (1, "for", None, 5, 8, 2, "scan"), (1, "if", None, 6, 7, 3, "scan"),
    (2, "def", "area", 4, 6, 1, None), (2, "class", "Box", 7, 9, 1, None), (2, "def", "__init__", 8, 9, 2, "Box"),
]


def _blocks_sql() -> str:
    rows = ", ".join("(" + ", ".join("null" if x is None else quote(x) if isinstance(x, str) else str(x) for x in b) + ")" for b in _BLOCKS)
    return f"select doc_id as file_id, word, name, line_start, line_end, depth, inside from documents join (values {rows}) as v(k, word, name, line_start, line_end, depth, inside) on doc_id % {len(TEMPLATES)} = k"


def _python_files(spark, sf_dir) -> DataFrame:
    """The templates of Python alone, one a document: prose after them may begin with a word of the language."""
    picks = F.pmod("doc_id", F.lit(len(TEMPLATES))).cast("int")
    codes = F.array(*(F.lit(code if language == book.PY else None).cast("string") for language, code in TEMPLATES))
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.lit(book.PY).alias("language"), F.get(codes, picks).alias("code")).where("code is not null")


@_query(_blocks_sql())
def python_blocks(spark, sf_dir):
    return blocks.python_blocks(_python_files(spark, sf_dir))


@_query(
    f"with b as ({_blocks_sql()}) select file_id, count(*) filter (word = 'def') as n_functions, count(*) filter (word = 'class') as n_classes, max(depth) as max_nesting,"
    " coalesce(max(line_end - line_start + 1) filter (word = 'def'), 0) as max_function_length, sum(line_end - line_start + 1) filter (word = 'def') / count(*) filter (word = 'def') as avg_function_length from b group by 1"
)
def python_block_metrics(spark, sf_dir):
    return blocks.block_metrics(blocks.python_blocks(_python_files(spark, sf_dir)))


# --- Metrics ---

_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0)
_LE = f"coalesce(list_min(list_filter([{', '.join(map(str, _BOUNDS))}], lambda b: b >= value)), 'infinity'::double)"


@_query(f"select event_type, {_LE} as le, count(*) as n from events where value is not null group by all")
def value_histograms(spark, sf_dir):
    """Histograms of the values of each type of event, merged from those of even and odd users."""
    e = _table(spark, sf_dir, "events")
    parts = [metrics.histogram(e.where(F.col("user_id") % 2 == k), F.col("value"), ["event_type"], _BOUNDS) for k in (0, 1)]
    return metrics.merged(*parts)


@_query(
    f"with h as (select event_type, {_LE} as le, count(*) as n from events where value is not null group by all),"
    " c as (select *, sum(n) over (partition by event_type order by le) as upto, sum(n) over (partition by event_type) as whole from h)"
    " select event_type, max(whole)::bigint as n, min(le) as quantile from c where upto >= whole * 0.9 group by 1"
)
def value_quantiles(spark, sf_dir):
    """The bound that nine tenths of the values of each type of event are at most."""
    e = _table(spark, sf_dir, "events")
    return metrics.quantile(metrics.histogram(e, F.col("value"), ["event_type"], _BOUNDS), ["event_type"], 0.9)
