"""Run rules over files: one projection over each file's lines, no shuffle until findings are deduplicated.

files: file_id, language, code; `structure` (lintlake.operators.structure) where metric rules are wanted.  Null codes
and unknown languages have no findings.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import rulebook as book
from lintlake.functions.predicates import Place, Test, quote, window_column
from lintlake.functions.rulebook import ALL, Rule
from lintlake.functions.textops import indent, line_count, matches, split_lines, starts_with_any, strip
from lintlake.functions.triggers import folded, holds, needs, pattern_signs, required, shows, signs

#: What the projection over lines makes of a finding; the rest is added from the table of rules.
HIT = "struct<rule_ord:int,seq:int,line_start:int,severity:string,title:string>"
#: What a number rule needs in a line.
DIGITS = r"\p{Nd}{3}"
#: Literals that are sought in each line before a pattern is tried.
FEW = 16
LINE_KINDS = ("line", "outside_tests", "after_loop", "todo")


def _finding(rule: Rule, title: Column | None, line: Column | None, seq: Column | int = 0, severity: Column | None = None) -> Column:
    """A HIT; title and severity only where they aren't the rule's own."""
    none = F.lit(None)
    return F.struct(
        F.lit(book.every_rule().index(rule)).alias("rule_ord"),
        (F.lit(seq) if isinstance(seq, int) else seq.cast("int")).alias("seq"),
        (none if line is None else line).cast("int").alias("line_start"),
        (none if severity is None else severity).cast("string").alias("severity"),
        (none if title is None else title).cast("string").alias("title"),
    )


def _fill(title: str, *values: Column) -> Column:
    parts = title.split("{}")
    out = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=False):
        out += [value.cast("string"), F.lit(part)]
    return F.concat(*out)


def _title(rule: Rule, line: Column) -> Column | None:
    if not rule.extract:
        return None
    pattern, group = rule.extract
    return _fill(rule.title, F.regexp_extract(line, "(?U)" + pattern, group))


def _line_test(rule: Rule, at: Place, language: str) -> Column:
    """Whether a line rule fires at a line."""
    if rule.kind == "after_loop":
        found = matches(at.line, book.CONCAT[language]) & F.coalesce(F.col("first_loop") <= at.i, F.lit(False))
    else:
        found = rule.test.spark(at)
    if rule.kind == "todo":
        return found
    if rule.kind == "outside_tests":
        # In tests: after the last test attribute no line was a lone closing brace.
        last = lambda places: F.array_max(F.filter(places, lambda k: k <= at.i))
        begun, ended = last(F.col("test_lines")), last(F.col("closing_lines"))
        found = found & (begun.isNull() | F.coalesce(ended > begun, F.lit(False)))
    return (~starts_with_any(at.stripped, rule.skip) & found) if rule.skip else found


def _todo_title(line: Column) -> Column:
    word = lambda lead: F.regexp_extract(line, rf"(?iU){lead}.*\b(TODO|FIXME|HACK|XXX|BUG)\b", 1)
    # The alternative that starts first in the line is the one that matches; where both start a match, the earlier.
    first, second = F.regexp_instr(line, F.lit(r"(?iU)#.*\b(TODO|FIXME|HACK|XXX|BUG)\b")), F.regexp_instr(line, F.lit(r"(?iU)//.*\b(TODO|FIXME|HACK|XXX|BUG)\b"))
    return F.upper(F.when((first > 0) & ((second == 0) | (first < second)), word("#")).otherwise(word("//")))


def _numbers(rule: Rule, at: Place) -> Column:
    """Findings for each unexplained number of a line."""
    mark = "￿"
    pieces = F.split(F.regexp_replace(F.translate(at.line, mark, "￾"), "(?U)" + book.NUMBER, mark + "$1" + mark), mark, -1)

    def each(ps: Column) -> Column:
        def one(j: Column) -> Column:
            text = F.get(ps, j)
            start = F.aggregate(F.slice(ps, 1, j), F.lit(0), lambda acc, p: acc + F.length(p))
            low = F.greatest(F.lit(0), start - 30)
            context = F.lower(F.substring(at.line, low + 1, start + F.length(text) + 30 - low))
            value = F.ltrim(text, F.lit("0"))
            number = F.when(F.length(value) <= 6, F.when(value == "", 0).otherwise(value.cast("int")))
            explained = reduce(lambda a, b: a | b, (context.contains(w) for w in book.NUMBER_CONTEXT))
            plain = number.isin(*book.PLAIN_NUMBERS, *book.KNOWN_PORTS) | number.between(*book.HTTP_STATUS)
            return F.when(~F.coalesce(plain, F.lit(False)) & ~explained, _finding(rule, _fill(rule.title, F.when(value == "", "0").otherwise(value)), at.i + 1, j))

        found = F.transform(F.sequence(F.lit(1), F.size(ps) - 1, F.lit(2)), one)
        return F.when(F.size(ps) > 1, F.filter(found, lambda x: x.isNotNull())).otherwise(_none())

    ok = at.line.rlike(DIGITS) & ~starts_with_any(at.stripped, rule.skip) & rule.test.spark(at) & matches(at.line, book.NUMBER)
    return F.when(ok, F.flatten(F.transform(F.array(pieces), each))).otherwise(_none())


def _loop_body(rule: Rule, language: str) -> Column:
    """Line numbers with a regular expression built inside a loop, by a stack of the loops' indents."""
    title = "Regex compiled inside loop" if language == book.PY else "RegExp instantiated inside loop"
    quoted = ("'", '"', "f'", 'f"', "`") if language == book.PY else ()
    start = F.struct(F.expr("cast(array() as array<int>)").alias("stack"), F.expr("cast(array() as array<int>)").alias("hits"))

    def step(acc: Column, k: Column) -> Column:
        line, stripped = F.get("lines", k), F.get("stripped", k)
        depth = indent(line).cast("int")
        stack = F.filter(acc["stack"], lambda d: d < depth)  # loops that this line is no longer inside are left
        loop = holds(line, (required(book.LOOP_LINE),)) & matches(line, book.LOOP_LINE)
        hit = (F.size(stack) > 0) & shows(line, pattern_signs(book.COMPILE_CALL[language])) & matches(line, book.COMPILE_CALL[language]) & ~starts_with_any(stripped, quoted)
        none = F.expr("cast(array() as array<int>)")
        moved = F.struct(F.concat(stack, F.when(loop, F.array(depth)).otherwise(none)).alias("stack"), F.concat(acc["hits"], F.when(~loop & hit, F.array((k + 1).cast("int"))).otherwise(none)).alias("hits"))
        return F.when((stripped == "") | starts_with_any(stripped, ("#", "//")), acc).otherwise(moved)

    # Only a file that builds a regular expression at all needs the fold.
    fold = F.aggregate(F.sequence(F.lit(0), F.size("lines") - 1), start, step, lambda acc: F.transform(acc["hits"], lambda i: _finding(rule, F.lit(title), i)))
    return F.when((F.size("lines") > 0) & matches(F.col("code"), book.COMPILE_CALL[language]), fold).otherwise(_none())


def _none() -> Column:
    return F.expr(f"cast(array() as array<{HIT}>)")


def _file_rule(rule: Rule, language: str, structured: bool) -> Column:
    if rule.kind == "loop_body":
        return _loop_body(rule, language)
    if rule.kind == "large_file":
        n = line_count(F.col("code"))
        return F.when(n > rule.least, F.array(_finding(rule, _fill(rule.title, n), None, severity=F.when(n > 1000, "high").otherwise(rule.severity)))).otherwise(_none())
    if rule.kind in ("first_of", "count_of"):
        hits = F.filter(F.transform(F.col("lines"), lambda line, i: F.when(_guarded(rule, _place(line, i), F.get("lows", i), language), i + 1)), lambda i: i.isNotNull())
        one = F.array(_finding(rule, _fill(rule.title, F.size(hits)), None)) if rule.kind == "count_of" else F.transform(hits, lambda i: _finding(rule, None, i))
        return F.when(F.size(hits) >= rule.least, one).otherwise(_none())
    if not structured:
        return _none()
    if rule.kind == "long_function":
        high = lambda f: F.when(f["length"] > 100, "high").otherwise(rule.severity)
        found = F.transform("structure.functions", lambda f: F.when(f["length"] > rule.least, _finding(rule, _fill(rule.title, f["name"], f["length"]), f["line_start"], severity=high(f))))
        return F.coalesce(F.filter(found, lambda x: x.isNotNull()), _none())
    value = F.col("structure.complexity" if rule.kind == "complexity" else "structure.max_nesting")
    high = {"PY006": 20, "PY008": 8}.get(rule.key)
    severity = F.when(value > high, "high").otherwise(rule.severity) if high else None
    return F.when(value > rule.least, F.array(_finding(rule, _fill(rule.title, value), None, severity=severity))).otherwise(_none())


def _place(line: Column, i: Column) -> Place:
    return Place(line, F.get("stripped", i), i, F.col("lines"), F.col("code"))


def _with_places(rows: DataFrame) -> DataFrame:
    """rows with what rules ask of a file as a whole, worked out once a file and only where some line can need it.

    first_loop: number of the first loop line that isn't a comment; test_lines, closing_lines: of Rust's test attributes and
    lone closing braces.
    """
    language, code = F.col("language"), F.col("code")
    skip = next((r.skip for r in book.RULES if r.kind == "after_loop"), ())
    places = lambda hit: F.filter(F.transform("stripped", lambda x, k: F.when(hit(x), k)), lambda k: k.isNotNull())
    needed = F.lit(False)
    for name, pattern in book.CONCAT.items():
        needed = needed | ((language == name) & shows(code, pattern_signs(pattern)) & matches(code, pattern))
    tested = (language == "rust") & matches(code, book.RUST_TEST)
    return rows.withColumns({
        "first_loop": F.when(needed, F.array_min(places(lambda x: holds(x, (required(book.LOOP_WORD),)) & matches(x, book.LOOP_WORD) & ~starts_with_any(x, skip)))),
        "test_lines": F.when(tested, places(lambda x: matches(x, book.RUST_TEST))),
        "closing_lines": F.when(tested, places(lambda x: x == "}")),
    })


def _may_fire(rule: Rule) -> Column:
    """Whether a file holds what a line rule needs; `low` is its folded code."""
    if rule.kind == "after_loop":
        return F.col("first_loop").isNotNull()
    if rule.kind == "numbers":
        return F.col("code").rlike(DIGITS)
    held = holds(F.col("low"), needs(rule.test, "code"))
    return F.lit(True) if held is None else held


def _guarded(rule: Rule, at: Place, low: Column, language: str) -> Column:
    """A line rule's test behind what it needs in the line: signs, and literals where they are few."""
    few = tuple(s for s in needs(rule.test, "line") if len(s) <= FEW)
    wanted = pattern_signs(book.CONCAT[language]) if rule.kind == "after_loop" else signs(rule.test)
    ahead = [x for x in (shows(at.line, wanted), holds(low, few)) if x is not None]
    return reduce(lambda a, b: a & b, [*ahead, _line_test(rule, at, language)])


def _by_line(rules: list[Rule]) -> list[Rule]:
    return [r for r in rules if r.kind in (*LINE_KINDS, "numbers", "first_of", "count_of")]


def _of_language(language: str, rules: list[Rule], structured: bool, on: str) -> Column:
    """Findings of a language's rules.  on: a column with _may_fire of each rule of _by_line; a rule that can't fire isn't tried."""
    own = [r for r in rules if language in r.languages]
    flagged = _by_line(own)
    fires = lambda r: F.get(F.col(on), flagged.index(r))
    per_line = [r for r in own if r.kind in LINE_KINDS]
    numbers = [r for r in own if r.kind == "numbers"]

    def each(line: Column, i: Column) -> Column:
        at, low = _place(line, i), F.get("lows", i)
        hits = [F.when(fires(r) & _guarded(r, at, low, language), _finding(r, _fill(r.title, _todo_title(line)) if r.kind == "todo" else _title(r, line), i + 1)) for r in per_line]
        found = [F.filter(F.array(*hits), lambda x: x.isNotNull())] if hits else []
        return F.concat(*found, *(F.when(fires(r), _numbers(r, at)).otherwise(_none()) for r in numbers))

    parts = []
    if per_line or numbers:
        some = reduce(lambda a, b: a | b, (fires(r) for r in per_line + numbers))
        parts.append(F.when(some, F.flatten(F.transform("lines", each))).otherwise(_none()))
    for r in own:
        if r.kind in ("first_of", "count_of"):
            parts.append(F.when(fires(r), _file_rule(r, language, structured)).otherwise(_none()))
        elif r.kind not in (*LINE_KINDS, "numbers"):
            parts.append(_file_rule(r, language, structured))
    return F.concat(*parts) if parts else _none()


def _called(rules: list[Rule]) -> Column:
    """Findings of rules that are functions, each called once a file; one that raises finds nothing."""
    numbers = {r.key: book.every_rule().index(r) for r in rules}

    def of(code: str, language: str) -> list[dict]:
        found = []
        for r in rules:
            if language in r.languages:
                try:
                    hits = list(r.check(code, language))
                except Exception:  # noqa: BLE001  a user's rule must not end the job
                    hits = []
                found += [{"rule_ord": numbers[r.key], "seq": i, "line_start": line, "severity": severity, "title": title} for i, (line, title, severity) in enumerate(hits)]
        return found

    kind = pa.list_(pa.struct([("rule_ord", pa.int32()), ("seq", pa.int32()), ("line_start", pa.int32()), ("severity", pa.string()), ("title", pa.string())]))
    run = F.arrow_udf(lambda codes, languages: pa.array([of(c, k) for c, k in zip(codes.to_pylist(), languages.to_pylist(), strict=True)], kind), f"array<{HIT}>")
    return run("code", "language")


@lru_cache(maxsize=64)
def _projection(application: str, rules: tuple[Rule, ...], functions: tuple[Rule, ...], every: tuple[Rule, ...], structured: bool) -> tuple[dict[str, Column], Column]:
    """Columns that say which rules can fire in a file, and the findings; kept, for thousands of columns take seconds to put together.

    Rules of all languages stand once; the others in one branch a language.  What rules need is sought in the whole file
    first, so one that can't fire isn't tried on any line.
    """
    shared, own = [r for r in rules if r.languages == ALL], {k: [r for r in rules if r.languages != ALL and k in r.languages] for k in ALL}
    flags = lambda some: F.array(*(_may_fire(r) for r in _by_line(some))).cast("array<boolean>")
    flagged, found = flags([]), _none()
    for language in ALL:
        if own[language]:
            flagged = F.when(F.col("language") == language, flags(own[language])).otherwise(flagged)
            found = F.when(F.col("language") == language, _of_language(language, own[language], structured, "on_own")).otherwise(found)
    called = [_called(list(functions))] if functions else []
    return {"on_shared": flags(shared), "on_own": flagged}, F.concat(_of_language(ALL[0], shared, structured, "on_shared"), found, *called)


def raw_findings(files: DataFrame, disabled: tuple[str, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """file_id, language and the fields of a finding, before deduplication.  disabled: public ids; only: keys or ids."""
    rules = [r for r in book.every_rule() if r.id not in disabled and (only is None or r.key in only or r.id in only)]
    functions = [r for r in rules if r.kind == "function"]
    rules = [r for r in rules if r.kind != "function"]
    structured = "structure" in files.columns
    rows = files.where(F.col("language").isin(*ALL) & F.col("code").isNotNull()).withColumn("lines", split_lines(F.col("code")))
    rows = rows.withColumns({"stripped": F.transform("lines", strip), "lows": F.transform("lines", folded), "low": folded(F.col("code"))})
    rows = _with_places(rows)
    flags, found = _projection(files.sparkSession.sparkContext.applicationId, tuple(rules), tuple(functions), tuple(book.every_rule()), structured)
    rows = rows.withColumns(flags).select("file_id", "language", found.alias("findings"))
    # An outer explode: from a plain one the optimizer infers a filter that would work out the findings twice more.
    hits = rows.select("file_id", "language", F.explode_outer("findings").alias("f")).where("f is not null").select("file_id", "language", "f.*")
    own = rule_table(files.sparkSession)
    return hits.join(F.broadcast(own), "rule_ord").select(
        "file_id", "language", "rule_id", "rule_ord", "seq",
        F.coalesce(hits["severity"], own["severity"]).alias("severity"), "category",
        F.coalesce(hits["title"], own["title"]).alias("title"), "confidence",
        "line_start", F.col("line_start").alias("line_end"),
    )


def rule_table(spark: SparkSession) -> DataFrame:
    """rule_ord, rule_id, severity, category, title, confidence: one row a rule."""
    rows = ", ".join(f"({i}, '{r.id}', '{r.severity}', '{r.category}', {_spark_quote(r.title)}, {r.confidence}D)" for i, r in enumerate(book.every_rule()))
    return spark.sql(f"select * from values {rows} as t(rule_ord, rule_id, severity, category, title, confidence)")


def _spark_quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def dedup(findings: DataFrame, keys: tuple[str, ...] = ("line_start", "category")) -> DataFrame:
    """Of findings with equal keys in a file (null lines are equal) the most confident, the first of equals."""
    order = F.struct(F.col("confidence"), -F.col("rule_ord"), -F.col("seq"))
    rest = [c for c in findings.columns if c not in ("file_id", *keys)]
    best = findings.groupBy("file_id", *keys).agg(F.max_by(F.struct(*rest), order).alias("b"))
    return best.select("file_id", *keys, *(F.col(f"b.{c}").alias(c) for c in rest)).select(*findings.columns)


def findings(files: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    return dedup(raw_findings(files, disabled))


# --- The same line rules as SQL, for comparison with another engine ---


def _sql_skip(rule: Rule) -> str:
    return "".join(f" and not starts_with(stripped, {quote(p)})" for p in rule.skip)


def has_sql(rule: Rule) -> bool:
    return rule.kind in ("line", "first_of", "count_of", "outside_tests", "after_loop", "todo", "large_file")


def _windows(rules: list[Rule]) -> set[tuple[int, int]]:
    return set().union(*(r.test.windows() for r in rules if isinstance(r.test, Test)))


def lines_sql(files_sql: str, rules: list[Rule]) -> str:
    """CTEs `files` and `lines`, the latter with a column for each window that the rules look at."""

    def bound(n: int) -> str:
        return "current row" if n == 0 else f"{abs(n)} {'preceding' if n < 0 else 'following'}"

    windows = "".join(f", coalesce(string_agg(line, chr(10) order by i) over (partition by file_id order by i rows between {bound(a)} and {bound(b)}), '') as {window_column((a, b))}" for a, b in sorted(_windows(rules)))
    return f"""files as ({files_sql}),
cut as (select file_id, language, code, string_split(code, chr(10)) as parts from files),
ends as (select file_id, language, code, case when parts[-1] = '' then parts[:-2] else parts end as parts from cut),
one as (select file_id, language, code, generate_subscripts(parts, 1) as i, unnest(parts) as line from ends),
lines as (select *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as stripped, coalesce(lag(line) over (partition by file_id order by i), '') as prev{windows} from one)"""


def rule_sql(rule: Rule) -> str:
    """select file_id, rule_id, line_start of a line rule's findings, over `lines`."""
    langs = ", ".join(quote(x) for x in rule.languages)
    if rule.kind == "after_loop":
        concat = " or ".join(f"(language = {quote(k)} and regexp_matches(line, {quote(v)}))" for k, v in book.CONCAT.items())
        first = f"(select file_id as f, min(i) as first_loop from lines where regexp_matches(stripped, {quote(book.LOOP_WORD)}){_sql_skip(rule)} group by 1)"
        return f"select file_id, {quote(rule.id)} as rule_id, i as line_start from lines join {first} on f = file_id and i >= first_loop where language in ({langs}){_sql_skip(rule)} and ({concat})"
    if rule.kind == "large_file":
        return f"select file_id, {quote(rule.id)} as rule_id, cast(null as integer) as line_start from files where language in ({langs}) and length(code) - length(replace(code, chr(10), '')) + 1 > {rule.least}"
    hit = f"language in ({langs}){_sql_skip(rule)} and {rule.test.sql()}"
    if rule.kind == "outside_tests":
        state = f"select *, last_value(case when regexp_matches(stripped, {quote(book.RUST_TEST)}) then 1 when stripped = '}}' then 0 end ignore nulls) over (partition by file_id order by i) as in_test from lines"
        return f"select file_id, {quote(rule.id)} as rule_id, i as line_start from ({state}) where coalesce(in_test, 0) = 0 and {hit}"
    if rule.kind == "count_of":
        return f"select file_id, {quote(rule.id)} as rule_id, cast(null as integer) as line_start from lines where {hit} group by file_id having count(*) >= {rule.least}"
    if rule.kind == "first_of":
        return f"select file_id, {quote(rule.id)} as rule_id, i as line_start from (select *, count(*) over (partition by file_id) as n from lines where {hit}) where n >= {rule.least}"
    return f"select file_id, {quote(rule.id)} as rule_id, i as line_start from lines where {hit}"
