"""Literals that patterns need, against Python's re; the index by rarest grams against plain containment."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lintlake.functions import rulebook as book
from lintlake.functions import triggers
from lintlake.functions.rulebook import RULES
from lintlake.operators import taint


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"\b(eval|exec)\s*\(", {"eval", "exec"}),
        (r"(?i)PassWord\s*=", {"password"}),
        (r"ab?c\d+longer", {"longer"}),
        (r"a[xy]b", {"axb", "ayb"}),
        (r"(foo|ba+r)z", {"z"}),
        (r"\d+", None),
        (r"(abc)*x?", None),
        (r"(abc)+", {"abc"}),
        (r"x(?!abc)y", {"xy"}),
        (r"a|", None),
    ],
)
def test_required_literals(pattern, want):
    got = triggers.required(pattern)
    assert got == (want and frozenset(want))


def test_every_match_holds_a_required_literal():
    """Random texts made from the patterns' own pieces: whatever matches holds what is needed."""
    rng = random.Random(2)
    patterns = {t.pattern for r in RULES for t in _regexes(r.test)}
    pieces = [w for p in patterns for w in re.findall(r"[A-Za-z_.]+|[^A-Za-z]", p)] + ["ſ", "K", "İ", "ı", " ", "(", "'", '"', "=", "1", "{"]
    seen = 0
    for p in patterns:
        need = triggers.required(p)
        compiled = re.compile(p)
        for _ in range(300):
            text = "".join(rng.choices(pieces, k=rng.randint(1, 12)))
            if compiled.search(text) and need:
                seen += 1
                low = text.translate(str.maketrans("ſKİı", "skii")).lower()
                assert any(x in low for x in need), (p, text)
    assert seen > 100


def _regexes(test):
    if isinstance(test, triggers.Re | triggers.FirstNotIn):
        yield test
    for name in ("a", "b"):
        if isinstance(getattr(test, name, None), triggers.Test):
            yield from _regexes(getattr(test, name))


def test_index_by_rarest_grams(spark):
    specs = [("py", "open("), ("py", "os.open("), ("py", "os"), ("py", "é("), ("js", "open("), ("js", "x"), ("py", "never there")]
    texts = ["os.open(x)\nopen(y)\n\nopen", "é(open()\nos", "", "nothing", "OPEN(\nthe os.opening("]
    files = [(i, lang, t) for i, (lang, t) in enumerate((lang, t) for lang in ("py", "js", "go") for t in texts)]
    df = spark.createDataFrame([*files, (99, "py", None)], "file_id int, language string, code string")
    table = spark.createDataFrame([(lang, p, f"{lang}:{p}", "k") for lang, p in specs], "language string, pattern string, signature string, kind string")
    want = sorted((i, n, f"{lang}:{p}") for i, lang, t in files for n, line in enumerate(t.split("\n"), 1) for own, p in specs if own == lang and p in line)
    found = taint.spec_matches(df, table)
    assert sorted((r.file_id, r.line_no, r.signature) for r in found.collect()) == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    grams = {(r.language, r.pattern): r.gram for r in triggers.trigger_index(table, triggers.gram_counts(df, table, "language"), "language").collect()}
    counts = lambda lang, g: sum(g in t for _, k, t in files if k == lang)
    for (lang, p), g in grams.items():
        assert counts(lang, g) == min(counts(lang, p[i : i + 3]) for i in range(max(1, len(p) - 2)))
    assert taint.spec_matches(df, table.limit(0)).collect() == []


def test_folding(spark):
    df = spark.createDataFrame([("PAſSWORD K İı É",), (None,)], "t string")
    assert [r[0] for r in df.select(triggers.folded(F.col("t"))).collect()] == ["password k ii é", None]


def test_every_match_holds_a_sign_of_each_set():
    """Random texts made from the patterns' own pieces; calls are known by their parenthesis, whatever is called."""
    rng = random.Random(3)
    patterns = sorted({t.pattern for r in RULES for t in _regexes(r.test)} | {*book.CONCAT.values(), *book.COMPILE_CALL.values()})
    seen = 0
    for p in patterns:
        wanted, compiled = triggers.pattern_signs(p), re.compile(p)
        pieces = re.findall(r"[A-Za-z_.]+|[^A-Za-z]", p) + [" ", "(", "'", '"', "=", "1", "{", "+"]
        for _ in range(1500):
            text = "".join(rng.choices(pieces, k=rng.randint(1, 12)))
            if wanted and (m := compiled.search(text)):
                seen += 1
                assert all(any(c in m[0] for c in s) for s in wanted), (p, text)
    assert seen > 100
    log = next(r for r in RULES if r.key == "PERF005")
    assert frozenset("(") in triggers.signs(log.test) and frozenset("+") in triggers.pattern_signs(book.CONCAT["python"])
