from pyspark.sql import functions as F

from lintlake.functions.textops import around, indent, line_count, split_lines, strip

TEXTS = ["", "\n", "a", "a\n", "a\r\nb", "a\u2028b\x85c", " \t a \xa0", "\n\n", "x\x0by\x0cz\x1c", "tab\tin", "é\n  è\n"]


def test_lines_and_strip_behave_like_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select("t", split_lines(F.col("t")).alias("lines"), strip(F.col("t")).alias("s"), line_count(F.col("t")).alias("n"), indent(F.col("t")).alias("i")).collect()
    for r in rows:
        assert r["lines"] == r["t"].splitlines()
        assert r["s"] == r["t"].strip()
        assert r["n"] == r["t"].count("\n") + 1
        assert r["i"] == len(r["t"]) - len(r["t"].lstrip())


def test_windows_stop_at_the_ends(spark):
    lines = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(lines,)], "lines array<string>")
    for i in range(4):
        for a, b in ((-5, 5), (0, 2), (1, 3), (-2, 0)):
            got = df.select(around(F.col("lines"), F.lit(i), a, b)).first()[0]
            assert got == "\n".join(lines[j] for j in range(4) if i + a <= j <= i + b)
