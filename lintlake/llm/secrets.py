"""Secret scans [native]: known shapes, and sliding-window Shannon entropy over candidate strings.

Known shapes (assignments to secret-like names, access keys, long hex runs) are found by pattern.  Beyond them every
long run of base64-like characters is a candidate: a window of `window` characters slides over it, the counts of its
characters are kept incrementally (one comes in, one goes out, and the sum of c * log2(c) changes by two terms), and
the candidate is reported if the largest entropy of any window reaches the threshold of its character class, unless an
allow-list suppresses it.

Nulls count as empty texts; null ids are kept; repeated rows are scanned one by one; an empty table gives no rows;
other columns are ignored.  Texts are scanned whole; positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm._common import bound, id_and_text, spans_text, tagged, with_spans

#: The known shapes.  Possessive and bounded forms of the stated patterns; they match the same places.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
#: Entropy thresholds in bits by character class, for windows of 20 characters (at most log2(20) = 4.32).
THRESHOLDS = {"hex": 2.8, "single_case": 3.3, "mixed": 3.6, "letters": 4.1}
#: Marks of strings that look random but are none.
ALLOWED = r"(?i)example|placeholder|changeme|dummy|sample|lorem|x{6}|0{8}|1{8}|123456789|abcdefgh"
UUID = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
#: The shortest candidate.
LEAST = 20


def char_class(s: Column) -> Column:
    """hex, single_case, mixed, or letters (of both cases, without digits); null for words of one case and for numbers."""
    digit, upper, lower = s.rlike("[0-9]"), s.rlike("[A-Z]"), s.rlike("[a-z]")
    return F.when(~digit, F.when(upper & lower, "letters")).when(~upper & ~lower, F.lit(None)).when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(~upper | ~lower, "single_case").otherwise("mixed")


def window_entropy(s: Column, window: int = 20) -> Column:
    """The largest Shannon entropy, in bits, of any `window` consecutive characters of s; linear in its length."""
    flog = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    put = lambda counts, k, c: F.concat(F.slice(counts, F.lit(1), k), F.array(c), F.slice(counts, k + 2, F.lit(96)))

    def largest(codes: Column) -> Column:
        w = F.least(F.size(codes), F.lit(window))

        def step(acc: Column, i: Column) -> Column:
            """One character comes in, one goes out: two counts and the sum of c * log2(c) change."""
            into, out = F.get(codes, i), F.coalesce(F.get(codes, F.when(i >= w, i - w)), F.lit(-1))
            counts = acc["counts"]
            up, down = F.get(counts, into), F.get(counts, F.when(out >= 0, out))
            total = acc["total"] + flog(up + 1) - flog(up) + F.when(out >= 0, flog(down - 1) - flog(down)).otherwise(F.lit(0.0))
            more = put(counts, into, up + 1)
            return F.when(into == out, acc).otherwise(
                F.struct(
                    F.when(out >= 0, put(more, out, down - 1)).otherwise(more).alias("counts"),
                    total.alias("total"),
                    F.when(i >= w - 1, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"),
                )
            )

        start = F.struct(F.array_repeat(F.lit(0.0), 96).alias("counts"), F.lit(0.0).alias("total"), F.lit(float("inf")).alias("least"))
        n = w.cast("double")
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: F.greatest(F.lit(0.0), F.log2(n) - acc["least"] / n))

    # Characters outside the candidates' alphabet share a number.
    codes = F.transform(F.split(s, ""), lambda c: F.when(F.ascii(c).between(32, 126), F.ascii(c) - 32).otherwise(F.lit(95)))
    return F.when(F.length(s) > 0, bound(codes, largest)).otherwise(F.lit(0.0))


def high_entropy(s: Column, window: int = 20) -> Column:
    """Whether a candidate's entropy reaches its class's threshold and no allow-list entry suppresses it.

    An entry suppresses the part of the candidate, between slashes, in which it stands; the other parts that are long
    enough are judged each for itself.
    """

    def reaches(x: Column) -> Column:
        limit = F.lit(None).cast("double")
        for name, bits in THRESHOLDS.items():
            limit = F.when(char_class(x) == name, F.lit(bits)).otherwise(limit)
        return bound(limit, lambda at: at.isNotNull() & (window_entropy(x, window) >= at))

    parts = F.filter(F.split(s, "/"), lambda p: (F.length(p) >= LEAST) & ~p.rlike(ALLOWED))
    return F.when(s.rlike(UUID), F.lit(False)).when(s.rlike(ALLOWED), F.exists(parts, reaches)).otherwise(F.coalesce(reaches(s), F.lit(False)))


def secret_spans(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, and arrays of (start, end, value): assign, access, hex, entropy; one row per row of docs."""
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = with_spans(rows, "text", "assign", ASSIGN)
    rows = rows.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN_VALUE, 1)) >= 12))
    rows = with_spans(rows, "text", "access", ACCESS)
    rows = with_spans(rows, "text", "hex", HEX)
    rows = with_spans(rows, "text", "entropy", CANDIDATE)
    rows = rows.withColumn("entropy", F.filter("entropy", lambda s: high_entropy(s["value"], window)))
    return rows.select("doc_id", "assign", "access", "hex", "entropy")


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.concat(*(tagged(F.col(k), k, i) for i, k in enumerate(("assign", "access", "hex"))))
    return found.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.concat(base, tagged(F.col("entropy"), "entropy", 3))).alias("spans"),
        F.size("entropy").cast("bigint").alias("n_entropy"),
    )
