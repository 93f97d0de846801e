"""Helpers the corpus operators share: the shared scratch folder, text patterns, spans, range look-ups."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.operators.parking import _PARKED, drop_parked, park, parked, shared_dir  # noqa: F401

#: Characters that separate words: ASCII other than letters and digits.  Everything from U+0080 on belongs to a word.
BREAKS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: White space of the white-space tokenizers.
BLANKS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Put around matches; any in the text first becomes the other non-character, which no pattern here tells apart.
MARK, OTHER = "￿", "￾"


def numbered(rows: DataFrame, name: str, block: int = 4096) -> DataFrame:
    """rows, parked, with `copy`: rows that are equal in all columns are numbered from 0.

    They are counted where they lie, before any shuffle, and dealt out again in blocks, so however many rows are equal, no
    task meets them all; the numbers don't depend on how the rows lay.
    """
    counted = park(rows.groupBy(*rows.columns).agg(F.count("*").alias("__n")), name)
    once = counted.where("__n = 1").select(*rows.columns, F.lit(0).cast("bigint").alias("copy"))
    many = counted.where("__n > 1")
    if many.isEmpty():
        return once
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / block)))
    dealt = many.withColumn("__b", blocks).repartition(*rows.columns, "__b")
    copies = F.sequence(F.col("__b") * block, F.least(F.col("__n"), (F.col("__b") + 1) * block) - 1)
    return park(once.unionByName(dealt.select(*rows.columns, F.explode(copies).alias("copy"))), f"{name}_numbered")


def row_key(docs: DataFrame) -> Column:
    """A hash of all of a row's columns: rows that differ anywhere, nulls included, have different ones."""
    cols = [F.col(f"`{c}`").cast("string") if kind.startswith("map") else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return F.xxhash64(*cols, *(c.isNull() for c in cols))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None, **more: str) -> DataFrame:
    """Only the columns an operator needs, so that no other column's name can clash with its own; row: a name for row_key."""
    return docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        docs[text_col].cast("string").alias("text"),
        *([row_key(docs).alias(row)] if row else []),
        *(docs[col].alias(name) for name, col in more.items()),
    )


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def long_array(values) -> Column:
    """An array literal that folds to a constant, however long."""
    return F.from_json(F.lit(json.dumps([int(v) for v in values])), "array<bigint>")


def range_of(key: Column, bounds: list[int], fan: int = 64) -> Column:
    """How many of the ascending bounds are at most key: its range, from 0, by a two-level search."""
    if len(bounds) <= fan:
        return F.size(F.filter(long_array(bounds), lambda b: b <= key))
    coarse = bounds[fan - 1 :: fan]
    rows = F.from_json(F.lit(json.dumps([bounds[i : i + fan] for i in range(0, len(bounds) + 1, fan)])), "array<array<bigint>>")
    top = F.size(F.filter(long_array(coarse), lambda b: b <= key))
    return top * fan + F.size(F.filter(F.get(rows, top), lambda b: b <= key))


def bound(value: Column, body) -> Column:
    """body(value) with value worked out once, also where body uses it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sum(values: Column, group: int = 512) -> Column:
    """Exclusive prefix sums of an int array, in two levels: each group's own, and those of the groups' totals, worked out once."""
    none = F.expr("cast(array() as array<bigint>)")

    def scan(arr: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("sum"), none.alias("out"))
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
        return F.aggregate(arr, start, step, lambda acc: acc["out"])

    def groups(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / group).cast("int")), lambda g: F.slice(all_, g * group + 1, F.lit(group)))

    def sums(parts: Column) -> Column:
        starts = scan(F.transform(parts, lambda g: F.aggregate(g, F.lit(0).cast("bigint"), lambda a, x: a + x)))
        return bound(starts, lambda s: F.flatten(F.transform(parts, lambda g, i: F.transform(scan(g), lambda x: x + F.get(s, i)))))

    made = bound(values, lambda all_: F.when(F.size(all_) > 0, bound(groups(all_), sums)).otherwise(none))
    return F.when(values.isNotNull(), made)


SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def with_spans(df: DataFrame, text: str, out: str, pattern: str, sieve: str | None = None, around: int | None = None, blank: str | None = None) -> DataFrame:
    """Add column `out`: the leftmost non-overlapping matches of a Java pattern, in code points, end exclusive.

    Matches are marked, the text is cut at the marks, and the pieces' lengths add up to positions; the cost is linear in
    the text.  Rows that the sieve (a cheaper pattern, else the pattern itself) doesn't match cost one search.  around: add
    to each span a hash of up to so many characters on either side, as far as the neighbouring matches.  blank: a column to
    add, the text with blanks for its matches, null if there are none.
    """
    parts, hit = f"__{out}_parts", F.col(text).rlike(sieve or pattern)
    marked = F.regexp_replace(F.translate(F.col(text), MARK, OTHER), pattern, f"{MARK}$0{MARK}")
    df = df.withColumn(parts, F.when(hit, F.split(marked, MARK, -1)))
    sizes = F.transform(F.col(parts), lambda p: F.length(p).cast("bigint"))
    df = df.withColumn(f"{parts}_at", F.when(F.size(parts) > 1, running_sum(sizes)))

    def made(all_: Column, at: Column) -> Column:
        def span(i: Column) -> Column:
            fields = [F.get(at, i).alias("start"), F.get(at, i + 1).alias("end"), F.get(all_, i).alias("value")]
            if around:
                fields.append(F.xxhash64(F.right(F.get(all_, i - 1), F.lit(around)), F.left(F.get(all_, i + 1), F.lit(around))).alias("around"))
            return F.struct(*fields)

        return F.transform(F.sequence(F.lit(1), F.size(all_) - 1, F.lit(2)), span)

    kind = SPANS if not around else SPANS.replace("value:string", "value:string,around:bigint")
    found = F.when(F.size(parts) > 1, bound(F.struct(F.col(parts).alias("p"), F.col(f"{parts}_at").alias("at")), lambda s: made(s["p"], s["at"])))
    df = df.withColumn(out, F.coalesce(found, F.expr(f"cast(array() as {kind})")).cast(kind))
    if blank:
        blanked = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit(" "), F.length(p))).otherwise(p)), "")
        df = df.withColumn(blank, F.when(F.size(parts) > 1, blanked))
    return df.drop(parts, f"{parts}_at")


def spans_text(spans: Column) -> Column:
    """kind:start:end of an array of structs (start, rank, kind, end), sorted as structs, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def tagged(spans: Column, kind: str, rank: int, by_kind: bool = False) -> Column:
    """Spans as structs that sort by start, then rank; by_kind: by rank, then start."""
    start, order = (lambda s: s["start"].alias("start")), F.lit(rank).alias("rank")
    rest = lambda s: [s["end"].alias("end"), F.lit(kind).alias("kind")]
    return F.transform(spans, lambda s: F.struct(order, start(s), *rest(s)) if by_kind else F.struct(start(s), order, *rest(s)))
