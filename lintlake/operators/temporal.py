"""Joins by order: as-of (the last row before), and points in ranges.

Both work within pieces of a key's time or number line, so that one key's rows, however many, spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], width: float, order: str | None = None) -> DataFrame:
    """left with `values` of the last row of right with the same key and a smaller or equal `at` (null if there is none).

    Ties of right go to the largest `order` (else the largest values).  A key's line is cut into pieces of `width`
    (seconds for timestamps): within a piece the last value is carried by a window over (key, piece), and into a piece by
    the last value of the pieces before, of which there is one row each.  Rows of left with a null key or `at` get nulls;
    rows of right with one are passed over.
    """
    kinds = dict(left.dtypes)
    epoch = F.lit("1970-01-01").cast(kinds[at]) if kinds[at].startswith("timestamp") else None
    number = lambda df: df[at].cast("double") if epoch is None else F.timestamp_diff("MICROSECOND", epoch, df[at]) / 1e6
    piece = lambda df: F.floor(number(df) / width)
    held = lambda df: F.struct(df[at], *([df[order]] if order else []), *(df[v].alias(f"v{i}") for i, v in enumerate(values)))
    known = right.where(right[key].isNotNull() & right[at].isNotNull()).select(right[key].alias("__key"), piece(right).alias("__piece"), right[at].alias("__at"), held(right).alias("__held"))
    mine = left.select(left[key].alias("__key"), piece(left).alias("__piece"), left[at].alias("__at"), F.struct(*(left[c] for c in left.columns)).alias("__row"))
    rows = mine.withColumn("__held", F.lit(None).cast(known.schema["__held"].dataType)).unionByName(known.withColumn("__row", F.lit(None).cast(mine.schema["__row"].dataType)))
    # Rows of right stand before those of left of the same time, the last of them last.
    own = Window.partitionBy("__key", "__piece").orderBy("__at", F.col("__row").isNotNull(), "__held").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__last", F.last("__held", ignorenulls=True).over(own)).where(F.col("__row").isNotNull())
    before = Window.partitionBy("__key").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    # One row a key and piece: what its last row of right holds, carried over pieces without any.
    ends = mine.select("__key", "__piece", F.lit(None).cast(known.schema["__held"].dataType).alias("__held")).unionByName(known.select("__key", "__piece", "__held"))
    carried = ends.groupBy("__key", "__piece").agg(F.max("__held").alias("__end")).withColumn("__carried", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    joined = rows.join(carried.where("__carried is not null"), ["__key", "__piece"], "left")
    found = F.coalesce("__last", "__carried")
    return joined.select("__row.*", *(found[f"v{i}"].alias(v) for i, v in enumerate(values)))


def in_ranges(points: DataFrame, ranges: DataFrame, key: str, at: Column, low: Column, high: Column, width: int) -> DataFrame:
    """points joined to the ranges (low to high, both included, whole numbers) of their key that hold them: all columns of both.

    Ranges are cut into buckets of `width` and meet points by (key, bucket), an equality join; a range is in as many
    buckets as it is long, so width should be near the ranges' usual length.  A pair is met once, in the point's bucket.
    Null keys and ends, and ranges that end before they begin, match nothing.
    """
    cut = lambda c: F.floor(c / F.lit(width))
    put = ranges.withColumns({"__low": low.cast("bigint"), "__high": high.cast("bigint")}).where("__low <= __high")
    put = put.withColumn("__bucket", F.explode(F.sequence(cut(F.col("__low")), cut(F.col("__high")))))
    mine = points.withColumn("__at", at.cast("bigint"))
    joined = mine.withColumn("__bucket", cut(F.col("__at"))).join(put, [key, "__bucket"])
    return joined.where(F.col("__at").between(F.col("__low"), F.col("__high"))).drop("__bucket", "__at", "__low", "__high")


def changed_findings(findings: DataFrame, changed: DataFrame, width: int = 32) -> DataFrame:
    """Findings (file_id, line_start, ...) on a changed line; changed: file_id, first, last, any number of ranges a file, which may overlap."""
    keyed = findings.withColumn("__row", F.monotonically_increasing_id())
    ranges = changed.select("file_id", "first", "last").distinct()
    hits = in_ranges(keyed.select("file_id", "line_start", "__row"), ranges, "file_id", F.col("line_start"), F.col("first"), F.col("last"), width)
    return keyed.join(hits.select("__row").distinct(), "__row", "left_semi").drop("__row")
