"""Mixing sources to target weights by weighted fair queueing.

Every source is shuffled (by a hash of the id and the row) and its documents queue up: a document's virtual finish time is the
source's words up to and including it, divided by the source's target.  A source may be asked for more than it has, so
its queue is repeated, up to `repeats` times.  All copies, ordered by finish time, make up the mix, truncated where
their words reach the total budget.

Targets: the budget is shared by weight; a source stops at `repeats` times its size and the excess is shared again.
The order is cut into ranges of finish time; their exact sums tell in which range the budget ends, that one is cut again
until it is small, and only then sorted.  Cumulative words are summed in two levels (blocks of a source, then within a block), so no task sees a whole
source.  Everything follows from the rows alone, so reruns agree.

Nulls: a null text has 0 words and is never taken; null sources form one source, last; null ids are kept.  Repeated rows
each count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm._bytes import text_udf
from lintlake.llm._common import id_and_text, numbered, park, row_key

#: Finish times are at most about `repeats` at the least weighted source; ranges are this fraction of one.
STEP = 1 / 4096


def word_count() -> Column:
    """A column function: the number of white-space words of a text."""
    return text_udf(lambda part: pa.array([len(t.split()) for t in part], pa.int64()), "bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], repeats: int) -> DataFrame:
    """source, source_size, rows, target for a table (source, source_size, rows) with one row a source.

    Water filling: with a level of words per weight, a source gets level * weight or its cap; sources over their cap
    leave the sharing and the level rises, until none is above.  Only the level and two sums come to the driver.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    sizes = sizes.withColumns({"weight": F.get(cycle, rank % len(weights)), "cap": F.col("source_size") * F.lit(float(repeats))})
    sizes = park(sizes, "sources")
    budget = float(sizes.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * level
        n, used, free = sizes.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (budget - (used or 0.0)) / free
    return sizes.select("source", "source_size", "rows", F.least("cap", F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeats: int = 3, block_rows: int = 500, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, rh (the row's key), source, size, source_size, target, taken (words the mix takes of the document), one row per row of docs."""
    rows = id_and_text(docs, id_col, text_col, row="rh", source=source_col).withColumn("source", F.col("source").cast("string"))
    rows = rows.select("doc_id", "rh", "source", word_count()("text").alias("size"))
    # The shuffle's order is by the id, then the row and its number among its equals: none of them makes a block of its own.
    rows = numbered(rows, "sizes").withColumn("turn", F.xxhash64("doc_id", "rh", "copy", F.lit(17)))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, repeats)
    targets = park(targets, "targets").withColumnRenamed("source", "s")
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["s"])).drop("s")
    # Blocks of a source: equal ranges of the hash, so in order of the shuffle; as many as rows in each, if those are many.
    blocks = F.ceil(F.col("rows") / F.greatest(F.lit(float(block_rows)), F.sqrt("rows")))
    block = F.least(blocks - 1, F.floor((F.col("turn") / F.lit(2.0**64) + 0.5) * blocks))
    rows = park(rows.withColumn("block", block.cast("bigint")), "queued")
    sums = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "block").orderBy("turn", "doc_id", "rh", "copy").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inside))
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["s"]) & (rows["block"] == sums["b"]))
    rows = park(rows.select("doc_id", "rh", "source", "size", "source_size", "target", "turn", (F.col("upto") + F.col("before")).alias("words")), "finish")
    cut = _cut(rows, repeats)
    copies = F.sequence(F.lit(0), F.lit(repeats - 1))
    if cut is None:
        included = F.lit(False)
        taken = F.lit(0).cast("bigint")
    else:
        key = lambda *cols: F.struct(*(c.alias(f"k{i}") for i, c in enumerate(cols)))
        included = lambda e: key(_finish(e), F.col("turn"), F.coalesce("doc_id", F.lit(-(1 << 63))), F.col("words")) <= key(*cut)
        taken = F.col("size") * F.size(F.filter(copies, lambda e: (F.col("size") > 0) & included(e)))
    return rows.select("doc_id", "rh", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def _finish(copy: Column) -> Column:
    """Virtual finish time of a document's copy in the given round of its source's queue."""
    return (copy * F.col("source_size") + F.col("words")) / F.col("target")


def _cut(rows: DataFrame, repeats: int, most: int = 1 << 18) -> tuple | None:
    """The last (finish, turn, doc_id, words) that the budget takes, as literals; None if it takes nothing.

    The range in which the budget ends is cut into ranges again until it holds at most `most` copies, which one task sorts.
    """
    queue = rows.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    queue = queue.select(_finish(F.col("e")).alias("finish"), "turn", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "words", "size")
    left = rows.agg(F.sum("size")).first()[0] or 0
    # What finishes by time 2 is in ranges of STEP, the rest in one; a source's last copy within its target ends by 1.
    low, step, ranges = 0.0, STEP, math.ceil(2 / STEP)
    while True:
        numbers = queue.withColumn("range", F.greatest(F.lit(0), F.least(F.lit(ranges), F.floor((F.col("finish") - low) / step))).cast("int"))
        at, n = None, 0
        for r in numbers.groupBy("range").agg(F.sum("size").alias("words"), F.count("*").alias("n")).orderBy("range").collect():  # at most ranges + 1 rows
            at, n = r["range"], r["n"]
            if r["words"] >= left:
                break
            left -= r["words"]
        if at is None:
            return None
        queue = numbers.where(F.col("range") == at).drop("range")
        # Copies that finish at one time are of different sources, so few: nothing finer than doubles tell apart is needed.
        if n <= most or at == ranges or step < 1e-15:
            break
        low, step, ranges = low + at * step, step * STEP, math.ceil(1 / STEP)
    order = ["finish", "turn", "id", "words"]
    last = queue.withColumn("sum", F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    # The copy that reaches the budget is the last one in.
    end = last.where(F.col("sum") - F.col("size") < left).orderBy(*(F.desc(c) for c in order)).first()
    return F.lit(end["finish"]), F.lit(end["turn"]), F.lit(end["id"]), F.lit(end["words"])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them.  Rows that are equal in all columns share their copies."""
    copies = mix(docs, **options).where("taken > 0").groupBy(F.col("rh").alias("__rh")).agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("__copies"))
    once = docs.withColumn("__rh", row_key(docs)).dropDuplicates(["__rh"]).join(copies, "__rh")
    return once.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")
