"""Balanced shards by sampled splitters [native].

Records are ordered by (hash of the text, hash of the id, id).  Splitters are quantiles of a size-weighted sample of
that key; the ranges between them are summed exactly, and a record's shard follows from the bytes before it, so the
shards' sizes differ by about one record.  Equal texts are neighbours in this order and stay in one shard unless their
group is so large (over `tolerance` of a shard) that it would tip the balance and may be cut where a shard ends.  Such a
text, and one with over two ranges' number of rows, has a range alone, which is subdivided by the hash of the id; other
ranges with that many rows, as of very many small texts, are subdivided by the key.

Nulls: a null text counts no bytes (size 1) and is grouped with the empty text; a null id sorts first.  Repeated rows
are placed one by one.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm._common import id_and_text, long_array, numbered, park, range_of, row_key


def sample_splitters(rows: DataFrame, total_bytes: int, ranges: int, per_range: int = 256) -> list[int]:
    """Quantile boundaries of `key` over a sample in which a record's chance grows with its size.

    The sample has ranges * per_range keys on average, whatever the table's size.
    """
    rate = ranges * per_range / max(1, total_bytes)
    draw = F.pmod(F.xxhash64("doc_id", "key", "copy", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < F.col("size") * F.lit(rate))
    cuts = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    found = sample.select(F.percentile_approx("key", cuts, F.lit(max(10_000, 4 * ranges))).alias("b")).first()["b"]
    return sorted(set(found or []))


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.01, range_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rh (the row's key), size, text_crc32, key, shard, slot: every record once, shards near equal in bytes, slots from 0."""
    text = F.coalesce("text", F.lit(""))
    rows = id_and_text(docs, id_col, text_col, row="rh").select(
        "doc_id",
        "rh",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    # Rows that are equal in all columns are told apart by their number, which the salt deals out.
    rows = numbered(rows, "keys")
    count, total = rows.agg(F.count("*"), F.sum("size")).first()
    total = total or 0
    ranges = min(4096, max(8 * shards, math.ceil(count / range_rows)))
    # A group over the tolerance, or of very many rows, gets a range of its own; there are fewer than shards / tolerance
    # and ranges / 2 of them.
    target = max(1, count // ranges)
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    heavy = F.col("bytes") > tolerance * total / shards
    large = groups.where(heavy | (F.col("n") > 2 * target)).select("key", heavy.alias("heavy")).collect()
    alone, hot = [r["key"] for r in large], [r["key"] for r in large if r["heavy"]]
    bounds = sorted({*sample_splitters(rows, total, ranges), *alone, *(k + 1 for k in alone if k < (1 << 63) - 1)})
    rows = rows.withColumn("part", range_of(F.col("key"), bounds)).withColumn("salt", F.shiftrightunsigned(F.xxhash64("doc_id", "rh", "copy", F.lit(5)), 1))
    most = min(target, range_rows)
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
    full = {r["part"]: (r["n"], r["a"], r["b"]) for r in parts.where(F.col("n") > 2 * most).collect()}
    rows = rows.withColumn("sub", _sub_range(full, most, len(bounds) + 1))
    single = F.get(long_array([int(p in full and full[p][1] == full[p][2]) for p in range(len(bounds) + 1)]), F.col("part").cast("int")) == 1
    # Bytes before each range: one row a range, so one task may add them up and every executor hold them.
    before = Window.orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part", "sub").agg(F.sum("size").alias("bytes")).select("part", "sub", "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    # The middle of a subdivided range, which is that of its one text.
    whole = Window.partitionBy("part")
    starts = starts.select("part", "sub", "base", F.when(single & (F.count("*").over(whole) > 1), F.min("base").over(whole) + F.sum("bytes").over(whole) / 2).alias("whole"))
    inside = Window.partitionBy("part", "sub").orderBy("key", "salt", "doc_id", "rh", "copy")
    group = Window.partitionBy("part", "sub", "key")
    placed = (
        rows.join(F.broadcast(starts), ["part", "sub"])
        .withColumn("at", F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("middle", F.when(_is_hot(hot), F.col("at") + F.col("size") / 2).otherwise(F.coalesce("whole", F.min("at").over(group) + F.sum("size").over(group) / 2)))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.lit(shards) * F.col("middle") / F.lit(float(max(1, total))))).cast("int"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("part", "sub", "shard").orderBy("key", "salt", "doc_id", "rh", "copy")))
        .select("doc_id", "rh", "size", "text_crc32", "key", "part", "sub", "shard", "rank")
    )
    placed = park(placed, "placed")
    earlier = Window.partitionBy("shard").orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    slots = placed.groupBy("shard", "part", "sub").agg(F.count("*").alias("n")).select("shard", "part", "sub", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    return placed.join(F.broadcast(slots), ["shard", "part", "sub"]).select(
        "doc_id", "rh", "size", "text_crc32", "key", "shard", (F.col("first") + F.col("rank") - 1).cast("bigint").alias("slot")
    )


def sharded(docs: DataFrame, shards: int = 8, **options) -> DataFrame:
    """The rows of docs, all columns, with shard and slot.  Rows that are equal in all columns share their places."""
    placed = shard(docs, shards, **options).select(F.col("rh").alias("__rh"), F.struct("shard", "slot").alias("__place"))
    once = docs.withColumn("__rh", row_key(docs)).dropDuplicates(["__rh"])
    joined = once.join(placed, "__rh")
    return joined.select(*(joined[c] for c in docs.columns), F.col("__place.shard"), F.col("__place.slot"))


def _is_hot(hot: list[int]) -> Column:
    return F.col("key").isin(hot) if hot else F.lit(False)


def _sub_range(full: dict[int, tuple[int, int, int]], target: int, parts: int) -> Column:
    """Parts of an overfull range, about `target` rows each: of one key by the salt, of several by the key, which is a hash."""
    part = F.col("part").cast("int")
    doubles = lambda values: F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")
    none = (0, 0, 0)
    pieces = F.get(long_array([math.ceil(full.get(p, none)[0] / target) or 1 for p in range(parts)]), part)
    low, wide = (F.get(doubles(v), part) for v in ([full.get(p, none)[1] for p in range(parts)], [full.get(p, none)[2] - full.get(p, none)[1] for p in range(parts)]))
    along = F.when(wide > 0, (F.col("key") - low) / wide).otherwise(F.col("salt") / F.lit(2.0**63))
    return F.when(pieces > 1, F.least(pieces - 1, F.floor(along * pieces))).otherwise(F.lit(0)).cast("int")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
