"""Stored results: a cache of reviews by content, and a store of reviews by id, as tables that only grow.

A table is a folder of Parquet files.  Writing appends rows, the latest row of a key counts, deleting appends a row
without a payload, and `compact` writes what is left anew.  Times are given by the caller, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.feedback import content_key, page

SCHEMA = "key string, saved_at timestamp, expires_at timestamp, payload string"
#: Seconds that cached results and stored reviews are kept by default.
CACHE_TTL, STORE_TTL = 3600, 2_592_000


def save(rows: DataFrame, path: str, now: Column, ttl: int) -> None:
    """Append rows (key, payload)."""
    until = now + F.make_dt_interval(secs=F.lit(ttl))
    rows.select(F.col("key").cast("string"), now.cast("timestamp").alias("saved_at"), until.cast("timestamp").alias("expires_at"), F.col("payload").cast("string")).write.mode("append").parquet(path)


def current(table: DataFrame, now: Column) -> DataFrame:
    """key, saved_at, expires_at, payload: the latest row of each key that hasn't expired or been deleted."""
    latest = table.groupBy("key").agg(F.max(F.struct("saved_at", F.col("payload").isNull().alias("gone"), "expires_at", "payload")).alias("r"))
    rows = latest.select("key", "r.saved_at", "r.expires_at", "r.payload")
    return rows.where(F.col("payload").isNotNull() & (F.col("expires_at") > now))


def load(spark: SparkSession, path: str, now: Column) -> DataFrame:
    return current(spark.read.schema(SCHEMA).parquet(path), now)


def delete(spark: SparkSession, path: str, keys: list[str], now: Column) -> None:
    rows = spark.createDataFrame([(k,) for k in keys], "key string")
    save(rows.withColumn("payload", F.lit(None)), path, now, 0)


def compact(spark: SparkSession, path: str, to: str, now: Column) -> None:
    """Write the current rows to another folder."""
    load(spark, path, now).write.mode("overwrite").parquet(to)


def cache_reviews(reviews: DataFrame, path: str, now: Column, ttl: int = CACHE_TTL) -> None:
    """Keep review rows (code, language, and the fields of a result) by content; files of equal content are kept once."""
    fields = [c for c in reviews.columns if c not in ("code", "file_id", "path")]
    rows = reviews.select(content_key(F.col("code"), F.col("language")).alias("key"), F.to_json(F.struct(*fields)).alias("payload"))
    save(rows.groupBy("key").agg(F.min("payload").alias("payload")), path, now, ttl)


def cached_reviews(files: DataFrame, path: str, now: Column) -> DataFrame:
    """files with `payload`, the stored result, and `cached`; null and false where there is none."""
    held = load(files.sparkSession, path, now).select("key", "payload")
    rows = files.withColumn("key", content_key(F.col("code"), F.col("language"))).join(held, "key", "left")
    return rows.withColumn("cached", F.col("payload").isNotNull()).drop("key")


def recent(spark: SparkSession, path: str, now: Column, limit: int = 20, offset: int = 0) -> DataFrame:
    """review_id, saved_at, payload of the newest reviews."""
    rows = load(spark, path, now).select(F.col("key").alias("review_id"), "saved_at", "payload")
    return page(rows, offset, limit)
