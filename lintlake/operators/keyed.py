"""Tables of one row a key, overwritten by key, each batch exactly once.

A table is a folder: `data/version=N/bucket=B` holds the rows of a bucket of keys as batch N left them, and `ledger` has
one file a batch with the buckets that it touched.  A batch reads only the buckets of its keys, writes them anew beside
the old ones and enters itself into the ledger last, with one file.  Readers see what the ledger names, so a batch that
failed half-way shows nothing, and one that is replayed changes nothing.  One writer at a time; readers as many as like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LEDGER = "number bigint, buckets array<int>, schema string, n_buckets int"


def create(spark: SparkSession, path: str, schema: str, buckets: int = 64) -> None:
    """An empty table of the columns `schema` (DDL)."""
    _enter(spark, path, -1, [], schema, buckets, "error")


def _enter(spark: SparkSession, path: str, number: int, touched: list[int], schema: str, buckets: int, mode: str) -> None:
    row = spark.createDataFrame([(number, touched, schema, buckets)], LEDGER)
    row.coalesce(1).write.mode(mode).json(f"{path}/ledger/batch={number}")


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").json(f"{path}/ledger")


def _about(spark: SparkSession, path: str) -> tuple[str, int]:
    first = _ledger(spark, path).where("number = -1").first()
    return first["schema"], first["n_buckets"]


def read(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The table's rows; only: of these buckets."""
    schema, _ = _about(spark, path)
    latest = _ledger(spark, path).select("number", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.max("number").alias("number"))
    if only is not None:
        latest = latest.where(F.col("bucket").isin(only))
    folders = [f"{path}/data/version={r['number']}/bucket={r['bucket']}" for r in latest.collect()]  # at most one a bucket
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def apply_batch(rows: DataFrame, path: str, keys: list[str], number: int, order: str | None = None) -> bool:
    """Put rows (the table's columns) over those of equal keys, as batch `number`; False if that batch is in already.

    Of rows of equal keys within a batch the one with the largest `order` stays, else the largest as a row.  Null keys are a key.
    """
    spark = rows.sparkSession
    if not _ledger(spark, path).where(F.col("number") == number).isEmpty():
        return False
    schema, n = _about(spark, path)
    columns = spark.createDataFrame([], schema).columns
    bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    rows = rows.select(*columns)
    touched = sorted(r[0] for r in rows.select(bucket.alias("b")).distinct().collect())  # at most n
    rest = [c for c in columns if c not in keys]
    best = F.struct(*([F.col(order).alias("__order")] if order else []), *rest)
    new = rows.groupBy(*keys).agg(F.max(best).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*columns)
    old = read(spark, path, touched)
    same = [old[k].eqNullSafe(new[k]) for k in keys]
    kept = old.join(new.select(*keys), _all(same), "left_anti")
    kept.unionByName(new).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={number}")
    _enter(spark, path, number, touched, schema, n, "overwrite")
    return True


def _all(tests: list[Column]) -> Column:
    found = tests[0]
    for t in tests[1:]:
        found = found & t
    return found


def upsert_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Each micro-batch of a stream over the table, exactly once, whatever is replayed."""
    run = lambda batch, number: apply_batch(batch, path, keys, number, order) and None
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
