"""Latency histograms that merge: counts of values by fixed upper bounds, of batches and of streams.

A histogram is rows of (group, le, n): n values were at most le and more than the bound below; le is infinity for the
rest.  As bounds are fixed, histograms of parts add up to that of the whole.  Null values aren't counted.
"""

from __future__ import annotations

import bisect
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Upper bounds in seconds.
SECONDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def histogram(rows: DataFrame, value: Column, by: list[str], bounds: tuple[float, ...] = SECONDS) -> DataFrame:
    """by, le, n; a group has rows for the bounds that it has values for."""
    put = rows.withColumn("__value", value.cast("double")).where("__value is not null")
    le = F.array(*(F.lit(float(b)) for b in bounds), F.lit(float("inf")))
    at = F.array_min(F.filter(le, lambda b: b >= F.col("__value")))
    return put.select(*by, F.coalesce(at, F.lit(float("inf"))).alias("le")).groupBy(*by, "le").agg(F.count("*").alias("n"))


def merged(*parts: DataFrame) -> DataFrame:
    """One histogram of several of the same groups and bounds."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*(c for c in whole.columns if c != "n")).agg(F.sum("n").alias("n"))


def quantile(histograms: DataFrame, by: list[str], q: float) -> DataFrame:
    """by, n, quantile: the smallest bound that at least the share q of a group's values are at most."""
    upto = Window.partitionBy(*by).orderBy("le").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a bound
    rows = histograms.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(*by))})
    return rows.where(F.col("upto") >= F.col("all") * q).groupBy(*by).agg(F.max("all").alias("n"), F.min("le").alias("quantile"))


class BatchTimes(StreamingQueryListener):
    """Counts micro-batches by their duration, their rows, and the queries that run; to be added to the session's streams."""

    def __init__(self, bounds: tuple[float, ...] = SECONDS):
        self.bounds, self.times, self.rows, self.running = bounds, Counter(), 0, 0

    def onQueryStarted(self, event) -> None:
        self.running += 1

    def onQueryProgress(self, event) -> None:
        at = bisect.bisect_left(self.bounds, event.progress.batchDuration / 1000)
        self.times[self.bounds[at] if at < len(self.bounds) else float("inf")] += 1
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.running -= 1

    def table(self, spark) -> DataFrame:
        """The durations as a histogram, to be merged with others."""
        return spark.createDataFrame(sorted(self.times.items()), "le double, n bigint")
