"""Feedback on findings: fingerprints, thresholds over the last reports of a key, expiring suppressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reports looked at, reports needed, and days that a suppression holds.
FINDING_LAST, FINDING_LEAST, PAIR_LAST, PAIR_LEAST, DAYS = 100, 3, 50, 2, 90


def fingerprint(category: Column, title: Column, language: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", category, F.substring(title, 1, 50), language), 256), 1, 16)


def content_key(code: Column, language: Column) -> Column:
    return F.sha2(F.concat_ws(":", code, language), 256)


def suppressions(events: DataFrame, keys: list[str], order: list[str], hit: Column, last: int, least: int, time: str | None = None, days: int = DAYS) -> DataFrame:
    """keys, n_hits, and active_until where `time` is given: keys with at least `least` hits among their last `last` events.

    A key's events are ranked in its own partition; the rank limit is pushed below the shuffle, so of a hot key no task
    sends more than `last` rows.
    """
    newest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    recent = events.withColumn("hit", hit).withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= last)
    until = [(F.max(F.when(F.col("hit"), F.col(time))) + F.make_dt_interval(F.lit(days))).alias("active_until")] if time else []
    return recent.groupBy(*keys).agg(F.count_if("hit").alias("n_hits"), *until).where(F.col("n_hits") >= least)


def finding_suppressions(events: DataFrame) -> DataFrame:
    """fingerprint, n_hits, active_until for events (category, title, language, action, ts)."""
    keyed = events.withColumn("fingerprint", fingerprint(*(F.col(c) for c in ("category", "title", "language"))))
    return suppressions(keyed, ["fingerprint"], ["ts"], F.col("action") == "false_positive", FINDING_LAST, FINDING_LEAST, "ts")


def pair_suppressions(reports: DataFrame) -> DataFrame:
    """source_sig, sink_sig, n_hits, active_until for reports (source_sig, sink_sig, ts)."""
    return suppressions(reports, ["source_sig", "sink_sig"], ["ts"], F.lit(True), PAIR_LAST, PAIR_LEAST, "ts")


def apply_suppressions(findings: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Findings (category, title, language) whose fingerprint isn't suppressed."""
    keyed = findings.withColumn("fingerprint", fingerprint(*(F.col(c) for c in ("category", "title", "language"))))
    return keyed.join(suppressed.select("fingerprint"), "fingerprint", "left_anti").drop("fingerprint")


def active(suppressed: DataFrame, now: Column) -> DataFrame:
    return suppressed.where(F.col("active_until") > now)


#: What the keys of suppressed source and sink pairs begin with.
PAIRS = "taint:"


def listed(suppressed: DataFrame) -> DataFrame:
    """Suppressions of findings alone: rows (fingerprint, ...) without those of source and sink pairs."""
    return suppressed.where(~F.col("fingerprint").startswith(PAIRS))


def split_cached(files: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(files with a stored result that hasn't expired, the others); results: (key, expires_at)."""
    keyed = files.withColumn("key", content_key(F.col("code"), F.col("language")))
    valid = results.where(F.col("expires_at") > now).select("key")
    return keyed.join(valid, "key", "left_semi"), keyed.join(valid, "key", "left_anti")


def page(reviews: DataFrame, offset: int, limit: int) -> DataFrame:
    """Newest reviews first."""
    return reviews.orderBy(F.desc("saved_at"), "review_id").offset(offset).limit(limit)


def installations(events: DataFrame) -> DataFrame:
    """The latest event of each installation, without those removed or suspended; events: (installation_id, ts, action, ...).
    Of events of one time the last by action counts: a removal rather than a creation."""
    rest = [c for c in events.columns if c != "installation_id"]
    latest = events.groupBy("installation_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "action")).alias("e"))
    return latest.select("installation_id", "e.*").where(~F.col("action").isin("deleted", "suspend"))
