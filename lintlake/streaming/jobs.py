"""Structured Streaming jobs: webhook ingest with deduplication, keyed suppression state, review events, event windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lintlake.operators import feedback, pulls, review, rules

_PAYLOAD = "action string, pull_request struct<number:int,head:struct<sha:string>>, repository struct<full_name:string>"


def pull_events(webhooks: DataFrame, wait: str = "1 hour") -> DataFrame:
    """ts, repo, number, sha of review-worthy webhook deliveries (ts, json), each head commit once within `wait`."""
    p = F.from_json("json", _PAYLOAD)
    rows = webhooks.select("ts", p.alias("p")).where(F.col("p.action").isin(*pulls.ACTIONS))
    rows = rows.select("ts", F.col("p.repository.full_name").alias("repo"), F.col("p.pull_request.number").alias("number"), F.col("p.pull_request.head.sha").alias("sha"))
    return rows.withWatermark("ts", wait).dropDuplicatesWithinWatermark(["repo", "number", "sha"]) if rows.isStreaming else rows.dropDuplicates(["repo", "number", "sha"])


_INSTALLED = "action string, installation struct<id:bigint,account:struct<login:string,type:string>>, repositories array<struct<full_name:string>>"
#: The deliveries that an installed app acts on, and what it notes of installations.
APP_EVENTS, INSTALLED = ("installation", "pull_request"), ("created", "deleted", "suspend")


def app_deliveries(deliveries: DataFrame, secret: str) -> DataFrame:
    """deliveries of an app's webhook (ts, event, signature, json) with `status`: rejected (wrong or no signature, or no secret
    is set), accepted, or ignored (an event that isn't acted on)."""
    valid = pulls.signed(F.col("json"), F.col("signature"), secret) if secret else F.lit(False)
    return deliveries.withColumn("status", F.when(~valid, "rejected").when(F.col("event").isin(*APP_EVENTS), "accepted").otherwise("ignored"))


def installation_events(accepted: DataFrame) -> DataFrame:
    """installation_id, ts, action, account_login, account_type, repos of the deliveries that tell of an installation's begin or end;
    an account without name or kind is `unknown`, an id that is missing 0."""
    p = F.from_json("json", _INSTALLED)
    rows = accepted.where(F.col("event") == "installation").select("ts", p.alias("p")).where(F.col("p.action").isin(*INSTALLED))
    known = lambda c: F.coalesce(F.col(f"p.installation.account.{c}"), F.lit("unknown")).alias(f"account_{c}")
    repos = F.transform(F.coalesce("p.repositories", F.expr("cast(array() as array<struct<full_name:string>>)")), lambda r: F.coalesce(r["full_name"], F.lit("")))
    return rows.select(F.coalesce("p.installation.id", F.lit(0)).alias("installation_id"), "ts", F.col("p.action").alias("action"), known("login"), known("type"), repos.alias("repos"))


def app_pull_events(accepted: DataFrame, wait: str = "1 hour") -> DataFrame:
    """pull_events of an app's accepted deliveries; those without owner, name, number or commit aren't acted on."""
    rows = pull_events(accepted.where(F.col("event") == "pull_request"), wait)
    return rows.where(F.col("repo").rlike("^[^/]+/.") & (F.col("number") != 0) & (F.col("sha") != ""))


def review_stream(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Review each micro-batch of files (file_id, language, code) and hand its typed events to `sink`."""

    def run(batch: DataFrame, number: int) -> None:
        sink(review_events(batch), number)

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def review_events(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """review_id, seq, type, payload: start, findings in order, complete; found: the files' findings, if they are known."""
    found = rules.findings(files) if found is None else found
    scores = review.file_scores(files.select("file_id", "language"), found)
    event = lambda seq, kind, payload: [F.col("file_id").alias("review_id"), F.struct(*seq).alias("at"), F.lit(kind).alias("type"), payload.alias("payload")]
    sort = lambda step, *keys: [F.lit(step).alias("step"), *(k.alias(f"k{i}") for i, k in enumerate(keys))]
    none = [F.lit(0), F.lit(0), F.lit("")]
    fields = F.to_json(F.struct("rule_id", "severity", "category", "title", "confidence", "line_start"))
    rows = files.select(*event(sort(0, *none), "agent_start", F.lit("{}"))).unionAll(found.select(*event(sort(1, *review.position()), "finding", fields)))
    rows = rows.unionAll(scores.select(*event(sort(2, *none), "complete", F.to_json(F.struct("score", "summary")))))
    lists = rows.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("at", "type", "payload"))).alias("e"))
    return lists.select("review_id", F.posexplode("e").alias("seq", "e")).select("review_id", "seq", "e.type", "e.payload")


def suppression_stream(events: DataFrame, key: str, hit: Column, last: int = feedback.FINDING_LAST, least: int = feedback.FINDING_LEAST, days: int = feedback.DAYS, late: str = "1 hour") -> DataFrame:
    """key, n_hits, active_until each time a key's last `last` events come to hold `least` hits; state expires with the suppression.

    events: a stream with a timestamp column ts.  The state of a key is its last events' flags and times, bounded, and it
    goes `days` of event time after the last event.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # Events are kept by their time, so one that comes late takes its place among them.
        seen = sorted(zip(state.get[1], state.get[0], strict=True)) if state.exists else []
        for rows in batches:
            times = rows["ts"].astype("datetime64[us]").astype("int64")
            seen = sorted([*seen, *zip(times.tolist(), rows["hit"].astype(bool).tolist(), strict=True)])[-last:]
        state.update(([f for _, f in seen], [t for t, _ in seen]))
        hits = [t for t, f in seen if f]
        state.setTimeoutTimestamp(max(seen[-1][0] // 1000, state.getCurrentWatermarkMs()) + days * 86_400_000)
        if len(hits) >= least:
            yield pd.DataFrame({key: [k[0]], "n_hits": [len(hits)], "active_until": [pd.Timestamp(max(hits), unit="us") + pd.Timedelta(days=days)]})

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, "ts", hit.alias("hit")).withWatermark("ts", late)
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n_hits bigint, active_until timestamp", "flags array<boolean>, times array<bigint>", "update", GroupStateTimeout.EventTimeTimeout)


def feedback_of(findings: DataFrame, feedback_: DataFrame, key: str, within: str, late: str = "1 hour") -> DataFrame:
    """key, ts, feedback_ts and the other columns: feedback (key, ts, ...) on a finding (key, ts, ...) of the same key, from the
    finding's time to `within` after it.

    Of two streams each side waits in the state only as long as a partner can still come: watermarks of `late` on both and
    the bound on the times let Spark drop what is older.  Batches give the same pairs.
    """
    theirs = feedback_.select(F.col(key).alias("__key"), F.col("ts").alias("feedback_ts"), *(c for c in feedback_.columns if c not in (key, "ts")))
    if findings.isStreaming:
        findings, theirs = findings.withWatermark("ts", late), theirs.withWatermark("feedback_ts", late)
    on = (F.col(key) == F.col("__key")) & (F.col("feedback_ts") >= F.col("ts")) & (F.col("feedback_ts") <= F.col("ts") + F.expr(f"interval {within}"))
    return findings.join(theirs, on).drop("__key")


class _LastReports(StatefulProcessor):
    """Per key the last `last` reports as list state, which expires `days` after the last one; a row whenever `least` of them are hits."""

    def __init__(self, key: str, last: int, least: int, days: int):
        self.key, self.last, self.least, self.days = key, last, least, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reports = handle.getListState("reports", "time bigint, hit boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = sorted(self.reports.get()) if self.reports.exists() else []
        for batch in rows:
            times = batch["ts"].astype("datetime64[us]").astype("int64")
            seen = sorted([*map(tuple, seen), *zip(times.tolist(), batch["hit"].astype(bool).tolist(), strict=True)])[-self.last :]
        self.reports.put(seen)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(seen[-1][0] // 1000 + self.days * 86_400_000)
        hits = [t for t, hit in seen if hit]
        if len(hits) >= self.least:
            yield self._row(key[0], "active", len(hits), max(hits))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        hits = [t for t, hit in self.reports.get() if hit]
        self.reports.clear()
        if len(hits) >= self.least:
            yield self._row(key[0], "expired", len(hits), max(hits))

    def _row(self, key, state: str, n: int, latest: int) -> pd.DataFrame:
        until = pd.Timestamp(latest, unit="us") + pd.Timedelta(days=self.days)
        return pd.DataFrame({self.key: [key], "state": [state], "n_hits": [n], "active_until": [until]})

    def close(self) -> None:
        pass


def suppression_states(events: DataFrame, key: str, hit: Column, last: int = feedback.FINDING_LAST, least: int = feedback.FINDING_LEAST, days: int = feedback.DAYS, late: str = "1 hour") -> DataFrame:
    """key, state, n_hits, active_until: `active` whenever a key's last reports come to hold enough hits, `expired` when its state goes.

    The state is a list with an event-time timer, `days` after the key's last report; needs the RocksDB state store.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, "ts", hit.alias("hit")).withWatermark("ts", late)
    out = f"{key} {kind}, state string, n_hits bigint, active_until timestamp"
    return rows.groupBy(key).transformWithStateInPandas(_LastReports(key, last, least, days), out, "Update", "EventTime")


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total of tumbling windows; the same for a batch and a stream of events."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, session_start, n: events of a user no further apart than `gap`."""
    out = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), "n")


def fold_events(events: DataFrame) -> DataFrame:
    """review_id, status, n_findings, score: what a viewer knows after the events (review_id, seq, type, payload)."""
    last = F.max_by("type", "seq")
    score = F.max(F.when(F.col("type") == "complete", F.get_json_object("payload", "$.score").cast("int")))
    return events.groupBy("review_id").agg(last.alias("status"), F.count_if(F.col("type") == "finding").alias("n_findings"), score.alias("score"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a stream to its end into an in-memory table; for tests and small jobs."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A stream over a folder of JSON files, at most `files` a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
