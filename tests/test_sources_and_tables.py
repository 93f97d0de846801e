"""Paged pull-request files, tables overwritten by key, bounded concurrent calls."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lintlake.operators import agents, keyed, metrics
from lintlake.sources.pulls import PullFiles, PullReader


@pytest.fixture
def pages(tmp_path):
    at = tmp_path / "o" / "r" / "7"
    at.mkdir(parents=True)
    files = [{"filename": f"f{i}.py", "status": "added", "changes": i} for i in range(250)]
    for p in range(3):
        (at / f"{p + 1}.json").write_text(json.dumps(files[100 * p : 100 * p + 100]))
    return str(tmp_path)


def test_pull_files_by_page(spark, pages):
    spark.dataSource.register(PullFiles)
    read = lambda **more: spark.read.format("pull_files").options(owner="o", repo="r", folder=pages, **more).load()
    for more in ({"changed_files": 250}, {}, {"changed_files": 1000}):  # planned, unknown, and more than there are
        rows = read(number=7, **more)
        assert sorted((r.page, r.filename) for r in rows.collect()) == sorted((i // 100 + 1, f"f{i}.py") for i in range(250))
    assert read(number=7, changed_files=250).rdd.getNumPartitions() == 3
    assert read(number=8).collect() == [] and read(number=8, changed_files=0).collect() == []
    row = read(number=7).where("filename = 'f3.py'").first()
    assert (row.changes, row.patch) == (3, None)
    asked = []
    reader = PullReader({"owner": "o", "repo": "r", "number": "7", "per_page": "2"})
    reader._fetch = lambda: lambda owner, repo, number, page, per_page: asked.append(page) or [{}] * (2 if page < 3 else 1)
    assert len(list(reader.read(reader.partitions()[0]))) == 5 and asked == [1, 2, 3]  # a short page ends it


def test_tables_by_key(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, part int, v int, ts int"
    keyed.create(spark, path, schema, buckets=8)
    put = lambda number, rows: keyed.apply_batch(spark.createDataFrame(rows, schema), path, ["k", "part"], number, "ts")
    got = lambda: sorted((r.k or "", r.part, r.v) for r in keyed.read(spark, path).collect())
    assert got() == []
    assert put(0, [("a", 1, 1, 1), ("a", 1, 2, 2), ("b", 1, 9, 1), (None, 1, 5, 1)])
    assert got() == [("", 1, 5), ("a", 1, 2), ("b", 1, 9)]
    assert put(1, [("a", 1, 7, 0), ("a", 2, 8, 0), (None, 1, 6, 0)])
    want = [("", 1, 6), ("a", 1, 7), ("a", 2, 8), ("b", 1, 9)]
    assert got() == want
    assert not put(1, [("a", 1, 100, 9)]) and not put(0, [("b", 1, 100, 9)])  # replays change nothing
    assert got() == want
    # A batch that died before its entry in the ledger shows nothing, and goes through when it comes again.
    spark.createDataFrame([("b", 1, -1, 1)], schema).withColumn("bucket", F.lit(3)).write.partitionBy("bucket").parquet(f"{path}/data/version=2")
    assert got() == want
    assert put(2, [("b", 1, 10, 1)]) and got() == want[:-1] + [("b", 1, 10)]
    assert put(3, []) and got() == want[:-1] + [("b", 1, 10)]


def test_stream_into_table_replayed(spark, tmp_path):
    path, schema, source = str(tmp_path / "t"), "k int, v int", str(tmp_path / "in")
    keyed.create(spark, path, schema, buckets=4)
    spark.createDataFrame([(i % 10, i) for i in range(50)], schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    keyed.upsert_stream(stream, path, ["k"], str(tmp_path / "c1"), "v").awaitTermination()
    want = sorted((i % 10, i) for i in range(40, 50))
    assert sorted(map(tuple, keyed.read(spark, path).collect())) == want
    # The same batches with a lost checkpoint: their numbers are in the ledger.
    spark.createDataFrame([(0, 1000)], schema).write.mode("append").parquet(source)
    keyed.upsert_stream(stream, path, ["k"], str(tmp_path / "c2"), "v").awaitTermination()
    assert sorted(map(tuple, keyed.read(spark, path).collect())) == want


def test_calls_in_flight_are_bounded(spark):
    def call(prompt):
        state = call.__dict__
        state["now"] = state.get("now", 0) + 1
        state["most"] = max(state.get("most", 0), state["now"])
        time.sleep(0.02 * (int(prompt) % 3))
        state["now"] -= 1
        if int(prompt) % 7 == 0:
            raise ValueError
        return f"{prompt}:{state['most']}"

    rows = spark.createDataFrame([(i, None if i == 5 else str(i)) for i in range(40)], "i int, prompt string").coalesce(1)
    got = {r.i: r.answer for r in agents.concurrent(call, 4)(rows).collect()}
    assert all(got[i] is None for i in range(40) if i % 7 == 0 or i == 5)
    answers = {i: a.split(":") for i, a in got.items() if a}
    assert all(int(a[0]) == i for i, a in answers.items())  # in order
    assert 1 < max(int(a[1]) for a in answers.values()) <= 4
    assert agents.concurrent(call, 2, tasks=1)(rows.repartition(8)).rdd.getNumPartitions() == 1


def test_histograms_merge_and_listen(spark, tmp_path):
    values = [None, 0.0, 0.005, 0.006, 1.0, 9.0, 11.0, 11.5]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "k string, v double")
    got = {(r.k, r.le): r.n for r in metrics.histogram(df, F.col("v"), ["k"]).collect()}
    assert got == {("a", 0.005): 2, ("a", 0.01): 1, ("a", 1.0): 1, ("a", 10.0): 1, ("a", float("inf")): 2}
    parts = [metrics.histogram(spark.createDataFrame([("a", v) for v in vs], "k string, v double"), F.col("v"), ["k"]) for vs in (values[:4], values[4:])]
    assert {(r.k, r.le): r.n for r in metrics.merged(*parts).collect()} == got
    q = lambda x: metrics.quantile(metrics.merged(*parts), ["k"], x).first()["quantile"]
    assert (q(0.2), q(0.5), q(0.7), q(1.0)) == (0.005, 1.0, 10.0, float("inf"))
    listener = metrics.BatchTimes()
    spark.streams.addListener(listener)
    try:
        spark.range(7).write.parquet(str(tmp_path / "in"))
        query = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if listener.rows == 7 and not listener.running:
                break
            time.sleep(0.1)
        assert (listener.rows, listener.running) == (7, 0) and sum(r.n for r in listener.table(spark).collect()) >= 1
    finally:
        spark.streams.removeListener(listener)
