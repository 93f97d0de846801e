"""Rows that are equal in all columns, however many; the mix's order of finish by brute force; profiles learned in parts."""

import functools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lintlake.llm import _common, language, mixing, sharding

WORDS = "river stone garden window letter morning paper silver bridge candle forest winter market harbour".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def kept_parked(monkeypatch, module):
    """What the module parks, by name."""
    placed, park = {}, module.park
    monkeypatch.setattr(module, "park", lambda df, name: placed.setdefault(name, park(df, name)))
    return placed


def test_equal_rows_are_numbered(spark):
    rows = [(1, "a")] * 10 + [(None, None)] * 9 + [(2, "b")]
    df = spark.createDataFrame(rows, "i int, t string")
    for parts in (1, 4):
        got = Counter((r["i"], r["t"], r["copy"]) for r in _common.numbered(df.repartition(parts), "n", block=4).collect())
        assert got == Counter([(1, "a", k) for k in range(10)] + [(None, None, k) for k in range(9)] + [(2, "b", 0)])
    assert [r["copy"] for r in _common.numbered(df.distinct(), "n").collect()] == [0, 0, 0]
    assert _common.numbered(df.limit(0), "n").count() == 0


def test_equal_rows_are_dealt_over_shards(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(7, "the same row", "s")] * 3000 + [(100 + i, prose(rng, 6), "s") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    placed = kept_parked(monkeypatch, sharding)
    out = sharding.shard(docs, 8, range_rows=100).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    assert max(Counter((r["part"], r["sub"]) for r in placed["placed"].collect()).values()) < 400
    size = Counter()
    for r in out:
        size[r["shard"]] += r["size"]
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 8
    for s in size:
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    again = sharding.shard(docs.repartition(7), 8, range_rows=100).collect()
    key = lambda r: (r["doc_id"], r["rh"], r["shard"], r["slot"])
    assert Counter(map(key, out)) == Counter(map(key, again))


def test_equal_rows_are_dealt_over_blocks_of_the_mix(spark, monkeypatch):
    docs = spark.createDataFrame([(7, "the same row", "s")] * 4000 + [(i, "an other one", "t") for i in range(500)], "doc_id bigint, text string, source string")
    placed = kept_parked(monkeypatch, mixing)
    out = mixing.mix(docs, block_rows=50)
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([7] * 4000 + list(range(500)))
    assert max(Counter((r["source"], r["block"]) for r in placed["queued"].collect()).values()) < 200
    total = sum(r["size"] for r in rows)
    assert total <= sum(r["taken"] for r in rows) < total + 3
    again = Counter((r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(9), block_rows=50).collect())
    assert again == Counter((r["doc_id"], r["taken"]) for r in rows)


@pytest.mark.parametrize("most", [1, 1 << 18])
def test_order_of_finish(spark, monkeypatch, most):
    """Cumulative words, finish times, the order and its end, each worked out plainly."""
    rng = random.Random(5)
    rows = [(i if i % 9 else None, prose(rng, rng.choice([1, 5, 40])) if i % 13 else None, rng.choice(["a", "a", "a", "b", None])) for i in range(400)]
    rows += [rows[5]] * 30 + [(10_000 + i, prose(rng, 3), "d") for i in range(5)]
    placed = kept_parked(monkeypatch, mixing)
    monkeypatch.setattr(mixing, "_cut", functools.partial(mixing._cut, most=most))
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), block_rows=20).collect()
    finish = placed["finish"].collect()
    queues = defaultdict(list)
    for r in finish:
        queues[r["source"]].append(r)
    assert Counter(r["source"] for r in finish) == Counter(r[2] for r in rows)
    for queue in queues.values():
        upto = 0
        for r in sorted(queue, key=lambda r: r["turn"]):
            upto += r["size"]
            assert r["words"] == upto
        assert upto == queue[0]["source_size"]
    copies = sorted(((e * r["source_size"] + r["words"]) / r["target"], r["turn"], -(1 << 63) if r["doc_id"] is None else r["doc_id"], r["words"], r["size"], r["rh"]) for r in finish if r["size"] for e in range(3))
    budget, taken = sum(r["size"] for r in finish), Counter()
    for *_, size, rh in copies:
        if budget <= 0:
            break
        budget -= size
        taken[rh] += size
    got = Counter()
    for r in out:
        got[r["rh"]] += r["taken"]
    assert +got == taken


def test_profiles_do_not_depend_on_when_counts_are_handed_on(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(prose(rng, 30), "en") for _ in range(20)] + [("".join(chr(rng.randint(0x4E00, 0x6000)) for _ in range(300)), "zh") for _ in range(20)] + [(None, "en"), ("", "zh"), ("x y z", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    whole = language.learn_profiles(docs)
    monkeypatch.setattr(language, "HELD", 40)
    parts = language.learn_profiles(docs)
    assert whole.langs == parts.langs and np.array_equal(whole.codes, parts.codes) and np.array_equal(whole.ranks, parts.ranks)
