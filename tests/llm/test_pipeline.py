"""The pipeline's stages against brute force, each on its own input."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from lintlake.llm import queries

from .test_text_operators import brute_components, brute_hits, edited, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    docs = [(i, prose(rng, rng.randint(20, 60)), "en" if i % 2 else None, f"s{i % 3}", i) for i in range(40)]
    docs += [(100 + i, edited(rng, docs[i][1], 1), "en", "s0", 1) for i in range(10)] + [(200, docs[5][1], "en", None, 1)]
    docs += [(300, None, "en", "s1", 0), (301, "1234 5678", "en", "s1", 0), (302, "", None, "s2", 0)]
    bench = [(1, " ".join(docs[20][1].split()[3:14])), (2, None)]
    docs += [(400, prose(rng, 5) + " " + bench[0][1] + " " + prose(rng, 5), "en", "s2", 1), docs[7]]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), bench


def test_stages_take_effect(spark, tables, tmp_path):
    at, bench = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, at).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns[: len(columns)] == columns
        seen[name] = before, Counter((r["doc_id"], r["text"]) for r in docs.collect())
    before, after = seen["language"]
    assert after == Counter(x for x in before if any(c.isalpha() for c in x[1] or ""))
    before, after = seen["near_duplicates"]
    keep = {i for i, _, root in brute_components(before) if i == root}
    assert Counter(i for i, _ in after.elements()) == Counter(keep)
    before, after = seen["decontamination"]
    assert after == Counter(x for x in before if not brute_hits(x[1], bench)[1])
    assert 20 not in {i for i, _ in after} and 400 not in {i for i, _ in after}
    before, after = seen["mixture"]
    size = lambda rows: sum(len(t.split()) for _, t in rows)
    assert set(after) <= set(before) and max(after.values()) <= 3
    assert size(before) <= size(after.elements()) < size(before) + max(size([x]) for x in before)
    before, after = seen["shards"]
    assert after == Counter(before)
    for s in range(8):
        slots = sorted(r["slot"] for r in docs.where(docs["shard"] == s).collect())
        assert slots == list(range(len(slots)))


def test_names():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(names)


def test_run_drops_what_stages_parked(spark, tables, monkeypatch):
    import os

    from lintlake.llm import _common

    at, _ = tables
    mark = _common.parked()
    corpus_pipeline.run(spark, at).collect()
    left = [f.removeprefix("file://") for f in _common._PARKED[mark:]]
    assert all(os.path.isdir(f) for f in left)
    assert any("mixture" in os.listdir(f) for f in left) and not any({"language", "near_duplicates", "decontamination"} & set(os.listdir(f)) for f in left)
    _common.drop_parked(spark, mark)
    assert not any(os.path.exists(f) for f in left) and _common.parked() == mark

    def fails(spark, docs, sf_dir):
        raise ValueError("stage")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], ("fails", fails), corpus_pipeline.STAGES[4]])
    with pytest.raises(ValueError, match="stage"):
        corpus_pipeline.run(spark, at)
    assert _common.parked() == mark
