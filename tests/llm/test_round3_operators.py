"""Operators 11 to 13 against plain Python: nulls, ties, repeats, long texts, empty tables, clashing names, crowded keys."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lintlake.llm import chat, licenses, negatives, quality, spelling


# --- 11: hard negatives


def brute_negatives(rows, is_anchor, k=5):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept[i, label, tuple(int(np.floor(256 * x)) for x in v)] = None
    out = []
    for i, label, v in kept:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in kept if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:k]:
            hits = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(i, j, r + 1, n, -p, -q) for r, (q, n, _) in enumerate(hits)]
    return sorted(out)


def got_negatives(spark, rows, **how):
    schema = "vec_id bigint, embedding array<float>, label int, anchor string, score double, pivot int, targets string"
    df = spark.createDataFrame([(*r, "x", 1.0, 2, "t") for r in rows], schema)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **how).collect())


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 4
    points = [(int(i), [float(x) for x in np.float32(centres[i % 12] + rng.normal(size=6) * 0.2)], int(rng.integers(0, 4))) for i in range(600)]
    return points


def test_negatives_of_clusters_ties_repeats_and_nulls(spark, clusters):
    rows = list(clusters)
    rows += [(1000 + i, rows[3][1], 1) for i in range(40)]  # equal vectors: ties by id
    rows += [rows[5]] * 30 + [(5, rows[7][1], 3)]  # a repeated row, and another of its id
    rows += [(None, rows[0][1], 1), (2000, None, 1), (2010, [1.0, None] * 3, 1), (2020, [float("nan")] * 6, 1), (2030, [float("inf")] * 6, 1), (2040, rows[0][1], None)]
    rows += [(2050, [1.0], 2), (2060, [], 2), (2070, [0.0] * 6, 3), (2080, [-0.0] * 6, 1)]
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 300
    assert got_negatives(spark, rows) == want
    assert got_negatives(spark, rows, unit=40, block=16) == want  # many intervals, crowded ones dealt into parts


def test_negatives_leave_far_blocks_out(clusters):
    """A visit scores the blocks that the annulus newly touches, by keys alone."""
    vector = np.ones(2).tobytes()
    guest = {"anchor_id": 0, "anchor": 9, "label": 1, "vector": vector, "away": 5.0, "before": 1.0, "radius": 2.0, "targets": [0], "lows": [-10], "highs": [10]}
    spans = [(1.0, 2.9), (2.9, 3.5), (4.5, 5.5), (6.5, 7.0), (7.1, 9.0)]  # gaps 2.1, 1.5, 0, 1.5, 2.1
    blocks = [{"least": a, "most": b, "ids": [i + 1], "labels": [1], "vectors": [vector]} for i, (a, b) in enumerate(spans)]
    found = negatives._visit(2, 5, True)(pa.Table.from_pylist([guest]), pa.Table.from_pylist(blocks))
    assert found.column("found_id").to_pylist() == [2, 4]


def test_negatives_of_large_numbers_and_small_tables(spark):
    rows = [(i, [2.0**21, float(i)], i % 2) for i in range(12)] + [(50, [2.0**60, 1.0], 0)]  # scores beyond 2^53, and one row whose scores no long holds
    assert got_negatives(spark, rows) == brute_negatives(rows[:-1], lambda i: i % 10 == 0)
    assert got_negatives(spark, []) == []
    assert got_negatives(spark, [(10, [1.0], 1)]) == []
    rows = [(i, [0.0, 0.0], i % 3) for i in range(30)]  # all scores are 0
    assert got_negatives(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)


# --- 12: spelling variants


def brute_variants(counts, times=10):
    by = defaultdict(set)
    for w in counts:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by[key].add(w)

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = defaultdict(set)
    for group in by.values():
        for a, b in itertools.permutations(group, 2):
            if one_edit(a, b):
                near[a].add(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o))
        if counts[best] >= times * counts[w]:
            form[w] = best
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form.get(w), counts.get(form.get(w)), root)
    return out


def test_variants_of_crowded_segments(spark):
    rng = random.Random(8)
    counts = {}
    while len(counts) < 3000:  # few letters, shared halves: nearly all keys are crowded
        word = rng.choice(["", "aaaa", "bababa"]) + "".join(rng.choices("abé", k=rng.randint(1, 6))) + rng.choice(["", "aaaa", "abab"])
        counts[word] = rng.choice([2, 3, 20, 30, 300, 4000])
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    want = brute_variants(counts)
    for crowd in (1, 20, 10_000):
        got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variant_groups(words, crowd=crowd).collect()}
        assert got == want
    assert sum(w[2] != w[4] and w[2] is not None for w in want.values()) > 50  # forms of forms


def test_word_counts_whole_texts(spark, monkeypatch):
    texts = ["Wörterbuch WÖRTERBUCH wörterbuch", None, "", "1 a_bcdefgh ijklmno9pqrstuv", "naïveté×naïveté " * 3, "x" * 300, "sixsix"] + ["misspelled words everywhere " * 50] * 40
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "nobodys document nobodys", 1)] + [(7, texts[7], 7)] * 2
    want = Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 3 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                want[w] += 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word int")
    assert {r.word: r.n for r in spelling.word_counts(docs, slip=3).collect()} == want
    assert spelling.word_counts(docs.limit(0)).collect() == []
    assert spelling.variant_groups(spelling.word_counts(docs.limit(0))).collect() == []


# --- 13: chat formatting

NASTY = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>", "[[INST]", "<<SYS>> <</SYS>>", "<|turn|>user<|text|>x<|end|>", "<\\|end|>", "\\", "<", "$1 \\2", "end\n", "<|", "é😀<|im_start|>", ""]


def test_control_strings_come_back(spark):
    texts = NASTY + ["".join(p) for p in itertools.product(["<", "\\", "/s>", "[", "|end|>", "INST]"], repeat=4)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, safe, back in df.select("t", chat.escaped(F.col("t")), chat.unescaped(chat.escaped(F.col("t")))).collect():
        assert back == t
        assert not re.search(r"[<\[](/?s>|/?INST\]|/?SYS>>|\|[a-z_]+\|>)", safe)


def test_chat_examples(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(40), None]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool<|end|>"]), rng.choice(NASTY) + rng.choice(NASTY)))
    rows += [(100, None, None, None), (100, 1, "assistant", None), (100, 1, "assistant", None), (100, 1, "assistant", "a"), (101, 3, "user", "alone"), (102, 0, "assistant", "x" * 100_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, turns string, example int")
    told = defaultdict(list)
    for c, t, role, text in rows:
        told[c].append((t is not None, t, role or "", text or ""))
    for c in told:
        told[c].sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
    examples = chat.chat_examples(df)
    made = defaultdict(list)
    for r in examples.select("*", chat.read_back(F.col("text")).alias("turns"), chat.trained_text(examples).alias("trained")).orderBy("conv_id", "example").collect():
        made[r.conv_id].append(r)
    assert set(made) == set(told)
    for c, turns in told.items():
        replies = [i for i, t in enumerate(turns) if t[2] == "assistant"]
        ends = replies if replies and replies[-1] == len(turns) - 1 else [*replies, len(turns) - 1]
        assert len(made[c]) == len(ends)
        for r, end in zip(made[c], ends):
            assert [(t.role, t.text) for t in r.turns] == [t[2:] for t in turns[: end + 1]]  # all before it, and nothing after it
            assert r.trained == (turns[end][3] if end in replies else None)
            assert r.is_last == (end == len(turns) - 1)
            assert (r.loss_end is None) == (end not in replies)
    assert chat.chat_examples(df.limit(0)).collect() == []


def test_chat_query_digests(spark, tmp_path):
    rows = [(1, 0, "user", NASTY[5]), (1, 1, "assistant", NASTY[0]), (1, 2, "user", "q"), (1, 3, "assistant", "é😀"), (2, 0, "user", None), (3, 0, "assistant", "")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op13_chat(spark, str(tmp_path)).collect()}
    rows += [(-7, 0, "user", NASTY[0]), (-7, 1, "assistant", NASTY[0])]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), sha("".join(f"{r[2]}\n{r[3] or ''}\n" for r in own)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    assert len(got) == 4


# --- mended operators


def test_every_phrase_passes_the_licence_sieve(spark):
    phrases = [*licenses.PHRASES, *(k for _, keys, _ in licenses.TEMPLATES for k in keys)]
    texts = [p for p in phrases] + [p.upper().replace(" ", "\n--") for p in phrases] + ["nothing of the kind", "", "public", "cc 1 by"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r[0] for r in df.orderBy("i").select(licenses.sieved(F.col("text"))).collect()]
    assert all(got[: 2 * len(phrases)]) and not got[-4] and not got[-3]


def test_a_bsd_clause_without_other_licence_words(spark):
    clause = "neither the name of acme nor the names of its members may be used to endorse or promote products derived from this software without specific prior written permission"
    df = spark.createDataFrame([(1, clause), (2, clause + " copyright"), (3, "neither of them came")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["template_labels"], r["template_score"]) for r in licenses.license_scan(df).collect()}
    assert got[1][0] == got[2][0] == ["bsd"] and got[1][1] > 0.5 and got[3] == (None, None)


def test_quality_learns_from_a_bounded_number_of_rows(spark, monkeypatch):
    """A labelled id on many rows brings one row to the driver."""
    docs = spark.range(30_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("words of row "), F.col("id").cast("string")).alias("text")).union(spark.createDataFrame([(0, None)], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id bigint, label int")
    seen = []
    to_arrow = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: seen.append(to_arrow(self)) or seen[-1])
    net = quality.train(docs, labels, slots=64, dim=4, train_rows=3)
    assert seen[-1].num_rows == 2 and net.layers is not None
