"""Blocks by hand and against ast; joins by order and stream joins against plain Python and their batch forms."""

import ast
import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lintlake.operators import blocks, temporal
from lintlake.streaming import jobs

NESTED = '''import os

def outer(a, b=(1,
        2)):
    """A text
def not_a_function():
    """
    for x in a:
        while x:
            x -= 1  # if this were code

        else:
            pass
    try:
        inner = [
for_each
        ]
    except ValueError:
        pass
    finally:
        with open("#") as f, \\
                open("b"):
            print("""
    if no: """)

    def within():
        return "it's # no comment"
    class Local:
        async def m(self):
            async for y in self:
                await y
    # the end


if a: b = 1
elif c:
    d = 2
# last
'''


def by_ast(code):
    kinds = {ast.FunctionDef: "def", ast.AsyncFunctionDef: "def", ast.ClassDef: "class", ast.If: "if", ast.For: "for", ast.AsyncFor: "for", ast.While: "while", ast.With: "with", ast.AsyncWith: "with", ast.Try: "try"}
    out = []

    def walk(node, depth, inside, chained=False):
        word = kinds.get(type(node))
        if word and not chained:
            name = getattr(node, "name", None) if word in ("def", "class") else None
            out.append((word, name, node.lineno, node.end_lineno, depth + 1, inside))
            depth, inside = depth + 1, name or inside
        for field, value in ast.iter_fields(node):
            for child in value if isinstance(value, list) else [value]:
                if isinstance(child, ast.AST):
                    # an elif is an if within orelse that begins with its own word
                    own = code.split("\n")[child.lineno - 1].strip() if hasattr(child, "lineno") else ""
                    walk(child, depth, inside, field == "orelse" and isinstance(child, ast.If) and own.startswith("elif"))

    walk(ast.parse(code), 0, None)
    return sorted(out, key=lambda b: b[2])


def got_blocks(spark, codes):
    df = spark.createDataFrame([(i, "python", c) for i, c in enumerate(codes)], "file_id int, language string, code string")
    out = [[] for _ in codes]
    for r in blocks.python_blocks(df).collect():
        out[r.file_id].append((r.word, r.name, r.line_start, r.line_end, r.depth, r.inside))
    return [sorted(x, key=lambda b: b[2]) for x in out]


def test_blocks_by_hand_and_by_ast(spark):
    codes = [NESTED, "", None, "x = 1\n", "def f(): return 1\nclass A: pass", "for x in y:\n\n\n    pass\n\n\n", "'''\nif a:\n    b\n'''\n", "def f():\n    return (\n1)\nx"]
    got = got_blocks(spark, codes)
    assert [b[:4] for b in got[0]] == [
        ("def", "outer", 3, 31), ("for", None, 8, 13), ("while", None, 9, 13), ("try", None, 14, 24), ("with", None, 21, 24), ("def", "within", 26, 27),
        ("class", "Local", 28, 31), ("def", "m", 29, 31), ("for", None, 30, 31), ("if", None, 35, 37),
    ]
    for code, found in zip(codes, got):
        if code:
            assert found == by_ast(code)
    assert got[1] == got[2] == got[6] == []


def test_blocks_of_random_programs(spark):
    rng = random.Random(12)

    def body(depth):
        lines = []
        for _ in range(rng.randint(1, 3)):
            pad = "    " * depth
            kind = rng.choice(["x", "x", "if", "for", "def", "class", "try", "with", "call"]) if depth < 5 else "x"
            if kind == "x":
                lines += [pad + rng.choice(["a = 1", "b = 'if x:'", "c = [1, 2]  # for", '"""t\n  u"""'])]
            elif kind == "call":
                lines += [pad + "f(", "1,", pad + "  'x')"]
            else:
                head = {"if": "if a:", "for": "for i in b:", "def": f"def f{rng.randint(0, 9)}(a):", "class": f"class C{rng.randint(0, 9)}:", "try": "try:", "with": "with a as b:"}[kind]
                lines += [pad + head, *body(depth + 1)]
                if kind == "try":
                    lines += [pad + "except E:", *body(depth + 1)]
                elif kind == "if" and rng.random() < 0.5:
                    lines += [pad + "elif b:", *body(depth + 1), pad + "else:", *body(depth + 1)]
            if rng.random() < 0.3:
                lines += rng.choice([[""], ["# note"], ["   "]])
        return lines

    codes = ["\n".join(body(0)) + "\n" for _ in range(60)]
    for code, found in zip(codes, got_blocks(spark, codes)):
        assert found == by_ast(code)


def test_asof_join(spark):
    rng = random.Random(4)
    left = [(rng.choice(["a", "b", "hot", None]), rng.choice([None, *range(0, 1000, 7)]), i) for i in range(300)]
    right = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(0, 1000, 13)]), f"v{i}", i) for i in range(200)]
    l, r = spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame(right, "k string, t int, v string, o int")
    want = []
    for k, t, i in left:
        held = [x for x in right if x[0] == k and k is not None and t is not None and x[1] is not None and x[1] <= t]
        want.append((i, max(held, key=lambda x: (x[1], x[3]))[2] if held else None))
    for width in (10, 100, 1e9):
        assert sorted((x.id, x.v) for x in temporal.asof_join(l, r, "k", "t", ["v"], width, "o").collect()) == sorted(want)
    assert temporal.asof_join(l.limit(0), r, "k", "t", ["v"], 10, "o").collect() == []
    assert {x.v for x in temporal.asof_join(l, r.limit(0), "k", "t", ["v"], 10, "o").collect()} == {None}


def test_ranges(spark):
    rng = random.Random(6)
    points = [(rng.choice([1, 2, None]), rng.choice([None, *range(-50, 200)]), i) for i in range(300)]
    ranges = [(rng.choice([1, 2, None]), a := rng.randint(-60, 200), rng.choice([a + rng.randint(-3, 90), None])) for _ in range(60)] + [(1, 5, 5)] * 2
    p, r = spark.createDataFrame(points, "file_id int, line_start int, i int"), spark.createDataFrame(ranges, "file_id int, first int, last int")
    want = sorted((i, a, b) for k, x, i in points for own, a, b in ranges if own == k and k and x is not None and b is not None and a <= x <= b)
    for width in (1, 16, 1000):
        hits = temporal.in_ranges(p, r, "file_id", F.col("line_start"), F.col("first"), F.col("last"), width)
        assert sorted((x.i, x.first, x.last) for x in hits.collect()) == want
    assert sorted(x.i for x in temporal.changed_findings(p, r).collect()) == sorted({i for i, _, _ in want})


T0 = dt.datetime(2024, 1, 1)


def feed(spark, tmp_path, name, schema, batches):
    """A stream that reads one file a micro-batch, in order."""
    folder = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/*")


def test_stream_join_equals_batch_and_drops_the_late(spark, tmp_path):
    rng = random.Random(7)
    at = lambda h: T0 + dt.timedelta(hours=h)
    findings = [[(f"k{rng.randint(0, 4)}", at(h + rng.random()), i * 100 + h) for h in range(i * 5, i * 5 + 5)] for i in range(4)]
    replies = [[(f"k{rng.randint(0, 4)}", at(h + rng.random()), i * 100 + h) for h in range(i * 5, i * 5 + 5)] for i in range(4)]
    a, b = "k string, ts timestamp, finding_id int", "k string, ts timestamp, feedback_id int"
    all_ = jobs.feedback_of(spark.createDataFrame(sum(findings, []), a), spark.createDataFrame(sum(replies, []), b), "k", "6 hours")
    stream = jobs.feedback_of(feed(spark, tmp_path, "f", a, findings), feed(spark, tmp_path, "r", b, replies), "k", "6 hours", late="12 hours")
    got = jobs.run_to_table(stream, "joined")
    want = sorted(map(tuple, all_.collect()))
    assert want and sorted(map(tuple, got.collect())) == want
    # A reply that comes when its finding is long out of the state finds no partner; a batch would pair them.
    f, r = [[("k", at(0), 1)], [("x", at(100), 2)], [("x", at(101), 3)], [("x", at(102), 4)]], [[("x", at(0), 0)], [("x", at(100), 5)], [("x", at(100.5), 6)], [("k", at(1), 7)]]
    late = jobs.run_to_table(jobs.feedback_of(feed(spark, tmp_path, "f2", a, f), feed(spark, tmp_path, "r2", b, r), "k", "6 hours"), "late_joined")
    assert 7 not in {x.feedback_id for x in late.collect()}


def test_states_expire(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        day = lambda d: T0 + dt.timedelta(days=d)
        schema = "key string, ts timestamp, bad boolean"
        batches = [
            [("a", day(0), True), ("a", day(1), True), ("b", day(0), False)],
            [("a", day(2), True), ("b", day(2), True), ("a", day(0.5), False)],  # the third hit; one comes late, but in time
            [("c", day(40), True)],  # a and b expire
            [("c", day(41), False)],
            [("a", day(42), True)],  # counts from nothing
        ]
        stream = jobs.suppression_states(feed(spark, tmp_path, "e", schema, batches), "key", F.col("bad"), last=4, least=3, days=30, late="2 days")
        rows = [tuple(r) for r in jobs.run_to_table(stream, "states", "update").collect()]
        assert rows == [("a", "active", 3, day(32)), ("a", "expired", 3, day(32))]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
