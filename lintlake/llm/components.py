"""Connected components of an edge table: spanning forests task by task, then alternating star steps as DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm._common import park

#: A task's forest is handed on when it has so many nodes, so that its memory is bounded.
NODES = 1 << 20


def _forest(edges: DataFrame) -> DataFrame:
    """u, v: for each task's edges, the least node of its component for every other node; stars that join the same nodes."""

    def join(batches):
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def stars() -> pa.RecordBatch:
            found = [(u, v) for u in list(up) if (v := top(u)) != u]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            for u, v in zip(*(batch.column(c).to_pylist() for c in ("u", "v")), strict=True):
                x, y = top(u), top(v)
                up[max(x, y)] = min(x, y)
            if len(up) >= NODES:
                yield stars()
        yield stars()

    return edges.select("u", "v").mapInArrow(join, "u bigint, v bigint")


def _to_least(edges: DataFrame, out: str, keep) -> DataFrame:
    """For each u with neighbours v: edges from the chosen neighbours to the least of u and them.

    The least is aggregated before the join, so a node with very many neighbours meets no single task.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return keep(edges.join(least, "u")).where(F.col(out) != F.col("m")).select(F.col(out).alias("u"), F.col("m").alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_least(both, "v", lambda e: e.where(F.col("v") > F.col("u"))).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, few: int = 1 << 20, most: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node that has an edge; edges: (u, v) of bigint.

    Each task first replaces its edges by a spanning forest.  Up to `few` edges that are left (16 MB) are joined by one
    task; more by star steps, each written to the shared folder, whose number grows with the logarithm of the number of
    nodes.  The result is the same.
    """
    edges = park(_forest(edges), "forest")
    left = edges.count()
    if left <= few:
        edges = park(_forest(edges.coalesce(1)), "components")
        return _labels(edges)
    state = None
    edges = park(edges.distinct(), "edges")
    for _ in range(most):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return _labels(edges)
        state = now
        edges = park(_small_star(_large_star(edges)), "edges")
    raise RuntimeError(f"components did not settle in {most} steps")


def _labels(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
