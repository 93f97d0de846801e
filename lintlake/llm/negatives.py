"""Hard-negative mining over one-dimensional distance keys.

Vectors are augmented by one component so that all have the same length; then the inner product with an anchor falls as
the distance to it grows, and the triangle inequality bounds both.  Each vector belongs to its nearest pivot and its key
is (pivot, distance to the pivot).  The index keeps all vectors sorted by key in intervals (`units`): a pivot's distances
are cut at quantiles, and crowded intervals are dealt into parts.  A search scans, at every pivot, the key intervals that
its annulus touches: |distance(anchor, pivot) - key| at most the radius.  The radius grows from round to round until the
bound on what wasn't scanned certifies each anchor's top k; anchors that are certified take no further part.

Two searches make the result: the first k rows of an anchor's own label (positives), then for each of them the first k
rows of other labels whose score lies between `share` percent of the positive's and all of it.  For the second, intervals
too near to hold such scores are left out too.  Scores are exact integers; results are exact, the index only saves work.

Rows with a null id, label or vector, with a null or non-finite component, or whose squared length (components as
floor(scale * x)) is 2^62 or more (scores would leave a long) take no part.  Vectors of unequal length count as filled up
with zeros.  Rows equal in id, label and vector count once; a row is never paired with rows of its own id; ties go to
the smaller id, then label.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintlake.llm._common import park

#: Bounded by parameter: rows that pivots are chosen from, pivots, and intervals a pivot (each known to the driver).
SAMPLE, PIVOTS, CUTS = 4096, 32, 64
#: Rows an interval should hold, rows of a block within it, and anchors that visit an interval in one task.
UNIT, BLOCK, GUESTS = 1 << 16, 1 << 12, 1 << 13
ROW = "vec_id bigint, label bigint, vector binary, pivot int, distance double"


def _matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors kept as bytes of float64, as rows of a matrix of `width` columns."""
    data = vectors.to_pylist()
    if all(len(v) == 8 * width for v in data):
        return np.frombuffer(b"".join(data)).reshape(len(data), width)
    out = np.zeros((len(data), width))
    for i, v in enumerate(data):
        x = np.frombuffer(v)
        out[i, : len(x)] = x
    return out


def _vectors(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """vec_id, label, vector (floor(scale * x) as float64 bytes), width, square: the rows that take part."""
    whole = F.transform(embeddings[vector_col].cast("array<double>"), lambda x: F.lit(scale) * x)
    rows = embeddings.select(embeddings[id_col].cast("bigint").alias("vec_id"), embeddings[label_col].cast("bigint").alias("label"), whole.alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter("vec_id is not null and label is not null and x is not null").filter(finite)

    def packed(batches):
        for b in batches:
            lists = [np.floor(np.asarray(x, float)) + 0.0 for x in b.column(2).to_pylist()]  # no negative zeros
            square = [float(x @ x) for x in lists]
            cols = [b.column(0), b.column(1), pa.array([x.tobytes() for x in lists], pa.binary()), pa.array([len(x) for x in lists], pa.int32()), pa.array(square)]
            batch = pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "vector", "width", "square"])
            yield batch.filter(pa.array(np.array(square) < 2.0**62)) if len(square) else batch

    return rows.mapInArrow(packed, "vec_id bigint, label bigint, vector binary, width int, square double")


class _Space:
    """Pivots in the augmented space, and how far rows and anchors are from them.  Built from a sample; small enough for closures."""

    def __init__(self, sample: np.ndarray, width: int, top: float, k: int):
        self.width, self.top = width, top  # top: the largest squared length of all rows
        points = self.augmented(sample)
        picked = [0]  # farthest first
        least = ((points - points[0]) ** 2).sum(1)
        while len(picked) < min(PIVOTS, len(points)) and least.max() > 0:
            picked.append(int(least.argmax()))
            least = np.minimum(least, ((points - points[picked[-1]]) ** 2).sum(1))
        self.pivots = points[picked]
        kth = [np.sort(((points - p) ** 2).sum(1))[min(k, len(points) - 1)] for p in points[:64]]
        self.radius = float(np.sqrt(np.median(kth)))  # where a search begins

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))]

    def to_pivots(self, points: np.ndarray) -> np.ndarray:
        square = (points**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def distance(self, square: Column, score: Column) -> Column:
        """Of an anchor (augmented by zero) of this squared length to a row of this score."""
        return F.sqrt(F.greatest(F.lit(0.0), square + F.lit(self.top) - 2 * score))

    @property
    def slack(self) -> float:
        """More than what rounding can add to a distance."""
        return 1e-6 * float(np.sqrt(self.top)) + 1e-9


def _keyed(rows: DataFrame, space: _Space) -> DataFrame:
    """Each row with its key; repeats within a batch go at once, so that a row repeated without end stays cheap."""

    def keys(batches):
        for b in batches:
            once = pa.Table.from_batches([b]).group_by(["vec_id", "label", "vector"]).aggregate([])
            for b in once.combine_chunks().to_batches():
                away = space.to_pivots(space.augmented(_matrix(b.column("vector"), space.width)))
                pivot = away.argmin(1)
                cols = [*(b.column(c) for c in ("vec_id", "label", "vector")), pa.array(pivot.astype(np.int32)), pa.array(away[np.arange(len(pivot)), pivot])]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "vector", "pivot", "distance"])

    return rows.select("vec_id", "label", "vector").mapInArrow(keys, ROW)


def _units(keyed: DataFrame, unit: int) -> tuple[DataFrame, DataFrame]:
    """Rows with `cut` and `part`, and the directory: pivot, cut, least, most, parts; at most PIVOTS * CUTS rows."""
    steps = [i / CUTS for i in range(1, CUTS)]
    stats = keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("distance", steps, 10_000).alias("at")).collect()
    bounds = []
    for s in stats:
        cuts = min(CUTS, -(-s["n"] // unit))
        bounds.append((s["pivot"], [float(s["at"][CUTS * i // cuts - 1]) for i in range(1, cuts)]))
    spark = keyed.sparkSession
    known = spark.createDataFrame(bounds, "pivot int, bounds array<double>")
    cut = keyed.join(F.broadcast(known), "pivot").withColumn("cut", F.size(F.filter("bounds", lambda b: b < F.col("distance")))).drop("bounds")
    directory = cut.groupBy("pivot", "cut").agg(F.count("*").alias("n"), F.min("distance").alias("least"), F.max("distance").alias("most")).collect()
    entries = [(d["pivot"], d["cut"], d["least"], d["most"], -(-d["n"] // unit)) for d in directory]
    directory = spark.createDataFrame(entries, "pivot int, cut int, least double, most double, parts int")
    parts = F.broadcast(directory.select("pivot", "cut", "parts"))
    dealt = cut.join(parts, ["pivot", "cut"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts")).cast("int")).drop("parts")
    return dealt, directory


def _index(dealt: DataFrame, block: int) -> DataFrame:
    """Blocks of consecutive rows by (pivot, cut, part, distance), without repeats: least, most, and the rows as arrays."""

    def blocks(batches):
        kept, last = [], None

        def made(rows):
            ids, labels, vectors, away = zip(*rows, strict=True)
            return {"pivot": unit[0], "cut": unit[1], "part": unit[2], "least": away[0], "most": away[-1], "ids": list(ids), "labels": list(labels), "vectors": list(vectors)}

        unit = None
        for b in batches:
            out = []
            for *u, away, vec_id, label, vector in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kept and (u != unit or len(kept) == block):
                    out.append(made(kept))
                    kept = []
                unit, row = u, (vec_id, label, vector, away)
                if (u, row) != last:
                    kept.append(row)
                last = (u, row)
            yield from pa.Table.from_pylist(out, schema).to_batches()
        if kept:
            yield from pa.Table.from_pylist([made(kept)], schema).to_batches()

    fields = "pivot int, cut int, part int, least double, most double, ids array<bigint>, labels array<bigint>, vectors array<binary>"
    long, many = pa.int32(), lambda kind: pa.list_(kind)
    schema = pa.schema([("pivot", long), ("cut", long), ("part", long), ("least", pa.float64()), ("most", pa.float64()), ("ids", many(pa.int64())), ("labels", many(pa.int64())), ("vectors", many(pa.binary()))])
    order = ["pivot", "cut", "part", "distance", "vec_id", "label", "vector"]
    return dealt.select(*order).repartition("pivot", "cut", "part").sortWithinPartitions(*order).mapInArrow(blocks, fields)


FOUND = "anchor_id bigint, anchor bigint, target int, rank int, found_id bigint, found_label bigint, score bigint"


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: as float64 while all sums stay below 2^53, else as 64-bit integers."""
    top = float(np.sqrt((anchors**2).sum(1).max() * (rows**2).sum(1).max()))
    return (anchors @ rows.T).astype(np.int64) if top < 2.0**52 else anchors.astype(np.int64) @ rows.astype(np.int64).T


def _visit(width: int, k: int, same: bool):
    """One interval and some anchors that visit it: each anchor's first k rows for each of its targets (score at least low, at most high)."""

    def visit(guests: pa.Table, blocks: pa.Table) -> pa.Table:
        out = {name: [] for name in [f.split()[0] for f in FOUND.split(", ")]}
        if not len(guests) or not len(blocks):
            return pa.table({n: pa.array(v, pa.int32() if n in ("target", "rank") else pa.int64()) for n, v in out.items()})
        g = {n: guests.column(n).to_pylist() for n in ("anchor_id", "anchor", "label", "targets", "lows", "highs")}
        points = _matrix(guests.column("vector"), width)
        away, before, radius = (np.array(guests.column(c).to_pylist()) for c in ("away", "before", "radius"))
        best: dict[tuple[int, int], list] = {}
        for b in range(len(blocks)):
            block = blocks.slice(b, 1).to_pylist()[0]
            rows, ids, labels = _matrix(pa.array(block["vectors"], pa.binary()), width), np.array(block["ids"]), np.array(block["labels"])
            gap = np.maximum(0, np.maximum(block["least"] - away, away - block["most"]))  # no row of the block is nearer
            near = np.flatnonzero((gap <= radius) & (gap > before))
            for at in range(0, len(near), 512):
                own = near[at : at + 512]
                scores = _scores(points[own], rows)
                for i, line in zip(own.tolist(), scores, strict=True):
                    fits = ((labels == g["label"][i]) == same) & (ids != g["anchor_id"][i])
                    for target, low, high in zip(g["targets"][i], g["lows"][i], g["highs"][i], strict=True):
                        held = best.setdefault((i, target), [])
                        least = held[-1][0] if len(held) == k else -low  # held: (-score, id, label), best first
                        hit = np.flatnonzero(fits & (line >= max(low, -least)) & (line <= high))
                        if len(hit):
                            if len(hit) > k:
                                hit = hit[np.lexsort((labels[hit], ids[hit], -line[hit]))[:k]]
                            best[i, target] = sorted(held + [(-int(line[j]), int(ids[j]), int(labels[j])) for j in hit])[:k]
        for (i, target), held in best.items():
            for rank, (less, found_id, found_label) in enumerate(held):
                for name, value in zip(out, (g["anchor_id"][i], g["anchor"][i], target, rank + 1, found_id, found_label, -less), strict=True):
                    out[name].append(value)
        return pa.table({n: pa.array(v, pa.int32() if n in ("target", "rank") else pa.int64()) for n, v in out.items()})

    return visit


def _search(anchors: DataFrame, index: DataFrame, directory: DataFrame, space: _Space, k: int, same: bool) -> DataFrame:
    """FOUND rows, the first k of each target of each anchor; anchors: anchor_id, anchor, label, vector, square, aways, targets, lows, highs, radius, nearest.

    radius: where the annulus begins to grow; nearest: rows nearer than this can't have a fitting score.
    """
    slots = max(1, -(-anchors.count() // GUESTS))
    guests = anchors.withColumn("slot", F.pmod(F.xxhash64("anchor"), F.lit(slots)).cast("int")).withColumn("before", F.lit(-1.0))
    guests = guests.withColumn("farthest", F.sqrt("square") + space.top**0.5)
    hosts = index.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    top = Window.partitionBy("anchor_id", "anchor", "target").orderBy(F.desc("score"), "found_id", "found_label")
    found = None
    while True:
        each = guests.select("*", F.posexplode("aways").alias("pivot", "away")).join(F.broadcast(directory), "pivot")
        near, far = (f(F.abs(F.col("least") - F.col("away")), F.abs(F.col("most") - F.col("away"))) for f in (F.least, F.greatest))
        gap = F.when(F.col("away").between(F.col("least"), F.col("most")), 0.0).otherwise(near)  # no row of the interval is nearer, by its key
        touched = (gap <= F.col("radius")) & (far > F.col("before")) & (F.col("away") + F.col("most") >= F.col("nearest"))
        each = each.filter(touched).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = ["pivot", "cut", "part", "slot"]
        visits = each.select(*keys, "anchor_id", "anchor", "label", "vector", "away", "before", "radius", "targets", "lows", "highs")
        open_ = hosts.join(visits.select(*keys).distinct(), keys, "left_semi")
        new = visits.groupBy(*keys).cogroup(open_.groupBy(*keys)).applyInArrow(_visit(space.width, k, same), FOUND)
        if found is not None:
            new = new.unionByName(found)
        found = park(new.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k), "found")
        # a target's bound: its k-th score, or its least allowed one while it has fewer
        full = found.filter(F.col("rank") == k).groupBy("anchor_id", "anchor").agg(F.map_from_entries(F.collect_list(F.struct("target", "score"))).alias("kth"))
        kth = lambda t, low: F.coalesce(F.try_element_at("kth", t), low)
        bounds = F.zip_with("targets", "lows", kth)
        left = guests.join(full, ["anchor_id", "anchor"], "left").withColumn("needed", F.least(space.distance(F.col("square"), F.array_min(bounds)), F.col("farthest")) + space.slack)
        left = left.filter(F.col("needed") > F.col("radius"))
        grown = F.least(F.col("needed"), F.greatest(2 * F.col("radius"), F.lit(space.radius), F.lit(space.top**0.5 / 16), F.lit(2 * space.slack)))
        guests = park(left.select(*(c for c in guests.columns if c not in ("radius", "before")), F.col("radius").alias("before"), grown.alias("radius")), "guests")
        if guests.isEmpty():
            return found


def hard_negatives(
    embeddings: DataFrame, anchor: Column, k: int = 5, share: int = 80, scale: float = 256.0, relabel=None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", unit: int = UNIT, block: int = BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for rows where the condition `anchor` (on vec_id) holds.

    relabel: a function from the columns vec_id and label to the label to use.
    """
    rows = _vectors(embeddings, id_col, vector_col, label_col, scale)
    if relabel:
        rows = rows.withColumn("label", relabel(F.col("vec_id"), F.col("label")).cast("bigint"))
    empty = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark = embeddings.sparkSession
    all_ = rows.agg(F.count("*").alias("n"), F.max("width").alias("width"), F.max("square").alias("top")).first()
    if not all_["n"]:
        return spark.createDataFrame([], empty)
    drawn = F.xxhash64("vec_id", "vector")
    sample = rows.select("vector", drawn.alias("drawn")).filter(F.pmod("drawn", F.lit(max(1, all_["n"] // (4 * SAMPLE)))) == 0)
    sample = sample.distinct().orderBy("drawn").limit(SAMPLE).select("vector").toArrow()
    space = _Space(_matrix(sample.column(0), all_["width"]), all_["width"], all_["top"], k)
    keyed = park(_keyed(rows, space), "keyed")
    dealt, directory = _units(keyed, unit)
    index = park(_index(dealt, block), "index")

    def placed(batches):
        for b in batches:
            points = _matrix(b.column(2), space.width)
            aways = space.to_pivots(np.c_[points, np.zeros(len(points))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((points**2).sum(1)), pa.array(list(aways), pa.list_(pa.float64()))], [*b.schema.names, "square", "aways"])

    chosen = keyed.select("vec_id", "label", "vector").filter(anchor).distinct()
    chosen = chosen.mapInArrow(placed, "vec_id bigint, label bigint, vector binary, square double, aways array<double>")
    chosen = park(chosen.withColumnRenamed("vec_id", "anchor_id").withColumn("anchor", F.xxhash64("label", "vector")), "anchors")
    low, high = (F.lit(x).cast("bigint") for x in (-(1 << 62), 1 << 62))
    seekers = chosen.select("*", F.array(F.lit(0)).alias("targets"), F.array(low).alias("lows"), F.array(high).alias("highs"), F.lit(space.radius).alias("radius"), F.lit(0.0).alias("nearest"))
    positives = _search(seekers, index, directory, space, k, True).filter("score >= 0")  # no score lies between 80 % of a negative number and all of it
    least = F.expr(f"(score div 100) * {share} + ((score % 100) * {share} + 99) div 100")
    ends = positives.groupBy("anchor_id", "anchor").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("target"), least.alias("low"), F.col("score").alias("high"), F.col("found_id").alias("id")))).alias("t"))
    asked = chosen.join(ends, ["anchor_id", "anchor"])
    part = lambda name: F.transform("t", lambda t: t[name])
    asked = asked.select("*", part("target").alias("targets"), part("low").alias("lows"), part("high").alias("highs"))
    slack = F.lit(space.slack)
    asked = asked.withColumn("radius", space.distance(F.col("square"), F.array_min("highs")) + slack).withColumn("nearest", space.distance(F.col("square"), F.array_max("highs")) - slack).drop("t")
    negatives = _search(asked, index, directory, space, k, False)
    positives = positives.select("anchor_id", "anchor", F.col("rank").alias("target"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(positives, ["anchor_id", "anchor", "target"]).select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100, against all rows."""
    moved = lambda vec_id, label: F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, relabel=moved)
