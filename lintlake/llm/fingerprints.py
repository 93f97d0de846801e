"""Document fingerprints by a homomorphic multiset hash [native].

A paragraph (a line) is hashed to a wide vector and a text's fingerprint is the sum of its paragraphs' vectors, modulo
powers of two.  Sums don't depend on the order of paragraphs, and a paragraph can be added to or taken from a
fingerprint without the rest of the text.  The vector has two parts:

- `lanes` (16 lanes modulo 2**32, from SHA-512 of the paragraph) decide equality;
- `sketch` (120 lanes modulo 2**31, packed two to a number) counts, for each of 60 bits of two 64-bit hashes, the
  paragraph's pieces of up to eight words that have the bit; `pieces` is their number.  No text has 2**31 pieces, as it
  has fewer bytes, so no lane wraps.  The cosine between two centred
  sketches estimates how much of the texts is shared: the likeness, 1 for equal fingerprints, about 0 for unrelated.

Nulls count as empty texts (one empty paragraph, no piece); two empty texts are alike (1), an empty one and another are
not (0).  A null id sorts first; repeated rows follow one another; a lone document is its own next.  An empty table
gives no rows; other columns are ignored; texts are hashed whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm._common import id_and_text, long_array, park, range_of

LANES, WIDTH, PER, SHIFTS, SEEDS = 16, 31, 2, 30, (3, 7)
LANE_MASK = (1 << 32) - 1
#: Bits j and j + 31 of a hash, once shifted right by j.
PACK = 1 | 1 << WIDTH
SUM_MASK = (1 << PER * WIDTH) - 1
PIECE = r"\S+(?:[ \t]+\S+){0,7}"
MIN_KEY = -(1 << 63)


def add_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add column `out`: struct(lanes array<bigint>, pieces bigint, sketch array<bigint>) of a non-null text."""
    sha, hashes = f"__{out}_sha", f"__{out}_hash"
    df = df.withColumns({
        sha: F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 512)),
        hashes: F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.struct(*(F.xxhash64(p, F.lit(s)).alias(f"h{s}") for s in SEEDS))),
    })
    zero = F.lit(0).cast("bigint")

    def lane(i: int) -> Column:
        part = lambda h: F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")
        return F.aggregate(sha, zero, lambda acc, h: (acc + part(h)).bitwiseAND(F.lit(LANE_MASK)))

    def packed(seed: int, j: int) -> Column:
        bits = lambda h: F.shiftright(h[f"h{seed}"], j).bitwiseAND(F.lit(PACK))
        return F.aggregate(hashes, zero, lambda acc, h: (acc + bits(h)).bitwiseAND(F.lit(SUM_MASK)))

    made = F.struct(
        F.array(*(lane(i) for i in range(LANES))).alias("lanes"),
        F.size(hashes).cast("bigint").alias("pieces"),
        F.array(*(packed(s, j) for s in SEEDS for j in range(SHIFTS))).alias("sketch"),
    )
    return df.withColumn(out, made).drop(sha, hashes)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of a's paragraphs with b's inserted (sign 1) or deleted (sign -1)."""
    mod = lambda x, mask: F.when(x < 0, x + F.lit(mask) + 1).otherwise(x).bitwiseAND(F.lit(mask))
    return F.struct(
        F.zip_with(a["lanes"], b["lanes"], lambda x, y: mod(x + sign * y, LANE_MASK)).alias("lanes"),
        (a["pieces"] + sign * b["pieces"]).alias("pieces"),
        F.zip_with(a["sketch"], b["sketch"], lambda x, y: mod(x + sign * y, SUM_MASK)).alias("sketch"),
    )


def as_text(fp: Column) -> Column:
    """Hex digits of a fingerprint; equal texts, and texts of the same paragraphs in any order, give the same."""
    width = lambda xs, n: F.array_join(F.transform(xs, lambda x: F.lpad(F.lower(F.hex(x)), n, "0")), "")
    return F.concat(width(fp["lanes"], 8), F.lpad(F.lower(F.hex(fp["pieces"])), 8, "0"), width(fp["sketch"], 16))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the centred sketches, at least 0."""

    def lanes(fp: Column) -> Column:
        part = lambda x, k: (2 * F.shiftright(x, k * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)) - fp["pieces"]).cast("double")
        return F.flatten(F.transform(fp["sketch"], lambda x: F.array(*(part(x, k) for k in range(PER)))))

    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    both = F.transform(F.array(F.struct(lanes(a).alias("x"), lanes(b).alias("y"))), lambda s: F.struct(dot(s["x"], s["y"]).alias("xy"), (dot(s["x"], s["x"]) * dot(s["y"], s["y"])).alias("n")))
    value = F.transform(both, lambda s: F.when(s["n"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["xy"] / F.sqrt(s["n"])))).otherwise(F.lit(0.0)))
    same = (a["sketch"] == b["sketch"]) & (a["pieces"] == b["pieces"])
    return F.when(same, F.lit(1.0)).otherwise(F.element_at(value, 1))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, fingerprint, one row per row of docs."""
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return add_fingerprint(rows, "text", "fingerprint")


#: There are at most about so many blocks, and as many ids, or texts of an id, with a block's number of rows.
BLOCKS = 1 << 16


def with_next(rows: DataFrame, block_rows: int = 500) -> DataFrame:
    """Add next_text, next_fingerprint: those of the next row by doc_id (then by the text's hash); the last row's are the first's.

    Rows are dealt by doc_id into blocks cut at approximate quantiles; the first rows of a block are also sent to the
    block before, so that each block finds its rows' next ones alone.  Text moves once, whatever the number of rows.  An id
    with over a block's number of rows (as null may be) has blocks of its own, by ranges of the text's hash; rows of such an
    id that are also equal in text are each other's next, so one of them stands for all.
    """
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(MIN_KEY)))
    ids = rows.select("key")
    least, n = ids.agg(F.min("key"), F.count("*")).first()
    target = max(block_rows, math.ceil((n or 0) / BLOCKS))
    blocks = math.ceil((n or 0) / target)
    bounds = []
    if blocks > 1:
        cuts = F.array(*(F.lit(i / blocks) for i in range(1, blocks)))
        bounds = ids.agg(F.percentile_approx("key", cuts, F.lit(max(10_000, 4 * blocks)))).first()[0]
    bounds = sorted({least if least is not None else 0, *bounds})
    hot = {r["key"]: r["n"] for r in ids.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > target).collect()} if blocks > 1 else {}
    order = ["place.ahead", "key", F.xxhash64("text")]
    if hot:
        rows, alike = _spread(rows, hot, bounds, target)
        found = _led(rows, Window.partitionBy("place.block", "place.sub").orderBy(*order))
        return found.unionByName(alike)
    own = F.col("block")
    rows = rows.withColumn("block", range_of(F.col("key"), bounds) - 1)
    first = F.col("key") == F.get(long_array(bounds), own)
    before = F.when(own == 0, F.lit(len(bounds) - 1)).otherwise(own - 1)
    places = F.array(F.struct(own.alias("block"), F.lit(0).alias("ahead")), F.when(first, F.struct(before.alias("block"), F.lit(1).alias("ahead"))))
    rows = rows.withColumn("place", F.explode(F.filter(places, lambda p: p.isNotNull()))).drop("block")
    return _led(rows, Window.partitionBy("place.block").orderBy(*order))


def _led(rows: DataFrame, order) -> DataFrame:
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)})
    return rows.where(F.col("place.ahead") == 0).drop("place", "key")


def _spread(rows: DataFrame, hot: dict[int, int], bounds: list[int], target: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their places, rows whose next is their like): ids of `hot` get blocks of their own, cut by the text's hash."""
    bounds = sorted({*bounds, *hot, *(k + 1 for k in hot if k < (1 << 63) - 1)})
    block = range_of(F.col("key"), bounds) - 1
    pieces = F.get(long_array([math.ceil(hot.get(b, 0) / target) or 1 for b in bounds]), F.col("block"))
    sub = F.least(pieces - 1, F.floor((F.col("th") / F.lit(2.0**64) + 0.5) * pieces))
    rows = rows.withColumn("th", F.xxhash64("text")).withColumn("block", block).withColumn("sub", sub)
    # Equal texts of a hot id, if they are as many: at most BLOCKS groups.
    groups = rows.where(pieces > 1).groupBy("key", "th").agg(F.count("*").alias("n")).where(F.col("n") > target)
    groups = F.broadcast(park(groups, "alike"))
    one = rows.join(groups, ["key", "th"]).groupBy("key", "th", "block", "sub").agg(*(F.first(c).alias(c) for c in ("doc_id", "text", "fingerprint", "n")))
    one = park(one, "ones")
    alike = one.withColumn("i", F.explode(F.sequence(F.lit(2), F.col("n")))).select("doc_id", "text", "fingerprint", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    # A row a block: few enough for one task to put in order, and for a broadcast.
    firsts = rows.groupBy("block", "sub").agg(F.min(F.struct("key", "th")).alias("first"))
    around = Window.orderBy("block", "sub")
    last = Window.orderBy(F.desc("block"), F.desc("sub"))
    here = F.struct("block", "sub")
    firsts = firsts.withColumn("before", F.coalesce(F.lag(here).over(around), F.first(here).over(last)))
    rows = rows.join(groups, ["key", "th"], "left_anti").unionByName(one.drop("n"))
    rows = rows.join(F.broadcast(park(firsts, "firsts")), ["block", "sub"])
    place = lambda b, c, ahead: F.struct(b.alias("block"), c.alias("sub"), F.lit(ahead).alias("ahead"))
    ahead = F.when(F.struct("key", "th") == F.col("first"), place(F.col("before.block"), F.col("before.sub"), 1))
    places = F.filter(F.array(place(F.col("block"), F.col("sub"), 0), ahead), lambda p: p.isNotNull())
    return rows.withColumn("place", F.explode(places)).drop("block", "sub", "th", "first", "before"), alike


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    rows = with_next(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = add_fingerprint(rows, "edited", "edited_fp")
    rows = rows.withColumnsRenamed({"fingerprint": "own_fp", "next_fingerprint": "next_fp"})
    return rows.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own_fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("own_fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("own_fp"), F.col("next_fp")).alias("near_next"),
    )
