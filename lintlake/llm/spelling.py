"""Spelling variant grouping: words one edit apart, found by an even-partition pigeonhole join.

A word of length l is cut evenly into two segments.  Of two words one edit apart, the shorter (or either, if equally
long) keeps one of its segments whole in the other: the first at the same place, the second at the same distance from
the end, which in a word one longer is one place on.  So each word is indexed by its two segments, and probes with its
own two and with those that a word one shorter would have.  Words that share a key are candidates; levenshtein verifies
them in the join's condition, so no candidate pair is ever written.

A key that many words share (`crowd`) is cut again: what is left between the shared start and end is halved, and one of
the halves must be whole too.  This goes on until keys are light or one character is left open, which is exact: the
last keys hold as many words as there are letters.  A pair that agrees in both halves is taken at the first only.

A variant's form is its most frequent neighbour where that one is ten times as frequent; forms of forms lead to a root.

Null and empty texts have no words; a null id counts as an empty one; repeated rows are counted one by one; ties go to
the smaller word by code points; an empty table gives no words; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm._bytes import CASE
from lintlake.llm._common import park

WORD = "[A-Za-zÀ-ÿ]"
#: A task's table of words is emitted at so many.
HELD = 1 << 18
#: Texts from this length on are read word by word, not as one list.
LONG = 1 << 20


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, slip: int | None = None) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, of at least `least` code points, with their numbers of occurrences.

    slip: where it divides h, the crc32 of `id:run`, the run loses its code point h % length (planted misspellings).
    """
    found = re.compile(rf"{WORD}{{{least},}}")

    def counted(batches):
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = (text.as_py() or "").encode().translate(CASE).decode()
                words = found.findall(text) if len(text) < LONG else (m[0] for m in found.finditer(text))
                own = Counter(words)
                for word, n in own.items():
                    if slip and (h := zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())) % slip == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield _batch(held)
                    held.clear()
        yield _batch(held)

    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return texts.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _batch(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def _key(word: Column) -> list[Column]:
    """The columns of a key: `short` is the length of the shorter word, `head` and `tail` the shared characters at either end."""
    key = F.xxhash64("short", "head", "tail", F.left(word, F.col("head")), F.right(word, F.col("tail")))
    return [F.col(c) for c in ("word", "n", "size", "short", "head", "tail", "apart")] + [key.alias("key")]


def _first_keys(words: DataFrame) -> DataFrame:
    """Two keys of each word as it is, two as one longer than its partner; `apart`: length of a prefix that must differ (-1: none), so that no pair is met twice."""

    def keys(short: Column) -> list[Column]:
        half = F.floor(short / 2).cast("int")
        zero = F.lit(0)
        return [F.struct(short.alias("short"), a.alias("head"), b.alias("tail"), c.alias("apart")) for a, b, c in ((half, zero, F.lit(-1)), (zero, short - half, half))]

    sized = words.select("word", "n", F.length("word").alias("size"))
    each = sized.select("*", F.explode(F.array(*keys(F.col("size")), *keys(F.col("size") - 1))).alias("k"))
    return each.select("word", "n", "size", "k.*").select(*_key(F.col("word")))


def _next_keys(keys: DataFrame) -> DataFrame:
    """Each key's two finer ones: the open middle of the shorter word is halved."""
    half = F.floor((F.col("short") - F.col("head") - F.col("tail")) / 2).cast("int")
    rest = F.col("short") - F.col("head") - F.col("tail") - half
    first = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"), F.col("apart").alias("apart"))
    second = F.struct(F.col("head").alias("head"), (F.col("tail") + rest).alias("tail"), (F.col("head") + half).alias("apart"))
    each = keys.select("word", "n", "size", "short", F.explode(F.array(first, second)).alias("k"))
    return each.select("word", "n", "size", "short", "k.*").select(*_key(F.col("word")))


def near_pairs(words: DataFrame, crowd: int = 64) -> DataFrame:
    """x, x_n, y, y_n: all pairs of distinct words (word, n) that are one inserted, deleted or replaced code point apart, each pair once."""
    keys, light = _first_keys(words), []
    while True:
        crowded = keys.groupBy("key").agg(F.count("*").alias("many")).filter(F.col("many") > crowd)
        parted = park(keys.join(crowded, "key", "left"), "keys")
        fine = F.col("many").isNull() | (F.col("short") - F.col("head") - F.col("tail") < 2)
        light.append(parted.filter(fine).drop("many"))
        keys = parted.filter(~fine).drop("many")
        if keys.isEmpty():
            break
        keys = _next_keys(keys)
    all_ = light[0]
    for more in light[1:]:
        all_ = all_.unionByName(more)
    x, y = all_.filter("size = short").alias("x"), all_.alias("y")
    once = (F.col("y.size") > F.col("x.size")) | (F.col("x.word") < F.col("y.word"))
    apart = (F.col("x.apart") < 0) | (F.left(F.col("x.word"), F.col("x.apart")) != F.left(F.col("y.word"), F.col("x.apart")))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "short", "head", "tail")]
    near = F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1
    on = same[0] & same[1] & same[2] & same[3] & once & apart & near
    return x.join(y, on).select(F.col("x.word").alias("x"), F.col("x.n").alias("x_n"), F.col("y.word").alias("y"), F.col("y.n").alias("y_n"))


def variant_groups(words: DataFrame, times: int = 10, crowd: int = 64) -> DataFrame:
    """word, n, n_near, form, form_n, root of each of the distinct words (word, n)."""
    pairs = near_pairs(words, crowd)
    side = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"{a}_n").alias("n"), F.col(b).alias("other"), F.col(f"{b}_n").alias("other_n"))
    both = pairs.select(F.explode(F.array(side("x", "y"), side("y", "x"))).alias("p")).select("p.*")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    form_n = -F.col("best.less")
    is_form = form_n >= F.col("n") * times
    told = park(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, form_n).alias("form_n")
        ),
        "forms",
    )
    ways = told.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # forms are `times` as frequent, so ways end; each step doubles how far they lead
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = park(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "ways")
        ways = longer.drop("moved")
        if longer.filter("moved").isEmpty():
            break
    return told.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = park(word_counts(docs, slip=31).filter("n >= 2"), "words")
    return variant_groups(words)
