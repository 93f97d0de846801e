"""Language identification by rank-order profiles.

Letters (one to three in a row, words padded) are counted over all training texts of a language; its profile is the
ranking of its most frequent n-grams.  A document's own most frequent n-grams are ranked likewise, and the out-of-place
distance to a profile sums the differences of ranks, with the largest one for n-grams that the profile lacks.  The
nearest language wins (ties: the first by name).  The score is a soft-max over the mean distances, 1 if no other
language comes near.

A text that is null or has no letter is `und` with score 0; so is every text where nothing could be learned.  Rows
without language or text teach nothing; a null id counts as the empty string in the split.  Repeated rows and equal
texts get equal results; an empty table gives no rows; other columns are ignored.  Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm._bytes import runs, text_udf

GUESS = "struct<lang:string,score:double,distance:double>"
_GUESS = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("distance", pa.float64())])
#: Each letter of Unicode has a symbol of its own, in order of code points; 0 is the gap between words.
BITS = 20
_TABLE: list[np.ndarray] = []


def symbols(text: bytes) -> np.ndarray:
    """The text's letters, lower-cased, as symbols, single gaps between words and at both ends; only a gap if it has no letter."""
    if not _TABLE:
        letter = np.array([chr(c).isalpha() for c in range(0x110000)])
        _TABLE.append(np.where(letter, np.cumsum(letter), 0))
    points = np.frombuffer(text.decode("utf-8", "ignore").lower().encode("utf-32-le", "ignore"), np.uint32)
    found = np.zeros(len(points) + 2, np.int64)
    found[1:-1] = _TABLE[0][points]
    return found[np.concatenate(([True], (found[1:] > 0) | (found[:-1] > 0)))]


def ngrams(s: np.ndarray) -> np.ndarray:
    """Codes of all one- to three-letter n-grams: the length in the top bits."""
    letters = s[s > 0]
    pairs = (1 << 3 * BITS | s[:-1] << BITS | s[1:])[(s[:-1] > 0) | (s[1:] > 0)]  # none of the gaps between two texts
    triples = (2 << 3 * BITS | s[:-2] << 2 * BITS | s[1:-1] << BITS | s[2:])[s[1:-1] > 0]
    return np.concatenate((letters, pairs, triples))


class Profiles:
    """Ranks of each language's n-grams."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.langs, self.size = sorted({lang for lang, _, _ in rows}), size
        self.codes = np.unique(np.array([code for _, code, _ in rows], np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), 2 * size, np.int32)
        for lang, code, rank in rows:
            self.ranks[self.langs.index(lang), np.searchsorted(self.codes, code)] = rank

    def guess(self, text: bytes) -> dict:
        s = symbols(text)
        if len(s) < 3 or not self.langs:
            return {"lang": "und", "score": 0.0, "distance": 1.0}
        codes, counts = np.unique(ngrams(s), return_counts=True)
        codes = codes[np.lexsort((codes, -counts))[: self.size]]
        at = np.searchsorted(self.codes, codes)
        at = np.where(self.codes[np.minimum(at, len(self.codes) - 1)] == codes, at, len(self.codes))
        apart = np.minimum(np.abs(self.ranks[:, at] - np.arange(len(codes), dtype=np.int32)), self.size)
        mean = apart.mean(1) / self.size
        best = int(np.argmin(mean))
        return {"lang": self.langs[best], "score": float(1 / np.exp(40 * (mean[best] - mean)).sum()), "distance": float(mean[best])}


#: N-grams of all languages that a task holds before it hands their counts on.
HELD = 1 << 20


def learn_profiles(docs: DataFrame, size: int = 400) -> Profiles:
    """Profiles of the `size` most frequent n-grams of each value of lang, over all rows of docs that have one."""
    held = HELD

    def count(batches):
        totals: dict[str, dict[int, int]] = {}

        def handed():
            for lang, own in totals.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "code", "n"])
            totals.clear()

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = totals.setdefault(lang, {})
                for part in runs(batch.column(0).filter(pa.array(langs == lang))):
                    codes = ngrams(np.concatenate([symbols(t) for t in part]))
                    found, n = np.unique(codes, return_counts=True)
                    for c, k in zip(found.tolist(), n.tolist(), strict=True):
                        own[c] = own.get(c, 0) + k
                    if sum(map(len, totals.values())) >= held:
                        yield from handed()
                        own = totals.setdefault(lang, {})
        yield from handed()

    texts = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull()).select(docs["text"].cast("string"), docs["lang"].cast("string"))
    counts = texts.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    ranked = counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)
    return Profiles([(r["lang"], r["code"], r["rank"]) for r in ranked.select("lang", "code", "rank").collect()], size)  # size rows a language


def guesser(spark, profiles: Profiles):
    """A column function: struct(lang, score, distance) of a text column; distance: the mean one to the nearest profile, 0 to 1."""
    shared = spark.sparkContext.broadcast(profiles)
    return text_udf(lambda part: pa.array([shared.value.guess(t) for t in part], _GUESS), GUESS)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def identify(docs: DataFrame, train: DataFrame | None = None, size: int = 400) -> DataFrame:
    """docs, all columns, with `__lang`: struct(lang, score, distance); profiles are learned from train, else from docs."""
    profiles = learn_profiles(docs if train is None else train, size)
    return docs.withColumn("__lang", guesser(docs.sparkSession, profiles)(docs["text"].cast("string")))


def accepted(docs: DataFrame, most: float = 0.85, size: int = 400) -> DataFrame:
    """The rows of docs, all columns, that are near some language: not `und`, and a distance of at most `most`.

    The distance doesn't depend on how many languages were learned; of an unknown script it is 1, of random letters about 0.9.
    """
    rows = identify(docs, None, size)
    return rows.where((F.col("__lang.lang") != "und") & (F.col("__lang.distance") <= most)).drop("__lang")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 5) == 0
    out = identify(docs.select("doc_id", "text"), docs.where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), F.col("__lang.lang").alias("lang_pred"), F.col("__lang.score").alias("score"))
