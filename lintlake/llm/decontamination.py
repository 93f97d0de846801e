"""Benchmark decontamination by a prefix-filtered set join.

Each window of `window` consecutive words of a benchmark item (the whole item if it is shorter) is a record of word
shingles, and a document contains it only if it contains all of its shingles.  Shingles are ordered by rarity, their
number of places in all documents; full containment makes one prefix token enough, the record's rarest shingle.  The
documents' shingles are joined with the prefix tokens only; the token's place in the window and in the document gives
the one place where the window could stand, which must lie within the document (length and positional bounds), and the
words of that item-sized window are then compared one by one: their hashes first, then their bytes.

The benchmark is taken in blocks of about `block_bytes` of text, each broadcast (as arrays, about thirteen bytes a byte of
text) and met by all documents in two passes, one to count, one to match; so memory doesn't grow with the benchmark, and
one block is the usual case.

Nulls: a null text, of a document or an item, has no words; an item without id still marks words but isn't listed.
Repeated rows get equal results; repeated items count once; empty tables give no rows (documents) or no hits
(benchmark).  Other columns are ignored.  Texts are handled whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm._bytes import WORDS, mix, runs, span_hashes, text_udf, word_bounds
from lintlake.llm._common import id_and_text, park, row_key

HITS = "struct<n_words:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_HITS = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))])
#: Rows of a matrix that are handled at a time.
CHUNK = 1 << 16


class Words:
    """The words of texts in a row: their bytes, bounds, hashes, and where each text's words begin (and the last ends)."""

    def __init__(self, texts: list[bytes]):
        self.data, self.starts, self.ends, counts = word_bounds([t.translate(WORDS) for t in texts])
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.first = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)

    def shingles(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (numbers of words) where q words of one text begin, and the hashes of these words."""
        n = max(0, len(self.hashes) - q + 1)
        key = np.full(n, q, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(q):
                key += self.hashes[j : j + n] * (mix(np.array([j], np.uint64), 8)[0] | np.uint64(1))
        # A place is cut off where the text ends before the last of the words.
        inside = np.ones(n, bool)
        for j in range(1, q):
            at = self.first[1:-1] - j
            inside[at[(at >= 0) & (at < n)]] = False
        place = np.flatnonzero(inside)
        return place, mix(key[place], 6)

    def said(self, begin: int, size: int) -> list[bytes]:
        return self.data[self.starts[begin] : self.ends[begin + size - 1]].tobytes().split()


class Sorted:
    """Distinct hashes in order, with a table of some of their bits that most others fail."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.mask = np.uint64((1 << max(10, (16 * max(1, len(self.keys)) - 1).bit_length())) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[self.keys & self.mask] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are known, and their numbers."""
        own = np.flatnonzero(self.table[keys & self.mask]) if len(self.keys) else np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys[own]), len(self.keys) - 1)
        same = self.keys[at] == keys[own] if len(own) else np.empty(0, bool)
        return own[same], at[same]


class Windows:
    """The windows of one benchmark block; rank() chooses their prefix tokens."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, shingle: int):
        self.ids, self.words, self.shingle = [i for i, _ in items], Words([t for _, t in items]), shingle
        first = self.words.first
        sizes = np.minimum(window, np.diff(first))
        many = np.where(sizes > 0, np.diff(first) - sizes + 1, 0)
        item = np.repeat(np.arange(len(items)), many)
        begin = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[:-1][item]
        size = sizes[item]
        # Windows of the same words are one; owners lists the items of each.
        key = size.astype(np.uint64)
        with np.errstate(over="ignore"):
            for j in range(window):
                own = size > j
                key[own] = mix(key[own] ^ self.words.hashes[begin[own] + j], 9)
        _, at, group = np.unique(key, return_index=True, return_inverse=True)
        order = np.lexsort((item, group))
        self.begin, self.size = begin[at], size[at]
        self.owners, self.bounds = item[order].astype(np.int32), np.searchsorted(group[order], np.arange(len(at) + 1))
        self.lengths = sorted(set(np.minimum(self.size, shingle).tolist()))
        self.prefix: dict[int, tuple] = {}

    def tokens(self) -> dict[int, Sorted]:
        """By length: the distinct shingles of all windows."""
        out = {}
        for q in self.lengths:
            place, key = self.words.shingles(q)
            # Texts of other lengths have shingles too that no window needs; they only cost room.
            out[q] = Sorted(key)
        return out

    def rank(self, tokens: dict[int, Sorted], counts: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle, ties by the shingle; counts are by shingle length, in the tokens' order."""
        for q in self.lengths:
            place, key = self.words.shingles(q)
            number = np.zeros(len(self.words.hashes), np.int64)
            number[place] = np.searchsorted(tokens[q].keys, key)
            own = np.flatnonzero(np.minimum(self.size, self.shingle) == q)
            token, offset = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
            for size in np.unique(self.size[own]).tolist():
                of = np.flatnonzero(self.size[own] == size)
                for i in range(0, len(of), CHUNK):
                    some = of[i : i + CHUNK]
                    n = number[self.begin[own[some]][:, None] + np.arange(size - q + 1)]
                    c = counts[q][n]
                    n = np.where(c == c.min(1, keepdims=True), n, len(tokens[q].keys))
                    offset[some] = n.argmin(1)
                    token[some] = n.min(1)
            order = np.argsort(token, kind="stable")
            some, starts = np.unique(token[order], return_index=True)
            self.prefix[q] = Sorted(tokens[q].keys[some]), np.append(starts, len(order)), own[order], offset[order]

    def hits(self, texts: list[bytes]) -> pa.Array:
        """For each text its number of words, the items with windows in it, and the word ranges that windows cover."""
        docs = Words(texts)
        found: list[tuple[int, int]] = []
        for q, (tokens, bounds, window, offset) in self.prefix.items():
            place, key = docs.shingles(q)
            own, at = tokens.find(key)
            place = place[own]
            sizes = bounds[at + 1] - bounds[at]
            ends = np.cumsum(sizes)
            # A token of very many windows, or a text of very many tokens, is handled in parts.
            for i in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
                each = np.arange(i, min(i + CHUNK, int(ends[-1])))
                k = np.searchsorted(ends, each, "right")
                entry = bounds[at[k]] + each - (ends[k] - sizes[k])
                w, begin = window[entry], place[k] - offset[entry]
                # Length and positional bounds: the window must lie within the text of its token.
                text = np.searchsorted(docs.first, place[k], "right") - 1
                fits = (begin >= docs.first[text]) & (begin + self.size[w] <= docs.first[text + 1])
                w, begin = w[fits], begin[fits]
                for size in np.unique(self.size[w]).tolist():
                    mine = self.size[w] == size
                    span = np.arange(size)
                    same = (docs.hashes[begin[mine][:, None] + span] == self.words.hashes[self.begin[w[mine]][:, None] + span]).all(1)
                    found += zip(begin[mine][same].tolist(), w[mine][same].tolist(), strict=True)
        out = [{"n_words": int(n), "items": [], "spans": []} for n in np.diff(docs.first)]
        owners: dict[int, set[int]] = {}
        for b, w in sorted(found):
            size = int(self.size[w])
            if docs.said(b, size) != self.words.said(int(self.begin[w]), size):
                continue
            t = int(np.searchsorted(docs.first, b, "right")) - 1
            start = b - int(docs.first[t])
            spans = out[t]["spans"]
            if spans and start <= spans[-1]["end"]:
                spans[-1]["end"] = max(spans[-1]["end"], start + size)
            else:
                spans.append({"start": start, "end": start + size})
            owners.setdefault(t, set()).update(self.owners[self.bounds[w] : self.bounds[w + 1]].tolist())
        for t, own in owners.items():
            out[t]["items"] = sorted({self.ids[k] for k in own} - {None})
        return pa.array(out, _HITS)


def _blocks(bench: DataFrame, block_bytes: int, id_col: str, text_col: str):
    """The benchmark's distinct items in blocks whose size doesn't grow with it."""
    rows = bench.select(bench[id_col].cast("string").alias("id"), F.coalesce(bench[text_col].cast("string"), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
        yield n, [(r["id"], r["text"].encode("utf-8", "surrogatepass")) for r in part.collect()]


def _ranked(texts: DataFrame, items: list, window: int, shingle: int) -> Windows:
    """The block's windows with prefix tokens, by the shingles' counts over all texts."""
    windows = Windows(items, window, shingle)
    tokens = windows.tokens()
    if not len(windows.begin):
        return windows
    shared = texts.sparkSession.sparkContext.broadcast(tokens)

    def count(batches):
        totals = {q: np.zeros(len(t.keys), np.int64) for q, t in shared.value.items()}
        for batch in batches:
            for part in runs(batch.column(0)):
                words = Words(part)
                for q, own in shared.value.items():
                    totals[q] += np.bincount(own.find(words.shingles(q)[1])[1], minlength=len(own.keys))
        for q, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at])], ["q", "at", "n"])

    totals = {q: np.zeros(len(t.keys), np.int64) for q, t in tokens.items()}
    counted = texts.select("text").mapInArrow(count, "q int, at int, n bigint").groupBy("q", "at").agg(F.sum("n").alias("n")).toArrow()  # at most a row per shingle of the block
    q, at, n = (counted.column(c).to_numpy() for c in ("q", "at", "n"))
    for length in totals:
        totals[length][at[q == length]] = n[q == length]
    shared.unpersist()
    windows.rank(tokens, totals)
    return windows


def _hits_column(texts: DataFrame, items: list, window: int, shingle: int):
    shared = texts.sparkSession.sparkContext.broadcast(_ranked(texts, items, window, shingle))
    return text_udf(lambda part: shared.value.hits(part), HITS)


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, shingle: int = 3, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of items with windows in the document, sorted as strings), spans (word ranges hit), one row per row of docs."""
    texts = id_and_text(docs, id_col, text_col)
    done = []
    for n, items in _blocks(bench, block_bytes, item_col, item_text_col):
        hits = texts.withColumn("h", _hits_column(texts, items, window, shingle)("text"))
        if n == 1:
            return _result(hits.select("doc_id", "h.n_words", "h.items", "h.spans"))
        done.append(park(hits.select("doc_id", F.xxhash64("text").alias("th"), "h.n_words", "h.items", "h.spans").dropDuplicates(["doc_id", "th"]), "hits"))
    every = done[0]
    for more in done[1:]:
        every = every.unionAll(more)
    merged = every.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    rows = texts.select("doc_id", F.xxhash64("text").alias("th"))
    joined = rows.join(merged, rows["doc_id"].eqNullSafe(merged["d"]) & (rows["th"] == merged["t"]), "left")
    return _result(joined.select("doc_id", "n_words", F.array_sort(F.array_distinct("items")).alias("items"), _union("spans").alias("spans")))


def _union(spans: str):
    """Overlapping or touching spans made one."""
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def step(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), none, step)


def _result(rows: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans")


def remove_contaminated(docs: DataFrame, bench: DataFrame, window: int = 10, shingle: int = 3, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, all columns, without those in which a benchmark window occurs."""
    hit_rows = None
    for n, items in _blocks(bench, block_bytes, "item_id", "text"):
        hit = _hits_column(id_and_text(docs), items, window, shingle)
        rows = docs.withColumn("__hits", hit(F.col("text").cast("string")))
        if n == 1:
            return rows.where(F.size("__hits.spans") == 0).drop("__hits")
        found = park(rows.where(F.size("__hits.spans") > 0).select(row_key(docs).alias("__rh")), "hit")
        hit_rows = found if hit_rows is None else hit_rows.unionAll(found)
    return docs.withColumn("__rh", row_key(docs)).join(hit_rows.distinct(), "__rh", "left_anti").select(*docs.columns)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = decontaminate(docs, bench)
    return out.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
