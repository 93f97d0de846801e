"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Tokens (white-space words, and each one's shape: last character, capitals, repetition of the word before) are hashed
into `slots`.  Random indexing gives every slot a fixed sparse ternary index vector; its context vector is the sum, over
all places in all documents, of the index vectors of the tokens within two words.  A document is the mean of its tokens'
index and context vectors, for words and for shapes.  A network with one hidden layer (numpy, on the driver) is fitted
to labelled rows, of which a part is set aside to find the temperature that calibrates its probabilities.

The contexts are counted over all documents.  Labels come from at most `train_rows` rows, a hash sample of those allowed
(all of them where there are fewer): the documented bound of what the driver holds.  An id that has several rows teaches
with one of them, the one whose text's hash is least.

A null or empty text has the zero vector and gets the network's answer for it.  Labelled rows that are null or absent
teach nothing; without labels of both kinds every score is the mean label (0.5 without any).  Repeated rows get equal
scores; an empty table gives no rows; other columns are ignored.  Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm._bytes import mix, runs, span_hashes, text_udf, word_bounds
from lintlake.llm._common import id_and_text
from lintlake.llm.language import fold

_BYTE = np.arange(256)
_UPPER = ((_BYTE >= 65) & (_BYTE <= 90)).astype(np.int64)
_LETTER = (_UPPER > 0) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
#: Letters and digits end a word alike; other last characters count each for itself.
_LAST = np.where(_LETTER, 1, np.where((_BYTE >= 48) & (_BYTE <= 57), 2, _BYTE + 3))

#: Vectors are gathered for so many words at a time, however long a text is.
CHUNK = 1 << 16


def tokens(texts: list[bytes], slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the words and of their shapes, for all texts in a row, and the number of words of each text."""
    data, starts, ends, counts = word_bounds(texts)
    h = span_hashes(data, starts, ends)
    capitals = np.concatenate(([0], np.cumsum(_UPPER[data])))
    letters = np.concatenate(([0], np.cumsum(_LETTER[data].astype(np.int64))))
    up, all_ = capitals[ends] - capitals[starts], letters[ends] - letters[starts]
    caps = np.where(up == 0, 0, np.where((up == all_) & (all_ > 1), 3, np.where(up == 1, 1, 2)))
    again = np.concatenate(([False], h[1:] == h[:-1])).astype(np.int64) if len(h) else np.empty(0, np.int64)
    shape = (_LAST[data[ends - 1]] * 4 + caps) * 2 + again
    with np.errstate(over="ignore"):
        shape = mix(shape.astype(np.uint64), 21)
    return (h % np.uint64(slots)).astype(np.int64), (shape % np.uint64(slots)).astype(np.int64), counts


def index_vectors(slots: int, dim: int, ones: int = 4) -> np.ndarray:
    """Sparse ternary vectors: `ones` entries of +1 or -1 a slot, from hashes of the slot."""
    out = np.zeros((slots, dim), np.int32)
    slot = np.arange(slots)
    for j in range(ones):
        h = mix(slot.astype(np.uint64), 31 + j)
        out[slot, (h >> np.uint64(8)).astype(np.int64) % dim] = np.where(h & np.uint64(1), 1, -1)
    return out


def _near(e: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word the sum of e over the words at most two away in the same text."""
    out = np.zeros_like(e)
    for d in (1, 2):
        same = (text[d:] == text[:-d])[:, None]
        out[d:] += np.where(same, e[:-d], 0)
        out[:-d] += np.where(same, e[d:], 0)
    return out


def context_vectors(texts: DataFrame, slots: int, dim: int) -> np.ndarray:
    """slots x dim: each slot's summed context over all rows, scaled to length 1.  Whole numbers until then, so reruns agree."""

    def count(batches):
        index, total = index_vectors(slots, dim), np.zeros((slots, dim), np.int64)
        for batch in batches:
            for part in runs(batch.column(0)):
                words, shapes, counts = tokens(part, slots)
                text = np.repeat(np.arange(len(counts)), counts)
                for i in range(0, len(words), CHUNK):
                    wide = slice(max(0, i - 2), i + CHUNK + 2)
                    own = slice(i, i + CHUNK)
                    near = _near(index[words[wide]] + index[shapes[wide]], text[wide])[i - wide.start :][: len(words[own])]
                    for at in (words[own], shapes[own]):
                        order = np.argsort(at, kind="stable")
                        first = np.flatnonzero(np.concatenate(([True], at[order][1:] != at[order][:-1])))
                        total[at[order][first]] += np.add.reduceat(near[order], first, axis=0)
        some = np.flatnonzero(total.any(1))
        for i in range(0, len(some), 4096):
            rows = some[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(total[rows, j]) for j in range(dim))], ["slot", *(f"c{j}" for j in range(dim))])

    schema = "slot bigint, " + ", ".join(f"c{j} bigint" for j in range(dim))
    sums = texts.select("text").mapInArrow(count, schema).groupBy("slot").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(dim)))
    table = sums.toArrow()  # at most a row a slot
    out = np.zeros((slots, dim), np.float32)
    if table.num_rows:
        out[table.column("slot").to_numpy()] = np.stack([table.column(f"c{j}").to_numpy() for j in range(dim)], 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)


class Network:
    """Two layers and a temperature; vectors: slots x (index and context dimensions)."""

    def __init__(self, vectors: np.ndarray, prior: float):
        self.vectors, self.prior, self.layers, self.temperature = vectors, prior, None, 1.0

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text: means of its words' and of its shapes' vectors."""
        words, shapes, counts = tokens(texts, len(self.vectors))
        width = self.vectors.shape[1]
        out = np.zeros((len(texts), 2 * width))
        text = np.repeat(np.arange(len(texts)), counts)
        for i in range(0, len(words), CHUNK):
            own = text[i : i + CHUNK]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            for k, at in enumerate((words, shapes)):
                out[own[first], k * width : (k + 1) * width] += np.add.reduceat(self.vectors[at[i : i + CHUNK]], first, axis=0)
        return (out / np.maximum(counts, 1)[:, None]).astype(np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 1, decay: float = 1e-4) -> None:
        """Adam on the log loss over four fifths of the rows; the temperature is the best of a grid over the rest."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        aside, own = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[own].mean(0), x[own].std(0) + 1e-3
        x = (x - self.mean) / self.scale
        params = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
                w1, b1, w2, b2 = params
                h = np.maximum(0, x[at] @ w1 + b1)
                off = (_sigmoid(h @ w2 + b2) - y[at]) / len(at)
                back = np.outer(off, w2) * (h > 0)
                grads = [x[at].T @ back + decay * w1, back.sum(0), h.T @ off + decay * w2, np.array([off.sum()])]
                step += 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    params[i] = params[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.layers = params
        if len(aside):
            z, t = self._logits(x[aside]), np.geomspace(0.25, 20, 80)
            loss = [np.logaddexp(0, np.where(y[aside] > 0, -z, z) / k).mean() for k in t]
            self.temperature = float(t[int(np.argmin(loss))])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(0, x @ w1 + b1) @ w2 + b2

    def fold(self) -> None:
        """Take the scaling and the first layer into the slots' vectors: both are linear, and so is the mean over words."""
        w1, b1, _, _ = self.layers
        width = self.vectors.shape[1]
        w = w1 / self.scale[:, None]
        self.folded = [(self.vectors @ w[k * width : (k + 1) * width]).astype(np.float32) for k in range(2)]
        self.offset = b1 - self.mean @ w
        self.vectors = self.vectors[:, :0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.layers is None:
            return np.full(len(texts), self.prior)
        words, shapes, counts = tokens(texts, len(self.vectors))
        h = np.zeros((len(texts), len(self.offset)))
        text = np.repeat(np.arange(len(texts)), counts)
        for i in range(0, len(words), CHUNK):
            own = text[i : i + CHUNK]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            h[own[first]] += np.add.reduceat(self.folded[0][words[i : i + CHUNK]] + self.folded[1][shapes[i : i + CHUNK]], first, axis=0)
        h = np.maximum(0, h / np.maximum(counts, 1)[:, None] + self.offset)
        # Rounded, so that equal texts get equal scores whatever they were batched with.
        return np.round(_sigmoid((h @ self.layers[2] + self.layers[3]) / self.temperature), 9)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, slots: int = 1 << 15, dim: int = 32, train_rows: int = 20_000) -> Network:
    """A network for labels (doc_id, label 0 or 1); docs: doc_id, text.  Contexts are counted over all docs."""
    vectors = np.concatenate((index_vectors(slots, dim).astype(np.float32), context_vectors(docs, slots, dim)), 1)
    chosen = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(train_rows)
    net = Network(vectors, 0.5)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def pool(part):
        return pa.array(list(shared.value.pool(part)), pa.list_(pa.float32()))

    # train_rows rows of 16 bytes at most: a proven bound for the broadcast.  Of an id's rows one is learned from, the
    # one whose text's hash is least, so that train_rows bounds what comes to the driver however often ids repeat.
    once = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = once.select("doc_id", "label", text_udf(pool, "array<float>")("text").alias("x")).toArrow()
    if rows.num_rows:
        order = np.lexsort((rows.column("doc_id").to_numpy(),))
        y = rows.column("label").to_numpy().astype(np.float64)[order]
        net = Network(vectors, float(y.mean()))
        if 0 < y.mean() < 1:
            net.fit(np.array(rows.column("x").to_pylist(), np.float32)[order], y)
            net.fold()
    return net


def scorer(spark, net: Network):
    """A column function: the probability of label 1 of a text column."""
    shared = spark.sparkContext.broadcast(net)
    return text_udf(lambda part: pa.array(shared.value.score(part), pa.float64()), "double")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = id_and_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    net = train(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    out = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), scorer(spark, net)("text").alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
