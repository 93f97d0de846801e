"""N-gram Jaccard join by multiple-global-order prefix filtering.

A document's set holds the distinct hashes (64 bits) of its `k`-word shingles.  Two sets with Jaccard similarity t or
more share a token in their prefixes (the first n - ceil(t n) + 1 tokens) under every global order of the tokens.

- Order 1 generates candidates: tokens by hash, but the corpus's frequent tokens last, the most frequent at the very
  end.  Frequent tokens are found by counting, over all documents, the least hashes of each set (as many as its prefix
  has); the list is broadcast up to `listed` tokens (8 MB), of more only the most frequent; that changes the work, not
  the result.
- Prefix tokens meet in buckets, sorted by set size; length, prefix-index and positional bounds thin the pairs.
- Parity bitmaps of the sets (two to four bits a token) bound the overlap: each differing bit stands for a token that
  only one of two sets has.
- Orders 2 and 3 (other hash orders) must agree, by a shared prefix token each, before the sets are intersected.

Equal sets are collapsed first, whatever their number.  A bucket of up to `small` sets gives its pairs.  Larger ones, as
large groups of near copies make, never meet in one task: tokens that are heavy within a task are dealt out by set, not
by token, and a large bucket is cut into blocks of at most about `block` sets and `block_tokens` tokens.

1. Each set goes to one block of its largest bucket (to one of each of two cuts, if it has several blocks).  A block
   links its sets to a spanning forest: sets that it has already joined aren't compared again, so a group of near copies
   costs about a multiple of its members.
2. Components are formed from these links and those of the small buckets.  Buckets that still hold several components
   are taken whole: blocks of all their sets meet blocks of the sets outside the bucket's largest component, so that
   every pair across components meets, in the bucket of the first prefix token that both have.  Rows whose place in the
   prefix is too far back for any set of the bucket are left out before.  Blocks of bitmaps, wider ones, meet first;
   whole sets are sent only for rows to which a bitmap of another component leaves a partner.

All bounds are exact, so no link between components is missed; links within one aren't all listed.

Nulls: a null text has an empty set, is linked with nothing, and is its own component; a null id never names a
component unless all its members have none.  Repeated rows and equal texts fall together.  An empty table gives no rows;
other columns are ignored.  Texts are read whole; fewer than k words make one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm._bytes import mix, runs, shingle_sets
from lintlake.llm._common import BLANKS, id_and_text, park, row_key
from lintlake.llm.components import components


class Threshold:
    """Similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int = 80, den: int = 100):
        self.num, self.den = num, den

    def prefix(self, n):
        """Prefix length: a partner shares at least ceil(t n) tokens."""
        return n + 1 + (-self.num * n) // self.den

    def index(self, n):
        """Prefix length of the smaller set: the larger shares at least ceil(2t / (1 + t) n)."""
        return n + 1 + (-2 * self.num * n) // (self.den + self.num)

    def overlap(self, a, b):
        """Shared tokens needed by sets of sizes a and b."""
        return -((-self.num * (a + b)) // (self.den + self.num))

    def reachable(self, a, b, apart):
        """Whether sets of sizes a and b that differ in `apart` bits of their bitmaps can share enough tokens."""
        return a + b - apart >= 2 * self.overlap(a, b)

    def sizes(self, a, b):
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)


def _digest(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s, 5).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64), 9).view(np.int64)[0])


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity bits of the tokens: two to four bits a token, a power of two, 64 at least."""
    bits = max(64, 2 << int(len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((mix(s, 7) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def sets_of(docs: DataFrame, t: Threshold, k: int = 5) -> DataFrame:
    """doc_id, th (hash of the text), rh (the row's key), n (set size), node (digest of the set; of the id where it is empty), least (its least hashes), bits; docs: doc_id, text, rh."""

    def sets(batches):
        for batch in batches:
            at = 0
            for part in runs(batch.column(3)):
                ids, ths, rhs = (batch.column(c).slice(at, len(part)) for c in range(3))
                at += len(part)
                own = shingle_sets(part, k)
                nodes = [_digest(s) if len(s) else int(mix(np.array([(x or 0) & (1 << 64) - 1], np.uint64), 3).view(np.int64)[0]) for s, x in zip(own, ids.to_pylist(), strict=True)]
                least = [s[: t.prefix(len(s))].view(np.int64) for s in own]
                yield pa.RecordBatch.from_arrays(
                    [ids, ths, rhs, pa.array([len(s) for s in own], pa.int64()), pa.array(nodes, pa.int64()), pa.array(least, pa.list_(pa.int64())), pa.array([bitmap(s).tobytes() for s in own], pa.binary())],
                    ["doc_id", "th", "rh", "n", "node", "least", "bits"],
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "rh", "text")
    return rows.mapInArrow(sets, "doc_id bigint, th bigint, rh bigint, n bigint, node bigint, least array<bigint>, bits binary")


def frequent_tokens(sets: DataFrame, at_least: int, listed: int) -> np.ndarray:
    """The frequent tokens by rising count, as uint64; at most `listed`, the most frequent."""
    counts = sets.select("node", "least").dropDuplicates(["node"]).select(F.explode("least").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= at_least)
    rows = counts.orderBy(F.desc("c"), "token").limit(listed).select("token").toArrow()
    return rows.column("token").to_numpy().view(np.uint64)[::-1]


class Order:
    """Order 1: by hash, listed tokens last, by rising frequency."""

    def __init__(self, frequent: np.ndarray):
        self.rank = np.argsort(frequent, kind="stable")
        self.tokens = frequent[self.rank]

    def sort(self, s: np.ndarray) -> np.ndarray:
        if not len(self.tokens) or not len(s):
            return s
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        known = self.tokens[at] == s
        if not known.any():
            return s
        return np.concatenate((s[~known], s[known][np.argsort(self.rank[at[known]], kind="stable")]))


#: Blocks of bitmaps hold so many times the sets and tokens of a block of sets; a bitmap has a sixteenth to a thirty-second of its set's bytes.
WIDE = 4
#: Prefix tokens are handed on when a task holds so many, so that its memory is bounded.
HELD = 1 << 20
TOKENS = "token bigint, salt int, n int, pos int, node bigint"


def prefix_tokens(docs: DataFrame, order, t: Threshold, k: int, small: int) -> DataFrame:
    """token, salt, n, pos, node for the prefix tokens of every set; equal sets of one task give theirs once.

    A token that a task meets in over `small` sets is heavy: its rows get salts by set, and one row with salt 0 and n 0
    marks the token.  So of a token's rows with salt 0 there are at most small + 1 from each HELD tokens.
    """

    def dealt(sets: list[np.ndarray], nodes: list[int], sizes: list[int]):
        many = np.array([len(x) for x in sets])
        token = np.concatenate(sets).view(np.int64)
        c = {"token": token, "n": np.repeat(np.array(sizes, np.int32), many), "pos": (np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32), "node": np.repeat(np.array(nodes, np.int64), many)}
        found, counts = np.unique(token, return_counts=True)
        heavy = found[counts > small]
        c["salt"] = np.zeros(len(token), np.int32)
        if len(heavy):
            at = heavy[np.minimum(np.searchsorted(heavy, token), len(heavy) - 1)] == token
            c["salt"][at] = 1 + (c["node"][at] & 0xFFFF)
            c = {x: np.concatenate((v, heavy if x == "token" else np.zeros(len(heavy), v.dtype))) for x, v in c.items()}
        for i in range(0, len(c["token"]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[x][i : i + 100_000]) for x in ("token", "salt", "n", "pos", "node")], ["token", "salt", "n", "pos", "node"])

    def tokens(batches):
        seen: set[int] = set()
        out, nodes, sizes, held = [], [], [], 0
        for batch in batches:
            for part in runs(batch.column(0)):
                for s in shingle_sets(part, k):
                    if len(s) and (node := _digest(s)) not in seen:
                        seen.add(node)
                        out.append(order.value.sort(s)[: t.prefix(len(s))])
                        nodes.append(node)
                        sizes.append(len(s))
                        held += len(out[-1])
                if held >= HELD:
                    yield from dealt(out, nodes, sizes)
                    out, nodes, sizes, held = [], [], [], 0
        if out:
            yield from dealt(out, nodes, sizes)

    return docs.select("text").mapInArrow(tokens, TOKENS)


def _buckets(batches, key: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of consecutive rows, cut only between two values of the key columns; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in key], 1)
        if held and (np.array([held[-1].column(c)[-1].as_py() for c in key]) != keys[0]).any():
            yield _columns(held)
            held = []
        other = np.flatnonzero((keys != keys[-1]).any(1))
        cut = int(other[-1]) + 1 if len(other) else 0  # rows of the last key may go on in the next batch
        if cut == 0:
            held.append(batch)
            continue
        yield _columns([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return {c: table.column(c).to_pylist() if c in ("set", "bits") else table.column(c).to_numpy() for c in table.column_names}


def _fits(c: dict, a: np.ndarray, b: np.ndarray, t: Threshold) -> np.ndarray:
    """Length, index-prefix and positional bounds of rows a and b (a's set the smaller) of one bucket."""
    na, nb, pa_, pb = (c[x][i].astype(np.int64) for x, i in (("n", a), ("n", b), ("pos", a), ("pos", b)))
    left = 1 + np.minimum(na - 1 - pa_, nb - 1 - pb)
    return t.sizes(na, nb) & (pa_ < t.index(na)) & (left >= t.overlap(na, nb))


def bucket_pairs(tokens: DataFrame, t: Threshold, small: int) -> DataFrame:
    """a, b, token, n, pos: candidate pairs (a, b); and, for each member of a bucket over `small`, b, token, n and pos."""

    def pairs(batches):
        for c in _buckets(batches, ("token", "salt")):
            keys, salts, nodes = c["token"], c["salt"], c["node"]
            other = (keys[1:] != keys[:-1]) | (salts[1:] != salts[:-1])
            first = np.concatenate(([True], other | (nodes[1:] != nodes[:-1])))  # equal sets of several tasks
            c = {x: v[first] for x, v in c.items()}
            keys, salts, nodes, n = c["token"], c["salt"], c["node"], c["n"]
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (salts[1:] != salts[:-1]))))
            sizes = np.diff(np.concatenate((starts, [len(keys)])))
            # Rows come by size, so a heavy token's mark comes first.
            large = (salts[starts] > 0) | (n[starts] == 0) | (sizes > small)
            a, b = [], []
            for z in np.unique(sizes[(sizes > 1) & ~large]):
                own = starts[(sizes == z) & ~large]
                i, j = np.triu_indices(z, 1)
                x, y = (own[:, None] + i).ravel(), (own[:, None] + j).ravel()
                fit = _fits(c, x, y, t)
                a.append(x[fit])
                b.append(y[fit])
            x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
            big = np.flatnonzero(np.repeat(large, sizes) & (n > 0))
            names, gap = ["a", "b", "token", "n", "pos"], lambda kind, many: pa.nulls(many, kind)
            if len(x):
                found = np.unique(np.stack((nodes[x], nodes[y])), axis=1)
                many = found.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), gap(pa.int64(), many), gap(pa.int32(), many), gap(pa.int32(), many)], names)
            if len(big):
                yield pa.RecordBatch.from_arrays([gap(pa.int64(), len(big)), pa.array(nodes[big]), pa.array(keys[big]), pa.array(n[big]), pa.array(c["pos"][big])], names)

    dealt = tokens.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "node")
    return dealt.mapInArrow(pairs, "a bigint, b bigint, token bigint, n int, pos int")


class Checked:
    """A set with its prefixes under orders 2 and 3, worked out when they are first asked for."""

    def __init__(self, s: np.ndarray, t: Threshold, seeds: tuple[int, ...] = (2, 3)):
        self.set, self.t, self.seeds, self.prefixes = s, t, seeds, None

    def _prefix(self) -> list[np.ndarray]:
        if self.prefixes is None:
            size = self.t.prefix(len(self.set))
            self.prefixes = [np.partition(mix(self.set, seed), size - 1)[:size] for seed in self.seeds]
        return self.prefixes

    def linked(self, other: Checked) -> bool:
        """The filters of the other orders, then the exact test."""
        x, y = self.set, other.set
        if not self.t.sizes(len(x), len(y)):
            return False
        if not all(_common(p, q) for p, q in zip(self._prefix(), other._prefix(), strict=True)):
            return False
        return _common(x, y) >= self.t.overlap(len(x), len(y))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def bitmaps_allow(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (a, b) whose bitmaps and sizes allow a link."""
    own = sets.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    for x in ("a", "b"):
        pairs = pairs.join(own.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), x)

    def allowed(batches):
        for batch in batches:
            c = {x: batch.column(x).to_numpy() for x in ("a", "b", "n_a", "n_b")}
            maps = zip(*([np.frombuffer(m, np.uint8) for m in batch.column(x).to_pylist()] for x in ("bits_a", "bits_b")), strict=True)
            apart = np.array([int(np.bitwise_count(folded(x, len(y)) ^ folded(y, len(x))).sum()) for x, y in maps], np.int64)
            ok = t.sizes(c["n_a"], c["n_b"]) & t.reachable(c["n_a"], c["n_b"], apart)
            yield pa.RecordBatch.from_arrays([pa.array(c["a"][ok]), pa.array(c["b"][ok])], ["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(allowed, "a bigint, b bigint")


def folded(m: np.ndarray, size: int) -> np.ndarray:
    """A bitmap folded to at most `size` bytes, which keeps parities."""
    return m if len(m) <= size else np.bitwise_xor.reduce(m.reshape(-1, size), axis=0)


def verify(pairs: DataFrame, own: DataFrame, t: Threshold) -> DataFrame:
    """u, v of the pairs (a, b) that are linked; own: (node, set).

    Pairs come from small buckets, so a set has a bounded number of partners for its size; they follow it in one task.
    """
    heads = own.select(F.col("node").alias("a"), F.lit(0).alias("role"), F.lit(0).cast("bigint").alias("b"), "set")
    members = pairs.join(own.withColumnRenamed("node", "b"), "b").select("a", F.lit(1).alias("role"), "b", "set")

    def check(batches):
        head, mine = None, None
        for batch in batches:
            found = []
            cols = [batch.column(c).to_pylist() for c in ("a", "role", "b", "set")]
            for a, role, b, s in zip(*cols, strict=True):
                if role == 0:
                    head, mine = a, Checked(np.frombuffer(s, np.uint64), t)
                elif a == head and mine.linked(Checked(np.frombuffer(s, np.uint64), t)):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    dealt = heads.unionAll(members).repartition("a").sortWithinPartitions("a", "role")
    return dealt.mapInArrow(check, "u bigint, v bigint")


def set_table(nodes: DataFrame, texts: DataFrame, sets: DataFrame, k: int, few: int = 1 << 18) -> DataFrame:
    """node, set (its hashes as bytes), bits for the wanted nodes.  Up to `few` nodes (24 bytes each) are broadcast, more joined by shuffling.

    Each node is read from one row; rows that are equal in all columns may give it again, once a task.
    """
    nodes = park(nodes.distinct(), "wanted")
    hint = F.broadcast if nodes.count() <= few else lambda df: df
    chosen = park(sets.where("n > 0").join(hint(nodes), "node").groupBy("node").agg(F.min(F.struct("th", "rh")).alias("m")).select("m.th", "m.rh"), "chosen")
    rows = texts.select(F.xxhash64("text").alias("th"), "rh", "text").join(hint(chosen), ["th", "rh"], "left_semi").select("text")

    def made(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in runs(batch.column(0)):
                found = {d: s for s in shingle_sets(part, k) if len(s) and (d := _digest(s)) not in seen}
                seen.update(found)
                columns = [pa.array([f(s).tobytes() for s in found.values()], pa.binary()) for f in (np.asarray, bitmap)]
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), *columns], ["node", "set", "bits"])

    return park(rows.mapInArrow(made, "node bigint, set binary, bits binary"), "own")


def within_reach(hot: DataFrame, t: Threshold) -> DataFrame:
    """The rows (node, token, n, pos) of large buckets whose place allows a link with any set as small as the bucket's least.

    Before its first shared token a set of size n has pos tokens that its partner lacks, so pos is at most n less the
    overlap needed.
    """
    least = hot.groupBy("token").agg(F.min("n").alias("least"))
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * t.num / t.den))
    needed = F.ceil((F.col("n") + smallest) * t.num / (t.den + t.num) - 1e-9)
    return hot.join(least, "token").where(F.col("pos") <= F.col("n") - needed).select("node", "token", "n")


def first_blocks(hot: DataFrame, block: int, block_tokens: int) -> DataFrame:
    """token, cut, mine, node, root, guest: each node in its largest bucket, dealt to blocks; in two cuts, if it has several blocks."""
    sizes = hot.groupBy("token").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    rows = hot.join(sizes, "token").groupBy("node").agg(F.max(F.struct("size", "token", "weight")).alias("m")).select("node", "m.*")
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("weight") / block_tokens))
    rows = rows.withColumn("blocks", blocks).withColumn("cut", F.explode(F.when(F.col("blocks") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("token", "cut", F.pmod(F.xxhash64("node", "cut"), F.col("blocks")).alias("mine"), "node", F.col("node").alias("root"), F.lit(0).alias("guest"))


def open_blocks(hot: DataFrame, labels: DataFrame, block: int, block_tokens: int) -> DataFrame:
    """token, cut, mine, node, root, guest, n: buckets in several components, as blocks of all their rows, each beside each block of guests.

    guest: 0 for a row of the bucket's largest component, 1 for another one, 2 for the latter as a guest.
    """
    rows = hot.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = rows.groupBy("token", "root").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    largest = F.max(F.struct("size", "root", "weight")).alias("m")
    open_ = parts.groupBy("token").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"), largest, F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda size, weight: F.ceil(F.greatest(size / block, weight / block_tokens))
    open_ = open_.select("token", F.col("m.root").alias("main"), blocks(F.col("size"), F.col("weight")).alias("blocks"), blocks(F.col("size") - F.col("m.size"), F.col("weight") - F.col("m.weight")).alias("guests"))
    rows = rows.join(open_, "token").withColumn("other", F.col("root") != F.col("main"))
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    mine, seat = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("guests"))
    place = lambda i, j, kind: F.struct((i * F.col("guests") + j).alias("mine"), kind.alias("guest"))
    home = F.transform(upto(F.col("guests")), lambda j: place(mine, j, F.when(F.col("other"), 1).otherwise(0)))
    away = F.when(F.col("other"), F.transform(upto(F.col("blocks")), lambda i: place(i, seat, F.lit(2))))
    rows = rows.withColumn("place", F.explode(F.concat(home, F.coalesce(away, F.slice(home, 1, 0)))))
    return rows.select("token", F.lit(0).alias("cut"), "place.mine", "node", "root", "place.guest", "n")


class Bitmaps:
    """Bitmaps of sets, of sizes n, that come by rising size, so that those of a length lie together.

    Partners of a set have bitmaps of its own length or the next, which are also kept folded to the shorter one.
    """

    def __init__(self, n, maps: list[np.ndarray]):
        self.n = np.array(n, np.int64)
        self.size, self.start, self.maps, self.folded = np.array([len(m) for m in maps]), {}, {}, {}
        for z in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == z)
            self.start[z], self.maps[z] = int(at[0]), np.stack([maps[i] for i in at])
            self.folded[z] = self.maps[z][:, : z // 2] ^ self.maps[z][:, z // 2 :]

    def near(self, i: int, j: np.ndarray, t: Threshold) -> np.ndarray:
        """Those of the later rows j whose overlap with row i can reach the threshold."""
        z = int(self.size[i])
        mine, kept = self.maps[z][i - self.start[z]], [j[self.size[j] > 2 * z]]  # of a threshold under a half
        for size, maps in ((z, self.maps), (2 * z, self.folded)):
            at = j[self.size[j] == size]
            if len(at):
                apart = np.bitwise_count(maps[size][at - self.start[size]] ^ mine).sum(1, dtype=np.int64)
                kept.append(at[t.reachable(self.n[i], self.n[at], apart)])
        return np.concatenate(kept)


def _partners(i: int, maps: Bitmaps, node: np.ndarray, guest: np.ndarray | None, label: np.ndarray, t: Threshold) -> np.ndarray:
    """The later rows of a block that row i may be linked with: of other labels, in reach of its size and its bitmap."""
    # Rows come by rising size: the larger partners of i, up to where sizes part.
    end = i + 1 + int(np.searchsorted(maps.n[i + 1 :], maps.n[i] * t.den // t.num, "right"))
    j = np.arange(i + 1, end)
    if guest is not None:  # a guest meets those at home; of two that are guests elsewhere, the lesser is at home
        least_home = (guest[j] == 0) | (node[j] < node[i]) if guest[i] == 2 else (guest[i] == 0) | (node[i] < node[j])
        j = j[((guest[j] == 2) != (guest[i] == 2)) & least_home]
    j = j[label[j] != label[i]]
    return maps.near(i, j, t) if len(j) else j


def within_bitmaps(rows: DataFrame, own: DataFrame, t: Threshold) -> DataFrame:
    """node, token, n of the rows (token, mine, node, root, guest, n) of open blocks that sizes and bitmaps leave a partner of another root."""

    def kept(batches):
        for c in _buckets(batches, ("token", "mine")):
            starts = np.flatnonzero(np.concatenate(([True], (c["token"][1:] != c["token"][:-1]) | (c["mine"][1:] != c["mine"][:-1]))))
            keep = np.zeros(len(c["token"]), bool)
            for s, e in zip(starts, [*starts[1:], len(keep)], strict=True):
                node, guest, label = (c[x][s:e] for x in ("node", "guest", "root"))
                maps = Bitmaps(c["n"][s:e], [np.frombuffer(x, np.uint8) for x in c["bits"][s:e]])
                for i in range(e - s):
                    found = _partners(i, maps, node, guest, label, t)
                    keep[s + found] = True
                    keep[s + i] |= len(found) > 0
            yield pa.RecordBatch.from_arrays([pa.array(c[x][keep]) for x in ("node", "token", "n")], ["node", "token", "n"])

    keys = ("token", "mine")
    dealt = rows.join(own.select("node", "bits"), "node").repartition(*keys).sortWithinPartitions(*keys, "n", "node")
    return dealt.mapInArrow(kept, "node bigint, token bigint, n int").distinct()


def block_links(rows: DataFrame, own: DataFrame, t: Threshold, order=None) -> DataFrame:
    """u, v: in each block, links that join all its rows (token, cut, mine, node, root, guest) as all links across roots would.

    With an order, a pair is left to the bucket of the first prefix token that both sets have.
    """

    def links(batches):
        for c in _buckets(batches, ("token", "cut", "mine")):
            key = np.stack((c["token"], c["cut"], c["mine"]), 1)
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
            found: list[tuple[int, int]] = []
            for s, e in zip(starts, [*starts[1:], len(key)], strict=True):
                found += _linked_in(c, s, e, t, order.value if order else None)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    keys = ("token", "cut", "mine")
    dealt = rows.join(own.select("node", "set"), "node").withColumn("n", F.length("set")).repartition(*keys).sortWithinPartitions(*keys, "n", "node")
    return dealt.mapInArrow(links, "u bigint, v bigint")


def _linked_in(c: dict, s: int, e: int, t: Threshold, order: Order | None) -> list[tuple[int, int]]:
    node, guest = c["node"][s:e], c["guest"][s:e]
    label = np.unique(c["root"][s:e], return_inverse=True)[1]
    if label.max() == 0:
        return []
    sets = [np.frombuffer(x, np.uint64) for x in c["set"][s:e]]
    maps, checked, found = Bitmaps([len(x) for x in sets], [bitmap(x) for x in sets]), [Checked(x, t) for x in sets], []
    prefix = [order.sort(x)[: t.prefix(len(x))] for x in sets] if order else None
    first = np.uint64(int(c["token"][s]) & (1 << 64) - 1)
    for i in range(len(node)):
        for x in _partners(i, maps, node, guest if order else None, label, t).tolist():
            if label[x] == label[i] or (prefix and not _first_common(prefix[i], prefix[x], first)):
                continue
            if checked[i].linked(checked[x]):
                found.append((int(node[i]), int(node[x])))
                label[label == label[x]] = label[i]
    return found


def _first_common(x: np.ndarray, y: np.ndarray, token: np.uint64) -> bool:
    """Whether token is the first one of x that y has too."""
    here = np.isin(x, y)
    return bool(here.any()) and x[int(np.argmax(here))] == token


def jaccard_groups(docs: DataFrame, num: int = 80, den: int = 100, k: int = 5, small: int = 32, block: int = 1000, block_tokens: int = 1 << 22, at_least: int = 4, listed: int = 1 << 20, few: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows (doc_id, th, rh, n, node, root), one per row of docs, root the component of its set; links (u, v) between sets."""
    t = Threshold(num, den)
    texts = id_and_text(docs, id_col, text_col, row="rh")
    sets = park(sets_of(texts, t, k), "sets")
    order = docs.sparkSession.sparkContext.broadcast(Order(frequent_tokens(sets, at_least, listed)))
    found = park(bucket_pairs(prefix_tokens(texts, order, t, k, small), t, small), "found")
    pairs = park(bitmaps_allow(found.where("token is null").select("a", "b").distinct(), sets, t), "pairs")
    hot = park(within_reach(found.where("token is not null").select(F.col("b").alias("node"), "token", "n", "pos").distinct(), t), "hot")
    own = set_table(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).unionAll(hot.select("node")), texts, sets, k)
    links = park(verify(pairs, own, t).unionAll(block_links(first_blocks(hot, block, block_tokens), own, t)), "links")
    labels = park(components(links, few), "labels")
    near = park(within_bitmaps(open_blocks(hot, labels, WIDE * block, WIDE * block_tokens), own, t), "near")
    more = park(block_links(open_blocks(near, labels, block, block_tokens), own, t, order), "more")
    if more.take(1):
        links = links.unionAll(more)
        labels = components(links, few)
    rows = sets.select("doc_id", "th", "rh", "n", "node").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rows, links


def _least_id(rows: DataFrame) -> DataFrame:
    return rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links), one row per row of docs."""
    rows, _ = jaccard_groups(docs, **options)
    rows = park(rows, "rows")
    out = rows.where("n > 0").join(_least_id(rows.where("n > 0")), "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionAll(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, one of each component: that with the smallest id, then hash of the text and of the row; texts without words all stay.

    Which row stays depends on the rows alone, so reruns agree.
    """
    rows, _ = jaccard_groups(docs, **options)
    rows = rows.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th", "rh")).alias("row"))
    kept = rows.select(F.col("row.th").alias("__th"), F.col("row.rh").alias("__rh"))
    mine = docs.withColumns({"__th": F.xxhash64(docs["text"].cast("string")), "__rh": row_key(docs)})
    blank = ~F.coalesce(docs["text"].cast("string"), F.lit("")).rlike(f"[^{BLANKS}]")
    # Rows that are equal in all columns stand for one.
    one = mine.where(~blank).join(kept, ["__th", "__rh"], "left_semi").dropDuplicates(["__th", "__rh"])
    return one.unionByName(mine.where(blank)).select(*docs.columns)


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
