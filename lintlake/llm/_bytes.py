"""Texts as UTF-8 bytes on the Python side: Arrow UDFs over whole texts, word bounds, vectorised hashes of words and shingles."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

_UP = bytes(range(65, 91))
#: ASCII letters lower-cased; the other ASCII characters but digits become blanks.  Bytes from 0x80 on are letters.
WORDS = bytes(b + 32 if b in _UP else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: ASCII letters lower-cased, nothing else changed; bytes.split() then cuts at ASCII white space.
CASE = bytes(b + 32 if b in _UP else b for b in range(256))
#: Texts are handled in runs of about this many bytes, so that memory doesn't follow the size of a batch.
RUN = 1 << 20


def raw(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null as an empty text."""
    return [b or b"" for b in texts.cast(pa.large_binary()).to_pylist()]


def runs(texts: pa.Array):
    """Consecutive slices of a batch, each about RUN bytes or one longer text."""
    held, size = [], 0
    for i in range(0, len(texts), 64):
        for b in raw(texts.slice(i, 64)):
            held.append(b)
            size += len(b)
            if size >= RUN:
                yield held
                held, size = [], 0
    if held:
        yield held


def text_udf(fn, returns: str):
    """A column function over a text column; fn takes a list of bytes and returns an Arrow array (of the type `returns`) as long."""

    def apply(texts: pa.Array) -> pa.Array:
        done = [fn(part) for part in runs(texts)]
        return pa.concat_arrays(done) if done else fn([])

    return F.arrow_udf(apply, returns).asNondeterministic()


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes, a different one for each seed."""
    with np.errstate(over="ignore"):
        h = h ^ np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


#: Spans over so many bytes are hashed one by one.
LONG = 64
#: Masks that keep the first 0 to 8 bytes of a little-endian number.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of data: eight bytes at a time, each mixed in; long ones by BLAKE2b."""
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    h = mix(size.astype(np.uint64), 1)
    own = np.flatnonzero((size > 0) & (size <= LONG))
    at = 0
    with np.errstate(over="ignore"):
        while len(own):
            x = h[own] ^ (eight[starts[own] + at] & _MASKS[np.minimum(size[own] - at, 8)])
            x = x * np.uint64(0x9FB21C651E98DF25)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h[own] = x ^ (x >> np.uint64(29))
            at += 8
            own = own[size[own] > at]
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h, 4)


_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def word_bounds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in a row as bytes, where their white-space words start and end, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[data]
    before = np.concatenate(([True], blank[:-1]))
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return data, starts, ends, np.diff(np.concatenate(([0], np.searchsorted(starts, bounds))))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles (white-space words, ASCII lower case); one of all words if fewer, none if none.

    A shingle's hash is a sum of its words' hashes, each with a factor for its place, mixed.
    """
    data, starts, ends, counts = word_bounds([t.translate(CASE) for t in texts])
    words = span_hashes(data, starts, ends)
    place = mix(np.arange(k + 1, dtype=np.uint64), 8) | np.uint64(1)
    n = len(words)
    first = np.cumsum(counts) - counts
    few = (counts > 0) & (counts < k)
    with np.errstate(over="ignore"):
        sums = np.zeros(n, np.uint64)
        short = counts[few].astype(np.uint64) * place[k]
        for j in range(k):
            sums[: max(0, n - j)] += words[j:] * place[j]
            own = counts[few] > j
            short[own] += words[first[few][own] + j] * place[j]
        sums[first[few]] = short
    sums = mix(sums, 6)
    many = np.where(few, 1, np.maximum(counts - k + 1, 0))
    return [np.unique(sums[a : a + m]) for a, m in zip(first.tolist(), many.tolist(), strict=True)]
