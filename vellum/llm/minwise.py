"""Pairs of similar 64-bit hashes across two sides by minwise signatures in banded buckets.

A hash is the set of its 64 shingles (position, bit), out of 128. Hashes that differ in d bits have the Jaccard similarity
J = (64 - d) / (64 + d), and under a random order of the 128 shingles the first one present is the same in both with
probability J: that first one is a minwise hash. A band of ``first`` of them names a bucket; inside it, second bands of ``second`` more
narrow the candidates. So a hash is shuffled once for each bucket band, and the second bands are enumerated inside the task
by sorting. Only candidates with one hash on either side are verified, by their exact similarity.

A pair at the least similarity asked for is missed with a probability of ``miss`` at most (closer pairs far more seldom):
:func:`choose_bands` takes the cheapest bands that keep it. Orders are seeded, so results are the same on every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Seconds to shuffle a hash, to compute one minwise hash, to sort one hash for one band, and to verify a candidate pair.
SHUFFLE_COST, HASH_COST, SORT_COST, VERIFY_COST = 1e-6, 20e-9, 100e-9, 10e-9
#: Hashes that the largest bucket of a band should hold: the first shingle of an order is present in half of all hashes.
BUCKET_ROWS = 3_000_000
#: Probability with which a pair at the least similarity may be missed.
MISS = 1e-5
#: Similarity of random hashes, which differ in half of their bits.
CHANCE = 1 / 3


@dataclass(frozen=True)
class Bands:
    """``buckets`` bands of ``first`` minwise hashes, each with ``inner`` second bands of ``second``."""

    buckets: int
    first: int
    inner: int
    second: int

    def recall(self, similarity: float) -> float:
        inside = 1 - (1 - similarity**self.second) ** self.inner
        return 1 - (1 - similarity**self.first * inside) ** self.buckets


def similarity_of(radius: int) -> float:
    return (64 - radius) / (64 + radius)


def choose_bands(n: int, radius: int, miss: float = MISS) -> Bands:
    """The cheapest bands for ``n`` hashes that miss a pair ``radius`` bits apart with probability ``miss`` at most."""
    j = similarity_of(radius)
    first = max(1, ceil(log2(max(n, 1) / BUCKET_ROWS)) + 1)
    best = None
    for second in range(1, 17):
        for inner in range(1, 41):
            caught = j**first * (1 - (1 - j**second) ** inner)
            buckets = ceil(log(miss) / log(1 - caught)) if caught < 1 else 1
            work = buckets * (SHUFFLE_COST + first * HASH_COST + inner * (second * HASH_COST + SORT_COST))
            cost = n * work + n * n / 2 * CHANCE ** (first + second) * buckets * inner * VERIFY_COST
            if best is None or cost < best[0]:
                best = cost, Bands(buckets, first, inner, second)
    return best[1]


def shingle_order(band: int, k: int) -> np.ndarray:
    """The seeded order of the 128 shingles of the k-th minwise hash of a band, as 2 x position + bit."""
    return np.random.default_rng([band, k]).permutation(128)


def quarters(bits: np.ndarray) -> np.ndarray:
    """The hashes in four rows of 16 bits each, the lowest first."""
    return np.ascontiguousarray(np.stack([bits >> np.uint64(16 * q) & np.uint64(0xFFFF) for q in range(4)]).astype(np.uint16))


def minwise(parts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Place in ``order`` of the first shingle that each hash has, from the :func:`quarters` of the hashes.

    Each quarter looks its own first shingle up in a table of 2^16 entries, which two tables of 2^8 make in one step.
    """
    place = np.empty(128, np.uint8)
    place[order] = np.arange(128)
    byte = np.arange(256)
    # first place among the 8 positions of each byte, for each value that it may have
    by_byte = np.stack([np.minimum.reduce([place[2 * (8 * k + i) + (byte >> i & 1)] for i in range(8)]) for k in range(8)])
    out = None
    for q in range(4):
        found = np.minimum.outer(by_byte[2 * q + 1], by_byte[2 * q]).ravel()[parts[q]]
        out = found if out is None else np.minimum(out, found, out=out)
    return out


def band_key(parts: np.ndarray, band: int, at: int, size: int) -> np.ndarray:
    """``size`` minwise hashes of a band, from the ``at``-th on, as one number; seven bits each, mixed beyond nine."""
    key = np.zeros(parts.shape[1], np.uint64)
    for k in range(at, at + size):
        found = minwise(parts, shingle_order(band, k)).astype(np.uint64)
        key = key * np.uint64(128) + found if size <= 9 else (key ^ found + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return key


def bucket_lanes(plan: Bands, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each band the (keys, partitions) of its larger buckets, dealt so that all partitions hold about as much: the largest
    first, each to the emptiest. How large they are is read off random bits; buckets of less than an eighth of a partition are
    left to chance."""
    bits = np.random.default_rng(0).integers(0, 1 << 64, 1 << 14, dtype=np.uint64)
    sampled, large = quarters(bits), []
    for band in range(plan.buckets):
        keys, counts = np.unique(band_key(sampled, band, 0, plan.first), return_counts=True)
        share = counts / len(bits)
        large += [(p, band, k) for p, k in zip(share.tolist(), keys.tolist(), strict=True) if p >= max(plan.buckets / parts / 8, 8 / len(bits))]
    load = [(0.0, i) for i in range(parts)]
    lanes: list[dict[int, int]] = [{} for _ in range(plan.buckets)]
    for p, band, key in sorted(large, reverse=True):
        held, at = heappop(load)
        lanes[band][key] = at
        heappush(load, (held + p, at))
    return [(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)], np.int32)) for d in lanes]


def _candidates(key: np.ndarray, bits: np.ndarray, side: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs with one key that cross the sides and are similar enough: within ``radius`` bits, which is the exact similarity."""
    order = np.argsort(key)
    key, bits, side = key[order], bits[order], side[order]
    ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(key))
    at, d = np.flatnonzero(left > 1), 1
    while len(at):
        for s in range(0, len(at), 1 << 20):
            i = at[s : s + (1 << 20)]
            j = i + d
            cross = ((side[i] & 1) & (side[j] >> 1)) | ((side[j] & 1) & (side[i] >> 1))
            i, j = i[cross > 0], j[cross > 0]
            near = np.bitwise_count(bits[i] ^ bits[j]) <= radius
            if near.any():
                yield bits[i[near]], bits[j[near]]
        d += 1
        at = at[left[at] > d]


def minwise_pairs(hashes: DataFrame, radius: int = 8, n: int | None = None, bands: Bands | None = None) -> DataFrame:
    """Pairs (bits_a < bits_b, signed) of different hashes of ``radius`` bits or less between the sides, each once.

    ``hashes``: column ``bits`` (BIGINT, distinct, not NULL) and ``side``, of which bit 1 and bit 2 say on which sides the hash
    occurs. ``n``: the number of rows, if known. Empty input gives an empty result; further columns are ignored.
    """
    n = hashes.count() if n is None else n
    plan = bands or choose_bands(n, radius)

    parts = max(int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * plan.buckets // BUCKET_ROWS))
    lanes = bucket_lanes(plan, parts)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = quarters(batch.column(0).to_numpy().view(np.uint64))
            for band in range(plan.buckets):
                key = band_key(bits, band, 0, plan.first)
                lane = ((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
                known, dealt = lanes[band]
                if len(known):
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    lane = np.where(known[at] == key, dealt[at], lane)
                yield pa.RecordBatch.from_arrays([pa.array(lane), pa.array(np.full(batch.num_rows, band, np.int32)), pa.array(key.view(np.int64)), batch.column(0), batch.column(1)], ["lane", "band", "bucket", "bits", "side"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(batches)
        if not kept:
            return
        t = pa.Table.from_batches(kept)
        band, bucket, bits, side = (t[c].to_numpy() for c in ("band", "bucket", "bits", "side"))
        bucket, bits = bucket.view(np.uint64), bits.view(np.uint64)
        for b in np.unique(band).tolist():
            mine = band == b
            x, s, k = bits[mine], side[mine], bucket[mine]
            found, sets = [], quarters(x)
            for inner in range(plan.inner):
                key = band_key(sets, b, plan.first + inner * plan.second, plan.second)
                key = (key ^ (k * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)  # as good as one number: a clash costs a look
                found += [np.stack([np.minimum(u.view(np.int64), v.view(np.int64)), np.maximum(u.view(np.int64), v.view(np.int64))], 1) for u, v in _candidates(key, x, s, radius)]
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["bits_a", "bits_b"])

    rows = hashes.select("bits", hashes["side"].cast("tinyint").alias("side")).mapInArrow(buckets, "lane int, band int, bucket bigint, bits bigint, side tinyint")
    return rows.repartitionById(parts, "lane").mapInArrow(verify, "bits_a bigint, bits_b bigint").distinct()
