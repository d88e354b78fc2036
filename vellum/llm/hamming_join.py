"""All pairs of 64-bit hashes within a Hamming distance, as a heavy-light set join.

A hash is read as the set of its tokens (block number, block value) over ``m`` blocks. Two hashes at distance
``radius`` or less differ in at most ``radius`` blocks, so their sets overlap in at least ``c = m - radius`` tokens:
the overlap join with threshold ``c`` finds every pair, without exception.

* **Enumeration.** Every c-subset of the tokens is a join key. Subsets are laid out by their first token, so that a hash
  is shuffled once per first token (``radius + 1`` times) and the rest of the subset is enumerated inside the task,
  where one sort of the bit-permuted hashes lines up all rows that share the subset.
* **Size-aware boundary.** All sets hold ``m`` tokens, so what separates light from heavy is the length of the inverted
  lists a set belongs to. Lists up to the boundary are enumerated in one task. A longer one is refined by the next token of
  the subset; a list still too long is scanned: cut into chunks, every pair of chunks is one task.
* **Cost.** ``m`` is picked by the model in :func:`choose_blocks`, which weighs sorting the C(m, c) subsets against
  verifying the pairs that random hashes leave in their lists. The boundary is the length at which enumerating a list would take
  a core's fair share of all that sorting (:func:`heavy_boundary`), so that no task outlasts the others.

A pair is reported by the first subset it shares only, so no pass over the found pairs is needed to make them distinct.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds to sort one hash for one subset, and to verify one candidate pair.
SORT_COST, VERIFY_COST = 30e-9, 4e-9
#: Hashes one task should hold: a list is never longer in one.
TASK_ROWS = 3_000_000
#: Lists that cost less to enumerate than to start another task aren't heavy, however few hashes there are.
TASK_COST = 0.05


def block_widths(m: int) -> list[int]:
    """64 bits cut into ``m`` blocks as equal as can be, wide ones first."""
    return [64 // m + (i < 64 % m) for i in range(m)]


def block_shifts(m: int) -> list[int]:
    shifts, at = [], 64
    for w in block_widths(m):
        at -= w
        shifts.append(at)
    return shifts


def choose_blocks(n: int, radius: int) -> int:
    """Number of blocks with the least estimated cost for ``n`` distinct hashes."""

    def cost(m: int) -> float:
        widths, c = block_widths(m), m - radius
        lists = sum(2.0 ** -sum(widths[i] for i in s) for s in combinations(range(m), c))
        return n * comb(m, c) * SORT_COST + n * n / 2 * lists * VERIFY_COST

    return min(range(radius + 1, min(64, radius + 6) + 1), key=cost)


def heavy_boundary(n: int, m: int, radius: int, slots: int) -> int:
    """Longest list, by its first token, that is enumerated in one task: the fair share of each of ``slots`` cores, in memory's bounds."""
    c = m - radius
    inside = comb(m - 1, c - 1) * SORT_COST  # subsets that begin with the first block, the dearest list
    share = n * comb(m, c) * SORT_COST / slots
    return max(2, min(TASK_ROWS, int(max(share, TASK_COST) / inside)))


def _value(bits: Column, m: int, j: int) -> Column:
    return F.shiftrightunsigned(bits, block_shifts(m)[j]).bitwiseAND(F.lit((1 << block_widths(m)[j]) - 1))


def _heavy(hashes: DataFrame, m: int, prefixes: list[tuple[int, ...]], longest: int) -> dict:
    """Inverted lists longer than ``longest``: (prefix, values) -> length. Counts are at most one per possible token tuple."""
    keys = F.array(*[F.struct(F.lit(p).alias("p"), F.array(*[_value(F.col("bits"), m, j) for j in s]).alias("v")) for p, s in enumerate(prefixes)])
    counts = hashes.select(F.explode(keys).alias("k")).groupBy("k.p", "k.v").agg(F.count(F.lit(1)).alias("n"))
    return {(prefixes[r["p"]], tuple(r["v"])): r["n"] for r in counts.where(F.col("n") > longest).collect()}


def _tasks(hashes: DataFrame, m: int, c: int, n: int, longest: int) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """Rows (task, spot, half, bits, side): ``task`` names the prefix of the subset (and chunks), ``spot`` the values."""
    bits = F.col("bits")
    firsts = [(j,) for j in range(m - c + 1)]
    prefixes: list[tuple[int, ...]] = list(firsts)
    heavy1 = _heavy(hashes, m, firsts, longest) if n > longest else {}
    heavy2: dict = {}
    if heavy1 and c > 1:
        deeper = sorted({(s[0], k) for s, _ in heavy1 for k in range(s[0] + 1, m - c + 2)})
        prefixes += deeper
        heavy2 = _heavy(hashes, m, deeper, longest)

    def spot(s: tuple[int, ...]) -> Column:
        at = F.lit(0).cast("bigint")
        for j in s:
            at = F.shiftleft(at, 16).bitwiseOR(_value(bits, m, j))
        return at

    def held(s: tuple[int, ...], heavy: dict) -> Column:
        values = [v for t, v in heavy if t == s]
        if not values:
            return F.lit(False)
        at = F.lit(0).cast("bigint")
        for j in s:
            at = F.shiftleft(at, 16).bitwiseOR(_value(bits, m, j))
        packed = []
        for v in values:
            x = 0
            for y in v:
                x = x << 16 | y
            packed.append(x)
        return at.isin(packed)

    def entry(p: int, s: tuple[int, ...], chunk: Column, half: Column) -> Column:
        return F.struct((F.lit(p).cast("bigint") * (1 << 40) + chunk).alias("task"), spot(s).alias("spot"), half.cast("tinyint").alias("half"))

    zero = F.lit(0)
    out = []
    for p, s in enumerate(prefixes):
        heavy = heavy1 if len(s) == 1 else heavy2
        scanned = len(s) == min(2, c)
        asked = held(s[:1], heavy1) if len(s) == 2 else F.lit(True)
        is_heavy = held(s, heavy)
        out.append(F.when(asked & ~is_heavy, F.array(entry(p, s, zero.cast("bigint"), zero))))
        if heavy and scanned:
            k = -(-max((n for t, n in heavy.items() if t[0] == s), default=0) // (longest // 2))
            if k:
                mine = F.pmod(F.xxhash64(bits), F.lit(k)).cast("bigint")
                pairs = F.transform(
                    F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")),
                    lambda t: F.struct(
                        (F.lit(p).cast("bigint") * (1 << 40) + 1 + F.least(mine, t) * k + F.greatest(mine, t)).alias("task"),
                        spot(s).alias("spot"),
                        F.when(mine > t, 2).otherwise(F.when(mine < t, 1).otherwise(0)).cast("tinyint").alias("half"),
                    ),
                )
                out.append(F.when(asked & is_heavy, pairs))
    none = F.array().cast("array<struct<task:bigint,spot:bigint,half:tinyint>>")
    rows = hashes.select("bits", "side", F.explode(F.concat(*[F.coalesce(o, none) for o in out])).alias("e"))
    return rows.select("e.task", "e.spot", "e.half", "bits", "side"), prefixes


def _pairs_of(y: np.ndarray, key_bits: int, half: np.ndarray | None, side: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted ``y`` whose top ``key_bits`` agree and that lie within ``radius``."""
    key = y >> np.uint64(64 - key_bits) if key_bits < 64 else y
    ends = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) + 1
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(y))  # rows from here to the end of the run
    at, d = np.flatnonzero(left > 1), 1
    while len(at):
        for s in range(0, len(at), 1 << 20):
            i = at[s : s + (1 << 20)]
            j = i + d
            if side is not None:  # keep only candidates that cross the sides
                cross = ((side[i] & 1) & (side[j] >> 1)) | ((side[j] & 1) & (side[i] >> 1))
                i, j = i[cross > 0], j[cross > 0]
            if half is not None:
                apart = half[i] != half[j]
                i, j = i[apart], j[apart]
            near = np.bitwise_count(y[i] ^ y[j]) <= radius
            if near.any():
                yield i[near], j[near]
        d += 1
        at = at[left[at] > d]


def _permute(x: np.ndarray, order: list[int], m: int) -> np.ndarray:
    """Blocks of ``x`` moved to the given order, first block on top."""
    widths, shifts = block_widths(m), block_shifts(m)
    out, at = np.zeros_like(x), 64
    for j in order:
        at -= widths[j]
        out |= ((x >> np.uint64(shifts[j])) & np.uint64((1 << widths[j]) - 1)) << np.uint64(at)
    return out


def find_in_task(bits: np.ndarray, half: np.ndarray | None, side: np.ndarray | None, prefix: tuple[int, ...], m: int, c: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of hashes that share ``prefix`` and, as first c-subset, one that begins with it."""
    widths, shifts = block_widths(m), block_shifts(m)
    for rest in combinations(range(prefix[-1] + 1, m), c - len(prefix)):
        subset = (*prefix, *rest)
        order = [*subset, *(j for j in range(m) if j not in subset)]
        y = _permute(bits, order, m)
        if side is None and half is None:
            y.sort()
            src = None
        else:
            src = np.argsort(y)
            y = y[src]
        for i, j in _pairs_of(y, sum(widths[b] for b in subset), None if half is None else half[src], None if side is None else side[src], radius):
            if src is None:
                # the permuted word holds block order[k] at place k: undo it for the few pairs found
                a, b = np.zeros(len(i), np.uint64), np.zeros(len(i), np.uint64)
                at = 64
                for k in order:
                    at -= widths[k]
                    mask = np.uint64((1 << widths[k]) - 1)
                    a |= ((y[i] >> np.uint64(at)) & mask) << np.uint64(shifts[k])
                    b |= ((y[j] >> np.uint64(at)) & mask) << np.uint64(shifts[k])
            else:
                a, b = bits[src[i]], bits[src[j]]
            x = a ^ b
            first = np.ones(len(x), bool)
            for k in range(subset[-1]):
                if k not in subset:  # an earlier shared block makes another subset the first
                    first &= ((x >> np.uint64(shifts[k])) & np.uint64((1 << widths[k]) - 1)) != 0
            if first.any():
                yield a[first], b[first]


def near_pairs(hashes: DataFrame, radius: int = 8, m: int | None = None, list_rows: int | None = None, across: bool = False, n: int | None = None) -> DataFrame:
    """Pairs (bits_a < bits_b, signed) of different hashes at Hamming distance ``radius`` or less.

    ``hashes``: column ``bits`` (BIGINT, distinct, not NULL); with ``across``, also ``side``: bit 1 and bit 2 say on which of two
    sides the hash occurs, and only pairs with one hash on either side are candidates. ``n``: the number of rows, if known;
    ``m`` and ``list_rows`` override the choices of the cost model.
    Empty input gives an empty result; further columns are ignored.
    """
    spark = hashes.sparkSession
    n = hashes.count() if n is None else n
    m = choose_blocks(n, radius) if m is None else m
    c = m - radius
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    list_rows = heavy_boundary(n, m, radius, slots) if list_rows is None else list_rows
    hashes = hashes.select("bits", (F.col("side") if across else F.lit(0)).cast("tinyint").alias("side"))
    rows, prefixes = _tasks(hashes, m, c, n, list_rows)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * (radius + 1) // TASK_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(batches)
        if not kept:
            return
        t = pa.Table.from_batches(kept)
        del kept
        task, half = t["task"].to_numpy(), t["half"].to_numpy()
        bits, side = t["bits"].to_numpy().view(np.uint64), t["side"].to_numpy()
        del t
        order = np.argsort(task, kind="stable")
        cuts = np.flatnonzero(np.diff(task[order], prepend=-1)) if len(order) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
            rows_ = order[lo:hi]
            h = half[rows_] if task[order[lo]] & ((1 << 40) - 1) else None
            if h is not None and not h.any():
                h = None  # a chunk with itself
            for a, b in find_in_task(bits[rows_], h, side[rows_] if across else None, prefixes[task[order[lo]] >> 40], m, c, radius):
                a, b = a.view(np.int64), b.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["bits_a", "bits_b"])

    return rows.repartition(parts, "task", "spot").mapInArrow(run, "bits_a bigint, bits_b bigint")
