"""Statistics of many draws over points that every task holds.

Where draws differ by weights or coefficients only, a table of points x draws says nothing that the points don't. Up to HELD_POINTS
of them go to the tasks once, as arrays, and draws are dealt to the tasks; a draw is then a sort or a few passes over arrays, and
nothing is shuffled. Callers take a row per point and draw beyond that.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import md5

#: Points that a task holds at most: of about 50 bytes each they are 150 MB, on the driver as well while they are sent.
HELD_POINTS = 3_000_000
#: Tasks for each core, so that the last ones are short.
ROUNDS = 4


def _poisson_limits() -> list[int]:
    """The least 32-bit hashes whose uniform number has a Poisson(1) multiplicity of 1, 2, ... 13, summed as ``resample.poisson_weight`` does."""
    out, term, cumulated = [], 0.36787944117144233, 0.36787944117144233
    for k in range(1, 14):
        out.append(math.ceil(cumulated * 2**32))
        term /= k
        cumulated += term
    return out


POISSON = _poisson_limits()


def per_draw(spark: SparkSession, draws: int, schema: str, values: dict[str, np.ndarray], compute: Callable[[dict[str, np.ndarray], np.ndarray], pa.Table]) -> DataFrame:
    """The rows of ``compute(values, draws)`` over all draws, some in each task; ``values`` are sent once to each executor."""
    sent = spark.sparkContext.broadcast(values)
    tasks = max(1, min(draws, ROUNDS * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [b.column(0).to_numpy() for b in batches]
        if mine and sum(map(len, mine)):
            yield from compute(sent.value, np.concatenate(mine)).to_batches()

    return spark.range(0, draws, 1, tasks).mapInArrow(run, schema)


def half_up(v: np.ndarray, places: int) -> np.ndarray:
    """``v`` x 10^places as whole numbers, rounded as Spark rounds: the shortest decimal of a double, halves away from zero."""
    big = v * 10.0**places
    out = np.rint(big)
    # where the product is as near to a half as its own error, the decimal digits decide
    with np.errstate(invalid="ignore"):
        near = np.flatnonzero(np.abs(np.abs(big - np.trunc(big)) - 0.5) <= 4e-16 * np.abs(big))
    for i in near[np.abs(big[near]) < 2.0**52]:
        out[i] = float(Decimal(repr(float(v[i]))).scaleb(places).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def centred_ranks(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mid-rank of each value among all, each standing for ``n`` rows, less the mean rank."""
    index = np.unique(values, return_inverse=True)[1]
    counts = np.bincount(index, n)
    return (np.cumsum(counts) - counts / 2.0)[index] - n.sum() / 2.0


def correlation(vx: float, vy: float, xy: float, n: float) -> float | None:
    """From sums of squares and products of centred ranks; None where :func:`vellum.functions.exprs.pearson` is NULL."""
    mean = n * ((n + 1) / 2.0) ** 2
    flat = vx <= 1e-12 * (vx + mean) or vy <= 1e-12 * (vy + mean)
    return None if flat else float(xy / (np.sqrt(vx) * np.sqrt(vy)))


def _form(inputs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """0 + the products, one after the other, as a row expression adds them."""
    out = np.zeros(inputs.shape[1])
    for x, w in zip(inputs, weights, strict=True):
        out += x * w
    return out


def _rank_forms(values: dict[str, np.ndarray], draws: np.ndarray, places: int) -> pa.Table:
    inputs, y, n, group = values["inputs"], values["y"], values["n"], values["group"]
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    rows = []
    for s, e in zip(starts, np.append(starts[1:], len(group)), strict=True):
        x, w = inputs[:, s:e], n[s:e]
        ry, total = centred_ranks(y[s:e], w), float(w.sum())
        wy = w * ry
        vy = float(wy @ ry)
        for d in draws:
            found = half_up(_form(x, values["weights"][d]) / values["divisors"][d], places)
            order = np.argsort(found)
            found, here = found[order], w[order]
            new = found[1:] != found[:-1]
            if np.isnan(found[-1]):  # missing numbers are one value, the largest
                new &= ~np.isnan(found[:-1])
            at = np.flatnonzero(np.append(True, new))
            counts = np.add.reduceat(here, at)
            ranks = np.cumsum(counts) - counts / 2.0 - total / 2.0
            rows.append((int(group[s]), int(d), int(total), correlation(float(counts @ (ranks * ranks)), vy, float(ranks @ np.add.reduceat(wy[order], at)), total)))
    return pa.table({k: pa.array(v, t) for k, v, t in zip(("g", "draw", "n", "rho"), zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)})


def rank_of_forms(points: DataFrame, inputs: list[str], weights: np.ndarray, divisors: np.ndarray, places: int) -> DataFrame:
    """(g, draw, n, rho): for each draw, the rank correlation of round(inputs @ weights / divisor, places) with ``y`` in each group.

    ``points`` (g int, y, n and ``inputs``) stand for n rows each and are at most HELD_POINTS.
    """
    t = points.select("g", "y", "n", *inputs).toArrow().sort_by("g")
    column = lambda c: t[c].to_numpy()
    values = {
        "group": column("g"), "y": column("y").astype(float), "n": column("n").astype(float), "inputs": np.array([column(c) for c in inputs], float),
        "weights": np.asarray(weights, float), "divisors": np.asarray(divisors, float),
    }
    schema = "g int, draw bigint, n bigint, rho double"
    if not t.num_rows:
        return points.sparkSession.createDataFrame([], schema)
    return per_draw(points.sparkSession, len(weights), schema, values, lambda held, draws: _rank_forms(held, draws, places))


def _steps(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(order, high, runs, groups) of each bit of the numbered values ``y``, the highest first, as :func:`ranks.concordance` takes them.

    In ``order``, points whose y agree in the higher bits are a group, sorted by x; ``high`` tells whose bit is set. ``runs`` are the
    starts of equal x within a group and the end, ``groups`` the places in ``runs`` where groups start and end.
    """
    by_x = np.argsort(x, kind="stable")
    for bit in reversed(range(int(y.max(initial=0)).bit_length())):
        order = by_x[np.argsort((y[by_x] >> (bit + 1)).astype(np.min_scalar_type(int(y.max()))), kind="stable")]
        group, xs = y[order] >> (bit + 1), x[order]
        start = np.append(True, group[1:] != group[:-1])
        runs = np.flatnonzero(start | np.append(True, xs[1:] != xs[:-1]))
        yield order.astype(np.int32), (y[order] >> bit & 1).astype(bool), np.append(runs, len(x)), np.append(np.flatnonzero(start[runs]), len(runs))


def _concordances(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> list[int]:
    """Of each row of weights, the sum over all pairs of points of sign(dx) sign(dy) w w'. What depends on the points alone is told once for all."""
    out = [0] * len(weights)
    if len(np.unique(x)) < len(np.unique(y)):
        x, y = y, x  # fewer bits
    for order, high, runs, groups in _steps(x, y):
        upto, low = np.zeros(len(x) + 1, np.int64), np.zeros(len(x) + 1, np.int64)
        for i, w in enumerate(weights):
            mine = w[order]
            np.cumsum(mine, out=upto[1:], dtype=np.int64)
            np.cumsum(np.where(high, 0, mine), out=low[1:], dtype=np.int64)
            lows = low[runs]
            highs = upto[runs] - lows
            # a point whose bit is set meets the low ones before its run and, the other way round, those after it
            met = np.diff(highs) @ (lows[:-1] + lows[1:])
            edge = lows[groups]
            out[i] += int(met - np.diff(highs[groups]) @ (edge[:-1] + edge[1:]))
    return out


#: Weights of a task's draws at a time: a byte each.
WEIGHTS = 32_000_000


def _bootstrap(values: dict, draws: np.ndarray, salt: str) -> pa.Table:
    x, y, x_at, y_at, point, keys = (values[k] for k in ("x", "y", "x_at", "y_at", "point", "keys"))
    first = np.flatnonzero(np.append(True, point[1:] != point[:-1]))  # rows are sorted by point
    n_x, n_y = int(x_at.max()) + 1, int(y_at.max()) + 1
    limits = [np.uint32(t) for t in POISSON if t < 2**32]
    moments = np.stack([np.ones(len(x)), x, y, x * x, y * y, x * y], axis=1)
    rows = []
    each = max(1, WEIGHTS // len(x))
    for some in (draws[i : i + each] for i in range(0, len(draws), each)):
        taken = np.zeros((len(some), len(x)), np.uint8)
        for s in range(0, len(x), md5.CHUNK):
            suffixes = md5.Suffixes(keys[s : s + md5.CHUNK])
            for i, d in enumerate(some):
                h = suffixes.heads(f"{salt}:{d}".encode())
                w = taken[i, s : s + len(h)]
                for limit in limits:
                    w += h >= limit
        at_points = np.add.reduceat(taken, first, axis=1, dtype=np.int32)
        signs = _concordances(x_at[first], y_at[first], at_points)
        for i, d in enumerate(some):
            w = taken[i].astype(float)
            n = float(w.sum())
            if not n:
                continue
            tx, ty = np.bincount(x_at, w, n_x), np.bincount(y_at, w, n_y)
            rx, ry = (np.cumsum(t) - t / 2.0 - n / 2.0 for t in (tx, ty))
            rho = correlation(float(tx @ (rx * rx)), float(ty @ (ry * ry)), float(w @ (rx[x_at] * ry[y_at])), n)
            _, sx, sy, sxx, syy, sxy = w @ moments
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            r = None if vx <= 1e-12 * sxx or vy <= 1e-12 * syy else float((sxy - sx * sy / n) / (np.sqrt(vx) * np.sqrt(vy)))
            pairs = n * (n - 1) / 2
            apart = np.sqrt(pairs - float((tx * (tx - 1)).sum()) / 2) * np.sqrt(pairs - float((ty * (ty - 1)).sum()) / 2)
            rows += [("rho", int(d), rho), ("r", int(d), r), ("tau", int(d), signs[i] / apart if apart else None)]
    return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("statistic", pa.string()), ("draw", pa.int32()), ("value", pa.float64())))})


def bootstrap_correlations(points: DataFrame, draws: int, salt: str) -> DataFrame:
    """(statistic, draw, value) as ``resample.iid_bootstrap_correlations`` returns it, of rows (x, y, suffix), at most HELD_POINTS.

    ``suffix`` is what follows salt:draw in the string whose hash tells the weight of a row in a draw.
    """
    schema = "statistic string, draw int, value double"
    t = points.select("x", "y", F.col("suffix").cast("binary").alias("suffix")).toArrow()
    if not t.num_rows:
        return points.sparkSession.createDataFrame([], schema)
    x, y = t["x"].to_numpy(), t["y"].to_numpy()
    x_at, y_at = (np.unique(v, return_inverse=True)[1].astype(np.int32) for v in (x, y))
    order = np.lexsort((y_at, x_at))
    x_at, y_at = x_at[order], y_at[order]
    point = np.cumsum(np.append(False, (x_at[1:] != x_at[:-1]) | (y_at[1:] != y_at[:-1])), dtype=np.int32)
    keys = t["suffix"].combine_chunks().take(pa.array(order))
    values = {"x": x[order], "y": y[order], "x_at": x_at, "y_at": y_at, "point": point, "keys": keys}
    return per_draw(points.sparkSession, draws, schema, values, lambda held, some: _bootstrap(held, some, salt))
