"""Linear models from one pass: a Gram matrix is an aggregate, its solution a small problem on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.exprs import clip, total
from vellum.operators import held
from vellum.operators.quantiles import exact_quantiles
from vellum.session import Scratch, rows_of

BOUND = 8.0
#: Rows among which a permutation control deals targets.
BLOCK_ROWS = 100_000


@dataclass(frozen=True)
class Ridge:
    """Medians and interquartile scales of the inputs, and the coefficients (intercept first) on clipped robust z-scores."""

    columns: tuple[str, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    beta: tuple[float, ...]
    alpha: float


def robust_scaling(df: DataFrame, columns: list[str]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(median, interquartile range; 1 where that is 0) of each column, exact."""
    row = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).first()
    q = [[0.0 if x is None else x for x in row[f"{c}_q"]] for c in columns] if row else [[0.0, 0.0, 0.0]] * len(columns)
    return tuple(x[1] for x in q), tuple((x[2] - x[0]) or 1.0 for x in q)


def _scaled(columns, centre, scale):
    return [F.coalesce(clip((F.col(c) - m) / s, -BOUND, BOUND), F.lit(0.0)) for c, m, s in zip(columns, centre, scale, strict=True)]


def gram(df: DataFrame, inputs: list, target: str) -> np.ndarray:
    """Sums of products of (1, inputs, target) over the rows with a target: (p + 2) squared numbers, whatever the rows."""
    rows = df.where(F.col(target).isNotNull()).select(F.lit(1.0).alias("_0"), *[x.alias(f"_{i + 1}") for i, x in enumerate(inputs)], F.col(target).cast("double").alias(f"_{len(inputs) + 1}"))
    k = len(inputs) + 2
    sums = rows.agg(*[F.coalesce(F.sum(F.col(f"_{i}") * F.col(f"_{j}")), F.lit(0.0)).alias(f"{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = sums[f"{i}_{j}"]
    return g


def solve_ridge(g: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients with an unpenalised intercept."""
    a = g[:-1, :-1] + alpha * np.diag([0.0] + [1.0] * (len(g) - 2))
    return np.linalg.lstsq(a, g[:-1, -1], rcond=None)[0]


def fit_ridge(df: DataFrame, columns: list[str], target: str, alpha: float) -> Ridge:
    centre, scale = robust_scaling(df, columns)
    beta = solve_ridge(gram(df, _scaled(columns, centre, scale), target), alpha)
    return Ridge(tuple(columns), centre, scale, tuple(beta), alpha)


def predict(df: DataFrame, model: Ridge, out: str = "prediction") -> DataFrame:
    terms = [b * x for b, x in zip(model.beta[1:], _scaled(model.columns, model.centre, model.scale), strict=True)]
    return df.withColumn(out, F.lit(model.beta[0]) + total(terms))


def select_ridge(df: DataFrame, columns: list[str], target: str, split: str, alphas: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)) -> tuple[Ridge, dict[float, float]]:
    """The strength with the best validation rank correlation (the smaller on ties), refitted on development and validation rows.

    All strengths share one Gram matrix, and their validation scores one pass per strength over the validation rows.
    """
    from vellum.operators.ranks import spearman

    dev, val = df.where(F.col(split) == "dev"), df.where(F.col(split) == "validation")
    centre, scale = robust_scaling(dev, columns)
    g = gram(dev, _scaled(columns, centre, scale), target)
    scores = {}
    for a in alphas:
        model = Ridge(tuple(columns), centre, scale, tuple(solve_ridge(g, a)), a)
        scores[a] = spearman(predict(val, model), "prediction", target).first()["rho"] or 0.0
    best = max(alphas, key=lambda a: (scores[a], -a))
    return fit_ridge(df.where(F.col(split).isin("dev", "validation")), columns, target, best), scores


def coefficients(df: DataFrame, model: Ridge) -> DataFrame:
    """(feature, coefficient, importance_rank) by absolute size."""
    order = sorted(zip(model.columns, model.beta[1:], strict=True), key=lambda x: (-abs(x[1]), x[0]))
    return df.sparkSession.createDataFrame([(c, float(b), i + 1) for i, (c, b) in enumerate(order)], "feature string, coefficient double, importance_rank int")


def principal_components(df: DataFrame, column: str, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, variances, components as rows) of an array column, the largest variance first, from dims squared sums.

    Each component's entry of largest size is positive, so that signs don't depend on the solver.
    """
    cells = df.select(F.posexplode(column).alias("i", "x"), F.col(column).alias("v")).select("i", F.col("x").cast("double").alias("x"), "v")
    # one row per dimension holds its sum and its products with all others: dims rows of dims numbers
    rows = cells.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), *[F.sum(F.col("x") * F.col("v")[j].cast("double")).alias(f"p{j}") for j in range(dims)]).orderBy("i").collect()
    n, s = rows[0]["n"], np.array([r["s"] for r in rows])
    cov = (np.array([[r[f"p{j}"] for j in range(dims)] for r in rows]) - np.outer(s, s) / n) / (n - 1)
    values, vectors = np.linalg.eigh(cov)
    vectors = vectors[:, ::-1].T
    vectors = vectors * np.sign(vectors[np.arange(dims), np.abs(vectors).argmax(1)])[:, None]
    return s / n, values[::-1], vectors


def pca_variance(df: DataFrame, column: str, dims: int) -> DataFrame:
    """(component, variance, share): eigenvalues of the covariance of an array column."""
    _, values, _ = principal_components(df, column, dims)
    return df.sparkSession.createDataFrame([(i, float(v), float(v / values.sum())) for i, v in enumerate(values)], "component int, variance double, share double")


def pca_projection(df: DataFrame, column: str, dims: int, k: int) -> DataFrame:
    """``df`` with ``pc1`` to ``pc<k>``: coordinates of the array column on its first components. A NULL array has NULL coordinates."""
    mean, _, vectors = principal_components(df, column, dims)
    moved = F.zip_with(column, F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x.cast("double") - m)
    out = df.withColumn("_centred", moved)
    for i, v in enumerate(vectors[:k]):
        out = out.withColumn(f"pc{i + 1}", F.aggregate(F.zip_with("_centred", F.array(*[F.lit(float(x)) for x in v]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x))
    return out.drop("_centred")


def calibration_slope(x: str, y: str, alpha: float = 1.0):
    """Aggregates slope and intercept of the one-input ridge y = a + b x in closed form."""
    n, sx, sy = F.count(F.lit(1)), F.sum(x), F.sum(y)
    sxx, sxy = F.sum(F.col(x) * F.col(x)) - sx * sx / n, F.sum(F.col(x) * F.col(y)) - sx * sy / n
    slope = sxy / (sxx + alpha)
    return slope, sy / n - slope * sx / n


def experiment_grid(df: DataFrame, sets: dict[str, list[str]], target: str, split: str, alphas: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)) -> DataFrame:
    """(features, alpha, n_features, r2_dev, r2_validation) of every set of columns and every ridge strength.

    Two Gram matrices over all columns, of development and of validation rows, answer the whole grid: a model's squared error is a
    form in its coefficients.
    """
    columns = sorted({c for s in sets.values() for c in s})
    dev = df.where(F.col(split) == "dev")
    centre, scale = robust_scaling(dev, columns)
    inputs = _scaled(columns, centre, scale)
    grams = {k: gram(df.where(F.col(split) == k), inputs, target) for k in ("dev", "validation")}
    rows = []
    for name, chosen in sorted(sets.items()):
        keep = [0, *[columns.index(c) + 1 for c in sorted(chosen)], len(columns) + 1]
        small = {k: g[np.ix_(keep, keep)] for k, g in grams.items()}
        for a in alphas:
            b = np.append(solve_ridge(small["dev"], a), -1.0)
            r2 = []
            for k in ("dev", "validation"):
                g = small[k]
                spread = g[-1, -1] - g[0, -1] ** 2 / g[0, 0] if g[0, 0] else 0.0
                r2.append(float(1 - b @ g @ b / spread) if spread > 1e-12 * g[-1, -1] else None)
            rows.append((name, float(a), len(chosen), *r2))
    return df.sparkSession.createDataFrame(rows, "features string, alpha double, n_features int, r2_dev double, r2_validation double")


def permuted_products(df: DataFrame, key: str, inputs: list, target: str, draws: int, block: str | None = None, seed: int = 7) -> np.ndarray:
    """(draws, 1 + inputs): sums of (1, inputs) x the target dealt anew to the rows, once for each draw.

    Rows are dealt to blocks of about BLOCK_ROWS by hash, the values of ``block`` apart, and targets change places within a block:
    up to BLOCK_ROWS rows it is a permutation of all of them, beyond that one of each of many random samples. A block returns its
    sums, so all draws cost one pass and no row is copied.
    """
    k = len(inputs) + 1
    rows = df.where(F.col(target).isNotNull())
    blocks = max(1, round(rows.count() / BLOCK_ROWS))
    rows = rows.select((F.col(block).cast("string") if block else F.lit("")).alias("_b"), F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(blocks)).alias("_h"), F.xxhash64(key).alias("_o"), F.lit(1.0).alias("_0"), *[x.alias(f"_{i + 1}") for i, x in enumerate(inputs)], F.col(target).cast("double").alias("_y"))

    def deal(t: pa.Table) -> pa.Table:
        order = np.argsort(t["_o"].to_numpy(), kind="stable")
        x = np.stack([t[f"_{i}"].to_numpy()[order] for i in range(k)])
        y = t["_y"].to_numpy()[order]
        rng = np.random.default_rng([seed, int(t["_h"][0].as_py()), *t["_b"][0].as_py().encode()])
        sums = np.stack([x @ rng.permutation(y) for _ in range(draws)])
        return pa.table({"draw": np.repeat(np.arange(draws), k), "i": np.tile(np.arange(k), draws), "s": sums.ravel()})

    parts = rows.groupBy("_b", "_h").applyInArrow(deal, "draw bigint, i bigint, s double").groupBy("draw", "i").agg(F.sum("s").alias("s"))
    out = np.zeros((draws, k))
    for r in parts.collect():  # draws x inputs numbers
        out[r["draw"], r["i"]] = r["s"]
    return out


def permutation_control(df: DataFrame, key: str, columns: list[str], target: str, split: str, fit_on: tuple[str, ...], alpha: float, draws: int, block: str | None = None) -> DataFrame:
    """(split, n, rho, n_permutations, mean_rho, rho_q025, rho_q975, abs_rho_q975, max_abs_rho) of each split.

    ``rho``: rank correlation of the ridge probe fitted on ``fit_on`` with the target; the others: of probes fitted to permuted
    targets, all from one Gram matrix. With ``block`` targets only change places within its values.
    """
    from vellum.operators.ranks import spearman

    # written once, the descriptors are computed once for all passes
    scratch = Scratch(df.sparkSession, "control")
    rows = scratch.keep(df.where(F.col(target).isNotNull()).select(*dict.fromkeys([key, split, *columns, target, *([block] if block else [])])))
    fit = rows.where(F.col(split).isin(*fit_on))
    centre, scale = robust_scaling(fit, columns)
    inputs = _scaled(columns, centre, scale)
    g = gram(fit, inputs, target)
    found = {-1: solve_ridge(g, alpha)}
    for draw, products in enumerate(permuted_products(fit, key, inputs, target, draws, block)):
        again = g.copy()
        again[:-1, -1] = products
        found[draw] = solve_ridge(again, alpha)
    terms = [f"_{i}" for i in range(len(inputs) + 1)]
    cells = rows.where(F.col(split).isNotNull()).select(F.col(split).alias("_s"), F.col(target).cast("double").alias("y"), F.lit(1.0).alias("_0"), *[x.alias(t) for x, t in zip(inputs, terms[1:], strict=True)])
    points = scratch.keep(cells.groupBy("_s", "y", *terms).agg(F.count(F.lit(1)).alias("n")))
    if rows_of(points) <= held.HELD_POINTS:
        names = F.array(*[F.lit(r["_s"]) for r in points.select("_s").distinct().orderBy("_s").collect()])  # the splits
        numbered = points.withColumn("g", (F.array_position(names, F.col("_s")) - 1).cast("int"))
        ranked = held.rank_of_forms(numbered, terms, np.array(list(found.values())), np.ones(len(found)), 12)
        rho = ranked.select(F.get(names, F.col("g")).alias(split), (F.col("draw") - 1).cast("int").alias("draw"), "n", "rho")
    else:
        beta = df.sparkSession.createDataFrame([(d, [float(x) for x in b]) for d, b in found.items()], "draw int, beta array<double>")
        long = points.select(F.col("_s").alias(split), "y", "n", F.array(*terms).alias("_x")).crossJoin(F.broadcast(beta))  # draws rows
        guess = F.aggregate(F.zip_with("_x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        rho = spearman(long.select(split, "draw", "y", "n", F.round(guess, 12).alias("_p")), "_p", "y", split, "draw", weight="n")
    null = F.when(F.col("draw") >= 0, F.coalesce("rho", F.lit(0.0)))
    q = lambda c, p: F.percentile(c, p)
    return rho.groupBy(split).agg(
        F.max("n").alias("n"), F.max(F.when(F.col("draw") < 0, F.col("rho"))).alias("rho"), F.count(null).alias("n_permutations"), F.avg(null).alias("mean_rho"),
        q(null, 0.025).alias("rho_q025"), q(null, 0.975).alias("rho_q975"), q(F.abs(null), 0.975).alias("abs_rho_q975"), F.max(F.abs(null)).alias("max_abs_rho"),
    )


def fit_trees(df: DataFrame, columns: list[str], target: str, kind: str = "forest", trees: int = 20, depth: int = 5, seed: int = 7):
    """A random forest or boosted trees of ``pyspark.ml`` on the rows with a target; missing inputs count as 0. The model predicts into ``prediction``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    makers = {
        "forest": lambda: RandomForestRegressor(featuresCol="_features", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed),
        "boosted": lambda: GBTRegressor(featuresCol="_features", labelCol=target, maxIter=trees, maxDepth=min(depth, 3), seed=seed),
    }
    assembler = VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="error")
    rows = df.where(F.col(target).isNotNull()).fillna(0.0, subset=columns)
    return Pipeline(stages=[assembler, makers[kind]()]).fit(rows)
