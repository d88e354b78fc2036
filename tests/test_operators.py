import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import distributions, exprs
from vellum.operators import dedup, generate, health, joins, manifest, models, quantiles, ranks, resample, scoring, skew, stats
from vellum.session import Scratch
from vellum.sources import io


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_clip_keeps_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-9.0,), (9.0,), (float("inf"),)], "x double")
    out = [r[0] for r in df.select(exprs.clip(F.col("x"), -4.0, 4.0)).collect()]
    assert out[0] is None and math.isnan(out[1]) and out[2:] == [-4.0, 4.0, 4.0]


def test_normal_cdf_matches_erf(spark):
    xs = [-8.0, -3.0, -2.5, -1.0, -0.1, 0.0, 0.3, 1.7, 2.49, 2.51, 4.0, 7.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", exprs.normal_cdf(F.col("x")).alias("p"))
    for r in df.collect():
        assert abs(r["p"] - 0.5 * (1 + math.erf(r["x"] / math.sqrt(2)))) < 1e-12


def test_stable_seed_is_the_first_four_bytes(spark):
    got = spark.range(1).select(exprs.stable_seed(F.lit('{"a": 1}'))).first()[0]
    assert got == int.from_bytes(hashlib.sha256(b'{"a": 1}').digest()[:4], "big")


def test_pearson_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "x double, y double")
    row = df.agg(exprs.pearson_agg(F.col("x"), F.col("y")).alias("a"), exprs.pearson_agg(F.col("x"), F.col("x")).alias("b")).first()
    assert row["a"] is None and abs(row["b"] - 1) < 1e-12


def test_scores_stay_in_bounds_and_dead_input_is_named(spark):
    rows = [(i, "dev" if i % 2 else "test", float(i), 5.0 if i else None) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, split string, a double, b double")
    spec = {"m": {"a": (0.7, "g"), "b": (0.3, "h")}}
    out = scoring.score(df, spec, "split = 'dev'", contributions=True).collect()
    assert all(0 <= r["m"] <= 100 for r in out)
    report = health.weighted_feature_health(df, spec, "split = 'dev'")
    with pytest.raises(ValueError, match="m/b"):
        health.assert_healthy(report)
    kept = health.retained_weight(report).first()
    assert abs(kept["retained_share"] - 0.7) < 1e-12
    with pytest.raises(ValueError, match="missing"):
        health.weighted_feature_health(df, {"m": {"zz": (1.0, "g")}})
    with pytest.raises(ValueError, match="m/a, m/b"):  # nothing to judge them by
        health.assert_healthy(health.weighted_feature_health(df.where("false"), spec))


def test_fill_policies(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    constants = scoring.fit_constants(df, ["x"], median=True)
    last = {fill: [r["x_z"] for r in scoring.standardise(df, ["x"], constants, fill).collect()][2] for fill in ("none", "zero", "raw_median")}
    assert last == {"none": None, "zero": 0.0, "raw_median": 2.0}
    with pytest.raises(ValueError, match="fill"):
        scoring.standardise(df, ["x"], constants, "other")


def test_score_distribution_counts_ties_and_bounds(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (20.0,), (100.0,)], "score double")
    r = health.score_distribution(df, ["score"]).first()
    assert (r["n_unique"], r["largest_tie"], r["lower_mass"], r["upper_mass"]) == (3, 0.5, 0.5, 0.25)


def test_rank_equivalence_finds_the_reversed_column(spark):
    df = spark.createDataFrame([(0.1, 0.9, 3.0), (0.4, 0.6, 1.0), (0.2, 0.8, 9.0), (0.7, 0.3, 2.0)], "symmetry double, one_minus double, independent double")
    assert values(health.rank_equivalent_pairs(df, ["symmetry", "one_minus", "independent"]), "a", "b", "direction") == [("one_minus", "symmetry", "reversed")]


@pytest.mark.parametrize("n", [1, 7, 500])
def test_mid_ranks_with_ties(spark, n):
    rng = np.random.default_rng(n)
    xs = rng.integers(0, max(2, n // 3), n).astype(float)
    got = {r["x"]: (r["n"], r["rank"]) for r in ranks.mid_ranks(spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double"), "x").collect()}
    for x in set(xs):
        assert got[x] == ((xs == x).sum(), (xs < x).sum() + ((xs == x).sum() + 1) / 2)


def test_spearman_is_invariant_under_monotone_maps(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(a + b)) for a, b in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "x double, y double").withColumn("z", F.exp("y"))
    a, b = (ranks.spearman(df, "x", c).first()["rho"] for c in ("y", "z"))
    assert abs(a - b) < 1e-12 and 0 < a < 1
    assert ranks.spearman(df.withColumn("c", F.lit(1.0)), "x", "c").first()["rho"] is None


def test_bh_is_monotone_and_rejects_missing(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.9,)], "p double")
    q = {r["p"]: r["q"] for r in ranks.benjamini_hochberg(df, "p").collect()}
    assert abs(q[0.01] - 0.04) < 1e-12 and abs(q[0.03] - 0.16 / 3) < 1e-12 and q[0.04] == q[0.03] and q[0.9] == 0.9
    assert ranks.benjamini_hochberg(df.where("p > 2"), "p").count() == 0
    with pytest.raises(Exception, match="must not be missing"):
        ranks.benjamini_hochberg(spark.createDataFrame([(0.1,), (None,)], "p double"), "p").collect()


def test_kendall_with_ties(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (3, 3), (4, 1)], "x int, y int")
    xs = [(1, 1), (2, 2), (2, 3), (3, 3), (4, 1)]
    s = sum(np.sign(a[0] - b[0]) * np.sign(a[1] - b[1]) for i, a in enumerate(xs) for b in xs[i + 1 :])
    want = s / math.sqrt((10 - 1) * (10 - 2))
    assert abs(ranks.kendall_tau_b(df, "x", "y").first()["tau"] - want) < 1e-12


def test_distribution_tails():
    assert abs(distributions.t_two_sided(2.0, 10) - 0.07338803477074039) < 1e-10
    assert abs(distributions.f_upper(3.0, 2, 12) - 0.08779149519890262) < 1e-10
    assert abs(distributions.chi2_upper(5.0, 3) - 0.1717971442967335) < 1e-10
    assert abs(1 - distributions.f_upper(distributions.f_quantile(0.95, 4, 9), 4, 9) - 0.95) < 1e-10
    assert abs(distributions.normal_quantile(0.975) - 1.959963984540054) < 1e-9


def test_icc_of_a_hand_case(spark):
    # the table of Shrout and Fleiss (1979): ICC(2,1) = .29, ICC(2,k) = .62
    table = [(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]
    df = spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(table) for j, x in enumerate(r)], "s int, r int, x double")
    r = stats.icc_agreement(df, "s", "r", "x").first()
    assert round(r["icc1"], 2) == 0.29 and round(r["icck"], 2) == 0.62 and r["low"] < r["icc1"] < r["high"] and r["p"] < 0.001


def test_shapiro_of_normal_and_skewed():
    x = np.random.default_rng(0).normal(size=100)
    w, p = stats.shapiro_wilk(x)
    assert w > 0.97 and p > 0.05
    w2, p2 = stats.shapiro_wilk(np.exp(2 * x))
    assert w2 < 0.7 and p2 < 1e-6
    assert math.isnan(stats.shapiro_wilk([1, 1, 1, 1])[0])


def test_decision_ladder(spark):
    rows = [(0.60, 0.01, 0.04), (0.599, 0.01, 0.04), (0.70, 0.01, 0.10), (0.2, 0.01, 0.01)]
    df = spark.createDataFrame(rows, "rho double, low double, q double")
    got = [r[0] for r in df.select(stats.association_status(F.col("rho"), F.col("low"), F.col("q"))).collect()]
    assert got == ["strong", "partial", "failure", "failure"]
    m = spark.createDataFrame([(0.15,), (0.10,), (-0.01,)], "m double")
    assert [r[0] for r in m.select(stats.selectivity_status(F.col("m"))).collect()] == ["strong", "partial", "failure"]


def test_one_to_one_join_raises_on_a_repeated_key(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d")], "k int, x string")
    b = spark.createDataFrame([(1, "p"), (3, "q")], "k int, y string")
    assert values(joins.join_one_to_one(a, b, ["k"]), "k", "x", "y") == [(1, "a", "p")]
    with pytest.raises(Exception, match="more than once on the right"):
        joins.join_one_to_one(a, b.union(b), ["k"]).collect()
    with pytest.raises(ValueError, match="both sides"):
        joins.join_one_to_one(a, a, ["k"])


def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 10)
    left = spark.createDataFrame([("hot",)] * 50 + [("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("c", 3)], "k string, v int")
    heavy = skew.heavy_keys(left, "k", left.count())
    assert heavy == ["hot"]
    for how in ("left", "inner"):
        got = skew.join_on_unique(left, right, "k", how, heavy)
        want = left.join(right, "k", how)
        assert values(got, "k", "v") == values(want, "k", "v")


def _words(value):
    return [int.from_bytes((value >> (64 * i) & (1 << 64) - 1).to_bytes(8, "big"), "big", signed=True) if (value >> (64 * i) & (1 << 64) - 1) < 1 << 63 else (value >> (64 * i) & (1 << 64) - 1) - (1 << 64) for i in range(4)]


def test_hamming_pairs_up_to_the_radius(spark):
    base = int.from_bytes(hashlib.sha256(b"x").digest(), "big")
    flips = {0: 0, 1: 8, 2: 9, 3: 16, 4: 17, 5: 256}
    rows = [(k, *_words(base ^ ((1 << n) - 1))) for k, n in flips.items()]
    df = spark.createDataFrame(rows, "id int, w0 bigint, w1 bigint, w2 bigint, w3 bigint")
    got = {(r["a"], r["b"]): r["distance"] for r in dedup.near_pairs(df, "id", ["w0", "w1", "w2", "w3"], 16).collect()}
    want = {(a, b): abs(flips[a] - flips[b]) for a in flips for b in flips if a < b and abs(flips[a] - flips[b]) <= 16}
    assert got == want  # the complement, 256 bits away, is no neighbour


@pytest.mark.parametrize("local", [500_000, 0])
def test_components_and_greedy_groups_differ_on_a_chain(spark, monkeypatch, local):
    monkeypatch.setattr(dedup, "LOCAL_LINKS", local)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("q", "q")], "a string, b string")
    assert values(dedup.components(edges, Scratch(spark, "t")), "v", "label") == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert values(dedup.greedy_groups(edges, Scratch(spark, "t")), "v", "anchor") == [("a", "a"), ("b", "a"), ("c", "c"), ("x", "x"), ("y", "x")]
    assert dedup.components(edges.where("false"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("local", [500_000, 0])
def test_greedy_groups_match_the_sequential_pass(spark, monkeypatch, local):
    monkeypatch.setattr(dedup, "LOCAL_LINKS", local)
    rng = np.random.default_rng(3)
    pairs = {tuple(sorted(map(int, p))) for p in rng.integers(0, 60, (90, 2)) if p[0] != p[1]}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    claimed = {}
    for v in sorted(near):
        if v not in claimed:
            claimed[v] = v
            for u in near[v]:
                claimed.setdefault(u, v)
    got = {r["v"]: r["anchor"] for r in dedup.greedy_groups(spark.createDataFrame(list(pairs), "a int, b int"), Scratch(spark, "t")).collect()}
    assert got == claimed


def test_repair_puts_each_group_in_one_split(spark):
    rows = [(1, "g", "dev"), (2, "g", "test"), (3, "g", "test"), (4, "h", ""), (5, "h", "dev"), (6, None, "test")]
    out = dedup.repair_splits(spark.createDataFrame(rows, "id int, g string, split string"), "g")
    assert values(out, "id", "split") == [(1, "test"), (2, "test"), (3, "test"), (4, "dev"), (5, "dev"), (6, "test")]


def test_cluster_bootstrap_equals_resampling_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{int(c)}", float(x), float(x + y)) for c, x, y in zip(rng.integers(0, 6, 120), rng.integers(0, 9, 120), rng.integers(0, 9, 120), strict=True)]
    df = spark.createDataFrame(rows, "c string, x double, y double")
    mult = rng.multinomial(6, [1 / 6] * 6, size=5).astype(float)
    got = [r["rho"] for r in resample.cluster_bootstrap_spearman(df, "x", "y", "c", mult).orderBy("draw").collect()]
    for m, rho in zip(mult, got, strict=True):
        sample = [(x, y) for c, x, y in rows for _ in range(int(m[int(c[1:])]))]
        xs, ys = (np.array(v) for v in zip(*sample, strict=True))
        mid = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        assert abs(np.corrcoef(mid(xs), mid(ys))[0, 1] - rho) < 1e-9
    assert resample.cluster_bootstrap_spearman(df.where("false"), "x", "y", "c", 3).count() == 0


def test_ridge_equals_the_dense_solution(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=300) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    m = models.fit_ridge(df, ["a", "b", "c"], "y", 1.0)
    z = np.clip((x - np.median(x, 0)) / (np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0)), -8, 8)
    a = np.hstack([np.ones((300, 1)), z])
    want = np.linalg.solve(a.T @ a + np.diag([0, 1, 1, 1.0]), a.T @ y)
    assert np.allclose(m.beta, want, atol=1e-8)
    assert models.predict(df, m).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 1


def test_pca_variance_equals_eigenvalues(spark):
    x = np.random.default_rng(4).normal(size=(50, 4))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "e array<double>")
    got = [r["variance"] for r in models.pca_variance(df, "e", 4).orderBy("component").collect()]
    assert np.allclose(got, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])


def test_orthogonal_design_is_balanced(spark):
    rows = [tuple(r)[1:] for r in generate.orthogonal_design(spark).collect()]
    x = np.array(rows, float)
    off = np.corrcoef(x.T) - np.eye(5)
    assert len(rows) == 125 and np.abs(off).max() < 1e-12


def test_design_seeds_are_unique_and_families_disjoint(spark):
    df = generate.factorial_design(spark)
    assert df.select("image_seed").distinct().count() == df.count() == df.select("image_id").distinct().count()
    assert df.groupBy("seed").agg(F.countDistinct("family").alias("k")).where("k > 1").count() == 0


def test_manifest_finds_a_changed_byte(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "sub" / "b.txt").write_bytes(b"two")
    before = spark.createDataFrame(manifest.hash_files(spark, str(tmp_path)).toPandas())
    assert values(before, "file", "bytes") == [("a.txt", 3), ("sub/b.txt", 3)]
    (tmp_path / "a.txt").write_bytes(b"onE")
    (tmp_path / "c.txt").write_bytes(b"new")
    (tmp_path / "sub" / "b.txt").unlink()
    after = manifest.hash_files(spark, str(tmp_path))
    assert values(manifest.verify(before, after), "file", "status") == [("a.txt", "changed"), ("c.txt", "unlisted"), ("sub/b.txt", "missing")]
    assert manifest.digest(before).first()["digest"] != manifest.digest(after).first()["digest"]
    assert manifest.fingerprint(before, "file", "sha256").first() != manifest.fingerprint(after, "file", "sha256").first()


def test_sources_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a_1", 0.5)], "name string, x double")
    assert "| a_1 | 0.5000 |" in io.markdown_table(df, "T")
    with pytest.raises(ValueError, match="at most"):
        io.markdown_table(spark.range(5).toDF("x"), "T", most_rows=3)
    row = io.latex_rows(df.withColumns({"lo": F.lit(-1.0), "hi": F.lit(1.0)}), "name", "x", "lo", "hi").first()["row"]
    assert row == "a\\_1 & $+0.5000$ [-1.0000, +1.0000] \\\\"
    empty = io.read_relation(spark, str(tmp_path / "none.parquet"), {"a": "int"})
    assert empty.columns == ["a"] and empty.count() == 0
    io.write_json({"b": 1, "a": 2}, str(tmp_path / "m.json"))
    assert io.read_config(str(tmp_path / "m.json")) == {"a": 2, "b": 1}
    assert io.rename_first(df, ["path", "name"], "relative_path").columns == ["relative_path", "x"]
    assert io.config_relation(spark, {"m": {"f": 1}}).collect()[0] == ("m", "f", 1.0)


@pytest.mark.parametrize("n", [1, 2, 10, 671, 2001, 9000])
def test_exact_quantiles_interpolate_like_numpy(spark, n):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=n), rng.integers(0, 5, n).astype(float)
    rows = [(float(a), float(b), "g" if i % 3 else None) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (None, float("nan"), "g"), (float("inf"), None, "empty")], "x double, y double, g string")
    p = [0.0, 0.005, 0.25, 0.5, 0.995, 1.0]
    r = quantiles.exact_quantiles(df, ["x", "y"], p).first()
    assert np.allclose(r["x_q"], np.quantile(x, p)) and np.allclose(r["y_q"], np.quantile(y, p))
    by = {r["g"]: r["x_q"] for r in quantiles.exact_quantiles(df, ["x"], p, "g").collect()}
    assert np.allclose(by[None], np.quantile(x[::3], p)) and "empty" not in by


def test_experiment_grid_equals_single_fits(spark):
    rng = np.random.default_rng(8)
    rows = [(*map(float, r), float(r[0] - 2 * r[1] + e), "dev" if i % 4 else "validation") for i, (r, e) in enumerate(zip(rng.normal(size=(200, 3)), rng.normal(size=200) * 0.3, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, split string")
    grid = {(r["features"], r["alpha"]): r for r in models.experiment_grid(df, {"two": ["a", "b"], "one": ["c"]}, "y", "split", (1.0, 10.0)).collect()}
    assert len(grid) == 4
    model = models.fit_ridge(df.where("split = 'dev'"), ["a", "b"], "y", 10.0)
    m = stats.error_metrics(F.col("y"), F.col("prediction"))
    want = models.predict(df.where("split = 'validation'"), model).agg(m["r2"]).first()[0]
    assert abs(grid["two", 10.0]["r2_validation"] - want) < 1e-9 and grid["one", 1.0]["r2_validation"] < 0.2


def test_trees_learn_a_step(spark):
    df = spark.createDataFrame([(float(i % 10), 1.0 if i % 10 > 4 else 0.0) for i in range(200)] + [(None, 0.0)], "a double, y double")
    for kind in ("forest", "boosted"):
        out = models.fit_trees(df, ["a"], "y", kind, trees=5).transform(df.fillna(0.0, subset=["a"]))
        assert out.agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 0.3


def brute_concordance(x, y, w):
    return sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) * w[i] * w[j] for i in range(len(x)) for j in range(i))


def test_concordance_equals_all_pairs():
    rng = np.random.default_rng(0)
    for n, top in ((0, 3), (1, 3), (40, 4), (60, 50), (80, 10_000)):
        x, y, w = rng.integers(0, top, n) / 7, rng.integers(-top, top, n) / 3, rng.integers(1, 4, n)
        assert math.isclose(ranks.concordance(x, y, w), brute_concordance(x, y, w), abs_tol=1e-9)


@pytest.mark.parametrize("kind", ["spread", "ties", "hot", "constant", "one", "none"])
def test_kendall_over_buckets(spark, kind):
    """Ties on either side, a value that a third of the rows hold, nulls, and no rows."""
    rng = np.random.default_rng(1)
    n = {"one": 1, "none": 0}.get(kind, 600)
    x = rng.normal(size=n) if kind == "spread" else rng.integers(0, 9, n).astype(float)
    x = np.where(rng.random(n) < 0.4, 5.0, rng.normal(size=n)) if kind == "hot" else np.full(n, 2.0) if kind == "constant" else x
    y = rng.normal(size=n) + x if kind == "spread" else rng.integers(0, 200, n).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (2.0, None)], "x double, y double")
    got = ranks.kendall_tau_b(df, "x", "y").collect()
    ties = lambda v: sum(k * (k - 1) / 2 for k in np.unique(v, return_counts=True)[1])
    pairs = n * (n - 1) / 2
    want = brute_concordance(x, y, np.ones(n)) / math.sqrt((pairs - ties(x)) * (pairs - ties(y))) if n > 1 and kind != "constant" else None
    if n == 0:
        assert not got
    else:
        assert got[0]["n"] == n and (got[0]["tau"] is None if want is None else math.isclose(got[0]["tau"], want, rel_tol=1e-9))
    both = df.where("x is not null and y is not null").withColumn("g", F.lit("a")).unionByName(spark.createDataFrame([(1.0, 1.0, "b"), (2.0, 2.0, "b")], "x double, y double, g string"))
    by = {r["g"]: r["tau"] for r in ranks.kendall_tau_b(both, "x", "y", "g").collect()}
    assert by["b"] == 1 and (n == 0 or by["a"] == got[0]["tau"])


def test_bootstrap_of_many_clusters_equals_few(spark, monkeypatch):
    """Beyond MOST_CLUSTERS each draw is ranked with its multiplicities; the same draws give the same correlations."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(a), float(a + b), int(c)) for a, b, c in zip(rng.integers(0, 20, 200), rng.integers(0, 20, 200), rng.integers(0, 12, 200), strict=True)], "x double, y double, c int")
    few = values(resample.cluster_bootstrap_spearman(df, "x", "y", "c", 15), "draw", "rho")
    monkeypatch.setattr(resample, "MOST_CLUSTERS", 5)
    many = values(resample.cluster_bootstrap_spearman(df, "x", "y", "c", 15), "draw", "rho")
    assert [a[0] for a in few] == [b[0] for b in many] and np.allclose([a[1] for a in few], [b[1] for b in many], atol=1e-9)


def test_permuted_targets_lose_the_relation(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    df = spark.createDataFrame([(i, float(a), float(3 * a + rng.normal()), "dev" if i % 3 else "test", "g") for i, a in enumerate(x)], "k int, x double, y double, split string, g string")
    out = {r["split"]: r for r in models.permutation_control(df, "k", ["x"], "y", "split", ("dev",), 1.0, 100).collect()}
    assert set(out) == {"dev", "test"} and out["test"]["rho"] > 0.8 and out["test"]["n_permutations"] == 100
    assert abs(out["test"]["mean_rho"]) < 0.4 and out["test"]["rho_q025"] < 0 < out["test"]["rho_q975"]
    fit = df.where("split = 'dev'")
    products = models.permuted_products(fit, "k", [F.col("x")], "y", 5)
    total = fit.agg(F.sum("y")).first()[0]
    assert np.allclose(products[:, 0], total) and len(set(np.round(products[:, 1], 6))) == 5  # the same values, dealt otherwise


@pytest.mark.parametrize("few", [True, False])
def test_rank_correlations_of_both_ways(spark, monkeypatch, few):
    """Ranks that are broadcast, and ranks that are joined by value with heavy values apart, are the same."""
    monkeypatch.setattr(ranks, "BROADCAST_VALUES", 10_000 if few else 0)
    monkeypatch.setattr(ranks, "HEAVY_ROWS", 20)
    rng = np.random.default_rng(8)
    rows = [("u" if i % 3 else None, float(rng.integers(0, 30)), 0.0 if rng.random() < 0.5 else float(rng.normal()), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame([*rows, ("u", None, 1.0, 1.0)], "g string, a double, b double, c double")
    got = {(r["g"], r["a"], r["b"]): r["rho"] for r in ranks.rank_correlations(df, ["a", "b", "c"], "g").collect()}
    rank = lambda v: np.array([np.sum(v < x) + (np.sum(v == x) + 1) / 2 for x in v])
    for g in ("u", None):
        part = np.array([r[1:] for r in rows if r[0] == g])
        want = np.corrcoef([rank(part[:, k]) for k in range(3)])
        for i, a in enumerate("abc"):
            for j, b in enumerate("abc"):
                if (g, a, b) in got:
                    assert math.isclose(got[g, a, b], want[i, j], abs_tol=1e-9)
    assert ("u", "a", "b") in got and len([k for k in got if k[0] == "u"]) == 9


def test_projection_on_principal_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None)], "k int, v array<double>")
    out = {r["k"]: [r["pc1"], r["pc2"]] for r in models.pca_projection(df, "v", 4, 2).collect()}
    _, _, vt = np.linalg.svd(x - x.mean(0))
    want = (x - x.mean(0)) @ vt[:2].T
    assert out[99] == [None, None]
    assert np.allclose(np.abs([out[i] for i in range(50)]), np.abs(want), atol=1e-9)
