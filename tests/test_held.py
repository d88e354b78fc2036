"""Statistics of draws over points that tasks hold, against those of a row per point and draw."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.functions import md5
from vellum.functions.exprs import hash_int
from vellum.operators import held, models, ranks, resample
from vellum.plans import base, resampling_queries


@pytest.fixture
def watched(monkeypatch):
    """The largest table that Scratch writes, in rows."""
    from vellum import session

    seen, keep = [], session.Scratch.keep

    def kept(self, df):
        out = keep(self, df)
        seen.append(session.rows_of(out))
        return out

    monkeypatch.setattr(session.Scratch, "keep", kept)
    return seen


def test_shares_of_odd_texts(spark, tmp_path):
    """The counts of Spark's expression are those of the one that SQL reads."""
    texts = ["", "\n", "A1.b(", "ÄÖ１２ 12\r\n[x]{}\\^-]", "😀9😀?aeiou\u0000Z", None, "((((", "zz^^--"]
    spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = base.features(spark, str(tmp_path)).toPandas().set_index("doc_id")
    for name, chars in base.SHARES.items():
        for i, t in enumerate(texts):
            assert pd.isna(got[name][i]) if t is None else got[name][i] == sum(c in chars for c in t) / max(len(t), 1)


def test_half_up_is_spark_s_rounding(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([[0.5, 1.5, -0.5, -2.5, 1.0000000005, -1.0000000005, 0.1234567895, 2.675, 0.0, -0.0, 1e17], rng.normal(size=500), (rng.integers(-(10**6), 10**6, 500) * 10 + 5) / 1e10])
    for places in (0, 9):
        want = [r[0] for r in spark.createDataFrame([(float(x),) for x in v], "v double").coalesce(1).select(F.round("v", places)).collect()]
        assert (held.half_up(v, places) / 10.0**places == np.array(want)).all()


@pytest.mark.parametrize("points", [0, held.HELD_POINTS])
def test_permutation_control_holds_points_not_draws(spark, monkeypatch, watched, points):
    """Both ways give the same; that of held points writes no row per point and draw."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=300).round(1)
    df = spark.createDataFrame([(i, float(a), None if i == 7 else float(round(a + rng.normal(), 1)), "dev" if i % 3 else "test") for i, a in enumerate(x)], "k int, x double, y double, split string")
    monkeypatch.setattr(held, "HELD_POINTS", points)
    out = models.permutation_control(df, "k", ["x"], "y", "split", ("dev",), 1.0, 30).toPandas().set_index("split").sort_index()
    assert list(out["n"]) == [199, 100] and (out["n_permutations"] == 30).all()
    if points:
        assert max(watched) <= 300
    # of one input, all predictions rank as x or the other way round
    rows = df.where("y is not null").toPandas()
    for split, g in rows.groupby("split"):
        assert np.isclose(out["rho"][split], g["x"].clip(-8, 8).rank().corr(g["y"].rank()), atol=1e-9)
        assert np.isclose(out["max_abs_rho"][split], out["rho"][split], atol=1e-9)


@pytest.mark.parametrize("points", [0, held.HELD_POINTS])
def test_weight_perturbation_holds_points_not_draws(spark, monkeypatch, watched, points):
    monkeypatch.setattr(held, "HELD_POINTS", points)
    df = base.features(spark, "/root/testdata/sf0.001")
    got = resampling_queries._perturbed(df, 25).toPandas().set_index("draw")["rho"].sort_index()
    if points:
        assert max(watched) <= 100
    pdf = df.where("n_letters is not null").toPandas()
    spec = base.COMPOSITES["density"]
    dev = pdf[pdf["split"] == "dev"]
    z = {c: ((pdf[c] - dev[c].mean()) / (dev[c].std() or 1)).clip(-4, 4) for c in spec}
    head = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16) / 2**32
    y = sum(w * z[c] for c, (w, _) in spec.items()).round(9)
    want = [sum(w * (0.9 + 0.2 * head(f"weights:{d}:{c}")) * z[c] for c, (w, _) in spec.items()).rank().corr(y.rank()) for d in range(25)]
    assert len(got) == 25 and np.allclose(got, want, atol=2e-6)


def test_hashes_of_many_strings(spark):
    """Those of hash_int, whatever the lengths and prefixes; longer strings than a block holds as well."""
    strings = ["", ":7", ":123456", ":äöü", ":" + "x" * 60, ":" + "y" * 47, ":" + "z" * 48, ":a\u0000"]
    made = md5.Suffixes(pa.array([s.encode() for s in strings], pa.binary()).slice(0))
    for prefix in ("iid:0", "iid:12", "images:999", "", "p" * 60):
        want = [r["h"] for r in spark.createDataFrame([(i, prefix + s) for i, s in enumerate(strings)], "i int, s string").select("i", hash_int(F.col("s")).alias("h")).orderBy("i").collect()]
        assert made.heads(prefix.encode()).tolist() == want
    assert md5.Suffixes(pa.array([b"a", b":7", b":8"], pa.binary()).slice(1)).heads(b"iid:3").tolist() == [int(hashlib.md5(b"iid:3:" + k).hexdigest()[:8], 16) for k in (b"7", b"8")]


def test_bootstrap_of_correlations_holds_rows_not_draws(spark, monkeypatch, watched):
    """Both ways agree, with ties, a constant resample and keys of any kind, and the held way writes no row per draw."""
    rng = np.random.default_rng(9)
    table = [(k, float(a), float(b)) for k, a, b in zip([None, "é", *map(str, range(118))], rng.integers(0, 9, 120), rng.normal(size=120).round(1), strict=True)]
    df = spark.createDataFrame([*table, ("x", None, 1.0), ("y", 1.0, None)], "k string, x double, y double")
    monkeypatch.setattr(held, "WEIGHTS", 500)
    few = resample.iid_bootstrap_correlations(df, "k", "x", "y", 40).toPandas().sort_values(["statistic", "draw"], ignore_index=True)
    assert max(watched) == 120 and len(few) == 120
    monkeypatch.setattr(held, "HELD_POINTS", 0)
    rows = resample.iid_bootstrap_correlations(df, "k", "x", "y", 40).toPandas().sort_values(["statistic", "draw"], ignore_index=True)
    assert (few[["statistic", "draw"]] == rows[["statistic", "draw"]]).all(axis=None) and np.allclose(few["value"], rows["value"], atol=1e-9)


def test_concordances_are_those_of_one_draw():
    rng = np.random.default_rng(4)
    x, y, w = rng.integers(0, 12, 200), rng.integers(0, 40, 200), rng.integers(0, 4, (5, 200)).astype(np.int32)
    assert held._concordances(x, y, w) == [ranks.concordance(x, y, v) for v in w]
    assert held._concordances(x, np.zeros(200, int), w) == [0] * 5


@pytest.mark.parametrize("spare", [(8, 16), (0, 0)])
def test_image_saturation_keeps_the_first_of_each_draw(spark, monkeypatch, watched, spare):
    """The rows that come first are those of the ranks of all, even if the bound lets too few pass at first; a row per document and draw isn't written."""
    monkeypatch.setattr(resample, "DEVIATIONS", spare[0])
    monkeypatch.setattr(resample, "MORE", spare[1])
    rng = np.random.default_rng(6)
    table = [(f"k{i}", "ab"[i % 7 == 0] if i > 2 else None, float(v), None if i == 9 else float(w)) for i, (v, w) in enumerate(rng.normal(size=(900, 2)).round(2))]
    df, draws = spark.createDataFrame(table, "key string, category string, x double, y double"), 30
    got = resampling_queries.image_grid(df, (7, 20), draws).toPandas().set_index("n").sort_index()
    assert max(watched) < 900 * draws / 4
    dealt = resampling_queries._dealt(df, (7, 20), draws, "images:").where("picked and y is not null").toPandas()
    for size, g in dealt.groupby("size"):
        rho = [d["x"].rank().corr(d["y"].rank()) for _, d in g.groupby("draw")]
        assert got["n_draws"][size] == draws and np.allclose(got.loc[size, ["rho", "std", "low", "high"]].astype(float), [np.median(rho), np.std(rho), *np.percentile(rho, [2.5, 97.5])], atol=2e-6)
