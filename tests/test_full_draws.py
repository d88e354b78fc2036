"""Resampling queries with the survey's numbers of draws against brute force."""

import numpy as np
import pandas as pd
import pytest

from vellum.plans import registry, resampling_queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "draws"), [("cluster_bootstrap_ci", 2000), ("paired_delta_bootstrap", 2000), ("iid_bootstrap_mean_diff", 1000), ("weight_perturbation", 1000)])
def test_the_survey_s_draws(spark, name, draws):
    """As many draws as the survey takes, of which the first are those that SQL confirms."""
    full = registry.queries()[f"{name}_full"](spark, DATA).toPandas()
    if name == "cluster_bootstrap_ci":
        assert full["n_draws"][0] == draws and full["low"][0] < full["high"][0]
        return
    few = registry.queries()[name](spark, DATA).toPandas().set_index("draw").iloc[:, 0].sort_index()
    value = full.set_index("draw").iloc[:, 0].sort_index()
    assert len(value) == draws and np.allclose(value[: len(few)], few, atol=2e-6)


def test_rater_grid_against_brute_force(spark):
    rng = np.random.default_rng(3)
    table = pd.DataFrame([(r, i, float(v)) for r in range(5) for i, v in enumerate(rng.normal(np.arange(20) / 4, 1.5).round(3))], columns=["rater", "item", "value"])
    got = resampling_queries.rater_grid(spark.createDataFrame(table), 30).toPandas().set_index("m").sort_index()
    order = resampling_queries.resample.subset_draws(spark.createDataFrame(table), "rater", 2, 30, "raters").toPandas()
    y = table.groupby("item")["value"].mean()
    rho, mad, overlap = [], [], []
    for _, g in order.groupby("draw"):
        x = table[table["rater"].isin(g["rater"])].groupby("item")["value"].mean()
        rho.append(x.rank().corr(y.rank()))
        mad.append((x - y).abs().mean())
        ends = lambda v: set(v.nsmallest(2).index) | set(v.nlargest(2).index)
        overlap.append(len(ends(x) & ends(y)) / 4)
    assert list(got.index) == [1, 2, 3, 4, 5] and (got["n_draws"] == 30).all() and got["rho"][5] == 1 and got["mad"][5] == 0
    assert np.allclose(got.loc[2, ["rho", "low", "high", "mad", "overlap"]].astype(float), [np.median(rho), *np.percentile(rho, [2.5, 97.5]), np.median(mad), np.median(overlap)], atol=2e-6)
    enough = got.index[(got["rho"] >= 0.95) & (got["low"] >= 0.9)].min()
    assert (got["sufficient"] == enough).all()


def test_subset_grids_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=60).round(4)
    table = pd.DataFrame({"key": np.arange(60), "category": np.where(np.arange(60) % 3, "a", "b"), "x": x, "y": (x + rng.normal(size=60)).round(4)})
    df, size, draws = spark.createDataFrame(table), 20, 12
    whole = table["x"].rank().corr(table["y"].rank())
    dealt = resampling_queries._dealt(df, (10, size), draws, "images:").toPandas()
    assert (dealt[dealt["picked"]].groupby(["size", "draw"]).size().unstack() == np.array([[10], [size]])).all(axis=None)
    rho = [g["x"].rank().corr(g["y"].rank()) for _, g in dealt[dealt["picked"] & (dealt["size"] == size)].groupby("draw")]
    got = resampling_queries.image_grid(df, (10, size), draws).toPandas().set_index("n").loc[size]
    assert got["n_draws"] == draws and np.allclose(got[["full_rho", "rho", "bias", "std", "low", "high"]].astype(float), [whole, np.median(rho), np.median(rho) - whole, np.std(rho), *np.percentile(rho, [2.5, 97.5])], atol=2e-6)
    rest = resampling_queries._dealt(df, (size,), draws, "labels:").toPandas()
    rho = []
    for _, g in rest.groupby("draw"):
        f, o = g[g["picked"]], g[~g["picked"]]
        dx = f["x"] - f["x"].mean()
        b = (dx * (f["y"] - f["y"].mean())).sum() / ((dx**2).sum() + 1)
        rho.append((o["x"] * b).rank().corr(o["y"].rank()))
    got = resampling_queries.label_grid(df, (size,), draws).toPandas().set_index("k").loc[size]
    assert got["n_draws"] == draws and np.allclose(got[["frozen_rho", "rho", "std", "gain"]].astype(float), [whole, np.median(rho), np.std(rho), np.median(rho) - whole], atol=2e-6)
