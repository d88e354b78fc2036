"""The status ladder needs intervals and q-values."""

import numpy as np
import pandas as pd

from vellum.plans.statistics_queries import status_ladder


def test_a_large_rho_whose_interval_crosses_0_is_a_failure(spark):
    """``good`` follows the target in every cluster; ``odd`` in one large cluster alone, against it in the others."""
    rng = np.random.default_rng(1)
    cluster = np.repeat(np.arange(6), [125, 5, 5, 5, 5, 5])
    target = rng.normal(size=150)
    noise = rng.normal(size=150)
    table = pd.DataFrame({"cluster": cluster.astype(str), "category": "en", "target": target, "other": noise, "good": target + noise / 4, "odd": np.where(cluster == 0, target, -target)})
    got = status_ladder(spark.createDataFrame(table), ["good", "odd"], ["target", "other"], "target", "cluster", "category", ["en", "de"], 200).toPandas().set_index("proxy")
    assert got["rho"]["odd"] >= 0.3 and got["q"]["odd"] < 0.05 and got["low"]["odd"] < 0 and got["low"]["good"] > 0.6
    assert list(got.loc["good", ["association", "selectivity", "family", "overall"]]) == ["strong"] * 4
    assert list(got.loc["odd", ["association", "family", "overall"]]) == ["failure"] * 3
