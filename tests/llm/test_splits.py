import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import splits
from vellum.operators import skew

SCHEMA = "item string, grp string, unit string, rows int, place int"


def test_closest_subset_matches_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(150):
        units = [int(x) for x in rng.integers(1, rng.choice([3, 15, 60]), rng.integers(1, 12))]
        sizes = {s: units.count(s) for s in set(units)}
        target = int(rng.integers(0, sum(units) + 1))
        taken = splits.closest_subset(sizes, target)
        total = sum(s * n for s, n in taken.items())
        best = min(abs(sum(c) - target) for k in range(len(units) + 1) for c in itertools.combinations(units, k))
        assert abs(total - target) == best and all(0 <= n <= sizes[s] for s, n in taken.items())


@pytest.mark.parametrize("sizes,target,miss", [({6: 10**9, 10: 10**9, 15: 1}, 8 * 10**9 + 1, 0), ({6: 10**9, 10: 10**9}, 8 * 10**9 + 1, 1), ({7: 10**6, 9: 1}, 7 * 500_000 + 4, 2), ({999: 10**7, 1000: 10**7}, 10**10 + 499, 0)])
def test_closest_subset_of_any_number_of_units(sizes, target, miss):
    taken = splits.closest_subset(sizes, target)
    assert abs(sum(s * n for s, n in taken.items()) - target) == miss and all(0 <= n <= sizes[s] for s, n in taken.items())


@pytest.mark.parametrize("bits", [1 << 23, 500])
def test_plan_uses_every_unit_once(bits):
    sizes = {1: 900, 2: 100, 7: 13, 400: 1}
    plan = splits.plan_splits(sizes, splits.SHARES, bits)
    for s, n in sizes.items():
        assert sum(p.get(s, 0) for p in plan.values()) == n and all(p.get(s, 0) >= 0 for p in plan.values())
    total = sum(s * n for s, n in sizes.items())
    for k, share in splits.SHARES.items():
        assert abs(sum(s * n for s, n in plan[k].items()) - share * total) <= 1
    assert splits.plan_splits({}, splits.SHARES) == {k: {} for k in splits.SHARES}


def test_thousands_of_sizes_are_planned_at_once():
    sizes = {s: 70 for s in range(1, 4001)}
    began = time.perf_counter()
    plan = splits.plan_splits(sizes, splits.SHARES)
    assert time.perf_counter() - began < 2
    total = sum(s * n for s, n in sizes.items())
    assert {k: sum(s * n for s, n in p.items()) for k, p in plan.items()} == {k: round(share * total) for k, share in splits.SHARES.items()}
    assert all(sum(p.get(s, 0) for p in plan.values()) == n for s, n in sizes.items())


def rows(spark):
    data = [("i1", "g1"), ("i2", "g1"), ("i2", "g2"), ("i3", "g2"), ("i3", "g2"), ("i4", None), ("i5", None), (None, "g1"), (None, None)]
    data += [(f"x{i}", f"h{i % 40}") for i in range(200)]
    return spark.createDataFrame([(*r, "u", 5, 1) for r in data], SCHEMA)


def test_related_items_share_a_split(spark, scratch):
    out = splits.grouped_splits(rows(spark), scratch).collect()
    by = {r["item"]: r for r in out}
    assert len(by) == len(out) == 205
    assert by["i1"]["unit"] == by["i2"]["unit"] == by["i3"]["unit"] == "group:g1" and by["i3"]["rows"] == 2
    assert by["i4"]["unit"] == "item:i4" != by["i5"]["unit"]
    for unit in {r["unit"] for r in out}:
        assert len({r["split"] for r in out if r["unit"] == unit}) == 1
    total = sum(r["rows"] for r in out)
    for k, share in splits.SHARES.items():
        assert abs(sum(r["rows"] for r in out if r["split"] == k) - share * total) <= 1
    again = {r["item"]: r["split"] for r in splits.grouped_splits(rows(spark).repartition(3), scratch).collect()}
    assert again == {k: r["split"] for k, r in by.items()}


def test_a_group_of_a_third_goes_to_the_largest_split(spark, scratch, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 20)
    monkeypatch.setattr(splits, "LEAST_BUCKETS", 4)
    data = [(f"a{i}", "hot") for i in range(100)] + [(f"b{i}", None) for i in range(200)]
    out = splits.grouped_splits(spark.createDataFrame(data, "item string, grp string"), scratch)
    assert {r[0] for r in out.where("unit = 'group:hot'").select("split").collect()} == {"train"}
    assert {r["split"]: r["n"] for r in out.groupBy("split").agg(F.sum("rows").alias("n")).collect()} == {"train": 210, "validation": 45, "test": 45}


def test_torn_entities(spark, scratch):
    data = [("i1", "g1", 0), ("i2", "g1", 0), ("i3", "g2", 1), ("i3", "g2", 1), ("i4", "g3", 0), ("i5", "g3", 2), ("i6", "g4", None), ("i7", "g4", 3), ("i2", "g5", 0), ("i9", "g5", 4), (None, "g6", 1), (None, "g6", 2), ("i8", None, 1)]
    df = spark.createDataFrame([(*r, "x") for r in data], "item string, entity string, place int, unit string")
    assert sorted(r[0] for r in splits.torn_entities(df, scratch).collect()) == ["g3", "g5", "g6"]
    assert splits.torn_entities(df.where("false"), scratch).count() == 0


def test_empty_rows(spark, scratch):
    assert splits.grouped_splits(rows(spark).where("false"), scratch).count() == 0
