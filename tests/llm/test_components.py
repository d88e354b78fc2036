import numpy as np
import pytest

from vellum.llm import components, consolidate
from vellum.operators import skew


def truth(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root if len([1 for w in root if find(w) == find(v)]) > 1}


def graph(kind):
    rng = np.random.default_rng(1)
    if kind == "chain":
        order = rng.permutation(300)
        return [(int(a), int(b)) for a, b in zip(order[:-1], order[1:], strict=True)]
    if kind == "cycle":
        return [(i, (i + 1) % 40) for i in range(40)]
    if kind == "star":
        return [(500, i) for i in range(200)]
    if kind == "tree":
        return [(i, (i - 1) // 2) for i in range(1, 200)]
    if kind == "core":
        return [(i, j) for i in range(12) for j in range(i)] + [(11, 50), (50, 51), (51, 52), (100, 101)]
    return [tuple(map(int, p)) for p in rng.integers(0, 250, (200, 2))] + [(3, 3), (7, 8), (7, 8), (8, 7)]


@pytest.mark.parametrize("local", [500_000, 30, 0])
@pytest.mark.parametrize("solver", [components.strip_and_compress, components.hook_and_shortcut])
@pytest.mark.parametrize("kind", ["chain", "cycle", "star", "tree", "core", "random"])
def test_labels_are_the_least_vertex(spark, scratch, monkeypatch, kind, solver, local):
    """By rounds of tables alone, by one task alone, and by a task that takes over."""
    monkeypatch.setattr(components, "LOCAL_LINKS", local)
    pairs = graph(kind)
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs] + [(None, 1, "x"), (2, None, "x")], "a int, b int, v string")
    rows = [tuple(r) for r in components.link_components(df, scratch, solver).collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == truth([p for p in pairs if p[0] != p[1]])


@pytest.mark.parametrize("solver", [components.strip_and_compress, components.hook_and_shortcut])
def test_hubs_take_the_broadcast_way(spark, scratch, monkeypatch, solver):
    """One vertex holds most edges: with a low bound its joins are broadcasts, with the same result."""
    monkeypatch.setattr(skew, "HEAVY_ROWS", 20)
    monkeypatch.setattr(components, "HEAVY_ROWS", 20)
    monkeypatch.setattr(components, "LOCAL_LINKS", 0)
    pairs = [(0, i) for i in range(1, 150)] + [(i, i + 1000) for i in range(1, 60)] + [(5000, 5001)]
    got = {r["v"]: r["label"] for r in components.link_components(spark.createDataFrame(pairs, "a int, b int"), scratch, solver).collect()}
    assert got == truth(pairs)


def test_no_links(spark, scratch):
    for rows in ([], [(1, 1)], [(None, None)]):
        df = spark.createDataFrame(rows, "a int, b int")
        assert components.link_components(df, scratch).count() == 0
    assert components.group_memberships(spark.createDataFrame([], "item string, grp string"), scratch).count() == 0


LISTINGS = [
    ("A_1", "exact_1"), ("A_2", " EXACT-1 "), ("A_2", "near_9"), ("A_3", "Near_9"), ("A_3", "near_9"), ("B_1", None), ("B_2", "  "), ("B_3", "only"),
    ("C_1", "c_2"), ("C_2", None), ("D_1", "d_1"), (None, "exact_1"), ("E_1", "e_1"), ("E_2", "E-1"), ("F_1", "zz"), ("F_2", "aa"), ("F_2", "zz"),
]


def listings(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in LISTINGS], "image_id string, duplicate_group_id string, label string, item int")


def test_image_groups(spark, scratch):
    """Spelling, chains over labels, labels that are image ids, own ids as labels, nulls and clashing column names."""
    got = {r["image_id"]: r["group_key"] for r in consolidate.tied_images(consolidate.image_groups(listings(spark), scratch), scratch).collect()}
    assert got == {"A_1": "exact_1", "A_2": "exact_1", "A_3": "exact_1", "C_1": "c_2", "C_2": "c_2", "E_1": "e_1", "E_2": "e_1", "F_1": "aa", "F_2": "aa"}


def test_empty_listings(spark, scratch):
    assert consolidate.tied_images(consolidate.image_groups(listings(spark).where("false"), scratch), scratch).count() == 0


def test_one_label_holds_a_third(spark, scratch, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 20)
    monkeypatch.setattr(components, "HEAVY_ROWS", 20)
    monkeypatch.setattr(components, "LOCAL_LINKS", 0)
    rows = [(f"H_{i}", "hot") for i in range(60)] + [(f"H_{i}", f"l_{i}") for i in range(30)] + [(f"K_{i}", f"l_{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "image_id string, duplicate_group_id string")
    got = {r["image_id"]: r["group_key"] for r in consolidate.tied_images(consolidate.image_groups(df, scratch), scratch).collect()}
    assert got == {i: "hot" for i in [f"H_{k}" for k in range(60)] + [f"K_{k}" for k in range(30)]}


def test_arrays_strip_a_long_chain():
    """A path of 100,000 vertices is spliced to nothing in rounds like the logarithm of its length, none of which gathers it."""
    order = np.random.default_rng(2).permutation(100_000)
    graph = components.Arrays(order[:-1], order[1:], 100_000)
    graph.strip()
    assert not len(graph.a) and len(graph.pointers) < 60
    assert len(np.unique(graph.roots())) == 1
