import pytest
from pyspark.sql import functions as F

from vellum.llm import mixture


def test_flow_serves_overlapping_sources():
    """b alone can't fill its share; what a and b have in common must go to b, which leaves a its own."""
    patterns = {("a",): 100, ("a", "b"): 50, ("b",): 10}
    flow = mixture.min_cost_flow(patterns, {"a": 100, "b": 60}, {"a": 1, "b": 1})
    assert flow == {(("a",), "a"): 100, (("a", "b"), "b"): 50, (("b",), "b"): 10}


def test_flow_repeats_as_little_as_possible():
    flow = mixture.min_cost_flow({("a",): 10, ("a", "b"): 10}, {"a": 40, "b": 0}, {"a": 3, "b": 1})
    assert flow == {(("a",), "a"): 20, (("a", "b"), "a"): 20}  # two copies of each rather than three of one
    assert mixture.min_cost_flow({("a",): 10}, {"a": 100}, {"a": 4}) == {(("a",), "a"): 40}
    assert mixture.min_cost_flow({}, {"a": 5}, {"a": 1}) == {}


DOCS = "doc_id bigint, sources array<string>, n_tokens bigint, source string, pattern int"


def plan(spark, scratch, rows, targets):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    return mixture.Mixture(docs, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), scratch)


def rows(n):
    out = [(i, ["big"], 7) for i in range(n)] + [(1000 + i, ["small"], 5) for i in range(6)]
    return out + [(2000, None, 9), (2001, ["elsewhere"], 50), (2002, [None], 3), (2003, ["big"], None), (2004, ["big"], 0), (None, ["big"], 7), (0, ["big"], 7)]


def test_shares_and_shortfall(spark, scratch):
    m = plan(spark, scratch, rows(100), [("big", 0.5, 1), ("small", 0.3, 3), ("empty", 0.2, 5), (None, 0.0, 1)])
    assert m.total == 102 * 7 + 30  # documents of no listed source are left aside
    assert sorted(r[0] for r in m.short().collect()) == ["empty", "small"]
    got = {r["source"]: r for r in m.shares().collect()}
    assert got["small"]["n_reached"] == 90 and got["small"]["falls_short"] and got["empty"]["n_available"] == 0
    assert 0 <= got["big"]["n_quota"] - got["big"]["n_reached"] < 7 and not got["big"]["falls_short"]
    used = m.selection()
    assert used.where("source = 'small' and repeats != 3").count() == 0 and used.where("source = 'big'").agg(F.max("repeats")).first()[0] == 1


def test_selection_doesnt_depend_on_partitions(spark, scratch):
    pick = lambda k: sorted(tuple(r) for r in mixture.Mixture(spark.createDataFrame(rows(60), "doc_id bigint, sources array<string>, n_tokens bigint").repartition(k), spark.createDataFrame([("big", 0.3, 1)], "source string, target_share double, max_repeats int"), scratch).selection().where("doc_id is not null").collect())
    assert pick(1) == pick(5)


@pytest.mark.parametrize("empty", ["docs", "targets"])
def test_empty_tables(spark, scratch, empty):
    m = plan(spark, scratch, rows(3)[: 0 if empty == "docs" else None], [("big", 0.5, 1)][: 0 if empty == "targets" else None])
    assert m.selection().count() == 0 and m.shares().count() == (1 if empty == "docs" else 0)
    assert m.short().count() == 0  # nothing of no tokens is missing


def test_a_long_document_early_in_the_order_doesnt_end_the_selection(spark, scratch):
    bucket = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(mixture.LEAST_BUCKETS))
    order = [r["id"] for r in spark.range(61).orderBy(bucket, F.xxhash64("id", F.lit(7))).collect()]
    docs = [(i, ["a"], 400 if i == order[0] else 5 + i % 9) for i in range(61)] + [(100 + i, ["b"], 10) for i in range(100)]
    quota = -(-350 * (sum(d[2] for d in docs)) // 2000)
    m = plan(spark, scratch, docs, [("a", 0.175, 1), ("b", 0.5, 1)])
    used = m.selection().where("source = 'a'").collect()
    left = {d[0]: d[2] for d in docs[:61]}
    for r in used:
        assert r["repeats"] == 1 and left.pop(r["doc_id"]) == r["n_tokens"]
    gap = quota - sum(r["n_tokens"] for r in used)
    assert 0 <= gap < min(left.values()) and order[0] in left
    got = {r["source"]: r for r in m.shares().collect()}
    assert got["a"]["n_missing"] == gap and got["a"]["selection_short"] == (gap > 0) and not got["a"]["falls_short"]


def test_no_document_fits_into_the_gap(spark, scratch):
    """The only document is longer than the quota: the flow says enough, the selection says none."""
    m = plan(spark, scratch, [(1, ["a"], 100), (2, ["b"], 100)], [("a", 0.2, 1), ("b", 0.5, 1)])
    got = {r["source"]: r for r in m.shares().collect()}
    assert not got["a"]["falls_short"] and got["a"]["selection_short"] and got["a"]["n_missing"] == 40 and not got["b"]["selection_short"]


def test_overlapping_sources_are_selected_within_caps(spark, scratch):
    """Texts of two sources serve the one that lacks tokens; no document is used beyond its cap or by a stranger."""
    docs = [(i, ["a"], 10) for i in range(40)] + [(100 + i, ["a", "b"], 10) for i in range(30)] + [(200 + i, ["b"], 10) for i in range(5)]
    m = plan(spark, scratch, docs, [("a", 0.4, 1), ("b", 0.45, 1)])
    got = {r["source"]: r for r in m.shares().collect()}
    assert got["b"]["n_reached"] == 330 and not got["b"]["falls_short"] and not got["a"]["selection_short"]
    assert all((r["n_over_cap"], r["n_foreign"], r["n_beyond"]) == (0, 0, 0) for r in mixture.audit(m).collect())


def test_too_many_patterns_are_refused(spark, scratch, monkeypatch):
    monkeypatch.setattr(mixture, "MOST_PATTERNS", 5)
    docs = [(i, [f"s{i}", f"s{i + 1}"], 1) for i in range(16)]
    with pytest.raises(ValueError, match="membership patterns"):
        plan(spark, scratch, docs, [(f"s{i}", 0.05, 1) for i in range(17)])
