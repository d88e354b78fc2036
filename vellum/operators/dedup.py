"""Exact and near duplicates of wide bit vectors, their groups, and splits that respect them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vellum.operators.order import hashed_rank
from vellum.operators.skew import HEAVY_ROWS, HEAVY_SHARE, heavy_keys, join_on_unique
from vellum.session import Scratch, rows_of

#: Links that one task settles.
LOCAL_LINKS = 500_000


def pack_bits(flags: Column) -> Column:
    """An array of up to 64 booleans as a BIGINT, the first flag in the lowest bit."""
    bits = F.transform(flags, lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Distance of bit vectors held in words, as an integer: 256 stays 256."""
    out = F.lit(0)
    for x, y in zip(a, b, strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def _blocks(words: list[str], radius: int) -> Column:
    """radius + 1 disjoint blocks of the vector: two vectors within the radius agree in one of them at least."""
    width = 64 * len(words)
    cuts = [round(i * width / (radius + 1)) for i in range(radius + 2)]
    entries = []
    for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        parts = []
        for w, name in enumerate(words):
            a, b = max(lo, 64 * w) - 64 * w, min(hi, 64 * w + 64) - 64 * w
            if a < b:
                mask = (1 << (b - a)) - 1
                parts.append(F.shiftrightunsigned(F.col(name), a).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1)).cast("string"))
        entries.append(F.struct(F.lit(i).alias("block"), F.concat_ws("/", *parts).alias("value")))
    return F.array(*entries)


def near_pairs(df: DataFrame, key: str, words: list[str], radius: int, probe: str | None = None) -> DataFrame:
    """(a, b, distance) of all pairs a < b within ``radius``; with ``probe`` (a condition), pairs of which one side at least meets it.

    Candidates agree in a block, an equi-join; no pair is missed. Probes alone are one side of it. NULL words take no part.
    """
    held = df.dropna(subset=[key, *words])
    rows = held.select(key, *words, *([F.expr(probe).alias("_p")] if probe else []), F.explode(_blocks(words, radius)).alias("e")).select("*", "e.*").drop("e")
    a = (rows.where("_p") if probe else rows).select(F.col(key).alias("a"), *[F.col(w).alias(f"_a{w}") for w in words], "block", "value")
    b = rows.select(F.col(key).alias("b"), *[F.col(w).alias(f"_b{w}") for w in words], "block", "value")
    dist = hamming([F.col(f"_a{w}") for w in words], [F.col(f"_b{w}") for w in words])
    met = a.join(b, ["block", "value"]).where(F.col("a") != F.col("b") if probe else F.col("a") < F.col("b"))
    near = met.withColumn("distance", dist).where(F.col("distance") <= radius)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").distinct()


def exact_groups(df: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, group_key, n) of rows whose digest occurs more than once; the group is named by its least key. No list is gathered."""
    counts = df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(key).alias("group_key"), F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = Scratch(df.sparkSession, "digests").keep(counts)
    # digests of very many rows meet a broadcast: of those with HEAVY_ROWS and more the HEAVY_SHARE largest
    heavy = [r[0] for r in counts.where(F.col("n") >= HEAVY_ROWS).orderBy(F.desc("n")).limit(HEAVY_SHARE).select(digest).collect()]
    return join_on_unique(df.select(key, digest), counts, digest, "inner", heavy).select(key, "group_key", "n")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label): connected components of edges (a, b) by contraction onto least neighbours; the label is the least vertex."""
    edges = scratch.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    first, maps = edges, []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = scratch.keep(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), F.least("a", "p").alias("to")))
        maps.append(parent)
        moved = edges
        for end, to in (("a", "x"), ("b", "y")):
            moved = join_on_unique(moved, parent.select(F.col("v").alias(end), F.col("to").alias(to)), end, "inner", heavy_keys(edges, end, rows_of(edges)))
        edges = scratch.keep(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a != b").distinct())
    labels = first.select(F.col("a").alias("v")).union(first.select(F.col("b"))).distinct().withColumn("label", F.col("v"))
    for parent in maps:
        labels = scratch.keep(labels)
        found = join_on_unique(labels, parent.select(F.col("v").alias("label"), "to"), "label", "left", heavy_keys(labels, "label", rows_of(labels)))
        labels = found.select("v", F.coalesce("to", "label").alias("label"))
    labels = scratch.keep(labels)
    while True:  # a hooked vertex may point to one hooked in the same round
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("up"))
        step = join_on_unique(labels, up, "label", "left", heavy_keys(labels, "label", rows_of(labels)))
        step = scratch.keep(step.select("v", F.coalesce("up", "label").alias("label"), (F.coalesce("up", "label") != F.col("label")).alias("moved")))
        labels = step.drop("moved")
        labels._vellum_rows = step._vellum_rows
        if step.where("moved").isEmpty():
            return labels


def _sequential_pass(edges: DataFrame):
    """Reads links in order of their larger end, then the smaller: when a vertex comes up, all smaller ones are settled."""
    kind = to_arrow_type(edges.schema["a"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict = {}  # claimed vertex -> its anchor; any other vertex is an anchor
        seen: set = set()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((a, b))
                if b not in of and a not in of:
                    of[b] = a
        vertices = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array(vertices, kind), pa.array([of.get(v, v) for v in vertices], kind)], ["v", "anchor"])

    return run


def greedy_groups(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, anchor): what a pass in key order gives in which each unclaimed vertex claims its unclaimed neighbours.

    A vertex is an anchor unless a smaller neighbour is one, so the result hangs on the order of the keys. Up to LOCAL_LINKS links
    one task makes that pass. Beyond, the set is settled in rounds, all vertices whose smaller neighbours are settled at once:
    as many as the longest ascending chain of links has vertices, which are few where links join copies.
    Members go to their least anchor. Unlike components this isn't transitive.
    """
    edges = scratch.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    if rows_of(edges) <= LOCAL_LINKS:
        return scratch.keep(edges.coalesce(1).sortWithinPartitions("b", "a").mapInArrow(_sequential_pass(edges), f"v {edges.schema['a'].dataType.simpleString()}, anchor {edges.schema['a'].dataType.simpleString()}"))
    state = scratch.keep(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().withColumn("anchor", F.lit(None).cast("boolean")))
    while not state.where("anchor is null").isEmpty():
        below = edges.join(state.select(F.col("v").alias("a"), F.col("anchor").alias("_s")), "a").groupBy(F.col("b").alias("v")).agg(F.bool_or(F.coalesce("_s", F.lit(False))).alias("_hit"), F.count_if(F.col("_s").isNull()).alias("_open"))
        status = F.when(F.col("anchor").isNotNull(), F.col("anchor")).when(F.col("_hit"), False).when(F.coalesce("_open", F.lit(0)) == 0, True)
        state = scratch.keep(state.join(below, "v", "left").select("v", status.alias("anchor")))
    anchors = state.where("anchor").select("v")
    claimed = edges.join(anchors.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.min("a").alias("anchor"))
    own = anchors.select("v", F.col("v").alias("anchor"))
    return own.unionByName(claimed.join(anchors, "v", "left_anti"))


# --- splits -----------------------------------------------------------------------------------------------------------


def stratified_split(df: DataFrame, key: str, category: str, shares: dict[str, float], salt: str = "split:") -> DataFrame:
    """``df`` with ``split``: per category, the first shares of a seeded hash order; what is left over has split ''."""
    ranked = hashed_rank(df, key, salt, category)
    split, upto = F.lit(None).cast("string"), 0.0
    for name, share in shares.items():
        upto += share
        split = F.coalesce(split, F.when(F.col("rank") <= F.floor(F.lit(upto) * F.col("rank_of") + 1e-9), name))
    return ranked.withColumn("split", F.coalesce(split, F.lit(""))).drop("rank", "rank_of")


def repair_splits(df: DataFrame, group: str, split: str = "split", fallback: str = "dev") -> DataFrame:
    """``df`` in which every group lies in one split: its most frequent one (the least on ties), '' becoming ``fallback``. Rows without group keep theirs."""
    counts = df.where(F.col(group).isNotNull()).groupBy(group, split).agg(F.count(F.lit(1)).alias("_n"))
    modal = counts.groupBy(group).agg(F.count(F.lit(1)).alias("_k"), F.min(F.struct((-F.col("_n")).alias("m"), F.col(split).alias("s")))["s"].alias("_modal"))
    target = modal.where("_k > 1").select(group, F.when(F.col("_modal") == "", fallback).otherwise(F.col("_modal")).alias("_to"))
    return df.join(target, group, "left").withColumn(split, F.coalesce("_to", split)).drop("_to")


def group_folds(df: DataFrame, group: str, category: str, k: int, salt: str = "fold:") -> DataFrame:
    """(group, fold): one fold per group, dealt in turn within the group's least category."""
    groups = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(category).alias("_c"))
    return hashed_rank(groups, group, salt, "_c").select(group, ((F.col("rank") - 1) % k).cast("int").alias("fold"))


def leakage_report(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """(kind, n_groups, n_spanning, n_rows): groups that lie in several splits, by the prefix of their name."""
    per = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(split).alias("k"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col(group).startswith("exact_"), "exact").when(F.col(group).startswith("near_"), "near").otherwise("other")
    return per.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("k") > 1).alias("n_spanning"), F.sum(F.when(F.col("k") > 1, F.col("n")).otherwise(0)).alias("n_rows"))


def sharing_group_with(df: DataFrame, group: str, protected: str) -> DataFrame:
    """Rows of ``df`` whose group also holds a row that meets ``protected``, those rows themselves left out."""
    groups = df.where(protected).where(F.col(group).isNotNull()).select(group).distinct()
    return df.where(f"not coalesce({protected}, false)").join(groups, group, "left_semi")


def sample_per_category(df: DataFrame, key: str, category: str, n: int, salt: str = "sample:") -> DataFrame:
    """``df`` with ``in_sample``: the first ``n`` rows per category in a seeded hash order. Sampling is the feature here."""
    return hashed_rank(df, key, salt, category).withColumn("in_sample", F.col("rank") <= n).drop("rank", "rank_of")
