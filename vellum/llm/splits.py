"""Problem 2: train, validation and test splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.reading import read_label
from vellum.llm.components import group_labels, hook_and_shortcut
from vellum.operators.skew import heavy_keys, join_on_unique
from vellum.session import Scratch, rows_of, table

SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}
#: Bits that one subset-sum may hold: its memory on the driver. Sizes for which it is enough are placed exactly, see :func:`plan_splits`.
MAX_BITS = 1 << 23
#: Units that a hash bucket holds on average, when units of one size are ranked without sorting them in one task.
BUCKET_UNITS, LEAST_BUCKETS = 1 << 16, 256


def _reach(start: int, steps: list[tuple[int, int]], mask: int) -> int:
    for size, take in steps:
        move = size * take
        start |= (start << move if move > 0 else start >> -move) & mask
    return start


def closest_subset(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many units of each size to take so that their total is as close to ``target`` as can be (the lower on a tie).

    It starts from a proportional choice, filled up until no unit fits: within the largest size of the target. Of the best choices
    the one nearest to it changes 3 x (largest size) + 2 units at most, for among more changes some would cancel out and could
    be left undone. So a bitset of the totals within so many largest sizes of the start loses nothing, whatever the number of
    units. A size that may change by n units enters as 1, 2, 4, ... units up and down: log n shifts. The walk ends once the
    target is reached. Every so many bitsets one is stored, those between are computed again on the way back.
    """
    sizes = {s: n for s, n in sizes.items() if n}
    total = sum(s * n for s, n in sizes.items())
    if target >= total or not sizes:
        return sizes
    start = {s: n * target // total for s, n in sizes.items()}
    have = sum(s * n for s, n in start.items())
    for s in sorted(sizes, reverse=True):
        more = min(sizes[s] - start[s], (target - have) // s)
        start[s] += more
        have += s * more
    largest = max(sizes)
    most = 3 * largest + 2
    down, up = min(have, most * largest), min(total - have, most * largest)
    mask, goal = (1 << (down + up + 1)) - 1, target - have + down  # bit ``down`` is the start
    steps = []
    for s, n in sorted(sizes.items()):
        for count, sign in ((min(sizes[s] - start[s], most), 1), (min(start[s], most), -1)):
            k = 1
            while count > 0:
                steps.append((s, sign * min(k, count)))
                count, k = count - min(k, count), 2 * k
    every = max(1, int(len(steps) ** 0.5))
    reach, stored, done = 1 << down, [], 0
    for done in range(0, len(steps), every):
        if reach >> goal & 1:
            break
        stored.append(reach)
        reach = _reach(reach, steps[done : done + every], mask)
    below = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reach >> (goal + 1)
    over = goal + (above & -above).bit_length() if above else None
    at = below if over is None or goal - below <= over - goal else over
    for block in reversed(range(len(stored))):
        part = steps[block * every : (block + 1) * every]
        inside = [stored[block]]
        for step in part[:-1]:
            inside.append(_reach(inside[-1], [step], mask))
        for (s, take), before in zip(reversed(part), reversed(inside), strict=True):
            if not before >> at & 1:
                start[s] += take
                at -= s * take
    return start


def exact_sizes(sizes: dict[int, int], max_bits: int = MAX_BITS) -> int:
    """The largest size s for which the units up to s can be placed by a bitset of ``max_bits``: 0 if there is none."""
    out = held = 0
    for s in sorted(sizes):
        held += s * sizes[s]
        if min(held, 2 * (3 * s + 2) * s) <= max_bits:
            out = s
    return out


def plan_splits(sizes: dict[int, int], shares: dict[str, float], max_bits: int = MAX_BITS) -> dict[str, dict[int, int]]:
    """Units of each size for each split. The split with the largest share takes what the others leave.

    Units up to :func:`exact_sizes` (about 1,180 rows by default, all if there are no more than ``max_bits`` rows) bring each split
    in turn as close to its share as can be. Larger units, which no bitset of that memory could hold, are placed before
    them, the largest first, each size by the shares and its last units one by one where most is missing; a split that then comes
    out on its share is as close as can be all the same.
    """
    total = sum(s * n for s, n in sizes.items())
    order = sorted(shares, key=lambda k: (shares[k], k))
    goals = {k: int(shares[k] * total + 0.5) for k in order[:-1]}
    goals[order[-1]] = total - sum(goals.values())
    plan: dict[str, dict[int, int]] = {k: {} for k in shares}
    small = exact_sizes(sizes, max_bits)
    for size in sorted((s for s in sizes if s > small), reverse=True):
        left = sizes[size]
        for k in order:
            plan[k][size] = int(shares[k] * sizes[size])
            left -= plan[k][size]
            goals[k] -= size * plan[k][size]
        for _ in range(left):  # fewer than there are splits
            k = max(order, key=lambda x: (goals[x], x))
            plan[k][size] += 1
            goals[k] -= size
    left = {s: n for s, n in sizes.items() if s <= small}
    for k in order[:-1]:
        for size, n in closest_subset(left, max(0, goals[k])).items():
            plan[k][size] = plan[k].get(size, 0) + n
            left[size] -= n
    for size, n in left.items():
        plan[order[-1]][size] = plan[order[-1]].get(size, 0) + n
    return plan


def assign_units(units: DataFrame, scratch: Scratch, shares: dict[str, float] | None = None, seed: int = 7) -> DataFrame:
    """(unit, split) for ``units`` (unit, rows): split totals as close to their shares as whole units allow.

    Only the histogram of unit sizes goes to the driver: sizes that differ number at most the square root of twice the rows.
    Which units of a size go where is a seeded hash order, ranked within hash buckets.
    """
    shares = shares or SHARES
    units = scratch.keep(units.select("unit", F.col("rows").cast("bigint").alias("rows")))
    sizes = {r["rows"]: r["n"] for r in units.groupBy("rows").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_splits(sizes, shares)
    names = list(shares)
    ranges = [(s, *[sum(plan[k].get(s, 0) for k in names[: i + 1]) for i in range(len(names))]) for s in sizes]
    spark = units.sparkSession
    bounds = spark.createDataFrame(ranges, "rows bigint, " + ", ".join(f"b{i} bigint" for i in range(len(names))))
    order = F.xxhash64(F.col("unit").cast("string"), F.lit(seed))
    buckets = max(LEAST_BUCKETS, sum(sizes.values()) // BUCKET_UNITS)
    ranked = units.withColumn("h", order).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    counts = ranked.groupBy("rows", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("rows").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(bounds, "rows")
    inside = Window.partitionBy("rows", "bucket").orderBy("h", "unit")
    placed = ranked.join(offsets, ["rows", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(inside))
    split = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        split = F.when(F.col("rank") <= F.col(f"b{i}"), names[i]).otherwise(split)
    return placed.select("unit", split.alias("split"))


def grouped_splits(rows: DataFrame, scratch: Scratch, shares: dict[str, float] | None = None, seed: int = 7) -> DataFrame:
    """(item, unit, split, rows) of every item of ``rows`` (item, grp): items that share a group, through others too, share a split.

    Items without a group are units of their own; rows with a NULL item are left out; repeated rows count towards the
    proportions, which are of rows. An empty table gives an empty result.
    """
    rows = rows.where("item is not null")
    weights = rows.groupBy("item").agg(F.count(F.lit(1)).alias("rows"))
    members = scratch.keep(rows.where("grp is not null").select("item", "grp").distinct())
    items, labels = group_labels(members, scratch, hook_and_shortcut)
    heavy = heavy_keys(items, "grp", rows_of(items))
    grouped = join_on_unique(items, labels, "grp", "left", heavy).select("item", F.concat(F.lit("group:"), F.coalesce("label", "grp")).alias("unit"))
    all_items = scratch.keep(weights.join(grouped, "item", "left").select("item", "rows", F.coalesce("unit", F.concat(F.lit("item:"), "item")).alias("unit")))
    units = scratch.keep(assign_units(all_items.groupBy("unit").agg(F.sum("rows").alias("rows")), scratch, shares, seed))
    hot = heavy_keys(all_items, "unit", rows_of(all_items))
    return join_on_unique(all_items, units, "unit", "left", hot).select("item", "unit", "split", "rows")


def torn_entities(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Entities of ``rows`` (item, entity, place) with more than one place, NULL places left aside.

    Components of items and entities are what must share a split. One that lies in a single place holds no torn entity and is
    left aside as a whole; only the entities of the others are looked into one by one. Rows are first reduced to distinct
    entities and places, so a group of any size is as many rows as it has places.
    """
    members = scratch.keep(rows.where("item is not null and entity is not null").select("item", F.col("entity").alias("grp")).distinct())
    _, labels = group_labels(members, scratch, hook_and_shortcut)
    seen = rows.where("entity is not null and place is not null").select(F.col("entity").alias("grp"), "place").distinct()
    seen = scratch.keep(seen.join(labels, "grp", "left").select("grp", "place", F.coalesce("label", "grp").alias("unit")))
    torn = seen.groupBy("unit").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo != hi").select("unit")
    inside = join_on_unique(seen, torn, "unit", "inner", heavy_keys(seen, "unit", rows_of(seen)))
    return inside.groupBy("grp").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo != hi").select(F.col("grp").alias("entity"))


def _image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "canonical_splits").select(F.col("image_id").alias("item"), read_label("duplicate_group_id").alias("grp"), F.when(F.col("fold") != -1, F.col("fold")).alias("place"))


def _seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row names its seed and nothing else that must stay together: the seed is item and entity at once."""
    seed = F.when(F.col("seed") >= 0, F.col("seed").cast("string"))
    return table(spark, sf_dir, "per_seed_external_metrics").select(seed.alias("item"), seed.alias("grp"), read_label("generator").alias("place"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = torn_entities(_image_rows(spark, sf_dir).withColumnRenamed("grp", "entity"), Scratch(spark, "p2i"))
    seeds = torn_entities(_seed_rows(spark, sf_dir).withColumnRenamed("grp", "entity"), Scratch(spark, "p2s"))
    kind = lambda df, k: df.select(F.lit(k).alias("entity_kind"), F.col("entity").alias("entity_key"))
    return kind(groups, "group").unionByName(kind(seeds, "seed"))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_kind, entity_key, split, rows): every image of canonical_splits and every seed of per_seed_external_metrics."""
    images = grouped_splits(_image_rows(spark, sf_dir), Scratch(spark, "p2a"))
    seeds = grouped_splits(_seed_rows(spark, sf_dir), Scratch(spark, "p2b"))
    kind = lambda df, k: df.select(F.lit(k).alias("entity_kind"), F.col("item").alias("entity_key"), "split", "rows")
    return kind(images, "image").unionByName(kind(seeds, "seed"))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_kind, split, rows, share) really reached."""
    per = p2_splits(spark, sf_dir).groupBy("entity_kind", "split").agg(F.sum("rows").alias("rows"))
    return per.withColumn("share", F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy("entity_kind")), 6))


def p2_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_kind, n_entities, rows, n_torn): are all entities there, with all their rows, and does the plan tear a group or seed apart?"""
    scratch = Scratch(spark, "p2u")
    out = []
    for kind, rows in (("image", _image_rows(spark, sf_dir)), ("seed", _seed_rows(spark, sf_dir))):
        placed = scratch.keep(grouped_splits(rows, scratch))
        torn = rows.where("item is not null and grp is not null").select("item", "grp").distinct().join(placed.select("item", "split"), "item")
        torn = torn.groupBy("grp").agg((F.min("split") != F.max("split")).alias("t")).agg(F.count_if("t").alias("n_torn"))
        out.append(placed.agg(F.count(F.lit(1)).alias("n_entities"), F.sum("rows").alias("rows")).crossJoin(torn).select(F.lit(kind).alias("entity_kind"), "*"))  # one row each
    return out[0].unionByName(out[1])
