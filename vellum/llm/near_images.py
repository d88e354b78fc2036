"""Problems 1 and 5: images whose perceptual hashes differ in a few bits, as pairs, as groups and across splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.reading import read_label, read_phash, read_sha256
from vellum.llm.components import link_components
from vellum.llm.hamming_join import near_pairs
from vellum.llm.minwise import minwise_pairs
from vellum.operators.skew import heavy_keys, join_on_unique
from vellum.session import Scratch, rows_of, table

RADIUS = 8
#: Images of one hash that a task pairs with as many others.
CHUNK_ROWS = 1000


def image_hashes(listings: DataFrame) -> DataFrame:
    """Distinct (image_id, bits) of the rows with an image id and a readable phash; ``several``: has the image more than one?"""
    rows = listings.select("image_id", read_phash("phash").alias("bits")).where("image_id is not null and bits is not null")
    return rows.groupBy("image_id").agg(F.collect_set("bits").alias("b")).select("image_id", F.explode("b").alias("bits"), (F.size("b") > 1).alias("several"))


def in_chunks(members: DataFrame, key: str, rows: int) -> DataFrame:
    """``members`` with ``chunk`` (from 0) and ``chunks``: those of one ``key`` dealt to chunks of about ``rows``, by the hash of image_id."""
    hot = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select(key, F.ceil(F.col("_n") / rows).alias("_k"))
    dealt = members.join(hot, key, "left").withColumn("chunks", F.coalesce("_k", F.lit(1).cast("bigint"))).drop("_k")
    return dealt.withColumn("chunk", F.pmod(F.xxhash64("image_id"), F.col("chunks")))


def pairs_of_equals(a: DataFrame, b: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Pairs (x, y) of rows of ``a`` (key, x, chunk) and ``b`` (key, y, chunk, chunks), dealt alike, with one key, a pair of chunks at a time."""
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias(c)
    left = a.select(key, x, F.col("chunk").alias("_ca"), every("_cb"))
    right = b.select(key, y, every("_ca"), F.col("chunk").alias("_cb"))
    return left.join(right, [key, "_ca", "_cb"]).select(x, y)


def pairs_of_neighbours(pairs: DataFrame, a: DataFrame, b: DataFrame, keys: tuple[str, str], x: str, y: str) -> DataFrame:
    """Pairs (x, y) of the rows of ``a`` (key, x, chunk, chunks) and ``b`` for ``pairs`` of keys: each pair of chunks is a key of its own."""
    ka, kb = keys
    sizes = lambda df, k, c: df.where("chunks > 1").select(k, F.col("chunks").alias(c)).distinct()
    every = lambda c, n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(n, F.lit(1).cast("bigint")) - 1)).alias(c)
    split = pairs.join(sizes(a, ka, "_na"), ka, "left").join(sizes(b, kb, "_nb"), kb, "left")
    split = split.select(ka, kb, "_nb", every("_ca", F.col("_na"))).select(ka, kb, "_ca", every("_cb", F.col("_nb")))
    one = split.join(a.select(ka, F.col("chunk").alias("_ca"), x), [ka, "_ca"])
    return one.join(b.select(kb, F.col("chunk").alias("_cb"), y), [kb, "_cb"]).select(x, y)


def hash_pairs_to_images(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Image pairs (a < b) of hash pairs, and of images that hold the same hash. However many images hold a hash, a task meets
    CHUNK_ROWS x CHUNK_ROWS of its pairs."""
    side = lambda bits, x: members.select(F.col("bits").alias(bits), F.col("image_id").alias(x), "chunk", "chunks")
    apart = pairs_of_neighbours(pairs, side("bits_a", "x"), side("bits_b", "y"), ("bits_a", "bits_b"), "x", "y").where("x != y")
    same = pairs_of_equals(side("bits", "x"), side("bits", "y"), "bits", "x", "y").where("x < y")
    return apart.unionByName(same).select(F.least("x", "y").alias("image_id_a"), F.greatest("x", "y").alias("image_id_b"))


def near_image_pairs(listings: DataFrame, scratch: Scratch, radius: int = RADIUS, **options) -> DataFrame:
    """Pairs (image_id_a < image_id_b) of images whose readable hashes differ in at most ``radius`` bits.

    Rows without image id or readable hash take no part; repeated rows count once; images with one hash form pairs too.
    Other columns are ignored; an empty table gives an empty result.
    """
    members = scratch.keep(in_chunks(image_hashes(listings), "bits", CHUNK_ROWS))
    hashes = scratch.keep(members.select("bits").distinct())
    pairs = scratch.keep(near_pairs(hashes, radius, **options))
    found = hash_pairs_to_images(pairs, members)
    # an image has one readable hash, so its pairs come out once; those of images with more are made distinct
    several = members.where("several").select("image_id").distinct()
    if several.isEmpty():
        return found
    return found.distinct()


def near_image_groups(listings: DataFrame, scratch: Scratch, radius: int = RADIUS, **options) -> DataFrame:
    """One row per image with a readable hash: (image_id, class_id, n_links).

    ``class_id`` is the least hash (signed) of the hashes joined by links of ``radius`` bits or less, ``n_links`` the number of
    *other hashes* within the radius; copies of one hash share a class and aren't expanded into pairs.
    """
    members = scratch.keep(image_hashes(listings).select("image_id", "bits"))
    hashes = scratch.keep(members.select("bits").distinct())
    pairs = scratch.keep(near_pairs(hashes, radius, **options))
    classes = link_components(pairs.select(F.col("bits_a").alias("a"), F.col("bits_b").alias("b")), scratch)
    ends = pairs.select(F.explode(F.array("bits_a", "bits_b")).alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("n_links"))
    linked = scratch.keep(classes.withColumnRenamed("v", "bits").join(ends, "bits"))
    heavy = heavy_keys(members, "bits", rows_of(members))
    out = join_on_unique(members, linked, "bits", "left", heavy)
    return out.select("image_id", F.coalesce("label", "bits").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


TRAIN, EVALUATION = "d_development", ("d_test", "d_stability", "d_case_study")


def image_sides(splits: DataFrame) -> DataFrame:
    """(image_id, side, role): side 1 for training, 2 for evaluation; images with other roles or none are left out.

    An image has one role over its rows; should it have several, a training row counts first, then the least evaluation role.
    """
    role = read_label("role")
    side = F.when(role == TRAIN, 1).when(role.isin(*EVALUATION), 2).cast("tinyint")
    rows = splits.select("image_id", side.alias("side"), role.alias("role")).where("image_id is not null and side is not null")
    return rows.groupBy("image_id").agg(F.min(F.struct("side", "role")).alias("s")).select("image_id", "s.side", "s.role")


def _overlaps(listings: DataFrame, splits: DataFrame, scratch: Scratch, radius: int, exact: bool, **options) -> tuple[DataFrame, DataFrame]:
    """(image_id, sha, bits, side, role) of the images with a role, and the pairs (t, e) of hashes that are near across the sides."""
    sides = image_sides(splits)
    read = listings.select("image_id", read_sha256("sha256").alias("sha"), read_phash("phash").alias("bits")).where("image_id is not null and (sha is not null or bits is not null)")
    rows = scratch.keep(read.distinct().join(sides, "image_id").select("image_id", "sha", "bits", "side", "role"))
    hashes = scratch.keep(rows.where("bits is not null").groupBy("bits").agg(F.bit_or("side").alias("side")))
    pairs = near_pairs(hashes, radius, across=True, **options) if exact else minwise_pairs(hashes, radius, **options)
    sided = hashes.select(F.col("bits").alias("bits_a"), F.col("side").alias("sa")), hashes.select(F.col("bits").alias("bits_b"), F.col("side").alias("sb"))
    known = scratch.keep(pairs).join(sided[0], "bits_a").join(sided[1], "bits_b")
    way = lambda t, e, st, se: F.when((F.col(st).bitwiseAND(1) > 0) & (F.col(se).bitwiseAND(2) > 0), F.struct(F.col(t).alias("t"), F.col(e).alias("e")))
    apart = known.select(F.explode(F.array_compact(F.array(way("bits_a", "bits_b", "sa", "sb"), way("bits_b", "bits_a", "sb", "sa")))).alias("p")).select("p.t", "p.e")
    return rows, scratch.keep(apart.unionByName(hashes.where("side = 3").select(F.col("bits").alias("t"), F.col("bits").alias("e"))))


def cross_split_pairs(listings: DataFrame, splits: DataFrame, scratch: Scratch, radius: int = RADIUS, exact: bool = False, **options) -> DataFrame:
    """(train_id, eval_id, kind) of overlaps between training and evaluation images; kind: exact, near or both.

    Near ones come from minwise signatures in banded buckets (:mod:`vellum.llm.minwise`), verified by their exact similarity:
    a hash is a set of 64 shingles (position, bit), and ``radius`` bits are Jaccard similarity (64 - radius) / (64 + radius). A pair
    at that bound is missed with probability ``minwise.MISS`` at most. With ``exact`` the block join of problem 1 takes their
    place, which misses none.
    Images without a role, NULL ids, and unreadable hashes take no part. An empty table gives an empty result.
    """
    rows, verified = _overlaps(listings, splits, scratch, radius, exact, **options)
    chunked = lambda key: scratch.keep(in_chunks(rows.where(F.col(key).isNotNull()).select(key, "image_id", "side").distinct(), key, CHUNK_ROWS))
    side = lambda df, s, key, name, x: df.where(F.col("side") == s).select(F.col(key).alias(name), F.col("image_id").alias(x), "chunk", "chunks")
    by_hash, by_sha = chunked("bits"), chunked("sha")
    near = pairs_of_neighbours(verified, side(by_hash, 1, "bits", "t", "train_id"), side(by_hash, 2, "bits", "e", "eval_id"), ("t", "e"), "train_id", "eval_id")
    same = pairs_of_equals(side(by_sha, 1, "sha", "sha", "train_id"), side(by_sha, 2, "sha", "sha", "eval_id"), "sha", "train_id", "eval_id")
    found = near.withColumn("kind", F.lit("near")).unionByName(same.withColumn("kind", F.lit("exact"))).groupBy("train_id", "eval_id").agg(F.min("kind").alias("k1"), F.max("kind").alias("k2"))
    return found.select("train_id", "eval_id", F.when(F.col("k1") == F.col("k2"), F.col("k1")).otherwise("both").alias("kind"))


def overlap_report(listings: DataFrame, splits: DataFrame, scratch: Scratch, radius: int = RADIUS, **options) -> DataFrame:
    """(role, source, n_pairs, n_exact, n_eval_images, n_train_images) per evaluation role and source, the piece of the evaluation
    image's id before the first ``_``.

    Pairs are counted, not listed: from how many images of either side hold a hash or digest. Of an image with several readable
    hashes or digests the least counts. For the rest see :func:`cross_split_pairs`.
    """
    rows, verified = _overlaps(listings, splits, scratch, radius, False, **options)
    one = rows.groupBy("image_id").agg(F.min("sha").alias("sha"), F.min("bits").alias("bits"), F.first("side").alias("side"), F.first("role").alias("role"))
    one = scratch.keep(one.withColumn("source", F.split_part("image_id", F.lit("_"), F.lit(1))))
    train, evaluated, by = one.where("side = 1"), one.where("side = 2"), ["role", "source"]
    n = F.count(F.lit(1))
    totals = lambda df, *keys: df.groupBy(*keys).agg(n.alias("n"))
    t, e = F.col("bits").alias("t"), F.col("bits").alias("e")
    near = scratch.keep(verified.join(totals(train.select(t), "t"), "t").join(totals(evaluated.select(e, *by), "e", *by).withColumnRenamed("n", "m"), "e"))
    per_sha = totals(train.where("sha is not null").select("sha", t), "sha", "t"), totals(evaluated.where("sha is not null").select("sha", e, *by), "sha", "e", *by).withColumnRenamed("n", "m")
    same = scratch.keep(per_sha[0].join(per_sha[1], "sha"))
    also_near = F.coalesce(F.bit_count(F.col("t").bitwiseXOR(F.col("e"))) <= radius, F.lit(False))
    pairs = F.col("n") * F.col("m")
    counts = near.select(*by, pairs.alias("p"), F.lit(0).alias("x")).unionByName(same.select(*by, F.when(also_near, 0).otherwise(pairs).alias("p"), pairs.alias("x")))
    counts = counts.groupBy(*by).agg(F.sum("p").cast("bigint").alias("n_pairs"), F.sum("x").cast("bigint").alias("n_exact"))
    # images that have any overlap: an image meets a hash or digest once for each role and source on the other side
    reached = lambda df, key, keys: df.select("image_id", F.col(key).alias("_k")).join(keys, "_k").select("image_id", "r", "s")
    groups = lambda df, key: df.select(F.col(key).alias("_k"), F.col("role").alias("r"), F.col("source").alias("s")).distinct()
    trained = reached(train, "bits", groups(near, "t")).unionByName(reached(train, "sha", groups(same, "sha"))).distinct().groupBy(F.col("r").alias("role"), F.col("s").alias("source")).agg(n.alias("n_train_images"))
    hit = lambda key, keys: evaluated.join(keys, key, "left_semi").select("image_id", *by)
    met = hit("bits", verified.select(F.col("e").alias("bits")).distinct()).unionByName(hit("sha", same.select("sha").distinct())).distinct().groupBy(*by).agg(n.alias("n_eval_images"))
    return counts.join(met, by).join(trained, by).select(*by, "n_pairs", "n_exact", "n_eval_images", "n_train_images")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_image_pairs(table(spark, sf_dir, "duplicate_groups"), Scratch(spark, "p1"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_image_groups(table(spark, sf_dir, "duplicate_groups"), Scratch(spark, "p1g"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cross_split_pairs(table(spark, sf_dir, "duplicate_groups"), table(spark, sf_dir, "canonical_splits"), Scratch(spark, "p5"))
    return pairs.select(F.least("train_id", "eval_id").alias("image_id_a"), F.greatest("train_id", "eval_id").alias("image_id_b"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(table(spark, sf_dir, "duplicate_groups"), table(spark, sf_dir, "canonical_splits"), Scratch(spark, "p5r"))
