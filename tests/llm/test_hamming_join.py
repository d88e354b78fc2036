import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import hamming_join, minwise, near_images


def brute(bits, radius, side=None):
    out = set()
    for i, a in enumerate(bits):
        for j in range(i + 1, len(bits)):
            b = bits[j]
            if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= radius and (side is None or (side[i] & 1 and side[j] & 2) or (side[j] & 1 and side[i] & 2)):
                out.add((min(a, b), max(a, b)))
    return out


def signed(x):
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >= 1 << 63 else x


def planted(n, seed, shared=0):
    """Random hashes, some with near copies at distances 1 to 10; ``shared``: so many leading bits are alike in all."""
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 1 << 63, n, dtype=np.uint64)]
    if shared:
        base = [b & (1 << (64 - shared)) - 1 | 0xABCDEF0123456789 >> (64 - shared) << (64 - shared) for b in base]
    for b in base[: n // 3]:
        flip = 0
        for k in rng.choice(64 - shared, rng.integers(1, 11), replace=False):
            flip |= 1 << int(k)
        base.append(b ^ flip)
    return sorted({signed(b) for b in base})


@pytest.mark.parametrize("m", [9, 10, 11, 12, 13])
def test_all_pairs_for_every_number_of_blocks(spark, m):
    bits = planted(150, m)
    df = spark.createDataFrame([(b,) for b in bits], "bits bigint")
    got = [tuple(r) for r in hamming_join.near_pairs(df, 8, m=m).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(bits, 8)


@pytest.mark.parametrize("m,limit", [(10, 40), (10, 5), (9, 10), (12, 20)])
def test_long_lists_are_refined_and_scanned(spark, m, limit):
    """A third of the rows and more share their first blocks: lists exceed the boundary at both depths."""
    bits = sorted(set(planted(120, 7, shared=20) + planted(60, 8)))
    df = spark.createDataFrame([(b,) for b in bits], "bits bigint")
    got = [tuple(r) for r in hamming_join.near_pairs(df, 8, m=m, list_rows=limit).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(bits, 8)


@pytest.mark.parametrize("limit", [None, 10])
def test_only_pairs_across_sides(spark, limit):
    bits = sorted(set(planted(120, 5, shared=14)))
    side = [1 + i % 3 for i in range(len(bits))]
    df = spark.createDataFrame(list(zip(bits, side, strict=True)), "bits bigint, side int")
    got = {tuple(r) for r in hamming_join.near_pairs(df, 8, across=True, list_rows=limit).collect()}
    assert got == brute(bits, 8, side) and got


def test_blocks_grow_with_the_rows():
    picked = [hamming_join.choose_blocks(n, 8) for n in (100, 100_000, 10_000_000, 10_000_000_000)]
    assert picked == sorted(picked) and picked[0] == 9 and all(sum(hamming_join.block_widths(m)) == 64 for m in picked)


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "bits bigint")
    assert hamming_join.near_pairs(df).count() == 0
    assert hamming_join.near_pairs(spark.createDataFrame([(5,)], "bits bigint")).count() == 0


COLUMNS = "image_id string, phash string, sha256 string, bits string, side int, label int"


def listings(spark):
    """Spellings, nulls, broken hashes, repeated rows and columns whose names clash with the operator's own."""
    rows = [
        ("a", "00000000000000FF", None), ("a", " 0x00000000000000ff ", None), ("b", "0000-0000:0000 00fe", None), ("c", "00000000000000ff", None),
        ("d", "ffff0000000000ff", None), ("e", "0000000000000000", None), ("f", "n/a", None), ("g", None, None), (None, "00000000000000ff", None), ("h", "85f76d65a88f8c57aa", None),
    ]
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], COLUMNS)


def test_image_pairs_of_dirty_rows(spark, scratch):
    got = sorted(tuple(r) for r in near_images.near_image_pairs(listings(spark), scratch).collect())
    assert got == [("a", "b"), ("a", "c"), ("b", "c")]
    assert near_images.near_image_pairs(listings(spark).where("false"), scratch).count() == 0


def test_image_groups_keep_copies_together(spark, scratch):
    got = {r["image_id"]: (r["class_id"], r["n_links"]) for r in near_images.near_image_groups(listings(spark), scratch).collect()}
    assert got == {"a": (254, 1), "b": (254, 1), "c": (254, 1), "d": (signed(0xFFFF0000000000FF), 0)}
    assert near_images.near_image_groups(listings(spark).where("false"), scratch).count() == 0


def test_cross_split_pairs(spark, scratch):
    sha = "ab" * 32
    rows = [
        ("t1", "00000000000000ff", f"SHA256:{sha.upper()}"), ("e1", "00000000000000fe", None), ("e2", None, sha), ("e3", "f" * 16, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
        ("m1", "00000000000000ff", sha), ("t2", "00000000000000ff", None), ("e4", "00000000000000ff", sha), (None, "00000000000000ff", sha), ("t3", None, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
    ]
    roles = [("t1", " D-Development"), ("t2", "D_development"), ("t3", "d_development"), ("e1", "D_TEST"), ("e2", "D_stability"), ("e3", "D_test"), ("e4", "D_case_study"), ("e4", "D_case_study"), ("m1", "D_metric"), ("n1", None), (None, "D_test")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], COLUMNS)
    splits = spark.createDataFrame([(*r, "k", 3) for r in roles], "image_id string, role string, phash string, side int")
    for exact in (False, True):
        got = sorted(tuple(r) for r in near_images.cross_split_pairs(df, splits, scratch, exact=exact).collect())
        assert got == [("t1", "e1", "near"), ("t1", "e2", "exact"), ("t1", "e4", "both"), ("t2", "e1", "near"), ("t2", "e4", "near")]
    report = sorted(tuple(r) for r in near_images.overlap_report(df, splits, scratch).collect())
    assert report == [("d_case_study", "e4", 2, 1, 1, 2), ("d_stability", "e2", 1, 1, 1, 1), ("d_test", "e1", 2, 0, 1, 2)]
    assert near_images.overlap_report(df.where("false"), splits, scratch).count() == 0
    for a, b in ((df.where("false"), splits), (df, splits.where("false"))):
        assert near_images.cross_split_pairs(a, b, scratch).count() == 0


def test_a_radius_is_a_similarity():
    for d in range(65):
        assert ((64 - d) / (64 + d) >= 56 / 72) == (d <= 8)


def test_the_heavy_boundary_comes_from_the_cost():
    """A list is heavy from a core's fair share of the sorting on: more cores or more hashes move it, memory bounds it."""
    at = hamming_join.heavy_boundary
    assert at(10_000_000, 12, 8, 100) < at(10_000_000, 12, 8, 10) <= hamming_join.TASK_ROWS == at(10**10, 12, 8, 10)
    assert at(10, 10, 8, 10) > 10  # not worth a task


def test_minwise_hash_is_the_first_shingle_of_the_order():
    bits = np.random.default_rng(3).integers(0, 1 << 63, 200, dtype=np.uint64)
    order = minwise.shingle_order(4, 2)
    assert sorted(order.tolist()) == list(range(128))
    rank = {int(s): i for i, s in enumerate(order)}
    assert minwise.minwise(minwise.quarters(bits), order).tolist() == [min(rank[2 * p + (int(b) >> p & 1)] for p in range(64)) for b in bits]


def test_minwise_hashes_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    for d in (2, 8, 20):
        b = a ^ np.array([sum(1 << int(k) for k in rng.choice(64, d, replace=False)) for _ in a], np.uint64)
        equal = np.mean([minwise.minwise(minwise.quarters(a), o) == minwise.minwise(minwise.quarters(b), o) for o in (minwise.shingle_order(9, k) for k in range(300))])
        assert abs(equal - (64 - d) / (64 + d)) < 0.03


@pytest.mark.parametrize("n", [100, 50_000, 10_000_000])
def test_bands_keep_the_recall_asked_for(n):
    for miss in (0.01, 1e-5):
        assert 1 - minwise.choose_bands(n, 8, miss).recall(minwise.similarity_of(8)) <= miss


@pytest.mark.parametrize("n,parts", [(400_000, 12), (10_000_000, 200)])
def test_buckets_are_dealt_evenly(n, parts):
    """Half of the hashes have the first shingle of an order: large buckets go to the emptiest partition."""
    plan = minwise.choose_bands(n, 8)
    bits = np.random.default_rng(1).integers(0, 1 << 64, 20_000, dtype=np.uint64)
    load, lanes, largest = np.zeros(parts), minwise.bucket_lanes(plan, parts), 0
    for band, (known, dealt) in enumerate(lanes):
        key = minwise.band_key(minwise.quarters(bits), band, 0, plan.first)
        hit = np.isin(key, known)
        np.add.at(load, dealt[np.searchsorted(known, key[hit])], 1)
        load += (~hit).sum() / parts
        largest = max(largest, np.unique(key, return_counts=True)[1].max())
    assert load.max() < max(1.25 * load.mean(), largest + load.mean())  # a bucket isn't cut


def test_minwise_pairs_equal_brute_force(spark):
    bits = planted(250, 21)
    side = [1 + i % 3 for i in range(len(bits))]
    df = spark.createDataFrame(list(zip(bits, side, strict=True)), "bits bigint, side int")
    got = [tuple(r) for r in minwise.minwise_pairs(df, 8).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(bits, 8, side) and got
    few = {tuple(r) for r in minwise.minwise_pairs(df, 8, bands=minwise.Bands(3, 2, 2, 5)).collect()}
    assert few < set(got)  # with few bands pairs are missed, none is made up
    assert minwise.minwise_pairs(df.where("false"), 8).count() == 0


@pytest.mark.parametrize("chunk", [1000, 7])
def test_a_hash_of_many_images_is_paired_by_chunks(spark, scratch, monkeypatch, chunk):
    monkeypatch.setattr(near_images, "CHUNK_ROWS", chunk)
    rows = [(f"i{i:03d}", "00000000000000ff" if i < 40 else f"{255 + (1 << i % 16 + 8):016x}", "ab" * 32) for i in range(70)]
    df = spark.createDataFrame(rows, "image_id string, phash string, sha256 string")
    near = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1") <= 8
    want = {(x, y) for x, p, _ in rows for y, q, _ in rows if x < y and near(p, q)}
    got = [tuple(r) for r in near_images.near_image_pairs(df, scratch).collect()]
    assert len(got) == len(want) and set(got) == want
    splits = spark.createDataFrame([(r[0], "D_development" if i % 2 else "D_test") for i, r in enumerate(rows)], "image_id string, role string")
    pairs = [tuple(r) for r in near_images.cross_split_pairs(df, splits, scratch).select("train_id", "eval_id").collect()]
    assert len(pairs) == 35 * 35 == len(set(pairs))


def test_twenty_thousand_images_of_one_hash_are_many_small_tasks(spark):
    """Rows that meet in one key: a chunk of either side, however many images there are."""
    members = spark.range(20_000).select(F.concat(F.lit("i"), "id").alias("image_id"), F.lit(7).cast("bigint").alias("bits"))
    dealt = near_images.in_chunks(members, "bits", near_images.CHUNK_ROWS)
    sizes = [r["n"] for r in dealt.groupBy("bits", "chunk").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 20 and sum(sizes) == 20_000 and max(sizes) < 1.2 * near_images.CHUNK_ROWS
    side = lambda x: dealt.select("bits", F.col("image_id").alias(x), "chunk", "chunks")
    assert near_images.pairs_of_equals(side("x"), side("y"), "bits", "x", "y").where("x < y").count() == 20_000 * 19_999 // 2
