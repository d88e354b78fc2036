import numpy as np
import pytest

from vellum.operators import raster


def disc(x, y, side=256):
    img = np.full((side, side, 3), 40, np.uint8)
    ys, xs = np.indices((side, side))
    img[(ys - y) ** 2 + (xs - x) ** 2 < 30**2] = (30, 200, 240)
    img[side - 20 : side - 10, 20:-20] = 128
    return img


def test_uniform_raster_has_no_saliency():
    img = np.full((64, 64, 3), 128, np.uint8)
    assert not raster.saliency_map(img).any()
    assert all(np.isfinite(v) for v in raster.all_features(img).values())


def test_saliency_follows_the_disc():
    left, right = raster.saliency_features(disc(60, 120)), raster.saliency_features(disc(200, 120))
    assert left["saliency_x"] < right["saliency_x"]
    assert sum(abs(left[k] - right[k]) > 1e-6 for k in left) >= 2


def test_there_are_38_finite_descriptors():
    rng = np.random.default_rng(0)
    found = raster.all_features(rng.integers(0, 256, (64, 80, 3)).astype(np.uint8))
    assert len(found) == 38 and all(np.isfinite(v) for v in found.values())


def test_hashes_survive_a_benign_change_and_part_from_the_complement():
    img = disc(90, 100)
    for f in (raster.average_hash, raster.perceptual_hash):
        base = f(img)
        assert (base != f(raster.scale_value(img, 1.05))).mean() < 0.1
        assert (base != f(255 - img)).mean() > 0.5


@pytest.mark.parametrize("name", sorted(raster.SENSITIVITY))
def test_manipulations_move_their_descriptor(name):
    img = disc(90, 100)
    img[20:60, 20:200] = (250, 250, 250)
    img[100:140, 30:60] = (60, 90, 200)
    f, signs = raster.SENSITIVITY[name]
    before, after = raster.all_features(img), raster.all_features(f(img, 3))
    for k, s in signs.items():
        assert (after[k] - before[k]) * s > 0, k


def test_standard_size_and_stability_keep_the_shape():
    img = disc(90, 100)
    assert raster.standardise_size(img[:, :200], 64).shape == (64, 64, 3)
    for f in raster.STABILITY.values():
        assert f(img).shape == img.shape and f(img).dtype == np.uint8


def test_describe_rejects_a_broken_raster(spark):
    df = spark.createDataFrame([(1, bytes(12), 2, 2)], "id int, data binary, height int, width int")
    assert raster.describe(df, "id", raster.operational_features).count() == 1
    bad = spark.createDataFrame([(1, bytes(5), 2, 2)], "id int, data binary, height int, width int")
    with pytest.raises(Exception, match="doesn't hold"):
        raster.describe(bad, "id", raster.operational_features).collect()


def test_variants_give_a_row_each(spark):
    img = disc(60, 60, 128)
    df = spark.createDataFrame([(7, img.tobytes(), 128, 128)], "id int, data binary, height int, width int")
    out = raster.variants(df, "id", raster.STABILITY).collect()
    assert {(r["transform"], r["level"]) for r in out} == set(raster.STABILITY) and all(len(r["data"]) == img.size for r in out)


def test_colours_on_known_rasters():
    """Two halves, red and blue: hues 0 and 120 in steps of two degrees."""
    img = np.zeros((20, 20, 3), np.uint8)
    img[:, :10, 2], img[:, 10:, 0] = 255, 255
    got = raster.colour_features(img)
    assert got["num_dominant_colors"] == 2 and got["hue_mean"] == 60 and got["saturation_mean"] == 255 == got["value_mean"] and got["saturation_std"] == 0
    assert got["warm_color_ratio"] == 0.5 and got["color_harmony"] == 1.0  # 60 apart on the circle of 180
    assert abs(got["color_entropy"] - np.log(2)) < 1e-5
    assert raster.lightness(np.array([[[255, 255, 255], [0, 0, 0]]], np.uint8)).tolist() == [[255.0, 0.0]]


def test_texture_on_known_rasters():
    flat = raster.texture_features(np.full((16, 16, 3), 77, np.uint8))
    assert (flat["gray_mean"], flat["gray_std"], flat["glcm_contrast"], flat["glcm_energy"], flat["glcm_homogeneity"], flat["glcm_correlation"], flat["edge_density"], flat["gradient_energy"]) == (77, 0, 0, 1, 1, 1, 0, 0)
    stripes = np.zeros((16, 16, 3), np.uint8)
    stripes[:, 1::2] = 255
    got = raster.cooccurrence(raster.grey_bytes(stripes) // 4, 0, 1, 64)
    assert got[0, 63] == got[63, 0] == 0.5 and raster.cooccurrence(raster.grey_bytes(stripes) // 4, 1, 0, 64)[0, 0] == 0.5


def test_canny_draws_the_outline_once():
    img = np.zeros((40, 40), int)
    img[10:30, 10:30] = 200
    edges = raster.canny(img, 50, 150)
    assert edges[:, 5].sum() == 0 and edges[20].sum() == 2 and edges[:, 20].sum() == 2
    faint = np.zeros((40, 40), int)
    faint[10:30, 10:30] = 20
    assert not raster.canny(faint, 50, 150).any() and raster.canny(faint, 50, 70).any()


def test_mirror_similarity():
    rng = np.random.default_rng(4)
    half = rng.integers(0, 256, (32, 16))
    assert abs(raster.mirror_similarity(np.hstack([half, half[:, ::-1]])) - 1) < 1e-9
    assert raster.mirror_similarity(rng.integers(0, 256, (32, 32))) < 0.3
    assert raster.mirror_similarity(np.full((20, 20), 9)) == 1 and raster.mirror_similarity(np.zeros((4, 9), int)) == 0.5
