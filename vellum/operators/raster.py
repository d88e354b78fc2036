"""Descriptors and transforms of rasters: pure NumPy functions on uint8 arrays [height, width, 3] in blue, green, red order.

They run inside Arrow batches (:func:`describe`), one process per task, never row by row through the JVM. Colour, texture and the
mirror symmetry follow the usual definitions of image libraries on 8-bit values: hue from 0 to 179, Sobel and Canny edges,
co-occurrence of 64 grey levels, structural similarity in windows of 7 x 7. Two things differ: the five clusters of dominant
colours start from fixed colours instead of random ones, and saliency is kept at 64 x 64. The projection fields and the
fast profile are this engine's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EDGE = 0.1


def luminance(img: np.ndarray) -> np.ndarray:
    """Luminance in [0, 1]."""
    x = img.astype(float) / 255.0
    return 0.114 * x[..., 0] + 0.587 * x[..., 1] + 0.299 * x[..., 2]


def hsv(img: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in [0, 1), saturation and value in [0, 1]."""
    b, g, r = (img[..., i].astype(float) / 255.0 for i in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = top - low
    safe = np.where(span > 0, span, 1.0)
    hue = np.where(top == r, (g - b) / safe % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6
    return np.where(span > 0, hue, 0.0), np.where(top > 0, span / np.where(top > 0, top, 1.0), 0.0), top


def entropy(counts: np.ndarray) -> float:
    """Shannon entropy in nats with 1e-10 added to the share of each bin."""
    p = counts.astype(float).ravel()
    p = p / (p.sum() + 1e-10) + 1e-10
    p /= p.sum()
    return float(-(p * np.log(p)).sum())


def hsv_bytes(img: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue from 0 to 179 in steps of two degrees, saturation and value from 0 to 255."""
    hue, sat, val = hsv(img)
    return np.rint(hue * 180).astype(int) % 180, np.rint(sat * 255).astype(int), np.rint(val * 255).astype(int)


def grey_bytes(img: np.ndarray) -> np.ndarray:
    return np.rint(luminance(img) * 255).astype(int)


def lightness(img: np.ndarray) -> np.ndarray:
    """L* of the CIE Lab space, scaled to 255."""
    x = img.astype(float) / 255.0
    linear = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92)
    y = 0.072169 * linear[..., 0] + 0.715160 * linear[..., 1] + 0.212671 * linear[..., 2]
    return np.rint(np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y) * 2.55)


def sobel(grey: np.ndarray, border: str = "reflect") -> tuple[np.ndarray, np.ndarray]:
    """Unscaled 3 x 3 derivatives along x and y."""
    p = np.pad(grey.astype(float), 1, mode=border)
    along = lambda q: (q[:-2] + 2 * q[1:-1] + q[2:])
    smooth_y, smooth_x = along(p), along(p.T).T
    return smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2]


def _shifted(x: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """``x`` seen from one step away, zeros beyond the border."""
    p = np.pad(x, 1)
    return p[1 + dy : 1 + dy + x.shape[0], 1 + dx : 1 + dx + x.shape[1]]


def canny(grey: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges: ridges of the gradient above ``low`` that are connected to one above ``high``."""
    gx, gy = sobel(grey, "edge")
    size, ax, ay = np.abs(gx) + np.abs(gy), np.abs(gx), np.abs(gy)
    flat, steep = ay < ax * np.tan(np.pi / 8), ay > ax * np.tan(3 * np.pi / 8)
    ridge = lambda dy, dx, strict: (size > _shifted(size, -dy, -dx)) & ((size > _shifted(size, dy, dx)) if strict else (size >= _shifted(size, dy, dx)))
    slanted = np.where(gx * gy < 0, ridge(1, -1, True), ridge(1, 1, True))
    keep = np.where(flat, ridge(0, 1, False), np.where(steep, ridge(1, 0, False), slanted)) & (size > low)
    edges = keep & (size > high)
    while True:
        grown = edges.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                grown |= _shifted(edges, dy, dx)
        grown &= keep
        if (grown == edges).all():
            return edges
        edges = grown


def box_means(x: np.ndarray, side: int, pad: tuple[int, int] | None) -> np.ndarray:
    """Means of ``side`` x ``side`` windows; with ``pad``, of windows around each pixel, the border mirrored."""
    if pad:
        x = np.pad(x, (pad, pad), mode="reflect") if min(x.shape) > 1 else np.pad(x, (pad, pad), mode="edge")
    total = np.pad(np.cumsum(np.cumsum(x.astype(float), 0), 1), ((1, 0), (1, 0)))
    return (total[side:, side:] - total[:-side, side:] - total[side:, :-side] + total[:-side, :-side]) / side**2


def mirror_similarity(grey: np.ndarray, side: int = 7) -> float:
    """Mean structural similarity of a raster and its mirror image; one half if no window fits."""
    if min(grey.shape) < side:
        return 0.5
    a, b = grey.astype(float), grey[:, ::-1].astype(float)
    mean = lambda x: box_means(x, side, None)
    n = side * side / (side * side - 1)
    ma, mb = mean(a), mean(b)
    va, vb, cov = n * (mean(a * a) - ma * ma), n * (mean(b * b) - mb * mb), n * (mean(a * b) - ma * mb)
    c1, c2 = (0.01 * np.ptp(grey)) ** 2, (0.03 * np.ptp(grey)) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))
    return float(np.where(np.isfinite(s), s, 1.0).mean())  # a raster of one value is its own mirror


def gradients(lum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude and direction (radians modulo pi) of Sobel gradients; the border repeats."""
    p = np.pad(lum, 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]) / 8
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]) / 8
    return np.hypot(gx, gy), np.arctan2(gy, gx) % np.pi


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, corners aligned on pixel centres."""
    ys = np.clip((np.arange(height) + 0.5) * x.shape[0] / height - 0.5, 0, x.shape[0] - 1)
    xs = np.clip((np.arange(width) + 0.5) * x.shape[1] / width - 0.5, 0, x.shape[1] - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(x0 + 1, x.shape[1] - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    if x.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    x = x.astype(float)
    return (1 - fy) * ((1 - fx) * x[y0][:, x0] + fx * x[y0][:, x1]) + fy * ((1 - fx) * x[y1][:, x0] + fx * x[y1][:, x1])


def standardise_size(img: np.ndarray, side: int = 512) -> np.ndarray:
    """Short side to ``side``, centre crop of the long one."""
    h, w = img.shape[:2]
    scale = side / min(h, w)
    x = resize(img, max(side, round(h * scale)), max(side, round(w * scale)))
    top, left = (x.shape[0] - side) // 2, (x.shape[1] - side) // 2
    return np.clip(np.rint(x[top : top + side, left : left + side]), 0, 255).astype(np.uint8)


# --- descriptors ------------------------------------------------------------------------------------------------------


def dominant_colours(img: np.ndarray, k: int = 5, rounds: int = 20, least: float = 0.05) -> int:
    """Clusters with more than ``least`` of the pixels after ``rounds`` of k-means over the distinct colours with their counts."""
    packed, counts = np.unique(img.reshape(-1, 3).astype(np.int64) @ np.array([1 << 16, 1 << 8, 1]), return_counts=True)
    colours = np.stack([packed >> 16, packed >> 8 & 255, packed & 255], 1).astype(float)
    by_light = np.argsort(colours @ np.array([0.114, 0.587, 0.299]), kind="stable")
    upto = np.cumsum(counts[by_light])
    centres = colours[by_light[np.searchsorted(upto, (np.arange(k) + 0.5) / k * upto[-1])]]
    for _ in range(rounds):
        near = ((colours[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        held = np.bincount(near, counts, k)
        moved = np.stack([np.bincount(near, counts * c, k) for c in colours.T], 1) / np.maximum(held, 1)[:, None]
        moved[held == 0] = centres[held == 0]
        if np.abs(moved - centres).max() < 1.0:
            break
        centres = moved
    return int((held > least * counts.sum()).sum())


def hue_distances(hue: np.ndarray, peaks: int) -> list[int]:
    """Circular distances (of 180) between the most frequent bins of five, all pairs of ``peaks`` of them."""
    top = np.argsort(np.bincount(hue.ravel() // 5, minlength=36), kind="stable")[-peaks:] * 5
    apart = [abs(int(a) - int(b)) for i, a in enumerate(top) for b in top[i + 1 :]]
    return [min(d, 180 - d) for d in apart]


#: Hue distances that count as harmonic.
HARMONIC = (0, 30, 60, 120, 180)


def colour_features(img: np.ndarray) -> dict[str, float]:
    hue, sat, val = hsv_bytes(img)
    joint = np.histogramdd(np.stack([hue.ravel(), sat.ravel(), val.ravel()], 1), bins=(12, 8, 8), range=((0, 180), (0, 256), (0, 256)))[0]
    pair = hue_distances(hue, 2)[0]
    return {
        "num_dominant_colors": float(dominant_colours(img)), "color_entropy": entropy(joint), "hue_mean": float(hue.mean()), "saturation_mean": float(sat.mean()),
        "saturation_std": float(sat.std()), "value_mean": float(val.mean()), "value_std": float(val.std()), "lightness_contrast": float(lightness(img).std()),
        "hue_contrast": float(np.mean(hue_distances(hue, 3)) / 90), "warm_color_ratio": float(((hue <= 30) | (hue >= 150)).mean()), "color_harmony": float(1 - min(abs(pair - a) for a in HARMONIC) / 90),
    }


def cooccurrence(grey: np.ndarray, dy: int, dx: int, levels: int) -> np.ndarray:
    """Symmetric shares of the pairs of levels that lie (dy, dx) apart."""
    h, w = grey.shape
    a = grey[: h - dy, max(0, -dx) : w - max(0, dx)]
    b = grey[dy:, max(0, dx) : w - max(0, -dx)]
    pairs = np.bincount((a * levels + b).ravel(), minlength=levels * levels).reshape(levels, levels).astype(float)
    pairs += pairs.T
    return pairs / max(pairs.sum(), 1.0)


def texture_features(img: np.ndarray, levels: int = 64) -> dict[str, float]:
    grey = grey_bytes(img)
    gx, gy = sobel(grey)
    size, direction = np.hypot(gx, gy), np.arctan2(gy, gx)
    strong = size > np.percentile(size, 70)
    i, j = np.indices((levels, levels))
    found = []
    for dy, dx in ((0, 1), (1, 1), (1, 0), (1, -1)):
        p = cooccurrence(grey // (256 // levels), dy, dx, levels)
        mean = (i * p).sum()
        var = ((i - mean) ** 2 * p).sum()
        found.append((((i - j) ** 2 * p).sum(), np.sqrt((p**2).sum()), (p / (1 + (i - j) ** 2)).sum(), ((i - mean) * (j - mean) * p).sum() / var if var > 1e-15 else 1.0))
    contrast, energy, homogeneity, correlation = np.mean(found, 0)
    return {
        "edge_density": float(canny(grey, 50, 150).mean()), "edge_orientation_entropy": entropy(np.histogram(direction[strong], bins=8, range=(-np.pi, np.pi))[0]) if strong.any() else 0.0,
        "glcm_contrast": float(contrast), "glcm_energy": float(energy), "glcm_homogeneity": float(homogeneity), "glcm_correlation": float(correlation),
        "gray_mean": float(grey.mean()), "gray_std": float(grey.std()), "gray_entropy": entropy(np.bincount(grey.ravel(), minlength=256)), "gradient_energy": float(size.mean()),
    }


def composition_features(img: np.ndarray) -> dict[str, float]:
    grey = grey_bytes(img)
    h, w = grey.shape
    salient = saliency_map(img)
    total, side = salient.sum(), len(salient)
    ys, xs = np.indices(salient.shape)
    cy, cx = ((ys * salient).sum() / total * h / side, (xs * salient).sum() / total * w / side) if total > 0 else (h / 2, w / 2)
    thirds = min(np.hypot(cy - h * a / 3, cx - w * b / 3) for a in (1, 2) for b in (1, 2))
    busy = box_means(255.0 * canny(grey, 30, 100), 32, (16, 15))
    size = np.hypot(*sobel(grey))
    y, x = np.indices(grey.shape)
    along = np.abs(y / max(h - 1, 1) - x / max(w - 1, 1)) < 0.1
    return {
        "symmetry": mirror_similarity(grey), "rule_of_thirds": float(1 - thirds / np.hypot(h, w)), "center_offset_x": float((cx - w / 2) / (w / 2)), "center_offset_y": float((cy - h / 2) / (h / 2)),
        "whitespace_ratio": float((busy < 0.02).mean()), "fg_bg_ratio": float((salient > salient.mean()).mean()), "diagonal_energy": float(size[along].sum() / size.sum()) if size.sum() > 0 else 0.0,
    }


def projection_features(img: np.ndarray) -> dict[str, float]:
    lum = luminance(img)
    edges = gradients(lum)[0] > EDGE
    rows = edges.mean(1) > 0.1
    side = max(1, min(lum.shape) // 8)
    blocks = np.array([lum[y : y + side, x : x + side].std() for y in range(0, lum.shape[0], side) for x in range(0, lum.shape[1], side)])
    cut = otsu(lum)
    dark = lum <= cut
    return {
        "edge_mean": float(edges.mean()), "text_block_count": float((rows[1:] & ~rows[:-1]).sum() + rows[0]), "block_std_cv": float(blocks.std() / blocks.mean()) if blocks.mean() > 0 else 0.0,
        "has_text": float(0.01 < dark.mean() < 0.5 and edges.mean() > 0.02),
    }


def otsu(lum: np.ndarray) -> float:
    counts, edges = np.histogram(lum, bins=64, range=(0, 1))
    p = counts / counts.sum()
    mid = (edges[:-1] + edges[1:]) / 2
    w, m = np.cumsum(p), np.cumsum(p * mid)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - m) ** 2 / (w * (1 - w))
    return float(mid[int(np.nanargmax(np.where(np.isfinite(between), between, -1)))])


def saliency_map(img: np.ndarray, side: int = 64) -> np.ndarray:
    """Spectral residual of the luminance, in [0, 1]; a uniform raster has none."""
    lum = resize(luminance(img), side, side)
    if np.ptp(lum) < 1e-12:
        return np.zeros((side, side))
    spectrum = np.fft.fft2(lum)
    log = np.log(np.abs(spectrum) + 1e-12)
    p = np.pad(log, 1, mode="wrap")
    smooth = sum(p[i : i + side, j : j + side] for i in range(3) for j in range(3)) / 9
    out = np.abs(np.fft.ifft2(np.exp(log - smooth + 1j * np.angle(spectrum)))) ** 2
    for _ in range(2):
        p = np.pad(out, 1, mode="edge")
        out = sum(p[i : i + side, j : j + side] for i in range(3) for j in range(3)) / 9
    return (out - out.min()) / np.ptp(out) if np.ptp(out) > 0 else np.zeros((side, side))


def saliency_features(img: np.ndarray) -> dict[str, float]:
    s = saliency_map(img)
    total = s.sum()
    ys, xs = np.indices(s.shape)
    cy, cx = ((ys * s).sum() / total / (len(s) - 1), (xs * s).sum() / total / (len(s) - 1)) if total > 0 else (0.5, 0.5)
    return {"saliency_mean": float(s.mean()), "saliency_std": float(s.std()), "saliency_max": float(s.max()), "saliency_x": float(cx), "saliency_y": float(cy), "saliency_area": float((s > 0.5).mean())}


def operational_features(img: np.ndarray) -> dict[str, float]:
    x = img.astype(float)
    lum = luminance(img)
    rg, yb = x[..., 2] - x[..., 1], (x[..., 2] + x[..., 1]) / 2 - x[..., 0]
    residual = []
    for k in (1, 2, 4):
        small = resize(lum, max(1, lum.shape[0] // (2 * k)), max(1, lum.shape[1] // (2 * k)))
        residual.append(entropy(np.histogram(np.clip(lum - resize(small, *lum.shape), -0.5, 0.5), bins=32, range=(-0.5, 0.5))[0]))
    return {
        "canny_edge_density": float((gradients(lum)[0] > EDGE).mean()), "multiscale_residual_entropy": float(np.mean(residual)), "colourfulness": float(np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean())),
        "global_luminance_cv": float(lum.std() / lum.mean()) if lum.mean() > 0 else 0.0, "horizontal_mirror_similarity": float(1 - np.abs(lum - lum[:, ::-1]).mean()),
    }


def average_hash(img: np.ndarray, side: int = 16) -> np.ndarray:
    """``side`` squared bits: is a cell of the shrunk luminance above its mean?"""
    small = resize(luminance(img), side, side)
    return (small > small.mean()).ravel()


def perceptual_hash(img: np.ndarray) -> np.ndarray:
    """64 bits: are the lowest 8 x 8 cosine coefficients of a 32 x 32 luminance above their median?"""
    small = resize(luminance(img), 32, 32)
    k, x = np.arange(8)[:, None], np.arange(32)[None, :]
    basis = np.cos(np.pi * (2 * x + 1) * k / 64)
    c = (basis @ small @ basis.T).ravel()
    return c > np.median(c)


def basic_features(img: np.ndarray) -> dict[str, float]:
    """Colour, texture and composition: what the audits of transforms look at."""
    return colour_features(img) | texture_features(img) | composition_features(img)


def all_features(img: np.ndarray) -> dict[str, float]:
    return basic_features(img) | projection_features(img) | saliency_features(img)


def fast_features(img: np.ndarray) -> dict[str, float]:
    """A cheaper profile on 256 x 256: mirror difference for symmetry, luminance for foreground, hue alone for entropy."""
    small = standardise_size(img, 256)
    hue, sat, val = hsv(small)
    lum = luminance(small)
    return {
        "symmetry": float(1 - np.abs(lum - lum[:, ::-1]).mean()), "fg_bg_ratio": float((lum < otsu(lum)).mean()), "color_entropy": entropy(np.histogram(hue, bins=36, range=(0, 1))[0]),
        "saturation_mean": float(sat.mean()), "value_mean": float(val.mean()), "edge_density": float((gradients(lum)[0] > EDGE).mean()),
    }


# --- transforms -------------------------------------------------------------------------------------------------------


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def scale_value(img: np.ndarray, factor: float) -> np.ndarray:
    return _bytes(img * factor)


def scale_contrast(img: np.ndarray, factor: float) -> np.ndarray:
    mean = luminance(img).mean() * 255
    return _bytes((img - mean) * factor + mean)


def resize_round_trip(img: np.ndarray, factor: float) -> np.ndarray:
    h, w = img.shape[:2]
    return _bytes(resize(resize(img, max(1, round(h * factor)), max(1, round(w * factor))), h, w))


def add_noise(img: np.ndarray, sigma: float, seed: int = 0) -> np.ndarray:
    return _bytes(img + np.random.default_rng(seed).normal(0, sigma * 255, img.shape))


def saturate(img: np.ndarray, factor: float) -> np.ndarray:
    grey = (luminance(img) * 255)[..., None]
    return _bytes(grey + (img - grey) * factor)


def sharpen(img: np.ndarray, amount: float) -> np.ndarray:
    p = np.pad(img.astype(float), ((1, 1), (1, 1), (0, 0)), mode="edge")
    blur = sum(p[i : i + img.shape[0], j : j + img.shape[1]] for i in range(3) for j in range(3)) / 9
    return _bytes(img + amount * (img - blur))


def add_shapes(img: np.ndarray, count: int, seed: int = 0) -> np.ndarray:
    out, rng = img.copy(), np.random.default_rng(seed)
    h, w = img.shape[:2]
    for _ in range(count):
        y, x, s = rng.integers(h), rng.integers(w), max(1, min(h, w) // 10)
        out[y : y + s, x : x + s] = rng.integers(0, 256, 3)
    return out


def add_bars(img: np.ndarray, count: int) -> np.ndarray:
    out, h = img.copy(), img.shape[0]
    thick = max(1, h // 40)
    for k in range(count):
        y = (k + 1) * h // (count + 1)
        out[y : y + thick, img.shape[1] // 8 : -max(1, img.shape[1] // 8)] = 20
    return out


def break_symmetry(img: np.ndarray, share: float) -> np.ndarray:
    out, w = img.copy(), img.shape[1]
    out[:, : max(1, round(w * share / 2))] = 255 - out[:, : max(1, round(w * share / 2))]
    return out


def fill_blank(img: np.ndarray, share: float, seed: int = 0) -> np.ndarray:
    """Covers the share of the lightest pixels with mid-tone texture."""
    lum = luminance(img)
    mask = lum >= np.quantile(lum, 1 - share)
    out = img.copy()
    out[mask] = np.random.default_rng(seed).integers(90, 170, (int(mask.sum()), 3))
    return out


#: Benign transforms (name, level) -> function, and manipulations (name, severity) -> (function, expected signs).
STABILITY: dict[tuple[str, str], Callable] = {
    ("value", "0.95"): lambda i: scale_value(i, 0.95), ("value", "1.05"): lambda i: scale_value(i, 1.05), ("contrast", "0.95"): lambda i: scale_contrast(i, 0.95),
    ("contrast", "1.05"): lambda i: scale_contrast(i, 1.05), ("resize", "0.95"): lambda i: resize_round_trip(i, 0.95), ("resize", "1.05"): lambda i: resize_round_trip(i, 1.05),
    ("noise", "0.005"): lambda i: add_noise(i, 0.005), ("noise", "0.01"): lambda i: add_noise(i, 0.01),
}
SENSITIVITY: dict[str, tuple[Callable, dict[str, int]]] = {
    "add_shapes": (lambda i, s: add_shapes(i, 4 * s), {"edge_density": 1}), "sharpen": (lambda i, s: sharpen(i, 0.5 * s), {"gradient_energy": 1}),
    "desaturate": (lambda i, s: saturate(i, 1 - 0.3 * s), {"saturation_mean": -1}), "saturate": (lambda i, s: saturate(i, 1 + 0.3 * s), {"saturation_mean": 1}),
    "add_text_bars": (lambda i, s: add_bars(i, 3 * s), {"edge_density": 1}), "reduce_symmetry": (lambda i, s: break_symmetry(i, 0.2 * s), {"symmetry": -1}),
    "add_colour_noise": (lambda i, s: add_noise(i, 0.05 * s), {"color_entropy": 1}), "reduce_whitespace": (lambda i, s: fill_blank(i, 0.1 * s), {"whitespace_ratio": -1}),
}


# --- Spark ------------------------------------------------------------------------------------------------------------


def describe(df: DataFrame, key: str, features: Callable[[np.ndarray], dict[str, float]], probe: np.ndarray | None = None) -> DataFrame:
    """(key, one DOUBLE per descriptor) of rasters in columns ``data`` (BINARY), ``height`` and ``width``. A raster of the wrong size or NULL raises."""
    names = list(features(np.zeros((16, 16, 3), np.uint8) if probe is None else probe))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, data, h, w in zip(pdf[key], pdf["data"], pdf["height"], pdf["width"], strict=True):
                if data is None or len(data) != h * w * 3:
                    raise ValueError(f"raster {k} doesn't hold {h} x {w} pixels")
                rows.append({key: k} | features(np.frombuffer(data, np.uint8).reshape(h, w, 3)))
            yield pd.DataFrame(rows, columns=[key, *names])

    return df.select(key, "data", "height", "width").mapInPandas(run, ", ".join([f"`{key}` {kind}", *[f"`{n}` double" for n in names]]))


def variants(df: DataFrame, key: str, transforms: dict[tuple[str, str], Callable]) -> DataFrame:
    """(key, transform, level, data, height, width): one row per raster and transform."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, data, h, w in zip(pdf[key], pdf["data"], pdf["height"], pdf["width"], strict=True):  # a frame per raster: variants are many times its size
                img = np.frombuffer(data, np.uint8).reshape(h, w, 3)
                yield pd.DataFrame([(k, t, level, f(img).tobytes(), h, w) for (t, level), f in transforms.items()], columns=[key, "transform", "level", "data", "height", "width"])

    return df.select(key, "data", "height", "width").mapInPandas(run, f"`{key}` {kind}, transform string, level string, data binary, height int, width int")
