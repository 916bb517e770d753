"""Band enhancement against loops over arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.operators import enhance


def mirror(i, n):
    return -i if i < 0 else 2 * (n - 1) - i if i >= n else i


def smooth(x):
    h, w = x.shape
    out = np.zeros_like(x)
    for r in range(h):
        for c in range(w):
            top = bottom = 0.0
            for i in range(-2, 3):
                for j in range(-2, 3):
                    if i * i + j * j <= 4:
                        v = x[mirror(r + i, h), mirror(c + j, w)]
                        k = math.exp(-(i * i + j * j) / 4.5 - (v - x[r, c]) ** 2 / (2 * 0.04**2))
                        top, bottom = top + k * v, bottom + k
            out[r, c] = top / bottom
    return out


def tables(levels, rows, cols, clip):
    h, w = levels.shape
    if h % rows or w % cols:
        ph, pw = rows - h % rows, cols - w % cols
        levels = np.array([[levels[mirror(r, h), mirror(c, w)] for c in range(w + pw)] for r in range(h + ph)])
    th, tw = levels.shape[0] // rows, levels.shape[1] // cols
    limit = max(int(clip * th * tw / 65536), 1)
    luts = {}
    for a in range(rows):
        for b in range(cols):
            hist = np.bincount(levels[a * th : (a + 1) * th, b * tw : (b + 1) * tw].ravel(), minlength=65536)
            cut = int(np.maximum(hist - limit, 0).sum())
            hist = np.minimum(hist, limit) + cut // 65536
            left = cut % 65536
            if left:
                step = max(65536 // left, 1)
                hist[: step * left : step] += 1
            luts[a, b] = np.minimum(np.rint(np.cumsum(hist) * (65535 / (th * tw))), 65535)
    return luts, th, tw


def equalise(levels, rows, cols, clip):
    luts, th, tw = tables(levels, rows, cols, clip)
    h, w = levels.shape
    out = np.zeros_like(levels)
    for r in range(h):
        for c in range(w):
            y, x = r / th - 0.5, c / tw - 0.5
            y1, x1 = math.floor(y), math.floor(x)
            v = 0.0
            for a, wy in ((y1, 1 - (y - y1)), (y1 + 1, y - y1)):
                for b, wx in ((x1, 1 - (x - x1)), (x1 + 1, x - x1)):
                    v += wy * wx * luts[min(max(a, 0), rows - 1), min(max(b, 0), cols - 1)][levels[r, c]]
            out[r, c] = np.rint(v)
    return out


@pytest.mark.parametrize(("h", "w", "tile"), [(16, 16, 64), (16, 24, 8), (17, 22, 8)])
def test_enhancement_matches_loops(spark, h, w, tile):
    rng = np.random.default_rng(h * w)
    band = np.clip(0.3 + 0.1 * np.add.outer(np.sin(np.arange(h) / 3), np.cos(np.arange(w) / 4)) + 0.05 * rng.normal(size=(h, w)), -0.1, 0.9)
    band[3, 4] = 0.0
    x = np.clip(band, 0, 0.6) / 0.6
    soft = smooth(x)
    rows, cols = max(1, round(h / tile)), max(1, round(w / tile))
    equal = equalise(np.floor(np.clip(soft, 0, 1) * 65535).astype(np.int64), rows, cols, 2.0) / 65535
    k = np.exp(-np.arange(-4, 5) ** 2 / 2.0)
    k /= k.sum()
    blur = np.array([[sum(k[i + 4] * k[j + 4] * equal[mirror(r + i, h), mirror(c + j, w)] for i in range(-4, 5) for j in range(-4, 5)) for c in range(w)] for r in range(h)])
    want = np.where(band > 0, np.clip(equal + 0.6 * (equal - blur), 0, 1) * 0.6, 0.0)
    df = spark.createDataFrame([(1, 2000, r, c, float(band[r, c])) for r in range(h) for c in range(w)], "lake int, yr int, r int, c int, nir double")
    got = {(r["r"], r["c"]): r["nir"] for r in enhance.enhanced(df, "nir", h, w, tile).collect()}
    assert len(got) == h * w
    # a level may fall to the other side of a step
    off = [abs(got[r, c] - want[r, c]) for r in range(h) for c in range(w)]
    assert np.quantile(off, 0.98) < 1e-5 and max(off) < 2e-3
