"""Outlines, distances, lengths, samples and storage against brute force."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos import storage
from limnos.operators import outlines, panel, raster, risk, spatial


def cells(spark, mask):
    rows = [(0, 0, int(r), int(c), int(mask[r, c])) for r in range(mask.shape[0]) for c in range(mask.shape[1])]
    return spark.createDataFrame(rows, "lake int, yr int, r int, c int, cls int")


def flood(mask):
    """Number of 8-connected patches, by hand."""
    left, n = set(zip(*map(list, np.nonzero(mask)), strict=True)), 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            r, c = todo.pop()
            for q in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if q in left:
                    left.discard(q)
                    todo.append(q)
    return n


def test_rings_enclose_their_patches(spark):
    rng = np.random.default_rng(31)
    mask = (rng.random((14, 17)) < 0.5).astype(int)
    mask[2:7, 2:7], mask[4, 4] = 1, 0  # a hole
    got = raster.patches(cells(spark, mask), 1)
    segments = outlines.straight(outlines.boundary(got))
    rings = outlines.rings(segments).collect()
    areas = {}
    for r in rings:
        pts = r["pts"]
        assert pts[0] == pts[-1] and len(pts) >= 5
        areas.setdefault(r["patch"], []).append(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:], strict=False)) / 2)
    sizes = {r["patch"]: r["count"] for r in got.groupBy("patch").count().collect()}
    assert {k: sum(v) for k, v in areas.items()} == sizes and len(sizes) == flood(mask)
    assert all(sum(x > 0 for x in v) == 1 for v in areas.values()) and any(x < 0 for v in areas.values() for x in v)
    sides = sum(mask[r, c] != (mask[r + i, c + j] if 0 <= r + i < 14 and 0 <= c + j < 17 else 0) for r in range(14) for c in range(17) if mask[r, c] for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))
    assert sum(r["perimeter"] for r in outlines.outlines(segments).collect()) == sides
    one = outlines.reconciled(got).collect()
    assert len(one) == 1 and one[0]["vector_ha"] == one[0]["raster_ha"] == round(mask.sum() * 0.04, 2) and one[0]["polygons"] == flood(mask)


def test_distances_stop_at_their_cap_and_change_sign_at_the_shore(spark):
    rng = np.random.default_rng(32)
    mask = (rng.random((9, 12)) < 0.08).astype(int)
    px = cells(spark, mask).withColumn("m", F.col("cls") == 1)
    hit = np.argwhere(mask)
    for cap in (60.0, None):
        got = {(r["r"], r["c"]): r["distance"] for r in raster.distance_to(px, "m", cap).collect()}
        for r in range(9):
            for c in range(12):
                d = 20 * np.sqrt(((hit - [r, c]) ** 2).sum(1)).min()
                assert got[r, c] == pytest.approx(d if cap is None else min(d, cap), abs=1e-4)
    empty = raster.distance_to(px.withColumn("m", F.lit(False)), "m", 60.0)
    assert {r["distance"] for r in empty.collect()} == {60.0}
    shore = {(r["r"], r["c"]): r["shore"] for r in raster.shoreline(px.select("lake", "r", "c", F.col("m").alias("inside"))).collect()}
    assert all((v < 0) == bool(mask[k]) and abs(v) >= 20 for k, v in shore.items())


def test_lengths_are_exact(spark):
    square = [(0, 0, 0, 4, 0), (1, 4, 0, 4, 4), (2, 4, 4, 0, 4), (3, 0, 4, 0, 0)]
    edges = spark.createDataFrame([(0, s, float(a), float(b), float(c), float(d)) for s, a, b, c, d in square], "lake int, seq int, x1 double, y1 double, x2 double, y2 double")
    line = spark.createDataFrame([(1, 0, -3.0, 2.0), (1, 1, 1.0, 2.0), (2, 0, 10.0, 10.0), (2, 1, 20.0, 20.0), (3, 0, 2.0, 1.0), (3, 1, 2.0, 1.0), (4, 0, 6.0, 6.0), (4, 1, 4.0, 4.0)], "id int, v int, x double, y double")
    assert spatial.length_within(line.where("id = 1"), edges, 0.0).first()["length"] == 1.0
    # from 2 before the square to 1 inside; then the diagonal up to the circle of radius 2 around the corner
    assert spatial.length_within(line.where("id = 1"), edges, 2.0).first()["length"] == 3.0
    assert spatial.length_within(line, edges, 2.0).first()["length"] == 5.0
    assert spatial.length_within(line.where("id = 2"), edges, 2.0).collect() == []


def test_samples_are_the_least_digests(spark):
    rows = spark.createDataFrame([(k % 3, k, k % 50) for k in range(600)], "lake int, r int, c int")
    got = panel.capped_sample(rows, ["lake"], ["r", "c"], 40).collect()
    want = [r for r in rows.withColumn("d", panel.drawn(["r", "c"])).collect()]
    for lake in range(3):
        least = sorted((r["d"], r["r"]) for r in want if r["lake"] == lake)[:40]
        assert sorted(r["r"] for r in got if r["lake"] == lake) == sorted(r for _, r in least)
    assert panel.capped_sample(rows, ["lake"], ["r", "c"], 1000).count() == 600


def test_shared_folder_must_be_named_off_local_masters():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Session())


def test_jackknife_of_the_mixed_model_matches_published_intervals(spark):
    """48 lake-years of buildings in the 75 m fence: predictions and 90 % intervals as published."""
    folder = Path(__file__).parent / "goldens"
    rows = spark.read.option("header", True).schema("lake string, yr int, buildings double, pred double, lo double, hi double").csv(str(folder / "buildings_75m.csv"))
    want = {(r["lake"], r["yr"]): r for r in rows.collect()}
    panel_rows = rows.select("lake", "yr", F.log1p("buildings").alias("log_built"), (F.col("yr") - 2020).alias("year_c"))
    got = risk.jackknife_plus(panel_rows, ["year_c"], "log_built", 0.1).collect()
    assert len(got) == len(want) == 48
    for r in got:
        w = want[r["lake"], r["yr"]]
        assert (r["pred"], r["lo"], r["hi"]) == pytest.approx((w["pred"], w["lo"], w["hi"]), abs=1e-6)
    fit = risk.coefficients(spark, risk.random_intercept(panel_rows, ["year_c"], "log_built")).where("name = 'year_c'").first()
    # growth of 5.4 % a year, 4.1 to 6.7
    assert [round((np.exp(fit[c]) - 1) * 100, 1) for c in ("coef", "lo", "hi")] == [5.4, 4.1, 6.7]


def test_jackknife_of_an_unbalanced_panel_is_the_mixed_fit_and_may_be_open(spark):
    rng = np.random.default_rng(33)
    rows = [(lake, yr, float(lake + 0.1 * yr + rng.normal(0, 0.05)), float(yr)) for lake in range(4) for yr in range(6) if (lake, yr) not in ((0, 0), (2, 5), (2, 4))]
    df = spark.createDataFrame(rows, "lake int, yr int, y double, x double")
    got = {(r["lake"], r["yr"]): r for r in risk.jackknife_plus(df, ["x"], "y", 0.01).collect()}
    assert len(got) == len(rows) and all(r["lo"] == -np.inf and r["hi"] == np.inf for r in got.values())
    for lake in range(4):
        fit = risk.random_intercept(df.where(F.col("lake") != lake), ["x"], "y")["coef"]
        assert all(got[k]["pred"] == pytest.approx(fit[0] + fit[1] * k[1], abs=1e-9) for k in got if k[0] == lake)
