"""Operators that deal their work to tiles, cells, ranges and blocks, against the same work done whole."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.operators import evaluate, graph, models, raster, risk, spatial
from limnos.streaming import feeds


def flood(cells):
    """Each cell with the first cell of its patch."""
    out = {}
    for start in sorted(cells):
        if start in out:
            continue
        stack = [start]
        while stack:
            r, c = stack.pop()
            if (r, c) in out:
                continue
            out[r, c] = start
            stack += [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (r + i, c + j) in cells and (r + i, c + j) not in out]
    return out


def spiral(n):
    """A path one cell wide that winds inwards with a gap of one between its turns."""
    cells, r, c, dr, dc, lengths = {(0, 0)}, 0, 0, 0, 1, [n - 1, n - 1, n - 1]
    while lengths[-1] > 2:
        lengths += [lengths[-1] - 2] * 2
    for steps in lengths:
        for _ in range(steps):
            r, c = r + dr, c + dc
            cells.add((r, c))
        dr, dc = dc, -dr
    return cells


@pytest.mark.parametrize("last", [4, 20_000])
def test_a_spiral_over_many_tiles_is_one_patch(spark, monkeypatch, last):
    """With all links contracted by joins, and with the last of them in one task."""
    monkeypatch.setattr(graph, "LAST_LINKS", last)
    cells = spiral(41)
    assert len(set(flood(cells).values())) == 1
    df = spark.createDataFrame([(1, 2000, r, c, 3) for r, c in cells], "lake int, yr int, r int, c int, cls int")
    got = {(r["r"], r["c"]): r["patch"] for r in raster.patches(df, 3, tile=7).collect()}
    assert got == dict.fromkeys(cells, "0,0")


def test_patches_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(41)
    rows = [(lake, 2000, r, c, int(rng.integers(0, 2))) for lake in (1, 2) for r in range(-9, 24) for c in range(31)]
    df = spark.createDataFrame(rows, "lake int, yr int, r int, c int, cls int")
    want = {}
    for lake in (1, 2):
        label = flood({(r, c) for k, _, r, c, v in rows if k == lake and v == 1})
        sizes = {}
        for first in label.values():
            sizes[first] = sizes.get(first, 0) + 1
        want |= {(lake, r, c): f"{first[0]},{first[1]}" for (r, c), first in label.items() if sizes[first] >= 3}
    for tile in (4, 256):
        assert {(r["lake"], r["r"], r["c"]): r["patch"] for r in raster.patches(df, 1, 3, tile=tile).collect()} == want
    assert raster.patches(df.where("cls = 7"), 7).collect() == []


def star(n, seed, cx, cy):
    """A closed outline of n edges around a centre."""
    rng = np.random.default_rng(seed)
    a = np.sort(rng.random(n)) * 2 * math.pi
    d = 20 + 6 * np.sin(9 * a) + rng.random(n)
    x, y = cx + d * np.cos(a), cy + d * np.sin(a)
    return np.stack((x, y, np.roll(x, -1), np.roll(y, -1)), axis=1)


def test_outlines_of_many_edges(spark):
    """Inside, distance and counts against all edges, and few rows for each point."""
    outlines = {1: star(3000, 1, 30, 30), 2: star(40, 2, 60, 35), 3: np.array([[0, 0, 8, 0], [8, 0, 8, 8], [8, 8, 0, 8], [0, 8, 0, 0]], float)}
    edges = spark.createDataFrame([(k, i, *map(float, e)) for k, es in outlines.items() for i, e in enumerate(es)], "lake int, seq int, x1 double, y1 double, x2 double, y2 double")
    rng = np.random.default_rng(3)
    points = [(i, *map(float, p)) for i, p in enumerate(np.concatenate((rng.random((300, 2)) * 90, [[8, 3], [0, 0], [4, 8], [16, 16]])))]
    df = spark.createDataFrame(points, "id long, x double, y double")

    def truth(x, y, e):
        x1, y1, x2, y2 = e.T
        with np.errstate(divide="ignore", invalid="ignore"):
            inside = int((((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1))).sum()) % 2 == 1
        t = np.clip(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0, 1)
        return inside, float(np.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)).min())

    for reach in (0.0, 2.5):
        near = {(r["id"], r["lake"]): (r["inside"], r["distance"]) for r in spatial.near_polygons(df, edges, reach).collect()}
        deep = {(r["id"], r["lake"]): (r["inside"], r["distance"]) for r in spatial.near_polygons(df, edges, reach, deep=True).collect()}
        for i, x, y in points:
            for k, e in outlines.items():
                inside, d = truth(x, y, e)
                if inside or d <= reach:
                    assert near[i, k][0] == inside and deep[i, k] == (inside, pytest.approx(d, abs=1e-9))
                    assert near[i, k][1] == (pytest.approx(d, abs=1e-9) if d <= reach else None)
                else:
                    assert (i, k) not in near and (i, k) not in deep
    met = df.withColumn("cx", F.floor(F.col("x") / 8)).withColumn("cy", F.floor(F.col("y") / 8)).join(spatial.reached(edges.where("lake = 1"), 2.5, 8.0), ["cx", "cy"]).count()
    assert met < 0.1 * len(points) * 3000


def test_running_sums_over_ranges_are_those_of_one_window(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(s), int(v)) for g, s, v in zip(rng.integers(0, 3, 900), rng.permutation(900), rng.integers(0, 9, 900), strict=True)]
    rows = [(0 if i % 3 else g, s, v) for i, (g, s, v) in enumerate(rows)]  # most are one group's
    got = {(r["g"], r["s"]): (r["v_upto"], r["v_all"]) for r in evaluate.running_sums(spark.createDataFrame(rows, "g int, s double, v int"), "g", F.desc("s"), {"v": "v"}).collect()}
    assert got == {(g, s): (sum(v2 for g2, s2, v2 in rows if g2 == g and s2 >= s), sum(v2 for g2, _, v2 in rows if g2 == g)) for g, s, _ in rows}


def test_order_statistics_reach_beyond_the_ends(spark):
    rows = [(1, float(v)) for v in (5, 1, 1, 9, 3, 3, 3, 7, 2, 8)] + [(2, 4.0), (2, None), (3, None)]
    got = {r["g"]: (r["lo"], r["hi"]) for r in evaluate.order_statistics(spark.createDataFrame(rows, "g int, v double"), "g", "v", 0.1).collect()}
    assert got == {1: (1.0, 9.0), 2: (-math.inf, math.inf)}
    assert evaluate.order_statistics(spark.createDataFrame(rows, "g int, v double"), "g", "v", 0.3).where("g = 1").first()["hi"] == 7.0


def test_lakes_are_taken_off_the_totals(spark, monkeypatch):
    """Fits from totals less two lakes are fits of the rest, and blocks of lakes change nothing."""
    rng = np.random.default_rng(6)
    rows = [(k, y, float(y), float(0.5 * y + 3 * k + rng.normal())) for k in range(7) for y in range(4 + k % 3)]
    df = spark.createDataFrame(rows, "lake int, yr int, x double, y double")
    p = 2

    def stats(keep):
        out = []
        for k in keep:
            z = np.array([(1.0, x, y) for lake, _, x, y in rows if lake == k])
            out.append(z.T @ z)
        return out

    whole = risk.totals(stats(range(7)))
    spread = risk.total_products(risk.sufficient(df, ["x"], "y"), p + 1)
    for m, (n, products, outer) in whole.items():
        assert spread[m][0] == n and np.allclose(spread[m][1], products) and np.allclose(spread[m][2], outer)
    rest = risk.without(whole, *stats([2, 5]))
    assert np.allclose(risk.reml(rest, p)[0], risk.reml(risk.totals(stats([0, 1, 3, 4, 6])), p)[0])
    once = sorted(map(tuple, risk.jackknife_plus(df, ["x"], "y", 0.2).collect()))
    monkeypatch.setattr(risk, "HELD_LAKES", 3)
    again = sorted(map(tuple, risk.jackknife_plus(df, ["x"], "y", 0.2).collect()))
    assert len(once) == len(rows) and np.allclose([r[2:] for r in once], [r[2:] for r in again])


SCENE = "lake int, yr int, r int, c int, v int"


def test_the_store_merges_parts_and_renews_stale_years(spark, tmp_path):
    landed, store = str(tmp_path / "landed"), str(tmp_path / "store")

    def drop(rows, schema=SCENE):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)

    def ingest(checkpoint, schema=SCENE, grid="2x2"):
        feeds.ingest_scenes(spark, landed, schema, store, str(tmp_path / checkpoint), grid).awaitTermination()
        return {(r["lake"], r["yr"], r["r"], r["c"]): r["v"] for r in spark.read.parquet(store).collect()}

    drop([(1, 2000, 0, 0, 5)])
    assert ingest("a") == {(1, 2000, 0, 0): 5}
    drop([(1, 2000, 0, 1, 6), (2, 2000, 0, 0, 1)])  # a second part of a stored year
    want = {(1, 2000, 0, 0): 5, (1, 2000, 0, 1): 6, (2, 2000, 0, 0): 1}
    assert ingest("a") == want
    files = {f.name for f in (tmp_path / "store").rglob("part-*.parquet")}
    assert ingest("b") == want  # a new checkpoint sees stored files again
    assert {f.name for f in (tmp_path / "store").rglob("part-*.parquet")} == files
    drop([(2, 2000, 0, 0, 9)])
    assert ingest("b")[1, 2000, 0, 1] == 6
    before = feeds.read_manifest(spark, store).count()
    drop([(1, 2000, 1, 1, 7)])
    assert ingest("b", grid="4x4")[1, 2000, 1, 1] == 7  # stale: read anew from all its files
    forms = {(r["lake"], r["form"].split()[-1]) for r in feeds.read_manifest(spark, store).collect()}
    assert forms == {(1, "2x2"), (2, "2x2"), (1, "4x4")} and feeds.read_manifest(spark, store).count() > before


def test_scorers_see_the_same_pixels(spark):
    rng = np.random.default_rng(9)
    rows = [(k, 2000, r, c, int(g > 500), int(g)) for k in (1, 2, 3) for r in range(12) for c in range(12) for g in [rng.integers(0, 1000)]]
    px = spark.createDataFrame([*rows, (1, 2000, 99, 99, None, 5)], "lake int, yr int, r int, c int, cls int, green int")
    scorers = {"forest": models.forest_scorer(["green"], trees=3, depth=3), "rule": models.rule_scorer((F.col("green") > 500).cast("int"))}
    scored = models.leave_one_out(px, scorers, cap=200).groupBy("scorer").agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("pred")).cast("int")).alias("hit")).collect()
    assert {r["scorer"]: r["n"] for r in scored} == {"forest": len(rows), "rule": len(rows)}
    assert all(r["hit"] > 0.95 for r in scored)


def test_patches_are_scored_in_batches(spark):
    rng = np.random.default_rng(10)
    rows = [(1, 2000, r, c, float(rng.random())) for r in range(8) for c in range(8)]
    px = spatial.patch_pixels(spark.createDataFrame(rows, "lake int, yr int, r int, c int, v double"), 4, 2, 8, 8)
    score = lambda cubes: np.concatenate([cubes, cubes - cubes.mean(axis=(2, 3), keepdims=True)], axis=1)
    got = {(r["r"], r["c"]): r["logits"] for r in models.averaged_logits(models.score_patches(px, ["v"], score, 4, at_once=2), 2).collect()}
    v = {(r, c): x for _, _, r, c, x in rows}
    for (r, c), logits in got.items():
        means = [np.mean([v[i, j] for i in range(a, a + 4) for j in range(b, b + 4)]) for a in (0, 2, 4) for b in (0, 2, 4) if a <= r < a + 4 and b <= c < b + 4]
        assert logits == pytest.approx([v[r, c], v[r, c] - np.mean(means)])


def test_distances_without_a_cap_are_exact(spark):
    rng = np.random.default_rng(11)
    for n in (1, 2, 50):
        f = np.where(rng.random(n) < 0.4, rng.integers(0, 90, n) ** 2.0, np.inf)
        want = [min(f[v] + (x - v) ** 2 for v in range(n)) for x in range(n)]
        assert raster.lower_envelope(f).tolist() == want
    on = {(int(r), int(c)) for r, c in rng.integers(0, 25, (9, 2))}
    df = spark.createDataFrame([(1, 2000, r, c, (r, c) in on) for r in range(25) for c in range(3, 31)] + [(2, 2000, 0, c, False) for c in range(4)], "lake int, yr int, r int, c int, m boolean")
    for r in raster.distance_to(df, "m", None).collect():
        want = min((math.hypot(r["r"] - a, r["c"] - b) * 20 for a, b in on if b >= 3), default=math.inf) if r["lake"] == 1 else math.inf
        assert r["distance"] == (pytest.approx(want, abs=1e-3) if want < math.inf else want)
