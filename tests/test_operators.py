"""Operators against brute force, invariants and published results."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.functions import geo
from limnos.functions import spectral as S
from limnos.operators import evaluate, models, panel, raster, risk, spatial
from limnos.sources import landed, sinks
from limnos.streaming import feeds


def grid(spark, rng, h=12, w=14, p=0.4):
    rows = [(1, 2000, r, c, int(rng.integers(0, 4)) if rng.random() < 0.9 else None, int(rng.integers(0, 200))) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "lake int, yr int, r int, c int, cls int, nir int"), {(r, c): (k, n) for _, _, r, c, k, n in rows}


def test_norm_diff_is_zero_where_the_sum_is(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.3, 0.1), (1.0, -0.5)], "a double, b double")
    assert [round(r[0], 6) for r in rows.select(S.norm_diff(F.col("a"), F.col("b"))).collect()] == [0.0, 0.5, 1.0]


def test_patches_are_the_components(spark):
    df, cells = grid(spark, np.random.default_rng(3))
    wet = {k for k, v in cells.items() if v[0] == 0}
    seen, want = set(), []
    for start in sorted(wet):
        if start in seen:
            continue
        stack, part = [start], set()
        while stack:
            r, c = stack.pop()
            if (r, c) in part:
                continue
            part.add((r, c))
            stack += [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (r + i, c + j) in wet]
        seen |= part
        want.append(len(part))
    got = raster.patch_table(raster.patches(df, 0)).select("px").collect()
    assert sorted(r[0] for r in got) == sorted(want)


def test_distance_is_exact(spark):
    df, cells = grid(spark, np.random.default_rng(5))
    near = {k for k, v in cells.items() if v[0] == 3 and k[0] % 3 == 0}
    got = raster.distance_to(df.withColumn("m", F.coalesce((F.col("cls") == 3) & (F.col("r") % 3 == 0), F.lit(False))), "m", 100.0).collect()
    for r in got:
        want = min([math.hypot(r["r"] - a, r["c"] - b) * 20 for a, b in near], default=100.0)
        assert abs(r["distance"] - min(want, 100.0)) < 1e-3


def test_opening(spark):
    df, cells = grid(spark, np.random.default_rng(7), p=0.8)
    on = {k for k, v in cells.items() if v[1] > 30}
    eroded = {(r, c) for r, c in cells if all((r + i, c + j) in on for i in (-1, 0, 1) for j in (-1, 0, 1))}
    want = {(r, c) for r, c in cells if any((r + i, c + j) in eroded for i in (-1, 0, 1) for j in (-1, 0, 1))}
    got = raster.opened(df.withColumn("m", F.col("nir") > 30), "m").where("opened").collect()
    assert {(r["r"], r["c"]) for r in got} == want


def test_projection_round_trip_and_known_point(spark):
    rows = spark.createDataFrame([(77.6, 12.97), (0.5, 51.5), (-70.6, -33.4), (179.9, 10.0)], "lon double, lat double").withColumn("zone", geo.utm_zone(F.col("lon")))
    x, y = geo.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    xy = rows.select("lon", "lat", "zone", x.alias("x"), y.alias("y"))
    lon, lat = geo.lonlat(F.col("x"), F.col("y"), F.col("zone"), F.col("lat") < 0)
    for r in xy.select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r["lon"] - r["lon2"]) < 1e-8 and abs(r["lat"] - r["lat2"]) < 1e-8
    # on the central meridian the easting is 500 km; at the equator the northing is 0
    one = spark.range(1).select(*geo.utm(F.lit(75.0), F.lit(0.0), F.lit(43))).first()
    assert abs(one[0] - 500000) < 1e-6 and abs(one[1]) < 1e-6


def test_readings_follow_the_published_rule(spark):
    # three steps of one lake, levels rounded to four digits; the readings are the published ones
    rows = [(1, 2019, 0.40, 0.50, 0.05, 0.05), (1, 2020, 0.36, 0.50, 0.09, 0.05), (1, 2021, 0.27, 0.10, 0.47, 0.16), (1, 2022, 0.40, 0.30, 0.25, 0.05)]
    got = panel.readings(spark.createDataFrame(rows, "lake int, yr int, water double, veg double, bare double, built double")).orderBy("yr").collect()
    assert [r["reading"] for r in got] == [panel.READINGS[0], panel.READINGS[3], panel.READINGS[0]]
    assert [r["built_persists"] for r in got] == [True, False, True]


def test_wilcoxon_matches_enumeration(spark):
    rng = np.random.default_rng(1)
    d = rng.integers(-6, 9, 9)
    rows = spark.createDataFrame([(1, float(x), 0.0) for x in d], "g int, a double, b double")
    got = evaluate.wilcoxon(rows, "g").first()
    d = d[d != 0]
    ranks = np.array([(np.abs(d) < abs(x)).sum() + ((np.abs(d) == abs(x)).sum() + 1) / 2 for x in d])
    stat = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    sums = [sum(r for i, r in enumerate(ranks) if s >> i & 1) for s in range(1 << len(d))]
    assert got["statistic"] == stat and abs(got["p"] - min(1, 2 * sum(x <= stat for x in sums) / len(sums))) < 1e-5


def test_macro_f1_of_a_class_that_is_never_predicted(spark):
    cm = spark.createDataFrame([(0, 0, 0, 8), (0, 0, 1, 2), (0, 1, 1, 10), (0, 3, 1, 5)], "g int, truth int, pred int, n long")
    skip, zero = (evaluate.summary_metrics(cm, "g", z).first()["macro_f1"] for z in ("skip", "zero"))
    assert abs(zero * 3 - skip * 2) < 1e-5


def test_mixed_model_recovers_known_effects(spark):
    rng = np.random.default_rng(2)
    rows = [(k, y, float(2 + 0.5 * y + u + rng.normal(0, 0.1))) for k, u in enumerate(rng.normal(0, 1, 40)) for y in range(8)]
    fit = risk.random_intercept(spark.createDataFrame(rows, "lake int, yr int, v double"), ["yr"], "v")
    assert abs(fit["coef"][1] - 0.5) < 0.01 and abs(fit["residual_var"] - 0.01) < 0.003 and 0.5 < fit["group_var"] < 2


def test_jackknife_covers(spark):
    rng = np.random.default_rng(4)
    rows = [(k, y, float(0.3 * y + rng.normal())) for k in range(10) for y in range(5)]
    got = risk.jackknife_plus(spark.createDataFrame(rows, "lake int, yr int, v double"), ["yr"], "v", 0.1).collect()
    assert len(got) == 50 and sum(r["lo"] <= r["y"] <= r["hi"] for r in got) >= 40


def test_points_in_a_square(spark):
    edges = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 0.0), (1, 1, 10.0, 0.0, 10.0, 10.0), (1, 2, 10.0, 10.0, 0.0, 10.0), (1, 3, 0.0, 10.0, 0.0, 0.0)], "lake int, seq int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 10.0, 5.0), (3, 12.0, 5.0), (4, 13.0, 14.0), (5, 30.0, 5.0)], "id int, x double, y double")
    got = spatial.counts_in_zones(points, edges, {"near": 2.0, "far": 5.0}).first()
    assert (got["n_footprint"], got["n_near"], got["n_far"]) == (2, 1, 2)


def test_rings_are_stitched_and_closed(spark):
    ways = spark.createDataFrame([(7, "outer", [[0.0, 0.0], [1.0, 0.0]]), (7, "outer", [[1.0, 1.0], [1.0, 0.0]]), (7, "inner", [[0.2, 0.2], [0.3, 0.2], [0.3, 0.3]])], "osm_id long, role string, pts array<array<double>>")
    rings = {r["role"]: r["ring"] for r in models.stitched(ways).collect()}
    assert len(rings["outer"]) == 4 and rings["outer"][0] == rings["outer"][-1] and rings["inner"][0] == rings["inner"][-1]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "osm.json").write_text('{"elements": [{"type": "way", "id": 1, "geometry": [{"lat": 1, "lon": 2}, {"lat": 1, "lon": 3}], "center": {"lat": 1, "lon": 2.5}}, {"type": "way", "id": 2, "geometry": [{"lat": 1, "lon": 2}]}]}')
    e = landed.read_elements(spark, str(tmp_path / "osm.json"))
    assert landed.building_points(e).count() == 1 and landed.lines(e).count() == 1 and landed.lines(e, True).count() == 2
    (tmp_path / "w.json").write_text('{"properties": {"parameter": {"PRECTOTCORR": {"20200101": 3.5, "20200102": -999}, "T2M": {"20200101": 20}}}}')
    days = {str(r["date"]): r for r in landed.read_weather(spark, str(tmp_path / "w.json"), "x").collect()}
    assert days["2020-01-01"]["PRECTOTCORR"] == 3.5 and days["2020-01-02"]["PRECTOTCORR"] is None
    (tmp_path / "g.json").write_text('{"features": [{"type": "Feature", "properties": {"lake": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}]}')
    assert landed.edges_of(landed.read_polygons(spark, str(tmp_path / "g.json"))).count() == 3
    (tmp_path / "s.json").write_text('{"features": [{"id": "a", "properties": {"datetime": "2020-02-03T05:00:00Z", "eo:cloud_cover": "3.5"}, "assets": {"B03": {"href": "u"}}}, {"id": "b", "properties": {"datetime": "2020-02-03T05:00:00Z", "eo:cloud_cover": "60"}, "assets": {}}]}')
    assert [r["id"] for r in landed.read_scenes(spark, str(tmp_path / "s.json")).collect()] == ["a"]
    (tmp_path / "p.csv").write_text("lake,year,v\na,2020,1.5\na,x,nan\n")
    p = landed.read_panel(spark, str(tmp_path / "none.csv"), ["v"], str(tmp_path / "p.csv")).collect()
    assert [(r["year"], r["v"]) for r in p] == [(2020, 1.5), (None, None)]
    with pytest.raises(ValueError):
        landed.aligned(spark.createDataFrame([(1, 5, 5)], "lake int, r int, c int"), spark.createDataFrame([(1, 4, 4)], "lake int, h int, w int"))
    px = spark.createDataFrame([(1, 2000, 0, 0, 5)], "lake int, yr int, r int, c int, v int")
    sinks.write_pixels(px, str(tmp_path / "px"))
    assert spark.read.parquet(str(tmp_path / "px")).where("lake = 1 and yr = 2000").count() == 1
    sinks.write_panel(px, str(tmp_path / "csv"))
    sinks.write_vectors(px, str(tmp_path / "gz"))
    assert spark.read.option("header", True).csv(str(tmp_path / "gz")).count() == 1
    f = sinks.features(spark.createDataFrame([(1, 2.34567, [[0.0, 0.0], [1.0, 1.0]], "w")], "id int, area_ha double, ring array<array<double>>, cls string"), "ring", ["cls"]).first()[0]
    assert '"area_ha":2.346' in f


def test_streams_agree_with_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(200).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 20_000).alias("ts"), (F.col("id") % 7).cast("double").alias("value"))
    rows.coalesce(1).write.parquet(src)
    q = feeds.rolling(spark.readStream.schema(rows.schema).parquet(src), 5).writeStream.outputMode("append").format("memory").queryName("rolling_out").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["d"]: (r["rain"], r["days"]) for r in spark.table("rolling_out").collect()}
    want = {r["d"]: (r["rain"], r["days"]) for r in feeds.rolling_batch(rows, 5).collect()}
    assert got and all(want[d] == v for d, v in got.items())
    px = spark.createDataFrame([(1, 2000, 0, 0, 5), (1, 2001, 0, 0, 6)], "lake int, yr int, r int, c int, v int")
    px.write.parquet(str(tmp_path / "landed"))
    for _ in range(2):
        feeds.ingest_scenes(spark, str(tmp_path / "landed"), "lake int, yr int, r int, c int, v int", str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_summaries_write_plain_numbers(spark):
    xs = [0.0, -0.0, 0.5, 9999999.5, 1e7, 48445150.1, 46122990.0, -482934210837.25, 9999999999999998.0, 1e16, 1.5e17, 0.001, 0.0005, 0.0001, 5e-05, 1.5e-07, 1e-100, math.nan, math.inf, None]
    rows = [(k, x, [x, 1e8], {"a\"b": x}, (x, "1.0E7, \u20ac]"), None) for k, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "k long, x double, xs array<double>, m map<string, double>, s struct<y: double, `z z`: string>, none array<double>")
    got = {r["k"]: r["row"] for r in sinks.payload("k", only=df).collect()}
    for k, x, *_ in rows:
        y = x if x is not None and math.isfinite(x) else None
        want = {"k": k, "x": y, "xs": [y, 1e8], "m": {'a"b': y}, "s": {"y": y, "z z": "1.0E7, \u20ac]"}, "none": None}
        assert got[k] == json.dumps(want, separators=(",", ":"), ensure_ascii=False)


def test_a_feed_is_landed_in_order_and_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(120).select("id", F.when(F.col("id") < 100, 20 - F.col("id") % 10).cast("int").alias("drop"))
    feeds.land_in_order(rows.mapInArrow(count, rows.schema), "drop", str(tmp_path / "feed"))
    assert seen.value == 120  # and not once for each of the ten drops
    files = sorted((tmp_path / "feed").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    got = [sorted(r["id"] for r in spark.read.parquet(str(f)).collect()) for f in files]
    assert got == [[k for k in range(100) if 20 - k % 10 == d] for d in range(11, 21)]
