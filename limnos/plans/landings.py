"""Queries of readers, writers and the ingest stream: files are landed from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators import models, outlines, risk
from limnos.plans.fixtures import view
from limnos.plans.maps import layers
from limnos.plans.registry import panel_query, query
from limnos.sources import landed, sinks
from limnos.storage import new_path
from limnos.streaming import feeds


def land(rows: DataFrame, name: str) -> str:
    """Write one JSON response a line; the path."""
    path = new_path(rows.sparkSession, name)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    return path


def responses(rows: DataFrame, item: Column, name: str, each: int = 100) -> DataFrame:
    """Items under ``name``, so many ids a response."""
    return rows.groupBy(F.floor(F.col("id") / each)).agg(F.collect_list(item).alias(name)).select(name)


# --- map elements, outlines, weather, scenes ------------------------------------------------


def elements(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Buildings (a seventh of them without a centre) and lines as landed map elements, read back."""
    place = lambda lat, lon: F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))
    building = F.struct(F.lit("node").alias("type"), "id", F.create_map(F.lit("building"), F.lit("yes")).alias("tags"), F.when(F.col("id") % 7 != 0, place(F.col("y"), F.col("x"))).alias("center"))
    whole = lines.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("v", "x", "y"))).alias("vs"))  # few vertices a line
    way = F.struct(F.lit("way").alias("type"), "id", F.create_map(F.lit("highway"), F.lit("road")).alias("tags"), F.transform("vs", lambda p: place(p["y"], p["x"])).alias("geometry"))
    path = land(responses(points, building, "elements"), "landed-buildings")
    more = land(responses(whole, way, "elements"), "landed-lines")
    spark = points.sparkSession
    return landed.read_elements(spark, path, False).unionByName(landed.read_elements(spark, more, False))


MAP = ("fx_points", "fx_lines")
panel_query("o_src_2_elements", "select 'node' as type, id, 0 as n, id % 7 <> 0 as centred from fx_points union all select 'way', id, count(*), false from fx_lines group by id",
    lambda p, li: elements(p, li).select("type", "id", F.greatest(F.coalesce(F.size("geometry"), F.lit(0)), F.lit(0)).alias("n"), F.col("center.lat").isNotNull().alias("centred")), MAP)
panel_query("o_src_3_building_points", "select id, x as lon, y as lat from fx_points where id % 7 <> 0", lambda p, li: landed.building_points(elements(p, li)), MAP)
panel_query("o_src_4_lines", "select id, v, x as lon, y as lat from fx_lines", lambda p, li: landed.lines(elements(p, li), True), MAP)


def polygons(edges: DataFrame) -> DataFrame:
    corner = lambda s: F.array(s["x1"].cast("double"), s["y1"].cast("double"))
    rings = edges.groupBy("lake").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x1", "y1"))), corner).alias("pts"))  # one outline a lake
    closed = F.concat("pts", F.slice("pts", 1, 1))
    feature = F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("lake"), F.col("lake").cast("string")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")).alias("geometry"))
    path = land(rings.select(F.array(feature).alias("features")), "landed-outlines")
    return landed.edges_of(landed.read_polygons(edges.sparkSession, path, False)).select("lake", "seq", "x1", "y1", "x2", "y2")


panel_query("o_src_5_polygons", "select lake::varchar as lake, seq, x1::double as x1, y1::double as y1, x2::double as x2, y2::double as y2 from fx_edges", polygons, ("fx_edges",))


def weather(days: DataFrame) -> DataFrame:
    """Daily rain and heat over all lakes, landed as maps of days by parameter with -999 for a missing value."""
    per_day = days.groupBy("d").agg(F.sum("rain_raw").cast("double").alias("rain"), F.max("tmax").cast("double").alias("tmax"))
    hot = F.when(F.col("tmax") < 39, F.col("tmax")).otherwise(landed.MISSING)
    series = lambda v: F.map_from_entries(F.collect_list(F.struct(F.date_format("d", "yyyyMMdd"), v)))  # noqa: E731  one entry a calendar day
    both = per_day.agg(F.struct(F.struct(series(F.col("rain")).alias("PRECTOTCORR"), series(hot).alias("T2M_MAX")).alias("parameter")).alias("properties"))
    read = landed.read_weather(days.sparkSession, land(both, "landed-weather"), "all", False)
    return read.select(F.col("date").cast("string").alias("date"), F.col("PRECTOTCORR").alias("rain"), F.col("T2M_MAX").alias("tmax"), "city")


panel_query("o_src_6_weather", ", p as (select d, sum(rain_raw)::double as rain, max(tmax)::double as tmax from fx_weather group by d) select d::varchar as date, rain, case when tmax < 39 then tmax end as tmax, 'all' as city from p", weather, ("fx_weather",))


def scenes(found: DataFrame) -> DataFrame:
    item = F.struct(
        F.col("id").cast("string").alias("id"),
        F.create_map(F.lit("datetime"), F.concat(F.col("d").cast("string"), F.lit("T05:00:00Z")), F.lit("eo:cloud_cover"), F.col("cloud").cast("string")).alias("properties"),
        F.create_map(F.lit("B03"), F.struct(F.concat(F.lit("scenes/"), "id", F.lit("/B03.tif")).alias("href"))).alias("assets"),
    )
    read = landed.read_scenes(found.sparkSession, land(responses(found, item, "features"), "landed-scenes"), multi_line=False)
    return read.select("id", "yr", "cloud", F.to_date("at").cast("string").alias("d"), F.col("assets")["B03"].alias("href"))


panel_query("o_src_7_scenes", "select id::varchar as id, yr, cloud::double as cloud, d::varchar as d, 'scenes/' || id || '/B03.tif' as href from fx_scenes where cloud < 25", scenes, ("fx_scenes",))

# --- panels, pixel stores, vectors, features ---------------------------------------------------


def panel_file(p: DataFrame) -> DataFrame:
    """A panel written as CSV with what is no number in it, and read as the fallback of a file that is not there."""
    path = new_path(p.sparkSession, "panel")
    sinks.write_panel(p.select("lake", F.col("yr").alias("year"), "water", F.when(F.col("yr") % 2 == 1, F.lit("n/a")).otherwise(F.col("built").cast("string")).alias("built")), path)
    return landed.read_panel(p.sparkSession, new_path(p.sparkSession, "no-panel"), ["lake", "water", "built"], path)


panel_query("o_src_8_snk_1_panel", "select lake::double as lake, yr as year, water, case when yr % 2 = 0 then built end as built from fx_fractions", panel_file)


def stored(px: DataFrame) -> str:
    path = new_path(px.sparkSession, "pixels")
    sinks.write_pixels(px, path)
    return path


panel_query("o_src_1_read_pixels", "select lake, yr, r, c, green, swir16 from fx_pixels where lake = 2 and yr = 1997", lambda px: landed.read_pixels(px.sparkSession, stored(px), 2, 1997, ["green", "swir16"]), ("fx_pixels",))
panel_query("o_snk_2_pixel_store", "select lake, yr, count(*) as n, sum(nir)::bigint as nir from fx_pixels group by lake, yr", lambda px: px.sparkSession.read.parquet(stored(px)).groupBy("lake", "yr").agg(F.count("*").alias("n"), F.sum("nir").alias("nir")), ("fx_pixels",))


def layer(keys: DataFrame, zones: DataFrame) -> DataFrame:
    """An external layer from its own store, on the grid or not at all."""
    path = stored(keys.select("lake", "yr", "r", "c", (F.col("pk") % 8).alias("code")))
    grid = zones.groupBy("lake").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    return landed.aligned(keys.sparkSession.read.parquet(path), grid).select("lake", "yr", "r", "c", "code")


panel_query("o_src_9_external_layer", "select lake, yr, r, c, pk % 8 as code from fx_key", layer, ("fx_key", "fx_zones"))


def vectors(px: DataFrame) -> DataFrame:
    path = new_path(px.sparkSession, "vectors")
    rows = px.select("lake", "yr", "r", "c", "nir")
    sinks.write_vectors(rows, path)
    return px.sparkSession.read.option("header", True).schema(rows.schema).csv(path)


panel_query("o_snk_3_vectors", "select lake, yr, r, c, nir from fx_pixels", vectors, ("fx_pixels",))

MASKS = ", g as (select * replace (dw % 4 as cls) from fx_grid), m as (select lake, 0 as layer from g where region and yr = 1995 and cls = 0 union all select lake, 1 from g where region and yr = 2001 and cls = 0 union all select lake, 2 from g where region and yr = 2001 and cls = 3 union all select lake, 3 from (select lake, r, c from g where region group by all having max(case when yr = 1995 then coalesce((cls = 3)::int, 0) end) = 0 and min(case when yr >= 2001 then coalesce((cls = 3)::int, 0) end) = 1))"


@query("o_snk_4_geojson", MASKS + " select lake, layer, round(count(*) * 0.04::double, 3) as ha from m group by lake, layer", ("fx_grid",))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Polygons of the layers' patches, written as features and read back: their areas are the cells'."""
    rings = outlines.rings(outlines.straight(outlines.boundary(layers(spark, sf))))
    area = F.sum(outlines.ring_area(F.col("pts"))) * 0.04
    whole = rings.groupBy("lake", "yr", "patch").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", "pts"))), lambda s: s["pts"]).alias("rings"), area.alias("area_ha"))
    path = new_path(spark, "features")
    sinks.features(whole.select(F.concat_ws(":", "lake", "yr", "patch").alias("id"), "area_ha", "rings", F.col("lake").cast("string").alias("lake"), F.col("yr").cast("string").alias("layer")), "rings", ["lake", "layer"]).write.text(path)
    read = spark.read.schema("properties struct<id: string, area_ha: double, lake: string, layer: string>, geometry struct<type: string, coordinates: array<array<array<double>>>>").json(path)
    read = read.withColumnsRenamed({"properties": "p"}).selectExpr("p.*", "geometry")
    return read.groupBy(F.col("lake").cast("int").alias("lake"), F.col("layer").cast("int").alias("layer")).agg(F.round(F.sum("area_ha"), 3).alias("ha"))


# --- rings of relations, streams, risk ------------------------------------------------------------


def stitched(edges: DataFrame) -> DataFrame:
    """Outlines put together again from their sides as way fragments, every other one turned round."""
    a, b = (F.array(F.col(x).cast("double"), F.col(y).cast("double")) for x, y in (("x1", "y1"), ("x2", "y2")))
    ways = edges.select(F.col("lake").alias("osm_id"), F.lit("outer").alias("role"), F.when(F.col("seq") % 2 == 0, F.array(a, b)).otherwise(F.array(b, a)).alias("pts"))
    return models.stitched(ways).select("osm_id", "role", F.size("ring").alias("n"), F.abs(outlines.ring_area(F.col("ring"))).alias("area"))


panel_query("o_ras_15_rings", "select lake as osm_id, 'outer' as role, count(*) + 1 as n, abs(sum(x1 * y2 - x2 * y1)) / 2.0::double as area from fx_edges group by lake", stitched, ("fx_edges",))


def ingested(px: DataFrame) -> DataFrame:
    """Pixels landed in three drops, the last of which repeats a year, and ingested after each."""
    spark = px.sparkSession
    drops, store, checkpoint = (new_path(spark, n) for n in ("drops", "store", "ingest"))
    rows = px.select("lake", "yr", "r", "c", "nir")
    for part in (rows.where("yr < 1998"), rows.where("yr >= 1998"), rows.where("yr = 1996")):
        part.write.mode("append").parquet(drops)
        feeds.ingest_scenes(spark, drops, rows.schema, store, checkpoint).awaitTermination()
    return spark.read.parquet(store).select("lake", "yr", "r", "c", "nir")


panel_query("o_str_1_ingest", "select lake, yr, r, c, nir from fx_pixels", ingested, ("fx_pixels",))


def ingested_in_parts(px: DataFrame) -> DataFrame:
    """Every lake's and year's pixels landed in two parts, the first of them twice, and ingested after each drop and anew."""
    spark = px.sparkSession
    drops, store = (new_path(spark, n) for n in ("drops", "store"))
    rows = px.select("lake", "yr", "r", "c", "nir")
    for k, part in enumerate((rows.where("(r + c) % 2 = 0"), rows.where("(r + c) % 2 = 1"), rows.where("(r + c) % 2 = 0"))):
        part.write.mode("append").parquet(drops)
        checkpoint = new_path(spark, f"ingest-{k % 2}")  # a lost checkpoint reads no stored file again
        feeds.ingest_scenes(spark, drops, rows.schema, store, checkpoint).awaitTermination()
    told = feeds.read_manifest(spark, store).groupBy("lake", "yr").agg(F.count_distinct("part").alias("parts"), F.count("*").alias("entries"))
    return feeds.read_store(spark, store, rows.schema).join(told, ["lake", "yr"]).groupBy("lake", "yr").agg(F.count("*").alias("n"), F.sum("nir").alias("nir"), (F.max("parts") == F.max("entries")).alias("once"))


panel_query("o_str_1_parts", "select lake, yr, count(*) as n, sum(nir)::bigint as nir, true as once from fx_pixels group by lake, yr", ingested_in_parts, ("fx_pixels",))


@query("o_str_2_stream", """with per as (select cast(ts as date) as day, sum(value) as rain from events group by all), s as (select day, rain, unnest(range(31)) as k from per)
select (day + k::int)::varchar as d, round(sum(rain), 4) as rain, count(*) as days from s group by day + k::int""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The feed as a stream of files by day, each followed by a drop of readings that come a day late and of repeated ones, and a last reading far ahead that closes all windows."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    drops, store, checkpoint = (new_path(spark, n) for n in ("feed", "rolled", "rolling"))
    # a reading comes with its own day, or a day late; some come again with the day after
    day = F.datediff("ts", F.lit("2000-01-01").cast("date"))
    late, again = F.col("event_id") % 5 == 0, F.col("event_id") % 7 == 0
    comes = F.array_compact(F.array(day + F.when(late, 1).otherwise(0), F.when(again, day + 1)))
    ahead = rows.agg(F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("interval 400 days")).alias("ts"), F.lit(0.0).alias("value"), (F.max(day) + 2).alias("drop"))
    feeds.land_in_order(rows.withColumn("drop", F.explode(comes)).unionByName(ahead), "drop", drops)  # a file a day
    feeds.rolled_stream(spark, drops, rows.schema, store, checkpoint).awaitTermination()
    out = spark.read.schema("d date, rain double, days long").parquet(store)
    last = rows.agg(F.to_date(F.max("ts")).alias("last"))
    return out.crossJoin(F.broadcast(last)).where(F.col("d") <= F.date_add("last", 30)).select(F.col("d").cast("string").alias("d"), "rain", "days")


@query("o_risk_1_water_model")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Water share by year and standardised rain, with a random intercept a lake."""
    rain = view(spark, sf, "fx_weather").groupBy("lake", F.year("d").alias("yr")).agg((F.sum("rain_raw") / 1e6).alias("rain"))
    p = view(spark, sf, "fx_fractions").join(rain, ["lake", "yr"])
    whole = p.agg(F.avg("rain").alias("m"), F.greatest(F.stddev_pop("rain"), F.lit(1e-9)).alias("s"))  # one row
    p = p.crossJoin(F.broadcast(whole)).withColumn("rain_z", (F.col("rain") - F.col("m")) / F.col("s")).withColumn("year_c", F.col("yr") - 1998)
    return risk.coefficients(spark, risk.random_intercept(p, ["year_c", "rain_z"], "water"))


@query("o_risk_1_3_building_growth")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Built pixels' log by year with a random intercept a lake; growth a year in percent with its interval."""
    p = view(spark, sf, "fx_panel").withColumn("log_built", F.log1p("built_px")).withColumn("year_c", F.col("yr") - 1998)
    table = risk.coefficients(spark, risk.random_intercept(p, ["year_c"], "log_built"))
    pct = lambda c: F.when(F.col("name") == "year_c", F.round((F.exp(c) - 1) * 100, 4))
    return table.withColumns({"growth_pct": pct("coef"), "growth_lo": pct("lo"), "growth_hi": pct("hi")})


@query("o_risk_4_interval_coverage")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage and median width of jackknife+ intervals of built land, by lake."""
    p = view(spark, sf, "fx_panel").select("lake", "yr", F.log1p("built_px").alias("log_built"), (F.col("yr") - 1998).alias("year_c"))
    return risk.coverage(risk.jackknife_plus(p, ["year_c"], "log_built", 0.1).withColumn("value", F.col("y")), "lake")
