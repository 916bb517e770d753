"""Readers of landed map, weather, scene and panel files, all with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINT = "struct<lat: double, lon: double>"
ELEMENTS = f"elements array<struct<type: string, id: long, tags: map<string, string>, geometry: array<{POINT}>, members: array<struct<type: string, ref: long, role: string, geometry: array<{POINT}>>>, center: {POINT}, lat: double, lon: double>>"
GEOJSON = "features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
CATALOGUE = "features array<struct<id: string, properties: map<string, string>, assets: map<string, struct<href: string>>>>"
WEATHER = "properties struct<parameter: map<string, map<string, double>>>"
MISSING = -999.0


def read_pixels(spark: SparkSession, store: str, lake: int, yr: int, bands: list[str]) -> DataFrame:
    """Bands of one lake and year from the pixel store: other partitions and columns are not read."""
    return spark.read.parquet(store).where((F.col("lake") == lake) & (F.col("yr") == yr)).select("lake", "yr", "r", "c", *bands)


def read_elements(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row a map element: type, id, tags, geometry, members, center. Responses are a file each, or a line each."""
    whole = spark.read.schema(ELEMENTS).option("multiLine", multi_line).json(path)
    return whole.select(F.explode("elements").alias("e")).select("e.*")


def ways(elements: DataFrame) -> DataFrame:
    return elements.where("type in ('way', 'relation')")


def building_points(elements: DataFrame) -> DataFrame:
    """Centres of the elements that have one."""
    return elements.where("center.lat is not null and center.lon is not null").select("id", F.col("center.lon").alias("lon"), F.col("center.lat").alias("lat"))


def lines(elements: DataFrame, vertices: bool = False) -> DataFrame:
    """Lines of two or more vertices, whole or one row a vertex."""
    kept = elements.where("type = 'way' and size(geometry) >= 2").select("id", "geometry")
    if not vertices:
        return kept
    return kept.select("id", F.posexplode("geometry").alias("v", "p")).select("id", "v", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))


def read_polygons(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(lake, ring, seq, lon, lat) of each outline; MultiPolygon parts are rings of their own."""
    whole = spark.read.schema(GEOJSON).option("multiLine", multi_line).json(path)
    f = whole.select(F.explode("features").alias("f")).select(F.col("f.properties")["lake"].alias("lake"), "f.geometry.type", F.col("f.geometry.coordinates").alias("text"))
    rings = F.when(F.col("type") == "Polygon", F.from_json("text", "array<array<array<double>>>")).otherwise(F.flatten(F.from_json("text", "array<array<array<array<double>>>>")))
    flat = f.withColumn("rings", rings).select("lake", F.posexplode("rings").alias("ring", "pts"))
    return flat.select("lake", "ring", F.posexplode("pts").alias("seq", "p")).select("lake", "ring", "seq", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def edges_of(outlines: DataFrame) -> DataFrame:
    """Consecutive vertices of each ring as edges; open rings are closed."""
    w = Window.partitionBy("lake", "ring").orderBy("seq")
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(first))
    e = outlines.select("lake", "ring", "seq", F.col("lon").alias("x1"), F.col("lat").alias("y1"), nxt("lon").alias("x2"), nxt("lat").alias("y2"))
    return e.where("x1 <> x2 or y1 <> y2")


def read_weather(spark: SparkSession, path: str, city: str, multi_line: bool = True) -> DataFrame:
    """Daily rows from parameter-wise JSON; -999 is missing."""
    whole = spark.read.schema(WEATHER).option("multiLine", multi_line).json(path)
    long = whole.select(F.explode("properties.parameter").alias("name", "days")).select("name", F.explode("days").alias("day", "v"))
    value = F.when(F.col("v") != MISSING, F.col("v"))
    names = ["PRECTOTCORR", "T2M", "T2M_MAX", "T2M_MIN", "RH2M", "WS10M"]
    return long.groupBy(F.to_date("day", "yyyyMMdd").alias("date")).pivot("name", names).agg(F.first(value)).withColumn("city", F.lit(city))


def read_scenes(spark: SparkSession, path: str, most_cloud: float = 25.0, months: tuple[int, int] = (1, 4), multi_line: bool = True) -> DataFrame:
    """Scene catalogue of a season below a cloud limit."""
    whole = spark.read.schema(CATALOGUE).option("multiLine", multi_line).json(path)
    f = whole.select(F.explode("features").alias("f")).select("f.id", F.to_timestamp(F.col("f.properties")["datetime"]).alias("at"), F.col("f.properties")["eo:cloud_cover"].try_cast("double").alias("cloud"), F.transform_values("f.assets", lambda k, v: v["href"]).alias("assets"))
    return f.where((F.col("cloud") < most_cloud) & F.month("at").between(*months)).withColumn("yr", F.year("at"))


def read_panel(spark: SparkSession, path: str, numbers: list[str], fallback: str | None = None) -> DataFrame:
    """Lake-year panel from CSV; what is no number is null. ``fallback`` is read where ``path`` has nothing."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException:
        if fallback is None:
            raise
        raw = spark.read.option("header", True).csv(fallback)
    for c in numbers:
        v = F.col(c).try_cast("double")
        raw = raw.withColumn(c, F.when(~F.isnan(v), v))
    return raw.withColumn("year", F.col("year").try_cast("int"))


def aligned(layer: DataFrame, grid: DataFrame) -> DataFrame:
    """An external layer's pixels; fails if any lies off the grid (lake, h, w)."""
    off = layer.join(grid, "lake", "left").where("h is null or r < 0 or c < 0 or r >= h or c >= w")
    if not off.isEmpty():
        raise ValueError("the layer's pixels don't fit the grid")
    return layer


def clipped(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points inside each lake's box, borders included, by one-degree cells."""
    cells = boxes.withColumn("cx", F.explode(F.sequence(F.floor("minx"), F.floor("maxx")))).withColumn("cy", F.explode(F.sequence(F.floor("miny"), F.floor("maxy"))))
    placed = points.withColumn("cx", F.floor("lon")).withColumn("cy", F.floor("lat"))
    return placed.join(cells, ["cx", "cy"]).where("lon between minx and maxx and lat between miny and maxy").select("lake", *points.columns)


def clipped_lines(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Whole lines (id, geometry of lon and lat) of two vertices or more with any vertex in a lake's box, borders included.

    Vertices meet the boxes by one-degree cells; a line that has met a lake, however
    often, comes once, whole.
    """
    kept = lines.where(F.size("geometry") >= 2)
    vertices = kept.select("id", F.explode("geometry").alias("p")).select("id", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))
    met = clipped(vertices, boxes).select("lake", "id").distinct()
    return met.join(kept, "id").select("lake", *kept.columns)
