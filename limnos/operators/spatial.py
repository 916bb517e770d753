"""Spatial joins and rasterisation without a geometry library.

Inside is crossing parity of a ray with the polygon's edges; distance is the
least distance to an edge. Candidates meet by cell buckets, never by all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.storage import stage


def crosses(x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) to the right crosses the edge (x1, y1)-(x2, y2)."""
    y1, y2 = F.col("y1"), F.col("y2")
    at = F.col("x1") + (y - y1) * (F.col("x2") - F.col("x1")) / F.nullif(y2 - y1, F.lit(0))
    return ((y1 > y) != (y2 > y)) & (x < at)


def edge_distance(x: Column, y: Column) -> Column:
    """Distance from (x, y) to the edge."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = ((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))
    return F.sqrt(F.pow(x - F.col("x1") - t * dx, 2) + F.pow(y - F.col("y1") - t * dy, 2))


def in_cells(lo: Column, hi: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))


def boxes(edges: DataFrame) -> DataFrame:
    return edges.groupBy("lake").agg(F.min(F.least("x1", "x2")).alias("bx0"), F.max(F.greatest("x1", "x2")).alias("bx1"), F.min(F.least("y1", "y2")).alias("by0"), F.max(F.greatest("y1", "y2")).alias("by1"))


def banded(edges: DataFrame, cell: float) -> DataFrame:
    """Each edge once for every band of rows (cy) that it has a part in."""
    return edges.withColumn("cy", in_cells(F.least("y1", "y2"), F.greatest("y1", "y2"), cell))


def reached(edges: DataFrame, reach: float, cell: float) -> DataFrame:
    """Each edge once for every cell (cx, cy) with a point within ``reach`` of it, and few others.

    In each band of rows only the piece of the edge that lies within reach of
    the band is widened, so a long edge has cells along it and not in its box.
    """
    bands = edges.withColumn("cy", in_cells(F.least("y1", "y2") - reach, F.greatest("y1", "y2") + reach, cell))
    dy, dx, flat = F.nullif(F.col("y2") - F.col("y1"), F.lit(0)), F.col("x2") - F.col("x1"), F.col("y1") == F.col("y2")
    part = lambda y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - F.col("y1")) / dy))
    a, b = F.when(flat, 0.0).otherwise(part(F.col("cy") * cell - reach)), F.when(flat, 1.0).otherwise(part((F.col("cy") + 1) * cell + reach))
    xa, xb = F.col("x1") + a * dx, F.col("x1") + b * dx
    slack = 1e-9 * (1 + F.greatest(F.abs("x1"), F.abs("x2")))  # a cut end may round across a cell's side
    return bands.withColumn("cx", in_cells(F.least(xa, xb) - reach - slack, F.greatest(xa, xb) + reach + slack, cell))


def near_polygons(points: DataFrame, edges: DataFrame, reach: float, cell: float = 8.0, deep: bool = False) -> DataFrame:
    """(id, x, y, lake, inside, distance) of points in a polygon or within ``reach`` of it.

    Each polygon's box, widened by the reach, is laid on a grid of cells; points
    meet the polygons of their own cell. Crossings are then counted with the
    edges of the point's own band of rows, and distances taken to the edges
    that reach its cell, both by equi-joins: an outline of any number of edges
    is dealt to bands and cells, and meets a point with few of them. The
    distance of a point farther inside is null, or found if ``deep``.
    """
    outlines = boxes(edges)
    cells = outlines.withColumn("cx", in_cells(F.col("bx0") - reach, F.col("bx1") + reach, cell)).withColumn("cy", in_cells(F.col("by0") - reach, F.col("by1") + reach, cell))
    placed = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    in_box = F.col("x").between(F.col("bx0") - reach, F.col("bx1") + reach) & F.col("y").between(F.col("by0") - reach, F.col("by1") + reach)
    pairs = placed.join(cells, ["cx", "cy"]).where(in_box).select("id", "x", "y", "lake", "cx", "cy")
    key, x, y = ["id", "x", "y", "lake"], F.col("x"), F.col("y")
    crossing = pairs.join(banded(edges, cell), ["lake", "cy"]).select(*key, crosses(x, y).cast("int").alias("crossed"), F.lit(None).cast("double").alias("distance"))
    close = pairs.join(reached(edges, reach, cell), ["lake", "cx", "cy"]).select(*key, F.lit(0).alias("crossed"), edge_distance(x, y).alias("distance"))
    both = crossing.unionByName(close.where(F.col("distance") <= reach)).groupBy(*key).agg((F.coalesce(F.sum("crossed"), F.lit(0)) % 2 == 1).alias("inside"), F.min("distance").alias("distance"))
    near = both.where(F.col("inside") | F.col("distance").isNotNull())
    if not deep:
        return near
    found = stage(near, "near-polygons")
    out, rest, step = found.where("distance is not null"), found.where("distance is null"), max(reach, cell / 2)
    while not rest.isEmpty():  # each round looks four times as far, so there are few
        step *= 4
        here = rest.drop("distance").withColumn("cx", F.floor(F.col("x") / step)).withColumn("cy", F.floor(F.col("y") / step))
        seen = here.join(reached(edges, step, step), ["lake", "cx", "cy"], "left").groupBy(*key, "inside").agg(F.min(edge_distance(x, y)).alias("distance"))
        seen = stage(seen.withColumn("distance", F.when(F.col("distance") <= step, F.col("distance"))), "deep-points")
        out, rest = out.unionByName(seen.where("distance is not null")), seen.where("distance is null")
    return out


def counts_in_zones(points: DataFrame, edges: DataFrame, rings: dict[str, float]) -> DataFrame:
    """Points of the footprint and of each ring around it, border included."""
    near = near_polygons(points, edges, max(rings.values()))
    in_foot = F.col("inside") | (F.col("distance") == 0)
    return near.groupBy("lake").agg(F.count_if(in_foot).alias("n_footprint"), *[F.count_if(~in_foot & (F.col("distance") <= m)).alias(f"n_{name}") for name, m in rings.items()])


def band_pressure(points: DataFrame, edges: DataFrame, limits: list[float], areas: DataFrame) -> DataFrame:
    """Points of disjoint distance bands outside a polygon, a unit of area."""
    near = near_polygons(points, edges, limits[-1]).where("not inside and distance > 0")
    band = F.lit(None).cast("int")
    for k in range(len(limits) - 1, -1, -1):
        band = F.when(F.col("distance") <= limits[k], k).otherwise(band)
    n = near.groupBy("lake", band.alias("band")).agg(F.count("*").alias("n"))
    return areas.join(n, ["lake", "band"], "left").select("lake", "band", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "area_ha", F.round(F.coalesce("n", F.lit(0)) / F.nullif(F.col("area_ha"), F.lit(0.0)), 4).alias("per_ha"))


def cells_in_polygons(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Grid cells whose centre lies in a polygon."""
    centres = cells.select(F.concat_ws(",", "r", "c").alias("id"), (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"), "r", "c")
    return near_polygons(centres, edges, 0.0).where("inside").select("lake", F.floor("y").cast("int").alias("r"), F.floor("x").cast("int").alias("c"))


def counts_per_cell(points: DataFrame, height: int, width: int) -> DataFrame:
    """Points in each cell; those off the grid are dropped."""
    rc = points.select(F.floor("y").cast("int").alias("r"), F.floor("x").cast("int").alias("c"))
    return rc.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1)).groupBy("r", "c").agg(F.count("*").alias("n"))


def segments(lines: DataFrame) -> DataFrame:
    """Consecutive vertices of each line as edges."""
    w = Window.partitionBy("id").orderBy("v")
    return lines.select("id", "v", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")


def cells_touched(lines: DataFrame, height: int, width: int) -> DataFrame:
    """Every cell that a line touches: cells of a segment's box that the segment meets (slab test)."""
    s = segments(lines)
    lo = lambda a, b: F.greatest(F.lit(0), F.floor(F.least(a, b)).cast("int"))
    hi = lambda a, b, n: F.least(F.lit(n - 1), F.floor(F.greatest(a, b)).cast("int"))
    span = lambda a, b, n: F.when(lo(a, b) <= hi(a, b, n), F.sequence(lo(a, b), hi(a, b, n)))
    cells = s.withColumn("r", F.explode(span("y1", "y2", height))).withColumn("c", F.explode(span("x1", "x2", width)))
    t0, t1 = F.lit(0.0), F.lit(1.0)
    ok = F.lit(True)
    for p, q, cell in (("x1", "x2", "c"), ("y1", "y2", "r")):
        d = F.col(q) - F.col(p)
        near, far = (F.col(cell) - F.col(p)) / F.nullif(d, F.lit(0.0)), (F.col(cell) + 1 - F.col(p)) / F.nullif(d, F.lit(0.0))
        t0 = F.greatest(t0, F.coalesce(F.least(near, far), F.lit(0.0)))
        t1 = F.least(t1, F.coalesce(F.greatest(near, far), F.lit(1.0)))
        ok = ok & ((d != 0) | F.col(p).between(F.col(cell), F.col(cell) + 1))
    return cells.where(ok & (t0 <= t1)).select("r", "c").distinct()


def length_within(lines: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """Length of lines inside or within ``reach`` of each polygon, exact.

    A segment can only enter or leave where it meets an edge, a parallel of it
    at ``reach``, or the circle around one of its ends. Cut there, every piece
    lies inside or outside as a whole, as its middle does.
    """
    s = segments(lines).withColumn("dx", F.col("x2") - F.col("x1")).withColumn("dy", F.col("y2") - F.col("y1")).where("dx <> 0 or dy <> 0")
    s = s.select("id", "v", F.col("x1").alias("ax"), F.col("y1").alias("ay"), "dx", "dy")
    cell = 8.0
    ends = lambda a, d: (F.least(F.col(a), F.col(a) + F.col(d)), F.greatest(F.col(a), F.col(a) + F.col(d)))
    here = s.withColumn("cx", in_cells(*ends("ax", "dx"), cell)).withColumn("cy", in_cells(*ends("ay", "dy"), cell))
    there = boxes(edges).withColumn("cx", in_cells(F.col("bx0") - reach, F.col("bx1") + reach, cell)).withColumn("cy", in_cells(F.col("by0") - reach, F.col("by1") + reach, cell)).select("lake", "cx", "cy")
    key = ["id", "v", "lake", "ax", "ay", "dx", "dy"]
    pairs = here.join(there, ["cx", "cy"]).select(key).distinct()
    sides = here.join(reached(edges, reach, cell), ["cx", "cy"]).select(*key, "x1", "y1", "x2", "y2").distinct()

    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cross = F.col("dx") * ey - F.col("dy") * ex
    side = (F.col("ax") - F.col("x1")) * ey - (F.col("ay") - F.col("y1")) * ex
    at = [(F.lit(o * reach) * F.sqrt(ex * ex + ey * ey) - side) / F.nullif(cross, F.lit(0.0)) for o in (-1.0, 0.0, 1.0)]
    a = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    for px, py in (("x1", "y1"), ("x2", "y2")):
        b = F.col("dx") * (F.col("ax") - F.col(px)) + F.col("dy") * (F.col("ay") - F.col(py))
        c = F.pow(F.col("ax") - F.col(px), 2) + F.pow(F.col("ay") - F.col(py), 2) - reach * reach
        at += [F.when(b * b >= a * c, (-b + F.lit(sign) * F.sqrt(b * b - a * c)) / a) for sign in (-1.0, 1.0)]
    whole = pairs.select(*key, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    cuts = whole.unionByName(sides.select(*key, F.explode(F.array(*at)).alias("t"))).where("t between 0 and 1")
    cuts = cuts.withColumn("t", F.round("t", 12)).distinct()
    pieces = cuts.withColumn("u", F.lead("t").over(Window.partitionBy("id", "v", "lake").orderBy("t"))).where("u is not null")
    middle = (F.col("t") + F.col("u")) / 2
    long = (F.col("u") - F.col("t")) * F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    points = pieces.select(F.struct("id", "v", "t", F.col("lake").alias("of"), long.alias("piece")).alias("id"), (F.col("ax") + middle * F.col("dx")).alias("x"), (F.col("ay") + middle * F.col("dy")).alias("y"))
    return near_polygons(points, edges, reach).where(F.col("lake") == F.col("id.of")).groupBy("lake").agg(F.round(F.sum("id.piece"), 3).alias("length"))


def areas_on_sphere(edges: DataFrame) -> DataFrame:
    """Square kilometres of polygons in degrees: after a cylindrical equal-area projection, and planar by the cosine of the mean latitude."""
    x1, y1, x2, y2 = (F.radians(c) for c in ("x1", "y1", "x2", "y2"))
    equal = F.abs(F.sum(x1 * F.sin(y2) - x2 * F.sin(y1))) / 2 * 6371.0088**2
    planar = F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2 * 111.32**2 * F.cos(F.radians(F.avg("y1")))
    return edges.groupBy("lake").agg(F.round(equal, 6).alias("area_km2"), F.round(planar, 6).alias("planar_km2"))


def nearest(points: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """The polygon that contains a point, else the nearest within reach."""
    near = near_polygons(points, edges, reach, deep=True)
    w = Window.partitionBy("id").orderBy((~F.col("inside")).cast("int"), F.when(F.col("inside"), 0.0).otherwise(F.col("distance")), "lake")
    return near.withColumn("k", F.row_number().over(w)).where("k = 1").select("id", "lake", "inside", F.round("distance", 4).alias("distance"))


def matched(wanted: DataFrame, named: DataFrame, edges: DataFrame) -> DataFrame:
    """How each wanted lake (id, name, x, y) gets its outline.

    ``osm`` where its name has one (the largest), else ``osm-geo`` where one
    holds its point, else ``buffer``: a circle of its nominal area.
    """
    by_name = named.groupBy("name").agg(F.max("area").alias("area"))
    holding = near_polygons(wanted.select("id", "x", "y"), edges, 0.0).where("inside").groupBy("id").agg(F.max("lake").alias("lake"))
    source = F.when(F.col("area").isNotNull(), "osm").when(F.col("lake").isNotNull(), "osm-geo").otherwise("buffer")
    return wanted.join(by_name, "name", "left").join(holding, "id", "left").select("id", source.alias("source"))


def shoelace(edges: DataFrame) -> DataFrame:
    return edges.groupBy("lake").agg(F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2.0).alias("area"))


def antecedent_rain(scenes: DataFrame, weather: DataFrame, windows: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    """Rain of the days before each scene, both ends counted, and since 1 October; mean of tmax over 30 days.

    Days meet scenes by lake and month bucket, so the range join is an equi-join
    with a bounded spread.
    """
    longest = max(windows) + 31
    s = scenes.select("id", "lake", F.col("d").alias("sd")).withColumn("bucket", F.explode(F.sequence(F.floor(F.datediff("sd", F.lit("1990-01-01").cast("date")) / longest) - 1, F.floor(F.datediff("sd", F.lit("1990-01-01").cast("date")) / longest))))
    w = weather.withColumn("bucket", F.floor(F.datediff("d", F.lit("1990-01-01").cast("date")) / longest))
    october = F.make_date(F.when(F.month("sd") >= 10, F.year("sd")).otherwise(F.year("sd") - 1), F.lit(10), F.lit(1))
    j = s.join(w, ["lake", "bucket"], "left")
    ok = F.col("d") <= F.col("sd")
    within = lambda n: ok & (F.col("d") >= F.date_sub("sd", n))
    return j.groupBy("id", "lake", "sd").agg(
        *[F.coalesce(F.sum(F.when(within(n), F.col("rain_raw"))), F.lit(0)).cast("long").alias(f"rain_{n}d") for n in windows],
        F.coalesce(F.sum(F.when(ok & (F.col("d") >= october), F.col("rain_raw"))), F.lit(0)).cast("long").alias("rain_season"),
        F.round(F.avg(F.when(within(30), F.col("tmax"))), 4).alias("tmax_30d"),
    ).withColumnRenamed("sd", "d")


def mosaic(layers: DataFrame) -> DataFrame:
    """First non-zero value of each pixel in the layers' order of priority."""
    return layers.groupBy("lake", "r", "c").agg(F.min_by(F.when(F.col("value") != 0, F.col("value")), F.when(F.col("value") != 0, F.struct("priority", "layer"))).alias("value"))


def patch_origins(length: int, size: int, stride: int) -> list[int]:
    """Starts of the patches that cover a length, the last one moved back to its end."""
    if length <= size:
        return [0]
    starts = list(range(0, length - size + 1, stride))
    return starts if starts[-1] == length - size else [*starts, length - size]


def patch_pixels(px: DataFrame, size: int, stride: int, height: int, width: int) -> DataFrame:
    """Each pixel with every patch that holds it: the few origins of its cell, no theta join."""
    rows, cols = (F.array(*map(F.lit, patch_origins(n, size, stride))) for n in (height, width))
    hold = lambda origins, at: F.filter(origins, lambda o: (o <= at) & (at < o + size))
    return px.withColumn("pr", F.explode(hold(rows, F.col("r")))).withColumn("pc", F.explode(hold(cols, F.col("c"))))


def patch_index(patched: DataFrame, least: float = 0.10) -> DataFrame:
    """Patches with enough labelled pixels."""
    out = patched.groupBy("lake", "yr", "pr", "pc").agg(F.count("*").alias("n"), F.count("cls").alias("labelled"))
    return out.where(F.col("labelled") >= F.col("n") * least)


def channel_stats(patched: DataFrame, channels: list[str]) -> DataFrame:
    """Mean and deviation by lake over patch pixels, as often as patches hold them."""
    var = lambda c: F.greatest(F.avg(F.col(c) * F.col(c)) - F.avg(c) * F.avg(c), F.lit(1e-8))
    return patched.groupBy("lake").agg(*[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in channels], *[F.round(F.sqrt(var(c)), 4).alias(f"std_{c}") for c in channels])
