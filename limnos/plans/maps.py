"""Queries of rasters, outlines, resampling, lengths, areas and forecasts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.functions import geo
from limnos.functions import spectral as S
from limnos.operators import enhance, evaluate, forecasts, models, outlines, panel, raster, resample, spatial, zonal
from limnos.plans.fixtures import view
from limnos.plans.queries import BAD, LL_ETA, LL_PHI, LL_XI, MIRRORED, MNDWI, NEAR, RANKQ, REACH, SCORES, UTM_T, UTM_X, UTM_Y, moving, scores
from limnos.plans.registry import panel_query, query

GRID = ("fx_grid",)
PLACES = "select lake, yr, r, c"


def box_sql(source: str, value: str, radius: int, name: str) -> str:
    """SQL of box_sum as common table expressions ending in ``name``, its sum in a column of that name."""
    span = f"range between {radius} preceding and {radius} following"
    return f"{name}_x as (select *, sum({value}) over (partition by lake, yr, r order by c {span}) as {name}_s from {source}), {name} as (select *, sum({name}_s) over (partition by lake, yr, c order by r {span}) as {name} from {name}_x)"


# --- windows ------------------------------------------------------------------------

TEXTURE = ", g as (select lake, yr, r, c, swir16::double as v from fx_grid), o as (select unnest([-1, 0, 1]) as o), k as (select g.lake, g.yr, g.r, g.c, case when g.r + a.o < 0 then 1 when g.r + a.o > 31 then 30 else g.r + a.o end as nr, case when g.c + b.o < 0 then 1 when g.c + b.o > 31 then 30 else g.c + b.o end as nc from g cross join o a cross join o b) select k.lake, k.yr, k.r, k.c, round(sum(v) / 9, 4) as mean, round(sqrt(greatest(sum(v * v) / 9 - sum(v) / 9 * sum(v) / 9, 0.0::double)), 4) as std from k join g on g.lake = k.lake and g.yr = k.yr and g.r = k.nr and g.c = k.nc group by k.lake, k.yr, k.r, k.c"
panel_query("o_ras_1_texture_swir", TEXTURE, lambda g: raster.texture(g, "swir16", 32, 32), GRID)
panel_query("o_ras_2_built_share_300", MIRRORED.format(15, "961.0"), lambda g: raster.built_share(g, 15, 32, 32), GRID)
OPEN = box_sql("m", "m", 1, "e") + ", f as (select * exclude (e, e_s), case when e = 9 then 1 else 0 end as e from e), " + box_sql("f", "e", 1, "d")
panel_query("o_ras_5_opening", ", m as (select lake, yr, r, c, case when scl between 4 and 7 then 1 else 0 end as m from fx_grid), " + OPEN + f" {PLACES}, d > 0 as opened from d", lambda g: raster.opened(g.withColumn("land", F.col("scl").between(4, 7)), "land").select("lake", "yr", "r", "c", "opened"), GRID)
panel_query("o_ras_6_distance", ", b as (select lake, yr, r, c from fx_grid where cls = 3) select a.lake, a.yr, a.r, a.c, round(least(coalesce(min(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))) * 20, 2000.0), 2000.0)::double, 4) as distance from fx_grid a left join b on a.lake = b.lake and a.yr = b.yr group by a.lake, a.yr, a.r, a.c", lambda g: raster.distance_to(g.withColumn("built", F.coalesce(F.col("cls") == 3, F.lit(False))), "built", 2000.0), GRID)
panel_query("o_ras_6_shoreline", ", d as (select a.lake, a.r, a.c, a.inside, min(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))) * 20 as d from fx_zones a join fx_zones b on a.lake = b.lake and a.inside <> b.inside group by all) select lake, r, c, round(case when inside then -d else d end, 4) as shore from d", lambda z: raster.shoreline(z), ("fx_zones",))
panel_query("o_prj_20_dihedral", """, m as (select unnest([0,1,2,3,4,5,6,7]) as k)
select lake, yr, k, case k when 0 then r when 1 then c when 2 then 31 - r when 3 then 31 - c when 4 then r when 5 then 31 - r when 6 then c else 31 - c end as r,
case k when 0 then c when 1 then 31 - r when 2 then 31 - c when 3 then r when 4 then 31 - c when 5 then c when 6 then r else 31 - r end as c, cls from fx_grid cross join m""", lambda g: raster.dihedral(g, 32), GRID)

# --- work that grows with the tables ------------------------------------------------------

panel_query("o_ras_7_patches_wide", REACH.format(0).replace("fx_grid", "fx_wide").replace("* 100", "* 1000") + " select lake, yr, (first // 1000) || ',' || (first % 1000) as patch, count(*) as px, round(count(*) * 0.04::double, 2) as ha, min(r) as r0, max(r) as r1, min(c) as c0, max(c) as c1 from p group by lake, yr, first", lambda p: raster.patch_table(raster.patches(p, 0)), ("fx_wide",))
panel_query("o_ras_10_block_wide", "select lake, yr, cast(floor(r / 8) as int) as r, cast(floor(c / 8) as int) as c, round(coalesce(avg(nullif(nir, 0)), 0), 4) as nir from fx_wide group by all", lambda p: raster.block_average(p, "nir", 8), ("fx_wide",))
panel_query("o_jn_3_points_wide", NEAR.replace("fx_points", "fx_order_points") + ", q as (select *, inside or distance = 0 as foot from nr where inside or distance <= 4) select lake, count(*) filter (where foot) as n_footprint, count(*) filter (where not foot and distance <= 2) as n_ring_30m, count(*) filter (where not foot and distance <= 4) as n_ring_75m from q group by lake", lambda p, e: spatial.counts_in_zones(p, e, {"ring_30m": 2.0, "ring_75m": 4.0}), ("fx_order_points", "fx_edges"))
panel_query("o_win_10_ranking_wide", ", z as (select * from fx_line_scores)" + RANKQ[RANKQ.index(", s as (select g, score"):], lambda z: evaluate.ranking(z, "g"), ("fx_line_scores",))

# --- outlines and layers ----------------------------------------------------------------


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """Patches of four layers of every lake: water of the first and last year, built land of the last, growth."""
    g = moving(view(spark, sf, "fx_grid"))
    masks = [g.where("region and yr = 1995 and cls = 0"), g.where("region and yr = 2001 and cls = 0"), g.where("region and yr = 2001 and cls = 3"), panel.persistent_growth(g, 1995, 2001)]
    cells = [m.select("lake", F.lit(k).alias("yr"), "r", "c", F.lit(1).alias("cls")) for k, m in enumerate(masks)]
    every = cells[0].unionByName(cells[1]).unionByName(cells[2]).unionByName(cells[3])
    return raster.patches(every, 1)


query("o_agg_29_reconciliation")(lambda spark, sf: outlines.reconciled(layers(spark, sf)).withColumnRenamed("yr", "layer"))
query("o_ras_8_patch_outlines")(lambda spark, sf: outlines.outlines(outlines.straight(outlines.boundary(layers(spark, sf)))).withColumnRenamed("yr", "layer"))

# --- resampling and quality ----------------------------------------------------------------

panel_query("o_ras_10_nearest", f", s as (select unnest([0, 1, 2]) as i) select lake, yr, (r * 3 + a.i)::int as r, (c * 3 + b.i)::int as c, scl from fx_grid cross join s a cross join s b", lambda g: resample.nearest(g, "scl", 3), GRID)
WEIGHT = "(1 - abs((f.r + 0.5) / 3 - 0.5 - p.r)) * (1 - abs((f.c + 0.5) / 3 - 0.5 - p.c))"
panel_query("o_ras_10_bilinear", f""", s as (select unnest([0, 1, 2]) as i), f as (select x.r * 3 + a.i as r, x.c * 3 + b.i as c from fx_rc x cross join s a cross join s b)
select p.lake, p.yr, f.r::int as r, f.c::int as c, round(sum({WEIGHT} * p.nir) / sum({WEIGHT}), 4) as nir from fx_pixels p join f on f.r between p.r * 3 - 3 and p.r * 3 + 5 and f.c between p.c * 3 - 3 and p.c * 3 + 5
where abs((f.r + 0.5) / 3 - 0.5 - p.r) < 1 and abs((f.c + 0.5) / 3 - 0.5 - p.c) < 1 group by p.lake, p.yr, f.r, f.c""", lambda p, rc: resample.bilinear(p, "nir", 3, 32, 32), ("fx_pixels", "fx_rc"))
query("o_ras_11_enhanced")(lambda spark, sf: enhance.enhanced(view(spark, sf, "fx_grid").withColumn("nir", F.col("nir") * 1e-4), "nir", 32, 32, 8))
#: A raster of zone 43 on a grid of zone 44, six degrees of longitude east, by way of longitude and latitude.
NORTH = resample.Grid(43, 780000.0, 1440640.0, 20.0, 32, 32)
EAST = resample.Grid(44, 129900.0, 1441500.0, 20.0, 40, 40)
KR = repr(geo.K0 * geo.RADIUS)
ON_EAST = f""", tg as (select a.n as r, b.n as c from (select unnest(range(40)) as n) a cross join (select unnest(range(40)) as n) b),
ta as (select r, c, (1441500.0::double - (r + 0.5) * 20) / {KR}::double as xi, (129900.0::double + (c + 0.5) * 20 - 500000) / {KR}::double as eta from tg), tb as (select r, c, {LL_XI} as xi1, {LL_ETA} as eta1 from ta),
tc as (select *, asin(sin(xi1) / cosh(eta1)) as chi from tb), td as (select r, c, 81 + degrees(atan2(sinh(eta1), cos(xi1))) as lon, degrees({LL_PHI}) as lat from tc),
te as (select r, c, radians(lat) as phi, radians(lon - 75) as lam from td), tf as (select r, c, lam, {UTM_T} as t from te), th as (select r, c, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t * t)) as eta from tf),
ti as (select r, c, (({UTM_X}) * {KR}::double + 500000 - 780000) / 20 as fc, (1440640 - ({UTM_Y}) * {KR}::double) / 20 as fr from th), ra as (select distinct lake, yr from fx_pixels)"""
panel_query("o_ras_10_reprojected", ON_EAST + """, s as (select unnest([0, 0, 1, 1]) as i, unnest([0, 1, 0, 1]) as j), n as (select r, c, floor(fr - 0.5)::int + i as sr, floor(fc - 0.5)::int + j as sc, (1 - abs(fr - 0.5 - (floor(fr - 0.5) + i))) * (1 - abs(fc - 0.5 - (floor(fc - 0.5) + j))) as w from ti cross join s)
select ra.lake, ra.yr, n.r::int as r, n.c::int as c, round(coalesce(sum(w * p.nir) filter (where p.nir is not null) / nullif(sum(w) filter (where p.nir is not null), 0), 0)::double, 4) as nir from ra cross join n left join fx_pixels p on p.lake = ra.lake and p.yr = ra.yr and p.r = n.sr and p.c = n.sc and p.nir <> 0 group by ra.lake, ra.yr, n.r, n.c""", lambda p: resample.reprojected(p, "nir", NORTH, EAST), ("fx_pixels",))
panel_query("o_ras_10_reprojected_codes", ON_EAST + " select ra.lake, ra.yr, ti.r::int as r, ti.c::int as c, coalesce(p.scl, 0)::double as scl from ra cross join ti left join fx_pixels p on p.lake = ra.lake and p.yr = ra.yr and p.r = floor(fr)::int and p.c = floor(fc)::int", lambda p: resample.reprojected(p, "scl", NORTH, EAST, "nearest"), ("fx_pixels",))
MIRROR = "case when g.r + a.o < 0 then 1 when g.r + a.o > 31 then 30 else g.r + a.o end as nr, case when g.c + b.o < 0 then 1 when g.c + b.o > 31 then 30 else g.c + b.o end as nc"
panel_query("o_ras_12_sharpness_noise", f""", g as (select lake, yr, r, c, (nir % 256)::double as v from fx_grid), o as (select unnest([-1, 0, 1]) as o),
k as (select g.lake, g.yr, g.r, g.c, a.o as i, b.o as j, {MIRROR} from g cross join o a cross join o b),
l as (select k.lake, k.yr, k.r, k.c, sum(v * case when abs(i) + abs(j) = 0 then -4 when abs(i) + abs(j) = 1 then 1 else 0 end) as lap, abs(sum(v * case when i = 0 and j = 0 then 4 when i = 0 or j = 0 then -2 else 1 end)) as nz
from k join g on g.lake = k.lake and g.yr = k.yr and g.r = k.nr and g.c = k.nc group by k.lake, k.yr, k.r, k.c)
select lake, yr, round(var_pop(lap), 4) as sharpness, round(sum(nz) filter (where r between 1 and 30 and c between 1 and 30) * sqrt(pi() / 2) / 5400, 4) as noise from l group by lake, yr""",
    lambda g: resample.sharpness_and_noise(g.withColumn("grey", F.col("nir") % 256), "grey", 32, 32), GRID)

# --- aggregates ---------------------------------------------------------------------------------

panel_query("o_agg_20_point_density", """, h as (select least(floor((x - 1) / 30 * 110), 109)::int as i, least(floor((y - 2) / 28 * 92), 91)::int as j, count(*) as n from fx_points where x between 1 and 31 and y between 2 and 30 group by all)
select i, j, n, round((select quantile_cont(n, 0.99) from h), 4) as p99 from h""", lambda p: zonal.point_density(p, (1.0, 2.0, 31.0, 30.0)), ("fx_points",))
panel_query("o_agg_23_water_change", f", q as (select *, scl not in {BAD} as clear, case when scl not in {BAD} and {MNDWI} > 0 then 1 else 0 end as m from fx_grid), " + OPEN.replace("from m)", "from q)") + ", w as (select *, d > 0 as wet from d) select a.lake, " + ", ".join(f"round(count(*) filter (where {x}) * 0.04::double, 2) as {n}" for n, x in (("stable_ha", "a.wet and b.wet"), ("lost_ha", "a.wet and not b.wet"), ("gained_ha", "not a.wet and b.wet"))) + " from w a join w b using (lake, r, c) where a.yr = 1995 and b.yr = 2001 and a.clear and b.clear and a.inside group by a.lake",
    lambda g: water_change(g), GRID)


def water_change(grid: DataFrame) -> DataFrame:
    i = S.indices(F.col("green"), F.col("red"), F.col("nir"), F.col("swir16"))
    px = grid.withColumn("clear", ~S.cloudy(F.col("scl"))).withColumn("wet", S.water(i["mndwi"], F.col("scl")))
    px = raster.opened(px.where("yr in (1995, 2001)"), "wet").withColumn("wet", F.col("opened"))
    return zonal.change_counts(px.where("yr = 1995"), px.where("yr = 2001"))


panel_query("o_prj_14_equal_area", ", e as (select lake, 70 + x1 * 0.01 as x1, 8 + y1 * 0.01 as y1, 70 + x2 * 0.01 as x2, 8 + y2 * 0.01 as y2 from fx_edges) select lake, round(abs(sum(radians(x1) * sin(radians(y2)) - radians(x2) * sin(radians(y1)))) / 2 * pow(6371.0088, 2), 6) as area_km2, round(abs(sum(x1 * y2 - x2 * y1)) / 2 * pow(111.32, 2) * cos(radians(avg(y1))), 6) as planar_km2 from e group by lake",
    lambda e: spatial.areas_on_sphere(e.select("lake", *[(F.lit(b) + F.col(n) * 0.01).alias(n) for n, b in (("x1", 70), ("y1", 8), ("x2", 70), ("y2", 8))])), ("fx_edges",))
query("o_ml_4_fitted_temperature", SCORES + """, r as (select truth, logits, list_max(logits) as m from sc), c as (select pow(2, unnest(range(-8, 9)) / 2.0::double) as t),
n as (select t, avg(m / t + ln(exp((logits[1] - m) / t) + exp((logits[2] - m) / t) + exp((logits[3] - m) / t) + exp((logits[4] - m) / t)) - logits[truth + 1] / t) as nll from r cross join c group by t),
b as (select arg_min(t, struct_pack(a := round(nll, 12), b := t)) as t from n), d as (select b.t * pow(2, k / 16.0::double) as t from b cross join (select unnest(range(-8, 9)) as k) k),
f as (select t, avg(m / t + ln(exp((logits[1] - m) / t) + exp((logits[2] - m) / t) + exp((logits[3] - m) / t) + exp((logits[4] - m) / t)) - logits[truth + 1] / t) as nll from r cross join d group by t)
select round(arg_min(t, struct_pack(a := round(nll, 12), b := t)), 6) as t, round(min(nll), 6) as nll from f""", ("fx_scores",))(lambda spark, sf: evaluate.fitted_temperature(scores(spark, sf)))

# --- lines ----------------------------------------------------------------------------------------

SEGMENTS = ", sg as (select * from (select id, v, x as ax, y as ay, lead(x) over (partition by id order by v) - x as dx, lead(y) over (partition by id order by v) - y as dy from fx_lines) where dx is not null)"
panel_query("o_jn_7_lines_touched", SEGMENTS + """, t as (select r, c, greatest(0.0::double, case when dx = 0 then 0 else least((c - ax) / nullif(dx, 0), (c + 1 - ax) / nullif(dx, 0)) end, case when dy = 0 then 0 else least((r - ay) / nullif(dy, 0), (r + 1 - ay) / nullif(dy, 0)) end) as t0,
least(1.0::double, case when dx = 0 then 1 else greatest((c - ax) / nullif(dx, 0), (c + 1 - ax) / nullif(dx, 0)) end, case when dy = 0 then 1 else greatest((r - ay) / nullif(dy, 0), (r + 1 - ay) / nullif(dy, 0)) end) as t1 from sg cross join fx_rc
where (dx <> 0 or ax between c and c + 1) and (dy <> 0 or ay between r and r + 1) and c between floor(least(ax, ax + dx)) and floor(greatest(ax, ax + dx)) and r between floor(least(ay, ay + dy)) and floor(greatest(ay, ay + dy))) select distinct r::int as r, c::int as c from t where t0 <= t1""", lambda li, rc: spatial.cells_touched(li, 32, 32), ("fx_lines", "fx_rc"))
REACH = 4.0
#: Where a segment may enter or leave a capsule of radius 4 around an edge: both end circles, both parallel sides, the edge itself.
ROOT = "(case when b * b - a * c >= 0 then [(-b - sqrt(b * b - a * c)) / a, (-b + sqrt(b * b - a * c)) / a] else []::double[] end)"
panel_query("o_jn_5_line_length", SEGMENTS + f""", p as (select s.*, e.lake, e.x1, e.y1, e.x2 - e.x1 as ex, e.y2 - e.y1 as ey, s.dx * s.dx + s.dy * s.dy as a, sqrt((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1)) as el from sg s cross join fx_edges e where s.dx * s.dx + s.dy * s.dy > 0),
q as (select id, v, lake, unnest([x1, x1 + ex]) as px, unnest([y1, y1 + ey]) as py, ax, ay, dx, dy, a from p),
k as (select id, v, lake, dx * (ax - px) + dy * (ay - py) as b, a, (ax - px) * (ax - px) + (ay - py) * (ay - py) - 16.0::double as c from q),
tt as (select id, v, lake, unnest({ROOT}) as t from k union all select id, v, lake, unnest([0.0::double, 1.0::double]) from p union all
select id, v, lake, (o * el - ((ax - x1) * ey - (ay - y1) * ex)) / (dx * ey - dy * ex) from p cross join (select unnest([-4.0::double, 0.0::double, 4.0::double]) as o) where dx * ey - dy * ex <> 0),
st as (select id, v, lake, t, lead(t) over (partition by id, v, lake order by t) as u from (select distinct id, v, lake, round(t, 12) as t from tt where t between 0 and 1)),
md as (select st.id, st.v, st.lake, t, u, ax + (t + u) / 2 * dx as x, ay + (t + u) / 2 * dy as y, (u - t) * sqrt(dx * dx + dy * dy) as piece from st join sg using (id, v) where u is not null),
ok as (select m.id, m.v, m.lake, m.t, piece, count(*) filter (where ((e.y1 > y) != (e.y2 > y)) and x < e.x1 + (y - e.y1) * (e.x2 - e.x1) / nullif(e.y2 - e.y1, 0)::double) % 2 = 1 as inside,
min(sqrt(pow(x - e.x1 - greatest(0.0::double, least(1.0::double, ((x - e.x1) * (e.x2 - e.x1) + (y - e.y1) * (e.y2 - e.y1)) / nullif((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1), 0)::double)) * (e.x2 - e.x1), 2)
+ pow(y - e.y1 - greatest(0.0::double, least(1.0::double, ((x - e.x1) * (e.x2 - e.x1) + (y - e.y1) * (e.y2 - e.y1)) / nullif((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1), 0)::double)) * (e.y2 - e.y1), 2))) as distance
from md m join fx_edges e on e.lake = m.lake group by m.id, m.v, m.lake, m.t, piece)
select lake, round(sum(piece), 3) as length from ok where inside or distance <= 4 group by lake""", lambda li, e: spatial.length_within(li, e, REACH), ("fx_lines", "fx_edges"))

# --- samples and shuffles by a digest that both engines have ------------------------------------------

MD5 = "md5('42:' || r || ':' || c)"
panel_query("o_top_4_capped_sample", f", k as (select *, row_number() over (partition by lake, yr order by {MD5}, r, c) as k from fx_pixels) select * exclude (k) from k where k <= 200", lambda p: panel.capped_sample(p, ["lake", "yr"], ["r", "c"], 200), ("fx_pixels",))
panel_query("o_prj_19_shuffled_labels", f", t as (select lake, yr, r, c, row_number() over (partition by lake, yr order by r, c) as k from fx_pixels), h as (select lake, yr, cls, row_number() over (partition by lake, yr order by {MD5}, r, c) as k from fx_pixels) select lake, yr, r, c, cls from t join h using (lake, yr, k)", lambda p: panel.shuffled(p, "cls", ["lake", "yr"], ["r", "c"]), ("fx_pixels",))

# --- forecasts ------------------------------------------------------------------------------------------

ROADS = ("fx_grid", "fx_lines")
panel_query("o_chg_6_jn_16_target", f", g as (select *, case when cls = 3 then 1 else 0 end as b from (select * replace (dw % 4 as cls) from fx_grid)), t as (select *, max(b) over (partition by lake, r, c order by yr range between 3 following and 3 following) as thn, min(b) over (partition by lake, r, c order by yr range between 3 following and unbounded following) as alw from g) select lake, r, c, yr, (thn = 1 and alw = 1)::int as target from t where region and scl not in {BAD} and cls is not null and cls <> 3 and thn is not null", lambda g: panel.forecast_target(moving(g)), GRID)


def forecast_rows(grid: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features of every cell and year, those of candidates with their target)."""
    rows = forecasts.features(moving(grid), spatial.cells_touched(lines, 32, 32), 32, 32)
    return rows, forecasts.candidates(rows, panel.forecast_target(moving(grid)))


def projected(grid: DataFrame, lines: DataFrame) -> DataFrame:
    rows, known = forecast_rows(grid, lines)
    return forecasts.project(forecasts.fitted(known, [1996, 1997, 1998]), rows, 2001)


def important(grid: DataFrame, lines: DataFrame) -> DataFrame:
    model = forecasts.fitted(forecast_rows(grid, lines)[1], [1996, 1997, 1998])
    return grid.sparkSession.createDataFrame(models.importance(model, list(forecasts.FEATURES)), "feature string, importance double")


panel_query("o_chg_5_features", None, lambda g, li: forecast_rows(g, li)[0], ROADS)
panel_query("o_chg_7_validation", None, lambda g, li: forecasts.validated(forecast_rows(g, li)[1], [1996, 1997], 1998), ROADS)
panel_query("o_chg_7_projection", None, projected, ROADS)
panel_query("o_top_3_importance", None, important, ROADS)
