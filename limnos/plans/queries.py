"""One query for each operator, over domain views of the given tables, with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.functions import geo
from limnos.functions import spectral as S
from limnos.operators import evaluate, models, panel, raster, risk, spatial, zonal
from limnos.plans.fixtures import view
from limnos.plans.registry import panel_query, query
from limnos.sources import landed, sinks
from limnos.streaming import feeds

BAD = "(0, 1, 3, 8, 9, 10)"


def nd(a: str, b: str) -> str:
    """SQL of norm_diff over digital numbers."""
    x, y = f"({a} * 1e-4::double)", f"({b} * 1e-4::double)"
    return f"(case when abs({x} + {y}) > 1e-6 then greatest(-1.0::double, least(1.0::double, ({x} - {y}) / ({x} + {y}))) else 0.0::double end)"


MNDWI, NDVI, NDWI, NDBI = nd("green", "swir16"), nd("nir", "red"), nd("green", "nir"), nd("swir16", "nir")
ZONED = "fx_pixels p join fx_zones z on p.lake = z.lake and p.r = z.r and p.c = z.c"
PZ = ("fx_pixels", "fx_zones")


def pz(spark: SparkSession, sf: str) -> DataFrame:
    return zonal.zoned(view(spark, sf, "fx_pixels"), view(spark, sf, "fx_zones"))


def ha(condition: str) -> str:
    return f"round(count(*) filter (where {condition}) * 0.04::double, 2)"


def frac(part: str, whole: str, digits: int = 4) -> str:
    return f"round(count(*) filter (where ({part}) and ({whole})) / nullif(count(*) filter (where {whole}), 0)::double, {digits})"


# --- sources, scalar functions, predicates -----------------------------------------


@query("o_prj_1_reflectance", "select lake, yr, r, c, round(green * 1e-4::double - 0.1::double, 4) as rho from fx_pixels", ("fx_pixels",))
def _(spark, sf):
    return view(spark, sf, "fx_pixels").select("lake", "yr", "r", "c", F.round(S.reflectance(F.col("green"), -0.1), 4).alias("rho"))


@query("o_prj_2_offset", "select lake, yr, r, c, case when yr < 1998 then nir when nir > 0 then greatest(nir - 1000, 1) else 0 end as nir from fx_pixels", ("fx_pixels",))
def _(spark, sf):
    return view(spark, sf, "fx_pixels").select("lake", "yr", "r", "c", S.corrected(F.col("nir"), F.col("yr") < 1998).alias("nir"))


@query("o_prj_3_4_indices", f"select lake, yr, r, c, round({NDWI}, 6) as ndwi, round({MNDWI}, 6) as mndwi, round({NDVI}, 6) as ndvi, round({NDBI}, 6) as ndbi from fx_pixels", ("fx_pixels",))
def _(spark, sf):
    idx = S.indices(F.col("green"), F.col("red"), F.col("nir"), F.col("swir16"))
    return view(spark, sf, "fx_pixels").select("lake", "yr", "r", "c", *[F.round(v, 6).alias(k) for k, v in idx.items()])


@query("o_prj_5_6_masks", f"select lake, yr, scl in {BAD} as cloudy, {MNDWI} > 0 and scl not in {BAD} as wet, {NDVI} > 0.30 and {MNDWI} <= 0 and scl not in {BAD} as leafy, count(*) as n from fx_pixels group by all", ("fx_pixels",))
def _(spark, sf):
    i = S.indices(F.col("green"), F.col("red"), F.col("nir"), F.col("swir16"))
    px = view(spark, sf, "fx_pixels").select("lake", "yr", "scl", *[v.alias(k) for k, v in i.items()])
    return px.groupBy("lake", "yr", S.cloudy(F.col("scl")).alias("cloudy"), S.water(F.col("mndwi"), F.col("scl")).alias("wet"), S.vegetation(F.col("mndwi"), F.col("ndvi"), F.col("scl")).alias("leafy")).agg(F.count("*").alias("n"))


@query("o_prj_7_index_rule", f"select lake, yr, case when {MNDWI} > 0 then 0 when {NDVI} > 0.30 then 1 else 2 end as rule_cls, count(*) as n from fx_pixels group by all", ("fx_pixels",))
def _(spark, sf):
    i = S.indices(F.col("green"), F.col("red"), F.col("nir"), F.col("swir16"))
    return view(spark, sf, "fx_pixels").groupBy("lake", "yr", S.index_class(i["mndwi"], i["ndvi"]).alias("rule_cls")).agg(F.count("*").alias("n"))


RECODE_DW = "case when dw = 0 then 0 when dw between 1 and 5 then 1 when dw = 6 then 3 when dw = 7 then 2 end"
RECODE_SCL = "case scl when 6 then 0 when 4 then 1 when 5 then 2 end"


@query("o_prj_8_recode", f"select {RECODE_SCL} as from_scl, {RECODE_DW} as from_dw, count(*) as n from fx_pixels group by all", ("fx_pixels",))
def _(spark, sf):
    return view(spark, sf, "fx_pixels").groupBy(S.recoded(F.col("scl"), S.SCL_CLASS).alias("from_scl"), S.recoded(F.col("dw"), S.EXTERNAL_CLASS).alias("from_dw")).agg(F.count("*").alias("n"))


LABELLED = f", b as (select cast(floor(y) as int) as r, cast(floor(x) as int) as c, count(*) as buildings from fx_points group by all), l as (select g.*, coalesce(b.buildings, 0) as buildings from fx_grid g left join b using (r, c)), s as (select *, case when not region or scl in {BAD} then null when buildings >= 1 then 3 else {RECODE_SCL} end as label, buildings >= 1 and scl = 6 as conflict from l)"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    n = spatial.counts_per_cell(view(spark, sf, "fx_points"), 32, 32).withColumnRenamed("n", "buildings")
    return view(spark, sf, "fx_grid").join(n, ["r", "c"], "left").withColumn("buildings", F.coalesce("buildings", F.lit(0)))


@query("o_prj_9_seed_labels", LABELLED + " select lake, yr, label, conflict, count(*) as n from s group by all", ("fx_grid", "fx_points"))
def _(spark, sf):
    px = labelled(spark, sf)
    return px.groupBy("lake", "yr", S.seed_label(F.col("scl"), F.col("buildings"), F.col("region")).alias("label"), S.building_conflict(F.col("scl"), F.col("buildings")).alias("conflict")).agg(F.count("*").alias("n"))


@query("o_prj_11_world_pixel", "select id, cast(floor((x * 20 - 5) / 20) as bigint) as col, cast(floor((640 - y * 20) / 20) as bigint) as row from fx_points", ("fx_points",))
def _(spark, sf):
    col, row = geo.pixel_of(F.col("x") * 20, F.col("y") * 20, F.lit(5.0), F.lit(640.0), 20.0)
    return view(spark, sf, "fx_points").select("id", col.alias("col"), row.alias("row"))


@query("o_prj_12_snap", """, b as (select lake, min(x1) * 20.0 - 7 as minx, max(x1) * 20.0 + 3 as maxx from fx_edges group by lake)
select lake, cast(floor(minx / 20) * 20 as double) as minx, cast(ceil(maxx / 20) * 20 as double) as maxx, (ceil(maxx / 20) - floor(minx / 20)) * 20 > 400 as clipped from b""", ("fx_edges",))
def _(spark, sf):
    b = view(spark, sf, "fx_edges").groupBy("lake").agg((F.min("x1") * 20.0 - 7).alias("a"), (F.max("x1") * 20.0 + 3).alias("b"))
    lo, hi, wide = geo.snapped(F.col("a"), F.col("b"), 20.0, 400.0)
    return b.select("lake", lo.alias("minx"), hi.alias("maxx"), wide.alias("clipped"))


@query("o_prj_12_clip", """, b as (select lake, min(x1) * 20.0 - 7 as minx, max(x1) * 20.0 + 3 as maxx, avg(x1) * 20.0 as mid from fx_edges group by lake)
select lake, cast(floor(case when maxx - minx > 400 then mid - 200 else minx end / 20) * 20 as double) as minx, cast(ceil(case when maxx - minx > 400 then mid + 200 else maxx end / 20) * 20 as double) as maxx, maxx - minx > 400 as clipped from b""", ("fx_edges",))
def _(spark, sf):
    b = view(spark, sf, "fx_edges").groupBy("lake").agg((F.min("x1") * 20.0 - 7).alias("a"), (F.max("x1") * 20.0 + 3).alias("b"), (F.avg("x1") * 20.0).alias("mid"))
    lo, hi, cut = geo.centred(F.col("a"), F.col("b"), F.col("mid"), 20.0, 400.0)
    return b.select("lake", lo.alias("minx"), hi.alias("maxx"), cut.alias("clipped"))


@query("o_prj_13_hectares", "select lake, round(count(*) filter (where inside) * 0.04::double, 2) as ha, round(count(*) filter (where inside) * 0.04::double * 2.471054::double, 4) as acres, count(*) filter (where inside) * 0.04::double * 2.471054::double > 20 as big from fx_zones group by lake", ("fx_zones",))
def _(spark, sf):
    n = F.count_if("inside") * zonal.PIXEL_HA
    return view(spark, sf, "fx_zones").groupBy("lake").agg(F.round(n, 2).alias("ha"), F.round(n * 2.471054, 4).alias("acres"), (n * 2.471054 > 20).alias("big"))


@query("o_prj_14_polygon_area", "select lake, abs(sum(x1 * y2 - x2 * y1)::bigint / 2.0::double) as area from fx_edges group by lake", ("fx_edges",))
def _(spark, sf):
    return spatial.shoelace(view(spark, sf, "fx_edges"))


@query("o_prj_15_slugify", "select p_partkey as id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '-p' || p_partkey as slug from part")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), geo.slug(F.col("p_name"), "p", F.col("p_partkey")).alias("slug"))


@query("o_prj_16_coordinates", """, t as (select id, case when id % 3 = 0 then 'lake ' || id else (12 + id % 30) || '.5, ' || (70 + id % 40) || '.25' end as q from fx_points)
, m as (select id, q, regexp_extract(q, '^\\s*(-?[0-9.]+)\\s*,\\s*(-?[0-9.]+)\\s*$', 1) as a, regexp_extract(q, '^\\s*(-?[0-9.]+)\\s*,\\s*(-?[0-9.]+)\\s*$', 2) as b from t)
select id, case when try_cast(a as double) between 6 and 38 and try_cast(b as double) between 68 and 98 then try_cast(a as double) end as lat, case when try_cast(a as double) between 6 and 38 and try_cast(b as double) between 68 and 98 then try_cast(b as double) end as lon from m""", ("fx_points",))
def _(spark, sf):
    q = F.when(F.col("id") % 3 == 0, F.concat(F.lit("lake "), "id")).otherwise(F.concat((12 + F.col("id") % 30).cast("string"), F.lit(".5, "), (70 + F.col("id") % 40).cast("string"), F.lit(".25")))
    lat, lon = geo.coordinates(q)
    return view(spark, sf, "fx_points").select("id", lat.alias("lat"), lon.alias("lon"))


@query("o_prj_17_29_names", "select n_nationkey as id, lower(trim(n_name)) as name, instr(lower(n_name), 'an') > 0 as hit from nation")
def _(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    return n.select(F.col("n_nationkey").alias("id"), F.lower(F.trim("n_name")).alias("name"), (F.instr(F.lower("n_name"), "an") > 0).alias("hit"))


@query("o_prj_18_date_parts", "select year(d) as yr, month(d) as m, count(*) as n from fx_weather group by all", ("fx_weather",))
def _(spark, sf):
    return view(spark, sf, "fx_weather").groupBy(F.year("d").alias("yr"), F.month("d").alias("m")).agg(F.count("*").alias("n"))


@query("o_prj_21_standardise", """, t as (select lake, avg(nir) as m, stddev_pop(nir) as s from fx_pixels group by lake) select p.lake, yr, r, c, round((nir - m) / s, 4) + 0.0::double as z from fx_pixels p join t using (lake)""", ("fx_pixels",))
def _(spark, sf):
    px = view(spark, sf, "fx_pixels")
    st = px.groupBy("lake").agg(F.avg("nir").alias("m"), F.stddev_pop("nir").alias("s"))
    return px.join(st, "lake").select("lake", "yr", "r", "c", (F.round((F.col("nir") - F.col("m")) / F.col("s"), 4) + 0.0).alias("z"))


@query("o_prj_22_panel_scaling", "select lake, yr, round(ln(1 + greatest(built_px, 0)), 6) as log_built, yr - 1998 as year_c, round((water_px - avg(water_px) over ()) / greatest(stddev_pop(water_px) over (), 1e-9), 6) as water_z from fx_panel", ("fx_panel",))
def _(spark, sf):
    p = view(spark, sf, "fx_panel")
    whole = p.agg(F.avg("water_px").alias("m"), F.greatest(F.stddev_pop("water_px"), F.lit(1e-9)).alias("s"))  # one row
    return p.crossJoin(F.broadcast(whole)).select("lake", "yr", F.round(F.log1p(F.greatest("built_px", F.lit(0))), 6).alias("log_built"), (F.col("yr") - 1998).alias("year_c"), F.round((F.col("water_px") - F.col("m")) / F.col("s"), 6).alias("water_z"))


LOGITS = "[embedding[1]::double, embedding[2]::double, embedding[3]::double, embedding[4]::double]"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "fx_scores").withColumn("logits", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")))
    return s.select("vec_id", F.col("truth").cast("int").alias("truth"), "logits", S.argmax(F.col("logits")).alias("pred"))


SCORES = f", l as (select vec_id, truth, {LOGITS} as logits from fx_scores), sc as (select vec_id, truth, logits, list_position(logits, list_max(logits)) - 1 as pred from l)"


@query("o_prj_23_softmax", SCORES + ", e as (select vec_id, pred, exp(logits[1] - list_max(logits)) as a, exp(logits[2] - list_max(logits)) as b, exp(logits[3] - list_max(logits)) as c, exp(logits[4] - list_max(logits)) as d from sc) select vec_id, pred, round(greatest(a, b, c, d) / (a + b + c + d), 6) as conf from e", ("fx_scores",))
def _(spark, sf):
    return scores(spark, sf).select("vec_id", "pred", F.round(F.array_max(S.softmax(F.col("logits"))), 6).alias("conf"))


@query("o_prj_24_stretch", """, l as (select lake, yr, quantile_cont(nir, 0.02) as lo, quantile_cont(nir, 0.98) as hi from fx_pixels group by all)
select lake, yr, r, c, round(pow(greatest(0.0::double, least(1.0::double, (nir - lo) / greatest(hi - lo, 1e-6))), 0.85), 4) as v from fx_pixels join l using (lake, yr)""", ("fx_pixels",))
def _(spark, sf):
    return raster.stretched(view(spark, sf, "fx_pixels"), "nir")


@query("o_prj_25_warnings", """, m as (select lake, max(yr) as y from fx_panel group by lake), e as (select p.lake, median(built_px) filter (where yr < y) as earlier, max(built_px) filter (where yr = y) as last from fx_panel p join m using (lake) group by p.lake)
select lake, earlier, last, earlier >= 50 and last < earlier / 4 as warned from e""", ("fx_panel",))
def _(spark, sf):
    return panel.warnings(view(spark, sf, "fx_panel")).select("lake", "earlier", "last", "warned")


@query("o_prj_25_reasons", """, m as (select lake, max(yr) as y from fx_panel group by lake), e as (select p.lake, median(built_px) filter (where yr < y) as earlier, max(built_px) filter (where yr = y) as last from fx_panel p join m using (lake) group by p.lake),
f as (select lake, 2 * count(*) filter (where cls = 3 and dw % 4 = 3) / (count(*) filter (where cls = 3) + count(*) filter (where dw % 4 = 3))::double as f1 from fx_pixels group by lake)
select e.lake, concat_ws(',', case when f1 < 0.30 then 'built F1' end, case when earlier >= 50 and last < earlier / 4 then 'built fell' end) as reasons from e join f using (lake)""", ("fx_panel", "fx_pixels"))
def _(spark, sf):
    """Reasons not to rely on a lake: its fall of built land, and the F1 of built land against the external layer."""
    cm = evaluate.confusion(view(spark, sf, "fx_pixels").select("lake", F.col("cls").alias("truth"), (F.col("dw") % 4).alias("pred")), "lake")
    f1 = evaluate.class_metrics(cm, "lake").where("cls = 3").select("lake", F.col("f1").alias("f1_built"))
    return panel.warnings(view(spark, sf, "fx_panel"), f1).select("lake", F.concat_ws(",", "warnings").alias("reasons"))


@query("o_prj_29_first_match", """with q as (select s_suppkey as id, ' ' || case when s_suppkey % 3 = 0 then substr(s_name, 8, 4 + (s_suppkey % 9)::int) else 'ation_' || s_suppkey % 30 end as q from supplier),
l as (select n_nationkey as lake, case when n_nationkey % 2 = 0 then 'Lake ' || n_name else n_name || '#000000' end as name, (n_nationkey * 7) % 11 as area from nation),
h as (select id, lake, row_number() over (partition by id order by area desc, lake) as k from q join l on contains(lower(name), lower(trim(q)))) select id, lake from h where k = 1""")
def _(spark, sf):
    q = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.concat(F.lit(" "), F.when(F.col("s_suppkey") % 3 == 0, F.substr("s_name", F.lit(8), (4 + F.col("s_suppkey") % 9).cast("int"))).otherwise(F.concat(F.lit("ation_"), (F.col("s_suppkey") % 30).cast("string")))).alias("q"))
    lakes = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("lake"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Lake "), "n_name")).otherwise(F.concat("n_name", F.lit("#000000"))).alias("name"), ((F.col("n_nationkey") * 7) % 11).alias("area"))
    return panel.first_match(q, lakes)


@query("o_prj_27_index_100", ", f as (select lake, arg_min(water, yr) as w from fx_fractions group by lake) select lake, yr, round(water / nullif(w, 0) * 100, 3) as idx from fx_fractions join f using (lake)", ("fx_fractions",))
def _(spark, sf):
    return panel.indexed(view(spark, sf, "fx_fractions"), "water")


@query("o_prj_28_colour_grade", "select lake, r, c, (d2 % 10) / 10.0::double as prob, case when d2 % 10 >= 7 then 'high' when d2 % 10 >= 4 then 'middle' else 'low' end as grade from fx_disc where d2 % 10 >= 1 and d2 <= (k + 6) * (k + 6)", ("fx_disc",))
def _(spark, sf):
    z = view(spark, sf, "fx_disc").where("d2 <= (k + 6) * (k + 6)").withColumn("prob", (F.col("d2") % 10) / 10.0)
    return z.where("prob >= 0.1").select("lake", "r", "c", "prob", F.when(F.col("prob") >= 0.7, "high").when(F.col("prob") >= 0.4, "middle").otherwise("low").alias("grade"))


# --- zonal aggregates -----------------------------------------------------------------

IDX = f", px as (select p.*, z.inside, z.collar, z.region, z.ring_30m, z.ring_75m, {NDWI} as ndwi, {MNDWI} as mndwi, {NDVI} as ndvi, p.scl not in {BAD} as clear from {ZONED})"
WET, LEAFY = "clear and mndwi > 0", "clear and ndvi > 0.30 and mndwi <= 0"


@query("o_agg_1_lake_areas", IDX + f""", s as (select lake, count(*) as ref_px from fx_zones where inside group by lake),
a as (select lake, yr, count(*) filter (where inside and clear) as valid_px, count(*) filter (where inside and {WET}) as water_px, count(*) filter (where inside and {LEAFY}) as veg_px, count(*) filter (where inside and scl = 6) as scl_px,
{frac(WET, 'collar and clear')} as collar_water_frac, {frac(LEAFY, 'collar and clear')} as collar_veg_frac,
round(avg(ndwi) filter (where inside and clear), 4) as mean_ndwi, round(avg(mndwi) filter (where inside and clear), 4) as mean_mndwi, round(avg(ndvi) filter (where inside and clear), 4) as mean_ndvi from px group by all)
select lake, yr, round(ref_px * 0.04::double, 2) as ref_ha, round(water_px * 0.04::double, 2) as water_ha, round(veg_px * 0.04::double, 2) as veg_ha, round((valid_px - water_px - veg_px) * 0.04::double, 2) as other_ha,
round(water_px / valid_px::double, 4) as water_frac, mean_ndwi, mean_mndwi, mean_ndvi, collar_water_frac, collar_veg_frac, round(scl_px * 0.04::double, 2) as scl_water_ha from a join s using (lake) where valid_px >= ref_px * 0.5""", PZ)
def lake_areas(spark, sf, least_valid: float = 0.5):
    return zonal.lake_areas(view(spark, sf, "fx_pixels"), view(spark, sf, "fx_zones"), least_valid)


CLASSES = ("water", "vegetation", "bare", "built")


@query("o_agg_2_composition", "select p.lake, yr, " + ", ".join(f"{frac(f'cls = {k}', 'inside and cls is not null')} as {n}_frac" for k, n in enumerate(CLASSES)) + ", " + ", ".join(f"{frac('cls = 3', f'{z} and cls is not null')} as built_{z}" for z in ("ring_30m", "ring_75m")) + f" from {ZONED} group by p.lake, yr", PZ)
def _(spark, sf):
    return zonal.composition(pz(spark, sf))


@query("o_agg_3_class_hectares", "select p.lake, yr, " + ", ".join(f"{ha(f'inside and cls = {k}')} as {n}_ha" for k, n in enumerate(CLASSES)) + ", " + ", ".join(f"{ha(f'{z} and cls = 3')} as built_{z}_ha" for z in ("ring_30m", "ring_75m")) + f" from {ZONED} group by p.lake, yr", PZ)
def _(spark, sf):
    return zonal.class_hectares(pz(spark, sf))


@query("o_agg_4_zone_split", f"select p.lake, {ha('cls = 3 and inside')} as inside_ha, {ha('cls = 3 and ring_30m')} as ring_30m_ha, {ha('cls = 3 and ring_75m')} as ring_75m_ha, {ha('cls = 3 and region and not inside and not ring_75m')} as beyond_ha from {ZONED} group by p.lake", PZ)
def _(spark, sf):
    return zonal.zone_split(pz(spark, sf), F.col("cls") == 3)


PATCHED = ", o as (select unnest([0, 8, 16]) as pr), pt as (select p.*, a.pr, b.pr as pc from fx_pixels p join o a on p.r >= a.pr and p.r < a.pr + 16 join o b on p.c >= b.pr and p.c < b.pr + 16)"


@query("o_agg_5_jn_13_channel_stats", PATCHED + " select lake, " + ", ".join(f"round(avg({c}), 4) as mean_{c}, round(sqrt(greatest(avg({c} * {c}) - avg({c}) * avg({c}), 1e-8)), 4) as std_{c}" for c in ("nir", "red")) + " from pt group by lake", ("fx_pixels",))
def _(spark, sf):
    return spatial.channel_stats(spatial.patch_pixels(view(spark, sf, "fx_pixels"), 16, 8, 32, 32), ["nir", "red"])


@query("o_ras_3_4_patch_index", ", o as (select unnest([0, 8, 16]) as pr), pt as (select g.*, a.pr, b.pr as pc from fx_grid g join o a on g.r >= a.pr and g.r < a.pr + 16 join o b on g.c >= b.pr and g.c < b.pr + 16) select lake, yr, pr, pc, count(*) as n, count(cls) as labelled from pt group by all having count(cls) >= count(*) * 0.10", ("fx_grid",))
def _(spark, sf):
    return spatial.patch_index(spatial.patch_pixels(view(spark, sf, "fx_grid"), 16, 8, 32, 32))


@query("o_agg_6_class_weights", ", k as (select lake, cls, count(*) as n from fx_pixels group by all) select lake, cls, n, round((1.0::double / greatest(n, 1)) / avg(1.0::double / greatest(n, 1)) over (partition by lake), 6) as weight from k", ("fx_pixels",))
def _(spark, sf):
    return zonal.class_weights(view(spark, sf, "fx_pixels"))


@query("o_agg_7_label_qa", LABELLED + f" select yr, count(label) as labelled_px, count(*) filter (where region) as region_px, count(*) filter (where region and scl in {BAD}) as cloud_px, count(*) filter (where region and conflict) as conflicts, " + ", ".join(f"count(*) filter (where label = {k}) as n_{n}" for k, n in enumerate(CLASSES)) + " from s group by yr", ("fx_grid", "fx_points"))
def _(spark, sf):
    return zonal.label_qa(labelled(spark, sf))


EXTERNAL = "(p.ok % 11) / 10.0::double"


def external(spark: SparkSession, sf: str) -> DataFrame:
    k = view(spark, sf, "fx_key").withColumn("presence", (F.col("ok") % 11) / 10.0).withColumn("fraction", (F.col("pk") % 8) / 4.0)
    return zonal.external_sums(k.join(view(spark, sf, "fx_zones"), zonal.ZONE_KEY), ("inside", "ring_30m", "ring_75m", "collar"))


LONG = ", e as (select k.lake, yr, (ok % 11) / 10.0::double as presence, (pk % 8) / 4.0::double as fraction, z.* exclude (lake, r, c) from fx_key k join fx_zones z on k.lake = z.lake and k.r = z.r and k.c = z.c), lg as (" + " union all ".join(f"select lake, '{z}' as zone, yr, round(sum(fraction), 1) as buildings, round(count(*) filter (where presence >= 0.5) * 0.04::double, 3) as built_ha, round(count(*) * 0.04::double, 2) as zone_ha from e where {z} group by lake, yr" for z in ("inside", "ring_30m", "ring_75m", "collar")) + ")"


@query("o_agg_8_external_sums", LONG + " select * from lg", ("fx_key", "fx_zones"))
def _(spark, sf):
    return external(spark, sf)


@query("o_agg_9_jn_12_cross_check", f"select p.lake, yr, " + ", ".join(f"round(avg((dw = {k})::int), 4) as dw_{k}_frac" for k in range(9)) + f", {frac(f'({RECODE_DW}) = cls', f'({RECODE_DW}) is not null')} as agreement, {frac('dw = 3', 'cls = 1')} as flooded_of_our_veg from {ZONED} where inside group by p.lake, yr", PZ)
def _(spark, sf):
    return zonal.cross_check(pz(spark, sf))


@query("o_agg_10_pivot", LONG + " select lake, yr, " + ", ".join(f"max({m}) filter (where zone = '{z}') as ob_{m}_{z}" for z in ("inside", "ring_30m", "ring_75m") for m in ("buildings", "built_ha")) + " from lg where zone <> 'collar' group by lake, yr", ("fx_key", "fx_zones"))
def _(spark, sf):
    return zonal.pivoted(external(spark, sf).where("zone <> 'collar'"), ["inside", "ring_30m", "ring_75m"], ["buildings", "built_ha"])


@query("o_agg_11_preflight", LONG + " select lake, max(buildings) as max_buildings, max(buildings) > 1 as passes from lg where zone = 'collar' group by lake", ("fx_key", "fx_zones"))
def _(spark, sf):
    return zonal.preflight(external(spark, sf).where("zone = 'collar'"))


@query("o_agg_12_observed_water", """, x as (select p.*, z.inside, dw % 4 as gsw, dw * 10 as occurrence from fx_pixels p join fx_zones z on p.lake = z.lake and p.r = z.r and p.c = z.c where z.inside)
select lake, yr, round(count(*) filter (where gsw = 3) / greatest(count(*) filter (where gsw > 0), 1)::double, 4) as permanent_frac, round(count(*) filter (where gsw >= 2) / greatest(count(*) filter (where gsw > 0), 1)::double, 4) as any_frac,
round(count(*) filter (where gsw > 0 and cls = 0) / greatest(count(*) filter (where gsw > 0), 1)::double, 4) as ours_water_frac, round(avg(occurrence), 4) as mean_occurrence from x group by all""", PZ)
def _(spark, sf):
    return zonal.observed_water(pz(spark, sf).withColumn("gsw", F.col("dw") % 4).withColumn("occurrence", F.col("dw") * 10))


@query("o_agg_17_signatures", "select cls, count(*) as n, " + ", ".join(f"round(avg({b}), 4) as mean_{b}, round(quantile_cont({b}, 0.25), 4) as p25_{b}, round(quantile_cont({b}, 0.75), 4) as p75_{b}" for b in ("green", "nir")) + " from fx_pixels group by cls having count(*) >= 50", ("fx_pixels",))
def _(spark, sf):
    return zonal.signatures(view(spark, sf, "fx_pixels"), ["green", "nir"])


@query("o_agg_18_separability", f", i as (select yr, scl = 6 as ref, {MNDWI} as v from fx_pixels) select yr, round(avg((v > 0)::int) filter (where ref), 4) as tpr, round(avg((v > 0)::int) filter (where not ref), 4) as fpr, round(abs(avg(v) filter (where ref) - avg(v) filter (where not ref)) / sqrt(var_pop(v) filter (where ref) + var_pop(v) filter (where not ref)), 4) as distance from i group by yr", ("fx_pixels",))
def _(spark, sf):
    px = view(spark, sf, "fx_pixels").withColumn("mndwi", S.indices(F.col("green"), F.col("red"), F.col("nir"), F.col("swir16"))["mndwi"])
    return zonal.separability(px, "mndwi", F.col("scl") == 6)


@query("o_agg_18_histogram", f"select yr, cast(least(floor(({MNDWI} + 1) / 2 * 120), 119) as int) as bin, count(*) as n from fx_pixels group by all", ("fx_pixels",))
def _(spark, sf):
    px = view(spark, sf, "fx_pixels").withColumn("mndwi", S.indices(F.col("green"), F.col("red"), F.col("nir"), F.col("swir16"))["mndwi"])
    return zonal.histogram(px, "mndwi")


@query("o_agg_28_agreement", f", y as (select p.lake, yr, avg((cls = dw % 4)::int) as same from {ZONED} where region group by p.lake, yr) select lake, round(avg(same), 6) as agreement from y group by lake", PZ)
def _(spark, sf):
    return zonal.agreement(pz(spark, sf).withColumn("other", F.col("dw") % 4), "other")


@query("o_agg_31_scene_scores", f"select lake, yr, round(avg((scl in {BAD})::int), 6) as bad, round(avg((scl <> 0)::int), 6) as cover, round(round(avg((scl in {BAD})::int), 6) + (1 - round(avg((scl <> 0)::int), 6)), 6) as score from fx_grid where region group by all", ("fx_grid",))
def _(spark, sf):
    return zonal.scene_scores(view(spark, sf, "fx_grid"))


@query("o_agg_30_grid_coverage", ", z as (select lake, round(count(*) filter (where inside) * 0.04::double, 2) as on_grid_ha from fx_zones group by lake), f as (select lake, abs(sum(x1 * y2 - x2 * y1)::bigint / 2.0::double) * 0.04::double as footprint_ha from fx_edges group by lake) select lake, on_grid_ha, footprint_ha, on_grid_ha < footprint_ha * 0.98 as flagged from z join f using (lake)", ("fx_zones", "fx_edges"))
def _(spark, sf):
    foot = spatial.shoelace(view(spark, sf, "fx_edges")).select("lake", (F.col("area") * 0.04).alias("footprint_ha"))
    return zonal.grid_coverage(view(spark, sf, "fx_zones"), foot)


# --- panels ----------------------------------------------------------------------------


def moving(grid: DataFrame) -> DataFrame:
    """The grid with classes that change over the years (those of the external layer, folded to four)."""
    return grid.withColumn("cls", F.col("dw") % 4)


panel_query("o_win_1_baseline", ", f as (select *, first(water) over (partition by lake order by yr) as w from fx_fractions) select lake, yr, round(water - w, 2) + 0.0::double as delta, case when w > 0 then round((water - w) / w * 100, 1) + 0.0::double end as pct from f", lambda p: panel.change_from_first(p, "water"))
panel_query("o_win_2_steps", ", f as (select *, lag(yr) over w as from_yr, lag(water) over w as a, lag(built) over w as b from fx_fractions window w as (partition by lake order by yr)) select lake, yr, from_yr, water, built, round(water - a, 4) as d_water, round(built - b, 4) as d_built from f where from_yr is not null", lambda p: panel.steps(p, ["water", "built"]).select("lake", "yr", "from_yr", "water", "built", "d_water", "d_built"))
panel_query("o_win_3_later_max", "select lake, yr, max(water) over (partition by lake order by yr rows between 1 following and unbounded following) as later_max from fx_fractions", lambda p: panel.later_max(p, "water"))
READ = "case " + " ".join(f"when {c} then '{r}'" for c, r in zip(("dw >= -0.05", "du > 0.02 and built_persists", "dv > 0.05", "db > 0.05 and recovers_later", "db > 0.05", "du > 0.02", "true"), panel.READINGS, strict=True)) + " end"
panel_query("o_chg_4_readings", f""", f as (select *, lag(yr) over w as from_yr, water - lag(water) over w as dw, veg - lag(veg) over w as dv, bare - lag(bare) over w as db, built - lag(built) over w as du, lag(water) over w as wb,
max(water) over l as lw, max(built) over l as lb, count(*) over l as nl from fx_fractions window w as (partition by lake order by yr), l as (partition by lake order by yr rows between 1 following and unbounded following)),
g as (select *, coalesce(lw >= wb * 0.8, false) as recovers_later, nl = 0 or coalesce(lb >= built * 0.8, false) as built_persists from f where from_yr is not null)
select lake, from_yr, yr, round(dw, 4) as d_water, round(dv, 4) as d_veg, round(db, 4) as d_bare, round(du, 4) as d_built, recovers_later, built_persists, {READ} as reading from g""", panel.readings)
panel_query("o_agg_16_risk_3_growth", "select lake, count(*) as n, arg_min(built_px, yr) as first, arg_max(built_px, yr) as last, case when count(*) > 2 then round((exp(regr_slope(ln(1 + built_px::double), yr)) - 1) * 100, 1) end as growth_pct from fx_panel group by lake", lambda p: panel.growth(p, "built_px"), ("fx_panel",))
panel_query("o_chg_2_net_change", "select lake, round(arg_max(water, yr) - arg_min(water, yr), 2) as net from fx_fractions group by lake", lambda p: panel.net_change(p, "water"))
panel_query("o_agg_27_first_last", "select lake, min(yr) as first_yr, arg_min(water, yr) as first, max(yr) as last_yr, arg_max(water, yr) as last from fx_fractions group by lake", lambda p: panel.first_last(p, "water"))
panel_query("o_win_4_5_history", "select lake, r, c, yr, coalesce(sum(case when cls = 3 then 1 else 0 end) over (partition by lake, r, c order by yr rows between unbounded preceding and 1 preceding), 0)::bigint as before, coalesce(min(case when cls = 3 then 1 else 0 end) over (partition by lake, r, c order by yr rows between 1 following and unbounded following), 1) as always_later from fx_grid", panel.earlier_built, ("fx_grid",))
panel_query("o_chg_1_persistent_growth", "select lake, r, c from (select * replace (dw % 4 as cls) from fx_grid) where region group by all having max(case when yr = 1995 then coalesce((cls = 3)::int, 0) end) = 0 and min(case when yr >= 2000 then coalesce((cls = 3)::int, 0) end) = 1", lambda p: panel.persistent_growth(moving(p), 1995, 2000), ("fx_grid",))
panel_query("o_chg_3_index_change", "select lake, r, c, yr, case when lag(yr) over w = yr - 1 then round((nir - lag(nir) over w)::double, 6) else 0.0 end as change from fx_pixels window w as (partition by lake, r, c order by yr)", lambda p: panel.index_change(p.withColumn("nir", F.col("nir").cast("double")), "nir"), ("fx_pixels",))
panel_query("o_win_6_best_scene", "select id, yr, d::varchar as d, cloud, tile, lake from (select *, row_number() over (partition by lake, yr order by cloud, id) as k from fx_scenes) where k = 1", lambda s: panel.best_per_group(s, "lake", "yr").withColumn("d", F.col("d").cast("string")), ("fx_scenes",))
panel_query("o_win_7_latest_version", "select 'S2_' || tile || '_' || yr as scene_key, max('S2_' || tile || '_' || yr || '_' || (id % 7) || '_L2A') as scene, count(*) as versions from fx_scenes group by tile, yr", lambda s: panel.latest_version(s.select(F.concat_ws("_", F.lit("S2"), "tile", "yr", F.col("id") % 7, F.lit("L2A")).alias("scene"))), ("fx_scenes",))
panel_query("o_win_8_folds", ", a as (select lake, count(*) as area from fx_zones where inside group by lake), r as (select *, row_number() over (order by area desc, lake) - 1 as k, count(*) over () as n from a) select r.k as fold, r.lake as test, v.lake as val, string_agg(o.lake::varchar, ',' order by o.lake) as train from r join r v on v.k = (r.k + 1) % r.n join r o on o.lake not in (r.lake, v.lake) group by r.k, r.lake, v.lake", lambda z: panel.folds(z.where("inside").groupBy("lake").agg(F.count("*").alias("area"))), ("fx_zones",))
panel_query("o_win_9_order_statistics", ", k as (select lake, water as value, row_number() over (partition by lake order by water) as k, count(*) over (partition by lake) as n from fx_fractions) select lake, coalesce(max(value) filter (where k = floor(0.2 * (n + 1))), '-inf'::double) as lo, coalesce(max(value) filter (where k = ceil(0.8 * (n + 1))), 'inf'::double) as hi from k group by lake", lambda p: evaluate.order_statistics(p, "lake", "water", 0.2))
panel_query("o_agg_34_year_matrix", "select lake, " + ", ".join(f"max(water) filter (where yr = {y}) as y{y}" for y in range(1995, 2002)) + " from fx_fractions group by lake", lambda p: panel.year_matrix(p, "water", list(range(1995, 2002))))
panel_query("o_agg_21_correlations", " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 4) as r from fx_fractions" for a in ("water", "veg", "built") for b in ("water", "veg", "built")), lambda p: panel.correlations(p, ["water", "veg", "built"]))
panel_query("o_agg_22_constant_columns", "select 'k' as name, (select max(n) = 1 from (select count(distinct k) as n from fx_disc group by lake)) as constant union all select 'd2', (select max(n) = 1 from (select count(distinct d2) as n from fx_disc group by lake))", lambda z: panel.constant_columns(z, "lake", ["k", "d2"]), ("fx_disc",))
panel_query("o_agg_35_means", "select lake, round(avg(water), 6) as water, round(avg(veg), 6) as veg from fx_fractions group by lake", lambda p: p.groupBy("lake").agg(F.round(F.avg("water"), 6).alias("water"), F.round(F.avg("veg"), 6).alias("veg")))
panel_query("o_agg_19_rain_matrix", ", m as (select lake, year(d) as yr, month(d) as m, sum(rain_raw)::bigint as rain from fx_weather group by all) select lake, yr, " + ", ".join(f"max(rain) filter (where m = {m}) as m{m}" for m in range(1, 13)) + " from m group by lake, yr", lambda w: panel.month_climatology(w.withColumnRenamed("rain_raw", "rain"))[0], ("fx_weather",))
panel_query("o_agg_19_climatology", ", m as (select lake, year(d) as yr, month(d) as m, sum(rain_raw) as rain from fx_weather group by all) select lake, m, round(avg(rain), 2) as mean_rain from m group by lake, m", lambda w: panel.month_climatology(w.withColumnRenamed("rain_raw", "rain"))[1], ("fx_weather",))
panel_query("o_risk_5_rain_trend", ", y as (select lake, year(d) as yr, sum(rain_raw)::double / 1e6 as rain from fx_weather group by all), j as (select lake, rain, water from fx_fractions join y using (lake, yr)), s as (select lake, count(*) as n, round(corr(rain, water), 4) as r, round(regr_slope(water, rain), 6) as slope, round(regr_intercept(water, rain), 4) as intercept from j group by lake) select *, case when abs(r) < 0.40 then 'no trend' when r > 0 then 'rising' when r < 0 then 'falling' end as trend from s",
    lambda p, w: panel.rain_trend(p.join(w.groupBy("lake", F.year("d").alias("yr")).agg((F.sum("rain_raw").cast("double") / 1e6).alias("rain")), ["lake", "yr"]), "rain", "water"), ("fx_fractions", "fx_weather"))
panel_query("o_top_1_lakes_by_area", "select lake, area from (select lake, count(*) as area from fx_zones where inside group by lake) order by area desc, lake limit 3", lambda z: z.where("inside").groupBy("lake").agg(F.count("*").alias("area")).orderBy(F.desc("area"), "lake").limit(3), ("fx_zones",))
SCENE_Q = ", q as (select *, (id % 50) / 100.0::double as bad, 1 - (id % 9) / 100.0::double as cover from fx_scenes), sq as (select *, bad + (1 - cover) as score, row_number() over (partition by lake, yr order by cloud, id) as k from q)"
panel_query("o_top_2_candidate_dates", SCENE_Q + " select lake, yr, coalesce(arg_min(id, k) filter (where cover > 0.99 and bad < 0.03), arg_min(id, score * 1000 + k * 1e-6)) as id from sq where k <= 6 group by lake, yr", lambda s: panel.candidate_dates(s.withColumn("bad", (F.col("id") % 50) / 100.0).withColumn("cover", 1 - (F.col("id") % 9) / 100.0).withColumn("score", F.col("bad") + (1 - F.col("cover")))), ("fx_scenes",))
panel_query("o_top_5_ordering", "select lake, mean_water from (select lake, round(avg(water), 6) as mean_water from fx_fractions group by lake) order by mean_water desc", lambda p: p.groupBy("lake").agg(F.round(F.avg("water"), 6).alias("mean_water")).orderBy(F.desc("mean_water")))
panel_query("o_agg_24_tile_coverage", ", t as (select tile, count(distinct yr) as years from fx_scenes group by tile) select * from t order by years desc, tile desc limit 1", lambda s: s.groupBy("tile").agg(F.count_distinct("yr").alias("years")).orderBy(F.desc("years"), F.desc("tile")).limit(1), ("fx_scenes",))
panel_query("o_agg_25_inventory", "select tile, lake, count(*) as n, count(*) filter (where cloud < 25) as used from fx_scenes group by rollup (tile, lake)", lambda s: s.rollup("tile", "lake").agg(F.count("*").alias("n"), F.count_if(F.col("cloud") < 25).alias("used")), ("fx_scenes",))


# --- set operations ----------------------------------------------------------------------

panel_query("o_set_1_union", "select lake, 'water' as m, water as v from fx_fractions union all select lake, 'built', built from fx_fractions", lambda p: p.select("lake", F.lit("water").alias("m"), F.col("water").alias("v")).unionByName(p.select("lake", F.lit("built").alias("m"), F.col("built").alias("v"))))
panel_query("o_set_2_difference", "select lake, r, c from fx_zones where ring_75m except select lake, r, c from fx_zones where ring_30m", lambda z: z.where("ring_75m").select("lake", "r", "c").exceptAll(z.where("ring_30m").select("lake", "r", "c")), ("fx_zones",))
panel_query("o_set_3_intersection", "select lake, yr from fx_fractions where water > 0.2 intersect select lake, yr from fx_fractions where built > 0.2", lambda p: p.where("water > 0.2").select("lake", "yr").intersect(p.where("built > 0.2").select("lake", "yr")))
panel_query("o_set_4_out_of_fold", "select lake, yr, r, c, case when lake % 2 = 0 then cls else (cls + 1) % 4 end as pred, case when lake % 2 = 0 then 'even' else 'odd' end as fold from fx_pixels", lambda p: p.where("lake % 2 = 0").select("lake", "yr", "r", "c", F.col("cls").alias("pred"), F.lit("even").alias("fold")).unionByName(p.where("lake % 2 = 1").select("lake", "yr", "r", "c", ((F.col("cls") + 1) % 4).alias("pred"), F.lit("odd").alias("fold"))), ("fx_pixels",))

# --- joins ---------------------------------------------------------------------------------

panel_query("o_jn_1_panel_join", ", w as (select lake, year(d) as yr, sum(rain_raw)::bigint as rain from fx_weather group by all) select f.lake, f.yr, water, rain from fx_fractions f left join w using (lake, yr)", lambda p, w: p.join(w.groupBy("lake", F.year("d").alias("yr")).agg(F.sum("rain_raw").alias("rain")), ["lake", "yr"], "left").select("lake", "yr", "water", "rain"), ("fx_fractions", "fx_weather"))
panel_query("o_jn_2_antecedent_rain", ", s as (select *, case when month(d) >= 10 then make_date(year(d)::int, 10, 1) else make_date(year(d)::int - 1, 10, 1) end as oct from fx_scenes where cloud < 25) select s.id, s.lake, s.d::varchar as d, " + ", ".join(f"coalesce(sum(rain_raw) filter (where w.d >= s.d - {n}), 0)::bigint as rain_{n}d" for n in (30, 90, 365)) + ", coalesce(sum(rain_raw) filter (where w.d >= oct), 0)::bigint as rain_season, round(avg(tmax) filter (where w.d >= s.d - 30), 4) as tmax_30d from s left join fx_weather w on w.lake = s.lake and w.d <= s.d and w.d >= s.d - 366 group by s.id, s.lake, s.d", lambda s, w: spatial.antecedent_rain(s.where("cloud < 25"), w).withColumn("d", F.col("d").cast("string")), ("fx_scenes", "fx_weather"))
CROSS = "((y1 > y) != (y2 > y)) and x < x1 + (y - y1) * (x2 - x1) / nullif(y2 - y1, 0)::double"
TT = "greatest(0.0::double, least(1.0::double, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0)::double))"
NEAR = f", nr as (select id, lake, count(*) filter (where {CROSS}) % 2 = 1 as inside, min(sqrt(pow(x - x1 - {TT} * (x2 - x1), 2) + pow(y - y1 - {TT} * (y2 - y1), 2))) as distance from fx_points cross join fx_edges group by id, lake)"
PE = ("fx_points", "fx_edges")
panel_query("o_jn_3_points_in_zones", NEAR + ", q as (select *, inside or distance = 0 as foot from nr where inside or distance <= 4) select lake, count(*) filter (where foot) as n_footprint, count(*) filter (where not foot and distance <= 2) as n_ring_30m, count(*) filter (where not foot and distance <= 4) as n_ring_75m from q group by lake", lambda p, e: spatial.counts_in_zones(p, e, {"ring_30m": 2.0, "ring_75m": 4.0}), PE)
panel_query("o_jn_4_band_pressure", NEAR + ", b as (select lake, case when distance <= 1 then 0 when distance <= 2.5 then 1 when distance <= 5 then 2 end as band from nr where not inside and distance > 0 and distance <= 5), n as (select lake, band, count(*) as n from b group by all), ar as (select r_regionkey as lake, k.band, (k.band + 1) * 10.0::double as area_ha from region cross join (select unnest([0, 1, 2]) as band) k) select lake, band, coalesce(n, 0) as n, area_ha, round(coalesce(n, 0) / area_ha, 4) as per_ha from ar left join n using (lake, band)",
    lambda p, e: spatial.band_pressure(p, e, [1.0, 2.5, 5.0], e.select("lake").distinct().withColumn("band", F.explode(F.array(*map(F.lit, range(3))))).withColumn("area_ha", (F.col("band") + 1) * 10.0)), PE)
panel_query("o_jn_6_rasterise_polygons", f", cc as (select r, c, c + 0.5::double as x, r + 0.5::double as y from fx_rc) select lake, r, c from cc cross join fx_edges group by lake, r, c having count(*) filter (where {CROSS}) % 2 = 1", lambda rc, e: spatial.cells_in_polygons(rc, e), ("fx_rc", "fx_edges"))
panel_query("o_jn_8_points_per_cell", "select cast(floor(y) as int) as r, cast(floor(x) as int) as c, count(*) as n from fx_points where floor(y) between 0 and 31 and floor(x) between 0 and 31 group by all", lambda p: spatial.counts_per_cell(p, 32, 32), ("fx_points",))
panel_query("o_jn_10_nearest", NEAR + ", q as (select *, row_number() over (partition by id order by (not inside)::int, case when inside then 0 else distance end, lake) as k from nr where inside or distance <= 3) select id, lake, inside, round(distance, 4) as distance from q where k = 1", lambda p, e: spatial.nearest(p, e, 3.0), PE)
LAYERS = ", ly as (select lake, r, c, yr as layer, nir * (case when ok % 3 = 0 then 0 else 1 end) as value, (yr * 7) % 5 as priority from fx_key join fx_pixels using (lake, yr, r, c))"
panel_query("o_jn_11_mosaic", LAYERS + " select lake, r, c, arg_min(value, priority * 10000 + layer) filter (where value <> 0) as value from ly group by all", lambda k, p: spatial.mosaic(k.join(p, ["lake", "yr", "r", "c"]).select("lake", "r", "c", F.col("yr").alias("layer"), F.when(F.col("ok") % 3 == 0, 0).otherwise(F.col("nir")).alias("value"), ((F.col("yr") * 7) % 5).alias("priority"))), ("fx_key", "fx_pixels"))
panel_query("o_jn_14_left_join", ", h as (select tile, count(*) as probes from fx_scenes where cloud > 50 group by tile), k as (select distinct tile, lake from fx_scenes) select k.tile, lake, probes from k left join h using (tile)", lambda s: s.select("tile", "lake").distinct().join(s.where("cloud > 50").groupBy("tile").agg(F.count("*").alias("probes")), "tile", "left"), ("fx_scenes",))
panel_query("o_jn_15_semi_anti", "select id, lake from fx_scenes s where exists (select 1 from fx_fractions f where f.lake = s.lake and f.yr = s.yr and water > 0.2) and not exists (select 1 from fx_fractions f where f.lake = s.lake and f.yr = s.yr and built > 0.25)", lambda s, p: s.join(p.where("water > 0.2"), ["lake", "yr"], "left_semi").join(p.where("built > 0.25"), ["lake", "yr"], "left_anti").select("id", "lake"), ("fx_scenes", "fx_fractions"))

# --- evaluation -------------------------------------------------------------------------------

CMQ = SCORES + ", cm as (select vec_id % 3 as g, truth, pred, count(*) as n from sc group by all)"


def cm(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(scores(spark, sf).withColumn("g", F.col("vec_id") % 3), "g")


query("o_agg_13_confusion", CMQ + " select g, truth, pred, n from cm", ("fx_scores",))(lambda spark, sf: cm(spark, sf))
PERQ = CMQ + ", kl as (select g, cls from (select distinct g from cm) cross join (select unnest([0,1,2,3]) as cls)), per as (select g, cls, coalesce((select sum(n) from cm where cm.g = kl.g and truth = cls), 0)::bigint as support, coalesce((select sum(n) from cm where cm.g = kl.g and pred = cls), 0)::bigint as predicted, coalesce((select sum(n) from cm where cm.g = kl.g and truth = cls and pred = cls), 0)::bigint as tp from kl)"
query("o_agg_14_metrics", PERQ + " select g, round(sum(tp) / sum(support)::double, 6) as accuracy, round(avg(case when predicted > 0 then 2 * tp / (support + predicted)::double end) filter (where support > 0), 6) as macro_f1, round(avg(tp / (support + predicted - tp)::double) filter (where support > 0), 6) as macro_iou, round((sum(tp) / sum(support)::double - sum(support * predicted) / (sum(support) * sum(support))::double) / (1 - sum(support * predicted) / (sum(support) * sum(support))::double), 6) as kappa, sum(support)::bigint as n from per group by g", ("fx_scores",))(lambda spark, sf: evaluate.summary_metrics(cm(spark, sf), "g"))
query("o_agg_33_row_normalised", CMQ + " select g, truth, pred, round(n / sum(n) over (partition by g, truth)::double, 6) as share from cm", ("fx_scores",))(lambda spark, sf: evaluate.row_normalised(cm(spark, sf), "g"))
ECEQ = SCORES + ", cf as (select truth, pred, 1 / (exp(logits[1] - list_max(logits)) + exp(logits[2] - list_max(logits)) + exp(logits[3] - list_max(logits)) + exp(logits[4] - list_max(logits))) as conf from sc), bn as (select ceil(conf * 10) as bin, count(*) as n, avg((truth = pred)::int) as acc, avg(conf) as conf from cf where conf > 0 group by 1) select round(sum(n * abs(acc - conf)) / (select count(*) from cf), 6) as ece from bn"
query("o_agg_15_calibration", ECEQ, ("fx_scores",))(lambda spark, sf: evaluate.calibration_error(scores(spark, sf).select((F.col("truth") == F.col("pred")).cast("int").alias("hit"), F.array_max(S.softmax(F.col("logits"))).alias("conf"))))
RANKQ = SCORES + ", z as (select vec_id % 3 as g, (truth = 1)::int as y, round(logits[2], 2) as score from sc), s as (select g, score, sum(y)::bigint as pos, sum(1 - y)::bigint as neg from z group by all), c as (select *, sum(pos) over d as tp, sum(neg) over d as fp, sum(pos) over (partition by g) as p, sum(neg) over (partition by g) as n from s window d as (partition by g order by score desc)), f as (select *, tp / (tp + fp)::double as precision_, 2 * tp / (tp + fp + p)::double as f1 from c) select g, round(sum(neg * (tp - pos) + pos * neg / 2.0::double) / (max(p) * max(n))::double, 6) as auc, round(sum(pos * precision_) / max(p)::double, 6) as ap, arg_max(score, f1) as threshold, round(max(f1), 6) as best_f1 from f group by g"
query("o_win_10_ranking", RANKQ, ("fx_scores",))(lambda spark, sf: evaluate.ranking(scores(spark, sf).select((F.col("vec_id") % 3).alias("g"), (F.col("truth") == 1).cast("int").alias("y"), F.round(F.col("logits")[1], 2).alias("score")), "g"))
GRID = [0.25, 0.5, 1.0, 2.0, 4.0]
query("o_ml_4_temperature", SCORES + ", t as (select unnest([0.25, 0.5, 1.0, 2.0, 4.0])::double as t) select t, round(avg(list_max(logits) / t + ln(exp((logits[1] - list_max(logits)) / t) + exp((logits[2] - list_max(logits)) / t) + exp((logits[3] - list_max(logits)) / t) + exp((logits[4] - list_max(logits)) / t)) - logits[truth + 1] / t), 6) as nll from sc cross join t group by t", ("fx_scores",))(lambda spark, sf: evaluate.temperature(scores(spark, sf), GRID))
WILQ = ", d as (select lake, round(water - built, 9) as d from fx_fractions where water - built <> 0), r as (select lake, d, 2 * rank() over (partition by lake order by abs(d)) + count(*) over (partition by lake, abs(d)) - 1 as r2 from d), k as (select *, row_number() over (partition by lake order by r2, d) - 1 as i, count(*) over (partition by lake) as n from r), m as (select lake, n, s, sum(case when (s >> i) & 1 = 1 then r2 else 0 end) as w from k cross join (select unnest(range(128)) as s) where s < (1 << n) group by lake, n, s), o as (select lake, count(*) as n, least(sum(case when d > 0 then r2 else 0 end), sum(case when d < 0 then r2 else 0 end)) as st from r group by lake) select o.lake, o.n, st / 2.0::double as statistic, round(least(1.0::double, 2 * count(*) filter (where w <= st) / (1 << o.n)::double), 6) as p from o join m using (lake) group by o.lake, o.n, st"
panel_query("o_ml_5_wilcoxon", WILQ, lambda p: evaluate.wilcoxon(p.select("lake", F.col("water").alias("a"), F.col("built").alias("b")), "lake"))
panel_query("o_prj_26_jn_17_decision", "select round(avg(water), 6) as mean_a, round(avg(built), 6) as mean_b, round(avg(built) - avg(water), 6) as gain, count(*) filter (where built > water) as improved, case when avg(built) - avg(water) >= 0.02 then 'b' else 'a' end as recommended from fx_fractions", lambda p: evaluate.decision(p.select(F.col("water").alias("a"), F.col("built").alias("b"))))
panel_query("o_agg_26_fold_summary", "select 'm' || (yr % 2) as model, round(avg(water), 6) as mean_f1, min(water) as min_f1, max(water) as max_f1 from fx_fractions group by yr % 2", lambda p: evaluate.fold_summary(p.select(F.concat(F.lit("m"), F.col("yr") % 2).alias("model"), F.col("water").alias("macro_f1"))))
SPLITS = ", sp as (select case when yr % 2 = 0 then 'raw' else 'enh' end as model, case when yr < 1999 then 'train' when yr < 2000 then 'val' else 'test' end as split, lake::varchar as lake, cls as truth, dw % 4 as pred, count(*) as n from fx_pixels where dw < 8 group by all), ev as (select * from sp union all select model, split, 'ALL (pooled)', truth, pred, sum(n) from sp where split <> 'test' group by all), kl as (select model, split, lake, cls from (select distinct model, split, lake from ev) cross join (select unnest([0, 1, 2, 3]) as cls)), pe as (select k.*, coalesce(sum(n) filter (where truth = cls), 0)::bigint as support, coalesce(sum(n) filter (where pred = cls), 0)::bigint as predicted, coalesce(sum(n) filter (where truth = cls and pred = cls), 0)::bigint as tp from kl k join ev using (model, split, lake) group by k.model, k.split, k.lake, k.cls)"
METRICS = "round(sum(tp) / sum(support)::double, 6) as accuracy, round(avg(case when predicted > 0 then 2 * tp / (support + predicted)::double end) filter (where support > 0), 6) as macro_f1, round(avg(tp / (support + predicted - tp)::double) filter (where support > 0), 6) as macro_iou, round((sum(tp) / sum(support)::double - sum(support * predicted) / (sum(support) * sum(support))::double) / (1 - sum(support * predicted) / (sum(support) * sum(support))::double), 6) as kappa, sum(support)::bigint as n"
panel_query("o_agg_26_pooled", SPLITS + f", me as (select model, split, lake, {METRICS} from pe group by model, split, lake) select * from me union all select model, split, 'ALL (mean)', " + ", ".join(f"round(avg({c}), 6)" for c in ("accuracy", "macro_f1", "macro_iou", "kappa")) + ", sum(n)::bigint from me where split = 'test' group by model, split",
    lambda p: evaluate.pooled_and_mean(p.where("dw < 8").groupBy(F.when(F.col("yr") % 2 == 0, "raw").otherwise("enh").alias("model"), F.when(F.col("yr") < 1999, "train").when(F.col("yr") < 2000, "val").otherwise("test").alias("split"), "lake", F.col("cls").alias("truth"), (F.col("dw") % 4).alias("pred")).agg(F.count("*").alias("n"))), ("fx_pixels",))
panel_query("o_agg_32_variant_pivot", "select lake, round(avg(water) filter (where yr % 2 = 0), 6) as raw, round(avg(water) filter (where yr % 2 = 1), 6) as enhanced, round(round(avg(water) filter (where yr % 2 = 1), 6) - round(avg(water) filter (where yr % 2 = 0), 6), 6) as gain from fx_fractions group by lake", lambda p: p.withColumn("v", F.when(F.col("yr") % 2 == 0, "raw").otherwise("enhanced")).groupBy("lake").pivot("v", ["raw", "enhanced"]).agg(F.round(F.avg("water"), 6)).withColumn("gain", F.round(F.col("enhanced") - F.col("raw"), 6)))
panel_query("o_risk_4_coverage", ", b as (select lake, water, avg(water) over (partition by lake) as m, stddev_pop(water) over (partition by lake) as s from fx_fractions) select lake, round(avg((water between m - s and m + s)::int), 6) as coverage, round(median(2 * s), 6) as width from b group by lake", lambda p: risk.coverage_of_band(p, "water"))

# --- rasters --------------------------------------------------------------------------------------

panel_query("o_ras_1_texture", ", g as (select lake, yr, r, c, nir::double as v from fx_grid), o as (select unnest([-1, 0, 1]) as o), k as (select g.lake, g.yr, g.r, g.c, case when g.r + a.o < 0 then 1 when g.r + a.o > 31 then 30 else g.r + a.o end as nr, case when g.c + b.o < 0 then 1 when g.c + b.o > 31 then 30 else g.c + b.o end as nc from g cross join o a cross join o b) select k.lake, k.yr, k.r, k.c, round(sum(v) / 9, 4) as mean, round(sqrt(greatest(sum(v * v) / 9 - (sum(v) / 9) * (sum(v) / 9), 0)), 4) as std from k join g on g.lake = k.lake and g.yr = k.yr and g.r = k.nr and g.c = k.nc group by all", lambda g: raster.texture(g, "nir", 32, 32), ("fx_grid",))
MIRRORED = ", im as (select n as at, n as i from (select unnest(range(32)) as n) union all select n, -n from (select unnest(range(1, {0} + 1)) as n) union all select n, 62 - n from (select unnest(range(31 - {0}, 31)) as n)), ex as (select g.lake, g.yr, a.i as r, b.i as c, case when cls = 3 then 1 else 0 end as v from fx_grid g join im a on a.at = g.r join im b on b.at = g.c), ac as (select *, sum(v) over (partition by lake, yr, r order by c range between {0} preceding and {0} following) as s from ex), dn as (select *, sum(s) over (partition by lake, yr, c order by r range between {0} preceding and {0} following) as n from ac) select lake, yr, r::int as r, c::int as c, round(n / {1}::double, 6) as share from dn where r between 0 and 31 and c between 0 and 31"
panel_query("o_ras_2_built_share", MIRRORED.format(5, "121.0"), lambda g: raster.built_share(g, 5, 32, 32), ("fx_grid",))
panel_query("o_ras_8_outline", "select a.lake, a.yr, count(*) as edges from fx_grid a cross join (select unnest([-1, 1, 0, 0]) as dr, unnest([0, 0, -1, 1]) as dc) s left join fx_grid b on b.lake = a.lake and b.yr = a.yr and b.r = a.r + dr and b.c = a.c + dc and b.cls = 0 where a.cls = 0 and b.lake is null group by all", lambda g: raster.outline(g, 0).groupBy("lake", "yr").agg(F.count("*").alias("edges")), ("fx_grid",))
panel_query("o_ras_10_block_average", "select lake, yr, cast(floor(r / 2) as int) as r, cast(floor(c / 2) as int) as c, round(coalesce(avg(nullif(nir, 0)), 0), 4) as nir from fx_grid group by lake, yr, cast(floor(r / 2) as int), cast(floor(c / 2) as int)", lambda g: raster.block_average(g, "nir", 2), ("fx_grid",))
panel_query("o_ras_12_quality", ", g as (select lake, yr, (nir % 256)::double as v from fx_pixels), l as (select lake, yr, floor(v) as lv, count(*) as k from g group by all), e as (select lake, yr, k / sum(k) over (partition by lake, yr)::double as p from l), b as (select lake, yr, sum(-p * log2(p)) as bits from e group by all) select lake, yr, round(stddev_pop(v), 4) as contrast, round(max(bits), 4) as entropy from g join b using (lake, yr) group by all", lambda p: raster.quality(p.withColumn("grey", (F.col("nir") % 256).cast("double")), "grey"), ("fx_pixels",))
panel_query("o_ras_13_bounds", "select lake, greatest(min(r) - 2, 0) as r0, least(max(r) + 2, 31) as r1, greatest(min(c) - 2, 0) as c0, least(max(c) + 2, 31) as c1 from fx_zones where region group by lake", lambda z: raster.bounds(z, 2, 32, 32), ("fx_zones",))
panel_query("o_ras_9_tile_average", PATCHED + " select lake, yr, r, c, round(avg(nir + pr + pc), 4) as logit from pt group by all", lambda p: spatial.patch_pixels(p, 16, 8, 32, 32).groupBy("lake", "yr", "r", "c").agg(F.round(F.avg(F.col("nir") + F.col("pr") + F.col("pc")), 4).alias("logit")), ("fx_pixels",))


def centred_score(cubes):
    """Scores of (green, nir, swir16) against the patch's mean green; overlapping patches differ, so the average tells."""
    green, nir, swir = cubes.transpose(1, 0, 2, 3)
    mean = green.mean(axis=(1, 2), keepdims=True)
    return np.stack([green - mean, nir - mean, swir - mean, swir - green], axis=1)


LOGIT_Q = PATCHED + ", me as (select lake, yr, pr, pc, sum(green) / 256.0::double as m from pt group by all), lo as (select p.lake, p.yr, r, c, avg(green - m) as a, avg(nir - m) as b, avg(swir16 - m) as d, avg(swir16 - green)::double as e from pt p join me using (lake, yr, pr, pc) group by all), mx as (select *, greatest(a, b, d, e) / 500 as top from lo)"
panel_query("o_ras_9_logits", LOGIT_Q + " select lake, yr, r, c, case when a >= greatest(b, d, e) then 0 when b >= greatest(d, e) then 1 when d >= e then 2 else 3 end as pred, round(1 / (exp(a / 500 - top) + exp(b / 500 - top) + exp(d / 500 - top) + exp(e / 500 - top)), 6) as conf from mx",
    lambda p: models.averaged_logits(models.score_patches(spatial.patch_pixels(p, 16, 8, 32, 32), ["green", "nir", "swir16"], centred_score, 16)).select("lake", "yr", "r", "c", S.argmax(F.transform("logits", lambda x: F.round(x, 9))).alias("pred"), F.round(F.array_max(S.softmax(F.transform("logits", lambda x: x / 500))), 6).alias("conf")), ("fx_pixels",))
#: Patches as reachability between cells: (lake, yr, r, c, first), first the smallest cell reached.
REACH = """, w as (select lake, yr, r, c from fx_grid where cls = {0}), p as (with recursive t(lake, yr, r, c, r0, c0) as (select lake, yr, r, c, r, c from w
union select t.lake, t.yr, w.r, w.c, t.r0, t.c0 from t join w on w.lake = t.lake and w.yr = t.yr and w.r between t.r - 1 and t.r + 1 and w.c between t.c - 1 and t.c + 1) select lake, yr, r, c, min(r0 * 100 + c0) as first from t group by lake, yr, r, c)"""
query("o_ras_7_patches", REACH.format(0) + " select lake, yr, (first // 100) || ',' || (first % 100) as patch, count(*) as px, round(count(*) * 0.04::double, 2) as ha, min(r) as r0, max(r) as r1, min(c) as c0, max(c) as c1 from p group by lake, yr, first having count(*) >= 2", ("fx_grid",))(lambda spark, sf: raster.patch_table(raster.patches(view(spark, sf, "fx_grid"), 0, 2)))
query("o_ras_7_tiles", REACH.format(3) + " select lake, yr, r, c, (first // 100) || ',' || (first % 100) as patch from p", ("fx_grid",))(lambda spark, sf: raster.patches(view(spark, sf, "fx_grid"), 3, 1, tile=5))
query("o_ras_14_burn_back", REACH.format(3) + ", k as (select *, count(*) over (partition by lake, yr, first) as n from p) select g.lake, g.yr, g.r, g.c, round(case when k.n >= 4 then (g.green % 256) * 0.5 + 127.5 else g.green % 256 end::double, 4) as v from fx_grid g left join k on k.lake = g.lake and k.yr = g.yr and k.r = g.r and k.c = g.c", ("fx_grid",))(lambda spark, sf: raster.burned(view(spark, sf, "fx_grid").withColumn("grey", F.col("green") % 256), raster.patches(view(spark, sf, "fx_grid"), 3, 4)))


# --- models, risk, streams, sinks ------------------------------------------------------------------

CHANNELS = ["blue", "green", "red", "nir", "swir16"]


@query("o_ml_1_2_forest")
def _(spark, sf):
    scored = models.leave_one_out(view(spark, sf, "fx_pixels"), {"forest": models.forest_scorer(CHANNELS, trees=10, depth=5)}, cap=20_000)
    return evaluate.summary_metrics(evaluate.confusion(scored, "lake"), "lake", "zero")


@query("o_ml_2_scorers")
def _(spark, sf):
    """The index rule and a forest on the same pixels of lakes that the forest never saw: metrics of each lake, and their mean."""
    px = view(spark, sf, "fx_pixels")
    green, swir, nir, red = (F.col(c) * 1e-4 for c in ("green", "swir16", "nir", "red"))
    rule = S.index_class(S.norm_diff(green, swir), S.norm_diff(nir, red))
    scorers = {"forest": models.forest_scorer(CHANNELS, trees=5, depth=4), "rule": models.rule_scorer(rule)}
    scored = models.leave_one_out(px, scorers, cap=20_000)
    counts = evaluate.confusion(scored.withColumn("key", F.struct("scorer", "lake")), "key").select("key.*", "truth", "pred", "n")
    return evaluate.pooled_and_mean(counts.withColumn("split", F.lit("test")), "scorer")


@query("o_ml_3_leakage")
def _(spark, sf):
    rows = view(spark, sf, "fx_fractions").join(view(spark, sf, "fx_weather").groupBy("lake", F.year("d").alias("yr")).agg((F.sum("rain_raw") / 1e6).alias("rain"), F.avg("tmax").alias("tmax")), ["lake", "yr"])
    return models.leakage(rows, ["rain", "tmax", "bare", "built"], "water")


@query("o_ml_6_score_patches")
def _(spark, sf):
    patched = spatial.patch_pixels(view(spark, sf, "fx_pixels"), 16, 8, 32, 32)
    logits = models.averaged_logits(models.score_patches(patched, ["green", "nir", "swir16"], plain_score, 16))
    return logits.groupBy("lake", "yr", S.argmax(F.col("logits")).alias("pred")).agg(F.count("*").alias("n"))


def plain_score(cubes):
    """Linear scores of (green, nir, swir16) for water, vegetation, bare and built."""
    green, nir, swir = cubes.transpose(1, 0, 2, 3)
    return np.stack([green - swir, nir - green, swir - green, (swir + green) / 2 - nir], axis=1)


@query("o_risk_1_random_intercept")
def _(spark, sf):
    fit = risk.random_intercept(view(spark, sf, "fx_fractions").withColumn("year_c", F.col("yr") - 1998), ["year_c"], "water")
    rows = [(n, float(b), float(s), fit["group_var"], fit["residual_var"]) for n, b, s in zip(fit["names"], fit["coef"], fit["se"], strict=True)]
    return spark.createDataFrame(rows, "name string, coef double, se double, group_var double, residual_var double")


@query("o_risk_2_jackknife")
def _(spark, sf):
    return risk.jackknife_plus(view(spark, sf, "fx_fractions").withColumn("year_c", F.col("yr") - 1998), ["year_c"], "water", 0.2)


UTM_T = f"sinh(atanh(sin(phi)) - {2 * geo.N**0.5 / (1 + geo.N)!r}::double * atanh({2 * geo.N**0.5 / (1 + geo.N)!r}::double * sin(phi)))"
UTM_X = "eta" + "".join(f" + {a!r}::double * cos({2 * (j + 1)} * xi) * sinh({2 * (j + 1)} * eta)" for j, a in enumerate(geo.ALPHA))
UTM_Y = "xi" + "".join(f" + {a!r}::double * sin({2 * (j + 1)} * xi) * cosh({2 * (j + 1)} * eta)" for j, a in enumerate(geo.ALPHA))


@query("o_prj_10_projection", f""", p as (select id, 70 + x * 0.5 as lon, 8 + y * 0.5 as lat, (floor((70 + x * 0.5 + 180) / 6) + 1)::int as zone from fx_points),
a as (select id, zone, radians(lat) as phi, radians(lon - (zone * 6 - 183)) as lam from p), b as (select id, zone, lam, {UTM_T} as t from a),
c as (select id, zone, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t * t)) as eta from b)
select id, zone, round(({UTM_X}) * {geo.K0 * geo.RADIUS!r}::double + 500000, 3) as east, round(({UTM_Y}) * {geo.K0 * geo.RADIUS!r}::double, 3) as north from c""", ("fx_points",))
def _(spark, sf):
    p = view(spark, sf, "fx_points").select("id", (70 + F.col("x") * 0.5).alias("lon"), (8 + F.col("y") * 0.5).alias("lat")).withColumn("zone", geo.utm_zone(F.col("lon")))
    east, north = geo.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    return p.select("id", "zone", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


LL_XI = "xi" + "".join(f" - {b!r}::double * sin({2 * (j + 1)} * xi) * cosh({2 * (j + 1)} * eta)" for j, b in enumerate(geo.BETA))
LL_ETA = "eta" + "".join(f" - {b!r}::double * cos({2 * (j + 1)} * xi) * sinh({2 * (j + 1)} * eta)" for j, b in enumerate(geo.BETA))
LL_PHI = "chi" + "".join(f" + {d!r}::double * sin({2 * (j + 1)} * chi)" for j, d in enumerate(geo.DELTA))


@query("o_prj_10_inverse", f""", p as (select id, (id % 2) = 1 as south, 43 as zone, 300000 + x * 12500 as east, 1000000 + y * 90000 as north from fx_points),
a as (select id, zone, (north - case when south then 10000000 else 0 end) / {geo.K0 * geo.RADIUS!r}::double as xi, (east - 500000) / {geo.K0 * geo.RADIUS!r}::double as eta from p),
b as (select id, zone, {LL_XI} as xi1, {LL_ETA} as eta1 from a), c as (select *, asin(sin(xi1) / cosh(eta1)) as chi from b)
select id, round(zone * 6 - 183 + degrees(atan2(sinh(eta1), cos(xi1))), 7) as lon, round(degrees({LL_PHI}), 7) as lat from c""", ("fx_points",))
def _(spark, sf):
    p = view(spark, sf, "fx_points")
    lon, lat = geo.lonlat(300000 + F.col("x") * 12500, 1000000 + F.col("y") * 90000, F.lit(43), F.col("id") % 2 == 1)
    return p.select("id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("o_str_2_rolling_rain", """with per as (select cast(ts as date) as day, sum(value) as rain from events group by all), s as (select day, rain, unnest(range(31)) as k from per)
select (day + k::int)::varchar as d, round(sum(rain), 4) as rain, count(*) as days from s group by day + k::int""")
def _(spark, sf):
    return feeds.rolling_batch(spark.read.parquet(f"{sf}/events.parquet")).withColumn("d", F.col("d").cast("string"))


@query("o_snk_5_summaries", "select lake, '{\"water\":' || max(water) || ',\"odd\":null}' as summary from fx_fractions group by lake", ("fx_fractions",))
def _(spark, sf):
    p = view(spark, sf, "fx_fractions").groupBy("lake").agg(F.max("water").alias("water")).withColumn("odd", F.lit(float("nan")))
    return sinks.summaries(p, "lake")


@query("o_snk_6_payload", ", s as (select 'lakes' as part, lake, '{\"lake\":' || lake || ',\"first_yr\":' || min(yr) || ',\"first\":' || arg_min(water, yr) || ',\"last_yr\":' || max(yr) || ',\"last\":' || arg_max(water, yr) || '}' as row from fx_fractions group by lake union all select 'series', lake, '{\"lake\":' || lake || ',\"yr\":' || yr || ',\"water\":' || water || '}' from fx_fractions) select * from s", ("fx_fractions",))
def _(spark, sf):
    p = view(spark, sf, "fx_fractions")
    return sinks.payload("lake", lakes=panel.first_last(p, "water"), series=p.select("lake", "yr", "water"))


@query("o_jn_9_name_match", """, n as (select n_nationkey as id, lower(trim(n_name)) as name, n_regionkey as lake, n_nationkey * 3 % 32 + 0.5::double as x, n_nationkey * 7 % 32 + 0.5::double as y from nation), o as (select c_custkey as oid, lower(trim(c_name)) as name, c_custkey % 100 as area from customer),
ex as (select n.id, max(area) as area from n join o on 'customer#' || lpad(n.id::varchar, 9, '0') = o.name group by n.id),
inn as (select id, count(*) filter (where """ + CROSS + """) % 2 = 1 as inside, lake from (select n.id, n.x, n.y, e.* from n cross join fx_edges e) group by id, lake), ci as (select id, max(lake) as lake from inn where inside group by id)
select n.id, case when ex.area is not null then 'osm' when ci.lake is not null then 'osm-geo' else 'buffer' end as source from n left join ex using (id) left join ci using (id)""", ("fx_edges",))
def _(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("customer#"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")).alias("name"), (F.col("n_nationkey") * 3 % 32 + 0.5).alias("x"), (F.col("n_nationkey") * 7 % 32 + 0.5).alias("y"))
    named = spark.read.parquet(f"{sf}/customer.parquet").select(F.lower(F.trim("c_name")).alias("name"), (F.col("c_custkey") % 100).alias("area"))
    return spatial.matched(n, named, view(spark, sf, "fx_edges"))


query("o_src_10_clip", "select r_regionkey as lake, id, x as lon, y as lat from fx_points join region on x between 4 + r_regionkey and 12.5 + r_regionkey and y between 3 and 15.5", ("fx_points",))(
    lambda spark, sf: landed.clipped(
        view(spark, sf, "fx_points").select("id", F.col("x").alias("lon"), F.col("y").alias("lat")),
        spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").alias("lake"), (F.col("r_regionkey") + 4.0).alias("minx"), (F.col("r_regionkey") + 12.5).alias("maxx"), F.lit(3.0).alias("miny"), F.lit(15.5).alias("maxy")),
    )
)
query("o_src_10_lines", "select r_regionkey as lake, l.id, count(*) as n from fx_lines l join (select distinct r_regionkey, id from fx_lines join region on x between 4 + r_regionkey and 12.5 + r_regionkey and y between 3 and 15.5) m on m.id = l.id group by all", ("fx_lines",))(
    lambda spark, sf: landed.clipped_lines(
        view(spark, sf, "fx_lines").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("v", "x", "y"))), lambda p: F.struct(p["y"].alias("lat"), p["x"].alias("lon"))).alias("geometry")),
        spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").alias("lake"), (F.col("r_regionkey") + 4.0).alias("minx"), (F.col("r_regionkey") + 12.5).alias("maxx"), F.lit(3.0).alias("miny"), F.lit(15.5).alias("maxy")),
    ).select("lake", "id", F.size("geometry").cast("long").alias("n"))
)


@query("o_snk_6_bundle", """, so as (select 'datasets' as part, tile as key, '{"key":' || tile || ',"y0":' || min(yr) || ',"y1":' || max(yr) || ',"used":' || bool_or(cloud < 25) || '}' as row from fx_scenes group by tile),
cl as (select 'climatology' as part, m as key, '{"key":' || m || ',"rain":' || round(avg(rain), 1) || '}' as row from (select month(d) as m, year(d) as yr, sum(rain_raw)::double as rain from fx_weather group by all) group by m),
hp as (select tile, count(*) filter (where cloud <= 50) > 0 as ok, count(*) as probes from fx_scenes where lake < 3 group by tile), he as (select 'health' as part, h.tile as key, '{"key":' || h.tile || ',"ok":' || ok || ',"probes":' || probes || '}' as row from hp h where exists (select 1 from fx_scenes s where s.tile = h.tile and cloud < 25)),
be as (select *, row_number() over (partition by yr order by cloud, id) as k from fx_scenes), sc as (select 'scenes' as part, yr as key, '{"key":' || yr || ',"date":"' || strftime(d, '%d %b %Y') || '","cloud":' || cloud || '}' as row from be where k = 1),
se as (select 'series' as part, lake as key, '{"key":' || lake || ',"yr":' || yr || ',"water":' || water || '}' as row from fx_fractions)
select part, key::bigint as key, row from (select * from so union all select * from cl union all select * from he union all select * from sc union all select * from se)""", ("fx_scenes", "fx_weather", "fx_fractions"))
def _(spark, sf):
    """The whole bundle a dashboard reads: sources, monthly rain, health of catalogued sources, scenes and lake series."""
    scenes, days = view(spark, sf, "fx_scenes"), view(spark, sf, "fx_weather")
    datasets = scenes.groupBy(F.col("tile").cast("long").alias("key")).agg(F.min("yr").alias("y0"), F.max("yr").alias("y1"), F.bool_or(F.col("cloud") < 25).alias("used"))
    months = days.groupBy(F.month("d").cast("long").alias("key"), F.year("d").alias("yr")).agg(F.sum("rain_raw").cast("double").alias("rain"))
    climatology = months.groupBy("key").agg(F.round(F.avg("rain"), 1).alias("rain"))
    probed = scenes.where("lake < 3").groupBy(F.col("tile").cast("long").alias("key")).agg((F.count_if(F.col("cloud") <= 50) > 0).alias("ok"), F.count("*").alias("probes"))
    health = probed.join(datasets.where("used").select("key"), "key", "left_semi")
    best = panel.best_per_group(scenes, "yr").select(F.col("yr").cast("long").alias("key"), F.date_format("d", "dd MMM yyyy").alias("date"), "cloud")
    series = view(spark, sf, "fx_fractions").select(F.col("lake").cast("long").alias("key"), "yr", "water")
    return sinks.payload("key", datasets=datasets, climatology=climatology, health=health, scenes=best, series=series)
