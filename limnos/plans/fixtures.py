"""Domain views over the given tables: pixels, zones, weather, scenes, points and scores.

The same text runs in Spark and in DuckDB: integer arithmetic, so both agree.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    "fx_key": """select n_regionkey as lake, cast(year(l_shipdate) as int) as yr, cast(l_partkey % 32 as int) as r, cast(l_orderkey % 32 as int) as c,
        max(l_orderkey) as ok, max(l_partkey) as pk, max(l_suppkey) as sk
        from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
        group by n_regionkey, year(l_shipdate), l_partkey % 32, l_orderkey % 32""",
    "fx_pixels": """select lake, yr, r, c, 150 + (ok * 17 + pk) % 1200 as blue, 200 + (ok * 37 + yr * 11) % 1800 as green, 150 + (pk * 31) % 1500 as red,
        150 + (pk * 53 + yr * 7) % 3500 as nir, 100 + (ok * 29 + pk * 13) % 3000 as swir16,
        case (ok + pk + yr) % 16 when 0 then 8 when 1 then 3 when 2 then 9 when 3 then 7 else 4 + (ok * 7 + pk * 3) % 3 end as scl,
        (ok * 17 + pk * 5) % 9 as dw, (ok + pk * 3) % 4 as cls from fx_key""",
    # wider than the other rasters, so that its cells grow with the tables
    "fx_wide": """select n_regionkey as lake, cast(year(l_shipdate) as int) as yr, cast(l_partkey * 7 % 512 as int) as r, cast(l_orderkey * 11 % 512 as int) as c,
        (max(l_orderkey) + max(l_partkey) * 3) % 4 as cls, 150 + (max(l_partkey) * 53) % 3500 as nir
        from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
        group by n_regionkey, year(l_shipdate), l_partkey * 7 % 512, l_orderkey * 11 % 512""",
    "fx_order_points": "select o_orderkey as id, ((o_orderkey * 37) % 6400) / cast(200.0 as double) as x, ((o_orderkey * 91 + o_custkey) % 6410) / cast(200.0 as double) as y from orders",
    "fx_line_scores": "select l_linenumber % 3 as g, case when l_returnflag = 'R' then 1 else 0 end as y, round(l_extendedprice / 10, 1) as score from lineitem",
    "fx_rc": "select x.r, y.r as c from (select distinct cast(p_partkey % 32 as int) as r from part) x cross join (select distinct cast(p_partkey % 32 as int) as r from part) y",
    "fx_disc": "select r_regionkey as lake, r, c, (r - 16) * (r - 16) + (c - 16) * (c - 16) as d2, 6 + r_regionkey as k from fx_rc cross join region",
    "fx_zones": """select lake, r, c, d2 <= k * k as inside, d2 > k * k and d2 <= (k + 6) * (k + 6) as collar, d2 <= (k + 6) * (k + 6) as region,
        d2 > k * k and d2 <= (k + 2) * (k + 2) as ring_30m, d2 > k * k and d2 <= (k + 4) * (k + 4) as ring_75m from fx_disc""",
    "fx_years": "select distinct yr from fx_key",
    "fx_grid": """select z.lake, y.yr, z.r, z.c, coalesce(p.blue, 0) as blue, coalesce(p.green, 0) as green, coalesce(p.red, 0) as red, coalesce(p.nir, 0) as nir,
        coalesce(p.swir16, 0) as swir16, coalesce(p.scl, 0) as scl, p.cls, p.dw, z.inside, z.collar, z.region, z.ring_30m, z.ring_75m
        from fx_zones z cross join fx_years y left join fx_pixels p on p.lake = z.lake and p.yr = y.yr and p.r = z.r and p.c = z.c""",
    "fx_weather": """select n_regionkey as lake, cast(o_orderdate as date) as d, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as rain_raw, max(o_custkey % 40) as tmax
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_regionkey, cast(o_orderdate as date)""",
    "fx_scenes": """select o_orderkey as id, cast(year(o_orderdate) as int) as yr, cast(o_orderdate as date) as d, (o_orderkey * 7) % 100 as cloud, o_custkey % 3 as tile, n_regionkey as lake
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where month(o_orderdate) <= 4""",
    "fx_points": "select c_custkey as id, ((c_custkey * 37) % 640) / cast(20.0 as double) as x, ((c_custkey * 91) % 641) / cast(20.0 as double) as y from customer",
    "fx_scores": "select vec_id, label % 4 as truth, embedding from embeddings",
    "fx_edges": """select r_regionkey as lake, seq, 16 + (6 + r_regionkey) * x1 as x1, 16 + (6 + r_regionkey) * y1 as y1, 16 + (6 + r_regionkey) * x2 as x2, 16 + (6 + r_regionkey) * y2 as y2
        from region cross join (select 0 as seq, 1 as x1, 0 as y1, 1 as x2, 1 as y2 union all select 1, 1, 1, -1, 1 union all select 2, -1, 1, -1, -1
        union all select 3, -1, -1, 1, -1 union all select 4, 1, -1, 1, 0) o""",
    "fx_lines": """select s_suppkey as id, v, ((s_suppkey * 29 + v * 113) % 640) / cast(20.0 as double) as x, ((s_suppkey * 53 + v * 71) % 640) / cast(20.0 as double) as y
        from supplier cross join (select 0 as v union all select 1 union all select 2) k""",
    "fx_panel": """select p.lake, p.yr, cast(count(*) as bigint) as valid_px, cast(sum(case when cls = 0 then 1 else 0 end) as bigint) as water_px,
        cast(sum(case when cls = 1 then 1 else 0 end) as bigint) as veg_px, cast(sum(case when cls = 2 then 1 else 0 end) as bigint) as bare_px,
        cast(sum(case when cls = 3 then 1 else 0 end) as bigint) as built_px
        from fx_pixels p join fx_zones z on p.lake = z.lake and p.r = z.r and p.c = z.c where z.inside and scl not in (0, 1, 3, 8, 9, 10) group by p.lake, p.yr""",
    "fx_fractions": """select lake, yr, round(water_px / cast(valid_px as double), 6) as water, round(veg_px / cast(valid_px as double), 6) as veg,
        round(bare_px / cast(valid_px as double), 6) as bare, round(built_px / cast(valid_px as double), 6) as built from fx_panel""",
}


def with_views(*names: str) -> str:
    """``with`` clause of the views and of those below them."""
    needed: list[str] = []

    def add(name: str) -> None:
        for below in re.findall(r"\bfx_\w+", VIEWS[name]):
            add(below)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in needed)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view over the tables of ``sf_dir``."""
    text = with_views(name)
    for table in BASE:
        if re.search(rf"\b{table}\b", text):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(f"{text} select * from {name}")
