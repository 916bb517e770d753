"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.columns import unused
from limnos.storage import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Steps of the ranking key that a source's words are summed over before the
#: one step that holds the cut is ranked row by row.
KEY_STEPS = 4096


def word_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A repeatable number in [0, 1) from the digest of a key."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=(3, 1, 2), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: its size and the words the mix should take of it.

    ``sizes`` has source and size. Sources in code point order, null last, get
    the weights in turn. The targets share ``budget`` times all sizes by weight
    and stop at ``most`` times the source's size; what is cut off is shared by
    weight among the rest until nobody is above. That fixed point is a water
    level: with sources ordered by size over weight, those below the level are
    full, and the level is the first one that the next source can hold.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = per_source.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight)
    by_fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("rank").asc())
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(budget))
        .withColumn("full_before", F.coalesce(F.sum("source_size").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(most))
        .withColumn("weight_left", F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("source_size") * F.lit(most))
    )
    level = F.coalesce(F.min_by("level", F.when(F.col("fits"), F.col("source_size") / F.col("weight"))).over(everything), F.lit(0.0))
    return filled.withColumn("water", level).select(
        "source", F.col("source_size").cast("long").alias("source_size"), "weight", F.least(F.col("source_size") * F.lit(most), F.col("water") * F.col("weight")).alias("target")
    )


def with_keys(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` with their sources' targets, whole copies and odds, and the Pareto key and its step."""
    keyed = rows.join(targets, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    return keyed.withColumn("q", F.when(F.col("p") > 0, odds)).withColumn("key", F.col("q") / (1 + F.col("q"))).withColumn("step", F.floor(F.col("key") * KEY_STEPS))


def mix_sources(
    docs: DataFrame, weights=(3, 1, 2), budget: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole_rows: bool = False
) -> DataFrame:
    """Copies of every document in a mix that meets its sources' targets.

    Every document of a source gets the whole copies that the source's rate
    (target over size) allows; the rest of the rate is its inclusion
    probability p for one more copy. Documents are ranked by Pareto order
    sampling, (u / (1 - u)) / (p / (1 - p)) with u uniform from the digest of
    the id, and taken in that order until the source's remaining words are met,
    to half the size of the document at the cut. The sample's size in words is
    thus fixed, and p is unequal between sources.

    Words are first summed by source and step of the ranking key; only the rows
    of the step that holds the cut are ranked one by one, so no source is
    sorted whole and a source with most of the rows costs no single task.

    Returns doc_id, source, size, source_size, target, copies and taken (size
    times copies), one row per input row. Null texts and texts without words
    have size 0 and take 0 words. A null source is a source of its own, the
    last. Rows with equal ids share their rank; among them the shorter comes
    first, and equal rows are interchangeable. Empty input gives no rows. Other
    columns, whatever their names, are ignored; with ``whole_rows`` all columns
    of ``docs`` come back instead of doc_id and source, and the added columns
    get underscores before their names where ``docs`` has such a column.
    """
    own = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), uniform(F.col(id_col)).alias("u")]
    slim = stage(docs.select(*own), "mix-sizes")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = stage(
        source_targets(slim, weights, budget, most)
        .withColumn("whole", F.floor(rate))
        .withColumn("p", rate - F.col("whole"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumnRenamed("source", "of"),
        "mix-targets",
    )
    # whole rows are read once more, not copied; targets have a row for each source
    rows = docs.select(*own, F.struct(*docs.columns).alias("whole_row")) if whole_rows else slim
    keyed = with_keys(slim, targets)
    per_step = keyed.where("step is not null").groupBy("source", "step", "rest").agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source").orderBy("step")
    cuts = (
        per_step.withColumn("before", F.sum("words").over(so_far) - F.col("words"))
        .where(F.col("before") <= F.col("rest"))
        .groupBy(F.col("source").alias("of"))
        .agg(F.max_by("step", "step").alias("cut"), F.max_by("before", "step").alias("before"))
    )
    cuts = stage(cuts, "mix-cuts")
    placed = with_keys(rows, targets).join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    at_cut = placed.where(F.col("step") == F.col("cut"))
    elsewhere = placed.where(~F.coalesce(F.col("step") == F.col("cut"), F.lit(False))).withColumn("more", F.coalesce(F.col("step") < F.col("cut"), F.lit(False)).cast("int"))
    in_order = Window.partitionBy("source", "step").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = at_cut.withColumn("ahead", F.col("before") + F.sum("size").over(in_order) - F.col("size")).withColumn(
        "more", (F.col("ahead") + F.col("size") / F.lit(2.0) <= F.col("rest")).cast("int")
    )
    out = elsewhere.unionByName(ranked.drop("ahead")).withColumn("copies", F.col("whole") + F.col("more"))
    added = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": F.col("copies").cast("long"), "taken": (F.col("size") * F.col("copies")).cast("long")}
    if whole_rows:
        return out.select(*[F.col("whole_row")[c].alias(c) for c in docs.columns], *[c.alias(unused(docs, name)) for name, c in added.items()])
    return out.select("doc_id", "source", *[c.alias(name) for name, c in added.items()])


#: DuckDB SQL for mix_sources over a relation named in {docs}.
MIX_SQL = r"""
with slim as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0 as u
  from {docs}
), per_source as (
  select source, sum(size)::bigint as source_size from slim group by source
), ranked as (
  select *, row_number() over (order by source nulls last) as rank from per_source
), weighed as (
  select *, [3.0::double, 1.0::double, 2.0::double][((rank - 1) % 3 + 1)::int] as weight from ranked
), filled as (
  select *, sum(source_size) over ()::double * 1.5::double as total,
    coalesce(sum(source_size) over (order by source_size / weight, rank rows between unbounded preceding and 1 preceding), 0)::double * 2.0::double as full_before,
    sum(weight) over (order by source_size / weight, rank rows between current row and unbounded following) as weight_left
  from weighed
), levels as (
  select *, (total - full_before) / weight_left as level from filled
), water as (
  select min_by(level, source_size / weight) as water from levels where level * weight <= source_size * 2.0::double
), targets as (
  select source, source_size, least(source_size * 2.0::double, coalesce((select water from water), 0) * weight) as target from levels
), rates as (
  select *, case when source_size > 0 then target / source_size else 0 end as rate from targets
), split as (
  select *, floor(rate) as whole, rate - floor(rate) as p, target - floor(rate) * source_size as rest from rates
), keyed as (
  select s.*, t.source_size, t.target, t.whole, t.p, t.rest,
    case when p > 0 then (u / (1 - u)) * ((1 - p) / p) end as q
  from slim s join split t on s.source is not distinct from t.source
), ordered as (
  select *, case when q is not null then
    sum(size) over (partition by source, q is null order by q / (1 + q), doc_id, size rows between unbounded preceding and current row) - size end as ahead
  from keyed
), out as (
  select *, (whole + case when ahead + size / 2.0::double <= rest then 1 else 0 end)::bigint as copies from ordered
)
"""
