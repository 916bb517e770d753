"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.operators.skew import salted_join
from limnos.storage import stage

ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run below 24 holds no run of 24, so the bound may stand here
KEYLIKE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Base kinds in the order in which spans that start together are listed; owned comes last.
KINDS = ("assign", "access", "hex", "owned")
FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("value_start", T.LongType()),
            T.StructField("value_end", T.LongType()),
            T.StructField("digest", T.StringType()),
            T.StructField("lively", T.BooleanType()),
        ]
    )
)


def looks_live(value: str, least: float = 3.0) -> bool:
    """Letters and digits, 16 characters or more, and at least so many bits a character."""
    if len(value) < 16 or value.isalpha() or value.isdigit():
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= least


def candidates(text: str) -> list[tuple[int, int, int, int, int, str]]:
    """(kind, start, end, and start, end and text of the value) of every candidate, by start and kind."""
    found = [(0, m.start(), m.end(), m.start(2), m.end(2), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(1, *m.span(), *m.span(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, *m.span(), *m.span(), m[0]) for m in HEX.finditer(text)]
    base = sorted(found)
    for m in KEYLIKE.finditer(text):
        v = m[0]
        if re.search("[a-z]", v) and re.search("[A-Z]", v) and re.search("[0-9]", v) and not any(c[1] < m.end() and m.start() < c[2] for c in base):
            found.append((3, *m.span(), *m.span(), v))
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def _scanned(docs: DataFrame, keep: dict[str, Column], text_col: str) -> DataFrame:
    """The ``keep`` columns, which don't include ``found``, and every candidate of the whole text, found."""
    from pyspark.sql.pandas.types import to_arrow_schema

    picked = docs.select(*[c.alias(name) for name, c in keep.items()], F.col(text_col).alias("scanned"))
    out = T.StructType([f for f in picked.schema if f.name != "scanned"] + [T.StructField("found", FOUND)])
    arrow = to_arrow_schema(out)
    kept, names = list(keep), [f.name for f in FOUND.elementType]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("scanned"):
                rows = [(*c[:5], hashlib.sha256(c[5].encode("utf-8", "surrogatepass")).hexdigest(), looks_live(c[5])) for c in candidates(text.as_py() or "")]
                found.append([dict(zip(names, r, strict=True)) for r in rows])
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in kept], pa.array(found, arrow.field("found").type)], schema=arrow)

    return picked.mapInArrow(scan, out)


def _line(spans: Column, *more: str) -> Column:
    """kind:start:end (and more numbers) by start and kind, comma-joined."""
    told = ("end", *more)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), *[s[c].alias(c) for c in told])))
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), *[s[c].cast("string") for c in told])))


def _places(owner_col: str, repo_cols: tuple[str, ...]) -> dict[str, Column]:
    """Owner and repository of a row; nulls are one of their own."""
    return {
        "owner": F.coalesce(F.col(owner_col).cast("string"), F.lit("")),
        "repo": F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols])),
    }


def frequencies(seen: DataFrame) -> DataFrame:
    """(digest, n_owners, n_repos, n_seen) of candidates (digest, owner, repo), summed by place before they meet."""
    where_found = seen.groupBy("digest", "owner", "repo").agg(F.count("*").alias("n"))
    owners = where_found.groupBy("digest", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("digest").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_seen"))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), most_owners: int = 1, most_repos: int = 3, least_owners: int = 3
) -> DataFrame:
    """Spans that hold secrets in every whole text, one row per input row.

    Base kinds (assign, access, hex) are always reported. Other key-like runs
    (20 or more characters with both cases and digits, outside base spans) are
    candidates only: corpus-wide, the digests of all candidates' values are
    counted by distinct repositories and owners. A value that looks live and
    that at most ``most_owners`` owners have, in ``most_repos`` repositories at
    most, is owner-specific, and its span is added as ``owned``, within a base
    span or by itself: one owner's key that stands in many repositories is
    copied as an example is. A digest with ``least_owners`` owners or more is a
    widely copied example, which ``n_example`` counts; ``n_live`` counts owned
    values.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live,
    n_example and frequency (kind:start:end:owners:repositories of every
    candidate, owned or not, by start and kind). Null and empty texts have no spans; null owners and repositories
    count as one of their own; equal rows give equal results. Counts are summed
    per digest, repository and owner before they meet, and a copied example in a
    third of all rows meets its count in a salted join. Other columns are ignored.
    """
    rows = _scanned(docs, {"doc_id": F.col(id_col), **_places(owner_col, repo_cols)}, text_col)
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    seen = rows.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("f")).withColumn("digest", F.col("f.digest"))
    owned = F.col("f.lively") & (F.col("n_owners") <= most_owners) & (F.col("n_repos") <= most_repos)
    told = F.struct(*[F.col(f"f.{c}").alias(c) for c in ("kind", "start", "end", "value_start", "value_end")], "n_owners", "n_repos", (F.col("n_owners") >= least_owners).alias("example"), owned.alias("live"))
    judged = salted_join(seen, frequencies(seen), "digest").select("row", told.alias("v")).groupBy("row").agg(F.collect_list("v").alias("judged"))
    # rows without candidates, which are most, meet nothing
    kept = rows.where(F.size("found") > 0).join(judged, "row")
    none = rows.where(F.size("found") == 0).withColumn("judged", F.array().cast(judged.schema["judged"].dataType))
    span = lambda v, kind, start, end: F.struct(kind.alias("kind"), v[start].alias("start"), v[end].alias("end"))
    base = F.filter("found", lambda s: s["kind"] < 3)
    live = F.array_distinct(F.transform(F.filter("judged", lambda v: v["live"]), lambda v: span(v, F.lit(3), "value_start", "value_end")))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return kept.unionByName(none).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_line(base), 256).alias("base_sha256"),
        _line(F.concat(F.transform(base, lambda v: span(v, v["kind"], "start", "end")), live)).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        F.size(F.filter("judged", lambda v: v["example"])).cast("long").alias("n_example"),
        _line(F.col("judged"), "n_owners", "n_repos").alias("frequency"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), mark: str = "[SECRET]", **limits) -> DataFrame:
    """``docs`` with every reported span of scan_secrets replaced by a mark.

    Keeps all rows and columns. Overlapping spans become one mark. Rows without
    spans keep their text as it is, null included; repeated rows stay repeated.
    Rows with base spans alone are rewritten where they are; only rows with
    key-like runs besides, which are few, are written once to meet the corpus's
    frequencies, and then only their values do.
    """
    keep = docs.columns
    limit = F.col("n_owners") <= limits.get("most_owners", 1), F.col("n_repos") <= limits.get("most_repos", 3)
    seen = _scanned(docs, _places(owner_col, repo_cols), text_col).where(F.size("found") > 0).select("owner", "repo", F.explode("found").alias("f"))
    # a run outside base spans may be a base value elsewhere, so all candidates count
    owned = stage(frequencies(seen.select("owner", "repo", F.col("f.digest").alias("digest"))).where(limit[0] & limit[1]).select("digest"), "owned-secrets")

    rows = _scanned(docs, {f"k{i}": F.col(c) for i, c in enumerate(keep)}, text_col)
    open_ = F.exists("found", lambda v: (v["kind"] == 3) & v["lively"])
    bounds = lambda spans: F.transform(spans, lambda v: F.struct(v["start"].alias("start"), v["end"].alias("end")))
    base = bounds(F.filter("found", lambda v: v["kind"] < 3))
    asked = stage(rows.where(open_).withColumn("row", F.monotonically_increasing_id()), "rows-with-key-like-runs")
    runs = asked.select("row", F.explode(F.filter("found", lambda v: (v["kind"] == 3) & v["lively"])).alias("f")).select("row", F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.digest").alias("digest"))
    live = stage(runs, "key-like-runs").join(owned, "digest").groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("live"))
    judged = asked.join(live, "row", "left").withColumn("spans", F.concat(base, F.coalesce("live", F.array().cast("array<struct<start:bigint,end:bigint>>"))))
    names = [f"k{i}" for i in range(len(keep))]
    rows = rows.where(~open_).withColumn("spans", base).select(*names, "spans").unionByName(judged.select(*names, "spans"))

    text = F.col(f"k{keep.index(text_col)}")
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def add(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        piece = F.concat(acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.when(apart, piece).otherwise(acc["done"]).alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    clean = F.aggregate(F.array_sort("spans"), start, add, lambda acc: F.concat(acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    clean = F.when(F.size("spans") > 0, clean).otherwise(text)
    return rows.select(*[(clean if c == text_col else F.col(f"k{i}")).alias(c) for i, c in enumerate(keep)])
