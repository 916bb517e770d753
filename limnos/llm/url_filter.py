"""URL filters: rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.storage import stage

#: (rule, verdict); a rule is a host and the start of a path.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Distinct labelled URLs that the trees are fitted on, about and at most.
TRAIN_ROWS = 20_000
#: Parts that the hosts fall into, so that a URL's own host is not in its suffix's rate when trees are fitted.
FOLDS = 5


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits a host (or a domain above it) and the start of a path, else null."""
    fits = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, rest = rule.partition("/")
        under = (host == domain) | host.endswith("." + domain)
        fits = F.when(under & path.startswith(slash + rest), F.lit(rule)).otherwise(fits)
    return fits


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc + F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c))))
    return F.when(n > 0, bits).otherwise(0.0)


#: What a block rate is counted for: the end of a host, the beginning of a path, and both together.
STATISTICS = ("suffix", "segment", "domain_segment", "opening")
FEATURES = (
    "n_url", "n_host", "n_path", "depth", "labels", "digit_share", "symbol_share", "bits", "host_bits", "params", "encoded", "secure", "numeric_host",
    "longest_digits", "longest_word", "first_length", *[f"{k}_{c}" for k in STATISTICS for c in ("rate", "seen")],
)


def statistic_values(host: Column, path: Column) -> dict[str, Column]:
    """The value of each of STATISTICS: the host's last two labels; the path's first segment; that with the host's last label; and with its last two and the next segment's first character."""
    parts = F.split(path, "/")
    segment, following = F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.substr(F.coalesce(F.get(parts, F.lit(2)), F.lit("")), F.lit(1), F.lit(1))
    values = (suffix(host), segment, F.concat_ws("/", F.substring_index(host, ".", -1), segment), F.concat_ws("/", suffix(host), segment, following))
    return dict(zip(STATISTICS, values, strict=True))


def lexical(urls: DataFrame) -> DataFrame:
    """Lexical features of ``url``, ``host`` and ``path``; null urls count as empty."""
    url = F.coalesce("url", F.lit(""))
    share = lambda pattern: F.when(F.length(url) > 0, F.regexp_count(url, F.lit(pattern)) / F.length(url)).otherwise(0.0)
    count = lambda column, pattern: F.regexp_count(column, F.lit(pattern)).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return urls.withColumns(
        {
            "n_url": F.length(url).cast("double"),
            "n_host": F.length("host").cast("double"),
            "n_path": F.length("path").cast("double"),
            "depth": count(F.col("path"), "/[^/]"),
            "labels": count(F.col("host"), "[^.]+"),
            "digit_share": share("[0-9]"),
            "symbol_share": share("[^A-Za-z0-9]"),
            "bits": entropy(url),
            "host_bits": entropy(F.col("host")),
            "params": count(query, "[^&]+"),
            "encoded": count(url, "%[0-9A-Fa-f]{2}"),
            "secure": url.startswith("https:").cast("double"),
            "longest_digits": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(url, F.lit("([0-9]+)")), F.length)), F.lit(0)).cast("double"),
            "longest_word": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(url, F.lit("([A-Za-z]+)")), F.length)), F.lit(0)).cast("double"),
            "first_length": F.length(F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit(""))).cast("double"),
            "numeric_host": F.col("host").rlike(r"^[0-9.]+(:[0-9]+)?$").cast("double"),
        }
    )


def fold(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """kind (of STATISTICS), value, fold, and how many labelled urls (and blocked ones) of hosts outside that fold have it; fold -1 has all."""
    values = statistic_values(F.col("host"), F.col("path"))
    long = labelled.select("label", fold(F.col("host")).alias("fold"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in values.items()])).alias("s"))
    per_fold = long.groupBy("s.kind", "s.value", "fold").agg(F.sum("label").alias("blocked"), F.count("*").alias("seen"))
    without = per_fold.select("kind", "value", "blocked", "seen", F.explode(F.filter(F.sequence(F.lit(-1), F.lit(FOLDS - 1)), lambda k: k != F.col("fold"))).alias("fold"))
    return without.groupBy("kind", "value", "fold").agg(F.sum("blocked").alias("blocked"), F.sum("seen").alias("seen"))


def with_rates(urls: DataFrame, counts: DataFrame, overall: float, fold_of: Column, prior: float = 10.0) -> DataFrame:
    """``urls`` with the smoothed block rate and the count of each of their STATISTICS; unseen values have the overall rate."""
    values = statistic_values(F.col("host"), F.col("path"))
    joined = urls.withColumns({f"{k}_value": v for k, v in values.items()} | {"fold": fold_of})
    for k in STATISTICS:
        of_kind = counts.where(F.col("kind") == k).select(F.col("value").alias(f"{k}_value"), "fold", "blocked", F.col("seen").alias("n"))
        joined = joined.join(of_kind, [f"{k}_value", "fold"], "left")
        seen = F.coalesce("n", F.lit(0))
        joined = joined.withColumns({f"{k}_rate": (F.coalesce("blocked", F.lit(0.0)) + overall * prior) / (seen + prior), f"{k}_seen": F.log1p(seen)}).drop("blocked", "n")
    return joined


def fit_trees(labelled: DataFrame, rows: int = TRAIN_ROWS, trees: int = 20, depth: int = 4):
    """Boosted trees on distinct labelled urls (url, host, path, label), and what scoring needs: suffix counts and the overall rate.

    About ``rows`` urls at most are fitted on: those whose hash lies below a
    threshold that their number sets, so copies of one url weigh as one and no
    task sorts them. Suffixes, and the other STATISTICS, are counted over all
    distinct labelled urls. A fitted url gets its rates from hosts of other
    folds than its own, so what it learns holds for hosts it has not seen.
    Without urls of both labels there are no trees.
    """
    distinct = stage(labelled.groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("label").alias("label")), "labelled-urls")
    total = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked")).first()
    overall = total["blocked"] / max(total["n"], 1)
    counts = stage(suffix_counts(distinct), "url-suffixes")
    if not 0 < overall < 1:
        return None, counts, overall
    share = min(1.0, rows / total["n"])
    sample = distinct.where(F.pmod(F.xxhash64(F.lit(7), "url"), F.lit(1 << 32)) < int(share * (1 << 32)))
    sample = stage(with_rates(lexical(sample), counts, overall, fold(F.col("host"))).select(*FEATURES, "label"), "url-sample")
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).select("features", "label")
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, stepSize=0.2, cacheNodeIds=False).fit(assembled), counts, overall


def score_trees(urls: DataFrame, fitted) -> DataFrame:
    """``urls`` (url, host, path and more) with the trees' probability of block as ``score``."""
    model, counts, overall = fitted
    if model is None:
        return urls.withColumn("score", F.lit(float(overall)))
    rated = with_rates(lexical(urls), counts, overall, F.lit(-1))
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rated))
    return scored.select(*urls.columns, vector_to_array("probability")[1].alias("score"))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", rows: int = TRAIN_ROWS, trees: int = 20, depth: int = 4) -> DataFrame:
    """Host, path, rule and verdict of every url.

    A url that a rule fits has the rule's verdict; these are the labelled urls.
    Boosted trees fitted on them (see fit_trees) judge the rest by lexical
    features.

    Returns page_id, host, path, rule, verdict and score (the trees' probability
    of block), one row per input row. Null urls and those without ``://`` have
    an empty host and path, fit no rule and are judged by the trees. Where the
    labelled urls are of one kind, or none is, the rest get that kind, or allow.
    Equal urls get equal verdicts. Other columns are ignored.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    urls = urls.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    of_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        of_rule = F.when(F.col("rule") == rule, verdict).otherwise(of_rule)
    urls = urls.withColumn("ruled", of_rule)
    labelled = urls.where("ruled is not null").select("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label"))
    scored = score_trees(urls, fit_trees(labelled, rows, trees, depth))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")


#: DuckDB SQL of judge_urls without its trees: page_id, host, path, rule and the rule's verdict.
RULES_SQL = r"""
with cut as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages
), fit as (
  select *, case
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule from cut
)
select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' end as ruled from fit
"""
