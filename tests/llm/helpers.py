"""Tables that the tests of the training-data operators share."""

import re

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30000


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def awkward(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows, columns named as the operators name theirs."""
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "  \n ", "en", None, 4), (3, LONG, "en", "a", len(LONG)), (4, "one two", "en", "b", 7), (4, "one two", "en", "b", 7), (5, "ONE two", None, "b", 7)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("node", "key", "root", "q", "id", "terms", "score", "rank", "n_shingles", "text_key", "leak_id", "leak_key", "_text_key", "row", "found", "size"):
        df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def fresh(rng, n):
    return [f"w{rng.integers(0, 1_000_000)}" for _ in range(n)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
