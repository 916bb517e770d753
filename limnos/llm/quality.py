"""Quality classifier on supervised subword embeddings."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.columns import unused

BITS = 17
DIM = 10
GRAMS = (3, 4)
#: Odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Characters of a text that are taken at once.
PIECE = 1 << 19
#: Labelled documents that a model is fitted on, about and at most.
TRAIN_ROWS = 6000

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, np.uint64), np.ones(0, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 14)
        up, down = (np.full(size, b, np.uint64) for b in (BASE, INVERSE))
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


def bucket(hashes: np.ndarray, salt: int) -> np.ndarray:
    mixed = (hashes + np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(33)
    return ((mixed * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: str) -> Iterator[np.ndarray]:
    """Buckets of a text's words, repeated words and character n-grams within words and at their borders.

    The text is taken in pieces, each with the few characters after it that its
    last n-grams reach, and a word that goes on carries its hash into the next
    piece: the features are those of the whole text, wherever it is cut.
    """
    begun, length = 0, 0  # hash and length of a word that goes on
    last = np.zeros(0, np.uint64)  # the word before
    for start in range(0, len(text), PIECE):
        chars = np.frombuffer(text[start : start + PIECE + max(GRAMS) - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        n, reach = min(PIECE, len(text) - start), len(chars)
        blank = (chars == 32) | ((chars >= 9) & (chars <= 13))
        chars[blank] = 32
        up, down = powers(reach)
        edges = np.flatnonzero(np.diff(np.concatenate(([True], blank[:n], [True])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((chars + np.uint64(1)) * up, dtype=np.uint64)))
        words, sizes = (sums[ends] - sums[starts]) * down[starts], ends - starts
        if length and not blank[0]:
            words[0] = (int(words[0]) * pow(BASE, length, 1 << 64) + begun) % (1 << 64)
            sizes[0] += length
        elif length:
            words = np.append(np.uint64(begun), words)
        length = 0
        if len(ends) and ends[-1] == n and start + n < len(text):
            begun, length, words = int(words[-1]), int(sizes[-1]), words[:-1]
        if len(words):
            yield bucket(words, 1)
            # word pairs: equal neighbours share one bucket, whatever the word
            run = np.append(last, words)
            yield bucket(np.zeros(int((run[1:] == run[:-1]).sum()), np.uint64), 2)
            last = words[-1:]
        for size in GRAMS:
            count = min(n, reach - size + 1)
            if count < 1:
                continue
            whole = np.ones(count, bool)
            for k in range(1, size - 1):
                whole &= ~blank[k : count + k]
            at = np.flatnonzero(whole & ~(blank[:count] & blank[size - 1 : count + size - 1]))
            yield bucket((sums[at + size] - sums[at]) * down[at], size)


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 5, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent on (buckets, counts, label) of each document.

    Vectors take longer steps, by the root of a document's number of buckets.
    A document is the mean of its features' vectors; a softmax over two classes
    follows. Since both are linear, the fitted model is one number a bucket
    (its vector's part in the log odds) and a bias.
    """
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for i in random.permutation(len(docs)):
            ids, counts, label = docs[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ vectors[ids]
            scores = out @ mean + bias
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[label] -= 1
            hidden = p @ out
            out -= lr * np.outer(p, mean)
            bias -= lr * 0.1 * p
            # a mean's gradient is spread thin over its many buckets, so they step further than the rest
            vectors[ids] -= (lr * len(ids)) ** 0.5 * 8 * np.outer(share, hidden)
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(id_col: str) -> Column:
    """Whether a document's labels are kept from learning."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> bytes:
    """A model from about ``rows`` labelled documents at most that are not held out.

    They are those whose id's hash lies below a threshold that the number of
    labels sets, so reruns agree and no task sorts the labels. Texts are turned
    into features where they lie; one task then has the bounded sample. Null and
    other labels than 0 and 1 are no labels; of repeated labels of one id the
    smaller holds, and of several texts of one id the smallest. Without any
    label the model scores 0.5 everywhere.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
        .groupBy("id")
        .agg(F.min("label").alias("label"))
    )
    share = min(1.0, rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(5), F.col("id").cast("string")), F.lit(1 << 32)) < int(share * (1 << 32)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for text in batch.column("text"):
                found = list(features(text.as_py() or ""))
                i, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
                ids.append(i.astype(np.int32).tobytes())
                counts.append(n.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("label"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["id", "label", "ids", "counts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [x for batch in batches for x in batch.to_pylist()]
        seen.sort(key=lambda x: (x["id"], x["label"], x["ids"]))
        sample = [(np.frombuffer(x["ids"], np.int32), np.frombuffer(x["counts"], np.int32), x["label"]) for x in seen]
        weights, bias = train(sample) if sample else (np.zeros(1 << BITS, np.float32), 0.0)
        np.savez_compressed(out := io.BytesIO(), weights=weights, bias=bias)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    # the sample's ids are bounded by ``rows``, so they may be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text"))
    model = texts.mapInArrow(count, "id string, label int, ids binary, counts binary").repartition(1).mapInArrow(learn, "model binary")
    return bytes(model.collect()[0]["model"])


def score_quality(docs: DataFrame, model: bytes, keep: dict[str, str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Probability of label 1 for every whole text, and some of its columns.

    ``keep`` maps columns of ``docs`` to names in the result, none of them
    ``score_col``, which is added.
    Null and empty texts have no features and get the model's bias. A text's
    features are taken in pieces, so memory stays bounded for any length.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    scored_text = unused(docs, "scored_text")
    picked = docs.select(*[F.col(c).alias(name) for c, name in keep.items()], F.col(text_col).alias(scored_text))
    from pyspark.sql.pandas.types import to_arrow_schema

    names = list(keep.values())
    schema = picked.select(*names, F.lit(0.0).alias(score_col)).schema
    arrow = to_arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = np.load(io.BytesIO(shared.value))
        weights, bias = fitted["weights"].astype(np.float64), float(fitted["bias"])
        for batch in batches:
            scores = []
            for text in batch.column(scored_text):
                total, n = 0.0, 0
                for ids in features(text.as_py() or ""):
                    total += float(weights[ids].sum())
                    n += len(ids)
                scores.append(1 / (1 + np.exp(-(total / max(n, 1) + bias))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(scores, pa.float64())], schema=arrow)

    return picked.mapInArrow(score, schema)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted (1 where the score is at least ``threshold``) of every document.

    Learns from fit_quality's bounded sample; scores use the text alone. One row
    per input row; repeated rows get equal scores; empty tables give no rows.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col)
    scored = score_quality(docs, model, {id_col: "doc_id"}, text_col)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
