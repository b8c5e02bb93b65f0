"""Toxicity: a linear classifier over hashed character n-grams scaled by naive Bayes log-count ratios.

A document's features are the hashed character n-grams (case folded) that it holds, each once. On the training rows the
log-count ratio r of each feature is estimated; a logistic regression is fitted on the features times r, and r is folded
into its weights, so that scoring adds up one weight for each distinct n-gram of the whole text. The sum is divided by a
power of the number of distinct n-grams, so that long texts are no likelier to be toxic than short ones by length alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import bounded_batches, code_points, first_of_ids, folded, text_blocks


@dataclass(frozen=True)
class Settings:
    """sample_rows bounds the labelled rows a class that are fitted on, sample_bytes their texts in all; min_rows drops
    features rarer than it, min_ratio those with a smaller log-count ratio."""

    orders: tuple[int, ...] = (3, 4, 5)
    bits: int = 18
    sample_rows: int = 1500
    sample_bytes: int = 1 << 26
    min_rows: int = 3
    min_ratio: float = 0.4
    smoothing: float = 1.0
    epochs: int = 12
    rate: float = 0.5
    l2: float = 1e-4
    threshold: float = 0.3


def features(data: np.ndarray, offsets: np.ndarray, s: Settings) -> Iterator[np.ndarray]:
    """For each document of a block: its distinct hashed n-grams, in no order. Texts shorter than an n-gram have none."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    points = folded(code_points(data)).astype(np.uint64)
    at = np.searchsorted(heads, offsets)
    grams = []
    for n in s.orders:
        h = np.full(max(len(points) - n + 1, 0), n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + points[i : len(points) - n + 1 + i] if len(h) else h
        h = h * np.uint64(0x9E3779B97F4A7C15)
        grams.append((h >> np.uint64(64 - s.bits)).astype(np.int32))
    seen = np.zeros(1 << s.bits, np.int32)
    for a, b in zip(at.tolist(), at[1:].tolist()):
        own = np.concatenate([g[a : max(a, b - n + 1)] for n, g in zip(s.orders, grams)])
        order = np.arange(len(own), dtype=np.int32)
        seen[own] = order  # the last of equals stays
        yield own[seen[own] == order]


def fit(rows: list[np.ndarray], toxic: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """(weight of each feature, bias). With no row of one class every score is the share of label 1 (0 without rows)."""
    size = 1 << s.bits
    n1 = int(toxic.sum())
    if not n1 or n1 == len(toxic):
        return np.zeros(size), 30.0 if n1 else -30.0
    count = [np.zeros(size), np.zeros(size)]
    for x, y in zip(rows, toxic):
        count[int(y)][x] += 1
    r = np.log((count[1] + s.smoothing) / (n1 + 2 * s.smoothing)) - np.log((count[0] + s.smoothing) / (len(toxic) - n1 + 2 * s.smoothing))
    r[(count[0] + count[1] < s.min_rows) | (np.abs(r) < s.min_ratio)] = 0
    kept = [x[r[x] != 0] for x in rows]
    norm = np.array([length_norm(len(x)) for x in rows])
    worth = np.where(toxic > 0, len(toxic) / (2 * n1), len(toxic) / (2 * (len(toxic) - n1)))  # classes weigh the same
    w, bias, g2, b2 = np.ones(size), 0.0, np.full(size, 1e-8), 1e-8
    order = np.random.default_rng(0)
    for _ in range(s.epochs):
        for batch in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 64)):
            idx = np.concatenate([kept[i] for i in batch])
            sizes = [len(kept[i]) for i in batch]
            scale = np.repeat(norm[batch], sizes)
            value = r[idx] * scale
            owner = np.repeat(np.arange(len(batch)), sizes)
            z = np.bincount(owner, value * w[idx], len(batch)) + bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[batch]) * worth[batch]
            touched, place = np.unique(idx, return_inverse=True)
            grad = np.bincount(place, value * error[owner]) / len(batch) + s.l2 * w[touched]
            g2[touched] += grad**2
            w[touched] -= s.rate * grad / np.sqrt(g2[touched])
            slope = error.mean()
            b2 += slope**2
            bias -= s.rate * slope / b2**0.5
    return w * r, bias


def length_norm(n: int) -> float:
    return 1.0 / max(n, 1) ** 0.25


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Fit on sample() of the labelled rows, of a repeated doc_id on one of its texts. The fit runs in one executor task; the driver gets one row with 2**s.bits
    weights. Without labelled rows every score is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for batch in first_of_ids(batches, s.sample_bytes):
            for _, _, data, offsets in text_blocks(batch.column("text")):
                rows.extend(features(data, offsets, s))
            y.extend(batch.column("toxic").to_pylist())
        w, bias = fit(rows, np.array(y, float), s)
        yield pa.RecordBatch.from_pydict({"weights": [w.astype(np.float32).tobytes()], "bias": [float(bias)]})

    got = bounded_batches(sample(docs, labels, s).coalesce(1)).mapInArrow(run, "weights binary, bias double").collect()
    return (np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"]) if got else (np.zeros(1 << s.bits, np.float32), -30.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], s: Settings = Settings()) -> DataFrame:
    """docs plus score (0 to 1) and predicted (1 where score >= s.threshold), from the whole text alone.

    Row by row, no shuffle. Null and empty texts have no features: their score is that of the bias. A column of docs that
    is named score or predicted is replaced.
    """
    weights, bias = docs.sparkSession.sparkContext.broadcast(np.asarray(model[0], np.float64)), float(model[1])
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            out = []
            for _, _, data, offsets in text_blocks(batch.column("text")):
                out += [w[x].sum() * length_norm(len(x)) + bias for x in features(data, offsets, s)]
            p = 1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= s.threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return bounded_batches(docs).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the identifier's decimal text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, text, toxic of the rows to learn from: labelled, not held out, in docs; of repeated labels the largest.

    At most s.sample_rows identifiers of each class, those of the smallest hash, so the sample is the same on every run.
    They are picked from the identifiers alone; the list, at most 2 * s.sample_rows longs, is broadcast to the texts.
    """
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("_h", F.xxhash64("doc_id"))
    one, two = (own.filter(F.col("toxic") == y).orderBy("_h", "doc_id").limit(s.sample_rows) for y in (0, 1))
    return docs.select("doc_id", "text").join(F.broadcast(one.unionByName(two).drop("_h")), "doc_id")
