"""Quality by ordinal cumulative-link regression on hashed text.

A document's grade is one of 0..K-1. One weight vector w over hashed features is shared by all
grades, K-1 ordered thresholds t_1 < t_2 < ... cut the scale: P(grade >= k) = sigmoid(w.x - t_k).
The expected grade is the sum of those tails, so one score gives both an order and tail
probabilities to select by.

Features of a text: hashed runs of three bytes, as the share of each bucket in the text to the
power 1/2, plus hashed bands of its length and of the share of distinct runs. All bytes of a
text count. Scoring is numpy over Arrow batches in blocks of bounded size; weights are a fixed
number of floats.

Defined results: null is an empty text, which has only its length feature; repeated rows get
equal scores; an empty table gives no rows, no labels give a model that accepts all; null
grades are not learned from. `accepted` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import balanced_sample, mapped, one_of_each, text_blocks

BUCKETS = 1 << 14
#: Further buckets: 16 length bands, 16 bands of distinct runs.
BANDS = 32
#: Labelled rows of each grade that a model is fitted on.
SAMPLE_PER_GRADE = 2_500
ROUNDS = 150


@dataclass(frozen=True)
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K-1, one row a text."""
        return 1.0 / (1.0 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each three-byte run, its text, and how many runs each text has."""
    sizes = np.maximum(np.diff(offsets) - 2, 0)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), sizes
    first = np.repeat(offsets[:-1], sizes) + (np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    value = data[first].astype(np.uint32)
    value |= data[first + 1].astype(np.uint32) << np.uint32(8)
    value |= data[first + 2].astype(np.uint32) << np.uint32(16)
    bucket = (value * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return bucket.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), sizes


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of the texts of a block: text, feature, value; sorted by text."""
    bucket, text, sizes = _runs(data, offsets)
    cells, counts = np.unique(text * BUCKETS + bucket, return_counts=True)
    row, feature = cells // BUCKETS, cells % BUCKETS
    value = np.sqrt(counts / np.maximum(sizes[row], 1))
    distinct = np.bincount(row, minlength=len(sizes))
    length = np.minimum(np.log2(1 + np.diff(offsets)), 15).astype(np.int64)
    expected = np.maximum(sizes, 1) ** 0.75
    spread = np.minimum(8 * distinct / expected, 15).astype(np.int64)
    every = np.arange(len(sizes))
    rows = np.concatenate([row, every, every])
    order = np.argsort(rows, kind="stable")
    columns = np.concatenate([feature, BUCKETS + length, BUCKETS + 16 + spread])
    values = np.concatenate([value, np.full(2 * len(sizes), 0.5)])
    return rows[order], columns[order], values[order]


def scores_of(model: Ordinal, column: pa.Array) -> np.ndarray:
    """w.x of every text of a column."""
    found = np.zeros(len(column))
    for start, end, data, offsets in text_blocks(column):
        row, feature, value = features(data, offsets)
        found[start:end] = np.bincount(row, weights=value * model.weights[feature], minlength=end - start)
    return found


def train(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grades: np.ndarray, weight: np.ndarray, levels: int) -> Ordinal:
    """Adam on the weighted negative log likelihood; gaps between thresholds stay positive."""
    n = len(grades)
    size = BUCKETS + BANDS
    w = np.zeros(size)
    share = np.array([(weight * (grades >= k)).sum() / weight.sum() for k in range(1, levels)])
    start = -np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    gaps = np.log(np.maximum(np.diff(start), 0.1))
    parameters = np.concatenate([w, start[:1], gaps])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    upto = grades[:, None] >= np.arange(1, levels)[None, :]
    for step in range(1, ROUNDS + 1):
        w, base, gap = parameters[:size], parameters[size], np.exp(parameters[size + 1 :])
        cuts = base + np.concatenate([[0.0], np.cumsum(gap)])
        score = np.bincount(row, weights=value * w[feature], minlength=n)
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -40, 40)))
        edge = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        every = np.arange(n)
        high, low = edge[every, grades], edge[every, grades + 1]
        likelihood = np.maximum(high - low, 1e-9)
        slope = edge * (1 - edge)
        by_cut = np.zeros((n, levels - 1))
        inner = grades >= 1
        by_cut[every[inner], grades[inner] - 1] = slope[every[inner], grades[inner]] / likelihood[inner]
        inner = grades < levels - 1
        by_cut[every[inner], grades[inner]] -= slope[every[inner], grades[inner] + 1] / likelihood[inner]
        by_cut *= weight[:, None] / weight.sum()
        # by_cut is d log P / d (score - cut)
        by_score = by_cut.sum(axis=1)
        gradient_w = -np.bincount(feature, weights=value * by_score[row], minlength=size) + 1e-5 * w
        by_base = by_cut.sum(axis=0)
        gradient_gap = np.array([by_base[k:].sum() * gap[k - 1] for k in range(1, levels - 1)])
        gradient = np.concatenate([gradient_w, [by_base.sum()], gradient_gap])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.15 if step < 0.7 * ROUNDS else 0.03
        parameters = parameters - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    w, base, gap = parameters[:size], parameters[size], np.exp(parameters[size + 1 :])
    return Ordinal(w.astype(np.float32), base + np.concatenate([[0.0], np.cumsum(gap)]))


def fit(docs: DataFrame, grades: DataFrame, levels: int, key: str = "doc_id", text: str = "text", grade: str = "grade", per_grade: int = SAMPLE_PER_GRADE) -> Ordinal:
    """Fit on about `per_grade` documents of each grade; grades are 0..levels-1.

    The driver gets hashed counts of the sampled documents, no texts.
    """
    known = grades.filter(F.col(grade).between(0, levels - 1)).select(F.col(key).alias("id_"), F.col(grade).cast("int").alias("grade_"))
    totals = {row["grade_"]: row["n"] for row in known.groupBy("grade_").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return Ordinal(np.zeros(BUCKETS + BANDS, np.float32), np.full(levels - 1, -10.0) + np.arange(levels - 1) * 1e-3)
    drawn = F.broadcast(balanced_sample(known, "id_", "grade_", per_grade))
    own = one_of_each(docs.select(F.col(key).alias("id_"), F.col(text).alias("text_")).join(drawn, "id_"), ["id_", "grade_"], "text_")
    own = own.select("text_", "grade_", F.xxhash64(F.col("id_").cast("string")).alias("order_"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_blocks(batch.column(0)):
                row, feature, value = features(data, offsets)
                cuts = np.searchsorted(row, np.arange(end - start + 1))
                parts = [
                    feature[a:b].astype("<u2").tobytes() + value[a:b].astype("<f4").tobytes()
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(start, end - start), batch.column(2).slice(start, end - start), pa.array(parts, pa.binary())],
                    ["grade", "order", "cells"],
                )

    rows = sorted(mapped(own, work, "grade int, order long, cells binary").collect(), key=lambda x: (x["order"], x["grade"], bytes(x["cells"])))
    features_, values, row = [], [], []
    for n, item in enumerate(rows):
        cells = bytes(item["cells"])
        count = len(cells) // 6
        features_.append(np.frombuffer(cells[: 2 * count], "<u2").astype(np.int32))
        values.append(np.frombuffer(cells[2 * count :], "<f4"))
        row.append(np.full(count, n, np.int32))
    if not rows:
        return Ordinal(np.zeros(BUCKETS + BANDS, np.float32), np.full(levels - 1, -10.0) + np.arange(levels - 1) * 1e-3)
    found = np.array([item["grade"] for item in rows])
    counts = np.bincount(found, minlength=levels)
    weight = np.array([totals.get(g, 0) / max(counts[g], 1) for g in range(levels)])[found]
    return train(np.concatenate(row), np.concatenate(features_), np.concatenate(values), found, weight, levels)


def score(docs: DataFrame, model: Ordinal, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail (array: P(grade >= 1), P(grade >= 2), ...) of every document row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = model.tails(scores_of(model, batch.column(1)))
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(len(tails) + 1) * tails.shape[1], pa.int32()), pa.array(tails.ravel(), pa.float64())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tails.sum(axis=1), pa.float64()), flat], ["doc_id", "expected_grade", "tail"]
            )

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text_"))
    return mapped(own, work, "doc_id long, expected_grade double, tail array<double>")


def accepted(docs: DataFrame, model: Ordinal, least_grade: int = 1, least_tail: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with P(grade >= least_grade) of at least `least_tail`."""
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = model.tails(scores_of(model, batch.column(at)))
            yield batch.filter(pa.array(tails[:, least_grade - 1] >= least_tail))

    return mapped(docs, work, docs.schema)


def grades_of(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ratings from the two labels: 0 poor, 1 sound but toxic, 2 sound and clean."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & toxic, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col(key), grade.alias("grade"))
