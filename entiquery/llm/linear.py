"""Linear models on hashed indicator features: labelled samples, two solvers, and scoring of whole tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ship import ship
from .features import BUCKETS, WIDE, features
from .shared import lean, materialise

#: Features of all rows of a sample together.
FEATURES = 1 << 24

_SAMPLE = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("buckets", pa.list_(pa.int64()))])
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def remainder(doc_id: str, modulus: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % modulus


@dataclass
class Model:
    """score = sigmoid(scale * (weights of a text's buckets, over ``norms`` if given, + bias))."""

    weights: np.ndarray
    bias: float
    scale: float
    norms: np.ndarray | None = None
    kinds: tuple[int, ...] = ()
    prefixes: tuple[int, ...] = ()

    def scores(self, column: pa.Array):
        """Yields (first row, last row, scores)."""
        for i, k, row, bucket in features(column, self.kinds, self.prefixes):
            total = np.bincount(row, self.weights[bucket], k - i) + self.bias
            if self.norms is not None:
                total = total / np.sqrt(np.bincount(row, self.norms[bucket], k - i) + 1)
            yield i, k, 1 / (1 + np.exp(-np.clip(self.scale * total, -40, 40)))


@dataclass
class SparseModel:
    """score = sigmoid(weights of a text's buckets + bias); ``keys``: the sorted buckets, of WIDE, that have a weight."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    kinds: tuple[int, ...] = ()
    prefixes: tuple[int, ...] = ()

    def scores(self, column: pa.Array):
        """Yields (first row, last row, scores)."""
        keys, weights = np.r_[self.keys, WIDE], np.r_[self.weights, 0.0]
        for i, k, row, bucket in features(column, self.kinds, self.prefixes, WIDE):
            at = np.searchsorted(keys, bucket)
            total = np.bincount(row, np.where(keys[at] == bucket, weights[at], 0.0), k - i) + self.bias
            yield i, k, 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, size: int, kinds: tuple[int, ...], prefixes: tuple[int, ...] = (), buckets: int = BUCKETS, most: int = FEATURES) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and 0/1 labels of at most ``size`` labelled rows with at most ``most`` features: half of each label, by the hash of doc_id.

    Both bound what reaches the driver. The choice is the same for any partitioning: rows are chosen by labels, of rows that repeat a doc_id
    the text of smallest hash; a row whose features would go beyond ``most`` is left out. A label that is null counts as none;
    of repeated labels of a doc_id the larger holds.
    """
    ship(docs.sparkSession)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.where(training).groupBy("doc_id").agg(F.max("label").alias("label"))
    some = [rows.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size // 2) for v in (0, 1)]
    chosen = F.broadcast(some[0].union(some[1]))  # at most ``size`` rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.xxhash64("text"), F.col("text").cast("string").alias("text")).alias("one")).join(chosen, "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("one").alias("one")).select("doc_id", "one.text", "label")

    def run(batches):
        for b in batches:
            for i, k, row, bucket in features(b.column(1), kinds, prefixes, buckets):
                cuts = pa.array(np.searchsorted(row, np.arange(k - i + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0)[i:k], b.column(2)[i:k], pa.ListArray.from_arrays(cuts, pa.array(bucket, pa.int64()))], schema=_SAMPLE)

    found = materialise(texts.mapInArrow(lean(run), "doc_id long, label int, buckets array<long>"))
    sizes = np.array(found.select(F.xxhash64("doc_id"), "doc_id", F.size("buckets")).orderBy(F.xxhash64("doc_id"), "doc_id").collect(), np.int64).reshape(-1, 3)
    fits = np.cumsum(sizes[:, 2]) <= most
    if not fits.all():
        found = found.where(F.col("doc_id").isin(sizes[fits, 1].tolist()))
    table = found.toArrow().combine_chunks()
    if not table.num_rows:
        return [], np.zeros(0, np.int64)
    lists = table["buckets"].combine_chunks()
    flat, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    return [flat[cuts[i] : cuts[i + 1]] for i in order], table["label"].to_numpy()[order].astype(np.int64)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], extra: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss machine; rows are sparse (bucket, value), ``extra`` the bias feature.

    Each step solves the dual for one row's multiplier, clipped to 0..cost.
    """
    w, bias = np.zeros(BUCKETS), 0.0
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    length = np.array([x @ x for x in values]) + extra**2
    for _ in range(epochs):
        moved = 0.0
        for j in rng.permutation(len(rows)):
            at, x = rows[j], values[j]
            gradient = y[j] * (w[at] @ x + bias * extra[j]) - 1
            step = min(max(alpha[j] - gradient / length[j], 0.0), cost[j]) - alpha[j]
            if step:
                w[at] += step * y[j] * x
                bias += step * y[j] * extra[j]
                alpha[j] += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 150) -> tuple[np.ndarray, np.ndarray, float]:
    """Columns in use, their weights and the bias of ridge logistic regression on soft labels, by accelerated gradient steps."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    column, at = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, v, bias, vb = np.zeros(len(column)), np.zeros(len(column)), 0.0, 0.0
    total = weight.sum()
    widest = max((len(r) for r in rows), default=0) + 1
    rate = 4 / (widest if widest < 64 else 64)
    for t in range(steps):
        m = t / (t + 3)
        look, lookb = w + m * v, bias + m * vb
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, look[at], len(rows)) + lookb, -40, 40)))
        g = weight * (p - y) / total
        new, newb = look - rate * (np.bincount(at, g[row], len(column)) + penalty * look), lookb - rate * g.sum()
        v, vb, w, bias = new - w, newb - bias, new, newb
    return column, w, bias


def score_documents(docs: DataFrame, model: Model | SparseModel, held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    ship(docs.sparkSession)
    shared_model = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches):
        m = shared_model.value
        for b in batches:
            for i, k, score in m.scores(b.column(2)):
                yield pa.RecordBatch.from_arrays([b.column(0)[i:k], b.column(1)[i:k], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema=_SCORED)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)), "text").mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")
