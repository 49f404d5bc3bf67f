"""M3: linear SVM with squared hinge loss, C = 1 and a penalised intercept.

For each separator the strictly convex objective ``0.5·|w|² + C·Σ max(0, 1 - s·(w·x))²`` (``x`` with a constant 1
appended, ``s`` = ±1) is minimised by Newton steps of exact length: the training rows are packed once into sparse
blocks that stay on the executors, and every step asks them for the gradient and the generalised Hessian in one job and for slopes along
the step in two or three, summed by ``treeAggregate``.  A step is thus a few jobs, whatever the condition of the Hessian. The
driver solves for the step; it holds a matrix of ``features + 1`` rows and columns, which the vocabulary bounds (32 MB for 2,000
words).  Beyond ``MATRIX_FEATURES`` there is no matrix: steps come from products of the Hessian with a vector (conjugate gradients).  Rows without a feature vector are left out of the training and get
the decision of the intercept.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Features up to which the Hessian is a matrix.
MATRIX_FEATURES = 2_500
#: Rows that are spread out for a part of the Hessian at once.
HESSIAN_ROWS = 1_024

_PACKED = "klass binary, row binary, feature binary, value binary"


def _entries(features_col: str) -> tuple[Column, Column, Column]:
    """Number of features, indices and values of a vector column, dense vectors included."""
    vector = F.unwrap_udt(features_col)
    values = vector["values"]
    every = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(vector["size"], F.size(values)), F.coalesce(vector["indices"], every), values


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each Arrow batch of ``klass, feature[], value[]`` as one row of four number arrays."""
    for batch in batches:
        if not batch.num_rows:
            continue
        klass, feature, value = batch.columns
        row = np.repeat(np.arange(batch.num_rows, dtype="int32"), pc.list_value_length(feature).to_numpy(zero_copy_only=False))
        parts = (klass.to_numpy(zero_copy_only=False).astype("int32"), row,
                 feature.flatten().to_numpy(zero_copy_only=False).astype("int32"),
                 value.flatten().to_numpy(zero_copy_only=False).astype("float64"))
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["klass", "row", "feature", "value"])


@dataclass
class Block:
    """Training rows of one Arrow batch as coordinate lists."""

    klass: np.ndarray
    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        """``x·w`` for each row, the last weight being the intercept."""
        return np.bincount(self.row, weights=self.value * w[self.feature], minlength=len(self.klass)) + w[-1]

    def back(self, per_row: np.ndarray, size: int) -> np.ndarray:
        """``Σ per_row·x`` over the rows."""
        out = np.empty(size)
        out[:-1] = np.bincount(self.feature, weights=self.value * per_row[self.row], minlength=size - 1)
        out[-1] = per_row.sum()
        return out

    def gradient(self, w: np.ndarray, positive: int) -> np.ndarray:
        """Gradient of the summed squared hinge."""
        sign = np.where(self.klass == positive, 1.0, -1.0)
        return self.back(-2.0 * sign * np.maximum(1.0 - sign * self.times(w), 0.0), len(w))

    def along(self, w: np.ndarray, s: np.ndarray, ts: np.ndarray, positive: int) -> np.ndarray:
        """Derivative of the summed squared hinge at ``w + t·s`` in the direction ``s``, for each ``t``."""
        sign = np.where(self.klass == positive, 1.0, -1.0)
        here, slope = sign * self.times(w), sign * self.times(s)
        return np.array([-2.0 * slope @ np.maximum(1.0 - here - t * slope, 0.0) for t in ts])

    def curvature(self, w: np.ndarray, v: np.ndarray, positive: int) -> np.ndarray:
        """Generalised Hessian of the summed squared hinge at ``w`` times ``v``."""
        sign = np.where(self.klass == positive, 1.0, -1.0)
        return self.back(np.where(sign * self.times(w) < 1.0, 2.0 * self.times(v), 0.0), len(w))

    def hessian(self, w: np.ndarray, positive: int, total: np.ndarray) -> None:
        """Adds to ``total`` the gradient of the summed squared hinge (first row) and its generalised Hessian (the others)."""
        size = len(w)
        total[0] += self.gradient(w, positive)
        sign = np.where(self.klass == positive, 1.0, -1.0)
        active = sign * self.times(w) < 1.0
        ends = np.cumsum(np.bincount(self.row, minlength=len(self.klass)))  # entries stand in the order of rows
        for s in range(0, len(self.klass), HESSIAN_ROWS):
            e = min(s + HESSIAN_ROWS, len(self.klass))
            low, high = (ends[s - 1] if s else 0), ends[e - 1]
            x = np.zeros((e - s, size))
            np.add.at(x, (self.row[low:high] - s, self.feature[low:high]), self.value[low:high])
            x[:, -1] = 1.0
            x = x[active[s:e]]
            total[1:] += 2.0 * (x.T @ x)


def _unpack(r) -> Block:
    return Block(np.frombuffer(r["klass"], "int32"), np.frombuffer(r["row"], "int32"),
                 np.frombuffer(r["feature"], "int32"), np.frombuffer(r["value"], "float64"))


def _total(blocks: RDD, size: int, part: Callable[[Block], np.ndarray]) -> np.ndarray:
    return blocks.treeAggregate(np.zeros(size), lambda acc, block: acc + part(block), lambda a, b: a + b)


def _newton(blocks: RDD, w: np.ndarray, positive: int) -> np.ndarray:
    """Gradient (first row) and generalised Hessian (the others) of the summed squared hinge: one job, half a matrix a task, two tasks a core at most."""
    size = len(w)

    def of_part(part: Iterator[Block]) -> Iterator[np.ndarray]:
        total = np.zeros((size + 1, size))
        for block in part:
            block.hessian(w, positive, total)
        yield np.concatenate([total[0], *(total[i + 1, i:] for i in range(size))])  # symmetric

    found = blocks.coalesce(2 * max(1, blocks.context.defaultParallelism)).mapPartitions(of_part).treeReduce(lambda a, b: a + b)
    out, at = np.empty((size + 1, size)), size
    out[0] = found[:size]
    for i in range(size):
        out[i + 1, i:] = found[at:at + size - i]
        out[i + 1:, i] = found[at:at + size - i]
        at += size - i
    return out


def _direction(gradient: np.ndarray, hessian: Callable[[np.ndarray], np.ndarray], enough: float) -> np.ndarray:
    """Newton direction by conjugate gradients, up to a residual of ``enough``."""
    s, r = np.zeros_like(gradient), -gradient
    p, rr = r, r @ r
    for _ in range(len(gradient)):
        hp = hessian(p)
        alpha = rr / (p @ hp)  # the penalty keeps the curvature at 1 or more
        s, r = s + alpha * p, r - alpha * hp
        left = r @ r
        if left <= enough * enough:
            break
        p, rr = r + p * (left / rr), left
    return s


def _length(slopes: Callable[[np.ndarray], np.ndarray]) -> float:
    """The root of a rising, piecewise linear function that is negative at 0: a bracket, cut twice into 32, then linear."""
    low, high = 0.0, 2.0
    for _ in range(2):
        ts = np.linspace(low, high, 33)
        found = slopes(ts)
        while found[-1] < 0:
            low, high = high, 2.0 * high
            ts = np.linspace(low, high, 33)
            found = slopes(ts)
        k = max(1, int(np.argmax(found >= 0)))
        low, high = float(ts[k - 1]), float(ts[k])
    return float(low + (high - low) * min(1.0, max(0.0, -found[k - 1] / max(found[k] - found[k - 1], 1e-300))))


def minimise(blocks: RDD, size: int, positive: int, c: float = 1.0, tol: float = 1e-9, max_iter: int = 200) -> np.ndarray:
    """Weights (intercept last) of the separator of class ``positive`` from the others.

    Ends when the gradient has shrunk by ``tol`` against the start, or when a step no longer moves the weights.
    """
    w = np.zeros(size)
    start = 0.0
    for _ in range(max_iter):
        matrix = _newton(blocks, w, positive) if size <= MATRIX_FEATURES + 1 else None
        gradient = w + c * (_total(blocks, size, lambda block, w=w: block.gradient(w, positive)) if matrix is None else matrix[0])
        norm = float(np.linalg.norm(gradient))
        start = start or norm
        if norm <= tol * start:
            return w
        if matrix is None:
            s = _direction(gradient, lambda v, w=w: v + c * _total(blocks, size, lambda block: block.curvature(w, v, positive)),
                           norm * min(0.1, norm / start))
        else:
            s = np.linalg.solve(np.eye(size) + c * matrix[1:], -gradient)  # the penalty makes it positive definite
        t = _length(lambda ts, w=w, s=s: w @ s + ts * (s @ s) + c * _total(blocks, len(ts), lambda block: block.along(w, s, ts, positive)))
        if t * np.linalg.norm(s) <= 1e-14 * np.linalg.norm(w):
            return w
        w = w + t * s
    warnings.warn(f"linear SVM not converged after {max_iter} steps", stacklevel=2)
    return w


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # one row for each separator (two labels: that of the second), intercept last

    def predict(self, rows: DataFrame, features_col: str = "features", keep: Sequence[str] = ("row_id", "label")) -> DataFrame:
        """``keep…, predicted``: the label of the largest decision (ties: the first label)."""
        ship_package(rows.sparkSession)
        weights = self.weights

        @F.pandas_udf("int")
        def place(feature: pd.Series, value: pd.Series) -> pd.Series:
            counts = [0 if x is None else len(x) for x in feature]
            idx = np.concatenate([np.asarray(x, dtype="int64") for x in feature if x is not None] or [np.empty(0, "int64")])
            val = np.concatenate([np.asarray(x, dtype="float64") for x in value if x is not None] or [np.empty(0)])
            block = Block(np.zeros(len(counts), "int32"), np.repeat(np.arange(len(counts)), counts), idx, val)
            scores = np.stack([block.times(w) for w in weights])
            return pd.Series(np.where(scores[0] > 0, 1, 0) if len(scores) == 1 else scores.argmax(axis=0))

        _, feature, value = _entries(features_col)
        names = F.array(*[F.lit(x) for x in self.labels])
        return rows.select(*keep, F.element_at(names, place(feature, value) + 1).alias("predicted"))


def fit(train: DataFrame, labels: Sequence[str], features_col: str = "features", label_col: str = "label",
        c: float = 1.0, tol: float = 1e-9) -> Model:
    """Separators over ``labels``: one for two labels, else one against the rest for each.

    Rows with other labels, null ones included, are left out.  Fewer than two labels or no training rows: ``ValueError``.
    """
    labels = list(labels)
    if len(labels) < 2:
        raise ValueError("a linear SVM needs at least two labels")
    ship_package(train.sparkSession)
    n_features, feature, value = _entries(features_col)
    known = train.where(F.col(label_col).isin(labels) & F.col(features_col).isNotNull())
    size = known.agg(F.max(n_features).alias("n")).first()["n"]
    if size is None:
        raise ValueError("a linear SVM needs training rows")
    klass = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label_col)).cast("int") - 1
    packed = known.select(klass.alias("klass"), feature.alias("feature"), value.alias("value")).mapInArrow(_pack, _PACKED)
    blocks = packed.rdd.map(_unpack).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        positives = [1] if len(labels) == 2 else range(len(labels))
        return Model(labels, np.stack([minimise(blocks, int(size) + 1, k, c, tol) for k in positives]))
    finally:
        blocks.unpersist()
