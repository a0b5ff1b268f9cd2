"""Multilayer perceptron classifier on counted rows.

Equal rows have equal gradients: rows are counted by features and label once, in blocks, and every
evaluation sums the weighted gradient of the blocks in the tasks. The weights start where Spark's
own classifier starts, L-BFGS with a strong Wolfe search runs on the driver (it sees one vector of
weights), and the result is a Spark ML model.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import hold

BLOCK_ROWS = 8_192
_CORRECTIONS, _FVALS = 10, 20
Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


class Perceptron:
    """Estimator: trains what a ``MultilayerPerceptronClassifier`` describes and returns its model."""

    def __init__(self, classifier: MultilayerPerceptronClassifier):
        self.classifier = classifier

    def fit(self, df: DataFrame) -> MultilayerPerceptronClassificationModel:
        layers = self.classifier.getLayers()
        counted = hold(df.groupBy(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label")).agg(
            F.count(F.lit(1)).cast("double").alias("n")))
        wrong = F.col("label").isNull() | (F.col("label") < 0) | (F.col("label") >= layers[-1]) | (F.col("label") != F.floor("label"))
        unknown = F.col("x").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        facts = counted.agg(F.count(F.when(wrong, 1)).alias("wrong"), F.count(F.when(unknown, 1)).alias("unknown"), F.sum("n").alias("n")).first()
        if facts["wrong"] or facts["unknown"] or not facts["n"]:
            raise ValueError(f"rows must have labels 0..{layers[-1] - 1} and finite features")
        blocks = hold(counted.mapInArrow(_blocks, "cells binary"))
        one = df.sparkSession.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], ["features", "label"])
        still = self.classifier.copy({self.classifier.maxIter: 0})
        start = still.fit(one).weights.toArray()
        found = minimise(lambda w: _evaluate(blocks, layers, w, facts["n"]), start, self.classifier.getMaxIter(), self.classifier.getTol())
        blocks.unpersist()
        counted.unpersist()
        return still.copy({still.initialWeights: Vectors.dense(found)}).fit(one)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of features, label and count as matrices."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(a, BLOCK_ROWS)
            x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            cells = np.column_stack([x, part.column(1).to_numpy(), part.column(2).to_numpy()])
            yield pa.RecordBatch.from_pydict({"cells": [cells.tobytes()]})


def gradient(cells: np.ndarray, layers: list[int], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed loss and gradient: sigmoid layers, softmax and cross-entropy on top."""
    x, label, n = cells[:, :-2], cells[:, -2].astype(int), cells[:, -1]
    parts, at = [], 0
    for a, b in zip(layers, layers[1:]):
        parts.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]))
        at += a * b + b
    seen = [x]
    for i, (w, bias) in enumerate(parts):
        z = seen[-1] @ w + bias
        if i < len(parts) - 1:
            with np.errstate(over="ignore"):
                seen.append(1.0 / (1.0 + np.exp(-z)))
    z -= z.max(1, keepdims=True)
    total = np.exp(z).sum(1, keepdims=True)
    rows = np.arange(len(x))
    loss = float((n * (np.log(total[:, 0]) - z[rows, label])).sum())
    delta = np.exp(z) / total
    delta[rows, label] -= 1.0
    delta *= n[:, None]
    out = []
    for i in reversed(range(len(parts))):
        out.append(np.concatenate([(seen[i].T @ delta).ravel(), delta.sum(0)]))
        if i:
            delta = (delta @ parts[i][0].T) * seen[i] * (1.0 - seen[i])
    return loss, np.concatenate(out[::-1])


def _evaluate(blocks: DataFrame, layers: list[int], weights: np.ndarray, n: float) -> tuple[float, np.ndarray]:
    width = layers[0] + 2

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights) + 1)
        for batch in batches:
            for raw in batch.column(0):
                loss, slope = gradient(np.frombuffer(raw.as_buffer()).reshape(-1, width), layers, weights)
                total[0] += loss
                total[1:] += slope
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    # One vector of weights for each task.
    sums = sum(np.frombuffer(bytes(r["sums"])) for r in blocks.mapInArrow(summed, "sums binary").collect()) / n
    return float(sums[0]), sums[1:]


# --- L-BFGS ----------------------------------------------------------------------


class _SearchFailed(Exception):
    pass


@dataclass(frozen=True)
class _Point:
    t: float
    value: float
    slope: float
    x: np.ndarray
    grad: np.ndarray


def minimise(f: Objective, x: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Weights after at most so many rounds; ends where value or gradient no longer change."""
    value, grad = f(x)
    initial, values, failed = value, [value], False
    steps: list[tuple[np.ndarray, np.ndarray]] = []               # (step, change of gradient), newest first
    done = 0
    while done < rounds:
        if len(values) >= 2 and abs(value - max(values)) <= tolerance * abs(initial):
            break
        if np.linalg.norm(grad) <= max(tolerance * abs(value), 1e-8):
            break
        try:
            way = _direction(grad, steps)
            at = _search(f, _Point(0.0, value, float(grad @ way), x, grad), way, 1.0 / np.linalg.norm(way) if done == 0 else 1.0)
            if at.t * np.linalg.norm(grad) < 1e-10:
                raise _SearchFailed
        except _SearchFailed:
            if failed:
                break
            steps, failed = [], True
            continue
        steps = [(at.x - x, at.grad - grad), *steps][:_CORRECTIONS]
        x, value, grad, failed, done = at.x, at.value, at.grad, False, done + 1
        values = [*values, value][-_FVALS:]
    return x


def _direction(grad: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    way, shares = grad.copy(), []
    for s, y in steps:
        shares.append(s @ way / (s @ y))
        way -= shares[-1] * y
    if steps:
        s, y = steps[0]
        if not s @ y >= 0:
            raise _SearchFailed
        way *= (s @ y) / (y @ y)
    for (s, y), share in zip(reversed(steps), reversed(shares)):
        way += (share - y @ way / (s @ y)) * s
    return -way


def _search(f: Objective, start: _Point, way: np.ndarray, t: float, tries: int = 10, least: float = 1e-4, most: float = 0.9) -> _Point:
    """A step that meets the strong Wolfe conditions."""
    if start.slope > 0:
        raise _SearchFailed

    def point(t: float) -> _Point:
        x = start.x + t * way
        value, grad = f(x)
        return _Point(t, value, float(grad @ way), x, grad)

    def zoom(low: _Point, high: _Point) -> _Point:
        for _ in range(tries):
            c = point(_between(*sorted((low, high), key=lambda p: p.t)))
            if c.value > start.value + least * c.t * start.slope or c.value >= low.value:
                high = c
            else:
                if abs(c.slope) <= most * abs(start.slope):
                    return c
                if c.slope * (high.t - low.t) >= 0:
                    high = low
                low = c
        raise _SearchFailed

    low = start
    for i in range(tries):
        c = point(t)
        if not math.isfinite(c.value):
            t /= 2.0
            continue
        if c.value > start.value + least * t * start.slope or (c.value >= low.value and i > 0):
            return zoom(low, c)
        if abs(c.slope) <= most * abs(start.slope):
            return c
        if c.slope >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise _SearchFailed


def _between(a: _Point, b: _Point) -> float:
    """Minimum of the cubic through both points, kept off the ends."""
    d1 = a.slope + b.slope - 3 * (a.value - b.value) / (a.t - b.t)
    square = d1 * d1 - a.slope * b.slope
    d2 = math.sqrt(square) if square >= 0 else math.nan
    down = b.slope - a.slope + 2 * d2
    t = b.t - (b.t - a.t) * (b.slope + d2 - d1) / down if down else math.nan
    return min(max(t, a.t + 0.1 * (b.t - a.t)), a.t + 0.9 * (b.t - a.t)) if math.isfinite(t) else (a.t + b.t) / 2
