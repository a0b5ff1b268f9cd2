"""Exact Shapley attributions of boosted trees, on margins, one set for each class.

A leaf answers ``value`` times one factor for each feature on its path: 1 or 0 for a known feature
(does the row keep to the path?), the share of rows that keep to it for an unknown one. The Shapley
value of such a product is the integral over t in 0..1 of the other factors, each mixed as
``t * known + (1 - t) * share``, times ``known - share``. The integrand is a polynomial, so Gauss
points give it exactly: the cost of a leaf is features by points, no subsets are listed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tablewright.operators.boosting import BoostedModel, Trees

#: Rows worked on at a time; a leaf needs this many times features on its path times points.
ROWS_AT_ONCE = 1024


@dataclass(frozen=True)
class _Path:
    """A leaf: its features, the share of rows that keep to the path at each, and the path's splits."""

    value: float
    features: np.ndarray
    shares: np.ndarray
    splits: tuple[tuple[int, bool, int], ...]       # inner node, goes left, place of its feature


def leaf_paths(trees: Trees, root: int) -> list[_Path]:
    """All leaves of one tree. A node that no row reached sends half of them each way."""
    out, open_ = [], [(root, ())]
    while open_:
        node, taken = open_.pop()
        if trees.feature[node] >= 0:
            sides = int(trees.left[node]), int(trees.right[node])
            weights = trees.weight[list(sides)]
            share = weights / weights.sum() if weights.sum() > 0 else np.array([0.5, 0.5])
            open_ += [(side, (*taken, (node, i == 0, float(share[i])))) for i, side in enumerate(sides)]
            continue
        features = sorted({int(trees.feature[n]) for n, _, _ in taken})
        shares = np.ones(len(features))
        splits = []
        for n, goes_left, share in taken:
            place = features.index(int(trees.feature[n]))
            shares[place] *= share
            splits.append((n, goes_left, place))
        out.append(_Path(float(trees.value[node]), np.array(features, np.int64), shares, tuple(splits)))
    return out


def goes_left(trees: Trees, node: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether values (broadcast against nodes) go left; NaN goes where the split sends missing values."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isnan(x), trees.missing_left[node], x <= trees.cut[node])


def _others(factors: np.ndarray) -> np.ndarray:
    """For each entry of the first axis the product of all other entries; factors may be zero."""
    one = np.ones_like(factors[:1])
    before = np.cumprod(np.concatenate([one, factors[:-1]]), axis=0)
    after = np.cumprod(np.concatenate([one, factors[:0:-1]]), axis=0)[::-1]
    return before * after


def contributions(trees: Trees, outputs: int, x: np.ndarray) -> np.ndarray:
    """(rows, outputs, features): each feature's part of the margin beyond the expected one."""
    out = np.zeros((len(x), outputs, x.shape[1]))
    for root, kind in zip(trees.root.tolist(), trees.kind.tolist()):
        paths = [p for p in leaf_paths(trees, root) if p.value and len(p.features)]
        inner = np.unique([n for p in paths for n, _, _ in p.splits]).astype(np.int64)
        row_of = {n: i for i, n in enumerate(inner.tolist())}
        for start in range(0, len(x), ROWS_AT_ONCE):
            part = x[start:start + ROWS_AT_ONCE]
            left = goes_left(trees, inner[:, None], part.T[trees.feature[inner]])
            for p in paths:
                known = np.ones((len(p.features), len(part)), bool)
                for node, side, place in p.splits:
                    known[place] &= left[row_of[node]] == side
                at, weight = np.polynomial.legendre.leggauss(-(-len(p.features) // 2))
                at, weight = ((at + 1) / 2)[None, :, None], weight / 2
                mixed = at * known[:, None] + (1 - at) * p.shares[:, None, None]
                integral = np.einsum("q,dqn->dn", weight, _others(mixed))
                out[start:start + len(part), kind, p.features] += (p.value * (known - p.shares[:, None]) * integral).T
    return out


def expected_margins(model: BoostedModel) -> np.ndarray:
    """The margin of each class when no feature is known; attributions add up to the rest."""
    out = np.array(model.base, float)
    for root, kind in zip(model.trees.root.tolist(), model.trees.kind.tolist()):
        out[kind] += sum(p.value * p.shares.prod() for p in leaf_paths(model.trees, root))
    return out


def with_background(model: BoostedModel, df: DataFrame) -> BoostedModel:
    """The model with the rows of ``df`` (its ``features``) as what an unknown feature is averaged over.

    A fitted model averages over the rows it was trained on. Each task counts rows by node; one
    shuffle adds the counts, and a count for each node of the model comes back. Rows of NULL
    features do not count; of an empty table all nodes count nothing.
    """
    trees = model.trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(trees.feature), np.int64)
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(batch.num_rows, -1)
            for root in trees.root.tolist():
                node, rows = np.full(len(x), root), np.arange(len(x))
                while len(rows):
                    count += np.bincount(node, minlength=len(count))
                    on = trees.feature[node] >= 0
                    node, rows = node[on], rows[on]
                    node = np.where(goes_left(trees, node, x[rows, trees.feature[node]]), trees.left[node], trees.right[node])
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"node": pa.array(seen, pa.int64()), "n": pa.array(count[seen], pa.int64())})

    rows = df.where("features IS NOT NULL").select(vector_to_array("features").alias("x"))
    found = rows.mapInArrow(run, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n")).collect()
    weight = np.zeros(len(trees.feature))
    for r in found:
        weight[r["node"]] = r["n"]
    return replace(model, trees=replace(trees, weight=weight))


def tree_attributions(df: DataFrame, key: Sequence[str], model: BoostedModel, names: Sequence[str]) -> DataFrame:
    """(key, output, feature, contribution) for every row, class margin and feature.

    ``output`` is 0 for a number or two classes (the margin of class 1), else the class. For each
    row and output the contributions sum to the margin less ``expected_margins``. Rows of NULL
    features have no attributions; repeated keys keep theirs; other columns are not read. The
    rows are never shuffled.
    """
    if len(names) != model.n_features:
        raise ValueError(f"{model.n_features} features, {len(names)} names")
    trees, outputs, width = model.trees, len(model.base), model.n_features

    @pandas_udf("array<array<double>>")
    def parts(features: pd.Series) -> pd.Series:
        x = np.array(features.tolist(), float).reshape(len(features), -1)
        if len(x) and x.shape[1] != width:
            raise ValueError(f"{width} features expected, {x.shape[1]} given")
        return pd.Series([list(c) for c in contributions(trees, outputs, x)] if len(x) else [], dtype=object)

    labels = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    there = df.where("features IS NOT NULL")
    by_output = there.select(*key, F.posexplode(parts(vector_to_array("features"))).alias("output", "_c"))
    cells = F.arrays_zip(labels.alias("feature"), F.col("_c").alias("contribution"))
    return by_output.select(*key, "output", F.inline(cells).alias("feature", "contribution"))
