"""Tree attributions against all subsets, their sums, backgrounds, and odd rows."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import tree_attributions as ta
from tablewright.operators.boosting import BoostedModel, BoostOptions, HistogramBooster, Trees


def random_model(rng, width, depth, trees, outputs, empty=0.1):
    """Random trees whose weights add up; some sides are empty, features repeat on paths."""
    nodes, roots, kinds = [], [], []

    def grow(level, weight):
        at = len(nodes)
        nodes.append(None)
        if level == 0 or rng.random() < 0.15:
            nodes[at] = (-1, 0.0, True, -1, -1, rng.normal(), weight)
            return at
        part = 0.0 if rng.random() < empty else np.floor(weight * rng.random())
        left, right = grow(level - 1, part), grow(level - 1, weight - part)
        nodes[at] = (int(rng.integers(width)), float(rng.normal()), bool(rng.random() < 0.5), left, right, 0.0, weight)
        return at

    for i in range(trees):
        roots.append(grow(depth, 1000.0))
        kinds.append(i % outputs)
    columns = [np.array(c, t) for c, t in zip(zip(*nodes), (np.int64, float, bool, np.int64, np.int64, float, float))]
    return BoostedModel("regression", width, max(1, outputs), rng.normal(size=outputs), Trees(*columns, np.array(roots), np.array(kinds)), np.zeros(width))


def known_only(t, node, x, known):
    """What a tree answers when only some features are known, by walking it."""
    f = t.feature[node]
    if f < 0:
        return t.value[node]
    left, right = t.left[node], t.right[node]
    if f in known:
        go = t.missing_left[node] if np.isnan(x[f]) else x[f] <= t.cut[node]
        return known_only(t, left if go else right, x, known)
    total = t.weight[left] + t.weight[right]
    share = t.weight[left] / total if total else 0.5
    return share * known_only(t, left, x, known) + (1 - share) * known_only(t, right, x, known)


def brute(model, x):
    t, width = model.trees, model.n_features
    out = np.zeros((len(x), len(model.base), width))
    for r, row in enumerate(x):
        for root, kind in zip(t.root, t.kind):
            worth = {s: known_only(t, root, row, s) for k in range(width + 1) for s in map(frozenset, combinations(range(width), k))}
            for s, v in worth.items():
                for f in set(range(width)) - s:
                    out[r, kind, f] += factorial(len(s)) * factorial(width - len(s) - 1) / factorial(width) * (worth[s | {f}] - v)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equals_all_subsets(seed):
    rng = np.random.default_rng(seed)
    model = random_model(rng, 5, 6, 4, 1 + seed % 3)
    x = rng.normal(size=(12, 5))
    x[rng.random(x.shape) < 0.2] = np.nan
    assert np.allclose(ta.contributions(model.trees, len(model.base), x), brute(model, x), atol=1e-12)


def test_deep_paths_add_up(monkeypatch):
    """Thirty features on a path: no enumeration could check it, the sum can."""
    monkeypatch.setattr(ta, "ROWS_AT_ONCE", 7)
    rng = np.random.default_rng(9)
    n = 30
    feature = np.array([*range(n), *[-1] * (n + 1)])
    left = np.array([*range(n, 2 * n), *[-1] * (n + 1)])
    right = np.array([*range(1, n), 2 * n, *[-1] * (n + 1)])
    weight = np.zeros(2 * n + 1)
    weight[n:] = rng.integers(1, 50, n + 1)
    for i in range(n - 1, -1, -1):
        weight[i] = weight[left[i]] + weight[right[i]]
    trees = Trees(feature, np.full(2 * n + 1, -0.8), np.ones(2 * n + 1, bool), left, right, np.where(feature < 0, rng.normal(size=2 * n + 1), 0), weight, np.array([0]), np.array([0]))
    model = BoostedModel("regression", n, 1, np.array([2.0]), trees, np.zeros(n))
    x = rng.normal(size=(40, n))
    parts = ta.contributions(trees, 1, x)
    assert np.allclose(parts.sum(2) + ta.expected_margins(model), trees.margins(x, model.base))


def test_fitted_classes_and_background(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    x[rng.random(x.shape) < 0.1] = np.nan
    y = np.digitize(np.nan_to_num(x[:, 0]) + np.nan_to_num(x[:, 1]), [-0.5, 0.8])
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, x array<double>, label double").repartition(3).select("id", array_to_vector("x").alias("features"), "label")
    model = HistogramBooster("classification", BoostOptions(trees=6, rate=0.3, depth=3), 3).fit(df)
    found = ta.tree_attributions(df.withColumn("output", F.lit("x")), ["id"], model, ["a", "b", "c"])
    assert found.count() == 400 * 3 * 3
    sums = {(r["id"], r["output"]): r["s"] for r in found.groupBy("id", "output").agg(F.sum("contribution").alias("s")).collect()}
    rest = model.trees.margins(x, model.base) - ta.expected_margins(model)
    assert all(sums[i, k] == pytest.approx(rest[i, k]) for i in range(400) for k in range(3))
    # All rows were trained on, so counting them again changes nothing but the roots.
    again = ta.with_background(model, df)
    inner = np.setdiff1d(np.arange(len(model.trees.weight)), model.trees.root)
    assert np.array_equal(again.trees.weight[inner], model.trees.weight[inner]) and (again.trees.weight[model.trees.root] == 400).all()
    part = ta.with_background(model, df.where("id < 50"))
    want = part.trees.margins(x[:1], model.base)[0] - ta.expected_margins(part)
    assert np.allclose(ta.contributions(part.trees, 3, x[:1]).sum(2)[0], want)
    assert np.allclose(ta.contributions(part.trees, 3, x[:1]), brute(part, x[:1]))


def test_odd_rows(spark):
    model = random_model(np.random.default_rng(3), 2, 2, 2, 1)
    df = spark.createDataFrame([(1, [0.1, 0.2]), (1, [0.1, 0.2]), (None, [float("nan"), 1.0]), (3, None)], "id int, x array<double>").select(
        "id", F.when(F.col("x").isNotNull(), array_to_vector(F.coalesce("x", F.array(F.lit(0.0))))).alias("features"))
    found = ta.tree_attributions(df, ["id"], model, ["a", "b"]).collect()
    assert sorted(str(r["id"]) for r in found) == ["1"] * 4 + ["None"] * 2
    assert ta.tree_attributions(df.where("false"), ["id"], model, ["a", "b"]).count() == 0
    assert not ta.with_background(model, df.where("false")).trees.weight.any()
    with pytest.raises(ValueError):
        ta.tree_attributions(df, ["id"], model, ["a"])
