"""Histogram boosting: splits against brute force, objectives, limits, patience and storage."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.catalog import models as catalog
from tablewright.operators import boosting, models
from tablewright.operators.boosting import BoostOptions, HistogramBooster
from tablewright.session import scratch_path
from tablewright.sources.stored_plans import load_plan, save_plan


def frame(spark, x, y, held=None, parts=3):
    rows = [(i, [float(v) for v in r], None if t is None else float(t), bool(held[i]) if held is not None else False) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, x array<double>, label double, held boolean").repartition(parts)
    return df.select("id", array_to_vector("x").alias("features"), "label", "held").cache()


def brute_tree(x, g, h, depth, l2, min_gain=0.0):
    """Predictions of one exact tree of the given depth on the training rows."""
    if depth:
        whole = g.sum() ** 2 / (h.sum() + l2)
        best = (0.0, None)
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                gain = 0.5 * (g[left].sum() ** 2 / (h[left].sum() + l2) + g[~left].sum() ** 2 / (h[~left].sum() + l2) - whole) - min_gain
                if gain > best[0] + 1e-12:
                    best = (gain, left)
        if best[1] is not None:
            out = np.empty(len(g))
            for part in (best[1], ~best[1]):
                out[part] = brute_tree(x[part], g[part], h[part], depth - 1, l2, min_gain)
            return out
    return np.full(len(g), -g.sum() / (h.sum() + l2))


def predicted(model, df, column="prediction"):
    return np.array([r[0] for r in model.transform(df).orderBy("id").select(column).collect()])


def test_trees_equal_exact_ones(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = x[:, 0] * 2 - (x[:, 1] > 5) * x[:, 2] + rng.normal(size=300)
    model = HistogramBooster("regression", BoostOptions(trees=3, rate=0.5, depth=3, l2=1.0)).fit(frame(spark, x, y))
    margin = np.full(300, y.mean())
    for _ in range(3):
        margin += 0.5 * brute_tree(x, margin - y, np.ones(300), 3, 1.0)
    assert np.allclose(predicted(model, frame(spark, x, y)), margin)
    assert model.featureImportances.toArray().sum() == pytest.approx(1.0)


def test_classes(spark, monkeypatch):
    monkeypatch.setattr(boosting, "WRITE_ROUNDS", 4)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    x[rng.random(x.shape) < 0.1] = np.nan
    z = np.nan_to_num(x, nan=2.0)
    for n_classes, y in ((2, (z[:, 0] + z[:, 1] ** 2 > 1)), (3, np.digitize(z[:, 0] + z[:, 1], [-0.5, 0.8]))):
        df = frame(spark, x, y.astype(float))
        model = HistogramBooster("classification", BoostOptions(trees=15, rate=0.3, depth=3), n_classes).fit(df)
        rows = models.scored_rows(model, df, "classification", n_classes, ["id"]).orderBy("id").collect()
        p = np.array([[r[f"p{c}"] for c in range(n_classes)] for r in rows])
        assert np.allclose(p.sum(1), 1) and (p.argmax(1) == [r.y_pred for r in rows]).all()
        assert (p.argmax(1) == y).mean() > 0.93
        root = scratch_path(spark, "plans")
        save_plan(spark, model, root, "m")
        assert np.array_equal(predicted(load_plan(spark, root, "m"), df), predicted(model, df))


@pytest.mark.parametrize("options", [BoostOptions(trees=3, depth=0, leaves=7), BoostOptions(trees=3, depth=4, symmetric=True),
                                     BoostOptions(trees=3, depth=2, row_share=0.5, column_share=0.5, l1=0.5, min_rows=30)])
def test_limits_of_trees(spark, options):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    y = np.sin(3 * x[:, 0]) + x[:, 1] * x[:, 2]
    model = HistogramBooster("regression", options).fit(frame(spark, x, y))
    t = model.trees
    ends = [*t.root.tolist()[1:], len(t.feature)]
    for a, b in zip(t.root.tolist(), ends):
        leaves = int((t.feature[a:b] < 0).sum())
        assert leaves <= (options.leaves or 1 << options.depth)
        if options.leaves:
            assert leaves == options.leaves
        if options.symmetric:
            level, used = [a], []
            while level:
                split = {(int(t.feature[n]), float(t.cut[n])) for n in level if t.feature[n] >= 0}
                assert len(split) <= 1
                level = [c for n in level if t.feature[n] >= 0 for c in (t.left[n], t.right[n])]
                used += split
            assert len(used) == options.depth
        if options.min_rows > 1:
            assert t.weight[a + 1:b].min() >= options.min_rows
        if options.column_share < 1:
            assert len(set(t.feature[a:b]) - {-1}) <= 2
    assert np.array_equal(predicted(model, frame(spark, x, y, parts=1)), predicted(HistogramBooster("regression", options).fit(frame(spark, x, y)), frame(spark, x, y, parts=1))) or options.row_share < 1


def test_patience(spark):
    """Noise stops early and is cut to its best round; a steady signal must not stop."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    held = np.arange(400) % 4 == 0
    noise = rng.normal(size=400)
    o = BoostOptions(trees=60, rate=0.3, depth=3, patience=5)
    model = HistogramBooster("regression", o, validation="held").fit(frame(spark, x, noise, held))
    assert len(model.curve) < 60 and model.n_rounds == model.best_round == int(np.argmin(model.curve)) + 1
    assert len(model.curve) == model.best_round + 5
    steady = HistogramBooster("regression", BoostOptions(trees=25, rate=0.05, depth=3, patience=5), validation="held").fit(frame(spark, x, 5 * x[:, 0], held))
    assert len(steady.curve) == 25 == steady.n_rounds
    want = [np.mean((steady.cut_to(k).trees.margins(x[held], steady.base)[:, 0] - 5 * x[held, 0]) ** 2) for k in (1, 13, 25)]
    assert np.allclose(want, [steady.curve[k - 1] for k in (1, 13, 25)])


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "id int, x array<double>, label double, held boolean").select("id", array_to_vector("x").alias("features"), "label", "held")
    assert HistogramBooster("regression", BoostOptions(trees=2)).fit(empty).base.tolist() == [0.0]
    x = np.array([[1.0, np.nan]] * 6)
    model = HistogramBooster("regression", BoostOptions(trees=2)).fit(frame(spark, x, [1, 2, 3, None, 1, 2]))
    assert np.allclose(predicted(model, frame(spark, x, [0.0] * 6)), 9 / 5)


def test_a_walk_by_places_among_cuts_is_the_plain_walk():
    rng = np.random.default_rng(6)
    nodes, root = [], []
    for _ in range(4):
        at = len(nodes)
        root.append(at)
        for i in range(3):
            nodes.append((int(rng.integers(3)), float(rng.choice([-1.0, 0.0, 0.5, 2.0, np.inf])), bool(rng.integers(2)), at + 2 * i + 1, at + 2 * i + 2, 0.0, 0.0))
        nodes += [(-1, 0.0, True, -1, -1, float(rng.normal()), 0.0) for _ in range(4)]
    kinds = (np.int64, float, bool, np.int64, np.int64, float, float)
    t = boosting.Trees(*[np.array(v, k) for v, k in zip(zip(*nodes), kinds)], np.array(root), np.array([0, 1, 0, 1]))
    x = rng.choice([np.nan, -np.inf, -1.0, -0.0, 0.25, 0.5, 2.0, 3.0, np.inf], (200, 4))

    def plain(kept):
        out = np.tile([0.5, -0.5], (len(x), 1))
        for r, row in enumerate(x):
            for a, k in zip(root[:kept], (0, 1, 0, 1)):
                while t.feature[a] >= 0:
                    v = row[t.feature[a]]
                    a = t.left[a] if (t.missing_left[a] if np.isnan(v) else v <= t.cut[a]) else t.right[a]
                out[r, k] += t.value[a]
        return out

    for kept in (4, 2, 0):
        cut = boosting.replace(t, root=t.root[:kept], kind=t.kind[:kept])
        assert np.array_equal(cut.margins(x, np.array([0.5, -0.5])), plain(kept))


def test_one_task_and_many_grow_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 64)
    monkeypatch.setattr(boosting, "WORK_ROWS", 100)
    monkeypatch.setattr(boosting, "WRITE_ROUNDS", 3)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 5))
    x[rng.random(x.shape) < 0.1] = np.nan
    y = np.digitize(np.nan_to_num(x[:, 0]) + np.nan_to_num(x[:, 1], nan=1.0), [-0.5, 0.8])
    df = frame(spark, x, [None if i == 5 else t for i, t in enumerate(y)], np.arange(600) % 4 == 0)
    made, plain = [], boosting._Blocks.__init__
    monkeypatch.setattr(boosting._Blocks, "__init__", lambda self, *a: made.append(1) or plain(self, *a))
    o = BoostOptions(trees=8, rate=0.3, depth=3, row_share=0.8, column_share=0.8, min_hessian=1.0, patience=3)
    models_ = []
    for blocks, sums in ((16, 64 << 20), (0, 64 << 20), (0, 0)):          # in one task, summed by the driver, summed in a shuffle
        monkeypatch.setattr(boosting, "NEAR_BLOCKS", blocks)
        monkeypatch.setattr(boosting, "SUM_BYTES", sums)
        models_.append(HistogramBooster("classification", o, 3, "held").fit(df))
    near, *far = models_
    assert len(made) == 2 and len(near.curve) > 3
    for m in far:
        assert np.array_equal(m.trees.feature, near.trees.feature) and np.array_equal(m.trees.cut, near.trees.cut)
        assert np.allclose(m.trees.value, near.trees.value) and np.allclose(m.curve, near.curve) and m.best_round == near.best_round


def test_the_multiclass_query_runs_its_preset_as_defined(spark, monkeypatch):
    """500 rounds at rate 0.05, ended by patience alone, and no fewer, larger steps."""
    rng = np.random.default_rng(8)
    n = 400
    lines, quantity = rng.integers(1, 8, n), rng.integers(1, 200, n).astype(float)
    price = 30000.0 * lines + 100 * quantity
    rows = [(i, int(a), float(b), float(b % 10 / 100), float(p + rng.normal() * 20000), float(p)) for i, (a, b, p) in enumerate(zip(lines, quantity, price))]
    orders = spark.createDataFrame(rows, "o_orderkey int, n_lines int, quantity double, discount double, o_totalprice double, price double")
    monkeypatch.setattr(catalog, "_orders", lambda spark, sf_dir: orders)
    fitted, plain = [], HistogramBooster.fit
    monkeypatch.setattr(HistogramBooster, "fit", lambda self, df: fitted.append(plain(self, df)) or fitted[-1])
    found = catalog.fit_multiclass(spark, "").collect()
    model, = fitted
    assert model.options == boosting.PRESETS["xgboost"] and (model.options.trees, model.options.rate) == (500, 0.05)
    assert len(model.curve) == min(500, model.best_round + 50) > 50
    assert [tuple(r) for r in found] == [("xgboost", True, True, True, True)]
