"""Neighbour and chained imputation against brute force on odd tables."""

import random

import numpy as np
import pytest

from tablewright.operators import chained, impute, neighbours


def knn(rows, k):
    """Filled rows by looking at all donors, in the documented order."""
    p = len(rows[0])
    means = [np.mean([r[c] for r in rows if r[c] is not None]) if any(r[c] is not None for r in rows) else None for c in range(p)]
    out = []
    for q in rows:
        filled = list(q)
        for t in range(p):
            if q[t] is not None:
                continue
            found = []
            for d in rows:
                shared = [c for c in range(p) if q[c] is not None and d[c] is not None]
                if d[t] is not None and shared:
                    total = 0.0
                    for c in shared:
                        total += (q[c] - d[c]) * (q[c] - d[c])
                    found.append(((p / len(shared)) * total, d[t]))
            best = sorted(found)[:k]
            filled[t] = sum(v for _, v in best) / len(best) if best else means[t]
        out.append(filled)
    return out


def table_of(rnd, n, discrete):
    def value(c):
        if rnd.random() < (0.25, 0.1, 0.4, 0.0)[c]:
            return None
        return float(rnd.randrange(6)) if discrete else rnd.choice([rnd.gauss(0, 1), rnd.gauss(50, 3)])
    return [tuple(value(c) for c in range(4)) for _ in range(n)]


@pytest.mark.parametrize("discrete", [True, False])
def test_neighbours_are_exact(spark, monkeypatch, discrete):
    rnd = random.Random(7)
    rows = table_of(rnd, 400, discrete) + [(None, None, None, 0.0), (None, None, None, 1e9)]
    want = [tuple(r) for r in knn(rows, 5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double, `c.d` double, n double").repartition(3)
    for ball, block, asking in ((2048, 8192, 50_000), (20, 7, 30)):
        monkeypatch.setattr(neighbours, "BALL_ROWS", ball)
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
        monkeypatch.setattr(neighbours, "ASKING_ROWS", asking)
        fitted = impute.fit_neighbours(df, ["a", "b", "c.d", "n"])
        assert fitted.tree.balls > 1 or ball > 20
        got = {r["id"]: tuple(r)[1:] for r in fitted.transform(df).collect()}
        assert all(np.allclose(got[i], w, rtol=1e-9, atol=1e-9) for i, w in enumerate(want))


def test_neighbours_of_odd_tables(spark):
    schema = "id int, a double, b double, key string"
    empty = spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(1, None, 2.0, "x"), (2, None, None, None), (3, None, 4.0, "y"), (3, float("nan"), 4.0, "y")], schema)
    fitted = impute.fit_neighbours(rows, ["a", "b"])
    got = sorted((r.id, r.a, r.b, r.key or "") for r in fitted.transform(rows).collect())
    assert got == [(1, None, 2.0, "x"), (2, None, 10 / 3, ""), (3, None, 4.0, "y"), (3, None, 4.0, "y")]
    assert fitted.transform(empty).count() == 0
    none = impute.fit_neighbours(empty, ["a", "b"])
    assert sorted(r.id for r in none.transform(rows).collect()) == [1, 2, 3, 3]


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5))
    x[rng.random(x.shape) < 0.3] = np.nan
    tree = neighbours.grow(x[:200], 12)
    place = tree.places(x)
    assert 4 <= tree.balls <= 12 and len(np.unique(place)) > 3 and place.max() < tree.balls
    low, high = np.full((tree.balls, 5), np.inf), np.full((tree.balls, 5), -np.inf)
    known, size = np.zeros((tree.balls, 5), int), np.bincount(place, minlength=tree.balls)
    for b in range(tree.balls):
        part = x[place == b]
        known[b] = (~np.isnan(part)).sum(0)
        for c in range(5):
            if known[b, c]:
                low[b, c], high[b, c] = np.nanmin(part[:, c]), np.nanmax(part[:, c])
    bound = neighbours.Balls(low, high, known, size).bounds(x[:80])
    for i in range(80):
        both = ~np.isnan(x[i]) & ~np.isnan(x)
        with np.errstate(invalid="ignore", divide="ignore"):
            d = np.where(both.any(1), 5 * np.where(both, (x[i] - x) ** 2, 0).sum(1) / both.sum(1), np.inf)
        for b in range(tree.balls):
            inside = d[place == b]
            assert not len(inside) or bound[i, b] <= inside.min() * (1 + 1e-12)


def chained_brute(x, rounds=10, ridge=1e-6, tolerance=1e-3):
    """Round after round on whole arrays."""
    known = ~np.isnan(x)
    start, scale = np.nanmean(x, 0), np.nanstd(x, 0)
    z = np.where(known, (x - start) / scale, 0.0)
    gaps = sorted((c for c in range(x.shape[1]) if not known[:, c].all()), key=lambda c: (~known[:, c]).sum())
    last = {}
    for _ in range(rounds):
        moved = 0.0
        for t in gaps:
            at = [c for c in range(x.shape[1]) if c != t]
            a, y = z[known[:, t]][:, at], z[known[:, t], t]
            g = a - a.mean(0)
            beta = np.linalg.solve(g.T @ g + ridge * np.eye(len(at)), g.T @ (y - y.mean()))
            alpha = y.mean() - beta @ a.mean(0)
            z[~known[:, t], t] = alpha + z[~known[:, t]][:, at] @ beta
            now = np.array([alpha, *beta])
            moved = max(moved, np.abs(now - last[t]).max() if t in last else 1.0)
            last[t] = now
        if moved < tolerance:
            break
    return z * scale + start


def test_chained_equals_whole_arrays(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5)) * [1, 10, 100, 1, 5] + [0, 3, 500, -2, 9]
    x[rng.random(x.shape) < [0.1, 0.3, 0.2, 0.0, 0.05]] = np.nan
    want = chained_brute(x)
    names = ["a", "b", "c.d", "e", "f"]
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)],
                               "id int, a double, b double, `c.d` double, e double, f double").repartition(4)
    for numbers, patterns in ((4_000_000, 2000), (0, 3)):
        monkeypatch.setattr(chained, "DRIVER_NUMBERS", numbers)
        monkeypatch.setattr(chained, "TASK_PATTERNS", patterns)
        fitted = impute.fit_chained(df, names)
        assert len({s[0] for s in fitted.steps}) == 4
        got = {r["id"]: [r[c] for c in names] for r in fitted.transform(df).collect()}
        assert np.allclose([got[i] for i in range(len(x))], want, rtol=1e-6, atol=1e-6)


def test_chained_of_odd_tables(spark):
    schema = "id int, a double, b double, key string"
    rows = spark.createDataFrame([(1, 1.0, None, "x"), (2, None, None, None), (3, 3.0, None, "y")], schema)
    fitted = impute.fit_chained(rows, ["a", "b"])
    assert sorted((r.id, round(r.a, 6), r.b) for r in fitted.transform(rows).collect()) == [(1, 1.0, 0.0), (2, 2.0, 0.0), (3, 3.0, 0.0)]
    empty = spark.createDataFrame([], schema)
    assert impute.fit_chained(empty, ["a", "b"]).transform(rows).where("id = 2").first().a == 0.0
