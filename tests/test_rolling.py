"""Rolling metrics against a plain loop: every window size, NULLs, clashing names, empty tables."""

import math
import random

import pytest

from tablewright.operators.performance import rolling_metrics

SCHEMA = "_block string, at int, id int, y_true double, y_pred double"


def brute(rows, n):
    out = {}
    for model in {r[0] for r in rows}:
        errors = [(r[2], None if r[3] is None or r[4] is None else r[3] - r[4])
                  for r in sorted((r for r in rows if r[0] == model), key=lambda r: (r[1], r[2]))]
        for i, (key, _) in enumerate(errors):
            held = [e for _, e in errors[max(0, i - n + 1):i + 1] if e is not None]
            out[key] = (sum(map(abs, held)) / len(held), math.sqrt(sum(e * e for e in held) / len(held)), len(held)) if held else (None, None, 0)
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_windows(spark, n):
    """A partition column named like one of the operator's own, and one that is NULL."""
    random.seed(n)
    maybe = lambda v: None if random.random() < 0.2 else v
    rows = [(random.choice(["a", "a", "a", "b", None]), random.randint(0, 40), i, maybe(random.uniform(-1e6, 1e6)), maybe(random.random())) for i in range(300)]
    found = rolling_metrics(spark.createDataFrame(rows, SCHEMA).repartition(4), ["_block"], "at", "id", n).collect()
    want = brute(rows, n)
    assert len(found) == len(rows) and {(r["_block"], r["id"], r["at"]) for r in found} == {(r[0], r[2], r[1]) for r in rows}
    for r in found:
        assert r["window_rows"] == want[r["id"]][2]
        assert r["mae"] == (want[r["id"]][0] if want[r["id"]][0] is None else pytest.approx(want[r["id"]][0]))
        assert r["rmse"] == (want[r["id"]][1] if want[r["id"]][1] is None else pytest.approx(want[r["id"]][1]))


def test_a_large_error_leaves_with_its_window(spark):
    """Differences of running totals would keep rounding errors of 1e18 for ever."""
    rows = [("a", i, i, 1e18 if i == 3 else 0.125, 0.0) for i in range(50)]
    found = {r["id"]: r["mae"] for r in rolling_metrics(spark.createDataFrame(rows, SCHEMA), ["_block"], "at", "id", 5).collect()}
    assert all(found[i] == 0.125 for i in range(8, 50))


def test_empty_and_without_partition(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rolling_metrics(df, ["_block"], "at", "id", 5).count() == 0
    rows = [("x", i, i, float(i), 0.0) for i in range(20)]
    found = {r["id"]: r["mae"] for r in rolling_metrics(spark.createDataFrame(rows, SCHEMA), [], "at", "id", 4).collect()}
    assert found[19] == 17.5 and found[0] == 0.0
