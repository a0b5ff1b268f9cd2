"""Exact order statistics, cuts and running sums against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions.hashing import seeded_hash
from tablewright.operators import split
from tablewright.operators.order import quantiles, rank_cuts, running_sums, select_ranks
from tablewright.operators.scale import quantile_grid


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=700), np.full(500, 3.25), rng.lognormal(sigma=4, size=300)])
    k = rng.integers(-10**12, 10**12, size=1500)
    rows = [(i, float(a), int(b), None if i % 5 == 0 else float(a)) for i, (a, b) in enumerate(zip(x, k))]
    return x, k, spark.createDataFrame(rows, "id long, x double, k long, gaps double")


def test_quantiles_match_numpy_with_a_value_holding_a_third(numbers):
    x, k, df = numbers
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = quantiles(df, {"x": F.col("x"), "k": F.col("k"), "gaps": F.col("gaps")}, probabilities)
    assert np.allclose(found["x"], np.quantile(x, probabilities))
    assert np.allclose(found["k"], np.quantile(k, probabilities))
    assert np.allclose(found["gaps"], np.quantile([v for i, v in enumerate(x) if i % 5], probabilities))


def test_quantiles_of_nothing_and_of_a_constant(spark):
    df = spark.createDataFrame([(None, 2.0), (None, 2.0)], "a double, b double")
    found = quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.5])
    assert found == {"a": [None], "b": [2.0]}


def test_ranks_carry_the_number_of_smaller_values(numbers):
    x, _, df = numbers
    ordered = np.sort(x)
    for rank, got in select_ranks(df, {"x": F.col("x")}, {"x": [0, 800, 1499]})["x"].items():
        assert got.value == ordered[rank] and got.below == int((x < ordered[rank]).sum())


def test_many_quantiles_by_running_counts(numbers):
    x, k, df = numbers
    grid = quantile_grid(df, ["x", "k"], 200)
    assert np.allclose(grid["x"], np.quantile(x, np.linspace(0, 1, 200)))
    assert np.allclose(grid["k"], np.quantile(k, np.linspace(0, 1, 200)))


def test_running_sums_over_partitions(spark):
    rows = [(g, i, (i * 7) % 11) for g in ("a", None) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    for r in running_sums(df, ["g"], "o", ["v"]).collect():
        assert r["run_v"] == sum((i * 7) % 11 for i in range(r["o"] + 1))


def test_cuts_take_exact_counts(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    h = seeded_hash(["k"], 7)
    cuts = rank_cuts(df, h, "k", lambda _, n: [0, 1, 1234, n])[None]
    from tablewright.operators.order import before_cut

    counts = [df.where(before_cut(h, F.col("k"), c)).count() for c in cuts]
    assert counts == [0, 1, 1234, 5000]


def test_a_column_that_does_not_identify_rows_is_refused(spark):
    df = spark.range(5000).withColumn("k", F.lit(1))
    with pytest.raises(ValueError, match="identify"):
        rank_cuts(df, seeded_hash(["k"], 7), "k", lambda _, n: [100])


def test_splits_ignore_partitioning_and_keep_groups_apart(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 37).withColumn("t", F.col("id") % 10)
    for make in (lambda d: split.random_split(d, "id"), lambda d: split.stratified_split(d, "id", "t"),
                 lambda d: split.time_split(d, "t", "id"), lambda d: split.kfold(d, "id").withColumnRenamed("fold", "split")):
        one = {r["id"]: r["split"] for r in make(df.repartition(2)).collect()}
        other = {r["id"]: r["split"] for r in make(df.repartition(9)).collect()}
        assert one == other and len(one) == 1000
    grouped = split.group_split(df, "g", "id")
    assert grouped.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_time_split_puts_missing_times_last(spark):
    rows = [(i, None if i < 30 else i) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, t long")
    parts = {r["id"]: r["split"] for r in split.time_split(df, "t", "id").collect()}
    assert all(parts[i] == "train" for i in range(30, 100))
    assert sorted(i for i in range(30) if parts[i] == "test") == list(range(10, 30))


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        split.split_table(spark.range(3), "other", "id")


def test_ranks_of_any_double_and_bigint_in_few_passes(spark, monkeypatch):
    from tablewright.operators import order

    wide = [s * 10.0 ** e for e in range(-300, 300) for s in (1, -1)] + [float("inf"), float("-inf"), 0.0, -0.0, 5e-324, 2.0 ** -1022, 1.7976931348623157e308]
    wide += [2.0 ** e for e in range(-60, 60)]
    whole = [-(1 << 63), (1 << 63) - 1, 0, 1, -1] * 100
    n = min(len(wide), len(whole))
    rows = [(float(wide[i]) if i < len(wide) else None, whole[i % len(whole)]) for i in range(len(wide))]
    df = spark.createDataFrame(rows, "x double, k bigint")
    passes = []
    plain = order._histogram
    monkeypatch.setattr(order, "_histogram", lambda *a: passes.append(1) or plain(*a))
    ranks = list(range(0, len(wide), 97)) + [len(wide) - 1]
    found = select_ranks(df, {"x": F.col("x"), "k": F.col("k")}, {"x": ranks, "k": [0, n // 2, len(wide) - 1]})
    ordered, keys = sorted(wide), sorted(r[1] for r in rows)
    assert {r: v.value for r, v in found["x"].items()} == {r: ordered[r] for r in ranks}
    assert {r: v.value for r, v in found["k"].items()} == {r: keys[r] for r in (0, n // 2, len(wide) - 1)}
    assert len(passes) <= 5


def test_stratified_split_with_many_classes(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 500).cast("string").alias("y"))
    rows = split.stratified_split(df, "k", "y").groupBy("y", "split").count().collect()
    assert len({r["y"] for r in rows}) == 500 and {(r["split"], r["count"]) for r in rows} == {("test", 2), ("val", 1), ("train", 7)}


def test_passes_read_a_row_once_for_all_columns(spark, monkeypatch):
    from tablewright.operators import order

    df = spark.range(400).select(F.col("id").cast("double").alias("a"), (F.col("id") - (1 << 62)).alias("b"), F.lit(-(1 << 63)).alias("c"))
    sizes, plain = [], order._histogram
    monkeypatch.setattr(order, "_histogram", lambda rows, *a: sizes.append(rows.count()) or plain(rows, *a))
    found = quantiles(df, {c: F.col(c) for c in df.columns}, [0.5])
    assert found == {"a": [199.5], "b": [199.5 - (1 << 62)], "c": [-float(1 << 63)]}
    assert sizes and set(sizes) == {400}


def test_nan_counts_as_the_largest_value(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (-2.0,)], "x double")
    found = {r: v.value for r, v in select_ranks(df, {"x": F.col("x")}, {"x": [0, 1, 2, 3]})["x"].items()}
    assert [found[r] for r in range(3)] == [-2.0, 1.0, float("inf")] and found[3] != found[3]
