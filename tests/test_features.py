"""Feature operators against brute force and hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import dates, encode, generate, impute, scale, select, text
from tablewright.operators.lookup import LookupTable
from tablewright.operators.profile import correlation_pairs
from tablewright.plans.features import FeatureOptions, fit_features


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        v = [float(rng.integers(0, 40)), float(rng.normal() * 10 + (200 if i % 50 == 0 else 0)), float(rng.integers(0, 5))]
        if i % 4 == 0:
            v = [7.0, 1.5, 2.0]                      # many copies of one donor
        if i % 6 == 1:
            v[int(rng.integers(0, 3))] = None
        if i % 30 == 1:
            v[0] = None
        rows.append((i, *v))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    filled = {r["id"]: (r["a"], r["b"], r["c"]) for r in impute.fit_neighbours(df, ["a", "b", "c"]).transform(df).collect()}
    for i, *v in rows:
        for t in range(3):
            if v[t] is not None:
                assert filled[i][t] == v[t]
                continue
            near = []
            for _, *d in rows:
                both = [j for j in range(3) if v[j] is not None and d[j] is not None]
                if d[t] is not None and both:
                    near.append((3.0 / len(both) * sum((v[j] - d[j]) ** 2 for j in both), d[t]))
            assert filled[i][t] == pytest.approx(np.mean([x for _, x in sorted(near)[:5]]))


def test_chained_regressions_recover_a_linear_column(spark):
    rows = [(float(i), float((i * 13) % 50), None if i % 7 == 0 else 3.0 * i - 2.0 * ((i * 13) % 50) + 5.0) for i in range(400)]
    df = spark.createDataFrame(rows, "x double, z double, y double")
    out = impute.fit_chained(df, ["x", "z", "y"]).transform(df)
    assert out.where(F.abs(F.col("y") - (3 * F.col("x") - 2 * F.col("z") + 5)) > 1e-3).count() == 0
    assert impute.nulls_remaining(out) == 0


def test_an_entirely_missing_column_stays_missing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan"))], "a double, b double")
    out = impute.fit_fill(df, "median").transform(df).collect()
    assert [tuple(r) for r in out] == [(None, 1.0), (None, 1.0)]


def test_constant_fill_needs_a_number(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    with pytest.raises(ValueError):
        impute.fit_fill(df, "constant", fill_value="MISSING")


def test_salted_lookup_equals_broadcast(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 11 == 0 else f"k{i % 90}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, c string")
    counts = df.where("c IS NOT NULL").groupBy(F.col("c").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    plain = LookupTable.build(counts).join(df, "c", ["n"], "")
    salted = LookupTable.build(counts, 0)
    assert "hot" in salted.hot_keys
    joined = salted.join(df, "c", ["n"], "", 0)
    assert sorted(map(tuple, plain.select("id", "c", "n").collect()), key=repr) == sorted(
        map(tuple, joined.select("id", "c", "n").collect()), key=repr)


def test_encoders_on_unseen_categories(spark):
    train = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 0)], "c string, y int")
    new = spark.createDataFrame([("a",), ("zz",), (None,)], "c string")

    def coded(strategy):
        return [tuple(r) for r in encode.fit_encoder(train, ["c"], strategy, "y").transform(new).collect()]

    assert coded("onehot") == [(1, 0), (0, 0), (0, 0)]
    assert [r[0] for r in coded("ordinal")] == [0, -1, -1]
    assert coded("frequency") == [(pytest.approx(2 / 3),), (0.0,), (0.0,)]
    assert coded("target")[1] == (0.5,) and coded("woe")[1] == (0.0,)
    weight = 1 / (1 + math.exp(-(2 - 20) / 10))
    assert coded("target")[0][0] == pytest.approx(0.5 * (1 - weight) + 0.5 * weight)
    with pytest.raises(ValueError):
        encode.fit_encoder(train, ["c"], "other")


@pytest.mark.parametrize("strategy", ["standard", "minmax", "robust", "maxabs", "power"])
def test_scale_then_inverse_is_identity(spark, strategy):
    df = spark.createDataFrame([(float(x), 5.0) for x in (-3, -1, 0, 2, 2, 9, 40)], "x double, same double")
    fitted = scale.fit_scaler(df, strategy)
    back = fitted.inverse_transform(fitted.transform(df)).collect()
    assert np.allclose([tuple(r) for r in back], [tuple(r) for r in df.collect()], atol=1e-6)
    assert all(np.isfinite(tuple(r)).all() for r in fitted.transform(df).collect())


def test_power_exponent_is_the_likelihood_maximum(spark):
    x = np.exp(np.linspace(-2, 3, 200)) - 1

    def likelihood(p):
        with np.errstate(all="ignore"):
            right = np.log1p(x) if abs(p) < 1e-12 else ((x + 1) ** p - 1) / p
            left = -np.log1p(-x) if abs(p - 2) < 1e-12 else -((1 - x) ** (2 - p) - 1) / (2 - p)
        y = np.where(x >= 0, right, left)
        return -len(x) / 2 * np.log(y.var()) + (p - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    fitted = scale.fit_scaler(spark.createDataFrame([(float(v),) for v in x], "x double"), "power")
    best = max(np.arange(-3, 5, 0.001), key=likelihood)
    assert fitted.powers["x"] == pytest.approx(best, abs=0.003)


def test_quantile_scaling_is_normal(spark):
    # As many quantiles as rows: every row sits on the grid.
    df = spark.range(1000).select((F.col("id") ** 2).cast("double").alias("x"))
    z = np.sort([r["x"] for r in scale.fit_scaler(df, "quantile").transform(df).collect()])
    for i in (1, 333, 500, 998):
        assert z[i] == pytest.approx(scale.normal_quantile(i / 999), abs=1e-6)


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([(1, "The cat, the CAT_2 a été!"), (2, None), (3, "one")], "id long, t string")
    rows = {r["id"]: r for r in text.with_tokens(df, "t").withColumn("g", text.ngrams(F.col("tokens"))).collect()}
    assert rows[1]["tokens"] == ["the", "cat", "the", "cat_2", "été"]
    assert rows[1]["g"][5:] == ["the cat", "cat the", "the cat_2", "cat_2 été"]
    assert rows[2]["g"] == [] and rows[3]["g"] == ["one"]


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "red red blue"), (2, "red green"), (3, "blue green")], "id long, t string")
    fitted = text.fit_text(df, "t", spans=(1, 1), min_df=2)
    values = {(r["id"], r["term"]): r["value"] for r in fitted.tfidf(df, "id").collect()}
    idf = math.log(4 / 3) + 1
    norm = math.sqrt((2 * idf) ** 2 + idf ** 2)
    assert values[(1, "red")] == pytest.approx(2 * idf / norm)
    assert sum(v * v for (i, _), v in values.items() if i == 2) == pytest.approx(1.0)


def test_iso_week_at_year_end_and_missing_times(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2020-12-31'), (TIMESTAMP '2021-01-03'), (NULL) AS v(t)")
    rows = dates.date_features(df, ["t"], ("weekofyear", "dayofweek", "is_month_end"), cyclical=False).collect()
    assert [tuple(r) for r in rows] == [(53, 3, 1), (53, 6, 0), (None, None, None)]


def test_ratio_with_a_zero_denominator(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 2.0)], "a double, b double")
    out = generate.generate_features(df)
    assert [r["ratio__a__b"] for r in out.collect()] == [0.0, 0.5, 0.0]
    assert out.columns == ["a", "b", "poly__a^2", "poly__a b", "poly__b^2", "ratio__a__b"]


def test_correlations_with_gaps_and_constants(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=200) + 1e6
    rows = [(float(x), None if i % 3 == 0 else float(2 * x + rng.normal()), 4.0, None) for i, x in enumerate(a)]
    found = {(r["column_a"], r["column_b"]): r["r"] for r in correlation_pairs(
        spark.createDataFrame(rows, "a double, b double, same double, none double")).collect()}
    kept = [(x, b) for x, b, *_ in rows if b is not None]
    assert found[("a", "b")] == pytest.approx(np.corrcoef(np.array(kept).T)[0, 1], abs=1e-7)
    assert found[("a", "same")] is None and found[("a", "none")] is None


def test_repeated_columns_are_dropped_even_against_dropped_ones(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), (F.col("id") * 3.0).alias("c"))
    assert select.correlated_columns(df) == ["b", "c"]


def test_feature_plan_on_a_mixed_table(spark):
    rows = [(i, float(i % 13) if i % 9 else None, "ABC"[i % 3], f"item_{i % 60}", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, num double, low string, high string, y int").withColumn(
        "day", F.date_add(F.lit("2021-01-01").cast("date"), F.col("id").cast("int")))
    fitted = fit_features(df.where("id < 150"), "y", True, FeatureOptions(text=False), key="id")
    out = fitted.transform(df.where("id >= 150"))
    assert out.columns == fitted.transform(df.where("id < 150")).columns
    assert impute.nulls_remaining(out) == 0 and "day" not in out.columns
    with pytest.raises(ValueError, match="missing at transform"):
        fitted.transform(df.drop("num"))
