"""Steps whose work has to grow no faster than the rows they read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.catalog import models as catalog
from tablewright.operators import boosting, scale
from tablewright.plans.features import FeatureOptions
from tablewright.plans.training import TrainingOptions, train


def test_a_run_is_trained_and_scored_on_rows_written_once(spark, monkeypatch):
    read = []

    class Stop(Exception):
        pass

    def train(df, *args, **kwargs):
        read.extend(df.inputFiles())
        raise Stop

    monkeypatch.setattr(catalog, "train", train)
    monkeypatch.setattr(catalog, "_orders", lambda spark, sf_dir: spark.range(5).select(
        F.col("id").alias("o_orderkey"), F.lit(1.0).alias("price"), F.lit(1).alias("o_custkey"), F.lit(1).alias("large")))
    try:
        catalog.stored_run_score(spark, "")
    except Stop:
        pass
    assert read and all("tablewright-orders-" in f for f in read)


def test_margins_are_written_each_round_where_a_core_has_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 1)                     # the driver's figure: 400 blocks
    writes, dropped, plain = [], [], boosting._Blocks.write
    monkeypatch.setattr(boosting._Blocks, "write", lambda self: writes.append(1) or plain(self))
    monkeypatch.setattr(boosting, "drop_folder", lambda spark, path: dropped.append(path))
    rows = spark.range(400).select(F.array((F.col("id") % 20).cast("double"), (F.col("id") % 7).cast("double")).alias("x"), (F.col("id") % 20 * 2).cast("double").alias("label"))
    from pyspark.ml.functions import array_to_vector

    model = boosting.HistogramBooster("regression", boosting.BoostOptions(trees=3, depth=2)).fit(rows.select(array_to_vector("x").alias("features"), "label"))
    assert model.n_rounds == 3 and len(writes) == 3 and len(set(dropped)) == 3


def test_exponents_are_scored_on_one_row_per_row(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.exp(rng.normal(size=300)) - 1.0, -rng.random(50)])
    df = spark.createDataFrame([(float(v), 2.0) for v in x] + [(None, 2.0)], "x double, k double").repartition(3)
    sizes, plain = [], scale._power_scores
    monkeypatch.setattr(scale, "_power_scores", lambda values, grids: sizes.append(values.count()) or plain(values, grids))
    found = scale.fit_power(df, ["x", "k"]).powers

    def likelihood(p):
        return -len(x) / 2 * np.log(scale._bent(x, p).var()) + (p - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    assert set(sizes) == {351} and found["k"] == 1.0
    assert all(likelihood(found["x"]) >= likelihood(found["x"] + d) for d in (-0.01, 0.01))


def test_a_workflow_fits_each_model_once_and_reads_its_rows_once(spark, monkeypatch):
    """Search, stack and final model use the fits of the model choice where settings and rows are the same."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    fits, read = [], spark.sparkContext.accumulator(0)
    for kind in (LogisticRegression, RandomForestClassifier):
        monkeypatch.setattr(kind, "fit", lambda self, df, plain=kind.fit: fits.append(type(self).__name__) or plain(self, df))

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("x"), F.pmod(F.col("id") * 7, F.lit(5)).cast("double").alias("z"),
                                   F.when(F.col("id") % 17 + F.col("id") % 5 > 9, 1).otherwise(0).alias("y"))
    df = rows.mapInArrow(passed, rows.schema)
    trained = train(df, "y", "id", "classification", FeatureOptions(text=False, generate=False, select=False),
                    TrainingOptions(models=("linear", "forest"), params={"forest": {"numTrees": 3, "maxDepth": 3}}, folds=2, n_trials=2,
                                    space={"C": [1.0]}))
    assert trained.metrics["roc_auc"] > 0.8 and read.value == 300
    linear, forest = fits.count("LogisticRegression"), fits.count("RandomForestClassifier")
    if trained.candidates[0].name == "linear":
        assert (linear, forest) == (2 + 1 + 1, 2 + 1)                    # folds, all rows; the meta-learner is a linear one
    else:
        assert forest <= 2 + 1 + 2 and linear == 2 + 1 + 1


def test_quantile_shares_are_placed_by_batch(spark):
    """Functions over arrays run interpreted for each row and edge: none is left in the plan."""
    values = [None, float("nan"), float("-inf"), -3.0, 0.0, -0.0, 1.0, 1.5, 2.0, 2.5, 4.0, 9.0, float("inf")]
    df = spark.createDataFrame([(v, 7.0) for v in values], "x double, k double")
    grid = (0.0, 1.0, 1.0, 2.0, 4.0)
    scaled = scale.QuantileScale({"x": grid, "k": (7.0, 7.0)}, normal=False).transform(df)
    assert "lambda" not in scaled._jdf.queryExecution().optimizedPlan().toString()

    def share(x):
        if x is None or x != x:
            return None
        if x <= grid[0] or x >= grid[-1]:
            return float(x >= grid[-1])
        places = []
        for n in (sum(e <= x for e in grid), sum(e < x for e in grid)):
            a = min(max(n - 1, 0), len(grid) - 2)
            width = grid[a + 1] - grid[a]
            places.append((a + min(max((x - grid[a]) / width, 0.0), 1.0) if width else a) / (len(grid) - 1))
        return sum(places) / 2

    assert [(r["x"], r["k"]) for r in scaled.collect()] == [(share(v), 0.0) for v in values]


def test_a_perceptron_reads_equal_rows_once_for_each_step(spark, monkeypatch):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    from tablewright.operators import models, perceptron

    df = spark.range(700).select((F.col("id") % 10 / 10.0).alias("a"), (F.col("id") % 4).cast("double").alias("b"),
                                 F.when(F.col("id") % 10 + F.col("id") % 3 > 5, 1).otherwise(0).alias("y"))
    rows = models.assemble(df, ["a", "b"], "y").repartition(3).cache()
    sizes, plain = set(), perceptron._evaluate

    def evaluate(blocks, *args):
        sizes.add(sum(len(r["cells"]) // 8 // 4 for r in blocks.collect()))
        return plain(blocks, *args)

    monkeypatch.setattr(perceptron, "_evaluate", evaluate)
    found = models.perceptron(2, 2, [3], maxIter=8).fit(rows)
    spark_own = MultilayerPerceptronClassifier(layers=[2, 3, 2], blockSize=1, seed=models.SEED, maxIter=8).fit(rows)
    assert sizes == {rows.distinct().count()} and max(sizes) < 100
    assert np.abs(found.weights.toArray() - spark_own.weights.toArray()).max() < 1e-6
    with pytest.raises(ValueError):
        models.perceptron(2, 2, [3]).fit(models.assemble(df, ["a", "b"], "y").withColumn("label", F.col("label") * 2))


def test_writing_margins_adds_no_parts(spark, monkeypatch):
    """Files larger than a split of the store are read in pieces: their number must not grow with the rounds."""
    from pyspark.ml.functions import array_to_vector

    monkeypatch.setattr(boosting, "NEAR_BLOCKS", 0)
    monkeypatch.setattr(boosting, "WRITE_ROUNDS", 1)
    parts, plain, read = [], boosting._Blocks.write, spark.sparkContext.pickleFile
    monkeypatch.setattr(boosting._Blocks, "write", lambda self: plain(self) or parts.append(self.margins.getNumPartitions()))
    monkeypatch.setattr(spark.sparkContext, "pickleFile", lambda path: read(path, 64))       # pieces as of large files
    rows = spark.range(400).select(array_to_vector(F.array((F.col("id") % 20).cast("double"))).alias("features"), (F.col("id") % 20).cast("double").alias("label"))
    boosting.HistogramBooster("regression", boosting.BoostOptions(trees=3, depth=2)).fit(rows)
    assert len(parts) == 3 and set(parts) == {1}
