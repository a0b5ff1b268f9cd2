"""Feature selection: every score comes from one or two aggregate jobs over all columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.order import quantiles
from tablewright.operators.profile import correlation_matrix
from tablewright.operators.schema import numeric_columns, small_frame


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def variances(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.0) -> DataFrame:
    """(column, variance, keep): population variance with missing read as 0."""
    columns = list(columns or numeric_columns(df))
    cells = [F.struct(F.lit(c).alias("column"), F.var_pop(_filled(c)).alias("variance")) for c in columns]
    return (
        df.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))
        .withColumn("keep", F.col("variance") > threshold)
    )


def correlated_columns(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 0.95) -> list[str]:
    """Columns that correlate too strongly with any earlier column, kept or not."""
    columns = list(columns or numeric_columns(df))
    r = correlation_matrix(df, columns)
    return [
        b for j, b in enumerate(columns)
        if any(r.get((a, b)) is not None and abs(r[(a, b)]) > limit for a in columns[:j])
    ]


def anova_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, score): F statistic between classes.

    Sums per class are centred on the overall mean first, so that large values do not
    cancel; both jobs are map-side combined and move one row per class.
    """
    columns = list(columns)
    known = df.where(F.col(label).isNotNull())
    means = known.agg(*[F.avg(_filled(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    centred = [_filled(c) - F.lit(means[f"m{i}"] or 0.0) for i, c in enumerate(columns)]
    by_class = known.groupBy(label).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(v).alias(f"s{i}") for i, v in enumerate(centred)],
        *[F.sum(v * v).alias(f"q{i}") for i, v in enumerate(centred)],
    )
    cells = []
    n, k = F.sum("n"), F.count(F.lit(1)).cast("double")
    for i, c in enumerate(columns):
        mean_square = F.sum(F.col(f"s{i}")) * F.sum(F.col(f"s{i}")) / n
        between = F.sum(F.col(f"s{i}") * F.col(f"s{i}") / F.col("n")) - mean_square
        within = F.sum(F.col(f"q{i}")) - F.sum(F.col(f"s{i}") * F.col(f"s{i}") / F.col("n"))
        score = F.try_divide(F.try_divide(between, k - 1.0), F.try_divide(within, n - k))
        cells.append(F.struct(F.lit(c).alias("feature"), score.alias("score")))
    return by_class.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))


def regression_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(feature, score): r^2 / (1 - r^2) * (n - 2)."""
    y = F.col(target).cast("double")
    cells = []
    for c in columns:
        r = F.corr(_filled(c), y)
        score = F.try_divide(r * r, 1.0 - r * r) * (F.count(y) - 2)
        cells.append(F.struct(F.lit(c).alias("feature"), score.alias("score")))
    return df.where(y.isNotNull()).agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))


def _bin(value: Column, edges: list[float]) -> Column:
    """Number of inner edges strictly below the value."""
    return sum(((value > e).cast("int") for e in sorted(set(edges))), F.lit(0))


def mutual_information(df: DataFrame, columns: Sequence[str], target: str, bins: int = 10,
                       regression: bool = False) -> DataFrame:
    """(feature, score): plug-in mutual information of quantile-binned values.

    A deterministic estimate that needs only a table of counts per (feature, bin, class).
    """
    columns = list(columns)
    known = df.where(F.col(target).isNotNull())
    values = {f"x{i}": _filled(c) for i, c in enumerate(columns)}
    if regression:
        values["y"] = F.col(target).cast("double")
    inner = quantiles(known, values, [i / bins for i in range(1, bins)])
    label = _bin(values["y"], inner["y"]).cast("string") if regression else F.col(target).cast("string")
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), _bin(values[f"x{i}"], inner[f"x{i}"]).alias("bin"), label.alias("label"))
        for i, c in enumerate(columns)])
    joint = known.select(F.inline(cells)).groupBy("feature", "bin", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # I = H(bin) + H(label) - H(bin, label), from sums of n ln n on tables of counts; pairs and both margins are one table.
    sides = F.array(*[
        F.struct(F.lit(side).alias("side"), (F.col("bin") if side != "label" else F.lit(None).cast("int")).alias("bin"),
                 (F.col("label") if side != "bin" else F.lit(None).cast("string")).alias("label")) for side in ("both", "bin", "label")])
    tables = joint.select("feature", "n", F.inline(sides)).groupBy("feature", "side", "bin", "label").agg(F.sum("n").alias("n"))
    merged = tables.groupBy("feature").agg(
        F.sum(F.when(F.col("side") == "both", F.col("n"))).alias("total"),
        *[F.sum(F.when(F.col("side") == side, F.col("n") * F.log("n"))).alias(name) for side, name in (("both", "both"), ("bin", "by_bin"), ("label", "by_label"))])
    total = F.col("total")
    score = (total * F.log(total) + F.col("both") - F.col("by_bin") - F.col("by_label")) / total
    return merged.select("feature", F.greatest(score, F.lit(0.0)).alias("score"))


def top_features(scores: DataFrame, min_importance: float = 0.001, max_features: int = 50) -> DataFrame:
    """Best first, ties by name; weak ones left out."""
    return scores.where(F.col("score") >= min_importance).orderBy(F.desc("score"), "feature").limit(max_features)


def lasso_coefficients(df: DataFrame, columns: Sequence[str], target: str, classification: bool,
                       alpha: float = 0.01, c: float = 1.0) -> DataFrame:
    """(feature, score): absolute L1-regularised coefficients, largest over the classes."""
    columns = list(columns)
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(
        df.select(*[_filled(x).alias(x) for x in columns], F.col(target).cast("double").alias("label")))
    if classification:
        strength = 1.0 / (c * max(1, data.count()))
        model = LogisticRegression(elasticNetParam=1.0, regParam=strength, standardization=False, maxIter=100).fit(data)
        matrix = abs(model.coefficientMatrix.toArray()).max(axis=0)
    else:
        model = LinearRegression(elasticNetParam=1.0, regParam=alpha, standardization=False, maxIter=200).fit(data)
        matrix = abs(model.coefficients.toArray())
    rows = [(x, float(w)) for x, w in zip(columns, matrix, strict=True)]
    return small_frame(df.sparkSession, rows, "feature string, score double")


def select_features(df: DataFrame, target: str, classification: bool, method: str = "mutual_info",
                    columns: Sequence[str] | None = None, variance_threshold: float = 0.0,
                    correlation_limit: float = 0.95, min_importance: float = 0.001,
                    max_features: int = 50) -> list[str]:
    """Drop constant and repeated columns, then keep the best by the chosen score.

    Without numeric columns everything is kept; an unknown method applies the two
    unsupervised filters only.
    """
    columns = [x for x in (columns or numeric_columns(df)) if x != target]
    if not columns:
        return []
    varying = {r["column"] for r in variances(df, columns, variance_threshold).where("keep").collect()}
    columns = [x for x in columns if x in varying]
    repeated = set(correlated_columns(df, columns, correlation_limit))
    columns = [x for x in columns if x not in repeated]
    if not columns or target not in df.columns:
        return columns
    if method == "mutual_info":
        scores = mutual_information(df, columns, target, regression=not classification)
    elif method == "f_test":
        scores = anova_scores(df, columns, target) if classification else regression_scores(df, columns, target)
    elif method == "lasso":
        scores = lasso_coefficients(df, columns, target, classification)
    else:
        return columns
    return [r["feature"] for r in top_features(scores, min_importance, max_features).collect()]
