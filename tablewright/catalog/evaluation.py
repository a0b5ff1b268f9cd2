"""Queries over metrics, calibration, error analysis, fairness and attributions.

Predictions come from fixed rules over lineitem and orders, so that every number can be
checked: truth ``l_returnflag = 'R'``, class ``l_discount > 0.05``, score from the price.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tablewright.catalog.base import order_hash_sql, query, stack_sql, table
from tablewright.operators import calibration, errors, explain, fairness, metrics, models, split, tree_attributions
from tablewright.operators.boosting import BoostedModel, Trees

_BINARY_SQL = """b AS (SELECT l_orderkey, l_linestatus, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice,
  (l_returnflag = 'R')::INTEGER AS y_true, (l_discount > 0.05)::INTEGER AS y_pred,
  l_extendedprice / 110000.0 AS score, l_discount * 10 AS coarse FROM lineitem)"""
_MULTI_SQL = """m AS (SELECT o_orderkey, o_orderstatus AS y_true, o_orderpriority, o_totalprice,
  CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 300000 THEN 'O' ELSE 'P' END AS y_pred FROM orders)"""
_REG_SQL = "r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax, l_quantity, l_extendedprice AS y_true, l_quantity * 1000 AS y_pred FROM lineitem)"


def _binary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice",
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"), (F.col("l_discount") > 0.05).cast("int").alias("y_pred"),
        (F.col("l_extendedprice") / 110000.0).alias("score"), (F.col("l_discount") * 10).alias("coarse"))


def _multi(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("y_true"), "o_orderpriority", "o_totalprice",
        F.when(price < 150000, "F").when(price < 300000, "O").otherwise("P").alias("y_pred"))


def _regression(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_quantity",
        F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * 1000).alias("y_pred"))


# --- class metrics ---------------------------------------------------------------

_CLASSES_SQL = f"""{_MULTI_SQL},
k AS (SELECT c, sum(t) AS t, sum(p) AS p, sum(h) AS h FROM (
  SELECT y_true AS c, count(*)::DOUBLE AS t, 0::DOUBLE AS p, sum((y_true = y_pred)::INT)::DOUBLE AS h FROM m GROUP BY y_true
  UNION ALL SELECT y_pred, 0, count(*), 0 FROM m GROUP BY y_pred) GROUP BY c)"""
_CLASS_EXPRESSIONS = {
    "accuracy": "sum(h) / sum(t)",
    "balanced_accuracy": "avg(CASE WHEN t > 0 THEN h / t END)",
    "precision": "sum(coalesce(h / nullif(p, 0), 0) * t) / sum(t)",
    "recall": "sum(coalesce(h / nullif(t, 0), 0) * t) / sum(t)",
    "f1": "sum(coalesce(2 * h / nullif(t + p, 0), 0) * t) / sum(t)",
    "mcc": "(sum(h) * sum(t) - sum(t * p)) / sqrt((sum(t) * sum(t) - sum(p * p)) * (sum(t) * sum(t) - sum(t * t)))",
    "cohen_kappa": "(sum(h) / sum(t) - sum(t * p) / (sum(t) * sum(t))) / (1 - sum(t * p) / (sum(t) * sum(t)))",
}


def _class_sql(*names: str) -> str:
    return f"WITH {_CLASSES_SQL} SELECT {', '.join(f'round({_CLASS_EXPRESSIONS[n]}, 9) AS {n}' for n in names)} FROM k"


def _class_query(name: str, *columns: str) -> None:
    @query(name, _class_sql(*columns))
    def run(spark, sf_dir):
        found = metrics.class_metrics(_multi(spark, sf_dir))
        return found.select(*[F.round(c, 9).alias(c) for c in columns])


_class_query("m_accuracy", "accuracy")
_class_query("m_balanced_accuracy", "balanced_accuracy")
_class_query("m_prf_weighted", "precision", "recall", "f1")
_class_query("m_mcc", "mcc")
_class_query("m_kappa", "cohen_kappa")


def _rank_sql(source: str, positive: str, score: str) -> str:
    """Counts per distinct score with what lies above, all in window functions."""
    return f"""(SELECT {score} AS s, sum(({positive})::INT)::DOUBLE AS pos, sum((NOT ({positive}))::INT)::DOUBLE AS neg,
      sum(sum(({positive})::INT)) OVER (ORDER BY {score} DESC)::DOUBLE AS tp, sum(sum((NOT ({positive}))::INT)) OVER (ORDER BY {score} DESC)::DOUBLE AS fp
      FROM {source} GROUP BY {score})"""


_AUC = "1 - sum(pos * (fp - neg + neg / 2)) / (sum(pos) * sum(neg))"
_AP = "sum(pos * tp / (tp + fp)) / sum(pos)"


@query("m_roc_auc", f"WITH {_BINARY_SQL} SELECT round({_AUC}, 9) AS roc_auc FROM {_rank_sql('b', 'y_true = 1', 'score')}")
def m_roc_auc(spark, sf_dir):
    found = metrics.ranking_metrics(_binary(spark, sf_dir), F.col("y_true") == 1, F.col("score"))
    return found.select(F.round("roc_auc", 9).alias("roc_auc"))


@query("m_average_precision", f"WITH {_BINARY_SQL} SELECT round({_AP}, 9) AS average_precision FROM {_rank_sql('b', 'y_true = 1', 'score')}")
def m_average_precision(spark, sf_dir):
    found = metrics.ranking_metrics(_binary(spark, sf_dir), F.col("y_true") == 1, F.col("score"))
    return found.select(F.round("average_precision", 9).alias("average_precision"))


_OVR_SCORES = {"F": "1 - o_totalprice / 600000", "O": "o_totalprice / 600000", "P": "(o_totalprice % 1000) / 1000"}


@query("m_roc_auc_ovr", f"WITH {_MULTI_SQL} SELECT round(sum(auc * n) / sum(n), 9) AS roc_auc_ovr FROM (" + stack_sql(
    [f"SELECT {_AUC} AS auc, sum(pos) AS n FROM {_rank_sql('m', f'''y_true = '{c}' ''', e)}" for c, e in _OVR_SCORES.items()]) + ")")
def m_roc_auc_ovr(spark, sf_dir):
    price = F.col("o_totalprice")
    scores = {"F": 1 - price / 600000, "O": price / 600000, "P": (price % 1000) / 1000}
    found = metrics.roc_auc_ovr(_multi(spark, sf_dir), scores)
    return found.select(F.round("roc_auc_ovr", 9).alias("roc_auc_ovr"))


@query("m_log_loss", f"""WITH {_BINARY_SQL}
SELECT round(-avg(ln(least(greatest(CASE WHEN y_true = 1 THEN score ELSE 1 - score END, 2.220446049250313e-16), 1 - 2.220446049250313e-16))), 9) AS log_loss FROM b""")
def m_log_loss(spark, sf_dir):
    p = F.when(F.col("y_true") == 1, F.col("score")).otherwise(1 - F.col("score"))
    return metrics.log_loss(_binary(spark, sf_dir), p).select(F.round("log_loss", 9).alias("log_loss"))


# --- regression metrics ----------------------------------------------------------

_REG_EXPRESSIONS = {
    "rmse": ("sqrt(avg(e * e))", 5), "mse": ("avg(e * e)", 2), "mae": ("avg(abs(e))", 5), "median_ae": ("median(abs(e))", 5),
    "mape": ("avg(abs(e) / greatest(abs(y_true), 2.220446049250313e-16))", 8), "r2": ("1 - avg(e * e) / var_pop(y_true)", 8),
    "explained_variance": ("1 - var_pop(e) / var_pop(y_true)", 8), "max_error": ("max(abs(e))", 5),
}
_REG_CTE = f"{_REG_SQL}, q AS (SELECT *, y_true - y_pred AS e FROM r)"


def _regression_query(name: str, *columns: str) -> None:
    sql = ", ".join(f"round({_REG_EXPRESSIONS[c][0]}, {_REG_EXPRESSIONS[c][1]}) AS {c}" for c in columns)

    @query(name, f"WITH {_REG_CTE} SELECT {sql} FROM q")
    def run(spark, sf_dir):
        found = metrics.regression_metrics(_regression(spark, sf_dir), with_median="median_ae" in columns)
        return found.select(*[F.round(c, _REG_EXPRESSIONS[c][1]).alias(c) for c in columns])


_regression_query("m_rmse", "rmse", "mse")
_regression_query("m_mae", "mae", "median_ae")
_regression_query("m_mape", "mape")
_regression_query("m_r2", "r2", "explained_variance")
_regression_query("m_max_error", "max_error")


@query("m_all_regression", f"WITH {_REG_CTE} " + stack_sql(
    [f"SELECT '{c}' AS metric, round({e}, 2) AS value FROM q" for c, (e, _) in _REG_EXPRESSIONS.items()]))
def m_all_regression(spark, sf_dir):
    return metrics.evaluate(_regression(spark, sf_dir), "regression").withColumn("value", F.round("value", 2))


_BINARY_CLASSES = """k AS (SELECT c, sum(t) AS t, sum(p) AS p, sum(h) AS h FROM (
  SELECT y_true AS c, count(*)::DOUBLE AS t, 0::DOUBLE AS p, sum((y_true = y_pred)::INT)::DOUBLE AS h FROM b GROUP BY y_true
  UNION ALL SELECT y_pred, 0, count(*), 0 FROM b GROUP BY y_pred) GROUP BY c)"""


@query("m_all_classification", f"WITH {_BINARY_SQL}, {_BINARY_CLASSES}, s AS {_rank_sql('b', 'y_true = 1', 'score')} " + stack_sql(
    [f"SELECT '{c}' AS metric, round({e}, 9) AS value FROM k" for c, e in _CLASS_EXPRESSIONS.items()]
    + [f"SELECT 'roc_auc', round({_AUC}, 9) FROM s", f"SELECT 'average_precision', round({_AP}, 9) FROM s",
       "SELECT 'log_loss', round(-avg(ln(least(greatest(CASE WHEN y_true = 1 THEN score ELSE 1 - score END, 2.220446049250313e-16), 1 - 2.220446049250313e-16))), 9) FROM b"]))
def m_all_classification(spark, sf_dir):
    found = metrics.evaluate(_binary(spark, sf_dir), "classification", score=F.col("score"))
    return found.withColumn("value", F.round("value", 9))


@query("confusion_matrix", f"WITH {_MULTI_SQL} SELECT y_true, " + ", ".join(
    f"CAST(count(*) FILTER (y_pred = '{c}') AS BIGINT) AS pred_{c}" for c in "FOP") + " FROM m GROUP BY y_true")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_multi(spark, sf_dir))


@query("roc_points", f"""WITH {_BINARY_SQL}, t AS (SELECT sum(y_true)::DOUBLE AS p, count(*) - sum(y_true)::DOUBLE AS n FROM b)
SELECT s AS threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM {_rank_sql('b', 'y_true = 1', 'coarse')}, t""")
def roc_points(spark, sf_dir):
    points = metrics.roc_points(_binary(spark, sf_dir), F.col("y_true") == 1, F.col("coarse"))
    return points.select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


# --- calibration -----------------------------------------------------------------

_CURVE_SQL = """c AS (SELECT CAST(len(list_filter([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]::DOUBLE[], lambda e: e < score)) AS INTEGER) AS bin,
  avg(score) AS mean_score, avg(y_true) AS positive_share, count(*) AS n FROM b GROUP BY 1)"""


@query("cal_brier", f"WITH {_BINARY_SQL} SELECT round(avg((score - y_true) * (score - y_true)), 9) AS brier FROM b")
def cal_brier(spark, sf_dir):
    return calibration.brier(_binary(spark, sf_dir)).select(F.round("brier", 9).alias("brier"))


@query("cal_curve", f"WITH {_BINARY_SQL}, {_CURVE_SQL} SELECT bin, round(mean_score, 9) AS mean_score, round(positive_share, 9) AS positive_share, n FROM c")
def cal_curve(spark, sf_dir):
    return calibration.curve(_binary(spark, sf_dir)).select(
        "bin", F.round("mean_score", 9).alias("mean_score"), F.round("positive_share", 9).alias("positive_share"), "n")


@query("cal_ece", f"""WITH {_BINARY_SQL}, {_CURVE_SQL} SELECT round(avg(abs(positive_share - mean_score)), 9) AS ece,
  round(sum(abs(positive_share - mean_score) * n) / sum(n), 9) AS ece_weighted FROM c""")
def cal_ece(spark, sf_dir):
    return calibration.calibration_error(_binary(spark, sf_dir)).select(
        F.round("ece", 9).alias("ece"), F.round("ece_weighted", 9).alias("ece_weighted"))


def _calibrated(spark, sf_dir, method):
    rows = _binary(spark, sf_dir)
    fitted = calibration.fit_calibrator(rows.where("l_orderkey % 2 = 0"), method)
    scored = fitted.transform(rows.where("l_orderkey % 2 = 1"))
    return calibration.calibration_error(scored, score="calibrated").select(
        F.lit(method).alias("method"), (F.col("ece_weighted") < 0.05).alias("calibrated"))


@query("cal_isotonic")
def cal_isotonic(spark, sf_dir):
    return _calibrated(spark, sf_dir, "isotonic")


@query("cal_platt")
def cal_platt(spark, sf_dir):
    return _calibrated(spark, sf_dir, "sigmoid")


# --- errors ----------------------------------------------------------------------

@query("err_overall", f"""WITH {_MULTI_SQL}, {_REG_SQL}
SELECT 'classification' AS task, round(avg((y_true <> y_pred)::INT), 9) AS error, count(*) AS n FROM m
UNION ALL SELECT 'regression', round(avg(abs(y_true - y_pred)), 5), count(*) FROM r""")
def err_overall(spark, sf_dir):
    classes = errors.overall_error(_multi(spark, sf_dir), "classification").select(
        F.lit("classification").alias("task"), F.round("error", 9).alias("error"), "n")
    numbers = errors.overall_error(_regression(spark, sf_dir), "regression").select(
        F.lit("regression").alias("task"), F.round("error", 5).alias("error"), "n")
    return classes.unionByName(numbers)


@query("err_worst", f"""WITH {_REG_SQL} SELECT l_orderkey, l_linenumber, round(abs(y_true - y_pred), 4) AS error FROM r
ORDER BY abs(y_true - y_pred) DESC, l_orderkey, l_linenumber LIMIT 20""")
def err_worst(spark, sf_dir):
    worst = errors.worst_rows(_regression(spark, sf_dir), "regression", ["l_orderkey", "l_linenumber"])
    return worst.select("l_orderkey", "l_linenumber", F.round("error", 4).alias("error"))


def _bucket_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, CAST(len(list_filter(e[2:len(e) - 1], lambda x: x < {c})) AS INTEGER) AS bucket, error, e
FROM (SELECT {c}::DOUBLE AS {c}, abs(y_true - y_pred) AS error FROM r), (SELECT list_sort(list_distinct(quantile_cont({c}::DOUBLE, [0.0,0.2,0.4,0.6,0.8,1.0]))) AS e FROM r)"""


_BUCKET_FEATURES = ("l_quantity", "l_discount", "l_linenumber", "l_partkey")


@query("err_by_bucket", f"""WITH {_REG_SQL}, x AS ({stack_sql([_bucket_sql(c) for c in _BUCKET_FEATURES])})
SELECT feature, bucket, round(e[bucket + 1], 6) AS low, round(e[bucket + 2], 6) AS high, round(avg(error), 5) AS mean_error, count(*) AS n FROM x GROUP BY ALL""")
def err_by_bucket(spark, sf_dir):
    found = errors.error_by_bucket(_regression(spark, sf_dir), "regression", _BUCKET_FEATURES)
    return found.select("feature", "bucket", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"),
                        F.round("mean_error", 5).alias("mean_error"), "n")


# --- fairness --------------------------------------------------------------------

_GROUPS_SQL = f"WITH {_BINARY_SQL}, g AS (" + stack_sql([
    f"""SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS "group", count(*) AS n, avg((y_true = y_pred)::INT) AS accuracy, avg((y_pred = 1)::INT) AS selection_rate
        FROM b GROUP BY {f}""" for f in ("l_linestatus", "l_linenumber")]) + ")"


def _groups(spark, sf_dir):
    return fairness.group_metrics(_binary(spark, sf_dir), ["l_linestatus", "l_linenumber", "not_there"])


def _round_all(df, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("fair_groups", f"""{_GROUPS_SQL} SELECT feature, "group", n, round(accuracy, 9) AS accuracy, round(selection_rate, 9) AS selection_rate FROM g""")
def fair_groups(spark, sf_dir):
    return _round_all(_groups(spark, sf_dir))


@query("fair_difference", f"""{_GROUPS_SQL} SELECT feature, round(max(accuracy) - min(accuracy), 9) AS accuracy,
  round(max(selection_rate) - min(selection_rate), 9) AS selection_rate FROM g GROUP BY feature""")
def fair_difference(spark, sf_dir):
    return _round_all(fairness.group_difference(_groups(spark, sf_dir)))


@query("fair_ratio", f"""{_GROUPS_SQL} SELECT feature, round(min(accuracy) / nullif(max(accuracy), 0), 9) AS accuracy,
  round(min(selection_rate) / nullif(max(selection_rate), 0), 9) AS selection_rate FROM g GROUP BY feature""")
def fair_ratio(spark, sf_dir):
    return _round_all(fairness.group_ratio(_groups(spark, sf_dir)))


@query("fair_fallback", f"""{_GROUPS_SQL} SELECT feature, count(*) AS n_groups, round(min(accuracy) / nullif(max(accuracy), 0), 9) AS disparate_impact_ratio,
  round(max(accuracy) - min(accuracy), 9) AS accuracy_difference FROM g GROUP BY feature""")
def fair_fallback(spark, sf_dir):
    return _round_all(fairness.accuracy_report(_groups(spark, sf_dir)))


# --- attributions ----------------------------------------------------------------

# A made-up linear model.
_COEFFICIENTS = {"l_quantity": 0.02, "l_discount": -3.0, "l_tax": 1.5, "l_linenumber": 0.1}
_SHAP_SQL = "sv AS (" + stack_sql([
    f"SELECT l_orderkey, '{c}' AS feature, {w} * ({c} - (SELECT avg({c}) FROM lineitem)) AS contribution FROM lineitem"
    for c, w in _COEFFICIENTS.items()]) + ")"


@query("shap_linear", f"WITH {_SHAP_SQL} SELECT l_orderkey, feature, round(contribution, 6) AS contribution FROM sv")
def shap_linear(spark, sf_dir):
    return _round_all(explain.linear_attributions(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _COEFFICIENTS), 6)


@query("shap_global", f"WITH {_SHAP_SQL} SELECT feature, round(avg(abs(contribution)), 9) AS importance FROM sv GROUP BY feature")
def shap_global(spark, sf_dir):
    values = explain.linear_attributions(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _COEFFICIENTS)
    return _round_all(explain.global_importance(values))


_ORDER_COEFFICIENTS = {"o_totalprice": 0.00001, "o_custkey": -0.001, "o_orderkey": 0.00003}
_ORDER_SHAP_SQL = "sv AS (" + stack_sql([
    f"SELECT o_orderkey AS id, '{c}' AS feature, {w:.5f}::DOUBLE * ({c} - (SELECT avg({c}) FROM orders)) AS contribution FROM orders"
    for c, w in _ORDER_COEFFICIENTS.items()]) + ")"


@query("shap_top_per_row", f"""WITH {_ORDER_SHAP_SQL} SELECT id, feature, round(contribution, 6) AS contribution, CAST(rank AS INTEGER) AS rank,
  CASE WHEN contribution >= 0 THEN 'increases' ELSE 'decreases' END AS direction FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(contribution) DESC, feature) AS rank FROM sv) WHERE rank <= 2""")
def shap_top_per_row(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey"))
    values = explain.linear_attributions(orders, ["id"], _ORDER_COEFFICIENTS)
    return _round_all(explain.top_contributions(values, ["id"], 2), 6)


@query("shap_sampled")
def shap_sampled(spark, sf_dir):
    """Sampled Shapley values of a product model over all orders; summed per feature."""
    orders = table(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice") / 100000).withColumn(
        "month", F.month("o_orderdate").cast("double"))
    values = explain.sampled_attributions(
        orders, "o_orderkey", ["price", "month"], orders,
        lambda rows: rows.withColumn("score", F.col("price") * F.col("month")), permutations=4)
    return explain.global_importance(values)


# A made-up tree. Quantity up to 25, then discount up to 0.05 (1 or 3), else tax up to 0.04 (2 or 6).
_TREE_FEATURES = ["l_quantity", "l_discount", "l_tax"]
_TREE = Trees(
    feature=np.array([0, 1, 2, -1, -1, -1, -1]), cut=np.array([25.0, 0.05, 0.04, 0, 0, 0, 0]), missing_left=np.ones(7, bool),
    left=np.array([1, 3, 5, -1, -1, -1, -1]), right=np.array([2, 4, 6, -1, -1, -1, -1]), value=np.array([0, 0, 0, 1.0, 3.0, 2.0, 6.0]),
    weight=np.zeros(7), root=np.array([0]), kind=np.array([0]))


def _tree_attribution_sql(feature: str) -> str:
    """Shapley value over the eight sets of known features: q, d, t are the row's sides, sq, sd, st the shares."""
    def worth(known):
        q, d, t = (c if c in known else f"s{c}" for c in "qdt")
        return f"({q} * ({d} + 3 * (1 - {d})) + (1 - {q}) * (2 * {t} + 6 * (1 - {t})))"

    a, b = (c for c in "qdt" if c != feature)
    terms = [f"({worth(feature + s)} - {worth(s)}) / {w}.0" for s, w in (("", 3), (a, 6), (b, 6), (a + b, 3))]
    return " + ".join(terms)


_TREE_SQL = """s AS (SELECT l_orderkey, l_linenumber, (l_quantity <= 25)::INTEGER::DOUBLE AS q, (l_discount <= 0.05)::INTEGER::DOUBLE AS d, (l_tax <= 0.04)::INTEGER::DOUBLE AS t FROM lineitem),
p AS (SELECT avg(q) AS sq, sum(q * d) / sum(q) AS sd, sum((1 - q) * t) / sum(1 - q) AS st FROM s)"""


@query("shap_trees", f"WITH {_TREE_SQL} " + " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, 0 AS output, '{f}' AS feature, round({_tree_attribution_sql(c)}, 6) AS contribution FROM s, p"
    for f, c in zip(_TREE_FEATURES, "qdt")))
def shap_trees(spark, sf_dir):
    """Exact attributions of a made-up tree, averaged over all of lineitem where a feature is unknown."""
    rows = models.assemble(table(spark, sf_dir, "lineitem"), _TREE_FEATURES, None, ["l_orderkey", "l_linenumber"])
    model = BoostedModel("regression", 3, 1, np.zeros(1), _TREE, np.zeros(3))
    model = tree_attributions.with_background(model, rows)
    return _round_all(tree_attributions.tree_attributions(rows, ["l_orderkey", "l_linenumber"], model, _TREE_FEATURES), 6)


@query("importance_topn", f"WITH {_SHAP_SQL} SELECT feature, round(avg(abs(contribution)), 9) AS importance FROM sv GROUP BY feature ORDER BY importance DESC, feature LIMIT 2")
def importance_topn(spark, sf_dir):
    values = explain.linear_attributions(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _COEFFICIENTS)
    return _round_all(explain.top_importance(explain.global_importance(values), 2))


# --- folds and blending ----------------------------------------------------------

_FOLDS_SQL = f"""f AS (SELECT m.*, CAST(CASE WHEN rn <= (n % 5) * (n // 5 + 1) THEN (rn - 1) // (n // 5 + 1)
  ELSE (n % 5) + (rn - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM (
  SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY {order_hash_sql("o_orderkey")}, o_orderkey) AS rn, count(*) OVER (PARTITION BY y_true) AS n FROM m) m)"""


@query("cv_fold_metrics", f"""WITH {_MULTI_SQL}, {_FOLDS_SQL}, a AS (SELECT fold, avg((y_true = y_pred)::INT) AS accuracy FROM f GROUP BY fold)
SELECT CAST(fold AS VARCHAR) AS part, round(accuracy, 9) AS accuracy FROM a
UNION ALL SELECT 'mean', round(avg(accuracy), 9) FROM a UNION ALL SELECT 'std', round(stddev_pop(accuracy), 9) FROM a""")
def cv_fold_metrics(spark, sf_dir):
    folded = split.stratified_kfold(_multi(spark, sf_dir), "o_orderkey", "y_true")
    per_fold = metrics.class_metrics(folded, by=["fold"]).select("fold", "accuracy")
    summary = metrics.fold_summary(per_fold)
    parts = per_fold.select(F.col("fold").cast("string").alias("part"), F.round("accuracy", 9).alias("accuracy"))
    return parts.unionByName(summary.select(F.lit("mean").alias("part"), F.round("mean", 9).alias("accuracy"))).unionByName(
        summary.select(F.lit("std").alias("part"), F.round("std", 9).alias("accuracy")))


@query("blend_average", """
SELECT l_orderkey, round((2 * least(l_discount * 10, 1) + 1 * l_extendedprice / 110000.0) / 3, 9) AS proba_class_1,
       CASE WHEN (2 * least(l_discount * 10, 1) + l_extendedprice / 110000.0) / 3 > 0.5 THEN 1 ELSE 0 END AS prediction FROM lineitem""")
def blend_average(spark, sf_dir):
    from tablewright.operators.ensemble import blend

    scored = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.least(F.col("l_discount") * 10, F.lit(1.0)).alias("a"), (F.col("l_extendedprice") / 110000.0).alias("b"))
    blended = blend(scored, {0: [1 - F.col("a"), 1 - F.col("b")], 1: [F.col("a"), F.col("b")]}, [2.0, 1.0])
    return blended.select("l_orderkey", F.round("proba_class_1", 9).alias("proba_class_1"), "prediction")
