"""Queries over drift, performance, retraining, alerts and batch scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.base import query, stack_sql, table
from tablewright.operators import drift, metrics, performance, score

_CUT = "1998-01-01"
_KS_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
_CHI_COLUMNS = ("o_orderpriority", "o_orderstatus")


def _lineitem_sides(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    early = F.col("l_shipdate") < F.lit(_CUT).cast("timestamp_ntz")
    return li.where(early), li.where(~early)


def _order_sides(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.lit(_CUT).cast("timestamp_ntz")
    return orders.where(early), orders.where(~early)


def _ks_sql(t: str, when: str, c: str) -> str:
    side = f"{when} < TIMESTAMP '{_CUT}'"
    return f"""SELECT '{c}' AS "column", max(n_ref) AS n_ref, max(n_cur) AS n_cur, max(abs(r / n_ref::DOUBLE - k / n_cur::DOUBLE)) AS statistic FROM (
  SELECT {c} AS v, sum(sum(({side})::INT)) OVER (ORDER BY {c}) AS r, sum(sum((NOT {side})::INT)) OVER (ORDER BY {c}) AS k,
         CAST((SELECT count(*) FROM {t} WHERE {side}) AS BIGINT) AS n_ref, CAST((SELECT count(*) FROM {t} WHERE NOT {side}) AS BIGINT) AS n_cur
  FROM {t} GROUP BY {c})"""


def _kolmogorov_sql(d: str) -> str:
    root = f"(sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur)) * {d})"
    series = f"2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * {root} * {root})))"
    return f"CASE WHEN {root} < 0.2 THEN 1.0 ELSE greatest(0, least(1, {series})) END"


@query("drift_ks", f"""WITH k AS ({stack_sql([_ks_sql("lineitem", "l_shipdate", c) for c in _KS_COLUMNS])})
SELECT "column", n_ref, n_cur, round(statistic, 9) AS statistic, round({_kolmogorov_sql("statistic")}, 6) AS p_value FROM k""")
def drift_ks(spark, sf_dir):
    reference, current = _lineitem_sides(spark, sf_dir)
    return drift.ks_statistics(reference, current, _KS_COLUMNS).select(
        "column", "n_ref", "n_cur", F.round("statistic", 9).alias("statistic"), F.round("p_value", 6).alias("p_value"))


def _chi_sql(c: str) -> str:
    side = f"o_orderdate < TIMESTAMP '{_CUT}'"
    return f"""SELECT '{c}' AS "column", sum((o - e * s) * (o - e * s) / (e * s)) AS statistic, count(*) - 1 AS dof FROM (
  SELECT o, e, sum(o) OVER () / sum(e) OVER () AS s FROM (
    SELECT {c}, sum((NOT {side})::INT)::DOUBLE + 1 AS o, sum(({side})::INT)::DOUBLE + 1 AS e FROM orders GROUP BY {c}))"""


# Both columns have an odd number of categories: the tail has a closed form.
_CHI_TAIL = """exp(-statistic / 2) * (CASE dof WHEN 2 THEN 1 WHEN 4 THEN 1 + statistic / 2 END)"""


@query("drift_chi2", f"""WITH c AS ({stack_sql([_chi_sql(c) for c in _CHI_COLUMNS])}) SELECT "column", round(statistic, 6) AS statistic, dof FROM c""")
def drift_chi2(spark, sf_dir):
    reference, current = _order_sides(spark, sf_dir)
    return drift.chi_square_statistics(reference, current, _CHI_COLUMNS).select(
        "column", F.round("statistic", 6).alias("statistic"), "dof")


_DRIFT_SQL = f"""WITH k AS ({stack_sql([_ks_sql("orders", "o_orderdate", c) for c in ("o_orderkey", "o_custkey", "o_totalprice")])}),
c AS ({stack_sql([_chi_sql(c) for c in _CHI_COLUMNS])}),
p AS (SELECT "column", 'ks' AS test, statistic, {_kolmogorov_sql("statistic")} AS p FROM k
      UNION ALL SELECT "column", 'chi2', statistic, {_CHI_TAIL} FROM c)"""
_DRIFT_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", *_CHI_COLUMNS]


@query("drift_columns", f"""{_DRIFT_SQL} SELECT "column", test, round(statistic, 6) AS statistic, round(p, 4) AS p_value, p < 0.05 AS drifted FROM p""")
def drift_columns(spark, sf_dir):
    reference, current = _order_sides(spark, sf_dir)
    found = drift.column_drift(reference, current.drop("not_there"), [*_DRIFT_COLUMNS, "not_there"])
    return found.withColumn("statistic", F.round("statistic", 6))


@query("drift_dataset", f"""{_DRIFT_SQL} SELECT CAST(sum((p < 0.05)::INT) AS BIGINT) AS n_drifted, CAST(5 AS BIGINT) AS n_columns,
  round(sum((p < 0.05)::INT) / 5.0, 4) AS drift_share, sum((p < 0.05)::INT) / 5.0 > 0.3 AS dataset_drift FROM p""")
def drift_dataset(spark, sf_dir):
    reference, current = _order_sides(spark, sf_dir)
    return drift.detect_drift(reference.select(*_DRIFT_COLUMNS), current.select(*_DRIFT_COLUMNS))[1]


# --- performance -----------------------------------------------------------------

_EVENTS_SQL = "e AS (SELECT event_id, ts, user_id, event_type, value AS y_true, 10 + (event_id % 17)::DOUBLE AS y_pred FROM events)"


def _predictions(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", F.col("value").alias("y_true"),
        (10 + (F.col("event_id") % 17).cast("double")).alias("y_pred"))


@query("perf_last_n", f"""WITH {_EVENTS_SQL}, w AS (SELECT * FROM e ORDER BY ts DESC, event_id DESC LIMIT 1000)
SELECT round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 6) AS rmse, round(avg(abs(y_true - y_pred)), 6) AS mae, round(max(abs(y_true - y_pred)), 6) AS max_error FROM w""")
def perf_last_n(spark, sf_dir):
    window = performance.last_rows(_predictions(spark, sf_dir), "ts", "event_id", 1000)
    return metrics.regression_metrics(window, with_median=False).select(
        *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "max_error")])


@query("perf_rolling", f"""WITH {_EVENTS_SQL}
SELECT user_id, event_id, ts, round(avg(abs(y_true - y_pred)) OVER w, 6) AS mae, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred)) OVER w), 6) AS rmse, count(*) OVER w AS window_rows
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def perf_rolling(spark, sf_dir):
    rolled = performance.rolling_metrics(_predictions(spark, sf_dir), ["user_id"], "ts", "event_id", 20)
    return rolled.select("user_id", "event_id", "ts", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), "window_rows")


@query("perf_rolling_1000", f"""WITH {_EVENTS_SQL}
SELECT event_type, event_id, ts, round(avg(abs(y_true - y_pred)) OVER w + 0.00000003, 6) AS mae, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred)) OVER w) + 0.00000003, 6) AS rmse, count(*) OVER w AS window_rows
FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""")
def perf_rolling_1000(spark, sf_dir):
    """The default window over a few large partitions; means of cents often lie halfway, so a little is added before rounding."""
    rolled = performance.rolling_metrics(_predictions(spark, sf_dir), ["event_type"], "ts", "event_id")
    return rolled.select("event_type", "event_id", "ts", F.round(F.col("mae") + 0.00000003, 6).alias("mae"), F.round(F.col("rmse") + 0.00000003, 6).alias("rmse"), "window_rows")


_HALVES_SQL = f"""{_EVENTS_SQL}, h AS (SELECT ts < TIMESTAMP '2024-01-15' AS first, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
  avg(abs(y_true - y_pred)) AS mae, 1 - avg((y_true - y_pred) * (y_true - y_pred)) / var_pop(y_true) AS r2 FROM e GROUP BY 1),
l AS (SELECT first, unnest(['rmse', 'mae', 'r2']) AS metric, unnest([rmse, mae, r2]) AS value FROM h)"""


@query("perf_degradation", f"""WITH {_HALVES_SQL}
SELECT metric, round(b.value, 6) AS baseline, round(c.value, 6) AS current, round(c.value - b.value, 4) AS delta,
  CASE WHEN metric = 'r2' THEN c.value - b.value < -0.05 ELSE c.value - b.value > 0.05 * b.value END AS degraded,
  CASE WHEN CASE WHEN metric = 'r2' THEN c.value - b.value < -0.05 ELSE c.value - b.value > 0.05 * b.value END THEN 'degraded' ELSE 'ok' END AS reason
FROM (SELECT * FROM l WHERE first) b JOIN (SELECT * FROM l WHERE NOT first) c USING (metric)""")
def perf_degradation(spark, sf_dir):
    rows = _predictions(spark, sf_dir)
    first = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")

    def facts(df):
        return metrics.long_form(metrics.regression_metrics(df, with_median=False).select("rmse", "mae", "r2"))

    found = performance.degradation(facts(rows.where(first)), facts(rows.where(~first)))
    return found.withColumn("baseline", F.round("baseline", 6)).withColumn("current", F.round("current", 6))


@query("perf_history", """
SELECT round(arg_max(mae, day), 9) AS last_value, count(*) AS n_points, round(arg_max(mae, day) - 10, 9) AS change
FROM (SELECT CAST(ts AS DATE) AS day, avg(abs(value - 10 - (event_id % 17))) AS mae FROM events GROUP BY 1)""")
def perf_history(spark, sf_dir):
    history = _predictions(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(
        F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))
    return performance.history_summary(history, "mae", "day", 10.0).select(
        F.round("last_value", 9).alias("last_value"), "n_points", F.round("change", 9).alias("change"))


_SIGNALS_SQL = """SELECT user_id, (sum((event_type = 'error')::INT) / count(*)::DOUBLE) * 1.5 AS drift_share, avg(value) < 18 AS degraded,
  CAST(date_diff('day', min(CAST(ts AS DATE)), DATE '2024-01-31') AS INTEGER) AS days_since_training FROM events GROUP BY user_id"""


@query("retrain_decision", f"""SELECT user_id, drift_share >= 0.3 OR degraded OR days_since_training >= 30 AS should_retrain,
  concat_ws(',', CASE WHEN drift_share >= 0.3 THEN 'data_drift' END, CASE WHEN degraded THEN 'performance_degradation' END,
            CASE WHEN days_since_training >= 30 THEN 'scheduled' END) AS reasons FROM ({_SIGNALS_SQL})""")
def retrain_decision(spark, sf_dir):
    signals = table(spark, sf_dir, "events").groupBy("user_id").agg(
        (F.sum((F.col("event_type") == "error").cast("int")) / F.count(F.lit(1)).cast("double") * 1.5).alias("drift_share"),
        (F.avg("value") < 18).alias("degraded"),
        F.date_diff(F.lit("2024-01-31").cast("date"), F.min(F.to_date("ts"))).alias("days_since_training"))
    decided = performance.retrain_decision(signals)
    return decided.select("user_id", "should_retrain", F.array_join("reasons", ",").alias("reasons"))


@query("alerts_filter", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'CRITICAL' ELSE 'WARNING' END AS level FROM events
WHERE event_type = 'error' OR value > 50""")
def alerts_filter(spark, sf_dir):
    level = F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("value") > 50, "WARNING").otherwise("INFO")
    alerts = table(spark, sf_dir, "events").select("event_id", level.alias("level"))
    return performance.filter_alerts(alerts, "WARNING")


# --- batch scoring ---------------------------------------------------------------

# A made-up logistic scorer.
_WEIGHTS = {"l_quantity": 0.03, "l_discount": 4.0, "l_tax": -2.0}
_LOGIT_SQL = "1.0 / (1.0 + exp(-(-1.0 + 0.03 * l_quantity + 4.0 * l_discount + -2.0 * l_tax)))"


def _scored(spark, sf_dir):
    return score.logistic_scores(table(spark, sf_dir, "lineitem"), _WEIGHTS, -1.0)


@query("batch_score", f"""SELECT l_orderkey, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction, round(1 - p, 9) AS proba_class_0, round(p, 9) AS proba_class_1
FROM (SELECT l_orderkey, {_LOGIT_SQL} AS p FROM lineitem)""")
def batch_score(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "l_orderkey", "prediction", F.round("proba_class_0", 9).alias("proba_class_0"), F.round("proba_class_1", 9).alias("proba_class_1"))


@query("batch_score_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) * 0.5 + 1 AS score FROM events")
def batch_score_json(spark, sf_dir):
    records = score.parse_records(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k double")
    return score.linear_scores(records, {"k": 0.5}, 1.0).select("event_id", "score")


@query("score_and_evaluate", f"""WITH s AS (SELECT (l_returnflag = 'R')::INT AS y, CASE WHEN {_LOGIT_SQL} > 0.5 THEN 1 ELSE 0 END AS q FROM lineitem)
SELECT round(avg((y = q)::INT), 9) AS accuracy, round(sum((y = 1 AND q = 1)::INT)::DOUBLE / sum(y), 9) AS recall_positive FROM s""")
def score_and_evaluate(spark, sf_dir):
    scored = _scored(spark, sf_dir).select((F.col("l_returnflag") == "R").cast("int").alias("y_true"), F.col("prediction").alias("y_pred"))
    counts = metrics.confusion_counts(scored)
    hit = F.col("y_true") == F.col("y_pred")
    return counts.agg(
        F.round(F.sum(F.when(hit, F.col("n"))) / F.sum("n"), 9).alias("accuracy"),
        F.round(F.sum(F.when(hit & (F.col("y_true") == 1), F.col("n"))) / F.sum(F.when(F.col("y_true") == 1, F.col("n"))), 9).alias("recall_positive"))
