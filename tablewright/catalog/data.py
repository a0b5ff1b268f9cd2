"""Queries over sources, schema rules, quality, profiling, splits and type detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.base import (
    GAPS_SQL, lineitem_with_gaps, order_hash_sql, query, stack_sql, table,
)
from tablewright.operators import profile, quality, schema, split, types
from tablewright.session import scratch_path
from tablewright.sources import artifacts, readers

# --- sources and artifact tables -------------------------------------------------

_ORDERS_CSV = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


@query("src_csv_roundtrip", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def src_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "orders") + ".csv"
    columns = [c.split()[0] for c in _ORDERS_CSV.split(", ")]
    readers.write_table(table(spark, sf_dir, "orders").select(*columns), path)
    return readers.read_table(spark, path, schema=_ORDERS_CSV)


@query("src_parquet", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty
FROM lineitem GROUP BY ALL""")
def src_parquet(spark, sf_dir):
    li = readers.read_table(spark, f"{sf_dir}/lineitem.parquet")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"))


@query("src_json_roundtrip", "SELECT event_id, user_id, event_type, value, props FROM events")
def src_json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "events") + ".jsonl"
    readers.write_table(
        table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props"), path)
    return readers.read_table(
        spark, path, schema="event_id bigint, user_id bigint, event_type string, value double, props string")


@query("src_orc_roundtrip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def src_orc_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "orders") + ".orc"
    readers.write_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return readers.read_table(spark, path)


@query("src_feather_files", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src_feather_files(spark, sf_dir):
    path = scratch_path(spark, "customer") + ".feather"
    customer = table(spark, sf_dir, "customer")
    readers.write_table(customer, path)
    return readers.read_table(spark, path, schema=customer.schema)


@query("src_chunk_counts", """
SELECT o_orderkey // 1000 AS chunk, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
FROM orders GROUP BY 1""")
def src_chunk_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.expr("o_orderkey div 1000").alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("meta_load", f"""
WITH {GAPS_SQL}
SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns,
       'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' AS column_names,
       'bigint,bigint,bigint,int,double,double,double,double,string,string,timestamp_ntz' AS dtypes,
       CAST(3 * count(*) - count(l_quantity) - count(l_extendedprice) - count(l_returnflag) AS BIGINT) AS null_count,
       round((3 * count(*) - count(l_quantity) - count(l_extendedprice) - count(l_returnflag)) * 100.0 / (count(*) * 11), 2) AS null_pct,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM gaps)) AS BIGINT) AS duplicate_rows
FROM gaps""")
def meta_load(spark, sf_dir):
    return artifacts.load_metadata(lineitem_with_gaps(spark, sf_dir))


@query("feature_table_roundtrip", """
SELECT CASE WHEN l_shipdate < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END AS split,
       count(*) AS n, round(sum(l_quantity), 2) AS sum_qty
FROM lineitem GROUP BY 1""")
def feature_table_roundtrip(spark, sf_dir):
    root = scratch_path(spark, "features")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_discount",
        F.when(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"), "train").otherwise("test").alias("split"))
    artifacts.save_feature_table(li, root, "lineitem")
    stored = artifacts.load_feature_table(spark, root, "lineitem")
    return stored.groupBy(F.col("split").cast("string").alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"))


@query("registry_latest", """
SELECT user_id, event_id, event_type, value, n_entries FROM (
  SELECT user_id, event_id, event_type, value,
         count(*) OVER (PARTITION BY user_id) AS n_entries,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1""")
def registry_latest(spark, sf_dir):
    return artifacts.latest_entries(
        table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


@query("dataset_fingerprint", """
SELECT count(*) AS n_rows,
       CAST(sum(('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR),
           o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(28,6)) AS VARCHAR), o_orderpriority)), 1, 15))::BIGINT::HUGEINT) AS VARCHAR) AS fingerprint
FROM orders""")
def dataset_fingerprint(spark, sf_dir):
    return artifacts.table_fingerprint(table(spark, sf_dir, "orders").drop("o_orderdate"))


# --- schema ----------------------------------------------------------------------

_INT_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
_REAL_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _narrow_sql(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", '{source}' AS from_type,
  CASE WHEN min({column}) >= -128 AND max({column}) <= 127 THEN 'tinyint'
       WHEN min({column}) >= -32768 AND max({column}) <= 32767 THEN 'smallint'
       WHEN min({column}) >= -2147483648 AND max({column}) <= 2147483647 THEN 'int'
       ELSE 'bigint' END AS to_type FROM lineitem"""


@query("downcast_plan", stack_sql(
    [_narrow_sql(c, "int" if c == "l_linenumber" else "bigint") for c in _INT_COLUMNS]
    + [f"SELECT '{c}', 'double', 'double'" for c in _REAL_COLUMNS]))
def downcast_plan(spark, sf_dir):
    return schema.downcast_plan(table(spark, sf_dir, "lineitem"))


@query("size_estimate", """
SELECT "column", CAST(bytes AS BIGINT) AS bytes, round(bytes / 1048576.0, 6) AS mb FROM (
  SELECT 'c_custkey' AS "column", count(*) * 8 AS bytes FROM customer
  UNION ALL SELECT 'c_name', sum(strlen(c_name)) FROM customer
  UNION ALL SELECT 'c_nationkey', count(*) * 4 FROM customer
  UNION ALL SELECT 'c_acctbal', count(*) * 8 FROM customer
  UNION ALL SELECT 'c_mktsegment', sum(strlen(c_mktsegment)) FROM customer)""")
def size_estimate(spark, sf_dir):
    return schema.size_estimate(table(spark, sf_dir, "customer"))


@query("categorical_candidates", stack_sql([
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) <= 50 AS is_categorical FROM {t}"""
    for t, c in (("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("orders", "o_orderstatus"),
                 ("orders", "o_orderpriority"), ("customer", "c_name"), ("customer", "c_mktsegment"))]))
def categorical_candidates(spark, sf_dir):
    parts = [schema.categorical_candidates(table(spark, sf_dir, t)) for t in ("lineitem", "orders", "customer")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select_numeric", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""")
def select_numeric(spark, sf_dir):
    return schema.select_kind(table(spark, sf_dir, "lineitem"), "numeric")


@query("infer_task", stack_sql([
    f"""SELECT '{c}' AS target, count(DISTINCT {c}) AS n_distinct,
        CASE WHEN count(DISTINCT {c}) <= 20 THEN 'classification' ELSE 'regression' END AS task FROM lineitem"""
    for c in ("l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice")]))
def infer_task(spark, sf_dir):
    return schema.infer_task(
        table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice"])


# --- quality ---------------------------------------------------------------------

@query("dq_size", """
SELECT 'error' AS severity, 'insufficient_features' AS rule, CAST(NULL AS VARCHAR) AS "column", CAST(1 AS DOUBLE) AS value
UNION ALL
SELECT 'error', 'insufficient_samples', NULL, CAST(n AS DOUBLE) FROM (SELECT count(*) AS n FROM labels) WHERE n < 100""")
def dq_size(spark, sf_dir):
    return quality.check_size(table(spark, sf_dir, "labels").select("quality"))


@query("dq_nulls", """
SELECT 'warning' AS severity, 'high_null_column' AS rule, 'mostly_null' AS "column",
       avg(CASE WHEN l_orderkey % 50 = 0 THEN 0.0 ELSE 1.0 END) AS value
FROM lineitem HAVING avg(CASE WHEN l_orderkey % 50 = 0 THEN 0.0 ELSE 1.0 END) > 0.95""")
def dq_nulls(spark, sf_dir):
    rare = F.when(F.col("l_orderkey") % 50 == 0, F.col("l_tax"))
    return quality.check_nulls(lineitem_with_gaps(spark, sf_dir).withColumn("mostly_null", rare)).select(
        "severity", "rule", "column", "value")


@query("dq_duplicates", """
SELECT count(*) AS n_rows, CAST(count(*) - d.n AS BIGINT) AS duplicate_rows,
       (count(*) - d.n) / count(*)::DOUBLE AS duplicate_share, (count(*) - d.n) / count(*)::DOUBLE > 0.5 AS high_duplicates
FROM lineitem, (SELECT count(*) AS n FROM (SELECT DISTINCT l_quantity, l_discount, l_returnflag FROM lineitem)) d
GROUP BY d.n""")
def dq_duplicates(spark, sf_dir):
    return quality.duplicate_summary(table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_returnflag"))


@query("dq_constant", """
SELECT 'warning' AS severity, 'constant_column' AS rule, 'fixed' AS "column", CAST(1 AS DOUBLE) AS value
UNION ALL SELECT 'warning', 'constant_column', 'nothing', CAST(0 AS DOUBLE)
UNION ALL SELECT 'warning', 'constant_column', 'l_tax', CAST(1 AS DOUBLE) FROM lineitem HAVING count(DISTINCT l_tax) <= 1""")
def dq_constant(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return quality.check_constant(li.withColumn("fixed", F.lit("x")).withColumn("nothing", F.lit(None).cast("double")))


@query("dq_cardinality", stack_sql([
    f"""SELECT 'warning' AS severity, 'high_cardinality' AS rule, '{c}' AS "column", CAST(count(DISTINCT {c}) AS DOUBLE) AS value
        FROM {t} HAVING count(DISTINCT {c}) > 100"""
    for t, c in (("documents", "text"), ("documents", "lang"), ("documents", "source"),
                 ("customer", "c_name"), ("customer", "c_mktsegment"))]))
def dq_cardinality(spark, sf_dir):
    limits = quality.Limits(max_cardinality=100)
    return quality.check_cardinality(table(spark, sf_dir, "documents"), limits).unionByName(
        quality.check_cardinality(table(spark, sf_dir, "customer"), limits))


@query("dq_target", f"""
WITH {GAPS_SQL}
SELECT count(*) AS n_rows, CAST(count(*) - count(l_returnflag) AS BIGINT) AS n_missing,
       round((count(*) - count(l_returnflag)) / count(*)::DOUBLE, 9) AS null_share, count(DISTINCT l_returnflag) AS n_classes
FROM gaps""")
def dq_target(spark, sf_dir):
    facts = quality.target_facts(lineitem_with_gaps(spark, sf_dir), "l_returnflag")
    return facts.withColumn("null_share", F.round("null_share", 9))


@query("dq_report", f"""
WITH {GAPS_SQL}
SELECT 'warning' AS severity, 'constant_column' AS rule, 'fixed' AS "column", CAST(1 AS DOUBLE) AS value
UNION ALL SELECT 'warning', 'high_null_column', 'mostly_null', round(avg(CASE WHEN l_orderkey % 50 = 0 THEN 0.0 ELSE 1.0 END), 9)
  FROM gaps HAVING avg(CASE WHEN l_orderkey % 50 = 0 THEN 0.0 ELSE 1.0 END) > 0.95
UNION ALL SELECT 'warning', 'high_duplicates', NULL, round((n - d) / n::DOUBLE, 9) FROM
  (SELECT count(*) AS n FROM gaps),
  (SELECT count(*) AS d FROM (SELECT DISTINCT l_quantity, l_returnflag, CASE WHEN l_orderkey % 50 = 0 THEN l_tax END FROM gaps))
  WHERE (n - d) / n::DOUBLE > 0.5
UNION ALL SELECT 'error', 'target_nulls', 'l_returnflag', CAST(count(*) - count(l_returnflag) AS DOUBLE) FROM gaps
  HAVING count(*) > count(l_returnflag)""")
def dq_report(spark, sf_dir):
    rare = F.when(F.col("l_orderkey") % 50 == 0, F.col("l_tax"))
    li = lineitem_with_gaps(spark, sf_dir).select(
        "l_quantity", "l_returnflag", rare.alias("mostly_null"), F.lit("x").alias("fixed"))
    return quality.quality_report(li, "l_returnflag").withColumn("value", F.round("value", 9))


@query("dq_autofix", f"""
WITH {GAPS_SQL} SELECT DISTINCT l_quantity, l_discount, l_returnflag FROM gaps""")
def dq_autofix(spark, sf_dir):
    rare = F.when(F.col("l_orderkey") % 50 == 0, F.col("l_tax"))
    li = lineitem_with_gaps(spark, sf_dir).select(
        "l_quantity", "l_discount", "l_returnflag", rare.alias("mostly_null"))
    return quality.autofix(li)


# --- profiling -------------------------------------------------------------------

_LI_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
_LI_NUMERIC = [c for c, t in _LI_TYPES.items() if t in ("bigint", "int", "double")]


@query("prof_schema", stack_sql([
    f"""SELECT CAST({i} AS BIGINT) AS position, '{c}' AS "column", '{t}' AS dtype,
        '{"numeric" if c in _LI_NUMERIC else "categorical" if t == "string" else "other"}' AS kind, count(*) AS n_rows FROM lineitem"""
    for i, (c, t) in enumerate(_LI_TYPES.items())]))
def prof_schema(spark, sf_dir):
    return profile.schema_profile(table(spark, sf_dir, "lineitem"))


def _missing_sql(columns, extra: str = "", where: str = "") -> str:
    parts = stack_sql([
        f"""SELECT '{c}' AS "column", {extra.format(t=_LI_TYPES[c])} CAST(count(*) - count({c}) AS BIGINT) AS n_missing,
            round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct FROM gaps""" for c in columns])
    return f"WITH {GAPS_SQL} SELECT * FROM ({parts}) {where}"


@query("prof_nulls", _missing_sql(_LI_TYPES))
def prof_nulls(spark, sf_dir):
    return profile.null_profile(lineitem_with_gaps(spark, sf_dir))


def _describe_sql(source: str, columns, digits: int = 4) -> list[str]:
    return [f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), {digits}) AS mean,
        round(stddev_samp({c}), {digits}) AS std, round(CAST(min({c}) AS DOUBLE), {digits}) AS min,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.25), {digits}) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), {digits}) AS p50,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.75), {digits}) AS p75, round(CAST(max({c}) AS DOUBLE), {digits}) AS max FROM {source}"""
            for c in columns]


@query("prof_describe", stack_sql(_describe_sql("lineitem", _LI_NUMERIC)))
def prof_describe(spark, sf_dir):
    return profile.describe_numeric(table(spark, sf_dir, "lineitem"))


def _top_sql(source: str, columns, n: int) -> str:
    return stack_sql([
        f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*) AS n,
            row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM {source} GROUP BY {c}) WHERE rank <= {n}"""
        for c in columns])


@query("prof_top_values", _top_sql("events", ["event_type", "props"], 10))
def prof_top_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "events"))


@query("prof_target", """
SELECT * FROM (
SELECT 'stat' AS part, 'n_unique' AS key, CAST(count(DISTINCT l_quantity) AS DOUBLE) AS value FROM lineitem
UNION ALL SELECT 'stat', 'n_missing', CAST(0 AS DOUBLE)
UNION ALL SELECT 'stat', 'mean', round(avg(l_quantity), 6) FROM lineitem
UNION ALL SELECT 'stat', 'std', round(stddev_samp(l_quantity), 6) FROM lineitem
UNION ALL SELECT 'stat', 'min', min(l_quantity) FROM lineitem
UNION ALL SELECT 'stat', 'max', max(l_quantity) FROM lineitem)
UNION ALL SELECT * FROM (SELECT 'top' AS part, CAST(l_quantity AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value
  FROM lineitem GROUP BY l_quantity ORDER BY count(*) DESC, l_quantity LIMIT 20)""")
def prof_target(spark, sf_dir):
    return profile.target_profile(table(spark, sf_dir, "lineitem"), "l_quantity")


_ORDER_TEXT = ("o_orderstatus", "o_orderpriority")


@query("prof_describe_all", stack_sql([
    f"""SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS "count", count(*) AS "unique",
        arg_min({c}, (-n, {c})) AS top, max(n) AS freq, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min,
        NULL::DOUBLE AS p25, NULL::DOUBLE AS p50, NULL::DOUBLE AS p75, NULL::DOUBLE AS max
        FROM (SELECT {c}, count(*) AS n FROM orders GROUP BY {c})""" for c in _ORDER_TEXT]
    + [f"""SELECT "column", "count", NULL::BIGINT AS "unique", NULL::VARCHAR AS top, NULL::BIGINT AS freq,
        mean, std, min, p25, p50, p75, max FROM ({s})"""
       for s in _describe_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"])]))
def prof_describe_all(spark, sf_dir):
    return profile.describe_all(table(spark, sf_dir, "orders"))


@query("prof_overview", f"""
WITH {GAPS_SQL}
SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns,
       CAST(3 * count(*) - count(l_quantity) - count(l_extendedprice) - count(l_returnflag) AS BIGINT) AS missing_cells,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM gaps)) AS BIGINT) AS duplicate_rows,
       CAST(8 AS BIGINT) AS numeric_columns, CAST(2 AS BIGINT) AS categorical_columns FROM gaps""")
def prof_overview(spark, sf_dir):
    return profile.overview(lineitem_with_gaps(spark, sf_dir))


@query("prof_dictionary", f"WITH {GAPS_SQL} " + stack_sql([
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null,
        round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS n_unique FROM gaps"""
    for c, t in _LI_TYPES.items()]))
def prof_dictionary(spark, sf_dir):
    return profile.dictionary(lineitem_with_gaps(spark, sf_dir))


@query("prof_missing", _missing_sql(_LI_TYPES, where="WHERE n_missing > 0").replace("SELECT * FROM", 'SELECT "column", missing_pct FROM'))
def prof_missing(spark, sf_dir):
    return profile.missing_share(lineitem_with_gaps(spark, sf_dir))


@query("missing_stats", _missing_sql(_LI_TYPES, "'{t}' AS dtype,", "WHERE n_missing > 0"))
def missing_stats(spark, sf_dir):
    return profile.missing_stats(lineitem_with_gaps(spark, sf_dir))


@query("prof_histogram", """
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
r AS (SELECT least(40, CAST(floor((l_extendedprice - lo) * 40 / (hi - lo)) AS BIGINT) + 1) AS bin, lo, hi FROM lineitem, b)
SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 40), 6) AS left_edge, round(lo + bin * ((hi - lo) / 40), 6) AS right_edge,
       count(*) AS n
FROM r GROUP BY bin, lo, hi""")
def prof_histogram(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query("prof_corr", f"WITH {GAPS_SQL} " + stack_sql([
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 8) AS r FROM gaps"
    for i, a in enumerate(_LI_NUMERIC) for b in _LI_NUMERIC[i + 1:]]))
def prof_corr(spark, sf_dir):
    return profile.correlation_pairs(lineitem_with_gaps(spark, sf_dir))


# --- splits and folds ------------------------------------------------------------

_H = order_hash_sql("o_orderkey")
_SPLIT_COLUMNS = ("o_orderkey", "split")


@query("split_random", f"""
SELECT o_orderkey, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + ceil(round((n - nt) * 0.1 / 0.8, 9)) THEN 'val' ELSE 'train' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_H}, o_orderkey) AS rn, count(*) OVER () AS n,
             ceil(round(count(*) OVER () * 0.2, 9)) AS nt FROM orders)""")
def split_random(spark, sf_dir):
    return split.random_split(table(spark, sf_dir, "orders"), "o_orderkey").select(*_SPLIT_COLUMNS)


@query("split_stratified", f"""
SELECT o_orderkey, o_orderstatus, CASE WHEN rn <= nt THEN 'test'
       WHEN rn <= nt + floor(round((n - nt) * 0.1 / 0.8, 9) + 0.5) THEN 'val' ELSE 'train' END AS split
FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H}, o_orderkey) AS rn,
             count(*) OVER (PARTITION BY o_orderstatus) AS n,
             floor(round(count(*) OVER (PARTITION BY o_orderstatus) * 0.2, 9) + 0.5) AS nt FROM orders)""")
def split_stratified(spark, sf_dir):
    return split.stratified_split(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus").select(
        "o_orderkey", "o_orderstatus", "split")


@query("split_time", """
SELECT o_orderkey, CASE WHEN rn <= n - nt - nv THEN 'train' WHEN rn <= n - nt THEN 'val' ELSE 'test' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n,
             floor(round(count(*) OVER () * 0.2, 9)) AS nt, floor(round(count(*) OVER () * 0.1, 9)) AS nv FROM orders)""")
def split_time(spark, sf_dir):
    return split.time_split(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").select(*_SPLIT_COLUMNS)


@query("split_group", f"""
WITH g AS (SELECT DISTINCT o_custkey FROM orders),
r AS (SELECT o_custkey, row_number() OVER (ORDER BY {order_hash_sql("o_custkey")}, o_custkey) AS rn, count(*) OVER () AS n FROM g)
SELECT o_orderkey, o_custkey, CASE WHEN rn <= ceil(round(n * 0.2, 9)) THEN 'test' ELSE 'train' END AS split
FROM orders JOIN r USING (o_custkey)""")
def split_group(spark, sf_dir):
    return split.group_split(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select(
        "o_orderkey", "o_custkey", "split")


def _fold_sql(partition: str, extra: str = "") -> str:
    over = f"PARTITION BY {partition}" if partition else ""
    return f"""
SELECT o_orderkey, {extra} CAST(CASE WHEN rn <= (n % 5) * (n // 5 + 1) THEN (rn - 1) // (n // 5 + 1)
       ELSE (n % 5) + (rn - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold
FROM (SELECT *, row_number() OVER ({over} ORDER BY {_H}, o_orderkey) AS rn, count(*) OVER ({over}) AS n FROM orders)"""


@query("folds_kfold", _fold_sql(""))
def folds_kfold(spark, sf_dir):
    return split.kfold(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "fold")


@query("folds_stratified", _fold_sql("o_orderstatus", "o_orderstatus,"))
def folds_stratified(spark, sf_dir):
    return split.stratified_kfold(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus").select(
        "o_orderkey", "o_orderstatus", "fold")


# --- semantic types --------------------------------------------------------------

_DETECT = {
    "lineitem": [(c, "datetime" if t == "timestamp_ntz" else "text" if t == "string" else "numeric") for c, t in _LI_TYPES.items()],
    "orders": [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "target"), ("o_totalprice", "numeric"),
               ("o_orderdate", "datetime"), ("o_orderpriority", "text"), ("date_text", "text"), ("is_late", "numeric")],
    "customer": [("c_custkey", "numeric"), ("c_name", "text"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"),
                 ("c_mktsegment", "text")],
    "documents": [("doc_id", "numeric"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "numeric")],
}


def _type_sql(name: str, column: str, kind: str) -> str:
    source = name
    if name == "orders":
        source = """(SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS date_text,
            CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS is_late FROM orders)"""
    d, n = f"count(DISTINCT {column})", f"count({column})"
    ident = f"{d} >= 0.95 * {n} AND {d} > 100"
    if kind == "target":
        rule = "max('target')"
    elif kind == "datetime":
        rule = f"CASE WHEN {d} <= 1 THEN 'constant' ELSE 'datetime' END"
    elif kind == "numeric":
        rule = f"""CASE WHEN {d} <= 1 THEN 'constant' WHEN bool_and({column} IN (0, 1)) THEN 'boolean' WHEN {ident} THEN 'id'
            WHEN bool_and({column} = floor({column})) AND {d} <= 50 THEN 'numeric_discrete' ELSE 'numeric_continuous' END"""
    else:
        rule = f"""CASE WHEN {d} <= 1 THEN 'constant' WHEN avg(CASE WHEN TRY_CAST({column} AS TIMESTAMP) IS NULL THEN 0 ELSE 1 END) >= 0.8 THEN 'datetime'
            WHEN {ident} THEN 'id' WHEN avg(length({column})) > 20 AND {d} > 50 THEN 'text'
            WHEN {d} <= 50 THEN 'categorical_low' ELSE 'categorical_high' END"""
    return f"SELECT '{name}' AS \"table\", '{column}' AS \"column\", {rule} AS semantic_type FROM {source}"


@query("type_detect", stack_sql([_type_sql(t, c, k) for t, cs in _DETECT.items() for c, k in cs]))
def type_detect(spark, sf_dir):
    result = None
    for name in _DETECT:
        df = table(spark, sf_dir, name)
        if name == "orders":
            df = df.withColumn("date_text", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn(
                "is_late", (F.col("o_orderstatus") == "P").cast("int"))
        found = types.detect_types(df, "o_orderstatus" if name == "orders" else None).select(
            F.lit(name).alias("table"), "column", "semantic_type")
        result = found if result is None else result.unionByName(found)
    return result
