"""Queries over imputation, dates, text, encoding, scaling, generation and selection."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tablewright.catalog.base import GAPS_SQL, hash_sql, lineitem_with_gaps, query, stack_sql, table
from tablewright.operators import dates, encode, generate, impute, scale, select, text
from tablewright.operators.lookup import LookupTable
from tablewright.operators.schema import small_frame
from tablewright.plans.features import FeatureOptions, fit_features
from tablewright.session import scratch_path
from tablewright.sources.stored_plans import load_plan, save_plan

# --- imputation ------------------------------------------------------------------


def _numbers(df, *columns, digits=6):
    return df.select("l_orderkey", *[F.round(c, digits).alias(c) for c in columns])


def _impute_sql(q: str, p: str) -> str:
    return f"""
WITH {GAPS_SQL}
SELECT l_orderkey, round(coalesce(l_quantity, {q}), 6) AS l_quantity, round(coalesce(l_extendedprice, {p}), 6) AS l_extendedprice
FROM gaps"""


@query("impute_mean", _impute_sql("(SELECT avg(l_quantity) FROM gaps)", "(SELECT avg(l_extendedprice) FROM gaps)"))
def impute_mean(spark, sf_dir):
    li = lineitem_with_gaps(spark, sf_dir)
    fitted = impute.fit_fill(li, "mean", columns=["l_quantity", "l_extendedprice"])
    return _numbers(fitted.transform(li), "l_quantity", "l_extendedprice")


@query("impute_median", _impute_sql("(SELECT median(l_quantity) FROM gaps)", "(SELECT median(l_extendedprice) FROM gaps)"))
def impute_median(spark, sf_dir):
    li = lineitem_with_gaps(spark, sf_dir)
    fitted = impute.fit_fill(li, "median", columns=["l_quantity", "l_extendedprice"])
    return _numbers(fitted.transform(li), "l_quantity", "l_extendedprice")


@query("impute_zero", _impute_sql("0", "0"))
def impute_zero(spark, sf_dir):
    li = lineitem_with_gaps(spark, sf_dir)
    fitted = impute.fit_fill(li, "zero", columns=["l_quantity", "l_extendedprice"])
    return _numbers(fitted.transform(li), "l_quantity", "l_extendedprice")


@query("impute_constant", _impute_sql("-1", "-1"))
def impute_constant(spark, sf_dir):
    li = lineitem_with_gaps(spark, sf_dir)
    fitted = impute.fit_fill(li, "constant", fill_value=-1, columns=["l_quantity", "l_extendedprice"])
    return _numbers(fitted.transform(li), "l_quantity", "l_extendedprice")


_ORDER_GAPS = """
WITH og AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority,
                   CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS o_orderstatus FROM orders)
"""


def _orders_with_gaps(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))


def _mode_sql(c: str) -> str:
    return f"(SELECT {c} FROM og WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("impute_mode", f"""{_ORDER_GAPS}
SELECT o_orderkey, coalesce(o_orderpriority, {_mode_sql("o_orderpriority")}) AS o_orderpriority,
       coalesce(o_orderstatus, {_mode_sql("o_orderstatus")}) AS o_orderstatus FROM og""")
def impute_mode(spark, sf_dir):
    orders = _orders_with_gaps(spark, sf_dir)
    return impute.fit_fill(orders, columns=["o_orderpriority", "o_orderstatus"]).transform(orders)


@query("impute_cat_constant", f"""{_ORDER_GAPS}
SELECT o_orderkey, coalesce(o_orderpriority, 'MISSING') AS o_orderpriority, coalesce(o_orderstatus, 'MISSING') AS o_orderstatus FROM og""")
def impute_cat_constant(spark, sf_dir):
    orders = _orders_with_gaps(spark, sf_dir)
    return impute.fit_fill(orders, categorical="constant", columns=["o_orderpriority", "o_orderstatus"]).transform(orders)


@query("impute_indicator", f"""
WITH {GAPS_SQL}
SELECT l_orderkey, coalesce(l_quantity, 0) AS l_quantity, coalesce(l_extendedprice, 0) AS l_extendedprice, l_discount,
       CASE WHEN l_quantity IS NULL THEN 1 ELSE 0 END AS l_quantity__missing,
       CASE WHEN l_extendedprice IS NULL THEN 1 ELSE 0 END AS l_extendedprice__missing FROM gaps""")
def impute_indicator(spark, sf_dir):
    li = lineitem_with_gaps(spark, sf_dir).select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
    return impute.fit_fill(li, "zero", columns=["l_quantity", "l_extendedprice", "l_discount"], add_indicator=True).transform(li)


@query("impute_nulls_remaining", f"""
WITH {GAPS_SQL}
SELECT CAST(count(*) FILTER (l_quantity IS NULL) + count(*) FILTER (l_extendedprice IS NULL) + count(*) FILTER (l_returnflag IS NULL) AS BIGINT) AS nulls_before,
       CAST(count(*) FILTER (l_returnflag IS NULL) AS BIGINT) AS nulls_after FROM gaps""")
def impute_nulls_remaining(spark, sf_dir):
    """What numeric imputation leaves: the gaps of the text column."""
    columns = ["l_quantity", "l_extendedprice", "l_returnflag"]
    li = lineitem_with_gaps(spark, sf_dir).select("l_orderkey", *columns)
    filled = impute.fit_fill(li, "mean", "none", columns=columns).transform(li)
    rows = [(impute.nulls_remaining(li, columns), impute.nulls_remaining(filled, columns))]
    return small_frame(spark, rows, "nulls_before bigint, nulls_after bigint")


def _parts_with_gaps(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.when(key % 5 != 0, F.col("p_size")).cast("double").alias("size"),
        F.when(key % 7 != 0, F.col("p_retailprice")).alias("price"),
        F.substring("p_brand", 7, 3).cast("double").alias("brand"))


def _knn_sql(target: str) -> str:
    shared = [c for c in ("size", "price", "brand") if c != target]
    gap = [f"(q.{c} - d.{c}) * (q.{c} - d.{c})" for c in shared]
    both = [f"(q.{c} IS NOT NULL AND d.{c} IS NOT NULL)::INT" for c in shared]
    return f"""(SELECT p_partkey, avg(v) AS fill FROM (
      SELECT q.p_partkey, d.{target} AS v, row_number() OVER (PARTITION BY q.p_partkey ORDER BY
        (3.0::DOUBLE / ({' + '.join(both)})) * ({' + '.join(f'coalesce({g}, 0)' for g in gap)}), d.{target}) AS rn
      FROM pg q JOIN pg d ON q.{target} IS NULL AND d.{target} IS NOT NULL AND {' + '.join(both)} > 0
    ) WHERE rn <= 5 GROUP BY p_partkey)"""


@query("impute_knn", f"""
WITH pg AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_size END::DOUBLE AS size,
                   CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price, substr(p_brand, 7, 3)::DOUBLE AS brand FROM part)
SELECT p_partkey, round(coalesce(size, s.fill), 6) AS size, round(coalesce(price, p.fill), 6) AS price, brand
FROM pg LEFT JOIN {_knn_sql("size")} s USING (p_partkey) LEFT JOIN {_knn_sql("price")} p USING (p_partkey)""")
def impute_knn(spark, sf_dir):
    part = _parts_with_gaps(spark, sf_dir)
    fitted = impute.fit_neighbours(part, ["size", "price", "brand"])
    return fitted.transform(part).select("p_partkey", F.round("size", 6).alias("size"), F.round("price", 6).alias("price"), "brand")


@query("impute_iterative", f"""
WITH {GAPS_SQL}
SELECT l_orderkey, l_linenumber, round(coalesce(l_extendedprice, (SELECT regr_intercept(l_extendedprice, l_linenumber) + 0 FROM gaps)
       + (SELECT regr_slope(l_extendedprice, l_linenumber) FROM gaps) * l_linenumber), 2) AS l_extendedprice FROM gaps""")
def impute_iterative(spark, sf_dir):
    li = lineitem_with_gaps(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_extendedprice")
    fitted = impute.fit_chained(li, ["l_linenumber", "l_extendedprice"])
    return fitted.transform(li).select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"),
                                       F.round("l_extendedprice", 2).alias("l_extendedprice"))


# --- dates -----------------------------------------------------------------------

_PARTS_SQL = {
    "year": "year({t})", "month": "month({t})", "day": "day({t})", "hour": "hour({t})", "minute": "minute({t})",
    "second": "second({t})", "dayofweek": "isodow({t}) - 1", "quarter": "quarter({t})", "weekofyear": "week({t})",
    "dayofyear": "dayofyear({t})", "days_in_month": "day(last_day({t}))",
    "is_weekend": "CASE WHEN isodow({t}) >= 6 THEN 1 ELSE 0 END",
    "is_month_start": "CASE WHEN day({t}) = 1 THEN 1 ELSE 0 END",
    "is_month_end": "CASE WHEN {t}::DATE = last_day({t}) THEN 1 ELSE 0 END",
    "is_quarter_start": "CASE WHEN {t}::DATE = date_trunc('quarter', {t})::DATE THEN 1 ELSE 0 END",
    "is_quarter_end": "CASE WHEN {t}::DATE = (date_trunc('quarter', {t}) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE THEN 1 ELSE 0 END",
}


def _part_columns(t: str, names, cyclical: bool = False) -> str:
    out = []
    for n in names:
        expression = _PARTS_SQL[n].format(t=t)
        out.append(f"CAST({expression} AS INTEGER) AS {t}_{n}")
        if cyclical and n in dates.PERIODS:
            angle = f"({2.0 * math.pi!r} * ({expression}) / {dates.PERIODS[n]}.0)"
            out += [f"round(sin({angle}), 9) AS {t}_{n}_sin", f"round(cos({angle}), 9) AS {t}_{n}_cos"]
    return ", ".join(out)


def _rounded_cycles(df):
    return df.select(*[F.round(c, 9).alias(c) if c.endswith(("_sin", "_cos")) else F.col(c) for c in df.columns])


@query("dt_parse", """
SELECT event_id, TRY_CAST(CASE WHEN event_id % 9 = 0 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS parsed
FROM events""")
def dt_parse(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, "not a date").otherwise(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).alias("raw"))
    return raw.select("event_id", dates.parse_datetime(F.col("raw")).cast("timestamp_ntz").alias("parsed"))


_PLAIN_PARTS = ("year", "month", "day", "hour", "minute", "second", "dayofweek", "quarter", "weekofyear", "dayofyear", "days_in_month")
_FLAG_PARTS = ("is_weekend", "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end")


@query("dt_parts", f"SELECT event_id, {_part_columns('ts', _PLAIN_PARTS)} FROM events")
def dt_parts(spark, sf_dir):
    return dates.date_features(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts"], _PLAIN_PARTS, cyclical=False)


@query("dt_flags", f"SELECT o_orderkey, {_part_columns('o_orderdate', _FLAG_PARTS)} FROM orders")
def dt_flags(spark, sf_dir):
    return dates.date_features(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"],
                               _FLAG_PARTS, cyclical=False)


@query("dt_cyclical", f"SELECT event_id, {_part_columns('ts', list(dates.PERIODS), True)} FROM events")
def dt_cyclical(spark, sf_dir):
    return _rounded_cycles(dates.date_features(
        table(spark, sf_dir, "events").select("event_id", "ts"), ["ts"], list(dates.PERIODS)))


@query("dt_default_set", f"SELECT o_orderkey, {_part_columns('o_orderdate', dates.DEFAULT_PARTS, True)} FROM orders")
def dt_default_set(spark, sf_dir):
    return _rounded_cycles(dates.date_features(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")))


@query("dt_autodetect", """
SELECT 'o_orderstatus' AS "column", avg(CASE WHEN TRY_CAST(o_orderstatus AS TIMESTAMP) IS NULL THEN 0.0 ELSE 1.0 END) AS parse_share, false AS is_datetime FROM orders
UNION ALL SELECT 'o_orderpriority', 0.0::DOUBLE, false UNION ALL SELECT 'o_orderdate', 1.0::DOUBLE, true
UNION ALL SELECT 'raw', round(avg(CASE WHEN o_orderkey % 9 = 0 THEN 0.0 ELSE 1.0 END), 9), avg(CASE WHEN o_orderkey % 9 = 0 THEN 0.0 ELSE 1.0 END) >= 0.8 FROM orders""")
def dt_autodetect(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("raw", F.when(F.col("o_orderkey") % 9 == 0, "unknown").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")))
    return dates.detect_date_columns(orders).withColumn("parse_share", F.round("parse_share", 9))


# --- text ------------------------------------------------------------------------

_WORDS_SQL = r"words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents)"
_GRAMS_SQL = _WORDS_SQL + """,
grams AS (SELECT doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words),
occ AS (SELECT doc_id, unnest(g) AS term FROM grams)"""
_VOCAB_SQL = _GRAMS_SQL + """,
terms AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM occ GROUP BY term HAVING count(DISTINCT doc_id) >= 2),
vocab AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS position FROM (SELECT * FROM terms ORDER BY n DESC, term LIMIT 500))"""
_COUNT_SQL = _VOCAB_SQL + ", tf AS (SELECT doc_id, term, df, count(*) AS n FROM occ JOIN vocab USING (term) GROUP BY ALL)"


@query("txt_tokens", f"WITH {_WORDS_SQL} SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM words")
def txt_tokens(spark, sf_dir):
    worded = text.with_tokens(table(spark, sf_dir, "documents"), "text")
    return worded.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("txt_ngrams", f"WITH {_GRAMS_SQL} SELECT doc_id, len(g) AS n_grams, md5(array_to_string(g, '|')) AS digest FROM grams")
def txt_ngrams(spark, sf_dir):
    worded = text.with_tokens(table(spark, sf_dir, "documents"), "text")
    grams = worded.withColumn("g", text.ngrams(F.col("tokens")))
    return grams.select("doc_id", F.size("g").cast("bigint").alias("n_grams"), F.md5(F.array_join("g", "|")).alias("digest"))


@query("txt_vocab", f"WITH {_VOCAB_SQL} SELECT term, n, df, CAST(position AS INTEGER) AS position FROM vocab")
def txt_vocab(spark, sf_dir):
    return text.vocabulary(table(spark, sf_dir, "documents"), "text")


@query("txt_count", f"WITH {_COUNT_SQL} SELECT doc_id, term, n AS value FROM tf")
def txt_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return text.fit_text(docs, "text").counts(docs, "doc_id")


@query("txt_tfidf", f"""WITH {_COUNT_SQL},
w AS (SELECT doc_id, term, n * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0) AS w FROM tf)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS value FROM w""")
def txt_tfidf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return text.fit_text(docs, "text").tfidf(docs, "doc_id").withColumn("value", F.round("value", 9))


@query("txt_hashing", f"""WITH {_GRAMS_SQL}, slots AS (SELECT doc_id, {hash_sql("term")} % 100 AS slot, count(*) AS n FROM occ GROUP BY ALL)
SELECT doc_id, slot, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS value FROM slots""")
def txt_hashing(spark, sf_dir):
    hashed = text.hashing_counts(table(spark, sf_dir, "documents"), "doc_id", "text", slots=100)
    return hashed.withColumn("value", F.round("value", 9))


@query("txt_autodetect", stack_sql([
    f"""SELECT '{c}' AS "column", round(avg(length({c})), 6) AS mean_length, avg(length({c})) > 20 AS is_text FROM {t}"""
    for t, c in (("documents", "text"), ("documents", "lang"), ("documents", "source"), ("customer", "c_name"), ("customer", "c_mktsegment"))]))
def txt_autodetect(spark, sf_dir):
    found = text.detect_text_columns(table(spark, sf_dir, "documents")).unionByName(
        text.detect_text_columns(table(spark, sf_dir, "customer")))
    return found.withColumn("mean_length", F.round("mean_length", 6))


# --- encoding --------------------------------------------------------------------

@query("enc_route", stack_sql([
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct, CASE WHEN count(DISTINCT {c}) > 20 THEN 'high' ELSE 'low' END AS route FROM part"""
    for c in ("p_name", "p_brand", "p_type")]))
def enc_route(spark, sf_dir):
    return encode.route_columns(table(spark, sf_dir, "part"))


@query("enc_onehot", """
SELECT l_orderkey, l_quantity, (l_returnflag = 'A')::INTEGER AS l_returnflag_A, (l_returnflag = 'N')::INTEGER AS l_returnflag_N,
       (l_returnflag = 'R')::INTEGER AS l_returnflag_R, (l_linestatus = 'F')::INTEGER AS l_linestatus_F, (l_linestatus = 'O')::INTEGER AS l_linestatus_O
FROM lineitem""")
def enc_onehot(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus")
    return encode.fit_encoder(li, ["l_returnflag", "l_linestatus"], "onehot").transform(li)


def _known_orders(spark, sf_dir):
    """Fit on orders before 2000, so that later priorities of the made-up code are unseen."""
    orders = table(spark, sf_dir, "orders").withColumn(
        "clerk", F.concat(F.lit("c"), (F.col("o_custkey") % 400).cast("string")))
    return orders.where(F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")), orders.select("o_orderkey", "o_orderpriority", "clerk")


_KNOWN_SQL = """
o AS (SELECT *, 'c' || (o_custkey % 400)::VARCHAR AS clerk FROM orders),
known AS (SELECT * FROM o WHERE o_orderdate < TIMESTAMP '1995-06-01')"""


def _place_sql(c: str) -> str:
    return f"(SELECT {c}, row_number() OVER (ORDER BY {c}) AS place FROM (SELECT DISTINCT {c} FROM known))"


@query("enc_ordinal", f"""WITH {_KNOWN_SQL}
SELECT o_orderkey, CAST(coalesce(p.place - 1, -1) AS INTEGER) AS o_orderpriority, CAST(coalesce(k.place - 1, -1) AS INTEGER) AS clerk
FROM o LEFT JOIN {_place_sql("o_orderpriority")} p USING (o_orderpriority) LEFT JOIN {_place_sql("clerk")} k USING (clerk)""")
def enc_ordinal(spark, sf_dir):
    known, orders = _known_orders(spark, sf_dir)
    return encode.fit_encoder(known, ["o_orderpriority", "clerk"], "ordinal").transform(orders)


@query("enc_binary", f"""WITH {_KNOWN_SQL}
SELECT o_orderkey, CAST((coalesce(p.place, 0) >> 2) & 1 AS INTEGER) AS o_orderpriority_0, CAST((coalesce(p.place, 0) >> 1) & 1 AS INTEGER) AS o_orderpriority_1,
       CAST(coalesce(p.place, 0) & 1 AS INTEGER) AS o_orderpriority_2
FROM o LEFT JOIN {_place_sql("o_orderpriority")} p USING (o_orderpriority)""")
def enc_binary(spark, sf_dir):
    known, orders = _known_orders(spark, sf_dir)
    return encode.fit_encoder(known, ["o_orderpriority"], "binary").transform(orders.drop("clerk"))


@query("enc_frequency", f"""WITH {_KNOWN_SQL}
SELECT o_orderkey, round(coalesce(p.n::DOUBLE / (SELECT count(*) FROM known), 0.0), 9) AS o_orderpriority,
       round(coalesce(k.n::DOUBLE / (SELECT count(*) FROM known), 0.0), 9) AS clerk
FROM o LEFT JOIN (SELECT o_orderpriority, count(*) AS n FROM known GROUP BY 1) p USING (o_orderpriority)
       LEFT JOIN (SELECT clerk, count(*) AS n FROM known GROUP BY 1) k USING (clerk)""")
def enc_frequency(spark, sf_dir):
    known, orders = _known_orders(spark, sf_dir)
    coded = encode.fit_encoder(known, ["o_orderpriority", "clerk"], "frequency").transform(orders)
    return coded.select("o_orderkey", F.round("o_orderpriority", 9).alias("o_orderpriority"), F.round("clerk", 9).alias("clerk"))


@query("enc_hashing", f"""
SELECT o_orderkey, {', '.join(f"CAST((a = {i})::INT + (b = {i})::INT AS INTEGER) AS hash_{i}" for i in range(16))}
FROM (SELECT o_orderkey, {hash_sql("o_orderpriority")} % 16 AS a, {hash_sql("o_orderstatus")} % 16 AS b FROM orders)""")
def enc_hashing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return encode.fit_encoder(orders, ["o_orderpriority", "o_orderstatus"], "hashing").transform(orders)


def _li_binary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_suppkey").cast("string").alias("supplier"), "l_linestatus",
        (F.col("l_returnflag") == "R").cast("int").alias("y"))


_BIN_SQL = """b AS (SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS supplier, l_linestatus, (l_returnflag = 'R')::INTEGER AS y FROM lineitem),
t AS (SELECT avg(y) AS prior, sum(y) AS p, count(*) - sum(y) AS q FROM b)"""


def _by_category_sql(code: str) -> str:
    parts = [f"""(SELECT {c}, {code} AS code FROM b, t GROUP BY {c}, prior, p, q) {a}""" for a, c in (("s", "supplier"), ("l", "l_linestatus"))]
    return f"""WITH {_BIN_SQL} SELECT l_orderkey, y, round(s.code, 9) AS supplier, round(l.code, 9) AS l_linestatus
FROM b JOIN {parts[0]} USING (supplier) JOIN {parts[1]} USING (l_linestatus)"""


@query("enc_target", _by_category_sql(
    "prior * (1 - 1 / (1 + exp(-(count(*) - 20) / 10.0))) + avg(y) * (1 / (1 + exp(-(count(*) - 20) / 10.0)))"))
def enc_target(spark, sf_dir):
    li = _li_binary(spark, sf_dir)
    coded = encode.fit_encoder(li, ["supplier", "l_linestatus"], "target", "y").transform(li)
    return coded.select("l_orderkey", "y", F.round("supplier", 9).alias("supplier"), F.round("l_linestatus", 9).alias("l_linestatus"))


@query("enc_woe", _by_category_sql("ln(((sum(y) + 1.0) / (p + 2.0)) / ((count(*) - sum(y) + 1.0) / (q + 2.0)))"))
def enc_woe(spark, sf_dir):
    li = _li_binary(spark, sf_dir)
    coded = encode.fit_encoder(li, ["supplier", "l_linestatus"], "woe", "y").transform(li)
    return coded.select("l_orderkey", "y", F.round("supplier", 9).alias("supplier"), F.round("l_linestatus", 9).alias("l_linestatus"))


@query("enc_lookup_salted", """
SELECT l_orderkey, l_partkey, count(*) OVER (PARTITION BY l_partkey) AS part_rows FROM lineitem""")
def enc_lookup_salted(spark, sf_dir):
    """The join used for category tables too large to broadcast."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    counts = li.groupBy(F.col("l_partkey").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    fitted = LookupTable.build(counts, broadcast_rows=0)
    return fitted.join(li, "l_partkey", ["n"], "", broadcast_rows=0).withColumnRenamed("n", "part_rows")


# --- scaling ---------------------------------------------------------------------

_SCALED = ("l_quantity", "l_extendedprice", "l_discount")


def _scale_sql(centre: str, width: str) -> str:
    columns = ", ".join(
        f"round(({c} - (SELECT {centre.format(c=c)} FROM lineitem)) / coalesce(nullif((SELECT {width.format(c=c)} FROM lineitem), 0), 1), 6) AS {c}"
        for c in _SCALED)
    return f"SELECT l_orderkey, {columns} FROM lineitem"


def _scaled(spark, sf_dir, strategy):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *_SCALED)
    return _numbers(scale.fit_scaler(li, strategy, _SCALED).transform(li), *_SCALED)


@query("scale_standard", _scale_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")


@query("scale_minmax", _scale_sql("min({c})", "max({c}) - min({c})"))
def scale_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


@query("scale_robust", _scale_sql("median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def scale_robust(spark, sf_dir):
    return _scaled(spark, sf_dir, "robust")


@query("scale_maxabs", _scale_sql("0.0", "max(abs({c}))").replace("SELECT 0.0 FROM lineitem", "SELECT 0.0"))
def scale_maxabs(spark, sf_dir):
    return _scaled(spark, sf_dir, "maxabs")


@query("scale_power")
def scale_power(spark, sf_dir):
    return _scaled(spark, sf_dir, "power")


@query("scale_power_fixed", """
SELECT l_orderkey, round((pow(l_quantity - 25 + 1, 0.5) - 1) / 0.5, 6) AS l_quantity FROM lineitem WHERE l_quantity >= 25
UNION ALL SELECT l_orderkey, round(-(pow(-(l_quantity - 25) + 1, 1.5) - 1) / 1.5, 6) FROM lineitem WHERE l_quantity < 25""")
def scale_power_fixed(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", F.round(scale.yeo_johnson(F.col("l_quantity") - 25, 0.5), 6).alias("l_quantity"))


@query("scale_quantile")
def scale_quantile(spark, sf_dir):
    return _scaled(spark, sf_dir, "quantile")


def _share_sql(c: str, g: str) -> str:
    def side(test: str) -> str:
        at = f"least(greatest(len(list_filter({g}, lambda e: e {test} {c})) - 1, 0), 9)"
        return f"({at} + coalesce(least(greatest(({c} - {g}[{at} + 1]) / nullif({g}[{at} + 2] - {g}[{at} + 1], 0), 0), 1), 0)) / 10.0"
    return f"round(CASE WHEN {c} <= {g}[1] THEN 0.0 WHEN {c} >= {g}[11] THEN 1.0 ELSE ({side('<=')} + {side('<')}) / 2 END, 6) AS {c}"


@query("scale_quantile_uniform", f"""
WITH g AS (SELECT quantile_cont(l_extendedprice, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS gp,
                  quantile_cont(l_quantity, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS gq FROM lineitem)
SELECT l_orderkey, {_share_sql("l_extendedprice", "gp")}, {_share_sql("l_quantity", "gq")} FROM lineitem, g""")
def scale_quantile_uniform(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity")
    fitted = scale.fit_quantile(li, ["l_extendedprice", "l_quantity"], n=11, normal=False)
    return _numbers(fitted.transform(li), "l_extendedprice", "l_quantity")


@query("scale_inverse", "SELECT l_orderkey, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount FROM lineitem")
def scale_inverse(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *_SCALED)
    fitted = scale.fit_scaler(li, "standard", _SCALED)
    return _numbers(fitted.inverse_transform(fitted.transform(li)), *_SCALED)


# --- generation ------------------------------------------------------------------

@query("gen_poly", """
SELECT l_orderkey, round(l_quantity * l_quantity, 4) AS "poly__l_quantity^2", round(l_quantity * l_discount, 4) AS "poly__l_quantity l_discount",
       round(l_discount * l_discount, 4) AS "poly__l_discount^2" FROM lineitem""")
def gen_poly(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    out = generate.generate_features(li, ["l_quantity", "l_discount"])
    return out.select("l_orderkey", *[F.round(f"`{c}`", 4).alias(c) for c in out.columns if c.startswith("poly__")])


@query("gen_ratio", """
SELECT l_orderkey, round(coalesce(l_quantity / nullif(l_discount, 0), 0), 4) AS ratio__l_quantity__l_discount,
       round(coalesce(l_quantity / nullif(l_tax, 0), 0), 4) AS ratio__l_quantity__l_tax,
       round(coalesce(l_discount / nullif(l_tax, 0), 0), 4) AS ratio__l_discount__l_tax FROM lineitem""")
def gen_ratio(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax")
    out = generate.generate_features(li, ["l_quantity", "l_discount", "l_tax"])
    return out.select("l_orderkey", *[F.round(c, 4).alias(c) for c in out.columns if c.startswith("ratio__")])


# --- selection -------------------------------------------------------------------

_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query("sel_variance", stack_sql([
    f"""SELECT '{c}' AS "column", round(var_pop({e}), 4) AS variance, var_pop({e}) > 0 AS keep FROM lineitem"""
    for c, e in (("l_quantity", "l_quantity"), ("l_tax", "l_tax"), ("gap", "CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE l_quantity END"), ("one", "1"))]))
def sel_variance(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_tax", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("gap"), F.lit(1).alias("one"))
    return select.variances(li).withColumn("variance", F.round("variance", 4))


@query("sel_correlation", """
SELECT 'price_twice' AS "column" WHERE (SELECT abs(corr(l_extendedprice, l_extendedprice * 2 + l_quantity)) FROM lineitem) > 0.95
UNION ALL SELECT 'net' WHERE (SELECT greatest(abs(corr(l_extendedprice, l_extendedprice * (1 - l_discount))), abs(corr(l_quantity, l_extendedprice * (1 - l_discount)))) FROM lineitem) > 0.95
UNION ALL SELECT 'l_extendedprice' WHERE (SELECT abs(corr(l_quantity, l_extendedprice)) FROM lineitem) > 0.95""")
def sel_correlation(spark, sf_dir):
    price = F.col("l_extendedprice")
    li = table(spark, sf_dir, "lineitem").select(
        "l_quantity", price, (price * 2 + F.col("l_quantity")).alias("price_twice"), (price * (1 - F.col("l_discount"))).alias("net"))
    dropped = select.correlated_columns(li, ["l_quantity", "l_extendedprice", "price_twice", "net"])
    return spark.createDataFrame([(c,) for c in dropped], "column string")


def _anova_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, round((sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), 6) AS score
FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) * count(*) AS ss, (SELECT avg({c}) FROM lineitem) AS gm FROM lineitem GROUP BY l_returnflag)"""


@query("sel_f_classif", stack_sql([_anova_sql(c) for c in _FEATURES]))
def sel_f_classif(spark, sf_dir):
    scores = select.anova_scores(table(spark, sf_dir, "lineitem"), _FEATURES, "l_returnflag")
    return scores.withColumn("score", F.round("score", 6))


@query("sel_f_regression", stack_sql([
    f"""SELECT '{c}' AS feature, round(pow(corr({c}, l_extendedprice), 2) / (1 - pow(corr({c}, l_extendedprice), 2)) * (count(*) - 2), 4) AS score FROM lineitem"""
    for c in ("l_quantity", "l_discount", "l_tax")]))
def sel_f_regression(spark, sf_dir):
    scores = select.regression_scores(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return scores.withColumn("score", F.round("score", 4))


def _bin_sql(c: str, e: str) -> str:
    return f"(SELECT count(*) FROM (SELECT DISTINCT unnest({e}) AS e) WHERE e < {c})"


def _mi_sql(features, label: str, binned_label: bool) -> str:
    deciles = "[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]"
    label_expression = f"CAST(len(list_filter(list_distinct(ey), lambda e: e < {label})) AS VARCHAR)" if binned_label else label
    ey = f"quantile_cont({label}, {deciles})" if binned_label else "NULL"
    joint = stack_sql([f"""SELECT '{c}' AS feature, len(list_filter(list_distinct(e), lambda e: e < {c})) AS bin, {label_expression} AS label, count(*)::DOUBLE AS n
      FROM lineitem, (SELECT quantile_cont({c}, {deciles}) AS e, {ey} AS ey FROM lineitem) GROUP BY ALL""" for c in features])
    return f"""WITH j AS ({joint}), t AS (SELECT feature, sum(n) AS total FROM j GROUP BY 1),
b AS (SELECT feature, bin, sum(n) AS nb FROM j GROUP BY ALL), l AS (SELECT feature, label, sum(n) AS nl FROM j GROUP BY ALL)
SELECT feature, round(greatest(sum(n / total * ln(n * total / (nb * nl))), 0), 9) AS score
FROM j JOIN t USING (feature) JOIN b USING (feature, bin) JOIN l USING (feature, label) GROUP BY feature"""


_MI_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("sel_mi_classif", _mi_sql(_MI_FEATURES, "l_returnflag", False))
def sel_mi_classif(spark, sf_dir):
    scores = select.mutual_information(table(spark, sf_dir, "lineitem"), _MI_FEATURES, "l_returnflag")
    return scores.withColumn("score", F.round("score", 9))


@query("sel_mi_regression", _mi_sql(("l_quantity", "l_discount", "l_tax"), "l_extendedprice", True))
def sel_mi_regression(spark, sf_dir):
    scores = select.mutual_information(
        table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", regression=True)
    return scores.withColumn("score", F.round("score", 9))


@query("sel_topk", "SELECT * FROM (" + _mi_sql(("l_quantity", "l_discount", "l_tax"), "l_extendedprice", True)
       + ") WHERE score >= 0 ORDER BY score DESC, feature LIMIT 2")
def sel_topk(spark, sf_dir):
    scores = select.mutual_information(
        table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", regression=True)
    return select.top_features(scores, 0.0, 2).withColumn("score", F.round("score", 9))


@query("sel_lasso")
def sel_lasso(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    scores = select.lasso_coefficients(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", classification=False)
    return select.top_features(scores, 0.001, 50)


# --- the whole feature plan ------------------------------------------------------

def _joined(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_totalprice",
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return li.join(orders, "l_orderkey")


_COLUMNS = ("l_quantity", "o_totalprice", "o_orderpriority")
_TARGET_CODE = "prior * (1 - 1 / (1 + exp(-(count(*) - 20) / 10.0))) + avg(y) * (1 / (1 + exp(-(count(*) - 20) / 10.0)))"


_PLAN_SQL = f"""
WITH j AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity, (l_returnflag = 'R')::INTEGER AS y,
                  o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT l_orderkey, l_linenumber, y, coalesce(l_quantity, (SELECT median(l_quantity) FROM j)) AS l_quantity, o_totalprice,
             coalesce(o_orderpriority, (SELECT o_orderpriority FROM j WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM j),
c AS (SELECT o_orderpriority, {_TARGET_CODE} AS code FROM f, (SELECT avg(y) AS prior FROM f) GROUP BY o_orderpriority, prior),
e AS (SELECT l_orderkey, l_linenumber, y, l_quantity, o_totalprice, code AS o_orderpriority FROM f JOIN c USING (o_orderpriority)),
s AS (SELECT l_orderkey, l_linenumber, y, {', '.join(f"({c} - (SELECT median({c}) FROM e)) / coalesce(nullif((SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM e), 0), 1) AS {c}" for c in _COLUMNS)} FROM e)
SELECT l_orderkey, l_linenumber, y, round(l_quantity, 6) AS l_quantity, round(o_totalprice, 6) AS o_totalprice, round(o_orderpriority, 6) AS o_orderpriority,
       round(l_quantity * l_quantity, 6) AS "poly__l_quantity^2", round(l_quantity * o_totalprice, 6) AS "poly__l_quantity o_totalprice" FROM s"""


@query("fe_fit_transform", _PLAN_SQL)
def fe_fit_transform(spark, sf_dir):
    joined = _joined(spark, sf_dir)
    fitted = fit_features(joined, "y", True, FeatureOptions(select=False, text=False), passthrough=["l_orderkey", "l_linenumber"])
    return _plan_columns(fitted.transform(joined))


def _plan_columns(out):
    names = [*_COLUMNS, "poly__l_quantity^2", "poly__l_quantity o_totalprice"]
    return out.select("l_orderkey", "l_linenumber", "y", *[F.round(f"`{c}`", 6).alias(c) for c in names])


@query("plan_roundtrip", _PLAN_SQL)
def plan_roundtrip(spark, sf_dir):
    """The plan stored as a version, loaded again by name and applied."""
    joined = _joined(spark, sf_dir)
    fitted = fit_features(joined, "y", True, FeatureOptions(select=False, text=False), passthrough=["l_orderkey", "l_linenumber"])
    root = scratch_path(spark, "plans")
    save_plan(spark, fitted, root, "lines")
    return _plan_columns(load_plan(spark, root, "lines").transform(joined))


@query("fe_documents")
def fe_documents(spark, sf_dir):
    """Text, category and number columns together, with selection by the label."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    fitted = fit_features(docs, "quality", True, FeatureOptions(text_features=50, generate=False, max_features=20), key="doc_id")
    out = fitted.transform(docs)
    names = [c for c in out.columns if c not in ("doc_id", "quality")]
    total = sum((F.col(f"`{c}`") for c in names), F.lit(0.0))
    return out.select("doc_id", "quality", F.lit(len(names)).alias("n_features"), F.round(total, 6).alias("feature_sum"))
