"""Profile, chart, source and insight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    DIRTY_ORDERS, EVENT, FENCES, LABELLED, LINE, LINE_ALL, ORDER, ORDER_ALL, check, long_sql,
)
from plumbline.operators import charts, insights, profile
from plumbline.plans.bundles import enterprise_profile, full_profile
from plumbline.plans.frames import shared_folder
from plumbline.sources import tables

# ---- sources ------------------------------------------------------------------------------


@check("load_parquet_customer", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer", "c_acctbal", "c_nationkey")
def _(t):
    return tables.load_table(t.spark, f"{t.folder}/customer.parquet")


def _round_trip(t, table, fmt):
    import uuid

    path = f"{shared_folder(t.spark)}/export-{uuid.uuid4().hex}.{fmt}"
    tables.export(table, path, fmt)
    return tables.load_table(t.spark, path, fmt, schema=table.schema)


@check("export_load_csv_customer", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer", "c_acctbal", "c_nationkey")
def _(t):
    return _round_trip(t, t.customer, "csv")


@check("export_load_json_supplier", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier", "s_acctbal", "s_nationkey")
def _(t):
    return _round_trip(t, t.supplier, "json")


@check("save_version_part", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part", "p_retailprice", "p_size")
def _(t):
    import uuid

    path = tables.save_version(t.part, f"{shared_folder(t.spark)}/part-{uuid.uuid4().hex}", "features")
    return tables.load_table(t.spark, path, "parquet")


@check("preview_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 100", "o_totalprice")
def _(t):
    return tables.preview(t.orders.drop("o_orderdate"), 100, "o_orderkey")


@check("shape_lineitem", "SELECT count(*) AS rows, 11 AS columns FROM lineitem", "", "columns")
def _(t):
    return tables.shape(t.lineitem)


@check("snapshot_statistics_lineitem", f"""WITH long AS ({long_sql('lineitem', LINE)})
SELECT "column", count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, quantile_cont(x, 0.25) AS q25,
 quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) AS max, skewness(x) AS skew, kurtosis(x) AS kurtosis
FROM long GROUP BY 1""", "mean std min q25 q50 q75 max skew kurtosis")
def _(t):
    return tables.snapshot(t.lineitem)["statistics"]


@check("project_headers_part", "SELECT p_size, p_brand, p_partkey FROM part", "", "p_size")
def _(t):
    return tables.project_headers(t.part, ["p_size", "p_brand", "p_partkey"])


@check("popular_users", """SELECT user_id, count(*) AS access_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_access
FROM events GROUP BY 1 ORDER BY access_count DESC, user_id LIMIT 10""")
def _(t):
    return tables.popular(t.events, "user_id", "ts").withColumn("last_access", F.date_format("last_access", "yyyy-MM-dd HH:mm:ss"))


@check("recent_events_user", "SELECT event_id, user_id, event_type, value FROM events WHERE user_id = 7 ORDER BY ts DESC LIMIT 10", "value")
def _(t):
    return tables.recent(t.events, "user_id", 7, "ts").select("event_id", "user_id", "event_type", "value")


# ---- profile ------------------------------------------------------------------------------

NUMERIC_STATS_SQL = """, stats AS (SELECT "column", avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std, min(x) AS min,
 max(x) AS max, skewness(x) AS skew, count(*) AS n FROM long GROUP BY 1),
o AS (SELECT long."column", count(*) FILTER (WHERE x < lo OR x > hi) AS outliers FROM long JOIN fences USING ("column") GROUP BY 1)
SELECT "column", mean, median, std, min, max, q1, q3, outliers, 100.0 * outliers / n AS outlier_pct, skew,
 CASE WHEN abs(skew) < 0.5 THEN 'symmetric' WHEN skew > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS trend, 100.0 * std / mean AS cv_pct
FROM stats JOIN fences USING ("column") JOIN o USING ("column")"""
NUMERIC_DOUBLES = "mean median std min max q1 q3 outlier_pct skew cv_pct"


@check("numeric_stats_events", f"WITH long AS ({long_sql('events', EVENT)}), {FENCES}{NUMERIC_STATS_SQL}", NUMERIC_DOUBLES)
def numeric_stats_events(t):
    return profile.numeric_stats(t.events)


@check("numeric_stats_lineitem", f"WITH long AS ({long_sql('lineitem', LINE)}), {FENCES}{NUMERIC_STATS_SQL}", NUMERIC_DOUBLES)
def _(t):
    return profile.numeric_stats(t.lineitem)


@check("population_stats_orders", f"""WITH long AS ({long_sql('orders', ORDER)}),
p AS (SELECT "column", x, row_number() OVER (PARTITION BY "column" ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY "column") AS n FROM long),
q AS (SELECT "column", max(x) FILTER (WHERE i = floor(n * 0.25)) AS q1, max(x) FILTER (WHERE i = floor(n * 0.5)) AS median,
  max(x) FILTER (WHERE i = floor(n * 0.75)) AS q3, count(*) AS count, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max FROM p GROUP BY 1),
m AS (SELECT long."column", avg(pow((x - mean) / std, 3)) AS skew, avg(pow((x - mean) / std, 4)) - 3 AS kurtosis,
  count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers FROM long JOIN q USING ("column") GROUP BY 1)
SELECT "column", count, mean, median, std, min, max, q1, q3, outliers, skew, kurtosis FROM q JOIN m USING ("column")""",
       "mean median std min max q1 q3 skew kurtosis")
def _(t):
    return profile.numeric_stats(t.orders, moments="population")


@check("table_summary_orders_dirty", f"""WITH {DIRTY_ORDERS}, long AS ({long_sql('orders_dirty', ORDER)}), {FENCES}
SELECT (SELECT count(*) FROM orders_dirty) AS rows, 6 AS columns, 3 AS numeric_columns, 3 AS other_columns,
 (SELECT count(*) FROM orders_dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dirty)) AS duplicate_rows,
 (SELECT count(*) FROM long WHERE x IS NULL) AS missing_cells,
 100.0 * (SELECT count(*) FROM long WHERE x IS NULL) / (6 * (SELECT count(*) FROM orders_dirty)) AS missing_pct,
 (SELECT count(*) FROM long JOIN fences USING ("column") WHERE x < lo OR x > hi) AS outlier_total""",
       "missing_pct", "columns numeric_columns other_columns")
def _(t):
    return profile.table_summary(t.orders_dirty)


COLUMN_KINDS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
_kind = {"bigint": "CASE WHEN d = n THEN 'identifier' WHEN d <= 10 THEN 'categorical_numeric' ELSE 'continuous' END",
         "string": "'categorical'", "timestamp_ntz": "'datetime'"}
_kind["double"] = _kind["bigint"]


@check("column_profile_orders", "WITH n AS (SELECT count(*) AS n FROM orders) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS dtype, d AS distinct_values, 100.0 * d / n AS distinct_pct, m AS missing, 100.0 * m / n AS missing_pct, "
    f"{_kind[k]} AS semantic_type FROM (SELECT count(DISTINCT {c}) AS d, count(*) - count({c}) AS m FROM orders), n" for c, k in COLUMN_KINDS.items()),
       "distinct_pct missing_pct")
def _(t):
    return profile.column_profile(t.orders)


@check("column_profile_approx_orders")
def _(t):
    return profile.column_profile(t.orders, approx=True)


@check("type_counts_lineitem", "SELECT * FROM (VALUES ('bigint', 3), ('int', 1), ('double', 4), ('string', 2), ('timestamp_ntz', 1)) AS v(dtype, columns)", "", "columns")
def _(t):
    return profile.type_counts(t.lineitem)


@check("missing_orders_dirty", f"""WITH {DIRTY_ORDERS}, m AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS n FROM orders_dirty" for c in ORDER_ALL) +
       ") SELECT \"column\", missing, 100.0 * missing / n AS missing_pct FROM m WHERE missing > 0", "missing_pct")
def _(t):
    return profile.missing_by_column(t.orders_dirty)


@check("complete_rows_orders_dirty", f"""WITH {DIRTY_ORDERS} SELECT count(*) AS rows, count(o_totalprice) AS complete_rows,
 1.0 * count(o_totalprice) / count(*) AS complete_share FROM orders_dirty""", "complete_share")
def _(t):
    return profile.complete_rows(t.orders_dirty)


@check("describe_lineitem", f"""WITH long AS ({long_sql('lineitem', LINE)})
SELECT "column", count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, quantile_cont(x, 0.25) AS q25,
 quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) AS max FROM long GROUP BY 1""", "mean std min q25 q50 q75 max")
def _(t):
    return profile.describe_numeric(t.lineitem)


@check("distribution_summary_orders", f"""WITH long AS ({long_sql('orders', ORDER)})
SELECT "column", count(DISTINCT x) AS distinct_values, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std, min(x) AS min,
 max(x) AS max, skewness(x) AS skew, kurtosis(x) AS kurtosis, 100.0 * stddev_samp(x) / avg(x) AS cv_pct FROM long GROUP BY 1""",
       "mean median std min max skew kurtosis cv_pct")
def _(t):
    return profile.distribution_summary(t.orders)


def _histogram_sql(table, col, bins):
    return f"""WITH s AS (SELECT min({col}) AS lo, max({col}) AS hi FROM {table}),
b AS (SELECT least(CAST(floor(({col} - lo) / ((hi - lo) / {bins})) AS INT), {bins - 1}) AS bin FROM {table}, s),
g AS (SELECT CAST(range AS INT) AS bin FROM range({bins}))
SELECT g.bin, lo + (hi - lo) * g.bin / {bins} AS low, lo + (hi - lo) * (g.bin + 1) / {bins} AS high, count(b.bin) AS n
FROM g CROSS JOIN s LEFT JOIN b ON b.bin = g.bin GROUP BY 1, 2, 3"""


@check("histogram_acctbal", _histogram_sql("customer", "c_acctbal", 10), "low high", "bin")
def _(t):
    return profile.histogram(t.customer, "c_acctbal", 10)


@check("histogram_value_by_type", """WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT event_type AS class, least(CAST(floor((value - lo) / ((hi - lo) / 20)) AS INT), 19) AS bin, lo, hi FROM events, s)
SELECT class, bin, lo + (hi - lo) * bin / 20 AS low, lo + (hi - lo) * (bin + 1) / 20 AS high, count(*) AS n FROM b GROUP BY 1, 2, 3, 4""", "low high", "bin")
def _(t):
    return profile.histogram(t.events, "value", 20, by="event_type")


@check("modality_orders", " UNION ALL ".join(f"""(WITH s AS (SELECT min({c}) AS lo, max({c}) AS hi FROM orders),
b AS (SELECT least(CAST(floor(({c} - lo) / ((hi - lo) / 30.0)) AS INT), 29) AS bin FROM orders, s),
g AS (SELECT g.range AS bin, count(b.bin) AS n FROM range(30) g LEFT JOIN b ON b.bin = g.range GROUP BY 1),
w AS (SELECT n, lag(n) OVER (ORDER BY bin) AS a, lead(n) OVER (ORDER BY bin) AS z FROM g)
SELECT '{c}' AS "column", count(*) FILTER (WHERE n > a AND n > z) AS peaks,
 CASE WHEN count(*) FILTER (WHERE n > a AND n > z) > 1 THEN 'multimodal' ELSE 'unimodal' END AS modality FROM w)""" for c in ("o_custkey", "o_totalprice")))
def _(t):
    return profile.modality(t.orders.select("o_custkey", "o_totalprice"))


@check("outliers_events", f"""WITH long AS ({long_sql('events', EVENT)}), {FENCES}
SELECT "column", count(*) FILTER (WHERE x < lo OR x > hi) AS outliers, 100.0 * count(*) FILTER (WHERE x < lo OR x > hi) / count(*) AS outlier_pct,
 lo AS lower_bound, hi AS upper_bound FROM long JOIN fences USING ("column") GROUP BY "column", lo, hi HAVING outliers > 0""",
       "outlier_pct lower_bound upper_bound")
def _(t):
    return profile.outlier_report(t.events)


@check("outlier_impact_orders_dirty", f"""WITH {DIRTY_ORDERS}, long AS ({long_sql('orders_dirty', ORDER)}), {FENCES},
s AS (SELECT "column", count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, count(*) FILTER (WHERE x < lo OR x > hi) AS outliers,
  avg(x) FILTER (WHERE x BETWEEN lo AND hi) AS m2, stddev_samp(x) FILTER (WHERE x BETWEEN lo AND hi) AS s2
  FROM long JOIN fences USING ("column") GROUP BY 1)
SELECT "column", outliers, 100.0 * outliers / n AS outlier_pct, abs(mean - m2) AS mean_impact, abs(std - s2) AS std_impact,
 CASE WHEN abs(mean - m2) > 0.1 * std THEN 'high' ELSE 'low' END AS severity FROM s WHERE outliers > 0""", "outlier_pct mean_impact std_impact")
def _(t):
    return profile.outlier_impact(t.orders_dirty)


@check("robust_stats_lineitem", f"""WITH long AS ({long_sql('lineitem', LINE)}),
r AS (SELECT "column", x, row_number() OVER (PARTITION BY "column" ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY "column") AS n FROM long)
SELECT "column", quantile_cont(x, 0.5) AS median, mad(x) AS mad, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr,
 avg(x) FILTER (WHERE i >= floor(0.1 * n) AND i < n - floor(0.1 * n)) AS trimmed_mean FROM r GROUP BY 1""", "median mad iqr trimmed_mean")
def _(t):
    return profile.robust_stats(t.lineitem)


# ---- text columns -------------------------------------------------------------------------

ORDER_TEXT = f"c AS (SELECT \"column\", x AS value, count(*) AS n FROM ({long_sql('orders', ['o_orderstatus', 'o_orderpriority'], 'VARCHAR')}) WHERE x IS NOT NULL GROUP BY 1, 2)"
PART_TEXT = f"c AS (SELECT \"column\", x AS value, count(*) AS n FROM ({long_sql('part', ['p_name', 'p_brand', 'p_type'], 'VARCHAR')}) WHERE x IS NOT NULL GROUP BY 1, 2)"


@check("top_values_part", f"""WITH {PART_TEXT}, r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c)
SELECT "column", value, n, rank FROM r WHERE rank <= 10""", "", "rank")
def _(t):
    return profile.top_values(t.part, 10)


ENTROPY = """e AS (SELECT "column", count(*) AS k, sum(n) AS total, -sum(n / t * log2(n / t)) AS h, max(n) AS top
FROM (SELECT *, sum(n) OVER (PARTITION BY "column") AS t FROM c) GROUP BY 1)"""


@check("categorical_stats_part", f"WITH {PART_TEXT}, {ENTROPY} SELECT \"column\", k AS distinct_values, h AS entropy, 100.0 * top / total AS dominance_pct FROM e", "entropy dominance_pct")
def _(t):
    return profile.categorical_stats(t.part)


@check("categorical_stats_rows_denominator", f"""WITH {ORDER_TEXT}, r AS (SELECT count(*) AS rows FROM orders)
SELECT "column", count(*) AS distinct_values, -sum(1.0 * n / rows * log2(1.0 * n / rows)) AS entropy, 100.0 * max(n) / max(rows) AS dominance_pct
FROM c, r GROUP BY 1""", "entropy dominance_pct")
def _(t):
    return profile.categorical_stats(t.orders, denominator="rows")


@check("entropy_orders", f"""WITH {ORDER_TEXT}, {ENTROPY} SELECT "column", h AS entropy, log2(k) AS max_entropy, h / log2(k) AS normalized_entropy,
 CASE WHEN h / log2(k) > 0.7 THEN 'balanced' ELSE 'imbalanced' END AS interpretation FROM e""", "entropy max_entropy normalized_entropy")
def _(t):
    return profile.entropy(t.orders)


IMBALANCE = """i AS (SELECT "column", arg_min(value, (-n, value)) AS majority_class, 100.0 * max(n) / sum(n) AS majority_pct,
 arg_max(value, (-n, value)) AS minority_class, 100.0 * min(n) / sum(n) AS minority_pct, 1.0 * max(n) / min(n) AS imbalance_ratio FROM c GROUP BY 1 HAVING count(*) >= 2)"""
SEVERITY = "CASE WHEN imbalance_ratio < 2 THEN 'balanced' WHEN imbalance_ratio < 5 THEN 'mild' WHEN imbalance_ratio < 10 THEN 'moderate' ELSE 'severe' END AS severity"


@check("imbalance_documents", f"""WITH c AS (SELECT "column", x AS value, count(*) AS n FROM ({long_sql('documents', ['lang', 'source'], 'VARCHAR')}) GROUP BY 1, 2), {IMBALANCE}
SELECT *, {SEVERITY} FROM i""", "majority_pct minority_pct imbalance_ratio")
def _(t):
    return profile.imbalance(t.documents, ["lang", "source"])


@check("rare_categories_part", f"""WITH {PART_TEXT}, s AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS t FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM s WHERE n / t < 0.01)
SELECT "column", count(*) AS rare_values, 100.0 * sum(n) / max(t) AS rare_pct,
 string_agg(value, ', ' ORDER BY rank) FILTER (WHERE rank <= 10) AS listed FROM r GROUP BY 1""", "rare_pct")
def _(t):
    return profile.rare_categories(t.part)


@check("concentration_part", f"""WITH {PART_TEXT}, r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n) AS i,
 row_number() OVER (PARTITION BY "column" ORDER BY n DESC) AS j FROM c),
g AS (SELECT "column", 2.0 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*) AS gini, 100.0 * sum(n) FILTER (WHERE j <= 5) / sum(n) AS top5_pct FROM r GROUP BY 1)
SELECT *, CASE WHEN top5_pct > 80 THEN 'high' WHEN top5_pct > 50 THEN 'moderate' ELSE 'low' END AS level FROM g""", "gini top5_pct")
def _(t):
    return profile.concentration(t.part)


LEVEL = "CASE WHEN distinct_ratio < 0.01 THEN 'very low' WHEN distinct_ratio < 0.1 THEN 'low' WHEN distinct_ratio < 0.5 THEN 'medium' WHEN distinct_ratio < 0.9 THEN 'high' ELSE 'very high' END AS level"


def cardinality_sql(table, cols):
    union = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values, 1.0 * count(DISTINCT {c}) / count(*) AS distinct_ratio FROM {table}" for c in cols)
    return f"SELECT *, {LEVEL} FROM ({union})"


@check("cardinality_lineitem", cardinality_sql("lineitem", LINE_ALL), "distinct_ratio")
def _(t):
    return profile.cardinality(t.lineitem)


@check("duplicates_orders_dirty", f"""WITH {DIRTY_ORDERS}, g AS (SELECT count(*) AS n FROM orders_dirty GROUP BY ALL),
h AS (SELECT {', '.join(ORDER_ALL)}, count(*) AS n FROM orders_dirty GROUP BY ALL)
SELECT sum(n) - count(*) AS duplicate_rows, 100.0 * (sum(n) - count(*)) / sum(n) AS duplicate_pct, count(*) AS unique_rows FROM h""",
       "duplicate_pct", "duplicate_rows")
def _(t):
    return profile.duplicate_report(t.orders_dirty)


@check("table_size_orders", "SELECT * FROM (" + " UNION ALL ".join([
    "SELECT 'o_orderkey' AS \"column\", 8 * count(o_orderkey) AS bytes FROM orders", "SELECT 'o_custkey', 8 * count(o_custkey) FROM orders",
    "SELECT 'o_orderstatus', sum(strlen(o_orderstatus)) FROM orders", "SELECT 'o_totalprice', 8 * count(o_totalprice) FROM orders",
    "SELECT 'o_orderdate', 8 * count(o_orderdate) FROM orders", "SELECT 'o_orderpriority', sum(strlen(o_orderpriority)) FROM orders"]) + ")", "", "bytes")
def _(t):
    return profile.table_size(t.orders)


_flags = ", ".join(f"CAST({c} IS NULL AS BIGINT) AS {c}_null" for c in ORDER_ALL)


@check("missing_matrix_head", f"WITH {DIRTY_ORDERS} SELECT o_orderkey, {_flags} FROM marred ORDER BY o_orderkey LIMIT 50")
def _(t):
    return profile.missing_matrix(t.orders_dirty.dropDuplicates(["o_orderkey"]), "o_orderkey", 50)


@check("missing_matrix_systematic", f"""WITH {DIRTY_ORDERS}, r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () // 200 AS step FROM marred)
SELECT o_orderkey, {_flags} FROM r WHERE i % step = 0""")
def _(t):
    return profile.missing_matrix(t.orders_dirty.dropDuplicates(["o_orderkey"]), "o_orderkey", 200, "systematic")


# ---- charts -------------------------------------------------------------------------------

@check("pareto_part_type", """WITH c AS (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1),
w AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS position, sum(n) OVER (ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING) AS s, sum(n) OVER () AS t FROM c)
SELECT value, n, position, 100.0 * s / t AS cumulative_pct, 100.0 * (s - n) / t < 80 AS vital FROM w""", "cumulative_pct")
def _(t):
    return charts.pareto(t.part, "p_type")


@check("pareto_part_name", """WITH c AS (SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1),
w AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS position, sum(n) OVER (ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING) AS s, sum(n) OVER () AS t FROM c)
SELECT value, n, position, 100.0 * s / t AS cumulative_pct, 100.0 * (s - n) / t < 80 AS vital FROM w""", "cumulative_pct")
def _(t):
    return charts.pareto(t.part, "p_name")


@check("top_k_event_type", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 15")
def _(t):
    return charts.top_k(t.events, "event_type", 15)


@check("top_k_others_brand", """WITH c AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS i FROM c)
SELECT CASE WHEN i <= 10 THEN v ELSE 'Others' END AS value, sum(n) AS n FROM r GROUP BY 1""", "", "n")
def _(t):
    return charts.top_k_with_others(t.part, "p_brand", 10)


@check("chart_group_mktsegment", """SELECT CASE WHEN trim(c_mktsegment) = '' OR c_mktsegment IS NULL THEN 'Missing' ELSE trim(c_mktsegment) END AS "group",
 avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY value DESC, 1 LIMIT 20""", "value")
def _(t):
    return charts.chart_group(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), "c_mktsegment", "o_totalprice", "mean")


@check("chart_group_sum_priority", f"""WITH {DIRTY_ORDERS} SELECT CASE WHEN trim(o_orderpriority) = '' THEN 'Missing' ELSE o_orderpriority END AS "group",
 sum(o_totalprice) AS value FROM orders_dirty GROUP BY 1 ORDER BY value DESC LIMIT 20""", "value")
def _(t):
    return charts.chart_group(t.orders_dirty, "o_orderpriority", "o_totalprice", "sum")


@check("chart_counts_type", "SELECT event_type AS \"group\", CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1 ORDER BY value DESC LIMIT 12", "value")
def _(t):
    return charts.chart_group(t.events, "event_type", None, "count", 12)


@check("category_target_brand", "SELECT p_brand AS category, avg(p_retailprice) AS mean, count(*) AS n FROM part GROUP BY 1 HAVING n >= 5 ORDER BY mean DESC, category LIMIT 15", "mean")
def _(t):
    return charts.category_target(t.part, "p_brand", "p_retailprice")


@check("split_summary_value", "SELECT event_type AS class, avg(value) AS mean, count(value) AS n FROM events GROUP BY 1 ORDER BY 1 LIMIT 2", "mean")
def _(t):
    return charts.split_summary(t.events, "value", "event_type")


@check("binned_mean_lineitem", """WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
SELECT least(CAST(floor((l_quantity - a) / ((b - a) / 10)) AS INT), 9) AS x_bin, least(CAST(floor((l_extendedprice - c) / ((d - c) / 10)) AS INT), 9) AS y_bin,
 avg(l_discount) AS mean, count(l_discount) AS n FROM lineitem, s GROUP BY 1, 2""", "mean", "x_bin y_bin")
def _(t):
    return charts.binned_mean(t.lineitem, "l_quantity", "l_extendedprice", "l_discount", 10)


@check("scatter_sample_events")
def _(t):
    return charts.scatter_sample(t.events, ["value", "user_id"], 200, "event_id")


@check("scatter_pairs_events", "SELECT event_id, CAST(user_id AS DOUBLE) AS x, value AS y FROM events ORDER BY event_id LIMIT 250", "x y")
def _(t):
    return charts.scatter_pairs(t.events, "user_id", "value", "event_id", 250)


@check("stratified_sample_sizes", """WITH c AS (SELECT event_type, count(*) AS size FROM events GROUP BY 1), t AS (SELECT count(*) AS n FROM events)
SELECT event_type, CAST(round_even(500.0 * size / n, 0) AS BIGINT) AS taken FROM c, t""")
def _(t):
    return charts.stratified_sample(t.events, "event_type", 500, "event_id").groupBy("event_type").agg(F.count("*").alias("taken"))


@check("kde_value", """WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h FROM events),
b AS (SELECT least(CAST(floor((value - lo) / ((hi - lo) / 512)) AS INT), 511) AS b, count(*) AS w FROM events, s GROUP BY 1),
g AS (SELECT range AS i FROM range(100))
SELECT lo + i * (hi - lo) / 99 AS x, sum(w * exp(-0.5 * pow((lo + i * (hi - lo) / 99 - (lo + (b + 0.5) * (hi - lo) / 512)) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())) AS density
FROM b, g, s GROUP BY 1""", "x density")
def _(t):
    return charts.kde(t.events, "value", 100)


BOX = "count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS max"
BOX_DOUBLES = "mean std min q1 median q3 max lower_fence upper_fence"


@check("box_stats_lineitem", f"""WITH long AS ({long_sql('lineitem', LINE)}), b AS (SELECT "column", {BOX} FROM long GROUP BY 1)
SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM b""", BOX_DOUBLES)
def _(t):
    return charts.box_stats(t.lineitem)


@check("box_stats_by_type", f"""WITH b AS (SELECT event_type AS "group", {BOX.replace('(x', '(value')} FROM events GROUP BY 1)
SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM b""", BOX_DOUBLES)
def _(t):
    return charts.box_stats(t.events, "event_type", "value")


# ---- insights and bundles -----------------------------------------------------------------

@check("insights_general_events", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events),
o AS (SELECT 100.0 * count(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) / count(*) AS pct, skewness(value) AS skew FROM events, q)
SELECT 'general' AS family, 'info' AS kind, 'outliers detected' AS title, 'value' AS subject, pct AS value FROM o WHERE pct > 5
UNION ALL SELECT 'general', 'info', 'skewed distribution', 'value', skew FROM o WHERE abs(skew) > 2
UNION ALL SELECT 'general', 'success', 'clean table', NULL, NULL FROM o WHERE pct <= 5""", "value")
def _(t):
    return insights.insights(t.events, "general")


@check("insights_segmentation_documents", """WITH c AS (SELECT 'lang' AS col, lang AS v, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2),
t AS (SELECT col, arg_max(v, n) AS v, 100.0 * max(n) / sum(n) AS pct, count(*) AS k, sum(n) AS rows FROM c GROUP BY 1),
f AS (SELECT 'segmentation' AS family, 'imbalance' AS kind, 'dominant category' AS title, col || ' = ' || v AS subject, pct AS value FROM t WHERE pct > 70
UNION ALL SELECT 'segmentation', 'sparse', 'sparse labels', col, k FROM t WHERE k > 50 AND rows < 1000)
SELECT * FROM f UNION ALL SELECT 'segmentation', 'info', 'balanced segmentation', NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM f)""", "value")
def _(t):
    return insights.insights(t.documents.select("lang", "source", "n_chars"), "segmentation")


@check("insights_all_lineitem")
def _(t):
    return insights.insights(t.lineitem)


@check("recommendations_orders_dirty", f"""WITH {DIRTY_ORDERS}, long AS ({long_sql('orders_dirty', ORDER)}), {FENCES},
m AS (SELECT 100.0 * (SELECT count(*) FROM long WHERE x IS NULL) / (6 * count(*)) AS pct FROM orders_dirty),
d AS (SELECT sum(n) - count(*) AS dup FROM (SELECT count(*) AS n FROM orders_dirty GROUP BY {', '.join(ORDER_ALL)})),
o AS (SELECT long."column" AS c, count(x) AS n, count(*) FILTER (WHERE x < lo OR x > hi) AS k FROM long JOIN fences USING ("column") GROUP BY 1),
found AS (SELECT 'recommendation' AS family, 'missing' AS kind, 'handle missing values' AS title, NULL AS subject, pct AS value FROM m WHERE pct > 5
UNION ALL SELECT 'recommendation', 'duplicates', 'remove duplicate rows', NULL, dup FROM d WHERE dup > 0
UNION ALL SELECT 'recommendation', 'outliers', 'cap or remove outliers', c, k FROM o WHERE k / n > 0.05)
SELECT family, kind, title, subject, CAST(value AS DOUBLE) AS value FROM found UNION ALL SELECT 'recommendation', 'clean', 'proceed to modelling', NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM found)""", "value")
def _(t):
    return insights.recommendations(t.orders_dirty)


@check("prioritized_recommendations_lineitem", """SELECT * FROM (VALUES (1, 'medium', 'scale features', NULL::DOUBLE), (2, 'medium', 'encode categorical columns', NULL),
 (3, 'medium', 'detect and treat outliers', NULL), (4, 'low', 'select features', NULL), (5, 'low', 'split into train and test', NULL)) AS v(position, priority, title, value)
WHERE (SELECT abs(corr(l_quantity, l_extendedprice)) FROM lineitem) <= 0.8""", "value", "position")
def _(t):
    return insights.prioritized_recommendations(t.lineitem)


@check("key_insights_events", """WITH s AS (SELECT skewness(value) AS v, skewness(user_id) AS u, skewness(event_id) AS e FROM events),
k AS (SELECT list_filter(['event_id', 'user_id', 'value'], lambda c, i: abs([e, u, v][i]) > 1) AS l FROM s)
SELECT 'key' AS family, 'good' AS kind, 'completeness' AS title, NULL AS subject, 100.0 AS value
UNION ALL SELECT 'key', 'good', 'duplicates', NULL, 0.0
UNION ALL SELECT 'key', 'info', 'skewed distributions', array_to_string(l, ', '), len(l) FROM k WHERE len(l) > 0
UNION ALL SELECT 'key', 'info', 'categorical columns', NULL, 2.0
UNION ALL SELECT 'key', 'info', 'column types', '3 numeric, 2 text', 6.0""", "value")
def _(t):
    return insights.key_insights(t.events)


@check("top_finding_skew_events", "SELECT 'skew' AS topic, 'value' AS subject, skewness(value) AS value, 0.9 AS confidence FROM events", "value confidence")
def _(t):
    return insights.top_finding(t.events, "skew")


@check("top_finding_missing_orders_dirty", f"WITH {DIRTY_ORDERS} SELECT 'missing' AS topic, 'o_totalprice' AS subject, count(*) - count(o_totalprice) AS value, 0.9 AS confidence FROM orders_dirty", "value confidence")
def _(t):
    return insights.top_finding(t.orders_dirty, "missing")


@check("top_finding_correlation_lineitem")
def _(t):
    return insights.top_finding(t.lineitem, "correlation")


@check("full_profile_events", f"WITH long AS ({long_sql('events', EVENT)}), {FENCES}{NUMERIC_STATS_SQL}", NUMERIC_DOUBLES)
def _(t):
    return full_profile(t.events)["statistics"]


@check("enterprise_profile_labelled")
def _(t):
    from datetime import datetime

    return enterprise_profile(t.labelled, datetime(2024, 1, 1), "quality")["summary"]
