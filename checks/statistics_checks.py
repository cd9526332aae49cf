"""Association, statistical test and time series queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from checks.base import DIRTY_ORDERS, EVENT, LABELLED, LINE, check, long_sql
from plumbline.operators import association, hypothesis, series

# ---- correlation --------------------------------------------------------------------------


def _pairs_sql(table, cols, both=False):
    parts = [f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS r FROM {table}" for a, b in combinations(cols, 2)]
    if both:
        parts += [f"SELECT '{b}', '{a}', corr({a}, {b}) FROM {table}" for a, b in combinations(cols, 2)]
        parts += [f"SELECT '{c}', '{c}', 1.0" for c in cols]
    return " UNION ALL ".join(parts)


STRENGTH = "CASE WHEN abs(r) >= 0.9 THEN 'very strong' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength"


@check("corr_lineitem", _pairs_sql("lineitem", LINE, both=True), "r")
def _(t):
    return association.corr_matrix(t.lineitem)


@check("corr_pairs_orders_dirty", f"WITH {DIRTY_ORDERS}, p AS ({_pairs_sql('orders_dirty', ['o_orderkey', 'o_custkey', 'o_totalprice'])}) SELECT *, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, {STRENGTH} FROM p", "r")
def _(t):
    return association.corr_pairs(t.orders_dirty)


PART_PAIRS = "SELECT p_size, p_retailprice, p_retailprice * 2 + p_size / 50.0 AS list_price FROM part"


def _priced_part(t):
    return t.part.select("p_size", "p_retailprice", (F.col("p_retailprice") * 2 + F.col("p_size") / 50.0).alias("list_price"))


@check("high_pairs_part", f"WITH v AS ({PART_PAIRS}), p AS ({_pairs_sql('v', ['p_size', 'p_retailprice', 'list_price'])}) SELECT *, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, {STRENGTH} FROM p WHERE abs(r) > 0.7", "r")
def _(t):
    return association.high_pairs(_priced_part(t), 0.7)


def _ranked_sql(table, cols):
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in cols)
    return f"WITH k AS (SELECT {ranks} FROM {table}) "


@check("spearman_lineitem", _ranked_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) + _pairs_sql("k", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], both=True), "r")
def _(t):
    return association.corr_matrix(t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "spearman")


@check("spearman_with_nulls", f"""WITH {DIRTY_ORDERS}, v AS (SELECT o_custkey, o_totalprice FROM orders_dirty WHERE o_totalprice IS NOT NULL),
k AS (SELECT rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS a, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS b FROM v)
SELECT 'o_custkey' AS feature1, 'o_totalprice' AS feature2, corr(a, b) AS r FROM k UNION ALL SELECT 'o_totalprice', 'o_custkey', corr(a, b) FROM k
UNION ALL SELECT 'o_custkey', 'o_custkey', 1.0 UNION ALL SELECT 'o_totalprice', 'o_totalprice', 1.0""", "r")
def _(t):
    return association.corr_matrix(t.orders_dirty.select("o_custkey", "o_totalprice"), "spearman")


@check("target_correlation_lineitem", " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r FROM lineitem" for c in LINE if c != "l_extendedprice"), "r")
def _(t):
    return association.target_correlation(t.lineitem, "l_extendedprice")


@check("corr_network_edges_part", f"WITH v AS ({PART_PAIRS}), p AS ({_pairs_sql('v', ['p_size', 'p_retailprice', 'list_price'])}) SELECT feature1 AS src, feature2 AS dst, r AS weight FROM p WHERE abs(r) > 0.5", "weight")
def _(t):
    return association.corr_network(_priced_part(t), 0.5)[0]


@check("corr_network_nodes_part", f"""WITH v AS ({PART_PAIRS}), p AS ({_pairs_sql('v', ['p_size', 'p_retailprice', 'list_price'])}), n AS (SELECT unnest(['p_size', 'p_retailprice', 'list_price']) AS node)
SELECT node, count(r) AS degree FROM n LEFT JOIN (SELECT * FROM p WHERE abs(r) > 0.5) e ON node IN (feature1, feature2) GROUP BY 1""")
def _(t):
    return association.corr_network(_priced_part(t), 0.5)[1]


@check("redundant_groups_part", f"WITH v AS ({PART_PAIRS}) SELECT 'p_retailprice' AS lead, 'p_retailprice, list_price' AS members, 2 AS size FROM v HAVING abs(corr(p_retailprice, list_price)) > 0.9 AND abs(corr(p_size, list_price)) <= 0.9", "", "size")
def _(t):
    return association.redundant_groups(_priced_part(t))


@check("check_hypothesis_part", f"WITH v AS ({PART_PAIRS}), r AS (SELECT corr(p_retailprice, list_price) AS r FROM v) SELECT 'p_retailprice' AS feature1, 'list_price' AS feature2, r, CASE WHEN abs(r) >= 0.5 THEN 'supported' ELSE 'weak' END AS verdict FROM r", "r")
def _(t):
    return association.check_hypothesis(_priced_part(t), "p_retailprice", "list_price")


def chi_sql(table, a, b, label="chi2"):
    """Chi-square over all cells, empty ones included, with the continuity correction for 2x2."""
    return f"""(WITH o AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT a, sum(o) AS ra FROM o GROUP BY 1), rb AS (SELECT b, sum(o) AS rb FROM o GROUP BY 1), n AS (SELECT sum(o) AS n, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM o),
c AS (SELECT coalesce(o.o, 0) AS o, ra * rb / n AS e, n, ka, kb FROM ra CROSS JOIN rb CROSS JOIN n LEFT JOIN o ON o.a = ra.a AND o.b = rb.b)
SELECT CASE WHEN ka = 2 AND kb = 2 THEN sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) ELSE sum(pow(o - e, 2) / e) END AS {label}, CAST(n AS BIGINT) AS n, ka, kb FROM c GROUP BY n, ka, kb)"""


def _cramers_sql(table, cols):
    parts = [f"SELECT '{a}' AS feature1, '{b}' AS feature2, least(1.0, sqrt(chi2 / (n * (least(ka, kb) - 1)))) AS cramers_v FROM {chi_sql(table, a, b)}" for a, b in combinations(cols, 2)]
    return f"SELECT *, CASE WHEN cramers_v < 0.1 THEN 'negligible' WHEN cramers_v < 0.3 THEN 'weak' WHEN cramers_v < 0.5 THEN 'moderate' ELSE 'strong' END AS strength FROM ({' UNION ALL '.join(parts)})"


@check("cramers_v_lineitem", _cramers_sql("lineitem", ["l_returnflag", "l_linestatus"]), "cramers_v")
def _(t):
    return association.cramers_v(t.lineitem, ["l_returnflag", "l_linestatus"])


@check("cramers_v_documents", _cramers_sql("documents", ["lang", "source"]), "cramers_v")
def _(t):
    return association.cramers_v(t.documents, ["lang", "source"])


def _eta_sql(table, numeric, categorical):
    parts = [f"""SELECT '{c}' AS categorical, '{x}' AS numeric, (SELECT sum(n * pow(m - mean, 2)) FROM (SELECT count({x}) AS n, avg({x}) AS m FROM {table} GROUP BY {c}), (SELECT avg({x}) AS mean FROM {table}))
 / (SELECT var_pop({x}) * count({x}) FROM {table}) AS eta_squared""" for c in categorical for x in numeric]
    return f"SELECT *, CASE WHEN eta_squared < 0.3 THEN 'weak' WHEN eta_squared < 0.7 THEN 'moderate' ELSE 'strong' END AS strength FROM ({' UNION ALL '.join(parts)})"


@check("corr_ratio_events", _eta_sql("events", EVENT, ["event_type", "props"]), "eta_squared")
def _(t):
    return association.correlation_ratio(t.events)


@check("vif_lineitem", """SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 1 / (1 - pow(corr(l_quantity, l_discount), 2)) AS vif, 'low' AS multicollinearity FROM lineitem" for c in ("l_quantity", "l_discount")) + ")", "vif")
def _(t):
    return association.vif(t.lineitem.select("l_quantity", "l_discount"))


@check("vif_all_lineitem")
def _(t):
    return association.vif(t.lineitem)


@check("linear_algebra_matrices", " UNION ALL ".join(
    f"SELECT '{a}' AS row, '{b}' AS column, covar_samp({a}, {b}) AS covariance, corr({a}, {b}) AS correlation, sum({a} * {b}) AS gram FROM lineitem"
    for a in ("l_quantity", "l_extendedprice", "l_discount") for b in ("l_quantity", "l_extendedprice", "l_discount")), "covariance correlation gram")
def _(t):
    return association.linear_algebra(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])["matrices"]


@check("linear_algebra_spectrum")
def _(t):
    return association.linear_algebra(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])["spectrum"]


@check("vector_pair_lineitem", """SELECT sum(l_quantity * l_extendedprice) AS dot, sqrt(sum(l_quantity * l_quantity)) AS norm_a, sqrt(sum(l_extendedprice * l_extendedprice)) AS norm_b,
 sum(l_quantity * l_extendedprice) / (sqrt(sum(l_quantity * l_quantity)) * sqrt(sum(l_extendedprice * l_extendedprice))) AS cosine, count(*) AS n FROM lineitem""", "dot norm_a norm_b cosine")
def _(t):
    return association.vector_pair(t.lineitem, "l_quantity", "l_extendedprice")


@check("trend_line_lineitem", "SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, count(*) AS n FROM lineitem", "slope intercept")
def _(t):
    return association.trend_line(t.lineitem, "l_quantity", "l_extendedprice")


@check("association_summary_lineitem")
def _(t):
    return association.association_summary(t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))


# ---- tests --------------------------------------------------------------------------------

@check("probability_value", """SELECT 'value' AS "column", count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, (60 - avg(value)) / stddev_samp(value) AS z_score,
 1.0 * count(*) FILTER (WHERE value <= 60) / count(*) AS empirical_p_below FROM events""", "mean std z_score empirical_p_below")
def _(t):
    return hypothesis.probability(t.events, "value", 60.0).select("column", "n", "mean", "std", "z_score", "empirical_p_below")


@check("mean_ci_by_type", """WITH g AS (SELECT event_type AS "group", count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM events GROUP BY 1 HAVING n >= 2),
t AS (SELECT *, (n - 1)::DOUBLE AS v, 1.959963984540054::DOUBLE AS z FROM g),
q AS (SELECT *, z + (pow(z, 3) + z) / (4 * v) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * v * v)
  + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(v, 3))
  + (79 * pow(z, 9) + 776 * pow(z, 7) + 1482 * pow(z, 5) - 1920 * pow(z, 3) - 945 * z) / (92160 * pow(v, 4)) AS t FROM t)
SELECT "group", n, mean, std, 0.95::DOUBLE AS level, t * std / sqrt(n) AS margin, mean - t * std / sqrt(n) AS low, mean + t * std / sqrt(n) AS high FROM q""",
       "mean std level margin low high")
def _(t):
    return hypothesis.mean_ci(t.events, "value", 0.95, "event_type")


@check("welch_acctbal", """WITH g AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1 ORDER BY 1 LIMIT 2),
p AS (SELECT a.g AS group_a, b.g AS group_b, a.m AS mean_a, b.m AS mean_b, a.v / a.n AS x, b.v / b.n AS y, a.n AS na, b.n AS nb FROM g a JOIN g b ON a.g < b.g)
SELECT group_a, group_b, mean_a, mean_b, (mean_a - mean_b) / sqrt(x + y) AS statistic, pow(x + y, 2) / (x * x / (na - 1) + y * y / (nb - 1)) AS df FROM p""", "mean_a mean_b statistic df")
def _(t):
    return hypothesis.welch_ttest(t.customer, "c_acctbal", "c_mktsegment").drop("p_value")


@check("anova_events", """WITH g AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1 HAVING n >= 2),
s AS (SELECT count(*) AS groups, sum(n) AS rows, sum(n * pow(m - (SELECT avg(value) FROM events), 2)) AS ss_between, sum((n - 1) * v) AS ss_within FROM g)
SELECT groups, rows, ss_between, ss_within, (ss_between / (groups - 1)) / (ss_within / (rows - groups)) AS f_statistic FROM s""", "ss_between ss_within f_statistic", "rows")
def _(t):
    return hypothesis.anova(t.events, "value", "event_type").drop("p_value")


@check("chi_square_orders", f"SELECT chi2 AS statistic, (ka - 1) * (kb - 1) AS dof, n FROM {chi_sql('orders', 'o_orderstatus', 'o_orderpriority')}", "statistic")
def _(t):
    return hypothesis.chi_square(t.orders, "o_orderstatus", "o_orderpriority").drop("p_value")


@check("chi_square_two_by_two", f"SELECT chi2 AS statistic, (ka - 1) * (kb - 1) AS dof, n FROM {chi_sql('labels', 'quality', 'toxic')}", "statistic")
def _(t):
    return hypothesis.chi_square(t.labels, "quality", "toxic").drop("p_value")


@check("ttest_two_columns", """WITH s AS (SELECT count(*) AS n, avg(l_discount) AS a, avg(l_tax) AS b, var_samp(l_discount) AS v, var_samp(l_tax) AS w FROM lineitem)
SELECT 'ttest' AS test, a AS mean_a, b AS mean_b, (a - b) / sqrt((v + w) / 2 * (2.0 / n)) AS statistic, 2.0 * n - 2 AS df FROM s""", "mean_a mean_b statistic df")
def _(t):
    return hypothesis.two_sample(t.lineitem, "l_discount", "l_tax", "ttest").drop("p_value")


BOTH = "b AS (SELECT l_discount AS x, 1 AS a FROM lineitem UNION ALL SELECT l_tax, 0 FROM lineitem)"


@check("mannwhitney_two_columns", f"""WITH {BOTH}, r AS (SELECT a, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM b)
SELECT 'mannwhitney' AS test, sum(a) AS n_a, sum(1 - a) AS n_b, sum(a * r) - sum(a) * (sum(a) + 1) / 2.0 AS statistic FROM r""", "statistic", "n_a n_b")
def _(t):
    return hypothesis.two_sample(t.lineitem, "l_discount", "l_tax", "mannwhitney").drop("p_value")


@check("ks_two_columns", f"""WITH {BOTH}, g AS (SELECT x, sum(a) AS p, sum(1 - a) AS q FROM b GROUP BY 1), c AS (SELECT sum(p) OVER (ORDER BY x) AS p, sum(q) OVER (ORDER BY x) AS q, sum(p) OVER () AS n, sum(q) OVER () AS m FROM g)
SELECT 'ks' AS test, max(n) AS n_a, max(m) AS n_b, max(abs(1.0 * p / n - 1.0 * q / m)) AS statistic FROM c""", "statistic", "n_a n_b")
def _(t):
    return hypothesis.two_sample(t.lineitem, "l_discount", "l_tax", "ks").drop("p_value")


@check("normality_heuristic_lineitem", f"""WITH long AS ({long_sql('lineitem', LINE)}), s AS (SELECT "column", skewness(x) AS skew, kurtosis(x) AS kurtosis FROM long GROUP BY 1)
SELECT *, abs(skew) < 0.5 AND abs(kurtosis) < 1 AS likely_normal FROM s""", "skew kurtosis")
def _(t):
    return hypothesis.normality_heuristic(t.lineitem)


@check("dagostino_lineitem", f"""WITH long AS ({long_sql('lineitem', LINE)}), s AS (SELECT "column", count(x)::DOUBLE AS n, avg(x) AS m FROM long GROUP BY 1),
c AS (SELECT "column", any_value(n) AS n, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4 FROM long JOIN s USING ("column") GROUP BY 1),
g AS (SELECT *, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) - 3 AS g2 FROM c),
a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
  (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / (pow(n + 1, 2) * (n + 3) * (n + 5))) AS x,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS root FROM g),
b AS (SELECT *, sqrt(2 * (beta2 - 1)) - 1 AS w2, 6 + 8 / root * (2 / root + sqrt(1 + 4 / (root * root))) AS d FROM a),
z AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs, (1 - 2 / d) / (1 + x * sqrt(2 / (d - 4))) AS r FROM b),
k AS (SELECT "column", n::BIGINT AS n, zs * zs + pow((1 - 2 / (9 * d) - sign(r) * pow(abs(r), 1.0 / 3)) / sqrt(2 / (9 * d)), 2) AS statistic FROM z)
SELECT *, exp(-statistic / 2) AS p_value, exp(-statistic / 2) > 0.05 AS is_normal FROM k""", "statistic p_value")
def _(t):
    return hypothesis.dagostino(t.lineitem)


@check("ks_normal_events")
def _(t):
    return hypothesis.ks_normal(t.events)


@check("ks_standard_normal_acctbal")
def _(t):
    return hypothesis.ks_normal(t.customer.select((F.col("c_acctbal") / 5000 - 1).alias("z")), standard=True)


@check("shapiro_events")
def _(t):
    return hypothesis.shapiro(t.events, "event_id")


@check("anderson_events")
def _(t):
    return hypothesis.anderson(t.events)


@check("fit_distribution_value")
def _(t):
    return hypothesis.fit_distribution(t.events.select("value"))


@check("qq_points_value", """WITH p AS (SELECT (range + 0.5) / 100 AS p FROM range(100)), v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () - 1 AS n FROM events)
SELECT p, a.value + (b.value - a.value) * (p * a.n - floor(p * a.n)) AS sample FROM p JOIN v a ON a.i = floor(p * a.n) JOIN v b ON b.i = ceil(p * b.n)""", "p sample")
def _(t):
    return hypothesis.qq_points(t.events, "value", 100).drop("theoretical")


def _experiment(t):
    return t.events.select((F.col("user_id") % 2).alias("arm"), (F.col("value") > 50).cast("int").alias("won"))


@check("ab_test_events", """WITH g AS (SELECT user_id % 2 AS arm, count(*) AS n, count(*) FILTER (WHERE value > 50) AS x FROM events GROUP BY 1),
p AS (SELECT a.n AS n1, a.x / a.n AS r1, b.n AS n2, b.x / b.n AS r2, (a.x + b.x) / (a.n + b.n) AS pool FROM g a, g b WHERE a.arm = 0 AND b.arm = 1),
z AS (SELECT *, (r2 - r1) / sqrt(pool * (1 - pool) * (1.0 / n1 + 1.0 / n2)) AS z_score FROM p)
SELECT '0' AS control, '1' AS variant, n1 AS n_control, n2 AS n_variant, r1 AS rate_control, r2 AS rate_variant, r2 - r1 AS absolute_lift, (r2 - r1) / r1 AS relative_lift, z_score, abs(z_score) > 1.959963985 AS significant FROM z""",
       "rate_control rate_variant absolute_lift relative_lift z_score")
def _(t):
    return hypothesis.ab_test(_experiment(t), "arm", "won", 0, 1).drop("p_value")


@check("bayes_ab_events", """WITH g AS (SELECT user_id % 2 AS arm, count(*) AS n, count(*) FILTER (WHERE value > 50) AS x FROM events GROUP BY 1)
SELECT '0' AS control, '1' AS variant, (a.x + 1) / (a.n + 2) AS mean_control, (b.x + 1) / (b.n + 2) AS mean_variant, (b.x + 1) / (b.n + 2) - (a.x + 1) / (a.n + 2) AS expected_uplift
FROM g a, g b WHERE a.arm = 0 AND b.arm = 1""", "mean_control mean_variant expected_uplift")
def _(t):
    return hypothesis.bayes_ab(_experiment(t), "arm", "won", 0, 1).select("control", "variant", "mean_control", "mean_variant", "expected_uplift")


@check("bayes_ab_probability")
def _(t):
    return hypothesis.bayes_ab(_experiment(t), "arm", "won", 0, 1)


@check("auto_test_numeric", f"""WITH {BOTH}, s AS (SELECT count(*) AS n, avg(l_discount) AS a, avg(l_tax) AS b, var_samp(l_discount) AS v, var_samp(l_tax) AS w FROM lineitem),
r AS (SELECT a, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM b)
SELECT 'welch' AS test, (a - b) / sqrt(v / n + w / n) AS statistic FROM s UNION ALL SELECT 'mannwhitney', sum(a * r) - sum(a) * (sum(a) + 1) / 2.0 FROM r""", "statistic")
def _(t):
    return hypothesis.auto_test(t.lineitem, "l_discount", "l_tax").drop("p_value")


@check("auto_test_categorical", f"SELECT 'chi_square' AS test, chi2 AS statistic FROM {chi_sql('documents', 'lang', 'source')}", "statistic")
def _(t):
    return hypothesis.auto_test(t.documents, "lang", "source").drop("p_value")


@check("statistical_summary_events")
def _(t):
    return hypothesis.statistical_summary(t.events)


# ---- series -------------------------------------------------------------------------------

@check("prepare_series_events", """SELECT event_type AS key, count(*) AS n, sum(value) AS total, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts FROM events GROUP BY 1 HAVING n >= 20""", "total")
def _(t):
    rows = series.prepare_series(t.events, "ts", "value", ["event_type"])
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


@check("frequency_hint_events", """WITH d AS (SELECT DISTINCT event_type AS key, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS i FROM d),
g AS (SELECT key, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY key ORDER BY ts) AS gap FROM r WHERE i <= 50), c AS (SELECT key, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2)
SELECT key, arg_min(gap, (-n, gap)) AS gap_seconds FROM c GROUP BY 1""")
def _(t):
    return series.frequency_hint(series.prepare_series(t.events, "ts", "value", ["event_type"]))


@check("forecast_orders_by_status")
def _(t):
    return series.forecast(t.orders, "o_orderdate", "o_totalprice", ["o_orderstatus"], (1, 1, 1), 12).drop("ts")


@check("forecast_seasonal_orders")
def _(t):
    return series.forecast(t.orders, "o_orderdate", "o_totalprice", [], (1, 0, 1), 14, (1, 1, 0, 7)).drop("ts")


@check("align_forecasts_orders")
def _(t):
    plain = series.forecast(t.orders, "o_orderdate", "o_totalprice", ["o_orderstatus"], (1, 0, 0), 6)
    seasonal = series.forecast(t.orders, "o_orderdate", "o_totalprice", ["o_orderstatus"], (1, 0, 0), 6, (1, 0, 0, 7))
    return series.align_forecasts(plain, seasonal)
