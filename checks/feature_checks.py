"""Feature engineering, preprocessing and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import DIRTY_ORDERS, FENCES, LABELLED, LINE, ORDER, check, long_sql
from checks.profile_checks import SEVERITY
from checks.statistics_checks import chi_sql
from plumbline.ml import isolation, neighbors
from plumbline.operators import features, preprocessing, scoring

# ---- features -----------------------------------------------------------------------------


@check("date_features_orders", "SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month, day(o_orderdate) AS o_orderdate_day, dayofweek(o_orderdate) AS o_orderdate_weekday FROM orders",
       "", "o_orderdate_year o_orderdate_month o_orderdate_day o_orderdate_weekday")
def _(t):
    return features.date_features(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate"]).drop("o_orderdate")


_in = lambda words: ", ".join(f"'{w}'" for w in words)


@check("text_features_conversations", f"""WITH s AS (SELECT conv_id, turn, regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS x,
 [w FOR w IN regexp_split_to_array(lower(text), '[^a-z0-9]+') IF w <> ''] AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN x = '' THEN 0 ELSE len(regexp_split_to_array(x, '[\\s\\p{{Z}}]+')) END AS text_word_count,
 CASE WHEN len(w) = 0 THEN 0.0 ELSE (len([v FOR v IN w IF v IN ({_in(features.POSITIVE_WORDS)})]) - len([v FOR v IN w IF v IN ({_in(features.NEGATIVE_WORDS)})])) / len(w) END AS text_sentiment FROM s""",
       "text_sentiment", "text_word_count")
def _(t):
    return features.text_features(t.conversations, ["text"]).select("conv_id", "turn", "text_word_count", "text_sentiment")


@check("interactions_lineitem", "SELECT l_orderkey, l_linenumber, l_quantity * l_discount AS l_quantity_x_l_discount, CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END AS l_quantity_div_l_discount FROM lineitem",
       "l_quantity_x_l_discount l_quantity_div_l_discount", "l_linenumber")
def _(t):
    return features.interactions(t.lineitem, "l_quantity", "l_discount").select("l_orderkey", "l_linenumber", "l_quantity_x_l_discount", "l_quantity_div_l_discount")


@check("label_encode_part", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand_code FROM part")
def _(t):
    return features.label_encode(t.part, ["p_brand"]).select("p_partkey", "p_brand_code")


@check("one_hot_orders", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS BIGINT) AS \"o_orderstatus_F\", CAST(o_orderstatus = 'O' AS BIGINT) AS \"o_orderstatus_O\", CAST(o_orderstatus = 'P' AS BIGINT) AS \"o_orderstatus_P\" FROM orders")
def _(t):
    return features.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderstatus"]).drop("o_orderstatus")


@check("rescale_minmax_lineitem", "SELECT l_orderkey, l_linenumber, (l_quantity - (SELECT min(l_quantity) FROM lineitem)) / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem) AS l_quantity FROM lineitem", "l_quantity", "l_linenumber")
def _(t):
    return features.rescale(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], "minmax")


@check("rescale_zscore_lineitem", "SELECT l_orderkey, l_linenumber, (l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem) AS l_quantity FROM lineitem", "l_quantity", "l_linenumber")
def _(t):
    return features.rescale(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], "zscore")


@check("drop_low_value_lineitem", "SELECT l_orderkey, l_quantity FROM lineitem WHERE (SELECT var_pop(l_discount) < 0.5 AND var_pop(l_tax) < 0.5 AND var_pop(l_quantity) > 0.5 FROM lineitem)", "l_quantity")
def _(t):
    return features.drop_low_value(t.lineitem.select("l_orderkey", "l_quantity", "l_discount", "l_tax"), variance=0.5)


@check("corr_importance_orders", """WITH c AS (SELECT o_orderkey, o_custkey, o_totalprice, dense_rank() OVER (ORDER BY o_orderstatus) AS s, dense_rank() OVER (ORDER BY o_orderpriority) AS p FROM orders)
SELECT 'o_orderkey' AS feature, abs(corr(o_orderkey, o_totalprice)) AS importance FROM c UNION ALL SELECT 'o_custkey', abs(corr(o_custkey, o_totalprice)) FROM c
UNION ALL SELECT 'o_orderstatus', abs(corr(s, o_totalprice)) FROM c UNION ALL SELECT 'o_orderpriority', abs(corr(p, o_totalprice)) FROM c""", "importance")
def _(t):
    return features.corr_importance(t.orders, "o_totalprice")


PCA_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@check("pca_standardized_lineitem")
def _(t):
    return features.pca(t.lineitem, PCA_COLS, 3).explained(t.spark)


@check("pca_two_columns", """WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
SELECT 1 AS component, (1 + r) / 2 AS ratio, (1 + r) / 2 AS ratio_of_kept FROM r UNION ALL SELECT 2, (1 - r) / 2, (1 - r) / 2 FROM r""", "ratio ratio_of_kept", "component")
def _(t):
    return features.pca(t.lineitem, ["l_quantity", "l_extendedprice"], 2).explained(t.spark)


@check("pca_unscaled_scores")
def _(t):
    scored = features.pca(t.lineitem, PCA_COLS, 3, standardize=False).transform(t.lineitem)
    return scored.select("l_orderkey", "l_linenumber", "pc1", "pc2", "pc3")


@check("reduction_input_orders_dirty", f"WITH {DIRTY_ORDERS} SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice FROM orders_dirty WHERE o_totalprice IS NOT NULL", "o_orderkey o_custkey o_totalprice")
def _(t):
    return features.reduction_input(t.orders_dirty)


# ---- preprocessing ------------------------------------------------------------------------

SMALL = ["o_orderkey", "o_totalprice", "o_orderpriority"]

for _strategy, _value in (("mean", "(SELECT avg(o_totalprice) FROM orders_dirty)"), ("median", "(SELECT quantile_cont(o_totalprice, 0.5) FROM orders_dirty)"),
                          ("auto", "(SELECT quantile_cont(o_totalprice, 0.5) FROM orders_dirty)"),
                          ("mode", "(SELECT o_totalprice FROM orders_dirty WHERE o_totalprice IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")):
    @check(f"impute_{_strategy}_orders_dirty", f"WITH {DIRTY_ORDERS} SELECT o_orderkey, coalesce(o_totalprice, {_value}) AS o_totalprice FROM orders_dirty", "o_totalprice")
    def _(t, strategy=_strategy):
        view = t.orders_dirty.select("o_orderkey", "o_totalprice")
        return preprocessing.fit_impute(view, strategy, ["o_totalprice"]).transform(view)


@check("impute_drop_orders_dirty", f"WITH {DIRTY_ORDERS} SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders_dirty WHERE o_totalprice IS NOT NULL", "o_totalprice")
def _(t):
    view = t.orders_dirty.select(*SMALL)
    return preprocessing.fit_impute(view, "drop").transform(view)


def _gappy(t):
    """Line items with every seventh part's quantity and every fifth supplier's price removed."""
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")).alias("q"),
                             F.when(F.col("l_suppkey") % 5 != 0, F.col("l_extendedprice")).alias("p"), "l_discount", "l_tax")


@check("impute_iterative_lineitem")
def _(t):
    view = _gappy(t)
    return preprocessing.fit_impute_iterative(view, ["q", "p", "l_discount", "l_tax"]).transform(view)


@check("impute_knn_customer", """WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS b, c_nationkey::DOUBLE AS k FROM customer),
r AS (SELECT q.c_custkey, d.b, row_number() OVER (PARTITION BY q.c_custkey ORDER BY abs(q.k - d.k), d.c_custkey::VARCHAR) AS place FROM v q JOIN v d ON q.b IS NULL AND d.b IS NOT NULL),
m AS (SELECT c_custkey, avg(b) AS m FROM r WHERE place <= 5 GROUP BY 1)
SELECT c_custkey, coalesce(b, m) AS c_acctbal, k AS c_nationkey FROM v LEFT JOIN m USING (c_custkey)""", "c_acctbal c_nationkey")
def _(t):
    view = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.col("c_nationkey").cast("double").alias("c_nationkey"))
    return neighbors.impute_knn(view, ["c_acctbal", "c_nationkey"], "c_custkey")


@check("fit_outliers_clip_events", "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a)) AS value FROM events, q", "value")
def _(t):
    view = t.events.select("event_id", "value")
    return preprocessing.fit_outliers(view, "clip", ["value"]).transform(view)


@check("winsorize_lineitem", """WITH r AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem),
b AS (SELECT max(x) FILTER (WHERE i = floor(0.05 * n)) AS lo, max(x) FILTER (WHERE i = n - 1 - floor(0.05 * n)) AS hi FROM r)
SELECT l_orderkey, l_linenumber, least(greatest(l_extendedprice, lo), hi) AS l_extendedprice FROM lineitem, b""", "l_extendedprice", "l_linenumber")
def _(t):
    return preprocessing.winsorize(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"])


@check("isolation_forest_events")
def _(t):
    view = t.events.select("event_id", "user_id", "value")
    return isolation.fit_isolation_forest(view, ["value", "user_id"], "event_id").transform(view).drop("user_id", "value")


def _encoded(t, table, col, method, target=None):
    view = getattr(t, table)
    (step,) = preprocessing.fit_encode(view, [col], method, target)
    return step.transform(view)


@check("label_encoder_part", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS p_type FROM part", "p_type")
def _(t):
    return _encoded(t, "part", "p_type", "label").select("p_partkey", "p_type")


@check("onehot_encoder_lineitem", "SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'A' AS BIGINT) AS \"l_returnflag_A\", CAST(l_returnflag = 'N' AS BIGINT) AS \"l_returnflag_N\", CAST(l_returnflag = 'R' AS BIGINT) AS \"l_returnflag_R\" FROM lineitem", "", "l_linenumber")
def _(t):
    return _encoded(t, "lineitem", "l_returnflag", "auto").select("l_orderkey", "l_linenumber", "l_returnflag_A", "l_returnflag_N", "l_returnflag_R")


@check("frequency_encode_part", "SELECT p_partkey, 1.0 * count(*) OVER (PARTITION BY p_brand) / count(*) OVER () AS p_brand FROM part", "p_brand")
def _(t):
    return _encoded(t, "part", "p_brand", "frequency").select("p_partkey", "p_brand")


@check("target_encode_part", "SELECT p_partkey, avg(p_retailprice) OVER (PARTITION BY p_brand) AS p_brand FROM part", "p_brand")
def _(t):
    return _encoded(t, "part", "p_brand", "target", "p_retailprice").select("p_partkey", "p_brand")


@check("frequency_encode_unseen", """WITH f AS (SELECT lang, 1.0 * count(*) / (SELECT count(*) FROM labels JOIN documents USING (doc_id)) AS s FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT doc_id, coalesce(s, 0.0) AS lang FROM documents LEFT JOIN f USING (lang)""", "lang")
def _(t):
    (step,) = preprocessing.fit_encode(t.labelled, ["lang"], "frequency")
    return step.transform(t.documents.select("doc_id", "lang"))


@check("target_encode_out_of_fold_orders")
def _(t):
    return preprocessing.target_encode_out_of_fold(t.orders, "o_orderpriority", "o_totalprice", "o_orderkey").select("o_orderkey", "o_orderpriority_target")


for _method, _expr in (("standard", "(c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer)"),
                       ("minmax", "(c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer)"),
                       ("robust", "(c_acctbal - (SELECT quantile_cont(c_acctbal, 0.5) FROM customer)) / (SELECT quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) FROM customer)"),
                       ("maxabs", "c_acctbal / (SELECT max(abs(c_acctbal)) FROM customer)")):
    @check(f"scale_{_method}_customer", f"SELECT c_custkey, {_expr} AS c_acctbal FROM customer", "c_acctbal")
    def _(t, method=_method):
        view = t.customer.select("c_custkey", "c_acctbal")
        return preprocessing.fit_scale(view, ["c_acctbal"], method).transform(view)


@check("scale_quantile_events")
def _(t):
    view = t.events.select("event_id", "value")
    return preprocessing.fit_scale(view, ["value"], "quantile").transform(view)


@check("select_by_variance_lineitem", "SELECT \"column\" FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", var_pop({c}) AS v FROM lineitem" for c in LINE) + ") WHERE v > 0.01")
def _(t):
    return t.spark.createDataFrame([(c,) for c in preprocessing.select_by_variance(t.lineitem)], "column string")


@check("select_by_correlation_part", "SELECT unnest(['p_size', 'p_retailprice']) AS \"column\" FROM (SELECT abs(corr(p_retailprice, p_retailprice * 2 + p_size / 50.0)) AS r FROM part) WHERE r > 0.95")
def _(t):
    view = t.part.select("p_size", "p_retailprice", (F.col("p_retailprice") * 2 + F.col("p_size") / 50.0).alias("list_price"))
    return t.spark.createDataFrame([(c,) for c in preprocessing.select_by_correlation(view)], "column string")


@check("preprocessor_orders_dirty", f"""WITH {DIRTY_ORDERS}, m AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders_dirty), i AS (SELECT o_orderkey, o_orderstatus, coalesce(o_totalprice, m) AS p FROM orders_dirty, m),
q AS (SELECT quantile_cont(p, 0.25) AS a, quantile_cont(p, 0.75) AS b FROM i), c AS (SELECT o_orderkey, o_orderstatus, least(greatest(p, a - 1.5 * (b - a)), b + 1.5 * (b - a)) AS p FROM i, q)
SELECT o_orderkey, round((p - (SELECT avg(p) FROM c)) / (SELECT stddev_pop(p) FROM c), 6) AS o_totalprice, CAST(o_orderstatus = 'F' AS BIGINT) AS "o_orderstatus_F", CAST(o_orderstatus = 'O' AS BIGINT) AS "o_orderstatus_O", CAST(o_orderstatus = 'P' AS BIGINT) AS "o_orderstatus_P" FROM c""", "o_totalprice")
def _(t):
    view = t.orders_dirty.select("o_orderkey", "o_totalprice", "o_orderstatus")
    return preprocessing.fit_preprocessor(view, "o_orderkey").transform(view).withColumn("o_totalprice", F.round("o_totalprice", 6))


@check("preprocessor_report_orders_dirty")
def _(t):
    return preprocessing.fit_preprocessor(t.orders_dirty, "o_orderkey").report(t.spark)


@check("smote_labels", f"""WITH c AS (SELECT CAST(toxic AS VARCHAR) AS toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT toxic, false AS synthetic, n FROM c UNION ALL SELECT arg_min(toxic, (n, toxic)), true, max(n) - min(n) FROM c""")
def _(t):
    return neighbors.smote(t.labelled, "toxic", ["n_chars", "quality"], "doc_id").groupBy("toxic", "synthetic").agg(F.count("*").alias("n"))


@check("undersample_labels", "SELECT quality, min(count(*)) OVER () AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1", "", "quality")
def _(t):
    return preprocessing.undersample(t.labelled, "quality", "doc_id").groupBy("quality").agg(F.count("*").alias("n"))


@check("balance_advice_quality", f"""WITH c AS (SELECT quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), s AS (SELECT max(n) AS a, min(n) AS b, sum(n) AS t, arg_max(quality, n) AS x, arg_min(quality, n) AS y FROM c),
r AS (SELECT *, a / b AS imbalance_ratio FROM s)
SELECT imbalance_ratio > 1.5 AS imbalanced, imbalance_ratio, CAST(x AS VARCHAR) AS majority_class, CAST(y AS VARCHAR) AS minority_class, 100.0 * b / t AS minority_pct, {SEVERITY},
 imbalance_ratio > 3 AND b > 6 AS smote_recommended, CASE WHEN imbalance_ratio > 3 AND b > 6 THEN CAST(trunc(0.5 * a - b) AS BIGINT) ELSE 0 END AS samples_to_generate,
 CASE WHEN imbalance_ratio > 10 THEN 'oversample with SMOTE; consider balanced ensembles' WHEN imbalance_ratio > 5 THEN 'use class weights; consider SMOTE above 50 minority rows'
 WHEN imbalance_ratio > 2 THEN 'use class weights; monitor precision and recall' ELSE '' END || CASE WHEN b < 30 THEN '; collect more minority rows' ELSE '' END AS recommendations FROM r""", "imbalance_ratio minority_pct", "samples_to_generate")
def _(t):
    return scoring.balance_advice(t.labelled, "quality")


# ---- scoring ------------------------------------------------------------------------------

def _mi_sql(source, x, y, bins):
    edges = ", ".join(str(i / bins) for i in range(1, bins))
    return f"""(WITH v AS (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS VARCHAR) AS y FROM {source}), e AS (SELECT list_distinct(quantile_cont(x, [{edges}])) AS e FROM v),
b AS (SELECT len([q FOR q IN e IF x > q]) AS b, y FROM v, e), j AS (SELECT b, y, count(*) AS n FROM b GROUP BY 1, 2),
p AS (SELECT n, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM j)
SELECT sum(n / t * ln(n * t / (nb * ny))) AS mi FROM p)"""


@check("mutual_info_labels", f"WITH {LABELLED} SELECT 'n_chars' AS feature, mi FROM {_mi_sql('labelled', 'n_chars', 'quality', 20)}", "mi")
def _(t):
    return scoring.mutual_info(t.labelled, ["n_chars"], "quality")


@check("mutual_info_numeric_target", f"""WITH v AS (SELECT l_quantity, l_discount, (SELECT list_distinct(quantile_cont(l_extendedprice, [{', '.join(str(i / 10) for i in range(1, 10))}])) FROM lineitem) AS e, l_extendedprice AS p FROM lineitem),
w AS (SELECT l_quantity, l_discount, len([q FOR q IN e IF p > q]) AS y FROM v)
SELECT 'l_quantity' AS feature, mi FROM {_mi_sql('w', 'l_quantity', 'y', 10)} UNION ALL SELECT 'l_discount', mi FROM {_mi_sql('w', 'l_discount', 'y', 10)}""", "mi")
def _(t):
    return scoring.mutual_info(t.lineitem, ["l_quantity", "l_discount"], "l_extendedprice", bins=10)


# Every row against every other of its class and of the table, which SQL can do at this size.
@check("mutual_info_nearest_labels", """WITH f AS (SELECT row_number() OVER () AS i, 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS x, quality AS y FROM documents JOIN labels USING (doc_id)),
c AS (SELECT y, count(*) AS n FROM f GROUP BY 1), p AS (SELECT f.*, n, least(3, n - 1) AS near FROM f JOIN c USING (y) WHERE n > 1),
d AS (SELECT a.i, abs(a.x - b.x) AS gap, row_number() OVER (PARTITION BY a.i ORDER BY abs(a.x - b.x)) AS r, a.near FROM p a JOIN p b ON a.y = b.y AND a.i <> b.i),
r AS (SELECT i, max(gap) AS radius FROM d WHERE r = near GROUP BY 1),
m AS (SELECT a.i, any_value(a.near) AS near, any_value(a.n) AS n, count(*) AS m FROM p a JOIN r ON a.i = r.i JOIN p b ON abs(a.x - b.x) < radius * (1 - 1e-6) OR a.x = b.x GROUP BY 1),
h AS (SELECT g AS n, coalesce(list_sum([1.0 / j FOR j IN range(1, g)]), 0) - 0.5772156649015329 AS psi FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM f))) AS g))
SELECT 'n_chars' AS feature, greatest(0, (SELECT psi FROM h WHERE n = (SELECT count(*) FROM m)) + avg(hk.psi) - avg(hn.psi) - avg(hm.psi)) AS mi
FROM m JOIN h hk ON hk.n = near JOIN h hn ON hn.n = m.n JOIN h hm ON hm.n = m""", "mi")
def _(t):
    return scoring.mutual_info_nearest(t.labelled, ["n_chars"], "quality")
@check("feature_scores_labels", f"""WITH {LABELLED} SELECT 'n_chars' AS feature, mi AS score, 'numeric' AS kind FROM {_mi_sql('labelled', 'n_chars', 'quality', 20)}
UNION ALL SELECT 'toxic', mi, 'numeric' FROM {_mi_sql('labelled', 'toxic', 'quality', 20)}
UNION ALL SELECT 'lang', sqrt(chi2 / (n * (least(ka, kb) - 1))), 'categorical' FROM {chi_sql('labelled', 'lang', 'quality')}
UNION ALL SELECT 'source', sqrt(chi2 / (n * (least(ka, kb) - 1))), 'categorical' FROM {chi_sql('labelled', 'source', 'quality')}""", "score")
def _(t):
    return scoring.feature_scores(t.labelled.drop("doc_id"), "quality")


@check("anova_scores_part", """WITH g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m, var_samp(p_retailprice) AS v FROM part GROUP BY 1 HAVING n >= 2),
s AS (SELECT count(*) AS k, sum(n) AS rows, sum(n * pow(m - (SELECT sum(n * m) / sum(n) FROM g), 2)) AS b, sum((n - 1) * v) AS w FROM g)
SELECT 'p_brand' AS feature, least((b / (k - 1)) / (w / (rows - k)) / 100, 1.0) AS score FROM s""", "score")
def _(t):
    return scoring.anova_scores(t.part, ["p_brand"], "p_retailprice")


@check("target_leakage_lineitem", """SELECT 'total' AS feature, 'perfect correlation' AS reason, 'high' AS severity, abs(corr(l_extendedprice * 1.1, l_extendedprice)) AS correlation FROM lineitem
UNION ALL SELECT 'l_extendedprice_post', 'name', 'medium', NULL UNION ALL SELECT 'l_extendedprice_post', 'post-event date', 'medium', NULL""", "correlation")
def _(t):
    return scoring.target_leakage(t.lineitem.select("l_extendedprice", (F.col("l_extendedprice") * 1.1).alias("total"), F.col("l_shipdate").alias("l_extendedprice_post")), "l_extendedprice")


def _advice_sql():
    return f"""WITH long AS ({long_sql('events', ['event_id', 'user_id', 'value'])}), {FENCES},
s AS (SELECT "column", skewness(x) AS skew, 100.0 * count(*) FILTER (WHERE x < lo OR x > hi) / count(*) AS outlier_pct, min(x) AS lo_x, max(x) AS hi_x FROM long JOIN fences USING ("column") GROUP BY 1),
a AS (SELECT *, list_concat(list_concat(CASE WHEN abs(skew) > 1 THEN CASE WHEN skew > 0 AND lo_x > 0 THEN ['log_transform', 'sqrt_transform', 'box_cox'] ELSE ['sqrt_transform', 'box_cox'] END ELSE [] END,
 CASE WHEN outlier_pct > 5 THEN ['robust_scaling', 'winsorization'] ELSE [] END), CASE WHEN lo_x >= 0 AND hi_x <= 1 THEN ['already_normalized'] ELSE ['min_max_scaling', 'standard_scaling'] END) AS l FROM s)"""


@check("recommend_transforms_events", _advice_sql() + " SELECT \"column\", array_to_string(l[1:3], ', ') AS recommended, skew, outlier_pct FROM a", "skew outlier_pct")
def _(t):
    return scoring.recommend_transforms(t.events)


@check("recommend_encodings_part", """WITH d AS (SELECT 'p_name' AS c, count(DISTINCT p_name) AS k, count(*) AS n FROM part UNION ALL SELECT 'p_brand', count(DISTINCT p_brand), count(*) FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type), count(*) FROM part)
SELECT c AS "column", CASE WHEN k = 2 THEN 'label_encoding, binary_encoding' WHEN k <= 10 THEN 'one_hot_encoding, target_encoding' WHEN k <= 50 THEN 'target_encoding, frequency_encoding' ELSE 'frequency_encoding, target_encoding' END AS recommended,
 k AS distinct_values, CASE WHEN k / n > 0.5 THEN 'high' ELSE 'low' END AS cardinality FROM d""")
def _(t):
    return scoring.recommend_encodings(t.part, "p_retailprice")


@check("transform_counts_events", _advice_sql() + """, e AS (SELECT unnest(l[1:3]) AS "transform" FROM a UNION ALL SELECT unnest(CASE WHEN k = 2 THEN ['label_encoding', 'binary_encoding'] WHEN k <= 10 THEN ['one_hot_encoding']
 WHEN k <= 50 THEN ['target_encoding', 'frequency_encoding'] ELSE ['frequency_encoding', 'target_encoding'] END) FROM (SELECT count(DISTINCT event_type) AS k FROM events UNION ALL SELECT count(DISTINCT props) FROM events))
SELECT "transform", count(*) AS columns FROM e GROUP BY 1""")
def _(t):
    return scoring.transform_counts(t.events)


@check("imputation_advice_orders_dirty", f"""WITH {DIRTY_ORDERS}, m AS (SELECT count(*) - count(o_totalprice) AS missing, 100.0 * (count(*) - count(o_totalprice)) / count(*) AS missing_pct FROM orders_dirty)
SELECT 'o_totalprice' AS "column", missing, missing_pct, CASE WHEN missing_pct > 50 THEN 'drop column' WHEN missing_pct > 20 THEN 'multiple imputation' ELSE 'mean, median or knn' END AS strategy FROM m""", "missing_pct")
def _(t):
    return scoring.imputation_advice(t.orders_dirty)


@check("ml_readiness_labels", f"""WITH {LABELLED}, r AS (SELECT max(n) / min(n) AS r FROM (SELECT count(*) AS n FROM labelled GROUP BY quality)), s AS (SELECT 100.0 - CASE WHEN r >= 10 THEN 15 WHEN r >= 5 THEN 10 ELSE 0 END AS score FROM r)
SELECT 'quality' AS target, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s""", "score")
def _(t):
    return scoring.ml_readiness(t.labelled, "quality")


@check("ml_readiness_no_target", f"""WITH {DIRTY_ORDERS}, h AS (SELECT count(*) AS n FROM orders_dirty GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)
SELECT 100.0 * (SELECT count(*) - count(o_totalprice) FROM orders_dirty) / (6 * sum(n)) AS missing_pct, 100.0 * (sum(n) - count(*)) / sum(n) AS duplicate_pct, 3 AS numeric_features, 2 AS categorical_features FROM h""",
       "missing_pct duplicate_pct", "numeric_features categorical_features")
def _(t):
    return scoring.ml_readiness(t.orders_dirty)
