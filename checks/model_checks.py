"""Model metrics, training and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import LABELLED, check
from plumbline.ml import clustering, metrics, training
from plumbline.ml.dbscan import dbscan
from plumbline.ml.histogram_boosting import fit_histogram_boosting
from plumbline.plans.frames import shared_folder

# ---- metrics over a rule: long documents are predicted to be of quality 1 -----------------

RULE = "p AS (SELECT quality AS label, CAST(n_chars > 1500 AS INT) AS prediction, n_chars AS score, toxic FROM documents JOIN labels USING (doc_id))"


def _ruled(t):
    return t.documents.join(t.labels, "doc_id").select(F.col("quality").alias("label"), (F.col("n_chars") > 1500).cast("int").alias("prediction"), F.col("n_chars").alias("score"), "toxic")


PER_CLASS = """k AS (SELECT DISTINCT label AS c FROM p UNION SELECT DISTINCT prediction FROM p),
m AS (SELECT c, count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS predicted, count(*) FILTER (WHERE label = c AND prediction = c) AS hits FROM p, k GROUP BY 1),
r AS (SELECT c, support, hits, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM m),
s AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)"""


@check("classification_metrics_labels", f"WITH {RULE}, {PER_CLASS} SELECT sum(hits) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1 FROM s",
       "accuracy precision recall f1")
def _(t):
    return metrics.classification_metrics(_ruled(t))


@check("classification_report_labels", f"WITH {RULE}, {PER_CLASS} SELECT CAST(c AS VARCHAR) AS class, precision, recall, f1, support FROM s", "precision recall f1")
def _(t):
    return metrics.classification_report(_ruled(t))


@check("confusion_labels", f"WITH {RULE}, k AS (SELECT DISTINCT label AS c FROM p UNION SELECT DISTINCT prediction FROM p) SELECT CAST(a.c AS VARCHAR) AS label, CAST(b.c AS VARCHAR) AS prediction, count(p.label) AS n FROM k a CROSS JOIN k b LEFT JOIN p ON p.label = a.c AND p.prediction = b.c GROUP BY 1, 2")
def _(t):
    return metrics.confusion_matrix(_ruled(t))


CURVE = "g AS (SELECT score, count(*) AS n, sum(label) AS tp FROM p GROUP BY 1), c AS (SELECT score, n, tp, sum(n - tp) OVER (ORDER BY score DESC) AS fp_up, sum(tp) OVER (ORDER BY score DESC) AS tp_up, sum(n - tp) OVER () AS neg, sum(tp) OVER () AS pos FROM g)"


@check("roc_labels", f"WITH {RULE}, {CURVE} SELECT CAST(score AS DOUBLE) AS threshold, fp_up / neg AS fpr, tp_up / pos AS tpr FROM c", "threshold fpr tpr")
def _(t):
    return metrics.roc_points(_ruled(t))


@check("auc_labels", f"WITH {RULE}, {CURVE} SELECT sum((n - tp) * (tp_up - tp + tp / 2.0)) / (max(neg) * max(pos)) AS auc, CAST(max(pos) AS BIGINT) AS positives, CAST(max(neg) AS BIGINT) AS negatives FROM c", "auc")
def _(t):
    return metrics.auc(_ruled(t))


PRICE = "p AS (SELECT l_extendedprice AS label, l_quantity * 2000 AS prediction FROM lineitem)"


@check("regression_metrics_lineitem", f"WITH {PRICE} SELECT 1 - avg(pow(label - prediction, 2)) / var_pop(label) AS r2, avg(abs(label - prediction)) AS mae, avg(pow(label - prediction, 2)) AS mse, sqrt(avg(pow(label - prediction, 2))) AS rmse FROM p", "r2 mae mse rmse")
def _(t):
    return metrics.regression_metrics(t.lineitem.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000).alias("prediction")))


@check("multi_output_metrics_lineitem", """WITH a AS (SELECT 'l_quantity' AS target, l_quantity AS y, 25.0 AS p FROM lineitem UNION ALL SELECT 'l_discount', l_discount, l_tax FROM lineitem),
m AS (SELECT target, 1 - avg(pow(y - p, 2)) / var_pop(y) AS r2, avg(abs(y - p)) AS mae, avg(pow(y - p, 2)) AS mse, sqrt(avg(pow(y - p, 2))) AS rmse FROM a GROUP BY 1)
SELECT target, r2, mae, mse, rmse FROM m UNION ALL SELECT 'mean', avg(r2), avg(mae), avg(mse), avg(rmse) FROM m""", "r2 mae mse rmse")
def _(t):
    view = t.lineitem.select("l_quantity", "l_discount", F.lit(25.0).alias("l_quantity_prediction"), F.col("l_tax").alias("l_discount_prediction"))
    return metrics.multi_output_metrics(view, ["l_quantity", "l_discount"], "regression")


@check("subset_accuracy_labels", f"WITH {RULE} SELECT avg(CAST(label = prediction AND toxic = 0 AS INT)) AS subset_accuracy FROM p", "subset_accuracy")
def _(t):
    view = _ruled(t).select(F.col("label").alias("quality"), F.col("prediction").alias("quality_prediction"), "toxic", F.lit(0).alias("toxic_prediction"))
    return metrics.multi_output_metrics(view, ["quality", "toxic"], "classification").where("target = 'mean'").select("subset_accuracy")


@check("meets_target_by_lang", """WITH m AS (SELECT lang AS model, avg(CAST(quality = CAST(n_chars > 1500 AS INT) AS INT)) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT *, accuracy >= 0.5 AS meets_target FROM m""", "accuracy")
def _(t):
    table = t.labelled.groupBy(F.col("lang").alias("model")).agg(F.avg((F.col("quality") == (F.col("n_chars") > 1500).cast("int")).cast("double")).alias("accuracy"))
    return metrics.meets_target(table, "accuracy", 0.5)


# ---- task, split, features ----------------------------------------------------------------

@check("detect_task_numeric", "SELECT 'l_extendedprice' AS target, 'numeric20' AS rule, CASE WHEN count(DISTINCT l_extendedprice) > 20 THEN 'regression' ELSE 'classification' END AS task FROM lineitem")
def _(t):
    return training.detect_task(t.lineitem, "l_extendedprice")


@check("detect_task_share", "SELECT 'l_linenumber' AS target, 'share' AS rule, CASE WHEN count(DISTINCT l_linenumber) <= 20 AND count(DISTINCT l_linenumber) < 0.05 * count(*) THEN 'classification' ELSE 'regression' END AS task FROM lineitem")
def _(t):
    return training.detect_task(t.lineitem, "l_linenumber", "share")


@check("detect_task_few", "SELECT 'l_discount' AS target, 'few' AS rule, CASE WHEN count(DISTINCT l_discount) < 20 THEN 'classification' ELSE 'regression' END AS task FROM lineitem")
def _(t):
    return training.detect_task(t.lineitem, "l_discount", "few")


@check("split_sizes_orders", "SELECT o_orderpriority, true AS is_test, CAST(ceil(count(*) * 0.2) AS BIGINT) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, false, count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) FROM orders GROUP BY 1")
def _(t):
    return training.split(t.orders, "o_orderpriority", 0.2, 42, "o_orderkey").groupBy("o_orderpriority", "is_test").agg(F.count("*").alias("n"))


@check("recommend_workflow_events", "SELECT 'clustering' AS workflow, NULL AS task, NULL AS target, 'event_id, user_id, value' AS features, 'silhouette' AS metric, 0.5 AS goal, 'no target-like name and 3 numeric columns' AS reason", "goal")
def _(t):
    return clustering.recommend_workflow(t.events.drop("props"))


@check("recommend_workflow_orders", "SELECT 'compare' AS workflow, 'regression' AS task, 'o_orderkey' AS target, 'o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority' AS features, 'r2' AS metric, 0.8 AS goal, count(*) || ' rows' AS reason FROM orders", "goal")
def _(t):
    return clustering.recommend_workflow(t.orders)


# ---- training -----------------------------------------------------------------------------

def _documents(t):
    return t.labelled.drop("toxic")


def _prices(t):
    """Parts with a price made from size, brand and type, so that models have something to find."""
    noise = F.pmod(F.xxhash64("p_partkey"), F.lit(1000)) / 10.0
    return t.part.select("p_partkey", "p_size", "p_type", F.col("p_retailprice").alias("p_cost"), (F.col("p_retailprice") * 1.5 + F.col("p_size") * 20 + noise).alias("price"))


def _compare(name, table, target, key, models, **options):
    @check(name)
    def _(t):
        return training.compare(table(t), target, models, id_col=key, **options)[1]


_compare("compare_linear_regressors", _prices, "price", "p_partkey", ["linear regression", "ridge", "lasso", "elastic net", "huber", "sgd regressor"])
_compare("compare_gram_regressors", _prices, "price", "p_partkey", ["bayesian ridge", "lars", "lars lasso", "omp", "ransac"])
_compare("compare_tree_regressors", _prices, "price", "p_partkey", ["decision tree", "random forest", "bagging", "gradient boosting"])
_compare("compare_distance_regressors", _prices, "price", "p_partkey", ["knn", "adaboost"])
_compare("compare_linear_classifiers", _documents, "quality", "doc_id", ["logistic regression", "ridge classifier", "sgd classifier", "linear svc"])
_compare("compare_tree_classifiers", _documents, "quality", "doc_id", ["decision tree", "random forest", "bagging", "gradient boosting"])
_compare("compare_other_classifiers", _documents, "quality", "doc_id", ["gaussian nb", "bernoulli nb", "lda", "qda", "knn"])
_compare("compare_boosted_and_neural_classifiers", _documents, "quality", "doc_id", ["histogram gradient boosting", "adaboost", "mlp"])
_compare("compare_multiclass_orders", lambda t: t.orders.select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", ["logistic regression", "decision tree", "lda"])
_compare("compare_tuned", _prices, "price", "p_partkey", ["ridge"], tuning=True, cv_folds=2)


@check("train_and_predict_parts")
def _(t):
    bundle, _scores = training.train(_prices(t), "price", "linear regression", id_col="p_partkey")
    return training.predict(bundle, _prices(t), "p_partkey").select("p_partkey", "prediction")


@check("train_and_predict_classes")
def _(t):
    bundle, _scores = training.train(_documents(t), "quality", "logistic regression", id_col="doc_id")
    return training.predict(bundle, _documents(t), "doc_id").select("doc_id", "prediction", "p_0", "p_1")


@check("train_multi_output_parts")
def _(t):
    return training.train_multi(_prices(t), ["price", "p_cost"], "linear regression", ["p_size", "p_type"], "regression", id_col="p_partkey")[1]


@check("cv_diagnostics_parts")
def _(t):
    return training.cv_diagnostics(_prices(t), "price", "linear regression", id_col="p_partkey")


@check("tune_parts")
def _(t):
    with training.Prepared(_prices(t), "price", None, "auto", 0.2, 42, "p_partkey") as ready:
        return training.tune(ready, "ridge", k=3)[1]


@check("feature_importance_parts")
def _(t):
    bundle, _scores = training.train(_prices(t), "price", "random forest", id_col="p_partkey", params={"numTrees": 20})
    return training.feature_importance(bundle, t.spark)


@check("forest_importance_lineitem")
def _(t):
    return training.forest_importance(t.lineitem.withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_partkey"])


@check("explain_linear_parts")
def _(t):
    bundle, _scores = training.train(_prices(t), "price", "linear regression", id_col="p_partkey")
    return training.explain(bundle, _prices(t), "p_partkey")


@check("explain_permutation_parts")
def _(t):
    bundle, _scores = training.train(_prices(t), "price", "decision tree", id_col="p_partkey")
    return training.explain(bundle, _prices(t), "p_partkey", method="permutation")


@check("explain_trees_parts")
def _(t):
    bundle, _scores = training.train(_prices(t), "price", "random forest", id_col="p_partkey", params={"numTrees": 10, "maxDepth": 6})
    return training.explain(bundle, _prices(t), "p_partkey")


# The values of a row and the base add up to what the model predicts, for every row.
@check("shap_adds_up_parts", "SELECT p_partkey, 'prediction' AS output, true AS adds_up FROM part")
def _(t):
    bundle, _scores = training.train(_prices(t), "price", "random forest", id_col="p_partkey", params={"numTrees": 10, "maxDepth": 6})
    values = training.shap_values(bundle, _prices(t), "p_partkey").join(training.predict(bundle, _prices(t), "p_partkey"), F.col("_row_id") == F.col("p_partkey"))
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v)
    return values.select("p_partkey", "output", (F.abs(total - F.col("prediction")) <= 1e-9 * F.abs("prediction")).alias("adds_up"))


@check("shap_adds_up_classes", "SELECT doc_id, 'p_1' AS output, true AS adds_up FROM documents JOIN labels USING (doc_id)")
def _(t):
    bundle, _scores = training.train(_documents(t), "quality", "decision tree", id_col="doc_id")
    values = training.shap_values(bundle, _documents(t), "doc_id").join(training.predict(bundle, _documents(t), "doc_id"), F.col("_row_id") == F.col("doc_id"))
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v)
    return values.select("doc_id", "output", (F.abs(total - F.col("p_1")) <= 1e-9).alias("adds_up"))


@check("rfe_parts")
def _(t):
    return training.rfe(_prices(t).drop("p_type"), "price", 1, ["p_size", "p_cost"], id_col="p_partkey")


@check("save_and_load_model_parts")
def _(t):
    import uuid

    bundle, _scores = training.train(_prices(t), "price", "ridge", id_col="p_partkey")
    again = training.load_model(training.save_model(bundle, f"{shared_folder(t.spark)}/model-{uuid.uuid4().hex}", t.spark), t.spark)
    return training.predict(again, _prices(t), "p_partkey").select("p_partkey", "prediction")


def _apart(spark, name, fitted, apply, key):
    """How many rows a saved and loaded model treats otherwise than the fitted one. Both sides have all rows, so neither goes through the driver
    in a broadcast, however small the planner takes it to be."""
    import uuid

    from plumbline.ml.storage import load, save

    again = load(save(fitted, f"{shared_folder(spark)}/fitted-{uuid.uuid4().hex}", spark), spark)
    ours, theirs = apply(fitted), apply(again)
    pairs = ours.select(F.col(key).alias("k"), F.struct(*[c for c in ours.columns if c != key]).alias("a")).join(
        theirs.select(F.col(key).alias("k"), F.struct(*[c for c in theirs.columns if c != key]).alias("b")).hint("merge"), "k")
    return pairs.agg(F.lit(name).alias("fitted"), F.count(F.lit(1)).alias("rows"), F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("bigint")).alias("differing"))


@check("save_and_load_families", """SELECT unnest(['bayesian ridge', 'knn', 'adaboost', 'gradient boosting']) AS fitted, count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM part
UNION ALL SELECT unnest(['qda', 'ridge classifier', 'bernoulli nb']), count(*), CAST(0 AS BIGINT) FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT unnest(['preprocessor']), count(*), CAST(0 AS BIGINT) FROM documents JOIN labels USING (doc_id)""")
def _(t):
    from plumbline.operators import preprocessing

    params, out = {"adaboost": {"rounds": 4}, "gradient boosting": {"maxIter": 5}}, None
    for name in ("bayesian ridge", "knn", "adaboost", "gradient boosting", "qda", "ridge classifier", "bernoulli nb"):
        table, target, key = (_prices(t), "price", "p_partkey") if name in ("bayesian ridge", "knn", "adaboost", "gradient boosting") else (_documents(t), "quality", "doc_id")
        bundle, _scores = training.train(table, target, name, id_col=key, params=params.get(name, {}))
        vectors = bundle.prep.transform(table.withColumn("_row_id", F.col(key))).select("_row_id", "features")
        row = _apart(t.spark, name, bundle.model, lambda m, v=vectors: m.transform(v).select("_row_id", "prediction"), "_row_id")
        out = row if out is None else out.unionByName(row)
    table = _documents(t).withColumn("n_chars", F.when(F.col("doc_id") % 7 > 0, F.col("n_chars")))
    fitted = preprocessing.fit_preprocessor(table.drop("doc_id"), "quality", missing="iterative", outliers="winsorize", scale="quantile")
    return out.unionByName(_apart(t.spark, "preprocessor", fitted, lambda p: p.transform(table), "doc_id"))


# ---- clustering ---------------------------------------------------------------------------

@check("cluster_quality_by_segment", """WITH c AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS x, avg(c_nationkey) AS y FROM customer GROUP BY 1),
a AS (SELECT avg(c_acctbal) AS x, avg(c_nationkey) AS y FROM customer),
d AS (SELECT g, sum(pow(c_acctbal - x, 2) + pow(c_nationkey - y, 2)) AS ss, avg(sqrt(pow(c_acctbal - x, 2) + pow(c_nationkey - y, 2))) AS s FROM customer JOIN c ON c_mktsegment = g GROUP BY 1),
b AS (SELECT c.g, max((d.s + e.s) / sqrt(pow(c.x - o.x, 2) + pow(c.y - o.y, 2))) AS w FROM c JOIN d ON c.g = d.g JOIN c o ON c.g <> o.g JOIN d e ON e.g = o.g GROUP BY 1)
SELECT (SELECT count(*) FROM c) AS clusters, (SELECT count(*) FROM customer) AS rows,
 (SELECT sum(n * (pow(c.x - a.x, 2) + pow(c.y - a.y, 2))) / (count(*) - 1) FROM c, a) / ((SELECT sum(ss) FROM d) / ((SELECT count(*) FROM customer) - (SELECT count(*) FROM c))) AS calinski_harabasz, (SELECT avg(w) FROM b) AS davies_bouldin""",
       "calinski_harabasz davies_bouldin", "clusters")
def _(t):
    return clustering.separation_scores(t.customer, ["c_acctbal", "c_nationkey"], "c_mktsegment")


@check("cluster_kmeans_events")
def _(t):
    rows, _quality = clustering.cluster(t.events, ["value", "user_id"], "kmeans", 3, id_col="event_id", restarts=10)
    return rows.select("event_id", "cluster")


@check("cluster_kmeans_quality_customer")
def _(t):
    return clustering.cluster(t.customer, ["c_acctbal", "c_nationkey"], "kmeans", 3, id_col="c_custkey")[1]


@check("cluster_agglomerative_customer")
def _(t):
    rows, _quality = clustering.cluster(t.customer, ["c_acctbal", "c_mktsegment"], "agglomerative", 4, id_col="c_custkey")
    return clustering.cluster_sizes(rows)


@check("cluster_dbscan_events")
def _(t):
    rows, _quality = clustering.cluster(t.events, ["value", "user_id"], "dbscan", eps=0.1, min_samples=8, id_col="event_id")
    return clustering.cluster_sizes(rows)


# Fitted rows get the clusters they had, also from a model that was saved.
@check("cluster_models_of_fitted_rows", """SELECT unnest(['kmeans', 'agglomerative', 'dbscan']) AS algorithm, count(*) AS rows, CAST(0 AS BIGINT) AS moved FROM customer""")
def _(t):
    import uuid

    from plumbline.ml.storage import load, save

    out = None
    for name, options in (("kmeans", {"restarts": 2}), ("agglomerative", {}), ("dbscan", {"eps": 0.2})):
        model = clustering.fit_clusters(t.customer, ["c_acctbal", "c_mktsegment"], name, 4, **options)
        rows, _quality = clustering.cluster(t.customer, ["c_acctbal", "c_mktsegment"], name, 4, id_col="c_custkey", **options)
        again = load(save(model, f"{shared_folder(t.spark)}/clusters-{uuid.uuid4().hex}", t.spark), t.spark)
        told = again.transform(t.customer, "c_custkey").select("c_custkey", F.col("cluster").alias("told"))
        row = rows.join(told, "c_custkey").agg(F.lit(name).alias("algorithm"), F.count(F.lit(1)).alias("rows"), F.sum((F.col("cluster") != F.col("told")).cast("bigint")).alias("moved"))
        out = row if out is None else out.unionByName(row)
    return out


@check("cluster_sizes_rule", "SELECT CAST(c_acctbal > 5000 AS INT) AS cluster, count(*) AS n FROM customer GROUP BY 1", "", "cluster")
def _(t):
    return clustering.cluster_sizes(t.customer.withColumn("cluster", (F.col("c_acctbal") > 5000).cast("int")))


# One column: clusters are runs of sorted values whose neighbours lie within eps, which SQL can tell when every point is core.
@check("dbscan_one_column", """WITH v AS (SELECT DISTINCT c_acctbal AS x FROM customer), g AS (SELECT x, CASE WHEN x - lag(x) OVER (ORDER BY x) <= 25 THEN 0 ELSE 1 END AS s FROM v),
k AS (SELECT x, sum(s) OVER (ORDER BY x) AS k FROM g), n AS (SELECT k, count(*) AS n, min(x) AS lo FROM customer JOIN k ON c_acctbal = x GROUP BY 1) SELECT CAST(n AS BIGINT) AS n, lo FROM n""", "lo")
def _(t):
    done = dbscan(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"], 25.0, 1)
    return done.groupBy("cluster").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("lo")).drop("cluster")


@check("histogram_boosting_first_split", """WITH s AS (SELECT p_size AS cut, sum(CAST(p_retailprice AS DOUBLE)) AS g, count(*) AS n FROM part GROUP BY 1),
c AS (SELECT cut, sum(g) OVER (ORDER BY cut) AS lg, sum(n) OVER (ORDER BY cut) AS ln, sum(g) OVER () AS tg, sum(n) OVER () AS tn FROM s),
b AS (SELECT * FROM c WHERE ln < tn ORDER BY lg * lg / ln + (tg - lg) * (tg - lg) / (tn - ln) DESC, cut LIMIT 1)
SELECT p_partkey, CASE WHEN p_size <= cut THEN lg / ln ELSE (tg - lg) / (tn - ln) END AS prediction FROM part, b""", "prediction")
def _(t):
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["p_size"], outputCol="features").transform(t.part.withColumn("label", F.col("p_retailprice").cast("double")))
    return fit_histogram_boosting(rows, rounds=1, step=1.0, leaves=2, min_rows=1).transform(rows).select("p_partkey", "prediction")
