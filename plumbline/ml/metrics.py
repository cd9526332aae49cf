"""Metrics over a prediction table (label, prediction, and a score for curves)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.plans.frames import cut_lineage
from plumbline.plans.ranks import cumulative


def _pairs(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    return pred.groupBy(quoted(label).cast("string").alias("label"), quoted(prediction).cast("string").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")).where("label is not null and prediction is not null")


def per_class(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, from the pair counts only."""
    pairs = _pairs(pred, label, prediction)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("hits")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hits")),
    )).alias("m")).select("m.*")
    sums = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return sums.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "hits")


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return per_class(pred, label, prediction).drop("hits")


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    t = per_class(pred, label, prediction)
    total = F.sum("support")
    return t.agg(
        (F.sum("hits") / total).alias("accuracy"), (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = quoted(label).cast("double"), quoted(prediction).cast("double")
    e = y - p
    sums = pred.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(F.when(p.isNotNull(), y)).alias("v"))
    return sums.select((1 - F.try_divide("mse", "v")).alias("r2"), "mae", "mse", F.sqrt("mse").alias("rmse"))


def multi_output_metrics(pred: DataFrame, targets: list[str], task: str) -> DataFrame:
    """Metrics per target, their mean, and for classes the share of rows with all targets right.

    Each target y has its prediction in ``y_prediction``.
    """
    one = classification_metrics if task == "classification" else regression_metrics
    frames = [one(pred, t, f"{t}_prediction").withColumn("target", F.lit(t)) for t in targets]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    names = [c for c in out.columns if c != "target"]
    mean = out.agg(*[F.avg(c).alias(c) for c in names]).withColumn("target", F.lit("mean"))
    out = out.unionByName(mean)
    if task == "classification":
        right = F.lit(True)
        for t in targets:
            right = right & (quoted(t).cast("string") == quoted(f"{t}_prediction").cast("string"))
        subset = pred.agg(F.avg(right.cast("double")).alias("subset_accuracy"))
        out = out.join(F.broadcast(subset.withColumn("target", F.lit("mean"))), "target", "left")
    return out


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts of every (label, prediction) pair of classes, zeros included."""
    pairs = _pairs(pred, label, prediction)
    classes = pairs.select(F.explode(F.array("label", "prediction")).alias("c")).distinct()
    # Classes are numbered and met by number, so that none of them passes through the driver.
    placed = cut_lineage(cumulative(classes.withColumn("n", F.lit(1)), [], [F.col("c")]).select("c", "place"))
    ends = placed.agg(F.min("place").alias("first"), F.max("place").alias("last")).first()
    if ends["last"] is None:
        return pairs
    others = placed.select(F.col("c").alias("label"), F.explode(F.sequence(F.lit(ends["first"]), F.lit(ends["last"]))).alias("place"))
    grid = others.join(placed.withColumnRenamed("c", "prediction"), "place").select("label", "prediction")
    return grid.join(pairs, ["label", "prediction"], "left").fillna(0, ["n"])


def _score_counts(pred: DataFrame, label: str, score: str, positive) -> DataFrame:
    hit = (quoted(label).cast("string") == F.lit(str(positive))).cast("long")
    return pred.select(quoted(score).cast("double").alias("score"), hit.alias("hit")).where("score is not null and hit is not null").groupBy(
        "score").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("tp"))


def roc_curve(pred: DataFrame, label: str = "label", score: str = "score", positive=1, window_rows: int | None = None) -> DataFrame:
    """One point per distinct score: false and true positive rate at that threshold."""
    counts = _score_counts(pred, label, score, positive)
    totals = counts.agg(F.sum("tp").alias("p"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    options = {} if window_rows is None else {"window_rows": window_rows}
    up = cumulative(counts, [], [F.col("score").desc()], ("n", "tp"), rows=totals["k"], **options)
    tp = F.col("before_tp") + F.col("tp")
    fp = F.col("before") + F.col("n") - tp
    return up.select(
        F.col("score").alias("threshold"),
        (fp / F.lit(float(max((totals["n"] or 0) - (totals["p"] or 0), 1)))).alias("fpr"),
        (tp / F.lit(float(max(totals["p"] or 0, 1)))).alias("tpr"),
        (F.col("before") - F.col("before_tp")).alias("fp_before"), F.col("before_tp").alias("tp_before"),
        F.col("n").alias("rows"), F.col("tp").alias("hits"))


def roc_points(pred: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    return roc_curve(pred, label, score, positive).select("threshold", "fpr", "tpr")


def auc(pred: DataFrame, label: str = "label", score: str = "score", positive=1, window_rows: int | None = None) -> DataFrame:
    """Area under the curve by trapezoids between distinct scores."""
    curve = roc_curve(pred, label, score, positive, window_rows)
    negatives = F.col("rows") - F.col("hits")
    area = F.sum(negatives * (F.col("tp_before") + F.col("hits") / 2.0))
    return curve.agg(F.try_divide(area, F.sum(negatives).cast("double") * F.sum("hits")).alias("auc"),
                     F.sum("hits").alias("positives"), F.sum(negatives).alias("negatives"))


def meets_target(results: DataFrame, metric: str, target: float, direction: str = ">=") -> DataFrame:
    """Add whether a metric of each row reaches a business target."""
    value = quoted(metric)
    ok = value >= target if direction == ">=" else value <= target
    return results.withColumn("meets_target", F.coalesce(ok, F.lit(False)))
