"""AdaBoost over weighted Spark decision trees."""

from __future__ import annotations

import math

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.frames import cut_lineage


class BoostedTrees:
    """A weighted vote (classes) or the weighted median (numbers) of trees."""

    def __init__(self, trees: list, weights: list[float], classes: list[float] | None):
        self.trees, self.weights, self.classes = trees, weights, classes

    def transform(self, df: DataFrame) -> DataFrame:
        kept = df.columns
        for i, t in enumerate(self.trees):
            t = t.copy({t.predictionCol: f"_t{i}"})
            if self.classes is not None:
                t = t.copy({t.rawPredictionCol: f"_r{i}", t.probabilityCol: f"_q{i}"})
            df = t.transform(df)
        votes = [(F.col(f"_t{i}"), F.lit(w)) for i, w in enumerate(self.weights)]
        if self.classes is not None:
            sums = [sum(((v == k).cast("double") * w for v, w in votes), F.lit(0.0)) for k in self.classes]
            best = F.greatest(*sums) if len(sums) > 1 else sums[0]
            pick = F.lit(self.classes[-1])
            for k, s in reversed(list(zip(self.classes, sums))):
                pick = F.when(s == best, F.lit(k)).otherwise(pick)
            total = sum(self.weights) or 1.0
            return df.withColumn("prediction", pick).withColumn("probability", F.array(*[s / total for s in sums])).select(
                *kept, "prediction", "probability")
        ordered = F.array_sort(F.array(*[F.struct(v.alias("v"), w.alias("w")) for v, w in votes]))
        half = sum(self.weights) / 2
        state = F.aggregate(ordered, F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("v")), lambda a, q: F.struct(
            (a["c"] + q["w"]).alias("c"), F.when(a["v"].isNull() & (a["c"] + q["w"] >= half), q["v"]).otherwise(a["v"]).alias("v")))
        return df.withColumn("prediction", state["v"]).select(*kept, "prediction")

    def importances(self) -> list[float]:
        total = None
        for t, w in zip(self.trees, self.weights):
            v = t.featureImportances.toArray() * w
            total = v if total is None else total + v
        return list(total / (total.sum() or 1.0))


def fit_adaboost_classifier(df: DataFrame, classes: list[float], rounds: int = 20, depth: int = 1, seed: int = 42,
                            cut_every: int = 5) -> BoostedTrees:
    """SAMME: every round reweights the rows the last tree got wrong."""
    k = len(classes)
    current = df.select("features", "label").withColumn("_w", F.lit(1.0))
    trees, weights = [], []
    for i in range(rounds):
        tree = DecisionTreeClassifier(maxDepth=depth, weightCol="_w", seed=seed).fit(current)
        scored = tree.transform(current).withColumn("_miss", (F.col("prediction") != F.col("label")).cast("double"))
        total = scored.agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_miss")).alias("e")).first()
        error = total["e"] / total["w"]
        if error >= 1 - 1 / k:
            break
        alpha = math.log((1 - error) / max(error, 1e-12)) + math.log(max(k - 1, 1))
        trees.append(tree)
        weights.append(alpha)
        if error <= 1e-12:
            break
        current = scored.withColumn("_w", F.col("_w") * F.exp(F.lit(alpha) * F.col("_miss"))).select("features", "label", "_w")
        if (i + 1) % cut_every == 0:
            current = cut_lineage(current)
    if not trees:
        trees, weights = [DecisionTreeClassifier(maxDepth=depth, seed=seed).fit(df)], [1.0]
    return BoostedTrees(trees, weights, classes)


def fit_adaboost_regressor(df: DataFrame, rounds: int = 20, depth: int = 3, seed: int = 42, cut_every: int = 5) -> BoostedTrees:
    """AdaBoost.R2 with weighted trees and linear loss."""
    current = df.select("features", "label").withColumn("_w", F.lit(1.0))
    trees, weights = [], []
    for i in range(rounds):
        tree = DecisionTreeRegressor(maxDepth=depth, weightCol="_w", seed=seed).fit(current)
        scored = tree.transform(current).withColumn("_e", F.abs(F.col("prediction") - F.col("label")))
        worst = scored.agg(F.max("_e")).first()[0]
        if not worst:
            trees.append(tree)
            weights.append(1.0)
            break
        loss = scored.agg((F.sum(F.col("_w") * F.col("_e")) / F.sum("_w")).alias("l")).first()["l"] / worst
        if loss >= 0.5:
            if not trees:
                trees.append(tree)
                weights.append(1.0)
            break
        beta = loss / (1 - loss)
        trees.append(tree)
        weights.append(math.log(1 / max(beta, 1e-12)))
        current = scored.withColumn("_w", F.col("_w") * F.pow(F.lit(beta), 1 - F.col("_e") / worst)).select("features", "label", "_w")
        if (i + 1) % cut_every == 0:
            current = cut_lineage(current)
    return BoostedTrees(trees, weights, None)
