"""The model catalogue: each name is fitted by a Spark ML estimator or a model of this package."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes,
    OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import Binarizer
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame

from plumbline.ml import boosting, linear
from plumbline.ml.neighbors import NeighborModel
from plumbline.ml.sgd import fit_sgd_classifier


@dataclass
class Context:
    """What a fit needs to know besides the rows."""

    rows: int
    width: int
    classes: list[float] | None
    seed: int = 42
    params: dict = field(default_factory=dict)


@dataclass
class Entry:
    category: str
    tasks: tuple[str, ...]
    fit: Callable[[DataFrame, Context], object]
    grid: dict[str, list] = field(default_factory=dict)


def _merge(defaults: dict, ctx: Context) -> dict:
    return {**defaults, **ctx.params}


def _linear_regression(**fixed):
    def fit(df: DataFrame, ctx: Context):
        p = _merge({"standardization": False, **fixed}, ctx)
        if "alpha" in p:
            p["regParam"] = p.pop("alpha") / max(ctx.rows, 1)
        return LinearRegression(**p).fit(df)

    return fit


def _tree(kind_class, kind_number, seeded=True, **fixed):
    def fit(df: DataFrame, ctx: Context):
        kind = kind_class if ctx.classes is not None else kind_number
        return kind(**_merge({**fixed, "seed": ctx.seed}, ctx)).fit(df)

    return fit


def _boosted(df: DataFrame, ctx: Context):
    p = _merge({"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "seed": ctx.seed}, ctx)
    if ctx.classes is None:
        return GBTRegressor(**p).fit(df)
    return GBTClassifier(**p).fit(df) if len(ctx.classes) == 2 else OneVsRest(classifier=GBTClassifier(**p)).fit(df)


def _svc(df: DataFrame, ctx: Context):
    one = LinearSVC(**_merge({"maxIter": 50, "regParam": 0.01}, ctx))
    return one.fit(df) if len(ctx.classes) == 2 else OneVsRest(classifier=one).fit(df)


def _logistic(df: DataFrame, ctx: Context):
    p = _merge({"maxIter": 100, "regParam": 1.0 / max(ctx.rows, 1), "standardization": False}, ctx)
    return LogisticRegression(**p).fit(df)


def _bernoulli(df: DataFrame, ctx: Context):
    stages = [Binarizer(threshold=0.0, inputCol="features", outputCol="_bits"),
              NaiveBayes(modelType="bernoulli", featuresCol="_bits", **ctx.params)]
    return Pipeline(stages=stages).fit(df)


def _mlp(df: DataFrame, ctx: Context):
    p = _merge({"maxIter": 500, "seed": ctx.seed, "layers": [ctx.width, 100, 50, len(ctx.classes)]}, ctx)
    return MultilayerPerceptronClassifier(**p).fit(df)


def _adaboost(df: DataFrame, ctx: Context):
    if ctx.classes is None:
        return boosting.fit_adaboost_regressor(df, seed=ctx.seed, **ctx.params)
    return boosting.fit_adaboost_classifier(df, ctx.classes, seed=ctx.seed, **ctx.params)


BOTH = ("classification", "regression")
CLASSES = ("classification",)
NUMBERS = ("regression",)

CATALOG: dict[str, Entry] = {
    "linear regression": Entry("linear", NUMBERS, _linear_regression()),
    "ridge": Entry("linear", NUMBERS, _linear_regression(alpha=1.0), {"alpha": [0.1, 1.0, 10.0]}),
    "lasso": Entry("linear", NUMBERS, _linear_regression(regParam=1.0, elasticNetParam=1.0), {"regParam": [0.01, 0.1, 1.0]}),
    "elastic net": Entry("linear", NUMBERS, _linear_regression(regParam=1.0, elasticNetParam=0.5),
                         {"regParam": [0.01, 0.1, 1.0], "elasticNetParam": [0.2, 0.5, 0.8]}),
    "huber": Entry("robust", NUMBERS, _linear_regression(loss="huber", epsilon=1.35)),
    "sgd regressor": Entry("linear", NUMBERS, _linear_regression(regParam=0.0001, solver="l-bfgs")),
    "bayesian ridge": Entry("linear", NUMBERS, lambda df, ctx: linear.fit_bayesian_ridge(df)),
    "lars": Entry("linear", NUMBERS, lambda df, ctx: linear.fit_lars(df)),
    "lars lasso": Entry("linear", NUMBERS, lambda df, ctx: linear.fit_lars(df, **_merge({"lasso": 1.0}, ctx)), {"lasso": [0.01, 0.1, 1.0]}),
    "omp": Entry("linear", NUMBERS, lambda df, ctx: linear.fit_omp(df, **ctx.params)),
    "ransac": Entry("robust", NUMBERS, lambda df, ctx: linear.fit_ransac(df, seed=ctx.seed, **ctx.params)),
    "logistic regression": Entry("linear", CLASSES, _logistic, {"regParam": [0.0, 0.001, 0.01, 0.1]}),
    "ridge classifier": Entry("linear", CLASSES, lambda df, ctx: linear.fit_ridge_classifier(df, ctx.classes, **ctx.params), {"alpha": [0.1, 1.0, 10.0]}),
    "sgd classifier": Entry("linear", CLASSES, lambda df, ctx: fit_sgd_classifier(df, ctx.classes, **ctx.params), {"alpha": [0.0001, 0.001, 0.01], "loss": ["hinge", "log"]}),
    "linear svc": Entry("svm", CLASSES, _svc, {"regParam": [0.001, 0.01, 0.1]}),
    "decision tree": Entry("tree", BOTH, _tree(DecisionTreeClassifier, DecisionTreeRegressor, maxDepth=8),
                           {"maxDepth": [5, 10, 20], "minInstancesPerNode": [1, 2, 4]}),
    "random forest": Entry("ensemble", BOTH, _tree(RandomForestClassifier, RandomForestRegressor, numTrees=100, maxDepth=10),
                           {"numTrees": [100, 200, 300], "maxDepth": [5, 8, 12]}),
    "bagging": Entry("ensemble", BOTH, _tree(RandomForestClassifier, RandomForestRegressor, numTrees=100, maxDepth=10, featureSubsetStrategy="all")),
    "gradient boosting": Entry("boosting", BOTH, _boosted, {"stepSize": [0.01, 0.05, 0.1], "maxDepth": [3, 5]}),
    "histogram gradient boosting": Entry("boosting", BOTH, _boosted),
    "adaboost": Entry("boosting", BOTH, _adaboost),
    "gaussian nb": Entry("probabilistic", CLASSES, lambda df, ctx: NaiveBayes(modelType="gaussian", **ctx.params).fit(df)),
    "bernoulli nb": Entry("probabilistic", CLASSES, _bernoulli),
    "lda": Entry("discriminant", CLASSES, lambda df, ctx: linear.fit_discriminant(df, ctx.classes)),
    "qda": Entry("discriminant", CLASSES, lambda df, ctx: linear.fit_discriminant(df, ctx.classes, quadratic=True)),
    "knn": Entry("distance", BOTH, lambda df, ctx: NeighborModel(df, ctx.params.get("k", 5), ctx.classes), {"k": [3, 5, 7, 11]}),
    "mlp": Entry("neural", CLASSES, _mlp),
}


def models_for(task: str) -> list[str]:
    return [n for n, e in CATALOG.items() if task in e.tasks]
