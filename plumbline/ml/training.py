"""Train, compare, tune, explain and apply models on a split table."""

from __future__ import annotations

import json
import logging
import random
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.ml import metrics as M
from plumbline.ml.catalog import CATALOG, Context, models_for
from plumbline.plans.frames import distinct_upto, hash_share, rows_frame
from plumbline.plans.quantiles import exact_quantiles
from plumbline.plans.sampling import mark_per_class

log = logging.getLogger(__name__)

HASH_WIDTH = 4096
#: Rows and vector slots that a partition of a prepared table holds at most.
PART_ROWS, PART_CELLS = 50_000, 4_000_000


# ---- task, split, features ----------------------------------------------------------------

def detect_task_name(df: DataFrame, target: str, rule: str = "numeric20") -> str:
    """``share``: text, or at most 20 values and below 5 % of rows, is a class. ``numeric20``: a number
    with more than 20 values is regression. ``few``: fewer than 20 values is a class."""
    numeric = target in C.numeric_columns(df)
    few = distinct_upto(df, {target: C.quoted(target)}, 21)[target]
    if rule == "share":
        rows = df.count()
        return "classification" if not numeric or (few <= 20 and few < 0.05 * rows) else "regression"
    if rule == "numeric20":
        return "regression" if numeric and few > 20 else "classification"
    if rule == "few":
        return "classification" if few < 20 else "regression"
    raise ValueError(f"unknown rule {rule!r}")


def detect_task(df: DataFrame, target: str, rule: str = "numeric20") -> DataFrame:
    return rows_frame(df.sparkSession, [{"target": target, "rule": rule, "task": detect_task_name(df, target, rule)}],
                      "target string, rule string, task string")


def split(df: DataFrame, target: str | None, test_size: float = 0.2, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Add ``is_test``: an exact share of every class, chosen by a hash of the id.

    Without a target, or when some class has a single row, the share is of the whole table.
    """
    label = target
    if target is not None:
        least = df.groupBy(C.quoted(target)).count().agg(F.min("count")).first()[0]
        label = target if least is not None and least >= 2 else None
    marked = mark_per_class(df, label, lambda n: F.ceil(n * F.lit(float(test_size))), id_col, seed)
    return marked.withColumnRenamed("_taken", "is_test")


def feature_pipeline(df: DataFrame, features: list[str], fill: str = "median", encode: str = "onehot", scale: bool = True, centre: bool = True,
                     hash_width: int = HASH_WIDTH) -> Pipeline:
    """Numbers are filled, texts coded, all assembled and scaled.

    ``encode``: ``onehot``, a slot per value however many there are; ``ordinal``, one slot; ``hash``, ``hash_width`` slots that all
    texts share. ``centre`` takes the mean off every slot and so fills the vectors; turn it off where codes are wide. Hashed
    slots are never centred. Only Spark ML stages, so the fitted pipeline can be saved.
    """
    if encode not in ("onehot", "ordinal", "hash"):
        raise ValueError(f"unknown encoding {encode!r}: use onehot, ordinal or hash")
    numeric = [c for c in features if c in C.numeric_columns(df)]
    times = [c for c in features if c in C.datetime_columns(df)]
    text = [c for c in features if c not in numeric + times]
    holes = {c: q[0] or 0.0 for c, q in exact_quantiles(df, numeric, [0.5]).items()} if fill == "median" and numeric else {}
    selected, inputs, stages, hashed = [], [], [], []
    for i, c in enumerate(features):
        name = "`" + c.replace("`", "``") + "`"
        if c in numeric:
            selected.append(f"coalesce(nanvl(cast({name} as double), cast(null as double)), {float(holes.get(c, 0.0))!r}D) as _n{i}")
            inputs.append(f"_n{i}")
        elif c in times:
            selected.append(f"coalesce(cast(unix_seconds(cast({name} as timestamp)) as double), 0D) as _n{i}")
            inputs.append(f"_n{i}")
        else:
            selected.append(f"coalesce(cast({name} as string), '<missing>') as _s{i}")
            if encode == "hash":
                hashed.append(f"_s{i}")
            else:
                stages.append(StringIndexer(inputCol=f"_s{i}", outputCol=f"_i{i}", handleInvalid="keep", stringOrderType="alphabetAsc"))
                if encode == "onehot":
                    stages.append(OneHotEncoder(inputCol=f"_i{i}", outputCol=f"_o{i}", dropLast=True, handleInvalid="keep"))
                inputs.append(f"_o{i}" if encode == "onehot" else f"_i{i}")
    if hashed:
        stages.append(FeatureHasher(inputCols=hashed, outputCol="_hashed", numFeatures=hash_width))
        inputs.append("_hashed")
    first = SQLTransformer(statement=f"SELECT *, {', '.join(selected)} FROM __THIS__")
    assembler = VectorAssembler(inputCols=inputs, outputCol="_raw" if scale else "features")
    tail = [StandardScaler(inputCol="_raw", outputCol="features", withMean=centre and not hashed, withStd=True)] if scale else []
    return Pipeline(stages=[first, *stages, assembler, *tail])


def feature_names(prepared: DataFrame, features: list[str]) -> list[str]:
    """Names of the vector slots, in terms of the source columns."""
    column = "_raw" if "_raw" in prepared.columns else "features"
    attrs = prepared.schema[column].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a.get("name", str(a["idx"]))) for kind in attrs.values() for a in kind)

    def plain(name: str) -> str:
        head, _, rest = name.partition("_")[2].partition("_")
        digits = head[1:]
        return (features[int(digits)] + (f"={rest}" if rest else "")) if digits.isdigit() else name

    return [plain(n) for _, n in slots]


@dataclass
class Bundle:
    """A fitted model with everything needed to apply it."""

    name: str
    task: str
    target: str
    features: list[str]
    prep: PipelineModel
    model: object
    labels: list[str] | None
    slots: list[str]


def _labelled(df: DataFrame, target: str, task: str, labels: list[str] | None, id_col: str) -> DataFrame:
    if task == "classification":
        text = F.coalesce(C.quoted(target).cast("string"), F.lit("<missing>"))
        pairs = [F.lit(v) for i, name in enumerate(labels) for v in (name, float(i))]
        label = F.try_element_at(F.create_map(*pairs), text)
    else:
        label = C.as_number(df, target)
    return df.withColumn("label", label).withColumn("_row_id", C.quoted(id_col)).where("label is not null")


class Prepared:
    """A split table turned into label and feature vectors, kept for many fits."""

    def __init__(self, df: DataFrame, target: str, features: list[str] | None, task: str, test_size: float, seed: int,
                 id_col: str, encode: str = "onehot", fill: str = "median", is_test: str | None = None, centre: bool = True, max_classes: int = 1000):
        """``is_test``: a boolean column with a split already made; else one is made. More than ``max_classes`` classes are refused."""
        self.target, self.seed, self.id_col = target, seed, id_col
        self.features = features or [f.name for f in df.schema if f.name not in (target, id_col, is_test) and not isinstance(f.dataType, C.NESTED)]
        self.task = detect_task_name(df, target) if task == "auto" else task
        self.labels = None
        if self.task == "classification":
            found = df.select(F.coalesce(C.quoted(target).cast("string"), F.lit("<missing>")).alias("v")).distinct().orderBy("v").limit(max_classes + 1).collect()
            if len(found) > max_classes:
                raise ValueError(f"{target!r} has more than {max_classes} classes")
            self.labels = [r["v"] for r in found]
        labelled = _labelled(df, target, self.task, self.labels, id_col)
        marked = labelled.withColumn("is_test", C.quoted(is_test)) if is_test else split(labelled, target if self.labels else None, test_size, seed, id_col)
        train = marked.where(~F.col("is_test"))
        self.prep = feature_pipeline(train, self.features, fill, encode, centre=centre).fit(train)
        vectors = self.prep.transform(marked)
        self.slots = feature_names(vectors, self.features)
        # A small file unfolds into wide vectors; fits take as many tasks as those need, not as many as the file has.
        rows = labelled.count()
        parts = max(-(-rows // PART_ROWS), -(-rows * len(self.slots) // PART_CELLS))
        if parts > marked.rdd.getNumPartitions():
            vectors = self.prep.transform(marked.repartition(parts))
        self.vectors = vectors.select("_row_id", "label", "features", "is_test").persist()
        self.train = self.vectors.where(~F.col("is_test")).drop("is_test")
        self.test = self.vectors.where("is_test").drop("is_test")
        self.rows = self.train.count()

    @property
    def classes(self) -> list[float] | None:
        return [float(i) for i in range(len(self.labels))] if self.labels else None

    def context(self, params: dict | None = None) -> Context:
        return Context(self.rows, len(self.slots), self.classes, self.seed, params or {})

    def bundle(self, name: str, model) -> Bundle:
        return Bundle(name, self.task, self.target, self.features, self.prep, model, self.labels, self.slots)

    def __enter__(self) -> Prepared:
        return self

    def __exit__(self, *_) -> None:
        self.vectors.unpersist()


def _entry(name: str, task: str):
    if name not in CATALOG or task not in CATALOG[name].tasks:
        raise ValueError(f"no {task} model named {name!r}; choose from {', '.join(models_for(task))}")
    return CATALOG[name]


def evaluate(model, rows: DataFrame, task: str) -> dict[str, float]:
    pred = model.transform(rows).select("label", "prediction")
    return (M.classification_metrics if task == "classification" else M.regression_metrics)(pred).first().asDict()


def train(df: DataFrame, target: str, model: str, features: list[str] | None = None, task: str = "auto", test_size: float = 0.2,
          seed: int = 42, id_col: str = "id", params: dict | None = None, **preparing) -> tuple[Bundle, DataFrame]:
    """(fitted bundle, held-out metrics) of one named model; ``preparing``: encode, fill, centre and max_classes of ``Prepared``."""
    with Prepared(df, target, features, task, test_size, seed, id_col, **preparing) as ready:
        fitted = _entry(model, ready.task).fit(ready.train, ready.context(params))
        scores = evaluate(fitted, ready.test, ready.task)
        bundle = ready.bundle(model, fitted)
    return bundle, _metric_rows(df, [{"model": model, "task": bundle.task, **scores}], bundle.task)


METRICS = {"classification": ("accuracy", "precision", "recall", "f1"), "regression": ("r2", "mae", "mse", "rmse")}


def _metric_rows(df: DataFrame, rows: list[dict], task: str, extra: str = "") -> DataFrame:
    fields = ", ".join(f"{m} double" for m in METRICS[task])
    return rows_frame(df.sparkSession, rows, f"model string, task string, {fields}{extra}")


def train_multi(df: DataFrame, targets: list[str], model: str, features: list[str], task: str, test_size: float = 0.2, seed: int = 42,
                id_col: str = "id") -> tuple[list[Bundle], DataFrame]:
    """One model per target over the same features and the same split; joint metrics."""
    marked = split(df, None, test_size, seed, id_col)
    held = marked.where("is_test").drop("is_test")
    bundles, joined = [], held.select(C.quoted(id_col), *[C.quoted(t) for t in targets])
    for t in targets:
        with Prepared(marked, t, features, task, test_size, seed, id_col, is_test="is_test") as ready:
            bundle = ready.bundle(model, _entry(model, ready.task).fit(ready.train, ready.context()))
        bundles.append(bundle)
        scored = predict(bundle, held).select(C.quoted(id_col), F.col("prediction").alias(f"{t}_prediction"))
        joined = joined.join(scored, id_col)
    return bundles, M.multi_output_metrics(joined, targets, task)


# ---- comparison, tuning, validation -------------------------------------------------------

def folds(rows: DataFrame, k: int, seed: int) -> DataFrame:
    return rows.withColumn("_fold", F.floor(hash_share("_row_id", seed=seed + 7) * k).cast("int"))


def cross_scores(entry, ready: Prepared, ctx: Context, k: int) -> list[float]:
    """Accuracy or R² on each fold; a row's fold follows from a hash of its id."""
    marked = folds(ready.train, k, ready.seed)
    out = []
    for i in range(k):
        fitted = entry.fit(marked.where(F.col("_fold") != i).drop("_fold"), ctx)
        scores = evaluate(fitted, marked.where(F.col("_fold") == i).drop("_fold"), ready.task)
        out.append(scores[METRICS[ready.task][0]])
    return out


def _level(value: float) -> str:
    return "high" if value > 0.08 else "moderate" if value > 0.03 else "low"


def _diagnostics(scores: list[float], held_out: float) -> dict:
    mean, std = float(np.mean(scores)), float(np.std(scores))
    bias = max(0.0, mean - held_out)
    return {"cv_mean": mean, "cv_std": std, "bias_proxy": bias, "bias_level": _level(bias), "variance_proxy": std, "variance_level": _level(std)}


CV_FIELDS = (", cv_mean double, cv_std double, bias_proxy double, bias_level string, variance_proxy double, variance_level string")


def cv_diagnostics(df: DataFrame, target: str, model: str, features: list[str] | None = None, task: str = "auto", k: int = 5,
                   seed: int = 42, id_col: str = "id") -> DataFrame:
    with Prepared(df, target, features, task, 0.2, seed, id_col) as ready:
        entry, ctx = _entry(model, ready.task), ready.context()
        held = evaluate(entry.fit(ready.train, ctx), ready.test, ready.task)
        row = {"model": model, "task": ready.task, **held, **_diagnostics(cross_scores(entry, ready, ctx, k), held[METRICS[ready.task][0]])}
        return _metric_rows(df, [row], ready.task, CV_FIELDS)


def candidates(grid: dict[str, list], trials: int, seed: int) -> tuple[str, list[dict]]:
    """The whole grid when it is small against the number of trials, else a seeded subset."""
    every = [dict(zip(grid, values)) for values in product(*grid.values())] if grid else []
    if len(every) <= max(20, trials // 2):
        return "grid_search", every
    return "random_search", random.Random(seed).sample(every, min(trials, len(every)))


def tune(ready: Prepared, model: str, k: int = 3, trials: int = 20, grid: dict[str, list] | None = None) -> tuple[dict, DataFrame]:
    """(best parameters, one row per candidate with its mean fold score)."""
    entry = _entry(model, ready.task)
    strategy, chosen = candidates(grid if grid is not None else entry.grid, trials, ready.seed)
    rows = []
    for params in chosen:
        score = float(np.mean(cross_scores(entry, ready, ready.context(params), k)))
        rows.append({"model": model, "strategy": strategy, "params": json.dumps(params, sort_keys=True), "score": score})
    best = max(rows, key=lambda r: r["score"]) if rows else None
    frame = rows_frame(ready.train.sparkSession, rows, "model string, strategy string, params string, score double")
    return (json.loads(best["params"]) if best else {}), frame


def compare(df: DataFrame, target: str, models: list[str] | None = None, features: list[str] | None = None, task: str = "auto",
            cv_folds: int = 0, tuning: bool = False, trials: int = 20, test_size: float = 0.2, seed: int = 42, id_col: str = "id") -> tuple[Bundle, DataFrame]:
    """(best bundle, table of models by held-out accuracy or R²); a model that cannot
    be fitted keeps its row, without scores, with the reason as its status; the others' status is ok."""
    with Prepared(df, target, features, task, test_size, seed, id_col) as ready:
        rows, best = [], None
        lead = METRICS[ready.task][0]
        for name in models or models_for(ready.task):
            entry = _entry(name, ready.task)
            try:
                params = tune(ready, name, max(cv_folds, 2), trials)[0] if tuning else {}
                ctx = ready.context(params)
                fitted = entry.fit(ready.train, ctx)
                scores = evaluate(fitted, ready.test, ready.task)
                if scores[lead] is None or scores[lead] != scores[lead]:
                    raise ValueError("no score on the held-out rows")
                row = {"model": name, "task": ready.task, "category": entry.category, "params": json.dumps(params, sort_keys=True), "status": "ok", **scores}
                if cv_folds >= 2:
                    row.update(_diagnostics(cross_scores(entry, ready, ctx, cv_folds), scores[lead]))
            except Exception as problem:  # one unsuitable model must not end the comparison
                reason = str(problem).splitlines()[0] if str(problem) else type(problem).__name__
                log.warning("model %s failed: %s", name, reason)
                rows.append({"model": name, "task": ready.task, "category": entry.category, "params": "{}", "status": f"{type(problem).__name__}: {reason}"})
                continue
            rows.append(row)
            if best is None or scores[lead] > best[0]:
                best = (scores[lead], ready.bundle(name, fitted))
        if best is None:
            raise ValueError("no model could be fitted")
        rows.sort(key=lambda r: (r["status"] != "ok", -r.get(lead, 0.0)))
        return best[1], _metric_rows(df, rows, ready.task, ", category string, params string, status string" + (CV_FIELDS if cv_folds >= 2 else ""))


# ---- applying and explaining --------------------------------------------------------------

def predict(bundle: Bundle, df: DataFrame, id_col: str = "id") -> DataFrame:
    """Prediction (class name or number), and class probabilities where the model has them.

    Features the table lacks count as missing.
    """
    absent = {c: F.lit(None).cast("double") for c in bundle.features if c not in df.columns}
    ready = df.withColumns(absent) if absent else df
    if id_col in df.columns:
        ready = ready.withColumn("_row_id", C.quoted(id_col))
    scored = bundle.model.transform(bundle.prep.transform(ready))
    cols = [C.quoted(c) for c in df.columns]
    if bundle.task != "classification":
        return scored.select(*cols, "prediction")
    named = F.array(*[F.lit(v) for v in bundle.labels])[F.col("prediction").cast("int")].alias("prediction")
    extra = []
    if "probability" in scored.columns:
        from pyspark.ml.functions import vector_to_array

        vector = scored.schema["probability"].dataType.typeName() != "array"
        p = vector_to_array("probability") if vector else F.col("probability")
        extra = [p[i].alias(f"p_{v}") for i, v in enumerate(bundle.labels)]
    return scored.select(*cols, named, *extra)


def _weights(model) -> list[float] | None:
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    if hasattr(model, "importances"):
        return list(model.importances())
    if getattr(model, "weights", None) is not None and isinstance(model.weights, np.ndarray):
        return [float(v) for v in model.weights]
    if hasattr(model, "featureImportances"):
        return list(model.featureImportances.toArray())
    if hasattr(model, "coefficientMatrix"):
        return list(np.abs(model.coefficientMatrix.toArray()).mean(axis=0))
    if getattr(model, "numClasses", 2) <= 2 and hasattr(model, "coefficients"):
        return list(np.abs(model.coefficients.toArray()))
    if hasattr(model, "models"):
        parts = [w for w in (_weights(m) for m in model.models) if w is not None]
        return list(np.mean(parts, axis=0)) if parts else None
    return None


def feature_importance(bundle: Bundle, spark) -> DataFrame:
    """Tree importances or absolute coefficients, summing to one; empty for other models."""
    values = _weights(bundle.model) or []
    total = sum(abs(v) for v in values) or 1.0
    rows = [{"feature": n, "importance": float(abs(v) / total)} for n, v in zip(bundle.slots, values)]
    rows.sort(key=lambda r: -r["importance"])
    return rows_frame(spark, rows, "feature string, importance double")


def forest_importance(df: DataFrame, target: str, features: list[str] | None = None, trees: int = 100, depth: int = 5, id_col: str = "id",
                      seed: int = 42) -> DataFrame:
    """Importances of a regression forest over numeric columns, missing values as zero."""
    names = features or [c for c in C.numeric_columns(df) if c not in (target, id_col)]
    pipeline = feature_pipeline(df, names, fill="zero", scale=False)
    rows = df.withColumn("label", C.as_number(df, target)).where("label is not null")
    prep = pipeline.fit(rows)
    vectors = prep.transform(rows)
    from plumbline.ml.histogram_forest import forest_gains

    shares = forest_gains(vectors, C.quoted(id_col) if id_col in df.columns else F.lit(0), trees, depth, seed)
    slots = feature_names(vectors, names)
    out = [{"feature": n, "importance": float(v)} for n, v in zip(slots, shares)]
    return rows_frame(df.sparkSession, sorted(out, key=lambda r: -r["importance"]), "feature string, importance double")


def explain(bundle: Bundle, df: DataFrame, id_col: str = "id", k: int = 20, seed: int = 42, method: str | None = None) -> DataFrame:
    """Mean absolute contribution per feature.

    Linear models: the exact mean of |coefficient times distance from the feature mean|. Trees and sums of trees:
    the exact mean of |Shapley value|, over all outputs but the first of two classes. Others, or with ``method="permutation"``:
    loss of score when one feature is permuted.
    """
    ready = df.withColumn("_row_id", C.quoted(id_col))
    if method not in (None, "permutation"):
        raise ValueError(f"unknown method {method!r}")
    if method is None:
        values = shap_values(bundle, df, id_col)
        if values is not None:
            each = values.select(F.posexplode("contributions").alias("i", "v")).groupBy("i").agg(F.avg(F.abs("v")).alias("contribution"))
            names = F.from_json(F.lit(json.dumps(bundle.slots)), "array<string>")
            return each.select(F.get(names, F.col("i")).alias("feature"), "contribution", F.lit("tree_shap").alias("method")).orderBy(F.desc("contribution"), "feature").limit(k)
    weights = _weights(bundle.model)
    many = getattr(bundle.model, "numClasses", 2) > 2
    plain = (not many and hasattr(bundle.model, "coefficients")) or (getattr(bundle.model, "classes", 0) is None and getattr(bundle.model, "weights", None) is not None)
    if method is None and plain and weights is not None:
        from pyspark.ml.functions import vector_to_array

        x = bundle.prep.transform(ready).select(vector_to_array("features").alias("x"))
        slots = range(len(weights))
        means = x.agg(*[F.avg(F.col("x")[i]) for i in slots]).first()
        row = x.agg(*[F.avg(F.abs(F.lit(float(w)) * (F.col("x")[i] - F.lit(means[i])))) for i, w in zip(slots, weights)]).first()
        rows = [{"feature": n, "contribution": float(v), "method": "linear"} for n, v in zip(bundle.slots, row)]
    else:
        lab = _labelled(df, bundle.target, bundle.task, bundle.labels, id_col)
        lead = METRICS[bundle.task][0]
        base = evaluate(bundle.model, bundle.prep.transform(lab).select("_row_id", "label", "features"), bundle.task)[lead]
        rows = []
        for i, c in enumerate(bundle.features):
            shuffled = permuted(lab, c, "_row_id", seed + i)
            score = evaluate(bundle.model, bundle.prep.transform(shuffled).select("_row_id", "label", "features"), bundle.task)[lead]
            rows.append({"feature": c, "contribution": float(base - score), "method": "permutation"})
    rows.sort(key=lambda r: -r["contribution"])
    return rows_frame(df.sparkSession, rows[:k], "feature string, contribution double, method string")


def shap_values(bundle: Bundle, df: DataFrame, id_col: str = "id") -> DataFrame | None:
    """Shapley values of every row under a tree model: the id, output, base, contributions, total. None for other models. Of two
    classes the second is given."""
    from plumbline.ml.tree_shap import adds_up, tree_shap

    if not adds_up(bundle.model):
        return None
    vectors = bundle.prep.transform(df.withColumn("_row_id", C.quoted(id_col))).select("_row_id", "features")
    values = tree_shap(bundle.model, vectors)
    return values.where("output <> 'p_0'") if bundle.labels is not None and len(bundle.labels) == 2 else values


def permuted(df: DataFrame, col: str, id_col: str, seed: int) -> DataFrame:
    """The table with one column permuted: row i of one hash order gets the value of row i of another."""
    from plumbline.plans.ranks import cumulative

    rows = df.count()
    others = [C.quoted(c) for c in df.columns if c != col]
    left = cumulative(df.select(
        F.struct(*others).alias("whole"), F.xxhash64(C.quoted(id_col), F.lit(seed)).alias("h"), C.quoted(id_col).alias("i"), F.lit(1).alias("n")),
        [], [F.col("h"), F.col("i")], rows=rows)
    right = cumulative(df.select(
        C.quoted(col).alias("value"), F.xxhash64(C.quoted(id_col), F.lit(seed + 1000)).alias("h"), C.quoted(id_col).alias("i"), F.lit(1).alias("n")),
        [], [F.col("h"), F.col("i")], rows=rows)
    return left.select("place", "whole").join(right.select("place", "value"), "place").select("whole.*", F.col("value").alias(col))


def rfe(df: DataFrame, target: str, k: int, features: list[str] | None = None, step: int = 1, trees: int = 50, id_col: str = "id",
        seed: int = 42) -> DataFrame:
    """Recursive elimination: drop the least important columns of a forest until k are left."""
    task = detect_task_name(df, target)
    names = features or [c for c in C.numeric_columns(df) if c not in (target, id_col)]
    left, rank, rows = list(names), len(names), []
    with Prepared(df, target, names, task, 0.0, seed, id_col) as ready:
        from pyspark.ml.feature import VectorSlicer

        while True:
            at = [names.index(c) for c in left]
            sliced = VectorSlicer(inputCol="features", outputCol="_f", indices=at).transform(ready.train).select(F.col("_f").alias("features"), "label")
            ctx = ready.context({"numTrees": trees, "maxDepth": 5})
            weights = dict(zip(left, CATALOG["random forest"].fit(sliced, ctx).featureImportances.toArray()))
            if len(left) <= k:
                break
            out = sorted(left, key=lambda c: (weights[c], c))[: min(step, len(left) - k)]
            for c in out:
                rows.append({"feature": c, "rank": rank - k + 1, "selected": False, "importance": float(weights[c])})
                rank -= 1
            left = [c for c in left if c not in out]
    rows += [{"feature": c, "rank": 1, "selected": True, "importance": float(weights[c])} for c in left]
    return rows_frame(df.sparkSession, rows, "feature string, rank int, selected boolean, importance double")


# ---- storage ------------------------------------------------------------------------------

def describe_model(bundle: Bundle, spark) -> DataFrame:
    return rows_frame(spark, [{"name": bundle.name, "task": bundle.task, "target": bundle.target, "features": bundle.features,
                      "labels": bundle.labels, "slots": bundle.slots}],
                      "name string, task string, target string, features array<string>, labels array<string>, slots array<string>")


def save_model(bundle: Bundle, path: str, spark) -> str:
    """Model, preparation pipeline and one metadata row under one folder; every model of the catalogue can be saved."""
    from plumbline.ml.storage import save

    bundle.prep.write().save(f"{path}/prep")
    save(bundle.model, f"{path}/model", spark)
    describe_model(bundle, spark).coalesce(1).write.json(f"{path}/meta")
    return path


def load_model(path: str, spark) -> Bundle:
    from plumbline.ml.storage import load

    meta = spark.read.schema("name string, task string, target string, features array<string>, labels array<string>, slots array<string>").json(f"{path}/meta").first()
    return Bundle(meta["name"], meta["task"], meta["target"], meta["features"], PipelineModel.load(f"{path}/prep"), load(f"{path}/model", spark), meta["labels"], meta["slots"])
