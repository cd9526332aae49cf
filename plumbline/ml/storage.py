"""Saving and loading of fitted models and preprocessors.

What Spark ML fitted is written by Spark ML. Everything else is numbers, a few tables, or both: a folder holds one JSON
text (kind and state), ``arrays`` with the number arrays as Parquet, and one Parquet table for each fitted table, so nothing is pickled and
nothing large passes through the driver.
"""

from __future__ import annotations

import datetime
import decimal
import importlib
import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession

from plumbline.ml.boosting import BoostedTrees
from plumbline.ml.isolation import IsolationForest
from plumbline.ml.linear import MatrixModel
from plumbline.ml.neighbors import NeighborModel
from plumbline.operators.preprocessing import Preprocessor, Step

ARRAYS = "name string, kind string, shape array<int>, row int, numbers array<double>"
#: Models of an ensemble saved or loaded at a time.
AT_ONCE = 8


def tagged(value):
    """JSON-ready form of the scalars a table can hold; ``untagged`` undoes it."""
    if isinstance(value, dict):
        return {"dict": [[tagged(k), tagged(v)] for k, v in value.items()]}
    if isinstance(value, (list, tuple)):
        return [tagged(v) for v in value]
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, (datetime.datetime, datetime.date)):
        return {"datetime" if isinstance(value, datetime.datetime) else "date": value.isoformat()}
    if isinstance(value, decimal.Decimal):
        return {"decimal": str(value)}
    if isinstance(value, (bytes, bytearray)):
        return {"bytes": bytes(value).hex()}
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise TypeError(f"cannot save a {type(value).__name__}")


def untagged(value):
    if isinstance(value, list):
        return [untagged(v) for v in value]
    if not isinstance(value, dict):
        return value
    ((kind, v),) = value.items()
    if kind == "dict":
        return {untagged(k): untagged(x) for k, x in v}
    return {"datetime": datetime.datetime.fromisoformat, "date": datetime.date.fromisoformat, "decimal": decimal.Decimal, "bytes": bytes.fromhex}[kind](v)


def _write_state(spark: SparkSession, path: str, kind: str, state: dict) -> None:
    spark.createDataFrame([(json.dumps({"kind": kind, "state": tagged(state)}),)], "value string").coalesce(1).write.text(f"{path}/state")


def _read_state(spark: SparkSession, path: str) -> tuple[str, dict]:
    found = json.loads(spark.read.text(f"{path}/state", wholetext=True).first()[0])
    return found["kind"], untagged(found["state"])


def _write_arrays(spark: SparkSession, path: str, arrays: dict[str, np.ndarray]) -> None:
    """One Parquet row per first index of each array."""
    rows = []
    for name, a in arrays.items():
        a = np.asarray(a)
        flat = a.reshape(1, -1) if a.ndim < 2 else a.reshape(a.shape[0], -1)
        rows += [(name, a.dtype.kind, list(a.shape), i, [float(v) for v in r]) for i, r in enumerate(flat)]
    spark.createDataFrame(rows, ARRAYS).write.parquet(f"{path}/arrays")


def _read_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {}
    for r in spark.read.parquet(f"{path}/arrays").orderBy("name", "row").collect():
        parts.setdefault(r["name"], []).append(r)
    return {n: np.array([r["numbers"] for r in rows]).reshape(rows[0]["shape"]).astype({"i": int, "b": bool}.get(rows[0]["kind"], float)) for n, rows in parts.items()}


def _save_spark_ml(model, path: str, spark: SparkSession) -> None:
    kind = type(model)
    _write_state(spark, path, "spark", {"class": f"{kind.__module__}.{kind.__name__}"})
    model.write().save(f"{path}/model")


def _load_spark_ml(path: str, state: dict):
    module, _, name = state["class"].rpartition(".")
    if module.split(".")[:2] != ["pyspark", "ml"]:
        raise ValueError(f"refusing to load {state['class']}")
    return getattr(importlib.import_module(module), name).load(f"{path}/model")


def _save_forest(forest: IsolationForest, path: str, spark: SparkSession) -> None:
    _write_state(spark, path, "isolation", {"cols": forest.cols, "fill": forest.fill, "size": forest.size, "threshold": forest.threshold, "trees": len(forest.trees)})
    _write_arrays(spark, path, {f"{i}.{j}": a for i, tree in enumerate(forest.trees) for j, a in enumerate(tree)})


def _load_forest(path: str, state: dict, spark: SparkSession) -> IsolationForest:
    arrays = _read_arrays(spark, path)
    forest = IsolationForest([tuple(arrays[f"{i}.{j}"] for j in range(5)) for i in range(state["trees"])], state["cols"], state["fill"], state["size"])
    forest.threshold = state["threshold"]
    return forest


def save(fitted, path: str, spark: SparkSession) -> str:
    """Write a fitted model, step or preprocessor into a new folder; ``load`` gives one that does the same."""
    if isinstance(fitted, MatrixModel):
        _write_state(spark, path, "matrix", {"name": fitted.name, "form": fitted.form, "classes": fitted.classes, "arrays": bool(fitted.arrays)})
        _write_arrays(spark, path, {**fitted.arrays, **({} if fitted.weights is None else {"weights": fitted.weights})})
    elif isinstance(fitted, BoostedTrees):
        _write_state(spark, path, "boosted", {"weights": [float(w) for w in fitted.weights], "classes": fitted.classes, "trees": len(fitted.trees)})
        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(lambda t: _save_spark_ml(t[1], f"{path}/trees/{t[0]}", spark), enumerate(fitted.trees)))
    elif isinstance(fitted, NeighborModel):
        _write_state(spark, path, "neighbors", {"k": fitted.k, "classes": fitted.classes})
        fitted.train.select("_row_id", "features", "label").write.parquet(f"{path}/train")
    elif isinstance(fitted, IsolationForest):
        _save_forest(fitted, path, spark)
    elif isinstance(fitted, Step):
        _write_state(spark, path, "step", {"name": fitted.name, "columns": fitted.columns, "effect": fitted.kind, "state": fitted.state, "table": fitted.table is not None, "forest": fitted.forest is not None})
        if fitted.table is not None:
            fitted.table.write.parquet(f"{path}/table")
        if fitted.forest is not None:
            _save_forest(fitted.forest, f"{path}/forest", spark)
    elif isinstance(fitted, Preprocessor):
        _write_state(spark, path, "preprocessor", {"steps": len(fitted.steps), "kept": fitted.kept, "before": fitted.before})
        for i, step in enumerate(fitted.steps):
            save(step, f"{path}/steps/{i}", spark)
    elif hasattr(fitted, "stored"):  # a model of this package that tells its own state and tables
        state, tables = fitted.stored()
        _write_state(spark, path, "own", {"class": f"{type(fitted).__module__}.{type(fitted).__name__}", "state": state, "tables": list(tables)})
        for name, part in tables.items():
            if isinstance(part, DataFrame):
                part.write.parquet(f"{path}/{name}")
            else:
                save(part, f"{path}/{name}", spark)
    elif isinstance(fitted, MLWritable):
        _save_spark_ml(fitted, path, spark)
    else:
        raise TypeError(f"cannot save a {type(fitted).__name__}")
    return path


def load(path: str, spark: SparkSession):
    kind, state = _read_state(spark, path)
    if kind == "spark":
        return _load_spark_ml(path, state)
    if kind == "matrix":
        arrays = _read_arrays(spark, path)
        weights = arrays.pop("weights", None)
        return MatrixModel(state["name"], state["form"], arrays, state["classes"], weights)
    if kind == "boosted":
        with ThreadPoolExecutor(AT_ONCE) as pool:
            trees = list(pool.map(lambda i: load(f"{path}/trees/{i}", spark), range(state["trees"])))
        return BoostedTrees(trees, state["weights"], state["classes"])
    if kind == "neighbors":
        return NeighborModel(spark.read.parquet(f"{path}/train"), state["k"], state["classes"])
    if kind == "isolation":
        return _load_forest(path, state, spark)
    if kind == "step":
        forest = load(f"{path}/forest", spark) if state["forest"] else None
        return Step(state["name"], state["columns"], state["effect"], state["state"], spark.read.parquet(f"{path}/table") if state["table"] else None, forest)
    if kind == "preprocessor":
        return Preprocessor([load(f"{path}/steps/{i}", spark) for i in range(state["steps"])], state["kept"], tuple(state["before"]))
    if kind == "own":
        module, _, name = state["class"].rpartition(".")
        if module.split(".")[0] != "plumbline":
            raise ValueError(f"refusing to load {state['class']}")
        return getattr(importlib.import_module(module), name).restored(state["state"], lambda part: f"{path}/{part}", spark)
    raise ValueError(f"unknown kind {kind!r}")
