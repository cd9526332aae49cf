"""Shapley values of tree models, exact for every row.

What a feature adds is averaged over all orders in which the features could become known; features not known yet follow the training
rows down both sides of a split (the path-dependent reading). For one leaf whose path tests m features this average is the integral
over t in (0, 1) of a product of m - 1 linear factors, one per other feature, which Gauss-Legendre points give exactly. So a leaf costs a few array
operations for a whole batch of rows, trees are broadcast as node arrays (as large as the model, not as the table), and the
values of a row add up to its prediction less the mean prediction.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.ml.boosting import BoostedTrees
from plumbline.plans.frames import shared_folder

#: Numbers of a chunk of rows: rows times features times outputs.
CELLS_AT_ONCE = 2_000_000


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first: ``feature`` (-1 in a leaf), ``cut`` (left up to it) or the ``left_values`` of a coded feature, children,
    training weight, and of leaves the outputs."""

    feature: np.ndarray
    cut: np.ndarray
    left_values: dict[int, np.ndarray]
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    def goes_left(self, x: np.ndarray, node: int) -> np.ndarray:
        column = x[:, self.feature[node]]
        return np.isin(column, self.left_values[node]) if node in self.left_values else column <= self.cut[node]

    def leaves(self) -> Iterator[tuple[int, dict[int, tuple[float, list[tuple[int, bool]]]]]]:
        """Each leaf with the features on its path: the share of training rows that their tests let through, and the tests."""
        todo: list[tuple[int, dict]] = [(0, {})]
        while todo:
            node, path = todo.pop()
            if self.feature[node] < 0:
                yield node, path
                continue
            for child, left in ((self.right[node], False), (self.left[node], True)):
                share, tests = path.get(int(self.feature[node]), (1.0, []))
                passed = share * self.cover[child] / self.cover[node]
                if passed > 0:
                    todo.append((int(child), {**path, int(self.feature[node]): (passed, [*tests, (node, left)])}))

    def base(self) -> np.ndarray:
        total = np.zeros(self.value.shape[1])
        for leaf, path in self.leaves():
            total += np.prod([share for share, _ in path.values()]) * self.value[leaf]
        return total

    def add_contributions(self, x: np.ndarray, out: np.ndarray) -> None:
        """Add this tree's values for the rows of ``x`` to ``out`` (rows, features, outputs)."""
        left = {int(n): self.goes_left(x, int(n)) for n in np.flatnonzero(self.feature >= 0)}
        for leaf, path in self.leaves():
            m = len(path)
            if not m:
                continue
            points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
            points, weights = (points + 1) / 2, weights / 2
            share = np.array([s for s, _ in path.values()])
            known = np.ones((m, len(x)), bool)
            for row, (_, tests) in zip(known, path.values()):
                for node, went in tests:
                    row &= left[node] if went else ~left[node]
            factor = share[:, None, None] * (1 - points)[None, :, None] + known[:, None, :] * points[None, :, None]
            others = np.einsum("q,mqn->mn", weights, factor.prod(axis=0)[None] / factor)
            out[:, list(path), :] += ((known - share[:, None]) * others).T[:, :, None] * self.value[leaf]


def read_trees(model, spark: SparkSession) -> list[list]:
    """The nodes of each tree of a Spark ML model, as it is written by its own ``write``."""
    path = f"{shared_folder(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        nodes = nodes.withColumn("tree", F.lit(0))
    trees: dict[int, list] = {}
    for r in nodes.orderBy("tree", "id").collect():
        trees.setdefault(r["tree"], []).append(r)
    return [trees[t] for t in sorted(trees)]


def to_tree(nodes: list, classes: int | None, weight: float, vote: bool = False) -> Tree:
    """Outputs of a leaf, times ``weight``: its class shares (with ``vote`` all for the first of the largest), or its prediction."""
    at = {r["id"]: i for i, r in enumerate(nodes)}
    inner = [r["leftChild"] >= 0 for r in nodes]
    stats = [np.array(r["impurityStats"]) for r in nodes]
    if classes is None:
        value = np.array([[r["prediction"]] for r in nodes], float)
    else:
        value = np.array([s / s.sum() if s.sum() else np.full(classes, 1 / classes) for s in stats])
        if vote:
            value = np.eye(classes)[[int(r["prediction"]) for r in nodes]]
    coded = {i: np.array(r["split"]["leftCategoriesOrThreshold"]) for i, r in enumerate(nodes) if inner[i] and r["split"]["numCategories"] >= 0}
    return Tree(
        np.array([r["split"]["featureIndex"] if i else -1 for r, i in zip(nodes, inner)]),
        np.array([r["split"]["leftCategoriesOrThreshold"][0] if i and k not in coded else np.nan for k, (r, i) in enumerate(zip(nodes, inner))]), coded,
        np.array([at.get(r["leftChild"], -1) for r in nodes]), np.array([at.get(r["rightChild"], -1) for r in nodes]),
        np.array([s.sum() if classes is not None else s[0] for s in stats]), weight * value)


CLASS_SHARES = (MC.DecisionTreeClassificationModel, MC.RandomForestClassificationModel)
MEANS = (MR.DecisionTreeRegressionModel, MR.RandomForestRegressionModel)
SUMS = (MR.GBTRegressionModel, MC.GBTClassificationModel)


def adds_up(model) -> bool:
    """Whether the model is a sum of trees."""
    return isinstance(model, (*CLASS_SHARES, *MEANS, *SUMS)) or isinstance(model, BoostedTrees) and model.classes is not None


def trees_of(model, spark: SparkSession) -> tuple[list[Tree], list[str]]:
    """Trees whose outputs add up to what the model says, and the names of the outputs: ``p_<class>``, ``prediction``, or
    ``margin`` (boosted classes, half the log-odds)."""
    if isinstance(model, CLASS_SHARES):
        trees = read_trees(model, spark)
        return [to_tree(t, model.numClasses, 1 / len(trees)) for t in trees], [f"p_{i}" for i in range(model.numClasses)]
    if isinstance(model, MEANS):
        trees = read_trees(model, spark)
        return [to_tree(t, None, 1 / len(trees)) for t in trees], ["prediction"]
    if isinstance(model, SUMS):
        trees = read_trees(model, spark)
        return [to_tree(t, None, w) for t, w in zip(trees, model.treeWeights)], ["prediction" if isinstance(model, MR.GBTRegressionModel) else "margin"]
    if not adds_up(model):
        raise ValueError(f"{type(model).__name__} is not a sum of trees")
    # A tree votes for one class with its weight; a tree that never saw the last classes has no places for them.
    total, classes, out = sum(model.weights) or 1.0, [int(c) for c in model.classes], []
    for t, w in zip(model.trees, model.weights):
        tree = to_tree(read_trees(t, spark)[0], t.numClasses, w / total, vote=True)
        value = np.zeros((len(tree.value), len(classes)))
        for i, c in enumerate(classes):
            if c < t.numClasses:
                value[:, i] = tree.value[:, c]
        out.append(replace(tree, value=value))
    return out, [f"p_{c}" for c in classes]


SHAP = "output string, base double, contributions array<double>, total double"


def tree_shap(model, vectors: DataFrame, id_col: str = "_row_id") -> DataFrame:
    """One row per row of ``vectors`` (``id_col``, ``features``) and output: the id, output, base, contributions (one per slot of the vector), and total,
    their sum with the base: what the model says."""
    spark = vectors.sparkSession
    trees, names = trees_of(model, spark)
    told = spark.sparkContext.broadcast((trees, names, sum(t.base() for t in trees)))
    kind = vectors.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, names, base = told.value
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = np.stack([np.asarray(v, float) for v in batch.column(1).to_pylist()])
            step = max(1, CELLS_AT_ONCE // (whole.shape[1] * len(names)))
            for at in range(0, len(whole), step):
                x = whole[at:at + step]
                out = np.zeros((len(x), x.shape[1], len(names)))
                for tree in trees:
                    tree.add_contributions(x, out)
                totals = base + out.sum(axis=1)
                for k, name in enumerate(names):
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(at, step), pa.array([name] * len(x)), pa.array(np.full(len(x), base[k])),
                        pa.array(list(out[:, :, k]), pa.list_(pa.float64())), pa.array(totals[:, k])], names=["id", "output", "base", "contributions", "total"])

    plain = vectors.select(F.col(id_col).alias("id"), vector_to_array("features").alias("x"))
    return plain.mapInArrow(work, f"id {kind}, {SHAP}").withColumnRenamed("id", id_col)
