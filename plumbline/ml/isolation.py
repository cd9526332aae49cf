"""Isolation forest: small hash samples per tree, scoring in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.plans.frames import cut_lineage, hash_share
from plumbline.plans.quantiles import SMALL_VALUES, exact_quantiles

SAMPLE = 256


def _path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def _walkable(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> tuple:
    """Levels, and of every node the column, cut, next nodes (not below the cut, below it) and length. A leaf leads to itself,
    so all rows take the same number of steps."""
    inner, nodes = feature >= 0, np.arange(len(feature))
    after = np.column_stack([np.where(inner, right, nodes), np.where(inner, left, nodes)]).astype(np.intp)
    levels, reached = 0, nodes[:1]
    while inner[reached].any():
        levels, reached = levels + 1, np.unique(after[reached[inner[reached]]])
    return levels, np.where(inner, feature, 0).astype(np.intp), cut, after.ravel(), length


class IsolationForest:
    def __init__(self, trees: list[tuple], cols: list[str], fill: dict[str, float], size: int):
        self.trees, self.cols, self.fill, self.size = trees, cols, fill, size
        self.threshold: float | None = None

    def score(self, df: DataFrame, into: str = "anomaly_score") -> DataFrame:
        """Score in (0, 1]; larger is more isolated."""
        trees, count, norm = [_walkable(*t) for t in self.trees], len(self.trees), _path(self.size)

        @F.pandas_udf("double")
        def rate(*columns: pd.Series) -> pd.Series:
            x = np.concatenate([c.to_numpy(dtype=float) for c in columns])
            rows = len(x) // len(columns)
            own, depth = np.arange(rows), np.zeros(rows)
            for levels, offset, cut, after, length in trees:
                node = np.zeros(rows, dtype=np.intp)
                for _ in range(levels):
                    low = x.take(offset.take(node) * rows + own) < cut.take(node)
                    node = after.take(2 * node + low)
                depth += length.take(node)
            return pd.Series(np.power(2.0, -depth / (count * norm)))

        return df.withColumn(into, rate(*[F.coalesce(C.as_number(df, c), F.lit(self.fill[c])) for c in self.cols]))

    def transform(self, df: DataFrame, action: str = "flag") -> DataFrame:
        scored = self.score(df).withColumn("is_outlier", F.col("anomaly_score") > F.lit(self.threshold))
        if action == "remove":
            return scored.where(~F.col("is_outlier")).select(*[C.quoted(c) for c in df.columns])
        return scored


def fit_isolation_forest(df: DataFrame, cols: list[str], id_col: str, contamination: float = 0.1, trees: int = 100,
                         seed: int = 42) -> IsolationForest:
    """One group of at most 256 rows per tree; the threshold is the exact score quantile."""
    rows = df.count()
    size = min(SAMPLE, rows)
    means = df.agg(*[F.avg(C.as_number(df, c)) for c in cols]).first()
    fill = {c: v or 0.0 for c, v in zip(cols, means)}
    # Twice the expected share, so that every tree finds its full sample; the surplus is cut below.
    share = min(1.0, 2.0 * size / max(rows, 1) + 1e-9)
    base = df.select(C.quoted(id_col).alias("_id"), *[F.coalesce(C.as_number(df, c), F.lit(fill[c])).alias(f"x{i}") for i, c in enumerate(cols)])
    # Every tree draws for itself at any table size; a row may be in the sample of several trees.
    draws = base.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    drawn = draws.withColumn("h", hash_share("_id", "tree", seed=seed)).where(F.col("h") < share)
    w = W.partitionBy("tree").orderBy("h", "_id")
    sample = drawn.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= size).select("tree", "_id", *[f"x{i}" for i in range(len(cols))])
    limit = math.ceil(math.log2(max(size, 2)))

    def grow(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_id")
        x = g[[f"x{i}" for i in range(len(cols))]].to_numpy(dtype=float)
        tree = int(g["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        nodes: list[list] = [[-1, 0.0, 0, 0, 0.0]]
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            at, part, depth = todo.pop()
            low, high = x[part].min(axis=0), x[part].max(axis=0)
            useful = np.flatnonzero(high > low)
            if depth >= limit or len(part) <= 1 or not len(useful):
                nodes[at][4] = depth + _path(len(part))
                continue
            f = int(rng.choice(useful))
            cut = float(rng.uniform(low[f], high[f]))
            side = x[part, f] < cut
            nodes[at][:4] = [f, cut, len(nodes), len(nodes) + 1]
            todo += [(len(nodes), part[side], depth + 1), (len(nodes) + 1, part[~side], depth + 1)]
            nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
        columns = list(zip(*nodes))
        return pd.DataFrame({"tree": [tree], "feature": [list(columns[0])], "cut": [list(columns[1])], "lo": [list(columns[2])],
                             "hi": [list(columns[3])], "len": [list(columns[4])]})

    grown = sample.groupBy("tree").applyInPandas(
        grow, "tree int, feature array<int>, cut array<double>, lo array<int>, hi array<int>, len array<double>").orderBy("tree").collect()
    forest = IsolationForest([(np.array(r["feature"]), np.array(r["cut"]), np.array(r["lo"]), np.array(r["hi"]), np.array(r["len"]))
                              for r in grown], cols, fill, size)
    scores = forest.score(df).select("anomaly_score")
    if rows > SMALL_VALUES:  # the quantile then takes several scans, which must not score again
        scores = cut_lineage(scores)
    forest.threshold = exact_quantiles(scores, ["anomaly_score"], [1 - contamination], rows=rows)["anomaly_score"][0]
    return forest
