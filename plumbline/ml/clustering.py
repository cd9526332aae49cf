"""Clusters, their quality and the choice of a workflow."""

from __future__ import annotations

import re

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.ml.dbscan import assign, core_points
from plumbline.ml.neighbors import nearest
from plumbline.ml.training import feature_pipeline
from plumbline.ml.ward import ward
from plumbline.operators.merging import infer_roles
from plumbline.plans.frames import cut_lineage, rows_frame
from plumbline.plans.ranks import cumulative


class ClusterModel:
    """Fitted clusters that can be given to any rows.

    ``kmeans``: the nearest centre. ``dbscan``: a core point within reach, else -1. ``agglomerative``: the nearest of the fitted rows. Rows
    that were fitted get the clusters they had.
    """

    def __init__(self, algorithm: str, prep: PipelineModel, model: KMeansModel | None = None, points: DataFrame | None = None, eps: float | None = None,
                 inertia: float | None = None):
        self.algorithm, self.prep, self.model, self.points, self.eps, self.inertia = algorithm, prep, model, points, eps, inertia

    def label(self, vectors: DataFrame, id_col: str) -> DataFrame:
        """(id_col, features, cluster) of rows with a ``features`` vector."""
        if self.algorithm == "kmeans":
            return self.model.transform(vectors).withColumnRenamed("prediction", "cluster").select(C.quoted(id_col), "features", "cluster")
        if self.algorithm == "dbscan":
            names = [c for c in self.points.columns if c not in ("cell", "cluster")]
            flat = vectors.select(C.quoted(id_col), vector_to_array("features").alias("a"))
            found = assign(flat.select(C.quoted(id_col), *[F.col("a")[i].alias(n) for i, n in enumerate(names)]), self.points, names, self.eps)
            return vectors.join(cut_lineage(found.select(C.quoted(id_col), "cluster")), id_col)
        # Equal rows are looked up once; fitted ones need no search.
        keyed = vectors.withColumn("x", vector_to_array("features"))
        known = keyed.join(self.points.select("x", "cluster"), "x").select(C.quoted(id_col), "features", "cluster")
        fresh = cut_lineage(keyed.select("x").distinct().join(self.points.select("x"), "x", "left_anti").withColumn("id", F.monotonically_increasing_id().cast("string")))
        if fresh.isEmpty():
            return known
        near = nearest(fresh, self.points.select(F.col("id").cast("string").alias("id"), "x"), 1).join(
            self.points.select(F.col("id").cast("string").alias("did"), "cluster"), "did").select("qid", "cluster")
        new = keyed.join(fresh.join(near, fresh["id"] == near["qid"]).select("x", "cluster"), "x").select(C.quoted(id_col), "features", "cluster")
        return known.unionByName(new)

    def transform(self, df: DataFrame, id_col: str = "id") -> DataFrame:
        """``df`` with ``cluster``. Ids must be unique."""
        vectors = cut_lineage(self.prep.transform(df).select(C.quoted(id_col), "features"))
        return df.join(self.label(vectors, id_col).select(C.quoted(id_col), "cluster"), id_col, "left")

    def stored(self) -> tuple[dict, dict]:
        parts = {"prep": self.prep, "model": self.model, "points": self.points}
        return {"algorithm": self.algorithm, "eps": self.eps, "inertia": self.inertia, "parts": [n for n, p in parts.items() if p is not None]}, {n: p for n, p in parts.items() if p is not None}

    @classmethod
    def restored(cls, state: dict, path, spark) -> ClusterModel:
        from plumbline.ml.storage import load

        has = state["parts"]
        return cls(state["algorithm"], load(path("prep"), spark), load(path("model"), spark) if "model" in has else None,
                   spark.read.parquet(path("points")) if "points" in has else None, state["eps"], state["inertia"])


def fit_clusters(df: DataFrame, cols: list[str], algorithm: str = "kmeans", k: int = 3, eps: float = 0.5, min_samples: int = 5, restarts: int = 10,
                 seed: int = 42) -> ClusterModel:
    """Columns are coded, filled with zero and standardised. ``kmeans`` keeps the best of the restarts, ``agglomerative`` is exact by
    Ward's criterion, ``dbscan`` is exact with noise as -1."""
    prep = feature_pipeline(df, cols, fill="zero").fit(df)
    vectors = cut_lineage(prep.transform(df).select("features"))
    count = max(2, k)
    if algorithm == "kmeans":
        models = [KMeans(k=count, seed=seed + i).fit(vectors) for i in range(restarts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        return ClusterModel(algorithm, prep, model=best, inertia=float(best.summary.trainingCost))
    arrays = vectors.select(vector_to_array("features").alias("x"))
    if algorithm == "dbscan":
        names = [f"x{i}" for i in range(len(arrays.first()["x"]))]
        points = arrays.select(*[F.col("x")[i].alias(n) for i, n in enumerate(names)])
        return ClusterModel(algorithm, prep, points=core_points(points, names, eps, min_samples), eps=eps)
    if algorithm == "agglomerative":
        # Equal rows are one cluster from the start; ids follow the values, so that the result does not depend on row order.
        folded = arrays.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("n"))
        points = cut_lineage(cumulative(folded, [], [F.col("x")]).select(F.col("place").alias("id"), "n", "x"))
        return ClusterModel(algorithm, prep, points=cut_lineage(points.join(ward(points, count), "id").select("id", "x", "cluster")))
    raise ValueError(f"unknown algorithm {algorithm!r}")


def cluster(df: DataFrame, cols: list[str], algorithm: str = "kmeans", k: int = 3, eps: float = 0.5, min_samples: int = 5,
            id_col: str = "id", restarts: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows with a ``cluster`` column, metrics) of ``fit_clusters``."""
    model = fit_clusters(df, cols, algorithm, k, eps, min_samples, restarts, seed)
    vectors = cut_lineage(model.prep.transform(df).select(C.quoted(id_col), "features"))
    scored = cut_lineage(model.label(vectors, id_col))
    return df.join(scored.select(C.quoted(id_col), "cluster"), id_col, "left"), cluster_quality(scored, model.inertia, algorithm)


def cluster_quality(scored: DataFrame, inertia: float | None, algorithm: str) -> DataFrame:
    """Silhouette (squared Euclidean), Calinski-Harabasz and Davies-Bouldin of labelled vectors."""
    array = scored.select(vector_to_array("features").alias("x"), "cluster")
    width = len(array.first()["x"])
    flat = array.select("cluster", *[F.col("x")[i].alias(f"x{i}") for i in range(width)])
    separation = separation_scores(flat, [f"x{i}" for i in range(width)], "cluster").first()
    groups = separation["clusters"]
    silhouette = None
    if groups >= 2:
        silhouette = ClusteringEvaluator(predictionCol="cluster").evaluate(scored.withColumn("cluster", F.col("cluster").cast("double")))
    return rows_frame(scored.sparkSession, [{
        "algorithm": algorithm, "clusters": groups - (scored.where("cluster = -1").limit(1).count() if algorithm == "dbscan" else 0),
        "inertia": inertia, "silhouette": silhouette,
        "calinski_harabasz": separation["calinski_harabasz"], "davies_bouldin": separation["davies_bouldin"],
    }], "algorithm string, clusters int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double")


def separation_scores(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin from cluster centres and mean distances.

    Two scans: the centres, then the distances of the rows from their own centre. Centres
    are compared with each other as a small array, not row by row.
    """
    xs = [C.as_number(df, c) for c in cols]
    base = df.where(C.quoted(label).isNotNull()).select(C.quoted(label).alias("g"), *[x.alias(f"x{i}") for i, x in enumerate(xs)]).dropna()
    d = len(cols)
    centres = base.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"c{i}") for i in range(d)])
    found = centres.collect()
    schema = "clusters int, rows long, calinski_harabasz double, davies_bouldin double"
    n, k = sum(r["n"] for r in found), len(found)
    if k < 2:
        return rows_frame(df.sparkSession, [{"clusters": k, "rows": n, "calinski_harabasz": None, "davies_bouldin": None}], schema)
    gap2 = sum((F.col(f"x{i}") - F.col(f"c{i}")) * (F.col(f"x{i}") - F.col(f"c{i}")) for i in range(d))
    # the number of clusters is the size of the broadcast side; it was collected above
    spread = base.join(F.broadcast(rows_frame(df.sparkSession, [r.asDict() for r in found], centres.schema)), "g") if k <= 100_000 else base.join(centres, "g")
    inside = {r["g"]: (r["ss"], r["s"]) for r in spread.groupBy("g").agg(F.sum(gap2).alias("ss"), F.avg(F.sqrt(gap2)).alias("s")).collect()}
    import numpy as np

    m = np.array([[r[f"c{i}"] for i in range(d)] for r in found])
    sizes = np.array([r["n"] for r in found], dtype=float)
    grand = (m * sizes[:, None]).sum(axis=0) / n
    between = float((sizes * ((m - grand) ** 2).sum(axis=1)).sum())
    within = sum(v[0] for v in inside.values())
    s = np.array([inside[r["g"]][1] for r in found])
    worst = []
    for i in range(k):
        away = np.sqrt(((m - m[i]) ** 2).sum(axis=1))
        away[i] = np.inf
        with np.errstate(divide="ignore"):
            worst.append(float(np.max((s + s[i]) / away)))
    ch = None if within == 0 or n <= k else between / (k - 1) / (within / (n - k))
    return rows_frame(df.sparkSession, [{"clusters": k, "rows": n, "calinski_harabasz": ch, "davies_bouldin": float(np.mean(worst))}], schema)


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def recommend_workflow(df: DataFrame) -> DataFrame:
    """Clustering without a target-like name and mostly numbers; else a target with its task."""
    roles = infer_roles(df).collect()
    names = df.columns
    numeric = [r["column"] for r in roles if r["role"] == "numeric"]
    targets = [c for c in names if re.search(r"target|label|class|outcome|y$", c, re.I)]
    rows = df.count()
    if not targets and len(numeric) >= max(2, int(len(names) * 0.6)):
        row = {"workflow": "clustering", "task": None, "target": None, "features": ", ".join(numeric[:8]),
               "metric": "silhouette", "goal": 0.5, "reason": f"no target-like name and {len(numeric)} numeric columns"}
    else:
        likely = {r["column"]: r["likely_categorical"] for r in roles}
        target = (targets or [c for c in names if likely.get(c)] or names)[0]
        continuous = target in numeric and not likely[target]
        task = "regression" if continuous else "classification"
        features = [c for c in names if c != target][: max(3, min(12, len(names) - 1))]
        row = {"workflow": "compare" if rows >= 200 else "selected", "task": task, "target": target, "features": ", ".join(features),
               "metric": "r2" if continuous else "accuracy", "goal": 0.8 if continuous else 0.9, "reason": f"{rows} rows"}
    return rows_frame(df.sparkSession, [row], "workflow string, task string, target string, features string, metric string, goal double, reason string")
