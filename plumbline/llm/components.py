"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b: bigint); root is the smallest node reachable.

    Links may repeat, point to themselves or hold nulls, which are left out. Each round every node sends its
    larger, then its smaller neighbours to the smallest one (two grouped minima and two equi
    joins), so no neighbourhood is gathered; rounds grow with the logarithm of the longest path.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = seen
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).where("a <> b").unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = cut_lineage(small.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) of a block of rows after the links a-b are added."""
    while len(a):
        x, y = labels[a], labels[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        open_ = lo != hi
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(labels, hi[open_], lo[open_])
        while (again := labels[labels] != labels).any():
            labels = np.where(again, labels[labels], labels)
    return labels
