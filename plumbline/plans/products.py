"""Sums of products of all pairs of columns in one scan, as matrix products of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ("n", "x", "xx", "xy")


@dataclass
class PairSums:
    """Entry (i, j) is over the rows where columns i and j are both present: rows, sum and sum of squares of
    i, sum of products, least and greatest i."""

    n: np.ndarray
    x: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    least: np.ndarray
    most: np.ndarray


def pair_sums(df: DataFrame, columns: list[Column], complete: bool = False) -> PairSums:
    """Each task multiplies its batches and hands on d x d numbers of each kind, d being the number of columns.

    ``complete`` says that no value is missing.
    """
    d = len(columns)
    plain = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((d, d)) for k in SUMS}
        least, most = np.full((d, d), np.inf), np.full((d, d), -np.inf)
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            here = np.ones_like(x) if complete else (~np.isnan(x)).astype(float)
            z = x if complete else np.nan_to_num(x, nan=0.0)
            sums["n"] += here.T @ here
            sums["x"] += z.T @ here
            sums["xx"] += (z * z).T @ here
            sums["xy"] += z.T @ z
            lows, highs = np.empty((d, d)), np.empty((d, d))
            low, high = np.where(here > 0, x, np.inf), np.where(here > 0, x, -np.inf)
            whole = (low.min(axis=0), high.max(axis=0))
            for j in range(d):
                rows = here[:, j] > 0
                if rows.all():
                    lows[:, j], highs[:, j] = whole
                else:
                    lows[:, j], highs[:, j] = low[rows].min(axis=0, initial=np.inf), high[rows].max(axis=0, initial=-np.inf)
            least, most = np.minimum(least, lows), np.maximum(most, highs)
        if seen:
            parts = [*[sums[k] for k in SUMS], least, most]
            yield pa.RecordBatch.from_arrays([pa.array([p.ravel().tolist()]) for p in parts], names=[*SUMS, "least", "most"])

    partial = plain.mapInArrow(work, ", ".join(f"{k} array<double>" for k in (*SUMS, "least", "most")))
    cells = partial.select(F.posexplode(F.arrays_zip(*SUMS, "least", "most")).alias("i", "v")).groupBy("i").agg(
        *[F.sum(f"v.{k}").alias(k) for k in SUMS], F.min("v.least").alias("least"), F.max("v.most").alias("most"))
    out = {k: np.zeros(d * d) for k in (*SUMS, "least", "most")}
    for r in cells.toLocalIterator():
        for k in out:
            out[k][r["i"]] = r[k]
    return PairSums(**{k: v.reshape(d, d) for k, v in out.items()})
