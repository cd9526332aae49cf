"""A linear classifier by averaged stochastic gradient descent.

Equal rows are folded into one weighted row and dealt by a hash of their values into shards of bounded size, each a packed block. In an epoch every
shard starts from the common weights and walks its rows in hash order, a small batch at a time; the weights of the shards are then averaged by
their rows. Order and shards follow from the values, so the result does not depend on how the table is partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.ml.linear import MatrixModel
from plumbline.plans.frames import cut_lineage

SHARD_ROWS, BATCH = 20_000, 32
LOSSES = ("hinge", "log")


def fit_sgd_classifier(
    df: DataFrame, classes: list[float], loss: str = "hinge", alpha: float = 1e-4, epochs: int = 20, shard_rows: int = SHARD_ROWS, batch: int = BATCH,
) -> MatrixModel:
    """One class against the others, all at once. The weights of the second half of the epochs are averaged.

    ``alpha`` weighs the squared weights against the mean loss. Steps begin at one over the mean squared length of a row and
    shrink with the square root of the epoch.
    """
    if loss not in LOSSES:
        raise ValueError(f"unknown loss {loss!r}: use {' or '.join(LOSSES)}")
    rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.sum("w").alias("w"), F.sum(
        F.col("w") * F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("s")).first()
    if not size["n"]:
        raise ValueError("no rows to fit")
    shards, width, total = -(-size["n"] // shard_rows), size["d"] + 1, size["w"]
    keyed = rows.withColumn("h", F.xxhash64("x", "y")).withColumn("shard", F.pmod("h", F.lit(shards)))

    def pack(d: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(d)), key=lambda i: (d["h"].iat[i], d["y"].iat[i], tuple(d["x"].iat[i])))
        d = d.iloc[order]
        x = np.column_stack([np.stack(d["x"].to_numpy()), np.ones(len(d))])
        return pd.DataFrame({"shard": [d["shard"].iat[0]], "x": [x.tobytes()], "y": [d["y"].to_numpy(float).tobytes()], "w": [d["w"].to_numpy(float).tobytes()]})

    packed = cut_lineage(keyed.groupBy("shard").applyInPandas(pack, "shard bigint, x binary, y binary, w binary"))
    weights, kept, start = np.zeros((len(classes), width)), [], 1 / (1 + size["s"] / total)

    def epoch(weights: np.ndarray, step: float):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for shard, xs, ys, ws in zip(b["shard"], b["x"], b["y"], b["w"]):
                    x, y, w = np.frombuffer(xs).reshape(-1, width), np.frombuffer(ys), np.frombuffer(ws)
                    sign, own = np.where(y[:, None] == np.array(classes), 1.0, -1.0), weights.copy()
                    for at in range(0, len(x), batch):
                        part = slice(at, at + batch)
                        margin = sign[part] * (x[part] @ own.T)
                        pull = (margin < 1).astype(float) if loss == "hinge" else 1 / (1 + np.exp(np.clip(margin, -500, 500)))
                        gradient = (sign[part] * pull * w[part, None]).T @ x[part] / w[part].sum()
                        own[:, :-1] *= 1 - step * alpha
                        own += step * gradient
                    yield pd.DataFrame({"shard": [shard], "share": [w.sum() / total], "m": [own.ravel()]})
        return work

    for turn in range(epochs):
        parts = packed.mapInPandas(epoch(weights, start / np.sqrt(1 + turn)), "shard bigint, share double, m array<double>")
        summed = parts.select(F.posexplode(F.transform("m", lambda v: v * F.col("share"))).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        weights = np.zeros(weights.size)
        weights[[r["i"] for r in summed]] = [r["v"] for r in summed]
        weights = weights.reshape(len(classes), width)
        if turn >= epochs // 2:
            kept.append(weights)
    mean = np.mean(kept, axis=0)
    return MatrixModel("sgd classifier", "linear", {"slope": mean[:, :-1].T.copy(), "constant": mean[:, -1].copy()}, classes, np.abs(mean[:, :-1]).mean(axis=0))
