"""A regression forest over histograms, for the importances of its features.

Every feature is cut into at most ``BINS`` bins once and the rows are packed into blocks of one byte per cell. A row counts in a tree as
often as a bootstrap would draw it, a Poisson number that follows from a hash of the row. A level of a group of trees is one job: each task sums rows
and labels per (tree, open node, bin) of the features drawn for the node, and only the best split of each node reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.ml.histogram_boosting import BLOCK_ROWS, feature_cuts
from plumbline.plans.frames import cut_lineage

BINS = 32
#: Sums that a task holds for a group of trees, and bytes of blocks in a partition.
TABLE_CELLS, PART_BYTES = 4_000_000, 20_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)
FOUND = "tree int, slot int, feature int, bin int, gain double, n double, ln double"
#: The number of draws of a row for each of 65 536 equal shares of chance.
DRAWS = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]), (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)


def draws(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row counts in a tree."""
    mixed = (hashes ^ np.uint64((seed * 1_000_003 + tree + 1) * int(ODD) % 2**64)) * ODD
    mixed ^= mixed >> np.uint64(32)
    return DRAWS[(mixed * ODD) >> np.uint64(48)]


def forest_gains(df: DataFrame, ident: Column, trees: int = 100, depth: int = 5, seed: int = 42, bins: int = BINS, table_cells: int = TABLE_CELLS) -> np.ndarray:
    """Share of the loss of variance that each slot of ``features`` brings about, averaged over the trees.

    A third of the features is drawn for every node. Of equal splits the smallest feature and bin win. Rows equal in ``ident``, features and
    label are drawn alike. An empty table raises ``ValueError``. Bins of features of many values come from a merged sketch and may differ a little with the partitioning.
    """
    rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), ident.alias("h")).withColumn("h", F.xxhash64("h", "x", "y"))
    size = rows.agg(F.max(F.size("x")).alias("d"), F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n")).first()
    if not size["n"]:
        raise ValueError("no rows to fit")
    width, mean = size["d"], size["mean"]
    cuts = feature_cuts(rows, width, bins)
    codes = 1 + max((len(c) for c in cuts), default=0)
    drawn = max(1, math.ceil(width / 3))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                coded = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]).astype(np.uint8)
                y, h = (part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (coded, y - mean, h)], names=["x", "y", "h"])

    def sums(group: list[int], level: int, split_feature: np.ndarray, split_bin: np.ndarray, slot_of: np.ndarray, chosen: dict[int, np.ndarray]):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tables = {t: np.zeros((2, (len(chosen[t]) + 1) * drawn * codes)) for t in group}
            for b in batches:
                for xs, ys, hs in zip(b["x"], b["y"], b["h"]):
                    x, y, hashes = np.frombuffer(xs, np.uint8), np.frombuffer(ys), np.frombuffer(hs, np.uint64)
                    start = np.arange(len(y)) * width
                    for t in group:
                        times = draws(hashes, t, seed)
                        here = np.flatnonzero(times)
                        at, w = start[here], times[here].astype(float)
                        wy, node = w * y[here], np.zeros(len(here), np.int64)
                        for _ in range(level):
                            right = x.take(at + split_feature[t].take(node)) > split_bin[t].take(node)
                            node = 2 * node + 1 + right
                        slot = slot_of[t].take(node)  # rows of closed nodes go to a slot of their own, the last
                        for q in range(drawn):
                            key = x.take(at + np.append(chosen[t][:, q], 0).take(slot)) + (slot * drawn + q) * codes
                            tables[t][0] += np.bincount(key, w, tables[t].shape[1])
                            tables[t][1] += np.bincount(key, wy, tables[t].shape[1])
            for t in group:
                parts = tables[t].reshape(2, -1, drawn, codes)[:, :-1]
                yield pd.DataFrame({"tree": t, "slot": np.arange(parts.shape[1]), "sums": [parts[:, s].tobytes() for s in range(parts.shape[1])]})
        return work

    def search(chosen: dict[int, np.ndarray]):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Best split of each node of a partition."""
            held: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for tree, slot, part in zip(b["tree"], b["slot"], b["sums"]):
                    table = np.frombuffer(part)
                    held[tree, slot] = held[tree, slot] + table if (tree, slot) in held else table
            found = []
            for (tree, slot), table in held.items():
                n, g = np.cumsum(table.reshape(2, drawn, codes), axis=2)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = g**2 / n + (g[:, -1:] - g) ** 2 / (n[:, -1:] - n) - (g**2 / n)[:, -1:]
                gain = np.where((n > 0) & (n < n[:, -1:]), gain, 0.0)
                q, code = np.unravel_index(int(np.argmax(gain)), gain.shape)
                found.append((tree, slot, int(chosen[tree][slot, q]), int(code), float(gain[q, code]), float(n[q, -1]), float(n[q, code])))
            yield pd.DataFrame(found, columns=[c.split()[0] for c in FOUND.split(", ")])
        return work

    packed = rows.mapInArrow(pack, "x binary, y binary, h binary")
    # A partition is read as one batch, so large tables take as many as bounded batches need.
    parts = -(-size["n"] * (width + 16) // PART_BYTES)
    packed = cut_lineage(packed.repartition(parts) if parts > packed.rdd.getNumPartitions() else packed)
    nodes = 2 ** (depth + 1)
    # Of a node that is not split all rows go to the left, where nothing is open.
    split_feature, split_bin = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), 255, np.int64)
    open_nodes = [[0] for _ in range(trees)]
    gains = np.zeros((trees, width))
    for level in range(depth):
        chosen = {t: np.array([np.sort(np.random.default_rng([seed, t, v]).permutation(width)[:drawn]) for v in open_nodes[t]]) for t in range(trees) if open_nodes[t]}
        slot_of = np.stack([np.full(nodes, len(found), np.int64) for found in open_nodes])
        for t in chosen:
            slot_of[t, open_nodes[t]] = np.arange(len(open_nodes[t]))
        many = max(1, table_cells // (2 * drawn * codes * (2**level + 1)))
        following: list[list[int]] = [[] for _ in range(trees)]
        for first in range(0, len(chosen), many):
            group = list(chosen)[first:first + many]
            level_sums = packed.mapInPandas(sums(group, level, split_feature, split_bin, slot_of, {t: chosen[t] for t in group}), "tree int, slot int, sums binary")
            found = level_sums.repartition("tree", "slot").mapInPandas(search({t: chosen[t] for t in group}), FOUND).collect()
            for r in sorted(found):
                if r["gain"] <= 1e-12 * r["n"]:
                    continue
                t, node = r["tree"], open_nodes[r["tree"]][r["slot"]]
                gains[t, r["feature"]] += r["gain"]
                following[t] += [child for child, n in ((2 * node + 1, r["ln"]), (2 * node + 2, r["n"] - r["ln"])) if n > 1]
                split_feature[t, node], split_bin[t, node] = r["feature"], r["bin"]
        open_nodes = following
    totals = gains.sum(axis=1, keepdims=True)
    shares = np.divide(gains, totals, out=np.zeros_like(gains), where=totals > 0).sum(axis=0)
    return shares / (shares.sum() or 1.0)
