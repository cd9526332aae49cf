"""Gradient boosting over histograms.

Every feature is cut into at most 255 bins once and the rows are packed into blocks of one byte per cell. A level of a round is one
job: each block sums gradients, curvatures and rows per (tree, open node, feature, bin), the sums meet by (tree, node, feature), and
only the best split of each node comes back. Splits with the largest gain go first until a tree has its leaves, so
what the driver holds is as large as the model. Scores live in the blocks and are written anew every ``cut_every`` rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.frames import cut_lineage

BINS, BLOCK_ROWS = 255, 65_536
FOUND = "tree int, slot int, feature int, bin int, gain double, g double, h double, n double, lg double, lh double, ln double"


@dataclass
class HistogramTree:
    """Nodes by number, the root first; ``feature`` is -1 in a leaf, rows up to ``cut`` (and codes up to ``bin``) go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, code: int, cut: float, values: tuple[float, float]) -> tuple[int, int]:
        """The numbers of the two new leaves."""
        first = len(self.feature)
        self.feature[node], self.bin[node], self.cut[node], self.left[node], self.right[node] = feature, code, cut, first, first + 1
        for value in values:
            for column, start in ((self.feature, -1), (self.bin, 0), (self.cut, 0.0), (self.left, 0), (self.right, 0), (self.value, value), (self.depth, self.depth[node] + 1)):
                column.append(start)
        return first, first + 1

    def leaves(self, cells: np.ndarray, coded: bool) -> np.ndarray:
        """The leaf of every row of ``cells`` (rows x features), codes or the features themselves."""
        feature, at = np.array(self.feature), np.array(self.bin if coded else self.cut)
        left, right = np.array(self.left), np.array(self.right)
        node = np.zeros(len(cells), np.int64)
        rows = np.arange(len(cells))
        for _ in range(max(self.depth)):
            tested = feature[node]
            goes = np.where(cells[rows, np.maximum(tested, 0)] <= at[node], left[node], right[node])
            node = np.where(tested < 0, node, goes)
        return node

    def add_to(self, scores: np.ndarray, cells: np.ndarray, coded: bool) -> None:
        scores += np.array(self.value)[self.leaves(cells, coded)]


def _shares(scores: np.ndarray) -> np.ndarray:
    """Probabilities of all classes; one column of scores stands for the second of two classes."""
    if scores.shape[1] == 1:
        second = 1 / (1 + np.exp(-np.clip(scores[:, 0], -500, 500)))
        return np.column_stack([1 - second, second])
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class HistogramBoosting:
    """A sum of trees per output: the number itself, the log-odds of the second class, or one score per class."""

    def __init__(self, rounds: list[list[HistogramTree]], start: list[float], classes: list[float] | None, gains: list[float]):
        self.rounds, self.start, self.classes, self.gains = rounds, start, classes, gains

    def transform(self, df: DataFrame) -> DataFrame:
        """``prediction`` and, for classes, ``probability`` of every row. NaN goes right at every split."""
        rounds, start, classes = self.rounds, self.start, self.classes

        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                cells = np.stack(x.to_numpy()) if len(x) else np.empty((0, 1))
                scores = np.tile(np.array(start), (len(x), 1))
                for trees in rounds:
                    for k, tree in enumerate(trees):
                        tree.add_to(scores[:, k], cells, False)
                yield pd.Series(list(scores if classes is None else _shares(scores)))

        scored = F.pandas_udf(score, "array<double>")(vector_to_array("features"))
        if classes is None:
            return df.withColumn("prediction", scored[0])
        best = df.withColumn("probability", scored)
        place = F.array_position("probability", F.array_max("probability")).cast("int")
        return best.withColumn("prediction", F.element_at(F.array(*[F.lit(float(c)) for c in classes]), place)).select(*df.columns, "prediction", "probability")

    def importances(self) -> list[float]:
        """Share of the gain of all splits that each feature has."""
        total = sum(self.gains)
        return [g / total if total else 0.0 for g in self.gains]

    def stored(self) -> tuple[dict, dict]:
        return {"rounds": [[asdict(t) for t in trees] for trees in self.rounds], "start": self.start, "classes": self.classes, "gains": self.gains}, {}

    @classmethod
    def restored(cls, state: dict, folder, spark: SparkSession) -> HistogramBoosting:
        return cls([[HistogramTree(**t) for t in trees] for trees in state["rounds"]], state["start"], state["classes"], state["gains"])


def feature_cuts(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Upper ends of the bins of each feature but the last: all its values if they are few, else quantiles from one merged sketch per feature."""
    ranks = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = rows.select(F.posexplode("x").alias("feature", "v")).where("not isnan(v)").groupBy("feature").agg(
        F.percentile_approx("v", ranks, 20 * bins).alias("q"), F.max("v").alias("top"))
    cuts = [np.empty(0)] * width
    for feature, q, top in found.collect():
        values = np.unique(q)
        cuts[feature] = values[values < top]
    return cuts


def _gradients(scores: np.ndarray, y: np.ndarray, classes: list[float] | None) -> tuple[np.ndarray, np.ndarray]:
    if classes is None:
        return scores - y[:, None], np.ones_like(scores)
    p = _shares(scores)[:, 1:] if scores.shape[1] == 1 else _shares(scores)
    hit = y[:, None] == np.array(classes[1:] if scores.shape[1] == 1 else classes)
    return p - hit, np.maximum(p * (1 - p), 1e-16)


def fit_histogram_boosting(
    df: DataFrame, classes: list[float] | None = None, rounds: int = 100, step: float = 0.1, leaves: int = 31, depth: int = 8, min_rows: int = 20,
    l2: float = 0.0, bins: int = BINS, cut_every: int = 10, block_rows: int = BLOCK_ROWS,
) -> HistogramBoosting:
    """Boost ``rounds`` trees (one per class if there are more than two) over the columns ``features`` and ``label``.

    Rows without a label are left out. A split needs ``min_rows`` rows on either side and a gain above zero; of equal gains the smallest feature and cut win. Boosting ends
    early when no tree of a round can be split. An empty table raises ``ValueError``. Sums are of doubles, so
    another partitioning can move scores by rounding only.
    """
    if not 2 <= bins <= BINS or leaves < 2 or rounds < 0:
        raise ValueError(f"bins from 2 to {BINS}, at least two leaves and no negative rounds")
    rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")).where("y is not null and not isnan(y)")
    size = rows.agg(F.max(F.size("x")).alias("d"), F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n")).first()
    if not size["n"]:
        raise ValueError("no rows to fit")
    width = size["d"]
    outputs = 1 if classes is None or len(classes) <= 2 else len(classes)
    if classes is None:
        start = [float(size["mean"])]
    else:
        counts = {r["y"]: r["count"] for r in rows.where(F.col("y").isin([float(c) for c in classes])).groupBy("y").count().collect()}
        share = [np.log(max(counts.get(float(c), 0), 1e-9)) for c in classes]
        start = [float(share[-1] - share[0])] if outputs == 1 and len(classes) == 2 else [float(s) for s in share]
    cuts = feature_cuts(rows, width, bins)
    codes = 1 + max((len(c) for c in cuts), default=0)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0

        def block() -> pd.DataFrame:
            x = np.stack([v for b in held for v in b["x"]])
            y = np.concatenate([b["y"].to_numpy(float) for b in held])
            coded = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]).astype(np.uint8)
            scores = np.tile(np.array(start), (len(y), 1))
            return pd.DataFrame({"x": [coded.tobytes()], "y": [y.tobytes()], "scores": [scores.tobytes()]})

        for b in batches:
            for i in range(0, len(b), block_rows):
                part = b.iloc[i:i + block_rows]
                if held and count + len(part) > block_rows:
                    yield block()
                    held, count = [], 0
                held.append(part)
                count += len(part)
        if count:
            yield block()

    def opened(x: bytes, y: bytes, scores: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(x, np.uint8).reshape(-1, width), np.frombuffer(y), np.frombuffer(scores).reshape(-1, outputs).copy()

    def advance(done: list[list[HistogramTree]]):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for xs, ys, ss in zip(b["x"], b["y"], b["scores"]):
                    x, _, scores = opened(xs, ys, ss)
                    for trees in done:
                        for k, tree in enumerate(trees):
                            tree.add_to(scores[:, k], x, True)
                    yield pd.DataFrame({"x": [xs], "y": [ys], "scores": [scores.tobytes()]})
        return work

    def sums(pending: list[list[HistogramTree]], growing: list[HistogramTree], open_nodes: list[list[int]]):
        """Gradient, curvature and row sums of each block per (tree, open node, feature)."""
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in advance(pending)(batches):
                for xs, ys, ss in zip(b["x"], b["y"], b["scores"]):
                    x, y, scores = opened(xs, ys, ss)
                    gradient, curve = _gradients(scores, y, classes)
                    for k, nodes in enumerate(open_nodes):
                        if not nodes:
                            continue
                        slot_of = np.full(len(growing[k].feature), -1)
                        slot_of[nodes] = np.arange(len(nodes))
                        slot = slot_of[growing[k].leaves(x, True)]
                        here = slot >= 0
                        if not here.any():
                            continue
                        slot, g, h = slot[here], gradient[here, k], curve[here, k]
                        parts = []
                        for j in range(width):
                            key, cells = slot * codes + x[here, j], len(nodes) * codes
                            table = np.stack([np.bincount(key, w, cells) for w in (g, h, None)], axis=1).reshape(len(nodes), codes, 3)
                            seen = np.flatnonzero(table[:, :, 2].any(axis=1))
                            parts.append(pd.DataFrame({"tree": k, "slot": seen, "feature": j, "sums": [table[s].tobytes() for s in seen]}))
                        yield pd.concat(parts)
        return work

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Best split of each (tree, node) among the features of a partition."""
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for b in batches:
            for tree, slot, feature, part in zip(b["tree"], b["slot"], b["feature"], b["sums"]):
                table = np.frombuffer(part).reshape(codes, 3)
                held[tree, slot, feature] = held[tree, slot, feature] + table if (tree, slot, feature) in held else table
        best: dict[tuple[int, int], tuple] = {}
        for (tree, slot, feature), table in sorted(held.items()):
            left = np.cumsum(table, axis=0)
            g, h, n = left[-1]
            lg, lh, ln = left.T
            fits = (ln >= min_rows) & (n - ln >= min_rows) & (lh > 0) & (h - lh > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fits, lg**2 / (lh + l2) + (g - lg) ** 2 / (h - lh + l2) - g**2 / (h + l2), -1.0)
            at = int(np.argmax(gain))
            if (tree, slot) not in best or gain[at] > best[tree, slot][4]:
                best[tree, slot] = (tree, slot, feature, at, float(gain[at]), g, h, n, lg[at], lh[at], ln[at])
        yield pd.DataFrame(list(best.values()), columns=[c.split()[0] for c in FOUND.split(", ")])

    packed_schema = "x binary, y binary, scores binary"
    packed = cut_lineage(rows.mapInPandas(pack, packed_schema))
    kept: list[list[HistogramTree]] = []
    pending: list[list[HistogramTree]] = []
    gains = [0.0] * width
    for _ in range(rounds):
        growing = [HistogramTree() for _ in range(outputs)]
        open_nodes = [[0] for _ in range(outputs)]
        while any(open_nodes):
            level = packed.mapInPandas(sums(pending, growing, open_nodes), "tree int, slot int, feature int, sums binary")
            found = level.repartition("tree", "slot", "feature").mapInPandas(search, FOUND).collect()
            best: dict[tuple[int, int], object] = {}
            for r in sorted(found, key=lambda r: (-r["gain"], r["feature"], r["bin"])):
                best.setdefault((r["tree"], r["slot"]), r)
            following: list[list[int]] = [[] for _ in range(outputs)]
            for (k, slot), r in best.items():
                tree = growing[k]
                room = (len(tree.feature) + 1) // 2 < leaves
                if r["gain"] <= 1e-12 * max(r["h"], 1.0) or not room:
                    continue
                values = (-step * r["lg"] / (r["lh"] + l2), -step * (r["g"] - r["lg"]) / (r["h"] - r["lh"] + l2))
                node = open_nodes[k][slot]
                both = tree.split(node, r["feature"], r["bin"], float(cuts[r["feature"]][r["bin"]]), values)
                gains[r["feature"]] += r["gain"]
                if tree.depth[node] + 1 < depth:
                    following[k] += [child for child, n in zip(both, (r["ln"], r["n"] - r["ln"])) if n >= 2 * min_rows]
            open_nodes = [nodes if (len(growing[k].feature) + 1) // 2 < leaves else [] for k, nodes in enumerate(following)]
        if all(len(t.feature) == 1 for t in growing):
            break
        kept.append(growing)
        pending.append(growing)
        if len(pending) == cut_every:
            packed = cut_lineage(packed.mapInPandas(advance(pending), packed_schema))
            pending = []
    return HistogramBoosting(kept, start, classes, gains)
