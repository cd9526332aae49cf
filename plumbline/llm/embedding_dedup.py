"""Embedding near-duplicates by a forest of random-projection trees.

A tree cuts space by random directions at medians of a bounded sample. Vectors close to a cut go to both
sides, so that a close pair is parted only if it straddles a cut by more than the overlap on each
side. Vectors meet in the leaves of several trees; every pair in a leaf is compared exactly. A pair that
meets in several leaves counts in the first, which both vectors' lists of leaves tell without any exchange.

Equal vectors are one class with a count. A leaf hands on a number of links per class and a forest of links,
never the pairs. Leaves with too many classes are cut into blocks, and blocks are compared two by two in
tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage, salted_lookup, split_crowded
from plumbline.llm.components import components, merge_labels
from plumbline.plans.frames import hash_share

#: Vectors the trees are fitted on, at most about so many, picked by a hash.
SAMPLE = 32_768
TREES, LEAF, BLOCK, DEPTH = 5, 256, 8_192, 16
#: Overlap on each side of a cut, in standard deviations of a random unit vector's projection.
SPILL = 0.25
SALTS = 256
PAIRS_AT_ONCE = 200_000


@dataclass
class Tree:
    """Nodes in arrays; a child below zero is leaf ``-1 - child``."""

    seed: int
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    first_leaf: int

    def directions(self, width: int) -> np.ndarray:
        """Unit directions of all nodes; cut to ``width``, so vectors of any width have a way."""
        all_ = np.random.default_rng(self.seed).standard_normal((len(self.cut), 4_096 if width <= 4_096 else width))[:, :width]
        return all_ / np.linalg.norm(all_, axis=1, keepdims=True)


def fit_tree(sample: np.ndarray, seed: int, share: float, first_leaf: int) -> Tree:
    """``share``: rows of the largest label that a sampled row stands for."""
    rng = np.random.default_rng(seed + 1)
    nodes, work, leaves = [], [(np.arange(len(sample)), 0, -1, 0)], 0
    probe = Tree(seed, np.zeros(1 << 12), None, None, 0).directions(sample.shape[1]) if len(sample) else None
    while work:
        rows, depth, parent, side = work.pop()
        if len(rows) * share <= LEAF or len(rows) < 16 or depth >= DEPTH or len(nodes) >= len(probe):
            child = -1 - leaves
            leaves += 1
        else:
            child = len(nodes)
            along = sample[rows] @ probe[child]
            at = float(np.quantile(along, rng.uniform(0.4, 0.6)))
            nodes.append([at, 0, 0])
            low = along < at
            work += [(rows[low], depth + 1, child, 1), (rows[~low], depth + 1, child, 2)]
        if parent >= 0:
            nodes[parent][side] = child
    cut = np.array([n[0] for n in nodes])
    return Tree(seed, cut, np.array([n[1] for n in nodes], int), np.array([n[2] for n in nodes], int), first_leaf)


def leaves_of(tree: Tree, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs of unit vectors; a row near a cut is in several leaves."""
    if not len(tree.cut):
        return np.arange(len(unit)), np.full(len(unit), tree.first_leaf)
    along = unit @ tree.directions(unit.shape[1]).T
    margin = SPILL / np.sqrt(unit.shape[1])
    row, node, out = np.arange(len(unit)), np.zeros(len(unit), int), []
    while len(row):
        away = along[row, node] - tree.cut[node]
        lower, upper = away < margin, away >= -margin
        row, node = np.concatenate([row[lower], row[upper]]), np.concatenate([tree.left[node[lower]], tree.right[node[upper]]])
        end = node < 0
        out.append((row[end], tree.first_leaf - 1 - node[end]))
        row, node = row[~end], node[~end]
    return np.concatenate([r for r, _ in out]), np.concatenate([leaf for _, leaf in out])


def fit_forest(classes: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> list[Tree]:
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    top, total = (largest[0] or 0), (largest[1] or 0)
    share = min(1.0, sample / max(1, total))
    rows = classes.where(hash_share(F.col("class"), seed=3) < F.lit(share)).select("vec").collect()
    width = max((len(r[0]) for r in rows), default=1)
    held = [np.asarray(r[0], float) for r in rows if len(r[0]) == width]
    drawn = np.array([v / np.linalg.norm(v) for v in held]).reshape(-1, width)
    forest, first = [], 0
    for seed in range(trees):
        forest.append(fit_tree(drawn, 1_000 + 2 * seed, top / max(1, len(drawn)), first))
        first += len(forest[-1].cut) + 1
    return forest


def usable(vec: Column) -> Column:
    """Vectors with a direction: not null, all components finite, not all zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


PLACED = "label string, width int, leaf int, class bigint, weight bigint, vec array<double>, leaves array<int>"


def deal(forest):
    """Every class with its vector to its leaves; ``leaves`` lists them all in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, ident, weight = batch.column(0), batch.column(1), batch.column(2)
            vecs = batch.column(3).to_pylist()
            widths = np.array([len(v) for v in vecs])
            for width in np.unique(widths):
                here = np.flatnonzero(widths == width)
                raw = np.array([vecs[i] for i in here], float)
                scale = np.abs(raw).max(axis=1, keepdims=True)
                unit = raw / scale
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                found = [leaves_of(t, unit) for t in forest.value]
                row, leaf = np.concatenate([r for r, _ in found]), np.concatenate([x for _, x in found])
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(here) + 1)), pa.int32()), pa.array(leaf, pa.int32()))
                take = pa.array(here[row])
                flat = pa.array(unit[row].ravel())
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * width, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([
                    label.take(take), pa.array(np.full(len(row), width), pa.int32()), pa.array(leaf, pa.int32()), ident.take(take), weight.take(take), vec,
                    lists.take(pa.array(row))], names=["label", "width", "leaf", "class", "weight", "vec", "leaves"])

    return work


def compare(rows: pa.Table, threshold: float) -> pa.RecordBatch:
    """Links of one leaf, or of two blocks of one: class, number of linked vectors, root of its group here."""
    n = rows.num_rows
    unit = rows["vec"].combine_chunks().flatten().to_numpy().reshape(n, -1)
    weight, ident = rows["weight"].to_numpy(), rows["class"].to_numpy()
    leaf, left = rows["leaf"][0].as_py(), rows["left"].to_numpy(zero_copy_only=False)
    right = rows["right"].to_numpy(zero_copy_only=False)
    lists = rows["leaves"].combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    wide = np.full((n, counts.max()), -1)
    wide[np.repeat(np.arange(n), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)] = lists.flatten().to_numpy()
    labels, links = np.arange(n), np.zeros(n, np.int64)
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    own = bool((left & right).any())
    step = max(1, 4_000_000 // max(1, len(b)))
    for i in range(0, len(a), step):
        x, y = np.nonzero(unit[a[i:i + step]] @ unit[b].T >= threshold)
        x, y = a[i:i + step][x], b[y]
        once = x < y if own else np.ones(len(x), bool)
        x, y = x[once], y[once]
        for j in range(0, len(x), PAIRS_AT_ONCE):
            p, q = x[j:j + PAIRS_AT_ONCE], y[j:j + PAIRS_AT_ONCE]
            labels = merge_labels(labels, p, q)
            met = np.zeros(len(p), bool)
            for c in range(wide.shape[1]):
                early = wide[p, c]
                met |= ((early >= 0) & (early < leaf))[:] & (wide[q] == early[:, None]).any(axis=1)
            p, q = p[~met], q[~met]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
    some = np.flatnonzero((links > 0) | (labels != np.arange(n)))
    return pa.RecordBatch.from_arrays([pa.array(ident[some]), pa.array(links[some]), pa.array(ident[labels[some]])], names=["class", "n", "root"])


def compare_leaves(threshold: float):
    """Compare a partition that is sorted by leaf and block pair, one of them at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            at = list(zip(*[batch.column(i).to_pylist() for i in range(5)]))
            begin = 0
            for i in range(len(at) + 1):
                if i == len(at) or (at[i] != key):
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    if i < len(at):
                        if sum(h.num_rows for h in held) > 1:
                            yield compare(pa.Table.from_batches(held), threshold)
                        held, key, begin = [], at[i], i
        if sum(h.num_rows for h in held) > 1:
            yield compare(pa.Table.from_batches(held), threshold)

    return work


def embedding_dedup(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.98,
    trees: int = TREES, sample: int = SAMPLE, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept.

    Only rows with equal labels that are not null are compared (all rows if ``label_col`` is None), and only vectors of equal width. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing. ``component_id`` is the smallest
    id reachable, ``kept`` marks the rows that carry it. Repeated ids are rows of their own; a row
    without id counts as a link but names no component. An empty table gives an empty result. Extra columns play no part.
    """
    label = F.lit("") if label_col is None else rows[label_col].cast("string")
    base = cut_lineage(rows.select(rows[id_col].alias("vec_id"), label.alias("label"), rows[vec_col].cast("array<double>").alias("vec")).withColumn(
        "row", F.monotonically_increasing_id()))
    able = base.where(usable(F.col("vec")) & F.col("label").isNotNull())
    classes = cut_lineage(able.groupBy("label", "vec").agg(F.min("row").alias("class"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("smallest")))
    forest = rows.sparkSession.sparkContext.broadcast(fit_forest(classes, trees, sample))
    placed = cut_lineage(classes.select("label", "class", "weight", "vec").mapInArrow(deal(forest), PLACED))
    key = ["label", "width", "leaf"]
    dealt = split_crowded(placed, key, block, F.col("class")).select(*key, "p", "q", "class", "weight", "vec", "leaves", "left", "right")
    pair = [*key, "p", "q"]
    met = cut_lineage(dealt.repartition(*pair).sortWithinPartitions(*pair).mapInArrow(compare_leaves(threshold), "class bigint, n bigint, root bigint"))
    links = met.groupBy("class").agg(F.sum("n").alias("n"))
    nodes = components(met.select(F.col("class").alias("a"), F.col("root").alias("b")))
    joined = classes.join(links, "class", "left").join(nodes, classes["class"] == nodes["node"], "left").select(
        "label", "vec", "smallest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"), "class")
    roots = joined.groupBy("root").agg(F.min("smallest").alias("component_id"))
    known = salted_lookup(joined, roots, ["root"], F.col("class"), SALTS).select("label", "vec", "n_links", "component_id")
    linked = salted_lookup(able.select("vec_id", "row", "label", "vec"), known, ["label", "vec"], F.col("row"), SALTS).select("vec_id", "n_links", "component_id")
    alone = base.where(~usable(F.col("vec")) | F.col("label").isNull()).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
