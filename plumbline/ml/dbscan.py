"""Exact DBSCAN by grid cells whose diagonal is eps.

All points of a cell are within eps of each other. A cell with min_samples points or more
therefore holds core points only and is one cluster piece without any pair being formed.
Pairs of points are formed only where one side has fewer than min_samples points, or
between the thin rims of two dense cells that cell and sub-cell boxes could not decide.
Copies of a point are folded into one weighted point first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.frames import cut_lineage
from plumbline.plans.lookups import lookup_join
from plumbline.plans.ranks import cumulative

DRIVER_EDGES = 200_000
SUB = 4
#: Helper columns, named so that no table has them.
CELL, CLUSTER = "__plumb_cell", "__plumb_cluster"


def _key(cols: list[str], side: float) -> Column:
    return F.concat_ws(",", *[F.floor(F.col(c) / side).cast("string") for c in cols])


def _boxes(points: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(
        F.sum("w").alias("n"), F.array(*[F.min(c) for c in cols]).alias("lo"), F.array(*[F.max(c) for c in cols]).alias("hi"))


def _box_gap(cols: list[str], a: str, b: str, far: bool) -> Column:
    """Squared smallest or largest distance between two boxes."""
    total = F.lit(0.0)
    for i in range(len(cols)):
        alo, ahi, blo, bhi = F.col(f"{a}lo")[i], F.col(f"{a}hi")[i], F.col(f"{b}lo")[i], F.col(f"{b}hi")[i]
        side = F.greatest(ahi - blo, bhi - alo) if far else F.greatest(alo - bhi, blo - ahi, F.lit(0.0))
        total = total + side * side
    return total


def _gap2(cols: list[str], a: str, b: str) -> Column:
    return sum(((F.col(a + c) - F.col(b + c)) * (F.col(a + c) - F.col(b + c)) for c in cols), F.lit(0.0))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _near_cells(left: DataFrame, right: DataFrame, cols: list[str], eps: float) -> DataFrame:
    """(acell, bcell, whole) of different cells, one of either table, whose boxes come within eps.

    Candidates share or neighbour a coarse square of side eps over the first three
    columns; the boxes decide. ``whole``: every point pair is within eps.
    """
    lead = cols[:3]
    coarse = [F.floor(F.col("lo")[i] / eps).cast("long") for i in range(len(lead))]
    left, right = (_prefixed(cells.select("cell", "n", "lo", "hi", *[c.alias(f"g{i}") for i, c in enumerate(coarse)]), side) for cells, side in ((left, "a"), (right, "b")))
    # A cell is smaller than a coarse square but may lie across two: one more step on each side.
    reach = F.array(*[F.lit(v).cast("long") for v in (-2, -1, 0, 1, 2)])
    for i in range(len(lead)):
        left = left.withColumn("_s", F.explode(reach)).withColumn(f"k{i}", F.col(f"ag{i}") + F.col("_s")).drop("_s")
    match = F.lit(True)
    for i in range(len(lead)):
        match = match & (F.col(f"k{i}") == F.col(f"bg{i}"))
    pairs = left.join(right, match & (F.col("acell") != F.col("bcell")))
    e2 = eps * eps
    return pairs.where(_box_gap(cols, "a", "b", far=False) <= e2).select(
        "acell", "bcell", F.col("an").alias("an"), F.col("bn").alias("bn"), (_box_gap(cols, "a", "b", far=True) <= e2).alias("whole"))


def dbscan(df: DataFrame, cols: list[str], eps: float, min_samples: int = 5, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """Add ``cluster``: numbered from 0 in the order of their smallest cell key, noise is -1.

    A point within reach of two clusters, without being a core point, joins the one with
    the smaller number.
    """
    return assign(df, core_points(df, cols, eps, min_samples, driver_edges), cols, eps)


def cell_side(cols: list[str], eps: float) -> float:
    return eps / math.sqrt(len(cols)) * (1 - 1e-9)


def core_points(df: DataFrame, cols: list[str], eps: float, min_samples: int = 5, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """The distinct core points: their coordinates, cell and ``cluster``."""
    e2 = eps * eps
    side = cell_side(cols, eps)
    folded = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("w")).withColumn("cell", _key(cols, side))
    points = cut_lineage(folded)
    cells = cut_lineage(_boxes(points, ["cell"], cols))
    # Points of dense cells are core points as they are: only sparse cells look around.
    near = cut_lineage(_near_cells(cells.where(F.col("n") < min_samples), cells, cols, eps))
    dense = cells.where(F.col("n") >= min_samples).select("cell")
    sparse_points = points.join(cells.where(F.col("n") < min_samples).select("cell", F.col("n").alias("own")), "cell")

    # Neighbour counts of the points in sparse cells: own cell, whole cells, then point by point.
    whole = near.where("whole").groupBy("acell").agg(F.sum("bn").alias("around"))
    partly = near.where(~F.col("whole")).select("acell", "bcell")
    other = _prefixed(points, "b")
    mine = _prefixed(sparse_points, "a")
    touching = mine.join(partly, "acell").join(other, "bcell").where(_gap2(cols, "a", "b") <= e2)
    extra = touching.groupBy(*[f"a{c}" for c in cols]).agg(F.sum("bw").alias("extra"))
    counted = mine.join(whole, "acell", "left").join(extra, [f"a{c}" for c in cols], "left")
    total = F.col("aown") + F.coalesce("around", F.lit(0)) + F.coalesce("extra", F.lit(0))
    sparse_core = counted.where(total >= min_samples).select(F.col("acell").alias("cell"), *[F.col(f"a{c}").alias(c) for c in cols], F.col("aw").alias("w"))
    core = cut_lineage(points.join(dense, "cell").select("cell", *cols, "w").unionByName(sparse_core))

    labels = _core_labels(core, cols, eps, min_samples, driver_edges)

    names = labels.select("label").distinct().withColumn("n", F.lit(1))
    numbers = cumulative(names, [], [F.col("label")]).select("label", F.col("place").cast("int").alias("cluster"))
    return cut_lineage(core.join(labels.join(numbers, "label"), "cell").select("cell", *cols, "cluster"))


def assign(df: DataFrame, core: DataFrame, cols: list[str], eps: float) -> DataFrame:
    """Add ``cluster`` to rows of any table: that of a core point in their own cell, all of which are within reach, else the smallest one of the
    core points in near cells that are within ``eps``, else -1."""
    own = cut_lineage(core.groupBy("cell").agg(F.first("cluster").alias(CLUSTER), F.count(F.lit(1)).alias("n")))  # a cell's core points are one cluster
    known = F.lit(True)
    for c in cols:
        known = known & F.col(c).isNotNull()
    # Rows of those cells are done; the others alone are folded, paired and looked up by their coordinates.
    placed = cut_lineage(lookup_join(df.withColumn(CELL, F.when(known, _key(cols, cell_side(cols, eps)))), own.withColumnRenamed("cell", CELL), CELL, [CLUSTER]))
    rest = placed.where(F.col(CLUSTER).isNull())
    there = cut_lineage(rest.where(F.col(CELL).isNotNull()).select(F.col(CELL).alias("cell"), *cols).groupBy("cell", *cols).agg(F.count(F.lit(1)).alias("w")))
    boxes = _boxes(core.select("cell", *cols, F.lit(1).cast("bigint").alias("w")), ["cell"], cols)
    near = cut_lineage(_near_cells(_boxes(there, ["cell"], cols), boxes, cols, eps).select("acell", "bcell"))
    reach = _prefixed(there, "a").join(near, "acell").join(_prefixed(core, "b"), "bcell").where(_gap2(cols, "a", "b") <= eps * eps)
    border = reach.groupBy(*[f"a{c}" for c in cols]).agg(F.min("bcluster").alias("cluster")).select(*[F.col(f"a{c}").alias(c) for c in cols], "cluster")
    same = F.lit(True)
    for c in cols:
        same = same & (F.col(f"p.{c}") == F.col(f"q.{c}"))
    found = rest.drop(CELL, CLUSTER).alias("p").join(border.alias("q"), same, "left").select("p.*", F.coalesce("q.cluster", F.lit(-1)).alias("cluster"))
    return placed.where(F.col(CLUSTER).isNotNull()).drop(CELL).withColumnRenamed(CLUSTER, "cluster").unionByName(found)


def _core_labels(core: DataFrame, cols: list[str], eps: float, min_samples: int, driver_edges: int) -> DataFrame:
    """(cell, label) of the cells with core points, joined where core points are within eps.

    Boxes decide first: of whole cells, then of sub-cells of dense pairs. Points are paired
    only between cells those edges have not connected already.
    """
    e2 = eps * eps
    boxes = cut_lineage(_boxes(core, ["cell"], cols))
    pairs = cut_lineage(_near_cells(boxes, boxes, cols, eps).where("acell < bcell"))
    sure = pairs.where("whole").select("acell", "bcell")
    open_pairs = pairs.where(~F.col("whole")).select("acell", "bcell", ((F.col("an") >= min_samples) & (F.col("bn") >= min_samples)).alias("heavy"))

    # Sub-cells of a quarter of the side: at most SUB^d boxes per cell over the first three columns.
    fine = [F.floor(F.col(c) / (eps / math.sqrt(len(cols)) / SUB)).cast("string") for c in cols[:3]]
    parted = core.withColumn("sub", F.concat_ws(",", *fine))
    subs = cut_lineage(_boxes(parted, ["cell", "sub"], cols))

    def sub_pairs(which: DataFrame) -> DataFrame:
        joined = which.join(_prefixed(subs, "a"), "acell").join(_prefixed(subs, "b"), "bcell")
        return joined.where(_box_gap(cols, "a", "b", far=False) <= e2)

    decided = sub_pairs(open_pairs.where("heavy").drop("heavy")).where(_box_gap(cols, "a", "b", far=True) <= e2).select("acell", "bcell").distinct()
    nodes = boxes.select("cell")
    known = cut_lineage(sure.unionByName(decided))
    labels = cut_lineage(_components(nodes, known, driver_edges))
    apart = open_pairs.join(labels.select(F.col("cell").alias("acell"), F.col("label").alias("la")), "acell").join(
        labels.select(F.col("cell").alias("bcell"), F.col("label").alias("lb")), "bcell").where("la <> lb").drop("la", "lb")
    apart = cut_lineage(apart)
    light = apart.where(~F.col("heavy")).drop("heavy").join(_prefixed(core, "a"), "acell").join(_prefixed(core, "b"), "bcell")
    rims = sub_pairs(apart.where("heavy").drop("heavy")).select("acell", "asub", "bcell", "bsub").join(
        _prefixed(parted, "a"), ["acell", "asub"]).join(_prefixed(parted, "b"), ["bcell", "bsub"])
    met = [t.where(_gap2(cols, "a", "b") <= e2).select("acell", "bcell").distinct() for t in (light, rims)]
    found = cut_lineage(met[0].unionByName(met[1]))
    return cut_lineage(_components(nodes, known.unionByName(found), driver_edges))


def _components(nodes: DataFrame, edges: DataFrame, driver_edges: int) -> DataFrame:
    """(cell, label): the smallest cell key of each connected piece.

    A short edge list is joined up in the driver; a longer one by repeated minimum
    labels with pointer jumping, each round written to the checkpoint folder.
    """
    few = edges.limit(driver_edges + 1).collect()
    if len(few) <= driver_edges:
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for r in few:
            x, y = root(r["acell"]), root(r["bcell"])
            if x != y:
                parent[max(x, y)] = min(x, y)
        known = [(c, root(c)) for c in list(parent)]
        if not known:
            return nodes.withColumn("label", F.col("cell"))
        table = nodes.sparkSession.createDataFrame(known, "cell string, label string")
        return nodes.join(table, "cell", "left").withColumn("label", F.coalesce("label", "cell"))
    both = cut_lineage(edges.select(F.col("acell").alias("src"), F.col("bcell").alias("cell")).unionByName(
        edges.select(F.col("bcell").alias("src"), F.col("acell").alias("cell"))))
    labels = cut_lineage(nodes.withColumn("label", F.col("cell")))
    while True:
        offered = both.join(labels.select(F.col("cell").alias("src"), "label"), "src").select("cell", "label")
        lower = labels.unionByName(offered).groupBy("cell").agg(F.min("label").alias("label"))
        # A label is itself a cell: take over the label that cell has by now.
        jump = lower.select(F.col("cell").alias("via"), F.col("label").alias("further"))
        after = cut_lineage(lower.join(jump, lower["label"] == jump["via"]).select("cell", F.col("further").alias("label")))
        moved = after.join(labels.select("cell", F.col("label").alias("old")), "cell").where("label <> old")
        if not moved.limit(1).count():
            return after
        labels = after
