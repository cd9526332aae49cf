"""Exact nearest neighbours by pivots: imputation, oversampling and a neighbour model.

Donors are dealt to the nearest of some sampled pivots. How far a group reaches from its pivot
bounds, by the triangle inequality, the distance of all its members from a query, so a query meets only the groups
that may hold one of its k nearest. Groups near each other form a region, to which a query is sent once, however many of its groups
it needs. Large regions and crowds of queries are cut into blocks; a
pair of blocks is one task that returns the k nearest donors per query and nothing else, and the
block results are merged by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.plans.frames import cut_lineage, hash_share
from plumbline.plans.profiling import profiled
from plumbline.plans.sampling import mark_per_class

QUERY_BLOCK = 10_000
DONOR_BLOCK = 50_000
MAX_PIVOTS = 2_048
#: Regions that donors are dealt over at least, if they have so many rows; queries whose distances from pivots are held together.
REGIONS, REGION_ROWS, QUERIES_AT_ONCE = 64, 1_000, 1_000
#: Sets of missing columns that are looked up apart, each among the columns it has.
PATTERNS = 8


def _rough(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of the rows of x from the rows of y over the coordinates that x has, by matrix products, and per row of x how far off
    they may be."""
    gone = np.isnan(x)
    middle = y.mean(axis=0)
    z, y = np.where(gone, 0.0, x - middle), y - middle
    own, other = (z * z).sum(axis=1), y * y
    out = z @ (-2.0 * y.T)
    out += own[:, None]
    out += (~gone).astype(float) @ other.T if gone.any() else other.sum(axis=1)
    return out, 2e-15 * (y.shape[1] + 16) * (own + other.sum(axis=1).max(initial=0.0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    if column.null_count:
        raise ValueError("a row has no vector")
    flat = np.asarray(pc.list_flatten(column), float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def closest(x: np.ndarray, y: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, squared distance) of the ``keep`` nearest rows of y for each row of x, equal ones in the order of y.

    Matrix products tell which rows may be among them; only those are measured and sorted.
    """
    rough, off = _rough(x, y)
    keep = min(keep, len(y))
    limit = np.partition(rough, keep - 1, axis=1)[:, keep - 1] + 2 * off
    row, at = np.nonzero(rough <= limit[:, None])
    del rough
    exact, step = np.empty(len(row)), max(1, 4_000_000 // max(1, y.shape[1]))
    for i in range(0, len(row), step):
        gap = np.nan_to_num(x[row[i : i + step]] - y[at[i : i + step]], nan=0.0)
        exact[i : i + step] = (gap * gap).sum(axis=1)
    order = np.lexsort((at, exact, row))
    row, at, exact = row[order], at[order], exact[order]
    first = np.searchsorted(row, np.arange(len(x)))
    best = np.arange(len(row)) - first[row] < keep
    return row[best], at[best], exact[best]


def nearest(queries: DataFrame, donors: DataFrame, k: int, exclude_self: bool = False, donor_rows: int | None = None,
            query_block: int = QUERY_BLOCK, donor_block: int = DONOR_BLOCK, pivots: int | None = None) -> DataFrame:
    """(qid, did, rank, distance): the k nearest donors of each query, ties by donor id.

    Both inputs are (id string, x array<double>). A missing query coordinate is left out
    and the squared distance scaled up by the share of present ones.
    """
    keep = k + exclude_self
    rows = donors.count() if donor_rows is None else donor_rows
    found = _Groups.of(donors, rows, pivots, together=min(donor_block, max(REGION_ROWS, -(-rows // REGIONS))))
    pairs, placed = found.visited(queries, keep, donor_block), found.blocks(donor_block)

    def meet(q: pa.Table, d: pa.Table) -> pa.Table:
        # id order makes equal distances resolve the same way everywhere
        d = d.take(pc.sort_indices(d["did"]))
        x, y, own = _matrix(q["qx"]), _matrix(d["dx"]), d["own"].to_numpy()
        row, donor, gap = found.closest(x, y, own, q["bound"].to_numpy(), keep)
        share = x.shape[1] / np.maximum((~np.isnan(x)).sum(axis=1), 1) if len(x) else np.empty(0)
        out = pa.table({"qid": q["qid"].take(pa.array(row)), "did": d["did"].take(pa.array(donor)), "distance": np.sqrt(gap * share[row])})
        return out.filter(pc.fill_null(pc.not_equal(out["qid"], out["did"]), True)) if exclude_self else out

    # A crowd of queries at one block of donors is dealt over copies of that block.
    crowds = pairs.groupBy("g", "b").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("crowd"))
    asked = pairs.join(crowds, ["g", "b"]).withColumn("c", F.pmod(F.xxhash64("qid"), F.col("crowd")).cast("int"))
    given = placed.join(crowds, ["g", "b"]).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("crowd") - 1)))
    # The number of tasks is given: short vectors are few bytes, and the work is not.
    tasks = int(min(2_000, max(2 * found.blocks_in_all(donor_block), pairs.count() // 5_000)))
    met = asked.select("g", "b", "c", "qid", "qx", "bound").repartition(tasks, "g", "b", "c").groupBy("g", "b", "c").cogroup(
        given.select("g", "b", "c", "own", "did", "dx").repartition(tasks, "g", "b", "c").groupBy("g", "b", "c")).applyInArrow(meet, "qid string, did string, distance double")
    w = W.partitionBy("qid").orderBy("distance", "did")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def visits(queries: DataFrame, donors: DataFrame, k: int, donor_rows: int | None = None, donor_block: int = DONOR_BLOCK,
           pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(g, b, qid, qx): the groups and blocks a query must visit; (g, b, did, dx): their donors."""
    found = _Groups.of(donors, donors.count() if donor_rows is None else donor_rows, pivots)
    return found.visited(queries, k, donor_block).drop("bound"), found.blocks(donor_block).drop("own")


def regions(centres: np.ndarray, count: np.ndarray, together: int) -> np.ndarray:
    """The region of each group: groups are halved by walls across a long axis of their pivots until a region holds at most ``together`` donors or one group."""
    region, todo, n = np.zeros(len(centres), np.int64), [np.arange(len(centres))], 0
    rng = np.random.default_rng(31)
    while todo:
        at = todo.pop()
        if len(at) > 1 and count[at].sum() > together:
            x = centres[at] - centres[at].mean(axis=0)
            axis = rng.normal(size=x.shape[1])
            for _ in range(3):
                axis = x.T @ (x @ axis)
                axis /= max(float(np.abs(axis).max()), 1e-300)
            order = at[np.argsort(x @ axis, kind="stable")]
            held = np.cumsum(count[order])
            half = min(max(int(np.searchsorted(held, held[-1] / 2)), 1), len(at) - 1)
            todo += [order[:half], order[half:]]
        else:
            region[at] = n
            n += 1
    return region


def _sampled(donors: DataFrame, rows: int, many: int) -> np.ndarray:
    """The vectors of the ``many`` donors of the smallest hashes, from about ``rows``.

    Only rows that may be among them are gathered, and one task picks them, so that the driver gets ``many``, and not as many from every task.
    """
    share = hash_share("id", seed=31)
    upto = (many + 8 * math.sqrt(many)) / max(rows, 1)
    while True:
        low = donors if upto >= 1 else donors.where(share <= upto)
        found = low.repartition(1).orderBy(share, "id").limit(many).select("x").collect()
        if upto >= 1 or len(found) == many:
            return np.array([r["x"] for r in found], dtype=float)
        upto *= 8


class _Groups:
    """Donors dealt to their nearest pivots, and how far each group reaches; groups near each other form a region, which is one task."""

    def __init__(self, placed: DataFrame, centres: np.ndarray, count: np.ndarray, reach: np.ndarray, region: np.ndarray):
        self.placed, self.centres, self.count, self.reach, self.region = placed, centres, count, reach, region

    @classmethod
    def of(cls, donors: DataFrame, rows: int, pivots: int | None, together: int = 0) -> _Groups:
        many = pivots or int(min(MAX_PIVOTS, max(1, math.isqrt(rows))))
        centres = _sampled(donors, rows, many)
        if not len(centres):
            centres = np.zeros((1, 1))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for d in batches:
                if d.num_rows:
                    x = _matrix(d.column(1))
                    g = _rough(x, centres)[0].argmin(axis=1)  # any group will do, its reach is exact
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), d.column(0), d.column(1), pa.array(np.sqrt(((x - centres[g]) ** 2).sum(axis=1)))], names=["own", "did", "dx", "far"])

        placed = cut_lineage(donors.select(F.col("id").cast("string"), F.col("x").cast("array<double>")).mapInArrow(assign, "own int, did string, dx array<double>, far double"))
        count, reach = np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for r in placed.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():
            count[r["own"]], reach[r["own"]] = r["n"], r["far"]
        return cls(placed, centres, count, reach, regions(centres, count, together))

    def __getstate__(self) -> dict:
        return {**vars(self), "placed": None}  # tasks need the pivots only

    def _blocks(self, donor_block: int) -> np.ndarray:
        return -(-np.bincount(self.region, self.count).astype(np.int64) // donor_block)

    def blocks_in_all(self, donor_block: int) -> int:
        return max(1, int(self._blocks(donor_block).sum()))

    def blocks(self, donor_block: int) -> DataFrame:
        """(g, b, own, did, dx): region, block of the region, group; donors of a region are dealt over its blocks by a hash."""
        wide, region = (F.array(*[F.lit(int(n)) for n in v]) for v in (np.maximum(self._blocks(donor_block), 1), self.region))
        put = self.placed.withColumn("g", F.element_at(region, F.col("own") + 1))
        return put.select("g", F.pmod(F.xxhash64("did"), F.element_at(wide, F.col("g") + 1)).cast("int").alias("b"), "own", "did", "dx")

    def away(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How far rows are, at least, from any donor of the groups ``own``."""
        rough, off = _rough(x, self.centres[own])
        return np.sqrt(np.maximum(rough - off[:, None], 0.0)) - self.reach[own]

    def visited(self, queries: DataFrame, k: int, donor_block: int) -> DataFrame:
        """(g, b, qid, qx, bound): the regions and blocks a query must visit; its k nearest donors are not beyond ``bound``."""
        blocks, count, region = self._blocks(donor_block), self.count, self.region

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for q in (batch.slice(i, QUERIES_AT_ONCE) for batch in batches for i in range(0, batch.num_rows, QUERIES_AT_ONCE)):
                x = _matrix(q.column(1))
                rough, off = _rough(x, self.centres)
                away = np.sqrt(np.maximum(rough - off[:, None], 0.0)) - self.reach
                most = np.where(count > 0, np.sqrt(np.maximum(rough, 0.0) + off[:, None]) + self.reach, np.inf)
                # A group that is not empty has a donor, so the nearest k groups hold enough.
                few = np.argpartition(most, min(k, most.shape[1]) - 1, axis=1)[:, :k]
                few = np.take_along_axis(few, np.argsort(np.take_along_axis(most, few, axis=1), axis=1), axis=1)
                enough = (np.cumsum(count[few], axis=1) >= min(k, int(count.sum()))).argmax(axis=1)
                bound = most[np.arange(len(x)), few[np.arange(len(x)), enough]]
                row, g = np.nonzero((away <= _beyond(bound)[:, None]) & (count > 0))
                row, g = np.divmod(np.unique(row * len(blocks) + region[g]), len(blocks))
                times = blocks[g]
                b = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, g = np.repeat(row, times), np.repeat(g, times)
                yield pa.RecordBatch.from_arrays([
                    pa.array(g, pa.int32()), pa.array(b, pa.int32()), q.column(0).take(pa.array(row)), _vectors(x[row]), pa.array(bound[row])], names=["g", "b", "qid", "qx", "bound"])

        return cut_lineage(queries.select(F.col("id").cast("string"), F.col("x").cast("array<double>")).mapInArrow(
            plan, "g int, b int, qid string, qx array<double>, bound double"))

    def closest(self, x: np.ndarray, y: np.ndarray, own: np.ndarray, bound: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``closest`` of donors whose groups are ``own``, for queries whose nearest donors are not beyond ``bound``. The donors of a query's nearest
        group are measured first, and then only groups that may hold nearer ones."""
        held = np.unique(own)
        members = {j: np.flatnonzero(own == j) for j in held.tolist()}
        found: list[tuple[np.ndarray, ...]] = []
        for start in range(0, len(x) if len(held) else 0, QUERIES_AT_ONCE):
            part, limit = x[start:start + QUERIES_AT_ONCE], bound[start:start + QUERIES_AT_ONCE].copy()
            away = self.away(part, held)
            first = away.argmin(axis=1)
            for again in (False, True):
                for at, j in enumerate(held.tolist()):
                    mine = np.flatnonzero((away[:, at] <= _beyond(limit)) & ((first == at) != again))
                    step = max(1, 4_000_000 // len(members[j]))
                    for i in range(0, len(mine), step):
                        rows = mine[i:i + step]
                        row, donor, gap = closest(part[rows], y[members[j]], keep)
                        found.append((start + rows[row], members[j][donor], gap))
                        if len(members[j]) >= keep:  # the last of each row is its k-th nearest so far
                            limit[rows] = np.minimum(limit[rows], np.sqrt(gap[keep - 1::keep]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        row, donor, gap = (np.concatenate(v) for v in zip(*found))
        order = np.lexsort((donor, gap, row))
        row, donor, gap = row[order], donor[order], gap[order]
        best = np.arange(len(row)) - np.searchsorted(row, row, "left") < keep
        return row[best], donor[best], gap[best]


def _beyond(bound: np.ndarray) -> np.ndarray:
    """A little more than the bound, for what rounding may add."""
    return bound * (1 + 1e-9) + 1e-12


def impute_knn(df: DataFrame, cols: list[str], id_col: str, k: int = 5, donors_from: DataFrame | None = None) -> DataFrame:
    """Fill gaps with the mean of the k nearest complete rows (Euclidean over present values)."""
    source = df if donors_from is None else donors_from
    x = F.array(*[C.as_number(df, c) for c in cols])
    gappy = F.lit(False)
    for c in cols:
        gappy = gappy | C.is_null(df, c)
    queries = df.where(gappy).select(C.quoted(id_col).cast("string").alias("id"), F.transform(x, lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x"))
    donors = source.select(C.quoted(id_col).cast("string").alias("id"), *[C.as_number(source, c).alias(f"_d{i}") for i, c in enumerate(cols)]).dropna()
    vectors = donors.select("id", F.array(*[F.col(f"_d{i}") for i in range(len(cols))]).alias("x"))
    near = _nearest_by_pattern(queries, vectors, k, len(cols))
    means = near.join(donors, near["did"] == donors["id"]).groupBy("qid").agg(
        *[F.avg(f"_d{i}").alias(f"_m{i}") for i in range(len(cols))])
    joined = df.join(means, C.quoted(id_col).cast("string") == F.col("qid"), "left")
    return joined.select(*[
        F.coalesce(C.as_number(df, c), F.col(f"_m{cols.index(c)}")).alias(c) if c in cols else C.quoted(c) for c in df.columns])


def _nearest_by_pattern(queries: DataFrame, donors: DataFrame, k: int, width: int) -> DataFrame:
    """(qid, did) of the k nearest donors, looked up among the columns that a query has.

    Distances know nothing else, so donors alike there are as near as each other and the k smallest ids
    of them are enough; queries alike there are looked up once. With more than ``PATTERNS`` sets of missing columns all go through one search.
    """
    queries = cut_lineage(queries)
    gaps = queries.select(F.transform("x", F.isnan).alias("p"))
    patterns = [r["p"] for r in gaps.distinct().limit(PATTERNS + 1).collect()]
    if not 0 < len(patterns) <= PATTERNS:
        return nearest(queries, donors, k).select("qid", "did")
    out = None
    for p in patterns:
        at = [i for i in range(width) if not p[i]]
        seen = F.array(*[F.col("x")[i] for i in at]) if at else F.array(F.lit(0.0))
        asked = queries.where(F.transform("x", F.isnan) == F.array(*[F.lit(v) for v in p])).select("id", seen.alias("x"))
        once = cut_lineage(asked.groupBy("x").agg(F.min("id").alias("id")))
        first = donors.select("id", seen.alias("x")).withColumn("rn", F.row_number().over(W.partitionBy("x").orderBy("id"))).where(F.col("rn") <= k)
        near = nearest(once.select("id", "x"), cut_lineage(first.select("id", "x")), k)
        apart = (F.col("distance") * math.sqrt(width / max(len(at), 1))).alias("distance")
        found = asked.join(once.select("x", F.col("id").alias("qid")), "x").join(near.select("qid", "did", apart), "qid").select(F.col("id").alias("qid"), "did", "distance")
        out = found if out is None else out.unionByName(found)
    # Rows that share an id share k neighbours, as in one search.
    w = W.partitionBy("qid").orderBy("distance", "did")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "did")


def smote(df: DataFrame, target: str, cols: list[str], id_col: str, ratio: float = 1.0, k: int = 5, seed: int = 42) -> DataFrame:
    """Original rows and synthetic minority rows up to ``ratio`` times the majority.

    Each synthetic row lies between a minority row and one of its k nearest minority
    neighbours; neighbour and position follow from a hash of the id and the copy number.
    The result has the feature columns, the target and a flag.
    """
    label = C.quoted(target).cast("string")
    sizes = df.where(label.isNotNull()).groupBy(label.alias("y")).agg(F.count(F.lit(1)).alias("n")).orderBy("n", "y").collect()
    minority, small, large = sizes[0]["y"], sizes[0]["n"], sizes[-1]["n"]
    need = max(0, int(ratio * large) - small)
    original = df.select(*[C.as_number(df, c).alias(c) for c in cols], label.alias(target), F.lit(False).alias("synthetic"))
    if need == 0 or small < 2:
        return original
    rows = df.where(label == F.lit(minority)).select(
        C.quoted(id_col).cast("string").alias("id"), F.array(*[F.coalesce(C.as_number(df, c), F.lit(0.0)) for c in cols]).alias("x"))
    near = nearest(rows, rows, k, exclude_self=True, donor_rows=small)
    listed = near.join(rows.select(F.col("id").alias("did"), F.col("x").alias("nx")), "did").groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("rank", "nx"))).alias("near"))
    copies, extra = divmod(need, small)
    marked = mark_per_class(rows, None, lambda n: extra, "id", seed)
    base = marked.join(listed, F.col("id") == F.col("qid")).withColumn("m", F.lit(copies) + F.col("_taken").cast("int")).where("m > 0")
    made = base.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m"))))
    pick = F.floor(hash_share("id", "copy", seed=seed) * F.size("near")).cast("int")
    made = made.withColumn("to", F.col("near")[pick]["nx"]).withColumn("t", hash_share("id", "copy", seed=seed + 1))
    between = F.zip_with("x", "to", lambda a, b: a + F.col("t") * (b - a))
    made = made.withColumn("z", between)
    synthetic = made.select(*[F.col("z")[i].alias(c) for i, c in enumerate(cols)], F.lit(minority).alias(target), F.lit(True).alias("synthetic"))
    return original.unionByName(synthetic)


class NeighborModel:
    """Vote or mean of the k nearest training rows."""

    def __init__(self, train: DataFrame, k: int, classes: list[float] | None):
        self.train, self.k, self.classes = train, k, classes

    def transform(self, df: DataFrame) -> DataFrame:
        marked = df.withColumn("_id", F.col("_row_id").cast("string"))
        queries = marked.select(F.col("_id").alias("id"), vector_to_array("features").alias("x"))
        donors = self.train.select(F.col("_row_id").cast("string").alias("id"), vector_to_array("features").alias("x"), F.col("label").alias("_y"))
        near = nearest(queries, donors.select("id", "x"), self.k)
        # All rows are on both sides of these joins; sizes are taken from files, which may be far smaller than the rows, so broadcasts are ruled out.
        voted = near.join(donors.select(F.col("id").alias("did"), "_y").hint("merge"), "did")
        if self.classes is None:
            result = voted.groupBy("qid").agg(F.avg("_y").alias("prediction"))
        else:
            shares = [F.avg((F.col("_y") == c).cast("double")).alias(f"_p{i}") for i, c in enumerate(self.classes)]
            names = [F.col(f"_p{i}") for i in range(len(self.classes))]
            result = voted.groupBy("qid").agg(*shares).withColumn("probability", F.array(*names))
            at = F.array_position(F.col("probability"), F.array_max("probability")).cast("int") - 1
            result = result.withColumn("prediction", F.array(*[F.lit(c) for c in self.classes])[at]).select("qid", "prediction", "probability")
        return marked.join(result.hint("merge"), F.col("_id") == F.col("qid")).drop("_id", "qid")
