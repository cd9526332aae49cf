"""Exact agglomerative clustering by Ward's criterion, in parallel rounds.

Merging two clusters raises the sum of squares by n m / (n + m) times the squared distance of their centres. Under this criterion no
merge brings anyone closer together than the two were, so every pair that are each other's nearest may be merged
at once: the tree is the one that merging the cheapest pair each time gives. The last few are merged in the driver.

A round cuts space into boxes and merges within each, pair after pair, as long as nothing beyond the walls can be cheaper for
either of the two: the distance to the nearest wall and the least size of a cluster bound that price from below, and the centre of a
merged cluster stays in the box. What is left lies near walls, and the next round has others.

Where that merges too few (many columns: most clusters are near a wall) a round finds the nearest cluster of each one and merges the
mutual pairs, typically a third of the clusters. The nearest cluster is searched for among groups around sampled pivots: first within the own block, then in
the groups that may hold a cheaper one, by the triangle inequality and the least size in the group. Nothing but the best of a block is returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.frames import cut_lineage, hash_share

#: Clusters merged in the driver, pivots, members of a block. They shape the work and not the result.
DRIVER_CLUSTERS, PIVOTS, BLOCK = 2_000, 1_024, 20_000
PAIRS_AT_ONCE = 2_000_000
#: Clusters of a box, of the smallest boxes within one, and as many as are compared with each other in one box; sampled rows for the walls.
BOX, LEAF, COMPARED, WALL_SAMPLE = 20_000, 512, 4_096, 20_000
#: A round in boxes that merges a smaller share than this is followed by one over all of space.
WORTH = 0.2
MERGE = "a bigint, b bigint, height double, round int"


def raises(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What merging each of (n, x) with each of (m, y) adds to the sum of squares; the same from either side."""
    gap = x[:, None, :] - y[None, :, :]
    return (n[:, None] * m[None, :] / (n[:, None] + m[None, :])) * (gap * gap).sum(axis=2)


def cheapest(ids: np.ndarray, n: np.ndarray, x: np.ndarray, others: np.ndarray, m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster the cheapest other one and the price (inf: none). Ties go to the smaller pair of ids, so that
    the cheapest pair of all is mutual."""
    best, price = np.full(len(ids), -1, np.int64), np.full(len(ids), np.inf)
    order = np.argsort(others, kind="stable")
    others, m, y = others[order], m[order], y[order]
    step = max(1, PAIRS_AT_ONCE // max(1, y.size))
    for at in range(0, len(ids), step):
        part = slice(at, at + step)
        cost = raises(n[part], x[part], m, y)
        cost[ids[part][:, None] == others[None, :]] = np.inf
        # Pairs of one cluster are ordered by the other's id, whichever of the two is smaller.
        first = cost.argmin(axis=1)
        price[part], best[part] = cost[np.arange(len(cost)), first], others[first]
    best[~np.isfinite(price)] = -1
    return best, price


def parted(x: np.ndarray, share: float = 0.5) -> tuple[int, float] | None:
    """Axis and place of a wall halfway between two neighbouring values, about ``share`` of the rows below; none if all rows are equal."""
    axis = int((x.max(axis=0) - x.min(axis=0)).argmax())
    values = np.sort(x[:, axis])
    if values[0] == values[-1]:
        return None
    at = values[min(int(share * len(values)), len(values) - 1)]
    i = int(np.searchsorted(values, at, "left")) or int(np.searchsorted(values, at, "right"))
    wall = values[i - 1] + (values[i] - values[i - 1]) / 2
    return axis, float(wall if wall > values[i - 1] else values[i])


def box_walls(sample: np.ndarray, boxes: int, seed: int) -> tuple[list[tuple], list[tuple[np.ndarray, np.ndarray]]]:
    """A tree of walls (axis, place, child below, child above; children under zero are boxes) and the sides of the boxes."""
    rng, tree, sides = np.random.default_rng(seed), [], []
    d = sample.shape[1]

    def cut(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, many: int) -> int:
        found = parted(x, rng.uniform(0.35, 0.65)) if many > 1 and len(x) > 1 else None
        if found is None:
            sides.append((lo, hi))
            return -len(sides)
        axis, wall = found
        at, low, high = len(tree), hi.copy(), lo.copy()
        low[axis] = high[axis] = wall
        tree.append(None)
        left = x[:, axis] < wall
        tree[at] = (axis, wall, cut(x[left], lo, low, many // 2), cut(x[~left], high, hi, many - many // 2))
        return at

    cut(sample, np.full(d, -np.inf), np.full(d, np.inf), boxes)
    return tree, sides


def box_of(x: np.ndarray, tree: list[tuple]) -> np.ndarray:
    out = np.zeros(len(x), np.int32)
    todo = [(0, np.arange(len(x)))] if tree else []
    while todo:
        at, rows = todo.pop()
        axis, wall, low, high = tree[at]
        left = x[rows, axis] < wall
        for child, part in ((low, rows[left]), (high, rows[~left])):
            if child < 0:
                out[part] = -child - 1
            elif len(part):
                todo.append((child, part))
    return out


def merge_inside(ids: np.ndarray, n: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: float, begin: int, merges: list[tuple]) -> tuple:
    """What is left (ids, n, x, next step) of the clusters of a box when all pairs are merged for which no cluster outside, of size ``least`` or more,
    can be cheaper. Halves come first, each with a wall between them; so few are compared with few."""
    step = begin
    wall = parted(x) if len(ids) > LEAF else None
    if wall is not None:
        axis, place = wall
        left, low, high = x[:, axis] < place, hi.copy(), lo.copy()
        low[axis] = high[axis] = place
        below = merge_inside(ids[left], n[left], x[left], lo, low, least, begin, merges)
        above = merge_inside(ids[~left], n[~left], x[~left], high, hi, least, begin, merges)
        ids, n, x = (np.concatenate(pair) for pair in zip(below[:3], above[:3]))
        step = max(below[3], above[3])
    if not 1 < len(ids) <= COMPARED:
        return ids, n, x, step
    order = np.argsort(ids)
    ids, n, x = ids[order], n[order], x[order]
    other, price = cheapest(ids, n, x, ids, n, x)
    while True:
        gap = np.minimum(x - lo, hi - x).min(axis=1).clip(0.0)
        sure = price < n * least / (n + least) * gap * gap * (1 - 1e-9)
        at = np.searchsorted(ids, other).clip(0, len(ids) - 1)
        a = np.flatnonzero(sure & sure[at] & (other[at] == ids) & (ids < other))
        if not len(a):
            return ids, n, x, step
        b = at[a]
        merges += zip(ids[a].tolist(), ids[b].tolist(), price[a].tolist(), [step] * len(a))
        step += 1
        total = n[a] + n[b]
        x[a] = (n[a, None] * x[a] + n[b, None] * x[b]) / total[:, None]
        n[a] = total
        # Merging brings no one closer, so only the merged and those whose partner merged look again.
        stale = np.zeros(len(ids), bool)
        stale[a] = stale[b] = True
        stale |= stale[at]
        keep = np.ones(len(ids), bool)
        keep[b] = False
        ids, n, x, other, price, stale = ids[keep], n[keep], x[keep], other[keep], price[keep], stale[keep]
        other[stale], price[stale] = cheapest(ids[stale], n[stale], x[stale], ids, n, x)


def merge_in_boxes(clusters: DataFrame, rows: int, least: float, turn: int, box: int = BOX) -> DataFrame:
    """The clusters left (id, n, x) and the merges (a, b, height, round) of one round in boxes, in one table."""
    boxes = -(-rows // max(1, min(box, max(2_000, rows // 64))))
    drawn = clusters.orderBy(hash_share("id", seed=100 + turn), "id").limit(min(WALL_SAMPLE, 64 * boxes)).select("x").collect()
    tree, sides = box_walls(np.array([r["x"] for r in drawn], float), boxes, turn)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                yield d.assign(g=box_of(np.stack(d["x"].to_numpy()), tree))

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = pd.concat(batches)
        merges: list[tuple] = []
        lo, hi = sides[int(d["g"].iloc[0])]
        ids, n, x, _ = merge_inside(d["id"].to_numpy(), d["n"].to_numpy().copy(), np.stack(d["x"].to_numpy()), lo, hi, least, turn, merges)
        yield pd.DataFrame({"id": ids, "n": n, "x": list(x), "a": None, "b": None, "height": None, "round": None})
        if merges:
            yield pd.DataFrame(merges, columns=["a", "b", "height", "round"]).assign(id=None, n=None, x=None)[["id", "n", "x", "a", "b", "height", "round"]]

    placed = clusters.select("id", "n", "x").mapInPandas(assign, "id bigint, n double, x array<double>, g int")
    # The number of tasks is given: the bytes are few, the work is not.
    return cut_lineage(placed.repartition(min(len(sides), 2_000), "g").groupBy("g").applyInPandas(inside, f"id bigint, n double, x array<double>, {MERGE}"))


def nearest_clusters(clusters: DataFrame, rows: int, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(id, other, height): the cheapest partner of every cluster (id, n, x)."""
    many = int(min(pivots, max(1, math.isqrt(rows))))
    centres = np.array([r["x"] for r in clusters.orderBy(hash_share("id", seed=17), "id").limit(many).select("x").collect()], float)

    def away(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((x[:, None, :] - centres[None]) ** 2).sum(axis=2), 0.0))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            step = max(1, PAIRS_AT_ONCE // centres.size)
            for at in range(0, len(d), step):
                part = d.iloc[at:at + step]
                gap = away(np.stack(part["x"].to_numpy()))
                g = gap.argmin(axis=1)
                yield part.assign(g=g, far=gap[np.arange(len(part)), g])

    placed = cut_lineage(clusters.select("id", "n", "x").mapInPandas(assign, "id bigint, n double, x array<double>, g int, far double"))
    count, reach, least = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.full(len(centres), np.inf)
    for r in placed.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.max("far").alias("far"), F.min("n").alias("n")).collect():
        count[r["g"]], reach[r["g"]], least[r["g"]] = r["c"], r["far"], r["n"]
    blocks = -(-count // block)
    wide = F.element_at(F.array(*[F.lit(int(b)) for b in np.maximum(blocks, 1)]), F.col("g") + 1)
    dealt = placed.withColumn("b", F.pmod(F.xxhash64("id"), wide).cast("int"))

    def inside(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("id")
        ids, n, x = d["id"].to_numpy(), d["n"].to_numpy(), np.stack(d["x"].to_numpy())
        other, height = cheapest(ids, n, x, ids, n, x)
        return d.assign(other=other, height=height)[["id", "n", "x", "g", "b", "other", "height"]]

    tasks = int(min(2_000, max(1, rows // 1_000)))  # given, as the bytes are few and the work is not
    own = cut_lineage(dealt.repartition(tasks, "g", "b").groupBy("g", "b").applyInPandas(inside, "id bigint, n double, x array<double>, g int, b int, other bigint, height double"))

    def elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            step = max(1, PAIRS_AT_ONCE // centres.size)
            for at in range(0, len(d), step):
                part = d.iloc[at:at + step]
                n = part["n"].to_numpy()[:, None]
                gap = np.maximum(away(np.stack(part["x"].to_numpy())) - reach, 0.0)
                with np.errstate(invalid="ignore"):
                    bound = np.where(count > 0, gap * gap * (n / (n / least[None, :] + 1)), np.inf)
                row, g = np.nonzero((bound <= part["height"].to_numpy()[:, None] * (1 + 1e-9)) & (count > 0))
                times = blocks[g]
                b = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, g = np.repeat(row, times), np.repeat(g, times)
                new = (g != part["g"].to_numpy()[row]) | (b != part["b"].to_numpy()[row])
                row, g, b = row[new], g[new], b[new]
                yield pd.DataFrame({"g": g.astype(np.int32), "b": b.astype(np.int32), "qid": part["id"].to_numpy()[row], "qn": part["n"].to_numpy()[row], "qx": part["x"].to_numpy()[row]})

    asked = own.select("id", "n", "x", "g", "b", "height").mapInPandas(elsewhere, "g int, b int, qid bigint, qn double, qx array<double>")

    def meet(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"id": pd.Series(dtype=np.int64), "other": pd.Series(dtype=np.int64), "height": pd.Series(dtype=float)})
        other, height = cheapest(q["qid"].to_numpy(), q["qn"].to_numpy(), np.stack(q["qx"].to_numpy()), d["id"].to_numpy(), d["n"].to_numpy(), np.stack(d["x"].to_numpy()))
        return pd.DataFrame({"id": q["qid"].to_numpy(), "other": other, "height": height})

    crowds = asked.withColumn("c", F.pmod(F.xxhash64("qid"), F.lit(8)).cast("int"))  # many queries at one block are dealt over copies of it
    copies = dealt.select("g", "b", "id", "n", "x").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(7))))
    found = crowds.repartition(tasks, "g", "b", "c").groupBy("g", "b", "c").cogroup(copies.repartition(tasks, "g", "b", "c").groupBy("g", "b", "c")).applyInPandas(meet, "id bigint, other bigint, height double")
    every = own.select("id", "other", "height").unionByName(found).where("other >= 0")
    return every.groupBy("id").agg(F.min(F.struct("height", "other")).alias("m")).select("id", "m.other", "m.height")


def merge_in_driver(rows: list, begin: int) -> list[tuple[int, int, float, int]]:
    """All merges of a few clusters (id, n, x), the cheapest pair first; a merged one keeps the smaller id."""
    rows = sorted(rows, key=lambda r: r["id"])
    ids, n, x = [r["id"] for r in rows], np.array([r["n"] for r in rows], float), np.array([r["x"] for r in rows], float)
    cost = raises(n, x, n, x)
    np.fill_diagonal(cost, np.inf)
    # For each row its cheapest partner; only rows whose partner changed are looked through again.
    best, out = cost.argmin(axis=1), []
    for turn in range(len(rows) - 1):
        price = cost[np.arange(len(rows)), best]
        i = int(price.argmin())
        a, b = sorted((i, int(best[i])))
        out.append((ids[a], ids[b], float(price[i]), begin + turn))
        x[a] = (n[a] * x[a] + n[b] * x[b]) / (n[a] + n[b])
        n[a] += n[b]
        cost[b], cost[:, b] = np.inf, np.inf
        open_ = np.flatnonzero(np.isfinite(cost[a]))
        if len(open_):
            cost[a, open_] = cost[open_, a] = raises(n[[a]], x[[a]], n[open_], x[open_])[0]
            for r in open_[(best[open_] == a) | (best[open_] == b)].tolist():
                best[r] = cost[r].argmin()
            cheaper = open_[cost[open_, a] < cost[open_, best[open_]]]
            best[cheaper] = a
            best[a] = cost[a].argmin()
    return out


def ward_merges(points: DataFrame, driver_clusters: int = DRIVER_CLUSTERS, pivots: int = PIVOTS, block: int = BLOCK, box: int = BOX) -> DataFrame:
    """(a, b, height, round) of all merges of the clusters (id bigint, n double, x array<double>): b goes into a."""
    clusters, turn, merges, boxed = cut_lineage(points.select("id", "n", "x")), 0, None, True
    while True:
        rows, least = clusters.agg(F.count(F.lit(1)), F.min("n")).first()
        if rows <= driver_clusters:
            last = points.sparkSession.createDataFrame(merge_in_driver(clusters.collect(), turn), MERGE)
            return last if merges is None else merges.unionByName(last)
        if boxed:
            both = merge_in_boxes(clusters, rows, least, turn, box)
            pairs, clusters = both.where("a is not null").select("a", "b", "height", "round"), both.where("id is not null").select("id", "n", "x")
            done, last_step = pairs.agg(F.count(F.lit(1)), F.max("round")).first()
            merges = pairs if merges is None else merges.unionByName(pairs)
            turn = turn + 1 if last_step is None else last_step + 1
            boxed = done >= WORTH * rows
            continue
        boxed = True
        near = cut_lineage(nearest_clusters(clusters, rows, pivots, block))
        back = near.select(F.col("id").alias("other"), F.col("other").alias("id"), F.lit(True).alias("mutual"))
        pairs = cut_lineage(near.join(back, ["id", "other"]).where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"), "height", F.lit(turn).alias("round")))
        merges = pairs if merges is None else merges.unionByName(pairs)
        target = pairs.select(F.col("b").alias("id"), F.col("a").alias("into")).unionByName(pairs.select(F.col("a").alias("id"), F.col("a").alias("into")))
        moved = clusters.join(target, "id", "left").withColumn("into", F.coalesce("into", "id"))
        both = moved.groupBy("into").agg(F.sort_array(F.collect_list(F.struct("id", "n", "x"))).alias("p"))  # one or two
        first, second, total = F.col("p")[0], F.get("p", F.lit(1)), F.col("p")[0]["n"] + F.get("p", F.lit(1))["n"]
        mean = F.zip_with(first["x"], second["x"], lambda u, v: (first["n"] * u + second["n"] * v) / total)
        clusters = cut_lineage(both.select(F.col("into").alias("id"), F.coalesce(total, first["n"]).alias("n"), F.when(F.size("p") > 1, mean).otherwise(first["x"]).alias("x")))
        turn += 1


def ward(points: DataFrame, k: int, **settings) -> DataFrame:
    """(id, cluster) of the points (id bigint, n double, x array<double>) cut into ``k`` clusters (fewer if there are fewer points),
    numbered by their smallest id. Equal prices are settled by ids."""
    merges = cut_lineage(ward_merges(points, **settings))
    # The k - 1 dearest merges are undone; a merge is never cheaper than those within it, and later where it is equal.
    cut = merges.orderBy(F.desc("height"), F.desc("round"), F.desc("a")).limit(k - 1).select("a", "b", F.lit(True).alias("cut"))
    up = cut_lineage(merges.join(cut, ["a", "b"], "left_anti").select(F.col("b").alias("id"), F.col("a").alias("up")))
    while True:  # every step halves the way to the root
        further = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
        after = cut_lineage(up.join(further, "up", "left").select("id", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        done = after.where("moved").isEmpty()
        up = after.select("id", "up")
        if done:
            break
    rooted = cut_lineage(points.select("id").join(up, "id", "left").select("id", F.coalesce("up", "id").alias("root")))
    names = sorted(r["root"] for r in rooted.select("root").distinct().collect())  # at most k
    numbered = points.sparkSession.createDataFrame([(r, i) for i, r in enumerate(names)], "root bigint, cluster int")
    return rooted.join(F.broadcast(numbered), "root").select("id", "cluster")
