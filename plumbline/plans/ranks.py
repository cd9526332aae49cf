"""Cumulative counts over value-count tables, without one task seeing a whole column.

``counts`` holds one row per distinct value (so ties and hot values are already
folded). Small tables use one window. Larger ones are range-sorted, written to the
checkpoint folder so that the split points stay fixed, and numbered per partition
with partition offsets added afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.plans.frames import cut_lineage

WINDOW_ROWS = 2_000_000


def cumulative(
    counts: DataFrame, keys: list[str], order: list[Column], weights: tuple[str, ...] = ("n",),
    rows: int | None = None, window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add ``before``: the summed ``n`` of earlier rows of the same key (``before_x`` for a
    further weight x); and ``place``: how many earlier rows there are.
    """
    names = {w: "before" if w == "n" else f"before_{w}" for w in weights}
    if (counts.count() if rows is None else rows) <= window_rows:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        added = {names[x]: F.sum(x).over(w) - F.col(x) for x in weights}
        return counts.withColumns({**added, "place": F.count(F.lit(1)).over(w) - 1})
    ordered = cut_lineage(counts.orderBy(*keys, *order)).withColumn("_part", F.spark_partition_id())
    local = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = {f"_sum{i}": F.sum(x).over(local) - F.col(x) for i, x in enumerate(weights)}
    numbered = ordered.withColumns({**inside, "_row": F.count(F.lit(1)).over(local) - 1})
    # One row per (partition, key) pair that meets: at most partitions + keys rows.
    totals = ordered.groupBy("_part", *keys).agg(
        F.count(F.lit(1)).alias("_c"), *[F.sum(x).alias(f"_w{i}") for i, x in enumerate(weights)])
    across = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = totals.select(
        "_part", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_c").over(across), zero).alias("_c0"),
        *[F.coalesce(F.sum(f"_w{i}").over(across), zero).alias(f"_o{i}") for i in range(len(weights))],
    ).withColumnRenamed("_part", "_at")
    match = F.col("_part") == F.col("_at")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    done = numbered.join(offsets, match)
    added = {names[x]: F.col(f"_sum{i}") + F.col(f"_o{i}") for i, x in enumerate(weights)}
    done = done.withColumns({**added, "place": F.col("_row") + F.col("_c0")})
    return done.select(*counts.columns, *names.values(), "place")


def value_counts(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, x, n) with nulls left out."""
    return (
        df.select(key.alias("key"), value.alias("x")).where("x is not null")
        .groupBy("key", "x").agg(F.count(F.lit(1)).alias("n"))
    )


def average_rank(before: Column, n: Column) -> Column:
    """Mean 1-based rank of ``n`` tied rows that follow ``before`` smaller ones."""
    return before + (n + 1) / F.lit(2.0)
