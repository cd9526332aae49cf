"""The numbers behind charts: ranked counts, grouped summaries, samples, densities."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import columns as C
from plumbline.plans.frames import rows_frame
from plumbline.plans.profiling import profiled
from plumbline.plans.quantiles import grouped_quantiles
from plumbline.plans.ranks import cumulative
from plumbline.plans.sampling import take_per_class


def _counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(C.quoted(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value is not null")


def pareto(df: DataFrame, col: str, cutoff: float = 80.0) -> DataFrame:
    """Counts in falling order with cumulative share; ``vital`` marks values up to the cut-off."""
    counts = _counts(df, col)
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")).first()
    done = cumulative(counts, [], [F.col("n").desc(), F.col("value")], rows=total["k"])
    whole = F.lit(float(total["total"] or 1))
    return done.select(
        "value", "n", (F.col("place") + 1).alias("position"),
        (100.0 * (F.col("before") + F.col("n")) / whole).alias("cumulative_pct"),
        (100.0 * F.col("before") / whole < cutoff).alias("vital"),
    )


def top_k(df: DataFrame, col: str, k: int = 15) -> DataFrame:
    return _counts(df, col).orderBy(F.col("n").desc(), "value").limit(k)


def top_k_with_others(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The k most frequent values and one bucket for the rest."""
    top = top_k(df, col, k)
    marked = _counts(df, col).join(F.broadcast(top.select(F.col("value").alias("_top"))), F.col("value") == F.col("_top"), "left")
    return (
        marked.groupBy(F.coalesce("_top", F.lit("Others")).alias("value")).agg(F.sum("n").alias("n"))
    )


def chart_group(df: DataFrame, x: str, y: str | None, agg: str = "mean", limit: int = 20) -> DataFrame:
    """Group by a column (blank as 'Missing'), aggregate another, keep the largest groups."""
    label = C.strip(C.quoted(x).cast("string"))
    group = F.when(label.isNull() | (label == ""), "Missing").otherwise(label).alias("group")
    if agg == "count":
        value = F.count(F.lit(1)).cast("double")
    else:
        value = {"mean": F.avg, "sum": F.sum}[agg](C.as_number(df, y))
    grouped = df.groupBy(group).agg(value.alias("value"))
    return grouped.orderBy(F.col("value").desc(), "group").limit(limit)


def category_target(df: DataFrame, col: str, target: str, min_rows: int = 5, limit: int = 15) -> DataFrame:
    y = C.as_number(df, target)
    grouped = df.groupBy(C.quoted(col).alias("category")).agg(F.avg(y).alias("mean"), F.count(y).alias("n"))
    return grouped.where(F.col("category").isNotNull() & (F.col("n") >= min_rows)).orderBy(
        F.col("mean").desc(), "category").limit(limit)


def split_summary(df: DataFrame, col: str, by: str) -> DataFrame:
    """Mean and count of a column for the first two classes in sorted order."""
    x = C.as_number(df, col)
    grouped = df.where(C.quoted(by).isNotNull()).groupBy(C.quoted(by).cast("string").alias("class")).agg(
        F.avg(x).alias("mean"), F.count(x).alias("n"))
    return grouped.orderBy("class").limit(2)


def binned_mean(df: DataFrame, x: str, y: str, z: str, bins: int = 10) -> DataFrame:
    """Mean of z over an equal-width grid of x and y."""
    m = profiled(df.select(C.quoted(x), C.quoted(y))).moments
    bx = C.equal_width_bin(C.as_number(df, x), m[x]["min"], m[x]["max"], bins)
    by = C.equal_width_bin(C.as_number(df, y), m[y]["min"], m[y]["max"], bins)
    return (
        df.select(bx.alias("x_bin"), by.alias("y_bin"), C.as_number(df, z).alias("_z"))
        .where("x_bin is not null and y_bin is not null").groupBy("x_bin", "y_bin")
        .agg(F.avg("_z").alias("mean"), F.count("_z").alias("n"))
    )


def scatter_sample(df: DataFrame, cols: list[str], n: int, id_col: str, seed: int = 42) -> DataFrame:
    """n rows in an order fixed by a hash of the id, whatever the partitioning."""
    full = df.where(~F.greatest(F.lit(False), *[C.is_null(df, c) for c in cols]))
    return full.orderBy(F.xxhash64(C.quoted(id_col), F.lit(seed)), id_col).limit(n).select(id_col, *cols)


def scatter_pairs(df: DataFrame, x: str, y: str, order_by: str, n: int = 250) -> DataFrame:
    """The first n complete numeric pairs in the given order."""
    a, b = C.as_number(df, x), C.as_number(df, y)
    return df.select(C.quoted(order_by), a.alias("x"), b.alias("y")).where(
        "x is not null and y is not null").orderBy(order_by).limit(n)


def stratified_sample(df: DataFrame, target: str, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """n rows, each class in proportion (rounded), chosen by a hash of the id."""
    total = df.count()
    if total <= n:
        return df
    return take_per_class(df, target, lambda size: F.bround(n * size / total), id_col, seed)


def kde(df: DataFrame, col: str, points: int = 100, bins: int = 512) -> DataFrame:
    """Gaussian density on an even grid, Scott's bandwidth, from a fine histogram.

    The table is reduced to at most ``bins`` weighted centres, which are then joined
    with the grid: a fixed amount of work whatever the table size.
    """
    p = profiled(df)
    m = p.moments[col]
    lo, hi, n = m["min"], m["max"], m["n"]
    width = (m["std"] or 0.0) * n ** (-0.2) if n else 0.0
    if not n or width == 0.0:
        return rows_frame(p.spark, [], "x double, density double")
    step = (hi - lo) / bins
    centres = (
        p.df.select(C.equal_width_bin(p.number(col), lo, hi, bins).alias("b")).where("b is not null")
        .groupBy("b").agg(F.count(F.lit(1)).alias("w")).withColumn("c", F.lit(lo) + (F.col("b") + 0.5) * step)
    )
    grid = F.sequence(F.lit(0), F.lit(points - 1))
    scale = 1.0 / (n * width * math.sqrt(2 * math.pi))
    return (
        centres.withColumn("g", F.explode(grid))
        .withColumn("x", F.lit(lo) + F.col("g") * ((hi - lo) / (points - 1)))
        .groupBy("g").agg(
            F.max("x").alias("x"),
            (F.sum(F.col("w") * F.exp(-0.5 * F.pow((F.col("x") - F.col("c")) / width, 2))) * scale).alias("density"))
        .select("x", "density")
    )


def box_stats(df: DataFrame, by: str | None = None, col: str | None = None) -> DataFrame:
    """Quartiles, fences, mean and deviation per numeric column, or per group of one column."""
    schema = ("count long, mean double, std double, min double, q1 double, median double, q3 double, max double, "
              "lower_fence double, upper_fence double")

    def line(m: dict, q: list[float]) -> dict:
        spread = 1.5 * (q[2] - q[0])
        return {"count": m["n"], "mean": m["mean"], "std": m["std"], "min": m["min"], "q1": q[0], "median": q[1],
                "q3": q[2], "max": m["max"], "lower_fence": q[0] - spread, "upper_fence": q[2] + spread}

    if by is None:
        p = profiled(df)
        rows = [{"column": c, **line(p.moments[c], list(p.quartiles[c]))} for c in p.filled]
        return rows_frame(p.spark, rows, "column string, " + schema)
    x = C.as_number(df, col)
    groups = df.where(C.quoted(by).isNotNull() & x.isNotNull()).groupBy(C.quoted(by).cast("string").alias("g")).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    found = {r["g"]: r.asDict() for r in groups.collect()}
    cuts = grouped_quantiles(df, by, col, [0.25, 0.5, 0.75], rows=sum(m["n"] for m in found.values()))
    rows = [{"group": g, **line(m, cuts[g])} for g, m in found.items()]
    return rows_frame(df.sparkSession, rows, "group string, " + schema)
