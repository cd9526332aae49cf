"""Samples and splits by hash: the same rows whatever the partitioning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.columns import quoted
from plumbline.plans.frames import cut_lineage, hash_share
from plumbline.plans.lookups import lookup_join

NULL_CLASS = "\u0000null"
#: Slices of the hash range that are counted per class.
BUCKETS = 4_096
#: Helper columns, named so that no table has them.
CLASS, SHARE, CUT, TAKEN = "__plumb_class", "__plumb_share", "__plumb_cut", "_taken"


def mark_per_class(
    df: DataFrame, target: str | None, take: Callable[[Column], Column | int], id_col: str, seed: int = 42
) -> DataFrame:
    """Add ``_taken``: true for the ``take(size)`` rows of each class with the smallest hash.

    ``take`` maps the column of class sizes to the wanted numbers. Counts per class and slice of the
    hash range tell the slice that holds the cut; only the rows of that slice are ranked. So no class
    is sorted in one task, any number of classes will do, nothing is collected, and
    the sizes are exact as long as ids are unique.
    """
    label = F.lit("all") if target is None else F.coalesce(quoted(target).cast("string"), F.lit(NULL_CLASS))
    marked = df.withColumn(CLASS, label).withColumn(SHARE, hash_share(quoted(id_col), seed=seed))
    plain = marked.select(F.col(CLASS), F.col(SHARE), F.floor(F.col(SHARE) * BUCKETS).cast("int").alias("slice"))
    counts = plain.groupBy(CLASS, "slice").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(CLASS).agg(F.sum("n").alias("size"))
    wanted = take(F.col("size"))
    wanted = F.lit(wanted) if isinstance(wanted, int) else wanted
    want = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), wanted.cast("bigint")))
    upto = F.sum("n").over(W.partitionBy(CLASS).orderBy("slice"))
    found = counts.withColumn("upto", upto).join(sizes.withColumn("want", want), CLASS).where(
        (F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
    edges = cut_lineage(found.select(
        CLASS, F.col("size").alias("n"), "slice", (F.col("want") - F.col("upto") + F.col("n")).alias("rest"), (F.col("want") == F.col("size")).alias("whole")))
    near = lookup_join(plain.withColumnRenamed("slice", "own"), edges.where("not whole"), CLASS, ["slice", "rest"]).where("own = slice")
    place = F.row_number().over(W.partitionBy(CLASS).orderBy(SHARE))
    inner = near.withColumn("place", place).where("place = rest").select(CLASS, F.col(SHARE).alias(CUT))
    cuts = cut_lineage(edges.join(inner, CLASS, "left").select(CLASS, "n", F.when(F.col("whole"), F.lit(2.0)).otherwise(F.col(CUT)).alias(CUT)))
    joined = lookup_join(marked, cuts, CLASS, [CUT])
    return joined.withColumn(TAKEN, F.coalesce(F.col(SHARE) <= F.col(CUT), F.lit(False))).drop(CLASS, SHARE, CUT)


def take_per_class(df: DataFrame, target: str | None, take: Callable[[Column], Column | int], id_col: str, seed: int = 42) -> DataFrame:
    return mark_per_class(df, target, take, id_col, seed).where(TAKEN).drop(TAKEN)
