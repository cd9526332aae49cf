"""Small result frames, lineage cuts and split helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType


def rows_frame(spark: SparkSession, rows: list[dict], schema: str | StructType) -> DataFrame:
    """A tidy result of a few rows per column, pair or test of the profiled table."""
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    casts = {DoubleType: float, LongType: int, IntegerType: int}

    def plain(value, kind):
        cast = casts.get(type(kind))
        return value if value is None or cast is None else cast(value)

    return spark.createDataFrame([tuple(plain(r.get(f.name), f.dataType) for f in struct) for r in rows], struct)


def chunks(items: list, size: int = 50) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Where it is not set a local folder is made, which suits a single-machine test
    session only.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def hash_share(*cols, seed: int = 42) -> Column:
    """Uniform number in [0, 1) fixed by the given columns and seed."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def distinct_upto(df: DataFrame, values: dict[str, Column], limit: int) -> dict[str, int]:
    """Distinct non-null values of several expressions, counted no further than ``limit``.

    A sketch tells columns with clearly more values apart in one scan without a shuffle.
    Only the others are counted exactly, and those fold to few rows before their shuffle.
    """
    row = df.agg(*[F.approx_count_distinct(v).alias(f"d{i}") for i, v in enumerate(values.values())]).first()
    found = {}
    for (name, v), rough in zip(values.items(), row):
        if rough > 4 * limit + 10:
            found[name] = limit
        else:
            found[name] = df.where(v.isNotNull()).select(v.alias("v")).distinct().limit(limit).count()
    return found
