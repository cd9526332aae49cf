"""Left lookup joins that hold up when a few keys own most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted

BROADCAST_KEYS = 50_000
HOT_SHARE = 1_000
SPREAD = 1_024


def lookup_join(
    df: DataFrame, lookup: DataFrame, key: str, values: list[str],
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """Attach ``values`` of ``lookup`` (columns: key, n, values) to every row of ``df``.

    ``n`` is the row count of the key in the fitted data. A lookup of few keys is
    broadcast. Otherwise the keys above one thousandth of all rows (so at most a
    thousand) are broadcast and the rest is joined by shuffle; rows that are served
    by the broadcast, and rows with a null key, are spread over salts they alone use.
    """
    size = lookup.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")).first()
    renamed = lookup.select(
        quoted(key).alias("_key"), F.col("n").alias("_n"),
        *[quoted(v).alias(f"_v{i}") for i, v in enumerate(values)],
    )
    if size["keys"] <= broadcast_keys:
        joined = df.join(F.broadcast(renamed.drop("_n")), quoted(key) == F.col("_key"), "left")
        return joined.select(*[quoted(c) for c in df.columns], *[
            F.col(f"_v{i}").alias(v) for i, v in enumerate(values)
        ])
    limit = size["rows"] / HOT_SHARE
    hot = renamed.where(F.col("_n") > limit).drop("_n").select(
        F.col("_key").alias("_hot"), *[F.col(f"_v{i}").alias(f"_h{i}") for i in range(len(values))]
    )
    cold = renamed.where(F.col("_n") <= limit).drop("_n").withColumn("_salt", F.lit(0))
    marked = df.join(F.broadcast(hot), quoted(key) == F.col("_hot"), "left").withColumn(
        "_row_salt",
        F.when(
            F.col("_hot").isNotNull() | quoted(key).isNull(),
            1 + F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int"),
        ).otherwise(F.lit(0)),
    )
    joined = marked.join(
        cold, (quoted(key) == F.col("_key")) & (F.col("_row_salt") == F.col("_salt")), "left"
    )
    return joined.select(*[quoted(c) for c in df.columns], *[
        F.coalesce(F.col(f"_h{i}"), F.col(f"_v{i}")).alias(v) for i, v in enumerate(values)
    ])
