"""Joins, label attachment and value mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.plans.frames import rows_frame
from plumbline.plans.lookups import lookup_join


def merge(df: DataFrame, other: DataFrame, on: list[str], how: str = "inner", null_keys_match: bool = True) -> DataFrame:
    """Equi-join on shared column names; null keys meet each other unless told otherwise.

    The join strategy is left to the optimizer, which broadcasts by measured size and
    splits skewed partitions at run time.
    """
    if how == "cross":
        return df.crossJoin(other)
    C.require_columns(df, on)
    C.require_columns(other, on)
    if not null_keys_match:
        return df.join(other, on, {"outer": "full"}.get(how, how))
    left, right = df.alias("l"), other.alias("r")
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    joined = left.join(right, condition, {"outer": "full"}.get(how, how))
    keys = [F.coalesce(F.col(f"l.`{c}`"), F.col(f"r.`{c}`")).alias(c) for c in on]
    rest = [F.col(f"l.`{c}`") for c in df.columns if c not in on]
    clash = set(df.columns)
    rest += [F.col(f"r.`{c}`").alias(c + "_other" if c in clash else c) for c in other.columns if c not in on]
    return joined.select(*keys, *rest)


def attach_labels(df: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Left join of per-row labels; rows without a label get null."""
    return df.join(labels, id_col, "left")


def map_values(df: DataFrame, mapping: DataFrame, col: str, into: str, default: float = 0.0) -> DataFrame:
    """Replace values by a (value, n, code) table; values outside it get the default."""
    named = mapping.select(F.col("value").alias(col), "n", F.col("code").alias(into))
    return lookup_join(df, named, col, [into]).withColumn(into, F.coalesce(F.col(into), F.lit(default)))


def infer_roles(df: DataFrame, numeric_ratio: float = 0.9, date_ratio: float = 0.75, max_categories: int = 20) -> DataFrame:
    """numeric, date, categorical or text per column, from how many present values parse."""
    cols = [f.name for f in df.schema if not isinstance(f.dataType, C.NESTED)]
    dates, numbers = C.datetime_columns(df), C.numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        present = ~C.is_missing(df, c)
        aggs.append(F.count_if(present).alias(f"n{i}"))
        aggs.append(F.count_distinct(F.when(present, C.quoted(c))).alias(f"d{i}"))
        if c not in dates:
            aggs.append(F.count(C.as_number(df, c)).alias(f"x{i}"))
        if c not in dates + numbers:
            aggs.append(F.count(C.strip(C.quoted(c).cast("string")).try_cast("timestamp")).alias(f"t{i}"))
    row = df.agg(*aggs).first().asDict()
    rows = []
    for i, c in enumerate(cols):
        n, d = row[f"n{i}"], row[f"d{i}"]
        number = row.get(f"x{i}", 0) / n if n else 0.0
        date = 1.0 if c in dates and n else row.get(f"t{i}", 0) / n if n else 0.0
        if number >= numeric_ratio:
            role = "numeric"
        elif date >= date_ratio:
            role = "date"
        else:
            role = "categorical" if d <= max_categories else "text"
        rows.append({"column": c, "numeric_share": number, "date_share": date, "distinct_values": d, "role": role,
                     "likely_categorical": role != "numeric" or d <= max_categories})
    return rows_frame(df.sparkSession, rows, "column string, numeric_share double, date_share double, "
                      "distinct_values long, role string, likely_categorical boolean")
