"""Many time series at once: one group per key, aggregated to regular buckets first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import columns as C
from plumbline.functions.arima import fit_arima


def _key(keys: list[str]):
    """One text per combination of key values: a single key as it is, several joined by ``|`` with ``|`` and
    ``\\`` inside a value escaped; a null among several is ``\\N``."""
    if not keys:
        return F.lit("all")
    texts = [C.quoted(k).cast("string") for k in keys]
    if len(texts) == 1:
        return texts[0]
    safe = [F.coalesce(F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\\N")) for t in texts]
    return F.concat_ws("|", *safe)


def prepare_series(df: DataFrame, ts: str, value: str, keys: list[str] | None = None, min_rows: int = 20) -> DataFrame:
    """(key, ts, value) without nulls, only series of at least ``min_rows`` observations."""
    rows = df.select(_key(keys or []).alias("key"), C.quoted(ts).cast("timestamp_ntz").alias("ts"),
                     C.as_number(df, value).alias("value")).dropna()
    if not keys:
        long = rows.limit(min_rows).count() >= min_rows
        return rows if long else rows.where(F.lit(False))
    long_enough = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows).select("key")
    return rows.join(long_enough, "key", "left_semi")


def frequency_hint(series: DataFrame, stamps: int = 50) -> DataFrame:
    """Most common gap in seconds among the first stamps of each series."""
    w = W.partitionBy("key").orderBy("ts")
    # row_number under a bound is cut per task before the shuffle
    first = series.select("key", "ts").distinct().withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= stamps)
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(w).cast("timestamp"))
    gaps = first.withColumn("gap", seconds).where("gap is not null").groupBy("key", "gap").agg(F.count(F.lit(1)).alias("n"))
    return gaps.groupBy("key").agg(F.min(F.struct(-F.col("n"), "gap")).alias("best")).select(
        "key", F.col("best.gap").alias("gap_seconds"))


def regular_buckets(series: DataFrame, unit: str = "day") -> DataFrame:
    """Mean per key and calendar unit: a series is then no longer than its calendar."""
    return series.groupBy("key", F.date_trunc(unit, "ts").alias("bucket")).agg(F.avg("value").alias("value"))


FORECAST = "key string, step int, ts timestamp_ntz, forecast double, sigma2 double, loglik double, aic double, bic double, fitted string"


def forecast(
    df: DataFrame, ts: str, value: str, keys: list[str] | None = None, order: tuple[int, int, int] = (1, 1, 1),
    steps: int = 12, seasonal_order: tuple[int, int, int, int] | None = None, unit: str = "day", min_rows: int = 20, evaluations: int = 400,
) -> DataFrame:
    """ARIMA or seasonal ARIMA per series by exact maximum likelihood.

    Rows are averaged per calendar unit before they are grouped, so the largest group
    holds one row per unit however many observations the series has. Units without rows are
    missing values of the model. ``fitted`` names the order, which is the one asked for; a series too short for it has one row
    with step 0, no forecast, and the reason there. ``evaluations`` bounds the search for the coefficients.
    """
    steps = min(60, max(3, steps))
    buckets = regular_buckets(prepare_series(df, ts, value, keys, min_rows), unit)
    pandas_unit = {"minute": "min", "hour": "h", "day": "D", "week": "W-MON", "month": "MS"}[unit]
    asked = f"ARIMA{tuple(order)}" + (f"{tuple(seasonal_order)}" if seasonal_order else "")

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        y = g.set_index("bucket")["value"].sort_index().asfreq(pandas_unit)
        empty = pd.Series([None], dtype=float)
        try:
            got = fit_arima(y.to_numpy(dtype=float), order, seasonal_order, steps, evaluations)
        except ValueError as reason:
            return pd.DataFrame({"key": g["key"].iloc[0], "step": [0], "ts": [pd.NaT], "forecast": empty, "sigma2": empty, "loglik": empty, "aic": empty, "bic": empty, "fitted": [str(reason)]})
        stamps = pd.date_range(y.index[-1], periods=steps + 1, freq=pandas_unit)[1:]
        return pd.DataFrame({"key": g["key"].iloc[0], "step": range(1, steps + 1), "ts": stamps, "forecast": got.forecast, "sigma2": got.sigma2, "loglik": got.loglik,
                             "aic": got.aic, "bic": got.bic, "fitted": asked})

    return buckets.select("key", F.col("bucket").cast("timestamp_ntz"), "value").groupBy("key").applyInPandas(fit, FORECAST)


def align_forecasts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two forecasts side by side, matched on key and step."""
    left = a.where("step > 0").select("key", "step", F.col("forecast").alias("forecast_a"))
    right = b.where("step > 0").select("key", "step", F.col("forecast").alias("forecast_b"))
    return left.join(right, ["key", "step"], "full")
