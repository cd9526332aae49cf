"""Table and column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from plumbline.functions import columns as C
from plumbline.plans.frames import distinct_upto, rows_frame
from plumbline.plans.profiling import Profile, profiled
from plumbline.plans.quantiles import exact_quantiles
from plumbline.plans.ranks import cumulative

Table = DataFrame | Profile


def pct(part: float, whole: float) -> float:
    return 100.0 * part / whole if whole else 0.0


def table_summary(data: Table) -> DataFrame:
    p = profiled(data)
    return rows_frame(p.spark, [{
        "rows": p.rows, "columns": len(p.columns), "numeric_columns": len(p.numeric),
        "other_columns": len(p.columns) - len(p.numeric), "duplicate_rows": p.duplicates,
        "missing_cells": p.missing_cells, "missing_pct": p.missing_pct, "outlier_total": p.outlier_total,
    }], "rows long, columns int, numeric_columns int, other_columns int, duplicate_rows long, "
        "missing_cells long, missing_pct double, outlier_total long")


def column_profile(data: Table, approx: bool = False) -> DataFrame:
    """One row per column: type, distinct values, missing cells and semantic type."""
    p = profiled(data)
    if approx:
        row = p.df.agg(*[F.approx_count_distinct(C.quoted(c)).alias(f"d{i}") for i, c in enumerate(p.columns)]).first()
        distinct = dict(zip(p.columns, row))
    else:
        distinct = p.distinct
    kinds = dict(p.df.dtypes)
    rows = []
    for c in p.columns:
        d = distinct.get(c)
        if c in p.datetime:
            kind = "datetime"
        elif c in p.numeric:
            kind = "identifier" if d == p.rows > 0 else "categorical_numeric" if d <= 10 else "continuous"
        else:
            kind = "categorical"
        rows.append({
            "column": c, "dtype": kinds[c], "distinct_values": d,
            "distinct_pct": None if d is None else pct(d, max(p.rows, 1)),
            "missing": p.missing[c], "missing_pct": pct(p.missing[c], max(p.rows, 1)), "semantic_type": kind,
        })
    return rows_frame(p.spark, rows, "column string, dtype string, distinct_values long, distinct_pct double, "
                      "missing long, missing_pct double, semantic_type string")


def type_counts(data: Table) -> DataFrame:
    p = profiled(data)
    kinds = [t for _, t in p.df.dtypes]
    rows = [{"dtype": k, "columns": kinds.count(k)} for k in sorted(set(kinds))]
    return rows_frame(p.spark, rows, "dtype string, columns int")


def missing_by_column(data: Table, only_missing: bool = True) -> DataFrame:
    p = profiled(data)
    rows = [{"column": c, "missing": m, "missing_pct": pct(m, p.rows)}
            for c, m in p.missing.items() if m or not only_missing]
    rows.sort(key=lambda r: (-r["missing"], r["column"]))
    return rows_frame(p.spark, rows, "column string, missing long, missing_pct double")


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without any null, and their share."""
    whole = ~_any([C.is_null(df, c) for c in df.columns])
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(whole).alias("complete_rows"),
        F.avg(whole.cast("double")).alias("complete_share"),
    )


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def describe_numeric(data: Table) -> DataFrame:
    p = profiled(data)
    rows = []
    for c in p.numeric:
        m, q = p.moments[c], p.quartiles.get(c, (None, None, None))
        rows.append({"column": c, "count": m["n"], "mean": m["mean"], "std": m["std"], "min": m["min"],
                     "q25": q[0], "q50": q[1], "q75": q[2], "max": m["max"]})
    return rows_frame(p.spark, rows, "column string, count long, mean double, std double, min double, "
                      "q25 double, q50 double, q75 double, max double")


def distribution_summary(data: Table) -> DataFrame:
    """Distinct count, skewness, excess kurtosis and coefficient of variation per column."""
    p = profiled(data)
    rows = []
    for c in p.filled:
        m = p.moments[c]
        rows.append({"column": c, "distinct_values": p.distinct[c], "mean": m["mean"], "median": p.quartiles[c][1],
                     "std": m["std"], "min": m["min"], "max": m["max"], "skew": m["skew"],
                     "kurtosis": m["kurt"], "cv_pct": pct(m["std"], m["mean"]) if m["mean"] and m["std"] is not None else 0.0})
    return rows_frame(p.spark, rows, "column string, distinct_values long, mean double, median double, std double, "
                      "min double, max double, skew double, kurtosis double, cv_pct double")


def trend_label(skew: float) -> str:
    return "symmetric" if abs(skew) < 0.5 else "right-skewed" if skew > 0 else "left-skewed"


NUMERIC_STATS = (
    "column string, mean double, median double, std double, min double, max double, q1 double, q3 double, "
    "outliers long, outlier_pct double, skew double, trend string, cv_pct double"
)


def numeric_stats(data: Table, moments: str = "sample") -> DataFrame:
    """Centre, spread, shape and outliers of every numeric column.

    ``moments='population'`` uses population moments and the order statistics at
    the floored index in place of interpolated quartiles.
    """
    p = profiled(data)
    if moments == "population":
        return _population_stats(p)
    rows = []
    for c in p.filled:
        m, (q1, q2, q3) = p.moments[c], p.quartiles[c]
        std = m["std"] or 0.0
        rows.append({
            "column": c, "mean": m["mean"], "median": q2, "std": std, "min": m["min"], "max": m["max"],
            "q1": q1, "q3": q3, "outliers": p.outliers[c]["n"], "outlier_pct": pct(p.outliers[c]["n"], p.rows),
            "skew": m["skew"], "trend": trend_label(m["skew"]), "cv_pct": pct(std, m["mean"]) if m["mean"] else 0.0,
        })
    return rows_frame(p.spark, rows, NUMERIC_STATS)


def _population_stats(p: Profile) -> DataFrame:
    spots: dict[str, list[float]] = {}
    for n in {p.moments[c]["n"] for c in p.filled}:
        same = [c for c in p.filled if p.moments[c]["n"] == n]
        probs = [min(int(n * q), n - 1) / max(n - 1, 1) for q in (0.25, 0.5, 0.75)]
        spots.update(exact_quantiles(p.df, same, probs, rows=p.rows))
    aggs = []
    for i, c in enumerate(p.filled):
        x, (q1, _, q3) = p.number(c), spots[c]
        aggs.append(F.count_if((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).alias(f"o{i}"))
    out = p.df.agg(*aggs).first() if aggs else []
    rows = [{
        "column": c, "count": p.moments[c]["n"], "mean": p.moments[c]["mean"], "median": spots[c][1],
        "std": p.moments[c]["std_pop"], "min": p.moments[c]["min"], "max": p.moments[c]["max"],
        "q1": spots[c][0], "q3": spots[c][2], "outliers": out[i],
        "skew": p.moments[c]["skew_pop"], "kurtosis": p.moments[c]["kurt_pop"],
    } for i, c in enumerate(p.filled)]
    return rows_frame(p.spark, rows, "column string, count long, mean double, median double, std double, min double, "
                      "max double, q1 double, q3 double, outliers long, skew double, kurtosis double")


def histogram(data: Table, col: str, bins: int = 10, by: str | None = None) -> DataFrame:
    """Equal-width bins over the whole range; at most as many bins as distinct values."""
    p = profiled(data)
    m = p.moments[col]
    if not m["n"]:
        return rows_frame(p.spark, [], "bin int, low double, high double, n long")
    x = p.number(col)
    # The number of distinct values matters only below the requested bins.
    k = max(1, distinct_upto(p.df, {col: x}, bins)[col])
    lo, hi = (m["min"] - 0.5, m["max"] + 0.5) if m["min"] == m["max"] else (m["min"], m["max"])
    edges = [lo + (hi - lo) * i / k for i in range(k + 1)]
    edges[-1] = hi
    frame = rows_frame(p.spark, [{"bin": i, "low": edges[i], "high": edges[i + 1]} for i in range(k)],
                       "bin int, low double, high double")
    number = C.equal_width_bin(x, m["min"], m["max"], k).alias("bin")
    if by is None:
        counts = p.df.select(number).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
        return frame.join(counts, "bin", "left").fillna(0, ["n"])
    base = p.df.select(C.quoted(by).cast("string").alias("class"), number).where("bin is not null and class is not null")
    counts = base.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(frame), "bin").select("class", "bin", "low", "high", "n")


def modality(data: Table) -> DataFrame:
    """Unimodal or multimodal by interior peaks of a histogram of at most 30 bins."""
    p = profiled(data)
    few = distinct_upto(p.df, {c: p.number(c) for c in p.filled}, 30) if p.filled else {}
    wide = {c: k for c, k in few.items() if k >= 20}
    shapes = p.histograms(wide)
    rows = []
    for c in p.filled:
        n = shapes.get(c)
        if n is None:
            label, peaks = "categorical-like", None
        else:
            peaks = sum(n[i] > n[i - 1] and n[i] > n[i + 1] for i in range(1, len(n) - 1))
            label = "multimodal" if peaks > 1 else "unimodal"
        rows.append({"column": c, "peaks": peaks, "modality": label})
    return rows_frame(p.spark, rows, "column string, peaks int, modality string")


def outlier_report(data: Table) -> DataFrame:
    p = profiled(data)
    rows = [{
        "column": c, "outliers": p.outliers[c]["n"], "outlier_pct": pct(p.outliers[c]["n"], p.rows),
        "lower_bound": p.fences[c][0], "upper_bound": p.fences[c][1],
    } for c in p.filled if p.outliers[c]["n"]]
    return rows_frame(p.spark, rows, "column string, outliers long, outlier_pct double, lower_bound double, upper_bound double")


def outlier_impact(data: Table) -> DataFrame:
    """How far mean and std move when the values outside the fences are left out."""
    p = profiled(data)
    rows = []
    for c in p.filled:
        o, m = p.outliers[c], p.moments[c]
        if not o["n"]:
            continue
        shift = abs(m["mean"] - o["mean_inside"])
        rows.append({
            "column": c, "outliers": o["n"], "outlier_pct": pct(o["n"], m["n"]), "mean_impact": shift,
            "std_impact": abs(m["std"] - o["std_inside"]) if o["std_inside"] is not None else None,
            "severity": "high" if shift > 0.1 * m["std"] else "low",
        })
    return rows_frame(p.spark, rows, "column string, outliers long, outlier_pct double, mean_impact double, "
                      "std_impact double, severity string")


def robust_stats(data: Table, trim: float = 0.1) -> DataFrame:
    """Median, median absolute deviation, interquartile range and trimmed mean.

    The trimmed mean needs no ranking: the two order statistics at the cut are found
    first, then one aggregate sums the values between them and counts the ties.
    """
    p = profiled(data)
    cols = p.filled
    if not cols:
        return rows_frame(p.spark, [], "column string, median double, mad double, iqr double, trimmed_mean double")
    away = p.df.select(*[F.abs(p.number(c) - p.quartiles[c][1]).alias(f"d{i}") for i, c in enumerate(cols)])
    mads = exact_quantiles(away, away.columns, [0.5], rows=p.rows)
    cut: dict[str, tuple] = {}
    for n in {p.moments[c]["n"] for c in cols}:
        k = int(trim * n)
        same = [c for c in cols if p.moments[c]["n"] == n]
        got = exact_quantiles(p.df, same, [k / max(n - 1, 1), (n - 1 - k) / max(n - 1, 1)], rows=p.rows)
        cut.update({c: (*got[c], k) for c in same})
    aggs = []
    for i, c in enumerate(cols):
        x, (lo, hi, _) = p.number(c), cut[c]
        aggs.append(F.struct(
            F.sum(F.when((x > lo) & (x < hi), x)).alias("mid"), F.count_if(x <= lo).alias("low"),
            F.count_if(x < hi).alias("below"),
        ).alias(f"t{i}"))
    got = p.df.agg(*aggs).first()
    rows = []
    for i, c in enumerate(cols):
        lo, hi, k = cut[c]
        n, t = p.moments[c]["n"], got[i]
        if lo == hi:
            mean = lo
        else:
            mean = ((t["mid"] or 0.0) + lo * (t["low"] - k) + hi * (n - k - t["below"])) / (n - 2 * k)
        q1, q2, q3 = p.quartiles[c]
        rows.append({"column": c, "median": q2, "mad": mads[f"d{i}"][0], "iqr": q3 - q1, "trimmed_mean": mean})
    return rows_frame(p.spark, rows, "column string, median double, mad double, iqr double, trimmed_mean double")


# ---- text columns -------------------------------------------------------------------------

def _by_count(*partition: str):
    return W.partitionBy(*partition).orderBy(F.col("n").desc(), F.col("value"))


def top_values(data: Table, k: int = 10, columns: list[str] | None = None) -> DataFrame:
    """The k most frequent values per text column; ties by value."""
    counts = profiled(data).value_counts(columns)
    return counts.withColumn("rank", F.row_number().over(_by_count("column"))).where(F.col("rank") <= k)


def _totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_values"),
        F.sum(F.col("n") * F.log2("n")).alias("nlogn"),
        F.max(F.struct("n", F.lit(1))).alias("_top"),
    )


def categorical_stats(data: Table, denominator: str = "non_null") -> DataFrame:
    """Distinct values, entropy and share of the most frequent value per text column."""
    p = profiled(data)
    base = F.col("total") if denominator == "non_null" else F.lit(p.rows)
    t = _totals(p.value_counts())
    return t.select(
        "column", "distinct_values",
        ((F.col("total") * F.log2(base.cast("double")) - F.col("nlogn")) / base).alias("entropy"),
        (F.lit(100.0) * F.col("_top.n") / base).alias("dominance_pct"),
    )


def entropy(data: Table) -> DataFrame:
    t = _totals(profiled(data).value_counts())
    h = F.log2("total") - F.col("nlogn") / F.col("total")
    top = F.log2(F.col("distinct_values").cast("double"))
    share = F.least(F.coalesce(F.try_divide(h, top), F.lit(0.0)), F.lit(1.0))
    return t.select(
        "column", h.alias("entropy"), top.alias("max_entropy"), share.alias("normalized_entropy"),
        F.when(share > 0.7, "balanced").otherwise("imbalanced").alias("interpretation"),
    )


def imbalance_severity(ratio: Column) -> Column:
    return (
        F.when(ratio < 2, "balanced").when(ratio < 5, "mild").when(ratio < 10, "moderate").otherwise("severe")
    )


def imbalance(data: Table, columns: list[str] | None = None) -> DataFrame:
    """Most and least frequent value of each column with at least two values."""
    counts = profiled(data).value_counts(columns)
    t = counts.groupBy("column").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("levels"),
        F.min(F.struct(-F.col("n"), "value")).alias("most"),
        F.max(F.struct(-F.col("n"), "value")).alias("least"),
    ).where("levels >= 2")
    major, minor = -F.col("most.col1"), -F.col("least.col1")
    ratio = major / minor
    return t.select(
        "column", F.col("most.value").alias("majority_class"), (100.0 * major / F.col("total")).alias("majority_pct"),
        F.col("least.value").alias("minority_class"), (100.0 * minor / F.col("total")).alias("minority_pct"),
        ratio.alias("imbalance_ratio"), imbalance_severity(ratio).alias("severity"),
    )


def rare_categories(data: Table, threshold: float = 0.01, listed: int = 10) -> DataFrame:
    """Values below the share threshold: how many, their rows, and the most frequent of them."""
    counts = profiled(data).value_counts()
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    rare = counts.join(totals, "column").where(F.col("n") / F.col("total") < threshold)
    shown = rare.withColumn("rank", F.row_number().over(_by_count("column"))).where(F.col("rank") <= listed)
    names = shown.groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]), ", ").alias("listed")
    )
    sums = rare.groupBy("column").agg(
        F.count(F.lit(1)).alias("rare_values"), (100.0 * F.sum("n") / F.max("total")).alias("rare_pct")
    )
    return sums.join(names, "column")


def concentration(data: Table) -> DataFrame:
    """Gini coefficient of the value counts and share of the five largest values.

    Ranks are taken over distinct count sizes (never more than about the square root
    of twice the row number), not over the values themselves.
    """
    counts = profiled(data).value_counts()
    sizes = counts.groupBy("column", "n").agg(F.count(F.lit(1)).alias("m"))
    w = W.partitionBy("column").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    gini = (
        sizes.withColumn("before", F.sum("m").over(w) - F.col("m"))
        .withColumn("weighted", F.col("n") * (F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2))
        .groupBy("column").agg(
            F.sum("m").alias("k"), F.sum(F.col("n") * F.col("m")).alias("total"), F.sum("weighted").alias("ranked"))
    )
    top5 = (
        counts.withColumn("rank", F.row_number().over(_by_count("column"))).where("rank <= 5")
        .groupBy("column").agg(F.sum("n").alias("top5"))
    )
    share = 100.0 * F.col("top5") / F.col("total")
    return gini.join(top5, "column").select(
        "column", (2 * F.col("ranked") / (F.col("k") * F.col("total")) - (F.col("k") + 1) / F.col("k")).alias("gini"),
        share.alias("top5_pct"),
        F.when(share > 80, "high").when(share > 50, "moderate").otherwise("low").alias("level"),
    )


def cardinality_level(ratio: float) -> str:
    for bound, label in ((0.01, "very low"), (0.1, "low"), (0.5, "medium"), (0.9, "high")):
        if ratio < bound:
            return label
    return "very high"


def cardinality(data: Table) -> DataFrame:
    p = profiled(data)
    rows = [{"column": c, "distinct_values": d, "distinct_ratio": d / p.rows if p.rows else 0.0,
             "level": cardinality_level(d / p.rows if p.rows else 0.0)} for c, d in p.distinct.items()]
    return rows_frame(p.spark, rows, "column string, distinct_values long, distinct_ratio double, level string")


def duplicate_report(data: Table) -> DataFrame:
    p = profiled(data)
    return rows_frame(p.spark, [{
        "duplicate_rows": p.duplicates, "duplicate_pct": pct(p.duplicates, p.rows), "unique_rows": p.rows - p.duplicates,
    }], "duplicate_rows long, duplicate_pct double, unique_rows long")


def table_size(df: DataFrame) -> DataFrame:
    """Bytes per column: fixed width by type, or the length of the text."""
    aggs, names = [], []
    for f in df.schema:
        kind, c = f.dataType, C.quoted(f.name)
        if isinstance(kind, C.TEXT + (T.BinaryType,)):
            size = F.octet_length(c)
        elif isinstance(kind, C.NESTED):
            size = F.octet_length(F.to_json(F.struct(c)))
        else:
            width = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}.get(kind.simpleString(), 8)
            size = F.when(c.isNotNull(), F.lit(width))
        aggs.append(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias(f"b{len(names)}"))
        names.append(f.name)
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(f"b{i}").alias("bytes")) for i, n in enumerate(names)
    ])).alias("m")).select("m.column", "m.bytes")


def missing_matrix(df: DataFrame, order_by: str, n: int = 50, mode: str = "head", rows: int | None = None) -> DataFrame:
    """0/1 null flags of the first n rows, or of every (rows / n)-th row."""
    flags = [C.is_null(df, c).cast("int").alias(c + "_null") for c in df.columns]
    if mode == "head":
        return df.orderBy(order_by).limit(n).select(C.quoted(order_by), *flags)
    rows = df.count() if rows is None else rows
    step = max(1, rows // n)
    packed = df.select(F.struct(C.quoted(order_by), *flags).alias("whole"), C.quoted(order_by).alias("at"), F.lit(1).alias("n"))
    return cumulative(packed, [], [F.col("at")], rows=rows).where(F.col("place") % step == 0).select("whole.*")
