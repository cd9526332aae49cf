"""Cleaning: types, text, categories, missing values, duplicates, outliers, smoothing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from plumbline.functions import columns as C
from plumbline.plans.frames import rows_frame
from plumbline.plans.profiling import profiled
from plumbline.plans.quantiles import exact_quantiles
from plumbline.plans.ranks import WINDOW_ROWS, cumulative

# Default English stopwords.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is",
    "it", "its", "not", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with",
)

# Words that count as a positive outcome.
POSITIVE_OUTCOMES = ("1", "true", "yes", "y", "success", "win", "converted")

# Name parts that mark date columns.
DATE_WORDS = ("date", "time", "timestamp")


@dataclass
class CleanConfig:
    trim: bool = True
    fix_types: bool = True
    number_columns: list[str] | None = None
    date_columns: list[str] | None = None
    thousands: str = ","
    decimal: str = "."
    date_formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")
    day_first: bool = False
    clean_text: bool = False
    text_columns: list[str] | None = None
    lowercase: bool = True
    drop_punctuation: bool = True
    drop_stopwords: bool = False
    stopwords: tuple[str, ...] = ()
    standardize: bool = False
    category_columns: list[str] | None = None
    category_case: str = "lower"
    category_mappings: dict[str, dict[str, str]] = field(default_factory=dict)
    missing: str = "fill_mean"
    drop_duplicates: bool = True
    outliers: str | None = None
    smoothing: str | None = None
    smoothing_columns: list[str] | None = None
    window: int = 3
    order_by: str | None = None
    partition_by: tuple[str, ...] = ()


# The four cleaning presets.
PRESETS = {
    "quick_cleanup": CleanConfig(),
    "nlp_text": CleanConfig(fix_types=False, clean_text=True, drop_stopwords=True, missing="fill_mode"),
    "business_standard": CleanConfig(
        missing="fill_mode", clean_text=True, lowercase=False, drop_punctuation=False,
        standardize=True, category_case="title",
    ),
    "sensor_smoothing": CleanConfig(missing="fill_median", outliers="clip", smoothing="median", window=5),
}


def _set(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    return df.select(*[exprs[c].alias(c) if c in exprs else C.quoted(c) for c in df.columns])


def trim_text(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return _set(df, {c: C.strip(C.quoted(c)) for c in (cols or C.text_columns(df))})


def locale_number(c: Column, thousands: str = ",", decimal: str = ".") -> Column:
    """Text to double under the given separators; null when it does not parse."""
    text = F.replace(C.strip(c), F.lit(" "), F.lit(""))
    if thousands and thousands != decimal:
        text = F.replace(text, F.lit(thousands), F.lit(""))
    if decimal and decimal != ".":
        text = F.replace(text, F.lit(decimal), F.lit("."))
    return C.parse_double(text)


def parse_numbers(df: DataFrame, cols: list[str], thousands: str = ",", decimal: str = ".") -> DataFrame:
    return _set(df, {c: locale_number(C.quoted(c), thousands, decimal) for c in cols
                     if c in C.text_columns(df)})


def number_parse_report(df: DataFrame, cols: list[str], thousands: str = ",", decimal: str = ".") -> DataFrame:
    """Per column: values present, values that parse, values lost by typing it as a number."""
    aggs = []
    for i, c in enumerate(cols):
        present = ~C.is_missing(df, c)
        parsed = locale_number(C.quoted(c), thousands, decimal)
        aggs.append(F.struct(F.lit(c).alias("column"), F.count_if(present).alias("present"),
                             F.count(parsed).alias("parsed"),
                             F.count_if(present & parsed.isNull()).alias("failed")).alias(f"c{i}"))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(cols))])).alias("m")).select("m.*")


def pick_date_formats(df: DataFrame, cols: list[str], formats: tuple[str, ...]) -> dict[str, str | None]:
    """The format most values of each column match; None when none matches any."""
    pairs = [(c, f) for c in cols for f in formats]
    if not pairs:
        return {c: None for c in cols}
    row = df.agg(*[
        F.count(F.try_to_timestamp(C.strip(C.quoted(c).cast("string")), F.lit(f))).alias(f"h{i}")
        for i, (c, f) in enumerate(pairs)
    ]).first()
    best: dict[str, tuple[int, str | None]] = {c: (0, None) for c in cols}
    for i, (c, f) in enumerate(pairs):
        if row[i] > best[c][0]:
            best[c] = (row[i], f)
    return {c: f for c, (_, f) in best.items()}


def parse_dates(
    df: DataFrame, cols: list[str], formats: tuple[str, ...] = CleanConfig.date_formats, day_first: bool = False
) -> DataFrame:
    """Rewrite dates as yyyy-MM-dd text; a value that does not parse is kept as it is."""
    chosen = pick_date_formats(df, cols, formats)
    exprs = {}
    for c in cols:
        source = C.quoted(c).cast("string")
        if chosen[c] is not None:
            parsed = F.try_to_timestamp(C.strip(source), F.lit(chosen[c]))
        else:
            slashed = "d/M/yyyy" if day_first else "M/d/yyyy"
            parsed = F.coalesce(F.try_to_timestamp(C.strip(source), F.lit(slashed)), C.strip(source).try_cast("timestamp"))
        exprs[c] = F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), source)
    return _set(df, exprs)


def to_text(df: DataFrame, cols: list[str]) -> DataFrame:
    return _set(df, {c: C.quoted(c).cast("string") for c in cols})


def cleaned_text(c: Column, lowercase: bool = True, drop_punctuation: bool = True, drop_stopwords: bool = False,
                 stopwords: tuple[str, ...] = ()) -> Column:
    text = C.strip(c)
    if lowercase:
        text = F.lower(text)
    if drop_punctuation:
        text = F.regexp_replace(text, r"(?U)[^\w\s]", " ")
    if drop_stopwords:
        words = sorted({*STOPWORDS, *(w.strip().lower() for w in stopwords if w.strip())})
        stop = F.array(*[F.lit(w) for w in words])
        tokens = F.split(text, r"(?U)\s+")
        text = F.array_join(F.filter(tokens, lambda t: (t != "") & ~F.array_contains(stop, F.lower(t))), " ")
    done = C.strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(C.strip(c) == "", c).otherwise(done)


def clean_text(df: DataFrame, cols: list[str] | None = None, **options) -> DataFrame:
    return _set(df, {c: cleaned_text(C.quoted(c), **options) for c in (cols or C.text_columns(df))})


def standard_category(c: Column, mapping: dict[str, str] | None = None, case: str = "lower") -> Column:
    """Trim, look up (ignoring case), then set the case."""
    text = C.strip(c)
    if mapping:
        pairs = [F.lit(v) for k, t in mapping.items() for v in (k.strip().lower(), t.strip())]
        text = F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(text)), text)
    done = {"lower": F.lower, "upper": F.upper, "title": C.title_case}.get(case, lambda x: x)(text)
    return F.when(C.strip(c) == "", c).otherwise(done)


def standardize_categories(df: DataFrame, cols: list[str] | None = None,
                           mappings: dict[str, dict[str, str]] | None = None, case: str = "lower") -> DataFrame:
    cols = cols or C.text_columns(df)
    return _set(df, {c: standard_category(C.quoted(c), (mappings or {}).get(c), case) for c in cols})


# ---- missing values -----------------------------------------------------------------------

def drop_missing_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    keep = F.lit(True)
    for c in cols or df.columns:
        keep = keep & ~C.is_missing(df, c)
    return df.where(keep)


def most_frequent(df: DataFrame, col: str):
    """Most frequent present value; the smallest of equals. None without any."""
    counts = df.where(~C.is_missing(df, col)).groupBy(C.quoted(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    row = counts.orderBy(F.col("n").desc(), "v").first()
    return None if row is None else row["v"]


def fill_values(df: DataFrame, strategy: str, cols: list[str] | None = None) -> dict[str, object]:
    """The value each column with missing cells is filled with."""
    cols = [c for c in (cols or df.columns) if not isinstance(df.schema[c].dataType, C.NESTED)]
    numeric = [c for c in cols if c in C.numeric_columns(df)]
    aggs = [F.count_if(C.is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs += [F.avg(C.as_number(df, c)).alias(f"a{i}") for i, c in enumerate(numeric)]
    row = df.agg(*aggs).first()
    holes = [c for i, c in enumerate(cols) if row[f"m{i}"]]
    found: dict[str, object] = {}
    if strategy == "fill_zero":
        found = {c: 0 if c in numeric else "Unknown" for c in holes}
    elif strategy == "fill_mean":
        found = {c: row[f"a{i}"] for i, c in enumerate(numeric) if c in holes}
    elif strategy == "fill_median":
        wanted = [c for c in numeric if c in holes]
        found = {c: q[0] for c, q in exact_quantiles(df, wanted, [0.5]).items()}
    elif strategy != "fill_mode":
        raise ValueError(f"unknown fill strategy {strategy!r}")
    for c in holes:
        if found.get(c) is None:
            mode = most_frequent(df, c)
            found[c] = mode if mode is not None else "Unknown" if c in C.text_columns(df) else 0
    return found


def fill_missing(df: DataFrame, strategy: str, cols: list[str] | None = None,
                 values: dict[str, object] | None = None) -> DataFrame:
    values = fill_values(df, strategy, cols) if values is None else values
    exprs = {}
    for c, v in values.items():
        if isinstance(df.schema[c].dataType, C.DATETIME + (T.BooleanType,)) and v in (0, "Unknown"):
            continue
        exprs[c] = F.when(C.is_missing(df, c), F.lit(v)).otherwise(C.quoted(c))
    return _set(df, exprs)


# ---- duplicates ---------------------------------------------------------------------------

def drop_duplicates(df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first",
                    order_by: str | None = None) -> DataFrame:
    """Distinct rows, or the first, last or only row per subset value in a given order."""
    if subset is None:
        return df.dropDuplicates()
    if keep is False:
        whole = F.struct(*[C.quoted(c) for c in df.columns])
        alone = df.groupBy(*[C.quoted(c) for c in subset]).agg(
            F.count(F.lit(1)).alias("_n"), F.any_value(whole).alias("_row"))
        return alone.where("_n = 1").select("_row.*")
    if order_by is None:
        raise ValueError("keep='first' or 'last' needs order_by: rows of a table have no order of their own")
    order = C.quoted(order_by).asc() if keep == "first" else C.quoted(order_by).desc()
    w = W.partitionBy(*[C.quoted(c) for c in subset]).orderBy(order)
    # rank 1 is taken before the shuffle as well, so a large group stays spread out
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def duplicate_members(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """How many rows share their subset values with another row."""
    keys = [C.quoted(c) for c in (subset or df.columns)]
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("duplicate_members"), F.count(F.lit(1)).alias("groups"))


# ---- outliers -----------------------------------------------------------------------------

def iqr_fences(df: DataFrame, cols: list[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    out = {}
    for c, q in exact_quantiles(df, cols, [0.25, 0.75]).items():
        if q[0] is not None:
            out[c] = (q[0] - factor * (q[1] - q[0]), q[1] + factor * (q[1] - q[0]))
    return out


def treat_outliers(df: DataFrame, cols: list[str] | None = None, action: str = "clip",
                   fences: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Clip to the quartile fences, or remove rows beyond them (nulls stay)."""
    if action not in ("clip", "remove"):
        raise ValueError(f"unknown outlier action {action!r}")
    fences = iqr_fences(df, cols or C.numeric_columns(df)) if fences is None else fences
    if action == "remove":
        keep = F.lit(True)
        for c, (lo, hi) in fences.items():
            x = C.as_number(df, c)
            keep = keep & (x.isNull() | x.between(lo, hi))
        return df.where(keep)
    exprs = {}
    for c, (lo, hi) in fences.items():
        x = C.as_number(df, c)
        exprs[c] = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
    return _set(df, exprs)


def _outlier_masks(df: DataFrame, cols: list[str], method: str, threshold: float) -> dict[str, Column]:
    if method == "iqr":
        return {c: (C.as_number(df, c) < lo) | (C.as_number(df, c) > hi)
                for c, (lo, hi) in iqr_fences(df, cols, threshold).items()}
    if method == "zscore":
        m = profiled(df.select(*[C.quoted(c) for c in cols])).moments
        return {c: F.abs(C.as_number(df, c) - m[c]["mean"]) / m[c]["std_pop"] > threshold
                for c in cols if m[c]["std_pop"]}
    raise ValueError(f"unknown outlier method {method!r}")


def replace_outliers(df: DataFrame, cols: list[str], method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Outliers become the column median."""
    medians = exact_quantiles(df, cols, [0.5])
    masks = _outlier_masks(df, cols, method, threshold)
    return _set(df, {c: F.when(mask, F.lit(medians[c][0])).otherwise(C.as_number(df, c)) for c, mask in masks.items()})


def count_outliers(df: DataFrame, cols: list[str], method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    masks = _outlier_masks(df, cols, method, threshold)
    if not masks:
        return rows_frame(df.sparkSession, [], "column string, outliers long")
    one = df.agg(*[F.count_if(mask).alias(f"c{i}") for i, mask in enumerate(masks.values())])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("outliers")) for i, c in enumerate(masks)
    ])).alias("m")).select("m.*")


# ---- smoothing ----------------------------------------------------------------------------

SMOOTH_BLOCK = 1_000_000


def smooth(df: DataFrame, cols: list[str], order_by: str, window: int = 3, method: str = "mean",
           partition_by: tuple[str, ...] = (), rows: int | None = None, window_rows: int = WINDOW_ROWS,
           block: int = SMOOTH_BLOCK) -> DataFrame:
    """Trailing mean or median over ``window`` rows in a given order.

    A long series is cut into blocks of consecutive rows; each block also gets the
    last ``window - 1`` rows of the one before it, so every frame is whole.
    """
    window = max(2, window)
    rows = df.count() if rows is None else rows
    keys = list(partition_by)

    def rolled(frame) -> dict[str, Column]:
        out = {}
        for c in cols:
            x = C.as_number(df, c)
            out[c] = (F.percentile(x, F.lit(0.5)) if method == "median" else F.avg(x)).over(frame)
        return out

    if rows <= window_rows:
        frame = W.partitionBy(*[C.quoted(k) for k in keys]).orderBy(C.quoted(order_by)).rowsBetween(1 - window, 0)
        return _set(df, rolled(frame))
    named = [f"k{i}" for i in range(len(keys))]
    packed = df.select(F.struct("*").alias("whole"), *[C.quoted(k).alias(n) for k, n in zip(keys, named)], C.quoted(order_by).alias("at"), F.lit(1).alias("n"))
    placed = cumulative(packed, named, [F.col("at")], rows=rows, window_rows=window_rows).select(
        F.col("place").alias("__plumb_place"), *[F.col(n).alias(f"__plumb_{n}") for n in named], "whole.*")
    at = F.col("__plumb_place")
    near_end = at % block >= block - (window - 1)
    spread = placed.withColumn("__plumb_copy", F.explode(F.when(near_end, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    spread = spread.withColumn("__plumb_block", F.floor(at / block) + F.col("__plumb_copy"))
    frame = W.partitionBy(*[f"__plumb_{n}" for n in named], "__plumb_block").orderBy("__plumb_place").rowsBetween(1 - window, 0)
    exprs = rolled(frame)
    done = spread.select(*[exprs[c].alias(c) if c in exprs else C.quoted(c) for c in df.columns], "__plumb_copy")
    return done.where("__plumb_copy = 0").drop("__plumb_copy")


# ---- whole cleaner ------------------------------------------------------------------------

def column_roles(df: DataFrame, config: CleanConfig) -> tuple[list[str], list[str]]:
    """(number columns, date columns); each text column gets one role at most.

    Unless named, a text column is a date by its name and a number when every
    present value parses.
    """
    text = C.text_columns(df)
    dates = config.date_columns or [c for c in text if any(w in c.lower() for w in DATE_WORDS)]
    dates = [c for c in dates if c in text]
    if config.number_columns:
        return [c for c in config.number_columns if c in text and c not in dates], dates
    open_cols = [c for c in text if c not in dates]
    if not open_cols:
        return [], dates
    report = number_parse_report(df, open_cols, config.thousands, config.decimal).collect()
    return [r["column"] for r in report if r["present"] and not r["failed"]], dates


def clean(df: DataFrame, config: CleanConfig | None = None) -> DataFrame:
    """The cleaning steps in their fixed order; lazy but for the small aggregates that fetch
    parse votes, fill values and fences."""
    cfg = config or CleanConfig()
    out = trim_text(df) if cfg.trim else df
    if cfg.fix_types:
        numbers, dates = column_roles(out, cfg)
        out = parse_numbers(out, numbers, cfg.thousands, cfg.decimal)
        out = parse_dates(out, dates, cfg.date_formats, cfg.day_first)
    if cfg.clean_text:
        out = clean_text(out, cfg.text_columns, lowercase=cfg.lowercase, drop_punctuation=cfg.drop_punctuation,
                         drop_stopwords=cfg.drop_stopwords, stopwords=cfg.stopwords)
    if cfg.standardize:
        out = standardize_categories(out, cfg.category_columns, cfg.category_mappings, cfg.category_case)
    out = drop_missing_rows(out) if cfg.missing == "drop_rows" else fill_missing(out, cfg.missing)
    if cfg.drop_duplicates:
        out = drop_duplicates(out)
    if cfg.outliers:
        out = treat_outliers(out, action=cfg.outliers)
    if cfg.smoothing:
        if cfg.order_by is None:
            raise ValueError("smoothing needs order_by")
        held = {cfg.order_by, *cfg.partition_by}
        cols = cfg.smoothing_columns or [c for c in C.numeric_columns(out) if c not in held]
        out = smooth(out, cols, cfg.order_by, cfg.window, cfg.smoothing, cfg.partition_by)
    return out


def missing_cells(df: DataFrame) -> Column:
    return sum((F.count_if(C.is_missing(df, c)) for c in df.columns), F.lit(0))


def clean_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    b = before.agg(F.count(F.lit(1)).alias("rows_before"), missing_cells(before).alias("missing_before"))
    a = after.agg(F.count(F.lit(1)).alias("rows_after"), missing_cells(after).alias("missing_after"))
    x, y = b.first(), a.first()
    return rows_frame(before.sparkSession, [{
        "rows_before": x["rows_before"], "rows_after": y["rows_after"],
        "removed_rows": x["rows_before"] - y["rows_after"],
        "missing_before": x["missing_before"], "missing_after": y["missing_after"],
    }], "rows_before long, rows_after long, removed_rows long, missing_before long, missing_after long")


def recommend_preset(df: DataFrame) -> DataFrame:
    """One of the four presets from the share of numeric columns, text length and names."""
    cols = [f.name for f in df.schema if not isinstance(f.dataType, C.NESTED)]
    text = C.text_columns(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        aggs.append(F.count(C.as_number(df, c) if c not in C.datetime_columns(df) else F.lit(None)).alias(f"n{i}"))
        if c in text:
            aggs.append(F.avg(F.when(~C.is_missing(df, c), F.length(C.quoted(c)))).alias(f"l{i}"))
    row = df.agg(*aggs).first()
    total = row["rows"]
    numeric = sum(1 for i, _ in enumerate(cols) if row[f"n{i}"] and row[f"n{i}"] / max(total, 1) >= 0.7)
    wordy = sum(1 for i, c in enumerate(cols) if c in text and (row[f"l{i}"] or 0) >= 30)
    dated = sum(1 for c in df.columns if any(w in c.lower() for w in DATE_WORDS))
    if wordy >= 2:
        preset = "nlp_text"
    elif numeric >= max(2, int(len(df.columns) * 0.6)) and total >= 50:
        preset = "sensor_smoothing"
    elif numeric and dated:
        preset = "business_standard"
    else:
        preset = "quick_cleanup"
    return rows_frame(df.sparkSession, [{"preset": preset, "numeric_columns": numeric, "text_heavy_columns": wordy,
                      "date_named_columns": dated, "rows": total}],
                      "preset string, numeric_columns int, text_heavy_columns int, date_named_columns int, rows long")


def cleaning_counts(df: DataFrame) -> DataFrame:
    """Missing cells, duplicate rows and number-like columns."""
    text = C.text_columns(df)
    aggs = [missing_cells(df).alias("missing")]
    for i, c in enumerate(text):
        present = ~C.is_missing(df, c)
        aggs += [F.count_if(present).alias(f"p{i}"), F.count(locale_number(C.quoted(c))).alias(f"q{i}")]
    row = df.agg(*aggs).first()
    like = len(C.numeric_columns(df)) + sum(
        1 for i, _ in enumerate(text) if row[f"p{i}"] and row[f"q{i}"] / row[f"p{i}"] >= 0.6)
    return rows_frame(df.sparkSession, [{"missing_cells": row["missing"], "duplicate_rows": profiled(df).duplicates,
                      "numeric_like_columns": like}], "missing_cells long, duplicate_rows long, numeric_like_columns int")


def _differences(before: DataFrame, after: DataFrame, id_col: str) -> DataFrame:
    shared = [c for c in before.columns if c in after.columns and c != id_col]
    b = before.select(C.quoted(id_col).alias("_id"), F.struct(*[C.quoted(c).cast("string").alias(c) for c in shared]).alias("_b"))
    a = after.select(C.quoted(id_col).alias("_id"), F.struct(*[C.quoted(c).cast("string").alias(c) for c in shared]).alias("_a"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col("_b")[c], F.lit("")).alias("before"),
                               F.coalesce(F.col("_a")[c], F.lit("")).alias("after")) for c in shared])
    return b.join(a, "_id").select("_id", F.explode(cells).alias("m")).select("_id", "m.*").where("before <> after")


def column_diff(before: DataFrame, after: DataFrame, id_col: str) -> DataFrame:
    """Changed cells per column between two versions joined on an id."""
    return _differences(before, after, id_col).groupBy("column").agg(F.count(F.lit(1)).alias("changed"))


def column_diff_samples(before: DataFrame, after: DataFrame, id_col: str, n: int = 3) -> DataFrame:
    w = W.partitionBy("column").orderBy("_id")
    return _differences(before, after, id_col).withColumn("rank", F.row_number().over(w)).where(
        F.col("rank") <= n).withColumnRenamed("_id", id_col)


def encode_binary(df: DataFrame, col: str, into: str = "outcome") -> DataFrame:
    """0/1 outcome: positive numbers, else positive words, else the later of two values.

    Raises when none of the rules applies.
    """
    text = F.lower(C.strip(C.quoted(col).cast("string")))
    number = C.as_number(df, col)
    # Two distinct words at most are needed: the first, the last, and any in between.
    words = F.when(text != "", text)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count(number).alias("numbers"),
        F.count_if(text.isin(*POSITIVE_OUTCOMES)).alias("positives"),
        F.min(words).alias("least"), F.max(words).alias("most"),
    ).first()
    if row["numbers"] >= max(3, int(row["rows"] * 0.7)):
        return df.withColumn(into, (F.coalesce(number, F.lit(0.0)) > 0).cast("int"))
    if row["positives"]:
        return df.withColumn(into, F.coalesce(text.isin(*POSITIVE_OUTCOMES), F.lit(False)).cast("int"))
    if row["least"] is not None and row["least"] != row["most"]:
        others = df.where(words.isNotNull() & ~words.isin(row["least"], row["most"])).limit(1).count()
        if not others:
            return df.withColumn(into, F.coalesce(words == row["most"], F.lit(False)).cast("int"))
    raise ValueError(f"column {col!r} is not a binary outcome")
