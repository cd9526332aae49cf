"""Derived columns: dates, texts, interactions, codes, scales and components."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.operators.cleaning import _set
from plumbline.plans.frames import rows_frame
from plumbline.plans.lookups import lookup_join
from plumbline.plans.profiling import profiled
from plumbline.plans.ranks import cumulative

# The two sentiment word lists.
POSITIVE_WORDS = (
    "good", "great", "excellent", "positive", "up", "increase", "improved", "success", "happy", "love", "profit", "growth",
)
NEGATIVE_WORDS = (
    "bad", "poor", "negative", "down", "decrease", "decline", "risk", "error", "fail", "loss", "hate", "issue",
)


def date_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Year, month, day and weekday (Sunday is 0); text is parsed, failures give null."""
    made = {}
    for c in cols:
        t = C.quoted(c) if c in C.datetime_columns(df) else C.strip(C.quoted(c).cast("string")).try_cast("timestamp")
        made.update({f"{c}_year": F.year(t), f"{c}_month": F.month(t), f"{c}_day": F.dayofmonth(t),
                     f"{c}_weekday": F.dayofweek(t) - 1})
    return df.withColumns(made)


def tokens(c: Column) -> Column:
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+")
    return F.filter(words, lambda w: w != "")


def text_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Word count and sentiment: (positive - negative words) / words."""
    made = {}
    for c in cols:
        text = C.strip(F.coalesce(C.quoted(c), F.lit("")))
        count = F.when(text == "", 0).otherwise(F.size(F.split(text, r"(?U)\s+")))
        words = tokens(C.quoted(c))
        plus = F.size(F.filter(words, lambda w: w.isin(*POSITIVE_WORDS)))
        minus = F.size(F.filter(words, lambda w: w.isin(*NEGATIVE_WORDS)))
        score = F.coalesce(F.try_divide((plus - minus).cast("double"), F.size(words)), F.lit(0.0))
        made.update({f"{c}_word_count": count, f"{c}_sentiment": score})
    return df.withColumns(made)


def interactions(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = C.as_number(df, a), C.as_number(df, b)
    return df.withColumns({f"{a}_x_{b}": x * y, f"{a}_div_{b}": F.try_divide(x, y)})


def value_codes(df: DataFrame, col: str) -> DataFrame:
    """(col, n, code): codes of the distinct values in sorted order."""
    counts = df.where(C.quoted(col).isNotNull()).groupBy(C.quoted(col).alias(col)).agg(F.count(F.lit(1)).alias("n"))
    return cumulative(counts, [], [C.quoted(col)]).select(C.quoted(col), "n", F.col("place").cast("int").alias("code"))


def label_encode(df: DataFrame, cols: list[str], suffix: str = "_code") -> DataFrame:
    for c in cols:
        df = lookup_join(df, value_codes(df, c).withColumnRenamed("code", c + suffix), c, [c + suffix])
    return df


def safe_name(value: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in str(value))


def value_columns(column: str, values: list[str], taken: list[str]) -> list[str]:
    """One new column name per value; where two would be alike, or a column has the name, a number follows."""
    used, out = set(taken), []
    for v in values:
        base = f"{column}_{safe_name(v)}"
        name, turn = base, 2
        while name in used:
            name, turn = f"{base}_{turn}", turn + 1
        used.add(name)
        out.append(name)
    return out


def one_hot(df: DataFrame, cols: list[str], max_categories: int = 20) -> DataFrame:
    """0/1 columns for the most frequent values of each column; ties by value."""
    made = {}
    for c in cols:
        top = df.where(C.quoted(c).isNotNull()).groupBy(C.quoted(c).cast("string").alias("v")).agg(
            F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "v").limit(max_categories).collect()
        values = [r["v"] for r in top]
        for name, v in zip(value_columns(c, values, [*df.columns, *made]), values):
            made[name] = F.coalesce((C.quoted(c).cast("string") == F.lit(v)).cast("int"), F.lit(0))
    return df.withColumns(made)


def rescale(df: DataFrame, cols: list[str] | None = None, method: str = "minmax") -> DataFrame:
    """Min-max or z-score; nulls stay, a column without spread is only shifted."""
    cols = cols or C.numeric_columns(df)
    m = profiled(df.select(*[C.quoted(c) for c in cols])).moments
    exprs = {}
    for c in cols:
        if not m[c]["n"]:
            continue
        shift, scale = (m[c]["min"], m[c]["max"] - m[c]["min"]) if method == "minmax" else (m[c]["mean"], m[c]["std_pop"])
        exprs[c] = (C.as_number(df, c) - F.lit(shift)) / F.lit(scale or 1.0)
    return _set(df, exprs)


def drop_low_value(df: DataFrame, missing: float = 0.5, variance: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Leave out columns with too many missing cells and numeric columns that hardly vary."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    numeric = C.numeric_columns(df)
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(C.is_missing(df, c)).alias(f"m{i}"))
        if c in numeric:
            aggs.append(F.var_pop(C.as_number(df, c)).alias(f"v{i}"))
    row = df.agg(*aggs).first().asDict()
    out = []
    for i, c in enumerate(df.columns):
        sparse = row["rows"] and row[f"m{i}"] / row["rows"] > missing
        flat = c in numeric and (row[f"v{i}"] is None or row[f"v{i}"] <= variance)
        if c in keep or not (sparse or flat):
            out.append(c)
    return df.select(*[C.quoted(c) for c in out])


def corr_importance(df: DataFrame, target: str, k: int = 20) -> DataFrame:
    """|Pearson r| of every column with the target; text columns by their sorted codes."""
    text = [c for c in C.text_columns(df)]
    coded = label_encode(df, text, "_code_") if text else df
    names = {c: c + "_code_" if c in text else c for c in df.columns if c in text or c in C.numeric_columns(df)}
    y = C.as_number(coded, names[target])
    features = [c for c in names if c != target]
    row = coded.agg(*[F.abs(C.pairwise_corr(C.as_number(coded, names[c]), y)).alias(f"r{i}") for i, c in enumerate(features)]).first()
    rows = [{"feature": c, "importance": row[i] or 0.0} for i, c in enumerate(features)]
    rows.sort(key=lambda r: (-r["importance"], r["feature"]))
    return rows_frame(df.sparkSession, rows[:k], "feature string, importance double")


def reduction_columns(df: DataFrame, min_share: float = 0.4) -> list[str]:
    """Columns of which at least ``min_share`` of all rows parse as a number."""
    cols = [f.name for f in df.schema if not isinstance(f.dataType, C.NESTED + C.DATETIME)]
    row = df.agg(F.count(F.lit(1)), *[F.count(C.as_number(df, c)) for c in cols]).first()
    return [c for c, n in zip(cols, row[1:]) if row[0] and n / row[0] >= min_share]


def reduction_input(df: DataFrame, min_share: float = 0.4) -> DataFrame:
    """The mostly numeric columns as doubles, complete rows only."""
    cols = reduction_columns(df, min_share)
    return df.select(*[C.as_number(df, c).alias(c) for c in cols]).dropna()


class FittedPCA:
    def __init__(self, model, cols: list[str], signs: list[float], ratios: list[float], loadings: list[list[float]]):
        self.model, self.cols, self.signs, self.ratios, self._loadings = model, cols, signs, ratios, loadings

    def transform(self, df: DataFrame) -> DataFrame:
        rows = df.select("*", *[C.as_number(df, c).alias(f"_p{i}") for i, c in enumerate(self.cols)]).dropna(
            subset=[f"_p{i}" for i in range(len(self.cols))])
        scored = self.model.transform(rows).withColumn("_a", vector_to_array("_pc"))
        return scored.select(*[C.quoted(c) for c in df.columns], *[
            (F.col("_a")[i] * s).alias(f"pc{i + 1}") for i, s in enumerate(self.signs)])

    def explained(self, spark) -> DataFrame:
        kept = sum(self.ratios)
        rows = [{"component": i + 1, "ratio": r, "ratio_of_kept": r / kept if kept else 0.0} for i, r in enumerate(self.ratios)]
        return rows_frame(spark, rows, "component int, ratio double, ratio_of_kept double")

    def loadings(self, spark) -> DataFrame:
        rows = [{"component": i + 1, "column": c, "loading": v[j]} for i, v in enumerate(self._loadings) for j, c in enumerate(self.cols)]
        return rows_frame(spark, rows, "component int, column string, loading double")


def pca(df: DataFrame, cols: list[str], k: int = 2, standardize: bool = True) -> FittedPCA:
    """Principal components over complete rows; the largest loading of each is positive."""
    names = [f"_p{i}" for i in range(len(cols))]
    rows = df.select(*[C.as_number(df, c).alias(n) for c, n in zip(cols, names)]).dropna()
    stages = [VectorAssembler(inputCols=names, outputCol="_raw"),
              StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=standardize),
              PCA(k=k, inputCol="_x", outputCol="_pc")]
    model = Pipeline(stages=stages).fit(rows)
    matrix = model.stages[-1].pc.toArray()
    signs, loadings = [], []
    for j in range(k):
        v = matrix[:, j]
        sign = 1.0 if v[abs(v).argmax()] >= 0 else -1.0
        signs.append(sign)
        loadings.append([float(sign * x) for x in v])
    return FittedPCA(model, cols, signs, [float(x) for x in model.stages[-1].explainedVariance], loadings)
