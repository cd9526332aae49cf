"""Column classes and the column expressions every operator shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
NUMERIC = INTEGRAL + FLOATING + (T.DecimalType,)
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
TEXT = (T.StringType, T.VarcharType, T.CharType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, TEXT)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, DATETIME)]


def require_columns(df: DataFrame, names: list[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"columns not in the table: {', '.join(absent)}")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def as_number(df: DataFrame, name: str) -> Column:
    """The column as double; NaN counts as null."""
    kind = df.schema[name].dataType
    c = quoted(name)
    if isinstance(kind, FLOATING):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(kind, NUMERIC):
        return c.cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    return parse_double(c)


def parse_double(c: Column) -> Column:
    """Text to a finite double, null when it is not a number."""
    parsed = c.cast("string").try_cast("double")
    usable = ~F.isnan(parsed) & (F.abs(parsed) != F.lit(float("inf")))
    return F.when(usable, parsed)


def is_null(df: DataFrame, name: str) -> Column:
    """Null or NaN."""
    c = quoted(name)
    if isinstance(df.schema[name].dataType, FLOATING):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def strip(c: Column) -> Column:
    """Remove whitespace of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, NaN, or text that is blank after stripping."""
    if isinstance(df.schema[name].dataType, TEXT):
        c = quoted(name)
        return c.isNull() | (strip(c) == "")
    return is_null(df, name)


def title_case(c: Column) -> Column:
    """Capitalise every run of letters, whatever separates the runs."""
    spaced = F.regexp_replace(F.lower(c), r"(?U)(?<!\p{Alpha})(\p{Alpha})", "\u0001$1")
    pieces = F.split(spaced, "\u0001")
    capital = F.transform(
        pieces,
        lambda p, i: F.when(
            i > 0, F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))
        ).otherwise(p),
    )
    return F.array_join(capital, "")


def safe_ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def sample_skewness(n: Column, g1: Column) -> Column:
    """Bias-corrected skewness from the population one; null below three rows."""
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one; null below four rows."""
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def pairwise_corr(a: Column, b: Column) -> Column:
    """Pearson r over rows where both are present; null when either is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def equal_width_bin(c: Column, lo: float, hi: float, bins: int) -> Column:
    """Zero-based bin number; the last bin is closed, a constant column is widened by one half."""
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    number = F.width_bucket(c, F.lit(float(lo)), F.lit(float(hi)), F.lit(bins))
    return F.least(number.cast("int"), F.lit(bins)) - 1
