"""Reading, writing and previewing tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions import columns as C
from plumbline.plans.frames import rows_frame
from plumbline.plans.profiling import profiled

FORMATS = {"csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc"}
#: Formats that Spark has no reader for.
UNREADABLE = {"xls", "xlsx", "pdf", "zip"}


#: How files begin that say what they are; text files begin with none of these.
SIGNATURES = {"PAR1": "parquet", "ORC": "orc", "PK\x03\x04": "zip"}


def content_format(spark: SparkSession, path: str) -> tuple[str, str]:
    """(format, separator) by the first line: a binary signature, a JSON bracket, else CSV with its most frequent separator."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0]["value"] if head else ""
    for signature, kind in SIGNATURES.items():
        if line.startswith(signature):
            return kind, ","
    if "PNG" in line[:4] or "JFIF" in line[:12] or "Exif" in line[:12]:
        return "image", ","
    if line.lstrip("\ufeff \t")[:1] in ("{", "["):
        return "json", ","
    return "csv", max((",", "\t", ";"), key=line.count)


def load_table(spark: SparkSession, path: str, format: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """Read a file or a directory of files of one schema; the format follows the extension, or the
    content where there is none or an unknown one. Images give one row of features each.

    Blank CSV fields and NaN read as null. Without a schema a CSV is scanned once more
    to infer one; pass the schema for large inputs. Empty inputs are refused.
    """
    tail = path.rstrip("/").rsplit("/", 1)[-1]
    extension = tail.rsplit(".", 1)[-1].lower() if "." in tail else ""
    kind, separator = format or FORMATS.get(extension), "\t" if extension == "tsv" else ","
    if kind is None and extension not in UNREADABLE:
        kind, separator = content_format(spark, path)
    if kind == "image":
        from plumbline.sources.images import image_features

        return image_features(spark, path)
    if kind not in {"csv", "json", "parquet", "orc"}:
        raise ValueError(f"unsupported table format: {format or extension}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        reader = reader.options(header=True, inferSchema=schema is None, nullValue="", escape='"',
                                sep=separator)
    df = nan_to_null(reader.format(kind).load(path))
    if not df.columns or df.isEmpty():
        raise ValueError(f"no data rows in {path}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    exprs = []
    for f in df.schema:
        c = C.quoted(f.name)
        exprs.append(F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name) if isinstance(f.dataType, C.FLOATING) else c)
    return df.select(*exprs)


def preview(df: DataFrame, n: int, order_by: str) -> DataFrame:
    return df.orderBy(order_by).limit(n)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))


def snapshot(data, order_by: str | None = None, sample_rows: int = 5) -> dict[str, DataFrame]:
    """Shape, column types and nulls, statistics with skew and kurtosis, and a few rows."""
    from plumbline.operators import profile as P

    p = profiled(data)
    parts = {
        "shape": rows_frame(p.spark, [{"rows": p.rows, "columns": len(p.columns)}], "rows long, columns int"),
        "columns": rows_frame(p.spark, [{"column": c, "dtype": t, "missing": p.missing[c]} for c, t in p.df.dtypes],
                              "column string, dtype string, missing long"),
        "statistics": P.describe_numeric(p).join(
            rows_frame(p.spark, [{"column": c, "skew": p.moments[c]["skew"], "kurtosis": p.moments[c]["kurt"]}
                                 for c in p.numeric], "column string, skew double, kurtosis double"), "column"),
    }
    if order_by:
        parts["sample"] = preview(p.df, sample_rows, order_by)
    return parts


def project_headers(df: DataFrame, headers: list[str]) -> DataFrame:
    """The named columns in the named order; all of them must exist."""
    C.require_columns(df, headers)
    return df.select(*[C.quoted(h) for h in headers])


def save_version(df: DataFrame, base: str, kind: str, stamp: str | None = None) -> str:
    """Write a derived version beside its table and return its path."""
    stamp = stamp or datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S")
    path = f"{base.rstrip('/')}_{kind}_{stamp}"
    df.write.mode("errorifexists").parquet(path)
    return path


def export(df: DataFrame, path: str, format: str = "csv") -> None:
    if format == "csv":
        df.write.mode("errorifexists").options(header=True, escape='"').csv(path)
    elif format == "json":
        df.write.mode("errorifexists").json(path)
    else:
        raise ValueError(f"unsupported export format: {format}")


def popular(log: DataFrame, key: str, ts: str, n: int = 10) -> DataFrame:
    """Most used entries of a log: accesses and last access."""
    grouped = log.groupBy(C.quoted(key)).agg(F.count(F.lit(1)).alias("access_count"), F.max(C.quoted(ts)).alias("last_access"))
    return grouped.orderBy(F.col("access_count").desc(), key).limit(n)


def recent(log: DataFrame, key: str, value, ts: str, n: int = 10) -> DataFrame:
    return log.where(C.quoted(key) == F.lit(value)).orderBy(C.quoted(ts).desc()).limit(n)
