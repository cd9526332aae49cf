"""Quality scores. The rules below act on the scalars of one shared Profile."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.operators import profile as P
from plumbline.operators.profile import Table, pct
from plumbline.plans.frames import rows_frame
from plumbline.plans.profiling import Profile, profiled

#: Distinct texts of a column that are counted before they are parsed.
FEW_VALUES = 10_000

# Component weights of the reliability index.
DRI_WEIGHTS = {
    "missingness": 0.20,
    "duplicates": 0.15,
    "outliers": 0.15,
    "type_consistency": 0.15,
    "category_balance": 0.10,
    "date_consistency": 0.10,
    "high_cardinality": 0.10,
    "zero_variance": 0.05,
}

# A component below its bound is reported as an issue.
DRI_ISSUES = {
    "missingness": (70, "high missing data rate"),
    "duplicates": (80, "significant duplicate rows"),
    "outliers": (70, "high outlier rate"),
    "type_consistency": (90, "data type inconsistencies"),
    "category_balance": (60, "severe category imbalance"),
    "high_cardinality": (70, "high cardinality columns"),
    "zero_variance": (95, "zero-variance columns"),
}


def stepped(value: float, steps: list[tuple[float, float]], slope: float) -> float:
    """Score of the first step the value lies below; past the last one, a falling line."""
    for bound, score in steps:
        if value < bound:
            return score
    return max(0.0, 100.0 - slope * value)


def missingness_score(data: Table) -> float:
    share = profiled(data).missing_pct
    return 100.0 if share == 0 else stepped(share, [(5, 90.0), (10, 75.0), (20, 50.0)], 1.0)


def duplicates_score(data: Table) -> float:
    p = profiled(data)
    share = pct(p.duplicates, p.rows)
    return 100.0 if share == 0 else stepped(share, [(1, 95.0), (5, 80.0), (10, 60.0)], 2.0)


def outliers_score(data: Table) -> float:
    p = profiled(data)
    values = sum(p.moments[c]["n"] for c in p.numeric)
    return stepped(pct(p.outlier_total, values), [(1, 100.0), (5, 90.0), (10, 75.0)], 2.0)


def _text_parses(p: Profile) -> dict[str, dict]:
    """Per text column: values, values that parse as a number, values that parse as a time.

    Of a column with few values each is parsed once, however many rows have it.
    """
    if not hasattr(p, "_parses"):
        few = [c for c in p.text if p.distinct[c] <= FEW_VALUES]
        many = [c for c in p.text if c not in few]
        p._parses = {c: {"n": 0, "numbers": 0, "times": 0} for c in few}
        value, n = F.col("value"), F.col("n")
        for r in p.value_counts(few).groupBy("column").agg(
                F.sum(n).alias("n"), F.sum(F.when(C.parse_double(value).isNotNull(), n).otherwise(0)).alias("numbers"),
                F.sum(F.when(C.strip(value).try_cast("timestamp").isNotNull(), n).otherwise(0)).alias("times")).collect() if few else []:
            p._parses[r["column"]] = {k: r[k] for k in ("n", "numbers", "times")}
        aggs = []
        for i, c in enumerate(many):
            v = C.quoted(c)
            aggs.append(F.struct(
                F.count(v).alias("n"), F.count(C.parse_double(v)).alias("numbers"),
                F.count(C.strip(v).try_cast("timestamp")).alias("times"),
            ).alias(f"p{i}"))
        row = p.df.agg(*aggs).first() if aggs else []
        p._parses |= {c: row[i].asDict() for i, c in enumerate(many)}
    return p._parses


def type_consistency_score(data: Table) -> float:
    """Falls with the share of columns that hold only numbers but are typed as text."""
    p = profiled(data)
    wrong = sum(1 for t in _text_parses(p).values() if t["numbers"] == t["n"])
    return max(0.0, 100.0 - pct(wrong, len(p.columns)))


def category_balance_score(data: Table) -> float:
    """Mean normalised entropy of the text columns with at least two values."""
    p = profiled(data)
    got = P.entropy(p).where("max_entropy > 0").agg(F.avg("normalized_entropy")).first()[0] if p.text else None
    return 100.0 if got is None else 100.0 * got


def date_consistency_score(data: Table, as_of: datetime) -> float:
    """Half for dates kept as text; otherwise falls with columns beyond ``as_of`` or before 1900."""
    p = profiled(data)
    if not p.datetime:
        untyped = any(t["n"] and t["times"] == t["n"] for t in _text_parses(p).values())
        return 50.0 if untyped else 100.0
    now, old = F.lit(as_of.isoformat(sep=" ")), F.lit("1900-01-01 00:00:00")
    aggs = []
    for i, c in enumerate(p.datetime):
        t = C.quoted(c).cast("timestamp_ntz")
        aggs.append(F.max((t > now.cast("timestamp_ntz")).cast("int")).alias(f"late{i}"))
        aggs.append(F.max((t < old.cast("timestamp_ntz")).cast("int")).alias(f"early{i}"))
    issues = sum(v or 0 for v in p.df.agg(*aggs).first())
    return max(0.0, 100.0 - 50.0 * issues / len(p.datetime))


def high_cardinality_score(data: Table) -> float:
    p = profiled(data)
    high = sum(1 for c in p.text if p.rows and p.distinct[c] / p.rows > 0.5)
    return max(0.0, 100.0 - pct(high, len(p.text)))


def zero_variance_score(data: Table) -> float:
    p = profiled(data)
    return max(0.0, 100.0 - pct(sum(1 for d in p.distinct.values() if d == 1), len(p.columns)))


def letter(score: float) -> str:
    for bound, grade in ((90, "A"), (80, "B"), (70, "C"), (60, "D")):
        if score >= bound:
            return grade
    return "F"


def dri_scores(data: Table, as_of: datetime) -> dict[str, float]:
    p = profiled(data)
    return {
        "missingness": missingness_score(p), "duplicates": duplicates_score(p), "outliers": outliers_score(p),
        "type_consistency": type_consistency_score(p), "category_balance": category_balance_score(p),
        "date_consistency": date_consistency_score(p, as_of), "high_cardinality": high_cardinality_score(p),
        "zero_variance": zero_variance_score(p),
    }


def dri(data: Table, as_of: datetime) -> DataFrame:
    """Data reliability index: eight weighted component scores, the total, grade and issues."""
    p = profiled(data)
    scores = dri_scores(p, as_of)
    total = sum(scores[k] * w for k, w in DRI_WEIGHTS.items())
    rows = []
    for k, w in DRI_WEIGHTS.items():
        bound, text = DRI_ISSUES.get(k, (None, None))
        rows.append({"component": k, "score": scores[k], "weight": w, "grade": None,
                     "issue": text if bound is not None and scores[k] < bound else None})
    rows.append({"component": "total", "score": total, "weight": 1.0, "grade": letter(total), "issue": None})
    return rows_frame(p.spark, rows, "component string, score double, weight double, grade string, issue string")


def quality_report(data: Table, as_of: datetime) -> dict[str, DataFrame]:
    p = profiled(data)
    return {
        "dri": dri(p, as_of), "missing": P.missing_by_column(p), "duplicates": P.duplicate_report(p),
        "outliers": P.outlier_report(p), "cardinality": P.cardinality(p),
    }


def quality_value(data: Table, method: str = "penalty") -> float:
    """0 to 100. ``penalty``, ``simple`` and ``mean3`` are the three published rules."""
    p = profiled(data)
    width = len(p.columns)
    if method == "penalty":
        score = 100.0
        score -= min(40.0, 2.0 * p.missing_pct)
        score -= min(20.0, 5.0 * pct(p.outlier_total, p.rows * width))
        return float(int(max(0.0, min(100.0, score))))
    if method == "simple":
        return max(0.0, 100.0 - 0.5 * p.missing_pct - 0.3 * pct(p.duplicates, p.rows))
    if method == "mean3":
        unique = pct(p.rows - p.duplicates, p.rows)
        inside = 100.0 - pct(p.outlier_total, p.rows * len(p.numeric))
        return float(int((100.0 - p.missing_pct + unique + inside) / 3 + 0.5))
    raise ValueError(f"unknown quality method {method!r}")


def quality_score(data: Table, method: str = "penalty") -> DataFrame:
    p = profiled(data)
    score = quality_value(p, method)
    row = {"method": method, "score": score}
    if method == "mean3":
        sparse = sum(1 for m in p.missing.values() if pct(m, p.rows) > 20)
        row["readiness"] = min(100.0, max(0.0, score - 10.0 * sparse))
    return rows_frame(p.spark, [row], "method string, score double, readiness double")


def quality_radar(data: Table) -> DataFrame:
    """Completeness, consistency, validity and uniqueness, each 0 to 100."""
    p = profiled(data)
    cvs = []
    for c in p.filled:
        m = p.moments[c]
        cvs.append(pct(m["std"] or 0.0, m["mean"]) if m["mean"] else 0.0)
    axes = {
        "completeness": 100.0 - p.missing_pct,
        "consistency": quality_value(p) - (sum(cvs) / max(len(cvs), 1)) / 10,
        "validity": 100.0 - 2.0 * pct(p.outlier_total, p.rows * max(len(p.columns), 1)),
        "uniqueness": 100.0 - pct(p.duplicates, p.rows),
    }
    rows = [{"axis": k, "score": max(0.0, min(100.0, v))} for k, v in axes.items()]
    return rows_frame(p.spark, rows, "axis string, score double")


def completeness(data: Table) -> DataFrame:
    """Record, cell, missing and duplicate counts with status and overall score."""
    p = profiled(data)
    share = p.missing_pct
    unique = 100.0 - pct(p.duplicates, p.rows)
    return rows_frame(p.spark, [{
        "records": p.rows, "columns": len(p.columns), "cells": p.rows * len(p.columns),
        "missing_cells": p.missing_cells, "completeness_pct": 100.0 - share, "duplicate_rows": p.duplicates,
        "duplicate_pct": pct(p.duplicates, p.rows), "numeric_columns": len(p.numeric), "text_columns": len(p.text),
        "affected_columns": sum(1 for m in p.missing.values() if m),
        "status": "good" if share < 5 else "attention" if share < 20 else "critical",
        "score": (100.0 - share + unique) / 2,
    }], "records long, columns int, cells long, missing_cells long, completeness_pct double, duplicate_rows long, "
        "duplicate_pct double, numeric_columns int, text_columns int, affected_columns int, status string, score double")
