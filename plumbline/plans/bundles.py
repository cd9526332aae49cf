"""Bundles: many operators over one shared Profile."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from plumbline.operators import association, hypothesis, insights, profile, quality, scoring, structure
from plumbline.plans.frames import rows_frame
from plumbline.plans.profiling import profiled


def full_profile(data) -> dict[str, DataFrame]:
    """Automatic analysis of one table."""
    p = profiled(data)
    return {
        "summary": profile.table_summary(p),
        "columns": profile.column_profile(p),
        "types": profile.type_counts(p),
        "missing": profile.missing_by_column(p, only_missing=False),
        "statistics": profile.numeric_stats(p),
        "modality": profile.modality(p),
        "categorical": profile.categorical_stats(p, denominator="rows"),
        "correlations": association.corr_pairs(p),
        "quality": quality.quality_score(p),
        "radar": quality.quality_radar(p),
        "insights": insights.insights(p),
        "recommendations": insights.recommendations(p),
        "normality": hypothesis.normality_heuristic(p),
    }


def enterprise_profile(data, as_of: datetime, target: str | None = None) -> dict[str, DataFrame]:
    """Quality, structure, statistics, association and readiness with summary and advice."""
    p = profiled(data)
    parts = {
        "dri": quality.dri(p, as_of),
        "semantic_types": structure.semantic_types(p),
        "primary_keys": structure.primary_keys(p),
        "dependencies": structure.functional_dependencies(p),
        "schema": structure.schema_quality(p),
        "statistics": hypothesis.statistical_summary(p),
        "associations": association.association_summary(p),
        "readiness": scoring.ml_readiness(p, target),
        "transforms": scoring.recommend_transforms(p),
    }
    if target:
        parts["leakage"] = scoring.target_leakage(p, target)
        parts["feature_scores"] = scoring.feature_scores(p.df, target)
    scores = {r["component"]: r["score"] for r in parts["dri"].collect()}
    schema = parts["schema"].first()
    counts = parts["associations"].first()
    flags = [r for r in parts["statistics"].collect() if r["subject"]]
    ready = parts["readiness"].first()["score"] if target else None
    suspects = parts["leakage"].count() if target else 0
    parts["summary"] = rows_frame(p.spark, [{
        "rows": p.rows, "columns": len(p.columns), "dri": scores["total"], "grade": quality.letter(scores["total"]),
        "schema_score": schema["quality_score"], "high_correlations": counts["pearson_high"],
        "multicollinear": counts["multicollinear"], "readiness": ready,
    }], "rows long, columns int, dri double, grade string, schema_score double, high_correlations int, "
        "multicollinear long, readiness double")
    advice = []

    def add(area: str, priority: str, title: str, value) -> None:
        advice.append({"area": area, "priority": priority, "title": title, "value": None if value is None else float(value)})

    if scores["total"] < 80:
        add("quality", "high", "reliability index below 80", scores["total"])
    if not schema["has_primary_key"]:
        add("structure", "medium", "no primary key", None)
    if flags:
        add("statistics", "medium", "statistical issues", len(flags))
    if counts["multicollinear"]:
        add("features", "high", "features with high inflation", counts["multicollinear"])
    if ready is not None and ready < 70:
        add("preparation", "high", "table not ready for training", ready)
    if suspects:
        add("leakage", "critical", "leakage suspects", suspects)
    parts["advice"] = rows_frame(p.spark, advice, "area string, priority string, title string, value double")
    return parts
