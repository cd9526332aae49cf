"""Rule-based findings as rows (family, kind, title, subject, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.operators import profile as P
from plumbline.operators.profile import Table, pct, trend_label
from plumbline.plans.frames import rows_frame
from plumbline.plans.profiling import Profile, profiled

ROW = "family string, kind string, title string, subject string, value double"


def _row(family: str, kind: str, title: str, subject: str | None = None, value: float | None = None) -> dict:
    return {"family": family, "kind": kind, "title": title, "subject": subject, "value": value}


def _pairs(p: Profile, bound: float) -> list[tuple[str, str, float]]:
    return [(a, b, r) for (a, b), r in p.correlations.items() if r is not None and abs(r) > bound]


def _general(p: Profile) -> list[dict]:
    rows = []
    holes = sorted(((pct(m, p.rows), c) for c, m in p.missing.items() if pct(m, p.rows) > 5), key=lambda t: -t[0])
    if holes:
        rows.append(_row("general", "warning", "high missing data", holes[0][1], holes[0][0]))
    wild = sorted(((pct(p.outliers[c]["n"], p.rows), c) for c in p.filled if pct(p.outliers[c]["n"], p.rows) > 5), key=lambda t: -t[0])
    if wild:
        rows.append(_row("general", "info", "outliers detected", wild[0][1], wild[0][0]))
    strong = _pairs(p, 0.8)
    if strong:
        rows.append(_row("general", "success", "strong patterns", f"{strong[0][0]} ~ {strong[0][1]}", strong[0][2]))
    skewed = [c for c in p.filled if abs(p.moments[c]["skew"]) > 2]
    if skewed:
        rows.append(_row("general", "info", "skewed distribution", skewed[0], p.moments[skewed[0]]["skew"]))
    if p.missing_cells == 0 and not wild:
        rows.append(_row("general", "success", "clean table"))
    return rows


def _trend(p: Profile) -> list[dict]:
    shape = {r["column"]: r["modality"] for r in P.modality(p).collect()}
    rows = []
    for c in p.filled:
        if abs(p.moments[c]["skew"]) > 1.5:
            rows.append(_row("trend", trend_label(p.moments[c]["skew"]), "distribution bias", c, p.moments[c]["skew"]))
        if shape[c] == "multimodal":
            rows.append(_row("trend", "multimodal", "latent groups", c))
    return rows or [_row("trend", "info", "numeric stability")]


def _segmentation(p: Profile) -> list[dict]:
    rows = []
    if p.text:
        top = {r["column"]: r for r in P.top_values(p, 1).collect()}
        for c in p.text:
            if c in top and pct(top[c]["n"], p.rows) > 70:
                rows.append(_row("segmentation", "imbalance", "dominant category", f"{c} = {top[c]['value']}", pct(top[c]["n"], p.rows)))
            if p.rows < 1000 and p.distinct[c] > 50:
                rows.append(_row("segmentation", "sparse", "sparse labels", c, float(p.distinct[c])))
    return rows or [_row("segmentation", "info", "balanced segmentation")]


def _behaviour(p: Profile) -> list[dict]:
    rows = []
    strong = _pairs(p, 0.85)
    if strong:
        rows.append(_row("behaviour", "redundancy", "information redundancy", f"{strong[0][0]} ~ {strong[0][1]}", strong[0][2]))
    if p.rows and p.outlier_total > 0.1 * p.rows:
        rows.append(_row("behaviour", "volatility", "high volatility", None, float(p.outlier_total)))
    return rows or [_row("behaviour", "info", "predictive coherence")]


def _comparative(p: Profile) -> list[dict]:
    """Variation of the first numeric column across the first text column, as eta squared."""
    from plumbline.operators.association import correlation_ratio

    if p.filled and p.text:
        r = correlation_ratio(p.df, [p.filled[0]], [p.text[0]]).first()
        return [_row("comparative", "variance", "variation across groups", f"{p.filled[0]} by {p.text[0]}", r["eta_squared"] if r else None)]
    return [_row("comparative", "info", "univariate consistency")]


FAMILIES = {"general": _general, "trend": _trend, "segmentation": _segmentation, "behaviour": _behaviour, "comparative": _comparative}


def insights(data: Table, family: str | None = None) -> DataFrame:
    p = profiled(data)
    chosen = FAMILIES.values() if family is None else [FAMILIES[family]]
    return rows_frame(p.spark, [r for f in chosen for r in f(p)], ROW)


def recommendations(data: Table) -> DataFrame:
    """Missing cells, duplicate rows and outlier columns worth treating; else that the table is clean."""
    p = profiled(data)
    rows = []
    if p.missing_pct > 5:
        rows.append(_row("recommendation", "missing", "handle missing values", None, p.missing_pct))
    if p.duplicates:
        rows.append(_row("recommendation", "duplicates", "remove duplicate rows", None, float(p.duplicates)))
    for c in p.filled:
        n = p.moments[c]["n"]
        if n > 3 and p.outliers[c]["n"] / n > 0.05:
            rows.append(_row("recommendation", "outliers", "cap or remove outliers", c, float(p.outliers[c]["n"])))
    return rows_frame(p.spark, rows or [_row("recommendation", "clean", "proceed to modelling")], ROW)


def prioritized_recommendations(data: Table) -> DataFrame:
    p = profiled(data)
    rows = []

    def add(priority: str, title: str, value: float | None = None) -> None:
        rows.append({"position": len(rows) + 1, "priority": priority, "title": title, "value": value})

    if p.missing_pct > 20:
        add("critical", "handle missing data", p.missing_pct)
    elif p.missing_pct > 5:
        add("high", "address missing data", p.missing_pct)
    if p.duplicates:
        add("high", "remove duplicate rows", float(p.duplicates))
    if any(r is not None and 0.8 < abs(r) < 1.0 for r in p.correlations.values()):
        add("high", "check multicollinearity")
    if p.numeric:
        add("medium", "scale features")
    if p.text:
        add("medium", "encode categorical columns")
    add("medium", "detect and treat outliers")
    add("low", "select features")
    add("low", "split into train and test")
    return rows_frame(p.spark, rows, "position int, priority string, title string, value double")


def key_insights(data: Table) -> DataFrame:
    p = profiled(data)
    complete = 100.0 - p.missing_pct
    skewed = [c for c in p.filled if abs(p.moments[c]["skew"]) > 1]
    strong = len(_pairs(p, 0.7))
    rows = [_row("key", "good" if complete >= 95 else "warning", "completeness", None, complete),
            _row("key", "good" if not p.duplicates else "warning", "duplicates", None, float(p.duplicates))]
    if skewed:
        rows.append(_row("key", "info", "skewed distributions", ", ".join(skewed[:3]), float(len(skewed))))
    if strong:
        rows.append(_row("key", "info", "multicollinearity", None, float(strong)))
    if p.text:
        rows.append(_row("key", "info", "categorical columns", None, float(len(p.text))))
    rows.append(_row("key", "info", "column types", f"{len(p.numeric)} numeric, {len(p.text)} text", float(len(p.columns))))
    return rows_frame(p.spark, rows, ROW)


def top_finding(data: Table, topic: str) -> DataFrame:
    """The one most telling row on missing, correlation, outlier, quality or skew."""
    from plumbline.operators.quality import quality_value

    p = profiled(data)
    subject, value, trust = None, None, 0.9
    if topic == "missing":
        subject, value = max(p.missing.items(), key=lambda t: t[1])
    elif topic == "correlation":
        best = max(((abs(r), f"{a} ~ {b}", r) for (a, b), r in p.correlations.items() if r is not None), default=None)
        if best:
            subject, value = best[1], best[2]
    elif topic == "outlier":
        subject = max(p.filled, key=lambda c: p.outliers[c]["n"], default=None)
        value = p.outliers[subject]["n"] if subject else None
    elif topic == "skew":
        subject = max(p.filled, key=lambda c: abs(p.moments[c]["skew"]), default=None)
        value = p.moments[subject]["skew"] if subject else None
    elif topic == "quality":
        subject, value = "table", quality_value(p)
    else:
        raise ValueError(f"unknown topic {topic!r}")
    if value is None:
        trust = 0.3
    return rows_frame(p.spark, [{"topic": topic, "subject": subject, "value": None if value is None else float(value), "confidence": trust}],
                      "topic string, subject string, value double, confidence double")
