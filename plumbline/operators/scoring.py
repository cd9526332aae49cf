"""Feature scores, leakage and preparation advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import columns as C
from plumbline.operators.association import pair_chi_square
from plumbline.operators.hypothesis import anova
from plumbline.operators.profile import Table, pct
from plumbline.operators import profile as P
from plumbline.operators.quality import letter
from plumbline.plans.frames import cut_lineage, distinct_upto, rows_frame
from plumbline.plans.profiling import Profile, profiled
from plumbline.plans.quantiles import exact_quantiles
from plumbline.plans.ranks import WINDOW_ROWS, cumulative

EULER = 0.5772156649015329
#: Values of a class that one task orders at a time; it shapes the work and not the result.
RADIUS_BLOCK = 100_000


def quantile_bin(x: Column, edges: list[float]) -> Column:
    """How many inner edges lie below the value."""
    out = F.lit(0)
    for e in edges:
        out = out + (x > F.lit(e)).cast("int")
    return out


def mutual_info(df: DataFrame, cols: list[str], target: str, bins: int = 20, classes: bool | None = None) -> DataFrame:
    """Mutual information (nats) of quantile-binned columns with the target.

    A class target is used as it is, a numeric one with more than 20 values is binned
    too. Counts of (feature, bin, class) for all features come from one scan.
    """
    p = profiled(df)
    if classes is None:
        classes = target not in p.numeric or distinct_upto(df, {target: C.quoted(target)}, 21)[target] <= 20
    binned = cols if classes else [*cols, target]
    inner = [i / bins for i in range(1, bins)]
    edges = {c: sorted(set(q)) if q[0] is not None else [] for c, q in exact_quantiles(df, binned, inner).items()}
    label = C.quoted(target).cast("string") if classes else F.when(
        C.as_number(df, target).isNotNull(), quantile_bin(C.as_number(df, target), edges[target]).cast("string"))
    cells = [F.struct(F.lit(c).alias("feature"), F.coalesce(quantile_bin(C.as_number(df, c), edges[c]), F.lit(-1)).alias("b"),
                      label.alias("y")) for c in cols]
    joint = df.select(F.explode(F.array(*cells)).alias("m")).select("m.*").where("y is not null").groupBy(
        "feature", "b", "y").agg(F.count(F.lit(1)).alias("n"))
    bx = joint.groupBy("feature", "b").agg(F.sum("n").alias("nb"))
    by = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("t"))
    every = joint.join(bx, ["feature", "b"]).join(by, ["feature", "y"]).join(total, "feature")
    share = F.col("n") / F.col("t")
    return every.groupBy("feature").agg(
        F.sum(share * F.log(F.col("n").cast("double") * F.col("t") / (F.col("nb").cast("double") * F.col("ny")))).alias("mi"))


def digamma(n: Column) -> Column:
    """The digamma function of whole numbers from 1 on: harmonic sums up to nine, the asymptotic series beyond."""
    sums = [sum(1.0 / i for i in range(1, m)) - EULER for m in range(1, 11)]
    x = n.cast("double")
    r = 1 / (x * x)
    series = F.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    return F.when(n <= 10, F.get(F.array(*[F.lit(v) for v in sums]), (n - 1).cast("int"))).otherwise(series)


def neighbour_radius(values: DataFrame, k: int, block: int = RADIUS_BLOCK, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``values`` (feature, y, x, n: how many rows of the class have the value) with ``size``, the rows of the class, ``near``, k or one less than the
    class has rows, and ``radius``, the distance from x to the near-th other row of the class.

    At most k values on either side can hold it. The values of a class are numbered in order and looked at block by block, each
    block with the k values next to it on both sides, so that no class is gathered in one task.
    """
    sized = values.join(values.groupBy("feature", "y").agg(F.sum("n").alias("size")), ["feature", "y"]).where("size > 1")
    placed = cumulative(sized.select("feature", "y", "x", "n", "size"), ["feature", "y"], [F.col("x")], window_rows=window_rows)
    own = F.floor(F.col("place") / block)
    spread = placed.withColumn("own", own).withColumn("block", F.explode(F.array_distinct(F.array(
        F.floor((F.col("place") - k) / block), own, F.floor((F.col("place") + k) / block)))))
    w = W.partitionBy("feature", "y", "block").orderBy("x")
    sides = [F.struct(F.abs(f("x", j).over(w) - F.col("x")).alias("gap"), f("n", j).over(w).alias("n")) for f in (F.lag, F.lead) for j in range(1, k + 1)]
    near = F.least(F.lit(k), F.col("size") - 1)
    beside = F.array_sort(F.filter(F.array(*sides), lambda s: s["gap"].isNotNull()))
    start = F.struct((F.col("n") - 1).cast("bigint").alias("met"), F.when(F.col("n") > F.col("near"), F.lit(0.0)).alias("radius"))
    found = F.aggregate("beside", start, lambda a, s: F.struct(
        (a["met"] + s["n"]).alias("met"), F.when(a["radius"].isNull() & (a["met"] + s["n"] >= F.col("near")), s["gap"]).otherwise(a["radius"]).alias("radius")))
    told = spread.withColumns({"near": near, "beside": beside}).where("block = own")
    return told.select("feature", "y", "x", "n", "size", "near", found["radius"].alias("radius"))


def mutual_info_nearest(
    df: DataFrame, cols: list[str], target: str, k: int = 3, bins: int = 20, classes: bool | None = None, block: int = RADIUS_BLOCK, window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Mutual information (nats, at least 0) of numeric columns with a class, estimated from nearest neighbours: (feature, mi).

    For every row the distance to its k-th neighbour within the class is set against the rows of all classes that lie nearer:
    ``psi(N) + mean psi(k) - mean psi(class size) - mean psi(rows nearer, itself included)``. Classes of a single row are left out. Equal values are folded
    first; a row with k others at its own value counts those. A numeric target with more than 20 values is cut into ``bins`` quantile classes.
    """
    p = profiled(df)
    if classes is None:
        classes = target not in p.numeric or distinct_upto(df, {target: C.quoted(target)}, 21)[target] <= 20
    if classes:
        label = C.quoted(target).cast("string")
    else:
        edges = exact_quantiles(df, [target], [i / bins for i in range(1, bins)])[target]
        label = F.when(C.as_number(df, target).isNotNull(), quantile_bin(C.as_number(df, target), sorted(set(edges)) if edges[0] is not None else []).cast("string"))
    cells = [F.struct(F.lit(c).alias("feature"), label.alias("y"), C.as_number(df, c).alias("x")) for c in cols]
    values = cut_lineage(df.select(F.explode(F.array(*cells)).alias("m")).select("m.*").where("x is not null and y is not null").groupBy(
        "feature", "y", "x").agg(F.count(F.lit(1)).alias("n")))
    points = cut_lineage(neighbour_radius(values, k, block, window_rows))
    # A row is nearer if its distance is below the radius; the millionth part keeps rounding from counting the neighbour itself.
    reach = F.col("radius") * (1 - 1e-6)
    rows = points.groupBy("feature", "x").agg(F.sum("n").alias("n"))
    events = rows.select("feature", "x", F.lit(1).alias("side"), "n", F.lit(None).cast("string").alias("y"), F.lit(None).cast("double").alias("of"))
    for side, at in ((0, F.col("x") - reach), (2, F.col("x") + reach)):
        events = events.unionByName(points.select("feature", at.alias("x"), F.lit(side).alias("side"), F.lit(0).cast("bigint").alias("n"), "y", F.col("x").alias("of")))
    counted = cumulative(events, ["feature"], [F.col("x"), F.col("side"), F.col("y"), F.col("of")], window_rows=window_rows).where("side <> 1")
    met = counted.groupBy("feature", "y", F.col("of").alias("x")).agg(F.sum(F.when(F.col("side") == 2, F.col("before")).otherwise(-F.col("before"))).alias("m"))
    parts = points.join(met, ["feature", "y", "x"]).groupBy("feature").agg(
        F.sum("n").alias("t"), F.sum(F.col("n") * (digamma(F.col("near")) - digamma(F.col("size")) - digamma(F.col("m")))).alias("s"))
    return parts.select("feature", F.greatest(F.lit(0.0), digamma(F.col("t")) + F.col("s") / F.col("t")).alias("mi"))


def class_association(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Cramer's V of text columns with a class target."""
    stats = pair_chi_square(df, [(c, target) for c in cols])
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.least("levels1", "levels2") - 1)))
    return stats.select(F.col("feature1").alias("feature"), F.coalesce(v, F.lit(0.0)).alias("score"))


def anova_scores(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """min(F / 100, 1) of a numeric target over the groups of each text column."""
    rows = []
    for c in cols:
        r = anova(df, target, c).first()
        rows.append({"feature": c, "score": min(r["f_statistic"] / 100, 1.0) if r and r["f_statistic"] is not None else 0.0})
    return rows_frame(df.sparkSession, rows, "feature string, score double")


def feature_scores(df: DataFrame, target: str, k: int = 10, bins: int = 20) -> DataFrame:
    """The k best columns: mutual information for numbers, V or F score for texts."""
    classes = distinct_upto(df, {target: C.quoted(target)}, 20)[target] < 20
    numeric = [c for c in C.numeric_columns(df) if c != target]
    text = [c for c in C.text_columns(df) if c != target]
    parts = []
    if numeric:
        parts.append(mutual_info(df, numeric, target, bins, classes).select("feature", F.col("mi").alias("score"), F.lit("numeric").alias("kind")))
    if text:
        scored = class_association(df, text, target) if classes else anova_scores(df, text, target)
        parts.append(scored.withColumn("kind", F.lit("categorical")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(F.col("score").desc(), "feature").limit(k)


def leakage_rows(p: Profile, target: str) -> list[dict]:
    rows = []
    for c in p.numeric:
        if c != target and target in p.numeric:
            r = p.correlations.get((c, target), p.correlations.get((target, c)))
            if r is not None and abs(r) > 0.99:
                rows.append({"feature": c, "reason": "perfect correlation", "severity": "high", "correlation": abs(r)})
    low = target.lower()
    for c in p.columns:
        if c != target and (low in c.lower() or c.lower() in low):
            rows.append({"feature": c, "reason": "name", "severity": "medium", "correlation": None})
    for c in p.datetime:
        if "after" in c.lower() or "post" in c.lower():
            rows.append({"feature": c, "reason": "post-event date", "severity": "medium", "correlation": None})
    return rows


def target_leakage(data: Table, target: str) -> DataFrame:
    p = profiled(data)
    return rows_frame(p.spark, leakage_rows(p, target), "feature string, reason string, severity string, correlation double")


def balance_advice(data: Table, target: str) -> DataFrame:
    """Class imbalance with the rows needed for a 1:2 ratio and advice."""
    p = profiled(data)
    r = P.imbalance(p, [target]).first()
    schema = ("imbalanced boolean, imbalance_ratio double, majority_class string, minority_class string, minority_pct double, "
              "severity string, smote_recommended boolean, samples_to_generate long, recommendations string")
    if r is None:
        return rows_frame(p.spark, [], schema)
    values = p.df.where(C.quoted(target).isNotNull()).count()
    major, minor = round(values * r["majority_pct"] / 100), round(values * r["minority_pct"] / 100)
    ratio = r["imbalance_ratio"]
    smote = ratio > 3 and minor > 6
    advice = []
    if ratio > 10:
        advice += ["oversample with SMOTE", "consider balanced ensembles"]
    elif ratio > 5:
        advice += ["use class weights", "consider SMOTE above 50 minority rows"]
    elif ratio > 2:
        advice += ["use class weights", "monitor precision and recall"]
    if minor < 30:
        advice.append("collect more minority rows")
    return rows_frame(p.spark, [{
        "imbalanced": ratio > 1.5, "imbalance_ratio": ratio, "majority_class": r["majority_class"],
        "minority_class": r["minority_class"], "minority_pct": r["minority_pct"], "severity": r["severity"],
        "smote_recommended": smote, "samples_to_generate": int(0.5 * major - minor) if smote else 0,
        "recommendations": "; ".join(advice)}], schema)


def recommend_transforms(data: Table) -> DataFrame:
    """Up to three transforms per numeric column from skew, outliers and range."""
    p = profiled(data)
    rows = []
    for c in p.filled:
        m = p.moments[c]
        if m["n"] < 10:
            continue
        advice = []
        if abs(m["skew"]) > 1:
            advice += (["log_transform"] if m["skew"] > 0 and m["min"] > 0 else []) + ["sqrt_transform", "box_cox"]
        share = p.outliers[c]["n"] / m["n"]
        if share > 0.05:
            advice += ["robust_scaling", "winsorization"]
        advice += ["already_normalized"] if m["min"] >= 0 and m["max"] <= 1 else ["min_max_scaling", "standard_scaling"]
        rows.append({"column": c, "recommended": ", ".join(advice[:3]), "skew": m["skew"], "outlier_pct": 100 * share})
    return rows_frame(p.spark, rows, "column string, recommended string, skew double, outlier_pct double")


def recommend_encodings(data: Table, target: str | None = None) -> DataFrame:
    """Two encodings per text column by the number of its values."""
    p = profiled(data)
    rows = []
    for c in p.text:
        if c == target:
            continue
        d = p.distinct[c]
        if d == 2:
            advice = ["label_encoding", "binary_encoding"]
        elif d <= 10:
            advice = ["one_hot_encoding"] + (["target_encoding"] if target else [])
        elif d <= 50:
            advice = ["target_encoding", "frequency_encoding"]
        else:
            advice = ["frequency_encoding", "target_encoding"]
        rows.append({"column": c, "recommended": ", ".join(advice), "distinct_values": d,
                     "cardinality": "high" if p.rows and d / p.rows > 0.5 else "low"})
    return rows_frame(p.spark, rows, "column string, recommended string, distinct_values long, cardinality string")


def transform_counts(data: Table, target: str | None = None) -> DataFrame:
    p = profiled(data)
    advised = recommend_transforms(p).select("recommended").unionByName(recommend_encodings(p, target).select("recommended"))
    return advised.select(F.explode(F.split("recommended", ", ")).alias("transform")).groupBy("transform").agg(
        F.count(F.lit(1)).alias("columns"))


def imputation_advice(data: Table) -> DataFrame:
    p = profiled(data)
    rows = []
    for c, m in p.missing.items():
        share = pct(m, p.rows)
        if not m:
            continue
        if share > 50:
            advice = "drop column"
        elif share > 20:
            advice = "multiple imputation"
        else:
            advice = "mean, median or knn" if c in p.numeric else "mode"
        rows.append({"column": c, "missing": m, "missing_pct": share, "strategy": advice})
    return rows_frame(p.spark, rows, "column string, missing long, missing_pct double, strategy string")


def readiness_score(p: Profile, target: str) -> float:
    score = 100.0 - min(20.0, p.missing_pct)
    tilt = P.imbalance(p, [target]).first()
    if tilt is not None:
        score -= {"severe": 15, "moderate": 10}.get(tilt["severity"], 0)
    return max(0.0, score - 10 * len(leakage_rows(p, target)))


def ml_readiness(data: Table, target: str | None = None) -> DataFrame:
    """With a target: score and grade. Without: missing and duplicate shares and type counts."""
    p = profiled(data)
    if target is not None:
        score = readiness_score(p, target)
        return rows_frame(p.spark, [{"target": target, "score": score, "grade": letter(score)}],
                          "target string, score double, grade string")
    return rows_frame(p.spark, [{"missing_pct": p.missing_pct, "duplicate_pct": pct(p.duplicates, p.rows),
                      "numeric_features": len(p.numeric), "categorical_features": len(p.text)}],
                      "missing_pct double, duplicate_pct double, numeric_features int, categorical_features int")
