"""Correlation, association and linear algebra over columns."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.operators.profile import Table
from plumbline.plans.frames import rows_frame
from plumbline.plans.products import pair_sums
from plumbline.plans.profiling import Profile, profiled
from plumbline.plans.ranks import average_rank, cumulative

PAIR = "feature1 string, feature2 string, r double"


def corr_strength(r: float) -> str:
    r = abs(r)
    return "very strong" if r >= 0.9 else "strong" if r >= 0.7 else "moderate" if r >= 0.4 else "weak"


def corr_matrix(data: Table, method: str = "pearson") -> DataFrame:
    """r for every ordered pair of numeric columns; null where one of them is constant."""
    p = profiled(data)
    pairs = p.correlations if method == "pearson" else spearman_pairs(p)
    rows = [{"feature1": c, "feature2": c, "r": 1.0 if p.moments[c]["min"] != p.moments[c]["max"] else None} for c in p.numeric]
    for (a, b), r in pairs.items():
        rows += [{"feature1": a, "feature2": b, "r": r}, {"feature1": b, "feature2": a, "r": r}]
    return rows_frame(p.spark, rows, PAIR)


def spearman_pairs(p: Profile) -> dict[tuple[str, str], float | None]:
    """Pearson r of average ranks over the rows where both columns are present.

    Columns without nulls share one ranking each. A pair with nulls is ranked on its
    own complete rows.
    """
    whole = [c for c in p.numeric if p.moments[c]["n"] == p.rows and p.rows]
    found: dict[tuple[str, str], float | None] = {}
    if len(whole) > 1:
        ranked = ranked_columns(p.df.select(*[p.number(c).alias(c) for c in whole]), whole, p.rows)
        q = Profile(ranked)
        found.update(q.correlations)
    for a, b in combinations(p.numeric, 2):
        if (a, b) not in found:
            both = p.df.select(p.number(a).alias(a), p.number(b).alias(b)).where(
                F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull())
            found[(a, b)] = Profile(ranked_columns(both, [a, b])).correlations[(a, b)]
    return found


def ranked_columns(df: DataFrame, cols: list[str], rows: int | None = None) -> DataFrame:
    """Replace each value by its average rank.

    Ranks live on the distinct values of a column; they reach the rows through
    a join on (column, value) that hot values pass by broadcast.
    """
    from plumbline.plans.lookups import lookup_join

    rows = df.count() if rows is None else rows
    out = df.select(*[C.quoted(c) for c in cols])
    for i, c in enumerate(cols):
        counts = df.groupBy(C.quoted(c).alias(c)).agg(F.count(F.lit(1)).alias("n"))
        ranks = cumulative(counts, [], [C.quoted(c)], rows=rows).select(
            C.quoted(c), "n", average_rank(F.col("before"), F.col("n")).alias(f"_rank{i}"))
        out = lookup_join(out, ranks, c, [f"_rank{i}"])
    return out.select(*[F.col(f"_rank{i}").alias(c) for i, c in enumerate(cols)])


def corr_pairs(data: Table) -> DataFrame:
    """Each pair once, with direction and strength, strongest first."""
    p = profiled(data)
    rows = [{"feature1": a, "feature2": b, "r": r, "direction": "positive" if r > 0 else "negative",
             "strength": corr_strength(r)} for (a, b), r in p.correlations.items() if r is not None]
    rows.sort(key=lambda x: -abs(x["r"]))
    return rows_frame(p.spark, rows, PAIR + ", direction string, strength string")


def high_pairs(data: Table, threshold: float = 0.7) -> DataFrame:
    return corr_pairs(data).where(F.abs("r") > threshold)


def target_correlation(data: Table, target: str) -> DataFrame:
    p = profiled(data)
    rows = [{"feature": a if b == target else b, "r": r} for (a, b), r in p.correlations.items()
            if target in (a, b) and r is not None]
    rows.sort(key=lambda x: -x["r"])
    return rows_frame(p.spark, rows, "feature string, r double")


def corr_network(data: Table, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): pairs beyond the threshold, and every column with its degree."""
    p = profiled(data)
    edges = [{"src": a, "dst": b, "weight": r} for (a, b), r in p.correlations.items() if r is not None and abs(r) > threshold]
    nodes = [{"node": c, "degree": sum(c in (e["src"], e["dst"]) for e in edges)} for c in p.numeric]
    return (rows_frame(p.spark, edges, "src string, dst string, weight double"),
            rows_frame(p.spark, nodes, "node string, degree int"))


def redundant_groups(data: Table, threshold: float = 0.9) -> DataFrame:
    """Greedy groups in column order: a column and all columns beyond the threshold with it."""
    p = profiled(data)
    strong: dict[str, set] = {c: {c} for c in p.numeric}
    for (a, b), r in p.correlations.items():
        if r is not None and abs(r) > threshold:
            strong[a].add(b)
            strong[b].add(a)
    rows, seen = [], set()
    for c in p.numeric:
        if c not in seen and len(strong[c]) > 1:
            group = [x for x in p.numeric if x in strong[c]]
            rows.append({"lead": c, "members": ", ".join(group), "size": len(group)})
            seen.update(group)
    return rows_frame(p.spark, rows, "lead string, members string, size int")


def check_hypothesis(data: Table, a: str, b: str) -> DataFrame:
    p = profiled(data)
    r = p.correlations.get((a, b), p.correlations.get((b, a)))
    verdict = "untestable" if r is None else "supported" if abs(r) >= 0.5 else "weak"
    return rows_frame(p.spark, [{"feature1": a, "feature2": b, "r": r, "verdict": verdict}], PAIR + ", verdict string")


# ---- categorical association --------------------------------------------------------------

def pair_chi_square(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Chi-square of several column pairs at once, from one melted count table.

    Empty cells need no rows: each adds its expected count, and all expected counts
    sum to N. For a 2x2 table the continuity-corrected value is formed from the
    four counts.
    """
    cells = [F.struct(F.lit(i).alias("pair"), F.lit(a).alias("feature1"), F.lit(b).alias("feature2"),
                      C.quoted(a).cast("string").alias("a"), C.quoted(b).cast("string").alias("b"))
             for i, (a, b) in enumerate(pairs)]
    keys = ["pair", "feature1", "feature2"]
    counts = (
        df.select(F.explode(F.array(*cells)).alias("m")).select("m.*").where("a is not null and b is not null")
        .groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("o"))
    )
    row_sums = counts.groupBy("pair", "a").agg(F.sum("o").alias("ra"))
    col_sums = counts.groupBy("pair", "b").agg(F.sum("o").alias("cb"))
    totals = counts.groupBy("pair").agg(F.sum("o").alias("n"))
    shape = row_sums.groupBy("pair").agg(F.count(F.lit(1)).alias("levels1"), F.min("ra").alias("r1")).join(
        col_sums.groupBy("pair").agg(F.count(F.lit(1)).alias("levels2"), F.min("cb").alias("c1")), "pair").join(totals, "pair")
    raw = (
        counts.join(row_sums, ["pair", "a"]).join(col_sums, ["pair", "b"])
        .join(totals.withColumnRenamed("n", "_n"), "pair")
        .withColumn("e", F.col("ra").cast("double") * F.col("cb") / F.col("_n"))
        .groupBy(*keys).agg(
            F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e")).alias("s"),
            F.sum("e").alias("seen"), F.count(F.lit(1)).alias("cells"))
        .join(shape, "pair")
    )
    unseen = F.when(F.col("cells") < F.col("levels1") * F.col("levels2"), F.col("n") - F.col("seen")).otherwise(0.0)
    plain = F.col("s") + unseen
    # 2x2: every |O-E| is the same d, and sum(1/E) = n^3 / (r1 r2 c1 c2).
    n, r1, c1 = (F.col(x).cast("double") for x in ("n", "r1", "c1"))
    inverse = n * n * n / (r1 * (n - r1) * c1 * (n - c1))
    d = F.sqrt(F.greatest(plain, F.lit(0.0)) / inverse)
    shrunk = d - F.least(F.lit(0.5), d)
    chi2 = F.when((F.col("levels1") == 2) & (F.col("levels2") == 2), shrunk * shrunk * inverse).otherwise(
        F.greatest(plain, F.lit(0.0)))
    usable = (F.col("levels1") >= 2) & (F.col("levels2") >= 2)
    return raw.select(
        "feature1", "feature2", F.when(usable, chi2).otherwise(0.0).alias("chi2"), "n", "levels1", "levels2",
        ((F.col("levels1") - 1) * (F.col("levels2") - 1)).alias("dof"))


def cramers_v(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or C.text_columns(df)
    stats = pair_chi_square(df, list(combinations(cols, 2)))
    v = F.least(F.lit(1.0), F.sqrt(F.try_divide(
        F.col("chi2"), F.col("n") * (F.least("levels1", "levels2") - 1))))
    v = F.coalesce(v, F.lit(0.0))
    label = F.when(v < 0.1, "negligible").when(v < 0.3, "weak").when(v < 0.5, "moderate").otherwise("strong")
    return stats.select("feature1", "feature2", v.alias("cramers_v"), label.alias("strength"))


def correlation_ratio(df: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None,
                      min_eta: float | None = None) -> DataFrame:
    """Eta squared of every numeric column over the groups of every text column.

    One pass reduces the rows to (pair, group): count, sum and sum of squares about
    the column mean.
    """
    numeric = C.numeric_columns(df) if numeric is None else numeric
    categorical = C.text_columns(df) if categorical is None else categorical
    means = profiled(df.select(*[C.quoted(c) for c in numeric])).moments
    parts = []
    for c in categorical:
        values = [F.struct(F.lit(c).alias("categorical"), F.lit(x).alias("numeric"),
                           (C.as_number(df, x) - F.lit(means[x]["mean"])).alias("d")) for x in numeric if means[x]["n"]]
        if values:
            parts.append((c, values))
    frame = None
    for c, values in parts:
        grouped = (
            df.where(C.quoted(c).isNotNull()).select(C.quoted(c).cast("string").alias("g"), F.explode(F.array(*values)).alias("m"))
            .select("g", "m.*").where("d is not null").groupBy("categorical", "numeric", "g")
            .agg(F.count("d").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"))
        )
        one = grouped.groupBy("categorical", "numeric").agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
            F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
        frame = one if frame is None else frame.unionByName(one)
    if frame is None:
        return df.sparkSession.createDataFrame([], "categorical string, numeric string, eta_squared double, strength string")
    grand = F.col("s") * F.col("s") / F.col("n")
    eta = F.coalesce(F.try_divide(F.col("between") - grand, F.col("ss") - grand), F.lit(0.0))
    eta = F.when(F.col("groups") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), eta)))
    label = F.when(eta < 0.3, "weak").when(eta < 0.7, "moderate").otherwise("strong")
    out = frame.select("categorical", "numeric", eta.alias("eta_squared"), label.alias("strength"))
    return out if min_eta is None else out.where(F.col("eta_squared") > min_eta)


# ---- linear algebra -----------------------------------------------------------------------

def gram(df: DataFrame, cols: list[str], fill: float | None = None, centre: dict[str, float] | None = None):
    """(rows, sums, cross products) of the columns as numpy: one scan, d x d numbers.

    Rows with a null are left out unless ``fill`` is given.
    """
    xs = [F.coalesce(C.as_number(df, c), F.lit(fill)) if fill is not None else C.as_number(df, c) for c in cols]
    if centre:
        xs = [x - F.lit(float(centre[c])) for x, c in zip(xs, cols)]
    base = df.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)]).dropna()
    if not cols:
        return base.count(), np.zeros(0), np.zeros((0, 0))
    s = pair_sums(base, [F.col(f"x{i}") for i in range(len(cols))], complete=True)
    return int(s.n[0, 0]), np.diag(s.x).copy(), s.xy


def covariance(df: DataFrame, cols: list[str], fill: float | None = None):
    """(rows, means, sample covariance); values are centred before they are multiplied."""
    base = df if fill is None else df.select(*[F.coalesce(C.as_number(df, c), F.lit(fill)).alias(c) for c in cols])
    complete = base.select(*[C.as_number(base, c).alias(c) for c in cols]).dropna()
    rough = complete.agg(*[F.avg(C.quoted(c)) for c in cols]).first()
    centre = {c: v or 0.0 for c, v in zip(cols, rough)}
    n, sums, cross = gram(complete, cols, centre=centre)
    means = np.array([centre[c] for c in cols])
    if n < 2:
        return n, means, np.zeros((len(cols), len(cols)))
    return n, means + sums / n, (cross - np.outer(sums, sums) / n) / (n - 1)


def vif(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Variance inflation per column, missing values as zero; collinear or constant gives infinity."""
    cols = cols or C.numeric_columns(df)
    _, _, cov = covariance(df, cols, fill=0.0)
    rows = []
    for i, c in enumerate(cols):
        others = [j for j in range(len(cols)) if j != i]
        if not others:
            continue
        if cov[i, i] <= 0:
            r2 = 1.0
        else:
            explained = cov[i, others] @ np.linalg.pinv(cov[np.ix_(others, others)], rcond=1e-12) @ cov[others, i]
            r2 = float(explained / cov[i, i])
        value = 1.0 / (1.0 - r2) if r2 < 0.9999 else float("inf")
        rows.append({"feature": c, "vif": value, "multicollinearity": "low" if value < 5 else "moderate" if value < 10 else "high"})
    return rows_frame(df.sparkSession, rows, "feature string, vif double, multicollinearity string")


def linear_algebra(df: DataFrame, cols: list[str]) -> dict[str, DataFrame]:
    """Covariance, correlation and Gram matrix with eigenpairs, singular values and rank."""
    spark = df.sparkSession
    n, _, cov = covariance(df, cols)
    _, _, xtx = gram(df, cols)
    sd = np.sqrt(np.diag(cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = cov / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    singular = np.sqrt(np.clip(np.linalg.eigvalsh(xtx)[::-1], 0.0, None))
    limit = singular.max(initial=0.0) * max(n, len(cols)) * np.finfo(float).eps
    cells = [{"row": a, "column": b, "covariance": float(cov[i, j]),
              "correlation": None if np.isnan(corr[i, j]) else float(corr[i, j]), "gram": float(xtx[i, j])}
             for i, a in enumerate(cols) for j, b in enumerate(cols)]
    pairs, spectrum = [], []
    for k, o in enumerate(order):
        v = vectors[:, o]
        v = v if v[np.argmax(np.abs(v))] > 0 else -v
        spectrum.append({"component": k, "eigenvalue": float(values[o]), "singular_value": float(singular[k])})
        pairs += [{"component": k, "column": c, "loading": float(v[i])} for i, c in enumerate(cols)]
    return {
        "matrices": rows_frame(spark, cells, "row string, column string, covariance double, correlation double, gram double"),
        "spectrum": rows_frame(spark, spectrum, "component int, eigenvalue double, singular_value double"),
        "eigenvectors": rows_frame(spark, pairs, "component int, column string, loading double"),
        "rank": rows_frame(spark, [{"rows": n, "columns": len(cols), "rank": int((singular > limit).sum())}],
                           "rows long, columns int, rank int"),
    }


def vector_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = C.as_number(df, a), C.as_number(df, b)
    base = df.select(x.alias("x"), y.alias("y")).dropna()
    sums = base.agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm_a"),
                    F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm_b"), F.count(F.lit(1)).alias("n"))
    return sums.select("dot", "norm_a", "norm_b", F.try_divide("dot", F.col("norm_a") * F.col("norm_b")).alias("cosine"), "n")


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = C.as_number(df, x), C.as_number(df, y)
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_count(b, a).alias("n"))


def association_summary(data: Table) -> DataFrame:
    """How many strong pairs, associations, collinear and redundant columns the table has."""
    p = profiled(data)
    strong = sum(1 for r in p.correlations.values() if r is not None and abs(r) > 0.7)
    ranked = sum(1 for r in spearman_pairs(p).values() if r is not None and abs(r) > 0.7) if len(p.numeric) > 1 else 0
    assoc = cramers_v(p.df).where("cramers_v > 0.5").count() if len(p.text) > 1 else 0
    mixed = correlation_ratio(p.df, min_eta=0.3).count() if p.text and p.numeric else 0
    collinear = vif(p.df).where("vif > 10").count() if len(p.numeric) > 1 else 0
    extra = redundant_groups(p).agg(F.coalesce(F.sum(F.col("size") - 1), F.lit(0))).first()[0]
    return rows_frame(p.spark, [{"pearson_high": strong, "spearman_high": ranked, "categorical_associations": assoc,
                      "mixed_correlations": mixed, "multicollinear": collinear, "redundant_features": extra}],
                      "pearson_high int, spearman_high int, categorical_associations long, mixed_correlations long, "
                      "multicollinear long, redundant_features long")
