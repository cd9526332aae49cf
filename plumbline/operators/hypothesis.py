"""Statistical tests. Spark reduces the table to sufficient statistics; the tail
probability is a scalar function of the result row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.functions import tails
from plumbline.functions.distributions import gamma_cdf, normal_cdf
from plumbline.operators import profile as P
from plumbline.operators.association import pair_chi_square
from plumbline.operators.profile import Table
from plumbline.plans.frames import rows_frame
from plumbline.plans.profiling import Profile, profiled
from plumbline.plans.quantiles import exact_quantiles
from plumbline.plans.ranks import average_rank, cumulative
from plumbline.plans.sampling import take_per_class


def probability(df: DataFrame, col: str, value: float) -> DataFrame:
    """Normal and empirical probability of a value, and the mass within 1, 2, 3 deviations."""
    x = C.as_number(df, col)
    r = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
               F.avg((x <= value).cast("double")).alias("share")).first()
    z = (value - r["mean"]) / r["std"] if r["std"] else None
    within = [1 - 2 * tails.normal_sf(k) if r["std"] else None for k in (1, 2, 3)]
    return rows_frame(df.sparkSession, [{
        "column": col, "n": r["n"], "mean": r["mean"], "std": r["std"], "z_score": z,
        "p_below_normal": None if z is None else tails.normal_cdf(z),
        "p_above_normal": None if z is None else tails.normal_sf(z), "empirical_p_below": r["share"],
        "within_1_std": within[0], "within_2_std": within[1], "within_3_std": within[2],
    }], "column string, n long, mean double, std double, z_score double, p_below_normal double, p_above_normal double, "
        "empirical_p_below double, within_1_std double, within_2_std double, within_3_std double")


def mean_ci(df: DataFrame, col: str, level: float = 0.95, by: str | None = None) -> DataFrame:
    """t interval of the mean, overall or per group; the level is kept in [0.5, 0.999]."""
    level = min(0.999, max(0.5, level))
    x = C.as_number(df, col)
    label = F.lit("all") if by is None else C.quoted(by).cast("string")
    groups = df.select(label.alias("group"), x.alias("x")).where("x is not null and group is not null").groupBy("group").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")).where("n >= 2")

    def attach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t = np.array([tails.t_ppf(0.5 + level / 2, n - 1) for n in b["n"]], dtype=float)
            margin = t * b["std"].to_numpy() / np.sqrt(b["n"].to_numpy())
            yield b.assign(level=level, margin=margin, low=b["mean"] - margin, high=b["mean"] + margin)

    return groups.mapInPandas(attach, "group string, n long, mean double, std double, level double, margin double, "
                              "low double, high double")


def _groups(df: DataFrame, value: str, group: str, names: list | None = None) -> DataFrame:
    """(group, n, mean, var) of a value column; partial aggregation keeps hot groups spread."""
    x = C.as_number(df, value)
    rows = df.select(C.quoted(group).cast("string").alias("group"), x.alias("x")).where("group is not null and x is not null")
    if names:
        rows = rows.where(F.col("group").isin([str(n) for n in names]))
    return rows.groupBy("group").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))


def welch_ttest(df: DataFrame, value: str, group: str, a=None, b=None) -> DataFrame:
    """Two groups (the first two in sorted order unless named), unequal variances."""
    named = [a, b] if a is not None and b is not None else None
    two = _groups(df, value, group, named).orderBy("group").limit(2).collect()
    if len(two) < 2:
        raise ValueError("two groups are needed")
    x, y = (two if named is None else sorted(two, key=lambda r: named.index(next(n for n in named if str(n) == r["group"]))))
    return rows_frame(df.sparkSession, [{"group_a": x["group"], "group_b": y["group"],
                      **_t_row(x["n"], x["mean"], x["var"], y["n"], y["mean"], y["var"], pooled=False)}],
                      "group_a string, group_b string, " + T_ROW)


T_ROW = "mean_a double, mean_b double, statistic double, df double, p_value double"


def _t_row(n1, m1, v1, n2, m2, v2, pooled: bool) -> dict:
    if pooled:
        dof = n1 + n2 - 2
        v = ((n1 - 1) * v1 + (n2 - 1) * v2) / dof
        se2 = v * (1 / n1 + 1 / n2)
    else:
        a, b = v1 / n1, v2 / n2
        se2 = a + b
        dof = se2 * se2 / (a * a / (n1 - 1) + b * b / (n2 - 1)) if se2 else float("nan")
    t = (m1 - m2) / math.sqrt(se2) if se2 else None
    return {"mean_a": m1, "mean_b": m2, "statistic": t, "df": float(dof),
            "p_value": None if t is None else tails.t_two_sided(t, dof)}


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way analysis of variance over groups of at least two rows."""
    return _anova(_groups(df, value, group).where("n >= 2"))


def _anova(groups: DataFrame) -> DataFrame:
    centred = groups.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"),
                         (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    r = centred.first()
    spark = groups.sparkSession
    schema = "groups long, rows long, ss_between double, ss_within double, f_statistic double, p_value double"
    if r["groups"] is None or r["groups"] < 2:
        return rows_frame(spark, [], schema)
    s = groups.agg(F.sum(F.col("n") * F.pow(F.col("mean") - r["grand"], 2)).alias("ssb"),
                   F.sum((F.col("n") - 1) * F.col("var")).alias("ssw")).first()
    d1, d2 = r["groups"] - 1, r["rows"] - r["groups"]
    f = (s["ssb"] / d1) / (s["ssw"] / d2) if s["ssw"] else None
    return rows_frame(spark, [{"groups": r["groups"], "rows": r["rows"], "ss_between": s["ssb"], "ss_within": s["ssw"],
                      "f_statistic": f, "p_value": None if f is None else tails.f_sf(f, d1, d2)}], schema)


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two columns; continuity correction for a 2x2 table."""
    r = pair_chi_square(df, [(a, b)]).first()
    schema = "statistic double, dof long, n long, p_value double"
    if r is None:
        return rows_frame(df.sparkSession, [], schema)
    p = tails.chi2_sf(r["chi2"], r["dof"]) if r["dof"] else 1.0
    return rows_frame(df.sparkSession, [{"statistic": r["chi2"], "dof": r["dof"], "n": r["n"], "p_value": p}], schema)


def two_sample(df: DataFrame, a: str, b: str, test: str = "ttest", window_rows: int | None = None) -> DataFrame:
    """Compare two numeric columns: ``ttest`` (equal variance), ``welch``, ``mannwhitney`` or ``ks``."""
    spark, x, y = df.sparkSession, C.as_number(df, a), C.as_number(df, b)
    if test in ("ttest", "welch"):
        r = df.agg(F.count(x).alias("n1"), F.avg(x).alias("m1"), F.var_samp(x).alias("v1"),
                   F.count(y).alias("n2"), F.avg(y).alias("m2"), F.var_samp(y).alias("v2")).first()
        return rows_frame(spark, [{"test": test, **_t_row(*r, pooled=test == "ttest")}], "test string, " + T_ROW)
    both = df.select(F.explode(F.array(F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"), x.alias("x")),
                                       F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"), y.alias("x")))).alias("m")).select("m.*")
    counts = both.where("x is not null").groupBy("x").agg(
        F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count(F.lit(1)).alias("n"))
    options = {} if window_rows is None else {"window_rows": window_rows}
    ranked = cumulative(counts, [], [F.col("x")], ("n", "na", "nb"), **options)
    schema = "test string, n_a long, n_b long, statistic double, p_value double"
    if test == "mannwhitney":
        t = F.col("n").cast("double")
        r = ranked.agg(F.sum("na").alias("n1"), F.sum("nb").alias("n2"),
                       F.sum(F.col("na") * average_rank(F.col("before"), F.col("n"))).alias("ra"),
                       F.sum(t * t * t - t).alias("ties")).first()
        n1, n2 = r["n1"], r["n2"]
        n = n1 + n2
        u = r["ra"] - n1 * (n1 + 1) / 2
        sd = math.sqrt(n1 * n2 / 12.0 * ((n + 1) - r["ties"] / (n * (n - 1))))
        z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd if sd else 0.0
        return rows_frame(spark, [{"test": test, "n_a": n1, "n_b": n2, "statistic": u,
                          "p_value": min(1.0, 2 * tails.normal_sf(z))}], schema)
    if test == "ks":
        sizes = counts.agg(F.sum("na"), F.sum("nb")).first()
        gap = F.abs((F.col("before_na") + F.col("na")) / F.lit(float(sizes[0])) - (F.col("before_nb") + F.col("nb")) / F.lit(float(sizes[1])))
        d = ranked.agg(F.max(gap)).first()[0]
        scale = math.sqrt(sizes[0] * sizes[1] / (sizes[0] + sizes[1]))
        return rows_frame(spark, [{"test": test, "n_a": sizes[0], "n_b": sizes[1], "statistic": d,
                          "p_value": tails.kolmogorov_sf(scale * d)}], schema)
    raise ValueError(f"unknown test {test!r}")


# ---- normality ----------------------------------------------------------------------------

def normality_heuristic(data: Table) -> DataFrame:
    p = profiled(data)
    rows = [{"column": c, "skew": p.moments[c]["skew"], "kurtosis": p.moments[c]["kurt"],
             "likely_normal": abs(p.moments[c]["skew"]) < 0.5 and abs(p.moments[c]["kurt"] or 0.0) < 1.0} for c in p.filled]
    return rows_frame(p.spark, rows, "column string, skew double, kurtosis double, likely_normal boolean")


def dagostino(data: Table) -> DataFrame:
    """Omnibus test of skewness and kurtosis from the moments, columns of 20 values or more."""
    p = profiled(data)
    rows = []
    for c in p.filled:
        m = p.moments[c]
        if m["n"] < 20 or m["kurt_pop"] is None:
            continue
        k2 = _skew_z(m["skew_pop"], m["n"]) ** 2 + _kurt_z(m["kurt_pop"], m["n"]) ** 2
        pv = tails.chi2_sf(k2, 2)
        rows.append({"column": c, "n": m["n"], "statistic": k2, "p_value": pv, "is_normal": pv > 0.05})
    return rows_frame(p.spark, rows, "column string, n long, statistic double, p_value double, is_normal boolean")


def _skew_z(g1: float, n: int) -> float:
    """D'Agostino's transformation of sqrt(b1)."""
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta2 - 1)) - 1
    a = math.sqrt(2 / (w2 - 1))
    return math.asinh(y / a) / math.sqrt(0.5 * math.log(w2))


def _kurt_z(g2: float, n: int) -> float:
    """Anscombe and Glynn's transformation of b2."""
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) ** 2 * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / math.sqrt(var)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7.0) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6.0 + 8.0 / root * (2.0 / root + math.sqrt(1 + 4.0 / root**2))
    ratio = (1 - 2.0 / a) / (1 + x * math.sqrt(2.0 / (a - 4)))
    return (1 - 2.0 / (9 * a) - math.copysign(abs(ratio) ** (1 / 3), ratio)) / math.sqrt(2.0 / (9 * a))


def _ranked_values(p: Profile, cols: list[str], window_rows: int | None = None) -> DataFrame:
    """(column, x, n, before) over the distinct values of several columns."""
    cells = [F.struct(F.lit(c).alias("column"), p.number(c).alias("x")) for c in cols]
    counts = p.df.select(F.explode(F.array(*cells)).alias("m")).select("m.*").where("x is not null").groupBy(
        "column", "x").agg(F.count(F.lit(1)).alias("n"))
    options = {} if window_rows is None else {"window_rows": window_rows}
    return cumulative(counts, ["column"], [F.col("x")], rows=p.rows * len(cols), **options)


def _by_column(p: Profile, cols: list[str], pick) -> Column:
    """A per-column scalar as an expression over the ``column`` label."""
    pairs = [F.lit(v) for c in cols for v in (c, float(pick(c)))]
    return F.element_at(F.create_map(*pairs), F.col("column"))


def ks_normal(data: Table, standard: bool = False, window_rows: int | None = None) -> DataFrame:
    """Kolmogorov-Smirnov distance from N(mean, std), or from N(0, 1)."""
    p = profiled(data)
    cols = [c for c in p.filled if standard or p.moments[c]["std"]]
    if not cols:
        return rows_frame(p.spark, [], "column string, n long, statistic double, p_value double, is_normal boolean")
    z = F.col("x") if standard else (
        (F.col("x") - _by_column(p, cols, lambda c: p.moments[c]["mean"])) / _by_column(p, cols, lambda c: p.moments[c]["std"]))
    return _ks_rows(p, cols, _ranked_values(p, cols, window_rows).withColumn("cdf", normal_cdf(z)))


def _distance(size) -> Column:
    above = (F.col("before") + F.col("n")) / size - F.col("cdf")
    return F.greatest(above, F.col("cdf") - F.col("before") / size)


def _ks_rows(p: Profile, cols: list[str], ranked: DataFrame) -> DataFrame:
    size = _by_column(p, cols, lambda c: p.moments[c]["n"])
    rows = []
    for r in ranked.groupBy("column").agg(F.max(_distance(size)).alias("d")).collect():
        n = p.moments[r["column"]]["n"]
        pv = tails.kolmogorov_sf(math.sqrt(n) * r["d"])
        rows.append({"column": r["column"], "n": n, "statistic": r["d"], "p_value": pv, "is_normal": pv > 0.05})
    return rows_frame(p.spark, rows, "column string, n long, statistic double, p_value double, is_normal boolean")


def anderson(data: Table, window_rows: int | None = None) -> DataFrame:
    """Anderson-Darling statistic against N(mean, std)."""
    p = profiled(data)
    cols = [c for c in p.filled if p.moments[c]["std"]]
    if not cols:
        return rows_frame(p.spark, [], "column string, n long, statistic double")
    z = (F.col("x") - _by_column(p, cols, lambda c: p.moments[c]["mean"])) / _by_column(p, cols, lambda c: p.moments[c]["std"])
    size = _by_column(p, cols, lambda c: p.moments[c]["n"])
    b, m = F.col("before").cast("double"), F.col("n").cast("double")
    # Summed weights of the m tied ranks b+1 .. b+m, seen from below and from above.
    low = (b + m) * (b + m) - b * b
    high = m * (2 * size + 1) - ((b + m) * (b + m + 1) - b * (b + 1))
    tiny = F.lit(1e-300)
    term = low * F.log(F.greatest(normal_cdf(z), tiny)) + high * F.log(F.greatest(normal_cdf(-z), tiny))
    return _ranked_values(p, cols, window_rows).groupBy("column").agg(
        F.max(size).cast("long").alias("n"), (-F.max(size) - F.sum(term) / F.max(size)).alias("statistic"))


def shapiro(data: Table, id_col: str | None = None, limit: int = 5000, seed: int = 42) -> DataFrame:
    """Shapiro-Wilk on at most ``limit`` values per column, the bound of the method.

    Larger tables are sampled by a hash of ``id_col``.
    """
    p = profiled(data)
    df, cols = p.df, p.filled
    if p.rows > limit:
        if id_col is None:
            raise ValueError("more rows than the test allows: name an id column for the sample")
        df = take_per_class(df, None, lambda n: limit, id_col, seed)
    cells = [F.struct(F.lit(c).alias("column"), C.as_number(df, c).alias("x")) for c in cols]
    long = df.select(F.explode(F.array(*cells)).alias("m")).select("m.*").where("x is not null")
    return long.groupBy("column").applyInPandas(
        _shapiro_group, "column string, n long, statistic double, p_value double, is_normal boolean")


def _shapiro_group(g: pd.DataFrame) -> pd.DataFrame:
    """Royston's approximation of the Shapiro-Wilk statistic and its significance."""
    x = np.sort(g["x"].to_numpy(dtype=float))
    n = len(x)
    if n < 8 or x[0] == x[-1]:
        return pd.DataFrame({"column": [], "n": [], "statistic": [], "p_value": [], "is_normal": []}).astype(
            {"column": str, "n": int, "is_normal": bool})
    m = np.array([tails.normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssm, u = m @ m, 1 / math.sqrt(n)
    # Royston's polynomials in 1/sqrt(n) and ln n.
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(ssm)], u)
    previous = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(ssm)], u)
    scale = (ssm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * previous**2)
    a = m / math.sqrt(scale)
    a[-1], a[-2], a[0], a[1] = last, previous, -last, -previous
    w = (a @ x) ** 2 / ((x - x.mean()) @ (x - x.mean()))
    ln = math.log(n)
    if n <= 11:
        mu = np.polyval([-0.0006714, 0.0250540, -0.39978, 0.5440], n)
        sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        g_n = 0.459 * n - 2.273
        z = (-math.log(max(g_n - math.log1p(-w), 1e-300)) - mu) / sd
    else:
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
        z = (math.log1p(-w) - mu) / sd
    p = tails.normal_sf(z)
    return pd.DataFrame({"column": [g["column"].iloc[0]], "n": [n], "statistic": [float(w)], "p_value": [p], "is_normal": [p > 0.05]})


def fit_distribution(data: Table, window_rows: int | None = None) -> DataFrame:
    """Best of normal, lognormal, gamma and exponential per column by Kolmogorov distance.

    Parameters are closed-form or Newton estimates from one aggregate; the distances
    come from the ranked distinct values.
    """
    p = profiled(data)
    schema = "column string, distribution string, ks_statistic double, p_value double, best boolean"
    cols = [c for c in p.filled if p.moments[c]["n"] >= 10 and p.moments[c]["std"]]
    if not cols:
        return rows_frame(p.spark, [], schema)
    positive = [c for c in cols if p.moments[c]["min"] > 0]
    logs = {}
    if positive:
        row = p.df.agg(*[F.struct(F.avg(F.log(p.number(c))).alias("m"), F.stddev_pop(F.log(p.number(c))).alias("s")).alias(f"l{i}")
                         for i, c in enumerate(positive)]).first()
        logs = {c: (row[i]["m"], row[i]["s"]) for i, c in enumerate(positive)}
    ranked = _ranked_values(p, cols, window_rows)
    rows = []
    for c in cols:
        m, x = p.moments[c], F.col("x")
        curves = {
            "normal": normal_cdf((x - m["mean"]) / m["std_pop"]),
            "exponential": 1 - F.exp(-(x - m["min"]) / (m["mean"] - m["min"])),
        }
        if c in logs and logs[c][1]:
            curves["lognormal"] = normal_cdf((F.log(x) - logs[c][0]) / logs[c][1])
            shape = _gamma_shape(math.log(m["mean"]) - logs[c][0])
            curves["gamma"] = gamma_cdf(shape)(x * (shape / m["mean"]))
        mine = ranked.where(F.col("column") == c)
        size = F.lit(float(m["n"]))
        named = mine.select("before", "n", *[e.alias(k) for k, e in curves.items()])
        gaps = [F.max(F.greatest((F.col("before") + F.col("n")) / size - F.col(k), F.col(k) - F.col("before") / size)).alias(k) for k in curves]
        found = named.agg(*gaps).first().asDict()
        best = min(found, key=lambda k: found[k])
        for k, d in found.items():
            rows.append({"column": c, "distribution": k, "ks_statistic": d,
                         "p_value": tails.kolmogorov_sf(math.sqrt(m["n"]) * d), "best": k == best})
    return rows_frame(p.spark, rows, schema)


def _gamma_shape(s: float) -> float:
    """Maximum-likelihood shape from ln(mean) - mean(ln x) (Minka's iteration)."""
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(20):
        h = 1e-5 * k
        digamma = (math.lgamma(k + h) - math.lgamma(k - h)) / (2 * h)
        trigamma = (math.lgamma(k + h) - 2 * math.lgamma(k) + math.lgamma(k - h)) / (h * h)
        step = (math.log(k) - digamma - s) / (1 / k - trigamma)
        k = max(k - step, k / 2)
        if abs(step) < 1e-9 * k:
            break
    return k


def qq_points(df: DataFrame, col: str, n: int = 100) -> DataFrame:
    """n pairs of normal and sample quantiles."""
    probs = [(i + 0.5) / n for i in range(n)]
    got = exact_quantiles(df, [col], probs)[col]
    rows = [{"p": q, "theoretical": tails.normal_ppf(q), "sample": v} for q, v in zip(probs, got)]
    return rows_frame(df.sparkSession, rows, "p double, theoretical double, sample double")


# ---- experiments --------------------------------------------------------------------------

def _arms(df: DataFrame, group: str, outcome: str, control, variant) -> list[tuple[str, int, int]]:
    label = C.quoted(group).cast("string")
    rows = df.where(label.isNotNull()).groupBy(label.alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(C.as_number(df, outcome)).cast("long").alias("hits"))
    if control is not None and variant is not None:
        rows = rows.where(F.col("g").isin(str(control), str(variant)))
    arms = {r["g"]: (r["n"], r["hits"] or 0) for r in rows.orderBy("g").limit(2).collect()}
    if len(arms) < 2:
        raise ValueError("two arms are needed")
    names = [str(control), str(variant)] if control is not None and variant is not None else list(arms)
    return [(k, *arms[k]) for k in names]


def ab_test(df: DataFrame, group: str, outcome: str, control=None, variant=None) -> DataFrame:
    """Proportion z-test of a 0/1 outcome between two arms, with absolute and relative lift."""
    (c, n1, x1), (v, n2, x2) = _arms(df, group, outcome, control, variant)
    r1, r2, pool = x1 / n1, x2 / n2, (x1 + x2) / (n1 + n2)
    se = math.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
    z = (r2 - r1) / se if se else None
    return rows_frame(df.sparkSession, [{
        "control": c, "variant": v, "n_control": n1, "n_variant": n2, "rate_control": r1, "rate_variant": r2,
        "absolute_lift": r2 - r1, "relative_lift": (r2 - r1) / r1 if r1 else None, "z_score": z,
        "p_value": None if z is None else 2 * tails.normal_sf(abs(z)),
        "significant": z is not None and 2 * tails.normal_sf(abs(z)) < 0.05,
    }], "control string, variant string, n_control long, n_variant long, rate_control double, rate_variant double, "
        "absolute_lift double, relative_lift double, z_score double, p_value double, significant boolean")


def bayes_ab(df: DataFrame, group: str, outcome: str, control=None, variant=None) -> DataFrame:
    """Beta posteriors under a uniform prior; the chance that the variant is better is integrated."""
    (c, n1, x1), (v, n2, x2) = _arms(df, group, outcome, control, variant)
    a, b = (x1 + 1, n1 - x1 + 1), (x2 + 1, n2 - x2 + 1)

    def mean(t): return t[0] / (t[0] + t[1])

    def sd(t): return math.sqrt(mean(t) * (1 - mean(t)) / (t[0] + t[1] + 1))

    lo, hi = max(0.0, mean(b) - 12 * sd(b)), min(1.0, mean(b) + 12 * sd(b))
    steps = 400
    better = 0.0
    for i in range(steps):
        left, right = lo + (hi - lo) * i / steps, lo + (hi - lo) * (i + 1) / steps
        mass = tails.beta_cdf(right, *b) - tails.beta_cdf(left, *b)
        better += mass * (tails.beta_cdf(left, *a) + 4 * tails.beta_cdf((left + right) / 2, *a) + tails.beta_cdf(right, *a)) / 6
    return rows_frame(df.sparkSession, [{
        "control": c, "variant": v, "mean_control": mean(a), "mean_variant": mean(b),
        "control_low": tails.beta_ppf(0.025, *a), "control_high": tails.beta_ppf(0.975, *a),
        "variant_low": tails.beta_ppf(0.025, *b), "variant_high": tails.beta_ppf(0.975, *b),
        "p_variant_better": better, "expected_uplift": mean(b) - mean(a),
    }], "control string, variant string, mean_control double, mean_variant double, control_low double, "
        "control_high double, variant_low double, variant_high double, p_variant_better double, expected_uplift double")


def auto_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Welch and Mann-Whitney for two numeric columns (over complete pairs), else chi-square."""
    schema = "test string, statistic double, p_value double"
    numeric = C.numeric_columns(df)
    if a in numeric and b in numeric:
        pairs = df.select(C.as_number(df, a).alias(a), C.as_number(df, b).alias(b)).dropna()
        t, u = two_sample(pairs, a, b, "welch").first(), two_sample(pairs, a, b, "mannwhitney").first()
        rows = [{"test": "welch", "statistic": t["statistic"], "p_value": t["p_value"]},
                {"test": "mannwhitney", "statistic": u["statistic"], "p_value": u["p_value"]}]
    else:
        r = chi_square(df, a, b).first()
        rows = [{"test": "chi_square", "statistic": r["statistic"], "p_value": r["p_value"]}] if r else []
    return rows_frame(df.sparkSession, rows, schema)


def statistical_summary(data: Table) -> DataFrame:
    """Counts of non-normal and imbalanced columns, and one flag row per column at fault."""
    p = profiled(data)
    normal = dagostino(p).collect()
    tilt = P.imbalance(p).collect() if p.text else []
    rows = [
        {"item": "numeric_columns", "subject": None, "value": len(p.numeric)},
        {"item": "categorical_columns", "subject": None, "value": len(p.text)},
        {"item": "non_normal", "subject": None, "value": sum(not r["is_normal"] for r in normal)},
        {"item": "imbalanced", "subject": None, "value": sum(r["severity"] in ("moderate", "severe") for r in tilt)},
    ]
    rows += [{"item": "high_outlier_impact", "subject": r["column"], "value": r["outliers"]}
             for r in P.outlier_impact(p).where("severity = 'high'").collect()]
    rows += [{"item": "severe_imbalance", "subject": r["column"], "value": None} for r in tilt if r["severity"] == "severe"]
    return rows_frame(p.spark, rows, "item string, subject string, value long")
