"""Fit / transform steps: imputation, outliers, encoding, scaling, selection, balancing.

A fitted step holds scalars per column or a value table; applying it to new rows is a
projection or a lookup join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.functions.distributions import normal_ppf
from plumbline.ml.isolation import IsolationForest, fit_isolation_forest
from plumbline.operators.association import covariance
from plumbline.operators.cleaning import _set, iqr_fences, most_frequent, treat_outliers
from plumbline.operators.features import value_codes, value_columns
from plumbline.plans.frames import cut_lineage, distinct_upto, rows_frame
from plumbline.plans.lookups import lookup_join
from plumbline.plans.profiling import Profile, profiled
from plumbline.plans.quantiles import exact_quantiles
from plumbline.plans.sampling import take_per_class

SMALL_TABLE = 1_000


def settle(table: DataFrame) -> DataFrame:
    """Keep a fitted value table: in the driver when tiny, else in the checkpoint folder."""
    first = table.limit(SMALL_TABLE + 1).collect()
    if len(first) <= SMALL_TABLE:
        return rows_frame(table.sparkSession, [r.asDict() for r in first], table.schema)
    return cut_lineage(table)


@dataclass
class Step:
    """One fitted step: its name, the columns it touches, which of ``EFFECTS`` it has, and what was fitted (numbers, a value table, a forest)."""

    name: str
    columns: list[str]
    kind: str
    state: dict = field(default_factory=dict)
    table: DataFrame | None = None
    forest: IsolationForest | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        return EFFECTS[self.kind](df, self)

    @property
    def values(self) -> dict:
        return self.state.get("values", {})


# ---- imputation ---------------------------------------------------------------------------

def fit_impute(df: DataFrame, strategy: str = "auto", cols: list[str] | None = None) -> Step:
    """drop, mean, median, mode; auto is median for numbers and mode for the rest."""
    cols = cols or [f.name for f in df.schema if not isinstance(f.dataType, C.NESTED)]
    if strategy == "drop":
        return Step("impute_drop", cols, "drop")
    numeric = [c for c in cols if c in C.numeric_columns(df)]
    values: dict[str, object] = {}
    if strategy in ("auto", "median"):
        values = {c: q[0] for c, q in exact_quantiles(df, numeric, [0.5]).items()}
    elif strategy == "mean":
        m = profiled(df.select(*[C.quoted(c) for c in numeric])).moments if numeric else {}
        values = {c: m[c]["mean"] for c in numeric}
    elif strategy != "mode":
        raise ValueError(f"unknown imputation {strategy!r}")
    for c in cols:
        if c not in values and (c not in numeric or strategy == "mode"):
            values[c] = most_frequent(df, c)
    values = {c: v for c, v in values.items() if v is not None}

    return Step(f"impute_{strategy}", list(values), "fill", {"values": values})


def _drop(t: DataFrame, step: Step) -> DataFrame:
    keep = F.lit(True)
    for c in step.columns:
        keep = keep & ~C.is_null(t, c)
    return t.where(keep)


def _fill(t: DataFrame, step: Step) -> DataFrame:
    return _set(t, {c: F.when(C.is_null(t, c), F.lit(v)).otherwise(
        C.as_number(t, c) if isinstance(v, float) and c in C.numeric_columns(t) else C.quoted(c))
        for c, v in step.values.items() if c in t.columns})


def fit_impute_iterative(df: DataFrame, cols: list[str], rounds: int = 10, ridge: float = 1e-3, tol: float = 1e-3) -> Step:
    """Each column with gaps is regressed on the others, round after round.

    The regressions need only means and covariances. Those are re-estimated per round
    from the filled table in one aggregate, so a round is one scan; the fitted values
    enter the next round as expressions over the original columns, never nested.
    """
    p = profiled(df.select(*[C.quoted(c) for c in cols]))
    means = {c: p.moments[c]["mean"] or 0.0 for c in cols}
    gaps = [c for c in cols if p.missing[c]]
    weights: dict[str, list] = {c: [means[c], {}] for c in gaps}
    fitted = Step("impute_iterative", gaps, "regress", {"means": means, "weights": weights})
    history = [means[c] for c in gaps]

    for _ in range(rounds if gaps else 0):
        _, mu, cov = covariance(fitted.transform(df).select(*[C.quoted(c) for c in cols]), cols)
        for c in gaps:
            i = cols.index(c)
            others = [j for j in range(len(cols)) if j != i]
            a = cov[np.ix_(others, others)]
            slope = np.linalg.solve(a + ridge * np.diag(np.maximum(np.diag(a), 1e-12)), cov[others, i])
            weights[c] = [float(mu[i] - slope @ mu[others]), {cols[j]: float(s) for j, s in zip(others, slope)}]
        now = [weights[c][0] for c in gaps]
        if all(abs(a - b) <= tol * max(1.0, abs(a)) for a, b in zip(now, history)):
            break
        history = now
    fitted.state["values"] = {c: weights[c][0] for c in gaps}
    return fitted


def _regress(t: DataFrame, step: Step) -> DataFrame:
    means, weights = step.state["means"], step.state["weights"]
    helper = {c: f"__plumb_f{i}" for i, c in enumerate(means)}
    base = t.withColumns({helper[c]: F.coalesce(C.as_number(t, c), F.lit(m)) for c, m in means.items()})
    out = {}
    for c, (constant, slopes) in weights.items():
        guess = F.lit(float(constant))
        for o, w in slopes.items():
            guess = guess + F.lit(float(w)) * F.col(helper[o])
        out[c] = F.coalesce(C.as_number(t, c), guess)
    return base.withColumns(out).drop(*helper.values())


def fit_impute_knn(df: DataFrame, cols: list[str] | None = None, k: int = 5) -> Step:
    """Gaps of any table get the mean of the k nearest complete rows of the fitted one."""
    cols = cols or C.numeric_columns(df)
    complete = df.select(*[C.as_number(df, c).alias(c) for c in cols]).dropna()
    donors = cut_lineage(complete.withColumn(ROW_ID, F.monotonically_increasing_id()))

    return Step("impute_knn", cols, "knn", {"k": k}, donors)


def _knn(t: DataFrame, step: Step) -> DataFrame:
    from plumbline.ml.neighbors import impute_knn

    marked = cut_lineage(t.withColumn(ROW_ID, F.monotonically_increasing_id()))
    return impute_knn(marked, step.columns, ROW_ID, step.state["k"], step.table).drop(ROW_ID)


# ---- outliers -----------------------------------------------------------------------------

#: Helper column, named so that no table has it.
ROW_ID = "__plumb_row"


def fit_outliers(df: DataFrame, method: str = "clip", cols: list[str] | None = None) -> Step:
    cols = cols or C.numeric_columns(df)
    if method == "winsorize":
        return Step("winsorize", cols, "fences", {"action": "clip", "values": winsor_limits(df, cols)})
    if method == "isolation_forest":
        # A row is told by its values: equal rows are scored alike.
        forest = fit_isolation_forest(df.withColumn(ROW_ID, F.xxhash64(*[C.quoted(c) for c in cols])), cols, ROW_ID)
        return Step("outliers_isolation_forest", cols, "isolation", {"values": {"threshold": forest.threshold}}, forest=forest)
    if method not in ("clip", "remove"):
        raise ValueError(f"unknown outlier method {method!r}: use clip, remove, winsorize or isolation_forest")
    return Step(f"outliers_{method}", cols, "fences", {"action": method, "values": iqr_fences(df, cols)})


def _fences(t: DataFrame, step: Step) -> DataFrame:
    return treat_outliers(t, action=step.state["action"], fences={c: tuple(v) for c, v in step.values.items()})


def winsor_limits(df: DataFrame, cols: list[str], limits: tuple[float, float] = (0.05, 0.05)) -> dict[str, tuple[float, float]]:
    """The order statistics that replace everything below and above them."""
    p = profiled(df.select(*[C.quoted(c) for c in cols]))
    out = {}
    for n in {p.moments[c]["n"] for c in p.filled}:
        same = [c for c in p.filled if p.moments[c]["n"] == n]
        low, high = int(limits[0] * n), n - 1 - int(limits[1] * n)
        got = exact_quantiles(p.df, same, [low / max(n - 1, 1), high / max(n - 1, 1)], rows=p.rows)
        out.update({c: (q[0], q[1]) for c, q in got.items()})
    return out


def winsorize(df: DataFrame, cols: list[str], limits: tuple[float, float] = (0.05, 0.05)) -> DataFrame:
    return treat_outliers(df, action="clip", fences=winsor_limits(df, cols, limits))


# ---- encoding -----------------------------------------------------------------------------

def fit_encode(df: DataFrame, cols: list[str], method: str = "auto", target: str | None = None,
               max_onehot: int = 10, max_columns: int = 200) -> list[Step]:
    """label, onehot, frequency, target; auto is one-hot up to ``max_onehot`` values, else label. A one-hot column of more than
    ``max_columns`` values is refused."""
    steps = []
    for c in cols:
        kind = method
        if method == "auto":
            few = distinct_upto(df, {c: C.quoted(c)}, max_onehot + 1)[c]
            kind = "onehot" if few <= max_onehot else "label"
        if kind == "onehot":
            steps.append(_fit_onehot(df, c, max_columns))
            continue
        if kind == "label":
            table = value_codes(df, c).withColumn("code", F.col("code").cast("double"))
        else:
            counts = df.where(C.quoted(c).isNotNull()).groupBy(C.quoted(c).alias(c))
            if kind == "frequency":
                rows = df.count()
                table = counts.agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.col("n") / F.lit(float(rows)))
            elif kind == "target":
                if target is None:
                    raise ValueError("target encoding needs the target column")
                table = counts.agg(F.count(F.lit(1)).alias("n"), F.avg(C.as_number(df, target)).alias("code"))
            else:
                raise ValueError(f"unknown encoding {kind!r}")
        steps.append(_lookup_step(f"encode_{kind}", c, settle(table.select(C.quoted(c), "n", "code"))))
    return steps


def _lookup_step(name: str, c: str, table: DataFrame, unseen: float = 0.0) -> Step:
    return Step(name, [c], "lookup", {"unseen": unseen}, table)


def _lookup(t: DataFrame, step: Step) -> DataFrame:
    (c,) = step.columns
    joined = lookup_join(t, step.table.withColumnRenamed("code", "_code"), c, ["_code"])
    return _set(joined, {c: F.coalesce(F.col("_code"), F.lit(step.state["unseen"]))}).drop("_code")


def _fit_onehot(df: DataFrame, c: str, limit: int) -> Step:
    """0/1 columns for all values of a column; more than ``limit`` values are refused, as each makes a column."""
    found = df.where(C.quoted(c).isNotNull()).select(C.quoted(c).cast("string").alias("v")).distinct().orderBy("v").limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"column {c!r} has more than {limit} values: use label, frequency or target encoding")
    values = [r["v"] for r in found]

    return Step("encode_onehot", [c], "onehot", {"values": {c: values}, "names": value_columns(c, values, df.columns)})


def _onehot(t: DataFrame, step: Step) -> DataFrame:
    (c,) = step.columns
    made = {n: F.coalesce((C.quoted(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)) for n, v in zip(step.state["names"], step.values[c])}
    return t.withColumns(made).drop(c)


def target_encode_out_of_fold(df: DataFrame, col: str, target: str, id_col: str, folds: int = 5, seed: int = 42,
                              into: str | None = None) -> DataFrame:
    """Target mean of the other folds only, so a row never sees its own target."""
    from plumbline.plans.frames import hash_share

    into = into or col + "_target"
    marked = df.withColumn("_fold", F.floor(hash_share(C.quoted(id_col), seed=seed) * folds).cast("int"))
    y = C.as_number(df, target)
    per_fold = marked.where(C.quoted(col).isNotNull()).groupBy(C.quoted(col).alias("_k"), "_fold").agg(
        F.sum(y).alias("s"), F.count(y).alias("c"))
    # per value at most ``folds`` rows: every fold gets the sums of the others
    totals = per_fold.groupBy("_k").agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"), F.collect_list(F.struct("_fold", "s", "c")).alias("parts"))
    total = df.agg(F.avg(y)).first()[0]
    slots = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: F.try_divide(
        F.col("ts") - F.coalesce(F.aggregate(F.filter("parts", lambda q: q["_fold"] == f), F.lit(0.0), lambda a, q: a + F.coalesce(q["s"], F.lit(0.0))), F.lit(0.0)),
        F.col("tc") - F.aggregate(F.filter("parts", lambda q: q["_fold"] == f), F.lit(0).cast("long"), lambda a, q: a + q["c"])))
    table = totals.select(F.col("_k").alias(col), F.col("tc").alias("n"), slots.alias("_slots"))
    joined = lookup_join(marked, table, col, ["_slots"])
    return joined.withColumn(into, F.coalesce(F.col("_slots")[F.col("_fold")], F.lit(total))).drop("_slots", "_fold")


# ---- scaling ------------------------------------------------------------------------------

def scale_factors(df: DataFrame, cols: list[str], method: str) -> dict[str, tuple[float, float]]:
    """(shift, scale) per column; a scale of zero becomes one."""
    p = profiled(df.select(*[C.quoted(c) for c in cols]))
    out = {}
    for c in p.filled:
        m = p.moments[c]
        if method == "standard":
            shift, scale = m["mean"], m["std_pop"]
        elif method == "minmax":
            shift, scale = m["min"], m["max"] - m["min"]
        elif method == "robust":
            q1, q2, q3 = p.quartiles[c]
            shift, scale = q2, q3 - q1
        elif method == "maxabs":
            shift, scale = 0.0, max(abs(m["min"]), abs(m["max"]))
        else:
            raise ValueError(f"unknown scaling {method!r}")
        out[c] = (shift, scale or 1.0)
    return out


def fit_scale(df: DataFrame, cols: list[str] | None = None, method: str = "standard") -> Step:
    cols = cols or C.numeric_columns(df)
    if method == "quantile":
        return fit_quantile_normal(df, cols)
    return Step(f"scale_{method}", cols, "scale", {"values": scale_factors(df, cols, method)})


def _scale(t: DataFrame, step: Step) -> DataFrame:
    return _set(t, {c: (C.as_number(t, c) - F.lit(a)) / F.lit(b) for c, (a, b) in step.values.items()})


def fit_quantile_normal(df: DataFrame, cols: list[str], points: int = 1000) -> Step:
    """Empirical distribution on a quantile grid, then the normal quantile function."""
    probs = [i / (points - 1) for i in range(points)]
    grids = {c: [float(v) for v in q] for c, q in exact_quantiles(df, cols, probs).items() if q[0] is not None}
    return Step("scale_quantile", list(grids), "normal", {"grids": grids})


def _normal(t: DataFrame, step: Step) -> DataFrame:
    def share_of(grid: np.ndarray):
        reference = np.arange(len(grid)) / (len(grid) - 1)

        @F.pandas_udf("double")
        def share(x: pd.Series) -> pd.Series:
            v = x.to_numpy(dtype=float)
            # Ties in the grid: the middle of the flat stretch.
            up = np.interp(v, grid, reference)
            down = -np.interp(-v, -grid[::-1], -reference[::-1])
            return pd.Series(0.5 * (up + down)).where(x.notna().to_numpy())

        return share

    edge = 1e-7
    return _set(t, {c: normal_ppf(F.least(F.greatest(share_of(np.array(g, float))(C.as_number(t, c)), F.lit(edge)), F.lit(1 - edge)))
                    for c, g in step.state["grids"].items()})


#: What a step does to a table, by kind.
EFFECTS: dict[str, Callable[[DataFrame, Step], DataFrame]] = {
    "drop": _drop, "fill": _fill, "regress": _regress, "knn": _knn, "fences": _fences, "isolation": lambda t, step: step.forest.transform(t, "remove"),
    "lookup": _lookup, "onehot": _onehot, "scale": _scale, "normal": _normal,
}


# ---- selection ----------------------------------------------------------------------------

def select_by_variance(data, threshold: float = 0.01) -> list[str]:
    p = profiled(data)
    return [c for c in p.filled if p.moments[c]["std_pop"] ** 2 > threshold]


def select_by_correlation(data, threshold: float = 0.95) -> list[str]:
    """Numeric columns without the later one of every pair beyond the threshold."""
    p = profiled(data)
    order = {c: i for i, c in enumerate(p.numeric)}
    dropped = {max(pair, key=order.get) for pair, r in p.correlations.items() if r is not None and abs(r) > threshold}
    return [c for c in p.numeric if c not in dropped]


# ---- the whole preprocessor ---------------------------------------------------------------

class Preprocessor:
    """Fitted steps in order, with a report of what they did."""

    def __init__(self, steps: list[Step], kept: list[str] | None, before: tuple[int, int]):
        self.steps, self.kept, self.before = steps, kept, before

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.transform(df)
        return df if self.kept is None else df.select(*[C.quoted(c) for c in self.kept if c in df.columns])

    def report(self, spark) -> DataFrame:
        plain = lambda v: tuple(v) if isinstance(v, list) and len(v) == 2 else v  # noqa: E731  a pair, also after loading
        rows = [{"position": i, "step": s.name, "columns": ", ".join(s.columns), "values": str({c: plain(v) for c, v in s.values.items()}) if s.values else None}
                for i, s in enumerate(self.steps)]
        return rows_frame(spark, rows, "position int, step string, columns string, values string")


def fit_preprocessor(
    df: DataFrame, target: str | None = None, missing: str | None = "auto", outliers: str | None = "clip",
    encode: str | None = "auto", scale: str | None = "standard", selection: str | None = None, k: int = 10,
) -> Preprocessor:
    """Impute, treat outliers, encode, scale and select, each fitted on the output of the one before."""
    rows = df.count()
    steps: list[Step] = []
    features = [c for c in df.columns if c != target]
    current = df

    def add(new: list[Step]) -> None:
        nonlocal current
        for s in new:
            steps.append(s)
            current = s.transform(current)

    if missing:
        numbers = [c for c in C.numeric_columns(current) if c != target]
        if missing == "iterative":
            add([fit_impute_iterative(current, numbers)])
        elif missing == "knn":
            add([fit_impute_knn(current, numbers)])
        else:
            add([fit_impute(current, missing, features)])
    numeric = [c for c in C.numeric_columns(current) if c != target]
    if outliers and numeric:
        add([fit_outliers(current, outliers, numeric)])
    text = [c for c in C.text_columns(current) if c != target]
    if encode and text:
        add(fit_encode(current, text, encode, target))
    if scale and numeric:
        add([fit_scale(current, numeric, scale)])
    kept = None
    if selection:
        view = current.select(*[C.quoted(c) for c in C.numeric_columns(current) if c != target])
        if selection == "variance":
            names = select_by_variance(view)
        elif selection == "correlation":
            names = select_by_correlation(view)
        elif selection == "mutual_info":
            from plumbline.operators.scoring import mutual_info

            names = [r["feature"] for r in mutual_info(current, view.columns, target).orderBy(
                F.col("mi").desc(), "feature").limit(k).collect()]
        elif selection == "rfe":
            from plumbline.ml.training import rfe

            marked = current.withColumn(ROW_ID, F.xxhash64(*[C.quoted(c) for c in current.columns]))
            ranked = rfe(marked, target, min(k, len(view.columns)), view.columns, id_col=ROW_ID)
            names = [r["feature"] for r in ranked.where("selected").orderBy("feature").collect()]
        else:
            raise ValueError(f"unknown selection {selection!r}")
        kept = names + ([target] if target else [])
    return Preprocessor(steps, kept, (rows, len(df.columns)))


# ---- balancing ----------------------------------------------------------------------------

def undersample(df: DataFrame, target: str, id_col: str, seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest, rows chosen by a hash of the id."""
    least = df.where(C.quoted(target).isNotNull()).groupBy(C.quoted(target)).count().agg(F.min("count")).first()[0]
    return take_per_class(df.where(C.quoted(target).isNotNull()), target, lambda n: least, id_col, seed)
