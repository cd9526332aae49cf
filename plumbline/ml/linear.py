"""Models solved from class means and cross products: one distributed pass, d x d algebra.

Rows carry a ``features`` vector and a ``label``. Each task adds up its own blocks with
matrix products; the sums meet in one grouped aggregate of d x d numbers per class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_to_matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0))


def cross_products(df: DataFrame, by_class: bool = False) -> dict[float, np.ndarray]:
    """Per class (or overall under 0.0) the sum of z zᵀ with z = (1, features, label)."""
    base = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[float, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            y = b["label"].to_numpy(dtype=float)
            z = np.column_stack([np.ones(len(b)), rows_to_matrix(b["x"]), y])
            for k in np.unique(y) if by_class else [0.0]:
                part = z[y == k] if by_class else z
                sums[k] = sums.get(k, 0.0) + part.T @ part
        for k, m in sums.items():
            yield pd.DataFrame({"k": [float(k)], "m": [m.ravel()]})

    partial = base.mapInPandas(block, "k double, m array<double>")
    summed = partial.select("k", F.posexplode("m").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    flat: dict[float, dict[int, float]] = {}
    for r in summed.collect():
        flat.setdefault(r["k"], {})[r["i"]] = r["v"]
    out = {}
    for k, cells in flat.items():
        d = int(round(len(cells) ** 0.5))
        out[k] = np.array([cells[i] for i in range(d * d)]).reshape(d, d)
    return out


def _quadratic(a: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.column_stack([c - 0.5 * (((x - m) @ r) ** 2).sum(axis=1) for m, r, c in zip(a["means"], a["roots"], a["constant"])])


#: How a matrix model scores feature rows from its arrays.
FORMS: dict[str, Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]] = {
    "linear": lambda a, x: x @ a["slope"] + a["constant"], "quadratic": _quadratic}


class MatrixModel:
    """Scores rows by one of ``FORMS`` of the feature matrix, one Arrow batch at a time."""

    def __init__(self, name: str, form: str, arrays: dict[str, np.ndarray], classes: list[float] | None, weights: np.ndarray | None = None):
        self.name, self.form, self.arrays, self.classes, self.weights = name, form, arrays, classes, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return FORMS[self.form](self.arrays, x)

    def transform(self, df: DataFrame) -> DataFrame:
        form, arrays, classes = self.form, self.arrays, self.classes

        @F.pandas_udf("struct<prediction:double,probability:array<double>>")
        def apply(x: pd.Series) -> pd.DataFrame:
            s = FORMS[form](arrays, rows_to_matrix(x))
            if classes is None:
                return pd.DataFrame({"prediction": s, "probability": [None] * len(s)})
            e = np.exp(s - s.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            return pd.DataFrame({"prediction": np.array(classes)[s.argmax(axis=1)], "probability": list(p)})

        scored = df.withColumn("_s", apply(vector_to_array("features")))
        out = scored.withColumn("prediction", F.col("_s.prediction"))
        return (out.withColumn("probability", F.col("_s.probability")) if classes else out).drop("_s")


def _linear(name: str, beta: np.ndarray, intercept: float) -> MatrixModel:
    return MatrixModel(name, "linear", {"slope": np.asarray(beta, float), "constant": np.float64(intercept)}, None, np.abs(beta))


def _moments(m: np.ndarray):
    """(rows, feature means, label mean, centred XᵀX, centred Xᵀy, centred yᵀy)."""
    n = m[0, 0]
    mean = m[0] / n
    c = m - n * np.outer(mean, mean)
    return n, mean[1:-1], mean[-1], c[1:-1, 1:-1], c[1:-1, -1], c[-1, -1]


def fit_bayesian_ridge(df: DataFrame, rounds: int = 300, tol: float = 1e-3) -> MatrixModel:
    """Evidence maximisation over noise and weight precision from the cross products."""
    n, mx, my, a, b, yy = _moments(cross_products(df)[0.0])
    values, vectors = np.linalg.eigh(a)
    values = np.clip(values, 0.0, None)
    rotated = vectors.T @ b
    alpha, lam = (n / yy if yy > 0 else 1.0), 1.0
    beta = np.zeros(len(b))
    for _ in range(rounds):
        new = vectors @ (rotated / (values + lam / alpha))
        rss = max(yy - 2 * new @ b + new @ a @ new, 1e-12 * yy, 1e-300)
        gamma = float((alpha * values / (lam + alpha * values)).sum())
        lam = (gamma + 2e-6) / (new @ new + 2e-6)
        alpha = (n - gamma + 2e-6) / (rss + 2e-6)
        done = np.abs(new - beta).sum() < tol
        beta = new
        if done:
            break
    return _linear("bayesian ridge", beta, my - mx @ beta)


def _scaled(a: np.ndarray, b: np.ndarray):
    s = np.sqrt(np.clip(np.diag(a), 0.0, None))
    s = np.where(s > 0, s, 1.0)
    return s, a / np.outer(s, s), b / s


def fit_omp(df: DataFrame, k: int | None = None) -> MatrixModel:
    """Orthogonal matching pursuit; a tenth of the features unless told otherwise."""
    _, mx, my, a, b, _ = _moments(cross_products(df)[0.0])
    s, g, c = _scaled(a, b)
    k = k or max(1, len(b) // 10)
    chosen: list[int] = []
    beta = np.zeros(len(b))
    for _ in range(min(k, len(b))):
        residual = c - g @ beta
        residual[chosen] = 0.0
        j = int(np.abs(residual).argmax())
        if abs(residual[j]) < 1e-12:
            break
        chosen.append(j)
        beta = np.zeros(len(b))
        beta[chosen] = np.linalg.lstsq(g[np.ix_(chosen, chosen)], c[chosen], rcond=None)[0]
    return _linear("omp", beta / s, my - mx @ (beta / s))


def fit_lars(df: DataFrame, lasso: float | None = None, max_steps: int = 500) -> MatrixModel:
    """Least-angle regression on the cross products; with ``lasso`` its path stops at that penalty."""
    n, mx, my, a, b, _ = _moments(cross_products(df)[0.0])
    s, g, c = _scaled(a, b)
    d = len(b)
    beta, active = np.zeros(d), []
    for _ in range(max_steps):
        corr = c - g @ beta
        top = np.abs(corr).max(initial=0.0)
        floor = 0.0 if lasso is None else lasso * n
        if top <= max(floor, 1e-10):
            break
        rest = [j for j in range(d) if j not in active]
        joined = [j for j in rest if abs(corr[j]) >= top - 1e-9 * max(top, 1.0)]
        active += joined
        signs = np.sign(corr[active])
        direction = np.linalg.lstsq(g[np.ix_(active, active)], signs, rcond=None)[0]
        slope = g[:, active] @ direction
        steps = [top - floor]
        for j in range(d):
            if j not in active:
                for sign in (1, -1):
                    den = 1 - sign * slope[j]
                    if den > 1e-12:
                        step = (top - sign * corr[j]) / den
                        if 1e-12 < step < top:
                            steps.append(step)
        step = min(steps)
        drop = None
        if lasso is not None:
            for i, j in enumerate(active):
                if beta[j] and direction[i] and 0 < -beta[j] / direction[i] < step:
                    step, drop = -beta[j] / direction[i], j
        beta[active] += step * direction
        if drop is not None:
            beta[drop] = 0.0
            active.remove(drop)
    return _linear("lars", beta / s, my - mx @ (beta / s))


def fit_ridge_classifier(df: DataFrame, classes: list[float], alpha: float = 1.0) -> MatrixModel:
    """Ridge on +1 / -1 labels, one column of targets per class, from per-class sums."""
    sums = cross_products(df, by_class=True)
    total = sum(sums.values())
    n = total[0, 0]
    mean = total[0, 1:-1] / n
    a = total[1:-1, 1:-1] - n * np.outer(mean, mean) + alpha * np.eye(len(mean))
    weights, constants = [], []
    for k in classes:
        size = sums[k][0, 0] if k in sums else 0.0
        xy = 2 * (sums[k][0, 1:-1] if k in sums else 0.0) - total[0, 1:-1]
        my = (2 * size - n) / n
        w = np.linalg.solve(a, xy - n * mean * my)
        weights.append(w)
        constants.append(my - mean @ w)
    w, c = np.array(weights).T, np.array(constants)
    return MatrixModel("ridge classifier", "linear", {"slope": w, "constant": c}, classes, np.abs(w).mean(axis=1))


def fit_discriminant(df: DataFrame, classes: list[float], quadratic: bool = False, shrink: float = 1e-9) -> MatrixModel:
    """Linear or quadratic discriminant from class means and covariances."""
    sums = cross_products(df, by_class=True)
    classes = [k for k in classes if k in sums]
    n = sum(m[0, 0] for m in sums.values())
    means, covs, priors = [], [], []
    for k in classes:
        m = sums[k]
        size, mean = m[0, 0], m[0, 1:-1] / m[0, 0]
        means.append(mean)
        covs.append(m[1:-1, 1:-1] - size * np.outer(mean, mean))
        priors.append(size / n)
    means = np.array(means)
    if not quadratic:
        pooled = sum(covs) / max(n - len(classes), 1.0)
        inverse = np.linalg.pinv(pooled, rcond=shrink, hermitian=True)
        w = inverse @ means.T
        c = -0.5 * np.einsum("ij,jk,ik->i", means, inverse, means) + np.log(priors)
        return MatrixModel("lda", "linear", {"slope": w, "constant": c}, classes, np.abs(w).mean(axis=1))
    parts = []
    for mean, cov, prior in zip(means, covs, priors):
        cov = cov / max(prior * n - 1, 1.0)
        values, vectors = np.linalg.eigh(cov)
        values = np.maximum(values, shrink * max(values.max(), 1e-300))
        root = vectors / np.sqrt(values)
        parts.append((mean, root, -0.5 * np.log(values).sum() + np.log(prior)))

    means, roots, constants = (np.array(p) for p in zip(*parts))
    return MatrixModel("qda", "quadratic", {"means": means, "roots": roots, "constant": constants}, classes)


def fit_ransac(df: DataFrame, trials: int = 100, seed: int = 42, max_features: int = 500) -> MatrixModel:
    """Candidate lines through small random row sets, judged by inliers in one scan, refitted on those.

    A row is an inlier when its residual is within the median absolute deviation of
    the label.
    """
    from plumbline.plans.quantiles import exact_quantiles

    mid = exact_quantiles(df, ["label"], [0.5])["label"][0]
    spread = df.select(F.abs(F.col("label") - F.lit(mid)).alias("d"))
    limit = exact_quantiles(spread, ["d"], [0.5])["d"][0]
    base = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
    width = len(base.first()["x"])
    if width > max_features:  # every trial draws a row for each feature
        raise ValueError(f"more than {max_features} features for candidate lines; use the huber model")
    need = trials * (width + 1)
    drawn = base.orderBy(F.xxhash64("x", "label", F.lit(seed))).limit(need).collect()
    x = np.array([r["x"] for r in drawn])
    y = np.array([r["label"] for r in drawn])
    rng = np.random.default_rng(seed)
    lines = []
    for _ in range(trials):
        pick = rng.choice(len(y), size=min(width + 1, len(y)), replace=False)
        z = np.column_stack([np.ones(len(pick)), x[pick]])
        lines.append(np.linalg.lstsq(z, y[pick], rcond=None)[0])
    lines = np.array(lines)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = np.zeros(len(lines))
        for b in batches:
            if len(b):
                z = np.column_stack([np.ones(len(b)), rows_to_matrix(b["x"])])
                hits += (np.abs(z @ lines.T - b["label"].to_numpy()[:, None]) <= limit).sum(axis=0)
        yield pd.DataFrame({"i": range(len(lines)), "n": hits})

    best = base.mapInPandas(tally, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "i").first()["i"]
    line = lines[best]
    chosen = MatrixModel("candidate", "linear", {"slope": line[1:], "constant": line[0]}, None)
    inliers = chosen.transform(df.drop("prediction")).where(F.abs(F.col("prediction") - F.col("label")) <= limit).drop("prediction")
    _, mx, my, a, b, _ = _moments(cross_products(inliers)[0.0])
    beta = np.linalg.lstsq(a, b, rcond=1e-10)[0]
    return _linear("ransac", beta, my - mx @ beta)
