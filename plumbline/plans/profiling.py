"""The shared pass over a table: each statistic is computed once and kept as driver scalars.

A ``Profile`` wraps a DataFrame. Every property is a fixed number of scalars per
column (or per column pair); the table itself never leaves the executors.
Operators accept a DataFrame or a Profile, so a bundle shares one set of scans.
"""

from __future__ import annotations

from functools import cached_property
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import columns as C
from plumbline.plans.frames import chunks
from plumbline.plans.products import pair_sums
from plumbline.plans.quantiles import exact_quantiles

#: Types of which a hash tells values apart as grouping does.
FLAT = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


class Profile:
    def __init__(self, df: DataFrame):
        self.df = df
        self.spark = df.sparkSession
        self.columns = df.columns
        self.numeric = C.numeric_columns(df)
        self.text = C.text_columns(df)
        self.datetime = C.datetime_columns(df)

    def number(self, name: str) -> Column:
        return C.as_number(self.df, name)

    @cached_property
    def _base(self) -> dict:
        """Rows, missing cells and moments.

        A scan takes as many columns as keep its aggregation buffers within one
        generated loop: five numeric ones at 17 buffer fields each, others at one. Each
        column is read once in all.
        """
        out: dict = {"missing": {}, "moments": {}, "rows": None}
        others = [c for c in self.columns if c not in self.numeric]
        parts = [(n, []) for n in chunks(self.numeric, 5)] or [([], [])]
        for k, extra in enumerate(chunks(others, 8)):
            if k < len(parts):
                parts[k][1].extend(extra)
            else:
                parts.append(([], extra))
        for numeric, extra in parts:
            aggs = [F.count(F.lit(1)).alias("rows")]
            for i, c in enumerate(numeric):
                x = self.number(c)
                aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_pop(x).alias(f"std{i}"), F.min(x).alias(f"min{i}"),
                         F.max(x).alias(f"max{i}"), F.skewness(x).alias(f"g1{i}"), F.kurtosis(x).alias(f"g2{i}")]
            aggs += [F.count(F.when(~C.is_null(self.df, c), F.lit(1))).alias(f"k{i}") for i, c in enumerate(extra)]
            row = self.df.agg(*aggs).first()
            out["rows"] = row["rows"]
            for i, c in enumerate(numeric):
                out["moments"][c] = _corrected({f: row[f"{f}{i}"] for f in ("n", "mean", "std", "min", "max", "g1", "g2")})
                out["missing"][c] = row["rows"] - row[f"n{i}"]
            for i, c in enumerate(extra):
                out["missing"][c] = row["rows"] - row[f"k{i}"]
        out["missing"] = {c: out["missing"][c] for c in self.columns}
        return out

    @property
    def rows(self) -> int:
        return self._base["rows"]

    @property
    def missing(self) -> dict[str, int]:
        return self._base["missing"]

    @property
    def missing_cells(self) -> int:
        return sum(self.missing.values())

    @property
    def missing_pct(self) -> float:
        cells = self.rows * len(self.columns)
        return 100.0 * self.missing_cells / cells if cells else 0.0

    @property
    def moments(self) -> dict[str, dict]:
        return self._base["moments"]

    @cached_property
    def filled(self) -> list[str]:
        """Numeric columns with at least one value."""
        return [c for c in self.numeric if self.moments[c]["n"]]

    @cached_property
    def distinct(self) -> dict[str, int]:
        """Distinct counts, null and NaN left out; maps have none.

        One scan turns each cell into its column's number and a 128-bit hash of the value; tasks fold them
        before one shuffle of narrow rows, so long texts are never moved.
        """
        names = [f.name for f in self.df.schema if not isinstance(f.dataType, T.MapType)]
        if not names:
            return {}
        cells = [F.when(~C.is_null(self.df, c), F.struct(
            F.lit(i).alias("i"), F.xxhash64(C.quoted(c)).alias("a"), F.xxhash64(F.lit(1), C.quoted(c)).alias("b"))) for i, c in enumerate(names)]
        folded = self.df.select(F.explode(F.array(*cells)).alias("m")).where("m is not null").select("m.*").distinct()
        found = {r["i"]: r["count"] for r in folded.groupBy("i").count().collect()}
        return {c: found.get(i, 0) for i, c in enumerate(names)}

    @cached_property
    def quartiles(self) -> dict[str, tuple[float, float, float]]:
        known = {c: (m["n"], float(m["min"]), float(m["max"])) for c, m in self.moments.items() if m["n"]}
        got = exact_quantiles(self.df, self.filled, [0.25, 0.5, 0.75], rows=self.rows, known=known)
        return {c: tuple(q) for c, q in got.items()}

    @cached_property
    def fences(self) -> dict[str, tuple[float, float]]:
        out = {}
        for c, (q1, _, q3) in self.quartiles.items():
            out[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        return out

    @cached_property
    def outliers(self) -> dict[str, dict]:
        """Per column: values outside the fences, and mean and std of those inside."""
        out = {}
        for part in chunks(self.filled, 15):
            aggs = []
            for i, c in enumerate(part):
                x, (lo, hi) = self.number(c), self.fences[c]
                inside = F.when(x.between(lo, hi), x)
                aggs += [F.count_if((x < lo) | (x > hi)), F.avg(inside), F.stddev_samp(inside)]
            row = self.df.agg(*[a.alias(f"o{i}") for i, a in enumerate(aggs)]).first()
            for i, c in enumerate(part):
                out[c] = dict(zip(("n", "mean_inside", "std_inside"), row[3 * i : 3 * i + 3]))
        return out

    @property
    def outlier_total(self) -> int:
        return sum(o["n"] for o in self.outliers.values())

    @cached_property
    def duplicates(self) -> int:
        """Rows that repeat an earlier row; copies are folded before the shuffle.

        Flat columns go as one 128-bit hash of the values and of which are null, so that rows are never moved; nested ones as they are.
        """
        flat = [C.quoted(f.name) for f in self.df.schema if isinstance(f.dataType, FLAT)]
        keys = [C.quoted(f.name) for f in self.df.schema if not isinstance(f.dataType, FLAT)]
        if flat:
            told = [*[c.isNull() for c in flat], *flat]
            keys += [F.xxhash64(*told).alias("_a"), F.xxhash64(F.lit(1), *told).alias("_b")]
        distinct = self.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        return distinct.agg(F.sum(F.col("_n") - 1)).first()[0] or 0

    @cached_property
    def correlations(self) -> dict[tuple[str, str], float | None]:
        """Pairwise-complete Pearson r of every pair of numeric columns.

        Columns are centred on their known means first, then one scan sums the products of all pairs, each
        over its own complete rows.
        """
        found: dict[tuple[str, str], float | None] = {p: None for p in combinations(self.numeric, 2)}
        varied = [c for c in self.filled if self.moments[c]["min"] != self.moments[c]["max"]]
        if len(varied) < 2:
            return found
        centred = [self.number(c) - F.lit(self.moments[c]["mean"]) for c in varied]
        s = pair_sums(self.df, centred, complete=not any(self.missing[c] for c in varied))
        for (i, a), (j, b) in combinations(enumerate(varied), 2):
            n = s.n[i, j]
            if n > 1 and s.least[i, j] != s.most[i, j] and s.least[j, i] != s.most[j, i]:
                spread = (s.xx[i, j] - s.x[i, j] ** 2 / n) * (s.xx[j, i] - s.x[j, i] ** 2 / n)
                r = (s.xy[i, j] - s.x[i, j] * s.x[j, i] / n) / spread**0.5 if spread > 0 else 0.0
                found[(a, b)] = float(max(-1.0, min(1.0, r)))
        return found

    def value_counts(self, names: list[str] | None = None) -> DataFrame:
        """(column, value, n) of the text columns, nulls left out, in one pass."""
        names = self.text if names is None else names
        cells = [F.struct(F.lit(c).alias("column"), C.quoted(c).cast("string").alias("value")) for c in names]
        if not cells:
            return self.spark.createDataFrame([], "column string, value string, n long")
        return (
            self.df.select(F.explode(F.array(*cells)).alias("m")).select("m.column", "m.value")
            .where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        )

    def histograms(self, bins: dict[str, int]) -> dict[str, list[int]]:
        """Equal-width bin counts of several columns in one scan."""
        cells = []
        for c, k in bins.items():
            m = self.moments[c]
            number = C.equal_width_bin(self.number(c), m["min"], m["max"], k)
            cells.append(F.struct(F.lit(c).alias("column"), number.alias("bin")))
        if not cells:
            return {}
        rows = (
            self.df.select(F.explode(F.array(*cells)).alias("m")).select("m.column", "m.bin")
            .where("bin is not null").groupBy("column", "bin").count().collect()
        )
        out = {c: [0] * k for c, k in bins.items()}
        for r in rows:
            out[r["column"]][r["bin"]] = r["count"]
        return out


def _corrected(m: dict) -> dict:
    """Sample versions of the population moments; a constant column has no skew."""
    n, g1, g2, spread = m["n"], m.pop("g1"), m.pop("g2"), m.pop("std")
    constant = not n or m["min"] == m["max"]
    g1 = 0.0 if constant or g1 is None or g1 != g1 else g1
    g2 = None if constant or g2 is None or g2 != g2 else g2
    m["std_pop"] = spread
    m["std"] = spread * (n / (n - 1)) ** 0.5 if n > 1 else None
    m["skew_pop"], m["kurt_pop"] = g1, g2
    m["skew"] = g1 * (n * (n - 1)) ** 0.5 / (n - 2) if n >= 3 else 0.0
    m["kurt"] = (
        (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if n >= 4 and g2 is not None else None
    )
    return m


def profiled(data: DataFrame | Profile) -> Profile:
    return data if isinstance(data, Profile) else Profile(data)
