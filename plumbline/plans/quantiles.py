"""Exact quantiles without gathering a column in one task.

Spark's ``percentile`` keeps a value -> count map of a whole group in one task, so it
is used only for a known small number of values. Beyond that a sample guesses a bracket
around every wanted rank, one scan counts the rows below and inside all brackets of all columns, and once
brackets hold few enough rows one more scan fetches and sorts only those. A bracket that misses its rank, or
does not shrink, is halved instead. The sample decides where to look, never the answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.columns import as_number, quoted
from plumbline.plans.frames import chunks, rows_frame

SMALL_VALUES = 5_000_000
BRACKET_ROWS = 200_000
SAMPLE_ROWS = 100_000


def exact_quantiles(
    df: DataFrame, cols: list[str], probs: list[float], rows: int | None = None,
    small_values: int = SMALL_VALUES, bracket_rows: int = BRACKET_ROWS, sample_rows: int = SAMPLE_ROWS,
    known: dict[str, tuple] | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of numeric columns, nulls and NaN left out. ``known``: rows, least and greatest value of each
    column where they have been counted."""
    if not cols:
        return {}
    rows = df.count() if rows is None else rows
    if rows * len(cols) > small_values:
        return _by_brackets(df, {c: as_number(df, c) for c in cols}, probs, rows, bracket_rows, sample_rows, known)
    array = F.array(*[F.lit(float(p)) for p in probs])
    row = df.agg(*[F.percentile(as_number(df, c), array).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    return {c: list(row[i]) if row[i] is not None else [None] * len(probs) for i, c in enumerate(cols)}


def grouped_quantiles(
    df: DataFrame, key: str, col: str, probs: list[float], rows: int | None = None,
    small_values: int = SMALL_VALUES, bracket_rows: int = BRACKET_ROWS, sample_rows: int = SAMPLE_ROWS,
) -> dict[str, list[float]]:
    """Exact quantiles of one column per value of a low-cardinality key."""
    label, x = quoted(key).cast("string"), as_number(df, col)
    rows = df.count() if rows is None else rows
    if rows <= small_values:
        array = F.array(*[F.lit(float(p)) for p in probs])
        got = df.where(label.isNotNull() & x.isNotNull()).groupBy(label.alias("key")).agg(F.percentile(x, array).alias("q")).collect()
        return {r["key"]: list(r["q"]) for r in got}
    levels = [r[0] for r in df.where(label.isNotNull() & x.isNotNull()).select(label).distinct().collect()]
    found: dict[str, list[float]] = {}
    for part in chunks(levels, 50):
        exprs = {v: F.when(label == F.lit(v), x) for v in part}
        found.update(_by_brackets(df, exprs, probs, rows, bracket_rows, sample_rows))
    return found


@dataclass
class Bracket:
    """Values lo..hi hold ``inside`` rows, ``below`` rows are smaller; ranks are first..last."""

    name: str
    first: int
    last: int
    lo: float
    hi: float
    below: int
    inside: int


def _by_brackets(df: DataFrame, exprs: dict[str, Column], probs: list[float], rows: int, bracket_rows: int, sample_rows: int,
                 known: dict[str, tuple] | None = None) -> dict:
    sizes = known if known is not None else _extent(df, exprs)
    wanted: dict[tuple[str, int], float] = {}
    todo = []
    for c, (n, least, most) in sizes.items():
        for p in probs if n else []:
            first, last = math.floor(p * (n - 1)), math.ceil(p * (n - 1))
            if least == most:
                wanted[(c, first)] = wanted[(c, last)] = least
            elif (c, first, last) not in {(b.name, b.first, b.last) for b in todo}:
                todo.append(Bracket(c, first, last, least, most, 0, n))
    guesses = True
    while todo:
        small = [b for b in todo if b.inside <= bracket_rows]
        if small:
            wanted.update(_sorted_ranks(df, exprs, small))
        todo = [b for b in todo if b.inside > bracket_rows]
        spans = _guess(df, exprs, todo, bracket_rows, sample_rows) if guesses else {}
        cut = [spans.get(i) or (b.lo, b.lo + (b.hi - b.lo) / 2) for i, b in enumerate(todo)]
        closer = _tally(df, exprs, todo, cut) if todo else []
        before = sum(b.inside for b in todo)
        todo = []
        for b in closer:
            if b.lo == b.hi:
                wanted[(b.name, b.first)] = wanted[(b.name, b.last)] = b.lo
            else:
                todo.append(b)
        guesses = sum(b.inside for b in todo) < 0.7 * before
    out = {}
    for c, (n, _, _) in sizes.items():
        if not n:
            out[c] = [None] * len(probs)
            continue
        out[c] = []
        for p in probs:
            at = p * (n - 1)
            a, b = wanted[(c, math.floor(at))], wanted[(c, math.ceil(at))]
            out[c].append(a + (b - a) * (at - math.floor(at)))
    return out


def _extent(df: DataFrame, exprs: dict[str, Column]) -> dict[str, tuple]:
    """Rows, least and greatest value of each column without nulls and NaN, counted by Spark itself."""
    out: dict[str, tuple] = {}
    for part in chunks(list(exprs), 20):
        xs = [F.nanvl(exprs[c].cast("double"), F.lit(None).cast("double")) for c in part]
        row = df.agg(*[a.alias(f"{kind}{i}") for i, x in enumerate(xs) for kind, a in (("n", F.count(x)), ("lo", F.min(x)), ("hi", F.max(x)))]).first()
        out.update({c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(part)})
    return out


def _guess(df: DataFrame, exprs: dict[str, Column], todo: list[Bracket], bracket_rows: int, sample_rows: int) -> dict[int, tuple]:
    """A span around each rank from sample quantiles of its bracket; six deviations wide each way."""
    spans: dict[int, tuple] = {}
    shared: dict[tuple, list[int]] = {}
    for i, b in enumerate(todo):
        shared.setdefault((b.name, b.lo, b.hi, b.inside), []).append(i)
    for part in chunks(list(shared), 100):
        least = min(k[3] for k in part)
        most = max(k[3] for k in part)
        # No larger a sample than the next bracket needs.
        size = min(sample_rows, max(10_000, int((6 * most / bracket_rows) ** 2)))
        share = min(1.0, size / least)
        sample = df if share >= 1 else df.sample(fraction=share, seed=17)
        aggs, sides = [], []
        for key in part:
            name, lo, hi, inside = key
            held = []
            for i in shared[key]:
                b = todo[i]
                at = [(r - b.below) / max(inside - 1, 1) for r in (b.first, b.last)]
                width = [6 * math.sqrt(q * (1 - q) / (inside * share)) + 20 / (inside * share) for q in at]
                held += [at[0] - width[0], at[1] + width[1]]
            sides.append(held)
            x = F.when(exprs[name].between(lo, hi), exprs[name])
            aggs.append(F.percentile(x, F.array(*[F.lit(min(max(h, 0.0), 1.0)) for h in held])))
        row = sample.agg(*[a.alias(f"g{i}") for i, a in enumerate(aggs)]).first()
        for key, held, got in zip(part, sides, row):
            for n, i in enumerate(shared[key] if got is not None else []):
                b = todo[i]
                lo = b.lo if held[2 * n] <= 0 else got[2 * n]
                hi = b.hi if held[2 * n + 1] >= 1 else got[2 * n + 1]
                if (lo, hi) != (b.lo, b.hi):
                    spans[i] = (lo, hi)
    return spans


def _columns(df: DataFrame, exprs: dict[str, Column], part: list[Bracket]) -> tuple[DataFrame, list[list[int]]]:
    """The values of the brackets' columns, and the numbers of the brackets of each."""
    names = list(dict.fromkeys(b.name for b in part))
    of = [[i for i, b in enumerate(part) if b.name == name] for name in names]
    return df.select(*[exprs[name].cast("double").alias(f"c{i}") for i, name in enumerate(names)]), of


def _present(column: pa.Array) -> np.ndarray:
    """Values without nulls and NaN in order."""
    x = column.drop_null().to_numpy(zero_copy_only=False)
    return np.sort(x[~np.isnan(x)])


def _tally(df: DataFrame, exprs: dict[str, Column], part: list[Bracket], spans: list[tuple]) -> list[Bracket]:
    """The piece of each bracket that holds its ranks: the span, or what lies on one side of it.

    One scan counts for all brackets of all columns.
    """
    plain, of = _columns(df, exprs, part)
    edges = [np.array([(part[i].lo, *spans[i], part[i].hi) for i in own]) for own in of]
    # Below the span, in it and above it: rows, least and greatest value.
    names = [f"{kind}{k}" for k in range(3) for kind in ("n", "least", "most")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((3, len(part)), np.int64)
        least, most = np.full((3, len(part)), np.inf), np.full((3, len(part)), -np.inf)
        for batch in batches:
            for column, own, edge in zip(batch.columns, of, edges):
                x = _present(column)
                if not len(x):
                    continue
                own = np.array(own)
                ends = [np.searchsorted(x, edge[:, i], side) for i, side in enumerate(("left", "left", "right", "right"))]
                for k, (start, end) in enumerate(zip(ends, ends[1:])):
                    some = end > start
                    at = own[some]
                    rows[k, at] += (end - start)[some]
                    least[k, at], most[k, at] = np.minimum(least[k, at], x[start[some]]), np.maximum(most[k, at], x[end[some] - 1])
        columns = [pa.array(v) for k in range(3) for v in (rows[k], least[k], most[k])]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(part)), pa.int32()), *columns], names=["id", *names])

    kinds = {"n": ("bigint", F.sum), "least": ("double", F.min), "most": ("double", F.max)}
    counted = plain.mapInArrow(work, "id int, " + ", ".join(f"{c} {kinds[c[:-1]][0]}" for c in names)).groupBy("id").agg(
        *[kinds[c[:-1]][1](c).alias(c) for c in names])
    got = {r["id"]: r for r in counted.collect()}
    out = []
    for i, b in enumerate(part):
        if i not in got:
            continue
        # Every piece ends at values that occur, so a piece of one value is known to be one.
        pieces, start = [], b.below
        for k in range(3):
            pieces.append((got[i][f"least{k}"], got[i][f"most{k}"], start, got[i][f"n{k}"]))
            start += got[i][f"n{k}"]
        together = any(p[2] <= b.first and b.last < p[2] + p[3] for p in pieces)
        # Two neighbouring ranks may fall into different pieces: each then goes on alone.
        for first, last in {(b.first, b.last)} if together else {(b.first, b.first), (b.last, b.last)}:
            for low, high, below, inside in pieces:
                if below <= first and last < below + inside:
                    out.append(Bracket(b.name, first, last, low, high, below, inside))
    return out


def _sorted_ranks(df: DataFrame, exprs: dict[str, Column], part: list[Bracket]) -> dict[tuple[str, int], float]:
    """Values at the ranks of small brackets: one scan, and only rows inside some bracket are shuffled."""
    plain, of = _columns(df, exprs, part)
    edges = [[(i, part[i].lo, part[i].hi) for i in own] for own in of]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, numbers = [], [], []
            for column, own in zip(batch.columns, edges):
                x, n = np.unique(_present(column), return_counts=True)
                for i, lo, hi in own:
                    a, b = np.searchsorted(x, lo, "left"), np.searchsorted(x, hi, "right")
                    if b > a:
                        ids.append(np.full(b - a, i, np.int32))
                        values.append(x[a:b])
                        numbers.append(n[a:b])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (ids, values, numbers)], names=["id", "x", "n"])

    counts = plain.mapInArrow(work, "id int, x double, n bigint").groupBy("id", "x").agg(F.sum("n").alias("n"))
    ranks = rows_frame(df.sparkSession, [{"id": i, "first": b.first - b.below, "last": b.last - b.below} for i, b in enumerate(part)],
                       "id int, first long, last long")
    up = counts.withColumn("up", F.sum("n").over(W.partitionBy("id").orderBy("x"))).join(F.broadcast(ranks), "id")
    chosen = up.where("(up > first and up - n <= first) or (up > last and up - n <= last)").collect()
    found = {}
    for r in chosen:
        b = part[r["id"]]
        if r["up"] > r["first"] >= r["up"] - r["n"]:
            found[(b.name, b.first)] = r["x"]
        if r["up"] > r["last"] >= r["up"] - r["n"]:
            found[(b.name, b.last)] = r["x"]
    return found
