"""Packing of documents into sequences as a cutting-stock problem, solved by column generation.

A document gives whole sequences and a tail shorter than one; Spark counts the tails per length. A pattern says how many tails of which
lengths fill one sequence. A linear program asks for the mix of patterns that meets the histogram with the fewest cuts; a knapsack by dynamic
programming over the token capacity prices new patterns with the duals, until none saves a cut. Lengths are dealt into groups of some hundred, a
program each, which keeps its inverse small and loses little, as every group spans all lengths. Patterns that fill a sequence to the last
token are rounded to whole numbers. What they leave is packed by subset sums, and a place that no subset fills gets a part of a tail that is cut.

All this moves counts per length; the plan holds runs of ranks of tails within a length, so its size follows the capacity and not the corpus.
Spark ranks the tails (a running place per task plus a prefix sum over tasks) and looks up each place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import shared_table
from plumbline.llm.token_output import id_type, rank_encoder

TEXTS_AT_ONCE = 128
#: Length and rank share one number in look-ups.
RANK_BITS = 44
TINY = 1e-9
Pattern = tuple[tuple[int, int], ...]


def knapsack(sizes: np.ndarray, price: np.ndarray, most: np.ndarray, width: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """For every exact sum up to ``width`` the largest total price of at most ``most`` items of each size (-inf: not reachable),
    and the steps (item, how many at once, sums at which they were taken)."""
    value, steps = np.full(width + 1, -np.inf), []
    value[0] = 0.0
    for i, size in enumerate(sizes.tolist()):
        left, bundle = min(int(most[i]), width // size), 1
        while left:
            many = min(bundle, left)
            weight = size * many
            with_it = value[:-weight] + many * price[i]
            better = with_it > value[weight:] + TINY
            value[weight:][better] = with_it[better]
            steps.append((i, many, better))
            left, bundle = left - many, 2 * bundle
    return value, steps


def pattern_at(steps: list[tuple[int, int, np.ndarray]], sizes: np.ndarray, total: int) -> dict[int, int]:
    """The items behind one sum of ``knapsack``."""
    items: dict[int, int] = {}
    for i, many, better in reversed(steps):
        weight = int(sizes[i]) * many
        if total >= weight and better[total - weight]:
            items[i] = items.get(i, 0) + many
            total -= weight
    return items


def subset_sum(items: list[tuple[int, int]], width: int) -> dict[int, int]:
    """Items (size, how many there are; ascending) with the largest sum within ``width``, large sizes first."""
    reach, mask, steps = 1, (1 << (width + 1)) - 1, []
    for size, n in items:
        for _ in range(min(n, width // size)):
            steps.append((size, reach))
            reach = (reach | reach << size) & mask
    left, taken = reach.bit_length() - 1, {}
    for size, before in reversed(steps):
        if left >= size and before >> (left - size) & 1:
            taken[size] = taken.get(size, 0) + 1
            left -= size
    return taken


def spread(items: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """About ``n`` of the items, the largest among them."""
    step = -(-len(items) // n)
    return items[::-1][::step][::-1] if step > 1 else items


def best_subset(items: list[tuple[int, int]], width: int) -> dict[int, int]:
    """As ``subset_sum``; a part of the items is tried first, and will do if it fills the width."""
    for n in (64, 256, len(items)):
        taken = subset_sum(spread(items, n), width)
        if sum(s * n for s, n in taken.items()) == width or n >= len(items):
            break
    return taken


class Master:
    """The restricted linear program: patterns whose amounts meet the demand with as few cuts as can be, kept as a basis with its inverse.

    A pattern that fills its sequence costs nothing. Any other costs one cut, of a tail that fills it up; so does cutting a tail instead
    of giving it a place, and giving its place to a cut one. The dual of a length is thus within one cut either way, which keeps the
    prices steady. The first basis comes from using one pattern after the other until a length runs out: each pattern stands for that
    length, which the later ones do not have, so the basis is triangular.
    """

    def __init__(self, sizes: np.ndarray, demand: np.ndarray, most: np.ndarray, width: int):
        m, at = len(sizes), {int(s): i for i, s in enumerate(sizes)}
        self.sizes, self.width = sizes, width
        self.patterns: list[Pattern] = [((i, 1),) for i in range(m)]
        self.amount, left = np.zeros(m), demand.copy()
        open_ = [(int(s), int(n)) for s, n in zip(sizes, most)]
        while open_:
            taken = best_subset(open_, width)
            amount, out = min((left[at[s]] / n, at[s]) for s, n in taken.items())
            self.patterns[out], self.amount[out] = tuple(sorted((at[s], n) for s, n in taken.items())), amount
            for s, n in taken.items():
                left[at[s]] -= n * amount
            left[out] = 0.0
            open_ = [(s, n) for s, n in open_ if left[at[s]] > TINY]
        basis = np.zeros((m, m))
        for k, pattern in enumerate(self.patterns):
            for i, n in pattern:
                basis[i, k] = n
        self.cost = np.array([float(self.room(p) > 0) for p in self.patterns])
        self.inverse = np.linalg.inv(basis)
        self.dual = self.cost @ self.inverse

    def room(self, pattern: Pattern) -> int:
        return self.width - sum(int(self.sizes[i]) * n for i, n in pattern)

    def saves(self, pattern: Pattern, cost: float) -> float:
        """Cuts that a unit of the pattern saves."""
        return sum(self.dual[i] * n for i, n in pattern) - cost

    def enter(self, pattern: Pattern, cost: float) -> None:
        items, often = [i for i, _ in pattern], np.array([n for _, n in pattern], float)
        change = self.inverse[:, items] @ often
        rows = np.flatnonzero(np.abs(change) > TINY)
        up = rows[change[rows] > TINY]
        if not len(up):
            return
        ratio = self.amount[up] / change[up]
        ties = up[ratio <= ratio.min() + TINY]
        out = int(ties[np.argmax(change[ties])])  # of ties the steadiest pivot
        step = max(0.0, float(ratio.min()))
        row = self.inverse[out] / change[out]
        rest = rows[rows != out]
        self.dual -= self.saves(pattern, cost) * row
        self.amount[rest] -= step * change[rest]
        self.inverse[rest] -= change[rest, None] * row
        self.inverse[out], self.amount[out], self.cost[out], self.patterns[out] = row, step, cost, pattern

    def cuts(self) -> float:
        return float(self.cost @ self.amount)


def column_generation(sizes: np.ndarray, demand: np.ndarray, width: int, tolerance: float, rounds: int, columns: int = 32, priced: int = 256) -> list[tuple[Pattern, float]]:
    """Patterns and their amounts in the linear program's solution.

    A pattern has a length no more than twice as often as a sequence does on average. Demands are moved by up to a hundredth, each by
    its own share, so that two lengths hardly run out at once and no step is empty. Each round prices ``priced`` lengths, half of them the dearest
    and half drawn by lot, and all lengths once those give nothing. Ends when no pattern saves a cut, when there are fewer than ``tolerance``
    cuts a sequence, or after ``rounds`` knapsacks; whichever it is, the amounts meet the demand.
    """
    draw = np.random.default_rng(0)
    most = np.maximum(1, np.ceil(2 * demand * width / float(sizes @ demand))).astype(np.int64)
    master = Master(sizes, demand * (1 + 0.01 * draw.random(len(sizes))), most, width)
    sequences, everything = float(sizes @ demand) / width, len(sizes) <= priced
    for _ in range(rounds):
        if master.cuts() <= tolerance * sequences:
            break
        for sign in (1, -1):  # cut a tail, or fill its place with a cut one
            beyond = sign * master.dual - 1
            for i in np.argsort(-beyond)[:columns].tolist():
                if sign * master.dual[i] > 1 + 1e-7:
                    master.enter(((i, sign),), 1.0)
        if everything:
            own = np.arange(len(sizes))
        else:
            dear = np.argsort(-master.dual, kind="stable")
            own = np.sort(np.concatenate([dear[:priced // 2], draw.permutation(dear[priced // 2:])[:priced // 2]]))
        value, steps = knapsack(sizes[own], master.dual[own], most[own], width)
        ends = {width: 0.0} | {int(e): 1.0 for e in np.argsort(-value, kind="stable")[:columns]}
        waiting = [(tuple(sorted((int(own[i]), n) for i, n in pattern_at(steps, sizes[own], e).items())), 0.0 if e == width else 1.0) for e, c in ends.items() if value[e] > c + 1e-7]
        if not waiting:
            if everything:
                break
            everything = True
            continue
        everything = len(sizes) <= priced
        for _ in waiting:
            saved = [master.saves(*w) for w in waiting]
            best = int(np.argmax(saved))
            if saved[best] <= 1e-7:
                break
            master.enter(*waiting[best])
    return [(p, float(x)) for p, x in zip(master.patterns, master.amount) if x > TINY and all(n > 0 for _, n in p)]


@dataclass(frozen=True)
class CuttingPlan:
    """``rows``: (length, first rank, tails, layer, start, part, per, before, sequence, offset) of runs of tails. Of each, ``part`` ids from ``start`` on are
    placed: ``per`` in a sequence from ``sequence`` and ``offset`` on, ``before`` having been placed so already. A whole
    tail is one part in layer 0; the parts of a cut one are in layers 0, 1 and so on."""

    rows: np.ndarray
    sequences: int


class Stock:
    """Tails and remainders of cut ones by length, as runs (length of the tail, first rank, tails, start, layer)."""

    def __init__(self, counts: list[tuple[int, int]]):
        self.left = {length: n for length, n in sorted(counts) if n}
        self.runs = {length: [(length, 0, n, 0, 0)] for length, n in self.left.items()}
        self.rows: list[tuple[int, ...]] = []
        self.sequences = 0

    def items(self) -> list[tuple[int, int]]:
        return sorted(self.left.items())

    def take(self, length: int, n: int) -> Iterator[tuple[int, int, int, int, int]]:
        self.left[length] -= n
        runs = self.runs[length]
        while n:
            own, rank, many, start, layer = runs.pop()
            if many > n:
                runs.append((own, rank + n, many - n, start, layer))
            yield own, rank, min(many, n), start, layer
            n -= min(many, n)
        if not self.left[length]:
            del self.left[length], self.runs[length]

    def place(self, length: int, per: int, times: int, offset: int, part: int | None = None) -> None:
        """``per`` items in each of the next ``times`` sequences; with ``part`` that many ids of each, the rest going back."""
        before = 0
        for own, rank, many, start, layer in self.take(length, per * times):
            self.rows.append((own, rank, many, layer, start, part or length, per, before, self.sequences, offset))
            before += many
            if part:
                rest = length - part
                self.left[rest] = self.left.get(rest, 0) + many
                self.runs.setdefault(rest, []).append((own, rank, many, start + part, layer + 1))

    def use(self, pattern: dict[int, int], times: int, fill: int = 0, room: int = 0) -> None:
        """Fill the next ``times`` sequences with the pattern and, if there is ``room``, with that much of an item of length ``fill``."""
        offset = 0
        for length, per in pattern.items():
            self.place(length, per, times, offset)
            offset += per * length
        if room:
            self.place(fill, 1, times, offset, room)
        self.sequences += times


def plan_cutting(counts: list[tuple[int, int]], width: int, tolerance: float = 0.001, rounds: int = 60, group: int = 256) -> CuttingPlan:
    """Sequences without padding for the given (length, number of tails), lengths below ``width``."""
    stock = Stock(counts)
    groups = -(-len(stock.left) // group)
    found = []
    for g in range(groups):
        own = stock.items()[g::groups]
        sizes = np.array([s for s, _ in own], np.int64)
        solved = column_generation(sizes, np.array([n for _, n in own], float), width, tolerance, rounds)
        found += [({int(sizes[i]): n for i, n in p}, x) for p, x in solved if sum(int(sizes[i]) * n for i, n in p) == width]
    found.sort(key=lambda e: (-e[1], sorted(e[0].items())))
    for up in (0.05, 0.95):
        for i, (pattern, x) in enumerate(found):
            times = min(int(x + up), *(stock.left.get(s, 0) // n for s, n in pattern.items()))
            if times > 0:
                stock.use(pattern, times)
                found[i] = (pattern, x - times)
    fill = 0
    while sum(s * n for s, n in stock.left.items()) >= width:
        taken = best_subset(stock.items(), width)
        room = width - sum(s * n for s, n in taken.items())
        times = min(stock.left[s] // n for s, n in taken.items())
        if room:
            # One length after the other is cut, the most frequent first, so that the cut tails are of few lengths. Beside the
            # pattern there is one longer than the room, or everything had fit.
            spare = {s: n - taken.get(s, 0) for s, n in stock.left.items() if s > room and n > taken.get(s, 0)}
            fill = fill if fill in spare else max(spare, key=lambda s: (spare[s], s))
            times = min([times, stock.left[fill] // (taken.get(fill, 0) + 1)])
        stock.use(taken, times, fill, room)
    # Less than a sequence is left: it is laid out over powers of two.
    total, bits = sum(s * n for s, n in stock.left.items()), [1 << b for b in reversed(range(width.bit_length()))]
    for size in [b for b in bits if total & b]:
        room, offset = size, 0
        while room:
            length = max((s for s in stock.left if s <= room), default=min(stock.left))
            part = min(length, room)
            stock.place(length, 1, 1, offset, part if part < length else None)
            room, offset = room - part, offset + part
        stock.sequences += 1
    return CuttingPlan(np.array(sorted(stock.rows), np.int64).reshape(-1, 10), stock.sequences)


def tokenized(docs: DataFrame, path: str, pattern: str, end: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """Per document its ids, the CRC-32 of its whole sequences and of its tail, and its places in its task: ``turn`` among the tails of
    that length, ``whole`` among the whole sequences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = rank_encoder(path, pattern), TaskContext.get().partitionId()
        kind = np.dtype(id_type(max(encoder.n_vocab, end + 1)))
        turns, wholes, row = np.zeros(width + 1, np.int64), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                out: list[list] = [[] for _ in TOKEN_TYPES]
                for ident, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*encoder.encode_ordinary(text or ""), end], "<u4")
                    n, tail = divmod(len(ids), width)
                    crcs = [zlib.crc32(ids[i * width:(i + 1) * width]) for i in range(n)]
                    values = (ident, task, row, len(ids), ids.astype(kind).tobytes(), kind.itemsize, crcs, wholes, tail, zlib.crc32(ids[n * width:]), int(turns[tail]))
                    for column, value in zip(out, values):
                        column.append(value)
                    turns[tail] += 1
                    wholes, row = wholes + n, row + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, TOKEN_TYPES)], names=TOKEN_NAMES)

    plain = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return plain.mapInArrow(work, TOKENS)


TOKENS = "doc_id bigint, task int, row bigint, doc_tokens bigint, ids binary, id_bytes int, crcs array<bigint>, whole bigint, tail bigint, tail_crc bigint, turn bigint"
TOKEN_NAMES = [c.split()[0] for c in TOKENS.split(", ")]
TOKEN_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
PLACED = "doc_id bigint, task int, row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
PLACED_NAMES = [c.split()[0] for c in PLACED.split(", ")]


def part_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The CRC-32 of cut parts, from the ids of their documents (the columns after those of ``PLACED``)."""
    for batch in batches:
        found = []
        for start, length, ids, size in zip(*(batch.column(c).to_pylist() for c in ("start", "length", "ids", "id_bytes"))):
            found.append(zlib.crc32(np.frombuffer(ids, f"<u{size}")[start:start + length].astype("<u4")))
        names = [n for n in PLACED_NAMES if n not in ("task", "row")]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()) if n == "ids_crc32" else batch.column(n) for n in names], names=names)


def cutting_stock_packing(
    docs: DataFrame, path: str, pattern: str, width: int = 2048, end: int = 1, tolerance: float = 0.001, rounds: int = 60, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` is a rank file and ``pattern`` its word pattern; ``end`` follows every document. A sequence holds ``width`` ids, but for
    the last few, whose lengths are powers of two: none needs padding. Documents longer than a sequence are cut at its width; others
    are cut only where neither patterns nor subset sums place them whole. Null texts count as empty and are one id. Repeated rows
    and null ids are packed like any other. An empty table gives an empty result. Extra columns play no part. ``tolerance`` and ``rounds``
    end the column generation; they move cuts and nothing else.
    """
    spark = docs.sparkSession
    made = shared_table(tokenized(docs, path, pattern, end, width, id_col, text_col), "tokens")
    plain = made.drop("ids", "id_bytes")
    by_task = plain.groupBy("task", "tail").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("crcs")).alias("wholes"))
    before = lambda *keys: Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "tail", F.coalesce(F.sum("n").over(before("tail")), F.lit(0)).alias("base"))
    sizes = by_task.groupBy("tail").agg(F.sum("n").alias("n"), F.sum("wholes").alias("wholes")).collect()
    wholes = sum(r["wholes"] for r in sizes)
    plan = plan_cutting([(r["tail"], r["n"]) for r in sizes if r["tail"]], width, tolerance, rounds)
    told = spark.sparkContext.broadcast(plan)

    # Whole sequences are numbered after those of the plan, task by task and within it as they came.
    by_slice = by_task.groupBy("task").agg(F.sum("wholes").alias("wholes")).withColumn("slice", F.floor(F.col("task") / 1024))
    ahead = by_slice.groupBy("slice").agg(F.sum("wholes").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = by_slice.join(ahead, "slice").select("task", (F.col("ahead") + F.coalesce(F.sum("wholes").over(before("slice")), F.lit(0))).alias("first"))
    long = plain.where(F.size("crcs") > 0).join(starts, "task").select(
        "doc_id", "doc_tokens", (F.col("first") + F.col("whole") + plan.sequences).alias("first"), F.posexplode("crcs").alias("i", "ids_crc32"))
    pieces = long.select(
        "doc_id", (F.col("i") * F.lit(width)).cast("bigint").alias("start"), F.lit(width).cast("bigint").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    if not wholes:
        pieces = pieces.limit(0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = told.value.rows
        layers = [rows[rows[:, 3] == k] for k in range(int(rows[:, 3].max(initial=-1)) + 1)]
        keys = [(r[:, 0] << RANK_BITS) + r[:, 1] for r in layers]
        for batch in batches:
            own, rank, crc = (batch.column(c).to_numpy() for c in ("tail", "rank", "tail_crc"))
            head = batch.column("doc_tokens").to_numpy() - own
            for layer, key in zip(layers, keys):
                row = np.searchsorted(key, (own << RANK_BITS) + rank, side="right") - 1
                at = np.flatnonzero((row >= 0) & (layer[row, 0] == own) & (rank - layer[row, 1] < layer[row, 2]))
                _, first, _, _, start, part, per, before, sequence, offset = layer[row[at]].T
                turn = before + rank[at] - first
                known = {c: batch.column(c).take(pa.array(at)) for c in ("doc_id", "task", "row", "doc_tokens")}
                known |= {
                    "start": pa.array(head[at] + start), "length": pa.array(part), "ids_crc32": pa.array(crc[at], mask=part < own[at]),
                    "sequence_id": pa.array(sequence + turn // per), "offset": pa.array(offset + turn % per * part)}
                yield pa.RecordBatch.from_arrays([known[n] for n in PLACED_NAMES], names=PLACED_NAMES)

    tails = plain.where("tail > 0").join(bases, ["task", "tail"]).select("doc_id", "task", "row", "doc_tokens", "tail", "tail_crc", (F.col("base") + F.col("turn")).alias("rank"))
    placed = shared_table(tails.mapInArrow(place, PLACED), "places")
    names = [n for n in PLACED_NAMES if n not in ("task", "row")]
    out = pieces.unionByName(placed.where("ids_crc32 is not null").select(*names))
    lengths = sorted(set(plan.rows[plan.rows[:, 5] < plan.rows[:, 0], 0].tolist()))  # at most the width
    if lengths:
        # Only the ids of documents whose tail has a length that is cut are shuffled.
        whole = made.where(F.col("tail").isin(lengths)).select("task", "row", "ids", "id_bytes")
        cut = placed.where("ids_crc32 is null").join(whole, ["task", "row"]).select(*PLACED_NAMES, "ids", "id_bytes")
        schema = ", ".join(c for c in PLACED.split(", ") if c.split()[0] in names)
        out = out.unionByName(cut.mapInArrow(part_crcs, schema).select(*names))
    return out
