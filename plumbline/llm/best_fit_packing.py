"""Vector best-fit packing of documents into training sequences.

A piece asks for tokens, one document and an attention cost (the square of its length); a sequence
has a capacity for each. Pieces are taken longest first; each goes to the open sequence, among those
with room in every dimension, whose remaining room has the smallest weighted norm afterwards, or with
``rule="dot"`` to the one whose room points most along the piece's demand. A new sequence is opened only where none has room.

What a piece asks for is fixed by its length, so the choice is made for all pieces of one length
at once from the table of counts per length, at most ``tokens`` rows: sequences that look alike are one group with
a count, and the plan says which ranks among the pieces of a length go to which group. Its size depends
on the capacity, not on the corpus, while the packing is that of one global best-fit run. Spark counts the
lengths, ranks the pieces (a running place per task plus a prefix sum over tasks) and looks up each place.
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

from plumbline.llm.common import cut_lineage
from plumbline.llm.word_tokens import word_ids

TEXTS_AT_ONCE = 128


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence and the weights of the dimensions in the choice of a sequence."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], float)


def plan_packing(counts: list[tuple[int, int]], capacity: Capacity) -> np.ndarray:
    """Rows (length, first rank, items, items per sequence, first sequence, offset) for the given
    (length, number of pieces); a piece that breaks a limit on its own gets a sequence of its own."""
    limits, weights = capacity.limits(), np.array(capacity.weights)
    if capacity.rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {capacity.rule}")
    room = np.empty((0, 3))
    many: list[int] = []
    held: list[list[tuple[int, int, int, int]]] = []  # length, first rank, per sequence, offset
    done: list[tuple[int, list]] = []

    def cost(rooms: np.ndarray, ask: np.ndarray) -> np.ndarray:
        if capacity.rule == "dot":
            return -((rooms / limits) * (ask / limits) * weights).sum(axis=1)
        return ((((rooms - ask) / limits) ** 2) * weights).sum(axis=1)

    def put(group: int, length: int, rank: int, per: int, sequences: int) -> None:
        """Give the first ``sequences`` of a group ``per`` pieces each; the others stay a group."""
        nonlocal room
        if sequences < many[group]:
            room = np.vstack([room, room[group]])
            held.append([(n, r + sequences * q, q, o) for n, r, q, o in held[group]])
            many.append(many[group] - sequences)
            many[group] = sequences
        offset = int(limits[0] - room[group][0])
        held[group] = [*held[group], (length, rank, per, offset)]
        room[group] = room[group] - per * np.array([length, 1, length**2], float)

    for length, n in sorted(counts, reverse=True):
        ask, rank = np.array([length, 1, length**2], float), 0
        alone = bool((ask > limits).any())
        while n:
            fits = np.flatnonzero((room >= ask).all(axis=1)) if len(room) and not alone else np.empty(0, int)
            if len(fits):
                order = cost(room[fits], ask)
                group = int(fits[int(np.argmin(order))])
                others = np.delete(order, int(np.argmin(order)))
                rival = min([float(order.min())] * (many[group] > 1) + ([float(others.min())] if len(others) else []), default=np.inf)
                per, left = 1, room[group] - ask
                while (left >= ask).all() and float(cost(left[None], ask)[0]) <= rival:
                    per, left = per + 1, left - ask
                sequences = min(many[group], n // per)
                if not sequences:
                    per, sequences = n, 1
            else:
                per = 1 if alone else int(min(np.floor(limits / ask)))
                per = min(per, n)
                sequences = n // per
                room = np.vstack([room, limits])
                held.append([])
                many.append(sequences)
                group = len(many) - 1
            put(group, length, rank, per, sequences)
            rank, n = rank + per * sequences, n - per * sequences
        full = room[:, 0] < 1
        if full.any():
            done += [(many[i], held[i]) for i in np.flatnonzero(full)]
            keep = np.flatnonzero(~full)
            room, many, held = room[keep], [many[i] for i in keep], [held[i] for i in keep]
    rows, sequence = [], 0
    for count, content in [*done, *zip(many, held)]:
        rows += [(length, rank, count * per, per, sequence, offset) for length, rank, per, offset in content]
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def cut_documents(docs: DataFrame, path: str, size: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of at most ``size`` ids: doc_id, piece, start, length, ids_crc32, and task, turn: the place
    among the pieces of that length in its task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = word_ids(path), TaskContext.get().partitionId()
        tail = np.array([end], "<u4").tobytes()
        turns: dict[int, int] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(i, TEXTS_AT_ONCE)
                out: list[list] = [[] for _ in range(7)]
                for ident, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text) + tail
                    for piece, at in enumerate(range(0, len(ids), 4 * size)):
                        body = ids[at:at + 4 * size]
                        length = len(body) // 4
                        turn = turns.get(length, 0)
                        turns[length] = turn + 1
                        for column, value in zip(out, (ident, piece, at // 4, length, zlib.crc32(body), task, turn)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, PIECE_TYPES)], names=PIECE_NAMES)

    plain = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    return plain.mapInArrow(work, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, turn bigint")


PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "turn"]
PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def best_fit_packing(
    docs: DataFrame, path: str, capacity: Capacity = Capacity(), end: int = 0, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``path`` is a tokenizer file; ``end`` follows every document. Null texts count as empty and
    are one piece of one id. Repeated rows and null ids are packed like any other. An empty table gives
    an empty result. Extra columns play no part.
    """
    spark = docs.sparkSession
    pieces = cut_lineage(cut_documents(docs, path, capacity.tokens, end, id_col, text_col))
    counted = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    sizes = counted.groupBy("length").agg(F.sum("n").alias("n"))
    plan = spark.sparkContext.broadcast(plan_packing([(r["length"], r["n"]) for r in sizes.collect()], capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, per, sequence, offset = plan.value.T
        starts = (length << 44) + rank
        for batch in batches:
            own, turn = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = np.searchsorted(starts, (own << 44) + turn, side="right") - 1
            beyond = turn - rank[row]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence[row] + beyond // per[row]), pa.array(offset[row] + beyond % per[row] * own)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(bases, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("turn")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
