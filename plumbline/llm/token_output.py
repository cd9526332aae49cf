"""Packed token matrices: documents as ids, cut losslessly where too long, packed best-fit decreasing.

Every task packs what it reads, a bounded window of tokens at a time, so nothing is shuffled and no task
holds more than a window. Within a window the pieces are placed longest first into the open row with the least
sufficient room; a segment tree over the rooms, with the number of open rows at each, finds it in
``log2(width)`` steps. Rows that are less than ``full`` used at the end of a window give their pieces
back to the next one, so that only a task's last window leaves gaps.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from plumbline.llm.common import worker_cache

WINDOW_TOKENS = 4_000_000
FULL = 0.97
SCHEMA = (
    "sequence_id bigint, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<bigint>, pieces array<int>, starts array<bigint>"
)


class RoomTree:
    """Segment tree over room sizes; a node holds how many open rows lie below it."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def least(self, wanted: int) -> int | None:
        """The smallest room of at least ``wanted`` that an open row has."""
        node = wanted + self.size
        if self.count[node]:
            return wanted
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def pack(lengths: list[int], width: int) -> list[list[int]]:
    """Best-fit decreasing: rows of piece numbers, no row longer than ``width``."""
    tree, open_, rows = RoomTree(width), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        room = tree.least(need)
        if room is None:
            rows.append([])
            row, room = len(rows) - 1, width
        else:
            row = open_[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        room -= need
        if room:
            open_.setdefault(room, []).append(row)
            tree.add(room, 1)
    return rows


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def rank_encoder(path: str, pattern: str):
    """The library's encoder for a rank file, loaded once per worker."""
    import tiktoken

    state = worker_cache(f"ranks:{path}")
    if not state:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        state["encoder"] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return state["encoder"]


def token_output(
    docs: DataFrame, path: str, pattern: str, end: int, width: int = 2048, pad: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW_TOKENS,
) -> DataFrame:
    """One row per packed sequence, ready to be written as Parquet.

    ``input_ids`` holds ``width`` little-endian ids (two bytes each if all ids fit, else four), padded with ``pad`` (the
    ``end`` id if none is given); the first ``n_tokens`` are text. ``cu_seqlens`` are the cumulative segment lengths from 0,
    ``position_resets`` the places where positions begin at 0 again, ``position_ids`` the positions (same type, 0 in the padding).
    ``doc_ids``, ``pieces`` and ``starts`` name each segment's document, piece number and first id there, so documents can be put together again.

    Every document ends in ``end``; null and empty texts are that id alone. Repeated rows and null ids are packed
    each. An empty table gives an empty result. Extra columns play no part. Sequence numbers hold the task's number and so
    follow the table's files.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, made = rank_encoder(path, pattern), TaskContext.get().partitionId(), 0
        kind = np.dtype(id_type(max(encoder.n_vocab, end + 1, (pad or 0) + 1)))
        held: list[tuple[int | None, int, int, np.ndarray]] = []
        tokens = 0

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal held, tokens, made
            out, rest = [], []
            for row in pack([len(h[3]) for h in held], width):
                segments = [held[i] for i in row]
                used = sum(len(s[3]) for s in segments)
                if not last and used < FULL * width:
                    rest += segments
                    continue
                ids, places = np.full(width, end if pad is None else pad, kind), np.zeros(width, kind)
                bounds = np.cumsum([0, *[len(s[3]) for s in segments]])
                for a, b, s in zip(bounds, bounds[1:], segments):
                    ids[a:b], places[a:b] = s[3], np.arange(b - a)
                out.append((task << 32 | made, used, ids.tobytes(), places.tobytes(), bounds.tolist(), bounds[:-1].tolist(), [s[0] for s in segments], [s[1] for s in segments], [s[2] for s in segments]))
                made += 1
            held, tokens = rest, sum(len(s[3]) for s in rest)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, TYPES)], names=NAMES)

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encoder.encode_ordinary(text or ""), end], kind)
                held += [(ident, piece, at, ids[at:at + width]) for piece, at in enumerate(range(0, len(ids), width))]
                tokens += len(ids)
                if tokens >= window:
                    yield emit(False)
                    if tokens > window // 2:  # poorly packable; let go rather than grow
                        yield emit(True)
        yield emit(True)

    plain = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    return plain.mapInArrow(work, SCHEMA)


NAMES = ["sequence_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "position_resets", "doc_ids", "pieces", "starts"]
TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
