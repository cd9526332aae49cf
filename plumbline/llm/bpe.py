"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of one or more pre-tokens form one linked list with a gap between pre-tokens; every mergeable neighbour pair lies in the bucket of its rank, as the position of its left
part. A bitmap with one bit per rank, and above it bitmaps with one bit per word below, give the lowest rank that
is not empty by find-first-set. A bucket is emptied from left to right; entries whose pair has
changed since are skipped. As no pair crosses a gap, the order within each pre-token is that of merging it
alone, lowest rank first and leftmost among equals; the work is linear in the bytes but for the three
bitmap steps, so a single pre-token of any length costs no more than many short ones.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Recent, worker_cache

#: Pieces of text and pre-tokens whose ids a worker keeps in each of two generations, about 250 bytes each, and texts
#: encoded together.
KEPT_PIECES = 200_000
TEXTS_AT_ONCE = 128
#: Bytes of pre-tokens merged together, a longer one alone.
BYTES_AT_ONCE = 1 << 17


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 and number on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


BYTES = [bytes([i]) for i in range(256)]


class RankQueue:
    """Buckets of positions by rank under a three-level bitmap of 64-bit words."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low, self.mid, self.top = [0] * ((ranks >> 6) + 1), [0] * ((ranks >> 12) + 1), 0

    def fill(self, buckets: dict[int, list[int]]) -> None:
        """The first buckets, of an empty queue."""
        self.buckets = buckets
        for rank in buckets:
            self._mark(rank)

    def _mark(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self._mark(rank)
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions from left to right."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        a = (b << 6) + (self.mid[b] & -self.mid[b]).bit_length() - 1
        rank = (a << 6) + (self.low[a] & -self.low[a]).bit_length() - 1
        self.low[a] &= self.low[a] - 1
        if not self.low[a]:
            self.mid[b] &= self.mid[b] - 1
            if not self.mid[b]:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class Merges:
    """The merges of a rank file as a table of neighbouring ids, so that no bytes are joined or hashed while merging."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(b not in ranks for b in BYTES):
            raise ValueError("the rank file lacks single bytes")
        self.bits = max(ranks.values()).bit_length()
        self.ranks = max(ranks.values()) + 1
        halves = ((left, right, rank) for token, rank in ranks.items() for i in range(1, len(token))
                  if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None)
        self.pairs = {left << self.bits | right: rank for left, right, rank in halves}
        self.byte_ids = np.array([ranks[b] for b in BYTES], np.int64)
        # Rank of two neighbouring bytes; row and column 256 stand for a gap.
        self.byte_pairs = np.full((257, 257), -1, np.int64)
        for i, left in enumerate(BYTES):
            self.byte_pairs[i, :256] = [ranks.get(left + right, -1) for right in BYTES]

    def ids(self, pretokens: list[bytes]) -> list[bytes]:
        """Ids of every pre-token as little-endian unsigned 32-bit integers. A merged pair's id is its rank; gaps and positions
        merged away hold -1, which no pair of the table contains."""
        sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        ends = np.cumsum(sizes + 1)
        if not len(ends):
            return []
        n = int(ends[-1])
        at = np.full(n, 256, np.int64)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        at[inside] = np.frombuffer(b"".join(pretokens), np.uint8)
        start = np.full(n, -1, np.int64)
        start[:-1] = self.byte_pairs[at[:-1], at[1:]]
        waiting = np.flatnonzero(start >= 0)
        waiting = waiting[np.argsort(start[waiting], kind="stable")]
        given, first = np.unique(start[waiting], return_index=True)
        queue = RankQueue(self.ranks)
        queue.fill(dict(zip(given.tolist(), (w.tolist() for w in np.split(waiting, first[1:])) if len(given) else ())))
        parts = np.append(self.byte_ids, -1)[at].tolist()
        wanted = start.tolist()  # the rank under which a position's pair waits
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        self._merge(queue, parts, wanted, after, before)
        left = np.array(parts, np.int64)
        alive = left >= 0
        packed = left[alive].astype("<u4").tobytes()
        bounds = [0, *(4 * np.cumsum(alive)[ends - 1]).tolist()]
        return [packed[a:b] for a, b in zip(bounds, bounds[1:])]

    def _merge(self, queue: RankQueue, parts: list[int], wanted: list[int], after: list[int], before: list[int]) -> None:
        bits, pair_of, buckets, push = self.bits, self.pairs.get, queue.buckets, queue.push
        while (found := queue.pop()) is not None:
            rank, bucket = found
            for turn, i in enumerate(bucket):
                if wanted[i] != rank:
                    continue  # stale
                j = after[i]
                k = after[j]
                h = before[i]  # -1 before the first position: the last one, which is a gap
                parts[i], parts[j], wanted[j] = rank, -1, -1
                after[i], before[k] = k, i
                lower = False
                wanted[i] = new = pair_of(rank << bits | parts[k], -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        push(new, i)
                    lower = new < rank
                new = pair_of(parts[h] << bits | rank, -1)
                if new != wanted[h]:
                    wanted[h] = new
                    if new >= 0:
                        push(new, h)
                        lower |= new < rank
                if lower:  # a lower rank has come up; it goes before the rest of this bucket
                    for rest in bucket[turn + 1:]:
                        if wanted[rest] == rank:
                            push(rank, rest)
                    break


def merge_all(pretokens: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of every pre-token."""
    return [np.frombuffer(ids, "<u4").tolist() for ids in Merges(ranks).ids(pretokens)]


#: What a text of plain lines does not hold: white space beside a space or line end, and other white space.
ODD = ["  ", " \n", "\n ", "\n\n", *[c for c in map(chr, range(0x110000)) if c.isspace() and c not in " \n"]]


class Encoder:
    """Encodes whole texts; pre-tokens and pieces of text between single spaces are worked out once per worker."""

    def __init__(self, path: str, pattern: str):
        state = worker_cache(f"bpe:{path}:{pattern}")
        if not state:
            ranks = load_ranks(path)
            state.update(
                merges=Merges(ranks), tokens={v: k for k, v in ranks.items()}, find=regex.compile(pattern).findall, heads=Recent(KEPT_PIECES // 4),
                tails=Recent(KEPT_PIECES), matches=Recent(KEPT_PIECES))
        self.merges, self.tokens, self.find = state["merges"], state["tokens"], state["find"]
        self.heads, self.tails, self.matches = state["heads"], state["tails"], state["matches"]

    def pieces(self, text: str) -> list[str]:
        """The text cut before each single space between two characters that are no white space; every piece but the
        first comes without that space.

        The pattern's matches never cross such a place, and it matches the same on either side, so pieces are encoded on their own.
        """
        out: list[str] = []
        joined = False
        for i, part in enumerate(text.split(" ")):
            if i and joined and part and not part[0].isspace():
                out.append(part)
            elif i:
                out[-1] = f"{out[-1]} {part}"
            else:
                out.append(part)
            joined = bool(part) and not part[-1].isspace()
        return out

    def lines(self, text: str) -> list[list[str]]:
        """The pieces of the parts of a text that single line ends between two other characters that are no white space
        keep apart. A text with any other white space side by side is one part."""
        if any(odd in text for odd in ODD) or text[:1].isspace() or text[-1:].isspace():
            return [self.pieces(text)]
        return [line.split(" ") for line in text.split("\n")]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.lines(t or "") for t in texts]
        self.heads.fill({line[0] for lines in cut for line in lines} | {"\n"}, self._encode_pieces)
        self.tails.fill(set(chain.from_iterable(chain.from_iterable(cut))), self._encode_tails)
        head, tail = self.heads.__getitem__, self.tails.__getitem__
        return [head("\n").join([head(line[0]) + b"".join(map(tail, line[1:])) for line in lines]) for lines in cut]

    def _encode_tails(self, pieces: list[str]) -> list[bytes]:
        return self._encode_pieces([f" {p}" for p in pieces])

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        found = [self.find(p) for p in pieces]
        self.matches.fill(set(chain.from_iterable(found)), self._encode_matches)
        look_up = self.matches.__getitem__
        return [look_up(matches[0]) if len(matches) == 1 else b"".join(map(look_up, matches)) for matches in found]

    def _encode_matches(self, matches: list[str]) -> list[bytes]:
        out: list[bytes] = []
        held: list[bytes] = []
        room = BYTES_AT_ONCE
        for token in map(str.encode, matches):
            if held and len(token) > room:
                out += self.merges.ids(held)
                held, room = [], BYTES_AT_ONCE
            held.append(token)
            room -= len(token)
        return out + self.merges.ids(held)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row, with ``decode`` also ``decoded``, the bytes of those ids.

    Null texts count as empty and have no ids. Repeated rows and null ids come back each; an empty table gives
    an empty result; extra columns play no part.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(i, TEXTS_AT_ONCE)
                ids = encoder.encode(part.column(1).to_pylist())
                made = [pa.array(ids, pa.binary()), *([pa.array(map(encoder.decode, ids), pa.binary())] if decode else [])]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=names)

    names = ["doc_id", "ids", *(["decoded"] if decode else [])]
    plain = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    return plain.mapInArrow(work, "doc_id bigint, ids binary" + (", decoded binary" if decode else ""))


def bpe_decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with the column ``decoded`` (binary); null ids decode to nothing."""

    def decoded(ids: pa.Array) -> pa.Array:
        decoder = Encoder(path, pattern)
        return pa.array([decoder.decode(i) for i in ids.to_pylist()], pa.binary())

    return rows.withColumn("decoded", F.arrow_udf(decoded, "binary")(F.coalesce(rows[ids_col], F.lit(b""))))


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, encoded and decoded again by the same worker."""
    decoded = bpe_encode(docs, path, pattern, id_col, text_col, decode=True)
    return decoded.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

