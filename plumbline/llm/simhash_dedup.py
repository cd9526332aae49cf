"""SimHash near-duplicates by a self-join of binary tries over the fingerprints.

A trie's node is the range of fingerprints with one prefix. Two nodes of one depth are visited
together; the bits in which their prefixes differ add up, and a pair of nodes is dropped once that
exceeds its budget. Several tries are walked, each with another part of the fingerprint in front, with a small
budget down to the end of that part and with the whole budget below it, so nearly all pairs of nodes die
early. Fingerprints that differ in up to ``parts * (part_errors + 1) - 1`` bits are within the small budget in
one part at least: none of those pairs is lost. Of pairs beyond that and within ``errors`` most are found.

The upper levels are dealt out by Spark: a fingerprint goes to the node of its own prefix, and as a
visitor to each node whose prefix it exceeds by few enough bits. Nodes with too many members go deeper
in a further round. The levels below are walked inside tasks, node by node in bounded chunks, and
what a task emits is a forest of links, at most one per member, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage, keep_rows, row_key, salted_lookup, worker_cache
from plumbline.llm.components import components, merge_labels
from plumbline.llm.simhash import HASHES_AT_ONCE, bit_counts

SALTS = 256
#: Members of a node beyond which it goes deeper, members walked at a time, bits of a step down. They shape the work
#: and not the result.
NODE_MAX, CHUNK, STEP = 150_000, 40_000, 4
LEAF_PAIRS = 64
PAIRS_AT_ONCE = FRONTIER = 250_000


@dataclass(frozen=True)
class Tries:
    """Fingerprints of ``words`` times 64 bits, linked at ``errors`` or fewer differing bits, found through
    ``parts`` tries that allow ``part_errors`` in their own part. ``node``: average residents of a node when dealing starts."""

    words: int = 1
    parts: int = 3
    part_errors: int = 1
    errors: int = 4
    node: int = 4_096

    @property
    def bounds(self) -> np.ndarray:
        return np.arange(self.parts + 1) * 64 * self.words // self.parts

    def turned(self, high: np.ndarray, low: np.ndarray, trie) -> np.ndarray:
        """The 64 bits that begin with the trie's part, around the end of the fingerprint."""
        start = self.bounds[trie]
        second = low if self.words == 2 else high
        swap, by = start >= 64, (start % 64).astype(np.uint64)
        first, second = np.where(swap, second, high), np.where(swap, high, second)
        return np.where(by == 0, first, (first << by) | (second >> ((np.uint64(64) - by) % np.uint64(64))))

    def allowed(self, trie, depth):
        """Differing bits that two prefixes of this depth may have."""
        return np.where(np.diff(self.bounds)[trie] >= depth, self.part_errors, self.errors)

    def depth(self, n: int) -> int:
        return min(int(np.diff(self.bounds).min()) - 1, max(4, (max(1, n // self.node) - 1).bit_length()))


#: Four or fewer of 64 bits: every such pair is linked.
CLOSE = Tries()


def fingerprint(text: str | None, width: int, seeds: tuple[int, ...] = (42,)) -> list[int]:
    """SimHash words, one per seed, of the word shingles of a text; words are split at ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return [0] * len(seeds)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    last = ends[min(width, len(words)) - 1:].tolist()
    digest, out = xxhash.xxh64_intdigest, []
    for seed in seeds:
        ones = np.zeros(64, np.int64)
        for i in range(0, n, HASHES_AT_ONCE):
            size = min(HASHES_AT_ONCE, n - i)
            hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[i:i + size], last[i:i + size])), np.uint64, size)
            ones += bit_counts(hashes, np.zeros(1, np.int64))[0]
        out.append(int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]))
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, words: int) -> DataFrame:
    """doc_id, text_key, fp and low (the fingerprint's bits as bigint; low is 0 with one word) of every row."""
    plain = docs.select(docs[id_col].cast("bigint").alias("doc_id"), row_key(docs[text_col]).alias("text_key"), docs[text_col].alias("text"))
    seeds = tuple(range(42, 42 + words))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")  # frees what an earlier stage kept
        for batch in batches:
            found = np.zeros((batch.num_rows, 2), np.uint64)
            for i, text in enumerate(batch.column(2).to_pylist()):
                found[i, :words] = fingerprint(text, width, seeds)
            fp, low = np.ascontiguousarray(found.T).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp), pa.array(low)], names=["doc_id", "text_key", "fp", "low"])

    return plain.mapInArrow(work, "doc_id bigint, text_key bigint, fp bigint, low bigint")


def deal(tries: Tries, depth: int):
    """From (id, fp, low): its nodes (trie, depth, prefix) at ``depth``, which lies inside every part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(3)]
            for trie in range(tries.parts):
                own = tries.turned(rows[1].view(np.uint64), rows[2].view(np.uint64), trie) >> np.uint64(64 - depth)
                yield _members(trie, depth, own, rows, True)
                for mask in range(1, 1 << depth):
                    if mask.bit_count() <= tries.part_errors:
                        # The highest differing bit is one of the visitor's, so that two prefixes meet at one of them.
                        has = (own >> np.uint64(mask.bit_length() - 1)) & np.uint64(1) == 1
                        yield _members(trie, depth, own[has] ^ np.uint64(mask), [r[has] for r in rows], False)

    return work


def _members(trie, depth, prefix: np.ndarray, rows: list[np.ndarray], home) -> pa.RecordBatch:
    n = len(prefix)
    return pa.RecordBatch.from_arrays([
        pa.array(np.broadcast_to(np.asarray(trie, np.int32), n)), pa.array(np.broadcast_to(np.asarray(depth, np.int32), n)), pa.array(prefix.view(np.int64)),
        *[pa.array(r) for r in rows], pa.array(np.broadcast_to(np.asarray(home), n))], names=["trie", "depth", "prefix", "id", "fp", "low", "home"])


#: ``home`` marks a fingerprint in the node of its own prefix.
MEMBER = "trie int, depth int, prefix bigint, id bigint, fp bigint, low bigint, home boolean"


def deepen(tries: Tries):
    """The members of nodes that are too large, dealt to nodes ``STEP`` bits deeper."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trie, depth = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            prefix, rows = batch.column(2).to_numpy().view(np.uint64), [batch.column(i).to_numpy() for i in (3, 4, 5)]
            below = np.minimum(depth + STEP, 64)
            by = (below - depth).astype(np.uint64)
            own = tries.turned(rows[1].view(np.uint64), rows[2].view(np.uint64), trie) >> (64 - below).astype(np.uint64)
            spent = np.bitwise_count((own >> by) ^ prefix).astype(np.int64)
            budget = tries.allowed(trie, below)
            for mask in range(1 << STEP):
                top = np.uint64(1 << max(0, mask.bit_length() - 1))
                fits = (mask < (1 << (below - depth))) & (spent + mask.bit_count() <= budget) & ((mask == 0) | (spent > 0) | (own & top != 0))
                low = (own[fits] ^ np.uint64(mask)) & ((np.uint64(1) << by[fits]) - np.uint64(1))
                yield _members(
                    trie[fits].astype(np.int32), below[fits].astype(np.int32), (prefix[fits] << by[fits]) | low, [r[fits] for r in rows], (spent[fits] == 0) & (mask == 0))

    return work


def walk(tries: Tries, trie: np.ndarray, depth: np.ndarray, prefix: np.ndarray, ident: np.ndarray, fp: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links among the members of whole nodes: pairs of a resident with another member of
    its node within the budget, reduced to (member, root) per connected group."""
    key = tries.turned(fp, low, trie)
    visit = (key >> (64 - depth).astype(np.uint64)) != prefix
    order = np.lexsort((key, visit, prefix, depth, trie))
    trie, depth, prefix, ident, fp, low, key, visit = (x[order] for x in (trie, depth, prefix, ident, fp, low, key, visit))
    n = len(fp)
    new = np.ones(n, bool)
    new[1:] = (trie[1:] != trie[:-1]) | (depth[1:] != depth[:-1]) | (prefix[1:] != prefix[:-1])
    node, head = np.cumsum(new) - 1, np.flatnonzero(new)
    own = key >> (64 - depth).astype(np.uint64)
    run = new.copy()
    run[1:] |= own[1:] != own[:-1]
    lo = np.flatnonzero(run)
    hi = np.append(lo[1:], n)
    # Pairs of ranges: residents with themselves, and residents with each run of visitors of one prefix.
    home = ~visit[lo]
    end = np.zeros(len(head), np.int64)
    end[node[lo[home]]] = hi[home]
    met = home | (end[node[lo]] > 0)
    a0, a1, b0, b1 = head[node[lo[met]]], end[node[lo[met]]], lo[met], hi[met]
    err = np.bitwise_count(own[b0] ^ prefix[b0]).astype(np.int64)
    labels = np.arange(n)
    ones: dict[int, np.ndarray] = {}
    work = [(a0, a1, b0, b1, err, depth[b0].astype(np.int64))]
    while work:
        pairs = work.pop()
        if len(pairs[0]) > FRONTIER:
            half = len(pairs[0]) // 2
            work += [tuple(x[half:] for x in pairs), tuple(x[:half] for x in pairs)]
            continue
        a0, a1, b0, b1, err, at = pairs
        ready = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (at >= 64)
        labels = _verify(labels, fp, low, a0[ready], a1[ready], b0[ready], b1[ready], tries.errors)
        a0, a1, b0, b1, err, at = (x[~ready] for x in pairs)
        if not len(a0):
            continue
        a_mid, b_mid = np.empty_like(a0), np.empty_like(b0)
        for level in np.unique(at).tolist():
            if level not in ones:
                ones[level] = np.concatenate([[0], np.cumsum((key >> np.uint64(63 - level)) & np.uint64(1), dtype=np.int64)])
            here, up = at == level, ones[level]
            a_mid[here] = a1[here] - (up[a1[here]] - up[a0[here]])
            b_mid[here] = b1[here] - (up[b1[here]] - up[b0[here]])
        both = np.ones(len(a0), bool)
        grown = [(a0, a_mid, b0, b_mid, err, both), (a_mid, a1, b_mid, b1, err, both), (a0, a_mid, b_mid, b1, err + 1, both), (a_mid, a1, b0, b_mid, err + 1, a0 != b0)]
        budget = tries.allowed(trie[a0], at + 1)
        parts = [[x[ok] for x in (p0, p1, q0, q1, e, at + 1)] for p0, p1, q0, q1, e, some in grown if (ok := (p1 > p0) & (q1 > q0) & (e <= budget) & some).any()]
        if parts:
            work.append(tuple(np.concatenate(x) for x in zip(*parts)))
    linked = np.flatnonzero(labels != np.arange(n))
    return ident[linked], ident[labels[linked]]


def _verify(labels, fp, low, a0, a1, b0, b1, errors: int) -> np.ndarray:
    """Labels after all pairs of the given ranges have been compared."""
    size = (a1 - a0) * (b1 - b0)
    total = np.cumsum(size)
    begin = 0
    while begin < len(size):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS_AT_ONCE, side="right")))
        part = slice(begin, stop)
        of = np.repeat(np.arange(begin, stop), size[part])
        turn = np.arange(len(of)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        width = (b1 - b0)[of]
        x, y = a0[of] + turn // width, b0[of] + turn % width
        near = (x != y) & (np.bitwise_count(fp[x] ^ fp[y]).astype(np.int16) + np.bitwise_count(low[x] ^ low[y]) <= errors)
        labels = merge_labels(labels, x[near], y[near])
        begin = stop
    return labels


def walk_nodes(tries: Tries, chunk: int = CHUNK):
    """Walk the nodes of a partition, sorted by node, a bounded number of members at a time."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        trie, depth, prefix, ident, fp, low = held
        a, b = walk(tries, trie.astype(np.int64), depth.astype(np.int64), prefix.view(np.uint64), ident, fp.view(np.uint64), low.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        held = [np.empty(0, t) for t in (np.int32, np.int32, np.int64, np.int64, np.int64, np.int64)]
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
            if len(held[0]) >= chunk:
                same = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
                cut = len(same) - int(same.sum())
                if cut:
                    yield flush([h[:cut] for h in held])
                    held = [h[cut:] for h in held]
        if len(held[0]):
            yield flush(held)

    return work


def trie_links(values: DataFrame, tries: Tries, node_max: int = NODE_MAX) -> DataFrame:
    """Links (a, b) between ids that connect all values (id, fp, low: distinct, bigint) within the budget of each other."""
    members = values.select("id", "fp", "low").mapInArrow(deal(tries, tries.depth(values.count())), MEMBER)
    key, ready = ["trie", "depth", "prefix"], None
    while True:
        crowd = cut_lineage(members.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > node_max) & (F.col("depth") < 64)))
        done = crowd.isEmpty()
        small = members if done else members.join(crowd, key, "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        if done:
            break
        below = cut_lineage(members.join(crowd, key, "left_semi").select(*key, "id", "fp", "low").mapInArrow(deepen(tries), MEMBER))
        members = below.join(below.where("home").select(*key).distinct(), key, "left_semi").select(below.columns)
    return ready.drop("home").repartition(*key).sortWithinPartitions(*key).mapInArrow(walk_nodes(tries), "a bigint, b bigint")


def place(rows: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with component_id, least_key and kept, from the links between the ids of their classes (id, fp, low, smallest, key)."""
    nodes = components(links)
    rooted = classes.join(nodes, classes["id"] == nodes["node"], "left").select("fp", "low", "smallest", "key", F.coalesce("root", "id").alias("root"))
    groups = salted_lookup(
        rooted, rooted.groupBy("root").agg(F.min("smallest").alias("component_id"), F.min("key").alias("least_key")), ["root"], F.col("fp"), SALTS)
    placed = salted_lookup(rows, groups.select("fp", "low", "component_id", "least_key"), ["fp", "low"], F.struct("doc_id", "text_key"), SALTS)
    kept = F.when(F.col("component_id").isNull(), F.col("text_key") == F.col("least_key")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return placed.withColumn("kept", kept)


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, tries: Tries = CLOSE, node_max: int = NODE_MAX) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits per word), component_id, kept, text_key, least_key
    (the least text key of the component).

    Null and blank texts have fingerprint zero and are linked like any other; fewer words than a
    shingle make one shingle. A component's id is its smallest doc_id (null if it has none); ``kept`` marks
    the rows that carry it, or one row key of a component without ids. Repeated rows each come back. An empty
    table gives an empty result. Extra columns play no part.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, width, tries.words))
    ident = F.col("fp") if tries.words == 1 else F.xxhash64("fp", "low")
    classes = cut_lineage(rows.groupBy("fp", "low").agg(F.min("doc_id").alias("smallest"), F.min("text_key").alias("key")).withColumn("id", ident))
    placed = place(rows, classes, trie_links(classes, tries, node_max))
    digits = F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("fp", "low")[:tries.words]])
    return placed.select("doc_id", F.lower(digits).alias("fingerprint"), "component_id", "kept", "text_key", "least_key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, tries: Tries = CLOSE) -> DataFrame:
    """``docs`` with one document of each component of ``simhash_dedup``, all columns kept: the one with the smallest id,
    of several texts under that id the one with the least text key. Without any id it is the text with the least key."""
    rows = simhash_dedup(docs, id_col, text_col, width, tries).where("kept")
    # A text lies in one component, so the least text key of a component names it.
    one = rows.groupBy("least_key").agg(F.min("component_id").alias("doc_id"), F.min("text_key").alias("text_key"))
    return keep_rows(docs, one.select("doc_id", "text_key"), id_col, text_col)
