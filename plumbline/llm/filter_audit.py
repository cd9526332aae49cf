"""How document filters interact, from a sparse document-term matrix.

Every task turns whole documents into shards of a matrix in CSR form (row pointers, word numbers, counts), a bounded
number of words at a time, and lists the words a shard holds, each once. Spark deals these lists by word,
so that equal words of all shards meet in one sorted run and get one number of the global dictionary, and sends the
numbers back to their shards. Row sums and non-zero counts of the encoded shards are words and distinct words of
the documents. Of all other filters the pass that reads the text tells the outcome, but for copies, which meet by digest.

With the outcomes of five filters a document is one of 32 cases, so every order of the filters is audited from the counts
per part and case.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain, permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from plumbline.llm.common import salted_lookup, shared_table, worker_cache

#: Words after which a shard is closed; a document is never cut, so a shard holds at most one beyond it.
SHARD_WORDS = 3_000_000
SALTS = 256
WORDS_AT_ONCE, NUMBERS_HELD, TEXTS_AT_ONCE = 50_000, 1_000_000, 256
#: Entries of a shard that are put into order together; a document is not cut.
ENTRIES_AT_ONCE = 100_000
FILTERS = "ABCDE"
MARKS = np.frombuffer(b"#$%&*|", np.uint8)
#: Of a document: id, part, SHA-256 of the text, code points, letters A-Z, whether any of ``MARKS`` occurs.
ROW = "struct<doc_id: bigint, part: string, digest: binary, points: bigint, capitals: bigint, marked: boolean>"
ROW_TYPE = pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("points", pa.int64()), ("capitals", pa.int64()), ("marked", pa.bool_())])
SHARD = f"shard bigint, number int, word binary, rows array<{ROW}>, indptr binary, indices binary, counts binary"
SHARD_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.list_(ROW_TYPE), pa.binary(), pa.binary(), pa.binary()]
SHARD_NAMES = ["shard", "number", "word", "rows", "indptr", "indices", "counts"]


class Numbered(dict):
    """Numbers keys in the order they come up."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def narrow(counts: np.ndarray) -> np.ndarray:
    """The same counts as the smallest unsigned integers that hold them all; ``wide`` undoes it."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def wide(counts: bytes, entries: int) -> np.ndarray:
    return np.frombuffer(counts, f"<u{len(counts) // entries}" if entries else "u1").astype(np.int64)


def one_binary(values: np.ndarray) -> pa.Array:
    """The bytes of an array as the only value of a binary column."""
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, values.nbytes], np.int32)), pa.py_buffer(values)])


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, TEXTS_AT_ONCE) for i in range(0, batch.num_rows, TEXTS_AT_ONCE))


def build_shards(words_at_most: int):
    """From (doc_id, part, text as binary): per shard one row with its matrix (``number``: how many words), and one for each of its words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("shards")  # frees what an earlier stage kept
        made, task = 0, TaskContext.get().partitionId()
        number, rows, indices, counts, held = Numbered(), [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, number, rows, indices, counts, held
            # The matrix is handed on without copies, and gone before the words are.
            shard, words, entries = task << 32 | made, list(number), [len(i) for i in indices]
            known = [pa.array([v], t) for v, t in zip((shard, len(number), None, rows), SHARD_TYPES)]
            number, rows = Numbered(), []
            indices, counts = np.concatenate(indices), np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([*known, *map(one_binary, (np.cumsum([0, *entries]), indices, counts))], names=SHARD_NAMES)
            known, indices, counts = [], [], []
            for at in range(0, len(words), WORDS_AT_ONCE):
                part = words[at:at + WORDS_AT_ONCE]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard)), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(part, pa.binary()), *[pa.nulls(n, t) for t in SHARD_TYPES[3:]]],
                    names=SHARD_NAMES)
            made, held = made + 1, 0

        for batch in chain.from_iterable(map(slices, batches)):
            for ident, part, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or b""
                bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
                words = text.split()
                own, often = np.unique(np.fromiter(map(number.__getitem__, words), np.int32, len(words)), return_counts=True)
                indices.append(own)
                counts.append(narrow(often))  # joined, they are as wide as the widest
                rows.append({
                    "doc_id": ident, "part": part, "digest": hashlib.sha256(text).digest(), "points": len(text) - int(bytes_[128:192].sum()),
                    "capitals": int(bytes_[65:91].sum()), "marked": bool(bytes_[MARKS].any())})
                held += len(words)
                if held >= words_at_most:
                    yield from flush()
        if rows:
            yield from flush()

    return work


def number_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (word, shard, number) sorted by word: per shard the numbers and their codes, packed, with the slice. The words of a slice are coded from 0; ``last``
    is the code reached by then."""
    part, code, last, held = TaskContext.get().partitionId(), -1, None, 0
    packed: dict[int, list[np.ndarray]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(shard, np.concatenate(found[::2]).tobytes(), np.concatenate(found[1::2]).tobytes()) for shard, found in packed.items()]
        shards, numbers, codes = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(shards, pa.int64()), pa.array(np.full(len(rows), part, np.int32)), pa.array(np.full(len(rows), code)), pa.array(numbers, pa.binary()), pa.array(codes, pa.binary())],
            names=["shard", "slice", "last", "numbers", "codes"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        words, shards, numbers = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        new = np.ones(n, bool)
        new[1:] = ~np.asarray(pc.equal(words.slice(1), words.slice(0, n - 1)))
        new[0] = code < 0 or words[0].as_py() != last
        codes = code + np.cumsum(new)
        code, last = int(codes[-1]), words[n - 1].as_py()
        order = np.argsort(shards, kind="stable")
        ends = np.flatnonzero(np.append(shards[order][1:] != shards[order][:-1], True)) + 1
        for a, b in zip([0, *ends[:-1]], ends):
            packed.setdefault(int(shards[order[a]]), []).extend((numbers[order[a:b]], codes[order[a:b]]))
        held += n
        if held >= NUMBERS_HELD:
            yield flush()
            packed, held = {}, 0
    if packed:
        yield flush()


def encode_shard(shards: pa.Table, numbers: pa.Table) -> pa.Table:
    """The shard with its words' global numbers in place of its own, in ascending order within each row."""
    row = {c: shards.column(c)[0].as_py() for c in ("indptr", "indices", "counts", "words")}
    told = np.empty(row["words"], np.int64)
    for own, codes, begin in zip(*(numbers.column(c).to_pylist() for c in ("numbers", "codes", "begin"))):
        told[np.frombuffer(own, np.int32)] = np.frombuffer(codes, np.int64) + begin
    indptr, own = np.frombuffer(row["indptr"], np.int64), np.frombuffer(row["indices"], np.int32)
    indices, counts = np.empty(len(own), np.int64), np.frombuffer(row["counts"], f"<u{len(row['counts']) // len(own)}" if len(own) else "u1").copy()
    # Some documents at a time, so that the keys and places of a sort are never as many as the shard's entries.
    first = 0
    while first < len(indptr) - 1:
        end = max(first + 1, int(np.searchsorted(indptr, indptr[first] + ENTRIES_AT_ONCE, "right")) - 1)
        at = slice(int(indptr[first]), int(indptr[end]))
        codes = told[own[at]]
        order = np.lexsort((codes, np.repeat(np.arange(end - first), np.diff(indptr[first:end + 1]))))
        indices[at], counts[at] = codes[order], counts[at][order]
        first = end
    return pa.table({"shard": shards.column("shard"), "rows": shards.column("rows"), "indptr": [row["indptr"]], "indices": one_binary(indices), "counts": one_binary(counts)})


def _numbered_shards(docs: DataFrame, id_col: str, text_col: str, part_col: str, words_at_most: int) -> PandasCogroupedOps:
    """The shards of the table, each with the global numbers of its words."""
    plain = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), docs[text_col].cast("string").cast("binary").alias("text"))
    made = shared_table(plain.mapInArrow(build_shards(words_at_most), SHARD), "shards")
    lists = made.where("word is not null").select("word", "shard", "number")
    packed = "shard bigint, slice int, last bigint, numbers binary, codes binary"
    coded = shared_table(lists.repartition("word").sortWithinPartitions("word").mapInArrow(number_words, packed), "dictionary")
    # One number of words per shuffle partition: where each slice of the dictionary begins.
    sizes, begins = dict(coded.groupBy("slice").agg(F.max("last") + 1).collect()), {}
    for part in sorted(sizes):
        begins[part] = sum(sizes[p] for p in sizes if p < part)
    offsets = F.from_json(F.lit(json.dumps([begins.get(p, 0) for p in range(max(begins, default=0) + 1)])), "array<bigint>")
    numbers = coded.select("shard", "numbers", "codes", F.get(offsets, F.col("slice")).alias("begin"))
    matrices = made.where("rows is not null").select("shard", F.col("number").alias("words"), "rows", "indptr", "indices", "counts")
    return matrices.groupBy("shard").cogroup(numbers.groupBy("shard"))


def document_term_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", words_at_most: int = SHARD_WORDS) -> DataFrame:
    """One row per CSR shard: shard, rows (one struct a document, as in ``ROW``), indptr and indices (little-endian 64-bit
    integers; indices are dense numbers of a dictionary of all words of the table), counts (the smallest unsigned integers that fit).

    Words are cut at ASCII white space. Null texts and parts count as empty. A task closes a shard at ``words_at_most`` words, so
    neither a shard nor its list of words grows with the table.
    """
    numbered = _numbered_shards(docs, id_col, text_col, part_col, words_at_most)
    return numbered.applyInArrow(encode_shard, f"shard bigint, rows array<{ROW}>, indptr binary, indices binary, counts binary")


def row_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row sums and non-zero counts of shards beside what is known of their documents."""
    for batch in batches:
        for i in range(batch.num_rows):
            indptr = np.frombuffer(batch.column(2)[i].as_py(), np.int64)
            total = np.concatenate([[0], np.cumsum(wide(batch.column(3)[i].as_py(), int(indptr[-1])))])
            rows = batch.column(1).slice(i, 1).flatten()
            n = len(indptr) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array(np.arange(n)), *rows.flatten(), pa.array(total[indptr[1:]] - total[indptr[:-1]]), pa.array(np.diff(indptr))],
                names=["shard", "row", *[f.name for f in ROW_TYPE], "words", "distinct_words"])


def shard_statistics(shards: pa.Table, numbers: pa.Table) -> pa.Table:
    """``row_statistics`` of a shard in the worker that encodes it, so that neither a second worker nor Spark holds the matrix."""
    matrix = encode_shard(shards, numbers).select(["shard", "rows", "indptr", "counts"])
    return pa.Table.from_batches(row_statistics(iter(matrix.to_batches())))


def document_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", words_at_most: int = SHARD_WORDS) -> DataFrame:
    """Per document: doc_id, part, words, distinct_words and ``fails``, a sum of 1, 2, 4, 8, 16 for each of A to E that it fails.

    A: under 100 words; B: under four words in five are distinct; C: over a tenth of the code points are A-Z; D: any of
    ``#$%&*|``; E: the text is that of a smaller id. A document without words passes B and C. Rows without an id pass E and let
    others pass; of rows with one id and one text none fails E for the other.
    """
    schema = "shard bigint, row bigint, doc_id bigint, part string, digest binary, points bigint, capitals bigint, marked boolean, words bigint, distinct_words bigint"
    rows = shared_table(_numbered_shards(docs, id_col, text_col, part_col, words_at_most).applyInArrow(shard_statistics, schema), "documents")
    told = salted_lookup(rows, rows.groupBy("digest").agg(F.min("doc_id").alias("first")), ["digest"], F.struct("shard", "row"), SALTS)
    fails = ["words < 100", "100 * distinct_words < 80 * words", "100 * capitals > 10 * points", "marked", "coalesce(first < doc_id, false)"]
    return told.select("doc_id", "part", "words", "distinct_words", sum((F.expr(f).cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0)).alias("fails"))


def every_step(filters: str = FILTERS) -> list[dict]:
    """All orders of the filters, step by step, with the filters before the step and its own as sums of powers of two."""
    out = []
    for order in permutations(filters):
        before = 0
        for step, name in enumerate(order, 1):
            own = 1 << filters.index(name)
            out.append({"filter_order": "".join(order), "step": step, "before": before, "own": own})
            before |= own
    return out


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", words_at_most: int = SHARD_WORDS) -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    ``labels`` holds doc_id, quality and toxic; a document is good or toxic if any label of its id says 1. Repeated
    rows count each, null ids have no label. A part with documents has all its rows, zeros included; an empty table gives none.
    Extra columns play no part.
    """
    # Documents of one id and outcome are counted before the join, so that neither a repeated id nor the rows without one gather.
    cases = document_flags(docs, id_col, text_col, part_col, words_at_most).groupBy("doc_id", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    known = labels.groupBy(labels["doc_id"].cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    n = F.col("n")
    counted = cases.join(known, "doc_id", "left").groupBy("part", "fails").agg(
        F.sum("n").alias("n"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"), F.sum(n * F.coalesce("bad", F.lit(0))).alias("bad"))
    steps = F.from_json(F.lit(json.dumps(every_step())), "array<struct<filter_order: string, step: int, before: int, own: int>>")
    fails = F.col("fails")
    met = counted.withColumn("s", F.explode(steps)).select("*", "s.*").withColumns({
        "lost": (fails.bitwiseAND(F.col("before")) == 0) & (fails.bitwiseAND(F.col("own")) != 0), "fails_own": fails.bitwiseAND(F.col("own")) != 0})

    def total(of, where):
        return F.sum(F.when(where, of).otherwise(F.lit(0))).cast("bigint")

    return met.groupBy("part", "filter_order", "step").agg(
        total(n, fails.bitwiseAND(F.col("before").bitwiseOR(F.col("own"))) == 0).alias("kept"), total(n, F.col("lost")).alias("removed"),
        total(n, F.col("fails_own") & ~F.col("lost")).alias("redundant"), total(n, fails == F.col("own")).alias("unique_fails"),
        total(F.col("good"), F.col("lost")).alias("good_lost"), total(F.col("bad"), F.col("lost")).alias("toxic_lost"),
        # Of the filters a document fails each is first in an equal share of the 120 orders.
        total(F.expr("n * 120 div greatest(bit_count(fails), 1)"), F.col("fails_own")).alias("shapley"))
