"""How the sources of a language differ in their words, from stripes folded inside the tasks.

A stripe is a term of one language with the number of its documents and its occurrences per source. Every task folds
whole documents into a table of stripes and spills it when it is full. Spark deals the stripes by language and term, so that
those of one term meet in one sorted run, where they are merged as they stream past.

The merged stripes then emit the divergences: a term against its whole language directly, and two sources against each other
as the sum over the terms both have. What a pair of sources owes to terms that one or both lack depends on a term only
through the count of one source, so it comes from the number of terms per source and count.

Shares are whole billionths, ``p = 1 + floor(10**9 * (count + 1) / (N + V))``; a divergence is ``floor((p - q)**2 / q)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage, shared_table, worker_cache
from plumbline.llm.filter_audit import Numbered

#: Terms and entries after which a task spills its stripes, and what is handled at a time; they shape the work and not the result.
STRIPES, ENTRIES = 400_000, 4_000_000
TERMS_AT_ONCE, PAIRS_AT_ONCE, SUMS_HELD = 20_000, 1_000_000, 400_000
#: ASCII capitals to small letters, all other ASCII but letters to blanks.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
STRIPE = "lang string, term binary, df bigint, sources array<string>, counts array<bigint>"
STRIPE_NAMES = ["lang", "term", "df", "sources", "counts"]


def fold_entries(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the sum of the counts of each."""
    order = np.argsort(key, kind="stable")
    key, counts = key[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(counts, first) if len(first) else counts


def stripes_of(terms: pa.Array, df: np.ndarray, key: np.ndarray, counts: np.ndarray, sources: pa.Array, lang: pa.Array) -> pa.RecordBatch:
    """Stripes from sorted entries whose key is term times sources plus source."""
    term, source = np.divmod(key, max(1, len(sources)))
    offsets = pa.array(np.searchsorted(term, np.arange(len(df) + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [lang, terms, pa.array(df), pa.ListArray.from_arrays(offsets, sources.take(pa.array(source))), pa.ListArray.from_arrays(offsets, pa.array(counts))], names=STRIPE_NAMES)


def fold_documents(stripes: int, entries: int):
    """From (lang, source, text as binary): the stripes of what a task reads, spilled when full."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("stripes")  # frees what an earlier stage kept
        tables: dict[str, tuple[Numbered, list]] = {}
        sources, held = Numbered(), 0

        def spill() -> Iterator[pa.RecordBatch]:
            nonlocal tables, sources, held
            names = pa.array(list(sources), pa.string())
            for lang, (number, rows) in tables.items():
                own = np.concatenate([r[0] for r in rows])
                df = np.bincount(own, minlength=len(number))
                source = np.repeat([r[2] for r in rows], [len(r[0]) for r in rows])
                key, counts = fold_entries(own.astype(np.int64) * len(sources) + source, np.concatenate([r[1] for r in rows]))
                terms = list(number)
                for at in range(0, len(terms), TERMS_AT_ONCE):
                    part = terms[at:at + TERMS_AT_ONCE]
                    a, b = np.searchsorted(key, (at * len(sources), (at + len(part)) * len(sources)))
                    yield stripes_of(pa.array(part, pa.binary()), df[at:at + len(part)], key[a:b] - at * len(sources), counts[a:b], names, pa.array([lang] * len(part), pa.string()))
            tables, sources, held = {}, Numbered(), 0

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = (text or b"").translate(FOLD).split()
                if not words:
                    continue
                number, rows = tables.setdefault(lang, (Numbered(), []))
                own, often = np.unique(np.fromiter(map(number.__getitem__, words), np.int32, len(words)), return_counts=True)
                rows.append((own, often.astype(np.int64), sources[source]))
                held += len(own)
                if held >= entries or sum(len(n) for n, _ in tables.values()) >= stripes:
                    yield from spill()
        yield from spill()

    return work


def merge_stripes(least: int):
    """From stripes sorted by language and term: one stripe per term that has at least ``least`` documents.

    A run that goes on in the next batch is held back as one merged stripe, however many there are of it.
    """

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, term, df, sources, counts = batch.columns
        n = batch.num_rows
        new = np.ones(n, bool)
        new[1:] = ~np.asarray(pc.and_(pc.equal(lang.slice(1), lang.slice(0, n - 1)), pc.equal(term.slice(1), term.slice(0, n - 1))))
        first, run = np.flatnonzero(new), np.cumsum(new) - 1
        coded = sources.flatten().dictionary_encode()
        entry = np.repeat(run, pc.list_value_length(sources).to_numpy())
        key, total = fold_entries(entry * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), counts.flatten().to_numpy())
        at = pa.array(first)
        return stripes_of(term.take(at), np.add.reduceat(df.to_numpy(), first), key, total, coded.dictionary, lang.take(at))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, (pa.string(), pa.binary(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())))], names=STRIPE_NAMES)
            whole = merged(batch if held is None else pa.concat_batches([held, batch]))
            held = whole.slice(whole.num_rows - 1)
            whole = whole.slice(0, whole.num_rows - 1)
            yield whole.filter(pc.greater_equal(whole.column(2), least))
        if held is not None:
            yield held.filter(pc.greater_equal(held.column(2), least))

    return work


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, sources, p, p0) of stripes: (lang, source, item, value), added up over the terms that both sources have.

    ``value`` is the divergence of the two shares less what counts per source will say of the term: each share against the share
    of a term that the other lacks, those of two lacking ones being counted twice by then.
    """
    groups, keys, sums = Numbered(), [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def flush() -> pa.RecordBatch:
        key, total = fold_entries(np.concatenate(keys), np.concatenate(sums))
        names = list(groups)
        lang, own = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
        a, b = pa.array(key >> 32), pa.array(key & 0xFFFFFFFF)
        return pa.RecordBatch.from_arrays([lang.take(a), own.take(a), own.take(b), pa.array(total)], names=["lang", "source", "item", "value"])

    for batch in batches:
        sizes = pc.list_value_length(batch.column(1)).to_numpy()
        lang = batch.column(0).dictionary_encode()
        source = batch.column(1).flatten().dictionary_encode()
        pair, at = np.unique(np.repeat(lang.indices.to_numpy(), sizes).astype(np.int64) << 32 | source.indices.to_numpy(), return_inverse=True)
        langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        group = np.array([groups[langs[k >> 32], sources[k & 0xFFFFFFFF]] for k in pair.tolist()], np.int64)[at]
        p, p0 = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        begin, width = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
        ends, a = np.cumsum(width), 0
        while a < len(p):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS_AT_ONCE, side="right")))
            x = np.repeat(np.arange(a, b), width[a:b])
            y = begin[x] + np.arange(len(x)) - (ends[x] - width[x] - (ends[a - 1] if a else 0))
            x, y = x[x != y], y[x != y]
            value = divergence(p[x], p[y]) - divergence(p[x], p0[y]) - divergence(p0[x], p[y]) + divergence(p0[x], p0[y])
            key, total = fold_entries(group[x] << 32 | group[y], value)
            keys.append(key)
            sums.append(total)
            a = b
            if sum(map(len, keys)) > SUMS_HELD:
                key, total = fold_entries(np.concatenate(keys), np.concatenate(sums))
                keys, sums = [key], [total]
                if len(key) > SUMS_HELD // 2:
                    yield flush()
                    keys, sums = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    yield flush()


def merged_stripes(docs: DataFrame, text_col: str, lang_col: str, source_col: str, min_docs: int, stripes: int, entries: int) -> DataFrame:
    """Merged stripes of the terms with at least ``min_docs`` documents of their language."""
    plain = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))], docs[text_col].cast("string").cast("binary").alias("text"))
    folded = plain.mapInArrow(fold_documents(stripes, entries), STRIPE)
    return shared_table(folded.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(merge_stripes(min_docs), STRIPE), "stripes")


def share(count: Column | str, of: Column | str) -> Column:
    """Billionths of ``of`` that ``count`` + 1 are, rounded down, plus one; exact for any counts."""
    plus = (F.col(count) if isinstance(count, str) else count).cast("decimal(20,0)") + F.lit(1)
    whole = (F.col(of) if isinstance(of, str) else of).cast("decimal(20,0)")
    return F.lit(1).cast("bigint") + F.floor(F.call_function("div", plus.cast("decimal(21,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), F.greatest(whole, F.lit(1).cast("decimal(20,0)")))).cast("bigint")


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200,
    stripes: int = STRIPES, entries: int = ENTRIES,
) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others and which terms it has too many of.

    Part ``pair``: item is another source of the language, value the divergence of the two summed over all kept terms. Part ``term``: item is a
    term that the source has and has a larger share of than its language; value is the divergence of the two shares, the
    ``top`` largest are given. Ranks go by value, then by item in UTF-8. Terms are runs of ASCII letters (A-Z as a-z) and
    all signs beyond ASCII; a language keeps those in at least ``min_docs`` of its documents.

    Null texts, languages and sources count as empty. A source without terms, and a language without kept ones, still has its pairs (value 0
    where nothing is kept). Repeated rows count each. An empty table gives an empty result. Extra columns play no part.
    """
    kept = merged_stripes(docs, text_col, lang_col, source_col, min_docs, stripes, entries)
    groups = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source")).distinct()
    entry = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", F.col("e.sources").alias("source"), F.col("e.counts").alias("count"))
    often = cut_lineage(entry.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("terms")))
    sizes = often.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("terms")).alias("n"), F.sum("terms").alias("own"))
    kinds = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    zero = F.lit(0).cast("bigint")
    sized = groups.join(sizes, ["lang", "source"], "left").join(kinds, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "own", "v")])
    sized = shared_table(sized.withColumn("p0", share(zero, F.col("n") + F.col("v"))), "groups")
    # One row per language; its map is as long as the stripe of a term that all its sources have.
    langs = shared_table(sized.groupBy("lang").agg(
        F.first("v").alias("v"), F.sum("n").alias("n_lang"), F.map_from_entries(F.collect_list(F.struct("source", F.struct("n", "p0")))).alias("of")), "languages")
    shares = kept.join(langs, "lang").select(
        "lang", "term", "sources", F.transform(F.arrays_zip("sources", "counts"), lambda e: share(e["counts"], F.element_at("of", e["sources"])["n"] + F.col("v"))).alias("p"),
        F.transform("sources", lambda s: F.element_at("of", s)["p0"]).alias("p0"),
        share(F.aggregate("counts", zero, lambda a, c: a + c), F.col("n_lang") + F.col("v")).alias("q"))

    f = lambda p, q: F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")
    over = shares.select("lang", "term", "q", F.explode(F.arrays_zip("sources", "p")).alias("e")).select("lang", F.col("e.sources").alias("source"), "term", "q", F.col("e.p").alias("p"))
    terms = over.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), f("p", "q").alias("value"))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int"))

    other = sized.select("lang", F.col("source").alias("item"), F.col("own").alias("own_b"), F.col("p0").alias("q0"))
    pairs = sized.join(other, "lang").where("source <> item")
    neither = pairs.select("lang", "source", "item", (F.expr("v - own - own_b") * f("p0", "q0")).alias("value"))
    counted = often.join(sized.select("lang", "source", "n", "v"), ["lang", "source"]).select("lang", "source", "terms", share("count", F.col("n") + F.col("v")).alias("p")).join(
        other.select("lang", "item", "q0"), "lang").where("source <> item")
    one = counted.select("lang", "source", "item", (F.col("terms") * f("p", "q0")).alias("value"))
    turned = counted.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("terms") * f("q0", "p")).alias("value"))
    both = shares.where(F.size("sources") > 1).select("lang", "sources", "p", "p0").mapInArrow(pair_sums, "lang string, source string, item string, value bigint")
    total = neither.unionByName(one).unionByName(turned).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    total = total.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return ranked(total).unionByName(ranked(terms).where(F.col("rank") <= top))
