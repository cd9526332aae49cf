"""Secret scan by corpus-wide ownership frequency, in DataFrame operations only.

Patterns propose candidates. The hash of every candidate's value is counted over distinct
repositories and distinct owners of the whole corpus: a value that many owners hold is an example
that got copied (documentation, templates), a value held by few is a live-looking credential. Base
patterns are always reported and only classed by it; the broad ``bare`` pattern (a long token of
mixed letters and digits without any key word) is reported only where the value is live-looking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage, row_key, salted_lookup

# Fixed values: (kind, pattern, group that holds the value, least length of that value).
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
]
BARE = ("bare", r"(?<![A-Za-z0-9+_-])[A-Za-z0-9+_-]{20,}", 0, 20)
KINDS = [*BASE, BARE]
#: A value with this many owners or more is an example that was copied.
COPIED_OWNERS = 3
SALTS = 64
MARK = "[SECRET]"
HITS = "array<struct<kind:int,gap:int,size:int,chars:int,hash:bigint,mixed:boolean>>"
SEEN = "array<struct<start:int,end:int,kind:int,copied:boolean,covered:boolean>>"


def pattern_hits(text: Column, kind: int) -> Column:
    """All hits of one kind, leftmost and not overlapping, in order: the characters between it and the one before, its own, those of its
    value, and what tells whether it counts. Every list is made once, so the work follows the length of the text."""
    _, pattern, group, _ = KINDS[kind]
    hits, values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    beside = F.filter(F.arrays_zip(hits.alias("hit"), values.alias("value"), gaps.alias("gap")), lambda h: h["hit"].isNotNull())
    found = F.transform(beside, lambda h: F.struct(
        F.lit(kind).alias("kind"), F.length(h["gap"]).alias("gap"), F.length(h["hit"]).alias("size"), F.length(h["value"]).alias("chars"), F.xxhash64(h["value"]).alias("hash"),
        (h["value"].rlike("[0-9]") & h["value"].rlike("[a-z]") & h["value"].rlike("[A-Z]")).alias("mixed")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(HITS))


def has_candidates(text: Column) -> Column:
    out = F.lit(False)
    for _, pattern, _, _ in KINDS:
        out |= F.coalesce(text, F.lit("")).rlike(pattern)
    return out


def _told(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_cols: tuple[str, ...] = ("source", "lang"),
    owner_cols: tuple[str, ...] = ("source",), copied_owners: int = COPIED_OWNERS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied,
    live (array of start, end) and text_key.

    A repository and an owner are told by the values of the named columns; null is a value of its own.
    Null texts count as empty and have no spans. Repeated rows are judged each. A value held by
    ``copied_owners`` owners or more, or by as many repositories of two owners, is a copied example, any other is live.
    An empty table gives an empty result. Extra columns play no part. Texts of any length and number of hits take work in proportion.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    named = lambda cols: F.concat_ws("\x1f", *[F.coalesce(docs[c].cast("string"), F.lit("\x00")) for c in cols])
    found = cut_lineage(docs.select(
        docs[id_col].alias("doc_id"), row_key(docs[text_col]).alias("text_key"), F.xxhash64(named(repo_cols)).alias("repo"),
        F.xxhash64(named(owner_cols)).alias("owner"), F.concat(*[pattern_hits(text, k) for k in range(len(KINDS))]).alias("hits"),
    ).withColumn("row", F.monotonically_increasing_id()))
    hits = found.where(F.size("hits") > 0).select("row", "repo", "owner", F.posexplode("hits").alias("turn", "h")).select("row", "repo", "owner", "turn", "h.*")
    so_far = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    least = F.get(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind"))
    spans = hits.withColumn("end", so_far).where((F.col("chars") >= least) & ((F.col("kind") < len(BASE)) | F.col("mixed")))
    # Read in the order of base starts and other ends, a span overlaps a base one if one so far ends beyond its start.
    is_base = F.col("kind") < len(BASE)
    reading = Window.partitionBy("row").orderBy("at", F.when(is_base, 1).otherwise(0), "kind", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = spans.withColumn("start", F.col("end") - F.col("size")).withColumn("at", F.when(is_base, F.col("start")).otherwise(F.col("end")))
    furthest = F.max(F.when(is_base, F.col("end"))).over(reading)
    cands = cut_lineage(placed.withColumn("covered", ~is_base & (F.coalesce(furthest, F.lit(0)) > F.col("start"))).select("row", "repo", "owner", "hash", "start", "end", "kind", "covered"))
    holders = cands.select("hash", "repo", "owner").distinct().groupBy("hash").agg(F.countDistinct("repo").alias("repos"), F.countDistinct("owner").alias("owners"))
    classed = holders.select("hash", ((F.col("owners") >= copied_owners) | ((F.col("owners") > 1) & (F.col("repos") >= 2 * copied_owners))).alias("copied"))
    told = salted_lookup(cands, classed, ["hash"], F.col("row"), SALTS).groupBy("row").agg(
        F.collect_list(F.struct("start", "end", "kind", "copied", "covered")).alias("seen"))
    base = F.filter("seen", lambda s: s["kind"] < len(BASE))
    added = F.filter("seen", lambda s: (s["kind"] == len(BASE)) & ~s["copied"] & ~s["covered"])
    count = lambda k: F.size(F.filter("seen", lambda s: s["kind"] == k)).cast("long")
    rows = found.select("row", "doc_id", "text_key").join(told, "row", "left").withColumn(
        "seen", F.coalesce("seen", F.array().cast(SEEN)))
    live = F.filter(F.concat(base, added), lambda s: ~s["copied"])
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k][0]}") for k in range(len(BASE))], F.sha2(_told(base), 256).alias("base_sha256"),
        _told(F.concat(base, added)).alias("spans"), F.size(live).cast("long").alias("n_live"),
        F.size(F.filter(base, lambda s: s["copied"])).cast("long").alias("n_copied"),
        F.array_sort(F.transform(live, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("live"), "text_key")


def masked(text: Column, live: Column, mark: str = MARK) -> Column:
    """The text with each live span, overlapping ones together, replaced by a mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    walked = F.aggregate(live, start, lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
        F.concat(acc["out"], F.when(s["start"] < acc["at"], F.lit("")).otherwise(
            F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))).alias("out"), s["end"].alias("at"))))
    return F.concat(walked["out"], F.substr(text, walked["at"] + 1))


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with the live-looking secrets masked; copied examples and all rows stay.

    Only rows in which a pattern is found are shuffled.
    """
    names = docs.columns
    live = secret_scan(docs, id_col, text_col, **settings).where("n_live > 0").select(
        F.col("doc_id").alias("live_id"), F.col("text_key").alias("live_key"), "live").dropDuplicates(["live_id", "live_key"])
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    ident, text = F.col(f"_{names.index(id_col)}"), F.col(f"_{names.index(text_col)}")
    found = plain.where(has_candidates(text)).withColumn("key", row_key(text)).join(live, ident.eqNullSafe(F.col("live_id")) & (F.col("key") == F.col("live_key")), "left")
    changed = found.select(*[F.when(F.col("live").isNotNull(), masked(text, F.col("live"))).otherwise(text).alias(c) if c == f"_{names.index(text_col)}" else F.col(c) for c in plain.columns])
    return plain.where(~has_candidates(text)).unionByName(changed).toDF(*names)
