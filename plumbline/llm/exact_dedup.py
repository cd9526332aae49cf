"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

The rows are dealt evenly into runs. Each run is sorted by digest and folded to one
entry per digest. Then runs are exchanged in rounds: a round merges ``2 ** bits`` neighbouring
runs into one, a binomial tree with that fan-in, until one run is left, which every round
spreads over all tasks by digest. A merge walks the entries in order of digest, SHA-256 and id, and of neighbours with the
same SHA-256, at most one from each run, the first stays with the sum of their row counts; the 64-bit digest alone decides nothing. The answer goes back
down: to the first runs, at most one row per run and digest, and from there to the rows. No step
puts more than one run's share of a digest into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage, keep_rows, power_of_two, row_key, shuffle_partitions

#: Bits of a run's number that one round merges away: 16 runs become one.
ROUND_BITS = 4


def normalised(text: Column) -> Column:
    """Null as empty; each run of spaces, tabs and line ends as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def merge_sorted(entries: DataFrame) -> DataFrame:
    """One entry for each (run, digest, sha) of the entries (run, digest, sha, smallest, n): a walk over the sorted rows that
    keeps the first of equal neighbours, the one with the smallest id (null if none has one)."""
    order = [F.col("run"), F.col("digest"), F.col("sha"), F.col("smallest").asc_nulls_last()]
    same = Window.partitionBy("run", "digest", "sha").orderBy(F.col("smallest").asc_nulls_last())
    dealt = entries.repartition("run", "digest", "sha").sortWithinPartitions(*order)
    walked = dealt.withColumns({"turn": F.row_number().over(same), "all": F.sum("n").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return walked.where("turn = 1").select("run", "digest", "sha", "smallest", F.col("all").alias("n"))


def merge_runs(entries: DataFrame, runs: int, bits: int = ROUND_BITS) -> DataFrame:
    """(digest, sha, smallest, n) over all runs from the sorted entries (run, digest, sha, smallest, n)."""
    while runs > 1:
        runs = max(1, runs >> bits)
        entries = merge_sorted(entries.withColumn("run", F.shiftright("run", bits)))
    return entries.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = ROUND_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_key.

    Null texts count as empty. Ids may be null or repeated: the smallest id that is not null
    stays, among rows with that id and text just one (the smallest ``text_key``, a hash of the raw text); a group without any id
    keeps one row and has no ``keep_id``. An empty table gives an empty result. Other columns play no part.
    """
    runs = power_of_two(4 * shuffle_partitions(docs.sparkSession))
    sha = F.unhex(F.sha2(normalised(docs[text_col]), 256))
    rows = cut_lineage(docs.select(docs[id_col].alias("doc_id"), row_key(docs[text_col]).alias("text_key"), sha.alias("sha")).withColumn("row", F.monotonically_increasing_id()).select(
        "doc_id", "text_key", "sha", "row", F.xxhash64("sha").alias("digest"), F.pmod(F.xxhash64("row"), F.lit(runs)).cast("int").alias("run")))
    # Rows without an id come last; of rows alike in id and text the first one as the table was read.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "row")
    first = rows.groupBy("run", "digest", "sha").agg(F.min(order).alias("smallest"), F.count(F.lit(1)).alias("n"))
    merged = merge_runs(first, runs, bits).select("digest", "sha", "smallest", F.col("n").alias("group_size"))
    answers = first.select("run", "digest", "sha").join(merged, ["digest", "sha"])
    placed = rows.join(answers, ["run", "digest", "sha"])
    return placed.select(
        "doc_id", F.col("smallest.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("smallest.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "text_key")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    return keep_rows(docs, exact_dedup(docs, id_col, text_col).where("kept"), id_col, text_col)
