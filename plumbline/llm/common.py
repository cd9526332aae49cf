"""Pieces the corpus operators share: lineage cuts, skew-safe lookups, row decisions, worker caches."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.frames import cut_lineage, shared_folder

__all__ = ["Recent", "cut_lineage", "keep_rows", "power_of_two", "row_key", "salted_lookup", "shared_table", "shuffle_partitions", "shuffles_removed", "split_crowded", "table", "worker_cache"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under a name of its own in the folder all executors share, and read again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries made in here let go of their shuffle files when they end, and not when the driver next collects its garbage. It
    suits steps whose results are checkpointed."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def power_of_two(least: int) -> int:
    """The smallest power of two that is at least ``least``."""
    return 1 << max(0, least - 1).bit_length()


def salted_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: Column, salts: int) -> DataFrame:
    """Left join of ``rows`` with ``lookup`` (one row per key) that no hot key can block.

    Rows are dealt by key and a salt taken from ``spread``. Only the (key, salt) pairs
    that occur are joined with the lookup, at most ``salts`` rows for a key, and rows then
    meet the answer of their own salt. Keys must not be null.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread, F.lit(7)), F.lit(salts)).cast("int"))
    answers = salted.select(*keys, "_salt").distinct().join(lookup, keys)
    return salted.join(answers, [*keys, "_salt"], "left").drop("_salt")


def split_crowded(rows: DataFrame, keys: list[str], block: int, spread: Column, counted: DataFrame | None = None, crowd: DataFrame | None = None) -> DataFrame:
    """Adds p, q, left and right, so that all pairs of a key's rows meet without a key growing past two blocks.

    A key of up to ``block`` rows stays whole (p = q = 0, both sides true). The rows of a larger one are dealt into
    blocks by ``spread``, and a copy of each goes to every pair of blocks it belongs to; a pair of rows meets
    where one is ``left`` and the other ``right``. ``counted``, if given, are the rows of all keys that can be that
    large; the others need not be counted. ``crowd``, if given, are the keys of more than ``block`` rows with their numbers of rows, ``_n``.
    """
    if crowd is None:
        crowd = (rows if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    whole = rows.select("*", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(True).alias("left"), F.lit(True).alias("right"))
    crowd = cut_lineage(crowd)
    if crowd.isEmpty():
        return whole
    blocks = F.ceil(F.col("_n") / block).cast("int")
    dealt = rows.join(crowd, keys).withColumn("_own", F.pmod(F.xxhash64(spread), blocks).cast("int")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return whole.join(crowd, keys, "left_anti").unionByName(dealt.select(
        *rows.columns, F.least("_own", "_other").alias("p"), F.greatest("_own", "_other").alias("q"),
        (F.col("_own") <= F.col("_other")).alias("left"), (F.col("_own") >= F.col("_other")).alias("right")))


def row_key(text: Column) -> Column:
    """Tells rows with the same id and different texts apart."""
    return F.xxhash64(text)


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose (id, text) is in ``kept`` (columns: doc_id, text_key), each once.

    Ids may be null or repeated; of rows equal in both, one stays. The columns of ``docs``
    come back as they are, whatever their names.
    """
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    ident, text = f"_{names.index(id_col)}", f"_{names.index(text_col)}"
    # Join and distinct use the same plain columns, so that texts are shuffled once.
    keys = ["none", "id", "key"]
    told = lambda ident, key: {"none": ident.isNull(), "id": F.coalesce(ident, F.lit(0)), "key": key}
    wanted = kept.select("doc_id", "text_key").withColumns(told(F.col("doc_id"), F.col("text_key"))).select(*keys)
    keyed = plain.withColumns(told(F.col(ident).cast("bigint"), row_key(F.col(text))))
    return keyed.join(wanted, keys, "left_semi").dropDuplicates(keys).select(*plain.columns).toDF(*names)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so that the tasks it runs one after
    the other share what they have worked out. Callers bound its size, and a worker keeps one at a
    time: asking for another name lets go of the one before."""
    kept = vars(sys).setdefault("_plumbline_caches", {})
    for other in [n for n in kept if n != name]:
        del kept[other]
    return kept.setdefault(name, {})


class Recent(dict):
    """Values by key, worked out by ``make`` when first asked for; about twice ``limit`` are kept, those used last.

    ``map(recent.__getitem__, keys)`` stays in C for the keys that are there. Where many are better worked out
    together, ``fill`` puts them there beforehand.
    """

    def __init__(self, limit: int, make: Callable | None = None):
        super().__init__()
        self.limit, self.make, self.old = limit, make, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self._age()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def _age(self) -> None:
        self.old = dict(self)
        self.clear()

    def fill(self, keys: set, make: Callable[[list], Iterable]) -> None:
        """All of ``keys`` are there afterwards; ``make`` gives the values of those not kept."""
        if len(self) >= self.limit:
            self._age()
        missing = [k for k in keys if k not in self]
        old = self.old
        self.update([(k, old[k]) for k in missing if k in old])
        missing = [k for k in missing if k not in self]
        if missing:
            self.update(zip(missing, make(missing)))
