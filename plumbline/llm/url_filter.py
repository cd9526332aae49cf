"""Allow and block lists over urls by a cascade of Bloom filters, in DataFrame operations only.

A url's candidate keys are every suffix of its host that has as many labels as some rule's host, with every prefix of its path that is as long
as some rule's path; so their number follows from the rules, however long the url. All candidate keys of the corpus are the key universe. Level 0 of the cascade
holds the listed keys; level 1 holds the universe's keys that level 0 takes for listed though they
are not; level 2 the listed keys that level 1 takes for false; and so on until a level errs on none.
A key of the universe is listed if it leaves the cascade at an odd level. That is exact, and urls
are judged by bit tests alone, without a join.

Level 0 has so many bits that about as many keys of the universe pass it as there are rules;
from then on each level halves the rest. The bits thus come to a few per rule and doubling of the
universe, a size bound by the rule list and not by the urls.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage

#: Bits of a word of a filter; 63 would be the sign.
WORD = 62
LEVELS = 64


@dataclass(frozen=True)
class Rule:
    """``verdict`` is block or allow; ``path`` is a prefix of the url's path."""

    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return f"{self.host}{self.path}"


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    hashes: int
    seed: int

    def holds(self, key: Column) -> Column:
        """True if all bits of the key are set."""
        words = F.from_json(F.lit(str(list(self.words))), "array<bigint>")  # one literal, however long
        test = F.lit(True)
        for place, shift in _bits(key, len(self.words), self.hashes, self.seed):
            test &= F.call_function("shiftright", F.get(words, place), shift).bitwiseAND(F.lit(1)) == 1
        return test


def _bits(key: Column, words: int, hashes: int, seed: int) -> list[tuple[Column, Column]]:
    out = []
    for i in range(hashes):
        place = F.pmod(F.xxhash64(key, F.lit(seed * 101 + i)), F.lit(words * WORD))
        out.append(((place / WORD).cast("int"), (place % WORD).cast("int")))
    return out


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of the distinct ``key`` column of about ``n`` keys with the given false share."""
    hashes = max(1, round(-math.log2(rate)))
    words = max(1, math.ceil(n * max(1.0, -math.log2(rate)) / math.log(2) / WORD))
    places = keys.select(F.explode(F.array(*[
        F.struct(p.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), s).alias("bit")) for p, s in _bits(F.col("key"), words, hashes, seed)])).alias("b"))
    found = dict(places.groupBy("b.word").agg(F.bit_or("b.bit")).collect())
    return Level(tuple(found.get(i, 0) for i in range(words)), hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, size: int) -> Cascade:
    """``listed``: the distinct keys of the rules; ``universe``: keys that will be asked for, repeated
    ones too, about ``size`` different ones. Only keys that pass level 0 are shuffled."""
    n = listed.count()
    if not n:
        return Cascade(())
    levels = [build_level(listed, n, min(0.5, math.sqrt(0.5) * n / max(size, 1)), 0)]
    inside = listed
    # The urls are read once; what passes level 0 is about as many keys as there are rules.
    outside = cut_lineage(universe.where(levels[0].holds(F.col("key"))).select("key").distinct().join(listed, "key", "left_anti"))
    while (wrong := outside.count()) and len(levels) < LEVELS:
        levels.append(build_level(outside, wrong, 0.5, len(levels)))
        inside, outside = outside, inside.where(levels[-1].holds(F.col("key")))
    if wrong:
        raise RuntimeError("the Bloom cascade has not ended; two keys share all their hashes")
    return Cascade(tuple(levels))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def candidates(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Keys of every host suffix of so many labels with every path prefix of the given lengths, longest key first;
    of equally long keys the one with the longer host comes first."""
    own = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    hosts = F.filter(F.array(*[F.when(own >= n, F.substring_index(host, ".", -n)) for n in labels]), lambda h: h.isNotNull())
    heads = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(heads, lambda p: F.struct(
        (-F.length(h) - F.length(p)).alias("size"), (-F.length(h)).alias("own"), F.concat(h, p).alias("key")))))
    return F.transform(F.array_sort(keys), lambda k: k["key"])


def url_filter(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    The longest rule that fits decides; where none fits, or the url is null or no url, ``rule`` is null
    and the verdict is allow. Repeated rows are judged each; an empty table gives an empty result. A
    host's port or user part belongs to the host. Hosts and paths of any length take work in proportion to their length. Other columns play no part.
    """
    spark = pages.sparkSession
    lengths, labels = sorted({len(r.path) for r in rules}), sorted({r.host.count(".") + 1 for r in rules})
    host, path = host_and_path(pages[url_col])
    judged = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    if not rules:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    keyed = judged.withColumn("keys", candidates(F.col("host"), F.col("path"), labels, lengths))
    universe = keyed.select(F.explode("keys").alias("key"))
    listed = spark.createDataFrame([(r.key, r.verdict) for r in rules], "key string, verdict string")
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    known = build_cascade(listed.select("key").distinct(), universe, size)
    block = build_cascade(listed.where("verdict = 'block'").select("key").distinct(), listed.select("key"), len(rules))
    rule = F.get(F.filter("keys", lambda k: known.listed(k)), F.lit(0))
    return keyed.withColumn("rule", rule).select(
        "page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull() & block.listed(F.col("rule")), "block").otherwise("allow").alias("verdict"))
