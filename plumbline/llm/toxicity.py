"""Toxicity by maximum-scoring segments.

Every word gets the log-odds of toxic against other labelled documents under Dirichlet priors taken
from the pooled counts, as a lower confidence bound; words that say nothing on their own are read through their
prefixes. All other words share one small negative score, the log-odds of the remaining mass.
A linear scan finds all maximal segments of a text. Segment scores of random text follow an
extreme-value law, so ``-ln p`` with ``p = 1 - exp(-n exp(-lambda S))`` tells how surprising a passage is in
a text of n words; lambda solves the law's equation for the learnt scores. The evidence of all
significant passages and the best segment make the document's score by a logistic curve, which is
fitted on labelled documents that the word scores have not seen.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage, worker_cache
from plumbline.plans.frames import hash_share

#: Labelled documents the model is fitted on, at most about so many, picked by a hash of their id.
SAMPLE = 24_000
#: Word scores kept at most, the surest first.
FEATURES = 50_000
#: Mass of the prior as a share of all counts, least standard errors above zero, prefix lengths.
PRIOR, SURE, PREFIXES = 0.1, 3.0, (6, 5, 4)
THRESHOLD = 0.7
KNOWN_WORDS = 500_000
WORDS = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def maximal_segments(hits: list[tuple], drift: float) -> list[tuple[int, int, float]]:
    """The segments of ``plain_segments``. Where hits also carry their word, a segment's score is that of its best part
    when the k-th time a word comes up in the segment counts 1/k², as the scores are learnt from documents and not from
    repetitions. What comes before or after a segment has no say in it."""
    found = plain_segments([hit[:2] for hit in hits], drift)
    if not hits or len(hits[0]) < 3:
        return found
    out, i = [], 0
    for start, end, _ in found:
        seen: Counter = Counter()
        best, run, last = 0.0, 0.0, start - 1
        while i < len(hits) and hits[i][0] <= end:
            place, score, word = hits[i]
            seen[word] += 1
            run = max(0.0, run - drift * (place - last - 1)) + score / seen[word] ** 2
            best, last, i = max(best, run), place, i + 1
        out.append((start, end, best))
    return out


def plain_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a sequence in which the words
    ``hits`` (place, positive score) stand out and every other word scores ``-drift``; linear time."""
    open_: list[list[float]] = []  # start, end, sum before, sum through
    total, last = 0.0, -1
    for place, score in hits:
        total -= drift * (place - last - 1)
        seg = [place, place, total, total + score]
        total += score
        last = place
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= seg[2]:
                j -= 1
            if j < 0 or open_[j][3] >= seg[3]:
                open_.append(seg)
                break
            seg = [open_[j][0], seg[1], open_[j][2], seg[3]]
            del open_[j:]
    return [(int(s), int(e), b - a) for s, e, a, b in open_]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    drift: float = 0.05
    decay: float = 1.0
    curve: tuple[float, float, float] = (-2.0, 1.0, 0.0)

    def word(self, word: str) -> float:
        found = self.scores.get(word)
        if found is not None:
            return found
        for size in PREFIXES:
            if len(word) > size:
                found = self.scores.get(word[:size] + "*")
                if found is not None:
                    return found
        return 0.0

    def hits(self, words: list[str], known: dict[str, float]) -> list[tuple[int, float, str]]:
        """Places and scores of the words that stand out, and the words."""
        if len(known) > KNOWN_WORDS:
            known.clear()
        new = {w for w in words if w not in known}
        for w in new:
            known[w] = self.word(w)
        return [(i, score, w) for i, w in enumerate(words) if (score := known[w]) > 0]

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, float, list[tuple[int, int, float]]]:
        """Sum of -ln p over the segments, the best segment's score, and the segments with p < 0.05."""
        total, best, found = 0.0, 0.0, []
        for start, end, score in segments:
            expected = max(n, 1) * math.exp(-min(700.0, self.decay * score))
            surprise = -math.log(-math.expm1(-expected)) if expected < 700 else 0.0
            total, best = total + surprise, max(best, self.decay * score)
            if surprise > -math.log(0.05):
                found.append((start, end, surprise))
        return total, best, found

    def score(self, total: float, best: float) -> float:
        a, b, c = self.curve
        z = a + b * math.log1p(total) + c * math.log1p(best)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, other = Counter(), Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (toxic if label else other).update(set(tokens(text)))
        words = [*(toxic.keys() | other.keys())]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([other[w] for w in words], pa.int64())], names=["word", "n1", "n0"])


def _log_odds(counts: DataFrame, n1: float, n0: float) -> DataFrame:
    """word, n1, n0, p0 (posterior share among other documents), z and score (one standard error below the log-odds)."""
    mass = PRIOR * (n1 + n0)
    own = F.lit(PRIOR) * (F.col("n1") + F.col("n0"))
    y1, y0 = F.col("n1") + own, F.col("n0") + own
    odds = F.log(y1 / (F.lit(n1 + mass) - y1)) - F.log(y0 / (F.lit(n0 + mass) - y0))
    error = F.sqrt(1 / y1 + 1 / y0)
    return counts.select("word", "n1", "n0", (y0 / (n0 + mass)).alias("p0"), (odds / error).alias("z"), (odds - error).alias("score")).where(F.col("z") >= SURE)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model of the labelled documents; labels may repeat (toxic wins) or be null (left out).

    Without labels of both kinds the model knows no words and gives every text the same low score.
    """
    known = cut_lineage(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col(label_col).cast("int")).alias("label")).where("label is not null"))
    share = sample / max(1, known.count())
    picked = known.where(hash_share(F.col("id"), seed=5) < F.lit(float(min(share, 1.0))))
    # Copies count once; if their labels differ, toxic wins.
    texts = cut_lineage(docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(F.broadcast(picked), "id").groupBy(
        F.xxhash64("text").alias("key")).agg(F.min("text").alias("text"), F.max("label").alias("label")))
    fold = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(4))
    counts = cut_lineage(texts.where(fold > 0).select("text", "label").mapInArrow(_counts, "word string, n1 bigint, n0 bigint").groupBy("word").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))
    n1, n0 = (float(x or 0) for x in counts.agg(F.sum("n1"), F.sum("n0")).first())
    if not n1 or not n0:
        return Model()
    whole = _log_odds(counts, n1, n0)
    rest = counts.join(whole.select("word"), "word", "left_anti")
    parts = [rest.where(F.length("word") > size).groupBy(F.concat(F.substring("word", 1, size), F.lit("*")).alias("word")).agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0")) for size in PREFIXES]
    stems = _log_odds(parts[0].unionByName(parts[1]).unionByName(parts[2]), n1, n0)
    rows = whole.unionByName(stems).orderBy(F.desc("z"), "word").limit(FEATURES).collect()
    scores = {r["word"]: r["score"] for r in rows if r["score"] > 0}
    m1 = min(0.5, sum(r["n1"] for r in rows) / n1)
    m0 = min(0.5, sum(r["p0"] for r in rows))
    drift = max(0.01, math.log1p(-m0) - math.log1p(-m1)) if m1 > m0 else 0.05
    model = Model(scores, drift, _decay([(r["p0"], r["score"]) for r in rows if r["score"] > 0], drift))
    model.curve = _curve(model, texts.where(fold == 0).select("text", "label"))
    return model


def _decay(shares: list[tuple[float, float]], drift: float) -> float:
    """The positive solution of E[exp(lambda * score)] = 1 over words of other documents."""
    rest = max(1e-6, 1 - sum(p for p, _ in shares))
    def mean(x: float) -> float:
        return sum(p * math.exp(min(700.0, x * s)) for p, s in shares) + rest * math.exp(-x * drift) - 1
    low, high = 1e-3, 3.0
    if not shares or mean(low) > 0 or mean(high) < 0:
        return 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    return low


def _curve(model: Model, texts: DataFrame) -> tuple[float, float, float]:
    """Logistic weights of the evidence on the documents kept back, at most a quarter of the sample."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                words = tokens(text)
                out.append(model.evidence(maximal_segments(model.hits(words, known), model.drift), len(words))[:2])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.float64()), pa.array([y for _, y in out], pa.float64()), batch.column(1).cast(pa.int32())], names=["total", "best", "label"])

    rows = texts.mapInArrow(work, "total double, best double, label int").toPandas()
    x = np.column_stack([np.ones(len(rows)), np.log1p(rows.total), np.log1p(rows.best)])
    y = (rows.label > 0).to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Model().curve
    w = np.zeros(3)
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -4, 4)
        if abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


JUDGED = "score double, passages array<struct<start:int,end:int,surprise:double>>"


def judge(model: Model, text: Column, spark) -> Column:
    """Struct of score and passages (start and end as characters) for every text; null counts as empty."""
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def work(texts: pd.Series) -> pd.DataFrame:
        model = sent.value
        cache = worker_cache("toxicity")
        if cache.get("model") != key:
            cache.clear()
            cache.update(model=key, known={})
        scores, passages = [], []
        for text in texts:
            words = tokens(text)
            total, best, found = model.evidence(maximal_segments(model.hits(words, cache["known"]), model.drift), len(words))
            scores.append(model.score(total, best))
            spans = [m.span() for m in WORDS.finditer(text.lower())] if found else []
            passages.append([{"start": spans[s][0], "end": spans[e][1], "surprise": p} for s, e, p in found])
        return pd.DataFrame({"score": scores, "passages": passages})

    return F.pandas_udf(work, JUDGED)(text)


def toxicity(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the columns ``toxicity`` (struct of score and passages) and ``toxic_predicted`` (0 or 1).

    Row by row, so null ids and repeated rows need no care; null and empty texts have the score of
    a text without any passage. ``start`` and ``end`` count in the lower-cased text.
    """
    judged = docs.withColumn("toxicity", judge(model, docs[text_col], docs.sparkSession))
    return judged.withColumn("toxic_predicted", (F.col("toxicity.score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, with their columns as they are."""
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    kept = toxicity(plain, model, f"_{names.index(text_col)}", threshold).where("toxic_predicted = 0")
    return kept.select(*plain.columns).toDF(*names)


def held_out(ident: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(ident.cast("string")), F.lit(3)) == 1, F.lit(False))
