"""Op 5: toxicity by class-conditional Kneser-Ney models.

Two Kneser-Ney models over words, one of toxic and one of ordinary texts.  As in Kneser-Ney's lower orders, a word counts once
for each context that holds it, not once for each occurrence; the context of a word is its text, so that one text that repeats
a word can't decide what the word means.  A class's counts are discounted, and the mass that this frees goes to the counts of
both classes together::

    P(word | class) = max(n(class, word) - D(class), 0) / n(class) + BACKOFF * P(word)
    P(word) = n(word) / (n + number of words)          what is left over is for words that neither class holds

Both classes give the same mass to the shared counts, which sets each one's discount D.  So a rare expression has what the
classes share: its ratio is exactly 1 unless one class holds it oftener than its discount, and a model is the short table of
words of which that holds.

A text is measured at ``SCALES``: the log of toxic over ordinary likelihood, divided by length, of its most toxic expression (one
word), of its most toxic passage (five words; a shorter text is divided by five too) and of the whole text.  A few insults are lost in the mean of a
long text, and many mild words don't make one expression.  A logistic curve, fitted on rows scored by a model that has not seen them
(two halves), turns the three ratios into a probability.

The models are fitted on a bounded sample of labelled rows (``TRAIN_DOCS`` of each class, whole texts);
every text is scored whole.

Defined results: a null or empty text has ratios of 0; rows without a doc_id are not learned from; without rows of both classes
every score is the toxic share, or 0 with no labels at all; a doc_id labelled twice with unlike labels is not learned from; rows
may repeat, and get equal scores; other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TRAIN_DOCS = 3_000
BACKOFF = 0.5
SCALES = (1, 5)  # words of a passage; the whole text comes last
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def discount(counts: dict[int, int], mass: float = BACKOFF) -> float:
    """The D with sum(min(D, n)) = mass * sum(n) over words; ``counts`` tells how many words have a count n (0 apart)."""
    counts = {n: k for n, k in counts.items() if n > 0}
    wanted, below, words = mass * sum(n * k for n, k in counts.items()), 0, sum(counts.values())
    for n in sorted(counts):  # up to n the sum grows with D by the number of words that have n or more
        if below + n * words >= wanted:
            return (wanted - below) / words
        below, words = below + n * counts[n], words - counts[n]
    return 0.0


def log_likelihood(n: int, shared: float, total: int, d: float, mass: float = BACKOFF) -> float:
    """log P(word | class) of a word with count ``n`` in a class of ``total``, discounted by ``d``."""
    return math.log(max(n - d, 0) / total + mass * shared)


def measures(ratio: dict[str, float], text: str | None) -> tuple[float, ...]:
    """Length-normalised log ratios: of the most toxic passage of each scale, then of the whole text."""
    words = words_of(text)
    x = np.fromiter(map(ratio.get, words, repeat(0.0)), dtype=np.float64, count=len(words))
    if not x.any():
        return (0.0,) * (len(SCALES) + 1)
    ends, out = np.concatenate([[0.0], np.cumsum(x)]), []
    for scale in SCALES:
        size = min(scale, len(x))
        out.append(float((ends[size:] - ends[:-size]).max()) / scale)
    return *out, float(ends[-1]) / len(x)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Log ratios of words, and the logistic weights; without ratios, a constant."""

    def __init__(self, ratio: dict[str, float] | None, weights, constant: float = 0.0):
        self.ratio, self.weights, self.constant = ratio, weights, constant

    def score(self, text: str | None) -> tuple[float, ...]:
        """Probability, then the ratios."""
        if self.ratio is None:
            return (self.constant, *(0.0,) * (len(SCALES) + 1))
        found = measures(self.ratio, text)
        z = float(np.dot(found, self.weights[:-1]) + self.weights[-1])
        return (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), *found)


def log_ratios(counted: DataFrame, halves: tuple[int, ...], mass: float = BACKOFF) -> dict[str, float]:
    """log P(word | toxic) - log P(word | ordinary), where it isn't 0.  ``counted``: (word, n0 to n3), ordinary then toxic, by half.

    What comes to the driver is bounded by the sample: how often each count occurs, and the words above a discount.
    """
    n = [sum((F.col(f"n{2 * y + h}") for h in halves), F.lit(0)).alias(name) for y, name in ((0, "ordinary"), (1, "toxic"))]
    table = counted.select("word", *n).filter("ordinary + toxic > 0")
    size, words = table.agg(F.sum(F.col("ordinary") + F.col("toxic")), F.count(F.lit(1))).first()
    if not words:
        return {}
    sides = {}
    for side in ("ordinary", "toxic"):
        counts = {r[0]: r[1] for r in table.groupBy(side).count().collect()}
        sides[side] = sum(k * c for k, c in counts.items()), discount(counts, mass)
    (no, do), (nt, dt) = sides["ordinary"], sides["toxic"]
    if not no or not nt:
        return {}
    above = table.filter((F.col("ordinary") > do) | (F.col("toxic") > dt)).collect()
    shared = lambda r: (r["ordinary"] + r["toxic"]) / (size + words)
    return {r["word"]: log_likelihood(r["toxic"], shared(r), nt, dt, mass) - log_likelihood(r["ordinary"], shared(r), no, do, mass) for r in above}


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, mass: float = BACKOFF) -> Model:
    """The model of labelled rows: ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1)."""
    marks = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("y1")).filter("y = y1").select("doc_id", "y")
    chosen = None
    for y in (0, 1):
        part = common.hashed_sample(marks.filter(F.col("y") == y), F.col("doc_id"), train_docs)
        chosen = part if chosen is None else chosen.union(part)
    chosen = common.sized_broadcast(common.stored(chosen, "toxic-labels"), 4 * train_docs)
    # a text that repeats an id counts once for each row
    rows = common.stored(docs.select("doc_id", "text").join(chosen, "doc_id").withColumn("half", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)).cast("int")), "toxic-sample")
    rows = common.spread(rows)
    sizes = {x["y"]: x["count"] for x in rows.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Model(None, None, 1.0 if sizes.get(1) else 0.0)

    def count(batches):
        for batch in batches:
            found = Counter()
            for text, y, half in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "half"))):
                for word in set(words_of(text)):
                    found[word, 2 * y + half] += 1
            keys = list(found)
            for a in range(0, len(keys), 50_000):
                part = keys[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.string()), pa.array([j for _, j in part], pa.int32()), pa.array([found[k] for k in part], pa.int64())], ["word", "j", "n"])
        common.tidy()

    counted = rows.mapInArrow(count, "word string, j int, n long").groupBy("word").agg(*(F.sum(F.when(F.col("j") == j, F.col("n")).otherwise(0)).alias(f"n{j}") for j in range(4)))
    counted = common.stored(counted, "toxic-words")
    spark = docs.sparkSession
    pair = spark.sparkContext.broadcast([log_ratios(counted, (1,), mass), log_ratios(counted, (0,), mass)])  # for rows of half 0, the model of half 1

    def seen_by_other(batches):
        for batch in batches:
            texts, half = batch.column("text"), batch.column("half").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([measures(pair.value[h], t.as_py()) for t, h in zip(texts, half)], pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    scored = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "text", "half").mapInArrow(seen_by_other, "doc_id long, y int, x array<double>").orderBy("doc_id", "x").collect()
    weights = logistic(np.array([r["x"] for r in scored]), np.array([r["y"] for r in scored], dtype=np.float64))
    return Model(log_ratios(counted, (0, 1), mass), weights)


SCORED = "doc_id long, held_out boolean, score double, predicted int, word_ratio double, passage_ratio double, text_ratio double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``SCORED`` for each whole text of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        use = shared.value
        for batch in batches:
            got = np.array([use.score(x.as_py()) for x in batch.column("text")], dtype=np.float64).reshape(-1, len(SCALES) + 2)
            p = got[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *map(pa.array, got[:, 1:].T)], ["doc_id", "held_out", "score", "predicted", "word_ratio", "passage_ratio", "text_ratio"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.fold() == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return common.spread(rows).mapInArrow(scored, SCORED)


def ordinary_only(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with any columns) without the rows whose score is 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches):
        use = shared.value
        for batch in batches:
            yield batch.filter(pa.array([use.score(x.as_py())[0] < 0.5 for x in batch.column("text")], pa.bool_()))
        common.tidy()

    return docs.mapInArrow(kept, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return score(docs, fit(docs.filter(common.fold() != 0), labels))
