"""Op 1: language identification by word-first backoff.

A known word scores by its log frequency in each language.  Another word falls back to its character 5-grams, else 4-grams,
and so on to single letters: the first length at which the model knows any of the word's n-grams decides, by the mean of
their log frequencies.  A text's language has the highest mean score of its words.

The model is fitted on a bounded sample of labelled rows (whole texts): languages share ``TRAIN_DOCS`` evenly, one
with fewer rows than its share gives all and leaves the rest to the others, and a share is ``LEAST_DOCS`` rows at least.
All words and all n-grams of the sample are known; none is cut.  A worker scores a word once for each batch of texts at most, and
adds up rows of one matrix of scores.  Every text is scored whole.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is any text if there
are no labelled rows; rows without a doc_id are never learned from, and their held_out is null; equal
scores go to the language that comes first by code point; rows may repeat, and get equal results; other columns are not read,
whatever their names; an empty table gives no rows.
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

TRAIN_DOCS = 8_000
LEAST_DOCS = 100
LONGEST = 5
EVIDENCE = 25  # words that count at most towards the certainty of a score
MEMO = 200_000  # words that the training texts lack, whose scores a worker keeps
_WORD = re.compile(r"[^\W\d_]+")


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between two marks; single letters go without the marks."""
    word = f"\x02{word}\x03" if n > 1 else word
    return [word[i : i + n] for i in range(len(word) - n + 1)]


class Model:
    """Log frequencies by language of words and of n-grams: a row of ``scores`` for each."""

    def __init__(self, langs: list[str], words: dict[str, list[int]], grams: dict[str, list[int]]):
        self.langs = langs
        self.words, tables = dict(zip(words, range(len(words)))), [self._logs(words.values())]
        self.grams, rows = {}, len(words)
        for n in range(1, LONGEST + 1):
            some = {g: x for g, x in grams.items() if len(g) == n}
            self.grams.update(zip(some, range(rows, rows + len(some))))
            tables.append(self._logs(some.values()))
            rows += len(some)
        self.scores = np.concatenate(tables)
        self.memo: dict[str, np.ndarray | None] = {}

    def _logs(self, counts) -> np.ndarray:
        if not counts:
            return np.zeros((0, len(self.langs)))
        n = np.array(list(counts), dtype=np.float64)
        return np.log(n + 0.5) - np.log(n.sum(axis=0) + 0.5 * (len(n) + 1))

    def score_word(self, word: str) -> np.ndarray | None:
        """Scores by language; none if nothing of the word is known or it has no letter."""
        if (row := self.words.get(word)) is not None:
            return self.scores[row]
        if not any(map(str.isalpha, word)):
            return None
        for n in range(LONGEST, 0, -1):
            found = [x for g in grams_of(word, n) if (x := self.grams.get(g)) is not None]
            if found:
                return self.scores[found].mean(axis=0)
        return None

    def _remembered(self, word: str) -> np.ndarray | None:
        if word not in self.memo:
            if len(self.memo) >= MEMO:
                return self.score_word(word)
            self.memo[word] = self.score_word(word)
        return self.memo[word]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, certainty) of each text."""
        parts = [_WORD.findall(text.lower()) if text else [] for text in texts]
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        new: dict[str, int] = {}  # words of the batch that the training texts lack, by their place behind the known ones
        extra, base, out = [], len(self.scores), []
        rows = []
        for words in parts:
            at = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))
            for i in np.flatnonzero(at < 0).tolist():
                word = words[i]
                if (row := new.get(word)) is None:
                    if (score := self._remembered(word)) is None:
                        row = -1 if any(map(str.isalpha, word)) else -2
                    else:
                        row = base + len(extra)
                        extra.append(score)
                    new[word] = row
                at[i] = row
            rows.append(at)
        tail = np.array(extra).reshape(len(extra), len(self.langs))
        for at in rows:
            late = at >= base
            known, n = at[(at >= 0) & ~late], int((at >= 0).sum())
            if not n and not (at == -1).any():
                out.append(("und", 0.0))
                continue
            mean = (self.scores[known].sum(axis=0) + tail[at[late] - base].sum(axis=0)) / max(n, 1)
            odds = np.exp((mean - mean.max()) * min(n, EVIDENCE))
            best = int(np.argmax(mean))
            out.append((self.langs[best], float(odds[best] / odds.sum())))
        return out


def _counts(rows: DataFrame, per_task, key: str, langs: int) -> DataFrame:
    """Sums by key of what ``per_task`` counts in each partition: a Counter of (key, language number)."""

    def count(batches):
        found = per_task(batches)
        keys = list(found)
        for a in range(0, len(keys), 50_000):
            part = keys[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([j for _, j in part], pa.int32()), pa.array([found[x] for x in part], pa.int64())], [key, "j", "n"])

    counted = common.spread(rows).mapInArrow(count, f"{key} string, j int, n long")
    return counted.groupBy(key).agg(*(F.sum(F.when(F.col("j") == j, F.col("n")).otherwise(0)).alias(f"n{j}") for j in range(langs)))


def share(sizes: list[int], total: int, least: int = LEAST_DOCS) -> float:
    """Rows for each language, so that all take ``total`` together; a language without so many gives what it has."""
    level = math.inf
    for i, n in enumerate(sorted(sizes)):
        level = total / (len(sizes) - i)
        if n > level:
            return max(level, least)
        total -= n
    return math.inf


def sampled(rows: DataFrame, train_docs: int) -> DataFrame:
    """The labelled rows that a model learns from: of each language about its share, chosen by a hash of the doc_id."""
    sizes = {x["lang"]: x["count"] for x in rows.groupBy("lang").count().collect()}
    level = share(list(sizes.values()), train_docs)
    cut = {lang: int(level / n * (1 << 30)) for lang, n in sizes.items() if n > level}
    if not cut:
        return rows
    keep = F.coalesce(F.create_map(*(F.lit(x) for pair in cut.items() for x in pair))[F.col("lang")], F.lit(1 << 30))
    return rows.filter(F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(1 << 30)) < keep)


def _table(counts: DataFrame, key: str, langs: int) -> dict[str, list[int]]:
    """Counts by language of every key, in order; as many as the bounded sample holds."""
    found = counts.orderBy(key).toArrow()
    columns = (found.column(f"n{j}").to_pylist() for j in range(langs))
    return dict(zip(found.column(key).to_pylist(), map(list, zip(*columns))))


def fit(rows: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """The model of ``rows`` (doc_id, text, lang); rows with a null text or lang teach nothing."""
    rows = common.stored(sampled(rows.filter("text is not null and lang is not null").select("doc_id", "text", "lang"), train_docs), "lang-sample")
    langs = sorted(x["lang"] for x in rows.select("lang").distinct().collect())
    if not langs:
        return Model([], {}, {})
    number = {x: j for j, x in enumerate(langs)}

    def word_counts(batches):
        found = Counter()
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                for word, n in Counter(_WORD.findall(text.lower())).items():
                    found[word, number[lang]] += n
        return found

    def gram_counts(batches):
        found = Counter()
        for batch in batches:
            by_lang = [batch.column(f"n{j}").to_pylist() for j in range(len(langs))]
            for i, word in enumerate(batch.column("word").to_pylist()):
                for j, column in enumerate(by_lang):
                    if column[i]:
                        for n in range(1, LONGEST + 1):
                            for g in grams_of(word, n):
                                found[g, j] += column[i]
        return found

    per_word = common.stored(_counts(rows, word_counts, "word", len(langs)), "lang-words")
    per_gram = common.stored(_counts(per_word, gram_counts, "gram", len(langs)), "lang-grams")
    return Model(langs, _table(per_word, "word", len(langs)), _table(per_gram, "gram", len(langs)))


def parts(batch, size: int = 1 << 21):
    """Runs of rows of an Arrow batch whose texts have about ``size`` bytes, one row at least."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a, done = 0, 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield batch.slice(a, b - a)
        a, done = b, int(ends[b - 1])


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each whole text of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        use = shared.value
        for batch in (part for whole in batches for part in parts(whole)):
            got = use.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.fold() == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return common.spread(rows).mapInArrow(score, PREDICTED)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, fit(docs.filter(common.fold() != 0)))
