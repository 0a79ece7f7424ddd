"""Exact hybrid retrieval: similarity, fusion, negative penalty, category scope, top-k, re-ranking, confidence.

A stated set of queries is searched against every library row in one scan (``operators.blocks``): a task holds a block of queries and streams a chunk of
the library past it, keeping the best rows of each query; only those are shuffled, and a ranked window merges them.  No query reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright import rules
from cuewright.functions import text as tx
from cuewright.functions import vector as vx
from cuewright.operators import blocks


@dataclass(frozen=True)
class SearchParams:
    text_weight: float = 0.4
    neg_alpha: float = 0.0
    top_k: int = 3
    min_score: float | None = None
    candidates: int = 50
    scope_floor: int = 5
    query_block: int = 512


def prepared(library: DataFrame) -> DataFrame:
    """``library`` with vectors of doubles, without rows whose sound vector is null, zero, or holds a null or a number that isn't finite.

    A text vector of that kind, or none in the whole index, is a null ``text_emb``.
    """
    text = F.col("text_emb") if "text_emb" in library.columns else F.lit(None).cast("array<double>")
    catid = F.col("catid") if "catid" in library.columns else F.lit(None).cast("string")
    rows = library.select("path", catid.alias("catid"), vx.usable(F.col("audio_emb")).alias("audio_emb"), vx.usable(text).alias("text_emb"))
    return rows.filter("path is not null and audio_emb is not null")


def with_negatives(library: DataFrame, negatives: DataFrame, text_weight: float = 0.4) -> DataFrame:
    """``library`` with neg_sim, the highest similarity of each row with any negative query.

    Negatives are what a user types: they travel as one row of vectors, and nothing is shuffled.
    """
    unit = negatives.select(vx.normalised(vx.usable(F.col("query_emb"))).alias("v")).filter("v is not null")
    held = library.crossJoin(F.broadcast(unit.agg(F.collect_list("v").alias("_neg"))))

    def fused(v: Column) -> Column:
        return vx.dot(F.col("audio_emb"), v) * (1 - text_weight) + F.coalesce(vx.dot(F.col("text_emb"), v), F.lit(0.0)) * text_weight

    return held.withColumn("neg_sim", F.array_max(F.transform("_neg", fused))).drop("_neg")


def active_scopes(library: DataFrame, floor: int = 5) -> DataFrame:
    """(category, allowed): the search scopes that the library has ``floor`` rows in, or more; other categories are not restricted.

    Rows are counted by catalogue id, and the counts put together for each category: both are as small as the rule tables.
    """
    scope = rules.scope(library.sparkSession)
    counts = library.groupBy("catid").agg(F.count(F.lit(1)).alias("n"))
    held = scope.select("category", F.explode("allowed").alias("catid")).join(counts, "catid").groupBy("category").agg(F.sum("n").alias("n"))
    return scope.join(held.filter(F.col("n") >= floor).select("category"), "category", "left_semi")


def ranked(scored: DataFrame, score: str, k: int, tie: str = "path", name: str = "rank") -> DataFrame:
    """The k best rows of each query, ties by ``tie``; rows with a null score are never ranked."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), tie)
    return scored.filter(F.col(score).isNotNull()).withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)


#: What a task holds at most: queries, places of their hits, and library rows.  ``SearchParams.query_block`` is how many queries are multiplied at once.
TASK_QUERIES, TASK_PLACES, TASK_ROWS = 65_536, 1_600_000, 262_144
#: Hits that a task merges, on average.
MERGED = 1_000_000
ROW_STEP, PAIR_STEP = 2048, 32_768

HITS = "query_id long, path string, catid string, score double, audio_sim double, text_sim double, neg_sim double"


class _Search:
    """A block of queries (query_id, v, allowed) and its best library rows so far.

    A product in single precision tells which pairs may be among the best, its error allowed for; only these are scored, in double precision.
    Rows come in order of path, so that ties go by their numbers.
    """

    def __init__(self, params: SearchParams):
        self.params, self.ids, self.vectors, self.allowed = params, [], [], []
        self.groups: list[tuple] | None = None
        self.rows, self.count = [], 0

    def add_queries(self, queries: pa.StructArray) -> None:
        self.ids.append(queries.field("query_id").to_numpy(zero_copy_only=False))
        self.vectors.append(queries.field("v"))
        self.allowed += [None if x is None else tuple(x) for x in queries.field("allowed").to_pylist()]

    def _begin(self) -> None:
        """Queries of one scope are a group, which meets the rows of its scope only."""
        whole, self.names = blocks.matrix(pa.concat_arrays(self.vectors)), np.concatenate(self.ids)
        self.width, self.vectors, self.groups = whole.shape[1], [], []
        for names in set(self.allowed):
            who = np.flatnonzero([x == names for x in self.allowed])
            exact = whole[who]
            quick = np.hstack([exact, np.ones((len(who), 1))]).astype(np.float32)  # the last is for what is taken off a row
            self.groups.append((names, who, exact, quick, blocks.Nearest(len(who), self.params.top_k, self.params.min_score)))

    def add_rows(self, rows: pa.StructArray) -> None:
        if not self.ids or not len(rows):
            return
        if self.groups is None:
            self._begin()
        for a in range(0, len(rows), ROW_STEP):
            self._add(rows.slice(a, ROW_STEP))

    def _add(self, rows: pa.StructArray) -> None:
        w, alpha, first = self.params.text_weight, self.params.neg_alpha, self.count
        audio = blocks.matrix(rows.field("audio_emb"), self.width)
        text_emb, text = rows.field("text_emb"), np.zeros_like(audio)
        held = np.flatnonzero(text_emb.is_valid().to_numpy(zero_copy_only=False))
        if len(held):
            text[held] = blocks.matrix(text_emb.take(pa.array(held)), self.width)
        negative = rows.field("neg_sim").to_numpy(zero_copy_only=False).astype(np.float64)
        catids = rows.field("catid").to_pylist()
        self.rows.append((rows.field("path").take(pa.array(np.arange(len(rows)))), catids, negative))  # a copy, else the whole batch is held
        self.count += len(rows)
        off = -alpha * negative
        usable = np.isfinite(off)
        fused = np.hstack([audio * (1 - w) + text * w, np.where(usable, off, 0.0)[:, None]])
        scale = float(np.abs(fused).max(initial=0)) or 1.0
        # sums of larger numbers may not be finite: all of these pairs are scored
        plain = max(float(np.abs(x).max(initial=0)) for x in (audio, text, fused)) > 1e150
        small = (fused / scale).astype(np.float32)
        error = (self.width + 5) * 2.0**-23 * 1.5 * float(np.sqrt((small.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
        for names, _, exact, quick, best in self.groups:
            at = np.flatnonzero(usable if names is None else usable & np.array([c in names for c in catids]))
            if not len(at):
                continue
            narrow = small if len(at) == len(small) else small[at]
            for a in range(0, best.n, self.params.query_block):
                self._pairs(slice(a, a + self.params.query_block), at, narrow, exact, quick, best, audio, text, negative, scale, error, plain, first)
            best.seeded = best.seeded or len(at) > best.k

    def _pairs(self, part, at, narrow, exact, quick, best, audio, text, negative, scale, error, plain, first) -> None:
        """The pairs of some queries with some rows (``at``) that may be among the best."""
        w, alpha, unit = self.params.text_weight, self.params.neg_alpha, 10.0**-vx.DIGITS
        if plain:
            query, row = (x.ravel() for x in np.indices((len(exact[part]), len(at))))
        else:
            near = quick[part] @ narrow.T
            if not best.seeded and len(at) > best.k:
                kth = np.partition(near, len(at) - best.k, axis=1)[:, len(at) - best.k].astype(np.float64)
                best.floor[part] = np.maximum(best.floor[part], (kth - error) * scale - unit)
            least = ((best.floor[part] - unit) / scale - error).astype(np.float32)
            query, row = np.divmod(np.flatnonzero(near >= least[:, None]), len(at))
        if not len(query):
            return
        row = at[row]
        if len(query) * 16 > len(exact[part]) * len(at):
            heard, told = (exact[part] @ audio.T)[query, row], (exact[part] @ text.T)[query, row]
        else:
            steps = range(0, len(query), PAIR_STEP)
            heard, told = (np.concatenate([np.einsum("ij,ij->i", exact[part][query[b : b + PAIR_STEP]], x[row[b : b + PAIR_STEP]]) for b in steps]) for x in (audio, text))
        score = np.round(heard * (1 - w) + told * w - alpha * negative[row], vx.DIGITS)
        good = np.isfinite(score) & (score >= best.floor[part][query])
        best.add((query[good] + part.start).astype(np.int32), score[good], (row[good] + first).astype(np.int32), heard[good], told[good])

    def result(self) -> pa.RecordBatch | None:
        found = [(who, x) for _, who, _, _, best in self.groups or () if (x := best.result()) is not None]
        if not found:
            return None
        query, score, row, heard, told = (np.concatenate(x) for x in zip(*((who[x[0]], *x[1:]) for who, x in found)))
        paths, catids, negative = zip(*self.rows)
        take = pa.array(row)
        columns = [pa.array(self.names[query].astype(np.int64)), pa.concat_arrays(paths).take(take), pa.array([c for x in catids for c in x], pa.string()).take(take)]
        columns += [pa.array(x) for x in (score, heard, told, np.concatenate(negative)[row])]
        return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in HITS.split(", ")])


def search(queries: DataFrame, library: DataFrame, params: SearchParams = SearchParams(), negatives: DataFrame | None = None, scoped: bool = False) -> DataFrame:
    """Hits (query_id, rank, path, catid, score, audio_sim, text_sim, neg_sim) of ``queries`` (query_id, query_emb, and category if ``scoped``).

    Scores are rounded before they are ranked, ties go by path.  Rows and queries whose vector is null, zero, or not all of finite numbers take no
    part; a row without a text vector has text_sim 0, and its audio part is still scaled by 1 - text_weight.
    """
    lib = prepared(library)
    against = negatives is not None and params.neg_alpha > 0
    lib = with_negatives(lib, negatives, params.text_weight) if against else lib.withColumn("neg_sim", F.lit(0.0))
    q = queries.filter("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), vx.normalised(vx.usable(F.col("query_emb"))).alias("v"), *(["category"] if scoped else []))
    if scoped:  # scopes are as few as the rule tables
        q = q.join(F.broadcast(active_scopes(library, params.scope_floor)), "category", "left").drop("category")
    else:
        q = q.withColumn("allowed", F.lit(None).cast("array<string>"))
    kinds = {c: t for c, t in library.dtypes if c in ("audio_emb", "text_emb") and t == "array<float>"}  # as narrow as they were
    lib = lib.select(*[F.col(c).cast(kinds.get(c, t)).alias(c) for c, t in lib.dtypes])
    block = max(1, min(TASK_QUERIES, TASK_PLACES // max(1, params.top_k)))
    asked = q.filter("v is not null").select("query_id", "v", "allowed")
    count, size, cores = queries.count(), library.count(), queries.sparkSession.sparkContext.defaultParallelism
    hits = blocks.searched(asked, lib, "query_id", ["path"], lambda: _Search(params), HITS, block, TASK_ROWS, size, params.top_k, "path", count)
    # a task has k hits of a query at most, so nothing is ranked before they are dealt out: to more tasks if there are more hits
    most = count * min(size, blocks.dealt_to(count, size, cores, block, TASK_ROWS, params.top_k)[1] * params.top_k)
    hits = hits.repartition(max(cores, -(-most // MERGED)), "query_id")
    sims = [vx.rounded(F.col(c)).alias(c) for c in ("audio_sim", "text_sim", "neg_sim")]
    return ranked(hits, "score", params.top_k).select("query_id", "rank", "path", "catid", "score", *sims)


def rerank(candidates: DataFrame) -> DataFrame:
    """``candidates`` (query_id, query, category, path, catid, score, rank) with bonuses and penalty in ``score``.

    +0.04 if the catalogue id is in the category's scope, +0.02 for each word of the query in the file's name, -0.12 if the id is
    wrong for the category.  Equal scores keep the order of retrieval.
    """
    spark = candidates.sparkSession
    dims = F.broadcast(rules.scope(spark)), F.broadcast(rules.wrong(spark))
    joined = candidates.join(dims[0], "category", "left").join(dims[1], "category", "left")
    scope = F.when(F.coalesce(F.array_contains("allowed", F.col("catid")), F.lit(False)) & (F.col("catid") != rules.UNKNOWN), 0.04).otherwise(0.0)
    overlap = F.size(F.array_intersect(tx.word_set(F.col("query")), tx.path_words(F.col("path")))) * 0.02
    penalty = F.when(F.coalesce(F.array_contains("bad", F.col("catid")), F.lit(False)), 0.12).otherwise(0.0)
    new = vx.rounded(F.col("score") + scope + overlap - penalty)
    return joined.withColumn("original_score", F.col("score")).withColumn("score", new).withColumnRenamed("rank", "retrieval_rank").drop("allowed", "bad")


def confidence(best: Column) -> Column:
    """Band of the best re-ranked score of a query; none counts as 0."""
    s = F.coalesce(best, F.lit(0.0))
    return F.when(s > 0.45, "high").when(s > 0.30, "medium").otherwise("low")


def smart_search(queries: DataFrame, library: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """Retrieve ``candidates`` for each query (query_id, query, category, query_emb), re-rank, keep ``top_k``, band the best."""
    hits = search(queries, library, SearchParams(text_weight=params.text_weight, top_k=params.candidates))
    known = queries.select("query_id", "query", "category")
    better = rerank(hits.join(known, "query_id"))
    out = ranked(better, "score", params.top_k, tie="retrieval_rank")
    best = F.max("score").over(Window.partitionBy("query_id"))
    return out.withColumn("confidence", confidence(best)).withColumn("source", F.lit("global"))


def nested(hits: DataFrame) -> DataFrame:
    """One row a query: ``results``, its hits in order of rank."""
    hit = F.struct("rank", *[c for c in hits.columns if c not in ("query_id", "rank")])
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("results"))


def without_excluded(hits: DataFrame) -> DataFrame:
    """Rows whose path holds none of the parts that their ``category`` excludes."""
    joined = hits.join(F.broadcast(rules.excluded(hits.sparkSession)), "category", "left")
    held = F.exists("patterns", lambda p: F.lower(F.col("path")).contains(F.lower(p)))
    return joined.filter(~F.coalesce(held, F.lit(False))).drop("patterns")


def report(hits: DataFrame) -> DataFrame:
    """One line of text for each hit, by query and rank."""
    line = F.format_string("%d. %s  %.4f (audio %.4f, text %.4f, negative %.4f)", "rank", tx.basename(F.col("path")), "score", "audio_sim", "text_sim", "neg_sim")
    return hits.orderBy("query_id", "rank").select("query_id", "rank", line.alias("line"))
