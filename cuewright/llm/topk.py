"""Op 4: exact top-k inner products by exhaustive term-at-a-time accumulation.

Candidates are read once; queries come in blocks of ``QUERY_BLOCK``, and a task streams a chunk of the candidates past a block
(``operators.blocks``), so that neither queries nor candidates are collected or broadcast, whatever their number.  A task turns
each batch of its candidates into postings (for each term
the candidates that hold it, and their weights); for each term of the sparse query rows the
weighted postings are scattered into dense score arrays.  A partition selection keeps the k
best of a batch, merged with the best so far of the task; a window merges the tasks' k rows.
No candidate is skipped or capped.

Defined results: vectors that are null, or hold a null or a component that isn't finite, take no
part, nor do rows with a null id; components that a shorter vector lacks are 0; rows that share
an id are never each other's candidates, and of those the smallest vector is the query; ties go
to the smaller id (then repeat, if the candidates' table repeats it); other columns are not read, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.operators import blocks

from . import common

K = 5
QUERY_BLOCK = 4096  # queries that a task holds
CELLS = 4_000_000  # scores of a dense array at a time
HITS = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): whole vectors as integers; rows that take no part are left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(scale)).cast("long"))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


class Postings:
    """The inverted form of a batch of rows."""

    def __init__(self, rows: np.ndarray):
        self.size = len(rows)
        held = rows.T != 0
        self.of = [np.flatnonzero(x) for x in held]
        self.weight = [rows[at, t] for t, at in enumerate(self.of)]
        self.most = int(np.abs(rows).max(initial=0))

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Dense (queries x rows) scores, one term after the other."""
        bound = self.most * int(np.abs(queries).max(initial=0)) * max(1, len(self.of))
        kind = np.int32 if bound < 2**31 else np.int64
        out = np.zeros((len(queries), self.size), dtype=kind)
        for t, (at, weight) in enumerate(zip(self.of, self.weight)):
            users = np.flatnonzero(queries[:, t])
            if not len(users) or not len(at):
                continue
            added = np.multiply.outer(queries[users, t].astype(kind), weight.astype(kind))
            if len(users) == len(queries) and len(at) == self.size:
                out += added
            else:
                out[np.ix_(users, at)] += added
        return out


class _Search:
    """A block of queries (vec_id, v) and its best candidates so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.vectors, self.best = k, [], [], None

    def add_queries(self, queries: pa.StructArray) -> None:
        self.ids.append(queries.field("vec_id").to_numpy(zero_copy_only=False))
        self.vectors.append(queries.field("v"))

    def add_rows(self, rows: pa.StructArray) -> None:
        if self.best is None:
            if not self.ids:
                return
            self.names = np.concatenate(self.ids)
            self.wanted = blocks.matrix(pa.concat_arrays(self.vectors), kind=np.int64)
            step = max(1, CELLS // 8192)
            self.best = [(slice(a, a + step), blocks.Best(len(self.names[a : a + step]), self.k)) for a in range(0, len(self.names), step)]
        ids = rows.field("vec_id").to_numpy(zero_copy_only=False)
        whole = blocks.matrix(rows.field("v"), self.wanted.shape[1], np.int64)  # terms that no query of the block has add nothing
        for a in range(0, len(ids), 8192):
            some, post = ids[a : a + 8192], Postings(whole[a : a + 8192])
            for part, best in self.best:
                best.add(post.scores(self.wanted[part]), some, self.names[part][:, None] != some)

    def result(self) -> pa.RecordBatch | None:
        found = [(self.names[part], x) for part, best in self.best or () if (x := best.result()) is not None]
        if not found:
            return None
        columns = [np.concatenate(x) for x in zip(*((names[x[0]], x[2], x[1]) for names, x in found))]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for quantised ``queries`` against quantised ``candidates``."""
    queries = common.stored(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    hits = blocks.searched(queries, candidates.select("vec_id", "v"), "vec_id", ["vec_id", "v"], lambda: _Search(k), HITS, block)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(common.table(spark, sf_dir, "embeddings"))
    return top_k(rows.filter("vec_id % 50 = 0"), rows)


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
