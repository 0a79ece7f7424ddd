"""A stated set of queries against all rows, in blocks: one scan of the rows, whatever the number of blocks; nothing reaches the driver.

Queries are dealt to blocks and rows to chunks by hashes.  A task has one block and streams the rows of one chunk past it, so it
holds a block and its best hits only.  Each row goes to every block, each query to every chunk: with blocks of ``block`` queries
what is shuffled is small beside the products that are computed.  There are about as many tasks as the cluster has cores or the rows have
partitions; where the rows' number is given, there are as few as hold ``chunk`` rows each and keep all cores busy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions import vector as vx

MOST_CHUNKS = 4096
#: Rows of a task's hits that are handed to Spark at once.
OUT_STEP = 16_384


class Search(Protocol):
    """One block's search: queries come first, then all rows of a chunk."""

    def add_queries(self, queries: pa.StructArray) -> None: ...

    def add_rows(self, rows: pa.StructArray) -> None: ...

    def result(self) -> pa.RecordBatch | None: ...


def partitions(df: DataFrame) -> int:
    """How many partitions ``df`` comes in, without running any of it: behind a shuffle, as many as shuffles have."""
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return plan.toRdd().getNumPartitions()


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if its input has fewer (a table of one file, say); else as it is.  For Python stages."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if partitions(df) < cores else df


def chunks_for(rows: DataFrame, blocks: int) -> int:
    """Chunks of the rows: enough to keep all cores busy, or one for each partition if these are more."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, min(MOST_CHUNKS, max(-(-cores // blocks), -(-partitions(rows) // blocks))))


def dealt_to(queries: int, rows: int, cores: int, block: int, chunk: int, k: int) -> tuple[int, int]:
    """(blocks, chunks) of at most ``block`` queries and ``chunk`` rows, that are at least ``cores`` pairs and shuffle little.

    Each row (two vectors) goes to every block; each query (one vector) and its ``k`` hits (a quarter of one) to or from every chunk.
    """
    blocks, chunks = max(1, -(-queries // block)), max(1, -(-rows // chunk))
    if blocks * chunks < cores:
        even = (cores * queries * (1 + k / 4) / (2 * max(rows, 1))) ** 0.5
        blocks = max(blocks, min(cores // chunks, round(even)))
        chunks = max(chunks, -(-cores // blocks))
    return blocks, chunks


def in_steps(found: Search | None) -> Iterator[pa.RecordBatch]:
    """The hits of a task's search, if it had any, in batches of ``OUT_STEP`` rows."""
    if found is not None and (out := found.result()) is not None:
        for a in range(0, out.num_rows, OUT_STEP):
            yield out.slice(a, OUT_STEP)


def searched(
    queries: DataFrame, rows: DataFrame, query_key: str, row_keys: list[str], search: Callable[[], Search], schema: str, block: int, chunk: int | None = None, size: int = 0, k: int = 0, order: str | None = None, asked: int | None = None
) -> DataFrame:
    """Hits (``schema``) of every block of ``queries`` in every chunk of ``rows``; the caller merges the chunks' hits.

    ``queries`` are counted once, unless ``asked`` is their number or more; rows that are alike in ``row_keys`` meet in one chunk.  With ``chunk``,
    ``size`` is the number of rows or more, and ``k`` the hits that a query has in a chunk.  Rows come by their column ``order``, if it is given.
    """
    count = queries.count() if asked is None else asked
    blocks = max(1, -(-count // block))
    chunks = chunks_for(rows, blocks) if chunk is None else 1
    if chunk is not None:
        blocks, chunks = dealt_to(count, size, rows.sparkSession.sparkContext.defaultParallelism, block, chunk, k)
    number = lambda keys, n: F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(number([query_key], blocks).alias("b"), every(chunks).alias("c"), F.lit(False).alias("late"), F.struct(*queries.columns).alias("q"))
    r = rows.select(every(blocks).alias("b"), number(row_keys, chunks).alias("c"), F.lit(True).alias("late"), F.struct(*rows.columns).alias("r"))
    both = q.unionByName(r, allowMissingColumns=True).withColumn("task", F.col("b") * chunks + F.col("c"))
    dealt = both.select("task", "late", "q", "r").repartitionById(blocks * chunks, F.col("task")).sortWithinPartitions("task", "late", *([f"r.{order}"] if order else []))

    def run(batches):
        task, found = None, None
        for batch in batches:
            at = batch.column("task").to_numpy()
            late = batch.column("late").to_numpy(zero_copy_only=False)
            ends = np.flatnonzero((at[1:] != at[:-1]) | (late[1:] != late[:-1])) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(at)]):
                if a == b:
                    continue
                if at[a] != task:
                    yield from in_steps(found)
                    task, found = at[a], search()
                part = batch.slice(a, b - a)
                found.add_rows(part.column("r")) if late[a] else found.add_queries(part.column("q"))
        yield from in_steps(found)

    return dealt.mapInArrow(run, schema)


def matrix(vectors: pa.ListArray, width: int | None = None, kind=np.float64) -> np.ndarray:
    """Rows of numbers as one matrix; what a shorter row lacks is 0, what a longer one has beyond ``width`` is left out."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    width = int(lengths.max(initial=0)) if width is None else width
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out, ends = np.zeros((len(lengths), width), dtype=kind), np.concatenate([[0], np.cumsum(lengths)])
    for i, n in enumerate(np.minimum(lengths, width).tolist()):
        out[i, :n] = values[ends[i] : ends[i] + n]
    return out


class Best:
    """The k best rows of each query of a block, over batches; scores are whole numbers, ties go by the smaller key."""

    def __init__(self, queries: int, k: int):
        self.n, self.k, self.held, self.size = queries, k, [], 0

    def add(self, scores: np.ndarray, keys: np.ndarray, ok: np.ndarray, more: Callable[[np.ndarray, np.ndarray], list] = lambda query, at: []) -> None:
        """``scores`` and ``ok`` (queries x rows) and the rows' ``keys``; ``more`` gives further columns of chosen (query, row) pairs."""
        n = len(keys)
        if self.k < n:
            place = np.empty(n, dtype=np.int64)
            place[np.argsort(keys, kind="stable")] = np.arange(n)
            if int(np.abs(scores).max(initial=0)) < (1 << 62) // n:
                # one number for score and place, so that a selection leaves no ties
                both = np.where(ok, scores.astype(np.int64) * n + (n - 1 - place), np.iinfo(np.int64).min)
                at = np.argpartition(both, n - self.k, axis=1)[:, n - self.k :]
            else:
                at = np.lexsort((np.broadcast_to(place, scores.shape), -scores, ~ok), axis=1)[:, : self.k]
        else:
            at = np.broadcast_to(np.arange(n), scores.shape)
        query, at = np.repeat(np.arange(self.n), at.shape[1]), at.ravel()
        good = ok[query, at]
        query, at = query[good], at[good]
        if len(query):
            self.held.append((query, scores[query, at].astype(np.int64), keys[at], *more(query, at)))
            self.size += len(query)
        if self.size > 4 * self.n * self.k + 100_000:
            self.shrink()

    def shrink(self) -> None:
        if self.held:
            columns = [np.concatenate(x) for x in zip(*self.held)]
            query, score, key = columns[:3]
            order = np.lexsort((key, -score, query))
            ordered = query[order]
            order = order[np.arange(len(order)) - np.searchsorted(ordered, ordered, side="left") < self.k]
            self.held, self.size = [tuple(x[order] for x in columns)], len(order)

    def result(self) -> tuple | None:
        """Columns (query, score, key, and what ``more`` gave) of the best, or None."""
        self.shrink()
        return self.held[0] if self.held else None


class Nearest:
    """The k best rows of each query, over batches whose rows are numbered in the order of ties; ``floor`` is the least score that can still be one."""

    def __init__(self, queries: int, k: int, least: float | None):
        self.n, self.k, self.held, self.size, self.seeded = queries, k, [], 0, False
        self.floor = np.full(queries, -np.inf if least is None else least)

    def add(self, *columns: np.ndarray) -> None:
        """Columns: query, score, the row's number, and any more."""
        if len(columns[0]):
            self.held.append(columns)
            self.size += len(columns[0])
        if self.size > 3 * self.n * self.k + 16_384:
            self.shrink()

    def shrink(self) -> None:
        if not self.held:
            return
        columns = [np.concatenate(x) for x in zip(*self.held)]
        query, score, at = columns[:3]
        order = np.lexsort((at, -score, query))
        ordered = query[order]
        place = np.arange(len(order)) - np.searchsorted(ordered, ordered, side="left")
        last = order[place == self.k - 1]
        # a later row must be better than the k-th; scores are rounded, so half a unit more tells
        above = np.maximum(score[last] + 0.5 * 10.0**-vx.DIGITS, np.nextafter(score[last], np.inf))
        self.floor[query[last]] = np.maximum(self.floor[query[last]], above)
        order = order[place < self.k]
        self.held, self.size = [tuple(x[order] for x in columns)], len(order)

    def result(self) -> tuple | None:
        self.shrink()
        return self.held[0] if self.held else None
