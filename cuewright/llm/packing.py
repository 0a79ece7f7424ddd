"""Op 9: first-fit decreasing with a tournament tree, apart in random groups of documents.

A document's ids are cut into full sequences and one remainder.  Full sequences need no
search.  Remainders are dealt to groups by a hash of the document; in each group, in
descending length, each goes to the first bin with room, found from the root of a tournament
tree (a binary tree that holds the largest free room below each node) in O(log bins) steps.
Only lengths and checksums are shuffled, never texts or ids.

Defined results: a null text is empty (one piece, the end id alone); rows that repeat a
doc_id are separate documents; a null doc_id is packed as any other; equal lengths go by
doc_id and checksum; an empty table gives no rows.  No piece or group is dropped or capped: a
group's expected size is a parameter, and rows that are alike in id and text are spread too: by turns within a task, which is all
that may differ between runs (it is the same for rows that don't repeat).  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
GROUP = 2000  # documents of a group, expected
TURNS = 100_000  # rows whose repeats a task counts at a time
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket long, twin int"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """First bin, in order of opening, with a given room: the tree of maxima over ``bins`` bins."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece, whose room it takes."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < length:
                k += 1
        had = room[k]
        room[k] = left = had - length
        bin_ = k - self.leaves
        while k > 1:
            k //= 2
            left = room[2 * k] if room[2 * k] >= room[2 * k + 1] else room[2 * k + 1]
            if room[k] == left:
                break
            room[k] = left
        return bin_, had


def first_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each length, all of them from 1 to ``capacity``."""
    tree, out = Tournament(max(1, len(lengths)), capacity), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bin_, room = tree.place(lengths[i])
        out[i] = (bin_, capacity - room)
    return out


def pieces(docs: DataFrame, groups: int, tokenizer: str, end_id: int, capacity: int, seed: int) -> DataFrame:
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        common.tidy()  # of what the worker did before
        enc, seen = tokens.encoder(tokenizer), Counter()
        for batch in batches:
            for names, texts in tokens.slices(batch):
                rows = []
                for key, got in zip(names, enc.encode(texts)):
                    raw = got + end
                    n, crc = len(raw) // 4, zlib.crc32(raw)
                    if len(seen) >= TURNS:  # what repeats often is met again
                        seen.clear()
                    twin = seen[key, crc, n]  # equal rows of this task: spread by turns, whichever comes first
                    seen[key, crc, n] += 1
                    bucket = zlib.crc32(f"{seed} {key} {crc} {n} {twin // 64}".encode()) % groups
                    for at in range(0, n, capacity):
                        size = min(capacity, n - at)
                        rows.append((key, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), n, bucket, twin))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), [pa.int64()] * 6 + [pa.int32()])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "twin"])
            common.tidy()

    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.spread(small).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY, group: int = GROUP, seed: int = 9) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with the sequence and the offset that each goes to."""
    groups = max(1, -(-docs.count() // group))
    cut = pieces(docs, groups, tokenizer or tokens.default_path(), end_id, capacity, seed)

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), *((x, "ascending") for x in ("doc_id", "ids_crc32", "start", "doc_tokens", "twin"))])
        lengths, base = table.column("length").to_pylist(), table.column("bucket")[0].as_py() << 32
        full = sum(x == capacity for x in lengths)
        placed = [(i, 0) for i in range(full)] + [(full + b, at) for b, at in first_fit_decreasing(lengths[full:], capacity)]
        table = table.append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64()))
        return table.append_column("offset", pa.array([at for _, at in placed], pa.int64())).drop_columns(["bucket", "twin"])

    return cut.groupBy("bucket").applyInArrow(fill, PACKED)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
