"""Op 3: token ids in shards coded by a static range asymmetric numeral system (rANS).

A shard is one self-contained byte string: header, one frequency table shared by all its blocks,
a document index, and independent blocks.  A block interleaves ``LANES`` coder states over one
stream of 32-bit words; every ``STEPS`` steps it holds a checkpoint (all states and the place in
the stream), so that a reader can start at any of them, or decode all of them side by side as
done here.  Each block ends in a CRC-32 of its ids, the shard in a CRC-32 of its bytes.

Shards are rows of a Parquet table (``part, shard, first_pos, n_docs, n_tokens, data``): Spark's
committer makes the write safe against lost tasks, on any file system that Spark can write.

Defined results: a null text is empty (only the end id); a null doc_id sorts first; rows that
repeat a doc_id are separate documents, ordered by a hash of the text; other columns are not read, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.operators import blocks

from . import common, tokens

MAGIC = b"CWR1"
SCALE = 20  # frequencies sum to 2**SCALE
LANES = 128
STEPS = 512  # steps between checkpoints
BLOCK = LANES * STEPS * 2  # ids of a block
LOW = 1 << 31  # a state is in [LOW, LOW << 32)
WORD_MEMO = 1_400_000  # words whose ids a worker keeps; it has little else in memory
SHARD_IDS = 1 << 21  # a shard is closed at the first document end at or beyond this


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, each at least 1, near to ``counts`` (all positive)."""
    total = 1 << SCALE
    if len(counts) > total:
        raise ValueError("more symbols than slots")
    freq = np.maximum(1, np.floor(counts * (total / counts.sum()))).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    rest = total - int(freq.sum())
    while rest:
        if rest > 0:
            freq[order[0]] += rest
            break
        room = freq[order] - 1
        cut = np.minimum(room, np.maximum(1, room // 2))
        cut = np.minimum(cut, np.maximum(0, -rest - np.concatenate([[0], np.cumsum(cut)[:-1]])))
        freq[order] -= cut
        rest += int(cut.sum())
    return freq


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values, dtype="<i8").tobytes(), 6)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype="<i8")


def _encode_blocks(sym: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> list[bytes]:
    """``sym`` is (blocks, ids a block) of symbol numbers; all blocks run side by side."""
    n_blocks, n = sym.shape
    steps = -(-n // LANES)
    lanes = np.zeros((n_blocks, steps * LANES), dtype=np.int64)  # the last step is filled with symbol 0
    lanes[:, :n] = sym
    lanes = lanes.reshape(n_blocks, steps, LANES)
    f_of, c_of = freq.astype(np.uint64), cum[:-1].astype(np.uint64)
    state = np.full((n_blocks, LANES), LOW, dtype=np.uint64)
    words = np.zeros((n_blocks, steps, LANES), dtype=np.uint32)
    sent = np.zeros((n_blocks, steps, LANES), dtype=bool)
    marks: dict[int, np.ndarray] = {}
    shift, scale = np.uint64(63 - SCALE), np.uint64(SCALE)
    for t in range(steps - 1, -1, -1):
        s = lanes[:, t]
        f = f_of[s]
        full = state >= (f << shift)
        sent[:, t] = full
        words[:, t] = state.astype(np.uint32)  # the low half
        state = np.where(full, state >> np.uint64(32), state)
        q = state // f
        state = (q << scale) + (state - q * f) + c_of[s]
        if t % STEPS == 0:
            marks[t] = state.copy()
    out = []
    for b in range(n_blocks):
        stream = words[b][sent[b]].astype("<u4").tobytes()
        before = np.concatenate([[0], np.cumsum(sent[b].sum(axis=1))])
        points = b"".join(struct.pack("<I", before[t]) + marks[t][b].astype("<u8").tobytes() for t in sorted(marks))
        out.append(struct.pack("<III", n, len(marks), len(stream)) + points + stream)
    return out


def counted(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, the number of each id's place among them, and how often each occurs."""
    if not len(flat) or int(flat.max()) >= 1 << 22:
        return np.unique(flat, return_inverse=True, return_counts=True)
    counts = np.bincount(flat)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), dtype=np.int32)
    place[symbols] = np.arange(len(symbols), dtype=np.int32)
    return symbols, place[flat], counts[symbols]


def encode_shard(doc_ids: list, ids: list[bytes]) -> bytes:
    """One shard of the documents' ids, given as little-endian unsigned 32-bit bytes."""
    lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    symbols, sym, counts = counted(flat)
    freq = quantised(counts.astype(np.float64)) if len(symbols) else np.zeros(0, dtype=np.int64)
    cum = np.concatenate([[0], np.cumsum(freq)])
    whole = len(flat) // BLOCK
    blocks = _encode_blocks(sym[: whole * BLOCK].reshape(whole, BLOCK), freq, cum) if whole else []
    if len(flat) > whole * BLOCK:
        blocks += _encode_blocks(sym[whole * BLOCK :].reshape(1, -1), freq, cum)
    blocks = [x + struct.pack("<I", zlib.crc32(flat[i * BLOCK : (i + 1) * BLOCK].tobytes())) for i, x in enumerate(blocks)]
    known = np.array([x is not None for x in doc_ids], dtype=np.int64)
    keys = np.array([x or 0 for x in doc_ids], dtype=np.int64)
    parts = [_packed(np.diff(symbols.astype(np.int64), prepend=0)), _packed(freq), _packed(np.diff(keys, prepend=0)), _packed(known), _packed(lengths)]
    body = struct.pack("<IQI", len(doc_ids), len(flat), len(blocks))
    body += b"".join(struct.pack("<I", len(x)) + x for x in [*parts, *blocks])
    return MAGIC + body + struct.pack("<I", zlib.crc32(body))


def _decode_lanes(blocks: list[bytes], sizes: list[int], freq, cum, slots) -> list[np.ndarray]:
    """Symbol numbers of blocks of one size; every checkpoint of every block is decoded side by side."""
    n = sizes[0]
    steps = -(-n // LANES)
    starts, states, streams, base = [], [], [], 0
    for data in blocks:
        _, marks, size = struct.unpack_from("<III", data)
        at = 12
        for _ in range(marks):
            starts.append(base + struct.unpack_from("<I", data, at)[0])
            states.append(np.frombuffer(data, dtype="<u8", count=LANES, offset=at + 4))
            at += 4 + 8 * LANES
        streams.append(np.frombuffer(data, dtype="<u4", count=size // 4, offset=at))
        base += size // 4
    points = -(-steps // STEPS)
    words = np.concatenate([*streams, np.zeros(LANES, dtype=np.uint32)]).astype(np.uint64)
    pos, state = np.array(starts, dtype=np.int64), np.array(states, dtype=np.uint64)
    out = np.zeros((len(state), STEPS, LANES), dtype=np.uint32)
    f_of, c_of = freq.astype(np.uint64), cum[:-1].astype(np.uint64)
    mask, scale, low = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(LOW)
    last = steps - (points - 1) * STEPS  # steps after a block's last checkpoint
    final = np.arange(len(state)) % points == points - 1
    for t in range(min(STEPS, steps)):
        if t == last and points > 1:
            state, pos, live = state[~final], pos[~final], np.flatnonzero(~final)
        elif t == 0:
            live = np.arange(len(state))
        slot = state & mask
        s = slots[slot]
        out[live, t] = s
        state = f_of[s] * (state >> scale) + slot - c_of[s]
        need = state < low
        rank = np.cumsum(need, axis=1)
        take = words[np.minimum(pos[:, None] + rank - 1, len(words) - 1)]
        state = np.where(need, (state << np.uint64(32)) | take, state)
        pos = pos + rank[:, -1]
    out = out.reshape(len(blocks), points * STEPS * LANES)
    return [out[b, :n] for b in range(len(blocks))]


def decode_shard(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a shard; a checksum that doesn't match raises ValueError."""
    if data[:4] != MAGIC or zlib.crc32(data[4:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a shard, or a damaged one")
    n_docs, n_ids, n_blocks = struct.unpack_from("<IQI", data, 4)
    at, parts = 20, []
    for _ in range(5 + n_blocks):
        (size,) = struct.unpack_from("<I", data, at)
        parts.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    symbols, freq, keys, known, lengths = map(_unpacked, parts[:5])
    symbols, keys = np.cumsum(symbols).astype(np.uint32), np.cumsum(keys)
    cum, blocks = np.concatenate([[0], np.cumsum(freq)]), parts[5:]
    slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    sizes = [struct.unpack_from("<I", x)[0] for x in blocks]
    found, whole = [], sum(x == BLOCK for x in sizes)
    for a, b in [(0, whole), (whole, len(blocks))]:
        if b > a:
            found += _decode_lanes(blocks[a:b], sizes[a:b], freq, cum, slots)
    ids = symbols[np.concatenate(found)] if found else np.zeros(0, dtype=np.uint32)
    for i, x in enumerate(blocks):
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) != struct.unpack("<I", x[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
    return [int(k) if y else None for k, y in zip(keys, known)], lengths, ids


SHARDS = "part int, shard int, first_pos long, n_docs long, n_tokens long, data binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order and write the shards to ``path``.

    One shuffle by ranges of doc_id brings the order.  There are as many ranges as the input has partitions (which follow its
    bytes), and ``spark.sql.shuffle.partitions`` or the cluster's cores at least; a shard is closed by size, so a task never holds more
    than one.
    """
    tokenizer = tokenizer or tokens.default_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def shards(batches):
        enc, keys, ids, n, shard, pos = tokens.encoder(tokenizer, WORD_MEMO), [], [], 0, 0, 0
        part = TaskContext.get().partitionId()
        row = lambda: pd.DataFrame({"part": [part], "shard": [shard], "first_pos": [pos], "n_docs": [len(keys)], "n_tokens": [n], "data": [encode_shard(keys, ids)]})
        for batch in batches:
            for names, texts in tokens.slices(batch):
                for key, got in zip(names, enc.encode(texts)):
                    keys.append(key)
                    ids.append(got + end)
                    n += len(got) // 4 + 1
                    if n >= shard_ids:
                        yield _arrow(row())
                        keys, ids, n, shard, pos = [], [], 0, shard + 1, pos + n
        if keys:
            yield _arrow(row())

    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small = small.withColumn("h", F.xxhash64("text"))  # rows that share a doc_id may be in several ranges
    spark = docs.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.partitions(small))
    ordered = small.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    ordered.mapInArrow(shards, SHARDS).write.parquet(path)


def _arrow(frame: pd.DataFrame):
    import pyarrow as pa

    kinds = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_pos", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])
    return pa.RecordBatch.from_pandas(frame, schema=kinds, preserve_index=False)


DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the shards at ``path``: their place in the whole stream, length and checksum.

    Only one row a partition of the write goes through a window: its count of ids.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    per_part = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = per_part.selectExpr("part", "sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before")
    placed = shards.join(common.sized_broadcast(before), "part").select((F.coalesce("before", F.lit(0)) + F.col("first_pos")).alias("start"), "data")

    def documents(batches):
        import pyarrow as pa

        for batch in batches:
            for at, data in zip(batch.column("start").to_pylist(), batch.column("data").to_pylist()):
                keys, lengths, ids = decode_shard(data)
                raw, ends = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(lengths)])
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ends[:-1] + at, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(documents, DOCS)


def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.work_dir(spark, "rans")
    write_shards(common.table(spark, sf_dir, "documents"), path)
    return read_shards(spark, path)
