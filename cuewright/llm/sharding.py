"""Op 7 [native]: placement in shards by a permutation-filled lookup table (as in Maglev hashing).

Each shard has its own permutation of a table with a prime number of slots (an offset and a
skip from its name's hash).  The shards take turns; at its turn a shard claims the first slot of
its permutation that is still free, ``weight`` times over.  The finished table is a constant of
``slots`` numbers whatever the data's size, and is broadcast: a document's hash gives its slot,
a hash join its shard.  Adding or removing a shard moves few documents beyond those it must.

The main path is DataFrame functions only.  Nothing is shuffled, so no key can be hot; rows
without a doc_id are dealt by a hash of their text, so that many of them don't meet in a shard.

Defined results: a null doc_id is placed by its text, without either at the hash of the empty
string; rows that repeat a doc_id share its shard; columns ``slot`` and ``shard`` are replaced, others pass through whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARDS = 64
SLOTS_PER_SHARD = 100


def _prime_from(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], slots: int | None = None, weights: list[int] | None = None) -> list[int]:
    """For each slot the number of the shard that claimed it."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need distinct names, one at least")
    slots, weights = slots or _prime_from(max(2, SLOTS_PER_SHARD * len(names))), weights or [1] * len(names)
    if _prime_from(slots) != slots or slots < len(names) or min(weights) < 0 or not any(weights):
        raise ValueError("the number of slots must be a prime, no less than the shards; weights are 0 or more, not all 0")
    at = [_hash(f"offset {x}") % slots for x in names]
    skip = [1 + _hash(f"skip {x}") % (slots - 1) for x in names]
    table, free = [-1] * slots, slots
    while free:
        for k, turns in enumerate(weights):
            for _ in range(min(turns, free)):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % slots
                table[at[k]] = k
                free -= 1
    return table


def slot_of(slots: int, doc_id: Column, text: Column) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, names: list[str], slots: int | None = None, weights: list[int] | None = None) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (columns of these names are replaced)."""
    table = lookup_table(names, slots, weights)
    claimed = docs.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(table)), "array<int>")).alias("slot", "shard"))
    placed = docs.drop("slot", "shard").withColumn("slot", slot_of(len(table), F.col("doc_id"), F.col("text")))
    return placed.join(F.broadcast(claimed), "slot", "left")


def write_sharded(docs: DataFrame, path: str, names: list[str], slots: int | None = None, files: int = 1) -> None:
    """Write ``docs`` as Parquet, a folder for each shard with about ``files`` files.

    One shuffle brings a shard's rows together, split by a hash of the document into ``files`` parts, so that the number of files
    doesn't follow that of tasks.
    """
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files))
    placed = place(docs, names, slots).drop("slot")
    placed.repartition(len(names) * files, "shard", part).write.partitionBy("shard").parquet(path)


NAMES = [f"shard-{k:03d}" for k in range(SHARDS)]


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = place(docs, NAMES).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return placed.select(F.col("doc_id").cast("long").alias("doc_id"), "slot", "shard", "n_bytes")


SQL = f"""
WITH t AS (SELECT cast([{", ".join(map(str, lookup_table(NAMES)))}] AS INTEGER[]) AS shards),
d AS (
  SELECT doc_id, text, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(text), '')), 1, 15))::BIGINT % {_prime_from(SLOTS_PER_SHARD * SHARDS)})::INTEGER AS slot
  FROM documents
)
SELECT doc_id, slot, shards[slot + 1] AS shard, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM d, t
"""
