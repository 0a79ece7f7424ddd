"""Helpers that the corpus operators share: inputs, a shared working folder, holdout folds, joins on hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.operators import blocks

SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _work_root(spark: SparkSession) -> str:
    """A folder below ``spark.checkpoint.dir``.  A session without one gets a folder of its own in local mode, where driver and tasks
    are one process; on a cluster that is an error, as executors could not read each other's folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        root = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/cuewright/{spark.sparkContext.applicationId}"


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{_work_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Remove this application's tables between steps, once no result that reads them is needed any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_work_root(spark))
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote and that no result reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/cuewright/" in folder:
                place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in no fold (null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def hashed_sample(df: DataFrame, key: Column, rows: int, seed: int = 17) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of ``key``: the same rows on every run.

    The expected size is the bound; it only limits what a classifier is fitted on.
    """
    n = df.count()
    if n <= rows:
        return df
    keep = int(rows / n * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < keep)


def is_small(df: DataFrame, rows: int = 200_000) -> bool:
    return len(df.limit(rows + 1).select(F.lit(1)).collect()) <= rows


def sized_broadcast(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; without, else (a shuffle join).  For narrow rows."""
    return F.broadcast(df) if is_small(df, rows) else df


def spread_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``left`` joined with the narrow ``right`` on equal or null-safe-equal ``on``, where many rows of ``left`` may share a key.

    A small ``right`` (counted) is broadcast.  Else rows of a key are split by a hash of ``spread`` (columns of ``left``), and ``right`` is there for each
    part.  Columns of ``right`` other than ``on`` must not be columns of ``left``.
    """
    if is_small(right):
        right, keys = F.broadcast(right), list(on)
    else:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys = [*on, "_salt"]
    renamed = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
    same = None
    for c in keys:
        one = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        same = one if same is None else same & one
    return left.join(renamed, same, how).drop("_salt", *(f"_r_{c}" for c in keys))


spread = blocks.spread


def tidy() -> None:
    """Give memory that a task no longer uses back to the system: workers live on between tasks, beside a large JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
