"""The library index: incremental selection of new files, duration filter, append, preset guard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as tx

NO_DURATION = -1.0


def plain_path(path):
    """A path without the scheme that file listings put before it."""
    return F.regexp_replace(path, "^file:/+", "/")


def new_files(found: DataFrame, index: DataFrame) -> DataFrame:
    """Files (path, ...) that the index does not hold."""
    return found.join(index.select("path"), "path", "left_anti")


def long_enough(files: DataFrame, least: float = 10.0) -> DataFrame:
    """Files of known duration of ``least`` seconds or more; with ``least`` 0 all of them."""
    return files.filter(F.col("duration") >= least) if least > 0 else files


def guard_preset(index: DataFrame, preset: str) -> None:
    """Refuse to update an index that was made with another preset."""
    other = index.filter(F.col("preset") != preset).select("preset").limit(1).collect()
    if other:
        raise ValueError(f"the index was made with preset {other[0]['preset']!r}, not {preset!r}")


def extended(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index and the new rows; a column that one lacks is null there, an unknown duration is -1."""
    both = index.unionByName(rows, allowMissingColumns=True)
    return both.withColumn("duration", F.coalesce("duration", F.lit(NO_DURATION)))


def counts(found: DataFrame, index: DataFrame, least: float = 10.0) -> DataFrame:
    """One row: files found, new, too short or unknown, kept."""
    fresh = found.join(index.select("path", F.lit(True).alias("_held")), "path", "left")
    new = F.col("_held").isNull()
    ok = F.coalesce(F.col("duration") >= least, F.lit(False)) if least > 0 else F.lit(True)
    return fresh.agg(F.count(F.lit(1)).alias("found"), F.count_if(new).alias("new"), F.count_if(new & ~ok).alias("skipped"), F.count_if(new & ok).alias("kept"))


def captioned(files: DataFrame) -> DataFrame:
    embedded = F.col("embedded") if "embedded" in files.columns else F.lit(None).cast("string")
    return files.withColumn("caption", tx.caption(F.col("path"), embedded))
