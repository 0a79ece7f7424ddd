"""The library index kept up to date from a stream of new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuewright.operators import library
from cuewright.sources import files, sinks


def file_stream(spark: SparkSession, folder: str, schema: str = "path string, duration double") -> DataFrame:
    """A stream of Parquet files that list new media (path, duration, ...)."""
    return spark.readStream.schema(schema).parquet(folder)


def media_stream(spark: SparkSession, folder: str, pattern: str = "*.{wav,WAV}") -> DataFrame:
    """A stream of the media files themselves (path, content)."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def keep_indexed(stream: DataFrame, index_path: str, checkpoint: str, rows_of: Callable[[DataFrame], DataFrame], preset: str, least: float = 10.0):
    """Start a query that appends to the index what each micro-batch brings, then stops when the input is used up.

    Files that the index holds, and files that are too short, are left out; ``rows_of`` turns the rest into index rows.  A batch that is
    run again after a failure finds its files in the index, so nothing is added twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        held = files.index_or_empty(batch.sparkSession, index_path)
        library.guard_preset(held, preset)
        fresh = library.new_files(library.long_enough(batch, least).dropDuplicates(["path"]), held)
        sinks.write_index(rows_of(fresh), index_path, append=True)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
