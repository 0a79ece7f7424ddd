"""Writers: index, JSON records, nested manifests, component tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_index(rows: DataFrame, path: str, append: bool = False) -> None:
    """A library index as Parquet; text vectors are null row by row."""
    rows.write.mode("append" if append else "overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are kept as fields."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """One file with an array of all rows in ``order``: for the records of one video, which are few."""
    row = F.struct(*df.columns)
    listed = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), row.alias("r")))).alias("l")).select(F.to_json(F.transform("l", lambda x: x["r"]), {"ignoreNullFields": "false"}).alias("value"))
    listed.coalesce(1).write.mode("overwrite").text(path)


def write_json_arrays(df: DataFrame, path: str, by: str, order: str) -> None:
    """An array of the rows of each ``by`` in ``order``, in a folder of its own: the records of many videos in one job."""
    row = F.struct(*[c for c in df.columns if c != by])
    listed = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), row.alias("r")))).alias("l"))
    listed.select(by, F.to_json(F.transform("l", lambda x: x["r"]), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def write_keyed_arrays(df: DataFrame, path: str, by: str, order: str) -> None:
    """As ``write_json_arrays``, but a line of JSON for each ``by``, with its value and the array ``rows``: a few files, however many videos there are."""
    row = F.struct(*[c for c in df.columns if c != by])
    listed = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), row.alias("r")))).alias("l"))
    listed.select(F.to_json(F.struct(by, F.transform("l", lambda x: x["r"]).alias("rows")), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_json_objects(df: DataFrame, path: str, by: str) -> None:
    """One JSON object in a folder of its own for each row; ``by`` names it (and is read back as a column)."""
    row = F.struct(*[c for c in df.columns if c != by])
    df.select(by, F.to_json(row, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def write_components(components: DataFrame, path: str) -> None:
    """Timeline components, a folder for each project."""
    components.write.mode("overwrite").partitionBy("project").parquet(path)


def write_frames(frames: DataFrame, path: str) -> None:
    """Frames (name, image) as a table of names and bytes; ``frame_name`` gives the names."""
    frames.select("name", "image").write.mode("overwrite").parquet(path)


def frame_name(scene_id, which=None):
    """``scene_01.jpg``, or ``scene_01_mid.jpg`` with a part's name."""
    return F.format_string("scene_%02d.jpg", scene_id) if which is None else F.format_string("scene_%02d_%s.jpg", scene_id, which)


def edit_list(components: DataFrame, fps: float = 30.0) -> DataFrame:
    """Clips as lines of a CMX3600-style edit list (project, track, line), for tools that read no tables."""
    code = lambda f: F.format_string("%02d:%02d:%02d:%02d", F.floor(f / (3600 * n)), F.floor(f / (60 * n)) % 60, F.floor(f / n) % 60, f % n)
    n = int(round(fps))
    a, b = F.coalesce("source_start", F.lit(0)), F.col("start_frame")
    line = F.format_string("%03d  AX       A%d    C        %s %s %s %s", "seq", "track", code(a), code(a + F.col("length")), code(b), code(b + F.col("length")))
    return components.filter("kind = 'Clip'").select("project", "track", "seq", line.alias("line"), F.col("source").alias("clip_name"))
