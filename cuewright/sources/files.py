"""File listings and JSON, text and Parquet readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright import schemas
from cuewright.operators.library import NO_DURATION, plain_path

AUDIO = ("wav", "mp3", "flac", "aif", "aiff", "ogg", "m4a")
VIDEO = ("mp4", "mov", "avi", "mkv")


def listing(spark: SparkSession, folder: str, extensions: tuple[str, ...], recursive: bool = True, folders: bool = False) -> DataFrame:
    """(path, size) of files whose extension is all lower or all upper case; contents are not read.

    With ``folders``, of entries of ``folder`` itself: one that is a folder (a table in parts, say) counts as one file, with the size of all files in it.
    Spark's listing skips names that start with ``_`` or ``.``.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive or folders).lower())
    if folders:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        root = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/") + "/"
        entry = F.element_at(F.split(F.substr("path", F.lit(len(root) + 1)), "/"), 1)
        ends = F.element_at(F.split(entry, r"\."), -1)
        held = read.load(folder).select(entry.alias("_entry"), "length").filter(entry.contains(".") & ends.isin(*[x for e in extensions for x in (e, e.upper())]))
        return held.groupBy("_entry").agg(F.sum("length").alias("size")).select(plain_path(F.concat(F.lit(root), "_entry")).alias("path"), "size")
    names = ",".join(x for e in extensions for x in (e, e.upper()))
    found = read.option("pathGlobFilter", f"*.{{{names}}}").load(folder)
    return found.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("size")).dropDuplicates(["path"])


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder, AUDIO).orderBy("path")


def video_files(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder, VIDEO, recursive=False).orderBy("path")


def model_files(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, path, size, is_projector) of model files, for ``classify.rank_models``."""
    found = listing(spark, folder, ("gguf",))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return found.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "path", "size", name.contains("mmproj").alias("is_projector"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """A library index; columns that it lacks are null, the preset ``natural``, an unknown duration -1."""
    df = spark.read.parquet(path)
    have = set(df.columns)
    col = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    return df.select(
        "path", col("audio_emb", "array<float>"), col("text_emb", "array<float>"), col("catid", "string"),
        F.coalesce(col("duration", "float"), F.lit(NO_DURATION)).alias("duration"), F.coalesce(col("preset", "string"), F.lit("natural")).alias("preset"),
    )


def index_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """``index``, or no rows where there is none yet."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return index(spark, path) if place.getFileSystem(conf).exists(place) else spark.createDataFrame([], schemas.LIBRARY)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files that hold an array or one object; what does not fit a field is null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def scenes(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, schemas.SCENES)


def keyed_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scenes of lines that each hold a ``video_id`` and its array ``rows`` (``sinks.write_keyed_arrays``)."""
    fields = schemas.SCENES.removeprefix("video_id string, ")
    return spark.read.schema(f"video_id string, rows array<struct<{fields}>>").json(path).select("video_id", F.inline("rows"))


def metadata(spark: SparkSession, path: str, fps_default: float = 30.0) -> DataFrame:
    return json_rows(spark, path, schemas.METADATA).withColumn("fps", F.coalesce("fps", F.lit(fps_default)))


def analyses(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, ord, analysis): descriptions whose analysis stays JSON text, as its keys matter."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("ord", "r"))
    return rows.select(F.get_json_object("r", "$.scene_id").cast("int").alias("scene_id"), "ord", F.get_json_object("r", "$.openrouter_analysis").alias("analysis"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, schemas.MANIFEST)


def query_lines(spark: SparkSession, path: str) -> DataFrame:
    """(query): lines of a text file without the blank ones."""
    line = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return spark.read.text(path).select(line.alias("query")).filter("query <> ''")
