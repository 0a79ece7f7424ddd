"""Assembly: diverse layers for each scene, source offsets, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions import text as tx
from cuewright.functions import timecode as tc

LEAD_IN = 10.0


def layer_confidence(score: Column) -> Column:
    return F.when(score > 0.25, "high").when(score > 0.18, "medium").otherwise("low")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that is a function of the keys, so that reruns agree."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_offset(audio: Column, clip: Column, u: Column, lead_in: float = LEAD_IN) -> Column:
    """Where a clip starts in its source: anywhere behind the lead-in if there is room for it, else centred, else 0."""
    free = audio - clip
    spread = F.lit(lead_in) + u * (free - F.lit(lead_in))
    return F.round(F.when(audio > clip + lead_in, spread).when(audio > clip, free / 2).otherwise(F.lit(0.0)), 3)


def diverse_layers(hits: DataFrame, most: int = 3, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Of each scene's hits (``keys``, rank, path, score, audio_duration, duration) the first ``most`` with unlike names, as tracks 1, 2, 3.

    A hit without a duration is skipped and does not keep its name from others.
    """
    usable = hits.filter("audio_duration is not null and audio_duration <> 0").withColumn("sim_key", tx.similarity_key(F.col("path")))
    first = Window.partitionBy(*keys, "sim_key").orderBy("rank", "path")
    kept = usable.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    track = F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "path"))
    return kept.withColumn("track", track).filter(F.col("track") <= most)


def layers(hits: DataFrame, most: int = 3, u: Column | None = None, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Manifest layers, one row each."""
    chosen = diverse_layers(hits, most, keys)
    start = source_offset(F.col("audio_duration"), F.col("duration"), uniform(*map(F.col, keys), F.col("path")) if u is None else u)
    return chosen.withColumn("source_start_offset", start).select(
        *keys, "track",
        F.format_string("Match #%d", "track").alias("layer_name"), F.lit("top3").alias("layer_type"),
        F.col("path").alias("source_file"), "source_start_offset",
        F.round(F.col("source_start_offset") + F.col("duration"), 3).alias("source_end_offset"),
        "audio_duration", F.round("duration", 3).alias("clip_duration"), F.round("score", 4).alias("score"),
        layer_confidence(F.col("score")).alias("confidence"), F.lit("ok").alias("status"),
        (F.col("source_start_offset") + F.col("duration") > F.col("audio_duration")).alias("beyond_media"),
    )


LAYER_FIELDS = ["track", "layer_name", "layer_type", "source_file", "source_start_offset", "source_end_offset", "audio_duration", "clip_duration", "score", "confidence", "status"]


def manifest_scenes(scenes: DataFrame, layer_rows: DataFrame, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """``scenes`` (``keys``, start, end, duration, category, sound_description, silence_required) with their layers as an array; silent ones have none."""
    grouped = layer_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*LAYER_FIELDS))).alias("_l"))
    joined = scenes.join(grouped, list(keys), "left")
    none = F.slice("_l", 1, 0)
    silent = F.coalesce("silence_required", F.lit(False))
    held = F.when(~silent & F.col("_l").isNotNull(), F.col("_l")).otherwise(F.coalesce(none, F.from_json(F.lit("[]"), dict(joined.dtypes)["_l"])))
    return joined.select(*keys, F.col("start").alias("timeline_start"), F.col("end").alias("timeline_end"), "duration", "category", "sound_description", silent.alias("silence_required"), held.alias("layers"))


def manifests(scenes: DataFrame, layer_rows: DataFrame, videos: DataFrame, created_at: str = "", version: str = "1") -> DataFrame:
    """One nested row for each video's timeline, with its totals (``scenes_with_sound`` counts layers, ``scenes_with_layers`` scenes).

    ``videos``: (video_file, fps); scenes and layers have a ``video_file`` too.  A video without scenes has none in its row.  A manifest is one
    record by nature, so its scenes meet in one task; videos don't.
    """
    rows = manifest_scenes(scenes, layer_rows, ("video_file", "scene_id"))
    names = [c for c in rows.columns if c != "video_file"]
    agg = rows.groupBy("video_file").agg(
        F.count(F.lit(1)).cast("int").alias("total_scenes"),
        F.sum(F.size("layers")).cast("int").alias("scenes_with_sound"),
        F.count_if(F.size("layers") > 0).cast("int").alias("scenes_with_layers"),
        F.count_if("silence_required").cast("int").alias("silent_scenes"),
        F.array_sort(F.collect_list(F.struct(*names))).alias("scenes"),
    )
    joined = videos.select("video_file", F.col("fps").cast("double").alias("video_fps")).join(agg, "video_file", "left")
    totals = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total_scenes", "scenes_with_sound", "scenes_with_layers", "silent_scenes")]
    listed = F.coalesce("scenes", F.from_json(F.lit("[]"), dict(agg.dtypes)["scenes"])).alias("scenes")
    return joined.select(tx.project_name(F.col("video_file")).alias("project_name"), F.lit(created_at).alias("created_at"), "video_file", "video_fps", F.lit(version).alias("pipeline_version"), *totals, listed)


def manifest(scenes: DataFrame, layer_rows: DataFrame, video_file: str, fps: float, created_at: str = "", version: str = "1") -> DataFrame:
    """``manifests`` of one video."""
    name = F.lit(video_file)
    video = scenes.sparkSession.range(1).select(name.alias("video_file"), F.lit(fps).alias("fps"))
    return manifests(scenes.withColumn("video_file", name), layer_rows.withColumn("video_file", name), video, created_at, version)


def silence_required(is_blank: Column, parsed: Column) -> Column:
    """A blank scene is silent whatever the model says."""
    return F.when(F.coalesce(is_blank, F.lit(False)), True).otherwise(F.coalesce(parsed, F.lit(False)))


def results_of(scenes: DataFrame, hits: DataFrame, key: str = "scene_id") -> DataFrame:
    """``scenes`` with the hits (nested, from ``retrieval.nested``) of their key, an empty array without any.

    With ``key='description'``, scenes of equal text share the hits of the last of them.
    """
    if key == "description":
        shared = scenes.join(hits, "scene_id").groupBy("sound_description").agg(F.max_by("results", "scene_id").alias("results"))
        joined = scenes.join(shared, "sound_description", "left")
    else:
        joined = scenes.join(hits, key, "left")
    return joined.withColumn("results", F.coalesce("results", F.from_json(F.lit("[]"), dict(joined.dtypes)["results"])))
