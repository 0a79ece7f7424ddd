"""The scene map: scenes joined with model analyses, normalised, with tags and descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as tx
from cuewright.functions import timecode as tc

LAYER = "struct<type:string,description:string,weight:string>"
#: Numbers come as text, so that what is no number takes its default.
ANALYSIS = f"struct<sound_description:string,tags:array<string>,mood:string,environment:string,time_of_day:string,intensity:string,negative_elements:array<string>,primary_focus:string,sound_layers:array<{LAYER}>>"


def last_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last by ``order``."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, order).alias("r")).select("r.*")


def gated(raw: Column) -> Column:
    """An analysis as JSON text: of an error nothing, of an unparsed reply the JSON that can be salvaged from it.

    ``salvage_json`` runs for every row, as Python functions are not skipped inside CASE.
    """
    reply = F.get_json_object(raw, "$.raw_response")
    keys = F.json_object_keys(raw)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    return F.when(has("raw_response"), tx.salvage_json(reply)).when(has("error"), F.lit(None)).otherwise(raw)


def normalised(parsed: Column) -> Column:
    """An analysis (``ANALYSIS``, may be null) with every default filled in and numbers clamped to [0, 1]."""
    word = lambda c: tx.strip(F.coalesce(parsed[c], F.lit("")))
    layer = lambda l: F.struct(
        F.when(tx.strip(F.coalesce(l["type"], F.lit("ambience"))) == "", "ambience").otherwise(tx.strip(F.coalesce(l["type"], F.lit("ambience")))).alias("type"),
        tx.strip(F.coalesce(l["description"], F.lit(""))).alias("description"),
        tx.clamp01(l["weight"], 1.0).alias("weight"),
    )
    layers = F.transform(F.filter(F.coalesce(parsed["sound_layers"], F.array().cast(f"array<{LAYER}>")), lambda l: l.isNotNull()), layer)
    negative = F.transform(F.filter(F.coalesce(parsed["negative_elements"], F.array().cast("array<string>")), lambda x: x != ""), tx.strip)
    return F.struct(
        word("sound_description").alias("sound_description"),
        F.coalesce(parsed["tags"], F.array().cast("array<string>")).alias("tags"),
        *[word(c).alias(c) for c in ("mood", "environment", "time_of_day")],
        tx.clamp01(parsed["intensity"], 0.5).alias("intensity"),
        negative.alias("negative_elements"),
        word("primary_focus").alias("primary_focus"),
        layers.alias("sound_layers"),
    )


def scene_map(scenes: DataFrame, analyses: DataFrame | None = None, frames: DataFrame | None = None, most_tags: int = 10) -> DataFrame:
    """The 21 fields of each scene.

    ``scenes``: (scene_id, start, end, start_frame, end_frame, duration, blank_info); ``analyses``: (scene_id, ord, analysis as JSON text);
    ``frames``: (scene_id, ord, frame_path).  Of rows that repeat a scene the last counts; a scene without rows has defaults.
    """
    out = scenes
    if analyses is not None:
        a = last_of(analyses, "scene_id", "ord").select("scene_id", gated(F.col("analysis")).alias("_raw"))
        out = out.join(a, "scene_id", "left")
    else:
        out = out.withColumn("_raw", F.lit(None).cast("string"))
    if frames is not None:
        out = out.join(last_of(frames, "scene_id", "ord").select("scene_id", "frame_path"), "scene_id", "left")
    else:
        out = out.withColumn("frame_path", F.lit(None).cast("string"))
    out = out.withColumn("_a", normalised(F.from_json("_raw", ANALYSIS)))
    blank = F.coalesce(F.col("blank_info.is_blank"), F.lit(False))
    return out.select(
        "scene_id", "start", "end", "start_frame", "end_frame", "duration", "frame_path",
        tx.description_or_layers(F.col("_a.sound_description"), F.col("_a.sound_layers")).alias("sound_description"),
        tx.tags(F.col("_a.tags"), most_tags).alias("tags"),
        *[F.col(f"_a.{c}").alias(c) for c in ("mood", "environment", "time_of_day", "intensity", "negative_elements", "primary_focus", "sound_layers")],
        F.col("duration").alias("target_duration"),
        tc.duration_flexibility(F.col("duration")).alias("duration_flexibility"),
        (F.col("duration") > 5).alias("loop_acceptable"),
        blank.alias("is_blank"),
        "blank_info",
    )
