"""The three whole jobs: index a library, search it, turn a film into a timeline.  Models and codecs are injected."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright import rules, workspace
from cuewright.functions import text as tx
from cuewright.functions import timecode as tc
from cuewright.operators import assemble, classify, library, retrieval, timeline
from cuewright.operators.retrieval import SearchParams
from cuewright.sources import files, models, riff, sinks


def anchors(spark: SparkSession, encoder: Callable[[], models.TextEncoder]) -> DataFrame:
    """Encoded anchor texts (ord, catid, emb)."""
    rows = rules.table(spark, [(i, c, t) for i, (c, t) in enumerate(rules.ANCHORS)], "ord int, catid string, anchor string")
    return models.encode_texts(rows, "anchor", encoder).select("ord", "catid", "emb")


HEARD = f"{riff.HEADER}, audio_emb array<float>, ok boolean"


def listen(
    content: DataFrame,
    index: DataFrame,
    audio_encoder: Callable[[], models.AudioEncoder],
    decoder: Callable[[], models.Decoder],
    least_seconds: float = 10.0,
    probe: Callable[[str, bytes], float | None] | None = None,
    rate: int = 48000,
    seconds: float = 120.0,
) -> DataFrame:
    """(path, header, audio_emb, ok) of the files of ``content`` (path, content) that ``index`` lacks and that are long enough, written once.

    One pass reads a file's header and, if it is long enough, decodes and encodes it: media bytes are never shuffled where the index's
    paths can be sent to all tasks.  A file that can't be decoded stays, with ``ok`` false.
    """
    held = index.select("path")
    few = len(held.limit(1_000_001).select(F.lit(1)).collect()) <= 1_000_000
    fresh = content.select(library.plain_path(F.col("path")).alias("path"), "content").join(F.broadcast(held) if few else held, "path", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dec, enc = decoder(), audio_encoder()
        for frame in frames:
            rows = []
            for path, data in zip(frame["path"], frame["content"]):
                data = bytes(data or b"")
                told = riff.header_of(path, data, probe)
                if least_seconds > 0 and not (told["duration"] is not None and told["duration"] >= least_seconds):
                    continue
                wave = dec.decode(path, data, rate, seconds)
                ok = wave is not None and len(wave) > 0
                rows.append(told | {"audio_emb": enc.encode([wave])[0].astype("float32") if ok else None, "ok": ok})
            if rows:
                yield pd.DataFrame(rows)

    path = workspace.folder(content.sparkSession, "heard")
    fresh.mapInPandas(run, HEARD).write.parquet(path)
    return content.sparkSession.read.schema(HEARD).parquet(path)


def failed(heard: DataFrame) -> DataFrame:
    """(path, size, duration) of the files of ``listen`` that could not be decoded."""
    return heard.filter("not ok").select("path", "size", "duration")


def index_rows(heard: DataFrame, text_encoder: Callable[[], models.TextEncoder], preset: str = "natural", use_names: bool = True) -> DataFrame:
    """Index rows for the files of ``listen`` that could be decoded."""
    captioned = models.encode_texts(library.captioned(heard.filter("ok")), "caption", text_encoder, "text_emb")
    told = captioned.withColumn("_text", classify.classifier_text(F.col("path"), F.col("embedded"), F.col("caption")))
    told = models.encode_texts(told, "_text", text_encoder, "emb")
    classed = classify.cascade(told, anchors(heard.sparkSession, text_encoder))
    text = F.col("text_emb") if use_names else F.lit(None).cast("array<float>")
    return classed.select("path", "audio_emb", text.alias("text_emb"), "catid", F.col("duration").cast("float").alias("duration"), F.lit(preset).alias("preset"))


def index_library(
    content: DataFrame,
    index: DataFrame,
    text_encoder: Callable[[], models.TextEncoder],
    audio_encoder: Callable[[], models.AudioEncoder],
    decoder: Callable[[], models.Decoder],
    preset: str = "natural",
    least_seconds: float = 10.0,
    use_names: bool = True,
    probe: Callable[[str, bytes], float | None] | None = None,
) -> DataFrame:
    """Index rows for the files of ``content`` (path, content) that ``index`` lacks: ``listen``, then ``index_rows``."""
    library.guard_preset(index, preset)
    return index_rows(listen(content, index, audio_encoder, decoder, least_seconds, probe), text_encoder, preset, use_names)


def search_texts(texts: DataFrame, index: DataFrame, encoder: Callable[[], models.TextEncoder], params: SearchParams = SearchParams()) -> DataFrame:
    """Re-ranked hits for ``texts`` (query_id, query, category); empty queries have none."""
    asked = models.encode_texts(texts.filter("trim(query) <> ''"), "query", encoder, "query_emb")
    return retrieval.smart_search(asked, index, params)


def analyse(scenes: DataFrame, frames: DataFrame, client: Callable[[], models.VlmClient], at_once: int | None = None) -> DataFrame:
    """Analysis rows of scenes that have a frame: ``frames`` (scene_id, image)."""
    told = models.describe_frames(frames.filter("image is not null"), client, at_once).select("scene_id", "parsed")
    joined = scenes.join(told, "scene_id")
    blank = F.col("blank_info.is_blank") if "blank_info" in scenes.columns else F.lit(False)
    return joined.withColumn("silence_required", assemble.silence_required(blank, F.col("parsed.silence_required"))).select(
        "scene_id", "start", "end", "duration", F.col("parsed.category").alias("category"), F.col("parsed.sound_description").alias("sound_description"), "silence_required"
    )


def timelines_of(analysis: DataFrame, videos: DataFrame, index: DataFrame, encoder: Callable[[], models.TextEncoder], created_at: str = "") -> tuple[DataFrame, DataFrame]:
    """(manifests, components) of the analysed scenes of many videos in one job.

    ``analysis``: (video_file, scene_id, start, end, duration, category, sound_description, silence_required); ``videos``: (video_file, fps).
    """
    keys = ("video_file", "scene_id")
    asked = analysis.withColumn("query_id", F.xxhash64(*keys))
    hits = search_texts(asked.select("query_id", F.col("sound_description").alias("query"), "category"), index, encoder, SearchParams(top_k=10))
    lengths = index.select("path", F.when(F.col("duration") > 0, F.col("duration").cast("double")).alias("audio_duration"))
    hits = hits.join(lengths, "path").join(asked.select("query_id", *keys, F.col("duration")), "query_id").select(*keys, "rank", "path", "score", "audio_duration", "duration")
    layer_rows = assemble.layers(hits, keys=keys)
    manifest = assemble.manifests(analysis, layer_rows, videos, created_at)
    loud = layer_rows.join(analysis.filter("not silence_required").select(*keys), list(keys), "left_semi")
    project, rates = tx.project_name(F.col("video_file")).alias("project"), videos.select("video_file", F.col("fps").cast("double").alias("fps"))
    scenes = analysis.join(rates, "video_file").select(project, "scene_id", tc.to_seconds(F.col("start"), tolerant=True).alias("start_sec"), "duration", F.lit(None).cast("int").alias("start_frame"), F.lit(None).cast("int").alias("end_frame"), "fps")
    layers = loud.join(rates, "video_file").select(project, "scene_id", F.col("track").alias("pos"), "track", F.col("source_file").alias("source"), F.col("source_start_offset").alias("source_offset"), "fps")
    return manifest, timeline.track_components(scenes, layers, F.col("fps"))


def timeline_of(analysis: DataFrame, index: DataFrame, encoder: Callable[[], models.TextEncoder], video_file: str, fps: float = 30.0, created_at: str = "") -> tuple[DataFrame, DataFrame]:
    """``timelines_of`` one video."""
    name = F.lit(video_file)
    video = analysis.sparkSession.range(1).select(name.alias("video_file"), F.lit(fps).alias("fps"))
    return timelines_of(analysis.withColumn("video_file", name), video, index, encoder, created_at)


def update_index(spark: SparkSession, folder: str, index_path: str, **how) -> None:
    """Scan a folder and append what is new to the index there."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(x for e in files.AUDIO for x in (e, e.upper())) + "}").load(folder).select("path", "content")
    sinks.write_index(index_library(content, files.index_or_empty(spark, index_path), **how), index_path, append=True)
