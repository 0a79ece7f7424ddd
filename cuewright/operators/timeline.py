"""Timeline operators: scene folds, blank statistics, cut detection, gap-filled tracks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuewright.config import Detection
from cuewright.functions import timecode as tc
from cuewright.functions import vector as vx

SCENE = "struct<start_ms:long,end_ms:long,start_frame:long,end_frame:long,duration:double,is_blank:boolean>"


def _in_order(df: DataFrame, order: list[str], step: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """``step`` over the rows of each partition, which holds whole videos in order: one pass, whose state is what ``step`` keeps.

    For folds, whose next row depends on what became of the rows before.  Rows stream, so a long video is never held as a whole.
    """
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, held = to_arrow_schema(schema), []
        for row in step(row for batch in batches for row in batch.to_pylist()):
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pylist(held, kinds)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)

    return df.repartition("video_id").sortWithinPartitions("video_id", *order).mapInArrow(run, schema)


def _fold(scenes: DataFrame, joins: Callable[[dict, dict], bool]) -> DataFrame:
    """Runs of scenes of each ``video_id`` joined while ``joins(current, next)`` holds, renumbered from 1.

    ``scenes``: (video_id, scene_id, start_ms, end_ms, start_frame, end_frame, is_blank, and any numbers ``joins`` asks for).  The columns other than
    times and frames are those of the first scene of a run.
    """

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        run = None
        for row in rows:
            if run is not None and row["video_id"] == run["video_id"] and joins(run, row):
                run |= {c: row[c] for c in ("end_ms", "end_frame") if c in row}
                continue
            number = 1
            if run is not None:
                yield run
                number = run["scene_id"] + 1 if row["video_id"] == run["video_id"] else 1
            run = row | {"scene_id": number}
        if run is not None:
            yield run

    return _in_order(scenes, ["start_ms", "scene_id"], step)


def merge_short(scenes: DataFrame, least_ms: int = 500, keep_blank: bool = True, strict: bool = False) -> DataFrame:
    """Scenes shorter than ``least_ms`` run on into the next; the last one may stay short.

    With ``keep_blank`` a blank scene is not run on, but it may be swallowed by a short one before it; ``strict`` keeps that from happening.
    """

    def joins(cur: dict, nxt: dict) -> bool:
        short = cur["end_ms"] - cur["start_ms"] < least_ms
        return short and not (keep_blank and cur["is_blank"]) and not (strict and nxt["is_blank"])

    return _fold(scenes, joins)


def merge_similar(scenes: DataFrame, feature: str, similar: float = 0.85) -> DataFrame:
    """Neighbours run together while neither is blank and 1 - |difference of ``feature``| is at least ``similar``.

    The run keeps the feature of its first scene.  ``merge_similar_frames`` compares sampled frames instead.
    """
    return _fold(scenes, lambda cur, nxt: not cur["is_blank"] and not nxt["is_blank"] and 1 - abs(cur[feature] - nxt[feature]) >= similar)


def similarity(a: Column, b: Column) -> Column:
    """``histogram_similarity`` of two arrays of histograms, as a column."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: vx.pearson(x, y))))
    return F.coalesce(F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x), F.size(pairs)), F.lit(0.0))


def histogram_similarity(a: list[list[float]], b: list[list[float]]) -> float:
    """Mean Pearson correlation of all pairs of histograms; 0.0 where a side is empty or flat."""
    import numpy as np

    values = []
    for x in a:
        for y in b:
            x_, y_ = np.asarray(x) - np.mean(x), np.asarray(y) - np.mean(y)
            norm = float(np.sqrt((x_ * x_).sum() * (y_ * y_).sum()))
            values.append(float((x_ * y_).sum()) / norm if norm else 0.0)
    return float(np.mean(values)) if values else 0.0


def _centred(histograms: list) -> list[tuple]:
    """Each histogram less its mean, with the sum of its squares."""
    import numpy as np

    if len({len(h) for h in histograms}) == 1:
        c = np.array(histograms, dtype=np.float64)
        c -= c.mean(axis=1, keepdims=True)
        return list(zip(c, (c * c).sum(axis=1).tolist()))
    return [(c, float((c * c).sum())) for c in (np.asarray(h, dtype=np.float64) - np.mean(h) for h in histograms)]


def merge_similar_frames(scenes: DataFrame, frames: DataFrame, similar: float = 0.85, samples: int = 3) -> DataFrame:
    """``merge_similar`` in its general form: ``frames`` (video_id, at_ms, histogram) are sampled anew over each grown run.

    A video's frames come before its scenes in one sorted partition, and are what is held of it.
    """
    kind = dict(scenes.dtypes)["video_id"]
    names = ["video_id", "scene_id", "start_ms", "end_ms", "start_frame", "end_frame", "is_blank"]
    schema = StructType.fromDDL(f"video_id {kind}, scene_id int, start_ms long, end_ms long, start_frame long, end_frame long, is_blank boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left
        from functools import cache

        import numpy as np
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, out = to_arrow_schema(schema), []

        @cache
        def places(n: int) -> list[int]:
            return np.unique(np.linspace(0, n - 1, samples).round().astype(int)).tolist()

        def sampled(a: int, b: int) -> list:
            low = bisect_left(at, a)
            n = bisect_left(at, b) - low
            return [told[low + i] for i in places(n)] if n > 0 else []

        def alike(x: list, y: list) -> float:
            """``histogram_similarity`` of centred histograms."""
            total = 0.0
            for c, s in x:
                for d, t in y:
                    norm = (s * t) ** 0.5
                    total += float(c.dot(d)) / norm if norm else 0.0
            return total / (len(x) * len(y)) if x and y else 0.0

        video, at, hist, told, cur = (), [], [], None, None
        for batch in batches:
            for key, is_scene, when, scene_id, end_ms, start_frame, end_frame, blank, histogram in zip(*(c.to_pylist() for c in batch.columns)):
                if (key,) != video:
                    if cur:
                        out.append(cur)
                    video, at, hist, told, cur = (key,), [], [], None, None
                if not is_scene:
                    at.append(when)
                    hist.append(histogram)
                    continue
                if told is None:
                    told = _centred(hist)
                if cur and not cur[6] and not blank and alike(sampled(cur[2], cur[3]), sampled(when, end_ms)) >= similar:
                    cur[3], cur[5] = end_ms, end_frame
                    continue
                number = 1
                if cur:
                    out.append(cur)
                    number = cur[1] + 1
                cur = [key, number, when, end_ms, start_frame, end_frame, blank]
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), kinds)], schema=kinds)
                    out = []
        if cur:
            out.append(cur)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), kinds)], schema=kinds)

    cols = scenes.select(*names[:6], F.coalesce("is_blank", F.lit(False)).alias("is_blank"))
    left = cols.select("video_id", F.lit(True).alias("is_scene"), F.col("start_ms").alias("at"), "scene_id", "end_ms", "start_frame", "end_frame", "is_blank")
    right = frames.select("video_id", F.lit(False).alias("is_scene"), F.col("at_ms").alias("at"), "histogram")
    spark = scenes.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a given number, so that few bytes don't end in few tasks
    # by a number of its own: where both sides come partitioned by video, Spark would leave this shuffle out, and then join each side's partitions unlike
    both = left.unionByName(right, allowMissingColumns=True).repartitionById(parts, F.pmod(F.xxhash64("video_id"), F.lit(parts)).cast("int")).sortWithinPartitions("video_id", "is_scene", "at", "scene_id")
    return both.mapInArrow(run, schema)


def blank_marks(frames: DataFrame, black: float = 25.0, white: float = 225.0) -> DataFrame:
    """``frames`` (a frame's statistics) with is_black, is_white and is_color_blank."""
    c = F.col
    plain = (c("std_brightness") < 10) & (c("edge_density") < 0.005)
    is_black = (c("p_black") > 0.98) | ((c("mean_brightness") < black) & plain)
    is_white = (c("p_white") > 0.98) | ((c("mean_brightness") > white) & plain)
    flat = (c("uniform_ratio") > 0.97) & (c("color_std") < 10) & (c("edge_density") < 0.004) & (c("lap_var") < 18)
    marked = frames.withColumn("is_black", F.coalesce(is_black, F.lit(False))).withColumn("is_white", F.coalesce(is_white, F.lit(False)))
    return marked.withColumn("is_color_blank", ~F.col("is_black") & ~F.col("is_white") & F.coalesce(flat, F.lit(False)))


def blank_statistics(frames: DataFrame, keys: list[str] = ["video_id", "scene_id"]) -> DataFrame:
    """Blank statistics of each scene; ``frames`` has a row for each requested sample (sample_no, read_ok, statistics).

    A frame that is black and white at once counts twice, and samples that could not be read count in the ratio's denominator.
    """
    ok = F.coalesce(F.col("read_ok"), F.lit(True))
    m = blank_marks(frames).withColumn("_ok", ok)
    one = lambda x: F.sum(F.when(F.col("_ok") & x, 1).otherwise(0))
    last = lambda c: F.coalesce(F.max_by(c, F.when(F.col("_ok"), F.col("sample_no"))), F.lit(0.0)).alias(f"{c}_last")
    agg = m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples_checked"),
        one(F.col("is_black")).alias("_black"),
        one(F.col("is_white")).alias("_white"),
        one(F.col("is_color_blank")).alias("_color"),
        F.coalesce(F.avg(F.when(F.col("_ok"), F.col("mean_brightness"))), F.lit(0.0)).alias("brightness"),
        *[last(c) for c in ("edge_density", "lap_var", "color_std", "p_white", "p_black", "uniform_ratio")],
    )
    ratio = (F.col("_black") + F.col("_white") + F.col("_color")) / F.col("samples_checked")
    out = agg.withColumn("blank_ratio", ratio).withColumn("is_blank", F.col("blank_ratio") >= 0.6)
    out = out.withColumn("is_black", F.col("is_blank") & (F.col("_black") > F.col("_white"))).withColumn("is_white", F.col("is_blank") & (F.col("_white") > F.col("_black")))
    return out.withColumn("is_color", F.col("is_blank") & ~F.col("is_black") & ~F.col("is_white")).drop("_black", "_white", "_color")


def blank_info(stats: DataFrame, keys: list[str] = ["video_id", "scene_id"]) -> DataFrame:
    """``blank_statistics`` as the nested record that scenes carry."""
    metrics = F.struct(F.col("brightness").alias("mean_brightness"), *[f"{c}_last" for c in ("edge_density", "lap_var", "color_std", "p_white", "p_black", "uniform_ratio")])
    return stats.select(*keys, F.struct("is_blank", "is_black", "is_white", "is_color", "brightness", "blank_ratio", "samples_checked", metrics.alias("metrics")).alias("blank_info"))


def with_blank_info(scenes: DataFrame, info: DataFrame, keys: list[str] = ["video_id", "scene_id"]) -> DataFrame:
    """``scenes`` with the ``blank_info`` record of their keys; a scene without one has null, which counts as not blank."""
    return scenes.join(info.select(*keys, "blank_info"), keys, "left")


def merge_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(video_id, before, after, merged): how many scenes each video had, has, and has lost to merging."""
    n = lambda df, name: df.groupBy("video_id").agg(F.count(F.lit(1)).alias(name))
    return n(before, "before").join(n(after, "after"), "video_id", "left").withColumn("after", F.coalesce("after", F.lit(0))).withColumn("merged", F.col("before") - F.col("after"))


def frame_differences(frames: DataFrame, value: str = "value") -> DataFrame:
    """Threshold that each video's frame-to-frame differences recommend; 12 without any."""
    order = Window.partitionBy("video_id").orderBy("frame_no")
    diffs = frames.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(order)))
    out = diffs.groupBy("video_id").agg(F.avg("_d").alias("mean_diff"), F.stddev_pop("_d").alias("std_diff"))
    m, s = F.col("mean_diff"), F.col("std_diff")
    # a population deviation of one difference is 0
    return out.withColumn("threshold", F.when(m.isNull(), 12).when((m < 5) & (s < 3), 16).when((m > 25) | (s > 10), 10).otherwise(12))


def adaptive_cuts(frames: DataFrame, window: int = 2, ratio: float = 3.0, least: float = 15.0, min_len: int = 15, value: str = "value") -> DataFrame:
    """Cuts (video_id, frame_no): frames whose score is ``least`` or more and ``ratio`` times the mean of ``window`` neighbours on both sides.

    A cut closer than ``min_len`` frames to the one kept before it is left out (in order, in one pass over a video's candidates).
    """
    order = Window.partitionBy("video_id").orderBy("frame_no")
    around = order.rowsBetween(-window, window)
    n, total = F.count(value).over(around), F.sum(value).over(around)
    near = (total - F.col(value)) / (n - 1)
    scored = frames.withColumn("_n", n).withColumn("_near", near)
    hit = scored.filter((F.col("_n") == 2 * window + 1) & (F.col(value) >= least) & ((F.col("_near") < 1e-5) | (F.col(value) / F.col("_near") >= ratio)))

    def apart(rows: Iterator[dict]) -> Iterator[dict]:
        last = None
        for row in rows:
            if last is None or row["video_id"] != last["video_id"] or row["frame_no"] - last["frame_no"] >= min_len:
                last = row
                yield row

    return _in_order(hit.select("video_id", "frame_no"), ["frame_no"], apart)


def threshold_cuts(frames: DataFrame, threshold: float = 27.0, value: str = "value") -> DataFrame:
    """Cuts where the score reaches ``threshold``, coming from below it."""
    order = Window.partitionBy("video_id").orderBy("frame_no")
    before = F.coalesce(F.lag(value).over(order), F.lit(0.0))
    return frames.withColumn("_b", before).filter((F.col(value) >= threshold) & (F.col("_b") < threshold)).select("video_id", "frame_no")


def fade_cuts(frames: DataFrame, threshold: float = 12.0, value: str = "brightness") -> DataFrame:
    """Cuts in the middle of fades through black: of each run of frames below ``threshold`` that light frames enclose."""
    order = Window.partitionBy("video_id").orderBy("frame_no")
    dark = (F.col(value) < threshold).cast("int")
    turned = frames.withColumn("_d", dark).withColumn("_run", F.sum(F.when(F.col("_d") != F.coalesce(F.lag("_d").over(order), F.lit(-1)), 1).otherwise(0)).over(order))
    runs = turned.groupBy("video_id", "_run").agg(F.max("_d").alias("d"), F.min("frame_no").alias("a"), F.max("frame_no").alias("b"))
    last = F.max("_run").over(Window.partitionBy("video_id"))
    inner = runs.withColumn("_last", last).filter("d = 1 and _run > 1 and _run < _last")
    return inner.select("video_id", F.floor((F.col("a") + F.col("b")) / 2).cast("long").alias("frame_no"))


def detect_cuts(frames: DataFrame, how: Detection) -> DataFrame:
    """Cuts of ``frames`` (video_id, frame_no, value, and brightness where fades count) by a detection mode."""
    cuts = adaptive_cuts(frames, how.window, how.ratio, how.least, how.min_len) if how.adaptive else threshold_cuts(frames, how.threshold)
    return cuts.union(fade_cuts(frames, how.threshold)).distinct() if how.fades else cuts


def scenes_of_cuts(cuts: DataFrame, films: DataFrame) -> DataFrame:
    """Scenes between cuts; ``films``: (video_id, fps, total_frames)."""
    starts = cuts.select("video_id", F.col("frame_no").alias("start_frame")).union(films.select("video_id", F.lit(0).cast("long"))).distinct()
    order = Window.partitionBy("video_id").orderBy("start_frame")
    ends = starts.join(films, "video_id").withColumn("end_frame", F.coalesce(F.lead("start_frame").over(order), F.col("total_frames")))
    ms = lambda c: F.rint(F.col(c) * 1000 / F.col("fps")).cast("long")
    out = ends.filter("end_frame > start_frame").withColumn("scene_id", F.row_number().over(order))
    return out.select("video_id", "scene_id", ms("start_frame").alias("start_ms"), ms("end_frame").alias("end_ms"), "start_frame", "end_frame")


def track_components(scenes: DataFrame, layers: DataFrame, fps: Column | float = 30.0, tracks: int = 3) -> DataFrame:
    """Components (project, track, seq, kind, scene_id, start_frame, length, source, source_start) of each track.

    ``scenes``: (project, scene_id, start_sec, duration, start_frame, end_frame; frames may be null, then times are rounded).  ``layers``: (project,
    scene_id, pos, track, source, source_offset); the first layer of a track counts.  Each scene gives a gap filler if it starts behind the
    end of the one before, and a clip or a filler of its length.  ``start_frame`` is the running sum of lengths: where scenes overlap, later ones drift.
    """
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    begin = F.coalesce(F.col("start_frame").cast("long"), tc.nearest_frame(F.col("start_sec"), rate))
    exact = F.col("end_frame").cast("long") - F.col("start_frame").cast("long")
    exact = F.when(exact > 0, exact).otherwise(tc.frame_of(F.coalesce("duration", F.lit(0.0)), rate))
    length = F.when(F.col("start_frame").isNotNull(), exact).otherwise(tc.nearest_frame(F.coalesce("duration", F.lit(0.0)), rate))
    s = scenes.select("project", "scene_id", begin.alias("at"), length.alias("len"), F.explode(F.sequence(F.lit(1), F.lit(tracks))).alias("track"))
    first = layers.groupBy("project", "scene_id", "track").agg(F.min_by(F.struct("source", tc.nearest_frame(F.coalesce("source_offset", F.lit(0.0)), rate).alias("source_start")), "pos").alias("l"))
    s = s.join(first, ["project", "scene_id", "track"], "left")
    order = Window.partitionBy("project", "track").orderBy("scene_id")
    gap = F.col("at") - F.lag(F.col("at") + F.col("len"), 1, 0).over(order)
    filler = F.struct(F.lit("Filler").alias("kind"), F.col("gap").alias("length"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("source_start"))
    clip = F.struct(F.when(F.col("l").isNotNull(), "Clip").otherwise("Filler").alias("kind"), F.col("len").alias("length"), F.col("l.source").alias("source"), F.col("l.source_start").alias("source_start"))
    parts = s.withColumn("gap", gap).select("project", "track", "scene_id", F.posexplode(F.when(F.col("gap") > 0, F.array(filler, clip)).otherwise(F.array(clip))).alias("i", "c"))
    run = Window.partitionBy("project", "track").orderBy("scene_id", "i")
    before = F.coalesce(F.sum("c.length").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select("project", "track", F.row_number().over(run).alias("seq"), "c.kind", "scene_id", before.alias("start_frame"), "c.length", "c.source", "c.source_start")


def timeline_frames(scenes: DataFrame, fps: float = 30.0) -> DataFrame:
    """Length of the timecode track: the last scene's end and five minutes, an hour at least."""
    end = F.greatest(F.coalesce(F.max(F.col("start_sec") + F.col("duration")), F.lit(0.0)), F.lit(0.0)) + 300
    return scenes.groupBy("project").agg(tc.frame_of(F.greatest(end, F.lit(3600.0)), F.lit(fps)).alias("timecode_length"))
