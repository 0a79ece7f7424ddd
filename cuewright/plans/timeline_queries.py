"""Queries over scene timelines: times, folds, blank statistics, cuts, tracks, frame rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions import timecode as tc
from cuewright.functions import vector as vx
from cuewright.operators import timeline
from cuewright.plans import inputs
from cuewright.plans.inputs import SCENES_SQL

FPS = 30


def scene_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = inputs.scenes(spark, sf_dir)
    a, b = F.col("start_ms") / 1000.0, F.col("end_ms") / 1000.0
    rows = sc.select("event_id", tc.from_seconds(a).alias("start"), a.alias("a"), b.alias("b"))
    rows = rows.withColumn("seconds", tc.to_seconds(F.col("start"))).withColumn("times", tc.sample_times(F.col("a"), F.col("b"), F.col("b") - F.col("a")))
    return rows.select(
        "event_id", "start", vx.rounded(F.col("seconds"), 3).alias("seconds"), F.size("times").alias("n_times"), vx.rounded(F.aggregate("times", F.lit(0.0), lambda s, x: s + x), 4).alias("sum_times"),
        tc.duration_flexibility(F.col("b") - F.col("a")).alias("flexibility"), tc.frame_of(F.col("a"), F.lit(25.0)).alias("frame"),
    )


SCENE_TIMES_SQL = f"""
WITH {SCENES_SQL}, s AS (SELECT event_id, start_ms / 1000.0::DOUBLE AS a, end_ms / 1000.0::DOUBLE AS b, start_ms FROM sc),
t AS (SELECT *, CASE WHEN b - a < 0.5 THEN [(a + b) / 2] ELSE list_transform(generate_series(0, 6), lambda i: a + (b - a) * (i / 6.0::DOUBLE)) END AS times FROM s)
SELECT event_id, printf('%02d:%02d:%02d.%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS start, round(a, 3) AS seconds,
  len(times)::INTEGER AS n_times, round(list_sum(times), 4) AS sum_times, CASE WHEN b - a < 1 THEN 'exact' WHEN b - a < 5 THEN 'strict' WHEN b - a < 15 THEN 'loose' ELSE 'any' END AS flexibility,
  trunc(a * 25.0::DOUBLE)::BIGINT AS frame FROM t
"""

LEAST_MS = 2000


def merge_short_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = inputs.framed(inputs.scenes(spark, sf_dir)).select("video_id", "scene_id", "start_ms", "end_ms", "start_frame", "end_frame", "is_blank")
    return timeline.merge_short(sc, LEAST_MS).select("video_id", "scene_id", "start_ms", "end_ms", "is_blank")


def _fold_sql(joins: str, carried: str) -> str:
    """A recursive fold: ``m`` is the number of runs finished before, ``c_*`` the current run."""
    return f"""
WITH RECURSIVE {SCENES_SQL}, s AS (SELECT video_id, scene_id, start_ms, end_ms, is_blank, {carried} AS f FROM sc),
fold AS (
  SELECT video_id, scene_id, 1 AS run, start_ms AS c_start, end_ms AS c_end, is_blank AS c_blank, f AS c_f FROM s WHERE scene_id = 1
  UNION ALL
  SELECT s.video_id, s.scene_id, run + (NOT j)::INT, CASE WHEN j THEN c_start ELSE s.start_ms END, s.end_ms, CASE WHEN j THEN c_blank ELSE s.is_blank END, CASE WHEN j THEN c_f ELSE s.f END
  FROM (SELECT fold.*, n.scene_id AS nid, ({joins}) AS j FROM fold JOIN s n ON n.video_id = fold.video_id AND n.scene_id = fold.scene_id + 1) k
  JOIN s ON s.video_id = k.video_id AND s.scene_id = k.nid
)
SELECT video_id, run::INTEGER AS scene_id, min(c_start) AS start_ms, max(c_end) AS end_ms, bool_or(c_blank) AS is_blank FROM fold GROUP BY video_id, run
"""


def merge_similar_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = inputs.framed(inputs.scenes(spark, sf_dir)).select("video_id", "scene_id", "start_ms", "end_ms", "start_frame", "end_frame", "is_blank", (F.col("value") / 100).alias("tone"))
    return timeline.merge_similar(sc, "tone").select("video_id", "scene_id", "start_ms", "end_ms", "is_blank")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven requested samples of each event's scene, with statistics that follow from numbers."""
    e = inputs.table(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("sample_no"))
    h = (F.col("event_id") * 31 + F.col("sample_no") * 7) % 97
    return e.select(
        (F.col("event_id") % 500).alias("video_id"), "event_id", F.col("event_id").alias("scene_id"), "sample_no", (h % 11 != 3).alias("read_ok"),
        F.when(F.col("event_id") % 4 == 0, h % 20).when(F.col("event_id") % 4 == 1, 226 + h % 20).otherwise(h * 2).cast("double").alias("mean_brightness"), (h % 12).cast("double").alias("std_brightness"),
        (h % 13).cast("double").alias("color_std"), ((h % 9) / 1000.0).alias("edge_density"), (h % 25).cast("double").alias("lap_var"), F.when(h % 5 == 0, 0.99).otherwise(0.2).alias("p_black"),
        F.when(h % 7 == 0, 0.985).otherwise(0.1).alias("p_white"), F.when(h % 3 == 0, 0.98).otherwise(0.5).alias("uniform_ratio"),
    )


FRAMES_SQL = """
fr AS (
  SELECT event_id AS scene_id, i AS sample_no, (event_id * 31 + i * 7) % 97 AS h FROM events, (SELECT unnest(range(0, 7)) AS i)
), f AS (
  SELECT *, h % 11 <> 3 AS ok, (CASE WHEN scene_id % 4 = 0 THEN h % 20 WHEN scene_id % 4 = 1 THEN 226 + h % 20 ELSE h * 2 END)::DOUBLE AS b, h % 12 < 10 AND (h % 9) / 1000.0::DOUBLE < 0.005 AS plain FROM fr
), m AS (
  SELECT *, h % 5 = 0 OR (b < 25 AND plain) AS bl, h % 7 = 0 OR (b > 225 AND plain) AS wh FROM f
), x AS (
  SELECT *, NOT bl AND NOT wh AND h % 3 = 0 AND h % 13 < 10 AND (h % 9) / 1000.0::DOUBLE < 0.004 AND h % 25 < 18 AS co FROM m
)"""


def blank_scene_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = timeline.blank_statistics(_frames(spark, sf_dir), ["scene_id"])
    return s.select("scene_id", "samples_checked", "is_blank", "is_black", "is_white", "is_color", vx.rounded(F.col("brightness")).alias("brightness"), vx.rounded(F.col("blank_ratio")).alias("blank_ratio"), vx.rounded(F.col("edge_density_last")).alias("edge_density_last"))


BLANK_SQL = f"""
WITH {FRAMES_SQL}, g AS (
  SELECT scene_id, count(*) AS n, count(*) FILTER (WHERE ok AND bl) AS nb, count(*) FILTER (WHERE ok AND wh) AS nw, count(*) FILTER (WHERE ok AND co) AS nc,
    coalesce(avg(b) FILTER (WHERE ok), 0) AS brightness, coalesce(arg_max((h % 9) / 1000.0::DOUBLE, sample_no) FILTER (WHERE ok), 0) AS last FROM x GROUP BY scene_id
), r AS (SELECT *, (nb + nw + nc) / n AS ratio, (nb + nw + nc) / n >= 0.6 AS blank FROM g)
SELECT scene_id, n AS samples_checked, blank AS is_blank, blank AND nb > nw AS is_black, blank AND nw > nb AS is_white, blank AND nb = nw AS is_color, round(brightness, 6) AS brightness,
  round(ratio, 6) AS blank_ratio, round(last, 6) AS edge_density_last FROM r
"""


def _projects(spark: SparkSession, sf_dir: str):
    sc = inputs.framed(inputs.scenes(spark, sf_dir))
    exact = F.col("video_id") % 2 == 0
    gap = F.when(F.col("scene_id") % 5 == 0, F.col("start_ms") + 400).otherwise(F.col("start_ms"))
    rows = sc.select(
        F.concat(F.lit("p"), F.col("video_id").cast("string")).alias("project"), "scene_id", (gap / 1000.0).alias("start_sec"), "duration",
        F.when(exact, F.col("start_frame")).alias("start_frame"), F.when(exact, F.col("end_frame")).alias("end_frame"), "event_id", "value",
    )
    layer = rows.filter("value < 30").select("project", "scene_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(2))).alias("track"), "event_id")
    layers = layer.select("project", "scene_id", "track", F.when(F.col("track") == 1, 0).otherwise(1).alias("pos"), F.concat(F.lit("/l/"), F.col("event_id").cast("string")).alias("source"), (F.col("event_id") % 13 / 4.0).alias("source_offset")).distinct()
    return rows, layers


def track_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, layers = _projects(spark, sf_dir)
    return timeline.track_components(rows, layers, float(FPS))


TRACKS_SQL = f"""
WITH {SCENES_SQL}, r AS (
  SELECT 'p' || video_id AS project, scene_id, event_id, value, video_id % 2 = 0 AS exact, (CASE WHEN scene_id % 5 = 0 THEN start_ms + 400 ELSE start_ms END) / 1000.0::DOUBLE AS start_sec,
    (end_ms - start_ms) / 1000.0::DOUBLE AS duration, start_ms * 30 // 1000 AS sf, end_ms * 30 // 1000 AS ef FROM sc
), p AS (
  SELECT *, CASE WHEN exact THEN sf ELSE round_even(start_sec * 30, 0)::BIGINT END AS pos_at,
    CASE WHEN exact THEN CASE WHEN ef - sf > 0 THEN ef - sf ELSE trunc(duration * 30)::BIGINT END ELSE round_even(duration * 30, 0)::BIGINT END AS len FROM r
), t AS (
  SELECT p.*, track, value < 30 AND track IN (1, 2) AS clip FROM p, (SELECT unnest([1, 2, 3]) AS track)
), g AS (
  SELECT *, pos_at - lag(pos_at + len, 1, 0) OVER (PARTITION BY project, track ORDER BY scene_id) AS gap FROM t
), c AS (
  SELECT project, track, scene_id, 0 AS i, 'Filler' AS kind, gap AS length, NULL AS source, NULL::BIGINT AS source_start FROM g WHERE gap > 0
  UNION ALL
  SELECT project, track, scene_id, 1, CASE WHEN clip THEN 'Clip' ELSE 'Filler' END, len, CASE WHEN clip THEN '/l/' || event_id END, CASE WHEN clip THEN round_even(event_id % 13 / 4.0::DOUBLE * 30, 0)::BIGINT END FROM g
)
SELECT project, track::INTEGER AS track, (row_number() OVER w)::INTEGER AS seq, kind, scene_id, coalesce(sum(length) OVER (PARTITION BY project, track ORDER BY scene_id, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_frame,
  length, source, source_start FROM c WINDOW w AS (PARTITION BY project, track ORDER BY scene_id, i)
"""


def timecode_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _projects(spark, sf_dir)
    return timeline.timeline_frames(rows, float(FPS))


TIMECODE_SQL = f"""
WITH {SCENES_SQL}
SELECT 'p' || video_id AS project, trunc(greatest(max((CASE WHEN scene_id % 5 = 0 THEN start_ms + 400 ELSE start_ms END) / 1000.0::DOUBLE + (end_ms - start_ms) / 1000.0::DOUBLE) + 300, 3600) * 30)::BIGINT AS timecode_length FROM sc GROUP BY video_id
"""

RATES = ["29.97", "23.98", "25", "59.94", "47.95", "x", "-1", "24.0004", "30"]


def frame_rate_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = inputs.table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", tc.frame_rate(inputs.by_number(RATES, F.col("o_orderkey") % 9)).alias("r"), tc.downscale((F.col("o_orderkey") % 5 * 1000)).alias("downscale"))
    return rows.select("o_orderkey", vx.rounded(F.col("r.value")).alias("value"), "r.num", "r.den", "downscale")


RATES_SQL = f"""
WITH v AS (SELECT o_orderkey, coalesce(nullif(greatest(try_cast(({inputs.sql_list(RATES)})[o_orderkey % 9 + 1] AS DOUBLE), 0), 0), 30) AS v, o_orderkey % 5 * 1000 AS w FROM orders),
r AS (
  SELECT *, CASE WHEN abs(v - 23.976) < 0.01 THEN [24000, 1001] WHEN abs(v - 29.97) < 0.01 THEN [30000, 1001] WHEN abs(v - 59.94) < 0.01 THEN [60000, 1001] WHEN abs(v - 47.952) < 0.01 THEN [48000, 1001]
    WHEN abs(v - round_even(v, 0)) < 0.001 THEN [round_even(v, 0)::INTEGER, 1] END AS f FROM v
)
SELECT o_orderkey, round(f[1] / f[2], 6) AS value, f[1]::BIGINT AS num, f[2]::BIGINT AS den, (CASE WHEN w >= 3840 THEN 3 WHEN w >= 1920 THEN 2 ELSE 1 END)::INTEGER AS downscale FROM r
"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame scores of each user's events, in order."""
    from pyspark.sql import Window

    e = inputs.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("video_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("frame_no"), F.round("value", 2).alias("value"))


SCORES_SQL = "fs AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no, round(value, 2) AS value FROM events)"


def frame_diff_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = timeline.frame_differences(_scores(spark, sf_dir))
    return d.select("video_id", vx.rounded(F.col("mean_diff")).alias("mean_diff"), vx.rounded(F.col("std_diff")).alias("std_diff"), "threshold")


DIFF_SQL = f"""
WITH {SCORES_SQL}, d AS (SELECT video_id, abs(value - lag(value) OVER (PARTITION BY video_id ORDER BY frame_no)) AS d FROM fs),
g AS (SELECT video_id, avg(d) AS m, stddev_pop(d) AS s FROM d GROUP BY video_id)
SELECT video_id, round(m, 6) AS mean_diff, round(s, 6) AS std_diff, (CASE WHEN m IS NULL THEN 12 WHEN m < 5 AND s < 3 THEN 16 WHEN m > 25 OR s > 10 THEN 10 ELSE 12 END)::INTEGER AS threshold FROM g
"""


def adaptive_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.adaptive_cuts(_scores(spark, sf_dir), ratio=1.5, min_len=3)


ADAPTIVE_SQL = f"""
WITH RECURSIVE {SCORES_SQL}, w AS (
  SELECT *, count(value) OVER (PARTITION BY video_id ORDER BY frame_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n,
    (sum(value) OVER (PARTITION BY video_id ORDER BY frame_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - value) AS total FROM fs
), h AS (
  SELECT video_id, frame_no FROM w WHERE n = 5 AND value >= 15 AND (total / 4 < 1e-5 OR value / (total / 4) >= 1.5)
), r AS (
  SELECT video_id, min(frame_no) AS frame_no FROM h GROUP BY video_id
  UNION ALL
  SELECT r.video_id, (SELECT min(h.frame_no) FROM h WHERE h.video_id = r.video_id AND h.frame_no >= r.frame_no + 3) AS frame_no FROM r WHERE r.frame_no IS NOT NULL
)
SELECT video_id, frame_no FROM r WHERE frame_no IS NOT NULL
"""


def threshold_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.threshold_cuts(_scores(spark, sf_dir))


THRESHOLD_SQL = f"""
WITH {SCORES_SQL}, b AS (SELECT *, coalesce(lag(value) OVER (PARTITION BY video_id ORDER BY frame_no), 0) AS before FROM fs)
SELECT video_id, frame_no FROM b WHERE value >= 27 AND before < 27
"""


def cut_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    films = s.groupBy("video_id").agg(F.lit(25.0).alias("fps"), F.count(F.lit(1)).alias("total_frames"))
    return timeline.scenes_of_cuts(timeline.threshold_cuts(s), films)


CUT_SQL = f"""
WITH {SCORES_SQL}, b AS (SELECT *, coalesce(lag(value) OVER (PARTITION BY video_id ORDER BY frame_no), 0) AS before, count(*) OVER (PARTITION BY video_id) AS total FROM fs),
c AS (SELECT DISTINCT video_id, frame_no, total FROM b WHERE (value >= 27 AND before < 27) OR frame_no = 0),
s AS (SELECT video_id, frame_no AS start_frame, coalesce(lead(frame_no) OVER (PARTITION BY video_id ORDER BY frame_no), total) AS end_frame FROM c)
SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY start_frame))::INTEGER AS scene_id, start_frame * 40 AS start_ms, end_frame * 40 AS end_ms, start_frame, end_frame FROM s WHERE end_frame > start_frame
"""

QUERIES = {
    "scene_times": scene_times,
    "merge_short_scenes": merge_short_scenes,
    "merge_similar_scenes": merge_similar_scenes,
    "blank_scene_stats": blank_scene_stats,
    "track_components": track_components,
    "timecode_length": timecode_length,
    "frame_rate_resolve": frame_rate_resolve,
    "frame_diff_threshold": frame_diff_threshold,
    "adaptive_cuts": adaptive_cuts,
    "threshold_cuts": threshold_cuts,
    "cut_scenes": cut_scenes,
}

ORACLE_SQL = {
    "scene_times": SCENE_TIMES_SQL,
    "merge_short_scenes": _fold_sql(f"c_end - c_start < {LEAST_MS} AND NOT c_blank", "0"),
    "merge_similar_scenes": _fold_sql("NOT c_blank AND NOT n.is_blank AND 1 - abs(c_f - n.f) >= 0.85", "value / 100"),
    "blank_scene_stats": BLANK_SQL,
    "track_components": TRACKS_SQL,
    "timecode_length": TIMECODE_SQL,
    "frame_rate_resolve": RATES_SQL,
    "frame_diff_threshold": DIFF_SQL,
    "adaptive_cuts": ADAPTIVE_SQL,
    "threshold_cuts": THRESHOLD_SQL,
    "cut_scenes": CUT_SQL,
}
