"""Timecodes, folds, tracks, blank statistics."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuewright import config
from cuewright.functions import timecode as tc
from cuewright.operators import assemble, timeline

SCENES = "video_id long, scene_id int, start_ms long, end_ms long, start_frame long, end_frame long, is_blank boolean"


def scenes(spark, spans):
    return spark.createDataFrame([(1, i, a, b, a // 40, b // 40, k) for i, (a, b, k) in enumerate(spans)], SCENES)


def folded(df):
    return [(r["scene_id"], r["start_ms"], r["end_ms"], r["is_blank"]) for r in df.orderBy("scene_id").collect()]


def test_merge_short(spark):
    spans = [(0, 200, False), (200, 600, False), (600, 800, True), (800, 1800, False), (1800, 2000, False)]
    assert folded(timeline.merge_short(scenes(spark, spans))) == [(1, 0, 600, False), (2, 600, 800, True), (3, 800, 1800, False), (4, 1800, 2000, False)]
    spans = [(0, 200, False), (200, 400, True), (400, 1400, False)]
    assert folded(timeline.merge_short(scenes(spark, spans))) == [(1, 0, 1400, False)]
    assert folded(timeline.merge_short(scenes(spark, spans), strict=True)) == [(1, 0, 200, False), (2, 200, 400, True), (3, 400, 1400, False)]
    assert folded(timeline.merge_short(scenes(spark, []))) == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 1200), st.booleans()), min_size=1, max_size=25))
def test_merge_short_properties(spark, steps):
    spans, at = [], 0
    for n, blank in steps:
        spans.append((at, at + n, blank))
        at += n
    once = folded(timeline.merge_short(scenes(spark, spans)))
    assert [r[0] for r in once] == list(range(1, len(once) + 1))
    assert once[0][1] == 0 and once[-1][2] == at and all(a[2] == b[1] for a, b in zip(once, once[1:]))
    # by a plain fold
    want, cur = [], list(spans[0])
    for nxt in spans[1:]:
        if cur[1] - cur[0] < 500 and not cur[2]:
            cur[1] = nxt[1]
        else:
            want.append(tuple(cur))
            cur = list(nxt)
    assert [r[1:] for r in once] == [*want, tuple(cur)]
    again = folded(timeline.merge_short(scenes(spark, [r[1:] for r in once])))
    assert again == once


def test_merge_similar_frames(spark):
    spans = [(0, 100, False), (100, 200, False), (200, 300, False), (300, 400, True)]
    hist = {0: [1.0, 0.0, 0.0], 1: [1.0, 0.0, 0.01], 2: [0.0, 1.0, 0.0], 3: [0.0, 1.0, 0.0]}
    frames = spark.createDataFrame([(1, 100 * k + 50, h) for k, h in hist.items()], "video_id long, at_ms long, histogram array<double>")
    assert folded(timeline.merge_similar_frames(scenes(spark, spans), frames)) == [(1, 0, 200, False), (2, 200, 300, False), (3, 300, 400, True)]


def test_timecodes(spark):
    row = spark.createDataFrame([("01:02:05.500", 3725.5, 59.9996, "bad")], "c string, s double, t double, b string").select(
        tc.to_seconds(F.col("c")), tc.from_seconds(F.col("s")), tc.from_seconds(F.col("t")), tc.to_seconds(F.col("b"), tolerant=True), tc.to_seconds(F.col("b"))
    ).first()
    assert tuple(row) == (3725.5, "01:02:05.500", "00:00:60.000", 0.0, None)


def test_sample_times(spark):
    df = spark.createDataFrame([(1.0, 1.4), (10.0, 12.0)], "a double, b double")
    short, normal = (r[0] for r in df.select(tc.sample_times(F.col("a"), F.col("b"), F.col("b") - F.col("a"))).collect())
    assert short == [1.2] and len(normal) == 7 and (normal[0], normal[-1]) == (10.0, 12.0)


@pytest.mark.parametrize("value, num, den", [("29.97", 30000, 1001), ("23.98", 24000, 1001), ("25", 25, 1), ("12.5", 25, 2), ("x", 30, 1), ("-1", 30, 1), (None, 30, 1)])
def test_frame_rate(spark, value, num, den):
    r = spark.createDataFrame([(value,)], "v string").select(tc.frame_rate(F.col("v")).alias("r")).first()["r"]
    assert (r["num"], r["den"]) == (num, den) and r["value"] == pytest.approx(num / den)


@pytest.mark.parametrize("d, band", [(0.99, "exact"), (1.0, "strict"), (4.99, "strict"), (5.0, "loose"), (15.0, "any"), (None, "exact")])
def test_flexibility(spark, d, band):
    assert spark.createDataFrame([(d,)], "d double").select(tc.duration_flexibility(F.col("d"))).first()[0] == band


def test_tracks(spark):
    s = spark.createDataFrame([("p", 1, 0.0, 2.0, None, None), ("p", 2, 3.0, 1.0, None, None)], "project string, scene_id int, start_sec double, duration double, start_frame int, end_frame int")
    l = spark.createDataFrame([("p", 1, 0, 1, "/a.wav", 0.5), ("p", 1, 1, 1, "/b.wav", 0.0)], "project string, scene_id int, pos int, track int, source string, source_offset double")
    got = {}
    for r in timeline.track_components(s, l).orderBy("track", "seq").collect():
        got.setdefault(r["track"], []).append((r["kind"], r["length"], r["source"], r["source_start"], r["start_frame"]))
    assert got[1] == [("Clip", 60, "/a.wav", 15, 0), ("Filler", 30, None, None, 60), ("Filler", 30, None, None, 90)]
    assert got[2] == got[3] == [("Filler", 60, None, None, 0), ("Filler", 30, None, None, 60), ("Filler", 30, None, None, 90)]
    assert timeline.timeline_frames(s).first()["timecode_length"] == 108000


@pytest.mark.parametrize("audio, low, high", [(30.0, 10, 25), (12.0, 3.5, 3.5), (4.0, 0, 0)])
def test_source_offset(spark, audio, low, high):
    for u in (0.0, 0.5, 0.999999):
        got = spark.createDataFrame([(audio, 5.0, u)], "a double, c double, u double").select(assemble.source_offset(F.col("a"), F.col("c"), F.col("u"))).first()[0]
        assert low <= got <= high


@pytest.mark.parametrize("score, band", [(0.26, "high"), (0.25, "medium"), (0.18, "low")])
def test_layer_confidence(spark, score, band):
    assert spark.createDataFrame([(score,)], "s double").select(assemble.layer_confidence(F.col("s"))).first()[0] == band


def test_unknown_duration_keeps_no_name(spark):
    rows = [(1, 1, "/l/rain_1.wav", 0.9, None, 5.0), (1, 2, "/l/rain_2.wav", 0.8, 20.0, 5.0), (1, 3, "/l/rain_3.wav", 0.7, 20.0, 5.0), (1, 4, "/l/wind.wav", 0.2, 20.0, 5.0)]
    df = spark.createDataFrame(rows, "scene_id int, rank int, path string, score double, audio_duration double, duration double")
    got = [(r["track"], r["source_file"]) for r in assemble.layers(df).orderBy("track").collect()]
    assert got == [(1, "/l/rain_2.wav"), (2, "/l/wind.wav")]


def test_corner_and_middle_frames(spark):
    df = spark.createDataFrame([(1.0, 2.0, 10.0, 15), (0.0, 0.0, 10.0, 0), (1.0, 2.0, 10.0, 1000)], "a double, b double, fps double, n int")
    got = [[x["frame"] for x in r[0]] for r in df.select(tc.corner_frames(F.col("a"), F.col("b"), F.col("fps"), F.col("n"))).collect()]
    assert got == [[10, 14, 14], [0, 0, 0], [10, 15, 20]]
    mid = spark.createDataFrame([(1.0, 2.0, None), (None, None, 25.0)], "a double, b double, fps double").select(tc.middle_frame(F.col("a"), F.col("b"), F.col("fps"))).collect()
    assert [r[0] for r in mid] == [36, 0]
    size = spark.createDataFrame([(1920, 1080), (300, 200)], "w int, h int").select(tc.fitted(F.col("w"), F.col("h"))).collect()
    assert [tuple(r[0]) for r in size] == [(720, 405), (300, 200)]


def test_modes(spark):
    assert config.detection("nope") == config.MODES["adaptive"] and config.detection("dynamic").merge_similar
    assert config.detection("adaptive", auto=False).fades and not config.detection("static", auto=False, threshold=9).adaptive
    assert (config.tag_limit(2), config.tag_limit(5), config.text_weight(0.4, False)) == (10, 5, 0.0)
    assert "CATEGORY:" in config.scene_prompt(["A"]) and "NEGATIVE:" in config.contrast_prompt()
    light = [50, 50, 5, 5, 5, 50, 50, 50, 5]
    value = [0, 0, 0, 0, 0, 0, 40, 0, 0]
    frames = spark.createDataFrame([(1, i, float(v), float(b)) for i, (v, b) in enumerate(zip(value, light))], "video_id long, frame_no long, value double, brightness double")
    cuts = lambda d: sorted(r["frame_no"] for r in timeline.detect_cuts(frames, d).collect())
    assert cuts(config.detection("static")) == [3, 6] and cuts(config.detection("adaptive")) == [6] and cuts(config.detection("dynamic")) == [3, 6]


def test_similarity_columns(spark):
    """The column form equals the plain one; empty and flat sides count as 0."""
    a, b = [[1.0, 2.0, 4.0], [0.0, 1.0, 0.0]], [[3.0, 1.0, 2.0], [1.0, 1.0, 1.0], [2.0, 4.0, 8.0]]
    df = spark.createDataFrame([(a, b), (a, []), ([], b), (a, a)], "a array<array<double>>, b array<array<double>>")
    got = [r[0] for r in df.select(timeline.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([timeline.histogram_similarity(x, y) for x, y in ((a, b), (a, []), ([], b), (a, a))])


def test_blank_info_join_and_counts(spark):
    sc = scenes(spark, [(0, 100, False), (100, 900, False), (900, 2000, False)])
    info = spark.createDataFrame([(1, 1, (True,))], "video_id long, scene_id int, blank_info struct<is_blank:boolean>")
    got = {r["scene_id"]: r["blank_info"] for r in timeline.with_blank_info(sc, info).collect()}
    assert got[0] is None and got[1]["is_blank"] and got[2] is None
    assert [tuple(r) for r in timeline.merge_counts(sc, timeline.merge_short(sc)).collect()] == [(1, 3, 2, 1)]
    assert [tuple(r) for r in timeline.merge_counts(sc, sc.limit(0)).collect()] == [(1, 3, 0, 3)]


def test_merge_similar_frames_samples_a_grown_run(spark):
    """Several samples of a run, videos without frames or scenes, ragged order: as the definition says, row by row."""
    rng = np.random.default_rng(3)
    rows, shots = [], []
    for v in range(12):
        for k in range(20):
            rows.append((v, k + 1, k * 10, k * 10 + 10, k, k + 1, bool(rng.random() < 0.1)))
        if v != 5:
            shots += [(v, int(at), (np.arange(4) * rng.choice([-1, 1], p=[0.3, 0.7]) + rng.random(4) * 1.2).tolist()) for at in np.sort(rng.choice(200, 60, replace=False))]
    shots.append((99, 0, [1.0, 2.0, 3.0, 4.0]))
    sc = spark.createDataFrame(rows[::-1], "video_id long, scene_id int, start_ms long, end_ms long, start_frame long, end_frame long, is_blank boolean")
    fr = spark.createDataFrame(shots[::-1], "video_id long, at_ms long, histogram array<double>")
    want = []
    for v in range(12):
        mine = [(a, h) for w, a, h in shots if w == v]

        def sampled(a, b):
            inside = [h for t, h in mine if a <= t < b]
            return [inside[i] for i in np.unique(np.linspace(0, len(inside) - 1, 3).round().astype(int))] if inside else []

        runs = []
        for _, _, a, b, _, _, blank in (r for r in rows if r[0] == v):
            if runs and not runs[-1][2] and not blank and timeline.histogram_similarity(sampled(*runs[-1][:2]), sampled(a, b)) >= 0.3:
                runs[-1][1] = b
            else:
                runs.append([a, b, blank])
        want += [(v, n, *r) for n, r in enumerate(runs, 1)]
    got = timeline.merge_similar_frames(sc, fr, 0.3)
    assert sorted((r["video_id"], r["scene_id"], r["start_ms"], r["end_ms"], r["is_blank"]) for r in got.collect()) == want and len(want) < len(rows)
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
