"""Readers, headers, models behind interfaces, sinks, streaming: on files made here."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.operators import assemble, timeline
from cuewright.sources import files, models, riff, sinks
from cuewright.streaming import incremental


def wav(*chunks, seconds=0.5, rate=8000):
    fmt = struct.pack("<HHIIHH", 1, 1, rate, rate * 2, 2, 16)
    body = b"WAVE"
    for name, data in [*chunks, (b"fmt ", fmt), (b"data", bytes(int(seconds * rate) * 2))]:
        body += name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_riff():
    data = wav((b"odd ", b"x"), (b"bext", b"Rain on roof".ljust(602, b"\0")), (b"iXML", b"<UCS_CATID>AMBForst</UCS_CATID>"))
    assert riff.description(data) == "Rain on roof"
    assert riff.category(data) == "AMBForst"
    assert riff.sound(data)["duration"] == 0.5
    assert riff.category(wav((b"iXML", b"<IXML:CATEGORY> </IXML:CATEGORY><CATEGORY>x</CATEGORY>"))) == ""
    assert riff.description(b"no riff") == "" and riff.category(data[:30]) is None and riff.description(data[:20]) == ""


def test_headers_and_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.wav").write_bytes(wav((b"bext", b"Sea")))
    (tmp_path / "b.WAV").write_bytes(b"junk")
    (tmp_path / "c.Wav").write_bytes(b"junk")
    found = files.audio_files(spark, str(tmp_path)).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in found] == ["b.WAV", "a.wav"]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "content")
    got = {r["path"].rsplit("/", 1)[1]: r for r in riff.headers(raw, lambda p, c: 7.0).collect()}
    assert (got["a.wav"]["duration"], got["a.wav"]["embedded"], got["b.WAV"]["duration"]) == (0.5, "Sea", 7.0)


def test_json_sources(spark, tmp_path):
    (tmp_path / "scenes.json").write_text(json.dumps([{"scene_id": 1, "start": "00:00:00.000", "duration": 1.5, "blank_info": {"is_blank": True}}]))
    (tmp_path / "meta.json").write_text(json.dumps({"video_path": "v"}))
    (tmp_path / "ai.json").write_text(json.dumps([{"scene_id": 1, "openrouter_analysis": {"error": "x"}}]))
    (tmp_path / "q.txt").write_text(" rain \n\n wind\n")
    assert files.scenes(spark, str(tmp_path / "scenes.json")).first()["blank_info"]["is_blank"]
    assert files.metadata(spark, str(tmp_path / "meta.json")).first()["fps"] == 30.0
    assert json.loads(files.analyses(spark, str(tmp_path / "ai.json")).first()["analysis"]) == {"error": "x"}
    assert sorted(r[0] for r in files.query_lines(spark, str(tmp_path / "q.txt")).collect()) == ["rain", "wind"]


def test_index_sources(spark, tmp_path):
    path = str(tmp_path / "index")
    assert files.index_or_empty(spark, path).count() == 0
    sinks.write_index(spark.createDataFrame([("/a", [1.0])], "path string, audio_emb array<float>"), path)
    row = files.index_or_empty(spark, path).first()
    assert (row["preset"], row["duration"], row["text_emb"]) == ("natural", -1.0, None)


class Tone:
    def decode(self, path, content, rate, seconds):
        return np.frombuffer(content, dtype=np.uint8).astype(float) if content else None

    def encode(self, waves):
        return np.array([[w.mean(), len(w)] for w in waves])


class Film:
    def grab(self, path, frame):
        return None if frame < 0 else np.full((16, 16, 3), 0 if frame == 0 else 255 if frame == 1 else 90, dtype=np.uint8)


class Vlm:
    def describe(self, image):
        return "CATEGORY: AMB-PARK\nDESCRIPTION: " + image.decode()


def test_models(spark):
    audio = spark.createDataFrame([("/a", b"\x02\x04"), ("/b", b"")], "path string, content binary")
    got = {r["path"]: r for r in models.encode_audio(audio, Tone, Tone).collect()}
    assert got["/a"]["audio_emb"] == [3.0, 2.0] and not got["/b"]["ok"]
    texts = spark.createDataFrame([("rain wind",), (None,)], "t string")
    vectors = [r["emb"] for r in models.encode_texts(texts, "t", models.HashedEncoder).collect()]
    assert len(vectors[0]) == 64 and not any(vectors[1])
    wanted = spark.createDataFrame([(1, "/v", 1, k, k if k < 3 else -1) for k in range(4)], "video_id long, path string, scene_id int, sample_no int, frame_idx int")
    frames = models.grab_frames(wanted, Film, models.grey_features, models.FRAME_FEATURES)
    stats = timeline.blank_statistics(frames).first()
    assert (stats["samples_checked"], stats["is_blank"], stats["is_color"]) == (4, True, True)
    assert timeline.blank_info(timeline.blank_statistics(frames)).first()["blank_info"]["metrics"]["p_white_last"] == 0.0
    told = models.describe_frames(spark.createDataFrame([(1, bytearray(b"birds"))], "scene_id int, image binary"), Vlm).first()
    assert (told["parsed"]["category"], told["parsed"]["sound_description"]) == ("AMB-PARK", "birds")
    assert sum(models.colour_histogram(Film().grab("", 1))) == 256


def test_sinks(spark, tmp_path):
    scenes = spark.createDataFrame([(1, "a", "b", 5.0, "AMB-PARK", "x", False), (2, "a", "b", 5.0, "AMB-PARK", "x", True)], "scene_id int, start string, end string, duration double, category string, sound_description string, silence_required boolean")
    hits = spark.createDataFrame([(k, 1, "/l/r.wav", 0.9, 30.0, 5.0) for k in (1, 2)], "scene_id int, rank int, path string, score double, audio_duration double, duration double")
    m = assemble.manifest(scenes, assemble.layers(hits), "/v/My Film (1).mp4", 25.0)
    sinks.write_json(m, str(tmp_path / "m"))
    back = files.manifest(spark, str(tmp_path / "m")).first()
    assert (back["project_name"], back["total_scenes"], back["scenes_with_sound"], back["silent_scenes"]) == ("My_Film__1_", 2, 1, 1)
    assert [len(s["layers"]) for s in back["scenes"]] == [1, 0]
    sinks.write_json_array(scenes, str(tmp_path / "arr"), "scene_id")
    assert [s["scene_id"] for s in json.loads(spark.read.text(str(tmp_path / "arr")).first()[0])] == [1, 2]
    comp = spark.createDataFrame([("p", 1, 1, "Clip", 1, 0, 60, "/a.wav", 15)], "project string, track int, seq int, kind string, scene_id int, start_frame long, length long, source string, source_start long")
    sinks.write_components(comp, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1
    assert sinks.edit_list(comp).first()["line"].endswith("00:00:00:15 00:00:02:15 00:00:00:00 00:00:02:00")


def test_results_of(spark):
    scenes = spark.createDataFrame([(1, "rain"), (2, "rain"), (3, "sun")], "scene_id int, sound_description string")
    hits = spark.createDataFrame([(1, [("/a",)]), (2, [("/b",)])], "scene_id int, results array<struct<path:string>>")
    by_id = {r["scene_id"]: r["results"] for r in assemble.results_of(scenes, hits).collect()}
    assert by_id[1][0]["path"] == "/a" and by_id[3] == []
    by_text = {r["scene_id"]: r["results"] for r in assemble.results_of(scenes, hits, "description").collect()}
    assert by_text[1][0]["path"] == by_text[2][0]["path"] == "/b"


def test_streamed_index(spark, tmp_path):
    src, index = str(tmp_path / "in"), str(tmp_path / "index")
    rows = spark.createDataFrame([("/a", 20.0), ("/b", 5.0)], "path string, duration double")
    rows.write.parquet(src)
    run = lambda: incremental.keep_indexed(incremental.file_stream(spark, src), index, str(tmp_path / "cp"), lambda d: d.select("path", F.col("duration").cast("float").alias("duration"), F.lit("natural").alias("preset")), "natural").awaitTermination()
    run()
    assert [r["path"] for r in spark.read.parquet(index).collect()] == ["/a"]
    spark.createDataFrame([("/a", 20.0), ("/c", 30.0)], "path string, duration double").write.mode("append").parquet(src)
    run()
    assert sorted(r["path"] for r in spark.read.parquet(index).collect()) == ["/a", "/c"]
    with pytest.raises(Exception):
        spark.createDataFrame([("/z", 20.0)], "path string, duration double").write.mode("append").parquet(src)
        incremental.keep_indexed(incremental.file_stream(spark, src), index, str(tmp_path / "cp"), lambda d: d, "music").awaitTermination()


def test_listing_counts_a_table_in_parts_as_one_file(spark, tmp_path):
    spark.range(3).repartition(2).write.parquet(str(tmp_path / "a.parquet"))
    (tmp_path / "b.parquet").write_bytes(b"xy")
    (tmp_path / "plain" / "c.parquet").mkdir(parents=True)
    (tmp_path / "plain" / "c.parquet" / "part").write_bytes(b"x")
    (tmp_path / "parquet").write_bytes(b"no extension")
    found = {r["path"]: r["size"] for r in files.listing(spark, str(tmp_path), ("parquet",), folders=True).collect()}
    assert set(found) == {str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")}
    assert found[str(tmp_path / "b.parquet")] == 2 and found[str(tmp_path / "a.parquet")] > 200


def test_report_rounds_as_its_sql_does(spark, duck):
    """Ties of the shortest decimal, where a double times 100 is a little less."""
    from cuewright.functions import vector as vx
    from pyspark.sql import functions as F

    values = [s * (k / 100 + 0.005) for k in range(120) for s in (1, -1)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(vx.rounded_double(F.col("x"), 2)).collect()]
    want = [r[0] for r in duck.execute("select round(unnest(?::double[]), 2)", [values]).fetchall()]
    assert got == want and any(v != r[0] for v, r in zip(want, spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 2)).collect()))


def test_scenes_of_many_videos_are_few_files(spark, tmp_path):
    """A JSON array a video, in its order, but not a file a video."""
    import os

    rows = spark.range(600).selectExpr("cast(id % 200 as string) as video_id", "cast(id / 200 as int) as scene_id", "'00:00' as start", "if(id = 7, 1.5, null) as duration")
    path = str(tmp_path / "scenes")
    sinks.write_keyed_arrays(rows, path, "video_id", "scene_id")
    names = [f"{d}/{n}" for d, _, found in os.walk(path) for n in found if n.startswith("part")]
    assert 0 < len(names) <= 2 * spark.sparkContext.defaultParallelism
    lines = [json.loads(x) for n in names for x in open(n)]
    assert len(lines) == 200 and all([r["scene_id"] for r in x["rows"]] == [0, 1, 2] for x in lines)
    got = files.keyed_scenes(spark, path)
    assert got.count() == 600 and [tuple(r) for r in got.filter("duration is not null").select("video_id", "scene_id", "duration", "end").collect()] == [("7", 0, 1.5, None)]


def test_audio_vectors_come_in_few_frames_with_columns_to_keep(spark, monkeypatch):
    rows = spark.range(100).repartition(1).selectExpr("cast(id as string) as path", "if(id % 5 = 0, cast('' as binary), cast('ab' as binary)) as content", "array(cast(id as float)) as kept")
    seen = rows.mapInPandas(lambda frames: frames, rows.schema)
    heard = models.encode_audio(seen, Tone, Tone, keep=("kept",))
    assert all(r["ok"] == (int(r["path"]) % 5 != 0) and r["kept"] == [float(r["path"])] and (r["audio_emb"] is not None) == r["ok"] for r in heard.collect())
    from cuewright.plans import registry
    from helpers import SF

    plan = registry.QUERIES["media_models"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInPandas") == 1
