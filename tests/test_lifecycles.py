"""The three whole jobs with stand-ins for models."""

import numpy as np
from test_sources import Vlm, wav

from cuewright.plans import lifecycles
from cuewright.sources import files, models


class Ear:
    """Hears a file as the hashed words of its length; enough for a data path."""

    def decode(self, path, content, rate, seconds):
        return None if b"BROKEN" in content else np.frombuffer(content[:64], dtype=np.uint8).astype(float)

    def encode(self, waves):
        return np.array([np.resize(w, 64) for w in waves])


def test_index_then_timeline(spark, tmp_path):
    sounds = tmp_path / "lib"
    sounds.mkdir()
    for name, data in {
        "Forest_Birds_1.wav": wav((b"bext", b"forest birds singing"), seconds=12),
        "Forest_Birds_2.wav": wav(seconds=30),
        "Car Park_hum.wav": wav(seconds=40),
        "short.wav": wav(seconds=1),
        "bad.wav": wav((b"bext", b"BROKEN"), seconds=20),
    }.items():
        (sounds / name).write_bytes(data)
    index, how = str(tmp_path / "index"), dict(text_encoder=models.HashedEncoder, audio_encoder=Ear, decoder=Ear)
    lifecycles.update_index(spark, str(sounds), index, **how)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.index(spark, index).collect()}
    assert sorted(rows) == ["Car Park_hum.wav", "Forest_Birds_1.wav", "Forest_Birds_2.wav"]
    assert rows["Car Park_hum.wav"]["catid"] == "AMBUndr" and rows["Forest_Birds_2.wav"]["duration"] == 30.0
    lifecycles.update_index(spark, str(sounds), index, **how)
    assert files.index(spark, index).count() == 3

    scenes = spark.createDataFrame(
        [(1, "00:00:00.000", "00:00:04.000", 4.0, (False,)), (2, "00:00:05.000", "00:00:07.000", 2.0, (True,))], "scene_id int, start string, end string, duration double, blank_info struct<is_blank:boolean>"
    )
    frames = spark.createDataFrame([(1, bytearray(b"forest birds")), (2, bytearray(b"forest"))], "scene_id int, image binary")
    analysis = lifecycles.analyse(scenes, frames, Vlm)
    assert {r["scene_id"]: r["silence_required"] for r in analysis.collect()} == {1: False, 2: True}
    manifest, parts = lifecycles.timeline_of(analysis, files.index(spark, index), models.HashedEncoder, "/v/My Film.mp4")
    m = manifest.first()
    assert (m["total_scenes"], m["silent_scenes"], len(m["scenes"][1]["layers"])) == (2, 1, 0)
    assert m["scenes"][0]["layers"][0]["track"] == 1 and m["project_name"] == "My_Film"
    track = [(r["kind"], r["length"]) for r in parts.filter("track = 1").orderBy("seq").collect()]
    assert track == [("Clip", 120), ("Filler", 30), ("Filler", 60)]
