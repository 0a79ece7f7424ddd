"""Cases worked out from the meaning of the text functions."""

import json

import pytest
from helpers import SF
from pyspark.sql import functions as F

from cuewright import rules
from cuewright.functions import text as tx
from cuewright.operators import scenemap
from cuewright.plans import registry


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "stem, caption",
    [
        ("QP92_City Traffic-BusyStreet_01", "city traffic busy street quiet ambience background"),
        ("thunder - heavy rain - weather 1", "thunder heavy rain weather"),
        ("3DS02 RoomTone", "room tone ambience interior room tone enclosed indoor"),
        ("Rain_48k_v3", "rain v3"),
        ("wind 4k mp3player2", "wind 4k mp3player2"),
        ("çayDenizSesi_2", "çay deniz sesi"),
    ],
)
def test_caption(spark, stem, caption):
    assert one(spark, f"/lib/{stem}.mp3", tx.caption) == caption


def test_caption_of_embedded_text(spark):
    told = lambda path, text: spark.createDataFrame([(path, text)], "p string, t string").select(tx.caption(F.col("p"), F.col("t"))).first()[0]
    assert told("/a/UWT_x.WAV", "Deep-Sea, bubbles;; x") == "deep sea bubbles x underwater water aquatic submerged"
    assert told("/a/Sea Wind.mp3", "ignored") == "sea wind"
    assert told("/a/Sea Wind.wav", "") == "sea wind"


@pytest.mark.parametrize("name, key", [("rain-48k_3", "rain-48k"), ("wind_take4", "wind"), ("wind-take4", "wind-take4"), ("rain_48k", "rain"), ("x_v3", "x")])
def test_similarity_key(spark, name, key):
    assert one(spark, f"/l/{name}.wav", tx.similarity_key) == key


@pytest.mark.parametrize(
    "raw, category, text",
    [
        ("", rules.ROOM_TONE, "[no response]"),
        (None, rules.ROOM_TONE, "[no response]"),
        (" \n\t ", rules.ROOM_TONE, "[no response]"),
        ("**CATEGORY:** amb-urban\n**DESCRIPTION:** Busy street", "AMB-URBAN", "Busy street"),
        ("A quiet forest path", "AMB-FOREST", "A quiet forest path"),
        ("CATEGORY: UNKNOWN\nDESCRIPTION: waves on the beach by the city", "AMB-URBAN", "waves on the beach by the city"),
        ("CATEGORY: FOO\nDESCRIPTION: x", "FOO", "x"),
        ("DESCRIPTION:\nfoo", rules.ROOM_TONE, "foo"),
        ("<thinking>CATEGORY: A\nB</thinking>CATEGORY: AMB-PARK\nDESCRIPTION: y", "AMB-PARK", "y"),
        ("thinking hard\nlet me analyze\nlake at dawn", "AMB-LAKESIDE", "lake at dawn"),
    ],
)
def test_reply(spark, raw, category, text):
    got = one(spark, raw, tx.parse_reply)
    assert (got["category"], got["sound_description"], got["silence_required"]) == (category, text, False)


@pytest.mark.parametrize(
    "positive, negative, status, category",
    [
        ("AMB-FOREST", "AMB-URBAN - Day - Outdoor Close - Traffic, Crowds", "ok", "AMB-URBAN"),
        ("AMB-FOREST", "AMB-FOREST - x", "auto_corrected_same", "AMB-URBAN"),
        ("AMB-FOREST", "NOT-A-KEY - x", "auto_corrected_invalid", "AMB-URBAN"),
        ("AMB-FOREST", "AMB-HOSPITAL - Day - Indoor - piano hum", "auto_corrected_danger", "AMB-URBAN"),
        ("NOT-A-KEY", "AMB-URBAN - x", "invalid_positive", "AMB-URBAN"),
    ],
)
def test_negative(spark, positive, negative, status, category):
    text = f"POSITIVE: {positive} - Day\nNEGATIVE: {negative}"
    got = one(spark, text, lambda t: tx.check_negative(tx.line_categories(t, "POSITIVE"), tx.labelled_line(t, "NEGATIVE"), tx.line_categories(t, "NEGATIVE")))
    assert (got["status"], got["category"]) == (status, category)


def test_query_text(spark):
    def text(key, time="Day", perspective=""):
        row = spark.createDataFrame([(key, time, perspective)], "key string, t string, p string").join(rules.vocabulary(spark), "key", "left")
        return row.select(tx.query_text(*(F.col(c) for c in ("key", "sub", "cat", "descr", "t", "p")))).first()[0]

    assert text("AMB-FOREST") == "forest ambience trees day"
    assert text("FOO-BAR") == "foo bar"
    assert text("AMB-RESTAURANT", "", "Indoor Close") == "restaurant & bar ambience restaurants indoor close"


@pytest.mark.parametrize("raw, out", [('ok {"a":1} bye', '{"a":1}'), ('{"a":1} then {"b":2}', None), ("none", None), (None, None), ('{"a":1,"a":2}', '{"a":2}')])
def test_salvage(spark, raw, out):
    assert one(spark, raw, tx.salvage_json) == out


def test_tags(spark):
    raw = ["Rain<2sec", "The", "rain", "Rain", "ok", "Gök gürültüsü!"]
    assert one(spark, raw, tx.tags, "array<string>") == ["rainunder 2sec", "rain", "gök gürültüsü"]
    assert one(spark, None, tx.tags, "array<string>") == []
    assert one(spark, "ﬁre", tx.nfkc) == "fire"


def test_description_of_layers(spark):
    df = spark.createDataFrame([(None, [("a", "0.2"), (" ", "9"), ("b", "x"), ("c", "0.2"), ("d", "1")])], "d string, l array<struct<description:string,weight:string>>")
    assert df.select(tx.description_or_layers(F.col("d"), F.col("l"))).first()[0] == "d a c"


@pytest.mark.parametrize("name, gb, rank", [("Qwen3.5-9B-Q6_K.gguf", 0, 7.65), ("model-4B-BF16.gguf", 0, 4.0), ("Qwen2.5-VL-3B-Instruct-Q4_K_M.gguf", 0, 2.25), ("plain-q8_0.gguf", 6.0, 6.3), ("plain.gguf", 1.0, 1.5)])
def test_model_rank(spark, name, gb, rank):
    got = spark.createDataFrame([(name, float(gb))], "n string, g double").select(tx.model_rank(F.col("n"), F.col("g"))).first()[0]
    assert got == pytest.approx(rank)


def test_scene_map_shapes(spark):
    scenes = spark.createDataFrame([(k, "a", "b", None, None, float(k), None) for k in range(5)], "scene_id int, start string, end string, start_frame int, end_frame int, duration double, blank_info struct<is_blank:boolean>")
    rows = [
        (0, 0, json.dumps({"mood": "old"})),
        (0, 1, json.dumps({"mood": " new ", "intensity": 7, "tags": ["Rain", "rain"]})),
        (1, 0, json.dumps({"raw_response": 'x {"mood":"m","sound_layers":[{"description":"hum"}]} y'})),
        (2, 0, json.dumps({"error": "e", "mood": "lost"})),
        (3, 0, json.dumps({"intensity": "loud", "sound_layers": [{"type": " ", "description": "d", "weight": -1}]})),
    ]
    got = {r["scene_id"]: r for r in scenemap.scene_map(scenes, spark.createDataFrame(rows, "scene_id int, ord int, analysis string")).collect()}
    assert len(got[0].asDict()) == 21
    assert (got[0]["mood"], got[0]["intensity"], got[0]["tags"]) == ("new", 1.0, ["rain"])
    assert (got[1]["mood"], got[1]["sound_description"]) == ("m", "hum")
    assert (got[2]["mood"], got[2]["tags"], got[4]["mood"]) == ("", [], "")
    assert got[3]["intensity"] == 0.5 and got[3]["sound_layers"][0].asDict() == {"type": "ambience", "description": "d", "weight": 0.0}
    assert [got[k]["duration_flexibility"] for k in range(5)] == ["exact", "strict", "strict", "strict", "strict"]


def test_queries_read_whole_texts_and_addresses(spark):
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    for r in registry.QUERIES["conversation_categories"](spark, SF).collect():
        text = (texts[r["conv_id"], r["turn"]] or "").lower()
        assert r["category"] == next((v for p, v in rules.DESCRIPTION_HINTS if p in text), rules.ROOM_TONE)
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = registry.QUERIES["page_labels"](spark, SF).collect()
    assert {r["page_id"]: r["url"] for r in got} == {k: f"file:///{u}" for k, u in urls.items()}
    assert all(r["name"] == urls[r["page_id"]].rpartition("/")[2] for r in got) and len({r["name"] for r in got}) > 15
