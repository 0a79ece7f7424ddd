"""Queries over texts: captions, replies, tags, categories, JSON, models, scene map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright import rules
from cuewright.functions import text as tx
from cuewright.functions import vector as vx
from cuewright.operators import classify, scenemap
from cuewright.plans import inputs
from cuewright.plans.inputs import sql_list

PREFIXES = ["QP92_", "UWT ", "3DS02 RoomTone-", "SNDfx_", "thunder - ", ""]
KEYS = [*rules.VOCABULARY, "FOO-BAR"]


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = F.concat(inputs.by_number(PREFIXES, k % 6), F.initcap("p_name"), F.lit("-BusyStreet_"), (k % 100).cast("string"), F.lit("_v3.mp3"))
    return p.select("p_partkey", F.concat(F.lit("/lib/x.y/"), name).alias("path")).withColumn("caption", tx.caption(F.col("path")))


def _hint_sql(x: str, how: str = "starts_with") -> str:
    return "CASE " + " ".join(f"WHEN {how}({x}, '{p}') THEN '{v}'" for p, v in rules.PREFIX_HINTS) + " ELSE '' END"


CAPTIONS_SQL = f"""
WITH f AS (
  SELECT p_partkey, ({sql_list(PREFIXES)})[p_partkey % 6 + 1]
    || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || '-BusyStreet_' || (p_partkey % 100) || '_v3' AS stem FROM part
), t AS (
  SELECT *, string_split(regexp_replace(regexp_replace(stem, '[-_.]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), ' ') AS words FROM f
), c AS (
  SELECT *, lower(array_to_string(list_filter(words, lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]+')
    AND NOT (regexp_full_match(w, '[A-Za-z0-9]{{3,7}}') AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]'))), ' ')) AS words_ FROM t
)
SELECT p_partkey, '/lib/x.y/' || stem || '.mp3' AS path, trim(words_ || ' ' || {_hint_sql("upper(stem)")}) AS caption FROM c
"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.table(spark, sf_dir, "conversations")
    n = F.col("conv_id") + F.col("turn")
    head = F.regexp_replace("text", r"[\r\n]", " ")
    raw = (
        F.when(n % 8 == 0, F.concat(F.lit("**CATEGORY:** amb-urban\n**DESCRIPTION:** "), head))
        .when(n % 8 == 1, F.concat(F.lit("[img-12]CATEGORY: UNKNOWN\nDESCRIPTION: waves at the beach by the city "), head))
        .when(n % 8 == 2, F.concat(F.lit("Thinking it over\n  A quiet forest path "), head))
        .when(n % 8 == 3, F.concat(F.lit("<thinking>a\nb</thinking>category: WATR-SURF\ndescription:   "), head))
        .when(n % 8 == 4, F.lit("   "))
        .when(n % 8 == 5, F.concat(F.lit("CATEGORY: FOO\nDESCRIPTION:\n"), head))
        .when(n % 8 == 6, F.lit(None).cast("string"))
        .otherwise(head)
    )
    return c.select("conv_id", "turn", raw.alias("raw"))


REPLIES_SQL = """
r AS (
  SELECT conv_id, turn, regexp_replace(text, '[\\r\\n]', ' ', 'g') AS head, (conv_id + turn) % 8 AS n FROM conversations
), raw AS (
  SELECT conv_id, turn, CASE n WHEN 0 THEN '**CATEGORY:** amb-urban' || chr(10) || '**DESCRIPTION:** ' || head
    WHEN 1 THEN '[img-12]CATEGORY: UNKNOWN' || chr(10) || 'DESCRIPTION: waves at the beach by the city ' || head
    WHEN 2 THEN 'Thinking it over' || chr(10) || '  A quiet forest path ' || head
    WHEN 3 THEN '<thinking>a' || chr(10) || 'b</thinking>category: WATR-SURF' || chr(10) || 'description:   ' || head
    WHEN 4 THEN '   ' WHEN 5 THEN 'CATEGORY: FOO' || chr(10) || 'DESCRIPTION:' || chr(10) || head WHEN 6 THEN NULL ELSE head END AS raw FROM r
)"""


def vlm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _replies(spark, sf_dir).withColumn("p", tx.parse_reply(F.col("raw")))
    return rows.select("conv_id", "turn", "p.category", "p.sound_description", "p.silence_required")


VLM_SQL = f"""
WITH {REPLIES_SQL}, c AS (
  SELECT *, replace(regexp_replace(regexp_replace(raw, '\\[img-\\d+\\]', '', 'g'), '(?s)<thinking>.*?</thinking>', '', 'g'), '*', '') AS clean FROM raw
), p AS (
  SELECT *, upper(regexp_extract(clean, '(?i)CATEGORY:\\s*([\\w-]+)', 1)) AS named, trim(regexp_extract(clean, '(?i)DESCRIPTION:\\s*([^\\n]*)', 1)) AS told,
    list_filter(list_transform(string_split(clean, chr(10)), lambda s: trim(s)), lambda s: s <> '' AND NOT contains(upper(s), 'CATEGORY:') AND NOT contains(upper(s), 'DESCRIPTION:')
      AND NOT contains(lower(s), 'thinking') AND NOT contains(lower(s), 'analyze')) AS plain FROM c
), d AS (
  SELECT *, CASE WHEN told <> '' THEN told ELSE coalesce(plain[1], '') END AS description FROM p
)
SELECT conv_id, turn,
  CASE WHEN raw IS NULL OR trim(raw) = '' THEN 'AMB-ROOM-TONE' WHEN named NOT IN ('', 'UNKNOWN') THEN named
    ELSE CASE {" ".join(f"WHEN contains(lower(description), '{p}') THEN '{v}'" for p, v in rules.DESCRIPTION_HINTS)} ELSE 'AMB-ROOM-TONE' END END AS category,
  CASE WHEN raw IS NULL OR trim(raw) = '' THEN '[no response]' ELSE description END AS sound_description, false AS silence_required
FROM d
"""

NEGATIVES = ["Traffic, Crowds", "piano hum", "Quiet air", "Machines"]


def _posneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = inputs.table(spark, sf_dir, "part"), F.col("p_partkey")
    pos, neg = inputs.by_number(KEYS, k % 38), inputs.by_number(KEYS, F.when(k % 3 == 1, k).otherwise(k * 7) % 38)
    text = F.concat(F.lit("  POSITIVE: "), F.lower(pos), F.lit(" - Day - Outdoor\nnegative:  "), neg, F.lit(" - Day - "), inputs.by_number(NEGATIVES, k % 4))
    return p.select("p_partkey", text.alias("text"))


def posneg_parse_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rows = _posneg(spark, sf_dir).select(
        "p_partkey", tx.labelled_line(t, "POSITIVE").alias("positive"), tx.labelled_line(t, "NEGATIVE").alias("negative"), tx.line_categories(t, "POSITIVE").alias("pos_category"), tx.line_categories(t, "NEGATIVE").alias("_neg")
    )
    rows = rows.withColumn("c", tx.check_negative(F.col("pos_category"), F.col("negative"), F.col("_neg")))
    return rows.select("p_partkey", "positive", "negative", "pos_category", F.col("c.category").alias("neg_category"), F.col("c.status").alias("negative_status"))


def _posneg_sql() -> str:
    danger = " OR ".join(f"contains(lower(negative), '{w}')" for w in rules.DANGER)
    return f"""
WITH k AS (
  SELECT p_partkey, ({sql_list(KEYS)})[p_partkey % 38 + 1] AS pos, ({sql_list(KEYS)})[CASE WHEN p_partkey % 3 = 1 THEN p_partkey ELSE p_partkey * 7 END % 38 + 1] AS neg,
    ({sql_list(NEGATIVES)})[p_partkey % 4 + 1] AS told FROM part
), l AS (
  SELECT p_partkey, lower(pos) || ' - Day - Outdoor' AS positive, neg || ' - Day - ' || told AS negative, nullif(pos, 'FOO-BAR') AS pos_category, nullif(neg, 'FOO-BAR') AS neg_ FROM k
), s AS (
  SELECT *, CASE WHEN pos_category IS NULL THEN 'invalid_positive' WHEN neg_ = pos_category THEN 'auto_corrected_same' WHEN neg_ IS NULL THEN 'auto_corrected_invalid'
    WHEN {danger} THEN 'auto_corrected_danger' ELSE 'ok' END AS negative_status FROM l
), o(key, opposite) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in rules.OPPOSITE.items())})
SELECT p_partkey, positive, negative, pos_category, CASE WHEN negative_status LIKE 'auto%' THEN coalesce(opposite, 'AMB-ROOM-TONE') ELSE neg_ END AS neg_category, negative_status
FROM s LEFT JOIN o ON o.key = s.pos_category
"""


def category_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = inputs.table(spark, sf_dir, "part").select(
        "p_partkey", inputs.by_number(KEYS, k % 38).alias("key"), F.when(k % 3 == 0, "").otherwise("Day").alias("time"), F.when(k % 4 == 0, "Indoor Close").otherwise("").alias("perspective")
    )
    joined = rows.join(F.broadcast(rules.vocabulary(spark)), "key", "left")
    return joined.select("p_partkey", "key", tx.query_text(*(F.col(c) for c in ("key", "sub", "cat", "descr", "time", "perspective"))).alias("query"))


def _values(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CATEGORY_SQL = f"""
WITH v(key, cat, sub, catid, descr) AS (VALUES {", ".join("(" + ", ".join(map(_values, (k, *v))) + ")" for k, v in rules.VOCABULARY.items())}),
r AS (
  SELECT p_partkey, ({sql_list(KEYS)})[p_partkey % 38 + 1] AS key, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'day' END AS time, CASE WHEN p_partkey % 4 = 0 THEN 'indoor close' END AS perspective FROM part
)
SELECT p_partkey, r.key, CASE WHEN sub IS NULL THEN replace(lower(r.key), '-', ' ') ELSE concat_ws(' ', lower(sub), lower(cat), string_split(lower(descr), ',')[1], time, perspective) END AS query
FROM r LEFT JOIN v ON v.key = r.key
"""


def opposite_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opposed category, what its negative query says, and the scopes' sizes of each vocabulary entry."""
    joined = rules.vocabulary(spark)
    for table in (rules.opposite(spark), rules.scope(spark), rules.negative_text(spark), rules.narrow_scope(spark)):
        joined = joined.join(table.withColumnRenamed("category", "key"), "key", "left")
    negative, size = F.coalesce("negative", F.lit(rules.ROOM_TONE)), lambda c: F.coalesce(F.size(c), F.lit(0))
    return joined.select("key", "catid", negative.alias("negative"), F.coalesce("text", F.replace(F.lower(negative), F.lit("-"), F.lit(" "))).alias("negative_text"), size("allowed").alias("scope_size"), size("narrow").alias("narrow_size"))


def _opposite_row(k: str, v: tuple) -> str:
    negative = rules.OPPOSITE.get(k, rules.ROOM_TONE)
    told = rules.NEGATIVE_TEXT.get(k, negative.lower().replace("-", " "))
    return f"('{k}', '{v[2]}', '{negative}', '{told}', {len(rules.SCOPE[k]) + 1 if k in rules.SCOPE else 0}, {len(rules.SUB_INDEX.get(k, []))})"


OPPOSITE_SQL = f"""
WITH v(key, catid, negative, negative_text, scope_size, narrow_size) AS (VALUES {", ".join(_opposite_row(k, v) for k, v in rules.VOCABULARY.items())})
SELECT key, catid, negative, negative_text, scope_size::INTEGER AS scope_size, narrow_size::INTEGER AS narrow_size FROM v
"""


def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = inputs.table(spark, sf_dir, "events"), F.col("event_id")
    raw = F.when(n % 4 == 0, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" bye"))).when(n % 4 == 1, F.concat("props", F.lit(" then "), "props")).when(n % 4 == 2, F.lit("none")).otherwise(F.col("props"))
    rows = e.select("event_id", tx.salvage_json(raw).alias("j"))
    return rows.select("event_id", F.col("j").isNotNull().alias("parsed"), F.get_json_object("j", "$.k").alias("k"))


JSON_SQL = """
WITH r AS (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Sure: ' || props || ' bye' WHEN 1 THEN props || ' then ' || props WHEN 2 THEN 'none' ELSE props END AS raw FROM events
), x AS (SELECT event_id, regexp_extract(raw, '(?s)\\{.*\\}') AS j FROM r),
g AS (SELECT event_id, CASE WHEN j <> '' AND json_valid(j) THEN j END AS j FROM x)
SELECT event_id, j IS NOT NULL AS parsed, json_extract_string(j, '$.k') AS k FROM g
"""


def tags_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.table(spark, sf_dir, "part")
    raw = F.array(F.lit("Rain<2sec"), F.lit("The"), F.col("p_name"), F.lower("p_name"), F.lit("ok"), F.col("p_type"), F.concat(F.lit("wind! "), F.col("p_brand")), F.lit("> 5 bars"), F.lit("it’s"))
    wide = F.concat(F.lit("ﬁre "), F.translate(F.lower("p_brand"), "abdnr", "ａｂｄｎｒ"))  # a ligature, full-width letters
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.array(wide, F.lit("Ｒａｉｎ")), raw)).otherwise(raw)
    return p.select("p_partkey", F.array_join(tx.tags(raw, 6), "|").alias("tags"))


TAGS_SQL = f"""
WITH r AS (
  SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ['fire ' || p_brand, 'rain'] ELSE [] END || ['Rain<2sec', 'The', p_name, lower(p_name), 'ok', p_type, 'wind! ' || p_brand, '> 5 bars', 'it’s'] AS raw FROM part
), c AS (
  SELECT p_partkey, list_transform(raw, lambda t: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(t)), '’', ''''), '<\\s*(\\d)', 'under \\1', 'g'), '>\\s*(\\d)', 'over \\1', 'g'),
    '[^a-z0-9 ''-]', '', 'g'), ' +', ' ', 'g'))) AS tags FROM r
), k AS (
  SELECT p_partkey, list_filter(tags, lambda t: length(t) > 2 AND NOT list_contains({sql_list(rules.STOP_WORDS)}, t)) AS tags FROM c
)
SELECT p_partkey, array_to_string(list_filter(tags, lambda t, i: list_position(tags, t) = i)[1:6], '|') AS tags FROM k
"""


def layer_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = inputs.table(spark, sf_dir, "part"), F.col("p_partkey")
    layer = lambda d, w: F.struct(d.alias("description"), w.cast("string").alias("weight"))
    rows = p.select(
        "p_partkey", F.when(k % 4 == 0, F.concat(F.lit(" "), F.col("p_name"))).alias("d"),
        F.array(layer(F.col("p_type"), k % 3), layer(F.lit(" "), F.lit(9)), layer(F.col("p_brand"), k % 5), layer(F.lit("hum"), F.lit("loud")), layer(F.lit("air"), F.lit(1))).alias("l"),
    )
    return rows.select("p_partkey", tx.description_or_layers(F.col("d"), F.col("l")).alias("description"))


LAYERS_SQL = """
WITH l AS (
  SELECT p_partkey, p_name, unnest([p_type, p_brand, 'hum', 'air']) AS d, unnest([p_partkey % 3, p_partkey % 5, 0, 1]) AS w, unnest([0, 2, 3, 4]) AS i FROM part
), r AS (
  SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY w DESC, i) AS n FROM l
)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN any_value(p_name) ELSE string_agg(d, ' ' ORDER BY n) FILTER (WHERE n <= 3) END AS description FROM r GROUP BY p_partkey
"""

MODELS = ["Qwen-9B-Q6_K.gguf", "model-4B-BF16.gguf", "vl-3b-Instruct-Q4_K_M.gguf", "plain-q8_0.gguf", "tiny-q2_k.gguf", "big-72B-q5_k.gguf"]


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = inputs.table(spark, sf_dir, "part"), F.col("p_partkey")
    folder = F.concat(F.lit("/m/"), F.floor(k / 10).cast("string"))
    base = p.select(folder.alias("folder"), F.concat(folder, F.lit("/"), k.cast("string"), F.lit("-"), inputs.by_number(MODELS, k % 6)).alias("path"), (F.col("p_size").cast("long") * 150_000_000).alias("size"), F.lit(False).alias("is_projector"))
    bare = F.floor(k / 10) % 20 == 7  # a folder whose projectors lie elsewhere
    proj = p.select(F.when(bare, "/elsewhere").otherwise(folder).alias("folder"), F.concat(folder, F.lit("/mmproj-"), k.cast("string"), F.lit(".gguf")).alias("path"), F.col("p_size").cast("long").alias("size"), F.lit(True).alias("is_projector"))
    return base.union(proj)


def model_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.rank_models(_models(spark, sf_dir)).select("folder", "base", "projector", "model_rank", "place")


MODEL_SQL = f"""
WITH f AS (
  SELECT '/m/' || (p_partkey // 10) AS folder, '/m/' || (p_partkey // 10) || '/' || p_partkey || '-' || ({sql_list(MODELS)})[p_partkey % 6 + 1] AS base,
    '/m/' || (p_partkey // 10) || '/mmproj-' || p_partkey || '.gguf' AS projector, p_size::BIGINT * 150000000 AS size, p_size::BIGINT AS psize, p_partkey // 10 % 20 <> 7 AS has FROM part
), b AS (
  SELECT folder, arg_max(base, (size, base)) AS base, arg_max(projector, (psize, projector)) FILTER (WHERE has) AS projector, max(size) AS size FROM f GROUP BY folder
), n AS (
  SELECT *, lower(string_split(base, '/')[-1]) AS name, size / 1073741824.0::DOUBLE AS gb FROM b WHERE projector IS NOT NULL
), s AS (
  SELECT *, round(CASE WHEN regexp_extract(name, '(\\d+\\.?\\d*)\\s*b', 1) <> '' THEN regexp_extract(name, '(\\d+\\.?\\d*)\\s*b', 1)::DOUBLE WHEN gb > 5 THEN 7 WHEN gb > 2.5 THEN 4 WHEN gb > 1.5 THEN 3 ELSE 1.5 END
    * CASE {" ".join(f"WHEN contains(name, '{m}') THEN {q}::DOUBLE" for m, q in rules.QUANTISATION)} ELSE 1.0 END, 6) AS model_rank FROM n
)
SELECT folder, base, projector, model_rank, (row_number() OVER (ORDER BY model_rank DESC, folder))::INTEGER AS place FROM s
"""


def scene_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scenes, with analyses in several shapes or none; the nested fields as text."""
    sc = inputs.scenes(spark, sf_dir)
    key = F.col("event_id").cast("int")
    scenes = sc.select(
        key.alias("scene_id"), F.lit("a").alias("start"), F.lit("b").alias("end"), F.lit(None).cast("int").alias("start_frame"), F.lit(None).cast("int").alias("end_frame"),
        ((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("duration"), F.struct(F.col("is_blank").alias("is_blank")).alias("blank_info"),
    )
    good = F.concat(F.lit('{"sound_description":" rain on '), F.col("event_type"), F.lit('","tags":["Rain","rain","the","'), F.col("event_type"), F.lit('"],"mood":"calm","intensity":'), F.round(F.col("value") / 50, 3).cast("string"), F.lit("}"))
    layered = F.lit('{"sound_layers":[{"type":"","description":"hum","weight":0.2},{"description":"birds ","weight":"3"}],"intensity":"high"}')
    raw = F.when(key % 5 == 0, good).when(key % 5 == 1, F.to_json(F.struct(F.concat(F.lit("Here: "), good).alias("raw_response")))).when(key % 5 == 2, F.lit('{"error":"x","mood":"lost"}')).when(key % 5 == 3, layered)
    # a negative scene_id is that of no scene
    analyses = sc.select(F.when(key % 5 == 4, -1 - key).otherwise(key).alias("scene_id"), F.lit(1).alias("ord"), raw.alias("analysis")).union(sc.select(F.when(key % 5 == 0, key).otherwise(-1 - key), F.lit(0), F.lit('{"mood":"old"}')))
    frames = sc.select(F.when(key % 2 == 0, key).otherwise(-1 - key).alias("scene_id"), F.lit(0).alias("ord"), F.format_string("scene_%02d.jpg", key).alias("frame_path"))
    out = scenemap.scene_map(scenes, analyses, frames)
    layers = F.array_join(F.transform("sound_layers", lambda l: F.concat_ws(":", l["type"], l["description"], F.round(l["weight"], 3).cast("string"))), ";")
    return out.select(
        "scene_id", vx.rounded(F.col("duration"), 3).alias("duration"), "frame_path", "sound_description", F.array_join("tags", "|").alias("tags"), "mood", vx.rounded(F.col("intensity")).alias("intensity"),
        layers.alias("layers"), "duration_flexibility", "loop_acceptable", "is_blank",
    )


SCENE_MAP_SQL = f"""
WITH {inputs.SCENES_SQL}, s AS (
  SELECT event_id::INTEGER AS scene_id, round((end_ms - start_ms) / 1000.0::DOUBLE, 3) AS duration, is_blank, event_type, value, event_id % 5 AS n FROM sc
)
SELECT scene_id, duration, CASE WHEN scene_id % 2 = 0 THEN printf('scene_%02d.jpg', scene_id) END AS frame_path,
  CASE WHEN n IN (0, 1) THEN 'rain on ' || event_type WHEN n = 3 THEN 'birds hum' ELSE '' END AS sound_description,
  CASE WHEN n IN (0, 1) THEN 'rain|' || event_type ELSE '' END AS tags, CASE WHEN n IN (0, 1) THEN 'calm' ELSE '' END AS mood,
  CASE WHEN n IN (0, 1) THEN round(greatest(0, least(1, round(value / 50, 3))), 6) ELSE 0.5 END AS intensity,
  CASE WHEN n = 3 THEN 'ambience:hum:0.2;ambience:birds:1.0' ELSE '' END AS layers,
  CASE WHEN duration < 1 THEN 'exact' WHEN duration < 5 THEN 'strict' WHEN duration < 15 THEN 'loose' ELSE 'any' END AS duration_flexibility, duration > 5 AS loop_acceptable, is_blank
FROM s
"""


def description_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category that the words of made-up sentences hint at, one for each turn."""
    words = [p for p, _ in rules.DESCRIPTION_HINTS] + ["nothing"]
    c = inputs.table(spark, sf_dir, "conversations")
    n = (F.col("conv_id") * 3 + F.col("turn")) % 15
    text = F.concat(F.lit("By the "), inputs.by_number(words, n), F.lit(" and the "), inputs.by_number(words, (n * 4 + 2) % 15))
    return c.select("conv_id", "turn", tx.category_of_description(text).alias("category"))


def _description_sql() -> str:
    words = sql_list([p for p, _ in rules.DESCRIPTION_HINTS] + ["nothing"])
    return f"""
WITH t AS (SELECT conv_id, turn, 'by the ' || ({words})[(conv_id * 3 + turn) % 15 + 1] || ' and the ' || ({words})[((conv_id * 3 + turn) % 15 * 4 + 2) % 15 + 1] AS d FROM conversations)
SELECT conv_id, turn, CASE {" ".join(f"WHEN contains(d, '{p}') THEN '{v}'" for p, v in rules.DESCRIPTION_HINTS)} ELSE 'AMB-ROOM-TONE' END AS category FROM t
"""


def conversation_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category that the words of whole conversation texts hint at."""
    return inputs.table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.category_of_description(F.col("text")).alias("category"))


CONVERSATION_SQL = f"""
SELECT conv_id, turn, CASE {" ".join(f"WHEN contains(lower(text), '{p}') THEN '{v}'" for p, v in rules.DESCRIPTION_HINTS)} ELSE 'AMB-ROOM-TONE' END AS category FROM conversations
"""


def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display names, stems, project names and URLs of made-up paths, one for each page."""
    p = inputs.table(spark, sf_dir, "pages")
    path = F.concat(F.lit("/v/My Film ("), F.col("page_id").cast("string"), F.lit(").cut.mp4"))
    return p.select("page_id", tx.basename(path).alias("name"), tx.stem(path).alias("stem"), tx.project_name(path).alias("project"), tx.file_url(path).alias("url"))


FILE_SQL = """
SELECT page_id, 'My Film (' || page_id || ').cut.mp4' AS name, 'My Film (' || page_id || ').cut' AS stem, 'My_Film__' || page_id || '_.cut' AS project, 'file:///v/My Film (' || page_id || ').cut.mp4' AS url FROM pages
"""


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display names, stems, project names and URLs of whole page addresses taken as paths."""
    url = F.col("url")
    return inputs.table(spark, sf_dir, "pages").select("page_id", tx.basename(url).alias("name"), tx.stem(url).alias("stem"), tx.project_name(url).alias("project"), tx.file_url(url).alias("url"))


PAGE_SQL = r"""
WITH n AS (SELECT page_id, url, string_split(url, '/')[-1] AS name FROM pages), s AS (SELECT *, regexp_replace(name, '(.)\.[^.]*$', '\1') AS stem FROM n)
SELECT page_id, name, stem, translate(stem, ' ()', '___') AS project, 'file://' || CASE WHEN starts_with(url, '/') THEN '' ELSE '/' END || url AS url FROM s
"""

QUERIES = {
    "captions": captions,
    "vlm_parse": vlm_parse,
    "posneg_parse_validate": posneg_parse_validate,
    "category_query_text": category_query_text,
    "opposite_category": opposite_category,
    "json_salvage": json_salvage,
    "tags_extract": tags_extract,
    "layer_description": layer_description,
    "model_rank": model_rank,
    "scene_map": scene_map,
    "description_categories": description_categories,
    "conversation_categories": conversation_categories,
    "file_labels": file_labels,
    "page_labels": page_labels,
}

ORACLE_SQL = {
    "captions": CAPTIONS_SQL,
    "vlm_parse": VLM_SQL,
    "posneg_parse_validate": _posneg_sql(),
    "category_query_text": CATEGORY_SQL,
    "opposite_category": OPPOSITE_SQL,
    "json_salvage": JSON_SQL,
    "tags_extract": TAGS_SQL,
    "layer_description": LAYERS_SQL,
    "model_rank": MODEL_SQL,
    "scene_map": SCENE_MAP_SQL,
    "description_categories": _description_sql(),
    "conversation_categories": CONVERSATION_SQL,
    "file_labels": FILE_SQL,
    "page_labels": PAGE_SQL,
}
