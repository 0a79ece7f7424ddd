"""Queries over the sound library: retrieval, re-ranking, classification, incremental indexing, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright import rules
from cuewright.functions import text as tx
from cuewright.functions import vector as vx
from cuewright.operators import assemble, classify, library, retrieval
from cuewright.plans import inputs
from cuewright.plans.inputs import ANCHORS_SQL, LIBRARY_SQL, QUERIES_SQL, pairs_sql, sql_list

HIT = ["query_id", "rank", "path", "catid", "score", "audio_sim", "text_sim", "neg_sim"]


def _search(weight, scoped=False, negatives=False, **more):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lib, q = inputs.library(spark, sf_dir), inputs.queries(spark, sf_dir)
        neg = inputs.first_of_label(lib).select(F.col("ord").alias("query_id"), F.col("emb").alias("query_emb")) if negatives else None
        return retrieval.search(q, lib, retrieval.SearchParams(text_weight=weight, **more), neg, scoped).select(*HIT)

    return run


def _search_sql(weight, k=3, scoped=False, negatives=False, alpha=0.0, least=None, floor=5) -> str:
    ctes = [LIBRARY_SQL, QUERIES_SQL, pairs_sql(weight)]
    neg, join = "0.0::DOUBLE", ""
    if negatives:
        ctes += [ANCHORS_SQL, f"nq AS (SELECT ord AS query_id, '' AS query, '' AS category, {inputs.UNIT.format(v='v')} AS v FROM anchors)"]
        ctes += [pairs_sql(weight, "nq", "npairs"), "neg AS (SELECT path, max(base) AS neg_sim FROM npairs GROUP BY path)"]
        neg, join = "neg.neg_sim", "JOIN neg ON neg.path = pairs.path"
    if scoped:
        rows = ", ".join(f"('{c}', {sql_list([*v, rules.UNKNOWN])})" for c, v in rules.SCOPE.items())
        ctes.append(f"scope(category, allowed) AS (VALUES {rows})")
        ctes.append("marked AS (SELECT p.*, s.allowed, coalesce(list_contains(s.allowed, p.catid), false) AS ok FROM pairs p LEFT JOIN scope s ON s.category = p.category)")
        ctes.append("counted AS (SELECT *, sum(ok::INT) OVER (PARTITION BY query_id) AS n FROM marked)")
        ctes.append(f"kept AS (SELECT * FROM counted WHERE allowed IS NULL OR n < {floor} OR ok)")
    source = "kept AS pairs" if scoped else "pairs"
    ctes.append(f"scored AS (SELECT query_id, pairs.path, catid, audio_sim, text_sim, {neg} AS neg_sim, round(base - {alpha}::DOUBLE * {neg}, 6) AS score FROM {source} {join})")
    where = f"WHERE score >= {least}" if least is not None else ""
    ctes.append(f"ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM scored {where})")
    return (
        "WITH " + ",".join(ctes) + f" SELECT query_id, rank::INTEGER AS rank, path, catid, score, round(audio_sim, 6) AS audio_sim, round(text_sim, 6) AS text_sim, round(neg_sim, 6) AS neg_sim FROM ranked WHERE rank <= {k}"
    )


def rerank_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.smart_search(inputs.queries(spark, sf_dir), inputs.library(spark, sf_dir))
    return out.select("query_id", "rank", "path", "catid", "score", "original_score", "confidence", "source")


def _rerank_sql() -> str:
    scope = ", ".join(f"('{c}', {sql_list([*v, rules.UNKNOWN])})" for c, v in rules.SCOPE.items())
    wrong = ", ".join(f"('{c}', {sql_list(v)})" for c, v in rules.WRONG.items())
    return f"""
WITH {LIBRARY_SQL}, {QUERIES_SQL}, {pairs_sql(0.4)},
scope(category, allowed) AS (VALUES {scope}), wrong(category, bad) AS (VALUES {wrong}),
first AS (
  SELECT *, round(base, 6) AS original_score, row_number() OVER (PARTITION BY query_id ORDER BY round(base, 6) DESC, path) AS rr FROM pairs
), words AS (
  SELECT f.*, s.allowed, w.bad, len(list_intersect(
    list_filter(string_split(lower(query), ' '), lambda x: x <> ''),
    list_filter(string_split(lower(regexp_replace(regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', ''), '[-_.,;()]', ' ', 'g')), ' '), lambda x: x <> ''))) AS overlap
  FROM first f LEFT JOIN scope s ON s.category = f.category LEFT JOIN wrong w ON w.category = f.category WHERE rr <= 50
), again AS (
  SELECT *, round(original_score + CASE WHEN coalesce(list_contains(allowed, catid), false) AND catid <> 'UNKNOWN' THEN 0.04::DOUBLE ELSE 0 END
    + overlap * 0.02::DOUBLE - CASE WHEN coalesce(list_contains(bad, catid), false) THEN 0.12::DOUBLE ELSE 0 END, 6) AS score FROM words
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rr) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM again
)
SELECT query_id, rank::INTEGER AS rank, path, catid, score, original_score,
  CASE WHEN best > 0.45 THEN 'high' WHEN best > 0.30 THEN 'medium' ELSE 'low' END AS confidence, 'global' AS source
FROM ranked WHERE rank <= 3
"""


def zero_shot_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = inputs.library(spark, sf_dir)
    return classify.zero_shot(lib.select(F.col("vec_id").alias("key"), F.col("audio_emb").alias("emb")), inputs.first_of_label(lib))


def _shot_sql(key: str = "vec_id", name: str = "shot") -> str:
    return f"""
sims AS (
  SELECT lib.{key} AS key, anchors.ord, anchors.catid,
    round(list_inner_product({inputs.UNIT.format(v="lib.a")}, {inputs.UNIT.format(v="anchors.v")}), 6) AS score FROM lib CROSS JOIN anchors
), {name} AS (
  SELECT key, CASE WHEN score >= 0.25 THEN catid ELSE 'UNKNOWN' END AS catid, score
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, ord) AS n FROM sims) WHERE n = 1
)"""


def _files(lib: DataFrame) -> DataFrame:
    n = F.col("vec_id")
    path = F.when(n % 7 == 0, F.concat(F.lit("/lib/Car Park/"), n.cast("string"), F.lit(".wav"))).when(n % 5 == 1, F.concat(F.lit("/lib/Village walla "), n.cast("string"), F.lit(".mp3"))).otherwise(F.col("path"))
    return lib.select(
        path.alias("path"), F.when(n % 3 == 0, F.lit("Stream and river by the city")).otherwise("").alias("embedded"), F.when(n % 11 == 0, F.lit("AMBMeta")).alias("metadata_catid"), F.col("audio_emb").alias("emb")
    )


def classify_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = inputs.library(spark, sf_dir)
    return classify.cascade(_files(lib), inputs.first_of_label(lib), 0.5).select("path", "embedded", "metadata_catid", "catid")


def _cascade_sql() -> str:
    votes = ", ".join("(" + " + ".join(f"contains(w, '{x}')::INT" for x in words) + ")" for _, words in rules.KEYWORDS)
    return f"""
WITH {LIBRARY_SQL}, {ANCHORS_SQL}, {_shot_sql().replace("0.25", "0.5")},
f AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN '/lib/Car Park/' || vec_id || '.wav' WHEN vec_id % 5 = 1 THEN '/lib/Village walla ' || vec_id || '.mp3' ELSE path END AS path,
    CASE WHEN vec_id % 3 = 0 THEN 'Stream and river by the city' ELSE '' END AS embedded, CASE WHEN vec_id % 11 = 0 THEN 'AMBMeta' END AS metadata_catid FROM lib
), w AS (SELECT *, lower(embedded || ' ' || path) AS w FROM f),
v AS (SELECT *, [{votes}] AS votes FROM w)
SELECT path, embedded, metadata_catid, coalesce(
  CASE WHEN contains(lower(path), 'car park') THEN 'AMBUndr' END, metadata_catid, nullif(shot.catid, 'UNKNOWN'),
  CASE WHEN list_max(votes) > 0 THEN ({sql_list([c for c, _ in rules.KEYWORDS])})[list_position(votes, list_max(votes))] ELSE 'UNKNOWN' END) AS catid
FROM v JOIN shot ON shot.key = v.vec_id
"""


def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = inputs.library(spark, sf_dir)
    held = lib.filter("label < 5").select("path", "catid", "duration", "preset")
    fresh = library.long_enough(library.new_files(lib.select("path", "duration"), held))
    return library.extended(held, fresh).select("path", "catid", "duration", "preset")


INCREMENTAL_SQL = f"""
WITH {LIBRARY_SQL}, held AS (SELECT path, catid, duration, 'natural' AS preset FROM lib WHERE label < 5)
SELECT * FROM held UNION ALL
SELECT path, NULL, duration, NULL FROM lib WHERE duration >= 10 AND NOT EXISTS (SELECT 1 FROM held WHERE held.path = lib.path)
"""


def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = inputs.library(spark, sf_dir)
    return library.counts(lib.select("path", "duration"), lib.filter("label < 5"))


COUNTS_SQL = f"""
WITH {LIBRARY_SQL} SELECT count(*) AS found, count(*) FILTER (WHERE label >= 5) AS new,
  count(*) FILTER (WHERE label >= 5 AND duration < 10) AS skipped, count(*) FILTER (WHERE label >= 5 AND duration >= 10) AS kept FROM lib
"""

WORDS = ["rain", "wind-low", "City", "hum", "sea_a", "birds", "door", "crowd", "fan", "bell"]
SUFFIXES = ["_1", "-2", "_v3", "_take4", "_48k", "", "-48k_3"]


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = inputs.library(spark, sf_dir)
    n = F.col("vec_id")
    path = F.concat(F.lit("/l/"), inputs.by_number(WORDS, F.col("label")), inputs.by_number(SUFFIXES, n % 7), F.lit(".wav"))
    return lib.select(
        F.floor(n / 25).alias("scene_id"), (n % 25).cast("int").alias("rank"), path.alias("path"), F.round((n % 40) / F.lit(100.0), 4).alias("score"),
        F.when(n % 6 != 5, (n % 30 + 0.5).cast("double")).alias("audio_duration"), (F.floor(n / 25) % 20 + 1.25).cast("double").alias("duration"),
    )


HITS_SQL = f"""
hits AS (
  SELECT vec_id // 25 AS scene_id, (vec_id % 25)::INTEGER AS rank, '/l/' || ({sql_list(WORDS)})[label + 1] || ({sql_list(SUFFIXES)})[vec_id % 7 + 1] || '.wav' AS path,
    round((vec_id % 40) / 100.0::DOUBLE, 4) AS score, CASE WHEN vec_id % 6 <> 5 THEN (vec_id % 30 + 0.5)::DOUBLE END AS audio_duration, (vec_id // 25 % 20 + 1.25)::DOUBLE AS duration
  FROM lib
), keyed AS (
  SELECT *, trim(regexp_replace(lower(regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '')), '([-_]v?\\d+|_?\\d+k|_take\\d+)$', ''), '-_ ') AS sim_key FROM hits WHERE audio_duration IS NOT NULL AND audio_duration <> 0
), firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, sim_key ORDER BY rank, path) AS n FROM keyed) WHERE n = 1
), layers AS (
  SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY scene_id ORDER BY rank, path))::INTEGER AS track FROM firsts) WHERE track <= 3
)"""


def sim_key_dedup_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.diverse_layers(_hits(spark, sf_dir)).select("scene_id", "track", "rank", "path", "sim_key", "score")


def manifest_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.layers(_hits(spark, sf_dir))


MANIFEST_LAYERS = f"""
WITH {LIBRARY_SQL}, {HITS_SQL}, o AS (
  SELECT *, ('0x' || substr(md5(scene_id || '|' || path), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u FROM layers
), s AS (
  SELECT *, round(CASE WHEN audio_duration > duration + 10 THEN 10.0::DOUBLE + u * (audio_duration - duration - 10.0::DOUBLE) WHEN audio_duration > duration THEN (audio_duration - duration) / 2 ELSE 0.0 END, 3) AS source_start_offset FROM o
)
SELECT scene_id, track, 'Match #' || track AS layer_name, 'top3' AS layer_type, path AS source_file, source_start_offset, round(source_start_offset + duration, 3) AS source_end_offset, audio_duration,
  round(duration, 3) AS clip_duration, score, CASE WHEN score > 0.25 THEN 'high' WHEN score > 0.18 THEN 'medium' ELSE 'low' END AS confidence, 'ok' AS status,
  source_start_offset + duration > audio_duration AS beyond_media
FROM s
"""


def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    scenes = hits.select("scene_id", "duration").distinct().select(
        "scene_id", F.lit("").alias("start"), F.lit("").alias("end"), "duration", F.lit("AMB-URBAN").alias("category"), F.lit("x").alias("sound_description"), (F.col("scene_id") % 4 == 0).alias("silence_required")
    )
    return assemble.manifest(scenes, assemble.layers(hits), "/v/My Film (1).mp4", 30.0).select("project_name", "total_scenes", "scenes_with_sound", "scenes_with_layers", "silent_scenes")


MANIFEST_TOTALS = f"""
WITH {LIBRARY_SQL}, {HITS_SQL}, s AS (SELECT DISTINCT scene_id, scene_id % 4 = 0 AS silent FROM hits),
c AS (SELECT s.scene_id, silent, count(l.path) FILTER (WHERE NOT silent) AS n FROM s LEFT JOIN layers l ON l.scene_id = s.scene_id GROUP BY ALL)
SELECT 'My_Film__1_' AS project_name, count(*)::INTEGER AS total_scenes, sum(n)::INTEGER AS scenes_with_sound, (count(*) FILTER (WHERE n > 0))::INTEGER AS scenes_with_layers, (count(*) FILTER (WHERE silent))::INTEGER AS silent_scenes FROM c
"""


def exclude_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = inputs.library(spark, sf_dir)
    words = ["city", "garage", "birds", "surf", "UWT deep", "plain"]
    rows = lib.select(inputs.by_number(inputs.CATEGORIES, F.col("label")).alias("category"), F.concat(F.lit("/l/"), inputs.by_number(words, F.col("vec_id") % 6), F.lit("_"), F.col("vec_id").cast("string")).alias("path"))
    return retrieval.without_excluded(rows)


def _exclude_sql() -> str:
    rows = ", ".join(f"('{c}', '{p.lower()}')" for c, ps in rules.EXCLUDED.items() for p in ps)
    return f"""
WITH {LIBRARY_SQL}, ex(category, pattern) AS (VALUES {rows}),
f AS (SELECT ({sql_list(inputs.CATEGORIES)})[label + 1] AS category, '/l/' || (['city', 'garage', 'birds', 'surf', 'UWT deep', 'plain'])[vec_id % 6 + 1] || '_' || vec_id AS path FROM lib)
SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.category = f.category AND contains(lower(f.path), ex.pattern))
"""


def histogram_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of neighbouring groups of three vectors, as of scenes with three colour histograms each."""
    from cuewright.operators import timeline

    e = inputs.table(spark, sf_dir, "embeddings")
    scene = e.groupBy(F.floor(F.col("vec_id") / 3).alias("scene_id")).agg(F.collect_list("embedding").alias("a"))
    nxt = scene.select((F.col("scene_id") - 1).alias("scene_id"), F.col("a").alias("b"))
    return scene.join(nxt, "scene_id").select("scene_id", vx.rounded(timeline.similarity(F.col("a"), F.col("b"))).alias("similarity"))


HISTOGRAM_SQL = """
WITH u AS (SELECT vec_id, vec_id // 3 AS scene_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS bin FROM embeddings),
c AS (SELECT a.scene_id, a.vec_id AS left_id, b.vec_id AS right_id, corr(a.x, b.x) AS r FROM u a JOIN u b ON b.scene_id = a.scene_id + 1 AND b.bin = a.bin GROUP BY ALL)
SELECT scene_id, round(avg(r), 6) AS similarity FROM c GROUP BY scene_id
"""


def excluded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of each library path."""
    return inputs.library(spark, sf_dir).select("path", F.array_join(F.array_sort(tx.path_words(F.col("path"))), " ").alias("words"))


WORDS_SQL = f"""
WITH {LIBRARY_SQL}
SELECT path, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(regexp_replace(regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', ''), '[-_.,;()]', ' ', 'g')), ' '), lambda x: x <> ''))), ' ') AS words FROM lib
"""

QUERIES = {
    "vector_topk": _search(0.0),
    "hybrid_topk": _search(0.4, top_k=5),
    "negative_penalty_topk": _search(0.4, negatives=True, neg_alpha=0.3),
    "scoped_topk": _search(0.4, scoped=True),
    "scoped_topk_escape": _search(0.4, scoped=True, scope_floor=120),
    "min_score_topk": _search(0.4, top_k=50, min_score=0.15),
    "blocked_topk": _search(0.4, top_k=5, query_block=100),
    "rerank_confidence": rerank_confidence,
    "zero_shot_classify": zero_shot_classify,
    "classify_cascade": classify_cascade,
    "incremental_index": incremental_index,
    "index_counts": index_counts,
    "sim_key_dedup_top3": sim_key_dedup_top3,
    "manifest_layers": manifest_layers,
    "manifest_totals": manifest_totals,
    "exclude_patterns": exclude_patterns,
    "histogram_corr": histogram_corr,
    "path_words": excluded_words,
}

ORACLE_SQL = {
    "vector_topk": _search_sql(0.0),
    "hybrid_topk": _search_sql(0.4, 5),
    "negative_penalty_topk": _search_sql(0.4, negatives=True, alpha=0.3),
    "scoped_topk": _search_sql(0.4, scoped=True),
    "scoped_topk_escape": _search_sql(0.4, scoped=True, floor=120),
    "min_score_topk": _search_sql(0.4, 50, least=0.15),
    "blocked_topk": _search_sql(0.4, 5),
    "rerank_confidence": _rerank_sql(),
    "zero_shot_classify": f"WITH {LIBRARY_SQL}, {ANCHORS_SQL}, {_shot_sql()} SELECT key, catid, score FROM shot",
    "classify_cascade": _cascade_sql(),
    "incremental_index": INCREMENTAL_SQL,
    "index_counts": COUNTS_SQL,
    "sim_key_dedup_top3": f"WITH {LIBRARY_SQL}, {HITS_SQL} SELECT scene_id, track, rank, path, sim_key, score FROM layers",
    "manifest_layers": MANIFEST_LAYERS,
    "manifest_totals": MANIFEST_TOTALS,
    "exclude_patterns": _exclude_sql(),
    "histogram_corr": HISTOGRAM_SQL,
    "path_words": WORDS_SQL,
}
