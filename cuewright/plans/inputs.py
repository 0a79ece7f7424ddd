"""Engine inputs from the generic tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATIDS = ["AMBUrbn", "AMBForst", "AMBSea", "WATRSurf", "AMBRoom", "UNKNOWN", "AMBTraf", "WATRUndwtr", "AMBOffc", "AMBRurl"]
CATEGORIES = ["AMB-URBAN", "AMB-FOREST", "AMB-SEASIDE", "WATR-SURF", "AMB-ROOM-TONE", "AMB-HITECH", "AMB-TRAFFIC", "AMB-NAUTICAL", "AMB-OFFICE", "AMB-RURAL"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_number(values: list[str], n: Column) -> Column:
    """The value of a list at a number from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def sql_list(values: list) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sound library: vectors, a rotated second modality, catalogue ids by label, paths with two words."""
    e = table(spark, sf_dir, "embeddings")
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    joined = e.withColumn("_p", F.col("vec_id") % 200 + 1).join(names, F.col("_p") == F.col("p_partkey"))
    path = F.concat(F.lit("/lib/"), F.col("label").cast("string"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("vec_id").cast("string"), F.lit(".wav"))
    return joined.select(
        "vec_id", "label", "p_name", path.alias("path"), F.col("embedding").alias("audio_emb"),
        F.concat(F.slice("embedding", 33, 32), F.slice("embedding", 1, 32)).alias("text_emb"),
        by_number(CATIDS, F.col("label")).alias("catid"), (F.col("vec_id") % 30 + 0.5).cast("double").alias("duration"), F.lit("natural").alias("preset"),
    )


LIBRARY_SQL = f"""
lib AS (
  SELECT e.vec_id, e.label, p.p_name, '/lib/' || e.label || '/' || replace(p.p_name, ' ', '_') || '_' || e.vec_id || '.wav' AS path,
    e.embedding::DOUBLE[] AS a, (list_slice(e.embedding, 33, 64) || list_slice(e.embedding, 1, 32))::DOUBLE[] AS t,
    ({sql_list(CATIDS)})[e.label + 1] AS catid, (e.vec_id % 30 + 0.5)::DOUBLE AS duration
  FROM embeddings e JOIN part p ON p.p_partkey = e.vec_id % 200 + 1
)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each library row: its vector, its words and its label's category."""
    lib = library(spark, sf_dir)
    return lib.select(F.col("vec_id").alias("query_id"), F.col("audio_emb").alias("query_emb"), F.col("p_name").alias("query"), by_number(CATEGORIES, F.col("label")).alias("category"))


def first_of_label(lib: DataFrame) -> DataFrame:
    """The vector of each label's smallest id: anchors, and negative queries."""
    return lib.groupBy("label").agg(F.min_by("audio_emb", "vec_id").alias("emb")).select(F.col("label").alias("ord"), by_number(CATIDS, F.col("label")).alias("catid"), "emb")


UNIT = "list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"

QUERIES_SQL = f"""
q AS (
  SELECT vec_id AS query_id, {UNIT.format(v="a")} AS v, p_name AS query, ({sql_list(CATEGORIES)})[label + 1] AS category FROM lib
)"""

ANCHORS_SQL = "anchors AS (SELECT label AS ord, any_value(catid) AS catid, arg_min(a, vec_id) AS v FROM lib GROUP BY label)"


def pairs_sql(text_weight: float, q: str = "q", name: str = "pairs") -> str:
    return f"""
{name} AS (
  SELECT q.query_id, q.query, q.category, lib.path, lib.catid, list_inner_product(lib.a, q.v) AS audio_sim, list_inner_product(lib.t, q.v) AS text_sim,
    list_inner_product(lib.a, q.v) * (1 - {text_weight}::DOUBLE) + list_inner_product(lib.t, q.v) * {text_weight}::DOUBLE AS base
  FROM {q} q CROSS JOIN lib
)"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes: a user's events are a film, an event lasts to the next; errors are blank.  Times are scaled to seconds of film."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = e.withColumn("_us", us).withColumn("_first", F.first(us).over(order)).withColumn("_next", F.lead(us).over(order)).filter("_next is not null")
    ms = lambda c: F.floor((F.col(c) - F.col("_first")) / 10_000_000).cast("long")
    return e.select(
        F.col("user_id").alias("video_id"), F.row_number().over(order).alias("scene_id"), ms("_us").alias("start_ms"), ms("_next").alias("end_ms"),
        (F.col("event_type") == "error").alias("is_blank"), F.col("event_type"), F.col("value"), "event_id", "props",
    )


SCENES_SQL = """
ev AS (
  SELECT *, epoch_us(ts) AS us, first(epoch_us(ts)) OVER w AS first_us, lead(epoch_us(ts)) OVER w AS next_us FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), sc AS (
  SELECT user_id AS video_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS scene_id,
    ((us - first_us) // 10000000)::BIGINT AS start_ms, ((next_us - first_us) // 10000000)::BIGINT AS end_ms,
    event_type = 'error' AS is_blank, event_type, value, event_id, props
  FROM ev WHERE next_us IS NOT NULL
)"""


def framed(sc: DataFrame, fps: int = 30) -> DataFrame:
    """``scenes`` with frames and a duration in seconds."""
    at = lambda c: F.floor(F.col(c) * fps / 1000).cast("long")
    return sc.withColumn("start_frame", at("start_ms")).withColumn("end_frame", at("end_ms")).withColumn("duration", (F.col("end_ms") - F.col("start_ms")) / 1000.0)
