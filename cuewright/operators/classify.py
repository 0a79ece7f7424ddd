"""The classification cascade: path overrides, embedded metadata, zero-shot anchors, keyword votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright import rules
from cuewright.functions import text as tx
from cuewright.functions import vector as vx

FLOOR = 0.25


def override(path: Column) -> Column:
    return tx.first_match(F.lower(path), rules.OVERRIDES)


def keyword_vote(path: Column, embedded: Column) -> Column:
    """The catalogue id with most of its words in description and path, the first of equals; UNKNOWN without any."""
    where = F.lower(F.concat(F.coalesce(embedded, F.lit("")), F.lit(" "), path))
    votes = []
    for i, (catid, words) in enumerate(rules.KEYWORDS):
        n = sum((where.contains(w).cast("int") for w in words), F.lit(0))
        votes.append(F.struct(n.alias("n"), F.lit(-i).alias("o"), F.lit(catid).alias("catid")))
    best = F.greatest(*votes)
    return F.when(best["n"] > 0, best["catid"]).otherwise(rules.UNKNOWN)


def zero_shot(texts: DataFrame, anchors: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(key, catid, score): the anchor (ord, catid, emb) most similar to each text (key, emb), or UNKNOWN below ``floor``; rows may repeat a key.

    Anchors are a rule table: they travel as one row, and the best is an array's maximum, so that nothing is shuffled.
    """
    unit = anchors.select("ord", "catid", vx.normalised(F.col("emb")).alias("a")).agg(F.collect_list(F.struct("ord", "catid", "a")).alias("_anchors"))
    held = texts.select("key", vx.normalised(F.col("emb")).alias("v")).crossJoin(F.broadcast(unit))
    scored = F.transform("_anchors", lambda x: F.struct(vx.rounded(vx.dot(F.col("v"), x["a"])).alias("score"), (-x["ord"]).alias("o"), x["catid"].alias("catid")))
    out = held.select("key", F.array_max(scored).alias("b"))
    return out.select("key", F.when(F.col("b.score") >= floor, F.col("b.catid")).otherwise(rules.UNKNOWN).alias("catid"), F.col("b.score").alias("score"))


def classifier_text(path: Column, embedded: Column, caption: Column) -> Column:
    """The embedded description of a path that ends in ``.wav`` (lower case only), if it has one; else the caption."""
    return F.when(path.endswith(".wav") & (F.coalesce(embedded, F.lit("")) != ""), embedded).otherwise(caption)


def cascade(files: DataFrame, anchors: DataFrame, floor: float = FLOOR) -> DataFrame:
    """``files`` (path, embedded, metadata_catid, emb) with ``catid``: the first of the four stages that knows one.

    Rows that the cheap stages settle never reach the similarity stage.
    """
    early = files.withColumn("_early", F.coalesce(override(F.col("path")), F.when(F.col("metadata_catid") != "", F.col("metadata_catid"))))
    settled = early.filter("_early is not null").withColumn("catid", F.col("_early"))
    rest = early.filter("_early is null")
    shot = zero_shot(rest.select(F.col("path").alias("key"), "emb").dropDuplicates(["key"]), anchors, floor).select(F.col("key").alias("_key"), F.col("catid").alias("_shot"))
    rest = rest.join(shot, F.col("path") == F.col("_key"), "left").drop("_key")
    known = F.when(F.col("_shot") != rules.UNKNOWN, F.col("_shot"))
    rest = rest.withColumn("catid", F.coalesce(known, keyword_vote(F.col("path"), F.col("embedded")))).drop("_shot")
    return settled.unionByName(rest).drop("_early")


def best_of(models: DataFrame) -> DataFrame:
    """Model files (folder, path, size, is_projector): the largest base and projector of each folder that has both."""
    one = lambda flag: F.max_by(F.when(F.col("is_projector") == flag, F.col("path")), F.when(F.col("is_projector") == flag, F.struct("size", "path")))
    pair = models.groupBy("folder").agg(one(False).alias("base"), one(True).alias("projector"), F.max(F.when(~F.col("is_projector"), F.col("size"))).alias("size"))
    return pair.filter("base is not null and projector is not null")


def rank_models(models: DataFrame) -> DataFrame:
    """``best_of`` with rank and 1-based place, the best first."""
    ranked = best_of(models).withColumn("model_rank", vx.rounded(tx.model_rank(tx.basename(F.col("base")), F.col("size") / float(1 << 30))))
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(F.col("model_rank").desc(), "folder")))


def select_model(ranked: DataFrame, choice: str | None = None) -> DataFrame:
    """The row that a 1-based number or a part of the name picks; the best without a choice."""
    if choice is None:
        return ranked.filter("place = 1")
    if choice.isdigit():
        return ranked.filter(F.col("place") == int(choice))
    hit = ranked.filter(F.lower(tx.basename(F.col("base"))).contains(choice.lower()))
    return hit.orderBy("place").limit(1)
