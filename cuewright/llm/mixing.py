"""Op 10: mix sources to target weights by Pareto order sampling.

Targets: sources share all words by weight; a target stops at ``CAP`` times its source's size
and the excess goes to the others by weight, which ends in min(cap, weight * level) for one
level, found from running sums over the sources in order of cap / weight.

Sampling: a source takes floor(target / size) certain whole copies of every document and, for
the rest, a sample without replacement whose size in words is fixed: documents are ranked by
their random odds u / (1 - u) over their inclusion odds p / (1 - p) and taken in that order up
to the first that exceeds the words still wanted.  From there it goes on, ``ROUNDS`` times in all, with the documents behind that
still fit; the last place goes to the document, among all not taken, that brings the sum nearest to the target (or to
none).  u is a hash of the document, so reruns agree.
p is the same for all documents of a source, which are ranked apart from those of others, so the order within a
source is that of u: a simple random order.

Where a round ends in a source is found without ordering it as a whole: rank keys fall into
equal-width buckets (a monotone map), words are summed by bucket, and only the bucket in which
the wanted words are reached is put in order.  Bucket counts follow the source's documents, so
that this bucket holds about ``IN_ORDER`` documents for a source of any size; how many there are changes no result.
The last place is a minimum by source, partial before its shuffle.

Sources are a dimension: one row a source (not a document) meets in one task, where targets are found.  That
holds for some millions of sources.

Defined results: a null text has size 0; a null source is a source, and comes last; a null
doc_id is a document by its size; rows that share source, doc_id and size share one draw (all are
taken, or none); a source without words has target 0; other columns pass through whatever their names, but for
``source_size``, ``target`` and ``copies``, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAP = 3
WEIGHTS = (1, 2, 3)
IN_ORDER = 4096
ROUNDS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(seed: int = 10) -> Column:
    """A number in (0, 1) that is a function of the document alone."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long").cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row a source: n_docs, source_size, target.  Windows here see one row a source."""
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int")).cast("long"))
    # a source is at its cap if the level that all sources from it on would share is at least its own cap / weight
    ratio = F.col("source_size") * cap / F.col("weight")
    order = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before, from_here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    per = per.withColumn("_total", F.sum("source_size").over(every))
    per = per.withColumn("_level", (F.col("_total") - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))) / F.sum("weight").over(from_here))
    per = per.withColumn("_at_cap", F.col("_level") * F.col("weight") >= F.col("source_size") * cap)
    level = F.min(F.when(~F.col("_at_cap"), F.struct(ratio, F.col("source").isNull(), "source", "_level"))).over(every)["_level"]
    target = F.when(F.col("_at_cap"), (F.col("source_size") * cap).cast("double")).otherwise(level * F.col("weight"))
    return per.select("source", "n_docs", "source_size", target.alias("target"))


def plan(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """targets() with the certain copies, the inclusion probability and the words still wanted."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        targets(sizes, weights, cap)
        .withColumn("copies", whole)
        .withColumn("wanted", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("p", F.when(F.col("source_size") > 0, F.col("wanted") / F.col("source_size")).otherwise(F.lit(0.0)))
    )


def _key() -> Column:
    """The order of documents within a source."""
    return F.struct("q", F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("d"), "size")


def _sampled(steps: Column) -> Column:
    """Whether a document's key is between the two ends of one of its source's rounds, and its size one that fitted there."""

    def held(step: Column) -> Column:
        above, below = F.coalesce(F.col("key") > step["low"], F.lit(True)), F.coalesce(F.col("key") < step["high"], F.lit(True))
        return above & below & (F.col("size") <= step["most"])

    return F.exists(steps, held)


def _with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``rows`` with their source's line of ``per_source`` (null-safe); a source may hold any share of the rows."""
    return common.spread_join(rows, per_source, ["source"], ["doc_id", "size"])


def _ranked(sizes: DataFrame, per_source: DataFrame, seed: int) -> DataFrame:
    """``sizes`` with its source's plan and q, the rank key in [0, 1): q / (1 - q) is random odds over inclusion odds."""
    u, p = draw(seed), F.col("p")
    # odds(u) / odds(p) = a / b, and a / (a + b) keeps its order
    a, b = u * (F.lit(1.0) - p), (F.lit(1.0) - u) * p
    return _with_source(sizes, per_source).withColumn("q", F.when(p > 0, a / (a + b)).otherwise(F.lit(1.0)))


def _round(keys: DataFrame, state: DataFrame, in_order: int) -> DataFrame:
    """``state`` (source, gap, cut, done, steps) after one more round over ``keys`` (source, n_docs, q, key, size, words)."""
    live = common.spread_join(keys, state.filter("not done").select("source", "gap", "cut"), ["source"], ["key"])
    live = live.filter((F.col("cut").isNull() | (F.col("key") > F.col("cut"))) & (F.col("size") <= F.col("gap"))).drop("cut")
    buckets = F.ceil(F.col("n_docs") / F.lit(in_order)).cast("long")
    live = live.withColumn("bucket", F.least(F.floor(F.col("q") * buckets).cast("long"), buckets - 1))
    sums = live.groupBy("source", "bucket").agg(F.sum("words").alias("words"), F.first("gap").alias("gap"))
    running = Window.partitionBy("source").orderBy("bucket")
    sums = common.stored(sums.withColumn("upto", F.sum("words").over(running)).withColumn("before", F.col("upto") - F.col("words")), "mix-buckets")
    crossing = sums.filter((F.col("before") <= F.col("gap")) & (F.col("gap") < F.col("upto"))).select("source", "bucket", "before")
    inside = common.spread_join(live, crossing, ["source", "bucket"], ["key"])
    order = Window.partitionBy("source").orderBy("key")
    inside = inside.withColumn("upto", F.col("before") + F.sum("words").over(order)).withColumn("taken", F.col("upto") <= F.col("gap"))
    ends = inside.groupBy("source").agg(F.min(F.when(~F.col("taken"), F.col("key"))).alias("high"), F.coalesce(F.max(F.when(F.col("taken"), F.col("upto"))), F.first("before")).alias("got"))
    # where no bucket crosses, all that fit are taken
    every = sums.groupBy("source").agg(F.max("upto").alias("all"))
    found = every.join(ends.withColumnRenamed("source", "_e"), F.col("source").eqNullSafe(F.col("_e")), "left").select(F.col("source").alias("_s"), "all", "high", "got")
    step = F.struct(F.col("cut").alias("low"), "high", F.col("gap").alias("most"))
    joined = state.join(found, F.col("source").eqNullSafe(F.col("_s")), "left")
    return joined.select(
        "source",
        (F.col("gap") - F.coalesce("got", "all", F.lit(0))).alias("gap"),
        F.coalesce("high", "cut").alias("cut"),
        (F.col("done") | F.col("high").isNull()).alias("done"),
        F.when(F.col("all").isNull(), F.col("steps")).otherwise(F.concat("steps", F.array(step))).alias("steps"),
    )


KEY = "struct<q:double,d:bigint,size:bigint>"


def thresholds(sizes: DataFrame, per_source: DataFrame, seed: int = 10, in_order: int = IN_ORDER, rounds: int = ROUNDS) -> DataFrame:
    """One row a source: the rounds' ``steps`` (see ``_sampled``), and the key that takes the last place, ``end``."""
    ranked = _ranked(sizes, per_source, seed).filter("p > 0 and size > 0").withColumn("key", _key())
    # rows that share a key are one step of the order
    keys = common.stored(ranked.groupBy("source", "n_docs", "q", "key", F.col("key.size").alias("size")).agg(F.sum("key.size").alias("words")), "mix-keys")
    none = F.array().cast(f"array<struct<low:{KEY},high:{KEY},most:double>>")
    state = per_source.filter("p > 0").select("source", F.col("wanted").alias("gap"), F.lit(None).cast(KEY).alias("cut"), F.lit(False).alias("done"), none.alias("steps"))
    state = common.stored(state, "mix-state")
    for _ in range(rounds):
        state = common.stored(_round(keys, state, in_order), "mix-round")
    left = common.spread_join(keys, state, ["source"], ["key"]).filter(~_sampled(F.col("steps")))
    miss = F.abs(F.col("gap") - F.col("words"))
    end = left.filter(miss < F.col("gap")).groupBy(F.col("source").alias("_s")).agg(F.min(F.struct(miss.alias("miss"), "key"))["key"].alias("end"))
    return state.join(end, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "steps", "end")


def mix(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = 10) -> DataFrame:
    """``sizes`` (doc_id, source, size, any more) with source_size, target and copies for each row."""
    rows = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), F.col("size").cast("long").alias("size"), F.struct(*sizes.columns).alias("row"))
    narrow = common.stored(rows.drop("row"), "mix-sizes")
    per_source = common.stored(plan(narrow, weights, cap), "mix-plan")
    cuts = common.stored(thresholds(narrow, per_source, seed), "mix-cuts").withColumnRenamed("source", "_source")
    per_source = per_source.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    ranked = _ranked(rows, common.stored(per_source, "mix-per-source"), seed).withColumn("key", _key())
    sampled = F.when((F.col("p") <= 0) | (F.col("size") <= 0), False).otherwise(F.coalesce(_sampled(F.col("steps")) | F.coalesce(F.col("key") == F.col("end"), F.lit(False)), F.lit(False)))
    added = ("source_size", "target", "copies")
    kept = [F.col("row").getField(c).alias(c) for c in sizes.columns if c not in added]
    return ranked.withColumn("copies", F.col("copies") + sampled.cast("long")).select(*kept, *added)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    sizes = common.stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-docs")
    return mix(sizes).select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _round_sql(n: int) -> str:
    """A round: of what still fits behind the last end, in order, as much as the gap takes."""
    return f"""
a{n} AS (SELECT *, p > 0 AND size > 0 AND pos > cut AND size <= gap AS live FROM x{n}),
b{n} AS (SELECT *, sum(CASE WHEN live THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY pos) AS upto FROM a{n}),
x{n + 1} AS (
  SELECT * EXCLUDE (live, upto, gap, cut, chosen), gap - coalesce(sum(size) FILTER (WHERE live AND upto <= gap) OVER (PARTITION BY source), 0) AS gap,
    coalesce(min(pos) FILTER (WHERE live AND upto > gap) OVER (PARTITION BY source), 9000000000000000000) AS cut, chosen OR (live AND upto <= gap) AS chosen FROM b{n}
)"""


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s0 AS (
  SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight, (sum(source_size) OVER ())::BIGINT AS total FROM s0
), s2 AS (
  SELECT *, (total - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s1
), s3 AS (
  SELECT *, level * weight >= source_size * 3 AS at_cap FROM s2
), lvl AS (
  SELECT level FROM s3 WHERE NOT at_cap ORDER BY source_size * 3 / weight, source NULLS LAST LIMIT 1
), s4 AS (
  SELECT source, n_docs, source_size, CASE WHEN at_cap THEN (source_size * 3)::DOUBLE ELSE (SELECT level FROM lvl) * weight END AS target FROM s3
), s5 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM s4
), s6 AS (
  SELECT *, target - copies * source_size AS wanted, CASE WHEN source_size > 0 THEN (target - copies * source_size) / source_size ELSE 0 END AS p FROM s5
), r0 AS (
  SELECT d.*, s6.* EXCLUDE (source),
    (('0x' || substr(md5('10:' || coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source
), r AS (
  SELECT *, CASE WHEN p > 0 THEN (u * (1.0 - p)) / (u * (1.0 - p) + (1.0 - u) * p) ELSE 1.0 END AS q FROM r0
), x0 AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST, size) AS pos, wanted AS gap, 0 AS cut, false AS chosen FROM r
), {ROUNDS_SQL}, e AS (
  SELECT source, arg_min(doc_id, (abs(gap - size), q, doc_id)) AS end_doc FROM x{ROUNDS}
  WHERE p > 0 AND size > 0 AND NOT chosen AND abs(gap - size) < gap GROUP BY source
)
SELECT t.doc_id, t.size, t.source_size, t.target,
  ((t.copies + (t.chosen OR coalesce(t.doc_id = e.end_doc, false))::INT) * t.size)::BIGINT AS taken
FROM x{ROUNDS} t LEFT JOIN e ON t.source IS NOT DISTINCT FROM e.source
"""
SQL = SQL.replace("{ROUNDS_SQL}", ", ".join(_round_sql(n) for n in range(ROUNDS))).replace("{ROUNDS}", str(ROUNDS))
