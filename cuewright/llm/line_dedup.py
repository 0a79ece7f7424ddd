"""Op 8: drop lines that many documents share, except in the last document that holds each.

Lines are exploded with their positions as 128-bit hashes of their normalised form (white space of ASCII stripped at
both ends, A-Z lower-cased); hashes are counted by distinct documents, with partial sums before
the shuffle, so that a very common line is no hot key there.  The lines of a hash over the threshold are found by a join that
splits a line's holders into parts, or has the short table of such hashes in every task if it is small.  The positions that
a text loses are gathered by text, and the text is put together again from the positions that stay, in order: texts
are shuffled once, by document and text.

Defined results: a null or empty text is one empty line, which is never dropped (its key is
short); rows that repeat a doc_id are one document for the count and lose the same lines; rows
with a null doc_id are together one document that comes before all others; a document that
loses all its lines keeps the empty text; other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 40
MIN_DOCS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def line_key(line: Column) -> Column:
    """Stripped, with A-Z in lower case (``lower`` alone would change other letters too)."""
    x = stripped(line)
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def line_hash(key: Column) -> Column:
    """128 bits of a line's key."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(8), key).alias("b"))


def _text_hash() -> Column:
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(3), F.col("text")).alias("b"))


def counted_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t, pos, h) of the lines of ``docs`` (doc_id, text) that are long enough to count; t is the text's hash."""
    lines = docs.select("doc_id", _text_hash().alias("t"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.filter(F.char_length("line") >= MIN_CHARS).select("doc_id", "t", "pos", line_key(F.col("line")).alias("key"))
    return keys.filter(F.char_length("key") >= MIN_CHARS).select("doc_id", "t", "pos", line_hash(F.col("key")).alias("h"))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, t, gone): for each text that loses lines, their positions."""
    held = counted_lines(docs)
    per_line = held.select("h", "doc_id").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).filter(F.col("n") >= min_docs)
    common_lines = common.stored(per_line.select("h", "last"), "common-lines")
    lost = common.spread_join(held, common_lines, ["h"], ["doc_id", "t"]).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    return lost.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("gone"))


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, lines, kept): each row of ``docs`` (doc_id, text, any more) as a struct, its lines, and those that stay."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    gone = dropped_lines(rows.select("doc_id", "text"), min_docs).toDF("_doc", "_t", "gone")
    joined = rows.withColumn("t", _text_hash()).join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("t") == F.col("_t")), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    stay = F.transform(places, lambda i: F.get(F.col("lines"), i))
    return joined.select("row", lines_of(F.col("text")).alias("lines"), "gone").select("row", "lines", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(stay).alias("kept"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_common_lines(docs).select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.last AS dropped FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
