"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``.  ``run`` writes what a stage keeps to the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm import common, line_dedup, mixing, near_dedup, packing, toxicity


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5 (op 5); whole rows, unchanged."""
    model = toxicity.fit(docs.filter(common.fold() != 0), common.table(spark, sf_dir, "labels"))
    return toxicity.ordinary_only(docs, model)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more share, but for the last that holds each (op 8).

    No document is dropped; one that loses all its lines keeps the empty text, and ``n_chars``
    (where it is a column) is that of the text that stays.
    """
    kept = line_dedup.drop_common_lines(docs)
    loses = F.size("kept") < F.size("lines")
    new = {"text": F.when(loses, F.array_join("kept", "\n")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(loses, F.char_length(new["text"]).cast(kind)).otherwise(F.col("row.n_chars"))
    return kept.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id (op 6)."""
    return near_dedup.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it (op 10): its row so many times, or not at all."""
    row = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.struct(*docs.columns).alias("_row"))
    taken = mixing.mix(row).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 2048 (op 9)."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", ordinary),
    ("line_dedup", without_common_lines),
    ("near_dedup", distinct_documents),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can't express the first stage; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
