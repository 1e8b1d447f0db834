"""Corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes the documents its predecessor kept and returns documents of the same columns;
the last returns packed sequences. A stage's result is written once and read back, so a lost
executor costs at most the stage that runs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.llm import decontaminate, nearedup, packing, quality, suffixes
from weftlog.llm.base import store, table, tuned
from weftlog.operators.skew import ordered


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the divergence tests; null text does not pass.

    Rows are judged where they are read: all columns travel through the rules.
    """
    tuned(spark)
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id.

    Rows of one id and one text are one document. Where rows of one id have different texts each text
    is a document of its own, of equal ids the one with the smaller hash first, so a text only goes
    if another document stands for it. Documents without an id belong to no group and stay.
    """
    tuned(spark)
    named = docs.where(F.col("doc_id").isNotNull()).withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = store(named.select("doc_id", "__th").distinct(), "names")
    if texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        kept = nearedup.groups(named).where("kept").select("doc_id").distinct()
        # Both steps deal by doc_id, so the documents move once.
        one = named.join(kept.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    else:
        numbers = store(ordered(texts, [], ["doc_id", "__th"]).select("doc_id", "__th", "pos"), "numbers")
        numbered = named.join(numbers, ["doc_id", "__th"])
        kept = nearedup.groups(numbered.select(F.col("pos").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("pos")).distinct()
        one = numbered.join(kept, "pos", "left_semi").dropDuplicates(["doc_id", "__th"])
    return one.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


# Words of a passage that goes where it stands more than once.
PASSAGE_WORDS = 50


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages, runs of PASSAGE_WORDS words or more that also stand
    elsewhere; one that has no word left goes."""
    tuned(spark)
    rest = suffixes.without_repeated_runs(docs, PASSAGE_WORDS)
    rest = rest.withColumn("__changed", F.coalesce(F.col("__rest") != F.col("text"), F.lit(False)))
    size = F.char_length("__rest").cast(docs.schema["n_chars"].dataType)
    out = rest.withColumns({"text": F.col("__rest"), "n_chars": F.when(F.col("__changed"), size).otherwise(F.col("n_chars"))})
    return out.where(~F.col("__changed") | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    tuned(spark)
    return decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark")).where(F.size("__hits") == 0).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in length buckets and batches of a token budget."""
    tuned(spark)
    # Idle workers would hold their memos beside the JVM work of whatever runs next.
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), leave=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark leaks", benchmark_leaks),
    ("packing", packed_sequences),
]

# Hash forests, suffix runs and length buckets have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, f"stage{k + 1}")
    return docs
