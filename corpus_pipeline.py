"""The corpus pipeline: quality rules, exact dedup, MinHash near-dedup, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame
that is written and read again; all but the last return the columns of documents. The mix repeats
documents of small sources, so the last stage returns a row for each time that one is taken.

Nulls, repeated and empty rows, very long texts and clashing columns are what each stage's operator defines; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxlake.llm import exact_dedup, minhash, mixing, quality_rules, sentencepiece_codec
from boxlake.llm.common import drop_written, read_table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality_rules.fit_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, rules)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs, words=5, threshold=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("minhash_near_dedup", near), ("mix_sources", mix), ("sentencepiece", pieces)]

#: SQL can't express the learned rules and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns; a stage's table goes when the next one's is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_written(before)
        before = docs
    return docs
