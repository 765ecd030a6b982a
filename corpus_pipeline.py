"""A corpus in five stages: quality rules, near duplicates, repeated runs, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns what goes on. All but the last return the
columns of `docs`; n_chars follows the text where a stage changes it. Null ids, null and empty
texts and repeated rows are treated as the operators state it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critiq.llm import decontaminate, order_minhash, quality_rules, sentencepiece_codec, substring_dedup
from critiq.llm.queries import piece_model, share_code
from critiq.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and resemble the trusted ones enough."""
    trusted = quality_rules.trusted_documents(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality_rules.score_quality(docs, trusted)
    return judged.where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    share_code(spark)
    return order_minhash.one_per_class(docs)


def repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without word runs that stand earlier in the corpus."""
    share_code(spark)
    kept = substring_dedup.remove_repeats(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by test items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_hits(decontaminate.find_hits(docs, benchmark)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, with an end id."""
    share_code(spark)
    coded = sentencepiece_codec.encode_texts(docs, piece_model())
    return coded.select(*[c for c in docs.columns if c != "ids"], "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_runs", repeated_runs),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]

#: SQL can express neither the sketches nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
