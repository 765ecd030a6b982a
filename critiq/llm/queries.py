"""The registered queries of the operators for training data: name -> function of (spark, folder)."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from critiq.llm import (
    block_neighbours,
    decontaminate,
    language_mixture,
    order_minhash,
    prefix_trie,
    quality_fm,
    quality_rules,
    ranked_search,
    sentencepiece_codec,
    shard_table,
    substring_dedup,
    url_templates,
    warc_derivatives,
)
from critiq.llm.rows import NO_ID

Query = Callable[[SparkSession, str], DataFrame]


def share_code(spark: SparkSession) -> None:
    """Let Python workers that are started in another folder import this package."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    share_code(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _digest(text) -> Column:
    return F.sha2(text.cast("binary"), 256)


def piece_model() -> str:
    """Where the vocabulary file of the queries lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.encode_texts(docs, piece_model())
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _digest(joined).alias("ids_sha256"),
        _digest(F.col("decoded")).alias("decoded_sha256"),
    )


def op2_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on the url of every page."""
    judged = url_templates.judge_urls(_table(spark, folder, "pages").select("page_id", "url"), depth=None)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def _fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op3_quality_machine(spark: SparkSession, folder: str) -> DataFrame:
    """The quality of every document; a fifth of all ids is held out from learning."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    labels = _table(spark, folder, "labels").where(_fold(5) != 0)
    scored = quality_fm.score_quality(docs, labels)
    held_out = F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted")


def op4_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata and conversion records of every page, their blocks as digests."""
    responses = warc_derivatives.responses_of_pages(_table(spark, folder, "pages"))
    return warc_derivatives.derive_records(responses).select(
        "page_id", *[c for c in warc_derivatives.RESULTS if c not in ("block", "warc_date")]
    )


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the words that stand inside windows of test items."""
    found = decontaminate.find_hits(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    items = _digest(F.array_join("items", ",")).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated")


SHARDS = [f"shard-{i:02d}" for i in range(64)]


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Slot and shard of every document, by its id."""
    docs = _table(spark, folder, "documents").select("doc_id")
    return shard_table.place(docs, SHARDS)


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document; trusted are documents labelled good and not toxic."""
    trusted = quality_rules.trusted_documents(_table(spark, folder, "labels"))
    judged = quality_rules.score_quality(_table(spark, folder, "documents"), trusted)
    return judged.select("doc_id", *quality_rules.RESULTS)


def op8_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document; a quarter of all ids is held out from learning."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    judged = language_mixture.identify_languages(docs, learn_from=_fold(4) != 2)
    held_out = F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out")
    return judged.select("doc_id", held_out, "lang_pred", "score", "languages")


def op9_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return order_minhash.with_classes(_table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "class_id"
    )


def _kept_digest(text: Column) -> Column:
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), quality_rules.BLANKS, " "))
    return _digest(words)


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the words of windows that stand earlier.

    The numbers of unchanged documents come from where they are; only changed texts are moved.
    """
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    changed = substring_dedup.changed_texts(docs)
    partly = changed.where(~F.col("copy")).select(
        F.col("id").alias("cut_id"), F.col("digest").alias("cut_digest"), "n_removed", _kept_digest(F.col("text")).alias("cut")
    )
    copies = changed.where("copy").select(F.col("id").alias("copy_id"), F.col("digest").alias("copy_digest"), "copy")
    counted = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"),
        F.xxhash64("text").alias("digest"),
        F.size(quality_rules.text_words(F.col("text"))).cast("long").alias("n_words"),
        _kept_digest(F.col("text")).alias("whole"),
    )
    found = counted.join(partly, (F.col("id") == F.col("cut_id")) & (F.col("digest") == F.col("cut_digest")), "left")
    found = found.join(copies, (F.col("id") == F.col("copy_id")) & (F.col("digest") == F.col("copy_digest")), "left")
    gone = F.coalesce("copy", F.lit(False)) & (F.col("n_words") >= substring_dedup.WINDOW)
    return found.select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, _digest(F.lit(""))).otherwise(F.coalesce("cut", "whole")).alias("kept_sha256"),
    )


#: A conversation shares fewer turns than this with the one it begins as.
SHARED_TURNS = 9


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of the trie of conversations, of which four in five begin as another one does."""
    convs = prefix_trie.conversations(_table(spark, folder, "conversations"))
    conv = F.col("conv_id")
    shared = (F.crc32(conv.cast("string").cast("binary")) % SHARED_TURNS).cast("int")
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(convs, conv - conv % 5, shared, SHARED_TURNS - 1))


def op13_block_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding")
    return block_neighbours.nearest(vectors, F.col("vec_id") % 50 == 0)


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents for every test item."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return ranked_search.rank_documents(docs, _table(spark, folder, "benchmark").select("item_id", "text"))


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_url_templates": op2_url_templates,
    "op3_quality_machine": op3_quality_machine,
    "op4_warc_derivatives": op4_warc_derivatives,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_mixture": op8_language_mixture,
    "op9_order_minhash": op9_order_minhash,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_block_neighbours": op13_block_neighbours,
}
