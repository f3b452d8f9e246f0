"""The queries of this subpackage: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, embedding_dedup, language_id, line_dedup, minhash, pii, sentencepiece_sampling, suffix_dedup, token_binary

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is on this machine; a path of your own serves as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_binary(spark: SparkSession, folder: str) -> DataFrame:
    return token_binary.round_trip(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = line_dedup.deduplicated(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    done = chat_format.formatted(table(spark, folder, "conversations"))
    return done.select("conv_id", "piece", "n_turns", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op5_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), similarity=(85, 100))


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, folder, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = sentencepiece_sampling.sampled(docs, vocabulary("piece_bpe_32k.model"), with_ids=False)
    return done.select("row.doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless")


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    # lang is the label that the model is fitted on, so it is no evidence; plain text declares nothing in markup
    found = language_id.identify(docs, language_id.fit(docs, "lang"), host=F.col("source"))
    return found.select("doc_id", "lang", "text_lang", F.round("confidence", 6).alias("confidence"), "accepted")


def language_id_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The same operator over web pages: declared markup language, address suffix and host."""
    model = language_id.fit(table(spark, folder, "documents"), "lang")
    found = language_id.identify(
        table(spark, folder, "pages"), model, "page_id", language_id.visible(F.col("html")), declared=language_id.declared_in(F.col("html")), suffix=language_id.suffix_of(F.col("url")), host=language_id.host_of(F.col("url"))
    )
    return found.select("page_id", "lang", "text_lang", F.round("confidence", 6).alias("confidence"), "accepted")


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffix_dedup.removal(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents").select("doc_id", "text"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_token_binary, op2_line_dedup, op3_embedding_dedup, op4_chat_format, op5_minhash_dedup, op6_decontaminate, op7_sentencepiece, op8_language_id, op9_suffix_dedup, op10_pii, language_id_pages)}
