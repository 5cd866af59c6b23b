"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscope.llm import (
    binary_codes, bpe, bpe_stream, chat, chat_repair, decontaminate, langid, licenses, ngram_join, pii, prefix_trie,
    suffix_dedup, warc)
from tierscope.llm.common import load


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(load(spark, sf_dir, "documents").select("doc_id", "text"),
                               load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        decontaminate.item_digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_folder(spark)
    warc.write(load(spark, sf_dir, "pages"), path)
    t = warc.transactions(warc.read(spark, path, with_payload=False))
    page_id = F.get(F.col("metadata"), F.lit(0))["fields"]["page-id"].cast("bigint")
    rows = t.select("record_id", "refers_to", "payload_bytes", "digest", "type", page_id.alias("page_id"))
    first = rows.where("type = 'response'").select(F.col("record_id").alias("refers_to"),
                                                   F.col("page_id").alias("first_page"))
    return rows.join(first, "refers_to", "left").select(
        "page_id", "payload_bytes", F.substring_index("digest", ":", -1).alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("first_page").alias("refers_to"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id bigint, turn bigint, role string, text string")
    rows = load(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").union(extra)
    return chat.digests(chat.render(chat.fold(chat.event_log(rows))))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_codes.near_duplicates(load(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(load(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(load(spark, sf_dir, "documents"), digests=True)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
    start = F.transform("places", lambda p: p.first)
    base = F.array_distinct(F.transform("places", lambda p: p.label))
    added = F.transform("blocks", lambda b: b.label)
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, added)), ",").alias("labels"),
        "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return langid.predict(docs.select("doc_id", "text"), langid.fit(docs)).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.encode(load(spark, sf_dir, "documents"),
                      public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN, digests=True)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.audited(load(spark, sf_dir, "conversations"))


def op12_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe_stream.encode(load(spark, sf_dir, "documents"),
                             public_tokenizers.path("byte_bpe_50k.json"), digests=True)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuild(load(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_benchmark_decontamination, op2_pii_surrogates, op3_warc_transactions, op4_chat_formatting,
        op5_embedding_near_dedup, op6_ngram_jaccard_join,
        op7_suffix_array_dedup, op8_license_scan, op9_language_id, op10_byte_bpe,
        op11_conversation_repair, op12_streaming_bpe, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    from tierscope.llm import oracle
    return dict(oracle.SQL)
