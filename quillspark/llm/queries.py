"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import brown_lm, leaks, mil_quality, near_dup, packing, suffix_dedup, topk, toxicity, unigram, warc
from quillspark.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32 of doc_id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files lie on this machine and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.write(spark, table(spark, sf_dir, "pages")).read(payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(5) == 0)


def op3_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(5) == 0)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), packing.Packing(tokenizer_path("word_bpe_49k.json")))


def op5_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), leaks.Leaks(short=True))


def op6_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(spark, table(spark, sf_dir, "documents"), unigram.Unigram(tokenizer_path("piece_bpe_32k.model")))


def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(spark, table(spark, sf_dir, "documents"), remainder(7) == 2)


def op9_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_passages(spark, table(spark, sf_dir, "documents")).drop("kept_text")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_warc, op2_classifier_chain, op3_mil_quality, op4_best_fit_packing, op5_qgram_decontamination, op6_segment_top_k, op7_viterbi_counts, op8_brown_lm, op9_minhash_near_dup, op10_suffix_dedup)
}
