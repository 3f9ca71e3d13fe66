"""The corpus pipeline: documents to packed sequences.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet in the shared folder and
read back as the next one's ``docs``.  All stages take null values in any column, empty and very long
texts, repeated rows, empty tables, and further columns of any name; what each makes of them stands with
it and with the operator that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import leaks, mil_quality, near_dup, packing, suffix_dedup
from quillspark.llm.queries import remainder, table, tokenizer_path
from quillspark.llm.store import Scratch

#: Near copies from a similarity of 0.8; a pair at 0.8 shares no band once in 10**7 cases.
NEAR = near_dup.NearDup(threshold=80, bands=56, rows=6)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; a score that ties with the threshold is accepted.

    Null and empty texts are judged as one empty passage.  Repeated rows stay or go together.
    """
    return mil_quality.keep_good(spark, docs, table(spark, sf_dir, "labels"), remainder(5) == 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id, so there are no ties.

    Null, empty and blank texts are copies of nothing.  Repeated rows become one; of rows without doc_id
    and with equal texts one stays.
    """
    return near_dup.keep_one(spark, docs, NEAR)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that a document with a smaller id holds.

    Null, empty and short texts and rows without doc_id stay as they are; a text may become empty.
    Repeated rows are cut alike.
    """
    return suffix_dedup.cut_passages(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts and rows without doc_id stay.  Repeated rows stay or go together; without items
    all stay.
    """
    return leaks.without_leaks(spark, docs, table(spark, sf_dir, "benchmark"), leaks.Leaks(short=True))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    Null and empty texts are one separator.  Repeated rows are packed as often as they come, rows without
    doc_id too; pieces of equal lengths take places in the order of their ids.
    """
    return packing.pack(spark, docs, packing.Packing(tokenizer_path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("decontamination", decontamination), ("sequences", sequences)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = scratch.cut(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = out
    return docs
