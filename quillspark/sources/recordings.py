"""Recorded model answers, and the audit of calls.

Answers are looked up by a join: the exact hash of a prompt first, then a key of the prompt's version
and the content it was made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text


def stable_key(version: Column, content_hash: Column) -> Column:
    return F.concat_ws(":", F.lit("stable"), version, content_hash)


def complete(prompts: DataFrame, recordings: DataFrame) -> DataFrame:
    """``prompts`` (prompt, prompt_version, content_hash, document_version_id) with ``answer``.

    ``recordings`` (key, answer) has one row a key.  The placeholder for the version id is filled in.
    """
    keyed = prompts.withColumn("_exact", F.sha2("prompt", 256)).withColumn("_stable", stable_key(F.col("prompt_version"), F.col("content_hash")))
    exact = recordings.select(F.col("key").alias("_exact"), F.col("answer").alias("_a"))
    stable = recordings.select(F.col("key").alias("_stable"), F.col("answer").alias("_b"))
    out = keyed.join(exact, "_exact", "left").join(stable, "_stable", "left")
    answer = F.replace(F.coalesce("_a", "_b"), F.lit("{{document_version_id}}"), F.coalesce("document_version_id", F.lit("")))
    return out.withColumn("answer", answer).withColumn("error_class", F.when(F.col("answer").isNull(), "recording_missing")).drop("_exact", "_stable", "_a", "_b")


def audit(calls: DataFrame, price: float | None = None) -> DataFrame:
    """An audit row for each call: hashes, tokens (reported, else estimated), cost and status.

    calls: model_name, prompt_version, document_version_id, prompt, answer, input_tokens, output_tokens,
    cost, started_at, finished_at, error_class.
    """
    tokens = lambda given, c: F.coalesce(F.col(given), text.estimated_tokens(c))
    out = calls.withColumns({"input_tokens": tokens("input_tokens", "prompt"), "output_tokens": F.when(F.col("answer").isNull(), 0).otherwise(tokens("output_tokens", "answer"))})
    total = F.col("input_tokens") + F.col("output_tokens")
    cost = F.coalesce(F.col("cost"), total * price / 1000 if price is not None else F.lit(None).cast("double"))
    return out.select("model_name", "prompt_version", "document_version_id", F.sha2("prompt", 256).alias("input_hash"), F.sha2("answer", 256).alias("output_hash"), "input_tokens", "output_tokens", total.alias("total_tokens"), cost.alias("cost"), "started_at", "finished_at", F.when(F.col("error_class").isNull(), "success").otherwise("failed").alias("status"), "error_class")
