"""Idempotent, dry-run delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text


def resend_approved(reason: Column, approver: Column) -> Column:
    return text.present(reason) & text.present(approver)


def plan(messages: DataFrame, history: DataFrame) -> DataFrame:
    """``messages`` with idempotency_key, attempt_no and delivery_error.

    messages: briefing_id, channel, markdown, resend_reason, resend_approved_by; history:
    idempotency_key, attempt_no.  A key that was tried before needs an approved reason.
    """
    row = messages.withColumn("content_hash", F.sha2("markdown", 256)).withColumn("idempotency_key", text.idempotency_key(F.col("briefing_id"), F.col("channel"), F.col("content_hash")))
    last = history.groupBy("idempotency_key").agg(F.max(F.coalesce("attempt_no", F.lit(1))).alias("_last"))
    row = row.join(last, "idempotency_key", "left")
    ok = F.col("_last").isNull() | resend_approved(F.col("resend_reason"), F.col("resend_approved_by"))
    error = F.when(F.col("idempotency_key").isNull(), "invalid_idempotency_key").when(~ok, "resend_approval_required")
    return row.withColumn("delivery_error", error).withColumn("attempt_no", F.when(error.isNull(), F.coalesce("_last", F.lit(0)) + 1)).drop("_last")


def dry_run(planned: DataFrame, now: Column, limit: int = 4096) -> DataFrame:
    """Delivery rows of what would be sent: masked text, its chunks, and the name of the artifact."""
    masked = text.mask_secrets("markdown")
    out = planned.where("delivery_error IS NULL").withColumn("message", masked)
    return out.select(F.sha2(F.concat_ws("|", "idempotency_key", F.col("attempt_no").cast("string")), 256).alias("delivery_id"), "briefing_id", "channel", "idempotency_key", "content_hash", "attempt_no", now.alias("attempted_at"), F.lit("dry_run").alias("status"), F.concat(F.lit("message-"), F.sha2("message", 256)).alias("artifact"), text.chunk_message("message", limit).alias("chunks"))


def upsert(deliveries: DataFrame, new: DataFrame) -> DataFrame:
    """``deliveries`` with the rows of ``new`` in place of those that share a key."""
    return deliveries.join(new.select("idempotency_key"), "idempotency_key", "left_anti").unionByName(new.select(*deliveries.columns))
