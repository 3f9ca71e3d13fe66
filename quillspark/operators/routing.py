"""Routing of scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text


def conflicting_fields(df: DataFrame) -> Column:
    """The core fields that a status column or the status map calls conflicting, in order."""
    out = []
    for field in text.CORE_FIELDS:
        parts = [F.lower(F.trim(F.col(f"{field}_status"))) == "conflicting"] if f"{field}_status" in df.columns else []
        if "field_status" in df.columns:
            parts.append(F.lower(F.trim(F.col("field_status")[field])) == "conflicting")
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.coalesce(part, F.lit(False))
        out.append(F.when(hit, F.lit(field)))
    return F.array_compact(F.array(*out))


def route(df: DataFrame, threshold: float = 60.0, least_confidence: float = 0.7, band: float = 10.0, review_high: bool = False) -> DataFrame:
    """``df`` with route_reasons and review_status: needs_review if there is a reason, else rejected.

    Reasons are a score that is missing or within ``band`` of the threshold (both ends count), a
    confidence that is missing or too low, and a conflicting core field.  A clear, confident, high score
    gives no reason and is rejected like a low one; ``review_high`` sends it to review instead.
    """
    score, confidence = text.number("value_score"), text.number("extraction_confidence")
    reasons = [
        F.when(score.isNull(), "missing_value_score").when(score.between(threshold - band, threshold + band), "borderline_score"),
        F.when(confidence.isNull() | (confidence < least_confidence), "low_extraction_confidence"),
        F.when(F.size(conflicting_fields(df)) > 0, "conflicting_core_field"),
    ]
    if review_high:
        reasons.append(F.when(score > threshold + band, "high_score"))
    out = df.withColumn("route_reasons", F.array_compact(F.array(*reasons)))
    return out.withColumn("review_status", F.when(F.size("route_reasons") > 0, "needs_review").otherwise("rejected"))
