"""Extracted candidates: contract, evidence, and what may be published of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text

STATUSES = ("explicit", "inferred", "unknown", "conflicting", "not_applicable")


def contract_errors(df: DataFrame, required: tuple[str, ...] = ("candidate_id", "canonical_name")) -> Column:
    """The names of broken rules: required columns, known statuses, bounds, and that an empty core field is unknown."""
    out = [F.when(~text.present(c), F.lit(f"{c}: required")) for c in required if c in df.columns]
    for field in text.CORE_FIELDS:
        status = f"{field}_status"
        if status in df.columns:
            out.append(F.when(~F.coalesce(F.col(status), F.lit("")).isin(*STATUSES), F.lit(f"{status}: not a status")))
            if field in df.columns:
                empty = ~(text.present_list(field) if df.schema[field].dataType.typeName() == "array" else text.present(field))
                out.append(F.when(empty & (F.col(status) != "unknown"), F.lit(f"{field}: empty but not unknown")))
    if "extraction_confidence" in df.columns:
        out.append(F.when(~F.col("extraction_confidence").between(0, 1), F.lit("extraction_confidence: not in 0..1")))
    if "value_score" in df.columns:
        out.append(F.when(~F.col("value_score").between(0, 100), F.lit("value_score: not in 0..100")))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def validate(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """``candidates`` with error_class (null: valid), publishable_fields and excluded_fields.

    evidence: candidate_id, field_name, evidence_error.  A candidate needs one accepted quote at least.
    """
    good = evidence.groupBy("candidate_id").agg(F.collect_set(F.when(F.col("evidence_error").isNull(), F.col("field_name"))).alias("_fields"), F.count_if(F.col("evidence_error").isNotNull()).alias("_bad"))
    row = candidates.join(good, "candidate_id", "left").withColumn("contract_errors", contract_errors(candidates))
    fields = F.coalesce("_fields", F.array().cast("array<string>"))
    error = F.when(F.size("contract_errors") > 0, "schema_invalid").when(F.coalesce("_bad", F.lit(0)) > 0, "evidence_invalid").when(F.size(fields) == 0, "evidence_missing")
    ok = [F.when(F.array_contains(fields, f) & _usable(candidates, f), F.lit(f)) for f in text.CORE_FIELDS]
    row = row.withColumn("error_class", error).withColumn("publishable_fields", F.array_compact(F.array(*ok)))
    row = row.withColumn("excluded_fields", F.array_except(text.literals(text.CORE_FIELDS), "publishable_fields"))
    return row.withColumn("state", F.when(F.col("error_class").isNull(), "validated").otherwise("failed")).drop("_fields", "_bad")


def _usable(df: DataFrame, field: str) -> Column:
    if field not in df.columns:
        return F.lit(False)
    value = text.present_list(field) if df.schema[field].dataType.typeName() == "array" else text.present(field)
    status = F.col(f"{field}_status").isin("explicit", "inferred") if f"{field}_status" in df.columns else F.lit(True)
    recorded = ~F.coalesce(F.col("field_status")[field], F.lit("")).isin("unknown", "conflicting", "not_applicable") if "field_status" in df.columns else F.lit(True)
    return F.coalesce(value & status & recorded, F.lit(False))


def keep_supported(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """``candidates`` with core fields that no accepted quote supports set to null and unknown.

    Conflicting fields stay conflicting, and put the candidate up for review.
    """
    good = evidence.where("evidence_error IS NULL").groupBy("candidate_id").agg(F.collect_set("field_name").alias("_fields"))
    row = candidates.join(good, "candidate_id", "left").withColumn("_fields", F.coalesce("_fields", F.array().cast("array<string>")))
    new: dict[str, Column] = {}
    conflict = F.lit(False)
    for field in text.CORE_FIELDS:
        has = F.array_contains("_fields", field)
        if field in candidates.columns:
            new[field] = F.when(has, F.col(field))
        if (status := f"{field}_status") in candidates.columns:
            new[status] = F.when(has | (F.col(status) == "conflicting"), F.col(status)).otherwise("unknown")
            conflict = conflict | F.coalesce(F.col(status) == "conflicting", F.lit(False))
    if "review_status" in candidates.columns:
        new["review_status"] = F.when(conflict, "needs_review").otherwise(F.col("review_status"))
    return row.withColumns(new).drop("_fields")


def candidate_rows(answers: DataFrame, schema: str, answer: str = "answer") -> DataFrame:
    """Model answers as candidate columns: one JSON object each; what cannot be read has error_class."""
    parsed = answers.withColumn("_v", text.fenced_json(answer)).withColumn("_c", F.from_json(F.col("_v").cast("string"), schema))
    row = parsed.withColumn("error_class", F.when(F.col("_v").isNull(), "schema_invalid"))
    return row.select(*[c for c in answers.columns if c != answer], "error_class", "_c.*")


def candidate_view(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row for each candidate and core field, with its accepted quotes; fields without any stay."""
    fields = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("field_name"), F.col(f).cast("string").alias("claim") if f in candidates.columns else F.lit(None).cast("string").alias("claim")) for i, f in enumerate(text.CORE_FIELDS)])
    rows = candidates.select("candidate_id", F.explode(fields).alias("f")).select("candidate_id", "f.*")
    quotes = evidence.where("evidence_error IS NULL").groupBy("candidate_id", "field_name").agg(F.array_sort(F.collect_set("quote")).alias("quotes"))
    return rows.join(quotes, ["candidate_id", "field_name"], "left").withColumn("quotes", F.coalesce("quotes", F.array().cast("array<string>")))
