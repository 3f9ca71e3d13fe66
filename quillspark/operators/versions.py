"""Append-only document versions: the upsert as DataFrame rewrites.

``documents`` holds a row for each (source, canonical URL), ``versions`` a row for each content a
document ever had.  On a table format with MERGE the same frames are the source of the merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import html, text, urls

#: Columns that an observation updates where it has a value.
OBSERVED = ("original_url", "title", "author", "license", "published_at", "language", "etag", "last_modified")


def document_id(source: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws("|", source, url), 256)


def stage(items: DataFrame, canonical: Column | None = None) -> DataFrame:
    """Items with document_id, canonical_url, bodies and hashes.

    Where reading is denied there are no bodies, and the hash stands for the denial.  Content given by a
    hash keeps it, otherwise it is the hash of the inert body.
    """
    given = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    row = items.withColumn("canonical_url", urls.normalize_url("url") if canonical is None else canonical).where("canonical_url IS NOT NULL")
    row = row.withColumn("_denied", F.coalesce(given("robots_allowed"), F.lit("true")) != "true")
    row = row.withColumn("normalized_body", F.when(~F.col("_denied"), F.coalesce(given("normalized_body"), html.sanitize_html(F.coalesce(given("body"), F.lit(""))))))
    content = F.when(F.col("_denied"), text.denied_hash(F.col("source_id"), F.col("canonical_url"))).otherwise(F.coalesce(given("content_hash"), text.sha256_tagged("normalized_body")))
    body = F.when(~F.col("_denied"), F.coalesce(given("body_hash"), text.sha256_tagged(given("body"))))
    return row.withColumns({"document_id": document_id(F.col("source_id"), F.col("canonical_url")), "content_hash": content, "body_hash": body}).drop("_denied")


def same_content(a_hash: Column, b_hash: Column, a_body: Column, b_body: Column) -> Column:
    """Equal content, and equal bodies where both have one."""
    return (a_hash == b_hash) & F.coalesce(a_body == b_body, F.lit(True))


def new_versions(staged: DataFrame, versions: DataFrame, order: Sequence[str] = ("retrieved_at", "position")) -> DataFrame:
    """The versions that ``staged`` adds, numbered after those that are there.

    Content that a document ever had is no new version, even if another came between.  Of equal rows of
    one batch the first counts.
    """
    key = ["document_id", "content_hash"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    fresh = staged.withColumn("_n", first).where("_n = 1").drop("_n").join(versions.select(*key), key, "left_anti")
    last = versions.groupBy("document_id").agg(F.max("version_no").alias("_last"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(*order))
    out = fresh.join(last, "document_id", "left").withColumn("version_no", (F.coalesce("_last", F.lit(0)) + place).cast("int")).drop("_last")
    return out.withColumn("document_version_id", F.sha2(F.concat_ws("|", *key), 256))


def change_summary(versions: DataFrame) -> DataFrame:
    """``versions`` with change_summary: what differs from the version before."""
    order = Window.partitionBy("document_id").orderBy("version_no")
    have = [c for c in ("content_hash", "body_hash", "source_version_ref") if c in versions.columns]
    parts = [F.when(~F.col(c).eqNullSafe(F.lag(c).over(order)), F.lit(c.replace("_", " ") + " changed")) for c in have]
    text_ = F.concat_ws("; ", *parts)
    first = F.row_number().over(order) == 1
    return versions.withColumn("change_summary", F.when(first, "Initial version").when(text_ == "", "No content change").otherwise(F.concat(F.upper(F.substring(text_, 1, 1)), F.substring(text_, F.lit(2), F.length(text_)))))


def upsert_documents(documents: DataFrame, staged: DataFrame, order: Sequence[str] = ("retrieved_at", "position")) -> DataFrame:
    """``documents`` after a batch: the last observation of each updates what it has a value for.

    The time of the first collection is set once; maps of metadata are merged, the new value first.
    """
    last = staged.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy(*[F.desc(c) for c in order]))).where("_n = 1")
    have = [c for c in OBSERVED if c in staged.columns and c in documents.columns]
    new = last.select("document_id", F.col("source_id").alias("_source"), F.col("canonical_url").alias("_url"), F.col("content_hash").alias("_hash"), F.col("retrieved_at").alias("_at"), *[F.col(c).alias(f"_new_{c}") for c in have], *([F.col("metadata").alias("_meta")] if "metadata" in staged.columns and "metadata" in documents.columns else []))
    row = documents.join(new, "document_id", "full")
    columns = {"source_id": F.coalesce("source_id", "_source"), "canonical_url": F.coalesce("canonical_url", "_url"), "content_hash": F.coalesce("_hash", "content_hash"), "first_collected_at": F.coalesce("first_collected_at", "_at"), "last_checked_at": F.coalesce("_at", "last_checked_at")}
    columns |= {c: F.coalesce(f"_new_{c}", c) for c in have}
    if "_meta" in new.columns:
        empty = F.create_map().cast("map<string,string>")
        meta, old = F.coalesce("_meta", empty), F.coalesce("metadata", empty)
        columns["metadata"] = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(meta, k)), meta)
    return row.withColumns({k: v for k, v in columns.items() if k in documents.columns}).select(*documents.columns)


def retained(versions: DataFrame, now: Column, days: int) -> DataFrame:
    """The versions that a retention of ``days`` keeps; nothing is deleted here."""
    return versions.where(F.col("retrieved_at") >= now - F.make_dt_interval(F.lit(days)))
