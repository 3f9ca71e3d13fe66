"""Local sinks: alerts, operational reports, report archives, dry-run messages and audit rows.

A sink writes only what its folder does not hold yet, by id, so a replay adds nothing; what is stored
wins.  Ids are compared by a join with the stored ids alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import lint


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether anything lies at ``folder``, on whatever file system it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def append_absent(rows: DataFrame, folder: str, key: str, form: str = "parquet") -> None:
    """Append the rows whose ``key`` the folder lacks, one for each key; null keys are left out."""
    new = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
    if exists(rows.sparkSession, folder):
        stored = rows.sparkSession.read.schema(new.select(key).schema).format(form).load(folder)
        new = new.join(stored.select(key), key, "left_anti").select(*new.columns)
    new.write.mode("append").format(form).save(folder)


def write_alerts(alerts: DataFrame, folder: str) -> None:
    """Alerts as JSON lines, secrets in their strings masked."""
    masked = [text.mask_secrets(f.name).alias(f.name) if f.dataType.typeName() == "string" and f.name != "alert_id" else F.col(f.name) for f in alerts.schema]
    append_absent(alerts.select(*masked), folder, "alert_id", "json")


def checked_reports(reports: DataFrame, markdown: str = "markdown", given: Column | None = None, window: str = "window_id") -> DataFrame:
    """``reports`` with report_id, masked markdown and archive_error (a banned phrase, or null)."""
    masked = reports.withColumn(markdown, text.mask_secrets(markdown))
    name = text.report_id(F.lit(None).cast("string") if given is None else given, F.col(window).cast("string"))
    return masked.withColumn("report_id", name).withColumn("archive_error", F.when(~lint.is_clean(F.col(markdown)), "banned_phrase"))


def archive_texts(rows: DataFrame, folder: str, key: str, markdown: str = "markdown") -> None:
    """One folder ``key=...`` of text for each row with a safe name and without archive_error.

    The same name is written anew and others stay, so a text can be archived again.
    """
    good = rows.where(text.safe_segment(key))
    if "archive_error" in rows.columns:
        good = good.where("archive_error IS NULL")
    out = good.select(F.coalesce(markdown, F.lit("")).alias("value"), key)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).text(folder)


def archive_reports(reports: DataFrame, folder: str, markdown: str = "markdown") -> DataFrame:
    """Write operational reports; gives report_id and archive_error of each."""
    checked = checked_reports(reports, markdown)
    archive_texts(checked, folder, "report_id", markdown)
    return checked.select("report_id", "archive_error")


def write_messages(sent: DataFrame, folder: str) -> None:
    """Chunks of dry-run messages, a row for each, under the artifact's name; equal messages once."""
    chunks = sent.dropDuplicates(["artifact"]).select("artifact", F.posexplode("chunks").alias("chunk", "body"))
    append_absent(chunks.select(F.concat_ws(":", "artifact", "chunk").alias("chunk_id"), "artifact", "chunk", "body"), folder, "chunk_id", "json")


def record_runs(audit: DataFrame, folder: str, by: Sequence[str] = ("model_name", "prompt_version", "document_version_id", "input_hash", "started_at")) -> None:
    """Append audit rows of model calls; a call is one row however often it is replayed."""
    run = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in by]), 256)
    append_absent(audit.withColumn("llm_run_id", run), folder, "llm_run_id")
