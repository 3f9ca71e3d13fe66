"""Streams of items into the version log, and state machines over streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators import metrics, states, versions


def items_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """JSON items that land as files under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def recent(items: DataFrame, time: str = "retrieved_at", late: str = "30 days", keys: tuple[str, ...] = ("source_id", "item_id", "content_hash")) -> DataFrame:
    """A stream without repeats within the allowed lateness; rows without a time are not in it."""
    dated = items.where(F.col(time).isNotNull())
    return dated.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


#: Parts of the version log by the hash of a document; a batch reads only those of its documents.
BUCKETS = 64


def append_versions(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Append the versions that a batch adds to the log under ``folder``.

    A replayed batch writes the same folder again, and versions come from all other batches, so a
    failure between write and commit adds nothing twice.  Rows carry a bucket of their document and lie in
    its order, so a batch reads only the row groups of the buckets that its documents fall into.
    """
    spark = batch.sparkSession
    staged = versions.stage(batch)
    columns = ["document_id", "content_hash", "body_hash", "source_id", "canonical_url", "retrieved_at", "position", "normalized_body"]
    schema = "document_id string, content_hash string, body_hash string, source_id string, canonical_url string, retrieved_at timestamp, position int, normalized_body string, version_no int, document_version_id string"
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [str(x.getPath()) for x in fs.listStatus(root)] if fs.exists(root) else []
    others = [x for x in done if not x.endswith(f"/batch={batch_id}")]
    known = spark.createDataFrame([], schema)
    if others:
        touched = [r[0] for r in staged.select(bucket).distinct().collect()]  # at most BUCKETS numbers
        log = spark.read.schema(schema + ", bucket int").parquet(*others)
        known = log.where(F.col("bucket").isNull() | F.col("bucket").isin(touched or [-1])).drop("bucket")
    new = versions.new_versions(staged.select(*columns), known)
    rows = new.select(*[c.split()[0] for c in schema.split(", ")], bucket.alias("bucket")).sortWithinPartitions("bucket")
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def version_log(items: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """All items that are there, appended to the version log; exact, with the log itself as state."""
    return items.writeStream.foreachBatch(lambda df, i: append_versions(df, i, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alert_sink(measured: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Alerts of a stream of metric rows as JSON; a replay overwrites its own batch."""

    def write(df: DataFrame, i: int) -> None:
        metrics.alerts(df).write.mode("overwrite").json(f"{folder}/batch={i}")

    return measured.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, time: str, window: str = "7 days", late: str = "1 day", bad: str = "error") -> DataFrame:
    """Events and failures of each tumbling window of a stream."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == bad).alias("failed"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "failed")


def machine(steps: DataFrame, key: str, order: str, initial: str = "discovered") -> DataFrame:
    """A stream of (key, order, target) through the state machine: a row for each step.

    The state of a key is kept between batches; steps that no edge allows leave it as it is and are
    returned with ``ok`` false.
    """
    allowed = {a: frozenset(out) for a, out in states.EDGES.items()}

    def run(name: tuple, batches, state: GroupState):
        current = state.get[0] if state.exists else initial
        for pdf in batches:
            out = []
            for row in pdf.sort_values(order).itertuples(index=False):
                target = row.target
                ok = target in allowed.get(current, ())
                out.append((name[0], current, target, ok))
                current = target if ok else current
            yield pd.DataFrame(out, columns=[key, "from_state", "to_state", "ok"])
        state.update((current,))

    return steps.groupBy(key).applyInPandasWithState(run, f"{key} string, from_state string, to_state string, ok boolean", "state string", "append", GroupStateTimeout.NoTimeout)
