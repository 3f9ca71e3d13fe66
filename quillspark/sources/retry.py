"""Retries: a capped exponential schedule, as columns and as a driver loop."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RetryPolicy:
    most: int = 3
    base_seconds: float = 1.0
    cap_seconds: float = 60.0

    def backoff(self, count: Column) -> Column:
        """Seconds to wait after failure ``count``, from 1: base doubled each time, up to the cap."""
        return F.least(F.lit(self.cap_seconds), F.lit(self.base_seconds) * F.pow(F.lit(2.0), count - 1))

    def record_failures(self, states: DataFrame, failures: DataFrame) -> DataFrame:
        """The retry state of each source after one more failure; terminal states stay as they are.

        states: source_id, retry_count, terminal_error, error_class, last_error_at, next_retry_at;
        failures: source_id, error_class, failed_at.
        """
        new = failures.select("source_id", F.col("error_class").alias("_class"), F.col("failed_at").alias("_at"))
        row = states.join(new, "source_id", "full").withColumn("_hit", F.col("_at").isNotNull() & ~F.coalesce("terminal_error", F.lit(False)))
        count = F.coalesce("retry_count", F.lit(0)) + F.when(F.col("_hit"), 1).otherwise(0)
        row = row.withColumn("retry_count", count)
        ends = F.when(F.col("_hit"), F.col("retry_count") >= self.most).otherwise(F.coalesce("terminal_error", F.lit(False)))
        row = row.withColumn("_ends", ends)
        wait = F.timestamp_micros(F.unix_micros("_at") + (self.backoff(F.col("retry_count")) * 1_000_000).cast("long"))
        return row.select(
            "source_id",
            "retry_count",
            F.col("_ends").alias("terminal_error"),
            F.when(F.col("_hit"), F.col("_class")).otherwise(F.col("error_class")).alias("error_class"),
            F.when(F.col("_hit"), F.col("_at")).otherwise(F.col("last_error_at")).alias("last_error_at"),
            F.when(F.col("_hit") & ~F.col("_ends"), wait).when(~F.col("_hit"), F.col("next_retry_at")).alias("next_retry_at"),
            F.when(F.col("_ends"), "failed").when(F.col("retry_count") > 0, "retry_scheduled").otherwise("ok").alias("status"),
        )

    def run(self, work: Callable[[], object], sleep: Callable[[float], None] = time.sleep) -> object:
        """``work()``, tried up to ``most`` times; the last failure is raised."""
        for count in range(1, max(1, self.most) + 1):
            try:
                return work()
            except Exception:
                if count >= self.most:
                    raise
                sleep(min(self.cap_seconds, self.base_seconds * 2 ** (count - 1)))
        raise AssertionError("unreachable")
