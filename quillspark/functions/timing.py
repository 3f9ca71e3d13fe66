"""Windows and schedules."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def in_half_open(t: Column, start: Column, end: Column) -> Column:
    """start <= t < end; a null time is outside (observation windows)."""
    return F.coalesce((t >= start) & (t < end), F.lit(False))


def in_closed(t: Column, start: Column, end: Column) -> Column:
    """start <= t <= end; a null time is inside (collection and report windows)."""
    return t.isNull() | t.between(start, end)


def observation_windows(spark: SparkSession, first: datetime, last: datetime, days: int = 7) -> DataFrame:
    """(window_id, start, end): windows of ``days`` that tile [first, last), made without a table."""
    seconds = days * 86400
    n = max(0, -(-int((last - first).total_seconds()) // seconds))
    start = F.lit(first).cast("timestamp_ntz")
    step = lambda k: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k * seconds).cast("decimal(18,6)"))
    rows = spark.range(n).select((start + step(F.col("id"))).alias("start"), (start + step(F.col("id") + 1)).alias("end"))
    iso = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'") for c in ("start", "end")]
    return rows.select(F.concat(F.lit("window-"), F.sha2(F.concat_ws("|", *iso, F.lit("UTC")), 256)).alias("window_id"), "start", "end")


def window_start(t: Column, first: datetime, days: int = 7) -> Column:
    """The start of the tile of ``days`` that holds ``t``: the equi-join form of a window join."""
    origin = F.lit(first).cast("timestamp_ntz")
    n = F.floor(F.timestamp_diff("SECOND", origin, t) / (days * 86400))
    return F.timestamp_add("DAY", (n * days).cast("int"), origin)


def collection_window(cursor_end: Column, last_success: Column, now: Column, initial_days: int = 14, max_days: int = 30, recovery: bool = False) -> Column:
    """struct(window_start, window_end, requested_start, truncated).

    The window starts where the last one ended, or ``initial_days`` ago; a start more than ``max_days``
    ago is moved up and marked, a first start only in recovery.
    """
    day = lambda n: F.make_dt_interval(F.lit(n))
    before = F.coalesce(cursor_end, last_success)
    asked = F.coalesce(before, now - day(initial_days))
    floor = now - day(max_days)
    cut = (asked < floor) & (before.isNotNull() | F.lit(recovery))
    return F.struct(F.when(cut, floor).otherwise(asked).alias("window_start"), now.alias("window_end"), asked.alias("requested_start"), cut.alias("truncated"))


def parse_schedule(entries: list[str]) -> list[tuple[int, int, int]]:
    """(weekday from 0, hour, minute) of entries such as "TUE 08:30", sorted; anything else raises."""
    slots = []
    for entry in entries:
        m = re.fullmatch(r"\s*([A-Za-z]{3})\s+([01]\d|2[0-3]):([0-5]\d)\s*", entry)
        if not m or m[1].upper() not in WEEKDAYS:
            raise ValueError(f"not a schedule entry: {entry!r}")
        slots.append((WEEKDAYS.index(m[1].upper()), int(m[2]), int(m[3])))
    if not slots or len(set(slots)) < len(slots):
        raise ValueError("a schedule needs entries, each once")
    return sorted(slots)


def slots_between(df: DataFrame, start: str, end: str, schedule: list[str], zone: str = "UTC") -> DataFrame:
    """``df`` with a row for each slot, as ``scheduled_for`` in UTC, in [start, end) of its columns.

    Slots are local times of ``zone``; days are laid out in the zone, a day more at either end.
    """
    local = lambda c: F.to_date(F.from_utc_timestamp(F.col(c), zone))
    table = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(h * 60 + m).alias("m")) for d, h, m in parse_schedule(schedule)])
    days = df.withColumn("_day", F.explode(F.sequence(F.date_sub(local(start), 1), F.date_add(local(end), 1))))
    slots = days.withColumn("_slot", F.explode(F.filter(table, lambda s: s["d"] == F.weekday("_day"))))
    at = F.to_utc_timestamp(F.timestamp_add("MINUTE", F.col("_slot.m"), F.col("_day").cast("timestamp")), zone)
    slots = slots.withColumn("scheduled_for", at).where((F.col("scheduled_for") >= F.col(start)) & (F.col("scheduled_for") < F.col(end)))
    return slots.drop("_day", "_slot")


def next_slot(after: Column, schedule: list[str]) -> Column:
    """The first slot (UTC) strictly after a time: the least over the slots of the next eight days."""
    day = F.date_trunc("DAY", after)
    matches = F.array(*[F.when((F.weekday(o) == d) & (o > after), o) for (d, h, m) in parse_schedule(schedule) for o in [*(F.timestamp_add("MINUTE", F.lit(n * 1440 + h * 60 + m), day) for n in range(9))]])
    return F.array_min(F.array_compact(matches))
