"""Operational metrics per observation window, verdicts, alerts and the expansion gate.

A metric frame has a row for each window and metric; an empty sample has no value and the verdict
insufficient_data.  Windows tile time, so membership is an equi-join on the window's start.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Target of each metric and whether values are to reach it or to stay under it.
TARGETS = {"M1": (0.95, True), "M2": (30.0, False), "M3": (20.0, False), "M4": (0.02, False), "M5": (0.0, False), "M6": (0.0, False)}
TITLES = {"M1": "Collection success rate", "M2": "Report delay in minutes", "M3": "Review backlog", "M4": "Delivery failure rate", "M5": "Duplicate rate", "M6": "Evidence gap rate"}


def result(df: DataFrame, metric: str, value: Column, numerator: Column, denominator: Column, sample: Column, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """Metric rows with value, target, verdict; an empty sample has neither value nor a met target."""
    target, reach = TARGETS[metric]
    value = F.when(sample > 0, value.cast("double"))
    meets = F.coalesce((value >= target) if reach else (value <= target), F.lit(False))
    verdict = F.when(value.isNull(), "insufficient_data").when(meets, "met").otherwise("breached")
    return df.select(*keys, F.lit(metric).alias("metric_id"), value.alias("value"), F.lit(target).alias("target"), numerator.cast("double").alias("numerator"), denominator.cast("double").alias("denominator"), sample.cast("long").alias("sample_size"), verdict.alias("verdict"), meets.alias("meets_target"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def _every(windows: DataFrame, counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts for every window, zero where nothing was seen."""
    return windows.select(*keys).join(counted, list(keys), "left").na.fill(0)


def by_days(windows: DataFrame, start: str, end: str) -> DataFrame:
    """``windows``, a row for each day that one touches, as ``_day``: a range join becomes an equi-join on days."""
    return windows.withColumn("_day", F.explode(F.sequence(F.to_date(start), F.to_date(end))))


def in_windows(df: DataFrame, at: str, windows: DataFrame, how: str = "inner") -> DataFrame:
    """``df`` with the window_id of each window (window_id, start, end) that its time ``at`` lies in; the end does not belong.

    Times and windows meet on their days, so neither side is broadcast and no other pair is looked at.
    """
    fine = windows.where("start <= end").select("window_id", F.col("start").alias("_start"), F.col("end").alias("_end"))
    w = by_days(fine, "_start", "_end")
    inside = (F.to_date(at) == F.col("_day")) & (F.col(at) >= F.col("_start")) & (F.col(at) < F.col("_end"))
    return df.join(w, inside, how).drop("_start", "_end", "_day")


def collection_success(jobs: DataFrame, sources: DataFrame, windows: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """M1: successes among the terminal jobs of active sources.

    jobs: the window keys, source_id, status, terminal_error.
    """
    ended = jobs.where((F.col("status") == "success") | F.col("terminal_error")).join(sources.where("active").select("source_id"), "source_id", "left_semi")
    counted = ended.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("good"))
    row = _every(windows, counted, keys)
    return result(row, "M1", ratio(F.col("good"), F.col("n")), F.col("good"), F.col("n"), F.col("n"), keys)


def final_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def briefing_delay(briefings: DataFrame, windows: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """M2: the largest delay of the last attempt of each successful report, in minutes, and the median.

    briefings: the window keys, briefing_id, run_attempt, tie (any unique column), delay; a last attempt
    without a delay does not count.
    """
    last = final_rows(briefings, [*keys, "briefing_id"], [F.desc("run_attempt"), F.asc("tie")])
    counted = last.groupBy(*keys).agg(F.max("delay").alias("longest"), F.median("delay").alias("middle"), F.count("delay").alias("n"))
    row = windows.select(*keys).join(counted, list(keys), "left").na.fill({"n": 0})
    out = result(row, "M2", F.col("longest"), F.coalesce("longest", F.lit(0)), F.lit(1), F.col("n"), keys)
    return out


def review_backlog(candidates: DataFrame, windows: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """M3: candidates that wait for review; the sample is all candidates, whatever the window."""
    total = candidates.agg(F.count("*").alias("n"), F.count_if(F.col("review_status") == "needs_review").alias("open"))
    row = windows.select(*keys).join(F.broadcast(total))
    return result(row, "M3", F.col("open"), F.col("open"), F.col("n"), F.col("n"), keys)


def delivery_failure(deliveries: DataFrame, windows: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """M4: failures among the final attempts of (briefing, channel) pairs within each window.

    deliveries: the window keys, briefing_id, channel, attempt_no, attempted_at, delivery_id, status.
    The window is cut out before the final attempt is chosen.
    """
    last = final_rows(deliveries, [*keys, "briefing_id", "channel"], [F.desc("attempt_no"), F.desc("attempted_at"), F.desc("delivery_id")])
    counted = last.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("bad"))
    row = _every(windows, counted, keys)
    return result(row, "M4", ratio(F.col("bad"), F.col("n")), F.col("bad"), F.col("n"), F.col("n"), keys)


def duplicate_flags(versions: DataFrame, order: Sequence[str] = ("created_at", "version_no", "document_version_id")) -> DataFrame:
    """versions (document_id, content_hash, ...) with ``duplicate``: the hash was seen earlier.

    Only the first row of a (document, hash) is not a duplicate, so that row is found by a partial
    aggregation and no group is sorted in one task.
    """
    key = F.struct(*order)
    first = versions.groupBy("document_id", "content_hash").agg(F.min(key).alias("_first"))
    return versions.join(first, ["document_id", "content_hash"]).withColumn("duplicate", key != F.col("_first")).drop("_first")


def duplicate_rate(versions: DataFrame, windows: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """M5: duplicates, flagged over the whole history, among the versions of each window."""
    counted = duplicate_flags(versions).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("duplicate").alias("bad"))
    row = _every(windows, counted, keys)
    return result(row, "M5", ratio(F.col("bad"), F.col("n")), F.col("bad"), F.col("n"), F.col("n"), keys)


def evidence_gap(items: DataFrame, evidence: DataFrame, windows: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """M6: core-claim items of published reports that have no evidence.

    items: the window keys, item_id; evidence: item_id, a row or more for each linked item.
    """
    linked = evidence.select("item_id").distinct().withColumn("_linked", F.lit(True))
    counted = items.join(linked, "item_id", "left").groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("_linked").isNull()).alias("bad"))
    row = _every(windows, counted, keys)
    return result(row, "M6", ratio(F.col("bad"), F.col("n")), F.col("bad"), F.col("n"), F.col("n"), keys)


def complete_rows(metrics: DataFrame, windows: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """All six metrics of every window, in order; one that is missing has insufficient data."""
    spec = F.explode(F.array(*[F.struct(F.lit(m).alias("metric_id"), F.lit(TITLES[m]).alias("title"), F.lit(t).alias("_target")) for m, (t, _) in TARGETS.items()])).alias("s")
    want = windows.select(*keys, spec).select(*keys, "s.*")
    out = want.join(metrics, [*keys, "metric_id"], "left")
    return out.select(*keys, "metric_id", "title", "value", F.col("_target").alias("target"), F.coalesce("sample_size", F.lit(0)).alias("sample_size"), normal_verdict(F.col("verdict"), F.col("value"), F.col("sample_size"), F.col("meets_target")).alias("verdict"), F.coalesce("meets_target", F.lit(False)).alias("meets_target"))


def normal_verdict(verdict: Column, value: Column, sample: Column, meets: Column) -> Column:
    """One of met, breached, insufficient_data; what is unclear is never met."""
    known = F.lower(F.trim(verdict))
    empty = value.isNull() | (F.coalesce(sample, F.lit(0)) <= 0)
    return F.when(known.isin("met", "breached", "insufficient_data"), known).when(empty, "insufficient_data").when(F.coalesce(meets, F.lit(False)), "met").otherwise("breached")


def alerts(metrics: DataFrame, window: str = "window_id") -> DataFrame:
    """An alert for each breached (error) or insufficient (warning) metric; ids make replays harmless."""
    severity = F.when(F.col("verdict") == "breached", "error").when(F.col("verdict") == "insufficient_data", "warning")
    out = metrics.select(F.concat_ws(":", F.col(window).cast("string"), "metric_id").alias("alert_id"), severity.alias("severity"), F.col(window), "metric_id", "verdict", "value", "target")
    return out.where("severity IS NOT NULL").dropDuplicates(["alert_id"])


def expansion_gate(metrics: DataFrame, windows: DataFrame, required: int = 4, metric_ids: Sequence[str] = tuple(TARGETS), gap: str = "INTERVAL 1 DAY") -> DataFrame:
    """One row: whether the last ``required`` windows are consecutive and meet every metric.

    windows: window_id, start, end.  Consecutive windows leave at most ``gap`` between them, or start
    seven days apart.  The reason names missing windows first, then a break, missing data, a breach.
    """
    last = windows.orderBy(F.desc("end"), F.desc("start"), F.desc("window_id")).limit(required)
    order = Window.orderBy("end", "start", "window_id")
    before = last.withColumn("_end", F.lag("end").over(order)).withColumn("_start", F.lag("start").over(order))
    joined = F.col("_end").isNull() | ((F.col("start") >= F.col("_end")) & (F.col("start") <= F.col("_end") + F.expr(gap))) | (F.col("start") == F.col("_start") + F.expr("INTERVAL 7 DAYS"))
    chained = before.withColumn("_joined", joined)
    wanted = chained.withColumn("metric_id", F.explode(F.array(*[F.lit(m) for m in metric_ids])))
    rows = wanted.join(metrics.select("window_id", "metric_id", "verdict", "meets_target"), ["window_id", "metric_id"], "left")
    judged = rows.agg(
        F.count_distinct("window_id").alias("windows"),
        F.bool_and("_joined").alias("consecutive"),
        F.count_if(F.col("verdict").isNull() | (F.col("verdict") == "insufficient_data")).alias("insufficient"),
        F.count_if(F.col("verdict") == "breached").alias("breached"),
        F.bool_and(F.coalesce("meets_target", F.lit(False))).alias("all_met"),
        F.array_sort(F.collect_set(F.when(~F.coalesce("meets_target", F.lit(False)), F.col("metric_id")))).alias("blocked_metrics"),
    )
    reason = F.when(F.col("windows") < required, "not_enough_windows").when(~F.col("consecutive"), "not_consecutive").when(F.col("insufficient") > 0, "insufficient_data").when(F.col("breached") > 0, "breached").when(~F.col("all_met"), "breached").otherwise("eligible")
    return judged.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "eligible")


def expansion_recommendations(gate: DataFrame, inactive_sources: DataFrame, options: Sequence[str] = ("add_source", "raise_frequency", "widen_scope")) -> DataFrame:
    """Recommend or hold, for each option; adding needs a real source that is not active."""
    spare = inactive_sources.agg(F.count("*").alias("spare"))
    row = gate.select("eligible").join(F.broadcast(spare)).withColumn("option", F.explode(F.array(*[F.lit(o) for o in options])))
    return row.select("option", F.when(F.col("eligible") & (F.col("spare") > 0), "recommend").otherwise("hold").alias("recommendation"))


def recalibration(gate: DataFrame, current: dict[str, float], proposed: dict[str, float]) -> DataFrame:
    """Thresholds as they are and as proposed; nothing is ever changed here."""
    rows = F.array(*[F.struct(F.lit(k).alias("threshold"), F.lit(float(v)).alias("current"), F.lit(float(proposed.get(k, v))).alias("proposed")) for k, v in current.items()])
    out = gate.select("eligible", F.explode(rows).alias("r")).select("r.*", "eligible")
    return out.select("threshold", "current", "proposed", (F.col("eligible") & (F.col("current") != F.col("proposed"))).alias("recommended"), F.lit(False).alias("changed"))
