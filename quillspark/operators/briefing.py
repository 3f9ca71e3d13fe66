"""Report assembly: three ranked segments, carry-over, summary, and rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text, timing
from quillspark.operators.metrics import TARGETS, by_days

SEGMENTS = ("approved", "pending", "carried")


def candidate_time(df: DataFrame) -> Column:
    """The first time a candidate has: made, captured, retrieved."""
    return F.coalesce(*[F.col(c) for c in ("created_at", "captured_at", "retrieved_at") if c in df.columns])


def ranked(df: DataFrame, by: Sequence[str], segment: str = "segment", score: str = "value_score", time: str = "created_at", key: str = "candidate_id", most: int = 7) -> DataFrame:
    """The first ``most`` rows of each report with their rank: segment, score (nulls last), time, key.

    A candidate that stands in two segments counts in the first.
    """
    place = F.array_position(text.literals(SEGMENTS), F.col(segment))
    first = df.withColumn("_place", place).withColumn("_n", F.row_number().over(Window.partitionBy(*by, key).orderBy("_place"))).where("_n = 1")
    order = Window.partitionBy(*by).orderBy("_place", F.desc_nulls_last(score), F.asc_nulls_first(time), key)
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("_place", "_n")


def assemble(occurrences: DataFrame, candidates: DataFrame, previous_items: DataFrame, evidence: DataFrame, most: int = 7) -> DataFrame:
    """Items of each report: briefing_id, candidate_id, segment, rank, carried_over, quotes.

    occurrences: briefing_id, window_start, window_end, scheduled_for; previous_items: scheduled_for,
    candidate_id.  Candidates within the closed window count, and undated ones; candidates that an
    earlier report listed and nobody decided on are carried over.  Those without evidence are left out
    before the cut, and two quotes of each are kept.

    Dated candidates meet windows on days.  Undated ones stand in every report, and a candidate that was
    listed stands in every later one; of these only the first ``most`` of a segment, and of those first
    listed at one time, can be among the first ``most`` of a report, so no more of them meet the reports.
    """
    quotes = evidence.groupBy("candidate_id").agg(F.array_sort(F.collect_set(F.struct("field_name", "evidence_id", "quote"))).alias("_all"))
    known = candidates.withColumn("_at", candidate_time(candidates)).join(quotes.select("candidate_id"), "candidate_id", "left_semi")
    decided = F.col("review_status").isin("approved", "published")
    open_ = F.col("review_status").isin("pending", "needs_review")
    known = known.where(decided | open_).withColumn("segment", F.when(decided, "approved").otherwise("pending"))
    slots = by_days(occurrences.where("window_start <= window_end"), "window_start", "window_end")
    inside = (F.to_date("_at") == F.col("_day")) & timing.in_closed(F.col("_at"), F.col("window_start"), F.col("window_end"))
    columns = ["briefing_id", "candidate_id", "segment", "value_score", "created_at"]
    first = (F.desc_nulls_last("value_score"), F.asc_nulls_first("created_at"), F.asc("candidate_id"))

    def leading(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*first))).where(F.col("_n") <= most).drop("_n")

    dated = known.where("_at IS NOT NULL").join(slots, inside).select(*columns)
    undated = leading(known.where("_at IS NULL"), "segment").join(F.broadcast(occurrences.select("briefing_id")), F.lit(True)).select(*columns)
    listed = previous_items.groupBy("candidate_id").agg(F.min("scheduled_for").alias("_before"))
    waiting = leading(known.where("segment = 'pending'").join(listed, "candidate_id"), "_before")
    reports = occurrences.select("briefing_id", "scheduled_for")
    carried = F.broadcast(waiting).join(reports, F.col("_before") < F.col("scheduled_for")).withColumn("segment", F.lit("carried")).select(*columns)
    rows = dated.unionByName(undated).unionByName(carried)
    out = ranked(rows, ["briefing_id"], most=most).join(reports, "briefing_id").join(listed, "candidate_id", "left")
    was = F.coalesce(F.col("_before") < F.col("scheduled_for"), F.lit(False))
    out = out.withColumn("carried_over", was & (F.col("segment") != "approved")).drop("_before", "scheduled_for")
    return out.join(quotes, "candidate_id").withColumn("quotes", F.slice(F.transform("_all", lambda e: e["quote"]), 1, 2)).drop("_all")


def source_summary(jobs: DataFrame, by: Sequence[str], status: str = "status", classes: Sequence[str] = ("success", "failed", "not_executed")) -> DataFrame:
    """Jobs of each report by status class, and in all."""
    return jobs.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == c).alias(c) for c in classes])


def notes(candidates: Column, approved: Column, failed: Column, carried: Column) -> Column:
    """What a reader should know of a report."""
    return F.array_compact(F.array(F.when(candidates == 0, "no_candidates"), F.when(approved == 0, "no_approved_candidates"), F.when(failed > 0, "source_failures"), F.when(carried > 0, "carried_over")))


def grouped_evidence(rows: DataFrame) -> DataFrame:
    """A row for each candidate: first non-null fields in order, and its distinct quotes in order.

    rows: candidate_id, position, evidence_id, quote and any fields.
    """
    fields = [c for c in rows.columns if c not in ("candidate_id", "position", "evidence_id", "quote")]
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("position"))).alias(c) for c in fields]
    quotes = F.array_sort(F.collect_list(F.struct("position", "evidence_id", "quote")))
    out = rows.groupBy("candidate_id").agg(*firsts, quotes.alias("_q"))
    pairs = F.array_distinct(F.transform("_q", lambda q: F.struct(q["evidence_id"].alias("evidence_id"), q["quote"].alias("quote"))))
    return out.withColumn("quotes", F.filter(pairs, lambda q: q["quote"].isNotNull())).drop("_q")


def render_items(items: DataFrame, quote_chars: int = 300) -> DataFrame:
    """``items`` (rank, canonical_name, value_score, core_claim, quotes, source_link) with markdown lines."""
    quotes = F.transform("quotes", lambda q: F.concat(F.lit("  - > "), F.substring(text.collapse(q), 1, quote_chars)))
    lines = F.array_compact(F.array(F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), text.clean_line("canonical_name")), F.concat(F.lit("- score: "), text.clean_line("value_score")), F.concat(F.lit("- claim: "), text.clean_line("core_claim")), F.when(F.col("source_link").isNotNull(), F.concat(F.lit("- source: "), F.col("source_link")))))
    return items.withColumn("markdown", F.array_join(F.concat(lines, quotes), "\n"))


def render_briefings(items: DataFrame, most: int = 7) -> DataFrame:
    """One text a report, of its first ``most`` items, and how many more there were."""
    rows = items.groupBy("briefing_id").agg(F.array_sort(F.collect_list(F.struct("rank", "markdown"))).alias("_all"))
    body = F.array_join(F.transform(F.slice("_all", 1, most), lambda r: r["markdown"]), "\n\n")
    return rows.select("briefing_id", F.concat(F.lit("# Report "), F.col("briefing_id"), F.lit("\n\n"), body).alias("markdown"), F.greatest(F.size("_all") - most, F.lit(0)).alias("items_truncated"))


def render_metrics(metrics: DataFrame, by: str = "window_id") -> DataFrame:
    """One text a window: a table of all metrics, then what is breached and what lacks data."""
    order = F.array_position(text.literals(list(TARGETS)), F.col("metric_id"))
    line = F.concat_ws(" | ", "metric_id", "title", F.coalesce(F.format_number("value", 4), F.lit("-")), F.col("target").cast("string"), "verdict")
    rows = metrics.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line"), "metric_id", "verdict"))).alias("r"))
    pick = lambda v: F.array_join(F.transform(F.filter("r", lambda x: x["verdict"] == v), lambda x: x["metric_id"]), ", ")
    table = F.array_join(F.transform("r", lambda x: F.concat(F.lit("| "), x["line"], F.lit(" |"))), "\n")
    head = F.lit("| metric | title | value | target | verdict |\n| --- | --- | --- | --- | --- |\n")
    return rows.select(by, text.mask_secrets(F.concat(head, table, F.lit("\n\nbreached: "), pick("breached"), F.lit("\ninsufficient data: "), pick("insufficient_data"))).alias("markdown"))
