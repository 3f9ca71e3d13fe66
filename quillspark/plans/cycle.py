"""The full cycle over typed tables: collect to alerts, in fourteen stages.

Each stage is a DataFrame transformation; ``run_cycle`` composes them and gives every stage's frame
and one table of tallies.  Rows that fail a stage carry an error class and do not stop the others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import briefing, delivery, evidence, gate, metrics, novelty, relevance, routing, scoring, validation, versions
from quillspark.sources import recordings
from quillspark.sources.registry import Settings

STAGES = ("collect", "classify", "extract", "validate", "evidence", "score", "novelty", "route", "briefing", "gate", "delivery", "metrics", "report", "alerting")

#: What a recorded answer is read as.
CANDIDATE = "canonical_name string, strategy_families array<string>, asset_classes array<string>, holding_horizon string, core_hypothesis string, signal_inputs string, entry_logic string, exit_logic string, required_data string, risk_notes string, extraction_confidence double, field_status map<string,string>, quotes array<struct<field_name:string,quote:string>>"


@dataclass
class Cycle:
    """The frames of a run by stage, and the error column that each may carry."""

    keep: Callable[[str, DataFrame], DataFrame]
    frames: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, Column] = field(default_factory=dict)

    def add(self, stage: str, df: DataFrame, error: Column | None = None) -> DataFrame:
        self.frames[stage] = self.keep(stage, df)
        self.errors[stage] = F.lit(None).cast("string") if error is None else error
        return self.frames[stage]

    def tallies(self) -> DataFrame:
        """(stage, position, processed, succeeded, failed), a row for each stage that ran."""
        out = None
        for name, df in self.frames.items():
            bad = self.errors[name].isNotNull()
            row = df.agg(F.lit(name).alias("stage"), F.lit(STAGES.index(name)).alias("position"), F.count("*").alias("processed"), F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"))
            out = row if out is None else out.unionByName(row)
        return out


def written(folder: str) -> Callable[[str, DataFrame], DataFrame]:
    """A ``keep`` that writes each stage as Parquet under ``folder`` and reads it back."""

    def keep(stage: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{folder}/{stage}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{stage}")

    return keep


def _columns(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns of ``df``; one that it lacks is null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def measure(tables: Mapping[str, DataFrame], new: DataFrame, sent: DataFrame, pool: DataFrame, now: Column) -> DataFrame:
    """M1 to M6 of each window, over what was there and what this run adds: versions, reports, deliveries.

    All but M1 and M3 are placed by time, so they need windows with start and end.
    """
    windows = tables["windows"]
    out = metrics.collection_success(tables["jobs"], tables["sources"], windows).unionByName(metrics.review_backlog(pool, windows))
    if not {"start", "end"} <= set(windows.columns):
        return out
    kinds = {"briefing_id": "string", "run_attempt": "int", "run_status": "string", "publication_status": "string", "scheduled_for": "timestamp", "generated_at": "timestamp"}
    made = tables["occurrences"].select("briefing_id", "scheduled_for", now.alias("generated_at"), F.lit("success").alias("run_status"))
    if "briefings" in tables:
        earlier = _columns(tables["briefings"], **kinds)
        last = earlier.groupBy("briefing_id").agg((F.max(F.coalesce("run_attempt", F.lit(0))) + 1).alias("run_attempt"))
        reports = earlier.unionByName(_columns(made.join(last, "briefing_id", "left").na.fill({"run_attempt": 1}), **kinds))
    else:
        reports = _columns(made.withColumn("run_attempt", F.lit(1)), **kinds)
    dated = metrics.in_windows(reports, "scheduled_for", windows)
    delay = (F.unix_micros("generated_at") - F.unix_micros("scheduled_for")) / 60e6
    drafts = dated.where("run_status = 'success'").select("window_id", "briefing_id", F.coalesce("run_attempt", F.lit(0)).alias("run_attempt"), F.col("generated_at").alias("tie"), delay.alias("delay"))
    out = out.unionByName(metrics.briefing_delay(drafts, windows))
    kinds = {"delivery_id": "string", "briefing_id": "string", "channel": "string", "attempt_no": "int", "attempted_at": "timestamp", "status": "string"}
    attempts = _columns(tables["deliveries"], **kinds).unionByName(_columns(sent, **kinds))
    good = F.coalesce(F.col("status").isin("success", "sent", "dry_run"), F.lit(False))
    attempts = attempts.withColumn("status", F.when(good, "success").otherwise("failed"))
    out = out.unionByName(metrics.delivery_failure(metrics.in_windows(attempts, "attempted_at", windows), windows))
    kinds = {"document_id": "string", "content_hash": "string", "version_no": "int", "document_version_id": "string", "created_at": "timestamp"}
    kept = _columns(tables["versions"], **kinds).unionByName(_columns(new.withColumn("created_at", now), **kinds)).where("created_at IS NOT NULL")
    out = out.unionByName(metrics.duplicate_rate(metrics.in_windows(kept, "created_at", windows, "left"), windows))
    if not {"briefing_items", "item_evidence"} <= set(tables):
        return out
    public = dated.where("publication_status IN ('approved', 'published')").select("window_id", "briefing_id").distinct()
    claims = tables["briefing_items"].where("core_claim").select("briefing_id", "item_id").join(public, "briefing_id")
    return out.unionByName(metrics.evidence_gap(claims, tables["item_evidence"], windows))


def run_cycle(tables: Mapping[str, DataFrame], now: Column, settings: Settings = Settings(), keep: Callable[[str, DataFrame], DataFrame] = lambda _, df: df) -> Cycle:
    """All stages over ``tables``: items, versions, recordings, candidates, occurrences, previous_items,
    deliveries, jobs, sources, windows; if there are any also evidence, briefings (briefing_id,
    run_attempt, run_status, publication_status, scheduled_for, generated_at), briefing_items
    (briefing_id, item_id, core_claim) and item_evidence (item_id).

    Candidates of a run are compared with those that were there before it, never with themselves.
    ``keep`` is given each stage's frame and returns what later stages read: ``written`` cuts the plan
    there, so that no stage is worked out again for the next; without it nothing runs here.
    """
    run = Cycle(keep)
    staged = versions.stage(tables["items"])
    new = run.add("collect", versions.change_summary(versions.new_versions(staged, tables["versions"])))
    told = run.add("classify", relevance.classify(new.withColumn("text", F.coalesce("normalized_body", F.lit(""))), title="title", explain=False))
    fit = told.where("relevance = 'relevant'")
    prompts = fit.select("document_version_id", "canonical_url", "retrieved_at", "published_at", "author", "license", "source_id", F.col("normalized_body").alias("prompt"), F.lit("extract-1").alias("prompt_version"), "content_hash", F.col("relevance").alias("relevance_status"))
    answers = recordings.complete(prompts, tables["recordings"])
    drawn = validation.candidate_rows(answers.drop("error_class"), CANDIDATE)
    drawn = drawn.withColumn("candidate_id", F.sha2(F.concat_ws("|", "document_version_id", "canonical_name"), 256)).withColumn("document_version_ids", F.array("document_version_id"))
    run.add("extract", drawn, F.col("error_class"))
    drawn = run.frames["extract"]
    good = drawn.where("error_class IS NULL").drop("error_class")
    asked = good.select("candidate_id", "document_version_id", F.posexplode("quotes").alias("request_id", "q")).select("candidate_id", "document_version_id", "request_id", "q.*")
    proof = asked.select("field_name", "quote", "document_version_id", F.col("request_id").alias("provenance_id"), F.lit(True).alias("accepted")).distinct()
    linked = evidence.link(asked, proof, new.select("document_version_id", F.col("normalized_body").alias("body")), chars=settings.quote_max_chars)
    linked = run.add("evidence", linked, F.col("evidence_error"))
    held = validation.keep_supported(good.drop("quotes"), linked)
    checked = run.add("validate", validation.validate(held, linked.withColumn("evidence_error", F.when(F.col("evidence_error") != "quote_not_in_source", F.col("evidence_error")))), F.col("error_class"))
    valid = checked.where("error_class IS NULL").drop("error_class", "state", "contract_errors")
    scored = run.add("score", scoring.score(valid, now))
    before = tables["candidates"].join(scored.select("candidate_id"), "candidate_id", "left_anti")
    judged = run.add("novelty", scored.join(novelty.classify(scored, before), "candidate_id"))
    routed = run.add("route", routing.route(judged, settings.candidate_score_threshold, settings.extraction_confidence_min))
    pool = routed.select("candidate_id", "canonical_name", "value_score", "review_status", F.col("retrieved_at").alias("created_at"))
    pool = pool.unionByName(before.select("candidate_id", "canonical_name", "value_score", "review_status", "created_at"))
    quotes = linked.where("evidence_error IS NULL").select("candidate_id", "field_name", "evidence_id", "quote")
    if "evidence" in tables:
        quotes = quotes.unionByName(tables["evidence"].select(*quotes.columns))
    items = run.add("briefing", briefing.assemble(tables["occurrences"], pool, tables["previous_items"], quotes, settings.briefing_max_items))
    named = items.join(pool.select("candidate_id", "canonical_name"), "candidate_id").withColumns({"core_claim": F.col("canonical_name"), "claim": F.col("canonical_name"), "source_link": F.lit("fixture://recorded"), "status": F.lit("explicit"), "version_ids": F.col("quotes")})
    gated = run.add("gate", gate.item_violations(named), F.get(F.col("violations"), F.lit(0)))
    texts = briefing.render_briefings(briefing.render_items(gated.where("size(violations) = 0")), settings.briefing_max_items)
    planned = delivery.plan(texts.withColumns({"channel": F.lit("dry_run"), "resend_reason": F.lit(None).cast("string"), "resend_approved_by": F.lit(None).cast("string")}), tables["deliveries"])
    planned = run.add("delivery", planned, F.col("delivery_error"))
    measured = run.add("metrics", metrics.complete_rows(measure(tables, new, delivery.dry_run(planned, now), pool, now), tables["windows"]))
    run.add("report", briefing.render_metrics(measured))
    run.add("alerting", metrics.alerts(measured))
    return run
