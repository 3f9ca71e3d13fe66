import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillspark.plans import cycle

T0 = datetime(2024, 1, 1)
BODY = "An order book momentum strategy. Enter on imbalance. Exit in seconds."


def tables(spark):
    answer = {"canonical_name": "Book Momentum", "strategy_families": ["momentum"], "asset_classes": ["fx"], "holding_horizon": "5 seconds", "core_hypothesis": "order book momentum", "entry_logic": "imbalance", "exit_logic": "made up", "extraction_confidence": 0.5, "quotes": [{"field_name": "core_hypothesis", "quote": "order book  momentum"}, {"field_name": "entry_logic", "quote": "Enter on imbalance."}, {"field_name": "exit_logic", "quote": "not there"}]}
    from quillspark.functions import text

    digest = spark.range(1).select(text.sha256_tagged(F.lit(BODY))).first()[0]
    items = [("s", "http://h/a", "T", BODY, T0, 0, None, "ann", None), ("s", "http://h/b", "T", "dividend news", T0, 1, None, None, None), ("s", "http://h/c", "T", "tick momentum without a recording", T0, 2, None, None, None)]
    return {
        "items": spark.createDataFrame(items, "source_id string, url string, title string, body string, retrieved_at timestamp, position int, published_at timestamp, author string, license string"),
        "versions": spark.createDataFrame([], "document_id string, content_hash string, version_no int"),
        "recordings": spark.createDataFrame([(f"stable:extract-1:{digest}", "```json\n" + json.dumps(answer) + "\n```")], "key string, answer string"),
        "candidates": spark.createDataFrame([("old", "Other", ["x"], ["y"], "days", "hold", None, None, None, None, None, ["v"], 5, "needs_review", T0)], "candidate_id string, canonical_name string, strategy_families array<string>, asset_classes array<string>, holding_horizon string, core_hypothesis string, signal_inputs string, entry_logic string, exit_logic string, required_data string, risk_notes string, document_version_ids array<string>, value_score int, review_status string, created_at timestamp"),
        "occurrences": spark.createDataFrame([("b1", T0, T0 + timedelta(7), T0 + timedelta(7))], "briefing_id string, window_start timestamp, window_end timestamp, scheduled_for timestamp"),
        "previous_items": spark.createDataFrame([], "scheduled_for timestamp, candidate_id string"),
        "deliveries": spark.createDataFrame([], "idempotency_key string, attempt_no int"),
        "jobs": spark.createDataFrame([("w", "s", "success", False)], "window_id string, source_id string, status string, terminal_error boolean"),
        "sources": spark.createDataFrame([("s", True)], "source_id string, active boolean"),
        "windows": spark.createDataFrame([("w",)], "window_id string"),
    }


def test_a_whole_cycle(spark, tmp_path):
    run = cycle.run_cycle(tables(spark), F.lit(T0 + timedelta(1)).cast("timestamp"), keep=cycle.written(str(tmp_path)))
    tally = {r.stage: (r.processed, r.succeeded, r.failed) for r in run.tallies().collect()}
    assert list(tally) == list(cycle.STAGES) or set(tally) == set(cycle.STAGES)
    assert tally["collect"] == (3, 3, 0) and tally["extract"] == (2, 1, 1) and tally["evidence"] == (3, 2, 1) and tally["validate"] == (1, 1, 0)
    row = run.frames["route"].first()
    assert row.exit_logic is None and row.novelty_status == "new" and row.review_status == "needs_review" and 0 < row.value_score < 100
    assert [r.candidate_id for r in run.frames["briefing"].collect()] == [row.candidate_id]
    assert run.frames["delivery"].first().delivery_error is None and "Book Momentum" in run.frames["delivery"].first().markdown
    assert {r.verdict for r in run.frames["metrics"].collect()} == {"met", "insufficient_data"} and run.frames["alerting"].count() == 4


def test_a_repeated_cycle_collects_nothing(spark, tmp_path):
    first = tables(spark)
    run = cycle.run_cycle(first, F.lit(T0).cast("timestamp"), keep=cycle.written(str(tmp_path / "a")))
    again = cycle.run_cycle(first | {"versions": run.frames["collect"].select("document_id", "content_hash", "version_no")}, F.lit(T0).cast("timestamp"), keep=cycle.written(str(tmp_path / "b")))
    assert again.frames["collect"].count() == 0 and again.frames["route"].count() == 0


def test_all_six_metrics_are_measured(spark, tmp_path):
    given = tables(spark)
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    given["windows"] = spark.createDataFrame([("w", T0, at(60)), ("later", at(60), at(120))], "window_id string, start timestamp, end timestamp")
    given["versions"] = spark.createDataFrame([("d", "h", 1, "v1", at(-90)), ("d", "h", 2, "v2", at(5))], "document_id string, content_hash string, version_no int, document_version_id string, created_at timestamp")
    given["deliveries"] = spark.createDataFrame([("k1", 1, "x1", "b0", "mail", at(6), "success"), ("k1", 2, "x2", "b0", "mail", at(7), "rejected"), ("k2", 1, "x3", "b0", "chat", at(60), "success")], "idempotency_key string, attempt_no int, delivery_id string, briefing_id string, channel string, attempted_at timestamp, status string")
    given["briefings"] = spark.createDataFrame([("b0", 1, "success", "draft", at(0), at(5)), ("b0", 2, "success", "published", at(0), at(45)), ("b9", 1, "failed", "draft", at(1), at(99)), ("b8", 1, "success", "draft", at(70), at(80))], "briefing_id string, run_attempt int, run_status string, publication_status string, scheduled_for timestamp, generated_at timestamp")
    given["briefing_items"] = spark.createDataFrame([("b0", "i1", True), ("b0", "i2", True), ("b0", "i3", False), ("b8", "i4", True)], "briefing_id string, item_id string, core_claim boolean")
    given["item_evidence"] = spark.createDataFrame([("i1",), ("i1",)], "item_id string")
    run = cycle.run_cycle(given, F.lit(at(10)).cast("timestamp"), keep=cycle.written(str(tmp_path)))
    got = {(r.window_id, r.metric_id): (r.value, r.sample_size, r.verdict) for r in run.frames["metrics"].collect()}
    # three new versions of this run beside v2, and a delivery of this run beside b0's
    assert [got["w", f"M{i}"] for i in range(1, 7)] == [(1.0, 1, "met"), (45.0, 1, "breached"), (got["w", "M3"][0], got["w", "M3"][1], "met"), (0.5, 2, "breached"), (0.25, 4, "breached"), (0.5, 2, "breached")]
    assert got["later", "M2"] == (10.0, 1, "met") and got["later", "M4"] == (0.0, 1, "met") and got["later", "M5"][2] == got["later", "M6"][2] == "insufficient_data"
    assert {r.alert_id for r in run.frames["alerting"].where("severity = 'error'").collect()} == {"w:M2", "w:M4", "w:M5", "w:M6"}
