from pathlib import Path

from pyspark.sql import functions as F

from quillspark.operators import archive, delivery


def test_alerts_are_written_once_and_the_first_wins(spark, tmp_path):
    folder = str(tmp_path / "alerts")
    one = spark.createDataFrame([("w1:M1", "error", "API_TOKEN=abc"), ("w1:M2", "warning", None), (None, "error", "x")], "alert_id string, severity string, note string")
    archive.write_alerts(one, folder)
    archive.write_alerts(one.withColumn("severity", F.lit("other")).unionByName(spark.createDataFrame([("w2:M1", "error", "y")], one.schema)), folder)
    rows = {r["alert_id"]: (r["severity"], r["note"]) for r in spark.read.schema(one.schema).json(folder).collect()}
    assert set(rows) == {"w1:M1", "w1:M2", "w2:M1"}
    assert rows["w1:M1"][0] == "error" and "abc" not in rows["w1:M1"][1]
    archive.write_alerts(one.limit(0), folder)
    assert spark.read.schema(one.schema).json(folder).count() == 3


def test_reports_are_archived_by_name_unless_a_phrase_is_banned(spark, tmp_path):
    folder = str(tmp_path / "reports")
    rows = spark.createDataFrame([("w1", "all metrics met"), ("w2", "a guaranteed return"), ("w3", None)], "window_id string, markdown string")
    errors = [r["archive_error"] for r in archive.archive_reports(rows, folder).collect()]
    assert sorted(map(str, errors)) == ["None", "None", "banned_phrase"]
    names = [p.name for p in Path(folder).glob("report_id=*")]
    assert len(names) == 2
    archive.archive_reports(rows.where("window_id = 'w1'").withColumn("markdown", F.lit("again")), folder)
    assert len(list(Path(folder).glob("report_id=*"))) == 2
    assert "again" in {r["value"] for r in spark.read.text(folder).collect()}


def test_briefings_with_unsafe_names_are_not_written(spark, tmp_path):
    folder = str(tmp_path / "briefings")
    rows = spark.createDataFrame([("briefing-1", "a\nb"), ("../up", "c")], "briefing_id string, markdown string")
    archive.archive_texts(rows, folder, "briefing_id")
    assert [p.name for p in Path(folder).glob("briefing_id=*")] == ["briefing_id=briefing-1"]


def test_messages_and_runs_survive_replays(spark, tmp_path):
    planned = spark.createDataFrame([("b1", "dry_run", "x" * 5000, "k", "h", 1, None)], "briefing_id string, channel string, markdown string, idempotency_key string, content_hash string, attempt_no int, delivery_error string")
    sent = delivery.dry_run(planned, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    folder = str(tmp_path / "messages")
    for _ in range(2):
        archive.write_messages(sent, folder)
    bodies = [r["body"] for r in spark.read.json(folder).orderBy("chunk").collect()]
    assert [len(b) for b in bodies] == [4096, 904]
    audit = spark.createDataFrame([("m", "v1", "d1", "i", None, 1), ("m", "v1", "d2", "j", None, 2)], "model_name string, prompt_version string, document_version_id string, input_hash string, started_at timestamp, total_tokens int")
    runs = str(tmp_path / "runs")
    for _ in range(2):
        archive.record_runs(audit, runs)
    assert spark.read.parquet(runs).count() == 2
