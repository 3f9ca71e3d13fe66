import json
from datetime import datetime

from quillspark.streaming import ingest

SCHEMA = "source_id string, item_id string, url string, body string, content_hash string, retrieved_at timestamp, position int"


def land(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def item(i, body, day=1):
    return {"source_id": "s", "item_id": str(i), "url": f"http://h/{i}", "body": body, "retrieved_at": f"2024-01-0{day}T00:00:00Z", "position": i}


def test_version_log_is_exact_over_restarts(spark, tmp_path):
    src, log, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "check")
    land(src, "1.json", item(1, "a"), item(2, "b"), item(1, "a"))
    stream = lambda: ingest.items_stream(spark, str(src), SCHEMA.replace("content_hash string, ", ""), 1)
    ingest.version_log(stream(), log, check).awaitTermination()
    land(src, "2.json", item(1, "a", 2), item(1, "c", 3))
    land(src, "3.json", item(1, "a", 4))
    ingest.version_log(stream(), log, check).awaitTermination()
    got = sorted((r.canonical_url, r.version_no, r.normalized_body) for r in spark.read.parquet(f"{log}/*").collect())
    assert got == [("http://h/1", 1, "a"), ("http://h/1", 2, "c"), ("http://h/2", 1, "b")]
    ingest.append_versions(spark.read.schema(SCHEMA.replace("content_hash string, ", "")).json(str(src / "1.json")), 0, log)
    assert spark.read.parquet(f"{log}/*").count() == 3


def test_state_machine_keeps_state_between_batches(spark, tmp_path):
    src = tmp_path / "steps"
    land(src, "1.json", {"k": "a", "t": 1, "target": "collected"}, {"k": "b", "t": 1, "target": "approved"})
    land(src, "2.json", {"k": "a", "t": 2, "target": "normalized"}, {"k": "a", "t": 3, "target": "collected"})
    steps = spark.readStream.schema("k string, t int, target string").option("maxFilesPerTrigger", 1).json(str(src))
    q = ingest.machine(steps, "k", "t").writeStream.format("memory").queryName("machine").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("machine").collect())) == [("a", "collected", "normalized", True), ("a", "discovered", "collected", True), ("a", "normalized", "collected", False), ("b", "discovered", "approved", False)]


def test_rates_and_recent(spark, tmp_path):
    src = tmp_path / "ev"
    land(src, "1.json", *[{"ts": f"2024-01-{d:02d}T00:00:00Z", "event_type": "error" if d == 2 else "ok"} for d in (1, 2, 9, 30)])
    events = spark.readStream.schema("ts timestamp, event_type string").json(str(src))
    q = ingest.event_rates(events, "ts").writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.start, r.n, r.failed) for r in spark.table("rates").collect())
    assert sum(g[1] for g in got) == 3 and sum(g[2] for g in got) == 1 and got[0][0] <= datetime(2024, 1, 1)
    land(tmp_path / "it", "1.json", item(1, "a") | {"content_hash": "h"}, item(1, "a") | {"content_hash": "h"}, item(2, "a") | {"content_hash": "h"})
    q = ingest.recent(ingest.items_stream(spark, str(tmp_path / "it"), SCHEMA)).writeStream.format("memory").queryName("recent").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("recent").count() == 2
