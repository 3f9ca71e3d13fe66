import base64
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import records
from quillspark.sources import guards, readers, recordings, registry, robots
from quillspark.sources.retry import RetryPolicy

POLICY = {"sources": [{"source_id": "a", "connector_type": "rss", "active": True, "base_url": "https://a.example/", "rate_limit": {"requests_per_minute": 30, "burst": 2}}, {"source_id": "b", "connector_type": "html", "active": False}]}
RESPONSE = "source_id string, base_url string, status int, body string, etag string, last_modified string"


def items(spark, reader, body, status=200, etag="e1"):
    return reader(spark.createDataFrame([("a", "https://a.example/dir/", status, body, etag, None)], RESPONSE)).orderBy("position").collect()


def test_policy(spark):
    table = registry.source_table(spark, POLICY)
    assert [r.source_id for r in registry.active_sources(table).collect()] == ["a"]
    assert [r.source_id for r in registry.inactive_candidates(table).collect()] == ["b"]
    for bad in ({}, {"sources": []}, {"sources": [{"source_id": "a", "connector_type": "no"}]}, {"sources": POLICY["sources"] * 2}):
        with pytest.raises(registry.SourcePolicyError):
            registry.validate_policy(bad)
    with pytest.raises(registry.SourcePolicyError):
        registry.validate_policy(POLICY, fixtures=("b",))
    with pytest.raises(registry.SourceInactive):
        registry.read(spark, table, "b", spark.createDataFrame([], RESPONSE))


def test_sync_keeps_stored_rows(spark):
    table = registry.source_table(spark, POLICY)
    stored = table.where("source_id = 'a'").withColumn("name", F.lit("mine"))
    assert [(r.source_id, r.name) for r in registry.sync_sources(stored, table).collect()] == [("a", "mine")]
    new = spark.createDataFrame([("a", {"etag": "x"}, datetime(2024, 1, 1))], "source_id string, cursor map<string,string>, last_success_at timestamp")
    row = registry.persist_cursors(stored, new).first()
    assert row.cursor == {"etag": "x"} and row.name == "mine"


def test_settings():
    assert registry.Settings.load({"max_lookback_days": "10"}, {"QUILLSPARK_BRIEFING_MAX_ITEMS": "3"}).briefing_max_items == 3
    for bad in ({"nope": 1}, {"live_llm": True}, {"quote_max_chars": 400}, {"delivery_dry_run": False}):
        with pytest.raises(ValueError):
            registry.Settings.load(bad)
    assert registry.Settings.load({"live_llm": True, "approvals": ["live_llm"]}).live_llm


def test_cursors(spark):
    df = spark.createDataFrame([(None,), ('{"If-None-Match": "e", "x": "1"}',), ("plain",), ("{bad",)], "c string")
    got = [r[0] for r in df.select(registry.coerce_cursor(F.col("c"))).collect()]
    assert got == [{}, {"etag": "e", "x": "1"}, {"value": "plain"}, {}]
    m = spark.range(1).select(registry.conditional_headers(F.create_map(F.lit("etag"), F.lit("e"))).alias("h"), registry.response_cursor(F.create_map(F.lit("etag"), F.lit("e"), F.lit("k"), F.lit("v")), F.lit("f"), F.lit(None).cast("string")).alias("c")).first()
    assert m.h == {"If-None-Match": "e"} and m.c == {"etag": "f", "k": "v"}


RSS = """<?xml version="1.0"?><rss><channel><title>t</title>
<item><guid>g1</guid><link>/one</link><title> One </title><description>d</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>
<item><guid>g2</guid><link>https://b/two</link><title>Two</title></item>
<item><guid>g1</guid><link>/new</link><title>Newer</title><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>urn:1</id><title>A</title><link rel="self" href="/self"/><link rel="alternate" href="/alt"/><summary>s</summary><author><name>N</name></author><updated>2024-01-03T00:00:00Z</updated></entry>
<entry><id>urn:2</id><title>B</title><link href="https://x/y"/><published>2024-01-04T00:00:00+01:00</published></entry></feed>"""


def test_feeds(spark):
    rss = items(spark, readers.feed_items, RSS)
    assert [(r.item_id, r.title, r.url) for r in rss] == [("g1", "Newer", "https://a.example/new"), ("g2", "Two", "https://b/two")]
    assert rss[0].source_version_ref == "e1" and rss[1].published_at is None
    atom = items(spark, readers.feed_items, ATOM)
    assert [(r.item_id, r.url, r.author) for r in atom] == [("urn:1", "https://a.example/alt", "N"), ("urn:2", "https://x/y", None)]
    assert items(spark, readers.feed_items, RSS, status=304) == []
    start, end = F.lit(datetime(2024, 1, 2, 10)).cast("timestamp"), F.lit(datetime(2024, 1, 9)).cast("timestamp")
    df = spark.createDataFrame([("a", "https://a/", 200, RSS, None, None)], RESPONSE)
    assert {r.item_id for r in readers.feed_items(df, start, end).collect()} == {"g1", "g2"}
    assert {r.item_id for r in readers.feed_items(df, start + F.expr("INTERVAL 1 SECOND"), end).collect()} == {"g2"}


def test_json_metadata(spark):
    record = {"DOI": "10.1/x", "title": ["T", "U"], "author": [{"given": "A", "family": "B"}], "issued": {"date-parts": [[2024, 5]]}, "license": [{"URL": "https://l"}]}
    for body in ({"message": {"items": [record]}}, {"message": record}, [record], record, {"items": [record]}):
        (r,) = items(spark, readers.json_items, json.dumps(body))
        assert (r.item_id, r.title, r.author, r.url, r.license) == ("10.1/x", "T", "A B", "https://doi.org/10.1/x", "https://l")
        assert r.published_at == datetime(2024, 5, 1)


def test_releases_of_many_sources_are_not_broadcast(spark):
    df = spark.createDataFrame([], "source_id string, base_url string, status int, body string, etag string, last_modified string")
    plan = readers.release_items(df)._jdf.queryExecution().analyzed().toString()
    assert "Join LeftOuter" in plan and "ResolvedHint" not in plan and "broadcast" not in plan


def test_releases(spark):
    body = [{"id": 1, "name": "v1", "html_url": "https://g/1", "target_commitish": "aaa", "published_at": "2024-01-01T00:00:00Z"}, {"id": 2, "tag_name": "v2", "target_commitish": "bbb", "created_at": "2024-02-01T00:00:00Z"}, {"id": 3, "published_at": "2025-01-01T00:00:00Z"}]
    readme = {"html_url": "https://g/r", "encoding": "base64", "content": base64.b64encode("é hello".encode()).decode()}
    df = spark.createDataFrame([("a", "b", 200, json.dumps(body), None, None), ("a", "b", 200, json.dumps(readme), None, None)], RESPONSE)
    got = {r.item_id: r for r in readers.release_items(df).collect()}
    assert set(got) == {"release:1", "release:2", "release:3", "readme"} and {r.source_version_ref for r in got.values()} == {"bbb"} and got["readme"].body == "é hello"


def test_pages_and_files(spark, tmp_path):
    (tmp_path / "p.html").write_text("<title>T</title><script>x</script><p onload=y>z</p>")
    (r,) = readers.html_items(readers.responses(spark, str(tmp_path), "h", "https://h/")).collect()
    assert (r.title, r.body, r.url) == ("T", "<title>T</title><p>z</p>", "https://h/")


def test_guards(spark):
    rules = records.allow_rules(spark, ["https://ok.example/x", "plain.example", "port.example:8080"])
    df = spark.createDataFrame([(u,) for u in ("https://OK.example./a", "http://ok.example/", "http://plain.example/", "http://port.example:8080/", "http://port.example/", "ftp://ok.example/", "https://u:p@ok.example/", "https://ok.example/a b", None)], "url string")
    got = {r.url: r.url_error for r in guards.check_urls(df, rules).collect()}
    assert list(got.values()).count(None) == 3 and got["http://ok.example/"] == got["http://port.example/"] == "host_not_allowed"
    assert got["ftp://ok.example/"] == "unsupported_scheme" and got["https://u:p@ok.example/"] == "credentials_in_url" and got[None] == got["https://ok.example/a b"] == "malformed_url"
    hops = spark.createDataFrame([("https://ok.example/a", "/b", 0), ("https://ok.example/a", "https://evil/", 0), ("https://ok.example/a", "/b", 3)], "url string, location string, hops int")
    assert sorted(str(r.url_error) for r in guards.redirects(hops, rules).collect()) == ["None", "host_not_allowed", "too_many_redirects"]
    ips = spark.createDataFrame([(1, ["8.8.8.8"]), (2, ["8.8.8.8", "10.0.0.1"]), (3, []), (4, None)], "k int, addresses array<string>")
    assert {r.k: r.address_error for r in guards.check_addresses(ips).collect()} == {1: None, 2: "forbidden_address", 3: "forbidden_address", 4: "forbidden_address"}
    heads = spark.createDataFrame([("text/html; charset=x", "10"), ("image/png", str(10**9)), (None, None), ("TEXT/XML", "x")], "m string, n string")
    assert [tuple(r) for r in heads.select(guards.allowed_media(F.col("m")), guards.allowed_length(F.col("n"))).collect()] == [(True, True), (False, False), (False, True), (True, False)]
    assert guards.consume_limited([b"ab", b"c"], 3) == b"abc"
    with pytest.raises(guards.ResponseTooLarge):
        guards.consume_limited([b"ab", b"cd"], 3)


def test_robots(spark):
    body = "User-agent: other\nDisallow: /\n\nUser-agent: *\nUser-agent: bot\nDisallow: /a\nAllow: /a/b # c\nDisallow: /*.pdf$\nAllow: /x\nDisallow: /x\n"
    rules = robots.rule_table(spark.createDataFrame([("h", body), ("n", None), ("e", ""), ("o", "User-agent: other\nDisallow: /")], "host string, body string"), "Bot/1.0")
    df = spark.createDataFrame([("h", "/a/c"), ("h", "/a/b/c"), ("h", "/q.pdf"), ("h", "/q.pdf?x"), ("h", "/x"), ("h", "/z"), ("n", "/a"), ("o", "/a"), ("missing", "/")], "host string, path string")
    got = [(r.host, r.path, r.robots_allowed) for r in robots.decide(df, rules).collect()]
    assert sorted(got) == sorted([("h", "/a/c", "false"), ("h", "/a/b/c", "true"), ("h", "/q.pdf", "false"), ("h", "/q.pdf?x", "true"), ("h", "/x", "true"), ("h", "/z", "true"), ("n", "/a", "unknown"), ("o", "/a", "true"), ("missing", "/", "unknown")])


def test_retry(spark):
    p = RetryPolicy(most=3)
    assert [r[0] for r in spark.range(1, 9).select(p.backoff(F.col("id"))).collect()] == [1, 2, 4, 8, 16, 32, 60, 60]
    states = spark.createDataFrame([("a", 1, False, None, None, None), ("b", 2, False, None, None, None), ("c", 3, True, "x", None, None)], "source_id string, retry_count int, terminal_error boolean, error_class string, last_error_at timestamp, next_retry_at timestamp")
    t = datetime(2024, 1, 1)
    got = {r.source_id: r for r in p.record_failures(states, spark.createDataFrame([(s, "E", t) for s in "abcd"], "source_id string, error_class string, failed_at timestamp")).collect()}
    assert (got["a"].retry_count, got["a"].terminal_error, got["a"].next_retry_at) == (2, False, t + timedelta(seconds=2))
    assert (got["b"].retry_count, got["b"].status, got["b"].next_retry_at) == (3, "failed", None)
    assert (got["c"].retry_count, got["c"].error_class) == (3, "x") and got["d"].next_retry_at == t + timedelta(seconds=1)
    waits, tries = [], []
    with pytest.raises(OSError):
        p.run(lambda: tries.append(1) or (_ for _ in ()).throw(OSError()), waits.append)
    assert waits == [1, 2] and len(tries) == 3


def test_rate_limit_equals_a_simulated_bucket(spark):
    rng = random.Random(1)
    times = sorted(datetime(2024, 1, 1) + timedelta(milliseconds=rng.randrange(30_000)) for _ in range(60))
    requests = spark.createDataFrame([("a", t) for t in times], "source_id string, requested_at timestamp")
    got = [r.allowed_at for r in guards.rate_limit_waits(requests, registry.source_table(spark, POLICY)).orderBy("requested_at", "allowed_at").collect()]
    want, tokens, last = [], 2.0, None
    for t in (x.timestamp() for x in times):
        at = t if last is None else max(t, last)
        tokens = min(2.0, tokens + (0 if last is None else (at - last) / 2))
        if tokens < 1:
            at, tokens = at + (1 - tokens) * 2, 1.0
        tokens, last = tokens - 1, at
        want.append(at)
    assert all(abs(g.timestamp() - w) < 0.01 for g, w in zip(got, want))


def test_recordings(spark):
    prompts = spark.createDataFrame([("p1", "v", "h", "d1"), ("p2", "v", "h2", "d2"), ("p3", "v", "h3", "d3")], "prompt string, prompt_version string, content_hash string, document_version_id string")
    import hashlib

    known = spark.createDataFrame([(hashlib.sha256(b"p1").hexdigest(), '{"v":"{{document_version_id}}"}'), ("stable:v:h2", "s")], "key string, answer string")
    got = {r.prompt: (r.answer, r.error_class) for r in recordings.complete(prompts, known).collect()}
    assert got == {"p1": ('{"v":"d1"}', None), "p2": ("s", None), "p3": (None, "recording_missing")}
    calls = spark.createDataFrame([("m", "v", "d", "a b c", "x", None, 7, None, None, None, None)], "model_name string, prompt_version string, document_version_id string, prompt string, answer string, input_tokens int, output_tokens int, cost double, started_at timestamp, finished_at timestamp, error_class string")
    r = recordings.audit(calls, price=1.0).first()
    assert (r.input_tokens, r.output_tokens, r.total_tokens, r.cost, r.status) == (3, 7, 10, 0.01, "success")


def test_records(spark):
    runs = spark.createDataFrame([(datetime(2024, 1, 1), "success", 0), (datetime(2024, 1, 8), "failed", 1)], "window_end timestamp, run_status string, position int")
    occ = spark.createDataFrame([(datetime(2024, 1, 15), "success"), (datetime(2024, 3, 15), "failed"), (datetime(2023, 12, 1), "success")], "scheduled_for timestamp, run_status string")
    got = {r.scheduled_for: r for r in records.advance_cursor(runs, occ).collect()}
    a, b, c = (got[d] for d in (datetime(2024, 1, 15), datetime(2024, 3, 15), datetime(2023, 12, 1)))
    assert (a.window_start, a.cursor, a.truncated) == (datetime(2024, 1, 1), datetime(2024, 1, 15), False)
    assert b.truncated and b.cursor == datetime(2024, 1, 1) and c.window_start == datetime(2023, 11, 17)
    stored = spark.createDataFrame([("b1", 1, "approved")], "briefing_id string, run_attempt int, publication_status string")
    new = spark.createDataFrame([("b1", 1, "draft"), ("b2", 1, "draft")], stored.schema)
    assert sorted(map(tuple, records.upsert_briefings(stored, new).collect())) == [("b1", 2, "pending_approval"), ("b2", 1, "pending_approval")]
    assert sorted(r[0] for r in records.insert_absent(stored, new, "briefing_id").select("publication_status").collect()) == ["approved", "draft"]
    assert [r[0] for r in spark.createDataFrame([('{"status": "Relevant"}',), ("irrelevant",), ("x",)], "a string").select(records.model_label(F.col("a"))).collect()] == ["relevant", "irrelevant", None]
    assert records.delivery_mode({"a": "dry_run", "b": ""}) == "dry_run" and records.delivery_mode({"a": "dry_run", "b": "live"}) == "live"
