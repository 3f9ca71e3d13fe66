"""Queries of sources: connectors over recorded bodies, cursors, guards, robots, retries and recorded answers.

Bodies are made from orders: an order is a source, its lines are the entries of its feed.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import records
from quillspark.register import query, table
from quillspark.sources import guards, readers, recordings, registry, robots
from quillspark.sources.retry import RetryPolicy

#: Lines of an order, those that share a number told apart, in SQL.
_LINES = "SELECT l_orderkey AS o, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)::INT AS i, l_partkey AS p, l_shipdate::DATE AS d FROM lineitem"


def _lines(spark: SparkSession, sf_dir: str, entry: Column) -> DataFrame:
    """(source_id, entries): a text for each line of an order, in order; ``entry`` reads the struct ``e``."""
    made = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))).alias("es"))
    rows = made.select("l_orderkey", F.posexplode("es").alias("k", "e")).select("l_orderkey", (F.col("k") + 1).alias("i"), "e")
    texts = rows.select("l_orderkey", "i", entry.alias("text")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("es"))
    return texts.select(F.col("l_orderkey").alias("o"), F.transform("es", lambda e: e["text"]).alias("entries"))


def _responses(bodies: DataFrame, body: Column, **more: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return bodies.select(F.col("o").cast("string").alias("source_id"), F.lit("https://feeds.example.com/a/").alias("base_url"), F.when(F.col("o") % 10 == 9, 304).otherwise(200).alias("status"), body.alias("body"), more.get("etag", none).alias("etag"), more.get("last_modified", none).alias("last_modified"))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _day() -> Column:
    return F.date_format("e.l_shipdate", "yyyy-MM-dd")


@query(f"""
WITH l AS ({_LINES})
SELECT o::VARCHAR AS source_id, CASE WHEN i % 3 = 0 THEN 'https://x.example/' || o || '/' || i WHEN i % 3 = 1 THEN 'id-' || o || '-' || i ELSE 'Title ' || p || ' of ' || i END AS item_id,
       CASE WHEN i % 3 = 0 THEN 'https://x.example/' || o || '/' || i WHEN i % 3 = 1 THEN 'https://feeds.example.com/l/' || i ELSE 'https://feeds.example.com/a/Title ' || p || ' of ' || i END AS url,
       'Title ' || p || ' of ' || i AS title, 'Ann & Bob' AS author, epoch(d::TIMESTAMP)::BIGINT + 30600 AS published, 'e' || o AS version, (i - 1)::INT AS position
FROM l WHERE o % 2 = 0 AND o % 10 <> 9
""")
def rss_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as RSS feeds, some entries without an id, some without a link."""
    i = F.col("i")
    link = F.when(i % 3 == 0, _text("<link>https://x.example/", F.col("l_orderkey"), "/", i, "</link>")).when(i % 3 == 1, _text("<guid>id-", F.col("l_orderkey"), "-", i, "</guid><link>/l/", i, "</link>")).otherwise(F.lit("<link> </link>"))
    entry = _text("<item>", link, "<title>Title ", F.col("e.l_partkey"), " of ", i, "</title><author>Ann &amp; Bob</author><pubDate>", F.date_format("e.l_shipdate", "EEE, dd MMM yyyy"), " 08:30:00 GMT</pubDate></item>")
    body = _text('<?xml version="1.0"?><rss version="2.0"><channel><title>c</title>', F.array_join("entries", ""), "</channel></rss>")
    items = readers.feed_items(_responses(_lines(spark, sf_dir, entry).where("o % 2 = 0"), body, etag=_text("e", F.col("o"))))
    return items.select("source_id", "item_id", "url", "title", "author", F.unix_seconds("published_at").alias("published"), F.col("source_version_ref").alias("version"), "position")


@query(f"""
WITH l AS ({_LINES}), r AS (SELECT *, first_value(i) OVER w AS first, row_number() OVER (PARTITION BY o, p % 2 ORDER BY d DESC, i) AS k FROM l WINDOW w AS (PARTITION BY o, p % 2 ORDER BY i))
SELECT o::VARCHAR AS source_id, 'urn:' || (p % 2) AS item_id, 'https://x.example/' || o || '/' || i AS url, 'T' || i AS title, 'Body ' || p AS body, 'Ann' AS author, 'CC0' AS license, epoch(d::TIMESTAMP)::BIGINT AS updated, (first - 1)::INT AS position
FROM r WHERE k = 1 AND o % 2 = 1 AND o % 10 <> 9
""")
def atom_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as Atom feeds whose entries share two ids: the latest of each stays, at the place of the first."""
    entry = _text("<entry><id>urn:", F.col("e.l_partkey") % 2, '</id><link rel="self" href="/self"/><link rel="alternate" href="https://x.example/', F.col("l_orderkey"), "/", F.col("i"), '"/><title>T', F.col("i"), "</title><summary>Body ", F.col("e.l_partkey"), "</summary><author><name>Ann</name></author><rights>CC0</rights><published>2000-01-01T00:00:00Z</published><updated>", _day(), "T00:00:00Z</updated></entry>")
    body = _text('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>', F.array_join("entries", ""), "</feed>")
    items = readers.feed_items(_responses(_lines(spark, sf_dir, entry).where("o % 2 = 1"), body))
    return items.select("source_id", "item_id", "url", "title", "body", "author", "license", F.unix_seconds("updated_at").alias("updated"), "position")


@query(f"""
WITH l AS ({_LINES})
SELECT o::VARCHAR AS source_id, CASE WHEN i % 2 = 0 THEN '10.1/' || o || '.' || i ELSE 'https://x.example/' || i END AS item_id, CASE WHEN i % 2 = 0 THEN 'https://doi.org/10.1/' || o || '.' || i ELSE 'https://x.example/' || i END AS url,
       'T ' || p AS title, 'Ann Lee' AS author, 'https://cc.example/0' AS license, CASE WHEN i % 2 = 0 THEN d ELSE date_trunc('year', d)::DATE END AS published, (i - 1)::INT AS position
FROM l WHERE o % 10 <> 9
""")
def json_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bibliographic JSON in three layouts, with whole and partial dates."""
    day = F.col("e.l_shipdate")
    name = F.when(F.col("i") % 2 == 0, _text('"DOI":"10.1/', F.col("l_orderkey"), ".", F.col("i"), '"')).otherwise(_text('"URL":"https://x.example/', F.col("i"), '"'))
    parts = F.when(F.col("i") % 2 == 0, _text(F.year(day), ",", F.month(day), ",", F.dayofmonth(day))).otherwise(F.year(day).cast("string"))
    entry = _text("{", name, ',"title":["T ', F.col("e.l_partkey"), '"],"author":[{"given":"Ann","family":"Lee"}],"license":[{"URL":"https://cc.example/0"}],"issued":{"date-parts":[[', parts, "]]}}")
    listed = F.array_join("entries", ",")
    body = F.when(F.col("o") % 3 == 0, _text('{"message":{"items":[', listed, "]}}")).when(F.col("o") % 3 == 1, _text("[", listed, "]")).otherwise(_text('{"items":[', listed, "]}"))
    items = readers.json_items(_responses(_lines(spark, sf_dir, entry), body))
    return items.select("source_id", "item_id", "url", "title", "author", "license", F.to_date("published_at").alias("published"), "position")


@query(f"""
WITH l AS ({_LINES}), c AS (SELECT o, max_by('c' || i, d::VARCHAR || lpad(i::VARCHAR, 2, '0')) AS v FROM l WHERE i % 2 = 1 GROUP BY o)
SELECT o::VARCHAR AS source_id, 'release:' || i AS item_id, 'v' || p AS title, 'Notes ' || n AS body, v AS version, epoch(d::TIMESTAMP)::BIGINT + i AS published FROM l JOIN c USING (o) WHERE o % 10 <> 9
UNION ALL SELECT DISTINCT o::VARCHAR, 'readme', 'README', 'Read me ' || o, v, NULL FROM l JOIN c USING (o) WHERE o % 10 <> 9
""")
def release_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lists of releases, and a README in base64 each; all carry the latest commit."""
    stamp = _text(_day(), "T00:00:", F.lpad(F.col("i").cast("string"), 2, "0"), "Z")
    commit = F.when(F.col("i") % 2 == 1, _text('"c', F.col("i"), '"')).otherwise(F.lit("null"))
    name = F.when(F.col("i") % 2 == 1, F.lit("")).otherwise(_text("v", F.col("e.l_partkey")))
    entry = _text('{"id":', F.col("i"), ',"tag_name":"v', F.col("e.l_partkey"), '","name":"', name, '","body":"Notes ', F.col("e.l_linenumber"), '","target_commitish":', commit, ',"published_at":"', stamp, '"}')
    bodies = _lines(spark, sf_dir, entry)
    readme = _text('{"html_url":"https://x.example/r","encoding":"base64","content":"', F.base64(_text("Read me ", F.col("o")).cast("binary")), '"}')
    both = _responses(bodies, _text("[", F.array_join("entries", ","), "]")).unionByName(_responses(bodies, readme))
    return readers.release_items(both).select("source_id", "item_id", "title", "body", F.col("source_version_ref").alias("version"), F.unix_seconds("published_at").alias("published"))


_TEXT = "replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"')"


@query(f"""
SELECT page_id, 'sha256:' || sha256(html) AS version, trim(regexp_replace(replace({_TEXT.format("regexp_extract(html, '<title>(.*?)</title>', 1)")}, '&amp;', '&'), '\\s+', ' ', 'g')) AS title,
       md5({_TEXT.format("regexp_replace(regexp_replace(html, '<script>.*?</script>', '', 'gs'), '<!DOCTYPE html>|<!--.*?-->', '', 'gs')")}) AS body
FROM pages
""")
def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the response of a source of its own: one item with an inert body."""
    p = table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    items = readers.html_items(p.select(F.col("page_id").cast("string").alias("source_id"), F.col("url").alias("base_url"), F.lit(200).alias("status"), F.col("html").alias("body"), none.alias("etag"), none.alias("last_modified")))
    return items.select(F.col("source_id").cast("long").alias("page_id"), F.col("source_version_ref").alias("version"), "title", F.md5("body").alias("body"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber IN (1, 2, 5) AS media, CASE WHEN l_linenumber = 7 THEN false WHEN l_linenumber = 6 THEN true ELSE l_quantity * 300000 <= 10485760 END AS length FROM lineitem
""")
def response_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as responses: media types that may be read, and lengths within the bound."""
    n = F.col("l_linenumber")
    media = F.when(n == 1, "text/html; charset=utf-8").when(n == 2, " Application/JSON").when(n == 3, "image/png").when(n == 4, "text/csv").when(n == 5, "text/xml").when(n == 6, "")
    length = F.when(n == 7, "many").when(n < 6, (F.col("l_quantity") * 300000).cast("long").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", guards.allowed_media(media).alias("media"), guards.allowed_length(length).alias("length"))


@query("""
SELECT page_id, t AS target, CASE WHEN page_id % 5 >= 3 THEN 'too_many_redirects' WHEN page_id % 3 = 2 THEN 'credentials_in_url' WHEN h LIKE '%.example.com' THEN NULL ELSE 'host_not_allowed' END AS url_error
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS h, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/next' WHEN 1 THEN url ELSE 'https://u:p@a.example.com/' END AS t FROM pages)
""")
def redirect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirects of pages, each target checked like a first URL; rules come from entries of an allowlist."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    location = F.when(F.col("page_id") % 3 == 0, "/next").when(F.col("page_id") % 3 == 1, F.col("url")).otherwise("https://u:p@a.example.com/")
    hosts = pages.select(guards.url_parts(F.col("url"))["host"].alias("host")).distinct().where(F.col("host").like("%.example.com"))
    rules = hosts.select("host", F.lit(None).cast("string").alias("scheme"), F.lit(None).cast("int").alias("port")).unionByName(records.allow_rules(spark, ["a.example.com:443"]))
    out = guards.redirects(pages.withColumn("location", location).withColumn("hops", F.col("page_id") % 5), rules)
    return out.select("page_id", "target", "url_error")


@query("""
WITH r AS (SELECT user_id, epoch_us(ts) AS t, 60000000.0 / CASE user_id % 3 WHEN 0 THEN 0.002 WHEN 1 THEN 0.0005 ELSE 60 END AS gap, 1 + user_id % 2 AS burst, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events)
SELECT user_id, t AS requested, round(greatest(t, max(t - n * gap) OVER (PARTITION BY user_id ORDER BY t, n ROWS UNBOUNDED PRECEDING) + (n - burst + 1) * gap) / 1000000)::BIGINT AS allowed FROM r
""")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of users, spaced by token buckets of three rates."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("ts").alias("requested_at"))
    policy = F.from_json(F.when(F.col("source_id") % 3 == 0, '{"requests_per_minute":"0.002"}').when(F.col("source_id") % 3 == 1, '{"interval_seconds":"120000"}').otherwise('{"retry_after_seconds":"1"}'), "map<string,string>")
    sources = e.select("source_id").distinct().select("source_id", records.requests_per_minute(policy).alias("requests_per_minute"), (F.col("source_id") % 2 + 1).cast("int").alias("burst"))
    out = guards.rate_limit_waits(e.withColumn("requested_at", F.col("requested_at").cast("timestamp")), sources)
    return out.select(F.col("source_id").alias("user_id"), F.unix_micros("requested_at").alias("requested"), F.round(F.unix_micros("allowed_at") / 1e6).cast("long").alias("allowed"))


AGENTS = "User-agent: *\nDisallow: /\n\nUser-agent: quill\nUser-agent: other\nDisallow: /fr/\nAllow: /fr/8*5\n\nUser-agent: quillbot\nDisallow: /en/\nDisallow: /de/*2$\nAllow: /en/8\n\nUser-agent: quillbotter\nDisallow: /es/\n"


@query("""
WITH p AS (SELECT page_id, page_id % 4 = 3 AS unknown, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages),
r(allow, pattern, regex) AS (VALUES (false, '/en/', '^/en/'), (false, '/de/*2$', '^/de/.*2$'), (true, '/en/8', '^/en/8')),
b AS (SELECT page_id, allow, pattern FROM p JOIN r ON regexp_matches(path, regex) WHERE NOT unknown QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, allow DESC, pattern DESC) = 1)
SELECT page_id, CASE WHEN unknown THEN 'unknown' WHEN coalesce(allow, true) THEN 'true' ELSE 'false' END AS robots_allowed, pattern AS robots_rule FROM p LEFT JOIN b USING (page_id)
""")
def robots_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against a file with rules for several agents, of which the longest name that fits counts; some hosts have no file."""
    host = F.when(F.col("page_id") % 4 == 3, "none").otherwise("has")
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
    rules = robots.rule_table(spark.createDataFrame([("has", AGENTS), ("none", None)], "host string, body string"), "QuillBot/2.0 (+https://x)")
    return robots.decide(pages, rules).select("page_id", "robots_allowed", "robots_rule")


@query("""
SELECT page_id, target, regexp_extract(target, '^([a-z]+://[^/?#]+)', 1) || '/robots.txt' AS robots_url, CASE WHEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) LIKE '%.example.com' THEN 'User-agent: *' END AS robots_text
FROM (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://api.example.org/x/' || page_id WHEN 2 THEN 'https://base.example.org/' WHEN 3 THEN 'https://fetch.example.org/' || page_id END AS target FROM pages)
""")
def document_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL whose rules count for a document: of the request, of the item unless recorded, of the source; and its rule file."""
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"), F.when(k == 1, F.concat(F.lit("https://api.example.org/x/"), n)).alias("request_url"), F.when(k == 3, F.concat(F.lit("https://fetch.example.org/"), n)).otherwise(F.lit("  ")).alias("fetch_url"), F.when(k == 2, F.concat(F.lit("fixture://"), n)).otherwise(F.col("url")).alias("url"), F.lit("https://base.example.org/").alias("base_url"))
    judged = p.select("page_id", F.col("page_url").alias("url"), records.document_target(p).alias("target"))
    hosts = judged.select(F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("host")).distinct().where(F.col("host").like("%.example.com")).withColumn("body", F.lit("User-agent: *"))
    return records.with_robots_text(judged, hosts).select("page_id", "target", records.robots_target(F.col("target")).alias("robots_url"), "robots_text")


@query("""
WITH s AS (SELECT c_custkey, c_nationkey % 4 AS n, c_nationkey % 4 >= 3 OR c_custkey % 7 = 0 AS done, c_custkey % 3 = 0 AS hit FROM customer),
x AS (SELECT *, hit AND NOT done AS counts FROM s)
SELECT c_custkey::VARCHAR AS source_id, (n + counts::INT)::INT AS retry_count, CASE WHEN counts THEN n + 1 >= 3 ELSE done END AS terminal_error, CASE WHEN counts THEN 'timeout' ELSE 'old' END AS error_class,
       CASE WHEN counts THEN CASE WHEN n + 1 < 3 THEN 1704103200 + (2 ** n)::BIGINT END ELSE 1704067200 END AS next_retry,
       CASE WHEN (CASE WHEN counts THEN n + 1 >= 3 ELSE done END) THEN 'failed' WHEN n + counts::INT > 0 THEN 'retry_scheduled' ELSE 'ok' END AS status
FROM x
""")
def retry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources with failures behind them, a third of which fail once more."""
    at = lambda h: F.lit(datetime(2024, 1, 1, h)).cast("timestamp_ntz").cast("timestamp")
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string").alias("source_id")
    n = F.col("c_nationkey") % 4
    states = c.select(key, n.cast("int").alias("retry_count"), ((n >= 3) | (F.col("c_custkey") % 7 == 0)).alias("terminal_error"), F.lit("old").alias("error_class"), at(0).alias("last_error_at"), at(0).alias("next_retry_at"))
    failures = c.where("c_custkey % 3 = 0").select(key, F.lit("timeout").alias("error_class"), at(10).alias("failed_at"))
    out = RetryPolicy().record_failures(states, failures)
    return out.select("source_id", "retry_count", "terminal_error", "error_class", F.unix_seconds(F.col("next_retry_at").cast("timestamp_ntz").cast("timestamp")).alias("next_retry"), "status")


@query("""
SELECT c_custkey, CASE k WHEN 0 THEN 'etag=a' || c_custkey || ',last_modified=Mon' WHEN 1 THEN 'value=2024-01-0' || (1 + c_custkey % 9) WHEN 3 THEN 'window_end=2024-02-03T00:00:00Z' ELSE '' END AS cursor,
       CASE k WHEN 0 THEN 'If-Modified-Since=Mon,If-None-Match=a' || c_custkey ELSE '' END AS headers,
       CASE k WHEN 0 THEN 'etag=new,last_modified=Mon' WHEN 1 THEN 'etag=new,value=2024-01-0' || (1 + c_custkey % 9) WHEN 3 THEN 'etag=new,window_end=2024-02-03T00:00:00Z' ELSE 'etag=new' END AS after,
       CASE k WHEN 1 THEN DATE '2024-01-01' + (c_custkey % 9)::INT WHEN 3 THEN DATE '2024-02-03' END AS until
FROM (SELECT c_custkey, c_custkey % 4 AS k FROM customer)
""")
def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors as JSON, as a bare value, and none: folded, as request headers, after a response, and as a time."""
    k, n = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit('{"ETag":"a'), n, F.lit('","If-Modified-Since":"Mon"}'))).when(k == 1, F.concat(F.lit("2024-01-0"), (F.col("c_custkey") % 9 + 1).cast("string"))).when(k == 3, '{"window_end":"2024-02-03T00:00:00Z"}')
    c = table(spark, sf_dir, "customer").select("c_custkey", registry.coerce_cursor(raw).alias("m"))
    flat = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    after = registry.response_cursor(F.col("m"), F.lit("new"), F.lit(None).cast("string"))
    return c.select("c_custkey", flat(F.col("m")).alias("cursor"), flat(registry.conditional_headers(F.col("m"))).alias("headers"), flat(after).alias("after"), F.to_date(records.cursor_time(F.col("m"))).alias("until"))


@query("""
SELECT 'n' || n_nationkey AS source_id, CASE n_nationkey % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'html' ELSE 'github' END AS connector_type, n_regionkey < 3 AS active, n_nationkey % 5 = 0 AS fixture, CASE WHEN n_nationkey % 2 = 0 THEN 30.0 ELSE 60.0 END::DOUBLE AS requests_per_minute,
       CASE WHEN n_nationkey % 4 = 0 THEN 'e' || n_nationkey END AS etag, n_regionkey >= 3 AND n_nationkey % 5 <> 0 AS candidate
FROM nation WHERE n_regionkey < 3 OR n_nationkey % 2 = 1
""")
def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a policy of sources: validated, synchronised with a stored half, and given new cursors."""
    nations = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # a dimension of 25 rows
    policy = {"sources": [{"source_id": f"n{r.n_nationkey}", "connector_type": ("rss", "html", "github")[r.n_nationkey % 3], "active": r.n_regionkey < 3, "fixture": r.n_nationkey % 5 == 0, "rate_limit": {"requests_per_minute": 30} if r.n_nationkey % 2 == 0 else None} for r in nations]}
    whole = registry.source_table(spark, policy)
    key = F.substring("source_id", 2, 9).cast("int")
    stored = registry.sync_sources(whole.where(key % 2 == 1), whole)
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    updates = registry.active_sources(stored).unionByName(stored.where("NOT active")).where(key % 4 == 0).select("source_id", registry.response_cursor(empty, F.concat(F.lit("e"), key.cast("string")), F.lit(None).cast("string")).alias("cursor"), F.lit(None).cast("timestamp").alias("last_success_at"))
    kept = registry.persist_cursors(stored, updates)
    spare = registry.inactive_candidates(kept).select("source_id", F.lit(True).alias("candidate"))
    return kept.join(spare, "source_id", "left").select("source_id", "connector_type", "active", "fixture", "requests_per_minute", F.col("cursor")["etag"].alias("etag"), F.coalesce("candidate", F.lit(False)).alias("candidate"))


_TOKENS = r"greatest(1, len(list_filter(regexp_split_to_array(trim({}), '\s+'), lambda w: w <> '')))"


@query(rf"""
WITH c AS (SELECT *, 'Ask ' || conv_id || ' ' || turn AS prompt, CASE role WHEN 'user' THEN 'exact answer' WHEN 'assistant' THEN 'stable v' || conv_id END AS answer FROM conversations),
t AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 7 ELSE {_TOKENS.format('prompt')} END AS i, CASE WHEN answer IS NULL THEN 0 ELSE {_TOKENS.format('answer')} END AS o FROM c)
SELECT conv_id, turn, answer, sha256(prompt) AS input_hash, sha256(answer) AS output_hash, i::INT AS input_tokens, o::INT AS output_tokens, round(CASE WHEN turn % 3 = 0 THEN 0.5 ELSE (i + o) * 0.2 / 1000 END, 9) AS cost,
       CASE WHEN answer IS NULL THEN 'failed' ELSE 'success' END AS status, CASE WHEN answer IS NULL THEN 'recording_missing' END AS error_class
FROM t
""")
def audited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as prompts with recorded answers, by their exact hash or by a stable key, and the audit of every call."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("Ask "), F.col("conv_id").cast("string"), F.lit(" "), F.col("turn").cast("string")).alias("prompt"), F.lit("p1").alias("prompt_version"), F.md5(F.concat_ws("|", "conv_id", "turn")).alias("content_hash"), F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("document_version_id"))
    exact = c.where("role = 'user'").select(F.sha2("prompt", 256).alias("key"), F.lit("exact answer").alias("answer"))
    stable = c.where("role = 'assistant'").select(recordings.stable_key(F.col("prompt_version"), F.col("content_hash")).alias("key"), F.lit("stable {{document_version_id}}").alias("answer"))
    done = recordings.complete(c, exact.unionByName(stable))
    none = F.lit(None)
    calls = done.withColumns({"model_name": F.concat_ws("|", "conv_id", "turn", "answer"), "input_tokens": F.when(F.col("turn") % 2 == 0, 7), "output_tokens": none.cast("int"), "cost": F.when(F.col("turn") % 3 == 0, 0.5), "started_at": none.cast("timestamp"), "finished_at": none.cast("timestamp")})
    name = F.split("model_name", r"\|")
    audit = recordings.audit(calls, 0.2)
    return audit.select(name[0].cast("long").alias("conv_id"), name[1].cast("long").alias("turn"), F.get(name, F.lit(2)).alias("answer"), "input_hash", "output_hash", "input_tokens", "output_tokens", F.round("cost", 9).alias("cost"), "status", "error_class")


@query("""SELECT conv_id, '{"n":' || max(turn) || '}' AS usage FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def reported_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events of calls: the last one of each that reports usage."""
    n = F.col("turn").cast("string")
    event = F.when(F.col("role") == "assistant", F.concat(F.lit('{"usage":{"n":'), n, F.lit("}}"))).otherwise(F.concat(F.lit('{"other":'), n, F.lit("}")))
    return records.last_usage(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line_no"), event.alias("event")), "conv_id")


@query(r"""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '<raw ' || c_custkey || '>' WHEN 1 THEN 'record ' || c_name ELSE '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' END AS body,
       'a=2,b=1,c=' || c_mktsegment AS merged, substr(c_name || ' A_TOKEN=[REDACTED] ' || repeat('x', 300), 1, 200) AS summary FROM customer
""")
def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records: the body that is kept of each, metadata merged over older, and a bounded summary."""
    k = F.col("c_custkey") % 3
    c = table(spark, sf_dir, "customer")
    d = c.select("c_custkey", "c_name", F.when(k == 0, F.concat(F.lit("<raw "), F.col("c_custkey").cast("string"), F.lit(">"))).alias("raw_body"), F.when(k == 1, F.concat(F.lit("record "), F.col("c_name"))).alias("raw_record"), "c_mktsegment")
    old, new = F.from_json(F.lit('{"a":"1","b":"1"}'), "map<string,string>"), F.map_from_arrays(F.array(F.lit("a"), F.lit("c")), F.array(F.lit("2"), F.col("c_mktsegment")))
    merged = F.array_join(F.array_sort(F.transform(F.map_entries(records.merge_maps(old, new)), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    summary = records.bounded(F.concat(F.col("c_name"), F.lit(" A_TOKEN=hidden "), F.lit("x" * 300)))
    return d.select("c_custkey", records.raw_body(d.select("c_custkey", "c_name", "raw_body", "raw_record")).alias("body"), merged.alias("merged"), summary.alias("summary"))
