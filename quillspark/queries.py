"""Registered queries: operators over the provided tables through adapters, and SQL for the same rows.

The provided tables have no candidates or reports, so each query maps columns to the roles that an
operator expects; the adapters are the ``select`` lists at the top of each function.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import html, text, timing, urls
from quillspark.operators import briefing, delivery, evidence, gate, lint, metrics, novelty, relevance, routing, scoring, states, versions
from quillspark.register import ORACLES, QUERIES, query, table
from quillspark.sources import guards, readers, robots
from quillspark.sources.retry import RetryPolicy

FIRST, LAST = datetime(2024, 1, 1), datetime(2024, 2, 5)
WEEK = ("window_start",)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("window_start", timing.window_start(F.col("ts"), FIRST))


def _weeks(spark: SparkSession) -> DataFrame:
    return timing.observation_windows(spark, FIRST, LAST).select(F.col("start").alias("window_start"))


def _m(df: DataFrame) -> DataFrame:
    return df.select("window_start", "metric_id", F.round("value", 6).alias("value"), "sample_size", "verdict")


def _sql_metric(metric: str, rows: str, value: str, n: str, target: float, reach: bool) -> str:
    sign = ">=" if reach else "<="
    return f"""
WITH w AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29', INTERVAL 7 DAY)) AS window_start),
e AS (SELECT *, TIMESTAMP '2024-01-01' + INTERVAL 7 DAY * (date_diff('second', TIMESTAMP '2024-01-01', ts) // 604800) AS window_start FROM events),
r AS ({rows}),
a AS (SELECT w.window_start, {n} AS n, {value} AS v FROM w LEFT JOIN r USING (window_start) GROUP BY 1)
SELECT window_start, '{metric}' AS metric_id, round(CASE WHEN n > 0 THEN v END, 6) AS value, n AS sample_size,
       CASE WHEN n = 0 THEN 'insufficient_data' WHEN v {sign} {target} THEN 'met' ELSE 'breached' END AS verdict
FROM a
"""


_SQL_M1 = _sql_metric("M1", "SELECT window_start, event_type FROM e JOIN customer ON user_id = c_custkey WHERE c_acctbal > 0", "count(*) FILTER (WHERE event_type <> 'error')::DOUBLE / count(event_type)", "count(event_type)", 0.95, True)
_SQL_M4 = _sql_metric("M4", "SELECT window_start, event_type FROM e QUALIFY row_number() OVER (PARTITION BY window_start, user_id, event_id % 3 ORDER BY ts DESC, event_id DESC) = 1", "count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(event_type)", "count(event_type)", 0.02, False)
_SQL_M5 = _sql_metric("M5", "SELECT window_start, rn FROM (SELECT window_start, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS rn FROM e)", "count(*) FILTER (WHERE rn > 1)::DOUBLE / count(rn)", "count(rn)", 0.0, False)


@query(_SQL_M1)
def collection_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: events as jobs, customers with a positive balance as active sources."""
    e = _events(spark, sf_dir)
    jobs = e.select("window_start", F.col("user_id").alias("source_id"), F.when(F.col("event_type") != "error", "success").otherwise("failed").alias("status"), F.lit(True).alias("terminal_error"))
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_acctbal") > 0).alias("active"))
    return _m(metrics.collection_success(jobs, sources, _weeks(spark), WEEK))


@query("""
WITH l AS (
  SELECT date_trunc('month', o_orderdate)::DATE AS order_month, l_orderkey, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS delay
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey, l_shipdate) = 1)
SELECT order_month, max(delay)::DOUBLE AS longest, median(delay)::DOUBLE AS middle, count(*) AS n,
       CASE WHEN max(delay) <= 30 THEN 'met' ELSE 'breached' END AS verdict
FROM l GROUP BY 1
""")
def draft_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: orders as reports, their lines as attempts, days from order to shipping as delay."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("ordered"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select(F.trunc("ordered", "month").alias("order_month"), F.col("l_orderkey").alias("briefing_id"), F.col("l_linenumber").alias("run_attempt"), F.struct("l_partkey", "l_suppkey", "l_shipdate").alias("tie"), F.date_diff(F.col("l_shipdate").cast("date"), "ordered").alias("delay"))
    last = metrics.final_rows(rows, ["order_month", "briefing_id"], [F.desc("run_attempt"), F.asc("tie")])
    counted = last.groupBy("order_month").agg(F.max("delay").cast("double").alias("longest"), F.median("delay").alias("middle"), F.count("*").alias("n"))
    return counted.withColumn("verdict", F.when(F.col("longest") <= 30, "met").otherwise("breached"))


@query("""
SELECT count(*) FILTER (WHERE o_orderstatus = 'P')::DOUBLE AS value, count(*) AS sample_size,
       CASE WHEN count(*) = 0 THEN 'insufficient_data' WHEN count(*) FILTER (WHERE o_orderstatus = 'P') <= 20 THEN 'met' ELSE 'breached' END AS verdict
FROM orders
""")
def review_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: open orders as candidates that wait."""
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", "needs_review").otherwise("approved").alias("review_status"))
    one = spark.range(1).select(F.lit("all").alias("window_id"))
    return metrics.review_backlog(rows, one).select("value", "sample_size", "verdict")


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("window_start", F.col("user_id").alias("briefing_id"), (F.col("event_id") % 3).alias("channel"), F.lit(1).alias("attempt_no"), F.col("ts").alias("attempted_at"), F.col("event_id").alias("delivery_id"), F.when(F.col("event_type") == "error", "failed").otherwise("sent").alias("status"))


@query(_SQL_M4)
def delivery_failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: events as delivery attempts of (user, event_id mod 3)."""
    return _m(metrics.delivery_failure(_deliveries(spark, sf_dir), _weeks(spark), WEEK))


def _version_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("window_start", F.col("user_id").alias("document_id"), F.concat_ws("|", "event_type", "props").alias("content_hash"), F.col("ts").alias("created_at"), F.lit(1).alias("version_no"), F.col("event_id").alias("document_version_id"))


@query(_SQL_M5)
def duplicate_version_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: a user's events as versions, type and properties as content."""
    return _m(metrics.duplicate_rate(_version_rows(spark, sf_dir), _weeks(spark), WEEK))


@query("""
SELECT count(*) FILTER (WHERE n = 0)::DOUBLE / count(*) AS value, count(*) AS sample_size, CASE WHEN value <= 0 THEN 'met' ELSE 'breached' END AS verdict
FROM (SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS n FROM orders WHERE o_orderstatus = 'F')
""".replace("count(*) FILTER (WHERE n = 0)::DOUBLE / count(*) AS value", "round(count(*) FILTER (WHERE n = 0)::DOUBLE / count(*), 6) AS value"))
def evidence_gap_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: finished orders as items, returned lines as evidence."""
    items = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.lit("all").alias("window_id"), F.col("o_orderkey").alias("item_id"))
    linked = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item_id"))
    one = spark.range(1).select(F.lit("all").alias("window_id"))
    return metrics.evidence_gap(items, linked, one).select(F.round("value", 6).alias("value"), "sample_size", "verdict")


_SQL_M2 = _sql_metric("M2", "SELECT window_start, event_id % 97 AS delay FROM e WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY window_start, user_id ORDER BY event_id % 5 DESC, event_id) = 1", "max(delay)::DOUBLE", "count(delay)", 30.0, False)
_SQL_M3 = """
SELECT window_start, 'M3' AS metric_id, waiting::DOUBLE AS value, n AS sample_size, CASE WHEN n = 0 THEN 'insufficient_data' WHEN waiting <= 20 THEN 'met' ELSE 'breached' END AS verdict
FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29', INTERVAL 7 DAY)) AS window_start), (SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS waiting, count(*) AS n FROM orders)
"""
_SQL_M6 = _sql_metric("M6", "SELECT window_start, user_id FROM e WHERE event_type = 'purchase'", "count(*) FILTER (WHERE user_id % 2 = 1)::DOUBLE / count(user_id)", "count(user_id)", 0.0, False)
_SQL_ALL = " UNION ALL ".join(f"SELECT * FROM ({m})" for m in (_SQL_M1, _SQL_M2, _SQL_M3, _SQL_M4, _SQL_M5, _SQL_M6))


def _six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of each week: events as jobs, attempts, deliveries and versions, purchases as claims, orders as candidates."""
    e = _events(spark, sf_dir)
    jobs = e.select("window_start", F.col("user_id").alias("source_id"), F.when(F.col("event_type") != "error", "success").otherwise("failed").alias("status"), F.lit(True).alias("terminal_error"))
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_acctbal") > 0).alias("active"))
    reports = e.where("event_type <> 'error'").select("window_start", F.col("user_id").alias("briefing_id"), (F.col("event_id") % 5).alias("run_attempt"), F.col("event_id").alias("tie"), (F.col("event_id") % 97).alias("delay"))
    waiting = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", "needs_review").otherwise("approved").alias("review_status"))
    claims = e.where("event_type = 'purchase'").select("window_start", F.col("event_id").alias("item_id"), "user_id")
    weeks = _weeks(spark)
    out = metrics.collection_success(jobs, sources, weeks, WEEK)
    for more in (
        metrics.briefing_delay(reports, weeks, WEEK),
        metrics.review_backlog(waiting, weeks, WEEK),
        metrics.delivery_failure(_deliveries(spark, sf_dir), weeks, WEEK),
        metrics.duplicate_rate(_version_rows(spark, sf_dir), weeks, WEEK),
        metrics.evidence_gap(claims.select("window_start", "item_id"), claims.where("user_id % 2 = 0").select("item_id"), weeks, WEEK),
    ):
        out = out.unionByName(more)
    return out


@query(f"""
WITH m AS ({_SQL_ALL}), ids AS (SELECT unnest(['M1', 'M2', 'M3', 'M4', 'M5', 'M6']) AS metric_id),
w AS (SELECT DISTINCT window_start FROM m)
SELECT w.window_start, metric_id, m.value, coalesce(m.sample_size, 0) AS sample_size, coalesce(m.verdict, 'insufficient_data') AS verdict
FROM w CROSS JOIN ids LEFT JOIN m USING (window_start, metric_id)
""")
def metric_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six metrics of every week."""
    return _m(metrics.complete_rows(_six(spark, sf_dir), _weeks(spark), WEEK))


@query(f"""
SELECT strftime(window_start, '%Y-%m-%d') || ':' || metric_id AS alert_id, CASE verdict WHEN 'breached' THEN 'error' ELSE 'warning' END AS severity, verdict
FROM ({_SQL_ALL}) WHERE verdict IN ('breached', 'insufficient_data')
""")
def metric_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the weekly metrics."""
    rows = _six(spark, sf_dir).withColumn("window_id", F.date_format("window_start", "yyyy-MM-dd"))
    return metrics.alerts(rows).select("alert_id", "severity", "verdict")


@query(f"""
WITH m AS ({_SQL_ALL}), l AS (SELECT DISTINCT window_start FROM m ORDER BY 1 DESC LIMIT 4)
SELECT count(DISTINCT window_start) AS windows, true AS consecutive, count(*) FILTER (WHERE verdict = 'insufficient_data') AS insufficient,
       count(*) FILTER (WHERE verdict = 'breached') AS breached, bool_and(verdict = 'met') AS all_met,
       array_to_string(list_sort(list_distinct(list(metric_id) FILTER (WHERE verdict <> 'met'))), ',') AS blocked_metrics,
       CASE WHEN count(*) FILTER (WHERE verdict = 'insufficient_data') > 0 THEN 'insufficient_data' WHEN count(*) FILTER (WHERE verdict = 'breached') > 0 THEN 'breached' ELSE 'eligible' END AS reason,
       bool_and(verdict = 'met') AS eligible
FROM m JOIN l USING (window_start)
""")
def expansion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four weeks against all six metrics."""
    rows = _six(spark, sf_dir).withColumn("window_id", F.col("window_start").cast("string"))
    weeks = timing.observation_windows(spark, FIRST, LAST).withColumn("window_id", F.col("start").cast("string"))
    return metrics.expansion_gate(rows, weeks).withColumn("blocked_metrics", F.array_join("blocked_metrics", ","))


#: Terms that occur in the invented prose.
TERMS = relevance.Terms(microstructure=("that", "with"), strategy=("rewh", "this"), background=("tion",), irrelevant=("hehely", "orre"), horizon=("from",))


def _sql_terms(terms: tuple[str, ...]) -> str:
    return "list_filter([" + ", ".join(f"'{t}'" for t in sorted(terms)) + "], lambda t: contains(x, t))"


@query(f"""
WITH d AS (SELECT doc_id, lower(text) AS x FROM documents),
t AS (SELECT doc_id, x, {_sql_terms(TERMS.microstructure)} AS m, {_sql_terms(TERMS.strategy)} AS s, {_sql_terms(TERMS.background)} AS b, {_sql_terms(TERMS.irrelevant)} AS i FROM d)
SELECT doc_id, array_to_string(m, ',') AS microstructure_terms, array_to_string(s, ',') AS strategy_terms, array_to_string(b, ',') AS background_terms, array_to_string(i, ',') AS irrelevant_terms,
       CASE WHEN len(i) > 0 AND len(s) = 0 THEN 'irrelevant' WHEN len(s) > 0 AND (len(m) > 0 OR contains(x, 'from')) THEN 'relevant'
            WHEN len(m) > 0 OR len(b) > 0 THEN 'background_only' ELSE 'irrelevant' END AS relevance
FROM t
""")
def relevance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term rules over all documents."""
    out = relevance.classify(table(spark, sf_dir, "documents"), TERMS, explain=False)
    return out.select("doc_id", *[F.array_join(f"{n}_terms", ",").alias(f"{n}_terms") for n in relevance.SIGNALS], "relevance")


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def evidence_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark items as quotes, found in all documents."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return evidence.contained(quotes, docs).select("item_id", "doc_id")


@query("""
WITH q AS (SELECT conv_id, turn, role, text, length(trim(text)) BETWEEN 1 AND 300 AS fits FROM conversations)
SELECT conv_id, turn, role, coalesce(fits AND row_number() OVER (PARTITION BY conv_id, role, fits ORDER BY turn) <= 2, false) AS in_limits FROM q
""")
def quote_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as quotes of (conversation, role): two each, of 1 to 300 characters."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return evidence.within_limits(rows, ["conv_id", "role"], "text", "turn").select("conv_id", "turn", "role", "in_limits")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("candidate_id"),
        F.col("p_name").alias("canonical_name"),
        F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("official ")).otherwise(F.lit("")), F.col("p_brand")).alias("source_type"),
        F.col("p_brand").alias("strategy_families"),
        F.col("p_type").alias("asset_classes"),
        F.when(F.col("p_size") < 10, "seconds").when(F.col("p_size") < 25, "hours").otherwise("days").alias("holding_horizon"),
        F.col("p_name").alias("core_hypothesis"),
        F.col("p_type").alias("entry_logic"),
        F.when(F.col("p_size") < 40, F.col("p_brand")).alias("exit_logic"),
        F.when(F.col("p_size") % 3 == 0, "inferred").otherwise("explicit").alias("core_hypothesis_status"),
        F.timestamp_add("DAY", -F.col("p_size").cast("int"), F.lit(datetime(2024, 1, 31))).cast("timestamp_ntz").cast("string").alias("published_at"),
        F.when(F.col("p_size") % 5 == 0, "variant").when(F.col("p_size") % 7 == 0, "new").alias("novelty_status"),
        ((F.col("p_retailprice") % 100) / 100).alias("extraction_confidence"),
        F.col("p_size"),
    )


_SQL_SCORE = """
WITH p AS (SELECT p_partkey AS candidate_id, p_size AS s, p_type AS t, p_brand AS b, p_name AS n, p_retailprice AS price FROM part),
c AS (SELECT candidate_id, price, s,
  CASE WHEN s % 2 = 0 OR contains(lower(b), 'exchange') THEN 10 ELSE 6 END + 4 AS source_reliability,
  CASE WHEN s % 3 = 0 THEN 1 ELSE 2 END + 3 + CASE WHEN s < 40 THEN 3 ELSE 0 END + 2 + 2 + 2 AS reproducibility,
  CASE WHEN s < 10 THEN 6 WHEN s < 25 THEN 3 ELSE 0 END + 2 + CASE WHEN s < 40 THEN 1 ELSE 0 END AS relevance,
  CASE WHEN s <= 1 THEN 10 WHEN s <= 7 THEN 8 WHEN s <= 14 THEN 6 WHEN s <= 30 THEN 4 WHEN s <= 90 THEN 2 ELSE 0 END AS recency,
  CASE WHEN s % 5 = 0 THEN 6 WHEN s % 7 = 0 THEN 10 ELSE 5 END AS novelty
FROM p)
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_parts(spark, sf_dir), F.lit(datetime(2024, 1, 31)).cast("timestamp"))


@query(_SQL_SCORE + "SELECT candidate_id, (source_reliability + reproducibility + relevance + recency + novelty)::INT AS value_score FROM c")
def value_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value score of parts as candidates."""
    return _scored(spark, sf_dir).select("candidate_id", "value_score")


@query(_SQL_SCORE + "SELECT candidate_id, k AS criterion, v::INT AS score FROM c UNPIVOT (v FOR k IN (source_reliability, reproducibility, relevance, recency, novelty))")
def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five criteria of each part."""
    return _scored(spark, sf_dir).select("candidate_id", F.explode("score_breakdown").alias("criterion", "c")).select("candidate_id", "criterion", F.col("c.score").alias("score"))


@query(_SQL_SCORE + """, r AS (SELECT candidate_id, source_reliability + reproducibility + relevance + recency + novelty AS v, (price % 100) / 100 AS conf FROM c)
SELECT candidate_id, CASE WHEN v BETWEEN 40 AND 60 OR conf < 0.7 THEN 'needs_review' ELSE 'rejected' END AS review_status,
       concat_ws(',', CASE WHEN v BETWEEN 40 AND 60 THEN 'borderline_score' END, CASE WHEN conf < 0.7 THEN 'low_extraction_confidence' END) AS route_reasons
FROM r""")
def route_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored parts, routed at a threshold of 50."""
    return routing.route(_scored(spark, sf_dir), threshold=50.0).select("candidate_id", "review_status", F.array_join("route_reasons", ",").alias("route_reasons"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Roles of the comparison: large parts are a run's new candidates, small ones those that were there before it."""
    p = _parts(spark, sf_dir)
    return p.where("p_size > 25"), p.where("p_size <= 25")


_SQL_FOLD = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_SQL_PAIRS = f"""
WITH p AS (
  SELECT p_partkey AS id, p_size AS s, {_SQL_FOLD.format('p_name')} AS n, {_SQL_FOLD.format('p_brand')} AS f, {_SQL_FOLD.format('p_type')} AS a,
         CASE WHEN p_size < 10 THEN 1 WHEN p_size < 25 THEN 3 ELSE 4 END AS h,
         list_distinct(string_split({_SQL_FOLD.format('p_name')}, ' ')) AS c1, list_distinct(string_split({_SQL_FOLD.format('p_type')}, ' ')) AS c2,
         CASE WHEN p_size < 40 THEN list_distinct(string_split({_SQL_FOLD.format('p_brand')}, ' ')) ELSE [] END AS c3
  FROM part),
j AS (
  SELECT x.id AS a, y.id AS b, x.n = y.n AS same_name, x.f = y.f AND x.a = y.a AND x.h = y.h AS same_profile, x.f = y.f AND x.a = y.a AND x.h = y.h AS related,
         len(list_intersect(x.c1, y.c1))::DOUBLE / len(list_distinct(x.c1 || y.c1)) AS j1, len(list_intersect(x.c2, y.c2))::DOUBLE / len(list_distinct(x.c2 || y.c2)) AS j2,
         CASE WHEN len(x.c3 || y.c3) = 0 THEN 1.0 ELSE len(list_intersect(x.c3, y.c3))::DOUBLE / len(list_distinct(x.c3 || y.c3)) END AS j3
  FROM p x JOIN p y ON x.s > 25 AND y.s <= 25 AND (x.n = y.n OR (x.f = y.f AND x.a = y.a))),
k AS (SELECT *, round((j1 + j2 + j3 + 3) / 6, 6) AS similarity FROM j),
r AS (SELECT *, CASE WHEN same_name AND same_profile AND similarity = 1.0 THEN 'new_evidence' WHEN same_name AND same_profile THEN 'changed' WHEN similarity >= 0.35 AND (related OR same_name) THEN 'variant' END AS relation FROM k)
"""


@query(_SQL_PAIRS + "SELECT a, b, similarity, relation FROM r WHERE relation IS NOT NULL")
def field_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large parts against small ones that share a name, or brand and type."""
    return novelty.relations(*_sides(spark, sf_dir), fold=text.fold_ascii)


@query(_SQL_PAIRS + """, g AS (SELECT a, min(CASE relation WHEN 'new_evidence' THEN 2 WHEN 'changed' THEN 3 ELSE 4 END) AS best FROM r WHERE relation IS NOT NULL GROUP BY a)
SELECT p.id AS candidate_id, CASE best WHEN 2 THEN 'new_evidence' WHEN 3 THEN 'changed' WHEN 4 THEN 'variant' ELSE 'new' END AS novelty_status,
       coalesce((SELECT string_agg(b::VARCHAR, ',' ORDER BY b) FROM r WHERE r.a = p.id AND CASE relation WHEN 'new_evidence' THEN 2 WHEN 'changed' THEN 3 WHEN 'variant' THEN 4 END = best), '') AS related_ids
FROM p LEFT JOIN g ON g.a = p.id WHERE p.s > 25""")
def novelty_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The novelty of large parts against small ones."""
    return novelty.classify(*_sides(spark, sf_dir), fold=text.fold_ascii, separator=",")


def _page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    return p.select(F.col("page_id").alias("document_version_id"), host.alias("document_id"), F.md5("html").alias("content_hash"), F.row_number().over(Window.partitionBy(host).orderBy("page_id")).alias("version_no"))


_SQL_HOSTS = "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, md5(html) AS h FROM pages"


@query(f"SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id)::INT AS version_no FROM (SELECT page_id, host FROM ({_SQL_HOSTS}) QUALIFY row_number() OVER (PARTITION BY host, h ORDER BY page_id) = 1)")
def version_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one host as versions of a document; content seen before adds none."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    staged = table(spark, sf_dir, "pages").select("page_id", host.alias("document_id"), F.md5("html").alias("content_hash"))
    empty = spark.createDataFrame([], "document_id string, content_hash string, version_no int")
    return versions.new_versions(staged, empty, ["page_id"]).select("page_id", F.col("document_id").alias("host"), "version_no")


@query(f"""
SELECT page_id, CASE WHEN p IS NULL THEN 'Initial version' WHEN p = h THEN 'No content change' ELSE 'Content hash changed' END AS change_summary
FROM (SELECT page_id, h, lag(h) OVER (PARTITION BY host ORDER BY page_id) AS p FROM ({_SQL_HOSTS}))
""")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between neighbouring pages of a host."""
    return versions.change_summary(_page_items(spark, sf_dir)).select(F.col("document_version_id").alias("page_id"), "change_summary")


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def feed_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, the earliest row of equal times."""
    return readers.deduplicate(table(spark, sf_dir, "events").withColumn("place", F.col("event_id")), ("user_id",), F.col("ts"), "place").select("user_id", "event_id", "ts")


@query("""
WITH u AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1), a AS (SELECT DISTINCT user_id FROM events),
c AS (SELECT a.user_id, last, coalesce(last, TIMESTAMP '2024-02-25' - INTERVAL 14 DAY) AS asked, TIMESTAMP '2024-02-25' - INTERVAL 30 DAY AS floor FROM a LEFT JOIN u USING (user_id))
SELECT user_id, CASE WHEN asked < floor AND last IS NOT NULL THEN floor ELSE asked END AS window_start, asked < floor AND last IS NOT NULL AS truncated FROM c
""")
def collection_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next window of each user, from the last purchase to a fixed day."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last"))
    now = F.lit(datetime(2024, 2, 25)).cast("timestamp_ntz")
    w = timing.collection_window(F.col("last"), F.lit(None).cast("timestamp_ntz"), now)
    return e.select("user_id", w.alias("w")).select("user_id", "w.window_start", "w.truncated")


@query("""
SELECT d + CASE dayofweek(d) WHEN 2 THEN INTERVAL 510 MINUTE ELSE INTERVAL 1020 MINUTE END AS scheduled_for
FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE::TIMESTAMP, max(o_orderdate)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM orders)
WHERE dayofweek(d) IN (2, 5) AND scheduled_for < (SELECT max(o_orderdate)::DATE::TIMESTAMP FROM orders)
""")
def schedule_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of a weekly schedule over the span of the orders."""
    span = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").cast("timestamp").alias("start"), F.max("o_orderdate").cast("date").cast("timestamp").alias("end"))
    return timing.slots_between(span, "start", "end", ["TUE 08:30", "FRI 17:00"]).select(F.col("scheduled_for").cast("timestamp_ntz").alias("scheduled_for"))


@query("""
SELECT c_mktsegment, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS success, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed, count(*) FILTER (WHERE o_orderstatus = 'P') AS not_executed
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each segment by status class."""
    kind = F.create_map(*[F.lit(x) for pair in (("F", "success"), ("O", "failed"), ("P", "not_executed")) for x in pair])
    o = table(spark, sf_dir, "orders").select("o_custkey", F.element_at(kind, F.col("o_orderstatus")).alias("status"))
    rows = o.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return briefing.source_summary(rows, ["c_mktsegment"])


@query("""
SELECT date_trunc('month', o_orderdate)::DATE AS order_month, o_orderkey, o_orderstatus AS status,
       row_number() OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_orderstatus, o_totalprice DESC NULLS LAST, o_orderkey)::INT AS rank
FROM orders QUALIFY rank <= 7
""")
def top_items_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per month the first seven: finished as approved, open as pending, partial as carried."""
    segment = F.create_map(*[F.lit(x) for pair in (("F", "approved"), ("O", "pending"), ("P", "carried")) for x in pair])
    o = table(spark, sf_dir, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("order_month"), F.col("o_orderkey").alias("candidate_id"), F.col("o_orderstatus").alias("status"), F.element_at(segment, F.col("o_orderstatus")).alias("segment"), F.col("o_totalprice").alias("value_score"), F.lit(None).cast("timestamp").alias("created_at"))
    return briefing.ranked(o, ["order_month"]).select("order_month", F.col("candidate_id").alias("o_orderkey"), "status", "rank")


@query("""
SELECT from_state, to_state, count(*) AS n FROM (SELECT lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS from_state, role AS to_state FROM conversations)
WHERE from_state IS NOT NULL AND from_state || '>' || to_state NOT IN ('user>assistant', 'system>user') GROUP BY ALL
""")
def state_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that follow another in a way the edges do not allow."""
    edges = {"system": ("user",), "user": ("assistant",), "assistant": ()}
    bad = states.violations(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role", edges)
    return bad.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*/9$\nDisallow: /fr/8\nAllow: /fr/82\nDisallow: /de\n"


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages),
r(allow, pattern, regex) AS (VALUES (false, '/en/', '^/en/'), (true, '/en/1', '^/en/1'), (false, '/*/9$', '^/.*/9$'), (false, '/fr/8', '^/fr/8'), (true, '/fr/82', '^/fr/82'), (false, '/de', '^/de')),
b AS (SELECT page_id, allow, pattern FROM p JOIN r ON regexp_matches(path, regex) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, allow DESC, pattern DESC) = 1)
SELECT page_id, CASE WHEN coalesce(allow, true) THEN 'true' ELSE 'false' END AS robots_allowed, pattern AS robots_rule FROM p LEFT JOIN b USING (page_id)
""")
def robots_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against one rule file: the longest pattern wins, an allow on a tie."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("*").alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
    rules = robots.rule_table(spark.createDataFrame([("*", ROBOTS)], "host string, body string"))
    return robots.decide(pages, rules).select("page_id", "robots_allowed", "robots_rule")


@query("""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
  regexp_replace('/' || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages),
n AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_'))), '&') AS q2 FROM p)
SELECT page_id, scheme || '://' || host || path || CASE WHEN q2 <> '' THEN '?' || q2 ELSE '' END AS url FROM n
""")
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URLs of all pages."""
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url("url").alias("url"))


_UNESCAPED = "replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"')"


@query(f"""
SELECT page_id, trim(regexp_replace(replace({_UNESCAPED.format("regexp_extract(html, '<title>(.*?)</title>', 1)")}, '&amp;', '&'), '\\s+', ' ', 'g')) AS title,
       {_UNESCAPED.format("regexp_replace(regexp_replace(html, '<script>.*?</script>', '', 'gs'), '<!DOCTYPE html>|<!--.*?-->', '', 'gs')")} AS body
FROM pages
""")
def sanitize_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages made inert, with their titles; the SQL knows the markup that these pages hold."""
    return table(spark, sf_dir, "pages").select("page_id", html.html_title("html").alias("title"), html.sanitize_html("html").alias("body"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b(?:the|of) [a-z]+ing\\b')) AS phrase FROM documents")
def phrase_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banned phrases of all documents, with a pattern that the invented prose holds."""
    found = lint.phrases(F.col("text"), {"test": (r"\b(?:the|of) [a-z]+ing\b",)})
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(found)).select("doc_id", "phrase")


@query("SELECT doc_id, md5(regexp_replace(text, '(?i)\\b(token|secret|key)(\\s*[:=]\\s*)([^\\s,;]+)', '\\1\\2[REDACTED]', 'g')) AS masked FROM documents")
def mask_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with values of secret names redacted."""
    masked = text.mask_secrets("text", r"(?i)\b(token|secret|key)(\s*[:=]\s*)([^\s,;]+)")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(masked).alias("masked"))


@query("SELECT l_orderkey, l_linenumber, least(60.0, 2.0 ** (l_linenumber - 1))::DOUBLE AS backoff_seconds FROM lineitem")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits after failure number l_linenumber."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", RetryPolicy().backoff(F.col("l_linenumber")).alias("backoff_seconds"))


@query("SELECT o_orderkey, 'b' || o_orderkey || ':' || lower(o_orderstatus) || ':' || sha256(o_orderkey::VARCHAR) AS idempotency_key FROM orders")
def idempotency_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery keys of orders."""
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.idempotency_key(F.concat(F.lit("b"), key), F.lower("o_orderstatus"), F.sha2(key, 256)).alias("idempotency_key"))


@query("SELECT o_orderkey, 'briefing-' || sha256('scheduled:' || strftime(o_orderdate::DATE::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') || '+00:00') AS briefing_id FROM orders")
def trigger_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report ids of order dates."""
    return table(spark, sf_dir, "orders").select("o_orderkey", text.trigger_id(F.lit("scheduled"), F.col("o_orderdate").cast("date").cast("timestamp")).alias("briefing_id"))


@query(r"SELECT conv_id, count(*) AS calls, sum(greatest(1, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')))) ::BIGINT AS tokens FROM conversations GROUP BY 1")
def llm_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of the turns of each conversation."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("calls"), F.sum(text.estimated_tokens("text")).cast("long").alias("tokens"))


@query("""
SELECT page_id, CASE WHEN regexp_extract(url, '^([a-z]+)://', 1) NOT IN ('http', 'https', 'fixture') THEN 'unsupported_scheme'
  WHEN NOT (h LIKE '%.example.com' AND s = 'https') THEN 'host_not_allowed' END AS url_error
FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS h, regexp_extract(url, '^([a-z]+)://', 1) AS s FROM pages)
""")
def url_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose host is in the allowlist, over https."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(guards.url_parts(F.col("url"))["host"].alias("host")).distinct().where(F.col("host").like("%.example.com"))
    rules = hosts.select("host", F.lit("https").alias("scheme"), F.lit(None).cast("int").alias("port"))
    return guards.check_urls(pages, rules).select("page_id", "url_error")


@query("""
SELECT conv_id, turn, concat_ws(',', CASE WHEN trim(text) = '' THEN 'quote_length' END, CASE WHEN length(trim(text)) > 300 THEN 'quote_length' END,
  CASE WHEN role = 'system' THEN 'unsafe_source_link' END) AS violations FROM conversations
""")
def publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as items, each its own quote; system turns have no safe link."""
    c = table(spark, sf_dir, "conversations")
    items = c.select("conv_id", "turn", F.lit("claim").alias("claim"), F.lit("explicit").alias("status"), F.array("text").alias("quotes"), F.array(F.col("conv_id").cast("string")).alias("version_ids"), F.when(F.col("role") == "system", "javascript:x").otherwise("https://example.com/a").alias("source_link"))
    judged = gate.item_violations(items)
    return judged.select("conv_id", "turn", F.array_join("violations", ",").alias("violations"))


@query("""
SELECT user_id, event_type, max(n) + 1 AS attempt_no FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) GROUP BY ALL
""")
def delivery_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next attempt of each (user, type), its events being the history."""
    e = table(spark, sf_dir, "events")
    pairs = e.groupBy("user_id", "event_type").agg(F.count("*").alias("attempt_no"))
    messages = pairs.select(F.col("user_id").cast("string").alias("briefing_id"), F.col("event_type").alias("channel"), F.lit("x").alias("markdown"), F.lit("again").alias("resend_reason"), F.lit("me").alias("resend_approved_by"), "user_id", "event_type")
    key = text.idempotency_key(F.col("user_id").cast("string"), F.col("event_type"), F.sha2(F.lit("x"), 256))
    history = pairs.select(key.alias("idempotency_key"), "attempt_no")
    return delivery.plan(messages, history).select("user_id", "event_type", F.col("attempt_no").cast("long").alias("attempt_no"))


# the modules below add their own queries
from quillspark import function_queries, report_queries, source_queries  # noqa: E402, F401

__all__ = ["ORACLES", "QUERIES"]
