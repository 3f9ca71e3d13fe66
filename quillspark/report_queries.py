"""Queries of versions, evidence, candidates, review, reports, delivery and operation, over whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text, timing
from quillspark.operators import archive, briefing, delivery, evidence, gate, lint, metrics, records, relevance, review, routing, scoring, states, validation, versions
from quillspark.register import query, table
from quillspark.streaming import ingest


def _pick(key: Column, *values) -> Column:
    """The value whose place is ``key`` modulo their number."""
    out = F.lit(None)
    for i, v in enumerate(values):
        out = F.when(key % len(values) == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def _strings(*values: Column | str) -> Column:
    return F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in values])


def _at(*parts: int) -> Column:
    return F.lit(datetime(*parts)).cast("timestamp_ntz")


_PAGE = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"


@query(f"""
WITH s AS (SELECT page_id, {_PAGE} || '/' AS u, page_id % 7 = 0 AS denied, html FROM pages),
h AS (SELECT page_id, u, CASE WHEN denied THEN 'sha256:' || sha256('access-denied:host:' || u) ELSE 'sha256:' || sha256(html) END AS hash, CASE WHEN NOT denied THEN 'T' || page_id END AS title FROM s),
l AS (SELECT u, arg_max_null(hash, page_id) AS hash, arg_max_null(title, page_id) AS title, max(page_id) AS last, bool_or(page_id % 2 = 0) AS known, min(page_id) FILTER (WHERE page_id % 2 = 0) AS first FROM h GROUP BY u)
SELECT u AS canonical_url, hash AS content_hash, coalesce(title, CASE WHEN known THEN 'old' END) AS title, last AS checked, CASE WHEN known THEN -1 ELSE last END AS first_collected FROM l
""")
def document_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as observations of their host's document, some denied, over a table that knows the hosts of even pages."""
    at = F.timestamp_seconds(F.col("page_id"))
    host = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1), F.lit("/"))
    items = table(spark, sf_dir, "pages").select(F.lit("host").alias("source_id"), host.alias("url"), F.col("html").alias("normalized_body"), F.when(F.col("page_id") % 7 == 0, "false").otherwise("true").alias("robots_allowed"), F.when(F.col("page_id") % 7 != 0, F.concat(F.lit("T"), F.col("page_id").cast("string"))).alias("title"), at.alias("retrieved_at"), F.lit(0).alias("position"), F.col("page_id"))
    staged = versions.stage(items)
    known = staged.where("page_id % 2 = 0").select("document_id", "source_id", "canonical_url").distinct()
    old = known.select("*", F.lit("x").alias("content_hash"), F.lit("old").alias("title"), F.timestamp_seconds(F.lit(-1)).alias("first_collected_at"), F.timestamp_seconds(F.lit(-1)).alias("last_checked_at"))
    out = versions.upsert_documents(old, staged)
    return out.select("canonical_url", "content_hash", "title", F.unix_seconds("last_checked_at").alias("checked"), F.unix_seconds("first_collected_at").alias("first_collected"))


@query("SELECT event_id, ts >= TIMESTAMP '2024-01-16' AS kept, a AND (b OR event_id % 3 = 2) AS same FROM (SELECT *, event_id % 2 = 0 AS a, event_id % 3 = 0 AS b FROM events) WHERE ts >= TIMESTAMP '2024-01-16'")
def retained_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions: those that a retention of 15 days keeps, and whether their content is that of another."""
    e = table(spark, sf_dir, "events").withColumn("retrieved_at", F.col("ts"))
    body = F.when(F.col("event_id") % 3 == 0, "a").when(F.col("event_id") % 3 == 1, "b")
    same = versions.same_content((F.col("event_id") % 2).cast("string"), F.lit("0"), body, F.lit("a"))
    kept = versions.retained(e, _at(2024, 1, 31), 15)
    return kept.select("event_id", F.lit(True).alias("kept"), same.alias("same"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    quote = F.when(F.col("turn") == 3, F.concat(F.col("text"), F.lit("?"))).otherwise(F.concat(F.lit(" "), F.col("text")))
    return c.select(F.col("conv_id").alias("candidate_id"), F.col("role").alias("field_name"), F.col("turn").alias("request_id"), quote.alias("quote"), F.when(F.col("turn") == 5, "none").otherwise(F.col("conv_id").cast("string")).alias("document_version_id"))


@query("""
WITH r AS (SELECT conv_id, role, turn, CASE WHEN turn = 3 THEN text || '?' ELSE text END AS q, turn = 5 AS lost FROM conversations),
b AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS body FROM conversations GROUP BY 1),
p AS (SELECT trim(CASE WHEN turn = 3 THEN text || '?' ELSE text END) AS quote, role, conv_id, turn FROM conversations WHERE turn % 4 <> 2),
m AS (SELECT r.*, (SELECT min(p.conv_id * 100 + p.turn) FROM p WHERE p.quote = trim(r.q) AND p.role = r.role AND (p.turn = 0 OR (CASE WHEN r.lost THEN 'none' ELSE r.conv_id::VARCHAR END) = p.conv_id::VARCHAR)) AS prov,
             length(trim(r.q)) BETWEEN 1 AND 300 AS fits FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, fits ORDER BY turn) AS place FROM m)
SELECT k.conv_id AS candidate_id, role AS field_name, turn AS request_id, prov AS provenance_id,
       CASE WHEN lost THEN 'unknown_version' WHEN prov IS NULL THEN 'no_provenance' WHEN NOT coalesce(fits AND place <= 2, false) THEN 'quote_limits' WHEN NOT contains(body, trim(q)) THEN 'quote_not_in_source' END AS evidence_error
FROM k JOIN b USING (conv_id)
""")
def linked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as quotes of their conversation: matched to provenance of the version, bounded, and looked for in its text."""
    c = table(spark, sf_dir, "conversations")
    quote = F.when(F.col("turn") == 3, F.concat(F.col("text"), F.lit("?"))).otherwise(F.col("text"))
    proof = c.select(F.col("role").alias("field_name"), quote.alias("quote"), F.when(F.col("turn") != 0, F.col("conv_id").cast("string")).alias("document_version_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("provenance_id"), F.when(F.col("turn") % 4 == 2, "rejected").otherwise(" Verified ").alias("status"))
    bodies = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).select(F.col("conv_id").cast("string").alias("document_version_id"), F.array_join(F.transform("t", lambda t: t["text"]), "\n").alias("body"))
    return evidence.link(_requests(spark, sf_dir), proof, bodies).select("candidate_id", "field_name", "request_id", "provenance_id", "evidence_error")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates with core fields, statuses and bounds, some of them broken."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("candidate_id"),
        F.when(k % 11 != 0, F.col("p_name")).alias("canonical_name"),
        F.col("p_name").alias("core_hypothesis"),
        _pick(k, "explicit", "inferred", "unknown", "conflicting", "guess").alias("core_hypothesis_status"),
        F.when(k % 4 != 0, F.col("p_type")).alias("entry_logic"),
        F.when(k % 3 == 0, "unknown").otherwise("explicit").alias("entry_logic_status"),
        F.col("p_brand").alias("exit_logic"),
        F.lit("explicit").alias("exit_logic_status"),
        F.create_map(F.lit("exit_logic"), _pick(k, "explicit", " Conflicting ")).alias("field_status"),
        (F.col("p_size") / 45).alias("extraction_confidence"),
        F.lit("pending").alias("review_status"),
    )


def _proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of candidates: two fields each, a ninth of the rows in error, none for every thirteenth."""
    p = table(spark, sf_dir, "part").where("p_partkey % 13 <> 0")
    rows = p.select(F.col("p_partkey").alias("candidate_id"), F.explode(F.array(F.lit("core_hypothesis"), F.lit("exit_logic"))).alias("field_name"), F.col("p_name").alias("quote"))
    return rows.withColumn("evidence_error", F.when((F.col("candidate_id") % 9 == 0) & (F.col("field_name") == "exit_logic"), "quote_limits"))


_SQL_CANDIDATES = """
WITH c AS (SELECT p_partkey AS id, p_partkey % 11 <> 0 AS named, p_partkey % 5 AS s, p_partkey % 4 <> 0 AS entry, p_partkey % 3 = 0 AS entry_unknown, p_size / 45.0 AS conf, p_partkey % 13 <> 0 AS proof, p_partkey % 13 <> 0 AND p_partkey % 9 = 0 AS bad, p_partkey % 2 AS f FROM part),
e AS (SELECT *, list_filter([CASE WHEN NOT named THEN 'canonical_name: required' END, CASE WHEN s = 4 THEN 'core_hypothesis_status: not a status' END, CASE WHEN NOT entry AND NOT entry_unknown THEN 'entry_logic: empty but not unknown' END, CASE WHEN conf > 1 THEN 'extraction_confidence: not in 0..1' END], lambda x: x IS NOT NULL) AS errors FROM c)
"""


@query(_SQL_CANDIDATES + """
SELECT id AS candidate_id, array_to_string(errors, ';') AS errors, CASE WHEN len(errors) > 0 THEN 'schema_invalid' WHEN bad THEN 'evidence_invalid' WHEN NOT proof THEN 'evidence_missing' END AS error_class,
       CASE WHEN len(errors) = 0 AND NOT bad AND proof THEN 'validated' ELSE 'failed' END AS state,
       concat_ws(',', CASE WHEN proof AND s IN (0, 1) THEN 'core_hypothesis' END, CASE WHEN proof AND NOT bad AND f = 0 THEN 'exit_logic' END) AS publishable
FROM e
""")
def validated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates against their contract and their evidence, and what of them may be published."""
    c = _candidates(spark, sf_dir).withColumn("field_status", F.map_from_arrays(F.array(F.lit("exit_logic")), F.array(_pick(F.col("candidate_id"), "explicit", "conflicting"))))
    out = validation.validate(c, _proof(spark, sf_dir))
    return out.select("candidate_id", F.array_join("contract_errors", ";").alias("errors"), "error_class", "state", F.array_join("publishable_fields", ",").alias("publishable"))


@query(_SQL_CANDIDATES + """
SELECT id AS candidate_id, proof AS core_kept, CASE WHEN proof OR s = 3 THEN ['explicit', 'inferred', 'unknown', 'conflicting', 'guess'][s + 1] ELSE 'unknown' END AS core_status, false AS entry_kept, 'unknown' AS entry_status, proof AND NOT bad AS exit_kept,
       CASE WHEN s = 3 THEN 'needs_review' ELSE 'pending' END AS review_status FROM e
""")
def supported_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without the fields that no accepted quote supports."""
    out = validation.keep_supported(_candidates(spark, sf_dir), _proof(spark, sf_dir))
    kept = lambda c: F.col(c).isNotNull()
    return out.select("candidate_id", kept("core_hypothesis").alias("core_kept"), F.col("core_hypothesis_status").alias("core_status"), kept("entry_logic").alias("entry_kept"), F.col("entry_logic_status").alias("entry_status"), kept("exit_logic").alias("exit_kept"), "review_status")


@query(_SQL_CANDIDATES + """, n AS (SELECT id, proof, bad, p_name AS name, p_brand AS brand, CASE WHEN entry THEN p_type END AS kind FROM e JOIN part ON p_partkey = id)
SELECT id AS candidate_id, 'core_hypothesis' AS field_name, name AS claim, CASE WHEN proof THEN name ELSE '' END AS quotes FROM n UNION ALL SELECT id, 'entry_logic', kind, '' FROM n UNION ALL
SELECT id, 'exit_logic', brand, CASE WHEN proof AND NOT bad THEN name ELSE '' END FROM n UNION ALL SELECT id, unnest(['signal_inputs', 'required_data', 'risk_notes']), NULL, '' FROM n
""")
def candidate_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every core field of every candidate with its quotes."""
    return validation.candidate_view(_candidates(spark, sf_dir), _proof(spark, sf_dir)).select("candidate_id", "field_name", "claim", F.array_join("quotes", "|").alias("quotes"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS canonical_name, CASE WHEN p_partkey % 3 = 0 THEN p_size / 10.0 END AS extraction_confidence, CASE WHEN p_partkey % 3 = 2 THEN 'schema_invalid' END AS error_class FROM part
""")
def candidate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as candidates: fenced, partial, and none at all."""
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    answer = F.when(k == 0, _strings('```json\n{"canonical_name":"', name, '","extraction_confidence":', F.col("p_size") / 10, "}\n```")).when(k == 1, _strings('{"canonical_name":"', name, '"}')).otherwise(_strings("no answer for ", name))
    rows = table(spark, sf_dir, "part").select("p_partkey", answer.alias("answer"))
    return validation.candidate_rows(rows, "canonical_name string, extraction_confidence double").select("p_partkey", "canonical_name", "extraction_confidence", "error_class")


@query(_SQL_CANDIDATES + """, r AS (SELECT id, concat_ws(',', CASE WHEN s = 3 THEN 'core_hypothesis' END, CASE WHEN f = 1 THEN 'exit_logic' END) AS conflicts, conf, CASE WHEN id % 10 = 0 THEN NULL ELSE id % 100 END AS v FROM e)
SELECT id AS candidate_id, conflicts, concat_ws(',', CASE WHEN v IS NULL THEN 'missing_value_score' WHEN v BETWEEN 50 AND 70 THEN 'borderline_score' END, CASE WHEN conf < 0.7 THEN 'low_extraction_confidence' END, CASE WHEN conflicts <> '' THEN 'conflicting_core_field' END, CASE WHEN v > 70 THEN 'high_score' END) AS reasons FROM r
""")
def conflict_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with conflicting fields, missing scores and high ones, routed with the shipped bounds."""
    c = _candidates(spark, sf_dir).withColumn("value_score", F.when(F.col("candidate_id") % 10 != 0, F.col("candidate_id") % 100))
    out = routing.route(c, review_high=True).withColumn("conflicts", routing.conflicting_fields(c))
    return out.select("candidate_id", F.array_join("conflicts", ",").alias("conflicts"), F.array_join("route_reasons", ",").alias("reasons"))


def _list(terms) -> str:
    return "list_filter([" + ", ".join(f"'{t}'" for t in sorted(terms)) + "], lambda t: contains(x, t))"


_TERMS = relevance.Terms()


@query(f"""
WITH d AS (SELECT doc_id, lower('Title ' || coalesce(lang, '') || ' ' || text || CASE doc_id % 6 WHEN 0 THEN ' An order book signal.' WHEN 1 THEN ' Scalping for seconds' WHEN 2 THEN ' dividend' WHEN 3 THEN ' price formation' WHEN 4 THEN ' momentum and dividend' ELSE '' END) AS x, doc_id % 3 <> 0 AS open FROM documents),
t AS (SELECT doc_id, x, {_list(_TERMS.microstructure)} AS m, {_list(_TERMS.strategy)} AS s, {_list(_TERMS.background)} AS b, {_list(_TERMS.irrelevant)} AS i FROM d WHERE open),
r AS (SELECT *, CASE WHEN len(i) > 0 AND len(s) = 0 THEN 'irrelevant' WHEN len(s) > 0 AND (len(m) > 0 OR contains(x, 'minutes') OR contains(x, 'seconds')) THEN 'relevant' WHEN len(m) > 0 OR len(b) > 0 THEN 'background_only' ELSE 'irrelevant' END AS relevance FROM t)
SELECT doc_id, array_to_string(m, ',') AS microstructure, array_to_string(s, ',') AS strategy, relevance, CASE WHEN relevance = 'relevant' THEN 'extracted' ELSE relevance END AS next_state, least(3, len(m))::INT AS snippets FROM r
""")
def explained_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that may still be classified, by the shipped terms, with snippets and the state that follows."""
    more = _pick(F.col("doc_id"), " An order book signal.", " Scalping for seconds", " dividend", " price formation", " momentum and dividend", "")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Title "), F.coalesce("lang", F.lit(""))).alias("title"), F.concat("text", more).alias("text"), _pick(F.col("doc_id"), "rejected", F.lit(None).cast("string"), "normalized").alias("state"))
    out = relevance.classify(relevance.classifiable(d), title="title")
    return out.select("doc_id", F.array_join("microstructure_terms", ",").alias("microstructure"), F.array_join("strategy_terms", ",").alias("strategy"), "relevance", relevance.next_state(F.col("relevance")).alias("next_state"), F.size("microstructure_snippets").alias("snippets"))


_STATES = "CASE o_orderkey % 5 WHEN 0 THEN 'discovered' WHEN 1 THEN 'deduplicated' WHEN 2 THEN 'validated' WHEN 3 THEN 'needs_review' ELSE 'approved' END"
_GOALS = "CASE o_orderkey % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'classified' ELSE 'collected' END"


@query(f"""
SELECT o_orderkey, CASE WHEN ok THEN t ELSE s END AS state, CASE WHEN t IS NOT NULL AND NOT ok THEN s || ' -> ' || t END AS error, CASE WHEN ok THEN t ELSE s END IN ('approved', 'rejected') AS terminal
FROM (SELECT *, t IS NOT NULL AND s || '>' || t IN ('discovered>collected', 'deduplicated>classified', 'validated>rejected', 'needs_review>rejected') AS ok FROM (SELECT o_orderkey, {_STATES} AS s, CASE WHEN o_orderkey % 7 <> 0 THEN {_GOALS} END AS t FROM orders))
""")
def state_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of the state machine: allowed steps are taken, others named."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _pick(k, "discovered", "deduplicated", "validated", "needs_review", "approved").alias("state"))
    asked = rows.where(k % 7 != 0).select("o_orderkey", _pick(k, "rejected", "classified", "collected").alias("target"))
    out = states.advance(rows, asked, "o_orderkey")
    return out.select("o_orderkey", "state", F.col("transition_error").alias("error"), states.is_terminal(F.col("state")).alias("terminal"))


@query("""
WITH c AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'needs_review' WHEN 'O' THEN 'validated' ELSE 'approved' END AS s, CASE o_orderkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'needs_review' END AS d FROM orders),
k AS (SELECT *, d IS NOT NULL AND s || '>' || d IN ('needs_review>approved', 'needs_review>rejected', 'validated>needs_review', 'validated>rejected') AS ok FROM c)
SELECT id AS candidate_id, CASE WHEN ok THEN d ELSE s END AS review_status, ok AS recorded, row_number() OVER (PARTITION BY CASE WHEN ok THEN d ELSE s END ORDER BY id)::INT AS place FROM k
""")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on orders as candidates: what is allowed takes effect and is recorded; lists of a status keep an order."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "needs_review").when(F.col("o_orderstatus") == "O", "validated").otherwise("approved")
    c = o.select(F.col("o_orderkey").alias("candidate_id"), status.alias("review_status"), F.lit(0).alias("created_at"))
    d = o.where("o_orderkey % 4 < 3").select(F.col("o_orderkey").alias("candidate_id"), F.lit("me").alias("reviewer_id"), _pick(F.col("o_orderkey") % 4, "approved", "rejected", "needs_review").alias("decision"), F.lit("").alias("comment"), F.lit(0).alias("reviewed_at"))
    after, recorded = review.decide(c, d)
    listed = None
    for s in ("needs_review", "validated", "approved", "rejected"):
        one = review.list_candidates(after, s)
        ranked = scoring.best_of(one, ["review_status"], [F.col("created_at"), F.col("candidate_id")], 1 << 30)
        listed = ranked if listed is None else listed.unionByName(ranked)
    marks = recorded.select("candidate_id", F.lit(True).alias("recorded"))
    return listed.join(marks, "candidate_id", "left").select("candidate_id", "review_status", F.coalesce("recorded", F.lit(False)).alias("recorded"), F.col("rank").alias("place"))


@query("""
SELECT c_custkey::VARCHAR AS briefing_id, CASE WHEN c_nationkey % 3 < 2 AND c_custkey % 3 = 0 THEN 'approved' ELSE ['draft', 'pending_approval', 'archived'][c_nationkey % 3 + 1] END AS status, c_custkey % 3 = 0 AND c_nationkey % 3 = 2 AS refused, CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 1 END AS attempt
FROM customer
""")
def report_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on customers as reports, of which every second was made three times before."""
    c = table(spark, sf_dir, "customer")
    new = c.select(F.col("c_custkey").cast("string").alias("briefing_id"), F.lit(0).alias("run_attempt"), F.lit("x").alias("publication_status"))
    stored = new.where("CAST(briefing_id AS BIGINT) % 2 = 0").withColumn("run_attempt", F.lit(3))
    rows = records.upsert_briefings(stored, new)
    asked = c.select(F.col("c_custkey").cast("string").alias("briefing_id"), _pick(F.col("c_nationkey"), "draft", "pending_approval", "archived").alias("now"))
    open_ = rows.join(asked, "briefing_id").withColumn("publication_status", F.when(F.col("now") == "pending_approval", F.col("publication_status")).otherwise(F.col("now"))).drop("now")
    done = review.decide_briefings(open_, c.where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("briefing_id"), F.lit("approved").alias("decision")))
    return review.list_briefings(done.withColumn("scheduled_for", F.lit(0))).select("briefing_id", F.col("publication_status").alias("status"), F.col("transition_error").isNotNull().alias("refused"), F.col("run_attempt").alias("attempt"))


@query("""
SELECT user_id, event_type, CASE WHEN n > 0 AND user_id % 3 = 0 THEN 'resend_approval_required' END AS delivery_error, CASE WHEN NOT (n > 0 AND user_id % 3 = 0) THEN n + 1 END AS attempt_no, CASE WHEN NOT (n > 0 AND user_id % 3 = 0) THEN 'Report ' || user_id || ' MY_KEY=[REDACTED]' END AS message
FROM (SELECT user_id, event_type, count(*) FILTER (WHERE event_type <> 'view') AS n FROM events GROUP BY 1, 2)
""")
def delivery_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages to (user, type), every event but a view an earlier attempt: keys, attempts, approvals and masked texts."""
    e = table(spark, sf_dir, "events")
    markdown = _strings("Report ", F.col("user_id"), " MY_KEY=abc")
    reason = F.when(F.col("user_id") % 3 != 0, "again")
    messages = e.select("user_id", "event_type").distinct().select(F.col("user_id").cast("string").alias("briefing_id"), F.col("event_type").alias("channel"), markdown.alias("markdown"), reason.alias("resend_reason"), F.lit("me").alias("resend_approved_by"), "user_id", "event_type")
    key = text.idempotency_key(F.col("user_id").cast("string"), F.col("event_type"), F.sha2(markdown, 256))
    history = e.where("event_type <> 'view'").select(key.alias("idempotency_key"), F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")).alias("attempt_no"))
    planned = delivery.plan(messages, history)
    sent = delivery.dry_run(planned, F.current_timestamp()).select("briefing_id", "channel", F.array_join("chunks", "").alias("message"))
    return planned.join(sent, ["briefing_id", "channel"], "left").select("user_id", "event_type", "delivery_error", F.col("attempt_no").cast("long").alias("attempt_no"), "message")


@query("""
WITH i AS (SELECT l_orderkey AS o, bool_and(l_returnflag <> 'R' OR l_linenumber < 6) AS sources, bool_and(l_tax < 0.08) AS approved, bool_or(l_linenumber = 7 AND l_quantity < 5) AS sensitive FROM lineitem GROUP BY 1),
t AS (SELECT DISTINCT l_orderkey AS o FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY l_orderkey, l_partkey HAVING count(*) > 1),
b AS (SELECT o_orderkey AS o, o_orderstatus AS s, o_orderkey % 13 = 0 AS undated, o_orderkey % 5 = 0 AS draft, o_orderkey % 6 = 0 AS sent, o_orderkey % 4 = 0 AS again FROM orders)
SELECT o AS briefing_id, CASE WHEN NOT coalesce(sources, true) THEN 'source_not_allowed' WHEN undated THEN 'invalid_data_window' WHEN coalesce(sensitive, false) THEN 'sensitive_information' WHEN t.o IS NOT NULL THEN 'unrelated_duplicates'
  WHEN NOT ((s = 'F' AND coalesce(approved, true)) OR draft) THEN 'not_approved' WHEN sent AND NOT again THEN 'already_delivered' END AS gate_error
FROM b LEFT JOIN i USING (o) LEFT JOIN t USING (o)
""")
def report_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports and lines as their items, against the rules in front of delivery."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    reports = o.select(k.alias("briefing_id"), F.when(k % 13 != 0, F.lit(0)).alias("window_start"), F.lit(1).alias("window_end"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("draft").alias("approval"), (k % 5 == 0).alias("internal_draft"), F.lit("h").alias("content_hash"), F.when(k % 4 == 0, "again").alias("resend_reason"), F.lit("me").alias("resend_approved_by"))
    line = table(spark, sf_dir, "lineitem")
    name = F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") < 5), "Api-Key").otherwise("note")
    items = line.select(F.col("l_orderkey").alias("briefing_id"), F.col("l_linenumber").alias("item_id"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")).alias("identity"), F.lit(False).alias("related"), F.when(F.col("l_tax") < 0.08, "published").otherwise("draft").alias("approval"), ((F.col("l_returnflag") != "R") | (F.col("l_linenumber") < 6)).alias("source_allowed"), F.map_from_arrays(F.array(name), F.array(F.lit("x"))).alias("metadata"))
    sent = o.where(k % 6 == 0).select(k.alias("briefing_id"), F.lit("h").alias("content_hash"), F.lit("sent").alias("status"))
    return gate.gate_briefings(reports, items, sent).select("briefing_id", "gate_error")


@query("""
SELECT conv_id, count(*) AS items, count(*) FILTER (WHERE role <> 'system' AND length(trim(text)) > 300) AS blocked, count(*) FILTER (WHERE role <> 'system' AND length(trim(text)) > 300) = 0 AS publishable FROM conversations GROUP BY 1
""")
def publishable_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as reports; turns of the system assert nothing and need no evidence."""
    c = table(spark, sf_dir, "conversations")
    none = F.array().cast("array<string>")
    system = F.col("role") == "system"
    items = c.select("conv_id", F.when(system, " ").otherwise("claim").alias("claim"), F.when(system, "unknown").otherwise("explicit").alias("status"), F.when(system, none).otherwise(F.array("text")).alias("quotes"), F.array(F.lit("v")).alias("version_ids"), F.when(~system, "https://example.com/a").alias("source_link"))
    return gate.publishable(gate.item_violations(items), ["conv_id"])


_PHRASES = "CASE {} % 4 WHEN 0 THEN ' Buy  SIGNAL' WHEN 1 THEN ' guaranteed returns' WHEN 2 THEN ' stock advice' ELSE ' no phrase' END"


@query(f"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'trading_signal' WHEN 1 THEN 'return_guarantee' ELSE 'investment_recommendation' END AS category, trim({_PHRASES.format('doc_id')}) AS phrase,
       (length(text) + 1)::INT AS start, (length(text) + length({_PHRASES.format('doc_id')}))::INT AS stop FROM documents WHERE doc_id % 4 < 3
""")
def banned_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with something added, against the shipped phrases, with the place of each match."""
    more = _pick(F.col("doc_id"), " Buy  SIGNAL", " guaranteed returns", " stock advice", " no phrase")
    found = lint.find(table(spark, sf_dir, "documents").select("doc_id", F.concat("text", more).alias("text")), "doc_id", "text")
    return found.select("doc_id", "category", "phrase", "start", F.col("end").alias("stop"))


_WINDOWS = "SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29', INTERVAL 7 DAY)) AS w"


def _weeks(spark: SparkSession) -> DataFrame:
    return timing.observation_windows(spark, datetime(2024, 1, 1), datetime(2024, 2, 5))


@query(f"""
WITH w AS ({_WINDOWS}), e AS (SELECT event_id, user_id, ts, event_type = 'error' AS failed, event_id % 97 AS delay FROM events),
r AS (SELECT w, user_id, delay, row_number() OVER (PARTITION BY w, user_id ORDER BY event_id % 5 DESC, event_id) AS n FROM w JOIN e ON ts >= w AND ts < w + INTERVAL 7 DAY WHERE NOT failed),
a AS (SELECT w, max(delay)::DOUBLE AS v, count(*) AS n FROM r WHERE n = 1 GROUP BY w)
SELECT w.w AS start, 'M2' AS metric_id, v AS value, 30.0::DOUBLE AS target, coalesce(n, 0) AS sample_size, CASE WHEN n IS NULL THEN 'insufficient_data' WHEN v <= 30 THEN 'met' ELSE 'breached' END AS verdict FROM w LEFT JOIN a ON a.w = w.w
""")
def report_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: users as reports, events that are no errors as their attempts, over windows that hold their times."""
    weeks = _weeks(spark)
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    rows = metrics.in_windows(e, "ts", weeks).select("window_id", F.col("user_id").alias("briefing_id"), (F.col("event_id") % 5).alias("run_attempt"), F.col("event_id").alias("tie"), (F.col("event_id") % 97).alias("delay"))
    out = metrics.briefing_delay(rows, weeks).join(weeks, "window_id")
    return out.select("start", "metric_id", "value", "target", "sample_size", "verdict")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 and M6 of each week from events: every user a delivery, purchases claims of which those of even users have evidence."""
    weeks = _weeks(spark)
    e = metrics.in_windows(table(spark, sf_dir, "events"), "ts", weeks)
    sent = e.select("window_id", F.col("user_id").alias("briefing_id"), F.lit("x").alias("channel"), F.lit(1).alias("attempt_no"), F.col("ts").alias("attempted_at"), F.col("event_id").alias("delivery_id"), F.when(F.col("event_type") == "error", "failed").otherwise("sent").alias("status"))
    claims = e.where("event_type = 'purchase'").select("window_id", F.col("event_id").alias("item_id"), "user_id")
    return metrics.delivery_failure(sent, weeks).unionByName(metrics.evidence_gap(claims.select("window_id", "item_id"), claims.where("user_id % 2 = 0").select("item_id"), weeks))


_SQL_MEASURED = f"""
WITH w AS ({_WINDOWS}), e AS (SELECT w, event_id, user_id, ts, event_type FROM w JOIN events ON ts >= w AND ts < w + INTERVAL 7 DAY),
f AS (SELECT w, event_type FROM e QUALIFY row_number() OVER (PARTITION BY w, user_id ORDER BY ts DESC, event_id DESC) = 1),
m AS (SELECT w, 'M4' AS metric_id, count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*) AS value, count(*) AS n, 0.02::DOUBLE AS target FROM f GROUP BY w
      UNION ALL SELECT w, 'M6', count(*) FILTER (WHERE user_id % 2 = 1)::DOUBLE / count(*), count(*), 0.0::DOUBLE FROM e WHERE event_type = 'purchase' GROUP BY w),
v AS (SELECT *, CASE WHEN value <= target THEN 'met' ELSE 'breached' END AS verdict FROM m)
"""


@query(_SQL_MEASURED + """
, t(metric_id, title, target) AS (VALUES ('M1', 'Collection success rate', '0.95'), ('M2', 'Report delay in minutes', '30.0'), ('M3', 'Review backlog', '20.0'), ('M4', 'Delivery failure rate', '0.02'), ('M5', 'Duplicate rate', '0.0'), ('M6', 'Evidence gap rate', '0.0')),
a AS (SELECT w.w, t.metric_id, t.title, t.target, v.value, coalesce(v.verdict, 'insufficient_data') AS verdict FROM w CROSS JOIN t LEFT JOIN v ON v.w = w.w AND v.metric_id = t.metric_id)
SELECT w AS start, '| metric | title | value | target | verdict |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) ||
       string_agg('| ' || metric_id || ' | ' || title || ' | ' || coalesce(printf('%.4f', value), '-') || ' | ' || target || ' | ' || verdict || ' |', chr(10) ORDER BY metric_id) || chr(10) || chr(10) ||
       'breached: ' || coalesce(string_agg(metric_id, ', ' ORDER BY metric_id) FILTER (WHERE verdict = 'breached'), '') || chr(10) || 'insufficient data: ' || coalesce(string_agg(metric_id, ', ' ORDER BY metric_id) FILTER (WHERE verdict = 'insufficient_data'), '') AS markdown
FROM a GROUP BY w
""")
def metric_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operational report of each week: all six metrics as text, checked for banned phrases."""
    weeks = _weeks(spark)
    whole = metrics.complete_rows(_measured(spark, sf_dir), weeks)
    checked = archive.checked_reports(briefing.render_metrics(whole)).where("archive_error IS NULL")
    return checked.join(weeks, "window_id").select("start", "markdown")


@query(_SQL_MEASURED + """
, l AS (SELECT w FROM w ORDER BY w DESC LIMIT 4), ids AS (SELECT unnest(['M4', 'M5', 'M6']) AS metric_id)
SELECT l.w AS start, ids.metric_id, CASE WHEN v.verdict IS NULL THEN 'insufficient_data' ELSE v.verdict END AS reason FROM l CROSS JOIN ids LEFT JOIN v ON v.w = l.w AND v.metric_id = ids.metric_id WHERE coalesce(v.verdict, '') <> 'met'
""")
def expansion_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps the last four weeks from passing."""
    weeks = _weeks(spark)
    return records.expansion_blockers(_measured(spark, sf_dir), weeks, ["M4", "M5", "M6"]).join(weeks, "window_id").select("start", "metric_id", "reason")


@query("""
SELECT o AS option, CASE WHEN k = 0 THEN 'recommend' ELSE 'hold' END AS recommendation, k AS case_no FROM (SELECT unnest(['add_source', 'raise_frequency', 'widen_scope']) AS o), (SELECT unnest([0, 1]) AS k)
UNION ALL SELECT t, CASE WHEN k = 0 AND t = 'value_score' THEN 'change' ELSE 'keep' END, k FROM (SELECT unnest(['value_score', 'confidence']) AS t), (SELECT unnest([0, 1]) AS k)
""")
def expansion_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options and thresholds after a gate that passed and one that did not, with suppliers as inactive sources."""
    spare = table(spark, sf_dir, "supplier").select("s_suppkey")
    out = None
    for k, eligible in enumerate((True, False)):
        verdict = spark.range(1).select(F.lit(eligible).alias("eligible"))
        options = metrics.expansion_recommendations(verdict, spare).select("option", "recommendation")
        changes = metrics.recalibration(verdict, {"value_score": 60.0, "confidence": 0.7}, {"value_score": 55.0})
        both = options.unionByName(changes.select(F.col("threshold").alias("option"), F.when(F.col("recommended"), "change").otherwise("keep").alias("recommendation"))).withColumn("case_no", F.lit(k))
        out = both if out is None else out.unionByName(both)
    return out


@query("""
WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderdate AS d, o_totalprice AS v FROM orders),
b(b, a, z) AS (VALUES ('b1', TIMESTAMP '1995-01-01', TIMESTAMP '1995-07-01'), ('b2', TIMESTAMP '1996-01-01', TIMESTAMP '1996-07-01'), ('b3', TIMESTAMP '1997-01-01', TIMESTAMP '1997-07-01')),
x AS (SELECT b, id, CASE s WHEN 'F' THEN 0 ELSE 1 END AS seg, v, d FROM b JOIN o ON d BETWEEN a AND z),
p AS (SELECT id, d AS listed FROM o WHERE id % 50 = 0), c AS (SELECT DISTINCT b, id FROM b JOIN p ON listed < z),
y AS (SELECT * FROM x UNION ALL SELECT b, c.id, 2, v, d FROM c JOIN o USING (id) WHERE s <> 'F'),
f AS (SELECT * FROM y WHERE id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY b, id ORDER BY seg) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY seg, v DESC NULLS LAST, d NULLS FIRST, id)::INT AS rank FROM f)
SELECT r.b AS briefing_id, r.id AS candidate_id, ['approved', 'pending', 'carried'][seg + 1] AS segment, rank, c.id IS NOT NULL AND seg > 0 AS carried_over, 'q' || r.id || '|r' || r.id AS quotes
FROM r LEFT JOIN c ON c.b = r.b AND c.id = r.id WHERE rank <= 7
""")
def report_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of three reports over orders as candidates: windows, carry-over, evidence and the cut."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    slots = spark.createDataFrame([(f"b{n}", datetime(y, 1, 1), datetime(y, 7, 1)) for n, y in ((1, 1995), (2, 1996), (3, 1997))], "briefing_id string, window_start timestamp_ntz, window_end timestamp_ntz").withColumn("scheduled_for", F.col("window_end"))
    candidates = o.select(k.alias("candidate_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("needs_review").alias("review_status"), F.col("o_totalprice").alias("value_score"), F.col("o_orderdate").alias("created_at"))
    previous = o.where(k % 50 == 0).select(k.alias("candidate_id"), F.col("o_orderdate").alias("scheduled_for"))
    quotes = o.where(k % 3 != 0).select(k.alias("candidate_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(q).alias("q")) for f, q in (("a", "q"), ("b", "r"), ("c", "s"))])).alias("e")).select("candidate_id", F.col("e.f").alias("field_name"), F.col("e.f").alias("evidence_id"), _strings(F.col("e.q"), F.col("candidate_id")).alias("quote"))
    out = briefing.assemble(slots, candidates, previous, quotes)
    return out.select("briefing_id", "candidate_id", "segment", "rank", "carried_over", F.array_join("quotes", "|").alias("quotes"))


@query("""
WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)::INT AS r, l_quantity::INT AS v FROM lineitem)
SELECT o::VARCHAR AS briefing_id, '# Report ' || o || string_agg(chr(10) || chr(10) || '## ' || r || '. part ' || p || chr(10) || '- score: ' || CASE WHEN v = 7 THEN '-' ELSE v::VARCHAR END || chr(10) || '- claim: -' || CASE WHEN p % 2 = 0 THEN chr(10) || '- source: https://x.example/' || p ELSE '' END || chr(10) || '  - > a quote', '' ORDER BY r) FILTER (WHERE r <= 7) AS markdown,
       greatest(count(*) - 7, 0)::INT AS items_truncated FROM l GROUP BY o
""")
def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports and their lines as items, as text; what is over seven is counted."""
    made = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"))).alias("es"))
    rows = made.select(F.col("l_orderkey").cast("string").alias("briefing_id"), F.posexplode("es").alias("k", "e"))
    part = F.col("e.l_partkey")
    items = rows.select("briefing_id", (F.col("k") + 1).alias("rank"), _strings("part\n ", part).alias("canonical_name"), F.when(F.col("e.l_quantity") != 7, F.col("e.l_quantity").cast("int")).alias("value_score"), F.lit(" ").alias("core_claim"), F.array(F.lit("a \n quote")).alias("quotes"), F.when(part % 2 == 0, _strings("https://x.example/", part)).alias("source_link"))
    return briefing.render_briefings(briefing.render_items(items))


@query("""
SELECT o_custkey AS candidate_id, min_by(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS priority, array_to_string(list_distinct(list('q' || o_orderkey % 3 ORDER BY o_orderkey)), '|') AS quotes_sorted, count(*) AS n FROM orders GROUP BY 1
""".replace("array_to_string(list_distinct(list('q' || o_orderkey % 3 ORDER BY o_orderkey)), '|')", "array_to_string(list_sort(list_distinct(list('q' || o_orderkey % 3))), '|')"))
def candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of customers: the first value of a field that is there, and the distinct quotes."""
    k = F.col("o_orderkey")
    quote = _strings("q", k % 3)
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate_id"), k.alias("position"), quote.alias("evidence_id"), quote.alias("quote"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("priority"))
    counts = rows.groupBy("candidate_id").agg(F.count("*").alias("n"))
    out = briefing.grouped_evidence(rows).join(counts, "candidate_id")
    return out.select("candidate_id", "priority", F.array_join(F.array_sort(F.transform("quotes", lambda q: q["quote"])), "|").alias("quotes_sorted"), "n")


@query("""
SELECT user_id, concat_ws(',', CASE WHEN n = 0 THEN 'no_candidates' END, CASE WHEN a = 0 THEN 'no_approved_candidates' END, CASE WHEN f > 0 THEN 'source_failures' END, CASE WHEN c > 0 THEN 'carried_over' END) AS notes
FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS n, count(*) FILTER (WHERE event_type = 'purchase') AS a, count(*) FILTER (WHERE event_type = 'error') AS f, count(*) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY 1)
""")
def report_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader should know of a user's report."""
    n = {k: F.count_if(F.col("event_type") == k).alias(k) for k in ("view", "purchase", "error", "click")}
    counted = table(spark, sf_dir, "events").groupBy("user_id").agg(*n.values())
    return counted.select("user_id", F.array_join(briefing.notes(*[F.col(k) for k in n]), ",").alias("notes"))


@query("""
WITH r AS (SELECT o_orderkey AS k, date_trunc('day', o_orderdate) AS t FROM orders WHERE o_orderstatus = 'F'),
s AS (SELECT c_custkey, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (c_custkey % 1500)::INT + INTERVAL 12 HOUR AS z, c_custkey % 4 <> 0 AS good FROM customer),
l AS (SELECT s.*, (SELECT max(t) FROM r WHERE t <= s.z AND k % 200 = 0) AS prev FROM s)
SELECT c_custkey, CASE WHEN prev < z - INTERVAL 30 DAY THEN z - INTERVAL 30 DAY ELSE coalesce(prev, z - INTERVAL 14 DAY) END AS window_start, z AS window_end, prev IS NOT NULL AND prev < z - INTERVAL 30 DAY AS truncated, CASE WHEN good THEN z ELSE prev END AS cursor FROM l
""")
def report_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as occurrences after runs on the days of some orders: windows that tile time, and the next cursors."""
    runs = table(spark, sf_dir, "orders").where("o_orderkey % 200 = 0").select(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("window_end"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("run_status"), F.col("o_orderkey").alias("position"))
    at = F.timestamp_add("HOUR", ((F.col("c_custkey") % 1500) * 24 + 12).cast("int"), _at(1995, 1, 1)).cast("timestamp_ntz")
    slots = table(spark, sf_dir, "customer").select("c_custkey", at.alias("scheduled_for"), F.when(F.col("c_custkey") % 4 != 0, "success").otherwise("failed").alias("run_status"))
    out = records.advance_cursor(runs, slots)
    return out.select("c_custkey", "window_start", "window_end", "truncated", "cursor")


@query("""
WITH c AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9가-힣]+', ' ', 'g')) AS n, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[a-z0-9가-힣]+')) AS t, p_size AS s FROM part),
a AS (SELECT * FROM c WHERE s <= 10), b AS (SELECT * FROM c WHERE id % 4 = 1),
j AS (SELECT a.id, b.id AS other, len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(a.t || b.t)) AS sim FROM a JOIN b ON a.id <> b.id AND len(list_intersect(a.t, b.t)) > 0),
m AS (SELECT id, other, sim FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) = 1),
w AS (SELECT a.id, (SELECT min(b.id) FROM b WHERE b.n = a.n AND b.id <> a.id) AS one FROM a),
k AS (SELECT a.id, CASE WHEN (SELECT min(b.id) FROM b WHERE b.n = a.n) <> a.id THEN (SELECT min(b.id) FROM b WHERE b.n = a.n) ELSE (SELECT max(b.id) FROM b WHERE b.n = a.n AND b.id <> a.id) END AS twin FROM a)
SELECT a.id AS candidate_id, coalesce(twin, other) AS best_id, round(coalesce(sim, 0), 6) AS similarity, CASE WHEN twin IS NOT NULL THEN 'duplicate' WHEN coalesce(sim, 0) >= 0.35 THEN 'variant' ELSE 'new' END AS status,
       CASE WHEN twin IS NOT NULL THEN 0 WHEN coalesce(sim, 0) >= 0.65 THEN 3 WHEN coalesce(sim, 0) >= 0.35 THEN 6 ELSE 10 END AS points
FROM a LEFT JOIN k ON k.id = a.id LEFT JOIN m ON m.id = a.id
""")
def token_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parts as new candidates against every fourth part as those that are there, by all tokens."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("canonical_name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"), "p_size")
    return scoring.token_novelty(p.where("p_size <= 10"), p.where("candidate_id % 4 = 1"), ["canonical_name", "kind", "brand"])


@query("""
SELECT c_custkey, CASE WHEN k = 0 THEN 'candidate|' || c_custkey || '|f;strategy|s' || c_nationkey || '|f' WHEN k = 1 THEN 'strategy|s' || c_nationkey || '|' WHEN k = 2 THEN 'name|customer ' || split_part(c_name, '#', 2) ELSE 'item|i' || c_custkey END AS identities,
       CASE WHEN c_custkey % 2 = 0 THEN 'https://a.example/' || c_custkey ELSE '' END AS links
FROM (SELECT *, c_custkey % 4 AS k FROM customer)
""")
def item_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What items are the same as others by, from their strongest name down, and their safe links."""
    k, n = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    link = F.when(F.col("c_custkey") % 2 == 0, _strings("https://a.example/", n)).otherwise("javascript:x")
    d = table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 0, n).alias("candidate_id"), F.when(k <= 1, _strings("s", F.col("c_nationkey"))).alias("strategy_id"), F.when(k == 0, "f").alias("field_name"), F.when(k == 2, F.col("c_name")).alias("canonical_name"), _strings("i", n).alias("item_id"), link.alias("canonical_url"), F.lit("data:x").alias("source_url"))
    return d.select("c_custkey", F.array_join(records.identities(d), ";").alias("identities"), F.array_join(records.source_links(d), ";").alias("links"))


@query("SELECT conv_id, role AS field_name, text AS quote, turn <= 1 AS fits FROM conversations")
def evidence_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps from fields to quotes as rows, and whether another quote would still fit the limit of an item."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.map_from_arrays(F.array("role"), F.array(F.array("text"))).alias("quotes"))
    rows = records.evidence_rows(c.withColumn("key", F.struct("conv_id", "turn")), "key")
    return rows.select("key.conv_id", "field_name", "quote", records.within_item_limit(F.col("key.turn"), F.lit(1)).alias("fits"))


@query("""
SELECT o_orderkey, CASE k WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate - INTERVAL 14 DAY END AS start, CASE k WHEN 0 THEN o_orderdate + INTERVAL 2 DAY ELSE o_orderdate END AS stop FROM (SELECT *, o_orderkey % 3 AS k FROM orders)
""")
def observed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of a report: as supplied, else its own, else two weeks before its slot."""
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate").cast("timestamp_ntz")
    w = records.observation_window(F.when(k == 0, d), F.when(k != 1, F.timestamp_add("DAY", F.lit(2), d)), F.when(k == 1, F.timestamp_add("DAY", F.lit(-1), d)), d, d)
    return table(spark, sf_dir, "orders").select("o_orderkey", w.alias("w")).select("o_orderkey", F.col("w.start").alias("start"), F.col("w.end").alias("stop"))


@query("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1")
def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and failures of each tumbling week; the same frame serves a stream."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.event_rates(e, "ts").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "failed")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'stored' WHEN c_custkey % 3 = 1 THEN 'new' ELSE 'new' END AS origin FROM customer
""")
def absent_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers put into a table that has a third of them: what is stored wins, and repeats add nothing."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    stored = c.where("c_custkey % 3 = 0").withColumn("origin", F.lit("stored"))
    new = c.withColumn("origin", F.lit("new"))
    return records.insert_absent(stored, new.unionByName(new), "c_custkey")
