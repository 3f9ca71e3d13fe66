import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import briefing, delivery, evidence, gate, lint, metrics, novelty, records, relevance, review, routing, scoring, states, validation, versions

T0 = datetime(2024, 1, 1)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def windows(spark, n=4):
    return spark.createDataFrame([(f"w{i}", T0 + timedelta(days=7 * i), T0 + timedelta(days=7 * i + 7)) for i in range(n)], "window_id string, start timestamp, end timestamp")


def test_empty_samples_are_not_zero(spark):
    w = windows(spark, 2)
    jobs = spark.createDataFrame([("w0", "a", "success", False), ("w0", "a", "failed", True), ("w0", "a", "failed", False), ("w0", "off", "success", False)], "window_id string, source_id string, status string, terminal_error boolean")
    sources = spark.createDataFrame([("a", True), ("off", False)], "source_id string, active boolean")
    got = rows(metrics.collection_success(jobs, sources, w), "window_id", "value", "sample_size", "verdict", "meets_target")
    assert got == [("w0", 0.5, 2, "breached", False), ("w1", None, 0, "insufficient_data", False)]


def test_final_attempt_is_chosen_within_the_window(spark):
    d = spark.createDataFrame([("w0", "b", "c", 1, T0, "1", "failed"), ("w0", "b", "c", 2, T0, "2", "sent"), ("w1", "b", "c", 3, T0, "3", "failed"), ("w0", "b", "d", 1, T0, "4", "failed"), ("w0", "b", "d", 1, T0, "5", "sent")], "window_id string, briefing_id string, channel string, attempt_no int, attempted_at timestamp, delivery_id string, status string")
    assert rows(metrics.delivery_failure(d, windows(spark, 2)), "window_id", "value", "sample_size", "verdict") == [("w0", 0.0, 2, "met"), ("w1", 1.0, 1, "breached")]


def test_duplicates_are_flagged_over_the_whole_history(spark):
    v = spark.createDataFrame([("w0", "d", "h", T0, 1, "a"), ("w1", "d", "h", T0, 2, "b"), ("w1", "d", "g", T0, 3, "c"), ("w1", "e", "h", T0, 1, "d")], "window_id string, document_id string, content_hash string, created_at timestamp, version_no int, document_version_id string")
    assert rows(metrics.duplicate_rate(v, windows(spark, 2)), "window_id", "numerator", "sample_size") == [("w0", 0.0, 1), ("w1", 1.0, 3)]


def test_delay_backlog_and_gap(spark):
    b = spark.createDataFrame([("w0", "x", 1, 1, 90.0), ("w0", "x", 2, 2, 10.0), ("w0", "y", 1, 3, 20.0)], "window_id string, briefing_id string, run_attempt int, tie int, delay double")
    assert rows(metrics.briefing_delay(b, windows(spark, 2)), "value", "verdict") == [(20.0, "met"), (None, "insufficient_data")]
    c = spark.createDataFrame([("needs_review",)] * 21 + [("x",)], "review_status string")
    assert rows(metrics.review_backlog(c, windows(spark, 1)), "value", "sample_size", "verdict") == [(21.0, 22, "breached")]
    i = spark.createDataFrame([("w0", 1), ("w0", 2)], "window_id string, item_id int")
    assert rows(metrics.evidence_gap(i, spark.createDataFrame([(1,), (1,)], "item_id int"), windows(spark, 1)), "value", "numerator") == [(0.5, 1.0)]


def metric_rows(spark, verdicts):
    return spark.createDataFrame([(w, m, v, v == "met", 1.0 if v != "insufficient_data" else None, 1) for (w, m), v in verdicts.items()], "window_id string, metric_id string, verdict string, meets_target boolean, value double, sample_size long")


def test_expansion_gate(spark):
    good = {(f"w{i}", m): "met" for i in range(4) for m in metrics.TARGETS}
    decide = lambda v, w=None: metrics.expansion_gate(metric_rows(spark, v), w or windows(spark)).first()
    assert decide(good).eligible
    assert decide(good, windows(spark, 3)).reason == "not_enough_windows"
    assert decide(good | {("w1", "M2"): "breached"}).reason == "breached"
    both = decide(good | {("w1", "M2"): "breached", ("w2", "M3"): "insufficient_data"})
    assert both.reason == "insufficient_data" and both.blocked_metrics == ["M2", "M3"]
    gap = windows(spark).withColumn("end", F.when(F.col("window_id") == "w1", F.col("end") - F.expr("INTERVAL 2 DAYS")).otherwise(F.col("end"))).withColumn("start", F.when(F.col("window_id") == "w2", F.col("start") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("start")))
    assert decide(good, gap).reason == "not_consecutive"
    blockers = records.expansion_blockers(metric_rows(spark, good | {("w1", "M2"): "breached"}), windows(spark), list(metrics.TARGETS))
    assert rows(blockers, "window_id", "metric_id", "reason") == [("w1", "M2", "breached")]
    row = metrics.expansion_gate(metric_rows(spark, good), windows(spark))
    assert {r[0] for r in rows(metrics.expansion_recommendations(row, spark.range(1)), "recommendation")} == {"recommend"}
    assert {r[0] for r in rows(metrics.expansion_recommendations(row, spark.range(0)), "recommendation")} == {"hold"}
    assert rows(metrics.recalibration(row, {"a": 1.0, "b": 2.0}, {"a": 3.0}), "threshold", "recommended", "changed") == [("a", True, False), ("b", False, False)]


def test_alerts_and_reports(spark):
    m = metric_rows(spark, {("w0", "M1"): "breached", ("w0", "M2"): "met"})
    full = metrics.complete_rows(m, windows(spark, 1))
    assert full.count() == 6 and {r.verdict for r in full.collect()} == {"breached", "met", "insufficient_data"}
    assert rows(metrics.alerts(full), "alert_id", "severity")[:2] == [("w0:M1", "error"), ("w0:M3", "warning")]
    body = briefing.render_metrics(full).first().markdown
    assert "breached: M1\n" in body and body.endswith("insufficient data: M3, M4, M5, M6") and body.index("| M1 |") < body.index("| M2 |")


def test_relevance(spark):
    docs = spark.createDataFrame([(1, "order book momentum"), (2, "dividend yield"), (3, "dividend momentum l1"), (4, "the order book"), (5, "momentum alone"), (6, "momentum in seconds"), (7, ""), (8, None)], "id int, text string")
    out = relevance.classify(docs)
    assert rows(out, "id", "relevance") == [(1, "relevant"), (2, "irrelevant"), (3, "relevant"), (4, "background_only"), (5, "irrelevant"), (6, "relevant"), (7, "irrelevant"), (8, "irrelevant")]
    r = out.where("id = 1").first()
    assert r.microstructure_terms == ["order book"] and r.strategy_snippets == ["order book momentum"]
    assert relevance.classifiable(spark.createDataFrame([("collected",), (None,), ("validated",)], "state string")).count() == 2


def test_evidence(spark):
    asked = spark.createDataFrame([("c", 1, "f", " a  b ", "v"), ("c", 2, "f", "zz", "v"), ("c", 3, "f", "c d", "v"), ("c", 4, "f", "e", "v"), ("c", 5, "g", "a b", "v"), ("c", 6, "h", "a b", "w")], "candidate_id string, request_id int, field_name string, quote string, document_version_id string")
    proof = spark.createDataFrame([("f", "a  b", None, 1, True), ("f", "zz", "v", 2, True), ("f", "c d", "v", 3, True), ("f", "e", "v", 4, True), ("g", "a b", "other", 5, True), ("h", "a b", None, 6, True)], "field_name string, quote string, document_version_id string, provenance_id int, accepted boolean")
    versions_ = spark.createDataFrame([("v", "x a b c d e")], "document_version_id string, body string")
    got = rows(evidence.link(asked, proof, versions_), "request_id", "evidence_error")
    assert got == [(1, None), (2, "quote_not_in_source"), (3, "quote_limits"), (4, "quote_limits"), (5, "no_provenance"), (6, "unknown_version")]


def test_containment_equals_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab cd efg h ij".split()) for _ in range(30)) for _ in range(40)]
    quotes = [t[k : k + n] for t in texts[:20] for k, n in ((rng.randrange(20), 14), (rng.randrange(20), 25))] + ["none of these"]
    q = spark.createDataFrame(list(enumerate(quotes)), "q int, quote string")
    d = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    want = {(i, j) for i, x in enumerate(quotes) for j, t in enumerate(texts) if x in t}
    assert set(rows(evidence.contained(q, d), "q", "d")) == want == set(rows(evidence.contained_by_prefix(q, d), "q", "d"))


CANDIDATE = "candidate_id string, canonical_name string, strategy_families array<string>, asset_classes array<string>, holding_horizon string, core_hypothesis string, signal_inputs string, entry_logic string, exit_logic string, required_data string, risk_notes string, document_version_ids array<string>"


def test_quotes_without_an_inner_word_are_found(spark):
    quotes = [(0, "abc"), (1, "b"), (2, "one two"), (3, " x"), (4, ""), (5, None), (6, "日本語テキスト検索エンジンの例文"), (7, "a  b"), (8, "in the middle"), (9, "wanting")]
    bodies = [(0, "xabcx"), (1, "one two three"), (2, "none two"), (3, "全文に日本語テキスト検索エンジンの例文があり"), (4, ""), (5, None), (6, "a  b in the middle x"), (0, "xabcx")]
    q = spark.createDataFrame(quotes, "q int, quote string")
    d = spark.createDataFrame(bodies, "d int, text string")
    want = sorted((i, j) for i, a in quotes for j, b in bodies if a is not None and b is not None and a in b)
    assert sorted((r.q, r.d) for r in evidence.contained(q, d).collect()) == want


def candidates(rng, n, start):
    pick = lambda xs: rng.choice(xs)
    out = []
    for i in range(n):
        core = [pick(["buy dip", "buy the dip", "sell top", "", None]) for _ in range(6)]
        out.append((f"{start}{i}", pick(["Alpha One", "alpha-one", "Beta", ""]), [pick(["F", "G"])], [pick(["X", "y", "Y"])], pick(["5 seconds", "1-2 minutes", "seconds to minutes", "soon", ""]), *core, [pick(["v1", "v2"])] if rng.random() < 0.6 else []))
    return out


def fold(x):
    return "".join(c if c.isalnum() else " " for c in (x or "").lower()).split()


def brute_novelty(c, existing):
    found = {}
    for e in existing:
        units = [[novelty.HORIZON[w] for w in fold(x[4]) if w in novelty.HORIZON] for x in (c, e)]
        same = (min(units[0]), max(units[0])) == (min(units[1]), max(units[1])) if all(units) else fold(c[4]) == fold(e[4])
        over = max(min(units[0]), min(units[1])) <= min(max(units[0]), max(units[1])) if all(units) else bool(fold(c[4])) and fold(c[4]) == fold(e[4])
        sets = [({" ".join(fold(v)) for v in x[2]}, {" ".join(fold(v)) for v in x[3]}) for x in (c, e)]
        sims = []
        for k in range(5, 11):
            a, b = set(fold(c[k])), set(fold(e[k]))
            sims.append(1.0 if not a and not b else len(a & b) / len(a | b))
        s = round(sum(sims) / 6, 6)
        name = bool(fold(c[1])) and fold(c[1]) == fold(e[1])
        profile = sets[0] == sets[1] and same
        related = sets[0][0] & sets[1][0] and sets[0][1] & sets[1][1] and over
        if name and profile and s == 1:
            dup = bool(set(c[11]) & set(e[11])) if c[11] and e[11] else c[0] == e[0]
            found.setdefault("duplicate" if dup else "new_evidence", set()).add(e[0])
        elif name and profile:
            found.setdefault("changed", set()).add(e[0])
        elif s >= 0.35 and (related or name):
            found.setdefault("variant", set()).add(e[0])
    for k in novelty.RELATIONS:
        if k in found:
            return k, sorted(found[k] | (found.get("new_evidence", set()) if k == "duplicate" else set()))
    return "new", []


@pytest.mark.parametrize("how", [text.fold_unicode, text.fold_ascii])
def test_novelty_equals_brute_force(spark, how):
    rng = random.Random(4)
    new, old = candidates(rng, 40, "n"), candidates(rng, 60, "o")
    old.append(new[0])
    got = {r.candidate_id: (r.novelty_status, r.related_ids) for r in novelty.classify(spark.createDataFrame(new, CANDIDATE), spark.createDataFrame(old, CANDIDATE), how).collect()}
    assert got == {c[0]: brute_novelty(c, old) for c in new}


def test_novelty_compares_rows_once_for_all_ids(spark):
    rng = random.Random(5)
    new = [(f"{c[0]}-{k}", *c[1:]) for c in candidates(rng, 8, "n") for k in range(3)]
    old = [(f"{c[0]}-{k}", *c[1:]) for c in candidates(rng, 12, "o") for k in range(4)] + new[:6]
    new += [new[0], (new[1][0], *new[9][1:])]
    a, b = spark.createDataFrame(new, CANDIDATE), spark.createDataFrame(old, CANDIDATE)
    got = sorted(novelty.relations(a, b).collect())
    want = []
    for x in new:
        for y in old:
            status, ids = brute_novelty(x, [y])
            if ids:
                want.append((x[0], y[0], status))
    assert [(r.a, r.b, r.relation) for r in got] == sorted(want) and len({(r.a, r.b) for r in got}) < len(got)
    shared = novelty._gathered(novelty.prepare(a), "x", "a")
    assert shared.count() == len({c[1:] for c in ((c[0], *map(str, c[1:])) for c in new)})


def test_novelty_of_ids_with_equal_and_with_several_rows(spark):
    rng = random.Random(5)
    new = [(f"{c[0]}-{k}", *c[1:]) for c in candidates(rng, 8, "n") for k in range(3)]
    old = [(f"{c[0]}-{k}", *c[1:]) for c in candidates(rng, 12, "o") for k in range(4)] + new[:6]
    new += [new[0], (new[1][0], *new[9][1:])]
    a, b = spark.createDataFrame(new, CANDIDATE), spark.createDataFrame(old, CANDIDATE)
    whole = {c[0]: [d for d in new if d[0] == c[0]] for c in new}
    for r in novelty.classify(a, b, separator=",").collect():
        by_kind = [{e[0] for c in whole[r.candidate_id] for e in old if brute_novelty(c, [e])[0] == k} for k in novelty.RELATIONS]
        best = next((k for k, ids in enumerate(by_kind) if ids), None)
        ids = set() if best is None else by_kind[best] | (by_kind[1] if best == 0 else set())
        assert (r.novelty_status, r.related_ids) == ("new" if best is None else novelty.RELATIONS[best], ",".join(sorted(ids)))


def test_token_novelty(spark):
    a = spark.createDataFrame([("a", "X One", "p q r"), ("b", "Y", "p q r s"), ("c", "Z", "none"), ("d", "x-one", "k")], "candidate_id string, canonical_name string, core_hypothesis string")
    got = {r.candidate_id: (r.best_id, r.status, r.points) for r in scoring.token_novelty(a, a, ["core_hypothesis"]).collect()}
    assert got == {"a": ("d", "duplicate", 0), "b": ("a", "variant", 3), "c": (None, "new", 10), "d": ("a", "duplicate", 0)}


@pytest.mark.parametrize("block", [None, ["kind"]])
def test_token_novelty_equals_brute_force(spark, block):
    rng = random.Random(6)
    rows = [(i, f"n{rng.randint(0, 40)}" if rng.random() < 0.5 else None, " ".join(["every"] * (i % 3 > 0) + rng.choices("a b c d e f g h".split(), k=rng.randint(0, 5))), rng.choice("xy")) for i in range(90)]
    old = [r for r in rows if r[0] % 3 != 1] + [(r[0] + 200, None, *r[2:]) for r in rows[:20]] + [(r[0] + 300, None, *r[2:]) for r in rows[:20]]
    old += old[:30]  # repeated rows count once
    new = [*rows, (500, None, "unseen words", "x")]
    schema = "candidate_id long, canonical_name string, core_hypothesis string, kind string"
    want = {}
    for i, name, words, kind in new:
        others = [(j, n, set(w.split())) for j, n, w, k in old if j != i and (block is None or k == kind)]
        mine = set(words.split())
        order = min(((-len(mine & w) / len(mine | w), j) for j, _, w in others if mine & w), default=(0.0, None))
        twins = [j for j, n, _ in others if name and n == name]
        same = [j for j, n, _, k in old if name and n == name and (block is None or k == kind)]
        twin = None if not twins else min(same) if min(same) != i else max(same)
        want[i] = (order[1] if twin is None else twin, round(-order[0], 6), "duplicate" if twin is not None else "variant" if -order[0] >= 0.35 else "new")
    got = scoring.token_novelty(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema), ["core_hypothesis"], block)
    assert {r.candidate_id: (r.best_id, abs(r.similarity), r.status) for r in got.collect()} == want


def test_score(spark):
    full = spark.createDataFrame([("exchange", "me", "2024-01-30T00:00:00Z", "mit", "https://x", "tick data", ["fx"], "5 seconds", "sample", "l2", "h", "s", "e", "x", "d", "r", "relevant", "new", "2024-01-01T00:00:00Z"), *[(None,) * 6 + (None,) + (None,) * 12]], "source_type string, author string, published_at string, license string, canonical_url string, required_frequency string, market_types array<string>, holding_horizon string, time_range string, microstructure_level string, core_hypothesis string, signal_inputs string, entry_logic string, exit_logic string, required_data string, risk_notes string, relevance_status string, novelty_status string, last_successful_briefing_at string")
    got = scoring.score(full, F.lit(datetime(2024, 1, 31)).cast("timestamp")).collect()
    assert got[0].value_score == 100 and {k: v.score for k, v in got[0].score_breakdown.items()} == scoring.WEIGHTS
    assert got[1].value_score == 5


def test_routing(spark):
    df = spark.createDataFrame([(95.0, 0.9, None), (50.0, 0.9, None), (70.0, 0.9, None), (70.1, 0.9, None), (None, 0.9, None), (10.0, 0.5, None), (10.0, None, None), (10.0, 0.9, {"entry_logic": "Conflicting "})], "value_score double, extraction_confidence double, field_status map<string,string>")
    got = [(r.review_status, r.route_reasons) for r in routing.route(df).collect()]
    review_ = "needs_review"
    assert got == [("rejected", []), (review_, ["borderline_score"]), (review_, ["borderline_score"]), ("rejected", []), (review_, ["missing_value_score"]), (review_, ["low_extraction_confidence"]), (review_, ["low_extraction_confidence"]), (review_, ["conflicting_core_field"])]
    assert routing.route(df, review_high=True).first().review_status == review_


def test_states(spark):
    assert not states.EDGES["failed"] and set(states.EDGES) == {s for e in states.EDGES.values() for s in e} | {"discovered"}
    h = spark.createDataFrame([("a", 1, "discovered"), ("a", 2, "collected"), ("a", 3, "classified"), ("b", 1, "failed"), ("b", 2, "collected")], "k string, t int, state string")
    assert rows(states.violations(h, ["k"], ["t"]), "k", "from_state", "to_state") == [("a", "collected", "classified"), ("b", "failed", "collected")]


def test_versions(spark):
    items = lambda *r: spark.createDataFrame([("s", u, b, a, datetime(2024, 1, d), p) for u, b, a, d, p in r], "source_id string, url string, body string, robots_allowed string, retrieved_at timestamp, position int")
    empty = spark.createDataFrame([], "document_id string, content_hash string, version_no int")
    first = versions.new_versions(versions.stage(items(("http://h/a?utm_source=x", "A", "true", 1, 0), ("http://h/a", "A", "true", 1, 1), ("http://H:80/a", "B", "true", 2, 0), ("http://h/z", "secret", "unknown", 1, 0), ("bad", "q", "true", 1, 0))), empty)
    got = rows(first, "canonical_url", "version_no", "normalized_body")
    assert got == [("http://h/a", 1, "A"), ("http://h/a", 2, "B"), ("http://h/z", 1, None)]
    again = versions.new_versions(versions.stage(items(("http://h/a", "A", "true", 3, 0), ("http://h/a", "C", "true", 4, 0))), first.select("document_id", "content_hash", "version_no"))
    assert rows(again, "version_no", "normalized_body") == [(3, "C")]
    told = versions.change_summary(first.where("canonical_url = 'http://h/a'"))
    assert [r.change_summary for r in told.orderBy("version_no").collect()] == ["Initial version", "Content hash changed; body hash changed"]
    docs = spark.createDataFrame([(versions_id, "s", "http://h/a", "Old", None, datetime(2023, 1, 1), datetime(2023, 1, 1), {"k": "1", "j": "0"}) for versions_id in [first.where("version_no = 2").first().document_id]], "document_id string, source_id string, canonical_url string, title string, content_hash string, first_collected_at timestamp, last_checked_at timestamp, metadata map<string,string>")
    staged = versions.stage(items(("http://h/a", "A", "true", 5, 0), ("http://h/n", "N", "true", 5, 0))).withColumns({"title": F.when(F.col("url") == "http://h/n", "New"), "metadata": F.create_map(F.lit("k"), F.lit("2"))})
    up = {r.canonical_url: r for r in versions.upsert_documents(docs, staged).collect()}
    a = up["http://h/a"]
    assert (a.title, a.first_collected_at, a.last_checked_at, a.metadata) == ("Old", datetime(2023, 1, 1), datetime(2024, 1, 5), {"j": "0", "k": "2"}) and up["http://h/n"].title == "New"


def test_validation(spark):
    c = spark.createDataFrame([("a", "n", "h", "explicit", 0.9), ("b", "n", "", "explicit", 0.9), ("c", "n", "h", "inferred", 2.0), ("d", "n", "h", "explicit", 0.9), ("e", "n", "h", "explicit", 0.9)], "candidate_id string, canonical_name string, core_hypothesis string, core_hypothesis_status string, extraction_confidence double")
    e = spark.createDataFrame([(k, "core_hypothesis", "quote_limits" if k == "e" else None) for k in "abce"], "candidate_id string, field_name string, evidence_error string")
    got = {r.candidate_id: (r.error_class, r.publishable_fields, len(r.excluded_fields)) for r in validation.validate(c, e).collect()}
    assert got["a"] == (None, ["core_hypothesis"], 5) and [got[k][0] for k in "bcde"] == ["schema_invalid", "schema_invalid", "evidence_missing", "evidence_invalid"]
    kept = {r.candidate_id: (r.core_hypothesis, r.core_hypothesis_status) for r in validation.keep_supported(c, e).collect()}
    assert kept["a"] == ("h", "explicit") and kept["d"] == (None, "unknown") and kept["e"] == (None, "unknown")
    view = validation.candidate_view(c, e.withColumn("quote", F.lit("q")))
    assert view.count() == 30 and view.where("size(quotes) = 1").count() == 3


def test_lint(spark):
    df = spark.createDataFrame([(1, "a Buy  Signal and risk-free"), (2, "수익률을 보장 합니다"), (3, "fine"), (4, None)], "k int, t string")
    assert [(r.k, r.category, r.phrase) for r in lint.find(df, "k", "t").orderBy("k", "start").collect()] == [(1, "trading_signal", "Buy  Signal"), (1, "return_guarantee", "risk-free"), (2, "return_guarantee", "수익률을 보장")]
    assert [r[0] for r in df.orderBy("k").select(lint.is_clean(F.col("t"))).collect()] == [False, False, True, True]


def test_item_gate(spark):
    good = ("claim", "explicit", ["q"], ["v"], "https://x/y")
    df = spark.createDataFrame([good, ("", "unknown", None, None, None), (None, "unknown", None, None, "https://x/"), ("c", "e", ["a", "b", "c"], ["v"] * 3, "https://x/"), ("c", "e", ["a" * 301], ["v"], "javascript:1"), ("guaranteed profit", "e", ["q"], [""], "https://x/")], "claim string, status string, quotes array<string>, version_ids array<string>, source_link string")
    assert [r.violations for r in gate.item_violations(df).collect()] == [[], [], ["missing_evidence"], ["too_many_quotes"], ["quote_length", "unsafe_source_link"], ["missing_version", "banned_phrase"]]
    assert gate.forbidden_columns(spark.createDataFrame([], "a struct<raw_html:string>, api_token string, title string")) == ["raw_html", "api_token"]


def test_briefing_gate(spark):
    b = "briefing_id string, window_start timestamp, window_end timestamp, approval string, internal_draft boolean, content_hash string, resend_reason string, resend_approved_by string"
    rows_ = [("ok", T0, T0, "approved", False, "h", None, None), ("window", T0 + timedelta(1), T0, "approved", False, "h", None, None), ("draft", T0, T0, "pending", True, "h", None, None), ("pending", T0, T0, "pending", False, "h", None, None), ("sent", T0, T0, "approved", False, "h", None, None), ("resent", T0, T0, "approved", False, "h", "why", "me"), ("twins", T0, T0, "approved", False, "h", None, None), ("source", T0, T0, "approved", False, "h", None, None), ("secret", T0, T0, "approved", False, "h", None, None)]
    i = [(r[0], f"{r[0]}{k}", f"i{k}" if r[0] != "twins" else "i", False, "approved", r[0] != "source", {"api_key" if r[0] == "secret" else "note": "x"}) for r in rows_ for k in range(2)]
    items = spark.createDataFrame(i, "briefing_id string, item_id string, identity string, related boolean, approval string, source_allowed boolean, metadata map<string,string>")
    sent = spark.createDataFrame([("sent", "h", "sent"), ("resent", "h", "sent"), ("ok", "other", "sent")], "briefing_id string, content_hash string, status string")
    got = {r.briefing_id: r.gate_error for r in gate.gate_briefings(spark.createDataFrame(rows_, b), items, sent).collect()}
    assert got == {"ok": None, "window": "invalid_data_window", "draft": None, "pending": "not_approved", "sent": "already_delivered", "resent": None, "twins": "unrelated_duplicates", "source": "source_not_allowed", "secret": "sensitive_information"}


def test_assemble(spark):
    occ = spark.createDataFrame([("b", T0, T0 + timedelta(7), T0 + timedelta(7))], "briefing_id string, window_start timestamp, window_end timestamp, scheduled_for timestamp")
    c = spark.createDataFrame([("a1", "approved", 10.0, T0), ("a2", "approved", None, T0), ("p1", "needs_review", 90.0, T0 + timedelta(7)), ("p2", "pending", 95.0, None), ("old", "needs_review", 99.0, T0 - timedelta(30)), ("done", "rejected", 99.0, T0), ("bare", "approved", 99.0, T0), ("both", "needs_review", 1.0, T0)], "candidate_id string, review_status string, value_score double, created_at timestamp")
    before = spark.createDataFrame([(T0, "old"), (T0, "both"), (T0 + timedelta(7), "p1"), (T0, "done")], "scheduled_for timestamp, candidate_id string")
    e = spark.createDataFrame([(k, "f", f"{k}{n}", f"q{n}") for k in ("a1", "a2", "p1", "p2", "old", "done", "both") for n in range(3)], "candidate_id string, field_name string, evidence_id string, quote string")
    out = briefing.assemble(occ, c, before, e)
    assert [(r.candidate_id, r.segment, r.carried_over) for r in out.orderBy("rank").collect()] == [("a1", "approved", False), ("a2", "approved", False), ("p2", "pending", False), ("p1", "pending", False), ("both", "pending", True), ("old", "carried", True)]
    assert briefing.assemble(occ, c, before, e, most=2).count() == 2 and out.first().quotes == ["q0", "q1"]


def test_grouped_evidence_and_rendering(spark):
    r = spark.createDataFrame([("c", 2, "e2", "q", "second"), ("c", 1, "e1", "p", None), ("c", 3, "e2", "q", "third")], "candidate_id string, position int, evidence_id string, quote string, title string")
    row = briefing.grouped_evidence(r).first()
    assert row.title == "second" and [tuple(q) for q in row.quotes] == [("e1", "p"), ("e2", "q")]
    items = spark.createDataFrame([("b", i, f"n{i}", 1, "c", ["x  y"], "https://l") for i in range(1, 4)], "briefing_id string, rank int, canonical_name string, value_score int, core_claim string, quotes array<string>, source_link string")
    out = briefing.render_briefings(briefing.render_items(items), 2).first()
    assert out.items_truncated == 1 and "## 2. n2" in out.markdown and "n3" not in out.markdown and "> x y" in out.markdown


def test_delivery(spark):
    m = spark.createDataFrame([("b", "c", "hello A_TOKEN=x", None, None), ("b b", "c", "x", None, None)], "briefing_id string, channel string, markdown string, resend_reason string, resend_approved_by string")
    none = spark.createDataFrame([], "idempotency_key string, attempt_no int")
    plan = delivery.plan(m, none)
    assert rows(plan, "attempt_no", "delivery_error") == [(1, None), (None, "invalid_idempotency_key")]
    sent = delivery.dry_run(plan, F.lit(T0))
    assert sent.first().chunks == ["hello A_TOKEN=[REDACTED]"] and sent.first().status == "dry_run"
    again = delivery.plan(m.limit(1), sent.select("idempotency_key", "attempt_no"))
    assert again.first().delivery_error == "resend_approval_required"
    ok = delivery.plan(m.limit(1).withColumns({"resend_reason": F.lit("r"), "resend_approved_by": F.lit("p")}), sent.select("idempotency_key", "attempt_no"))
    assert ok.first().attempt_no == 2
    assert delivery.upsert(sent, delivery.dry_run(ok, F.lit(T0))).select("attempt_no").collect() == [(2,)]


def test_review(spark):
    c = spark.createDataFrame([("a", "needs_review", T0, ["v2", "v1"]), ("b", "rejected", T0, [])], "candidate_id string, review_status string, created_at timestamp, document_version_ids array<string>")
    d = spark.createDataFrame([("a", "r", "approved", "", T0), ("b", "r", "approved", "", T0)], "candidate_id string, reviewer_id string, decision string, comment string, reviewed_at timestamp")
    after, log = review.decide(c, d)
    assert rows(after, "candidate_id", "review_status") == [("a", "approved"), ("b", "rejected")] and [r.candidate_id for r in log.collect()] == ["a"]
    assert review.list_candidates(c, "needs_review").count() == 1 and review.list_candidates(c).count() == 2
    v = spark.createDataFrame([("v1",), ("v2",), ("v3",)], "document_version_id string")
    assert [r.document_version_id for r in review.candidate_versions(c, v).collect()] == ["v2", "v1"]
    b = spark.createDataFrame([("x", "draft"), ("y", "archived")], "briefing_id string, publication_status string")
    out = review.decide_briefings(b, spark.createDataFrame([("x", "approved"), ("y", "approved")], "briefing_id string, decision string"))
    assert rows(out, "briefing_id", "publication_status") == [("x", "approved"), ("y", "archived")]
    log = spark.createDataFrame([], "candidate_id string, reviewer_id string, field_name string, proposed_value string, reason string")
    asked = spark.createDataFrame([("a", "r", "entry_logic", "v", ""), ("a", "r", "title", "v", "")], log.schema)
    assert review.amend(log, asked).count() == 1
