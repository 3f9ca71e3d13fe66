from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import html, text, timing, urls


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()])
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://Example.COM:80/a/./b/../c//d/?utm_source=x&b=2&a=1&gclid=9#f", "http://example.com/a/c/d/?a=1&b=2"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com:8443/%7euser/%2f?q=a%20b&q=", "https://example.com:8443/~user/%2F?q=&q=a+b"),
        ("https://bücher.example/%", "https://xn--bcher-kva.example/%25"),
        ("http://[::1]:80/x", "http://[::1]/x"),
        ("http://u:P@Host/", "http://u:P@host/"),
        ("http://h:99999/", None),
        ("/relative", None),
        ("http:///x", None),
        (None, None),
    ],
)
def test_canonical(url, want):
    assert urls.canonical(url) == want


@settings(max_examples=200, deadline=None)
@given(st.text("abc/.%2eEfF~?&=+utm_#é", max_size=30))
def test_canonical_is_idempotent(tail):
    first = urls.canonical("https://example.com/" + tail)
    assert first is None or urls.canonical(first) == first


def test_links_and_addresses(spark):
    for link, ok in (("https://a.b/c", True), ("doi:10.1/x", True), ("javascript:alert(1)", False), ("data:text/html,x", False), ("a/b", False), (None, False)):
        assert one(spark, urls.safe_link(F.col("x")), x=link) is ok
    assert [urls.forbidden(a) for a in ("8.8.8.8", "10.0.0.1", "127.0.0.1", "::ffff:10.0.0.1", "100.64.0.1", "fe80::1%eth0", "224.0.0.1", "x", None, "2606:4700::1")] == [False, *[True] * 8, False]
    assert one(spark, urls.normalize_url_ascii(F.col("x")), x="HTTPS://A.com:443//b?z=1&utm_x=2&a=3#f") == "https://a.com/b?a=3&z=1"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p onclick=x>a<script>b<script>c</script>d</p>", "<p>ad</p>"),
        ('<a href="java\nscript:x" title="t">q</a>', '<a title="t">q</a>'),
        ('<img src="data:x"><img srcset="a 1x, javascript:b 2x"><br/>', "<img><img><br />"),
        ('<div style="background:url(\'javascript:x\')">a &lt; b &amp; c</div>', "<div>a &lt; b &amp; c</div>"),
        ("<!-- c --><!DOCTYPE html><iframe><b>x</b></iframe><i>y</i>", "<i>y</i>"),
        ("", ""),
    ],
)
def test_inert(page, want):
    assert html.inert(page) == want


def test_title():
    assert html.title("<title> a\n b</title><p>c</p>") == "a b" and html.title("<p>x</p>") is None and html.title(None) is None


@pytest.mark.parametrize(("cut", "body", "head"), [("a&amp", "a&amp;", "a&"), ("a&am", "a&amp;am", "a&am"), ("a&", "a&amp;", "a&")])
def test_references_cut_short_are_read_and_escaped(cut, body, head):
    assert html.inert(f"<title>{cut}</title>") == f"<title>{body}</title>" and html.title(f"<title>{cut}</title>") == head


def test_scores_round_half_to_even(spark):
    assert [one(spark, text.clamp_score(F.col("x"), 10), x=v) for v in (2.5, 3.5, 0.5, -1.0, 99.0)] == [2, 4, 0, 0, 10]


def test_times(spark):
    want = datetime(2024, 2, 3, 4, 5, 6)
    for t in ("Sat, 03 Feb 2024 04:05:06 GMT", "Sat, 03 Feb 2024 06:05:06 +0200", "2024-02-03T04:05:06Z", "2024-02-03 04:05:06"):
        assert one(spark, text.parse_time("x").cast("timestamp_ntz"), x=t) == want
    assert one(spark, text.parse_time("x"), x="soon") is None
    assert one(spark, text.date_parts(F.array(F.lit(2024), F.lit(5))).cast("timestamp_ntz")) == datetime(2024, 5, 1)


def test_masking(spark):
    assert one(spark, text.mask_secrets("x"), x="API_KEY=abc, my_token : q; plain=1") == "API_KEY=[REDACTED], my_token : [REDACTED]; plain=1"
    assert one(spark, text.mask_secrets("x", known=["hunter2"]), x="say hunter2") == "say [REDACTED]"
    assert one(spark, text.mask_map(F.create_map(F.lit("A_SECRET"), F.lit("v"), F.lit("b"), F.lit("v")))) == {"A_SECRET": "[REDACTED]", "b": "v"}
    assert [one(spark, text.is_secret_name("x"), x=v) for v in ("TOKEN", "a_key", "monkey", "keys")] == [True, True, False, False]


def test_messages_and_keys(spark):
    assert one(spark, text.chunk_message("x", 3), x="abcdefg") == ["abc", "def", "g"] and one(spark, text.chunk_message("x", 3), x="") == [""]
    assert one(spark, text.idempotency_key(F.lit("b"), F.lit("c"), F.lit("h"))) == "b:c:h"
    assert one(spark, text.idempotency_key(F.lit("b b"), F.lit("c"), F.lit("h"))) is None
    assert one(spark, text.report_id(F.lit("../x"), F.lit("w"))).startswith("report-") and one(spark, text.report_id(F.lit("ok-1"), F.lit("w"))) == "ok-1"
    assert one(spark, text.estimated_tokens("x"), x="  a  b ") == 2 and one(spark, text.estimated_tokens("x"), x="") == 1


def test_tokens_and_similarity(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"))
    assert one(spark, text.jaccard(a, b)) == 0.5 and one(spark, text.jaccard(F.array().cast("array<string>"), b)) == 0
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"), 1.0)) == 1
    assert one(spark, text.fold_unicode("x"), x="Ｓtraße—№5") == "strasse no5"
    assert one(spark, text.score_tokens("x"), x="Ab 가나, ab-C1") == ["ab", "가나", "c1"]


def test_quotes_and_snippets(spark):
    assert one(spark, text.quote_in_source(F.lit("a  b"), F.lit("x a b y"))) and not one(spark, text.quote_in_source(F.lit(" "), F.lit("x y")))
    assert one(spark, text.snippet(F.lit("p " * 100 + "Key\nword" + " q" * 100), F.lit("key"), 4, 6)) == "p p Key word"
    assert one(spark, text.snippet(F.lit("none"), F.lit("key"))) is None


def test_json(spark):
    assert str(one(spark, text.fenced_json("x").cast("string"), x='```json\n{"a": 1}\n```')) == '{"a":1}'
    assert one(spark, text.fenced_json("x").cast("string"), x="[1]") is None
    assert one(spark, text.canonical_json(F.struct(F.lit("é").alias("b"), F.lit(1).alias("a")))) == '{"a":1,"b":"é"}'


def test_windows(spark):
    rows = timing.observation_windows(spark, datetime(2024, 1, 1), datetime(2024, 1, 20)).collect()
    assert len(rows) == 3 and rows[0].end == rows[1].start and len({r.window_id for r in rows}) == 3
    t = lambda d: F.lit(d).cast("timestamp_ntz")
    assert one(spark, timing.window_start(t(datetime(2024, 1, 8)), datetime(2024, 1, 1))) == datetime(2024, 1, 8)
    now = t(datetime(2024, 3, 1))
    none = F.lit(None).cast("timestamp_ntz")
    w = one(spark, timing.collection_window(none, none, now))
    assert w.window_start == datetime(2024, 2, 16) and not w.truncated
    w = one(spark, timing.collection_window(t(datetime(2023, 1, 1)), none, now))
    assert w.window_start == datetime(2024, 1, 31) and w.truncated and w.requested_start == datetime(2023, 1, 1)


def test_schedules(spark):
    span = spark.sql("SELECT TIMESTAMP '2024-03-25 00:00:00' AS a, TIMESTAMP '2024-04-08 00:00:00' AS b")
    got = [str(r.scheduled_for) for r in timing.slots_between(span, "a", "b", ["TUE 08:30", "fri 17:00"], "Europe/Berlin").selectExpr("cast(scheduled_for AS timestamp_ntz) AS scheduled_for").orderBy("scheduled_for").collect()]
    assert got == ["2024-03-26 07:30:00", "2024-03-29 16:00:00", "2024-04-02 06:30:00", "2024-04-05 15:00:00"]
    for bad in (["XXX 08:30"], ["MON 24:00"], [], ["MON 08:30", "mon 08:30"]):
        with pytest.raises(ValueError):
            timing.parse_schedule(bad)
    at = F.lit(datetime(2024, 3, 26, 8, 30)).cast("timestamp")
    assert one(spark, timing.next_slot(at, ["TUE 08:30", "FRI 17:00"]).cast("timestamp_ntz")) == datetime(2024, 3, 29, 17)
