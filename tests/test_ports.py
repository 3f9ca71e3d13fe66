import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quillspark import review_cli
from quillspark.sources import ports


class Page(BaseHTTPRequestHandler):
    def do_GET(self):
        kind, body = "text/html", b"<p>hi</p>"
        if self.path.startswith("/go"):
            n = int(self.path[3:] or 0)
            self.send_response(302)
            self.send_header("Location", f"/go{n - 1}" if n else "/page?x=1")
            self.end_headers()
            return
        if self.path == "/png":
            kind = "image/png"
        if self.path == "/big":
            body = b"x" * 5000
        self.send_response(200)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    one = HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=one.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{one.server_port}"
    one.shutdown()


def test_fetch(server):
    seen = []

    def judge(url):
        seen.append(url)
        return "host_not_allowed" if "/secret" in url else None

    t = ports.HttpTransport(judge, timeout=5, most=1000)
    assert isinstance(t, ports.Transport)
    got = t.get(f"{server}/go1")
    assert got.body == b"<p>hi</p>" and got.url.endswith("/page?x=1") and len(seen) == 3
    for path, why in (("/go3", "too_many_redirects"), ("/png", "media_type"), ("/big", "content_length"), ("/secret", "host_not_allowed")):
        with pytest.raises(ports.FetchError, match=why):
            t.get(server + path)
    t.close()
    with pytest.raises(ports.FetchError, match="closed"):
        t.get(server)


def test_refusal():
    public = lambda host: ["93.184.216.34"]
    hosts = ["example.com"]
    assert ports.refusal("https://example.com/a", hosts, public) is None
    assert ports.refusal("ftp://example.com/a", hosts, public) == "unsupported_scheme"
    assert ports.refusal("https://u:p@example.com/", hosts, public) == "credentials_in_url"
    assert ports.refusal("https://other.example/", hosts, public) == "host_not_allowed"
    assert ports.refusal("https://example.com/", hosts, lambda h: ["93.184.216.34", "10.0.0.1"]) == "forbidden_address"
    assert ports.refusal("https://example.com/", hosts, lambda h: []) == "forbidden_address"


def test_folder_store(tmp_path):
    store = ports.FolderStore(f"file://{tmp_path}/s")
    assert isinstance(store, ports.ObjectStore)
    store.put("a-1.txt", b"x")
    store.put("a-1.txt", b"y")
    assert store.get("a-1.txt") == b"y"
    store.delete("a-1.txt")
    store.delete("a-1.txt")
    with pytest.raises(FileNotFoundError):
        store.get("a-1.txt")
    for key in ("", "../a", ".a", "a/b", "ä"):
        with pytest.raises(ValueError):
            store.put(key, b"")


def test_review_commands(spark, tmp_path):
    base = f"file://{tmp_path}"
    rows = [("c1", "one", "needs_review", 5, 1), ("c2", "two", "approved", 7, 2)]
    c = spark.createDataFrame(rows, "candidate_id string, canonical_name string, review_status string, value_score int, created_at int")
    c.withColumn("core_hypothesis", F.lit("h")).write.parquet(f"{base}/candidates")
    spark.createDataFrame([("c1", "core_hypothesis", "q", None)], "candidate_id string, field_name string, quote string, evidence_error string").write.parquet(f"{base}/evidence")
    spark.createDataFrame([("b1", "draft", 1), ("b2", "approved", 2)], "briefing_id string, publication_status string, scheduled_for int").write.parquet(f"{base}/briefings")

    def do(*words):
        return review_cli.run(spark, review_cli.parser().parse_args(["--tables", base, *words]))

    assert len(do("list")) == 2 and "c1" in do("list", "--status", "needs_review")[0]
    assert len(do("show", "c1")) == 6 and '"quotes":["q"]' in do("show", "c1")[0]
    assert do("decide", "c1", "approved", "--reviewer", "me") == ["c1: approved"]
    assert not do("list", "--status", "needs_review") and spark.read.parquet(f"{base}/reviews").count() == 1
    with pytest.raises(ValueError):
        do("decide", "c2", "rejected", "--reviewer", "me")
    assert do("briefing-decide", "b1", "approved") == ["b1: approved"] and len(do("briefing-list", "--status", "approved")) == 2
    with pytest.raises(ValueError):
        do("briefing-decide", "b2", "rejected")
