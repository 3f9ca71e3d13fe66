import gzip
import io
import random

import pyarrow.fs as pafs

from quillspark.llm import warc
from tests.llm.helpers import odd, prose


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", None) for r in rows], "page_id long, url string, html string, sha string, refers_to string")


def want(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, url, html in rows:
        raw = (html or "").encode()
        again = i is not None and len(raw) >= least and i > first[html or ""]
        out.append((i, url, len(raw), warc.base32_sha1(raw), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", prose(rng, rng.randrange(200))) for i in range(60)]
    rows += [(100 + i, f"http://c/{i}", rows[7][2]) for i in range(20)] + [(5 + i * 1000, None, t) for i, t in odd(rng) if i]
    return [*rows, (-4, "http://m/", "minus"), (None, "http://n/", rows[7][2]), (None, None, None), (3, "http://h/3", rows[3][2]), (900, "a\r\nb: c\n", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n")]


def records(df):
    return sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark):
    rows = corpus()
    archive = warc.write(spark, pages(spark, rows), warc.Warc(roll=20_000, slice=5000, read=4000, gap=100))
    out = archive.read()
    assert records(out) == want(rows)
    held = {(r.page_id, bytes(r.payload)) for r in out.where("record_type = 'response'").collect()}
    first = {i for i, *_ , kind, _ in want(rows) if kind == "response"}
    assert held == {(i, (h or "").encode()) for i, _, h in rows if i in first and (i is None or (i, (h or "").encode()) in held)}
    assert archive.files.count() > 1 and archive.index.count() == len(rows)


def test_selection_reads_only_its_records(spark):
    archive = warc.write(spark, pages(spark, corpus()))
    some = archive.index.where("page_id BETWEEN 10 AND 19 AND record_type = 'response'")
    assert sorted(r.page_id for r in archive.read(some).collect()) == list(range(10, 20))


def test_least_bytes(spark):
    rows = [(i, "u", "same") for i in range(5)] + [(10 + i, "u", "longer payload") for i in range(3)]
    assert records(warc.write(spark, pages(spark, rows), warc.Warc(least=5)).read()) == want(rows, 5)


def test_empty(spark):
    assert warc.write(spark, pages(spark, [])).read().count() == 0


def test_members_are_whole_gzip_files_at_any_buffer(spark):
    archive = warc.write(spark, pages(spark, corpus()))
    row = archive.index.orderBy("length", ascending=False).first()
    fs, base = pafs.FileSystem.from_uri(archive.folder)
    with fs.open_input_stream(f"{base}/{row.file}", compression=None) as f:
        raw = f.read()
    found = [(o, n, r) for o, n, r in warc.members(io.BytesIO(raw), 7)]
    assert found == list(warc.members(io.BytesIO(raw))) and (row.offset, row.length) in {(o, n) for o, n, _ in found}
    assert all(gzip.decompress(raw[o : o + n]) == r for o, n, r in found)


def test_urls_come_back_as_they_went_in():
    for url in ("http://a/b", " http://a/b ", "http://a/%0A%25", "http://a/\r\nWARC-Type: x", "é\tü\x00", "", " ", "a b"):
        fields, _, payload = warc.parse(warc.record(1, url, b"x", None))
        assert warc._url(fields) == url and payload == b"x" and fields["warc-type"] == "response"
