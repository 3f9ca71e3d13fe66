import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import mil_quality as M
from tests.llm.helpers import frame, odd, prose

SF = "/root/testdata/sf0.01"


def labelled(rng, n):
    """Good prose, and the same with a run of one word somewhere in it."""
    rows, labels = [], []
    for i in range(n):
        text, bad = prose(rng, rng.randrange(30, 300)), i % 3 == 0
        if bad:
            w = text.split()
            a = rng.randrange(len(w))
            text = " ".join([*w[:a], *[rng.choice(["buy!!", "$$$ %%%"])] * 60, *w[a:]])
        rows.append((i, text))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled(random.Random(1), 500)
    out = M.score(spark, frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("doc_id") % 5 == 0).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if r.held_out]
    assert len(out) == 500 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_accuracy_of_the_provided_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = M.score(spark, docs, labels, held).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_odd_rows_and_no_labels(spark):
    rows = odd(random.Random(1))
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = M.score(spark, frame(spark, rows), none, F.col("doc_id") % 5 == 0).collect()
    assert len(out) == len(rows) and len({round(r.score, 9) for r in out}) == 1
    odd_labels = spark.createDataFrame([(None, 1), (1, None), (2, 0), (4, 1), (5, 1), (5, 0), (7, 9), (8, 1)], "doc_id long, quality int")
    out = M.score(spark, frame(spark, rows), odd_labels, F.col("doc_id") % 5 == 4).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert M.score(spark, frame(spark, []), odd_labels, F.col("doc_id") % 5 == 0).count() == 0


def test_keep_good_keeps_columns(spark):
    rows, labels = labelled(random.Random(2), 200)
    docs = frame(spark, [*rows, (None, None)])
    out = M.keep_good(spark, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("doc_id") % 5 == 0)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert len(kept & {i for i, q, _ in labels if q}) > 125 and len(kept & {i for i, q, _ in labels if not q}) < 8


def test_gradients():
    p = M.Quality(hidden=5, gate=3)
    rng = np.random.default_rng(1)
    bags = [rng.random((n, p.width)).astype(np.float32) for n in (1, 4, 2)]
    y = np.array([1.0, 0.0, 1.0])
    m = M.train(bags, y, M.Quality(hidden=5, gate=3, epochs=1))
    x, edges = np.concatenate(bags), np.array([0, 1, 5, 7])

    def loss():
        s, _ = m.forward(x, edges)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    g = m.gradients(x, edges, y)
    for k, v in m.w.items():
        i = tuple(0 for _ in v.shape)
        old, eps = v[i], 1e-5
        v[i] = old + eps
        up = loss()
        v[i] = old - eps
        down = loss()
        v[i] = old
        assert abs((up - down) / (2 * eps) - g[k][i]) < 1e-6, k


def test_passages_do_not_depend_on_neighbours():
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (0, 1, 64, 65, 400)] + ["", None]
    p = M.Quality()
    x, edges = M.encode(pa.array(texts), p)
    for i, t in enumerate(texts):
        one, _ = M.encode(pa.array([t], pa.string()), p)
        assert np.array_equal(one, x[edges[i] : edges[i + 1]])


def test_long_labelled_texts_count_by_evenly_spread_passages(spark):
    assert M.spread(3, 8, 9).tolist() == [3, 4, 5, 6, 7] and M.spread(10, 110, 5).tolist() == [10, 30, 50, 70, 90]
    rng = random.Random(5)
    rows = [(i, " ".join(["!!! junk"] * 200 if i % 2 else [prose(rng, 10) for _ in range(30)])) for i in range(40)] + [(100, "!!! junk " * 30_000)]
    labels = [(i, int(i % 2 == 0)) for i in range(40)] + [(100, 0)]
    p = M.Quality(sample_passages=8)
    kept = M.keep_good(spark, frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(False), p)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(range(0, 40, 2))
