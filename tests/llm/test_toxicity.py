import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import toxicity as X
from tests.llm.helpers import frame, odd, prose

SF = "/root/testdata/sf0.1"


WORDS = {"insult": ("clown", "idiot", "loser"), "contempt": ("scum", "trash", "worthless"), "disgust": ("disgusting", "pathetic", "vile")}


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        w, bad = prose(rng, rng.randrange(20, 200)).split(), i % 4 == 0
        for word in rng.choice(list(WORDS.values())) if bad else ():
            w.insert(rng.randrange(len(w)), word + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out(spark):
    rows, labels = labelled(random.Random(1), 1000)
    out = X.score(spark, frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 5 == 0).collect()
    truth = dict(labels)
    assert len(out) == 1000 and np.mean([r.predicted == truth[r.doc_id] for r in out if r.held_out]) > 0.97


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_of_the_provided_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    truth = labels.select("doc_id", F.col("toxic").alias("truth"))
    rows = X.score(spark, docs, labels, held).where("held_out").join(truth, "doc_id").collect()
    right = sum(r.predicted and r.truth for r in rows)
    assert right / sum(r.predicted for r in rows) > 0.95 and right / sum(r.truth for r in rows) > 0.85


def test_odd_rows_and_no_labels(spark):
    rows = odd(random.Random(1))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = X.score(spark, frame(spark, rows), none, F.col("doc_id") % 5 == 0).collect()
    assert len(out) == len(rows) and all(0 <= r.toxic <= 1 for r in out)
    few = spark.createDataFrame([(None, 1), (1, None), (2, 0), (4, 1), (5, 1), (5, 0), (7, 9), (8, 1)], "doc_id long, toxic int")
    assert X.score(spark, frame(spark, rows), few, F.col("doc_id") % 5 == 4).count() == len(rows)
    assert X.score(spark, frame(spark, []), few, F.col("doc_id") % 5 == 4).count() == 0


def test_links_use_earlier_probabilities():
    rng = np.random.default_rng(1)
    before = rng.random((400, 1))
    y = (before[:, 0] > 0.5).astype(float)
    w = X._logistic(np.zeros(0, int), np.zeros(0, int), before, y, np.ones(400, bool), 0, X.Toxicity(penalty=0.01))
    assert w[0] > 2


def test_kinds_come_from_the_data(spark):
    rng = random.Random(7)
    groups = [("zorkel", "blargus"), ("snivit", "quemmel"), ("wobbrin", "fnarkle")]
    rows, labels, group = [], [], {}
    for i in range(900):
        w = prose(rng, rng.randrange(20, 100)).split()
        if i % 3 == 0:
            group[i] = rng.randrange(3)
            for word in groups[group[i]]:
                w.insert(rng.randrange(len(w)), word)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    out = X.score(spark, frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 5 == 0).collect()
    best = {}
    for r in out:
        p = [r.kind_1, r.kind_2, r.kind_3]
        if r.doc_id in group:
            best.setdefault(group[r.doc_id], set()).add(p.index(max(p)))
            assert max(p) > 0.5
        else:
            assert max(p) < 0.5
    assert sorted(map(len, best.values())) == [1, 1, 1] and set.union(*best.values()) == {0, 1, 2}


def log_loss(p, y):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))


def test_the_chain_helps_where_one_kind_must_be_strong():
    """Toxic rows hold most signs of one kind, clean ones a few of every kind: no sum of signs tells them apart."""
    rng = np.random.default_rng(4)
    n, each, p = 3000, 8, X.Toxicity()
    x = np.zeros((n, 3 * each), dtype=bool)
    y = np.arange(n) % 3 == 0
    for i in range(n):
        if y[i]:
            x[i, rng.integers(3) * each + rng.permutation(each)[:6]] = True
        else:
            for k in range(3):
                x[i, k * each + rng.permutation(each)[: rng.integers(1, 4)]] = True
    train = np.arange(n) < 2000
    row, place = np.nonzero(x[train])
    folds = np.arange(2000) % p.folds
    kinds = X.derived_kinds(row, place, y[train].astype(int), np.ones(3 * each, bool), 3)
    rest_row, rest_place = np.nonzero(x[~train])
    loss = {}
    for name, categories in (("chain", [*kinds.T.astype(float), y[train].astype(float)]), ("plain", [y[train].astype(float)])):
        weights = X.chained(row, place, folds, categories, 3 * each, p)
        chain = X.Chain(np.arange(3 * each, dtype=np.uint64), [str(k) for k in range(len(weights))], weights, p)
        loss[name] = log_loss(chain.predict(rest_row, rest_place, n - 2000)[:, -1], y[~train])
    assert loss["chain"] < 0.7 * loss["plain"]
