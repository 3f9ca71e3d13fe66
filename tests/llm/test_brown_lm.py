import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import brown_lm as B
from tests.llm.helpers import frame, odd, prose, words


def held():
    return F.col("doc_id") % 4 == 0


P = B.BrownLM(frequent=40, groups=8, classes=10, sweeps=4, common=50)


def base(rows):
    toks = [(i, [*words(t, fold=True), None]) for i, t in rows]
    train = [t for i, t in toks if i is None or i % 4]
    c = collections.Counter(x for t in train for x in t)
    n, v = sum(c.values()), len(c)
    return [(i, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for i, t in toks]


def check(spark, rows, p=P):
    out = B.score(spark, frame(spark, rows), held(), p).collect()
    key = lambda r: tuple((x is None, x) for x in r[:4]) + (round(r[4], 6),)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out), key=key)
    want = sorted(base(rows), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want])
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in out)
    return out


def languages(rng, n):
    """Documents of two languages with own words, so classes carry what comes next."""
    return [(i, " ".join(f"{'ab'[i % 2]}{w[1:]}" for w in prose(rng, rng.randrange(20, 80), 60).split())) for i in range(n)]


def test_counts_base_and_gain(spark):
    rows = languages(random.Random(1), 120)
    out = check(spark, rows)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_common_words_and_joined_words_agree(spark):
    rows = languages(random.Random(2), 60)
    few = B.score(spark, frame(spark, rows), held(), B.BrownLM(frequent=4, groups=8, classes=6, common=30)).collect()
    many = B.score(spark, frame(spark, rows), held(), B.BrownLM(frequent=4, groups=8, classes=6, common=10**6)).collect()
    a, b = ({r.doc_id: (r.n_known, round(r.score, 6), round(r.base_score, 6)) for r in x} for x in (few, many))
    assert a == b


def test_odd_rows(spark):
    check(spark, odd(random.Random(1)))


def test_no_training_rows_and_empty(spark):
    out = B.score(spark, frame(spark, [(4, "a b"), (8, None)]), held(), P).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in out)
    assert B.score(spark, frame(spark, []), held(), P).count() == 0


def test_exchange_separates():
    rng = np.random.default_rng(1)
    n = 21
    pairs = np.zeros((n, n))
    for _ in range(4000):
        u = rng.integers(0, 10) if rng.random() < 0.5 else rng.integers(10, 20)
        pairs[u, (u // 10 * 10 + rng.integers(0, 10))] += 1
    cls = B.exchange(pairs, 3, 10)
    assert len(set(cls[:10])) == 1 and len(set(cls[10:20])) == 1 and cls[0] != cls[10] and cls[20] == 2


def test_probabilities_sum_to_one(spark):
    rows = languages(random.Random(3), 60)
    df = frame(spark, rows).select("doc_id", "text")
    counts = df.select("text").mapInArrow(B._count_words(P), "word long, ending short, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))
    m = B.fit(spark, df.select("text"), counts, P)
    assert np.allclose((10**m.transition).sum(axis=1), 1)
    n = {r.word: r.n for r in counts.collect()}
    mass = 10**m.log_unseen
    mass[P.classes - 1] = 1  # the end
    from quillspark.llm.words import Words
    import pyarrow as pa

    seen = Words(pa.array([" ".join(sorted({x.decode() for _, t in rows for x in words(t, fold=True)}))]), fold=True)
    cls = m.cls[m.units.of(seen)]
    for h, c in zip(seen.hashes.view(np.int64).tolist(), cls.tolist()):
        mass[c] += 10 ** (math.log10(n[h] - m.discount) - m.log_class[c])
    used = np.isin(np.arange(P.classes), cls)
    assert np.allclose(mass[used], 1)


def test_gain_is_the_rise_of_the_likelihood():
    rng = np.random.default_rng(2)
    n, classes = 30, 5
    pairs = rng.poisson(3, (n, n)).astype(float)
    cls = np.append(rng.integers(0, classes - 1, n - 1), classes - 1)

    def joint(cls):
        member = np.eye(classes)[cls]
        return member.T @ pairs @ member

    now, member = joint(cls), np.eye(classes)[cls]
    off = pairs - np.diag(np.diag(pairs))
    gain = B.Gains(now).of(cls, off @ member, off.T @ member, np.diag(pairs))
    for u in range(n):
        for c in range(classes):
            there = cls.copy()
            there[u] = c
            assert np.isclose(gain[u, c], B.likelihood(joint(there)) - B.likelihood(now))


def test_every_training_word_is_placed(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(f"{'xy'[j % 2]}{rng.randrange(60)}q" for j in range(60))) for i in range(80)]
    p = B.BrownLM(frequent=4, groups=2, classes=6)
    docs = frame(spark, rows).select("doc_id", held().alias("held_out"), "text")
    m, classes, classed = B.learn(spark, docs, p, B.Scratch(spark, "test"))
    train = [t for i, t in rows if i % 4]
    seen = sorted({w for t in train for w in t.split()})
    from quillspark.llm.words import Words
    import pyarrow as pa

    of = {r.word: r for r in classes.collect()}
    cls = {w: of[int(h)].cls for w, h in zip(seen, Words(pa.array([" ".join(seen)]), fold=True).hashes.view(np.int64))}
    assert len(of) == len(seen) and sum(r.n for r in of.values()) == m.tokens - m.ends
    assert not {cls[w] for w in seen if w[0] == "x"} & {cls[w] for w in seen if w[0] == "y"}
    joint = np.zeros((6, 6))
    for t in train:
        path = [5, *(cls[w] for w in t.split()), 5]
        for a, b in zip(path, path[1:]):
            joint[a, b] += 1
    assert (joint == m.joint).all() and B.likelihood(joint) > B.likelihood(B.fit(spark, docs.where("NOT held_out").select("text"), spark.createDataFrame([(r.word, r.ending, r.n) for r in of.values()], "word long, ending short, n long"), p).joint)
    mass = 10**m.log_unseen
    for r in of.values():
        mass[r.cls] += 10 ** (math.log10(r.n - m.discount) - m.log_class[r.cls])
    assert np.allclose(mass[sorted({r.cls for r in of.values()})], 1)
