import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import topk as T


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", None) for r in rows], "vec_id long, embedding array<float>, score string, block string")


def brute(rows, k, every=5):
    fine = {(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    vectors = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in fine]
    out = set()
    for q, a in vectors:
        if q % every:
            continue
        scored = sorted({(-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q})
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def corpus(seed, n=300, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, width))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.2, width)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(40)] + [(n + 50, [0.0] * width), (n + 51, [0.0] * width)]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("p", [T.TopK(k=5), T.TopK(k=5, candidates=40, queries=10), T.TopK(k=500, candidates=64, queries=7)])
def test_brute_force(spark, p):
    rows = corpus(1)
    got = {tuple(r) for r in T.top_k(spark, frame(spark, rows), F.col("vec_id") % 5 == 0, p).collect()}
    assert got == brute(rows, p.k)


def test_odd_rows(spark):
    rows = corpus(2, 40) + [(None, [1.0] * 16), (1000, None), (1005, [None] * 16), (1010, [float("nan")] * 16), (1015, [float("inf")] * 16), (1020, [0.5, -0.25]), (1025, []), (5, corpus(2, 40)[0][1])]
    got = {tuple(r) for r in T.top_k(spark, frame(spark, rows), F.col("vec_id") % 5 == 0, T.TopK(k=4, candidates=16, queries=4)).collect()}
    assert {g[0] for g in got} >= {1020, 1025} and not {g[0] for g in got} & {1000, 1005, 1010, 1015}
    assert not {g[2] for g in got} & {None, 1000, 1005, 1010, 1015}


def test_one_vector_and_empty(spark):
    assert T.top_k(spark, frame(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 5 == 0).count() == 0
    assert T.top_k(spark, frame(spark, []), F.col("vec_id") % 5 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-200, 200, (30, 64)).astype(float), rng.integers(-200, 200, (50, 64)).astype(float)
    last = None
    for n in (1, 2, 4, 8, 16, 64):
        bound = T.statistics(a, n) @ T.statistics(b, n).T
        assert (bound + 1e-6 >= a @ b.T).all()
        assert last is None or bound.mean() <= last + 1e-6
        last = bound.mean()


def test_large_components_are_exact():
    a = np.array([[2**40, 3], [1, 1]], dtype=np.int64)
    assert T.exact(a, a).tolist() == [[2**80 % 2**64 + 9, 2**40 + 3], [2**40 + 3, 2]]


def side(x, first=0):
    return T.Side(np.arange(first, first + len(x)), x)


def test_bounds_leave_few_pairs_for_exact_scores():
    rng = np.random.default_rng(5)
    x = np.floor(64 * rng.normal(0, 0.125, (8192, 64))).astype(np.int64)
    q, p = side(x[:100]), T.TopK()
    score = T.exact(x[:100], x)
    score[np.arange(100), np.arange(100)] = -(10**9)
    floor = np.sort(score, axis=1)[:, -p.k].astype(float)
    left = [len(rows) for rows, _ in T.survivors(q, side(x), floor, p)]
    assert left == sorted(left, reverse=True) and left[-1] < 0.5 * left[0]
    for rows, cols in T.survivors(q, side(x), floor, p):
        alive = np.zeros(score.shape, bool)
        alive[rows, cols] = True
        assert alive[score >= floor[:, None]].all()


def test_search_over_blocks_with_rising_thresholds():
    rng = np.random.default_rng(6)
    x = rng.integers(-30, 30, (700, 16))
    p = T.TopK(k=7, strip=9)
    blocks = [side(x[a : a + 60], a) for a in range(0, 700, 60)]
    at, ids, score = T.search(side(x[:40]), blocks, np.full(40, -np.inf), p)
    full = T.exact(x[:40], x)
    for i in range(40):
        want = sorted((-int(full[i, j]), j) for j in range(700) if j != i)[:7]
        assert sorted(zip((-score[at == i]).tolist(), ids[at == i].tolist())) == want
