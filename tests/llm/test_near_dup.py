import collections
import random

import pytest

from quillspark.llm import near_dup as N
from quillspark.llm.components import components
from quillspark.llm.store import Scratch
from tests.llm.helpers import edited, frame, odd, prose, words


def shingles(text, n=5):
    w = words(text, fold=True)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=85):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    held = collections.defaultdict(list)
    for i, s in sets.items():
        both = collections.Counter(j for x in s for j in held[x])
        for x in s:
            held[x].append(i)
        for j, n in both.items():
            if 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect() if r.doc_id is not None}


def corpus(seed):
    rng = random.Random(seed)
    rows, base = [], prose(rng, 150)
    for i in range(60):  # one large group whose members are alike to every degree
        rows.append((1000 + i, edited(rng, base, rng.randrange(12))))
    for i in range(40):  # chains: each a small edit of the one before
        rows.append((2000 + i, edited(rng, rows[-1][1] if i % 5 else prose(rng, 120), 2)))
    passage = prose(rng, 60)
    rows += [(3000 + i, prose(rng, 20) + " " + passage) for i in range(40)]  # a passage that many share
    rows += [(4000 + i, prose(rng, rng.randrange(1, 200))) for i in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("p", [N.NearDup(), N.NearDup(block=4, leader_rounds=1)])
def test_brute_force(spark, p):
    rows = corpus(3)
    assert got(N.near_duplicates(spark, frame(spark, rows), p)) == brute(rows)


def test_lower_threshold(spark):
    rows = corpus(4)
    assert got(N.near_duplicates(spark, frame(spark, rows), N.NearDup(threshold=80, bands=56, rows=6))) == brute(rows, 80)


def test_odd_rows(spark):
    rows = odd(random.Random(1))
    out = N.near_duplicates(spark, frame(spark, rows)).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is not None} == brute(rows)
    assert all(r.component_id is None and r.kept for r in out if r.doc_id is None)


def test_empty(spark):
    assert N.near_duplicates(spark, frame(spark, [])).count() == 0


def test_keep_one_keeps_columns(spark):
    docs = frame(spark, odd(random.Random(2)))
    out = N.keep_one(spark, docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert 6 not in kept and 5 in kept and 12 not in kept and kept.count(None) == 2


def test_keep_one_folds_repeated_rows(spark):
    text = prose(random.Random(7), 30)
    rows = [(1, text), (1, text), (2, text), (3, ""), (3, ""), (None, text), (None, text), (None, None), (None, None), (4, "a b"), (4, "a b")]
    out = N.keep_one(spark, frame(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, text), (3, ""), (3, ""), (None, text), (None, None), (None, None), (4, "a b")], key=str)
    assert N.keep_one(spark, frame(spark, [])).count() == 0


def test_blocks_of_one_component_do_not_meet(spark):
    p = N.NearDup(block=4)
    rows = [(1, i, 100, 10) for i in range(20)] + [(1, 50 + i, 50 + i, 10) for i in range(3)]
    here = spark.createDataFrame(rows, "bucket long, rep long, comp long, n long")
    got_ = N._blocks(here, p, Scratch(spark, "t")).collect()
    met = collections.defaultdict(set)
    for r in got_:
        met[r.i, r.j].add(r.rep)
    pairs = {frozenset((a, b)) for reps in met.values() for a in reps for b in reps if a != b}
    assert all(frozenset((a, b)) in pairs for a in range(20) for b in range(50, 53)) and all(frozenset((a, b)) in pairs for a in range(50, 53) for b in range(50, 53) if a != b)
    assert max(sum(r.rep == x for r in got_) for x in range(20)) == 1


def test_recall_just_above_the_threshold(spark):
    rng, rows, want = random.Random(9), [], 0
    for i in range(600):
        base = [f"w{rng.randrange(10**6)}" for _ in range(124)]
        other = list(base)
        for place in (30, 90):
            other[place] = f"x{i}"  # ten of 120 shingles of each change: 110 / 130 = 0.846, or one edit: 115 / 125
        if i % 2:
            other[90] = base[90]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        want += i % 2
    out = got(N.near_duplicates(spark, frame(spark, rows)))
    assert sum(out[2 * i + 1][1] == 2 * i for i in range(600)) == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (3, 2)]
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert out == {i: top(i) for a, b in edges if a != b for i in (a, b)}
