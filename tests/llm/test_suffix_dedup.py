import hashlib
import random

import numpy as np
import pytest

from quillspark.llm import suffix_dedup as S
from tests.llm.helpers import frame, odd, prose, words


def brute(rows, window):
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect() if r.doc_id is not None}


def corpus(seed):
    rng = random.Random(seed)
    shared = [prose(rng, 40, 2000) for _ in range(4)]
    rows = []
    for i in range(80):
        parts = [prose(rng, rng.randrange(30), 2000)]
        for _ in range(rng.randrange(3)):
            w = rng.choice(shared).split()
            a = rng.randrange(30)
            parts += [" ".join(w[a : a + rng.randrange(40)]), prose(rng, rng.randrange(10), 2000)]
        rows.append((i * 3 % 83, "\n".join(parts)))
    return [*rows, (200, rows[5][1]), (201, rows[5][1]), (202, "q " * 60)]


@pytest.mark.parametrize("p", [S.SuffixDedup(window=8, gram=3), S.SuffixDedup(window=8, gram=3, part=2, broadcast_values=0), S.SuffixDedup(window=5, gram=5, symbols=5, part=1), S.SuffixDedup(window=50)])
def test_brute_force(spark, p):
    rows = corpus(1)
    assert got(S.dedup_passages(spark, frame(spark, rows), p)) == brute(rows, p.window)


def test_odd_rows(spark):
    rows = odd(random.Random(1))
    out = S.dedup_passages(spark, frame(spark, rows)).collect()
    assert len(out) == len(rows)
    want = brute(list(dict.fromkeys(rows)), 50)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out if r.doc_id is not None} == want
    assert sum(r.n_removed for r in out if r.doc_id is None) == 0


def test_empty(spark):
    assert S.dedup_passages(spark, frame(spark, [])).count() == 0


def test_cut_keeps_columns_and_clean_texts(spark):
    rows = corpus(2)
    docs = frame(spark, rows)
    p = S.SuffixDedup(window=8, gram=3)
    out = S.cut_passages(spark, docs, p)
    assert out.columns == docs.columns
    want = brute(rows, 8)
    texts = dict(rows)
    for r in out.collect():
        n, removed, sha = want[r.doc_id]
        assert r.text == texts[r.doc_id] if not removed else hashlib.sha256(r.text.encode()).hexdigest() == sha
        assert r.n_chars is None if not removed else r.n_chars == len(r.text)


def test_runs_and_cover():
    rng = np.random.default_rng(1)
    for _ in range(50):
        starts = rng.integers(0, 40, rng.integers(0, 20))
        want = np.zeros(47, bool)
        for s in starts:
            want[s : s + 8] = True
        assert (S.covered(47, S.runs(starts), 8) == want).all()
