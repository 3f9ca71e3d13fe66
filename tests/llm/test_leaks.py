import random
import re
import resource
import tracemalloc

import numpy as np
import pyarrow as pa

from quillspark.llm import leaks as L
from tests.llm.helpers import frame, odd, prose


def folded(text):
    return re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", (text or "").translate({c: c + 32 for c in range(65, 91)})).strip()


def points(text):
    return np.array([ord(c) for c in text], dtype=np.uint32)


def distance(item: str, text: str) -> int:
    """Fewest edits of ``item`` against any part of ``text``, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def corpus(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randrange(4, 40), 3000)) for i in range(25)] + [(90, None), (None, "x y"), (91, "ab")]
    rows = [(1000 + i, prose(rng, 60, 3000)) for i in range(30)]
    for i, t in items[:25]:
        for k, share in enumerate((0, 0.04, 0.09, 0.12, 0.3)):
            s = list(t)
            for _ in range(int(len(s) * share)):
                q = rng.randrange(len(s))
                s[q : q + rng.randrange(2)] = rng.choice(["", "z", "yy"])
            rows.append((i * 10 + k, f"{prose(rng, 30, 3000)} {''.join(s)} {prose(rng, 30, 3000)}"))
    rows += [(5000, items[3][1].upper().replace(" ", "  ,\n")), (5001, f"{items[4][1]} {items[4][1]}")]
    return items, rows


def test_brute_force(spark):
    items, rows = corpus(1)
    out = L.leaks(spark, frame(spark, rows), frame(spark, items, "item_id")).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in out}
    want = {}
    for i, t in items:
        goal = folded(t)
        if i is None or len(goal) < 20:
            continue
        for d, text in rows:
            if (n := distance(goal, folded(text))) <= int(len(goal) * 0.1):
                want[d, i] = n
    assert got == want
    texts, goals = dict(rows), dict(items)
    for r in out:
        part = texts[r.doc_id].encode()[r.start : r.end].decode()
        assert distance(folded(part), folded(goals[r.item_id])) <= r.edits


def test_blocks_of_the_index(spark):
    items, rows = corpus(2)
    docs, bench = frame(spark, rows), frame(spark, items, "item_id")
    one, many = (sorted(map(tuple, L.leaks(spark, docs, bench, p).collect())) for p in (L.Leaks(), L.Leaks(block=200, chunk=500)))
    assert one == many and one


def test_odd_rows_and_empty(spark):
    rows = odd(random.Random(1))
    items = [(1, rows[4][1][:100]), (2, None), (3, ""), (None, "q" * 50), (4, "x" * 300)]
    got = {(r.doc_id, r.item_id) for r in L.leaks(spark, frame(spark, rows), frame(spark, items, "item_id")).collect()}
    assert got == {(5, 1), (6, 1), (9, 4)}
    assert L.leaks(spark, frame(spark, []), frame(spark, items, "item_id")).count() == 0
    assert L.leaks(spark, frame(spark, rows), frame(spark, [], "item_id")).count() == 0


def test_without_leaks_keeps_columns(spark):
    items, rows = corpus(3)
    docs = frame(spark, rows)
    out = L.without_leaks(spark, docs, frame(spark, items, "item_id"))
    kept = {r.doc_id for r in out.collect()}
    found = {r.doc_id for r in L.leaks(spark, docs, frame(spark, items, "item_id")).collect()}
    assert out.columns == docs.columns and kept == {i for i, _ in rows} - found
    assert kept and not kept & {i * 10 for i, t in items[:25] if len(folded(t)) >= 20}


def test_align():
    rng = random.Random(4)
    for _ in range(60):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 12)))
        b = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 20)))
        n, s, e = L.align(points(a), points(b), 99)
        assert n == distance(a, b) and 0 <= s <= e <= len(b) and distance(a, b[s:e]) == n


def test_align_in_a_band_of_diagonals():
    rng = random.Random(6)
    for _ in range(60):
        a = "".join(rng.choice("abcd") for _ in range(30))
        b = list(a)
        for _ in range(3):
            b[rng.randrange(30) : rng.randrange(30)] = rng.choice(["", "x", "yz"])
        text = "".join(rng.choice("abcd") for _ in range(40)) + "".join(b) + "".join(rng.choice("abcd") for _ in range(40))
        best = distance(a, text)
        assert L.within(points(a), points(text), best, -30, len(text)) and not L.within(points(a), points(text), best - 1, -30, len(text))
        if best <= 6:
            assert min(L.align(points(a), points(text), 6, d, d + 12)[0] for d in range(-30, len(text), 3)) == best


def test_fold_places():
    texts = ["  A,b!! É ", "", None, "x", "日😀 b"]
    raw, offsets = L.W.text_buffers(pa.array(texts))
    t = L.fold(raw, offsets)
    assert ["".join(map(chr, t.points[a:b])) for a, b in zip(t.edges[:-1], t.edges[1:])] == ["a b É ", "", "", "x", "日😀 b"]
    assert bytes(raw[t.place])[:1] == b"A" and t.width.tolist() == [1, 1, 1, 1, 2, 1, 1, 3, 4, 1, 1]


def test_edits_are_characters(spark):
    rng = random.Random(8)
    item = "".join(rng.choice("éàüßñ日本語 ab") for _ in range(130))
    rows, want = [], {}
    for i in range(40):
        t = list(item)
        for place in rng.sample(range(130), i % 16):
            t[place] = rng.choice("øå漢字ık")
        text = "".join(rng.choice("éàüßñ ab") for _ in range(60)) + "".join(t) + " ende"
        rows.append((i, text))
        if (n := distance(folded(item), folded(text))) <= len(folded(item)) // 10:
            want[i] = n
    got = {r.doc_id: r for r in L.leaks(spark, frame(spark, rows), frame(spark, [(1, item)], "item_id")).collect()}
    assert {i: r.edits for i, r in got.items()} == want and len(want) > 20
    for i, r in got.items():
        assert distance(folded(item), folded(rows[i][1].encode()[r.start : r.end].decode())) <= r.edits


def test_repeated_grams_do_not_multiply():
    p = L.Leaks()
    near = "ab" * 150 + "abxab" + "ab" * 100
    index = L.build([(1, "ab" * 400), (2, near)], p)
    text = "ab" * 20_000 + "cd" * 50 + near.replace("x", "y") + "cd" * 50
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = {i: n for _, i, n, _, _ in L.find(pa.array([text, "ba" * 1_000_000]), index, p)}
    assert found[1] == 0 and found[2] == 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    small = L.Leaks(hits=50, diagonals=40)
    assert sorted(L.find(pa.array([text[-2000:], "zz " + near]), L.build([(2, near)], small), small)) == sorted(L.find(pa.array([text[-2000:], "zz " + near]), L.build([(2, near)], p), p))


def test_short_items_match_exactly_on_word_edges(spark):
    items = [(1, "Red fox"), (2, "fox"), (3, "a"), (4, "red  FOX!"), (5, "!?"), (6, "seventeen letters"), (7, "nineteen letters xy"), (8, "日本"), (8, "fox")]
    docs = [(1, "the red-fox ran"), (2, "foxes are reddish"), (3, "A fox"), (4, "x" * 50 + " Seventeen, letters"), (5, "seventeen lettera nineteen letters xy"), (6, "日本 fox. fox"), (7, "seventeen"), (8, "letters"), (9, ""), (10, "nineteen Xetters xy"), (11, " fox"), (12, "red"), (13, "fox")]
    fold = lambda t: re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", t.lower()).strip()
    want = sorted((d, i) for d, t in docs for i, x in items if fold(x) and f" {fold(x)} " in f" {fold(t)} ")
    got = L.leaks(spark, frame(spark, docs), frame(spark, items, key="item_id"), L.Leaks(short=True)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == want and all(r.edits == 0 for r in got)
    text = dict(docs)
    assert all(fold(text[r.doc_id].encode()[r.start : r.end].decode()) in {fold(x) for i, x in items if i == r.item_id} for r in got)


def test_hashes_of_long_grams_take_two_words_a_byte():
    data = np.random.default_rng(1).integers(0, 256, 1 << 18, dtype=np.uint8)
    eights = L._eights(data)
    tracemalloc.start()
    try:
        got = L._hash_grams(data, 13, eights)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 17 * len(data)
    assert (got[:200] == [L._hash_grams(data[i : i + 13], 13)[0] for i in range(200)]).all()
