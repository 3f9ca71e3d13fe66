import itertools
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import bpe, packing
from quillspark.llm import words as W
from tests.llm.helpers import frame, odd, prose

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
TRICKY = ["", "<|endoftext|> a<|startoftext|>b", "DON'T we'll x'd  ''s it's 123 4a5", "İstanbul ΑΣ ΣΑΣ ǅ ß ﬁ é é 日本 x　y \x1c z", "aaaaaaaaaaaaa aaaa bbbbbb ,,,,!!!! ......", "🙂 🙂🙂 a🙂b", "a\u0085b   c d", "×÷ ÀÖØ ÿ ı İ"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library():
    t, rng = library(), random.Random(1)
    texts = TRICKY + ["".join(rng.choice("abcdefgh ,.'éñ!X9\n") for _ in range(300)) for _ in range(60)]
    got = bpe.document_ids(pa.array(texts), PATH)
    assert [x.tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def check(spark, rows, capacity=64):
    t = library()
    out = packing.pack(spark, frame(spark, rows), packing.Packing(PATH, capacity=capacity), keep_ids=True).collect()
    want = []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, k, s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == Counter(want)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)
    full = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full[r.sequence_id]
        full[r.sequence_id] += r.length
    assert not full or max(full.values()) <= capacity
    return len(full), sum(w[3] for w in want) / capacity


def test_round_trip_and_few_sequences(spark):
    rng = random.Random(2)
    n, least = check(spark, [(i, prose(rng, rng.randrange(1, 60))) for i in range(300)])
    assert n <= least * 1.01 + 1


def test_odd_rows(spark):
    check(spark, [*odd(random.Random(1)), *enumerate(TRICKY, 100)], 2048)


def test_empty(spark):
    assert packing.pack(spark, frame(spark, []), packing.Packing(PATH)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    cap = 100
    lengths = Counter(min(cap, int(rng.paretovariate(0.5))) if seed % 2 else rng.randrange(1, cap + 1) for _ in range(2000))
    s = packing.plan(lengths, cap)
    used, fill = Counter(), Counter()
    for length, a, b, q, off in zip(*(s[k].tolist() for k in ("length", "number", "until", "sequence", "offset"))):
        for i in range(a, b):
            used[length, i] += 1
            fill[q + i - a] += length
            assert off + length <= cap
    assert used == Counter({(x, i): 1 for x, n in lengths.items() for i in range(n)})
    assert max(fill.values()) <= cap and len(fill) == s["sequences"][0]
    assert len(fill) <= sum(k * v for k, v in lengths.items()) / cap * 1.02 + 1


def test_plan_prefers_exact_complements():
    s = packing.plan({60: 5, 40: 5, 30: 4, 70: 2, 50: 3, 20: 3}, 100)
    assert s["sequences"][0] == (300 + 200 + 120 + 140 + 150 + 60 + 99) // 100


def fewest(lengths, cap):
    """The fewest sequences, by trying the place of every piece."""
    best = len(lengths)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in sorted(set(bins)):
            if k + lengths[i] <= cap:
                rest = list(bins)
                rest[rest.index(k)] += lengths[i]
                put(i + 1, rest)
        put(i + 1, [*bins, lengths[i]])

    put(0, [])
    return best


def test_small_cases_against_the_optimum():
    rng, more = random.Random(11), 0
    for _ in range(120):
        lengths = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))), reverse=True)
        n = int(packing.plan(Counter(lengths), 20)["sequences"][0])
        best = fewest(lengths, 20)
        assert best <= n <= best + 1
        more += n > best
    assert more <= 6


def test_sums_know_what_is_available():
    rng = random.Random(12)
    for _ in range(40):
        left = [0] + [rng.randrange(3) if rng.random() < 0.4 else 0 for _ in range(24)]
        sums = packing.Sums(left)
        while any(left):
            total = rng.randrange(1, 25)
            found = sums.exact(total)
            ways = [c for n in (1, 2, 3) for c in itertools.combinations_with_replacement(range(1, 25), n) if sum(c) == total and all(left[x] >= k for x, k in Counter(c).items())]
            assert (found is None) == (not ways) and (not ways or len(found) == min(map(len, ways)) and sum(found) == total)
            for x in found or [next(i for i, n in enumerate(left) if n)]:
                left[x] -= 1
            assert min(left) >= 0


def peak(work) -> int:
    """Bytes that ``work`` takes at once, besides what was held before."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_new_words_leave_known_ones_in_place():
    t, rng = bpe.WordBPE(PATH), random.Random(3)
    many = ["".join(rng.choices("bcdfghjkqvxz0123", k=24)) for _ in range(20_000)]
    t.encode(W.Words(pa.array([" ".join(many)]), fold=False))
    assert peak(lambda: t.encode(W.Words(pa.array(["a few new words"]), fold=False))) < 10 * len(t.ids)
    again = many[:50] + ["new", "words", "unseen"] + many[-50:]
    ids, sizes = t.encode(W.Words(pa.array([" ".join(again)]), fold=False))
    whole = library()
    want = [whole.encode(x, add_special_tokens=False).ids for x in again]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == list(itertools.chain(*want))


def test_large_batches_are_packed_in_small_parts():
    rng = random.Random(4)
    text = prose(rng, 60_000)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [text] * 40})
    pieces = packing._pieces(packing.Packing(PATH), False)
    small = list(pieces(iter([batch.slice(0, 1)])))
    found: list = []
    # all at once took 231 MB
    assert batch.nbytes > 7 << 20 and peak(lambda: found.extend(x.num_rows for x in pieces(iter([batch])))) < 120 << 20
    assert sum(found) == 40 * sum(x.num_rows for x in small)
