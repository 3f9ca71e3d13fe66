import random

import pyarrow as pa
import pytest

from quillspark.llm import unigram as U
from tests.llm.helpers import frame, odd, prose

public = pytest.importorskip("public_tokenizers")
P = U.Unigram(public.path("piece_bpe_32k.model"))
TRICKY = ["", " ", "   ", "a", "🙂🙂 a  b   c ", "日本語 テキスト\n\n x\ty", "▁▁a ▁ b", "<s> </s> <0x41>", "<unk> a<unk>b", "x<s>y </s>z<0x41><0xE2>", "é́ ́", "aaaaaaaaaaaaaaaaaaaaaaaaa", "▁x", "门梦\x00 龘龘a", "a" + " " * 70 + "b"]


def library(pieces):
    from tokenizers import Tokenizer, models, normalizers

    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(U.MARK), normalizers.Replace(" ", U.MARK)])
    return t


def test_counts_equal_the_library():
    rng = random.Random(1)
    texts = TRICKY + ["".join(rng.choice("abcdeéñ日🙂 .,\n▁XY0") for _ in range(rng.randrange(120))) for _ in range(200)]
    t = library(U.vocabulary(P.model))
    assert U.counter(P).texts(pa.array(texts)).tolist() == [len(t.encode(x).ids) for x in texts]


def test_ties_and_unknowns_equal_the_library():
    rng = random.Random(2)
    table = [("<unk>", 0.0), (U.MARK, -1.0), *[(f"<0x{b:02X}>", -1.0) for b in range(256)]]
    table += [(x, float(-rng.randrange(1, 4))) for x in ("a", "b", "ab", "ba", "aa", "bab", "aba", U.MARK + "a", U.MARK + "ab", U.MARK + U.MARK)]
    t, c = library(table), U.Counter(table, 10**6)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(30))) for _ in range(500)]
    assert c.texts(pa.array(texts)).tolist() == [len(t.encode(x).ids) for x in texts]


def test_memory_is_bounded():
    rng = random.Random(3)
    texts = [prose(rng, 50) for _ in range(20)]
    small = U.Counter(U.vocabulary(P.model), 10)
    assert [small.texts(pa.array([x]))[0] for x in texts] == U.counter(P).texts(pa.array(texts)).tolist()


def test_odd_rows_and_empty(spark):
    rows = odd(random.Random(1))
    t = library(U.vocabulary(P.model))
    out = U.token_counts(spark, frame(spark, rows), P).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    short = [(i, x) for i, x in rows if len(x or "") < 10_000]
    want = sorted(((i, len((x or "").encode()), len(t.encode(x or "").ids)) for i, x in short), key=key)
    assert len(out) == len(rows) and sorted((tuple(r) for r in out if r.n_bytes < 10_000), key=key) == want
    assert U.token_counts(spark, frame(spark, []), P).count() == 0
