"""Token ids of a word-level BPE tokenizer for whole batches of texts.

The tokenizer drops white space and never merges across it, so the ids of a text are the ids of its
words in order.  Distinct words of a batch are looked up in a cache; the others are split into
pieces and all pieces are merged together, one merge of each piece a round, in numpy.  A word with
a character outside printable ASCII and Latin letters, or one that could hold a special token, is
given to the tokenizers library itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from quillspark.llm import words as W

# fixed values of the tokenizer's split; İ has a lower case of two characters
_PLAIN = regex.compile("[!-~À-įı-ɏ]+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_NONE = np.int64(1 << 40)


class WordBPE:
    """Ids by the tokenizer file at ``path``; ``most`` bounds the words that the cache holds."""

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.path, self.most, self._whole = path, most, None
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(visible)]
        letter = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.byte_id = np.array([vocab[letter[b]] for b in range(256)], dtype=np.int64)
        self.last_id = np.array([vocab[letter[b] + suffix] for b in range(256)], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        key = left << 20 | right
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.begin, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty pieces, flat, and the number of ids of each."""
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        size = np.array([len(x) for x in pieces], dtype=np.int64)
        sym = self.byte_id[data]
        stop = np.cumsum(size) - 1
        sym[stop] = self.last_id[data[stop]]
        owner = np.repeat(np.arange(len(pieces)), size)
        done_ids, done_owner = [], []
        rank = np.full(len(sym), _NONE)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._rank(sym[inner], sym[inner + 1])
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            least = np.minimum.reduceat(rank, start)
            count = np.diff(np.concatenate((start, [len(sym)])))
            wide = np.repeat(least, count)
            over = wide == _NONE
            if over.any():
                done_ids.append(sym[over])
                done_owner.append(owner[over])
                sym, owner, rank, wide = sym[~over], owner[~over], rank[~over], wide[~over]
                if not len(sym):
                    break
            hit = rank == wide
            # of overlapping pairs (a a a) every second one merges, from the left
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
            place = np.arange(len(at)) - np.repeat(at[run] - at[run] + run, np.diff(np.concatenate((run, [len(at)]))))
            at = at[place % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            new = (np.cumsum(keep) - 1)[at]
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            for x in (new, new[new > 0] - 1):
                after = np.minimum(x + 1, len(sym) - 1)
                rank[x] = np.where((x + 1 < len(sym)) & (owner[after] == owner[x]), self._rank(sym[x], sym[after]), _NONE)
        ids, own = np.concatenate(done_ids or [sym]), np.concatenate(done_owner or [owner])
        order = np.argsort(own, kind="stable")
        return ids[order].astype(np.int32), np.bincount(own, minlength=len(pieces))

    def _whole_word(self, word: str) -> list[int]:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole.encode(word, add_special_tokens=False).ids

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, flat, and the number of ids of each."""
        place: dict[str, int] = {}
        parts: list[int] = []
        many = np.zeros(len(words), dtype=np.int64)
        odd: dict[int, list[int]] = {}
        for i, raw in enumerate(words):
            word = raw.decode()
            if not _PLAIN.fullmatch(word) or "<|" in word:
                odd[i] = self._whole_word(word)
                continue
            found = _PIECES.findall(word.lower())
            many[i] = len(found)
            for x in found:
                parts.append(place.setdefault(x, len(place)))
        if place:
            flat, count = self.merge([x.encode() for x in place])
        else:
            flat, count = np.zeros(0, np.int32), np.zeros(0, np.int64)
        begin = np.concatenate(([0], np.cumsum(count)))
        used = np.array(parts, dtype=np.int64)
        ids, lengths = take(flat, begin, used), count[used] if len(used) else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(lengths)))
        edge = np.concatenate(([0], np.cumsum(many)))
        sizes = total[edge[1:]] - total[edge[:-1]]
        if odd:
            split = np.split(ids, np.cumsum(sizes)[:-1])
            for i, x in odd.items():
                split[i] = np.array(x, dtype=np.int32)
                sizes[i] = len(x)
            ids = np.concatenate(split).astype(np.int32)
        return ids, sizes

    def encode(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, flat, and the number of ids of each word."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        distinct, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self._clear()
        new = distinct if not len(self.known) else distinct[self.known[np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)] != distinct]
        if len(new):
            at = first[np.searchsorted(distinct, new)]
            raw = words.data.tobytes()
            ids, sizes = self._encode([raw[s:e] for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)])
            # ids are only added at the end, so that what is known already is not moved
            place = np.searchsorted(self.known, new)
            self.begin = np.insert(self.begin, place, len(self.ids) + np.cumsum(sizes) - sizes)
            self.size = np.insert(self.size, place, sizes)
            self.known = np.insert(self.known, place, new)
            self.ids = np.concatenate((self.ids, ids))
        rows = np.searchsorted(self.known, distinct)[inverse]
        return runs(self.ids, self.begin[rows], self.size[rows]), self.size[rows]


def runs(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``flat[b:b + n]`` of ``begin`` and ``size``, one after the other."""
    if not len(begin):
        return flat[:0]
    end = np.cumsum(size)
    at = np.repeat(begin - (end - size), size)
    at += np.arange(len(at))
    return flat[at]


def take(flat: np.ndarray, begin: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The runs ``flat[begin[r]:begin[r + 1]]`` of ``rows``, one after the other."""
    return runs(flat, begin[rows], begin[rows + 1] - begin[rows]) if len(rows) else flat[:0]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBPE:
    """One tokenizer and cache for each Python worker."""
    return WordBPE(path)


def document_ids(column: pa.Array, path: str) -> list[np.ndarray]:
    """The ids of each text; nulls are empty."""
    words = W.Words(column, fold=False)
    ids, sizes = tokenizer(path).encode(words)
    edge = np.concatenate(([0], np.cumsum(sizes)))[words.first]
    return [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
