"""Vectorised words, word hashes and shingles over Arrow string buffers.

Every text operator of this subpackage sees words the same way: maximal runs of bytes other than
space and 0x09-0x0D.  A word's identity is a 64-bit polynomial hash over a table of random byte
values, so a batch of texts is split and hashed in a few numpy passes without making Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 2 << 20
#: Bytes hashed with one table of powers; longer words grow the table.
_BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240117))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = int(_rng.integers(2**61, 2**62)) * 2 + 1
_P_INV = pow(_P, -1, 1 << 64)
_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit of ``x`` over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) <= n:
        size = max(n + 1, _BLOCK + 1)
        for name, base in (("up", _P), ("down", _P_INV)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _tables[name] = np.multiply.accumulate(table)
    return _tables["up"], _tables["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``; spans are sorted and may overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        stop = int(np.searchsorted(ends, lo + _BLOCK, side="right"))
        stop = max(stop, at + 1)
        hi = int(ends[stop - 1])
        up, down = _powers(hi - lo)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * down[: hi - lo], out=sums[1:])
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        out[at:stop] = (sums[e] - sums[s]) * up[s]
        at = stop
    return mix(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw, off - off[0] if len(off) else np.zeros(1, dtype=np.int64)


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most ``limit`` bytes of text, or of one row."""
    if not batch.num_rows:
        return
    _, off = text_buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


class Words:
    """The words of a column of texts.

    ``starts`` and ``ends`` are byte offsets into ``data``; ``first[i]:first[i + 1]`` are the words of
    row ``i``; ``hashes`` identifies each word, ASCII letters folded when ``fold`` is set.
    """

    def __init__(self, column: pa.Array, fold: bool) -> None:
        self.data, self.offsets = text_buffers(column)
        n = len(self.data)
        inside = ~SPACE[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        self.starts = np.flatnonzero(begins)
        finishes = inside.copy()
        if n:
            finishes[:-1] &= ~inside[1:] | edge[1:n]
        self.ends = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        if fold:
            self.data = LOWER[self.data]
        self.hashes = span_hashes(self.data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int) -> bytes:
        """The bytes of word ``i``."""
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive entries, rows disregarded: one for each start."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    while len(_MULT) < n:
        raise ValueError(f"grams of {n} words are longer than {len(_MULT)}")
    total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for j in range(n):
        total += hashes[j : len(hashes) - n + 1 + j] * _MULT[j]
    return mix(total)
