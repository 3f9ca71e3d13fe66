"""Benchmark decontamination by the q-gram lemma.

A document holds a benchmark item if one of its passages is within ``rate`` of the item's length in
edits, a character each.  If m characters meet a passage with k edits, they share at least
m + 1 - q (k + 1) q-grams, and all of these lie in a band of k + 1 neighbouring diagonals.  So:

1. The q-grams of the whole of each text are looked up in an index of all items.  Places in the text that
   share a q-gram with an item count once each; areas where places within the length of a passage reach
   the bound are kept.
2. There a hit has a diagonal, its place in the text less its place in the item.  Diagonals are cut into
   bands of 2 (k + 1) that overlap by half, so any k + 1 neighbours lie in one; bands whose hits within the
   length of a passage reach the bound are kept.  Where q-grams repeat so often that hits would outnumber
   ``hits``, all diagonals of the area are kept instead, which loses nothing.
3. The item is aligned within the kept diagonals alone; the fewest edits and their span stay.

Texts are compared folded: ASCII letters in lower case, each run of other ASCII characters one space,
characters beyond ASCII as they are.  Items of under ``least`` folded characters have no edit budget: if
asked for, they match as they are, on word edges.
The index of items goes to every task in blocks of bounded size; a benchmark of more blocks takes as
many passes over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.store import small_batches, unused


@dataclass(frozen=True)
class Leaks:
    #: Edits allowed, as a share of the item's folded length.
    rate: float = 0.1
    #: The longest q-gram; an item takes the longest for which the lemma still asks for a hit.
    gram: int = 10
    #: Items of fewer folded characters are too short for edits; they are left out, or, with ``short``, match
    #: as they are between word edges.
    least: int = 20
    short: bool = False
    #: Bytes of items in one block of the index.
    block: int = 4 << 20
    #: Hits of a text and an item that are held at once, and diagonals that are aligned at once.
    hits: int = 1 << 19
    diagonals: int = 1 << 14
    #: Bytes of text that are matched at once.
    chunk: int = 2 << 20


_FOLD = W.LOWER[:128].copy()
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


@dataclass
class Folded:
    """Folded characters of texts, one after the other.

    ``edges`` are those of each text; ``place`` and ``width`` are where a character came from and its
    bytes there; ``small`` is a byte for each character, the same one for the same character.
    """

    points: np.ndarray
    edges: np.ndarray
    place: np.ndarray
    width: np.ndarray

    def __post_init__(self) -> None:
        self.small = (self.points ^ (self.points >> np.uint32(7)) ^ (self.points >> np.uint32(13))).astype(np.uint8)


def fold(data: np.ndarray, offsets: np.ndarray) -> Folded:
    """The UTF-8 bytes of texts, folded."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.diff(np.append(starts, len(data))).astype(np.int8)
    points = data[starts].astype(np.uint32)
    ascii_ = points < 128
    points[ascii_] = _FOLD[points[ascii_]]
    many = np.flatnonzero(width > 1)
    if len(many):
        at, n = starts[many], width[many]
        value = points[many] & (np.uint32(0xFF) >> (n + 1).astype(np.uint32))
        for k in (1, 2, 3):
            here = n > k
            value[here] = value[here] << np.uint32(6) | (data[at[here] + k] & 0x3F)
        points[many] = value
    space = points == 0x20
    keep = ~space
    keep[1:] |= ~space[:-1]
    first = np.searchsorted(starts, offsets)
    begin = first[:-1][first[:-1] < len(points)]
    keep[begin] = ~space[begin]
    kept = np.flatnonzero(keep)
    return Folded(points[kept], np.searchsorted(kept, first), starts[kept], width[kept])


@dataclass
class Index:
    """Items of a block, and for each length of q-grams: sorted keys, the items that hold each, and a bitmap of keys."""

    ids: list[int]
    texts: list[Folded]
    edits: np.ndarray
    grams: np.ndarray
    bound: np.ndarray
    by_q: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    #: By length of short items: their hashes, sorted, with ids and characters.
    short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)


def _eights(data: np.ndarray) -> np.ndarray:
    """Each run of eight bytes as one word, by doubling."""
    out = data.astype(np.uint64)
    for step in (1, 2, 4):
        if len(out) <= step:
            return out[:0]
        high = out[:-step] << np.uint64(8 * step)
        high |= out[step:]
        out = high
    return out


def _hash_grams(data: np.ndarray, q: int, eights: np.ndarray | None = None) -> np.ndarray:
    """A hash of each run of ``q`` bytes; ``eights`` are the runs of eight, if they are known."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if q < 8:
        out = np.zeros(n, np.uint64)
        for j in range(q):
            out = (out << np.uint64(8)) | data[j : j + n]
        return out * np.uint64(0x9E3779B97F4A7C15)
    eights = _eights(data) if eights is None else eights
    out = eights[:n] * np.uint64(0x9E3779B97F4A7C15)
    if q > 8:  # the last eight bytes overlap the first; together they are the whole run
        out ^= out >> np.uint64(29)
        out += eights[q - 8 : q - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
        out *= np.uint64(0x9E3779B97F4A7C15)
    return out


_TABLE_BITS = 22


def _item(text: str) -> Folded:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    out = fold(raw, np.array([0, len(raw)]))
    n = len(out.points)
    while n and out.points[n - 1] == 0x20:
        n -= 1
    return Folded(out.points[:n], np.array([0, n]), out.place[:n], out.width[:n])


def build(items: list[tuple[int, str]], p: Leaks) -> Index:
    """The index of a block of items; those under ``least`` folded characters are apart, or left out."""
    ids, texts = [], []
    short: dict[int, list[tuple[int, Folded]]] = {}
    for i, text in items:
        folded = _item(text)
        if len(folded.points) >= p.least:
            ids.append(i)
            texts.append(folded)
        elif len(folded.points) and p.short:
            short.setdefault(len(folded.points), []).append((i, folded))
    size = np.array([len(t.points) for t in texts], dtype=np.int64)
    edits = np.floor(size * p.rate).astype(np.int64)
    grams = np.minimum(p.gram, size // (edits + 1))
    index = Index(ids, texts, edits, grams, size + 1 - grams * (edits + 1))
    for q in np.unique(grams).tolist():
        mine = np.flatnonzero(grams == q)
        each = [np.unique(_hash_grams(texts[k].small, q)) for k in mine.tolist()]
        h, item = np.concatenate(each), np.repeat(mine, [len(g) for g in each])
        order = np.argsort(h, kind="stable")
        h, item = h[order], item[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        table[h >> np.uint64(64 - _TABLE_BITS)] = True
        index.by_q[q] = (h[first], np.append(first, len(h)), item.astype(np.int32), table)
    for n, found in short.items():
        h = np.concatenate([_hash_grams(t.small, n) for _, t in found])
        order = np.argsort(h, kind="stable")
        index.short[n] = (h[order], np.array([i for i, _ in found])[order], np.stack([t.points for _, t in found])[order])
    return index


def align(item: np.ndarray, text: np.ndarray, most: int, first: int | None = None, last: int | None = None) -> tuple[int, int, int]:
    """Fewest edits of ``item`` against any part of ``text`` within diagonals ``first`` to ``last``, and that part's edges.

    The parts start and end freely; a cost over ``most`` is given as ``most + 1``.  A row of the table is
    one character of the item and holds the band's diagonals, so insertions are a running minimum.
    Characters before and after the text differ from all others, which costs as much as leaving the
    item's out.
    """
    m, n = len(item), len(text)
    first, last = max(-m, -m if first is None else first), min(n, n if last is None else last)
    step = np.arange(last - first + 1, dtype=np.int64)
    around = np.full(n + 2 * m + 1, 0xFFFFFFFF, dtype=np.uint32)
    around[m : m + n] = text
    cost, begin = np.zeros(len(step), dtype=np.int64), step + first
    for i, letter in enumerate(item.tolist()):
        change = cost + (around[m + first + i : m + last + i + 1] != letter)
        skip = np.append(cost[1:], most + m) + 1
        take = change <= skip
        new, source = np.where(take, change, skip), np.where(take, begin, np.append(begin[1:], n))
        low = np.minimum.accumulate(new - step)
        at = np.maximum.accumulate(np.where(new - step == low, step, 0))
        cost, begin = low + step, source[at]
        if cost.min() > most:
            return most + 1, 0, 0
    end = int(np.argmin(cost))
    return int(min(cost[end], most + 1)), int(np.clip(begin[end], 0, n)), int(np.clip(first + end + m, 0, n))


def within(item: np.ndarray, text: np.ndarray, most: int, first: int, last: int) -> bool:
    """Whether some part of ``text`` within diagonals ``first`` to ``last`` is at most ``most`` edits from ``item``.

    The table of ``align`` without places: costs are kept less the number of their diagonal, so an
    insertion costs nothing and an omission two.
    """
    m, n = len(item), len(text)
    first, last = max(-m, first), min(n, last)
    if first > last:
        return False
    step = np.arange(last - first + 1, dtype=np.int32)
    around = np.full(n + 2 * m + 1, 0xFFFFFFFF, dtype=np.uint32)
    around[m : m + n] = text
    change = np.lib.stride_tricks.sliding_window_view(around[m + first : 2 * m + last], len(step)) != item[:, None]
    cost = -step
    for i in range(m):
        new = cost + change[i]
        np.minimum(new[:-1], cost[1:] + 2, out=new[:-1])
        cost = np.minimum.accumulate(new, out=new)
        if i % 16 == 15 and (cost + step).min() > most:
            return False
    return bool((cost + step).min() <= most)


def _bands(pos: np.ndarray, inside: np.ndarray, size: int, k: int, q: int, bound: int, widest: int) -> Iterator[tuple[int, int]]:
    """Diagonals, first and last, of neighbouring bands that have ``bound`` hits within a passage.

    Q-grams that edits leave alone have places of their own in the text and in the item, so a place
    counts once, however many hits it has.
    """
    half = k + 1
    diag = (pos - inside) // half
    band = np.concatenate((diag, diag - 1))
    where, item = np.concatenate((pos, pos)), np.concatenate((inside, inside))
    order = np.lexsort((where, band))
    band, where, item = band[order], where[order], item[order]
    new = np.concatenate(([True], (band[1:] != band[:-1]) | (where[1:] != where[:-1])))
    one, place = band[new], where[new]
    if len(one) < bound:
        return
    # hits i and i + bound - 1 of one band, no further apart than in a passage
    near = (one[bound - 1 :] == one[: len(one) - bound + 1]) & (place[bound - 1 :] - place[: len(one) - bound + 1] <= size + k - q)
    now: tuple[int, int] | None = None
    for b in np.unique(one[: len(near)][near]).tolist():
        lo, hi = np.searchsorted(band, [b, b + 1])
        if len(np.unique(item[lo:hi])) < bound:
            continue
        # band b has diagonals b * half up to (b + 2) * half; edits lead at most k away from them
        first, last = b * half - k, (b + 2) * half + k
        if now and first <= now[1] and last - now[0] <= widest:
            now = (now[0], last)
        else:
            if now:
                yield now
            now = (first, last)
    if now:
        yield now


def _diagonals(hashes: np.ndarray, goal: Folded, q: int, k: int, bound: int, p: Leaks) -> Iterator[tuple[int, int]]:
    """Diagonals of a stretch of text, first and last, in which the item is to be aligned."""
    size = len(goal.points)
    grams = _hash_grams(goal.small, q)
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    lo = np.searchsorted(grams, hashes, side="left")
    count = np.searchsorted(grams, hashes, side="right") - lo
    pos = np.flatnonzero(count)
    n = count[pos]
    if (total := int(n.sum())) > p.hits:
        for d in range(int(pos[0]) - size, int(pos[-1]) + k + 1, p.diagonals):
            yield d - k, d + p.diagonals + k
    elif len(pos) >= bound:
        entry = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[pos], n)
        yield from _bands(np.repeat(pos, n), order[entry], size, k, q, bound, p.diagonals)


def _best(t: Folded, hashes: np.ndarray, text: tuple[int, int], areas: list[tuple[int, int]], goal: Folded, q: int, k: int, bound: int, p: Leaks) -> tuple[int, int, int] | None:
    """(edits, start, end) of the item's best match near the ``areas`` of a text, or None.

    An area has the first and the last place of q-grams that lie close enough; a match has all of its own in one.
    """
    size, wanted = len(goal.points), goal.small.tobytes()
    for first, last in areas:
        raw = t.small[first : last + q].tobytes()
        at = raw.find(wanted)
        while at >= 0 and not np.array_equal(t.points[first + at : first + at + size], goal.points):
            at = raw.find(wanted, at + 1)
        if at >= 0:
            return 0, first + at, first + at + size
    best = None
    for first, last in areas:
        for low, high in _diagonals(hashes[first : last + 1], goal, q, k, bound, p):
            # the text that these diagonals touch, so that a long text is not copied for each
            lo, hi = max(text[0], first + low), min(text[1], first + high + size + 1)
            if not within(goal.points, t.points[lo:hi], k, first + low - lo, first + high - lo):
                continue
            found = align(goal.points, t.points[lo:hi], k, first + low - lo, first + high - lo)
            if found[0] <= k and (best is None or found[0] < best[0]):
                best = (found[0], lo + found[1], lo + found[2])
    return best


def _find_short(t: Folded, eights: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, start, end) in folded characters of the first place where a text holds a short item between word edges."""
    points, edges = t.points, t.edges
    edge = np.ones(len(points) + 1, dtype=bool)
    edge[:-1] = points == 0x20
    ends = edge.copy()
    ends[edges] = True
    begins = np.concatenate(([True], edge[:-1]))
    begins[edges] = True
    starts = np.flatnonzero(begins[:-1] & ~edge[:-1])
    for n, (hashes, ids, texts) in index.short.items():
        pos = starts[starts + n <= len(points)]
        pos = pos[ends[pos + n]]
        row = np.searchsorted(edges, pos, side="right") - 1
        ok = pos + n <= edges[row + 1]
        pos, row = pos[ok], row[ok]
        if not len(pos):
            continue
        h = _hash_grams(t.small, n, eights)[pos]
        lo = np.searchsorted(hashes, h, side="left")
        count = np.searchsorted(hashes, h, side="right") - lo
        total = np.cumsum(count)
        item = np.arange(total[-1]) + np.repeat(lo - (total - count), count)
        pos, row = np.repeat(pos, count), np.repeat(row, count)
        same = (points[pos[:, None] + np.arange(n)] == texts[item]).all(axis=1)
        pos, row, item = pos[same], row[same], item[same]
        _, first = np.unique(row * len(ids) + item, return_index=True)
        for k in first.tolist():
            yield int(row[k]), int(ids[item[k]]), int(pos[k]), int(pos[k]) + n


def _joined(pair: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of the same pair that overlap as one, in order."""
    order = np.lexsort((lo, pair))
    pair, lo, hi = pair[order], lo[order], hi[order]
    if not len(pair):
        return pair, lo, hi
    number = np.cumsum(np.concatenate(([0], pair[1:] != pair[:-1])))
    reach = np.maximum.accumulate(number * (1 << 40) + hi)
    new = np.flatnonzero(np.concatenate(([True], number[1:] * (1 << 40) + lo[1:] > reach[:-1])))
    return pair[new], lo[new], reach[np.append(new[1:] - 1, len(pair) - 1)] & ((1 << 40) - 1)


def _areas(pos: np.ndarray, row: np.ndarray, key: np.ndarray, first: np.ndarray, items: np.ndarray, q: int, index: Index, most: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(row, item, areas): first and last places where a text has as many places close together as the item's bound asks.

    Places are paired with items ``most`` at a time, each time from so far back that no passage is cut.
    """
    many, size = len(index.ids), np.array([len(t.points) for t in index.texts], dtype=np.int64)
    near = size + index.edits - q
    count = first[key + 1] - first[key]
    total = np.cumsum(count)
    found: tuple[list, list, list] = ([], [], [])
    at = 0
    while at < len(key):
        stop = max(at + 1, int(np.searchsorted(total, total[at] - count[at] + most, side="right")))
        begin = int(np.searchsorted(pos, pos[at] - near.max()))
        n = count[begin:stop]
        entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[key[begin:stop]], n)
        pair, where = np.repeat(row[begin:stop], n) * many + items[entry], np.repeat(pos[begin:stop], n)
        order = np.argsort(pair, kind="stable")
        pair, where = pair[order], where[order]
        item = pair % many
        # a place and the one that is bound - 1 further on, of one text and item, no further apart than in a passage
        last = np.arange(len(pair)) + index.bound[item] - 1
        here = np.flatnonzero(last < len(pair))
        ok = (pair[last[here]] == pair[here]) & (where[last[here]] - where[here] <= near[item[here]])
        here = here[ok]
        for out, v in zip(found, _joined(pair[here], where[here], where[last[here]]), strict=True):
            out.append(v)
        at = stop
    pair, lo, hi = _joined(*(np.concatenate(x) for x in found))
    edges = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1], [True]))) if len(pair) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield (*divmod(int(pair[a]), many), list(zip(lo[a:b].tolist(), hi[a:b].tolist(), strict=True)))


def find(column: pa.Array, index: Index, p: Leaks) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, edits, byte start, byte end) of the best match of each item that a text holds."""
    raw, offsets = W.text_buffers(column)
    t = fold(raw, offsets)
    eights = _eights(t.small)

    def span(r: int, start: int, end: int) -> tuple[int, int]:
        if end <= start:
            return 0, 0
        return int(t.place[start] - offsets[r]), int(t.place[end - 1] + t.width[end - 1] - offsets[r])

    for r, item_id, lo, hi in _find_short(t, eights, index) if index.short else ():
        yield (r, item_id, 0, *span(r, lo, hi))
    for q, (keys, first, items, table) in index.by_q.items():
        h = _hash_grams(t.small, q, eights)
        pos = np.flatnonzero(table[(h >> np.uint64(64 - _TABLE_BITS)).view(np.int64)])
        key = np.minimum(np.searchsorted(keys, h[pos]), len(keys) - 1)
        row = np.searchsorted(t.edges, pos, side="right") - 1
        ok = (keys[key] == h[pos]) & (pos + q <= t.edges[row + 1])
        if not ok.any():
            continue
        for r, k, areas in _areas(pos[ok], row[ok], key[ok], first, items, q, index, p.hits):
            text = int(t.edges[r]), int(t.edges[r + 1])
            if best := _best(t, h, text, areas, index.texts[k], q, int(index.edits[k]), int(index.bound[k]), p):
                yield (r, index.ids[k], best[0], *span(r, best[1], best[2]))


def _matches(sent, p: Leaks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for part in W.chunks(batch, "text", p.chunk):
                found = list(find(part.column(1), index, p))
                if found:
                    row, item, edits, start, end = zip(*found, strict=True)
                    ids = part.column(0).take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(item, pa.int64()), pa.array(edits, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "edits", "start", "end"])

    return run


def _blocks(benchmark: DataFrame, p: Leaks) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``block`` bytes, read one by one."""
    block, held = [], 0
    for r in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["item_id", "text"]).toLocalIterator():
        size = len(r["text"].encode())
        if block and held + size > p.block:
            yield block
            block, held = [], 0
        block.append((r["item_id"], r["text"]))
        held += size
    if block:
        yield block


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, p: Leaks = Leaks()) -> DataFrame:
    """(doc_id, item_id, edits, start, end): every document that holds an item, once for each.

    start and end are bytes of the text in UTF-8, of the match with the fewest edits.  Null texts and
    ids hold nothing; items that are null, without id, without a folded character, or, unless ``short``,
    under ``least`` match nothing.
    Repeated rows of documents repeat their matches; of items that share an id each text counts, and
    their rows repeat.  Empty tables give an empty result.  Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits int, start long, end long"
    small_batches(spark)
    out = None
    for block in _blocks(items, p):
        sent = spark.sparkContext.broadcast(build(block, p))
        one = docs.mapInArrow(_matches(sent, p), schema)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, p: Leaks = Leaks()) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns, whatever their names.

    Null and empty texts hold nothing and stay, and so do rows without doc_id.  Repeated rows of one
    doc_id stay or go together.  An empty table gives an empty one; without items all rows stay.
    """
    name = unused("leak_id", docs)
    gone = leaks(spark, docs, benchmark, p).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
