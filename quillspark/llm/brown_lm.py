"""Brown class-based bigram language model.

Exchange clustering assigns words to classes; the probability of a text is the product, over its
words and one end, of a class transition and an emission of the word by its class:

    log10 p(text) = sum log10 P(class | class before) + sum log10 P(word | class)

The exchange starts from units: the most frequent words, one unit each, and all other words in
groups by the ending they share.  Then rounds move every other training word by itself, from what
stands before and after it in all training documents; words, counts and classes
stay in tables.  A
word of a round is moved as if it moved alone, so a round that lowers the likelihood is taken back.
Only unseen words keep the class of their ending.  Transitions are smoothed towards class
frequencies; emissions discount every seen word by D, and the mass so saved is that of one event,
"some unseen word of this class", whichever word it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.store import Scratch


@dataclass(frozen=True)
class BrownLM:
    #: Words that are units of their own, and groups of all other words.
    frequent: int = 1024
    groups: int = 256
    classes: int = 64
    sweeps: int = 8
    #: Frequent words have a share of 1 / common of all tokens or more: at most so many words can.
    common: int = 2_000_000
    #: Rounds in which each word that is not a unit of its own is moved.
    rounds: int = 2
    #: Bytes of text in a chunk, and entries (a word of a chunk) in a bucket of words.
    chunk: int = 1 << 20
    bucket: int = 1_000_000

    @property
    def units(self) -> int:
        return self.frequent + self.groups + 1


def _group(words: W.Words, p: BrownLM) -> np.ndarray:
    """The ending group of each word: its last two bytes, dealt to ``groups``."""
    last = words.data[words.ends - 1].astype(np.uint64)
    before = np.where(words.ends - words.starts > 1, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
    return (W.mix(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(p.groups)).astype(np.int64)


def _count_words(p: BrownLM):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text", 16 << 20):
                words = W.Words(part.column(0), fold=True)
                word, at, n = np.unique(words.hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(_group(words, p)[at].astype(np.int16)), pa.array(n.astype(np.int64))], names=["word", "ending", "n"])

    return run


@dataclass
class Units:
    """The unit of a word: ``frequent`` holds the sorted hashes of the words that are units."""

    frequent: np.ndarray
    p: BrownLM

    def of(self, words: W.Words) -> np.ndarray:
        out = _group(words, self.p) + self.p.frequent
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, words.hashes), len(self.frequent) - 1)
            hit = self.frequent[at] == words.hashes
            out[hit] = at[hit]
        return out

    def sequence(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """Units of all rows, the end before and after each row's words, and where ends stand."""
        n = len(words.first) - 1
        ends = words.first + np.arange(n + 1)
        seq = np.full(len(words) + n + 1, self.p.units - 1, dtype=np.int64)
        inside = np.ones(len(seq), dtype=bool)
        inside[ends] = False
        seq[inside] = self.of(words)
        return seq, ends


def _count_pairs(units) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = units.value
        size = u.p.units
        total = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for part in W.chunks(batch):
                seq, _ = u.sequence(W.Words(part.column(0), fold=True))
                total += np.bincount(seq[:-1] * size + seq[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    return run


def exchange(pairs: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Classes of units by the exchange algorithm; the last unit, the end, keeps the last class.

    Units start in order of frequency, dealt round; each sweep takes every unit out of its class and
    puts it where the likelihood of the class bigrams is largest, until a sweep moves nothing or
    ``sweeps`` are done.
    """
    size = len(pairs)
    end = classes - 1
    seen = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = [u for u in np.argsort(-seen, kind="stable") if u != size - 1]
    cls = np.zeros(size, dtype=np.int64)
    for i, u in enumerate(order):
        cls[u] = i % end
    cls[size - 1] = end
    member = np.zeros((size, classes))
    member[np.arange(size), cls] = 1
    joint = member.T @ pairs @ member
    to_class, from_class = pairs @ member, (member.T @ pairs).T.copy()

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    movable = [u for u in order if seen[u] > 0]
    for _ in range(sweeps):
        moved = 0
        for u in movable:
            a, own = cls[u], pairs[u, u]
            out, into = to_class[u].copy(), from_class[u].copy()
            out[a] -= own
            into[a] -= own
            joint[a, :] -= out
            joint[:, a] -= into
            joint[a, a] -= own
            now = f(joint)
            rows = f(joint + out[None, :]) - now
            cols = f(joint + into[:, None]) - now
            both = np.diagonal(joint)
            gain = rows.sum(axis=1) - np.diagonal(rows) + cols.sum(axis=0) - np.diagonal(cols) + f(both + out + into + own) - f(both)
            left, right = joint.sum(axis=1), joint.sum(axis=0)
            gain -= f(left + out.sum() + own) - f(left) + f(right + into.sum() + own) - f(right)
            gain[end] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            joint[b, :] += out
            joint[:, b] += into
            joint[b, b] += own
            if b != a:
                moved += 1
                cls[u] = b
                to_class[:, a] -= pairs[:, u]
                to_class[:, b] += pairs[:, u]
                from_class[:, a] -= pairs[u, :]
                from_class[:, b] += pairs[u, :]
        if not moved:
            break
    return cls


@dataclass
class Model:
    """Everything that scoring needs; all arrays are bounded by the parameters."""

    units: Units
    cls: np.ndarray
    transition: np.ndarray
    #: log10 of a class's tokens, and of the share that its unseen words get.
    log_class: np.ndarray
    log_unseen: np.ndarray
    discount: float
    tokens: int
    ends: int
    distinct: int
    #: Tokens of each pair of classes.
    joint: np.ndarray


def fit(spark: SparkSession, train: DataFrame, counts: DataFrame, p: BrownLM) -> Model:
    """The model that rounds start from; ``counts`` is the cut table (word, ending, n) of the training texts."""
    sums = counts.agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).first()
    tokens, distinct, once, twice = (int(x or 0) for x in sums)
    ends = train.count()
    top = counts.where(F.col("n") * p.common >= tokens + ends).select("word", "ending", "n").toPandas()
    word = top["word"].to_numpy(dtype=np.int64).view(np.uint64)
    by_rank = np.lexsort((word, -top["n"].to_numpy(dtype=np.int64)))[: p.frequent]
    units = Units(np.sort(word[by_rank]), p)
    sent = spark.sparkContext.broadcast(units)
    found = train.select("text").mapInArrow(_count_pairs(sent), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(p.units * p.units)
    pairs[found["pair"].to_numpy()] = found["n"].to_numpy()
    pairs = pairs.reshape(p.units, p.units)
    cls = exchange(pairs, p.classes, p.sweeps)
    member = np.zeros((p.units, p.classes))
    member[np.arange(p.units), cls] = 1
    joint = member.T @ pairs @ member
    groups = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toPandas()
    unit_n, unit_words = np.zeros(p.units), np.zeros(p.units)
    at = groups["ending"].to_numpy(dtype=np.int64) + p.frequent
    unit_n[at], unit_words[at] = groups["n"], groups["words"]
    mine = np.searchsorted(units.frequent, word[by_rank])
    unit_n[mine], unit_words[mine] = top["n"].to_numpy()[by_rank], 1
    np.subtract.at(unit_n, top["ending"].to_numpy(dtype=np.int64)[by_rank] + p.frequent, top["n"].to_numpy()[by_rank])
    np.subtract.at(unit_words, top["ending"].to_numpy(dtype=np.int64)[by_rank] + p.frequent, 1)
    class_n, class_words = np.bincount(cls, unit_n, p.classes), np.bincount(cls, unit_words, p.classes)
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    return Model(units, cls, *_tables(joint, class_n, class_words, discount), discount, tokens + ends, ends, distinct + (ends > 0), joint)


def _tables(joint: np.ndarray, class_n: np.ndarray, class_words: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions, log10 of the tokens of each class, and of the share of its unseen words."""
    classes = len(joint)
    share = (joint.sum(axis=0) + 1) / (joint.sum() + classes)
    transition = np.log10((joint + classes * share[None, :]) / (joint.sum(axis=1, keepdims=True) + classes))
    unseen = np.where(class_n > 0, discount * class_words / np.maximum(class_n, 1), 1.0)
    return transition, np.log10(np.maximum(class_n, 1)), np.log10(unseen)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(joint: np.ndarray) -> float:
    """What the exchange raises: the log likelihood of class bigrams up to a constant of the words."""
    return float(_f(joint).sum() - _f(joint.sum(axis=0)).sum() - _f(joint.sum(axis=1)).sum())


#: Counts whose gains are looked up.
_FEW = 8


class Gains:
    """How much the likelihood rises when one word moves, the others staying where they are."""

    def __init__(self, joint: np.ndarray) -> None:
        self.joint = joint
        self.left, self.right = joint.sum(axis=1), joint.sum(axis=0)
        few = np.arange(_FEW + 1.0)[:, None, None]
        #: By count, class beside the word, and class of the word.
        self.after = _f(joint.T[None] + few) - _f(joint.T)[None]
        self.before = _f(joint[None] + few) - _f(joint)[None]

    def _sum(self, beside: np.ndarray, joint: np.ndarray, table: np.ndarray) -> np.ndarray:
        row, c = np.nonzero(beside)
        n = beside[row, c]
        each = table[np.minimum(n, _FEW).astype(np.int64), c]
        many = n > _FEW
        each[many] = _f(joint[c[many]] + n[many, None]) - _f(joint[c[many]])
        out = np.zeros(beside.shape)
        if len(row):
            at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            out[row[at]] = np.add.reduceat(each, at, axis=0)
        return out

    def of(self, cls: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Gains (word, class) of words of class ``cls``: ``after`` and ``before`` hold how often each
        class stands beside the word, ``own`` how often the word follows itself, which neither holds."""
        j, i = self.joint, np.arange(len(cls))
        ja, jt, diag = j[cls], j.T[cls], np.diagonal(j)
        aa, ba, own = after[i, cls], before[i, cls], own.astype(float)

        def d(x: np.ndarray, more: np.ndarray) -> np.ndarray:
            return _f(x + more) - _f(x)

        ra, ca = d(ja, -after), d(jt, -before)
        gain = self._sum(after, j.T, self.after) - d(jt, aa[:, None]) - d(diag, after)
        gain += self._sum(before, j, self.before) - d(ja, ba[:, None]) - d(diag, before)
        gain += (ra.sum(axis=1) - ra[i, cls] + ca.sum(axis=1) - ca[i, cls])[:, None] - ra - ca
        gain += d(diag[cls], -aa - ba - own)[:, None] + d(diag, after + before + own[:, None])
        gain += d(ja, ba[:, None] - after) + d(jt, aa[:, None] - before)
        for side, n in ((self.left, after.sum(axis=1) + own), (self.right, before.sum(axis=1) + own)):
            gain -= d(side[cls], -n)[:, None] + d(side, n[:, None])
        gain[i, cls] = 0
        return gain


_CODED = "chunk long, doc_id array<long>, held_out array<boolean>, first array<int>, ending binary, seq binary, words binary, n binary"
_SPREAD = "bucket int, chunk long, words binary, ending binary, n binary"
_STATE = "bucket int, chunks binary, sizes binary, words binary, ending binary, n binary, place binary"
_CLASSES = "bucket int, chunk long, cls binary"
_BESIDE = "bucket int, chunk long, cls binary, sizes binary, codes binary"
#: Rows of the table of classes that belong to no chunk: codes of a bucket's words, and sums of its classes.
_WORDS, _SUMS = -1, -2


def _lists(*columns: np.ndarray | pa.Array) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]


def _cells(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """``data`` between neighbouring ``edges``, a binary cell each."""
    offsets = (np.asarray(edges, dtype=np.int64) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _joined(column: pa.ChunkedArray | pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All cells one after the other, and how many values each has."""
    cells = [np.frombuffer(x.as_buffer(), dtype=kind) for x in column]
    return np.concatenate([*cells, np.zeros(0, kind)]), np.array([len(x) for x in cells], dtype=np.int64)


def _place_type(words: int) -> type:
    return np.uint16 if words <= 1 << 16 else np.uint32


def _ending_type(p: BrownLM) -> type:
    return np.uint8 if p.groups <= 256 else np.uint16


def _code_type(p: BrownLM) -> type:
    return np.uint8 if 2 * p.classes < 256 else np.uint16


def _encode(p: BrownLM):
    """Chunks of rows: their distinct words in order of hash, how often training rows hold each, and rows as places among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in W.chunks(batch, "text", p.chunk):
                words = W.Words(part.column(2), fold=True)
                word, at, place = np.unique(words.hashes, return_index=True, return_inverse=True)
                held = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                n = np.bincount(place[~held[words.rows()]], minlength=len(word))
                cells = (_group(words, p)[at].astype(_ending_type(p)), place.astype(_place_type(len(word))), word, n.astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), *_lists(part.column(0), pa.array(held), words.first.astype(np.int32)), *(pa.array([x.tobytes()], pa.binary()) for x in cells)], names=[c.split()[0] for c in _CODED.split(", ")])
                chunk += 1

    return run


def _spread(p: BrownLM, buckets: int):
    """The words of chunks, dealt to ranges of hashes: a row for each bucket and chunk."""
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, ending, n = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in ((1, np.uint64), (2, _ending_type(p)), (3, np.uint32)))
                edges = np.concatenate(([0], np.searchsorted(words, bounds), [len(words)]))
                here = np.flatnonzero(np.diff(edges))
                edges = np.append(edges[here], len(words))
                chunk = np.full(len(here), batch.column(0)[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), pa.array(chunk), *(_cells(x, edges) for x in (words, ending, n))], names=["bucket", "chunk", "words", "ending", "n"])

    return run


def _row(**values) -> pa.Table:
    kinds = {bytes: pa.binary(), int: pa.int32()}
    return pa.table({k: pa.array([v], kinds[type(v)]) for k, v in values.items()})


def _gather(p: BrownLM):
    """A bucket as one row: its distinct words with endings and counts, and the word of each entry of its chunks."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        words, sizes = _joined(rows.column("words"), np.uint64)
        ending, n = _joined(rows.column("ending"), _ending_type(p))[0], _joined(rows.column("n"), np.uint32)[0]
        word, first, place = np.unique(words, return_index=True, return_inverse=True)
        total = np.bincount(place, n, len(word)).astype(np.int64)
        cells = {"chunks": rows.column("chunk").to_numpy(), "sizes": sizes.astype(np.int32), "words": word, "ending": ending[first], "n": total, "place": place.astype(np.int32)}
        return _row(bucket=rows.column("bucket")[0].as_py(), **{k: v.tobytes() for k, v in cells.items()})

    return run


class _Bucket:
    """A row of the state as arrays."""

    def __init__(self, row, p: BrownLM) -> None:
        self.bucket = row("bucket").as_py()
        kinds = {"chunks": np.int64, "sizes": np.int32, "words": np.uint64, "ending": _ending_type(p), "n": np.int64, "place": np.int32}
        for name, kind in kinds.items():
            setattr(self, name, np.frombuffer(row(name).as_buffer(), dtype=kind))
        self.edges = np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64)))

    def classes(self, code: np.ndarray, p: BrownLM) -> pa.Table:
        """Codes of the words for each chunk, for the bucket, and sums of words and tokens by class."""
        code = code.astype(_code_type(p))
        seen = self.n > 0
        of = (code % p.classes)[seen]
        sums = np.concatenate((np.bincount(of, self.n[seen], p.classes), np.bincount(of, minlength=p.classes))).astype(np.int64)
        cells = pa.concat_arrays([_cells(code[self.place], self.edges), pa.array([code.tobytes(), sums.tobytes()], pa.binary())])
        chunk = np.concatenate((self.chunks, [_WORDS, _SUMS]))
        return pa.table([pa.array(np.full(len(chunk), self.bucket, np.int32)), pa.array(chunk), cells], names=["bucket", "chunk", "cls"])


def _buckets(batches: Iterator[pa.RecordBatch], p: BrownLM) -> Iterator[_Bucket]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Bucket(lambda name, i=i: batch.column(batch.schema.get_field_index(name))[i], p)


def _counts(p: BrownLM):
    """(word, ending, n) of all training words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _buckets(batches, p):
            seen = np.flatnonzero(b.n > 0)
            for at in range(0, len(seen), 100_000):
                k = seen[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(b.words[k].view(np.int64)), pa.array(b.ending[k].astype(np.int16)), pa.array(b.n[k])], names=["word", "ending", "n"])

    return run


def _chunk_counts(p: BrownLM):
    """Counts of the words of each chunk: two bytes each, those that need more apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _buckets(batches, p):
            n = b.n[b.place]
            large = n >= 0xFFFF
            edges = np.concatenate(([0], np.cumsum(large)))[b.edges]
            chunk = pa.array(b.chunks)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(chunk), b.bucket, np.int32)), chunk, _cells(np.minimum(n, 0xFFFF).astype(np.uint16), b.edges), _cells(n[large], edges)], names=["bucket", "chunk", "few", "many"])

    return run


def _first_classes(model):
    """Classes of words as the units have them; words that are units stay there, and held-out words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        p = m.units.p
        for b in _buckets(batches, p):
            unit = b.ending.astype(np.int64) + p.frequent
            fixed = np.isin(b.words, m.units.frequent)
            unit[fixed] = np.searchsorted(m.units.frequent, b.words[fixed])
            code = np.where(b.n > 0, m.cls[unit] + p.classes * fixed, 2 * p.classes)
            yield from b.classes(code, p).to_batches()

    return run


class _Chunk:
    """A chunk whose words have their classes; words that training rows lack have that of their ending."""

    def __init__(self, m: Model, coded: pa.Table, known: pa.Table) -> None:
        p = m.units.p
        flat = {k: coded.column(k).combine_chunks().flatten() for k in ("doc_id", "first", "held_out") if k in coded.column_names}
        self.doc_id = flat.get("doc_id")
        self.held, self.first = flat["held_out"].to_numpy(zero_copy_only=False).astype(bool), flat["first"].to_numpy().astype(np.int64)
        self.ending = np.frombuffer(coded.column("ending")[0].as_buffer(), dtype=_ending_type(p)).astype(np.int64)
        self.seq = np.frombuffer(coded.column("seq")[0].as_buffer(), dtype=_place_type(len(self.ending))).astype(np.int64)
        self.known = known.sort_by("bucket")
        code, self.sizes = _joined(self.known.column("cls"), _code_type(p))
        code = code.astype(np.int64)
        self.unseen, self.fixed = code == 2 * p.classes, (code >= p.classes) & (code < 2 * p.classes)
        self.cls = np.where(self.unseen, m.cls[self.ending + p.frequent], code % p.classes)

    def training(self) -> np.ndarray:
        """Places of the words of training rows, ends before and after each row."""
        sizes = np.diff(self.first)
        tokens = self.seq[np.repeat(~self.held, sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes[~self.held] + 1)))
        out = np.full(ends[-1] + 1, len(self.ending), dtype=np.int64)
        inside = np.ones(len(out), dtype=bool)
        inside[ends] = False
        out[inside] = tokens
        return out


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(k, kinds[t]) for k, t in (c.split() for c in schema.split(", "))]).empty_table()


def _beside(model):
    """What stands beside the words of a chunk that may move: the class after, that before plus
    ``classes``, or twice ``classes`` for the word itself, an entry a time; a row for each bucket."""

    def run(coded: pa.Table, known: pa.Table) -> pa.Table:
        m: Model = model.value
        p = m.units.p
        if not coded.num_rows or not known.num_rows:
            return _empty(_BESIDE)
        c = _Chunk(m, coded, known)
        seq = c.training()
        cls = np.append(c.cls, p.classes - 1)[seq]
        free = np.append(~c.fixed, False)[seq]
        left, right, same = seq[:-1], seq[1:], seq[:-1] == seq[1:]
        l, r, o = free[:-1] & ~same, free[1:] & ~same, free[:-1] & same
        word = np.concatenate((left[l], right[r], left[o]))
        code = np.concatenate((cls[1:][l], cls[:-1][r] + p.classes, np.full(o.sum(), 2 * p.classes))).astype(_code_type(p))
        many = np.bincount(word, minlength=len(c.ending))
        start, edges = np.concatenate(([0], np.cumsum(many))), np.concatenate(([0], np.cumsum(c.sizes)))
        many = many.astype(np.uint16 if not len(many) or many.max() < 1 << 16 else np.uint32)
        columns = [c.known.column("bucket").combine_chunks(), pa.array(np.full(len(c.sizes), coded.column("chunk")[0].as_py())), pa.nulls(len(c.sizes), pa.binary()), _cells(many, edges), _cells(code[np.argsort(word, kind="stable")], start[edges])]
        return pa.table(columns, names=["bucket", "chunk", "cls", "sizes", "codes"])

    return run


def _pairs(model):
    """Pairs of classes of the training rows of a chunk."""

    def run(coded: pa.Table, known: pa.Table) -> pa.Table:
        m: Model = model.value
        if not coded.num_rows:
            return _empty("pair int, times long")
        cls = np.append((c := _Chunk(m, coded, known)).cls, m.units.p.classes - 1)[c.training()]
        total = np.bincount(cls[:-1] * m.units.p.classes + cls[1:])
        pair = np.flatnonzero(total)
        return pa.table([pa.array(pair.astype(np.int32)), pa.array(total[pair])], names=["pair", "times"])

    return run


def _move(gains, p: BrownLM):
    """A bucket's words where the likelihood is largest, by all that stands beside them in all chunks."""

    def run(state: pa.Table, rows: pa.Table) -> pa.Table:
        if not state.num_rows:
            return _empty(_CLASSES)
        g, size = gains.value, 2 * p.classes + 1
        b = _Bucket(lambda name: state.column(name)[0], p)
        own = rows.filter(pa.compute.equal(rows.column("chunk"), _WORDS))
        code = np.frombuffer(own.column("cls")[0].as_buffer(), dtype=_code_type(p)).astype(np.int64)
        rows = rows.filter(pa.compute.not_equal(rows.column("chunk"), _WORDS)).sort_by("chunk")
        cells = [x.as_buffer() for x in rows.column("sizes")]
        sizes = np.concatenate([*(np.frombuffer(x, dtype=np.uint32 if len(x) == 4 * n else np.uint16).astype(np.int64) for x, n in zip(cells, b.sizes, strict=True)), np.zeros(0, np.int64)])
        beside, _ = _joined(rows.column("codes"), _code_type(p))
        owner = np.repeat(b.place, sizes)
        order = np.argsort(owner, kind="stable")
        owner, beside = owner[order], beside[order]
        movable = np.flatnonzero(code < p.classes)
        for at in range(0, len(movable), 1024):
            words = movable[at : at + 1024]
            lo, hi = np.searchsorted(owner, [words[0], words[-1] + 1])
            counts = np.bincount((owner[lo:hi] - words[0]) * size + beside[lo:hi], minlength=(words[-1] - words[0] + 1) * size).reshape(-1, size)[words - words[0]].astype(float)
            gain = g.of(code[words], counts[:, : p.classes], counts[:, p.classes : -1], counts[:, -1])
            gain[:, p.classes - 1] = -np.inf
            best = np.argmax(gain, axis=1)
            code[words] = np.where(gain[np.arange(len(words)), best] > 1e-9, best, code[words])
        return b.classes(code, p)

    return run


_CLASSED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, seen double, classes binary"


def _classed(model):
    """Rows with the classes of their words, plus ``classes`` where unseen, and what word counts give."""

    def run(coded: pa.Table, known: pa.Table) -> pa.Table:
        m: Model = model.value
        p = m.units.p
        if not coded.num_rows:
            return _empty(_CLASSED)
        counted = known.filter(known.column("few").is_valid()).sort_by("bucket")
        c = _Chunk(m, coded, known.filter(known.column("cls").is_valid()))
        n = _joined(counted.column("few"), np.uint16)[0].astype(np.int64)
        n[n == 0xFFFF] = _joined(counted.column("many"), np.int64)[0]
        floor = np.log10(float(m.tokens) + m.distinct + 1) if m.tokens else 0.0
        sizes = np.diff(c.first)
        rows = np.repeat(np.arange(len(sizes)), sizes)

        def total(x: np.ndarray) -> np.ndarray:
            return np.bincount(rows, x[c.seq], len(sizes)).astype(float)

        base = total(np.log10(n + 1.0)) + np.log10(m.ends + 1.0) - floor * (sizes + 1)
        seen = total(np.where(n > 0, np.log10(np.maximum(n - m.discount, 1e-9)), 0.0))
        known_n = total((n > 0).astype(float)).astype(np.int64) + (m.ends > 0)
        code = (c.cls + p.classes * c.unseen)[c.seq].astype(_code_type(p))
        return pa.table([c.doc_id, pa.array(c.held), pa.array((sizes + 1).astype(np.int64)), pa.array(known_n), pa.array(base), pa.array(seen), _cells(code, c.first)], names=[x.split()[0] for x in _CLASSED.split(", ")])

    return run


def _steps(column: pa.Array, p: BrownLM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of rows with ends around each, which are words, which of these are unseen, and where ends stand."""
    codes = [np.frombuffer(x, dtype=_code_type(p)) for x in column.to_pylist()]
    ends = np.concatenate(([0], np.cumsum([len(x) + 1 for x in codes]))).astype(np.int64)
    seq = np.full(ends[-1] + 1, p.classes - 1, dtype=np.int64)
    inside = np.ones(len(seq), dtype=bool)
    inside[ends] = False
    code = np.concatenate([*codes, np.zeros(0, _code_type(p))]).astype(np.int64)
    seq[inside] = code % p.classes
    return seq, inside, code >= p.classes, ends


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                seq, inside, unseen, ends = _steps(batch.column(6), m.units.p)
                each = np.concatenate(([0.0], m.transition[seq[:-1], seq[1:]]))
                word = seq[inside]
                each[inside] += np.where(unseen, m.log_unseen[word], -m.log_class[word])
                steps = np.cumsum(each)
                score = batch.column(5).to_numpy() + steps[ends[1:]] - steps[ends[:-1]]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(np.full(batch.num_rows, m.tokens)), batch.column(4), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _joint(pairs: DataFrame, p: BrownLM) -> np.ndarray:
    found = pairs.groupBy("pair").agg(F.sum("times").alias("n")).toPandas()
    joint = np.zeros(p.classes**2)
    joint[found["pair"].to_numpy(dtype=np.int64)] = found["n"]
    return joint.reshape(p.classes, p.classes)


def _words_with_classes(p: BrownLM):
    """(word, ending, n, cls, fixed) of a bucket's training words."""

    def run(state: pa.Table, rows: pa.Table) -> pa.Table:
        b = _Bucket(lambda name: state.column(name)[0], p)
        code = np.frombuffer(rows.column("cls")[0].as_buffer(), dtype=_code_type(p)).astype(np.int64)
        k = np.flatnonzero(b.n > 0)
        return pa.table([pa.array(b.words[k].view(np.int64)), pa.array(b.ending[k].astype(np.int16)), pa.array(b.n[k]), pa.array((code[k] % p.classes).astype(np.int16)), pa.array(code[k] >= p.classes)], names=["word", "ending", "n", "cls", "fixed"])

    return run


def learn(spark: SparkSession, docs: DataFrame, p: BrownLM, scratch: Scratch) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the table of all training words (word, ending, n, cls, fixed), and the classed rows of ``docs``.

    Words are dealt to buckets by ranges of hashes, about ``bucket`` entries (a word of a chunk) each; what
    goes between chunks and buckets are cells of bytes, a row for each pair: two for what stands beside a
    word, one for a class.
    """

    def cut(df: DataFrame, name: str) -> DataFrame:
        """A cut table; the shuffle files behind it go when the driver's JVM sees that nothing holds them."""
        out = scratch.cut(df, name)
        spark._jvm.System.gc()
        return out

    whole = cut(docs.mapInArrow(_encode(p), _CODED), "coded")
    entries = whole.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    buckets = max(spark.sparkContext.defaultParallelism, -(-int(entries) // p.bucket))
    spread = whole.select("chunk", "words", "ending", "n").mapInArrow(_spread(p, buckets), _SPREAD)
    state = cut(spread.groupBy("bucket").applyInArrow(_gather(p), _STATE), "state")
    coded = cut(whole.drop("words", "n"), "places")
    scratch.drop(whole)
    counts = state.mapInArrow(_counts(p), "word long, ending short, n long")
    m = fit(spark, docs.where("NOT held_out").select("text"), counts, p)
    sent = spark.sparkContext.broadcast(m)
    classes = cut(state.mapInArrow(_first_classes(sent), _CLASSES), "classes")

    def by_chunk(columns: list[str], known: DataFrame, run, schema: str) -> DataFrame:
        return coded.select("chunk", "held_out", "first", "ending", "seq", *columns).groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, schema)

    def joint_of(classes: DataFrame) -> np.ndarray:
        return _joint(by_chunk([], classes.where("chunk >= 0"), _pairs(sent), "pair int, times long"), p)

    joint, best = m.joint, likelihood(m.joint)
    for _ in range(p.rounds if m.tokens else 0):
        beside = by_chunk([], classes.where("chunk >= 0"), _beside(sent), _BESIDE)
        own = classes.where(f"chunk = {_WORDS}").select("bucket", "chunk", "cls", F.lit(None).cast("binary").alias("sizes"), F.lit(None).cast("binary").alias("codes"))
        gains = spark.sparkContext.broadcast(Gains(joint))
        moved = cut(state.groupBy("bucket").cogroup(beside.unionByName(own).groupBy("bucket")).applyInArrow(_move(gains, p), _CLASSES), "classes")
        new = joint_of(moved)
        if likelihood(new) < best:
            scratch.drop(moved)
            break
        scratch.drop(classes)
        classes, joint, best = moved, new, likelihood(new)
    counted = state.mapInArrow(_chunk_counts(p), "bucket int, chunk long, few binary, many binary")
    nothing = F.lit(None).cast("binary")
    known = classes.where("chunk >= 0").select("bucket", "chunk", "cls", nothing.alias("few"), nothing.alias("many")).unionByName(counted.select("bucket", "chunk", nothing.alias("cls"), "few", "many"))
    classed = cut(by_chunk(["doc_id"], known, _classed(sent), _CLASSED), "classed")
    sums = [np.frombuffer(r["cls"], dtype=np.int64) for r in classes.where(f"chunk = {_SUMS}").select("cls").toLocalIterator()]
    class_n, class_words = np.sum([np.zeros(2 * p.classes, np.int64), *sums], axis=0).reshape(2, -1).astype(float)
    transition, log_class, log_unseen = _tables(joint, class_n, class_words, m.discount)
    found = state.groupBy("bucket").cogroup(classes.where(f"chunk = {_WORDS}").groupBy("bucket")).applyInArrow(_words_with_classes(p), "word long, ending short, n long, cls short, fixed boolean")
    return replace(m, transition=transition, log_class=log_class, log_unseen=log_unseen, joint=joint), found, classed


def score(spark: SparkSession, docs: DataFrame, held_out, p: BrownLM = BrownLM()) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text, ...), learned from those that ``held_out`` spares.

    ``held_out`` is a boolean column over doc_id; null counts as False.  Null and empty texts hold
    one token, the end.  Without training documents every token has base probability 1 and classes
    are equally likely.  Rows are scored one by one, so repeated rows repeat; a null doc_id is
    returned as it is.  Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scratch = Scratch(spark, "brown")
    model, _, classed = learn(spark, docs, p, scratch)
    scratch.keep_only(classed)
    return classed.mapInArrow(_score(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
