"""Exact top-k inner products by multi-resolution segment statistics.

Components become integers.  A vector is cut into 1, 2, 4, ... segments; with the mean and the
deviation of each segment, the distance of two vectors is at least

    sum over segments of length * ((mean - mean')^2 + (deviation - deviation')^2)

and as score = (|q|^2 + |x|^2 - distance^2) / 2, that bounds the score from above.  Bounds are taken
from coarse to fine, each for the survivors of the one before; pairs whose bound is under the query's
k-th best so far drop out, and only survivors of the finest level get exact scores.

Vectors are packed into blocks.  A task has one block of queries and a group of candidate blocks, of
bounded size; both come by one shuffle.  It visits blocks from near to far, by what the box of a block's
statistics allows, and the k-th best scores rise from block to block.  The scores of a query block with
one candidate block come first and give all tasks their first thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.store import Scratch


@dataclass(frozen=True)
class TopK:
    k: int = 20
    scale: int = 64
    #: Vectors in a block of candidates and of queries, and bytes of a group of candidate blocks.
    candidates: int = 4096
    queries: int = 8192
    group: int = 32 << 20
    levels: tuple[int, ...] = (1, 2, 4, 8, 16, 32)
    #: Queries that are compared with a block at once.
    strip: int = 512


_BLOCK = "block long, ids binary, vectors binary"
_FOUND = "query_id long, vec_id long, score long"


def _kind(largest: int) -> type:
    """The narrowest integers that hold components up to ``largest``."""
    return next((t for t in (np.int16, np.int32) if largest <= np.iinfo(t).max), np.int64)


def _packed(width: int, kind: type):
    """Rows (block, vec_id, vector), sorted by block, as one row a block; shorter vectors end in zeros."""

    def row(block: int, ids: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
        cells = (pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (ids, vectors))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *cells], names=["block", "ids", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            block, vec_id = (batch.column(c).to_numpy() for c in (0, 1))
            size = np.diff(batch.column(2).offsets.to_numpy())
            x = np.zeros((batch.num_rows, width), dtype=kind)
            at = np.repeat(np.arange(len(size)), size)
            x[at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)] = batch.column(2).flatten().to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if block[lo] != now and ids:
                    yield row(now, ids, vectors)
                    ids, vectors = [], []
                now = int(block[lo])
                ids.append(vec_id[lo:hi])
                vectors.append(x[lo:hi])
        if ids:
            yield row(now, ids, vectors)

    return run


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(length) * (mean, deviation) of each segment of each row."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    size = np.diff(edges)
    total = np.add.reduceat(x, edges[:-1], axis=1)
    square = np.add.reduceat(x * x, edges[:-1], axis=1)
    mean = total / size
    return np.concatenate((mean * np.sqrt(size), np.sqrt(np.maximum(square - total * mean, 0))), axis=1)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, in floats only where these are exact."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


class Side:
    """Vectors of a block with their statistics by level, worked out when they are first asked for."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x.astype(np.int64)
        self.real = x.astype(np.float64)
        self.norm = (self.real * self.real).sum(axis=1)
        # small values leave room for single precision in bounds, which have a slack for it
        self.float = np.float32 if not self.x.size or np.abs(self.real).max() < 1e6 else np.float64
        self._levels: dict[int, np.ndarray] = {}

    def at(self, segments: int) -> np.ndarray:
        if segments not in self._levels:
            self._levels[segments] = statistics(self.real, segments).astype(self.float)
        return self._levels[segments]

    def part(self, rows: slice) -> Side:
        out = object.__new__(Side)
        out.ids, out.x, out.real, out.norm, out.float = self.ids[rows], self.x[rows], self.real[rows], self.norm[rows], self.float
        out._levels = {k: v[rows] for k, v in self._levels.items()}
        return out


def _sums(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    return np.concatenate([(a[rows[i : i + 8192]] * b[cols[i : i + 8192]]).sum(axis=1) for i in range(0, len(rows), 8192)] or [np.zeros(0, a.dtype)])


def survivors(q: Side, x: Side, floor: np.ndarray, p: TopK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, candidates) of the pairs that are left, first of all and then after each level."""
    alive = q.ids[:, None] != x.ids[None, :]
    rows, cols = np.nonzero(alive)
    yield rows, cols
    if not np.isfinite(floor).any():
        return
    for segments in (s for s in p.levels if s < q.x.shape[1]):
        if not len(rows):
            return
        a, b = q.at(segments), x.at(segments)
        # |q|^2 + |x|^2 - bound, halved, is the inner product of the statistics; rounding gets some slack
        if len(rows) > 0.1 * alive.size:
            ok = (a @ b.T)[rows, cols] if alive.size != len(rows) else (a @ b.T).ravel()
        else:
            ok = _sums(a, b, rows, cols)
        ok = ok + 2e-5 * (1 + q.norm[rows] + x.norm[cols]) >= floor[rows]
        rows, cols = rows[ok], cols[ok]
        yield rows, cols


def _first_k(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the best ``k`` of their row, best first, rows in order; ties go to the smaller id."""
    order = np.lexsort((ids, -score, rows))
    return order[np.arange(len(rows)) - np.searchsorted(rows[order], rows[order]) < k]


def best(q: Side, x: Side, floor: np.ndarray, p: TopK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate's id, score) of the best ``k`` of each query that reach ``floor``."""
    rows, cols = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for rows, cols in survivors(q, x, floor, p):  # noqa: B007
        pass
    score = exact(q.x, x.x)[rows, cols] if len(rows) > 0.1 * len(q.ids) * len(x.ids) else _sums(q.x, x.x, rows, cols)
    ok = score >= floor[rows]
    rows, ids, score = rows[ok], x.ids[cols[ok]], score[ok]
    top = _first_k(rows, ids, score, p.k)
    return rows[top], ids[top], score[top]


def _side(ids, vectors, kind: type) -> Side:
    a = np.frombuffer(ids.as_buffer(), dtype=np.int64)
    return Side(a, np.frombuffer(vectors.as_buffer(), dtype=kind).reshape(len(a), -1))


def _strips(n: int, p: TopK) -> Iterator[slice]:
    yield from (slice(at, at + p.strip) for at in range(0, n, p.strip))


def _floors(p: TopK, kind: type):
    """Query blocks with the k-th best score of each query in one candidate block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q = _side(batch.column("ids")[i], batch.column("vectors")[i], kind)
                floor = np.full(len(q.ids), -np.inf)
                if batch.column("other_ids")[i].is_valid:
                    x = _side(batch.column("other_ids")[i], batch.column("other_vectors")[i], kind)
                    for strip in _strips(len(q.ids), p):
                        rows, _, score = best(q.part(strip), x, floor[strip], p)
                        last = np.flatnonzero(np.bincount(rows, minlength=0) == p.k)
                        floor[strip.start + last] = score[np.searchsorted(rows, last, side="right") - 1]
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("block", "ids", "vectors")), pa.array([floor.tobytes()], pa.binary())], names=["block", "ids", "vectors", "floor"])

    return run


def _reach(q: Side, x: Side, segments: int) -> np.ndarray:
    """The most that a query can score with any vector in the box of a block's statistics."""
    a, b = q.at(segments).astype(np.float64), x.at(segments).astype(np.float64)
    return np.maximum(a, 0) @ b.max(axis=0) + np.minimum(a, 0) @ b.min(axis=0) + 2e-5 * (1 + q.norm + x.norm.max())


def search(q: Side, blocks: list[Side], floor: np.ndarray, p: TopK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate's id, score) of the best ``k`` of each query in all ``blocks`` that reach ``floor``."""
    blocks = [x for x in blocks if len(x.ids)]
    found = []
    segments = [s for s in p.levels if s < q.x.shape[1]]
    for strip in _strips(len(q.ids), p):
        one, low = q.part(strip), floor[strip].copy()
        reach = [_reach(one, x, segments[-1]) if segments else np.full(len(one.ids), np.inf) for x in blocks]
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        for i in sorted(range(len(blocks)), key=lambda i: -reach[i].mean()):
            asks = np.flatnonzero(reach[i] >= low)
            if not len(asks):
                continue
            rows, ids, score = best(one.part(asks), blocks[i], low[asks], p)
            held = tuple(np.concatenate(x) for x in zip(held, (asks[rows], ids, score), strict=True))
            top = _first_k(*held, p.k)
            held = tuple(x[top] for x in held)
            many = np.bincount(held[0], minlength=len(one.ids))
            full = np.flatnonzero(many == p.k)
            low[full] = np.maximum(low[full], held[2][np.cumsum(many)[full] - 1])
        found.append((held[0] + strip.start, held[1], held[2]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3))


def _meet(p: TopK, kind: type):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        rows = [], [], []
        blocks = [_side(i, v, kind) for i, v in zip(candidates.column("ids"), candidates.column("vectors"), strict=True)]
        for k in range(queries.num_rows):
            q = _side(queries.column("ids")[k], queries.column("vectors")[k], kind)
            floor = np.frombuffer(queries.column("floor")[k].as_buffer(), dtype=np.float64)
            at, ids, score = search(q, blocks, floor, p)
            for out, v in zip(rows, (q.ids[at], ids, score), strict=True):
                out.append(v)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in rows], names=["query_id", "vec_id", "score"])

    return run


def top_k(spark: SparkSession, vectors: DataFrame, is_query, p: TopK = TopK()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each query.

    ``is_query`` is a boolean column over vec_id; candidates are all rows with another vec_id.  Ties go
    to the smaller vec_id.  Rows with a null id, a null vector, or a null or non-finite component take
    no part; shorter vectors count as filled up with zeros.  Of rows that share a vec_id and a vector
    one takes part; rows that share only the id all do.  An empty table, or one without queries, gives
    an empty result.  Other columns are not read.
    """
    scratch = Scratch(spark, "topk")
    x = F.col("embedding").cast("array<double>")
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * p.scale)).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).distinct()
    rows = scratch.cut(rows, "vectors")
    largest = F.max(F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector"))))
    total, asked, width, largest = (int(v or 0) for v in rows.agg(F.count("*"), F.sum(F.col("asks").cast("long")), F.max(F.size("vector")), largest).first())
    width, n, m = max(1, width), max(1, -(-total // p.candidates)), max(1, -(-asked // p.queries))
    kind = _kind(largest)

    def blocks(df: DataFrame, many: int, name: str) -> DataFrame:
        keyed = df.select(F.pmod(F.xxhash64("vec_id"), F.lit(many)).alias("block"), "vec_id", "vector")
        return scratch.cut(keyed.repartition(max(1, many), "block").sortWithinPartitions("block").mapInArrow(_packed(width, kind), _BLOCK), name)

    candidates = blocks(rows, n, "candidates")
    queries = blocks(rows.where("asks"), m, "queries")
    one = candidates.select(F.col("block").alias("other"), F.col("ids").alias("other_ids"), F.col("vectors").alias("other_vectors"))
    first = queries.join(one, F.pmod("block", F.lit(n)) == F.col("other"), "left").drop("other")
    queries = scratch.cut(first.mapInArrow(_floors(p, kind), _BLOCK + ", floor binary"), "floors")
    # every block of queries meets every group of candidate blocks in a task of its own
    groups = min(n, max(-(-total * width * np.dtype(kind).itemsize // p.group), -(-2 * spark.sparkContext.defaultParallelism // m)))
    left = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = candidates.select(F.pmod("block", F.lit(groups)).cast("int").alias("part"), "ids", "vectors").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>")))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_meet(p, kind), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
