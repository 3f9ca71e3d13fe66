"""Best-fit packing of documents into sequences by exact-complement hashing.

What a sequence holds depends on lengths alone, and there are at most ``capacity`` lengths, so the
plan is made on the histogram.  An index by sum knows a single length, a pair and a triple that are
still available for each sum.  From the largest length down, the gap beside a length is looked up in the
index, and a combination that fills it exactly is used as often as its lengths last.  Lengths without
an exact complement are the residuals: the largest opens a sequence, the best-fitting length goes in,
and what gap that leaves is looked up in the index again.  Residuals are packed either when all exact
fills are done or as they turn up, whichever takes fewer sequences.  Pieces are then numbered within
their length, and each number finds its sequence and place in the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import bpe
from quillspark.llm import words as W
from quillspark.llm.store import Scratch


@dataclass(frozen=True)
class Packing:
    #: A tokenizer file on every machine.
    tokenizer: str
    capacity: int = 2048
    separator: int = 0
    #: Rows that one task numbers.
    numbered: int = 1_000_000


def _pieces(p: Packing, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if keep_ids else {})
        for batch in batches:
            for part in W.chunks(batch):
                row, out = [], {k: [] for k in kinds}
                for i, ids in enumerate(bpe.document_ids(part.column(1), p.tokenizer)):
                    ids = np.append(ids, p.separator).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), p.capacity)):
                        x = ids[start : start + p.capacity]
                        row.append(i)
                        values = (k, start, len(x), zlib.crc32(x.tobytes()), *([x.astype(np.int32)] if keep_ids else []))
                        for name, v in zip(out, values, strict=True):
                            out[name].append(v)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *(pa.array(v, kinds[k]) for k, v in out.items())], names=["doc_id", *out])

    return run


class Sums:
    """An index, by sum, of one, two or three lengths that are available.

    ``left`` counts what is available of each length and only ever falls, so a combination that has run
    out never comes back: the larger length of a sum's pair, and the largest of its triple, only fall too,
    and a lookup goes on from where the last one for the same sum ended.
    """

    def __init__(self, left: list[int]) -> None:
        self.left = left
        self.pair = [s - 1 for s in range(len(left))]
        self.triple = [s - 2 for s in range(len(left))]

    def _pair(self, total: int, large: int) -> tuple[int, int] | None:
        """The pair of ``total`` whose larger length is the largest up to ``large``."""
        left = self.left
        while 2 * large >= total:
            small = total - large
            if left[large] and left[small] > (small == large):
                return large, small
            large -= 1
        return None

    def exact(self, total: int) -> tuple[int, ...] | None:
        """One length, a pair or a triple that sums up to ``total``, largest first, or None."""
        if self.left[total]:
            return (total,)
        if pair := self._pair(total, self.pair[total]):
            self.pair[total] = pair[0]
            return pair
        self.pair[total] = 0
        large = self.triple[total]
        while 3 * large >= total:
            if self.left[large]:
                self.left[large] -= 1
                pair = self._pair(total - large, min(large, total - large - 1))
                self.left[large] += 1
                if pair:
                    self.triple[total] = large
                    return (large, *pair)
            large -= 1
        self.triple[total] = 0
        return None


def _plan(histogram: dict[int, int], capacity: int, later: bool) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """Sequences and slots (length, first number, number after the last, first sequence, offset)."""
    left = [0] * (capacity + 1)
    for length, n in histogram.items():
        left[length] = int(n)
    sums = Sums(left)
    used, sequences, slots = [0] * (capacity + 1), 0, []

    def use(pattern: list[int]) -> None:
        """Sequences that hold ``pattern``, as many as its lengths last."""
        nonlocal sequences
        need = Counter(pattern)
        times = min(left[x] // n for x, n in need.items())
        offset = 0
        for x in pattern:
            slots.append((x, used[x], used[x] + times, sequences, offset))
            used[x] += times
            offset += x
        for x, n in need.items():
            left[x] -= n * times
        sequences += times

    def exact(length: int) -> bool:
        """Whether sequences that ``length`` opens could be filled exactly."""
        left[length] -= 1
        found = sums.exact(capacity - length) if length < capacity else ()
        left[length] += 1
        if found is not None:
            use([length, *found])
        return found is not None

    def residual(length: int) -> None:
        pattern, gap = [length], capacity - length
        left[length] -= 1
        while gap:
            found = sums.exact(gap) if len(pattern) > 1 else None
            if found is None:
                fits = next((x for x in range(gap, 0, -1) if left[x]), None)
                if fits is None:
                    break
                found = (fits,)
            for x in found:
                left[x] -= 1
                pattern.append(x)
                gap -= x
        for x in pattern:
            left[x] += 1
        use(pattern)

    for length in range(capacity, 0, -1):
        while left[length]:
            if not exact(length):
                if later:
                    break
                residual(length)
    for length in range(capacity, 0, -1):
        while left[length]:
            residual(length)
    return sequences, slots


def plan(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Slots (length, first number, first sequence, offset), each as long as its pattern is used.

    ``until`` of a slot is the number after its last.
    """
    sequences, slots = min((_plan(histogram, capacity, later) for later in (True, False)), key=lambda p: p[0])
    table = np.array(slots, dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "number", "until", "sequence", "offset"), table.T, strict=True)) | {"sequences": np.array([sequences])}


def _place(sent, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = sent.value
        key = slots["length"] << 48 | slots["number"]
        for batch in batches:
            length, number = (batch.column(k).to_numpy() for k in ("length", "number"))
            at = np.searchsorted(key, length << 48 | number, side="right") - 1
            sequence = slots["sequence"][at] + number - slots["number"][at]
            names = [x for x in batch.schema.names if x != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(slots["offset"][at])], names=[*names, "sequence_id", "offset"])

    return run


def pack(spark: SparkSession, docs: DataFrame, p: Packing, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null and empty texts are one separator.  Only documents over ``capacity`` ids are cut.  Repeated
    rows are packed as often as they come; a null doc_id is kept.  An empty table gives an empty
    result.  Other columns are not read.
    """
    scratch = Scratch(spark, "pack")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    pieces = scratch.cut(docs.mapInArrow(_pieces(p, keep_ids), schema), "pieces")
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan(lengths, p.capacity)
    deal = max(32, -(-sum(lengths.values()) // p.numbered))
    pieces = pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(deal)).cast("int"))
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    dealt = pieces.groupBy("length", "deal").agg(F.count("*").alias("n")).select("length", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    mine = Window.partitionBy("length", "deal").orderBy("doc_id", "piece", "ids_crc32")
    numbered = pieces.withColumn("number", F.row_number().over(mine)).join(dealt, ["length", "deal"])
    numbered = numbered.withColumn("number", (F.col("base") + F.col("number") - 1).cast("long")).drop("base", "deal")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    return numbered.select(*columns, "number").mapInArrow(_place(spark.sparkContext.broadcast(slots), p.capacity), schema + ", sequence_id long, offset long")
