"""MinHash near-duplicate detection: minima, banding, verification, components.

Two documents are linked if the Jaccard similarity of their sets of word shingles is at least a
threshold.  Documents with equal sets form a class and only its smallest id goes on.  Of every
class, minima of many universal hashes are cut into bands; classes that share a band meet in a
bucket.  Buckets give candidates in two ways, neither of which emits all pairs of a bucket:

* leader rounds: each class is compared with one leader of its buckets, so a group of thousands of
  near copies becomes one component at linear cost;
* block pairs: buckets that still hold several components are cut into blocks of bounded size.  For
  each pair of blocks one task compares one-bit signatures of classes of different components and
  passes on the classes that have a possible partner; these come back with their full sets, and the
  task confirms pairs, likeliest first, and keeps the links that join components.

Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.components import components
from quillspark.llm.store import Scratch, small, unused


@dataclass(frozen=True)
class NearDup:
    """Parameters.  With 48 bands of 7 minima a pair at 0.85 shares no band once in 10**8 cases."""

    shingle: int = 5
    threshold: int = 85
    bands: int = 48
    rows: int = 7
    #: Standard errors that the one-bit estimate may lie under the threshold.
    slack: float = 6.0
    #: Classes and shingles in a block of a bucket.
    block: int = 2048
    block_shingles: int = 1 << 20
    #: Shingles in a part of a set that is compared.
    part: int = 4096
    leader_rounds: int = 2
    seed: int = 7


@lru_cache(maxsize=4)
def _hashes(p: NearDup) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(p.seed))
    n = p.bands * p.rows
    a = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a[:, None], rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]


def minima(values: np.ndarray, p: NearDup) -> np.ndarray:
    """The least value of each universal hash over a set of shingle hashes."""
    a, b = _hashes(p)
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(p.bands * p.rows, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 1024):
        np.minimum(out, (a * x[at : at + 1024] + b).min(axis=1), out=out)
    return out


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text; of fewer than ``n`` words, all words as one."""
    words = W.Words(column, fold=True)
    grams = W.grams(words.hashes, n)
    for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
        if hi - lo >= n:
            s = np.sort(grams[lo : hi - n + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif hi > lo:
            yield W.grams(words.hashes[lo:hi], hi - lo) + np.uint64(hi - lo)
        else:
            yield np.zeros(0, dtype=np.uint64)


_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, keys binary, bits binary"


def _sign(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = W.mix(np.arange(1, p.rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for part in W.chunks(batch):
                rows = ([], [], [], [], [])
                for s in shingle_sets(part.column(1), p.shingle):
                    sums = (W.mix(s).sum(dtype=np.uint64), W.mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)) if len(s) else (np.uint64(0), np.uint64(0))
                    least = minima(s, p)
                    keys = W.mix((least.reshape(p.bands, p.rows).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64) + np.arange(p.bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
                    bits = np.packbits(((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)) if len(s) else np.zeros(0, np.uint8)
                    for out, v in zip(rows, (len(s), *(int(x.view(np.int64)) for x in sums), keys.tobytes() if len(s) else b"", bits.tobytes()), strict=True):
                        out.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, k) for v, k in zip(rows, kinds, strict=True))], names=["doc_id", "n_shingles", "set_a", "set_b", "keys", "bits"])

    return run


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [v for v in batch.column(1).to_pylist()]
        keys = np.frombuffer(b"".join(raw), dtype=np.int64)
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(v) // 8 for v in raw])
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(ids[at : at + 100_000])], names=["bucket", "rep"])


def _part_sets(p: NearDup):
    """Rows (doc_id, depth, text) as parts (rep, depth, part, shingles): a set cut by the first bits of its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            for chunk in W.chunks(batch):
                rows: tuple[list, ...] = ([], [], [], [])
                for i, s in enumerate(shingle_sets(chunk.column(2), p.shingle)):
                    depth = chunk.column(1)[i].as_py()
                    edges = np.searchsorted(s, (np.arange(1, 1 << depth, dtype=np.uint64) << np.uint64(64 - depth)) if depth else np.zeros(0, np.uint64))
                    for part, piece in enumerate(np.split(s, edges)):
                        for out, v in zip(rows, (chunk.column(0)[i].as_py(), depth, part, piece.tobytes()), strict=True):
                            out.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=["rep", "depth", "part", "shingles"])

    return run


def _shared(u: np.ndarray, v: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if not len(u) or not len(v):
        return 0
    at = np.searchsorted(u, v)
    at[at == len(u)] = 0
    return int((u[at] == v).sum())


def _similar(u: np.ndarray, v: np.ndarray, p: NearDup) -> bool:
    """Whether two sorted sets reach the threshold."""
    if 100 * min(len(u), len(v)) < p.threshold * max(len(u), len(v)):
        return False
    both = _shared(u, v)
    return 100 * both >= p.threshold * (len(u) + len(v) - both)


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [_shared(*(np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in pair)) for pair in zip(batch.column(3), batch.column(4), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(both, pa.int64())], names=["a", "b", "total", "both"])


def _confirmed(pairs: DataFrame, sizes: DataFrame, docs: DataFrame, p: NearDup, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, as a cut table.

    Pairs whose sizes (rep, n) rule it out go first.  Sets are compared in parts of about ``part``
    shingles, dealt by the first bits of their hashes, so no row and no batch holds a whole long set.
    """
    left, right = (sizes.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}")) for k in ("a", "b"))
    sized = pairs.join(left, "a").join(right, "b").where(100 * F.least("n_a", "n_b") >= p.threshold * F.greatest("n_a", "n_b"))
    depth = F.ceil(F.log2(F.greatest(F.greatest("n_a", "n_b") / p.part, F.lit(1.0)))).cast("int")
    pairs = scratch.cut(sized.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"), depth.alias("depth")), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"), "depth").distinct()
    ids = scratch.cut(ids, "ids")
    mine = docs.join(small(ids), "doc_id").select("doc_id", "depth", "text")
    sets = scratch.cut(mine.mapInArrow(_part_sets(p), "rep long, depth int, part int, shingles binary").groupBy("rep", "depth", "part").agg(F.min("shingles").alias("shingles")), "sets")
    places = pairs.withColumn("part", F.explode(F.expr("sequence(0, cast(pow(2, depth) as int) - 1)")))
    x, y = (sets.select(F.col("rep").alias(k), "depth", "part", F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    joined = places.join(x, ["a", "depth", "part"]).join(y, ["b", "depth", "part"]).select("a", "b", "total", "x", "y")
    counted = joined.mapInArrow(_count_shared, "a long, b long, total long, both long").groupBy("a", "b", "total").agg(F.sum("both").alias("both"))
    links = scratch.cut(counted.where(100 * F.col("both") >= p.threshold * (F.col("total") - F.col("both"))).select("a", "b"), "links")
    scratch.drop(pairs, ids, sets)
    return links


def _partners(rows: pa.Table, p: NearDup) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (x, y) of members of one pair of blocks whose estimate could reach the threshold.

    Members of one component are no partners, and neither are two that also share an earlier band:
    the bucket of the first band they share compares them.  Comes with the equal bits of each pair.
    """
    n_bits, t = p.bands * p.rows, p.threshold / 100
    mean = (1 + t) / 2
    least = n_bits * (mean - p.slack * np.sqrt(mean * (1 - mean) / n_bits))
    rep, comp, n, side = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("rep", "comp", "n_shingles", "side"))
    bits = np.unpackbits(np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(len(rep), -1), axis=1)[:, :n_bits].astype(np.float32) * 2 - 1
    keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.int64).reshape(len(rep), -1)
    band = int(np.flatnonzero(keys[0] == rows.column("bucket")[0].as_py())[0])
    one, two = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    for at in range(0, len(one), 256):
        i = one[at : at + 256]
        same = (bits[i] @ bits[two].T + n_bits) / 2
        ok = (same >= least) & (comp[i][:, None] != comp[two][None, :]) & ((side[i][:, None] != 0) | (rep[i][:, None] < rep[two][None, :]))
        ok &= 100 * np.minimum(n[i][:, None], n[two][None, :]) >= p.threshold * np.maximum(n[i][:, None], n[two][None, :])
        x, y = np.nonzero(ok)
        fresh = np.concatenate([~(keys[i[x[k : k + 65536]], :band] == keys[two[y[k : k + 65536]], :band]).any(axis=1) for k in range(0, len(x), 65536)] or [np.zeros(0, bool)])
        x, y = x[fresh], y[fresh]
        yield i[x], two[y], same[x, y]


def _hopeful(rows: pa.Table, p: NearDup) -> pa.RecordBatch | None:
    """The members of one pair of blocks that have a partner."""
    found = [np.unique(np.concatenate((x, y))) for x, y, _ in _partners(rows, p) if len(x)]
    if found:
        return rows.select(["bucket", "i", "j", "side", "rep"]).take(pa.array(np.unique(np.concatenate(found)))).combine_chunks().to_batches()[0]
    return None


def _linked(rows: pa.Table, p: NearDup) -> pa.RecordBatch | None:
    """Confirmed links that join components within one pair of blocks: a forest, likeliest first in each strip."""
    comp = rows.column("comp").to_pylist()
    rep = rows.column("rep").to_pylist()
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in rows.column("shingles")]
    root = {c: c for c in comp}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for x, y, same in _partners(rows, p):
        order = np.argsort(-same, kind="stable")
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            a, b = top(comp[i]), top(comp[j])
            if a != b and _similar(sets[i], sets[j], p):
                root[max(a, b)] = min(a, b)
                out.append((rep[i], rep[j]))
    return pa.RecordBatch.from_arrays([pa.array([v[k] for v in out], pa.int64()) for k in (0, 1)], names=["a", "b"]) if out else None


def _grouped(work, p: NearDup):
    """``work`` on the rows of each (bucket, i, j), which come sorted; groups are of bounded size."""

    def edges(table: pa.Table) -> np.ndarray:
        key = np.stack([table.column(k).to_numpy() for k in ("bucket", "i", "j")])
        return np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [table.num_rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([rest, table]) if rest is not None else table).combine_chunks()
            edge = edges(table)
            for lo, hi in zip(edge[:-2], edge[1:-1], strict=True):
                if hi - lo > 1 and (out := work(table.slice(lo, hi - lo), p)) is not None:
                    yield out
            rest = table.slice(edge[-2])
        if rest is not None and rest.num_rows > 1 and (out := work(rest.combine_chunks(), p)) is not None:
            yield out

    return run


def _whole_sets(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch):
                sets = [s.tobytes() for s in shingle_sets(part.column(1), p.shingle)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return run


def _blocks(here: DataFrame, p: NearDup, scratch: Scratch) -> DataFrame:
    """(bucket, i, j, side, rep, comp): members of mixed buckets, once for each pair of blocks to compare.

    A component of a bucket that is larger than a block gets blocks of its own, which never meet each
    other: its members are linked already.  All smaller ones share the other blocks.  So a bucket of one
    large group and a few strangers costs a copy of each member, not one for each block.  A block holds
    at most ``block`` classes and ``block_shingles`` shingles on average.
    """
    need = F.greatest(F.ceil(F.col("m") / p.block), F.ceil(F.col("w") / p.block_shingles)).cast("int")
    sizes = scratch.cut(here.groupBy("bucket", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("w")).withColumn("own", need), "sizes")
    shared = sizes.where("own = 1").groupBy("bucket").agg(F.sum("m").alias("m"), F.sum("w").alias("w")).select("bucket", need.alias("shared"))
    large = sizes.where("own > 1").select("bucket", "comp", "own", F.coalesce(F.sum("own").over(Window.partitionBy("bucket").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    large = scratch.cut(large, "large")
    extra = large.groupBy("bucket").agg(F.sum("own").alias("extra"))
    plan = scratch.cut(sizes.select("bucket").distinct().join(shared, "bucket", "left").join(extra, "bucket", "left").na.fill(0), "plan")
    rows = here.join(small(plan), "bucket").join(small(large), ["bucket", "comp"], "left")
    hashed = F.xxhash64("rep")
    first = F.col("shared") + F.col("at")
    mine = F.when(F.col("own").isNull(), F.pmod(hashed, F.greatest("shared", F.lit(1)))).otherwise(first + F.pmod(hashed, F.col("own"))).cast("int")
    every = F.sequence(F.lit(0), (F.col("shared") + F.col("extra") - 1).cast("int"))
    others = F.when(F.col("own").isNull(), every).otherwise(F.filter(every, lambda b: (b < first) | (b >= first + F.col("own"))))
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(others))
    # side: 0 both (a block with itself), 1 the lower block, 2 the higher
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return rows.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), side.alias("side"), "rep", "comp")


def near_duplicates(spark: SparkSession, docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...).

    Null and empty texts, and texts without words, have an empty set: n_shingles 0, linked with
    nothing.  A row without doc_id is linked with nothing: component_id null, kept.  Repeated rows
    are returned as often as they come; of rows that share a doc_id but not the text, that with the
    least set hashes stands for the id in links.  An empty table gives an empty result.  Other columns,
    whatever their names, are not read.
    """
    scratch = Scratch(spark, "near-dup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.cut(docs.mapInArrow(_sign(p), _SIGNED), "signed")
    named = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = scratch.cut(named.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    one = named.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    one = one.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b", "n_shingles", "keys", "bits")).alias("s"))
    reps = scratch.cut(one.select(F.col("doc_id").alias("rep"), "s.n_shingles", "s.keys", "s.bits"), "reps")
    sizes = reps.select("rep", F.col("n_shingles").alias("n"))
    rows = reps.select("rep", "keys").mapInArrow(_bucket_rows, "bucket long, rep long")
    shared = scratch.cut(rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket"), "shared")
    buckets = scratch.cut(rows.join(shared, "bucket"), "buckets")
    scratch.drop(shared)
    links = None
    roots = scratch.cut(reps.select(F.col("rep").alias("node"), F.col("rep").alias("root")).limit(0), "roots")

    def labels() -> DataFrame:
        return scratch.cut(buckets.join(roots, F.col("rep") == F.col("node"), "left").select("bucket", "rep", F.coalesce("root", "rep").alias("comp")), "labelled")

    # the order of ids changes from round to round, so another leader stands out
    for k in range(p.leader_rounds):
        turn = F.lit((0, 0x2AAAAAAAAAAAAAAA, 0x3333333333333333)[k % 3])
        labelled = labels()
        head = labelled.groupBy("bucket").agg(F.min(F.col("rep").bitwiseXOR(turn)).alias("head"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        head = scratch.cut(head.select("bucket", F.col("head").bitwiseXOR(turn).alias("leader")), "heads")
        led = labelled.join(head, "bucket").where("rep <> leader").groupBy("rep", "comp").agg(F.min(F.col("leader").bitwiseXOR(turn)).alias("leader"))
        led = led.select(F.col("rep").alias("a"), F.col("leader").bitwiseXOR(turn).alias("b"))
        new = _confirmed(led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sizes, docs, p, scratch)
        every = new if links is None else scratch.cut(links.unionByName(new).distinct(), "links")
        scratch.drop(labelled, head, roots, *([links, new] if links is not None else []))
        links = every
        roots = scratch.cut(components(links, scratch), "roots")
    # whatever still meets across components is compared in blocks
    labelled = labels()
    mixed = scratch.cut(labelled.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket"), "mixed")
    here = scratch.cut(labelled.join(mixed, "bucket").join(sizes, "rep").select("bucket", "rep", "comp", "n"), "here")
    scratch.drop(labelled, mixed, buckets)
    key = ["bucket", "i", "j"]
    signs = reps.select("rep", "n_shingles", "bits", "keys")
    dealt = _blocks(here, p, scratch).join(signs, "rep").repartition(*key).sortWithinPartitions(*key)
    hopeful = scratch.cut(dealt.mapInArrow(_grouped(_hopeful, p), "bucket long, i int, j int, side int, rep long"), "hopeful")
    ids = scratch.cut(hopeful.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    texts = docs.join(small(ids), "doc_id", "left_semi").select("doc_id", "text")
    sets = scratch.cut(texts.mapInArrow(_whole_sets(p), "rep long, shingles binary").groupBy("rep").agg(F.min("shingles").alias("shingles")), "sets")
    compared = hopeful.join(signs, "rep").join(sets, "rep").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root")
    found = compared.repartition(*key).sortWithinPartitions(*key).mapInArrow(_grouped(_linked, p), "a long, b long").distinct()
    links = scratch.cut(links.unionByName(found).distinct() if links is not None else found, "links")
    roots = scratch.cut(components(links, scratch), "roots")
    scratch.keep_only(signed, classes, roots)
    named_class = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b", "n_shingles"], "left")
    out = named_class.join(roots, F.col("rep") == F.col("node"), "left")
    comp = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("root", "rep"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), comp).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(spark: SparkSession, docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """``docs`` without the near copies: of each component one row of the smallest doc_id stays.

    Rows with null, empty or blank texts are copies of nothing and stay.  Repeated rows of one doc_id
    become one; if they differ, that with the least values in the order of the columns stays.  A row
    without doc_id cannot be named as a copy: of such rows with equal texts one stays.  Ties do not
    arise, as ids order components.  All columns are returned, whatever their names; an empty table
    gives an empty one.
    """
    scratch = Scratch(spark, "keep-one")
    found = scratch.cut(near_duplicates(spark, docs, p).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.max("n_shingles").alias("n"), F.count("*").alias("many")), "found")
    gone, mark = unused("gone", docs), unused("many", docs)
    out = docs.join(found.where("NOT kept").select(F.col("doc_id").alias(gone)), F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    again = scratch.cut(found.where("kept AND many > 1 AND n > 0").select(F.col("doc_id").alias(mark)), "again")
    words = F.coalesce(F.col("text").cast("string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    nameless = F.col("doc_id").isNull() & words
    if not again.count() and not docs.where(nameless).limit(1).count():
        return out
    single = out.join(small(again), F.col("doc_id").cast("long") == F.col(mark), "left_anti").where(~nameless)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    twice = out.where("doc_id IS NOT NULL").join(small(again), F.col("doc_id").cast("long") == F.col(mark), "left_semi").groupBy("doc_id").agg(F.min(whole).alias(gone)).select(f"{gone}.*")
    unnamed = out.where(nameless).groupBy(F.sha2(F.col("text").cast("string"), 256).alias(mark)).agg(F.min(whole).alias(gone)).select(f"{gone}.*")
    return single.unionByName(twice).unionByName(unnamed)
