"""Removal of repeated passages with prefix-partitioned suffix trees over words.

A window is ``window`` consecutive words.  Every word is removed that a window covers whose words
also start a window of a document with a smaller id.  The steps:

1. Documents with equal words form a class; all but its smallest id are repeats from end to end.
2. Equal windows have equal minimizers, so only windows whose minimizer occurs in two documents can
   repeat.  Their starts are the suffixes that go on; no repeat is lost.
3. A suffix is cut at ``window`` words and written as a few symbols, each the hash of a run of
   words.  Suffixes are split by their first symbol; a prefix that too many suffixes share is split
   by one symbol more, and at full depth by a salt, a copy of its first suffix going to each part.
4. Each part is sorted, which lays out its suffix tree: equal leading symbols of neighbours are the
   depth of their common node.  Nodes as deep as the window with leaves of two documents are the
   repeats.  A part is read as a stream, so its size is no bound on memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.store import Scratch, small, unused


@dataclass(frozen=True)
class SuffixDedup:
    window: int = 50
    #: Words of a gram whose least hash in a window is the window's minimizer.
    gram: int = 8
    #: Symbols of a suffix.
    symbols: int = 3
    #: Suffixes in a part before its prefix is lengthened.
    part: int = 8192
    #: A join's side is broadcast only up to so many values (4 to 8 bytes each).
    broadcast_values: int = 4_000_000

    @property
    def cuts(self) -> list[int]:
        return [round(i * self.window / self.symbols) for i in range(self.symbols + 1)]


def _window_minima(grams: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` neighbours, in log2(n) passes."""
    step = 1
    while step * 2 <= n:
        grams = np.minimum(grams[:-step], grams[step:])
        step *= 2
    return np.minimum(grams[: len(grams) - (n - step)], grams[n - step :]) if n > step else grams


def _minimizers(words: W.Words, lo: int, hi: int, p: SuffixDedup) -> np.ndarray:
    """The minimizer of each window that starts at words ``lo`` to ``hi - window``."""
    return _window_minima(W.grams(words.hashes[lo:hi], min(p.gram, p.window)), max(1, p.window - p.gram + 1))


_PROFILE = "doc_id long, n_words long, set_a long, set_b long, minimizers array<long>, kept_sha256 string"


def _profile(p: SuffixDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch):
                words = W.Words(part.column(1), fold=False)
                raw, off = W.text_buffers(part.column(1))
                place = np.arange(len(words), dtype=np.uint64)
                a, b, least, shas = [], [], [], []
                for i, (lo, hi) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                    order = W.mix(place[: hi - lo])
                    a.append(int(W.mix(words.hashes[lo:hi] + order).sum(dtype=np.uint64).view(np.int64)))
                    b.append(int(W.mix(words.hashes[lo:hi] ^ order).sum(dtype=np.uint64).view(np.int64)))
                    least.append(np.unique(_minimizers(words, lo, hi, p)).view(np.int64) if hi - lo >= p.window else np.zeros(0, np.int64))
                    shas.append(hashlib.sha256(b" ".join(raw[off[i] : off[i + 1]].tobytes().split())).hexdigest())
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in least]))).astype(np.int32), pa.array(np.concatenate(least)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(words.first).astype(np.int64)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists, pa.array(shas)], names=["doc_id", "n_words", "set_a", "set_b", "minimizers", "kept_sha256"])

    return run


def _suffixes(p: SuffixDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", *(f"s{i}" for i in range(p.symbols))]
        for batch in batches:
            for part in W.chunks(batch):
                words = W.Words(part.column(1), fold=False)
                runs = [W.grams(words.hashes, hi - lo) for lo, hi in zip(p.cuts[:-1], p.cuts[1:], strict=True)]
                for i, (lo, hi) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                    if hi - lo < p.window:
                        continue
                    wanted = np.asarray(part.column(2)[i].values, dtype=np.int64).view(np.uint64)
                    at = np.flatnonzero(np.isin(_minimizers(words, lo, hi, p), wanted))
                    if len(at):
                        symbols = [pa.array(r[lo + at + c].view(np.int64)) for r, c in zip(runs, p.cuts, strict=False)]
                        ids = pa.array(np.full(len(at), part.column(0)[i].as_py(), dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), *symbols], names=names)

    return run


def deep_nodes(symbols: np.ndarray) -> np.ndarray:
    """Of suffixes in sorted order, the common depth (in symbols) of each with the one before it."""
    equal = symbols[:, 1:] == symbols[:, :-1]
    return np.concatenate(([0], np.logical_and.accumulate(equal, axis=0).sum(axis=0))) if symbols.shape[1] else np.zeros(0, int)


def _trees(p: SuffixDedup):
    keys = [f"s{i}" for i in range(p.symbols)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[np.ndarray, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "start", "part", "salt", *keys)}
            path = np.stack([col["part"], col["salt"].astype(np.int64), *(col[k] for k in keys)])
            new = deep_nodes(path) < len(path)  # a leaf of another node than the one before it
            new[0] = last is None or not np.array_equal(last[0], path[:, 0])
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            first = np.where(at >= 0, col["doc_id"][np.maximum(at, 0)], 0 if last is None else last[1])
            last = path[:, -1].copy(), int(first[-1])
            repeat = (col["doc_id"] > first) & (col["start"] >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(col["doc_id"][repeat]), pa.array(col["start"][repeat])], names=["doc_id", "start"])

    return run


def _dealt(suffixes: DataFrame, scratch: Scratch, p: SuffixDedup) -> DataFrame:
    """Suffixes with the part and salt of the subtree they belong to.

    Each depth counts the prefixes that were too many at the depth before; all other rows fall into one
    null group that partial aggregation folds up.  The few heavy prefixes are joined back to all rows,
    one to one, so a row is neither lost nor made.
    """
    keys = [f"s{i}" for i in range(p.symbols)]
    rows, part, salt = suffixes, None, F.lit(0)
    deepest = None
    for depth in range(1, p.symbols + 1):
        prefix = keys[:depth]
        again = F.lit(True) if depth == 1 else F.col(f"many{depth - 1}").isNotNull()
        counted = rows.groupBy(*[F.when(again, F.col(k)).alias(k) for k in prefix]).agg(F.count("*").alias(f"many{depth}"), F.min("doc_id").alias("least"))
        heavy = scratch.cut(counted.where((F.col(f"many{depth}") > p.part) & F.col("s0").isNotNull()), f"heavy{depth}")
        own = F.xxhash64(*prefix)
        part = own if part is None else F.when(again, own).otherwise(part)
        if not heavy.count():
            break
        rows = rows.join(small(heavy.drop("least")), prefix, "left")
        deepest = heavy if depth == p.symbols else None
    if deepest is not None:
        salts = F.ceil(F.col(f"many{p.symbols}") / p.part).cast("int")
        salt = F.coalesce(F.pmod(F.xxhash64("doc_id", "start"), salts).cast("int"), F.lit(0))
        # every salted part gets the suffix of the smallest document, as a leaf without a place
        heads = deepest.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        heads = heads.select(F.col("least").alias("doc_id"), F.lit(-1).alias("start"), *keys, F.xxhash64(*keys).alias("part"), "salt")
        return rows.select("doc_id", "start", *keys, part.alias("part"), salt.alias("salt")).unionByName(heads)
    return rows.select("doc_id", "start", *keys, part.alias("part"), salt.alias("salt"))


def repeats(suffixes: DataFrame, scratch: Scratch, p: SuffixDedup) -> DataFrame:
    """(doc_id, start) of the suffixes that share a node of full depth with a smaller document."""
    keys = [f"s{i}" for i in range(p.symbols)]
    dealt = _dealt(suffixes, scratch, p).repartition("part", "salt").sortWithinPartitions("part", "salt", *keys, "doc_id")
    return dealt.mapInArrow(_trees(p), "doc_id long, start int")


def runs(starts: np.ndarray) -> np.ndarray:
    """Sorted distinct starts as first, end, first, end, ... of their runs, ends not included."""
    starts = np.unique(starts)
    if not len(starts):
        return starts
    first = np.concatenate(([True], np.diff(starts) > 1))
    return np.stack((starts[first], np.append(starts[:-1][first[1:]], starts[-1]) + 1), axis=1).ravel()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [runs(np.asarray(x.values, dtype=np.int32)) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "runs"])


def covered(n_words: int, found: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n_words`` words the windows that start in ``found`` runs cover."""
    step = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(step, found[::2], 1)
    np.add.at(step, np.minimum(found[1::2] - 1 + window, n_words), -1)
    return np.cumsum(step[:-1]) > 0


def _remove(p: SuffixDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = covered(len(words), np.asarray(found.values, dtype=np.int64), p.window)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                for x, v in zip(out, (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                    x.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _few(df: DataFrame, values: str, p: SuffixDedup) -> DataFrame:
    """``df`` with a broadcast hint if its lists are within the documented bound."""
    total = df.agg(F.sum(F.size(values) + 4)).first()[0] or 0
    return F.broadcast(df) if total <= p.broadcast_values else df


def dedup_passages(spark: SparkSession, docs: DataFrame, p: SuffixDedup = SuffixDedup()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for every row of ``docs`` (doc_id, text, ...).

    kept_text is null where nothing is removed: the text stands as it is.  Null and empty texts have
    no words.  A row without doc_id is neither compared nor changed.  Repeated rows are treated
    alike; doc_id is taken to name one text.  An empty table gives an empty result.  Other columns
    are not read.
    """
    scratch = Scratch(spark, "suffix")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = scratch.cut(docs.mapInArrow(_profile(p), _PROFILE), "profile")
    long = profile.where(f"doc_id IS NOT NULL AND n_words >= {p.window}")
    classes = scratch.cut(long.groupBy("n_words", "set_a", "set_b").agg(F.min("doc_id").alias("first"), F.count("*").alias("many")), "classes")
    copies = classes.where("many > 1").select("n_words", "set_a", "set_b", "first")
    whole = scratch.cut(long.join(copies, ["n_words", "set_a", "set_b"]).where("doc_id > first").select("doc_id").distinct(), "whole")
    heads = long.join(classes.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    marks = scratch.cut(heads.select("doc_id", F.explode("minimizers").alias("mark")), "marks")
    twice = scratch.cut(marks.groupBy("mark").agg(F.count("*").alias("many")).where("many > 1").select("mark"), "twice")
    wanted = scratch.cut(marks.join(twice, "mark").groupBy("doc_id").agg(F.collect_list("mark").alias("marks")), "wanted")
    texts = docs.join(_few(wanted, "marks", p), "doc_id").select("doc_id", "text", "marks")
    suffixes = scratch.cut(texts.mapInArrow(_suffixes(p), "doc_id long, start int, " + ", ".join(f"s{i} long" for i in range(p.symbols))), "suffixes")
    scratch.drop(marks, twice, wanted)
    found = repeats(suffixes, scratch, p).groupBy("doc_id").agg(F.collect_list("start").alias("starts"))
    found = scratch.cut(found.mapInArrow(_runs, "doc_id long, runs array<int>"), "repeats")
    scratch.drop(suffixes)
    changed = docs.join(_few(found, "runs", p), "doc_id").select("doc_id", "text", "runs").mapInArrow(_remove(p), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    rest = profile.select("doc_id", "n_words", "kept_sha256").join(small(found.select("doc_id")), "doc_id", "left_anti")
    rest = rest.join(small(whole.select("doc_id", F.lit(True).alias("all"))), "doc_id", "left")
    none = hashlib.sha256(b"").hexdigest()
    rest = rest.select("doc_id", "n_words", F.when(F.col("all"), F.col("n_words")).otherwise(0).cast("long").alias("n_removed"), F.when(F.col("all"), none).otherwise(F.col("kept_sha256")).alias("kept_sha256"), F.when(F.col("all"), "").alias("kept_text"))
    return changed.unionByName(rest)


def cut_passages(spark: SparkSession, docs: DataFrame, p: SuffixDedup = SuffixDedup()) -> DataFrame:
    """``docs`` with repeated passages cut out of the texts; n_chars, where present, follows.

    Every row stays, null, empty and short texts and rows without doc_id as they are; a text that is all
    passage becomes empty.  Of equal passages that of the smallest doc_id stays; repeated rows of one
    doc_id are cut alike.  Where words are cut the rest is joined by single spaces.  All columns are
    returned, whatever their names; an empty table gives an empty one.
    """
    scratch = Scratch(spark, "cut")
    name, kept = unused("cut_id", docs), unused("cut_text", docs)
    made = dedup_passages(spark, docs, p).where("n_removed > 0").select(F.col("doc_id").alias(name), F.col("kept_text").alias(kept)).dropDuplicates([name])
    made = scratch.cut(made, "changed")
    out = docs.join(made, F.col("doc_id").cast("long") == F.col(name), "left")
    new = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(name).isNotNull(), F.length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(new).select(*[f"`{c}`" for c in docs.columns])
