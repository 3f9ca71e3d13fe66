"""Toxicity by a classifier chain.

The links of the chain are categories, the last one toxicity as ``labels.toxic`` marks it.  The
categories before it are kinds of abuse.  No label names them, so they come from the data: toxic
training rows are clustered by their selected features, a cluster a kind.  Each link is a logistic
model over the presence of selected words and word beginnings, for toxicity or against it, and over the
probabilities of all links before it.  In training these probabilities are out-of-fold predictions, so
no link learns from scores that saw its own row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.store import Scratch

@dataclass(frozen=True)
class Toxicity:
    #: Kinds of abuse that are told apart.
    kinds: int = 3
    #: Bytes of word beginnings that are features beside whole words.
    beginnings: tuple[int, ...] = (4, 5, 6, 7, 8)
    #: A feature that comes this often in a text is a further feature.
    often: int = 3
    #: Bound of the training sample and of the selected features.
    sample: int = 12_000
    features: int = 2000
    #: Least z-score, of either sign, and number of texts of a selected feature.
    z: float = 3.5
    least: int = 5
    folds: int = 5
    steps: int = 250
    penalty: float = 2.0
    threshold: float = 0.5
    seed: int = 23


def text_features(column: pa.Array, p: Toxicity) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of a column of texts: whole words and word beginnings, as often as they come."""
    words = W.Words(column, fold=True)
    # letters only: what trails a word (punctuation, marks) is cut off
    data = words.data
    letter = np.zeros(256, dtype=bool)
    letter[97:123] = letter[128:] = True
    inside = letter[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[words.offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1 : len(data)]
    stop = inside.copy()
    if len(data):
        stop[:-1] &= ~inside[1:] | edge[1 : len(data)]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    rows = np.searchsorted(words.offsets, starts, side="right") - 1
    found_rows, found = [rows], [W.span_hashes(data, starts, ends)]
    for n in p.beginnings:
        long = ends - starts > n
        found_rows.append(rows[long])
        found.append(W.mix(W.span_hashes(data, starts[long], starts[long] + n) + np.uint64(n)))
    return np.concatenate(found_rows), np.concatenate(found)


def _distinct(row: np.ndarray, feature: np.ndarray, p: Toxicity) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, and pairs that come often once more under another name."""
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])))) if len(row) else np.zeros(0, np.int64)
    often = new[np.diff(np.concatenate((new, [len(row)]))) >= p.often]
    return np.concatenate((row[new], row[often])), np.concatenate((feature[new], W.mix(feature[often] + np.uint64(1 << 60))))


def _feature_counts(p: Toxicity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text", 16 << 20):
                toxic = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                row, feature = _distinct(*text_features(part.column(0), p), p)
                name, inverse = np.unique(feature, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(np.bincount(inverse, toxic[row], len(name)).astype(np.int64)), pa.array(np.bincount(inverse, minlength=len(name)).astype(np.int64))], names=["feature", "toxic", "n"])

    return run


@dataclass
class Chain:
    """Sorted features; a row of weights, earlier probabilities and constant for each link."""

    features: np.ndarray
    names: list[str]
    weights: list[np.ndarray]
    p: Toxicity

    def places(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the selected features of texts."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, feature = _distinct(*text_features(column, self.p), self.p)
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        hit = self.features[at] == feature
        return row[hit], at[hit]

    def predict(self, row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of all links, one after the other."""
        out = np.zeros((n, len(self.names)))
        for k, w in enumerate(self.weights):
            out[:, k] = _probability(row, place, out[:, :k], w, len(self.features))
        return out


def _probability(row: np.ndarray, place: np.ndarray, before: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    x = np.bincount(row, w[place], len(before)) + before @ w[size:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(row: np.ndarray, place: np.ndarray, before: np.ndarray, y: np.ndarray, use: np.ndarray, size: int, p: Toxicity) -> np.ndarray:
    """Weights of a logistic model of the rows in ``use``, by Adam on the whole sample."""
    w = np.zeros(size + before.shape[1] + 1)
    share = (y[use].sum() + 0.5) / (use.sum() + 1)
    w[-1] = np.log(share / (1 - share))
    if y[use].sum() in (0, use.sum()):
        return w
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, p.steps + 1):
        err = np.where(use, _probability(row, place, before, w, size) - y, 0)
        g = np.concatenate((np.bincount(place, err[row], size), before.T @ err, [err.sum()])) + p.penalty * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - 0.15 * (1 - step / (p.steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return w


def derived_kinds(row: np.ndarray, place: np.ndarray, toxic: np.ndarray, speaks: np.ndarray, count: int, rounds: int = 10) -> np.ndarray:
    """(row, kind): which of ``count`` kinds each toxic row belongs to, none for rows without a feature that ``speaks``.

    A kind starts from the rows that share the most frequent feature of those not yet taken; then rows go
    to the kind with the most similar mean, and means are taken anew, until nothing moves.
    """
    out = np.zeros((len(toxic), count), dtype=bool)
    bad = np.flatnonzero(toxic)
    x = np.zeros((len(bad), len(speaks)), dtype=np.float32)
    of = np.full(len(toxic), -1)
    of[bad] = np.arange(len(bad))
    here = (of[row] >= 0) & speaks[place]
    x[of[row[here]], place[here]] = 1
    known = x.any(axis=1)
    if not known.any():
        return out
    x /= np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1)
    member, rest = np.zeros((len(bad), count), dtype=bool), known.copy()
    for k in range(count):
        if rest.any():
            member[:, k] = rest & (x[:, np.argmax((x[rest] > 0).sum(axis=0))] > 0)
            rest &= ~member[:, k]
    for _ in range(rounds):
        mean = member.T.astype(np.float32) @ x
        mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
        new = known[:, None] & (np.argmax(x @ mean.T, axis=1)[:, None] == np.arange(count))
        if (new == member).all():
            break
        member = new
    out[bad] = member
    return out


def chained(row: np.ndarray, place: np.ndarray, folds: np.ndarray, categories: list[np.ndarray], size: int, p: Toxicity) -> list[np.ndarray]:
    """The weights of a link for each category; links see out-of-fold probabilities of those before them."""
    weights, before = [], np.zeros((len(folds), 0))
    every = np.ones(len(folds), dtype=bool)
    for k, y in enumerate(categories):
        weights.append(_logistic(row, place, before, y, every, size, p))
        unseen = np.zeros(len(folds))
        for f in range(p.folds) if k + 1 < len(categories) else ():
            w = _logistic(row, place, before, y, folds != f, size, p)
            unseen = np.where(folds == f, _probability(row, place, before, w, size), unseen)
        before = np.column_stack((before, unseen))
    return weights


def _sample_places(chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch):
                row, place = chain.value.places(part.column(0))
                order = np.argsort(row, kind="stable")
                off = np.searchsorted(row[order], np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.ListArray.from_arrays(off, pa.array(place[order].astype(np.int32)))], names=["toxic", "fold", "places"])

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, p: Toxicity) -> Chain:
    """The chain learned from ``labels`` (doc_id, toxic), of which a bounded sample by hash is read."""
    scratch = Scratch(spark, "toxicity")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    ids = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id").limit(p.sample)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(p.seed + 1)), F.lit(p.folds)).cast("int")
    rows = scratch.cut(docs.join(F.broadcast(ids), "doc_id").select("text", "toxic", fold.alias("fold")), "sample")
    n, bad = (int(x or 0) for x in rows.agg(F.count("*"), F.sum("toxic")).first())
    counted = rows.select("text", "toxic").mapInArrow(_feature_counts(p), "feature long, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("n").alias("n")).withColumn("b", F.col("n") - F.col("a"))
    odds = F.log((F.col("a") + 0.5) / (F.lit(bad) - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (F.lit(n - bad) - F.col("b") + 0.5))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    strong = counted.withColumn("z", z).where((F.abs("z") >= p.z) & (F.col("n") >= p.least))
    top = strong.orderBy(F.desc(F.abs("z")), "feature").limit(p.features).select("feature", "z").toPandas()
    feature = top["feature"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(feature)
    features, speaks = feature[order], top["z"].to_numpy(dtype=float)[order] > 0
    chain = Chain(features, [*(f"kind_{k + 1}" for k in range(p.kinds)), "toxic"], [], p)
    found: pd.DataFrame = rows.mapInArrow(_sample_places(spark.sparkContext.broadcast(chain)), "toxic int, fold int, places array<int>").toPandas()
    scratch.drop(rows)
    toxic, folds = (found[c].to_numpy(dtype=np.int64) for c in ("toxic", "fold"))
    sizes = [len(x) for x in found["places"]]
    row = np.repeat(np.arange(len(found)), sizes)
    place = np.concatenate([np.asarray(x, dtype=np.int64) for x in found["places"]]) if len(found) else np.zeros(0, np.int64)
    kinds = derived_kinds(row, place, toxic, speaks, p.kinds)
    chain.weights = chained(row, place, folds, [*kinds.T.astype(float), toxic.astype(float)], len(features), p)
    return chain


def _scored(chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Chain = chain.value
        for batch in batches:
            for part in W.chunks(batch):
                row, place = c.places(part.column(1))
                out = c.predict(row, place, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(x) for x in out.T), pa.array((out[:, -1] >= c.p.threshold).astype(np.int32))], names=["doc_id", "held_out", *c.names, "predicted"])

    return run


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, held_out: Column, p: Toxicity = Toxicity()) -> DataFrame:
    """(doc_id, held_out, a probability for each link, predicted) of every row of ``docs`` (doc_id, text).

    Learns from rows of ``labels`` (doc_id, toxic) for which ``held_out``, a boolean column over doc_id,
    is not true; labels other than 0 and 1 are left out, of several for one document the largest
    counts.  Null and empty texts have no features: their scores are the chain's constants.  Without
    labels, or with one label only, scores are the smoothed share of toxic rows.  Kinds are numbered from 1; a
    kind that no toxic row belongs to has the probability of a link without positives.  Repeated rows are
    scored alike and a null doc_id is returned.  Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chain = fit(spark, docs, labels.where(F.coalesce(~held_out, F.lit(True))), p)
    out = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    names = ", ".join(f"{k} double" for k in chain.names)
    return out.mapInArrow(_scored(spark.sparkContext.broadcast(chain)), f"doc_id long, held_out boolean, {names}, predicted int")
