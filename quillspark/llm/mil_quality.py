"""Quality classifier by gated attention over passages (multiple-instance learning).

A document is a bag of passages of ``passage`` words.  Every passage is encoded from its bytes: the
shares of bytes and of hashed byte pairs, and how much its words repeat.  Gated attention weighs the
passages, and the weighted sum is scored:

    h = tanh(x W + b),  a = softmax over the document of w . (tanh(h V) * sigmoid(h U)),
    score = sigmoid(c . sum(a h) + d)

All weights are learned together, from document labels only, by Adam on a bounded sample of the
labelled training rows and, of very long ones, of their passages.
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
from quillspark.llm.store import small_batches


@dataclass(frozen=True)
class Quality:
    passage: int = 64
    pair_bins: int = 128
    hidden: int = 24
    gate: int = 12
    epochs: int = 14
    batch: int = 64
    rate: float = 0.004
    decay: float = 1e-4
    #: Bounds of the training sample: labelled documents, and passages of one of them, evenly spread over it.
    sample: int = 4000
    sample_passages: int = 64
    #: A document is kept if its score is at least this.
    threshold: float = 0.3
    seed: int = 11

    @property
    def width(self) -> int:
        return 256 + self.pair_bins + 4


#: Bytes of text that are encoded at once: each takes some 80 bytes of memory on the way.
_CHUNK = 1 << 20


def encode(column: pa.Array, p: Quality) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and the edges of each text's passages.

    A text without words has one passage, all zeros but for the constant.
    """
    words = W.Words(column, fold=False)
    n_words = np.diff(words.first)
    n_passages = np.maximum(1, -(-n_words // p.passage))
    edges = np.concatenate(([0], np.cumsum(n_passages)))
    total = int(edges[-1])
    x = np.zeros((total, p.width), dtype=np.float32)
    x[:, -1] = 1
    if len(words):
        rows = words.rows()
        place = edges[rows] + (np.arange(len(words)) - words.first[rows]) // p.passage
        size = words.ends - words.starts
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(words.starts - begin, size)
        data = words.data[at].astype(np.int64)
        owner = np.repeat(place, size) * 256
        shares = np.bincount(owner + data, minlength=total * 256).reshape(total, 256)
        n_bytes = np.maximum(shares.sum(axis=1, keepdims=True), 1)
        x[:, :256] = np.sqrt(shares / n_bytes)
        follow = np.concatenate((data[1:], [0x20]))
        last = np.zeros(len(data), dtype=bool)
        last[begin + size - 1] = True
        follow[last] = 0x20
        pair = ((data * 257 + follow) * 40503 >> 7) % p.pair_bins
        pairs = np.bincount(owner // 256 * p.pair_bins + pair, minlength=total * p.pair_bins).reshape(total, p.pair_bins)
        x[:, 256 : 256 + p.pair_bins] = np.sqrt(pairs / n_bytes)
        count = np.maximum(np.bincount(place, minlength=total), 1)
        same = np.zeros(len(words), dtype=bool)
        same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (place[1:] == place[:-1])
        order = np.lexsort((words.hashes, place))
        a, b = place[order], words.hashes[order]
        fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        x[:, -4] = np.bincount(place, same, total) / count
        x[:, -3] = np.bincount(a, fresh, total) / count
        x[:, -2] = np.minimum(shares.sum(axis=1) / count / 16, 4)
    return x, edges


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, dict]:
        """Scores of the documents whose passages lie between ``edges``."""
        w, bag = self.w, np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        z = (x - self.mean) * self.scale
        h = np.tanh(z @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * s) @ w["w"]
        e = np.exp(e - np.maximum.reduceat(e, edges[:-1])[bag])
        a = e / np.add.reduceat(e, edges[:-1])[bag]
        pooled = np.add.reduceat(a[:, None] * h, edges[:-1], axis=0)
        return _sigmoid(pooled @ w["c"] + w["d"][0]), {"z": z, "h": h, "t": t, "s": s, "a": a, "pooled": pooled, "bag": bag}

    def gradients(self, x: np.ndarray, edges: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        w = self.w
        score, k = self.forward(x, edges)
        err = (score - y) / len(y)
        g = {"c": k["pooled"].T @ err, "d": np.array([err.sum()])}
        down = (err[:, None] * w["c"])[k["bag"]]
        da = (down * k["h"]).sum(axis=1)
        de = k["a"] * (da - np.add.reduceat(k["a"] * da, edges[:-1])[k["bag"]])
        gate = k["t"] * k["s"]
        g["w"] = gate.T @ de
        dgate = de[:, None] * w["w"]
        dt, ds = dgate * k["s"] * (1 - k["t"] ** 2), dgate * k["t"] * k["s"] * (1 - k["s"])
        g["V"], g["U"] = k["h"].T @ dt, k["h"].T @ ds
        dh = (k["a"][:, None] * down + dt @ w["V"].T + ds @ w["U"].T) * (1 - k["h"] ** 2)
        g["W"], g["b"] = k["z"].T @ dh, dh.sum(axis=0)
        return g


def train(bags: list[np.ndarray], y: np.ndarray, p: Quality) -> Model:
    """The model of labelled bags of passages; without both labels, one that gives the labels' mean."""
    rng = np.random.Generator(np.random.PCG64(p.seed))
    every = np.concatenate(bags) if bags else np.zeros((1, p.width), np.float32)
    scale = 1 / np.maximum(every.std(axis=0), 0.01)

    def draw(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    w = {"W": draw(p.width, p.hidden), "b": np.zeros(p.hidden), "V": draw(p.hidden, p.gate), "U": draw(p.hidden, p.gate), "w": draw(p.gate), "c": draw(p.hidden), "d": np.zeros(1)}
    model = Model(every.mean(axis=0), scale, w)
    share = float(y.mean()) if len(y) else 0.5
    w["d"][0] = np.log((share * len(y) + 1) / ((1 - share) * len(y) + 1))
    if len(np.unique(y)) < 2:
        w["c"][:] = 0
        return model
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    for epoch in range(p.epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), p.batch):
            mine = order[at : at + p.batch]
            edges = np.concatenate(([0], np.cumsum([len(bags[i]) for i in mine])))
            g = model.gradients(np.concatenate([bags[i] for i in mine]), edges, y[mine])
            step += 1
            rate = p.rate * (1 - epoch / p.epochs)
            for k, v in g.items():
                v = v + p.decay * w[k]
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                w[k] -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def spread(first: int, end: int, most: int) -> np.ndarray:
    """At most ``most`` places, evenly spread from ``first`` to ``end``; all of them if there are no more."""
    return np.arange(first, end) if end - first <= most else first + np.arange(most) * (end - first) // most


def _encoded(p: Quality):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text", _CHUNK):
                x, edges = encode(part.column(0), p)
                raw = [x[spread(a, b, p.sample_passages)].astype(np.float16).tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(raw, pa.binary())], names=["quality", "x"])

    return run


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, p = model.value
        for batch in batches:
            for part in W.chunks(batch, "text", _CHUNK):
                x, edges = encode(part.column(1), p)
                score, _ = m.forward(x, edges)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score.astype(np.float64)), pa.array((score >= p.threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, p: Quality) -> Model:
    """The model learned from ``labels`` (doc_id, quality), of which a bounded sample by hash is read."""
    small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = known.orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id").limit(p.sample)
    texts = docs.join(F.broadcast(ids), "doc_id").select("text", "quality")
    found: pd.DataFrame = texts.mapInArrow(_encoded(p), "quality int, x binary").toPandas()
    bags = [np.frombuffer(x, dtype=np.float16).reshape(-1, p.width).astype(np.float32) for x in found["x"]]
    order = sorted(range(len(bags)), key=lambda i: (bags[i].shape[0], found["x"][i]))
    return train([bags[i] for i in order], found["quality"].to_numpy(dtype=np.float64)[order], p)


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, held_out: Column, p: Quality = Quality()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text, ...).

    Learns from rows of ``labels`` (doc_id, quality) for which ``held_out``, a boolean column over
    doc_id, is not true.  Labels other than 0 and 1 are left out; of several for one document the
    least counts.  Null and empty texts are one empty passage and are scored as such.  Without
    labels of both kinds every score is the smoothed mean label.  Repeated rows are scored alike and
    a null doc_id is returned.  Only doc_id and text of ``docs`` are read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(spark, docs, labels.where(F.coalesce(~held_out, F.lit(True))), p)
    out = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return out.mapInArrow(_scored(spark.sparkContext.broadcast((model, p))), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, held_out: Column, p: Quality = Quality()) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns, whatever their names.

    Null and empty texts are judged as one empty passage; rows without doc_id are judged like others.
    Repeated rows stay or go together, and scores that tie with the threshold stay.  Without labels of
    both kinds all rows stay if the mean label reaches the threshold, else none.  An empty table gives an
    empty one.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast((fit(spark, text, labels.where(F.coalesce(~held_out, F.lit(True))), p), p))

    @F.arrow_udf("boolean")
    def accepted(column: pa.Array) -> pa.Array:
        m, q = model.value
        out = []
        for part in W.chunks(pa.RecordBatch.from_arrays([column], names=["text"]), "text", _CHUNK):
            out.append(m.forward(*encode(part.column(0), q))[0] >= q.threshold)
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(accepted(F.col("text").cast("string")))
