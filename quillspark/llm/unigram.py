"""Token counts by Viterbi over a unigram vocabulary, without making the tokens.

The vocabulary is a list of pieces with scores.  A text is written with a space mark in front and for
every space; an Aho-Corasick automaton gives all pieces that end at each character, and dynamic
programming carries the best score and its number of pieces.  Ties go as in the tokenizers library:
of equal scores the piece that starts first wins.  A character that is no piece is unknown, at ten
under the least score, and counts as its UTF-8 bytes.  Names of control pieces in a text (<s>, <unk>,
<0x41>) are pieces like others, as they are to that library's Unigram model when no added token names them.

No piece has a space mark behind another character, so a text's best path is made of the best paths
of its runs of marks and the letters behind them.  Distinct runs are counted once and remembered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.store import small_batches

MARK = "▁"


@dataclass(frozen=True)
class Unigram:
    #: A sentencepiece file on every machine; its pieces and scores are the vocabulary.
    model: str
    #: Runs that a worker remembers.
    most: int = 1_000_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, in order of ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts pieces of runs; ``known`` and ``counts`` remember them by hash."""

    def __init__(self, pieces: list[tuple[str, float]], most: int) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - 10
        self.split = not any(MARK in piece.lstrip(MARK) for piece, _ in pieces)
        self.most = most
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def run(self, text: str) -> int:
        """The number of pieces of one run."""
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        at, found = 0, None
        for end, (size, score) in self.automaton.iter(text):
            if end != at - 1 or found is None:
                # characters at which no piece ends are unknown
                if found is not None and not found[2]:
                    self._unknown(text, at, found, best)
                if found is not None:
                    best[at], count[at] = found[0], count[found[1]] + found[3]
                for i in range(at + 1, end + 1):
                    best[i], count[i] = best[i - 1] + self.unknown, count[i - 1] + len(text[i - 1].encode())
                at, found = end + 1, [-np.inf, 0, False, 1]
            total = best[at - size] + score
            if total > found[0]:
                found[0], found[1], found[3] = total, at - size, 1
            if size == 1:
                found[2] = True
        if found is not None:
            if not found[2]:
                self._unknown(text, at, found, best)
            best[at], count[at] = found[0], count[found[1]] + found[3]
        for i in range(at + 1, n + 1):
            count[i] = count[i - 1] + len(text[i - 1].encode())
        return count[n]

    def _unknown(self, text: str, at: int, found: list, best: list[float]) -> None:
        total = best[at - 1] + self.unknown
        if total > found[0]:
            found[0], found[1], found[3] = total, at - 1, len(text[at - 1].encode())

    def texts(self, column: pa.Array) -> np.ndarray:
        """The number of pieces of each text; null and empty texts have none."""
        raw, offsets = W.text_buffers(column)
        size = np.diff(offsets)
        data = np.insert(raw, offsets[:-1][size > 0], 0x20)
        edges = np.concatenate(([0], np.cumsum(size + (size > 0))))
        first = edges[:-1][size > 0]
        begins = data == 0x20
        begins[1:] &= data[:-1] != 0x20
        # a mark that stands in the text itself belongs to the run of marks too
        begins[3:] &= ~((data[:-3] == 0xE2) & (data[1:-2] == 0x96) & (data[2:-1] == 0x81))
        if self.split:
            begins[first] = True
        else:
            begins = np.zeros(len(data), dtype=bool)
            begins[first] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        hashes = W.span_hashes(data, starts, ends)
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self.known, self.counts = self.known[:0], self.counts[:0]
        new = ~np.isin(distinct, self.known)
        made = [self.run(data[starts[i] : ends[i]].tobytes().decode().replace(" ", MARK)) for i in at[new].tolist()]
        known = np.concatenate((self.known, distinct[new]))
        order = np.argsort(known, kind="stable")
        self.known, self.counts = known[order], np.concatenate((self.counts, np.array(made, np.int64)))[order]
        counts = self.counts[np.searchsorted(self.known, distinct)][inverse] if len(starts) else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(counts)))
        return np.diff(total[np.searchsorted(starts, edges)])


@lru_cache(maxsize=2)
def counter(p: Unigram) -> Counter:
    """One automaton and memory for each Python worker."""
    return Counter(vocabulary(p.model), p.most)


def token_counts(spark: SparkSession, docs: DataFrame, p: Unigram) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs`` (doc_id, text, ...).

    Null and empty texts have no bytes and no tokens.  Repeated rows repeat and a null doc_id is
    returned; an empty table gives an empty result.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch):
                _, offsets = W.text_buffers(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(counter(p).texts(part.column(1)))], names=["doc_id", "n_bytes", "n_tokens"])

    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
