"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, pairs of neighbours and pairs that skip one or two words are hashed into a
fixed number of coordinates; a text has each of its coordinates once. The model is
fitted on a bounded sample of the labelled rows, in the order of a hash of the id.
Every coordinate has a learning rate of its own, and L1 leaves most weights at
zero: what is sent to the tasks has at most one weight for each coordinate.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.llm.scratch import columns_of, tidy, whole_text
from wattframe.llm.words import split_words, text_slices

BITS = 20
#: Labelled rows the model is fitted on, about; a bound on the work of one task.
TRAIN_ROWS = 16_000
EPOCHS = 6
#: Coordinates of fewer texts cannot outgrow L1 and are left out of the fit.
MIN_TEXTS = 3
_SLICE_BYTES = 1 << 20
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 12.0, 1.0
#: Distances of the words in a pair; 0 is the word alone.
GAPS = (0, 1, 2, 3)

_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of the words without the punctuation around them."""
    bare = (w.strip(string.punctuation) or w for w in words)
    return np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in bare), np.uint64, len(words))


def coordinates(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and coordinate of every occurrence of a feature."""
    offsets, index, dictionary = split_words(pc.utf8_lower(texts))
    counts = np.diff(offsets)
    words = dictionary.to_pylist()
    hashes = word_hashes(words)[index]
    text = np.repeat(np.arange(len(counts)), counts)
    real = np.array([bool(w) for w in words], bool)[index] if words else np.empty(0, bool)
    text, hashes = text[real], hashes[real]
    rows, found = [], []
    for gap in GAPS:
        mixed = hashes * _ODD
        if gap:
            same = text[gap:] == text[:-gap]
            mixed = ((hashes[:-gap] * _ODD + np.uint64(gap)) ^ (hashes[gap:] >> np.uint64(7)))[same] * _ODD
            rows.append(text[gap:][same])
        else:
            rows.append(text)
        found.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """FTRL-proximal; coordinate ``2 ** bits`` is the intercept, which has no L1."""

    def __init__(self, bits: int = BITS):
        self._z = np.zeros((1 << bits) + 1)
        self._n = np.zeros((1 << bits) + 1)
        self._l1 = np.full((1 << bits) + 1, L1)
        self._l1[-1] = 0.0

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n, l1 = self._z[at], self._n[at], self._l1[at]
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > l1, w, 0.0)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        error = sigmoid(w.sum()) - label
        grown = self._n[at] + error * error
        self._z[at] += error - (np.sqrt(grown) - np.sqrt(self._n[at])) / ALPHA * w
        self._n[at] = grown


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, "text", _SLICE_BYTES):
                row, at = coordinates(some.column("text"), bits)
                keys = np.unique(row << bits | at)
                ends = np.searchsorted(keys >> bits, np.arange(len(some) + 1))
                own = (keys & ((1 << bits) - 1)).astype("<i4")
                found = [own[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [some.column("turn"), some.column("toxic"), pa.array(found, pa.binary())], ["turn", "toxic", "at"]
                )

    return run


def _fit(bits: int, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        held = []
        for batch in batches:
            held.append(batch)
            for at in batch.column("at"):
                counts[np.frombuffer(at.as_buffer(), "<i4")] += 1
        rows = []
        while held:
            batch = held.pop(0)
            for at, toxic in zip(batch.column("at"), batch.column("toxic").to_pylist()):
                own = np.frombuffer(at.as_buffer(), "<i4")
                rows.append((np.append(own[counts[own] >= MIN_TEXTS], np.int32(1 << bits)), toxic))
        model = Ftrl(bits)
        for _ in range(epochs):
            for at, toxic in rows:
                model.learn(at, toxic)
        weights = model.weights()
        kept = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(weights[kept])], ["at", "weight"])

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learnable: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    train_rows: int = TRAIN_ROWS,
    bits: int = BITS,
    epochs: int = EPOCHS,
) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that are not zero.

    ``learnable`` says, by the id, which labelled rows may be learned from. Of an id
    labelled more than once the greater label counts; null ids and labels are left
    out. Without labelled rows there are no weights.
    """
    known = (
        columns_of(labels, id_column, label_column)
        .where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & learnable)
        .groupBy(F.col(id_column).alias("id"))
        .agg(F.max(label_column).cast("double").alias("toxic"))
        .withColumn("turn", F.xxhash64("id"))
    )
    n = known.count()
    if not n:
        return np.empty(0, np.int64), np.empty(0)
    # about train_rows of them, whatever the size of the table
    cut = int(min(1.0, train_rows / n) * 2.0**32)
    sample = known.where(F.pmod("turn", F.lit(1 << 32)) < cut)
    texts = columns_of(docs, id_column, text_column).select(
        F.col(id_column).alias("id"), whole_text(text_column).alias("text")
    )
    features = (
        texts.join(F.broadcast(sample), "id")
        .select("turn", "toxic", "text")
        .mapInArrow(tidy(_features(bits)), "turn long, toxic double, at binary")
    )
    model = features.repartition(1).sortWithinPartitions("turn", "at").mapInArrow(tidy(_fit(bits, epochs)), "at long, weight double")
    rows = model.toArrow()
    return rows["at"].to_numpy(), rows["weight"].to_numpy()


def score(
    docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_column: str = "text", bits: int = BITS
) -> DataFrame:
    """``(doc, score)``: each row as a struct, and its score from 0 to 1.

    Null and empty texts have the score of the intercept. Without a model every score
    is 0. An empty table gives an empty one.
    """
    at, weight = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << bits) + 1)
        dense[at] = weight
        for batch in batches:
            for some in text_slices(batch, "text", _SLICE_BYTES):
                row, found = coordinates(some.column("text"), bits)
                heavy = dense[found] != 0
                keys = np.unique(row[heavy] << bits | found[heavy])
                sums = np.bincount(keys >> bits, dense[keys & ((1 << bits) - 1)], minlength=len(some))
                scores = sigmoid(sums + dense[-1]) if len(at) else np.zeros(len(some))
                yield pa.RecordBatch.from_arrays([some.column("doc"), pa.array(scores)], ["doc", "score"])

    packed = docs.select(F.struct("*").alias("doc"), whole_text(f"`{text_column}`").alias("text"))
    return packed.mapInArrow(tidy(run), T.StructType([packed.schema["doc"], T.StructField("score", T.DoubleType())]))


def learnable_id(id_column: str = "doc_id") -> Column:
    """Ids whose CRC-32, of the id as text, leaves another remainder than 2 by 4."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 != 2
