"""Language of a text by prediction by partial matching.

For each language a tree of byte contexts of up to four bytes holds how often each byte
followed them in the texts to learn from. The trees are frozen then: a text's code
length under a language is the sum, over its bytes, of what it costs to code the byte
in the longest context known, after an escape (method C, with exclusion) from every
longer one that doesn't know the byte. The language of the shortest code is predicted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.llm.rank_index import text_bytes
from wattframe.llm.scratch import Scratch, columns_of, tidy, whole_text
from wattframe.llm.words import text_slices

#: Bytes of the longest context.
ORDER = 4
#: Labelled rows of each language that the trees are grown from, about.
TRAIN_ROWS = 4_000
#: Nodes (a context and a byte after it) kept of each language, the most frequent ones.
#: With 12 bytes a node this bounds what is sent to the tasks: 3 MB for a language.
NODES = 1 << 18
UNDETERMINED = "und"
#: Bytes of text whose contexts are looked up at once.
_WINDOW = 1 << 20


def contexts(data: np.ndarray, offsets: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the bytes from ``begin`` to ``end``: text number, bytes of context in the text, and the last five bytes as one number."""
    from_ = max(0, begin - ORDER)
    part = data[from_:end].astype(np.uint64)
    grams = np.zeros(len(part), np.uint64)
    for back in range(ORDER, -1, -1):
        grams <<= np.uint64(8)
        if back < len(part):
            grams[back:] |= part[: len(part) - back]
    grams = grams[begin - from_ :]
    text = np.searchsorted(offsets, np.arange(begin, end), side="right") - 1
    depth = np.minimum(np.arange(begin, end) - offsets[text], ORDER)
    return text, depth, grams


def _low(grams: np.ndarray, n_bytes: int) -> np.ndarray:
    return grams & np.uint64((1 << (8 * n_bytes)) - 1)


def _windows(total: int) -> Iterator[tuple[int, int]]:
    for begin in range(0, total, _WINDOW):
        yield begin, min(begin + _WINDOW, total)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "size", "gram", "n"]
    for batch in batches:
        for some in text_slices(batch, "text"):
            data, offsets = text_bytes(some.column("text"))
            langs = some.column("lang").dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)
            values = langs.dictionary
            for begin, end in _windows(len(data)):
                text, depth, grams = contexts(data, offsets, begin, end)
                for lang in np.unique(code[text]):
                    own = code[text] == lang
                    own_depth, own_grams = depth[own], grams[own]
                    for size in range(ORDER + 1):
                        found, n = np.unique(_low(own_grams[own_depth >= size], size + 1), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([values[int(lang)].as_py()] * len(found), pa.string()),
                                pa.array(np.full(len(found), size), pa.int32()),
                                pa.array(found.astype(np.int64)),
                                pa.array(n.astype(np.int64)),
                            ],
                            names,
                        )


@dataclass(frozen=True)
class ContextTree:
    """The frozen tree of one language; one entry of each list for every context length."""

    grams: list[np.ndarray]
    counts: list[np.ndarray]
    known: list[np.ndarray]
    totals: list[np.ndarray]
    symbols: list[np.ndarray]
    shadows: list[np.ndarray]

    @classmethod
    def grow(cls, size: np.ndarray, gram: np.ndarray, n: np.ndarray) -> ContextTree:
        grams, counts, known, totals, symbols, shadows = [], [], [], [], [], []
        for k in range(ORDER + 1):
            order = np.argsort(gram[size == k])
            g, c = gram[size == k][order].astype(np.uint64), n[size == k][order].astype(np.float64)
            context, first = np.unique(g >> np.uint64(8), return_index=True)
            grams.append(g)
            counts.append(c)
            known.append(context)
            totals.append(np.add.reduceat(c, first) if len(first) else c)
            symbols.append(np.diff(np.append(first, len(g))).astype(np.float64))
            if k == 0 or not len(g):
                shadows.append(np.zeros(len(context)))
                continue
            # what the bytes known after a context count for in the next shorter one
            shorter = counts[k - 1][np.searchsorted(grams[k - 1], _low(g, k))]
            shadows.append(np.add.reduceat(shorter, first))
        return cls(grams, counts, known, totals, symbols, shadows)

    def code_lengths(self, depth: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Bits of each byte after its context."""
        bits = np.zeros(len(grams))
        hidden_total, hidden_symbols = np.zeros(len(grams)), np.zeros(len(grams))
        open_ = np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            if not len(self.grams[k]):
                continue
            here = open_[depth[open_] >= k]
            own = _low(grams[here], k + 1)
            at = np.searchsorted(self.known[k], own >> np.uint64(8))
            at[at == len(self.known[k])] = 0
            met = self.known[k][at] == own >> np.uint64(8)
            here, own, at = here[met], own[met], at[met]
            total, symbols = self.totals[k][at] - hidden_total[here], self.symbols[k][at] - hidden_symbols[here]
            node = np.searchsorted(self.grams[k], own)
            node[node == len(self.grams[k])] = 0
            coded = self.grams[k][node] == own
            bits[here[coded]] += np.log2((total + symbols)[coded] / self.counts[k][node[coded]])
            # a context whose bytes are all excluded is left without a cost
            left = ~coded & (symbols > 0)
            bits[here[left]] += np.log2((total + symbols)[left] / symbols[left])
            hidden_total[here], hidden_symbols[here] = self.shadows[k][at], self.symbols[k][at]
            done = np.zeros(len(grams), bool)
            done[here[coded]] = True
            open_ = open_[~done[open_]]
        bits[open_] += np.log2(256 - hidden_symbols[open_])
        return bits


def fit(
    docs: DataFrame,
    learnable: Callable[[Column], Column],
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "lang",
    train_rows: int = TRAIN_ROWS,
    nodes: int = NODES,
) -> dict[str, ContextTree]:
    """The tree of each language.

    Learned from are about ``train_rows`` rows of each language whose ids ``learnable`` allows, chosen by a hash of
    the id and the text whatever the size of the table, with their whole texts; rows
    with a null id, text or label are left out. A node is kept if it is among the
    ``nodes`` most frequent of its language, ties at the limit left out together, or
    has no context. Without such rows there are no trees. The driver holds ``nodes``
    rows for each language of the labels.
    """
    scratch = Scratch(docs.sparkSession, "language")
    known = (
        columns_of(docs, id_column, text_column, label_column)
        .where(F.col(f"`{id_column}`").isNotNull() & learnable(F.col(f"`{id_column}`")))
        .select(F.col(f"`{label_column}`").alias("lang"), F.col(f"`{text_column}`").alias("text"), F.col(f"`{id_column}`").alias("id"))
        .dropna()
    )
    shares = known.groupBy("lang").agg((F.lit(float(train_rows)) / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 32)) / F.lit(2.0**32)
    sample = known.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("lang", "text")
    counted = sample.mapInArrow(tidy(_count_grams), "lang string, size int, gram long, n long")
    grams = scratch.keep(counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")))
    frequent = Window.partitionBy("lang").orderBy(F.desc("n"))
    limits = (
        grams.groupBy("lang", "n")
        .agg(F.count("*").alias("of"))
        .withColumn("upto", F.sum("of").over(frequent))
        .where(F.col("upto") <= nodes)
        .groupBy("lang")
        .agg(F.min("n").alias("least"))
    )
    kept = grams.join(F.broadcast(limits), "lang", "left").where((F.col("n") >= F.col("least")) | (F.col("size") == 0))
    rows = kept.select("lang", "size", "gram", "n").toArrow()
    scratch.drop(grams)
    size, gram, n = (rows[c].to_numpy() for c in ("size", "gram", "n"))
    langs = np.array(rows["lang"].to_pylist(), object)
    return {str(lang): ContextTree.grow(*(x[langs == lang] for x in (size, gram, n))) for lang in sorted(set(langs))}


def _score(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for some in text_slices(batch, "text"):
                data, offsets = text_bytes(some.column("text"))
                bits = np.zeros((len(names), len(some)))
                for begin, end in _windows(len(data)):
                    text, depth, grams = contexts(data, offsets, begin, end)
                    keys, at = np.unique(grams | depth.astype(np.uint64) << np.uint64(40), return_inverse=True)
                    own, own_depth = _low(keys, ORDER + 1), (keys >> np.uint64(40)).astype(np.int64)
                    for i, name in enumerate(names):
                        cost = trees[name].code_lengths(own_depth, own)[at]
                        bits[i] += np.bincount(text, cost, minlength=len(some))
                best = bits.argmin(axis=0)
                shortest = bits[best, np.arange(len(some))]
                share = 1.0 / np.exp2(np.maximum(shortest - bits, -1000.0)).sum(axis=0)
                lettered = some.column("lettered").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc"),
                        pa.array(np.where(lettered, np.array(names, object)[best], UNDETERMINED), pa.string()),
                        pa.array(np.where(lettered, share, 0.0)),
                        pa.array(np.where(np.diff(offsets) > 0, shortest / np.maximum(np.diff(offsets), 1), 0.0)),
                    ],
                    ["doc", "lang_pred", "score", "bits_per_byte"],
                )

    return run


def identify(docs: DataFrame, trees: dict[str, ContextTree], text_column: str = "text") -> DataFrame:
    """``(doc, lang_pred, score, bits_per_byte)``, one row per document.

    ``doc`` is a struct of all columns, whatever their names. The score is the share
    of the predicted language if all were equally likely before; of equal code
    lengths the first language by name is taken. Null texts, texts without a letter,
    and all texts where there are no trees are ``und`` with score 0. An empty table
    gives an empty one. Texts of any length are read in windows, whole.
    """
    text = whole_text(f"`{text_column}`")
    packed = docs.select(F.struct("*").alias("doc"), text.alias("text"), F.rlike(text, F.lit(r"\p{L}")).alias("lettered"))
    found = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("bits_per_byte", T.DoubleType()),
    ]
    if not trees:
        return packed.select(
            "doc", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte")
        )
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    return packed.mapInArrow(tidy(_score(shared, sorted(trees))), T.StructType([packed.schema["doc"], *found]))


def held_out(key: Column) -> Column:
    """Ids whose CRC-32, of the id as text, leaves the remainder 2 by 4; null ids are none."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
