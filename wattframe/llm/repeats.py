"""Removal of repeated byte strings by a sparse suffix array.

A string of ``length`` bytes that occurs twice holds, in both places, the same
k-mer of least hash at the same distance from its start. So only suffixes that begin
at such k-mers, the anchors, are sorted: every string of that length belongs to the
anchor within it. Anchors whose k-mer occurs once are dropped first.

The remaining suffixes, with the bytes before them, are range-partitioned by their
leading k-mer; Spark samples the splitters. Equal k-mers never part, so no match
crosses a boundary, neither between partitions nor between the runs a task sorts. In a bucket both the bytes from the anchor on and the
bytes before it are sorted by multikey quicksort, eight bytes at a time, ties alone
going on to the next eight. Two strings at the same distance from their anchors are
equal if they are in one class of common prefix in both orders.

K-mers met very often are not gathered: their strings are counted one by one, by a
cryptographic hash, with partial sums before the shuffle. Of equal texts at most two
in a task are looked at, since two suffice to show that all of them repeats.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.scratch import Scratch, columns_of, shuffle_partitions, tidy, whole_text
from wattframe.llm.words import text_slices

LENGTH = 200
KMER = 32
#: K-mers that occur more often are counted string by string; others are sorted in one task.
FREQUENT = 100_000
#: Starting positions whose anchors are looked for at once.
_STRIP = 1 << 20
#: Suffixes sorted at once, as far as equal leading bytes allow.
_SORT_ROWS = 40_000
_MATRIX_ROWS = 10_000
_TEXTS_KEPT = 100_000
_LOW = np.uint64((1 << 24) - 1)


def _kmer_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the KMER = 4 x 8 bytes from each position on."""
    x = data.astype(np.uint64)
    for shift in (8, 16, 32):
        step = shift // 8
        x = (x[:-step] << np.uint64(shift)) | x[step:]
    n = len(x) - (KMER - 8)
    h = np.zeros(n, np.uint64)
    for word, odd in enumerate((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)):
        h = (h ^ x[8 * word : 8 * word + n]) * np.uint64(odd)
        h ^= h >> np.uint64(29)
    return h


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours: the end of one block of that size and the start of the next."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``(text, kmer hash, anchor, first, last)`` over texts laid end to end.

    The strings that start at ``first`` to ``last`` have their k-mer of least hash, the
    leftmost of equal ones, at ``anchor``. All positions count from the text's start.
    """
    starts = np.concatenate(([0], ends[:-1]))
    found = []
    for at in range(0, max(0, len(data) - length + 1), _STRIP):
        part = data[at : at + _STRIP + length - 1]
        hashes = _kmer_hashes(part)
        place = np.arange(len(hashes), dtype=np.uint64)
        least = _sliding_min((hashes & ~_LOW) | place, length - KMER + 1)
        anchor = (least & _LOW).astype(np.int64)
        begin = at + np.arange(len(least))
        text = np.searchsorted(ends, begin, side="right")
        valid = begin + length <= ends[np.minimum(text, len(ends) - 1)]
        edge = np.ones(len(least), bool)
        edge[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        first = np.flatnonzero(edge & valid)
        stop = np.append(np.flatnonzero(edge | ~valid), len(least))
        last = stop[np.searchsorted(stop, first, side="right")] - 1
        own = text[first]
        base = starts[own]
        found.append((own, hashes[anchor[first]].view(np.int64), at + anchor[first] - base, at + first - base, at + last - base))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found))


def _laid_out(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    bodies = batch.column("body").to_pylist()
    return np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([len(b) for b in bodies])


def _anchor_rows(length: int, places: bool):
    names = ["kmer", "h1", "h2", "at", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, "body"):
                text, kmer, *where = anchors(*_laid_out(some), length)
                if not places:
                    yield pa.RecordBatch.from_arrays([pa.array(kmer)], ["kmer"])
                    continue
                keys = [some.column(h).take(pa.array(text)) for h in ("h1", "h2")]
                yield pa.RecordBatch.from_arrays([pa.array(kmer), *keys, *map(pa.array, where)], names)

    return run


def _twice_at_most(batches: Iterator[pa.RecordBatch], column: str):
    """Rows with wanted anchors, of equal texts two; what was seen is forgotten past a bound."""
    seen: Counter = Counter()
    for batch in batches:
        for row in batch.select(["h1", "h2", "body", column]).to_pylist():
            if not row[column]:
                continue
            if len(seen) > _TEXTS_KEPT:
                seen.clear()
            key = row["h1"], row["h2"]
            seen[key] += 1
            if seen[key] <= 2:
                yield *key, row["body"], row[column]


_SUFFIX = "lead binary, h1 long, h2 long, at long, low int, high int, context binary"


def _suffixes(length: int):
    """Suffixes at anchors, with the bytes before that their strings reach back to."""

    def run(batches):
        rows = []
        for h1, h2, body, wanted in _twice_at_most(batches, "wanted"):
            for w in wanted:
                if not w["frequent"]:
                    at, first, last = w["at"], w["first"], w["last"]
                    rows.append((body[at : at + KMER], h1, h2, at, at - last, at - first, body[first : last + length]))
            if len(rows) > 5_000:
                yield _batch(rows, _SUFFIX)
                rows = []
        if rows:
            yield _batch(rows, _SUFFIX)

    return run


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


_STRING = "string binary, h1 long, h2 long, start long"


def _strings(length: int):
    """Hashes of the single strings of frequent anchors."""

    def run(batches):
        rows = []
        for h1, h2, body, wanted in _twice_at_most(batches, "wanted"):
            for w in wanted:
                if w["frequent"]:
                    for p in range(w["first"], w["last"] + 1):
                        rows.append((blake2b(body[p : p + length], digest_size=16).digest(), h1, h2, p))
            if len(rows) > 20_000:
                yield _batch(rows, _STRING)
                rows = []
        if rows:
            yield _batch(rows, _STRING)

    return run


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of big-endian words, and bytes each has in common with the row before it."""
    n, depth = words.shape
    order = np.arange(n)
    common = np.full(n, 8 * depth)
    edge = np.zeros(n, bool)
    edge[:1] = True
    common[:1] = 0
    for k in range(depth):
        group = np.cumsum(edge)
        tied = np.flatnonzero(~edge | ~np.append(edge[1:], True))
        if not len(tied):
            break
        key, of = words[order[tied], k], group[tied]
        by = np.lexsort((key, of))
        order[tied] = order[tied][by]
        key = key[by]
        parted = np.flatnonzero((of[1:] == of[:-1]) & (key[1:] != key[:-1])) + 1
        differing = key[parted] ^ key[parted - 1]
        # equal leading bytes of the two words
        equal = np.searchsorted(_TOPS, differing, side="right")
        common[tied[parted]] = 8 * k + 8 - equal
        edge[tied[parted]] = True
    return order, common


#: The least numbers that need 1, 2, ... bytes.
_TOPS = np.array([1 << (8 * i) for i in range(8)], np.uint64)


def _matrix(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Bytes from ``start`` on, forwards or backwards, as rows of big-endian words, zeros behind."""
    width = -(-width // 8) * 8
    column = np.arange(width)
    out = np.empty((len(start), width), np.uint8)
    for i in range(0, len(start), _MATRIX_ROWS):
        some = slice(i, i + _MATRIX_ROWS)
        inside = column < size[some, None]
        at = np.where(inside, start[some, None] + step * column, 0)
        out[some] = np.where(inside, data[at], 0)
    return out.view(">u8").astype(np.uint64)


def repeated_strings(contexts: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """For every row and distance from its anchor, whether that string occurs in another row.

    Row i has the strings that start ``low[i]`` to ``high[i]`` bytes before its anchor,
    which is ``high[i]`` bytes into its context.
    """
    n = len(contexts)
    size = np.fromiter(map(len, contexts), np.int64, n)
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(contexts), np.uint8)
    anchor = begin + high
    ahead, ahead_common = multikey_sort(_matrix(data, anchor, size - high, length, 1))
    back, back_common = multikey_sort(_matrix(data, anchor - 1, high, int(high.max(initial=0)) or 1, -1))
    found = np.zeros((n, length - KMER + 1), bool)
    class_ahead, class_back = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        own = np.flatnonzero((low <= o) & (o <= high))
        if len(own) < 2:
            continue
        class_ahead[ahead] = np.cumsum(ahead_common < length - o)
        class_back[back] = np.cumsum(back_common < o)
        key = class_ahead[own] * (n + 1) + class_back[own]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.append(same, False) | np.insert(same, 0, False)
        found[own[by[hit]], o] = True
    return found


_SPAN = "h1 long, h2 long, start long, stop long"


def _sorted_bucket(length: int):
    """Suffixes sorted by their leading bytes to spans of repeated bytes."""

    def spans(held: pa.Table) -> pa.RecordBatch:
        low, high, at, h1, h2 = (held[c].to_numpy() for c in ("low", "high", "at", "h1", "h2"))
        found = repeated_strings(held["context"].to_pylist(), low, high, length)
        padded = np.pad(found, ((0, 0), (1, 1))).astype(np.int8)
        change = np.diff(padded, axis=1)
        row, first = np.nonzero(change == 1)
        _, stop = np.nonzero(change == -1)
        # the strings that start ``stop - 1`` to ``first`` bytes before the anchor
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (h1[row], h2[row], at[row] - stop + 1, at[row] - first + length)],
            ["h1", "h2", "start", "stop"],
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= _SORT_ROWS:
                table = pa.Table.from_batches(held)
                # the last k-mer may go on in the next batch
                other = pc.not_equal(table["lead"], table["lead"][-1]).to_numpy()
                cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
                if cut:
                    yield spans(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows = len(table) - cut
        if rows:
            yield spans(pa.Table.from_batches(held))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the spans, joined where they meet, out of each text."""
    for batch in batches:
        for some in text_slices(batch, "body"):
            rows = []
            for ident, body, spans in zip(*(some.column(c).to_pylist() for c in ("id", "body", "spans"))):
                kept, at, removed, n = [], 0, 0, 0
                for s in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if s[1] <= at and n:
                        continue
                    if s[0] > at or not n:
                        kept.append(body[at : s[0]])
                        n += 1
                        at = s[0]
                    removed += s[1] - at
                    at = s[1]
                kept.append(body[at:])
                rows.append((ident, len(body), removed, n, b"".join(kept)))
            if rows:
                yield _batch(rows, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    frequent: int = FREQUENT,
) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes left.

    A byte of the UTF-8 text goes if a string of ``length`` bytes over it also starts
    anywhere else, in another row or in the same one; strings are judged on the input
    and never cross rows. Spans that touch are one. Null texts count as empty; a text
    that stands in several rows is a repeat in all of them. ``length`` is at least 64.
    Rows without an id are treated like any other. An empty table gives an empty one.
    Other columns are not read. Documents are read several times and must be the same
    each time.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    n = shuffle_partitions(spark)
    body = whole_text(text_column).cast("binary")
    texts = columns_of(docs, id_column, text_column).select(F.col(id_column).cast("long").alias("id"), body.alias("body"))
    texts = texts.withColumns({"h1": F.xxhash64("body"), "h2": F.xxhash64(F.lit(1), "body")})
    # which k-mers occur again
    repeated = scratch.keep(
        texts.mapInArrow(tidy(_anchor_rows(length, False)), "kmer long").groupBy("kmer").count().where("count > 1")
    )
    where = "kmer long, h1 long, h2 long, at long, first long, last long"
    wanted = scratch.keep(
        texts.mapInArrow(tidy(_anchor_rows(length, True)), where)
        .join(repeated, "kmer")
        .groupBy("h1", "h2")
        .agg(F.collect_set(F.struct("at", "first", "last", (F.col("count") > frequent).alias("frequent"))).alias("wanted"))
    )
    with_wanted = texts.join(wanted, ["h1", "h2"], "left")
    spans = (
        with_wanted.mapInArrow(tidy(_suffixes(length)), _SUFFIX)
        .repartitionByRange(n, "lead")
        .sortWithinPartitions("lead")
        .mapInArrow(tidy(_sorted_bucket(length)), _SPAN)
    )
    if not repeated.where(F.col("count") > frequent).isEmpty():
        strings = scratch.keep(with_wanted.mapInArrow(tidy(_strings(length)), _STRING))
        again = scratch.keep(strings.groupBy("string").count().where("count > 1").drop("count"))
        spans = spans.unionByName(
            strings.join(again, "string").select("h1", "h2", "start", (F.col("start") + length).alias("stop"))
        )
    by_text = spans.groupBy("h1", "h2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return (
        texts.join(by_text, ["h1", "h2"], "left")
        .mapInArrow(tidy(_cut), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
        .withColumnRenamed("id", id_column)
    )
