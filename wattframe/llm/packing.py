"""Packing documents into sequences of a fixed number of tokens.

Texts are tokenized where they are read; only pieces longer than a sequence are
cut. How many pieces there are of each length is a table of at most ``capacity``
rows, whatever the corpus holds, and bin completion works on that: for the longest
piece left, the undominated fillings of the rest of its sequence are enumerated,
branches are cut by the waste they leave, and best-fit decreasing is the first
incumbent. A filling found is used as often as the pieces left allow, so that the
result is a short table of patterns. Pieces then find their place by their number
among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.scratch import Scratch, columns_of, tidy, whole_text
from wattframe.llm.words import WordIds, load_tokenizer, text_slices

CAPACITY = 2048
END_ID = 0
#: Branches that the search may try before it settles for the incumbent.
SEARCH_NODES = 8_000
#: Fillings looked at for one sequence, and of these how many are branched on.
FILLINGS, BRANCHES = 400, 4
#: Text tokenized at once; the more, the fewer words are looked up twice.
_SLICE_BYTES = 8 << 20

Pattern = tuple[tuple[int, int], ...]  # (length, how often) with falling lengths

PIECES = "id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def _pieces(tokenizer_path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(load_tokenizer(tokenizer_path))
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far
        for batch in batches:
            for some in text_slices(batch, "text", _SLICE_BYTES):
                part = some.column("source")[0].as_py()
                ids, counts = ids_of.texts(some.column("text"))
                ends = np.cumsum(counts)
                closed = np.insert(ids, ends, np.uint32(end_id)).astype("<u4", copy=False)
                begins = (ends - counts + np.arange(len(counts))).tolist()
                rows = []
                for doc, begin, n in zip(some.column("id").to_pylist(), begins, counts.tolist()):
                    for piece, start in enumerate(range(0, n + 1, capacity)):
                        length = min(capacity, n + 1 - start)
                        crc = zlib.crc32(closed[begin + start : begin + start + length])
                        rows.append((doc, piece, start, length, crc, part, int(seen[length])))
                        seen[length] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(x, pa.int32() if name in ("piece", "part") else pa.int64())
                            for name, x in zip(_NAMES, zip(*rows))
                        ],
                        _NAMES,
                    )

    return run


_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over lengths with counts: equal sequences are filled together."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}  # by room left
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                each = min(capacity // length, left)
                times = left // each
                open_.setdefault(capacity - each * length, []).append((((length, each),), times))
                left -= each * times
                continue
            pattern, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
            each = min(room // length, left)
            used = min(times, left // each)
            if used < times:
                open_.setdefault(room, []).append((pattern, times - used))
            open_.setdefault(room - each * length, []).append((pattern + ((length, each),), used))
            left -= each * used
    return [x for some in open_.values() for x in some]


def _holds(sizes: list[int], items: list[int]) -> bool:
    """Whether the items can be dealt out to bins of the given sizes."""
    if not items:
        return True
    tried = set()
    for i, room in enumerate(sizes):
        if room >= items[0] and room not in tried:
            tried.add(room)
            if _holds(sizes[:i] + [room - items[0]] + sizes[i + 1 :], items[1:]):
                return True
    return False


def _dominates(a: list[int], b: list[int]) -> bool:
    """Filling ``b`` can be dealt out into the pieces of ``a``, so ``a`` is at least as good."""
    return len(a) <= len(b) <= 8 and sum(a) >= sum(b) and _holds(a, b)


def completions(lengths: list[int], counts: dict[int, int], room: int) -> list[Pattern]:
    """Undominated fillings of ``room``, the least waste first.

    ``lengths`` fall. Longer pieces are tried first; the search ends at FILLINGS
    steps, or when enough fillings without waste are known.
    """
    found: list[tuple[int, list[int]]] = []
    steps = 0
    stack: list[tuple[int, int, list[int]]] = [(0, room, [])]
    full = 0
    while stack and steps < FILLINGS and full < BRANCHES:
        at, left, items = stack.pop()
        steps += 1
        at = max(at, bisect_left(lengths, -left, key=neg))  # the longest that still fits
        while at < len(lengths) and counts[lengths[at]] <= items.count(lengths[at]):
            at += 1
        if at == len(lengths):
            if not any(counts[x] > items.count(x) for x in lengths[-1:] if x <= left):
                found.append((left, items))
                full += left == 0
            continue
        stack.append((at + 1, left, items))
        each = min(left // lengths[at], counts[lengths[at]] - items.count(lengths[at]))
        for n in range(1, each + 1) if each <= 3 else (1, each):
            stack.append((at + 1, left - n * lengths[at], items + [lengths[at]] * n))
    found.sort(key=lambda x: (x[0], len(x[1])))
    kept: list[list[int]] = []
    for _, items in found:
        if len(kept) < BRANCHES and not any(_dominates(k, items) for k in kept):
            kept.append(items)
    return [tuple((x, items.count(x)) for x in dict.fromkeys(items)) for items in kept] or [()]


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = SEARCH_NODES) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used, so that every piece is placed once."""
    counts = {k: n for k, n in counts.items() if n}
    total = sum(k * n for k, n in counts.items())
    best = best_fit_decreasing(counts, capacity)
    best_bins = sum(n for _, n in best)
    least = -(-total // capacity)
    stack = [(counts, 0, 0, ())]  # pieces left, sequences used, waste, patterns as a linked list
    while stack and nodes and best_bins > least:
        left, bins, waste, made = stack.pop()
        nodes -= 1
        if not left:
            if bins < best_bins:
                best_bins, best = bins, []
                while made:
                    head, made = made
                    best.append(head)
            continue
        if waste > (best_bins - 1) * capacity - total:
            continue
        lengths = sorted(left, reverse=True)
        longest = lengths[0]
        rest = dict(left)
        rest[longest] -= 1
        for filling in reversed(completions(lengths, rest, capacity - longest)):
            pattern = dict(filling)
            pattern[longest] = pattern.get(longest, 0) + 1
            times = min(left[k] // n for k, n in pattern.items())
            after = {k: m for k, n in left.items() if (m := n - times * pattern.get(k, 0))}
            spare = capacity - sum(k * n for k, n in pattern.items())
            # the last, partly filled sequence may stay open: it alone is no waste
            lost = waste + spare * (times if after else times - 1)
            ordered = tuple(sorted(pattern.items(), reverse=True))
            stack.append((after, bins + times, lost, ((ordered, times), made)))
    return best


def places(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, first, last, sequence, each, offset)``.

    The pieces numbered ``first`` up to ``last`` of that length go, ``each`` to one
    sequence, to the sequences from ``sequence`` on, at ``offset`` and behind it.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            first = used.get(length, 0)
            used[length] = first + each * times
            rows.append((length, first, used[length], sequence, each, offset))
            offset += each * length
        sequence += times
    return rows


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A document is its ids followed by ``end_id``; a null or empty text is ``end_id``
    alone. Documents of more than ``capacity`` tokens are cut into pieces of that
    many, the last may be shorter. Repeated rows and rows without an id are packed
    like any other. An empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    texts = columns_of(docs, id_column, text_column).select(
        F.col(id_column).cast("long").alias("id"),
        whole_text(text_column).alias("text"),
        F.spark_partition_id().alias("source"),
    )
    pieces = scratch.keep(texts.mapInArrow(tidy(_pieces(tokenizer_path, capacity, end_id)), PIECES))
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.keep(by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    # at most one row per length
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.createDataFrame(
        places(bin_completion(counts, capacity)),
        "length long, first long, last long, sequence long, each long, at long",
    )
    number = F.col("base") + F.col("rank")
    placed = pieces.join(base.drop("n"), ["part", "length"]).withColumn("number", number)
    # the table follows the lengths, not the pieces, so its size is bounded by the capacity
    return placed.join(F.broadcast(table), ["length"]).where("number >= first AND number < last").select(
        F.col("id").alias(id_column),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.floor((F.col("number") - F.col("first")) / F.col("each"))).alias("sequence_id"),
        (F.col("at") + (F.col("number") - F.col("first")) % F.col("each") * F.col("length")).alias("offset"),
    )
