"""Near-duplicates by SimHash fingerprints and a binary trie self-join.

Fingerprints of 64 bits are taken from word shingles. Equal ones are combined
first. If two differ in at most ``max_bits`` bits, at least one of
``max_bits + 1`` slices of the bits is equal, so that the pair meets in the subtrie
below that slice, in the rotation that puts the slice first. Spark deals these
subtries out; within a task the trie is walked by pairs of nodes, both one bit
deeper at a time, adding up the bits in which the two paths differ, and a pair is
dropped as soon as the sum exceeds ``max_bits``. Subtries that hold too many
fingerprints are cut, before they are dealt out, into pairs of deeper nodes within
the same budget, so that a crowded slice is shared by many tasks. Links become
components by ``components``; a subtrie hands on a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.components import connected_components
from wattframe.llm.scratch import Scratch, columns_of, shuffle_partitions, tidy, whole_text

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: A subtrie with more fingerprints is cut at further bits.
CROWDED = 4096
_BITS = 64
_CHUNK = 1 << 20


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in more than half of the shingles' hashes."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        starts = np.concatenate(([0], ends[: -words] + 1)).tolist()
        stops = ends[words - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts)
        )
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """Bits set in over half. 255 rows of bits are added at a time, eight bytes in one word."""
    counts = np.zeros(_BITS, np.int64)
    for at in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[at : at + 255 * 256].view(np.uint8), bitorder="little")
        lanes = bits.view(np.uint64).reshape(-1, _BITS // 8)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, _BITS).sum(axis=0, dtype=np.int64)
    ones = np.flatnonzero(2 * counts > len(hashes))
    return sum(1 << int(i) for i in ones)


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes(), words) for t in batch.column("text")]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(signed)], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """``(id, fp)`` of each row; null texts count as empty."""
    texts = columns_of(docs, id_column, text_column).select(
        F.col(id_column).cast("long").alias("id"),
        whole_text(text_column).cast("binary").alias("text"),
    )
    return texts.mapInArrow(tidy(_fingerprints(words)), "id long, fp long")


def _slices(max_bits: int) -> list[tuple[int, int]]:
    """First bit, from the top, and width of each slice."""
    n = max_bits + 1
    edges = [round(i * _BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _rotated(fp, first: int):
    """The bits from ``first`` on are put before the others."""
    if first == 0:
        return fp
    return F.shiftleft(fp, first).bitwiseOR(F.shiftrightunsigned(fp, _BITS - first))


def _subtries(distinct: DataFrame, max_bits: int, crowded: int, scratch: Scratch) -> DataFrame:
    """Rows ``(slice, width, depth, head, u, v, turned)``: the two nodes of each starting pair.

    ``head`` is the slice's value, ``u`` and ``v`` are nodes ``depth`` bits below it that
    differ in at most ``max_bits`` bits; ``u = v`` is a node met with itself.
    """
    parts = None
    for k, (first, width) in enumerate(_slices(max_bits)):
        turned = _rotated(F.col("fp"), first)
        part = distinct.select(
            F.lit(k).alias("slice"),
            F.lit(width).alias("width"),
            F.shiftrightunsigned(turned, _BITS - width).alias("head"),
            turned.alias("turned"),
        )
        parts = part if parts is None else parts.unionByName(part)
    bits = F.ceil(F.log2(F.col("count") / F.lit(crowded)))
    counts = scratch.keep(
        parts.groupBy("slice", "head")
        .count()
        .where("count > 1")
        .select("slice", "head", F.greatest(F.lit(0), F.least(F.lit(10), bits)).cast("int").alias("depth"))
    )
    near = f"filter(sequence(0, shiftleft(1, depth) - 1), o -> bit_count(o ^ node) <= {max_bits})"
    return (
        parts.join(counts, ["slice", "head"])
        .withColumn("node", F.expr("cast(shiftright(shiftrightunsigned(shiftleft(turned, width), 1), 63 - depth) as int)"))
        .withColumn("other", F.explode(F.expr(near)))
        .select(
            "slice", "width", "depth", "head", F.least("node", "other").alias("u"),
            F.greatest("node", "other").alias("v"), "turned",
        )
    )


def node_pairs(
    values: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray],
    depth: np.ndarray, spent: np.ndarray, max_bits: int,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk the trie of sorted ``values`` from the given node pairs downwards.

    A node is a range of ``values`` with equal leading ``depth`` bits, ``a`` and ``b``
    are starts and ends of the pairs' nodes, ``spent`` the bits in which their paths
    differ. Yields positions of values that differ in at most ``max_bits`` bits, the
    first below the second. The last piece of work is taken first, so that what
    waits stays small.
    """
    work = [(a[0], a[1], b[0], b[1], depth, spent)]
    while work:
        a0, a1, b0, b1, d, s = work.pop()
        if len(a0) > _CHUNK:
            half = len(a0) // 2
            work.append((a0[:half], a1[:half], b0[:half], b1[:half], d[:half], s[:half]))
            a0, a1, b0, b1, d, s = a0[half:], a1[half:], b0[half:], b1[half:], d[half:], s[half:]
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            close = (np.bitwise_count(values[i] ^ values[j]) <= max_bits) & (i != j)
            if close.any():
                yield i[close], j[close]
            go = ~leaf
            a0, a1, b0, b1, d, s = a0[go], a1[go], b0[go], b1[go], d[go], s[go]
        if not len(a0):
            continue
        shift = (_BITS - 1 - d).astype(np.uint64)
        a_mid = _split(values, a0, a1, shift)
        same = (a0 == b0) & (a1 == b1)
        b_mid = np.where(same, a_mid, _split(values, b0, b1, shift))
        children = [
            (a0, a_mid, b0, b_mid, s, None),
            (a_mid, a1, b_mid, b1, s, None),
            (a0, a_mid, b_mid, b1, s + 1, None),
            (a_mid, a1, b0, b_mid, s + 1, ~same),
        ]
        kept = []
        for x0, x1, y0, y1, cost, more in children:
            live = (x1 > x0) & (y1 > y0) & (cost <= max_bits)
            if more is not None:
                live &= more
            live &= ~((x0 == y0) & (x1 - x0 == 1))  # a leaf with itself
            kept.append((x0[live], x1[live], y0[live], y1[live], d[live] + 1, cost[live]))
        work.append(tuple(np.concatenate(c) for c in zip(*kept)))


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """In each range, the first value whose bit at ``shift`` is 1; by bisection, all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    one = np.uint64(1)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        high = (values[mid] >> shift[open_]) & one == one
        hi[open_] = np.where(high, mid, hi[open_])
        lo[open_] = np.where(high, lo[open_], mid + 1)


class _Forest:
    """Spanning forest of the links seen so far among positions."""

    def __init__(self, n: int):
        self._root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            ri, rj = self._root[i], self._root[j]
            differ = ri != rj
            if not differ.any():
                return
            i, j, ri, rj = i[differ], j[differ], ri[differ], rj[differ]
            np.minimum.at(self._root, np.maximum(ri, rj), np.minimum(ri, rj))
            while not np.array_equal(up := self._root[self._root], self._root):
                self._root = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.flatnonzero(self._root != np.arange(len(self._root)))
        return i, self._root[i]


def _links_of(rows: dict[str, np.ndarray], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links within each starting pair; rows are sorted and hold whole pairs."""
    keys = [rows[c] for c in ("slice", "head", "u", "v")]
    values = rows["turned"].view(np.uint64)
    new = np.zeros(len(values), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(values))
    u, v, width, depth = (rows[c][start] for c in ("u", "v", "width", "depth"))
    at = width.astype(np.int64) + depth
    # where u ends and v begins: the first row whose bit sets differ from u
    node = (values << rows["width"].astype(np.uint64) >> np.uint64(1)) >> (63 - rows["depth"]).astype(np.uint64)
    below = np.add.reduceat((node == rows["u"].astype(np.uint64)).astype(np.int64), start) if len(start) else start
    mid = start + below
    alone = u == v
    forest = _Forest(len(values))
    walk = node_pairs(
        values,
        (start, np.where(alone, end, mid)),
        (np.where(alone, start, mid), end),
        at,
        np.bitwise_count(u ^ v).astype(np.int64),
        max_bits,
    )
    for i, j in walk:
        forest.add(i, j)
    i, j = forest.links()
    first = np.array([a for a, _ in _slices(max_bits)], np.uint64)[rows["slice"][i]]
    back = (np.uint64(_BITS) - first) % np.uint64(_BITS)

    def unturned(x: np.ndarray) -> np.ndarray:
        return ((x >> first) | (x << back)).view(np.int64)

    return unturned(values[i]), unturned(values[j])


_COLUMNS = ["slice", "width", "depth", "head", "u", "v", "turned"]


def _trie_join(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def emit(rows):
            a, b = _links_of(rows, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _COLUMNS}
            if held is not None:
                rows = {c: np.concatenate((held[c], rows[c])) for c in _COLUMNS}
            last = np.ones(len(rows["turned"]), bool)  # the last pair may go on in the next batch
            for c in ("slice", "head", "u", "v"):
                last &= rows[c] == rows[c][-1] if len(last) else last
            cut = int(np.argmax(last)) if len(last) else 0
            held = {c: x[cut:] for c, x in rows.items()}
            if cut:
                yield emit({c: x[:cut] for c, x in rows.items()})
        if held is not None and len(held["turned"]):
            yield emit(held)

    return run


def links(distinct: DataFrame, max_bits: int, scratch: Scratch, crowded: int = CROWDED) -> DataFrame:
    """``(a, b)``: links that connect the same distinct fingerprints as all links do."""
    spark = distinct.sparkSession
    keys = ["slice", "head", "u", "v"]
    dealt = _subtries(distinct, max_bits, crowded, scratch).repartition(shuffle_partitions(spark), *keys)
    return dealt.sortWithinPartitions(*keys, "turned").mapInArrow(tidy(_trie_join(max_bits)), "a long, b long").distinct()


def simhash_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    crowded: int = CROWDED,
) -> DataFrame:
    """One row per input row: its id, ``fingerprint`` as 16 hex digits, and ``component_id``.

    A-Z are lower-cased, words are split at ASCII white space, and shingles count as
    often as they occur; a text with fewer words than a shingle is one shingle, and a
    text without words (a null one too) has fingerprint zero and is linked like any
    other. ``component_id`` is the smallest id that can be reached over links. Rows
    without an id take part; a component of such rows only has a null id. Repeated
    rows each give a row. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(fingerprints(docs, id_column, text_column, shingle_words))
    distinct = scratch.keep(marked.groupBy("fp").agg(F.min("id").alias("least")))
    edges = scratch.keep(links(distinct.select("fp"), max_bits, scratch, crowded))
    roots = connected_components(edges, scratch)
    placed = scratch.keep(
        distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        )
    )
    smallest = scratch.keep(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = scratch.keep(placed.join(smallest, "root").select("fp", "component_id"))
    return marked.join(classes, "fp").select(
        F.col("id").alias(id_column),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
