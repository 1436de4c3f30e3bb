"""Byte-pair encoding of whole corpora through a table of their distinct words.

Texts are split into words where they are read. A block of texts becomes the list
of its distinct words and, for every position, the number of its word in that list.
The lists are dealt out by a hash of the word, so that all blocks that hold a word
send it to one task, which encodes it once; its ids go back to those blocks and are
put in place of the numbers there. Only distinct words, their ids and the numbers
move, packed and compressed; texts do not. Ids become pieces by a join with the
vocabulary, whose size is that of the tokenizer.

Words and numbers are made by two passes over the same rows. The ids that come back
are checked against the numbers' own checksum, and a difference fails the job:
documents whose rows come in another order at each reading must be written first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.scratch import columns_of, shuffle_partitions, tidy, whole_text
from wattframe.llm.words import WordIds, gather, load_tokenizer, split_words, text_slices

#: Distinct words of a block, after which the next one begins.
BLOCK_WORDS = 1 << 18
#: Bytes of text, or of ids, handled at once; four workers share an executor.
SLICE_BYTES = 2 << 20

_WORDS = "bucket int, block long, words binary"
_PARTS = "block long, kind int, part int, ids array<long>, counts binary, body binary, check long"
_KIND_IDS, _KIND_BUCKETS, _KIND_NUMBERS = 0, 1, 2


def _packed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, codec="zstd", asbytes=True)


class _Block:
    """Distinct words of a run of texts, numbered as they first occur."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def add(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words per text, and the words' numbers."""
        offsets, index, dictionary = split_words(texts)
        number = self.number
        coded = np.fromiter(
            (number.setdefault(w, len(number)) for w in dictionary.to_pylist()), np.int32, len(dictionary)
        )
        return np.diff(offsets), coded[index]

    def buckets(self, n: int) -> tuple[list[str], np.ndarray]:
        words = list(self.number)
        return words, np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % n


def _blocks(batches: Iterator[pa.RecordBatch], block_words: int):
    """Yields ``(block, part, (ids, counts, numbers))``, and ``(block, part, words)`` as a block's last."""
    block, part, words = -1, 0, _Block()
    for batch in batches:
        if block < 0 and len(batch):
            block = batch.column("source")[0].as_py() << 32
        for some in text_slices(batch, "text", SLICE_BYTES):
            if len(words.number) >= block_words:
                yield block, part, words
                block, part, words = block + 1, 0, _Block()
            yield block, part, (some.column("id"), *words.add(some.column("text")))
            part += 1
    if part:
        yield block, part, words


def _word_lists(block_words: int, buckets: int):
    """A row for each block and bucket with the block's words of that bucket, in order of number."""

    def run(batches):
        for block, _, found in _blocks(batches, block_words):
            if isinstance(found, _Block):
                words, bucket = found.buckets(buckets)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
                rows = [
                    (int(bucket[order[a]]), block, _sized("\n".join([words[i] for i in order[a:b]]).encode()))
                    for a, b in zip(edges, edges[1:])
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))],
                    ["bucket", "block", "words"],
                )

    return run


def _sized(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _packed(data)


def _unsized(data: bytes) -> bytes:
    return _unpacked(data[8:], int.from_bytes(data[:8], "little"))


def _part(**values) -> pa.RecordBatch:
    """One row of ``_PARTS``."""
    kinds = {
        "block": pa.int64(), "kind": pa.int32(), "part": pa.int32(), "ids": pa.list_(pa.int64()),
        "counts": pa.binary(), "body": pa.binary(), "check": pa.int64(),
    }
    return pa.RecordBatch.from_arrays([pa.array([values.get(k)], t) for k, t in kinds.items()], list(kinds))


def _numbers(block_words: int, buckets: int):
    """Texts as word numbers, and for each block the bucket of every word."""

    def run(batches):
        for block, part, found in _blocks(batches, block_words):
            if isinstance(found, _Block):
                words, bucket = found.buckets(buckets)
                body = _sized(bucket.astype("<i4").tobytes())
                yield _part(block=block, kind=_KIND_BUCKETS, part=part, body=body, check=_check(words, bucket))
            else:
                ids, counts, numbers = found
                yield _part(
                    block=block, kind=_KIND_NUMBERS, part=part, ids=ids.to_pylist(),
                    counts=_sized(counts.astype("<i8").tobytes()), body=_sized(numbers.astype("<i4").tobytes()),
                )

    return run


def _check(words: list[str], bucket: np.ndarray) -> int:
    """Sum over the buckets of the checksum of their words, as ``_encode_lists`` takes it."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    return sum(zlib.crc32("\n".join([words[i] for i in order[a:b]]).encode()) for a, b in zip(edges, edges[1:]))


def _encode_lists(tokenizer_path: str):
    """Word lists, sorted by bucket, to lists of ids; a bucket's distinct words are encoded once."""

    def run(batches):
        ids_of, at = None, None
        tokenizer = load_tokenizer(tokenizer_path)
        for batch in batches:
            for bucket, block, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "words"))):
                if bucket != at:
                    at, ids_of = bucket, WordIds(tokenizer, most=None)
                data = _unsized(packed)
                flat, lengths = ids_of.words(data.decode().split("\n"))
                yield _part(
                    block=block, kind=_KIND_IDS, part=bucket, counts=_sized(lengths.astype("<i8").tobytes()),
                    body=_sized(flat.astype("<u4").tobytes()), check=zlib.crc32(data),
                )

    return run


def _assembled(batches):
    """Parts sorted by block and kind to ``(id, n_tokens, ids)``."""
    block, lists, check = None, {}, 0
    starts = lengths = flat = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != block:
                block, lists, check, flat = row["block"], {}, 0, None
            if row["kind"] == _KIND_IDS:
                lists[row["part"]] = (
                    np.frombuffer(_unsized(row["counts"]), "<i8"), np.frombuffer(_unsized(row["body"]), "<u4")
                )
                check += row["check"]
                continue
            if row["kind"] == _KIND_BUCKETS:
                bucket = np.frombuffer(_unsized(row["body"]), "<i4")
                if check != row["check"] or len(bucket) != sum(len(n) for n, _ in lists.values()):
                    raise ValueError("the documents came in another order at the second reading; write them first")
                order = np.argsort(bucket, kind="stable")
                counts = np.concatenate([lists[b][0] for b in sorted(lists)])
                flat = np.concatenate([lists[b][1] for b in sorted(lists)])
                starts, lengths, lists = np.empty(len(order), np.int64), np.empty(len(order), np.int64), {}
                starts[order], lengths[order] = np.cumsum(counts) - counts, counts
                continue
            words = np.frombuffer(_unsized(row["counts"]), "<i8")
            numbers = np.frombuffer(_unsized(row["body"]), "<i4")
            n = lengths[numbers]
            ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(words)))]
            body = pa.py_buffer(gather(starts[numbers], n, flat).astype("<u4").tobytes())
            offsets = pa.py_buffer((ends * 4).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["ids"], pa.int64()),
                    pa.array(np.diff(ends)),
                    pa.Array.from_buffers(pa.large_binary(), len(words), [None, offsets, body]).cast(pa.binary()),
                ],
                ["id", "n_tokens", "ids"],
            )


def bpe_encode(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per input row: its id, ``n_tokens``, and ``ids`` as little-endian unsigned 32-bit numbers.

    The ids are those of the tokenizer for the whole text without special tokens
    added; special tokens that a text spells out are its own. Null and empty texts
    have no ids. Repeated rows and rows without an id are encoded like any other. An
    empty table gives an empty one. Other columns are not read. The vocabulary file
    has to be at ``tokenizer_path`` on every executor.
    """
    spark = docs.sparkSession
    texts = columns_of(docs, id_column, text_column).select(
        F.col(id_column).cast("long").alias("id"),
        whole_text(text_column).alias("text"),
        F.spark_partition_id().alias("source"),
    )
    n = shuffle_partitions(spark)
    lists = texts.mapInArrow(tidy(_word_lists(block_words, n)), _WORDS)
    found = (
        lists.repartition(n, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(tidy(_encode_lists(tokenizer_path)), _PARTS)
    )
    parts = found.unionByName(texts.mapInArrow(tidy(_numbers(block_words, n)), _PARTS))
    return (
        parts.repartition(n, "block")
        .sortWithinPartitions("block", "kind", "part")
        .mapInArrow(tidy(_assembled), "id long, n_tokens long, ids binary")
        .withColumnRenamed("id", id_column)
    )


def _pieces(tokenizer_path: str) -> pa.Array:
    """The piece of every id; null where the vocabulary has none."""
    tokenizer = load_tokenizer(tokenizer_path)
    by_id = {i: p for p, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    return pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.string())


def _decode(tokenizer_path: str):
    def run(batches):
        pieces = _pieces(tokenizer_path)
        for batch in batches:
            for some in text_slices(batch, "ids", SLICE_BYTES):
                column = some.column("ids")
                ends = np.concatenate(([0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) // 4))
                ids = np.frombuffer(b"".join(column.to_pylist()), "<u4")
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces.take(pa.array(ids)))
                texts = pc.binary_join(lists, " ")
                yield pa.RecordBatch.from_arrays([*some.columns, texts], [*some.schema.names, "decoded"])

    return run


def bpe_decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds ``decoded``: the pieces of ``ids`` with a blank between them.

    That is what a tokenizer file without a decoder gives, special tokens included.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes)
    return encoded.mapInArrow(tidy(_decode(tokenizer_path)), f"{schema}, decoded string")
