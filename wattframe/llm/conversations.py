"""Repair of conversations at the least cost.

The turns of all conversations are put in order by a range partitioning, so that one
conversation may lie in many partitions, and cut into segments of bounded size. A segment
that is a whole conversation is repaired by itself. Segments of longer conversations
first become tables of costs from state to state, which are chained from the end; then
each segment knows its cheapest ways, and the states at the cuts follow from the start.
Only these tables, one small row for each segment, meet by conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wattframe.llm.audit_paths import DELETE, FINAL, INSERT, LETTERS, REROLE, AFTER_U, FAR, START, TRUNCATED_COST, Turns, costs_to_end, least_paths
from wattframe.llm.scratch import Scratch, shuffle_partitions, tidy

Batches = Iterator[pa.RecordBatch]

#: Turns and bytes of a segment, about.
SEGMENT_TURNS = 1024
SEGMENT_BYTES = 4 << 20
#: White space, and marks that end a whole sentence.
WHITE = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = ".!?"

SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[0, 1] = _LEGAL[1, 2] = _LEGAL[2, 1] = True


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)`` with a twentieth of the rows lost, and others spoilt.

    Nulls are read as one blank, in the key as well; ``conv_id`` and ``turn`` stay null.
    """
    blank = F.lit(" ")
    known = {c: F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.concat(known["conv_id"], F.lit(":"), known["turn"]).cast("binary")) % 20
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(known["role"]).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(known["text"], SENTENCE_ENDS, "")).otherwise(known["text"]).alias("text"),
        F.when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    ).where(fault != 0)


def _graded(rows: DataFrame) -> DataFrame:
    """Each turn's distinct messages with their first fault, and how many copies there are.

    A message that has been met in the conversation before is found by the first turn
    of its (role, text): no row is compared with all others of its conversation, and
    copies are counted before anything is shuffled.
    """
    digest = F.sha2(F.col("text").cast("binary"), 256)
    keys = [F.col("conv_id"), F.col("role"), digest.alias("digest")]
    turns = rows.groupBy("conv_id", "turn", "role", digest.alias("digest")).agg(
        F.sum("copies").alias("copies"), F.first("text").alias("text")
    )
    firsts = rows.groupBy(*keys).agg(F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("turn"))
    firsts = firsts.select(
        "conv_id", "role", "digest", F.when(~F.col("unnumbered"), F.col("turn")).alias("turn"), F.lit(True).alias("first")
    )
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "turn", "role", "digest")]
    met = turns.alias("t").join(firsts.alias("f").hint("merge"), same, "left")
    said = F.rtrim(F.col("t.text"), F.lit(WHITE))
    ended = F.right(said, F.lit(1)).isin(*SENTENCE_ENDS)
    fault = F.when(said == "", BLANK).when(F.col("f.first").isNull(), DUPLICATE).when(~ended, TRUNCATED).otherwise(SOUND)
    initial = F.substring("t.role", 1, 1)
    return met.select(
        "t.conv_id",
        "t.turn",
        "t.role",
        "t.text",
        "t.copies",
        fault.alias("fault"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
    )


def _segments(segment_turns: int):
    """Segments of the sorted turns, one row each, with lists of what their turns hold."""

    def run(batches: Batches) -> Batches:
        part, seq = TaskContext.get().partitionId(), 0
        held: pa.RecordBatch | None = None
        # the first segment may go on from the partition before
        goes_on = True

        def cut(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            """Where segments begin, and which of them begin a conversation."""
            codes = rows.column("conv_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            fresh = np.append(True, codes[1:] != codes[:-1])
            at = np.arange(len(codes))
            run = np.maximum.accumulate(np.where(fresh, at, 0))
            sizes = np.cumsum(pc.binary_length(rows.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            piece = (at - run) // segment_turns + (sizes - sizes[run]) // SEGMENT_BYTES
            begins = fresh | np.append(True, piece[1:] != piece[:-1])
            return np.flatnonzero(begins), fresh

        def made(rows: pa.RecordBatch, starts: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
            nonlocal seq
            offsets = pa.array(np.append(starts, len(rows)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, rows.column(c)) for c in ("role", "text", "copies", "fault", "initial")]
            numbers = pa.array(np.arange(seq, seq + len(starts)), pa.int64())
            seq += len(starts)
            return pa.RecordBatch.from_arrays(
                [rows.column("conv_id").take(pa.array(starts)), pa.array(np.full(len(starts), part), pa.int32()), numbers, pa.array(whole), *lists],
                ["conv_id", "part", "seq", "whole", "role", "text", "copies", "fault", "initial"],
            )

        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            if not len(rows):
                continue
            starts, fresh = cut(rows)
            begins_run = fresh[starts]
            begins_run[0] = not goes_on
            if len(starts) > 1:
                whole = begins_run[:-1] & fresh[starts[1:]]
                yield made(rows.slice(0, starts[-1]), starts[:-1], whole)
                goes_on = not begins_run[-1]
            held = rows.slice(starts[-1])
        if held is not None and len(held):
            yield made(held, np.zeros(1, np.int64), np.zeros(1, bool))

    return run


def _turns(batch: pa.RecordBatch) -> Turns:
    def flat(name: str) -> np.ndarray:
        return batch.column(name).flatten().to_numpy(zero_copy_only=False)

    lengths = pc.list_value_length(batch.column("fault")).to_numpy(zero_copy_only=False).astype(np.int64)
    fault = flat("fault")
    return Turns(
        flat("initial"),
        (fault == BLANK) | (fault == DUPLICATE),
        np.where(fault == TRUNCATED, TRUNCATED_COST, 0).astype(np.int64),
        np.concatenate(([0], np.cumsum(lengths))),
    )


def _tables(batches: Batches) -> Batches:
    """The costs of a segment from each state to each state, row by row, and its first and last role."""
    for batch in batches:
        turns = _turns(batch)
        units = np.where(np.eye(4, dtype=bool), 0, FAR)
        costs = costs_to_end(turns, np.broadcast_to(units, (len(batch), 4, 4)).copy())
        begin = turns.starts[:-1] + np.arange(len(batch))
        table = costs[begin].transpose(0, 2, 1).reshape(-1)
        offsets = pa.array(np.arange(len(batch) + 1) * 16, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("conv_id", "part", "seq")),
                pa.ListArray.from_arrays(offsets, pa.array(table, pa.int64())),
                pa.array(turns.role[turns.starts[:-1]], pa.int32()),
                pa.array(turns.role[turns.starts[1:] - 1], pa.int32()),
            ],
            ["conv_id", "part", "seq", "table", "first", "last"],
        )


def _by_conversation(batches: Batches) -> Iterator[tuple[bool, dict]]:
    """Rows of sorted batches, and whether each begins a conversation."""
    begun, before = False, None
    for batch in batches:
        for row in batch.to_pylist():
            yield not begun or row["conv_id"] != before, row
            begun, before = True, row["conv_id"]


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 10_000) -> Batches:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in held], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays(columns, names)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held.clear()
    if held:
        yield batch()


def _exits(batches: Batches) -> Batches:
    """What each state at a segment's end costs, for segments from the last to the first."""

    def rows() -> Iterator[tuple]:
        exits, follower = FINAL, None
        for begins, row in _by_conversation(batches):
            if begins:
                exits, follower = FINAL, None
            crossing = int(follower is not None and not _LEGAL[row["last"], follower])
            yield row["part"], row["seq"], exits.tolist(), follower is None, crossing
            table = np.array(row["table"]).reshape(4, 4)
            exits, follower = np.minimum((table + exits).min(axis=1), FAR), row["first"]

    return _batched(rows(), ["part", "seq", "exits", "final", "crossing"], [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64()])


def _entries(batches: Batches) -> Batches:
    """The state each segment begins in, for segments from the first to the last."""

    def rows() -> Iterator[tuple]:
        entry = START
        for begins, row in _by_conversation(batches):
            entry = START if begins else entry
            yield row["part"], row["seq"], entry
            entry = row["leads"][entry]

    return _batched(rows(), ["part", "seq", "entry"], [pa.int32(), pa.int64(), pa.int32()])


def _exit_costs(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("exits").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), 4)


def _leads(batches: Batches) -> Batches:
    """For each state at a segment's start the state in which its least path ends."""
    for batch in batches:
        turns, exits = _turns(batch), _exit_costs(batch)
        costs = costs_to_end(turns, exits[:, None, :])[:, 0]
        final = batch.column("final").to_numpy(zero_copy_only=False)
        ends = np.stack([least_paths(turns, costs, np.full(len(batch), s), final).exit_state for s in range(4)], axis=1)
        offsets = pa.array(np.arange(len(batch) + 1) * 4, pa.int32())
        leads = pa.ListArray.from_arrays(offsets, pa.array(ends.reshape(-1), pa.int32()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "seq")), leads], ["conv_id", "part", "seq", "leads"])


def _starts(of: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``of`` up to each of the starts."""
    return np.concatenate(([0], np.cumsum(of)))[starts]


def _repaired(batches: Batches) -> Batches:
    for batch in batches:
        if not len(batch):
            continue
        turns, exits = _turns(batch), _exit_costs(batch)
        costs = costs_to_end(turns, exits[:, None, :])[:, 0]
        entry = batch.column("entry").to_numpy(zero_copy_only=False).astype(np.int64)
        paths = least_paths(turns, costs, entry, batch.column("final").to_numpy(zero_copy_only=False))
        copies = batch.column("copies").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        fault = batch.column("fault").flatten().to_numpy(zero_copy_only=False)

        # every copy after the first is deleted right after it
        inserted = paths.letter == INSERT
        own = np.minimum(paths.turn, max(len(copies) - 1, 0))
        width = np.where(inserted, 1, copies[own]) if len(copies) else np.ones(len(own), np.int64)
        audit = np.full(int(width.sum()), LETTERS[DELETE])
        audit[np.cumsum(width) - width] = LETTERS[paths.letter]
        audit_at = _starts(width, paths.starts)
        audits = pa.LargeStringArray.from_buffers(len(batch), pa.py_buffer(audit_at.astype(np.int64)), pa.py_buffer(audit))

        stays = paths.letter != DELETE
        letter, turn, state = paths.letter[stays], own[stays], paths.state[stays]
        given = np.where(state == AFTER_U, 0, 1)
        n = len(copies)
        roles = pa.concat_arrays([batch.column("role").flatten().cast(pa.string()), pa.array(["user", "assistant"], pa.string())])
        texts = pa.concat_arrays([batch.column("text").flatten().cast(pa.string()), pa.array([""], pa.string())])
        role = roles.take(pa.array(np.where((letter == INSERT) | (letter == REROLE), n + given, turn)))
        text = texts.take(pa.array(np.where(letter == INSERT, n, turn)))
        messages = pa.ListArray.from_arrays(
            pa.array(_starts(stays, paths.starts), pa.int32()), pa.StructArray.from_arrays([role, text], ["role", "text"])
        )

        further = copies - 1
        pair = np.zeros(n, bool)
        if n:
            pair[:-1] = ~_LEGAL[turns.role[:-1], turns.role[1:]]
            pair[turns.starts[1:] - 1] = False

        def total(of: np.ndarray) -> pa.Array:
            return pa.array(np.diff(_starts(of, turns.starts)).astype(np.int64))

        crossing = batch.column("crossing").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("conv_id", "part", "seq", "whole")),
                total(np.where(fault == BLANK, copies, 0)),
                total(np.where(fault == DUPLICATE, copies, np.where(fault == BLANK, 0, further))),
                total(fault == TRUNCATED),
                pc.add(total(pair + further), pa.array(crossing, pa.int64())),
                pa.array(paths.cost + 4 * np.diff(_starts(further, turns.starts)), pa.int64()),
                audits.cast(pa.string()),
                messages,
            ],
            ["conv_id", "part", "seq", "whole", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "messages"],
        )


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """Repaired segments of the conversations, to be read in the order of ``part`` and ``seq``.

    ``rows`` are ``(conv_id, turn, role, text, copies)`` without null roles and texts;
    nulls of ``conv_id`` are one conversation. Rows are taken by turn, nulls first,
    then by role and text in byte order; equal rows and ``copies`` follow each other.
    A row's first fault counts: no character but white space, role and text met
    before, or an end that is no sentence's end. Keep is free, another role costs 3,
    a turn deleted 4, an empty turn inserted 3, and truncated turns 3 more if they
    stay. A role whose initial is not s, u or a, an empty one too, cannot be kept.

    Returned are ``(conv_id, part, seq, whole, blank, duplicate, truncated, illegal,
    cost, audit, messages)``: counts, costs, letters of the edits and repaired messages
    of a segment; ``whole`` where it is the conversation's only one for certain. An
    empty table gives an empty one. The result is written to the shared folder.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "conversations")
    order = ["conv_id", "turn", "role", "text"]
    ordered = _graded(rows).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    key = rows.schema["conv_id"]
    place = [key, T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType())]
    lists = [("role", T.StringType()), ("text", T.StringType()), ("copies", T.LongType()), ("fault", T.IntegerType()), ("initial", T.IntegerType())]
    segment = T.StructType([*place, T.StructField("whole", T.BooleanType()), *(T.StructField(n, T.ArrayType(t)) for n, t in lists)])
    segments = scratch.keep(ordered.select("conv_id", *(n for n, _ in lists)).mapInArrow(tidy(_segments(segment_turns)), segment))

    parts = segments.where(~F.col("whole"))
    n = shuffle_partitions(spark)
    small = parts.select("conv_id", "part", "seq", "copies", "fault", "initial")
    tables = small.mapInArrow(
        tidy(_tables), T.StructType([*place, T.StructField("table", T.ArrayType(T.LongType())), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
    )
    exits = scratch.keep(
        tables.repartition(n, "conv_id")
        .sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
        .mapInArrow(tidy(_exits), "part int, seq long, exits array<bigint>, final boolean, crossing long")
    )
    leads = small.join(exits.hint("merge"), ["part", "seq"]).mapInArrow(
        tidy(_leads), T.StructType([*place, T.StructField("leads", T.ArrayType(T.IntegerType()))])
    )
    entries = (
        leads.repartition(n, "conv_id")
        .sortWithinPartitions("conv_id", "part", "seq")
        .mapInArrow(tidy(_entries), "part int, seq long, entry int")
    )
    linked = parts.join(exits.hint("merge"), ["part", "seq"]).join(entries.hint("merge"), ["part", "seq"])
    alone = segments.where("whole").withColumns(
        {
            "exits": F.lit(FINAL.tolist()).cast("array<bigint>"),
            "final": F.lit(True),
            "crossing": F.lit(0).cast("long"),
            "entry": F.lit(START),
        }
    )
    message = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    found = T.StructType(
        [
            *place,
            T.StructField("whole", T.BooleanType()),
            *(T.StructField(c, T.LongType()) for c in _COUNTS),
            T.StructField("audit", T.StringType()),
            T.StructField("messages", T.ArrayType(message)),
        ]
    )
    return scratch.keep(alone.unionByName(linked).mapInArrow(tidy(_repaired), found))


def _folded(key: pa.DataType):
    """Audit and digest of conversations of several segments, read in order with one of them in memory."""

    def rows(batches: Batches) -> Iterator[tuple]:
        conv, audit, digest, empty = None, None, None, True
        for begins, row in _by_conversation(batches):
            if begins:
                if audit is not None:
                    yield conv, "".join(audit), digest.hexdigest()
                conv, audit, digest, empty = row["conv_id"], [], hashlib.sha256(), True
            audit.append(row["audit"])
            if row["messages"]:
                digest.update((("" if empty else "\n") + "\n".join(f"{m['role']}:{m['text']}" for m in row["messages"])).encode())
                empty = False
        if audit is not None:
            yield conv, "".join(audit), digest.hexdigest()

    def run(batches: Batches) -> Batches:
        yield from _batched(rows(batches), ["conv_id", "audit", "repaired_sha256"], [key, pa.string(), pa.string()], size=100)

    return run


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv_id, audit, repaired_sha256)`` of each conversation of ``repair``.

    The digest covers the messages as ``role:text`` joined by newlines. Conversations of
    several segments are hashed by one task each, as a digest has to be, from sorted rows
    that pass by one at a time.
    """
    line = F.transform("messages", lambda m: F.concat(m.role, F.lit(":"), m.text))
    alone = repaired.where("whole").select(
        "conv_id", "audit", F.sha2(F.array_join(line, "\n").cast("binary"), 256).alias("repaired_sha256")
    )
    key = repaired.schema["conv_id"]
    found = T.StructType([key, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    joined = (
        repaired.where(~F.col("whole"))
        .select("conv_id", "part", "seq", "audit", "messages")
        .repartition(shuffle_partitions(repaired.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "part", "seq")
        .mapInArrow(tidy(_folded(to_arrow_type(key.dataType))), found)
    )
    return alone.unionByName(joined)


def summary(conversations: DataFrame, rows: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """One row for each ``conv_id`` of ``conversations``, with faults, cost, audit and digest of ``rows`` repaired.

    Conversations without a row left have zeros, no audit and the digest of nothing.
    """
    repaired = repair(rows, segment_turns)
    counts = repaired.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    turns = rows.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    result = conversations.select(F.col("conv_id").alias("key")).distinct()
    for part in (turns, counts, digests(repaired)):
        named = part.withColumnRenamed("conv_id", "own")
        result = result.join(named.hint("merge"), F.col("key").eqNullSafe(F.col("own")), "left").drop("own")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return result.select(
        F.col("key").alias("conv_id"),
        *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS)),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )
