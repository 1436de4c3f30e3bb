"""State that streams keep of the recent span.

A day is open until the watermark, the newest time seen less a horizon, has passed its
end; until then all that matters of it is in the state, and the tables need not be read.
Rows of days that have ended are late. They are handed on as such, however late they
come, and dealt with by what is stored. Rows without a time count as late too.

The state lies in a fixed number of groups, dealt by a hash, so no point makes a group
of its own. A group drops the days that have ended whenever it gets rows, before it adds
to its state; it so holds no more than open days did when it last got some. Timeouts are
not used: by event time the engine would drop late rows, by processing time a run over
what is there would never end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Span before the newest time seen that is kept in the state.
HORIZON = "3 days"
#: Groups of the state. A group's state is read and written whole, so it should stay within some megabytes.
SPREAD = 8
#: State of a group that ``spread_for`` allows.
GROUP_BYTES = 1 << 22

#: Rows of a group come to the state in packs of about so many bytes, so that 10,000 of them are some 40 MB.
PACK_BYTES = 1 << 12
#: Rows, or bytes, of a task in which copies are looked for and from which packs are made.
GATHERED_ROWS, GATHERED_BYTES = 1 << 16, 1 << 25
#: Packs that are opened together.
PACKS_AT_ONCE = 1 << 10

_PACK = ["share", "newest", "hashes", "days", "rows"]
_DAY_MS = 24 * 3600 * 1000
_NO_DAY = np.iinfo(np.int32).min


def _days(times: pd.Series) -> np.ndarray:
    """Days since 1970 of times in UTC; a time that is missing has the least day."""
    missing = times.isna().to_numpy()
    days = times.to_numpy().astype("datetime64[D]").astype(np.int64)
    return np.where(missing, _NO_DAY, days).astype(np.int32)


def _ended(days: np.ndarray, state: GroupState) -> np.ndarray:
    """Which days the watermark has passed; those that are not known have ended."""
    return (days.astype(np.int64) + 1) * _DAY_MS <= state.getCurrentWatermarkMs()


def spread_for(rows: int) -> int:
    """Groups for a stream with about so many rows in its open days, at 20 bytes each."""
    return max(SPREAD, -(-20 * rows // GROUP_BYTES))


def digest(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of a row; nulls are told apart from missing values next to them."""
    parts = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= GATHERED_ROWS or sum(x.nbytes for x in held) >= GATHERED_BYTES:
            yield pa.concat_batches(held)
            held = []
    if sum(map(len, held)):
        yield pa.concat_batches(held)


def _packed(batches: Iterator[pa.RecordBatch], columns: list[str], time: str, spread: int) -> Iterator[pa.RecordBatch]:
    """Rows without their copies nearby, some of a group as one: their hashes, their days and all columns as bytes.

    The columns are followed by both hashes and the day.
    """
    for batch in _gathered(batches):
        h1, h2, days = (x.to_numpy() for x in batch.columns[-3:])
        once = np.flatnonzero(~pd.DataFrame({"h1": h1, "h2": h2}).duplicated().to_numpy())
        share = np.mod(h1[once], spread)
        order = np.argsort(share, kind="stable")
        once, share = once[order], share[order]
        rows = batch.select(list(range(len(columns)))).take(pa.array(once))
        # packs begin where a group does, and after so many rows of it
        most = max(1, PACK_BYTES * len(rows) // (rows.nbytes + 20 * len(rows)))
        first = np.flatnonzero(np.diff(share, prepend=-1))
        ends = np.append(first[1:], len(share))
        starts = np.concatenate([np.arange(a, b, most) for a, b in zip(first, ends)])
        ends = np.append(starts[1:], len(share))
        at = rows.column(columns.index(time))
        known = at.is_valid().to_numpy(zero_copy_only=False)
        micros = at.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
        days = days[once].astype("<i4")
        pairs = np.stack((h1[once], h2[once]), axis=1).astype("<i8")
        some = np.logical_or.reduceat(known, starts)
        newest = pa.array(np.maximum.reduceat(micros, starts), mask=~some).cast(at.type)
        cut = [(int(a), int(b)) for a, b in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(share[starts]),
                newest,
                pa.array([pairs[a:b].tobytes() for a, b in cut], pa.binary()),
                pa.array([days[a:b].tobytes() for a, b in cut], pa.binary()),
                pa.array([rows.slice(a, b - a).serialize().to_pybytes() for a, b in cut], pa.binary()),
            ],
            names=_PACK,
        )


def _unpacked(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The kept rows of packs, each with what is said of it."""
    for batch in batches:
        for i in range(0, len(batch), PACKS_AT_ONCE):
            part = batch.slice(i, PACKS_AT_ONCE)
            rows = pa.Table.from_batches([pa.ipc.read_record_batch(x.as_buffer(), schema) for x in part.column("rows")])
            kept, late = (np.frombuffer(b"".join(part.column(c).to_pylist()), bool) for c in ("kept", "late"))
            yield from rows.append_column("late", pa.array(late)).filter(pa.array(kept)).combine_chunks().to_batches()


#: First and second hash and day of rows, in the order of the first hash.
_Run = tuple[np.ndarray, np.ndarray, np.ndarray]


def _with_run(runs: list[_Run], *rows: np.ndarray) -> list[_Run]:
    """Runs with further rows, each at least twice as long as the next, so that a row is moved a few times only."""
    if not len(rows[0]):
        return runs
    runs = [*runs, rows]
    while len(runs) > 1 and len(runs[-2][0]) < 2 * len(runs[-1][0]):
        runs[-2:] = [tuple(np.concatenate(x) for x in zip(*runs[-2:]))]
    order = np.argsort(runs[-1][0], kind="stable")
    return [*runs[:-1], tuple(x[order] for x in runs[-1])]


def _held(h1: np.ndarray, h2: np.ndarray, runs: list[_Run]) -> np.ndarray:
    """Which pairs of hashes are in one of the runs."""
    found = np.zeros(len(h1), bool)
    for first, second, _ in runs:
        at = np.searchsorted(first, h1)
        left = np.flatnonzero(at < len(first))
        # more than once only where first hashes are equal and second ones are not
        while len(left):
            left = left[first[at[left]] == h1[left]]
            same = second[at[left]] == h2[left]
            found[left[same]] = True
            left = left[~same]
            at[left] += 1
            left = left[at[left] < len(first)]
    return found


def fresh_rows(
    rows: DataFrame, columns: list[str], time: str = "timestamp", horizon: str = HORIZON, spread: int = SPREAD
) -> DataFrame:
    """A stream's rows without the copies of what the state holds, ``late`` telling which it cannot vouch for.

    The state holds 20 bytes for each different row of an open day. ``spread`` stays as it was when
    a stream goes on from its checkpoint.

    The engine hands a group's state to Python again with every 10,000 rows of the group (with every
    batch of ``spark.sql.execution.arrow.maxRecordsPerBatch``) and keeps dozens of these batches. So
    the rows come to the state in packs, of which a group rarely has that many.
    """
    kept = rows.select(*columns)
    h1, h2 = digest(columns)
    day = F.coalesce(F.unix_date(F.to_date(time)), F.lit(int(_NO_DAY)))
    hashed = kept.select("*", h1.alias("h1"), h2.alias("h2"), day.alias("days"))
    packs = T.StructType([T.StructField(c, t) for c, t in zip(_PACK, (T.LongType(), rows.schema[time].dataType, *[T.BinaryType()] * 3))])
    grouped = hashed.mapInArrow(lambda x: _packed(x, columns, time, spread), packs).withWatermark("newest", horizon).groupBy("share")

    def unseen(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, days = (np.frombuffer(x, k) for x, k in zip(state.get if state.exists else (b"", b""), ("<i8", "<i4")))
        open_ = ~_ended(days, state)
        runs = _with_run([], seen[::2][open_], seen[1::2][open_], days[open_])
        del seen, days
        for frame in (f.iloc[i : i + PACKS_AT_ONCE] for f in frames for i in range(0, len(f), PACKS_AT_ONCE)):
            own = np.frombuffer(b"".join(frame["hashes"]), "<i8")
            own1, own2, own_days = own[::2], own[1::2], np.frombuffer(b"".join(frame["days"]), "<i4")
            late = _ended(own_days, state)
            # the state has no late rows, as their days are not in it
            new = ~pd.DataFrame({"h1": own1, "h2": own2}).duplicated().to_numpy()
            new[~late] &= ~_held(own1[~late], own2[~late], runs)
            fresh = new & ~late
            runs = _with_run(runs, own1[fresh], own2[fresh], own_days[fresh])
            ends = np.cumsum([len(x) // 4 for x in frame["days"]])
            cut = list(zip([0, *ends[:-1]], ends))
            said = frame[["rows"]].assign(kept=[new[a:b].tobytes() for a, b in cut], late=[late[a:b].tobytes() for a, b in cut])
            yield said[[any(x) for x in said["kept"]]]
        h1, h2, days = (np.concatenate(x) for x in zip(*runs)) if runs else (np.empty(0, k) for k in ("<i8", "<i8", "<i4"))
        state.update((np.stack((h1, h2), axis=1).astype("<i8").tobytes(), days.astype("<i4").tobytes()))

    fresh = grouped.applyInPandasWithState(
        unseen, "rows binary, kept binary, late binary", "seen binary, days binary", "update", GroupStateTimeout.NoTimeout
    )
    schema = rows.sparkSession.createDataFrame([], kept.schema).toArrow().schema
    found = T.StructType([*kept.schema.fields, T.StructField("late", T.BooleanType())])
    return fresh.mapInArrow(lambda x: _unpacked(x, schema), found)


_TOTALS = ("total", "n")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and counts per point and hour within a batch, before anything is shuffled."""
    for batch in batches:
        sums = pa.table(batch).group_by(["settlement_point", "timestamp"]).aggregate([("price", "sum"), ("price", "count")])
        sums = sums.rename_columns(["settlement_point", "timestamp", *_TOTALS])
        yield from sums.select(["settlement_point", "timestamp", *_TOTALS]).to_batches()


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.groupby(["settlement_point", "timestamp"], dropna=False, as_index=False)[list(_TOTALS)].sum()


def hour_totals(market: DataFrame, horizon: str = HORIZON, spread: int = SPREAD) -> DataFrame:
    """Sums and counts per point and hour: ``(share, settlement_point, timestamp, total, n, kind)``.

    ``open`` rows are all open hours of a group that got rows, ``closed`` rows the hours of
    ended days, given once, and ``late`` rows additions to hours of days that had ended.
    """
    hours = market.select("settlement_point", F.date_trunc("hour", "timestamp").alias("timestamp"), F.col("price").cast("double"))
    sums = T.StructType(
        [
            T.StructField("settlement_point", T.StringType()),
            T.StructField("timestamp", T.TimestampType()),
            T.StructField("total", T.DoubleType()),
            T.StructField("n", T.LongType()),
        ]
    )
    grouped = (
        hours.mapInArrow(_added, sums)
        .withColumn("share", F.pmod(F.xxhash64("settlement_point"), F.lit(spread)))
        .withWatermark("timestamp", horizon)
        .groupBy("share")
    )
    found = T.StructType([T.StructField("share", T.LongType()), *sums.fields, T.StructField("kind", T.StringType())])

    def added(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        points, micros, totals, counts = state.get if state.exists else ([], [], [], [])
        held = pd.DataFrame(
            {
                "settlement_point": pd.Series(points, dtype=object),
                "timestamp": pd.to_datetime(np.array(micros, np.int64), unit="us"),
                "total": np.array(totals, float),
                "n": np.array(counts, np.int64),
            }
        )
        came = pd.concat([f[held.columns] for f in frames]).fillna({"total": 0.0})
        late = _ended(_days(came["timestamp"]), state)
        over = _ended(_days(held["timestamp"]), state)
        now = _summed(pd.concat([held[~over], came[~late]]))
        for kind, rows in (("open", now), ("closed", held[over]), ("late", _summed(came[late]))):
            yield rows.assign(share=key[0], kind=kind)[found.names]
        micros = now["timestamp"].to_numpy().astype("datetime64[us]").astype(np.int64).tolist()
        points = [None if pd.isna(p) else p for p in now["settlement_point"]]
        state.update((points, micros, now["total"].tolist(), now["n"].tolist()))

    return grouped.applyInPandasWithState(
        added,
        found,
        "points array<string>, micros array<bigint>, totals array<double>, counts array<bigint>",
        "update",
        GroupStateTimeout.NoTimeout,
    )
