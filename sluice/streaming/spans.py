"""Joins of two streams whose rows meet within a span of event time, and sums by window behind them, with state by groups of keys.

Rows are packed by group as Arrow batches before they are shuffled, met in numpy, and spread again: what the shuffle, the state store
and the calls between the JVM and Python handle one by one are packs of rows. A batch writes the rows that it brings; it reads those of
the groups that it touches, a pack at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import sluice

# Workers may run in a folder where this package can't be imported: send its functions whole.
cloudpickle.register_pickle_by_value(sluice)

#: Groups of keys, fixed for a checkpoint: a batch costs some milliseconds for each group that it touches.
GROUPS = 1_024
_INPUT = 16 << 20  # bytes of a task's input that are packed at a time
_PACK, _PACKS = 4 << 20, 8  # bytes of a stored pack; so many smaller ones are made one
_OUT = 20_000  # pairs that are made at a time
_DAY = 86_400_000_000
_OWN = ("_key", "_at", "_from", "_end")  # columns for the join alone


def _bytes(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _table(pack: bytes | pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(pack).read_all()


def _gathered(tables: Iterable[pa.Table], size: int) -> Iterator[pa.Table]:
    """The tables joined to larger ones, of about so many bytes."""
    held, have = [], 0
    for t in tables:
        held.append(t)
        have += t.nbytes
        if have >= size:
            yield pa.concat_tables(held).combine_chunks()
            held, have = [], 0
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _packed(df: DataFrame, is_left: bool, made: Callable[[pa.Table], pa.Table] = lambda t: t) -> DataFrame:
    """The rows by _group, many in each pack; made: what is made of the rows before."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered((pa.Table.from_batches([b]) for b in batches if b.num_rows), _INPUT):
            table = made(table)
            group = table["_group"].to_numpy()
            order = np.argsort(group, kind="stable")
            rows = table.drop_columns(["_group"]).take(pa.array(order))
            found, first = np.unique(group[order], return_index=True)
            last = np.append(first[1:], len(order))
            packs = [_bytes(rows.slice(a, b - a)) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([is_left] * len(found)), pa.array(packs, pa.binary())], ["_group", "is_left", "rows"])

    return df.mapInArrow(pack, "_group long, is_left boolean, rows binary")


def _spread(packs: DataFrame, schema: T.StructType) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch.column(0):
                yield from _table(pack.as_buffer()).to_batches()

    return packs.mapInArrow(spread, schema)


def _met(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
    """The pairs of equal _key whose _at on the right is within _from and _end on the left; many pairs of a key come in parts."""
    swapped = left.num_rows < right.num_rows
    many, few = (right, left) if swapped else (left, right)  # the smaller side is sorted
    keys = few["_key"].to_numpy()
    order = np.argsort(keys, kind="stable")
    keys, wanted = keys[order], many["_key"].to_numpy()
    first = np.searchsorted(keys, wanted, "left")
    number = np.searchsorted(keys, wanted, "right") - first
    of = np.flatnonzero(number)
    first, number = first[of], number[of]
    ends = np.cumsum(number)
    start, frm, till, at = 0, left["_from"].to_numpy(), left["_end"].to_numpy(), right["_at"].to_numpy()
    while start < len(of):
        done = int(ends[start] - number[start])
        stop = max(start + 1, int(np.searchsorted(ends, done + _OUT, "right")))
        n = number[start:stop]
        a = np.repeat(of[start:stop], n)
        b = order[np.arange(len(a)) + np.repeat(first[start:stop] - (ends[start:stop] - n - done), n)]
        lefts, rights = (b, a) if swapped else (a, b)
        near = (at[rights] >= frm[lefts]) & (at[rights] <= till[lefts])
        if near.any():
            sides = [t.select([c for c in t.column_names if c not in _OWN]).take(pa.array(i[near])) for t, i in ((left, lefts), (right, rights))]
            yield pa.Table.from_arrays([c for s in sides for c in s.columns], names=[c for s in sides for c in s.column_names])
        start = stop


class _Side:
    """The rows of one side of a group, in packs that are named by the time after which they are not needed."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.packs = handle.getMapState(name, "until LONG, size LONG, id STRING", "rows BINARY")

    def names(self) -> list[tuple]:
        return list(self.packs.keys())

    def tables(self) -> Iterator[pa.Table]:
        return (_table(self.packs.getValue(name)[0]) for name in self.names())

    def add(self, table: pa.Table, behind: int) -> int:
        """Stores the rows, and says until when they are needed."""
        small = [name for name in self.names() if name[1] < _PACK]
        if len(small) >= _PACKS:
            table = pa.concat_tables([table, *(_table(self.packs.getValue(name)[0]) for name in small)])
            for name in small:
                self.packs.removeKey(name)
        until = (int(table["_end"].to_numpy().max()) + behind) // 1000 + 1
        self.packs.updateValue((until, table.nbytes, uuid.uuid4().hex), (_bytes(table.combine_chunks()),))
        return until

    def drop(self, watermark: int) -> None:
        for name in self.names():
            if name[0] < watermark:
                self.packs.removeKey(name)


class _Near(StatefulProcessor):
    """Rows of both sides wait for those of the other; a timer for each pack drops it."""

    def __init__(self, behind: int):
        self.behind = behind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.left, self.right = handle, _Side(handle, "left"), _Side(handle, "right")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        news: dict[bool, list[pa.Table]] = {True: [], False: []}
        have = 0
        for frame in rows:
            for is_left, pack in zip(frame["is_left"].tolist(), frame["rows"].tolist(), strict=True):
                news[is_left].append(_table(pack))
                have += len(pack)
                if have >= _PACK:
                    yield from self._meet(news)
                    news, have = {True: [], False: []}, 0
        yield from self._meet(news)

    def _meet(self, news: dict[bool, list[pa.Table]]) -> Iterator[pd.DataFrame]:
        """The pairs of new rows with new and with stored ones; then the new ones are stored too."""
        left, right = (pa.concat_tables(of).combine_chunks() if of else None for of in (news[True], news[False]))
        if left is not None and right is not None:
            yield from self._out(_met(left, right))
        if left is not None:
            yield from self._out(pairs for held in self.right.tables() for pairs in _met(left, held))
        if right is not None:
            yield from self._out(pairs for held in self.left.tables() for pairs in _met(held, right))
        for side, table in ((self.left, left), (self.right, right)):
            if table is not None:
                self.handle.registerTimer(side.add(table, self.behind))

    def _out(self, tables: Iterator[pa.Table]) -> Iterator[pd.DataFrame]:
        for table in _gathered(tables, _PACK):
            yield pd.DataFrame({"rows": [_bytes(table)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for side in (self.left, self.right):
            side.drop(timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def length(df: DataFrame, within: str) -> int:
    """An interval's length in microseconds; that of months differs by up to three days."""
    start = "TIMESTAMP '2000-01-01 00:00:00'"
    return df.sparkSession.sql(f"SELECT unix_micros({start} + INTERVAL {within}) - unix_micros({start})").head()[0]


def near_join(left: DataFrame, right: DataFrame, on: tuple[str, str], times: tuple[str, str], within: str, depth: int = 0, groups: int = GROUPS) -> DataFrame:
    """Rows of left and right of equal keys (whole numbers) and of times at most `within` apart. The columns of both sides differ.

    State goes once the watermark has passed all that may still come; at depth n the inputs come from n such joins in a row, and so
    may be older by as many spans. Rows older than the watermark meet what is still there. The result has no watermark of its own.
    """
    span = F.expr(f"INTERVAL {within}")
    begin, at = (F.col(t).cast("timestamp") for t in times)

    def keyed(df: DataFrame, key: str, time: Column, own: Column) -> DataFrame:
        k = F.col(key).cast("long")
        rows = df.filter(k.isNotNull() & time.isNotNull())
        return rows.select(*df.columns, k.alias("_key"), own, F.unix_micros(time + span).alias("_end"), F.pmod(F.xxhash64(k), F.lit(groups)).alias("_group"))

    lefts = keyed(left, on[0], begin, F.unix_micros(begin - span).alias("_from"))
    rights = keyed(right, on[1], at, F.unix_micros(at).alias("_at"))
    behind = depth * length(left, within) + 4 * (depth + 1) * _DAY
    packs = _packed(lefts, True).unionByName(_packed(rights, False))
    out = packs.groupBy("_group").transformWithStateInPandas(_Near(behind), "rows binary", "append", "eventTime")
    return _spread(out, T.StructType([*left.schema, *right.schema]))


class _Windows(StatefulProcessor):
    """Sums of a group's windows, each until the watermark has passed its end by `behind` microseconds; the group has one timer, for the
    window that ends first."""

    def __init__(self, keys: list[str], end: str, value: str, behind: int):
        self.keys, self.end, self.value, self.behind = keys, end, value, behind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # passed: the watermark when windows came out last, in milliseconds; they don't come out again
        self.windows = handle.getValueState("windows", "rows BINARY, timer LONG, passed LONG")

    def _held(self) -> tuple[list[pa.Table], int | None, int]:
        held = self.windows.get()
        return ([], None, -(2**63)) if held is None else ([_table(held[0])], held[1], held[2])

    def _due(self, table: pa.Table) -> np.ndarray:
        return -(-(table[self.end].cast(pa.int64()).to_numpy() + self.behind) // 1000)

    def _keep(self, table: pa.Table, timer: int | None, passed: int) -> None:
        """Stores the windows and sets the timer, which is at `timer` so far."""
        first = int(self._due(table).min()) if table.num_rows else None
        if timer != first:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.windows.update((_bytes(table), first, passed))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        have, timer, passed = self._held()
        for frame in rows:
            have = [added(pa.concat_tables([*have, *map(_table, frame["rows"].tolist())]), self.keys, self.value)]
        self._keep(have[0].filter(pa.array(self._due(have[0]) > passed)), timer, passed)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (held,), timer, _ = self._held()
        passed, at = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        over = self._due(held) <= max(passed, at)
        self._keep(held.filter(pa.array(~over)), None if timer == at else timer, max(passed, at))
        if over.any():
            yield pd.DataFrame({"rows": [_bytes(held.filter(pa.array(over)))]})

    def close(self) -> None:
        pass


def added(table: pa.Table, keys: list[str], value: str) -> pa.Table:
    """The rows of equal keys made one: the sums of their items and value."""
    out = table.group_by(keys).aggregate([("items", "sum"), (value, "sum")])
    return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select(table.column_names).cast(table.schema).combine_chunks()


def summed(df: DataFrame, end: str, value: str, behind: int, groups: int = 64) -> DataFrame:
    """The number (items) and sum of `value`, a decimal, of the rows with equal other columns, of which `end` is the time when a window ends:
    each once the watermark, of which df has no column, has passed that by `behind` microseconds. Rows of a window that came out are dropped.
    """
    names = [c for c in df.columns if c != value]
    rows = df.select(*names, F.lit(1).cast("long").alias("items"), F.col(value).cast("decimal(38,4)").alias(value))
    packs = _packed(rows.withColumn("_group", F.pmod(F.xxhash64(end), F.lit(groups))), True, lambda t: added(t, [*names, "_group"], value))
    out = packs.groupBy("_group").transformWithStateInPandas(_Windows(names, end, value, behind), "rows binary", "append", "eventTime")
    return _spread(out, rows.schema)
