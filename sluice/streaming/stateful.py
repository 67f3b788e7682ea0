"""Operators that keep state by key; the session needs the RocksDB state store (see with_rocksdb)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import sluice
from sluice.streaming import spans

# Workers may run in a folder where this package can't be imported: send its functions whole.
cloudpickle.register_pickle_by_value(sluice)


_ROWS = 10_000  # rows of a frame that goes out


_BATCH = 8 << 20  # bytes of an Arrow batch


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """State in RocksDB, of which a batch stores the changes rather than whole files.

    What an executor holds beside its heap does not grow with the tables: all its stores share one bound, as each would keep buffers of
    its own, and Arrow batches between the JVM and Python end by bytes too, not by rows alone. Bounds that the session has set stay.
    """
    conf = "spark.sql.streaming.stateStore"
    spark.conf.set(f"{conf}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(f"{conf}.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set(f"{conf}.rocksdb.boundedMemoryUsage", "true")
    if spark.conf.get(f"{conf}.rocksdb.maxMemoryUsageMB", None) is None:
        spark.conf.set(f"{conf}.rocksdb.maxMemoryUsageMB", "256")
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str(2**31 - 1), f"{2**31 - 1}b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH))
    return spark


class _Newer(StatefulProcessor):
    """Lets a row pass if its ts is beyond every ts of its key so far."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "ts LONG", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else -(2**63)
        passed: set[int] = set()  # frames come and go; only their times are held, so that of equal ones the first passes
        for frame in rows:
            frame = frame[frame["ts"] > seen].sort_values(["ts", "scn"])
            frame = frame[~frame["ts"].duplicated() & ~frame["ts"].isin(passed)]
            if len(frame):
                passed.update(frame["ts"].tolist())
                yield frame
        if passed:
            self.seen.update((int(max(passed)),))

    def handleInitialState(self, key, initialState: pd.DataFrame, timer) -> None:
        self.seen.update((int(initialState["ts"].max()),))

    def close(self) -> None:
        pass


def _mode(ttl_ms: int | None) -> str:
    """State expires by processing time; without a ttl no timers run."""
    return "processingTime" if ttl_ms else "none"


def drop_stale(rows: DataFrame, schema: str = "key long, ts long, scn long", known: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Rows (key, ts, scn, ...) whose ts is later than all that earlier batches let pass for the key; one row of a key and ts.

    known (key, ts): what a first run takes as seen, as from target tables; later runs go on from the checkpoint. A key that
    had no news for ttl_ms of processing time is forgotten; without ttl_ms none is.
    """
    initial = known.groupBy("key") if known is not None else None
    return rows.groupBy("key").transformWithStateInPandas(_Newer(ttl_ms), schema, "append", _mode(ttl_ms), initialState=initial)


#: Groups of keys. State is read and written by group: a call between the JVM and Python serves all keys of a group that a batch
#: brings, and a batch writes the groups that it touches. The number stays with a checkpoint.
GROUPS = 8_192


def _grouped(rows: DataFrame, key: str, groups: int):
    """The rows that have a key, grouped by its hash."""
    return rows.filter(F.col(key).isNotNull()).withColumn("_group", F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(groups))).groupBy("_group")


def _longs(blobs: Iterable[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, np.int64) for b in blobs]


def _blobs(*columns: Sequence[int] | np.ndarray) -> tuple[bytes, ...]:
    return tuple(np.asarray(c, np.int64).tobytes() for c in columns)


def _now(timer, ttl_ms: int | None) -> int:
    return timer.getCurrentProcessingTimeInMs() if ttl_ms else 0


class _Pending(StatefulProcessor):
    """Orders wait until their customer is known; the customers of a group share their state."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # seen: the processing time of the last news, 0 without a ttl
        self.people = handle.getListState("people", "customer_id LONG, name STRING, ts LONG, seen LONG", self.ttl_ms)
        self.waiting = handle.getListState("waiting", "customer_id LONG, order_id LONG, seen LONG", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        now = _now(timer, self.ttl_ms)
        alive = lambda seen: not self.ttl_ms or seen + self.ttl_ms > now
        known = {who: (name, ts, seen) for who, name, ts, seen in self.people.get() if alive(seen)}
        waiting = [tuple(r) for r in self.waiting.get() if alive(r[2])]
        had, news = len(waiting), False
        for frame in rows:
            people = frame[frame["is_customer"]]
            for who, name, ts in zip(people["customer_id"].tolist(), people["name"].tolist(), people["ts"].tolist(), strict=True):
                if who not in known or ts >= known[who][1]:
                    known[who], news = (name, ts, now), True
            orders = frame[~frame["is_customer"]]
            waiting.extend((who, order, now) for who, order in zip(orders["customer_id"].tolist(), orders["order_id"].tolist(), strict=True))
        if news:
            self.people.put([(who, *of) for who, of in known.items()])
        left = [r for r in waiting if r[0] not in known]
        if len(left) == len(waiting) > had:
            self.waiting.appendList(left[had:])
        elif len(left) < len(waiting):
            self.waiting.put(left) if left else self.waiting.clear()
        out = ((who, order, known[who][0]) for who, order, _ in waiting if who in known)
        while part := list(islice(out, _ROWS)):
            yield pd.DataFrame(part, columns=["customer_id", "order_id", "customer_name"])

    def close(self) -> None:
        pass


def pending_join(orders: DataFrame, customers: DataFrame, ttl_ms: int | None = None, groups: int = GROUPS) -> DataFrame:
    """Orders (customer_id, order_id) joined with customers (customer_id, name, ts); an order waits for its customer.

    With ttl_ms customers are forgotten, and orders given up, after so much processing time; without it state stays.
    """
    none = lambda t: F.lit(None).cast(t)
    who = F.col("customer_id").cast("long").alias("customer_id")
    both = orders.select(who, F.col("order_id").cast("long").alias("order_id"), none("string").alias("name"), F.lit(0).cast("long").alias("ts"), F.lit(False).alias("is_customer"))
    both = both.unionByName(customers.select(who, F.lit(0).cast("long").alias("order_id"), "name", F.col("ts").cast("long").alias("ts"), F.lit(True).alias("is_customer")))
    return _grouped(both, "customer_id", groups).transformWithStateInPandas(_Pending(ttl_ms), "customer_id long, order_id long, customer_name string", "append", _mode(ttl_ms))


def _by_order(frame: pd.DataFrame, *columns: str) -> Iterator[tuple[int, list[tuple[int, ...]]]]:
    """The orders of a frame, each with its rows, in the order of the columns."""
    rows = sorted(zip(*(frame[c].tolist() for c in ("order_id", *columns)), strict=True))
    return ((order, [r[1:] for r in own]) for order, own in groupby(rows, key=itemgetter(0)))


class _Items(StatefulProcessor):
    """The latest items of each order of a group; above `cap` the last `keep` stay, and after `ttl_ms` of event time without news the
    list starts afresh."""

    def __init__(self, cap: int, keep: int, ttl_ms: int, state_ttl_ms: int | None):
        self.cap, self.keep, self.ttl_ms, self.state_ttl_ms = cap, keep, ttl_ms, state_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # columns of 64-bit integers, an item a place; seen: the processing time of the order's last news, 0 without a ttl
        self.items = handle.getValueState("items", "order_id BINARY, item_id BINARY, ts BINARY, seen BINARY", self.state_ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        now = _now(timer, self.state_ttl_ms)
        # the times of a batch must be in order; a group's batch is a small part of it
        batch = pd.concat(list(rows))
        held = np.stack(_longs(self.items.get() or [b""] * 4))
        if self.state_ttl_ms:
            held = held[:, held[3] + self.state_ttl_ms > now]
        touched = np.isin(held[0], batch["order_id"].to_numpy())
        lists: dict[int, list[tuple[int, int]]] = {}
        for order, item, ts, _ in held[:, touched].T.tolist():
            lists.setdefault(order, []).append((item, ts))
        out = []
        for order, new in _by_order(batch, "ts", "item_id"):
            have = lists.get(order, [])
            newest = max((t for _, t in have), default=0)
            for ts, item in new:
                if have and ts - newest > self.ttl_ms:
                    have = []
                newest = max(newest, ts) if have else ts
                have.append((item, ts))
                if len(have) > self.cap:
                    have = have[-self.keep :]
                    newest = max(t for _, t in have)
            lists[order] = have
            out.append((order, len(have), have[-1][1]))
        changed = np.array([(order, item, ts, now) for order, have in lists.items() for item, ts in have], np.int64).reshape(-1, 4).T
        self.items.update(_blobs(*np.concatenate([held[:, ~touched], changed], axis=1)))
        yield pd.DataFrame(out, columns=["order_id", "items", "last_ts"])

    def close(self) -> None:
        pass


def item_lists(items: DataFrame, cap: int = 100, keep: int = 50, ttl_ms: int = 3_600_000, state_ttl_ms: int | None = None, groups: int = GROUPS) -> DataFrame:
    """Items (order_id, item_id, ts) to the number that each order's list holds after each batch.

    ttl_ms is event time between items after which a list starts afresh; state_ttl_ms is processing time after which the
    state of an order without news is dropped.
    """
    lists = _Items(cap, keep, ttl_ms, state_ttl_ms)
    longs = items.select(*[F.col(c).cast("long").alias(c) for c in ("order_id", "item_id", "ts")])
    return _grouped(longs, "order_id", groups).transformWithStateInPandas(lists, "order_id long, items long, last_ts long", "update", _mode(state_ttl_ms))


def join_streams(orders: DataFrame, items: DataFrame, late: str = "10 seconds", within: str = "1 hour") -> DataFrame:
    """Orders (order_id, order_ts) with the items (item_order_id, item_ts, ...) within a span of their time: both sides have watermarks, so
    state is dropped in time; an order without items comes out once they can't come any more."""
    o, i = orders.withWatermark("order_ts", late), items.withWatermark("item_ts", late)
    near = F.expr(f"order_id = item_order_id AND item_ts BETWEEN order_ts - INTERVAL {within} AND order_ts + INTERVAL {within}")
    return o.join(i, near, "leftOuter")


def join_four(orders: DataFrame, customers: DataFrame, items: DataFrame, products: DataFrame, late: str = "10 seconds", within: str = "1 hour", groups: int = spans.GROUPS) -> DataFrame:
    """Items (item_order_id, item_product_id, item_ts, ...) with their order (order_id, order_customer_id, order_ts), its customer
    (customer_id, customer_ts, ...) and their product (product_id, product_ts, ...), all four streams with watermarks.

    Each side may come up to `within` of event time apart from the item or order it belongs to, so all state is dropped in time.
    Of the times item_ts stays, without a watermark. State is kept by groups of keys (see spans).
    """
    with_rocksdb(orders.sparkSession)
    o, c, i, p = orders.withWatermark("order_ts", late), customers.withWatermark("customer_ts", late), items.withWatermark("item_ts", late), products.withWatermark("product_ts", late)
    whose = spans.near_join(o, c, ("order_customer_id", "customer_id"), ("order_ts", "customer_ts"), within, groups=groups).drop("customer_ts")
    what = spans.near_join(i, p, ("item_product_id", "product_id"), ("item_ts", "product_ts"), within, groups=groups).drop("product_ts")
    return spans.near_join(whose, what, ("order_id", "item_order_id"), ("order_ts", "item_ts"), within, depth=1, groups=groups).drop("order_ts")


def tier_windows(orders: DataFrame, customers: DataFrame, items: DataFrame, products: DataFrame, late: str = "10 seconds", within: str = "1 hour", length: str = "5 minutes", groups: int = spans.GROUPS) -> DataFrame:
    """Items by window of their time, tier of their order's customer and category of their product: number, sum and average of `amount`.

    The inputs are those of join_four, with `tier` in customers, `category` in products and `amount` in items, and so is the state of the
    joins. A window comes out, and its state goes, once the watermark has passed its end by `within` for each of two joins in a row.
    """
    joined = join_four(orders, customers, items, products, late, within, groups)
    at, amount = F.window("item_ts", length), F.col("amount").cast("decimal(18,4)").alias("amount")
    out = spans.summed(joined.select(at["start"].alias("window_start"), at["end"].alias("window_end"), "tier", "category", amount), "window_end", "amount", 2 * spans.length(orders, within))
    total = F.col("amount").cast("decimal(28,4)")
    mean = F.round(total.cast("decimal(28,10)") / F.col("items"), 4).cast("double")
    return out.select("window_start", "window_end", "tier", "category", "items", total.cast("double").alias("total"), mean.alias("average"))


def drop_repeats(rows: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each key within `late` of event time: without Python, and the watermark drops the state of keys in time."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


class _Expiring(StatefulProcessor):
    """The items of each order of a group until no news came for ttl_ms of event time: then the list comes out and its state goes. The
    group has one timer, for the list that ends first."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # columns of 64-bit integers, a list a place
        self.lists = handle.getValueState("lists", "order_id BINARY, items BINARY, first_ts BINARY, last_ts BINARY, timer LONG")

    def _held(self) -> tuple[np.ndarray, int | None]:
        held = self.lists.get()
        return (np.stack(_longs([b""] * 4)), None) if held is None else (np.stack(_longs(held[:4])), held[4])

    def _keep(self, lists: np.ndarray, timer: int | None) -> None:
        """Stores the lists and sets the timer, which is at `timer` so far."""
        first = int(lists[3].min()) + self.ttl_ms if lists.size else None
        if timer != first:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.lists.clear() if first is None else self.lists.update((*_blobs(*lists), first))

    def _out(self, lists: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(lists.T, columns=["order_id", "items", "first_ts", "last_ts"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        held, timer = self._held()
        touched = np.isin(held[0], batch["order_id"].to_numpy())
        lists = {order: of for order, *of in held[:, touched].T.tolist()}
        ended = []
        for order, new in _by_order(batch, "ts_ms"):
            have = lists.get(order)
            for (ts,) in new:
                if have is not None and ts > have[2] + self.ttl_ms:  # the list ended between two items of one batch
                    ended.append((order, *have))
                    have = None
                have = [1, ts, ts] if have is None else [have[0] + 1, have[1], max(have[2], ts)]
            lists[order] = have
        changed = np.array([(order, *of) for order, of in lists.items()], np.int64).reshape(-1, 4).T
        self._keep(np.concatenate([held[:, ~touched], changed], axis=1), timer)
        if ended:
            yield self._out(np.array(ended, np.int64).T)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        # all that the watermark has passed comes at once: the timer that is set now is for a later batch
        over = held[3] + self.ttl_ms <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        if over.any():
            self._keep(held[:, ~over], None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)
            yield self._out(held[:, over])

    def close(self) -> None:
        pass


def expired_lists(items: DataFrame, ttl_ms: int = 3_600_000, late: str = "10 seconds", groups: int = GROUPS) -> DataFrame:
    """Items (order_id, ts) of a stream to the lists that have ended: (order_id, items, first_ts, last_ts), times in milliseconds.

    A list ends when ttl_ms of event time pass without an item; a timer tells it when the watermark passes, so lists that
    get no more news come out too. An item that is older than the watermark is dropped.
    """
    with_rocksdb(items.sparkSession)
    timed = items.withWatermark("ts", late).select(F.col("order_id").cast("long").alias("order_id"), F.unix_millis("ts").alias("ts_ms"), "ts")
    out = "order_id long, items long, first_ts long, last_ts long"
    return _grouped(timed, "order_id", groups).transformWithStateInPandas(_Expiring(ttl_ms), out, "append", "eventTime")


class _Parted(StatefulProcessor):
    """Marks the rows that are older than the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        for r in rows:
            given = {k: v for k, v in r.asDict().items() if k != "_part"}
            yield Row(*given, "is_late")(*given.values(), r.ts_ms < passed)

    def close(self) -> None:
        pass


def parted_late(rows: DataFrame, ts: str, late: str, parts: int = 64) -> DataFrame:
    """A stream's rows with is_late: whether the stream's own watermark had passed them when they came. None is dropped.

    The time goes on as a plain number beside the watermark's column, so that late rows reach the operator. Rows are dealt by
    hash, a hot key to all parts.
    """
    with_rocksdb(rows.sparkSession)
    names = [f.name for f in rows.schema if f.name != ts]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != ts) + ", ts_ms long, is_late boolean"
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    timed = rows.withColumn("_mark", F.col(ts)).withWatermark("_mark", late)
    plain = timed.select(*names, F.unix_millis(F.col("_mark") + F.expr("INTERVAL 0 SECOND")).alias("ts_ms"), part.alias("_part"))
    marked = plain.groupBy("_part").transformWithState(_Parted(), out, "append", "eventTime")
    return marked.withColumn(ts, F.timestamp_millis("ts_ms")).drop("ts_ms")


class _Silent(StatefulProcessor):
    """An alert for each source that is silent for a while of processing time."""

    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_ts LONG, timer LONG")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.last.get()
        if held is not None:
            self.handle.deleteTimer(held[1])
        at = timerValues.getCurrentProcessingTimeInMs() + self.after_ms
        self.handle.registerTimer(at)
        newest = max(int(r.ts_ms) for r in rows)
        self.last.update((newest if held is None else max(newest, held[0]), at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.last.get()
        self.last.clear()
        yield Row("source", "last_ts", "silent_since")(key[0], held[0], held[1] - self.after_ms)

    def close(self) -> None:
        pass


def silent_sources(rows: DataFrame, after_ms: int = 30_000) -> DataFrame:
    """Rows (source, ts_ms) of a stream to (source, last_ts, silent_since), one row whenever a source was silent for after_ms.

    Timers of processing time fire without input, so the stream that watches runs on by itself.
    """
    with_rocksdb(rows.sparkSession)
    return rows.groupBy("source").transformWithState(_Silent(after_ms), "source string, last_ts long, silent_since long", "append", "processingTime")
