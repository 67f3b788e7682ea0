"""Target tables as Parquet folders, the dead-letter table, and payloads for push services."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import sluice
from sluice.functions.schemas import MODES
from sluice.operators.aggregates import furthest
from sluice.operators.mapping import public_columns

# Workers may run in a folder where this package can't be imported: send its functions whole.
cloudpickle.register_pickle_by_value(sluice)

HIDDEN = ("operation", "source_ts", "processed_at")
PROGRESS = "consumer_id STRING, topic STRING, last_offset BIGINT, last_timestamp TIMESTAMP"


def aligned(df: DataFrame, columns: T.StructType) -> DataFrame:
    """df in a fixed list of columns; one that it lacks is null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns])


#: Columns that a table's rows carry beside its own: when they were written, and whether they take their key out.
AT, GONE = "_at", "_gone"


def latest_of(rows: DataFrame, keys: list[str], order: tuple[str, ...] = (), first: bool = False) -> DataFrame:
    """The row of each key that counts: the greatest in `order`, of equal ones that written last (first: that written first), of those
    written together that of the greatest hash, so reruns agree. A key whose row is gone is left out."""
    columns = rows.columns
    present = [F.struct(F.col(c).isNotNull(), F.col(c)) for c in order if c in columns]
    rank = F.struct(*present, -F.col(AT) if first else F.col(AT), F.xxhash64(*[c for c in columns if c != AT]))
    best = F.max_by(F.struct(*columns), rank)
    return rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(best.alias("_row")).select("_row.*").filter(f"{GONE} IS NOT TRUE")


class Tables:
    """Tables under a folder: Parquet that Spark writes and commits, with no index or pointer beside it.

    Each write is a folder of its own, <table>/<stream>/batch=<n>. A batch that runs again replaces its own rows; a stream with a
    new checkpoint has a new id, so it neither replaces nor skips what others wrote. A keyed table holds change rows, and
    readers take the row of each key that counts: a batch writes as many rows as it brings, however large the table is.

    compact() is a job apart from the streams: it folds a stream's older batches into one folder upto=<n>, which counts from Spark's
    _SUCCESS on and hides batch=0..n, and removes what the fold before had hidden, so readers that began earlier go on.
    The newest batch of a stream is never folded: it may run again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str) -> str:
        return "/".join([self.folder, *parts])

    def _at(self, *parts: str) -> tuple[Any, Any]:
        """The file system and path of a place in the folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(*parts))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        system, path = self._at(*parts)
        return sorted(x.getPath().getName() for x in system.listStatus(path)) if system.exists(path) else []

    def _drop(self, *parts: str) -> None:
        system, path = self._at(*parts)
        system.delete(path, True)

    def _parts(self, table: str, stream: str) -> tuple[list[int], list[int]]:
        """The finished folds and the finished batches of a stream."""
        done: dict[str, list[int]] = {"upto": [], "batch": []}
        for name in self._names(table, stream):
            kind, _, n = name.partition("=")
            system, mark = self._at(table, stream, name, "_SUCCESS")
            if kind in done and system.exists(mark):
                done[kind].append(int(n))
        return sorted(done["upto"]), sorted(done["batch"])

    def paths(self, table: str) -> list[str]:
        """The folders that hold a table now."""
        out = []
        for stream in self._names(table):
            folds, batches = self._parts(table, stream)
            fold = folds[-1:] if folds else []
            out += [self._path(table, stream, f"upto={n}") for n in fold]
            out += [self._path(table, stream, f"batch={n}") for n in batches if n > (fold or [-1])[0]]
        return out

    def days(self, table: str, first: datetime.date, last: datetime.date) -> list[str]:
        """The folders of some days of a table that lies by day."""
        wanted = [(path, name) for path in self.paths(table) for name in self._names(*path.removeprefix(self.folder + "/").split("/"))]
        return [f"{path}/{name}" for path, name in wanted if name.startswith("day=") and first.isoformat() <= name[4:14] <= last.isoformat()]

    def rows(self, table: str, columns: T.StructType, days: tuple[datetime.date, datetime.date] | None = None) -> DataFrame:
        """All rows of a table, or those of some days, with AT and GONE; columns that older rows lack are null."""
        hidden = [T.StructField(AT, T.LongType()), T.StructField(GONE, T.BooleanType())]
        schema = T.StructType([*[f for f in columns if f.name not in (AT, GONE)], *hidden])
        paths = self.days(table, *days) if days else self.paths(table)
        return self._load(schema, paths) if paths else self.spark.createDataFrame([], schema)

    def _load(self, schema: T.StructType, paths: list[str]) -> DataFrame:
        # folders of days only serve to find and drop them; the time itself is in the rows
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)

    def read(self, table: str, columns: T.StructType, keys: list[str] | None = None, order: tuple[str, ...] = ("source_ts",)) -> DataFrame:
        """The table: of a keyed one a row for each key, the greatest in `order`. Of equal rows that written last counts, in a table that
        only takes missing keys that written first. `columns` may be more than some rows have."""
        rows = self.rows(table, columns)
        if keys:
            rows = latest_of(rows, keys, order, MODES.get(table) == "insert_missing")
        return rows.select(*columns.names)

    def put(self, table: str, df: DataFrame, batch_id: int, stream: str = "direct", day: str | None = None, gone: bool = False) -> None:
        """Writes the rows of a batch; day: a time by whose day the rows lie in folders, so that old days can be dropped."""
        df = df.withColumns({AT: F.lit(time.time_ns() // 1000), GONE: F.lit(True if gone else None).cast("boolean") if GONE not in df.columns else F.col(GONE)})
        path = self._path(table, stream, f"batch={batch_id}")
        if day:
            df.withColumn("day", F.to_date(day)).write.mode("overwrite").partitionBy("day").parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)

    def write(self, table: str, df: DataFrame, batch_id: int, stream: str = "direct", day: str | None = None) -> bool:
        """Writes to a table that has a mode; False for one that has none."""
        if table in MODES:
            self.put(table, df, batch_id, stream, day)
        return table in MODES

    def remove(self, table: str, of: DataFrame, batch_id: int, stream: str = "direct") -> None:
        """Takes the keys of `of` (with the columns that order the table's rows) out of a keyed table."""
        self.put(table, of, batch_id, stream, gone=True)

    def advance(self, table: str, progress: DataFrame, batch_id: int, stream: str = "direct") -> None:
        """Progress rows (consumer_id, topic, last_offset, last_timestamp) put into a table; read by `reached`."""
        self.put(table, progress, batch_id, stream)

    def reached(self, table: str) -> DataFrame:
        """How far each consumer is in each topic: none goes back."""
        return furthest(self.rows(table, T.StructType.fromDDL(PROGRESS)))

    def compact(
        self, table: str, columns: T.StructType, keys: list[str] | None = None, order: tuple[str, ...] = ("source_ts",), least: int = 10, day: str | None = None,
        keep: Column | None = None, part_bytes: int = 128 * 2**20,
    ) -> None:
        """Folds the older batches of each stream that has at least `least` unfolded ones.

        Of a keyed table a row for each key is kept (one that is gone too, as older rows may still come from other streams); keep:
        of which rows; rows with a null answer stay. Files get about part_bytes, sorted by key, so readers of few keys skip most.
        """
        for stream in self._names(table):
            folds, batches = self._parts(table, stream)
            last = folds[-1] if folds else -1
            new = [n for n in batches if n > last][:-1]
            if len(new) < least:
                continue
            paths = [self._path(table, stream, f"upto={last}")] * bool(folds) + [self._path(table, stream, f"batch={n}") for n in new]
            hidden = [T.StructField(AT, T.LongType()), T.StructField(GONE, T.BooleanType())]
            df = self._load(T.StructType([*columns, *hidden]), paths)
            df = df if keep is None else df.filter(F.coalesce(keep, F.lit(True)))
            size = sum(self._size(p) for p in paths)
            if keys:
                kept = latest_of(df.withColumn("_out", F.col(GONE)).withColumn(GONE, F.lit(None).cast("boolean")), keys, order, MODES.get(table) == "insert_missing")
                df = kept.withColumn(GONE, F.col("_out")).drop("_out").repartition(max(1, -(-size // part_bytes)), *keys).sortWithinPartitions(*keys)
            else:
                df = df.coalesce(max(1, -(-size // part_bytes)))
            path = self._path(table, stream, f"upto={new[-1]}")
            (df.withColumn("day", F.to_date(day)).write.mode("overwrite").partitionBy("day") if day else df.write.mode("overwrite")).parquet(path)
            for n in folds[:-1]:
                self._drop(table, stream, f"upto={n}")
            for n in (n for n in batches if n <= last):
                self._drop(table, stream, f"batch={n}")

    def _size(self, path: str) -> int:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()

    def expire(self, table: str, before: datetime.date) -> int:
        """Drops the days before a date from a table that lies by day; how many folders went. No file of a later day is read or written."""
        n = 0
        for path in self.paths(table):
            parts = path.removeprefix(self.folder + "/").split("/")
            for name in self._names(*parts):
                if name.startswith("day=") and name[4:14] < before.isoformat():
                    self._drop(*parts, name)
                    n += 1
        return n


def dead_letters(errors: DataFrame, topic: Column, payload: Column, consumer: str, at: Column) -> DataFrame:
    """errors (error_type, error_message) as rows of the dead-letter table: message up to 1000 characters, no retries, pending."""
    return errors.select(
        F.uuid().alias("dlq_id"), topic.alias("original_topic"), "error_type", F.left("error_message", F.lit(1000)).alias("error_message"), F.lit(0).alias("retry_count"), payload.alias("payload"), at.alias("first_failure_at"), at.alias("last_failure_at"),
        F.lit(consumer).alias("consumer_id"), F.lit("pending").alias("status"), at.alias("created_at"),
    )


def dead_letter_messages(dlq: DataFrame) -> DataFrame:
    """(topic, value) of dead letters as messages: their metadata beside the original payload."""
    meta = F.struct("dlq_id", "original_topic", "error_type", "error_message", "retry_count", "first_failure_at", "last_failure_at", "consumer_id")
    value = F.to_json(F.struct(meta.alias("dlq_metadata"), F.coalesce(F.try_parse_json("payload"), F.to_variant_object(F.struct(F.col("payload").alias("raw")))).alias("original_payload")))
    return dlq.select(F.concat(F.lit("cdc/dlq/"), "original_topic").alias("topic"), value.alias("value"))


def dead_letter_notifications(dlq: DataFrame) -> DataFrame:
    return dlq.select(F.col("error_type").alias("event_type"), F.left("error_message", F.lit(200)).alias("message"), F.lit("error").alias("severity"), F.to_json(F.struct("dlq_id", "original_topic")).alias("payload"))


def event_payloads(rows: DataFrame, table: str, consumer: str) -> DataFrame:
    """(payload): each row as an event, its data without internal columns."""
    data = F.struct(*public_columns(rows, HIDDEN).columns)
    return rows.select(F.to_json(F.struct(F.lit(table).alias("table"), F.col("operation"), data.alias("data"), F.date_format("source_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("source_ts"), F.lit(consumer).alias("consumer_id"))).alias("payload"))


def _iso(df: DataFrame) -> list[Column]:
    return [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes]


def row_payloads(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(payload): the columns of each row, times as ISO text."""
    return rows.select(F.to_json(F.struct(*_iso(rows.select(*columns)))).alias("payload"))


# The columns of two target tables.
ENRICHED = ["order_id", "customer_id", "customer_name", "customer_tier", "customer_region", "total_amount", "item_count", "order_date", "status", "window_start", "window_end"]
EXTRACTED = ["order_id", "product_id", "quantity", "unit_price", "subtotal", "extracted_from"]
# End of the fixed values.


class _Chunks:
    def __init__(self, size: int):
        self.size = size

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, []
        for batch in batches:
            held += batch.column("payload").to_pylist()
            while len(held) >= self.size:
                yield self.out(n, held[: self.size])
                n, held = n + 1, held[self.size :]
        if held:
            yield self.out(n, held)

    def out(self, n: int, held: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([held], pa.list_(pa.string()))], ["chunk", "payloads"])


def chunked(payloads: DataFrame, size: int = 100) -> DataFrame:
    """(part, chunk, payloads): up to `size` payloads a request, taken as they lie in a partition, so nothing is exchanged."""
    return payloads.select("payload").mapInArrow(_Chunks(size), "chunk long, payloads array<string>").select(F.spark_partition_id().cast("long").alias("part"), "chunk", "payloads")


def each_on_its_own(batch: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """Gives one computed batch to every sink; the message of each that fails, without stopping the others."""
    failed = {}
    batch.persist()
    try:
        for name, sink in sinks.items():
            try:
                sink(batch)
            except Exception as e:  # each sink's failure is reported on its own
                failed[name] = str(e)[:1000]
    finally:
        batch.unpersist()
    return failed
