"""The streaming pipeline: decoded micro-batches feed the target tables, and keyed state the enriched orders."""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from statistics import quantiles

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from sluice.functions.folders import written
from sluice.functions.schemas import KEYS, MODES, TARGETS, Mapped, mapping
from sluice.operators import alerts, evolution, xml
from sluice.operators.aggregates import by_tier, progress
from sluice.operators.dedup import latest_by_key
from sluice.operators.mapping import load_mapping, to_target
from sluice.sources import sinks
from sluice.sources.envelope import decode, invalid, mismatched, rows
from sluice.sources.sinks import Tables, aligned, dead_letters, each_on_its_own
from sluice.streaming import keyed


@dataclass
class Settings:
    """sinks: what else each batch of enriched orders goes to, by name; one that fails stops neither the others nor the batch.

    push: where payloads go, by kind: events, items, enriched, notifications, dead_letters; each gets a DataFrame of (chunk, payloads).
    days: appended tables that lie in folders by the day of one of their times, so that `Tables.expire` can drop old ones.
    report_seconds: how often rows, rates and lag go to cdc_metrics. items: how the items in the orders' XML are read.
    """

    consumer: str = "sluice"
    trigger: str = "10 seconds"
    dead_letters: bool = True
    enrich: bool = True
    sinks: dict[str, Callable[[DataFrame], None]] = field(default_factory=dict)
    push: dict[str, Callable[[DataFrame], None]] = field(default_factory=dict)
    days: dict[str, str] = field(default_factory=dict)
    report_seconds: float = 30.0
    items: xml.Extraction = xml.ITEMS


REGISTRY = "table_name STRING, column_name STRING, column_type STRING, target_table STRING, target_column STRING, target_type STRING, is_active BOOLEAN, promoted_at TIMESTAMP"
ENRICHED = (
    "order_id INT, customer_id INT, customer_name STRING, customer_tier STRING, customer_region STRING, total_amount DECIMAL(15,2), item_count BIGINT, order_date TIMESTAMP, "
    "status STRING, window_start TIMESTAMP, window_end TIMESTAMP, order_version BIGINT, customer_version BIGINT"
)
METRICS = "consumer_id STRING, metric_name STRING, metric_value DECIMAL(15,4), metric_unit STRING, window_start TIMESTAMP, window_end TIMESTAMP"
SEQUENCE, VERSIONS = ("source_ts", "source_scn"), ("order_version", "customer_version")


def stream_of(batch: DataFrame) -> str:
    """The id of the streaming query whose micro-batch this is: that of its checkpoint, so a restart keeps it and a new checkpoint has
    a new one."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"


def side_by_side(spark: SparkSession, jobs: list[Callable[[], None]], most: int = 8) -> None:
    """Runs independent jobs of a batch at once; the first failure is raised when all have ended."""
    with ThreadPoolExecutor(most) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    for r in running:
        r.result()


class Running:
    """The queries of a started pipeline."""

    def __init__(self, pipeline: Pipeline, queries: list[StreamingQuery]):
        self.pipeline, self.queries = pipeline, queries

    def awaitTermination(self) -> None:
        for q in self.queries:
            q.awaitTermination()
        self.close()

    def stop(self) -> None:
        for q in self.queries:
            q.stop()
        self.close()

    def close(self) -> None:
        """Waits for what the listener is still to be told of the last batches, and reports."""
        last = [(str(q.id), p.batchId) for q in self.queries if (p := q.lastProgress) is not None]
        until = time.time() + 10
        while time.time() < until and not set(last) <= {(b["query"], b["batch"]) for b in self.pipeline.statistics.batches}:
            time.sleep(0.05)
        self.pipeline.report()
        self.pipeline.spark.streams.removeListener(self.pipeline.statistics)


class Pipeline:
    """Writes each micro-batch of messages to the target tables, under the id of its stream and its own: a batch that runs again replaces itself."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.tables, self.statistics = Tables(spark, folder), Statistics()
        self._reported = time.time()

    def batch(self, messages: DataFrame, batch_id: int) -> None:
        """Every table's write is a job of its own, and they run side by side. Tables without events in the batch are left alone."""
        stream = stream_of(messages)
        # the image stays, not what it was taken from
        decoded = decode(messages).drop("before", "after", "schema_name", "operation").persist()
        found = decoded.groupBy("table_name").agg(F.count("*").alias("n")).filter(F.col("table_name").isin(*KEYS)).collect()
        here = sorted(r["table_name"] for r in found)  # five at most
        every = {t: rows(decoded, t) for t in here}
        known = self.mapping()
        # promoted columns are read before, so images do not go along through the sort and shuffle to the latest rows
        latest = {t: latest_by_key(evolution.with_promoted(df, new_columns(t, known[t])).drop("_cdc_image"), [KEYS[t]]) for t, df in every.items()}
        promoted = {t: [m.source for m in columns if m not in mapping(t)] for t, columns in known.items()}
        unknown = evolution.unknown(decoded, promoted).persist()
        if "ORDERS" in here:
            latest["ORDERS"] = latest["ORDERS"].persist()
        failures: dict[str, str] = {}
        try:
            jobs = [lambda t=t: self.target(t, latest[t], known[t], batch_id, stream, failures) for t in here]
            if "ORDERS" in here:
                jobs.append(lambda: self.items(latest["ORDERS"], batch_id, stream, failures))
            jobs.append(lambda: failures.update(self.evolved(unknown, batch_id, stream)))
            jobs.append(lambda: self.tables.advance("cdc_checkpoints", progress(decoded, self.settings.consumer), batch_id, stream))
            if self.settings.dead_letters:
                jobs.append(lambda: self.failed(decoded, every, batch_id, stream))
            side_by_side(self.spark, jobs)
            if failures and self.settings.dead_letters:
                self.tables.write("cdc_dlq", self.lost(failures), batch_id, f"{stream}-failures")
            if time.time() - self._reported >= self.settings.report_seconds:
                self.report()
        finally:
            for df in (decoded, unknown, *[latest[t] for t in here if t == "ORDERS"]):
                df.unpersist()

    def mapping(self) -> dict[str, list[Mapped]]:
        """The projections as the registry has them now: a column that was promoted since the last batch is in this one. A column that the
        registry does not speak of is mapped as it is declared."""
        out = {t: mapping(t) for t in KEYS}
        if self.tables.paths("cdc_schema_registry"):
            for table, columns in load_mapping(self.registry()).items():
                declared = {m.target for m in out[table]}
                out[table] = out[table] + [m for m in columns if m.target not in declared]
        return out

    def registry(self) -> DataFrame:
        """A row for each column: as it was promoted, or else as it was first found."""
        return self.tables.read("cdc_schema_registry", T.StructType.fromDDL(REGISTRY), ["table_name", "column_name"], ("is_active",))

    def target(self, table: str, latest: DataFrame, columns: list[Mapped], batch_id: int, stream: str, failures: dict[str, str]) -> None:
        own = xml.without_xml(latest, self.settings.items) if table == "ORDERS" else latest
        # appended tables have the declared columns; in others the sequence number tells events of one time apart
        name = TARGETS[table]
        out = to_target(own, table, columns, sequence=MODES[name] == "upsert")
        self.tables.write(name, out, batch_id, stream, self.settings.days.get(name))
        failures |= self.pushed("events", lambda: sinks.event_payloads(out, table, self.settings.consumer))

    def items(self, orders: DataFrame, batch_id: int, stream: str, failures: dict[str, str]) -> None:
        items = xml.order_items(orders, self.settings.items).withColumnRenamed("ORDER_ID", "order_id")
        self.tables.write("cdc_order_items_extracted", items, batch_id, stream)
        failures |= self.pushed("items", lambda: sinks.row_payloads(items, [c for c in sinks.EXTRACTED if c in items.columns]))

    def pushed(self, kind: str, payloads: Callable[[], DataFrame]) -> dict[str, str]:
        """Gives payloads to where the settings send that kind; what failed."""
        send = self.settings.push.get(kind)
        return each_on_its_own(sinks.chunked(payloads()), {f"push {kind}": send}) if send else {}

    def evolved(self, unknown: DataFrame, batch_id: int, stream: str) -> dict[str, str]:
        """Unknown columns of all tables and events: their rows go to the dynamic table, their names to the registry.

        A registry that can't be written does not stop the batch; returns the message of what failed.
        """
        if unknown.isEmpty():
            return {}
        self.tables.write("cdc_orders_dynamic", evolution.dynamic_of(unknown), batch_id, stream)
        found = evolution.types_of(unknown).withColumn("is_active", F.lit(False))
        register = lambda df: self.tables.write("cdc_schema_registry", aligned(df, T.StructType.fromDDL(REGISTRY)), batch_id, stream)
        return each_on_its_own(found, {"registry": register})

    def promote(self, table: str) -> None:
        """Makes the pending columns of a table part of its target from the next batch on, and fills them in for a keyed target's rows.

        An appended target is filled in as it is read (`evolution.backfill`). Runs beside the stream: what it writes has an id of its own.
        """
        run = f"promotion-{time.time_ns()}"
        pending = self.registry().filter(~F.col("is_active") & (F.col("table_name") == table)).persist()
        target = TARGETS[table]
        try:
            active = evolution.promote(pending, table, target).withColumn("promoted_at", F.current_timestamp())
            self.tables.put("cdc_schema_registry", active, 0, run)
            if MODES[target] == "upsert":
                key, columns = KEYS[table].lower(), active.collect()  # a row for each new column
                if columns:
                    kept = T.StructType.fromDDL("data STRING, event_timestamp TIMESTAMP, source_table STRING, order_id INT, customer_id INT")
                    dynamic = self.tables.rows("cdc_orders_dynamic", kept).filter(F.col("source_table") == table)
                    declared = to_target(self.spark.createDataFrame([], evolution.row_schema(table)), table, sequence=True).schema
                    have = self.tables.read(target, T.StructType([*declared, *[T.StructField(c["target_column"], T._parse_datatype_string(c["target_type"])) for c in columns]]), [key], SEQUENCE)
                    for c in columns:
                        have = evolution.backfill(have, dynamic, key, c["target_column"], c["column_name"], c["target_type"])
                    filled = have.filter(reduce(lambda a, b: a | b, [F.col(c["target_column"]).isNotNull() for c in columns]))
                    self.tables.put(target, filled, 0, run)
        finally:
            pending.unpersist()

    def failed(self, decoded: DataFrame, every: dict[str, DataFrame], batch_id: int, stream: str) -> None:
        """What could not be read goes to the dead letters: messages, values of other types, and XML of every event."""
        dead = lambda df, topic, payload: dead_letters(df, topic, payload, self.settings.consumer, F.current_timestamp())
        out = dead(invalid(decoded), F.col("topic"), F.col("value"))
        for table in every:
            out = out.unionByName(dead(mismatched(decoded, table, [KEYS[table]]), F.col("topic"), F.col("value")))
        if "ORDERS" in every:
            out = out.unionByName(dead(xml.malformed(every["ORDERS"], self.settings.items), F.lit("cdc/oracle/ORDERS"), F.col("_cdc_image")))
            out = out.unionByName(dead(xml.incomplete(every["ORDERS"], self.settings.items, ["_cdc_image"]), F.lit("cdc/oracle/ORDERS"), F.col("_cdc_image")))
        self.tables.write("cdc_dlq", out, batch_id, stream, self.settings.days.get("cdc_dlq"))
        self.pushed("dead_letters", lambda: sinks.dead_letter_notifications(out).select(F.to_json(F.struct("*")).alias("payload")))

    def lost(self, failures: dict[str, str]) -> DataFrame:
        rows = self.spark.createDataFrame([("WRITE_ERROR", m, n) for n, m in failures.items()], "error_type string, error_message string, name string")
        return dead_letters(rows, F.col("name"), F.lit(None).cast("string"), self.settings.consumer, F.current_timestamp())

    def enriched(self, changed: DataFrame, batch_id: int) -> None:
        """A batch of what `keyed.enriched` yields: enriched orders with their versions go to their table, where orders that are deleted
        leave; the aggregates count the orders that the batch brings itself. Orders of high value are notified, all go to the sinks."""
        stream = stream_of(changed)
        changed = changed.persist()
        try:
            if changed.isEmpty():
                return
            conflicts, rows = changed.filter("conflict IS NOT NULL"), changed.filter("conflict IS NULL").drop("conflict")
            out = rows.filter("NOT deleted").drop("deleted", "own")
            own = rows.filter("own AND NOT deleted")
            failures: dict[str, str] = {}
            jobs = [
                lambda: self.tables.put("cdc_orders_enriched", rows.withColumn(sinks.GONE, F.col("deleted")).drop("deleted", "own"), batch_id, stream),
                lambda: self.tables.write("cdc_order_aggregations", by_tier(own), batch_id, stream),
                lambda: failures.update(each_on_its_own(out.drop(*VERSIONS), self.settings.sinks) if self.settings.sinks else {}),
                lambda: failures.update(self.pushed("enriched", lambda: sinks.row_payloads(out, sinks.ENRICHED))),
                lambda: failures.update(self.pushed("notifications", lambda: alerts.high_value_notifications(own).select(F.to_json(F.struct("*")).alias("payload")))),
            ]
            side_by_side(self.spark, jobs)
            if self.settings.dead_letters:
                named = conflicts.select(F.lit("CONSTRAINT_VIOLATION").alias("error_type"), F.concat(F.lit("key exists: "), "conflict").alias("error_message"), F.concat(F.lit("cdc/oracle/"), F.split("conflict", " ")[0]).alias("topic"))
                dead = dead_letters(named, F.col("topic"), F.lit(None).cast("string"), self.settings.consumer, F.current_timestamp())
                dead = dead.unionByName(self.lost(failures)) if failures else dead
                if failures or not conflicts.isEmpty():
                    self.tables.write("cdc_dlq", dead, batch_id, stream)
        finally:
            changed.unpersist()

    def known(self) -> dict[str, DataFrame] | None:
        """What the tables hold, as the first state of a run without a checkpoint; None if they hold nothing yet."""
        if not any(self.tables.paths(TARGETS[t]) for t in KEYS):
            return None
        now = {}
        for table in (keyed.ORDER, keyed.ITEM, keyed.CUSTOMER):
            schema = to_target(self.spark.createDataFrame([], evolution.row_schema(table)), table, sequence=MODES[TARGETS[table]] == "upsert").schema
            now[table] = self.tables.read(TARGETS[table], schema, [KEYS[table].lower()], SEQUENCE)
        enriched = latest_versions(self.tables.rows("cdc_orders_enriched", T.StructType.fromDDL(ENRICHED)))
        return keyed.known_state(now[keyed.ORDER], now[keyed.ITEM], now[keyed.CUSTOMER], enriched)

    def orders_enriched(self) -> DataFrame:
        """The enriched orders as they are now."""
        return self.tables.read("cdc_orders_enriched", T.StructType.fromDDL(ENRICHED), ["order_id"], VERSIONS).drop(*VERSIONS)

    def start(self, messages: DataFrame, checkpoint: str, once: bool = False) -> Running:
        """Starts on a stream of messages; once: takes what is there and stops. The checkpoint makes a restart go on where it stopped; with a
        new one the state is taken from the tables first, and the messages must be those that came since."""
        self.spark.streams.addListener(self.statistics)

        def begin(stream: DataFrame, each: Callable[[DataFrame, int], None], name: str) -> StreamingQuery:
            writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/{name}")
            return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=self.settings.trigger)).start()

        # the state is read before this run's own writes reach the tables
        enriched = keyed.enriched(decode(messages), self._first_state(f"{checkpoint}/enriched")) if self.settings.enrich else None
        queries = [begin(enriched, self.enriched, "enriched")] if enriched is not None else []
        counted = messages.observe(self.settings.consumer, F.count(F.lit(1)).alias("rows"))
        return Running(self, [*queries, begin(counted, self.batch, "tables")])

    def _first_state(self, checkpoint: str) -> dict[str, DataFrame] | None:
        """The tables' state, written down, for a new checkpoint; Spark reads it in the first batch alone."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
        if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            known = self.known()
            return known and {k: df.limit(0) for k, df in known.items()}
        known = self.known()
        return known and {k: written(df) for k, df in known.items()}

    def report(self) -> None:
        """Rows, rates, lag and batch times since the last report, to cdc_metrics."""
        began, self._reported = self._reported, time.time()
        found = self.statistics.taken()
        if found:
            ends = F.timestamp_millis(F.lit(int(began * 1000))).alias("window_start"), F.timestamp_millis(F.lit(int(self._reported * 1000))).alias("window_end")
            df = self.spark.createDataFrame([(self.settings.consumer, n, v, u) for n, v, u in found], "consumer_id string, metric_name string, metric_value double, metric_unit string")
            self.tables.write("cdc_metrics", aligned(df.select("*", *ends), T.StructType.fromDDL(METRICS)), 0, f"metrics-{int(self._reported * 1000)}")


def new_columns(table: str, columns: list[Mapped]) -> list[Mapped]:
    """Those of a table's columns that are not declared."""
    declared = {m.source for m in mapping(table)}
    return [m for m in columns if m.source not in declared]


def latest_versions(rows: DataFrame) -> DataFrame:
    """(order_id, customer_id, order_version, customer_version) of all orders, of those that left too, so their versions go on."""
    best = F.max_by(F.struct("customer_id", *VERSIONS), F.struct(*VERSIONS))
    return rows.groupBy("order_id").agg(best.alias("b")).select("order_id", "b.*")


class Statistics(StreamingQueryListener):
    """Rows, rates, batch times and lag of each of the last micro-batches; observed: what DataFrame.observe counted."""

    def __init__(self, most: int = 10_000) -> None:
        self.batches: deque[dict] = deque(maxlen=most)
        self._new: deque[dict] = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        observed = {n: r.asDict() for n, r in (p.observedMetrics or {}).items()}
        batch = {
            "query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "ms": p.batchDuration,
            "state_rows": sum(s.numRowsTotal for s in p.stateOperators), "observed": observed, "behind": sum(_behind(s) for s in p.sources),
        }
        self.batches.append(batch)
        self._new.append(batch)

    def taken(self) -> list[tuple[str, float, str]]:
        """(name, value, unit) over the batches since it was asked last."""
        new = [self._new.popleft() for _ in range(len(self._new))]
        if not new:
            return []
        ms = sorted(b["ms"] for b in new)
        at = lambda q: quantiles(ms, n=100, method="inclusive")[q - 1] if len(ms) > 1 else ms[0]
        counted = sum(o.get("rows") or 0 for b in new for o in b["observed"].values())
        seconds = sum(ms) / 1000
        return [
            ("rows", float(counted), "rows"), ("rows_per_second", counted / seconds if seconds else 0.0, "rows/s"), ("batches", float(len(new)), "batches"),
            ("batch_p50", float(at(50)), "ms"), ("batch_p99", float(at(99)), "ms"), ("lag", float(new[-1]["behind"]), "offsets"),
        ]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _behind(source) -> int:
    """How far the offset that a batch reached is from the latest that the source has; 0 where they are no numbers."""

    def number(offset) -> int | None:
        found = [int(x) for x in re.findall(r"(?<=[:\s])-?\d+", str(offset or ""))]
        return sum(found) if found else None

    end, latest = number(source.endOffset), number(source.latestOffset)
    return max(0, latest - end) if end is not None and latest is not None else 0


def late_rows(batch: DataFrame, ts: str, watermark_ms: int) -> DataFrame:
    """The rows of a micro-batch that a watermark drops, for a side table."""
    return batch.filter(F.col(ts) < F.timestamp_millis(F.lit(watermark_ms)))


def collected(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream yields over all that is there now, as a table. Not for operators whose state expires by processing time: such
    a stream never ends by itself."""
    spark, schema = stream.sparkSession, stream.schema
    out = f"{folder}/out"

    def save(df: DataFrame, batch_id: int) -> None:
        df.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*schema, T.StructField("_batch", T.IntegerType())])).parquet(f"{out}/*")
