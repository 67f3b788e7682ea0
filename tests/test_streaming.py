import itertools
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators import evolution, xml
from sluice.operators.mapping import to_target
from sluice.plans import queries
from sluice.sources import envelope
from sluice.streaming import pipeline, stateful
from tests.conftest import CUSTOMER, ITEM, ORDER, SF, message


def put(folder, name, *messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"topic": t, "value": v}) + "\n" for t, v in messages))


def all_rows(spark, run, table):
    return [r.asDict() for r in spark.read.parquet(*run.tables.paths(table)).collect()] if run.tables.paths(table) else []


def customers(spark, run):
    schema = to_target(spark.createDataFrame([], evolution.row_schema("CUSTOMERS")), "CUSTOMERS", sequence=True).schema
    return [r["tier"] for r in run.tables.read("cdc_customers", schema, ["customer_id"], pipeline.SEQUENCE).collect()]


def enriched(run):
    return {r["order_id"]: (r["customer_name"], r["item_count"]) for r in run.orders_enriched().collect()}


def runner(spark, tmp_path, settings=None):
    """A pipeline, and a function that feeds it a file of messages; each file may have a checkpoint of its own."""
    run, n = pipeline.Pipeline(spark, f"file://{tmp_path}/tables", settings), itertools.count()

    def go(*messages, checkpoint="checkpoint", folder="in"):
        if messages:
            put(tmp_path / folder, f"{next(n):03d}.json", *messages)
        run.start(envelope.read_feed(spark, f"file://{tmp_path}/{folder}", 1), f"file://{tmp_path}/{checkpoint}", once=True).awaitTermination()

    return run, go


def test_pipeline_and_restart(spark, tmp_path):
    run, go = runner(spark, tmp_path)
    broken = ORDER | {"ORDER_ID": 7, "SHIPPING_INFO": "<a><items>", "PRIORITY": "HIGH"}
    go(message("ORDERS", ORDER), message("CUSTOMERS", CUSTOMER), message("ORDER_ITEMS", ITEM), message("ORDERS", broken), ("cdc/oracle/SALES/ORDERS/insert", "bad"))
    go(message("CUSTOMERS", CUSTOMER | {"TIER": "PLATINUM"}, op="u", ts_ms=1_700_000_000_001))
    go()
    assert customers(spark, run) == ["PLATINUM"]
    assert sorted(r["order_id"] for r in all_rows(spark, run, "cdc_orders")) == [7, 77]
    assert len(all_rows(spark, run, "cdc_order_items_extracted")) == 2
    assert sorted(r["error_type"] for r in all_rows(spark, run, "cdc_dlq")) == ["MALFORMED_JSON", "MALFORMED_XML"]
    assert [json.loads(r["data"]) for r in all_rows(spark, run, "cdc_orders_dynamic")] == [{"PRIORITY": "HIGH"}]
    assert enriched(run) == {77: ("Ada Quill", 1), 7: ("Ada Quill", 0)}
    assert {r["customer_tier"] for r in run.orders_enriched().collect()} == {"PLATINUM"}


@pytest.mark.parametrize("fresh", [False, True])
def test_enriched_over_several_batches(spark, tmp_path, fresh):
    """The order, its items and its customer come in batches of their own, in any order; fresh: each run has a new checkpoint and knows
    what came before from the tables alone."""
    run, go = runner(spark, tmp_path, pipeline.Settings(dead_letters=False))
    item = lambda i, order=77: ITEM | {"ITEM_ID": i, "ORDER_ID": order}
    later = 1_700_000_000_001
    batches = [
        ([message("ORDER_ITEMS", item(1))], {}),
        ([message("ORDERS", ORDER), message("ORDERS", ORDER | {"ORDER_ID": 7})], {77: (None, 1), 7: (None, 0)}),
        ([message("CUSTOMERS", CUSTOMER), message("ORDER_ITEMS", item(2))], {77: ("Ada Quill", 2), 7: ("Ada Quill", 0)}),
        ([message("ORDERS", ORDER | {"STATUS": "SHIPPED"}, op="u", ts_ms=later), message("ORDER_ITEMS", item(2, 7), op="u", ts_ms=later)], {77: ("Ada Quill", 1), 7: ("Ada Quill", 1)}),
        # an older order and item, and deletes
        ([message("ORDERS", ORDER), message("ORDER_ITEMS", item(2)), message("ORDER_ITEMS", None, item(1), op="d", ts_ms=later), message("ORDERS", None, ORDER | {"ORDER_ID": 7}, op="d", ts_ms=later)], {77: ("Ada Quill", 0)}),
        # to another customer, of whom nothing is known
        ([message("ORDERS", ORDER | {"CUSTOMER_ID": 8}, op="u", ts_ms=later + 1)], {77: (None, 0)}),
        ([message("CUSTOMERS", CUSTOMER | {"CUSTOMER_ID": 8, "FIRST_NAME": "Bo"}), message("CUSTOMERS", CUSTOMER | {"TIER": "X"}, op="u", ts_ms=later)], {77: ("Bo Quill", 0)}),
        ([message("CUSTOMERS", None, CUSTOMER | {"CUSTOMER_ID": 8}, op="d", ts_ms=later)], {77: (None, 0)}),
    ]
    for i, (messages, want) in enumerate(batches):
        own = {"checkpoint": f"checkpoint{i}", "folder": f"in{i}"} if fresh else {}
        go(*messages, **own)
        assert enriched(run) == want, i


def test_new_checkpoint_loses_no_row(spark, tmp_path):
    """Three files, then two more by a stream with a new checkpoint, whose batch numbers start again; a replay changes nothing."""
    run, go = runner(spark, tmp_path)
    orders = lambda ids: [message("ORDERS", ORDER | {"ORDER_ID": i}) for i in ids]
    for i in range(3):
        put(tmp_path / "in", f"{i}.json", *orders(range(10 * i, 10 * i + 10)), message("CUSTOMERS", CUSTOMER | {"CUSTOMER_ID": i}))
    go()
    for i in range(2):
        put(tmp_path / "more", f"{i}.json", *orders(range(100 + 10 * i, 110 + 10 * i)), message("CUSTOMERS", CUSTOMER | {"CUSTOMER_ID": i, "TIER": "NEW"}, op="u", ts_ms=1_700_000_000_009))
    go(checkpoint="second", folder="more")
    assert sorted(r["order_id"] for r in all_rows(spark, run, "cdc_orders")) == [*range(30), *range(100, 120)]
    assert sorted(customers(spark, run)) == ["NEW", "NEW", "SILVER"] and len(enriched(run)) == 50
    before = {t: sorted(map(repr, all_rows(spark, run, t))) for t in ("cdc_orders", "cdc_orders_enriched")}
    go(checkpoint="second", folder="more")
    assert before == {t: sorted(map(repr, all_rows(spark, run, t))) for t in before}


def test_a_batch_reads_no_table(spark, tmp_path, monkeypatch):
    """However large the tables are: enrichment lives on its state, and writes look at nothing that is there."""
    run, go = runner(spark, tmp_path)
    go(*[message("ORDERS", ORDER | {"ORDER_ID": i}) for i in range(200)], message("CUSTOMERS", CUSTOMER))
    monkeypatch.setattr(run, "known", lambda: None)
    monkeypatch.setattr(run.tables, "rows", lambda *_: (_ for _ in ()).throw(AssertionError("a table was read")))
    go(message("ORDER_ITEMS", ITEM), message("CUSTOMERS", CUSTOMER | {"TIER": "GOLD"}, op="u", ts_ms=1_700_000_000_001))
    monkeypatch.undo()
    assert {r["customer_tier"] for r in run.orders_enriched().collect()} == {"GOLD"} and enriched(run)[77] == ("Ada Quill", 1)


def test_promoted_column_of_a_keyed_table(spark, tmp_path):
    """An unknown column is registered, promoted, filled in for rows that came before, and written by later batches."""
    run, go = runner(spark, tmp_path, pipeline.Settings(enrich=False))
    person = lambda i, **more: message("CUSTOMERS", CUSTOMER | {"CUSTOMER_ID": i} | more)
    go(person(1, MOOD="calm"), person(2))
    assert [(r["column_name"], r["is_active"]) for r in run.registry().collect()] == [("MOOD", False)]
    run.promote("CUSTOMERS")
    read = lambda: {r["customer_id"]: (r["mood"], r["tier"]) for r in run.tables.read("cdc_customers", T.StructType.fromDDL("customer_id INT, tier STRING, mood STRING, source_ts TIMESTAMP"), ["customer_id"]).collect()}
    assert read() == {1: ("calm", "SILVER"), 2: (None, "SILVER")}
    go(person(3, MOOD="wild", ODD=1), message("CUSTOMERS", CUSTOMER | {"CUSTOMER_ID": 1, "TIER": "GOLD", "MOOD": "glad"}, op="u", ts_ms=1_700_000_000_001))
    assert read() == {1: ("glad", "GOLD"), 2: (None, "SILVER"), 3: ("wild", "SILVER")}
    assert sorted((r["column_name"], r["is_active"]) for r in run.registry().collect()) == [("MOOD", True), ("ODD", False)]
    assert [json.loads(r["data"]) for r in all_rows(spark, run, "cdc_orders_dynamic")] == [{"MOOD": "calm"}, {"ODD": 1}]


def test_item_lists_cap_and_expire(spark, tmp_path):
    stateful.with_rocksdb(spark)
    rows = [(1, i, i) for i in range(150)] + [(2, 1, 0), (2, 2, 10_000_000)]
    spark.createDataFrame(rows, "order_id long, item_id long, ts long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("order_id long, item_id long, ts long").parquet(f"{tmp_path}/in")
    out = pipeline.collected(stateful.item_lists(stream, ttl_ms=3_600_000), f"{tmp_path}/out", "update")
    got = {r["order_id"]: r["items"] for r in out.collect()}
    assert got[1] <= 100 and got[2] == 1


def test_late_rows(spark):
    rows = spark.createDataFrame([(1_000,), (9_000,)], "ms long").select(F.timestamp_millis("ms").alias("ts"))
    assert pipeline.late_rows(rows, "ts", 5_000).count() == 1


def test_first_run_starts_from_known_state(spark, tmp_path):
    stateful.with_rocksdb(spark)
    spark.createDataFrame([(1, 5, 1), (1, 8, 2), (2, 5, 3)], "key long, ts long, scn long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key long, ts long, scn long").parquet(f"{tmp_path}/in")
    known = spark.createDataFrame([(1, 6)], "key long, ts long")
    got = pipeline.collected(stateful.drop_stale(stream, known=known), f"{tmp_path}/out").collect()
    assert sorted((r["key"], r["ts"]) for r in got) == [(1, 8), (2, 5)]


def test_pipeline_sides(spark, tmp_path):
    """Registry, dynamic rows of all tables and events, dead letters of every kind, a sink that fails, payloads, and sequence numbers."""
    seen, sent = [], {}

    def down(df):
        raise RuntimeError("no route")

    push = {kind: lambda df, k=kind: sent.setdefault(k, []).extend(p for r in df.collect() for p in r["payloads"]) for kind in ("events", "items", "enriched", "notifications", "dead_letters")}
    settings = pipeline.Settings(sinks={"push": down, "copy": lambda df: seen.append(df.count())}, push=push, report_seconds=0)
    run, go = runner(spark, tmp_path, settings)
    broken = message("ORDERS", ORDER | {"SHIPPING_INFO": "<a><items>", "RUSH": True}, ts_ms=1)
    go(broken, message("ORDERS", ORDER | {"TOTAL_AMOUNT": 12_000}), message("CUSTOMERS", CUSTOMER | {"MOOD": "calm"}, scn="10"), message("CUSTOMERS", {"CUSTOMER_ID": "none"}))
    go(message("CUSTOMERS", CUSTOMER | {"TIER": "LATE"}, scn="9"), message("ORDERS", ORDER | {"STATUS": "STALE"}, ts_ms=2), message("ORDERS", ORDER | {"RUSH": False}, ts_ms=3))
    read = lambda t: all_rows(spark, run, t)
    assert sorted((r["table_name"], r["column_name"]) for r in run.registry().collect()) == [("CUSTOMERS", "MOOD"), ("ORDERS", "RUSH")]
    assert sorted((r["source_table"], json.loads(r["data"]).popitem()) for r in read("cdc_orders_dynamic")) == [("CUSTOMERS", ("MOOD", "calm")), ("ORDERS", ("RUSH", False)), ("ORDERS", ("RUSH", True))]
    # the second batch brings only news that are stale, so nothing is enriched or pushed by it
    assert sorted((r["error_type"], r["original_topic"]) for r in read("cdc_dlq")) == [("MALFORMED_XML", "cdc/oracle/ORDERS"), ("SCHEMA_MISMATCH", "cdc/oracle/SALES/CUSTOMERS/insert"), ("WRITE_ERROR", "push")]
    assert customers(spark, run) == ["SILVER"] and [r["status"] for r in run.orders_enriched().collect()] == ["CONFIRMED"]
    assert seen == [1] and max(r["last_offset"] for r in run.tables.reached("cdc_checkpoints").collect()) == 10
    assert [json.loads(p)["event_type"] for p in sent["notifications"]] == ["HIGH_VALUE_ORDER"] and len(sent["enriched"]) == 1
    assert {json.loads(p)["table"] for p in sent["events"]} == {"ORDERS", "CUSTOMERS"} and len(sent["items"]) == 4
    assert {json.loads(p)["event_type"] for p in sent["dead_letters"]} == {"MALFORMED_XML", "SCHEMA_MISMATCH"}
    metrics = {(r["metric_name"], r["metric_unit"]) for r in read("cdc_metrics")}
    assert {("rows", "rows"), ("rows_per_second", "rows/s"), ("batch_p50", "ms"), ("batch_p99", "ms"), ("lag", "offsets")} <= metrics


def test_conflicts_and_incomplete_items_are_dead_letters(spark, tmp_path):
    """An event that creates a key that lives is taken as news and told; an event that comes again is not."""
    how = xml.ITEMS._replace(required=("quantity",), on_missing="dlq")
    run, go = runner(spark, tmp_path, pipeline.Settings(items=how))
    first = message("ORDERS", ORDER)
    go(first, message("ORDERS", ORDER | {"ORDER_ID": 8, "SHIPPING_INFO": '<s><items><item product_id="1"/></items></s>'}), message("CUSTOMERS", CUSTOMER))
    go(first, message("CUSTOMERS", CUSTOMER, op="r", ts_ms=1_700_000_000_005), message("ORDER_ITEMS", ITEM))
    go(message("ORDERS", ORDER | {"STATUS": "AGAIN"}, ts_ms=1_700_000_000_009), message("ORDER_ITEMS", ITEM | {"QUANTITY": 5}, ts_ms=1_700_000_000_009))
    found = sorted((r["error_type"], r["original_topic"], r["error_message"]) for r in all_rows(spark, run, "cdc_dlq"))
    assert found == [
        ("CONSTRAINT_VIOLATION", "cdc/oracle/ORDERS", "key exists: ORDERS 77"), ("CONSTRAINT_VIOLATION", "cdc/oracle/ORDER_ITEMS", "key exists: ORDER_ITEMS 300"),
        ("MALFORMED_XML", "cdc/oracle/ORDERS", "an item in SHIPPING_INFO lacks quantity"),
    ]
    assert {r["order_id"]: (r["status"], r["item_count"]) for r in run.orders_enriched().collect()} == {77: ("AGAIN", 1), 8: ("CONFIRMED", 0)}


def test_lag_is_told_from_offsets():
    source = lambda end, latest: type("Source", (), {"endOffset": end, "latestOffset": latest})
    assert pipeline._behind(source('{"t":{"0":5,"1":7}}', '{"t":{"0":9,"1":7}}')) == 4
    assert pipeline._behind(source('{"logOffset":3}', None)) == 0 and pipeline._behind(source(None, "x")) == 0


def test_output_modes_and_statistics(spark, tmp_path):
    spark.createDataFrame([(1, 2), (1, 3), (2, 5)], "k int, v int").repartition(2).write.parquet(f"{tmp_path}/in")
    stats = pipeline.Statistics()
    spark.streams.addListener(stats)
    try:
        sums = spark.readStream.schema("k int, v int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").groupBy("k").agg(F.sum("v").alias("v"))
        out = pipeline.collected(sums, f"{tmp_path}/out", "complete")
        last = out.agg(F.max("_batch")).first()[0]
        assert sorted((r["k"], r["v"]) for r in out.filter(F.col("_batch") == last).collect()) == [(1, 5), (2, 5)]
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        assert sum(b["rows"] for b in stats.batches) == 3 and all(b["ms"] >= 0 for b in stats.batches)
    finally:
        spark.streams.removeListener(stats)


def test_state_expires(spark, tmp_path):
    """The same row passes again once its key is forgotten."""
    import time

    stateful.with_rocksdb(spark)
    schema, got = "key long, ts long, scn long", []
    put_row = lambda: spark.createDataFrame([(1, 5, 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put_row()
    stream = stateful.drop_stale(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ttl_ms=1)
    query = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        for n in (1, 2):
            end = time.time() + 60
            while len(got) < n and time.time() < end:
                time.sleep(0.3)
            put_row()
    finally:
        query.stop()
    assert len(got) >= 2


def test_a_silent_source_raises_an_alert(spark, tmp_path):
    """A timer of processing time fires without input: once for each silence."""
    import time

    schema, got = "source string, ts_ms long", []
    put_row = lambda ts: spark.createDataFrame([("a", ts)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put_row(5)
    watched = stateful.silent_sources(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), after_ms=500)
    query = watched.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        for n in (1, 2):
            end = time.time() + 60
            while len(got) < n and time.time() < end:
                time.sleep(0.2)
            if n == 1:
                time.sleep(3)
                assert len(got) == 1
                put_row(9)
    finally:
        query.stop()
    assert [(r["source"], r["last_ts"]) for r in got] == [("a", 5), ("a", 9)]


def test_state_of_closed_windows_is_dropped(spark, tmp_path):
    """The joins and the window behind them keep fewer rows once the watermark has passed."""
    from sluice.plans import queries
    from tests.conftest import SF

    stats = pipeline.Statistics()
    spark.streams.addListener(stats)
    try:
        out = stateful.tier_windows(*queries.four_streams(spark, SF), "1 day", "300 days", "30 days")
        assert pipeline.collected(out, f"{tmp_path}/out").count() > 0
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(stats)
    held = [b["state_rows"] for b in stats.batches]
    assert held[-1] < 0.7 * max(held)


def test_a_list_in_reach_of_its_timer_goes_on(spark, tmp_path):
    """Each item sets the timer anew; a list ends between two items of one batch too."""
    for part in ([(1, 1000), (1, 1050), (2, 1000)], [(1, 1140), (1, 1300), (2, 1090)], [(3, 2000)], [(3, 2010)]):
        spark.createDataFrame(part, "order_id long, s long").select("order_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("order_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = pipeline.collected(stateful.expired_lists(stream, 100_000, "200 seconds"), f"{tmp_path}/out").collect()
    assert sorted((r["order_id"], r["items"], r["first_ts"], r["last_ts"]) for r in got) == [(1, 1, 1_300_000, 1_300_000), (1, 3, 1_000_000, 1_140_000), (2, 2, 1_000_000, 1_090_000)]


def test_keys_share_state_in_groups(spark, tmp_path):
    """State is kept by group, so its rows, and the calls of a batch, are as many as groups at most; keys of a group don't mix."""
    stateful.with_rocksdb(spark)
    day = 86_400_000
    items = spark.range(4000).selectExpr("id % 1000 AS order_id", "id AS item_id", f"(id % 1000 + id div 1000) * {day // 1000} AS ts", "id div 2000 AS half")
    for half in (0, 1):
        items.filter(f"half = {half}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/items")
        spark.range(100).filter(f"id % 2 = {half}").selectExpr("id AS customer_id", "concat('c', id) AS name", "1 AS ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/people")
    stream = lambda of, ddl: spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{of}")
    i = stream("items", "order_id long, item_id long, ts long")
    lists = pipeline.collected(stateful.item_lists(i, cap=3, keep=2, groups=4), f"{tmp_path}/lists", "update").collect()
    assert sorted((r["_batch"], r["order_id"], r["items"]) for r in lists) == [(b, o, 2) for b in (0, 1) for o in range(1000)]
    orders = i.select(F.col("order_id").alias("customer_id"), F.col("item_id").alias("order_id"))
    pending = pipeline.collected(stateful.pending_join(orders, stream("people", "customer_id long, name string, ts long"), groups=4), f"{tmp_path}/pending").collect()
    assert sorted((r["order_id"], r["customer_name"]) for r in pending) == [(o, f"c{o % 1000}") for o in range(4000) if o % 1000 < 100]
    timed = i.select("order_id", F.timestamp_millis("ts").alias("ts"))
    ended = pipeline.collected(stateful.expired_lists(timed, 600_000, "1 second", groups=4), f"{tmp_path}/ended").collect()
    assert all(r["items"] == 4 and r["last_ts"] - r["first_ts"] == 3 * (day // 1000) for r in ended if r["order_id"] >= 200) and len({r["order_id"] for r in ended}) == len(ended) > 0
    last = max(r["ts"] for r in items.collect())
    assert {r["order_id"] for r in ended} == {o for o in range(1000) if (o + 3) * (day // 1000) + 600_000 <= last - 1000}
    states = [spark.read.format("statestore").option("stateVarName", var).load(f"{tmp_path}/{of}/checkpoint") for of, var in (("lists", "items"), ("ended", "lists"))]
    assert all(0 < s.count() <= 4 for s in states)


def test_streams_of_large_tables_have_more_files(spark, tmp_path):
    """No task writes a quarter of a large table, and the micro-batches stay as many."""
    spark.range(0, 40_000, 1, 24).selectExpr("id", "timestamp_millis(id) AS ts").write.parquet(f"{tmp_path}/t.parquet")
    size = max(p.stat().st_size for p in (tmp_path / "t.parquet").glob("*.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size + 1))
    spark.conf.set("spark.sql.files.openCostInBytes", str(size + 1))
    try:
        whole = queries.feeds.table(spark, str(tmp_path), "t")
        streams = {"dealt": queries._stream(spark, str(tmp_path), "t", 2), "timed": queries._timed(spark, whole, "ts")}
        for (name, stream), batches in zip(streams.items(), (2, 4), strict=True):
            assert len(whole.inputFiles()) == 24
            got = pipeline.collected(stream, f"{tmp_path}/{name}")
            assert got.count() == 40_000 and got.select("_batch").distinct().count() == batches
            files = spark.read.text(f"{tmp_path}/{name}/checkpoint/sources/0/*").filter("value LIKE '{%'").count()
            assert files == 24
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_enriched_orders_share_state_in_groups(spark, tmp_path):
    """The state has a value for each group, not for each key; numbers beyond 53 bits, far dates and nulls pass through it unharmed."""
    from sluice.streaming import keyed

    big = 2**53
    far = ORDER | {"ORDER_ID": 1, "ORDER_DATE": "9999-12-31", "CUSTOMER_ID": None, "TOTAL_AMOUNT": None}
    news = lambda status, scn: message("ORDERS", ORDER | {"ORDER_ID": 2, "STATUS": status}, op="u", scn=scn)
    first = [message("ORDERS", far, scn=None), news("OLD", str(big)), message("CUSTOMERS", CUSTOMER), *[message("ORDERS", ORDER | {"ORDER_ID": i}) for i in range(10, 60)]]
    put(tmp_path / "in", "0.json", *first)
    os.utime(tmp_path / "in" / "0.json", (1_700_000_000, 1_700_000_000))  # files come by their times
    put(tmp_path / "in", "1.json", news("NEW", str(big + 1)), news("OLD", str(big)), message("ORDER_ITEMS", ITEM | {"ORDER_ID": 2}))
    seen = []
    out = keyed.enriched(envelope.decode(envelope.read_feed(spark, f"file://{tmp_path}/in", 1)), groups=3)
    q = out.writeStream.foreachBatch(lambda df, n: seen.extend((n, r) for r in df.collect())).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    states = [s.numRowsTotal for p in q.recentProgress for s in p.stateOperators]
    assert max(states) <= 12  # two lists a group, each with its number of entries
    rows = {(n, r["order_id"]): r for n, r in seen}
    assert sorted(rows) == [(0, 1), (0, 2), *[(0, i) for i in range(10, 60)], (1, 2)]
    alone = rows[0, 1]
    assert str(alone["order_date"]).startswith("9999-12-31") and (alone["customer_id"], alone["total_amount"], alone["customer_name"]) == (None, None, None)
    assert (rows[0, 2]["status"], rows[1, 2]["status"], rows[1, 2]["item_count"], rows[1, 2]["customer_name"]) == ("OLD", "NEW", 1, "Ada Quill")


def test_messages_of_the_metrics_run_lie_in_as_many_files_as_splits(spark, tmp_path, monkeypatch):
    """Three micro-batches of several files each: no task writes a third of a large feed."""
    monkeypatch.setattr(queries, "shared_folder", lambda _: f"file://{tmp_path}/run")
    got = {r["metric_name"]: r["metric_value"] for r in queries.stream_metrics(spark, SF).collect()}
    splits = queries.feeds.feed(spark, SF, "ORDERS").rdd.getNumPartitions()
    assert splits > 3 and len(list((tmp_path / "run" / "in").glob("*.json"))) >= splits
    assert got == {"rows": spark.read.parquet(f"{SF}/orders.parquet").count(), "batches": 3}


def test_batches_carry_images_no_further_than_they_are_read(spark, tmp_path, monkeypatch):
    """A batch keeps no row images beside the one that counts, and the sort for the latest rows has none; a promoted column is read all the same."""
    seen, latest = [], pipeline.latest_by_key
    monkeypatch.setattr(pipeline, "latest_by_key", lambda df, keys: (seen.append(df.columns), latest(df, keys))[1])
    kept, unknown = [], pipeline.evolution.unknown
    monkeypatch.setattr(pipeline.evolution, "unknown", lambda decoded, *a: (kept.append(decoded.columns), unknown(decoded, *a))[1])
    run, go = runner(spark, tmp_path, pipeline.Settings(enrich=False))
    go(message("CUSTOMERS", CUSTOMER | {"POINTS": 5}))
    run.promote("CUSTOMERS")
    go(message("CUSTOMERS", CUSTOMER | {"POINTS": 6}, op="u", scn="2"))
    assert seen and not any("_cdc_image" in columns for columns in seen) and "POINTS" in seen[-1]
    assert kept and not any({"before", "after"} & set(columns) for columns in kept)
    assert 6 in [r["points"] for r in spark.read.option("mergeSchema", True).parquet(*run.tables.paths("cdc_customers")).collect()]


def test_messages_of_large_feeds_are_packed(spark, tmp_path):
    """Feeds' messages lie on disk packed, in as many files as a micro-batch can read at once."""
    feed = queries.feeds.feed(spark, SF, "ORDERS")
    each = queries._sent(feed, f"file://{tmp_path}/in", 2)
    files = list((tmp_path / "in").glob("part-*"))
    assert len(files) == 2 * each and all(f.name.endswith(".json.gz") for f in files)
    assert sum(f.stat().st_size for f in files) < feed.selectExpr("sum(length(value))").first()[0] / 4
    assert spark.read.schema(envelope.FEED).json(f"{tmp_path}/in").exceptAll(feed).isEmpty()
