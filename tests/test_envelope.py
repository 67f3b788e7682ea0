import json

from pyspark.sql import functions as F

from sluice.operators import dedup, evolution, mapping
from sluice.sources import envelope
from tests.conftest import SF, CUSTOMER, ORDER, PRODUCT, message


def decoded(feed, *messages):
    return envelope.decode(feed(*messages))


def test_row_image_follows_the_operation(feed):
    d = decoded(feed, message("ORDERS", ORDER), message("ORDERS", None, ORDER, "d"), message("ORDERS", {"ORDER_ID": 2}, ORDER, "u"), message("ORDERS", {"ORDER_ID": 3}, op="r"))
    got = [(r["_cdc_op"], r["ORDER_ID"]) for r in envelope.rows(d, "ORDERS").collect()]
    assert got == [("c", 77), ("d", 77), ("u", 2), ("r", 3)]


def test_flat_payload_defaults_and_empty_body(spark, feed):
    flat = message("ORDERS", {"ORDER_ID": 7}, wrapped=False)
    bare = ("cdc/oracle/SALES/ORDERS/insert", json.dumps({"after": {"ORDER_ID": 8}}))
    d = envelope.decode(feed(flat, bare, ("t", "  "), ("t", None)).withColumn("received_at", F.timestamp_millis(F.lit(5000))))
    got = [(r["ORDER_ID"], r["_cdc_op"], r["_cdc_ts_ms"]) for r in envelope.rows(d, "ORDERS").collect()]
    assert got == [(7, "c", 1_700_000_000_000), (8, "c", 5000)] and d.count() == 2


def test_errors(feed):
    d = decoded(feed, message("ORDERS", ORDER, op="x"), message("ORDERS", {}), ("a/b/c/ORDERS/e", "not json"), message("ORDERS", ORDER))
    assert [r["error_message"] for r in d.collect()] == ["unknown operation x", "empty row image", "not valid JSON", None]
    assert envelope.invalid(d).count() == 3 and envelope.valid(d).count() == 1


def test_topics(feed):
    rows = envelope.topic_parts(feed(("a/b/S/T/o", ""), ("a/b/S", ""), ("a", ""))).collect()
    assert [(r["schema_name"], r["table_name"], r["operation"]) for r in rows] == [("S", "T", "o"), ("S", "UNKNOWN", "unknown"), ("UNKNOWN", "UNKNOWN", "unknown")]
    f = feed(("cdc/x/ORDERS/insert", ""), ("cdc/x/y/ORDERS/insert", ""), ("cdc.x/ORDERS/insert", ""))
    assert [r["topic"] for r in envelope.subscribe(f, ["cdc/*/ORDERS/*"]).collect()] == ["cdc/x/ORDERS/insert"]
    assert envelope.subscribe(f, []).count() == 0


def test_bad_values_are_null_alone(feed):
    r = envelope.rows(decoded(feed, message("ORDERS", ORDER | {"TOTAL_AMOUNT": "much", "CUSTOMER_ID": 10**12})), "ORDERS").first()
    assert (r["ORDER_ID"], r["TOTAL_AMOUNT"], r["CUSTOMER_ID"], str(r["ORDER_DATE"])) == (77, None, None, "2023-06-30 00:00:00")
    bad = envelope.mismatched(decoded(feed, message("ORDERS", {"TOTAL_AMOUNT": "much"})), "ORDERS", ["ORDER_ID"]).first()
    assert bad["error_message"] == "TOTAL_AMOUNT does not fit double; ORDER_ID is missing"


def test_milliseconds_survive(feed):
    r = envelope.with_metadata(envelope.rows(decoded(feed, message("ORDERS", ORDER, ts_ms=1_700_000_000_123)), "ORDERS")).first()
    assert r["source_ts"].microsecond == 123_000


def test_encode_round_trip(spark):
    images = spark.createDataFrame([((1, 2.5), None, "c", 9, 3)], "after struct<ORDER_ID:int,TOTAL_AMOUNT:double>, before string, op string, ts_ms long, scn long")
    r = envelope.rows(envelope.decode(envelope.encode(images, "ORDERS")), "ORDERS").first()
    assert (r["ORDER_ID"], r["TOTAL_AMOUNT"], r["_cdc_ts_ms"], r["_cdc_scn"]) == (1, 2.5, 9, 3)


def test_latest_by_time_then_scn(feed):
    d = decoded(feed, message("ORDERS", {"ORDER_ID": 1, "STATUS": "a"}, ts_ms=5, scn="9"), message("ORDERS", {"ORDER_ID": 1, "STATUS": "b"}, ts_ms=5, scn="10"), message("ORDERS", {"ORDER_ID": 1, "STATUS": "c"}, ts_ms=4, scn="99"), message("ORDERS", {"STATUS": "z"}))
    assert [r["STATUS"] for r in dedup.latest_by_key(envelope.rows(d, "ORDERS"), ["ORDER_ID"]).collect()] == ["b"]


def test_a_thousand_updates_on_a_hundred_keys(feed):
    d = decoded(feed, *[message("ORDERS", {"ORDER_ID": i % 100, "TOTAL_AMOUNT": i}, ts_ms=i) for i in range(1000)])
    out = dedup.latest_by_key(envelope.rows(d, "ORDERS"), ["ORDER_ID"]).collect()
    assert len(out) == 100 and {r["TOTAL_AMOUNT"] for r in out} == {float(i) for i in range(900, 1000)}


def test_stale_and_capped(spark):
    rows = spark.createDataFrame([(1, 5, 0), (1, 5, 1), (1, 6, 2), (1, 4, 3), (2, 1, 4)], "k int, _cdc_ts_ms long, n int")
    assert [r["is_stale"] for r in dedup.stale(rows, ["k"], "n").orderBy("n").collect()] == [False, True, False, True, False]
    many = spark.range(150).selectExpr("1 AS k", "id AS _cdc_ts_ms", "id AS _cdc_scn")
    assert dedup.last_n(many, ["k"], 50, cap=100).count() == 50 and dedup.last_n(many.limit(80), ["k"], 50, cap=100).count() == 80


def test_mapping(feed):
    d = decoded(feed, message("CUSTOMERS", CUSTOMER), message("CUSTOMERS", {"CUSTOMER_ID": 2, "LAST_NAME": "Quill"}), message("CUSTOMERS", {"CUSTOMER_ID": 3}), message("PRODUCTS", PRODUCT), message("PRODUCTS", {"PRODUCT_ID": 2, "STATUS": "INACTIVE"}), message("PRODUCTS", {"PRODUCT_ID": 3}))
    people = mapping.to_target(envelope.rows(d, "CUSTOMERS"), "CUSTOMERS").orderBy("customer_id")
    assert [r["name"] for r in people.collect()] == ["Quill", None, "Ada Quill"] and "_last_name" not in people.columns
    goods = mapping.to_target(envelope.rows(d, "PRODUCTS"), "PRODUCTS").orderBy("product_id").collect()
    assert [r["is_active"] for r in goods] == [False, True, True]
    back = mapping.customers_back(people.filter("customer_id = 1 OR customer_id = 9")).first()
    assert (back["FIRST_NAME"], back["LAST_NAME"], back["CITY"]) == ("Ada", "Quill", "Turku")


def test_registry_drives_the_projection(spark, feed):
    registry = mapping.registry_seed(spark).unionByName(spark.createDataFrame([("ORDERS", "PRIORITY", "VARCHAR2(255)", "cdc_orders", "priority", "STRING", False)], mapping.registry_seed(spark).schema))
    assert not [m for m in mapping.load_mapping(registry)["ORDERS"] if m.target == "priority"]
    later = registry.withColumn("is_active", F.lit(True))
    assert [m for m in mapping.load_mapping(later)["ORDERS"] if m.target == "priority"]


def test_schema_evolution(spark, feed):
    extra = ORDER | {"PRIORITY": "HIGH", "POINTS": 7, "BIG": 3_000_000_000, "RATE": 7.0, "FLAG": True, "NOTHING": None, "OBJ": {"a": [1]}}
    e = envelope.rows(decoded(feed, message("ORDERS", extra), message("ORDERS", ORDER)), "ORDERS")
    assert {r[0] for r in evolution.new_columns(e, "ORDERS").collect()} == {"PRIORITY", "POINTS", "BIG", "RATE", "FLAG", "NOTHING", "OBJ"}
    kinds = {r["column_name"]: r["column_type"] for r in evolution.detected(e, "ORDERS").collect()}
    assert kinds == {"PRIORITY": "VARCHAR2(255)", "POINTS": "NUMBER(10)", "BIG": "NUMBER(19)", "RATE": "NUMBER(15,4)", "FLAG": "NUMBER(1)", "NOTHING": "VARCHAR2(255)", "OBJ": "VARCHAR2(255)"}
    (row,) = evolution.dynamic_rows(e, "ORDERS").collect()
    data = json.loads(row["data"])
    assert data["POINTS"] == 7 and data["OBJ"] == {"a": [1]} and row["order_id"] == 77
    empty = spark.createDataFrame([], "table_name string, column_name string")
    fresh = evolution.register(empty, evolution.detected(e, "ORDERS"))
    assert fresh.count() == 7 and evolution.register(fresh, evolution.detected(e, "ORDERS")).count() == 0
    target = spark.createDataFrame([(77,), (1,)], "order_id int")
    filled = evolution.backfill(target, evolution.dynamic_rows(e, "ORDERS"), "order_id", "points", "POINTS", "int").orderBy("order_id").collect()
    assert [r["points"] for r in filled] == [None, 7]


def test_snapshots_to_changes(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string"), spark.createDataFrame([(2, "x"), (3, None), (4, "d")], "k int, v string")
    got = {(r["op"], (r["after"] or r["before"])["k"]) for r in envelope.changes(old, new, "k").collect()}
    assert got == {("d", 1), ("u", 2), ("c", 4)}


def test_one_parse_of_each_event_and_image(spark, tmp_path):
    spark.createDataFrame([message("ORDERS", ORDER)], "topic string, value string").write.parquet(f"{tmp_path}/feed")
    out = envelope.rows(envelope.decode(spark.read.parquet(f"{tmp_path}/feed")), "ORDERS").filter("STATUS = 'CONFIRMED' AND _cdc_op = 'c'")
    assert out.count() == 1 and out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 2


def test_changed_columns_and_structs(spark, feed):
    e = lambda *images: envelope.rows(decoded(feed, *[message("ORDERS", i) for i in images]), "ORDERS")
    got = {tuple(r) for r in evolution.changed_columns(e({"ORDER_ID": 1, "OLD": 1}), e({"ORDER_ID": 1, "FRESH": 1})).collect()}
    assert got == {("OLD", "removed"), ("FRESH", "added")}
    names = evolution.struct_of("AUDIT_LOG", [{"column_name": "BETA"}, {"column_name": "LOG_ID"}]).names
    assert names == sorted(names) and names.count("LOG_ID") == 1 and "BETA" in names


def test_promoted_since(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 50), ("c", 59)], "column_name string, m int").withColumn("promoted_at", F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, m)"))
    assert [r[0] for r in evolution.promoted_since(rows, F.expr("TIMESTAMP '2024-01-01 01:20:00'")).collect()] == ["c", "b"]


def test_stored_feeds_are_packed(spark):
    """Messages repeat their frame: stored ones take a small part of their text."""
    import pyarrow.parquet as pq

    from sluice.plans import feeds

    files = [f.removeprefix("file://") for f in feeds.feed(spark, SF, "ORDER_ITEMS").inputFiles()]
    columns = [pq.ParquetFile(f).metadata.row_group(0).column(1) for f in files if pq.ParquetFile(f).metadata.num_row_groups]
    assert columns and {c.compression for c in columns} == {"ZSTD"}
