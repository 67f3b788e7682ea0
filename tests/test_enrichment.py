import json

import pytest
from pyspark.sql import functions as F

from sluice.operators import aggregates, alerts, joins, reports
from sluice.plans import batch
from sluice.sources import sinks
from tests.conftest import CUSTOMER, ITEM, ORDER, message


def enriched(feed, orders=None):
    return batch.enriched(feed(*(orders or [message("ORDERS", ORDER)])), feed(message("CUSTOMERS", CUSTOMER)), feed(message("ORDER_ITEMS", ITEM)))


def test_enriched_order(feed):
    r = enriched(feed).first()
    assert (r["order_id"], r["customer_id"], r["customer_name"], r["customer_tier"], r["customer_region"], float(r["total_amount"]), r["item_count"]) == (77, 9, "Ada Quill", "SILVER", "Turku", 71.5, 1)
    assert (r["window_end"] - r["window_start"]).seconds == 300


def test_unknown_customer_and_no_items(feed):
    r = enriched(feed, [message("ORDERS", {"ORDER_ID": 5, "CUSTOMER_ID": 6})]).first()
    assert (r["customer_name"], r["item_count"], r["total_amount"]) == (None, 0, None)


def test_deleted_rows_are_not_current(feed):
    assert enriched(feed, [message("ORDERS", ORDER), message("ORDERS", None, ORDER, "d", 1_700_000_000_001)]).count() == 0


def test_tiers(spark):
    e = spark.createDataFrame([("GOLD", 10.0), ("GOLD", None), (None, 5.0)], "customer_tier string, total_amount double").withColumns({"window_start": F.lit(None).cast("timestamp"), "window_end": F.lit(None).cast("timestamp")})
    plain = {r["customer_tier"]: (r["order_count"], r["total_revenue"], r["avg_order_value"]) for r in aggregates.by_tier(e).collect()}
    assert plain == {"GOLD": (2, 10.0, 10.0), "UNKNOWN": (1, 5.0, 5.0)}
    zero = {r["customer_tier"]: r["avg_order_value"] for r in aggregates.by_tier(e, null_as_zero=True).collect()}
    assert zero == {"GOLD": 5.0, "UNKNOWN": 5.0}


def test_dynamic_join_needs_the_key(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y", 2)], "k int, v string, w int")
    assert tuple(joins.dynamic_join(a, b, "k").first()) == (1, "x", "y", 2)
    with pytest.raises(ValueError):
        joins.dynamic_join(a, b, "z")


def test_alerts(spark):
    e = spark.createDataFrame([(1, 1, "GOLD", 10000.0), (2, 1, "GOLD", 9999.99), (3, 1, None, None)], "order_id int, customer_id int, customer_tier string, total_amount double")
    (n,) = alerts.high_value_notifications(e).collect()
    assert n["message"] == "High-value order 1: $10,000.00" and n["severity"] == "warning" and json.loads(n["payload"])["order_id"] == 1
    assert alerts.high_value(e, 9999.0, "GOLD").count() == 2


def test_dead_letters(spark):
    errors = spark.createDataFrame([("T", "x" * 3000, "{}")], "error_type string, error_message string, p string")
    d = sinks.dead_letters(errors, F.lit("t"), F.col("p"), "c", F.current_timestamp())
    r = d.first()
    assert len(r["error_message"]) == 1000 and (r["retry_count"], r["status"]) == (0, "pending")
    assert len(sinks.dead_letter_notifications(d).first()["message"]) == 200
    assert sinks.dead_letter_messages(d.withColumn("payload", F.lit("no json"))).first()["topic"] == "cdc/dlq/t"


def table(spark, tmp_path, name, columns, keys, order=("source_ts",)):
    """A keyed table with short ways to put rows and to read it."""
    t = sinks.Tables(spark, f"file://{tmp_path}")
    rows = lambda *x: spark.createDataFrame(list(x), columns)
    put = lambda i, *x, stream="one": t.put(name, rows(*x), i, stream)
    now = lambda: sorted(tuple(r) for r in t.read(name, rows().schema, keys, order).collect())
    return t, rows, put, now


def test_upsert_keeps_the_later_row_and_replays_once(spark, tmp_path):
    t, rows, put, now = table(spark, tmp_path, "cdc_customers", "customer_id int, name string, source_ts int", ["customer_id"])
    put(0, (1, "new", 5), (2, "b", 1))
    put(1, (1, "old", 4), (3, "c", 1))
    put(1, (1, "old", 4), (3, "c", 1))
    assert now() == [(1, "new", 5), (2, "b", 1), (3, "c", 1)] and not t.write("unknown", rows(), 0)


def test_of_equal_times_the_greater_sequence_number_counts(spark, tmp_path):
    columns = "customer_id int, name string, source_ts int, source_scn long"
    _, _, put, now = table(spark, tmp_path, "cdc_customers", columns, ["customer_id"], ("source_ts", "source_scn"))
    put(0, (1, "ten", 5, 10), (2, "x", 5, 7))
    put(1, (1, "nine", 5, 9), (2, "same", 5, 7), (3, "c", 5, None))
    put(2, (3, "d", 5, 1))
    assert [r[1] for r in now()] == ["ten", "same", "d"]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    t, found, put, now = table(spark, tmp_path, "cdc_schema_registry", "column_name string, kind string", ["column_name"], ())
    for i, x in [(0, "ab"), (0, "ab"), (1, "bc"), (1, "bc")]:
        put(i, *[(c, f"{i}") for c in x])
    assert now() == [("a", "0"), ("b", "0"), ("c", "1")]  # only missing keys are taken
    for _ in range(2):
        t.write("cdc_orders", spark.range(3), 4)
    assert t.read("cdc_orders", spark.range(1).schema).count() == 3


def test_streams_neither_replace_nor_skip_what_others_wrote(spark, tmp_path):
    """Batches 0 and 1 of a stream with a new checkpoint, and of two streams at once, after three batches of another."""
    t, rows, put, now = table(spark, tmp_path, "cdc_customers", "customer_id int, name string, source_ts int", ["customer_id"])
    for i in range(3):
        put(i, *[(10 * i + k, "a", 1) for k in range(10)])
        t.write("cdc_orders", spark.range(10 * i, 10 * i + 10), i, "one")
    for stream in ("two", "three"):
        for i in (0, 1):
            put(i, *[(10 * i + k, stream, 2) for k in range(10)], *[(100 + 10 * i + k, stream, 2) for k in range(10)], stream=stream)
            t.write("cdc_orders", spark.range(100, 110), i, stream)
    assert [r[:2] for r in now()] == [(k, "three" if k < 20 or k > 99 else "a") for k in [*range(30), *range(100, 120)]]
    assert t.read("cdc_orders", spark.range(1).schema).count() == 30 + 40


@pytest.mark.parametrize("step", ["rows", "fold", "removal"])
def test_a_stop_between_two_steps_loses_nothing(spark, tmp_path, monkeypatch, step):
    t, rows, put, now = table(spark, tmp_path, "cdc_customers", "customer_id int, name string, source_ts int", ["customer_id"])
    for i in range(4):
        put(i, (1, f"v{i}", i), (10 + i, "b", 1))
    whole = now()
    if step == "rows":  # files but no mark of Spark's committer
        put(4, (1, "half", 9))
        (tmp_path / "cdc_customers/one/batch=4/_SUCCESS").unlink()
    elif step == "fold":
        t.compact("cdc_customers", rows().schema, ["customer_id"], least=1)
        (tmp_path / "cdc_customers/one/upto=2/_SUCCESS").unlink()
    else:
        t.compact("cdc_customers", rows().schema, ["customer_id"], least=1)
        put(4, (1, "v3", 3))
        monkeypatch.setattr(t, "_drop", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            t.compact("cdc_customers", rows().schema, ["customer_id"], least=1)
    assert now() == whole == [(1, "v3", 3), *[(10 + i, "b", 1) for i in range(4)]]


def files(tmp_path, *names):
    return [p for p in tmp_path.joinpath(*names).rglob("*.parquet")]


def test_a_batch_writes_what_it_brings_and_folds_bound_the_disk(spark, tmp_path):
    """1,000 keys into 200,000: about 1,000 rows are written; over 100 batches files and bytes stay bounded, and no row changes."""
    import pyarrow.parquet as pq

    t = sinks.Tables(spark, f"file://{tmp_path}")
    big = spark.range(0, 200_000, 1, 4).selectExpr("CAST(id AS INT) AS customer_id", "'a' AS name", "0L AS source_ts")
    t.put("cdc_customers", big, 0, "one")
    small = spark.range(1000).selectExpr("CAST(id * 7 AS INT) AS customer_id", "'b' AS name", "1L AS source_ts")
    t.put("cdc_customers", small, 1, "one")
    assert sum(pq.read_metadata(p).num_rows for p in files(tmp_path, "cdc_customers", "one", "batch=1")) == 1000
    sizes = []
    for i in range(2, 102):
        few = spark.range(10, numPartitions=1).selectExpr(f"CAST(id * 7 AS INT) AS customer_id", f"'c{i}' AS name", f"{i}L AS source_ts")
        t.put("cdc_customers", few, i, "one")
        if i % 10 == 0:
            t.compact("cdc_customers", small.schema, ["customer_id"], least=5)
            sizes.append((len(files(tmp_path, "cdc_customers")), sum(p.stat().st_size for p in files(tmp_path, "cdc_customers"))))
    assert max(n for n, _ in sizes) < 60 and sizes[-1][1] < 1.2 * sizes[2][1]
    got = {r["name"]: r["n"] for r in t.read("cdc_customers", small.schema, ["customer_id"]).groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 199_000, "b": 990, "c101": 10}


def test_folding_an_appended_table_keeps_each_row_once(spark, tmp_path):
    t = sinks.Tables(spark, f"file://{tmp_path}")
    for i in range(12):
        t.write("cdc_orders", spark.range(5), i, "one")
        t.compact("cdc_orders", spark.range(1).schema, least=3)
        t.write("cdc_orders", spark.range(5), i, "one")  # the newest batch may run again
    assert t.read("cdc_orders", spark.range(1).schema).count() == 60
    assert len(t.paths("cdc_orders")) <= 5


def test_rows_are_removed_and_expire(spark, tmp_path):
    t, rows, put, now = table(spark, tmp_path, "state", "k int, ts int", ["k"], ("ts",))
    put(0, *[(i, i * 10) for i in range(6)])
    t.remove("state", rows((3, 31)), 1, "one")
    assert [r[0] for r in now()] == [0, 1, 2, 4, 5]
    put(2, (3, 5))  # an older row doesn't bring the key back
    put(3)
    assert [r[0] for r in now()] == [0, 1, 2, 4, 5]
    t.compact("state", rows().schema, ["k"], ("ts",), least=1, keep=F.col("ts") >= 20)
    assert [r[0] for r in now()] == [2, 4, 5]


def test_days_are_dropped_whole(spark, tmp_path):
    """Retention removes the folders of old days; no other file is touched, and scans of a day read that day alone."""
    import datetime

    t = sinks.Tables(spark, f"file://{tmp_path}")
    days = spark.range(0, 40).selectExpr("id", "TIMESTAMP '2024-03-01 00:00:00' + make_dt_interval(CAST(id % 8 AS INT)) AS changed_at")
    for i in range(2):
        t.write("cdc_audit_log", days, i, "one", day="changed_at")
    before = {p: p.stat().st_mtime_ns for p in files(tmp_path, "cdc_audit_log")}
    assert t.expire("cdc_audit_log", datetime.date(2024, 3, 6)) == 10
    after = {p: p.stat().st_mtime_ns for p in files(tmp_path, "cdc_audit_log")}
    assert after == {p: m for p, m in before.items() if "day=2024-03-0" in str(p) and str(p).split("day=")[1][:10] >= "2024-03-06"} != {}
    left = t.read("cdc_audit_log", days.schema)
    assert left.count() == 30 and left.agg(F.min("changed_at")).first()[0].day == 6
    one = t.rows("cdc_audit_log", days.schema, (datetime.date(2024, 3, 7), datetime.date(2024, 3, 7)))
    assert one.count() == 10 and all("day=2024-03-07" in f for f in one.inputFiles())


def test_rules_about_waiting_and_dead_letters(spark):
    at = lambda m: f"TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, {m})"
    rows = spark.createDataFrame([(0, 1, 5.0), (1, 2, 90.0), (2, None, 5.0), (61, 62, 5.0)], "m int, d int, ms double")
    rows = rows.withColumns({"ts": F.expr(at("m")), "done": F.expr(at("d"))})
    got = {(r["rule"], r["value"]) for r in alerts.breaches(rows, "ts", F.lit(False), F.col("ms"), "60 minutes", 0.5, 50, 0, 0, done=F.col("done"), is_dead=F.col("m") == 1).collect()}
    assert got == {("p99_latency", 90.0), ("backlog", 1.0), ("dead_letters", 1.0)}


def test_the_p99_is_exact_in_large_windows(spark):
    rows = spark.range(0, 200_000, 1, 16).selectExpr("id % 2 AS w", "double(id * 7919 % 200000) AS ms").selectExpr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, int(w) * 60) AS ts", "ms")
    got = alerts.breaches(rows, "ts", F.lit(False), F.col("ms"), "60 minutes").filter("rule = 'p99_latency'").collect()
    each = [sorted(i * 7919 % 200_000 for i in range(w, 200_000, 2)) for w in (0, 1)]  # 100,000 values each, all different
    assert sorted(r["value"] for r in got) == sorted(float(v[98_999]) for v in each)


def test_dual_sinks(spark):
    seen = []

    def bad(df):
        raise RuntimeError("down")

    failed = sinks.each_on_its_own(spark.range(3), {"bad": bad, "good": lambda df: seen.append(df.count())})
    assert failed == {"bad": "down"} and seen == [3]


def test_chunks_and_pages(spark):
    p = spark.range(0, 1050, 1, 3).select(F.col("id").cast("string").alias("payload"))
    sizes = [len(r["payloads"]) for r in sinks.chunked(p).collect()]
    assert sum(sizes) == 1050 and max(sizes) == 100
    assert [r["id"] for r in reports.page(spark.range(10), ["id"], 3, 4).collect()] == [4, 5, 6]
