"""Joins of streams within a span of time, with state by groups of keys."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.streaming import pipeline, spans, stateful

AT = "timestamp_seconds(1600000000 + {})"


def streams(spark, folder, tables, files=3):
    """Each table as a stream of so many micro-batches."""
    for name, df in tables.items():
        for part in range(files):
            df.filter(f"n % {files} = {part}").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    return [spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}") for name, df in tables.items()]


def plain(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.fixture
def held(spark):
    stats = pipeline.Statistics()
    spark.streams.addListener(stats)
    yield lambda: (spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000), [b["state_rows"] for b in stats.batches])[1]
    spark.streams.removeListener(stats)


def test_four_streams_share_state_in_groups(spark, tmp_path, held):
    """Against Spark's own join of the tables: null keys and times, a hot key, the last year, other columns of any type; the state has as
    many rows as there are packs, not as rows of the streams."""
    tables = {
        "orders": spark.range(600).selectExpr("id AS n", "if(id % 50 = 0, null, id) AS order_id", "CAST(if(id % 3 = 0, 7, id % 60) AS INT) AS order_customer_id", f"CASE WHEN id % 41 = 0 THEN null WHEN id = 599 THEN TIMESTAMP '9999-12-31 23:59:59.999999' ELSE {AT.format('id % 100')} END AS order_ts", "if(id % 2 = 0, null, 9007199254740993 + id) AS big"),
        "customers": spark.range(70).selectExpr("id AS n", "if(id = 9, null, id) AS customer_id", f"{AT.format('id % 90')} AS customer_ts", "if(id % 4 = 0, null, CAST(id / 7 AS DECIMAL(20, 6))) AS credit", "array(id, null) AS list"),
        "items": spark.range(2000).selectExpr("id AS n", "id % 600 AS item_order_id", "id % 11 AS item_product_id", f"{AT.format('id % 130')} AS item_ts", "CAST(CAST(id AS STRING) AS BINARY) AS raw"),
        "products": spark.range(12).selectExpr("id AS n", "if(id < 2, 5, id) AS product_id", f"{AT.format('id * 8')} AS product_ts", "if(id = 5, null, concat('c', id)) AS category"),
    }
    tables = {name: df.withColumnRenamed("n", f"n_{name}").withColumn("n", F.col(f"n_{name}")) for name, df in tables.items()}
    o, c, i, p = [s.drop("n") for s in streams(spark, tmp_path, tables)]
    out = pipeline.collected(stateful.join_four(o, c, i, p, "10000 days", "40 seconds", groups=4), f"{tmp_path}/out")
    near = lambda a, b: F.expr(f"{a} BETWEEN {b} - INTERVAL 40 SECONDS AND {b} + INTERVAL 40 SECONDS")
    o, c, i, p = [df.drop("n") for df in tables.values()]
    want = o.join(c, F.expr("order_customer_id = customer_id") & near("customer_ts", "order_ts")).join(i, F.expr("order_id = item_order_id") & near("item_ts", "order_ts")).join(p, F.expr("item_product_id = product_id") & near("product_ts", "item_ts"))
    columns = [c for c in want.columns if c not in ("order_ts", "customer_ts", "product_ts")]
    assert {f.name: f.dataType for f in out.drop("_batch").schema} == {f.name: f.dataType for f in want.select(*columns).schema}
    got = plain(out, columns)
    assert got == plain(want, columns) and len(got) > 300
    # three joins of four groups; a batch brings at most a pack and a timer a side, and a pack has a key and a value
    assert 0 < held()[-1] <= 3 * 4 * 2 * 3 * 3


def test_many_small_packs_are_made_one(spark, tmp_path, held):
    rows = spark.range(120).selectExpr("id AS n", "id % 10 AS a", f"{AT.format('id')} AS a_ts")
    left, right = streams(spark, tmp_path, {"a": rows, "b": rows.selectExpr("n", "a AS b", "a_ts AS b_ts", "n AS other")}, 11)
    stateful.with_rocksdb(spark)
    out = spans.near_join(left.withWatermark("a_ts", "1 day"), right.withWatermark("b_ts", "1 day").drop("n"), ("a", "b"), ("a_ts", "b_ts"), "20 seconds", groups=1)
    got = pipeline.collected(out, f"{tmp_path}/out")
    assert sorted((r["n"], r["other"]) for r in got.collect()) == [(x, y) for x in range(120) for y in range(120) if (x - y) % 10 == 0 and abs(x - y) <= 20]
    packs = [spark.read.format("statestore").option("stateVarName", side).load(f"{tmp_path}/out/checkpoint").count() for side in ("left", "right")]
    assert max(packs) <= spans._PACKS < 11


def test_state_goes_once_the_watermark_has_passed(spark, tmp_path):
    """Rows at most 30 days apart, 50 days a batch: what may still meet others is kept."""
    rows = spark.range(300).selectExpr("id AS n", "id % 10 AS a", f"{AT.format('id * 86400')} AS a_ts")
    for name, df in {"a": rows, "b": rows.selectExpr("a AS b", "a_ts AS b_ts", "n AS other")}.items():
        for part in range(6):
            df.filter(F.col(f"{name}_ts").between(F.expr(AT.format(part * 4_320_000)), F.expr(AT.format(part * 4_320_000 + 4_319_999)))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    a, b = (spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}") for n, s in (("a", "n long, a long, a_ts timestamp"), ("b", "b long, b_ts timestamp, other long")))
    stateful.with_rocksdb(spark)
    out = spans.near_join(a.withWatermark("a_ts", "1 second"), b.withWatermark("b_ts", "1 second"), ("a", "b"), ("a_ts", "b_ts"), "30 days", groups=1)
    got = pipeline.collected(out, f"{tmp_path}/out")
    assert sorted((r["n"], r["other"]) for r in got.collect()) == [(x, y) for x in range(300) for y in range(300) if (x - y) % 10 == 0 and abs(x - y) <= 30]
    packs = spark.read.format("statestore").option("stateVarName", "left").load(f"{tmp_path}/out/checkpoint")
    first = packs.selectExpr("min(user_map_key.until)").head()[0]
    assert 1 <= packs.count() < 6 and first >= (1_600_000_000 + 200 * 86_400) * 1000


def test_windows_keep_packs_and_come_out_once(spark, tmp_path, held):
    """Against a batch: windows by tier and category, nulls and all, up to what the watermark has passed; state holds packs, not rows, and
    a late row opens no window again."""
    tables = {
        "orders": spark.range(3000).selectExpr("id AS n", "id AS order_id", "id % 40 AS order_customer_id", f"{AT.format('id')} AS order_ts"),
        "customers": spark.range(3000).selectExpr("id AS n", "id AS customer_id", "if(id % 4 = 0, null, concat('t', id % 3)) AS tier", f"{AT.format('id')} AS customer_ts"),
        "items": spark.range(3000).selectExpr("id AS n", "id AS item_order_id", "id % 7 AS item_product_id", "if(id % 5 = 0, null, id / 3) AS amount", f"{AT.format('id')} AS item_ts"),
        "products": spark.range(3000).selectExpr("id AS n", "id AS product_id", "if(id = 3, null, concat('c', id % 2)) AS category", f"{AT.format('id')} AS product_ts"),
    }
    for name, df in tables.items():
        late = df.filter("n = 6") if name == "items" else df.limit(0)  # of a window that has come out by then
        for part in (df.filter("n < 1000"), df.filter("n BETWEEN 1000 AND 1999"), df.filter("n >= 2000").unionByName(late)):
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    o, c, i, p = [spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}").drop("n") for name, df in tables.items()]
    got = pipeline.collected(stateful.tier_windows(o, c, i, p, "1 second", "100 seconds", "10 seconds", groups=4), f"{tmp_path}/out").drop("_batch")
    o, c, i, p = [df.drop("n") for df in tables.values()]
    near = lambda a, b: F.expr(f"{a} BETWEEN {b} - INTERVAL 100 SECONDS AND {b} + INTERVAL 100 SECONDS")
    joined = i.join(o, F.expr("item_order_id = order_id") & near("item_ts", "order_ts")).join(c, F.expr("order_customer_id = customer_id") & near("customer_ts", "order_ts")).join(p, F.expr("item_product_id = product_id") & near("product_ts", "item_ts"))
    amount = F.col("amount").cast("decimal(18,4)")
    want = joined.groupBy(F.window("item_ts", "10 seconds").alias("w"), "tier", "category").agg(F.count("*").alias("items"), F.sum(amount).cast("double").alias("total"))
    want = want.filter(F.col("w.end") <= F.expr(AT.format("2999 - 1 - 200"))).selectExpr("w.start AS window_start", "w.end AS window_end", "tier", "category", "items", "total")
    columns = want.columns
    assert plain(got, columns) == plain(want, columns) and got.count() > 40
    assert 0 < max(held()) < 500


def test_memory_beside_the_heap_is_bounded(spark):
    """Arrow batches end by bytes, and RocksDB stores share a bound; before, a batch took 64 MB and stores of joins by Spark none."""
    conf = "spark.sql.streaming.stateStore.rocksdb"
    for key in (f"{conf}.boundedMemoryUsage", f"{conf}.maxMemoryUsageMB", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.unset(key)
    stateful.with_rocksdb(spark)
    assert spark.conf.get(f"{conf}.boundedMemoryUsage") == "true" and spark.conf.get(f"{conf}.maxMemoryUsageMB") == "256"
    sizes = spark.range(0, 60, 1, 1).selectExpr("repeat('x', 1000000) AS t").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert max(r["n"] for r in sizes) < 10 << 20
    spark.conf.set(f"{conf}.maxMemoryUsageMB", "300")
    assert stateful.with_rocksdb(spark).conf.get(f"{conf}.maxMemoryUsageMB") == "300"  # what a session has set stays
    spark.conf.unset(f"{conf}.maxMemoryUsageMB")
