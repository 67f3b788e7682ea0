"""What decides the time on large tables: how rows are dealt, and what shuffles carry."""

import shutil

from pyspark.sql import functions as F

from sluice.plans import feeds, queries
from sluice.sources import envelope
from tests.conftest import ITEM, ORDER, SF, message


def test_a_table_of_one_row_group_is_encoded_by_all_cores(spark, tmp_path):
    shutil.copy(f"{SF}/orders.parquet", tmp_path)
    size = (tmp_path / "orders.parquet").stat().st_size
    spark.conf.set("spark.sql.files.maxPartitionBytes", size // 5)
    try:
        assert feeds.table(spark, str(tmp_path), "orders").rdd.getNumPartitions() >= 4
        files = feeds.feed(spark, str(tmp_path), "ORDERS").groupBy(F.input_file_name()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(files) >= 4 and max(r["count"] for r in files) < 2 * min(r["count"] for r in files)


def test_events_of_a_user_lie_together(spark):
    at = queries._user_columns(spark, SF).select(F.spark_partition_id().alias("p"), F.get(F.json_object_keys("_cdc_image"), F.lit(1)).alias("name")).collect()
    runs = sum(a["p"] != b["p"] or a["name"] != b["name"] for a, b in zip(at, at[1:])) + 1
    assert runs == len({r["name"] for r in at})


def test_images_are_not_carried_to_the_latest_rows(spark):
    for name in ("cdc_dedup_items", "agg_window_tier_category", "enrich_orders", "items_per_order"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "max_by" in x and "_cdc_image" in x]


def test_numbers_as_numbers_and_as_texts(feed):
    odd = ITEM | {"ITEM_ID": "301", "QUANTITY": 4.0, "UNIT_PRICE": "1.5", "SUBTOTAL": True}
    rows = envelope.rows(envelope.decode(feed(message("ORDER_ITEMS", ITEM), message("ORDER_ITEMS", odd))), "ORDER_ITEMS")
    got = [tuple(r[:6]) for r in rows.collect()]
    assert got == [(300, 77, 81, 4, 12.25, 49.0), (301, 77, 81, None, 1.5, None)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "StructField(UNIT_PRICE,DoubleType,true)" in plan


def test_images_that_are_texts(feed):
    """An image that is a text is one if the text is an object with fields."""
    texts = ['{"ORDER_ID":5}', "{}", '{"ORDER_ID', "x"]
    d = envelope.decode(feed(*[message("ORDERS", t) for t in texts], message("ORDERS", ORDER)))
    assert [r["error_message"] for r in d.collect()] == [None, "empty row image", "empty row image", "empty row image", None]
