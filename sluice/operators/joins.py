"""Enrichment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.mapping import full_name


def items_per_order(items: DataFrame) -> DataFrame:
    """(ORDER_ID, item_count, items_total): aggregated before any join, so the join moves one row for each order."""
    return items.groupBy("ORDER_ID").agg(F.count("*").alias("item_count"), F.sum(F.col("SUBTOTAL").cast("decimal(15,2)")).cast("double").alias("items_total"))


def current(rows: DataFrame) -> DataFrame:
    """The rows that are not deleted."""
    return rows.filter("_cdc_op <> 'd'")


def enrich_orders(orders: DataFrame, customers: DataFrame, items: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Each order with its customer's name, tier and region, and its number of items (0 if none).

    orders, customers and items hold one row of each key. The sides are left to the optimizer, which broadcasts those that
    are measured to be small. window_start and window_end are the window of the event's time.
    """
    who = customers.select("CUSTOMER_ID", full_name().alias("customer_name"), F.col("TIER").alias("customer_tier"), F.col("CITY").alias("customer_region"))
    out = orders.join(who, "CUSTOMER_ID", "left").join(items_per_order(items), "ORDER_ID", "left")
    at = F.window(F.timestamp_millis("_cdc_ts_ms"), window)
    return out.select(
        F.col("ORDER_ID").alias("order_id"), F.col("CUSTOMER_ID").alias("customer_id"), "customer_name", "customer_tier", "customer_region", F.col("TOTAL_AMOUNT").cast("decimal(15,2)").alias("total_amount"), F.coalesce("item_count", F.lit(0)).alias("item_count"),
        F.col("ORDER_DATE").alias("order_date"), F.col("STATUS").alias("status"), at["start"].alias("window_start"), at["end"].alias("window_end"),
    )


def items_with_products(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items with their product's name and category; null if it is unknown."""
    return items.join(products.select("PRODUCT_ID", F.col("NAME").alias("product_name"), F.col("CATEGORY").alias("product_category")), "PRODUCT_ID", "left")


def items_of_orders(items: DataFrame, orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Items with source_ts, the tier of their order's customer (UNKNOWN if there is none) and their product's category.

    All four hold one row of each key. Orders meet their customers first: they are fewer than items.
    """
    tiers = orders.select("ORDER_ID", "CUSTOMER_ID").join(customers.select("CUSTOMER_ID", F.col("TIER").alias("customer_tier")), "CUSTOMER_ID", "left")
    out = items_with_products(items, products).join(tiers.select("ORDER_ID", "customer_tier"), "ORDER_ID", "left")
    return out.withColumns({"customer_tier": F.coalesce("customer_tier", F.lit("UNKNOWN")), "source_ts": F.timestamp_millis("_cdc_ts_ms")})


def dynamic_join(left: DataFrame, right: DataFrame, on: str, suffix: str = "_right") -> DataFrame:
    """Left join on a key that both must have; every other column is carried, those of the right side with a suffix if both have them."""
    for side, df in (("left", left), ("right", right)):
        if on not in df.columns:
            raise ValueError(f"the {side} side has no column {on}")
    renamed = right.select(*[F.col(c).alias(c if c == on or c not in left.columns else c + suffix) for c in right.columns])
    return left.join(renamed, on, "left")


def insert_missing(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of batch whose key target has not: one of each key."""
    return batch.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def conflicting(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of batch whose key target has, as CONSTRAINT_VIOLATION."""
    hit = batch.join(target.select(*keys), keys, "left_semi")
    return hit.withColumns({"error_type": F.lit("CONSTRAINT_VIOLATION"), "error_message": F.lit("key exists: " + ", ".join(keys))})
