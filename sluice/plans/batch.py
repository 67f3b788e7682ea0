"""The batch pipeline: decode, latest rows, enrichment, aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sluice.operators.aggregates import by_tier
from sluice.operators.dedup import latest_by_key
from sluice.operators.joins import current, enrich_orders
from sluice.sources.envelope import decode, rows


def enriched(orders_feed: DataFrame, customers_feed: DataFrame, items_feed: DataFrame) -> DataFrame:
    """Current orders with their current customer and items, from three feeds of messages."""
    # the images, which are most of a row, are not carried through the shuffle
    latest = lambda feed, table, key: current(latest_by_key(rows(decode(feed), table).drop("_cdc_image", "_cdc_table"), [key]))
    return enrich_orders(latest(orders_feed, "ORDERS", "ORDER_ID"), latest(customers_feed, "CUSTOMERS", "CUSTOMER_ID"), latest(items_feed, "ORDER_ITEMS", "ITEM_ID"))


def tiers(orders_feed: DataFrame, customers_feed: DataFrame, items_feed: DataFrame) -> DataFrame:
    return by_tier(enriched(orders_feed, customers_feed, items_feed))
