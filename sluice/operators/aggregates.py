"""Aggregates over enriched orders and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"


def by_tier(enriched: DataFrame, null_as_zero: bool = False) -> DataFrame:
    """Orders by customer tier: how many, revenue and average amount to two places, first and last time.

    A null tier is UNKNOWN. null_as_zero counts null amounts as 0 in the average.
    """
    amount = F.col("total_amount").cast(MONEY)
    amount = F.coalesce(amount, F.lit(0).cast(MONEY)) if null_as_zero else amount
    out = enriched.groupBy(F.coalesce("customer_tier", F.lit("UNKNOWN")).alias("customer_tier")).agg(
        F.count("*").alias("order_count"), F.sum(amount).alias("_sum"), F.count(amount).alias("_n"), F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end")
    )
    mean = F.round(F.col("_sum").cast("decimal(28,10)") / F.col("_n"), 2).cast("double")
    return out.select("window_start", "window_end", "customer_tier", F.lit(None).cast("string").alias("product_category"), "order_count", F.coalesce(F.col("_sum"), F.lit(0)).cast("double").alias("total_revenue"), mean.alias("avg_order_value"))


def windowed(rows: DataFrame, ts: str, keys: list[str], value: str, length: str = "5 minutes", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count, sum and average of value by event-time window and keys; late is the watermark for streams, slide makes windows overlap."""
    rows = rows.withWatermark(ts, late) if late else rows
    at = F.window(ts, length, slide) if slide else F.window(ts, length)
    amount = F.col(value).cast("decimal(18,4)")
    out = rows.groupBy(at.alias("_w"), *keys).agg(F.count("*").alias("order_count"), F.sum(amount).alias("_sum"), F.count(amount).alias("_n"))
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "order_count", F.col("_sum").cast("double").alias("total_revenue"), F.round(F.col("_sum").cast("decimal(28,10)") / F.col("_n"), 4).cast("double").alias("avg_order_value"))


def by_customer(rows: DataFrame, optional: list[str]) -> DataFrame:
    """Orders and revenue by customer, and the latest value of each optional column that rows have."""
    latest = [F.max_by(c, F.struct("_cdc_ts_ms", "_cdc_scn")).alias(f"latest_{c.lower()}") for c in optional if c in rows.columns]
    return rows.groupBy("CUSTOMER_ID").agg(F.count("*").alias("order_count"), F.sum(F.col("TOTAL_AMOUNT").cast(MONEY)).cast("double").alias("total_revenue"), *latest)


def counts_by(rows: DataFrame, column: str, name: str = "events") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias(name))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of each table."""
    out: DataFrame | None = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    return out


def dlq_summary(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("error_type", "status").agg(F.count("*").alias("error_count"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def metrics(rows: DataFrame, ts: str, consumer: str, length: str = "1 minute") -> DataFrame:
    """Events by window, in the columns of the metrics table."""
    out = rows.groupBy(F.window(ts, length).alias("_w")).agg(F.count("*").cast("decimal(15,4)").alias("metric_value"))
    return out.select(F.lit(consumer).alias("consumer_id"), F.lit("events").alias("metric_name"), "metric_value", F.lit("events").alias("metric_unit"), F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"))


def state_sizes(items: DataFrame, key: str) -> DataFrame:
    """(keys, total_items) of grouped state."""
    return items.groupBy(key).agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_items"))


def progress(decoded: DataFrame, consumer: str) -> DataFrame:
    """(consumer_id, topic, last_offset, last_timestamp): how far a batch reaches in each topic."""
    return decoded.groupBy("topic").agg(F.max(F.col("scn").try_cast("long")).alias("last_offset"), F.timestamp_millis(F.max("ts_ms")).alias("last_timestamp")).withColumn("consumer_id", F.lit(consumer))


def furthest(reached: DataFrame) -> DataFrame:
    """Progress rows to one of each consumer and topic: as far as any of them reaches."""
    return reached.groupBy("consumer_id", "topic").agg(F.max("last_offset").alias("last_offset"), F.max("last_timestamp").alias("last_timestamp"))


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 2))
