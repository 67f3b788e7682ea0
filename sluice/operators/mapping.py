"""Source columns to target tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.schemas import MAPPING, TARGETS, Mapped, mapping


def full_name(first: str = "FIRST_NAME", last: str = "LAST_NAME") -> Column:
    """First and last name with a blank between; null if both are blank or null."""
    return F.nullif(F.trim(F.concat_ws(" ", first, last)), F.lit(""))


def is_active(status: str = "STATUS") -> Column:
    """Whether a product is active; one without a status is."""
    return F.coalesce(F.col(status), F.lit("ACTIVE")) == "ACTIVE"


_DERIVED = {("CUSTOMERS", "name"): full_name, ("PRODUCTS", "is_active"): is_active}


def to_target(rows: DataFrame, table: str, columns: list[Mapped] | None = None, sequence: bool = False) -> DataFrame:
    """The target rows of a table's events, with source_ts and operation. A column that rows lack is null.

    sequence: with source_scn too, which tells events of one millisecond apart.
    """
    chosen = [m for m in columns or mapping(table) if not m.target.startswith("_")]
    out = []
    for m in chosen:
        derived = _DERIVED.get((table, m.target))
        value = derived() if derived else F.col(m.source) if m.source in rows.columns else F.lit(None)
        out.append((value.cast(m.type) if derived or m.source not in rows.columns else value.try_cast(m.type)).alias(m.target))
    return rows.select(*out, F.timestamp_millis("_cdc_ts_ms").alias("source_ts"), F.col("_cdc_op").alias("operation"), *([F.col("_cdc_scn").alias("source_scn")] if sequence else []))


def registry_seed(spark) -> DataFrame:
    """The registry's first rows: (table_name, column_name, column_type, target_table, target_column, target_type, is_active)."""
    rows = [(t, s, k, TARGETS[t], c, d, True) for t, s, k, c, d in MAPPING]
    return spark.createDataFrame(rows, "table_name string, column_name string, column_type string, target_table string, target_column string, target_type string, is_active boolean")


def active_mapping(registry: DataFrame) -> DataFrame:
    """The active rows with a target, in order."""
    return registry.filter("is_active AND target_table IS NOT NULL AND target_column IS NOT NULL").orderBy("table_name", "column_name")


def load_mapping(registry: DataFrame) -> dict[str, list[Mapped]]:
    """The projections that the registry describes. It holds a row for each column of a table, so it is small."""
    out: dict[str, list[Mapped]] = {t: mapping(t) for t in TARGETS}
    found: dict[str, list[Mapped]] = {}
    for r in active_mapping(registry).collect():
        found.setdefault(r["table_name"], []).append(Mapped(r["column_name"], r["target_column"], r["target_type"]))
    return out | found


def customers_back(target: DataFrame) -> DataFrame:
    """Target customers as source rows: the name is split at the first blank, region is CITY."""
    part = lambda i: F.coalesce(F.get(F.split("name", " ", 2), F.lit(i)), F.lit(""))
    return target.select(F.col("customer_id").alias("CUSTOMER_ID"), part(0).alias("FIRST_NAME"), part(1).alias("LAST_NAME"), F.col("email").alias("EMAIL"), F.col("tier").alias("TIER"), F.col("region").alias("CITY"))


def products_back(target: DataFrame) -> DataFrame:
    status = F.when(F.col("is_active"), "ACTIVE").otherwise("INACTIVE")
    return target.select(F.col("product_id").alias("PRODUCT_ID"), F.col("name").alias("NAME"), F.col("category").alias("CATEGORY"), F.col("price").cast("double").alias("PRICE"), F.col("stock_qty").alias("STOCK_QUANTITY"), status.alias("STATUS"))


def public_columns(df: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """df without columns that start with _ and those named in also."""
    return df.drop(*[c for c in df.columns if c.startswith("_") or c in also])


def recent_items(items: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """Target items of the last hours before as_of, or without a time, in order: what a first run starts from."""
    return items.filter((F.col("source_ts") >= as_of - F.expr(f"INTERVAL {hours} HOUR")) | F.col("source_ts").isNull()).orderBy("order_id", "item_id")
