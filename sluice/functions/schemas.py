"""Source and target schemas, keys and mappings of the five retail tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

# The change feed's tables, keys, columns and where they go.
TABLES = {
    "ORDERS": "ORDER_ID INT, CUSTOMER_ID INT, ORDER_DATE TIMESTAMP, TOTAL_AMOUNT DOUBLE, STATUS STRING, SHIPPING_INFO STRING, CREATED_AT TIMESTAMP, UPDATED_AT TIMESTAMP",
    "ORDER_ITEMS": "ITEM_ID INT, ORDER_ID INT, PRODUCT_ID INT, QUANTITY INT, UNIT_PRICE DOUBLE, SUBTOTAL DOUBLE, CREATED_AT TIMESTAMP, UPDATED_AT TIMESTAMP",
    "CUSTOMERS": "CUSTOMER_ID INT, FIRST_NAME STRING, LAST_NAME STRING, EMAIL STRING, PHONE STRING, ADDRESS STRING, CITY STRING, COUNTRY STRING, TIER STRING, CREATED_AT TIMESTAMP, UPDATED_AT TIMESTAMP",
    "PRODUCTS": "PRODUCT_ID INT, NAME STRING, DESCRIPTION STRING, CATEGORY STRING, PRICE DOUBLE, STOCK_QUANTITY INT, STATUS STRING, CREATED_AT TIMESTAMP, UPDATED_AT TIMESTAMP",
    "AUDIT_LOG": "LOG_ID INT, ACTION STRING, ENTITY_TYPE STRING, ENTITY_ID INT, USER_ID INT, DETAILS STRING, IP_ADDRESS STRING, CREATED_AT TIMESTAMP",
}
KEYS = {"ORDERS": "ORDER_ID", "ORDER_ITEMS": "ITEM_ID", "CUSTOMERS": "CUSTOMER_ID", "PRODUCTS": "PRODUCT_ID", "AUDIT_LOG": "LOG_ID"}
TARGETS = {"ORDERS": "cdc_orders", "ORDER_ITEMS": "cdc_order_items", "CUSTOMERS": "cdc_customers", "PRODUCTS": "cdc_products", "AUDIT_LOG": "cdc_audit_log"}
#: (source table, source column, source type, target column, target type); a target that starts with _ only feeds another column.
MAPPING = (
    ("ORDERS", "ORDER_ID", "NUMBER(10)", "order_id", "INT"),
    ("ORDERS", "CUSTOMER_ID", "NUMBER(10)", "customer_id", "INT"),
    ("ORDERS", "ORDER_DATE", "TIMESTAMP", "order_date", "TIMESTAMP"),
    ("ORDERS", "TOTAL_AMOUNT", "NUMBER(15,2)", "total_amount", "DECIMAL(15,2)"),
    ("ORDERS", "STATUS", "VARCHAR2(20)", "status", "STRING"),
    ("ORDERS", "SHIPPING_INFO", "CLOB", "shipping_info", "STRING"),
    ("ORDER_ITEMS", "ITEM_ID", "NUMBER(10)", "item_id", "INT"),
    ("ORDER_ITEMS", "ORDER_ID", "NUMBER(10)", "order_id", "INT"),
    ("ORDER_ITEMS", "PRODUCT_ID", "NUMBER(10)", "product_id", "INT"),
    ("ORDER_ITEMS", "QUANTITY", "NUMBER(5)", "quantity", "INT"),
    ("ORDER_ITEMS", "UNIT_PRICE", "NUMBER(10,2)", "unit_price", "DECIMAL(10,2)"),
    ("ORDER_ITEMS", "SUBTOTAL", "NUMBER(15,2)", "subtotal", "DECIMAL(15,2)"),
    ("CUSTOMERS", "CUSTOMER_ID", "NUMBER(10)", "customer_id", "INT"),
    ("CUSTOMERS", "FIRST_NAME", "VARCHAR2(100)", "name", "STRING"),
    ("CUSTOMERS", "LAST_NAME", "VARCHAR2(100)", "_last_name", "STRING"),
    ("CUSTOMERS", "EMAIL", "VARCHAR2(100)", "email", "STRING"),
    ("CUSTOMERS", "TIER", "VARCHAR2(20)", "tier", "STRING"),
    ("CUSTOMERS", "CITY", "VARCHAR2(50)", "region", "STRING"),
    ("CUSTOMERS", "CREATED_AT", "TIMESTAMP", "created_at", "TIMESTAMP"),
    ("PRODUCTS", "PRODUCT_ID", "NUMBER(10)", "product_id", "INT"),
    ("PRODUCTS", "NAME", "VARCHAR2(200)", "name", "STRING"),
    ("PRODUCTS", "CATEGORY", "VARCHAR2(50)", "category", "STRING"),
    ("PRODUCTS", "PRICE", "NUMBER(10,2)", "price", "DECIMAL(10,2)"),
    ("PRODUCTS", "STOCK_QUANTITY", "NUMBER(10)", "stock_qty", "INT"),
    ("PRODUCTS", "STATUS", "VARCHAR2(20)", "is_active", "BOOLEAN"),
    ("AUDIT_LOG", "LOG_ID", "NUMBER(10)", "log_id", "INT"),
    ("AUDIT_LOG", "ACTION", "VARCHAR2(50)", "event_type", "STRING"),
    ("AUDIT_LOG", "ENTITY_TYPE", "VARCHAR2(100)", "table_name", "STRING"),
    ("AUDIT_LOG", "ENTITY_ID", "NUMBER(10)", "record_id", "STRING"),
    ("AUDIT_LOG", "USER_ID", "NUMBER(10)", "changed_by", "STRING"),
    ("AUDIT_LOG", "CREATED_AT", "TIMESTAMP", "changed_at", "TIMESTAMP"),
)
#: How each target table is written.
MODES = {
    "cdc_orders": "append", "cdc_order_items": "append", "cdc_audit_log": "append", "cdc_customers": "upsert", "cdc_products": "upsert", "cdc_orders_enriched": "upsert",
    "cdc_order_aggregations": "append", "cdc_order_items_extracted": "append", "cdc_orders_dynamic": "append", "cdc_dlq": "append", "cdc_schema_registry": "insert_missing", "cdc_checkpoints": "upsert", "cdc_metrics": "append",
}
#: The names of inferred types in the registry, and of the registry's types in target tables.
SOURCE_TYPES = {"int": "NUMBER(10)", "long": "NUMBER(19)", "double": "NUMBER(15,4)", "string": "VARCHAR2(255)", "boolean": "NUMBER(1)", "timestamp": "TIMESTAMP"}
# End of the fixed values.

#: Of the source only what is used is read: the parser skips the rest.
_SOURCE = "scn STRING"
_BODY = f"before STRING, after STRING, source STRUCT<{_SOURCE}>, op STRING, ts_ms BIGINT"
#: A message with its payload inside or bare; _corrupt has the text of one that does not fit.
EVENT = f"payload STRUCT<{_BODY}>, {_BODY}, _corrupt STRING"


class Mapped(NamedTuple):
    source: str
    target: str
    type: str


def schema(table: str) -> T.StructType:
    """The baseline columns of a source table."""
    return T.StructType.fromDDL(TABLES[table])


def known(table: str) -> list[str]:
    return schema(table).names


def mapping(table: str) -> list[Mapped]:
    return [Mapped(s, t, k) for name, s, _, t, k in MAPPING if name == table]
