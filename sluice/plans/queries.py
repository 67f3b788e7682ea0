"""The registered queries, each with its SQL where SQL can express it. All read the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.folders import shared_folder, written
from sluice.operators import aggregates, alerts, dedup, evolution, joins, mapping, reports, xml
from sluice.plans import batch, feeds
from sluice.sources import envelope, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "TIMESTAMP '2024-01-15 00:00:00'"

# SQL fragments that repeat the feeds' arithmetic.
OP = "CASE WHEN {k} % 20 = 0 THEN 'd' WHEN {k} % 20 <= 5 THEN 'u' ELSE 'c' END"
O_OP, C_OP, P_OP, L_OP = (OP.format(k=k) for k in ("o_orderkey", "c_custkey", "p_partkey", "l_partkey"))
O_TS = "(epoch_ms(o_orderdate) + o_orderkey % 1000)"
L_TS = "(epoch_ms(l_shipdate) + l_partkey % 1000)"
ITEM = "(l_orderkey * 8 + l_linenumber)"
C_ROW = "c_custkey::INT AS customer_id, trim(concat_ws(' ', split_part(c_name, '#', 1), split_part(c_name, '#', 2))) AS name, 'c' || c_custkey || '@example.com' AS email, c_mktsegment AS tier, n_name AS region"
C_FROM = "customer LEFT JOIN nation ON c_nationkey = n_nationkey"
LATEST_ITEMS = f"(SELECT * FROM (SELECT *, {ITEM} AS item, row_number() OVER (PARTITION BY {ITEM} ORDER BY {L_TS} DESC, l_partkey * 1000000 + l_suppkey DESC) AS k FROM lineitem) WHERE k = 1)"
ENRICHED = f"""(SELECT o_orderkey::INT AS order_id, o_custkey::INT AS customer_id, CASE WHEN {C_OP} <> 'd' THEN trim(concat_ws(' ', split_part(c_name, '#', 1), split_part(c_name, '#', 2))) END AS customer_name,
    CASE WHEN {C_OP} <> 'd' THEN c_mktsegment END AS customer_tier, CASE WHEN {C_OP} <> 'd' THEN n_name END AS customer_region, o_totalprice::DECIMAL(15,2) AS total_amount, coalesce(n, 0)::BIGINT AS item_count, o_orderdate::TIMESTAMP AS order_date, o_orderstatus AS status,
    time_bucket(INTERVAL 5 MINUTE, make_timestamp({O_TS} * 1000)) AS window_start, time_bucket(INTERVAL 5 MINUTE, make_timestamp({O_TS} * 1000)) + INTERVAL 5 MINUTE AS window_end
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {LATEST_ITEMS} WHERE {L_OP} <> 'd' GROUP BY l_orderkey) ON o_orderkey = l_orderkey WHERE {O_OP} <> 'd')"""


def plain(df: DataFrame) -> DataFrame:
    """df with decimals as doubles, which is how results are compared."""
    return df.withColumns({c: F.col(c).cast("double") for c, t in df.dtypes if t.startswith("decimal")})


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf: plain(f(spark, sf))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _decoded(spark: SparkSession, sf: str, name: str, **how) -> DataFrame:
    return envelope.decode(feeds.feed(spark, sf, name, **how))


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    return batch.enriched(*(feeds.feed(spark, sf, t) for t in ("ORDERS", "CUSTOMERS", "ORDER_ITEMS")))


# Decoding


@query(f"SELECT o_orderkey::INT AS order_id, o_custkey::INT AS customer_id, o_orderdate::TIMESTAMP AS order_date, o_totalprice AS total_amount, o_orderstatus AS status, {O_OP} AS op, {O_TS}::BIGINT AS ts_ms, 'ORDERS' AS table_name, o_orderkey AS scn FROM orders")
def cdc_decode_orders(spark: SparkSession, sf: str) -> DataFrame:
    e = feeds.events(spark, sf, "ORDERS")
    return e.select(*[F.col(c).alias(c.lower()) for c in ("ORDER_ID", "CUSTOMER_ID", "ORDER_DATE", "TOTAL_AMOUNT", "STATUS")], F.col("_cdc_op").alias("op"), F.col("_cdc_ts_ms").alias("ts_ms"), F.col("_cdc_table").alias("table_name"), F.col("_cdc_scn").alias("scn"))


@query(f"""SELECT schema_name, table_name, operation, count(*) AS events FROM (
    SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'UNKNOWN' ELSE 'SALES' END AS schema_name, CASE WHEN o_orderkey % 9 IN (0, 1) THEN 'UNKNOWN' ELSE 'ORDERS' END AS table_name,
        CASE WHEN o_orderkey % 9 <= 2 THEN 'unknown' ELSE CASE {O_OP} WHEN 'd' THEN 'delete' WHEN 'u' THEN 'update' ELSE 'insert' END END AS operation FROM orders) GROUP BY ALL""")
def cdc_topic_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Topics of two, three, four and five parts."""
    f = feeds.feed(spark, sf, "ORDERS")
    k = F.get_json_object("value", "$.payload.source.scn").cast("long") % 9
    parts = F.split("topic", "/")
    f = f.withColumn("topic", F.when(k <= 2, F.array_join(F.slice(parts, F.lit(1), (k + 2).cast("int")), "/")).otherwise(F.col("topic")))
    return envelope.topic_parts(f).groupBy("schema_name", "table_name", "operation").agg(F.count("*").alias("events"))


@query(f"SELECT 'cdc/oracle/SALES/ORDERS/' || CASE {O_OP} WHEN 'd' THEN 'delete' WHEN 'u' THEN 'update' ELSE 'insert' END AS topic, count(*) AS events FROM orders GROUP BY ALL UNION ALL SELECT 'cdc/oracle/SALES/CUSTOMERS/delete', count(*) FROM customer WHERE {C_OP} = 'd'")
def cdc_topic_subscribe(spark: SparkSession, sf: str) -> DataFrame:
    both = feeds.feed(spark, sf, "ORDERS").union(feeds.feed(spark, sf, "CUSTOMERS"))
    return aggregates.counts_by(envelope.subscribe(both, ["cdc/oracle/*/ORDERS/*", "cdc/*/SALES/CUSTOMERS/delete"]), "topic")


@query(f"SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'MALFORMED_JSON' END AS error_type, CASE WHEN o_orderkey % 17 = 0 THEN 'unknown operation x' END AS error_message, count(*) AS events FROM orders GROUP BY ALL")
def cdc_filter_unknown_op(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    d = _decoded(spark, sf, "ORDERS", op=F.when(k % 17 == 0, "x").otherwise(feeds.op_of(k)))
    return d.groupBy("error_type", "error_message").agg(F.count("*").alias("events"))


@query("SELECT o_orderkey::INT AS order_id, CASE WHEN o_orderkey % 4 = 0 THEN 'empty row image' WHEN o_orderkey % 4 = 1 THEN 'not valid JSON' END AS error_message FROM orders WHERE o_orderkey % 4 <> 2")
def cdc_broken_events(spark: SparkSession, sf: str) -> DataFrame:
    """Empty images, bad JSON and events without a body."""
    o = feeds.dealt(feeds.table(spark, sf, "orders")).select("o_orderkey", (F.col("o_orderkey") % 4).alias("k"))
    value = F.when(F.col("k") == 0, '{"payload":{"op":"c","after":{},"ts_ms":1}}').when(F.col("k") == 1, '{"payload":').when(F.col("k") == 2, " ").otherwise('{"payload":{"op":"c","after":{"ORDER_ID":1},"ts_ms":1}}')
    d = envelope.decode(o.select("o_orderkey", F.lit("cdc/oracle/SALES/ORDERS/insert").alias("topic"), value.alias("value")))
    return d.select(F.col("o_orderkey").cast("int").alias("order_id"), "error_message")


@query(f"SELECT c_custkey::INT AS customer_id, c_mktsegment AS tier, {C_OP} AS op, (1700000000000 + c_custkey)::BIGINT AS ts_ms FROM customer")
def cdc_flat_payload(spark: SparkSession, sf: str) -> DataFrame:
    e = envelope.rows(envelope.decode(envelope.encode(feeds.customers(spark, sf), "CUSTOMERS", wrapped=False)), "CUSTOMERS")
    return e.select(F.col("CUSTOMER_ID").alias("customer_id"), F.col("TIER").alias("tier"), F.col("_cdc_op").alias("op"), F.col("_cdc_ts_ms").alias("ts_ms"))


@query("SELECT o_orderkey::INT AS order_id, 'c' AS op, epoch_ms(o_orderdate)::BIGINT AS ts_ms FROM orders")
def cdc_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Events without op and ts_ms: an insert at the time of receipt."""
    o = feeds.table(spark, sf, "orders")
    value = F.to_json(F.struct(F.struct(F.struct(F.col("o_orderkey").alias("ORDER_ID")).alias("after")).alias("payload")))
    d = envelope.decode(o.select(F.lit("cdc/oracle/SALES/ORDERS/insert").alias("topic"), value.alias("value"), F.col("o_orderdate").alias("received_at")))
    return envelope.rows(d, "ORDERS").select(F.col("ORDER_ID").alias("order_id"), F.col("_cdc_op").alias("op"), F.col("_cdc_ts_ms").alias("ts_ms"))


@query(f"SELECT o_orderkey::INT AS order_id, make_timestamp({O_TS} * 1000) AS source_ts, {O_OP} AS operation FROM orders")
def cdc_source_ts(spark: SparkSession, sf: str) -> DataFrame:
    return envelope.with_metadata(feeds.events(spark, sf, "ORDERS")).select(F.col("ORDER_ID").alias("order_id"), "source_ts", "operation")


@query(f"SELECT CASE {O_OP} WHEN 'd' THEN 'deletes' WHEN 'u' THEN 'updates' ELSE 'inserts' END AS branch, count(*) AS events FROM orders GROUP BY ALL")
def cdc_split_ops(spark: SparkSession, sf: str) -> DataFrame:
    parts = envelope.split_operations(feeds.events(spark, sf, "ORDERS"))
    one, two, three = (p.groupBy(F.lit(n).alias("branch")).agg(F.count("*").alias("events")) for p, n in zip(parts, ("inserts", "updates", "deletes")))
    return one.unionByName(two).unionByName(three)


@query("""SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'c' WHEN b.c_custkey IS NULL THEN 'd' ELSE 'u' END AS op
    FROM (SELECT c_custkey, c_mktsegment AS m FROM customer WHERE c_custkey % 15 <> 0) a FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS m FROM customer WHERE c_custkey % 16 <> 0) b USING (c_custkey)
    WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.m <> b.m""")
def cdc_snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    c = feeds.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    new = c.filter("c_custkey % 16 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "NEW").otherwise(F.col("c_mktsegment")))
    out = envelope.changes(c.filter("c_custkey % 15 <> 0"), new, "c_custkey")
    return out.select(F.coalesce("before.c_custkey", "after.c_custkey").alias("c_custkey"), "op")


@query("SELECT o_orderkey::INT AS order_id, CASE WHEN o_orderkey % 3 = 0 THEN 'TOTAL_AMOUNT does not fit double' ELSE 'CUSTOMER_ID is missing' END AS error_message FROM orders WHERE o_orderkey % 3 <> 2")
def cdc_schema_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    o = feeds.dealt(feeds.table(spark, sf, "orders"))
    row = F.struct(F.col("o_orderkey").alias("ORDER_ID"), F.when(F.col("o_orderkey") % 3 != 1, F.col("o_custkey")).alias("CUSTOMER_ID"), F.when(F.col("o_orderkey") % 3 == 0, "much").otherwise("1.5").alias("TOTAL_AMOUNT"))
    d = envelope.decode(envelope.encode(feeds._images(o, "o_orderkey", row, F.lit(1), op=F.lit("c")), "ORDERS"))
    return envelope.mismatched(d, "ORDERS", ["ORDER_ID", "CUSTOMER_ID"]).select(F.get_json_object("image", "$.ORDER_ID").cast("int").alias("order_id"), "error_message")


# Deduplication


@query(f"SELECT item::INT AS item_id, l_partkey::INT AS product_id, l_quantity::INT AS quantity, l_extendedprice AS subtotal FROM {LATEST_ITEMS}")
def cdc_dedup_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.events(spark, sf, "ORDER_ITEMS").select("ITEM_ID", "PRODUCT_ID", "QUANTITY", "SUBTOTAL", *dedup.ORDER)
    out = dedup.latest_by_key(rows, ["ITEM_ID"])
    return out.select(F.col("ITEM_ID").alias("item_id"), F.col("PRODUCT_ID").alias("product_id"), F.col("QUANTITY").alias("quantity"), F.col("SUBTOTAL").alias("subtotal"))


@query("""SELECT event_id, coalesce(max((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY event_id * 2 + CASE WHEN event_id % 5 = 0 THEN 2001 ELSE 0 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= (epoch_us(ts) // 1000), false) AS is_stale FROM events""")
def cdc_stale_events(spark: SparkSession, sf: str) -> DataFrame:
    e = feeds.events(spark, sf, "AUDIT_LOG").withColumn("arrival", F.col("LOG_ID").cast("long") * 2 + F.when(F.col("LOG_ID") % 5 == 0, 2001).otherwise(0))
    return dedup.stale(e, ["USER_ID"], "arrival").select(F.col("LOG_ID").cast("long").alias("event_id"), "is_stale")


def _customer_history(spark: SparkSession, sf: str) -> DataFrame:
    old, new = (mapping.to_target(feeds.events(spark, sf, "CUSTOMERS", version=v), "CUSTOMERS") for v in (0, 2))
    return old.unionByName(new)


@query(f"SELECT {C_ROW.replace('c_mktsegment AS tier', chr(39) + chr(39) + ' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ' + chr(39) + '-2' + chr(39) + ' ELSE ' + chr(39) + chr(39) + ' END AS tier')} FROM {C_FROM}")
def cdc_latest_customers(spark: SparkSession, sf: str) -> DataFrame:
    return reports.latest(_customer_history(spark, sf), "customer_id").select("customer_id", "name", "email", "tier", "region")


@query("SELECT p_partkey::INT AS product_id, p_name AS name, p_type AS category, p_retailprice AS price, p_size AS stock_qty, p_partkey % 10 <> 0 AS is_active FROM part")
def cdc_latest_products(spark: SparkSession, sf: str) -> DataFrame:
    p = mapping.to_target(feeds.events(spark, sf, "PRODUCTS"), "PRODUCTS")
    stale = p.withColumns({"source_ts": F.lit(None).cast("timestamp"), "stock_qty": F.lit(0)})
    return reports.latest(p.unionByName(stale), "product_id").drop("source_ts", "operation")


@query(f"SELECT l_orderkey::INT AS order_id, item::INT AS item_id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {L_TS} DESC, l_partkey * 1000000 + l_suppkey DESC, item DESC) AS r FROM (SELECT *, {ITEM} AS item FROM lineitem)) WHERE r <= 3")
def cdc_last_n_items(spark: SparkSession, sf: str) -> DataFrame:
    out = dedup.last_n(feeds.events(spark, sf, "ORDER_ITEMS"), ["ORDER_ID"], 3, (*dedup.ORDER, "ITEM_ID"))
    return out.select(F.col("ORDER_ID").alias("order_id"), F.col("ITEM_ID").alias("item_id"))


@query(f"SELECT l_orderkey::INT AS order_id, count(*) AS items FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY {L_TS} DESC, l_partkey * 1000000 + l_suppkey DESC, {ITEM} DESC) AS r FROM lineitem) WHERE n <= 6 OR r <= 3 GROUP BY l_orderkey")
def cdc_capped_items(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of more than six items keep the last three."""
    out = dedup.last_n(feeds.events(spark, sf, "ORDER_ITEMS"), ["ORDER_ID"], 3, (*dedup.ORDER, "ITEM_ID"), cap=6)
    return aggregates.counts_by(out, "ORDER_ID", "items").withColumnRenamed("ORDER_ID", "order_id")


# Mapping


@query(f"SELECT o_orderkey::INT AS order_id, o_custkey::INT AS customer_id, o_orderdate::TIMESTAMP AS order_date, o_totalprice AS total_amount, o_orderstatus AS status, NULL::VARCHAR AS shipping_info, make_timestamp({O_TS} * 1000) AS source_ts, {O_OP} AS operation FROM orders")
def cdc_map_orders(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.to_target(feeds.events(spark, sf, "ORDERS"), "ORDERS")


@query(f"SELECT {ITEM}::INT AS item_id, l_orderkey::INT AS order_id, l_partkey::INT AS product_id, l_quantity::INT AS quantity, l_extendedprice AS unit_price, l_extendedprice AS subtotal, make_timestamp({L_TS} * 1000) AS source_ts, {L_OP} AS operation FROM lineitem")
def cdc_map_items(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.to_target(feeds.events(spark, sf, "ORDER_ITEMS"), "ORDER_ITEMS")


@query(f"SELECT {C_ROW}, NULL::TIMESTAMP AS created_at, make_timestamp((1700000000000 + c_custkey) * 1000) AS source_ts, {C_OP} AS operation FROM {C_FROM}")
def cdc_map_customers(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.to_target(feeds.events(spark, sf, "CUSTOMERS"), "CUSTOMERS")


@query(f"SELECT p_partkey::INT AS product_id, p_name AS name, p_type AS category, p_retailprice AS price, p_size AS stock_qty, p_partkey % 10 <> 0 AS is_active, make_timestamp((1700000000000 + p_partkey) * 1000) AS source_ts, {P_OP} AS operation FROM part")
def cdc_map_products(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.to_target(feeds.events(spark, sf, "PRODUCTS"), "PRODUCTS")


@query("SELECT event_id::INT AS log_id, event_type, 'EVENTS' AS table_name, event_id::VARCHAR AS record_id, user_id::VARCHAR AS changed_by, ts AS changed_at, date_trunc('milliseconds', ts) AS source_ts, 'c' AS operation FROM events")
def cdc_map_audit(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.to_target(feeds.events(spark, sf, "AUDIT_LOG"), "AUDIT_LOG")


@query(f"SELECT customer_id AS \"CUSTOMER_ID\", 'Customer' AS \"FIRST_NAME\", split_part(name, ' ', 2) AS \"LAST_NAME\", email AS \"EMAIL\", tier AS \"TIER\", region AS \"CITY\" FROM (SELECT {C_ROW} FROM {C_FROM})")
def cdc_reverse_customers(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.customers_back(cdc_map_customers(spark, sf))


@query("SELECT p_partkey::INT AS \"PRODUCT_ID\", p_name AS \"NAME\", p_type AS \"CATEGORY\", p_retailprice AS \"PRICE\", p_size AS \"STOCK_QUANTITY\", CASE WHEN p_partkey % 10 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS \"STATUS\" FROM part")
def cdc_reverse_products(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.products_back(cdc_map_products(spark, sf))


@query(f"SELECT item::INT AS item_id, l_orderkey::INT AS order_id, CASE WHEN l_partkey % 50 > 0 THEN make_timestamp({L_TS} * 1000) END AS source_ts FROM {LATEST_ITEMS} WHERE l_partkey % 50 = 0 OR make_timestamp({L_TS} * 1000) >= TIMESTAMP '2000-01-01' - INTERVAL 48 HOUR")
def cdc_bootstrap_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.events(spark, sf, "ORDER_ITEMS").drop("_cdc_image", "_cdc_table")
    items = mapping.to_target(dedup.latest_by_key(rows, ["ITEM_ID"]), "ORDER_ITEMS")
    items = items.withColumn("source_ts", F.when(F.col("product_id") % 50 > 0, F.col("source_ts")))
    return mapping.recent_items(items, F.expr("TIMESTAMP '2000-01-01 00:00:00'"), 48).select("item_id", "order_id", "source_ts")


# Writing


@query(f"SELECT {C_ROW.replace('c_mktsegment AS tier', 'CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' + chr(39) + '-2' + chr(39) + ' ELSE c_mktsegment END AS tier')} FROM {C_FROM}")
def cdc_upsert_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches, the newer first: an older row doesn't replace a newer one."""
    tables = sinks.Tables(spark, shared_folder(spark))
    for i, version in enumerate((2, 0)):
        tables.write("cdc_customers", mapping.to_target(feeds.events(spark, sf, "CUSTOMERS", version=version), "CUSTOMERS"), i)
    out = mapping.to_target(feeds.events(spark, sf, "CUSTOMERS"), "CUSTOMERS")
    return tables.read("cdc_customers", out.schema, ["customer_id"]).select("customer_id", "name", "email", "tier", "region")


@query("SELECT c_custkey::INT AS customer_id, c_mktsegment AS tier FROM customer WHERE c_custkey % 3 <> 0")
def cdc_insert_missing(spark: SparkSession, sf: str) -> DataFrame:
    have, batch_ = (mapping.to_target(feeds.events(spark, sf, "CUSTOMERS", version=v), "CUSTOMERS") for v in (2, 0))
    return joins.insert_missing(have, batch_, ["customer_id"]).select("customer_id", "tier")


@query("SELECT c_custkey::INT AS customer_id, 'CONSTRAINT_VIOLATION' AS error_type FROM customer WHERE c_custkey % 3 = 0")
def cdc_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    have, batch_ = (mapping.to_target(feeds.events(spark, sf, "CUSTOMERS", version=v), "CUSTOMERS") for v in (2, 0))
    return joins.conflicting(have, batch_, ["customer_id"]).select("customer_id", "error_type")


@query(f"SELECT o_orderkey::INT AS order_id, o_totalprice AS total_amount, {O_OP} AS operation FROM orders")
def cdc_append_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches; the second runs twice and replaces itself."""
    tables, rows = sinks.Tables(spark, shared_folder(spark)), mapping.to_target(feeds.events(spark, sf, "ORDERS"), "ORDERS")
    for i in (0, 1, 1):
        tables.write("cdc_orders", rows.filter(F.col("order_id") % 2 == i), i)
    return tables.read("cdc_orders", rows.schema).select("order_id", "total_amount", "operation")


def _dead(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    d = envelope.invalid(_decoded(spark, sf, "ORDERS", op=F.when(k % 17 == 0, F.concat(F.lit("x"), (k % 3).cast("string"))).otherwise(feeds.op_of(k))))
    return sinks.dead_letters(d, F.col("topic"), F.col("value"), "test", F.timestamp_millis("ts_ms"))


@query(f"SELECT o_orderkey::VARCHAR AS scn, 'MALFORMED_JSON' AS error_type, 'unknown operation x' || o_orderkey % 3 AS error_message, 0 AS retry_count, 'pending' AS status, make_timestamp({O_TS} * 1000) AS created_at FROM orders WHERE o_orderkey % 17 = 0")
def cdc_dlq_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _dead(spark, sf).select(F.get_json_object("payload", "$.payload.source.scn").alias("scn"), "error_type", "error_message", "retry_count", "status", "created_at")


@query(f"SELECT 'MALFORMED_JSON' AS error_type, 'pending' AS status, count(*) AS error_count, min(make_timestamp({O_TS} * 1000)) AS oldest, max(make_timestamp({O_TS} * 1000)) AS newest FROM orders WHERE o_orderkey % 17 = 0")
def cdc_dlq_summary(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.dlq_summary(_dead(spark, sf))


@query("SELECT 'MALFORMED_JSON' AS error_type, count(*) AS events FROM orders WHERE o_orderkey % 17 = 0")
def cdc_dlq_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.counts_by(_dead(spark, sf), "error_type")


@query("SELECT 'unknown operation x' || o_orderkey % 3 AS message, 'error' AS severity, count(*) AS events FROM orders WHERE o_orderkey % 17 = 0 GROUP BY ALL")
def cdc_dlq_notifications(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.dead_letter_notifications(_dead(spark, sf)).groupBy("message", "severity").agg(F.count("*").alias("events"))


@query("SELECT 'MALFORMED_JSON' AS error_type, o_orderkey::VARCHAR AS scn FROM orders WHERE o_orderkey % 17 = 0")
def cdc_dlq_messages(spark: SparkSession, sf: str) -> DataFrame:
    m = sinks.dead_letter_messages(_dead(spark, sf))
    return m.select(F.get_json_object("value", "$.dlq_metadata.error_type").alias("error_type"), F.get_json_object("value", "$.original_payload.payload.source.scn").alias("scn"))


# Schema evolution


#: Each user's events name a column of their own: as many unknown columns as there are users.
_BY_USER = "'U' || user_id AS column_name"


def _user_columns(spark: SparkSession, sf: str) -> DataFrame:
    # the JSON parser keeps up to 12,000 names and copies them for each new one: a user's events, which share a name, lie together
    e = feeds.dealt(feeds.table(spark, sf, "events"), "user_id")
    image = F.to_json(F.create_map(F.lit("LOG_ID"), F.col("event_id"), F.concat(F.lit("U"), "user_id"), F.col("event_id") * 1_000_000))
    return envelope.rows(envelope.decode(envelope.encode(feeds._images(e, "event_id", image, F.unix_millis("ts"), op=F.lit("c")), "AUDIT_LOG")), "AUDIT_LOG")


@query("SELECT DISTINCT 'U' || user_id AS column_name FROM events")
def cdc_new_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A column of each user's own."""
    return evolution.new_columns(_user_columns(spark, sf), "AUDIT_LOG")


@query("SELECT column_name, count(*) AS times FROM (SELECT unnest(['SHIPPING_INFO', 'CREATED_AT', 'UPDATED_AT']) AS column_name FROM orders) GROUP BY ALL")
def cdc_removed_columns(spark: SparkSession, sf: str) -> DataFrame:
    return evolution.removed_columns(feeds.events(spark, sf, "ORDERS"), "ORDERS")


@query("""WITH c AS (SELECT 'U' || user_id AS column_name, bool_or(event_id % 100 = 0) AS old, bool_or(event_id % 100 = 1) AS new FROM events GROUP BY ALL)
    SELECT column_name, CASE WHEN new THEN 'added' ELSE 'removed' END AS change FROM c WHERE old <> new""")
def cdc_changed_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of a few events, so that users, and the columns of their own, come and go."""
    # stored, so that the events are decoded once for both
    e = written(_user_columns(spark, sf).filter("LOG_ID % 100 < 2"))
    return evolution.changed_columns(e.filter("LOG_ID % 100 = 0"), e.filter("LOG_ID % 100 = 1"))


def _odd_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit events with fields of every type beside the baseline."""
    e = feeds.dealt(feeds.table(spark, sf, "events"))
    row = F.struct(
        F.col("event_id").alias("LOG_ID"), F.col("user_id").alias("N_INT"), (F.col("user_id") + 3_000_000_000).alias("N_LONG"), (F.col("event_id") + F.lit(0.5)).alias("N_DOUBLE"), F.col("event_type").alias("S"), (F.col("event_id") % 2 == 0).alias("B"), F.struct(F.col("user_id").alias("x")).alias("O"), F.array(F.col("user_id")).alias("A"),
    )
    return envelope.rows(envelope.decode(envelope.encode(feeds._images(e, "event_id", row, F.unix_millis("ts"), op=F.lit("c")), "AUDIT_LOG")), "AUDIT_LOG")


@query("SELECT DISTINCT 'AUDIT_LOG' AS table_name, unnest(['N_INT', 'N_LONG', 'N_DOUBLE', 'S', 'B', 'O', 'A']) AS column_name, unnest(['NUMBER(10)', 'NUMBER(19)', 'NUMBER(15,4)', 'VARCHAR2(255)', 'NUMBER(1)', 'VARCHAR2(255)', 'VARCHAR2(255)']) AS column_type FROM events")
def cdc_registry_types(spark: SparkSession, sf: str) -> DataFrame:
    return evolution.detected(_odd_audit(spark, sf), "AUDIT_LOG")


@query("SELECT DISTINCT 'AUDIT_LOG' AS table_name, unnest(['N_LONG', 'N_DOUBLE', 'S', 'B', 'O', 'A']) AS column_name, false AS is_active FROM events")
def cdc_register_columns(spark: SparkSession, sf: str) -> DataFrame:
    found = evolution.detected(_odd_audit(spark, sf), "AUDIT_LOG")
    registry = mapping.registry_seed(spark).select("table_name", "column_name").unionByName(found.filter("column_name = 'N_INT'").select("table_name", "column_name"))
    return evolution.register(registry, found).select("table_name", "column_name", "is_active")


@query("SELECT DISTINCT unnest(['N_INT', 'N_LONG', 'N_DOUBLE', 'S', 'B', 'O', 'A']) AS column_name, unnest(['INT', 'BIGINT', 'DECIMAL(15,4)', 'STRING', 'BOOLEAN', 'STRING', 'STRING']) AS target_type FROM events")
def cdc_type_map(spark: SparkSession, sf: str) -> DataFrame:
    return evolution.detected(_odd_audit(spark, sf), "AUDIT_LOG").select("column_name", evolution.target_type().alias("target_type"))


@query(f"SELECT table_name, count(*) AS pending FROM (SELECT DISTINCT 'AUDIT_LOG' AS table_name, {_BY_USER} FROM events WHERE user_id % 3 > 0) GROUP BY ALL")
def cdc_pending_count(spark: SparkSession, sf: str) -> DataFrame:
    """Of the columns that are found those of every third user are active already."""
    found = evolution.detected(_user_columns(spark, sf), "AUDIT_LOG")
    found = found.withColumn("is_active", F.substring("column_name", 2, 20).cast("long") % 3 == 0)
    registry = mapping.registry_seed(spark).unionByName(found, allowMissingColumns=True)
    return evolution.pending(registry).groupBy("table_name").agg(F.count("*").alias("pending"))


@query("""SELECT o_orderkey::INT AS order_id, o_totalprice AS total_amount, NULL::VARCHAR AS shipping_info, CASE WHEN o_orderkey % 7 = 0 THEN '{"LOYALTY_POINTS":' || o_orderkey % 500 || '}' END AS extra_fields FROM orders""")
def cdc_normalized(spark: SparkSession, sf: str) -> DataFrame:
    n = evolution.normalized(feeds.events(spark, sf, "ORDERS"), "ORDERS")
    return n.select(F.col("ORDER_ID").alias("order_id"), F.col("TOTAL_AMOUNT").alias("total_amount"), F.col("SHIPPING_INFO").alias("shipping_info"), "extra_fields")


@query(f"""SELECT o_orderkey::INT AS order_id, o_custkey::INT AS customer_id, '{{"LOYALTY_POINTS":' || o_orderkey % 500 || '}}' AS data, 'ORDERS' AS source_table, {O_OP} AS operation, make_timestamp({O_TS} * 1000) AS event_timestamp FROM orders WHERE o_orderkey % 7 = 0""")
def cdc_dynamic_rows(spark: SparkSession, sf: str) -> DataFrame:
    return evolution.dynamic_rows(feeds.events(spark, sf, "ORDERS"), "ORDERS")


@query("SELECT o_orderkey::INT AS order_id, (o_orderkey % 500)::VARCHAR AS value FROM orders WHERE o_orderkey % 7 = 0")
def cdc_json_key_query(spark: SparkSession, sf: str) -> DataFrame:
    return evolution.json_lookup(cdc_dynamic_rows(spark, sf), "LOYALTY_POINTS").select("order_id", "value")


@query("SELECT o_orderkey::INT AS order_id, CASE WHEN o_orderkey % 7 = 0 THEN (o_orderkey % 500)::INT END AS loyalty_points FROM orders")
def cdc_promote_backfill(spark: SparkSession, sf: str) -> DataFrame:
    target = mapping.to_target(feeds.events(spark, sf, "ORDERS"), "ORDERS").select("order_id")
    return evolution.backfill(target, cdc_dynamic_rows(spark, sf), "order_id", "loyalty_points", "LOYALTY_POINTS", "int")


@query("""WITH c AS (SELECT user_id, arg_min(event_id, (ts, event_id)) * 1000000 AS v FROM events GROUP BY ALL)
    SELECT 'AUDIT_LOG' AS table_name, 'U' || user_id AS column_name, 'cdc_audit_log' AS target_table, 'u' || user_id AS target_column, CASE WHEN v > 2147483647 THEN 'BIGINT' ELSE 'INT' END AS target_type, true AS is_active FROM c
    UNION ALL SELECT DISTINCT 'ORDERS', 'LOYALTY_POINTS', NULL, NULL, NULL, false FROM orders WHERE o_orderkey % 7 = 0""")
def cdc_promote_registry(spark: SparkSession, sf: str) -> DataFrame:
    """The pending columns of one table become active, with types by their first values; those of others stay pending."""
    found = evolution.detected(_user_columns(spark, sf), "AUDIT_LOG").unionByName(evolution.detected(feeds.events(spark, sf, "ORDERS"), "ORDERS"))
    registry = mapping.registry_seed(spark).unionByName(found.withColumn("is_active", F.lit(False)), allowMissingColumns=True)
    out = evolution.promote(registry, "AUDIT_LOG", "cdc_audit_log").filter("column_name RLIKE '^U[0-9]' OR column_name = 'LOYALTY_POINTS'")
    return out.select("table_name", "column_name", "target_table", "target_column", "target_type", "is_active")


@query("SELECT event_id::INT AS log_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id::INT END AS amount FROM events")
def cdc_safe_cast(spark: SparkSession, sf: str) -> DataFrame:
    e = feeds.dealt(feeds.table(spark, sf, "events"))
    row = F.struct(F.col("event_id").alias("LOG_ID"), F.when(F.col("event_id") % 3 == 0, F.concat("user_id", F.lit("x"))).otherwise(F.col("user_id").cast("string")).alias("ENTITY_ID"))
    rows = envelope.rows(envelope.decode(envelope.encode(feeds._images(e, "event_id", row, F.lit(1), op=F.lit("c")), "AUDIT_LOG")), "AUDIT_LOG")
    return rows.select(F.col("LOG_ID").alias("log_id"), F.col("ENTITY_ID").alias("amount"))


@query("SELECT event_id::INT AS log_id, user_id::VARCHAR AS user_id FROM events")
def cdc_map_parse(spark: SparkSession, sf: str) -> DataFrame:
    m = evolution.as_map(feeds.events(spark, sf, "AUDIT_LOG"))
    return m.select(F.col("LOG_ID").alias("log_id"), F.col("fields")["USER_ID"].alias("user_id"))


@query("SELECT o_orderkey::INT AS \"ORDER_ID\", NULL::VARCHAR AS \"PRIORITY\", NULL::INT AS \"POINTS\" FROM orders")
def cdc_missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import types as T

    return evolution.with_columns(feeds.events(spark, sf, "ORDERS").select("ORDER_ID"), T.StructType.fromDDL("ORDER_ID INT, PRIORITY STRING, POINTS INT"))


# XML

_XML_ORDERS = "EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o_orderkey)"


@query("SELECT l_orderkey::INT AS order_id, l_partkey::INT AS product_id, l_quantity::INT AS quantity, l_extendedprice::DECIMAL(15,2)::DOUBLE AS unit_price, round(l_quantity::INT * l_extendedprice::DECIMAL(15,2), 2)::DOUBLE AS subtotal, 'SHIPPING_INFO' AS extracted_from FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0")
def xml_items(spark: SparkSession, sf: str) -> DataFrame:
    return xml.order_items(feeds.events(spark, sf, "ORDERS", xml=True)).withColumnRenamed("ORDER_ID", "order_id")


@query(f"SELECT o_orderkey::INT AS order_id, 'MALFORMED_XML' AS error_type FROM orders WHERE o_orderkey % 11 = 0 AND {_XML_ORDERS}")
def xml_malformed(spark: SparkSession, sf: str) -> DataFrame:
    return xml.malformed(feeds.events(spark, sf, "ORDERS", xml=True), xml.ITEMS).select(F.col("ORDER_ID").alias("order_id"), "error_type")


@query(f"SELECT o_orderkey::INT AS order_id, o_orderkey % 11 = 0 AND {_XML_ORDERS} AS xml_error FROM orders")
def xml_marked(spark: SparkSession, sf: str) -> DataFrame:
    return xml.with_parsed(feeds.events(spark, sf, "ORDERS", xml=True), xml.ITEMS).select(F.col("ORDER_ID").alias("order_id"), F.col("_xml_error").alias("xml_error"))


@query(f"SELECT c_custkey::INT AS customer_id, type, n_name || CASE type WHEN 'billing' THEN ' 1' ELSE ' 2' END AS street, n_name AS city, CASE WHEN type = 'billing' THEN c_custkey::VARCHAR END AS zip FROM {C_FROM}, (SELECT unnest(['billing', 'shipping']) AS type)")
def xml_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """A configured extraction: elements and an attribute; a missing element is null."""
    c = feeds.table(spark, sf, "customer").join(F.broadcast(feeds.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # nation has 25 rows
    text = F.format_string('<customer><addresses><address type="billing"><street>%s 1</street><city>%s</city><zip>%d</zip></address><address type="shipping"><street>%s 2</street><city>%s</city></address></addresses></customer>', "n_name", "n_name", "c_custkey", "n_name", "n_name")
    return xml.extract(c.select(F.col("c_custkey").cast("int").alias("customer_id"), text.alias("ADDRESS")), xml.ADDRESSES, ["customer_id"]).drop("extracted_from")


# Joins and aggregates


@query(f"SELECT * REPLACE (total_amount::DOUBLE AS total_amount) FROM {ENRICHED}")
def enrich_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf)


@query(f"""SELECT {ITEM}::INT AS item_id, l_orderkey::INT AS order_id, l_partkey::INT AS product_id, p_name AS product_name, p_type AS product_category, l_quantity::INT AS quantity
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 3 > 0""")
def enrich_with_products(spark: SparkSession, sf: str) -> DataFrame:
    """Every item, with nulls for the products that are unknown."""
    out = joins.items_with_products(feeds.events(spark, sf, "ORDER_ITEMS"), feeds.events(spark, sf, "PRODUCTS").filter("PRODUCT_ID % 3 > 0"))
    columns = {"ITEM_ID": "item_id", "ORDER_ID": "order_id", "PRODUCT_ID": "product_id", "QUANTITY": "quantity"}
    return out.select(*columns, "product_name", "product_category").withColumnsRenamed(columns)


@query("SELECT o_orderkey AS order_id, o_custkey AS k, o_orderstatus AS status, c_mktsegment AS status_right FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def enrich_dynamic_join(spark: SparkSession, sf: str) -> DataFrame:
    o = feeds.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"))
    c = feeds.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("status"))
    return joins.dynamic_join(o, c, "k")


@query(f"SELECT o_custkey::INT AS customer_id, count(*) AS order_count, sum(o_totalprice::DECIMAL(15,2))::DOUBLE AS total_revenue, arg_max(o_orderstatus, {O_TS}::HUGEINT * 1000000000 + o_orderkey) AS latest_status FROM orders GROUP BY ALL")
def customer_dynamic_agg(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.by_customer(feeds.events(spark, sf, "ORDERS"), ["STATUS", "SALES_CHANNEL"]).withColumnRenamed("CUSTOMER_ID", "customer_id")


@query(f"SELECT l_orderkey::INT AS order_id, count(*) AS item_count, sum(l_extendedprice::DECIMAL(15,2))::DOUBLE AS items_total FROM {LATEST_ITEMS} GROUP BY ALL")
def items_per_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.events(spark, sf, "ORDER_ITEMS").select("ITEM_ID", "ORDER_ID", "SUBTOTAL", *dedup.ORDER)
    return joins.items_per_order(dedup.latest_by_key(rows, ["ITEM_ID"])).withColumnRenamed("ORDER_ID", "order_id")


_TIERS = f"SELECT min(window_start) AS window_start, max(window_end) AS window_end, coalesce(customer_tier, 'UNKNOWN') AS customer_tier, NULL::VARCHAR AS product_category, count(*) AS order_count, coalesce(sum({{x}}), 0)::DOUBLE AS total_revenue, round(sum({{x}})::DECIMAL(28,10) / count({{x}}), 2)::DOUBLE AS avg_order_value FROM {ENRICHED} GROUP BY coalesce(customer_tier, 'UNKNOWN')"


@query(_TIERS.format(x="total_amount"))
def agg_by_tier(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.by_tier(_enriched(spark, sf))


@query(_TIERS.format(x="coalesce(CASE WHEN order_id % 10 > 0 THEN total_amount END, 0)"))
def agg_by_tier_nulls_zero(spark: SparkSession, sf: str) -> DataFrame:
    e = _enriched(spark, sf).withColumn("total_amount", F.when(F.col("order_id") % 10 > 0, F.col("total_amount")))
    return aggregates.by_tier(e, null_as_zero=True)


_SUMS = """count(*) AS order_count, sum({v}::DECIMAL(18,4))::DOUBLE AS total_revenue, round(sum({v}::DECIMAL(18,4))::DECIMAL(28,10) / count({v}), 4)::DOUBLE AS avg_order_value"""
_WINDOWS = f"SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end, event_type, {_SUMS.format(v='value')} FROM events GROUP BY ALL"


@query(_WINDOWS)
def agg_window(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.windowed(feeds.table(spark, sf, "events"), "ts", ["event_type"], "value")


@query(f"""WITH rows AS (SELECT time_bucket(INTERVAL 5 MINUTE, make_timestamp({L_TS} * 1000)) AS window_start, coalesce(customer_tier, 'UNKNOWN') AS customer_tier, p_type AS product_category, l_extendedprice
        FROM {LATEST_ITEMS} LEFT JOIN {ENRICHED} ON l_orderkey = order_id LEFT JOIN (SELECT * FROM part WHERE {P_OP} <> 'd') ON l_partkey = p_partkey WHERE {L_OP} <> 'd')
    SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, customer_tier, product_category, {_SUMS.format(v='l_extendedprice')} FROM rows GROUP BY ALL""")
def agg_window_tier_category(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of five minutes by customer tier and product category over the current items."""
    now = lambda t, key, *columns: joins.current(dedup.latest_by_key(feeds.events(spark, sf, t).select(key, *columns, "_cdc_op", *dedup.ORDER), [key]))
    items, orders = now("ORDER_ITEMS", "ITEM_ID", "ORDER_ID", "PRODUCT_ID", "SUBTOTAL"), now("ORDERS", "ORDER_ID", "CUSTOMER_ID")
    items = joins.items_of_orders(items, orders, now("CUSTOMERS", "CUSTOMER_ID", "TIER"), now("PRODUCTS", "PRODUCT_ID", "NAME", "CATEGORY"))
    return aggregates.windowed(items, "source_ts", ["customer_tier", "product_category"], "SUBTOTAL")


@query("SELECT 'ORDERS' AS table_name, count(*) AS events FROM orders UNION ALL SELECT 'ORDER_ITEMS', count(*) FROM lineitem UNION ALL SELECT 'CUSTOMERS', count(*) FROM customer UNION ALL SELECT 'PRODUCTS', count(*) FROM part UNION ALL SELECT 'AUDIT_LOG', count(*) FROM events")
def event_counts_by_table(spark: SparkSession, sf: str) -> DataFrame:
    every = feeds.feed(spark, sf, "ORDERS")
    for name in ("ORDER_ITEMS", "CUSTOMERS", "PRODUCTS", "AUDIT_LOG"):
        every = every.union(feeds.feed(spark, sf, name))
    return aggregates.counts_by(envelope.topic_parts(every), "table_name")


@query(f"SELECT CASE {L_OP} WHEN 'd' THEN 'delete' WHEN 'u' THEN 'update' ELSE 'insert' END AS operation, count(*) AS events FROM lineitem GROUP BY ALL")
def event_counts_by_operation(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.counts_by(envelope.topic_parts(feeds.feed(spark, sf, "ORDER_ITEMS")), "operation")


@query("SELECT 'orders' AS table_name, count(*) AS row_count FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer")
def table_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.table_counts({t: feeds.table(spark, sf, t) for t in ("orders", "lineitem", "customer")})


@query("SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end, 'c' AS consumer_id, 'events' AS metric_name, count(*)::DOUBLE AS metric_value, 'events' AS metric_unit FROM events GROUP BY ALL")
def consumer_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.metrics(feeds.table(spark, sf, "events"), "ts", "c")


@query("SELECT count(DISTINCT l_orderkey) AS keys, count(*) AS total_items FROM lineitem")
def state_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.state_sizes(feeds.events(spark, sf, "ORDER_ITEMS"), "ORDER_ID")


@query(f"SELECT 'cdc/oracle/SALES/ORDERS/' || CASE {O_OP} WHEN 'd' THEN 'delete' WHEN 'u' THEN 'update' ELSE 'insert' END AS topic, max(o_orderkey) AS last_offset, make_timestamp(max({O_TS}) * 1000) AS last_timestamp, 'c' AS consumer_id FROM orders GROUP BY ALL")
def feed_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Written in two batches, the later events first."""
    tables, d = sinks.Tables(spark, shared_folder(spark)), _decoded(spark, sf, "ORDERS")
    for i in (1, 0):
        out = aggregates.progress(d.filter(F.col("scn").cast("long") % 2 == i), "c")
        tables.advance("cdc_checkpoints", out, 1 - i)
    return tables.reached("cdc_checkpoints").select(*out.columns)


# Reports


@query(f"SELECT order_id, window_start FROM {ENRICHED} ORDER BY window_start DESC, order_id DESC LIMIT 5")
def latest_enriched(spark: SparkSession, sf: str) -> DataFrame:
    return reports.newest(_enriched(spark, sf), 5, "window_start", "order_id").select("order_id", "window_start")


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 100 OFFSET 250")
def page_events(spark: SparkSession, sf: str) -> DataFrame:
    return reports.page(feeds.table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 100, 250)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def newest_n(spark: SparkSession, sf: str) -> DataFrame:
    return reports.newest(feeds.table(spark, sf, "events").select("event_id", "ts"), 1000, "ts", "event_id")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 100")
def lookup_events(spark: SparkSession, sf: str) -> DataFrame:
    return reports.lookup(feeds.table(spark, sf, "events").select("event_id", "event_type"), "event_type", "error", ["event_id"])


@query(f"SELECT event_id FROM events WHERE ts >= {AS_OF} - INTERVAL 3600 SECOND")
def ttl_filter(spark: SparkSession, sf: str) -> DataFrame:
    return reports.alive(feeds.table(spark, sf, "events"), F.expr(AS_OF), 3600, "ts").select("event_id")


@query(f"SELECT event_id FROM events WHERE ts >= {AS_OF} - INTERVAL 7 DAY")
def retention(spark: SparkSession, sf: str) -> DataFrame:
    return reports.retained(feeds.table(spark, sf, "events"), F.expr(AS_OF), 7, "ts").select("event_id")


# Alerts


@query(f"SELECT order_id, total_amount::DOUBLE AS total_amount FROM {ENRICHED} WHERE coalesce(total_amount, 0) >= 10000")
def alert_high_value(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.high_value(_enriched(spark, sf)).select("order_id", "total_amount")


@query(f"SELECT order_id, total_amount::DOUBLE AS total_amount FROM {ENRICHED} WHERE total_amount > 400000 AND customer_tier = 'BUILDING'")
def alert_high_value_tier(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.high_value(_enriched(spark, sf), 400_000, "BUILDING").select("order_id", "total_amount")


@query(f"SELECT c_custkey::INT AS customer_id FROM customer WHERE {C_OP} = 'c' AND c_mktsegment = 'BUILDING'")
def alert_new_customer(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.new_customers(feeds.events(spark, sf, "CUSTOMERS"), "BUILDING").select(F.col("CUSTOMER_ID").alias("customer_id"))


@query("""WITH e AS (SELECT *, time_bucket(INTERVAL 60 MINUTE, ts) AS w, row_number() OVER (PARTITION BY time_bucket(INTERVAL 60 MINUTE, ts) ORDER BY value) AS k,
            CASE WHEN event_id % 10 > 0 THEN ts + INTERVAL 1 MINUTE * (event_id % 180) END AS done FROM events),
        per AS (SELECT w, w + INTERVAL 60 MINUTE AS till, count(*) AS n, avg((event_type = 'error')::INT::DOUBLE) AS errors, sum((event_type = 'error' AND event_id % 3 = 0)::INT)::DOUBLE AS dead FROM e GROUP BY ALL),
        waiting AS (SELECT per.w, count(*)::DOUBLE AS n FROM per JOIN e ON e.ts < till AND (done IS NULL OR done > till) GROUP BY per.w),
        p99 AS (SELECT e.w, min(value) AS p FROM e JOIN per USING (w) WHERE k >= ceil(0.99 * n) GROUP BY e.w)
    SELECT w AS window_start, 'error_rate' AS rule, errors AS value FROM per WHERE errors > 0.25 UNION ALL SELECT w, 'backlog', n FROM waiting WHERE n > 90
    UNION ALL SELECT w, 'dead_letters', dead FROM per WHERE dead > 1 UNION ALL SELECT w, 'p99_latency', p FROM p99 WHERE p > 95""")
def alert_rules(spark: SparkSession, sf: str) -> DataFrame:
    """value stands for the latency; an event is done some minutes after it came, each tenth never."""
    e, k = feeds.table(spark, sf, "events"), F.col("event_id")
    done = F.when(k % 10 > 0, F.col("ts") + F.make_dt_interval(mins=(k % 180).cast("int")))
    error = F.col("event_type") == "error"
    return alerts.breaches(e, "ts", error, F.col("value"), "60 minutes", 0.25, 95, 90, 1, done=done, is_dead=error & (k % 3 == 0))


@query(f"SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) < {AS_OF} + INTERVAL 16 DAY - INTERVAL 86400 SECOND")
def alert_silent(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.silent(feeds.table(spark, sf, "events"), "ts", "user_id", F.expr(AS_OF) + F.expr("INTERVAL 16 DAYS"), 86_400)


@query("SELECT DISTINCT 'NEW_COLUMNS' AS event_type, 'New columns in ORDERS: LOYALTY_POINTS' AS message, 'info' AS severity FROM orders WHERE o_orderkey % 7 = 0")
def alert_new_columns(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.new_column_alerts(evolution.detected(feeds.events(spark, sf, "ORDERS"), "ORDERS")).drop("payload")


# Payloads


@query(f"SELECT 'ORDERS' AS \"table\", {O_OP} AS operation, 'c' AS consumer_id, o_orderkey::VARCHAR AS order_id, o_totalprice AS total_amount, strftime(make_timestamp({O_TS} * 1000), '%Y-%m-%dT%H:%M:%S.%g') AS source_ts FROM orders")
def payload_events(spark: SparkSession, sf: str) -> DataFrame:
    p = sinks.event_payloads(cdc_map_orders(spark, sf), "ORDERS", "c")
    get = lambda path: F.get_json_object("payload", path)
    return p.select(get("$.table").alias("table"), get("$.operation").alias("operation"), get("$.consumer_id").alias("consumer_id"), get("$.data.order_id").alias("order_id"), get("$.data.total_amount").cast("double").alias("total_amount"), get("$.source_ts").alias("source_ts"))


@query(f"SELECT order_id::VARCHAR AS order_id, customer_name, item_count::VARCHAR AS item_count, strftime(window_start, '%Y-%m-%dT%H:%M:%S') AS window_start FROM {ENRICHED}")
def payload_enriched(spark: SparkSession, sf: str) -> DataFrame:
    p = sinks.row_payloads(_enriched(spark, sf), sinks.ENRICHED)
    return p.select(*[F.get_json_object("payload", f"$.{c}").alias(c) for c in ("order_id", "customer_name", "item_count", "window_start")])


@query("SELECT l_orderkey::VARCHAR AS order_id, l_partkey::VARCHAR AS product_id, 'SHIPPING_INFO' AS extracted_from FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0")
def payload_items(spark: SparkSession, sf: str) -> DataFrame:
    p = sinks.row_payloads(xml_items(spark, sf), sinks.EXTRACTED)
    return p.select(*[F.get_json_object("payload", f"$.{c}").alias(c) for c in ("order_id", "product_id", "extracted_from")])


@query(f"SELECT 'HIGH_VALUE_ORDER' AS event_type, 'High-value order ' || order_id || ': $' || format('{{:,.2f}}', total_amount::DOUBLE) AS message, 'warning' AS severity, order_id::VARCHAR AS order_id FROM {ENRICHED} WHERE total_amount >= 10000")
def payload_notifications(spark: SparkSession, sf: str) -> DataFrame:
    n = alerts.high_value_notifications(_enriched(spark, sf))
    return n.select("event_type", "message", "severity", F.get_json_object("payload", "$.order_id").alias("order_id"))


@query("SELECT event_id, event_type, true AS small FROM events")
def payload_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every payload is in one chunk, of a hundred at most."""
    p = feeds.table(spark, sf, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("payload"))
    each = sinks.chunked(p).select(F.explode("payloads").alias("p"), (F.size("payloads") <= 100).alias("small"))
    return each.select(F.from_json("p", "event_id long, event_type string").alias("p"), "small").select("p.*", "small")


# Streams


def _stream(spark: SparkSession, sf: str, name: str, files: int = 2, columns: str = "*") -> DataFrame:
    """A table, or the columns of it that are in use, as a stream of four parts, so many a micro-batch; a part is as many files as a
    large table needs."""
    source = feeds.table(spark, sf, name).select(*columns.split())
    folder, each = shared_folder(spark), _files(source)
    source.repartition(4 * each).write.parquet(folder)
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files * each).parquet(folder)


def _files(df: DataFrame, parts: int = 4) -> int:
    """How many files a part of df is dealt to: about as many as it has splits, so that no task reads more as df grows."""
    return -(-df.rdd.getNumPartitions() // parts)


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id FROM events), early AS (SELECT user_id, ms, max(ms) OVER (PARTITION BY user_id) AS seen FROM e WHERE event_id % 2 = 0)
    SELECT user_id AS key, ms AS ts, 0 AS batch FROM early GROUP BY ALL
    UNION ALL SELECT user_id, ms, 1 FROM e WHERE ms > coalesce((SELECT max(seen) FROM early f WHERE f.user_id = e.user_id), -1) GROUP BY ALL""")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The even events, then all: the second batch lets through only what is later than all that a key had in the first."""
    from sluice.streaming import pipeline, stateful

    stateful.with_rocksdb(spark)
    e, folder = feeds.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.unix_millis("ts").alias("ts"), F.col("event_id").alias("scn")), shared_folder(spark)
    for part in (e.filter("scn % 2 = 0"), e):
        part.repartition(4).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 4).parquet(folder)
    out = pipeline.collected(stateful.drop_stale(stream), shared_folder(spark))
    return out.select("key", "ts", F.col("_batch").alias("batch"))


@query(_WINDOWS.replace("FROM events", "FROM (SELECT *, max(ts) OVER () AS newest FROM events) WHERE time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE <= newest - INTERVAL 1 DAY"))
def stream_window(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that the watermark (a day, since files come in any order) has passed; the rest of the last day stays in state."""
    from sluice.streaming import pipeline

    source = feeds.table(spark, sf, "events")
    folder = shared_folder(spark)
    source.repartitionByRange(4, "ts").write.parquet(folder)
    stream = spark.readStream.schema(source.schema).parquet(folder)
    windows = aggregates.windowed(stream, "ts", ["event_type"], "value", late="1 day")
    return pipeline.collected(windows, shared_folder(spark)).drop("_batch")


@query("SELECT o_custkey AS customer_id, o_orderkey AS order_id, c_name AS customer_name FROM orders JOIN customer ON o_custkey = c_custkey")
def stream_pending_join(spark: SparkSession, sf: str) -> DataFrame:
    from sluice.streaming import pipeline, stateful

    stateful.with_rocksdb(spark)
    o = _stream(spark, sf, "orders").select(F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("order_id"))
    c = _stream(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.lit(1).alias("ts"))
    return pipeline.collected(stateful.pending_join(o, c), shared_folder(spark)).drop("_batch")


@query("""WITH near AS (SELECT o_orderkey, l_partkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate - INTERVAL 100 DAY AND o_orderdate + INTERVAL 100 DAY)
    SELECT o_orderkey AS order_id, l_partkey AS part, l_linenumber AS line FROM near
    UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM near) AND o_orderdate + INTERVAL 100 DAY < (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem))) - INTERVAL 1 DAY""")
def stream_join(spark: SparkSession, sf: str) -> DataFrame:
    """The matches, and the orders that no item can match any more once the watermark has passed."""
    from sluice.streaming import pipeline, stateful

    o = _stream(spark, sf, "orders", 4).select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_ts"))
    i = _stream(spark, sf, "lineitem", 4).select(F.col("l_orderkey").alias("item_order_id"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("item_ts"))
    return pipeline.collected(stateful.join_streams(o, i, "1 day", "100 days"), shared_folder(spark)).select("order_id", "part", "line")


@query("""SELECT o_orderkey AS order_id, c_mktsegment AS tier, l_partkey AS part, p_type AS category FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
    WHERE l_shipdate BETWEEN o_orderdate - INTERVAL 400 DAY AND o_orderdate + INTERVAL 400 DAY AND TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (c_custkey % 900) BETWEEN o_orderdate - INTERVAL 400 DAY AND o_orderdate + INTERVAL 400 DAY
      AND TIMESTAMP '1995-06-01' + INTERVAL 1 DAY * (p_partkey % 700) BETWEEN l_shipdate - INTERVAL 400 DAY AND l_shipdate + INTERVAL 400 DAY""")
def stream_join_four(spark: SparkSession, sf: str) -> DataFrame:
    """Orders, customers, items and products, in several micro-batches; customers and products get times by their keys."""
    from sluice.streaming import pipeline, stateful

    day = lambda start, key: F.expr(f"TIMESTAMP '{start} 00:00:00' + make_dt_interval(CAST({key} AS INT))")
    o = _stream(spark, sf, "orders", columns="o_orderkey o_custkey o_orderdate").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("order_customer_id"), F.col("o_orderdate").alias("order_ts"))
    c = _stream(spark, sf, "customer", columns="c_custkey c_mktsegment").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("tier"), day("1995-01-01", "c_custkey % 900").alias("customer_ts"))
    i = _stream(spark, sf, "lineitem", columns="l_orderkey l_partkey l_shipdate").select(F.col("l_orderkey").alias("item_order_id"), F.col("l_partkey").alias("item_product_id"), F.col("l_shipdate").alias("item_ts"))
    p = _stream(spark, sf, "part", columns="p_partkey p_type").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"), day("1995-06-01", "p_partkey % 700").alias("product_ts"))
    out = pipeline.collected(stateful.join_four(o, c, i, p, "10000 days", "400 days"), shared_folder(spark))
    return out.select("order_id", "tier", F.col("product_id").alias("part"), "category")


@query("""WITH i AS (SELECT l_orderkey, epoch_ms(l_shipdate) AS ts, l_partkey * 8 + l_linenumber AS id FROM lineitem),
        gaps AS (SELECT *, coalesce(ts - lag(ts) OVER w > 8640000000, true)::INT AS fresh FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY ts, id)),
        lists AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS list FROM gaps),
        sizes AS (SELECT l_orderkey, list, count(*) AS n FROM lists GROUP BY ALL)
    SELECT l_orderkey AS order_id, (CASE WHEN arg_max(n, list) <= 3 THEN arg_max(n, list) ELSE 2 + (arg_max(n, list) - 4) % 2 END)::BIGINT AS items FROM sizes GROUP BY ALL""")
def stream_item_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of more than three items keep the last two, and start afresh after a hundred days without news."""
    from sluice.streaming import pipeline, stateful

    stateful.with_rocksdb(spark)
    i = _stream(spark, sf, "lineitem", 4).select(F.col("l_orderkey").alias("order_id"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("item_id"), F.unix_millis("l_shipdate").alias("ts"))
    lists = stateful.item_lists(i, cap=3, keep=2, ttl_ms=100 * 86_400_000)
    return pipeline.collected(lists, shared_folder(spark), "update").select("order_id", "items")


@query(ORACLES["cdc_upsert_customers"])
def stream_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The pipeline over customers and later versions of some, in any order and several micro-batches; the result is its table of customers."""
    from sluice.streaming.pipeline import SEQUENCE, Pipeline, Settings

    folder = shared_folder(spark)
    versions = [feeds.feed(spark, sf, "CUSTOMERS", version=v) for v in (2, 0)]
    reduce(DataFrame.unionByName, versions).repartition(3).write.json(f"{folder}/in")
    run = Pipeline(spark, f"{folder}/tables", Settings(enrich=False))
    run.start(envelope.read_feed(spark, f"{folder}/in", 1), f"{folder}/checkpoint", once=True).awaitTermination()
    schema = mapping.to_target(feeds.events(spark, sf, "CUSTOMERS"), "CUSTOMERS", sequence=True).schema
    return run.tables.read("cdc_customers", schema, ["customer_id"], SEQUENCE).select("customer_id", "name", "email", "tier", "region")


def _sent(messages: DataFrame, folder: str, batches: int) -> int:
    """Writes messages to a folder as packed files, and says how many a micro-batch takes. Packed files are not split, so there are as many
    as the feed has 8 MB (some 100 MB of messages)."""
    size = int(str(messages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    each = max(_files(messages, batches), -(-size // (batches * 8 * 2**20)))
    messages.repartition(batches * each).write.option("compression", "gzip").json(folder)
    return each


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [feeds.feed(spark, sf, t) for t in ("ORDERS", "ORDER_ITEMS", "CUSTOMERS")])


@query(ORACLES["enrich_orders"])
def stream_orders_enriched(spark: SparkSession, sf: str) -> DataFrame:
    """The pipeline over orders, items and customers in any order and several micro-batches; the result is its table of enriched orders."""
    from sluice.streaming.pipeline import Pipeline

    folder, messages = shared_folder(spark), _messages(spark, sf)
    each = _sent(messages, f"{folder}/in", 3)
    run = Pipeline(spark, f"{folder}/tables")
    run.start(envelope.read_feed(spark, f"{folder}/in", each), f"{folder}/checkpoint", once=True).awaitTermination()
    return run.orders_enriched()


@query(ORACLES["enrich_orders"])
def stream_new_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """As stream_orders_enriched, but the second half of the messages is read by a run with a new checkpoint, which knows the tables alone."""
    from sluice.streaming.pipeline import Pipeline

    folder, messages = shared_folder(spark), _messages(spark, sf)
    for half in (0, 1):
        _sent(messages.filter(F.pmod(F.xxhash64("value"), F.lit(2)) == half), f"{folder}/in{half}", 2)
        run = Pipeline(spark, f"{folder}/tables")
        run.start(envelope.read_feed(spark, f"{folder}/in{half}"), f"{folder}/checkpoint{half}", once=True).awaitTermination()
    return run.orders_enriched()


def _timed(spark: SparkSession, df: DataFrame, ts: str, parts: int = 4) -> DataFrame:
    """df as a stream of parts in the order of ts, one a micro-batch: none holds a row that is earlier than one of the parts before. A part
    is as many files as a large table needs."""
    folder, each = shared_folder(spark), _files(df)
    ms = df.withColumn("_ms", F.unix_millis(ts)).persist()
    ends = ms.approxQuantile("_ms", [i / parts for i in range(1, parts)], 0.01)
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        one = ms.filter(F.lit(True) if low is None else F.col("_ms") >= low).filter(F.lit(True) if high is None else F.col("_ms") < high)
        one.drop("_ms").repartition(each).write.mode("append").parquet(folder)
    ms.unpersist()
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(folder)


_FOUR = """o AS (SELECT o_orderkey AS k, o_custkey AS ck, o_orderdate AS ts FROM orders), c AS (SELECT c_custkey AS ck, c_mktsegment AS tier, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (c_custkey * 37 % 2400) AS ts FROM customer),
    i AS (SELECT l_orderkey AS k, l_partkey AS pk, l_extendedprice AS amount, l_shipdate AS ts FROM lineitem), p AS (SELECT p_partkey AS pk, p_type AS category, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (p_partkey * 37 % 2400) AS ts FROM part)"""


@query(f"""WITH {_FOUR}, passed AS (SELECT least((SELECT max(ts) FROM o), (SELECT max(ts) FROM c), (SELECT max(ts) FROM i), (SELECT max(ts) FROM p)) - INTERVAL 1 DAY - INTERVAL 600 DAY AS ts)
    SELECT time_bucket(INTERVAL 30 DAY, i.ts, TIMESTAMP '1970-01-01') AS window_start, tier, category, count(*) AS items, sum(amount::DECIMAL(18,4))::DOUBLE AS total
    FROM i JOIN o USING (k) JOIN c USING (ck) JOIN p USING (pk)
    WHERE i.ts BETWEEN o.ts - INTERVAL 300 DAY AND o.ts + INTERVAL 300 DAY AND c.ts BETWEEN o.ts - INTERVAL 300 DAY AND o.ts + INTERVAL 300 DAY AND p.ts BETWEEN i.ts - INTERVAL 300 DAY AND i.ts + INTERVAL 300 DAY
    GROUP BY ALL HAVING time_bucket(INTERVAL 30 DAY, any_value(i.ts), TIMESTAMP '1970-01-01') + INTERVAL 30 DAY <= (SELECT ts FROM passed)""")
def stream_tier_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows by tier and category behind the join of four streams: those that the watermark has passed through both joins."""
    from sluice.streaming import pipeline, stateful

    out = stateful.tier_windows(*four_streams(spark, sf), "1 day", "300 days", "30 days")
    return pipeline.collected(out, shared_folder(spark)).select("window_start", "tier", "category", "items", "total")


def four_streams(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders, customers, items and products in the order of their times; customers and products get times by their keys."""
    day = lambda key: F.expr(f"TIMESTAMP '1995-01-01 00:00:00' + make_dt_interval(CAST({key} * 37 % 2400 AS INT))")
    t = lambda name: feeds.table(spark, sf, name)
    o = t("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("order_customer_id"), F.col("o_orderdate").alias("order_ts"))
    c = t("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("tier"), day("c_custkey").alias("customer_ts"))
    i = t("lineitem").select(F.col("l_orderkey").alias("item_order_id"), F.col("l_partkey").alias("item_product_id"), F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").alias("item_ts"))
    p = t("part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"), day("p_partkey").alias("product_ts"))
    return _timed(spark, o, "order_ts"), _timed(spark, c, "customer_ts"), _timed(spark, i, "item_ts"), _timed(spark, p, "product_ts")


@query("""WITH i AS (SELECT l_orderkey, epoch_ms(l_shipdate) AS ts FROM lineitem),
        gaps AS (SELECT *, coalesce(ts - lag(ts) OVER w > 2592000000, true)::INT AS fresh FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY ts)),
        lists AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY ts ROWS UNBOUNDED PRECEDING) AS list FROM gaps),
        ended AS (SELECT l_orderkey, list, count(*) AS items, min(ts)::BIGINT AS first_ts, max(ts)::BIGINT AS last_ts FROM lists GROUP BY ALL)
    SELECT l_orderkey AS order_id, items, first_ts, last_ts FROM ended
    WHERE last_ts + 2592000000 <= (SELECT max(ts) FROM i) - 86400000 OR list < (SELECT max(list) FROM ended e WHERE e.l_orderkey = ended.l_orderkey)""")
def stream_expired_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The lists of items that ended by thirty days without news: timers of event time let them out, news or not."""
    from sluice.streaming import pipeline, stateful

    i = feeds.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("ts"))
    return pipeline.collected(stateful.expired_lists(_timed(spark, i, "ts"), 30 * 86_400_000, "1 day"), shared_folder(spark)).drop("_batch")


@query("""WITH e AS (SELECT event_id, ts, event_id % 4 AS file FROM events), passed AS (SELECT file, max(ts) AS ts FROM e GROUP BY file)
    SELECT event_id, coalesce(epoch_ms(ts) < epoch_ms((SELECT max(p.ts) FROM passed p WHERE p.file < e.file)) - 86400000, false) AS is_late FROM e""")
def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Files in any order of time: the rows that the watermark (a day) had passed are parted from the others, and none is dropped."""
    from sluice.streaming import pipeline, stateful

    e, folder = feeds.table(spark, sf, "events").select("event_id", "ts"), shared_folder(spark)
    for part in range(4):
        e.filter(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return pipeline.collected(stateful.parted_late(stream, "ts", "1 day"), shared_folder(spark)).select("event_id", "is_late")


@query("SELECT event_id, (1 + (epoch_ms(ts) + 86400000 <= (SELECT max(epoch_ms(ts)) FROM events) - 86400000)::INT)::BIGINT AS copies FROM events")
def stream_within_watermark(spark: SparkSession, sf: str) -> DataFrame:
    """Events that are sent twice at once and again much later: the second is dropped, the third passes once the watermark has dropped the key."""
    from sluice.streaming import pipeline, stateful

    e, folder = feeds.table(spark, sf, "events").select("event_id", "ts"), shared_folder(spark)
    end = e.agg(F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    for part in (e.unionAll(e), end, e.withColumn("ts", F.col("ts") + F.expr("INTERVAL 100 DAYS"))):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    kept = pipeline.collected(stateful.drop_repeats(stream, ["event_id"], "ts", "1 day"), shared_folder(spark))
    return kept.filter("event_id >= 0").groupBy("event_id").agg(F.count("*").alias("copies"))


@query("SELECT o_orderkey::INT AS order_id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 500 END::INT AS loyalty_points, o_orderkey % 2 = 1 AND o_orderkey % 7 = 0 AS was_written FROM orders")
def stream_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """A stream finds an unknown column; it is promoted; later batches write it, and what came before is filled in from the dynamic table."""
    from sluice.streaming.pipeline import Pipeline, Settings

    folder, feed = shared_folder(spark), feeds.feed(spark, sf, "ORDERS")
    run = Pipeline(spark, f"{folder}/tables", Settings(enrich=False))
    key = F.get_json_object("value", "$.payload.source.scn").cast("long")
    for half in (0, 1):
        feed.filter(key % 2 == half).write.mode("append").json(f"{folder}/in")
        run.start(envelope.read_feed(spark, f"{folder}/in"), f"{folder}/checkpoint", once=True).awaitTermination()
        if half == 0:
            run.promote("ORDERS")
    written = run.tables.read("cdc_orders", T.StructType.fromDDL("order_id INT, loyalty_points INT")).withColumn("was_written", F.col("loyalty_points").isNotNull())
    dynamic = run.tables.read("cdc_orders_dynamic", T.StructType.fromDDL("order_id INT, data STRING, event_timestamp TIMESTAMP"))
    return evolution.backfill(written, dynamic, "order_id", "loyalty_points", "LOYALTY_POINTS", "int").select("order_id", "loyalty_points", "was_written")


@query("SELECT 'rows' AS metric_name, count(*)::DOUBLE AS metric_value, 'rows' AS metric_unit FROM orders UNION ALL SELECT 'batches', 3, 'batches'")
def stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """What a run has measured of itself, as its table of metrics holds it: rows and batches (times and rates differ between runs)."""
    from sluice.streaming.pipeline import METRICS, Pipeline, Settings

    folder, feed = shared_folder(spark), feeds.feed(spark, sf, "ORDERS")
    each = _files(feed, 3)
    feed.repartition(3 * each).write.json(f"{folder}/in")
    run = Pipeline(spark, f"{folder}/tables", Settings(enrich=False, report_seconds=0))
    run.start(envelope.read_feed(spark, f"{folder}/in", each), f"{folder}/checkpoint", once=True).awaitTermination()
    out = run.tables.read("cdc_metrics", T.StructType.fromDDL(METRICS)).filter(F.col("metric_name").isin("rows", "batches"))
    return out.groupBy("metric_name", "metric_unit").agg(F.sum("metric_value").cast("double").alias("metric_value"))


@query("""WITH e AS (SELECT *, time_bucket(INTERVAL 60 MINUTE, ts) AS w, row_number() OVER (PARTITION BY time_bucket(INTERVAL 60 MINUTE, ts) ORDER BY value) AS k FROM events),
        per AS (SELECT w, count(*) AS n, avg((event_type = 'error')::INT::DOUBLE) AS errors, sum((event_type = 'error' AND event_id % 3 = 0)::INT)::DOUBLE AS dead FROM e GROUP BY ALL
                HAVING w + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY),
        p99 AS (SELECT e.w, min(value) AS p FROM e JOIN per USING (w) WHERE k >= ceil(0.99 * n) GROUP BY e.w)
    SELECT w AS window_start, 'error_rate' AS rule, errors AS value FROM per WHERE errors > 0.25
    UNION ALL SELECT w, 'dead_letters', dead FROM per WHERE dead > 1 UNION ALL SELECT w, 'p99_latency', p FROM p99 WHERE p > 95""")
def stream_alert_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules on error rate, latency and dead letters as windows of a stream, judged once the watermark has passed them."""
    from sluice.streaming import pipeline

    e, k = _timed(spark, feeds.table(spark, sf, "events").select("event_id", "event_type", "ts", "value"), "ts"), F.col("event_id")
    error = F.col("event_type") == "error"
    out = alerts.breaches(e, "ts", error, F.col("value"), "60 minutes", 0.25, 95, 90, 1, is_dead=error & (k % 3 == 0), late="1 day")
    return pipeline.collected(out, shared_folder(spark)).drop("_batch")


@query("SELECT (ts::DATE)::VARCHAR AS day, count(*) AS events FROM events WHERE ts::DATE >= (SELECT min(ts)::DATE + 5 FROM events) GROUP BY ALL")
def retention_days(spark: SparkSession, sf: str) -> DataFrame:
    """A log that lies by day, in two batches, of which the first five days are dropped."""
    tables, e = sinks.Tables(spark, shared_folder(spark)), feeds.table(spark, sf, "events").select("event_id", "ts")
    for i in (0, 1):
        tables.write("cdc_audit_log", e.filter(F.col("event_id") % 2 == i), i, day="ts")
    tables.expire("cdc_audit_log", e.agg(F.date_add(F.min("ts").cast("date"), 5)).first()[0])
    return tables.read("cdc_audit_log", e.schema).groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(F.count("*").alias("events"))
