"""The star-schema tables as change feeds, by integer arithmetic that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.folders import written
from sluice.sources.envelope import decode, encode, rows

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its times, which have no zone, are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def dealt(df: DataFrame, by: str | None = None) -> DataFrame:
    """A table's rows, whose messages are much longer and cost more, dealt to all cores.

    Spark cuts a table that is no larger than two full splits a core into about a split a core, but whole row groups go to one of
    them: a table that lies in a few row groups would keep as many cores busy. A larger one has several full splits a core.
    by: rows with equal values of this column go to one core and lie together, whatever the table's size.
    """
    splits, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    if by:
        return df.repartition(max(splits, cores), by).sortWithinPartitions(by)
    return df.repartition(max(splits, cores)) if splits <= 2 * cores else df


def op_of(key: Column) -> Column:
    """d for each twentieth key, u for the next five, else c."""
    return F.when(key % 20 == 0, "d").when(key % 20 <= 5, "u").otherwise("c")


def _images(df: DataFrame, key: str, row: Column, ts_ms: Column, scn: Column | None = None, op: Column | None = None) -> DataFrame:
    op = op_of(F.col(key)) if op is None else op
    out = df.select(row.alias("row"), op.alias("op"), ts_ms.cast("long").alias("ts_ms"), (F.col(key) if scn is None else scn).alias("scn"))
    return out.withColumns({"before": F.when(F.col("op").isin("u", "d"), F.col("row")), "after": F.when(F.col("op") != "d", F.col("row"))}).drop("row")


def orders(spark: SparkSession, sf_dir: str, xml: bool = False, op: Column | None = None) -> DataFrame:
    """LOYALTY_POINTS, a column that the baseline lacks, is in each seventh order; with xml the items are in SHIPPING_INFO."""
    # with xml the join deals the rows
    o = table(spark, sf_dir, "orders") if xml else dealt(table(spark, sf_dir, "orders"))
    if xml:
        o = o.join(shipping(spark, sf_dir), "o_orderkey", "left")
    row = F.struct(
        F.col("o_orderkey").alias("ORDER_ID"), F.col("o_custkey").alias("CUSTOMER_ID"), F.date_format("o_orderdate", ISO).alias("ORDER_DATE"), F.col("o_totalprice").alias("TOTAL_AMOUNT"), F.col("o_orderstatus").alias("STATUS"), *([F.col("xml").alias("SHIPPING_INFO")] if xml else []),
        F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") % 500).alias("LOYALTY_POINTS"),
    )
    return _images(o, "o_orderkey", row, F.unix_millis("o_orderdate") + F.col("o_orderkey") % 1000, op=op)


def shipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, xml) of orders with items: every eleventh broken, every thirteenth without an items element."""
    item = F.concat(F.lit('<item product_id="'), F.col("l_partkey"), F.lit('" quantity="'), F.col("l_quantity").cast("int"), F.lit('" unit_price="'), F.col("l_extendedprice").cast("decimal(15,2)"), F.lit('"/>'))
    # an order has a handful of items
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items"))
    whole = F.concat(F.lit("<shipping_info><items>"), F.col("items"), F.lit("</items></shipping_info>"))
    xml = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("<shipping_info><items>"), F.col("items"))).when(F.col("o_orderkey") % 13 == 0, F.lit("<shipping_info><address>x</address></shipping_info>")).otherwise(whole)
    return items.select("o_orderkey", xml.alias("xml"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several events of one item are natural: order and line number do not tell line items apart."""
    li = dealt(table(spark, sf_dir, "lineitem")).withColumn("item", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    row = F.struct(F.col("item").alias("ITEM_ID"), F.col("l_orderkey").alias("ORDER_ID"), F.col("l_partkey").alias("PRODUCT_ID"), F.col("l_quantity").cast("int").alias("QUANTITY"), F.col("l_extendedprice").alias("UNIT_PRICE"), F.col("l_extendedprice").alias("SUBTOTAL"))
    return _images(li, "l_partkey", row, F.unix_millis("l_shipdate") + F.col("l_partkey") % 1000, F.col("l_partkey") * 1_000_000 + F.col("l_suppkey"))


def customers(spark: SparkSession, sf_dir: str, version: int = 0) -> DataFrame:
    """Version v holds the customers whose key is divisible by v + 1, 1000 v ms later and with another tier."""
    c = dealt(table(spark, sf_dir, "customer")).filter(F.col("c_custkey") % (version + 1) == 0)
    c = c.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # nation has 25 rows
    row = F.struct(
        F.col("c_custkey").alias("CUSTOMER_ID"), F.get(F.split("c_name", "#"), F.lit(0)).alias("FIRST_NAME"), F.get(F.split("c_name", "#"), F.lit(1)).alias("LAST_NAME"), F.concat(F.lit("c"), F.col("c_custkey"), F.lit("@example.com")).alias("EMAIL"), F.col("n_name").alias("CITY"),
        F.concat(F.col("c_mktsegment"), F.lit(f"-{version}" if version else "")).alias("TIER"),
    )
    return _images(c, "c_custkey", row, F.lit(1_700_000_000_000 + 1000 * version) + F.col("c_custkey"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dealt(table(spark, sf_dir, "part"))
    status = F.when(F.col("p_partkey") % 10 == 0, "INACTIVE").when(F.col("p_partkey") % 10 != 1, "ACTIVE")
    row = F.struct(F.col("p_partkey").alias("PRODUCT_ID"), F.col("p_name").alias("NAME"), F.col("p_type").alias("CATEGORY"), F.col("p_retailprice").alias("PRICE"), F.col("p_size").alias("STOCK_QUANTITY"), status.alias("STATUS"))
    return _images(p, "p_partkey", row, F.lit(1_700_000_000_000) + F.col("p_partkey"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dealt(table(spark, sf_dir, "events"))
    row = F.struct(F.col("event_id").alias("LOG_ID"), F.col("event_type").alias("ACTION"), F.lit("EVENTS").alias("ENTITY_TYPE"), F.col("event_id").alias("ENTITY_ID"), F.col("user_id").alias("USER_ID"), F.col("props").alias("DETAILS"), F.date_format("ts", ISO).alias("CREATED_AT"))
    return _images(e, "event_id", row, F.unix_millis("ts"), op=F.lit("c"))


BUILDERS = {"ORDERS": orders, "ORDER_ITEMS": order_items, "CUSTOMERS": customers, "PRODUCTS": products, "AUDIT_LOG": audit}


_stored: dict[tuple[str, ...], DataFrame] = {}


def feed(spark: SparkSession, sf_dir: str, name: str, **how) -> DataFrame:
    """A table's events as messages (topic, value), stored as any feed is: what reads them does not encode them again.

    Written once for each application, folder and way.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name, str(sorted(how.items(), key=str)))
    if key not in _stored:
        _stored[key] = written(encode(BUILDERS[name](spark, sf_dir, **how), name))
    return _stored[key]


def events(spark: SparkSession, sf_dir: str, name: str, **how) -> DataFrame:
    """A table's events, encoded and decoded again."""
    return rows(decode(feed(spark, sf_dir, name, **how)), name)
