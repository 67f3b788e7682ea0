import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def message(table, after=None, before=None, op="c", ts_ms=1_700_000_000_000, scn="1", wrapped=True):
    """(topic, value) of an event."""
    word = {"c": "insert", "u": "update", "d": "delete", "r": "read"}.get(op, "other")
    payload = {"before": before, "after": after, "source": {"scn": scn, "table": table}, "op": op, "ts_ms": ts_ms}
    return f"cdc/oracle/SALES/{table}/{word}", json.dumps({"payload": payload} if wrapped else payload)


def xml_item(product, quantity, price, subtotal=None):
    rest = "" if subtotal is None else f' subtotal="{subtotal}"'
    return f'<item product_id="{product}" quantity="{quantity}" unit_price="{price}"{rest}/>'


XML = f"<shipping_info><items>{xml_item(81, 4, 12.25, 49)}{xml_item(82, 3, 7.5, 22.5)}</items></shipping_info>"
ORDER = {"ORDER_ID": 77, "CUSTOMER_ID": 9, "ORDER_DATE": "2023-06-30", "TOTAL_AMOUNT": 71.5, "STATUS": "CONFIRMED", "SHIPPING_INFO": XML}
CUSTOMER = {"CUSTOMER_ID": 9, "FIRST_NAME": "Ada", "LAST_NAME": "Quill", "EMAIL": "ada@quill.test", "TIER": "SILVER", "CITY": "Turku"}
ITEM = {"ITEM_ID": 300, "ORDER_ID": 77, "PRODUCT_ID": 81, "QUANTITY": 4, "UNIT_PRICE": 12.25, "SUBTOTAL": 49.0}
PRODUCT = {"PRODUCT_ID": 81, "NAME": "Brass Lamp", "CATEGORY": "Lighting", "PRICE": 12.25, "STOCK_QUANTITY": 5, "STATUS": "ACTIVE"}


@pytest.fixture(scope="session")
def feed(spark):
    """Makes a feed of messages."""
    return lambda *messages: spark.createDataFrame(list(messages), "topic string, value string")
