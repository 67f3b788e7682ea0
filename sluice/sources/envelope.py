"""Change events to rows and back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.columns import let, spread
from sluice.functions.schemas import EVENT, schema

OPERATIONS = {"c": "insert", "r": "read", "u": "update", "d": "delete"}
FEED = "topic STRING, value STRING"


def read_feed(spark: SparkSession, path: str, most_files: int | None = None) -> DataFrame:
    """A stream of (topic, value) JSON lines as they arrive in a folder; most_files bounds a micro-batch."""
    reader = spark.readStream.schema(FEED)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return reader.json(path)


def topic_parts(feed: DataFrame) -> DataFrame:
    """feed with schema_name, table_name and operation, the third to fifth part of the topic; UNKNOWN, UNKNOWN and unknown if missing."""
    part = lambda i, default: F.coalesce(F.get(F.split("topic", "/"), F.lit(i)), F.lit(default))
    return feed.withColumns({"schema_name": part(2, "UNKNOWN"), "table_name": part(3, "UNKNOWN"), "operation": part(4, "unknown")})


def subscribe(feed: DataFrame, patterns: list[str]) -> DataFrame:
    """The rows whose topic matches one of the patterns; * stands for one whole level or a part of it."""
    if not patterns:
        return feed.filter(F.lit(False))
    globs = ["[^/]*".join(re.escape(p) for p in pattern.split("*")) for pattern in patterns]
    return feed.filter(F.col("topic").rlike("^(?:" + "|".join(globs) + ")$"))


def decode(feed: DataFrame) -> DataFrame:
    """feed (topic, value, perhaps received_at) with op, ts_ms, scn, before, after, image and error_type, error_message.

    The payload may stand alone or inside {"payload": ...}. A missing op is c, a missing ts_ms the time of receipt if the feed has it.
    image is the row that the operation leaves: before for d, after otherwise; before and after stay JSON text, so that
    columns unknown so far survive. Rows without a body are dropped. Bad JSON, unknown operations and empty images have the
    error_type MALFORMED_JSON, all others null.

    All that is read from a value comes from one parse: the fields are one struct, bound once and spread by a generator, which
    filters on them do not pass.
    """
    feed = topic_parts(feed.filter(F.trim("value") != ""))
    received = F.unix_millis("received_at") if "received_at" in feed.columns else F.lit(None).cast("long")

    def event(e: Column) -> Column:
        bare = F.struct(*[e[c].alias(c) for c in ("before", "after", "source", "op", "ts_ms")])
        return let(F.coalesce(e["payload"], bare), lambda p: let(F.coalesce(p["op"], F.lit("c")), lambda op: with_image(e, p, op)))

    def with_image(e: Column, p: Column, op: Column) -> Column:
        return let(F.when(op.isin("c", "r", "u"), p["after"]).when(op == "d", p["before"]), lambda image: record(e, p, op, image))

    def record(e: Column, p: Column, op: Column, image: Column) -> Column:
        # a value whose text starts with a brace was an object, so it is parsed no more, unless the message has such a string
        whole = image.startswith('{"') & ~F.contains("value", F.lit('"{')) & ~F.contains("value", F.lit("\\u007"))
        empty = F.when(whole, False).otherwise(F.coalesce(F.size(F.json_object_keys(image)), F.lit(0)) <= 0)
        # the parser also marks values of another type as corrupt; only what is no JSON at all is an error
        broken = e["_corrupt"].isNotNull() & F.try_parse_json("value").isNull()
        error = F.when(broken, "not valid JSON").when(~op.isin(*OPERATIONS), F.concat(F.lit("unknown operation "), op)).when(empty, "empty row image")
        return let(error, lambda message: F.struct(
            op.alias("op"), F.coalesce(p["ts_ms"], received).alias("ts_ms"), p["source"]["scn"].alias("scn"), p["before"].alias("before"), p["after"].alias("after"), image.alias("image"),
            message.alias("error_message"), F.when(message.isNotNull(), "MALFORMED_JSON").alias("error_type"),
        ))

    parsed = F.from_json("value", EVENT, {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"})
    return spread(feed, let(parsed, event))


def valid(decoded: DataFrame) -> DataFrame:
    return decoded.filter("error_type IS NULL")


def invalid(decoded: DataFrame) -> DataFrame:
    return decoded.filter("error_type IS NOT NULL")


def typed(image: Column, fields: T.StructType) -> Column:
    """The fields of a JSON object; a value that doesn't fit its type is null and leaves the others alone. One parse for all fields.

    Numbers are read as such, which is faster than by their text; only where one does not fit are the numbers read by their texts.
    """
    numbers = [f.name for f in fields if isinstance(f.dataType, (T.IntegerType, T.DoubleType))]
    read = T.StructType([*(f if f.name in numbers else T.StructField(f.name, T.StringType()) for f in fields), T.StructField("_corrupt", T.StringType())])

    def value(raw: Column, f: T.StructField) -> Column:
        if f.name not in numbers:
            return raw[f.name].try_cast(f.dataType)
        return F.when(raw["_corrupt"].isNull(), raw[f.name]).otherwise(F.get_json_object(image, f"$.{f.name}").try_cast(f.dataType))

    parsed = F.from_json(image, read, {"columnNameOfCorruptRecord": "_corrupt"})
    return let(parsed, lambda raw: F.struct(*[value(raw, f).alias(f.name) for f in fields]))


def rows(decoded: DataFrame, table: str) -> DataFrame:
    """The valid events of a table, with its baseline columns and _cdc_op, _cdc_ts_ms, _cdc_table, _cdc_scn, _cdc_image."""
    own = valid(decoded).filter(F.col("table_name") == table).select(
        F.col("op").alias("_cdc_op"), F.col("ts_ms").alias("_cdc_ts_ms"), F.col("table_name").alias("_cdc_table"), F.col("scn").try_cast("long").alias("_cdc_scn"), F.col("image").alias("_cdc_image")
    )
    return spread(own, typed(F.col("_cdc_image"), schema(table))).select(*schema(table).names, *own.columns)


def mismatched(decoded: DataFrame, table: str, required: list[str]) -> DataFrame:
    """Valid events of a table with a null required column, or a value that doesn't fit its type: error_type SCHEMA_MISMATCH."""
    fields = schema(table)
    texts = F.from_json("image", T.StructType([T.StructField(f.name, T.StringType()) for f in fields]))

    def faults(raw: Column) -> Column:
        bad = [F.when(raw[f.name].isNotNull() & raw[f.name].try_cast(f.dataType).isNull(), F.lit(f"{f.name} does not fit {f.dataType.simpleString()}")) for f in fields]
        return F.concat_ws("; ", *bad, *[F.when(raw[c].isNull(), F.lit(f"{c} is missing")) for c in required])

    own = valid(decoded).filter(F.col("table_name") == table).drop("error_message", "error_type")
    out = spread(own, let(texts, lambda raw: F.struct(faults(raw).alias("error_message"))))
    return out.filter("error_message <> ''").withColumn("error_type", F.lit("SCHEMA_MISMATCH"))


def with_metadata(events: DataFrame) -> DataFrame:
    """events with source_ts (whole milliseconds), operation and processed_at."""
    return events.withColumns({"source_ts": F.timestamp_millis("_cdc_ts_ms"), "operation": F.col("_cdc_op"), "processed_at": F.current_timestamp()})


def split_operations(events: DataFrame, column: str = "_cdc_op") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inserts (c, r), updates and deletes."""
    return events.filter(F.col(column).isin("c", "r")), events.filter(F.col(column) == "u"), events.filter(F.col(column) == "d")


def encode(images: DataFrame, table: str, db_schema: str = "SALES", wrapped: bool = True) -> DataFrame:
    """(topic, value) of rows (before, after: structs or JSON text; op, ts_ms, scn)."""
    body = lambda c: F.parse_json(c) if dict(images.dtypes)[c] == "string" else F.col(c)
    fixed = {"version": "2.4", "connector": "oracle", "name": "feed", "snapshot": "false", "db": "ORCL", "schema": db_schema, "table": table}
    scn = F.col("scn").cast("string")
    source = F.struct(*[F.lit(v).alias(k) for k, v in fixed.items()], F.col("ts_ms"), scn.alias("txId"), scn.alias("scn"))
    payload = F.struct(body("before").alias("before"), body("after").alias("after"), source.alias("source"), F.col("op"), F.col("ts_ms"))
    word = F.element_at(F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv]), F.col("op"))
    value = F.to_json(F.struct(payload.alias("payload")) if wrapped else payload)
    return images.select(F.concat_ws("/", F.lit("cdc/oracle"), F.lit(db_schema), F.lit(table), word).alias("topic"), value.alias("value"))


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(before, after, op) between two snapshots of a table: c, u and d rows."""
    pack = lambda df, name: df.select(F.col(key).alias("_k"), F.struct(*df.columns).alias(name))
    both = pack(old, "before").join(pack(new, "after"), "_k", "full")
    op = F.when(F.col("before").isNull(), "c").when(F.col("after").isNull(), "d").when(~F.col("before").eqNullSafe(F.col("after")), "u")
    return both.withColumn("op", op).filter("op IS NOT NULL").drop("_k")
