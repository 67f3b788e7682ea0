"""Schema evolution: unknown columns are found, registered, kept as JSON, promoted and filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.columns import let
from sluice.functions.schemas import SOURCE_TYPES, TABLES, Mapped, known, schema
from sluice.operators.dedup import latest_by_key

INT_MAX = 2_147_483_647


def key_set(image: str = "_cdc_image") -> Column:
    return F.json_object_keys(image)


def new_columns(events: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """(column_name): the keys in the images of a table that are not among `columns` (the baseline)."""
    extra = F.array_except(key_set(), F.array(*map(F.lit, columns or known(table))))
    return events.select(F.explode(extra).alias("column_name")).distinct()


def removed_columns(events: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """(column_name, times): the columns that images lack, and how many do."""
    gone = F.array_except(F.array(*map(F.lit, columns or known(table))), key_set())
    return events.select(F.explode(gone).alias("column_name")).groupBy("column_name").agg(F.count("*").alias("times"))


def changed_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column_name, change): the keys of images that a batch has and the batch before it had not (added), or the other way (removed)."""
    keys = lambda events, name: events.select(F.explode(key_set()).alias("column_name")).distinct().withColumn(name, F.lit(True))
    both = keys(before, "old").join(keys(after, "new"), "column_name", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
    return both.select("column_name", change.alias("change")).filter("change IS NOT NULL")


def inferred_type(value: Column) -> Column:
    """The type of a variant value: boolean, int, long (beyond 32 bits), double, else string."""
    kind = F.schema_of_variant(value)
    whole = F.try_variant_get(value, "$", "bigint")
    return F.when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", F.when(F.abs(whole) > INT_MAX, "long").otherwise("int")).when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "double").otherwise("string")


def unknown(decoded: DataFrame, promoted: dict[str, list[str]] | None = None) -> DataFrame:
    """(table_name, op, ts_ms, scn, image, extra) of the valid events of all tables that have fields outside the baseline and the
    promoted columns: extra is the map of those alone, so what is exploded or typed later is only what is new."""
    own = {t: known(t) + (promoted or {}).get(t, []) for t in TABLES}
    names = F.create_map(*[x for t, columns in own.items() for x in (F.lit(t), F.array(*map(F.lit, columns)))])
    own = decoded.filter(F.col("error_type").isNull() & F.col("table_name").isin(*TABLES)).select("table_name", "op", "ts_ms", F.col("scn").try_cast("long").alias("scn"), "image")
    more = F.size(F.array_except(F.json_object_keys("image"), names[F.col("table_name")])) > 0
    extra = F.map_filter(F.from_json("image", "map<string,variant>"), lambda k, _: ~F.array_contains(names[F.col("table_name")], k))
    return own.filter(more).withColumn("extra", extra)


def types_of(unknown: DataFrame) -> DataFrame:
    """(table_name, column_name, column_type) of the unknown columns of all tables, by the type of the first value that is not null."""
    found = unknown.select("table_name", "ts_ms", "scn", F.explode("extra").alias("column_name", "value"))
    first = F.min_by(inferred_type(F.col("value")), F.struct(F.is_variant_null("value"), "ts_ms", "scn"))
    out = found.groupBy("table_name", "column_name").agg(first.alias("kind"))
    names = F.create_map(*[F.lit(x) for kv in SOURCE_TYPES.items() for x in kv])
    return out.select("table_name", "column_name", names[F.col("kind")].alias("column_type"))


def dynamic_of(unknown: DataFrame) -> DataFrame:
    """The events that have unknown fields, as rows of the dynamic table."""
    number = lambda c: F.coalesce(F.get_json_object("image", f"$.{c}").try_cast("int"), F.lit(0)).alias(c.lower())
    return unknown.select(number("ORDER_ID"), number("CUSTOMER_ID"), F.to_json("extra").alias("data"), F.col("table_name").alias("source_table"), F.col("op").alias("operation"), F.timestamp_millis("ts_ms").alias("event_timestamp"))


def row_schema(table: str) -> T.StructType:
    """The columns of a source table's events."""
    return T.StructType.fromDDL(TABLES[table] + ", _cdc_op STRING, _cdc_ts_ms BIGINT, _cdc_table STRING, _cdc_scn BIGINT, _cdc_image STRING")


def with_promoted(events: DataFrame, columns: list[Mapped]) -> DataFrame:
    """events with promoted columns, read from the image as text that fits their types or null."""
    return events.withColumns({m.source: F.get_json_object("_cdc_image", f"$.{m.source}").try_cast(m.type) for m in columns if m.source not in events.columns})


def detected(events: DataFrame, table: str) -> DataFrame:
    """types_of for the events of one table."""
    own = events.select(F.lit(table).alias("table_name"), F.col("_cdc_ts_ms").alias("ts_ms"), F.col("_cdc_scn").alias("scn"), F.col("_cdc_image").alias("image"))
    more = F.size(F.array_except(F.json_object_keys("image"), F.array(*map(F.lit, known(table))))) > 0
    extra = F.map_filter(F.from_json("image", "map<string,variant>"), lambda k, _: ~k.isin(known(table)))
    return types_of(own.filter(more).withColumn("extra", extra))


def register(registry: DataFrame, found: DataFrame) -> DataFrame:
    """The rows to append to the registry: those that are not there yet, inactive."""
    fresh = found.dropDuplicates(["table_name", "column_name"]).join(registry.select("table_name", "column_name"), ["table_name", "column_name"], "left_anti")
    return fresh.withColumn("is_active", F.lit(False))


def pending(registry: DataFrame) -> DataFrame:
    return registry.filter("NOT is_active").orderBy("table_name", "column_name")


def extras(table: str, image: str = "_cdc_image") -> Column:
    """The fields outside the baseline as a JSON object; null if there are none."""
    extra = F.map_filter(F.from_json(image, "map<string,variant>"), lambda k, _: ~k.isin(known(table)))
    return let(extra, lambda m: F.when(F.size(m) > 0, F.to_json(m)))


def normalized(events: DataFrame, table: str) -> DataFrame:
    """The baseline columns (null if missing) and extra_fields: known columns typed, all others kept."""
    return events.select(*known(table), "_cdc_op", "_cdc_ts_ms", extras(table).alias("extra_fields"))


def dynamic_rows(events: DataFrame, table: str) -> DataFrame:
    """The events that have extra fields, for the dynamic table; a missing order or customer id is 0."""
    number = lambda c: F.coalesce(F.get_json_object("_cdc_image", f"$.{c}").try_cast("int"), F.lit(0)).alias(c.lower())
    out = events.withColumn("data", extras(table)).filter("data IS NOT NULL")
    return out.select(number("ORDER_ID"), number("CUSTOMER_ID"), "data", F.lit(table).alias("source_table"), F.col("_cdc_op").alias("operation"), F.timestamp_millis("_cdc_ts_ms").alias("event_timestamp"))


def with_columns(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """df with the wanted columns that it lacks, as typed nulls."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in wanted if f.name not in df.columns})


def struct_of(table: str, registry_rows: list | None = None) -> T.StructType:
    """The sorted struct of a table: the baseline and the registered columns."""
    more = [T.StructField(r["column_name"], T.StringType()) for r in registry_rows or [] if r["column_name"] not in known(table)]
    return T.StructType(sorted([*schema(table), *more], key=lambda f: f.name))


def target_type(column: str = "column_type") -> Column:
    """A registered type as the type of a target column."""
    c = F.col(column)
    plain = F.when(c == "NUMBER(1)", "BOOLEAN").when(c == "NUMBER(10)", "INT").when(c == "NUMBER(19)", "BIGINT").when(c == "TIMESTAMP", "TIMESTAMP")
    return plain.when(c.rlike(r"^NUMBER\("), F.regexp_replace(c, "^NUMBER", "DECIMAL")).otherwise("STRING")


def promote(registry: DataFrame, table: str, target: str) -> DataFrame:
    """The registry with the pending columns of a table active: target column in small letters, target type by target_type."""
    own = ~F.col("is_active") & (F.col("table_name") == table)
    return registry.withColumns({
        "target_table": F.when(own, target).otherwise(F.col("target_table")), "target_column": F.when(own, F.lower("column_name")).otherwise(F.col("target_column")),
        "target_type": F.when(own, target_type()).otherwise(F.col("target_type")), "is_active": F.col("is_active") | own,
    })


def backfill(target: DataFrame, dynamic: DataFrame, key: str, column: str, source: str, kind: str) -> DataFrame:
    """target with `column`, taken where it is null from the JSON of the key's latest dynamic row that has the source field."""
    have = target if column in target.columns else target.withColumn(column, F.lit(None).cast(kind))
    value = F.try_variant_get(F.try_parse_json("data"), f"$.{source}", kind)
    found = dynamic.select(F.col(key), "event_timestamp", value.alias("_value")).filter(F.get_json_object("data", f"$.{source}").isNotNull())
    latest = latest_by_key(found, [key], ("event_timestamp", "_value")).select(key, "_value")
    return have.join(latest, key, "left").withColumn(column, F.coalesce(column, "_value")).drop("_value")


def promoted_since(registry: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    return registry.filter(F.col("promoted_at") >= as_of - F.expr(f"INTERVAL {hours} HOUR")).orderBy(F.desc("promoted_at"))


def json_lookup(dynamic: DataFrame, key: str) -> DataFrame:
    """The dynamic rows that have a key, with its value as text."""
    return dynamic.withColumn("value", F.get_json_object("data", f"$.{key}")).filter("value IS NOT NULL")


def as_map(events: DataFrame, image: str = "_cdc_image") -> DataFrame:
    return events.withColumn("fields", F.from_json(image, "map<string,string>"))
