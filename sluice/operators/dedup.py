"""Latest rows by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("_cdc_ts_ms", "_cdc_scn")


def latest_by_key(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ORDER) -> DataFrame:
    """The row of each key that is greatest in `order`, nulls least; rows with a null key are dropped.

    An aggregation rather than a sort: each task keeps one row of a key, so a hot key sends few rows.
    """
    rows = rows.dropna(subset=keys)
    best = F.max_by(F.struct(*rows.columns), F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order]))
    return rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(best.alias("_row")).select("_row.*")


def last_n(rows: DataFrame, keys: list[str], n: int, order: tuple[str, ...] = ORDER, cap: int | None = None) -> DataFrame:
    """The last n rows of each key; with cap only where a key has more than that.

    Only the first ranks are asked for, so each task sends n (or cap + 1) rows of a hot key, not all.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    last = rows.withColumn("_rank", rank).filter(F.col("_rank") <= max(n, 0 if cap is None else cap + 1))
    if cap is None:
        return last.drop("_rank")
    over = F.max("_rank").over(Window.partitionBy(*keys)) > cap
    return last.withColumn("_over", over).filter(~F.col("_over") & (F.col("_rank") <= cap) | (F.col("_rank") <= n)).drop("_rank", "_over")


def stale(rows: DataFrame, keys: list[str], arrival: str, ts: str = "_cdc_ts_ms") -> DataFrame:
    """rows with is_stale: whether a row of the same key that arrived before has the same or a later ts."""
    seen = F.max(ts).over(Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("is_stale", F.coalesce(seen >= F.col(ts), F.lit(False)))
