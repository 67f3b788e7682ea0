"""Lookups, pages, retention and latest views over target tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.dedup import latest_by_key


def latest(target: DataFrame, key: str, ts: str = "source_ts", tie: str | None = None) -> DataFrame:
    """The latest row of each key, rows without a time last. An aggregation, so a hot key sends one row a task."""
    return latest_by_key(target, [key], (ts, *([tie] if tie else [])))


def newest(target: DataFrame, n: int, ts: str, tie: str) -> DataFrame:
    """The newest n rows: a top-n, without a sort of the whole table."""
    return target.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def page(target: DataFrame, order: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """A page in a total order; at most 1000 rows."""
    return target.orderBy(*order).offset(offset).limit(min(limit, 1000))


def lookup(target: DataFrame, column: str, value, order: list[str], limit: int = 100) -> DataFrame:
    return target.filter(F.col(column) == F.lit(value)).orderBy(*order).limit(limit)


def alive(target: DataFrame, as_of: Column, seconds: int, ts: str = "stored_at") -> DataFrame:
    """Rows that are not older than their time to live."""
    return target.filter(F.col(ts) >= as_of - F.make_dt_interval(secs=F.lit(seconds)))


def retained(target: DataFrame, as_of: Column, days: int, ts: str = "processed_at") -> DataFrame:
    return target.filter(F.col(ts) >= as_of - F.make_dt_interval(days=F.lit(days)))
