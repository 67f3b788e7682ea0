"""Columns that are computed once, however often they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is not inlined again, an expression is."""
    return F.transform(F.array(value), body)[0]


def spread(df: DataFrame, fields: Column) -> DataFrame:
    """df with the fields of a struct as columns. A generator makes them, so filters on them stay above it and the struct is
    computed once a row; outer, since for others the optimizer adds a filter that computes it again."""
    return df.select("*", F.inline_outer(F.array(fields)))
