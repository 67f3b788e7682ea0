"""Spans of regular-expression matches as native columns: arrays of (kind, first, last) in code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.llm.common import let

SPAN = "array<struct<start:bigint,order:int,end:bigint,kind:string>>"
_BLOCK = 256


def running_sums(numbers: Column) -> Column:
    """Running sums of an array of longs: sums of blocks first, so the work grows little over the array's length."""
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def of(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda b: add(F.slice(xs, b * _BLOCK + 1, _BLOCK)))
        before = lambda bs: F.transform(F.sequence(F.lit(0), F.size(bs) - 1), lambda b: add(F.slice(bs, F.lit(1), b)))
        at = lambda i: F.floor(i / _BLOCK).cast("int")
        return let(let(blocks, before), lambda base: F.transform(xs, lambda _, i: base[at(i)] + add(F.slice(xs, at(i) * _BLOCK + 1, i - at(i) * _BLOCK + 1))))

    return let(numbers, lambda xs: F.when(F.size(xs) > 0, of(xs)).otherwise(F.array().cast("array<bigint>")))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Each match of a pattern that never matches nothing, left to right: structs (start, end, value, piece).

    value is the group's text, piece what stands between the match before and this one. Lengths of the pieces that
    split() leaves and of the matches give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(pieces: Column, found: Column, values: Column) -> Column:
        ends = running_sums(F.transform(found, lambda m, i: (F.length(m) + F.length(pieces[i])).cast("long")))
        return let(ends, lambda e: F.transform(found, lambda m, i: F.struct((e[i] - F.length(m)).alias("start"), e[i].alias("end"), values[i].alias("value"), pieces[i].alias("piece"))))

    return let(F.split(text, pattern, -1), lambda p: let(whole, lambda m: let(value, lambda v: placed(p, m, v))))


def spans(text: Column, kind: str, order: int, pattern: str, group: int = 0, keep=None) -> Column:
    """The spans of a kind: matches of the pattern whose value (the group) passes keep."""
    found = matches(text, pattern, group)
    if keep is not None:
        found = F.filter(found, lambda m: keep(m["value"]))
    return F.when(text.rlike(pattern), F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")))).otherwise(F.array().cast(SPAN))


def joined(found: Column, by_kind: bool = False) -> Column:
    """kind:start:end of each span by start, then kind (by_kind: by kind, then start), comma-joined."""
    if by_kind:
        found = F.transform(F.array_sort(F.transform(found, lambda s: F.struct(s["order"].alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["start"], s["order"], s["end"], s["kind"]))
    else:
        found = F.array_sort(found)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
