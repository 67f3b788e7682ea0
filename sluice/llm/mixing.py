"""Operator 4: mix sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import n_words, written

WEIGHTS = (3, 1, 2)
DRAWS = 15  # a SHA-256 has so many 32-bit windows, 16 bits apart


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source (source, source_size, target) of rows (source, size).

    Sources in the order of their code points, null last, weigh `weights`, repeating. They share `share` times
    the whole size; no target exceeds `most` times its source's size: what is over goes to the others by weight.
    In the order of room per weight the sources that are cut come first, and the level, what is left per weight left,
    rises up to the first source that is not cut and falls after it, so running sums find it directly.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("room", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy(F.lit(0))
    earlier = every.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "left": F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("room").over(earlier), F.lit(0.0)),
        "heavy": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)),
    })
    per = per.withColumn("level", F.col("left") / F.col("heavy"))
    per = per.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("room"), F.col("level"))).over(every))
    return per.select("source", "source_size", F.least(F.col("room"), F.coalesce(F.col("level") * F.col("weight"), F.col("room"))).alias("target"))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of each row: the number of words, 0 for a null text. Null ids and sources stay, repeated rows too; an
    empty table gives no rows; extra columns don't matter."""
    return written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source (source, source_size, target, rate, draw) of rows (doc_id, source, size).

    The rate is target / size. Every document has DRAWS hash draws, windows of one SHA-256 of its id that overlap by half; a
    source uses the draw number whose sum comes nearest to its target (the first of equals), so the taken words come nearer
    than one draw would bring them, and reruns agree. A source of size 0 has target 0 and rate 0. A null source is one, after all
    others; rows that share an id draw alike; an empty table gives no sources.
    """
    targets = source_targets(sized, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = written(targets.withColumn("rate", rate))
    drawn = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("doc_id", "t.*", "size")
    sums = [F.sum(F.col("size") * _extra(j)).alias(f"s{j}") for j in range(DRAWS)]
    sums = drawn.withColumn("seed", _seed("doc_id")).groupBy("source", "source_size", "target", "rate").agg(*sums)
    taken = lambda j: F.floor("rate") * F.col("source_size") + F.col(f"s{j}")
    far = F.array(*[F.struct(F.abs(taken(j) - F.col("target")).alias("far"), F.lit(j).alias("draw")) for j in range(DRAWS)])
    return written(sums.select("source", "source_size", "target", "rate", F.array_min(far)["draw"].alias("draw")))


def _seed(doc_id: str) -> Column:
    return F.sha2(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), 256)


def _extra(j: int) -> Column:
    """Whether draw j takes a row once more than floor(rate): 0 or 1."""
    drawn = F.conv(F.substring("seed", 4 * j + 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return (drawn < F.col("rate") - F.floor("rate")).cast("long")


def _with_copies(rows: DataFrame, doc_id: str, source: str, by_source: DataFrame) -> DataFrame:
    """rows with their source's plan and copies. Each row's own id and source decide, so rows that share an id are safe."""
    out = rows.join(by_source.withColumnRenamed("source", "_of"), F.col(source).eqNullSafe(F.col("_of")))
    extra = F.element_at(F.array(*[_extra(j) for j in range(DRAWS)]), F.col("draw") + 1)
    return out.withColumn("seed", _seed(doc_id)).withColumn("copies", F.floor("rate") + extra)


def copies(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of each document.

    A document is taken floor(rate) times, and once more if its hash draw is below the fraction. Rows of one source and
    doc_id draw alike. A null text has size 0, a null source is a source, a null doc_id an id. An empty table gives no rows.
    """
    sized = sizes(docs)
    out = _with_copies(sized, "doc_id", "source", plan(sized, **how))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as copies() takes it, in the columns of docs, which may have any names.

    Rows only meet the table of sources, so no texts are shuffled. A row with rate 0 leaves; an empty table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("from"))
    taken = _with_copies(rows, "id", "from", plan(sizes(docs), **how))
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select("row.*")
