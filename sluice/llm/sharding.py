"""Operator 6: shards by vector bin packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import n_words, written

DIMENSIONS = ("size", "tokens", "rows")


def pack(loads: np.ndarray, left: np.ndarray, spare: float | None = None) -> np.ndarray:
    """The shard of each load vector: largest first, each where the dot product with what is left is highest.

    loads and left are shares of the whole by dimension; left is taken from as loads are placed. With spare a load goes only
    where no dimension falls under -spare, and to -1 where there is no such shard.
    """
    where = np.full(len(loads), -1)
    for i in np.lexsort((np.arange(len(loads)), -loads.max(axis=1, initial=0))):
        fit = left @ loads[i]
        if spare is not None:
            fit = np.where((left - loads[i] >= -spare).all(axis=1), fit, -np.inf)
        k = int(np.argmax(fit))
        if fit[k] > -np.inf:
            where[i] = k
            left[k] -= loads[i]
    return where


def shard(docs: DataFrame, shards: int = 16, pieces_per_shard: int = 8, cells: int = 8192, slot_rows: int = 65_536, spare: float = 0.01) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, shard, slot) of each document.

    size is the text's UTF-8 bytes and 1, tokens its words; a null text has neither. Documents of one text form a group.
    Heavy groups, with over 1 / (shards * pieces_per_shard) of the bytes, tokens or rows, are packed first, each as a whole, where the dot
    product with what is left of a shard's share is highest; there are at most 3 * shards * pieces_per_shard of them. Only a group
    that fits in no shard (to `spare` of a shard's share) is cut, into pieces of about the heavy bound by a hash of doc_id.
    The light groups go whole into one of `cells` cells by their hash; cells and pieces, which these parameters bound at any
    size of the table, fill what the heavy groups leave. So sums of the shards differ by about a cell or a piece. Slots
    number a shard's rows from 0 by (hash bucket, doc_id): counts of buckets give each bucket its first slot, so no task
    sorts a whole shard. There are as many buckets as a shard has slot_rows rows on average (256 at least), dealt by the hash of
    doc_id and text. Rows alike in all share what they get in any order. An empty table gives no rows; extra columns don't matter.
    """
    spark, heavy_from = docs.sparkSession, shards * pieces_per_shard
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + F.lit(1)).cast("long")
    base = written(docs.select("doc_id", size.alias("size"), n_words(F.col("text")).alias("tokens"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("text_md5")))
    sums = [F.sum("size"), F.sum("tokens"), F.count("*")]
    total = np.array([max(1.0, float(t or 0)) for t in base.agg(*sums).first()])
    slot_buckets = max(256, -(-int(total[2]) // (shards * slot_rows)))
    base = base.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_md5"), F.lit(slot_buckets)).cast("int"))
    share = F.greatest(*[s / F.lit(float(t)) for s, t in zip(sums, total)])
    heavy = base.groupBy("text_md5").agg(*sums, share.alias("share")).filter(F.col("share") * heavy_from > 1).orderBy("text_md5").collect()
    left = np.full((shards, len(DIMENSIONS)), 1 / shards)
    loads = np.array([tuple(r)[1:4] for r in heavy], float).reshape(-1, 3) / total
    where = pack(loads, left, spare / shards)
    # (text_md5, pieces, shard): pieces of the groups to cut, the shard of the others; 3 * heavy_from rows at most
    groups = [(r["text_md5"], int(np.ceil(r["share"] * heavy_from)) if k < 0 else None, None if k < 0 else int(k)) for r, k in zip(heavy, where)]
    known = spark.createDataFrame(groups, "text_md5 string, pieces int, whole int")
    cell = F.pmod(F.xxhash64("text_md5"), F.lit(cells)).cast("string")
    piece = F.concat_ws("/", "text_md5", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("pieces")).cast("string"))
    base = base.join(F.broadcast(known), "text_md5", "left")
    base = base.withColumn("unit", F.when(F.col("pieces").isNotNull(), piece).when(F.col("whole").isNull(), cell))
    light = base.filter("unit IS NOT NULL").groupBy("unit").agg(*sums).orderBy("unit").collect()  # cells and pieces
    put = pack(np.array([tuple(r)[1:] for r in light], float).reshape(-1, 3) / total, left)
    placed = spark.createDataFrame([(r[0], int(k)) for r, k in zip(light, put)], "unit string, placed int")
    base = base.join(F.broadcast(placed), "unit", "left").withColumn("shard", F.coalesce("whole", "placed"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = base.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_md5"))
    # firsts has shards * slot_buckets rows at most: the optimizer broadcasts it while that is small
    out = base.join(F.broadcast(firsts) if slot_buckets <= 4096 else firsts, ["shard", "bucket"])
    return out.select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("first") + rank - 1).cast("long").alias("slot"))
