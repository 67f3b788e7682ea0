"""Operator 9: document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import mix

PRIME = 2**31 - 1
BASES = (1_000_003_579, 1_999_999_943)
WINDOW = 8  # code points; a shorter text is one window
BINS = 128
_EMPTY = np.uint64(2**64 - 1)
_tables: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    """Powers of base modulo PRIME, n at least."""
    have = _tables.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), PRIME)) % np.uint64(PRIME)])
    _tables[base] = have
    return have


def codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefixes:
    """Modular prefix arrays of a text's code points: any span's hash takes O(1)."""

    def __init__(self, text: np.ndarray, known: Prefixes | None = None, same: int = 0):
        """known: of a text that has the first `same` code points in common."""
        self.n, p = len(text), np.uint64(PRIME)
        self.sums = []
        for k, base in enumerate(BASES):
            head = known.sums[k][: same + 1] if known is not None else np.zeros(1, np.uint64)
            at = len(head) - 1
            terms = (text[at:].astype(np.uint64) + np.uint64(1)) * _table(base, self.n + 1)[at : self.n] % p
            self.sums.append(np.concatenate([head, (np.cumsum(terms) + head[-1]) % p]))

    def spans(self, start: np.ndarray | int, size: int) -> np.ndarray:
        """62-bit hashes of the spans of `size` code points from each start: equal spans, equal hashes, in any text."""
        p, out = np.uint64(PRIME), None
        for sums, base in zip(self.sums, BASES):
            back = _table(pow(base, -1, PRIME), self.n + 1)
            if isinstance(start, slice):
                here = (sums[start.start + size : start.stop + size] + p - sums[start]) * back[start] % p
            else:
                here = (sums[start + size] + p - sums[start]) * back[start] % p
            out = here if out is None else (out << np.uint64(31)) | here
        return out

    def same(self, i: int, other: Prefixes, j: int, size: int) -> bool:
        return size == 0 or bool(self.spans(i, size) == other.spans(j, size))

    def common(self, i: int, other: Prefixes, j: int) -> int:
        """The longest common extension from i here and from j in other, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same(i, other, j, mid) else (low, mid - 1)
        return low


def bins(prefixes: Prefixes, first: int, last: int) -> np.ndarray:
    """The least hash in each of BINS classes over the windows that start in first..last-1; _EMPTY where there is none."""
    out = np.full(BINS, _EMPTY)
    if last > first:
        h = np.sort(mix(prefixes.spans(slice(first, last), window(prefixes.n))))
        edge = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
        at = np.searchsorted(h, edge)
        ok = at < len(h)
        found = h[at[ok]]
        out[np.flatnonzero(ok)] = np.where(found >> np.uint64(57) == edge[ok] >> np.uint64(57), found, _EMPTY)
    return out


#: For each class the order in which it asks the classes for a window, itself first: fixed, so alike in all texts.
_ASKED = np.argsort(mix(np.arange(BINS * BINS, dtype=np.uint64).reshape(BINS, BINS) + np.uint64(1)), axis=1)
_ASKED = np.array([[i, *(row[row != i])] for i, row in enumerate(_ASKED)])


def sketch(least: np.ndarray) -> str:
    """Two hex digits for each class; an empty class takes the least hash of the first full one that it asks. Empty for no windows.

    Two texts agree in a class about as often as they share windows, however few they have.
    """
    full = least != _EMPTY
    if not full.any():
        return ""
    source = _ASKED[np.arange(BINS), full[_ASKED].argmax(1)]
    return (mix(least[source] + np.arange(BINS, dtype=np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """From 0 to 1, about the share of windows that two texts have in common; empty texts are like each other only."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    equal = sum(p == q for p, q in zip(x, y)) / len(x)
    return max(0.0, (equal - 1 / 256) / (1 - 1 / 256))


def window(n: int) -> int:
    return max(1, min(n, WINDOW))


def n_windows(n: int) -> int:
    return n - window(n) + 1 if n else 0


def fingerprint(text: str | None) -> str:
    c = codes(text)
    return sketch(bins(Prefixes(c), 0, n_windows(len(c))))


def _row(doc_id, text: np.ndarray, following: np.ndarray, following_print: str, own: tuple[Prefixes, np.ndarray, str]) -> tuple:
    n = len(text)
    keep = n - n // 4
    edited = np.concatenate([text[:keep], following[: n // 4]])
    prefixes, head, print_ = own
    other = Prefixes(edited, prefixes, keep)
    if window(n) == window(len(edited)):
        least = np.minimum(head, bins(other, max(0, keep - window(n) + 1), n_windows(len(edited))))
    else:
        least = bins(other, 0, n_windows(len(edited)))
    edited_print = sketch(least)
    raw = edited.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return doc_id, n, hashlib.sha256(raw).hexdigest(), print_, edited_print, likeness(print_, edited_print), likeness(print_, following_print), prefixes.common(0, other, 0)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_start long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_start", pa.int64())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each block ending with the row that follows it (head): compares each row with the next."""
    before, done = None, []
    for batch in batches:
        for doc_id, text, head in zip(*(batch.column(c) for c in ("doc_id", "text", "head"))):
            c = codes(text.as_py())
            n, p = len(c), Prefixes(c)
            cut = max(0, n - n // 4 - window(n) + 1)  # windows from here on reach into the last quarter
            first = bins(p, 0, min(cut, n_windows(n)))
            print_ = sketch(np.minimum(first, bins(p, cut, n_windows(n))))
            if before is not None:
                done.append(_row(before[0], before[1], c, print_, before[2]))
            before = None if head.as_py() else (doc_id.as_py(), c, (p, first, print_))
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), _ARROW)], schema=_ARROW)
                done = []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), _ARROW)], schema=_ARROW)


def fingerprints(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Each document's fingerprint, and its likeness to an edited copy and to the next document by doc_id.

    The edited copy has its last quarter replaced by the start of the next document; the last document's next is the
    first. common_start is the longest common extension of text and copy from their starts. Documents are dealt into
    blocks of neighbouring ids by approximate quantiles; each block also gets the first row of the next block, so one
    shuffle of the texts is enough and no order over the whole table is needed. A null text is empty; a null doc_id sorts
    first; rows with one doc_id sort by text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select(F.col("doc_id").cast("double").alias("id"))
    cuts = sorted({x for x in ids.approxQuantile("id", [i / blocks for i in range(1, blocks)], 0.2 / blocks)}) if blocks > 1 else []
    cuts = [-float("inf"), *(cuts or [0.0]), float("inf")]
    dealt = Bucketizer(splits=cuts, inputCol="id", outputCol="b", handleInvalid="keep").transform
    block = lambda df: dealt(df.withColumn("id", F.coalesce(F.col("doc_id").cast("double"), F.lit(-float("inf"))))).withColumn("block", F.col("b").cast("int")).drop("id", "b")
    # the first row of each block: as many rows as there are blocks
    firsts = block(rows.select("doc_id")).groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("m")).select("block", F.col("m.doc_id").alias("doc_id")).orderBy("block").collect()
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    before = {r["block"]: firsts[i - 1]["block"] for i, r in enumerate(firsts)}
    known = [r["doc_id"] for r in firsts if r["doc_id"] is not None]
    heads = block(rows.filter(F.col("doc_id").isin(known) | F.col("doc_id").isNull() & F.lit(len(known) < len(firsts))))
    heads = heads.withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "text"))).filter("k = 1").drop("k")
    heads = heads.withColumn("block", F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("block")])
    both = block(rows).withColumn("head", F.lit(False)).unionByName(heads.withColumn("head", F.lit(True)))
    both = both.repartition(max(1, blocks // 4), "block").sortWithinPartitions("block", "head", F.col("doc_id").asc_nulls_first(), "text")
    return both.mapInArrow(_pairs, SCHEMA)
