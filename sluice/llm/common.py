"""What the document operators share: shared folders, words in the JVM, and words in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import sluice
from sluice.functions.columns import let
from sluice.functions.folders import shared_folder, written

__all__ = ["SPACE", "WORD", "Words", "bounded_batches", "documents", "find_words", "let", "mix", "n_words", "parts", "shared_folder", "span_hashes", "words", "written"]

# Workers may run in a folder where this package can't be imported: send its functions whole.
cloudpickle.register_pickle_by_value(sluice)

#: White space and words, as Java regular expressions.
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def bounded_batches(spark: SparkSession, most: str = "4m") -> Iterator[None]:
    """Within it, jobs send Arrow batches that are bounded by bytes, not by rows alone; the session's own setting comes back after."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, most)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


class Words(NamedTuple):
    """Words of a batch of texts: the text each is in, its 64-bit hash, its place in buf."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    buf: np.ndarray


_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_STEP = 65_536  # codes that are summed at once
_tables: dict[tuple[int, int], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit of the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base (k=0) or of its inverse modulo 2^64 (k=1): the first _STEP, and each _STEP-th of the first n."""
    base = _BASE if k == 0 else pow(_BASE, -1, 2**64)
    out = []
    for step, many in ((1, _STEP), (_STEP, n // _STEP + 1)):
        have = _tables.get((k, step))
        if have is None or len(have) < many:
            factors = np.full(2 * many, pow(base, step, 2**64), np.uint64)
            factors[0] = 1
            have = _tables[k, step] = np.multiply.accumulate(factors)
        out.append(have)
    return out[0], out[1]


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end], wherever the spans lie: equal spans have equal hashes.

    Beside the codes it holds 8 bytes a code, in whatever length.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    low, high = _powers(0, len(codes))
    prefix = np.zeros(len(codes) + 1, np.uint64)
    for i, at in enumerate(range(0, len(codes), _STEP)):
        block = codes[at : at + _STEP].astype(np.uint64)
        block += np.uint64(1)
        block *= low[: len(block)]
        prefix[at + 1 : at + 1 + len(block)] = np.cumsum(block) * high[i] + prefix[at]
    low, high = _powers(1, len(codes))
    return mix((prefix[end] - prefix[start]) * (high[start // _STEP] * low[start % _STEP]) + (end - start).astype(np.uint64) * _MULT)


def find_words(texts: pa.Array, lower: bool = True) -> Words:
    """Words of a string array, letters A-Z made lower; a null has none. Words never cross texts."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if lower:
        buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.zeros(len(buf) + 1, bool)
    edge[ends] = True
    first = inside & edge[:-1]
    first[1:] |= inside[1:] & ~inside[:-1]
    last = inside & edge[1:]
    last[:-1] |= inside[:-1] & ~inside[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(np.searchsorted(ends, start, "right") - 1, span_hashes(buf, start, end), start, end, buf)


def parts(batch: pa.RecordBatch, column: str, most: int = 2_000_000):
    """Slices of a batch with about `most` bytes of text each, so that memory is bounded by that or one text."""
    texts = batch.column(column)
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
