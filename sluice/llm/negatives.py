"""Operator 11: hard negatives by threshold joins of anchors with an inverted index of vectors.

Dimensions stand in falling order of their energy. For a threshold a row's trailing dimensions are left out of the index
as long as the norm of what is left out, times the greatest such norm of any anchor, stays below it: without an indexed
part such a row can't reach the threshold. Partial scores grow over the indexed dimensions; a pair is dropped once its
partial score plus the product of both remaining norms is below the anchor's threshold; what is left is completed from the
rows. Thresholds start high and are lowered for the anchors whose windows are not full yet, down to the windows' ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import written

#: Shares of the greatest possible score, and of a positive's score, at which the thresholds start; None: the window's end.
FIRST, NEXT = (0.5, 0.3, 0.15, None), (0.93, None)
_FOUND = "anchor_id long, anchor_key long, window int, score long, vec_id long"
_BLOCK, _ANCHORS, _PARTS = 2_048, 256, 8
_SLACK = 1e-6


def scaled(rows: DataFrame, by: float = 256.0, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, q) with q the floors of the components times `by`, for the rows that take part.

    A row takes no part if its vec_id, label or vector is null or any component is null or not finite.
    """
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    fit = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & finite)
    q = F.transform(vector, lambda x: F.floor(x.cast("double") * by))
    return fit.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))


class _Shape(NamedTuple):
    """order: the dimensions by falling energy; longest: the greatest norm of a row."""

    order: list[int]
    longest: float


def _shape(rows: DataFrame) -> _Shape:
    squares = lambda q: F.aggregate(q, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest = rows.agg(F.max(squares(F.col("q")))).first()[0] or 0.0
    if longest >= 2**53:
        raise ValueError("scores of these vectors do not fit in 53 bits")
    energy = rows.select(F.posexplode("q").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("e"))
    e = {r["i"]: r["e"] for r in energy.collect()}  # one row a dimension
    return _Shape(sorted(e, key=lambda i: (-e[i], i)), longest**0.5)


def _matrix(q: pa.Array, order: list[int]) -> np.ndarray:
    """Vectors of an array of lists, dimensions in the given order; a shorter vector ends in zeros."""
    ends = q.offsets.to_numpy().astype(np.int64)
    sizes, flat = np.diff(ends), q.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.float64)
    out = np.zeros((len(q), max(len(order), 1)))
    out[np.repeat(np.arange(len(q)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out[:, order] if order else out


class _Side(NamedTuple):
    """Vectors, and the norms of what is left of them from each part of the dimensions on."""

    x: np.ndarray
    rest: np.ndarray
    cuts: np.ndarray

    def of(self, at) -> _Side:
        return _Side(self.x[at], self.rest[at], self.cuts)


def _side(x: np.ndarray) -> _Side:
    d = x.shape[1]
    cuts = np.unique(np.linspace(0, d, min(_PARTS, d) + 1).astype(int))
    left = np.zeros((len(x), len(cuts)))
    for k in range(len(cuts) - 2, -1, -1):
        part = x[:, cuts[k] : cuts[k + 1]]
        left[:, k] = left[:, k + 1] + np.einsum("ij,ij->i", part, part)
    return _Side(x, np.sqrt(left) * (1 + 1e-12), cuts)  # rounding never makes a bound too low


def pairs_above(rows: _Side, anchors: _Side, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of all pairs whose inner product is at least the anchor's threshold."""
    cuts, parts = rows.cuts, len(rows.cuts) - 1
    lowest = least.min() - _SLACK
    # the index: a row's parts up to the first from which the suffix norms cover the rest
    covered = rows.rest * anchors.rest.max(0) < lowest
    indexed = np.where(covered.any(1), covered.argmax(1), parts)
    at = np.argsort(-indexed, kind="stable")
    at = at[indexed[at] > 0] if lowest > 0 else at
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    rows, indexed = rows.of(at), indexed[at]
    partial = np.zeros((len(at), len(least)))
    k = 0
    for k in range(parts):
        n = int(np.searchsorted(-indexed, -k, "left"))  # the posting list of this part
        if not n:
            break
        partial[:n] += rows.x[:n, cuts[k] : cuts[k + 1]] @ anchors.x[:, cuts[k] : cuts[k + 1]].T
        if k % 2 and k + 1 < parts and _alive(rows, anchors, partial, np.minimum(indexed, k + 1), least).mean() < 0.1:
            break
    done = np.minimum(indexed, k + 1)
    r, a = np.nonzero(_alive(rows, anchors, partial, done, least))
    score, start = partial[r, a], done[r]
    for k in range(int(start.min()) if len(start) else parts, parts):
        now = start <= k
        part = slice(cuts[k], cuts[k + 1])
        for i in np.array_split(np.flatnonzero(now), len(r) // 65_536 + 1):
            score[i] += np.einsum("ij,ij->i", rows.x[r[i], part], anchors.x[a[i], part])
        stay = ~now | (score + rows.rest[r, k + 1] * anchors.rest[a, k + 1] >= least[a] - _SLACK)
        r, a, score, start = r[stay], a[stay], score[stay], start[stay]
    score = np.rint(score)
    hit = score >= least[a]
    return at[r[hit]], a[hit], score[hit]


def _alive(rows: _Side, anchors: _Side, partial: np.ndarray, done: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which pairs can still reach their thresholds, by the norms of what is not summed yet."""
    alive = np.empty(partial.shape, bool)
    for k in np.unique(done):
        i = done == k
        alive[i] = partial[i] + np.outer(rows.rest[i, k], anchors.rest[:, k]) >= least - _SLACK
    return alive


class _Best:
    """The best `n` rows of each anchor's windows so far: score, then vec_id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, n: int):
        self.low, self.high, self.n = low.astype(np.float64), high.astype(np.float64), n
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def least(self) -> np.ndarray:
        """Each anchor's threshold: no window takes less."""
        return self.low.min(1)

    def add(self, a: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        windows = self.low.shape[1]
        slots, scores, names = [self.slot], [self.score], [self.id]
        for w in range(windows):
            fits = (score >= self.low[a, w]) & (score <= self.high[a, w])
            slots.append(a[fits] * windows + w)
            scores.append(score[fits])
            names.append(ids[fits])
        slot, score, ids = np.concatenate(slots), np.concatenate(scores), np.concatenate(names)
        by = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[by], score[by], ids[by]
        first = np.searchsorted(slot, slot, "left")
        rank = np.arange(len(slot)) - first
        full = rank == self.n - 1
        self.low.reshape(-1)[slot[full]] = score[full]  # a full window takes nothing below its last row
        keep = rank < self.n
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]


class _Scan:
    """Over the rows of a task: the best rows of each window of some anchors, of the anchor's label or of others."""

    def __init__(self, anchors: pa.Table, shape: _Shape, n: int, same: bool):
        self.anchors, self.shape, self.n, self.same = anchors, shape, n, same

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = self.anchors.combine_chunks()
        ids, keys, labels = (t[c].to_numpy() for c in ("vec_id", "key", "label"))
        whole = lambda c: np.array(t[c].to_pylist(), np.float64).reshape(t.num_rows, -1)
        best = [_Best(whole("low")[i : i + _ANCHORS], whole("high")[i : i + _ANCHORS], self.n) for i in range(0, t.num_rows, _ANCHORS)]
        side = _side(_matrix(t["q"].combine_chunks() if t["q"].num_chunks != 1 else t["q"].chunk(0), self.shape.order))
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                rows = _side(_matrix(part["q"], self.shape.order))
                row_ids, row_keys, row_labels = (part[c].to_numpy() for c in ("vec_id", "key", "label"))
                for i, b in enumerate(best):
                    own = slice(i * _ANCHORS, (i + 1) * _ANCHORS)
                    r, a, score = pairs_above(rows, side.of(own), b.least())
                    fits = (row_labels[r] == labels[own][a]) == self.same
                    fits &= (row_keys[r] != keys[own][a]) | (row_ids[r] != ids[own][a])
                    b.add(a[fits], score[fits], row_ids[r[fits]])
        for i, b in enumerate(best):
            windows = b.low.shape[1]
            a = b.slot // windows + i * _ANCHORS
            out = [ids[a], keys[a], (b.slot % windows).astype(np.int32), b.score.astype(np.int64), b.id]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["anchor_id", "anchor_key", "window", "score", "vec_id"])


def _best(found: DataFrame, n: int) -> DataFrame:
    by = Window.partitionBy("anchor_id", "anchor_key", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def _scan(rows: DataFrame, anchors: DataFrame, shape: _Shape, n: int, same: bool, most_anchors: int) -> DataFrame:
    """The best n rows of each window (low, high) of the anchors, over all rows; a stated number of anchors at a time goes to the tasks."""
    times = -(-anchors.count() // most_anchors)
    found = [rows.sparkSession.createDataFrame([], _FOUND)]
    for i in range(times):
        group = anchors.filter(F.pmod(F.xxhash64("key"), F.lit(times)) == i) if times > 1 else anchors
        found.append(written(rows.mapInArrow(_Scan(group.select("vec_id", "key", "label", "q", "low", "high").toArrow(), shape, n, same), _FOUND)))
    return written(_best(reduce(DataFrame.unionByName, found), n))


def _to_end(share: float | None, of: Column, end: Column) -> Column:
    return end if share is None else F.greatest(F.ceil(of * share), end)


def mine(
    rows: DataFrame, is_anchor: Column | str, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100, most_anchors: int = 8_192
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, q: array of long).

    Scores are inner products; higher ones come first, ties by smaller vec_id. An anchor's positives are its first other rows
    of its label; for each of them the first rows of other labels between the two percentages of its score are returned, rank
    from 1. Null ids, labels and vectors must be gone (`scaled`). Rows alike in everything count once; rows that share a
    vec_id but differ are rows of their own. A shorter vector counts as ending in zeros. Extra columns don't matter; an empty
    table, or one without anchors, gives no rows. ValueError if a score might need more than 53 bits.

    Up to most_anchors anchors at a time are sent to all tasks: the rows are read once for each such group.
    """
    # identical rows merge before they are dealt, so a repeated row is no hot key
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("q").cast("array<bigint>").alias("q")).distinct()
    rows = written(rows.withColumn("key", F.xxhash64("vec_id", "label", "q")))
    shape = _shape(rows)
    anchors = written(rows.filter(is_anchor))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    names = {"vec_id": "anchor_id", "key": "anchor_key"}

    todo, done = anchors, []
    for share in FIRST:
        low = F.lit(float("-inf")) if share is None else F.ceil(norm * shape.longest * share).cast("double")
        best = _scan(rows, todo.withColumns({"low": F.array(low), "high": F.array(F.lit(float("inf")))}), shape, positives, True, most_anchors)
        full = best.groupBy("anchor_id", "anchor_key").agg(F.count("*").alias("n")).filter((F.col("n") >= positives) | F.lit(share is None))
        done.append(best.join(full.drop("n"), ["anchor_id", "anchor_key"], "left_semi"))
        if share is None:
            break
        todo = written(todo.join(full.withColumnsRenamed({v: k for k, v in names.items()}), ["vec_id", "key"], "left_anti"))
        if todo.isEmpty():
            break
    first = reduce(DataFrame.unionByName, done).select("anchor_id", "anchor_key", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    first = written(first)

    # the windows of an anchor, one for each of its few positives; those that can hold nothing are left out
    end, top = F.ceil(F.col("positive_score") * low_percent / 100), F.floor(F.col("positive_score") * high_percent / 100)
    todo = first.withColumns({"end": end, "top": top}).filter("end <= top")
    done = []
    for share in NEXT:
        low = _to_end(share, F.col("top"), F.col("end")).cast("double")
        windows = todo.groupBy("anchor_id", "anchor_key").agg(F.map_from_entries(F.collect_list(F.struct("nth", F.struct(low.alias("low"), F.col("top").cast("double").alias("high"))))).alias("w"))  # as many as positives
        bound = lambda c, none: F.array(*[F.coalesce(F.try_element_at("w", F.lit(i + 1))[c], F.lit(none)) for i in range(positives)])  # noqa: E731, B023
        asked = windows.withColumns({"low": bound("low", float("inf")), "high": bound("high", float("-inf"))}).withColumnsRenamed({v: k for k, v in names.items()})
        best = _scan(rows, written(anchors.join(asked.drop("w"), ["vec_id", "key"])), shape, negatives, False, most_anchors)
        best = best.withColumn("nth", F.col("window") + 1)
        key = ["anchor_id", "anchor_key", "nth"]
        full = best.groupBy(*key).agg(F.count("*").alias("n")).filter((F.col("n") >= negatives) | F.lit(share is None)).drop("n")
        done.append(best.join(full, key, "left_semi").select(*key, "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))
        if share is None:
            break
        todo = written(todo.join(full, key, "left_anti"))
        if todo.isEmpty():
            break
    out = reduce(DataFrame.unionByName, done).join(first, ["anchor_id", "anchor_key", "nth"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
