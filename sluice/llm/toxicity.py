"""Operator 10: toxicity by multiple-instance learning over sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import mix, parts, span_hashes, written

FEATURES = 2**18
STARTS = (4, 5)  # a word's first so many bytes are features beside the word


def _sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, sentence, features by word, ends of the documents, sentence of each byte) of the words in a string array.

    Words are runs of letters, A-Z made lower; a sentence ends at . ! ? or a line's end, or with its document.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    stop = (buf == 46) | (buf == 33) | (buf == 63) | (buf == 10)
    edge = np.zeros(len(buf) + 1, bool)
    edge[ends] = True
    sentence = np.cumsum(np.concatenate([[False], stop[:-1]])[: len(buf)] | edge[: len(buf)])
    buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
    inside = ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    first = inside & edge[:-1]
    first[1:] |= inside[1:] & ~inside[:-1]
    last = inside & edge[1:]
    last[:-1] |= inside[:-1] & ~inside[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    spans = [span_hashes(buf, start, end)] + [mix(span_hashes(buf, start, np.minimum(start + k, end)) + np.uint64(k)) for k in STARTS]
    features = np.stack(spans, axis=1) % np.uint64(FEATURES)
    return np.searchsorted(ends, start, "right") - 1, sentence[start] if len(buf) else start, features.astype(np.int64), ends, sentence


def _distinct(sentence: np.ndarray, features: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of a word, feature) of the chosen features, each once in a sentence however often it is said, in order of the words."""
    rows, columns = np.nonzero(chosen)
    own = features[rows, columns].astype(np.int64)
    _, first = np.unique(sentence[rows].astype(np.int64) * FEATURES + own, return_index=True)
    first.sort()
    return rows[first], own[first]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, documents that have it) of each batch."""
    for whole in batches:
        for batch in parts(whole, "text"):
            doc, _, features, _, _ = _sentences(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            both = np.unique(np.repeat(doc, features.shape[1]) * FEATURES + features.ravel())
            kind, n = np.unique(both % FEATURES * 2 + toxic[both // FEATURES], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind // 2), pa.array(kind % 2), pa.array(n)], ["feature", "toxic", "n"])


class _Compact:
    """Texts to (toxic, number of sentences, sentence and feature number of each known feature)."""

    def __init__(self, chosen: np.ndarray):
        self.chosen = chosen

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(FEATURES, -1, np.int32)
        place[self.chosen] = np.arange(len(self.chosen))
        for whole in batches:
            for batch in parts(whole, "text"):
                doc, sentence, features, ends, sentence_at = _sentences(batch.column("text"))
                at = place[features]
                rows, own = _distinct(sentence, at, at >= 0)
                cut = np.searchsorted(doc[rows], np.arange(len(batch) + 1))
                lengths = [(sentence_at[b - 1] - sentence_at[a] + 1) if b > a else 0 for a, b in zip(ends, ends[1:])]
                s, f = sentence[rows].astype(np.int32), own.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").cast(pa.int32()), pa.array(lengths, pa.int32()), pa.array([s[a:b] for a, b in zip(cut, cut[1:])], pa.list_(pa.int32())), pa.array([f[a:b] for a, b in zip(cut, cut[1:])], pa.list_(pa.int32()))],
                    ["toxic", "sentences", "sentence", "feature"],
                )


def fit_noisy_or(rows: list, n_features: int, rounds: int = 400, step: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that make 1 - prod(1 - sigmoid(bias + weights of the sentence)) fit the labels, by Adam."""
    label = np.array([r["toxic"] for r in rows], float)
    doc, feature, inside = [], [], []
    plain, n = np.zeros(len(rows)), 0
    for i, r in enumerate(rows):
        own, at = np.unique(np.array(r["sentence"], int), return_inverse=True)
        plain[i] = r["sentences"] - len(own)
        doc += [i] * len(own)
        inside.append(at + n)
        feature.append(np.array(r["feature"], int))
        n += len(own)
    doc, inside, feature = np.array(doc, int), np.concatenate([*inside, np.zeros(0, int)]).astype(int), np.concatenate([*feature, np.zeros(0, int)]).astype(int)
    w, b = np.zeros(n_features), -5.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())) * 0.5 + 0.5 / max(1, len(label))
    for t in range(1, rounds + 1):
        z = np.bincount(inside, w[feature], n) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p0 = 1 / (1 + np.exp(-np.clip(b, -30, 30)))
        clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(rows)) + plain * np.log1p(-p0)
        whole = -np.expm1(clean)
        # d loss / d log(clean share): 1 for a clean document, -(clean / whole) for a toxic one; d log(1 - p) / dz = -p
        slope = np.where(label == 1, -np.exp(clean) / np.maximum(whole, 1e-9), 1.0) * weight
        dz = slope[doc] * p
        g = np.append(np.bincount(feature, dz[inside], n_features) + ridge * w / max(1, n_features), dz.sum() + (slope * plain * p0).sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_features: int = 4096, least_docs: int = 5, most_bytes: int = 200_000_000) -> tuple[np.ndarray, float]:
    """A weight for each of FEATURES hashed features, and the bias.

    docs (doc_id, text) and labels (doc_id, toxic) of the rows to learn from: at most most_rows of them, those whose hash of
    doc_id is least, and of these as many as have most_bytes of text. Rows that share a doc_id are one, that of the least text
    hash; it is toxic if any of its labels says so. Null ids and labels take no part, null texts are empty. Kept are the
    most_features features that stand out most in the toxic ones and occur in least_docs of them. Without toxic or without
    clean rows, as in an empty table, no weight is learnt. Extra columns don't matter.
    """
    chosen = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = written(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows))
    mine = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # chosen has most_rows rows at most
    one = mine.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    one = written(one)
    fits = written(one.select("doc_id", F.octet_length("text").alias("size")).withColumn("sum", F.sum("size").over(before)).filter(F.col("sum") <= most_bytes))
    rows = one.join(F.broadcast(fits.select("doc_id")), "doc_id", "left_semi").select("text", "toxic")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = np.zeros(FEATURES, np.float32)
    if not n.get(1) or not n.get(0):
        return none, 0.0 if n.get(1) else -30.0
    seen = rows.mapInArrow(_frequencies, "feature long, toxic long, n long").groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / F.lit(n[1] + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(n[0] + 1.0))
    top = seen.filter(F.col("bad") >= least_docs).filter(odds > 1).orderBy((odds * F.sqrt("bad")).desc(), "feature").limit(most_features).collect()
    picked = np.array([r["feature"] for r in top], int)
    compact = rows.mapInArrow(_Compact(picked), "toxic int, sentences int, sentence array<int>, feature array<int>").collect()
    w, b = fit_noisy_or(compact, len(picked))
    none[picked] = w
    return none, b


class _Score:
    def __init__(self, weights: np.ndarray, bias: float, least: float):
        self.weights, self.bias, self.least = weights, bias, least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for whole in batches:
            for batch in parts(whole, "text"):
                doc, sentence, features, ends, at = _sentences(batch.column("text"))
                rows, own = _distinct(sentence, features, self.weights[features] != 0)
                z = np.bincount(sentence[rows], self.weights[own], int(at[-1]) + 1 if len(at) else 1) + self.bias
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                clean = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
                score, bad = [], []
                for k, (a, b) in enumerate(zip(ends, ends[1:])):
                    if b == a:
                        score.append(float(1 / (1 + np.exp(-self.bias))))
                        bad.append([])
                        continue
                    score.append(float(-np.expm1(clean[at[b - 1] + 1] - clean[at[a]])))
                    found = []
                    if score[-1] >= self.least:
                        own = at[a:b]
                        point = np.cumsum((np.frombuffer(batch.column("text").slice(k, 1)[0].as_buffer(), np.uint8) & 0xC0) != 0x80)
                        for s in own[0] + np.flatnonzero(p[own[0] : own[-1] + 1] >= self.least):
                            i, j = np.searchsorted(own, s), np.searchsorted(own, s, "right")
                            found.append({"start": int(point[i]) - 1, "end": int(point[j - 1]), "score": float(p[s])})
                    bad.append(found)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(bad, spans)], ["doc_id", "score", "sentences"])


class _Clean:
    def __init__(self, scorer: _Score, limit: float):
        self.scorer, self.limit = scorer, limit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            filled = whole.set_column(whole.schema.get_field_index("text"), "text", whole.column("text").fill_null(""))
            for batch, own in zip(parts(filled, "text"), parts(whole, "text")):
                scored = next(self.scorer(iter([batch])))
                yield own.filter(pa.array(scored.column("score").to_numpy() < self.limit))


def clean(docs: DataFrame, model: tuple[np.ndarray, float], limit: float = 0.7) -> DataFrame:
    """The rows of docs whose score is under limit, as they are, repeated ones and columns of any name too. Null and empty texts score
    as one plain sentence; an empty table stays empty."""
    return docs.mapInArrow(_Clean(_Score(*model, 2.0), limit), docs.schema)


def score(docs: DataFrame, model: tuple[np.ndarray, float], least: float = 0.5) -> DataFrame:
    """(doc_id, score, sentences) of each document: the noisy-or of its sentences, and the spans (code points, end
    exclusive) and scores of those of `least` or more. An empty or null text scores as one plain sentence; repeated rows score
    alike, null ids stay; an empty table gives no rows; extra columns don't matter."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, sentences array<struct<start:bigint,end:bigint,score:double>>"
    return rows.mapInArrow(_Score(*model, least), schema)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
