"""Operator 7: an interpolated modified Kneser-Ney bigram model."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import find_words, mix, parts, shared_folder

BEGIN, END = np.uint64(0x0B0E61), np.uint64(0x0E4D)
_FLUSH = 1_500_000  # tokens that a task holds before it sends their counts
_HELD = 2_000_000  # pairs of a shard that a task holds before it sums those alike
_OPEN = 16_000  # files that a worker keeps mapped
_SPREAD = 8  # shards over which the pairs of one left word lie


class Tokens(NamedTuple):
    """Every token of a batch and the one before it, by document: words, then END; BEGIN stands before the first."""

    doc: np.ndarray
    left: np.ndarray
    right: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    words, n = find_words(texts), len(texts)
    right = np.full(len(words.doc) + n, END)
    right[np.arange(len(words.doc)) + words.doc] = words.hash
    ends = np.searchsorted(words.doc, np.arange(n), "right") + np.arange(n)
    left = np.roll(right, 1)
    left[np.concatenate([[0], ends[:-1] + 1])[:n]] = BEGIN
    doc = np.repeat(np.arange(n), np.diff(np.concatenate([[-1], ends])))
    return Tokens(doc, left, right)


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right << np.uint64(23))))


def pair_shard(left: np.ndarray, right: np.ndarray, shards: int) -> np.ndarray:
    return ((left % np.uint64(shards) + right % np.uint64(_SPREAD)) % np.uint64(shards)).astype(np.int64)


def word_shard(word: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so sorted words meet them in turn."""
    return (word // np.uint64(2**64 // shards + 1)).astype(np.int64)


def _summed(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by (left, right), and how often each occurs."""
    order = np.lexsort((right, left))
    left, right, n = left[order], right[order], n[order]
    new = np.ones(len(left), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    at = np.flatnonzero(new)
    return left[at], right[at], np.add.reduceat(n, at) if len(at) else n


def _packed(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(a.tobytes() for a in arrays), codec="zstd", asbytes=True)


class _Count:
    """Texts to (shard, pairs, runs, right, left and counts): sorted pairs, their left words once each."""

    def __init__(self, shards: int):
        self.shards = shards

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in batches:
            for batch in parts(whole, "text"):
                t = tokens(batch.column("text"))
                held.append(t)
                n += len(t.right)
                if n >= _FLUSH:
                    yield from self.sent(held)
                    held, n = [], 0
        if n:
            yield from self.sent(held)

    def sent(self, held: list[Tokens]) -> Iterator[pa.RecordBatch]:
        left, right = (np.concatenate([getattr(t, k) for t in held]) for k in ("left", "right"))
        left, right, n = _summed(left, right, np.ones(len(left), np.int64))
        shard = pair_shard(left, right, self.shards)
        order = np.argsort(shard, kind="stable")
        left, right, n, shard = left[order], right[order], n[order], shard[order]
        cut = np.flatnonzero(np.diff(shard)) + 1
        rows = []
        for a, b in zip([0, *cut], [*cut, len(shard)]):
            first = np.flatnonzero(np.concatenate([[True], left[a + 1 : b] != left[a : b - 1]]))
            runs = np.diff(np.append(first, b - a)).astype(np.uint32)
            rows.append((int(shard[a]), int(b - a), len(first), right[a:b].tobytes(), _packed(left[a:b][first], runs, n[a:b].astype(np.uint64))))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["shard", "pairs", "lefts", "rights", "rest"])


COUNTED = "shard long, pairs long, lefts long, rights binary, rest binary"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all, so that a task can run again."""
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).view(np.uint8).data)
    system.move(part, f"{path}/{name}")


def _load(folder: str, name: str, rows: int, kind: type, columns: int = 1) -> np.ndarray:
    """A memory map of a saved array of so many rows, or of counts as narrow as they are.

    Where the folder is not mounted here it is of a copy, whose name goes at once, so that its space is free when the worker
    ends. A file that is missing or has another size is an error: scores without it would be wrong.
    """
    if not rows:
        return np.zeros((0, columns) if columns > 1 else 0, kind)
    system, path = _open(folder)
    at, local = f"{path}/{name}", isinstance(system, fs.LocalFileSystem)
    size = system.get_file_info(at).size
    kinds = {rows * columns * np.dtype(k).itemsize: k for k in (kind, np.uint32)}
    if size not in kinds:
        raise FileNotFoundError(f"{name} of the model in {folder} has {size} bytes, not {rows} rows")
    if not local:
        copy = f"{tempfile.gettempdir()}/{uuid.uuid4().hex}"
        fs.copy_files(at, copy, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
        at = copy
    flat = np.memmap(at, kinds[size], "r")
    if not local:
        os.unlink(at)
    return flat.reshape(-1, columns) if columns > 1 else flat


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits if they fit, else in 64."""
    return counts.astype(np.uint32 if counts.size == 0 or counts.max() < 2**32 else np.uint64)


class _Pairs:
    """The blobs of a shard to its file of sorted pair hashes with counts; sends what each word gathers here to the words' shards.

    Blobs come as a stream, and pairs alike are summed as it goes: a task holds the shard's different pairs and _HELD more.
    """

    def __init__(self, shards: int, folder: str):
        self.shards, self.folder = shards, folder

    def __call__(self, key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = [[], [], []], 0
        for batch in group:
            for r in batch.to_pylist():
                rest = pa.decompress(r["rest"], decompressed_size=12 * r["lefts"] + 8 * r["pairs"], codec="zstd", asbytes=True)
                firsts, runs = np.frombuffer(rest, np.uint64, r["lefts"]), np.frombuffer(rest, np.uint32, r["lefts"], 8 * r["lefts"])
                n = np.frombuffer(rest[12 * r["lefts"] :], np.uint64).astype(np.int64)
                for column, x in zip(held, (np.repeat(firsts, runs), np.frombuffer(r["rights"], np.uint64), n)):
                    column.append(x)
                fresh += r["pairs"]
                if fresh >= _HELD:
                    held, fresh = [[x] for x in _summed(*map(np.concatenate, held))], 0
        left, right, n = _summed(*map(np.concatenate, held))
        shard, hashes = key[0].as_py(), pair_key(left, right)
        order = np.argsort(hashes)
        _save(self.folder, f"pair-{shard}", hashes[order])
        _save(self.folder, f"pair-count-{shard}", _narrow(n[order]))
        words, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        on_left, on_right = at[: len(left)], at[len(left) :]
        begin = np.where(words == BEGIN, _sum_at(on_left, n, len(words)), 0)
        follow = [np.bincount(on_left, n == k if k < 3 else n >= 3, len(words)) for k in (1, 2, 3)]
        sums = np.stack([_sum_at(on_right, n, len(words)), np.bincount(on_right, minlength=len(words)), *follow, begin], axis=1).astype(np.int64)
        to = word_shard(words, self.shards)
        cut = np.flatnonzero(np.diff(to)) + 1
        several = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        for i, (a, b) in enumerate(zip([0, *cut], [*cut, len(to)])):
            first = i == 0
            row = [int(to[a]), int(b - a), words[a:b].tobytes(), _packed(sums[a:b].astype(np.uint64)), *(x * first for x in several), shard, len(n) * first]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 6])], ["shard", "words", "hashes", "sums", "p1", "p2", "p3", "p4", "of", "pairs"])


def _sum_at(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by place; exact, as sums of doubles are only below 2 ** 53."""
    out = np.zeros(size, np.int64)
    np.add.at(out, at, n)
    return out


PAIRED = "shard long, words long, hashes binary, sums binary, p1 long, p2 long, p3 long, p4 long, of long, pairs long"


class _Words:
    """What each word of a shard gathered to its file: sorted hashes with count, continuations and kinds of pairs that it begins."""

    def __init__(self, folder: str):
        self.folder = folder

    def merged(self, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        hashes, sums = np.concatenate([h for h, _ in held]), np.concatenate([s for _, s in held])
        order = np.argsort(hashes, kind="stable")
        words, at = np.unique(hashes[order], return_index=True)
        return words, np.add.reduceat(sums[order], at)

    def __call__(self, key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, several, files = [], 0, np.zeros(4, np.int64), []
        for batch in group:
            for r in batch.to_pylist():
                sums = np.frombuffer(pa.decompress(r["sums"], decompressed_size=48 * r["words"], codec="zstd", asbytes=True), np.uint64)
                held.append((np.frombuffer(r["hashes"], np.uint64), sums.reshape(-1, 6).astype(np.int64)))
                several += [r[f"p{k}"] for k in (1, 2, 3, 4)]
                files += [(r["of"], r["pairs"])] if r["pairs"] else []
                fresh += r["words"]
                if fresh >= _HELD:
                    held, fresh = [self.merged(held)], 0
        words, sums = self.merged(held)
        begin = words == BEGIN
        sums[begin, 0] = sums[begin, 5]  # as often as documents begin
        shard = key[0].as_py()
        _save(self.folder, f"word-{shard}", words)
        _save(self.folder, f"word-count-{shard}", _narrow(sums[:, :5]))
        real = sums[~begin]
        out = [real[:, 0].sum(), len(real), real[:, 1].sum(), *[(real[:, 1] == k).sum() for k in (1, 2, 3, 4)], (real[:, 1] >= 3).sum(), *several]
        pairs = pa.array([[{"shard": a, "rows": b} for a, b in files]], pa.list_(pa.struct([("shard", pa.int64()), ("rows", pa.int64())])))
        yield pa.RecordBatch.from_arrays([*[pa.array([int(x)], pa.int64()) for x in out], pa.array([shard]), pa.array([len(words)]), pairs], [*TOTALS, "shard", "rows", "pairs"])


TOTALS = ["n", "v", "kinds", "c1", "c2", "c3", "c4", "c3p", "p1", "p2", "p3", "p4"]
COUNTS = ", ".join(f"{c} long" for c in TOTALS) + ", shard long, rows long, pairs array<struct<shard:bigint,rows:bigint>>"


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """For counts 0, 1, 2 and 3 or more; each between 0 and the count."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [k - (k + 1) * y * b / a if a else y * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(d, 0.0), k) for k, d in enumerate(raw, 1))])


def _plain(f):
    """f as the plain function that applyInArrow asks for."""

    def of(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(key, group)

    return of


class Model(NamedTuple):
    """Where the sorted arrays are, and the sums over all words and pairs."""

    folder: str
    shards: int
    totals: dict[str, int]


def train(docs: DataFrame, shards: int | None = None, shard_bytes: int = 16_000_000) -> Model:
    """Counts every pair of tokens in the texts of docs, and stores hashes and counts in the shared folder.

    There are as many shards as the texts have shard_bytes, so what a task gathers stays the same at any size. Tasks send sorted
    pairs with counts, by shard of the pair; a shard sums them, writes its file, and sends what each word gathers there to the
    word's shard. A word's pairs are spread over shards, so no word's pairs meet in one task. The rows of all files are kept
    in a manifest, so that one that is missing is noticed. Null and empty texts are one END; extra columns don't matter; an
    empty table gives a model that knows no word.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    if shards is None:
        shards = max(2, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    folder = shared_folder(spark)
    sent = texts.mapInArrow(_Count(shards), COUNTED).repartition(shards, "shard")
    pairs = sent.groupBy("shard").applyInArrow(_plain(_Pairs(shards, folder)), PAIRED).repartition(shards, "shard")
    totals, files = dict.fromkeys(TOTALS, 0), np.zeros((shards, 2), np.int64)
    for r in pairs.groupBy("shard").applyInArrow(_plain(_Words(folder)), COUNTS).toLocalIterator():  # a row a shard
        totals = {c: totals[c] + r[c] for c in TOTALS}
        files[r["shard"], 1] = r["rows"]
        for x in r["pairs"]:
            files[x["shard"], 0] = x["rows"]
    _save(folder, "manifest", files)
    return Model(folder, shards, totals)


class _Score:
    def __init__(self, model: Model):
        self.model, self.files = model, {}

    def __getstate__(self):
        return self.model

    def __setstate__(self, model):
        self.__init__(model)

    def file(self, kind: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted hashes of a shard, and what is counted of each."""
        if (kind, shard) not in self.files:
            if len(self.files) >= _OPEN // 2:
                self.files.clear()
            rows = self.manifest()[shard, 0 if kind == "pair" else 1]
            folder = self.model.folder
            self.files[kind, shard] = _load(folder, f"{kind}-{shard}", rows, np.uint64), _load(folder, f"{kind}-count-{shard}", rows, np.uint64, 1 if kind == "pair" else 5)
        return self.files[kind, shard]

    def manifest(self) -> np.ndarray:
        if "manifest" not in self.files:
            self.files["manifest"] = _load(self.model.folder, "manifest", self.model.shards, np.int64, 2)
        return self.files["manifest"]

    def words(self, words: np.ndarray) -> np.ndarray:
        """Count, continuations, and the pairs met once, twice, oftener that it begins, of sorted words."""
        out = np.zeros((len(words), 5), np.int64)
        shard = word_shard(words, self.model.shards)
        cut = np.flatnonzero(np.diff(shard)) + 1
        for a, b in zip([0, *cut], [*cut, len(words)]):
            have, counts = self.file("word", int(shard[a]))
            if len(have):
                at = np.minimum(np.searchsorted(have, words[a:b]), len(have) - 1)
                ok = have[at] == words[a:b]
                out[a:b][ok] = counts[at[ok]]
        return out

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.zeros(len(left), np.int64)
        shard, key = pair_shard(left, right, self.model.shards), pair_key(left, right)
        order = np.lexsort((key, shard))
        cut = np.flatnonzero(np.diff(shard[order])) + 1
        for a, b in zip([0, *cut], [*cut, len(order)]):
            own = order[a:b]
            have, counts = self.file("pair", int(shard[own[0]]))
            if len(have):
                at = np.minimum(np.searchsorted(have, key[own]), len(have) - 1)
                ok = have[at] == key[own]
                out[own[ok]] = counts[at[ok]]
        return out

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = self.model.totals
        low, high = _discounts(x["c1"], x["c2"], x["c3"], x["c4"]), _discounts(x["p1"], x["p2"], x["p3"], x["p4"])
        for whole in batches:
            for batch in parts(whole, "text"):
                t, docs = tokens(batch.column("text")), batch.num_rows
                words, at = np.unique(np.concatenate([t.left, t.right]), return_inverse=True)
                known = self.words(words)
                before, now = known[at[: len(t.left)]], known[at[len(t.left) :]]
                base = np.log10((now[:, 0] + 0.5) / (x["n"] + 0.5 * (x["v"] + 1)))
                uniform = 1 / (x["v"] + 1)
                if x["kinds"]:
                    rest = (low[1] * x["c1"] + low[2] * x["c2"] + low[3] * x["c3p"]) / x["kinds"]
                    one = np.maximum(now[:, 1] - low[np.minimum(now[:, 1], 3)], 0) / x["kinds"] + rest * uniform
                else:
                    one = np.full(len(t.right), uniform)
                pair = self.pairs(t.left, t.right)
                seen = np.maximum(before[:, 0], 1)
                back = before[:, 2:] @ high[1:] / seen
                two = np.where(before[:, 0] > 0, np.maximum(pair - high[np.minimum(pair, 3)], 0) / seen + back * one, one)
                sums = [np.bincount(t.doc, minlength=docs), np.bincount(t.doc, now[:, 0] > 0, docs).astype(np.int64), np.bincount(t.doc, base, docs), np.bincount(t.doc, np.log10(two), docs)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each document: log10 chances under add-one-half unigrams and the model.

    A null or empty text is one END. Repeated rows score alike, null ids stay; an empty table gives no rows; extra columns don't
    matter.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_Score(model), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
