"""Operator 2: SentencePiece encoding and decoding; giant texts by a max-plus scan over chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sluice.llm.common import parts, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"  # stands for a space, and before a text
NEVER = np.float32(-np.inf)
_BLOCK = 64  # chunks whose matrices are combined first
State = tuple[int, int]  # a piece's start and end around a boundary


def library(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


class Pieces:
    """A SentencePiece BPE model, and which pieces may follow which.

    A sequence of pieces is the model's encoding of their text just if each two neighbours are the encoding of theirs: a
    merge across a border depends on the two pieces beside it only. So encoding is a best path, with weight 0 for
    neighbours that may meet and minus infinity for others. A character that is no piece stands for its bytes.
    """

    def __init__(self, model: bytes):
        self.lib = library(model)
        n = self.lib.get_piece_size()
        plain = [i for i in range(n) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i))]
        self.ids = {self.lib.id_to_piece(i): i for i in plain}
        self.scores = {p: self.lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = {b: self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.longest = max(map(len, self.ids))
        #: Whether a space can only be the start of a piece: then encodings of words are independent.
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.may_follow = lru_cache(200_000)(self._may_follow)
        self.alone = lru_cache(100_000)(lambda p: self.merged(p) == [p])

    def check(self) -> None:
        """Raises for a model that chunks would encode otherwise than its library: none of byte pairs, or one that changes texts."""
        for text in ("a", "x  y", "\ufb01 \uff21 \u00e9e\u0301\t\n", "the theory of 12345 words", "z" * 40):
            marked = MARK + text.replace(" ", MARK)
            own = [i for p in self.merged(marked) for i in ([self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()])]
            if own != self.lib.encode(text):
                raise ValueError("only byte-pair models that leave texts as they are and mark their start can encode in chunks")

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by its definition: the best merge first, the first of equals."""
        out = list(text)
        while True:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(out, out[1:])) if a + b in self.scores), default=None)
            if best is None:
                return out
            out[-best[1] : -best[1] + 2] = [out[-best[1]] + out[-best[1] + 1]]

    def _may_follow(self, a: str, b: str) -> bool:
        return self.merged(a + b) == [a, b]

    def at(self, text: str, start: int, most: int) -> list[int]:
        """The ends, up to most, of the pieces that can start here; a character that is no piece counts as one."""
        if text[start] not in self.ids:
            return [start + 1]
        return [e for e in range(start + 1, min(start + self.longest, most) + 1) if (p := text[start:e]) in self.ids and self.alone(p)]

    def states(self, text: str, at: int) -> list[State]:
        """The pieces that start before `at` and end there or after."""
        return [(s, e) for s in range(max(0, at - self.longest), at) for e in self.at(text, s, len(text)) if e >= at]

    def reach(self, text: str, first: State, stop: int) -> dict[State, State]:
        """The pieces that can follow from first on, starting before stop, each with one that it can follow; first stands for the start
        of a word if it is empty."""
        back: dict[State, State] = {}
        ends: dict[int, list[State]] = {first[1]: [first]}
        for s in range(first[1], stop):
            if s not in ends:
                continue
            for e in self.at(text, s, len(text)):
                for a in ends[s]:
                    if a[0] == a[1] or self.may_follow(text[a[0] : a[1]], text[s:e]):
                        back[s, e] = a
                        ends.setdefault(e, []).append((s, e))
                        break
        return back

    def path(self, back: dict[State, State], last: State, first: State) -> list[State]:
        out = []
        while last != first:
            out.append(last)
            last = back[last]
        return out[::-1]

    def encoded(self, text: str, spans: list[State]) -> list[int]:
        return [i for s, e in spans for i in ([self.ids[text[s:e]]] if text[s:e] in self.ids else [self.bytes[b] for b in text[s:e].encode()])]

    def words(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """The first and the last start of a word in low..high-1."""
        starts = [i for i in range(low, high) if text[i] == MARK and (i == 0 or text[i - 1] != MARK)] if self.by_word else []
        return (starts[0], starts[-1]) if starts else None


class Chunk:
    """A piece of a giant text from low to high, with enough before and after it to see all pieces that cross its borders."""

    def __init__(self, pieces: Pieces, text: str, low: int, high: int, first: bool, last: bool):
        self.p, self.text, self.low, self.high = pieces, text, low, high
        self.left = [(low, low)] if first else pieces.states(text, low)
        self.right = [(s, e) for s, e in pieces.states(text, high) if not last or e == high]
        self.words = pieces.words(text, low, high)

    def matrix(self) -> np.ndarray:
        """The transfer matrix from each state at low to each at high: 0 where a path leads, else minus infinity."""
        out = np.full((len(self.left), len(self.right)), NEVER, np.float32)
        if self.words is None:
            for i, a in enumerate(self.left):
                back = self.p.reach(self.text, a, self.high)
                out[i, [j for j, b in enumerate(self.right) if b in back or a == b]] = 0
            return out
        first, last = self.words
        after = self.p.reach(self.text, (last, last), self.high)
        ends = [j for j, b in enumerate(self.right) if b in after]
        for i, a in enumerate(self.left):
            if a[1] == first or any(e == first for _, e in self.p.reach(self.text, a, first)):
                out[i, ends] = 0
        return out

    def ids(self, i: int, j: int) -> list[int]:
        """The ids of the pieces that start here, on the path from state i at low to state j at high."""
        a, b = self.left[i], self.right[j]
        if self.words is None:
            return self.p.encoded(self.text, self.p.path(self.p.reach(self.text, a, self.high), b, a))
        first, last = self.words
        head = []
        if a[1] != first:
            back = self.p.reach(self.text, a, first)
            head = self.p.path(back, next(x for x in back if x[1] == first), a)
        tail = self.p.path(self.p.reach(self.text, (last, last), self.high), b, (last, last))
        middle = self.p.lib.encode(self.text[first + 1 : last]) if last > first else []
        return [*self.p.encoded(self.text, head), *middle, *self.p.encoded(self.text, tail)]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices; associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def walk(matrices: list[np.ndarray], start: int, end: int) -> list[int]:
    """The states at all borders on the best path from start to end."""
    best = [np.full(matrices[0].shape[0], NEVER, np.float32)]
    best[0][start] = 0
    for m in matrices:
        best.append((best[-1][:, None] + m).max(axis=0))
    out = [end]
    for m, b in zip(matrices[::-1], best[-2::-1]):
        out.append(int(np.argmax(b + m[:, out[-1]])))
    return out[::-1]


class _Encode:
    def __init__(self, model: bytes):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = library(self.model)
        for whole in batches:
            for batch in parts(whole, "text"):
                ids = pieces.encode(batch.column("text").to_pylist(), num_threads=1)
                yield batch.drop_columns(["text"]).append_column("ids", pa.array(ids, pa.list_(pa.int32())))


class _Decode:
    def __init__(self, model: bytes):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = library(self.model)
        for whole in batches:
            for batch in _slices(whole):
                yield batch.append_column("decoded", pa.array([None if x is None else pieces.decode(x) for x in batch.column("ids").to_pylist()], pa.string()))


def _slices(batch: pa.RecordBatch, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` ids each, so that a worker never holds all ids of a batch as Python numbers."""
    sizes = np.cumsum(batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


class _Chunks:
    """Giant texts to chunks (key, at, text, low, high, first, last); spaces and the start are marked."""

    def __init__(self, size: int, around: int):
        self.size, self.around = size, around

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                text = MARK + text.replace(" ", MARK)
                for k, at in enumerate(range(0, len(text), self.size)):
                    end, low = min(at + self.size, len(text)), max(0, at - self.around)
                    row = (key, k, text[low : end + self.around], at - low, end - low, at == 0, end == len(text))
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["key", "at", "text", "low", "high", "first", "last"])


_CHUNK = "key string, at long, text string, low long, high long, first boolean, last boolean"


class _Matrices:
    def __init__(self, model: bytes):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(self.model)
        for batch in batches:
            rows = batch.to_pylist()
            m = [Chunk(pieces, r["text"], r["low"], r["high"], r["first"], r["last"]).matrix() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("at"), pa.array([x.shape[0] for x in m], pa.int64()), pa.array([x.tobytes() for x in m], pa.binary())], ["key", "at", "height", "matrix"])


class _Backtrace:
    def __init__(self, model: bytes):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(self.model)
        for batch in batches:
            ids = [Chunk(pieces, r["text"], r["low"], r["high"], r["first"], r["last"]).ids(r["start"], r["end"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("at"), pa.array(ids, pa.list_(pa.int32()))], ["key", "at", "ids"])


def _loaded(rows: list[dict]) -> list[np.ndarray]:
    return [np.frombuffer(r["matrix"], np.float32).reshape(r["height"], -1) for r in rows]


def _sorted(group: pa.Table, by: str) -> list[dict]:
    return sorted(group.to_pylist(), key=lambda r: r[by])


def _block(group: pa.Table) -> pa.Table:
    """The matrices of a block of chunks to their product."""
    rows = _sorted(group, "at")
    out = _loaded(rows)
    while len(out) > 1:
        out = [combine(*out[i : i + 2]) if i + 1 < len(out) else out[i] for i in range(0, len(out), 2)]
    return pa.table({"key": [rows[0]["key"]], "block": pa.array([rows[0]["block"]], pa.int64()), "height": pa.array([out[0].shape[0]], pa.int64()), "matrix": [out[0].tobytes()]})


def _text(group: pa.Table) -> pa.Table:
    """The products of a text's blocks to the states at the blocks' borders."""
    rows = _sorted(group, "block")
    matrices = _loaded(rows)
    ends = [matrices[0][0]]
    for m in matrices[1:]:
        ends.append((ends[-1][:, None] + m).max(axis=0))
    path = walk(matrices, 0, int(np.argmax(ends[-1])))
    return pa.table({"key": [r["key"] for r in rows], "block": pa.array([r["block"] for r in rows], pa.int64()), "start": pa.array(path[:-1], pa.int64()), "end": pa.array(path[1:], pa.int64())})


def _within(group: pa.Table) -> pa.Table:
    """A block's matrices and border states to the states of each chunk."""
    rows = _sorted(group, "at")
    path = walk(_loaded(rows), rows[0]["start"], rows[0]["end"])
    return pa.table({"key": [r["key"] for r in rows], "at": pa.array([r["at"] for r in rows], pa.int64()), "start": pa.array(path[:-1], pa.int64()), "end": pa.array(path[1:], pa.int64())})


def _proto(model: str) -> bytes:
    with open(model, "rb") as f:
        return f.read()


def _packed(docs: DataFrame, *but: str) -> Column:
    """The columns of docs but some, of any names, as one struct."""
    names = [c for c in docs.columns if c not in but]
    return (F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("none"))).alias("row")


def encode(docs: DataFrame, model: str = MODEL, giant: int = 65_536, chunk: int = 16_384) -> DataFrame:
    """docs without text, with ids: the model's ids of each text, as its own library gives them.

    Texts of over `giant` characters are cut into chunks that overlap by a piece's length. Each chunk yields the transfer
    matrix between the pieces that can cross its borders; products of blocks of matrices, then of a text's blocks, give
    the piece at each border, from which each chunk is traced back on its own. A null text has null ids, an empty one none.
    Giant texts that are equal are encoded once. Other columns are carried whatever their names, but one called ids gives way
    to the ids. A model that chunks can't encode raises. An empty table gives no rows.
    """
    proto = _proto(model)
    pieces = Pieces(proto)
    pieces.check()
    around = pieces.longest
    rows = docs.select(_packed(docs, "text", "ids"), F.col("text"))
    out = StructType([rows.schema["row"], StructField("ids", ArrayType(IntegerType()))])
    small = rows.filter(F.length("text") <= giant).mapInArrow(_Encode(proto), out)
    large = rows.filter(F.length("text") > giant).select("row", "text", F.sha2("text", 256).alias("key"))
    texts = large.select("key", "text").dropDuplicates(["key"])
    chunks = written(texts.mapInArrow(_Chunks(chunk, around), _CHUNK))
    spread = chunks.repartition("key", "at")
    block = F.floor(F.col("at") / _BLOCK)
    matrices = written(spread.mapInArrow(_Matrices(proto), "key string, at long, height long, matrix binary").withColumn("block", block))
    products = matrices.groupBy("key", "block").applyInArrow(_block, "key string, block long, height long, matrix binary")
    borders = products.groupBy("key").applyInArrow(_text, "key string, block long, start long, end long")
    states = matrices.join(borders, ["key", "block"]).groupBy("key", "block").applyInArrow(_within, "key string, at long, start long, end long")
    traced = chunks.join(states, ["key", "at"]).mapInArrow(_Backtrace(proto), "key string, at long, ids array<int>")
    whole = traced.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    large = large.select("row", "key").join(whole, "key").select("row", "ids")
    none = rows.filter("text IS NULL").select("row", F.lit(None).cast("array<int>").alias("ids"))
    names = [c for c in docs.columns if c not in ("text", "ids")]
    return small.unionByName(large).unionByName(none).select(*[F.col("row").getField(c).alias(c) for c in names], "ids")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with a column decoded, the text of the ids; null for null. A column of that name gives way to it."""
    rows = encoded.select(_packed(encoded, "decoded"), F.col("ids"))
    out = rows.mapInArrow(_Decode(_proto(model)), StructType([*rows.schema, StructField("decoded", StringType())]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in encoded.columns if c != "decoded"], "decoded")
