"""Operator 8: exact Jaccard join of documents on word n-grams, and the groups that its links make."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import bounded_batches, find_words, mix, parts, written

SKETCH_BITS = 23
_BLOCK_BITS = 17  # counters of a block of the sketch
_SLICE = 500_000  # bytes of texts that are cut into shingles at once
_MOST_SEEN = 100_000  # names of sets that a task remembers
SIGNATURE = 4  # longs
SIGNS = [f"s{i}" for i in range(SIGNATURE)]
_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct k-word shingles of each text; a text of fewer words has all of them as one."""
    words = find_words(texts)
    combine = lambda acc, h: mix(acc * np.uint64(0x9E3779B97F4A7C15) + h)
    n = max(0, len(words.hash) - k + 1)
    whole = words.doc[:n] == words.doc[k - 1 :][:n]
    acc = np.full(n, np.uint64(k))
    for i in range(k):
        acc = combine(acc, words.hash[i : i + n])
    doc, out = [words.doc[:n][whole]], [acc[whole]]
    sizes = np.bincount(words.doc, minlength=len(texts))
    starts = np.cumsum(sizes) - sizes
    for size in range(1, k):
        short = np.flatnonzero(sizes == size)
        acc = np.full(len(short), np.uint64(size))
        for i in range(size):
            acc = combine(acc, words.hash[starts[short] + i])
        doc.append(short)
        out.append(acc)
    doc, out = np.concatenate(doc), np.concatenate(out)
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (out[1:] != out[:-1])
    return doc[new], out[new]


def _nodes(doc: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name of each text's set, as a signed long."""
    sums = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    np.add.at(sums[0], doc, mix(shingle))
    np.add.at(sums[1], doc, mix(shingle ^ _SALTS[0]))
    return (mix(sums[0]) ^ mix(sums[1] * _SALTS[1] + np.uint64(1))).view(np.int64)


class _Sets:
    """Texts to one row each (doc_id, key, node, n, signature), and the task's sketch of shingle counts in blocks.

    The signature has one bit for each of 256 classes of shingles: whether the set has an odd number of them. Two sets differ
    in as many shingles, at least, as their signatures differ in bits.
    """

    def __init__(self, k: int):
        self.k = k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(2**SKETCH_BITS, np.uint16)
        for whole in batches:
            for batch in parts(whole, "text", _SLICE):
                n = batch.num_rows
                doc, shingle = shingles(batch.column("text"), self.k)
                slot, times = np.unique(shingle >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                sketch[slot] = np.minimum(sketch[slot] + times, 60_000).astype(np.uint16)
                odd = np.bincount(doc * 256 + (shingle & np.uint64(255)).astype(np.int64), minlength=n * 256) & 1
                signature = np.packbits(odd.astype(np.uint8).reshape(n, 256), axis=1).view(np.int64)
                yield self.rows(n, doc_id=batch.column("doc_id"), key=batch.column("key"), node=_nodes(doc, shingle, n), n=np.bincount(doc, minlength=n), **{f"s{i}": np.ascontiguousarray(signature[:, i]) for i in range(SIGNATURE)})
        if sketch.any():
            blocks = sketch.reshape(-1, 2**_BLOCK_BITS)
            yield self.rows(len(blocks), block=np.arange(len(blocks)), counts=[pa.compress(b.tobytes(), codec="zstd", asbytes=True) for b in blocks])

    def rows(self, many: int, /, **columns) -> pa.RecordBatch:
        fields = [("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), *[(f"s{i}", pa.int64()) for i in range(SIGNATURE)], ("block", pa.int64()), ("counts", pa.binary())]
        return pa.RecordBatch.from_arrays([columns[c].cast(t) if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(many, t) for c, t in fields], schema=pa.schema(fields))


_ROWS = "doc_id long, key long, node long, n long, " + ", ".join(f"s{i} long" for i in range(SIGNATURE)) + ", block long, counts binary"


def _summed_sketch(key, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2**_BLOCK_BITS, np.int64)
    for batch in group:
        for blob in batch.column("counts"):
            total += np.frombuffer(pa.decompress(blob.as_buffer(), decompressed_size=2 * len(total), codec="zstd"), np.uint16)
    level = np.minimum(np.round(8 * np.log2(total + 1)), 255).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([level.tobytes()])], ["block", "levels"])


def _sketch(rows: DataFrame) -> np.ndarray:
    """How often, on a scale of logarithms, the shingles of each of 2 ** SKETCH_BITS classes occur: a fixed number of bytes."""

    def summed(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summed_sketch(key, group)

    levels = np.zeros((2 ** (SKETCH_BITS - _BLOCK_BITS), 2**_BLOCK_BITS), np.uint8)
    for r in rows.filter("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(summed, "block long, levels binary").toLocalIterator():
        levels[r["block"]] = np.frombuffer(r["levels"], np.uint8)
    return levels.ravel()


def least_common(n: int | np.ndarray, percent: int):
    """Of n shingles, as many are in any set as like as that."""
    return -(-n * percent // 100)


def _slot(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _ordered(doc: np.ndarray, shingle: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles by document in the order of rarity: rare classes first, then by hash."""
    return np.lexsort((mix(shingle), levels[_slot(shingle)], doc))


def _prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    """So many first shingles of a set, in any order, include one of each set as like as that."""
    return n - least_common(n, percent) + 1


class _Prefixes:
    """Texts to (token, salt, node, n, place) for the first shingles in the order of rarity, once for each set that a task remembers.

    The salt parts the tokens of classes that the sketch counts over `hot` times, by node; other tokens have -1.
    """

    def __init__(self, k: int, percent: int, levels, hot: float):
        self.k, self.percent, self.levels, self.hot = k, percent, levels, hot

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = np.frombuffer(self.levels.value, np.uint8), set()
        pieces = np.ceil(np.exp2(np.arange(256) / 8) / self.hot).astype(np.int64)  # by level
        for whole in batches:
            for batch in parts(whole, "text", _SLICE):
                doc, shingle = shingles(batch.column("text"), self.k)
                node = _nodes(doc, shingle, batch.num_rows)
                fresh = np.zeros(len(node), bool)
                if len(seen) > _MOST_SEEN:  # a set may come twice from a task; the exchange drops it
                    seen.clear()
                for i, x in enumerate(node.tolist()):
                    fresh[i] = x not in seen
                    seen.add(x)
                doc, shingle = doc[fresh[doc]], shingle[fresh[doc]]
                order = _ordered(doc, shingle, levels)
                doc, shingle = doc[order], shingle[order]
                n = np.bincount(doc, minlength=batch.num_rows)
                place = np.arange(len(doc)) - (np.cumsum(n) - n)[doc] + 1
                keep = place <= _prefix_sizes(n[doc], self.percent)
                doc, token, place = doc[keep], shingle[keep], place[keep]
                into = pieces[levels[_slot(token)]]
                salt = np.where(into > 1, (mix(node[doc].view(np.uint64)) % np.maximum(into, 1).astype(np.uint64)).astype(np.int64), -1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token.view(np.int64), salt, node[doc], n[doc], place)], ["token", "salt", "node", "n", "place"])


class _Load:
    """Texts to (node, low, high, set) where the text has the node's set.

    low and high are the prefixes in two more orders, of rising and of falling hashes (32 bits of each shingle).
    """

    def __init__(self, k: int, percent: int):
        self.k, self.percent = k, percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text", _SLICE):
                doc, shingle = shingles(batch.column("text"), self.k)
                node = _nodes(doc, shingle, batch.num_rows)
                cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                low, high, sets, own = [], [], [], np.flatnonzero(node == batch.column("node").to_numpy())
                for i in own:
                    one = shingle[cut[i] : cut[i + 1]]
                    size = _prefix_sizes(len(one), self.percent)
                    short = (one & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                    low.append(short[:size])
                    high.append(short[-size:])
                    sets.append(one.tobytes())
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(low, kind), pa.array(high, kind), pa.array(sets, pa.binary())], ["node", "low", "high", "set"])


class _Verify:
    """Candidate pairs with both sets to those that are like enough."""

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= _in_common(len(x) + len(y), self.percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _in_common(total, percent: int):
    """The least number of shingles in common of two like sets that have so many together."""
    return -(-percent * total // (100 + percent))


class _Apart:
    """The rows of two blocks of a token to the pairs (a, b) of different components that sizes, places and signatures let be."""

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, group: pa.Table) -> pa.Table:
        c = {k: group.column(k).to_numpy() for k in ("i", "j", "own", "node", "comp", "n", "place", *SIGNS)}
        x, y = (np.flatnonzero(c["own"] == c[k][0]) for k in ("i", "j"))
        of = lambda k: (c[k][x][:, None], c[k][y][None, :])
        (n, m), (at, to), (low, high) = of("n"), of("place"), of("comp")
        need = _in_common(n + m, self.percent)
        ok = (low != high) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * self.percent) & (1 + np.minimum(n - at, m - to) >= need)
        if c["i"][0] == c["j"][0]:
            ok &= np.less(*of("node"))
        p, q = (side[k] for side, k in zip((x, y), np.nonzero(ok)))
        apart = sum((np.bitwise_count((c[s][p] ^ c[s][q]).view(np.uint64)).astype(np.int64) for s in SIGNS), np.zeros(len(p), np.int64))
        near = apart <= c["n"][p] + c["n"][q] - 2 * _in_common(c["n"][p] + c["n"][q], self.percent)
        p, q = c["node"][p[near]], c["node"][q[near]]
        return pa.table({"a": np.minimum(p, q), "b": np.maximum(p, q)})


class _Links:
    """The sets of two blocks of a component to (node, linked): the rows that each node's links lead to in the other block."""

    def __init__(self, percent: int, width: int = 4096):
        self.percent, self.width = percent, width

    def __call__(self, group: pa.Table) -> pa.Table:
        i, j, own, node, rows = (group.column(k).to_numpy() for k in ("i", "j", "own", "node", "rows"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("set")]
        x, y = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
        n = np.array([len(s) for s in sets], np.int64)
        whose, token = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
        _, at, times = np.unique(token, return_inverse=True, return_counts=True)
        shared = times[at] > 1  # others are in no two sets
        number = np.cumsum(times > 1) - 1
        whose, at = whose[shared], number[at[shared]]
        order = np.argsort(at, kind="stable")
        whose, at = whose[order], at[order]
        common = np.zeros((len(x), len(y)), np.float32)
        # blocks of columns, so that memory is bounded; counts below 2 ** 24 are exact
        for first in range(0, int(number[-1]) + 1, self.width):
            a, b = np.searchsorted(at, [first, first + self.width])
            has = np.zeros((len(sets), self.width), np.float32)
            has[whose[a:b], at[a:b] - first] = 1
            common += has[x] @ has[y].T
        like = 100 * common >= self.percent * (n[x][:, None] + n[y][None, :] - common)
        like &= node[x][:, None] != node[y][None, :]
        linked = np.zeros(len(sets), np.int64)
        linked[x] += like @ rows[y]
        if i[0] != j[0]:
            linked[y] += like.T @ rows[x]
        return pa.table({"node": node, "linked": linked})


def _plain(f):
    """f as the plain function that applyInArrow asks for."""

    def of(group: pa.Table) -> pa.Table:
        return f(group)

    return of


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to (node, comp) in one task: the least node of each node's component."""
    tables = list(batches)
    if not tables:
        return
    a, b = (np.concatenate([t.column(k).to_numpy() for t in tables]) for k in ("a", "b"))
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(node))
    while True:  # each end takes the least of both, and of that its least in turn
        low = np.minimum(least[x], least[y])
        new = least.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, least[x], low)
        np.minimum.at(new, least[y], low)
        new = new[new]
        if np.array_equal(new, least):
            break
        least = new
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[least])], ["node", "comp"])


def components(edges: DataFrame, most_rounds: int = 60, most_in_a_task: int = 1_000_000) -> DataFrame:
    """(node, comp): the least node of each node's component, for the nodes of edges (a, b).

    Up to most_in_a_task edges (16 bytes each) are joined up in one task. More go in rounds: large star and small star in turn,
    until the edges stay the same: each node's neighbours are joined to the least of them, first the larger ones, then the
    smaller ones. The least is an aggregate, which each task begins on its own, and is joined back, so a hub's neighbours never sit in
    one window. Rounds grow with the logarithm of the longest chain; if most_rounds are not enough it raises, so no
    unfinished labels come out.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state(edges)
    if before[0] <= most_in_a_task:
        return written(edges.coalesce(1).mapInArrow(_joined_up, "node long, comp long"))

    def least(e: DataFrame) -> DataFrame:
        """e (u, v) with m, the least v of each u."""
        return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")

    for _ in range(most_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        large = least(both).filter("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).filter("a <> b").distinct()
        down = least(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        edges = written(down.select(F.col("v").alias("a"), F.col("m").alias("b")).union(down.select("u", "m")).filter("a <> b").distinct())
        after = state(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        before = after
    raise RuntimeError(f"components still change after {most_rounds} rounds")


def _placed(a: str, b: str, percent: int) -> Column:
    """Whether two rows of a token can be of a pair that is like enough, by their sizes and the token's places in them."""
    c = lambda x, y: F.col(f"{x}.{y}")
    need = F.ceil((c(a, "n") + c(b, "n")) * percent / (100 + percent) - 1e-9)
    return (F.least(c(a, "n"), c(b, "n")) * 100 >= F.greatest(c(a, "n"), c(b, "n")) * percent) & (1 + F.least(c(a, "n") - c(a, "place"), c(b, "n") - c(b, "place")) >= need)


def _signed(a: str, b: str, percent: int) -> Column:
    """Whether two sets can be like enough, by their sizes and signatures."""
    c = lambda x, y: F.col(f"{x}.{y}")
    total = c(a, "n") + c(b, "n")
    apart = sum((F.bit_count(c(a, f"s{i}").bitwiseXOR(c(b, f"s{i}"))) for i in range(SIGNATURE)), F.lit(0))
    return apart <= total - 2 * F.ceil(total * percent / (100 + percent) - 1e-9)


def _dealt(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """rows for each pair of blocks (i, j) of their key that they take part in, with their own block: so that every two rows
    of a key meet in one group, and no group has more than two blocks."""
    own = rows.withColumn("own", F.pmod(F.xxhash64("node", key), blocks).cast("int"))
    met = own.withColumn("_o", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    return met.withColumns({"i": F.least("own", "_o"), "j": F.greatest("own", "_o")}).drop("_o")


def groups(docs: DataFrame, *how, **more) -> DataFrame:
    """As labelled, without the columns key and comp."""
    return labelled(docs, *how, **more).drop("key", "comp")


def labelled(docs: DataFrame, *how, **more) -> DataFrame:
    """As _labelled, whose jobs on texts send them in batches that are bounded by bytes."""
    with bounded_batches(docs.sparkSession):
        return _labelled(docs, *how, **more)


def _labelled(
    docs: DataFrame, k: int = 4, percent: int = 85, rounds: int = 2, crowd: int = 16, most_broadcast: int = 500_000, count: bool = True,
    block: int = 512, block_shingles: int = 500_000, hot: int = 2000,
) -> DataFrame:
    """(doc_id, key, comp, n_shingles, component_id, n_links) of each row of docs; without count there is no n_links.

    key is the hash of the text, and comp the node that stands for the component (null for a text without words).

    Two rows link if their sets of distinct k-word shingles have a Jaccard likeness of percent / 100 or more; component_id is the
    least doc_id that links reach, and n_links the number of other rows that a row links with, rows of the same set among them.
    All links between different sets are found or lie within a component that is found:

    Rows with one set are one node. The first shingles of each set in a global order are its prefix; like sets share a token
    there, in any order. Candidates come from the prefixes in the order of rarity (by a sketch of all counts), and must share
    a token too in those of two more orders, of rising and of falling hashes: these filters, with sizes, places of the token
    and signatures, meet in the joins before sets are brought to the pairs that are left and compared.

    All pairs of a token that up to `crowd` nodes share are candidates. A larger crowd goes in rounds: every node is compared
    with one, first the one with the most shared tokens, then a drawn one, which joins large groups in few pairs; then the
    nodes of which the components still differ meet in pairs of blocks of `block` nodes, so no link is lost.

    Links within crowds are counted by component: its nodes meet in pairs of blocks of about `block` nodes and
    block_shingles shingles at most, where the sets' products give all sizes in common at once; what leaves a task is a
    number for each node, never the pairs. The work grows with the square of a component's different sets. Rows
    of one set are counted by their number. Tokens that the sketch counts over `hot` times (or 16 times the mean) are dealt by node too,
    so no task ranks or counts a whole crowd.

    Empty and null texts link with nothing and have their own doc_id; a null doc_id counts as greater than all. Extra
    columns don't matter; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    rows = written(docs.mapInArrow(_Sets(k), _ROWS))
    sketch = _sketch(rows)
    levels = spark.sparkContext.broadcast(sketch.tobytes())  # 2 ** SKETCH_BITS bytes
    often = max(float(hot), 16 * float(np.exp2(sketch / 8).mean()))
    sets = rows.filter("block IS NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    nodes = sets.filter("n > 0").groupBy("node").agg(first, F.count("*").alias("rows"), F.first("n").alias("n"), *[F.first(s).alias(s) for s in SIGNS])
    nodes = written(nodes.select("*", "first.doc_id", "first.key").drop("first"))
    # one exchange by token serves both the distinct rows and their number
    prefixes = docs.mapInArrow(_Prefixes(k, percent, levels, often), "token long, salt long, node long, n long, place long")
    prefixes = prefixes.repartition("token", "salt").dropDuplicates(["token", "salt", "node"])
    times = F.count("*").over(Window.partitionBy("token", "salt"))
    met = written(prefixes.withColumn("times", times).filter("times > 1 OR salt >= 0"))
    salted = met.filter("salt >= 0").drop("times")
    totals = salted.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1")
    shared = met.filter("salt < 0").unionByName(salted.join(totals, "token")).drop("salt")
    tokens = F.count("*").over(Window.partitionBy("node"))  # as many rows as a set's prefix
    crowded = written(shared.filter(F.col("times") > crowd).drop("n").join(nodes.drop("doc_id", "key", "rows"), "node").withColumn("tokens", tokens))

    def loaded(wanted: DataFrame, small: bool) -> DataFrame:
        """The sets and further prefixes of nodes; small: they are most_broadcast at most."""
        wanted = wanted.join(nodes, "node").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "node")
        own = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
        texts = docs.join(F.broadcast(wanted) if small else wanted, own).select("text", "node")
        return written(texts.mapInArrow(_Load(k, percent), "node long, low array<int>, high array<int>, set binary").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that share a token in the other orders' prefixes, and are like enough."""
        n = pairs.count()
        if not n:
            return spark.createDataFrame([], "a long, b long")
        have = loaded(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), 2 * n <= most_broadcast)
        side = lambda c, *names: have.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in names])
        left = pairs.join(side("a", "low", "high"), "a").join(side("b", "low", "high"), "b")
        left = left.filter(F.arrays_overlap("low_a", "low_b") & F.arrays_overlap("high_a", "high_b")).select("a", "b")
        both = left.join(side("a", "set"), "a").join(side("b", "set"), "b")
        return written(both.select("a", "b", "set_a", "set_b").mapInArrow(_Verify(percent), "a long, b long"))

    def ordered(pairs: DataFrame) -> DataFrame:
        return written(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())

    few = shared.filter(F.col("times") <= crowd)
    pairs = ordered(few.alias("x").join(few.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & _placed("x", "y", percent)))
    x, y = (nodes.select(F.col("node").alias(c), F.struct("n", *SIGNS).alias(v)) for c, v in (("a", "x"), ("b", "y")))
    few_links = links = verified(written(pairs.join(x, "a").join(y, "b").filter(_signed("x", "y", percent)).select("a", "b")))
    found = components(links)

    def differing() -> DataFrame:
        """The crowds with the components of their nodes, where these differ."""
        known = crowded.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        several = known.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
        return known.join(several.select("token"), "token", "left_semi")

    columns = ["node", "comp", "n", "place", *SIGNS]
    for i in range(rounds + 1):
        left = written(differing())
        if left.isEmpty():
            break
        if i < rounds:
            draw = (F.col("n") - F.col("tokens")) / F.col("n") if i == 0 else F.xxhash64("node", F.lit(i)).cast("double")
            centre = left.groupBy("token").agg(F.min(F.struct(draw.alias("draw"), *columns)).alias("y"))
            star = left.select("token", F.struct(*columns).alias("x")).join(centre, "token").filter("x.comp <> y.comp")
            more = ordered(star.filter(_placed("x", "y", percent) & _signed("x", "y", percent)))
        else:
            met = _dealt(left, "token", F.ceil(F.col("times") / block)).select("token", "i", "j", "own", *columns)
            more = written(met.groupBy("token", "i", "j").applyInArrow(_plain(_Apart(percent)), "a long, b long").distinct())
        links = written(links.union(verified(more)))
        found = components(links)
    labels = written(nodes.select("node", "doc_id", "rows").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    ids = labels.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = labels.join(ids, "comp").select("node", "comp", "component_id", "rows")
    out = [F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")]
    if count:
        dense = crowded.select("node", "n").distinct().join(labels.select("node", "comp", "rows"), "node")
        sizes = dense.groupBy("comp").agg(F.count("*").alias("size"), F.sum("n").alias("sum")).filter("size > 1")
        dense = written(dense.join(sizes, "comp"))
        blocks = F.ceil(F.greatest(F.col("size") / block, F.col("sum") / block_shingles))
        linked = spark.createDataFrame([], "node long, linked long")
        if n := dense.count():
            have = loaded(dense.select("node"), n <= most_broadcast).select("node", "set")
            met = _dealt(dense, "comp", blocks).select("comp", "i", "j", "own", "node", "rows").join(have, "node")
            linked = met.groupBy("comp", "i", "j").applyInArrow(_plain(_Links(percent)), "node long, linked long")
        # links of which an end is in no crowd came from small tokens
        inside = dense.select(F.col("node"), F.lit(1).alias("_in"))
        rest = few_links.distinct().join(inside.withColumnsRenamed({"node": "a", "_in": "_in_a"}), "a", "left").join(inside.withColumnsRenamed({"node": "b", "_in": "_in_b"}), "b", "left").filter("_in_a IS NULL OR _in_b IS NULL")
        ends = rest.select(F.col("a").alias("node"), F.col("b").alias("other")).union(rest.select("b", "a"))
        single = ends.join(nodes.select(F.col("node").alias("other"), F.col("rows").alias("linked")), "other").select("node", "linked")
        sums = single.unionByName(linked).groupBy("node").agg(F.sum("linked").alias("linked"))
        named = named.join(sums, "node", "left").select("node", "comp", "component_id", (F.col("rows") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
        out.append(F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).alias("n_links"))
    return sets.join(named, "node", "left").select("doc_id", "key", "comp", *out)


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, **how) -> DataFrame:
    """docs with one document of each group of like ones: that of the least doc_id, and of those the least text hash.

    A row with a null doc_id stays only if its group has no doc_id. Texts without words are like nothing and all stay. Of rows
    alike in doc_id and text one stays. Columns of any name are carried; an empty table gives no rows.
    """
    rows = written(labelled(docs, k, percent, count=False, **how).select("doc_id", "key", "comp"))
    best = rows.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one"))
    kept = best.select("one.doc_id", "one.key").unionByName(rows.filter("comp IS NULL").select("doc_id", "key").distinct())
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    own = F.col("id").eqNullSafe(F.col("k.doc_id")) & (F.col("hash") == F.col("k.key"))
    return packed.join(kept.alias("k"), own, "left_semi").dropDuplicates(["id", "hash"]).select("row.*")
