"""Operator 13: spelling variants by range searches in K-d trees over letter-count vectors.

One edit changes the counts of letters by at most two in all: by one for an inserted or deleted letter, by two for a replaced
one. Words of each length have a tree; a word looks for its variants in the tree of its own length within distance 2 and in that
of the next length within 1. Boxes further away are pruned; of what is left the order of letters decides.

The upper levels of the trees are split on a bounded sample of words and tell every word its leaf; words and the searches that
reach a leaf meet there in a shuffle, and the tree goes on within the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import written

RUN = r"[A-Za-zÀ-ÿ]"
_LETTERS = 91  # a to z, 64 letters from U+00C0, and one for all others
_LEAF = 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least_length: int = 6, least_n: int = 5, one_in: int = 199) -> DataFrame:
    """(word, n): the words of at least least_length code points and their numbers, where that is least_n or more.

    Words are runs of letters, A-Z made lower. A run whose crc32 of <doc_id>:<run> is divisible by one_in loses the code point at
    that number modulo its length. Shorter runs can't become words, so they are not read out. A null text has no words, a
    null doc_id counts as the empty text in the checksum; repeated rows count each; an empty table has no words.
    """
    runs = F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))
    # explode_outer: explode() would add a filter that extracts the runs again
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode_outer(runs).alias("run")).filter("run IS NOT NULL")
    run = run.select("d", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = run.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run"))
    return h.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def codes(words: list[str], width: int) -> np.ndarray:
    """Code points of words as a table, padded with zeros."""
    return np.array(words, f"<U{max(width, 1)}").view(np.uint32).reshape(len(words), max(width, 1))


def letter_counts(table: np.ndarray) -> np.ndarray:
    """How often each word has each letter, up to 255."""
    out = np.zeros((len(table), _LETTERS), np.uint8)
    letter = np.where((table >= 97) & (table <= 122), table - 97, np.where((table >= 0xC0) & (table <= 0xFF), table - 0xC0 + 26, _LETTERS - 1)).astype(np.int64)
    for j in range(table.shape[1]):
        i = np.flatnonzero(table[:, j])
        out[i, letter[i, j]] += out[i, letter[i, j]] < 255
    return out


class Node(NamedTuple):
    """A split of letter counts: up to `most` of a letter go left. A leaf has a number instead."""

    letter: int
    most: int
    left: Node | None
    right: Node | None
    leaf: int


def _split(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter whose counts part the points best, and up to what count they go left; None if all are alike."""
    n = len(counts)
    best, at = 0, None
    for most in range(3):
        left = (counts <= most).sum(0)
        even = np.minimum(left, n - left)
        i = int(even.argmax())
        if even[i] > best:
            best, at = int(even[i]), (i, most)
    if at is None and n:
        spread = counts.max(0) > counts.min(0)
        if spread.any():
            i = int(spread.argmax())
            at = (i, int(counts[:, i].min()))
    return at


def build(counts: np.ndarray, most: int, leaves: list[np.ndarray], at: np.ndarray | None = None) -> Node:
    """A tree whose leaves have up to `most` points, or points of equal counts; their places are added to leaves."""
    at = np.arange(len(counts)) if at is None else at
    cut = _split(counts[at]) if len(at) > most else None
    if cut is None:
        leaves.append(at)
        return Node(-1, 0, None, None, len(leaves) - 1)
    left = counts[at, cut[0]] <= cut[1]
    return Node(*cut, build(counts, most, leaves, at[left]), build(counts, most, leaves, at[~left]), -1)


def home(node: Node, counts: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Puts the leaf of each point into out."""
    if node.left is None:
        out[at] = node.leaf
        return
    left = counts[at, node.letter] <= node.most
    home(node.left, counts, at[left], out)
    home(node.right, counts, at[~left], out)


def reach(node: Node, counts: np.ndarray, at: np.ndarray, far: np.ndarray, box: dict[int, tuple[int, int]], radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, places): the searches that can find something in each leaf.

    far: the distance of each search from the node's box so far; box: the bounds of the letters that were split. A search
    whose distance grows over the radius is pruned.
    """
    if not len(at):
        return
    if node.left is None:
        yield node.leaf, at
        return
    low, high = box.get(node.letter, (0, 255))
    mine = counts[at, node.letter].astype(np.int16)
    beyond = lambda lo, hi: np.maximum(0, np.maximum(lo - mine, mine - hi))
    before = far - beyond(low, high)
    for child, (lo, hi) in ((node.left, (low, min(high, node.most))), (node.right, (max(low, node.most + 1), high))):
        d = before + beyond(lo, hi)
        go = d <= radius
        yield from reach(child, counts, at[go], d[go], box | {node.letter: (lo, hi)}, radius)


def _bits(counts: np.ndarray) -> np.ndarray:
    """Counts in unary as two words of 64 bits: as many bits differ as counts do, or fewer, so none within reach is lost."""
    out = np.zeros((len(counts), 2), np.uint64)
    c = counts.astype(np.uint64)
    unary = (np.uint64(1) << np.minimum(c, np.uint64(4))) - np.uint64(1)  # four bits a letter
    for i in range(26):
        out[:, i // 16] |= unary[:, i] << np.uint64(4 * (i % 16))
    rest = np.zeros(len(counts), np.uint64)
    for i in range(26, _LETTERS):
        rest ^= (c[:, i] & np.uint64(1)) << np.uint64(i % 24)
    out[:, 1] |= rest << np.uint64(40)
    return out


def one_edit(a: np.ndarray, b: np.ndarray, longer: int) -> np.ndarray:
    """Whether words a (rows of codes) become words b by one replaced letter, or by one inserted if b is longer by one."""
    if not longer:
        return (a != b).sum(1) == 1
    same = a == b[:, :-1]
    ahead = np.where(same.all(1), a.shape[1], same.argmin(1))
    after = (a == b[:, 1:])[:, ::-1]
    behind = np.where(after.all(1), a.shape[1], after.argmin(1))
    return ahead + behind >= a.shape[1]


def neighbours(points: list[str], searches: list[str], most_pairs: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(search, point): places of words that are one edit apart; all points are of one length, all searches of it or one less."""
    n, m = len(points[0]), len(searches[0])
    p, s = codes(points, n), codes(searches, m)
    counts, sought = letter_counts(p), letter_counts(s)
    pb, sb = _bits(counts), _bits(sought)
    radius = 2 if n == m else 1
    leaves: list[np.ndarray] = []
    tree = build(counts, _LEAF, leaves)
    for leaf, at in reach(tree, sought, np.arange(len(searches)), np.zeros(len(searches), np.int16), {}, radius):
        mine = leaves[leaf]
        step = max(1, most_pairs // max(1, len(mine)))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            differ = np.bitwise_count(sb[part, None, 0] ^ pb[None, mine, 0]) + np.bitwise_count(sb[part, None, 1] ^ pb[None, mine, 1])
            x, y = np.nonzero(differ <= radius)
            x, y = part[x], mine[y]
            ok = one_edit(s[x], p[y], n - m)
            if ok.any():
                yield x[ok], y[ok]


class _Trees:
    """Deals words to the leaves of the upper trees: as a point to its own leaf, as a search to all leaves in reach."""

    def __init__(self, trees: dict[int, tuple[Node, int]]):
        self.trees = trees  # by length: the tree, and the number of its first leaf

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.array(batch["word"].to_pylist(), object)
            n = batch["n"].to_numpy()
            lengths = np.array([len(w) for w in words], np.int64)
            for size in np.unique(lengths):
                own = np.flatnonzero(lengths == size)
                counts = letter_counts(codes(list(words[own]), int(size)))
                every, zeros = np.arange(len(own)), np.zeros(len(own), np.int16)
                tree, first = self.trees.get(int(size), _ONE_LEAF)
                leaf = np.zeros(len(own), np.int64)
                home(tree, counts, every, leaf)
                yield _dealt(words[own], n[own], int(size), leaf + first, True)
                for longer, radius in ((0, 2), (1, 1)):
                    tree, first = self.trees.get(int(size) + longer, _ONE_LEAF)
                    for k, at in reach(tree, counts, every, zeros, {}, radius):
                        yield _dealt(words[own[at]], n[own[at]], int(size) + longer, np.full(len(at), k + first), False)


_ONE_LEAF = (Node(-1, 0, None, None, 0), -1)  # of a length that the sample has not
_DEALT = "size int, leaf long, is_point boolean, word string, n long"
_PAIR = "word string, n long, near string, near_n long"


def _dealt(words: np.ndarray, n: np.ndarray, size: int, leaf: np.ndarray, is_point: bool) -> pa.RecordBatch:
    k = len(words)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(k, size, np.int32)), pa.array(leaf), pa.array(np.full(k, is_point)), pa.array(words.tolist(), pa.string()), pa.array(n)],
        ["size", "leaf", "is_point", "word", "n"],
    )


def _upper_trees(words: DataFrame, sample_words: int, leaf_words: int) -> dict[int, tuple[Node, int]]:
    """Trees by length, split on a sample of words by hash, so that a leaf has about leaf_words of all."""
    total = words.count()
    one_in = max(1, total // sample_words)
    seen: dict[int, list[str]] = {}
    for r in words.select("word").filter(F.pmod(F.xxhash64("word"), F.lit(one_in)) == 0).limit(2 * sample_words).collect():
        seen.setdefault(len(r["word"]), []).append(r["word"])
    out, first = {}, 0
    for size, sample in sorted(seen.items()):
        leaves: list[np.ndarray] = []
        tree = build(letter_counts(codes(sorted(sample), size)), max(8, leaf_words // one_in), leaves)
        out[size] = (tree, first)
        first += len(leaves)
    return out


def _meet(met: pa.Table) -> pa.Table:
    """The pairs of a leaf's points with some of the searches that reach it, either way."""
    points, searches = met.filter(met["is_point"]), met.filter(pc.invert(met["is_point"]))
    out: list[list] = [[], [], [], []]
    a, an = points["word"].to_pylist(), points["n"].to_numpy()
    s, sn = np.array(searches["word"].to_pylist(), object), searches["n"].to_numpy()
    lengths = np.array([len(w) for w in s], np.int64)
    for size in np.unique(lengths):
        own = np.flatnonzero(lengths == size)
        for x, y in neighbours(a, list(s[own])) if a else ():
            x = own[x]
            words = [a[i] for i in y]
            out[0] += s[x].tolist()
            out[1].append(sn[x])
            out[2] += words
            out[3].append(an[y])
            if size < len(a[0]):  # a search in the longer words' tree finds for both
                out[0] += words
                out[1].append(an[y])
                out[2] += s[x].tolist()
                out[3].append(sn[x])
    whole = lambda xs: pa.array(np.concatenate(xs) if xs else np.zeros(0, np.int64), pa.int64())
    return pa.table({"word": pa.array(out[0], pa.string()), "n": whole(out[1]), "near": pa.array(out[2], pa.string()), "near_n": whole(out[3])})


def near_words(words: DataFrame, sample_words: int = 200_000, leaf_words: int = 4_096, searches: int = 65_536) -> DataFrame:
    """(word, n, near, near_n): every pair, both ways, of words (word, n) that differ by exactly one edit.

    words must hold each word once. The sample of up to twice sample_words words only chooses the splits: every word is in a
    leaf and every leaf in reach is searched. A leaf with more searches than `searches` is dealt to several tasks, its points
    to each of them; points of equal counts can't be split, so a leaf is as large as its anagrams at least.
    """
    dealt = written(words.mapInArrow(_Trees(_upper_trees(words, sample_words, leaf_words)), _DEALT))
    key = ["size", "leaf"]
    loads = dealt.filter("NOT is_point").groupBy(*key).agg(F.ceil(F.count("*") / searches).cast("int").alias("parts"))  # a row a leaf
    own = F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    met = dealt.join(loads, key).withColumn("part", F.explode(F.when(F.col("is_point"), every).otherwise(own)))
    return met.select(*key, "part", "is_point", "word", "n").groupBy(*key, "part").applyInArrow(_meet, _PAIR)


def variants(words: DataFrame, times: int = 5, **how) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of the words (word, n).

    form: the near word of largest n, ties to the smallest in code-point order, if that n is at least `times` the word's;
    else null. root: the last of the forms' forms, the word itself if it has none. n rises along forms, so they end.
    """
    pairs = near_words(words, **how)
    # rising n, then falling word: min_by over (-n, word)
    found = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = F.when(-F.col("best.less") >= F.col("n") * times, F.col("best"))
    out = words.join(found, "word", "left").withColumn("best", best)
    out = written(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    hops = out.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps that a word has gone
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        hops = written(hops.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        moved = not hops.filter("moved").isEmpty()
        hops = hops.select("word", "root")
        if not moved:
            break
    return out.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, **how) -> DataFrame:
    """variants of the vocabulary of documents. Null texts have no words; an empty table gives no rows; extra columns don't matter."""
    return variants(written(vocabulary(docs)), **how)

