"""Operator 3: quality rules that vote, weighed by weak supervision."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import WORD, let, words, written

SPAN = 8  # words of a window


class Rule(NamedTuple):
    """Votes for (1) above or below `good`, against (-1) beyond `bad`, and else abstains (0)."""

    name: str
    value: str  # SQL
    good: float
    bad: float

    def vote(self) -> Column:
        value = F.expr(self.value)
        if self.good <= self.bad:
            return F.when(value <= self.good, 1).when(value > self.bad, -1).otherwise(0)
        return F.when(value >= self.good, 1).when(value < self.bad, -1).otherwise(0)


def _share(a: str, b: str) -> str:
    return f"{a} / greatest({b}, 1)"


#: Most kinds of junk show in several of these, so that rules can confirm each other.
RULES = (
    Rule("long", "n_words", 60, 25),
    Rule("symbols", _share("n_symbols", "n_words"), 0.05, 0.3),
    Rule("odd_words", _share("n_odd_words", "n_words"), 0.1, 0.3),
    Rule("letters", _share("n_marks", "word_chars"), 0.06, 0.1),
    Rule("starts", _share("n_starts", "n_words"), 0.35, 0.6),
    Rule("capitals", _share("n_capital_runs", "n_words"), 0.1, 0.4),
    Rule("repeats", _share("n_repeat_words", "n_words"), 0.1, 0.3),
    Rule("runs", _share("n_runs", "n_words"), 0.03, 0.2),
    Rule("lines", _share("n_dup_lines", "n_lines"), 0.1, 0.3),
    Rule("variety", _share("n_distinct", "n_words"), 0.3, 0.15),
    Rule("word_length", f"abs({_share('word_chars', 'n_words')} - 6.5)", 4.0, 9.0),
)
#: Counted as pieces of the text that these part: words with more after a mark or with a mark first, words that do not start small.
COUNTED = {
    "n_symbols": "[#*$%&|<>]",
    "n_capital_runs": "[A-Z]{2,}",
    "n_odd_words": rf"[^\p{{L}}\x20\x09-\x0D]{WORD}|(?<!{WORD[:-1]})[^\p{{L}}\x20\x09-\x0D]+",
    "n_starts": rf"(?<!{WORD[:-1]})[^\p{{Ll}}\x20\x09-\x0D]",
}


def _repeat_words(ws: Column) -> Column:
    """How many words lie in windows of SPAN words that occur twice or more in the text (by 64-bit hash)."""

    def covered(at: Column) -> Column:
        reach = lambda p, i: F.when(i < F.size(at) - 1, F.least(F.lit(SPAN), at[F.least(i + 1, F.size(at) - 1)] - p)).otherwise(F.lit(SPAN))
        return F.aggregate(F.transform(at, reach), F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(hashes: Column) -> Column:
        """Where the windows are that have an equal one."""

        def found(by_hash: Column) -> Column:
            last = F.size(by_hash) - 1
            equal = lambda x, i: (i > 0) & (by_hash[F.greatest(i - 1, F.lit(0))]["h"] == x["h"]) | (i < last) & (by_hash[F.least(i + 1, last)]["h"] == x["h"])
            return F.array_sort(F.transform(F.filter(by_hash, equal), lambda x: x["at"]))

        return let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))), found)

    def doubled(hashes: Column, apart: int) -> Column:
        """Hashes of windows twice as long, from each window and the one that follows it."""
        return let(hashes, lambda hs: F.transform(F.slice(hs, 1, F.size(hs) - apart), lambda h, i: F.xxhash64(h, hs[i + apart])))

    windows = F.transform(ws, lambda w: F.xxhash64(w))
    for apart in (1, 2, 4):  # to windows of 8
        windows = doubled(windows, apart)
    none = F.lit(0).cast("long")
    some = let(windows, lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), let(twice(hs), covered)).otherwise(none))
    return F.when(F.size(ws) > SPAN, some).otherwise(none)


def features(docs: DataFrame) -> DataFrame:
    """What the rules look at, by row; a null text counts as empty, which has zeros. Repeated rows give repeated results, null ids stay;
    an empty table gives no rows; extra columns don't matter."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", let(words(text), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"), F.size(F.filter(ws, lambda w, i: (i > 0) & (w == ws[F.greatest(i - 1, F.lit(0))]))).cast("long").alias("n_runs"), _repeat_words(ws).alias("n_repeat_words"),
    )).alias("w"), let(F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0), lambda ls: F.struct(
        F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
    )).alias("l"), *[(F.size(F.split(text, p, -1)) - 1).cast("long").alias(c) for c, p in COUNTED.items()], F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", "")).cast("long").alias("n_marks"))
    return out.select("doc_id", "w.*", "l.*", "n_marks", *COUNTED)


#: The first belief: chances of a vote from a good and from a bad document. A vote against says more than one for: junk of one
#: kind passes the rules that look for other kinds.
START = {1: (0.7, 0.4), 0: (0.25, 0.3), -1: (0.05, 0.3)}


class Belief(NamedTuple):
    """The share of good documents, and for each rule the chances of its votes from a good and from a bad one."""

    prior: float
    chances: dict[str, dict[int, tuple[float, float]]]


def estimate(patterns: DataFrame, rules: list[str], rounds: int = 20, prior: float = 0.8) -> Belief:
    """Expectation-maximisation on the table of vote patterns (votes: one of each rule, n): 3 ** rules rows at most.

    All rounds are one job: the table, whose size the rules bound, is one array, and a fold over the rounds carries the
    belief as an array of numbers (the prior, then for each rule and vote the two chances). A trace of START stays in the
    sums, so no chance becomes 0. Without patterns the first belief stays.
    """
    votes = (-1, 0, 1)
    first = [prior, *[x for _ in rules for v in votes for x in START[v]]]
    traces = F.lit(first[1:])

    def belief_of(sums: Column) -> Column:
        good, n = sums[0] + sums[2] + sums[4], sums[1] + sums[3] + sums[5]
        chance = lambda x, k: F.when(k % 2 == 0, (x + traces[k]) / (good + 1)).otherwise((x - sums[F.greatest(k - 1, F.lit(0))] + traces[k]) / (n - good + 1))
        return F.concat(F.array((good + 1) / (n + 2)), F.transform(sums, chance))

    def round_(belief: Column) -> Column:
        def likely(p: Column) -> Column:
            ratio = lambda v, i: belief[6 * i + 2 * v + 3] / belief[6 * i + 2 * v + 4]
            odds = F.aggregate(F.transform(p["votes"], ratio), belief[0] / (1 - belief[0]), lambda a, x: a * x)
            return let(odds, lambda o: p["n"] * (o / (1 + o)))

        def add(sums: Column, p: Column) -> Column:
            mine = lambda k: p["votes"][F.floor(k / 6).cast("int")] == F.floor(k / 2).cast("int") % 3 - 1
            return let(likely(p), lambda g: F.transform(sums, lambda x, k: x + F.when(mine(k), F.when(k % 2 == 0, g).otherwise(p["n"].cast("double"))).otherwise(0.0)))

        return let(F.aggregate("patterns", F.lit([0.0] * (len(first) - 1)), add), belief_of)

    packed = patterns.agg(F.collect_list(F.struct("votes", "n")).alias("patterns"))
    whole = F.when(F.size("patterns") > 0, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(first), lambda b, _: round_(b))).otherwise(F.lit(first))
    got = packed.select(whole.alias("belief")).first()[0]
    pairs = iter(zip(got[1::2], got[2::2], strict=True))
    return Belief(got[0], {r: {v: next(pairs) for v in votes} for r in rules})


def posterior(belief: Belief, votes: Column) -> Column:
    """The chance that a document is good, from its votes, one of each rule in order."""
    ratios = F.lit([by_vote[v][0] / by_vote[v][1] for by_vote in belief.chances.values() for v in (-1, 0, 1)])
    each = F.transform(votes, lambda v, i: F.get(ratios, 3 * i + v + 1))
    odds = F.aggregate(each, F.get(F.lit([belief.prior / (1 - belief.prior)]), F.lit(0)), lambda a, x: a * x)
    return let(odds, lambda o: o / (1 + o))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The features of each document, base_failed, its quality (chance that it is good) and kept.

    base_failed: under 20 words, or over 30% of them in repeated windows. kept: not base_failed, and quality is `least` or
    more. An empty or null text fails. Rows alike are judged alike; extra columns don't matter; an empty table gives no rows.
    """
    found = features(docs)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = written(found.withColumns({"votes": F.array(*[r.vote() for r in RULES]), "base_failed": base_failed}))
    patterns = written(rows.groupBy("votes").agg(F.count("*").alias("n")).coalesce(1))
    belief = estimate(patterns, [r.name for r in RULES])
    out = rows.withColumn("quality", posterior(belief, F.col("votes")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least)).drop("votes")
