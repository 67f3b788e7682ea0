"""Operator 5: personal data by patterns, and by contexts learnt from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import SPACE, let, written
from sluice.llm.spans import SPAN, count, joined, matches, spans

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _card(value: Column) -> Column:
    """13 to 19 digits that pass Luhn's test."""
    d = F.reverse(_digits(value))
    weighed = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    luhn = F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0
    return F.when(F.length(d).between(13, 19), luhn).otherwise(F.lit(False))


#: (kind, pattern, test of a match). Possessive quantifiers and look-behinds keep long runs from being tried again and again; they
#: leave the matches as they are, since what a run is followed by does not depend on where in it a match starts.
KINDS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", _card),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(_digits(v)).between(9, 15)),
)
BASE = tuple(k for k, _, _ in KINDS)
#: Words with a digit or an at sign: what an identifier may look like. Marks at the end stay outside.
_CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@](?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.,;:!?)\"'])?"
_KNOWN = "array<struct<start:bigint,end:bigint,value:string,patterns:array<string>,seed:string>>"
REACH = 3  # words on either side that a pattern may have


def base_spans(text: Column) -> Column:
    return F.concat(F.array().cast(SPAN), *[spans(text, k, i, p, keep=test) for i, (k, p, test) in enumerate(KINDS)])


def _folded(value: Column) -> Column:
    """In small letters, with each digit as 0: words alike but for their numbers are one context."""
    return F.regexp_replace(F.lower(value), "[0-9]", "0")


def _shape(value: Column) -> Column:
    """Runs of letters as a, of digits as 0; other characters stay."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]+", "0")


def _patterns(left: Column, right: Column, value: Column) -> Column:
    """What an instance is met by: the one to REACH words before it, the one to REACH words after it, the word on both
    sides, and the word before with the value's shape. left and right have their nearest words last and first."""
    n, m = F.size(left), F.size(right)
    before = [F.when(n >= k, F.concat(F.lit(f"{k}<"), F.array_join(F.slice(left, -k, k), " "))) for k in range(1, REACH + 1)]
    after = [F.when(m >= k, F.concat(F.lit(f"{k}>"), F.array_join(F.slice(right, 1, k), " "))) for k in range(1, REACH + 1)]
    last, first = F.element_at(left, -1), F.element_at(right, 1)
    both = [F.when((n > 0) & (m > 0), F.concat(F.lit("<>"), last, F.lit(" "), first)), F.when(n > 0, F.concat(F.lit("<~"), last, F.lit(" "), _shape(value)))]
    return F.array_compact(F.array(*before, *after, *both))


def _instances(text: Column, base: Column) -> Column:
    """Candidate words with their patterns, in small letters, and the kind of base span that starts there.

    The words around come from the pieces of text between candidates, whole, and where these are too short from the
    neighbouring candidate, digits folded. Candidates inside a base span but not at its start are part of it and left out.
    """

    def words_of(piece: Column) -> Column:
        return F.filter(F.split(_folded(piece), SPACE + "+"), lambda w: w != "")

    def placed(found: Column, tail: Column) -> Column:
        pieces = F.concat(F.transform(found, lambda m: words_of(m["piece"])), F.array(words_of(tail)))
        values = F.transform(found, lambda m: _folded(m["value"]))
        return let(pieces, lambda p: let(values, lambda v: F.transform(found, lambda m, i: one(m, i, p, v))))

    def one(m: Column, i: Column, pieces: Column, values: Column) -> Column:
        left = F.concat(F.when(i > 0, F.array(F.get(values, i - 1))).otherwise(F.array().cast("array<string>")), pieces[i])
        right = F.concat(F.get(pieces, i + 1), F.when(i + 1 < F.size(values), F.array(F.get(values, i + 1))).otherwise(F.array().cast("array<string>")))
        own = F.filter(base, lambda s: (s["start"] < m["end"]) & (s["end"] > m["start"]))
        here = F.filter(own, lambda s: s["start"] == m["start"])
        kind = F.when(F.size(own) > 0, F.when(F.size(here) > 0, F.get(here, F.lit(0))["kind"]).otherwise(F.lit("part")))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lower(m["value"]).alias("value"), _patterns(left, right, m["value"]).alias("patterns"), kind.alias("seed"))

    tail = F.element_at(F.split(text, _CANDIDATE, -1), -1)
    found = let(matches(text, _CANDIDATE), lambda ms: placed(ms, tail))
    found = F.filter(found, lambda x: ~x["seed"].eqNullSafe(F.lit("part")))
    return F.when(text.rlike("[0-9@]"), found).otherwise(F.array().cast(_KNOWN))


def bootstrap(instances: DataFrame, rounds: int = 3, least: float = 0.8, support: int = 3) -> DataFrame:
    """(pattern, kind): the patterns that tell of a kind with confidence `least` or more.

    instances (pattern, value, seed). The graph joins each pattern with the distinct values that it met. A value that a base
    pattern found is known for its kind with belief 1. Each round scores a pattern for a kind by the sum of its values' beliefs
    over their number and one, so that few values are not trusted, if `support` of them at least are believed in; then
    each other value takes the mean score of its good patterns as its belief. Values count once, however often they occur,
    so copies don't add weight. An empty table gives no patterns.
    """
    graph = written(instances.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    patterns = written(graph.groupBy("pattern").agg(F.count("*").alias("values")).filter(F.col("values") >= support))
    graph = written(graph.join(patterns.select("pattern"), "pattern", "left_semi"))  # patterns of fewer values can never be good
    seeds = graph.filter("seed IS NOT NULL").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
    belief, good = seeds, None
    for _ in range(rounds):
        met = graph.select("pattern", "value").join(belief, "value").groupBy("pattern", "kind").agg(F.sum("belief").alias("belief"), F.count("*").alias("believed"))
        scored = met.join(patterns, "pattern").select("pattern", "kind", "believed", (F.col("belief") / (F.col("values") + 1)).alias("score"))
        good = written(scored.filter((F.col("score") >= least) & (F.col("believed") >= support)))
        fresh = graph.filter("seed IS NULL").select("pattern", "value").join(good, "pattern").groupBy("value", "kind").agg(F.avg("score").alias("belief"))
        belief = written(seeds.unionByName(fresh))
    return good.groupBy("pattern").agg(F.max(F.struct("score", "kind")).alias("m")).select("pattern", F.col("m.kind").alias("kind"), F.col("m.score").alias("score"))


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, found) of each row of docs: the base spans and the candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.when(text.rlike("[0-9@]"), base_spans(text)).otherwise(F.array().cast(SPAN))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"), marked.alias("base"))
    return written(rows.select("doc_id", "text_key", "base", _instances(F.col("text"), F.col("base")).alias("found")))


def _each(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("found") > 0).select("doc_id", "text_key", F.explode("found").alias("f")).select("doc_id", "text_key", "f.*")


def _by_pattern(each: DataFrame) -> DataFrame:
    return each.withColumn("pattern", F.explode("patterns")).drop("patterns")


def _discovered(each: DataFrame, good: DataFrame) -> DataFrame:
    """each instance that a good pattern meets, with the kind of the best of them."""
    met = _by_pattern(each).join(good, "pattern")
    keys = [c for c in each.columns if c != "patterns"]
    return met.groupBy(*keys).agg(F.max(F.struct("score", "kind")).alias("m")).select(*keys, F.col("m.kind").alias("kind"))


def recall(docs: DataFrame, hidden: int = 5, **how) -> DataFrame:
    """(seed, hidden, found, right): of each kind, how many distinct values of base spans are hidden (one in `hidden`, by hash), how many
    of them the patterns of the others discover, and how many as their own kind. Null texts have no values and repeated rows count
    once a value; an empty table, or one without spans, gives no rows; extra columns don't matter."""
    each = _each(_marked(docs))
    gone = F.col("seed").isNotNull() & (F.pmod(F.xxhash64("value"), F.lit(hidden)) == 0)
    good = bootstrap(_by_pattern(each.withColumn("seed", F.when(~gone, F.col("seed")))), **how)
    told = _discovered(each.filter(gone), good).groupBy("seed", "value").agg(F.max((F.col("kind") == F.col("seed")).cast("int")).alias("right"))
    both = each.filter(gone).select("seed", "value").distinct().join(told, ["seed", "value"], "left")
    return both.groupBy("seed").agg(F.count("*").alias("hidden"), F.count("right").alias("found"), F.coalesce(F.sum("right"), F.lit(0)).alias("right"))


def find(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, text_key, base, learnt) of each row of docs: the spans of the base kinds, and those that patterns add.

    Added are candidate words outside all base spans that a good pattern meets; their kind is near_ and the kind that the best
    pattern tells of. text_key is the text's xxhash64, so rows that share a doc_id are told apart; rows alike in both have the
    same spans. Null and empty texts have none. Extra columns don't matter; an empty table gives no rows.
    """
    rows = _marked(docs)
    each = _each(rows)
    good = bootstrap(_by_pattern(each), **how)
    order = len(BASE) + F.array_position(F.array(*map(F.lit, BASE)), F.col("kind")).cast("int") - 1
    span = F.struct("start", order.alias("order"), "end", F.concat(F.lit("near_"), "kind").alias("kind"))
    new = _discovered(each.filter("seed IS NULL"), good).select("doc_id", "text_key", span.alias("s"))
    new = new.groupBy("doc_id", "text_key").agg(F.collect_set("s").alias("learnt"))  # spans of one text
    out = rows.alias("r").join(new.alias("n"), F.col("r.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("r.text_key") == F.col("n.text_key")), "left")
    return out.select("r.doc_id", "r.text_key", "base", F.coalesce("learnt", F.array().cast(SPAN)).alias("learnt"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and the text of all spans, for each row of find(): one without spans has zeros, the hash of
    nothing and an empty text; repeated rows give repeated results, null ids stay."""
    base = joined(F.col("base"), by_kind=True)
    return found.select("doc_id", *[count(F.col("base"), k).alias(f"n_{k}") for k in BASE], F.sha2(base, 256).alias("base_sha256"), joined(F.concat("base", "learnt"), by_kind=True).alias("spans"))


def redact(docs: DataFrame, **how) -> DataFrame:
    """docs with each span of personal data replaced by its kind in square brackets; n_chars follows where there is one.

    Of overlapping spans the one that starts first, and then is longest, counts. Null texts stay null; other columns, of any
    name, stay as they are; an empty table gives no rows.
    """
    found = find(docs, **how).filter(F.size("base") + F.size("learnt") > 0).select("doc_id", "text_key", F.concat("base", "learnt").alias("spans")).dropDuplicates(["doc_id", "text_key"])
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("body"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    both = packed.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_key")), "left").select("row", "body", "spans")
    cut = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.col("body")

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] < a["at"], a).otherwise(F.struct((-s["back"]).alias("at"), F.concat(a["out"], F.array(piece)).alias("out")))

    joined_up = F.aggregate(cut, begin, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    out = both.select("row", F.when(F.col("spans").isNull(), text).otherwise(joined_up).alias("text"))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[own[c].alias(c) if c in own else F.col("row").getField(c).alias(c) for c in docs.columns])
