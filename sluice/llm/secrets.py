"""Operator 1: secret scans with a trigram index."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import written
from sluice.llm.spans import SPAN, count, joined, spans

try:
    from re import _constants as sre, _parser as parser  # Python 3.11 and later
except ImportError:
    import sre_constants as sre
    import sre_parse as parser


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  # characters of the group


#: The first three are the base rules; the order is that of kinds at one start.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("login", r"://[^\s/:@]{1,64}:[^\s/@]{3,128}@"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/=-]{16,}"),
)
BASE = ("assign", "access", "hex")
_MOST_STRINGS = 64

#: A query: all of its clauses must hold; a clause holds if all trigrams of one of its branches occur.
Query = list[list[frozenset[str]]]


def _flush(run: set[str], out: Query) -> None:
    """The clause that one of these strings occurs; none if one of them has no trigram."""
    branches = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
    if frozenset() not in branches:
        out.append([b for b in sorted(branches, key=sorted) if not any(c < b for c in branches)])


def _finite(nodes) -> set[str] | None:
    """All strings, in lower case, that these nodes match; None if they are endless or many."""
    strings = {""}
    for op, of in nodes:
        if op == sre.LITERAL:
            ways = {chr(of).lower()}
        elif op == sre.IN and all(o == sre.LITERAL for o, _ in of):
            ways = {chr(c).lower() for _, c in of}
        elif op == sre.SUBPATTERN:
            ways = _finite(of[3])
        elif op == sre.BRANCH:
            parts = [_finite(b) for b in of[1]]
            ways = None if None in parts else set().union(*parts)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and of[:2] == (0, 1) and (inner := _finite(of[2])) is not None:
            ways = inner | {""}
        else:
            ways = None
        if ways is None or len(strings) * len(ways) > _MOST_STRINGS:
            return None
        strings = {s + t for s in strings for t in ways}
    return strings


def _walk(nodes, run: set[str], out: Query) -> set[str]:
    """Adds to out what the nodes demand. run: the strings of which one ends before them; returns those after."""
    for op, of in nodes:
        ways = _finite([(op, of)])
        if ways is not None and len(ways) * len(run) <= _MOST_STRINGS:
            run = {a + b for a in run for b in ways}
        elif op == sre.SUBPATTERN:
            run = _walk(of[3], run, out)
        else:
            if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and of[0]:
                run = _walk(of[2], run, out)  # it occurs once at least
            _flush(run, out)
            run = {""}
    return run


def trigram_query(pattern: str) -> Query:
    """What a text in lower case must contain to match; no clause: any text may match, so the rule scans all."""
    out: Query = []
    _flush(_walk(parser.parse(pattern), {""}, out), out)
    return out


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index (trigram, doc_id) of the texts in lower case, for the trigrams that some query names."""
    found = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]))
    # explode() would add a filter on the size of the array, and so look for every trigram twice
    return docs.select("doc_id", F.lower("text").alias("low")).select("doc_id", F.explode_outer(found).alias("trigram")).filter("trigram IS NOT NULL")


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(doc_id, rules): the rules of which a document has all clauses, by intersecting the postings.

    One group for a document, rule, clause and branch counts the trigrams that meet; one for a document and rule counts clauses.
    """
    terms = [(rule, c, b, t, len(branch), len(query)) for rule, query in queries.items() for c, clause in enumerate(query) for b, branch in enumerate(clause) for t in sorted(branch)]
    terms = postings.sparkSession.createDataFrame(terms, "rule string, clause int, branch int, trigram string, need int, clauses int")
    met = postings.join(F.broadcast(terms), "trigram").groupBy("doc_id", "rule", "clause", "branch", "need", "clauses").agg(F.count_distinct("trigram").alias("n")).filter("n = need")
    full = met.groupBy("doc_id", "rule", "clauses").agg(F.count_distinct("clause").alias("n")).filter("n = clauses")
    return full.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _spans(rule: Rule, order: int, text: Column) -> Column:
    return spans(text, rule.kind, order, rule.pattern, rule.group, (lambda v: F.length(v) >= rule.least) if rule.least else None)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, most_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, spans) of each row of docs: array of (start, order, end, kind) by start, then rule.

    A rule with a trigram query is tried only on the documents that the index finds; each row's own text decides, so
    rows that share a doc_id are safe. A rule without mandatory trigrams scans every text. Null and empty texts have no
    spans; a row with a null doc_id is scanned with all rules. The candidates (an id and rules each) are written; up to
    most_broadcast of them go to the texts, so that no text is shuffled, and more meet the texts in a shuffle. Extra columns don't
    matter; an empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for clause in q for branch in clause for t in branch})
    found = written(candidates(index(docs.filter("doc_id IS NOT NULL"), trigrams), queries))
    found = F.broadcast(found) if found.count() <= most_broadcast else found
    empty = F.array().cast(SPAN)
    all_scans = F.concat(empty, *[_spans(r, i, F.col("text")) for i, r in enumerate(rules) if r.kind not in queries])
    tried = F.concat(empty, *[F.when(F.col("doc_id").isNull() | F.array_contains("rules", r.kind), _spans(r, i, F.col("text"))).otherwise(empty) for i, r in enumerate(rules) if r.kind in queries])
    out = docs.join(found, "doc_id", "left")
    tried = F.when(F.col("doc_id").isNull() | F.col("rules").isNotNull(), tried).otherwise(empty)
    return out.select("doc_id", F.array_sort(F.concat(all_scans, tried)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and the text of all spans, for each row of scan(): one without spans has zeros, the hash of
    nothing and an empty text; repeated rows give repeated results, null ids stay."""
    s = F.col("spans")
    base = joined(F.filter(s, lambda x: x["kind"].isin(*BASE)))
    return scanned.select("doc_id", *[count(s, k).alias(f"n_{k}") for k in BASE], F.sha2(base, 256).alias("base_sha256"), joined(s).alias("spans"))


