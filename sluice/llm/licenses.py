"""Operator 12: license scans. One automaton finds identifier tags, another notice phrases; a parser evaluates expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import parts

# Base phrases and labels, and public license identifiers.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "apache software license": "apache",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl-1.0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc0": "cc0-1.0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0-1.0",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
# End of the fixed values.

#: How much a license asks, by the beginning of its label; the longest one that fits counts, others ask UNKNOWN.
ASKS = {
    "public-domain": 0.1, "cc0": 0.1, "unlicense": 0.1, "0bsd": 0.1, "mit": 0.2, "bsd": 0.2, "isc": 0.2, "zlib": 0.2, "bsl": 0.2, "apache": 0.3,
    "cc-by": 0.3, "mpl": 0.5, "epl": 0.5, "lgpl": 0.5, "cc-by-sa": 0.6, "cc-by-nd": 0.8, "cc-by-nc": 0.8, "gpl": 0.8, "agpl": 0.9, "proprietary": 1.0,
}
UNKNOWN, EXCEPTION = 0.7, 0.2
_POWER = {"with": 3, "and": 2, "or": 1}
_STOP = re.compile(r"[\r\n]|\*/|-->")
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*(?::[a-z0-9][a-z0-9.+-]*)?)")

FOUND = "array<struct<label:string,start:bigint,words:int,kind:string,asks:double>>"
EXPRESSIONS = "array<struct<start:bigint,expression:string,labels:array<string>,asks:double>>"


def asks(label: str) -> float:
    """How much a license asks of its users: 0.1 for public domain to 1 for all rights reserved."""
    fits = [p for p in ASKS if label == p or label.startswith(p + "-") or label.startswith(p + "+")]
    return ASKS[max(fits, key=len)] if fits else UNKNOWN


class Value(NamedTuple):
    """labels: the licenses that an expression names; asks: of `or` the least, of `and` the most, an exception lowers it."""

    labels: frozenset[str]
    asks: float


def _apply(op: str, a: Value, b: Value) -> Value:
    if op == "with":  # b names an exception, no license
        return Value(a.labels, max(0.0, round(a.asks - EXCEPTION, 6)))
    return Value(a.labels | b.labels, (min if op == "or" else max)(a.asks, b.asks))


def tokens(line: str) -> list[str]:
    """The tokens of the longest whole expression that begins a line of lower-case text; none if there is none.

    Operands and operators alternate and parentheses close; what comes after the last place where that holds is left out.
    """
    out: list[str] = []
    at = depth = whole = 0
    operand = True  # whether an operand comes next
    while m := _TOKEN.match(line, at):
        t = m.group(1)
        if operand != (t not in _POWER and t != ")") or t == ")" and not depth:
            break
        if t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
        else:
            operand = t in _POWER
        out.append(t if t in "()" else t.rstrip(".-:"))
        at = m.end()
        if not operand and not depth:
            whole = len(out)
    return out[:whole]


def evaluate(found: list[str]) -> Value | None:
    """The value of a whole expression's tokens, by two stacks: `with` binds before `and`, that before `or`."""
    values: list[Value] = []
    ops: list[str] = []

    def until(least: int) -> None:
        while ops and ops[-1] != "(" and _POWER[ops[-1]] >= least:
            b, a = values.pop(), values.pop()
            values.append(_apply(ops.pop(), a, b))

    for t in found:
        if t == "(":
            ops.append(t)
        elif t == ")":
            until(0)
            ops.pop()
        elif t in _POWER:
            until(_POWER[t])
            ops.append(t)
        else:
            values.append(Value(frozenset([t]), asks(t)))
    until(0)
    return values[0] if values else None


@cache
def _automaton(kind: str) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    if kind == "tags":
        for t in TAGS:
            out.add_word(t, t)
    else:
        for phrases, name in ((NOTICES, "notice"), (BASE, "base")):
            for p, label in phrases.items():
                out.add_word(f" {p} ", (label, len(p.split()), name, len(p) + 1))
    out.make_automaton()
    return out


#: Bytes to lower case, and to words with spaces between.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def scan_text(raw: bytes) -> tuple[int, list[dict], list[dict]]:
    """The number of words, the places of phrases and the expressions of a text in UTF-8."""
    lower = raw.translate(_LOWER)
    spaced = np.frombuffer(b" " + lower.translate(_WORDS) + b" ", np.uint8)
    keep = np.ones(len(spaced), bool)
    keep[1:] = (spaced[1:] != 32) | (spaced[:-1] != 32)  # one space between words
    line = spaced[keep]
    starts = np.flatnonzero(line[:-1] == 32) + 1 if len(line) > 1 else np.zeros(0, np.int64)
    found, said = [], []
    if len(starts):
        # one character a byte, so places are those of bytes
        for end, (label, n, kind, size) in _automaton("phrases").iter(line.tobytes().decode("latin-1")):
            found.append({"label": label, "start": int(np.searchsorted(starts, end - size + 1)), "words": n, "kind": kind, "asks": asks(label)})
    text = lower.decode("latin-1")
    places = np.flatnonzero((spaced[1:] != 32) & (spaced[:-1] == 32))  # of words in the text itself
    for end, tag in _automaton("tags").iter(text):
        stop = _STOP.search(text, end + 1)
        expression = tokens(text[end + 1 : stop.start() if stop else len(text)])
        if expression:
            value = evaluate(expression)
            written = " ".join(expression).replace("( ", "(").replace(" )", ")")
            at = int(np.searchsorted(places, end + 1 - len(tag)))
            said.append({"start": at, "expression": written, "labels": sorted(value.labels), "asks": value.asks})
    return len(starts), found, said


_TYPES = {
    "n_words": pa.int64(),
    "found": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int32()), ("kind", pa.string()), ("asks", pa.float64())])),
    "expressions": pa.list_(pa.struct([("start", pa.int64()), ("expression", pa.string()), ("labels", pa.list_(pa.string())), ("asks", pa.float64())])),
}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, "text"):
            rows = [scan_text(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part["text"]]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES.values())]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *cols], ["doc_id", *_TYPES])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, found, expressions) of each row of docs.

    found: the places of all phrases (label, start in words from 0, words, kind base or notice, what it asks), overlapping ones too;
    expressions: those behind identifier tags (start of the tag in words, the expression, its licenses, what it asks).
    Whole texts are read; a null text counts as empty, and has no words, places or expressions. Repeated rows give repeated
    results, null ids stay null; an empty table gives no rows; extra columns, whatever their names, don't matter.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, f"doc_id {kind}, n_words long, found {FOUND}, expressions {EXPRESSIONS}")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, places and labels of scan's rows. score: the most that any place or expression asks, 0 where there is none."""
    base = F.filter("found", lambda x: x["kind"] == "base")
    starts = F.transform(base, lambda x: x["start"])
    listed = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    said = F.flatten(F.transform("expressions", lambda e: e["labels"]))
    labels = F.transform("found", lambda x: x["label"])
    most = lambda xs: F.coalesce(F.array_max(F.transform(xs, lambda x: x["asks"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(F.transform(base, lambda x: x["label"])).alias("base_labels"), listed(F.concat(labels, said)).alias("labels"), F.greatest(most("found"), most("expressions")).alias("score"),
    )
