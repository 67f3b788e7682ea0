"""Operators 11 to 13 against plain versions, and their odd cases."""

import collections
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest

from sluice.llm import licenses, negatives, oracles, queries, spelling
from tests.conftest import SF

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_negatives(rows, is_anchor):
    """rows: distinct (vec_id, label, q)."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in itertools.zip_longest(a, b, fillvalue=0))
    for anchor in (r for r in rows if is_anchor(r[0])):
        by = sorted((-dot(anchor[2], r[2]), r[0], r[1]) for r in rows if r is not anchor)
        for s, p, _ in [x for x in by if x[2] == anchor[1]][:5]:
            fit = [x for x in by if x[2] != anchor[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(anchor[0], p, k + 1, n, -s, -m) for k, (m, n, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["dense", "sparse", "ties", "negative"])
def test_negatives_against_plain(spark, kind):
    g = np.random.default_rng(5)
    n, d = 240, 11
    q = g.integers(-40, 41, (n, d))
    if kind == "sparse":
        q[g.random((n, d)) < 0.8] = 0
    if kind == "ties":
        q[:] = q[g.integers(0, 3, n)]  # a third of the rows alike
    if kind == "negative":
        q = np.where(np.arange(n)[:, None] % 20 == 0, -abs(q), abs(q))
    rows = [(i, int(g.integers(0, 3)), [int(x) for x in q[i]][: d - i % 2]) for i in range(n)]
    df = spark.createDataFrame(rows + rows[:30], "vec_id long, label int, q array<bigint>").repartition(3)  # repeated rows count once
    got = negatives.mine(df, "vec_id % 20 = 0", most_anchors=5).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(rows, lambda i: i % 20 == 0)


def test_pairs_above_finds_all():
    g = np.random.default_rng(1)
    x, a = g.integers(-9, 10, (300, 17)).astype(float), g.integers(-9, 10, (40, 17)).astype(float)
    for least in (-1e9, -50.0, 0.0, 120.0, 500.0, 1e9):
        t = np.full(40, least)
        t[::3] += 30
        r, c, s = negatives.pairs_above(negatives._side(x), negatives._side(a), t)
        want = {(i, j): v for (i, j), v in np.ndenumerate(x @ a.T) if v >= t[j]}
        assert {(i, j): v for i, j, v in zip(r, c, s, strict=True)} == want


def test_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, 1, [1.0]), (1, None, [1.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [nan]), (5, 1, [inf]), (6, 1, []), (7, 1, [0.5, -0.001])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS q", "2 AS key")
    assert [tuple(r) for r in negatives.scaled(df).orderBy("vec_id").collect()] == [(6, 1, []), (7, 1, [128, -1])]
    assert negatives.mine(negatives.scaled(df.limit(0)), "true").collect() == []
    # one vec_id with two labels: each row is one of its own
    two = spark.createDataFrame([(0, 1, [5]), (0, 2, [5]), (1, 1, [5]), (2, 2, [4])], "vec_id long, label int, q array<bigint>")
    got = sorted(tuple(r) for r in negatives.mine(two, "vec_id = 0").collect())
    assert got == [(0, 1, 1, 0, 25, 25), (0, 1, 2, 2, 25, 20)]
    big = spark.createDataFrame([(0, 1, [2**40])], "vec_id long, label int, q array<bigint>")
    with pytest.raises(ValueError, match="53 bits"):
        negatives.mine(big, "true")


def test_negatives_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    got = queries.QUERIES["op11_negatives"](spark, SF).collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(oracles.ORACLES["op11_negatives"]).fetchall()) != []


@pytest.mark.parametrize(
    "line,tokens,labels,asks",
    [
        (" mit or apache-2.0 and gpl-3.0-only", "mit or apache-2.0 and gpl-3.0-only", "apache-2.0,gpl-3.0-only,mit", 0.2),
        (" (mit or apache-2.0) and gpl-3.0-only.", "( mit or apache-2.0 ) and gpl-3.0-only", "apache-2.0,gpl-3.0-only,mit", 0.8),
        (" gpl-2.0+ with classpath-exception-2.0 or licenseref-x", "gpl-2.0+ with classpath-exception-2.0 or licenseref-x", "gpl-2.0+,licenseref-x", 0.6),
        (" mit and (bsd-3-clause", "mit", "mit", 0.2),
        (" mit or", "mit", "mit", 0.2),
        (" mit isc", "mit", "mit", 0.2),
        (" ((mit))", "( ( mit ) )", "mit", 0.2),
        (" and mit", "", None, None),
        (" )", "", None, None),
        ("", "", None, None),
    ],
)
def test_expressions(line, tokens, labels, asks):
    found = licenses.tokens(line)
    assert " ".join(found) == tokens
    value = licenses.evaluate(found)
    assert (value and (",".join(sorted(value.labels)), value.asks)) == (labels and (labels, asks))


def test_licenses_against_plain(spark):
    g = np.random.default_rng(2)
    pool = "gnu general public license GNU License apache cc by BY mit é1 ß x9 MIT ccby".split()
    join = [" ", "  ", "-", "\n", "_", ". ", "\x00"]
    texts = ["".join(pool[g.integers(len(pool))] + join[g.integers(len(join))] for _ in range(g.integers(0, 60))) for _ in range(80)] + [None, "", "cc by cc by", "Mit License"]
    texts += ["a " * 3_000_000 + "MIT License", "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "cc by")], "doc_id long, text string").selectExpr("*", "1 AS found", "2 AS n_words")
    got = {r["doc_id"]: tuple(r)[1:6] for r in licenses.digest(licenses.scan(df)).collect()}
    for i, t in [*enumerate(texts), (None, "cc by")]:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        hits = [(k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in hits]
        assert got[i] == (len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))), i
    assert licenses.digest(licenses.scan(df.limit(0))).collect() == []


def test_license_labels_and_score(spark):
    texts = ["// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 */ rest", "Licensed under CC BY-NC 4.0.", "nothing", "SPDX-License-Identifier:\nMIT"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned = licenses.scan(df).orderBy("doc_id").collect()
    assert [(e["start"], e["expression"]) for e in scanned[0]["expressions"]] == [(0, "(mit or gpl-2.0-only) and apache-2.0")]
    got = [(r["labels"], r["score"]) for r in licenses.digest(licenses.scan(df)).orderBy("doc_id").collect()]
    assert got == [("apache-2.0,gpl-2.0-only,mit", 0.3), ("cc-by,cc-by-nc,cc-by-nc-4.0", 0.8), ("", 0.0), ("", 0.0)]


def plain_variants(n, times=5):
    near = {w: {v for v in n if v != w and (len(v) == len(w) and sum(a != b for a, b in zip(v, w, strict=True)) == 1 or abs(len(v) - len(w)) == 1 and one_less(v, w))} for w in n}
    form = {w: b for w in n if near[w] and n[b := min(near[w], key=lambda x: (-n[x], x))] >= times * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n), key=repr)


def one_less(a, b):
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


@pytest.mark.parametrize("how", [{}, {"sample_words": 60, "leaf_words": 40, "searches": 25}])
def test_variants_against_plain(spark, how):
    """Anagrams, letters beyond ASCII, chains of forms, and a hot leaf dealt to several tasks."""
    g = np.random.default_rng(3)
    words = {"".join(g.choice(list("abcé"), g.integers(6, 9))) for _ in range(400)} | {"aaaaaaaaaaaaa", "aaaaaaaaaaaab", "×÷×÷×÷", "×÷×÷×é"}
    n = {w: int(5 ** g.integers(1, 7)) for w in sorted(words)}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3), **how).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_variants(n)


def test_vocabulary(spark):
    texts = ["Wordle wordlé WORDLE x" * 3, None, "", "é" * 5 + " " + "abcdef" * 2000, "abcdéf1abcdef_abcdefg" * 40] * 5
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS run", "2 AS word")
    for one_in in (199, 2):
        want = collections.Counter()
        for i, t in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                run = run.translate(LOW)
                h = zlib.crc32(f"{i}:{run}".encode())
                want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
        want = {w: c for w, c in want.items() if c >= 5 and len(w) >= 6}
        assert {r["word"]: r["n"] for r in spelling.vocabulary(df, one_in=one_in).collect()} == want
    assert spelling.grouped(df.limit(0)).collect() == []


def test_spelling_query_against_plain(spark):
    """The whole query on the smallest tables: near words by shared patterns instead of trees."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    n = collections.Counter()
    for r in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}
    got = queries.QUERIES["op13_spelling"](spark, SF).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_variants(n)
