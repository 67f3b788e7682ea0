"""Queries with SQL, and the pipeline."""

import collections
import itertools
import random
import re

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from sluice.llm import oracles, pieces, quality, queries
from sluice.llm.common import documents, written
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(oracles.ORACLES[name]).df()
    columns = sorted(want.columns)
    key = lambda df: sorted(map(repr, df[columns].astype(object).map(lambda v: round(float(v), 9) if isinstance(v, (int, float)) else v).itertuples(index=False, name=None)))
    assert sorted(got.columns) == columns and key(got) == key(want)


def test_stages(spark):
    docs, names = documents(spark, SF), documents(spark, SF).columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        counts.append(docs.count())
        assert name == "encoding" or docs.columns == names
    assert counts[0] > counts[1] > counts[2] == counts[3] < counts[4] == counts[5]
    assert len(corpus_pipeline.STAGES) == 5


def test_every_query_has_rows(spark):
    """One for each document, but for the queries on anchors and on words."""
    n = documents(spark, SF).count()
    for name, query in queries.QUERIES.items():
        got = query(spark, SF).count()
        assert got == n or name in ("op11_negatives", "op13_spelling") and got > 0, name


PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def made_documents():
    """A small odd table: toxic texts, exact and near copies, personal data, a hot source, nulls, empty texts, repeated rows."""
    rng = random.Random(21)
    vocabulary = [f"{a}{b}{c}{d}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs" for d in ("", "el", "or")]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, labels = [], []
    for i in range(150):
        words = say(rng.randint(12, 60)).split()
        if i % 5 == 0:
            words[len(words) // 2] = "vile nasty scum"
        text = " ".join(words) + "."
        rows.append((i, text + (f" write to u{i}@mail{i % 3}.example or 10.0.{i}.7" if i % 4 == 1 else ""), "en", "hot" if i % 3 else f"s{i % 4}"))
        labels.append((i, int(i % 5 == 0)))
    for i in range(1, 60, 6):  # exact copies, and copies of which the last word differs
        rows.append((200 + i, rows[i][1], "en", "copies"))
        rows.append((300 + i, " ".join(rows[i][1].split()[:-1]) + " " + say(1), "en", None))
    rows += [(400, "", "en", "hot"), (401, None, "en", "hot"), (402, "one two", "en", "s1"), (403, "One  TWO", "en", "s1"), (None, say(30), "en", "hot"), rows[7], rows[7]]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], labels


def plain_groups(rows, k, percent):
    """Rows to the one of each group of links that stays: the least doc_id, nulls last; of rows alike one."""

    def shingles(text):
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()

    rows = list(dict.fromkeys(rows))
    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    first = {}
    for i, r in enumerate(rows):
        if sets[i]:
            first.setdefault(group[i], []).append(r)
    return [r for i, r in enumerate(rows) if not sets[i]] + [min(rs, key=lambda r: (r[0] is None, r[0])) for rs in first.values()]


def test_stages_against_plain_versions(spark, tmp_path):
    """Each stage on what the one before kept, row by row."""
    rows, labels = made_documents()
    docs = spark.createDataFrame(rows, PLAIN).repartition(3)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, f"file://{tmp_path}"))
        out[name] = [tuple(r) for r in docs.collect()] if name != "encoding" else docs
    key = lambda rs: sorted(rs, key=repr)
    assert key(out["toxicity"]) == key([r for r in rows if "vile" not in (r[1] or "")])
    assert {r[0] for r in out["near_duplicates"] if r[0] is not None and r[0] < 400} <= {i for i, _ in labels}
    assert key(out["near_duplicates"]) == key(plain_groups(out["toxicity"], 5, 80))

    def redacted(text):
        return text and re.sub(r"\bu[0-9]+@mail[0-9]\.example\b", "[email]", re.sub(r"\b10\.0\.[0-9]+\.7\b", "[ip]", text))

    assert key(out["private_data"]) == key([(i, redacted(t), lang, s, None if t is None else len(redacted(t))) for i, t, lang, s, _ in out["near_duplicates"]])
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(out["private_data"], columns=[f.split()[0] for f in PLAIN.split(", ")]).astype({"doc_id": "Int64"}))
    taken = {r[0]: r[1] // r[2] for r in con.execute(f"SELECT doc_id, taken, size FROM ({oracles.ORACLES['op4_mixing']}) WHERE size > 0").fetchall()}
    got = collections.Counter(r for r in out["mixing"] if r[1])
    assert got == collections.Counter({r: taken[r[0]] for r in out["private_data"] if r[1] and taken[r[0]]})
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = key([(r[0], None if r[1] is None else lib.encode(r[1])) for r in out["mixing"]])
    assert key([(r["doc_id"], r["ids"]) for r in out["encoding"].collect()]) == want


def test_kept_of_quality_against_plain(spark):
    """The whole verdict: features, votes, expectation-maximisation and posterior in plain Python."""
    rows, _ = made_documents()
    rows += [(500 + i, "spam " * (20 + i) + "\nspam\nspam\n", "en", "hot", None) for i in range(12)]
    docs = spark.createDataFrame(rows, PLAIN)
    seen = quality.features(docs).collect()
    votes = [tuple(r) for r in quality.features(docs).select(*[rule.vote().alias(rule.name) for rule in quality.RULES]).collect()]
    counts, prior, chances = collections.Counter(votes), 0.8, [dict(quality.START) for _ in quality.RULES]

    def post(v):
        odds = prior / (1 - prior)
        for c, x in zip(chances, v, strict=True):
            odds *= c[x][0] / c[x][1]
        return odds / (1 + odds)

    for _ in range(20):
        p = {v: post(v) for v in counts}
        good, n = sum(p[v] * k for v, k in counts.items()), sum(counts.values())
        side = lambda r, x, f: sum(f(p[v]) * k for v, k in counts.items() if v[r] == x)  # noqa: E731, B023
        fresh = [{x: ((side(r, x, lambda q: q) + quality.START[x][0]) / (good + 1), (side(r, x, lambda q: 1 - q) + quality.START[x][1]) / (n - good + 1)) for x in (1, 0, -1)} for r in range(len(quality.RULES))]
        prior, chances = (good + 1) / (n + 2), fresh
    failed = [r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"] for r in seen]
    want = sorted((str(r["doc_id"]), not bad and post(v) >= 0.5, round(post(v), 6)) for r, v, bad in zip(seen, votes, failed, strict=True))
    assert sorted((str(r["doc_id"]), r["kept"], round(r["quality"], 6)) for r in quality.judge(docs).collect()) == want
    assert {k for _, k, _ in want} == {True, False}
