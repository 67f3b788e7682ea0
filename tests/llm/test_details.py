"""Parts of the document operators against plain versions, and rows that are hard to carry."""

import collections
import os
import random
import re
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import language_model, mixing, pieces, privacy, quality, sharding, similarity, toxicity
from sluice.llm.common import mix, span_hashes

NAMES = "_key _copy _copies _text _kept _ids ids decoded row id hash body one of from seed draw copies rate spans doc key comp".split()


def table(spark, rows):
    return spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "mail a@b.example now please", "x"), (1, "another text under the same id", "y"), (2, None, "x"), (None, "no id here at all", None), (3, "", "y")]
    return table(spark, rows).withColumns({c: F.concat(F.lit(c), F.coalesce("text", F.lit(""))) for c in NAMES})


CARRY = {
    "redact": lambda d: privacy.redact(d),
    "mix": lambda d: mixing.mix(d),
    "one_of_each": lambda d: similarity.one_of_each(d),
    "clean": lambda d: toxicity.clean(d, (np.zeros(toxicity.FEATURES, np.float32), -30.0)),
    "encode": lambda d: pieces.encode(d),
    "decode": lambda d: pieces.decode(pieces.encode(d)),
}


@pytest.mark.parametrize("name", CARRY)
def test_columns_of_any_name_are_carried(clashing, name):
    out = CARRY[name](clashing)
    own = {"encode": {"ids"}, "decode": {"ids", "decoded"}}.get(name, set())
    kept = [c for c in NAMES if c not in own]
    if name in ("redact", "mix", "one_of_each", "clean"):
        assert out.columns == clashing.columns
    want = {tuple(r) for r in clashing.select(kept).collect()}
    got = [tuple(r) for r in out.select(kept).collect()]
    assert set(got) == want and (name == "mix" or len(got) == 5)
    assert CARRY[name](clashing.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    """Each row's own text and source decide."""
    w = " ".join(f"w{i}" for i in range(40))
    kept = similarity.one_of_each(table(spark, [(1, w, "a"), (2, w + " x", "a"), (2, "quite another text of its own", "a"), (5, w, "b")]))
    assert sorted((r["doc_id"], r["text"][:5]) for r in kept.collect()) == [(1, "w0 w1"), (2, "quite")]
    docs = table(spark, [(i, "a b c d", s) for s, n in (("x", 20), ("y", 4), ("z", 2)) for i in range(n)])
    want = collections.Counter({(r["doc_id"], r["source"]): r["copies"] for r in mixing.copies(docs).collect()})
    got = collections.Counter((r["doc_id"], r["source"]) for r in mixing.mix(docs).collect())
    assert got == +want and len({r for r in want.values()}) > 1


def test_pack():
    rng = random.Random(3)
    loads = np.array([[rng.random() for _ in range(3)] for _ in range(60)])
    loads /= loads.sum(axis=0)
    left = [[1 / 4] * 3 for _ in range(4)]
    want = {}
    for i in sorted(range(60), key=lambda i: (-max(loads[i]), i)):
        fits = [all(a - b >= -0.001 for a, b in zip(x, loads[i])) for x in left]
        scores = [sum(a * b for a, b in zip(x, loads[i])) if ok else -1e9 for x, ok in zip(left, fits)]
        want[i] = scores.index(max(scores)) if any(fits) else -1
        if want[i] >= 0:
            left[want[i]] = [a - b for a, b in zip(left[want[i]], loads[i])]
    got = sharding.pack(loads, np.full((4, 3), 1 / 4), 0.001)
    assert got.tolist() == [want[i] for i in range(60)]


def test_groups_that_fit_are_not_cut(spark):
    rng = random.Random(4)
    texts = [f"group {g} of copies " * rng.randint(1, 9) for g in range(30) for _ in range(rng.randint(1, 60))] + [f"one {i} " * rng.randint(1, 40) for i in range(1200)]
    rows = sharding.shard(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    where = collections.defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values()) and len({r["shard"] for r in rows}) == 16
    loads = collections.Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) < 1.1 * min(loads.values())


def test_expectation_maximisation(spark):
    rng = random.Random(5)
    counts = collections.Counter(tuple(rng.choice([1, 1, 0]) if good else rng.choice([-1, 0, -1]) for _ in range(3)) for good in [True] * 80 + [False] * 20)
    df = spark.createDataFrame([(list(v), n) for v, n in counts.items()], "votes array<int>, n long")
    belief = quality.estimate(df, ["a", "b", "c"], rounds=7)
    prior, chances = 0.8, [dict(quality.START) for _ in range(3)]
    post = lambda v: (lambda o: o / (1 + o))(prior / (1 - prior) * np.prod([c[x][0] / c[x][1] for c, x in zip(chances, v)]))
    for _ in range(7):
        p = {v: post(v) for v in counts}
        good, n = sum(p[v] * k for v, k in counts.items()), sum(counts.values())
        fresh = []
        for r in range(3):
            side = lambda x, f: sum(f(p[v]) * k for v, k in counts.items() if v[r] == x)  # noqa: B023, E731
            fresh.append({x: ((side(x, lambda q: q) + quality.START[x][0]) / (good + 1), (side(x, lambda q: 1 - q) + quality.START[x][1]) / (n - good + 1)) for x in (1, 0, -1)})
        prior, chances = (good + 1) / (n + 2), fresh
    assert belief.prior == pytest.approx(prior)
    for name, c in zip("abc", chances):
        assert {k: pytest.approx(v) for k, v in c.items()} == belief.chances[name]
    got = {tuple(r["votes"]): r["p"] for r in df.select("votes", quality.posterior(belief, F.col("votes")).alias("p")).collect()}
    assert got == {v: pytest.approx(post(v)) for v in counts}


def test_bootstrap(spark):
    rng = random.Random(6)
    seeds = {f"v{i}": rng.choice(["email", "phone", None]) for i in range(40)}
    rows = sorted({(f"p{(i * 7 + j) % 9 if rng.random() < 0.5 else i % 4}", f"v{i}") for i in range(40) for j in range(3)})
    # patterns that meet one kind only, and one unknown value each
    rows += [(f"clean-{k}", f"{k}{i}") for k in ("email", "phone") for i in range(9)] + [("clean-email", "new1"), ("next", "new1")] + [("next", f"email{i}") for i in range(9)] + [("next", "new2")]
    seeds |= {f"{k}{i}": k for k in ("email", "phone") for i in range(9)}
    df = spark.createDataFrame([(p, v, seeds.get(v)) for p, v in rows], "pattern string, value string, seed string")
    graph = collections.defaultdict(set)
    for p, v in rows:
        graph[p].add(v)
    graph = {p: vs for p, vs in graph.items() if len(vs) >= 3}
    belief = {v: {seeds[v]: 1.0} for vs in graph.values() for v in vs if seeds.get(v)}
    known, good = dict(belief), {}
    for _ in range(3):
        good = {}
        for p, vs in graph.items():
            for k in ("email", "phone"):
                have = [belief[v][k] for v in vs if k in belief.get(v, {})]
                if len(have) >= 3 and sum(have) / (len(vs) + 1) >= 0.8:
                    good[p, k] = sum(have) / (len(vs) + 1)
        belief = dict(known)
        for v in {v for vs in graph.values() for v in vs if not seeds.get(v)}:
            for k in ("email", "phone"):
                scores = [s for (p, kind), s in good.items() if kind == k and v in graph[p]]
                if scores:
                    belief.setdefault(v, {})[k] = sum(scores) / len(scores)
    got = {(r["pattern"], r["kind"]): r["score"] for r in privacy.bootstrap(df).collect()}
    assert got == {pk: pytest.approx(s) for pk, s in good.items()} and ("clean-email", "email") in got


def test_patterns_on_both_sides_and_recall(spark):
    texts = [f"call {w} at u{i}@mail.example for {v}" for i, (w, v) in enumerate(zip("ab cd ef gh ij kl mn op qr st uv wx".split() * 2, "pq rs tu vw".split() * 6))]
    texts += ["acct2 99-xy for pq", "room 12 of 40"]
    rows = {r["doc_id"]: r["spans"] for r in privacy.digest(privacy.find(table(spark, [(i, t, "s") for i, t in enumerate(texts)]))).collect()}
    assert all("email" in rows[i] for i in range(24)) and rows[25] == ""
    (r,) = privacy.recall(table(spark, [(i, t, "s") for i, t in enumerate(texts)]), hidden=4).collect()
    assert r["seed"] == "email" and r["hidden"] >= 2 and r["found"] == r["right"] == r["hidden"]


def test_a_model_that_lacks_a_file_raises(spark):
    docs = table(spark, [(i, f"some words {i} to count", "s") for i in range(30)])
    model = language_model.train(docs, shards=3)
    folder = model.folder.removeprefix("file://")
    (before, *_), name = language_model.score(docs, model).select(F.sum("score")).first(), "pair-1"
    assert before < 0
    os.rename(f"{folder}/{name}", f"{folder}/away")
    with pytest.raises(Exception, match="of the model"):
        language_model.score(docs, model).collect()
    with open(f"{folder}/{name}", "wb") as f:
        f.write(b"12345678")
    with pytest.raises(Exception, match="of the model"):
        language_model.score(docs, model).collect()


def test_models_that_chunks_cannot_encode_raise():
    with open(pieces.MODEL, "rb") as f:
        p = pieces.Pieces(f.read())
    p.check()
    p.lib = SimpleNamespace(encode=lambda text: [1])
    with pytest.raises(ValueError):
        p.check()


def test_noisy_or(spark):
    """Scores against sentences and words found one by one."""
    rng = np.random.default_rng(7)
    weights = np.where(rng.random(toxicity.FEATURES) < 0.3, rng.normal(0, 2, toxicity.FEATURES), 0).astype(np.float32)
    texts = ["One bad line. Two bad lines! and more\nof THE same same", "", None, "é ü. x", "no stop at all", "..."]
    one = lambda b, k=None: int((span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)])) if k is None else mix(span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([min(k, len(b))])) + np.uint64(k)))[0] % np.uint64(toxicity.FEATURES))
    for r in toxicity.score(table(spark, [(i, t, "s") for i, t in enumerate(texts)]), (weights, -1.0)).collect():
        clean = 1.0
        text = texts[r["doc_id"]] or ""
        for sentence in re.findall(r"[^.!?\n]*[.!?\n]|[^.!?\n]+", text) or [""]:
            words = [re.sub("[A-Z]", lambda m: m.group().lower(), w).encode() for w in re.findall(r"[A-Za-z\u0080-￿]+", sentence)]
            features = {f for w in words for f in (one(w), one(w, 4), one(w, 5))}
            clean *= 1 - 1 / (1 + np.exp(-(sum(float(weights[f]) for f in features) - 1.0)))
        assert r["score"] == pytest.approx(1 - clean, abs=1e-6)


def test_components_in_rounds(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 1000), (300, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    rounds, task = ({r["node"]: r["comp"] for r in similarity.components(df, most_in_a_task=n).collect()} for n in (0, 10**6))
    assert {k: v for k, v in task.items() if k != v} == {k: v for k, v in rounds.items() if k != v}
    assert task[1000] == 0 and task[139] == 100 and task[300] == 200
    with pytest.raises(RuntimeError, match="rounds"):
        similarity.components(df, most_rounds=1, most_in_a_task=0)


def test_salted_tokens_lose_no_link(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(70):
        own = list(base)
        own[rng.randrange(50)] = f"x{rng.randrange(30)}"
        texts.append(" ".join(own))
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)])
    plain = sorted(map(tuple, similarity.groups(docs, percent=80, hot=10**9).collect()))
    assert sorted(map(tuple, similarity.groups(docs, percent=80, hot=1, block=9).collect())) == plain
    assert max(r[3] for r in plain) > 30


def test_hashes_of_spans_in_long_codes():
    """Equal spans have equal hashes wherever they lie, across the steps of the sums too, and other spans have others."""
    piece = np.random.default_rng(3).integers(0, 256, 70_000).astype(np.uint8)
    codes = np.concatenate([piece, piece[:7], piece, piece[:-1]])
    start = np.array([0, 70_007, 140_007, 140_007, 5, 65_530, 135_537])
    end = start + [70_000, 70_000, 69_999, 10, 10, 12, 12]
    got = span_hashes(codes, start, end).tolist()
    assert got[0] == got[1] and got[5] == got[6]
    assert len(set(got)) == 5
    short = span_hashes(codes[5:15], np.array([0, 3, 3]), np.array([10, 3, 4])).tolist()
    assert short[0] == got[4] and len(set(short)) == 3
