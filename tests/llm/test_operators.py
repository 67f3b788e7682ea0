"""The document operators against plain versions on small and odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import fingerprints, language_model, mixing, pieces, privacy, quality, queries, secrets, sharding, similarity, toxicity
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "a", "é😀", "one two three", "x" * 70_000, "the same text of a few words here", "the same text of a few words here", "a\nb\na\n\nb"]


def words(text):
    return WORD.findall(text or "")


def table(spark, texts, sources=None, schema=PLAIN):
    rows = [(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, a null id, and columns whose names clash with ones used inside."""
    docs = table(spark, ODD)
    docs = docs.union(docs.filter("doc_id = 7")).union(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    return docs.withColumns({c: F.lit(1) for c in ("node", "n", "rules", "spans", "key", "block", "token", "size", "copies", "w", "l", "k")})


@pytest.mark.parametrize("run", [
    lambda d: secrets.digest(secrets.scan(d)), lambda d: quality.judge(d), lambda d: mixing.copies(d), lambda d: privacy.digest(privacy.find(d)), lambda d: sharding.shard(d), lambda d: language_model.score(d, language_model.train(d)), lambda d: similarity.groups(d), lambda d: fingerprints.fingerprints(d),
    lambda d: pieces.decode(pieces.encode(d)), lambda d: toxicity.score(d, toxicity.train(d, d.selectExpr("doc_id", "int(doc_id % 2) AS toxic"))), lambda d: privacy.redact(d),
], ids=["secrets", "quality", "mixing", "privacy", "sharding", "language_model", "similarity", "fingerprints", "pieces", "toxicity", "redact"])
def test_odd_and_empty_tables(spark, odd, run):
    assert run(odd).count() == len(ODD) + 2
    assert run(odd.limit(0)).count() == 0


def test_secrets_against_python(spark):
    random.seed(1)
    bits = ["password=", "PassWord: ", "secret:token", "token = \"", "api_key=", "apikey:'", "abc", "abcdefgh123", "AKIA", "AKIA" + "Q" * 16, "0123456789abcdef" * 2, " ", "\n", "é", "😀", "gho_" + "a" * 36, "://u:passw@h", "Bearer " + "z" * 20, "="]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 12))) for _ in range(300)] + ["token=abcdef " * 3000]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(table(spark, texts))).collect()}
    for i, text in enumerate(texts):
        found = sorted((m.start(), k, m.end(), rule.kind) for k, rule in enumerate(secrets.RULES) for m in re.finditer(rule.pattern, text) if len(m.group(rule.group)) >= rule.least)
        assert got[i]["spans"] == ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)
        base = ",".join(f"{kind}:{a}:{b}" for a, k, b, kind in found if kind in secrets.BASE)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") == []
    assert secrets.trigram_query("abcd") == [[frozenset({"abc", "bcd"})]]
    assert secrets.trigram_query("(?:abc|xyz)[0-9]+") == [[frozenset({"abc"}), frozenset({"xyz"})]]
    assert secrets.trigram_query("x?abc") == [[frozenset({"abc"})]]
    assert secrets.trigram_query("(?:ab|c)") == []


def repeated(ws):
    where = collections.defaultdict(list)
    for i in range(len(ws) - 7):
        where[tuple(ws[i : i + 8])].append(i)
    return len({j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_quality(spark):
    random.seed(2)
    vocabulary = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 9))) for _ in range(400)]
    clean = [" ".join(random.choices(vocabulary, k=80)).capitalize() + "." for _ in range(150)]
    junk = [" ".join(w + "###" for w in random.choices(vocabulary, k=80)) for _ in range(15)] + [" ".join(w.upper() + "!!" for w in random.choices(vocabulary, k=80)) for _ in range(15)]
    loop = [" ".join(vocabulary[:9] * 6), "few words", "x y z\n" * 30]
    rows = quality.judge(table(spark, clean + junk + loop)).orderBy("doc_id").collect()
    for r, t in zip(rows, clean + junk + loop):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_repeat_words"]) == (len(words(t)), sum(map(len, words(t))), len(re.findall(r"[#*$%&|<>]", t)), repeated(words(t)))
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    assert all(r["kept"] for r in rows[:150]) and not any(r["kept"] for r in rows[150:]) and rows[-1]["n_dup_lines"] == 29


def test_mixing_targets_and_draws(spark):
    texts = ["w " * (i % 40 + 1) for i in range(3000)] + [None]
    docs = table(spark, texts, ["b", "a", "c", "c", "c", "c"])
    rows = mixing.copies(docs).collect()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert r["copies"] <= 2
    left, names, cut = 1.5 * sum(sizes.values()), sorted(sizes), {}
    weight = dict(zip(names, (3, 1, 2)))
    while over := [s for s in names if s not in cut and left * weight[s] / sum(weight[x] for x in names if x not in cut) > 2 * sizes[s]]:
        cut |= {s: 2 * sizes[s] for s in over}
        left = 1.5 * sum(sizes.values()) - sum(cut.values())
    want = cut | {s: left * weight[s] / sum(weight[x] for x in names if x not in cut) for s in names if s not in cut}
    assert target == pytest.approx(want) and all(abs(taken[s] - want[s]) < 0.02 * want[s] for s in names)
    assert sorted(map(tuple, mixing.copies(docs).collect())) == sorted(map(tuple, rows))
    assert mixing.mix(docs).count() == sum(r["copies"] for r in rows)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0


def test_mix_takes_null_ids_by_source(spark):
    rows = [(None, source, "a b c") for source, n in (("x", 30), ("y", 10), ("z", 4)) for _ in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = {r["source"]: r["n"] for r in mixing.copies(docs).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    assert len({r["copies"] for r in mixing.copies(docs).collect()}) > 1
    assert {r["source"]: r["count"] for r in mixing.mix(docs).groupBy("source").count().collect()} == {k: v for k, v in want.items() if v}


def test_privacy_base_against_python(spark):
    random.seed(3)
    bits = ["a@b.c", "@", "x.y@z", "..", "1.2.3.4", "300.1.1.1", "007.1.2.3", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (988) 555-2485", "++1234567890", "é", "😀", " ", "\n", "-", "12", ".5", "_x@d.e", "+", "("]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(1, 14))) for _ in range(300)] + ["1" * 30_000, "a" * 30_000 + "@", "1." * 9000, None, ""]
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    test = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15}
    got = {r["doc_id"]: r["base_sha256"] for r in privacy.digest(privacy.find(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in plain.items() if not (k == "email" and len(t or "") > 20_000) for m in re.finditer(p, t or "") if test[k](m.group()))
        assert got[i] == hashlib.sha256(want.encode()).hexdigest()


def test_privacy_learns_contexts(spark):
    texts = [f"please write mailto u{i}@mail.example now" for i in range(8)] + ["please write mailto boss_at_42_example now", "version 2.0 of it", "version 3.1 of it"]
    rows = {r["doc_id"]: r["spans"] for r in privacy.digest(privacy.find(table(spark, texts))).collect()}
    assert rows[8] == "near_email:20:38" and rows[9] == rows[10] == ""
    out = {r["doc_id"]: r for r in privacy.redact(table(spark, texts)).collect()}
    assert out[8]["text"] == "please write mailto [near_email] now" and out[0]["n_chars"] == len(out[0]["text"]) and out[9]["text"] == texts[9]


def test_sharding(spark):
    random.seed(4)
    texts = ["hot copy " * 5] * 900 + ["w " * random.randint(1, 200) for _ in range(1800)]
    rows = sharding.shard(table(spark, texts)).collect()
    shards = collections.defaultdict(list)
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]].encode()) + 1, zlib.crc32(texts[r["doc_id"]].encode()))
        shards[r["shard"]].append(r)
    assert len(shards) == 16 and all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards.values())
    loads = [sum(r["size"] for r in s) for s in shards.values()]
    assert max(loads) < 1.05 * min(loads) and max(map(len, shards.values())) < 1.2 * min(map(len, shards.values()))
    whole = collections.defaultdict(set)
    for r in rows:
        if r["doc_id"] >= 900:  # the hot group can't fit in a shard, all others do
            whole[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in whole.values())


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    cut = lambda t: [*(t.encode().lower().split()), b"</s>"]
    one, two = collections.Counter(), collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            one.update(cut(t))
            two.update(zip([b"<s>", *cut(t)], cut(t)))
    total, kinds, after, begins, follow = sum(one.values()), len(one), collections.Counter(r for _, r in two), collections.Counter(), collections.defaultdict(lambda: [0] * 4)
    for (left, _), n in two.items():
        begins[left] += n
        follow[left][min(n, 3)] += 1
    often = lambda c: language_model._discounts(*[sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])
    low, high = often(after), often(two)
    spare = sum(low[min(v, 3)] for v in after.values())
    for r in queries.op7_language_model(spark, SF).collect():
        base = score = 0.0
        for left, right in zip([b"<s>", *cut(texts[r["doc_id"]])], cut(texts[r["doc_id"]])):
            base += math.log10((one[right] + 0.5) / (total + 0.5 * (kinds + 1)))
            p = (max(after[right] - low[min(after[right], 3)], 0) + spare / (kinds + 1)) / len(two)
            if begins[left]:
                n = two[left, right]
                p = (max(n - high[min(n, 3)], 0) + sum(high[k] * follow[left][k] for k in (1, 2, 3)) * p) / begins[left]
            score += math.log10(p)
        assert (r["base_score"], r["score"], r["train_tokens"]) == (pytest.approx(base), pytest.approx(score), total)


def plain_groups(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset([tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else [])
    top = {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 50)])
def test_similarity(spark, k, percent):
    """Near copies of one text in a crowd, small groups, and texts that share a passage only."""
    random.seed(k)
    vocabulary = [f"w{i}" for i in range(3000)]
    base, passage, texts = random.choices(vocabulary, k=120), random.choices(vocabulary, k=40), []
    for n in range(90):
        own = list(base)
        for _ in range(random.randint(0, 5)):
            own[random.randrange(120)] = random.choice(vocabulary)
        texts.append(" ".join(own))
    for n in range(60):
        own = random.choices(vocabulary, k=random.randint(3, 100))
        texts += [" ".join(own + passage * (n % 2)), " ".join([*own, random.choice(vocabulary)] + passage * (n % 2))]
    texts += ["", None, "a b", "A B", "a b c", texts[0], texts[0].upper()]
    random.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similarity.groups(table(spark, texts), k, percent).collect()}
    assert got == plain_groups(dict(enumerate(texts)), k, percent)


def test_similarity_counts_links(spark):
    """Crowds over the bound of 16, and over one block; copies of a text count each."""
    random.seed(11)
    texts = []
    for size in (60, 25, 3):
        own = [f"w{random.randrange(10**6)}" for _ in range(60)]
        for _ in range(size):
            one = list(own)
            for _ in range(random.choice([0, 1, 1, 2])):
                one[random.randrange(len(one))] = f"w{random.randrange(10**6)}"
            texts.append(" ".join(one))
    texts += [texts[0], texts[0].upper(), texts[61], "a b", "A B", "", None]
    sets = [frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset() for w in ((t or "").lower().split() for t in texts)]
    like = lambda x, y: bool(x) and bool(y) and len(x & y) * 100 >= 85 * len(x | y)
    want = [sum(like(x, y) for j, y in enumerate(sets) if j != i) for i, x in enumerate(sets)]
    got = {r["doc_id"]: r["n_links"] for r in similarity.groups(table(spark, texts), block=8).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert max(want) > 20 and len(set(want)) > 5


def test_similarity_of_null_ids(spark):
    """A null id links like others: near copies, a bridge between two documents, and groups of null ids alone."""
    w = [f"w{i}" for i in range(80)]
    bridge = " ".join(w)
    far = [" ".join(["x1"] + w[1:]), " ".join(w[:-1] + ["y1"])]  # 76 of 78 like the bridge, 75 of 79 like each other
    alone = " ".join(f"z{i}" for i in range(80))
    rows = [(5, far[0]), (9, far[1]), (None, bridge), (None, bridge), (None, alone), (None, alone), (None, alone + " end"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["n_links"]) for r in similarity.groups(docs, percent=97).collect()), key=repr)
    assert got == sorted([(5, 5, 2), (9, 5, 2), (None, 5, 3), (None, 5, 3), (None, None, 2), (None, None, 2), (None, None, 2), (None, None, 0)], key=repr)
    kept = [(r["doc_id"], r["text"]) for r in similarity.one_of_each(docs, k=4, percent=97).collect()]
    assert len(kept) == 3 and (5, far[0]) in kept and (None, "") in kept and sum(t.startswith(alone) for _, t in kept) == 1


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (300, 200)], "a long, b long")
    got = {r["node"]: r["comp"] for r in similarity.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[200] == got[300] == 100


def test_fingerprints(spark):
    random.seed(6)
    texts = ["".join(random.choice("abcdefgh é😀") for _ in range(random.choice([0, 1, 3, 9, 40, 400]))) for _ in range(120)]
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(table(spark, texts), blocks=6).collect()}
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.fingerprint(t), fingerprints.fingerprint(edited))
        common = next((k for k, (a, b) in enumerate(zip(t, edited)) if a != b), min(len(t), len(edited)))
        assert r["common_start"] == common
        if len(t) == 400 and len(after) == 400:
            assert r["near_edited"] > 0.3 > r["near_next"]


def test_likeness_is_about_the_share_of_windows_at_every_length():
    """A plain version: the Jaccard likeness of the sets of windows, for lengths 0 to 100; no length behaves in another way."""
    random.seed(16)
    draw = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))

    def share(a, b):
        x, y = ({t[i : i + 8] for i in range(max(1, len(t) - 7))} if t else set() for t in (a, b))
        return len(x & y) / len(x | y) if x | y else 1.0

    far = []
    for n in range(101):
        t = draw(n)
        for other in (t + "wxyz", t[:-1], t, t[n // 4 :], draw(n), t[: n // 2] + draw(n - n // 2)):
            far.append(abs(fingerprints.likeness(fingerprints.fingerprint(t), fingerprints.fingerprint(other)) - share(t, other)))
    assert max(far) < 0.2 and sum(far) / len(far) < 0.03
    for n, more in ((20, 4), (31, 1)):
        t = draw(n)
        like = fingerprints.likeness(fingerprints.fingerprint(t), fingerprints.fingerprint(t + "wxyz"[:more]))
        assert abs(like - share(t, t + "wxyz"[:more])) < 0.15 and like > 0.6


def test_spans_equal_by_hash():
    text = fingerprints.Prefixes(fingerprints.codes("abcabcabcx"))
    assert text.same(0, text, 3, 6) and not text.same(0, text, 3, 7) and text.common(0, text, 3) == 6


def test_toxicity_finds_the_sentence(spark):
    random.seed(7)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    say = lambda: " ".join(random.choices(vocabulary, k=8))
    texts, labels = [], []
    for i in range(400):
        sentences = [say() for _ in range(6)]
        if i % 3 == 0:
            sentences[i % 6] = say() + random.choice([" vile", " nasty"]) + " " + say()
        texts.append(". ".join(sentences) + ".")
        labels.append((i, int(i % 3 == 0)))
    docs = table(spark, texts)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int").filter("doc_id % 5 <> 0"))
    for r in toxicity.score(docs, model).collect():
        assert (r["score"] >= 0.7) == (r["doc_id"] % 3 == 0)
        if r["score"] >= 0.7:
            assert any(re.search("vile|nasty", texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["sentences"])
    assert toxicity.clean(docs, model).count() == sum(i % 3 != 0 for i in range(400))


def test_pieces_in_chunks_equal_the_library(spark):
    import sentencepiece

    random.seed(8)
    with open(pieces.MODEL, "rb") as f:
        proto = f.read()
    p, lib = pieces.Pieces(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    some = ["a", "b", " ", "  ", "\n", "é", "😀", "the", " of", "tion", "1", "     ", "x" * 17]
    for n in range(150):
        text = "".join(random.choice(some) for _ in range(random.randint(1, 60)))
        marked, size = pieces.MARK + text.replace(" ", pieces.MARK), random.choice([1, 3, 7, 20])
        chunks = []
        for at in range(0, len(marked), size):
            end, low = min(at + size, len(marked)), max(0, at - p.longest)
            chunks.append(pieces.Chunk(p, marked[low : end + p.longest], at - low, end - low, at == 0, end == len(marked)))
        path = pieces.walk([c.matrix() for c in chunks], 0, int(np.argmax(__import__("functools").reduce(pieces.combine, [c.matrix() for c in chunks])[0])))
        assert [i for c, a, b in zip(chunks, path, path[1:]) for i in c.ids(a, b)] == lib.encode(text)
    big = [" ".join(random.choices(["tion", "er", "an", "é", "th"], k=5000)), "abcdefgh12" * 900, " " * 9000, "short", None]
    out = pieces.decode(pieces.encode(table(spark, big), giant=5000, chunk=2000)).collect()
    for r in out:
        assert (r["ids"], r["decoded"]) == ((None, None) if big[r["doc_id"]] is None else (lib.encode(big[r["doc_id"]]), big[r["doc_id"]]))


def test_combine_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (rng.choice([0, -np.inf], size=s).astype(np.float32) for s in ((3, 4), (4, 5), (5, 2)))
    assert np.array_equal(pieces.combine(pieces.combine(a, b), c), pieces.combine(a, pieces.combine(b, c)))
