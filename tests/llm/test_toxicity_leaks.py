import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontaminate, toxicity


def test_fold():
    t = toxicity.Folding()
    assert toxicity.fold("Ídı0т! a$s", t) == toxicity.fold("idiot  ass", t)
    assert toxicity.fold("W0RTH1ESS", t) == toxicity.fold("worthless", t)


def test_exception_phrase_voids_term():
    t = toxicity.Folding()
    lex = toxicity.Lexicon({" ciown": 2.0}, (" ciown fish ",))
    a = lex.automaton()
    assert toxicity.hits(toxicity.fold("clown fish swim", t), a) == []
    assert len(toxicity.hits(toxicity.fold("you clown, clown fish", t), a)) == 1
    assert toxicity.hits("x", toxicity.Lexicon().automaton()) == []


def make(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        word = ("blargword", "zonkery", "b1argw0rd")[i % 3] if bad else "gentle"
        extra = " clown fish" if i % 7 == 0 else ""
        rows.append((i, f"common text number words here {word} and more words{extra} " + "pad " * (i % 50), "en", 9.0))
        if i < 500:
            labels.append((i, int(bad), 1))
    rows += [(1000, None, "en", 1.0), (1001, "", "en", 1.0), (None, "blargword", "en", 1.0), (1002, "calm " * 30_000 + "blargword", "en", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_learned_on_held_out(spark):
    docs, labels = make(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 600:
            assert r.predicted == int(r.doc_id % 5 == 0)
        if r.doc_id in (1000, 1001):
            assert r.predicted == 0
        if r.doc_id in (None, 1002):
            assert r.predicted == 1


def test_without_labels(spark):
    docs, labels = make(spark)
    assert toxicity.toxicity(docs, labels.limit(0)).agg({"score": "max"}).first()[0] < 0.5
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
SWAP = "zeta eta theta iota kappa lambda mu and alpha beta gamma delta epsilon"
DOCS = [
    (1, f"before {ITEM.upper()}, after"), (2, f"some {SWAP} rest"), (3, "alpha beta gamma delta other"), (4, None), (5, ""),
    (6, "filler " * 20_000 + ITEM), (7, "epsilon delta gamma beta alpha"), (1, ITEM), (None, ITEM), (8, ITEM + " " + ITEM),
]


DOCS += [(None, "clean words of no item"), (8, "another row of a leaking document's id"), (9, "背景 " + "量子纠缠是两个粒子之间的非局域关联现象" + "。"), (10, "量子纠缠")]
ITEMS = [(10, ITEM), (11, "too short item"), (12, None), (13, "never in any of the documents at all"), (14, "量子纠缠是两个粒子之间的非局域关联现象")]
EXTRA = "text2 string, `__leak` boolean, `__id` int, digest string, `key` long, `a.b` int, coverage double"


def rows(df):
    return sorted((str(r.doc_id), r.item_id, r.matched, r.tiles, r.longest, round(r.coverage, 3)) for r in df.collect())


@pytest.mark.parametrize("most", [0, 16 << 20])
def test_leaks_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    docs = spark.createDataFrame([(i, t, "x", True, n, "d", n, n, 1.0) for n, (i, t) in enumerate(DOCS)], f"doc_id long, text string, {EXTRA}")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted([("1", 10, 12, 1, 12, 1.0)] * 2 + [("2", 10, 12, 2, 7, 1.0), ("6", 10, 12, 1, 12, 1.0), ("None", 10, 12, 1, 12, 1.0), ("8", 10, 12, 1, 12, 1.0), ("9", 14, 19, 1, 19, 1.0)])
    assert rows(decontaminate.find_leaks(docs, bench)) == want
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    leaking = {n for n, (_, t) in enumerate(DOCS) if t and (ITEM in t.lower() or SWAP in t or ITEMS[-1][1] in t)}
    assert sorted(r["__id"] for r in kept.collect()) == sorted(set(range(len(DOCS))) - leaking)
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0


def brute_tiles(item, doc, least):
    free_item, free_doc, out = [True] * len(item), [True] * len(doc), []
    while True:
        best, found = least, []
        for s in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while s + n < len(doc) and i + n < len(item) and free_item[i + n] and free_doc[s + n] and item[i + n] == doc[s + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, s)]
                elif n == best:
                    found.append((i, s))
        if not found:
            return out
        for i, s in found:
            if all(free_item[i : i + best]) and all(free_doc[s : s + best]):
                free_item[i : i + best] = free_doc[s : s + best] = [False] * best
                out.append((i, s, best))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=20), st.lists(st.integers(-1, 3), max_size=40), st.integers(1, 4))
def test_tiling_is_greedy(item, doc, least):
    doc = [x if x in item else -1 for x in doc]
    assert decontaminate.tile(item, doc, least) == brute_tiles(item, doc, least)


def test_leaks_equal_brute_force(spark):
    """Every document against every item, by tiling without hashes or seeds."""
    import random

    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(3, 16)))) for k in range(12)]
    docs = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1].split()
            a = rng.randint(0, len(part) // 2)
            at = rng.randint(0, len(w))
            w[at:at] = part[a : a + rng.randint(2, 14)]
        docs.append((i, " ".join(w)))
    want = []
    for i, text in docs:
        for k, item in items:
            a, b = item.split(), text.split()
            matched = sum(n for *_, n in brute_tiles(a, b, 5))
            if matched and matched >= 0.5 * len(a):
                want.append((i, k, matched))
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.matched) for r in got) == sorted(want) and len(want) > 20


def test_score_equals_naive_search(spark):
    """The automaton's score against looking for every term and phrase at every place."""
    import math
    import random

    rng = random.Random(4)
    lexicon = toxicity.Lexicon({" bad": 1.5, " awfui ": 2.0, " ba": 0.5}, (" bad iuck ", " not bad "), -2.0, (1.1, 0.7))
    texts_ = [" ".join(rng.choices(["bad", "luck", "not", "awful", "awfully", "B4D", "bar", "fine", "a"], k=rng.randint(0, 30))) for _ in range(80)]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string"), lexicon).collect()}
    for i, text in enumerate(texts_):
        t = toxicity.fold(text, toxicity.Folding())
        places = lambda x: [a for a in range(len(t)) if t.startswith(x, a)]
        void = [(a, a + len(x)) for x in lexicon.exceptions for a in places(x)]
        total = sum(w for x, w in lexicon.weights.items() for a in places(x) if not any(p <= a and a + len(x) <= q for p, q in void))
        z = -2.0 + 1.1 * math.log1p(total) + 0.7 * math.sqrt(total / max(1, t.count(" ") - 1))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-12


def test_many_hits_in_linear_time():
    lexicon = toxicity.Lexicon({" bad": 1.0}, (" not bad ",))
    assert len(toxicity.hits(" " + "bad not bad " * 100_000, lexicon.automaton())) == 100_000


def test_drop_toxic_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "clean", 0.7, "z"), (2, "blargword", 0.1, "z"), (None, None, 0.2, "y")], "doc_id long, text string, `__score` double, `a.b` string")
    kept = toxicity.drop_toxic(docs, toxicity.Lexicon({" biargword ": 9.0}))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "clean", 0.7, "z"), (None, None, 0.2, "y")], key=str)


def test_tiling_of_repetitions_is_quick():
    assert len(decontaminate.tile([0] * 50, [0] * 200_000, 5)) == 1


def test_workers_without_the_package(tmp_path):
    """Spark started elsewhere: workers cannot import this package and need not."""
    import os
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))!r})
from tessera.session import local_session
from tessera.llm import decontaminate, simhash, toxicity
spark = local_session(2, 2)
docs = spark.createDataFrame([(1, {ITEM!r}), (2, 'clean')], 'doc_id long, text string')
bench = spark.createDataFrame([(10, {ITEM!r})], 'item_id long, text string')
assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [2]
assert decontaminate.find_leaks(docs, bench).count() == 1
assert simhash.drop_near_duplicates(docs).count() == 2
assert toxicity.drop_toxic(docs, toxicity.Lexicon({{' ciean ': 9.0}})).count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-1500:]
