import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash


def brute_fp(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    label = {f: f for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if bin(a ^ b).count("1") <= radius:
                ra, rb = find(a), find(b)
                label[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in fs}


@pytest.mark.parametrize("dense", [4, 256])
def test_bk_links_equal_brute_force(dense):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set(int(x) for x in centres)
    for c in centres:
        for _ in range(25):
            x = int(c)
            for b in rng.choice(16, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b + 16)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    i, j = simhash.bk_links(np.zeros(len(fps), np.int64), fps, 3, dense, budget=500)
    label = {int(f): int(f) for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in zip(fps[i].tolist(), fps[j].tolist()):
        ra, rb = find(a), find(b)
        label[max(ra, rb)] = min(ra, rb)
    want = brute_components(fps.tolist())
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups({k: find(k) for k in label}) == groups(want)


def test_components_whole(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(i, base + f" tail{i % 7} x{i}") for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "Same Words"), (104, "same words"), (105, "é\x85ü x y z"), (106, "one"), (104, "same words"), (200, "z" * 100_000)]
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_components(df).collect())
    fps = {(i, t): brute_fp(t) for i, t in rows}
    comp = brute_components(set(fps.values()))
    low = {}
    for (i, t), f in fps.items():
        low[comp[f]] = min(low.get(comp[f], i), i)
    assert got == sorted((i, fps[i, t], low[comp[fps[i, t]]]) for i, t in rows)


def test_empty(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert simhash.drop_near_duplicates(spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (1, "a b c d")], "doc_id long, text string")).collect() == [(1, "a b c d")]


@pytest.mark.parametrize("plan", [(4, 1), (5, 2), (6, 3)])
def test_links_for_every_shard_plan(spark, monkeypatch, plan):
    monkeypatch.setattr(simhash, "shard_plan", lambda n, radius: plan)
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 150, dtype=np.uint64)}
    for c in sorted(fps):
        fps.add(c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    links = simhash.link_fingerprints(spark.createDataFrame(signed, "fp long"), 3)
    from tessera.llm.common import connected_components

    got = {r.node & (2**64 - 1): r.label for r in connected_components(links).collect()}
    want = brute_components(fps)
    sizes = {v: sum(x == v for x in want.values()) for v in want.values()}
    assert set(got) == {f for f in fps if sizes[want[f]] > 1}
    assert len(set(got.values())) == sum(n > 1 for n in sizes.values())


def test_shard_plans_grow():
    assert simhash.shard_plan(10**6, 3) == (4, 1) and simhash.shard_plan(10**9, 3) == (5, 2) and simhash.shard_plan(10**13, 3) == (6, 3)


def test_components_of_a_long_chain(spark):
    from tessera.llm.common import connected_components

    n = 10_000
    got = connected_components(spark.range(n).selectExpr("(id * 7919) % 10007 as a", "((id + 1) * 7919) % 10007 as b"))
    assert got.agg({"label": "min"}).first()[0] == got.agg({"label": "max"}).first()[0] == 0
    assert got.count() == n + 1


def test_clashing_names_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d", 1, 2, "x"), (3, "a b c d", 1, 2, "x"), (None, None, 5, 6, "y")], "doc_id long, text string, `__id` int, fp int, `a.b` string")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted([(3, "a b c d", 1, 2, "x"), (None, None, 5, 6, "y")], key=str)


def linked_sets(fps, links):
    label = {int(f): int(f) for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        label[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in label}


@pytest.mark.parametrize("plan", [(4, 1), (5, 2), (6, 3)])
def test_crowded_shards_are_split(spark, monkeypatch, plan):
    monkeypatch.setattr(simhash, "shard_plan", lambda n, radius: plan)
    monkeypatch.setattr(simhash, "STEP_PRINTS", 300)
    rng = np.random.default_rng(12)
    base, fps = int(rng.integers(0, 1 << 60)), set()
    for _ in range(400):  # all agree on most bits; some are within the radius of each other
        x = base
        for b in rng.choice(20, rng.integers(0, 9), replace=False):
            x ^= 1 << int(b * 3)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 200)}
    df = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    links = [(r.a, r.b) for r in simhash.link_fingerprints(df, 3, crowd=10).collect()]
    assert linked_sets(fps, links) == linked_sets(fps, [(r.a, r.b) for r in simhash.link_fingerprints(df, 3).collect()]) == brute_components(sorted(fps))


def test_a_template_of_many(spark):
    """One block of bits shared by all: its shard is split and the parts are small."""
    import time

    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 47, 100_000).astype(np.int64) << 16 | 4711)
    near = fps[:50] ^ (7 << 20)
    df = spark.createDataFrame([(int(f),) for f in np.unique(np.r_[fps, near])], "fp long").repartition(4)
    began = time.perf_counter()
    links = {tuple(sorted((r.a, r.b))) for r in simhash.link_fingerprints(df, 3).collect()}
    assert {tuple(sorted((int(a), int(b)))) for a, b in zip(fps[:50], near) if a != b} <= links
    assert time.perf_counter() - began < 120
