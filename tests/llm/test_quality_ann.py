import math
import random

import numpy as np

from tessera.llm import hnsw, quality


def brute(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q, v in good.items():
        if q % every == 0:
            s = [(-float(v @ w), i) for i, w in good.items() if i != q and len(w) == len(v)]
            out[q] = [(i, -d) for d, i in sorted(s)[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=12) * rng.uniform(0.5, 2)).tolist()) for i in range(1500)]
    common = rng.normal(size=12).tolist()
    rows += [(i, common) for i in range(2000, 2400)]
    rows += [(3000, None), (3020, [0.0] * 12), (3040, [float("nan")] + [1.0] * 11), (3060, [None] + [1.0] * 11), (3080, [float("inf")] * 12), (None, common), (2000, common)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    want = brute(rows, 20, 20)
    got: dict = {}
    for r in hnsw.nearest(df, 20, 20, shard_rows=400).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    right = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
        for _, i, s in found:
            w = dict((i, np.array(v, np.float32).astype(float)) for i, v in rows if i == q or i is not None and v is not None)[i]
            assert abs(s - float(np.array(dict(rows)[q], np.float32).astype(float) @ w)) < 1e-9
        right += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert right / (20 * len(want)) >= 0.95
    # the twenty smallest ids of the common vector, wherever it wins
    q = next(q for q in want if q >= 2000)
    assert [i for _, i, _ in sorted(got[q])] == [i for i, _ in want[q]]


def test_recall_over_shards_and_with_outliers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.2, 3, 3000)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(3001, (x[5] * 1e4).tolist()), (3003, (x[9] / abs(x[9]).max() * 1e200).tolist()), (3007, (x[11] * 1e-300).tolist()), (3020, (x[3] * 1e180).tolist())]
    got = {}
    for r in hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=300).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    every, right, total = np.array([v for _, v in rows]), 0, 0
    ids = np.array([i for i, _ in rows])
    for q, v in rows:
        if q % 20 == 0:
            with np.errstate(over="ignore", invalid="ignore"):
                score = np.nan_to_num(every @ np.array(v), nan=-np.inf)
            score[ids == q] = -np.inf
            best = ids[np.lexsort((ids, -score))[:20]]
            found = sorted(got[q])
            assert len(found) == 20 and [s for *_, s in found] == sorted((s for *_, s in found), reverse=True)
            right, total = right + len(set(best) & {i for _, i, _ in found}), total + 20
    assert set(got) == {q for q, _ in rows if q % 20 == 0}
    assert right / total >= 0.95


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in hnsw.nearest(df).collect()] == [(0, 1, 1, 0.5)]
    assert hnsw.nearest(df.limit(0)).count() == 0


def test_graph_layers_round_trip():
    x = np.random.default_rng(1).normal(size=(300, 8))
    g = hnsw.Graph(x)
    m = g.packed()
    h = hnsw.Graph.unpacked(x, m["entry"], m["layers"], m["heights"])
    assert (g.search(x[:20], 40) == h.search(x[:20], 40)).all()


def test_co_training_on_held_out(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1200):
        good = rng.random() < 0.7
        w = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        text = ". ".join(" ".join(w[k : k + 8]).capitalize() for k in range(0, len(w), 8)) + "."
        if not good:
            text = rng.choice([" | ".join(w), "!! ".join(w).upper(), " ".join(w[:3] * 20)])
        rows.append((i, text, "en", f"s{i % 3}", 0.5))
        if i < 500:
            labels.append((i, int(good)))
    rows += [(5000, None, None, None, 0.5), (5001, "", "en", "s", 0.5), (None, "x", "en", "s", 0.5), (5002, "word " * 50_000, "en", "s", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.co_train(docs, lab, rounds=2).collect()}
    assert len(got) == 1204 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    truth = dict(labels)
    held = [r for i, r in got.items() if i in truth and r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    none = quality.co_train(docs, lab.limit(0)).agg({"score": "max"}).first()[0]
    assert none == 0.5
    assert quality.co_train(docs.limit(0), lab).count() == 0


def test_one_large_shard(spark, monkeypatch):
    """Recall of a single graph of many points: the beam grows with it."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12000, 24)).astype(np.float32)
    x /= np.sqrt((x * x).sum(1, keepdims=True))  # one band of lengths
    monkeypatch.setattr(hnsw, "BEAM_POINTS", 3000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in hnsw.nearest(df, 20, 100, shard_rows=20000).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    right = 0
    for q, found in got.items():
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -9
        right += len(set(np.argsort(-score)[:20]) & set(found))
    assert len(got) == 120 and right / (20 * 120) >= 0.97


def test_shards_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 100 * 8 * 4)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 4)))], "vec_id long, embedding array<double>")
    sizes = [r.n for r in hnsw.build_index(df, 5, shard_rows=50).select("n").collect()]
    assert sum(sizes) == 2000 and max(sizes) < 200
