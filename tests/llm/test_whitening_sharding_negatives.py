import random
import zlib

import numpy as np
import pytest

from tessera.llm import negatives, queries, sharding, whitening

SF = "/root/testdata/sf0.001"
ODD = [(None, [1.0, 3.0, 2.0], 1), (7001, None, 1), (7002, [1.0, None, 2.0], 1), (7003, [1.0, float("nan"), 2.0], 2), (7004, [float("inf")] * 3, 2), (7005, [], 3), (7006, [1.0], 3)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "x") for i, v, y in rows], "vec_id long, embedding array<double>, label int, n string")


# whitening


def whitened(rows):
    x = {i: np.floor(256 * np.array(v)) for i, v, *_ in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    mean = fit.mean(0)
    cov = (fit - mean).T @ (fit - mean) / len(fit)
    e, v = np.linalg.eigh(cov)
    return x, fit, mean, e[::-1], v[:, ::-1]


def check_whitening(got, rows, components=4):
    x, fit, mean, e, v = whitened(rows)
    n, sums = len(fit), fit.sum(0)
    assert len(got) == len(rows) * components
    signs = {}
    for r in got:
        c = r.component - 1
        want = (x[r.vec_id] - mean) @ v[:, c] / e[c] ** 0.5
        if abs(want) > 1e-3:
            signs.setdefault(c, np.sign(want * r.whitened))
        assert abs(abs(want) - abs(r.whitened)) < 1e-8 and (abs(want) < 1e-3 or np.sign(want * r.whitened) == signs[c])
        assert r.n == n and r.deviation == int(((n * x[r.vec_id] - sums) ** 2).sum()) and abs(r.explained / (e[c] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_as_by_eigenvectors(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12)) * np.logspace(0, -2.5, 12)  # condition in the hundreds of thousands for the covariance
    rows = [(i, list(map(float, r)), 0) for i, r in enumerate(rng.normal(size=(900, 12)) @ mix + 5)]
    rows += [(2000 + i, rows[3][1], 0) for i in range(300)]  # one vector held by many
    check_whitening(whitening.whiten(vectors(spark, rows)).collect(), rows)


def test_whitening_query(spark):
    rows = [(r.vec_id, list(map(float, r.embedding)), 0) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries.op11_whitening(spark, SF).collect(), rows)


def test_whitening_of_odd_tables(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 2))
    rows = [(i, [float(a), float(b), float(np.floor(256 * a) / 128)], 0) for i, (a, b) in enumerate(base)]  # the third is twice the first: two components
    got = whitening.whiten(vectors(spark, rows + ODD + [rows[5]])).collect()
    found = {(r.vec_id, r.component) for r in got}
    assert found == {(i, c) for i in [*range(200), None] for c in (1, 2)} and len(got) == 2 * 202
    assert all(r.identity_error < 1e-6 and r.n == 201 for r in got)
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).count() == 0
    assert whitening.whiten(vectors(spark, [])).count() == 0
    huge = whitening.whiten(vectors(spark, [(1, [1e300, 1.0], 0), (2, [-1e300, 2.0], 0), (3, [0.0, 9.0], 0)]), 1).collect()
    assert [r.deviation for r in sorted(huge)] == [None, None, 14745601] and all(np.isfinite(r.whitened) for r in huge)


def test_triangular_solves():
    rng = np.random.default_rng(1)
    a, r = rng.normal(size=(50, 6)), np.triu(rng.normal(size=(6, 6))) + 3 * np.eye(6)
    assert np.allclose(whitening.solve(a, r) @ r, a)


# sharding


def laid_out(rows, shards, key):
    """The whole order, sorted and cut at once."""
    total, before, out = sum(r[1] for r in rows), 0, []
    for r in sorted(rows, key=key):
        out.append((r, min(shards - 1, shards * (2 * before + r[1]) // (2 * total))))
        before += r[1]
    return out


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_cuts_of_one_order(spark, shards, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 40)
    rng = random.Random(2)
    rows = [(i, 1 + int(rng.paretovariate(1.1)), 7 if i % 3 == 0 else rng.randrange(10**6)) for i in range(3000)]  # a third has one key
    rows += [(5000 + i, 1, rng.randrange(10**6)) for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, s long, k long").repartition(7)
    got = {r.i: r for r in sharding.shard(df, df.k, df.i, df.s, shards).collect()}
    slots = dict.fromkeys(range(shards), 0)
    for (i, *_), at in laid_out(rows, shards, lambda r: (r[2], r[0])):
        assert got[i].shard == at and got[i].slot == slots[at]
        slots[at] += 1
    share, most = sum(r[1] for r in rows) / shards, max(r[1] for r in rows)
    sizes = [sum(r[1] for r in rows if got[r[0]].shard == s) for s in range(shards)]
    assert all(abs(x - share) <= most for x in sizes)


def test_shards_by_rows_and_odd_tables(spark, tmp_path):
    rows = [(None, None, 3), (None, None, 3), (1, 5, None), (1, 5, None), (2, 5, -4), *[(9, 9, 0)] * 30]
    df = spark.createDataFrame(rows, "key long, shard long, range int")
    got = sharding.shard(df, F_col("key"), F_col("shard"), shards=4)
    assert got.columns == ["key", "shard", "range", "shard_", "slot"]
    counts = [r[1] for r in got.groupBy("shard_").count().collect()]
    assert sum(counts) == 35 and max(counts) - min(counts) <= 1
    assert sharding.shard(df.limit(0), F_col("key"), F_col("shard"), F_col("range")).count() == 0
    zero = sharding.shard(df.where("range = 0"), F_col("key"), F_col("shard"), F_col("range"), 3)
    assert sorted(r[1] for r in zero.groupBy("shard_").count().collect()) == [10, 10, 10]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "aé"), (3, "aé"), (4, "z" * 10**6)], "doc_id long, text string")
    dealt = sharding.shard_digest(docs, 2).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in dealt) == sorted([(1, 1, 0), (2, 1, 0), (3, 4, zlib.crc32("aé".encode())), (3, 4, zlib.crc32("aé".encode())), (4, 10**6 + 1, zlib.crc32(b"z" * 10**6))])
    for s in {r.shard for r in dealt}:
        assert sorted(r.slot for r in dealt if r.shard == s) == list(range(sum(r.shard == s for r in dealt)))
    sharding.write_shards(sharding.shard(docs, sharding.group_key(docs.text), docs.doc_id, shards=2), str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, docs.collect()))


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


# hard negatives


def mined(rows, every, k=5):
    points = {}
    for i, v, y in rows:
        if i is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            x = [max(-(2**63), min(2**63 - 1, int(np.floor(256 * c)) if abs(c) < 2**55 else int(c) * 256)) for c in v]
            points[i] = min(points.get(i, (y, x)), (y, x))
    out = []
    for a, (label, x) in points.items():
        if a % every:
            continue
        scores = [(-max(-(2**63) + 1, min(2**63 - 1, sum(p * q for p, q in zip(x, w)))), i, y == label) for i, (y, w) in points.items() if i != a and len(w) == len(x)]
        for p, i, _ in sorted(s for s in scores if s[2])[:k]:
            window = sorted(s for s in scores if not s[2] and -80 * p <= -100 * s[0] <= -100 * p)[:k]
            out += [(a, i, r + 1, j, -p, -s) for r, (s, j, _) in enumerate(window)]
    return sorted(out)


def test_negatives_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP_CELLS", 600)
    monkeypatch.setattr(negatives, "ROW_TILE", 16)
    monkeypatch.setattr(negatives, "ANCHOR_TILE", 3)
    rng = np.random.default_rng(6)
    rows = [(i, [round(float(c), 1) for c in rng.normal(size=3)], int(rng.integers(4)) if i % 3 else 0) for i in range(700)]  # many ties, one label of a third
    rows += [(1000 + i, [0.5, 0.5, 0.1], i % 5) for i in range(120)]  # one vector with many labels
    rows += [(2000 + 10 * i, [float(i + 1)] * 2, i % 2) for i in range(6)] + [(3000, [1e10, 1.0, 2.0], 0), (3001, [9e9, 1.0, 2.0], 1), (3003, [1e10, 2.0, 2.0], 0), (3010, [-1e300, 0.0, 1.0], 0)]
    rows += ODD + [(rows[0][0], rows[0][1], 9), rows[10], (5000, [1.0, 1.0, 1.0], None)]
    got = sorted(map(tuple, negatives.hard_negatives(vectors(spark, rows), 10).collect()))
    assert got == mined(rows, 10) and len({r[0] for r in got}) > 60


def test_no_negatives(spark):
    assert negatives.hard_negatives(vectors(spark, [])).count() == 0
    assert negatives.hard_negatives(vectors(spark, [(0, [1.0], 1), (1, [1.0], 1)])).count() == 0
    assert [tuple(r) for r in negatives.hard_negatives(vectors(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.81], 2), (3, [0.7], 2)])).collect()] == [(0, 1, 1, 2, 65536, 256 * 207)]
