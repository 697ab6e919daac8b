"""Dictionary automata, call graphs and product queries on cases that are easy to get wrong."""

import random

from tessera.operators import assemble as A
from tessera.operators import dictionary as D
from tessera.operators import graph as G
from tessera.operators import understand as U


def test_short_names_and_parts(spark, monkeypatch):
    texts = [(1, "axbc"), (2, "bcd"), (3, ""), (4, None), (5, "平安e生保bc")]
    names = ["x", "bc", "bcd", "axbcd", "", None, "安e", "bc"]
    df, listed = spark.createDataFrame(texts, "i int, q string"), spark.createDataFrame([(n,) for n in names], "name string")
    want = sorted((i, n) for i, t in texts for n in {n for n in names if n is not None} if t is not None and n in t)
    assert sorted((r.i, r.mention) for r in U.link_names(df, "q", listed).collect()) == want
    assert sorted((r.i, r.mention) for r in U.link_names(df, "q", listed, few=2).collect()) == want
    placed = spark.createDataFrame([("x", "X", 2), ("bc", "BC", 1), ("ax", "AX", 0), (None, "N", 3)], "name string, canonical string, pos int")
    for most in (100, 1):
        monkeypatch.setattr(D, "PART_NAMES", most)
        assert sorted((r.i, r.linked or "-") for r in D.longest_name(df, "q", placed).collect()) == [(1, "AX"), (2, "BC"), (3, "-"), (4, "-"), (5, "BC")]
    assert D.contained(df, "q", listed.limit(0)).count() == 0


def test_many_names(spark):
    rng = random.Random(5)
    names = list({"".join(rng.choices("abcdef", k=rng.randrange(3, 12))) for _ in range(110_000)})
    texts = [(i, "".join(rng.choices("abcdefg ", k=300))) for i in range(40)]
    df = spark.createDataFrame(texts, "i int, q string")
    got = U.link_names(df, "q", spark.createDataFrame([(n,) for n in names], "name string"), few=60_000)
    known = set(names)
    want = {(i, t[a:b]) for i, t in texts for a in range(300) for b in range(a + 3, min(300, a + 12) + 1) if t[a:b] in known}
    rows = [(r.i, r.mention) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def resolved(spark, calls, **more):
    df = spark.createDataFrame(calls, "run_id int, idx int, depends_on array<int>, error string, ok_from int")
    return {(r.run_id, r.idx): (r.status, r.tries, r.round, r.cycle) for r in A.resolve_calls(df, **more).collect()}


def test_call_graphs(spark):
    calls = [
        (1, 0, [1], None, 1), (1, 1, [], "boom", None),  # a later call fails for good
        (2, 0, [2], None, 1), (2, 1, [0], None, 1), (2, 2, [], None, 1),  # forwards, then back
        (3, 0, [1], None, 1), (3, 1, [2], None, 1), (3, 2, [0], None, 1), (3, 3, [2], None, 1), (3, 4, [9, -1], None, 1),
        (4, 0, [0], None, 1), (4, 1, None, None, 1),
        (5, 0, [], "timed out", 3), (5, 1, [0], None, 1), (5, 2, [3], None, 1), (5, 3, [], "timeout", 2), (5, 4, [3], "timeout", 3),
        (6, 0, [1, 2], None, 1), (6, 1, [2], "x", None), (6, 2, [1], None, 1), (6, 3, [0], None, 1), (6, 4, [5, 4], None, 1), (6, 5, [4], None, 1),
    ]
    got = resolved(spark, calls, budget=3)
    assert [got[1, i][:2] for i in range(2)] == [("skipped", 0), ("failed", 1)]
    assert [got[2, i][:3] for i in range(3)] == [("done", 1, 2), ("done", 1, 2), ("done", 1, 1)]
    assert [got[3, i] for i in range(5)] == [("waiting", 0, None, 0)] * 3 + [("waiting", 0, None, None), ("done", 1, 1, None)]
    assert got[4, 0] == ("waiting", 0, None, 0) and got[4, 1][0] == "done"
    assert [got[5, i][:3] for i in range(5)] == [("done", 3, 3), ("done", 1, 3), ("done", 1, 3), ("done", 2, 2), ("failed", 2, 3)]
    assert [got[6, i][3] for i in range(6)] == [None, 1, 1, None, 4, 4] and got[6, 0][0] == got[6, 3][0] == "waiting"
    # each call has its own tries without a budget; one round is not enough for a forward dependency
    assert resolved(spark, calls)[5, 4][:2] == ("done", 3)
    assert resolved(spark, calls, budget=1)[2, 0][0] == "waiting"
    assert resolved(spark, []) == {}


def test_a_long_chain(spark):
    n = 40
    got = resolved(spark, [(1, i, [i - 1] if i else [], None, 1) for i in range(n)] + [(2, i, [i + 1], None, 1) for i in range(n)], budget=3)
    assert {got[1, i][:3] for i in range(n)} == {("done", 1, 1)}
    assert [got[2, i][0] for i in range(n)] == ["waiting"] * (n - 3) + ["done"] * 3


def test_products_without_issuer_and_by_category(spark):
    e = [("p1", "c1", "has_clause"), ("c1", "d1", "covers"), ("p2", "c2", "has_clause"), ("c2", "d1", "covers"), ("i1", "p2", "issues"), ("d1", "k", "belongs_to"), ("d2", "k", "belongs_to"), ("d3", "m", "belongs_to"), ("i1", "p3", "issues")]
    r = [(1, "d1", None, None), (2, "d2", None, None), (3, "d3", None, None), (4, "d2", "i1", None), (5, None, "i1", None), (6, None, None, None), (7, "d1", None, 10)]
    edges = spark.createDataFrame(e, "src string, dst string, type string")
    req = spark.createDataFrame(r, "request_id int, disease string, insurer string, max_waiting int")
    waits = spark.createDataFrame([("p1", 30), ("p1", 90), ("p2", 5)], "product string, value int")
    found = lambda **more: sorted(map(tuple, G.complex_query(req, edges, waits, **more).collect()))
    want = [(1, "p1"), (1, "p2"), (2, "p1"), (2, "p2"), (4, "p2"), (5, "p2"), (5, "p3"), (6, "p1"), (6, "p2"), (6, "p3"), (7, "p2")]
    assert found() == want
    assert found(belongs=None) == [x for x in want if x[0] not in (2, 4)]


def test_paths_from_both_ends(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(110)] + [("hub", f"leaf{i}") for i in range(3000)] + [("n1", "hub"), ("leaf7", "n2"), ("x", "leaf9"), ("leaf9", "y")]
    pairs = [(i, f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for i in range(60)] + [(100, "x", "hub"), (101, "hub", "y"), (102, "x", "y"), (103, "n1", "leaf2999"), (104, "hub", "hub"), (105, "no", "hub"), (106, None, "hub")]
    df = spark.createDataFrame(edges, "src string, dst string").selectExpr("*", "'t' as type")
    asked = spark.createDataFrame(pairs, "request_id int, a string, b string")

    def shortest(a, b, next_):
        level, seen = [(a,)] if a is not None else [], {a}
        for d in range(5):
            hits = [p for p in level if p[-1] == b]
            if hits:
                return d, list(min(hits))
            level = sorted(p + (n,) for p in level for n in next_.get(p[-1], ()) if n not in seen)
            seen |= {p[-1] for p in level}
            level = [p for i, p in enumerate(level) if p[-1] not in {q[-1] for q in level[:i]}] if len(level) < 500 else list({p[-1]: p for p in reversed(level)}.values())
        return None

    for directed in (False, True):
        next_: dict = {}
        for a, b in edges:
            next_.setdefault(a, set()).add(b)
            if not directed:
                next_.setdefault(b, set()).add(a)
        want = {i: shortest(a, b, next_) for i, a, b in pairs}
        got = {r.request_id: (r.distance, list(r.path)) for r in G.shortest_path(asked, df, directed=directed).collect()}
        assert got == {i: w for i, w in want.items() if w}
    reached, _ = G.meet(asked.where("request_id in (100, 101, 102)"), G.both_ways(df))
    assert reached.count() < 60  # the hub's three thousand neighbours are never walked


def test_texts_travel_in_bounded_batches(spark):
    """Whatever the session does not say itself: 1,000 texts at a time go to a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    df, names = spark.range(3).selectExpr("cast(id as string) as q"), spark.createDataFrame([("1",)], "name string")
    before = spark.conf.get(key)
    try:
        for said, used in (("10000", "1000"), ("5000", "5000")):
            spark.conf.set(key, said)
            assert [r.mention for r in U.link_names(df, "q", names).collect()] == ["1"] and spark.conf.get(key) == used
    finally:
        spark.conf.set(key, before)
