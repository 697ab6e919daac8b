"""Requests that ask the same, and leaves around hubs, must not multiply the work."""

import random

from pyspark.sql import functions as F

from tessera.operators import business as B
from tessera.operators import graph as G


def star(spark, leaves):
    """Two hubs of leaves that hang together by a node."""
    rows = [(f"x{h}_{i}", f"h{h}") for h in (1, 2) for i in range(leaves)] + [("h1", "m"), ("h2", "m")]
    return spark.createDataFrame(rows, "src string, dst string")


def watch(monkeypatch, module, name, seen):
    real = getattr(module, name)

    def noted(df, *a, **k):
        seen.append(df.count())
        return real(df, *a, **k)

    monkeypatch.setattr(module, name, noted)


def test_paths_leave_out_leaves(spark, monkeypatch):
    seen, n = [], 60
    watch(monkeypatch, G, "cut", seen)
    pairs = spark.createDataFrame([(i, f"x1_{i}", "h2") for i in range(n)] + [(n, "x1_0", "x1_1"), (n + 1, "x1_0", "x2_5"), (n + 2, "h1", "x1_3")], "request_id int, a string, b string")
    got = {r.request_id: r.path for r in G.shortest_path(pairs, star(spark, n)).collect()}
    assert got == {i: [f"x1_{i}", "h1", "m", "h2"] for i in range(n)} | {n: ["x1_0", "h1", "x1_1"], n + 1: ["x1_0", "h1", "m", "h2", "x2_5"], n + 2: ["h1", "x1_3"]}
    assert max(seen) <= 8 * n + 100  # edges both ways, from both sides; never requests times leaves


def test_neighbours_of_a_label_leave_out_leaves(spark, monkeypatch):
    seen, n = [], 60
    watch(monkeypatch, G, "cut", seen)
    seeds = spark.createDataFrame([(i, f"x1_{i}") for i in range(n)], "request_id int, id string")
    nodes = spark.createDataFrame([("h1", "Hub"), ("h2", "Hub"), ("m", "Middle"), ("x2_7", "Hub")], "id string, label string")
    got = G.neighbors(seeds, star(spark, n), 4, nodes=nodes, label="Hub").collect()
    assert sorted((r.request_id, r.id, r.distance) for r in got) == sorted((i, x, d) for i in range(n) for x, d in (("h1", 1), ("h2", 3), ("x2_7", 4)))
    assert max(seen) <= 8 * n + 100


def test_premiums_asked_alike_are_looked_up_once(spark, monkeypatch):
    seen = []
    watch(monkeypatch, B, "small", seen)
    req = spark.createDataFrame([(i, "red", 30, None) for i in range(50)] + [(50, "red", 30, "a")], "request_id int, product_name string, age int, sum_insured string")
    rates = spark.createDataFrame([(1, "red one", 20, 40, "a", 5.0, True), (2, "red two", 20, 40, "b", 3.0, True)], "rate_id int, product_name string, min_age int, max_age int, sum_insured string, premium_yearly double, is_active boolean")
    got = {r.request_id: (r.rate_id, r.age, r.premium_yearly) for r in B.premium_lookup(req, rates).collect()}
    assert got == {i: (2, 30, 3.0) for i in range(50)} | {50: (1, 30, 5.0)} and seen == [2]


def test_policies_asked_alike_are_looked_up_once(spark, monkeypatch):
    asked, real = [], B.contained

    def noted(df, text, names, *a):
        asked.append(names.count())
        return real(df, text, names, *a)

    monkeypatch.setattr(B, "contained", noted)
    none = F.lit(None).cast("long")
    req = spark.range(40).select(F.col("id").alias("request_id"), F.lit("agent").alias("role"), none.alias("self_id"), none.alias("user_id"), F.lit("ins").alias("insurer"), F.when(F.col("id") % 2 == 0, "red").alias("product_name"))
    pol = spark.range(90).select((F.col("id") % 7).alias("user_id"), F.concat(F.lit("ins"), F.col("id") % 3).alias("insurer"), F.when(F.col("id") % 4 == 0, "red").otherwise("blue").alias("product_name"), F.col("id").alias("effective_date"), F.lit(True).alias("is_valid"))
    got = B.policy_lookup(req, pol, 3).groupBy("request_id").agg(F.sort_array(F.collect_list("effective_date")).alias("d")).collect()
    assert {r.request_id: r.d for r in got} == {i: [80, 84, 88] if i % 2 == 0 else [87, 88, 89] for i in range(40)}
    assert asked[0] == 2


def test_complex_requests_asked_alike_share_one_answer(spark, monkeypatch):
    asked, real = [], G.category_products

    def noted(req, *a, **k):
        asked.append(req.count())
        return real(req, *a, **k)

    monkeypatch.setattr(G, "category_products", noted)
    edges = spark.createDataFrame([("p1", "c1", "has_clause"), ("p2", "c1", "has_clause"), ("c1", "d1", "covers"), ("d1", "k", "belongs_to"), ("d2", "k", "belongs_to"), ("n", "p2", "issues")], "src string, dst string, type string")
    req = spark.createDataFrame([(i, f"d{1 + i % 2}", "n" if i % 4 < 2 else None, None) for i in range(40)], "request_id int, disease string, insurer string, max_waiting int")
    waits = spark.createDataFrame([("p1", 3)], "product string, value int")
    got = sorted(tuple(r) for r in G.complex_query(req, edges, waits).collect())
    assert got == sorted((i, p) for i in range(40) for p in (("p2",) if i % 4 < 2 else ("p1", "p2"))) and asked == [4]


def test_complex_requests_meet_their_products_in_one_last_join(spark):
    """Rows of a request come together, so that a result of requests by products is written small; none of it is shuffled again."""
    edges = spark.createDataFrame([("n", f"p{i:02}", "issues") for i in range(40)], "src string, dst string, type string")
    req = spark.createDataFrame([(i, None, "n", None) for i in range(50)], "request_id int, disease string, insurer string, max_waiting int")
    got = [r.request_id for r in G.complex_query(req, edges, spark.createDataFrame([], "product string, value int")).collect()]
    assert len(got) == 2000 and 1 + sum(a != b for a, b in zip(got, got[1:])) == 50


def test_complex_requests_in_cells_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    covers = {(f"p{rng.randrange(30):02}", f"d{rng.randrange(6)}") for _ in range(60)}
    kin = {(f"d{i}", f"k{rng.randrange(4)}") for i in range(12) for _ in range(2)}  # d6 to d11 have no product; some have two categories
    issues = {(f"n{rng.randrange(3)}", f"p{rng.randrange(40):02}") for _ in range(40)}
    waits, most = [(f"p{i:02}", rng.randrange(9)) for i in range(25) for _ in range(2)], [(f"p{i:02}", rng.randrange(9)) for i in range(10, 40)]
    asks = [(i, rng.choice([None, *(f"d{j}" for j in range(14))]), rng.choice([None, "n0", "n1", "n7"]), rng.choice([None, 2, 5]), rng.choice([None, 4])) for i in range(90)]
    e = [(p, f"{p}:{d}", "has_clause") for p, d in covers] + [(f"{p}:{d}", d, "covers") for p, d in covers] + [(*x, "belongs_to") for x in kin] + [(*x, "issues") for x in issues]
    least = lambda of: {p: min(v for q, v in of if q == p) for p, _ in of}
    within = lambda of, p, limit: limit is None or least(of).get(p, limit) <= limit
    want = set()
    for i, d, n, w, m in asks:
        found = {p for p, x in covers if x == d} or {p for p, x in covers if {k for y, k in kin if y == x} & {k for y, k in kin if y == d}}
        found = found if d else {p for p, _ in covers} | {p for _, p in issues}
        want |= {(i, p) for p in found if (n is None or (n, p) in issues) and within(waits, p, w) and within(most, p, m)}
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    args = frame(asks, "request_id int, disease string, insurer string, max_waiting int, max_deductible int"), frame(e, "src string, dst string, type string"), frame(waits, "product string, value int"), frame(most, "product string, value int")
    monkeypatch.setattr(G, "BLOCK", 5)
    got = [tuple(r) for r in G.complex_query(*args).collect()]
    assert sorted(got) == sorted(want)
