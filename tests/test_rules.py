import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera import rules
from tessera.operators import assemble as A
from tessera.operators import business as B
from tessera.operators import compliance as K
from tessera.operators import graph as G
from tessera.operators import retrieval as R
from tessera.operators import understand as U


def ask(spark, column, *texts):
    return [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string").select("i", column.alias("x")).orderBy("i").collect()]




def test_guard_and_intents(spark):
    role = F.lit("customer")
    assert ask(spark, U.domain_guard(F.col("q"), role), "理赔", "嗨", "今天天气", "随便问问") == ["pass", "greeting", "reject", "pass"]
    assert ask(spark, U.domain_guard(F.col("q"), F.lit("agent")), "嗨嗨", "嗨", "写代码") == ["pass", "greeting", "reject"]
    assert ask(spark, U.rule_intent(F.col("q")), "免赔额是多少", "我的保单", "能赔吗", "A和B对比", "你好") == ["条款解读", "保单查询", "理赔咨询", "产品对比", None]
    assert ask(spark, F.regexp_replace(U.T.normalize(F.col("q")), "x", "x"), "免赔额 '是'，\"多少\"？ A") == ['免赔额是"多少"a']


def test_linking(spark):
    assert ask(spark, U.link_longest(F.col("q"), rules.INSURERS, rules.INSURER_ALIASES), "太平洋的产品", "太平", "没有") == ["太平洋保险", "太平人寿", None]
    got = ask(spark, U.disease_of(F.col("q")), "肺炎能赔吗", "意外骨折", "头疼")
    assert (got[0].name, got[0].category) == ("肺炎", "传染") and got[1].name == "意外骨折" and got[2] is None
    assert ask(spark, U.dimensions(F.col("q")), "等待期和免赔额各多少钱") == [["等待期", "免赔额", "保费"]]
    assert ask(spark, U.link_products(F.col("q"), ("平安e生保", "众安尊享e生")), "平安e生保和众安尊享e生", "问问好医保怎样") == [["平安e生保", "众安尊享e生"], ["问问好医保"]]
    assert ask(spark, U.link_longest(F.col("q"), rules.EVENT_WORDS), "重症监护住院") == ["重症监护"]


def test_link_names_both_ways(spark):
    df = spark.createDataFrame([(1, "平安e生保和众安"), (2, "没有"), (3, "安")], "i int, q string")
    names = spark.createDataFrame([("平安e生保",), ("众安",), ("安",), ("e生保和众安保",)], "name string")
    want = [(1, "众安"), (1, "安"), (1, "平安e生保"), (3, "安")]
    assert sorted((r.i, r.mention) for r in U.link_names(df, "q", names).collect()) == want
    assert sorted((r.i, r.mention) for r in U.link_names(df, "q", names, prefix=1, few=0).collect()) == want
    long = names.where("length(name) > 1")
    assert sorted((r.i, r.mention) for r in U.link_names(df, "q", long, prefix=2, few=0).collect()) == [(1, "众安"), (1, "平安e生保")]


def test_constraints(spark):
    strict, fixed = (ask(spark, U.constraints(F.col("q"), m), "等待期不超过30天", "等待期少于30天免赔额不超过1万")[:] for m in ("strict", "fixed"))
    assert strict[0].max_waiting_days is None and fixed[0].max_waiting_days == 30
    assert fixed[1].max_deductible == 10_000 and strict[1].max_waiting_days == 30


AGENTS = json.loads((Path(__file__).parent / "data" / "agents.json").read_text())  # the names a caller gives the agents


@pytest.mark.parametrize("intent, query, primary, mode", [
    ("理赔咨询", "这是一条测试query", "claim", "multi_agent"), ("产品咨询", "这是一条测试query", "product", "multi_agent"), ("投保流程", "这是一条测试query", "product", "multi_agent"),
    ("核保咨询", "这是一条测试query", "risk", "multi_agent"), ("保单查询", "这是一条测试query", "service", "multi_agent"), ("投诉建议", "这是一条测试query", "service", "rag_fallback"),
    ("闲聊", "这是一条测试query", "service", "rag_fallback"), ("产品咨询", "你好", "product", "rag_fallback"), ("理赔咨询", "肺炎能赔吗", "claim", "multi_agent"),
])
def test_routes(spark, intent, query, primary, mode):
    asked = spark.createDataFrame([(1, intent, query)], "query_id int, intent string, query string")
    r = U.route(asked, U.routes(spark)).first()
    assert (r.primary, r.mode) == (primary, mode)
    r = U.route(asked, U.routes(spark, rules.renamed(rules.ROUTES, AGENTS))).first()
    assert (r.primary, r.mode) == (AGENTS.get(primary, primary), mode)


def test_tasks_and_grants(spark):
    df = spark.createDataFrame([(1, "产品咨询", "这是一条测试query"), (2, "理赔咨询", "这是一条测试query")], "query_id int, intent string, query string")
    got = sorted((r.query_id, r.task_id, r.agent_name, r.task_intent, r.dependencies) for r in U.build_tasks(U.route(df, U.routes(spark))).collect())
    assert got == [(1, "task_0", "product", "产品咨询", []), (1, "task_1", "service", "保单查询", ["task_0"]), (2, "task_0", "claim", "理赔咨询", []), (2, "task_1", "risk", "核保咨询", ["task_0"])]
    assert rules.renamed(rules.TOOL_DOMAINS, AGENTS)["product_compare"] == (AGENTS["product"],)
    asks = spark.createDataFrame([("claim", "customer"), ("claim", "admin")], "domain string, role string")
    tools = U.tool_grants(asks, U.grants(spark, rules.TOOL_DOMAINS, "domain"), U.grants(spark, rules.TOOL_ROLES, "role"))
    assert sorted((r.role, r.tool) for r in tools.collect()) == [("customer", "claim_tracking"), ("customer", "clause_search"), ("customer", "policy_query")]


def test_strategies(spark):
    none, two = F.array().cast("array<string>"), F.array(F.lit("甲"), F.lit("乙"))
    dims = F.array(F.lit("保费"))
    assert ask(spark, U.subqueries(F.col("q"), two, dims, F.lit(False)), "x") == [["甲 保费", "乙 保费"]]
    assert ask(spark, U.subqueries(F.col("q"), two, none, F.lit(False)), "x") == [["甲 条款", "乙 条款"]]
    assert ask(spark, U.subqueries(F.col("q"), two, dims, F.lit(True)), "x") == [["甲 保障范围 保费 免赔额", "乙 保障范围 保费 免赔额"]]
    assert ask(spark, U.subqueries(F.col("q"), none, dims, F.lit(False)), "x") == [["x"]]
    c = U.complexity(F.lit(False), F.lit("pass"), F.lit(False), F.lit("条款解读"), F.lit(0), F.col("q"))
    assert ask(spark, c, "你好啊", "退保", "等待期内住院怎么办") == [0, 1, 1]


def test_compliance(spark):
    texts = ["医生建议服药", "根据条款，医生建议", "一定能赔，肯定赔", "平安太坑了", "赔1000元", "根据条款赔1000元", "正常回答"]
    broken = ask(spark, K.violations(F.col("q"), F.lit("理赔咨询")), *texts)
    assert broken == [["medical_advice"], [], ["regulatory_word:一定能赔"], ["denigration"], ["amount_no_citation"], [], []]
    for role, want in (("customer", [False, True, False, False, False, True, True]), ("agent", [False, True, False, True, True, True, True])):
        assert ask(spark, K.verdict(K.violations(F.col("q"), F.lit("理赔咨询")), F.lit(role)), *texts) == want
    fixed = ask(spark, K.apply_fixes(F.col("q"), K.violations(F.col("q"), F.lit("理赔咨询")), "\n\n⚠️ N", " A约定为准。", "X"), *texts)
    assert fixed[0].startswith("医生建议服药\n\n⚠️") and fixed[2] == "，肯定赔" and fixed[4].endswith("约定为准。") and fixed[6] == "正常回答"
    noted = ask(spark, K.append_disclaimer(F.col("q"), K.violations(F.col("q"), F.lit("")), F.lit("customer"), "\n\n---"), "好 \n")
    assert noted[0].startswith("好\n\n---")


VECTORS = [
    ("test_chunk_001", [1.0, 0.0, 0.0, 0.0], "平安健康", "平安e生保", "保险责任", True), ("test_chunk_002", [0.0, 0.0, 1.0, 0.0], "平安健康", "平安e生保", "责任免除", True),
    ("test_chunk_003", [0.8, 0.2, 0.0, 0.0], "众安保险", "众安尊享e生", "保险责任", True), ("test_chunk_004", [0.1, 0.1, 0.1, 0.1], "平安健康", "平安e生保_旧版", "保险责任", False),
]


def test_vector_filters(spark):
    c = spark.createDataFrame([(*v, "child") for v in VECTORS], "id string, v array<double>, insurer string, product_name string, clause_type string, is_valid boolean, chunk_type string")
    one = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "query_id int, qv array<double>")
    ids = lambda df: [r.id[-1] for r in R.dense_topk(one, df, 4).orderBy("rank").collect()]
    assert ids(c.where(R.scalar_filter())) == ["1", "3", "2"]
    assert ids(c.where(R.scalar_filter({"insurer": "平安健康"}))) == ["1", "2"]
    assert ids(c.where(R.scalar_filter({"clause_type": ["保险责任"]}))) == ["1", "3"]
    assert ids(c.where(R.scalar_filter({"product_name": "平安"}))) == ["1", "2"]
    live = c.where(R.scalar_filter())
    exact = [(r.id, r.rank) for r in R.dense_topk(one, live, 3).collect()]
    assert sorted(exact) == sorted((r.id, r.rank) for r in R.ivf_topk(one, R.ivf_index(live, 2), 3, 2).collect())
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(0, "y", 1), (0, "z", 2)], "query_id int, id string, rank int")
    assert [r.id for r in R.rrf([a, b]).orderBy("rank").collect()] == ["y", "x", "z"]
    assert R.build_context(one, spark.createDataFrame([], "query_id int, rank int, product_name string, clause_type string, parent_text string, text string")).first().context == "暂无相关条款"


def test_ivf_recall_grows_with_probes(spark):
    """Searching more cells finds more, all of them everything; the vectors are near random, so half of the cells find about eight in ten."""
    from tessera.plans.retrieval import asked, chunks

    sf = "/root/testdata/sf0.01"
    live, q = chunks(spark, sf).where(R.scalar_filter()).cache(), asked(spark, sf).cache()
    exact = {(r.query_id, r.id) for r in R.dense_topk(q, live, 10).collect()}
    index = R.ivf_index(live, 16)
    share = [len(exact & {(r.query_id, r.id) for r in R.ivf_topk(q, index, 10, n).collect()}) / len(exact) for n in (1, 4, 8, 16)]
    assert share == sorted(share) and share[2] >= 0.8 and share[3] == 1.0


def test_search_in_blocks_equals_broadcast(spark, monkeypatch):
    from tessera.plans.retrieval import asked, chunks

    live, q = chunks(spark, "/root/testdata/sf0.001").where(R.scalar_filter()), asked(spark, "/root/testdata/sf0.001")
    q = q.unionByName(spark.createDataFrame([(-1, [0.0] * 64)], q.schema))
    rows = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())
    want = rows(R.dense_topk(q, live, 7))
    monkeypatch.setattr(R, "BROADCAST_ROWS", 3)
    assert rows(R.dense_topk(q, live, 7)) == want and len(want) == 7 * q.count()


def test_small_is_bounded_by_bytes(spark):
    df = spark.range(100).select("id", F.array_repeat(F.lit(1.0), 1000).alias("v"))
    broadcast = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString() or "hint" in x._jdf.queryExecution().analyzed().toString().lower()
    assert broadcast(R.small(df)) and not broadcast(R.small(df, most=100_000)) and not broadcast(R.small(df, rows=50))


def test_notices_of_the_house(spark):
    """Fixes and the disclaimer with the wording that a caller hands in."""
    n = json.loads((Path(__file__).parent / "data" / "notices.json").read_text())
    df = spark.createDataFrame([(1, "建议服药  ", ["medical_advice"]), (2, "千万别买平安的产品", ["denigration"]), (3, "赔1万元", ["amount_no_citation"]), (4, "一定能赔的", ["regulatory_word:一定能赔"]), (5, "好 ", [])], "id int, t string, b array<string>")
    fixed = K.apply_fixes(F.col("t"), F.col("b"), n["medical_note"], n["amount_note"], n["neutral"])
    got = {r.id: r.f for r in df.select("id", K.append_disclaimer(fixed, F.col("b"), F.lit("customer"), n["customer_note"]).alias("f")).collect()}
    assert got == {1: "建议服药" + n["medical_note"], 2: n["neutral"], 3: "赔1万元" + n["amount_note"], 4: "的", 5: "好" + n["customer_note"]}


def test_business_rules(spark):
    rates = spark.createDataFrame([(1, "健康险", 18, 25, "50万", 258.0, True), (2, "健康险", 26, 40, "50万", 358.0, True), (3, "健康险", 18, 60, "50万", 300.0, False)], "rate_id int, product_name string, min_age int, max_age int, sum_insured string, premium_yearly double, is_active boolean")
    req = spark.createDataFrame([(1, "健康", 20, None), (2, "健康", 26, "50万"), (3, "健康", 70, None)], "request_id int, product_name string, age int, sum_insured string")
    assert sorted((r.request_id, r.premium_yearly) for r in B.premium_lookup(req, rates).collect()) == [(1, 258.0), (2, 358.0)]
    hits = spark.createDataFrame([(1, "肺炎住院", "保险责任", 1, "住院保障"), (1, "肺炎住院", "责任免除", 2, "肺炎除外"), (2, "骨折", "保险责任", 1, "骨折赔付"), (3, "骨折", "释义", 1, "骨折")], "request_id int, event string, clause_type string, rank int, text string")
    assert sorted((r.request_id, r.verdict, r.citations) for r in B.claim_eligibility(hits).collect()) == [(1, "excluded", ["肺炎除外"]), (2, "covered", ["骨折赔付"]), (3, "unknown", [])]
    p = spark.createDataFrame([("u1", "平安", "e生保", True, 1), ("u2", "平安", "e生%保", True, 2)], "user_id string, insurer string, product_name string, is_valid boolean, effective_date int")
    r = spark.createDataFrame([(1, "customer", "u1", "u2", None, None), (2, "agent", "a", None, "平", "%")], "request_id int, role string, self_id string, user_id string, insurer string, product_name string")
    assert sorted((x.request_id, x.user_id) for x in B.policy_lookup(r, p).collect()) == [(1, "u1"), (2, "u2")]


def test_graph_rules(spark):
    nodes, edges = G.seed(spark)
    assert nodes.where("label = 'Category'").count() == 14 and edges.where("src = 'disease:肺炎'").count() == 2
    assert nodes.where("id = 'disease:肺炎'").first().attrs["category"] == "传染"
    text = "等待期为30天，等待期 90日。免赔额1万元，免赔额为5000元，年免赔额 2万"
    c = spark.createDataFrame([("p", "甲", "责任免除", text + "肺炎", None)], "product_code string, product_name string, clause_type string, text string, parent_text string")
    assert sorted(r.dst for r in G.waiting(c).collect()) == ["waiting:30", "waiting:90"]
    assert sorted(r.dst for r in G.deductibles(c).collect()) == ["deductible:10000", "deductible:20000", "deductible:5000"]
    ill = nodes.where("label = 'Disease'").select("name")
    assert [(r.src, r.dst, r.type) for r in G.mentions(c, ill).collect()] == [("clause:p:责任免除", "disease:肺炎", "excludes")]


def test_assembly(spark):
    calls = spark.createDataFrame([(1, 0, [], "Connection reset", 3), (1, 1, [0], None, 1), (1, 2, [], "bad", None), (1, 3, [2], None, 1), (1, 4, [3], None, 1)], "run_id int, idx int, depends_on array<int>, error string, ok_from int")
    assert [(r.status, r.error_type, r.tries) for r in A.resolve_calls(calls).orderBy("idx").collect()] == [("done", None, 3), ("done", None, 1), ("failed", "permanent", 1), ("skipped", "permanent", 0), ("skipped", "permanent", 0)]
    raw = spark.createDataFrame([(1, '```json\n[{"tool_name": "a", "tool_args": {"k": "1"}}, {"tool_args": {}}]\n```'), (2, "oops")], "id int, raw string")
    good, bad = A.parse_calls(raw, "raw")
    assert [(r.id, r.pos, r.tool_name, r.tool_args, r.depends_on) for r in good.collect()] == [(1, 0, "a", {"k": "1"}, [])] and [r.id for r in bad.collect()] == [2]


def test_ties_of_most_asked_go_by_key(spark):
    """More questions asked once than a sketch tells of."""
    from tessera.operators import understand as U

    keys = spark.range(4000).selectExpr("id % 3 AS day", "format_string('%06d', id * 7919 % 4000) AS key")
    got = [(r.key, r.hits) for r in U.faq_hot_counted(U.faq_counts(keys), 5).collect()]
    assert got == [(f"{i:06d}", 1) for i in range(5)]
