"""Queries of compliance, business tables, assembly and evaluation."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import assemble as A
from tessera.operators import business as B
from tessera.operators import compliance as K
from tessera.registry import query
from tessera.sources.tables import read_table

# Word lists of the synthetic corpus, standing in for the domain's.
MEDICAL, ADVICE, QUOTING = ("thing", "leau"), ("ation", "ment"), ("thndre",)
REGULATORY = ("ererth", "tionble", "menteau")
DENIGRATION = ("and.{0,10}(the|of)", "keit.{0,6}und")
AMOUNTS, CITATIONS = (r"\d+", "mill"), ("tion.*?ing",)
LISTS = {"medical": (MEDICAL, ADVICE, QUOTING), "regulatory": (REGULATORY,), "denigration": (DENIGRATION,), "citation": (AMOUNTS, CITATIONS)}
MED = "((contains(t,'thing') OR contains(t,'leau')) AND (contains(t,'ation') OR contains(t,'ment')) AND NOT contains(t,'thndre'))"
REG = "CASE WHEN contains(t,'ererth') THEN 'ererth' WHEN contains(t,'tionble') THEN 'tionble' WHEN contains(t,'menteau') THEN 'menteau' ELSE '' END"
DEN = "(regexp_matches(t,'and.{0,10}(the|of)') OR regexp_matches(t,'keit.{0,6}und'))"
CIT = r"((regexp_matches(t,'\d+') OR contains(t,'mill')) AND NOT regexp_matches(t,'tion.*?ing'))"
BROKEN = f"list_filter([CASE WHEN {MED} THEN 'medical_advice' END, CASE WHEN {REG} <> '' THEN 'regulatory_word:' || {REG} END, CASE WHEN {DEN} THEN 'denigration' END, CASE WHEN role IN ('user') AND {CIT} THEN 'amount_no_citation' END], lambda x: x IS NOT NULL)"
ANSWERS = f"a AS (SELECT conv_id, turn, role, t, {BROKEN} AS b, CASE WHEN conv_id % 2 = 0 THEN 'customer' ELSE 'agent' END AS r FROM (SELECT conv_id, turn, role, text AS t FROM conversations))"
PASSED = "(CASE WHEN len(b) = 0 THEN true WHEN r = 'customer' THEN false WHEN list_contains(b, 'medical_advice') OR len(list_filter(b, lambda x: starts_with(x, 'regulatory_word:'))) > 0 THEN false ELSE len(b) <= 1 END)"


def answers(spark, d):
    x = read_table(spark, d, "conversations").withColumn("b", K.violations(F.col("text"), F.col("role"), ("user",), **LISTS))
    return x.withColumn("r", F.when(F.col("conv_id") % 2 == 0, "customer").otherwise("agent"))


@query(f"SELECT doc_id, {MED} AS medical, {REG} AS word, {DEN} AS denigrates, {CIT} AS uncited FROM (SELECT doc_id, text AS t FROM documents)")
def c1_c4_checks(spark, d):
    return read_table(spark, d, "documents").select("doc_id", K.check_medical(F.col("text"), MEDICAL, ADVICE, QUOTING).alias("medical"), K.check_regulatory(F.col("text"), REGULATORY).alias("word"), K.check_denigration(F.col("text"), DENIGRATION).alias("denigrates"), K.check_citation(F.col("text"), AMOUNTS, CITATIONS).alias("uncited"))


@query(f"WITH {ANSWERS} SELECT conv_id, turn, array_to_string(b, ',') AS broken, {PASSED} AS passed FROM a")
def c5_verdict(spark, d):
    return answers(spark, d).select("conv_id", "turn", F.array_join("b", ",").alias("broken"), K.verdict(F.col("b"), F.col("r")).alias("passed"))


FIX = r"""f AS (SELECT *, CASE WHEN list_contains(b,'medical_advice') THEN regexp_replace(t,'\s+$','') || ' NOTE' ELSE t END AS f1 FROM a), f2 AS (SELECT *, CASE WHEN len(list_filter(b, lambda x: starts_with(x,'regulatory_word:'))) > 0 THEN replace(f1, substr(list_filter(b, lambda x: starts_with(x,'regulatory_word:'))[1], 17), '') ELSE f1 END AS g FROM f), f3 AS (SELECT *, CASE WHEN list_contains(b,'denigration') THEN regexp_replace(g, '(and|keit).{0,5}', 'neutral', 'g') ELSE g END AS h FROM f2), fixed AS (SELECT *, CASE WHEN list_contains(b,'amount_no_citation') THEN regexp_replace(h,'\s+$','') || ' AMOUNT' ELSE h END AS fixed FROM f3)"""


def fixed(spark, d):
    return answers(spark, d).withColumn("fixed", K.apply_fixes(F.col("text"), F.col("b"), " NOTE", " AMOUNT", "neutral", "(and|keit).{0,5}"))


@query(f"WITH {ANSWERS}, {FIX} SELECT conv_id, turn, md5(fixed) AS fixed_md5 FROM fixed")
def c6_fixes(spark, d):
    return fixed(spark, d).select("conv_id", "turn", F.md5("fixed").alias("fixed_md5"))


@query(rf"WITH {ANSWERS} SELECT conv_id, turn, md5(CASE WHEN len(b) = 0 AND r = 'customer' THEN regexp_replace(t,'\s+$','') || ' CARE' ELSE t END) AS noted_md5 FROM a")
def c7_disclaimer(spark, d):
    return answers(spark, d).select("conv_id", "turn", F.md5(K.append_disclaimer(F.col("text"), F.col("b"), F.col("r"), " CARE")).alias("noted_md5"))


@query(f"WITH {ANSWERS}, {FIX} SELECT conv_id, turn, md5(CASE WHEN {PASSED} THEN fixed ELSE 'SAFE' END) AS final_md5 FROM fixed")
def c8_final_answer(spark, d):
    x = fixed(spark, d)
    return x.select("conv_id", "turn", F.md5(K.final_answer(K.verdict(F.col("b"), F.col("r")), F.col("fixed"), F.col("text"), "SAFE")).alias("final_md5"))


@query("WITH p(domain, kind, phrase) AS (VALUES ('en','forbidden','thing'), ('en','handoff','ererth'), ('fr','forbidden','leau'), ('de','handoff','keit')) SELECT doc_id, kind, phrase FROM documents JOIN p ON lang = domain WHERE contains(text, phrase)")
def c9_phrase_scan(spark, d):
    p = spark.createDataFrame([("en", "forbidden", "thing"), ("en", "handoff", "ererth"), ("fr", "forbidden", "leau"), ("de", "handoff", "keit")], "domain string, kind string, phrase string")
    return K.phrase_scan(read_table(spark, d, "documents").select("doc_id", F.col("lang").alias("domain"), "text"), p).select("doc_id", "kind", "phrase")


POLICIES = "policies AS (SELECT o_custkey AS user_id, s_name AS insurer, p_name AS product_name, p_partkey AS code, o_orderstatus AS status, o_orderdate AS effective_date, l_returnflag <> 'R' AS is_valid, l_orderkey, l_linenumber, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"
CLAIMS = "claims AS (SELECT l_orderkey || '-' || l_linenumber AS report_no, max(o_custkey) AS user_id, max(l_linestatus) AS status, max(l_shipdate) AS submitted_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1)"


def policies(spark, d):
    li, o, p, s = (read_table(spark, d, n) for n in ("lineitem", "orders", "part", "supplier"))
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    return x.select(F.col("o_custkey").alias("user_id"), F.col("s_name").alias("insurer"), F.col("p_name").alias("product_name"), F.col("p_partkey").alias("code"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("effective_date"), (F.col("l_returnflag") != "R").alias("is_valid"), "l_orderkey", "l_linenumber", "l_extendedprice")


def claims(spark, d):
    li, o = read_table(spark, d, "lineitem").where("l_returnflag = 'R'"), read_table(spark, d, "orders")
    x = li.join(o, li.l_orderkey == o.o_orderkey)
    return x.groupBy(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("report_no")).agg(F.max("o_custkey").alias("user_id"), F.max("l_linestatus").alias("status"), F.max("l_shipdate").alias("submitted_at"))


@query(f"WITH {POLICIES}, r AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1 END AS who, CASE WHEN c_custkey % 3 = 0 THEN 'red' END AS rp FROM customer), m AS (SELECT request_id, code, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY request_id ORDER BY effective_date DESC, user_id, insurer, product_name, code, status, l_orderkey, l_linenumber, l_extendedprice) AS n FROM policies JOIN r ON user_id = who WHERE is_valid AND (rp IS NULL OR contains(product_name, rp))) SELECT request_id, code, l_orderkey, l_linenumber FROM m WHERE n <= 5")
def b1_policy_lookup(spark, d):
    c = read_table(spark, d, "customer")
    none = F.lit(None).cast("string")
    r = c.select(F.col("c_custkey").alias("request_id"), F.when(F.col("c_custkey") % 2 == 0, "customer").otherwise("agent").alias("role"), F.col("c_custkey").alias("self_id"), (F.col("c_custkey") + 1).alias("user_id"), none.alias("insurer"), F.when(F.col("c_custkey") % 3 == 0, "red").alias("product_name"))
    return B.policy_lookup(r, policies(spark, d)).select("request_id", "code", "l_orderkey", "l_linenumber")


@query(f"WITH {POLICIES}, r AS (SELECT s_suppkey AS request_id, substr(s_name, 1, 14) AS ri, CASE WHEN s_suppkey % 2 = 0 THEN 'red' END AS rp FROM supplier WHERE s_suppkey % 3 <> 0), m AS (SELECT request_id, code, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY request_id ORDER BY effective_date DESC, user_id, insurer, product_name, code, status, l_orderkey, l_linenumber, l_extendedprice) AS n FROM policies JOIN r ON contains(insurer, ri) AND (rp IS NULL OR contains(product_name, rp)) WHERE is_valid) SELECT request_id, code, l_orderkey, l_linenumber FROM m WHERE n <= 5")
def b1_policy_lookup_by_insurer(spark, d):
    """Staff ask by insurer without a user; customers without one get nothing."""
    s = read_table(spark, d, "supplier")
    none = F.lit(None).cast("long")
    r = s.select(F.col("s_suppkey").alias("request_id"), F.when(F.col("s_suppkey") % 3 != 0, "agent").otherwise("customer").alias("role"), none.alias("self_id"), none.alias("user_id"), F.substring("s_name", 1, 14).alias("insurer"), F.when(F.col("s_suppkey") % 2 == 0, "red").alias("product_name"))
    return B.policy_lookup(r, policies(spark, d)).select("request_id", "code", "l_orderkey", "l_linenumber")


@query(f"WITH {CLAIMS}, r AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber AS report_no, l_orderkey FROM lineitem) SELECT r.report_no AS request_id, r.report_no, CASE WHEN l_orderkey % 2 = 0 THEN CASE WHEN c.user_id = l_orderkey % 150 THEN status END ELSE status END AS status FROM r LEFT JOIN claims c USING (report_no)")
def b2_claim_lookup(spark, d):
    li = read_table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("report_no"), "l_orderkey").distinct()
    r = li.select(F.col("report_no").alias("request_id"), "report_no", F.when(F.col("l_orderkey") % 2 == 0, "customer").otherwise("agent").alias("role"), (F.col("l_orderkey") % 150).alias("self_id"), F.lit(None).cast("long").alias("user_id"))
    return B.claim_lookup(r, claims(spark, d))


@query("WITH m AS (SELECT c_custkey AS request_id, p_partkey AS rate_id, 1 + c_custkey % 60 AS age, p_retailprice AS premium_yearly, row_number() OVER (PARTITION BY c_custkey ORDER BY p_retailprice, p_partkey) AS n FROM part JOIN customer ON 1 + c_custkey % 60 BETWEEN p_size AND p_size + 10 WHERE p_size <= 45 AND contains(p_name, CASE c_custkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'ring' ELSE 'small' END) AND (c_custkey % 2 = 0 OR p_type = 'PROMO')) SELECT request_id, rate_id, age, premium_yearly FROM m WHERE n = 1")
def b3_premium_lookup(spark, d):
    p = read_table(spark, d, "part")
    rates = p.select(F.col("p_partkey").alias("rate_id"), F.col("p_name").alias("product_name"), F.col("p_size").alias("min_age"), (F.col("p_size") + 10).alias("max_age"), F.col("p_type").alias("sum_insured"), F.col("p_retailprice").alias("premium_yearly"), (F.col("p_size") <= 45).alias("is_active"))
    k = F.col("c_custkey")
    r = read_table(spark, d, "customer").select(k.alias("request_id"), F.when(k % 3 == 0, "red").when(k % 3 == 1, "ring").otherwise("small").alias("product_name"), (1 + k % 60).alias("age"), F.when(k % 2 != 0, "PROMO").alias("sum_insured"))
    return B.premium_lookup(r, rates)


@query("WITH h AS (SELECT p_brand, p_type, p_name, p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice, p_partkey) AS rank FROM part) SELECT p_brand AS product_name, string_agg(substr(p_name, 1, 5), chr(10) ORDER BY rank) FILTER (p_type = 'PROMO') AS \"PROMO\", string_agg(substr(p_name, 1, 5), chr(10) ORDER BY rank) FILTER (p_type = 'SMALL') AS \"SMALL\" FROM h WHERE rank <= 3 AND p_type IN ('PROMO','SMALL') GROUP BY 1")
def b4_product_comparison(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand", "p_type").orderBy("p_retailprice", "p_partkey")
    h = read_table(spark, d, "part").select(F.lit(0).alias("query_id"), F.col("p_brand").alias("product_name"), F.col("p_type").alias("dim"), F.row_number().over(w).alias("rank"), F.col("p_name").alias("text"))
    return B.compare_products(h.where(F.col("dim").isin("PROMO", "SMALL")), ["PROMO", "SMALL"], 3, 5).drop("query_id")


@query("WITH h AS (SELECT conv_id AS request_id, turn AS rank, role AS clause_type, text, ['thing','th','hi','in','ng'] AS ws FROM conversations), x AS (SELECT *, len(list_filter(ws, lambda w: contains(text, w))) > 0 AS hit FROM h), v AS (SELECT request_id, CASE WHEN bool_or(hit AND clause_type = 'system') THEN 'excluded' WHEN bool_or(hit AND clause_type = 'user') THEN 'covered' ELSE 'unknown' END AS verdict FROM x GROUP BY 1) SELECT v.request_id, verdict, coalesce(md5(array_to_string((list(substr(text, 1, 20) ORDER BY rank) FILTER (hit AND ((verdict = 'excluded' AND clause_type = 'system') OR (verdict = 'covered' AND clause_type = 'user'))))[1:3], '|')), md5('')) AS cited_md5 FROM v JOIN x USING (request_id) GROUP BY v.request_id, verdict")
def b5_claim_eligibility(spark, d):
    h = read_table(spark, d, "conversations").select(F.col("conv_id").alias("request_id"), F.lit("thing").alias("event"), F.col("role").alias("clause_type"), F.col("turn").alias("rank"), "text")
    return B.claim_eligibility(h, "user", "system", 3, 20).select("request_id", "verdict", F.md5(F.array_join("citations", "|")).alias("cited_md5"))


def products(spark, d):
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("insurer"), F.col("p_type").alias("category"), (F.col("p_size") <= 25).alias("is_active"))


@query("SELECT e.event_id, p_name AS name, p_brand AS insurer FROM events e LEFT JOIN part ON p_partkey = e.event_id")
def b6_product_lookup(spark, d):
    r = read_table(spark, d, "events").select("event_id", F.col("event_id").alias("code"))
    return B.product_lookup(r, products(spark, d)).select("event_id", "name", "insurer")


@query("SELECT p_brand AS insurer, md5(string_agg(p_name, ',' ORDER BY p_name, p_partkey)) AS names_md5 FROM part WHERE p_size <= 25 GROUP BY 1")
def b7_insurer_products(spark, d):
    x = products(spark, d)
    return B.insurer_products(x.select("insurer"), x).select("insurer", F.md5(F.array_join("names", ",")).alias("names_md5"))


PROFILE = f"{POLICIES}, {CLAIMS}, p AS (SELECT user_id, list(product_name || '(' || insurer || ', ' || status || ')' ORDER BY n) AS ps FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY effective_date DESC, product_name, insurer, status) AS n FROM policies) WHERE n <= 10 GROUP BY 1), c AS (SELECT user_id, list(report_no || '(' || status || ')' ORDER BY n) AS cs FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY submitted_at DESC, report_no, status) AS n FROM claims) WHERE n <= 10 GROUP BY 1), f AS (SELECT c_custkey AS user_id, ps, cs FROM customer LEFT JOIN p ON p.user_id = c_custkey LEFT JOIN c ON c.user_id = c_custkey)"


def profile(spark, d):
    return B.user_profile(read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), policies(spark, d), claims(spark, d))


@query(f"WITH {PROFILE} SELECT user_id, coalesce(len(ps), 0)::INT AS n_policies, coalesce(len(cs), 0)::INT AS n_claims, md5(concat_ws(';', array_to_string(ps, ';'), array_to_string(cs, ';'))) AS held_md5, ps IS NOT NULL OR cs IS NOT NULL AS has_data FROM f")
def b8_user_profile(spark, d):
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    p = F.array_join(F.transform("policies", lambda x: F.concat(x["product_name"], F.lit("("), x["insurer"], F.lit(", "), x["status"], F.lit(")"))), ";")
    c = F.array_join(F.transform("claims", lambda x: F.concat(x["report_no"], F.lit("("), x["status"], F.lit(")"))), ";")
    return profile(spark, d).select("user_id", F.when(F.col("policies").isNull(), 0).otherwise(n("policies")).alias("n_policies"), F.when(F.col("claims").isNull(), 0).otherwise(n("claims")).alias("n_claims"), F.md5(F.concat_ws(";", p, c)).alias("held_md5"), "has_data")


@query(f"WITH {PROFILE}, s AS (SELECT user_id, concat_ws(chr(10), CASE WHEN len(ps) > 0 THEN '  • 已购保单(' || len(ps) || '): ' || array_to_string(ps[1:3], '; ') END, CASE WHEN len(cs) > 0 THEN '  • 理赔记录(' || len(cs) || '): ' || array_to_string(cs[1:3], '; ') END) AS body FROM f) SELECT user_id, md5(CASE WHEN body <> '' THEN '用户画像:' || chr(10) || body ELSE '' END) AS summary_md5 FROM s")
def b9_profile_summary(spark, d):
    return profile(spark, d).select("user_id", F.md5(B.profile_summary(F.col("policies"), F.col("claims"))).alias("summary_md5"))


@query("WITH p(c, stages) AS (VALUES (0, ['faq','chitchat']), (1, ['classify','cache','retrieval','generate','compliance']), (2, ['classify','cache','kg','strategy','retrieval','quality','generate','compliance','cache_write'])) SELECT conv_id * 100 + turn AS query_id, (unnest(range(1, len(stages) + 1)) - 1)::INT AS pos, unnest(stages) AS stage FROM conversations JOIN p ON c = turn % 3")
def a1_stage_plan(spark, d):
    return A.stage_plan(read_table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), (F.col("turn") % 3).alias("complexity")))


LOG = "l AS (SELECT user_id AS query_id, event_id AS pos, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skip' ELSE 'success' END AS status, CASE WHEN value > 20 THEN props END AS answer FROM events)"


@query(f"WITH {LOG}, m AS (SELECT *, min(CASE WHEN status = 'failed' OR (status = 'skip' AND answer IS NOT NULL) THEN pos END) OVER (PARTITION BY query_id) AS last FROM l) SELECT query_id, pos, status FROM m WHERE last IS NULL OR pos <= last")
def a2_short_circuit(spark, d):
    e = read_table(spark, d, "events")
    x = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skip").otherwise("success").alias("status"), F.when(F.col("value") > 20, F.col("props")).alias("answer"))
    return A.short_circuit(x).select("query_id", "pos", "status")


TASKS = "r AS (SELECT event_id // 2 AS query_id, 'task_' || (event_id % 2) AS task_id, event_type AS agent_name, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'degraded' ELSE 'success' END AS status, props AS result, CASE WHEN event_id % 3 = 0 THEN 'note' END AS disclaimer FROM events)"


def tasks(spark, d):
    e = read_table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "degraded").otherwise("success")
    return e.select(F.expr("event_id div 2").alias("query_id"), F.concat(F.lit("task_"), F.col("event_id") % 2).alias("task_id"), F.col("event_type").alias("agent_name"), status.alias("status"), F.col("props").alias("result"), F.when(F.col("event_id") % 3 == 0, "note").alias("disclaimer"))


@query(f"WITH {TASKS}, g AS (SELECT query_id, list(agent_name ORDER BY task_id) AS names, list({{'t': task_id, 'r': result, 'd': disclaimer}} ORDER BY task_id) FILTER (status <> 'failed') AS good FROM r GROUP BY 1) SELECT query_id, CASE WHEN good IS NULL THEN '抱歉，' || array_to_string(names, '、') || ' 服务当前不可用。' || chr(10) || '建议您联系人工客服获取帮助。' WHEN len(good) = 1 THEN good[1].r || CASE WHEN coalesce(good[1].d, '') <> '' THEN chr(10) || chr(10) || '---' || chr(10) || good[1].d ELSE '' END ELSE array_to_string(list_transform(good, lambda x: '【' || x.t || '】' || x.r), chr(10) || chr(10) || '---' || chr(10) || chr(10)) END AS answer FROM g")
def a3_aggregate_results(spark, d):
    return A.aggregate_results(tasks(spark, d))


@query("WITH o AS (SELECT source AS query_id, doc_id AS pos, lang AS clause_no, text, row_number() OVER (PARTITION BY source, lang, substr(text, 1, 80) ORDER BY doc_id) AS n FROM documents), m AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS nth FROM o WHERE n = 1) SELECT query_id, pos FROM m WHERE nth <= 10")
def a4_collect_sources(spark, d):
    x = read_table(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("pos"), F.col("lang").alias("clause_no"), "text")
    return A.collect_sources(x).select("query_id", "pos")


@query(f"WITH {TASKS} SELECT a.query_id, a.task_id, b.result AS upstream, b.result IS NULL AS unmet FROM r a LEFT JOIN r b ON a.query_id = b.query_id AND b.task_id = 'task_0' AND b.status <> 'failed' WHERE a.task_id = 'task_1'")
def a5_inject_upstream(spark, d):
    r = tasks(spark, d)
    none = F.array().cast("array<string>")
    return A.inject_upstream(r.select("query_id", "task_id", F.when(F.col("task_id") == "task_1", F.array(F.lit("task_0"))).otherwise(none).alias("dependencies")), r).select("query_id", "task_id", "upstream", "unmet")


@query("""WITH RECURSIVE c AS (SELECT event_id // 5 AS run_id, (event_id % 5)::INT AS idx, event_type, event_type IN ('error','view') AS err, event_type = 'error' AS transient, CASE event_type WHEN 'error' THEN 1 + event_id % 5 WHEN 'view' THEN NULL ELSE 1 END AS ok_from FROM events),
k AS (SELECT *, coalesce(ok_from > CASE WHEN transient THEN 3 ELSE 1 END, true) AS fails FROM c),
s AS (SELECT run_id, idx, CASE WHEN fails THEN 'failed' ELSE 'done' END AS status FROM k WHERE idx = 0 UNION ALL SELECT k.run_id, k.idx, CASE WHEN s.status <> 'done' AND k.idx % 2 = 1 THEN 'skipped' WHEN k.fails THEN 'failed' ELSE 'done' END FROM s JOIN k ON k.run_id = s.run_id AND k.idx = s.idx + 1)
SELECT s.run_id, s.idx, s.status, CASE WHEN s.status = 'skipped' THEN 0 WHEN transient THEN least(coalesce(ok_from, 4), 3) ELSE 1 END::INT AS tries FROM s JOIN k USING (run_id, idx)""")
def a6_resolve_calls(spark, d):
    e = read_table(spark, d, "events")
    k = (F.col("event_id") % 5).cast("int")
    kind = F.col("event_type")
    x = e.select(F.expr("event_id div 5").alias("run_id"), k.alias("idx"), F.when(k % 2 == 1, F.array(k - 1)).otherwise(F.array().cast("array<int>")).alias("depends_on"), F.when(kind == "error", "Connection lost").when(kind == "view", "bad argument").alias("error"), F.when(kind == "error", (1 + F.col("event_id") % 5).cast("int")).when(kind == "view", F.lit(None)).otherwise(1).cast("int").alias("ok_from"))
    return A.resolve_calls(x).select("run_id", "idx", "status", "tries")


@query("""WITH RECURSIVE c AS (SELECT event_id // 8 AS run_id, (event_id % 8)::INT AS idx, (event_id // 8) % 6 AS shape, event_type = 'error' AS transient, CASE event_type WHEN 'error' THEN 1 + event_id % 4 WHEN 'view' THEN 9 ELSE 1 END AS ok_from FROM events),
k AS (SELECT *, CASE shape WHEN 0 THEN [idx + 1] WHEN 1 THEN [idx - 1, idx - 1] WHEN 2 THEN CASE WHEN idx < 3 THEN [(idx + 1) % 3] WHEN idx < 5 THEN [2] WHEN idx = 5 THEN [6] WHEN idx = 6 THEN [5, 40] ELSE [-1] END WHEN 3 THEN [40, -1] WHEN 4 THEN [7 - idx] ELSE CASE WHEN idx % 2 = 0 THEN [idx + 1] ELSE [idx - 3] END END AS deps FROM c),
own AS (SELECT run_id, idx FROM k),
g AS (SELECT run_id, list({'idx': idx, 'transient': transient, 'most': CASE WHEN transient THEN 3 ELSE 1 END, 'ok_from': ok_from, 'deps': deps} ORDER BY idx) AS calls FROM k GROUP BY run_id),
b AS (SELECT run_id, list_transform(calls, lambda x: {'idx': x.idx, 'transient': x.transient, 'most': x.most, 'ok_from': x.ok_from, 'deps': list_filter(list_distinct(x.deps), lambda i: len(list_filter(calls, lambda y: y.idx = i)) > 0)}) AS calls FROM g),
r AS (SELECT run_id, 0 AS n, calls, list_transform(calls, lambda x: {'idx': x.idx, 'status': 'open', 'tries': 0, 'at': NULL::INT}) AS s FROM b
UNION ALL SELECT run_id, n + 1, calls, list_transform(calls, lambda x: list_transform([{'bad': len(list_filter(s, lambda y: list_contains(x.deps, y.idx) AND y.status IN ('failed', 'skipped'))) > 0, 'open': len(list_filter(s, lambda y: list_contains(x.deps, y.idx) AND y.status = 'open')) > 0, 'late': len(list_filter(s, lambda y: list_contains(x.deps, y.idx) AND y.status = 'waiting')) > 0, 'start': coalesce(list_max(list_transform(list_filter(s, lambda y: list_contains(x.deps, y.idx) AND y.status = 'done'), lambda y: y.at + (y.idx > x.idx)::INT)), 1)}], lambda z: CASE WHEN z.bad THEN {'idx': x.idx, 'status': 'skipped', 'tries': 0, 'at': NULL::INT} WHEN z.open THEN {'idx': x.idx, 'status': 'open', 'tries': 0, 'at': NULL::INT} WHEN z.late OR z.start > 3 THEN {'idx': x.idx, 'status': 'waiting', 'tries': 0, 'at': NULL::INT} WHEN x.ok_from <= least(x.most, 4 - z.start) THEN {'idx': x.idx, 'status': 'done', 'tries': x.ok_from::INT, 'at': (z.start + x.ok_from - 1)::INT} ELSE {'idx': x.idx, 'status': 'failed', 'tries': least(x.most, 4 - z.start)::INT, 'at': NULL::INT} END)[1]) FROM r WHERE n < 9),
reach(run_id, a, z) AS (SELECT run_id, x.idx, unnest(x.deps) FROM (SELECT run_id, unnest(calls) AS x FROM b) UNION SELECT reach.run_id, a, unnest(x.deps) FROM reach JOIN (SELECT run_id, unnest(calls) AS x FROM b) q ON q.run_id = reach.run_id AND q.x.idx = z),
circle AS (SELECT run_id, a AS idx, min(z) AS cycle FROM reach WHERE (run_id, a, a) IN (SELECT run_id, a, z FROM reach) AND (run_id, z, a) IN (SELECT run_id, a, z FROM reach) GROUP BY ALL)
SELECT f.run_id, o.idx AS idx, CASE o.status WHEN 'open' THEN 'waiting' ELSE o.status END AS status, o.tries AS tries, cycle FROM (SELECT run_id, unnest(s) AS o FROM r WHERE n = 9) f LEFT JOIN circle ON circle.run_id = f.run_id AND circle.idx = o.idx""")
def a6_resolve_graph(spark, d):
    """Runs of eight calls that depend forwards, backwards, crosswise, in circles, on themselves and on calls that do not exist; three rounds a run."""
    e = read_table(spark, d, "events")
    i, shape, kind = (F.col("event_id") % 8).cast("int"), F.expr("event_id div 8") % 6, F.col("event_type")
    circle = F.when(i < 3, F.array((i + 1) % 3)).when(i < 5, F.array(F.lit(2))).when(i == 5, F.array(F.lit(6))).when(i == 6, F.array(F.lit(5), F.lit(40))).otherwise(F.array(F.lit(-1)))
    deps = F.when(shape == 0, F.array(i + 1)).when(shape == 1, F.array(i - 1, i - 1)).when(shape == 2, circle).when(shape == 3, F.array(F.lit(40), F.lit(-1))).when(shape == 4, F.array(7 - i)).otherwise(F.when(i % 2 == 0, F.array(i + 1)).otherwise(F.array(i - 3)))
    ok = F.when(kind == "error", 1 + F.col("event_id") % 4).when(kind == "view", F.lit(None)).otherwise(1).cast("int")
    x = e.select(F.expr("event_id div 8").alias("run_id"), i.alias("idx"), deps.alias("depends_on"), F.when(kind == "error", "Request timed out").when(kind == "view", "bad argument").alias("error"), ok.alias("ok_from"))
    return A.resolve_calls(x, budget=3).select("run_id", "idx", "status", "tries", "cycle")


@query("SELECT event_id, coalesce(try_cast(nullif(regexp_extract(s, 'confidence=([0-9.]+)', 1), '') AS DOUBLE), CASE WHEN event_type <> 'error' THEN 0.8 ELSE 0.5 END) AS confidence FROM (SELECT event_id, event_type, CASE WHEN value > 50 THEN 'confidence=0.' || (event_id % 10) ELSE 'none' END AS s FROM events)")
def a7_confidence(spark, d):
    s = F.when(F.col("value") > 50, F.concat(F.lit("confidence=0."), F.col("event_id") % 10)).otherwise("none")
    return read_table(spark, d, "events").select("event_id", A.confidence(s, F.col("event_type") != "error").alias("confidence"))


@query("SELECT event_id, 'tool' || (event_id % 3) AS tool_name, regexp_extract(props, '([0-9]+)', 1) AS arg FROM events WHERE event_type NOT IN ('error', 'signup') UNION ALL SELECT event_id, 'bad', NULL FROM events WHERE event_type = 'error'")
def a8_parse_calls(spark, d):
    e = read_table(spark, d, "events")
    call = F.concat(F.lit('[{"tool_name":"tool'), F.col("event_id") % 3, F.lit('","tool_args":'), "props", F.lit("}]"))
    raw = F.when(F.col("event_type") == "error", "not json").when(F.col("event_type") == "signup", '[{"tool_args":{}}]').when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), call, F.lit("\n```"))).otherwise(call)
    good, bad = A.parse_calls(e.select("event_id", raw.alias("raw")), "raw")
    return good.select("event_id", "tool_name", F.try_element_at("tool_args", F.lit("k")).alias("arg")).unionByName(bad.select("event_id", F.lit("bad").alias("tool_name"), F.lit(None).cast("string").alias("arg")))


LOGITS = "g AS (SELECT vec_id, label, list_transform(range(10), lambda c: 4 * list_sum(list_transform(list_filter(range(1, len(embedding) + 1), lambda i: (i - 1) % 10 = c), lambda i: embedding[i]::DOUBLE))) AS z FROM embeddings), p AS (SELECT *, list_transform(z, lambda x: exp((x - list_max(z)) / 1.5)) AS e FROM g), r AS (SELECT vec_id, label, list_position(e, list_max(e))::INT - 1 AS pred, round(list_max(e) / list_sum(e), 4) AS confidence FROM p)"


def logits():
    """Ten class scores: every tenth component of a vector, summed."""
    part = lambda c: F.filter("embedding", lambda v, i: i % 10 == c)
    return F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: 4 * F.aggregate(part(c), F.lit(0.0), lambda a, v: a + v.cast("double")))


def predicted(spark, d):
    x = read_table(spark, d, "embeddings").select("vec_id", "label", logits().alias("logits"))
    return A.predict_from_logits(x, temperature=1.5)


@query(f"WITH {LOGITS} SELECT vec_id, pred, confidence FROM r")
def e1_predict(spark, d):
    return predicted(spark, d).select("vec_id", "pred", "confidence")


@query(f"WITH {LOGITS} SELECT l.label::VARCHAR AS label, count(r.label) AS n, round(avg((r.label = pred)::INT), 6) AS accuracy FROM (SELECT unnest(range(12))::INT AS label) l LEFT JOIN r ON r.label = l.label GROUP BY 1 UNION ALL SELECT 'all', count(*), round(avg((label = pred)::INT), 6) FROM r")
def e2_accuracy(spark, d):
    spine = predicted(spark, d).agg(F.explode(F.sequence(F.least(F.min("label"), F.lit(0)), F.greatest(F.max("label"), F.lit(11)))).alias("label"))
    return A.accuracy(predicted(spark, d), spine).select(F.coalesce(F.col("label").cast("string"), F.lit("all")).alias("label"), "n", F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {LOGITS} SELECT label, pred, count(*) AS n FROM r GROUP BY ALL")
def e3_confusion(spark, d):
    return A.confusion(predicted(spark, d))


@query(f"WITH {LOGITS}, t AS (SELECT i, pow(10, -0.5 + i / 19.0::DOUBLE) AS t FROM range(20) x(i)), l AS (SELECT i, t, avg(-ln(list_transform(z, lambda x: exp((x - list_max(z)) / t))[label + 1] / list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / t))) + 1e-8)) AS nll FROM g, t GROUP BY ALL) SELECT round(arg_min(t, (round(nll, 12), i)), 6) AS temperature, round(min(nll), 6) AS nll FROM l")
def e4_calibrate(spark, d):
    x = read_table(spark, d, "embeddings").select("label", logits().alias("logits"))
    return A.calibrate(x).select(F.round("temperature", 6).alias("temperature"), F.round("nll", 6).alias("nll"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::VARCHAR), doc_id) <= ceil(count(*) OVER (PARTITION BY toxic) * 0.1) AS held_out FROM labels")
def e5_stratified_split(spark, d):
    return A.stratified_split(read_table(spark, d, "labels"), label="toxic").select("doc_id", "held_out")
