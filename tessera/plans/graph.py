"""Queries of the knowledge graph: nations, regions, suppliers, customers and parts stand in for the domain's nodes."""

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.registry import query
from tessera.sources.tables import read_table

N_SQL = "nodes AS (SELECT 'r' || r_regionkey AS id, 'Region' AS label, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name FROM supplier UNION ALL SELECT 'c' || c_custkey, 'Customer', c_name FROM customer)"
E_SQL = "edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'in_region' AS type FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'in_nation' FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'in_nation' FROM customer)"
U_SQL = "u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"
P_SQL = "pe AS (SELECT DISTINCT 's' || l_suppkey AS product, 'p' || l_partkey || ':' || l_returnflag AS clause, 'p' || l_partkey AS disease, CASE WHEN l_returnflag <> 'R' THEN 'covers' ELSE 'excludes' END AS rel FROM lineitem), pb AS (SELECT 'p' || p_partkey AS disease, p_brand AS category FROM part)"


def key(prefix, c):
    return F.concat(F.lit(prefix), F.col(c))


def nodes(spark, d):
    t = lambda n: read_table(spark, d, n)
    return (
        t("region").select(*G.node(key("r", "r_regionkey"), "Region", F.col("r_name")))
        .unionByName(t("nation").select(*G.node(key("n", "n_nationkey"), "Nation", F.col("n_name"))))
        .unionByName(t("supplier").select(*G.node(key("s", "s_suppkey"), "Supplier", F.col("s_name"))))
        .unionByName(t("customer").select(*G.node(key("c", "c_custkey"), "Customer", F.col("c_name"))))
    )


def edges(spark, d):
    t = lambda n: read_table(spark, d, n)
    return (
        t("nation").select(*G.edge(key("n", "n_nationkey"), key("r", "n_regionkey"), "in_region"))
        .unionByName(t("supplier").select(*G.edge(key("s", "s_suppkey"), key("n", "s_nationkey"), "in_nation")))
        .unionByName(t("customer").select(*G.edge(key("c", "c_custkey"), key("n", "c_nationkey"), "in_nation")))
    )


def part_edges(spark, d):
    """Suppliers have clauses (part and return flag) that cover or exclude parts, which belong to brands."""
    li, p = read_table(spark, d, "lineitem"), read_table(spark, d, "part")
    clause = F.concat(F.lit("p"), "l_partkey", F.lit(":"), "l_returnflag")
    rel = F.when(F.col("l_returnflag") != "R", "covers").otherwise("excludes")
    return (
        li.select(*G.edge(key("s", "l_suppkey"), clause, "has_clause")).distinct()
        .unionByName(li.select(*G.edge(clause, key("p", "l_partkey"), rel)).distinct())
        .unionByName(p.select(*G.edge(key("p", "p_partkey"), F.col("p_brand"), "belongs_to")))
    )


def seeded(spark, d):
    p = read_table(spark, d, "part")
    names = p.groupBy(F.col("p_type").alias("category"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("pos"))
    return G.seed_tables(names, p.where("p_size <= 10").select(F.concat(F.lit("size"), "p_size").alias("alias"), F.col("p_brand").alias("name")).distinct())


@query("SELECT p_type AS category, p_name AS name, count(*) > 0 AS linked FROM part GROUP BY ALL")
def k1_seed_edges(spark, d):
    _, e = seeded(spark, d)
    return e.select(F.substring("dst", 10, 100).alias("category"), F.substring("src", 9, 100).alias("name"), F.lit(True).alias("linked"))


@query("WITH d AS (SELECT p_type AS category, p_name AS name, min(p_partkey) AS pos FROM part GROUP BY ALL), n AS (SELECT 'category:' || category AS id, 'Category' AS label, category AS name, NULL AS attr FROM (SELECT DISTINCT category FROM d) UNION ALL SELECT 'disease:' || name, 'Disease', name, arg_max(category, pos) FROM d GROUP BY name UNION ALL SELECT 'insurer:' || p_brand, 'Insurer', p_brand, string_agg(DISTINCT 'size' || p_size, ',' ORDER BY 'size' || p_size) FROM part WHERE p_size <= 10 GROUP BY p_brand) SELECT * FROM n")
def k1_seed_nodes(spark, d):
    n, _ = seeded(spark, d)
    return n.select("id", "label", "name", F.coalesce(F.try_element_at("attrs", F.lit("category")), F.try_element_at("attrs", F.lit("aliases"))).alias("attr"))


@query("SELECT DISTINCT 'insurer:' || CASE WHEN p_brand = 'Brand#2' THEN 'Two' ELSE p_brand END AS src, 'product:' || CASE WHEN p_size % 2 = 0 THEN p_partkey::VARCHAR ELSE p_name END AS dst FROM part WHERE p_size <= 40")
def k2_from_policies(spark, d):
    x = read_table(spark, d, "part").select(F.col("p_brand").alias("insurer"), F.col("p_name").alias("product_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_partkey").cast("string")).otherwise("").alias("code"), (F.col("p_size") <= 40).alias("is_valid"))
    return G.from_policies(x, {"Brand#2": "Two"})[1].select("src", "dst")


@query("WITH x AS (SELECT DISTINCT CASE WHEN p_brand = 'Brand#2' THEN 'Two' ELSE p_brand END AS insurer, CASE WHEN p_size % 2 = 0 THEN p_partkey::VARCHAR ELSE p_name END AS k, p_name FROM part WHERE p_size <= 40) SELECT 'insurer:' || insurer AS id, 'Insurer' AS label, insurer AS name FROM (SELECT DISTINCT insurer FROM x) UNION ALL SELECT 'product:' || k, 'Product', min(p_name) FROM x GROUP BY k")
def k2_policy_nodes(spark, d):
    x = read_table(spark, d, "part").select(F.col("p_brand").alias("insurer"), F.col("p_name").alias("product_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_partkey").cast("string")).otherwise("").alias("code"), (F.col("p_size") <= 40).alias("is_valid"))
    return G.from_policies(x, {"Brand#2": "Two"})[0].select("id", "label", "name")


@query("SELECT DISTINCT 'product:' || source AS id, 'Product' AS label, source AS name FROM documents WHERE length(text) > 0 UNION SELECT DISTINCT 'clause:' || source || ':' || lang, 'Clause', lang FROM documents WHERE length(text) > 0")
def k3_clause_nodes(spark, d):
    return G.from_clauses(clauses(spark, d))[0].select("id", "label", "name")


@query("SELECT l_suppkey::VARCHAR AS src, l_partkey::VARCHAR AS dst, l_returnflag AS type FROM lineitem GROUP BY ALL")
def k8_merge_edges(spark, d):
    e = read_table(spark, d, "lineitem").select("l_orderkey", *G.edge(F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_returnflag")))
    return G.merge_edges(e.where("l_orderkey % 3 <> 0").drop("l_orderkey").distinct(), e.where("l_orderkey % 2 = 0 or l_orderkey % 3 = 0").drop("l_orderkey"))


def clauses(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.col("source").alias("product_code"), F.col("source").alias("product_name"), F.col("lang").alias("clause_type"), "text", F.lit(None).cast("string").alias("parent_text"))


@query("SELECT DISTINCT 'product:' || source AS src, 'clause:' || source || ':' || lang AS dst FROM documents WHERE length(text) > 0")
def k3_from_clauses(spark, d):
    return G.from_clauses(clauses(spark, d))[1].select("src", "dst")


@query("SELECT DISTINCT 'clause:' || source || ':' || lang AS src, 'disease:' || w AS dst, CASE WHEN lang IN ('fr') THEN 'excludes' ELSE 'covers' END AS type FROM documents, (VALUES ('thing'), ('leau'), ('keit'), ('mente')) t(w) WHERE contains(text, w)")
def k4_mentions(spark, d):
    names = spark.createDataFrame([("thing",), ("leau",), ("keit",), ("mente",)], "name string")
    return G.mentions(clauses(spark, d), names, excluding=("fr",))


@query(r"SELECT DISTINCT 'clause:' || source || ':' || lang AS src, 'waiting:' || (regexp_extract(w, '(\d+)', 1)::BIGINT) AS dst FROM (SELECT source, lang, unnest(regexp_extract_all(text, '[a-z]\.(\d{2})@', 0)) AS w FROM documents)")
def k5_waiting(spark, d):
    return G.waiting(clauses(spark, d), patterns=(r"[a-z]\.(\d{2})@",)).select("src", "dst")


@query(r"SELECT DISTINCT 'clause:' || source || ':' || lang AS src, 'deductible:' || (regexp_extract(w, '(\d+)', 1)::BIGINT) AS dst FROM (SELECT source, lang, unnest(list_concat(regexp_extract_all(text, 'mail(\d)', 0), regexp_extract_all(text, '\.(\d{2})@', 0))) AS w FROM documents)")
def k6_deductibles(spark, d):
    return G.deductibles(clauses(spark, d), patterns=(r"mail(\d)", r"\.(\d{2})@")).select("src", "dst")


@query("SELECT DISTINCT 'clause:' || source || ':' || lang AS src, 'event:' || w AS dst FROM documents, (VALUES ('ererth'), ('eauion')) t(w) WHERE contains(text, w)")
def k7_events(spark, d):
    names = spark.createDataFrame([("ererth",), ("eauion",)], "name string")
    return G.mentions(clauses(spark, d), names, "event", relation="involves").select("src", "dst")


@query("SELECT 'n' || n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'old' ELSE 'new' END AS category, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey::VARCHAR END AS extra FROM nation")
def k8_merge(spark, d):
    n = read_table(spark, d, "nation")
    old = n.where("n_nationkey % 2 = 0").select(*G.node(key("n", "n_nationkey"), "Nation", F.col("n_name"), category=F.lit("old")))
    new = n.withColumn("x", F.when(F.col("n_nationkey") % 3 == 0, F.col("n_regionkey"))).select(*G.node(key("n", "n_nationkey"), "Nation", F.col("n_name"), category=F.lit("new"), extra=F.col("x")))
    return G.merge_nodes(old, new).select("id", "name", F.try_element_at("attrs", F.lit("category")).alias("category"), F.try_element_at("attrs", F.lit("extra")).alias("extra"))


@query(f"WITH {N_SQL}, r AS (SELECT p_partkey AS request_id, CASE WHEN p_size % 2 = 0 THEN 'NATION_' || (p_size % 30) ELSE 'er#00000000' || (p_size % 10) END AS asked, CASE WHEN p_size % 3 = 0 THEN 'Supplier' END AS wanted FROM part), m AS (SELECT request_id, id, label, name, CASE WHEN asked = name THEN 0 ELSE 1 END AS how FROM r JOIN nodes ON contains(name, asked) AND (wanted IS NULL OR label = wanted)), o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY how, length(name), name, id) AS n FROM m) SELECT request_id, id, label FROM o WHERE n = 1")
def k9_entity(spark, d):
    s = F.col("p_size")
    asked = F.when(s % 2 == 0, F.concat(F.lit("NATION_"), s % 30)).otherwise(F.concat(F.lit("er#00000000"), s % 10))
    r = read_table(spark, d, "part").select(F.col("p_partkey").alias("request_id"), asked.alias("name"), F.when(s % 3 == 0, "Supplier").alias("label"))
    return G.find_entity(r, nodes(spark, d)).select("request_id", "id", "label")


def each_nation(spark, d):
    return read_table(spark, d, "nation").select(F.col("n_nationkey").alias("request_id"), key("n", "n_nationkey").alias("id"))


@query(f"WITH {E_SQL} SELECT n_nationkey AS request_id, type, dst AS other, 'out' AS way FROM nation JOIN edges ON src = 'n' || n_nationkey UNION ALL SELECT n_nationkey, type, src, 'in' FROM nation JOIN edges ON dst = 'n' || n_nationkey")
def k10_relations(spark, d):
    return G.relations(each_nation(spark, d), edges(spark, d))


@query(f"WITH RECURSIVE {E_SQL}, {U_SQL}, w(request_id, id, distance) AS (SELECT n_nationkey, 'n' || n_nationkey, 0 FROM nation UNION SELECT request_id, dst, distance + 1 FROM w JOIN u ON src = id WHERE distance < 3) SELECT request_id, id, min(distance) AS distance FROM w GROUP BY ALL HAVING min(distance) > 0")
def k11_neighbors(spark, d):
    return G.neighbors(each_nation(spark, d), edges(spark, d), 3)


@query(f"WITH RECURSIVE {E_SQL}, {U_SQL}, w(request_id, id, distance) AS (SELECT s_suppkey, 's' || s_suppkey, 0 FROM supplier WHERE s_suppkey % 10 = 0 UNION SELECT request_id, dst, distance + 1 FROM w JOIN u ON src = id WHERE distance < 6) SELECT request_id, id, min(distance) AS distance FROM w WHERE starts_with(id, 'n') GROUP BY ALL")
def k11_neighbors_by_label(spark, d):
    far = read_table(spark, d, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("request_id"), key("s", "s_suppkey").alias("id"))
    return G.neighbors(far, edges(spark, d), 6, nodes=nodes(spark, d), label="Nation")


@query(f"WITH RECURSIVE {E_SQL}, {U_SQL}, w(request_id, here, b, distance, path) AS (SELECT s_suppkey, 's' || s_suppkey, 'n' || (s_suppkey % 25), 0, ['s' || s_suppkey] FROM supplier UNION ALL SELECT request_id, dst, b, distance + 1, list_append(path, dst) FROM w JOIN u ON src = here WHERE distance < 4 AND here <> b AND NOT list_contains(path, dst) AND NOT starts_with(dst, 'c') AND NOT starts_with(dst, 's')), o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, path) AS n FROM w WHERE here = b) SELECT request_id, distance, array_to_string(path, '>') AS path FROM o WHERE n = 1")
def k12_shortest_path(spark, d):
    pairs = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("request_id"), key("s", "s_suppkey").alias("a"), F.concat(F.lit("n"), F.col("s_suppkey") % 25).alias("b"))
    return G.shortest_path(pairs, edges(spark, d)).select("request_id", "distance", F.array_join("path", ">").alias("path"))


@query(f"WITH {N_SQL}, {E_SQL} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY ALL")
def k13_stats(spark, d):
    return G.stats(nodes(spark, d), edges(spark, d))


def each_part(spark, d):
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("request_id"), key("p", "p_partkey").alias("disease"))


@query(f"WITH {P_SQL} SELECT DISTINCT p_partkey AS request_id, product FROM part JOIN pe ON disease = 'p' || p_partkey WHERE rel = 'covers'")
def k14_disease_products(spark, d):
    return G.disease_products(each_part(spark, d), part_edges(spark, d))


@query(f"WITH {P_SQL}, r AS (SELECT min(p_partkey) + 1000000 AS request_id, 'q' || min(p_partkey) AS disease, p_brand AS category FROM part GROUP BY p_brand, p_type) SELECT DISTINCT r.request_id, product, 'category' AS via FROM r JOIN pb USING (category) JOIN pe ON pe.disease = pb.disease WHERE rel = 'covers'")
def k15_category_products(spark, d):
    p = read_table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("p_partkey"))
    more = p.select(*G.edge(key("q", "p_partkey"), F.col("p_brand"), "belongs_to"))
    r = p.select((F.col("p_partkey") + 1000000).alias("request_id"), key("q", "p_partkey").alias("disease"))
    return G.category_products(r, part_edges(spark, d).unionByName(more))


@query(f"WITH {P_SQL} SELECT DISTINCT s_suppkey AS request_id, pe.disease, rel AS relation, category FROM supplier JOIN pe ON product = 's' || s_suppkey LEFT JOIN pb ON pb.disease = pe.disease")
def k16_product_diseases(spark, d):
    r = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("request_id"), key("s", "s_suppkey").alias("product"))
    return G.product_diseases(r, part_edges(spark, d)).select("request_id", "disease", "relation", "category")


def attr_edges(spark, d):
    li = read_table(spark, d, "lineitem")
    clause = F.concat(F.lit("p"), "l_partkey", F.lit(":"), "l_returnflag")
    return li.select(*G.edge(clause, F.concat(F.lit("waiting:"), F.col("l_quantity").cast("int")), "has_waiting")).distinct()


@query("SELECT DISTINCT s_suppkey AS request_id, b.l_quantity::INT::BIGINT AS value FROM supplier JOIN (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem) a ON a.l_suppkey = s_suppkey JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_returnflag = b.l_returnflag")
def k17_product_attributes(spark, d):
    r = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("request_id"), key("s", "s_suppkey").alias("product"))
    return G.product_attr(r, part_edges(spark, d).unionByName(attr_edges(spark, d)), "has_waiting").select("request_id", "value")


@query(f"WITH {P_SQL}, w AS (SELECT 's' || s_suppkey AS product, s_suppkey % 40 AS value FROM supplier WHERE s_suppkey % 4 <> 0), r AS (SELECT p_partkey AS request_id, 'p' || p_partkey AS disease, CASE WHEN p_size % 2 = 0 THEN 'n' || (p_size % 25) END AS insurer, CASE WHEN p_size % 3 = 0 THEN 20 END AS max_waiting FROM part) SELECT DISTINCT request_id, pe.product FROM r JOIN pe ON pe.disease = r.disease AND rel = 'covers' JOIN supplier ON pe.product = 's' || s_suppkey LEFT JOIN w ON w.product = pe.product WHERE (insurer IS NULL OR 'n' || s_nationkey = insurer) AND (max_waiting IS NULL OR value IS NULL OR value <= max_waiting)")
def k18_complex_query(spark, d):
    s = read_table(spark, d, "supplier")
    issues = s.select(*G.edge(key("n", "s_nationkey"), key("s", "s_suppkey"), "issues"))
    waits = s.where("s_suppkey % 4 <> 0").select(key("s", "s_suppkey").alias("product"), (F.col("s_suppkey") % 40).alias("value"))
    z = F.col("p_size")
    r = read_table(spark, d, "part").select(F.col("p_partkey").alias("request_id"), key("p", "p_partkey").alias("disease"), F.when(z % 2 == 0, F.concat(F.lit("n"), z % 25)).alias("insurer"), F.when(z % 3 == 0, 20).alias("max_waiting"))
    return G.complex_query(r, part_edges(spark, d).unionByName(issues), waits, belongs=None)


@query(f"""WITH {P_SQL}, pr AS (SELECT 's' || s_suppkey AS product, CASE WHEN s_suppkey % 3 <> 0 THEN 'n' || s_nationkey END AS issuer FROM supplier), w AS (SELECT 's' || s_suppkey AS product, s_suppkey % 40 AS value FROM supplier WHERE s_suppkey % 4 <> 0),
r AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 3 < 2 THEN 'p' || (1 + c_custkey % 150) END AS disease, CASE WHEN c_custkey % 3 = 2 OR c_custkey % 5 = 0 THEN 'n' || c_nationkey END AS insurer, CASE WHEN c_custkey % 7 < 3 THEN 20 END AS max_waiting FROM customer),
cov AS (SELECT * FROM pe WHERE rel = 'covers' AND substr(disease, 2)::INT % 3 <> 0),
own AS (SELECT DISTINCT request_id, product FROM r JOIN cov USING (disease)),
kin AS (SELECT DISTINCT r.request_id, product FROM r JOIN pb a ON a.disease = r.disease JOIN pb b USING (category) JOIN cov ON cov.disease = b.disease WHERE r.request_id NOT IN (SELECT request_id FROM own)),
f AS (SELECT * FROM own UNION ALL SELECT * FROM kin UNION ALL SELECT request_id, product FROM r, pr WHERE disease IS NULL)
SELECT DISTINCT request_id, product FROM f JOIN r USING (request_id) JOIN pr USING (product) LEFT JOIN w USING (product) WHERE (insurer IS NULL OR insurer = issuer) AND (max_waiting IS NULL OR value IS NULL OR value <= max_waiting)""")
def k18_complex_query_fallback(spark, d):
    """A third of the products has no insurer, a third of the diseases no product of its own, requests may name an insurer only."""
    s, c = read_table(spark, d, "supplier"), read_table(spark, d, "customer")
    issues = s.where("s_suppkey % 3 <> 0").select(*G.edge(key("n", "s_nationkey"), key("s", "s_suppkey"), "issues"))
    known = part_edges(spark, d).where((F.col("type") != "covers") | (F.substring("dst", 2, 20).cast("int") % 3 != 0))
    waits = s.where("s_suppkey % 4 <> 0").select(key("s", "s_suppkey").alias("product"), (F.col("s_suppkey") % 40).alias("value"))
    k = F.col("c_custkey")
    r = c.select(
        k.alias("request_id"), F.when(k % 3 < 2, F.concat(F.lit("p"), 1 + k % 150)).alias("disease"),
        F.when((k % 3 == 2) | (k % 5 == 0), key("n", "c_nationkey")).alias("insurer"), F.when(k % 7 < 3, 20).alias("max_waiting"),
    )
    return G.complex_query(r, known.unionByName(issues), waits)


@query(f"WITH {E_SQL}, g AS (SELECT id, count(*) AS deg FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1), c AS (SELECT s_nationkey AS mention_id, 's' || s_suppkey AS id, 'n' || (s_suppkey % 25) AS insurer, s_nationkey FROM supplier), x AS (SELECT mention_id, c.id, round(0.3 * least(coalesce(deg, 0) / 10.0, 1.0) + 0.5 * (insurer = 'n' || s_nationkey)::INT, 3) AS score FROM c LEFT JOIN g USING (id)) SELECT mention_id, id, score::DOUBLE AS score, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, id) AS rank FROM x")
def k19_disambiguate(spark, d):
    c = read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("mention_id"), key("s", "s_suppkey").alias("id"), F.concat(F.lit("n"), F.col("s_suppkey") % 25).alias("insurer"))
    return G.disambiguate(c, edges(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("WITH p AS (SELECT n_regionkey AS query_id, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey) SELECT query_id, string_agg('推理路径' || n || ': ' || n_name || '  --[in_region]--> ' || r_name || chr(10) || '  关联产品: ' || n_name, chr(10) ORDER BY n) AS context FROM p WHERE n <= 3 GROUP BY 1")
def k20_context(spark, d):
    n, r = read_table(spark, d, "nation"), read_table(spark, d, "region")
    step = lambda node, rel: F.struct(node.alias("node"), rel.alias("relation"))
    steps = F.array(step(F.col("n_name"), F.lit(None).cast("string")), step(F.col("r_name"), F.lit("in_region")))
    p = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_regionkey").alias("query_id"), F.col("n_nationkey").alias("pos"), steps.alias("steps"), F.array("n_name").alias("products"))
    return G.context(p)
