"""Queries of vectors, hybrid retrieval and ranking."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lineage import cut, scratch
from tessera.operators import index as X
from tessera.operators import retrieval as R
from tessera.registry import query
from tessera.sources.tables import read_table

STRICT = "insurer = 'ins1' AND clause_type = '3'"
C = "c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, cast(label AS varchar) AS clause_type, 'ins' || (vec_id % 5) AS insurer, 'prod' || (vec_id % 20) AS product_name, vec_id % 17 <> 0 AS is_valid, vec_id // 4 AS parent FROM embeddings), q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, vec_id % 5 AS qi FROM embeddings WHERE vec_id % 20 = 0)"


def best(name, k, where="true", v="v", qv="qv", cond="true"):
    return f"{name} AS (SELECT query_id, id, score, rank FROM (SELECT query_id, id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM (SELECT query_id, id, list_cosine_similarity({v}, {qv}) AS s FROM c, q WHERE {where} AND {cond})) WHERE rank <= {k})"


FUSED = "f AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen, id) AS rank FROM (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((l, rank)) AS seen FROM (SELECT 0 AS l, query_id, id, rank FROM a UNION ALL SELECT 1, query_id, id, rank FROM b) GROUP BY query_id, id))"
LIVE = f"WITH {C}, {best('a', 30, 'is_valid')}, {best('b', 30, 'is_valid', 'v[1:32]', 'qv[1:32]')}, {FUSED}"
HITS = f"{LIVE}, r AS (SELECT query_id, id, coalesce(a.score, 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(a.score, 0), 9) DESC, f.rank, id) AS rank FROM f LEFT JOIN a USING (query_id, id) WHERE f.rank <= 30), h AS (SELECT r.*, c.product_name, c.clause_type, c.insurer, c.parent, d.text FROM r JOIN c USING (id) LEFT JOIN documents d ON d.doc_id = c.parent WHERE rank <= 5)"


def chunks(spark, d):
    e = read_table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("string").alias("clause_type"), F.concat(F.lit("ins"), F.col("vec_id") % 5).alias("insurer"),
        F.concat(F.lit("prod"), F.col("vec_id") % 20).alias("product_name"), (F.col("vec_id") % 17 != 0).alias("is_valid"), F.lit("child").alias("chunk_type"), F.expr("vec_id div 4").alias("parent"), F.lit("x").alias("text"),
    )


def asked(spark, d):
    e = read_table(spark, d, "embeddings").where("vec_id % 20 = 0")
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def parents(spark, d):
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("parent"), F.col("text").alias("parent_text"))


def hits(spark, d):
    return R.retrieve(asked(spark, d), chunks(spark, d), parents(spark, d))


def shown(df):
    """Scores to six places, ranks as SQL counts them."""
    return df.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query(r"WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM documents), c AS (SELECT doc_id, t, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT doc_id, count(*) AS n_terms, sum(n)::BIGINT AS n_words, md5(string_agg(t || ':' || n, ',' ORDER BY t || ':' || n)) AS counts_md5 FROM c GROUP BY 1) SELECT d.doc_id, coalesce(n_terms, 0) AS n_terms, coalesce(n_words, 0) AS n_words, coalesce(counts_md5, md5('')) AS counts_md5, CASE WHEN n_words > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS dense_sum FROM documents d LEFT JOIN s USING (doc_id)")
def v1_encode(spark, d):
    x = R.encode(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id").withColumn("n_words", F.size(R.words(F.col("text"))).cast("long"))
    counted = F.sort_array(F.transform(F.map_entries("sparse"), lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"] * F.col("n_words")).cast("long"))))
    return x.select("doc_id", F.size("sparse").cast("long").alias("n_terms"), "n_words", F.md5(F.array_join(counted, ",")).alias("counts_md5"), F.round(F.aggregate("dense", F.lit(0.0), lambda a, v: a + v), 6).alias("dense_sum"))


@query("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS unit, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 7)) AS e FROM embeddings))")
def v2_l2_normalize(spark, d):
    x = read_table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double") * (1 + F.col("vec_id") % 7)).alias("e"))
    x = x.select("vec_id", R.l2_normalize(F.col("e")).alias("v"))
    return x.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e), 6).alias("unit"), F.round(F.col("v")[0], 6).alias("first"))


@query("WITH k AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t, md5(t) AS key FROM documents), h AS (SELECT doc_id, t, key IN (SELECT key FROM k WHERE doc_id % 3 = 0) AS hit FROM k) SELECT doc_id, hit, CASE WHEN hit THEN -1.0 ELSE length(t) END::DOUBLE AS dense FROM h")
def v3_encode_with_cache(spark, d):
    x = read_table(spark, d, "documents").select("doc_id", "text")
    cache = x.where("doc_id % 3 = 0").select(R.text_key(F.col("text")).alias("key"), F.array(F.lit(-1.0)).alias("dense")).dropDuplicates(["key"])
    plain = lambda df, key, text: df.withColumn("dense", F.array(F.length(T.strip(F.col(text))).cast("double")))
    return R.encode_with_cache(x, cache, encoder=plain).select("doc_id", "hit", F.col("dense")[0].alias("dense"))


@query(f"WITH {C} SELECT id, product_name, clause_type FROM c WHERE is_valid AND starts_with(product_name, 'prod1') AND clause_type IN ('1', '2', '3') AND insurer = 'ins1'")
def v4_scalar_filter(spark, d):
    return chunks(spark, d).where(R.scalar_filter({"product_name": "prod1", "clause_type": ["1", "2", "3"], "insurer": "ins1"})).select("id", "product_name", "clause_type")


@query(f"WITH {C}, {best('a', 10, 'is_valid')} SELECT query_id, id, rank, round(score, 6) AS score FROM a")
def v5_dense_topk(spark, d):
    return shown(R.dense_topk(asked(spark, d), chunks(spark, d).where(R.scalar_filter()), 10))


@query()
def v6_ivf_topk(spark, d):
    live = chunks(spark, d).where(R.scalar_filter())
    return shown(R.ivf_topk(asked(spark, d), R.ivf_index(live, 16), 10, 8))


def stored(spark, d):
    """Half the chunks fit the cells, the other half comes later into the same cells."""
    path, c = scratch(spark, "ivf"), chunks(spark, d)
    X.write_ivf(c.where("id % 2 = 0"), path, 16)
    X.add_to_ivf(c.where("id % 2 = 1"), path, "second")
    return X.read_ivf(spark, path)


@query(f"WITH {C}, {best('a', 10, 'is_valid')} SELECT query_id, id, rank, round(score, 6) AS score FROM a")
def v6_ivf_stored(spark, d):
    """With every cell probed the stored index answers as exact search does."""
    return shown(X.ivf_search(stored(spark, d), nprobe=16)(asked(spark, d), None, 10))


WORDS = r"unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term"
SPARSE = f"p AS (SELECT id, term, count(*)::DOUBLE AS w FROM (SELECT doc_id AS id, {WORDS} FROM documents) GROUP BY ALL), qt AS (SELECT query_id, term, count(*)::DOUBLE AS w FROM (SELECT item_id AS query_id, {WORDS} FROM benchmark) GROUP BY ALL), s AS (SELECT query_id, id, score, rank FROM (SELECT query_id, id, sum(p.w * qt.w) AS score, row_number() OVER (PARTITION BY query_id ORDER BY sum(p.w * qt.w) DESC, id) AS rank FROM p JOIN qt USING (term) GROUP BY query_id, id) WHERE rank <= 30)"


def sparse(spark, d):
    q = R.postings(read_table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id")
    return R.sparse_search(q, read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 30)


@query(f"WITH {SPARSE} SELECT * FROM s")
def v7_sparse_topk(spark, d):
    return sparse(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {SPARSE} SELECT * FROM s")
def v7_block_max(spark, d):
    """The same lists out of stored blocks of postings, of which only those are read that can matter."""
    path = scratch(spark, "postings")
    X.write_postings(read_table(spark, d, "documents").withColumnRenamed("doc_id", "id"), path)
    q = R.postings(read_table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id")
    return X.blockmax_topk(q, X.read_postings(spark, path), 30).withColumn("rank", F.col("rank").cast("long"))


@query(f"{LIVE} SELECT query_id, id, rank, round(score, 6) AS score FROM f")
def v8_rank_fusion(spark, d):
    live = chunks(spark, d).where(R.scalar_filter())
    q = asked(spark, d)
    return shown(R.rrf([R.dense_topk(q, live, 30), R.dense_topk(q, live, 30, (1, 32))]))


@query(f"WITH {C}, {best('a', 5)} SELECT query_id, id, md5(d.text) AS parent_md5 FROM a JOIN c USING (id) LEFT JOIN documents d ON d.doc_id = c.parent AND d.doc_id % 3 <> 0")
def v9_parent_lookup(spark, d):
    found = R.dense_topk(asked(spark, d), chunks(spark, d), 5).join(chunks(spark, d).select("id", "parent"), "id")
    return R.with_parent(found, parents(spark, d).where("parent % 3 <> 0")).select("query_id", "id", F.md5("parent_text").alias("parent_md5"))


JACCARD = r"len(list_intersect(qw, dw)) / greatest(len(list_distinct(list_concat(qw, dw))), 1)"
RERANKED = rf"WITH {SPARSE}, w AS (SELECT query_id, id, rank, list_distinct(list_filter(string_split_regex(lower(b.text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS qw, list_distinct(list_filter(string_split_regex(lower(d.text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS dw FROM s JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = query_id), r AS (SELECT query_id, id, {JACCARD} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round({JACCARD}, 9) DESC, rank, id) AS rank FROM w)"


def reranked(spark, d, threshold=None):
    split = F.array_distinct(R.words(F.col("text")))
    found = cut(sparse(spark, d))  # thirty rows a query; only their texts are split, each once
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").join(R.small(found.select("id").distinct()), "id", "left_semi")
    found = found.join(docs.select("id", "text", split.alias("dw")), "id")
    found = found.join(read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), split.alias("qw")), "query_id")
    return shown(R.rerank(found, R.overlap_of(F.col("qw"), F.col("dw")), 5, threshold)).select("query_id", "id", "rank", "score")


@query(f"{RERANKED} SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 5")
def v10_rerank(spark, d):
    return reranked(spark, d)


@query(f"{RERANKED} SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 5 AND score >= 0.02")
def v11_rerank_threshold(spark, d):
    return reranked(spark, d, 0.02)


@query(f"""WITH {C}, {best('a', 10, 'is_valid', cond="c.id % 5 = q.qi")}, g AS (SELECT query_id, max(score) AS top1, round(avg(score) FILTER (rank <= 5), 4) AS avg5, count(*) FILTER (score > 0.3) AS n FROM a GROUP BY 1),
t AS (SELECT q.query_id, top1, avg5, n, CASE query_id % 3 WHEN 0 THEN 0.4 WHEN 1 THEN 0.3 ELSE 0.35 END AS t1, CASE query_id % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.2 ELSE 0.25 END AS t5 FROM q LEFT JOIN g USING (query_id)),
r AS (SELECT query_id, CASE WHEN top1 IS NULL THEN 'no_results' WHEN top1 < t1 THEN 'low_top1' WHEN avg5 < t5 THEN 'low_avg5' WHEN n < 2 THEN 'few_good' ELSE '' END AS reason FROM t) SELECT query_id, reason = '' AS passed, reason FROM r""")
def v12_quality_gate(spark, d):
    q = asked(spark, d)
    live = chunks(spark, d).where(R.scalar_filter())
    own = q.select("query_id", "qv", F.concat(F.lit("ins"), F.col("query_id") % 5).alias("product_name"))
    found = R.retrieve_compare(own, live.drop("product_name").withColumnRenamed("insurer", "product_name"), 10)
    intents = q.select("query_id", (F.col("query_id") % 3).cast("string").alias("intent"))
    return R.quality_gate(intents, found, {"0": (0.4, 0.3), "1": (0.3, 0.2)}, (0.35, 0.25), good=0.3)


@query(f"{HITS} SELECT query_id, id, product_name, clause_type FROM (SELECT *, row_number() OVER (PARTITION BY query_id, product_name, clause_type ORDER BY rank) AS n FROM h) WHERE n = 1")
def v13_sources(spark, d):
    return R.dedup_sources(hits(spark, d)).select("query_id", "id", "product_name", "clause_type")


@query(f"{HITS} SELECT q.query_id, md5(coalesce(string_agg('[条款' || rank || ': ' || product_name || ' - ' || clause_type || ']' || chr(10) || coalesce(text, 'x'), chr(10) || chr(10) ORDER BY rank), '暂无相关条款')) AS context_md5 FROM q LEFT JOIN h USING (query_id) GROUP BY q.query_id")
def v14_context(spark, d):
    return R.build_context(asked(spark, d), hits(spark, d)).select("query_id", F.md5("context").alias("context_md5"))


@query(f"{HITS} SELECT query_id, id, rank, round(score, 6) AS score, product_name, clause_type, md5(text) AS parent_md5 FROM h")
def v15_retrieve(spark, d):
    return shown(hits(spark, d)).select("query_id", "id", "rank", "score", "product_name", "clause_type", F.md5("parent_text").alias("parent_md5"))


@query(f"{HITS} SELECT query_id, id, rank, round(score, 6) AS score, product_name, clause_type, md5(text) AS parent_md5 FROM h")
def v15_stored_retrieve(spark, d):
    """The chain over the stored index; all cells probed, so that exact SQL is its twin."""
    found = R.retrieve(asked(spark, d), chunks(spark, d), parents(spark, d), first=X.ivf_search(stored(spark, d), nprobe=16))
    return shown(found).select("query_id", "id", "rank", "score", "product_name", "clause_type", F.md5("parent_text").alias("parent_md5"))


CHUNK_TEXT = "t AS (SELECT vec_id AS id, coalesce(substr(text, 1 + (vec_id % 4) * 200, 200), '') AS text FROM embeddings LEFT JOIN documents ON doc_id = vec_id // 4)"
HYBRID = rf"""WITH {C}, {CHUNK_TEXT}, w AS (SELECT id, unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS term FROM t), p AS (SELECT id, term, count(*)::DOUBLE AS w FROM w GROUP BY ALL), {best('a', 30, 'is_valid')},
b AS (SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (SELECT q.query_id, p.id, sum(p.w * o.w) AS s FROM q JOIN p o ON o.id = q.query_id JOIN p ON p.term = o.term JOIN c ON c.id = p.id AND c.is_valid GROUP BY ALL)) WHERE rank <= 30), {FUSED},
r AS (SELECT query_id, id, coalesce(a.score, 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(a.score, 0), 9) DESC, f.rank, id) AS rank FROM f LEFT JOIN a USING (query_id, id) JOIN t USING (id) WHERE f.rank <= 30)"""


@query(f"{HYBRID} SELECT query_id, id, rank, round(r.score, 6) AS score, md5(d.text) AS parent_md5 FROM r JOIN c USING (id) LEFT JOIN documents d ON d.doc_id = c.parent WHERE rank <= 5")
def v15_hybrid_retrieve(spark, d):
    """Dense and sparse lists over chunks that carry stretches of their documents' texts."""
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("parent"), F.substring("text", 1, 800).alias("whole"))  # as far as the stretches go
    said = F.coalesce(F.substring("whole", F.lit(1) + (F.col("id") % 4).cast("int") * 200, F.lit(200)), F.lit(""))
    c = cut(chunks(spark, d).join(docs, "parent", "left").withColumn("text", said).drop("whole"))  # read by both lists, the queries and the hits
    q = c.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv"), F.col("text").alias("query"))
    hits = R.retrieve(q, c, parents(spark, d), second=R.sparse_list)
    return shown(hits).select("query_id", "id", "rank", "score", F.md5("parent_text").alias("parent_md5"))


MASKED = "list_transform(qv, lambda x, i: CASE WHEN i <= 32 THEN x ELSE 0 END)"


@query(f"WITH {C}, {best('a', 30, 'is_valid')}, {best('b', 30, 'is_valid', 'v', MASKED)}, {FUSED} SELECT query_id, id, rank, round(score, 6) AS score FROM f WHERE rank <= 10")
def v16_subqueries(spark, d):
    q = asked(spark, d)
    masked = F.transform("qv", lambda x, i: F.when(i < 32, x).otherwise(F.lit(0.0).cast("float")))
    sub = q.select("query_id", F.lit(0).alias("sub"), "qv").unionByName(q.select("query_id", F.lit(1).alias("sub"), masked.alias("qv")))
    return shown(R.retrieve_subqueries(sub, chunks(spark, d).where(R.scalar_filter()), 10))


@query(f"WITH {C}, {best('a', 10, 'is_valid')}, w AS (SELECT query_id, p FROM q, (VALUES ('prod1'), ('prod2'), ('prod3')) t(p)), r AS (SELECT query_id, product_name, id, list_cosine_similarity(v, qv) AS s FROM w JOIN q USING (query_id) JOIN c ON c.product_name = p WHERE is_valid) SELECT query_id, product_name, id, rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, product_name ORDER BY round(s, 9) DESC, id) AS rank FROM r) WHERE rank <= 3")
def v17_compare(spark, d):
    q = asked(spark, d).withColumn("product_name", F.explode(F.array(*[F.lit(f"prod{i}") for i in (1, 2, 3)])))
    return shown(R.retrieve_compare(q, chunks(spark, d).where(R.scalar_filter())))


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE starts_with(p_name, 'red') AND p_type IN ('PROMO', 'SMALL') AND p_size <= 25")
def v18_conditional(spark, d):
    p = read_table(spark, d, "part").select("*", F.col("p_name").alias("product_name"), (F.col("p_size") <= 25).alias("is_valid"), F.lit("child").alias("chunk_type"))
    return p.where(R.scalar_filter({"product_name": "red", "p_type": ["PROMO", "SMALL"]})).select("p_partkey", "p_name", "p_retailprice")


@query(f"WITH {C}, s AS (SELECT * FROM c WHERE is_valid AND insurer = 'ins1' AND clause_type = '3'), {best('a', 10, 'is_valid', cond=STRICT)}, {best('b', 10, 'is_valid')}, n AS (SELECT query_id FROM a GROUP BY 1 HAVING count(*) >= 10), u AS (SELECT query_id, id, 0 AS relaxed, rank FROM a UNION ALL SELECT query_id, id, 1, rank FROM b WHERE query_id NOT IN (SELECT query_id FROM n)), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY relaxed) AS nth FROM u), r AS (SELECT query_id, id, relaxed, row_number() OVER (PARTITION BY query_id ORDER BY relaxed, rank) AS rank FROM o WHERE nth = 1) SELECT * FROM r WHERE rank <= 10")
def v19_fallback(spark, d):
    live = chunks(spark, d).where(R.scalar_filter())
    strict = live.where(R.scalar_filter({"insurer": "ins1", "clause_type": "3"}))
    return R.retrieve_fallback(asked(spark, d), strict, live, 10, 10).select("query_id", "id", "relaxed", F.col("rank").cast("long").alias("rank"))


@query(f"{HITS} SELECT query_id, id, md5(CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END) AS shown_md5 FROM h")
def v20_clause_search(spark, d):
    return hits(spark, d).select("query_id", "id", F.md5(R.display_text(F.col("parent_text"))).alias("shown_md5"))
