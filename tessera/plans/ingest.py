"""Queries of sources, sinks and ingestion."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lineage import scratch
from tessera.operators import ingest as I
from tessera.registry import query
from tessera.sources import tables as S
from tessera.sources.folders import read_folder
from tessera.sources.relational import conform
from tessera.sources.store import Store, append_chunks, delete, invalidate, upsert

DELIMS = ".!?;\n"
PATTERNS = ("[A-Z][a-z]+\\.$", "[A-Z][a-z]+ [a-z]+\\.$")
DOCS_SQL = "docs AS (SELECT doc_id, text, lang AS insurer, source AS product_code, cast(doc_id % 3 AS varchar) AS version, md5(text) AS file_md5 FROM documents)"


STRIP = "' ' || chr(9) || chr(10) || chr(13)"


def sentences_sql(text, delims=".!?;"):
    return f"list_filter(list_transform(regexp_extract_all({text}, '[^{delims}\\n]*[{delims}\\n]|[^{delims}\\n]+$'), lambda x: trim(x, {STRIP})), lambda x: x <> '')"


def packed_sql(parts, size, overlap):
    """The fold of chunk packing: a struct holds what is done, the buffer, and the buffer's length."""
    held = "coalesce(list_sum(list_transform(a.buf[i:], lambda y: length(y))), 0)"
    start, one = "{'done': []::VARCHAR[], 'buf': []::VARCHAR[], 'held': 0::BIGINT}", "{'done': []::VARCHAR[], 'buf': [x], 'held': length(x)}"
    flushed = f"{{'done': list_append(a.done, array_to_string(a.buf, '')), 'buf': list_append(a.buf[i:], x.buf[1]), 'held': ({held} + x.held)::BIGINT}}"
    step = f"CASE WHEN a.held + x.held > {size} AND len(a.buf) > 0 THEN list_transform([list_filter(range(1, len(a.buf) + 2), lambda i: {held} <= {overlap})[1]], lambda i: {flushed})[1] ELSE {{'done': a.done, 'buf': list_append(a.buf, x.buf[1]), 'held': a.held + x.held}} END"
    folded = f"list_reduce(list_prepend({start}, list_transform({parts}, lambda x: {one})), lambda a, x: {step})"
    return f"list_transform([{folded}], lambda r: CASE WHEN len(r.buf) > 0 THEN list_append(r.done, array_to_string(r.buf, '')) ELSE r.done END)[1]"


KIDS_SQL = f"k AS (SELECT doc_id, {packed_sql(sentences_sql('text'), 512, 64)} AS kids FROM documents), kid AS (SELECT doc_id, kids, unnest(kids) AS text, generate_subscripts(kids, 1) - 1 AS idx FROM k)"
PARENT_SQL = f"{KIDS_SQL}, par AS (SELECT doc_id, idx // 4 AS parent, string_agg(text, '' ORDER BY idx) AS text FROM kid GROUP BY ALL)"
LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {STRIP})), lambda x: x <> '')"
OPENS = "regexp_matches(x.title, '^(?:[A-Z][a-z]+[.]$|[A-Z][a-z]+ [a-z]+[.]$)') AND len(a.body) > 3"
SECTION_SQL = f"""l AS (SELECT doc_id, list_reduce(list_prepend({{'done': []::STRUCT(title VARCHAR, body VARCHAR[])[], 'title': '前言', 'body': []::VARCHAR[]}}, list_transform({LINES}, lambda x: {{'done': []::STRUCT(title VARCHAR, body VARCHAR[])[], 'title': x, 'body': []::VARCHAR[]}})),
lambda a, x: CASE WHEN {OPENS} THEN {{'done': list_append(a.done, {{'title': a.title, 'body': a.body}}), 'title': x.title, 'body': []::VARCHAR[]}} ELSE {{'done': a.done, 'title': a.title, 'body': list_append(a.body, x.title)}} END) AS r FROM documents),
lf AS (SELECT doc_id, CASE WHEN len(r.body) > 0 THEN list_append(r.done, {{'title': r.title, 'body': r.body}}) ELSE r.done END AS f FROM l),
lu AS (SELECT doc_id, unnest(f) AS s, generate_subscripts(f, 1) AS k FROM lf),
lg AS (SELECT doc_id, s.title AS title, min(k) AS k, array_to_string(arg_max(s.body, k), chr(10)) AS body FROM lu GROUP BY ALL),
sec AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS pos, title, body FROM lg)"""


def docs(spark, d):
    t = S.read_table(spark, d, "documents")
    return t.select("doc_id", "text", F.col("lang").alias("insurer"), F.col("source").alias("product_code"), (F.col("doc_id") % 3).cast("string").alias("version"), F.md5("text").alias("file_md5"))


def pages_of_doc(spark, d):
    return S.read_table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"), "text")


@query("SELECT doc_id, lang AS insurer, source AS product_name, md5(text) AS file_md5, '1.0' AS version, n_chars FROM documents WHERE text IS NOT NULL")
def s1_document_source(spark, d):
    t = S.read_table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.col("lang").alias("insurer"), F.col("source").alias("product_name"), F.md5("text").alias("file_md5"), F.lit("1.0").alias("version"), "n_chars")


@query("SELECT 'item_' || item_id AS file_name, md5(text || chr(10)) AS content_md5, CASE WHEN contains('item_' || item_id, '_1') THEN 'one' WHEN contains('item_' || item_id, '_2') THEN 'two' ELSE 'other' END AS doc_type, 'ins' || (item_id % 5) AS insurer FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)")
def s1_document_files(spark, d):
    """The benchmark's items as files of their own, read as documents with a table of metadata."""
    base = scratch(spark, "files")
    items = S.read_table(spark, d, "benchmark").groupBy("item_id").agg(F.min("text").alias("text")).withColumn("file_name", F.concat(F.lit("item_"), "item_id"))
    items.select(F.col("file_name").alias("name"), "text").repartition("name").write.partitionBy("name").text(base)
    meta = items.select("file_name", F.concat(F.lit("ins"), F.col("item_id") % 5).alias("insurer"))
    files = S.read_files(spark, base, meta, "name=([^/]+)/", (("_1", "one"), ("_2", "two")), "other")
    return files.select("file_name", F.md5("file_content").alias("content_md5"), "doc_type", "insurer")


@query("SELECT 'insurer=ins' || (item_id % 5) AS insurer, 'product=p' || (item_id % 3) AS product, md5(regexp_replace(text, '[\\r\\n]', ' ', 'g')) AS line_md5, count(*) AS n FROM benchmark WHERE item_id % 5 IN (1, 4) AND item_id % 3 = 2 GROUP BY ALL")
def s1_document_folder(spark, d):
    """The benchmark's items in folders by insurer and product, of which two insurers and a product are listed and read."""
    base = scratch(spark, "folders")
    items = S.read_table(spark, d, "benchmark").select(F.regexp_replace("text", r"[\r\n]", " ").alias("text"), F.concat(F.lit("ins"), F.col("item_id") % 5).alias("insurer"), F.concat(F.lit("p"), F.col("item_id") % 3).alias("product"))
    items.write.partitionBy("insurer", "product").text(base)
    some = read_folder(spark, base).where(F.col("insurer").isin("insurer=ins1", "insurer=ins4") & (F.col("product") == "product=p2"))
    lines = some.select("insurer", "product", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("insurer", "product", F.md5("line").alias("line_md5")).agg(F.count("*").alias("n"))


@query("SELECT md5(text) AS text_md5, toxic::VARCHAR AS label FROM labels JOIN documents USING (doc_id)")
def s6_labelled_file(spark, d):
    """Labelled texts as JSON array files, read back as rows."""
    base = scratch(spark, "labelled")
    x = S.read_table(spark, d, "labels").join(S.read_table(spark, d, "documents"), "doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(50)).alias("part"), F.struct("text", F.col("toxic").cast("string").alias("label")).alias("row"))
    x.groupBy("part").agg(F.to_json(F.collect_list("row")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(base)
    return S.read_labelled(spark, base).select(F.md5("text").alias("text_md5"), "label")


URL_TYPES = (("/en/", "english"), ("page=", "paged"), ("https", "secure"))


@query("SELECT page_id, CASE WHEN contains(url,'/en/') THEN 'english' WHEN contains(url,'page=') THEN 'paged' WHEN contains(url,'https') THEN 'secure' ELSE 'other' END AS doc_type FROM pages")
def s2_doc_type(spark, d):
    return S.read_table(spark, d, "pages").select("page_id", I.infer_doc_type(F.col("url"), URL_TYPES, "other").alias("doc_type"))


@query(f"""WITH {DOCS_SQL}, r AS (SELECT doc_id, version, text AS raw_text FROM docs WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, '9' AS version, text AS raw_text FROM docs WHERE doc_id % 2 = 0)
SELECT coalesce(r.doc_id, n.doc_id) AS doc_id, coalesce(n.version, r.version) AS version, md5(CASE WHEN r.doc_id IS NOT NULL THEN r.raw_text ELSE substr(n.raw_text, 1, 10000) END) AS text_md5 FROM r FULL JOIN n ON r.doc_id = n.doc_id""")
def s3_registry_upsert(spark, d):
    x = docs(spark, d).select("doc_id", "version", F.col("text").alias("raw_text"))
    old, new = x.where("doc_id % 3 <> 0"), x.where("doc_id % 2 = 0").withColumn("version", F.lit("9"))
    return I.upsert_registry(old, new).select("doc_id", "version", F.md5("raw_text").alias("text_md5"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END, '') AS insurer, '' AS parent_id, 'child' AS chunk_type, true AS is_valid, '1.0' AS version FROM documents")
def s4_chunk_defaults(spark, d):
    x = S.read_table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("insurer"))
    return I.chunk_defaults(x).select("doc_id", "insurer", "parent_id", "chunk_type", "is_valid", "version")


@query(f"""WITH {DOCS_SQL}, r AS (SELECT doc_id, version, text AS raw_text FROM docs WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, '9' AS version, text AS raw_text FROM docs WHERE doc_id % 2 = 0)
SELECT coalesce(r.doc_id, n.doc_id) AS doc_id, coalesce(n.version, r.version) AS version, md5(CASE WHEN r.doc_id IS NOT NULL THEN r.raw_text ELSE substr(n.raw_text, 1, 10000) END) AS text_md5 FROM r FULL JOIN n ON r.doc_id = n.doc_id""")
def s3_registry_store(spark, d):
    """The registry as a table of versions: a first batch, then an upsert that is sent twice."""
    store = Store(spark, scratch(spark, "registry"))
    x = docs(spark, d).select("doc_id", "version", F.col("text").alias("raw_text"))
    append_chunks(store, x.where("doc_id % 3 <> 0"), "first")
    for _ in range(2):
        upsert(store, x.where("doc_id % 2 = 0").withColumn("version", F.lit("9")), "second")
    return store.read().select("doc_id", "version", F.md5("raw_text").alias("text_md5"))


@query("SELECT cast(user_id AS varchar) AS session_id, event_type AS reason, 'pending' AS status, props AS summary, ts AS created_at FROM events WHERE event_type = 'error'")
def s7_ticket_store(spark, d):
    """Tickets by day, each day's batch sent twice."""
    store = Store(spark, scratch(spark, "tickets"))
    e = S.read_table(spark, d, "events").where("event_type = 'error'").withColumn("half", F.col("event_id") % 2)
    x = S.handoff_rows(e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("reason"), F.col("props").alias("summary"), "ts", "half").withColumn("reason", F.concat_ws("|", "reason", "half")), F.col("ts"))
    for half in ("0", "1", "0", "1"):
        append_chunks(store, x.where(F.col("reason").endswith(f"|{half}")), half)
    return store.read().withColumns({"reason": F.split("reason", r"\|")[0], "created_at": F.col("created_at").cast("timestamp_ntz")})


@query("""SELECT s_name AS insurer, p_name AS product_name, count(*) AS n, round(sum(l_extendedprice), 2) AS premium FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def s5_table_scan(spark, d):
    li, p, s = (S.read_table(spark, d, t) for t in ("lineitem", "part", "supplier"))
    x = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    return x.groupBy(F.col("s_name").alias("insurer"), F.col("p_name").alias("product_name")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("premium"))


RATES_SQL = "r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'no' || o_orderkey ELSE o_orderkey::VARCHAR END AS id, CASE WHEN o_custkey % 11 <> 0 THEN o_orderpriority END AS product_name, (o_orderkey % 60)::VARCHAR AS min_age, CASE WHEN o_orderkey % 5 = 0 THEN 'old' ELSE '90' END AS max_age, (o_custkey * 25) || '.5' AS premium_yearly FROM orders)"


@query(f"WITH {RATES_SQL} SELECT o_orderkey::INT AS id, product_name, min_age::INT AS min_age, max_age::INT AS max_age, premium_yearly::DECIMAL(10, 2)::DOUBLE AS premium, NULL::VARCHAR AS reason FROM r WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND product_name IS NOT NULL UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, CASE WHEN o_orderkey % 7 = 0 THEN 'id: not a int' WHEN product_name IS NULL THEN 'product_name: missing' ELSE 'max_age: not a int' END FROM r WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR product_name IS NULL")
def s5_typed_rows(spark, d):
    """Rates that arrive as text: typed rows, and those that do not fit with the reason."""
    o, k = S.read_table(spark, d, "orders"), F.col("o_orderkey")
    x = o.select(
        F.when(k % 7 == 0, F.concat(F.lit("no"), k)).otherwise(k.cast("string")).alias("ID"), F.when(F.col("o_custkey") % 11 != 0, F.col("o_orderpriority")).alias("product_name"), (k % 60).cast("string").alias("min_age"),
        F.when(k % 5 == 0, "old").otherwise("90").alias("max_age"), F.concat(F.col("o_custkey") * 25, F.lit(".5")).alias("premium_yearly"),
    )
    good, bad = conform(x, "rate_table")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("id", "int"), ("product_name", "string"), ("min_age", "int"), ("max_age", "int"), ("premium", "double"))]
    return good.select("id", "product_name", "min_age", "max_age", F.col("premium_yearly").cast("double").alias("premium"), F.lit(None).cast("string").alias("reason")).unionByName(bad.select(*none, "reason"))


@query("SELECT doc_id, cast(toxic AS varchar) AS label FROM labels")
def s6_labelled_rows(spark, d):
    x = S.read_table(spark, d, "labels").select("doc_id", F.to_json(F.struct(F.lit("t").alias("text"), F.col("toxic").cast("string").alias("label"))).alias("j"))
    return x.select("doc_id", F.from_json("j", "text string, label string")["label"].alias("label"))


@query("SELECT cast(user_id AS varchar) AS session_id, event_type AS reason, 'pending' AS status, props AS summary, ts AS created_at FROM events WHERE event_type = 'error'")
def s7_handoff_tickets(spark, d):
    e = S.read_table(spark, d, "events").where("event_type = 'error'")
    x = e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("reason"), F.col("props").alias("summary"), "ts")
    return S.handoff_rows(x, F.col("ts")).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query(r"""WITH q AS (SELECT conv_id, turn, 'result:' || role || ':' || md5(lower(regexp_replace(text, '[^a-zA-Z]', '', 'g'))) AS key, text, conv_id % 4 AS complexity, turn % 5 = 0 AS hit FROM conversations)
SELECT key, arg_max(text, (turn * 1000000 + conv_id, text)) AS answer, max(turn * 1000000 + conv_id) AS written_at FROM q WHERE complexity >= 2 AND length(text) > 0 AND NOT hit GROUP BY key""")
def s8_result_cache_sink(spark, d):
    c = S.read_table(spark, d, "conversations")
    key = F.concat(F.lit("result:"), "role", F.lit(":"), F.md5(T.normalize(F.col("text"), "[^a-zA-Z]")))
    x = c.select(key.alias("key"), F.col("text").alias("answer"), F.col("role").alias("intent"), (F.col("conv_id") % 4).alias("complexity"), (F.col("turn") % 5 == 0).alias("cache_hit"), (F.col("turn") * 1000000 + F.col("conv_id")).alias("written_at"))
    return S.result_cache_rows(x).select("key", F.from_json("value", "answer string, intent string")["answer"].alias("answer"), "written_at")


@query("SELECT doc_id, md5(text) AS file_md5 FROM documents")
def i1_content_md5(spark, d):
    return I.with_md5(S.read_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "file_md5")


@query(f"WITH {DOCS_SQL} SELECT min(doc_id) AS doc_id, file_md5 FROM docs WHERE file_md5 NOT IN (SELECT file_md5 FROM docs WHERE doc_id % 7 = 0) GROUP BY file_md5")
def i2_duplicate_skip(spark, d):
    x = docs(spark, d).select("doc_id", "file_md5")
    return I.dedup_documents(x, x.where("doc_id % 7 = 0")).select("doc_id", "file_md5")


@query("SELECT doc_id, source || '_' || substr(md5(text), 1, 8) AS document_id, length(text) < 100 AS is_short FROM documents")
def i3_i4_document_id_and_short_flag(spark, d):
    x = docs(spark, d)
    return x.select("doc_id", I.document_id(F.col("product_code"), F.col("file_md5")).alias("document_id"), (F.length("text") < 100).alias("is_short"))


@query("SELECT conv_id AS doc, md5(string_agg(chr(10) || '--- 第' || (turn + 1) || '页 ---' || chr(10) || text, '' ORDER BY turn)) AS raw_md5 FROM conversations WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0 GROUP BY conv_id")
def i5_page_assembly(spark, d):
    return I.assemble_pages(pages_of_doc(spark, d)).select("doc", F.md5("raw_text").alias("raw_md5"))


@query("SELECT conv_id AS doc, count(*) AS page_count, round(coalesce(avg(CASE WHEN turn < 3 THEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) END), 0), 6) AS avg_chars, coalesce(avg(CASE WHEN turn < 3 THEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) END), 0) < 100 AS needs_ocr FROM conversations GROUP BY conv_id")
def i6_ocr_triage(spark, d):
    return I.ocr_triage(pages_of_doc(spark, d)).withColumn("avg_chars", F.round("avg_chars", 6))


@query(f"WITH {SECTION_SQL} SELECT doc_id, pos, title, md5(body) AS body_md5, length(body) AS n_chars FROM sec")
def i7_sections(spark, d):
    x = docs(spark, d).select("doc_id", F.explode(T.sections(F.col("text"), PATTERNS)).alias("s"))
    return x.select("doc_id", "s.pos", "s.title", F.md5("s.body").alias("body_md5"), F.length("s.body").alias("n_chars"))


@query(r"""SELECT doc_id, nullif(trim(regexp_extract(text, '([a-zA-Z]+) = "', 1)), '') AS key_name, nullif(regexp_extract(text, '([a-z0-9.]+@[a-z0-9.]+)', 1), '') AS mail FROM documents""")
def i8_product_fields(spark, d):
    f = I.extract_fields(F.col("text"), {"key": r'([a-zA-Z]+) = "', "mail": r"([a-z0-9.]+@[a-z0-9.]+)"})
    return docs(spark, d).select("doc_id", f.alias("f")).select("doc_id", F.try_element_at("f", F.lit("key")).alias("key_name"), F.try_element_at("f", F.lit("mail")).alias("mail"))


@query(r"""SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?;\n]*[.!?;\n]|[^.!?;\n]+$'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS s FROM documents)""")
def i9_sentence_split(spark, d):
    return docs(spark, d).select("doc_id", T.sentences(F.col("text"), DELIMS).alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


def children(spark, d):
    return I.child_chunks(docs(spark, d), delims=DELIMS)


@query(f"WITH {KIDS_SQL} SELECT doc_id, idx, length(text) AS n_chars, md5(text) AS text_md5 FROM kid")
def i10_child_chunks(spark, d):
    return children(spark, d).select(F.col("doc").alias("doc_id"), "idx", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query(f"WITH {PARENT_SQL} SELECT doc_id, parent, md5(text) AS text_md5 FROM par")
def i11_parent_chunks(spark, d):
    return I.parent_chunks(children(spark, d)).select(F.col("doc").alias("doc_id"), "parent", F.md5("text").alias("text_md5"))


def paragraphs(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("para", "text"))


@query(f"WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para FROM documents), c AS (SELECT doc_id, para, unnest(kids) AS text, generate_subscripts(kids, 1) AS k FROM (SELECT doc_id, para, {packed_sql(sentences_sql('text'), 512, 64)} AS kids FROM p)) SELECT doc_id, para, row_number() OVER (PARTITION BY doc_id ORDER BY para, k) - 1 AS idx, md5(text) AS text_md5 FROM c")
def i12_semantic_chunks(spark, d):
    return I.chunk_by_paragraph(paragraphs(spark, d), delims=DELIMS).select(F.col("doc").alias("doc_id"), "para", "idx", F.md5("text").alias("text_md5"))


@query(f"""WITH {PARENT_SQL} SELECT printf('%d_child_%04d', kid.doc_id, kid.idx) AS chunk_id, kid.doc_id, 'child' AS chunk_type, printf('%d_parent_%04d', kid.doc_id, parent) AS parent_id, kid.idx AS chunk_index, md5(kid.text) AS text_md5, md5(par.text) AS parent_md5 FROM kid JOIN par ON kid.doc_id = par.doc_id AND kid.idx // 4 = parent
UNION ALL SELECT printf('%d_parent_%04d', doc_id, parent), doc_id, 'parent', NULL, -1, md5(text), NULL FROM par""")
def i13_chunk_rows(spark, d):
    return I.chunk_rows(docs(spark, d), delims=DELIMS).select("chunk_id", F.col("doc").alias("doc_id"), "chunk_type", "parent_id", "chunk_index", F.md5("text").alias("text_md5"), F.md5("parent_text").alias("parent_md5"))


def sentence_rows(spark, d):
    """Sentences with a derived boundary score in place of a model's."""
    s = docs(spark, d).select(F.col("doc_id").alias("doc"), F.posexplode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("sent", "text"))
    return s.withColumn("ratio", (F.length("text") % 10) / 10.0)


SENT_SQL = "s AS (SELECT doc_id AS doc, unnest(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS text, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: x <> ''), 1) - 1 AS sent FROM documents)"


@query(f"""WITH {SENT_SQL}, t AS (SELECT doc, sent * 100 + k * 10 AS t0, sent * 100 + k * 10 + 9 AS t1, (sent + k) % 3 AS pred FROM s, range(10) r(k))
SELECT s.doc, s.sent, round(coalesce(avg(CASE WHEN t.t0 >= s.sent * 100 AND t.t1 <= s.sent * 100 + 95 THEN CAST(pred = 0 AS INT) END), 0), 6) AS ratio FROM s LEFT JOIN t ON s.doc = t.doc AND t.t0 >= s.sent * 100 AND t.t1 <= s.sent * 100 + 95 GROUP BY ALL""")
def i14_boundary_density(spark, d):
    s = sentence_rows(spark, d).select("doc", "sent", (F.col("sent") * 100).alias("start"), (F.col("sent") * 100 + 95).alias("end"))
    t = s.select("doc", "sent", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).select("doc", (F.col("sent") * 100 + F.col("k") * 10).alias("start"), (F.col("sent") * 100 + F.col("k") * 10 + 9).alias("end"), ((F.col("sent") + F.col("k")) % 3).alias("pred"))
    return I.boundary_density(t, s).withColumns({"ratio": F.round("ratio", 6), "sent": F.col("sent").cast("long")})


@query("""WITH spine AS (SELECT conv_id AS doc, unnest(range(500 + conv_id % 7 * 100)) AS token FROM (SELECT DISTINCT conv_id FROM conversations)),
v AS (SELECT doc, token, w, (token * 7 + w * 3 + doc) % 5 < 2 AS p FROM spine, range(4) r(w) WHERE token >= w * 350 AND token < w * 350 + 400)
SELECT spine.doc, spine.token, coalesce(avg(CAST(p AS INT)) >= 0.5, false) AS is_boundary FROM spine LEFT JOIN v ON spine.doc = v.doc AND spine.token = v.token GROUP BY ALL""")
def i15_window_vote(spark, d):
    ids = S.read_table(spark, d, "conversations").select(F.col("conv_id").alias("doc")).distinct()
    spine = ids.select("doc", F.explode(F.sequence(F.lit(0), (499 + F.col("doc") % 7 * 100).cast("int"))).alias("token"))
    wins = spine.select("doc", "token", F.explode(F.array(*map(F.lit, range(4)))).alias("win")).where("token >= win * 350 and token < win * 350 + 400")
    preds = wins.select("doc", "win", (F.col("token") - F.col("win") * 350).alias("local"), ((F.col("token") * 7 + F.col("win") * 3 + F.col("doc")) % 5 < 2).cast("int").alias("pred"))
    return I.window_vote(preds, spine).withColumn("token", F.col("token").cast("long"))


PARA_SQL = f"""{SENT_SQL}, o AS (SELECT *, sum(CASE WHEN sent = 0 OR length(text) % 10 >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY sent) - 1 AS para FROM s),
p AS (SELECT doc, cast(para AS bigint) AS para, string_agg(text, '' ORDER BY sent) AS text FROM o GROUP BY ALL)"""


@query(f"WITH {PARA_SQL} SELECT doc, para, md5(text) AS text_md5 FROM p")
def i16_i19_paragraph_groups(spark, d):
    return I.group_paragraphs(sentence_rows(spark, d)).select("doc", "para", F.md5("text").alias("text_md5"))


@query(f"""WITH {PARA_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY para) AS n, length(text) < 100 AND NOT regexp_matches(text, '[|]') AS short FROM p),
f AS (SELECT *, first(short) OVER (PARTITION BY doc ORDER BY para) AS fs FROM n),
g AS (SELECT *, sum(CASE WHEN n = 1 THEN 1 WHEN n = 2 AND fs THEN 0 WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY para) - 1 AS g FROM f)
SELECT doc, cast(g AS bigint) AS para, md5(string_agg(text, '' ORDER BY n)) AS text_md5 FROM g GROUP BY ALL""")
def i17_merge_short(spark, d):
    return I.merge_short(I.group_paragraphs(sentence_rows(spark, d)), 100, r"[|]").select("doc", "para", F.md5("text").alias("text_md5"))


def headed(spark, d):
    """The sentences, some led by a clause number, some by words that only begin alike."""
    lead = F.when(F.col("sent") % 7 == 3, F.concat(F.lit("第"), F.col("sent"), F.lit("条 "))).when(F.col("sent") % 7 == 5, F.lit("本款第二项所列条件适用 ")).otherwise("")
    return sentence_rows(spark, d).withColumn("text", F.concat(lead, "text"))


HEADED_SQL = f"""{SENT_SQL}, hs AS (SELECT doc, sent, length(text) % 10 >= 3 AS opens, CASE WHEN sent % 7 = 3 THEN '第' || sent || '条 ' WHEN sent % 7 = 5 THEN '本款第二项所列条件适用 ' ELSE '' END || text AS text FROM s)"""
MERGED_SQL = """o AS (SELECT *, sum(CASE WHEN sent = 0 OR opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY sent) - 1 AS para FROM hs),
p AS (SELECT doc, cast(para AS bigint) AS para, string_agg(text, '' ORDER BY sent) AS text FROM o GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY para) AS n, length(text) < 100 AND NOT regexp_matches(text, '^第[一二三四五六七八九十百千0-9]+[章节条]') AS short FROM p),
f AS (SELECT *, first(short) OVER (PARTITION BY doc ORDER BY para) AS fs FROM n),
g AS (SELECT *, sum(CASE WHEN n = 1 THEN 1 WHEN n = 2 AND fs THEN 0 WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY para) - 1 AS g FROM f),
m AS (SELECT doc, cast(g AS bigint) AS para, string_agg(text, '' ORDER BY n) AS text FROM g GROUP BY ALL)"""


@query(f"WITH {HEADED_SQL}, {MERGED_SQL} SELECT doc, para, md5(text) AS text_md5 FROM m")
def i17_merge_short_default(spark, d):
    return I.merge_short(I.group_paragraphs(headed(spark, d))).select("doc", "para", F.md5("text").alias("text_md5"))


@query(f"""WITH {HEADED_SQL.replace('FROM s)', "FROM s WHERE doc IN (SELECT doc_id FROM documents WHERE length(text) >= 100) AND doc IN (SELECT doc FROM s GROUP BY doc HAVING count(*) > 1))")}, {MERGED_SQL},
w AS (SELECT doc_id AS doc, 0::BIGINT AS para, [text] AS parts FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc FROM hs)),
c AS (SELECT doc, para, CASE WHEN length(text) > 4000 THEN {packed_sql(sentences_sql('text', '.!?'), 4000, 0)} ELSE [text] END AS parts FROM m UNION ALL SELECT * FROM w)
SELECT doc, para, part, md5(text) AS text_md5 FROM (SELECT doc, para, unnest(range(len(parts))) AS part, unnest(parts) AS text FROM c)""")
def i19_segment(spark, d):
    whole = docs(spark, d).select(F.col("doc_id").alias("doc"), "text")
    return I.segment(whole, headed(spark, d), delims=".!?\n").select("doc", "para", "part", F.md5("text").alias("text_md5"))


@query(f"WITH c AS (SELECT doc_id AS doc, CASE WHEN length(text) > 4000 THEN {packed_sql(sentences_sql('text', '.!?'), 4000, 0)} ELSE [text] END AS parts FROM documents) SELECT doc, part, length(text) AS n_chars, md5(text) AS text_md5 FROM (SELECT doc, unnest(range(len(parts))) AS part, unnest(parts) AS text FROM c)")
def i18_split_long(spark, d):
    x = docs(spark, d).select(F.col("doc_id").alias("doc"), F.lit(0).alias("para"), "text")
    return I.split_long(x, 4000, ".!?\n").select("doc", "part", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query(f"WITH {KIDS_SQL}, {SECTION_SQL}, hit AS (SELECT kid.doc_id, idx, arg_min(title, pos) AS clause_type FROM kid JOIN sec ON sec.doc_id = kid.doc_id AND contains(body, substr(text, 1, 50)) GROUP BY ALL) SELECT doc_id, idx, coalesce(clause_type, '其他') AS clause_type FROM kid LEFT JOIN hit USING (doc_id, idx)")
def i20_clause_annotation(spark, d):
    x = docs(spark, d).select("doc_id", T.pack(T.sentences(F.col("text"), DELIMS)).alias("kids"), T.sections(F.col("text"), PATTERNS).alias("secs"))
    return x.select("doc_id", F.posexplode(I.annotate_clause(F.col("kids"), F.col("secs"))).alias("idx", "clause_type"))


@query(f"WITH {PARENT_SQL} SELECT printf('%d_child_%04d', kid.doc_id, kid.idx) AS chunk_id, md5(kid.text) AS text_md5, printf('%d_parent_%04d', kid.doc_id, parent) AS parent_id, md5(par.text) AS parent_md5 FROM kid JOIN par ON kid.doc_id = par.doc_id AND kid.idx // 4 = parent")
def i21_child_projection(spark, d):
    return I.chunk_rows(docs(spark, d), delims=DELIMS).where("chunk_type = 'child'").select("chunk_id", F.md5("text").alias("text_md5"), "parent_id", F.md5("parent_text").alias("parent_md5"))


@query(f"WITH {DOCS_SQL}, n AS (SELECT insurer, product_code, max(version) AS current FROM docs WHERE doc_id % 10 = 0 GROUP BY ALL) SELECT doc_id, coalesce(version = current, true) AS is_valid FROM docs LEFT JOIN n USING (insurer, product_code)")
def i22_version_invalidation(spark, d):
    x = docs(spark, d)
    return I.invalidate_versions(x.withColumn("is_valid", F.lit(True)), x.where("doc_id % 10 = 0")).select("doc_id", "is_valid")


@query(f"WITH {DOCS_SQL} SELECT doc_id FROM docs WHERE (insurer, product_code) NOT IN (SELECT insurer, product_code FROM docs WHERE doc_id % 50 = 0)")
def i23_delete_product(spark, d):
    x = docs(spark, d)
    return I.delete_product(x, x.where("doc_id % 50 = 0").select("insurer", "product_code").distinct()).select("doc_id")


@query(f"WITH {DOCS_SQL}, n AS (SELECT insurer, product_code, max(version) AS current FROM docs WHERE doc_id % 10 = 0 GROUP BY ALL) SELECT doc_id, coalesce(version = current, true) AS is_valid FROM docs LEFT JOIN n USING (insurer, product_code) WHERE (insurer, product_code) NOT IN (SELECT insurer, product_code FROM docs WHERE doc_id % 50 = 0)")
def i22_i23_store(spark, d):
    """Old versions made invalid and products deleted in a stored table, by lists; then compacted."""
    store = Store(spark, scratch(spark, "chunks"))
    x = docs(spark, d).select("doc_id", "insurer", "product_code", "version").withColumn("is_valid", F.lit(True))
    append_chunks(store, x.where("doc_id % 2 = 0"), "even")
    append_chunks(store, x.where("doc_id % 2 = 1"), "odd")
    invalidate(store, x.where("doc_id % 10 = 0"), "newer")
    delete(store, x.where("doc_id % 50 = 0").select("insurer", "product_code").distinct(), "gone")
    store.compact("whole")
    return store.read().select("doc_id", "is_valid")


@query("SELECT doc_id, length(text) >= 100 AND doc_id % 11 <> 0 AS ok FROM documents")
def i24_quarantine(spark, d):
    good, bad = I.quarantine(docs(spark, d), (F.length("text") >= 100) & (F.col("doc_id") % 11 != 0))
    return good.select("doc_id", F.lit(True).alias("ok")).unionByName(bad.select("doc_id", F.lit(False).alias("ok")))


STATUS_SQL = "CASE WHEN length(text) < 100 THEN 'failed' WHEN doc_id % 7 = 0 THEN 'skipped' WHEN doc_id % 13 = 0 THEN 'kg_failed' ELSE 'success' END"


@query(f"SELECT count(*) AS total, count(*) FILTER (s = 'success') AS success, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'kg_failed') AS kg_failed FROM (SELECT {STATUS_SQL} AS s FROM documents)")
def i25_ingest_stats(spark, d):
    return I.ingest_stats(docs(spark, d).select(F.expr(STATUS_SQL).alias("status")))


@query("SELECT conv_id, turn FROM conversations WHERE role <> 'user'")
def i26_cache_invalidation(spark, d):
    c = S.read_table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("result:"), "role", F.lit(":"), F.md5("text")).alias("key"))
    return I.invalidate_cache(c, ["user"]).select("conv_id", "turn")
