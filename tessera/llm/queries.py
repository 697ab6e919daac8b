"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, hnsw, negatives, packing, quality, secrets, sharding, simhash, substrings, token_counts, toxicity, whitening
from .common import text_batches

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op2_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_quality(spark, sf_dir):
    return quality.co_train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_nearest_neighbours(spark, sf_dir):
    return hnsw.nearest(read(spark, sf_dir, "embeddings"))


def op5_repeated_substrings(spark, sf_dir):
    return substrings.remove_repeats(read(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_simhash(spark, sf_dir):
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_secret_scan(spark, sf_dir):
    return secrets.secret_digest(read(spark, sf_dir, "documents"))


def op10_chat_format(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digest(turns.unionByName(chat.probe_turns(spark)))


def op11_whitening(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_sharding(spark, sf_dir):
    return sharding.shard_digest(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", moved))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_decontamination, op3_quality, op4_nearest_neighbours, op5_repeated_substrings, op6_toxicity, op7_simhash,
        op8_token_counts, op9_secret_scan, op10_chat_format, op11_whitening, op12_sharding, op13_hard_negatives,
    )
}

#: Escaping of control strings, as the chat template does it.
ESCAPED = r"regexp_replace({}, '(<|\[)(\\*)(/?s>|/?(?:INST|SYS|OUT|ROLE)\])', '\1\\\2\3', 'g')"

#: The others need hashes, tokenizers, learned weights or randomness tests that SQL lacks; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_repeated_substrings": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
b AS (SELECT doc_id, q, substr(h, 2 * q + 1, 2098) AS h FROM (SELECT doc_id, h, unnest(range(0, n - 49, 1000)) AS q FROM d WHERE n >= 50)),
k AS (SELECT doc_id, q + i AS p, md5_number(substr(h, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, q, h, unnest(range(0, least(1000, length(h) // 2 - 49))) AS i FROM b)),
f AS (SELECT s, min(doc_id) AS first FROM k GROUP BY s HAVING min(doc_id) < max(doc_id)),
o AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS opens FROM (SELECT DISTINCT doc_id, p FROM k JOIN f USING (s) WHERE first < doc_id)),
g AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM o),
x AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY ALL),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM x),
c AS (SELECT e.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)""",
    "op10_chat_format": rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, CASE role WHEN 'system' THEN '<s>[SYS] ' WHEN 'user' THEN '<s>[INST] ' WHEN 'assistant' THEN '<s>[OUT] ' ELSE '<s>[ROLE] ' || {ESCAPED.format("role")} || ' [/ROLE]' END || {ESCAPED.format("text")} || CASE role WHEN 'system' THEN ' [/SYS]</s>' WHEN 'user' THEN ' [/INST]</s>' WHEN 'assistant' THEN ' [/OUT]</s>' ELSE ' [/ROLE]</s>' END AS said FROM t),
m AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 'start') || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS moves FROM f),
c AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS learned, sum(length(said))::BIGINT AS formatted_chars, bool_and(moves) AND arg_max(role, n) = 'assistant' AS valid, (min(n) FILTER (NOT moves) - 1)::INT AS error_turn FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars, valid, error_turn FROM c""",
    "op12_sharding": """WITH byte AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS crc FROM (SELECT unnest(range(256)) AS n)),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, (octet_length(encode(t)) + 1)::BIGINT AS size, ('0x' || substr(md5(t), 1, 15))::BIGINT AS h, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, crc[xor(a & 255, b) + 1])), 4294967295) AS text_crc32 FROM d, byte),
o AS (SELECT *, sum(size) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS before, row_number() OVER (ORDER BY h, doc_id) - 1 AS i, sum(size) OVER () AS total FROM k),
s AS (SELECT doc_id, size, text_crc32, i, least(7, 8 * (2 * before + size) // (2 * total))::INT AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, i - min(i) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM s""",
    "op13_hard_negatives": """WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x::DOUBLE[], b.x::DOUBLE[])::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
