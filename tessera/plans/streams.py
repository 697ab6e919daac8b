"""Queries over event logs: batch twins of the streaming operators."""

from pyspark.sql import functions as F

from tessera.functions.lineage import scratch
from tessera.operators import ingest as I
from tessera.registry import query
from tessera.sources.tables import read_table
from tessera.streaming import sessions as S


def events(spark, d):
    return read_table(spark, d, "events")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM i GROUP BY user_id, k")
def t1_sessions(spark, d):
    return S.sessions(events(spark, d)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "last")})


@query("SELECT conv_id, md5(string_agg(role || ': ' || substr(text, 1, 200), chr(10) ORDER BY turn)) AS recent_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 GROUP BY 1")
def t2_recent_turns(spark, d):
    return S.recent_turns(read_table(spark, d, "conversations")).select("conv_id", F.md5("recent").alias("recent_md5"))


SECONDS = "epoch(ts)"


T3_SQL = ("WITH RECURSIVE e AS (SELECT user_id || ':' || event_type AS key, event_id AS id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events), r(key, id, n, written, hit) AS (SELECT key, id, n, us, false FROM e WHERE n = 1 UNION ALL SELECT e.key, e.id, e.n, CASE WHEN e.us < r.written + 36000000000 THEN r.written ELSE e.us END, e.us < r.written + 36000000000 FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1) SELECT id, hit FROM r")


@query(T3_SQL)
def t3_cache_replay(spark, d):
    x = events(spark, d).select(F.concat_ws(":", "user_id", "event_type").alias("key"), (F.unix_micros("ts") / 1e6).alias("at"), F.col("event_id").alias("id"))
    return S.cache_replay(x, 36000.0).select("id", "hit")


def slices(spark, d, x, n: int = 3):
    """x(at, …) as a stream of n files in order of time, one a micro-batch, and a folder for its results."""
    base = scratch(spark, "stream")
    first, last = x.agg(F.min("at"), F.max("at")).first()
    part = F.least(F.floor((F.col("at") - first) / max(last - first, 1e-9) * n), F.lit(n - 1))
    for k in range(n):
        x.where(part == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), base


def run_stream(spark, out, base):
    """The rows of a finished stream; the session's state store is put back."""
    name, store = S.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        out.writeStream.format("parquet").option("checkpointLocation", f"{base}/progress").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query(T3_SQL)
def t3_cache_replay_stream(spark, d):
    """As a stream, whose state expires by timer."""
    x = events(spark, d).select(F.concat_ws(":", "user_id", "event_type").alias("key"), (F.unix_micros("ts") / 1e6).alias("at"), F.col("event_id").alias("id"))
    stream, base = slices(spark, d, x)
    return run_stream(spark, S.cache_replay_stream(stream, 36000.0, "1 minute"), base).select("id", "hit")


@query("SELECT coalesce(min(doc_id) FILTER (doc_id % 2 = 0), min(doc_id)) AS doc_id, md5(text) AS file_md5, min(doc_id % 2) AS batch FROM documents GROUP BY text")
def t4_ingest_batches(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", F.md5("text").alias("file_md5"), (F.col("doc_id") % 2).alias("batch"))
    first = I.dedup_documents(docs.where("batch = 0"))
    return first.unionByName(I.dedup_documents(docs.where("batch = 1"), first))


@query("SELECT DISTINCT md5(text) AS file_md5, length(text) AS n_chars FROM documents")
def t4_ingest_stream(spark, d):
    """The documents as a stream of files, ingested by micro-batches into a store without repeats."""
    base = scratch(spark, "ingest")
    docs = read_table(spark, d, "documents").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("part"))
    docs.write.partitionBy("part").parquet(f"{base}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", "2").parquet(f"{base}/in")
    S.ingest_stream(stream.select("doc_id", "text"), f"{base}/store", f"{base}/progress", lambda batch, old: I.dedup_documents(I.with_md5(batch), old)).awaitTermination()
    return spark.read.parquet(f"{base}/store").select("file_md5", F.length("text").alias("n_chars"))


@query("WITH i AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT user_id AS channel, min(ts) AS start, count(*) AS n FROM i WHERE event_type = 'error' GROUP BY user_id, k HAVING count(*) >= 3")
def t5_failure_streaks(spark, d):
    x = events(spark, d).select(F.col("user_id").alias("channel"), "ts", F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"))
    return S.failure_streaks(x, 3).withColumn("start", F.col("start").cast("timestamp_ntz"))


T5_SQL = """WITH RECURSIVE e AS (SELECT user_id AS channel, event_id AS id, epoch_us(ts) AS us, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r(channel, id, n, fails, failed_at, is_open, skipped, opened) AS (SELECT channel, id, n, CASE WHEN ok THEN 0 ELSE 1 END, us, false, false, false FROM e WHERE n = 1
UNION ALL SELECT e.channel, e.id, e.n, CASE WHEN r.is_open AND e.us - r.failed_at < 36000000000 THEN r.fails WHEN e.ok THEN 0 ELSE r.fails + 1 END, CASE WHEN (r.is_open AND e.us - r.failed_at < 36000000000) OR e.ok THEN r.failed_at ELSE e.us END,
(r.is_open AND e.us - r.failed_at < 36000000000) OR (NOT e.ok AND r.fails + 1 >= 2), r.is_open AND e.us - r.failed_at < 36000000000, NOT (r.is_open AND e.us - r.failed_at < 36000000000) AND NOT e.ok AND r.fails + 1 >= 2 FROM r JOIN e ON e.channel = r.channel AND e.n = r.n + 1)
SELECT channel, id, skipped, opened FROM r"""


@query(T5_SQL)
def t5_breaker_replay(spark, d):
    x = events(spark, d).select(F.col("user_id").alias("channel"), (F.unix_micros("ts") / 1e6).alias("at"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"))
    return S.breaker_replay(x, 2, 36000.0)


@query(T5_SQL)
def t5_breaker_stream(spark, d):
    """As a stream over micro-batches; only channels in trouble keep state."""
    x = events(spark, d).select(F.col("user_id").alias("channel"), (F.unix_micros("ts") / 1e6).alias("at"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"))
    stream, base = slices(spark, d, x)
    return run_stream(spark, S.breaker_stream(stream, 2, 36000.0), base)


@query("WITH x AS (SELECT event_type AS stage, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT stage, max(n) AS n, round(avg(value), 6) AS mean, max(value) AS most, 3::BIGINT AS near FROM x GROUP BY stage")
def t6_latency_sketches(spark, d):
    """Quantiles out of daily sketches, and how many of the three lie within 2 % of their true rank."""
    log = events(spark, d).select(F.col("event_type").alias("stage"), F.col("value").cast("double").alias("latency"), F.to_date("ts").alias("day"))
    wanted = (0.5, 0.95, 0.99)
    found = S.merged_latency(S.latency_sketches(log), wanted)
    ranks = log.join(F.broadcast(found.select("stage", "quantiles")), "stage").groupBy("stage").agg(
        *[F.avg((F.col("latency") <= F.col("quantiles")[i]).cast("double")).alias(f"at{i}") for i in range(3)], *[F.avg((F.col("latency") < F.col("quantiles")[i]).cast("double")).alias(f"under{i}") for i in range(3)]
    )
    near = sum(((F.col(f"at{i}") >= q - 0.02) & (F.col(f"under{i}") <= q + 0.02)).cast("long") for i, q in enumerate(wanted))
    return found.join(ranks, "stage").select("stage", "n", F.round("mean", 6).alias("mean"), "most", near.alias("near"))


@query("SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, max(value) AS most FROM events GROUP BY 1")
def t6_stage_latency(spark, d):
    x = S.stage_latency(events(spark, d).select(F.col("event_type").alias("stage"), F.col("value").alias("latency")))
    return x.withColumns({"mean": F.round("mean", 6), "p50": F.round("p50", 6)})


@query("SELECT user_id AS channel, round(avg((event_type = 'error')::INT), 6) AS rate, count(*) AS n FROM events GROUP BY 1")
def t7_fallback_rate(spark, d):
    x = events(spark, d).select(F.col("user_id").alias("channel"), (F.col("event_type") == "error").alias("is_fallback"))
    return S.fallback_rate(x).withColumn("rate", F.round("rate", 6))
