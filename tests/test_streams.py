import random

from pyspark.sql import functions as F

from tessera.operators import ingest as I
from tessera.streaming import sessions as S


def breaker(rows, threshold, cool):
    fails, last, is_open, out = 0, 0.0, False, []
    for at, i, ok in sorted(rows):
        if is_open and at - last < cool:
            out.append((i, True, False))
            continue
        is_open = False
        if ok:
            fails, opened = 0, False
        else:
            fails, last = fails + 1, at
            opened = is_open = fails >= threshold
        out.append((i, False, opened))
    return out


def test_breaker_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(c, round(rng.random() * 2000, 1), i, rng.random() < 0.3) for i, c in enumerate(["a", "b", "c"] * 100)]
    df = spark.createDataFrame(rows, "channel string, at double, id long, ok boolean")
    got = sorted((r.id, r.skipped, r.opened) for r in S.breaker_replay(df, 3, 30.0).collect())
    assert got == sorted(x for c in "abc" for x in breaker([r[1:] for r in rows if r[0] == c], 3, 30.0))
    assert any(s for _, s, _ in got) and any(o for *_, o in got)


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_cache_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((rng.choice("xyz"), float(rng.randint(0, 5000)), i) for i in range(300))
    df = spark.createDataFrame(rows, "key string, at double, id long")
    batch = sorted((r.id, r.hit) for r in S.cache_replay(df).collect())
    df.orderBy("at").coalesce(1).write.parquet(f"{tmp_path}/in")
    for delay, name in ((None, "replayed"), ("10 seconds", "replayed_and_expired")):
        drain(S.cache_replay_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), delay=delay), name)
        assert sorted((r.id, r.hit) for r in spark.table(name).collect()) == batch
    assert any(h for _, h in batch) and not all(h for _, h in batch)


def test_session_stream_closes_the_batch_prefix(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    batch = {(r.user_id, r.start, r.last, r.n) for r in S.sessions(ev).collect()}
    ev.repartition(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/ev")
    drain(S.sessions(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/ev"), delay="1 hour"), "closed")
    stream = {(r.user_id, r.start, r.last, r.n) for r in spark.table("closed").collect()}
    assert stream <= batch and len(stream) >= 0.9 * len(batch)


def test_ingest_stream(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(30)], "doc_id long, text string")
    store = f"{tmp_path}/store"
    ingest = lambda batch, old: I.dedup_documents(I.with_md5(batch), old)
    for k in range(2):
        docs.where(f"doc_id % 2 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        q = S.ingest_stream(spark.readStream.schema(docs.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/cp", ingest)
        q.awaitTermination()
    got = spark.read.parquet(store)
    assert got.count() == got.select("text").distinct().count() == 7


def test_ingest_stream_repeats_a_batch(spark, tmp_path):
    """A batch that is run again, as after a failure before its commit, is not stored twice."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/in")
    ingest = lambda batch, old: I.dedup_documents(I.with_md5(batch), old)
    for k in range(2):  # a new progress folder each time: batch 0 again
        S.ingest_stream(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/cp{k}", ingest).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/store").count() == 10


def progress(stream, path):
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def in_files(spark, df, path, cuts):
    for lo, hi in zip(cuts, cuts[1:]):
        df.where((F.col("at") >= lo) & (F.col("at") < hi)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_cache_state_expires(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"k{rng.randrange(40)}", float(rng.randint(0, 400)), i) for i in range(200)]
    rows += [(f"late{rng.randrange(3)}", float(rng.randint(900, 4900)), 1000 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, at double, id long")
    kept = progress(S.cache_replay_stream(in_files(spark, df, tmp_path, [0, 200, 500, 1500, 3000, 5000]), 300.0, "10 seconds"), tmp_path)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("id", "hit").collect())) == sorted((r.id, r.hit) for r in S.cache_replay(df, 300.0).collect())
    assert max(kept) >= 30 and kept[-1] <= 6  # a value and a timer a key


def test_breaker_stream_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice("abcdefgh"), round(rng.random() * 900, 1), i, rng.random() < 0.45) for i in range(800)]
    rows += [(c, 2000.0, 5000 + i, True) for i, c in enumerate("abcdefgh")]
    df = spark.createDataFrame(rows, "channel string, at double, id long, ok boolean")
    kept = progress(S.breaker_stream(in_files(spark, df, tmp_path, [0, 300, 600, 1000, 3000]), 3, 30.0), tmp_path)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("channel", "id", "skipped", "opened").collect())) == sorted(map(tuple, S.breaker_replay(df, 3, 30.0).collect()))
    assert max(kept) > 0 and kept[-1] == 0  # all is well again


def test_latency_sketches_merge(spark):
    rng = random.Random(9)
    rows = [("a", rng.lognormvariate(0, 1), i % 30) for i in range(30000)] + [("b", 5.0, 1), ("b", None, 2)]
    log = spark.createDataFrame(rows, "stage string, latency double, day int")
    days = S.latency_sketches(log)
    assert days.count() == 31
    values = sorted(v for s, v, _ in rows if s == "a")
    for source in (days, S.latency_sketches(log, ())):  # merged days, one pass
        got = {r.stage: r for r in S.merged_latency(source, (0.1, 0.5, 0.99)).collect()}
        assert got["a"].n == 30000 and got["b"].quantiles == [5.0] * 3 and got["a"].most == values[-1]
        for q, v in zip((0.1, 0.5, 0.99), got["a"].quantiles):
            assert abs(sum(x <= v for x in values) / 30000 - q) < 0.0165


def test_streams_deal_many_keys_into_few_states(spark, tmp_path):
    """One call and one state row a bucket in a micro-batch, however many keys; null keys and huge ones too."""
    rng = random.Random(12)
    keys = [None, *range(2**60, 2**60 + 400)]
    rows = [(rng.choice(keys), round(rng.random() * 900, 1), i, rng.random() < 0.45) for i in range(3000)]
    df = spark.createDataFrame(rows, "channel long, at double, id long, ok boolean")
    cuts = [0, 300, 600, 1000]
    kept = progress(S.breaker_stream(in_files(spark, df, tmp_path / "b", cuts), 2, 30.0, buckets=8), tmp_path / "b")
    want = sorted(repr((c, *x)) for c in keys for x in breaker([r[1:] for r in rows if r[0] == c], 2, 30.0))
    assert sorted(repr(tuple(r)) for r in spark.read.parquet(f"{tmp_path}/b/out").select("channel", "id", "skipped", "opened").collect()) == want
    assert 0 < max(kept) <= 8
    asked = df.select(F.concat(F.lit("k"), "channel").alias("key"), "at", "id")
    kept = progress(S.cache_replay_stream(in_files(spark, asked, tmp_path / "c", cuts), 200.0, "10 seconds", buckets=8), tmp_path / "c")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/c/out").select("id", "hit").collect())) == sorted((r.id, r.hit) for r in S.cache_replay(asked, 200.0).collect())
    assert 0 < max(kept) <= 24
