"""Session, cache and failure analysis on event logs, as batches and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.ordered import in_order


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """user_id, start, last, n of sessions that end after an idle gap. delay: the watermark of a stream."""
    if delay is not None:
        events = events.withWatermark("ts", delay)
    found = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("last"))
    return found.select("user_id", "start", "last", "n")


def recent_turns(conv: DataFrame, n: int = 6, width: int = 200) -> DataFrame:
    """conv_id, recent: the last n turns in order, cut and led by their role."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    few = conv.withColumn("nth", F.row_number().over(last)).where(F.col("nth") <= n)
    line = F.concat("role", F.lit(": "), F.substring("text", 1, width))
    return few.groupBy("conv_id").agg(T.join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("t")))), lambda x: x["t"]), "\n").alias("recent"))


def cache_replay(requests: DataFrame, ttl: float = 600.0) -> DataFrame:
    """(key, at seconds, id) -> id, hit: whether an entry written within ttl stood; its life runs from the write.

    Requests of a key are read in time order; the state carried along is one number, the last
    write. A request ttl or more after the one before it cannot hit, so what follows it is a
    piece of its own and pieces of a busy key are read by different tasks.
    """
    by = Window.partitionBy("key").orderBy("at", "id")
    apart = F.coalesce(F.col("at") >= F.lag("at").over(by) + ttl, F.lit(True))
    pieces = requests.select("key", "at", "id").withColumn("piece", F.sum(apart.cast("int")).over(by))

    def replay():
        written = None

        def one(at, i):
            nonlocal written
            hit = written is not None and at < written + ttl
            written = written if hit else at
            return i, hit

        return one

    return in_order(pieces, ("key", "piece"), ("at", "id"), replay, "id long, hit boolean").select("key", "id", "hit")


#: The state store that processors with state variables and timers need; set it on the session that starts the stream (tessera.session does).
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Groups that a stream's keys are dealt into: one call and one state row each in a micro-batch, however many keys there are.
BUCKETS = 1024


def cache_replay_stream(requests: DataFrame, ttl: float = 600.0, delay: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """T3 on a stream: the last write of each key is its state between batches.

    delay: how late requests may come, against their own time `at`; with it a timer drops a
    key's state once its entry has expired, without it state stays. Keys are dealt into buckets,
    whose last writes are one state row; a micro-batch of a bucket is sorted in memory.
    """
    from pyspark.sql.streaming import StatefulProcessor

    due_at = lambda at: int((at + ttl) * 1000)

    class Replay(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.written = handle, handle.getValueState("written", "keys array<string>, ats array<double>, due long")

        def known(self) -> tuple[dict, int | None]:
            keys, ats, due = self.written.get() if self.written.exists() else ((), (), None)
            return dict(zip(keys, ats)), due

        def keep(self, written: dict, due: int | None) -> None:
            """Stores the last writes, with one timer: for the first of them that expires."""
            first = due_at(min(written.values())) if written and delay is not None else None
            if written:
                self.written.update((list(written), list(written.values()), first))
            else:
                self.written.clear()
            if first != due:
                if due is not None:
                    self.handle.deleteTimer(due)
                if first is not None:
                    self.handle.registerTimer(first)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            written, due = self.known()
            batch = pd.concat(list(rows)).sort_values(["at", "id"])
            hits = []
            for k, at in zip(batch["key"].tolist(), batch["at"].tolist()):
                last = written.get(k)
                hits.append(last is not None and at < last + ttl)
                if not hits[-1]:
                    written[k] = at
            if not all(hits):
                self.keep(written, due)
            yield pd.DataFrame({"key": batch["key"].to_numpy(), "id": batch["id"].to_numpy(), "hit": hits})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            written, due = self.known()
            now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
            gone = expiredTimerInfo.getExpiryTimeInMs()  # a timer that fires goes by itself
            self.keep({k: at for k, at in written.items() if due_at(at) > now}, None if due == gone else due)
            yield pd.DataFrame({"key": pd.Series([], dtype=object), "id": pd.Series([], dtype="int64"), "hit": pd.Series([], dtype=bool)})

        def close(self) -> None:
            pass

    mode = "None"
    if delay is not None:
        requests, mode = requests.withColumn("ts", F.timestamp_millis((F.col("at") * 1000).cast("long"))).withWatermark("ts", delay), "EventTime"
    dealt = requests.withColumns({"key": F.col("key").cast("string"), "bucket": F.pmod(F.xxhash64("key"), F.lit(buckets))})
    return dealt.groupBy("bucket").transformWithStateInPandas(Replay(), "key string, id long, hit boolean", "Append", mode)


def breaker_stream(calls: DataFrame, threshold: int = 5, cool_down: float = 30.0, buckets: int = BUCKETS) -> DataFrame:
    """T5 on a stream of (channel, at seconds, id, ok): channel, id, skipped, opened of every call, as breaker_replay has them.

    A channel's failures in a row, the time of the last and whether it is open are its state
    between batches; a success leaves nothing to remember, so healthy channels keep no state.
    Channels are dealt into buckets, whose states are one row; a micro-batch of a bucket is sorted
    in memory.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Breaker(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("breaker", "channels array<string>, fails array<long>, lasts array<double>, are_open array<boolean>")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            known = {c: state for c, *state in zip(*self.state.get())} if self.state.exists() else {}
            batch, rules = pd.concat(list(rows)).sort_values(["at", "id"]), {}
            channels, out = batch["channel"].tolist(), []
            for c, *call in zip(channels, batch["at"].tolist(), batch["id"].tolist(), batch["ok"].tolist()):
                if c not in rules:
                    rules[c] = breaker(threshold, cool_down, known.get(c))
                out.append(rules[c](*call))
            after = known | {c: rule.state() for c, rule in rules.items()}
            after = {c: state for c, state in after.items() if state[0] or state[2]}
            if after:
                self.state.update((list(after), *map(list, zip(*after.values()))))
            elif known:
                self.state.clear()
            yield pd.DataFrame({"channel": channels, "id": [o[0] for o in out], "skipped": [o[1] for o in out], "opened": [o[2] for o in out]})

        def close(self) -> None:
            pass

    kind = dict(calls.dtypes)["channel"]
    dealt = calls.withColumns({"channel": F.col("channel").cast("string"), "bucket": F.pmod(F.xxhash64("channel"), F.lit(buckets))})
    out = dealt.groupBy("bucket").transformWithStateInPandas(Breaker(), "channel string, id long, skipped boolean, opened boolean", "Append", "None")
    return out.withColumn("channel", F.col("channel").cast(kind))


def ingest_stream(docs: DataFrame, path: str, checkpoint: str, ingest) -> object:
    """T4: every micro-batch of new documents goes through ingest(batch, store so far or None) into path/batch=<id>.

    A batch that is run again after a failure sees the batches before it and writes its own
    folder anew, so nothing is stored twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            store = spark.read.parquet(path).where(F.col("batch") < number).drop("batch")
        except Exception as e:  # the first batch finds no store
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            store = None
        ingest(batch, store).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failure_streaks(calls: DataFrame, threshold: int = 5) -> DataFrame:
    """T5: channel, start, n of runs of at least threshold consecutive failures (gaps and islands)."""
    by = Window.partitionBy("channel").orderBy("ts", "id")
    island = F.sum(F.col("ok").cast("int")).over(by)
    runs = calls.withColumn("island", island).where(~F.col("ok")).groupBy("channel", "island").agg(F.min("ts").alias("start"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= threshold).select("channel", "start", "n")


def breaker_replay(calls: DataFrame, threshold: int = 5, cool_down: float = 30.0) -> DataFrame:
    """T5: (channel, at seconds, id, ok) -> id, skipped, opened of every call.

    A closed breaker opens at the threshold-th failure in a row; an open one skips calls until
    cool_down after the last failure, then lets one try: a failure opens it again at once, as
    the count stands, a success closes it and resets the count. A channel's calls are read in
    order by one task, which holds three numbers.
    """
    return in_order(calls, ("channel",), ("at", "id", "ok"), lambda: breaker(threshold, cool_down), "id long, skipped boolean, opened boolean")


def breaker(threshold: int, cool_down: float, known: tuple | None = None):
    """The rule of one channel, from a known (fails, last failure, is open) on; its state() is what to know next time."""
    fails, last, is_open = known or (0, 0.0, False)

    def one(at, i, ok):
        nonlocal fails, last, is_open
        if is_open and at - last < cool_down:
            return i, True, False
        if ok:
            fails, is_open = 0, False
        else:
            fails, last = fails + 1, at
            is_open = fails >= threshold
        return i, False, is_open

    one.state = lambda: (fails, last, is_open)
    return one


def stage_latency(log: DataFrame) -> DataFrame:
    """Stage, n, mean, p50, most, exact. Keeps every distinct value of a stage; latency_sketches does not."""
    return log.groupBy("stage").agg(F.count("*").alias("n"), F.avg("latency").alias("mean"), F.percentile("latency", 0.5).alias("p50"), F.max("latency").alias("most"))


def latency_sketches(log: DataFrame, by=("day",), k: int = 200) -> DataFrame:
    """A row for each stage and each of `by`: n, total, most and a KLL sketch, to be stored and merged.

    A sketch takes some kilobytes however many values it has seen; with k=200 a quantile's rank
    is off by about 1.65 % at most.
    """
    seen = log.where("latency is not null").groupBy("stage", *by)
    return seen.agg(F.count("*").alias("n"), F.sum("latency").alias("total"), F.max("latency").alias("most"), F.kll_sketch_agg_double(F.col("latency").cast("double"), F.lit(k)).alias("sketch"))


def merged_latency(sketches: DataFrame, quantiles=(0.5, 0.95, 0.99)) -> DataFrame:
    """T6 from stored sketches: stage, n, mean, most and quantiles (an array), over any choice of days."""
    met = sketches.groupBy("stage").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch").alias("s"))
    return met.select("stage", "n", "mean", "most", F.array(*[F.kll_sketch_get_quantile_double("s", F.lit(q)) for q in quantiles]).alias("quantiles"))


def fallback_rate(calls: DataFrame, by: str = "channel") -> DataFrame:
    """T7"""
    return calls.groupBy(by).agg(F.avg(F.col("is_fallback").cast("double")).alias("rate"), F.count("*").alias("n"))
