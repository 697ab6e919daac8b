"""Answer assembly, run bookkeeping and classifier evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import rules
from tessera.functions import text as T
from tessera.functions.lineage import cut

TRANSIENT = r"timeout|connection|timed out|too many requests|rate limit|service unavailable|try again"


def stage_plan(df: DataFrame, plans: dict | None = None) -> DataFrame:
    """A1: (query_id, complexity) -> query_id, pos, stage."""
    plans = rules.STAGE_PLANS if plans is None else plans
    stages = F.coalesce(*[F.when(F.col("complexity") == c, F.array(*[F.lit(s) for s in p])) for c, p in plans.items()])
    return df.select("query_id", F.posexplode(stages).alias("pos", "stage"))


def short_circuit(log: DataFrame) -> DataFrame:
    """A2: (query_id, pos, status, answer): rows up to the first that failed or skipped with an answer."""
    last = F.min(F.when((F.col("status") == "failed") | ((F.col("status") == "skip") & F.col("answer").isNotNull()), F.col("pos"))).over(Window.partitionBy("query_id"))
    return log.withColumn("last", last).where(F.col("last").isNull() | (F.col("pos") <= F.col("last"))).drop("last")


def aggregate_results(results: DataFrame) -> DataFrame:
    """A3: (query_id, task_id, agent_name, status, result, disclaimer) -> query_id, answer."""
    row = F.struct("task_id", "agent_name", F.col("status").isin("success", "degraded").alias("ok"), "result", "disclaimer")
    x = results.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("r")).withColumn("good", F.filter("r", lambda t: t["ok"]))
    none = F.concat(F.lit("抱歉，"), T.join(F.transform("r", lambda t: t["agent_name"]), "、"), F.lit(" 服务当前不可用。\n建议您联系人工客服获取帮助。"))
    one = F.col("good")[0]
    noted = F.when(F.coalesce(one["disclaimer"], F.lit("")) != "", F.concat(one["result"], F.lit("\n\n---\n"), one["disclaimer"])).otherwise(one["result"])
    many = T.join(F.transform("good", lambda t: F.concat(F.lit("【"), t["task_id"], F.lit("】"), t["result"])), "\n\n---\n\n")
    return x.select("query_id", F.when(F.size("good") == 0, none).when(F.size("good") == 1, noted).otherwise(many).alias("answer"))


def collect_sources(sources: DataFrame, most: int = 10, chars: int = 80) -> DataFrame:
    """A4: (query_id, pos, clause_no, text): the first of each clause number and text start, at most ten a query."""
    first = Window.partitionBy("query_id", "clause_no", F.substring("text", 1, chars)).orderBy("pos")
    once = sources.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    order = Window.partitionBy("query_id").orderBy("pos")
    return once.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def inject_upstream(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """A5: (query_id, task_id, dependencies) with results(query_id, task_id, status, result): upstream text and unmet flag for each dependency."""
    need = tasks.select("query_id", "task_id", F.explode("dependencies").alias("dep"))
    done = results.where(F.col("status").isin("success", "degraded")).select("query_id", F.col("task_id").alias("dep"), F.col("result").alias("upstream"))
    return need.join(done, ["query_id", "dep"], "left").withColumn("unmet", F.col("upstream").isNull())


def error_type(error: Column) -> Column:
    return F.when(error.isNull(), F.lit(None).cast("string")).when(F.lower(error).rlike(TRANSIENT), "transient").otherwise("permanent")


def resolve_calls(calls: DataFrame, rounds: int = 3, budget: int | None = None) -> DataFrame:
    """(run_id, idx, depends_on array<int>, error, ok_from int) -> run_id, idx, status, error_type, tries, round, cycle.

    A run's calls are a graph over depends_on, whatever the order of their indices; a dependency
    that is not an index of the run does not bind. A call is first tried in the round in which
    all its dependencies are done: in one round calls go by index, so a later one sees an
    earlier one's success at once and an earlier one sees a later one's in the next round. It
    succeeds at try ok_from (null: never); a failing call is tried again, once a round, only if
    its error is transient, `rounds` times at most. With a budget the run has only so many
    rounds in all. status is done, failed, skipped (a dependency failed or was skipped) or
    waiting (its turn never came: the budget ran out, or it depends on itself or on a call that
    waits). round is the one in which a call settled, null where it never did; cycle the
    smallest index of the circle a call is part of, null outside.

    Solved from the calls without open dependencies onwards: each step joins what has just
    settled with the edges that wait for it, so steps number as the longest chain and a run of
    any size is spread over all tasks. Runs and indices are unique; repeated dependencies count once.
    """
    kind = error_type(F.col("error"))
    transient = F.coalesce(kind, F.lit("")) == "transient"
    most = F.when(transient, rounds).otherwise(1)
    own = calls.select("run_id", F.col("idx").cast("int").alias("idx"), F.array_distinct(F.coalesce("depends_on", F.array().cast("array<int>"))).alias("deps"), kind.alias("kind"), most.alias("most"), F.coalesce("ok_from", F.lit(2**31 - 1)).alias("ok_from"))
    own = cut(own)
    edges = own.select("run_id", "idx", F.explode("deps").alias("dep"))
    edges = cut(edges.join(own.select("run_id", F.col("idx").alias("dep")), ["run_id", "dep"], "left_semi"))
    need = edges.groupBy("run_id", "idx").agg(F.count("*").cast("int").alias("need"))
    state = own.drop("deps").join(need, ["run_id", "idx"], "left").select("run_id", "idx", "kind", "most", "ok_from", F.coalesce("need", F.lit(0)).alias("need"), F.lit(False).alias("bad"), F.lit(False).alias("late"), F.lit(1).alias("start"))

    def settle(x: DataFrame) -> DataFrame:
        room = F.col("most") if budget is None else F.least("most", budget - F.col("start") + 1)
        late = F.col("late") | (room < 1)
        ok = F.col("ok_from") <= room
        tries = F.when(F.col("bad") | late, 0).when(ok, F.col("ok_from")).otherwise(room)
        status = F.when(F.col("bad"), "skipped").when(late, "waiting").when(ok, "done").otherwise("failed")
        error = F.when(F.col("bad"), "permanent").when(~late & ~ok, F.coalesce("kind", F.lit("permanent")))
        at = F.when(F.col("bad") | ~late, F.greatest(F.col("start"), F.col("start") + tries - 1))
        return x.select("run_id", "idx", status.alias("status"), error.alias("error_type"), tries.cast("int").alias("tries"), at.cast("int").alias("round"))

    settled, steps = None, 0
    while True:
        ready = F.col("bad") | (F.col("need") == 0)
        state = cut(state)
        frontier = settle(state.where(ready))
        if frontier.isEmpty():
            break
        settled = frontier if settled is None else settled.unionByName(frontier)
        steps += 1
        settled = cut(settled) if steps % 16 == 0 else settled
        seen = edges.join(frontier.select("run_id", F.col("idx").alias("dep"), "status", "round"), ["run_id", "dep"])
        met = seen.groupBy("run_id", "idx").agg(
            F.count("*").cast("int").alias("n"), F.max(F.col("status").isin("failed", "skipped")).alias("b"), F.max(F.col("status") == "waiting").alias("l"),
            F.max(F.col("round") + (F.col("dep") > F.col("idx")).cast("int")).alias("s"),
        )
        joined = state.where(~ready).join(met, ["run_id", "idx"], "left")
        state = joined.select(
            "run_id", "idx", "kind", "most", "ok_from", (F.col("need") - F.coalesce("n", F.lit(0))).alias("need"), (F.col("bad") | F.coalesce("b", F.lit(False))).alias("bad"),
            (F.col("late") | F.coalesce("l", F.lit(False))).alias("late"), F.greatest("start", "s").alias("start"),
        )
    stuck = state.select("run_id", "idx")
    circle = cycles(edges.join(stuck, ["run_id", "idx"], "left_semi").join(stuck.withColumnRenamed("idx", "dep"), ["run_id", "dep"], "left_semi"))
    waits = stuck.select("run_id", "idx", F.lit("waiting").alias("status"), F.lit(None).cast("string").alias("error_type"), F.lit(0).alias("tries"), F.lit(None).cast("int").alias("round"))
    out = waits if settled is None else settled.unionByName(waits)
    return out.join(circle, ["run_id", "idx"], "left")


def cycles(edges: DataFrame) -> DataFrame:
    """(run_id, idx, dep) -> run_id, idx, cycle: calls that reach themselves, named by the smallest of those they reach and are reached by.

    Every call takes the smallest index that reaches it; those that reach back to the one whose
    name they have are its circle and leave, and the rest goes on. Each step moves one number
    a call.
    """
    out = None
    edges = cut(edges.select("run_id", "idx", "dep").distinct())
    while not edges.isEmpty():
        # without an edge in or without an edge out, a call is in no circle
        while True:
            inner = edges.join(edges.select("run_id", F.col("dep").alias("idx")).distinct(), ["run_id", "idx"], "left_semi")
            inner = inner.join(edges.select("run_id", F.col("idx").alias("dep")).distinct(), ["run_id", "dep"], "left_semi")
            n, inner = edges.count(), cut(inner)
            edges, gone = inner, n - inner.count()
            if not gone:
                break
        if edges.isEmpty():
            break
        names = edges.select("run_id", "idx").distinct().withColumn("name", F.col("idx"))
        names = _spread(names, edges.select("run_id", F.col("idx").alias("from"), F.col("dep").alias("to")))
        inside = edges.join(names, ["run_id", "idx"]).join(names.select("run_id", F.col("idx").alias("dep"), F.col("name").alias("other")), ["run_id", "dep"]).where("name = other")
        inside = cut(inside.select("run_id", "idx", "dep", "name"))
        back = inside.where("idx = name").select("run_id", "idx", "name").distinct()
        while True:
            grown = inside.join(back.select("run_id", F.col("idx").alias("dep"), "name"), ["run_id", "dep", "name"]).select("run_id", "idx", "name").unionByName(back).distinct()
            grown = cut(grown)
            if grown.count() == back.count():
                break
            back = grown
        found = back.select("run_id", "idx", F.col("name").alias("cycle"))
        out = found if out is None else out.unionByName(found)
        left = edges.join(found.select("run_id", "idx"), ["run_id", "idx"], "left_anti")
        edges = cut(left.join(found.select("run_id", F.col("idx").alias("dep")), ["run_id", "dep"], "left_anti"))
    return edges.select("run_id", "idx", F.col("idx").alias("cycle")) if out is None else out


def _spread(names: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node's name becomes the smallest name that reaches it over edges(run_id, from, to)."""
    while True:
        sent = edges.join(names.withColumnRenamed("idx", "from"), ["run_id", "from"]).select("run_id", F.col("to").alias("idx"), "name")
        after = cut(names.unionByName(sent).groupBy("run_id", "idx").agg(F.min("name").alias("name")))
        total = lambda x: x.agg(F.sum("name")).first()[0]
        if total(after) == total(names):
            return after
        names = after


def confidence(reasoning: Column, any_success: Column) -> Column:
    """The number stated, else 0.8 with any success, else 0.5."""
    said = F.regexp_extract(reasoning, r"confidence=([\d.]+)", 1).try_cast("double")
    return F.coalesce(said, F.when(any_success, 0.8).otherwise(0.5))


CALLS = "array<struct<tool_name:string,tool_args:map<string,string>,depends_on:array<int>>>"


def parse_calls(df: DataFrame, text: str, schema: str = CALLS) -> tuple[DataFrame, DataFrame]:
    """(calls: one row each, bad rows): a code fence is stripped, calls without a name are dropped."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.col(text)), r"^```[a-z]*\s*", ""), r"\s*```$", "")
    parsed = df.withColumn("calls", F.from_json(bare, schema))
    bad = F.col("calls").isNull() | F.exists("calls", lambda c: c.isNull())
    good = parsed.where(~bad).select(*df.columns, F.posexplode("calls").alias("pos", "c")).where(F.coalesce(F.col("c.tool_name"), F.lit("")) != "")
    rows = good.select(*df.columns, "pos", "c.tool_name", F.coalesce("c.tool_args", F.create_map().cast("map<string,string>")).alias("tool_args"), F.coalesce("c.depends_on", F.array().cast("array<int>")).alias("depends_on"))
    return rows, parsed.where(bad).drop("calls")


# classifier evaluation


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    bound = F.transform(F.array(logits), lambda a: F.transform(a, lambda x: F.exp((x - F.array_max(a)) / temperature)))[0]
    return F.transform(F.transform(F.array(bound), lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda t, x: t + x).alias("s"))), lambda p: F.transform(p["e"], lambda x: x / p["s"]))[0]


def predict_from_logits(df: DataFrame, logits: str = "logits", temperature: float = 1.0) -> DataFrame:
    """Adds pred (index from 0) and confidence (4 places)."""
    x = df.withColumn("p", softmax(F.col(logits), temperature))
    return x.withColumns({"pred": (F.array_position("p", F.array_max("p")) - 1).cast("int"), "confidence": F.round(F.array_max("p"), 4)}).drop("p")


def accuracy(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Label (null: all), n, accuracy; a class without rows has null."""
    ok = F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy")
    each = labels.join(df.groupBy("label").agg(F.count("*").alias("n"), ok), "label", "left")
    return each.select("label", F.coalesce("n", F.lit(0)).alias("n"), "accuracy").unionByName(df.agg(F.lit(None).cast("int").alias("label"), F.count("*").alias("n"), ok))


def confusion(df: DataFrame) -> DataFrame:
    """Long form."""
    return df.groupBy("label", "pred").agg(F.count("*").alias("n"))


def calibrate(df: DataFrame, logits: str = "logits", steps: int = 20) -> DataFrame:
    """Temperature and mean loss of the best of log-spaced temperatures, the first of equals."""
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(10 ** (-0.5 + i / (steps - 1))).alias("t")) for i in range(steps)])
    x = df.select("label", logits, F.explode(grid).alias("g"))
    loss = -F.log(F.get(softmax(F.col(logits), F.col("g.t")), F.col("label")) + 1e-8)
    each = x.select("g.i", "g.t", loss.alias("nll")).groupBy("i", "t").agg(F.avg("nll").alias("nll"))
    return each.agg(F.min_by("t", F.struct(F.round("nll", 12), "i")).alias("temperature"), F.min("nll").alias("nll"))


def stratified_split(df: DataFrame, share: float = 0.1, key: str = "doc_id", label: str = "label", seed: str = "") -> DataFrame:
    """E5: adds held_out: the first `share` of each label's rows in the order of a hash."""
    order = Window.partitionBy(label).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    n = F.count("*").over(Window.partitionBy(label))
    return df.withColumn("held_out", F.row_number().over(order) <= F.ceil(n * share))
