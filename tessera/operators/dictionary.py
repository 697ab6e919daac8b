"""Names of a dictionary table inside texts, by one automaton."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import cut

#: Names and bytes of one automaton; a larger dictionary is worked off part by part.
PART_NAMES, PART_BYTES = 100_000, 16 << 20
#: Texts that travel to a Python worker at a time, with all names found in them.
BATCH = 1_000


def finder(spark, names: list[str]):
    """A function of a text column: the distinct names it contains, in the dictionary's order. A text is read once, whatever their number."""
    shared, held = spark.sparkContext.broadcast(names), {}

    @F.pandas_udf("array<string>")
    def found(texts):
        import ahocorasick
        import pandas as pd

        words = shared.value
        if "machine" not in held:  # once for all batches of a task
            machine = held["machine"] = ahocorasick.Automaton()
            for i, w in enumerate(words):
                if w:
                    machine.add_word(w, i)
            machine.make_automaton()
        machine, always = held["machine"], [w for w in words if not w]
        hits = (lambda t: sorted({i for _, i in machine.iter(t)})) if len(machine) else (lambda t: ())
        return pd.Series([None if t is None else always + [words[i] for i in hits(t)] for t in texts])

    return found


def parts_of(names: DataFrame, column: str, most: int | None = None):
    """The distinct names, in lists that each make one automaton."""
    listed = names.select(F.col(column).alias("n")).where("n is not null").distinct()
    n, size = listed.agg(F.count("*"), F.sum(F.octet_length("n"))).first()
    parts = max(1, -(-n // (most or PART_NAMES)), -(-(size or 0) // PART_BYTES))
    if parts > 1:
        listed = cut(listed)
    for p in range(parts):  # hashing leaves parts a little over or under their share
        some = listed if parts == 1 else listed.where(F.pmod(F.xxhash64("n"), F.lit(parts)) == p)
        yield parts, sorted(r["n"] for r in some.collect())


def contained(df: DataFrame, text: Column | str, names: DataFrame, column: str = "name", out: str = "mention", most: int | None = None) -> DataFrame:
    """df's rows once for each distinct name of names[column] that the text contains, with the name as `out`.

    Names of any length and number: up to PART_NAMES make one automaton, more are dealt by hash
    into parts that each go over the texts once, one part on the driver at a time. The texts are
    neither shuffled nor compared name by name. most: names of a part. An empty name is in every text, a null one in none.
    """
    found, spark = None, df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default; what the session says holds
        spark.conf.set(key, str(BATCH))
    for parts, some in parts_of(names, column, most):
        one = df.withColumn(out, F.explode(finder(spark, some)(text)))
        one = one if parts == 1 else cut(one)
        found = one if found is None else found.unionByName(one)
    return found


def longest_name(df: DataFrame, text: Column | str, names: DataFrame, out: str = "linked") -> DataFrame:
    """Q9 over a dictionary table names(name, canonical, pos): df with the canonical form of the longest name the text contains, of equals the one with the smallest pos; null if none."""
    best = "__best"
    while best in df.columns:
        best += "_"
    mapped = names.where("name is not null").groupBy("name").agg(F.min_by("canonical", "pos").alias("canonical"), F.min("pos").alias("pos"))
    order = F.struct(F.length("mention").alias("n"), (-F.col("pos")).alias("p"), F.col("canonical").alias("c"))
    tagged = df.withColumn(best, F.monotonically_increasing_id())
    tagged = cut(tagged)
    hits = contained(tagged.select(best, F.col(text).alias("t") if isinstance(text, str) else text.alias("t")), "t", names).select(best, "mention")
    first = hits.join(mapped, hits["mention"] == mapped["name"]).groupBy(best).agg(F.max(order).alias("m"))
    return tagged.join(first.select(best, F.col("m.c").alias(out)), best, "left").drop(best)
