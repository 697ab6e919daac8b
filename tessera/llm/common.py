"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master, as in tests, gets a temporary one where nothing is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def session_folder(spark: SparkSession) -> str:
    """The application's own part of the shared folder, which goes when the application ends."""
    sc = spark.sparkContext
    base = f"{shared_dir(spark)}/tessera-{sc.applicationId}"
    where = sc._jvm.org.apache.hadoop.fs.Path(base)
    fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return base


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of a shared file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def own(df: DataFrame) -> list[Column]:
    """df's columns as they are, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def text_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Bounds what a Python worker and its executor hold of long texts at once, unless the session says how many rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(rows))


def text_of() -> Column:
    """The text as a string; null is empty."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def cut(df: DataFrame) -> DataFrame:
    """Materialises df once in the shared folder; lost executors then reread instead of recomputing."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """Like cut, but as a Parquet table, which packs wide or repetitive rows tighter and prunes columns."""
    path = f"{session_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table carries; a null text is empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of().alias("text"),
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, label), label the smallest node reachable.

    Alternates large-star and small-star rewiring (each a shuffle of the edges, which never
    grow in number) until the edge set stands still, however many rounds that takes. Only linked
    nodes appear. Hot nodes are met by map-side minima and by joins that adaptive execution can
    split. Null ends and loops are left out; repeated edges count once.
    """
    e = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )

    def state(x: DataFrame):
        return x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(e)
    while before[0]:
        sym = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        e = cut(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        after = state(e)
        if after == before:
            break
        before = after
    nodes = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return nodes.unionByName(roots.join(nodes, "node", "left_anti"))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of results that nothing refers to any more.

    Twice with a pause: the first round frees what holds the plans, the second the shuffles.
    """
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
