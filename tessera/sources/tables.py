"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import rules
from tessera.operators.ingest import infer_doc_type


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One relational table; timestamps without zone are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, k in df.dtypes if k == "timestamp_ntz"})


def read_files(spark: SparkSession, path: str, meta: DataFrame | None = None, name: str = "([^/]+)$", types=rules.DOC_TYPES, default: str = rules.DOC_TYPE_DEFAULT) -> DataFrame:
    """Files under path as documents: file_name, file_content, received_at, doc_type, and the columns of meta(file_name, ...).

    name: the pattern whose first group is the file's name in its path. Missing paths are
    dropped; a file without metadata keeps nulls.
    """
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true").load(path)
    docs = files.select(
        F.regexp_extract("path", name, 1).alias("file_name"), F.col("content").alias("file_content"), F.col("modificationTime").alias("received_at")
    ).withColumn("doc_type", infer_doc_type(F.col("file_name"), types, default))
    return docs if meta is None else docs.join(meta, "file_name", "left")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {text, label}."""
    return spark.read.schema("text string, label string").option("multiLine", True).json(path)


def handoff_rows(df: DataFrame, now=None) -> DataFrame:
    """Tickets (session_id, reason, summary) with status pending."""
    return df.select("session_id", "reason", F.lit("pending").alias("status"), "summary", (F.current_timestamp() if now is None else now).alias("created_at"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def result_cache_rows(df: DataFrame, least_complexity: int = 2) -> DataFrame:
    """The last written answer for each key, from runs complex enough, answered, and not themselves cache hits."""
    from pyspark.sql import Window

    worth = df.where((F.col("complexity") >= least_complexity) & (F.length("answer") > 0) & ~F.col("cache_hit"))
    last = Window.partitionBy("key").orderBy(F.desc("written_at"), F.desc("answer"))
    kept = worth.withColumn("nth", F.row_number().over(last)).where("nth = 1")
    return kept.select("key", F.to_json(F.struct("answer", "intent")).alias("value"), "written_at")
