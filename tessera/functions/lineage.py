"""Cutting lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master, as in tests, gets a temporary one where nothing is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return named or sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which goes when the application ends."""
    sc = spark.sparkContext
    base = f"{shared_dir(spark)}/tessera-{sc.applicationId}"
    where = sc._jvm.org.apache.hadoop.fs.Path(base)
    fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
