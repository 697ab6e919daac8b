"""Relational tables with explicit types, from files or over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns and types of a deployment's tables; NOT NULL where a row cannot do without.
TABLES = {
    "documents": "doc_id STRING NOT NULL, insurer STRING NOT NULL, product_name STRING NOT NULL, product_code STRING NOT NULL, doc_type STRING, file_name STRING, file_md5 STRING, version STRING, page_count INT, raw_text STRING, is_active BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP",
    "document_chunks": "chunk_id STRING NOT NULL, doc_id STRING NOT NULL, text STRING NOT NULL, chunk_type STRING, parent_id STRING, chunk_index INT, clause_type STRING, is_valid BOOLEAN, created_at TIMESTAMP",
    "faq_questions": "id INT NOT NULL, question STRING NOT NULL, normalized_question STRING NOT NULL, answer STRING NOT NULL, category STRING, frequency INT, is_active BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP",
    "products": "product_code STRING NOT NULL, product_name STRING NOT NULL, insurer STRING NOT NULL, category STRING, is_active BOOLEAN, description STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "policy_cache": "id INT NOT NULL, user_id STRING NOT NULL, policy_no_masked STRING, insurer STRING NOT NULL, product_name STRING NOT NULL, status STRING, sum_insured DECIMAL(12,2), premium DECIMAL(10,2), effective_date DATE, expire_date DATE, is_valid BOOLEAN, synced_at TIMESTAMP",
    "rate_table": "id INT NOT NULL, product_name STRING NOT NULL, min_age INT NOT NULL, max_age INT NOT NULL, sum_insured STRING, premium_yearly DECIMAL(10,2) NOT NULL, premium_monthly DECIMAL(10,2), payment_methods STRING, is_active BOOLEAN, created_at TIMESTAMP",
    "claim_records": "id INT NOT NULL, report_no STRING NOT NULL, user_id STRING, status STRING, stage STRING, submitted_at DATE, estimated_days INT, need_materials STRING, remarks STRING, is_valid BOOLEAN, synced_at TIMESTAMP",
    "handoff_requests": "id INT NOT NULL, session_id STRING, reason STRING, status STRING, summary STRING, created_at TIMESTAMP",
}


def schema_of(name_or_ddl: str) -> StructType:
    return StructType.fromDDL(TABLES.get(name_or_ddl, name_or_ddl))


def conform(df: DataFrame, name_or_ddl: str) -> tuple[DataFrame, DataFrame]:
    """(rows in the schema's types, rows that do not fit with why).

    Columns are met by name, whatever their case; ones that df lacks are null, others are left
    out. A row does not fit if a value is lost in its cast or a NOT NULL column is null; the
    reason names the first such column.
    """
    schema, here = schema_of(name_or_ddl), {c.lower(): c for c in df.columns}
    value = lambda f: F.col("`" + here[f.name.lower()].replace("`", "``") + "`") if f.name.lower() in here else F.lit(None)
    typed = {f.name: value(f).try_cast(f.dataType) for f in schema.fields}
    faults = []
    for f in schema.fields:
        if f.name.lower() in here:
            faults.append(F.when(value(f).isNotNull() & typed[f.name].isNull(), F.lit(f"{f.name}: not a {f.dataType.simpleString()}")))
        if not f.nullable:
            faults.append(F.when(typed[f.name].isNull(), F.lit(f"{f.name}: missing")))
    reason = F.coalesce(*faults, F.lit(None).cast("string")) if faults else F.lit(None).cast("string")
    why = "reason"
    while why.lower() in here:
        why += "_"
    judged = df.withColumn(why, reason)
    good = judged.where(F.col(why).isNull()).select(*[typed[f.name].alias(f.name) for f in schema.fields])
    return good, judged.where(F.col(why).isNotNull())


def read_files_typed(spark: SparkSession, path: str, name_or_ddl: str) -> DataFrame:
    """Parquet files as a typed table; columns that are not in the schema are never read."""
    return spark.read.schema(schema_of(name_or_ddl)).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, name_or_ddl: str | None = None, by: str | None = None, parts: int = 8, options: dict | None = None) -> DataFrame:
    """A table of a database, typed; filters and columns are pushed down.

    by: a numeric or date column whose range is split into `parts` reads, each by a task of its
    own; its ends are asked for first. Rows where it is null come with the first. Without by, one task reads the table.
    """
    ddl = schema_of(name_or_ddl or table)
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    if by:
        lo, hi = reader.load().agg(F.min(by), F.max(by)).first()
        if lo is not None:
            reader = reader.option("partitionColumn", by).option("lowerBound", str(lo)).option("upperBound", str(hi)).option("numPartitions", parts)
    raw = reader.load()
    here = {c.lower(): c for c in raw.columns}
    missing = [f.name for f in ddl.fields if f.name.lower() not in here]
    if missing:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    return raw.select(*[F.col(f"`{here[f.name.lower()]}`").cast(f.dataType).alias(f.name) for f in ddl.fields])
