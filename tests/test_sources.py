"""Typed tables and document folders."""

import datetime
import decimal
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import folders, relational

ENGINE = "jdbc:derby:memory:tessera"


def test_rows_that_do_not_fit(spark):
    df = spark.createDataFrame([("1", "p", "18", "60", "12.50"), ("x", "p", "1", "2", "3"), ("2", None, "1", "2", "3"), ("3", "p", None, "9", "1"), ("4", "p", "1", "2", None)], "ID string, product_name string, min_age string, max_age string, premium_yearly string")
    good, bad = relational.conform(df.withColumn("reason", F.lit("old")).withColumn("extra", F.lit(1)), "rate_table")
    assert good.schema.simpleString() == relational.schema_of("rate_table").simpleString()
    assert [(r.id, r.min_age, r.premium_yearly, r.is_active) for r in good.collect()] == [(1, 18, decimal.Decimal("12.50"), None)]
    assert sorted((r.ID, r.reason_) for r in bad.collect()) == [("2", "product_name: missing"), ("3", "min_age: missing"), ("4", "premium_yearly: missing"), ("x", "id: not a int")]
    assert all(len(relational.schema_of(t)) >= 6 for t in relational.TABLES)


def test_typed_files(spark, tmp_path):
    spark.createDataFrame([(1, "s", "r", "x" * 50)], "id int, session_id string, reason string, other string").write.parquet(str(tmp_path / "t"))
    df = relational.read_files_typed(spark, str(tmp_path / "t"), "handoff_requests")
    assert [f.dataType for f in df.schema] == [f.dataType for f in relational.schema_of("handoff_requests")] and "other" not in df.columns
    assert df.first()[:3] == (1, "s", "r")


def test_jdbc(spark):
    jvm = spark._jvm
    try:
        con = jvm.java.sql.DriverManager.getConnection(f"{ENGINE};create=true")
    except Exception as e:
        pytest.skip(f"no embedded database: {e}")
    st = con.createStatement()
    st.executeUpdate("create table claim_records (id int not null, report_no varchar(50) not null, user_id varchar(50), status varchar(20), stage varchar(50), submitted_at date, estimated_days int, need_materials varchar(99), remarks varchar(99), is_valid boolean, synced_at timestamp)")
    for i in range(40):
        st.executeUpdate(f"insert into claim_records (id, report_no, user_id, status, submitted_at, is_valid) values ({i}, 'r{i}', 'u{i % 3}', 'open', date('2024-01-{1 + i % 28:02d}'), {'true' if i % 4 else 'false'})")
    df = relational.read_jdbc(spark, ENGINE, "claim_records", by="id", parts=4)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 40
    assert [f.dataType for f in df.schema] == [f.dataType for f in relational.schema_of("claim_records")]
    some = df.where("is_valid and user_id = 'u1' and id >= 10").select("report_no", "submitted_at")
    assert "GreaterThanOrEqual(ID,10)" in some._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.report_no for r in some.collect()) == sorted(f"r{i}" for i in range(10, 40) if i % 4 and i % 3 == 1)
    assert df.where("id = 1").first().submitted_at == datetime.date(2024, 1, 2)
    with pytest.raises(ValueError, match="lacks"):
        relational.read_jdbc(spark, ENGINE, "claim_records", "id int, nothing string")


@pytest.fixture
def root(tmp_path):
    for i in range(12):
        put(tmp_path / "in", f"ins{i % 3}", f"prod{i % 2}", f"f{i}.txt", f"text {i}", 1000 + i)
    put(tmp_path / "in", "ins0", "prod0", ".hidden", "no", 1)
    return tmp_path / "in"


def put(root, insurer, product, name, text, at):
    folder = root / insurer / product
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    os.utime(folder / name, (at, at))


def test_folders_are_read_in_part(spark, root, monkeypatch):
    every = folders.read_folder(spark, str(root))
    assert sorted((r.file_name, r.content.decode(), r.insurer, r["product"], r.size) for r in every.collect()) == sorted((f"f{i}.txt", f"text {i}", f"ins{i % 3}", f"prod{i % 2}", len(f"text {i}")) for i in range(12))
    (root / "ins1" / "prod1").chmod(0o755)
    some = every.where("insurer = 'ins1' and product in ('prod0') and size > 6")
    assert sorted(r.file_name for r in some.collect()) == ["f10.txt"]
    reader = folders.FolderReader(str(root))
    left = list(reader.pushFilters([folders.EqualTo(("insurer",), "ins1"), folders.In(("product",), ("prod0",)), folders.EqualTo(("size",), 6)]))
    assert len(left) == 1 and sorted(f[1].rsplit("/", 1)[1] for p in reader.partitions() for f in p.files) == ["f10.txt", "f4.txt"]
    monkeypatch.setattr(folders, "PARTITION_BYTES", 13)
    assert [len(p.files) for p in folders.FolderReader(str(root)).partitions()] == [2] * 6
    assert folders.read_folder(spark, str(root / "none")).count() == 0


def test_stream_goes_on_where_it_stopped(spark, root, tmp_path):
    def run():
        q = folders.stream_folder(spark, str(root)).select("file_name", "content").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        q.awaitTermination()
        return sorted(r.file_name for r in spark.read.schema("file_name string, content binary").parquet(str(tmp_path / "out")).collect())

    assert run() == sorted(f"f{i}.txt" for i in range(12))
    put(root, "ins9", "prod0", "later.txt", "later", 5000)
    assert run() == sorted([f"f{i}.txt" for i in range(12)] + ["later.txt"])
    assert len(run()) == 13
