"""The table that commits: whole versions or none."""

import pytest
from pyspark.sql import functions as F

from tessera.sources.store import Conflict, Store, append_chunks, delete, invalidate, upsert


def rows(spark, *data):
    return spark.createDataFrame(list(data), "doc_id long, version string, raw_text string")


def read(store, version=None):
    return sorted(map(tuple, store.read(version).collect()), key=str)


def test_failed_commit_leaves_the_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        store.read()
    assert append_chunks(store, rows(spark, (1, "1", "a"), (2, "1", None)), "one") == 1
    broken = rows(spark, (3, "1", "c")).withColumn("raw_text", F.expr("raise_error('disk gone')").cast("string"))
    with pytest.raises(Exception, match="disk gone"):
        append_chunks(store, broken, "two")
    assert store.versions() == [1] and read(store) == [(1, "1", "a"), (2, "1", None)]
    assert append_chunks(store, rows(spark, (3, "1", "c")), "two") == 2
    assert append_chunks(store, rows(spark, (3, "1", "c")), "two") == 2  # the same batch again
    assert len(read(store)) == 3 and read(store, 1) == [(1, "1", "a"), (2, "1", None)]
    assert store.vacuum(keep=2) == 1 and len(read(store, 1)) == 2  # what the failed commit left


def test_upsert_and_delete_by_lists(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    upsert(store, rows(spark, (1, "1", "a"), (2, "1", "b"), (None, "1", "n")), "one")
    upsert(store, rows(spark, (2, "2", "changed"), (3, "2", "x" * 20_000)), "two")
    assert read(store) == sorted([(1, "1", "a"), (2, "2", "b"), (3, "2", "x" * 10_000), (None, "1", "n")], key=str)
    delete(store, rows(spark, (1, "", ""), (None, "", "")).select("doc_id"), "gone")  # a null key equals a null
    assert [r[0] for r in read(store)] == [2, 3]
    append_chunks(store, rows(spark, (1, "5", "again")), "back")  # committed after the list, so it shows
    assert [r[0] for r in read(store)] == [1, 2, 3]
    before = read(store)
    store.compact("whole")
    assert read(store) == before and not store.state()["gone"]
    assert store.vacuum() > 0 and read(store) == before


def test_invalidation_writes_only_what_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    data = spark.createDataFrame([(i, "ins", f"p{i % 3}", "1", True) for i in range(9)], "doc_id long, insurer string, product_code string, version string, is_valid boolean")
    append_chunks(store, data, "one")
    invalidate(store, data.where("product_code = 'p1'").withColumn("version", F.lit("2")), "two")
    assert sorted((r.doc_id, r.is_valid) for r in store.read().collect()) == [(i, i % 3 != 1) for i in range(9)]
    assert spark.read.parquet(f"{tmp_path}/t/rows/{store.state()['rows'][-1]}").count() == 3


def test_the_second_of_two_writers_gives_way(spark, tmp_path):
    store, other = Store(spark, str(tmp_path / "t")), Store(spark, str(tmp_path / "t"))
    append_chunks(store, rows(spark, (1, "1", "a")), "one")
    seen = store.state()
    append_chunks(other, rows(spark, (2, "1", "b")), "two")
    with pytest.raises(Conflict):
        store.commit("three", add=rows(spark, (1, "2", "a")), remove=rows(spark, (1, "", "")).select("doc_id"), seen=seen)
    assert not store._claim(2, {}) and len(read(store)) == 2
    assert append_chunks(store, rows(spark, (4, "1", "d")), "four") == 3  # an append goes after whatever came
