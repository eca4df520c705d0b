"""The join that keeps hot keys' rows where they are; what a written table leaves on disk."""
import glob
import time

import pytest

from markscope.llm import common as C


@pytest.mark.parametrize("part", [0.001, 0.2, 1.0])
def test_hot_join_equals_a_left_join(spark, monkeypatch, part):
    monkeypatch.setattr(C, "HOT_PART", part)
    rows = C.written(spark.createDataFrame([(i, 7 if i % 2 else (None if i % 10 == 0 else i % 30)) for i in range(400)], "id long, key long").repartition(5), "t-rows")
    table = C.written(spark.createDataFrame([(k, f"v{k}") for k in range(0, 30, 3)] + [(7, None), (99, "none")], "by long, value string"), "t-table")
    want = rows.join(table, rows["key"] == table["by"], "left").collect()
    got = C.hot_join(rows, table, "key", "by", "t-hot")
    assert got.columns == ["id", "key", "by", "value"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want))


def test_hot_join_of_empty_tables(spark):
    rows = C.written(spark.createDataFrame([], "id long, key long"), "t-rows")
    table = C.written(spark.createDataFrame([], "by long"), "t-table")
    assert C.hot_join(rows, table, "key", "by", "t-hot").count() == 0
    some = C.written(spark.createDataFrame([(1, 2), (3, None)], "id long, key long"), "t-rows")
    assert {(r["id"], r["by"]) for r in C.hot_join(some, table, "key", "by", "t-hot").collect()} == {(1, None), (3, None)}


def test_a_written_table_leaves_no_shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    shuffled = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, setting = shuffled(), spark.conf.get(C._CLEANUP)
    kept = spark.range(1000).repartition(7, "id").groupBy("id").count()
    table = C.written(kept, "t-shuffled")
    end = time.time() + 20          # files are removed in the background
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(C._CLEANUP) == setting
    assert table.count() == 1000
