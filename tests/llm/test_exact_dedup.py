"""Streaming exact dedup against grouping by text."""
import pytest
from pyspark.sql import functions as F

from markscope.llm import exact_dedup as E

ROWS = [(1, "a"), (2, "a"), (3, "b"), (9, "a"), (4, None), (5, ""), (6, "x" * 100_000), (7, "x" * 100_000),
        (8, "x" * 99_999 + "y"), (10, "B"), (11, " b"), (12, "c"), (12, "c"), (None, "d"), (None, "d"), (None, "b")]


@pytest.mark.parametrize("chars", [64, 1, 0])
def test_groups(spark, tmp_path, chars):
    """Digests cut to one character, or to nothing, collide: the byte check has to part them."""
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(*r, "k") for r in ROWS], "doc_id long, text string, digest string").repartition(3).write.parquet(path)
    got = E.deduplicate(spark, path, digest=lambda c: E.sha256(c).substr(1, chars)).collect()
    want = {}
    for i, t in ROWS:
        g = [j for j, u in ROWS if (u or "") == (t or "")]
        want[(i, t or "")] = (max((j for j in g if j is not None), default=None), len(g))
    texts = {(r["id"], r["keep_id"], r["group_size"]) for r in got}
    assert len(got) == len(ROWS)
    assert texts == {(i, *v) for (i, _), v in want.items()}
    assert sum(r["kept"] for r in got) == len({t or "" for _, t in ROWS})
    assert all(r["id"] == r["keep_id"] for r in got if r["kept"])


def test_state_goes_on(spark, tmp_path):
    path, ckpt = str(tmp_path / "d"), str(tmp_path / "c")
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1).write.parquet(path)
    E.update_state(spark, path, ckpt)
    spark.createDataFrame([(3, "a")], "doc_id long, text string").write.mode("append").parquet(path)
    E.update_state(spark, path, ckpt)
    assert sorted((r["keep_id"], r["n"]) for r in E.read_state(spark, ckpt).collect()) == [(2, 1), (3, 2)]


def test_single_file_table(spark):
    """sf0.01 keeps a table in one file, not in a folder."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {tuple(r) for r in E.op9_exact_dedup_stream(spark, sf).collect()}
    g = docs.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    want = {tuple(r) for r in docs.join(g, "text").select("doc_id", "keep_id", "n", F.expr("doc_id = keep_id"), F.sha2(F.col("text").cast("binary"), 256)).collect()}
    assert got == want


def test_empty_and_keep_one(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    empty.write.parquet(str(tmp_path / "e"))
    assert E.deduplicate(spark, str(tmp_path / "e")).count() == 0
    assert E.keep_one(empty).count() == 0
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "doc_id long, text string, file int")
    kept = E.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({t or "" for _, t in ROWS})
    assert kept.filter(F.col("text") == "a").collect()[0]["doc_id"] == 9
