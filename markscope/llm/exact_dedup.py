"""Exact deduplication as a stream with disk-backed keyed state.

The documents are read as a file stream.  Its state, kept by RocksDB and checkpointed to the
shared folder, has one row per digest and never expires: the digest, the stable identifier of the
row that stays, that row's content locator (file and row number) and the number of rows.  A later run with the same
checkpoint goes on where the last one ended.

After the stream has caught up, the state is read as a table.  A digest that was hit more than once
is only a claim: the full bytes of its rows are compared with the bytes at the locator, and rows that
differ are grouped again by their text.  DataFrame operations only.

A large group of copies is one state row; map-side partial aggregation folds it before the
shuffle, and the join that compares bytes can be split by AQE.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markscope.llm.common import shared_path, written

BATCH_BYTES = 256 << 30

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: no disk set aside ahead of use
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _state_conf(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _located(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], text: bool) -> DataFrame:
    cols = [F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"),
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    return docs.select(*cols, *([F.coalesce(F.col(text_col), F.lit("")).alias("text")] if text else []))


def update_state(spark: SparkSession, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text",
                 digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES) -> None:
    """Take all files below ``path`` that the checkpoint has not seen into the state."""
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")
    # as a pattern the path may be one file, which a stream does not take by its plain name
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(f"{path[:-1]}[{path[-1]}]")
    held = (_located(stream, id_col, text_col, digest, False).groupBy("digest")
            .agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n")))
    with _state_conf(spark):
        (held.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(digest, keep_id, file, row, n)``: the state as of the last batch."""
    state = spark.read.format("statestore").load(checkpoint)
    value = state.schema["value"].dataType.names
    keep, n = (F.col(f"value.`{x}`") for x in value[-2:])
    return state.select(F.col("key.digest").alias("digest"), keep["id"].alias("keep_id"), keep["file"].alias("file"),
                        keep["row"].alias("row"), n.alias("n"))


def deduplicate(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None) -> DataFrame:
    """One row per row of the Parquet table at ``path``: ``(id, digest, file, row, keep_id, group_size, kept)``.

    Of equal texts the row with the largest id stays (of equal ids the last by file and row number; a null id
    comes before all others), exactly one of each group.  Null and empty texts are equal.  Other columns are
    ignored; an empty table gives no rows.
    """
    checkpoint = checkpoint or shared_path(spark, "dedup-state")
    docs = spark.read.parquet(path)
    if docs.isEmpty():  # a stream without a batch has no state to read
        return _located(docs, id_col, text_col, digest, False).selectExpr(
            "*", "id as keep_id", "0L as group_size", "true as kept")
    update_state(spark, path, checkpoint, id_col, text_col, digest)
    with _state_conf(spark):
        state = written(read_state(spark, checkpoint), "dedup-digests")
    hits = state.filter("n > 1").select(F.col("digest").alias("d"), F.col("file").alias("f"), F.col("row").alias("r"))
    # full bytes of the rows whose digest was hit, with those at the locator
    held = written(_located(docs, id_col, text_col, digest, True).join(hits, F.col("digest") == F.col("d"))
                   .select("id", "digest", "file", "row", "text", (F.expr("file = f and row = r")).alias("first")), "dedup-hits")
    first = held.filter("first").select(F.col("digest").alias("d"), F.col("text").alias("first_text"))
    other = written(held.join(first, F.expr("digest = d and not first")).filter("text <> first_text")
                    .drop("d", "first", "first_text"), "dedup-collisions")

    every = _located(docs, id_col, text_col, digest, False)
    st = state.select(F.col("digest").alias("d"), "keep_id", F.col("file").alias("f"), F.col("row").alias("r"), "n")
    out = every.join(st, F.col("digest") == F.col("d")).select(
        "id", "digest", "file", "row", "keep_id", F.col("n").alias("group_size"), F.expr("file = f and row = r").alias("kept"))
    if other.isEmpty():
        return out
    # equal digests, different bytes: these rows form groups by their own text
    own = other.groupBy("digest", "text").agg(F.max(F.struct("id", "file", "row")).alias("k"), F.count(F.lit(1)).alias("n2"))
    fixed = (other.join(own.withColumnsRenamed({"digest": "d2", "text": "t2"}), F.expr("digest = d2 and text = t2"))
             .select(F.col("file").alias("f2"), F.col("row").alias("r2"), F.col("k.id").alias("k2"), "n2",
                     F.expr("file = k.file and row = k.row").alias("kept2")))
    less = other.groupBy(F.col("digest").alias("d3")).agg(F.count(F.lit(1)).alias("n3"))
    return (out.join(fixed, F.expr("file = f2 and row = r2"), "left").join(less, F.col("digest") == F.col("d3"), "left")
            .select("id", "digest", "file", "row", F.expr("if(n2 is null, keep_id, k2)").alias("keep_id"),
                    F.expr("coalesce(n2, group_size - coalesce(n3, 0))").alias("group_size"),
                    F.coalesce("kept2", "kept").alias("kept")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are (written to the shared folder first)."""
    spark = docs.sparkSession
    path = shared_path(spark, "dedup-input")
    docs.write.parquet(path)
    gone = deduplicate(spark, path, id_col, text_col).filter(~F.col("kept")).select(
        F.col("file").alias("__file"), F.col("row").alias("__row"))
    copy = spark.read.schema(docs.schema).parquet(path)
    return copy.join(gone, (copy["_metadata.file_path"] == gone["__file"]) & (copy["_metadata.row_index"] == gone["__row"]), "left_anti")


def op9_exact_dedup_stream(spark, sf_dir: str) -> DataFrame:
    """Registered query: every document with the id that stays, its group's size and its digest."""
    out = deduplicate(spark, f"{sf_dir}/documents.parquet")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
