"""Helpers shared by the operators: the shared folder, written tables, shipping the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a local master may run without that setting (as in tests): its tasks share
    the driver's disk.  On a cluster a missing setting raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="markscope-llm-")
        spark.sparkContext.setCheckpointDir(root)    # the setting itself can't be changed in a running session
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark removes the shuffle files of a query when it ends, not when the driver's memory is next cleaned.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    What the write shuffled leaves the disk with it: the table holds all that is read later.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    w = df.write
    if partition_by:
        w = w.partitionBy(partition_by)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        w.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def running_parts(rows: DataFrame, weight: str, bound: int) -> DataFrame:
    """``rows`` (a written table) with a column ``part``: rows near each other share parts of a total ``weight`` of at most ``bound``.

    A row of more than half the bound is a part of its own.  Totals run within a file first, then over the files (a number for each file
    reaches the driver).
    """
    spark = rows.sparkSession
    at = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    half = max(1, bound // 2)
    total, offsets = 0, []
    for r in at.groupBy("__file").agg(F.sum(weight).alias("w")).orderBy("__file").collect():
        offsets.append((r["__file"], total))
        total += r["w"]
    offsets = F.broadcast(spark.createDataFrame(offsets, "__file string, __offset long"))
    before = F.sum(weight).over(Window.partitionBy("__file").orderBy("__row")) - F.col(weight) + F.col("__offset")
    own = F.when(F.col(weight) > half, F.concat_ws(":", "__file", "__row"))
    return at.join(offsets, "__file").withColumn("part", F.coalesce(own, F.floor(before / half).cast("string"))).drop("__file", "__row", "__offset")


#: A key with over this part of a table's rows is hot; fewer than a thousand keys can be.
HOT_PART = 0.001


def hot_join(rows: DataFrame, table: DataFrame, key: str, by: str, name: str) -> DataFrame:
    """``rows`` (a written table) left-joined on ``key = by`` to ``table`` (written, one row per ``by``), however many rows share a key.

    Rows of hot keys meet a broadcast table of those keys and stay where they are; the others are shuffled.  Null keys find nothing.
    """
    most = rows.count() * HOT_PART
    hot = rows.groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    few = F.broadcast(written(table.join(hot, F.col(by) == F.col("__hot")).select(*table.columns), name))
    met = F.col(key) == F.col(by)
    rest = rows.join(few.select(by), met, "left_anti")
    return rows.join(few, met).unionByName(rest.join(table, met, "left"))


def ship(spark: SparkSession) -> None:
    """Give the executors this package, as ``--py-files`` would, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_markscope_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    folder = tempfile.mkdtemp(prefix="markscope-pyfiles-")
    target = os.path.join(folder, "markscope_pyfiles.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.relpath(p, top))
    sc.addPyFile(target)
    sc._markscope_shipped = True


def crc_mod(id_col: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo m (null id: null)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % m


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
