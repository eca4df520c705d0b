"""Sinks (K1-K8): Spark writers in place of the reference's locked CSV printers.

Tables that grow by runs (pages, counts, results, redirects) are partitioned by ``batch``:
``mode="append"`` replaces the partition of its own batch only, so a run that is repeated leaves
no double rows; ``mode="overwrite"`` starts afresh.  What is derived from all batches (totals, statistics)
is always rewritten.  Counts and totals are long tables partitioned by metric, so a reader of
one metric prunes all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markscope.operators.measures import RESULT_COLUMNS

CSV_SEP = "£"
COUNTS_SCHEMA = "page_id bigint, key string, subkey string, n bigint, batch int, metric string, is_html5 boolean"
TOTALS_SCHEMA = "key string, subkey string, n bigint, scope string, metric string"


def _writer(df: DataFrame, parts: list[str], mode: str, batch: int | None):
    """A writer that replaces everything (overwrite) or the rows' own batch (append)."""
    if batch is not None:
        df, parts = df.withColumn("batch", F.lit(batch)), ["batch", *parts]
    w = df.write.mode("overwrite" if batch is not None else mode)
    if batch is not None:
        w = w.option("partitionOverwriteMode", "dynamic" if mode == "append" else "static")
    return w.partitionBy(*parts) if parts else w


def next_batch(spark, path: str) -> int:
    """The number of the next run's batch in a table that ``append`` adds to."""
    from pyspark.errors import AnalysisException
    try:
        last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    except AnalysisException:  # no table yet
        return 0
    return 0 if last is None else int(last) + 1


def write_page_results(results: DataFrame, path: str, mode: str = "overwrite", fmt: str = "csv",
                       batch: int | None = None) -> None:
    """K1: the 26 result columns, with the HTML5 twin as partition ``is_html5=true``.

    ``results`` must carry ``is_html5`` (``page_results(..., keep_keys=True)``).
    """
    df = results.select(*RESULT_COLUMNS, F.coalesce("is_html5", F.lit(False)).alias("is_html5"))
    w = _writer(df, ["is_html5"], mode, batch)
    if fmt == "csv":
        w.option("sep", CSV_SEP).option("header", True).csv(path)
    else:
        w.parquet(path)


def write_counts(counts: DataFrame, path: str, mode: str = "overwrite", batch: int | None = None) -> None:
    """K2/K3: per-page counts ``page_id, is_html5, metric, key, subkey, n``.

    Rows are rebalanced by folder first, so a folder gets a few files of even size (a large one is
    split), not one from every task.
    """
    _writer(counts.hint("rebalance", "metric", "is_html5"), ["metric", "is_html5"], mode, batch).parquet(path)


def read_counts(spark, path: str) -> DataFrame:
    """Read a count table back (its schema is given: a run without pages writes no file)."""
    return spark.read.schema(COUNTS_SCHEMA).parquet(path)


def read_totals(spark, path: str) -> DataFrame:
    return spark.read.schema(TOTALS_SCHEMA).parquet(path)


def write_totals(totals: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4/K5: corpus totals in ``scope/metric`` folders, clustered by key.

    Rows are dealt out by range and sorted, so a folder's files hold ranges of keys that don't overlap: a read of one
    key opens the file that holds it (the others by their minimum and maximum are passed over), and a key of very many subkeys
    is spread over several files.
    """
    order = ["scope", "metric", "key", "subkey"]
    (totals.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode(mode).partitionBy("scope", "metric").parquet(path))


def write_sketches(sketches: DataFrame, path: str, mode: str = "overwrite", batch: int | None = None) -> None:
    """a run's sketches ``metric, sketch`` (a few rows of fixed size)."""
    _writer(sketches.coalesce(1), [], mode, batch).parquet(path)


def write_run_stats(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K6: run statistics ``stat, value`` (small: one row per statistic)."""
    stats.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_redirects(redirects: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                    batch: int | None = None) -> None:
    """K8: the redirect map ``target, origin`` (Parquet, or text lines ``target£££origin``)."""
    if fmt == "text":
        redirects.select(F.concat_ws("£££", "target", "origin").alias("value")).write.mode(mode).text(path)
    else:
        _writer(redirects, [], mode, batch).parquet(path)


def read_redirects(spark, path: str) -> DataFrame:
    """The map kept over all runs, one origin per target: that of the latest batch."""
    return (spark.read.schema("target string, origin string, batch int").parquet(path).groupBy("target")
            .agg(F.max_by("origin", F.struct("batch", "origin")).alias("origin")))


def materialize(df: DataFrame, path: str, mode: str = "overwrite", batch: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back (cuts lineage, survives executor loss).

    With ``batch``, the table read back is that batch alone.
    """
    _writer(df, [], mode, batch).parquet(path)
    if batch is None:
        return df.sparkSession.read.schema(df.schema).parquet(path)
    return read_batches(df, path).filter(F.col("batch") == batch).drop("batch")


def read_batches(like: DataFrame, path: str) -> DataFrame:
    """All batches of a table with the columns of ``like``."""
    schema = T.StructType([*(f for f in like.schema.fields if f.name != "batch"), T.StructField("batch", T.IntegerType())])
    return like.sparkSession.read.schema(schema).parquet(path)
