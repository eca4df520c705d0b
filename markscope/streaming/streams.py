"""Incremental runs with Structured Streaming.

The reference processes N files per run, prints the last name and resumes after
it next time.  Here a file source with ``maxFilesPerTrigger`` and a checkpoint
does the bookkeeping: ``trigger(availableNow=True)`` processes what is new in
bounded batches and stops; the next run resumes after the last committed file.

* T2 ``append_page_counts``: per-page counts of each batch appended to a Parquet
  table, partitioned by batch id and written with dynamic partition overwrite,
  so a replayed batch replaces its own partition (idempotent).
* T1 ``page_stream`` over page tables, ``warc_stream`` over WARC text files.
* T3 ``running_totals``: every batch leaves its totals of all metrics by (scope, metric, key,
  subkey), one row per distinct key, as a run; ``FAN`` runs of a level are merged into one of the next, so a
  read touches few of them however many batches there were.
* T4 ``dedupe_urls``: the smallest page of each URL, kept in disk-backed keyed state (RocksDB).  Without a crawl time the
  state of seen URLs is never dropped, as in the reference; with one, a watermark drops it.

Checkpoints and outputs live under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markscope.operators import facts, measures, redirects, rollup
from markscope.session import scratch_path
from markscope.sources import warc
from markscope.sources.pages import normalize_pages

FAN = 4
#: Most bytes of files in a batch.
BATCH_BYTES = 8 << 30
#: State on disk: changes are written per batch instead of whole snapshots, and files grow as they fill.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def page_stream(spark: SparkSession, directory: str, glob: str = "*.parquet",
                max_files: int | None = None, max_bytes: int = BATCH_BYTES) -> DataFrame:
    """A stream of page tables (``page_id, url, html``) from a directory, in batches of bounded size."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(directory).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader.option("maxBytesPerTrigger", max_bytes)
    return normalize_pages(reader.parquet(directory))


def warc_stream(spark: SparkSession, directory: str, glob: str = "*", max_files: int | None = None, max_bytes: int = BATCH_BYTES) -> DataFrame:
    """A stream of the pages in WARC files, without redirect records; a later run takes only files that are new."""
    records = warc.parse_records(warc.read_warc_records(spark, directory, glob, True, max_files, max_bytes))
    return redirects.page_input(redirects.drop_redirect_records(records))


def append_page_counts(pages_stream: DataFrame, out_path: str, checkpoint: str):
    """Per-page counts (markup and messages) of every batch, appended idempotently.

    A page lies inside one batch, so the per-page lint aggregation runs as a plain
    batch job on each micro-batch: no streaming state is kept for it.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        events = rollup.count_events(measures.with_status(facts.parse_pages(batch)))
        counts = rollup.page_counts(events).withColumn("batch_id", F.lit(batch_id))
        (counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out_path))

    return (pages_stream.writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def append_run(totals: DataFrame, out_path: str, batch_id: int) -> None:
    """Add a batch's totals as the run ``lo = hi = batch_id``, then merge full levels.

    A run covers batches ``lo`` to ``hi`` and is written as one folder that appears at once (dynamic partition overwrite moves it into
    place when the job is done).  Merging adds a wider run and touches no other; readers take the widest run that covers a batch.  So the
    move of that folder is the switch: a crash before it leaves the old runs in use, after it the new one, and a batch that is run
    again replaces its own run only, with the same rows.
    """
    def put(df: DataFrame, lo: int, hi: int) -> None:
        (df.withColumn("lo", F.lit(lo).cast("long")).withColumn("hi", F.lit(hi).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("lo", "hi").parquet(out_path))

    spark = totals.sparkSession
    put(totals, batch_id, batch_id)
    width = FAN
    while (batch_id + 1) % width == 0:
        lo = batch_id + 1 - width
        put(_merged(spark, out_path, [r for r in live_runs(spark, out_path) if lo <= r[0]]), lo, batch_id)
        width *= FAN


def live_runs(spark: SparkSession, out_path: str) -> list[tuple[int, int]]:
    """The runs that readers use: ``(lo, hi)`` of those that no wider run covers (from folder names; no file is read)."""
    import re
    found = {tuple(map(int, m.groups())) for f in spark.read.parquet(out_path).inputFiles() if (m := re.search(r"/lo=(\d+)/hi=(\d+)/", f))}
    live: list[tuple[int, int]] = []
    for lo, hi in sorted(found, key=lambda r: (r[0], -r[1])):
        if not live or hi > live[-1][1]:
            live.append((lo, hi))
    return live


def _merged(spark: SparkSession, out_path: str, runs: list[tuple[int, int]]) -> DataFrame:
    wanted = F.struct("lo", "hi").isin([F.struct(F.lit(lo).cast("long"), F.lit(hi).cast("long")) for lo, hi in runs])
    rows = spark.read.schema(f"{TOTALS_SCHEMA}, lo long, hi long").option("basePath", out_path).parquet(
        *[f"{out_path}/lo={lo}/hi={hi}" for lo, hi in runs]).filter(wanted)
    return rows.groupBy("scope", "metric", "key", "subkey").agg(F.sum("n").cast("bigint").alias("n"))


TOTALS_SCHEMA = "scope string, metric string, key string, subkey string, n long"


def running_totals(pages_stream: DataFrame, out_path: str, checkpoint: str):
    """The totals of all metrics so far, kept in runs that are merged level by level; see ``append_run``."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        append_run(rollup.totals(rollup.count_events(measures.with_status(facts.parse_pages(batch)))), out_path, batch_id)

    return (pages_stream.writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_totals(spark: SparkSession, out_path: str) -> DataFrame:
    """The totals so far: the live runs merged (F16)."""
    return _merged(spark, out_path, live_runs(spark, out_path))


def dedupe_urls(pages_stream: DataFrame, out_path: str, checkpoint: str, crawl_time: str | None = None, within: str = "30 days",
                delay: str = "1 day"):
    """One page per URL, the first by ``(warc, page_id)`` whatever the order of arrival; read it with ``read_winners``.

    The state (RocksDB, so it may be larger than memory) holds a row for each URL; a batch leaves the winners that it changed in a
    partition of its own.  Pages without a URL share one.  With ``crawl_time`` (a timestamp column of the stream) a URL has a winner
    for each period of ``within``; the state of a period goes when the watermark has passed its end by ``delay``.
    """
    spark = pages_stream.sparkSession
    key = [F.col("url")]
    rows = pages_stream
    if crawl_time is not None:
        rows = rows.withWatermark(crawl_time, delay)
        key.append(F.window(crawl_time, within).alias("period"))
    best = rows.groupBy(*key).agg(F.min(F.struct("warc", "page_id")).alias("first"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        period = [F.col("period.start").alias("period")] if crawl_time is not None else []
        (batch.select("url", *period, "first.warc", "first.page_id", F.lit(batch_id).alias("batch_id")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_path))

    # the query takes a copy of the settings when it starts: the caller's session stays as it is
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        return (best.writeStream.foreachBatch(write_batch).outputMode("update").option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_winners(spark: SparkSession, out_path: str) -> DataFrame:
    """The winner of each URL (and period) so far; winners only become smaller, so the smallest is the last."""
    rows = spark.read.parquet(out_path)
    keys = [c for c in ("url", "period") if c in rows.columns]
    first = rows.groupBy(*keys).agg(F.min(F.struct("warc", "page_id")).alias("first"))
    return first.select("first.page_id", *keys)


def run_to_end(spark: SparkSession, starter, stream: DataFrame, name: str) -> str:
    """Run a stream to the end of the available input; return its output path."""
    base = scratch_path(spark, name)
    out, ckpt = f"{base}/out", f"{base}/checkpoint"
    q = starter(stream, out, ckpt)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return out
