"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "markscope", settings: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the library is tuned for.

    On a cluster the master and most settings come from spark-submit; only the
    ones left unset here are filled in.  AQE stays on so that shuffle partition
    counts are coalesced at run time and skewed joins are split.  ``settings`` adds to them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # one parquet split per 64 MB keeps a task's html within executor memory
        "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
        # a crawl keeps one page per WARC file: count each file as ~1 MB, not 4 MB,
        # so about 60 small files share a task instead of 15
        "spark.sql.files.openCostInBytes": str(1024 * 1024),
    }
    if master and master.startswith("local"):
        # local mode runs every task in the driver JVM; its default 1 GB heap thrashes
        conf["spark.driver.memory"] = "8g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in {**conf, **(settings or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextlib.contextmanager
def java_charsets_allowed(spark: SparkSession):
    """Within it, ``encode`` in a plan that is built takes every charset of the JVM and replaces what a charset lacks.

    Both settings are read when an expression is analysed, so plans built inside keep them and the session gets its own back.
    """
    names = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "true")
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


@functools.cache
def java_charsets() -> tuple[str, ...]:
    """Lower-case names and aliases of the charsets that the JVM can encode."""
    from pyspark import SparkContext
    jvm = SparkContext._active_spark_context._jvm
    names = set()
    for cs in jvm.java.nio.charset.Charset.availableCharsets().values():
        if cs.canEncode():
            names.add(cs.name().lower())
            names.update(a.lower() for a in cs.aliases())
    return tuple(sorted(names))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (the cluster names it).  Only with a local master, as in
    tests, may it be unset: then a scratch folder is created and registered.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect has no SparkContext on the client
        sc = None
    if not path and sc is not None:
        path = sc.getCheckpointDir()
    if not path:
        if sc is None or not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="markscope-ckpt-")
        sc.setCheckpointDir(path)    # the setting itself can't be changed in a running session
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint root for one job's outputs."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


_EXPR_CACHE: dict = {}
_EXPR_APP: list = [None]


def cached_expr(key, build):
    """Build a Column expression once per SparkContext and reuse it.

    Large rule expressions cost thousands of Py4J calls to assemble; the result is
    a plain expression tree that any DataFrame of the same context can reuse.
    """
    from pyspark import SparkContext
    app = SparkContext._active_spark_context.applicationId
    if _EXPR_APP[0] != app:  # handles of a stopped context are dead
        _EXPR_CACHE.clear()
        _EXPR_APP[0] = app
    if key not in _EXPR_CACHE:
        _EXPR_CACHE[key] = build()
    return _EXPR_CACHE[key]


__all__ = ["build_session", "cached_expr", "checkpoint_root", "java_charsets", "java_charsets_allowed", "scratch_path"]
