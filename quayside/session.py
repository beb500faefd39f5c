"""Session settings the semantics rely on, and the shared scratch folder for written tables."""

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from quayside.sources.live import remove

# Runtime settings: UTC wall clocks, ANSI errors instead of silent NULLs, adaptive plans. Parsing makes
# wide projections; past 8000 bytes of byte code a generated method is never compiled by HotSpot, so such
# stages are better run as separate operators, whose generated code is split into small methods. Writes
# into many date folders are bound by file operations, so small shuffles keep some parallelism, too.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

_PREPARED: dict[str, SparkSession] = {}


def build_session(app: str = "quayside", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the required settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """A session with the required settings: the given one if it has them, else one of its own beside it.

    A session that somebody else built keeps its settings; the one beside it takes over those that are not
    required here, as they are now.
    """
    if all(spark.conf.get(key, None) == value for key, value in REQUIRED.items()):
        return spark
    key = f"{spark.sparkContext.applicationId}/{id(spark._jsparkSession)}"
    if key not in _PREPARED:
        _PREPARED[key] = spark.newSession()
    own = _PREPARED[key]
    for name, value in {**spark.conf.getAll, **REQUIRED}.items():
        if spark.conf.isModifiable(name) and own.conf.get(name, None) != value:
            own.conf.set(name, value)
    return own


def work_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates: what ``spark.checkpoint.dir`` names, else the warehouse.

    Both are folders that all executors share; nothing is ever written to a machine's own temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the work root; never reused, so a retry cannot see half-written output."""
    return f"{work_root(spark)}/quayside/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that several branches read what was computed once."""
    return _written(df, work_path(df.sparkSession, name))


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Yields a function that is :func:`stored` for tables of one job; they are removed when it is done or has failed.

    Unlike a persisted frame, a table is read without the plan that it came from, and only in the columns asked for.
    """
    root = work_path(spark, name)
    try:
        yield lambda df, table: _written(df, f"{root}/{table}")
    finally:
        remove(spark, root)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
