"""Landing events as Parquet partitioned by UTC trade date."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.contract import LANDED, LANDED_COLUMNS, pascal
from quayside.sinks.generations import by_folder, compact_batches
from quayside.sources.live import children, exists, remove
from quayside.sources.landed import LANDED_FILE, batch_folder, read_bronze, read_or_empty


def landed_rows(accepted: DataFrame) -> DataFrame:
    """The flat 17-column projection, in contract order and types."""
    types = {f.name: f.dataType for f in LANDED.fields}
    return accepted.select(*[F.col(c).cast(types[c]).alias(c) for c in LANDED_COLUMNS])


def file_rows(accepted: DataFrame) -> DataFrame:
    """The landed projection under its file names, plus the partition column ``dt``."""
    rows = landed_rows(accepted)
    return rows.select(*[F.col(c).alias(pascal(c)) for c in LANDED_COLUMNS], F.to_date("occurred_at_utc").alias("dt"))


def write_landing(
    accepted: DataFrame,
    root: str,
    batch_id: int | None = None,
    max_records_per_file: int = 5_000_000,
) -> None:
    """Write accepted events below ``root`` as ``[batch_id=n/]dt=YYYY-MM-DD``.

    With a ``batch_id`` the folder of that batch is replaced as a whole, so running a batch again leaves one
    copy, whatever an earlier attempt left behind. Without one the write appends, and nothing is written if there
    is nothing to append. ``rebalance`` brings the
    rows of a date together for few, large files and lets adaptive execution cut a date that is too big for
    one task; sorting by port and product makes row-group statistics selective.
    """
    shaped = file_rows(accepted).hint("rebalance", "dt").sortWithinPartitions("dt", "Port", "Product")
    writer = shaped.write.partitionBy("dt").option("compression", "zstd").option("maxRecordsPerFile", max_records_per_file)
    if batch_id is None:
        # Whether there is anything is seen from what was written; asking first would compute all rows twice.
        known = exists(accepted.sparkSession, root)
        writer.mode("append").parquet(root)
        if not known and not any(name.startswith("dt=") for name in children(accepted.sparkSession, root)):
            remove(accepted.sparkSession, root)
    else:
        writer.mode("overwrite").parquet(batch_folder(root, batch_id))


def append_if_absent(incoming: DataFrame, landed: DataFrame, order: str = "arrival_seq") -> DataFrame:
    """Rows of ``incoming`` whose event id has not landed; of several with one id, the first.

    Landed ids take part as arrivals before all others, in one window that keeps a row per id and task.
    """
    present = landed.select("event_id", F.lit(True).alias("is_landed"))
    both = incoming.withColumn("is_landed", F.lit(False)).unionByName(present, allowMissingColumns=True)
    first = Window.partitionBy("event_id").orderBy(F.desc("is_landed"), order)
    ranked = both.withColumn("arrival_rank", F.row_number().over(first))
    return ranked.where("arrival_rank = 1 AND NOT is_landed").drop("arrival_rank", "is_landed")


def _by_date(rows: DataFrame) -> DataFrame:
    return rows.hint("rebalance", "dt").sortWithinPartitions("dt", "Port", "Product")


def _is_marked(spark: SparkSession, marker: str) -> bool:
    return not read_or_empty(spark, T.StructType().add("done", T.BooleanType()), marker).isEmpty()


def _mark(spark: SparkSession, marker: str) -> None:
    spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(marker)


def compact(spark: SparkSession, root: str, staging: str, first_date: str, last_date: str) -> None:
    """Rewrite the dates between the two bounds (inclusive) of an appended dataset into few files.

    The dates must be closed: nothing is appended to them meanwhile. Spark cannot overwrite what it is
    reading, so the dates go to ``staging`` first and replace the originals from there, whole partitions at a
    time. A run that died is repeated with the same ``staging``: once that is marked as complete it is never
    built again, for the originals may be half replaced by then.
    """
    if not _is_marked(spark, f"{staging}/_complete"):
        bounds = [F.lit(d).cast("date") for d in (first_date, last_date)]
        chosen = read_bronze(spark, root).where(F.col("dt").between(*bounds))
        _by_date(chosen).write.mode("overwrite").option("compression", "zstd").partitionBy("dt").parquet(f"{staging}/rows")
        _mark(spark, f"{staging}/_complete")
    staged = read_bronze(spark, f"{staging}/rows")
    writer = _by_date(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("compression", "zstd").partitionBy("dt").parquet(root)


def compact_landing(spark: SparkSession, root: str, upto: int) -> None:
    """Compact the closed micro-batches of a landing dataset up to one of them."""
    compact_batches(spark, root, upto, LANDED_FILE, by_folder("dt", "Port", "Product"))
