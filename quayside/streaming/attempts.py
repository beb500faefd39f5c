"""Attempts of micro-batches, and the records that no attempt gets through.

A batch whose sink fails is delivered again. Every delivery is noted beside the checkpoint, so that attempts are counted
over restarts. The last one that a batch is given looks for the records that it fails on: it halves the batch by the
records' hashes and evaluates each half, without writing, until single records are left. They become dead letters, and
the rest of the batch goes through. A batch in which no record fails alone is not what is broken; its error is raised.
"""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.contract import MAX_DELIVERIES
from quayside.operators.deadletter import RECORD_COLUMNS
from quayside.functions import business_key
from quayside.sources.landed import batch_folder
from quayside.sources.live import children

# What the bus calls it, too.
EXCEEDED = "MaxDeliveryCountExceeded"
# More failing records than this are a fault of the code or of the sink, and the batch's error is raised.
MOST_POISON = 1_000
SLOTS = 1 << 32


def attempts_folder(root: str, batch_id: int) -> str:
    return f"{batch_folder(f'{root}/attempts', batch_id)}"


def note_attempt(spark: SparkSession, root: str, batch_id: int) -> int:
    """Note a delivery of a batch; returns which one it is, from 1."""
    folder = attempts_folder(root, batch_id)
    number = 1 + sum(name.startswith("attempt=") for name in children(spark, folder))
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{folder}/attempt={number}")
    return number


def _slot() -> Column:
    """Where a record is halved: equal for equal records only, or nearly so."""
    return F.shiftrightunsigned(F.xxhash64("source_system", "source_record_id", "arrival_seq"), 32)


def evaluate(rows: DataFrame) -> None:
    """Compute every column of a frame and keep nothing."""
    rows.write.format("noop").mode("overwrite").save()


def failing_slots(records: DataFrame, probe: Callable[[DataFrame], None]) -> list[int]:
    """Slots of the records that ``probe`` fails on, each alone.

    Each failing record costs two probes per halving, of halves that get smaller; nothing but numbers is collected.
    """
    placed = records.withColumn("slot", _slot())
    found: list[int] = []
    ranges = [(0, SLOTS)]
    while ranges:
        low, high = ranges.pop()
        part = placed.where((F.col("slot") >= low) & (F.col("slot") < high))
        try:
            probe(part.drop("slot"))
            continue
        except Exception:
            slots = [r.slot for r in part.select("slot").distinct().limit(2).collect()]
            if not slots:
                raise
            if len(slots) == 1:
                found.append(slots[0])
                if len(found) > MOST_POISON:
                    raise
                continue
        middle = (low + high) // 2
        ranges += [(low, middle), (middle, high)]
    return found


def guarded(sink: Callable, probe: Callable[[DataFrame], None], most: int = MAX_DELIVERIES) -> Callable:
    """A sink (records, batch_id, store, now) that sets failing records aside on the last attempt of a batch.

    ``probe`` evaluates records as the sink does, without writing.
    """

    def run(records: DataFrame, batch_id: int, store, now: datetime | None = None) -> None:
        spark = records.sparkSession
        number = note_attempt(spark, store.root, batch_id)
        try:
            sink(records, batch_id, store, now)
            return
        except Exception as error:
            if number < most:
                raise
            slots = failing_slots(records, probe)
            if not slots:
                raise
            said = str(error).splitlines()[0][:500]
        poison = F.col("slot").isin(slots)
        placed = records.withColumn("slot", _slot())
        sink(placed.where(~poison).drop("slot"), batch_id, store, now)
        letters = placed.where(poison).select(
            F.struct(*RECORD_COLUMNS).alias("record"), F.lit(EXCEEDED).alias("reason"), F.lit(said).alias("detail"),
            (F.lit(now.isoformat()).cast("timestamp") if now else F.current_timestamp()).alias("dead_lettered_at_utc"),
            business_key(F.col("source_system"), F.col("source_record_id")).alias("correlation_id"),
        )
        # The sink has replaced the batch's letters; these are added to them.
        letters.write.mode("append").partitionBy("reason").parquet(batch_folder(store.dead_letters, batch_id))

    return run
