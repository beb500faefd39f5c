"""Short-term message dedupe, the kind a broker does."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quayside.contract import DUPLICATE_WINDOW_MINUTES
from quayside.session import stored
from quayside.sources.landed import batch_folder, read_or_empty

WINDOW = pd.Timedelta(minutes=DUPLICATE_WINDOW_MINUTES)


def kept_after(times: pd.Series, last: pd.Timestamp | None, window: pd.Timedelta) -> tuple[list[int], pd.Timestamp | None]:
    """Positions of the messages to keep, of rising enqueue times, and the time of the last one kept."""
    kept = []
    for position, at in enumerate(times):
        if last is None or at - last > window:
            kept.append(position)
            last = at
    return kept, last


def dedupe_within_window(
    messages: DataFrame, message_id: str = "message_id", enqueued_at: str = "enqueued_at", window: pd.Timedelta = WINDOW,
    lateness: pd.Timedelta = WINDOW,
) -> DataFrame:
    """Drop messages whose id was kept at most ``window`` before.

    The clock is the enqueue time, never the trade time: late trades are welcome. State is one instant per id,
    that of the last message kept, and ends when the watermark has passed its window: it has the ids of the last
    window and of ``lateness``, not of all time. Messages of an id are taken in enqueue order, so the result is the same for one
    micro-batch and for many, as long as batches follow each other in that order, as a queue delivers them. A task
    holds one id's messages of one micro-batch; ``dedupe_batch`` does not, and is for batches of any size.
    """
    state = T.StructType().add("last", T.LongType())

    def dedupe(_: tuple, chunks: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(chunks)).sort_values(enqueued_at, kind="stable")
        last = pd.Timestamp(held.get[0], unit="us") if held.exists else None
        kept, last = kept_after(rows[enqueued_at], last, window)
        if last is not None:
            held.update((last.value // 1000,))
            # One millisecond more, for a message after exactly one window still goes.
            end = (last + window).value // 1_000_000 + 1
            held.setTimeoutTimestamp(max(end, held.getCurrentWatermarkMs() + 1))
        yield rows.iloc[kept]

    timed = messages.withWatermark(enqueued_at, f"{int(lateness.total_seconds())} seconds")
    return timed.groupBy(message_id).applyInPandasWithState(
        dedupe, messages.schema, state, "append", GroupStateTimeout.EventTimeTimeout
    )


def _first_of_chains(rows: DataFrame, window: int) -> DataFrame:
    """Rows (id, at, session), sorted by these, at in microseconds -> the (id, at) to keep, chunk by chunk.

    All that is held of a session is its last kept instant. There is a step per kept message, not per row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, 0
        for batch in batches:
            if not len(batch):
                continue
            ids, at, session = batch.column("id"), batch.column("at").to_numpy(), batch.column("session").to_numpy()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            other = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False) & ~(null[1:] & null[:-1])
            cuts = np.flatnonzero(other | (session[1:] != session[:-1])) + 1
            kept = []
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                times, key = at[start:end], (ids[start].as_py(), int(session[start]))
                position = int(np.searchsorted(times, last + window, side="right")) if key == held else 0
                held = key
                while position < len(times):
                    kept.append(start + position)
                    last = int(times[position])
                    position = int(np.searchsorted(times, last + window, side="right"))
            yield batch.select(["id", "at"]).take(pa.array(kept, pa.int64()))

    return rows.mapInArrow(run, rows.select("id", "at").schema)


def dedupe_batch(
    batch: DataFrame, batch_id: int, out: str, state: str,
    message_id: str = "message_id", enqueued_at: str = "enqueued_at", window: pd.Timedelta = WINDOW,
    lateness: pd.Timedelta = pd.Timedelta(0),
) -> None:
    """Write what ``dedupe_within_window`` keeps of a micro-batch of any size, for ``foreachBatch``.

    * Messages of one id and instant become one before the shuffle. Those within the window of what an earlier
      batch kept are dropped by a join.
    * A message more than a window after the one before it is always kept. So an id is cut into sessions there,
      found from the least and greatest instant of each stretch of a window's length, of which an id has no more than its time
      span allows. Each session is streamed through a task in order.
    * ``out`` has a folder per batch. ``state`` has the last kept instant of the ids of the last window in two folders that take turns,
      so a batch that is delivered again reads what it read before. What is a window and ``lateness`` older than the newest message
      is forgotten: later batches bring nothing that it could still decide.

    A message without an instant is kept if nothing else is known of its id, once in a window of the batches' newest messages.
    """
    spark, length = batch.sparkSession, window.value // 1000
    kept_type = T.StructType([T.StructField("id", batch.schema[message_id].dataType)]).add("last", T.LongType()).add("newest", T.LongType())
    before = read_or_empty(spark, kept_type, f"{state}/{(batch_id - 1) % 2}") if batch_id else spark.createDataFrame([], kept_type)

    distinct = stored(batch.dropDuplicates([message_id, enqueued_at]), "messages")
    rows = distinct.select(F.col(message_id).alias("id"), F.unix_micros(F.col(enqueued_at).cast("timestamp")).alias("at"))
    earlier = before.select(F.col("id").alias("known"), "last", F.lit(True).alias("seen"))
    judged = rows.join(earlier, F.col("id").eqNullSafe(F.col("known")), "left").drop("known")
    after = F.col("last").isNull() | (F.col("at") > F.col("last") + length)
    timed = stored(judged.where(F.col("at").isNotNull() & after).select("id", "at", F.floor(F.col("at") / F.lit(length)).alias("stretch")), "timed")

    stretches = timed.groupBy("id", "stretch").agg(F.min("at").alias("first"), F.max("at").alias("final"))
    of_id = Window.partitionBy("id").orderBy("stretch")
    gap = F.col("first") - F.lag("final").over(of_id)
    stretches = stretches.withColumn("start", F.when(gap.isNull() | (gap > length), F.col("stretch")))
    stretches = stretches.select(F.col("id").alias("of"), F.col("stretch").alias("s"), F.last("start", ignorenulls=True).over(of_id).alias("session"))
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("s"))
    sessions = timed.join(stretches, same).select("id", "at", "session")
    order = ("id", "session", "at")
    kept = _first_of_chains(sessions.repartition("id", "session").sortWithinPartitions(*order), length)

    # Ids of which nothing but messages without an instant is known.
    untimed = rows.groupBy("id").agg(F.max("at").alias("at")).where("at IS NULL").join(earlier, F.col("id").eqNullSafe(F.col("known")), "left")
    kept = stored(kept.unionByName(untimed.where("seen IS NULL").select("id", "at")), "kept")
    chosen = kept.select(F.col("id").alias("kept_id"), F.col("at").alias("kept_at"))
    found = F.col(message_id).eqNullSafe(F.col("kept_id")) & F.unix_micros(F.col(enqueued_at).cast("timestamp")).eqNullSafe(F.col("kept_at"))
    distinct.join(chosen, found, "left_semi").write.mode("overwrite").parquet(batch_folder(out, batch_id))

    newest = rows.select("at").union(before.select("newest")).agg(F.max("at")).first()[0]
    known = before.unionByName(kept.select("id", F.col("at").alias("last"), F.lit(newest).cast("bigint").alias("newest")))
    known = known.groupBy("id").agg(F.max("last").alias("last"), F.max("newest").alias("newest"))
    if newest is not None:
        known = known.where(F.coalesce("last", "newest") >= newest - length - lateness.value // 1000)
    known.write.mode("overwrite").parquet(f"{state}/{batch_id % 2}")
