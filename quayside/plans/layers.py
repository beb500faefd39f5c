"""Silver and gold that are kept up to date: changes are merged in, nothing is rebuilt.

Silver is a keyed dataset of versions. A round of bronze adds the newest version of each event that it touches; readers
take the newest of what is stored, and compaction drops versions that were replaced. An event that is withdrawn is a
version that is ``removed``.

Gold is the sum of differences. A round knows what silver had of its events before and has after, and adds the parts of
the latter less those of the former. So an event that moves to another date or port leaves the old one, a date whose
events all vanish is empty, and dates that a round does not touch are neither read nor written.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.contract import LANDED
from quayside.plans.medallion import (
    MEASURES,
    gold_of_parts,
    gold_parts,
    narrowed_events,
    newest_of,
    newest_versions,
    supported_events,
    with_packed_ids,
    with_text_ids,
)
from quayside.sinks.generations import compact_batches
from quayside.sinks.keyindex import ROWS_PER_BUCKET, KeyedStore
from quayside.sources.live import Live, batch_folder, folder_bytes, live_folders, read_live

VERSION = T.StructType(list(LANDED.fields)).add("dt", T.DateType()).add("removed", T.BooleanType())

# Sums of any number of rows of silver.
PART_TYPES = {"n": "bigint", "mt": "decimal(38,3)", "usd": "decimal(38,2)", "price": "decimal(38,4)"}
PART = T.StructType(
    [
        T.StructField("port", T.StringType()),
        T.StructField("product", T.StringType()),
        T.StructField("trade_date", T.DateType()),
        T.StructField("vessel_imo", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("mt", T.DecimalType(38, 3)),
        T.StructField("usd", T.DecimalType(38, 2)),
        T.StructField("price", T.DecimalType(38, 4)),
    ]
)


# Rounds behind the oldest run of so many bytes have about as many ids as Spark broadcasts.
FEW_BYTES = 16 << 20


def _newest(versions: DataFrame) -> DataFrame:
    """Per event id the newest version. At one instant a removal is the newer."""
    return newest_versions(versions.select(*VERSION.fieldNames()), "removed")


def _shown(versions: DataFrame) -> DataFrame:
    return narrowed_events(versions.where("NOT removed").drop("removed"))


@dataclass(frozen=True)
class SilverStore:
    root: str
    rows_per_bucket: int = ROWS_PER_BUCKET

    @property
    def versions(self) -> KeyedStore:
        return KeyedStore(self.root, "event_id", VERSION, self.rows_per_bucket)

    def upsert(self, bronze: DataFrame, batch_id: int, removed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Merge a round of bronze in; returns what silver had of its events before, and has after.

        ``removed`` names events that are withdrawn: ``event_id``, ``ingested_at_utc``. Only versions of events of the
        round are looked up, when the frames returned are used, and in the columns that are used; that has to be
        before a second compaction removes what they read. A round that is run again replaces what it wrote.
        """
        spark = bronze.sparkSession
        came = supported_events(bronze).withColumn("removed", F.lit(False))
        if removed is not None:
            gone = removed.select("event_id", "ingested_at_utc", F.lit(True).alias("removed"))
            came = came.unionByName(gone, allowMissingColumns=True)
        self.versions.add(_newest(came), batch_id)
        fresh = spark.read.schema(VERSION).parquet(batch_folder(self.root, batch_id))
        live = live_folders(spark, self.root)
        if not any(first < batch_id for first in (*live.batches, *(r.first for r in live.runs))):
            return _shown(fresh.where(F.lit(False))), _shown(fresh)
        # Each event is in a round once, so that its ids need no distinct.
        ids = fresh.select("event_id")
        known = self.versions.candidates(ids, batch_id).select(*VERSION.fieldNames()).where("event_id IS NOT NULL")
        if folder_bytes(spark, batch_folder(self.root, batch_id)) <= FEW_BYTES:
            # So few ids are broadcast, and nothing else of what is stored is shuffled.
            known = known.join(ids, "event_id", "left_semi")
        # One shuffle brings together what was and what came, for both results.
        both = known.withColumn("came", F.lit(False)).unionByName(fresh.withColumn("came", F.lit(True)))
        of_event = Window.partitionBy("event_id")
        met = with_packed_ids(both).withColumn("touched", F.bool_or("came").over(of_event)).where("touched")
        before, after = (with_text_ids(newest_of(rows, "removed").drop("came", "touched")) for rows in (met.where("NOT came"), met))
        return _shown(before), _shown(after)

    def read(self, spark: SparkSession) -> DataFrame:
        """Silver as it is now.

        The oldest run holds most rows, each event once. While little is newer, rows whose event is in nothing newer
        pass as they are; the ids of what is newer are the build side, and only their events meet in a window. When
        these are too many to broadcast, two joins would shuffle the run twice, and one window over all does it once.
        """
        live = live_folders(spark, self.root)
        newer = read_live(spark, self.root, VERSION, Live(live.runs[1:], live.upto, live.batches))
        if not live.runs:
            return _shown(_newest(newer))
        oldest = read_live(spark, self.root, VERSION, Live(live.runs[:1], live.upto, ()))
        size = sum(r.bytes for r in live.runs[1:])
        if size + sum(folder_bytes(spark, batch_folder(self.root, b)) for b in live.batches) > FEW_BYTES:
            return _shown(_newest(newer.unionByName(oldest)))
        touched = newer.select("event_id").distinct()
        met = _newest(newer.unionByName(oldest.join(touched, "event_id", "left_semi")))
        alone = oldest.join(touched, "event_id", "left_anti").select(*VERSION.fieldNames())
        return _shown(alone.unionByName(met))

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Merge closed rounds; of an event's versions that meet, the newest stays, a removal, too."""

        def merge(versions: DataFrame) -> DataFrame:
            return newest_of(versions, "removed", within=("bucket", "part"))

        self.versions.compact(spark, upto, merge)


CELL = ("port", "product", "trade_date", "vessel_imo")


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of silver before and after a change -> what to add to gold's parts."""
    signed = gold_parts(new).unionByName(gold_parts(old).withColumns({c: -F.col(c) for c in MEASURES}))
    return _sums(signed)


def _sums(parts: DataFrame) -> DataFrame:
    summed = parts.groupBy(*CELL).agg(*[F.sum(c).cast(PART_TYPES[c]).alias(c) for c in MEASURES])
    return summed.where(" OR ".join(f"{c} <> 0" for c in MEASURES))


def _written(parts: DataFrame, folder: str) -> None:
    parts.write.mode("overwrite").option("compression", "zstd").parquet(folder)


@dataclass(frozen=True)
class GoldStore:
    root: str

    def apply(self, old: DataFrame, new: DataFrame, batch_id: int) -> None:
        """Take rows of silver out and others in, as one round."""
        _written(difference(old, new), batch_folder(self.root, batch_id))

    def replace_dates(self, silver_rows: DataFrame, batch_id: int, first_date: str, last_date: str) -> None:
        """Bring the parts of the trade dates between two bounds (inclusive) to what silver has there, be it nothing."""
        bounds = [F.lit(d).cast("date") for d in (first_date, last_date)]
        now = gold_parts(silver_rows.where(F.col("trade_date").between(*bounds)))
        known = read_live(silver_rows.sparkSession, self.root, PART, before=batch_id).drop("batch_id")
        known = known.where(F.col("trade_date").between(*bounds)).withColumns({c: -F.col(c) for c in MEASURES})
        _written(_sums(now.unionByName(known)), batch_folder(self.root, batch_id))

    def parts(self, spark: SparkSession) -> DataFrame:
        return read_live(spark, self.root, PART).drop("batch_id")

    def read(self, spark: SparkSession) -> DataFrame:
        return gold_of_parts(self.parts(spark))

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Add closed rounds up; parts that came to nothing are dropped."""

        def write(rows: DataFrame, folder: str) -> None:
            first = rows.agg(F.min("batch_id")).first()[0] or 0
            # A round has each cell once: there is little to add up before the shuffle, and sums are wider than parts.
            summed = _sums(rows.select(*PART.fieldNames()).repartition(*CELL))
            _written(summed.withColumn("batch_id", F.lit(first).cast("bigint")), folder)

        compact_batches(spark, self.root, upto, PART, write)
