"""All channels as one stream: pulls as they are dropped, a topic's messages, and pushed records.

The three streams are united under one schema, so that one query with one checkpoint ingests them. What a row is, its
channel says; Spark reads only the sources of a channel where a frame is filtered by it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.operators.arrival import arrival
from quayside.sources import all_channels, batch, push, stream
from quayside.sources.batch import BatchSource
from quayside.sources.stream import StreamSource

# Instants are microseconds; lane and position are a path and 0, a partition and an offset, a request and a place in it.
ARRIVED = T.StructType(
    [
        T.StructField("channel", T.StringType()),
        T.StructField("source_system", T.StringType()),
        T.StructField("source_record_id", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("body", T.StringType()),
        T.StructField("instant", T.LongType()),
        T.StructField("lane", T.StringType()),
        T.StructField("position", T.LongType()),
    ]
)

# A pushed record, as the gateway stores it.
PUSHED = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("place", T.LongType()),
        T.StructField("source_system", T.StringType()),
        T.StructField("source_record_id", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Pulls that a micro-batch takes at most; each is one bounded response.
MAX_PULLS = 1_000


def _arrived(rows: DataFrame, channel: str, **columns) -> DataFrame:
    given = {"channel": F.lit(channel), **columns}
    empty = {f.name: F.lit(None) for f in ARRIVED.fields}
    return rows.select(*[({**empty, **given}[f.name]).cast(f.dataType).alias(f.name) for f in ARRIVED.fields])


def dropped_pulls(spark: SparkSession, source: BatchSource, max_files: int = MAX_PULLS, archive: str | None = None) -> DataFrame:
    """New files of a drop folder, one pull each. ``archive``: where Spark moves files that a finished batch has read."""
    reader = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", max_files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    files = reader.text(source.path)
    return _arrived(
        files, batch.CHANNEL, source_system=F.lit(source.source_system), body=F.col("value"),
        instant=F.unix_micros("_metadata.file_modification_time"), lane=F.col("_metadata.file_path"), position=F.lit(0),
    )


def sent_messages(messages: DataFrame, source: StreamSource) -> DataFrame:
    return _arrived(
        messages, stream.CHANNEL, source_system=F.lit(source.source_system), body=F.col("value"),
        instant=F.unix_micros("timestamp"), lane=F.col("partition"), position=F.col("offset"),
    )


def pushed_records(spark: SparkSession, path: str, max_files: int = stream.MAX_FILES) -> DataFrame:
    rows = spark.readStream.schema(PUSHED).option("maxFilesPerTrigger", max_files).parquet(path)
    return _arrived(
        rows, push.CHANNEL, source_system=F.col("source_system"), source_record_id=F.col("source_record_id"),
        fields=F.col("fields"), instant=F.unix_micros("received_at"), lane=F.col("request_id"), position=F.col("place"),
    )


def topic_rows(arrived: DataFrame) -> DataFrame:
    """The messages among what arrived, with the columns of a topic."""
    return arrived.where(F.col("channel") == stream.CHANNEL).select(
        "source_system", F.col("body").alias("value"), F.col("lane").cast("int").alias("partition"),
        F.col("position").alias("offset"), F.timestamp_micros("instant").alias("timestamp"),
    )


def arrived_records(
    arrived: DataFrame, pulls: list[BatchSource], topic: StreamSource, carried: DataFrame | None = None
) -> DataFrame:
    """What arrived in a micro-batch as source records in one arrival order."""
    frames = [
        stream.stream_records(topic_rows(arrived), topic, carried),
        push.well_formed(
            arrived.where(F.col("channel") == push.CHANNEL).withColumn(
                "arrival_seq", arrival(F.col("instant"), F.col("lane"), F.col("position"))
            )
        ),
    ]
    for source in pulls:
        mine = arrived.where((F.col("channel") == batch.CHANNEL) & (F.col("source_system") == source.source_system))
        bodies = mine.select("body", F.col("instant").alias("pulled_at"), F.col("lane").alias("path"))
        frames.append(batch.batch_records(batch.pulled_fields(bodies), source))
    return all_channels(*frames)
