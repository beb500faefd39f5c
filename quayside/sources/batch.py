"""Batch pulls: files holding what a source system returned, a JSON array of flat string objects."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quayside.contract import DEFAULT_RECORD_ID_FIELD
from quayside.functions import is_blank, string_maps
from quayside.functions.jsonmap import JSON_OPTIONS
from quayside.operators.arrival import arrival
from quayside.operators.normalize import with_record_id

CHANNEL = "Batch"


@dataclass(frozen=True)
class BatchSource:
    """One source system: where its pulls arrive and which field holds its record id."""

    source_system: str
    path: str = ""
    record_id_field: str = DEFAULT_RECORD_ID_FIELD
    enabled: bool = True


def read_pulls(spark: SparkSession, source: BatchSource) -> DataFrame:
    """Files of a drop folder, one pull each, as rows of ``body``, ``pulled_at`` (microseconds) and ``path``.

    A pull is one bounded response of a source system, so a file is read as a whole; many pulls spread
    over many tasks.
    """
    return spark.read.text(source.path, wholetext=True).select(
        F.col("value").alias("body"),
        F.unix_micros("_metadata.file_modification_time").alias("pulled_at"),
        F.col("_metadata.file_path").alias("path"),
    )


def pulled_fields(pulls: DataFrame) -> DataFrame:
    """Pull bodies -> one row per element: ``fields`` and ``arrival_seq``, by time, path and place in the pull.

    Elements that are not flat string objects are left out one by one; the rest of the pull is kept.
    """
    array = F.from_json("body", "array<map<string,variant>>", JSON_OPTIONS)
    elements = pulls.select("pulled_at", "path", F.posexplode(array).alias("position", "element"))
    return (
        string_maps(elements, "element", "fields")
        .where(F.col("fields").isNotNull())
        .select("fields", arrival(F.col("pulled_at"), F.col("path"), F.col("position")).alias("arrival_seq"))
    )


def missing_id(fields: Column, id_field: str) -> Column:
    return is_blank(F.element_at(fields, F.lit(id_field)))


def batch_records(
    fields: DataFrame, source: BatchSource, skipped: Observation | None = None
) -> DataFrame:
    """Field maps of one source -> source records.

    Elements without a usable id are skipped, neither counted as outcomes nor dead-lettered; pass an
    ``Observation`` to learn how many.
    """
    if skipped is not None:
        without = missing_id(F.col("fields"), source.record_id_field)
        fields = fields.observe(skipped, F.count("*").alias("pulled"), F.count_if(without).alias("skipped"))
    return with_record_id(fields, source.source_system, CHANNEL, source.record_id_field)


def read_batch_sources(spark: SparkSession, sources: list[BatchSource]) -> DataFrame:
    """Source records of every enabled source."""
    from quayside.sources import all_channels

    frames = []
    for source in sources:
        if source.enabled:
            frames.append(batch_records(pulled_fields(read_pulls(spark, source)), source))
    if not frames:
        raise ValueError("no batch source is enabled")
    return all_channels(*frames)
