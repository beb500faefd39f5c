"""Scans of landed Parquet."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.contract import LANDED, LANDED_COLUMNS, pascal
from quayside.functions import business_key
from quayside.sources.live import batch_folder, read_live

__all__ = ["LANDED_FILE", "TABLE_NAMES", "batch_folder", "claimed_keys", "read_batches", "read_bronze", "read_landed", "read_or_empty", "snake_columns"]

# File name of every landed column -> its table name.
TABLE_NAMES = {pascal(column): column for column in LANDED_COLUMNS}

# Landed columns under their file names, with the date folder, for scans that must not infer a schema.
LANDED_FILE = T.StructType([T.StructField(pascal(f.name), f.dataType) for f in LANDED.fields]).add("dt", T.DateType())


def snake_columns(df: DataFrame) -> DataFrame:
    """Landed files under their table names. Columns that the contract does not declare keep their names."""
    return df.withColumnsRenamed(TABLE_NAMES)


def read_or_empty(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """A Parquet dataset with a declared schema; one that was never written is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_batches(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """A dataset of micro-batches with its ``batch_id``: its live runs and the batches after them."""
    return read_live(spark, root, schema)


def read_bronze(spark: SparkSession, root: str, batches: bool = False) -> DataFrame:
    """Landed files under their file names, with the folders' columns; an unwritten root reads as empty.

    ``batches``: the root holds micro-batches, and ``batch_id`` is a column. No schema inference, so
    opening the dataset reads no file footers.
    """
    return read_batches(spark, root, LANDED_FILE) if batches else read_or_empty(spark, LANDED_FILE, root)


def read_landed(spark: SparkSession, root: str, batches: bool = False) -> DataFrame:
    """Landed events under their table names."""
    return snake_columns(read_bronze(spark, root, batches))


def claimed_keys(landed: DataFrame) -> DataFrame:
    """Business keys that have landed: the claims later batches must respect."""
    return landed.select(business_key(F.col("source_system"), F.col("source_record_id")).alias("dedup_key"))
