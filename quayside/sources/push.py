"""Pushed batches: requests holding many records each."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.contract import BATCH_TOO_LARGE, INVALID_REQUEST, MAX_PUSH_BATCH
from quayside.functions import is_blank
from quayside.operators.arrival import arrival

CHANNEL = "Api"


def request_arrival(received_at: Column, request_id: Column, position: Column) -> Column:
    """``arrival_seq`` of a pushed record: when its request came in, and its place there."""
    return arrival(F.unix_micros(received_at), request_id, position)


def admit(requests: DataFrame, records: DataFrame, max_records: int = MAX_PUSH_BATCH) -> DataFrame:
    """One verdict per request: ``admitted``, ``invalid_request`` (empty) or ``batch_too_large``.

    ``requests`` lists the request ids; ``records`` holds their records. Counting combines on the map
    side, so one huge request costs one row per map task in the shuffle.
    """
    sizes = records.groupBy("request_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return requests.join(sizes, "request_id", "left").select(
        "request_id",
        n.alias("records"),
        # Fixed texts: why a request is refused as a whole.
        F.when(n == 0, INVALID_REQUEST).when(n > max_records, BATCH_TOO_LARGE).otherwise("admitted").alias("verdict"),
        F.when(n == 0, "The batch is empty.")
        .when(n > max_records, F.format_string(f"A batch may contain at most {max_records} records, got %d.", n))
        .alias("detail"),
    )


def admitted_records(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The records of admitted requests.

    A refused request may hold any share of all rows. Verdicts have one row per request, so adaptive
    execution can split such a request on the side of the records.
    """
    admitted = verdicts.where(F.col("verdict") == "admitted").select("request_id")
    return records.join(admitted, "request_id", "left_semi").select(*records.columns)


def guard(records: DataFrame) -> DataFrame:
    """Structural checks in order; ``request_error`` is NULL for well-formed records.

    Malformed records are reported to the caller as rejected with ``invalid_request``. They never enter
    the pipeline, so they are neither dead-lettered nor counted as outcomes there.
    """
    # Fixed texts: the three structural complaints.
    return records.withColumn(
        "request_error",
        F.when(is_blank(F.col("source_system")), "sourceSystem is required.")
        .when(is_blank(F.col("source_record_id")), "sourceRecordId is required.")
        .when(
            F.col("fields").isNull() | (F.size("fields") <= 0), "fields is required and must not be empty."
        ),
    )


def well_formed(records: DataFrame) -> DataFrame:
    return guard(records).where(F.col("request_error").isNull()).drop("request_error").withColumn(
        "channel", F.lit(CHANNEL)
    )


def request_summary(requested: DataFrame, outcome_totals: DataFrame) -> DataFrame:
    """Per-request answer: outcome counts, with malformed records among the rejected.

    ``requested`` are guarded records (with ``request_error``), ``outcome_totals`` the pipeline's counts
    per ``request_id``.
    """
    malformed = requested.groupBy("request_id").agg(
        F.count_if(F.col("request_error").isNotNull()).alias("malformed")
    )
    none = F.lit(0).cast("bigint")
    return malformed.join(outcome_totals, "request_id", "left").select(
        "request_id",
        F.coalesce("accepted", none).alias("accepted"),
        F.coalesce("duplicate", none).alias("duplicate"),
        (F.coalesce("rejected", none) + F.col("malformed")).alias("rejected"),
        F.coalesce("failed", none).alias("failed"),
    )
