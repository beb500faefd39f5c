"""Outcome of every record: Accepted, Duplicate, Rejected or Failed.

Records of one business key are taken in arrival order. The first record that is valid and reaches the
output claims the key; valid records after it are duplicates. Rejected and failed records leave the key
free. Keys claimed earlier (``claims``) count as arrivals before everything else.

Skew. A business key may own a large share of all rows, so no task may have to see all rows of a key:

* :func:`first_valid` filters ``row_number() = 1``, for which Spark keeps one row per key per map task
  before the shuffle.
* :func:`classify` keeps the duplicates. Each key's first arrival is a minimum, combined before the shuffle,
  and comes back to the rows over a join. One side has one row per key, so adaptive execution can split
  a hot key on the other. Rejected rows take no part in either.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.contract import DUPLICATE, NORMALIZATION_FAILED, VALIDATION_FAILED
from quayside.functions.identity import packed_id, unpacked_id
from quayside.operators.normalize import derived, normalize
from quayside.operators.validate import failure_summary, trade_rules, validate
from quayside.session import stored


def parse(records: DataFrame, as_of: Column, ingested_at: Column | None = None, rules=trade_rules) -> DataFrame:
    """Normalize and validate; ``is_valid`` is true for records that may claim their key."""
    events = normalize(records, as_of if ingested_at is None else ingested_at)
    checked = validate(events, rules(events, as_of))
    return checked.withColumn("is_valid", F.col("normalization_error").isNull() & F.col("is_clean"))


def _publishable(parsed: DataFrame) -> Column:
    """Valid records that reached the output: those without a publish error, where one is recorded."""
    ok = F.col("is_valid")
    return ok & F.col("publish_error").isNull() if "publish_error" in parsed.columns else ok


def claims_for(parsed: DataFrame, history: DataFrame) -> DataFrame:
    """The keys of ``history`` that matter for this batch.

    The batch keys are the build side of the semi join, so while the batch is small enough for Spark's
    size-checked broadcast, the much larger history is scanned and filtered without being shuffled.
    """
    wanted = parsed.where("is_valid").select("dedup_key").distinct()
    return history.select("dedup_key").join(wanted, "dedup_key", "left_semi")


def first_valid(parsed: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """The accepted records: one per business key not claimed before. Event ids are shuffled as bytes."""
    marked = parsed.where(_publishable(parsed)).withColumn("is_claim", F.lit(False))
    if claims is not None:
        earlier = claims.select("dedup_key", F.lit(True).alias("is_claim"))
        marked = marked.unionByName(earlier, allowMissingColumns=True)
    has_id = "event_id" in marked.columns
    if has_id:
        marked = marked.withColumn("event_id", packed_id(F.col("event_id")))
    arrival = Window.partitionBy("dedup_key").orderBy(F.desc("is_claim"), "arrival_seq")
    first = (
        marked.withColumn("arrival_rank", F.row_number().over(arrival))
        .where("arrival_rank = 1 AND NOT is_claim")
        .drop("arrival_rank", "is_claim")
    )
    return first.withColumn("event_id", unpacked_id(F.col("event_id"))) if has_id else first


def first_valid_events(parsed: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """:func:`first_valid` of records as ``parse`` leaves them.

    What follows from other columns of an event is left out of sorting and shuffling, and made for accepted records only.
    """
    made = derived(F.col("dedup_key"))
    return first_valid(parsed.drop(*made), claims).withColumns(made)


def first_arrivals(parsed: DataFrame, claims: DataFrame | None = None, order: str = "arrival_seq") -> DataFrame:
    """Per business key: the first publishable arrival (``first_seq``) and whether it was ``claimed`` before."""
    sent = parsed.where(_publishable(parsed)).select("dedup_key", F.col(order).alias("seq"), F.lit(False).alias("claim"))
    if claims is not None:
        earlier = claims.select("dedup_key", F.lit(None).cast(parsed.schema[order].dataType).alias("seq"), F.lit(True).alias("claim"))
        sent = sent.unionByName(earlier)
    return sent.groupBy("dedup_key").agg(F.min("seq").alias("first_seq"), F.bool_or("claim").alias("claimed"))


# Columns that outcome, reason and detail are made of; beside them ``publish_error``, where there is one.
DECIDING = ("dedup_key", "arrival_seq", "is_valid", "normalization_error", "failures")


def classify(parsed: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Parsed records plus ``outcome``, ``reason`` and ``detail``, one output row per input row.

    Parsed records are written once and read by each branch; select what is wanted, and ``DECIDING``, before.
    """
    return classify_stored(stored(parsed, "parsed"), claims)


def classify_stored(rows: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """:func:`classify` for parsed records that lie in files already, read by nothing but a scan.

    Of arrivals at one position the place in the files decides, so that one of them wins.
    """
    columns = rows.columns
    place = F.struct("arrival_seq", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = rows.withColumn("place", place)
    firsts = first_arrivals(rows, claims, "place")
    valid = rows.where("is_valid").join(firsts, "dedup_key", "left")

    claimed = F.coalesce("claimed", F.lit(False))
    has_error = "publish_error" in columns
    failed = F.col("publish_error").isNotNull() if has_error else F.lit(False)
    wins = ~failed & ~claimed & F.col("place").eqNullSafe(F.col("first_seq"))
    undelivered = failed & ~claimed & (F.col("first_seq").isNull() | (F.col("place") < F.col("first_seq")))
    outcome = F.when(wins, "Accepted").when(undelivered, "Failed").otherwise("Duplicate")
    decided = valid.withColumn("outcome", outcome).withColumns(
        {
            "reason": F.when(F.col("outcome") == "Duplicate", DUPLICATE).when(
                F.col("outcome") == "Failed", F.col("publish_error") if has_error else F.lit(None)
            ),
            # Fixed text: how a duplicate is described.
            "detail": F.when(
                F.col("outcome") == "Duplicate",
                F.format_string("Business key '%s' has already been ingested.", F.col("dedup_key")),
            ),
        }
    )
    shown = [*columns, "outcome", "reason", "detail"]
    return decided.select(*shown).unionByName(rejected(rows).select(*shown))


def rejection_reason() -> Column:
    return F.when(F.col("normalization_error").isNotNull(), NORMALIZATION_FAILED).when(
        ~F.col("is_valid"), VALIDATION_FAILED
    )


def rejection_detail() -> Column:
    return F.when(F.col("normalization_error").isNotNull(), F.col("normalization_error")).when(
        ~F.col("is_valid"), failure_summary(F.col("failures"))
    )


def rejected(parsed: DataFrame) -> DataFrame:
    """The rejected records with ``outcome``, ``reason`` and ``detail``; needs no shuffle."""
    return parsed.where(~F.col("is_valid")).withColumns(
        {"outcome": F.lit("Rejected"), "reason": rejection_reason(), "detail": rejection_detail()}
    )
