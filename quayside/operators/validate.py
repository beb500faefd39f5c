"""Data-quality rules over flat trade events. Every rule runs; every failure is reported."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.contract import (
    FUTURE_TOLERANCE_MINUTES,
    KNOWN_PRODUCTS,
    MAX_PRICE_USD_PER_MT,
    MAX_QUANTITY_MT,
    SCHEMA_VERSION,
)
from quayside.functions import imo_is_valid, is_blank

# Fixed pattern: five capital letters (a line feed at the very end does not matter).
LOCODE_PATTERN = r"(?d)^[A-Z]{5}$"


@dataclass(frozen=True)
class Rule:
    """One check. ``fails`` must never be NULL; ``message`` is only evaluated for failing rows."""

    field: str
    code: str
    fails: Column
    message: Column


def _text_of(df: DataFrame, column: str) -> Column:
    """How a number is spelled in a message: as read from the source, else without padding zeros."""
    if f"{column}_text" in df.columns:
        return F.col(f"{column}_text")
    return F.regexp_replace(F.col(column).cast("string"), r"\.?0+$", "")


def _out_of_range(column: str, largest: int) -> Column:
    value = F.col(column)
    return F.coalesce((value <= 0) | (value > largest), F.lit(True))


def trade_rules(df: DataFrame, as_of: Column) -> list[Rule]:
    """The rule set, in reporting order, bound to the columns of ``df``."""
    # Fixed texts: the message of each rule.
    return [
        Rule(
            "schemaVersion",
            "unsupported_schema_version",
            F.coalesce(F.col("schema_version") != SCHEMA_VERSION, F.lit(True)),
            F.format_string(f"Expected schema version {SCHEMA_VERSION}, got %d.", F.col("schema_version")),
        ),
        Rule(
            "tradeReference", "required", is_blank(F.col("trade_reference")), F.lit("Trade reference is empty.")
        ),
        Rule(
            "vesselImo",
            "invalid_imo",
            ~imo_is_valid(F.col("vessel_imo")),
            F.format_string(
                "'%s' is not a valid IMO number (7 digits, last one a check digit).", F.col("vessel_imo")
            ),
        ),
        Rule(
            "port",
            "invalid_locode",
            F.coalesce(~F.col("port").rlike(LOCODE_PATTERN), F.lit(True)),
            F.format_string("'%s' is not a UN/LOCODE (5 letters, for example DKFRC).", F.col("port")),
        ),
        Rule(
            "product",
            "unknown_product",
            F.coalesce(~F.col("product").isin(*KNOWN_PRODUCTS), F.lit(True)),
            F.format_string("'%s' is not one of " + ", ".join(sorted(KNOWN_PRODUCTS)) + ".", F.col("product")),
        ),
        Rule(
            "quantityMt",
            "out_of_range",
            _out_of_range("quantity_mt", MAX_QUANTITY_MT),
            F.format_string(
                f"Quantity must be greater than 0 and at most {MAX_QUANTITY_MT} MT, got %s.",
                _text_of(df, "quantity_mt"),
            ),
        ),
        Rule(
            "priceUsdPerMt",
            "out_of_range",
            _out_of_range("price_usd_per_mt", MAX_PRICE_USD_PER_MT),
            F.format_string(
                f"Price must be greater than 0 and at most {MAX_PRICE_USD_PER_MT} USD/MT, got %s.",
                _text_of(df, "price_usd_per_mt"),
            ),
        ),
        Rule("counterparty", "required", is_blank(F.col("counterparty")), F.lit("Counterparty is empty.")),
        Rule(
            "tradedAtUtc",
            "future_timestamp",
            F.coalesce(
                F.col("traded_at_utc") > as_of + F.expr(f"INTERVAL {FUTURE_TOLERANCE_MINUTES} MINUTES"),
                F.lit(False),
            ),
            F.format_string(
                f"Trade timestamp %s0+00:00 is more than {FUTURE_TOLERANCE_MINUTES} minutes ahead of now.",
                F.date_format(F.col("traded_at_utc"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
            ),
        ),
    ]


def validate(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``failures`` (an array, empty when clean) and ``is_clean``.

    Reports are put together by ``concat``, for which Spark generates code; a function with a lambda, such as
    ``array_compact``, would have all rules interpreted.
    """
    nothing = F.array().cast("array<struct<field:string,code:string,message:string>>")
    reports = [
        F.when(
            r.fails,
            F.array(F.struct(F.lit(r.field).alias("field"), F.lit(r.code).alias("code"), r.message.alias("message"))),
        ).otherwise(nothing)
        for r in rules
    ]
    anything = rules[0].fails
    for r in rules[1:]:
        anything = anything | r.fails
    checked = events.withColumn("is_clean", ~anything)
    failures = F.when(F.col("is_clean"), nothing).otherwise(F.concat(*reports))
    return checked.withColumn("failures", failures).select(*[c for c in events.columns if c not in ("failures", "is_clean")], "failures", "is_clean")


def failure_summary(failures: Column) -> Column:
    return F.array_join(F.transform(failures, lambda f: F.concat(f["field"], F.lit(": "), f["message"])), "; ")


def explode_failures(validated: DataFrame, *identity: str) -> DataFrame:
    """One row per failure, with its position in reporting order."""
    return validated.select(*identity, F.posexplode("failures").alias("ordinal", "failure")).select(
        *identity, "ordinal", "failure.field", "failure.code", "failure.message"
    )


def rule_counts(validated: DataFrame) -> DataFrame:
    """How often each rule failed."""
    return explode_failures(validated).groupBy("field", "code").agg(F.count("*").alias("failures"))
