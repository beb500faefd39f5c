"""The event contract: schemas, constants and the field vocabulary shared by every stage."""

from pyspark.sql import types as T

# --- fixed values: event envelope ------------------------------------------------------------
EVENT_TYPE = "bunker.trade.recorded"
SCHEMA_VERSION = 1
CHANNELS = ("Batch", "Stream", "Api")
OUTCOMES = ("Accepted", "Duplicate", "Rejected", "Failed")

# --- fixed values: reason codes --------------------------------------------------------------
NORMALIZATION_FAILED = "normalization_failed"
VALIDATION_FAILED = "validation_failed"
DUPLICATE = "duplicate"
INVALID_REQUEST = "invalid_request"
BATCH_TOO_LARGE = "batch_too_large"
DESERIALIZATION_FAILED = "deserialization_failed"
EMPTY_PAYLOAD = "empty_payload"
PUBLISH_TRANSIENT = "publish_transient"
PUBLISH_PERMANENT = "publish_permanent"

# --- fixed values: accepted source spellings per target field, highest priority first --------
ALIASES = {
    "trade_reference": ("tradeReference", "trade_reference", "trade_ref", "TradeRef", "deal_id", "dealId"),
    "vessel_imo": ("vesselImo", "vessel_imo", "imo", "IMO", "vessel"),
    "port": ("port", "portCode", "port_code", "locode", "unlocode", "delivery_port"),
    "product": ("product", "grade", "fuel_grade", "fuelGrade", "productCode"),
    "quantity_mt": ("quantityMt", "quantity_mt", "quantity", "qty", "volume_mt", "volumeMt"),
    "price_usd_per_mt": ("priceUsdPerMt", "price_usd_per_mt", "price", "unit_price", "unitPrice"),
    "counterparty": ("counterparty", "counter_party", "supplier", "seller"),
    "traded_at_utc": ("tradedAtUtc", "traded_at_utc", "tradedAt", "traded_at", "timestamp", "trade_date"),
}

# --- fixed values: data-quality limits -------------------------------------------------------
KNOWN_PRODUCTS = ("VLSFO", "HSFO", "LSMGO", "MGO", "ULSFO", "LNG")
MAX_QUANTITY_MT = 20000
MAX_PRICE_USD_PER_MT = 5000
FUTURE_TOLERANCE_MINUTES = 5

# --- fixed values: request and paging limits -------------------------------------------------
MAX_PUSH_BATCH = 500
DEFAULT_PAGE = 50
MAX_PAGE = 500

# --- fixed values: broker settings that shape the data ---------------------------------------
DUPLICATE_WINDOW_MINUTES = 10
MAX_DELIVERIES = 5
MESSAGE_TTL_DAYS = 14
LANDING_TRIGGER = "15 seconds"
DEFAULT_RECORD_ID_FIELD = "sourceRecordId"

# Quantities and prices travel as long-backed decimals: 9 integer and 9 fractional digits cover the
# whole valid range, and the product of two of them still fits a 38-digit decimal exactly.
AMOUNT = "decimal(18,9)"
MONEY = "decimal(18,2)"

# Where a record stands in arrival order, the same for all channels: structs are compared field by field, so no part is
# packed or cut. The instant in microseconds; the partition, the path of the pull or the request; the place there.
ARRIVAL = T.StructType(
    [
        T.StructField("at", T.LongType()),
        T.StructField("lane", T.StringType()),
        T.StructField("position", T.LongType()),
    ]
)

SOURCE_RECORD = T.StructType(
    [
        T.StructField("source_system", T.StringType()),
        T.StructField("source_record_id", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType(), True)),
        # Position in arrival order; must be deterministic.
        T.StructField("arrival_seq", ARRIVAL),
    ]
)

# The flat, landed shape of one event, in contract order.
LANDED_COLUMNS = (
    "event_id",
    "event_type",
    "schema_version",
    "source_system",
    "source_record_id",
    "channel",
    "occurred_at_utc",
    "ingested_at_utc",
    "trade_reference",
    "vessel_imo",
    "port",
    "product",
    "quantity_mt",
    "price_usd_per_mt",
    "total_usd",
    "counterparty",
    "traded_at_utc",
)

LANDED = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("source_system", T.StringType()),
        T.StructField("source_record_id", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("occurred_at_utc", T.TimestampType()),
        T.StructField("ingested_at_utc", T.TimestampType()),
        T.StructField("trade_reference", T.StringType()),
        T.StructField("vessel_imo", T.StringType()),
        T.StructField("port", T.StringType()),
        T.StructField("product", T.StringType()),
        T.StructField("quantity_mt", T.DecimalType(18, 9)),
        T.StructField("price_usd_per_mt", T.DecimalType(18, 9)),
        T.StructField("total_usd", T.DecimalType(18, 2)),
        T.StructField("counterparty", T.StringType()),
        T.StructField("traded_at_utc", T.TimestampType()),
    ]
)

# One row of a stream topic, as the Kafka source delivers it.
MESSAGE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)


def camel(name: str) -> str:
    """snake_case column name -> the camelCase name used on the wire."""
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


def pascal(name: str) -> str:
    """snake_case column name -> the PascalCase name used in landed files."""
    return "".join(part.capitalize() for part in name.split("_"))
