"""Turn source records into flat trade events, or say why that is impossible."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.contract import ALIASES, EVENT_TYPE, MONEY, SCHEMA_VERSION, camel
from quayside.functions import (
    business_key,
    event_id,
    evaluate_once,
    filled_only,
    first_present,
    is_blank,
    is_filled,
    parse_timestamp,
    strip,
)
from quayside.functions.numbers import clean_number, is_number, number_text, number_value, packed_number
from quayside.functions.times import EXTRA_LAYOUTS

# The order in which fields are checked: only the first problem of a record is reported.
CHECK_ORDER = (
    "traded_at_utc",
    "trade_reference",
    "vessel_imo",
    "port",
    "product",
    "quantity_mt",
    "price_usd_per_mt",
    "counterparty",
)

PLAIN_TEXT = ("trade_reference", "vessel_imo", "port", "product", "counterparty")
NUMERIC = ("quantity_mt", "price_usd_per_mt")


# Fixed texts: the two problem descriptions a record can be rejected with here.
def _missing(target: str, names: Sequence[str]) -> Column:
    return F.format_string(
        "Record '%s' from '%s' is missing required field '" + camel(target) + "' (accepted aliases: "
        + ", ".join(names) + ").",
        F.col("source_record_id"),
        F.col("source_system"),
    )


def _unreadable(target: str, what: str) -> Column:
    return F.format_string(
        "Field '" + camel(target) + "' on record '%s' is not a " + what + ": '%s'.",
        F.col("source_record_id"),
        F.col(f"raw_{target}"),
    )


def resolve(records: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Add ``raw_<target>``: the untrimmed value of the first filled alias of each target field.

    Nearly always the first alias that is there is filled, too. Only where it is blank are the others looked at, so that
    the usual row needs lookups and no function of the whole map, which Spark would interpret.
    """
    found = records.withColumns({f"raw_{target}": first_present(F.col("fields"), names) for target, names in aliases.items()})

    def filled(raw: Column, names: Sequence[str]) -> Column:
        others = F.filter(F.array(*[F.element_at("fields", F.lit(name)) for name in names]), is_filled)
        return F.when(raw.isNull() | is_filled(raw), raw).otherwise(F.get(others, F.lit(0)))

    return found.withColumns({f"raw_{target}": filled(F.col(f"raw_{target}"), names) for target, names in aliases.items()})


def is_routable(aliases: Mapping[str, Sequence[str]] = ALIASES) -> Column:
    """Whether a record looks like a trade at all: some spelling of the trade reference is filled."""
    return first_present(filled_only(F.col("fields")), aliases["trade_reference"]).isNotNull()


def normalize(
    records: DataFrame,
    ingested_at: Column | None = None,
    aliases: Mapping[str, Sequence[str]] = ALIASES,
    extra_layouts: Sequence[str] = EXTRA_LAYOUTS,
) -> DataFrame:
    """Source records plus the flat event columns, ``dedup_key`` and ``normalization_error``.

    The error is NULL for records that normalize. Input columns other than ``fields`` ride along, so
    a caller can carry a request id or a batch id through. A projection only: no shuffle.
    """
    stamped = F.current_timestamp() if ingested_at is None else ingested_at
    raw = {t: F.col(f"raw_{t}") for t in aliases}

    # Each step reads the columns of the one before, so shared work is done once per row.
    resolved = resolve(records, aliases).withColumns(
        {
            "time_text": strip(raw["traded_at_utc"]),
            "vessel_text": F.replace(F.upper(strip(raw["vessel_imo"])), F.lit("IMO"), F.lit("")),
            **{f"packed_{t}": packed_number(raw[t]) for t in NUMERIC},
        }
    )
    parsed = resolved.withColumns(
        {
            "traded_at_utc": parse_timestamp(F.col("time_text"), extra_layouts),
            **{f"clean_{t}": clean_number(F.col(f"packed_{t}")) for t in NUMERIC},
        }
    ).drop("time_text", *[f"packed_{t}" for t in NUMERIC])
    parsed = parsed.withColumns({f"readable_{t}": is_number(F.col(f"clean_{t}")) for t in NUMERIC})

    problems = []
    for target in CHECK_ORDER:
        problems.append(F.when(raw[target].isNull(), _missing(target, aliases[target])))
        if target == "traded_at_utc":
            problems.append(F.when(F.col(target).isNull(), _unreadable(target, "timestamp")))
        elif target in NUMERIC:
            problems.append(F.when(~F.col(f"readable_{target}"), _unreadable(target, "number")))

    typed = evaluate_once(
        parsed,
        {
            "normalization_error": F.coalesce(*problems),
            "trade_reference": raw["trade_reference"],
            "vessel_imo": strip(F.col("vessel_text")),
            "port": F.upper(strip(raw["port"])),
            "product": F.upper(strip(raw["product"])),
            "counterparty": strip(raw["counterparty"]),
            "traded_at_utc": F.col("traded_at_utc"),
            **{t: number_value(F.col(f"clean_{t}"), F.col(f"readable_{t}")) for t in NUMERIC},
            **{f"clean_{t}": F.col(f"clean_{t}") for t in NUMERIC},
        },
    )
    key = business_key(F.col("source_system"), F.col("source_record_id"))
    enveloped = typed.withColumns(
        {
            "dedup_key": key,
            **derived(key),
            "ingested_at_utc": stamped,
            **{f"{t}_text": number_text(F.col(f"clean_{t}")) for t in NUMERIC},
        }
    )
    return enveloped.drop(
        "vessel_text",
        *[f"raw_{t}" for t in aliases],
        *[f"{step}_{t}" for step in ("clean", "readable") for t in NUMERIC],
    )


def derived(key: Column) -> dict[str, Column]:
    """The columns of an event that follow from its business key and from its other columns."""
    return {
        "event_id": event_id(key),
        "event_type": F.lit(EVENT_TYPE),
        "schema_version": F.lit(SCHEMA_VERSION),
        "occurred_at_utc": F.col("traded_at_utc"),
        "total_usd": total_usd(),
    }


def total_usd() -> Column:
    """Quantity times price, rounded half-even to cents from the exact product."""
    return F.bround(F.col("quantity_mt") * F.col("price_usd_per_mt"), 2).try_cast(MONEY)


def with_record_id(fields: DataFrame, source_system: str, channel: str, id_field: str) -> DataFrame:
    """Flat field maps -> source records; maps without a usable id are left out."""
    record_id = F.element_at(F.col("fields"), F.lit(id_field))
    return fields.where(~is_blank(record_id)).withColumns(
        {
            "source_system": F.lit(source_system),
            "source_record_id": record_id,
            "channel": F.lit(channel),
        }
    )
