"""Timestamp parsing: ISO 8601 first, then a list of further layouts. Offsets become UTC."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed format: a full date, optionally a time of day, optionally a zone. Guards the lenient cast,
# which would otherwise take a bare year for a date.
ISO_PATTERN = (
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
    r"(?:[T ][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?: ?(?:Z|[+-][0-9]{2}:?[0-9]{2}))?)?\z"
)

# Fixed formats tried in order after ISO: invariant month-first dates and slashed year-first dates.
EXTRA_LAYOUTS = (
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "yyyy/M/d H:mm:ss",
    "yyyy/M/d H:mm",
    "yyyy/M/d",
)

# Fixed format: RFC 1123 with its English weekday, which Spark's formatter cannot read.
RFC1123_PATTERN = r"^[A-Za-z]{3}, (?=[0-9]{2} [A-Za-z]{3} [0-9]{4} )"
RFC1123_LAYOUT = "dd MMM yyyy HH:mm:ss z"


def parse_timestamp(text: Column, extra_layouts: Sequence[str] = EXTRA_LAYOUTS) -> Column:
    """Stripped text -> UTC timestamp, or NULL when no layout fits. Without a zone, UTC is meant."""
    slashed = F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in extra_layouts])
    rfc = F.try_to_timestamp(F.regexp_replace(text, RFC1123_PATTERN, ""), F.lit(RFC1123_LAYOUT))
    return (
        F.when(text.rlike(ISO_PATTERN), text.try_cast("timestamp"))
        .when(F.contains(text, F.lit("/")), slashed)
        .when(text.rlike(RFC1123_PATTERN), rfc)
    )


def wire_time(ts: Column) -> Column:
    """UTC timestamp as ISO text with microseconds and an explicit zero offset."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
