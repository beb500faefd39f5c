"""Reading landed events: filters, ordering, pages."""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.contract import DEFAULT_PAGE, MAX_PAGE


@dataclass(frozen=True)
class EventQuery:
    """Optional filters and paging. Bounds are UTC and inclusive on both sides.

    ``after`` is the time and event id of the last event seen; the page goes on from there. It is the cheap way
    to read on, at any depth. An ``offset`` counts from there, or from the newest event.
    """

    source_system: str | None = None
    port: str | None = None
    product: str | None = None
    from_utc: datetime | None = None
    to_utc: datetime | None = None
    limit: int = DEFAULT_PAGE
    offset: int = 0
    after: tuple[datetime, str] | None = None

    def __post_init__(self):
        if self.from_utc is not None and self.to_utc is not None and self.from_utc > self.to_utc:
            raise ValueError("invalid_range: 'from' must not be later than 'to'.")

    @property
    def page_limit(self) -> int:
        return min(self.limit, MAX_PAGE) if self.limit > 0 else DEFAULT_PAGE

    @property
    def page_offset(self) -> int:
        return max(self.offset, 0)


def _utc(moment: datetime):
    text = moment.isoformat() if moment.tzinfo else moment.isoformat() + "+00:00"
    return F.lit(text).cast("timestamp")


def filter_events(events: DataFrame, query: EventQuery) -> DataFrame:
    """Apply the filters that are set.

    When the events carry their ``dt`` partition, a time bound is repeated as a bound on ``dt``, which
    Catalyst cannot infer by itself and which prunes whole folders.
    """
    if query.source_system is not None:
        events = events.where(F.col("source_system") == query.source_system)
    if query.port is not None:
        events = events.where(F.col("port") == query.port.upper())
    if query.product is not None:
        events = events.where(F.col("product") == query.product.upper())
    partitioned = "dt" in events.columns
    if query.from_utc is not None:
        start = _utc(query.from_utc)
        events = events.where(F.col("occurred_at_utc") >= start)
        events = events.where(F.col("dt") >= F.to_date(start)) if partitioned else events
    if query.to_utc is not None:
        end = _utc(query.to_utc)
        events = events.where(F.col("occurred_at_utc") <= end)
        events = events.where(F.col("dt") <= F.to_date(end)) if partitioned else events
    return events


def _overlapping(rows: DataFrame, into: list[str], by: str, skip: int, take: int) -> DataFrame:
    """Groups of ``by`` (newest first) that hold some of the wanted positions, and how many rows are ``before`` each.

    ``rows`` may be cut into parts already, each with a ``before`` of its own (columns ``into``).
    """
    sizes = rows.groupBy(*into, by).agg(F.count("*").alias("n"))
    newest = Window.partitionBy(*[c for c in into if c != "before"]).orderBy(F.desc(by))
    start = F.col("before") if into else F.lit(0)
    placed = sizes.withColumn("upto", start + F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    wanted = placed.where((F.col("upto") > skip) & (F.col("upto") - F.col("n") < skip + take))
    return wanted.select(*[c for c in into if c != "before"], by, (F.col("upto") - F.col("n")).alias("before"))


def _at_offset(matching: DataFrame, skip: int, take: int) -> DataFrame:
    """The rows at positions ``skip`` to ``skip + take``, newest first, without a top-k of ``skip`` rows.

    Positions are found by counting: past whole days, then past whole minutes of the days that are left. Only
    rows of the minutes that are left are ranked.
    """
    day = F.to_date("occurred_at_utc") if "dt" not in matching.columns else F.col("dt")
    rows = matching.withColumns({"page_day": day, "page_minute": F.date_trunc("minute", "occurred_at_utc")})
    days = _overlapping(rows, [], "page_day", skip, take)
    near = rows.join(days, "page_day")
    minutes = _overlapping(near, ["page_day", "before"], "page_minute", skip, take)
    left = near.drop("before").join(minutes, ["page_day", "page_minute"])
    newest = Window.partitionBy("page_day", "page_minute").orderBy(F.desc("occurred_at_utc"), "event_id")
    position = F.col("before") + F.row_number().over(newest)
    return left.withColumn("page_position", position).where(
        (F.col("page_position") > skip) & (F.col("page_position") <= skip + take)
    ).select(*matching.columns)


def events_page(events: DataFrame, query: EventQuery) -> DataFrame:
    """One page, newest first, ties by event id. Never larger than the page maximum. Runs nothing while planned."""
    matching, skip, take = filter_events(events, query), query.page_offset, query.page_limit
    if query.after is not None:
        at, event_id = _utc(query.after[0]), F.lit(query.after[1])
        older = F.col("occurred_at_utc") < at
        matching = matching.where(older | ((F.col("occurred_at_utc") == at) & (F.col("event_id") > event_id)))
        if "dt" in matching.columns:
            matching = matching.where(F.col("dt") <= F.to_date(at))
    if skip:
        matching = _at_offset(matching, skip, take)
    return matching.orderBy(F.desc("occurred_at_utc"), "event_id").limit(take)


def page_info(page: DataFrame, query: EventQuery) -> DataFrame:
    """Page metadata: how many items the page holds, and the effective limit and offset."""
    return page.agg(F.count("*").alias("count")).select(
        "count", F.lit(query.page_limit).alias("limit"), F.lit(query.page_offset).alias("offset")
    )


def landed_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("landed_events"))
