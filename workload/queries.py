"""Every registered query: the engine's operators over trades derived from the driver's tables.

Results are plain columns for comparison: decimals as double, dates and timestamps as UTC ISO text. The
engine itself keeps decimals, dates and timestamps.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.contract import LANDED_COLUMNS
from quayside.functions import clean_number, imo_is_valid, is_number, number_value, packed_number, parse_timestamp, strip
from quayside.operators import deadletter, events, metrics
from quayside.operators.classify import DECIDING, claims_for, classify, classify_stored, first_valid, first_valid_events, parse, rejected
from quayside.operators.normalize import is_routable, normalize
from quayside.operators.validate import explode_failures, rule_counts, trade_rules, validate
from quayside.plans import medallion, reconcile
from quayside.plans.layers import GoldStore, SilverStore
from quayside.session import prepare, stored, work_path
from quayside.sinks import landing, publish
from quayside.sinks.deadletters import write_dead_letters
from quayside.sources import all_channels, batch, bus, push, store, stream
from quayside.sources.landed import batch_folder, read_bronze, read_landed, read_or_empty, snake_columns
from quayside.streaming.buslanding import BusStore, land_bus_batch
from quayside.streaming.dedupe import dedupe_batch
from quayside.sources.live import read_live
from quayside.streaming.ingest import COUNTS, Store, start_all_channels, start_ingest
from workload import inputs as I

ROW = ("source_record_id", "arrival_seq")
# A parsed record, kept whole, with what its outcome is made of.
RECORD = tuple(dict.fromkeys((*deadletter.RECORD_COLUMNS, *DECIDING)))


def plain(df: DataFrame) -> DataFrame:
    """Columns any engine spells the same way."""

    def simple(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(field.name)
        return c

    return df.select(*[simple(f) for f in df.schema.fields])


def parsed_trades(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """The source records, normalized and validated, ingested when they were received."""
    return parse(I.source_records(spark, sf, "received_at", *extra), I.as_of(), F.col("received_at"))


# --- sources ---------------------------------------------------------------------------------


def _flat_json(*pairs: tuple[str, Column]) -> Column:
    """JSON object text with string members."""
    members = [F.concat(F.lit(f'"{name}":"'), value, F.lit('"')) for name, value in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def src_batch_records(spark: SparkSession, sf: str) -> DataFrame:
    """Pull bodies of three elements: a record, one without an id, and one with a number in it."""
    t = I.lines(spark, sf)
    good = _flat_json(("sourceRecordId", F.col("source_record_id")), ("port", F.col("locode")))
    nameless = _flat_json(("sourceRecordId", F.lit("   ")), ("port", F.col("locode")))
    numeric = F.concat(F.lit('{"sourceRecordId":"N-1","quantityMt":'), F.col("tonnes").cast("string"), F.lit("}"))
    again = _flat_json(("sourceRecordId", F.col("source_record_id")), ("port", F.lower("locode")))
    body = F.when(F.col("l_partkey") % 41 == 0, F.lit("not json")).otherwise(
        F.concat(F.lit("["), F.concat_ws(", ", good, nameless, numeric, again), F.lit("]"))
    )
    path = F.col("arrival_tie").cast("string")
    pulls = t.select(body.alias("body"), F.col("arrival_day").alias("pulled_at"), path.alias("path"))
    records = batch.batch_records(batch.pulled_fields(pulls), batch.BatchSource("trading-desk"))
    return records.select(
        "source_record_id", F.col("arrival_seq.at").alias("pulled_at"), F.col("arrival_seq.lane").alias("path"),
        F.col("arrival_seq.position").alias("position"), "source_system", "channel",
        F.element_at("fields", F.lit("port")).alias("port"),
    )


def src_missing_record_id(spark: SparkSession, sf: str) -> DataFrame:
    """How many pulled elements lack a usable id, per source."""
    t = I.lines(spark, sf)
    k = F.col("l_partkey") % 19
    kept_id = F.when(k == 0, F.lit(None)).when(k == 1, F.lit("")).when(k == 2, F.lit("  ")).otherwise(
        F.col("source_record_id")
    )
    fields = F.when(k == 3, F.create_map(F.lit("other"), F.lit("x"))).otherwise(F.create_map(F.lit("recordNo"), kept_id))
    return (
        t.select("source_system", fields.alias("fields"))
        .groupBy("source_system")
        .agg(
            F.count("*").alias("pulled"),
            F.count_if(batch.missing_id(F.col("fields"), "recordNo")).alias("skipped"),
        )
        .withColumn("kept", F.col("pulled") - F.col("skipped"))
    )


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as stream messages; some are not JSON, some have no id, some break the string rule."""
    t = I.lines(spark, sf)
    k = F.col("l_partkey") % 8
    whole = _flat_json(("sourceRecordId", F.col("source_record_id")), ("port", F.col("locode")))
    value = (
        F.when(k == 0, F.concat(F.lit('{"sourceRecordId":"'), F.col("source_record_id")))
        .when(k == 1, F.concat(F.lit("["), whole, F.lit("]")))
        .when(k == 2, F.lit("null"))
        .when(k == 3, _flat_json(("port", F.col("locode"))))
        .when(k == 4, _flat_json(("sourceRecordId", F.lit(" ")), ("port", F.col("locode"))))
        .when(
            k == 5,
            F.concat(
                F.lit('{"sourceRecordId":"'), F.col("source_record_id"), F.lit('","quantityMt":'),
                F.col("tonnes").cast("string"), F.lit("}"),
            ),
        )
        .when(
            k == 6,
            _flat_json(
                ("sourceRecordId", F.col("source_record_id")), ("port", F.lit("XXXXX")), ("port", F.col("locode"))
            ),
        )
        .otherwise(F.concat(whole, F.when(F.col("l_suppkey") % 2 == 0, F.lit(" trailing")).otherwise(F.lit("  "))))
    )
    return t.select(
        value.alias("value"), F.col("arrival_tie").alias("offset"), F.col("l_shipdate").cast("timestamp").alias("timestamp")
    )


def stream_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict and decoded fields of every message, and of the raw event properties (numbers in them)."""
    props = I.table(spark, sf, "events").select(
        F.col("props").alias("value"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp")
    )
    decoded = stream.decode(_messages(spark, sf).unionByName(props), stream.StreamSource())
    return decoded.select(
        "offset",
        "verdict",
        F.element_at("fields", F.lit("sourceRecordId")).alias("record_id"),
        F.element_at("fields", F.lit("port")).alias("port"),
    )


def _request_id() -> Column:
    """The request that the trade of an order line is pushed with."""
    part = F.when(F.col("l_linenumber") <= 6, F.lit("main")).otherwise(F.lit("rest"))
    return F.concat_ws("-", F.lit("REQ"), F.col("l_suppkey").cast("string"), part)


def _requests(spark: SparkSession, sf: str, *extra: str, order_lines: DataFrame | None = None) -> DataFrame:
    """Pushed records; the big requests of a supplier exceed the limit for some suppliers only."""
    t = I.lines(spark, sf, order_lines).withColumn("request_id", _request_id())
    return I.as_records(t, "request_id", "l_partkey", *extra)


def src_push_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Structural verdict on every pushed record."""
    k = F.col("l_partkey") % 17
    broken = _requests(spark, sf).withColumns(
        {
            "source_system": F.when(k.isin(0, 4), F.lit(" ")).otherwise(F.col("source_system")),
            "source_record_id": F.when(k == 1, F.lit(None)).when(k == 4, F.lit("")).otherwise(F.col("source_record_id")),
            "fields": F.when(k == 2, F.map_filter("fields", lambda name, _: F.lit(False)))
            .when(k == 3, F.lit(None))
            .otherwise(F.col("fields")),
        }
    )
    return push.guard(broken).select("arrival_seq", "request_id", "request_error")


def _request_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Announced requests: two per supplier, and one per supplier that turns out to be empty."""
    suppliers = I.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("s"))
    return suppliers.select(
        F.explode(F.array(*[F.concat_ws("-", F.lit("REQ"), "s", F.lit(x)) for x in ("main", "rest", "none")])).alias(
            "request_id"
        )
    )


def src_batch_admission(spark: SparkSession, sf: str) -> DataFrame:
    return push.admit(_request_ids(spark, sf), _requests(spark, sf))


def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Answer to every admitted request: outcome counts of its records."""
    verdicts = push.admit(_request_ids(spark, sf), _requests(spark, sf))
    # Refused requests go before their records are made: an order line is a few numbers. Two branches read the rest.
    order_lines = I.table(spark, sf, "lineitem").withColumn("request_id", _request_id())
    order_lines = stored(push.admitted_records(order_lines, verdicts).drop("request_id"), "admitted-lines")
    broken = _requests(spark, sf, order_lines=order_lines).withColumn(
        "source_record_id", F.when(F.col("l_partkey") % 17 != 1, F.col("source_record_id"))
    )
    pipeline = parse(push.well_formed(broken), I.as_of())
    return push.request_summary(push.guard(broken), metrics.outcome_totals_by(pipeline, ["request_id"]))


def ingest_all_channels(spark: SparkSession, sf: str) -> DataFrame:
    """One pipeline for records that came in through all channels: outcomes per source system and channel.

    The erp's records come in pulls, messages and pushes, so that keys occur in several; the earliest arrival is
    accepted. Every fifth message has a clock three days slow.
    """
    records = I.source_records(spark, sf, "l_orderkey", "l_partkey").withColumn("instant", I.arrival_micros())
    wire = records.withColumn("json", F.to_json("fields"))
    pulls = wire.where("source_system = 'erp' AND channel = 'Batch'").select(
        F.concat(F.lit("["), "json", F.lit("]")).alias("body"),
        F.col("instant").alias("pulled_at"),
        F.lpad(F.col("arrival_seq.position").cast("string"), 12, "0").alias("path"),
    )
    slow = F.when(F.col("l_partkey") % 5 == 0, F.lit(3 * 86_400_000_000)).otherwise(F.lit(0))
    sent = wire.select(
        "source_system", "channel", F.col("json").alias("value"), (F.col("l_orderkey") % 4).cast("int").alias("partition"),
        I.packed_arrival(F.col("arrival_seq")).alias("offset"), F.timestamp_micros(F.col("instant") - slow).alias("timestamp"),
    )
    pushed = records.where("source_system = 'trading-desk' OR source_system = 'erp' AND channel = 'Api'").withColumn(
        "arrival_seq", push.request_arrival(F.timestamp_micros("instant"), F.lit("request"), F.col("arrival_seq.position"))
    )
    union = all_channels(
        batch.batch_records(batch.pulled_fields(pulls), batch.BatchSource("erp")),
        stream.stream_records(sent.where("source_system = 'erp' AND channel = 'Stream'"), stream.StreamSource("erp")),
        stream.stream_records(sent.where("source_system = 'port-telemetry'"), stream.StreamSource("port-telemetry")),
        push.well_formed(pushed),
    )
    return metrics.outcome_totals_by(parse(union, I.as_of()), ["source_system", "channel"])


def _published(spark: SparkSession, sf: str) -> DataFrame:
    return publish.envelopes(first_valid_events(parsed_trades(spark, sf)))


def publish_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """The outbox, read back: headers as they are sent, body decoded member by member with a JSON reader."""
    body = T.StructType(
        [T.StructField(n, T.StringType()) for n in (
            "eventId", "eventType", "schemaVersion", "sourceSystem", "sourceRecordId", "channel",
            "occurredAtUtc", "ingestedAtUtc", "deduplicationKey",
        )]
        + [T.StructField("payload", T.StructType([T.StructField(n, T.StringType()) for n in (
            "tradeReference", "vesselImo", "port", "product", "counterparty", "tradedAtUtc",
        )] + [T.StructField(n, T.DoubleType()) for n in ("quantityMt", "priceUsdPerMt", "totalUsd")]))]
    )
    outbox = work_path(spark, "outbox")
    publish.write_outbox(_published(spark, sf), outbox, batch_id=0)

    def header(name: str) -> Column:
        value = F.get(F.filter("headers", lambda h: h["key"] == name), F.lit(0))["value"]
        return value.cast("string")

    opened = spark.read.parquet(batch_folder(outbox, 0)).withColumn("b", F.from_json("value", body))
    return opened.select(
        F.col("key").alias("correlation_id"), header("messageId").alias("message_id"), header("subject").alias("subject"),
        header("contentType").alias("content_type"), header("schemaVersion").cast("int").alias("schema_version"), "b.*",
    ).select("*", "payload.*").drop("payload")


def bus_schema_filter(spark: SparkSession, sf: str) -> DataFrame:
    """What the landing subscription lets through when some producers already send version 2."""
    sent = _published(spark, sf).withColumn(
        "schema_version", F.when(F.substring(F.col("message_id"), 1, 1) == "a", 2).otherwise(F.col("schema_version"))
    )
    return bus.schema_v1(sent).groupBy("source_system", "channel").agg(F.count("*").alias("messages"))


def bus_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Message bodies back to events; some are cut short, null, incomplete or oddly cased."""
    k = F.substring(F.col("message_id"), 1, 1)
    body = (
        F.when(k == "0", F.substring(F.col("body"), 1, 80))
        .when(k == "1", F.lit("null"))
        .when(k == "2", F.replace(F.col("body"), F.lit('"port":'), F.lit('"harbour":')))
        .when(k == "3", F.replace(F.col("body"), F.lit('"eventId":'), F.lit('"EVENTID":')))
        .when(k == "4", F.replace(F.col("body"), F.lit('"schemaVersion":1'), F.lit('"schemaVersion":"1"')))
        .when(k == "5", F.replace(F.col("body"), F.lit('"channel":"'), F.lit('"channel":"X')))
        .when(k == "6", F.regexp_replace(F.col("body"), '"quantityMt":[0-9.]+', '"quantityMt":"many"'))
        .otherwise(F.col("body"))
    )
    messages = _published(spark, sf).select("message_id", body.alias("body"))
    decoded = bus.decode_events(messages)
    ok = F.col("decode_error").isNull()
    return plain(
        decoded.select(
            "message_id",
            "decode_error",
            *[F.when(ok, F.col(c)).alias(c) for c in (
                "event_id", "source_system", "channel", "port", "quantity_mt", "total_usd", "occurred_at_utc",
            )],
        )
    )


# --- normalization ---------------------------------------------------------------------------


def normalize_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return normalize(I.source_records(spark, sf), I.as_of()).select(
        *ROW, "trade_reference", "vessel_imo", "port", "product", "counterparty"
    )


def normalize_decimals(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen spellings of amounts, good and bad."""
    t = I.lines(spark, sf)
    w = F.lit(1000) + F.col("l_partkey") % 5000
    whole, head = w.cast("string"), F.floor(w / 1000).cast("string")
    tail, c = F.lpad((w % 1000).cast("string"), 3, "0"), F.col("cents")
    cases = [
        F.concat(whole, F.lit("."), c),
        F.concat(whole, F.lit(","), c),
        F.concat(head, F.lit(" "), tail, F.lit(","), c),
        F.concat(head, F.lit(","), tail, F.lit("."), c),
        F.concat(whole, F.lit(",")),
        F.concat(whole, F.lit("."), c, F.lit("-")),
        F.concat(F.lit("+"), whole, F.lit("."), c),
        F.concat(F.lit("  "), whole, F.lit("."), c, F.lit("\t")),
        F.concat(head, F.lit(","), tail),
        F.concat(head, F.lit(","), tail, F.lit(","), tail),
        F.concat(head, F.lit("."), tail, F.lit(","), c),
        F.concat(head, F.lit("e3")),
        F.concat(F.lit("+"), whole, F.lit("-")),
        F.concat(head, F.lit("\u00a0"), tail),
        F.concat(F.lit("."), c),
        F.concat(F.lit("- "), whole),
    ]
    text = F.element_at(F.array(*cases), (F.col("l_partkey") % 16 + 1).cast("int"))
    read = t.withColumn("clean", clean_number(packed_number(text)))
    return plain(
        read.select(*ROW, is_number(F.col("clean")).alias("is_number"), number_value(F.col("clean")).alias("value"))
    )


def normalize_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve spellings of instants, good and bad."""
    t = I.lines(spark, sf)
    at = F.col("traded_at")

    def shown(pattern: str, shift: str | None = None) -> Column:
        return F.date_format(at + F.expr(f"INTERVAL {shift}") if shift else at, pattern)

    cases = [
        shown("yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.concat(shown("yyyy-MM-dd'T'HH:mm:ss", "2 HOURS"), F.lit("+02:00")),
        shown("yyyy-MM-dd'T'HH:mm:ss"),
        F.concat(shown("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".1234567Z")),
        shown("yyyy-MM-dd"),
        F.concat(F.lit("  "), shown("yyyy-MM-dd HH:mm"), F.lit(" ")),
        shown("MM/dd/yyyy HH:mm:ss"),
        shown("M/d/yyyy"),
        F.concat(shown("EEE"), F.lit(", "), shown("dd MMM yyyy HH:mm:ss"), F.lit(" GMT")),
        F.lit("not a date"),
        shown("yyyy"),
        F.lit("1997-13-45"),
    ]
    text = F.element_at(F.array(*cases), (F.col("l_partkey") % 12 + 1).cast("int"))
    read = t.withColumn("text", strip(text))
    return plain(read.select(*ROW, parse_timestamp(F.col("text")).alias("parsed_at")))


def normalize_errors(spark: SparkSession, sf: str) -> DataFrame:
    """First problem of every record that cannot be normalized."""
    failed = normalize(I.damaged_records(spark, sf), I.as_of()).where(F.col("normalization_error").isNotNull())
    return failed.select(*ROW, F.lit("normalization_failed").alias("reason"), F.col("normalization_error").alias("detail"))


def normalize_routable(spark: SparkSession, sf: str) -> DataFrame:
    return I.damaged_records(spark, sf).select(*ROW, is_routable().alias("routable"))


def event_identity(spark: SparkSession, sf: str) -> DataFrame:
    return normalize(I.source_records(spark, sf), I.as_of()).select(*ROW, "dedup_key", "event_id")


def trade_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of amounts that end in half a cent half of the time."""
    halves = I.lines(spark, sf).withColumn(
        "t_quantity_mt", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".5"))
    )
    return plain(
        normalize(I.as_records(halves), I.as_of()).select(*ROW, "quantity_mt", "price_usd_per_mt", "total_usd")
    )


# --- data quality ----------------------------------------------------------------------------


def dq_imo_check(spark: SparkSession, sf: str) -> DataFrame:
    """Check digits of vessel numbers, some too short, too long or with a letter inside."""
    k, imo = F.col("l_partkey") % 13, F.col("imo")
    shown = (
        F.when(k == 0, F.substring(imo, 1, 6))
        .when(k == 1, F.concat(imo, F.lit("9")))
        .when(k == 2, F.concat(F.substring(imo, 1, 2), F.lit("A"), F.substring(imo, 4, 4)))
        .when(k == 3, F.concat(F.substring(imo, 1, 6), F.lit("٣")))
        .otherwise(imo)
    )
    return I.lines(spark, sf).select(*ROW, shown.alias("imo")).withColumn("valid", imo_is_valid(F.col("imo")))


def _checked_events(spark: SparkSession, sf: str) -> DataFrame:
    """Typed events as they could arrive from the bus, every rule broken by some of them."""
    events_ = normalize(
        I.source_records(spark, sf, "l_orderkey", "l_partkey"), I.as_of(I.DQ_AS_OF)
    ).where(F.col("normalization_error").isNull())
    k = F.col("l_orderkey")
    altered = events_.withColumns(
        {
            "schema_version": F.when(k % 101 == 0, 2).otherwise(F.col("schema_version")),
            "trade_reference": F.when(k % 103 == 0, "").otherwise(F.col("trade_reference")),
            "counterparty": F.when(k % 107 == 0, " \t").otherwise(F.col("counterparty")),
            "price_usd_per_mt": F.when(k % 109 == 0, F.col("price_usd_per_mt") * 10)
            .otherwise(F.col("price_usd_per_mt"))
            .cast("decimal(18,9)"),
        }
    ).drop("quantity_mt_text", "price_usd_per_mt_text")
    return validate(altered, trade_rules(altered, I.as_of(I.DQ_AS_OF)))


def dq_failures(spark: SparkSession, sf: str) -> DataFrame:
    return explode_failures(_checked_events(spark, sf), *ROW)


def dq_rule_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rule_counts(_checked_events(spark, sf))


# --- outcomes --------------------------------------------------------------------------------


def classify_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    trades = parsed_trades(spark, sf).select("source_record_id", "channel", *DECIDING)
    return classify(trades).select(*ROW, "channel", "outcome", "reason", "detail")


def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.outcome_counts(parsed_trades(spark, sf))


def outcome_totals(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.outcome_totals(metrics.outcome_counts(parsed_trades(spark, sf)))


def pull_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome tally of a pull, per source."""
    totals = metrics.outcome_totals_by(parsed_trades(spark, sf), ["source_system"])
    return metrics.unpivot_outcomes(totals, ["source_system"])


def publish_retries(spark: SparkSession, sf: str) -> DataFrame:
    """Retries spent on accepted events, the attempts taken from the order quantity."""
    accepted = first_valid(parsed_trades(spark, sf, "l_quantity"))
    return metrics.publish_retries(accepted.withColumn("attempts", F.lit(1) + F.col("l_quantity").cast("bigint") % 4))


def _history_split(spark: SparkSession, sf: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Parsed trades that arrived before the cut day, and those after: what decides about them, and ``columns``."""
    all_trades = stored(parsed_trades(spark, sf, "arrival_day").select("arrival_day", *DECIDING, *columns), "trades")
    before = F.col("arrival_day") < I.CUT_DAY
    return all_trades.where(before), all_trades.where(~before)


def dedupe_against_history(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of the later records when the keys of the earlier ones are taken."""
    history, current = _history_split(spark, sf, "source_record_id")
    claims = claims_for(current, first_valid(history))
    return classify_stored(current, claims).select(*ROW, "outcome")


def _with_publish_errors(spark: SparkSession, sf: str) -> DataFrame:
    return I.publish_errors(parsed_trades(spark, sf, "l_partkey"))


def dedupe_reserve_release(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes when some publishes fail and give their key back."""
    trades = _with_publish_errors(spark, sf).select("source_record_id", *DECIDING, "publish_error")
    return classify(trades).select(*ROW, "outcome", "reason")


# --- dead letters ----------------------------------------------------------------------------


def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    letters = deadletter.dead_letters(rejected(parsed_trades(spark, sf)), I.as_of())
    return plain(
        letters.select(
            "record.source_system", "record.source_record_id", "record.channel", "record.arrival_seq",
            F.size("record.fields").alias("field_count"), "reason", "detail", "dead_lettered_at_utc", "correlation_id",
        )
    )


def dead_letter_summary(spark: SparkSession, sf: str) -> DataFrame:
    trades = deadletter.with_letter_fields(_with_publish_errors(spark, sf)).select(*RECORD, "publish_error")
    return deadletter.summary(deadletter.dead_letters(classify(trades), I.as_of()))


def dead_letter_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Failed publishes run again, and unknown products corrected, against the keys taken meanwhile."""
    first_run = stored(deadletter.with_letter_fields(_with_publish_errors(spark, sf)).select(*RECORD, "publish_error"), "first-run")
    root = work_path(spark, "dead-letters")
    write_dead_letters(deadletter.dead_letters(classify_stored(first_run), I.as_of()), root, batch_id=0)
    letters = spark.read.parquet(root)
    corrections = (
        letters.where(F.contains(F.col("detail"), F.lit("'JETA1' is not one of")))
        .select("record.source_system", "record.source_record_id")
        .distinct()
        .withColumn("overrides", F.create_map(F.lit("product"), F.lit("mgo")))
    )
    # Both runs are parsed once, and read by what needs them.
    again = stored(parse(deadletter.replayable(letters, corrections), I.as_of()).select("source_record_id", "product", *DECIDING), "again")
    claims = claims_for(again, first_valid(first_run))
    return classify_stored(again, claims).select(*ROW, "outcome", "product")


def inbox_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Bus messages that ran out of deliveries or time."""
    inbox = I.table(spark, sf, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("enqueued_at"),
        (F.col("event_id") % 8).alias("delivery_count"),
    )
    return deadletter.expired_messages(inbox, I.as_of("2024-01-25 00:00:00")).select("event_id", "reason")


# --- landing ---------------------------------------------------------------------------------


def append_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Valid records offered to a store that already has the earlier events."""
    history, later = _history_split(spark, sf, "source_record_id", "event_id")
    offered = history.union(later).where("is_valid")
    added = landing.append_if_absent(offered, first_valid(history))
    return added.select("event_id", *ROW)


_WRITTEN: dict[tuple[str, str, str], str] = {}


def _written(spark: SparkSession, sf: str, name: str, rows) -> str:
    """Write a dataset once per session and reuse it, the way reports share one store."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN:
        root = work_path(spark, name)
        landing.write_landing(rows(), root)
        _WRITTEN[key] = root
    return _WRITTEN[key]


def event_store(spark: SparkSession, sf: str) -> DataFrame:
    """The accepted events as landed on storage, partitioned by trade date."""
    return read_landed(spark, _written(spark, sf, "events", lambda: first_valid_events(parsed_trades(spark, sf))))


def _bronze_events(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """Everything valid that was ever landed: replays, and some rows of a later schema version."""
    return parsed_trades(spark, sf, "l_orderkey", *extra).where("is_valid").withColumn(
        "schema_version", F.when(F.col("l_orderkey") % 31 == 0, 2).otherwise(F.col("schema_version"))
    )


def bronze(spark: SparkSession, sf: str) -> DataFrame:
    return landing.file_rows(_bronze_events(spark, sf))


def land_trade_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted events written as Parquet by trade date and read back."""
    root = work_path(spark, "land_trade_rows")
    landing.write_landing(first_valid_events(parsed_trades(spark, sf)), root)
    return plain(read_landed(spark, root).select(*LANDED_COLUMNS, "dt"))


def query_store(spark: SparkSession, sf: str) -> DataFrame:
    """Events through the query store: amounts rounded to its types, totals computed again."""
    fine = I.lines(spark, sf).withColumns(
        {
            "t_quantity_mt": F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".0625")),
            "t_price_usd_per_mt": F.concat(F.col("dollars").cast("string"), F.lit("."), F.col("cents"), F.lit("125")),
        }
    )
    accepted = first_valid(parse(I.as_records(fine, "received_at"), I.as_of(), F.col("received_at")))
    stored = store.to_store(accepted, I.as_of())
    return plain(
        store.from_store(stored).select("event_id", "quantity_mt", "price_usd_per_mt", "total_usd", "ingested_at_utc")
    )


def landed_count(spark: SparkSession, sf: str) -> DataFrame:
    return events.landed_count(event_store(spark, sf))


def landed_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return plain(reconcile.landed_by_date(event_store(spark, sf)))


def bronze_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Partition discovery over landed files: rows and tonnes per discovered date."""
    root = _written(spark, sf, "bronze", lambda: _bronze_events(spark, sf))
    found = read_bronze(spark, root)
    return plain(found.groupBy("dt").agg(F.count("*").alias("rows"), F.sum("QuantityMt").alias("mt")))


def compact_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Fragmented landing datasets rewritten into few files, by date and by micro-batch; every row is still there."""
    dates, batches = work_path(spark, "fragmented"), work_path(spark, "fragmented-batches")
    events_ = stored(_bronze_events(spark, sf).select(*LANDED_COLUMNS, "l_orderkey"), "fragments")
    for half in (0, 1):
        part = events_.where(F.col("l_orderkey") % 2 == half)
        landing.write_landing(part, dates)
        landing.write_landing(part, batches, batch_id=half)
    landing.compact(spark, dates, work_path(spark, "staging"), "1996-01-01", "1996-12-31")
    landing.compact_landing(spark, batches, 0)
    found = read_bronze(spark, dates).withColumn("layout", F.lit("dates")).unionByName(
        read_bronze(spark, batches, batches=True).drop("batch_id").withColumn("layout", F.lit("batches"))
    )
    return plain(found.groupBy("layout", "dt").agg(F.count("*").alias("rows"), F.sum("QuantityMt").alias("mt")))


def landing_profile(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.landing_profile(bronze(spark, sf))


# --- medallion -------------------------------------------------------------------------------


def silver_rename(spark: SparkSession, sf: str) -> DataFrame:
    """Landed file columns under their table names."""
    return plain(snake_columns(bronze(spark, sf)).select("event_id", "schema_version", "vessel_imo", "ingested_at_utc", "dt"))


def silver_trades(spark: SparkSession, sf: str) -> DataFrame:
    return plain(medallion.silver(bronze(spark, sf)))


def silver_delta(spark: SparkSession, sf: str) -> DataFrame:
    return medallion.silver_delta(bronze(spark, sf))


def ingest_lag(spark: SparkSession, sf: str) -> DataFrame:
    return medallion.ingest_lag(medallion.silver(bronze(spark, sf)))


def channel_summary(spark: SparkSession, sf: str) -> DataFrame:
    return plain(medallion.channel_summary(medallion.silver(bronze(spark, sf))))


def gold_port_product(spark: SparkSession, sf: str) -> DataFrame:
    return plain(medallion.gold(medallion.silver(bronze(spark, sf))))


def gold_top(spark: SparkSession, sf: str) -> DataFrame:
    return plain(medallion.gold_top(medallion.gold(medallion.silver(bronze(spark, sf))), 10))


def gold_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell of gold beside its independent recomputation."""
    landed = bronze(spark, sf)
    return plain(reconcile.compare_gold(landed, medallion.gold(medallion.silver(landed))))


# --- event queries ---------------------------------------------------------------------------

FILTER = events.EventQuery(
    source_system="erp", product="vlsfo", from_utc=datetime(1996, 3, 1), to_utc=datetime(1998, 9, 30, 12, 0)
)
DEEP_PAGE = events.EventQuery(limit=200, offset=2000)
PAGE_AFTER = events.EventQuery(limit=100, after=(datetime(1997, 6, 1, 7, 30), "8"))
PAGE = events.EventQuery(product="mgo", from_utc=datetime(1997, 1, 1), limit=100_000, offset=25)


def events_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return plain(
        events.filter_events(event_store(spark, sf), FILTER).select(
            "event_id", "source_system", "port", "product", "quantity_mt", "total_usd", "occurred_at_utc", "dt"
        )
    )


def _numbered(page: DataFrame) -> DataFrame:
    in_order = Window.orderBy(F.desc("occurred_at_utc"), "event_id")
    shown = page.select("event_id", "occurred_at_utc", "port", "quantity_mt")
    return plain(shown.withColumn("position", F.row_number().over(in_order)))


def events_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page with the position of each event in it (the page limit is clamped)."""
    return _numbered(events.events_page(event_store(spark, sf), PAGE))


def events_deep_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page far down the store, found by counting past whole days and minutes."""
    return _numbered(events.events_page(event_store(spark, sf), DEEP_PAGE))


def events_page_after(spark: SparkSession, sf: str) -> DataFrame:
    """The page after a given event, whatever came before it."""
    return _numbered(events.events_page(event_store(spark, sf), PAGE_AFTER))


def events_page_info(spark: SparkSession, sf: str) -> DataFrame:
    return events.page_info(events.events_page(event_store(spark, sf), PAGE), PAGE)


# --- streaming -------------------------------------------------------------------------------

# Arrival days (since 1970-01-01) at which one scheduled run of the stream ends and the next begins.
RUN_ENDS = (9900, 10800)


def _ingested(spark: SparkSession, sf: str) -> Store:
    key = (spark.sparkContext.applicationId, sf, "stream-ingest")
    if key in _WRITTEN:
        return Store(_WRITTEN[key])
    t = I.lines(spark, sf)
    wire = I.as_records(t, "arrival_day", "arrival_tie", "l_partkey")
    value = (
        F.when(F.col("l_partkey") % 29 == 0, F.lit('{"cut'))
        .when(F.col("l_partkey") % 31 == 0, F.to_json(F.map_filter("fields", lambda k, _: k != "sourceRecordId")))
        .otherwise(F.to_json("fields"))
    )
    messages = wire.select(
        F.col("source_record_id").alias("key"),
        value.alias("value"),
        F.lit("trades.raw").alias("topic"),
        F.lit(0).alias("partition"),
        I.packed_arrival(F.col("arrival_seq")).alias("offset"),
        F.timestamp_seconds(F.col("arrival_day") * 86400).alias("timestamp"),
        "arrival_day",
    )
    topic, kept = work_path(spark, "topic"), Store(work_path(spark, "stream"))
    day = F.col("arrival_day")
    for start, end in zip((None, *RUN_ENDS), (*RUN_ENDS, None), strict=True):
        arrived = messages.where(day >= start) if start is not None else messages
        arrived = arrived.where(day < end) if end is not None else arrived
        arrived.drop("arrival_day").write.mode("append").parquet(topic)
        run = start_ingest(
            stream.file_messages(spark, topic), stream.StreamSource(), kept,
            now=datetime.fromisoformat("2026-08-02T10:00:00+00:00"), available_now=True,
        )
        run.awaitTermination()
    _WRITTEN[key] = kept.root
    return kept


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines through the streaming pipeline in three scheduled runs; what landed, and when."""
    landed = read_landed(spark, _ingested(spark, sf).landing, batches=True)
    return plain(landed.select("event_id", "source_record_id", "trade_reference", "quantity_mt", "total_usd", "dt", "batch_id"))


def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What the streaming pipeline counted per micro-batch: messages that came, were no record, and every outcome."""
    return read_live(spark, _ingested(spark, sf).counts, COUNTS).select("batch_id", "channel", "measure", "n")


# Records of a pull, about; there are eight at least.
PULL_RECORDS = 5_000


def stream_all_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Pulls, messages and pushes through one streaming query in two scheduled runs; what landed through which channel.

    The second run's pulls bring half of the first one's records again.
    """
    records = I.source_records(spark, sf, "l_orderkey").withColumns(
        {"instant": I.arrival_micros(), "later": F.col("arrival_seq.at") >= I.CUT_DAY, "json": F.to_json("fields")}
    )
    records = stored(records, "arrivals")
    topic, pulls, pushes, kept = (work_path(spark, n) for n in ("topic", "pulls", "pushes", "channels"))
    erp = records.where("source_system = 'erp'")
    parts = max(8, -(-erp.count() // PULL_RECORDS))
    of_pulls = erp.withColumn("part", F.col("l_orderkey") % parts)
    for run_no, now_in in enumerate((~F.col("later"), F.col("later"))):
        again = ~F.col("later") & (F.col("part") % 2 == 0) if run_no else F.lit(False)
        body = F.transform(F.sort_array(F.collect_list(F.struct("instant", "json"))), lambda r: r["json"])
        drop = of_pulls.where(now_in | again).groupBy("part").agg(F.concat(F.lit("["), F.array_join(body, ","), F.lit("]")).alias("value"))
        drop.select("value").write.mode("append").option("maxRecordsPerFile", 1).text(pulls)
        records.where(now_in & (F.col("source_system") == "port-telemetry")).select(
            F.col("source_record_id").alias("key"), F.col("json").alias("value"), F.lit("trades.raw").alias("topic"),
            (F.col("l_orderkey") % 4).cast("int").alias("partition"), I.packed_arrival(F.col("arrival_seq")).alias("offset"),
            F.timestamp_micros("instant").alias("timestamp"),
        ).write.mode("append").parquet(topic)
        records.where(now_in & (F.col("source_system") == "trading-desk")).select(
            F.lit("request").alias("request_id"), F.timestamp_micros("instant").alias("received_at"), F.lit(0).cast("bigint").alias("place"),
            "source_system", "source_record_id", "fields",
        ).write.mode("append").parquet(pushes)
        run = start_all_channels(
            spark, stream.file_messages(spark, topic), stream.StreamSource(), [batch.BatchSource("erp", pulls)], pushes,
            Store(kept), now=datetime.fromisoformat("2026-08-02T10:00:00+00:00"), available_now=True,
        )
        run.awaitTermination()
    landed = read_landed(spark, Store(kept).landing, batches=True)
    return plain(landed.select("event_id", "source_system", "channel", "quantity_mt", "price_usd_per_mt", "dt", "batch_id"))


# Messages of a file of the log at most; a micro-batch takes a file.
LOG_FILE, LEAST_FILES = 2_000_000, 6


def stream_dedupe_window(spark: SparkSession, sf: str) -> DataFrame:
    """The event log as a message stream, what comes within ten minutes of a kept message of its id dropped.

    The log comes in files that follow each other in time, each a micro-batch; state is carried between them.
    """
    log = stored(I.table(spark, sf, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("message_id"),
        F.col("ts").cast("timestamp").alias("enqueued_at"),
    ), "events-log")
    folder, out, state, checkpoint = (work_path(spark, n) for n in ("log", "deduped", "dedupe-state", "dedupe-checkpoint"))
    seconds = F.unix_seconds("enqueued_at")
    span = log.agg(F.min(seconds), F.max(seconds), F.count("*")).first()
    files = max(LEAST_FILES, -(-span[2] // LOG_FILE))
    length = max((span[1] - span[0]) // files + 1, 1) if span[2] else 1
    for n in range(files if span[2] else 0):
        of_file = F.floor((seconds - F.lit(span[0])) / F.lit(length)) == n
        log.where(F.coalesce(of_file, F.lit(n == 0))).coalesce(1).write.mode("append").parquet(folder)
    if not span[2]:
        log.write.parquet(folder)
    run = (
        spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        .writeStream.foreachBatch(lambda batch, batch_id: dedupe_batch(batch, batch_id, out, state))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return plain(read_or_empty(spark, log.schema, out).select(*log.columns))


# --- bus to landing --------------------------------------------------------------------------


def _bus_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Published messages as the landing subscription holds them; some broken, some of version 2, some expired."""
    k = F.substring(F.col("message_id"), 1, 1)
    body = (
        F.when(k == "0", F.substring(F.col("body"), 1, 80))
        .when(k == "1", F.lit("null"))
        .when(k == "2", F.replace(F.col("body"), F.lit('"port":'), F.lit('"harbour":')))
        .otherwise(F.col("body"))
    )
    return _published(spark, sf).select(
        "message_id",
        F.when(k == "a", 2).otherwise(F.col("schema_version")).alias("schema_version"),
        body.alias("body"),
        F.when(k == "b", 5).otherwise(1).alias("delivery_count"),
        I.as_of().alias("enqueued_at"),
    )


def _landed_from_bus(spark: SparkSession, sf: str) -> BusStore:
    """Two batches, the second of which delivers the messages of the first once more."""
    key = (spark.sparkContext.applicationId, sf, "bus-landing")
    if key in _WRITTEN:
        return BusStore(_WRITTEN[key])
    messages = stored(_bus_messages(spark, sf), "bus")
    where = BusStore(work_path(spark, "bus-landing"))
    now = datetime.fromisoformat("2026-08-02T10:00:00+00:00")
    land_bus_batch(messages.where(F.substring(F.col("message_id"), 2, 1) < "8"), 0, where, now)
    land_bus_batch(messages, 1, where, now)
    _WRITTEN[key] = where.root
    return where


def bus_landing(spark: SparkSession, sf: str) -> DataFrame:
    """What landed from the bus, each event once, with its row in the query store."""
    where = _landed_from_bus(spark, sf)
    rows = store.read_stored(spark, where.events)
    landed = read_landed(spark, where.landing, batches=True).select("event_id", "dt", F.col("batch_id").alias("landed_batch"))
    return plain(landed.join(rows, "event_id", "full").select(
        "event_id", "dt", "landed_batch", "batch_id", "port", "quantity_mt", "total_usd", "landed_at_utc"
    ))


def bus_landing_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Dead letters of the bus subscription per batch and reason."""
    where = _landed_from_bus(spark, sf)
    return spark.read.parquet(where.dead_letters).groupBy(F.col("batch_id").cast("bigint").alias("batch_id"), "reason").agg(
        F.count("*").alias("letters")
    )


def silver_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Silver merged together from three rounds of bronze, the first two of them compacted."""
    kept = SilverStore(work_path(spark, "silver-store"))
    # Each round parses its own lines: the filter reaches the scan.
    rounds = _bronze_events(spark, sf, "l_suppkey").select(*LANDED_COLUMNS, "l_suppkey")
    for n in range(3):
        kept.upsert(landing.file_rows(rounds.where(F.col("l_suppkey") % 3 == n)), n)
        if n == 1:
            kept.compact(spark, n)
    return plain(kept.read(spark))


def gold_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Gold kept up to date by differences: of all events some move to another date and port, and some are withdrawn."""
    silver, gold = SilverStore(work_path(spark, "silver-store")), GoldStore(work_path(spark, "gold-store"))
    # Parsed again for the later round, which has a third of the lines: that is less than to write and read all.
    events_ = _bronze_events(spark, sf).select(*LANDED_COLUMNS, "l_orderkey")
    gold.apply(*silver.upsert(landing.file_rows(events_), 0), 0)
    later = events_.where(F.col("l_orderkey") % 5 == 0).withColumns(
        {c: F.col(c) + F.expr(f"INTERVAL {days} DAYS") for c, days in (
            ("ingested_at_utc", 3650), ("traded_at_utc", 40), ("occurred_at_utc", 40),
        )}
    ).withColumn("port", F.lit("XXMOV"))
    gone = events_.where(F.col("l_orderkey") % 7 == 0).select("event_id").distinct().withColumn("ingested_at_utc", I.as_of())
    gold.apply(*silver.upsert(landing.file_rows(later), 1, gone), 1)
    gold.compact(spark, 1)
    return plain(gold.read(spark))


QUERIES = (
    gold_port_product, gold_top, gold_reconcile, channel_summary, silver_trades, silver_rename, silver_delta,
    ingest_lag, bronze_scan, landing_profile, land_trade_rows, query_store, landed_count, landed_by_date, append_if_absent,
    compact_partition, events_filtered, events_page, events_deep_page, events_page_after, events_page_info, normalize_aliases, normalize_decimals,
    normalize_timestamps, normalize_errors, normalize_routable, event_identity, trade_totals, dq_imo_check,
    dq_failures, dq_rule_counts, classify_outcomes, outcome_counts, outcome_totals, batch_summary, pull_summary,
    publish_retries, dedupe_against_history, dedupe_reserve_release, dead_letters, dead_letter_summary,
    dead_letter_replay, inbox_expiry, src_batch_records, src_missing_record_id, src_push_guard,
    src_batch_admission, ingest_all_channels, stream_decode, publish_envelope, bus_schema_filter, bus_decode,
    bus_landing, bus_landing_letters, gold_refresh, silver_upsert, stream_ingest, stream_counts, stream_all_channels, stream_dedupe_window,
)


def registered():
    """Name -> callable, each preparing the session first."""

    def prepared(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            result = query(prepare(spark), str(sf_dir).rstrip("/"))
            if isinstance(dict((f.name, f.dataType) for f in result.schema.fields).get("arrival_seq"), T.StructType):
                result = result.withColumn("arrival_seq", I.packed_arrival(F.col("arrival_seq")))
            return result

        run.__name__, run.__doc__ = query.__name__, query.__doc__
        return run

    return {q.__name__: prepared(q) for q in QUERIES}
