import json
import os
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import BASE, clock, record
from quayside.contract import MESSAGE
from quayside.functions import flat_string_maps
from quayside.operators.classify import first_valid, parse
from quayside.sinks.publish import envelopes, kafka_rows
from quayside.sources import all_channels, bus, push
from quayside.sources.batch import BatchSource, batch_records, pulled_fields, read_batch_sources, read_pulls
from quayside.operators import arrival
from quayside.operators.arrival import latest_instants, non_falling
from quayside.sources.stream import StreamSource, decode, stream_records


def test_batch_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "pull.json").write_text(
        json.dumps([{**BASE, "sourceRecordId": "1"}, {"port": "X"}, {"sourceRecordId": "2", "qty": 5}, {"sourceRecordId": " "}])
    )
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "one.json").write_text('[{"no":"7","port":"P"}]')
    (tmp_path / "b" / "two.json").write_text('[{"no":"8"}]')
    (tmp_path / "b" / "broken.json").write_text("not json")
    sources = [
        BatchSource("desk", str(tmp_path / "a")),
        BatchSource("erp", str(tmp_path / "b"), record_id_field="no"),
        BatchSource("off", "/nowhere", enabled=False),
    ]
    got = {(r.source_system, r.source_record_id, r.channel) for r in read_batch_sources(spark, sources).collect()}
    assert got == {("desk", "1", "Batch"), ("erp", "7", "Batch"), ("erp", "8", "Batch")}


def test_skipped_elements_are_observed(spark, tmp_path):
    (tmp_path / "pull.json").write_text('[{"sourceRecordId":"1"},{"a":"b"},{"sourceRecordId":""}]')
    source, seen = BatchSource("desk", str(tmp_path)), Observation()
    assert batch_records(pulled_fields(read_pulls(spark, source)), source, seen).count() == 1
    assert seen.get == {"pulled": 3, "skipped": 2}


def test_elements_keep_their_order(spark, tmp_path):
    (tmp_path / "pull.json").write_text(json.dumps([{"sourceRecordId": str(i)} for i in range(20)]))
    source = BatchSource("desk", str(tmp_path))
    rows = batch_records(pulled_fields(read_pulls(spark, source)), source).orderBy("arrival_seq").collect()
    assert [r.source_record_id for r in rows] == [str(i) for i in range(20)]


def test_pulls_of_one_file_time_stay_apart(spark, tmp_path):
    for name, port in (("b", "BBBBB"), ("a", "AAAAA")):
        file = tmp_path / f"{name}.json"
        file.write_text(json.dumps([{"sourceRecordId": str(i), "port": port} for i in range(3)]))
        os.utime(file, (1_700_000_000, 1_700_000_000))
    source = BatchSource("desk", str(tmp_path))
    rows = batch_records(pulled_fields(read_pulls(spark, source)), source).orderBy("arrival_seq").collect()
    assert [r.fields["port"] for r in rows] == ["AAAAA"] * 3 + ["BBBBB"] * 3
    assert len({tuple(r.arrival_seq) for r in rows}) == 6


@pytest.mark.parametrize("offsets", [(1048575, 1048576), (10, 11), (2**40, 2**40 + 1)])
def test_the_lower_offset_arrives_first_whatever_the_producers_clock_says(spark, offsets):
    rows = [
        (None, json.dumps({**BASE, "sourceRecordId": "PT-1", "quantityMt": str(n)}), "trades", 0, offset, at)
        for n, (offset, at) in enumerate(zip(offsets, ("2026-08-01 00:00:05", "2026-08-01 00:00:00"), strict=True), 1)
    ]
    text = "key string, value string, topic string, partition int, offset bigint, at string"
    frame = spark.createDataFrame(rows, text).withColumn("timestamp", F.col("at").cast("timestamp"))
    accepted = first_valid(parse(stream_records(frame, StreamSource()), clock())).collect()
    assert [float(r.quantity_mt) for r in accepted] == [1.0]


@pytest.mark.parametrize("pull_at,message_at,expected", [("00:00:05", "00:00:09", "Batch"), ("00:00:09", "00:00:05", "Stream")])
@pytest.mark.parametrize("partition", [0, 7])
def test_the_earlier_channel_is_accepted(spark, partition, pull_at, message_at, expected):
    body = json.dumps({**BASE, "sourceRecordId": "PT-1"})
    pulls = spark.createDataFrame([(f"[{body}]", f"2026-08-01 {pull_at}", "/pulls/1")], "body string, at string, path string")
    pulls = pulls.withColumn("pulled_at", F.unix_micros(F.col("at").cast("timestamp")))
    rows = [(body, partition, 5, f"2026-08-01 {message_at}")]
    sent = spark.createDataFrame(rows, "value string, partition int, offset bigint, at string").withColumn("timestamp", F.col("at").cast("timestamp"))
    both = all_channels(batch_records(pulled_fields(pulls), BatchSource("port-telemetry")), stream_records(sent, StreamSource()))
    assert [r.channel for r in first_valid(parse(both, clock())).collect()] == [expected]


@pytest.mark.parametrize("block", [1, 2, 3, 1 << 20])
def test_instants_of_a_partition_never_fall(spark, block):
    """Against a plain loop; times fall back, are missing, and partitions have their own clocks."""
    rng = random.Random(block)
    sent = [(p, o, rng.choice([None, *range(20)])) for p in (0, 1) for o in rng.sample(range(40), 20)]
    frame = spark.createDataFrame(sent, "partition int, offset bigint, second int").withColumn("timestamp", F.timestamp_seconds("second"))
    carried = spark.createDataFrame([(1, 7_000_000), (5, 1)], "partition int, latest bigint")
    got = {(r.partition, r.offset): r.instant for r in non_falling(frame, carried, block).collect()}
    latest, want = {0: None, 1: 7_000_000}, {}
    for p, o, second in sorted(sent, key=lambda r: (r[0], r[1])):
        times = [t for t in (latest[p], None if second is None else second * 1_000_000) if t is not None]
        latest[p] = max(times, default=None)
        want[p, o] = latest[p]
    assert got == want
    after = {r.partition: r.latest for r in latest_instants(frame, carried).collect()}
    assert after == {**latest, 5: 1}


@pytest.mark.parametrize("most", [2, 3])
def test_sparse_offsets_fall_into_few_blocks_and_crowded_ones_are_cut(spark, monkeypatch, most):
    """Offsets far apart, most of them close together: before, each message was a row of one window over the partition."""
    monkeypatch.setattr(arrival, "MOST_BLOCKS", most)
    rng = random.Random(most)
    offsets = [*range(60), *(n * 2**40 for n in range(1, 40)), 2**50, 2**50 + 1, 2**50 + 2]
    sent = [(0, o, rng.choice([None, *range(50)])) for o in offsets]
    frame = spark.createDataFrame(sent, "partition int, offset bigint, second int").withColumn("timestamp", F.timestamp_seconds("second"))
    got = {r.offset: r.instant for r in non_falling(frame, None, 4).collect()}
    latest, want = None, {}
    for _, o, second in sorted(sent):
        times = [t for t in (latest, None if second is None else second * 1_000_000) if t is not None]
        latest = want[o] = max(times, default=None)
    assert got == want
    width = frame.groupBy("partition").agg(arrival._width(4).alias("w")).first().w
    assert len({o // width for o in offsets}) <= most + 2


def test_no_enabled_source(spark):
    with pytest.raises(ValueError):
        read_batch_sources(spark, [BatchSource("off", "x", enabled=False)])


def messages(spark, *bodies):
    rows = [(None, b, "trades", 0, i, None) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, MESSAGE).withColumn("timestamp", clock())


def test_stream_messages(spark):
    frame = messages(
        spark, json.dumps({**BASE, "sourceRecordId": "PT-1"}), "junk", "null", '{"port":"X"}', '{"sourceRecordId":7}'
    )
    verdicts = [r.verdict for r in decode(frame, StreamSource()).orderBy("offset").collect()]
    assert verdicts == ["record", "not_json", "not_json", "no_record_id", "not_json"]
    only = stream_records(frame, StreamSource()).collect()
    assert [(r.source_system, r.source_record_id, r.channel) for r in only] == [("port-telemetry", "PT-1", "Stream")]


PUSHED = "request_id string, source_system string, source_record_id string, fields map<string,string>, arrival_seq bigint"


def test_push_guard(spark):
    rows = [
        ("r", " ", None, None, 0), ("r", "erp", "", {"a": "b"}, 1), ("r", "erp", "1", {}, 2),
        ("r", "erp", "1", None, 3), ("r", "erp", "1", {"a": "b"}, 4),
    ]
    frame = spark.createDataFrame(rows, PUSHED)
    errors = [r.request_error for r in push.guard(frame).orderBy("arrival_seq").collect()]
    assert errors == [
        "sourceSystem is required.", "sourceRecordId is required.", "fields is required and must not be empty.",
        "fields is required and must not be empty.", None,
    ]
    assert [r.channel for r in push.well_formed(frame).collect()] == ["Api"]


def test_admission(spark):
    rows = [("big", "erp", str(i), {"a": "b"}, i) for i in range(501)] + [("full", "erp", str(i), {"a": "b"}, i) for i in range(500)]
    records = spark.createDataFrame(rows, PUSHED)
    requests = spark.createDataFrame([("big",), ("full",), ("none",)], "request_id string")
    verdicts = push.admit(requests, records)
    got = {r.request_id: (r.records, r.verdict, r.detail) for r in verdicts.collect()}
    assert got == {
        "big": (501, "batch_too_large", "A batch may contain at most 500 records, got 501."),
        "full": (500, "admitted", None),
        "none": (0, "invalid_request", "The batch is empty."),
    }
    kept = push.admitted_records(records, verdicts)
    assert kept.columns == records.columns and kept.count() == 500


def test_request_summary_counts_malformed_records_as_rejected(spark):
    guarded = push.guard(spark.createDataFrame([("r", "erp", "", {"a": "b"}, 0), ("q", "", "", None, 1)], PUSHED))
    totals = spark.createDataFrame(
        [("r", 1, 2, 3, 0)], "request_id string, accepted bigint, duplicate bigint, rejected bigint, failed bigint"
    )
    got = {r.request_id: tuple(r)[1:] for r in push.request_summary(guarded, totals).collect()}
    assert got == {"r": (1, 2, 4, 0), "q": (0, 0, 1, 0)}


def test_all_channels_have_one_shape(spark, records):
    both = all_channels(records(record()), stream_records(messages(spark, '{"sourceRecordId":"1"}'), StreamSource()))
    assert both.columns == ["source_system", "source_record_id", "channel", "fields", "arrival_seq"]
    assert both.count() == 2


def published(parsed):
    return envelopes(first_valid(parsed(record())))


def test_published_body(parsed):
    row = published(parsed).first()
    assert (row.correlation_id, row.message_id, row.subject) == (
        "trading-desk:TD-1", "ece334fd-407d-e3fa-8ae4-734e2aa239d2", "bunker.trade.recorded",
    )
    body = json.loads(row.body)
    assert body["occurredAtUtc"] == "2026-08-01T06:45:00.000000+00:00"
    assert body["deduplicationKey"] == "trading-desk:TD-1" and body["channel"] == "Batch"
    assert body["payload"]["quantityMt"] == 412.5 and body["payload"]["totalUsd"] == 302713.12


def test_kafka_rows(parsed):
    row = kafka_rows(published(parsed)).first()
    headers = {h.key: bytes(h.value).decode() for h in row.headers}
    assert row.key == "trading-desk:TD-1" and headers["schemaVersion"] == "1" and headers["channel"] == "Batch"


def test_events_survive_the_bus(parsed):
    accepted = first_valid(parsed(record()))
    back = bus.landable(bus.decode_events(envelopes(accepted))).first()
    there = accepted.first()
    for name in back.asDict():
        assert back[name] == there[name], name


def test_undecodable_bodies(spark, parsed):
    body = json.loads(published(parsed).first().body)
    without = {**body, "payload": {k: v for k, v in body["payload"].items() if k != "port"}}
    odd = {k.upper(): v for k, v in body.items()}
    cases = [
        (json.dumps(body), None), ("null", "empty_payload"), ("{", "deserialization_failed"), ("", "deserialization_failed"),
        (json.dumps(without), "deserialization_failed"), (json.dumps(odd), None),
        (json.dumps({**body, "schemaVersion": "1"}), None), (json.dumps({**body, "channel": "batch"}), None),
        (json.dumps({**body, "channel": "Fax"}), "deserialization_failed"), (json.dumps({**body, "extra": [1]}), None),
        (json.dumps({**body, "eventId": 5}), "deserialization_failed"), ("[]", "deserialization_failed"),
        (json.dumps({**body, "occurredAtUtc": "yesterday"}), "deserialization_failed"),
    ]
    frame = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i int, body string")
    decoded = bus.decode_events(frame)
    assert [r.decode_error for r in decoded.orderBy("i").collect()] == [e for _, e in cases]
    letters = bus.undecodable(decoded, clock())
    assert letters.count() == sum(e is not None for _, e in cases)
    assert letters.where("reason = 'empty_payload'").first().detail == "The message body did not contain an integration event."


def test_subscription_filter(spark):
    frame = spark.createDataFrame([(1,), (2,), (None,)], "schema_version int")
    assert [r[0] for r in bus.schema_v1(frame).collect()] == [1]


def test_messages_in_time_order_are_not_shuffled_for_their_arrival(spark):
    """Only places and times are; before, whole messages went through a window. Raised ones are joined by place."""
    rows = [(str(n), 0, n, n) for n in range(6)]
    frame = spark.createDataFrame(rows, "value string, partition int, offset bigint, second int").withColumn("timestamp", F.timestamp_seconds("second"))
    in_order = non_falling(frame)
    assert "Exchange" not in in_order._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.instant for r in in_order.collect()) == [n * 1_000_000 for n in range(6)]
    late = non_falling(frame.withColumn("timestamp", F.timestamp_seconds(F.when(F.col("offset") == 3, 1).otherwise(F.col("second")))))
    assert [r.instant for r in late.orderBy("offset").collect()] == [n * 1_000_000 for n in (0, 1, 2, 2, 4, 5)]
    alike = spark.createDataFrame([(0, 1, 5), (0, 1, 9), (0, 2, 7)], "partition int, offset bigint, second int")
    alike = non_falling(alike.withColumn("timestamp", F.timestamp_seconds("second")))
    assert [r.instant for r in alike.collect()] == [9_000_000] * 3


ODD_TEXTS = {
    '{"a":"b","c":null}': {"a": "b", "c": None},
    ' { "a" : "x\\"}y\\\\" , "a" : "\\u0041" } ': {"a": "A"},
    "{}": {},
    '{"a":"b","a":1}': None,
    '{"a":1,"a":"b"}': None,
    '{"a":{"b":"c"}}': None,
    '{"a":["b"]}': None,
    '{"a":true}': None,
    '{"a":NaN}': None,
    '{"a":"b"} x': None,
    '{"a":"b"},{"a":"c"}': None,
    '["a"]': None,
    "null": None,
    '"{\\"a\\":\\"b\\"}"': None,
    '{"long":"' + "\\n" * 50_000 + '"}': {"long": "\n" * 50_000},
}


def test_flat_maps_of_odd_texts_are_read_without_variants(spark):
    """Values were variants before, a builder each; now the text tells that all of them are strings."""
    frame = spark.createDataFrame([(t,) for t in ODD_TEXTS], "text string")
    got = flat_string_maps(frame, F.col("text"))
    assert {r.text: r.fields for r in got.collect()} == ODD_TEXTS
    assert "variant" not in got._jdf.queryExecution().analyzed().toString()


def test_bodies_are_parsed_once(spark, parsed):
    """Three times before. What names, nulls, repeated names and odd numbers mean stays."""
    body = envelopes(first_valid(parsed(record()))).first().body
    cases = {
        body: None,
        body.replace('"port"', '"Port"').replace('"eventId"', '"EVENTID"'): None,
        body.replace('"port":', '"PORT":"first","port":'): None,
        body.replace('{"eventId":', '{"EVENTID":"first","eventId":'): None,
        body.replace('{"eventId":', '{"eventId":"first","eventId":'): "deserialization_failed",
        body.replace('"port":', '"port":"first","port":'): "deserialization_failed",
        body.replace('"port":"SGSIN"', '"port":5'): "deserialization_failed",
        body.replace('"quantityMt":412.500000000', '"quantityMt":"412.50"'): None,
        body + " x": "deserialization_failed",
        f"[{body}]": "deserialization_failed",
        " null\n": "empty_payload",
        "nullx": "deserialization_failed",
        "": "deserialization_failed",
    }
    assert len(cases) == 13
    decoded = bus.decode_events(spark.createDataFrame([(b,) for b in cases], "body string"))
    assert {r.body: r.decode_error for r in decoded.collect()} == cases
    good = decoded.where("decode_error IS NULL").select("port", "quantity_mt", "total_usd").distinct().collect()
    assert [(r.port, str(r.quantity_mt), str(r.total_usd)) for r in good] == [("SGSIN", "412.500000000", "302713.12")]
    assert decoded._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
