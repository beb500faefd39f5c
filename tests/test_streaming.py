import json
import os
import random
import shutil
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import BASE, clock, record
from quayside.contract import MESSAGE
from quayside.operators.classify import first_valid
from quayside.operators.metrics import outcome_totals_by
from quayside.sinks.publish import OUTBOX, envelopes
from quayside.sources.landed import read_landed
from quayside.sources.stream import StreamSource, file_messages
from quayside.streaming.dedupe import WINDOW, dedupe_batch, dedupe_within_window, kept_after
from quayside.sources.store import read_stored
from quayside.session import work_root
from quayside.sinks.keyindex import KeyedStore
from quayside.sources.live import live_folders, read_live
from quayside.streaming.buslanding import BusStore, compact_bus_store, land_bus_batch, start_bus_landing
from quayside.sources.arriving import PUSHED
from quayside.sources.batch import BatchSource
from quayside.streaming.attempts import EXCEEDED, evaluate, guarded
from quayside.streaming.ingest import COUNTS, OUTCOMES, Store, batch_clock, compact_store, ingest_batch, start_all_channels, start_ingest

NOW = datetime(2026, 8, 2, 10, 0, tzinfo=timezone.utc)


def trade(rid, **changes):
    return json.dumps({**BASE, "sourceRecordId": rid, **changes})


class Topic:
    """A folder of message files standing in for a topic."""

    def __init__(self, spark, path):
        self.spark, self.path, self.offset = spark, str(path), 0

    def send(self, *bodies):
        rows = [(None, b, "trades", 0, self.offset + i, NOW) for i, b in enumerate(bodies)]
        self.offset += len(rows)
        self.spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(self.path)


@pytest.fixture
def topic(spark, tmp_path):
    return Topic(spark, tmp_path / "topic")


@pytest.fixture
def store(tmp_path):
    return Store(str(tmp_path / "store"))


def run(spark, topic, store, sink=ingest_batch):
    query = start_ingest(file_messages(spark, topic.path), StreamSource(), store, NOW, available_now=True, sink=sink)
    query.awaitTermination()


def landed(spark, store):
    rows = read_landed(spark, store.landing, batches=True).collect()
    return sorted((r.source_record_id, float(r.quantity_mt), r.batch_id) for r in rows)


def outcomes(spark, store):
    rows = spark.read.parquet(store.outcomes).groupBy("outcome").agg(F.sum("records").alias("n")).collect()
    return {r.outcome: r.n for r in rows}


def test_ingest_across_runs(spark, topic, store):
    topic.send(trade("PT-1", quantityMt="1"), trade("PT-2", vesselImo="9074720"), "junk", '{"a":"b"}')
    run(spark, topic, store)
    topic.send(trade("PT-1", quantityMt="2"), trade("PT-2", quantityMt="3"), trade("PT-3", quantityMt="4"))
    run(spark, topic, store)
    run(spark, topic, store)  # nothing new
    assert landed(spark, store) == [("PT-1", 1.0, 0), ("PT-2", 3.0, 1), ("PT-3", 4.0, 1)]
    assert outcomes(spark, store) == {"Accepted": 3, "Duplicate": 1, "Rejected": 1, "Failed": 0}
    letters = spark.read.parquet(store.dead_letters).collect()
    assert [(x.reason, x.record.source_record_id, str(x.dead_lettered_at_utc)) for x in letters] == [
        ("validation_failed", "PT-2", "2026-08-02 10:00:00")
    ]


def test_a_broken_sink_leaves_the_checkpoint_and_the_batch_comes_again(spark, topic, store):
    topic.send(trade("PT-1"), trade("PT-2", port="x"))
    delivered = []

    def breaks_after_landing(records, batch_id, where, now):
        delivered.append(batch_id)
        ingest_batch(records, batch_id, where, now)
        raise RuntimeError("store unavailable")

    with pytest.raises(Exception, match="store unavailable"):
        run(spark, topic, store, breaks_after_landing)
    # Everything was written, but the batch was not committed: it is delivered once more.
    run(spark, topic, store)
    assert delivered == [0]
    assert [(rid, batch) for rid, _, batch in landed(spark, store)] == [("PT-1", 0)]
    assert outcomes(spark, store) == {"Accepted": 1, "Duplicate": 0, "Rejected": 1, "Failed": 0}
    assert spark.read.parquet(store.dead_letters).count() == 1


def test_a_batch_keeps_its_clock(spark, store):
    assert batch_clock(spark, store, 0, NOW) == NOW
    assert batch_clock(spark, store, 0, NOW + timedelta(days=1)) == NOW
    assert batch_clock(spark, store, 1, NOW + timedelta(days=1)) == NOW + timedelta(days=1)


def test_window_dedupe_runs_on_enqueue_time(spark, tmp_path):
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    schema = "message_id string, enqueued_at timestamp"

    def send(**minutes):
        rows = [(name, NOW + timedelta(minutes=m)) for name, m in minutes.items()]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = (
            dedupe_within_window(spark.readStream.schema(schema).parquet(source))
            .writeStream.option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(availableNow=True)
            .outputMode("append")
            .start(out, format="parquet")
        )
        query.awaitTermination()
        got = spark.read.parquet(out).where("message_id = 'm'").select("enqueued_at").collect()
        return sorted((r[0] - NOW.replace(tzinfo=None)).seconds // 60 for r in got)

    assert send(m=0) == [0]
    assert send(m=5) == [0]  # a replay within ten minutes
    assert send(other=40) == [0]  # traffic moves the watermark past the window of "m"
    assert send(m=61) == [0, 61]


@pytest.mark.parametrize("cut", [[], [3], [1, 2, 3, 4, 5, 6], [4, 6]])
def test_window_dedupe_does_not_depend_on_the_batches(spark, tmp_path, cut):
    """Ten minutes from the last message kept, not from the last one seen; a message after exactly ten goes."""
    minutes = [0, 6, 10, 12, 12, 21, 23, 100]
    rows = [(m_id, NOW + timedelta(minutes=m)) for m in minutes for m_id in ("a", "b")] + [("c", NOW)]
    schema = "message_id string, enqueued_at timestamp"
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    for first, end in zip([0, *cut], [*cut, len(minutes)], strict=True):
        part = [r for r in rows if NOW + timedelta(minutes=minutes[first]) <= r[1]]
        part = [r for r in part if end == len(minutes) or r[1] < NOW + timedelta(minutes=minutes[end])]
        spark.createDataFrame(part[::-1], schema).coalesce(1).write.mode("append").parquet(source)
        query = (
            dedupe_within_window(spark.readStream.schema(schema).parquet(source))
            .writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
            .start(out, format="parquet")
        )
        query.awaitTermination()
    got = sorted((r.message_id, (r.enqueued_at - NOW.replace(tzinfo=None)).seconds // 60) for r in spark.read.parquet(out).collect())
    assert got == [(m, t) for m in "ab" for t in (0, 12, 23, 100)] + [("c", 0)]


@pytest.mark.parametrize("batches", [1, 3])
def test_a_hot_id_is_deduped_in_sessions(spark, tmp_path, batches):
    """Rows come in chunks of seven; the result is that of the plain loop."""
    draw = random.Random(4)
    seconds = sorted(draw.choice((0, 40_000, 90_000)) + draw.randrange(9_000) for _ in range(3_000))
    sent = [("hot", s) for s in seconds + seconds[::2]] + [(f"m{k % 40}", s) for k, s in enumerate(seconds[::5])] + [(None, 5), (None, 605), (None, 606)]
    rows = [(name, NOW + timedelta(seconds=s)) for name, s in sent] + [("untimed", None), ("m1", None)]
    schema, out, state = "message_id string, enqueued_at timestamp", str(tmp_path / "out"), str(tmp_path / "state")
    conf = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for k in range(batches):
            low, high = (NOW + timedelta(seconds=x * 99_100 / batches) for x in (k, k + 1))
            part = [r for r in rows if (low <= r[1] < high if r[1] else k == 0)]
            draw.shuffle(part)
            for _ in range(2):  # delivered again
                dedupe_batch(spark.createDataFrame(part, schema), k, out, state)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", conf)
    got = [(r.message_id, r.at) for r in spark.read.schema(schema).parquet(out).select("message_id", F.unix_seconds("enqueued_at").alias("at")).collect()]
    expected = [("untimed", None)]
    for name in {n for n, _ in sent}:
        times = pd.Series(sorted(pd.Timestamp(NOW) + pd.Timedelta(seconds=s) for n, s in sent if n == name))
        expected += [(name, int(times[i].timestamp())) for i in kept_after(times, None, WINDOW)[0]]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_dedupe_state_has_the_ids_of_the_last_window_only(spark, tmp_path):
    schema, out, state = "message_id string, enqueued_at timestamp", str(tmp_path / "out"), str(tmp_path / "state")
    for k in range(4):
        rows = [(f"m{k}-{i}", NOW + timedelta(minutes=15 * k + i)) for i in range(8)] + [("hot", NOW + timedelta(minutes=15 * k + 7))]
        dedupe_batch(spark.createDataFrame(rows, schema), k, out, state)
        known = {r.id: r.last for r in spark.read.parquet(f"{state}/{k % 2}").collect()}
        assert set(known) == {f"m{k}-{i}" for i in range(8)} | {"hot"}
    # A message after exactly ten minutes still goes, whatever was forgotten.
    late = NOW + timedelta(minutes=15 * 3 + 17)
    dedupe_batch(spark.createDataFrame([("hot", late), ("m3-7", late + timedelta(seconds=1))], schema), 4, out, state)
    last = spark.read.schema(schema).parquet(f"{out}/batch_id=4").collect()
    assert [r.message_id for r in last] == ["m3-7"]


def test_streaming_dedupe_state_expires(spark, tmp_path):
    schema, source, checkpoint = "message_id string, enqueued_at timestamp", str(tmp_path / "log"), str(tmp_path / "cp")
    for k in range(4):
        rows = [(f"m{k}-{i}", NOW + timedelta(hours=k, minutes=i)) for i in range(5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    query = (
        dedupe_within_window(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
        .writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .start(str(tmp_path / "out"), format="parquet")
    )
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20 and held[-1] == 5


def breaks_on(*ids):
    def transform(records):
        bad = F.col("source_record_id").isin(*ids)
        return records.withColumn("source_system", F.when(bad, F.raise_error(F.lit("cannot be read"))).otherwise(F.col("source_system")))

    return lambda records, batch_id, where, now: ingest_batch(transform(records), batch_id, where, now), lambda records: evaluate(transform(records))


def test_records_that_always_fail_become_dead_letters_after_the_last_attempt(spark, topic, store):
    topic.send(*[trade(f"PT-{i}") for i in range(12)], trade("PT-7", quantityMt="9"))
    sink = guarded(*breaks_on("PT-7", "PT-3"), most=2)
    with pytest.raises(Exception, match="cannot be read"):
        run(spark, topic, store, sink)
    run(spark, topic, store, sink)
    assert [rid for rid, _, _ in landed(spark, store)] == sorted(f"PT-{i}" for i in range(12) if i not in (3, 7))
    letters = spark.read.parquet(store.dead_letters).collect()
    assert sorted((x.record.source_record_id, x.reason) for x in letters) == [("PT-3", EXCEEDED), ("PT-7", EXCEEDED), ("PT-7", EXCEEDED)]
    topic.send(trade("PT-3", quantityMt="5"), trade("PT-20"))
    with pytest.raises(Exception, match="cannot be read"):
        run(spark, topic, store, sink)  # attempts are counted per batch
    counts = {(r.batch_id, r.measure): r.n for r in read_live(spark, store.counts, COUNTS).collect()}
    assert counts == {(0, "arrived"): 13, (0, "accepted"): 10, (0, "discarded"): 3}


def test_an_error_that_no_record_causes_is_raised(spark, topic, store):
    topic.send(trade("PT-1"))

    def broken(records, batch_id, where, now):
        raise RuntimeError("store unavailable")

    with pytest.raises(Exception, match="store unavailable"):
        run(spark, topic, store, guarded(broken, evaluate, most=1))


def test_all_channels_in_one_query(spark, topic, store, tmp_path):
    """Pulls overlap, a message and a push have keys of their own systems; what is no record is counted."""
    pulls, pushes = tmp_path / "pulls", str(tmp_path / "pushes")
    pulls.mkdir()

    def pull(name, *ids):
        (pulls / name).write_text(json.dumps([{**BASE, "sourceRecordId": i} for i in ids]))

    def push(*ids):
        rows = [("r1", NOW, k, "trading-desk", i, {**BASE}) for k, i in enumerate(ids)]
        spark.createDataFrame(rows, PUSHED).coalesce(1).write.mode("append").parquet(pushes)

    def go():
        start_all_channels(
            spark, file_messages(spark, topic.path), StreamSource(), [BatchSource("erp", str(pulls)), BatchSource("off", "x", enabled=False)],
            pushes, store, NOW, available_now=True,
        ).awaitTermination()

    pull("1.json", "E-1", "E-2")
    topic.send(trade("PT-1"), "junk")
    push("T-1", "T-1")
    go()
    pull("2.json", "E-2", "E-3")
    topic.send(trade("PT-1"))
    go()
    rows = read_landed(spark, store.landing, batches=True).select("source_system", "source_record_id", "channel", "batch_id").collect()
    assert sorted(map(tuple, rows)) == [
        ("erp", "E-1", "Batch", 0), ("erp", "E-2", "Batch", 0), ("erp", "E-3", "Batch", 1), ("port-telemetry", "PT-1", "Stream", 0),
        ("trading-desk", "T-1", "Api", 0),
    ]
    counts = {(r.batch_id, r.channel, r.measure): r.n for r in read_live(spark, store.counts, COUNTS).collect()}
    assert counts == {
        (0, "Stream", "arrived"): 2, (0, "Stream", "discarded"): 1, (0, "Stream", "accepted"): 1, (0, "Batch", "accepted"): 2,
        (0, "Api", "accepted"): 1, (0, "Api", "duplicate"): 1, (1, "Stream", "arrived"): 1, (1, "Stream", "duplicate"): 1,
        (1, "Batch", "accepted"): 1, (1, "Batch", "duplicate"): 1,
    }


def scanned_files(df):
    """Files that the scans of a frame would read."""
    return df.inputFiles()


def test_a_small_batch_opens_few_files_of_a_large_index(spark, tmp_path):
    index = KeyedStore(str(tmp_path / "keys"), rows_per_bucket=50)
    for batch in range(4):
        index.add(spark.range(batch * 1000, (batch + 1) * 1000).select(F.col("id").cast("string").alias("key")), batch)
    index.compact(spark, 2)
    run, = live_folders(spark, index.root).runs
    assert run.bits == 6  # 3,000 keys, 50 a bucket
    wanted = spark.createDataFrame([("7",), ("1500",), ("3500",), ("none",)], "key string")
    found = index.candidates(wanted, 4)
    of_run = [f for f in scanned_files(found) if "_runs" in f]
    assert 0 < len(of_run) <= 4 and found.count() < 1000 + 4 * 120
    assert sorted(r.key for r in index.of_keys(wanted, 4).collect()) == ["1500", "3500", "7"]
    assert sorted(r.key for r in index.of_keys(wanted, 3).collect()) == ["1500", "7"]
    assert sorted(r.key for r in index.of_keys(wanted, 1).collect()) == ["7"]
    assert index.of_keys(wanted.where("false"), 4).count() == 0


def test_bus_batches_do_not_read_the_store(spark, parsed, tmp_path, monkeypatch):
    where = BusStore(str(tmp_path / "bus"))
    for batch in range(3):
        land_bus_batch(bus_messages(spark, parsed, record(rid="1"), record(rid=str(batch))), batch, where, NOW)
        if batch == 1:
            compact_bus_store(spark, where, 0)
    assert sorted((r.source_record_id, r.batch_id) for r in read_stored(spark, where.events).collect()) == [("0", 0), ("1", 0), ("2", 2)]
    shutil.rmtree(where.events)
    shutil.rmtree(where.landing)
    land_bus_batch(bus_messages(spark, parsed, record(rid="1"), record(rid="9")), 3, where, NOW)
    assert [r.source_record_id for r in read_stored(spark, where.events).collect()] == ["9"]


def test_bodies_of_events_are_not_written_again(spark, parsed, tmp_path):
    """Before, every body was written beside the columns it was decoded to; only undecodable ones are needed."""
    folder = f"{work_root(spark)}/quayside/{spark.sparkContext.applicationId}"

    def decoded():
        return {n for n in (os.listdir(folder) if os.path.isdir(folder) else ()) if n.startswith("decoded-")}

    before, where = decoded(), BusStore(str(tmp_path / "bus"))
    bad = spark.createDataFrame([("x", 1, "{", 1)], "message_id string, schema_version int, body string, delivery_count int")
    land_bus_batch(bus_messages(spark, parsed, record(rid="1")).unionByName(bad.withColumn("enqueued_at", clock())), 0, where, NOW)
    (new,) = decoded() - before
    assert [r.body for r in spark.read.parquet(f"{folder}/{new}").collect() if r.body is not None] == ["{"]
    assert [r.body for r in spark.read.parquet(where.dead_letters).collect()] == ["{"]


def test_a_clock_that_falls_back_between_batches_keeps_offset_order(spark, topic, store, tmp_path):
    """The second batch's messages have earlier times than the first's; they still arrive after it."""
    late = NOW - timedelta(days=30)

    def send(offset, at):
        rows = [(None, trade(f"PT-{offset}"), "trades", 0, offset, at)]
        spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(topic.path)

    seen = []

    def keeps(records, batch_id, where, now):
        seen.extend((r.source_record_id, r.arrival_seq.at) for r in records.collect())

    send(0, NOW)
    run(spark, topic, store, keeps)
    send(1, late)
    run(spark, topic, store, keeps)
    instant = int(NOW.timestamp()) * 1_000_000
    assert seen == [("PT-0", instant), ("PT-1", instant)]


def test_ingestion_goes_on_after_compaction(spark, topic, store):
    for i in range(3):
        topic.send(trade(f"PT-{i}"), trade("PT-0"))
        run(spark, topic, store)
    before = landed(spark, store)
    total = outcomes(spark, store)
    for upto in (1, 2):
        compact_store(spark, store, upto)
        assert landed(spark, store) == before
    counts = read_live(spark, store.outcomes, OUTCOMES).groupBy("outcome").agg(F.sum("records").alias("n")).collect()
    assert {r.outcome: r.n for r in counts} == total
    assert read_live(spark, store.outbox, OUTBOX).count() == 3
    topic.send(*[trade(f"PT-{i}") for i in range(4)])
    run(spark, topic, store)
    assert [r[0] for r in landed(spark, store)] == ["PT-0", "PT-1", "PT-2", "PT-3"]


def test_the_outbox_holds_what_landed(spark, topic, store):
    topic.send(trade("PT-1"), trade("PT-1"), trade("PT-2", port="x"))
    run(spark, topic, store)
    row = spark.read.parquet(store.outbox).first()
    headers = {h.key: bytes(h.value).decode() for h in row.headers}
    assert row.key == "port-telemetry:PT-1" and headers["contentType"] == "application/json" and headers["channel"] == "Stream"
    assert spark.read.parquet(store.outbox).count() == 1


def bus_messages(spark, parsed, *rows):
    sent = envelopes(first_valid(parsed(*rows))).select("message_id", "schema_version", "body")
    return sent.withColumns({"delivery_count": F.lit(1), "enqueued_at": clock()})


def test_bus_messages_land_once(spark, parsed, tmp_path):
    where = BusStore(str(tmp_path / "bus"))
    good = bus_messages(spark, parsed, record(rid="1"), record(rid="2"))
    bad = spark.createDataFrame([("x", 1, "null", 1), ("y", 1, "{", 1), ("z", 2, "{", 1), ("w", 1, "late", 9)], "message_id string, schema_version int, body string, delivery_count int")
    both = good.unionByName(bad.withColumn("enqueued_at", clock()))
    for batch, messages in ((0, both), (0, both), (1, good.unionByName(bus_messages(spark, parsed, record(rid="3"))))):
        land_bus_batch(messages, batch, where, NOW)
    rows = read_landed(spark, where.landing, batches=True).collect()
    assert sorted((r.source_record_id, r.batch_id) for r in rows) == [("1", 0), ("2", 0), ("3", 1)]
    stored = read_stored(spark, where.events).collect()
    assert sorted((r.source_record_id, r.batch_id, str(r.landed_at_utc)) for r in stored) == [
        ("1", 0, "2026-08-02 10:00:00"), ("2", 0, "2026-08-02 10:00:00"), ("3", 1, "2026-08-02 10:00:00"),
    ]
    letters = sorted(r.reason for r in spark.read.parquet(where.dead_letters).collect())
    assert letters == ["MaxDeliveryCountExceeded", "deserialization_failed", "empty_payload"]


def test_bus_landing_as_a_stream(spark, parsed, tmp_path):
    source, where = str(tmp_path / "messages"), BusStore(str(tmp_path / "bus"))
    for rows in ((record(rid="1"),), (record(rid="1"), record(rid="2"))):
        frame = bus_messages(spark, parsed, *rows)
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).parquet(source)
        start_bus_landing(stream, where, NOW, available_now=True).awaitTermination()
    got = sorted((r.source_record_id, r.batch_id) for r in read_landed(spark, where.landing, batches=True).collect())
    assert got == [("1", 0), ("2", 1)]


def test_a_batch_counts_accepted_records_and_leaves_nothing_behind(spark, topic, store):
    topic.send(trade("PT-1", quantityMt="1"), trade("PT-1", quantityMt="2"), trade("PT-2", vesselImo="9074720"))
    run(spark, topic, store)
    assert outcomes(spark, store) == {"Accepted": 1, "Duplicate": 1, "Rejected": 1, "Failed": 0}
    assert [x.record.fields["vesselImo"] for x in spark.read.parquet(store.dead_letters).collect()] == ["9074720"]
    left = os.listdir(f"{work_root(spark)}/quayside/{spark.sparkContext.applicationId}")
    assert not [name for name in left if name.startswith("batch-")]


def test_counts_of_accepted_records_need_no_ranking(spark, parsed):
    rows = parsed(record(rid="A"), record(rid="A", channel="Api"), record(rid="B", port="x"), record(rid="C"), record(rid="D", channel="Api"))
    taken = spark.createDataFrame([("trading-desk:C",)], "dedup_key string")
    want = outcome_totals_by(rows, ["channel"], taken)
    got = outcome_totals_by(rows, ["channel"], accepted=first_valid(rows, taken))
    assert sorted(got.collect()) == sorted(want.collect()) and got.dtypes == want.dtypes


def test_a_lookup_where_nothing_is_stored_shuffles_nothing(spark, tmp_path):
    index = KeyedStore(str(tmp_path / "keys"))
    wanted = spark.createDataFrame([("a",), ("b",)], "key string")
    index.add(wanted, 3)
    none = index.of_keys(wanted, 3)
    assert none.collect() == [] and "Exchange" not in none._jdf.queryExecution().executedPlan().toString()
    assert [r.key for r in index.of_keys(wanted.limit(1), 4).collect()] == ["a"]
