import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import clock, record
from quayside.operators.classify import claims_for, classify, first_valid, first_valid_events, rejected
from quayside.operators.deadletter import dead_letters, expired_messages, replayable, summary, with_letter_fields
from quayside.operators.metrics import outcome_counts, outcome_totals, outcome_totals_by, publish_retries
from quayside.operators import classify as classify_module
from quayside.session import stored
from quayside.sinks.publish import envelopes, write_outbox
from workload import queries

ERROR = "publish_transient"


def outcomes(classified):
    return [r.outcome for r in classified.orderBy("arrival_seq").collect()]


def test_replay_is_a_duplicate_and_no_dead_letter(parsed):
    rows = parsed(record(), record())
    got = classify(rows).orderBy("arrival_seq").collect()
    assert [(r.outcome, r.reason) for r in got] == [("Accepted", None), ("Duplicate", "duplicate")]
    assert got[1].detail == "Business key 'trading-desk:TD-1' has already been ingested."
    assert dead_letters(classify(rows), clock()).count() == 0


def test_the_key_ignores_the_channel(parsed):
    assert outcomes(classify(parsed(record(), record(channel="Stream")))) == ["Accepted", "Duplicate"]


def test_a_rejected_key_stays_free(parsed):
    rows = parsed(record("erp", "E-1", product="JETA1"), record("erp", "E-1"))
    assert outcomes(classify(rows)) == ["Rejected", "Accepted"]
    assert first_valid(rows).count() == 1


def test_mixed_batch(parsed):
    rows = parsed(record(rid="M-1"), record(rid="M-1"), record(rid="M-2", product="JETA1"))
    assert outcomes(classify(rows)) == ["Accepted", "Duplicate", "Rejected"]


def test_reasons_and_dead_letters(parsed):
    rows = parsed(record(without=("vesselImo",)), record(rid="TD-2", vesselImo="9074720"))
    letters = dead_letters(rejected(rows), clock()).orderBy("reason").collect()
    assert [x.reason for x in letters] == ["normalization_failed", "validation_failed"]
    assert letters[0].record.fields["port"] == "SGSIN" and letters[0].correlation_id == "trading-desk:TD-1"
    assert str(letters[0].dead_lettered_at_utc) == "2026-08-02 10:00:00"
    assert {(r.reason, r.records) for r in summary(dead_letters(rejected(rows), clock())).collect()} == {
        ("normalization_failed", 1),
        ("validation_failed", 1),
    }


def test_claims_from_history(parsed):
    history = parsed(record())
    rows = parsed(record(), record(rid="TD-9"), record(rid="TD-9"))
    claims = claims_for(rows, history.select("dedup_key"))
    assert outcomes(classify(rows, claims)) == ["Duplicate", "Accepted", "Duplicate"]
    assert [r.source_record_id for r in first_valid(rows, claims).collect()] == ["TD-9"]


def with_errors(rows, seqs):
    return rows.withColumn("publish_error", F.when(F.col("arrival_seq.position").isin(*seqs), ERROR))


def test_a_failed_publish_gives_the_key_back(parsed):
    rows = with_errors(parsed(record(), record(), record()), [0])
    got = classify(rows).orderBy("arrival_seq").collect()
    assert [(r.outcome, r.reason) for r in got] == [("Failed", ERROR), ("Accepted", None), ("Duplicate", "duplicate")]


def reference_outcomes(rows, claimed):
    """The sequential definition, one record after the other."""
    claimed, result = set(claimed), {}
    for seq, key, valid, error in sorted(rows):
        if not valid:
            result[seq] = "Rejected"
        elif key in claimed:
            result[seq] = "Duplicate"
        elif error:
            result[seq] = "Failed"
        else:
            claimed.add(key)
            result[seq] = "Accepted"
    return result


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classification_equals_the_sequential_definition(spark, seed):
    rng = random.Random(seed)
    rows = [
        # One key holds half of all rows.
        (seq, "hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", rng.random() < 0.7, rng.random() < 0.3)
        for seq in rng.sample(range(10_000), 400)
    ]
    claimed = ["k3", "k7", "unused"] + (["hot"] if seed == 2 else [])
    df = spark.createDataFrame(
        [(s, k, v, ERROR if e else None, None if v else "bad") for s, k, v, e in rows],
        "arrival_seq bigint, dedup_key string, is_valid boolean, publish_error string, normalization_error string",
    ).withColumn("failures", F.expr("cast(array() as array<struct<field:string,code:string,message:string>>)"))
    claims = spark.createDataFrame([(k,) for k in claimed], "dedup_key string")
    got = classify(df, claims)
    expected = reference_outcomes(rows, claimed)
    assert {r.arrival_seq: r.outcome for r in got.collect()} == expected
    accepted = {r.arrival_seq for r in first_valid(df, claims).collect()}
    assert accepted == {s for s, o in expected.items() if o == "Accepted"}
    # Counting alone, where nothing fails to publish: with and without claims, per group that may be null.
    plain = df.drop("publish_error").withColumn("part", F.when(F.col("arrival_seq") % 3 > 0, F.col("arrival_seq") % 3))
    for taken, frame in ((claimed, claims), ([], None)):
        wanted = {}
        for seq, outcome in reference_outcomes([(s, k, v, False) for s, k, v, _ in rows], taken).items():
            part = wanted.setdefault(seq % 3 or None, {"Accepted": 0, "Duplicate": 0, "Rejected": 0})
            part[outcome] += 1
        totals = {r.part: r for r in outcome_totals_by(plain, ["part"], frame).collect()}
        assert {p: {"Accepted": r.accepted, "Duplicate": r.duplicate, "Rejected": r.rejected} for p, r in totals.items()} == wanted


def test_equal_positions_still_have_one_winner(spark, parsed):
    rows = parsed(record(), record(), record()).withColumn("arrival_seq", F.lit(5).cast("bigint"))
    assert sorted(r.outcome for r in classify(rows).collect()) == ["Accepted", "Duplicate", "Duplicate"]


def test_records_are_parsed_once(spark, parsed, tmp_path):
    parsed(record(), record()).write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    for frame in (classify(source), outcome_totals_by(source, ["channel"])):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(str(tmp_path / "in")) <= 1 and frame.count() > 0


def test_accepting_drops_later_arrivals_before_the_shuffle(parsed):
    plan = first_valid(parsed(record()))._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_accepting_shuffles_event_ids_as_bytes(parsed):
    """Before, they were shuffled as text of 36 digits."""
    rows = parsed(record(rid="1"), record(rid="2"), record(rid="2"))
    accepted = first_valid(rows)
    below = accepted._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")[-1]
    assert "unhex(" in below
    assert accepted.columns == rows.columns
    wanted = {(r.dedup_key, r.event_id) for r in rows.collect()}
    assert {(r.dedup_key, r.event_id) for r in accepted.collect()} == wanted and len(wanted) == 2
    odd = rows.withColumn("event_id", F.when(F.col("source_record_id") == "1", F.lit("ODD-id")))
    assert {r.event_id for r in first_valid(odd).collect()} == {"ODD-id", None}


def test_counts(parsed):
    rows = parsed(
        record("erp", "E-1"), record("kafka", "K-1", "Stream"), record("kafka", "K-2", "Stream", port="Fredericia"),
        record("erp", "E-1"),
    )
    counts = {(r.outcome, r.channel): r.records for r in outcome_counts(rows).collect()}
    assert len(counts) == 12 and sum(counts.values()) == 4
    assert counts["Accepted", "Batch"] == counts["Accepted", "Stream"] == counts["Rejected", "Stream"] == 1
    assert counts["Duplicate", "Batch"] == 1
    totals = {r.outcome: r.records for r in outcome_totals(outcome_counts(rows)).collect()}
    assert totals == {"Accepted": 2, "Duplicate": 1, "Rejected": 1, "Failed": 0}
    failed = outcome_totals_by(with_errors(rows, [0, 3]), ["source_system"]).where("source_system = 'erp'").first()
    assert (failed.accepted, failed.duplicate, failed.failed) == (0, 0, 2)


def test_publish_retries(spark):
    log = spark.createDataFrame([("Batch", 1), ("Batch", 3), ("Api", 2)], "channel string, attempts int")
    assert {r.channel: r.retries for r in publish_retries(log).collect()} == {"Batch": 2, "Stream": 0, "Api": 1}


def test_replay_of_dead_letters(spark, parsed):
    first = with_errors(
        parsed(record(rid="A"), record(rid="B", product="JETA1"), record(rid="C", product="JETA1"), record(rid="D")), [0]
    )
    letters = dead_letters(classify(first), clock())
    corrections = spark.createDataFrame(
        [("trading-desk", "B", {"product": "mgo"})],
        "source_system string, source_record_id string, overrides map<string,string>",
    )
    from quayside.operators.classify import parse

    again = parse(replayable(letters, corrections), clock())
    got = {r.source_record_id: (r.outcome, r["product"]) for r in classify(again).collect()}
    assert got == {"A": ("Accepted", "LSMGO"), "B": ("Accepted", "MGO")}
    assert replayable(letters).count() == 1


def test_expired_messages(spark):
    inbox = spark.createDataFrame(
        [(1, 5, "2026-08-01"), (2, 4, "2026-08-01"), (3, 0, "2026-07-01"), (4, 9, "2026-07-01")],
        "id int, delivery_count int, at string",
    ).withColumn("enqueued_at", F.col("at").cast("timestamp"))
    got = {r.id: r.reason for r in expired_messages(inbox, clock()).collect()}
    assert got == {1: "MaxDeliveryCountExceeded", 3: "TTLExpiredException", 4: "MaxDeliveryCountExceeded"}


def test_what_follows_from_an_event_is_made_after_the_first_is_known(spark, parsed):
    rows = parsed(record(rid="A"), record(rid="A", quantityMt="7"), record(rid="B", port="x"), record(rid="C", priceUsdPerMt="1.005"))
    claims = spark.createDataFrame([("trading-desk:A",)], "dedup_key string")
    for taken in (None, claims):
        got, want = first_valid_events(rows, taken), first_valid(rows, taken)
        assert sorted(got.select(*want.columns).collect(), key=str) == sorted(want.collect(), key=str)
    plan = first_valid_events(rows).select("event_id", "total_usd")._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window ["):]
    assert "sha2" in plan and "sha2" not in window


def test_fields_are_kept_for_letters_only(spark, parsed):
    rows = parsed(record(rid="A"), record(rid="B", port="x"), record(rid="C")).withColumn(
        "publish_error", F.when(F.col("source_record_id") == "C", "publish_transient")
    )
    kept = with_letter_fields(rows)
    assert {r.source_record_id: r.fields is not None for r in kept.collect()} == {"A": False, "B": True, "C": True}
    letters = [dead_letters(classify(x), clock()).collect() for x in (rows, kept)]
    assert sorted(letters[0], key=str) == sorted(letters[1], key=str)


def _small_tables(spark, folder):
    lines = [(n, n % 4, n % 3, n % 5, 10.0 + n, 100.0, 0.0, 0.0, "N", "O", datetime(1998, 6, 20 + n % 8)) for n in range(40)] * 2
    names = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    names += "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, names).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(n, t) for n, t in enumerate(("STANDARD", "SMALL", "PROMO", "MEDIUM"))], "p_partkey bigint, p_type string").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(n, f"S{n}", 5 * n) for n in range(3)], "s_suppkey bigint, s_name string, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")


def test_history_is_written_once_and_without_what_does_not_decide(spark, tmp_path, monkeypatch):
    _small_tables(spark, tmp_path)
    written = []
    monkeypatch.setattr(queries, "stored", lambda df, name: written.append((name, df.columns)) or stored(df, name))
    monkeypatch.setattr(classify_module, "stored", lambda df, name: written.append((name, df.columns)) or stored(df, name))
    got = queries.dedupe_against_history(spark, str(tmp_path)).groupBy("outcome").count().collect()
    assert [name for name, _ in written] == ["trades"] and "fields" not in written[0][1] and "total_usd" not in written[0][1]
    parsed = queries.parsed_trades(spark, str(tmp_path), "arrival_day")
    before = F.col("arrival_day") < 10400
    want = classify(parsed.where(~before), first_valid(parsed.where(before))).groupBy("outcome").count().collect()
    assert sorted(got) == sorted(want) and len(got) >= 2


def test_the_outbox_is_zstd(spark, parsed, tmp_path):
    write_outbox(envelopes(first_valid(parsed(record()))), str(tmp_path), 0)
    assert [n for n in os.listdir(tmp_path / "batch_id=0") if n.endswith(".parquet")][0].endswith(".zstd.parquet")
