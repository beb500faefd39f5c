import os
import shutil
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import clock, record
from quayside.contract import LANDED_COLUMNS
from quayside.operators.classify import first_valid
from quayside.operators.events import EventQuery, events_page, filter_events, page_info
from quayside.plans import layers, medallion, reconcile
from quayside.session import work_path, work_root
from quayside.plans.layers import GoldStore, SilverStore
from quayside.sinks.generations import compact_batches, in_files, plan_merge
from quayside.sinks.landing import append_if_absent, compact, compact_landing, file_rows, write_landing
from quayside.sources.store import from_store, to_store
from quayside.sources.landed import claimed_keys, read_bronze, read_landed, snake_columns
from quayside.sources.live import Run, batch_folder, children, live_folders, read_live, run_folder


def folders(root):
    return sorted(d for d in os.listdir(root) if d.startswith("dt="))


def files(root):
    return sorted(os.path.join(p, f) for p, _, fs in os.walk(root) for f in fs if f.endswith(".parquet"))


def two_days(parsed):
    return first_valid(
        parsed(
            record(rid="1", tradedAtUtc="2026-07-30T23:59:59Z"), record(rid="2", tradedAtUtc="2026-07-31T00:00:00Z"),
            record(rid="3", tradedAtUtc="2026-07-31T01:30:00+02:00"),
        )
    )


def test_two_dates_two_partitions(spark, parsed, tmp_path):
    root = str(tmp_path / "landing")
    write_landing(two_days(parsed), root)
    assert folders(root) == ["dt=2026-07-30", "dt=2026-07-31"] and len(files(root)) == 2
    back = read_landed(spark, root)
    assert back.columns == [*LANDED_COLUMNS, "dt"]
    row = back.where("source_record_id = '3'").first()
    assert row.occurred_at_utc == datetime(2026, 7, 30, 23, 30) and row.dt == date(2026, 7, 30)
    assert (row.quantity_mt, row.total_usd) == (Decimal("412.5"), Decimal("302713.12"))
    assert reconcile.schema_differences(read_bronze(spark, root)) == []
    assert read_bronze(spark, root).columns[0] == "EventId"


def test_unwritten_root_reads_empty(spark, tmp_path):
    assert read_landed(spark, str(tmp_path / "none")).count() == 0


def test_running_a_batch_again_leaves_one_copy(spark, parsed, tmp_path):
    root = str(tmp_path / "landing")
    for _ in range(2):
        write_landing(two_days(parsed), root, batch_id=4)
    write_landing(first_valid(parsed(record(rid="9"))), root, batch_id=5)
    back = read_landed(spark, root, batches=True)
    assert back.count() == 4 and {r[0] for r in back.select("batch_id").collect()} == {4, 5}
    assert {r[0] for r in claimed_keys(back).collect()} == {f"trading-desk:{i}" for i in "1239"}


def test_append_if_absent(parsed):
    landed = first_valid(parsed(record(rid="1")))
    offered = parsed(record(rid="1"), record(rid="2", quantityMt="10"), record(rid="2", quantityMt="20")).where("is_valid")
    added = append_if_absent(offered, landed).collect()
    assert [(r.source_record_id, r.quantity_mt) for r in added] == [("2", 10)]


def test_compaction(spark, parsed, tmp_path):
    root = str(tmp_path / "landing")
    for _ in range(3):
        write_landing(two_days(parsed), root)
    assert len(files(root)) == 6
    before = sorted(tuple(r) for r in read_bronze(spark, root).collect())
    compact(spark, root, str(tmp_path / "staging"), "2026-07-31", "2026-08-31")
    assert len(files(root + "/dt=2026-07-31")) == 1 and len(files(root + "/dt=2026-07-30")) == 3
    assert sorted(tuple(r) for r in read_bronze(spark, root).collect()) == before


def test_table_names(spark):
    frame = spark.createDataFrame([("a", 1, 2, 3)], ["EventId", "dt", "QuantityMt", "NotDeclared"])
    assert snake_columns(frame).columns == ["event_id", "dt", "quantity_mt", "NotDeclared"]


def test_an_empty_append_writes_nothing(spark, parsed, tmp_path):
    root = str(tmp_path / "landing")
    write_landing(two_days(parsed).where("false"), root)
    assert not os.path.exists(root) and read_bronze(spark, root).count() == 0
    write_landing(two_days(parsed).where("false"), root, batch_id=0)
    assert read_bronze(spark, root, batches=True).count() == 0 and read_landed(spark, root, batches=True).count() == 0


def test_an_append_does_not_ask_first_whether_there_are_rows(spark, parsed, tmp_path, monkeypatch):
    """Before, that question computed all rows, and the write computed them again."""
    root, rows = str(tmp_path / "landing"), two_days(parsed)
    monkeypatch.setattr(type(rows), "isEmpty", lambda self: pytest.fail("asked"))
    write_landing(rows, root)
    write_landing(rows.where("false"), root)
    assert read_bronze(spark, root).count() == rows.count()


def test_compaction_goes_on_from_a_complete_staging_folder(spark, parsed, tmp_path):
    root, staging = str(tmp_path / "landing"), str(tmp_path / "staging")
    for _ in range(2):
        write_landing(two_days(parsed), root)
    before = sorted(tuple(r) for r in read_bronze(spark, root).collect())
    # A run that died while it built the folder: there are rows, but no mark.
    read_bronze(spark, root).limit(1).write.partitionBy("dt").parquet(staging + "/rows")
    compact(spark, root, staging, "2026-07-01", "2026-07-31")
    assert sorted(tuple(r) for r in read_bronze(spark, root).collect()) == before
    # A run that died during the swap: one date is gone.
    shutil.rmtree(root + "/dt=2026-07-31")
    compact(spark, root, staging, "2026-07-01", "2026-07-31")
    assert sorted(tuple(r) for r in read_bronze(spark, root).collect()) == before


def test_batches_are_compacted_into_runs(spark, parsed, tmp_path):
    root = str(tmp_path / "landing")

    def rows():
        return sorted(tuple(r) for r in read_landed(spark, root, batches=True).collect())

    for batch in range(4):
        write_landing(first_valid(parsed(record(rid=str(batch)), record(rid=f"x{batch}", tradedAtUtc="2026-07-30"))), root, batch)
    before = rows()
    assert len(before) == 8
    # A run that was never listed changes nothing.
    read_bronze(spark, root, batches=True).limit(1).write.partitionBy("dt").parquet(f"{root}/{run_folder(0, 1)}")
    assert rows() == before
    compact_landing(spark, root, 1)
    assert rows() == before and live_folders(spark, root).upto == 1
    compact_landing(spark, root, 0)
    compact_landing(spark, root, 2)
    live = live_folders(spark, root)
    assert rows() == before and live.upto == 2 and live.batches == (3,)
    assert {f.split("/dt=")[0].split("landing/")[1] for f in read_bronze(spark, root, batches=True).inputFiles()} == {
        *(r.folder for r in live.runs), "batch_id=3"
    }
    write_landing(first_valid(parsed(record(rid="new"))), root, 4)
    assert len(rows()) == 9
    assert read_bronze(spark, root, batches=True).count() == 9


def test_what_compaction_replaced_is_removed_one_compaction_later(spark, tmp_path):
    root = str(tmp_path / "data")
    written = []

    def write(rows, folder):
        written.append(rows.count())
        in_files(rows, folder)

    schema = T.StructType().add("v", T.LongType())
    for batch in range(16):
        spark.range(100).select(F.col("id").alias("v")).coalesce(1).write.parquet(batch_folder(root, batch))
        compact_batches(spark, root, batch, schema, write)
        live = live_folders(spark, root)
        assert read_live(spark, root, schema).count() == 100 * (batch + 1) and not live.batches and len(live.runs) <= 6
        assert len(children(spark, root)) <= 4 + 1 and len(children(spark, f"{root}/_runs")) <= 2 * 6
    # Every row was rewritten about log2(16) times, not 8 times on average.
    assert sum(written) <= 100 * 16 * 5


@pytest.mark.parametrize("sizes,new,merged", [((), 10, 0), ((10,), 10, 1), ((100,), 10, 0), ((80, 40, 20), 10, 3), ((1000, 20), 10, 1)])
def test_runs_of_like_size_are_merged(sizes, new, merged):
    assert plan_merge(tuple(Run("", i, i, s) for i, s in enumerate(sizes)), new) == merged


def test_gold_of_replaced_dates(spark, parsed, tmp_path):
    rows = medallion.silver(sample(parsed))
    store = GoldStore(str(tmp_path / "parts"))

    def read():
        return sorted(tuple(r) for r in store.read(spark).collect())

    expected = sorted(tuple(r) for r in medallion.gold(rows).collect())
    store.replace_dates(rows, 0, "2026-01-01", "2026-12-31")
    assert read() == expected
    # Other dates stay as they are; a round that comes again replaces its own.
    for _ in range(2):
        store.replace_dates(rows.where("false"), 1, "2025-01-01", "2025-12-31")
        assert read() == expected
    more = rows.withColumn("quantity_mt", (F.col("quantity_mt") + 1).cast("decimal(12,3)"))
    store.replace_dates(more, 2, "2026-08-01", "2026-08-01")
    assert read() == sorted(tuple(r) for r in medallion.gold(more).collect())
    # Dates that have no rows any more have no gold.
    store.replace_dates(rows.where("false"), 3, "2026-08-01", "2026-08-01")
    assert read() == []
    store.compact(spark, 3)
    assert read() == [] and store.parts(spark).count() == 0


def test_layers_kept_up_to_date_equal_layers_built_anew(spark, parsed, tmp_path):
    """Events move to another date, port and vessel, come again older, and vanish and come back."""
    silver, gold = SilverStore(str(tmp_path / "silver"), rows_per_bucket=2), GoldStore(str(tmp_path / "gold"))
    rounds = [
        ([(record(rid=str(i), tradedAtUtc=f"2026-07-{10 + i}T00:00:00Z"), 0, 1) for i in range(6)], []),
        ([(record(rid="1", tradedAtUtc="2026-07-25T00:00:00Z"), 5, 1), (record(rid="2", port="NLRTM"), 5, 1), (record(rid="3", vesselImo="9241061"), 5, 1)], [("4", 5)]),
        ([(record(rid="1", quantityMt="1"), 3, 1), (record(rid="5", quantityMt="7"), 9, 2), (record(rid="6"), 9, 1)], [("5", 9), ("0", 9)]),
        ([(record(rid="4", quantityMt="2"), 12, 1), (record(rid="2"), 12, 1)], [("3", 12), ("none", 12)]),
    ]
    ids = {r.source_record_id: r.event_id for r in parsed(*[record(rid=str(i)) for i in range(7)]).collect()}
    known, gone = [], {}
    for n, (rows, removed) in enumerate(rounds):
        at = [(ids.get(rid, rid), f"2026-08-01T09:{minute:02d}:00Z") for rid, minute in removed]
        frame = spark.createDataFrame(at, "event_id string, at string").select("event_id", F.col("at").cast("timestamp").alias("ingested_at_utc"))
        for _ in range(2 if n == 1 else 1):  # the second time as after a failure
            gold.apply(*silver.upsert(bronze_of(parsed, *rows), n, frame), n)
        if n in (0, 2):
            silver.compact(spark, n)
            gold.compact(spark, n)
        known += rows
        gone |= {ids.get(rid, rid): minute for rid, minute in removed}
        if n not in (1, 3):
            continue
        newest = {r.event_id: r for r in medallion.silver(bronze_of(parsed, *known)).collect()}
        left = [r for r in newest.values() if r.event_id not in gone or r.ingested_at_utc.minute > gone[r.event_id]]
        assert sorted(map(tuple, silver.read(spark).select(*left[0].asDict()).collect())) == sorted(map(tuple, left))
        rebuilt = medallion.gold(spark.createDataFrame(left, medallion.silver(bronze_of(parsed, *known)).schema))
        assert sorted(map(tuple, gold.read(spark).collect())) == sorted(map(tuple, rebuilt.collect()))


@pytest.mark.parametrize("few", [-1, 1 << 30])
def test_a_round_is_written_once_and_met_in_one_shuffle(spark, parsed, tmp_path, monkeypatch, few):
    """Before, a round was written three times, and what it met was looked up and shuffled before anybody asked."""
    monkeypatch.setattr(layers, "FEW_BYTES", few)
    silver, rows = SilverStore(str(tmp_path / "silver"), rows_per_bucket=2), []
    folder = f"{work_root(spark)}/quayside/{spark.sparkContext.applicationId}"

    def intermediates():
        return {n for n in (os.listdir(folder) if os.path.isdir(folder) else ()) if n.startswith(("versions-", "before-"))}

    known = intermediates()
    for n, minute in enumerate((1, 2, 3)):
        came = [(record(rid=str(i), quantityMt=str(10 * minute + i)), minute, 1) for i in range(n, n + 4)]
        before, after = silver.upsert(bronze_of(parsed, *came), n)
        was = medallion.silver(bronze_of(parsed, *rows)) if rows else None
        of_round = {r[0] for r in medallion.silver(bronze_of(parsed, *came)).select("event_id").collect()}
        wanted = [] if was is None else [r for r in was.collect() if r.event_id in of_round]
        assert sorted(map(tuple, before.select(*medallion.silver(bronze_of(parsed, *came)).columns).collect())) == sorted(map(tuple, wanted))
        rows += came
        now = medallion.silver(bronze_of(parsed, *rows))
        assert sorted(map(tuple, after.select(*now.columns).collect())) == sorted(tuple(r) for r in now.collect() if r.event_id in of_round)
        if n == 1:
            silver.compact(spark, n)
        assert sorted(map(tuple, silver.read(spark).select(*now.columns).collect())) == sorted(map(tuple, now.collect()))
    assert intermediates() == known


def test_pages_after_an_event(parsed):
    stored = first_valid(parsed(*[record(rid=str(i), tradedAtUtc=f"2026-07-{1 + i % 5:02d}T00:00:00Z") for i in range(40)]))
    expected = [(r.occurred_at_utc, r.event_id) for r in stored.orderBy(F.desc("occurred_at_utc"), "event_id").collect()]
    seen, after = [], None
    while True:
        page = events_page(stored, EventQuery(limit=7, after=after)).collect()
        if not page:
            break
        seen += [(r.occurred_at_utc, r.event_id) for r in page]
        after = seen[-1]
    assert seen == expected
    got = events_page(stored, EventQuery(limit=5, offset=3, after=expected[9])).collect()
    assert [r.event_id for r in got] == [e for _, e in expected[13:18]]


def test_planning_a_page_runs_nothing_and_keeps_no_skipped_rows(spark, parsed, tmp_path):
    root = str(tmp_path / "landing")
    write_landing(two_days(parsed), root)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-a-page", "")
    page = events_page(read_landed(spark, root), EventQuery(limit=9, offset=50_000_000))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert tracker.getJobIdsForGroup("plan-a-page") == [] and "TakeOrderedAndProject(limit=9," in plan
    assert page.collect() == []


def bronze_of(parsed, *rows):
    """Landed file rows with their own ingestion time and schema version: ``(record, minute, version)``."""
    frame = parsed(*[r for r, _, _ in rows])
    minute = F.element_at(F.array(*[F.lit(m) for _, m, _ in rows]), (F.col("arrival_seq.position") + 1).cast("int"))
    version = F.element_at(F.array(*[F.lit(v) for _, _, v in rows]), (F.col("arrival_seq.position") + 1).cast("int"))
    return file_rows(
        frame.withColumns(
            {"ingested_at_utc": clock("2026-08-01T09:00:00Z") + F.make_dt_interval(mins=minute), "schema_version": version}
        )
    )


def sample(parsed):
    return bronze_of(
        parsed,
        (record(rid="1", quantityMt="100"), 0, 1),
        (record(rid="1", quantityMt="200"), 5, 1),
        (record(rid="1", quantityMt="300"), 9, 2),
        (record(rid="2", quantityMt="0.25", priceUsdPerMt="100.005"), 0, 1),
        (record(rid="3", product="MGO", vesselImo="9241061", channel="Stream"), 0, 1),
    )


def test_silver_keeps_the_newest_supported_version(parsed):
    rows = {r.source_record_id: r for r in medallion.silver(sample(parsed)).collect()}
    assert len(rows) == 3 and rows["1"].quantity_mt == 200
    assert rows["1"].ingest_lag_seconds == 140 * 60 and rows["1"].trade_date == date(2026, 8, 1)
    delta = medallion.silver_delta(sample(parsed)).first()
    assert (delta.bronze_rows, delta.dropped_version, delta.dropped_duplicate, delta.silver_rows) == (5, 1, 1, 3)


def test_silver_drops_older_versions_before_the_shuffle(parsed):
    plan = medallion.silver(sample(parsed))._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_gold_rounds_half_up(parsed):
    rows = medallion.gold(medallion.silver(sample(parsed))).collect()
    first = rows[1]
    assert [r["product"] for r in rows] == ["MGO", "LSMGO"]
    # 200.25 t; mean price (733.85 + 100.005) / 2 = 416.9275
    assert (first.trades, first.total_mt, first.avg_price_usd_per_mt, first.vessels) == (2, Decimal("200.3"), Decimal("416.93"), 1)
    top = medallion.gold_top(medallion.gold(medallion.silver(sample(parsed))), 1).collect()
    assert [(r["rank"], r["product"]) for r in top] == [(1, "MGO")]


def test_gold_at_once_shuffles_its_rows_by_vessel_only(spark, parsed):
    """Before, they were summed by date, too, and shuffled once more; the recomputation shuffled ids as text."""
    bronze = sample(parsed)
    silver = spark.createDataFrame(medallion.silver(bronze).collect(), medallion.silver(bronze).schema)
    gold, of_parts = medallion.gold(silver), medallion.gold_of_parts(medallion.gold_parts(silver))
    plan = gold._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "trade_date" not in plan.split("Exchange hashpartitioning")[-1].split("\n")[0]
    assert gold.schema == of_parts.schema and gold.collect() == of_parts.collect()
    again = reconcile.recompute_gold(bronze)._jdf.queryExecution().executedPlan().toString()
    assert "unhex(" in again.split("Exchange hashpartitioning")[-1]


def test_reconciliation(parsed):
    bronze = sample(parsed)
    gold = medallion.gold(medallion.silver(bronze))
    assert reconcile.gold_differences(bronze, gold).count() == 0
    wrong = gold.withColumn("trades", F.col("trades") + F.when(F.col("product") == "MGO", 1).otherwise(0))
    got = reconcile.gold_differences(bronze, wrong.where("product = 'MGO'")).collect()
    assert {(r["product"], r.measure) for r in got} == {("MGO", "trades")} | {("LSMGO", m) for m in reconcile.MEASURES}


def test_profile(parsed):
    got = {(r.kind, r.label): r.rows for r in reconcile.landing_profile(sample(parsed)).collect()}
    assert got == {
        ("channel", "Batch"): 4, ("channel", "Stream"): 1, ("source", "trading-desk"): 5,
        ("total", "rows"): 5, ("total", "distinct event ids"): 3,
    }


def test_managed_tables(spark, parsed, tmp_path):
    root = str(tmp_path / "landing")
    write_landing(two_days(parsed), root)
    for _ in range(2):
        medallion.refresh(spark, root, "trades_test")
    assert spark.table("trades_test.bronze_landed_events").count() == 3
    assert spark.table("trades_test.silver_bunker_trades").count() == 3
    assert spark.table("trades_test.gold_port_product_volume").first().trades == 3


def test_page(parsed):
    stored = first_valid(parsed(*[record(rid=str(i), tradedAtUtc=f"2026-07-{1 + i % 20:02d}T00:00:00Z") for i in range(60)]))
    page = events_page(stored, EventQuery(limit=7, offset=2)).collect()
    expected = sorted(stored.collect(), key=lambda r: (-r.occurred_at_utc.timestamp(), r.event_id))[2:9]
    assert [r.event_id for r in page] == [r.event_id for r in expected]
    assert EventQuery(limit=100000).page_limit == 500 and EventQuery(limit=0).page_limit == EventQuery(limit=-3).page_limit == 50
    assert EventQuery(offset=-1).page_offset == 0
    info = page_info(events_page(stored, EventQuery(limit=50, offset=40)), EventQuery(limit=50, offset=40)).first()
    assert tuple(info) == (20, 50, 40)


def test_deep_pages_count_past_whole_days_and_minutes(spark, parsed, tmp_path):
    rows = [record(rid=str(i), tradedAtUtc=f"2026-07-{1 + i % 7:02d}T{i % 24:02d}:00:00Z") for i in range(50)]
    root = str(tmp_path / "landing")
    write_landing(first_valid(parsed(*rows)), root)
    stored = read_landed(spark, root)
    expected = [r.event_id for r in stored.orderBy(F.desc("occurred_at_utc"), "event_id").collect()]
    for offset in (0, 1, 7, 8, 30, 49, 50, 500):
        query = EventQuery(limit=9, offset=offset)
        page = events_page(stored, query).collect()
        assert [r.event_id for r in page] == expected[offset:offset + 9]


def test_the_store_rounds_amounts_and_totals_them_again(parsed):
    accepted = first_valid(parsed(record(quantityMt="1.0625", priceUsdPerMt="100.00005")))
    stored = to_store(accepted, clock())
    row = from_store(stored).first()
    assert (row.quantity_mt, row.price_usd_per_mt) == (Decimal("1.063"), Decimal("100.0001"))
    assert (accepted.first().total_usd, row.total_usd) == (Decimal("106.25"), Decimal("106.30"))
    assert "landed_at_utc" in stored.columns and "total_usd" not in stored.columns


def test_filters(parsed):
    stored = first_valid(parsed(record(rid="1"), record("erp", "2", product="MGO"), record(rid="3", tradedAtUtc="2026-07-01")))
    def ids(**query):
        return sorted(r.source_record_id for r in filter_events(stored, EventQuery(**query)).collect())

    assert ids(product="mgo") == ["2"] and ids(port="sgsin") == ["1", "2", "3"]
    assert ids(source_system="erp") == ["2"] and ids(source_system="ERP") == []
    exact = datetime(2026, 8, 1, 6, 45)
    assert ids(from_utc=exact) == ["1", "2"] and ids(to_utc=exact) == ["1", "2", "3"]
    with pytest.raises(ValueError, match="invalid_range"):
        EventQuery(from_utc=datetime(2026, 8, 2), to_utc=datetime(2026, 8, 1))


def test_time_bounds_prune_date_folders(spark, parsed, tmp_path):
    root = str(tmp_path / "landing")
    write_landing(two_days(parsed), root)
    query = EventQuery(from_utc=datetime(2026, 7, 31), port="sgsin")
    found = filter_events(read_landed(spark, root), query)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "GreaterThanOrEqual(OccurredAtUtc" in plan and "EqualTo(Port,SGSIN)" in plan
    assert [r.source_record_id for r in found.collect()] == ["2"]


def test_work_folder_follows_the_session(spark):
    assert work_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert work_path(spark, "x") != work_path(spark, "x")
