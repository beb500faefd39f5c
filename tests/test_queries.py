"""Registered queries against their SQL at the smallest scale."""

import os

import duckdb
import pytest

from quayside.contract import LANDED_COLUMNS
from quayside.session import work_root
from workload.inputs import derive_lines
from workload.oracle import oracle
from workload.queries import registered

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# Those that write many date folders or run streams are left to the driver's comparison and their own tests.
SLOW = {"bronze_scan", "compact_partition", "land_trade_rows", "stream_ingest", "landed_count", "landed_by_date",
        "events_filtered", "events_page", "events_deep_page", "events_page_after", "events_page_info", "bus_landing",
        "bus_landing_letters", "stream_counts", "stream_all_channels"}
QUERIES = registered()
NAMES = [n for n in QUERIES if n not in SLOW]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def test_every_query_has_sql():
    assert set(oracle()) == set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = duck.execute(oracle()[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    expected = [tuple(plain(r[names.index(c)]) for c in columns) for r in rows.fetchall()]
    actual = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert sorted(actual, key=repr) == sorted(expected, key=repr)


def test_outcome_counts_of_the_source_records(spark):
    counts = {r.outcome: r.records for r in QUERIES["outcome_totals"](spark, SF).collect()}
    assert counts == {"Accepted": 3099, "Duplicate": 606, "Rejected": 61 + 2234, "Failed": 0}


def test_deriving_the_trades_writes_nothing_and_reads_few_columns(spark):
    """Before, the first query of a session wrote all columns of all trades, whatever it needed."""
    before = set(os.listdir(f"{work_root(spark)}/quayside/{spark.sparkContext.applicationId}")) if os.path.isdir(
        f"{work_root(spark)}/quayside/{spark.sparkContext.applicationId}") else set()
    found = QUERIES["src_missing_record_id"](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    folder = f"{work_root(spark)}/quayside/{spark.sparkContext.applicationId}"
    assert not os.path.isdir(folder) or set(os.listdir(folder)) == before
    assert "l_orderkey" in plan and "md5" not in plan
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in line and "l_orderkey" in line]
    assert scans and all("l_extendedprice" not in line for line in scans)


def written(spark, name):
    """Folders of intermediates of that name."""
    folder = f"{work_root(spark)}/quayside/{spark.sparkContext.applicationId}"
    return {f"{folder}/{n}" for n in (os.listdir(folder) if os.path.isdir(folder) else ()) if n.startswith(f"{name}-")}


def test_classifying_writes_only_what_outcomes_are_made_of(spark):
    """Before, whole records with all their fields were written for a result without them."""
    before = written(spark, "parsed")
    QUERIES["classify_outcomes"](spark, SF)
    (new,) = written(spark, "parsed") - before
    assert "fields" not in spark.read.parquet(new).columns


@pytest.mark.parametrize("name", ["dead_letter_replay", "landing_profile"])
def test_what_several_branches_read_is_parsed_once(spark, name):
    """Before, branches of the result derived and parsed the trades again."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "trade_ref" not in plan


def test_lines_are_shuffled_once_for_parts_of_any_number(spark):
    """Before, they were dealt out first, and shuffled and sorted again once parts were too many to broadcast."""
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40KB")
    try:
        plan = derive_lines(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("hashpartitioning(l_") == 1


def test_refused_requests_are_left_out_as_order_lines(spark):
    """Before, the records of all requests were made and shuffled whole to find the admitted ones, twice."""
    before = written(spark, "admitted-lines")
    QUERIES["batch_summary"](spark, SF)
    (new,) = written(spark, "admitted-lines") - before
    assert "request_id" not in spark.read.parquet(new).columns and "fields" not in spark.read.parquet(new).columns


def test_fragments_are_written_in_the_columns_that_land(spark):
    """Before, all that parsing adds was written, too."""
    before = written(spark, "fragments")
    QUERIES["compact_partition"](spark, SF)
    (new,) = written(spark, "fragments") - before
    assert set(spark.read.parquet(new).columns) == {*LANDED_COLUMNS, "l_orderkey"}


@pytest.mark.parametrize("name", ["silver_upsert", "gold_refresh"])
def test_rounds_are_not_written_before_they_are_merged(spark, name):
    """Before, all parsed lines were written with all columns, and read again by each round."""
    known = written(spark, "rounds") | written(spark, "events")
    QUERIES[name](spark, SF)
    assert written(spark, "rounds") | written(spark, "events") == known
