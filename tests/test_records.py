from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import clock, record
from quayside.contract import ALIASES
from quayside.operators.normalize import is_routable, normalize
from quayside.operators.validate import Rule, failure_summary, rule_counts, trade_rules, validate


def one(df):
    return df.collect()[0]


def test_the_base_record(records):
    row = one(normalize(records(record()), clock()))
    assert row.normalization_error is None
    assert row.event_id == "ece334fd-407d-e3fa-8ae4-734e2aa239d2"
    assert row.total_usd == Decimal("302713.12")  # half-even of 302713.125
    assert row.quantity_mt == Decimal("412.5")
    assert row.occurred_at_utc == row.traded_at_utc == datetime(2026, 8, 1, 6, 45)
    assert (row.event_type, row.schema_version, row.dedup_key) == ("bunker.trade.recorded", 1, "trading-desk:TD-1")


def test_erp_names(records):
    fields = {
        "deal_id": "D-1", "imo": "9241061", "delivery_port": "dkfrc", "fuel_grade": "vlsfo",
        "volume_mt": "1200", "unit_price": "590", "supplier": " Delta Energy DMCC ", "trade_date": "2026-08-01T08:30:00Z",
    }
    row = one(normalize(records(("erp", "E-1", "Batch", fields)), clock()))
    assert (row.trade_reference, row.port, row.product, row.counterparty) == ("D-1", "DKFRC", "VLSFO", "Delta Energy DMCC")
    assert row.quantity_mt == 1200 and row.total_usd == 708000


@pytest.mark.parametrize(
    "change, column, value",
    [
        ({"quantityMt": "1 250,75"}, "quantity_mt", Decimal("1250.75")),
        ({"vesselImo": "IMO 9074729"}, "vessel_imo", "9074729"),
        ({"vesselImo": " imo 9074729 imo"}, "vessel_imo", "9074729"),
        ({"tradedAtUtc": "2026-08-01T10:30:00+02:00"}, "traded_at_utc", datetime(2026, 8, 1, 8, 30)),
        ({"tradeReference": "  ", "trade_ref": " X "}, "trade_reference", " X "),
    ],
)
def test_spellings(records, change, column, value):
    row = one(normalize(records(record(**change)), clock()))
    assert row.normalization_error is None and row[column] == value


def test_missing_field_names_its_aliases(records):
    error = one(normalize(records(record(without=("counterparty",))), clock())).normalization_error
    assert error == (
        "Record 'TD-1' from 'trading-desk' is missing required field 'counterparty' "
        "(accepted aliases: counterparty, counter_party, supplier, seller)."
    )


def test_unreadable_values(records):
    rows = normalize(records(record(quantityMt="eight hundred"), record(tradedAtUtc="2026")), clock()).orderBy("arrival_seq")
    assert [r.normalization_error for r in rows.collect()] == [
        "Field 'quantityMt' on record 'TD-1' is not a number: 'eight hundred'.",
        "Field 'tradedAtUtc' on record 'TD-1' is not a timestamp: '2026'.",
    ]


def test_only_the_first_problem_is_reported_and_time_comes_first(records):
    error = one(normalize(records(record(tradedAtUtc=" ", quantityMt="x", without=("port",))), clock())).normalization_error
    assert "'tradedAtUtc'" in error


def test_own_aliases_can_be_added(records):
    aliases = {**ALIASES, "port": (*ALIASES["port"], "haven")}
    row = one(normalize(records(record(without=("port",), haven="dkfrc")), clock(), aliases))
    assert row.port == "DKFRC"


def test_routable(records):
    df = records(record(), record(tradeReference=" "), record(without=("tradeReference",)))
    assert [r[0] for r in df.select(is_routable()).collect()] == [True, False, False]


def codes(parsed, **changes):
    row = parsed(record(**changes)).first()
    return [(f.field, f.code) for f in row.failures]


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, []),
        ({"vesselImo": "9074720"}, [("vesselImo", "invalid_imo")]),
        ({"port": "Fredericia"}, [("port", "invalid_locode")]),
        ({"product": "JETA1"}, [("product", "unknown_product")]),
        ({"product": "lng"}, []),
        ({"quantityMt": "0"}, [("quantityMt", "out_of_range")]),
        ({"quantityMt": "-5"}, [("quantityMt", "out_of_range")]),
        ({"quantityMt": "25000"}, [("quantityMt", "out_of_range")]),
        ({"quantityMt": "20000"}, []),
        ({"quantityMt": "99999999999999"}, [("quantityMt", "out_of_range")]),
        ({"priceUsdPerMt": "0"}, [("priceUsdPerMt", "out_of_range")]),
        ({"priceUsdPerMt": "5000.01"}, [("priceUsdPerMt", "out_of_range")]),
        ({"tradedAtUtc": "2026-08-03T10:00:00Z"}, [("tradedAtUtc", "future_timestamp")]),
        ({"tradedAtUtc": "2026-08-02T10:02:00Z"}, []),
        ({"tradedAtUtc": "2026-08-02T10:05:00Z"}, []),
        (
            {"vesselImo": "9074720", "product": "JETA1", "priceUsdPerMt": "0"},
            [("vesselImo", "invalid_imo"), ("product", "unknown_product"), ("priceUsdPerMt", "out_of_range")],
        ),
    ],
)
def test_rules(parsed, change, expected):
    assert codes(parsed, **change) == expected


def test_messages(parsed):
    row = parsed(record(vesselImo="123", quantityMt="25000.50", tradedAtUtc="2026-08-03T10:00:00Z")).select(
        failure_summary(F.col("failures"))
    ).first()[0]
    assert row == (
        "vesselImo: '123' is not a valid IMO number (7 digits, last one a check digit).; "
        "quantityMt: Quantity must be greater than 0 and at most 20000 MT, got 25000.50.; "
        "tradedAtUtc: Trade timestamp 2026-08-03T10:00:00.0000000+00:00 is more than 5 minutes ahead of now."
    )


def test_own_rules_can_be_added(records):
    events = normalize(records(record()), clock())
    extra = Rule("counterparty", "sanctioned", F.col("counterparty").startswith("Lantern"), F.lit("No."))
    checked = validate(events, [*trade_rules(events, clock()), extra])
    assert [f.code for f in checked.first().failures] == ["sanctioned"]
    assert [tuple(r) for r in rule_counts(checked).collect()] == [("counterparty", "sanctioned", 1)]


def test_rules_and_aliases_are_not_interpreted_row_by_row(parsed, records):
    """Functions with lambdas are interpreted, with all that is inside them; the usual row must not need any."""
    plan = parsed(record())._jdf.queryExecution().optimizedPlan().toString()
    assert "map_filter" not in plan and "array_compact" not in plan and "isnotnull(lambda" not in plan


def test_a_blank_first_alias_gives_way_to_the_next_filled_one(records):
    blank = {"tradeReference": " ", "trade_reference": None, "trade_ref": "\u00a0", "deal_id": " D-1 ", "dealId": "D-2"}
    rows = normalize(records(record(**blank)), clock()).collect()
    assert [r.trade_reference for r in rows] == [" D-1 "]
