import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quayside.contract import SOURCE_RECORD  # noqa: E402
from quayside.operators.classify import parse  # noqa: E402
from quayside.session import build_session  # noqa: E402

CLOCK = "2026-08-02T10:00:00Z"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = build_session(
        "tests",
        "local[4]",
        spark__driver__memory="4g",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(warehouse),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("work")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def clock(text=CLOCK):
    return F.lit(text).cast("timestamp")


BASE = {
    "tradeReference": "QD/2026/0417",
    "vesselImo": "9321483",
    "port": "SGSIN",
    "product": "LSMGO",
    "quantityMt": "412.5",
    "priceUsdPerMt": "733.85",
    "counterparty": "Lantern Bay Bunkers",
    "tradedAtUtc": "2026-08-01T06:45:00Z",
}


def record(source="trading-desk", rid="TD-1", channel="Batch", without=(), **changes):
    fields = {k: v for k, v in {**BASE, **changes}.items() if k not in without}
    return (source, rid, channel, fields)


@pytest.fixture
def records(spark):
    """Records in arrival order -> source-record frame."""

    def build(*rows):
        return spark.createDataFrame([(*r, (0, "", i)) for i, r in enumerate(rows)], SOURCE_RECORD)

    return build


@pytest.fixture
def parsed(records):
    def build(*rows):
        return parse(records(*rows), clock())

    return build


def values(spark, texts):
    """One-column frame ``v`` with a position ``i``."""
    return spark.createDataFrame(list(enumerate(texts)), "i int, v string")


def column(df, expression):
    """Values of an expression in row order."""
    return [r[1] for r in sorted(df.select("i", expression.alias("x")).collect())] if "i" in df.columns else [
        r[0] for r in df.select(expression).collect()
    ]
