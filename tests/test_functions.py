import hashlib
import random
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import values
from quayside.functions import (
    business_key,
    clean_number,
    event_id,
    filled_only,
    flat_string_maps,
    imo_is_valid,
    is_blank,
    is_number,
    number_text,
    number_value,
    packed_number,
    parse_timestamp,
    strip,
)
from quayside.functions.identity import packed_id, unpacked_id
from quayside.functions.text import WHITE_SPACE

NUMBERS = [
    ("1 250,75", "1250.75"),
    ("1,234.5", "1234.5"),
    ("1,234", "1.234"),
    (",5", "0.5"),
    (".5", "0.5"),
    ("1.", "1"),
    ("5-", "-5"),
    ("+5", "5"),
    ("-5", "-5"),
    ("1,2,3.4", "123.4"),
    ("  850.5\t", "850.5"),
    ("0", "0"),
]
NOT_NUMBERS = ["1,234,567", "1.234,5", "1e3", "+5-", ",5.2", "1 234.5", "eight hundred", "1.2.3", "-", ".", "--5"]


def read_numbers(spark, texts):
    df = values(spark, texts).withColumn("c", clean_number(packed_number(F.col("v"))))
    rows = df.select("i", is_number(F.col("c")), number_value(F.col("c")), number_text(F.col("c"))).collect()
    return [r[1:] for r in sorted(rows)]


def test_numbers_in_many_spellings(spark):
    got = read_numbers(spark, [t for t, _ in NUMBERS])
    assert [(ok, value) for ok, value, _ in got] == [(True, Decimal(v)) for _, v in NUMBERS]


def test_what_is_not_a_number(spark):
    assert [(ok, value) for ok, value, _ in read_numbers(spark, NOT_NUMBERS)] == [(False, None)] * len(NOT_NUMBERS)


def test_a_number_too_large_for_the_type_is_still_a_number(spark):
    assert read_numbers(spark, ["123456789012345"]) == [(True, None, "123456789012345")]


def test_message_spelling_keeps_the_scale_of_the_source(spark):
    got = read_numbers(spark, ["0,00", "5-", ".5", "007", "25000", "1."])
    assert [text for _, _, text in got] == ["0.00", "-5", "0.5", "7", "25000", "1"]


TIMES = [
    ("2026-08-01T08:30:00Z", "2026-08-01 08:30:00"),
    ("2026-08-01T10:30:00+02:00", "2026-08-01 08:30:00"),
    ("2026-08-01T08:30:00.1234567Z", "2026-08-01 08:30:00.123456"),
    ("2026-08-01T08:30:00", "2026-08-01 08:30:00"),
    ("2026-08-01 08:30", "2026-08-01 08:30:00"),
    ("2026-08-01", "2026-08-01 00:00:00"),
    ("08/01/2026", "2026-08-01 00:00:00"),
    ("8/1/2026 08:30", "2026-08-01 08:30:00"),
    ("08/01/2026 08:30:00", "2026-08-01 08:30:00"),
    ("Sat, 01 Aug 2026 08:30:00 GMT", "2026-08-01 08:30:00"),
    ("2026", None),
    ("not a date", None),
    ("2026-13-45", None),
    ("13/45/2026", None),
    ("", None),
]


def test_timestamps(spark):
    df = values(spark, [t for t, _ in TIMES])
    got = sorted(df.select("i", parse_timestamp(F.col("v")).cast("string")).collect())
    assert [r[1] for r in got] == [t for _, t in TIMES]


def test_strip_and_blank_know_unicode_white_space(spark):
    texts = [WHITE_SPACE, " x　", " a b ", "a", "", None, "​"]
    rows = sorted(values(spark, texts).select("i", strip(F.col("v")), is_blank(F.col("v"))).collect())
    assert [r[1] for r in rows] == ["", "x", "a b", "a", "", None, "​"]
    assert [r[2] for r in rows] == [True, False, False, False, True, True, False]


def test_strip_agrees_with_python_on_random_text(spark):
    rng = random.Random(7)
    alphabet = WHITE_SPACE + "aZ09é-​"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(6))) for _ in range(400)]
    rows = sorted(values(spark, texts).select("i", strip(F.col("v"))).collect())
    assert [r[1] for r in rows] == [t.strip(WHITE_SPACE) for t in texts]


def test_blank_values_drop_out_of_the_map(spark):
    df = spark.createDataFrame([({"a": " x ", "b": None, "c": "\t"},)], "m map<string,string>")
    assert df.select(filled_only(F.col("m"))).first()[0] == {"a": " x "}


@pytest.mark.parametrize(
    "key, expected",
    [
        (("trading-desk", "TD-42"), "696bdebb-58ca-6308-b5b8-5e61fdb430c5"),
        (("erp", "E-1"), "09b39500-c5f9-fb75-d8ed-f9bb88c186ef"),
        (("port-telemetry", "PT-1"), "3d5cfff3-dc4b-8b16-e90d-18dd8bd1cc3a"),
    ],
)
def test_event_id(spark, key, expected):
    got = spark.range(1).select(event_id(business_key(F.lit(key[0]), F.lit(key[1])))).first()[0]
    assert got == expected
    assert got == str(uuid.UUID(bytes_le=hashlib.sha256(":".join(key).encode()).digest()[:16]))


def test_imo_check_digit(spark):
    good = ["9074729", "9241061", "9321483", "9454125", "9632959"]
    bad = ["9074720", "907472", "90747299", "90A4729", "", None, "907472٩", "9074729\n"]
    rows = sorted(values(spark, good + bad).select("i", imo_is_valid(F.col("v"))).collect())
    assert [r[1] for r in rows] == [True] * len(good) + [False] * len(bad)


JSON = [
    ('{"a":"1","b":null}', {"a": "1", "b": None}),
    ('{"a":"1","a":"2"}', {"a": "2"}),
    ("{}", {}),
    ('  {"a":"x"}  ', {"a": "x"}),
    ('{"a":1}', None),
    ('{"a":true}', None),
    ('{"a":{"b":"c"}}', None),
    ('{"a":["b"]}', None),
    ('[{"a":"x"}]', None),
    ("null", None),
    ("junk", None),
    ("", None),
    ('{"a":"x"} trailing', None),
    ('{"a":"x"},{"b":"y"}', None),
    ("{'a':'x'}", None),
    ('{"a":"x"', None),
    (None, None),
]


def test_flat_string_maps_are_strict(spark):
    decoded = flat_string_maps(values(spark, [t for t, _ in JSON]), F.col("v"))
    assert decoded.columns == ["i", "v", "fields"]
    rows = decoded.select("i", "fields").orderBy("i").collect()
    assert [r[1] for r in rows] == [m for _, m in JSON]


def test_packed_ids_come_back_as_they_were(spark):
    """Sixteen bytes are a GUID's alone; any other text, null and empty ones too, stays apart and comes back."""
    guid = "0f1e2d3c-4b5a-6978-8796-a5b4c3d2e1f0"
    texts = [guid, guid.upper(), guid + "\n", bytes.fromhex(guid.replace("-", "")).decode("latin-1"), "sixteen letters!", "", " ", "\0", "Ærø", None]
    packed = values(spark, texts).withColumn("p", packed_id(F.col("v"))).withColumn("back", unpacked_id(F.col("p")))
    rows = packed.orderBy("i").collect()
    assert [r.back for r in rows] == texts
    assert len({None if r.p is None else bytes(r.p) for r in rows}) == len(texts)
    assert [r.p is not None and len(r.p) == 16 for r in rows] == [True] + [False] * (len(texts) - 1)
