"""Trade records derived from the driver's tables.

Order lines become trade records from three source systems in three dialects. ``(l_orderkey,
l_linenumber)`` repeats in the data, so replays occur naturally. Every definition here has its SQL twin in
``oracle.py``.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.contract import camel
from quayside.functions.once import evaluate_once

AS_OF = "2026-08-02 10:00:00"
# Instant for the data-quality queries: some trades lie in its future.
DQ_AS_OF = "2001-06-01 00:00:00"
# Records that arrived before this day are history for the queries that need one.
CUT_DAY = 10400  # days since 1970-01-01: 1998-06-23

ARRIVAL_DAY_UNIT = 2**36

ERP_ALIASES = {
    "trade_reference": "deal_id",
    "vessel_imo": "imo",
    "port": "delivery_port",
    "product": "fuel_grade",
    "quantity_mt": "volume_mt",
    "price_usd_per_mt": "unit_price",
    "counterparty": "supplier",
    "traded_at_utc": "trade_date",
}
TEXTS = tuple(ERP_ALIASES)


def as_of(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letter(n: Column) -> Column:
    return F.char((F.lit(65) + n % 26).cast("int"))


def check_digit(base: Column) -> Column:
    digits = [F.floor(base / F.lit(10**p)).cast("bigint") % 10 for p in range(5, -1, -1)]
    return sum((d * w for d, w in zip(digits[1:], (6, 5, 4, 3, 2))), digits[0] * 7) % 10


def derive_lines(spark: SparkSession, sf_dir: str, order_lines: DataFrame | None = None) -> DataFrame:
    """Order lines with the plain (not yet spelled out) values of the trades they stand for.

    ``order_lines``: the rows of ``lineitem`` that are wanted, if not all.
    """
    # Dealt out by the join with the parts: the tables come as one file with one row group, and what follows is costly
    # per row. Parts grow with the lines, so this one shuffle has to serve both; the lines stream past them unsorted.
    li = table(spark, sf_dir, "lineitem") if order_lines is None else order_lines
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type").hint("shuffle_hash")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    joined = li.join(part, li.l_partkey == part.p_partkey).join(supplier, li.l_suppkey == supplier.s_suppkey)

    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    row_text = F.concat_ws(
        "|",
        *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        F.col("l_quantity").cast("int").cast("string"),
        cents.cast("string"),
        F.round(F.col("l_discount") * 100).cast("int").cast("string"),
        F.round(F.col("l_tax") * 100).cast("int").cast("string"),
        "l_returnflag",
        "l_linestatus",
    )
    shipped = F.col("l_shipdate").cast("timestamp")
    base = F.lit(900000) + F.col("l_partkey") % 99999
    nation = F.col("s_nationkey")
    return (
        joined.withColumns(
            {
                "dialect": F.col("l_linenumber") % 3,
                "source_record_id": F.concat(
                    F.lit("LI-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")
                ),
                "arrival_day": F.unix_date(F.to_date(shipped)).cast("bigint"),
                "arrival_tie": F.conv(F.substring(F.md5(row_text), 1, 9), 16, 10).cast("bigint"),
                "imo_base": base,
                "traded_at": shipped + F.make_dt_interval(mins=(F.col("l_orderkey") % 1440).cast("int")),
            }
        )
        .withColumns(
            {
                "source_system": F.element_at(
                    F.array(F.lit("trading-desk"), F.lit("erp"), F.lit("port-telemetry")), F.col("dialect") + 1
                ),
                "channel": F.element_at(
                    F.array(F.lit("Batch"), F.lit("Stream"), F.lit("Api")), (F.col("l_suppkey") % 3 + 1).cast("int")
                ),
                "arrival_seq": F.col("arrival_day") * F.lit(ARRIVAL_DAY_UNIT) + F.col("arrival_tie"),
                "imo": F.concat(
                    F.col("imo_base").cast("string"),
                    (
                        (check_digit(F.col("imo_base")) + F.when(F.col("l_partkey") % 7 == 0, 1).otherwise(0)) % 10
                    ).cast("string"),
                ),
                "locode": F.when(nation % 11 == 3, "Fredericia").otherwise(
                    F.concat(letter(nation), letter(nation * 7), letter(nation * 11), F.lit("P"), letter(nation % 5))
                ),
                "grade": F.element_at(
                    F.create_map(
                        *[
                            F.lit(x)
                            for pair in (
                                ("STANDARD", "VLSFO"), ("SMALL", "HSFO"), ("LARGE", "LSMGO"),
                                ("PROMO", "MGO"), ("ECONOMY", "ULSFO"), ("MEDIUM", "JETA1"),
                            )
                            for x in pair
                        ]
                    ),
                    F.col("p_type"),
                ),
                "tonnes": F.when(F.col("l_orderkey") % 97 == 0, 0).otherwise(F.col("l_quantity") * 25).cast("bigint"),
                "dollars": F.lit(450) + F.col("l_partkey") % 250,
                "cents": F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0"),
                "party": F.when(F.col("l_orderkey") % 89 != 0, F.col("s_name")),
                "received_at": F.col("traded_at")
                + F.make_dt_interval(
                    secs=(F.lit(1) + (F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 90000).cast("int")
                ),
            }
        )
    )


def grouped(n: Column, mark: str) -> Column:
    """Whole number with a thousands mark (values below one million)."""
    return F.when(n < 1000, n.cast("string")).otherwise(
        F.concat(F.floor(n / 1000).cast("string"), F.lit(mark), F.lpad((n % 1000).cast("string"), 3, "0"))
    )


def spelled(trades: DataFrame) -> DataFrame:
    """Add ``t_<field>``: each value as the record's dialect spells it."""
    d = F.col("dialect")

    def by_dialect(desk, erp, telemetry):
        return F.when(d == 0, desk).when(d == 1, erp).otherwise(telemetry)

    ref = F.col("l_orderkey").cast("string")
    return trades.withColumns(
        {
            "t_trade_reference": F.concat(by_dialect(F.lit("TR-"), F.lit("D-"), F.lit("TR-8")), ref),
            "t_vessel_imo": by_dialect(F.col("imo"), F.concat(F.lit(" imo "), F.col("imo")), F.col("imo")),
            "t_port": by_dialect(F.col("locode"), F.concat(F.lower("locode"), F.lit(" ")), F.col("locode")),
            "t_product": by_dialect(F.col("grade"), F.lower("grade"), F.concat(F.lit("\t"), F.col("grade"))),
            "t_quantity_mt": by_dialect(
                F.col("tonnes").cast("string"),
                F.concat(grouped(F.col("tonnes"), " "), F.lit(",00")),
                F.concat(grouped(F.col("tonnes"), ","), F.lit(".00")),
            ),
            "t_price_usd_per_mt": F.concat(
                F.col("dollars").cast("string"), by_dialect(F.lit("."), F.lit(","), F.lit(".")), F.col("cents")
            ),
            "t_counterparty": by_dialect(F.col("party"), F.concat(F.lit(" "), F.col("party"), F.lit("  ")), F.col("party")),
            "t_traded_at_utc": by_dialect(
                F.date_format("traded_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                F.concat(
                    F.date_format(F.col("traded_at") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"),
                    F.lit("+02:00"),
                ),
                F.date_format("traded_at", "yyyy-MM-dd HH:mm"),
            ),
        }
    )


def packed_arrival(arrival: Column) -> Column:
    """The arrival order of the derived trades as one number, for results; the tie is below ``ARRIVAL_DAY_UNIT``."""
    return arrival["at"] * F.lit(ARRIVAL_DAY_UNIT) + arrival["position"]


def arrival_micros() -> Column:
    """The arrival order of the derived trades as instants, in microseconds; the tie is less than a day."""
    return F.col("arrival_seq.at") * F.lit(86_400_000_000) + F.col("arrival_seq.position")


def lines(spark: SparkSession, sf_dir: str, order_lines: DataFrame | None = None) -> DataFrame:
    """The derived trades, plain and spelled out, of all order lines or of some.

    Nothing is written: a query derives the columns that it needs, and shuffles only what these are made of.
    """
    return spelled(derive_lines(spark, sf_dir, order_lines)).drop("imo_base", "p_type", "s_nationkey", "p_partkey", "s_suppkey")


def as_records(trades: DataFrame, *extra: str) -> DataFrame:
    """Spelled trades -> source records with the field names of their dialect."""

    def names(dialect: int) -> Column:
        pairs: list[Column] = [F.lit("sourceRecordId"), F.col("source_record_id")]
        if dialect == 2:
            # A blank value under the first-choice name must not hide the one under a later name.
            pairs += [F.lit("tradeReference"), F.lit("  "), F.lit("trade_ref"), F.col("t_trade_reference")]
        for field in TEXTS:
            if dialect == 2 and field == "trade_reference":
                continue
            pairs += [F.lit(ERP_ALIASES[field] if dialect == 1 else camel(field)), F.col(f"t_{field}")]
        return F.create_map(*pairs)

    fields = F.when(F.col("dialect") == 0, names(0)).when(F.col("dialect") == 1, names(1)).otherwise(names(2))
    arrival = F.struct(
        F.col("arrival_day").alias("at"), F.lit("").alias("lane"), F.col("arrival_tie").alias("position")
    ).alias("arrival_seq")
    plain = trades.select("source_system", "source_record_id", "channel", arrival, *extra, fields.alias("map"))
    # As opaque as a scanned map: later lookups must not be rewritten into the expressions behind it.
    return evaluate_once(plain, {"fields": F.col("map")}).drop("map")


def source_records(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return as_records(lines(spark, sf_dir), *extra)


def damaged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which many lack a field or hold an unreadable one."""
    t = lines(spark, sf_dir)
    k = F.col("l_orderkey") % 13

    def hurt(field: str, cases: dict[int, str | None]) -> Column:
        value = F.col(f"t_{field}")
        for case, text in cases.items():
            value = F.when(k == case, F.lit(text)).otherwise(value)
        return value

    return as_records(
        t.withColumns(
            {
                "t_traded_at_utc": hurt("traded_at_utc", {0: None, 1: "not a date", 10: None}),
                "t_trade_reference": hurt("trade_reference", {2: "  "}),
                "t_vessel_imo": hurt("vessel_imo", {3: None}),
                "t_port": hurt("port", {4: ""}),
                "t_product": hurt("product", {5: None}),
                "t_quantity_mt": hurt("quantity_mt", {6: "eight hundred", 10: "1e3"}),
                "t_price_usd_per_mt": hurt("price_usd_per_mt", {7: None, 8: "1.234,5"}),
                "t_counterparty": hurt("counterparty", {9: " "}),
            }
        )
    )


def publish_errors(records: DataFrame, part_key: str = "l_partkey") -> DataFrame:
    """Records of which some could not be published."""
    return records.withColumn(
        "publish_error",
        F.when(F.col(part_key) % 11 == 0, "publish_transient").when(F.col(part_key) % 11 == 1, "publish_permanent"),
    )
