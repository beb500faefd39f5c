"""Checks on what landed: an independent gold recomputation, and a profile of the landed files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.contract import LANDED, SCHEMA_VERSION, pascal
from quayside.plans.medallion import TIE_BREAKERS, with_packed_ids
from quayside.session import stored
from quayside.sources.landed import snake_columns

MEASURES = ("trades", "total_mt", "total_usd", "avg_price_usd_per_mt", "vessels")


def recompute_gold(bronze: DataFrame) -> DataFrame:
    """Gold from bronze by another route: newest version by ``max`` of a struct, sums in whole units.

    Amounts are summed as integers (thousandths, cents, ten-thousandths) and rounded half up by integer
    arithmetic, so an error in decimal typing or rounding on the main route shows up as a difference. Ids are shuffled
    as bytes.
    """
    newest = (
        with_packed_ids(snake_columns(bronze).where(F.col("schema_version") == SCHEMA_VERSION))
        .groupBy("event_id")
        .agg(F.max(F.struct("ingested_at_utc", *TIE_BREAKERS, "total_usd")).alias("v"))
        .select("v.*")
    )

    def units(column: str, scale: int):
        return F.round(F.col(column) * F.lit(10**scale), 0).cast("bigint")

    sums = newest.groupBy("port", "product").agg(
        F.count("*").alias("trades"),
        F.sum(units("quantity_mt", 3)).alias("mt"),
        F.sum(units("total_usd", 2)).alias("usd"),
        F.sum(units("price_usd_per_mt", 4)).alias("price"),
        F.countDistinct("vessel_imo").alias("vessels"),
    )
    return sums.select(
        "port",
        "product",
        "trades",
        (F.expr("(mt + 50) div 100").cast("decimal(20,0)") / 10).cast("decimal(22,1)").alias("total_mt"),
        (F.col("usd").cast("decimal(20,0)") / 100).cast("decimal(28,2)").alias("total_usd"),
        (F.expr("(2 * price + 100 * trades) div (200 * trades)").cast("decimal(20,0)") / 100)
        .cast("decimal(14,2)")
        .alias("avg_price_usd_per_mt"),
        "vessels",
    )


def compare_gold(bronze: DataFrame, gold_rows: DataFrame) -> DataFrame:
    """Every cell of gold beside its recomputation, one row per port, product and measure."""
    keys = ["port", "product"]
    left = gold_rows.select(*keys, *[F.col(m).alias(f"gold_{m}") for m in MEASURES])
    right = recompute_gold(bronze).select(*keys, *[F.col(m).alias(f"bronze_{m}") for m in MEASURES])
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("measure"),
                F.col(f"gold_{m}").cast("decimal(28,2)").alias("gold_value"),
                F.col(f"bronze_{m}").cast("decimal(28,2)").alias("bronze_value"),
            )
            for m in MEASURES
        ]
    )
    joined = left.join(right, keys, "full").select(*keys, F.inline(cells))
    return joined.withColumn("agrees", F.col("gold_value").eqNullSafe(F.col("bronze_value")))


def gold_differences(bronze: DataFrame, gold_rows: DataFrame) -> DataFrame:
    """Cells in which gold and its recomputation differ; no rows means they agree."""
    return compare_gold(bronze, gold_rows).where(~F.col("agrees")).drop("agrees")


def landing_profile(bronze: DataFrame) -> DataFrame:
    """Landed rows by channel and source, with totals and distinct event ids, as label and count."""
    # Read by two aggregations; what is behind the rows is computed once.
    rows = stored(snake_columns(bronze).select("channel", "source_system", "event_id"), "profile")
    grouped = rows.groupingSets(
        [["channel"], ["source_system"]], "channel", "source_system"
    ).agg(F.count("*").alias("rows"), F.grouping("channel").alias("by_source"))
    labelled = grouped.select(
        F.when(F.col("by_source") == 1, "source").otherwise("channel").alias("kind"),
        F.when(F.col("by_source") == 1, F.col("source_system")).otherwise(F.col("channel")).alias("label"),
        "rows",
    )
    totals = rows.agg(F.count("*").alias("all_rows"), F.countDistinct("event_id").alias("event_ids"))

    def total(label: str, column: str):
        return F.struct(F.lit("total").alias("kind"), F.lit(label).alias("label"), F.col(column).alias("rows"))

    overall = totals.select(F.inline(F.array(total("rows", "all_rows"), total("distinct event ids", "event_ids"))))
    return labelled.unionByName(overall)


def schema_differences(bronze: DataFrame) -> list[str]:
    """How the columns of landed files deviate from the contract; empty when they agree."""
    found = {f.name: f.dataType.simpleString() for f in bronze.schema.fields}
    problems = []
    for field in LANDED.fields:
        name, wanted = pascal(field.name), field.dataType.simpleString()
        if name not in found:
            problems.append(f"{name}: missing")
        elif found[name] != wanted:
            problems.append(f"{name}: {found[name]} instead of {wanted}")
    return problems


def landed_by_date(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("dt").agg(F.count("*").alias("rows"))
