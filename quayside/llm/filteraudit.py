"""What every filter of a set removes, in every order in which the set can be applied.

Each document becomes a mask of the filters that it fails; masks are counted per part. A recursive query extends
prefixes of filters by the letters they do not have yet, joins the cells of the part, carries the bits applied so far,
and so gives at each level the counts of that step. Prefixes are shared by all orders that start with them.

Cases: a null text is the empty one, which has no words. A null id is neither smaller nor larger than another: such a
document is never a later copy, makes no other one a copy, and has no labels. Repeated rows count each; rows of one id
are no copies of each other. Several labels of an id count as one that has each flag that any of them has. Parts
without documents have no rows; no documents, no rows. Other columns are left aside.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import ASCII_SPACE, encoded_words, map_arrow, slices, text_buffers, written
from quayside.session import work_path

# Words keep their case here.
CASED_WORDS = np.arange(256, dtype=np.uint8)
CASED_WORDS[list(ASCII_SPACE)] = 0x20
MARKS = np.zeros(256, bool)
MARKS[list(b"#$%&*|")] = True

FAULTS = "doc_id bigint, part string, mask int, name binary"


def _within(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many flags are set in every row."""
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(upto[rows])


def _faults(batches):
    """Masks of filters A to D, from the lowest bit, and a name that only equal texts share."""
    for batch in slices(batches):
        raw, rows = text_buffers(batch.column("text"))
        codes, vocabulary, at = encoded_words(batch.column("text"), CASED_WORDS)
        words = np.diff(at)
        width = max(len(vocabulary), 1)
        pairs = np.unique(np.repeat(np.arange(len(words)), words) * width + codes)
        distinct = np.bincount(pairs // width, minlength=len(words))
        points = _within((raw & 0xC0) != 0x80, rows)
        capitals = _within((raw >= ord("A")) & (raw <= ord("Z")), rows)
        fails = (words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * points, _within(MARKS[raw], rows) > 0)
        mask = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
        names = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(rows[:-1], rows[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(mask, pa.int32()), pa.array(names, pa.binary())],
            ["doc_id", "part", "mask", "name"],
        )


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents -> (part, mask, n, good, toxic): how many of a part fail exactly the filters of the mask.

    The last filter finds later copies. A text's smallest id is a minimum, combined before the shuffle, and comes back
    by text and id, a key that one document has; so a text that a third of all documents share burdens no task.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    faults = written(map_arrow(rows, _faults, FAULTS), "faults")
    flags = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(*(F.coalesce(F.max((F.col(c) == 1).cast("bigint")), F.lit(0)).alias(c) for c in ("quality", "toxic")))
    )
    known = faults.where("doc_id is not null")
    first = known.groupBy("name").agg(F.min("doc_id").alias("doc_id")).withColumn("copy", F.lit(0))
    judged = (
        known.groupBy("doc_id", "name", "part", "mask")
        .agg(F.count("*").alias("n"))
        .join(first, ["doc_id", "name"], "left")
        .join(flags, "doc_id", "left")
        .select(
            "part",
            F.col("mask").bitwiseOR(F.coalesce("copy", F.lit(16))).alias("mask"),
            "n",
            (F.col("n") * F.coalesce("quality", F.lit(0))).alias("good"),
            (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
    )
    unnamed = faults.where("doc_id is null").select("part", "mask", *(F.lit(n).cast("bigint").alias(c) for n, c in ((1, "n"), (0, "good"), (0, "toxic"))))
    return judged.unionByName(unnamed).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def _total(condition: str, what: str) -> str:
    return f"aggregate(filter(cells, c -> {condition}), 0L, (t, c) -> t + c.{what})"


# The fields of a level: documents without any failure so far, and what the new filter does to those of its cells.
METRICS = {
    "kept": _total("c.mask & (applied | bit) = 0", "n"),
    "removed": _total("c.mask & applied = 0 AND c.mask & bit <> 0", "n"),
    "redundant": _total("c.mask & applied <> 0 AND c.mask & bit <> 0", "n"),
    "unique_fails": _total("c.mask = bit", "n"),
    "good_lost": _total("c.mask & applied = 0 AND c.mask & bit <> 0", "good"),
    "toxic_lost": _total("c.mask & applied = 0 AND c.mask & bit <> 0", "toxic"),
}

# Every level adds one of the letters that a prefix has not used yet.
WALK = f"""
WITH RECURSIVE walk AS (
    SELECT part, '' AS prefix, 0 AS applied, 0 AS step, '' AS letter, {", ".join(f"0L AS {m}" for m in METRICS)}
    FROM {{cells}}
    UNION ALL
    SELECT part, concat(prefix, letter), applied | bit, step + 1, letter, {", ".join(METRICS.values())}
    FROM (
        SELECT w.part, w.prefix, w.applied, w.step, next.letter, next.bit, p.cells
        FROM (
            SELECT part, prefix, applied, step,
                explode(filter({{letters}}, l -> applied & l.bit = 0)) AS next
            FROM walk) w
        JOIN {{cells}} p ON w.part = p.part))
SELECT part, prefix, step, letter, {", ".join(METRICS)} FROM walk WHERE step > 0
"""


def filter_orders(cells: DataFrame, letters: str) -> DataFrame:
    """Cells (part, mask, n, good, toxic) -> one row per part, order of all letters and step.

    Bit i of a mask belongs to letter i. The recursion holds a row per part and prefix; its packed cells are at most
    one per mask. It is run in a session of its own, whose limit for the rows of a recursion is lifted, and written.
    """
    spark = cells.sparkSession
    packed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    at, to = work_path(spark, "cells"), work_path(spark, "steps")
    packed.write.parquet(at)
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name) and own.conf.get(name, None) != value:
            own.conf.set(name, value)
    own.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    alphabet = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << i})" for i, c in enumerate(letters))
    own.read.schema(packed.schema).parquet(at).createOrReplaceTempView("mask_cells")
    walk = own.sql(WALK.format(cells="mask_cells", letters=f"array({alphabet})"))
    walk.write.parquet(to)
    steps = spark.read.schema(walk.schema).parquet(to)
    n = len(letters)
    # A prefix of k letters starts (n - k)! orders.
    shares = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * F.factorial(F.lit(n) - F.col("step"))).alias("shapley"))
    orders = steps.where(F.col("step") == n).select("part", F.col("prefix").alias("filter_order"))
    return (
        orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
        .join(steps, ["part", "prefix", "step"])
        .join(shares, ["part", "letter"])
        .select("part", "filter_order", "step", *METRICS, "shapley")
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of filters A to E on documents, for every part, order and step."""
    return filter_orders(mask_cells(docs, labels), "ABCDE")
