"""Comparing the members of buckets with each other, without a task or a row count that grows with one bucket.

A bucket of any size is cut into parts of about ``PART`` members. A cell holds two parts (or one twice); every
pair of members meets in exactly one cell, so a large bucket becomes many equal tasks.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 512
# Pairs that are compared at a time.
PAIRS = 1 << 18


def cells(members: DataFrame, keys: list[str], node: str) -> DataFrame:
    """Members in their cells: adds ``part``, ``low`` and ``high``. Buckets of one member are left out."""
    sizes = members.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / PART).cast("int")
    return (
        members.join(sizes, keys)
        .withColumn("part", F.pmod(F.xxhash64(node, F.lit("part")), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("low", F.least("part", "other"))
        .withColumn("high", F.greatest("part", "other"))
        .drop("other", "size")
    )


def in_cells(members: DataFrame, keys: list[str]) -> DataFrame:
    """Cells brought together: one task has all of a cell, its rows one after another."""
    by = [*keys, "low", "high"]
    cell = F.xxhash64(*by)
    return members.withColumn("cell", cell).repartition("cell").sortWithinPartitions("cell", *by)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of sorted rows -> (rows, group starts and their end); no group is cut by a batch."""
    rest: list[pa.RecordBatch] = []

    def ready(batch):
        change = np.zeros(max(len(batch) - 1, 0), bool)
        for k in keys:
            c = batch.column(k)
            change |= c.slice(1).fill_null(0).to_numpy(zero_copy_only=False) != c.slice(0, len(c) - 1).fill_null(0).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero(change) + 1, [len(batch)]])

    for batch in batches:
        if not len(batch):
            continue
        rest.append(batch)
        joined = pa.Table.from_batches(rest).combine_chunks().to_batches()[0] if len(rest) > 1 else batch
        starts = ready(joined)
        last = int(starts[-2])
        rest = [joined.slice(last)]
        if last:
            yield joined.slice(0, last), starts[:-1]
    if rest:
        yield rest[0], np.array([0, len(rest[0])])


def pairs_within(starts: np.ndarray, limit: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of row numbers within the groups, about ``limit`` at a time."""
    sizes = np.diff(starts)
    end = np.repeat(starts[1:], sizes)
    rows = np.arange(len(end))
    later = end - rows - 1
    upto = np.cumsum(later)
    done = 0
    while done < len(rows):
        base = upto[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(upto, base + limit, side="right")))
        some = rows[done:stop]
        n = later[done:stop]
        left = np.repeat(some, n)
        right = left + 1 + np.arange(len(left)) - np.repeat(upto[done:stop] - n - base, n)
        if len(left):
            yield left, right
        done = stop
