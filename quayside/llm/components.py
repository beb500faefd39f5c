"""Connected components of a distributed edge list."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import map_arrow, written

EDGES = "a bigint, b bigint"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> one edge from every node that is not the smallest of its component to the smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def _contract(batches):
    for batch in batches:
        a, b = forest(batch.column("a").to_numpy(), batch.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _to_smallest(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """(node, neighbour) rows with the smallest neighbour of the node; a join, so that hot nodes can be split."""
    return edges.join(keys, "a")


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (node, component): every node that has an edge, and the smallest node it can reach.

    Alternates the two star steps: a node hooks its larger neighbours, then its smaller ones, onto the
    smallest neighbour. Both keep the components, and a logarithmic number of rounds makes stars of them.
    Minima are combined before the shuffle; they come back over a join, whose hot keys adaptive execution
    splits. Rounds are written to the shared folder.
    """
    start = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b")
    current = written(map_arrow(start, _contract, EDGES).distinct(), "edges")
    seen = None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = _to_smallest(both, low).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            _to_smallest(large, low)
            .select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))))
            .where("a <> b")
            .distinct()
        )
        current = written(small, "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        # Every node has one edge, to the smallest node of its component, and a round changes nothing.
        if state == seen:
            break
        seen = state
    stars = current.groupBy("a").agg(F.min("b").alias("component"))
    centres = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.select(F.col("a").alias("node"), "component").union(centres)
