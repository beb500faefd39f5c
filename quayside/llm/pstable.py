"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

Vectors are normalised, projected on random Gaussian directions, shifted, and cut into steps of ``WIDTH``; the
steps of ``PROJECTIONS`` directions are a bucket of one of ``TABLES`` tables. Vectors that share a bucket are
compared by their cosine in double precision. Two vectors at the threshold of 0.93 lie 0.374 apart and share
one bucket at least with a probability of 0.99, nearer ones almost surely.

Equal vectors of a label are one class. Buckets of any size are compared in cells of bounded size; a pair that
shares several buckets counts in the first table only. Tasks return link counts and a spanning forest of their
links, never pairs.

Cases. Null labels, null or zero vectors, and vectors with null or non-finite components link with nothing.
Vectors of different lengths are never compared. Rows that share a ``vec_id`` are one node, whose links add up.
Rows with a null ``vec_id`` link with nothing.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.buckets import cells, in_cells, pairs_within, whole_groups
from quayside.llm.common import map_arrow, mixed, written
from quayside.llm.components import connected_components, forest

TABLES, PROJECTIONS, WIDTH = 32, 12, 2.0
THRESHOLD = 0.93
SEED = 51_966


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def bucket_keys(units: np.ndarray) -> np.ndarray:
    """(rows, tables) 64-bit bucket keys."""
    draw = np.random.default_rng([SEED, units.shape[1]])
    directions = draw.standard_normal((units.shape[1], TABLES * PROJECTIONS))
    shift = draw.uniform(0, WIDTH, TABLES * PROJECTIONS)
    steps = np.floor((units @ directions + shift) / WIDTH).astype(np.int64).view(np.uint64)
    key = np.zeros((len(units), TABLES), np.uint64)
    for p in range(PROJECTIONS):
        key = mixed(key * np.uint64(31) + steps[:, p::PROJECTIONS])
    return key.view(np.int64)


def _rows(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _by_length(batch: pa.RecordBatch):
    lengths = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        yield batch.filter(pa.array(lengths == n))


def hash_tables(classes: DataFrame) -> DataFrame:
    """Classes (id, label, embedding) -> a row for each of their buckets."""

    def run(batches):
        for batch in batches:
            for part in _by_length(batch):
                keys = bucket_keys(unit(_rows(part.column("embedding"))))
                n, dim = len(part), len(part.column("embedding")[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column("class").to_numpy(), TABLES)),
                        pa.array(np.repeat(part.column("label").to_numpy(), TABLES), pa.int64()),
                        pa.array(np.full(n * TABLES, dim, np.int32)),
                        pa.array(np.tile(np.arange(TABLES, dtype=np.int32), n)),
                        pa.array(keys.ravel()),
                    ],
                    ["class", "label", "dim", "at", "bucket"],
                )

    schema = "class bigint, label bigint, dim int, at int, bucket bigint"
    return map_arrow(classes.select("class", F.col("label").cast("bigint").alias("label"), "embedding"), run, schema)


LINKED = "class bigint, links bigint, other bigint"


def link_cells(spread: DataFrame, threshold: float) -> DataFrame:
    """Cells -> (class, links) counts and (class, other) forest edges."""
    keys = ["label", "dim", "at", "bucket"]

    def run(batches):
        for batch, starts in whole_groups(batches, ["cell", *keys, "low", "high"]):
            classes, copies = batch.column("class").to_numpy(), batch.column("copies").to_numpy()
            part, at = batch.column("part").to_numpy(), batch.column("at").to_numpy()
            one = batch.column("low").to_numpy() == batch.column("high").to_numpy()
            # A slice of groups of one dimension at a time: lengths differ between labels at most.
            dims = batch.column("dim").to_numpy()
            units, keys_of = [None] * len(batch), np.zeros((len(batch), TABLES), np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                u = unit(_rows(batch.column("embedding").take(pa.array(rows))))
                keys_of[rows] = bucket_keys(u)
                for r, x in zip(rows, u, strict=True):
                    units[r] = x
            edges = []
            for a, b in pairs_within(starts, 1 << 16):
                keep = one[a] | (part[a] != part[b])
                a, b = a[keep], b[keep]
                first = (keys_of[a] == keys_of[b]).argmax(axis=1) == at[a] if len(a) else np.zeros(0, bool)
                a, b = a[first], b[first]
                for dim in np.unique(dims[a]):
                    some = dims[a] == dim
                    x, y = a[some], b[some]
                    if dim == dims.max() == dims.min():
                        if not isinstance(units, np.ndarray):
                            units = np.array(units)
                        cosine = np.einsum("ij,ij->i", units[x], units[y])
                    else:
                        cosine = np.array([units[i] @ units[j] for i, j in zip(x, y, strict=True)])
                    near = cosine >= threshold
                    edges.append(np.stack([x[near], y[near]]))
            if not edges:
                continue
            a, b = np.concatenate(edges, axis=1)
            if not len(a):
                continue
            node, n = np.unique(np.concatenate([a, b]), return_inverse=True)
            links = np.bincount(n, np.concatenate([copies[b], copies[a]])).astype(np.int64)
            child, root = forest(classes[a], classes[b])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([classes[node], child])),
                    pa.array([*links.tolist(), *[None] * len(child)], pa.int64()),
                    pa.array([*[None] * len(node), *root.tolist()], pa.int64()),
                ],
                ["class", "links", "other"],
            )

    return map_arrow(in_cells(spread, keys), run, LINKED)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept; one row per vector."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
        & F.exists("embedding", lambda x: x != 0.0)
    )
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # Zero has two signs; they are one value to a cosine.
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    classes = written(
        rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("class"), F.count("*").alias("copies")), "vectors"
    )
    buckets = written(hash_tables(classes), "tables")
    spread = cells(buckets, ["label", "dim", "at", "bucket"], "class").join(
        classes.select("class", F.col("label").cast("bigint").alias("label"), "copies", "embedding"), ["class", "label"]
    ).where(F.size("embedding") == F.col("dim"))
    linked = written(link_cells(spread, threshold), "linked")
    links = linked.where("links IS NOT NULL").groupBy("class").agg(F.sum("links").alias("links"))
    component = connected_components(linked.where("other IS NOT NULL").select(F.col("class").alias("a"), F.col("other").alias("b")))

    known = (
        classes.join(links, "class", "left")
        .join(component.withColumnRenamed("node", "class"), "class", "left")
        .select(
            "label", "embedding", F.lit(True).alias("usable"), "copies",
            F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class").alias("component"),
        )
    )
    # Equal vectors meet their class by a hash of it; hot classes are split by adaptive execution.
    return rows.join(known, ["label", "embedding", "usable"], "left").select(
        "vec_id",
        F.when(F.col("component").isNull(), F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("bigint").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component", "vec_id")).alias("kept"),
    )
