"""The live folders of a dataset of micro-batches.

A dataset has a folder per micro-batch (``batch_id=n``) and runs: what compaction made of neighbouring batches. The
newest manifest lists the runs and the last batch they cover. Readers open the listed runs and the batches after
them, by name; they never walk the dataset's root, where folders that were replaced may wait for their removal.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BATCH = "batch_id="
MANIFEST = T.StructType(
    [
        T.StructField("folder", T.StringType()),
        T.StructField("first", T.LongType()),
        T.StructField("last", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("bits", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class Run:
    """Batches ``first`` to ``last`` in one folder below the root; ``bits`` of a key's hash number its buckets."""

    folder: str
    first: int
    last: int
    bytes: int
    bits: int = 0


@dataclass(frozen=True)
class Live:
    """What a dataset consists of: runs, the last batch they cover (-1: none), and the batches after it."""

    runs: tuple[Run, ...]
    upto: int
    batches: tuple[int, ...]


def batch_folder(root: str, batch_id: int) -> str:
    """Where a micro-batch keeps its part of a dataset."""
    return f"{root}/{BATCH}{batch_id}"


def run_folder(first: int, last: int) -> str:
    """Where a run is kept, below the root; plain scans of the root pass it over."""
    return f"_runs/{first}-{last}"


def manifests(root: str) -> str:
    return f"{root}/_manifests"


def _path(spark: SparkSession, path: str):
    """The path and its file system, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _path(spark, path)
    return store.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder: one listing. A folder that does not exist has none."""
    at, store = _path(spark, path)
    return [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []


def folder_bytes(spark: SparkSession, path: str) -> int:
    at, store = _path(spark, path)
    return store.getContentSummary(at).getLength() if store.exists(at) else 0


def remove(spark: SparkSession, path: str) -> None:
    at, store = _path(spark, path)
    store.delete(at, True)


def manifest_versions(spark: SparkSession, root: str) -> list[int]:
    """Last batches of the manifests that were finished, newest first. One that has no file yet was never committed."""
    found = sorted((int(n) for n in children(spark, manifests(root)) if n.isdigit()), reverse=True)
    return [v for v in found if any(n.startswith("part-") for n in children(spark, f"{manifests(root)}/{v}"))]


def read_manifest(spark: SparkSession, root: str, version: int) -> tuple[Run, ...]:
    rows = spark.read.schema(MANIFEST).parquet(f"{manifests(root)}/{version}").collect()
    return tuple(sorted((Run(*r) for r in rows), key=lambda r: r.first))


def live_folders(spark: SparkSession, root: str) -> Live:
    """What readers open now."""
    versions = manifest_versions(spark, root)
    upto = versions[0] if versions else -1
    runs = read_manifest(spark, root, upto) if versions else ()
    ids = sorted(int(n.removeprefix(BATCH)) for n in children(spark, root) if n.startswith(BATCH))
    return Live(runs, upto, tuple(i for i in ids if i > upto))


def with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields)).add("batch_id", T.LongType())


def read_live(
    spark: SparkSession, root: str, schema: T.StructType, live: Live | None = None, before: int | None = None
) -> DataFrame:
    """The dataset with its ``batch_id``. ``before``: only batches before that one."""
    live = live or live_folders(spark, root)
    schema = with_batch(schema)
    folders = [batch_folder(root, b) for b in live.batches if before is None or b < before]
    frames = []
    if folders:
        frames.append(spark.read.schema(schema).option("basePath", root).parquet(*folders).select(*schema.fieldNames()))
    for run in live.runs:
        if before is None or run.first < before:
            kept = spark.read.schema(schema).parquet(f"{root}/{run.folder}").select(*schema.fieldNames())
            frames.append(kept if before is None or run.last < before else kept.where(f"batch_id < {before}"))
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)
