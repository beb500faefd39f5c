"""Near duplicates by MinHash, with odd sketches between the bands and the exact check.

A document's MinHash samples are banded; documents that agree in all rows of a band are candidates. Each
sample is also folded into a parity bitmap (an odd sketch): the number of ones in the XOR of two bitmaps
estimates how many samples differ, most precisely where similarities are high. Candidates whose estimate is
far below the threshold go no further; all others are confirmed on their full shingle sets.

Groups of any size. Equal sets are one class, by a combined minimum. In a bucket, every member is compared with
one leader, which costs a row per member. The leader is the member that meets most others in its bands: copies of
one text meet it more than each other. What that leaves in different components of one bucket is compared and
confirmed in cells of bounded size, which return a forest of links; pairs within a component need no comparison, for
they can't change it. So no link between components is lost that the bands have found: a pair at the threshold
is missed by all 32 bands of four rows with a probability below one in ten million.

Cases. Null or empty texts, and texts without words, have an empty set and link with nothing. Documents that
share a ``doc_id`` are one node. A null ``doc_id`` never links; such rows are kept. Shingles are compared by
64-bit hashes.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.buckets import cells, in_cells, pairs_within, whole_groups
from quayside.llm.common import encoded_words, map_arrow, mixed, shingle_hashes, slices, written
from quayside.llm.components import connected_components, forest

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
# Four and a half standard deviations of the estimate lie between a similarity of 0.8 and this share of it.
SLACK = 0.76
# So often is one member of a bucket compared with all others, before the rest are compared in cells.
LEADERS = 1

SIGNED = "doc_id bigint, n_shingles bigint, set_hash binary, bands array<bigint>, sketch binary"


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_607)
    return draw.integers(0, 2**32, SAMPLES, np.uint32) | np.uint32(1), draw.integers(0, 2**32, SAMPLES, np.uint32)


def minhash(hashes: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over a set of 64-bit hashes."""
    low = np.full(SAMPLES, 2**32 - 1, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 2048):
        np.minimum(low, (short[k : k + 2048, None] * multiply + add).min(axis=0), out=low)
    return low


def odd_sketch(samples: np.ndarray) -> bytes:
    """Parity bitmap of the pairs (hash function, sample)."""
    place = mixed(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(40)))
    ones = np.bincount((place % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(ones.astype(np.uint8)).tobytes()


def most_ones(similarity: float) -> int:
    """So many ones, at most, has the XOR of sketches whose estimate is the similarity."""
    differ = 2 * SAMPLES * (1 - similarity)
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-2 * differ / SKETCH_BITS))))


def distinct_sets(batch: pa.RecordBatch, size: int):
    codes, words, rows = encoded_words(batch.column("text"))
    hashes, starts = shingle_hashes(codes, words, rows, size)
    for k in range(len(batch)):
        yield np.unique(hashes[starts[k] : starts[k + 1]])


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Documents -> set size, hash of the set, band keys and odd sketch."""

    def sign(batches):
        multiply, add = _coefficients()
        power = (np.uint64(0x9E3779B97F4A7C15) ** np.arange(ROWS, dtype=np.uint64))[None, :]
        for batch in slices(batches):
            out = []
            for found in distinct_sets(batch, size):
                if not len(found):
                    out.append((0, None, None, None))
                    continue
                samples = minhash(found, multiply, add)
                keys = ((samples.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * power).sum(axis=1)
                out.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), mixed(keys).view(np.int64), odd_sketch(samples)))
            n, sets, bands, sketches = zip(*out, strict=True)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            columns = [pa.array(c, k) for c, k in zip((n, sets, bands, sketches), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_shingles", "set_hash", "bands", "sketch"])

    return map_arrow(docs.select("doc_id", "text"), sign, SIGNED)


def _close(left: pa.Array, right: pa.Array, limit: int) -> np.ndarray:
    a = np.frombuffer(b"".join(left.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
    b = np.frombuffer(b"".join(right.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
    return np.bitwise_count(a ^ b).sum(axis=1) <= limit


def close_sketches(pairs: DataFrame, sketches: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) whose odd sketches differ in at most ``limit`` bits."""

    def check(batches):
        for batch in batches:
            keep = _close(batch.column("sketch_a"), batch.column("sketch_b"), limit)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(
        sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b"
    )
    return map_arrow(both.select("a", "b", "sketch_a", "sketch_b"), check, "a bigint, b bigint")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``percent`` or more."""
    most = min(len(x), len(y))
    if 100 * most < percent * max(len(x), len(y)):
        return False
    common = most + max(len(x), len(y)) - len(np.union1d(x, y))
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, members): the sorted shingle sets of the documents that ``wanted`` (doc_id) lists, made again and written."""

    def sets(batches):
        for batch in slices(batches):
            found = [s.tobytes() for s in distinct_sets(batch, size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["id", "members"])

    texts = docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", "text")
    return written(map_arrow(texts, sets, "id bigint, members binary"), "shingle-sets")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough; sets are made again for these documents only."""
    members = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), size)

    def check(batches):
        for batch in batches:
            sets = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("set_a", "set_b"))
            keep = [similar(x, y, percent) for x, y in zip(*sets, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(members.select(F.col("id").alias("a"), F.col("members").alias("set_a")), "a").join(
        members.select(F.col("id").alias("b"), F.col("members").alias("set_b")), "b"
    )
    return map_arrow(both.select("a", "b", "set_a", "set_b"), check, "a bigint, b bigint")


BUCKET = ["band", "key"]


def crowded_buckets(classes: DataFrame) -> DataFrame:
    """(band, key, id, weight) of the buckets with several members; ``weight``: whom a member meets in all bands."""
    members = classes.select("id", F.posexplode("bands").alias("band", "key"))
    sizes = members.groupBy(*BUCKET).agg(F.count("*").alias("size")).where("size > 1")
    crowded = written(members.join(sizes, BUCKET), "buckets")
    weights = crowded.groupBy("id").agg(F.sum("size").alias("weight"))
    return written(crowded.drop("size").join(weights, "id"), "buckets")


def _in_components(crowded: DataFrame, placed: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with theirs."""
    rows = crowded.join(placed, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = rows.groupBy(*BUCKET).agg(F.min("component").alias("low_c"), F.max("component").alias("high_c")).where("low_c < high_c")
    return written(rows.join(split.select(*BUCKET), BUCKET), "open-buckets")


def _with_leaders(open_: DataFrame, led: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of each bucket's leader and the members outside its component; no component leads a bucket twice.

    ``led``: the (band, key, id) that led before; the second result adds those of this round.
    """
    before = led.join(open_.select(*BUCKET, "id", "component"), [*BUCKET, "id"]).select(*BUCKET, "component").distinct()
    free = open_.join(before, [*BUCKET, "component"], "left_anti")
    leaders = free.groupBy(*BUCKET).agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"), "component")).alias("top"))
    leaders = leaders.select(*BUCKET, (-F.col("top.minus")).alias("leader"), F.col("top.component").alias("of"))
    pairs = open_.join(leaders, BUCKET).where("component <> of")
    pairs = pairs.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    return pairs, written(led.union(leaders.select(*BUCKET, F.col("leader").alias("id"))), "leaders")


def _cell_rows(open_: DataFrame, classes: DataFrame) -> DataFrame:
    spread = cells(open_.select(*BUCKET, "id", "component"), BUCKET, "id")
    return spread.join(classes.select("id", "sketch", "bands"), "id")


def _close_pairs(batch: pa.RecordBatch, starts: np.ndarray, limit: int):
    """Row numbers of pairs in different components with close sketches, in the first bucket that they share."""
    part, component = batch.column("part").to_numpy(), batch.column("component").to_numpy()
    one, band = batch.column("low").to_numpy() == batch.column("high").to_numpy(), batch.column("band").to_numpy()
    bits = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(len(batch), -1)
    keys = batch.column("bands").flatten().to_numpy().reshape(len(batch), -1)
    for a, b in pairs_within(starts):
        keep = (component[a] != component[b]) & (one[a] | (part[a] != part[b]))
        a, b = a[keep], b[keep]
        keep = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1) <= limit
        a, b = a[keep], b[keep]
        keep = (keys[a] == keys[b]).argmax(axis=1) == band[a] if len(a) else np.zeros(0, bool)
        yield a[keep], b[keep]


def _linked_pair_by_pair(open_: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, limit: int) -> DataFrame:
    """Links (a, b) between components of one bucket: a spanning forest of them per task.

    First the members with any close sketch are found, a row each; then these meet again with their sets and are
    confirmed where they meet. No pair leaves a task unless it is a link that is needed.
    """
    keys = ["cell", *BUCKET, "low", "high"]

    def candidates(batches):
        for batch, starts in whole_groups(batches, keys):
            ids = batch.column("id").to_numpy()
            for a, b in _close_pairs(batch, starts, limit):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(ids[np.concatenate([a, b])]))], ["id"])

    close = map_arrow(in_cells(_cell_rows(open_, classes), BUCKET), candidates, "id bigint")
    close = written(close.distinct(), "close-members")
    members = shingle_sets(docs, close.select(F.col("id").alias("doc_id")), size)
    rows = _cell_rows(open_.join(close, "id", "left_semi"), classes).join(members, "id")

    def confirm(batches):
        for batch, starts in whole_groups(batches, keys):
            ids = batch.column("id").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("members")]
            found = []
            for a, b in _close_pairs(batch, starts, limit):
                found += [(ids[i], ids[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True) if similar(sets[i], sets[j], percent)]
            if found:
                left, right = forest(*np.array(found, np.int64).T)
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])

    return map_arrow(in_cells(rows, BUCKET), confirm, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, n_shingles, component_id, kept; one row per document."""
    signed = written(signatures(docs, size), "signatures")
    linked = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(
        linked.groupBy("set_hash").agg(
            F.min("doc_id").alias("id"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")
        ),
        "classes",
    )
    crowded, sketches = crowded_buckets(classes), classes.select("id", "sketch")
    limit = most_ones(percent / 100 * SLACK)
    pair = "a bigint, b bigint"
    tested = docs.sparkSession.createDataFrame([], pair)
    placed = docs.sparkSession.createDataFrame([], "id bigint, component bigint")
    led = docs.sparkSession.createDataFrame([], "band int, key bigint, id bigint")
    for turn in range(LEADERS + 1):
        open_ = _in_components(crowded, placed)
        if open_.isEmpty():
            break
        if turn < LEADERS:
            pairs, led = _with_leaders(open_, led)
            fresh = written(close_sketches(pairs, sketches, limit).join(tested, ["a", "b"], "left_anti"), "candidates")
            tested = tested.union(fresh)
            found = confirmed(fresh, docs, size, percent)
        else:
            found = _linked_pair_by_pair(open_, classes, docs, size, percent, limit)
        # What is linked already is a star per component; new links join stars.
        stars = placed.select(F.col("id").alias("a"), F.col("component").alias("b")).where("a <> b")
        links = written(found.union(stars), "links")
        placed = written(connected_components(links).withColumnRenamed("node", "id"), "placed")

    of_class = classes.join(placed, "id", "left").select("set_hash", F.coalesce("component", "id").alias("component"))
    # By join, not by class: hot classes are split by adaptive execution.
    return (
        signed.select("doc_id", "n_shingles", "set_hash")
        .join(of_class, "set_hash", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: the one with the smallest ``doc_id``."""
    gone = near_duplicates(docs, size, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
