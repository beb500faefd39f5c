"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a target of words; a document of it is taken ``target / source words`` times on average. The
whole part of that ratio is certain. The fractional part is an inclusion probability, and the cube method rounds
the probabilities of a source to zeros and ones while two totals stand still: its documents and its words.

* Flight. Three undecided documents always have a direction in which both totals stay; the probabilities move
  along it, one way or the other by chance, until one of them is decided. It costs a step per document.
* Sources are cut into blocks of bounded size, which fly apart from each other and leave two undecided documents
  at most. These meet in the next, much smaller round, until a source has one block. Hot sources are many blocks.
* What flights leave are a source's largest documents, which hardly move along the null space. So a source of many
  blocks keeps back documents of graded sizes before its first flight; they wait for its own last round.
* Landing. In its own last round the two documents that are left of a source, and a few of graded sizes, are rounded
  so that words and documents come nearest to their expectation.

Chance comes from hashes of document ids, so reruns agree. Cases. Null and empty texts have size zero and may be
taken or not without effect. A null source is a source of its own, the last one. Repeated rows are mixed each,
one like the other. Sources without words have target zero. An empty table gives an empty mix.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.buckets import whole_groups
from quayside.llm.common import SPACE_WORDS, map_arrow, slices, text_buffers, word_bounds, written

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2.0
BLOCK = 2_000
RESERVE = 14
# Each document kept back has at most this share of the words of the one before, so that all smaller ones make up for it.
GRADE = 0.6
# Size classes per doubling in which a source of many blocks keeps back a document.
CLASSES = 4


def word_numbers(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the words of each text. Nothing but these columns is kept of a document."""

    def count(batches):
        for batch in slices(batches):
            raw, rows = text_buffers(batch.column("text"))
            starts, _ = word_bounds(SPACE_WORDS[raw] != 0x20, rows)
            size = np.diff(np.searchsorted(starts, rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(size, pa.int64())], ["doc_id", "source", "size"]
            )

    return map_arrow(docs.select("doc_id", "source", "text"), count, "doc_id bigint, source string, size bigint")


def source_weights(totals: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Sources by code point, null last, with repeating weights. Ranks are per range, offset by the ranges before."""
    ranged = totals.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "sources")
    before = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = before.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    in_range = F.row_number().over(Window.partitionBy("range").orderBy("last", "source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranged.withColumn("rank", in_range).join(before, "range").withColumn("rank", F.col("rank") + F.col("before") - 1)
    return ranked.select("source", "source_size", F.get(cycle, F.pmod("rank", F.lit(len(weights))).cast("int")).alias("weight"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target): ``share`` of all words by weight, none above ``most`` times its source.

    What a capped source leaves is shared by weight among the others. Each round is one aggregation over the
    sources; rounds end when no source is newly capped.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = written(source_weights(totals, weights), "weights")
    cap = F.col("source_size") * F.lit(float(most))
    wanted = float(weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    rate, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(rate) >= cap
        s = weighed.agg(
            F.sum(F.when(over, cap)).alias("fixed"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count_if(over).alias("n")
        ).first()
        if s.n == capped or not s.open:
            break
        capped, rate = s.n, (wanted - (s.fixed or 0.0)) / s.open
    target = F.when(F.col("weight") * F.lit(rate) >= cap, cap).otherwise(F.col("weight") * F.lit(rate))
    return weighed.select("source", "source_size", target.cast("double").alias("target"))


def fly(chance: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Move probabilities until at most two are undecided; the sums of chances and of chance * size stand still.

    ``draw`` has a uniform number per document; the one whose place is taken decides the direction.
    """
    p, z, u = chance.astype(float).tolist(), size.astype(float).tolist(), draw.tolist()
    hand: list[int] = []
    for i in np.flatnonzero((chance > 0) & (chance < 1)).tolist():
        hand.append(i)
        if len(hand) < 3:
            continue
        a, b, c = hand
        # The null space of (1, 1, 1) and the sizes.
        along = (z[b] - z[c], z[c] - z[a], z[a] - z[b])
        widest = max(map(abs, along))
        moves = [(k, d / widest) for k, d in zip(hand, along, strict=True) if d] if widest else [(a, 1.0), (b, -1.0)]
        ahead = min(((1 - p[k]) if d > 0 else p[k]) / abs(d) for k, d in moves)
        back = min((p[k] if d > 0 else (1 - p[k])) / abs(d) for k, d in moves)
        step = ahead if u[c] * (ahead + back) < back else -back
        for k, d in moves:
            p[k] += step * d
        edge = min(hand, key=lambda k: min(p[k], 1 - p[k]))  # this one has arrived, up to rounding
        p[edge] = float(round(p[edge]))
        for k in hand:
            if min(p[k], 1 - p[k]) < 1e-9:
                p[k] = float(round(p[k]))
        hand = [k for k in hand if 0 < p[k] < 1]
    return np.array(p)


def land(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round what is undecided, all ways tried, so that words and documents come nearest to their expectation."""
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    out = chance.copy()
    # Bit k of a way tells whether the k-th document is taken.
    words, number = np.zeros(1), np.zeros(1)
    for z in size[open_].tolist():
        words, number = np.concatenate([words, words + z]), np.concatenate([number, number + 1])
    miss = np.abs(words - chance[open_] @ size[open_]) + np.abs(number - chance[open_].sum())
    out[open_] = (miss.argmin() >> np.arange(len(open_))) & 1
    return out


def fly_and_land(chance: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The last flight keeps back ``RESERVE`` documents whose sizes fall by ``GRADE`` from one to the next.

    What the flight leaves may be large documents; with these beside them the landing can make up for it.
    Expects the largest documents first.
    """
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    kept: list[int] = []
    wanted = size[open_].max(initial=0) * GRADE
    for i in open_.tolist():
        if len(kept) < RESERVE and size[i] <= wanted:
            kept.append(i)
            wanted = size[i] * GRADE
    kept += [i for i in open_[::-1].tolist() if i not in kept][: RESERVE - len(kept)]
    rest = np.setdiff1d(open_, kept)
    out = chance.copy()
    out[rest] = fly(chance[rest], size[rest], draw[rest])
    return land(out, size)


FLOWN = "source string, doc_id bigint, size bigint, copy int, chance double, lands boolean"


def _uniform(ids: list, copies: list, salt: int) -> np.ndarray:
    texts = (f"{i}/{c}/{salt}" for i, c in zip(ids, copies, strict=True))
    return np.array([xxhash.xxh3_64_intdigest(t) for t in texts], dtype=np.uint64).astype(float) / 2.0**64


def _fly_blocks(rows: DataFrame, salt: int) -> DataFrame:
    """Blocks brought together, flown, and landed if it is their source's last round."""

    def run(batches):
        for batch, starts in whole_groups(batches, ["cell", "no_source", "block"]):
            # Blocks whose hash is equal are told apart by their source.
            names = batch.column("source").to_pylist()
            ids, copies = batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist()
            size, chance = batch.column("size").to_numpy(), batch.column("chance").to_numpy().copy()
            draw, lands = _uniform(ids, copies, salt), batch.column("lands").to_pylist()
            for first, end in zip(starts[:-1], starts[1:], strict=True):
                cuts = [first, *(k for k in range(first + 1, end) if names[k] != names[k - 1]), end]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    chance[a:b] = (fly_and_land if lands[a] else fly)(chance[a:b], size[a:b], draw[a:b])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("source", "doc_id", "size", "copy")), pa.array(chance), batch.column("lands")],
                ["source", "doc_id", "size", "copy", "chance", "lands"],
            )

    keyed = rows.withColumn("no_source", F.col("source").isNull().cast("int")).withColumn("cell", F.xxhash64("no_source", "source", "block"))
    # Large documents first, as the landing expects them.
    sorted_ = keyed.repartition("cell").sortWithinPartitions("cell", "no_source", "source", "block", F.desc("size"), "doc_id", "copy")
    return map_arrow(sorted_, run, FLOWN)


UNDECIDED = "chance > 0 AND chance < 1"
UNIT = ("source", "doc_id", "size", "copy")


def _with_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Undecided rows with the number of blocks of their source; documents kept back need none."""
    counts = rows.where(UNDECIDED).groupBy("source").agg(F.count_if(~F.col("held")).alias("n"))
    counts = written(counts.select(F.col("source").alias("s"), F.ceil(F.col("n") / F.lit(block)).cast("bigint").alias("blocks")), "blocks")
    return rows.where(UNDECIDED).join(counts, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _hold_back(rows: DataFrame, block: int) -> DataFrame:
    """Rows with ``held``: the smallest document of every size class of every source that has more than one block."""
    many = _with_blocks(rows.withColumn("held", F.lit(False)), block).where("blocks > 1")
    grade = F.floor(F.log2(F.greatest("size", F.lit(1))) * CLASSES)
    # The minimum is combined before the shuffle.
    least = F.min(F.struct("size", F.xxhash64("doc_id", "copy").alias("draw"), "doc_id", "copy")).alias("least")
    held = written(many.groupBy("source", grade.alias("grade")).agg(least).select("source", "least.*"), "held")
    held = held.select(*(F.col(c).alias(f"held_{c}") for c in UNIT))
    same = [F.col(c).eqNullSafe(F.col(f"held_{c}")) for c in UNIT]
    return rows.join(held, same, "left").select(*rows.columns, F.col("held_copy").isNotNull().alias("held"))


def balanced(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (source, doc_id, size, copy, chance) -> the same with chances of zero and one."""
    columns, rows = rows.columns, written(rows, "chances")
    rows, salt = written(_hold_back(rows, block), "open"), 0
    decided = rows.where(f"NOT ({UNDECIDED})").select(*columns)
    while True:
        open_ = _with_blocks(rows, block).withColumn("lands", F.col("blocks") <= 1)
        goes = open_.where("lands OR NOT held")
        number = F.pmod(F.xxhash64("doc_id", "copy", F.lit(salt)), F.greatest("blocks", F.lit(1)))
        flown = written(_fly_blocks(goes.withColumn("block", number), salt), "flown")
        decided = decided.unionByName(flown.where(f"lands OR NOT ({UNDECIDED})").select(*columns))
        left = flown.where(f"NOT lands AND {UNDECIDED}").select(*columns, F.lit(False).alias("held"))
        rows = written(left.unionByName(open_.where("held AND NOT lands").select(*columns, "held")), "open")
        if rows.isEmpty():
            return decided
        salt += 1


# Sources whose targets may be sent to the tasks; more of them are joined by shuffle.
BROADCAST_SOURCES = 100_000


def mix(docs: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_REPEATS, block: int = BLOCK) -> DataFrame:
    """Documents (doc_id, source, text) -> doc_id, source, size, source_size, target, copies, taken."""
    sized = written(word_numbers(docs), "sizes")
    targets = written(source_targets(sized, weights, share, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.select(F.col("source").alias("s"), "source_size", "target", ratio.alias("ratio"))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    of_source = F.col("source").eqNullSafe(F.col("s"))

    # Rows that are alike in all that is kept get a number among themselves, so that each row is one unit.
    same = sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows"))
    units = same.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("rows") - 1).cast("int")))).join(targets, of_source)
    chances = units.select("source", "doc_id", "size", "copy", (F.col("ratio") - F.floor("ratio")).alias("chance"))
    taken = balanced(chances, block).join(targets, of_source)
    copies = (F.floor("ratio") + F.round("chance")).cast("bigint")
    return taken.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


# Rows of one file that are numbered together.
LANE = 10_000


def _numbered(rows: DataFrame, unit: list[str]) -> DataFrame:
    """Rows of a written table with ``number``, from 1 on, among those alike in ``unit``, in the order of the files.

    They are numbered in lanes of bounded size, after the rows of the lanes before, which are counted.
    """
    index = F.col("_metadata.row_index")
    placed = rows.withColumns({"file": F.col("_metadata.file_path"), "lane": F.floor(index / LANE), "row": index})
    lanes = placed.groupBy(*unit, "file", "lane").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*unit).orderBy("file", "lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    lanes = lanes.select(*(F.col(c).alias(f"l_{c}") for c in (*unit, "file", "lane")), "before")
    same = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in (*unit, "file", "lane")]
    in_lane = F.row_number().over(Window.partitionBy(*unit, "file", "lane").orderBy("row"))
    joined = placed.withColumn("in_lane", in_lane).join(lanes, same)
    return joined.select(*rows.columns, (F.col("in_lane") + F.col("before")).alias("number"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, each row as often as it is taken; columns as they were.

    Rows alike in ``doc_id``, ``source`` and size are taken equally often, or some of them once more than the others:
    the first ones in the order of the files, so that repeated rows and rows without an id meet the targets, too.
    """
    unit = ["mix_id", "mix_source", "mix_size"]
    # Copies of rows that are alike differ by one at most.
    counted = mix(docs, **settings).groupBy("doc_id", "source", "size").agg(
        F.min("copies").alias("mix_least"), (F.sum("copies") - F.min("copies") * F.count("*")).alias("mix_more")
    )
    counted = counted.where("mix_least > 0 OR mix_more > 0").toDF(*unit, "mix_least", "mix_more")
    # The same words as in ``word_numbers``, counted beside the other columns.
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    sized = docs.withColumn("mix_own", size)
    same = [sized[a].eqNullSafe(F.col(b)) for a, b in zip(("doc_id", "source", "mix_own"), unit, strict=True)]
    taken = written(sized.join(counted, same).drop("mix_own"), "taken")
    alike = written(taken.where("mix_more > 0"), "alike")
    chosen = _numbered(alike, unit).withColumn("mix_least", F.col("mix_least") + (F.col("number") <= F.col("mix_more")).cast("int"))
    rows = taken.where("mix_more = 0").unionByName(chosen.select(*taken.columns))
    times = F.sequence(F.lit(1), F.col("mix_least").cast("int"))
    return rows.where("mix_least > 0").withColumn("mix_copy", F.explode(times)).select(*docs.columns)
