"""Removing passages of words that an earlier document has, found by recompression.

In every round, runs of equal symbols and then pairs of a left and a right symbol become one symbol. Names are 64-bit
fingerprints of what they stand for, and a symbol's side is a bit of its name, so all tasks agree on names and sides
without a shuffle: equal passages are cut alike, but for a few symbols at their ends. Each symbol carries the span of
words that settles it: its own words and the neighbours that decided its rounds. Wherever the words of that span come
again, the same symbol is at the same place of them.

A window of 50 words takes its symbol from the highest round that has one whose span lies in the window (in round 0
every word is one), of several the least name, the first of equal ones. Equal windows take the same symbol at the
same place. Neighbouring windows share a symbol; together they are its context. Spark then settles symbols in three steps:

1. Symbols (the words of their spans) in one document only reveal nothing and are left. What remains is small.
   A symbol that always has the same context loses all its windows behind its smallest document.
2. Otherwise equal contexts are one class, and all its members but the smallest document lose all its windows.
3. What is left is settled window by window, one document per class: a window goes if the same words are in a class of
   a smaller document.

All steps are minima, combined before their shuffle, and joins with written tables, whose hot keys adaptive execution
splits; so a passage in a third of all documents burdens no task. Windows are compared by 64-bit hashes of their words
within symbols of equal 64-bit names, so a false match needs both to collide.

Cases: null and empty texts have no words. Documents shorter than a window keep all. A document without id is neither
earlier nor later than another and keeps all. Rows of one id are not earlier than each other, and each is judged by
its own text. Words of any length, texts of any length and runs of one word are handled alike; other columns are left
aside. No documents, no rows.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import hashed_words, map_arrow, mixed, slices, split_words, text_buffers, written
from quayside.llm.filteraudit import CASED_WORDS

WINDOW = 50
# Rounds: symbols of the last one are some three words long and their spans some fifteen, so that a window has many
# to choose from and neighbouring windows mostly share one.
ROUNDS = 4
BASE, CONTEXT_BASE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)

ANCHORS = "uid bigint, doc_id bigint, symbol bigint, context bigint, first int, last int"
JUDGED = (
    "uid bigint, doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string, "
    "gone array<int>, window array<bigint>, symbol array<bigint>, at array<int>"
)
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


class Rolling:
    """Hashes of any run of words of a sequence."""

    def __init__(self, words: np.ndarray, base: np.uint64):
        n = len(words)
        self.powers = np.ones(n + 1, np.uint64)
        self.powers[1:] = np.cumprod(np.full(n, base, np.uint64))
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        down = np.ones(n, np.uint64)
        down[1:] = np.cumprod(np.full(max(n - 1, 0), inverse, np.uint64))
        self.upto = np.zeros(n + 1, np.uint64)
        np.cumsum(words * down, out=self.upto[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sum of word * base**-(place in the run), and the run's length mixed in."""
        total = (self.upto[end] - self.upto[start]) * self.powers[start]
        return mixed(total ^ ((end - start).astype(np.uint64) << np.uint64(48)))


def placed(words: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all rows in one sequence, rows apart by one stop of ``window + 1`` places: (names, lo, hi).

    A symbol that a stop has decided spans it, which makes its span longer than any window.
    """
    n_rows = len(rows) - 1
    counts = np.diff(rows)
    stops = rows + np.arange(n_rows + 1)
    names = np.zeros(len(words) + n_rows + 1, np.uint64)
    wide = np.ones(len(names), np.int64)
    inside = np.ones(len(names), bool)
    inside[stops] = False
    names[inside] = words
    names[stops] = np.arange(n_rows + 1, dtype=np.uint64)
    wide[stops] = window + 1
    hi = np.cumsum(wide)
    return names, hi - wide, hi


def next_round(names: np.ndarray, lo: np.ndarray, hi: np.ndarray, stop: np.ndarray, number: int):
    """One round: runs, then pairs. Returns names, spans and which symbols are stops."""
    n = len(names)
    start = np.ones(n, bool)
    start[1:] = (names[1:] != names[:-1]) | stop[1:] | stop[:-1]
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, n)).astype(np.uint64)
    last = np.append(at[1:], n) - 1
    run = np.where((size > 1) & ~stop[at], mixed(names[at] + size * np.uint64(0x9E3779B97F4A7C15)), names[at])
    # That a run ends where it does depends on its neighbours.
    run_lo = np.where(stop[at], lo[at], lo[np.maximum(at - 1, 0)])
    run_hi = np.where(stop[at], hi[last], hi[np.minimum(last + 1, n - 1)])
    held = stop[at]
    side = (mixed(run + np.uint64(0xC2B2AE3D * number)) >> np.uint64(17)) & np.uint64(1)
    left, right = (side == 0) & ~held, (side == 1) & ~held
    paired = left[:-1] & right[1:]
    first = np.append(paired, False)
    second = np.concatenate([[False], paired])
    keep = ~second
    name, low, high = run.copy(), run_lo.copy(), run_hi.copy()
    name[:-1][paired] = mixed(run[:-1][paired] * np.uint64(0xFF51AFD7ED558CCD) + run[1:][paired] + np.uint64(number))
    high[:-1][paired] = np.maximum(run_hi[:-1], run_hi[1:])[paired]
    low[:-1][paired] = np.minimum(run_lo[:-1], run_lo[1:])[paired]
    # A left symbol stays alone because of what follows it, a right one because of what is before.
    alone = ~first & ~second
    l, r = np.flatnonzero(alone & left), np.flatnonzero(alone & right)
    high[l] = np.maximum(high[l], run_hi[l + 1])
    low[r] = np.minimum(low[r], run_lo[r - 1])
    return name[keep], low[keep], high[keep], held[keep]


def _least(values: np.ndarray, most: int) -> list[np.ndarray]:
    """Tables of the first least of 1, 2, 4 ... values from every place, up to ``most``, as places."""
    tables = [np.arange(len(values))]
    step = 1
    while step * 2 <= min(len(values), most):
        a, b = tables[-1][:-step], tables[-1][step:]
        tables.append(np.where(values[b] < values[a], b, a))
        step *= 2
    return tables


def symbols_of_windows(words: np.ndarray, rows: np.ndarray, window: int, rounds: int):
    """Per window of all rows: its first word, and the span (in words) of the symbol that it takes."""
    names, lo, hi = placed(words, rows, window)
    stop = np.zeros(len(names), bool)
    stop[rows + np.arange(len(rows))] = True
    counts = np.diff(rows)
    row = np.repeat(np.arange(len(counts)), np.maximum(counts - window + 1, 0))
    before = np.cumsum(np.maximum(counts - window + 1, 0)) - np.maximum(counts - window + 1, 0)
    start = rows[row] + np.arange(len(row)) - before[row]
    shift = (window + 1) * (row + 1)  # from words to places
    place = start + shift
    levels = []
    for number in range(rounds + 1):
        if number:
            names, lo, hi, stop = next_round(names, lo, hi, stop, number)
        fits = hi - lo <= window
        if not fits.any():
            break
        levels.append((mixed(names[fits] + np.uint64(number)), lo[fits], hi[fits]))
    chosen_lo, chosen_hi = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    rest = np.arange(len(row))
    for priority, low, high in reversed(levels):
        if not len(rest):
            break
        a = np.searchsorted(low, place[rest])
        b = np.searchsorted(high, place[rest] + window, side="right")
        some = a < b
        mine, a, b = rest[some], a[some], b[some]
        tables = _least(priority, int((b - a).max(initial=1)))
        depth = np.frexp((b - a).astype(np.float64))[1] - 1
        best = np.zeros(len(mine), np.int64)
        for k in np.unique(depth):
            of = depth == k
            x, y = tables[k][a[of]], tables[k][b[of] - (1 << int(k))]
            best[of] = np.where(priority[y] < priority[x], y, x)
        chosen_lo[mine], chosen_hi[mine] = low[best] - shift[mine], high[best] - shift[mine]
        rest = rest[~some]
    return row, start, chosen_lo, chosen_hi


def contexts(words: np.ndarray, rows: np.ndarray, window: int, rounds: int):
    """Rows of windows that share a symbol: (row, first and last start, symbol, context) as arrays."""
    row, start, low, high = symbols_of_windows(words, rows, window, rounds)
    if not len(row):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    change = np.ones(len(row), bool)
    change[1:] = (row[1:] != row[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    at = np.flatnonzero(change)
    last = np.append(at[1:], len(row)) - 1
    symbol = Rolling(words, BASE).of(low[at], high[at])
    whole = Rolling(words, CONTEXT_BASE).of(start[at], start[last] + window)
    # Where the symbol is in its context belongs to the class.
    whole = mixed(whole + (low[at] - start[at]).astype(np.uint64))
    return row[at], start[at] - rows[row[at]], start[last] - rows[row[at]], symbol, whole


def _words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, row offsets and word hashes."""
    words, rows = split_words(text, CASED_WORDS)
    coded = words.dictionary_encode()
    hashes = hashed_words(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    return words, rows.astype(np.int64), hashes


def _uids(batch: pa.RecordBatch) -> np.ndarray:
    """A number for each id and text; rows that share it are judged alike."""
    raw, rows = text_buffers(batch.column("text"))
    ids = batch.column("doc_id").to_pylist()
    return np.fromiter(
        (xxhash.xxh3_64_intdigest(raw[a:b], seed=0 if i is None else i & (2**64 - 1)) for i, a, b in zip(ids, rows[:-1], rows[1:])), np.uint64, len(ids)
    ).view(np.int64)


def _anchors(window: int, rounds: int):
    def anchors(batches):
        for batch in slices(batches):
            _, rows, hashes = _words_of(batch.column("text"))
            row, first, last, symbol, context = contexts(hashes, rows, window, rounds)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_uids(batch)[row]),
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(symbol.view(np.int64)),
                    pa.array(context.view(np.int64)),
                    pa.array(first, pa.int32()),
                    pa.array(last, pa.int32()),
                ],
                ["uid", "doc_id", "symbol", "context", "first", "last"],
            )

    return anchors


def _kept(words: pa.Array, gone: np.ndarray) -> str:
    """Digest of the words that are left, with one space between them."""
    left = words.filter(pa.array(~gone)) if gone.any() else words
    if not len(left):
        return hashlib.sha256(b"").hexdigest()
    raw, at = text_buffers(left)
    spaced = np.full(len(raw) + len(left) - 1, 0x20, np.uint8)
    spaced[np.arange(len(raw)) + np.repeat(np.arange(len(left)), np.diff(at))] = raw
    return hashlib.sha256(spaced).hexdigest()


def _covered(n: int, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Words covered by the windows that start from ``first`` to ``last``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, last + window, -1)
    return np.cumsum(steps)[:n] > 0


def _judge(window: int):
    """Rows with what is known of their contexts -> results; those with windows to compare keep text and windows."""

    def judge(batches):
        for batch in slices(batches):
            words, rows, hashes = _words_of(batch.column("text"))
            rolling = None
            out: dict[str, list] = {c.split()[0]: [] for c in JUDGED.split(", ")}
            marks = batch.column("marks").to_pylist()
            for i, (uid, doc_id, text) in enumerate(zip(batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"))):
                n = int(rows[i + 1] - rows[i])
                mine = np.array([(m["first"], m["last"], m["open"]) for m in marks[i] or ()], np.int64).reshape(-1, 3)
                sure, open_ = mine[mine[:, 2] == 0], mine[mine[:, 2] == 1]
                gone = _covered(n, sure[:, 0], sure[:, 1], window) if len(sure) else np.zeros(n, bool)
                windows = symbols = at = pending = places = None
                if len(open_):
                    if rolling is None:
                        rolling = Rolling(hashes, CONTEXT_BASE)
                    sizes = open_[:, 1] - open_[:, 0] + 1
                    at = np.repeat(open_[:, 0], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    windows = rolling.of(rows[i] + at, rows[i] + at + window).view(np.int64)
                    keys = np.array([m["symbol"] for m in marks[i] if m["open"] == 1], np.int64)
                    symbols, pending = np.repeat(keys, sizes), text.as_py()
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    places = edge.astype(np.int32)
                values = (
                    uid, doc_id, n, int(gone.sum()), None if pending is not None else _kept(words.slice(rows[i], n), gone), pending,
                    places, windows, symbols, None if at is None else at.astype(np.int32),
                )
                for column, value in zip(out.values(), values):
                    column.append(value)
            yield _typed(out, JUDGED)

    return judge


ARROW = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}


def _typed(columns: dict[str, list], schema: str) -> pa.RecordBatch:
    types = [f.split()[1] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, t in zip(columns.values(), types)], list(columns))


def _finish(window: int):
    """Rows with the windows that go in the end -> results."""

    def finish(batches):
        for batch in slices(batches):
            words, rows, _ = _words_of(batch.column("text"))
            out: dict[str, list] = {c.split()[0]: [] for c in RESULT.split(", ")}
            for i, (doc_id, edges, starts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "gone", "starts")))):
                n = int(rows[i + 1] - rows[i])
                steps = np.zeros(n + 1, np.int64)
                steps[edges[0::2]] += 1
                steps[edges[1::2]] -= 1
                starts = np.array(starts or [], np.int64)
                gone = (np.cumsum(steps)[:n] > 0) | _covered(n, starts, starts, window)
                for column, value in zip(out.values(), (doc_id, n, int(gone.sum()), _kept(words.slice(rows[i], n), gone))):
                    column.append(value)
            yield _typed(out, RESULT)

    return finish


def _uid_rows(batches):
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(_uids(batch)), batch.column("doc_id"), batch.column("text")], ["uid", "doc_id", "text"])


def without_earlier_passages(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    anchors = written(map_arrow(rows.where("doc_id is not null"), _anchors(window, rounds), ANCHORS), "anchors")

    symbols = (
        anchors.groupBy("symbol")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("context") != F.max("context")).alias("several"))
        .where("lo < hi")
    )
    shared = written(anchors.join(written(symbols.drop("hi"), "symbols"), "symbol"), "shared")

    # Behind the smallest document of its class everything goes; that one is compared if its symbol has other classes.
    mark = ("uid", "doc_id", F.struct("first", "last", "open", "symbol").alias("mark"))
    several = shared.where("several")
    classes = written(several.groupBy("symbol", "context").agg(F.min("doc_id").alias("least")), "classes")
    open_ = several.join(classes, ["symbol", "context"]).withColumn("open", (F.col("doc_id") == F.col("least")).cast("int"))
    sure = shared.where("NOT several AND doc_id > lo").withColumn("open", F.lit(0))
    marks = sure.select(*mark).unionByName(open_.select(*mark)).groupBy("uid", "doc_id").agg(F.collect_set("mark").alias("marks"))
    marks = written(marks, "marks")
    named = map_arrow(rows, _uid_rows, "uid bigint, doc_id bigint, text string")
    judged = written(map_arrow(named.join(marks, ["uid", "doc_id"], "left"), _judge(window), JUDGED), "judged")

    compared = judged.where("text is not null")
    windows = compared.select("uid", "doc_id", F.explode(F.arrays_zip("window", "symbol", "at")).alias("w")).select("uid", "doc_id", "w.*")
    earlier = written(
        windows.groupBy("symbol", "window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"), "earlier"
    )
    last = (
        windows.join(earlier, ["symbol", "window"])
        .where("doc_id > lo")
        .groupBy("uid", "doc_id")
        .agg(F.collect_set("at").alias("starts"))
    )
    finished = map_arrow(compared.select("uid", "doc_id", "text", "gone").join(last, ["uid", "doc_id"], "left"), _finish(window), RESULT)
    return judged.where("text is null").select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(finished)
