"""Removing later copies of passages, by longest previous factors in suffix order.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts earlier: in a smaller ``doc_id``, or
before in the same document. Suffixes need comparing only where they can agree for that long, so they are first
brought together and then sorted:

* Every string of ``LENGTH`` bytes has an anchor, its ``GRAM`` bytes of the smallest hash. Equal strings have
  equal anchors. Of an anchor, all strings that hold it lie in its context of 168 bytes.
* Equal contexts of an anchor are one class, by hash: all but the first are copies. Most of it is settled in the
  task that reads the documents, the rest where an anchor's classes meet.
* Where an anchor has several contexts, these come together as text. The suffixes of all contexts are ordered to
  a depth of ``LENGTH`` bytes by prefix doubling, and by position where they agree that far. A suffix whose
  previous smaller position in this order agrees with it to the full depth has a longest previous factor of that
  length: it starts earlier, too, and what it covers goes.
* Anchors that are very frequent in a sample of documents don't meet as contexts. Each string of theirs is a key
  of its own, first reduced to one per task. The sample decides the way only, never the result.

Cases. Null and empty texts have no bytes. Texts shorter than ``LENGTH`` keep all. Rows with a null ``doc_id`` come
after all others. Repeated rows (one ``doc_id``, one text) are one place and are judged alike; other texts under
one ``doc_id`` count as one document whose positions overlap.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.buckets import whole_groups
from quayside.llm.common import map_arrow, mixed, slices, text_buffers, written

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # an anchor's strings start at most so far before it
PIECE = 1 << 20  # bytes that are hashed at a time
SAMPLE_DOCUMENTS = 20_000
FREQUENT_SHARE = 0.01
MOST_FREQUENT = 50_000
LAST = 2**63 - 1  # stands for a null doc_id

_draw = np.random.default_rng(7)
BYTES = _draw.integers(1, 2**64, 256, np.uint64, endpoint=False)
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    forth, back = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 2**64), np.uint64)
    forth[0] = back[0] = 1
    return np.multiply.accumulate(forth), np.multiply.accumulate(back)


def _slide(values: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over every run of ``width`` values."""
    out, have = values, 1
    while have * 2 <= width:
        out = join(out[:-have], out[have:])
        have *= 2
    return join(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def _thinned(at: np.ndarray, row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Chains of equal anchors closer than a string is long, as in periodic texts: keep as many as are needed."""
    if len(at) < 3:
        return at
    linked = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]) & (np.diff(at) <= REACH)
    if not (linked[1:] & linked[:-1]).any():
        return at
    keep = np.ones(len(at), bool)
    ends = np.flatnonzero(np.concatenate([~linked, [True]]))
    begins = np.concatenate([[0], ends[:-1] + 1])
    for a, b in zip(begins, ends, strict=True):
        if b - a < 2:
            continue
        places, kept = at[a : b + 1], [0]
        while kept[-1] < b - a:
            far = int(np.searchsorted(places, places[kept[-1]] + REACH + 1, side="right")) - 1
            kept.append(max(far, kept[-1] + 1))
        keep[a : b + 1] = False
        keep[a + np.array(kept)] = True
    return at[keep]


class Anchors:
    """Anchors of a run of whole documents, with what is needed to hash any stretch of it."""

    def __init__(self, raw: np.ndarray, rows: np.ndarray, forth: np.ndarray, back: np.ndarray):
        self.rows, self.back = rows, back
        n = len(raw)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(BYTES[raw] * forth[:n], out=self.sums[1:])
        empty = np.zeros(0, np.int64)
        self.at = self.row = self.left = self.right = empty
        self.key = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        gram = mixed(self.stretch(np.arange(n - GRAM + 1), GRAM))
        short = np.maximum((gram >> np.uint64(32)).astype(np.uint32), 1)
        least = _slide(short, REACH + 1, np.minimum)  # of the string that starts here
        inside = np.zeros(n + 1, np.int32)
        long = np.flatnonzero(np.diff(rows) >= LENGTH)
        inside[rows[long]] += 1
        np.add.at(inside, rows[long + 1] - LENGTH + 1, -1)
        valid = np.cumsum(inside)[: len(least)] > 0
        self.least, self.valid = least, valid
        # A gram is an anchor if it is the least of some string around it.
        seen = np.concatenate([np.zeros(REACH, np.uint32), np.where(valid, least, 0), np.zeros(len(short) - len(least), np.uint32)])
        at = np.flatnonzero(_slide(seen, REACH + 1, np.maximum) == short)
        row = np.searchsorted(rows, at, side="right") - 1
        fits = at + GRAM <= rows[row + 1]
        at, row = at[fits], row[fits]
        keep = np.isin(at, _thinned(at, row, gram[at]))
        self.at, self.row = at[keep], row[keep]
        self.key, self.short = gram[self.at], short
        self.left = np.minimum(REACH, self.at - rows[self.row])
        self.right = np.minimum(LENGTH, rows[self.row + 1] - self.at)

    def stretch(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]

    def contexts(self) -> np.ndarray:
        """Hash of every anchor's context and its extent."""
        shape = (self.left * 256 + self.right).astype(np.uint64)
        return mixed(self.stretch(self.at - self.left, self.left + self.right) + mixed(shape))

    def strings_of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor numbers, starts) of the strings whose least gram is one of these anchors."""
        start = (self.at[some, None] + np.arange(-REACH, 1)).ravel()
        anchor = np.repeat(some, REACH + 1)
        ok = (start >= 0) & (start < len(self.least))
        start, anchor = start[ok], anchor[ok]
        ok = self.valid[start] & (self.least[start] == self.short[self.at[anchor]]) & (start >= self.at[anchor] - self.left[anchor])
        # After thinning, a string may have several equal anchors; it is listed once.
        start, one = np.unique(start[ok], return_index=True)
        return anchor[ok][one], start


def _runs(batches):
    """Documents a few at a time: (batch, bytes, row offsets)."""
    for batch in slices(batches, limit=PIECE):
        raw, rows = text_buffers(batch.column("text"))
        yield batch, raw, rows


class Hashing:
    """Powers for the longest run so far; one long text makes them grow."""

    def __init__(self):
        self.forth, self.back = powers(PIECE + 1)

    def __call__(self, raw: np.ndarray, rows: np.ndarray) -> Anchors:
        if len(raw) >= len(self.forth):
            self.forth, self.back = powers(len(raw) + 1)
        return Anchors(raw, rows, self.forth, self.back)


def frequent_anchors(
    docs: DataFrame, share: float = FREQUENT_SHARE, documents: int = SAMPLE_DOCUMENTS, least: int = 50
) -> list[int]:
    """Keys of anchors that more than ``share`` of the documents of a bounded sample hold, and ``least`` at least."""
    n = docs.count()
    if not n:
        return []
    sample = docs.sample(min(1.0, documents / n), seed=11)

    def keys(batches):
        hashing = Hashing()
        for _, raw, rows in _runs(batches):
            a = hashing(raw, rows)
            per_row = np.unique(np.stack([a.row.astype(np.uint64), a.key], axis=1), axis=0)
            found, n = np.unique(per_row[:, 1], return_counts=True)
            many = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(n[many])], ["key", "n"])

    least = max(least, share * min(n, documents))
    # A key that a run holds once is left out of the sample's counts; a frequent one is in most runs many times.
    counted = map_arrow(sample.select("text"), keys, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return [r.key for r in counted.where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).collect()]


# ``end``: where a copy ends (``pos`` is where it starts); -1 for a string of a frequent anchor; else less the
# bytes that an anchor's context has from the anchor on.
MARK = "key bigint, ctx bigint, doc bigint, fp int, pos int, end int"


def _mark(key, ctx, doc, fp, pos, end) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(c), k) for c, k in zip((key, ctx, doc, fp, pos, end), kinds, strict=True)],
        ["key", "ctx", "doc", "fp", "pos", "end"],
    )


def _later(parts: tuple[np.ndarray, ...], doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which rows are not the first, by document and position, of those that agree in ``parts``."""
    order = np.lexsort((pos, doc, *parts[::-1]))
    same = np.ones(max(len(order) - 1, 0), bool)
    for p in parts:
        same &= p[order[1:]] == p[order[:-1]]
    out = np.zeros(len(order), bool)
    out[order[1:]] = same
    return out


def marks(docs: DataFrame, frequent: list[int]) -> DataFrame:
    """Anchors and strings of frequent anchors, one of each kind per run of documents, and the copies of these."""

    def run(batches):
        hashing = Hashing()
        hot = np.sort(np.array(frequent, np.int64).view(np.uint64))
        for batch, raw, rows in _runs(batches):
            a = hashing(raw, rows)
            doc, fp = batch.column("doc").to_numpy(), batch.column("fp").to_numpy()
            is_hot = np.isin(a.key, hot) if len(hot) else np.zeros(len(a.key), bool)
            cold = np.flatnonzero(~is_hot)
            key, ctx = a.key[cold].view(np.int64), a.contexts()[cold].view(np.int64)
            d, f, pos = doc[a.row[cold]], fp[a.row[cold]], a.at[cold] - rows[a.row[cold]]
            left, right = a.left[cold], a.right[cold]
            later = _later((key, ctx), d, pos)
            first = ~later
            yield _mark(key[first], ctx[first], d[first], f[first], pos[first], -right[first])
            if later.any():
                yield _mark(key[later], ctx[later], d[later], f[later], (pos - left)[later], (pos + right)[later])
            if is_hot.any():
                anchor, start = a.strings_of(np.flatnonzero(is_hot))
                one = a.stretch(start, LENGTH)
                key, ctx = mixed(one).view(np.int64), mixed(one + a.key[anchor]).view(np.int64)
                d, f, pos = doc[a.row[anchor]], fp[a.row[anchor]], start - rows[a.row[anchor]]
                later = _later((key, ctx), d, pos)
                first = ~later
                yield _mark(key[first], ctx[first], d[first], f[first], pos[first], np.full(first.sum(), -1))
                if later.any():
                    yield _mark(key[later], ctx[later], d[later], f[later], pos[later], pos[later] + LENGTH)

    return map_arrow(docs.select("doc", "fp", "text"), run, MARK)


FOUND = "key bigint, doc bigint, fp int, pos int, end int"


def classes(marked: DataFrame) -> DataFrame:
    """Copies (``end`` > 0), and the first places of the contexts of anchors that have several (``end`` < 0)."""

    def run(batches):
        for batch, starts in whole_groups(batches, ["key"]):
            key, ctx, doc, fp, pos, end = (batch.column(c).to_numpy() for c in ("key", "ctx", "doc", "fp", "pos", "end"))
            copy = end >= 0
            rows = np.flatnonzero(~copy)
            k, c = key[rows], ctx[rows]
            # Rows are sorted by key, context, document and position.
            later = np.zeros(len(rows), bool)
            later[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
            number = np.concatenate([[0], np.cumsum(np.diff(k) != 0)]) if len(k) else np.zeros(0, np.int64)
            contexts = np.bincount(number, ~later & (end[rows] < -1), minlength=1)
            asked = rows[~later & (end[rows] < -1) & (contexts[number] > 1)] if len(k) else rows
            again = rows[later]
            string = end[again] == -1
            start = np.where(string, pos[again], pos[again] - np.minimum(REACH, pos[again]))
            stop = np.where(string, pos[again] + LENGTH, pos[again] - end[again])
            both = [(key[copy], doc[copy], fp[copy], pos[copy], end[copy]), (key[again], doc[again], fp[again], start, stop)]
            both.append((key[asked], doc[asked], fp[asked], pos[asked], end[asked]))
            columns = [np.concatenate(x) for x in zip(*both, strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["key", "doc", "fp", "pos", "end"]
            )

    # Copies are done; they need no partner and go wherever their document's hash sends them.
    routed = marked.withColumn("key", F.when(F.col("end") >= 0, F.xxhash64("doc", "pos")).otherwise(F.col("key")))
    sorted_ = routed.repartition("key").sortWithinPartitions("key", "ctx", "doc", "pos")
    return written(map_arrow(sorted_, run, FOUND), "copies")


def suffix_ranks(contexts: np.ndarray) -> np.ndarray:
    """Rows of symbols, 0 for none -> ranks of the suffixes of each row to a depth of ``LENGTH``, by prefix doubling.

    Column k is the suffix that starts at k; ranks of all rows are in one order.
    """
    columns = contexts.shape[1] - 7
    code = np.zeros((len(contexts), columns), np.uint64)
    for i in range(8):
        code = (code << np.uint64(8)) | contexts[:, i : i + columns].astype(np.uint64)
    rank, have = _dense(code), 8
    while have * 2 <= LENGTH:
        rank = _dense((rank[:, : rank.shape[1] - have] << np.uint64(32)) | rank[:, have:])
        have *= 2
    rest = LENGTH - have
    return _dense((rank[:, : rank.shape[1] - rest] << np.uint64(32)) | rank[:, rest:]) if rest else rank


def _dense(code: np.ndarray) -> np.ndarray:
    order = np.argsort(code, axis=None)
    flat = code.ravel()[order]
    rank = np.empty(len(flat), np.uint64)
    rank[order] = np.concatenate([[0], np.cumsum(flat[1:] != flat[:-1])]) if len(flat) else flat
    return rank.reshape(code.shape)


def earlier_factor(rank: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which suffixes have a longest previous factor of full depth.

    In suffix order, with positions rising where suffixes agree, the previous smaller position of a suffix is
    right before it if it agrees to full depth, and the next smaller one never does.
    """
    order = np.lexsort((start, doc, rank))
    r, d, s = rank[order], doc[order], start[order]
    head = np.concatenate([[True], r[1:] != r[:-1]])
    first = np.maximum.accumulate(np.where(head, np.arange(len(r)), 0))
    out = np.zeros(len(r), bool)
    # One place may be listed for several anchors; it is no earlier than itself.
    out[order] = (d != d[first]) | (s != s[first])
    return out


CONTEXT = "key bigint, doc bigint, fp int, start int, bytes binary"
COPY = "doc bigint, fp int, pos int, end int"
CONTEXTS = 4096  # that are sorted at a time, unless one anchor has more


def contexts_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, doc, fp, pos) -> the bytes around, cut at the ends of the document."""

    def run(batches):
        for batch in slices(batches):
            raw, rows = text_buffers(batch.column("text"))
            places = batch.column("places")
            row = np.repeat(np.arange(len(batch)), np.diff(places.offsets.to_numpy()))
            flat = places.flatten()
            key, pos = flat.field("key").to_numpy(), flat.field("pos").to_numpy().astype(np.int64)
            start = np.maximum(pos - REACH, 0)
            stop = np.minimum(pos + LENGTH, rows[row + 1] - rows[row])
            data = raw.tobytes()
            cut = [data[a:b] for a, b in zip(rows[row] + start, rows[row] + stop, strict=True)]
            for k in range(0, len(cut), 50_000):
                s = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[s]), batch.column("doc").take(pa.array(row[s])), batch.column("fp").take(pa.array(row[s])),
                     pa.array(start[s].astype(np.int32)), pa.array(cut[s], pa.binary())],
                    ["key", "doc", "fp", "start", "bytes"],
                )

    places = asked.groupBy("doc", "fp").agg(F.collect_list(F.struct("key", "pos")).alias("places"))
    joined = docs.join(places.hint("shuffle_hash"), ["doc", "fp"])
    return map_arrow(joined.select("doc", "fp", "text", "places"), run, CONTEXT)


def copies_in_contexts(contexts: DataFrame) -> DataFrame:
    """Contexts -> the places of their strings that have an earlier copy in another context of an anchor."""

    def sort_some(batch):
        n = len(batch)
        raw, offsets = text_buffers(batch.column("bytes"))
        size = np.diff(offsets)
        symbols = np.zeros((n, REACH + LENGTH), np.uint8)
        inside = np.arange(REACH + LENGTH)[None, :] < size[:, None]
        symbols[inside] = raw
        rank = suffix_ranks(symbols)  # a column per start
        row, at = np.nonzero(np.arange(rank.shape[1])[None, :] + LENGTH <= size[:, None])
        doc, start = batch.column("doc").to_numpy()[row], batch.column("start").to_numpy()[row].astype(np.int64) + at
        hit = earlier_factor(rank[row, at], doc, start)
        row, start = row[hit], start[hit]
        # Strings of one context that start next to each other are one stretch.
        fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + LENGTH)]) if len(row) else np.zeros(0, bool)
        begin = np.flatnonzero(fresh)
        end = np.concatenate([begin[1:] - 1, [len(row) - 1]])[: len(begin)].astype(np.int64)
        take = pa.array(row[begin])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc").take(take), batch.column("fp").take(take), pa.array(start[begin].astype(np.int32)),
             pa.array((start[end] + LENGTH).astype(np.int32))],
            ["doc", "fp", "pos", "end"],
        )

    def run(batches):
        for batch, starts in whole_groups(batches, ["key"]):
            k = 0
            while k < len(starts) - 1:
                far = max(k + 1, int(np.searchsorted(starts, starts[k] + CONTEXTS, side="right")) - 1)
                far = min(far, len(starts) - 1)
                yield sort_some(batch.slice(int(starts[k]), int(starts[far] - starts[k])))
                k = far

    return map_arrow(contexts.repartition("key").sortWithinPartitions("key"), run, COPY)


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Stretches -> maximal stretches, in order."""
    out: list[list[int]] = []
    for a, b in sorted((s["pos"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.hash("text").alias("fp"), "text")


def removals(docs: DataFrame, frequent: list[int] | None = None) -> DataFrame:
    """Documents (doc_id, text) -> (doc, fp, spans): what goes of each document that loses something.

    ``frequent``: the anchors whose strings are keys of their own; by default those of a sample.
    """
    keyed = _keyed(docs).where("text IS NOT NULL")
    found = classes(marks(keyed, frequent_anchors(docs.select("text")) if frequent is None else frequent))
    asked = found.where("end < 0").select("key", "doc", "fp", "pos")
    more = copies_in_contexts(contexts_of(keyed, asked))
    copies = found.where("end >= 0").select("doc", "fp", "pos", "end").union(more)
    return copies.groupBy("doc", "fp").agg(F.collect_list(F.struct("pos", "end")).alias("spans"))


def without_repeats(docs: DataFrame, frequent: list[int] | None = None) -> DataFrame:
    """Documents -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept``, the remaining bytes."""

    def run(batches):
        for batch in slices(batches):
            raw, rows = text_buffers(batch.column("text"))
            data, out = raw.tobytes(), []
            for k, spans in enumerate(batch.column("spans").to_pylist()):
                text = data[rows[k] : rows[k + 1]]
                gone = merged(spans or [])
                parts, at = [], 0
                for a, b in gone:
                    parts.append(text[at:a])
                    at = b
                kept = b"".join([*parts, text[at:]])
                out.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    joined = _keyed(docs).join(removals(docs, frequent).hint("shuffle_hash"), ["doc", "fp"], "left")
    return map_arrow(joined.select("doc_id", "text", "spans"), run, RESULT + ", kept binary")
