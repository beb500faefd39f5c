"""Positional inverted index over the corpus, and exact phrase and proximity search for benchmark items in it.

The index is split by documents: a shard covers some megabytes of text and holds, for every term of the
benchmark, the sorted positions at which it occurs. Shards are written to the shared folder and searched from
there, so the corpus is read once, is never shuffled, and a lost executor costs its shards only.

Queries are windows of consecutive item words. For a window, each shard starts from the posting list that is
the shortest there, shifts it by the term's place in the window, and intersects it with the lists of the next
rarest terms. Windows go to the tasks in blocks of bounded size; more items make more blocks, not larger ones.

Cases. Null and empty texts have no words. An item without words has no window; an item with fewer words than
a window is one window. Documents are told apart by shard and row, not by id: repeated ones, and those without an id,
are searched each. Repeated items and windows count once. Items without an id are searched, too: their words are hit and make
a document contaminated, but there is nothing to name, so they are not among its items.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import ALNUM_WORDS, encoded_words, map_arrow, slices, split_words, written

WINDOW = 10
# Bytes of item text whose windows are sent to the tasks at once.
BLOCK_BYTES = 8 << 20

SHARD = "shard bigint, doc_ids binary, has_id binary, doc_starts binary, terms array<binary>, term_starts binary, positions binary"
FOUND = "shard bigint, row int, doc_id bigint, n_words bigint, spans array<struct<first:int,last:int>>, items array<string>"


def _frame(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


class Queries:
    """Windows of a block of items: term numbers (padded with -1), lengths, and the items that hold them."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        names = sorted({i for i, _ in items if i is not None})
        place = {n: k for k, n in enumerate(names)}
        words, rows = split_words(pa.array([t for _, t in items], pa.string()), ALNUM_WORDS)
        texts = words.to_pylist()
        self.terms = sorted(set(texts))
        number = {w: k for k, w in enumerate(self.terms)}
        holders: dict[tuple[int, ...], set[int]] = {}
        for k, (item, _) in enumerate(items):
            coded = [number[w] for w in texts[rows[k] : rows[k + 1]]]
            for at in range(max(1, len(coded) - window + 1) if coded else 0):
                held = holders.setdefault(tuple(coded[at : at + window]), set())
                if item is not None:
                    held.add(place[item])
        found = sorted(holders)
        self.names = names
        self.length = np.array([len(w) for w in found], np.int64)
        self.words = np.full((len(found), window), -1, np.int64)
        for k, w in enumerate(found):
            self.words[k, : len(w)] = w
        self.holder_starts = np.cumsum([0, *(len(holders[w]) for w in found)])
        self.holders = np.array([i for w in found for i in sorted(holders[w])], np.int64)


def query_blocks(items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Queries]:
    """Items (item_id, text) in blocks of about ``block_bytes``; an empty table has no block."""
    texts = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for block in range(blocks):
        part = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield Queries([(r.item_id, r.text) for r in part.collect()], window)


def build_index(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Documents (doc_id, text) -> written shards with the postings of ``terms``."""
    def shards(batches):
        wanted = pa.array(terms, pa.binary())
        for number, batch in enumerate(slices(batches)):
            codes, distinct, rows = encoded_words(batch.column("text"), ALNUM_WORDS)
            known = pc.index_in(distinct, value_set=wanted).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            term = known[codes] if len(codes) else np.zeros(0, np.int64)
            at = np.flatnonzero(term >= 0)
            order = np.argsort(term[at], kind="stable")
            at, term = at[order], term[at][order]
            present, first = np.unique(term, return_index=True)
            ids = batch.column("doc_id")
            yield _frame(
                {
                    "shard": pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
                    "doc_ids": [ids.fill_null(0).to_numpy().astype("<i8").tobytes()],
                    "has_id": [ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()],
                    "doc_starts": [rows.astype("<i8").tobytes()],
                    "terms": pa.array([[terms[t] for t in present]], pa.list_(pa.binary())),
                    "term_starts": [np.append(first, len(at)).astype("<i8").tobytes()],
                    "positions": [at.astype("<i4").tobytes()],
                }
            )

    return written(map_arrow(docs.select("doc_id", "text"), shards, SHARD), "postings")


class Shard:
    """One shard in memory: its documents and its posting lists, as numbered by a set of queries."""

    def __init__(self, row: dict, number: dict[bytes, int], n_terms: int):
        self.number = row["shard"]
        ids = np.frombuffer(row["doc_ids"], "<i8")
        has = np.frombuffer(row["has_id"], np.uint8)
        self.doc_ids = [int(i) if h else None for i, h in zip(ids, has, strict=True)]
        self.doc_starts = np.frombuffer(row["doc_starts"], "<i8")
        self.positions = np.frombuffer(row["positions"], "<i4").astype(np.int64)
        starts = np.frombuffer(row["term_starts"], "<i8")
        self.first = np.zeros(n_terms + 1, np.int64)
        self.count = np.zeros(n_terms + 1, np.int64)  # the last stands for padding and has no postings
        self.term_at = np.full(int(self.doc_starts[-1]) + 1, -2, np.int64)
        for k, term in enumerate(row["terms"]):
            if (t := number.get(term)) is not None:
                self.first[t], self.count[t] = starts[k], starts[k + 1] - starts[k]
                self.term_at[self.positions[starts[k] : starts[k + 1]]] = t


# Candidate positions that are expanded at a time.
EXPAND = 1 << 20


def phrase_hits(shard: Shard, queries: Queries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window numbers, start positions) of all exact occurrences."""
    real = queries.words >= 0
    counts = np.where(real, shard.count[queries.words], np.iinfo(np.int64).max)
    alive = np.flatnonzero(counts.min(axis=1) > 0) if len(counts) else np.zeros(0, np.int64)
    rarest = np.argsort(counts[alive], axis=1, kind="stable")
    lists = counts[alive, rarest[:, 0]] if len(alive) else np.zeros(0, np.int64)
    ends = np.cumsum(lists)
    done = 0
    while done < len(alive):
        base = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, base + EXPAND, side="right")))
        part = np.arange(done, upto)
        done = upto
        window = np.repeat(part, lists[part])
        step = np.arange(len(window)) - np.repeat(ends[part] - lists[part] - base, lists[part])
        place = rarest[window, 0]
        start = shard.positions[shard.first[queries.words[alive[window], place]] + step] - place
        length = queries.length[alive[window]]
        inside = (start >= 0) & (start + length <= shard.doc_starts[-1])
        window, start, length = window[inside], start[inside], length[inside]
        same = np.searchsorted(shard.doc_starts, start, side="right") == np.searchsorted(
            shard.doc_starts, start + length - 1, side="right"
        )
        window, start = window[same], start[same]
        for k in range(1, queries.words.shape[1]):
            place = rarest[window, k]
            term = queries.words[alive[window], place]
            at = np.minimum(start + place, len(shard.term_at) - 1)
            agrees = (term < 0) | (shard.term_at[at] == term)
            window, start = window[agrees], start[agrees]
        yield alive[window], start


def proximity_hits(shard: Shard, queries: Queries, within: int) -> Iterator[tuple[int, int]]:
    """(window number, position of its rarest term) where all terms lie at most ``within`` words from it."""
    for w in range(len(queries.length)):
        terms = np.unique(queries.words[w, : queries.length[w]])
        lists = [shard.positions[shard.first[t] : shard.first[t] + shard.count[t]] for t in terms]
        if min(map(len, lists)) == 0:
            continue
        lists.sort(key=len)
        at = lists[0]
        doc = np.searchsorted(shard.doc_starts, at, side="right")
        low = np.maximum(at - within, shard.doc_starts[doc - 1])
        high = np.minimum(at + within, shard.doc_starts[doc] - 1)
        for other in lists[1:]:
            near = np.searchsorted(other, high, side="right") > np.searchsorted(other, low, side="left")
            at, low, high = at[near], low[near], high[near]
        for p in at:
            yield w, int(p)


def _spans(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _rows(shard: Shard, spans: list, items: list[list[str]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard.number] * len(shard.doc_ids), pa.int64()),
            pa.array(range(len(shard.doc_ids)), pa.int32()),
            pa.array(shard.doc_ids, pa.int64()),
            pa.array(np.diff(shard.doc_starts), pa.int64()),
            pa.array(spans, kind),
            pa.array(items, pa.list_(pa.string())),
        ],
        ["shard", "row", "doc_id", "n_words", "spans", "items"],
    )


def search(shards: DataFrame, queries: Queries, within: int | None = None) -> DataFrame:
    """Per document: the word spans that phrase matches (or proximity matches) cover, and the items they belong to."""
    def run(batches):
        number = {t: k for k, t in enumerate(queries.terms)}
        for batch in batches:
            for row in range(len(batch)):
                shard = Shard(batch.slice(row, 1).to_pylist()[0], number, len(queries.terms))
                change = np.zeros(int(shard.doc_starts[-1]) + 1, np.int64)
                pairs = []
                if within is None:
                    hits = phrase_hits(shard, queries)
                else:
                    near = list(proximity_hits(shard, queries, within))
                    hits = [(np.array([w for w, _ in near], np.int64), np.array([p for _, p in near], np.int64))]
                for window, start in hits:
                    np.add.at(change, start, 1)
                    np.add.at(change, start + (queries.length[window] if within is None else 1), -1)
                    doc = np.searchsorted(shard.doc_starts, start, side="right") - 1
                    pairs.append(np.unique(np.stack([doc, window], axis=1), axis=0) if len(doc) else np.zeros((0, 2), np.int64))
                covered = np.cumsum(change)[:-1] > 0
                items: list[set] = [set() for _ in shard.doc_ids]
                for doc, window in np.concatenate(pairs) if pairs else []:
                    for h in queries.holders[queries.holder_starts[window] : queries.holder_starts[window + 1]]:
                        items[doc].add(queries.names[h])
                spans: list[list] = [[] for _ in shard.doc_ids]
                first, last = _spans(covered)
                for doc, a, b in zip(np.searchsorted(shard.doc_starts, first, side="right") - 1, first, last, strict=True):
                    # A run of covered words may go on in the next documents; cut it at their starts.
                    while a <= b:
                        end = min(b, int(shard.doc_starts[doc + 1]) - 1)
                        if a <= end:
                            base = int(shard.doc_starts[doc])
                            spans[doc].append({"first": int(a) - base, "last": end - base})
                        a, doc = end + 1, doc + 1
                yield _rows(shard, spans, [sorted(i) for i in items])

    return map_arrow(shards, run, FOUND)


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, words inside a matched window, and the items whose windows occur.

    The index has the terms of all blocks and is built once. What blocks find meets by shard and row.
    """
    terms: set[bytes] = set()
    for block in query_blocks(items, window, block_bytes):
        terms.update(block.terms)
    shards = build_index(docs, sorted(terms))
    found = [search(shards, q) for q in query_blocks(items, window, block_bytes)] or [search(shards, Queries([], window))]
    merged = found[0]
    if len(found) > 1:
        for part in found[1:]:
            merged = merged.union(part)
        merged = merged.groupBy("shard", "row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"),
        )

    def summed(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                hit, upto = 0, -1
                for s in sorted((s["first"], s["last"]) for s in row["spans"]):
                    hit += max(0, s[1] - max(s[0] - 1, upto))
                    upto = max(upto, s[1])
                names = set(row["items"])
                out.append((row["doc_id"], row["n_words"], hit, len(names), _digest(names), hit > 0))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
            names_ = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names_)

    return map_arrow(merged, summed, RESULT)


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any matched window; rows with a null ``doc_id`` are judged by nothing and stay."""
    hit = contamination(docs, items).where("contaminated AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
