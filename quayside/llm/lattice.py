"""Language-model scores from the lattice of all subword segmentations.

The vocabulary is that of a public tokenizer; it is not changed. Its pieces are weighed by unigram scores that
are re-estimated on the training words: in each round, forward and backward sums over a word's lattice give the
expected number of times each piece is used. A word's lattice has an edge for every piece that fits, and one
edge from start to end for a word seen in training, weighed by its count less a discount; the mass of the
discounts goes to the pieces. The forward sum at the end of a word, in log space, is its marginal probability
over all segmentations; a text's is the product over its words and one end symbol. Every byte is a piece of its
own, so that no word is without a segmentation, and pieces that end a word are distinct from those that don't,
so that the probabilities of all texts add up to one at most. As in other discounted models, each distinct
word counts once when the pieces are fitted.

Words never share a lattice edge, so a word's forward sum is computed once per distinct word, not per
occurrence. Counts and scores cover all words of all documents. Frequent words (a bounded number) are sent to
the tasks; the others meet their scores over a join.

Cases. Null and empty texts are just the end symbol. Words of any length are scored, in steps of one byte; of a long
one only the sums that its longest piece reaches back to are held, and in training its forward sums, 8 bytes a byte.
Repeated documents count and are scored each. Without training documents, pieces keep equal scores.
"""

import json
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import encoded_words, map_arrow, slices, written

ROUNDS = 2
# Taken from the count of every training word, and given to the pieces.
DISCOUNT = 0.75
# So many words, at most, are sent to the tasks with their counts and scores.
FREQUENT = 65_536
# Words that share a forward recursion, and its longest piece in bytes.
LANES = 1 << 14
# Longer words are walked alone. A part of so many starts has its edges at hand.
LONG_WORD = 1_024
STARTS = 1 << 16

# The byte alphabet of public byte-level vocabularies. Printable bytes stand for themselves; the
# others, in ascending order, for the code points from 256 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def piece_bytes(vocabulary: str, word_end: str = "</w>") -> list[tuple[bytes, bool]]:
    """A tokenizers file with byte-level pieces -> (bytes, ends a word), without pieces that are no bytes."""
    back = {chr(b): b for b in PRINTABLE}
    back |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(PRINTABLE))}
    pieces = set()
    for piece in json.loads(vocabulary)["model"]["vocab"]:
        body = piece.removesuffix(word_end)
        if body and all(c in back for c in body):
            pieces.add((bytes(back[c] for c in body), body != piece))
    for b in range(256):
        pieces |= {(bytes([b]), False), (bytes([b]), True)}
    return sorted(p for p in pieces if not any(65 <= b <= 90 for b in p[0]))


class Trie:
    """Pieces as sorted (state, byte) edges; a state knows the inner and the word-final piece that end there."""

    def __init__(self, pieces: list[tuple[bytes, bool]]):
        self.size = len(pieces)
        self.longest = max(len(p) for p, _ in pieces)
        states = {b"": 0}
        for p, _ in pieces:
            for k in range(1, len(p) + 1):
                states.setdefault(p[:k], len(states))
        edges = sorted((states[s[:-1]] * 256 + s[-1], k) for s, k in states.items() if s)
        self.keys = np.array([e for e, _ in edges], np.int64)
        self.next = np.array([k for _, k in edges], np.int32)
        self.inner = np.full(len(states), -1, np.int32)
        self.final = np.full(len(states), -1, np.int32)
        for k, (p, ends) in enumerate(pieces):
            (self.final if ends else self.inner)[states[p]] = k
        root = np.full(256, -1, np.int32)
        has = self.keys < 256
        root[self.keys[has]] = self.next[has]
        self.root = root

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        want = state.astype(np.int64) * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.next[at], -1)


def _edges(trie: Trie, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Lattice edges of equally long words (rows of bytes): (start, end, word numbers, pieces)."""
    n = words.shape[1]
    found = []
    for start in range(n):
        rows = np.arange(len(words))
        state = trie.root[words[:, start]]
        for end in range(start + 1, min(n, start + trie.longest) + 1):
            if end > start + 1:
                state = trie.step(state, words[rows, end - 1])
            live = state >= 0
            if not live.all():
                rows, state = rows[live], state[live]
            if not len(rows):
                break
            piece = (trie.final if end == n else trie.inner)[state]
            has = piece >= 0
            if has.any():
                found.append((start, end, rows[has], piece[has]))
    return found


def _edges_from(trie: Trie, word: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of one word that start in [first, last), by start: starts, lengths, pieces."""
    n, length = len(word), 1
    at = np.arange(first, last)
    state = trie.root[word[at]]
    found = []
    while len(at):
        live = state >= 0
        at, state = at[live], state[live]
        piece = np.where(at + length == n, trie.final[state], trie.inner[state])
        has = piece >= 0
        found.append((at[has], np.full(int(has.sum()), length), piece[has]))
        inside = at + length < n
        at, state = at[inside], state[inside]
        state = trie.step(state, word[at + length])
        length += 1
    starts, lengths, pieces = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(starts, kind="stable")
    return starts[order], lengths[order], pieces[order]


def _log_sum(values: list[float]) -> float:
    if len(values) == 1:
        return values[0]
    most = max(values, default=-math.inf)
    return most if most == -math.inf else most + math.log(sum([math.exp(v - most) for v in values]))


def _forward_long(trie: Trie, scores: np.ndarray, word: np.ndarray, count: float = 0, expected: np.ndarray | None = None) -> float:
    """As :func:`forward`, for one word, part by part."""
    n, ring = len(word), trie.longest + 1
    alpha = np.zeros(n if expected is not None else 0)
    arriving: list[list[float]] = [[] for _ in range(ring)]
    arriving[0] = [0.0]
    parts = range(0, n, STARTS)
    for first in parts:
        last = min(n, first + STARTS)
        starts, lengths, pieces = _edges_from(trie, word, first, last)
        bounds = np.searchsorted(starts, np.arange(first, last + 1)).tolist()
        lengths, weights = lengths.tolist(), scores[pieces].tolist()
        sums = []
        for k in range(last - first):
            place = first + k
            here = _log_sum(arriving[place % ring])
            arriving[place % ring] = []
            sums.append(here)
            for e in range(bounds[k], bounds[k + 1]):
                arriving[(place + lengths[e]) % ring].append(here + weights[e])
        if expected is not None:
            alpha[first:last] = sums
    total = _log_sum(arriving[n % ring])
    if expected is None:
        return total
    beta = [0.0] * ring  # of the places behind, that of the end being zero
    for first in reversed(parts):
        last = min(n, first + STARTS)
        starts, lengths, pieces = _edges_from(trie, word, first, last)
        bounds = np.searchsorted(starts, np.arange(first, last + 1)).tolist()
        steps, weights = lengths.tolist(), scores[pieces].tolist()
        through = [0.0] * len(starts)
        for k in range(last - first - 1, -1, -1):
            place, a, b = first + k, bounds[k], bounds[k + 1]
            values = [weights[e] + beta[(place + steps[e]) % ring] for e in range(a, b)]
            through[a:b] = values
            beta[place % ring] = _log_sum(values)
        use = np.exp(alpha[starts] + np.array(through) - total) * count
        expected += np.bincount(pieces, use, minlength=len(expected))
    return total


def forward(trie: Trie, scores: np.ndarray, words: np.ndarray, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
    """Natural log marginals of equally long words; with ``counts``, adds expected piece uses to ``expected``."""
    n, m = words.shape[1], len(words)
    if n > LONG_WORD:
        times = np.zeros(m) if counts is None else counts
        return np.array([_forward_long(trie, scores, w, c, None if counts is None else expected) for w, c in zip(words, times, strict=True)])
    edges = _edges(trie, words)
    alpha = np.full((n + 1, m), -np.inf)
    alpha[0] = 0
    for start, end, rows, piece in edges:  # by start, so that alpha[start] is complete
        alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + scores[piece])
    total = alpha[n]
    if counts is not None:
        beta = np.full((n + 1, m), -np.inf)
        beta[n] = 0
        for start, end, rows, piece in reversed(edges):
            through = scores[piece] + beta[end, rows]
            beta[start, rows] = np.logaddexp(beta[start, rows], through)
            use = np.exp(alpha[start, rows] + through - total[rows]) * counts[rows]
            expected += np.bincount(piece, use, minlength=len(expected))
    return total


def by_length(words: pa.Array) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, rows of bytes) of equally long words, some at a time."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        lanes = max(1, LANES // max(1, int(n) // 16))
        for k in range(0, len(at), lanes):
            some = at[k : k + lanes]
            data = b"".join(words.take(pa.array(some)).to_pylist())
            yield some, np.frombuffer(data, np.uint8).reshape(len(some), int(n))


def word_counts(docs: DataFrame, training: str) -> DataFrame:
    """(word, n): distinct words of all documents and their number in those for which ``training`` holds."""

    def count(batches):
        for batch in slices(batches):
            codes, distinct, rows = encoded_words(batch.column("text"))
            if not len(codes):
                continue
            learned = np.repeat(batch.column("training").to_numpy(zero_copy_only=False), np.diff(rows))
            n = np.bincount(codes[learned], minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([distinct.cast(pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    seen = docs.select("text", F.expr(training).alias("training"))
    return map_arrow(seen, count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def piece_uses(words: DataFrame, trie: Trie, scores: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in the distinct training words: one number per piece of the vocabulary."""
    def expect(batches):
        expected = np.zeros(trie.size)
        for batch in batches:
            for some, rows in by_length(batch.column("word")):
                forward(trie, scores, rows, np.ones(len(some)), expected)
        used = np.flatnonzero(expected)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(expected[used])], ["piece", "uses"])

    sums = map_arrow(words.where("n > 0"), expect, "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
    uses = np.zeros(trie.size)
    for r in sums.collect():
        uses[r.piece] = r.uses
    return uses


def fit_scores(words: DataFrame, trie: Trie, rounds: int = ROUNDS) -> np.ndarray:
    """Natural log scores of the pieces, from equal ones on.

    Each piece keeps a thousandth of a use, so that none becomes impossible.
    """
    scores = np.full(trie.size, -np.log(trie.size))
    for _ in range(rounds):
        uses = piece_uses(words, trie, scores) + 0.001
        scores = np.log(uses / uses.sum())
    return scores


def with_whole_word(log_pieces: np.ndarray, counts: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
    """Log marginals with the edge that spans a whole training word; ``tokens`` and ``distinct`` of training."""
    if not tokens:
        return log_pieces
    whole = np.log(np.maximum(counts - DISCOUNT, 1e-300)) - np.log(tokens)
    return np.logaddexp(np.where(counts > 0, whole, -np.inf), log_pieces + np.log(DISCOUNT * distinct / tokens))


def scored_words(words: DataFrame, trie: Trie, scores: np.ndarray, tokens: int, distinct: int) -> DataFrame:
    """Words with ``score``: log10 of their marginal probability."""
    def score(batches):
        for batch in batches:
            out, n = np.zeros(len(batch)), batch.column("n").to_numpy().astype(float)
            for some, rows in by_length(batch.column("word")):
                out[some] = with_whole_word(forward(trie, scores, rows), n[some], tokens, distinct) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(out)], ["word", "n", "score"])

    return map_arrow(words, score, "word binary, n bigint, score double")


PARTS = "row bigint, doc_id bigint, training boolean, tokens bigint, known bigint, logs double, score double, words array<struct<word:binary,times:bigint>>"


def score_documents(docs: DataFrame, vocabulary: str, training: str, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``vocabulary`` is the text of a tokenizers file with byte-level pieces; ``training`` a condition on the
    columns of ``docs``. ``base_score`` is the word model with one added to every count.
    """
    spark = docs.sparkSession
    trie = Trie(piece_bytes(vocabulary))
    counts = written(word_counts(docs, training), "words")
    ends = docs.where(training).count()
    sizes = counts.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n, v = (sizes.n or 0) + ends, sizes.v + (ends > 0)
    table = written(scored_words(counts, trie, fit_scores(counts, trie, rounds), n, v), "scored-words")
    # The end symbol is a token like the words; it has no pieces, so what it keeps of its count is its weight.
    end = np.log(max(ends - DISCOUNT, DISCOUNT) / n) if n else -np.log(trie.size)
    top = table.orderBy(F.desc("n"), "word").limit(frequent).collect()
    known = spark.sparkContext.broadcast(
        ([r.word for r in top], np.array([r.n for r in top], np.int64), np.array([r.score for r in top], float))
    )

    def parts(batches):
        words, counts, scores = known.value
        listed = pa.array([bytes(w) for w in words], pa.binary())
        for batch in slices(batches):
            codes, distinct, rows = encoded_words(batch.column("text"))
            m = len(batch)
            row = np.repeat(np.arange(m), np.diff(rows))
            pair, times = np.unique(row * (len(distinct) + 1) + codes, return_counts=True)
            row, word = pair // (len(distinct) + 1), pair % (len(distinct) + 1)
            at = pc.index_in(distinct, value_set=listed).fill_null(-1).to_numpy(zero_copy_only=False)[word] if len(word) else word
            near = at >= 0
            r, t, k = row[near], times[near], at[near]
            c = counts[k]
            far = np.flatnonzero(~near)
            starts = np.searchsorted(row[far], np.arange(m + 1)).astype(np.int32)
            struct = pa.StructArray.from_arrays([distinct.take(pa.array(word[far])), pa.array(times[far], pa.int64())], ["word", "times"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("training"),
                    pa.array(np.diff(rows) + 1, pa.int64()),
                    pa.array(np.bincount(r, t * (c > 0), minlength=m).astype(np.int64)),
                    pa.array(np.bincount(r, t * np.log10(c + 1.0), minlength=m).astype(float)),
                    pa.array(np.bincount(r, t * scores[k], minlength=m).astype(float)),
                    pa.ListArray.from_arrays(pa.array(starts), struct),
                ],
                ["doc_id", "training", "tokens", "known", "logs", "score", "words"],
            )

    schema = PARTS.removeprefix("row bigint, ")
    # Written, so that both readers see the same rows; a row's number need not be stable beyond that.
    seen = written(map_arrow(docs.select("doc_id", "text", F.expr(training).alias("training")), parts, schema), "document-words")
    numbered = seen.withColumn("row", F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    pairs = numbered.select("row", F.inline("words")).join(table, "word")
    rest = pairs.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"),
        F.sum(F.col("times") * F.col("score")).alias("more_score"),
    )
    both = numbered.drop("words").join(rest, "row", "left")
    zero = F.lit(0.0)
    total = np.log10(n + v + 1)
    return both.select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(1 if ends else 0)).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", zero) + F.lit(float(np.log10(ends + 1))) - F.col("tokens") * F.lit(float(total))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero) + F.lit(float(end / np.log(10)))).alias("score"),
    )
