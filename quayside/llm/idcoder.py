"""Token ids in compressed, checksummed files.

Layout. A file is a Parquet table with a row per segment: some documents in ascending order of ``doc_id``, their
token numbers, and one binary value with all their ids. That value holds a header (the segment's ids by falling
frequency, and how often each frequency class occurs), a table of blocks, and the blocks. A block has about
``BLOCK`` ids, starts from the same state as every other, and has a CRC-32 of its ids, so that blocks can be read
alone and damage is found where it is.

Model. Ids are coded by their frequency rank. Three predictions are mixed: order 2 names the rank that followed
the last two ids before, order 1 the one that followed the last id, and order 0 spreads over frequency classes,
whose shares adapt, and evenly within a class. The weights of the mix adapt, too, apart for every pair of
confidences of order 2 and order 1. An arithmetic range coder with 64-bit ranges gives a rank that order 2 or
order 1 names their share of the range, and any other one its part of the rest, by order 0.

Blocks advance together, an id each per step, those of several segments if ``LANES`` has room: the state of the
models is one numpy array per part, for all blocks. What is coded with a block does not change its bytes. Spark's
writer commits the files, so a lost executor leaves none behind.

Cases. Null and empty texts have only the end id. A null ``doc_id`` comes first. Rows with one ``doc_id`` are
ordered by text. A text of any length is in one segment; segments of long texts have more blocks, not longer ones.
"""

import hashlib
import os
import re
import struct
import sys
import types
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import ASCII_SPACE, SPACE_WORDS, map_arrow, slices, text_buffers, word_bounds
from quayside.session import work_path

MAGIC = b"QIDS\x02"
BLOCK = 1024
LANES = 4096  # blocks that advance together
TEXT_BYTES = 4 << 20  # of a segment
KEPT_WORDS, KEPT_BYTES = 500_000, 64 << 20  # of one process

SLOTS = 1 << 10  # contexts an order remembers in a block
SURE = 4  # confidences 1 to 4; 0 is an empty slot
RATE = 5
WHOLE, MOST = 1 << 16, (1 << 16) - (1 << 11)  # of the weights; order 0 keeps about what lies between
BOTH = np.uint32((WHOLE + 1) * ((WHOLE >> RATE) - 1))  # what is left of two halves, each shifted by RATE
NONE, GAIN1, GAIN2 = np.uint32(0), np.uint32(MOST >> RATE), np.uint32(MOST >> RATE << 16)
CLASS_BITS = 15
CLASS_WHOLE, LEAST = 1 << CLASS_BITS, 32  # of the class shares, and the least of them
START_WEIGHT = (0, 5_000, 14_000, 24_000, 30_000)  # of a prediction by its confidence

U = np.uint64
FULL = U(1 << 48)  # a range is at least this wide
LOWER_SECOND = np.arange(256, dtype=np.uint8)  # bytes after 0xC3: the letters from U+00C0 to U+00DE in lower case
LOWER_SECOND[0x80:0x9F] += 0x20


class Models:
    """The state of all models for some blocks, a column or stretch per block. ``advance`` is the same for both directions.

    Ranks count from 1 here. A slot of a context holds a rank and how sure it is, 8 * rank + confidence; what belongs
    to both orders has a row for order 1 and one for order 2. The weights of both share a number, order 2's is the
    upper half. Weights of empty slots are zero and stay so, others stay above zero, and both together below ``WHOLE``.
    """

    def __init__(self, priors: list[np.ndarray]):
        """``priors``: the class shares that each block starts with."""
        self.blocks = blocks = len(priors)
        classes = np.array([len(p) - 1 for p in priors], np.int16)
        self.shares = np.full((max(classes) + 1, blocks), CLASS_WHOLE, np.uint16)
        for prior in {id(p): p for p in priors}.values():
            self.shares[: len(prior), [p is prior for p in priors]] = prior[:, None]
        self.flat, self.inner = self.shares.reshape(-1), self.shares[1:-1]
        self.at = np.arange(1, max(classes), dtype=np.int16)[:, None]
        # What moves the upper bounds of classes: each class gets the least share, the one that came all that is free.
        self.least = np.minimum(self.at, classes) * np.int16(LEAST >> RATE)
        self.free = (CLASS_WHOLE - LEAST * classes.astype(np.int64) >> RATE).astype(np.int16)
        self.slots = np.zeros(2 * blocks * SLOTS, np.int32)
        start = np.array(START_WEIGHT, np.uint32)
        self.weights = np.tile(np.add.outer(start << 16, start).reshape(-1), blocks)
        row = np.arange(blocks)
        self.weight, self.edges = row * (SURE + 1) ** 2, np.stack([row, row + blocks])
        self.context = np.stack([row, row + blocks]) * SLOTS
        self.last, self.before = np.zeros((2, blocks), np.int64)

    def narrow(self, m: int) -> None:
        """Go on with the first ``m`` blocks."""
        self.inner, self.least, self.free = self.inner[:, :m], self.least[:, :m], self.free[:m]
        self.weight, self.edges = self.weight[:m], self.edges[:, :m]
        self.context, self.last, self.before = self.context[:, :m], self.last[:m], self.before[:m]

    def predict(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks that order 1 and 2 name, and what they get of ranges of ``WHOLE`` units."""
        at = np.empty(self.context.shape, np.int64)
        np.multiply(self.last, 40503, out=at[0])
        np.add(at[0], self.before, out=at[1])
        at >>= 4
        at &= SLOTS - 1
        at += self.context
        self.chosen = at.reshape(-1)
        self.slot = self.slots.take(at)
        self.sure = self.slot & 7
        named = self.slot >> 3
        self.state = self.sure[1] * (SURE + 1) + self.sure[0] + self.weight
        self.both = self.weights.take(self.state)
        both = self.both.astype(U)
        weight = np.empty(at.shape, U)
        np.bitwise_and(both, U(0xFFFF), out=weight[0])
        weight[0] *= named[0] != named[1]
        np.right_shift(both, U(16), out=weight[1])
        weight *= unit
        return named, weight

    def class_part(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of classes in order 0."""
        first, size = self.flat.take(kind * self.blocks + self.edges).astype(U)
        size -= first
        return first, size

    def class_at(self, place: np.ndarray) -> np.ndarray:
        """The class with a place in order 0."""
        over = place.astype(np.uint16) >= self.inner
        return np.add.reduce(over.view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)

    def advance(self, rank: np.ndarray, small: np.ndarray, kind: np.ndarray, hit: np.ndarray) -> None:
        """Learn ranks, also given as 32-bit numbers, their classes, and where order 1 and 2 named them."""
        both = self.both
        both -= both >> RATE & BOTH
        both += np.where(hit[1], GAIN2, np.where(hit[0], GAIN1, NONE))
        self.weights[self.state] = both
        fresh = small << 3
        fresh += 1
        fresh = np.where(self.sure > 1, self.slot - 1, fresh)
        self.slots[self.chosen] = np.where(hit, self.slot + (self.sure < SURE), fresh).reshape(-1)
        step = kind.astype(np.int16) - self.at
        step >>= 15
        step &= self.free
        step += self.least
        self.inner -= self.inner >> RATE
        self.inner += step.view(np.uint16)
        self.last, self.before = rank, self.last * 60493


def class_of(rank: np.ndarray) -> np.ndarray:
    """Ranks 0, 1-2, 3-6, ... are the classes 0, 1, 2, ...; class c has 2**c ranks."""
    return np.frexp((rank + 1).astype(np.float64))[1].astype(np.int64) - 1


def _lengths(n: int) -> np.ndarray:
    blocks = -(-n // BLOCK)
    return np.full(blocks, n // blocks) + (np.arange(blocks) < n % blocks)


def _lasting(lengths: np.ndarray) -> np.ndarray:
    """Falling lengths of blocks -> how many blocks each step has."""
    return np.searchsorted(-lengths, -np.arange(lengths[0]))


def _encode_blocks(ranks: np.ndarray, lengths: np.ndarray, priors: list[np.ndarray]) -> list[bytes]:
    """The ranks of blocks of falling lengths -> the blocks' code."""
    blocks, longest, lasting = len(lengths), int(lengths[0]), _lasting(lengths)
    steps = np.zeros((blocks, longest), np.int32)
    steps[np.arange(longest) < lengths[:, None]] = ranks
    steps = np.ascontiguousarray(steps.T)
    steps += 1
    models = Models(priors)
    low, width = np.zeros(blocks, U), np.full(blocks, 2**64 - 1, U)
    out, at = np.zeros((longest + 64) * blocks, np.uint32), np.arange(blocks)
    kinds = class_of(np.arange(-1, int(ranks.max()) + 1))
    places = (np.arange(len(kinds)) - (1 << np.maximum(kinds, 0))).astype(U)
    lows, ats = low, at
    for step, m in enumerate(lasting):
        if m < len(low):
            models.narrow(m)
            low, width, at = low[:m], width[:m], at[:m]
        small = steps[step, :m]
        rank = small.astype(np.int64)
        kind = kinds.take(rank)
        named, (big1, big2) = models.predict(width >> U(16))
        hit = named == small
        flat = big2 + big1
        width -= flat
        width >>= U(CLASS_BITS)
        first, size = models.class_part(kind)
        first *= width
        flat += first
        size *= width
        size >>= kind.view(U)
        flat += size * places.take(rank)
        start = np.where(hit[1], U(0), np.where(hit[0], big2, flat))
        width = np.where(hit[1], big2, np.where(hit[0], big1, size))
        low += start
        over = np.flatnonzero(low < start)
        out[at[over] - blocks] += 1  # carries on are settled at the end
        models.advance(rank, small, kind, hit)
        if not step % 8 and at.max() + 40 * blocks > len(out):
            out = np.concatenate([out, np.zeros_like(out)])
        # Most that need to, write one word; what others write is overwritten.
        out[at] = (low >> U(48)).astype(np.uint32)
        need = (width < FULL).astype(np.int64)
        at += need * blocks
        need <<= 4
        low <<= need.view(U)
        width <<= need.view(U)
        need = np.flatnonzero(width < FULL)
        while len(need):
            out[at[need]] = low[need] >> U(48)
            at[need] += blocks
            low[need] <<= U(16)
            width[need] <<= U(16)
            need = need[width[need] < FULL]
    for _ in range(4):
        out[ats] = lows >> U(48)
        lows <<= U(16)
        ats += blocks
    out, upto = out.reshape(-1, blocks), ats // blocks
    for k in range(int(upto.max()) - 1, 0, -1):
        out[k - 1] += out[k] >> 16
        out[k] &= 0xFFFF
    code = np.ascontiguousarray(out[: upto.max()].astype("<u2").T)
    return [code[k, :n].tobytes() for k, n in enumerate(upto)]


def _decode_blocks(codes: list[np.ndarray], lengths: np.ndarray, priors: list[np.ndarray]) -> np.ndarray:
    """Codes of blocks of falling lengths -> ranks, (blocks, steps)."""
    blocks = len(lengths)
    models = Models(priors)
    words = np.zeros((blocks, max(len(c) for c in codes) + 8), np.uint16)
    for k, c in enumerate(codes):
        words[k, : len(c)] = c
    words = words.T.reshape(-1)
    value, at = np.zeros(blocks, U), np.arange(blocks)
    for _ in range(4):
        value = value << U(16) | words[at]
        at += blocks
    width = np.full(blocks, 2**64 - 1, U)
    out, left = np.zeros((int(lengths[0]), blocks), np.int32), False
    kinds = class_of(np.arange(-1, (1 << len(models.shares) - 1) - 1))
    for step, m in enumerate(_lasting(lengths)):
        if m < len(value):
            models.narrow(m)
            left |= value[m:].any()
            value, width, at = value[:m], width[:m], at[:m]
        ranks = out[step, :m]
        named, (big1, big2) = models.predict(width >> U(16))
        flat = big2 + big1
        by2, by0 = value < big2, value >= flat
        # What comes of order 0 where another one names the rank doesn't count, but is in bounds.
        width -= flat
        width >>= U(CLASS_BITS)
        rest = value - flat
        kind = models.class_at(np.minimum(rest // width, U(CLASS_WHOLE - 1)))
        first, size = models.class_part(kind)
        first *= width
        rest -= first
        size *= width
        size >>= kind.view(U)
        lowest = 1 << kind
        place = np.minimum(rest // size, (lowest - 1).view(U))
        rest -= place * size
        lowest += place.view(np.int64)
        ranks[:] = np.where(by2, named[1], np.where(by0, lowest.astype(np.int32), named[0]))
        value = np.where(by2, value, np.where(by0, rest, value - big2))
        width = np.where(by2, big2, np.where(by0, size, big1))
        rank = ranks.astype(np.int64)
        models.advance(rank, ranks, kinds.take(rank, mode="clip"), named == ranks)
        need = (width < FULL).astype(np.int64)
        word = words.take(at, mode="clip").astype(U)
        word *= need.view(U)
        at += need * blocks
        need <<= 4
        value <<= need.view(U)
        value |= word
        width <<= need.view(U)
        need = np.flatnonzero(width < FULL)
        while len(need):
            value[need] = value[need] << U(16) | words.take(at[need], mode="clip")
            at[need] += blocks
            width[need] <<= U(16)
            need = need[width[need] < FULL]
    if left or value.any():  # all of a code is the start of its last range
        raise ValueError("damaged code of a block")
    out -= 1
    return np.ascontiguousarray(out.T)


def class_prior(counts: np.ndarray) -> np.ndarray:
    """How often ranks occur -> cumulative class shares; each class has at least ``LEAST``."""
    kinds = class_of(np.arange(len(counts)))
    total = np.bincount(kinds, counts)
    shares = LEAST + np.floor(total * (CLASS_WHOLE - LEAST * len(total)) / max(total.sum(), 1)).astype(np.int64)
    shares[0] += CLASS_WHOLE - shares.sum()
    return np.concatenate([[0], np.cumsum(shares)])


def _together(lengths: list[np.ndarray]) -> list[np.ndarray]:
    """Lengths of the blocks of some segments -> places of those that advance together, longest first."""
    every = np.concatenate([np.zeros(0, np.int64), *lengths])
    return np.array_split(np.argsort(-every, kind="stable"), -(-len(every) // LANES)) if len(every) else []


def encode_segments(segments: list[np.ndarray]) -> list[bytes]:
    """Ids of segments -> their binary values."""
    ranked, priors, lengths, heads = [], [], [], []
    for ids in segments:
        if not len(ids):
            lengths.append(np.zeros(0, np.int64))
            heads.append(b"")
            continue
        if ids.max() < 1 << 20:  # vocabularies are small; count instead of sorting
            counts = np.bincount(ids)
            known = np.flatnonzero(counts)
            counts, number = counts[known], (np.cumsum(counts > 0) - 1)[ids]
        else:
            known, number, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.lexsort((known, -counts))
        rank_of = np.empty(len(known), np.int32)
        rank_of[order] = np.arange(len(known))
        prior = class_prior(counts[order])
        lengths.append(_lengths(len(ids)))
        ranked += np.split(rank_of[number], np.cumsum(lengths[-1])[:-1])
        priors += [prior] * len(lengths[-1])
        wide = "<u2" if known[-1] < 1 << 16 else "<u4"
        head = struct.pack("<QIII", len(ids), len(lengths[-1]), len(known), int(wide[-1]))
        heads.append(head + known[order].astype(wide).tobytes() + prior.astype("<u4").tobytes())
    codes: list[bytes] = [b""] * len(priors)
    for some in _together(lengths):
        ranks = [ranked[k] for k in some]
        made = _encode_blocks(np.concatenate(ranks), np.array([len(r) for r in ranks]), [priors[k] for k in some])
        for k, code in zip(some, made, strict=True):
            codes[k] = code
    out, done = [], 0
    for ids, n, head in zip(segments, lengths, heads, strict=True):
        if not len(ids):
            out.append(MAGIC + struct.pack("<QIII", 0, 0, 0, 0))
            continue
        mine = codes[done : done + len(n)]
        done += len(n)
        plain, ends = ids.astype("<u4"), np.cumsum(n)
        sums = [zlib.crc32(plain[b - k : b]) for b, k in zip(ends, n, strict=True)]
        head += np.array([[len(c), s] for c, s in zip(mine, sums, strict=True)], "<u4").tobytes()
        out.append(MAGIC + head + struct.pack("<I", zlib.crc32(head)) + b"".join(mine))
    return out


def encode_ids(ids: np.ndarray) -> bytes:
    """Ids of a segment -> its binary value."""
    return encode_segments([ids])[0]


def decode_segments(values: list[bytes]) -> list[np.ndarray]:
    """The binary values of segments -> their ids. Raises ``ValueError`` where a checksum does not fit."""
    codes, priors, lengths, tables = [], [], [], []
    for data in values:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("no segment of ids")
        n, blocks, known, width = struct.unpack_from("<QIII", data, len(MAGIC))
        if not n:
            lengths.append(np.zeros(0, np.int64))
            tables.append((np.zeros(0, np.uint32), np.zeros(0, np.uint32)))
            continue
        at = begin = len(MAGIC)
        at += struct.calcsize("<QIII")
        by_rank = np.frombuffer(data, f"<u{width}", known, at).astype(np.uint32)
        at += known * width
        classes = int(class_of(np.array([known - 1]))[0]) + 1
        prior = np.frombuffer(data, "<u4", classes + 1, at)
        at += 4 * (classes + 1)
        table = np.frombuffer(data, "<u4", 2 * blocks, at).reshape(blocks, 2)
        at += 8 * blocks
        if struct.unpack_from("<I", data, at)[0] != zlib.crc32(data[begin:at]):
            raise ValueError("damaged header")
        at += 4
        ends = at + np.cumsum(table[:, 0].astype(np.int64))
        codes += [np.frombuffer(data, "<u2", int(size) // 2, int(end - size)) for end, size in zip(ends, table[:, 0], strict=True)]
        priors += [prior] * blocks
        lengths.append(_lengths(n))
        tables.append((by_rank, table[:, 1]))
    every = np.concatenate([np.zeros(0, np.int64), *lengths])
    ranked: list[np.ndarray] = [np.zeros(0, np.int32)] * len(every)
    for some in _together(lengths):
        ranks = _decode_blocks([codes[k] for k in some], every[some], [priors[k] for k in some])
        for k, row in zip(some, ranks, strict=True):
            ranked[k] = row[: every[k]]
    out, done = [], 0
    for n, (by_rank, sums) in zip(lengths, tables, strict=True):
        mine = ranked[done : done + len(n)]
        done += len(n)
        ids = by_rank.take(np.concatenate(mine), mode="clip") if len(n) else by_rank
        plain, ends = ids.astype("<u4"), np.cumsum(n)
        for b, (end, k) in enumerate(zip(ends, n, strict=True)):
            if zlib.crc32(plain[end - k : end]) != sums[b]:
                raise ValueError(f"damaged block {b}")
        out.append(ids)
    return out


def decode_ids(data: bytes) -> np.ndarray:
    """The binary value of a segment -> its ids. Raises ``ValueError`` where a checksum does not fit."""
    return decode_segments([data])[0]


# Words of these bytes only are split and spelled here; the library does it for others. They are printable ASCII
# but for the bar of special tokens, and the letters from U+00C0 to U+00FF: 0xC3 and its second bytes, without
# those of the two signs among them.
PLAIN = np.zeros(256, bool)
PLAIN[0x21:0x7F] = PLAIN[0x80:0xC0] = PLAIN[0xC3] = True
PLAIN[[ord("|"), 0x97, 0xB7]] = False
# Fixed value: the split pattern of the vocabulary, for such words in lower case.
_PARTS = re.compile(r"('s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+)")

SPACE, LETTER, DIGIT, SIGN, WHOLE_WORD = range(5)
SORT = np.full(256, WHOLE_WORD, np.uint8)  # of bytes; apostrophes may go with letters, so such words stay whole
SORT[PLAIN] = SIGN
SORT[0x61:0x7B] = SORT[0x41:0x5B] = LETTER
SORT[0x80:] = np.where(PLAIN[0x80:], LETTER, WHOLE_WORD)
SORT[0x30:0x3A] = DIGIT
SORT[ord("'")] = WHOLE_WORD
SORT[sorted(ASCII_SPACE)] = SPACE


def encoded_parts(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of the parts of all texts, the distinct parts they stand for, and the part offsets of the rows.

    Parts are what the split pattern makes of plain words in lower case; other words, and those with an apostrophe, are
    one part as they are. So every part has the ids that it has as a word.
    """
    raw, rows = text_buffers(texts)
    sort, data = SORT[raw], SPACE_WORDS[raw]
    second = np.flatnonzero(raw == 0xC3) + 1
    data[second] = LOWER_SECOND[raw[second]]
    odd = sort == WHOLE_WORD
    if odd.any():
        starts, ends = word_bounds(sort != SPACE, rows)
        whole = np.bitwise_or.reduceat(odd.view(np.uint8), starts).view(bool)
        starts, lengths = starts[whole], (ends - starts)[whole]
        upto = np.cumsum(lengths)
        at = np.arange(upto[-1]) + np.repeat(starts - upto + lengths, lengths)
        sort[at], data[at] = WHOLE_WORD, raw[at]
    inside = sort != SPACE
    begins = inside.copy()
    if len(raw):
        begins[1:] &= (sort[1:] != sort[:-1]) | (sort[1:] == DIGIT)
        filled = rows[:-1][rows[:-1] < rows[1:]]
        begins[filled] = inside[filled]
    data = data[inside]
    offsets = np.append(np.flatnonzero(begins[inside]), len(data))
    small = len(data) < 2**31
    buffers = [None, pa.py_buffer(offsets.astype(np.int32 if small else np.int64)), pa.py_buffer(data)]
    parts = pa.Array.from_buffers(pa.binary() if small else pa.large_binary(), len(offsets) - 1, buffers)
    coded = parts.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.searchsorted(np.flatnonzero(begins), rows)


class WordTokenizer:
    """Ids of texts by a tokenizer that never joins what white space separates.

    Each distinct part of words is encoded once by the library and its ids are put in place of it; a bounded number
    of them is remembered from one batch to the next, and by a worker process from one task to the next. Plain ones
    are merged by the library many at a time: they are handed over in the byte alphabet, and the last piece is the
    one that ends a word.
    """

    def __init__(self, tokenizer_json: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # This module comes anew with each task, so what the process keeps has a place of its own. It is one tokenizer's.
        self.kept = vars(sys.modules.setdefault("quayside_kept_words", types.ModuleType("quayside_kept_words")))
        key = hashlib.sha256(tokenizer_json.encode()).digest()
        if self.kept.get("key") != key:
            words = pa.array([], pa.large_binary()), np.zeros(0, np.uint32), np.zeros(1, np.int64)
            self.kept.update(tools=self._tools(tokenizer_json), words=words, key=key)
        self.tokenizer, self.merges, self.ends, self.odd = self.kept["tools"]
        self.words, self.ids, self.starts = self.kept["words"]
        self.end_id = end_id

    @staticmethod
    def _tools(tokenizer_json: str) -> tuple:
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_str(tokenizer_json)
        merges = Tokenizer(tokenizer.model)
        merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        ends = np.zeros(max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0) + 1, bool)
        for piece, k in tokenizer.get_vocab(with_added_tokens=False).items():
            ends[k] = piece.endswith("</w>")
        # Bytes that are spelled otherwise than by the code point of their number.
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        odd = [(chr(c & 0x3F | 0x80), spelled.pre_tokenize_str(chr(c))[0][0][1]) for c in range(0xC0, 0x100)]
        return tokenizer, merges, ends, [(a, b) for a, b in odd if a != b]

    def _keep(self, words: pa.Array, ids: np.ndarray, starts: np.ndarray) -> None:
        if len(words) <= KEPT_WORDS and words.nbytes + ids.nbytes + starts.nbytes <= KEPT_BYTES:
            self.words, self.ids, self.starts = words, ids, starts
            self.kept["words"] = words, ids, starts

    def _plain_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for k in range(0, len(words), 4096):
            lines = _PARTS.sub(r"\1 ", b"\n".join(words[k : k + 4096]).decode().lower())
            parts = np.array([line.count(" ") for line in lines.split("\n")])
            lines = lines.encode().decode("latin-1")
            for byte, letter in self.odd:
                if byte in lines:
                    lines = lines.replace(byte, letter)
            some = np.array(self.merges.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[some])[np.cumsum(parts) - 1] + 1
            ids.append(some)
            counts.append(np.diff(last, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Encode new words: the words in another order, all their ids, the number of ids of each, the place of each."""
        raw, offsets = text_buffers(words)
        odd = np.concatenate([[0], np.cumsum(~PLAIN[raw])])[offsets]
        plain = odd[1:] == odd[:-1]
        some, others = words.filter(pa.array(plain)), words.filter(pa.array(~plain))
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        if len(some):
            found, n = self._plain_ids(some.to_pylist())
            ids.append(found)
            counts.append(n)
        if len(others):
            texts = [w.decode() for w in others.to_pylist()]
            rows = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids.append(np.array([x for r in rows for x in r], np.uint32))
            counts.append(np.array([len(r) for r in rows]))
        places = np.empty(len(words), np.int64)
        places[plain] = np.arange(len(some))
        places[~plain] = np.arange(len(some), len(words))
        return pa.concat_arrays([some, others]), np.concatenate(ids), np.concatenate(counts), places

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; number of ids of each)."""
        codes, distinct, rows = encoded_parts(texts)
        distinct = distinct.cast(pa.large_binary())
        known = pc.index_in(distinct, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = known < 0
        word_ids, starts = self.ids, self.starts
        if new.any():
            words, more, counts, places = self._learn(distinct.filter(pa.array(new)))
            known[new] = len(self.words) + places
            ends = np.cumsum(counts)
            word_ids, starts = np.concatenate([word_ids, more]), np.concatenate([starts, starts[-1] + ends])
            if len(self.words) + len(words) > KEPT_WORDS and 2 * len(words) > len(distinct):
                # What is kept is of little use for texts like these.
                self._keep(words, more, np.concatenate([[0], ends]))
            else:
                self._keep(pa.concat_arrays([self.words, words]), word_ids, starts)
        word = known[codes]
        lengths = starts[word + 1] - starts[word]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = word_ids[np.arange(upto[-1]) + np.repeat(starts[word] - upto[:-1], lengths)]
        n = np.diff(upto[rows])
        out = np.full(len(ids) + len(texts), self.end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), n)] = ids
        return out, n + 1


def full_groups(segments: Iterable, size: Callable) -> Iterator[list]:
    """Segments in groups whose blocks advance together: as many as ``LANES`` blocks hold, or one that is larger."""
    some, total = [], 0
    for segment in segments:
        n = size(segment)
        if some and total + n > LANES * BLOCK:
            yield some
            some, total = [], 0
        some.append(segment)
        total += n
    if some:
        yield some


SEGMENT = "part int, segment int, doc_ids array<bigint>, doc_tokens array<bigint>, n_tokens bigint, ids binary"


def write_ids(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = 1) -> None:
    """Documents (doc_id, text) -> files of ids in ascending order of ``doc_id``.

    Ranges of documents are sorted apart; ``part`` and ``segment`` number what is written in that order.
    """

    def run(batches):
        tokenize = WordTokenizer(tokenizer_json, end_id)
        part, segment = TaskContext.get().partitionId(), 0

        def tokenized():
            for batch in slices(batches, limit=TEXT_BYTES):
                yield batch.column("doc_id"), *tokenize(batch.column("text"))

        for some in full_groups(tokenized(), lambda x: len(x[1])):
            for (docs_, ids, n), value in zip(some, encode_segments([ids for _, ids, _ in some]), strict=True):
                doc_ids = pa.ListArray.from_arrays(pa.array([0, len(docs_)], pa.int32()), docs_)
                tokens = pa.array([n], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), doc_ids, tokens,
                     pa.array([len(ids)], pa.int64()), pa.array([value], pa.binary())],
                    ["part", "segment", "doc_ids", "doc_tokens", "n_tokens", "ids"],
                )
                segment += 1

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # The ids are compressed already.
    map_arrow(ordered, run, SEGMENT).write.option("compression", "uncompressed").parquet(path)


READ = "part int, segment int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"


def read_ids(files: DataFrame) -> DataFrame:
    """Files of ids -> (part, segment, doc_id, before, n_tokens, ids_crc32), every block decoded and checked."""

    def run(batches):
        rows = (batch.slice(k, 1) for batch in batches for k in range(len(batch)))
        for some in full_groups(rows, lambda row: row.column("n_tokens")[0].as_py()):
            some = [row.to_pylist()[0] for row in some]
            for row, ids in zip(some, decode_segments([row["ids"] for row in some]), strict=True):
                ids = ids.astype("<u4")
                ends = np.cumsum(row["doc_tokens"])
                if len(ids) != row["n_tokens"] or ends[-1] != len(ids):
                    raise ValueError("documents don't fill their segment")
                starts = ends - row["doc_tokens"]
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                m = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * m, pa.int32()), pa.array([row["segment"]] * m, pa.int32()),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(row["doc_tokens"], pa.int64()), pa.array(sums, pa.int64())],
                    ["part", "segment", "doc_id", "before", "n_tokens", "ids_crc32"],
                )

    return map_arrow(files, run, READ)


def encoded_documents(docs: DataFrame, tokenizer_json: str, end_id: int = 1) -> DataFrame:
    """Write the ids of all documents, read them back: doc_id, start, n_tokens, ids_crc32.

    ``start`` adds up the totals of the parts, of the segments of the part, and of the documents of the segment.
    """
    spark = docs.sparkSession
    path = work_path(spark, "ids")
    write_ids(docs, tokenizer_json, path, end_id)
    files = spark.read.schema(SEGMENT).parquet(path)
    totals = files.select("part", "segment", F.col("n_tokens").alias("total"))
    parts = totals.groupBy("part").agg(F.sum("total").alias("total"))
    parts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("part_start"))
    in_part = Window.partitionBy("part").orderBy("segment")
    segments = totals.select("part", "segment", (F.sum("total").over(in_part) - F.col("total")).alias("segment_start"))
    return (
        read_ids(files)
        .join(segments.join(parts, "part"), ["part", "segment"])
        .select("doc_id", (F.col("part_start") + F.col("segment_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )
