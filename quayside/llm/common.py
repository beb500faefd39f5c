"""What the operators share: written intermediates, Arrow batches of bounded size, and word splitting.

Texts are handled as whole Arrow buffers: numpy finds the words of all texts of a batch at once, and Arrow's
dictionary encoding turns equal words into equal numbers. Nothing here is per word in Python.
"""

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from quayside.session import work_path

# A task handles this much text at a time, whatever the size of the batches it is handed.
SLICE_BYTES = 4 << 20

ASCII_SPACE = frozenset((0x20, *range(0x09, 0x0E)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cut lineage that survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hand_back_memory() -> None:
    """Return what a task has freed to the system: its worker process goes on to other tasks, or waits beside them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            hand_back_memory()

    return df.mapInArrow(run, schema)


def byte_table(separators: Iterable[int] | None = None) -> np.ndarray:
    """256 bytes: A-Z in lower case, separators as 0x20, everything else itself."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    table[list(ASCII_SPACE if separators is None else separators)] = 0x20
    return table


# Words are runs of other bytes than these.
SPACE_WORDS = byte_table()
ALNUM_WORDS = byte_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an array one after another, and n + 1 byte offsets; null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of whole rows with at most ``limit`` bytes of text, or one row if that is longer."""
    for batch in batches:
        _, offsets = text_buffers(batch.column(column))
        start, n = 0, len(batch)
        while start < n:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), n)
            yield batch.slice(start, end - start)
            start = end


def word_bounds(inside: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; ``inside`` tells word bytes, and no word goes on from one row to the next."""
    starts = inside.copy()
    ends = inside.copy()
    if len(inside):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        filled = rows[:-1] < rows[1:]
        starts[rows[:-1][filled]] = inside[rows[:-1][filled]]
        ends[rows[1:][filled] - 1] = inside[rows[1:][filled] - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def split_words(texts: pa.Array, table: np.ndarray = SPACE_WORDS) -> tuple[pa.Array, np.ndarray]:
    """All words of an array of texts as one binary array, and the n + 1 word offsets of its rows."""
    raw, rows = text_buffers(texts)
    mapped = table[raw]
    inside = mapped != 0x20
    starts, ends = word_bounds(inside, rows)
    upto = np.concatenate([[0], np.cumsum(ends - starts)])
    small = upto[-1] < 2**31
    buffers = [None, pa.py_buffer(upto.astype(np.int32 if small else np.int64)), pa.py_buffer(mapped[inside])]
    words = pa.Array.from_buffers(pa.binary() if small else pa.large_binary(), len(starts), buffers)
    return words, np.searchsorted(starts, rows)


def encoded_words(texts: pa.Array, table: np.ndarray = SPACE_WORDS) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word numbers of all texts, the distinct words they stand for, and the word offsets of the rows."""
    words, rows = split_words(texts, table)
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, rows


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def hashed_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def shingle_hashes(codes: np.ndarray, words: pa.Array, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a row, and their n + 1 row offsets.

    A row with fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    hashes = hashed_words(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    counts = np.diff(rows)
    full = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for i in range(size):
        full = full * np.uint64(0x100000001B3) + hashes[i : i + len(full)]
    full = mixed(full)
    starts = np.arange(len(full))
    row_of = np.repeat(np.arange(len(counts)), counts)
    keep = row_of[: len(full)] == row_of[size - 1 : size - 1 + len(full)] if len(full) else np.zeros(0, bool)
    out, row_out = full[keep], row_of[starts[keep]]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(size - 1):
            has = counts[short] > i
            whole[has] = whole[has] * np.uint64(0x100000001B3) + hashes[rows[short[has]] + i]
        out = np.concatenate([out, mixed(whole + np.uint64(0xA5A5A5A5) * counts[short].astype(np.uint64))])
        row_out = np.concatenate([row_out, short])
        order = np.argsort(row_out, kind="stable")
        out, row_out = out[order], row_out[order]
    return out, np.searchsorted(row_out, np.arange(len(counts) + 1))
