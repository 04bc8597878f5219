"""What the operators share: the scratch folder, written cuts of lineage, and a vectorised word hash."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.workers import files, reach, shared_dir

#: Mixing constants, and an odd multiplier for runs of words.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)

#: Bytes of text that one vectorised step handles; a longer document makes a step of its own.
CHUNK_BYTES = 1 << 18
#: Bytes of a batch of rows that goes to Python at most, unless one row has more.
BATCH_BYTES = 1 << 20
#: Words beyond this many bytes are hashed one by one.
LONG_WORD = 256

#: Tables cut while a scratch() is open, by scratch().
_OPEN: list[list[DataFrame]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/tidewright-{name}-{uuid.uuid4().hex}"
    folder, system = files(spark, path)
    system.deleteOnExit(folder)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again, so that lost executors cost no earlier stage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    if _OPEN:
        _OPEN[-1].append(table)
    return table


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that cut() made and that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "_cut_path", None):
            folder, system = files(table.sparkSession, path)
            system.delete(folder, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that are cut meanwhile are deleted in the end, but for those that are taken off the list."""
    _OPEN.append([])
    try:
        yield _OPEN[-1]
    finally:
        drop(*_OPEN.pop())


#: Rows of ids, or of ids and a hash, that are broadcast at most (about 60 MB); above that a join shuffles.
BROADCAST_IDS = 1_000_000


def sized(ids: DataFrame, name: str) -> DataFrame:
    """ids as a written table, to be broadcast if it has at most BROADCAST_IDS rows."""
    table = cut(ids, name)
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def bound_batches(spark: SparkSession) -> None:
    """Let batches of rows that go to Python hold at most BATCH_BYTES, whatever the rows' length, and workers find the package. A lower bound that is set stays."""
    reach(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    asked = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < asked <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: What operators keep in this Python worker between their tasks, and how it is dropped.
KEPT: dict[str, Callable[[], None]] = {}


def _give_back() -> None:
    """Free memory goes back to the system, as workers outlive their tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Task, keeps: str = "") -> Task:
    """run, with what other operators keep in the worker dropped first, and its own free memory given back when a task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        for other in [k for k in KEPT if k != keeps]:
            KEPT.pop(other)()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def collect_garbage(spark: SparkSession) -> None:
    """Have executors collect all garbage: left alone, a JVM collects the young alone and grows to its whole heap, beside its own memory and the Python workers'. One task a core, so every idle executor has some; requests that wait for a collection are served by it. Nothing happens where -XX:+DisableExplicitGC is set."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Of eight bytes, the first n.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `most` bytes; null rows are empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        end = min(end, n)
        yield start, end, raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word, in bytes; words are runs of bytes other than space and 09-0D, and end with their row."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_BLANK[raw]
    first = np.zeros(len(raw), bool)
    first[offsets[:-1][offsets[:-1] < len(raw)]] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | first))
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = True, ~word[1:] | first[1:]
    return starts, np.flatnonzero(word & after) + 1


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a text on, as a number; zeros follow the text."""
    return np.ndarray(len(raw) + 1, "<u8", np.concatenate((raw, np.zeros(8, np.uint8))), strides=(1,))


def first_bytes(raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span, or all of a shorter one and zeros."""
    return _eights(raw)[starts] & _FIRST[np.minimum(size, 8)]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: eight at a time, each eight mixed into what is before them."""
    size = ends - starts
    h = mix(size.astype(np.uint64) + np.uint64(0x5EED71DE))
    if not len(starts):
        return h
    eights = _eights(raw)
    h = mix(h ^ (eights[starts] & _FIRST[np.minimum(size, 8)]))
    rest, at = np.flatnonzero(size > 8), 8
    while len(rest) and at < LONG_WORD:
        h[rest] = mix(h[rest] ^ (eights[starts[rest] + at] & _FIRST[np.minimum(size[rest] - at, 8)]))
        at += 8
        rest = rest[size[rest] > at]
    for i in rest.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _LOWER[raw]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, A-Z taken as a-z, and the row that each word is in."""
    starts, ends = word_bounds(raw, offsets)
    return span_hashes(lowered(raw), starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def gram_hashes(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of one row, and their rows."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = row[: len(row) - n + 1] == row[n - 1 :]
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        total = (total + h[i : len(h) - n + 1 + i]) * (_BASE + np.uint64(2 * i))
    return mix(total + np.uint64(n))[keep], row[: len(row) - n + 1][keep]
