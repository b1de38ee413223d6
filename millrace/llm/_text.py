"""Shared pieces of the text operators: batch plumbing, word hashing, lineage cuts.

A *word* is everywhere a maximal run of bytes other than 0x20 and 0x09-0x0D, which is also how ``bytes.split()``
cuts.  Texts reach Python as Arrow batches and are worked through in chunks of about ``CHUNK`` bytes, so that the
temporary arrays of a task are bounded by the longest single text and not by the batch.

A worker lives longer than a task and serves one operator after another, so what it keeps from task to task (``keeps``) goes
when another operator's task begins, and its free memory goes back to the system after each task (``serving``).
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 19
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
IS_WORD = np.array([i != 0x20 and not 0x09 <= i <= 0x0D for i in range(256)])

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


#: How a worker drops what it keeps for an operator; and the operator that it served last.
_drops: dict[str, Callable[[], None]] = {}
_served: list[str] = []


def keeps(operator: str, drop: Callable[[], None]) -> None:
    """``drop`` lets go of what a worker keeps from task to task for this operator."""
    _drops[operator] = drop


def serve(operator: str) -> None:
    """What this worker keeps for other operators goes, if it served another one before."""
    if _served == [operator]:
        return
    _served[:] = [operator]
    for other, drop in _drops.items():
        if other != operator:
            drop()
    _powers.clear()
    gc.collect()
    give_back()


def give_back() -> None:
    """Memory that this process has free goes back to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def serving(operator: str) -> Callable[[Run], Run]:
    """A function for mapInArrow as this operator's: see ``serve`` and ``give_back``."""

    def of(run: Run) -> Run:
        def own(batches):
            serve(operator)
            try:
                yield from run(batches)
            finally:
                give_back()

        return own

    return of


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and doubled as longer chunks come."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK + 4096), base, np.uint64)
        step[0] = 1
        have = _powers[base] = np.cumprod(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; sums and products of the inputs no longer show in its outputs."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], by one running sum over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=run[1:])
    return mix((run[ends] - run[starts]) * powers(_INVERSE, len(data) + 1)[starts] ^ (ends - starts).astype(np.uint64))


def words_of(texts: list[bytes], is_word: np.ndarray = IS_WORD) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of bytes in is_word. Of a chunk of texts: the bytes with a line end after each text, words' starts and ends, and of each text the
    first word's number (one more entry at the end) and the first byte."""
    data = b"\n".join([*texts, b""])
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    inside = is_word[np.frombuffer(data, np.uint8)].view(np.int8)
    edges = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return data, starts, ends, np.searchsorted(starts, at), at


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) of about ``size`` bytes each; a null text counts as empty. Only one chunk is held."""
    column = column.cast(pa.large_binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) + 1)
    first = 0
    while first < len(column):
        done = int(ends[first - 1]) if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, done + size, "right")))
        yield first, [t or b"" for t in column.slice(first, stop - first).to_pylist()]
        first = stop


#: Keys held by a task before they go to Spark.
HELD = 1_000_000


class Tally:
    """Counts of 64-bit keys, merged as they come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts))
        self.held += len(keys)

    def full(self) -> bool:
        """Whether it is still large after merging; then it has to be taken."""
        if self.held > HELD:
            self.add(*self.take())
        return self.held > HELD // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.zeros(0, np.int64) for i in (0, 1))
        self.parts, self.held = [], 0
        own, at = np.unique(keys, return_inverse=True)
        return own, np.bincount(at, counts, len(own)).astype(np.int64)


def as_text(column: str) -> F.Column:
    return F.col(f"`{column}`").cast("string")


def remainder(id_column: str, by: int) -> F.Column:
    """crc32(id as text) mod ``by``; null for a null id."""
    return F.crc32(as_text(id_column)) % by


def fresh(name: str, columns: list[str]) -> str:
    """A name that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that driver and executors share: spark.checkpoint.dir.

    Only where everything runs in one process is there a folder of its own if that isn't set.
    """
    sc = spark.sparkContext
    if not (folder := sc.getCheckpointDir()):
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(folder)
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder: later reads neither recompute nor depend on an executor."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame) -> DataFrame:
    """The same as a compressed Parquet table, of which later reads take only the columns that they need."""
    at = f"{shared_folder(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(at)
    return frame.sparkSession.read.schema(frame.schema).parquet(at)


#: A key is hot if it has more than one in HOT_SHARE of all rows; so there are at most HOT_SHARE of them.
HOT_SHARE = 1000


def spread_join(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of values: one row a key, with the number ``n`` of the rows that have it.

    Hot keys, at most HOT_SHARE, are broadcast, so that no task gets all rows of one; all others are joined by shuffle.
    """
    hot = F.col("n") * HOT_SHARE > total
    sent = F.broadcast(values.filter(hot).drop("n"))
    return rows.join(sent, key).unionByName(rows.join(F.broadcast(values.filter(hot).select(key)), key, "left_anti").join(values.filter(~hot).drop("n"), key))
