"""Helpers the operators share: the shared folder, JVM-side lets and barriers, word hashing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marshgrid.session import ensure_checkpoint_dir

#: Words are maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text hashed at a time; a longer word is still hashed whole.
SLICE_BYTES = 1 << 20


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(spark.sparkContext.applicationId)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that outlives executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    # The shuffle files of this write are of no use once it is done.
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_at = path
    return table


def drop(table: DataFrame) -> None:
    """Delete what ``saved`` wrote, once nothing reads it any more."""
    jvm = table.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(table.saved_at)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` names it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that the optimiser does not spell them out at every use."""
    held = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", held)


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def tidy() -> None:
    """Give a worker's free memory back to the machine at a task's end: idle workers keep what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---- vectorised hashing inside tasks -------------------------------------------------

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = {s: stream(s * 7919 + 11, 256) for s in (1, 2)}
_BASE = {s: int(stream(s * 104729 + 3, 1)[0]) | 1 for s in (1, 2)}
_POWERS: dict[int, np.ndarray] = {}


def _powers(seed: int, n: int) -> np.ndarray:
    have = _POWERS.get(seed)
    if have is None or len(have) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        base = np.full(size, _BASE[seed], dtype=np.uint64)
        base[0] = 1
        have = _POWERS[seed] = np.multiply.accumulate(base)
    return have[:n]


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    kind = np.int64 if wide else np.int32
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Runs of rows holding about ``limit`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def hash_words(raw: np.ndarray, offsets: np.ndarray, seeds=(1,)) -> tuple[list[np.ndarray], np.ndarray]:
    """64-bit hashes of all words (one array per seed) and the number of words of each row.

    A word's hash depends on its bytes only.  Long inputs are worked off in pieces cut
    at white space, so temporary arrays stay small.
    """
    parts: list[list[np.ndarray]] = [[] for _ in seeds]
    counts = np.zeros(len(offsets) - 1, dtype=np.int64)
    lo, total = 0, len(raw)
    while lo < total:
        hi = min(total, lo + SLICE_BYTES)
        while hi < total:  # go on to the next white space or row
            step = raw[hi:hi + 4096]
            stop = np.flatnonzero(_SPACES[step])
            row = offsets[np.searchsorted(offsets, hi)]
            at = hi + (int(stop[0]) if len(stop) else len(step))
            hi = int(min(at, row)) if row < at or len(stop) else at
            if len(stop) or row <= at:
                break
        piece = raw[lo:hi]
        space = _SPACES[piece]
        first = np.empty(len(piece), dtype=bool)
        first[0] = True
        first[1:] = space[:-1]
        edge = offsets[(offsets > lo) & (offsets < hi)] - lo
        first[edge] = True
        starts = np.flatnonzero(first & ~space)
        if len(starts):
            letters = ~space
            # Rank of each byte among the non-space bytes, and of each word's first one.
            body = piece[letters]
            head = np.flatnonzero(first[letters])
            size = np.diff(np.append(head, len(body)))
            within = np.arange(len(body)) - np.repeat(head, size)
            top = int(size.max())
            for out, seed in zip(parts, seeds):
                value = _BYTE[seed][body] * _powers(seed, top)[within]
                out.append(mix(np.add.reduceat(value, head) + size.astype(np.uint64)))
            np.add.at(counts, np.searchsorted(offsets, starts + lo, side="right") - 1, 1)
        lo = hi
    none = np.zeros(0, dtype=np.uint64)
    return [np.concatenate(p) if p else none for p in parts], counts


def windows(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    odd = stream(seed * 31 + 5, width) | np.uint64(1)
    out = hashes[:n] * odd[0]
    for k in range(1, width):
        out += hashes[k:k + n] * odd[k]
    return mix(out)


def windows_of_rows(registers: np.ndarray, rows: int) -> np.ndarray:
    """Hash of every run of ``rows`` neighbouring registers, by row (n x m / rows)."""
    n, m = registers.shape
    odd = stream(4243, m) | np.uint64(1)
    return mix((registers * odd).reshape(n, m // rows, rows).sum(axis=2, dtype=np.uint64))


def row_key(hashes: np.ndarray, seed: int) -> int:
    """Hash of a whole word sequence."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        odd = _powers(seed, n + 1)
        return int(mix(np.array([(hashes * odd[:n]).sum(dtype=np.uint64) + np.uint64(n)], dtype=np.uint64)).view(np.int64)[0])
