"""Shared plumbing of the text operators: shared scratch tables, chunks, exact vector hashes."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gnomon.sources.io import checkpoint_dir, discard, materialise  # noqa: F401 - the operators take them from here

U64 = np.uint64
BATCH = 8 << 20  # bytes of a batch that goes to a Python worker; a longer row is a batch alone
PIECE = 1 << 18  # bytes whose words are hashed at once: a byte takes some 40 meanwhile
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is not installed on their path, and get texts in batches of bounded bytes."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "-1", "268435456b", "268435456"):  # not set by the user
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store Spark knows will do."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def sweep(spark: SparkSession) -> None:
    """Let shuffle files of jobs that are over go now: the engine removes them once the driver's garbage is collected, which may be much later."""
    gc.collect()
    spark._jvm.System.gc()


_kept: dict = {}


def kept(name: str, make: Callable):
    """What a worker keeps from task to task: made once, and let go as soon as a task that does not name it begins."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def release(*own: str) -> None:
    """Give memory of earlier tasks of this worker back to the system: what they freed, and what they kept but for ``own``."""
    for name in set(_kept) - set(own):
        del _kept[name]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """The columns an operator uses, by position in the schema rather than by expression."""
    text = F.col("text")
    if not isinstance(df.schema["text"].dataType, StringType):
        text = text.cast("string").alias("text")
    return df.select("doc_id", text, *extra)


def utf8(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of an Arrow string or binary column; a null is an empty slice."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    n = len(column)
    null = np.asarray(column.is_null())
    if null.any():
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    return data, offsets, null


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of at most ``limit`` bytes, or of one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def sorted_by(h: np.ndarray, x: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, which of the ordered entries differ from the one before): by ``h`` and, where that ties, ``x``.

    Entries that are equal in both come in any order.
    """
    order = np.argsort(h)
    a = h[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    if x is not None and len(x) and not new.all():
        b = x[order]
        apart = np.zeros(len(a), bool)
        apart[1:] = b[1:] != b[:-1]
        if (apart & ~new).any():  # equal in h alone: rare, as h has 64 bits
            order = np.lexsort((x, h))
            a, b = h[order], x[order]
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n, kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), U64)
        out[0] = 1
        done = 1
        while done < len(out):
            step = min(done, len(out) - done)
            out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
            done += step
        have = _powers[base] = out
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * R**i: any slice's polynomial hash is then one subtraction."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64) * powers(_R, len(values)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the slices [start, end): equal slices give equal values wherever they lie."""
    return (sums[end] - sums[start]) * powers(_RINV, len(sums))[start]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of all words, and each row's first word (one more entry).

    ``offsets`` are the rows' bounds in ``data``; no word crosses one.
    """
    on = ~space[data]
    start, end = on.copy(), on.copy()
    start[1:] &= ~on[:-1]
    end[:-1] &= ~on[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start[inner] = on[inner]
    end[inner - 1] = on[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal words give equal hashes wherever they lie; words are in order, and hashed in pieces of PIECE bytes."""
    out = np.empty(len(start), U64)
    for a, b in slices(np.append(start, end[-1:]), PIECE):
        s, e = start[a:b], end[a:b]
        sums = prefix(data[s[0] : e[-1]].astype(U64) + U64(1))
        out[a:b] = mix(spans(sums, s - s[0], e - s[0]) + (e - s).astype(U64))
    return out


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
