"""Shared plumbing: staging folder, Arrow text blocks, vectorised hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a Python worker; bounds its memory.
BLOCK_BYTES = 1 << 20
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a temporary one serves a local master, as in tests; on a
    cluster that is an error, as executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not found:
        found = tempfile.mkdtemp(prefix="lingoloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def lean(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes: texts are long, and a worker holds a batch or two."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        own = int(re.sub(r"\D", "", spark.conf.get(key)))  # in rows, or in bytes with a unit "b"
        if not 0 < own <= most:
            spark.conf.set(key, most)


#: Tables that this driver has staged.
STAGED: list[str] = []


def drop_staged(spark: SparkSession) -> None:
    """Delete what has been staged so far; call it when the results that read it are written."""
    while STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    STAGED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, n: int) -> tuple[DataFrame, Callable[[], None]]:
    """Write df to the shared folder in n buckets of a column, and read it back as a table: joins by that column need not move it. The
    second result takes the table's name out of the catalogue again, once what reads it is written; files stay as those of ``staged``."""
    spark, title = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{title}"
    STAGED.append(path)
    df.write.format("parquet").bucketBy(n, column).option("path", path).saveAsTable(title)
    return spark.table(title), lambda: spark.sql(f"DROP TABLE {title}") and None


def unclashed(rows: DataFrame, half: str, other: str) -> DataFrame:
    """Rows whose column ``half`` tells 128-bit digests apart by itself: where digests share that half, all but the one with the smallest other half
    get a hash of both. Such rows are a handful at any size, and usually none, which one aggregate tells."""
    while True:
        ends = rows.where(F.col(half).isNotNull()).groupBy(half).agg(F.min(other).alias("_low"), F.max(other).alias("_high"))
        shared = staged(ends.where("_low <> _high").select(F.col(half).alias("_half"), "_low"), "clashes")
        if shared.isEmpty():
            return rows
        marked = rows.join(shared, F.col(half) == F.col("_half"), "left")
        rows = marked.withColumn(half, F.when(F.col(other) != F.col("_low"), F.xxhash64(half, other)).otherwise(F.col(half))).drop("_half", "_low")


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives freed memory back to the system when it ends; workers are used again and again."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def filled(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as one LargeString array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a LargeString array, without copying."""
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most so many bytes of text, one row at least."""
    off, _ = buffers(texts)
    a, n = 0, len(texts)
    while a < n:
        b = int(np.searchsorted(off, off[a] + most, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base & ((1 << 64) - 1), np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def folded(data: np.ndarray) -> np.ndarray:
    """Latin capitals with accents lowered in UTF-8 (bytes C3 80 to C3 9E, but for the multiplication sign)."""
    out = data.copy()
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[upper] += 0x20
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a block, and the number of words of each document.

    Words are the maximal runs of bytes other than ASCII white space, with A-Z lowered; no word crosses a
    document. ``starts`` holds the byte offsets of the documents and, last, the block's length.
    With ``marks``, all ASCII but letters and digits separates words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64)
    inside = ~(_MARKS if marks else _SPACE)[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = starts[:-1][starts[:-1] < n]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = starts[1:] - 1
    ends = ends[(ends >= 0)]
    last[ends] = inside[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up = powers(_PRIME, n)
    x = _LETTERS[data].astype(np.uint64)
    x += np.uint64(1)
    x *= up
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(x, out=total[1:])
    h = total[e]
    h -= total[s]
    h *= powers(_INVERSE, n)[s]
    h += (e - s).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(h), np.diff(np.searchsorted(s, starts))


def long_of(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
