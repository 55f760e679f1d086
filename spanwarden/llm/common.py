"""Shared helpers: scratch tables, batching of whole texts, vectorised word and window hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space bytes; these never occur inside a UTF-8 sequence.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
GROUP_BYTES = 1 << 20

_U = np.uint64
_RNG = np.random.RandomState(20240229)
BYTE_CODES = (_RNG.randint(0, 1 << 32, 256, dtype=np.uint64) << _U(32)) | _RNG.randint(0, 1 << 32, 256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one on a local master (tests), an error elsewhere."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_own_scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = spark._own_scratch = "file://" + tempfile.mkdtemp(prefix="spanwarden-")
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def materialize_by(df: DataFrame, name: str, column: str, values: tuple[int, ...]) -> list[DataFrame]:
    """``materialize`` into one table for each value of a column, which can be released one by one."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, str(len(values) + 1))  # a file open for each value: no sort of the rows, which may hold large blobs
    try:
        df.write.partitionBy(column).parquet(path)
    finally:
        spark.conf.set(writers, before)
    there = spark.read.schema(df.schema).parquet(path)
    out = []
    for v in values:
        table = there.filter(F.col(column) == v).drop(column)
        table._scratch = f"{path}/{column}={v}"
        out.append(table)
    return out


def tidy(spark: SparkSession, rounds: int = 1) -> None:
    """Let Spark drop the shuffle files of finished steps: its cleaner follows the collectors of Python and the JVM.

    Events of a job that has just ended still hold its plan for a moment; where much disk hangs on it, another round after a pause finds it free.
    """
    for i in range(rounds):
        if i:
            time.sleep(0.5)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more, and tidy up."""
    for df in tables:
        context = df.sparkSession.sparkContext
        if path := getattr(df, "_scratch", None):
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    if tables:
        tidy(tables[0].sparkSession)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts hold about ``limit`` bytes, with the texts as UTF-8 (null: empty)."""
    for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
        column = batch.column(batch.schema.get_field_index(text))
        texts = column.cast(pa.large_binary()).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            texts[i] = t = t or b""
            if size and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]
    give_back()


def give_back() -> None:
    """At a task's end: memory that it freed goes back to the system, since the worker waits for its next task with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def modest_batches(spark: SparkSession, limit: str = "4m") -> None:
    """Rows here hold whole texts and sets: smaller Arrow batches than Spark's default of 64 MB bound a task's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if n <= 4 * GROUP_BYTES:
            _powers[name] = have
    return have[:n]


class RangeHash:
    """Polynomial hashes (mod 2^64, mixed) of any range of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * _power("up", _BASE, n), out=self.sums[1:])
        self.down = _power("down", _BASE_INVERSE, n + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        if len(self.sums) <= k:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])


class Words:
    """The words of some texts: starts and ends in ``data``, 64-bit hashes, and for each text its range of words."""

    def __init__(self, texts: list[bytes], lower: bool):
        joined = b" ".join(texts) + b" "
        self.data = joined.lower() if lower else joined  # bytes.lower() touches A-Z only
        codes = np.frombuffer(self.data, dtype=np.uint8)
        space = _IS_SPACE[codes]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hashes = RangeHash(BYTE_CODES[codes]).ranges(self.starts, self.ends)
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.bounds = np.searchsorted(self.starts, offsets)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed piece."""
    import zstandard

    head = np.array([a.nbytes for a in arrays], dtype=np.int64)
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(piece: bytes, *kinds: type) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(piece)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(data, dtype=np.int64, count=len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def word_count(text: str = "text"):
    """Column: the number of words of the whole text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
