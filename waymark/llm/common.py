"""Helpers shared by the text operators: shared-folder tables, Arrow plumbing, numpy hashing."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)


#: Rows and bytes of a batch that goes to a Python worker; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:
    _libc = None


def trim() -> None:
    """Gives freed memory back to the system, so that what one task held is there for the next."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


#: For Python workers: large arrays come from the system and go back to it at once, instead of staying with the process.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "8388608", "MALLOC_ARENA_MAX": "2"}


def small_batches(spark: SparkSession) -> None:
    """Keeps the batches for Python workers small, whatever the session's setting, and the workers' memory as well."""
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        held = int(re.match("-?[0-9]+", spark.conf.get(key))[0])
        if held <= 0 or held > most:
            spark.conf.set(key, str(most))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, by a path that Spark's readers open."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and driver and executors are one process (tests), a temporary
    folder of this process. On a cluster it must be set: executors do not see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), f"waymark-{os.getpid()}")
        os.makedirs(found, exist_ok=True)
    return found


class Shared:
    """Tables written to the shared folder, so that lineage ends there and a lost executor costs nothing.

    ``put`` writes a frame and reads it back; ``drop`` removes one that nothing reads any more. What is left goes when the
    driver's file systems close.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.count = 0
        target = self._path(self.root)
        self._system(target).deleteOnExit(target)

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def forget(self) -> None:
        """Lets the driver find the frames that ended in a table, so that Spark deletes their shuffle files."""
        for _ in range(2):  # what the first round finds holds what the second one does
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def drop(self, path: str) -> None:
        target = self._path(path)
        self._system(target).delete(target, True)


def total_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column over all rows: one cheap pass that sizes partitions."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()["b"])


def pieces(n_bytes: int, each: int, least: int = 8) -> int:
    """Number of parts of about ``each`` bytes, a power of two so that hashes split evenly."""
    n = least
    while n * each < n_bytes:
        n *= 2
    return n


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """Applies a function of one record batch to every batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
        trim()

    return df.mapInArrow(run, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, in place where it can be."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def gram_hash(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Hash of every k consecutive values (polynomial modulo 2^64, by doubling), unmixed.

    The result has len(h) - k + 1 entries; none if there are fewer than k values.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, acc, power = 0, None, None
    block, size, mult = h, 1, int(base)
    while True:
        if k & size:
            if acc is None:
                acc, done, power = block, size, mult
            else:  # acc covers the first `done` values, block the next `size`
                m = len(h) - done - size + 1
                acc = acc[:m] * U64(mult) + block[done : done + m]
                done, power = done + size, (power * mult) & 0xFFFFFFFFFFFFFFFF
        if size * 2 > k:
            break
        m = len(block) - size
        block = block[:m] * U64(mult) + block[size : size + m]
        size, mult = size * 2, (mult * mult) & 0xFFFFFFFFFFFFFFFF
    return acc[:n]


def pack(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() splits at exactly these characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
