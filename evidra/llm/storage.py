"""Shared-folder tables and bounded filters that the operators of this subpackage use between their steps."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.session import shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Limits Arrow batches by bytes, so that long texts don't fill a Python worker; an own setting is left alone."""
    if not spark.conf.get(_BATCH, None):
        spark.conf.set(_BATCH, str(4 << 20))
    return spark


class Workspace:
    """Parquet tables of one operator call, under a folder of its own in the shared folder.

    A written table cuts the lineage: what reads it survives lost executors without running its predecessors again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = bounded_batches(spark)
        self.root = f"{shared_dir(spark)}/evidra/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        conf, before = self.spark.conf, self.spark.conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")  # the table replaces the shuffle files that made it
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class KeyFilter:
    """A bitmap over hashed 64-bit keys with a fixed size bound: it may keep a key too many and never loses one.

    `bits` is rounded up to a power of two between 2**16 and `max_bits`; the broadcast is bits / 8 bytes at most,
    32 MiB by default, however large the input. A fuller bitmap only lets more rows through to the exact join.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.bits = bits
        self.bitmap = words

    @classmethod
    def build(cls, keys: DataFrame, expected: int, max_bits: int = 1 << 28) -> KeyFilter:
        """keys: one BIGINT column; expected: about how many there are (counted by the caller)."""
        bits = 1 << 16
        while bits < max_bits and bits < expected * 64:
            bits <<= 1
        (name,) = keys.columns
        at = f"(shiftright({name}, 20) & {bits - 1}L)"
        rows = (
            keys.where(F.col(name).isNotNull())
            .groupBy(F.expr(f"cast(shiftright({at}, 6) as int)").alias("word"))
            .agg(F.expr(f"bit_or(shiftleft(1L, cast({at} & 63 as int)))").alias("bits"))
        )
        got = rows.toArrow()
        words = np.zeros(bits >> 6, np.uint64)
        words[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.int64).view(np.uint64)
        return cls(words, bits)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """keys: int64 or uint64; a mask of those that may be in the set."""
        at = (keys.view(np.int64) >> 20).view(np.uint64) & np.uint64(self.bits - 1)
        return (self.bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner", most: int = 4096) -> DataFrame:
    """`left` joined with `right`, whose keys are unique, without dealing a frequent key's rows to one task.

    weight: a column of `right`, the number of rows of `left` with the key; total: rows of `left`. Keys with more than
    total / most rows number less than `most`, so they are broadcast whatever the size; the others are shuffled. `how`
    is inner or left. `left` should be a saved table, as it is read twice.
    """
    rest = [c for c in right.columns if c not in keys]
    frequent = F.col(weight) * most > total
    hot = F.broadcast(right.where(frequent).select(*keys, F.struct(*rest).alias("__hot")))
    marked = left.join(hot, keys, "left")
    columns = [*left.columns, *rest]
    warm = marked.where("__hot is not null").select(*left.columns, *[F.col("__hot")[c].alias(c) for c in rest])
    cold = marked.where("__hot is null").drop("__hot").join(right.where(~frequent), keys, how)
    return warm.select(*columns).unionByName(cold.select(*columns))


def release() -> None:
    """Gives memory that a finished task has freed back to the system; workers are used again by other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Enough partitions for `per_task` rows each, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))
