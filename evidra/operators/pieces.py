"""Work on a large table piece by piece, with a ledger: each piece counts exactly once, and a broken run goes on.

A piece is the rows whose key hashes to it. Its output is written first and its receipt in the ledger last, so a piece
without a receipt is done again and replaces what it left. Receipts hold mergeable statistics: numbers of rows and sums
of row hashes. All pieces must see the same fixed inputs, and together the whole source, or the run is an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

LEDGER = "piece int, pieces int, fixed string, records bigint, record_sum string, rows bigint, row_sum string"


def digest(df: DataFrame) -> tuple[int, str]:
    """Number of rows and the sum of their hashes: blind to order and partitions, and additive over disjoint parts."""
    got = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))).first()
    return got[0], str(got[1])


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of each input file, found by the executors. A file must be under 2 GB, Spark's limit for one
    binary value; larger inputs are directories of part files."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return own.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def unchanged(spark: SparkSession, path: str, before: DataFrame) -> None:
    """An error that names the first file added, removed or changed since `before`, a saved table of fingerprints."""
    now = fingerprints(spark, path)
    odd = now.exceptAll(before).unionByName(before.exceptAll(now)).orderBy("file").first()
    if odd is not None:
        raise ValueError(f"input changed while it was read: {odd.file}")


@dataclass(frozen=True)
class Summary:
    pieces: int
    records: int
    rows: int


def ledger(spark: SparkSession, path: str) -> dict[int, dict]:
    """Receipts by piece; a piece has one at most."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return {}
    rows = spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(f"{path}/ledger").collect()  # one for each piece
    return {r.piece: r.asDict() for r in rows}


def run(spark: SparkSession, path: str, source: DataFrame, key: str, step: Callable[[DataFrame], DataFrame], fixed: DataFrame, pieces: int, inputs: str | None = None) -> tuple[DataFrame, Summary]:
    """`step` applied to `pieces` parts of `source` by `key`; the union of its results and what the ledger adds up to.

    fixed: what every piece is held against (patterns, settings); its digest is conserved. A second call with the same
    path goes on with the pieces that have no receipt; other numbers of pieces or other fixed rows are an error. With
    `inputs`, the files below it must keep their content from before the first piece to after the last.
    """
    if pieces < 1:
        raise ValueError("at least one piece")
    stamps = None
    if inputs is not None:
        stamps = fingerprints(spark, inputs)
        stamps.write.mode("ignore").parquet(f"{path}/inputs")
        stamps = spark.read.schema(stamps.schema).parquet(f"{path}/inputs")
        unchanged(spark, inputs, stamps)
    conserved = ":".join(map(str, digest(fixed)))
    done = ledger(spark, path)
    for receipt in done.values():
        if receipt["pieces"] != pieces or receipt["fixed"] != conserved:
            raise ValueError(f"{path} holds pieces of another run")
    own = source.withColumn("__piece", F.expr(f"pmod(xxhash64({key}), {pieces})"))
    schema = step(source.limit(0)).schema
    for k in range(pieces):
        if k in done:
            continue
        part = own.where(F.col("__piece") == k).drop("__piece")
        step(part).write.mode("overwrite").parquet(f"{path}/pieces/{k:06d}")
        records, rows = digest(part), digest(spark.read.schema(schema).parquet(f"{path}/pieces/{k:06d}"))
        if ":".join(map(str, digest(fixed))) != conserved:
            raise ValueError("the fixed inputs changed between pieces")
        receipt = spark.createDataFrame([(k, pieces, conserved, *records, *rows)], LEDGER)
        receipt.coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/{k:06d}")
    done = ledger(spark, path)
    whole = digest(source)
    summed = sum(r["records"] for r in done.values()), str(sum(int(r["record_sum"]) for r in done.values()))
    if sorted(done) != list(range(pieces)) or summed != whole:
        raise ValueError("pieces do not add up to the source")
    if stamps is not None:
        unchanged(spark, inputs, stamps)
    union = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/pieces")
    rows = digest(union)
    if rows != (sum(r["rows"] for r in done.values()), str(sum(int(r["row_sum"]) for r in done.values()))):
        raise ValueError("merged rows differ from the receipts")
    return union, Summary(pieces, whole[0], rows[0])


def counted(summary: Summary, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(summary.pieces, summary.records, summary.rows)], "pieces int, records bigint, rows bigint").select(F.col("pieces").cast(LongType()).alias("pieces"), "records", "rows")
