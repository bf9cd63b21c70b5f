"""Cutting lineage by tables in the shared folder, and dealing rows out to tasks of bounded size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from evidra.session import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """A copy of `df` as compressed Parquet in the folder of spark.checkpoint.dir; see `shared_dir` for sessions without one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evidra/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(df: DataFrame, size: int = 1_000_000) -> int:
    """Tasks of some `size` rows each that `df` is dealt out to; the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // size))
