"""An arriving directory of predictions against a fixed lake, as a stream. The batch operators are used unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidra.operators.matching import substring_join

SCHEMA = "sample string, peptide string, score double"


def best_scores(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Streaming best score and number of rows of each peptide, by built-in state."""
    return spark.readStream.schema(schema).parquet(path).groupBy("peptide").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))


def match_arrivals(spark: SparkSession, path: str, lake: DataFrame, out: str, checkpoint: str, seed: int = 9, schema: str = SCHEMA) -> StreamingQuery:
    """Matches each micro-batch with the lake and writes its hits; a batch that runs again replaces its own part."""

    def run(batch: DataFrame, number: int) -> None:
        hits = substring_join(batch.groupBy("peptide").agg(F.max("score").alias("score")), lake, seed=seed)
        hits.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
