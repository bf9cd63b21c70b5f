"""Per-sample summaries, annotation look-ups and seeded generators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators.control import shuffle_keeping
from evidra.operators.lineage import parts


def intensity_distribution(df: DataFrame, sample: str, value: str) -> DataFrame:
    """Measured and missing rows and quartiles (linear) of log2 of the positive values of each sample."""
    positive = F.when(F.col(value) > 0, F.log2(value))
    return df.groupBy(sample).agg(F.count(positive).alias("n_measured"), F.count_if(positive.isNull()).alias("n_missing"), F.percentile(positive, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select(sample, "n_measured", "n_missing", *[F.col("q")[k].alias(n) for k, n in enumerate(("q25", "q50", "q75"))])


def two_stage(left: DataFrame, table: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """Looks `value` up by `first`, and by `second` where that finds nothing; conflicting values of a key are an error."""

    def unique(key: str, name: str) -> DataFrame:
        got = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
        checked = F.when(F.col("__a").eqNullSafe(F.col("__b")), F.col("__a")).otherwise(F.raise_error(F.concat(F.lit(f"two values for {key} "), F.col(key).cast("string"))).cast(table.schema[value].dataType))
        return got.select(key, checked.alias(name))

    joined = left.join(unique(first, "__first"), first, "left").join(unique(second, "__second"), second, "left")
    return joined.withColumn(value, F.coalesce("__first", "__second")).drop("__first", "__second")


def complexity(df: DataFrame, sample: str, found: Column, species: str) -> DataFrame:
    """Hit rate, richness and the share of the most frequent species of each sample, with a rule-based advice."""
    rates = df.groupBy(sample).agg(F.avg(found.cast("int")).alias("hit_rate"))
    counts = df.where(found).groupBy(sample, species).agg(F.count(F.lit(1)).alias("n"))
    own = counts.groupBy(sample).agg(F.count(F.lit(1)).alias("richness"), (F.max("n") / F.sum("n")).alias("dominance"))
    advice = F.when(F.col("hit_rate") < 0.1, "low coverage").when(F.col("dominance") > 0.5, "dominated").otherwise("diverse")
    return rates.join(own, sample, "left").withColumn("advice", advice)


def gene_quantities(df: DataFrame, sample: str, peptide: str, gene: str, value: str) -> DataFrame:
    """Sums by gene of each peptide's greatest value in a sample.

    Rows are dealt out before anything is grouped, so that what a task holds does not follow the input; a gene of many
    peptides is summed in 16 tasks first.
    """
    n, salt = parts(df), F.pmod(F.xxhash64(peptide), F.lit(16)).alias("__salt")
    best = df.select(sample, peptide, gene, value, salt).repartition(n, sample, gene, "__salt").groupBy(sample, peptide, gene, "__salt").agg(F.max(value).alias("v"))
    sums = best.groupBy(sample, gene, "__salt").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    return sums.repartition(n, sample, gene).groupBy(sample, gene).agg(F.sum("n").alias("n_peptides"), F.sum("v").alias("quantity"))


def hops(df: DataFrame, *misses: tuple[str, Column]) -> DataFrame:
    """Counts of rows that each look-up of a chain has missed."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(name) for name, c in misses])


def halves(df: DataFrame, key: str) -> DataFrame:
    """Splits rows in two by a hash of the key, the same for any partitioning."""
    return df.withColumn("half", (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % 2).cast("int"))


def shuffled(df: DataFrame, accession: str = "accession", sequence: str = "sequence", prefix: str = "ENTRAP_", seed: int = 1) -> DataFrame:
    """Shuffled copies that keep K and R in place; each record's seed is its accession, so partitions don't matter."""

    def make(names: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([shuffle_keeping(t, f"{seed}:{n}") for n, t in zip(names, texts, strict=True)])

    made = F.pandas_udf(make, "string")
    return df.withColumns({sequence: made(F.col(accession), F.col(sequence)), accession: F.concat(F.lit(prefix), F.col(accession))})
