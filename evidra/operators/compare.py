"""Comparison of two result sets, lost genes, complementarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators.lineage import cut
from evidra.operators.study import running


def universe(left: DataFrame, right: DataFrame, everything: DataFrame | None, key: str) -> DataFrame:
    """Each key as both, left_only, right_only or neither."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    joined = a.join(b, key, "full")
    if everything is not None:
        joined = everything.select(key).distinct().join(joined, key, "left")
    status = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left_only").when(F.col("r"), "right_only").otherwise("neither")
    return joined.select(key, status.alias("status"))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts, gain in per cent, Jaccard and coverage of two sets, in one pass over the full join."""
    n = universe(left, right, None, key).agg(F.count_if(F.col("status") != "right_only").alias("n_left"), F.count_if(F.col("status") != "left_only").alias("n_right"), F.count_if(F.col("status") == "both").alias("n_both"), F.count(F.lit(1)).alias("n_any"))
    return n.select("n_left", "n_right", "n_both", F.try_divide((F.col("n_right") - F.col("n_left")) * 100.0, F.col("n_left")).alias("gain_percent"), F.try_divide("n_both", "n_any").alias("jaccard"), F.try_divide("n_both", "n_left").alias("coverage"))


def log_correlation(left: DataFrame, right: DataFrame, key: str, value: str, least: int = 10) -> DataFrame:
    """Pearson's correlation of log10 values of shared keys; null for fewer than `least`."""
    both = left.select(key, F.log10(value).alias("x")).join(right.select(key, F.log10(value).alias("y")), key)
    return both.agg(F.count(F.lit(1)).alias("n_shared"), F.corr("x", "y").alias("r")).select("n_shared", F.when(F.col("n_shared") >= least, F.col("r")).alias("pearson"))


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ranks with ties averaged, from counts of distinct values, summed up by range.

    Rows are joined back by their value, so values are written first: a sum that is formed twice may differ in its last place.
    """
    df = cut(df)
    counts = running(df.groupBy(value).agg(F.count(F.lit(1)).alias("__n")), value, "__n", "__upto")
    return df.join(counts.select(value, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(name)), value)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_rank(average_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "rx"), y, "ry")
    return ranked.agg(F.corr("rx", "ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def arm_metrics(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Gained, lost and retained keys, median log2 ratio and median absolute log2 ratio of shared ones."""
    joined = left.select(key, F.col(value).alias("a")).join(right.select(key, F.col(value).alias("b")), key, "full")
    ratio = F.when((F.col("a") > 0) & (F.col("b") > 0), F.log2(F.col("b") / F.col("a")))
    return joined.agg(F.count_if(F.col("a").isNull()).alias("gained"), F.count_if(F.col("b").isNull()).alias("lost"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("retained"), F.median(ratio).alias("median_log2"), F.median(F.abs(ratio)).alias("median_abs_log2"))


def lost(canonical: DataFrame, result: DataFrame, gene: str, peptide: str) -> DataFrame:
    """Genes of the canonical result that the other lacks, with how many of their peptides it has under other genes."""
    gone = canonical.join(result.select(gene).distinct(), gene, "left_anti")
    found = result.select(peptide).distinct().withColumn("found", F.lit(True))
    return gone.select(gene, peptide).distinct().join(found, peptide, "left").groupBy(gene).agg(F.count(F.lit(1)).alias("n_peptides"), F.count_if("found").alias("n_found_elsewhere"))
