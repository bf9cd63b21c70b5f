"""Contaminants by accession: the default list, tagging and exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.sequence import accession_of

#: Accessions of common contaminants (trypsin, albumin, keratins, caseins, egg and serum proteins, immunoglobulins).
DEFAULT = [
    "P00761", "P02769", "P22629", "P00921", "P46406", "P04264", "P35908", "P13645", "P35527", "P04259", "P13647", "P05787", "P08727", "P08779", "P19013", "Q04695",
    "P02535", "P02662", "P02663", "P02666", "P02668", "P00711", "P02754", "P01012", "P00698", "P02192", "P01857", "P01859", "P01860", "P01861", "P01876", "P01877", "P01834",
    "P12763", "P02070", "P01966",
]
PREFIX = "CON_"


def table(spark: SparkSession, accessions: list[str] | None = None) -> DataFrame:
    """accession: the default list, or another."""
    return spark.createDataFrame([(a,) for a in accessions or DEFAULT], "accession string")


def marked(df: DataFrame, identifier: str | Column, contaminants: DataFrame, name: str = "contaminant", prefix: str = PREFIX) -> DataFrame:
    """Adds a boolean: the identifier carries the prefix, or its accession is listed."""
    own = F.col(identifier) if isinstance(identifier, str) else identifier
    known = contaminants.select(F.col("accession").alias("__c")).distinct()
    joined = df.withColumn("__a", accession_of(own)).withColumn("__tag", F.coalesce(own.startswith(prefix), F.lit(False))).join(known, F.col("__a") == F.col("__c"), "left")
    return joined.withColumn(name, F.col("__tag") | F.col("__c").isNotNull()).drop("__a", "__c", "__tag")


def tagged(df: DataFrame, identifier: str, contaminants: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Prefixes the identifiers of contaminants that are not prefixed yet; adds `contaminant`."""
    own = F.col(identifier)
    return marked(df, identifier, contaminants, prefix=prefix).withColumn(identifier, F.when(F.col("contaminant") & ~own.startswith(prefix), F.concat(F.lit(prefix), own)).otherwise(own))


def excluded(psms: DataFrame, contaminants: DataFrame, proteins: str = "proteins", prefix: str = PREFIX) -> DataFrame:
    """Matches whose first protein (before `;` or `,`) is no contaminant."""
    first = F.trim(F.regexp_extract(F.coalesce(F.col(proteins), F.lit("")), r"^([^;,]*)", 1))
    return marked(psms, first, contaminants, "__out", prefix).where(~F.col("__out")).drop("__out")
