"""Taxonomy of peptides: assignment status, trees of weights, balance of a host and its community."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = ("domain", "phylum", "class", "order", "family", "genus", "species")
BACTERIA, ARCHAEA = 2, 2157
CATEGORIES = ("Host", "Bacteria", "Archaea", "Other assigned taxa", "Unresolved")


def assigned(peptides: DataFrame, lookups: DataFrame) -> DataFrame:
    """peptides: peptide. lookups: peptide, taxon_id, cutoff_used, lineage (array of struct id, name, rank), one row each.

    Adds status (assigned, unresolved, lookup_cutoff, cutoff_not_reported, not_returned) and the lineage, which is
    empty unless assigned. Two answers for a peptide are an error.
    """
    one = lookups.groupBy("peptide").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("taxon_id", "cutoff_used", "lineage")).alias("a"))
    one = one.select("peptide", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two answers for "), "peptide")).cast(one.schema["a"].dataType)).otherwise(F.col("a")).alias("a"))
    none = F.col("a.taxon_id").isNull() | (F.col("a.taxon_id") <= 1)
    status = F.when(F.col("a").isNull(), "not_returned").when(F.col("a.cutoff_used").isNull(), "cutoff_not_reported").when(F.col("a.cutoff_used"), "lookup_cutoff").when(none, "unresolved").otherwise("assigned")
    joined = peptides.join(one, "peptide", "left").withColumn("status", status)
    kind = one.schema["a"].dataType["lineage"].dataType.simpleString()
    return joined.withColumn("lineage", F.when(F.col("status") == "assigned", F.col("a.lineage")).otherwise(F.array().cast(kind))).drop("a")


def tree(weights: DataFrame, keys: list[str] = (), lineage: str = "lineage", status: str = "status", weight: str = "weight") -> DataFrame:
    """count and self_count of each lineage prefix (path of ids), depth and name; what is not assigned is under its status.

    The root, depth 0, has the whole weight, so that a node's count is its self_count and its children's counts.
    """
    ids = F.when(F.size(lineage) > 0, F.transform(lineage, lambda x: x["id"].cast("string"))).otherwise(F.array(F.concat(F.lit("?"), F.col(status))))
    names = F.when(F.size(lineage) > 0, F.transform(lineage, lambda x: x["name"])).otherwise(F.array(F.col(status)))
    own = weights.where(F.col(weight) > 0).groupBy(*keys, ids.alias("i"), names.alias("m")).agg(F.sum(weight).alias("w"))
    spread = own.select(*keys, "i", "m", "w", F.explode(F.sequence(F.lit(0), F.size("i"))).alias("depth"))
    path = F.array_join(F.slice("i", F.lit(1), F.col("depth")), "/")
    return spread.groupBy(*keys, path.alias("path"), "depth").agg(F.min(F.when(F.col("depth") > 0, F.try_element_at("m", F.col("depth")))).alias("name"), F.sum("w").alias("count"), F.sum(F.when(F.col("depth") == F.size("i"), F.col("w")).otherwise(0)).alias("self_count"))


def balance(observed: DataFrame, host: int = 9606, sample: str = "sample", signal: str = "signal") -> DataFrame:
    """observed: sample, peptide, status, lineage, signal, a row for each peptide of a sample. Shares of each category.

    sample, category, peptides, signal, peptide_fraction, signal_fraction (null where the sample has none).
    """
    has = lambda taxon: F.exists("lineage", lambda x: x["id"] == taxon)
    category = F.when(F.col("status") != "assigned", "Unresolved").when(has(host), "Host").when(has(BACTERIA), "Bacteria").when(has(ARCHAEA), "Archaea").otherwise("Other assigned taxa")
    kinds = [F.struct(F.lit(c).alias("category"), F.count_if(F.col("k") == c).alias("peptides"), F.coalesce(F.sum(F.when(F.col("k") == c, F.col(signal))), F.lit(0.0)).alias("signal")) for c in CATEGORIES]
    made = observed.withColumn("k", category).groupBy(sample).agg(F.count(F.lit(1)).alias("n"), F.sum(signal).alias("s"), F.array(*kinds).alias("c"))
    return made.select(sample, "n", "s", F.explode("c").alias("c")).select(sample, "c.*", F.try_divide("c.peptides", "n").alias("peptide_fraction"), F.try_divide("c.signal", "s").alias("signal_fraction"))


def reference_table(proteins: DataFrame, taxa: DataFrame) -> DataFrame:
    """accession, taxon (0 where unknown), sequence, note (empty): what a lookup service is given."""
    return proteins.join(taxa, "accession", "left").select("accession", F.coalesce("taxon", F.lit(0)).alias("taxon"), "sequence", F.lit("").alias("note"))
