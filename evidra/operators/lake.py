"""Sequence lakes: deduplication by content hash with provenance, and merged annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Descriptions that say nothing.
UNINFORMATIVE = r"(?i)\b(hypothetical|uncharacteri[sz]ed|putative\s+uncharacteri[sz]ed|predicted\s+protein|unknown\s+function|conserved\s+hypothetical|fragment)\b"


def dedup(records: DataFrame, seq_hash: str, order: list[str], carry: list[str]) -> DataFrame:
    """One row for each hash: the first record in order owns it; n_sources counts occurrences.

    One aggregation with partial minima; hot hashes are one row for each task before the shuffle.
    """
    return records.groupBy(seq_hash).agg(F.min_by(F.struct(*carry), F.struct(*order)).alias("o"), F.count(F.lit(1)).alias("n_sources")).select(seq_hash, "o.*", "n_sources")


def joint_headers(records: DataFrame, seq_hash: str, priority: str, header: str, threshold: int | None = None, track_all: bool = False) -> DataFrame:
    """Headers by hash in order of (priority, header), joined by `|||`: those of tracked priorities, and those of
    sources behind the owner."""
    owner = records.groupBy(seq_hash).agg(F.min(priority).alias("__p"))
    kept = records.join(owner, seq_hash)
    if not track_all:
        kept = kept.where((F.col(priority) <= F.lit(threshold or 0)) | (F.col(priority) > F.col("__p")))
    pairs = F.array_sort(F.collect_set(F.struct(priority, header)))
    return kept.groupBy(seq_hash).agg(pairs.alias("h")).select(seq_hash, F.size("h").alias("n_sources"), F.array_join(F.transform("h", lambda x: x[header]), "|||").alias("all_source_headers"))


def merge_annotations(records: DataFrame, seq_hash: str) -> DataFrame:
    """records: priority, accession, gene, description, organism, tax_id, evidence, version, reviewed.

    Primary record by (priority, accession); first gene by priority; longest informative description; organism if
    unanimous, else `ambiguous`; sorted taxa; least evidence level; greatest version; reviewed if any is.
    """
    order = F.struct("priority", "accession")
    informative = F.col("description").isNotNull() & (F.trim("description") != "") & ~F.col("description").rlike(UNINFORMATIVE)
    long_first = F.struct(-F.length("description"), F.col("priority"), F.col("accession"))
    some = F.when(F.col("description") != "", long_first)
    made = records.groupBy(seq_hash).agg(
        F.min_by("accession", order).alias("accession"),
        F.min_by("gene", F.when(F.col("gene").isNotNull() & (F.col("gene") != ""), order)).alias("gene"),
        F.coalesce(F.min_by("description", F.when(informative, long_first)), F.min_by("description", some), F.lit("")).alias("description"),
        F.count_distinct(F.nullif("organism", F.lit(""))).alias("n_organisms"), F.min(F.nullif("organism", F.lit(""))).alias("one"),
        F.array_sort(F.collect_set("tax_id")).alias("tax_ids"), F.min("evidence").alias("evidence"), F.max("version").alias("version"), F.bool_or("reviewed").alias("reviewed"), F.count(F.lit(1)).alias("n_sources"),
    )
    organism = F.when(F.col("n_organisms") > 1, "ambiguous").otherwise(F.col("one"))
    return made.withColumn("organism", organism).drop("one", "n_organisms")


def build_stats(records: DataFrame, seq_hash: str, source: str) -> DataFrame:
    """Per source: records, distinct sequences, sequences it has alone."""
    pairs = records.groupBy(seq_hash, source).agg(F.count(F.lit(1)).alias("n"))
    alone = pairs.groupBy(seq_hash).agg(F.count(F.lit(1)).alias("k"))
    return pairs.join(alone, seq_hash).groupBy(source).agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_sequences"), F.count_if(F.col("k") == 1).alias("n_alone"))


def consistent(records: DataFrame, accession: str, sequence: str) -> DataFrame:
    """The distinct records; an error if one accession has two sequences."""
    checked = records.groupBy(accession).agg(F.min(sequence).alias(sequence), F.max(sequence).alias("__other"))
    return checked.where(F.when(F.col(sequence).eqNullSafe(F.col("__other")), True).otherwise(F.raise_error(F.concat(F.lit("two sequences for "), F.col(accession))).cast("boolean"))).drop("__other")


def numbered(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds the number of each record within its key."""
    return records.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def reassigned(records: DataFrame, seq_hash: str, source: str, header: str, tags: list[str] = (), uniform: str | None = None) -> DataFrame:
    """Adds `emitted`: the header as it is, `tag_hash` for records of the given source tags, or `uniform_hash` for all.

    A uniform tag overrides the others; an empty one is an error.
    """
    if uniform is not None and not uniform.strip():
        raise ValueError("the uniform tag is empty")
    own = F.concat(F.col(source), F.lit("_"), F.col(seq_hash))
    named = F.concat(F.lit((uniform or "").strip() + "_"), F.col(seq_hash)) if uniform else F.when(F.col(source).isin(*tags), own).otherwise(F.col(header)) if tags else F.col(header)
    return records.withColumn("emitted", named)


def conflicts(records: DataFrame, seq_hash: str) -> DataFrame:
    """Organisms and genes of hashes whose records disagree: seq_hash, organisms, genes (sorted; null where they agree)."""
    sets = records.groupBy(seq_hash).agg(*[F.array_sort(F.collect_set(F.nullif(c, F.lit("")))).alias(c) for c in ("organism", "gene")])
    several = lambda c: F.when(F.size(c) > 1, F.col(c))
    return sets.select(seq_hash, several("organism").alias("organisms"), several("gene").alias("genes")).where("organisms is not null or genes is not null")
