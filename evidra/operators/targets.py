"""Search targets: counts by prefix, control sequences, selection by exact sequence, coverage of a specimen's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition_counts(headers: DataFrame, prefix: str, header: str = "header") -> DataFrame:
    """One row: n_target and n_control, by records and not by lines."""
    own = F.startswith(F.col(header), F.lit(prefix))
    return headers.agg(F.count_if(~own).alias("n_target"), F.count_if(own).alias("n_control"))


def observed_prefixes(headers: DataFrame, candidate: str, known: list[str] = (), header: str = "header") -> DataFrame:
    """prefix, n, is_known of all accessions that hold candidate in any case.

    A known prefix counts as it is, the longest first; else from candidate up to the next `_`, or candidate's letters.
    """
    token = F.element_at(F.split(F.trim(header), r"\s+"), 1)
    seen = headers.select(token.alias("t"), F.instr(F.upper(token), candidate.upper()).alias("at")).where("at > 0")
    rest = F.substring("t", F.col("at"), F.length("t"))
    cut = F.locate("_", rest, len(candidate) + 1)
    novel = F.when(cut > 0, F.substring(rest, F.lit(1), cut)).otherwise(F.substring(rest, 1, len(candidate)))
    prefix = F.coalesce(*[F.when(F.startswith("t", F.lit(k)), F.lit(k)) for k in sorted(known, key=lambda k: (-len(k), k))], novel)
    return seen.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).withColumn("is_known", F.col("prefix").isin(*known) if known else F.lit(False))


def injected(targets: DataFrame, controls: DataFrame, prefix: str, header: str = "header") -> DataFrame:
    """Targets and controls as one table with is_control.

    A target with the prefix, or a control without it, is an error: either would count on the wrong side.
    """
    own = F.startswith(F.col(header), F.lit(prefix))
    wrong = lambda bad, text: F.when(bad, F.raise_error(F.concat(F.lit(text), F.col(header))).cast("string")).otherwise(F.col(header))
    checked = targets.withColumn(header, wrong(own, "control among the targets: ")).withColumn("is_control", F.lit(False))
    return checked.unionByName(controls.withColumn(header, wrong(~own, "control without its prefix: ")).withColumn("is_control", F.lit(True)))


def selected_union(baseline: DataFrame, background: DataFrame, selected: DataFrame, prefix: str = "SHA256_") -> DataFrame:
    """Exact-sequence union of three tables with accession, sequence, seq_hash: accession, sequence, seq_hash, layer, appended.

    All of the baseline stays; the background's sequences that it lacks follow (of equal ones the least accession), then
    the selected ones that both lack, named by prefix and hash. `appended` (layer number, hash) orders what is added, null
    in the baseline. One aggregation by hash; no row is compared with another.
    """
    layers = [baseline.select("accession", "sequence", "seq_hash", F.lit(0).alias("layer")), background.select("accession", "sequence", "seq_hash", F.lit(1).alias("layer")), selected.select(F.concat(F.lit(prefix), "seq_hash").alias("accession"), "sequence", "seq_hash", F.lit(2).alias("layer"))]
    added = layers[1].unionByName(layers[2]).unionByName(layers[0]).groupBy("seq_hash").agg(F.min(F.struct("layer", "accession", "sequence")).alias("m")).where("m.layer > 0")
    return layers[0].withColumn("appended", F.lit(None).cast("struct<layer:int,seq_hash:string>")).unionByName(added.select("m.accession", "m.sequence", "seq_hash", "m.layer", F.struct("m.layer", "seq_hash").alias("appended")))


def source_coverage(abundances: DataFrame, proteins: DataFrame, annotations: DataFrame, compounds: DataFrame) -> DataFrame:
    """One row of counts. abundances: gene, dna, rna. proteins: gene. annotations: gene, term. compounds: compound, value.

    A gene is available if it has abundances and a sequence. Missing values are null, and never positive.
    """
    genes = abundances.groupBy("gene").agg(F.max("dna").alias("dna"), F.max("rna").alias("rna")).withColumn("a", F.lit(1))
    both = genes.join(proteins.select("gene").distinct().withColumn("p", F.lit(1)), "gene", "full").join(annotations.where("term <> ''").select("gene").distinct().withColumn("k", F.lit(1)), "gene", "left")
    a, p, k = (F.col(c).isNotNull() for c in "apk")
    counts = both.agg(
        F.count_if(a).alias("raw_genes"), F.count_if(a & p).alias("available_genes"), F.count_if(a & ~p).alias("unavailable_genes"), F.count_if(p & ~a).alias("proteins_without_abundance"),
        *[F.count_if(a & ~p & (F.col(c) > 0)).alias(f"unavailable_positive_{c}") for c in ("dna", "rna")], *[F.count_if(a & p & F.col(c).isNull()).alias(f"missing_{c}_in_available") for c in ("dna", "rna")],
        F.count_if(a & p & k).alias("available_genes_with_term"),
    )
    return counts.crossJoin(compounds.groupBy("compound").agg(F.max("value").alias("v")).agg(F.count_if(F.col("v") > 0).alias("positive_compounds")))


def median_lift(depths: DataFrame, arm: str, base: str, other: str, depth: str = "depth") -> DataFrame:
    """One row: medians of two arms over their samples, numbers of samples, lift of other over base in per cent (0 if base is)."""
    of = lambda name: F.median(F.when(F.col(arm) == name, F.col(depth)))
    made = depths.agg(of(base).alias("base_median"), of(other).alias("other_median"), F.count_if(F.col(arm) == base).alias("base_samples"), F.count_if(F.col(arm) == other).alias("other_samples"))
    return made.withColumn("lift_pct", F.coalesce(F.try_divide(100.0 * (F.col("other_median") - F.col("base_median")), "base_median"), F.lit(0.0)))
