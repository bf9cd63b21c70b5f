"""Genes of sequences by votes of peptides that are found in one gene only, and tiers built with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions import sequence as S
from evidra.operators.rollup import gene_vote


def index(canonical: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """canonical: header, sequence. (peptide, gene) of discriminative peptides, (gene, size), (name, gene) of clear names.

    Only headers with a real gene count.
    """
    own = canonical.withColumn("gene", S.gene_tag("header")).where(F.col("gene").isNotNull() & ~S.is_accession_gene("gene"))
    peptides = own.select("gene", F.explode(S.digest_folded("sequence")).alias("peptide")).groupBy("peptide").agg(F.min("gene").alias("gene"), F.max("gene").alias("other")).where("gene = other").select("peptide", "gene")
    names = own.select("gene", S.protein_name("header").alias("name")).where("name is not null").groupBy("name").agg(F.min("gene").alias("gene"), F.max("gene").alias("other")).where("gene = other").select("name", "gene")
    return peptides, peptides.groupBy("gene").agg(F.count(F.lit(1)).alias("size")), names


def assigned(records: DataFrame, canonical: DataFrame) -> DataFrame:
    """records: accession, header, sequence, unique accessions. Adds gene and method.

    Methods: peptide_vote, peptide_vote_ambiguous, ig_repertoire (no gene), name_match, kept_existing, unmapped (no gene).
    """
    peptides, sizes, names = index(canonical)
    cast = records.select("accession", F.explode(S.digest_folded("sequence")).alias("peptide")).join(peptides, "peptide").groupBy("accession", "gene").agg(F.count(F.lit(1)).alias("votes")).join(sizes, "gene")
    won = gene_vote(cast, "accession", "gene", "size").select("accession", F.col("gene").alias("voted"), "ambiguous")
    joined = records.join(won, "accession", "left").withColumn("name", S.protein_name("header")).join(names.withColumnRenamed("gene", "by_name"), "name", "left")
    own = S.gene_tag("header")
    method = (
        F.when(F.col("voted").isNotNull(), F.when(F.col("ambiguous"), "peptide_vote_ambiguous").otherwise("peptide_vote")).when(S.is_immunoglobulin("header"), "ig_repertoire")
        .when(F.col("by_name").isNotNull(), "name_match").when(own.isNotNull() & ~S.is_accession_gene(own), "kept_existing").otherwise("unmapped")
    )
    found = joined.withColumn("method", method)
    gene = F.when(F.startswith("method", F.lit("peptide_vote")), F.col("voted")).when(F.col("method") == "name_match", F.col("by_name")).when(F.col("method") == "kept_existing", own)
    return found.withColumn("gene", gene).select(*records.columns, "gene", "method")


def healed(records: DataFrame, canonical: DataFrame) -> DataFrame:
    """Records with their genes written into the headers: adds old_gene, gene, method; header is the new one."""
    made = assigned(records, canonical).withColumn("old_gene", S.gene_tag("header"))
    return made.withColumn("header", S.with_gene("header", F.col("gene")))


def method_counts(made: DataFrame) -> DataFrame:
    changed = F.col("gene").isNotNull() & ~F.col("gene").eqNullSafe(F.col("old_gene"))
    return made.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(changed).alias("changed"))


def smart_tier(canonical: DataFrame, candidates: DataFrame) -> DataFrame:
    """header, sequence, class: all canonical sequences, and candidates of other sequences that add something.

    A candidate stays as a variant, as an immunoglobulin, or as an isoform if it has a gene and a peptide that no
    canonical sequence has. Of records with one sequence the first by accession stays, canonical ones first.
    """
    base = canonical.groupBy("sequence").agg(F.min_by("header", "accession").alias("header")).select("header", "sequence", F.lit("canonical").alias("class"))
    others = candidates.where("sequence <> ''").join(canonical.select("sequence").distinct(), "sequence", "left_anti")
    known = canonical.select(F.explode(S.digest_folded("sequence")).alias("peptide")).distinct()
    novel = others.select("accession", F.explode(S.digest_folded("sequence")).alias("peptide")).join(known, "peptide", "left_anti").select("accession").distinct().withColumn("novel", F.lit(True))
    made = healed(others, canonical).join(novel, "accession", "left")
    variant = F.lower("accession").startswith("ens") | F.lower("header").contains("ens|")
    kind = F.when(variant, "variant").when(F.col("method") == "ig_repertoire", "ig_repertoire").when(F.col("gene").isNotNull() & F.col("novel"), "smart_isoform")
    kept = made.withColumn("class", kind).where("class is not null").groupBy("sequence").agg(F.min_by(F.struct("header", "class"), "accession").alias("b")).select("b.header", "sequence", "b.class")
    return base.unionByName(kept)
