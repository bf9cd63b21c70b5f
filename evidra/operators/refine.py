"""Candidates for refinement and proposals of single substitutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.sequence import clean_annotated, ion_completeness, normalize_il
from evidra.operators.ranking import best_per_key

#: Residues in the order that settles equal scores.
ORDER = "ARNDCQEGHILKMFPSTWYV"
#: Pairs that de novo engines confuse, with scores; every other pair has -5.
CONFUSIONS = {"IL": 10, "ND": 6, "QE": 6, "KQ": 4, "MF": 3, "AG": 2, "AS": 1, "VA": 1, "WD": 2, "WA": 2}
OTHER = -5


def confusions(spark: SparkSession) -> DataFrame:
    """residue, target, score of all pairs of different residues. Other matrices have the same columns."""
    known = CONFUSIONS | {pair[::-1]: s for pair, s in CONFUSIONS.items()}
    return spark.createDataFrame([(a, b, known.get(a + b, OTHER)) for a in ORDER for b in ORDER if a != b], "residue string, target string, score int")


def substitutions(matrix: DataFrame, least: int = -1, most: int = 3) -> DataFrame:
    """residue, options: up to `most` targets with at least `least`, best first; ties by the order of residues."""
    rank = F.instr(F.lit(ORDER), F.col("target"))
    ranked = matrix.where((F.col("score") >= least) & (rank > 0)).groupBy("residue").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), rank.alias("place"), "target", "score"))).alias("o"))
    return ranked.select("residue", F.transform(F.slice("o", 1, most), lambda x: F.struct(x.target.alias("target"), x.score.alias("score"))).alias("options"))


def variants(sequences: DataFrame, matrix: DataFrame, sequence: str = "sequence", least: int = -1, most: int = 3) -> DataFrame:
    """Every single substitution: the columns of `sequences`, position (from 0), notation, variant, score.

    The matrix is a table of at most 400 rows and is broadcast; a row for each place joins it by its residue.
    """
    s = F.upper(F.col(sequence))
    spread = sequences.where(F.length(sequence) > 0).select("*", F.explode(F.sequence(F.lit(0), F.length(sequence) - 1)).alias("position"))
    spread = spread.withColumn("residue", F.substring(s, F.col("position") + 1, F.lit(1)))
    made = spread.join(F.broadcast(substitutions(matrix, least, most)), "residue").withColumn("o", F.explode("options"))
    variant = F.overlay(F.col(sequence), F.col("o.target"), F.col("position") + 1)
    notation = F.concat("residue", (F.col("position") + 1).cast("string"), "o.target")
    return made.select(*sequences.columns, "position", notation.alias("notation"), variant.alias("variant"), F.col("o.score").alias("score"))


def with_completeness(psms: DataFrame) -> DataFrame:
    """Adds `ics`: from matched_peaks, else from longest_b and longest_y; the length from peptide_len, else the peptide."""
    length = F.col("peptide_len") if "peptide_len" in psms.columns else F.length(clean_annotated("peptide"))
    if "matched_peaks" in psms.columns:
        b, y = F.coalesce("matched_peaks", F.lit(0)), F.lit(0)
    elif {"longest_b", "longest_y"} <= set(psms.columns):
        b, y = F.coalesce("longest_b", F.lit(0)), F.coalesce("longest_y", F.lit(0))
    else:
        return psms.withColumn("ics", F.lit(0.0))
    return psms.withColumn("ics", ion_completeness(b, y, length))


def completeness_summary(df: DataFrame) -> DataFrame:
    ics = F.col("ics")
    share = lambda c: F.round(F.avg(c.cast("int")) * 100, 1)
    return df.agg(F.count(F.lit(1)).alias("n_psms"), F.round(F.avg(ics), 4).alias("mean_ics"), F.round(F.median(ics), 4).alias("median_ics"), share(ics >= 0.4).alias("pct_high"), share(ics < 0.3).alias("pct_low"), F.count_if(ics >= 0.4).alias("n_high"), F.count_if(ics < 0.3).alias("n_low"))


def candidates(psms: DataFrame, q: str = "spectrum_q", limit: float = 0.01, below: float = 0.4, most: int = 500, tie: str = "peptide") -> DataFrame:
    """Accepted matches of low completeness: the best hyperscore of each peptide, of those the `most` best.

    The limit is the operator's own; ties are settled by `tie` and the peptide.
    """
    low = with_completeness(psms).where((F.col(q) <= limit) & (F.col("ics") < below))
    best = best_per_key(low, ["peptide"], -F.col("hyperscore"), F.col(tie))
    return best.orderBy(F.desc("hyperscore"), "peptide").limit(most).select(clean_annotated("peptide").alias("peptide"), F.col("peptide").alias("peptide_raw"), F.substring_index("proteins", ";", 1).alias("protein"), "ics", "hyperscore")


def proposals(proteins: DataFrame, found: DataFrame, matrix: DataFrame, least: int = -1, most: int = 3) -> DataFrame:
    """proteins: protein, sequence. found: peptide, protein. One substitution for each protein that holds a candidate.

    The peptide is located as it is, else with I for L; of all substitutions within it the best score wins, then the
    first place, then the order of residues. All proteins come back; changed ones have `changed` and a suffixed name.
    """
    at = F.instr(F.col("sequence"), F.col("peptide"))
    folded = F.instr(normalize_il("sequence"), normalize_il("peptide"))
    placed = proteins.join(found.select("peptide", "protein").distinct(), "protein").withColumn("start", F.when(at > 0, at).otherwise(folded) - 1).where("start >= 0")
    places = placed.select("protein", "sequence", F.explode(F.sequence(F.col("start"), F.col("start") + F.length("peptide") - 1)).alias("position")).distinct()
    options = places.withColumn("residue", F.substring(F.col("sequence"), F.col("position") + 1, F.lit(1))).join(F.broadcast(substitutions(matrix, least, most)), "residue").withColumn("o", F.element_at("options", 1))
    best = options.groupBy("protein").agg(F.min_by(F.struct("position", "residue", F.col("o.target").alias("target"), F.col("o.score").alias("score")), F.struct(-F.col("o.score"), "position")).alias("b"))
    joined = proteins.join(best, "protein", "left")
    changed = F.col("b").isNotNull()
    variant = F.when(changed, F.overlay(F.col("sequence"), F.col("b.target"), F.col("b.position") + 1)).otherwise(F.col("sequence"))
    return joined.select(F.when(changed, F.concat("protein", F.lit("__VAR"))).otherwise(F.col("protein")).alias("protein"), variant.alias("sequence"), changed.alias("changed"), F.concat("b.residue", (F.col("b.position") + 1).cast("string"), "b.target").alias("notation"), F.col("b.score").alias("score"))
