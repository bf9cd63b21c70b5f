"""One sample's inference from end to end: peptides, exact edges, optional rescue by masses, a strategy, its reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators import contaminants, graph, massindex, matching, network
from evidra.operators.lineage import cut
from evidra.sources import sinks

SHORTEST, LONGEST, LEAST_VOTES = 9, 50, 5


@dataclass(frozen=True)
class Inference:
    """selected: protein. sequences: protein, sequence of those. edges: peptide, protein. provenance: a record for each
    selected protein. stats: one row."""

    selected: DataFrame
    sequences: DataFrame
    edges: DataFrame
    provenance: DataFrame
    stats: DataFrame


def scored_peptides(predictions: DataFrame, low: int = SHORTEST, high: int = LONGEST, least: float = 0.0) -> DataFrame:
    """peptide, score: the best score of each peptide, I as L, of `low` to `high` letters and at least `least`."""
    own = predictions.select(F.translate(F.upper("peptide"), "I", "L").alias("peptide"), F.col("score").cast("double").alias("score")).where(F.length("peptide").between(low, high))
    return own.groupBy("peptide").agg(F.max("score").alias("score")).where((F.col("score") >= least) if least > 0 else F.lit(True))


def exact_edges(peptides: DataFrame, proteins: DataFrame, low: int = SHORTEST) -> DataFrame:
    """peptide, protein of all occurrences, I as L. proteins: protein, sequence."""
    folded = proteins.select("protein", F.translate("sequence", "I", "L").alias("sequence"))
    return matching.substring_join(peptides.select("peptide"), folded, seed=low).select("peptide", "protein").distinct()


def infer(predictions: DataFrame, proteins: DataFrame, strategy: str = "razor", least_peptides: int = 2, low: int = SHORTEST, high: int = LONGEST, least_score: float = 0.0, species: DataFrame | None = None, prune: float | None = None, rescue: DataFrame | None = None, least_votes: int = LEAST_VOTES, known: DataFrame | None = None) -> Inference:
    """predictions: peptide, score. proteins: protein, sequence. Strategies are those of `graph` by name.

    rescue: protein, sequence of a larger set. Peptides without an exact match are anchored there by mass; the
    proteins found join the sample's, unless it has them, and all edges are made again, exact ones as before. species:
    protein, species, for species_budget. known: accession, contaminants other than the listed ones. An unknown strategy is an error.
    """
    choices: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
        "razor": lambda e, s: graph.razor(e).select("protein").distinct(),
        "razor_scored": lambda e, s: graph.razor_scored(e, s).select("protein").distinct(),
        "razor_greedy": lambda e, s: graph.razor_greedy(e).select("protein").distinct(),
        "uniform": lambda e, s: graph.uniform(e).select("protein"),
        "uniform_2pep": lambda e, s: graph.uniform(e, least_peptides).select("protein"),
        "info_score": lambda e, s: graph.info_score(e, s, least_score if least_score > 0 else 0.1).select("protein"),
        "species_budget": lambda e, s: graph.species_budget(e, species, prune).select("protein").distinct(),
    }
    if strategy not in choices or (strategy == "species_budget" and species is None):
        raise ValueError(f"{strategy} is not one of {', '.join(sorted(choices))}, or needs species")
    peptides = cut(scored_peptides(predictions, low, high, least_score))
    own = proteins.select("protein", "sequence")
    edges = cut(exact_edges(peptides, own, low))
    found = None
    if rescue is not None:
        failed = peptides.join(edges.select("peptide").distinct(), "peptide", "left_anti")
        asked = massindex.anchors(failed.select(F.col("peptide").alias("sequence"), "score"))
        index = massindex.write_index(rescue.select(F.col("protein").alias("target"), "sequence"), rule="nearest")
        found = cut(massindex.anchored(index, cut(asked.select("query", "sequence", "mass")), least_votes).select(F.col("target").alias("protein")).distinct())
        new = cut(rescue.select("protein", "sequence").join(found, "protein", "left_semi").join(own, "protein", "left_anti"))
        edges = cut(edges.unionByName(exact_edges(peptides, new, low)))
        own, rescued = own.unionByName(new), new.select("protein")
    selected = cut(choices[strategy](edges, peptides))
    listed = contaminants.table(edges.sparkSession) if known is None else known
    provenance = network.admissions(selected, edges, peptides, listed, rescued if rescue is not None else None, strategy)
    n_found, n_new = (found.count(), rescued.count()) if rescue is not None else (None, None)
    counts = own.agg(F.count(F.lit(1)).alias("n_proteins")).crossJoin(peptides.agg(F.count(F.lit(1)).alias("n_peptides"))).crossJoin(edges.agg(F.count_distinct("peptide").alias("n_matched"), F.count_distinct("protein").alias("n_candidates"))).crossJoin(selected.agg(F.count(F.lit(1)).alias("n_selected")))  # one row each
    stats = counts.select(F.lit(strategy).alias("strategy"), "*", F.coalesce(F.try_divide("n_proteins", "n_selected"), F.lit(0.0)).alias("reduction_factor"), F.lit(n_found).cast("bigint").alias("n_rescued"), F.lit(n_new).cast("bigint").alias("n_rescued_new"))
    return Inference(selected, own.join(selected, "protein", "left_semi"), edges, provenance, stats)


def write(made: Inference, path: str) -> None:
    """The selected sequences in order of accessions with an index, the provenance and, last, the statistics, which
    mark a whole result."""
    sinks.write_sorted_fasta(made.sequences, f"{path}/selected", "protein")
    sinks.write_json(made.provenance, f"{path}/provenance")
    sinks.write_json(made.stats, f"{path}/stats")
