"""Error control: proportions of false discoveries, calibration, tuning, conserved matches, generators."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Q_GRID = (0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1)


def fdp(target: Column, entrapment: Column, ratio: float = 1.0, empty: str = "null") -> dict[str, Column]:
    """Estimators from counts: combined, lower bound, sample. An empty denominator gives null, or 0.0 with empty="zero"."""
    total = target + entrapment
    made = {
        "combined": F.try_divide(entrapment * (1 + 1 / ratio), total),
        "lower_bound": F.try_divide(entrapment, total),
        "sample": F.try_divide(entrapment / ratio, target),
    }
    return {k: F.coalesce(v, F.lit(0.0)) if empty == "zero" else v for k, v in made.items()}


def paired_fdp(target: Column, entrapment: Column, above: Column, between: Column) -> Column:
    """The paired estimator: entrapments, plus those that beat their target, plus twice those between."""
    return F.try_divide(entrapment + above + 2 * between, target + entrapment)


def elias_gygi(target: Column, decoy: Column) -> Column:
    return F.try_divide(2 * decoy, target + decoy)


def verdict(rate: Column, limit: float) -> Column:
    return F.when(rate.isNull(), "UNDEFINED").when(rate <= limit, "PASS").otherwise("FAIL")


def estimates(entrapment: Column, target: Column, shared: Column, db_target: Column, db_entrapment: Column) -> dict[str, Column]:
    """All estimators from counts of matches and of the searched database. What is not defined is null, never 0."""
    total = entrapment + target
    some = F.when(db_entrapment > 0, F.lit(1))
    ratio = F.when(db_target > 0, F.try_divide(db_entrapment, db_target))
    scaled = entrapment * F.try_divide(db_target, db_entrapment)
    return {
        "r": ratio, "lower_bound": F.try_divide(entrapment, total), "combined_upper": F.try_divide(entrapment * (1 + F.try_divide(F.lit(1), ratio)), total),
        "elias_gygi": some * F.try_divide(2 * entrapment, total), "sample_method": F.try_divide(entrapment, target), "size_scaled": F.try_divide(scaled, scaled + target),
        "shared_sensitivity": F.try_divide(entrapment + shared, entrapment + shared + target),
    }


def paired_counts(pairs: DataFrame, cutoff: float) -> DataFrame:
    """pairs: target_score, entrapment_score, null where not found. The paired estimator and its counts, in one row.

    above: entrapments found whose target is not; between: entrapments found that score higher than their found target.
    """
    t, e = F.coalesce(F.col("target_score") >= cutoff, F.lit(False)), F.coalesce(F.col("entrapment_score") >= cutoff, F.lit(False))
    n = pairs.agg(F.count_if(t).alias("n_target"), F.count_if(e).alias("n_entrapment"), F.count_if(e & ~t).alias("n_target_undiscovered"), F.count_if(e & t & (F.col("entrapment_score") > F.col("target_score"))).alias("n_entrapment_greater"))
    return n.withColumn("fdp_paired", F.round(paired_fdp(F.col("n_target"), F.col("n_entrapment"), F.col("n_target_undiscovered"), F.col("n_entrapment_greater")), 6))


def class_counts(psms: DataFrame, keys: list[str], q: str, threshold: float = 0.01, least: int = 9, prefix: str = "ENTRAP_") -> DataFrame:
    """psms: peptide, proteins (array), label, q. Counts of target, entrapment, shared and decoy matches and peptides.

    Decoys are counted whatever their q; the others at or under the threshold with `least` residues or more.
    """
    bare = F.regexp_replace(F.upper("peptide"), "[^A-Z]", "")
    kind = F.when(F.col("label") != 1, "decoy").otherwise(psm_class(F.col("proteins"), F.col("label"), prefix, "\u0000"))
    own = psms.withColumns({"__k": kind, "__p": bare}).where((F.col("__k") == "decoy") | (F.col(q).between(0, threshold) & (F.length("__p") >= least)))
    return own.groupBy(*keys).agg(*[F.count_if(F.col("__k") == k).alias(f"n_{k}") for k in ("target", "entrap", "shared", "decoy")], *[F.count_distinct(F.when(F.col("__k") == k, F.col("__p"))).alias(f"peptides_{k}") for k in ("target", "entrap", "shared")])


def fdp_report(counts: DataFrame, db_target: int, db_entrapment: int, conserved_matches: str | None = None) -> DataFrame:
    """counts: those of class_counts, and a count of conserved entrapment matches if named. All estimators, a verdict, and
    those of what is left of the entrapments without the conserved ones."""
    e, t, s = F.col("n_entrap"), F.col("n_target"), F.col("n_shared")
    made = counts.withColumns(estimates(e, t, s, F.lit(db_target), F.lit(db_entrapment)))
    made = made.withColumn("verdict", verdict(F.col("combined_upper"), 0.01))
    if conserved_matches is None:
        return made
    rest = estimates(F.greatest(e - F.col(conserved_matches), F.lit(0)), t, s, F.lit(db_target), F.lit(db_entrapment))
    return made.withColumns({f"corrected_{k}": rest[k] for k in ("lower_bound", "combined_upper")})


def summary(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """n, median, inclusive quartiles (the median for fewer than four) and their distance; nulls and NaN do not count."""
    own = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    got = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    quartile = lambda k: F.when(F.col("n") >= 4, F.col("q")[k]).otherwise(F.col("q")[1])
    return got.select(*keys, "n", F.col("q")[1].alias("median"), quartile(0).alias("q1"), quartile(2).alias("q3"), (quartile(2) - quartile(0)).alias("iqr"))


def winner(grid: DataFrame, fdp_limit: float = 0.01) -> DataFrame:
    """Of a tuning grid (n_target, fdp and settings), the row with most targets among those at or under the limit, else
    the one with the least fdp; with `passed`."""
    passed = F.coalesce(F.col("fdp") <= fdp_limit, F.lit(False))
    rest = [c for c in grid.columns]
    order = F.struct(~passed, F.when(passed, -F.col("n_target").cast("double")).otherwise(F.coalesce("fdp", F.lit(float("inf")))), *[F.col(c) for c in rest if c not in ("n_target", "fdp")])
    return grid.withColumn("passed", passed).agg(F.min_by(F.struct(*rest, "passed"), order).alias("b")).select("b.*")


def psm_class(proteins: Column, label: Column, prefix: str = "ENTRAP_", decoy: str = "rev_") -> Column:
    """decoy, target, entrap or shared, by the prefixes of all proteins."""
    trap = F.exists(proteins, lambda x: x.startswith(prefix))
    plain = F.exists(proteins, lambda x: ~x.startswith(prefix))
    return F.when((label == -1) | F.exists(proteins, lambda x: x.startswith(decoy)), "decoy").when(trap & plain, "shared").when(trap, "entrap").otherwise("target")


def picked(psms: DataFrame, protein: str, score: str, tie: str) -> DataFrame:
    """The best-scoring match of each protein."""
    rest = [c for c in psms.columns if c != protein]
    return psms.groupBy(protein).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(tie))).alias("b")).select(protein, "b.*")


def calibration(df: DataFrame, keys: list[str], q: str, trap: Column, ratio: float = 1.0, grid=Q_GRID) -> DataFrame:
    """Combined proportion for each key and each q of a grid: counts are taken per grid cell, then summed up."""
    cell = F.lit(None).cast("int")
    for k in reversed(range(len(grid))):
        cell = F.when(F.col(q) <= F.lit(grid[k]), k).otherwise(cell)
    cells = df.withColumn("cell", cell).where("cell is not null").groupBy(*keys, "cell").agg(F.count_if(trap).alias("e"), F.count_if(~trap).alias("t"))
    spread = cells.select(*keys, "e", "t", F.explode(F.sequence(F.col("cell"), F.lit(len(grid) - 1))).alias("cell"))
    summed = spread.groupBy(*keys, "cell").agg(F.sum("e").alias("n_entrapment"), F.sum("t").alias("n_target"))
    return summed.select(*keys, F.element_at(F.array(*[F.lit(g) for g in grid]), F.col("cell") + 1).alias("q"), "n_entrapment", "n_target", fdp(F.col("n_target"), F.col("n_entrapment"), ratio)["combined"].alias("fdp"))


def curve(per_sample: DataFrame, value: str = "fdp") -> DataFrame:
    """median, mean and 90th percentile (the element at int(0.9 n)) over samples for each q."""
    values = F.array_sort(F.collect_list(value))  # one value for each sample
    return per_sample.groupBy("q").agg(F.median(value).alias("median"), F.avg(value).alias("mean"), values.alias("v")).select("q", "median", "mean", F.element_at("v", F.floor(F.size("v") * 0.9).cast("int") + 1).alias("p90"))


def outliers(df: DataFrame, value: str, z: float = 2.0) -> DataFrame:
    """Rows above mean + z standard deviations (n - 1)."""
    limits = df.agg((F.avg(value) + z * F.stddev_samp(value)).alias("__limit"))
    return df.crossJoin(F.broadcast(limits)).where(F.col(value) > F.col("__limit")).drop("__limit")


def tune(df: DataFrame, q: str, length: str, score: str, trap: Column, qs, lengths, scores) -> DataFrame:
    """Target and entrapment counts under each combination of limits, in one pass with conditional counts."""
    cells = [F.struct(F.lit(float(a)).alias("q"), F.lit(int(b)).alias("length"), F.lit(float(c)).alias("score"), F.count_if((F.col(q) <= a) & (F.col(length) >= b) & (F.col(score) >= c) & ~trap).alias("n_target"), F.count_if((F.col(q) <= a) & (F.col(length) >= b) & (F.col(score) >= c) & trap).alias("n_entrapment")) for a in qs for b in lengths for c in scores]
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def conserved(peptides: DataFrame, hits: DataFrame, most: int = 5) -> DataFrame:
    """Peptides found in other sequences: number of proteins and the first ones by name. hits: peptide, protein."""
    ranked = hits.select("peptide", "protein").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("peptide").orderBy("protein")))
    found = ranked.groupBy("peptide").agg(F.count(F.lit(1)).alias("n_proteins"), F.array_sort(F.collect_list(F.when(F.col("rn") <= most, F.col("protein")))).alias("proteins"))
    return peptides.join(found, "peptide")


def decoys(sequences: DataFrame, accession: str = "accession", sequence: str = "sequence", prefix: str = "rev_") -> DataFrame:
    """The sequences and their reversals."""
    return sequences.unionByName(sequences.withColumns({accession: F.concat(F.lit(prefix), F.col(accession)), sequence: F.reverse(sequence)}))


def shuffle_keeping(sequence: str, seed: str, keep: str = "KR") -> str:
    """Shuffles residues but those to keep, which stay in place; the seed makes each record independent of the others."""
    rng = random.Random(seed)
    free = [c for c in sequence if c not in keep]
    rng.shuffle(free)
    rest = iter(free)
    return "".join(c if c in keep else next(rest) for c in sequence)
