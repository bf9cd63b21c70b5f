"""Ordered quality filters of sequences: the first that rejects a sequence gives the reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions import sequence as S

REASONS = ("noncanonical", "length", "poly_run", "low_complexity", "fragment")


@dataclass(frozen=True)
class Filters:
    """Limits; None leaves a filter out. noncanonical: greatest share of letters that are no residues, before any
    change. clean: ambiguous residues become X. poly_run: shortest run of one residue. entropy: least normalised
    entropy. fragment: a sequence without M in front needs so many residues."""

    noncanonical: float | None = None
    clean: bool = False
    shortest: int = 1
    longest: int = 1_000_000_000
    poly_run: int | None = None
    entropy: float | None = None
    fragment: int | None = None


def filtered(df: DataFrame, filters: Filters, sequence: str = "sequence") -> DataFrame:
    """All rows, with `cleaned` (upper case, with X for ambiguous residues if asked for), `n_replaced`, `reason` (null
    for those that pass) and `detail`. A null sequence is empty."""
    raw = F.upper(F.coalesce(F.col(sequence), F.lit("")))
    own = df.withColumn("__raw", raw)
    share = S.noncanonical_fraction("__raw")
    cleaned = S.normalise_residues("__raw").sequence if filters.clean else F.col("__raw")
    own = own.withColumn("cleaned", cleaned)
    replaced = S.normalise_residues("__raw").replaced if filters.clean else F.lit(0)
    n = F.length("cleaned")
    percent = lambda c: F.format_string("%.2f%%", c * 100)
    tests = []
    if filters.noncanonical is not None:
        tests.append((F.coalesce(share > filters.noncanonical, F.lit(False)), "noncanonical", F.concat(F.lit("noncanonical:frac="), percent(share), F.lit(">"), percent(F.lit(filters.noncanonical)))))
    tests.append((n < filters.shortest, "length", F.concat(F.lit("too_short:"), n, F.lit(f"<{filters.shortest}"))))
    tests.append((n > filters.longest, "length", F.concat(F.lit("too_long:"), n, F.lit(f">{filters.longest}"))))
    if filters.poly_run is not None:
        tests.append((S.has_poly_run("cleaned", filters.poly_run), "poly_run", F.lit(f"poly_run:>={filters.poly_run}")))
    if filters.entropy is not None:
        own = own.withColumn("__entropy", S.sequence_entropy("cleaned"))
        entropy = F.col("__entropy")
        tests.append((entropy < filters.entropy, "low_complexity", F.concat(F.lit("low_complexity:entropy="), F.format_string("%.3f", entropy), F.lit(f"<{filters.entropy}"))))
    if filters.fragment is not None:
        tests.append((S.is_fragment("cleaned", filters.fragment), "fragment", F.concat(F.lit("fragment:no_M_start,len="), n, F.lit(f"<{filters.fragment}"))))
    verdict = F.lit(None).cast("struct<reason: string, detail: string>")
    for failed, reason, detail in reversed(tests):  # the first test stands outermost
        verdict = F.when(failed, F.struct(F.lit(reason).alias("reason"), detail.cast("string").alias("detail"))).otherwise(verdict)
    made = own.withColumn("__v", verdict).withColumn("n_replaced", F.when(F.col("__v.reason") == "noncanonical", 0).otherwise(replaced))
    return made.withColumns({"reason": F.col("__v.reason"), "detail": F.col("__v.detail")}).drop("__raw", "__v", "__entropy")


def report(rows: DataFrame) -> DataFrame:
    """rows: those of `filtered`. One row: total_input, passed, residues_normalised and a count of each reason."""
    return rows.agg(F.count(F.lit(1)).alias("total_input"), F.count_if(F.col("reason").isNull()).alias("passed"), F.coalesce(F.sum("n_replaced"), F.lit(0)).cast("bigint").alias("residues_normalised"), *[F.count_if(F.col("reason") == r).alias(f"rejected_{r}") for r in REASONS])
