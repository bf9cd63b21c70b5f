"""Search arms: accepted rows and rejected rows with reasons in one pass, each row exactly once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.lineage import cut

#: Reasons that are faults of the input, not choices of the gate; strict loading refuses them.
FAULTS = ("other_acquisition", "malformed", "invalid_q", "invalid_peptide", "unknown_accession", "decoy_accession", "not_contained", "invalid_intensity", "invalid_charge", "repeated_feature")


def canonical(peptide: Column) -> Column:
    """Bracketed modifications and dashes taken out, upper case, I as L; null if other than letters are left."""
    bare = F.upper(F.replace(F.regexp_replace(peptide, r"\[[^\[\]]*\]", ""), F.lit("-"), F.lit("")))
    return F.when(bare.rlike("^[A-Z]+$"), F.translate(bare, "I", "L"))


@dataclass(frozen=True)
class Arm:
    """psms and features: their rows with `reason` (null: accepted). support: seq_hash, peptide, unique (the peptide's
    row names this sequence only). peptides: peptide. aliases: seq_hash, accessions. charge_mode: combined, separate
    or null without features."""

    psms: DataFrame
    features: DataFrame
    support: DataFrame
    peptides: DataFrame
    aliases: DataFrame
    charge_mode: str | None


def _judged(rows: DataFrame, known: DataFrame, decoy: str) -> DataFrame:
    """Adds hashes of the reported accessions' sequences, and the fault of the worst one as reason of rows without one.

    known: accession, records (folded, seq_hash). Rows that name one accession meet it as they are, and rejected rows
    move nowhere; only rows of several accessions are numbered, taken apart and put together again.
    """
    missing = F.transform("records", lambda r: F.when(~F.contains(r["folded"], F.col("canonical")), 3))
    fault = F.when(F.startswith("accession", F.lit(decoy)), 1).when(F.col("records").isNull(), 2).otherwise(F.array_min(missing))
    hashes = F.coalesce(F.array_distinct(F.transform("records", lambda r: r["seq_hash"])), F.array().cast("array<string>"))
    asked, several = rows.where("reason is null"), F.contains("proteins", F.lit(";"))
    one = asked.where(~several).withColumn("accession", F.col("proteins")).join(known, "accession", "left").select(*rows.columns, fault.alias("fault"), hashes.alias("hashes"))
    numbered = cut(asked.where(several).withColumn("__id", F.monotonically_increasing_id()))
    each = numbered.select("__id", "canonical", F.explode(F.split("proteins", ";")).alias("accession")).join(known, "accession", "left").select("__id", fault.alias("fault"), hashes.alias("hashes"))
    members = each.groupBy("__id").agg(F.min("fault").alias("fault"), F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("hashes"))  # the members of one row
    judged = one.unionByName(numbered.join(members, "__id").drop("__id")).withColumn("reason", _fault()).drop("fault")
    return rows.where("reason is not null").withColumn("hashes", F.lit(None).cast("array<string>")).unionByName(judged)


def _fault() -> Column:
    return F.when(F.col("fault") == 1, "decoy_accession").when(F.col("fault") == 2, "unknown_accession").when(F.col("fault") == 3, "not_contained")


def _share(column: str) -> Column:
    """Null unless a number from 0 to 1."""
    value = F.col(column).try_cast("double")
    return F.when(value.between(0, 1), value)


def load_arm(psms: DataFrame, features: DataFrame, records: DataFrame, acquisition: str, q: float, protein_q: float | None = None, decoy: str = "rev_", strict: bool = True) -> Arm:
    """psms: peptide, proteins (`;` list), label, peptide_q, filename, and protein_q if a limit for it is given.
    features: peptide, charge, proteins, intensity (text or number). records: accession, sequence.

    A row of another acquisition, a q outside 0 to 1, an accepted target whose accession is unknown or a decoy or
    whose sequence lacks the peptide, a repeated (peptidoform, charge) and a charge other than -1 or above 0 are
    faults: errors if strict, else reasons of rejected rows. Decoys and rows above a limit are rejected by the gate.
    Features of peptides that are not accepted, without intensity or with none above 0 are rejected with their reason.
    Accepted features that mix combined (-1) and separate charges are always an error. Nulls in a row are faults.
    """
    own = records.select("accession", F.translate("sequence", "I", "L").alias("folded"), F.sha2("sequence", 256).alias("seq_hash"))
    known = cut(own.groupBy("accession").agg(F.collect_list(F.struct("folded", "seq_hash")).alias("records")))  # one record as a rule
    name = F.element_at(F.split(F.replace("filename", F.lit("\\"), F.lit("/")), "/"), -1)
    rows = psms.withColumn("canonical", canonical(F.col("peptide")))
    missing = F.col("peptide").isNull() | F.col("proteins").isNull() | F.col("filename").isNull() | F.col("label").isNull()
    reason = F.when(missing, "malformed").when(name != acquisition, "other_acquisition").when(F.col("label").try_cast("int").isNull(), "malformed").when(F.col("label").try_cast("int") != 1, "not_target").when(_share("peptide_q").isNull(), "invalid_q").when(_share("peptide_q") > q, "above_q")
    if protein_q is not None:
        reason = reason.when(_share("protein_q").isNull(), "invalid_q").when(_share("protein_q") > protein_q, "above_protein_q")
    rows = rows.withColumn("reason", reason.when(F.col("canonical").isNull(), "invalid_peptide"))
    rows = cut(_judged(rows, known, decoy))
    good = rows.where("reason is null")
    peptides = cut(good.select(F.col("canonical").alias("peptide")).distinct())
    each = good.select(F.col("canonical").alias("peptide"), (F.size("hashes") == 1).alias("one"), F.explode("hashes").alias("seq_hash"))
    support = each.groupBy("seq_hash", "peptide").agg(F.bool_or("one").alias("unique"))

    value = F.col("intensity").try_cast("double")
    text = F.lower(F.trim(F.coalesce(F.col("intensity").cast("string"), F.lit(""))))
    charge = F.col("charge").try_cast("int")
    lfq = features.withColumn("canonical", canonical(F.col("peptide")))
    lfq = lfq.join(peptides.select(F.col("peptide").alias("canonical"), F.lit(True).alias("__known")), "canonical", "left")
    reason = F.when(F.col("peptide").isNull() | F.col("proteins").isNull(), "malformed").when(F.col("canonical").isNull(), "invalid_peptide").when(F.col("__known").isNull(), "not_accepted").when(text.isin("", "na", "nan"), "missing").when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "invalid_intensity").when(value <= 0, "nonpositive").when(charge.isNull() | (charge == 0) | (charge < -1), "invalid_charge")
    lfq = _judged(cut(lfq.withColumn("reason", reason).drop("__known")), known, decoy).drop("hashes")
    # a peptidoform and charge may stand once only: which one counts can't be told
    lfq = cut(lfq)
    counted = lfq.where("reason is null").withColumn("several", F.count(F.lit(1)).over(Window.partitionBy(F.upper("peptide"), charge)) > 1)
    counted = counted.withColumn("reason", F.when(F.col("several"), "repeated_feature")).drop("several")
    lfq = cut(lfq.where("reason is not null").unionByName(counted))
    modes = lfq.where("reason is null").agg(F.count_if(charge == -1), F.count_if(charge > 0)).first()
    if modes[0] and modes[1]:
        raise ValueError("accepted features mix combined and separate charges")
    if strict:
        for rows_of in (rows, lfq):
            bad = rows_of.where(F.col("reason").isin(*FAULTS)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("peptide").alias("p")).orderBy("reason").first()
            if bad is not None:
                raise ValueError(f"{bad.n} rows with {bad.reason}, the first is {bad.p!r}")
    aliases = known.where(~F.startswith("accession", F.lit(decoy))).select("accession", F.explode("records.seq_hash").alias("seq_hash")).groupBy("seq_hash").agg(F.array_sort(F.collect_set("accession")).alias("accessions"))
    keep = lambda df, columns: df.select(*columns, "canonical", "reason")
    return Arm(keep(rows, psms.columns), keep(lfq, features.columns), support, peptides, aliases, "combined" if modes[0] else "separate" if modes[1] else None)


def conserved(rows: DataFrame) -> DataFrame:
    """reason (accepted for none) and its number of rows."""
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
