"""Gates, matrices and ambiguity of a study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.sequence import canonical_peptide
from evidra.operators import graph
from evidra.operators.lineage import cut


def accepted(df: DataFrame, q: str, threshold: float) -> Column:
    """Finite, from 0 to the threshold, both included."""
    return F.col(q).between(0, threshold) & ~F.isnan(F.col(q).cast("double"))


def group_matrix(df: DataFrame, keys: list[str], q: str, threshold: float, value: str) -> DataFrame:
    """Sums of positive values by key; the gate stands before the sum, so no row can admit another."""
    return df.where(accepted(df, q, threshold) & (F.col(value) > 0)).groupBy(*keys).agg(F.sum(value).alias("value"))


def quantify(df: DataFrame, sample: str, group: str, peptide: str, value: str) -> DataFrame:
    """n_peptides, n_features and intensity for each sample and group."""
    return df.groupBy(sample, group).agg(F.count_distinct(peptide).alias("n_peptides"), F.count(F.lit(1)).alias("n_features"), F.sum(value).alias("intensity"))


def wide(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A matrix with the given columns; missing stays null."""
    return df.groupBy(row).pivot(column, columns).agg(F.sum(value))


def ambiguity(edges: DataFrame) -> DataFrame:
    """How many peptides have how many proteins."""
    return edges.groupBy("peptide").agg(F.count(F.lit(1)).alias("n_proteins")).groupBy("n_proteins").agg(F.count(F.lit(1)).alias("n_peptides"))


def cross_sample(df: DataFrame, feature: str, value: str, samples: int) -> DataFrame:
    """Completeness, mean, coefficient of variation (n - 1, from two samples on) of each feature over samples."""
    got = df.groupBy(feature).agg(F.count(F.lit(1)).alias("n_samples"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return got.select(feature, "n_samples", (F.col("n_samples") / samples).alias("completeness"), "mean", F.when(F.col("n_samples") >= 2, F.try_divide("sd", "mean")).alias("cv"))


def cross_sample_summary(df: DataFrame, sample: str, feature: str, value: str, samples: int | None = None) -> DataFrame:
    """One row over a matrix in long form: n_samples, n_features, completeness_pct, median_cv_pct, features_in_all_samples,
    features_in_one_sample.

    Only values above 0 are measured; features without any count as features. The median of the coefficients (n - 1,
    features of two samples or more) is the upper one of an even number, 0 without any. `samples` counts samples
    without rows as well. Ranks are by range, so that no task sorts all features.
    """
    from evidra.operators.graph import in_order
    from evidra.operators.lineage import cut

    measured = F.when(F.col(value) > 0, F.col(value))
    own = cut(df.groupBy(feature).agg(F.count(measured).alias("k"), F.avg(measured).alias("mean"), F.stddev_samp(measured).alias("sd")).withColumn("cv", F.when(F.col("k") >= 2, F.col("sd") / F.col("mean") * 100)))
    n = samples if samples is not None else df.select(sample).distinct().count()
    ordered = cut(in_order(own.where("cv is not null").select("cv"), ["cv"], "place"))
    middle = ordered.where(F.col("place") == ordered.count() // 2).agg(F.coalesce(F.max("cv"), F.lit(0.0)).alias("median_cv_pct"))
    made = own.agg(F.lit(n).cast("bigint").alias("n_samples"), F.count(F.lit(1)).alias("n_features"), (F.coalesce(F.sum("k"), F.lit(0)) * 100.0 / F.greatest(F.lit(1), F.count(F.lit(1)) * n)).alias("completeness_pct"), F.count_if(F.col("k") == n).alias("features_in_all_samples"), F.count_if(F.col("k") == 1).alias("features_in_one_sample"))
    return made.crossJoin(F.broadcast(middle)).select("n_samples", "n_features", "completeness_pct", "median_cv_pct", "features_in_all_samples", "features_in_one_sample")  # one row


def search_q(psms: DataFrame) -> DataFrame:
    """Least peptide and protein q of each target peptide."""
    return psms.where("label = 1").groupBy("peptide").agg(F.min("peptide_q").alias("peptide_q"), F.min("protein_q").alias("protein_q"))


def replicate_cv(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per cent of variation of each set of replicates."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.try_divide(F.stddev_samp(value), F.avg(value)) * 100).alias("cv_percent"))


def running(df: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    """Adds the sum of `amount` up to each row in order of `key`, which is unique; no task sees more than its range.

    Ranges are sums of their own first; a window over one row for each range gives the bases.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, key).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.sum(amount).alias("__s"))
    base = sizes.withColumn("__base", F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    own = F.sum(amount).over(Window.partitionBy("__part").orderBy(key))
    return dealt.join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + own)


def step_up(df: DataFrame, p: str) -> DataFrame:
    """Benjamini-Hochberg: adds `adjusted`. Ranks come from counts of distinct values by range; the minimum from the
    largest value on is taken within ranges, and then over one row for each range. Rows are joined back by their value, so
    values are written first: a sum that is formed twice may differ in its last place."""
    df = cut(df)
    counts = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("__n"))
    total = df.where(F.col(p).isNotNull()).count()
    ranked = running(counts, p, "__n", "__rank").withColumn("__raw", F.least(F.lit(1.0), F.col(p) * total / F.col("__rank")))
    after = ranked.groupBy("__part").agg(F.min("__raw").alias("__m"))
    later = after.withColumn("__later", F.min("__m").over(Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1))).drop("__m")
    own = F.min("__raw").over(Window.partitionBy("__part").orderBy(F.desc(p)))
    made = ranked.join(F.broadcast(later), "__part").withColumn("adjusted", F.least(own, F.coalesce("__later", F.lit(1.0))))
    return df.join(made.select(p, "adjusted"), p)


def accepted_evidence(psms: DataFrame, threshold: float = 0.01, decoy: str = "rev_") -> DataFrame:
    """psms: sample, peptide (modified), proteins (array), label, rank, peptide_q. sample, peptide (canonical), protein.

    First-rank targets at or under the threshold; decoys among the proteins are left out.
    """
    own = psms.where((F.col("rank") == 1) & (F.col("label") == 1) & accepted(psms, "peptide_q", threshold))
    own = own.select("sample", canonical_peptide("peptide").alias("peptide"), F.filter("proteins", lambda x: (x != "") & ~x.startswith(decoy)).alias("p")).where("peptide <> ''")
    return own.select("sample", "peptide", F.explode("p").alias("protein")).distinct()


def gated(features: DataFrame, evidence: DataFrame) -> DataFrame:
    """Features whose (sample, canonical peptide) is accepted and whose intensity is finite and positive."""
    value = F.col("intensity")
    own = features.withColumn("canonical", canonical_peptide("peptide")).where((value > 0) & (value < float("inf")) & ~F.isnan(value))
    keys = evidence.select("sample", F.col("peptide").alias("canonical")).distinct()
    return own.join(keys, ["sample", "canonical"], "left_semi")


def unique_features(features: DataFrame) -> DataFrame:
    """The features; an error if a sample has a (peptide, charge) twice."""
    counted = features.groupBy("sample", "peptide", "charge").agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*[c for c in features.columns if c not in ("sample", "peptide", "charge")])).alias("__r"))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate feature "), F.col("peptide"))).cast("string")).otherwise(F.col("peptide"))
    return counted.withColumn("peptide", checked).select("sample", "peptide", "charge", "__r.*")


def ledger(features: DataFrame, dictionary: DataFrame, searched: DataFrame) -> DataFrame:
    """Gated features with their group: adds study_group, member_set, in_local_fasta and in_local_members.

    dictionary: peptide, protein. searched: sample, protein.
    """
    groups = dictionary.select(F.col("peptide").alias("canonical"), F.col("protein").alias("study_group"))
    local = searched.select("sample", F.col("protein").alias("study_group")).distinct().withColumn("__local", F.lit(True))
    joined = features.join(groups, "canonical").join(local, ["sample", "study_group"], "left")
    members = F.array_sort(F.array_distinct("proteins"))
    return joined.select("sample", "peptide", "canonical", "charge", F.array_join(members, ";").alias("member_set"), "study_group", F.coalesce("__local", F.lit(False)).alias("in_local_fasta"), F.array_contains("proteins", F.col("study_group")).alias("in_local_members"), "intensity")


def balanced(before: DataFrame, after: DataFrame, amount: str = "intensity", relative: float = 1e-10) -> DataFrame:
    """intensity_in and intensity_out; an error if they differ by more than `relative`."""
    a, b = before.agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias("intensity_in")), after.agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias("intensity_out"))
    both = a.crossJoin(b)  # one row each
    off = F.abs(F.col("intensity_in") - F.col("intensity_out")) > F.greatest(relative * F.greatest("intensity_in", "intensity_out"), F.lit(1e-6))
    return both.withColumn("intensity_out", F.when(off, F.raise_error(F.lit("intensity mass balance failed")).cast("double")).otherwise(F.col("intensity_out")))


def compose(psms: DataFrame, features: DataFrame, searched: DataFrame, threshold: float = 0.01) -> dict[str, DataFrame]:
    """A study from searches: study_groups, dictionary, ledger, long, acquisitions, ambiguity, evidence, balance.

    psms and features as in accepted_evidence and gated (proteins as an array, charge); searched: sample, protein.
    Proteins outside what was searched are an error.
    """
    evidence = cut(accepted_evidence(psms, threshold))
    edges = graph.outside(evidence.select("peptide", "protein").distinct(), searched)
    edges = cut(edges)
    selected = cut(graph.set_cover(edges))
    assigned = cut(graph.dictionary(edges, selected))
    rows = cut(ledger(gated(unique_features(features), evidence), assigned, searched))
    long = quantify(rows, "sample", "study_group", "canonical", "intensity")
    support = edges.groupBy("protein").agg(F.count(F.lit(1)).alias("observed_support_peptides"))
    sizes = assigned.groupBy("protein").agg(F.count(F.lit(1)).alias("assigned_peptides"))
    groups = selected.join(support, "protein").join(sizes, "protein", "left").select(F.col("protein").alias("study_group"), (F.col("selection_rank") - 1).alias("selection_rank"), "observed_support_peptides", F.coalesce("assigned_peptides", F.lit(0)).alias("assigned_peptides"))
    members = evidence.groupBy("sample", "peptide").agg(F.array_join(F.array_sort(F.collect_set("protein")), ";").alias("reported_proteins"), F.count_distinct("protein").alias("n_reported_proteins_sample"))
    degree = edges.groupBy("peptide").agg(F.count(F.lit(1)).alias("n_reported_proteins_study"))
    acquisitions = rows.groupBy("sample").agg(F.count_distinct("study_group").alias("quantified_study_groups"), F.count_distinct("canonical").alias("canonical_peptides"), F.count(F.lit(1)).alias("lfq_features"), F.sum("intensity").alias("intensity"))
    return {
        "study_groups": groups, "dictionary": assigned, "ledger": rows, "long": long, "acquisitions": acquisitions, "ambiguity": ambiguity(edges),
        "evidence": members.join(assigned, "peptide").join(degree, "peptide").withColumnRenamed("protein", "study_group"), "balance": balanced(rows, long),
    }
