"""Evidence networks, molecular gates and shared-peptide classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators.contaminants import marked


def edge_table(edges: DataFrame, left: str, right: str, sample: str) -> DataFrame:
    """Distinct edges with the number of acquisitions each is seen in and an id from its content."""
    got = edges.groupBy(left, right).agg(F.count_distinct(sample).alias("n_acquisitions"))
    return got.withColumn("edge_id", F.substring(F.sha2(F.concat_ws("|", F.col(left).cast("string"), F.col(right).cast("string")), 256), 1, 16))


def node_table(edges: DataFrame, left: str, right: str, sample: str) -> DataFrame:
    """Nodes of both kinds with degree and number of acquisitions."""
    def side(kind: str, own: str, other: str) -> DataFrame:
        return edges.groupBy(F.col(own).cast("string").alias("node")).agg(F.count_distinct(other).alias("degree"), F.count_distinct(sample).alias("n_acquisitions")).withColumn("kind", F.lit(kind))

    return side(left, left, right).unionByName(side(right, right, left))


def gate(df: DataFrame, tests: dict[str, Column], every: bool = False) -> DataFrame:
    """Rows that pass any (or every) test, with the names of those passed, sorted."""
    passed = F.array_sort(F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull()))
    return df.withColumn("passed", passed).where(F.size("passed") >= (len(tests) if every else 1))


def combine_origins(origins: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Union of several sources by key: greatest value and the sorted list of origins."""
    every = None
    for name, df in sorted(origins.items()):
        own = df.select(key, F.col(value), F.lit(name).alias("origin"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy(key).agg(F.max(value).alias(value), F.array_sort(F.collect_set("origin")).alias("origins"))


def active_terms(genes: DataFrame, compounds: DataFrame, links: DataFrame) -> DataFrame:
    """genes: gene, terms. compounds: compound, amount. links: compound, term. Genes with a term of an active compound."""
    active = links.join(compounds.where("amount > 0"), "compound").select("term").distinct()
    return genes.select("gene", F.explode("terms").alias("term")).join(active, "term", "left_semi").select("gene").distinct()


def shared_peptides(rescued: DataFrame, members: DataFrame, sequences: DataFrame, share: float = 0.8) -> DataFrame:
    """rescued: peptide, representative. members: representative, member. sequences: member, sequence.

    A peptide is shared if it stands in at least `share` of the members that have a sequence.
    """
    joined = rescued.join(members, "representative").join(sequences, "member", "left")
    got = joined.groupBy("peptide", "representative").agg(F.count("sequence").alias("n_resolved"), F.count_if(F.contains("sequence", "peptide")).alias("n_hits"))
    return got.withColumn("is_shared", F.coalesce(F.try_divide("n_hits", "n_resolved") >= share, F.lit(False)))


def admissions(selected: DataFrame, edges: DataFrame, scores: DataFrame, contaminants: DataFrame, rescued: DataFrame | None = None, strategy: str = "razor", most: int = 20) -> DataFrame:
    """A record for each selected protein: its first `most` peptides and their scores, mean and best score, admission.

    selected: protein. edges: peptide, protein. scores: peptide, score (0.5 where missing). rescued: protein.
    """
    joined = selected.select("protein").distinct().join(edges, "protein", "left").join(scores, "peptide", "left")
    score = F.when(F.col("peptide").isNotNull(), F.coalesce("score", F.lit(0.5)))
    own = joined.groupBy("protein").agg(F.count("peptide").alias("n_peptides"), F.array_sort(F.collect_set(F.when(F.col("peptide").isNotNull(), F.struct("peptide", score.alias("score"))))).alias("p"), F.round(F.avg(score), 4).alias("mean_score"), F.round(F.max(score), 4).alias("best_score"))
    first = F.slice("p", 1, most)
    made = own.select("protein", "n_peptides", F.transform(first, lambda x: x["peptide"]).alias("peptides"), (F.col("n_peptides") > most).alias("peptides_truncated"), F.transform(first, lambda x: x["score"]).alias("scores"), "mean_score", "best_score", F.lit(strategy).alias("strategy"))
    made = marked(made, F.col("protein").cast("string"), contaminants)
    if rescued is None:
        return made.withColumn("admission", F.lit("exact"))
    known = rescued.select("protein").distinct().withColumn("__r", F.lit(True))
    return made.join(known, "protein", "left").withColumn("admission", F.when(F.col("__r"), "kmer_rescue").otherwise("exact")).drop("__r")


def admission_summary(records: DataFrame) -> DataFrame:
    n = F.col("n_peptides")
    return records.agg(F.count(F.lit(1)).alias("n_proteins"), F.count_if(F.col("admission") == "kmer_rescue").alias("n_kmer_rescued"), F.count_if("contaminant").alias("n_contaminant"), F.median(n).alias("median_peptides_per_protein"), F.round(F.avg("best_score"), 4).alias("mean_best_score"), F.count_if(n == 1).alias("proteins_with_1_peptide"), F.count_if(n >= 2).alias("proteins_with_2plus_peptides"))


def view(edges: DataFrame, degrees: DataFrame, max_nodes: int = 150, max_edges: int = 300) -> DataFrame:
    """A bounded view: edges by descending degree of their peptide, peptide, assigned first, protein, under both caps.

    edges: peptide, protein, assigned. degrees: peptide, degree. The walk is the driver's, over rows that Spark sorts:
    it reads about as many as the caps allow. Once no two new nodes fit, Spark sends edges of known nodes only.
    """
    ordered = edges.join(degrees, "peptide").select("peptide", "protein", "assigned", "degree").orderBy(F.desc("degree"), "peptide", F.desc("assigned"), "protein")
    seen, chosen, taken = set(), [], set()

    def walk(rows, full: int) -> None:
        for row in rows:
            if len(chosen) == max_edges or len(seen) > full:
                return
            ends = {("peptide", row.peptide), ("protein", row.protein)}
            if (row.peptide, row.protein) not in taken and len(seen | ends) <= max_nodes:
                seen.update(ends)
                taken.add((row.peptide, row.protein))
                chosen.append(tuple(row))

    walk(ordered.toLocalIterator(), max_nodes - 2)
    if len(chosen) < max_edges and seen:
        names = {kind: [n for k, n in seen if k == kind] for kind in ("peptide", "protein")}
        walk(ordered.where(F.col("peptide").isin(names["peptide"]) | F.col("protein").isin(names["protein"])).toLocalIterator(), max_nodes)
    return edges.sparkSession.createDataFrame(chosen, ordered.schema)


def reconciled(peptides: DataFrame, evidence: DataFrame) -> DataFrame:
    """peptides: peptide, group, declared (its degree). evidence: sample, peptide, protein. The peptides that disagree.

    problem: no_evidence, degree (another number of proteins than declared), representative (not among the proteins).
    """
    seen = evidence.groupBy("peptide").agg(F.count_distinct("protein").alias("degree"))
    pairs = evidence.select("peptide", F.col("protein").alias("group")).distinct().withColumn("__m", F.lit(True))
    joined = peptides.join(seen, "peptide", "left").join(pairs, ["peptide", "group"], "left")
    problem = F.when(F.col("degree").isNull(), "no_evidence").when(F.col("degree") != F.col("declared"), "degree").when(F.col("__m").isNull(), "representative")
    return joined.select("peptide", problem.alias("problem")).where("problem is not null")
