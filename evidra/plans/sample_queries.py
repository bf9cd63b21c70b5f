"""Queries on samples, look-ups, sets and generators; roles as in evidence_queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import sequence as S
from evidra.operators import massindex, matching, samples
from evidra.plans import rescue_queries
from evidra.plans.evidence_queries import PATTERNS, SEQ, places_sql, sequences, substring_join, table, whole_windows
from evidra.sources import sinks

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


@query("intensity_distribution", """
SELECT l_suppkey, count(*) FILTER (l_quantity - 5 > 0) AS n_measured, count(*) FILTER (l_quantity - 5 <= 0) AS n_missing,
round(quantile_cont(CASE WHEN l_quantity > 5 THEN log2(l_quantity - 5) END, 0.25), 8) AS q25, round(quantile_cont(CASE WHEN l_quantity > 5 THEN log2(l_quantity - 5) END, 0.5), 8) AS q50, round(quantile_cont(CASE WHEN l_quantity > 5 THEN log2(l_quantity - 5) END, 0.75), 8) AS q75
FROM lineitem GROUP BY l_suppkey""")
def intensity_distribution(spark, sf):
    got = samples.intensity_distribution(table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_quantity") - 5).alias("v")), "l_suppkey", "v")
    return got.select("l_suppkey", "n_measured", "n_missing", *[F.round(c, 8).alias(c) for c in ("q25", "q50", "q75")])


@query("two_stage_lookup", """
WITH t AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS a, p_partkey AS b, p_type AS v FROM part)
SELECT l_partkey AS a, l_partkey + 1 AS b, coalesce(x.v, y.v) AS v, count(*) AS n FROM lineitem LEFT JOIN t x ON x.a = l_partkey LEFT JOIN t y ON y.b = l_partkey + 1 GROUP BY ALL""")
def two_stage_lookup(spark, sf):
    t = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("a"), F.col("p_partkey").alias("b"), F.col("p_type").alias("v"))
    left = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_partkey") + 1).alias("b"))
    return samples.two_stage(left, t, "a", "b", "v").groupBy("a", "b", "v").agg(F.count(F.lit(1)).alias("n"))


@query("sample_complexity", """
WITH r AS (SELECT l_suppkey, avg(CASE WHEN l_discount <= 0.05 THEN 1 ELSE 0 END) AS hit_rate FROM lineitem GROUP BY 1),
c AS (SELECT l_suppkey, l_partkey % 25 AS species, count(*) AS n FROM lineitem WHERE l_discount <= 0.05 GROUP BY ALL),
o AS (SELECT l_suppkey, count(*) AS richness, max(n) / sum(n) AS dominance FROM c GROUP BY 1)
SELECT l_suppkey, round(hit_rate, 8) AS hit_rate, richness, round(dominance, 8) AS dominance, CASE WHEN hit_rate < 0.1 THEN 'low coverage' WHEN dominance > 0.5 THEN 'dominated' ELSE 'diverse' END AS advice FROM r LEFT JOIN o USING (l_suppkey)""")
def sample_complexity(spark, sf):
    own = table(spark, sf, "lineitem").select("l_suppkey", "l_discount", (F.col("l_partkey") % 25).alias("species"))
    got = samples.complexity(own, "l_suppkey", F.col("l_discount") <= 0.05, "species")
    return got.select("l_suppkey", F.round("hit_rate", 8).alias("hit_rate"), "richness", F.round("dominance", 8).alias("dominance"), "advice")


@query("gene_quantities", """
WITH m AS (SELECT l_suppkey, l_orderkey, l_partkey, max(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_partkey, count(*) AS n_peptides, sum(v) AS quantity FROM m GROUP BY ALL""")
def gene_quantities(spark, sf):
    return samples.gene_quantities(table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_quantity"), "l_suppkey", "l_orderkey", "l_partkey", "l_quantity")


@query("lookup_misses", """
SELECT count(*) AS n, count(*) FILTER (o_orderkey IS NULL) AS no_order, count(*) FILTER (o_orderkey IS NOT NULL AND c_custkey IS NULL) AS no_customer
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'O') ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def lookup_misses(spark, sf):
    orders, customers = table(spark, sf, "orders").where("o_orderstatus <> 'O'").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey")
    joined = table(spark, sf, "lineitem").select("l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return samples.hops(joined, ("no_order", F.col("o_orderkey").isNull()), ("no_customer", F.col("o_orderkey").isNotNull() & F.col("c_custkey").isNull()))


@query("halves", "SELECT CAST(('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8))::BIGINT % 2 AS INTEGER) AS half, count(*) AS n FROM part GROUP BY 1")
def halves(spark, sf):
    return samples.halves(table(spark, sf, "part").select("p_partkey"), "p_partkey").groupBy("half").agg(F.count(F.lit(1)).alias("n"))


@query("hash_table", f"WITH {SEQ} SELECT sha256(sequence) AS sha256, doc_id, CAST(length(sequence) AS INTEGER) AS length FROM s")
def hash_table(spark, sf):
    return sinks.hash_table(sequences(spark, sf).select("doc_id", "sequence"), "doc_id")


@query("sequence_aliases", f"WITH {SEQ} SELECT 'SEQ_' || sha256(sequence) AS alias, count(*) AS n, min(doc_id) AS first_id FROM s GROUP BY 1")
def sequence_aliases(spark, sf):
    return sequences(spark, sf).groupBy(F.concat(F.lit("SEQ_"), F.sha2("sequence", 256)).alias("alias")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("match_counts", """
SELECT CASE WHEN l_returnflag = 'R' THEN 'decoy' WHEN l_returnflag = 'A' THEN 'entrapment' ELSE 'target' END AS kind, count(*) AS n, count(DISTINCT l_orderkey) AS n_peptides FROM lineitem WHERE coalesce(l_discount, 1.0) <= 0.05 GROUP BY 1""")
def match_counts(spark, sf):
    kind = F.when(F.col("l_returnflag") == "R", "decoy").when(F.col("l_returnflag") == "A", "entrapment").otherwise("target")
    return table(spark, sf, "lineitem").where(F.coalesce("l_discount", F.lit(1.0)) <= 0.05).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("n_peptides"))


@query("unmatched_patterns", f"WITH {SEQ}, {PATTERNS}, {places_sql(12)} SELECT peptide FROM d WHERE peptide NOT IN (SELECT peptide FROM x)")
def unmatched_patterns(spark, sf):
    patterns = whole_windows(spark, sf, 12).select("peptide").distinct()
    return patterns.join(substring_join(spark, sf), "peptide", "left_anti")


@query("catalogue_counts", """
WITH i AS (SELECT CASE page_id % 4 WHEN 0 THEN 'sp|P1|A_HUMAN' WHEN 1 THEN 'MGYG000000001_1' WHEN 2 THEN 'GMGC10.1' ELSE 'other' END AS i FROM pages)
SELECT CASE WHEN starts_with(i, 'sp|') THEN 'Human' WHEN starts_with(i, 'MGYG') THEN 'UHGG' WHEN starts_with(i, 'GMGC') THEN 'GMGC' ELSE 'smORF' END AS catalogue, count(*) AS n FROM i GROUP BY 1""")
def catalogue_counts(spark, sf):
    k = F.col("page_id") % 4
    made = F.when(k == 0, "sp|P1|A_HUMAN").when(k == 1, "MGYG000000001_1").when(k == 2, "GMGC10.1").otherwise("other")
    return table(spark, sf, "pages").groupBy(S.catalogue(made).alias("catalogue")).agg(F.count(F.lit(1)).alias("n"))


@query("mass_votes", rescue_queries.window_votes_sql(12, 3))
def mass_votes(spark, sf):
    """Asks with all windows of 12 residues of whole texts."""
    letters = table(spark, sf, "benchmark").select(F.col("item_id").alias("target"), F.regexp_replace(S.normalize_sequence("text"), "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("sequence"))
    pieces = letters.select("target", F.posexplode(S.windows("sequence", 12)).alias("k", "sequence")).where("length(sequence) = 12")
    queries = pieces.select(F.concat_ws("/", F.col("target").cast("string"), F.col("k").cast("string")).alias("query"), "sequence")
    got = matching.mass_vote_join(queries.withColumn("mass", S.residue_mass("sequence") + massindex.WATER), letters, least=3)
    return got.withColumn("error_ppm", F.round("error_ppm", 6))


@query("shuffled_copies")
def shuffled_copies(spark, sf):
    own = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("accession"), S.normalize_sequence("text").alias("sequence"))
    return samples.shuffled(own)
