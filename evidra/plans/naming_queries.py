"""Queries on names, prefixes, search targets and coverage; parts are proteins, brands accessions, suppliers genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import naming, targets
from evidra.plans.evidence_queries import SEQ, sequences, table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def joined(column, condition="true"):
    return f"(SELECT coalesce(string_agg(v, '; ' ORDER BY first_at), '') FROM (SELECT {column} AS v, min(p_partkey) AS first_at FROM part q WHERE q.p_brand = b.p_brand AND {condition} AND {column} <> '' GROUP BY 1))"


GENE = "CASE WHEN p_size % 7 = 0 THEN p_brand ELSE 'G' || p_size END"
SOURCE = "CASE WHEN p_partkey % 3 = 0 THEN 'unknown' ELSE 'S' || (p_partkey % 3) END"


@query("described", f"""
SELECT p_brand AS accession, {joined(GENE, f"{GENE} <> p_brand")} AS gene, {joined("p_type")} AS protein_name, {joined("p_name")} AS organism, {joined(SOURCE, f"{SOURCE} <> 'unknown'")} AS source, count(DISTINCT p_name || p_type) AS n_source_headers
FROM part b GROUP BY p_brand""")
def described(spark, sf):
    own = table(spark, sf, "part")
    return naming.described(own.select(F.col("p_brand").alias("accession"), F.concat("p_name", "p_type").alias("header"), F.col("p_partkey").alias("place"), F.expr(GENE).alias("gene"), F.col("p_type").alias("protein_name"), F.col("p_name").alias("organism"), F.expr(SOURCE).alias("source")))


@query("written_headers", """
SELECT p_partkey AS part, 'sp|P' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '|' || p_brand ELSE '' END || CASE WHEN p_size % 5 = 0 THEN '' ELSE ' ' || p_type END
|| CASE WHEN p_size % 2 = 0 THEN ' OS=' || p_name WHEN p_size % 11 = 0 THEN '' ELSE ' OS=' || p_brand END || CASE WHEN p_size % 4 = 0 THEN ' OX=' || p_size WHEN p_size % 4 = 1 THEN '' ELSE ' OX=7' END
|| CASE WHEN p_size % 6 = 0 THEN '' ELSE ' GN=G' || p_size END || CASE WHEN p_size % 7 = 0 THEN '' ELSE ' PE=' || (p_size % 7) END || ' SV=1 [lake:sources=A,B;tax=' || CASE WHEN p_size % 4 IN (0, 1) THEN '-' ELSE '7,9' END || ']' AS header FROM part""")
def written_headers(spark, sf):
    own = table(spark, sf, "part").selectExpr(
        "p_partkey AS part", "'SP' AS tag", "'P' || p_partkey AS accession", "CASE WHEN p_size % 3 = 0 THEN p_brand END AS entry_name", "CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS description",
        "CASE WHEN p_size % 2 = 0 THEN p_name END AS primary_organism", "CASE WHEN p_size % 11 = 0 THEN 'ambiguous' ELSE p_brand END AS organism", "CASE WHEN p_size % 4 = 0 THEN p_size END AS primary_tax",
        "CASE WHEN p_size % 4 IN (0, 1) THEN CAST(array() AS array<int>) ELSE array(7, 9) END AS tax_ids", "CASE WHEN p_size % 6 = 0 THEN NULL ELSE 'G' || p_size END AS gene", "nullif(p_size % 7, 0) AS evidence", "1 AS version", "array('B', 'A', 'B') AS sources",
    )
    return own.select("part", naming.written_header("lake").alias("header"))


@query("host_classes", """
WITH h AS (SELECT 'P' || s_suppkey AS m, CASE WHEN s_suppkey % 10 = 0 THEN 'Mixed' ELSE 'Human' END AS c FROM supplier WHERE s_suppkey % 2 = 0),
g AS (SELECT DISTINCT l_orderkey, 'P' || l_suppkey AS m FROM lineitem), k AS (SELECT l_orderkey, string_agg(m, ';' ORDER BY m) AS protein_group, bool_or(c IS NOT NULL AND c = 'Mixed') AS mixed, bool_or(c IS NOT NULL) AS host, bool_or(c IS NULL) AS other FROM g LEFT JOIN h USING (m) GROUP BY 1)
SELECT protein_group, CASE WHEN mixed OR (host AND other) THEN 'Mixed' WHEN host THEN 'Human' ELSE 'Microbial' END AS class, count(*) AS n FROM k GROUP BY 1, 2""")
def host_classes(spark, sf):
    hosts = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").selectExpr("'P' || s_suppkey AS accession", "CASE WHEN s_suppkey % 10 = 0 THEN 'Mixed' WHEN s_suppkey % 4 = 0 THEN '' END AS class")
    groups = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("P"), F.col("l_suppkey").cast("string")))), ";").alias("protein_group"))
    return naming.classify_with_hosts(groups, hosts).groupBy("protein_group", "class").agg(F.count(F.lit(1)).alias("n"))


@query("file_names", "SELECT p_partkey AS part, regexp_replace(p_name || '/' || p_brand || '-_', '[^A-Za-z0-9_]', '_', 'g') AS level, p_brand || '.mzML' AS run FROM part")
def file_names(spark, sf):
    path = F.concat(F.lit("D:\\runs/"), "p_name", F.lit("\\"), "p_brand", F.lit(".mzML"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("part"), naming.level_file_name(F.concat("p_name", F.lit("/"), "p_brand", F.lit("-_"))).alias("level"), naming.base_name(path).alias("run"))


HEADER = "CASE WHEN p_size % 4 = 0 THEN 'ENTRAP_' || p_type || '_' || p_partkey WHEN p_size % 4 = 1 THEN 'xEntrap' || p_size WHEN p_size % 4 = 2 THEN 'ENTRAP_SHUF_' || p_partkey ELSE p_brand END || ' ' || p_name"


def headers(spark, sf):
    return table(spark, sf, "part").select(F.expr(HEADER).alias("header"))


@query("prefix_counts", f"WITH h AS (SELECT {HEADER} AS header FROM part) SELECT count(*) FILTER (NOT starts_with(header, 'ENTRAP_')) AS n_target, count(*) FILTER (starts_with(header, 'ENTRAP_')) AS n_control FROM h")
def prefix_counts(spark, sf):
    return targets.partition_counts(headers(spark, sf), "ENTRAP_")


@query("prefixes_observed", f"""
WITH h AS (SELECT split_part({HEADER}, ' ', 1) AS t FROM part), k AS (SELECT CASE WHEN starts_with(t, 'ENTRAP_SHUF_') THEN 'ENTRAP_SHUF_' ELSE coalesce(nullif(regexp_extract(t, '(?i)entrap[^_]*_'), ''), regexp_extract(t, '(?i)entrap')) END AS prefix FROM h WHERE upper(t) LIKE '%ENTRAP%')
SELECT prefix, count(*) AS n, prefix = 'ENTRAP_SHUF_' AS is_known FROM k GROUP BY 1""")
def prefixes_observed(spark, sf):
    return targets.observed_prefixes(headers(spark, sf), "ENTRAP", ["ENTRAP_SHUF_"])


@query("controls_injected", "SELECT n_name AS header, false AS is_control FROM nation UNION ALL SELECT 'ENTRAP_' || p_name, true FROM part")
def controls_injected(spark, sf):
    return targets.injected(table(spark, sf, "nation").select(F.col("n_name").alias("header")), table(spark, sf, "part").select(F.concat(F.lit("ENTRAP_"), "p_name").alias("header")), "ENTRAP_")


@query("selected_union", f"""
WITH {SEQ}, r AS (SELECT 'D' || doc_id AS accession, sha256(sequence) AS seq_hash, doc_id % 3 AS part FROM s WHERE sequence <> ''),
g AS (SELECT seq_hash, min(accession) AS accession FROM r WHERE part = 1 AND seq_hash NOT IN (SELECT seq_hash FROM r WHERE part = 0) GROUP BY 1)
SELECT accession, seq_hash, 0 AS layer FROM r WHERE part = 0 UNION ALL SELECT accession, seq_hash, 1 FROM g
UNION ALL SELECT DISTINCT 'SHA256_' || seq_hash, seq_hash, 2 FROM r WHERE part = 2 AND seq_hash NOT IN (SELECT seq_hash FROM r WHERE part < 2)""")
def selected_union(spark, sf):
    own = sequences(spark, sf).where("sequence <> ''").select(F.col("doc_id"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("accession"), "sequence", F.sha2("sequence", 256).alias("seq_hash"))
    return targets.selected_union(*[own.where(F.col("doc_id") % 3 == i) for i in range(3)]).select("accession", "seq_hash", "layer")


@query("source_coverage", """
WITH g AS (SELECT l_partkey AS gene, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS dna, max(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS rna FROM lineitem WHERE l_tax > 0.03 GROUP BY 1),
p AS (SELECT p_partkey AS gene, p_size % 3 = 0 AS k FROM part WHERE p_size > 10), j AS (SELECT g.gene AS a, p.gene AS p, k, dna, rna FROM g FULL JOIN p ON g.gene = p.gene)
SELECT count(a) AS raw_genes, count(*) FILTER (a IS NOT NULL AND p IS NOT NULL) AS available_genes, count(*) FILTER (a IS NOT NULL AND p IS NULL) AS unavailable_genes, count(*) FILTER (a IS NULL) AS proteins_without_abundance,
count(*) FILTER (p IS NULL AND dna > 0) AS unavailable_positive_dna, count(*) FILTER (p IS NULL AND rna > 0) AS unavailable_positive_rna, count(*) FILTER (a IS NOT NULL AND p IS NOT NULL AND dna IS NULL) AS missing_dna_in_available,
count(*) FILTER (a IS NOT NULL AND p IS NOT NULL AND rna IS NULL) AS missing_rna_in_available, count(*) FILTER (a IS NOT NULL AND k) AS available_genes_with_term, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS positive_compounds FROM j""")
def source_coverage(spark, sf):
    own = table(spark, sf, "lineitem").where("l_tax > 0.03").selectExpr("l_partkey AS gene", "CASE WHEN l_returnflag = 'A' THEN l_quantity END AS dna", "CASE WHEN l_returnflag = 'R' THEN l_discount END AS rna")
    proteins = table(spark, sf, "part").where("p_size > 10")
    terms = proteins.select(F.col("p_partkey").alias("gene"), F.when(F.col("p_size") % 3 == 0, "K00001").otherwise("").alias("term"))
    return targets.source_coverage(own, proteins.select(F.col("p_partkey").alias("gene")), terms, table(spark, sf, "supplier").selectExpr("s_suppkey AS compound", "s_acctbal AS value"))


@query("median_lift", """
WITH d AS (SELECT l_suppkey, l_linestatus AS arm, count(DISTINCT l_partkey) AS depth FROM lineitem GROUP BY 1, 2), m AS (SELECT median(depth) FILTER (arm = 'F') AS base_median, median(depth) FILTER (arm = 'O') AS other_median, count(*) FILTER (arm = 'F') AS base_samples, count(*) FILTER (arm = 'O') AS other_samples FROM d)
SELECT *, round(100 * (other_median - base_median) / base_median, 8) AS lift_pct FROM m""")
def median_lift(spark, sf):
    depths = table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_linestatus").alias("arm")).agg(F.count_distinct("l_partkey").alias("depth"))
    return targets.median_lift(depths, "arm", "F", "O").withColumn("lift_pct", F.round("lift_pct", 8))
