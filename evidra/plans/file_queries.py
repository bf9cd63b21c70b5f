"""Queries that render tables to files in the shared folder and read them back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidra.functions import sequence as S
from evidra.operators import lake
from evidra.operators.lineage import parts
from evidra.plans import evidence_queries
from evidra.plans.evidence_queries import PATTERNS, SEQ, places_sql, sequences, table
from evidra.session import shared_dir
from evidra.sources import readers, sinks

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/evidra/files-{name}-{uuid.uuid4().hex}"


def records(spark, sf):
    return sequences(spark, sf).where("sequence <> ''").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("accession"), "source", "sequence")


@query("fasta_round_trip", f"WITH {SEQ} SELECT 'D' || doc_id AS accession, source, sha256(sequence) AS h, length(sequence) AS n FROM s WHERE sequence <> ''")
def fasta_round_trip(spark, sf):
    path = place(spark, "fasta")
    sinks.write_fasta(records(spark, sf).withColumn("header", F.concat_ws(" ", "accession", "source")), path, header="header")
    got = readers.fasta(spark, path, strict=True)
    return got.select("accession", F.regexp_extract("header", r" (\S+)$", 1).alias("source"), F.sha2("sequence", 256).alias("h"), F.length("sequence").cast("bigint").alias("n"))


@query("lake_from_files", f"WITH {SEQ} SELECT DISTINCT 'D' || doc_id AS accession, sha256(sequence) AS h FROM s WHERE sequence <> ''")
def lake_from_files(spark, sf):
    """Two acquisitions' FASTA of the same accessions, merged after a check that sequences agree."""
    path = place(spark, "acquisitions")
    for k in ("a", "b"):
        sinks.write_fasta(records(spark, sf), f"{path}/{k}", ordered=False)
    both = readers.fasta(spark, f"{path}/a").unionByName(readers.fasta(spark, f"{path}/b"))
    return lake.consistent(both.select("accession", "sequence"), "accession", "sequence").select("accession", F.sha2("sequence", 256).alias("h"))


LETTERS = "translate(CAST(l_orderkey AS VARCHAR) || '0123456', '0123456789', 'ACDEFGHKLM')"


def letters():
    return F.translate(F.concat(F.col("l_orderkey").cast("string"), F.lit("0123456")), "0123456789", "ACDEFGHKLM")


@query("predictions_read", f"SELECT 'run' || l_linenumber AS sample, {LETTERS} AS peptide, round(l_discount, 2) AS score, count(*) AS n FROM lineitem WHERE l_discount > 0 GROUP BY ALL")
def predictions_read(spark, sf):
    """The sample is the folder of a run; rows are dealt out, as there are few runs."""
    path, n = place(spark, "predictions"), parts(table(spark, sf, "lineitem"))
    own = table(spark, sf, "lineitem").select(letters().alias("sequence"), F.col("l_discount").alias("score"), F.concat(F.lit("run"), F.col("l_linenumber").cast("string")).alias("run"))
    own.repartition(n, "run", "sequence").write.option("header", True).partitionBy("run").csv(path)
    got = readers.predictions(spark, path, 8, 30, r"run=(\w+)").select("sample", "peptide", F.round("score", 2).alias("score"))
    return got.repartition(n, "sample", "peptide", "score").groupBy("sample", "peptide", "score").agg(F.count(F.lit(1)).alias("n"))


@query("vectors_read", f"SELECT {LETTERS} AS peptide, 0.5 AS score, count(*) AS n FROM lineitem GROUP BY ALL")
def vectors_read(spark, sf):
    path = place(spark, "vectors")
    own = table(spark, sf, "lineitem").select(letters().alias("s"))
    n = F.length("s")
    own.select(F.col("s").alias("pred_seq"), F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("0.5"), n), ", "), F.lit("]")).alias("pred_prob")).write.option("header", True).csv(path)
    return readers.predictions(spark, path, 8, 30).groupBy("peptide", "score").agg(F.count(F.lit(1)).alias("n"))


@query("matches_read", """
SELECT l_orderkey || '' AS peptide, CASE WHEN CAST(l_partkey AS VARCHAR) < CAST(l_suppkey AS VARCHAR) THEN l_partkey || ';' || l_suppkey WHEN l_partkey = l_suppkey THEN l_partkey || '' ELSE l_suppkey || ';' || l_partkey END AS proteins, l_discount AS peptide_q, count(*) AS n
FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'R' GROUP BY ALL""")
def matches_read(spark, sf):
    path = place(spark, "psms")
    own = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("peptide"), F.concat_ws(" ; ", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("proteins"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("label"), F.col("l_linenumber").alias("rank"), F.col("l_discount").alias("peptide_q"))
    sinks.write_table(own, path)
    return readers.psms(spark, path).groupBy("peptide", F.array_join("proteins", ";").alias("proteins"), "peptide_q").agg(F.count(F.lit(1)).alias("n"))


@query("features_read", "SELECT l_orderkey || '' AS peptide, l_linenumber AS charge, l_partkey || '' AS proteins, l_discount AS q_value, round(l_extendedprice, 2) AS intensity, count(*) AS n FROM lineitem GROUP BY ALL")
def features_read(spark, sf):
    path = place(spark, "lfq")
    own = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("peptide"), F.col("l_linenumber").alias("charge"), F.col("l_partkey").alias("proteins"), F.col("l_discount").alias("q_value"), F.lit(1).alias("score"), F.lit(1).alias("spectral_angle"), F.col("l_extendedprice").alias("run 1.mzML"))
    sinks.write_table(own, path)
    return readers.lfq(spark, path).groupBy("peptide", "charge", F.array_join("proteins", ";").alias("proteins"), "q_value", F.round("intensity", 2).alias("intensity")).agg(F.count(F.lit(1)).alias("n"))


@query("report_read", "SELECT l_orderkey || '' AS peptide, l_partkey || '' AS genes, l_suppkey || '' AS protein_group, l_discount AS q, max(l_extendedprice) AS quantity FROM lineitem WHERE l_discount <= 0.02 GROUP BY ALL")
def report_read(spark, sf):
    path = place(spark, "report")
    own = table(spark, sf, "lineitem").select(F.col("l_discount").alias("Q.Value"), F.col("l_orderkey").alias("Stripped.Sequence"), F.col("l_partkey").alias("Genes"), F.col("l_suppkey").alias("Protein.Group"), F.col("l_extendedprice").alias("Precursor.Quantity"))
    sinks.write_table(own, path)
    return readers.report(spark, path, 0.02).groupBy("peptide", "genes", "protein_group", "q").agg(F.max("quantity").alias("quantity"))


@query("abundances_read", "SELECT p_partkey || '' AS gene, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END AS tpm FROM part")
def abundances_read(spark, sf):
    path = place(spark, "tpm")
    own = table(spark, sf, "part").select(F.col("p_partkey").alias("gene_id"), F.when(F.col("p_size") % 5 == 0, "NA").otherwise(F.col("p_retailprice").cast("string")).alias("tpm"))
    sinks.write_table(own, path)
    return readers.abundances(spark, path)


@query("annotations_read", "SELECT p_partkey || '' AS query, p_brand AS EC, p_type AS GOs FROM part")
def annotations_read(spark, sf):
    path = place(spark, "annotations")
    rows = table(spark, sf, "part").select(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_brand", "p_type").alias("value"))
    head = spark.createDataFrame([("## made by a test",), ("#query\tEC\tGOs",)], "value string")
    head.unionByName(rows).write.text(path)
    return readers.annotations(spark, path)


@query("levels_read", """
WITH v AS (SELECT p_partkey || '' AS accession, unnest(['EC', 'GO']) AS level, unnest([p_type, p_brand || ',-;' || p_brand]) AS raw FROM part)
SELECT accession, level, value, count(*) AS n FROM (SELECT accession, level, trim(unnest(string_split_regex(raw, '[;,]'))) AS value FROM v) WHERE value NOT IN ('', '-') GROUP BY ALL""")
def levels_read(spark, sf):
    path = place(spark, "levels")
    sinks.write_table(table(spark, sf, "part").select(F.col("p_partkey").alias("accession"), F.col("p_type").alias("EC"), F.concat("p_brand", F.lit(",-;"), "p_brand").alias("GO")), path)
    got = readers.functional_levels(readers.table(spark, path, ["accession"]), "accession", ["EC", "GO", "none"])
    return got.groupBy("accession", "level", "value").agg(F.count(F.lit(1)).alias("n"))


@query("provenance_read", f"WITH {SEQ} SELECT sha256(sequence) AS seq_hash, min(doc_id) AS first_id, count(*) AS n_sources, string_agg(DISTINCT source, ',' ORDER BY source) AS tags FROM s GROUP BY 1")
def provenance_read(spark, sf):
    path = place(spark, "provenance")
    own = sequences(spark, sf).groupBy(F.sha2("sequence", 256).alias("seq_hash")).agg(F.min("doc_id").alias("m"), F.collect_list(F.struct(F.col("source").alias("tag"), F.col("doc_id").cast("string").alias("accession"), F.lit("x").alias("description"))).alias("sources"))
    sinks.write_json(own.select("seq_hash", F.col("m").cast("string").alias("accession"), "sources"), path, "gzip")
    got = readers.provenance(spark, path)
    tags = F.array_join(F.array_sort(F.array_distinct(F.transform("sources", lambda x: x["tag"]))), ",")
    return got.select("seq_hash", F.col("accession").cast("bigint").alias("first_id"), F.size("sources").cast("bigint").alias("n_sources"), tags.alias("tags"))


@query("sidecar_read", f"WITH {SEQ} SELECT DISTINCT sha256(sequence) AS seq_hash, source AS tag, coalesce(lang, '') AS header FROM s")
def sidecar_read(spark, sf):
    path = place(spark, "sidecar")
    own = sequences(spark, sf).select(F.sha2("sequence", 256).alias("sha256_hash"), F.lit(1).alias("priority"), F.concat_ws(" ", "source", "lang").alias("header"))
    sinks.write_table(lake.joint_headers(own, "sha256_hash", "priority", "header", track_all=True), path, ["sha256_hash"])
    return readers.sidecar(spark, path)


@query("peptides_read", f"SELECT {LETTERS} AS peptide, 1.0 AS score, count(*) AS n FROM lineitem GROUP BY ALL")
def peptides_read(spark, sf):
    path = place(spark, "peptides")
    table(spark, sf, "lineitem").select(letters().alias("value")).write.text(path)
    return readers.peptides_text(spark, path).groupBy("peptide", "score").agg(F.count(F.lit(1)).alias("n"))


@query("matrix_written", "SELECT l_partkey || '' AS part, printf('%.2f', sum(l_quantity) FILTER (l_returnflag = 'A')) AS A, printf('%.2f', sum(l_quantity) FILTER (l_returnflag = 'N')) AS N, printf('%.2f', sum(l_quantity) FILTER (l_returnflag = 'R')) AS R FROM lineitem GROUP BY 1")
def matrix_written(spark, sf):
    path = place(spark, "matrix")
    own = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), "l_returnflag", "l_quantity")
    made = sinks.write_matrix(own, path, "part", "l_returnflag", "l_quantity", ["A", "N", "R"])
    got = readers.table(spark, made, ["part", "A", "N", "R"])
    return got.select("part", *[F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c).cast("double"))).alias(c) for c in ("A", "N", "R")])


@query("bundle_written", """
SELECT c_custkey, n_name, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def bundle_written(spark, sf):
    """Whole tables written as one bundle, checked against their records and read back."""
    path = place(spark, "bundle")
    sinks.write_bundle({n: table(spark, sf, n) for n in ("nation", "customer", "orders")}, path, {"source": "tables"})
    got = readers.bundle(spark, path)
    sums = got["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    own = got["customer"].join(got["nation"], F.col("n_nationkey") == F.col("c_nationkey")).join(sums, F.col("o_custkey") == F.col("c_custkey"), "left")
    return own.select("c_custkey", "n_name", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query("engine_headers", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'x' || page_id || ' G1 text GN=G1' ELSE 'x' || page_id || ' text GN=G1' END AS header FROM pages""")
def engine_headers(spark, sf):
    accession = F.concat(F.lit("x"), F.col("page_id").cast("string"))
    first = F.concat(S.engine_header(accession, F.lit("G1"), F.lit("text"), "gene_first"), F.lit(" GN=G1"))
    return table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, first).otherwise(S.engine_header(accession, F.lit("G1"), F.lit("text"))).alias("header"))


@query("hits_written", f"WITH {SEQ}, {PATTERNS}, {places_sql(12)} SELECT peptide, CAST(doc_id AS VARCHAR) AS protein_id, CAST(position AS VARCHAR) AS position FROM x JOIN d USING (peptide)")
def hits_written(spark, sf):
    """All hits, in order of protein, position and peptide, read back as text."""
    path = place(spark, "hits")
    sinks.write_hits(evidence_queries.substring_join(spark, sf), path, "doc_id")
    return readers.table(spark, path, ["peptide", "protein_id", "position"])


_EVIDENCE = evidence_queries.ORACLES["evidence"]


@query("evidence_written", f"WITH ev AS ({_EVIDENCE}) SELECT CAST(protein AS VARCHAR) AS protein_id, CAST(n_peptides AS VARCHAR) AS n_peptides, CAST(n_samples AS VARCHAR) AS n_samples, true AS four_places FROM ev")
def evidence_written(spark, sf):
    """What is read back has four places and differs from the scores by half of the last one at most."""
    path = place(spark, "evidence")
    own = evidence_queries.evidence(spark, sf).select(F.col("protein").alias("protein_id"), "n_peptides", F.lit(0).alias("n_unique_peptides"), "n_samples", "mean_score", "max_score", F.col("support").alias("support_score"))
    sinks.write_evidence(own, path)
    got = readers.table(spark, path, list(sinks.EVIDENCE))
    scores = ("mean_score", "max_score", "support_score")
    both = got.join(own.select(F.col("protein_id").cast("string").alias("protein_id"), *[F.col(c).alias(f"own_{c}") for c in scores]), "protein_id")
    close = [F.col(c).rlike(r"^[0-9]+\.[0-9]{4}$") & (F.abs(F.col(c).cast("double") - F.col(f"own_{c}")) <= 0.0000500001) for c in scores]
    return both.select("protein_id", "n_peptides", "n_samples", (close[0] & close[1] & close[2]).alias("four_places"))


@query("statistics_written", "SELECT 0.05 AS q, count(*) AS n_rows, count(*) FILTER (l_discount <= 0.05) AS n_kept FROM lineitem")
def statistics_written(spark, sf):
    path = place(spark, "statistics")
    own = table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("l_discount") <= 0.05).alias("n_kept"))
    sinks.write_statistics(own, path, {"q": 0.05})
    return spark.read.json(path).select("q", "n_rows", "n_kept")
