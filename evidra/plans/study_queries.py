"""Queries on studies, functions, error reports, contaminants, refinement, taxonomy, genes; roles as in evidence_queries.

Order keys spelt in residues are peptides, suppliers samples, part keys with a P proteins, order lines charges.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidra.functions import sequence as S
from evidra.operators import contaminants, control, genes, graph, lake, network, refine, rollup, study, taxonomy
from evidra.plans.evidence_queries import DEGREE, EDGES, PATTERNS, SEQ, edges, sequences, table, whole_windows
from evidra.session import shared_dir
from evidra.sources import readers

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def spelt(c):
    return F.translate(F.col(c).cast("string"), "0123456789", "ACDEFGHIKM")


PSM = """psm AS (SELECT l_suppkey AS sample, translate(CAST(l_orderkey AS VARCHAR), '0123456789', 'ACDEFGHIKM') AS peptide, 'P' || l_partkey AS protein, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS label,
CASE WHEN l_linenumber <= 5 THEN 1 ELSE 2 END AS rank, l_discount AS q, l_linenumber AS charge, l_extendedprice AS intensity FROM lineitem),
ev AS (SELECT DISTINCT sample, translate(peptide, 'I', 'L') AS peptide, protein FROM psm WHERE rank = 1 AND label = 1 AND q <= 0.05),
dict AS (SELECT peptide, min(protein) AS study_group FROM ev GROUP BY 1),
feat AS (SELECT sample, peptide, charge, min(protein) AS protein, max(intensity) AS intensity FROM psm GROUP BY 1, 2, 3),
gated AS (SELECT p.*, translate(p.peptide, 'I', 'L') AS canonical FROM feat p WHERE intensity > 0 AND EXISTS (SELECT 1 FROM ev WHERE ev.sample = p.sample AND ev.peptide = translate(p.peptide, 'I', 'L')))"""


def matches(spark, sf):
    own = table(spark, sf, "lineitem")
    return own.select(F.col("l_suppkey").alias("sample"), spelt("l_orderkey").alias("peptide"), F.array(F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("proteins"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("label"), F.when(F.col("l_linenumber") <= 5, 1).otherwise(2).alias("rank"), F.col("l_discount").alias("peptide_q"), F.col("l_linenumber").alias("charge"), F.col("l_extendedprice").alias("intensity"))


def features(spark, sf):
    return matches(spark, sf).groupBy("sample", "peptide", "charge").agg(F.min("proteins").alias("proteins"), F.max("intensity").alias("intensity"))


def first_protein(evidence):
    return evidence.groupBy("peptide").agg(F.min("protein").alias("protein"))


def searched(spark, sf):
    own = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("protein"))
    return own.distinct()


@query("study_evidence", f"WITH {PSM} SELECT * FROM ev")
def study_evidence(spark, sf):
    return study.accepted_evidence(matches(spark, sf), 0.05)


@query("study_gated", f"WITH {PSM} SELECT sample, peptide, canonical, charge, round(intensity, 2) AS intensity FROM gated")
def study_gated(spark, sf):
    got = study.gated(features(spark, sf), study.accepted_evidence(matches(spark, sf), 0.05))
    return got.select("sample", "peptide", "canonical", "charge", F.round("intensity", 2).alias("intensity"))


@query("study_ledger", f"""
WITH {PSM}, local AS (SELECT DISTINCT sample, protein FROM psm)
SELECT g.sample, g.peptide, g.canonical, g.charge, g.protein AS member_set, d.study_group, l.protein IS NOT NULL AS in_local_fasta, g.protein = d.study_group AS in_local_members, round(g.intensity, 2) AS intensity
FROM gated g JOIN dict d ON d.peptide = g.canonical LEFT JOIN local l ON l.sample = g.sample AND l.protein = d.study_group""")
def study_ledger(spark, sf):
    evidence = study.accepted_evidence(matches(spark, sf), 0.05)
    got = study.ledger(study.gated(features(spark, sf), evidence), first_protein(evidence), searched(spark, sf))
    return got.withColumn("intensity", F.round("intensity", 2))


@query("study_acquisitions", f"""
WITH {PSM} SELECT sample, count(DISTINCT study_group) AS groups, count(DISTINCT canonical) AS peptides, count(*) AS features, round(sum(intensity), 2) AS intensity FROM gated JOIN dict ON dict.peptide = canonical GROUP BY sample""")
def study_acquisitions(spark, sf):
    evidence = study.accepted_evidence(matches(spark, sf), 0.05)
    rows = study.ledger(study.gated(study.unique_features(features(spark, sf)), evidence), first_protein(evidence), searched(spark, sf))
    return rows.groupBy("sample").agg(F.count_distinct("study_group").alias("groups"), F.count_distinct("canonical").alias("peptides"), F.count(F.lit(1)).alias("features"), F.round(F.sum("intensity"), 2).alias("intensity"))


@query("study_balance", f"WITH {PSM} SELECT round(sum(intensity), 0) AS intensity_in, round(sum(intensity), 0) AS intensity_out FROM gated JOIN dict ON dict.peptide = canonical")
def study_balance(spark, sf):
    evidence = study.accepted_evidence(matches(spark, sf), 0.05)
    rows = study.ledger(study.gated(features(spark, sf), evidence), first_protein(evidence), searched(spark, sf))
    got = study.balanced(rows, study.quantify(rows, "sample", "study_group", "canonical", "intensity"))
    return got.select(*[F.round(c, 0).alias(c) for c in got.columns])


@query("study_bundle")
def study_bundle(spark, sf):
    """The groups of a whole study, by the greedy cover over its accepted evidence."""
    return study.compose(matches(spark, sf), features(spark, sf), searched(spark, sf), 0.05)["study_groups"]


def lake_expectation_sql(rounds=10):
    """The rounds one after the other; early stops change less than is printed."""
    made = """o AS (SELECT l_suppkey AS sample, l_orderkey AS peptide, max(l_quantity) / 50 AS score FROM lineitem GROUP BY 1, 2),
w AS (SELECT peptide, max(score) AS score, count(DISTINCT sample) AS k FROM o GROUP BY 1), x AS (SELECT e.peptide, e.protein, degree, score, k FROM e JOIN g USING (peptide) JOIN w USING (peptide)),
n AS (SELECT protein, sqrt(count(DISTINCT sample)::DOUBLE) / sqrt(greatest(any_value(p_size) * 20, 50)::DOUBLE) AS norm FROM e JOIN o USING (peptide) JOIN part ON p_partkey = protein GROUP BY protein),
b0 AS (SELECT protein, sum(score / degree) * any_value(norm) AS a FROM x JOIN n USING (protein) GROUP BY protein), a0 AS (SELECT protein, a / (SELECT sum(a) FROM b0) AS a FROM b0)"""
    for k in range(rounds):
        made += f""",
s{k} AS (SELECT peptide, sum(a) AS t FROM x JOIN a{k} USING (protein) WHERE degree > 1 GROUP BY peptide),
b{k + 1} AS (SELECT protein, sum(CASE WHEN degree = 1 THEN score * sqrt(k::DOUBLE) WHEN t > 0 THEN score * a / t ELSE score / degree END) * any_value(norm) AS a FROM x JOIN a{k} USING (protein) LEFT JOIN s{k} USING (peptide) JOIN n USING (protein) GROUP BY protein),
a{k + 1} AS MATERIALIZED (SELECT protein, a / (SELECT sum(a) FROM b{k + 1}) AS a FROM b{k + 1})"""
    return f"WITH {EDGES}, {DEGREE}, {made} SELECT protein, round(a / (SELECT max(a) FROM a{rounds}), 6) AS abundance FROM a{rounds}"


@query("lake_expectation", lake_expectation_sql())
def lake_expectation(spark, sf):
    own = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("peptide")).agg((F.max("l_quantity") / 50).alias("score"))
    lengths = table(spark, sf, "part").select(F.col("p_partkey").alias("protein"), (F.col("p_size") * 20).alias("length"))
    return graph.lake_expectation(edges(spark, sf), own, lengths).select("protein", F.round("abundance", 6).alias("abundance"))


GROUPS = """grp AS (SELECT l_suppkey AS sample, l_orderkey AS peptide, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ';' ORDER BY CAST(l_partkey AS VARCHAR)) AS protein_group, sum(l_extendedprice) / 1.4142135 AS v FROM lineitem WHERE l_discount <= 0.05 GROUP BY 1, 2),
ann AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS accession, unnest(string_split(p_type, ' ')) AS value FROM part WHERE p_size > 10),
mem AS (SELECT DISTINCT protein_group, unnest(string_split(protein_group, ';')) AS accession FROM grp),
vote AS (SELECT protein_group, value, count(*) AS n FROM mem JOIN ann USING (accession) GROUP BY 1, 2),
win AS (SELECT protein_group, value AS plurality_value FROM (SELECT *, row_number() OVER (PARTITION BY protein_group ORDER BY n DESC, value) AS k FROM vote) WHERE k = 1),
bare AS (SELECT protein_group, 'Unannotated_' || lpad(CAST(row_number() OVER (ORDER BY protein_group) AS VARCHAR), 6, '0') AS plurality_value FROM (SELECT DISTINCT protein_group FROM grp) WHERE protein_group NOT IN (SELECT protein_group FROM win)),
res AS (SELECT * FROM win UNION ALL SELECT * FROM bare),
part_of AS (SELECT protein_group, value, 1.0 / count(*) OVER (PARTITION BY protein_group) AS w FROM vote UNION ALL SELECT protein_group, plurality_value, 1.0 FROM bare)"""


def groups(spark, sf):
    own = table(spark, sf, "lineitem").where("l_discount <= 0.05").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("peptide"))
    return own.agg(F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ";").alias("protein_group"), (F.sum("l_extendedprice") / 1.4142135).alias("v"))


def levels(spark, sf):
    return table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("accession"), F.explode(F.split("p_type", " ")).alias("value"))


@query("level_map", f"WITH {GROUPS} SELECT protein_group, any_value(plurality_value) AS plurality_value, CAST(count(*) AS INTEGER) AS n_unique_values, string_agg(value || ':' || printf('%.6f', w), ';' ORDER BY value) AS split_values FROM part_of JOIN res USING (protein_group) GROUP BY protein_group")
def level_map(spark, sf):
    return rollup.level_map(rollup.resolve_level(groups(spark, sf), levels(spark, sf)))


@query("functional_plurality", f"WITH {GROUPS} SELECT plurality_value AS value, sample, round(sum(v), 2) AS amount FROM grp JOIN res USING (protein_group) GROUP BY 1, 2")
def functional_plurality(spark, sf):
    own = groups(spark, sf)
    return rollup.functional_matrix(own, rollup.resolve_level(own, levels(spark, sf)), ["sample"], "v").withColumn("amount", F.round("amount", 2))


@query("functional_split", f"WITH {GROUPS} SELECT value, sample, round(sum(v * w), 2) AS amount FROM grp JOIN part_of USING (protein_group) GROUP BY 1, 2")
def functional_split(spark, sf):
    own = groups(spark, sf)
    return rollup.functional_matrix(own, rollup.resolve_level(own, levels(spark, sf)), ["sample"], "v", "split").withColumn("amount", F.round("amount", 2))


@query("functional_peptides", f"WITH {GROUPS} SELECT value, peptide, sample, round(sum(v * w), 2) AS amount FROM grp JOIN part_of USING (protein_group) GROUP BY 1, 2, 3")
def functional_peptides(spark, sf):
    own = groups(spark, sf)
    return rollup.functional_matrix(own, rollup.resolve_level(own, levels(spark, sf)), ["peptide", "sample"], "v", "split").withColumn("amount", F.round("amount", 2))


@query("group_metadata", f"""
WITH {GROUPS}, host AS (SELECT CAST(p_partkey AS VARCHAR) AS accession, CASE WHEN p_size = 50 THEN 'Mixed' ELSE 'Human' END AS class FROM part WHERE p_size > 25)
SELECT protein_group, min(m.accession) AS representative, count(*) AS n_members, CASE WHEN bool_or(coalesce(class, '') = 'Mixed') OR (bool_or(class IS NOT NULL) AND bool_or(class IS NULL)) THEN 'Mixed' WHEN bool_or(class IS NOT NULL) THEN 'Human' ELSE 'Microbial' END AS classification
FROM mem m LEFT JOIN host h ON h.accession = m.accession GROUP BY protein_group""")
def group_metadata(spark, sf):
    hosts = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").cast("string").alias("accession"), F.when(F.col("p_size") == 50, "Mixed").otherwise("Human").alias("class"))
    return rollup.group_metadata(groups(spark, sf), hosts)


@query("term_coverage", """
WITH v AS (SELECT l_suppkey AS sample, l_partkey AS g, sum(l_extendedprice) AS v, any_value(p_size) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT sample, round(sum(v), 2) AS observed_signal, count(*) AS measured_groups, round(coalesce(sum(v) FILTER (s <= 10), 0), 2) AS unannotated_signal, round((sum(v) - coalesce(sum(v) FILTER (s <= 10), 0)) / sum(v), 8) AS annotation_fraction FROM v GROUP BY 1""")
def term_coverage(spark, sf):
    own = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("p_partkey"), "l_extendedprice").join(table(spark, sf, "part").select("p_partkey", "p_size", "p_type"), "p_partkey")
    own = own.groupBy("sample", "p_partkey", F.when(F.col("p_size") > 10, F.split("p_type", " ")).alias("terms")).agg(F.sum("l_extendedprice").alias("v"))
    got = rollup.term_coverage(own, "sample", "p_partkey", "v", "terms")
    return got.select("sample", F.round("observed_signal", 2).alias("observed_signal"), "measured_groups", F.round("unannotated_signal", 2).alias("unannotated_signal"), F.round("annotation_fraction", 8).alias("annotation_fraction"))


@query("class_counts", """
WITH p AS (SELECT l_suppkey AS sample, translate(CAST(l_orderkey AS VARCHAR), '0123456789', 'ACDEFGHIKM') AS peptide, bool_or(l_returnflag = 'A') AS trap, bool_or(l_returnflag <> 'A') AS plain, min(l_discount) AS q, CASE WHEN l_suppkey % 7 = 0 THEN -1 ELSE 1 END AS label FROM lineitem GROUP BY ALL),
c AS (SELECT *, CASE WHEN label <> 1 THEN 'decoy' WHEN trap AND plain THEN 'shared' WHEN trap THEN 'entrap' ELSE 'target' END AS k FROM p), o AS (SELECT * FROM c WHERE k = 'decoy' OR (q <= 0.05 AND length(peptide) >= 3))
SELECT sample, count(*) FILTER (k = 'target') AS n_target, count(*) FILTER (k = 'entrap') AS n_entrap, count(*) FILTER (k = 'shared') AS n_shared, count(*) FILTER (k = 'decoy') AS n_decoy,
count(DISTINCT peptide) FILTER (k = 'target') AS peptides_target, count(DISTINCT peptide) FILTER (k = 'entrap') AS peptides_entrap, count(DISTINCT peptide) FILTER (k = 'shared') AS peptides_shared FROM o GROUP BY sample""")
def class_counts(spark, sf):
    return control.class_counts(grouped_matches(spark, sf), ["sample"], "q", 0.05, 3)


def grouped_matches(spark, sf):
    name = F.concat(F.when(F.col("l_returnflag") == "A", "ENTRAP_").otherwise("P"), F.col("l_partkey").cast("string"))
    own = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), "l_orderkey").agg(F.collect_set(name).alias("proteins"), F.min("l_discount").alias("q"))
    return own.select("sample", spelt("l_orderkey").alias("peptide"), "proteins", "q", F.when(F.col("sample") % 7 == 0, -1).otherwise(1).alias("label"))


@query("fdp_report", ORACLES["class_counts"].replace("SELECT sample, count(*) FILTER (k = 'target') AS n_target", "SELECT * FROM (SELECT sample, count(*) FILTER (k = 'target') AS n_target").replace("FROM o GROUP BY sample", """FROM o GROUP BY sample)""").replace("SELECT * FROM (", """SELECT sample, n_target, n_entrap, n_shared, n_decoy, round(CASE WHEN n_target + n_entrap > 0 THEN n_entrap / (n_target + n_entrap) END, 8) AS lower_bound,
round(CASE WHEN n_target + n_entrap > 0 THEN n_entrap * (1 + 1 / 0.5) / (n_target + n_entrap) END, 8) AS combined_upper, round(CASE WHEN n_target + n_entrap > 0 THEN 2 * n_entrap / (n_target + n_entrap) END, 8) AS elias_gygi, round(CASE WHEN n_target > 0 THEN n_entrap / n_target END, 8) AS sample_method,
round(CASE WHEN n_target + n_entrap > 0 THEN n_entrap * 2.0 / (n_entrap * 2.0 + n_target) END, 8) AS size_scaled, round(CASE WHEN n_target + n_entrap + n_shared > 0 THEN (n_entrap + n_shared) / (n_entrap + n_shared + n_target) END, 8) AS shared_sensitivity,
CASE WHEN n_target + n_entrap = 0 THEN 'UNDEFINED' WHEN n_entrap * 3.0 / (n_target + n_entrap) <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (""", 1))
def fdp_report(spark, sf):
    got = control.fdp_report(control.class_counts(grouped_matches(spark, sf), ["sample"], "q", 0.05, 3), 1000, 500)
    return got.select("sample", "n_target", "n_entrap", "n_shared", "n_decoy", *[F.round(c, 8).alias(c) for c in ("lower_bound", "combined_upper", "elias_gygi", "sample_method", "size_scaled", "shared_sensitivity")], "verdict")


@query("paired_counts", """
WITH p AS (SELECT l_orderkey, max(l_quantity) FILTER (l_returnflag <> 'A') AS t, max(l_quantity) FILTER (l_returnflag = 'A') AS e FROM lineitem GROUP BY 1),
n AS (SELECT count(*) FILTER (t >= 20) AS n_target, count(*) FILTER (e >= 20) AS n_entrapment, count(*) FILTER (e >= 20 AND NOT coalesce(t >= 20, false)) AS n_target_undiscovered, count(*) FILTER (e >= 20 AND t >= 20 AND e > t) AS n_entrapment_greater FROM p)
SELECT *, round((n_entrapment + n_target_undiscovered + 2 * n_entrapment_greater) / (n_target + n_entrapment), 6) AS fdp_paired FROM n""")
def paired_counts(spark, sf):
    trap = F.col("l_returnflag") == "A"
    own = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(~trap, F.col("l_quantity"))).alias("target_score"), F.max(F.when(trap, F.col("l_quantity"))).alias("entrapment_score"))
    return control.paired_counts(own, 20)


@query("sample_summary", "WITH v AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, count(*) AS n, round(median(v), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr FROM v GROUP BY 1")
def sample_summary(spark, sf):
    own = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("v"))
    got = control.summary(own, "v", ["l_returnflag"])
    return got.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("median", "q1", "q3", "iqr")])


@query("tune_winner", """
WITH g AS (SELECT q::DOUBLE AS q, n::INTEGER AS length, count(*) FILTER (l_returnflag <> 'A') AS n_target, count(*) FILTER (l_returnflag = 'A') * 2.0 / count(*) AS fdp FROM (VALUES (0.01), (0.05)) a(q), (VALUES (2), (4)) b(n) JOIN lineitem ON l_discount <= q AND l_linenumber >= n GROUP BY ALL)
SELECT q, length, n_target, round(fdp, 8) AS fdp, fdp <= 0.5 AS passed FROM g ORDER BY (fdp <= 0.5) DESC, CASE WHEN fdp <= 0.5 THEN -n_target ELSE fdp END, q, length LIMIT 1""")
def tune_winner(spark, sf):
    own = table(spark, sf, "lineitem").select("l_discount", "l_linenumber", F.lit(0.0).alias("s"), "l_returnflag")
    grid = control.tune(own, "l_discount", "l_linenumber", "s", F.col("l_returnflag") == "A", (0.01, 0.05), (2, 4), (0.0,))
    grid = grid.select("q", "length", "n_target", F.try_divide(F.col("n_entrapment") * 2.0, F.col("n_target") + F.col("n_entrapment")).alias("fdp"))
    return control.winner(grid, 0.5).withColumn("fdp", F.round("fdp", 8))


CON = "c AS (SELECT unnest([" + ", ".join(f"'{a}'" for a in contaminants.DEFAULT) + "]) AS acc)"
NAMES = """n AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'sp|P' || lpad(CAST(page_id % 10000 + 700 AS VARCHAR), 5, '0') || '|X_BOVIN' WHEN 1 THEN 'CON_P00761' WHEN 2 THEN 'P' || lpad(CAST(page_id % 5000 AS VARCHAR), 5, '0') WHEN 3 THEN 'MGYG000000001_1' ELSE 'rev_P02769' END AS id FROM pages),
a AS (SELECT *, CASE WHEN starts_with(id, 'sp|') THEN string_split(id, '|')[2] WHEN starts_with(id, 'rev_') THEN substr(id, 5) WHEN starts_with(id, 'CON_') THEN substr(id, 5) WHEN length(id) = 6 THEN id END AS acc FROM n),
m AS (SELECT page_id, id, starts_with(id, 'CON_') OR acc IN (SELECT acc FROM c) AS hit FROM a)"""


def named(spark, sf):
    k, p = F.col("page_id") % 5, F.col("page_id")
    return table(spark, sf, "pages").select("page_id", F.when(k == 0, F.concat(F.lit("sp|P"), F.lpad((p % 10000 + 700).cast("string"), 5, "0"), F.lit("|X_BOVIN"))).when(k == 1, "CON_P00761").when(k == 2, F.concat(F.lit("P"), F.lpad((p % 5000).cast("string"), 5, "0"))).when(k == 3, "MGYG000000001_1").otherwise("rev_P02769").alias("id"))


@query("contaminant_tags", f"WITH {CON}, {NAMES} SELECT page_id, CASE WHEN coalesce(hit, false) AND NOT starts_with(id, 'CON_') THEN 'CON_' || id ELSE id END AS id, coalesce(hit, false) AS contaminant FROM m")
def contaminant_tags(spark, sf):
    return contaminants.tagged(named(spark, sf), "id", contaminants.table(spark))


@query("contaminants_excluded", f"WITH {CON}, {NAMES} SELECT page_id, id || ';sp|X|Y' AS proteins FROM m WHERE NOT coalesce(hit, false)")
def contaminants_excluded(spark, sf):
    return contaminants.excluded(named(spark, sf).select("page_id", F.concat("id", F.lit(";sp|X|Y")).alias("proteins")), contaminants.table(spark))


@query("refinement_candidates", """
WITH p AS (SELECT translate(CAST(l_orderkey AS VARCHAR), '0123456789', 'ACDEFGHIKM') AS peptide, 'P' || l_partkey AS protein, l_discount AS q, l_linenumber AS peaks, l_extendedprice AS h FROM lineitem),
i AS (SELECT *, CASE WHEN length(peptide) > 1 THEN least(peaks / (2.0 * (length(peptide) - 1)), 1.0) ELSE 0.0 END AS ics FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY peptide ORDER BY h DESC, protein) AS k FROM i WHERE q <= 0.05 AND ics < 0.4)
SELECT peptide, peptide AS peptide_raw, protein, round(ics, 8) AS ics, h AS hyperscore FROM b WHERE k = 1 ORDER BY h DESC, peptide LIMIT 500""")
def refinement_candidates(spark, sf):
    own = table(spark, sf, "lineitem").select(spelt("l_orderkey").alias("peptide"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("proteins"), F.col("l_discount").alias("spectrum_q"), F.col("l_linenumber").alias("matched_peaks"), F.col("l_extendedprice").alias("hyperscore"))
    return refine.candidates(own, limit=0.05, tie="proteins").withColumn("ics", F.round("ics", 8))


@query("completeness_summary", """
WITH i AS (SELECT least(l_linenumber / 10.0, 1.0) AS ics FROM lineitem)
SELECT count(*) AS n_psms, round(avg(ics), 4) AS mean_ics, round(median(ics), 4) AS median_ics, round(avg(CASE WHEN ics >= 0.4 THEN 1 ELSE 0 END) * 100, 1) AS pct_high, round(avg(CASE WHEN ics < 0.3 THEN 1 ELSE 0 END) * 100, 1) AS pct_low, count(*) FILTER (ics >= 0.4) AS n_high, count(*) FILTER (ics < 0.3) AS n_low FROM i""")
def completeness_summary(spark, sf):
    own = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("matched_peaks"), F.lit(6).alias("peptide_len"), F.lit("X").alias("peptide"))
    return refine.completeness_summary(refine.with_completeness(own))


SUBST = "x(residue, target, score) AS (VALUES " + ", ".join(f"('{a}', '{b}', {s})" for p, s in refine.CONFUSIONS.items() for a, b in (p, p[::-1])) + ")"


@query("variants", f"""
WITH {SUBST}, {PATTERNS}, k AS (SELECT peptide, unnest(range(0, length(peptide))) AS position FROM d),
r AS (SELECT k.*, x.*, row_number() OVER (PARTITION BY peptide, position ORDER BY score DESC, instr('{refine.ORDER}', target)) AS rn FROM k JOIN x ON residue = substr(peptide, position + 1, 1) WHERE score >= -1)
SELECT peptide, CAST(position AS INTEGER) AS position, residue || (position + 1) || target AS notation, substr(peptide, 1, position) || target || substr(peptide, position + 2) AS variant, score FROM r WHERE rn <= 3""")
def variants(spark, sf):
    """Of windows of whole texts; the matrix is written as text and read back."""
    wide = refine.confusions(spark).groupBy("residue").pivot("target", list(refine.ORDER)).agg(F.first("score")).na.fill(0)
    path = f"{shared_dir(spark)}/evidra/matrix-{uuid.uuid4().hex}"
    head = spark.createDataFrame([("  " + "  ".join(refine.ORDER),)], "value string")
    head.unionByName(wide.select(F.concat_ws(" ", "residue", *[F.lpad(F.col(c).cast("string"), 2, " ") for c in refine.ORDER]).alias("value"))).write.text(path)
    return refine.variants(whole_windows(spark, sf, 12).select("peptide").distinct(), readers.substitution_matrix(spark, path), "peptide")


TAXA = """look AS (SELECT c_custkey AS peptide, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 1 ELSE c_nationkey + 2 END AS taxon, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey % 19 = 0 END AS cut, c_nationkey, n_regionkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal >= 0),
obs AS (SELECT o_custkey AS peptide, o_orderpriority AS sample, sum(o_totalprice) AS signal FROM orders GROUP BY 1, 2),
st AS (SELECT o.*, CASE WHEN l.peptide IS NULL THEN 'not_returned' WHEN cut IS NULL THEN 'cutoff_not_reported' WHEN cut THEN 'lookup_cutoff' WHEN taxon IS NULL OR taxon <= 1 THEN 'unresolved' ELSE 'assigned' END AS status, n_regionkey + 1000 AS a, c_nationkey + 2 AS b, r_name, n_name FROM obs o LEFT JOIN look l USING (peptide))"""


def taxa(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    own = table(spark, sf, "customer").where("c_acctbal >= 0").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    node = lambda i, name, rank: F.struct(i.cast("bigint").alias("id"), name.alias("name"), F.lit(rank).alias("rank"))
    look = own.select(k.alias("peptide"), F.when(k % 11 == 0, None).when(k % 13 == 0, 1).otherwise(n + 2).alias("taxon_id"), F.when(k % 17 == 0, None).otherwise(k % 19 == 0).alias("cutoff_used"), F.array(node(F.col("n_regionkey") + 1000, F.col("r_name"), "domain"), node(n + 2, F.col("n_name"), "phylum")).alias("lineage"))
    seen = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("peptide"), F.col("o_orderpriority").alias("sample")).agg(F.sum("o_totalprice").alias("signal"))
    return taxonomy.assigned(seen, look)


@query("taxonomy_balance", f"""
WITH {TAXA}, k AS (SELECT *, CASE WHEN status <> 'assigned' THEN 'Unresolved' WHEN a = 1003 OR b = 1003 THEN 'Host' WHEN b = 2 THEN 'Bacteria' WHEN b = 2157 THEN 'Archaea' ELSE 'Other assigned taxa' END AS category FROM st),
c AS (SELECT unnest(['Host', 'Bacteria', 'Archaea', 'Other assigned taxa', 'Unresolved']) AS category), t AS (SELECT sample, count(*) AS n, sum(signal) AS s FROM st GROUP BY 1)
SELECT t.sample, c.category, count(k.peptide) AS peptides, round(coalesce(sum(k.signal), 0), 2) AS signal, round(count(k.peptide) / any_value(n), 8) AS peptide_fraction, round(coalesce(sum(k.signal), 0) / any_value(s), 8) AS signal_fraction FROM t CROSS JOIN c LEFT JOIN k ON k.sample = t.sample AND k.category = c.category GROUP BY 1, 2""")
def taxonomy_balance(spark, sf):
    got = taxonomy.balance(taxa(spark, sf), host=1003)
    return got.select("sample", "category", "peptides", F.round("signal", 2).alias("signal"), *[F.round(c, 8).alias(c) for c in ("peptide_fraction", "signal_fraction")])


@query("taxonomy_tree", f"""
WITH {TAXA}, p AS (SELECT CASE WHEN status = 'assigned' THEN [a::VARCHAR, b::VARCHAR] ELSE ['?' || status] END AS i, CASE WHEN status = 'assigned' THEN [r_name, n_name] ELSE [status] END AS m, signal FROM st),
d AS (SELECT i, m, signal, unnest(range(0, len(i) + 1)) AS depth FROM p)
SELECT array_to_string(i[1:depth], '/') AS path, CAST(depth AS INTEGER) AS depth, min(CASE WHEN depth > 0 THEN m[depth] END) AS name, round(sum(signal), 2) AS count, round(sum(CASE WHEN depth = len(i) THEN signal ELSE 0 END), 2) AS self_count FROM d GROUP BY 1, 2""")
def taxonomy_tree(spark, sf):
    got = taxonomy.tree(taxa(spark, sf), weight="signal")
    return got.select("path", "depth", "name", F.round("count", 2).alias("count"), F.round("self_count", 2).alias("self_count"))


@query("reference_table", f"WITH {SEQ} SELECT doc_id AS accession, coalesce(CASE WHEN doc_id % 3 = 0 THEN doc_id % 50 + 2 END, 0) AS taxon, sha256(sequence) AS h, '' AS note FROM s")
def reference_table(spark, sf):
    own = sequences(spark, sf).select(F.col("doc_id").alias("accession"), "sequence")
    known = own.where("accession % 3 = 0").select("accession", (F.col("accession") % 50 + 2).alias("taxon"))
    return taxonomy.reference_table(own, known).select("accession", "taxon", F.sha2("sequence", 256).alias("h"), "note")


@query("admissions", f"""
WITH {EDGES}, w AS (SELECT l_orderkey AS peptide, max(l_quantity) / 53.0 AS score FROM lineitem WHERE l_tax <= 0.05 GROUP BY 1), sel AS (SELECT p_partkey AS protein FROM part WHERE p_size > 20),
j AS (SELECT sel.protein, e.peptide, coalesce(w.score, 0.5) AS score, row_number() OVER (PARTITION BY sel.protein ORDER BY e.peptide) AS k FROM sel LEFT JOIN e USING (protein) LEFT JOIN w ON w.peptide = e.peptide)
SELECT protein, count(peptide) AS n_peptides, coalesce(string_agg(CAST(peptide AS VARCHAR), ',' ORDER BY peptide) FILTER (k <= 20 AND peptide IS NOT NULL), '') AS peptides, count(peptide) > 20 AS peptides_truncated, round(avg(score) FILTER (peptide IS NOT NULL), 4) AS mean_score, round(max(score) FILTER (peptide IS NOT NULL), 4) AS best_score,
'razor' AS strategy, false AS contaminant, CASE WHEN protein % 2 = 0 THEN 'kmer_rescue' ELSE 'exact' END AS admission FROM j GROUP BY protein""")
def admissions(spark, sf):
    got = admitted(spark, sf)
    return got.select("protein", "n_peptides", F.array_join(F.transform("peptides", lambda x: x.cast("string")), ",").alias("peptides"), "peptides_truncated", "mean_score", "best_score", "strategy", "contaminant", "admission")


def admitted(spark, sf):
    scores = table(spark, sf, "lineitem").where("l_tax <= 0.05").groupBy(F.col("l_orderkey").alias("peptide")).agg((F.max("l_quantity") / 53.0).alias("score"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("protein"), "p_size")
    return network.admissions(part.where("p_size > 20"), edges(spark, sf), scores, contaminants.table(spark), part.where("protein % 2 = 0"))


@query("admission_summary", ORACLES["admissions"].replace("SELECT protein, count(peptide) AS n_peptides", "SELECT count(*) AS n_proteins, count(*) FILTER (admission = 'kmer_rescue') AS n_kmer_rescued, count(*) FILTER (contaminant) AS n_contaminant, median(n_peptides) AS median_peptides_per_protein, round(avg(best_score), 4) AS mean_best_score, count(*) FILTER (n_peptides = 1) AS proteins_with_1_peptide, count(*) FILTER (n_peptides >= 2) AS proteins_with_2plus_peptides FROM (SELECT protein, count(peptide) AS n_peptides") + ")")
def admission_summary(spark, sf):
    return network.admission_summary(admitted(spark, sf))


@query("network_view")
def network_view(spark, sf):
    own = edges(spark, sf)
    degree = own.groupBy("peptide").agg(F.count(F.lit(1)).alias("degree"))
    return network.view(own.withColumn("assigned", F.col("protein") % 2 == 0), degree)


@query("network_problems", f"""
WITH {EDGES}, {DEGREE}, p AS (SELECT peptide, min(protein) + CASE WHEN peptide % 50 = 0 THEN 1 ELSE 0 END AS grp, any_value(degree) + CASE WHEN peptide % 70 = 0 THEN 1 ELSE 0 END AS declared FROM e JOIN g USING (peptide) GROUP BY peptide)
SELECT * FROM (SELECT p.peptide, CASE WHEN degree <> declared THEN 'degree' WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.peptide = p.peptide AND e.protein = p.grp) THEN 'representative' END AS problem FROM p JOIN g ON g.peptide = p.peptide) WHERE problem IS NOT NULL""")
def network_problems(spark, sf):
    own = edges(spark, sf)
    k = F.col("peptide")
    declared = own.groupBy("peptide").agg((F.min("protein") + F.when(k % 50 == 0, 1).otherwise(0)).alias("group"), (F.count(F.lit(1)) + F.when(k % 70 == 0, 1).otherwise(0)).alias("declared"))
    return network.reconciled(declared, own.withColumn("sample", F.lit(1)))


@query("reassigned_headers", f"WITH {SEQ} SELECT doc_id, CASE WHEN source IN ('src1', 'src3') THEN source || '_' || sha256(sequence) ELSE 'H' || doc_id END AS emitted FROM s")
def reassigned_headers(spark, sf):
    own = sequences(spark, sf).select("doc_id", "source", F.sha2("sequence", 256).alias("seq_hash"), F.concat(F.lit("H"), F.col("doc_id").cast("string")).alias("header"))
    return lake.reassigned(own, "seq_hash", "source", "header", ["src1", "src3"]).select("doc_id", "emitted")


@query("annotation_conflicts", f"""
WITH {SEQ}, r AS (SELECT sha256(sequence) AS seq_hash, list_sort(list_distinct(list(source))) AS o, list_sort(list_distinct(list(lang) FILTER (lang IS NOT NULL AND lang <> ''))) AS g FROM s GROUP BY 1)
SELECT seq_hash, CASE WHEN len(o) > 1 THEN array_to_string(o, ',') END AS organisms, CASE WHEN len(g) > 1 THEN array_to_string(g, ',') END AS genes FROM r WHERE len(o) > 1 OR len(g) > 1""")
def annotation_conflicts(spark, sf):
    own = sequences(spark, sf).select(F.sha2("sequence", 256).alias("seq_hash"), F.col("source").alias("organism"), F.col("lang").alias("gene"))
    return lake.conflicts(own, "seq_hash").select("seq_hash", F.array_join("organisms", ",").alias("organisms"), F.array_join("genes", ",").alias("genes"))


@query("gene_methods")
def gene_methods(spark, sf):
    """Votes of the peptides of documents for the sources of single-source peptides."""
    own = sequences(spark, sf).select(F.col("doc_id").cast("string").alias("accession"), F.concat(F.lit("x"), F.col("doc_id").cast("string"), F.lit(" A protein GN="), F.upper("source")).alias("header"), "sequence")
    canonical = own.join(table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("accession")).distinct(), "accession", "left_semi")
    return genes.method_counts(genes.healed(own, canonical))


HEADERS = [
    "sp|P02649_v21K|APOE_VAR some change", "sp|P02768|ALBU_HUMAN Albumin OS=Homo sapiens OX=9606 GN=ALB PE=1 SV=2", "tr|A0A1|A0A1_HUMAN Some protein OS=Homo sapiens OX=9606 PE=4",
    "var-AFR|P02768|ALB_Asp574Gly|574 Albumin OS=Homo sapiens PE=1 SV=2 [VARIANT: p.D574G]", "ENSP00000001.1 pep chromosome:1 gene:ENSG01 gene_symbol:TP53 description:tumor protein [Source:HGNC]",
    "ENSP1|ENST1|ENSG1|-|-|TP53-201|TP53|393", "ens|ENST0001.8_Arg664Gln|KLK3 text", "ECOLI|WP_0001|b0001 gene=thrL leader peptide OS=Escherichia coli", "MGYG000000001_00001 some text", "GMGC10.000_000_001.UNKNOWN",
    "SMORF_00001 short", "MuPr_Assembly_S1_00001 contig", "GENSCAN00000001 pep scaffold:1", "1_1 # 1 # 1404 # 1 # ID=1_1;partial=10", "SAMPLE|REF|MGYG000000002_00007 text", "PROJ [SWISSPROT] sp|P1|A_HUMAN Alpha OS=Homo sapiens GN=AA1 md5=ff",
    "0123456789abcdef0123456789abcdef", "ACC1|GENEX|ISO_2|liver tissue", "plain text GN=ABC",
]
#: What the ladder gives for HEADERS, from the rules of each kind: accession, gene, description, organism, variant, source.
FIELDS = [
    ("sp|P02649_v21K|APOE_VAR", "APOE", "some change", None, "21K", "disease_variant"), ("sp|P02768|ALBU_HUMAN", "ALB", "Albumin", "Homo sapiens", None, "swissprot"), ("tr|A0A1|A0A1_HUMAN", None, "Some protein", "Homo sapiens", None, "trembl"),
    ("var-AFR|P02768|ALB_Asp574Gly|574", "ALB", "Albumin", "Homo sapiens", "p.D574G", "gnomad"), ("ENSP00000001.1", "TP53", "tumor protein", None, None, "ensembl_pep"),
    ("ENSP1|ENST1|ENSG1|-|-|TP53-201|TP53|393", "TP53", "isoform TP53-201", None, None, "gencode"), ("ens|ENST0001.8_Arg664Gln|KLK3", "KLK3", "text", None, "p.Arg664Gln", "personal_variant"), ("ECOLI|WP_0001|b0001", "thrL", "leader peptide", "Escherichia coli", None, "ncbi_microbe"), ("MGYG000000001_00001", "MGYG000000001_00001", "some text", None, None, "uhgp"), ("GMGC10.000_000_001.UNKNOWN", "GMGC10.000_000_001.UNKNOWN", None, None, None, "gmgc"),
    ("SMORF_00001", "SMORF_00001", "short", None, None, "smorf"), ("MuPr_Assembly_S1_00001", "MuPr_Assembly_S1_00001", "contig", None, None, "assembly"), ("GENSCAN00000001", None, "computational prediction", None, None, "genscan"), ("1_1", "1_1", "# 1 # 1404 # 1 # ID=1_1;partial=10", None, None, "prodigal"), ("SAMPLE|REF|MGYG000000002_00007", "MGYG000000002_00007", "text", None, None, "uhgp"), ("PROJ", "AA1", "Alpha", "Homo sapiens", None, "lake_hybrid"),
    ("0123456789abcdef0123456789abcdef", "0123456789abcdef0123456789abcdef", None, None, None, "md5_hash"), ("ACC1|GENEX|ISO_2|liver", "GENEX", "tissue", None, None, "isoform_db"), ("plain", "ABC", "text GN=ABC", None, None, "unknown"),
]


def sql_text(x):
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query("header_ladder", "WITH f(k, accession, gene, description, organism, variant, source) AS (VALUES " + ", ".join(f"({k}, " + ", ".join(map(sql_text, f)) + ")" for k, f in enumerate(FIELDS)) + f") SELECT page_id, accession, gene, description, organism, variant, source FROM pages JOIN f ON k = page_id % {len(HEADERS)}")
def header_ladder(spark, sf):
    header = F.element_at(F.array(*[F.lit(h) for h in HEADERS]), (F.col("page_id") % len(HEADERS)).cast("int") + 1)
    return table(spark, sf, "pages").select("page_id", S.ladder_fields(header).alias("f")).select("page_id", "f.*")


@query("gene_symbols", """
WITH w AS (SELECT doc_id, unnest(list_distinct(string_split(coalesce(text, ''), ' '))) AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id, count(*) FILTER (w <> '' AND NOT contains(w, '|') AND length(w) <= 20 AND NOT regexp_full_match(w, '[A-Z][0-9][A-Z0-9]{3,}') AND NOT regexp_matches(w, '^ENS[PTG]')) AS n FROM w GROUP BY 1""")
def gene_symbols(spark, sf):
    own = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    words = own.select("doc_id", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), " "))).alias("w"))
    return words.groupBy("doc_id").agg(F.count_if(S.is_gene_symbol("w")).alias("n"))
