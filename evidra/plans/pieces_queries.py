"""Queries on pieces with a ledger, sampled controls, sorted files, lineages from files and search arms.

For arms, order keys spelt in residues are peptides and part keys with a P proteins; a protein's sequence is made of
the peptides of its lines whose tax is at most 6 %, so that some reported members lack their peptide.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import sequence as S
from evidra.operators import arms, graph, inference, matching, pieces, ranking, sampling
from evidra.plans import evidence_queries
from evidra.plans.evidence_queries import SEQ, edges, sequences, table, whole_windows
from evidra.plans.file_queries import place, records
from evidra.plans.study_queries import spelt
from evidra.sources import readers, sinks

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


@query("evidence_in_pieces", evidence_queries.ORACLES["evidence"])
def evidence_in_pieces(spark, sf):
    """The evidence of all documents, three pieces of them one after the other, each with a receipt."""
    predictions = whole_windows(spark, sf, 20).select(F.col("item_id").alias("sample"), "peptide", (F.size(F.array_distinct(S.characters(F.col("peptide")))) / 20.0).alias("score"))
    kept = ranking.top_fraction(predictions, ["sample"], "score", 0.6)
    samples = table(spark, sf, "benchmark").count()

    def step(part):
        return matching.evidence(matching.substring_join(kept.select("peptide").distinct(), part, seed=20), kept, samples)

    got, _ = pieces.run(spark, place(spark, "pieces"), sequences(spark, sf).select(F.col("doc_id").alias("protein"), "sequence"), "protein", step, kept, 3)
    return got.select("protein", "n_hits", "n_peptides", "n_samples", *[F.round(c, 6).alias(c) for c in ("mean_score", "max_score", "support")])


@query("razor_in_pieces", evidence_queries.ORACLES["razor"])
def razor_in_pieces(spark, sf):
    """Edges are gathered in pieces of order lines; the choice is made on their union."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    step = lambda part: part.select(F.col("l_orderkey").alias("peptide"), F.col("l_partkey").alias("protein")).distinct()
    got, _ = pieces.run(spark, place(spark, "pieces"), lines, "l_orderkey", step, edges(spark, sf).limit(0), 4)
    return graph.razor(got)


@query("piece_ledger", "SELECT 5::BIGINT AS pieces, count(*) AS records, count(*) FILTER (l_discount <= 0.05) AS rows FROM lineitem")
def piece_ledger(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    _, summary = pieces.run(spark, place(spark, "pieces"), lines, "l_orderkey", lambda part: part.where("l_discount <= 0.05"), lines.limit(0), 5)
    return pieces.counted(summary, spark)


@query("sampled_controls")
def sampled_controls(spark, sf):
    """Shuffled copies of one document in ten, by one generator."""
    own = sequences(spark, sf).where("sequence <> ''").select("doc_id", "sequence")
    got = sampling.shuffled_sample(own, ["doc_id"], own.count() // 10, 42)
    return got.select("control", "doc_id", F.sha2("sequence", 256).alias("h"), F.length("sequence").cast("bigint").alias("n"))


@query("control_rate")
def control_rate(spark, sf):
    """How often windows of benchmark texts stand in shuffled copies of documents."""
    own = sequences(spark, sf).where("sequence <> ''").select("doc_id", "sequence")
    controls = sampling.shuffled_sample(own, ["doc_id"], own.count() // 10, 42).select("control", "sequence")
    return sampling.control_rate(whole_windows(spark, sf, 8).select("peptide"), controls)


@query("fasta_sorted", f"""WITH {SEQ}, r AS (SELECT 'D' || doc_id AS accession, sequence, length('>D' || doc_id) + 2 + length(sequence) + (length(sequence) - 1) // 60 AS bytes FROM s WHERE sequence <> '')
SELECT accession, bytes, sha256(sequence) AS h, (SELECT count(*) FROM r) AS n, (SELECT CAST(sum(bytes) AS BIGINT) FROM r) AS total FROM r""")
def fasta_sorted(spark, sf):
    """Written in order of accessions and read back; the index has each record's size and, by its parts, all bytes."""
    path = place(spark, "sorted")
    index = sinks.write_sorted_fasta(records(spark, sf).select("accession", "sequence"), path)
    ends = index.groupBy("part").agg(F.max(F.col("offset") + F.col("bytes")).alias("end"), F.count(F.lit(1)).alias("n"))
    whole = ends.agg(F.sum("n").alias("n"), F.sum("end").alias("total"))
    got = readers.fasta(spark, f"{path}/parts", strict=True).join(index, "accession")
    return got.crossJoin(F.broadcast(whole)).select("accession", "bytes", F.sha2("sequence", 256).alias("h"), "n", "total")  # one row


_NAMES = "l AS (SELECT c_custkey, translate('1' || c_custkey || '0123456', '0123456789', 'ACDEFGHKLM') AS peptide, n_nationkey + 10 AS nation, n_name, r_regionkey + 100 AS region, r_name, c_custkey % 5 AS kind FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


def _asked(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    own = table(spark, sf, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    peptide = F.translate(F.concat(F.lit("1"), F.col("c_custkey").cast("string"), F.lit("0123456")), "0123456789", "ACDEFGHKLM")
    return own.select("c_custkey", peptide.alias("peptide"), (F.col("n_nationkey") + 10).alias("nation"), "n_name", (F.col("r_regionkey") + 100).alias("region"), "r_name", (F.col("c_custkey") % 5).alias("kind"))


@query("lineage_read", f"""WITH {_NAMES}
SELECT peptide, CASE WHEN kind = 4 THEN 'not_returned' WHEN kind = 3 THEN 'lookup_cutoff' WHEN kind = 2 THEN 'unresolved' ELSE 'assigned' END AS status,
  CASE kind WHEN 0 THEN nation WHEN 1 THEN region WHEN 2 THEN 1 WHEN 3 THEN c_custkey + 1000 END AS taxon_id,
  CASE kind WHEN 0 THEN 'domain:' || region || ':' || r_name || '/phylum:' || nation || ':' || n_name WHEN 1 THEN 'domain:' || region || ':' || r_name WHEN 3 THEN 'domain:' || region || ':' || r_name || '/phylum:' || nation || ':' || n_name || '/clade:' || (c_custkey + 1000) || ':C' ELSE '' END AS lineage FROM l""")
def lineage_read(spark, sf):
    """Customers are peptides, their region and nation the lineage; answers are at the nation, the region, the root or
    a clade below, and some are missing."""
    own = _asked(spark, sf)
    kind = F.col("kind")
    shown = kind.isin(0, 1, 3)
    rows = own.where("kind < 4").select(
        "peptide", F.when(kind == 0, F.col("nation")).when(kind == 1, F.col("region")).when(kind == 2, 1).otherwise(F.col("c_custkey") + 1000).alias("taxon_id"),
        F.when(kind == 0, F.col("n_name")).when(kind == 1, F.col("r_name")).when(kind == 2, "root").otherwise("C").alias("taxon_name"),
        F.when(kind == 0, "phylum").when(kind == 1, "superkingdom").when(kind == 2, "no rank").otherwise("clade").alias("taxon_rank"),
        F.when(shown, F.col("region")).otherwise(0).alias("superkingdom_id"), F.when(shown, F.col("r_name")).otherwise("").alias("superkingdom_name"),
        F.when(kind.isin(0, 3), F.col("nation")).otherwise(0).alias("phylum_id"), F.when(kind.isin(0, 3), F.col("n_name")).otherwise("").alias("phylum_name"),
        F.lit(0).alias("genus_id"), F.lit(0).alias("species_id"), (kind == 3).alias("cutoff_used"),
    )
    path = place(spark, "lineages")
    sinks.write_json(rows, path)
    got = readers.lineage_answers(spark, path, own.select("peptide"), "lines")
    shown = F.transform("lineage", lambda e: F.concat_ws(":", e["rank"], e["id"].cast("string"), e["name"]))
    return got.select("peptide", "status", "taxon_id", F.array_join(shown, "/").alias("lineage"))


_ARM = """p AS (SELECT *, translate(CAST(l_orderkey AS VARCHAR), '0123456789', 'ACDEFGHIKM') AS peptide, translate(CAST(l_orderkey AS VARCHAR), '0123456789', 'ACDEFGHLKM') AS canonical FROM lineitem),
r AS (SELECT l_partkey, coalesce(string_agg(peptide, '' ORDER BY peptide) FILTER (l_tax <= 0.06), '') AS sequence FROM (SELECT DISTINCT l_partkey, peptide, l_tax FROM p) GROUP BY 1),
m AS (SELECT p.*, CASE WHEN l_returnflag = 'R' THEN 'not_target' WHEN l_discount > 0.05 THEN 'above_q' WHEN NOT contains(translate(sequence, 'I', 'L'), canonical) THEN 'not_contained' ELSE 'accepted' END AS reason FROM p JOIN r USING (l_partkey))"""


def _arm(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("peptide", spelt("l_orderkey"))
    named = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    parts = lines.select("l_partkey", "peptide", "l_tax").distinct().groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("l_tax") <= 0.06, F.col("peptide")))), "").alias("sequence"))
    known = parts.select(named.alias("accession"), "sequence")
    psms = lines.select("l_orderkey", "l_linenumber", "peptide", named.alias("proteins"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("label"), F.col("l_discount").alias("peptide_q"), F.lit("raw/run1").alias("filename"))
    features = lines.select("l_orderkey", "l_linenumber", "peptide", F.col("l_linenumber").alias("charge"), named.alias("proteins"), F.when(F.col("l_quantity") > 10, F.col("l_extendedprice")).when(F.col("l_quantity") > 5, F.lit(0.0)).alias("intensity"))
    return arms.load_arm(psms, features, known, "run1", 0.05, strict=False)


@query("arm_rows", f"WITH {_ARM} SELECT l_orderkey, l_linenumber, reason FROM m")
def arm_rows(spark, sf):
    """Every row of a search with the reason why it isn't accepted."""
    return _arm(spark, sf).psms.select("l_orderkey", "l_linenumber", F.coalesce("reason", F.lit("accepted")).alias("reason"))


@query("arm_features", f"""WITH {_ARM}, a AS (SELECT DISTINCT canonical FROM m WHERE reason = 'accepted'),
f AS (SELECT m.l_orderkey, m.l_linenumber, CASE WHEN a.canonical IS NULL THEN 'not_accepted' WHEN l_quantity <= 5 THEN 'missing' WHEN l_quantity <= 10 THEN 'nonpositive' WHEN NOT contains(translate(sequence, 'I', 'L'), m.canonical) THEN 'not_contained' END AS reason, m.peptide FROM m JOIN r USING (l_partkey) LEFT JOIN a ON a.canonical = m.canonical)
SELECT l_orderkey, l_linenumber, coalesce(reason, CASE WHEN count(*) FILTER (reason IS NULL) OVER (PARTITION BY peptide, l_linenumber) > 1 THEN 'repeated_feature' END, 'accepted') AS reason FROM f""")
def arm_features(spark, sf):
    return _arm(spark, sf).features.select("l_orderkey", "l_linenumber", F.coalesce("reason", F.lit("accepted")).alias("reason"))


@query("arm_counts", f"WITH {_ARM} SELECT reason, count(*) AS n FROM m GROUP BY reason")
def arm_counts(spark, sf):
    return arms.conserved(_arm(spark, sf).psms)


@query("arm_support", f"WITH {_ARM} SELECT sha256(sequence) AS seq_hash, canonical AS peptide, true AS unique FROM m JOIN r USING (l_partkey) WHERE reason = 'accepted' GROUP BY ALL")
def arm_support(spark, sf):
    return _arm(spark, sf).support


_FOLDED = "translate(peptide, 'I', 'L')"
_INFERRED = f"""{SEQ}, {evidence_queries.windows_sql(12)}, {evidence_queries.places_sql(12)},
pe AS (SELECT {_FOLDED} AS peptide, max(len(list_distinct(string_split(peptide, ''))) / 12.0::DOUBLE) AS score FROM w GROUP BY 1),
e AS (SELECT DISTINCT pe.peptide, doc_id AS protein FROM x JOIN pe ON {_FOLDED.replace('peptide', 'x.peptide')} = pe.peptide),
g AS (SELECT peptide, count(*) AS degree FROM e GROUP BY peptide),
c AS (SELECT protein, count(*) FILTER (degree = 1) AS n_unique, count(*) AS n_total FROM e JOIN g USING (peptide) GROUP BY protein),
z AS (SELECT DISTINCT protein FROM (SELECT protein, row_number() OVER (PARTITION BY peptide ORDER BY n_unique DESC, n_total DESC, protein) AS rn FROM e JOIN c USING (protein)) WHERE rn = 1)"""


def _inferred(spark, sf, **options):
    own = whole_windows(spark, sf, 12).select("peptide", (F.size(F.array_distinct(S.characters(F.col("peptide")))) / 12.0).alias("score"))
    return inference.infer(own, sequences(spark, sf).select(F.col("doc_id").alias("protein"), "sequence"), **options)


@query("inference_run", f"""WITH {_INFERRED} SELECT 'razor' AS strategy, (SELECT count(*) FROM s) AS n_proteins, (SELECT count(*) FROM pe) AS n_peptides, (SELECT count(DISTINCT peptide) FROM e) AS n_matched,
  (SELECT count(DISTINCT protein) FROM e) AS n_candidates, (SELECT count(*) FROM z) AS n_selected, round((SELECT count(*) FROM s) / (SELECT count(*) FROM z), 8) AS reduction_factor""")
def inference_run(spark, sf):
    """Windows of benchmark texts are the sample's peptides, documents its proteins."""
    return _inferred(spark, sf).stats.drop("n_rescued", "n_rescued_new").withColumn("reduction_factor", F.round("reduction_factor", 8))


@query("inference_selected", f"WITH {_INFERRED} SELECT z.protein, sha256(sequence) AS h, n_total AS n_peptides FROM z JOIN s ON doc_id = z.protein JOIN c ON c.protein = z.protein")
def inference_selected(spark, sf):
    """Written as files and read back with the provenance."""
    path = place(spark, "inference")
    made = _inferred(spark, sf)
    inference.write(made, path)
    got = readers.fasta(spark, f"{path}/selected/parts", strict=True).select(F.col("accession").cast("bigint").alias("protein"), F.sha2("sequence", 256).alias("h"))
    return got.join(spark.read.json(f"{path}/provenance").select("protein", "n_peptides"), "protein")
