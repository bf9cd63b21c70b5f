"""Mass-tolerant searches: windows of whole benchmark texts are predictions of their item, documents are targets.

Letters that are no residues stand for residues; in windows at odd places two residues are exchanged, as a sequencing
error that keeps the mass.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import sequence as S
from evidra.operators import massindex
from evidra.plans.evidence_queries import places_sql, table

QUERIES, ORACLES = {}, {}
LETTERS, RESIDUES = "BJOUXZ", "KLEAVF"
LENGTH, LEAST, TOP = 12, 4, 0.3


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def residues(text):
    return F.translate(S.normalize_sequence(text), LETTERS, RESIDUES)


def targets(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("target"), residues("text").alias("sequence"))


def predictions(spark, sf):
    """sample, peptide, score (share of distinct residues) of windows and of the last residues of each text."""
    own = table(spark, sf, "benchmark").select(F.col("item_id").alias("sample"), residues("text").alias("t")).where(F.length("t") >= LENGTH)
    pieces = F.concat(F.filter(S.windows("t", LENGTH), lambda p: F.length(p) == LENGTH), F.array(F.expr(f"right(t, {LENGTH})")))
    rows = own.select("sample", F.posexplode(pieces).alias("k", "p"))
    swapped = F.concat(F.substring("p", 1, 5), F.substring("p", 7, 1), F.substring("p", 6, 1), F.expr("substr(p, 8)"))
    rows = rows.select("sample", F.when(F.col("k") % 2 == 1, swapped).otherwise(F.col("p")).alias("peptide"))
    return rows.withColumn("score", F.size(F.array_distinct(S.characters(F.col("peptide")))) / float(LENGTH))


def _residue_sql(text):
    return f"translate(upper(regexp_replace({text}, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{RESIDUES}')"


_UNITS = ", ".join(str(round(S.RESIDUE_MASS.get(chr(65 + k), 0) * massindex.UNIT)) for k in range(26))


def mass_sql(text, length):
    """Millionths of a dalton of `length` letters."""
    return "(" + " + ".join(f"([{_UNITS}])[ascii(substr({text}, {k}, 1)) - 64]" for k in range(1, length + 1)) + ")"


_SEQUENCES = f"s AS (SELECT doc_id, {_residue_sql('text')} AS sequence FROM documents)"
_PREDICTIONS = f"""b AS (SELECT item_id, {_residue_sql('text')} AS t FROM benchmark),
pw AS (SELECT item_id, unnest(range(0, len(ps))) AS k, unnest(ps) AS p FROM (SELECT item_id, list_append([substr(t, 1 + {LENGTH} * k, {LENGTH}) FOR k IN range(0, length(t) // {LENGTH})], right(t, {LENGTH})) AS ps FROM b WHERE length(t) >= {LENGTH})),
pp AS (SELECT item_id AS sample, CASE WHEN k % 2 = 1 THEN substr(p, 1, 5) || substr(p, 7, 1) || substr(p, 6, 1) || substr(p, 8) ELSE p END AS peptide FROM pw),
pd AS (SELECT *, len(list_distinct(string_split(peptide, ''))) / {LENGTH}.0::DOUBLE AS score, list_max([length(peptide) - length(replace(peptide, r, '')) FOR r IN list_distinct(string_split(peptide, ''))]) AS common FROM pp),
po AS (SELECT sample, peptide, score FROM pd WHERE common * 2 <= {LENGTH})"""
_SAMPLES = f"""pr AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, peptide) AS rn, count(*) OVER (PARTITION BY sample) AS n FROM po),
ps AS (SELECT sample, peptide, max(score) AS score FROM pr WHERE rn <= ceil(n * {TOP}::DOUBLE) GROUP BY ALL)"""
_EXACT = f"""{places_sql(LENGTH)},
h AS (SELECT DISTINCT doc_id, peptide AS folded FROM (SELECT doc_id, translate(peptide, 'I', 'L') AS peptide FROM x) JOIN (SELECT DISTINCT translate(peptide, 'I', 'L') AS peptide FROM ps) USING (peptide)),
mt AS (SELECT DISTINCT peptide FROM ps WHERE translate(peptide, 'I', 'L') IN (SELECT folded FROM h))"""


def _votes_sql(queries, bin_of, least=LEAST):
    """v(peptide, doc_id, start, votes) of queries(peptide) against s(doc_id, sequence); bin_of: SQL of a mass."""
    return f"""ch5 AS (SELECT doc_id, 1000 * c AS base, substr(sequence, 1 + 1000 * c, 1004) AS piece FROM (SELECT doc_id, sequence, unnest(range(0, (length(sequence) + 999) // 1000)) AS c FROM s)),
x5 AS (SELECT doc_id, base + i AS place, substr(piece, 1 + i, 5) AS mer FROM (SELECT *, unnest(range(0, least(1000, length(piece) - 4))) AS i FROM ch5)),
m5 AS (SELECT mer, {bin_of(mass_sql('mer', 5))} AS bin FROM (SELECT DISTINCT mer FROM x5)),
qk AS (SELECT peptide, o, {bin_of(mass_sql('mer', 5))} AS bin FROM (SELECT peptide, o, substr(peptide, 1 + o, 5) AS mer FROM (SELECT peptide, unnest(range(0, length(peptide) - 4)) AS o FROM {queries}))),
qm AS (SELECT DISTINCT peptide, o, mer FROM (SELECT peptide, o, unnest([bin - 1, bin, bin + 1]) AS bin FROM qk) JOIN m5 USING (bin)),
v AS (SELECT peptide, doc_id, place - o AS start, count(*) AS votes FROM x5 JOIN qm USING (mer) WHERE place >= o GROUP BY ALL HAVING count(*) >= {least})"""


_FLOOR = lambda mass: f"greatest({mass} - 280000000, 0) // 1000"
_NEAREST = lambda mass: f"({mass} + 500) // 1000"


def window_votes_sql(length, least):
    """Anchors of all windows of `length` residues of benchmark texts, their other letters left out, among these texts."""
    return f"""WITH s AS (SELECT item_id AS doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^{''.join(S.RESIDUE_MASS)}]', '', 'g') AS sequence FROM benchmark),
qw AS (SELECT doc_id || '/' || k AS query, substr(sequence, 1 + {length} * k, {length}) AS peptide FROM (SELECT *, unnest(range(0, length(sequence) // {length})) AS k FROM s)),
an AS (SELECT DISTINCT peptide, {mass_sql('peptide', length)} / {massindex.UNIT}.0 + {massindex.WATER} AS mass FROM qw), {_votes_sql('an', _NEAREST, least)},
sp AS (SELECT peptide, doc_id, start, votes, mass, n, substr(sequence, start + 1, n) AS w FROM (SELECT v.*, mass, unnest(range({length - 2}, {length + 3})) AS n FROM v JOIN an USING (peptide)) JOIN s USING (doc_id) WHERE start + n <= length(sequence)),
er AS (SELECT *, abs(list_sum([([{_UNITS}])[ascii(c) - 64] FOR c IN string_split(w, '')]) / {massindex.UNIT}.0 + {massindex.WATER} - mass) / mass * 1e6 AS ppm FROM sp),
best AS (SELECT *, row_number() OVER (PARTITION BY peptide ORDER BY votes DESC, round(ppm * 100), doc_id, start, n) AS rn FROM er WHERE ppm <= {massindex.PPM})
SELECT query, doc_id AS target, CAST(start AS INTEGER) AS start, CAST(n AS INTEGER) AS length, votes, round(ppm, 6) AS error_ppm FROM best JOIN qw USING (peptide) WHERE rn = 1"""


_RESCUE = f"""WITH {_SEQUENCES}, {_PREDICTIONS}, {_SAMPLES}, {_EXACT},
mi AS (SELECT DISTINCT peptide FROM ps WHERE peptide NOT IN (SELECT peptide FROM mt)), {_votes_sql('mi', _FLOOR)},
best AS (SELECT peptide, doc_id AS target, votes FROM (SELECT *, row_number() OVER (PARTITION BY peptide ORDER BY votes DESC, doc_id, start) AS rn FROM v) WHERE rn = 1),
re AS (SELECT sample, peptide, target, votes, {LENGTH - 4}::BIGINT AS n_kmers, score FROM ps JOIN best USING (peptide))"""


def _prepared(spark, sf):
    return massindex.prepare(predictions(spark, sf), targets(spark, sf), TOP)


@query("rescue_manifest", f"""WITH {_PREDICTIONS}, {_SAMPLES} SELECT sample, any_value(n) AS n_peptides, count(DISTINCT peptide) FILTER (rn <= ceil(n * {TOP}::DOUBLE)) AS n_pooled FROM pr GROUP BY sample""")
def rescue_manifest(spark, sf):
    """What the first phase takes from each sample."""
    made = _prepared(spark, sf)
    return made.manifest.join(made.samples.groupBy("sample").agg(F.count(F.lit(1)).alias("n_pooled")), "sample")


@query("mass_rescue", f"{_RESCUE} SELECT sample, peptide, target, votes, n_kmers, round(score, 9) AS score FROM re")
def mass_rescue(spark, sf):
    own = targets(spark, sf)
    made = massindex.prepare(predictions(spark, sf), own, TOP)
    got = massindex.rescue(massindex.write_index(own), made, LEAST)
    return got.withColumn("score", F.round("score", 9))


@query("mass_rescue_lake", f"""{_RESCUE}, g AS (SELECT DISTINCT target FROM re), hh AS (SELECT DISTINCT doc_id AS target FROM h)
SELECT coalesce(hh.target, g.target) AS target, CASE WHEN g.target IS NULL THEN 'exact' WHEN hh.target IS NULL THEN 'rescued' ELSE 'both' END AS origin FROM hh FULL JOIN g ON hh.target = g.target""")
def mass_rescue_lake(spark, sf):
    """The evidence lake with rescued targets. Two halves of the targets have indexes of their own, whose votes merge."""
    own = targets(spark, sf)
    made = massindex.prepare(predictions(spark, sf), own, TOP)
    halves = [own.where(f"pmod(xxhash64(target), 2) = {k}") for k in (0, 1)]
    return massindex.enhanced(made, massindex.merged(*[massindex.rescue(massindex.write_index(half), made, LEAST) for half in halves]))


@query("mass_anchors", f"""WITH {_SEQUENCES}, {_PREDICTIONS}, an AS (SELECT peptide, max(score) AS score, ({mass_sql('peptide', LENGTH)}) / {massindex.UNIT}.0 + {massindex.WATER} AS mass FROM po GROUP BY peptide), {_votes_sql('an', _NEAREST)},
sp AS (SELECT peptide, doc_id, start, votes, mass, n, substr(sequence, start + 1, n) AS w FROM (SELECT v.*, mass, unnest(range({LENGTH - 2}, {LENGTH + 3})) AS n FROM v JOIN an USING (peptide)) JOIN s USING (doc_id) WHERE start + n <= length(sequence)),
er AS (SELECT *, abs(list_sum([([{_UNITS}])[ascii(c) - 64] FOR c IN string_split(w, '')]) / {massindex.UNIT}.0 + {massindex.WATER} - mass) / mass * 1e6 AS ppm FROM sp)
SELECT peptide AS query, doc_id AS target, CAST(start AS INTEGER) AS start, CAST(n AS INTEGER) AS length, votes, round(ppm, 6) AS error_ppm
FROM (SELECT *, row_number() OVER (PARTITION BY peptide ORDER BY votes DESC, round(ppm * 100), doc_id, start, n) AS rn FROM er WHERE ppm <= {massindex.PPM}) WHERE rn = 1""")
def mass_anchors(spark, sf):
    """Every searchable window with its theoretical mass."""
    asked = massindex.anchors(predictions(spark, sf).select(F.col("peptide").alias("sequence"), "score"))
    index = massindex.write_index(targets(spark, sf), rule="nearest")
    got = massindex.anchored(index, asked.select("query", "sequence", "mass"), LEAST)
    return got.select("query", "target", "start", "length", "votes", F.round("error_ppm", 6).alias("error_ppm"))
