"""Queries on sequences, ranking, matching, selection and studies over the driver's tables.

Roles: lineitem order keys are peptides, part keys proteins, supplier keys samples, extended prices intensities,
discounts q-values; events are scored predictions; letters of document texts are sequences; parts carry species.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import sequence as S
from evidra.operators.lineage import cut
from evidra.operators import compare, control, graph, lake, matching, network, ranking, rollup, study

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def matches(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("peptide"), F.col("l_partkey").alias("protein"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf).distinct()


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "lang", S.normalize_sequence("text").alias("sequence"))


EDGES = "e AS (SELECT DISTINCT l_orderkey AS peptide, l_partkey AS protein FROM lineitem)"
DEGREE = "g AS (SELECT peptide, count(*) AS degree FROM e GROUP BY peptide)"
COUNTS = "c AS (SELECT protein, count(*) FILTER (degree = 1) AS n_unique, count(*) AS n_total FROM e JOIN g USING (peptide) GROUP BY protein)"
SEQ = "s AS (SELECT doc_id, source, lang, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents)"


def fnv_sql(text: str) -> str:
    """The 64-bit FNV-1a hash of the UTF-8 bytes of `text`."""
    octets = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS HUGEINT))"
    return f"list_reduce(list_concat([14695981039346656037::HUGEINT], {octets}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


def expectation_sql(rounds: int = 10) -> str:
    """The rounds of the expectation maximisation, one after the other; early stops change less than is printed."""
    made = """w AS (SELECT l_orderkey AS peptide, max(l_quantity) / 50 AS score FROM lineitem GROUP BY 1), n AS (SELECT p_partkey AS protein, sqrt(greatest(p_size * 20, 50)::DOUBLE) AS norm FROM part),
x AS (SELECT e.peptide, e.protein, score FROM e JOIN w USING (peptide)),
b0 AS (SELECT protein, sum(score / degree) / any_value(norm) AS a FROM x JOIN g USING (peptide) JOIN n USING (protein) GROUP BY protein), a0 AS (SELECT protein, a / (SELECT max(a) FROM b0) AS a FROM b0)"""
    for k in range(rounds):
        made += f""",
s{k} AS (SELECT peptide, sum(a) AS t FROM x JOIN a{k} USING (protein) GROUP BY peptide),
b{k + 1} AS (SELECT protein, sum(score * a / t) / any_value(norm) AS a FROM x JOIN a{k} USING (protein) JOIN s{k} USING (peptide) JOIN n USING (protein) WHERE t > 0 GROUP BY protein), a{k + 1} AS MATERIALIZED (SELECT protein, a / (SELECT max(a) FROM b{k + 1}) AS a FROM b{k + 1})"""
    return f"WITH {EDGES}, {DEGREE}, {made} SELECT protein, round(a, 6) AS abundance FROM a{rounds} WHERE a >= 0.01"


def windows_sql(n: int) -> str:
    """w(item_id, peptide), as whole_windows gives it."""
    return f"""b AS (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS t FROM benchmark),
w AS (SELECT item_id, unnest(list_distinct(list_append([substr(t, 1 + {n} * k, {n}) FOR k IN range(0, length(t) // {n})], right(t, {n})))) AS peptide FROM b WHERE length(t) >= {n})"""


def places_sql(n: int) -> str:
    """x(doc_id, position, peptide): every place of whole sequences with its n letters; in chunks, as substr counts from the start."""
    return f"""ch AS (SELECT doc_id, 1000 * c AS base, substr(sequence, 1 + 1000 * c, 1000 + {n - 1}) AS piece FROM (SELECT doc_id, sequence, unnest(range(0, (length(sequence) + 999) // 1000)) AS c FROM s)),
x AS (SELECT doc_id, CAST(base + i AS INTEGER) AS position, substr(piece, 1 + i, {n}) AS peptide FROM (SELECT *, unnest(range(0, least(1000, length(piece) - {n - 1}))) AS i FROM ch))"""


def whole_windows(spark, sf, n):
    """item_id, peptide: consecutive windows of n letters of whole benchmark texts and the last n letters of each."""
    letters = table(spark, sf, "benchmark").select("item_id", S.normalize_sequence("text").alias("t")).where(F.length("t") >= n)
    pieces = F.concat(F.filter(S.windows("t", n), lambda p: F.length(p) == n), F.array(F.expr(f"right(t, {n})")))
    return letters.select("item_id", F.explode(F.array_distinct(pieces)).alias("peptide"))


@query("evidence", f"""
WITH {SEQ}, {windows_sql(20)}, {places_sql(20)},
q AS (SELECT item_id AS sample, peptide, len(list_distinct(string_split(peptide, ''))) / 20.0 AS score FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC) AS rn, count(*) OVER (PARTITION BY sample) AS all_n FROM q),
cut AS (SELECT sample, min(score) AS edge FROM n WHERE rn <= ceil(0.6::DOUBLE * all_n) GROUP BY sample),
k AS (SELECT q.* FROM q JOIN cut USING (sample) WHERE score >= edge),
d AS (SELECT DISTINCT peptide FROM k),
e AS (SELECT doc_id AS protein, peptide, count(*) AS n FROM x JOIN d USING (peptide) GROUP BY ALL),
m AS (SELECT peptide, max(score) AS score FROM k GROUP BY peptide),
y AS (SELECT protein, count(DISTINCT sample) AS n_samples FROM e JOIN k USING (peptide) GROUP BY protein)
SELECT protein, CAST(sum(n) AS BIGINT) AS n_hits, count(*) AS n_peptides, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score, any_value(n_samples) AS n_samples,
       round(least(1.0, log2(count(*) + 1.0) * sqrt(any_value(n_samples) / (SELECT count(*) FROM benchmark)) * avg(score)), 6) AS support
FROM e JOIN m USING (peptide) JOIN y USING (protein) GROUP BY protein""")
def evidence(spark, sf):
    """Patterns are windows of whole texts; a window's score is its share of distinct letters, wherever it stands."""
    predictions = whole_windows(spark, sf, 20).select(F.col("item_id").alias("sample"), "peptide", (F.size(F.array_distinct(S.characters(F.col("peptide")))) / 20.0).alias("score"))
    kept = cut(ranking.top_fraction(predictions, ["sample"], "score", 0.6))
    hits = matching.substring_join(kept.select("peptide").distinct(), sequences(spark, sf).select(F.col("doc_id").alias("protein"), "sequence"), seed=20)
    got = matching.evidence(hits, kept, table(spark, sf, "benchmark").count())
    return got.select("protein", "n_hits", "n_peptides", "n_samples", *[F.round(c, 6).alias(c) for c in ("mean_score", "max_score", "support")])


PATTERNS = f"{windows_sql(12)}, d AS (SELECT DISTINCT peptide FROM w)"


@query("substring_join", f"WITH {SEQ}, {PATTERNS}, {places_sql(12)} SELECT peptide, doc_id, position FROM x JOIN d USING (peptide)")
def substring_join(spark, sf):
    return matching.substring_join(whole_windows(spark, sf, 12).select("peptide").distinct(), sequences(spark, sf).select("doc_id", "sequence"), seed=12)


@query("include_unmatched", f"""
WITH {SEQ}, {PATTERNS}, {places_sql(12)}, m AS (SELECT DISTINCT doc_id FROM x JOIN d USING (peptide))
SELECT DISTINCT doc_id, doc_id NOT IN (SELECT doc_id FROM m) AS included FROM s""")
def include_unmatched(spark, sf):
    """All documents: matched ones, and all others as included."""
    matched = substring_join(spark, sf).select("doc_id").distinct()
    extra = sequences(spark, sf).select("doc_id").distinct().join(matched, "doc_id", "left_anti")
    return matched.withColumn("included", F.lit(False)).unionByName(extra.withColumn("included", F.lit(True)))


@query("sequence_scalars", """
WITH s AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents)
SELECT doc_id, sha256(sequence) AS seq_hash, length(sequence) AS length, sha256(translate(sequence, 'I', 'L')) AS folded_hash,
       length(regexp_replace(sequence, '[ACDEFGHIKLMNPQRSTVWYUO]', '', 'g')) / CASE WHEN length(sequence) = 0 THEN NULL ELSE length(sequence) END AS noncanonical,
       regexp_matches(sequence, 'A{3}|B{3}|C{3}|D{3}|E{3}|F{3}|G{3}|H{3}|I{3}|J{3}|K{3}|L{3}|M{3}|N{3}|O{3}|P{3}|Q{3}|R{3}|S{3}|T{3}|U{3}|V{3}|W{3}|X{3}|Y{3}|Z{3}') AS poly,
       length(sequence) = 0 OR (NOT starts_with(sequence, 'M') AND length(sequence) < 200) AS fragment,
       translate(regexp_replace(sequence, '\\*+$', ''), 'BJZ', 'XXX') AS cleaned
FROM s""")
def sequence_scalars(spark, sf):
    s = sequences(spark, sf)
    return s.select("doc_id", F.sha2("sequence", 256).alias("seq_hash"), F.length("sequence").cast("bigint").alias("length"), F.sha2(S.normalize_il("sequence"), 256).alias("folded_hash"), S.noncanonical_fraction("sequence").alias("noncanonical"), S.has_poly_run("sequence", 3).alias("poly"), S.is_fragment("sequence", 200).alias("fragment"), S.normalise_residues("sequence").sequence.alias("cleaned"))


@query("peptide_identity", """
SELECT DISTINCT event_type, '[+1]-' || upper(event_type) || '-I' AS raw, translate(replace(regexp_replace('[+1]-' || upper(event_type) || '-I', '\\[[^\\]]*\\]', '', 'g'), '-', ''), 'I', 'L') AS canonical FROM events""")
def peptide_identity(spark, sf):
    raw = F.concat(F.lit("[+1]-"), F.upper("event_type"), F.lit("-I"))
    return table(spark, sf, "events").select("event_type", raw.alias("raw"), S.canonical_peptide(raw).alias("canonical")).distinct()


@query("sequence_entropy", f"""
WITH {SEQ}, c AS (SELECT doc_id, sequence, length(sequence) AS n, unnest(string_split(sequence, '')) AS ch FROM s WHERE length(sequence) >= 2),
k AS (SELECT doc_id, any_value(n) AS n, ch, count(*) AS f FROM c WHERE ch <> '' GROUP BY doc_id, ch)
SELECT s.doc_id, coalesce(round(-sum((f / k.n) * log2(f / k.n)) / log2(20.0), 8), 0.0) AS entropy FROM s LEFT JOIN k ON s.doc_id = k.doc_id GROUP BY s.doc_id""")
def sequence_entropy(spark, sf):
    return sequences(spark, sf).select("doc_id", (F.round(S.sequence_entropy("sequence"), 8) + 0.0).alias("entropy"))


@query("low_complexity", f"""
WITH {SEQ}, w AS (SELECT doc_id, CAST(k AS INTEGER) AS k, substr(sequence, 1 + 12 * k, 12) AS p FROM (SELECT doc_id, sequence, unnest(range(0, (length(sequence) + 11) // 12)) AS k FROM s)),
c AS (SELECT doc_id, k, p, max(f) AS most, count(*) AS letters FROM (SELECT doc_id, k, p, ch, count(*) AS f FROM (SELECT *, unnest(string_split(p, '')) AS ch FROM w) WHERE ch <> '' GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, k, most > 0.6 * length(p) OR (length(p) = 12 AND letters <= 2) OR (length(p) >= 10 AND substr(repeat(substr(p, 1, 2), 6), 1, length(p)) = p) AS low FROM c""")
def low_complexity(spark, sf):
    """All windows of each sequence, the shorter last one as well."""
    pieces = sequences(spark, sf).select("doc_id", F.posexplode(S.windows("sequence", 12)).alias("k", "p"))
    return pieces.select("doc_id", "k", S.is_low_complexity("p").alias("low"))


@query("quality_cascade", f"""
WITH {SEQ}, r AS (SELECT CASE WHEN length(sequence) = 0 THEN 'empty' WHEN length(regexp_replace(sequence, '[ACDEFGHIKLMNPQRSTVWYUO]', '', 'g')) / length(sequence) > 0.05 THEN 'noncanonical'
  WHEN length(sequence) < 300 THEN 'short' WHEN length(sequence) > 10000 THEN 'long' ELSE 'kept' END AS reason FROM s)
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def quality_cascade(spark, sf):
    n = F.length("sequence")
    reason = F.when(n == 0, "empty").when(S.noncanonical_fraction("sequence") > 0.05, "noncanonical").when(n < 300, "short").when(n > 10000, "long").otherwise("kept")
    return sequences(spark, sf).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("digest_saturation", f"""
WITH {SEQ}, d AS (SELECT DISTINCT unnest(string_split_regex(regexp_replace(regexp_replace(sequence, '([KR])', '\\1|', 'g'), '\\|P', 'P', 'g'), '\\|')) AS p FROM s),
c AS (SELECT p FROM d WHERE regexp_full_match(p, '[ACDEFGHIKLMNPQRSTVWY]+'))
SELECT length(p) AS length, count(*) AS n_distinct, pow(20.0, length(p)) AS possible, round(count(*) / pow(20.0, length(p)), 12) AS saturation FROM c WHERE p <> '' GROUP BY length(p)""")
def digest_saturation(spark, sf):
    pieces = sequences(spark, sf).select(F.explode(S.tryptic("sequence")).alias("p")).where("p <> ''").distinct()
    possible = F.pow(F.lit(20.0), F.col("length"))
    return pieces.groupBy(F.length("p").cast("bigint").alias("length")).agg(F.count(F.lit(1)).alias("n_distinct")).select("length", "n_distinct", possible.alias("possible"), F.round(F.col("n_distinct") / possible, 12).alias("saturation"))


@query("mass_bins", """
WITH p AS (SELECT DISTINCT event_type, regexp_replace(upper(event_type), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM events),
m(r, w) AS (VALUES """ + ", ".join(f"('{r}', {w}::DOUBLE)" for r, w in S.RESIDUE_MASS.items()) + """),
c AS (SELECT event_type, s, unnest(string_split(s, '')) AS r FROM p)
SELECT event_type, s, CAST(round((sum(w) + 18.01056) / 0.01) AS BIGINT) AS bin FROM c JOIN m USING (r) GROUP BY ALL""")
def mass_bins(spark, sf):
    p = table(spark, sf, "events").select("event_type").distinct().withColumn("s", F.regexp_replace(F.upper("event_type"), "[^ACDEFGHIKLMNPQRSTVWY]", ""))
    return p.select("event_type", "s", S.mass_bin(S.theoretical_mass("s"), 0.01).alias("bin"))


@query("top_fraction", """
WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
t AS (SELECT user_id, min(value) AS edge FROM r WHERE rn <= greatest(1, ceil(0.1 * n)) GROUP BY user_id)
SELECT user_id, event_id, value FROM r JOIN t USING (user_id) WHERE value >= edge""")
def top_fraction(spark, sf):
    return ranking.top_fraction(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "value", 0.1)


@query("top_percent_positive", """
WITH p AS (SELECT event_type, event_id, value - 20 AS v FROM events WHERE value - 20 > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v DESC) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM p),
t AS (SELECT event_type, min(v) AS edge FROM r WHERE rn <= greatest(1, ceil(n * 5.0 / 100)) GROUP BY event_type)
SELECT event_type, event_id FROM r JOIN t USING (event_type) WHERE v >= edge""")
def top_percent_positive(spark, sf):
    own = table(spark, sf, "events").select("event_type", "event_id", (F.col("value") - 20).alias("v"))
    return ranking.top_percent_positive(own, ["event_type"], "v", 5.0).select("event_type", "event_id")


@query("peptide_scores", "SELECT event_type, max(value) AS best, count(DISTINCT user_id) AS n_samples FROM events GROUP BY event_type")
def peptide_scores(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.max("value").alias("best"), F.count_distinct("user_id").alias("n_samples"))


@query("threshold_fan_out", """
SELECT t.label AS threshold, l_suppkey, count(*) AS n FROM lineitem JOIN (VALUES ('0.01', 0.01), ('0.05', 0.05), ('unfiltered', 1.0)) t(label, q) ON l_discount <= t.q GROUP BY ALL""")
def threshold_fan_out(spark, sf):
    own = table(spark, sf, "lineitem").select("l_suppkey", "l_discount")
    return ranking.fan_out(own, "l_discount", [("0.01", 0.01), ("0.05", 0.05), ("unfiltered", 1.0)]).groupBy("threshold", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("degrees", f"WITH {EDGES}, {DEGREE}, {COUNTS} SELECT * FROM c")
def degrees(spark, sf):
    return graph.protein_counts(edges(spark, sf))


@query("razor", f"""
WITH {EDGES}, {DEGREE}, {COUNTS}, r AS (SELECT e.*, row_number() OVER (PARTITION BY peptide ORDER BY n_unique DESC, n_total DESC, protein) AS rn FROM e JOIN c USING (protein))
SELECT peptide, protein FROM r WHERE rn = 1""")
def razor(spark, sf):
    return graph.razor(edges(spark, sf))


@query("razor_hash", f"""
WITH {EDGES}, {DEGREE}, {COUNTS}, h AS (SELECT protein, {fnv_sql("CAST(protein AS VARCHAR)")} AS h FROM c),
r AS (SELECT e.*, row_number() OVER (PARTITION BY peptide ORDER BY n_unique DESC, n_total DESC, h, protein) AS rn FROM e JOIN c USING (protein) JOIN h USING (protein))
SELECT peptide, protein FROM r WHERE rn = 1""")
def razor_hash(spark, sf):
    return graph.razor(edges(spark, sf), "hash_acc")


@query("razor_scored", f"""
WITH {EDGES}, {DEGREE}, w AS (SELECT l_orderkey AS peptide, max(l_quantity) AS score FROM lineitem GROUP BY 1),
c AS (SELECT protein, round(sum(CASE WHEN degree = 1 THEN score ELSE 0 END), 9) AS sc, count(*) FILTER (degree = 1) AS u, count(*) AS t FROM e JOIN g USING (peptide) JOIN w USING (peptide) GROUP BY protein),
r AS (SELECT e.*, row_number() OVER (PARTITION BY peptide ORDER BY sc DESC, u DESC, t DESC, protein) AS rn FROM e JOIN c USING (protein))
SELECT peptide, protein FROM r WHERE rn = 1""")
def razor_scored(spark, sf):
    scores = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("peptide")).agg(F.max("l_quantity").alias("score"))
    return graph.razor_scored(edges(spark, sf), scores)


@query("razor_greedy")
def razor_greedy(spark, sf):
    return graph.razor_greedy(edges(spark, sf))


@query("uniform_2pep", f"WITH {EDGES} SELECT protein, count(*) AS n_peptides FROM e GROUP BY protein HAVING count(*) >= 2")
def uniform_2pep(spark, sf):
    return graph.uniform(edges(spark, sf), 2)


@query("info_score", f"""
WITH {EDGES}, {DEGREE}, w AS (SELECT l_orderkey AS peptide, max(l_quantity) / 50 AS score FROM lineitem GROUP BY 1)
SELECT protein, round(sum(score / degree), 6) AS info FROM e JOIN g USING (peptide) JOIN w USING (peptide) GROUP BY protein HAVING round(sum(score / degree), 9) >= 2""")
def info_score(spark, sf):
    scores = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("peptide")).agg((F.max("l_quantity") / 50).alias("score"))
    return graph.info_score(edges(spark, sf), scores, 2.0).select("protein", F.round("info", 6).alias("info"))


@query("species_budget", f"""
WITH {EDGES}, {DEGREE}, {COUNTS}, r AS (SELECT e.peptide, p_brand AS species, protein, row_number() OVER (PARTITION BY peptide, p_brand ORDER BY n_unique DESC, n_total DESC, protein) AS rn FROM e JOIN c USING (protein) JOIN part ON p_partkey = protein)
SELECT DISTINCT protein, species FROM r WHERE rn = 1""")
def species_budget(spark, sf):
    species = table(spark, sf, "part").select(F.col("p_partkey").alias("protein"), F.col("p_brand").alias("species"))
    return graph.species_budget(edges(spark, sf), species)


@query("credit_budget", f"""
WITH {EDGES}, {DEGREE}, w AS (SELECT l_orderkey AS peptide, max(l_quantity) / 50 AS score FROM lineitem GROUP BY 1), h AS (SELECT protein, {fnv_sql("CAST(protein AS VARCHAR)")} AS h FROM (SELECT DISTINCT protein FROM e)),
r AS (SELECT e.*, degree, greatest(1, ceil(least(degree, 10) * score * 12 / 24.0)) AS budget, row_number() OVER (PARTITION BY peptide ORDER BY h, protein) AS rn FROM e JOIN g USING (peptide) JOIN w USING (peptide) JOIN h USING (protein))
SELECT protein, count(*) AS credits, count(*) FILTER (degree = 1) AS n_unique FROM r WHERE rn <= budget GROUP BY protein""")
def credit_budget(spark, sf):
    scores = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("peptide")).agg((F.max("l_quantity") / 50).alias("score"))
    return graph.credit_budget(edges(spark, sf), scores, F.lit(18))


@query("expectation", expectation_sql())
def expectation(spark, sf):
    scores = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("peptide")).agg((F.max("l_quantity") / 50).alias("score"))
    lengths = table(spark, sf, "part").select(F.col("p_partkey").alias("protein"), (F.col("p_size") * 20).alias("length"))
    return graph.expectation(edges(spark, sf), scores, lengths).select("protein", F.round("abundance", 6).alias("abundance"))


@query("set_cover")
def set_cover(spark, sf):
    return graph.set_cover(matches(spark, sf))


@query("study_dictionary")
def study_dictionary(spark, sf):
    own = matches(spark, sf)
    return graph.dictionary(own, graph.set_cover(own))


@query("ambiguity", f"WITH {EDGES}, {DEGREE} SELECT degree AS n_proteins, count(*) AS n_peptides FROM g GROUP BY degree")
def ambiguity(spark, sf):
    return study.ambiguity(edges(spark, sf))


@query("group_matrix", "SELECT l_suppkey, l_partkey, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_discount <= 0.05 AND l_extendedprice > 0 GROUP BY ALL")
def group_matrix(spark, sf):
    got = study.group_matrix(table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_discount", "l_extendedprice"), ["l_suppkey", "l_partkey"], "l_discount", 0.05, "l_extendedprice")
    return got.withColumn("value", F.round("value", 2))


@query("wide_matrix", """
SELECT l_partkey, round(sum(l_extendedprice) FILTER (l_returnflag = 'A'), 2) AS a, round(sum(l_extendedprice) FILTER (l_returnflag = 'N'), 2) AS n, round(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 2) AS r FROM lineitem GROUP BY l_partkey""")
def wide_matrix(spark, sf):
    got = study.wide(table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice"), "l_partkey", "l_returnflag", "l_extendedprice", ["A", "N", "R"])
    return got.select("l_partkey", *[F.round(c, 2).alias(c.lower()) for c in ("A", "N", "R")])


@query("quantify", "SELECT l_suppkey, l_returnflag, count(DISTINCT l_orderkey) AS n_peptides, count(*) AS n_features, round(sum(l_extendedprice), 2) AS intensity FROM lineitem GROUP BY ALL")
def quantify(spark, sf):
    got = study.quantify(table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_extendedprice"), "l_suppkey", "l_returnflag", "l_orderkey", "l_extendedprice")
    return got.withColumn("intensity", F.round("intensity", 2))


@query("cross_sample", """
WITH m AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), k AS (SELECT count(DISTINCT l_suppkey) AS k FROM lineitem)
SELECT l_partkey, count(*) AS n_samples, round(count(*) / any_value(k), 8) AS completeness, round(avg(v), 6) AS mean, round(CASE WHEN count(*) >= 2 THEN stddev_samp(v) / avg(v) END, 6) AS cv FROM m, k GROUP BY l_partkey""")
def cross_sample(spark, sf):
    own = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("v"))
    samples = table(spark, sf, "lineitem").agg(F.count_distinct("l_suppkey")).first()[0]
    got = study.cross_sample(own, "l_partkey", "v", samples)
    return got.select("l_partkey", "n_samples", F.round("completeness", 8).alias("completeness"), F.round("mean", 6).alias("mean"), F.round("cv", 6).alias("cv"))


@query("search_q", "SELECT l_orderkey AS peptide, min(l_discount) AS peptide_q, min(l_tax) AS protein_q FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def search_q(spark, sf):
    psms = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("peptide"), F.col("l_discount").alias("peptide_q"), F.col("l_tax").alias("protein_q"), F.when(F.col("l_returnflag") != "R", 1).otherwise(-1).alias("label"))
    return study.search_q(psms)


@query("features_with_q", """
WITH q AS (SELECT l_orderkey AS peptide, min(l_discount) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT o_orderkey, coalesce(q, CAST('Infinity' AS DOUBLE)) AS q FROM orders LEFT JOIN q ON peptide = o_orderkey""")
def features_with_q(spark, sf):
    q = table(spark, sf, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_discount").alias("q"))
    return table(spark, sf, "orders").select("o_orderkey").join(q, "o_orderkey", "left").select("o_orderkey", F.coalesce("q", F.lit(float("inf"))).alias("q"))


@query("step_up", """
WITH v AS (SELECT l_suppkey, l_linenumber, avg(l_discount) AS p FROM lineitem GROUP BY ALL),
r AS (SELECT *, count(*) OVER () AS n, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM v)
SELECT l_suppkey, l_linenumber, round(least(1.0, min(p * n / k) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS adjusted FROM r""")
def step_up(spark, sf):
    own = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_discount").alias("p"))
    return study.step_up(own, "p").select("l_suppkey", "l_linenumber", F.round("adjusted", 6).alias("adjusted"))


@query("replicate_cv", "SELECT l_suppkey, count(*) AS n, round(stddev_samp(l_quantity) / avg(l_quantity) * 100, 6) AS cv_percent FROM lineitem GROUP BY 1")
def replicate_cv(spark, sf):
    return study.replicate_cv(table(spark, sf, "lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity").withColumn("cv_percent", F.round("cv_percent", 6))


@query("plurality", """
WITH v AS (SELECT l_suppkey, p_type, count(DISTINCT l_partkey) AS votes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT l_suppkey, p_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, p_type) AS rn FROM v) WHERE rn = 1""")
def plurality(spark, sf):
    own = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return rollup.plurality(own, "l_suppkey", "l_partkey", "p_type")


@query("gene_vote", """
WITH v AS (SELECT l_suppkey, p_brand, count(*) AS votes, count(DISTINCT l_partkey) AS size FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, lead(votes) OVER w AS second FROM v WINDOW w AS (PARTITION BY l_suppkey ORDER BY votes DESC, size DESC, p_brand))
SELECT l_suppkey, p_brand, votes, coalesce(second, 0) >= votes * 0.5 AS ambiguous FROM r WHERE rn = 1""")
def gene_vote(spark, sf):
    own = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    votes = own.groupBy("l_suppkey", "p_brand").agg(F.count(F.lit(1)).alias("votes"), F.count_distinct("l_partkey").alias("size"))
    return rollup.gene_vote(votes, "l_suppkey", "p_brand", "size")


@query("equal_split", """
WITH t AS (SELECT l_suppkey, l_extendedprice, unnest(list_distinct(string_split(p_type || ' ' || p_brand, ' '))) AS term, len(list_distinct(string_split(p_type || ' ' || p_brand, ' '))) AS n FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_suppkey, term, round(sum(l_extendedprice / n), 4) AS amount FROM t GROUP BY ALL""")
def equal_split(spark, sf):
    own = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.split(F.concat_ws(" ", "p_type", "p_brand"), " ").alias("terms")), "l_partkey")
    return rollup.equal_split(own, ["l_suppkey"], "terms", "l_extendedprice").withColumn("amount", F.round("amount", 4))


@query("unannotated_names", "SELECT p_name, 'Unannotated_' || lpad(CAST(row_number() OVER (ORDER BY p_name) AS VARCHAR), 6, '0') AS name FROM (SELECT DISTINCT p_name FROM part)")
def unannotated_names(spark, sf):
    return rollup.unannotated_names(table(spark, sf, "part"), "p_name")


BY_BRAND = "b AS (SELECT l_suppkey, p_brand, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def by_brand(spark, sf):
    own = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey"), "l_extendedprice")
    return own.join(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy("l_suppkey", "p_brand").agg(F.sum("l_extendedprice").alias("v"))


@query("relative_signal", f"WITH {BY_BRAND} SELECT l_suppkey, p_brand, round(v / sum(v) OVER (PARTITION BY l_suppkey), 8) AS share FROM b")
def relative_signal(spark, sf):
    return rollup.relative(by_brand(spark, sf), "l_suppkey", "v").select("l_suppkey", "p_brand", F.round("share", 8).alias("share"))


@query("diversity", f"""
WITH {BY_BRAND}, p AS (SELECT l_suppkey, v / sum(v) OVER (PARTITION BY l_suppkey) AS p FROM b)
SELECT l_suppkey, CAST(count(*) AS DOUBLE) AS richness, round(-sum(p * ln(p)), 6) AS shannon, round(exp(-sum(p * ln(p))), 6) AS effective, round(sum(p * p), 6) AS simpson FROM p GROUP BY l_suppkey""")
def diversity(spark, sf):
    got = rollup.diversity(by_brand(spark, sf), "l_suppkey", "v")
    return got.select("l_suppkey", "richness", *[F.round(c, 6).alias(c) for c in ("shannon", "effective", "simpson")])


@query("bray_curtis", f"""
WITH {BY_BRAND}, t AS (SELECT l_suppkey, sum(v) AS t FROM b GROUP BY 1),
m AS (SELECT x.l_suppkey AS sample_a, y.l_suppkey AS sample_b, sum(least(x.v, y.v)) AS m FROM b x JOIN b y ON x.p_brand = y.p_brand AND x.l_suppkey < y.l_suppkey GROUP BY ALL)
SELECT x.l_suppkey AS sample_a, y.l_suppkey AS sample_b, round(1 - 2 * coalesce(m, 0) / (x.t + y.t), 8) AS distance FROM t x JOIN t y ON x.l_suppkey < y.l_suppkey LEFT JOIN m ON sample_a = x.l_suppkey AND sample_b = y.l_suppkey""")
def bray_curtis(spark, sf):
    return rollup.bray_curtis(by_brand(spark, sf), "l_suppkey", "p_brand", "v").withColumn("distance", F.round("distance", 8))


@query("centred_log_ratio", f"""
WITH {BY_BRAND}, k AS (SELECT p_brand FROM b GROUP BY 1 HAVING count(DISTINCT l_suppkey) = (SELECT count(DISTINCT l_suppkey) FROM b)), o AS (SELECT * FROM b WHERE p_brand IN (SELECT p_brand FROM k))
SELECT l_suppkey, p_brand, round(ln(v) - avg(ln(v)) OVER (PARTITION BY l_suppkey), 8) AS clr FROM o""")
def centred_log_ratio(spark, sf):
    own = by_brand(spark, sf)
    n = own.agg(F.count_distinct("l_suppkey")).first()[0]
    return rollup.centred_log_ratio(own, "l_suppkey", "p_brand", "v", n).withColumn("clr", F.round("clr", 8))


@query("lineage_tree", """
WITH l AS (SELECT string_split(r_name || '/' || n_name || '/' || c_mktsegment, '/') AS l, count(*) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
d AS (SELECT l, w, unnest(range(1, len(l) + 1)) AS depth FROM l)
SELECT array_to_string(l[1:depth], '/') AS path, CAST(depth AS INTEGER) AS depth, CAST(sum(w) AS BIGINT) AS count, CAST(sum(CASE WHEN depth = len(l) THEN w ELSE 0 END) AS BIGINT) AS self_count FROM d GROUP BY ALL""")
def lineage_tree(spark, sf):
    own = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rollup.lineage_tree(own.select(F.array("r_name", "n_name", "c_mktsegment").alias("l"), F.lit(1).cast("bigint").alias("w")), "l", "w")


@query("fdp_by_sample", """
WITH c AS (SELECT l_suppkey, count(*) FILTER (l_linestatus = 'O') AS t, count(*) FILTER (l_linestatus <> 'O' AND l_returnflag = 'A') AS e FROM lineitem WHERE l_discount <= 0.05 GROUP BY 1)
SELECT l_suppkey, round(CASE WHEN t + e > 0 THEN e * 2.0 / (t + e) END, 8) AS combined, round(CASE WHEN t + e > 0 THEN e / (t + e) END, 8) AS lower_bound, round(CASE WHEN t > 0 THEN e / t END, 8) AS sample,
       CASE WHEN t + e = 0 THEN 'UNDEFINED' WHEN e * 2.0 / (t + e) <= 0.7 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c""")
def fdp_by_sample(spark, sf):
    c = table(spark, sf, "lineitem").where("l_discount <= 0.05").groupBy("l_suppkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("t"), F.count_if((F.col("l_linestatus") != "O") & (F.col("l_returnflag") == "A")).alias("e"))
    made = control.fdp(F.col("t"), F.col("e"))
    return c.select("l_suppkey", *[F.round(v, 8).alias(k) for k, v in made.items()], control.verdict(made["combined"], 0.7).alias("verdict"))


@query("psm_classes", """
WITH g AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS trap, bool_or(l_returnflag = 'N') AS plain, bool_or(l_returnflag = 'R') AS decoy FROM lineitem GROUP BY 1)
SELECT CASE WHEN decoy THEN 'decoy' WHEN trap AND plain THEN 'shared' WHEN trap THEN 'entrap' ELSE 'target' END AS class, count(*) AS n FROM g GROUP BY 1""")
def psm_classes(spark, sf):
    name = F.when(F.col("l_returnflag") == "A", "ENTRAP_x").when(F.col("l_returnflag") == "R", "rev_x").otherwise("x")
    own = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(name).alias("p"))
    return own.groupBy(control.psm_class(F.col("p"), F.lit(1)).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("picked_protein", """
SELECT l_partkey, l_extendedprice, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey) AS rn FROM lineitem) WHERE rn = 1""")
def picked_protein(spark, sf):
    return control.picked(table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice", "l_orderkey"), "l_partkey", "l_extendedprice", "l_orderkey")


GRID = ", ".join(f"({q}::DOUBLE)" for q in control.Q_GRID)


@query("calibration", f"""
SELECT l_suppkey, q, count(*) FILTER (l_returnflag = 'A') AS n_entrapment, count(*) FILTER (l_returnflag <> 'A') AS n_target, round(count(*) FILTER (l_returnflag = 'A') * 2.0 / count(*), 8) AS fdp
FROM lineitem JOIN (VALUES {GRID}) g(q) ON l_discount <= q GROUP BY ALL""")
def calibration(spark, sf):
    own = table(spark, sf, "lineitem").select("l_suppkey", "l_discount", "l_returnflag")
    return control.calibration(own, ["l_suppkey"], "l_discount", F.col("l_returnflag") == "A").withColumn("fdp", F.round("fdp", 8))


@query("calibration_curve", f"""
WITH c AS (SELECT l_suppkey, q, count(*) FILTER (l_returnflag = 'A') * 2.0 / count(*) AS fdp FROM lineitem JOIN (VALUES {GRID}) g(q) ON l_discount <= q GROUP BY ALL)
SELECT q, round(median(fdp), 6) AS median, round(avg(fdp), 6) AS mean, round(list_sort(list(fdp))[CAST(floor(count(*) * 0.9) AS INTEGER) + 1], 6) AS p90 FROM c GROUP BY q""")
def calibration_curve(spark, sf):
    own = table(spark, sf, "lineitem").select("l_suppkey", "l_discount", "l_returnflag")
    got = control.curve(control.calibration(own, ["l_suppkey"], "l_discount", F.col("l_returnflag") == "A"))
    return got.select("q", *[F.round(c, 6).alias(c) for c in ("median", "mean", "p90")])


@query("outliers", """
WITH v AS (SELECT user_id, avg(value) AS v FROM events GROUP BY 1) SELECT user_id, round(v, 6) AS v FROM v WHERE v > (SELECT avg(v) + 1.5 * stddev_samp(v) FROM v)""")
def outliers(spark, sf):
    own = table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("v"))
    return control.outliers(own, "v", 1.5).select("user_id", F.round("v", 6).alias("v"))


@query("tune_grid", """
SELECT q::DOUBLE AS q, n::INTEGER AS length, s::DOUBLE AS score, count(*) FILTER (l_returnflag <> 'A') AS n_target, count(*) FILTER (l_returnflag = 'A') AS n_entrapment
FROM (VALUES (0.01), (0.05)) a(q), (VALUES (2), (4)) b(n), (VALUES (1000.0), (20000.0)) c(s) JOIN lineitem ON l_discount <= q AND l_linenumber >= n AND l_extendedprice >= s GROUP BY ALL""")
def tune_grid(spark, sf):
    own = table(spark, sf, "lineitem").select("l_discount", "l_linenumber", "l_extendedprice", "l_returnflag")
    return control.tune(own, "l_discount", "l_linenumber", "l_extendedprice", F.col("l_returnflag") == "A", (0.01, 0.05), (2, 4), (1000.0, 20000.0))


@query("conserved_scan", f"""
WITH {SEQ}, {PATTERNS}, {places_sql(12)}, p AS (SELECT peptide, false AS reversed FROM d UNION SELECT reverse(peptide), true FROM d),
h AS (SELECT DISTINCT peptide, reversed, doc_id FROM p JOIN x USING (peptide))
SELECT peptide, reversed, count(*) AS n_proteins, array_to_string(list_sort(list(doc_id))[1:5], ',') AS proteins FROM h GROUP BY ALL""")
def conserved_scan(spark, sf):
    forward = whole_windows(spark, sf, 12).select("peptide").distinct()
    both = forward.withColumn("reversed", F.lit(False)).unionByName(forward.select(F.reverse("peptide").alias("peptide"), F.lit(True).alias("reversed"))).distinct()
    hits = matching.substring_join(both.select("peptide").distinct(), sequences(spark, sf).select(F.col("doc_id").alias("protein"), "sequence"), seed=12)
    return control.conserved(both, hits).select("peptide", "reversed", "n_proteins", F.array_join(F.transform("proteins", lambda x: x.cast("string")), ",").alias("proteins"))


@query("universe", """
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_suppkey % 2 = 1), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_suppkey % 2 = 0)
SELECT p_partkey AS k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'left_only' WHEN b.k IS NOT NULL THEN 'right_only' ELSE 'neither' END AS status
FROM part LEFT JOIN a ON a.k = p_partkey LEFT JOIN b ON b.k = p_partkey""")
def universe(spark, sf):
    odd, even = arms(spark, sf)
    return compare.universe(odd.select("k"), even.select("k"), table(spark, sf, "part").select(F.col("p_partkey").alias("k")), "k")


ARMS = "a AS (SELECT l_partkey AS k, sum(l_extendedprice) AS v FROM lineitem WHERE l_suppkey % 2 = 1 GROUP BY 1), b AS (SELECT l_partkey AS k, sum(l_extendedprice) AS v FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1)"


def arms(spark, sf):
    """All of lineitem in two arms: odd suppliers and even ones."""
    own = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_partkey").alias("k"), "l_extendedprice")
    return [own.where(F.col("l_suppkey") % 2 == r).groupBy("k").agg(F.sum("l_extendedprice").alias("v")) for r in (1, 0)]


@query("overlap", f"""
WITH {ARMS}, n AS (SELECT count(a.k) AS n_left, count(b.k) AS n_right, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS n_both, count(*) AS n_any FROM a FULL JOIN b ON a.k = b.k)
SELECT n_left, n_right, n_both, round((n_right - n_left) * 100.0 / n_left, 8) AS gain_percent, round(n_both / n_any, 8) AS jaccard, round(n_both / n_left, 8) AS coverage FROM n""")
def overlap(spark, sf):
    got = compare.overlap(*arms(spark, sf), "k")
    return got.select("n_left", "n_right", "n_both", *[F.round(c, 8).alias(c) for c in ("gain_percent", "jaccard", "coverage")])


@query("log_correlation", f"WITH {ARMS} SELECT count(*) AS n_shared, round(CASE WHEN count(*) >= 10 THEN corr(log10(a.v), log10(b.v)) END, 6) AS pearson FROM a JOIN b ON a.k = b.k")
def log_correlation(spark, sf):
    return compare.log_correlation(*arms(spark, sf), "k", "v").withColumn("pearson", F.round("pearson", 6))


@query("arm_metrics", f"""
WITH {ARMS} SELECT count(*) FILTER (a.k IS NULL) AS gained, count(*) FILTER (b.k IS NULL) AS lost, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS retained,
round(median(log2(b.v / a.v)), 6) AS median_log2, round(median(abs(log2(b.v / a.v))), 6) AS median_abs_log2 FROM a FULL JOIN b ON a.k = b.k""")
def arm_metrics(spark, sf):
    got = compare.arm_metrics(*arms(spark, sf), "k", "v")
    return got.select("gained", "lost", "retained", F.round("median_log2", 6).alias("median_log2"), F.round("median_abs_log2", 6).alias("median_abs_log2"))


@query("spearman", f"""
WITH {ARMS}, j AS (SELECT a.v AS x, b.v AS y FROM a JOIN b ON a.k = b.k),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM j)
SELECT round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM r""")
def spearman(spark, sf):
    a, b = arms(spark, sf)
    return compare.spearman(a.withColumnRenamed("v", "x").join(b.withColumnRenamed("v", "y"), "k"), "x", "y").withColumn("spearman", F.round("spearman", 6))


@query("lost_genes", """
WITH c AS (SELECT l_partkey AS gene, l_orderkey AS peptide FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT l_partkey AS gene, l_orderkey AS peptide FROM lineitem WHERE l_returnflag = 'R' AND l_discount <= 0.02)
SELECT c.gene, count(DISTINCT c.peptide) AS n_peptides, count(DISTINCT c.peptide) FILTER (c.peptide IN (SELECT peptide FROM r)) AS n_found_elsewhere FROM c WHERE c.gene NOT IN (SELECT gene FROM r) GROUP BY c.gene""")
def lost_genes(spark, sf):
    own = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_orderkey").alias("peptide"), "l_returnflag", "l_discount")
    return compare.lost(own.where("l_returnflag = 'A'"), own.where("l_returnflag = 'R' AND l_discount <= 0.02"), "gene", "peptide")


@query("lake_dedup", f"""
WITH {SEQ}, r AS (SELECT sha256(sequence) AS seq_hash, source, doc_id, row_number() OVER (PARTITION BY sha256(sequence) ORDER BY source, doc_id) AS rn, count(*) OVER (PARTITION BY sha256(sequence)) AS n_sources FROM s)
SELECT seq_hash, source, doc_id, n_sources FROM r WHERE rn = 1""")
def lake_dedup(spark, sf):
    own = sequences(spark, sf).select(F.sha2("sequence", 256).alias("seq_hash"), "source", "doc_id")
    return lake.dedup(own, "seq_hash", ["source", "doc_id"], ["source", "doc_id"])


@query("lake_headers", f"""
WITH {SEQ}, r AS (SELECT DISTINCT sha256(sequence) AS seq_hash, CAST(substr(source, 4) AS INTEGER) AS priority, source || ' ' || lang AS header FROM s), o AS (SELECT seq_hash, min(priority) AS p FROM r GROUP BY 1),
k AS (SELECT r.* FROM r JOIN o USING (seq_hash) WHERE priority <= 5 OR priority > p)
SELECT seq_hash, CAST(count(*) AS INTEGER) AS n_sources, string_agg(header, '|||' ORDER BY priority, header) AS all_source_headers FROM k GROUP BY 1""")
def lake_headers(spark, sf):
    own = sequences(spark, sf).select(F.sha2("sequence", 256).alias("seq_hash"), F.substring("source", 4, 9).cast("int").alias("priority"), F.concat_ws(" ", "source", "lang").alias("header"))
    return lake.joint_headers(own, "seq_hash", "priority", "header", 5)


@query("lake_merge", f"""
WITH {SEQ}, r AS (SELECT sha256(sequence) AS seq_hash, CAST(substr(source, 4) AS INTEGER) AS priority, doc_id AS accession, lang AS gene, source AS organism, doc_id % 7 AS tax_id FROM s)
SELECT seq_hash, arg_min(accession, (priority, accession)) AS accession, arg_min(gene, (priority, accession)) AS gene, CASE WHEN count(DISTINCT organism) > 1 THEN 'ambiguous' ELSE min(organism) END AS organism,
array_to_string(list_sort(list_distinct(list(tax_id))), ',') AS tax_ids, count(*) AS n_sources FROM r GROUP BY 1""")
def lake_merge(spark, sf):
    own = sequences(spark, sf).select(F.sha2("sequence", 256).alias("seq_hash"), F.substring("source", 4, 9).cast("int").alias("priority"), F.col("doc_id").alias("accession"), F.col("lang").alias("gene"), F.lit(None).cast("string").alias("description"), F.col("source").alias("organism"), (F.col("doc_id") % 7).alias("tax_id"), F.lit(1).alias("evidence"), F.lit(1).alias("version"), F.lit(True).alias("reviewed"))
    got = lake.merge_annotations(own, "seq_hash")
    return got.select("seq_hash", "accession", "gene", "organism", F.array_join(F.transform("tax_ids", lambda x: x.cast("string")), ",").alias("tax_ids"), "n_sources")


@query("lake_stats", f"""
WITH {SEQ}, p AS (SELECT sha256(sequence) AS h, source, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT h, count(*) AS k FROM p GROUP BY 1)
SELECT source, CAST(sum(n) AS BIGINT) AS n_records, count(*) AS n_sequences, count(*) FILTER (k = 1) AS n_alone FROM p JOIN k USING (h) GROUP BY source""")
def lake_stats(spark, sf):
    return lake.build_stats(sequences(spark, sf).select(F.sha2("sequence", 256).alias("h"), "source"), "h", "source")


@query("network_edges", """
SELECT l_orderkey, l_partkey, count(DISTINCT l_suppkey) AS n_acquisitions, substr(sha256(l_orderkey || '|' || l_partkey), 1, 16) AS edge_id FROM lineitem GROUP BY ALL""")
def network_edges(spark, sf):
    return network.edge_table(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), "l_orderkey", "l_partkey", "l_suppkey")


@query("network_nodes", """
SELECT CAST(l_orderkey AS VARCHAR) AS node, count(DISTINCT l_partkey) AS degree, count(DISTINCT l_suppkey) AS n_acquisitions, 'l_orderkey' AS kind FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT CAST(l_partkey AS VARCHAR), count(DISTINCT l_orderkey), count(DISTINCT l_suppkey), 'l_partkey' FROM lineitem GROUP BY l_partkey""")
def network_nodes(spark, sf):
    return network.node_table(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), "l_orderkey", "l_partkey", "l_suppkey")


@query("molecular_gate", """
SELECT p_partkey, CASE WHEN p_size > 40 AND p_retailprice > 1500 THEN 'abundant,costly' WHEN p_size > 40 THEN 'abundant' ELSE 'costly' END AS passed FROM part WHERE p_size > 40 OR p_retailprice > 1500""")
def molecular_gate(spark, sf):
    got = network.gate(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), {"abundant": F.col("p_size") > 40, "costly": F.col("p_retailprice") > 1500})
    return got.select("p_partkey", F.array_join("passed", ",").alias("passed"))


@query("combined_origins", """
WITH u AS (SELECT l_partkey AS k, l_quantity AS v, 'late' AS o FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, l_quantity, 'early' FROM lineitem WHERE l_returnflag = 'A')
SELECT k, max(v) AS v, array_to_string(list_sort(list_distinct(list(o))), ',') AS origins FROM u GROUP BY k""")
def combined_origins(spark, sf):
    own = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("v"), "l_returnflag")
    got = network.combine_origins({"late": own.where("l_returnflag = 'R'"), "early": own.where("l_returnflag = 'A'")}, "k", "v")
    return got.withColumn("origins", F.array_join("origins", ","))


@query("active_terms", """
SELECT DISTINCT p_partkey AS gene FROM part, (SELECT unnest(string_split(p_type, ' ')) AS term FROM part WHERE p_size > 45) a WHERE list_contains(string_split(p_type, ' '), a.term) AND p_brand <> 'x'""")
def active_terms(spark, sf):
    part = table(spark, sf, "part")
    links = part.select(F.col("p_partkey").alias("compound"), F.explode(F.split("p_type", " ")).alias("term"))
    return network.active_terms(part.select(F.col("p_partkey").alias("gene"), F.split("p_type", " ").alias("terms")), part.select(F.col("p_partkey").alias("compound"), (F.col("p_size") > 45).cast("int").alias("amount")), links)


@query("shared_peptides", f"""
WITH {SEQ}, r AS (SELECT DISTINCT source AS representative, lower(lang) AS l, upper(lang) AS peptide FROM documents)
SELECT r.peptide, r.representative, count(s.sequence) AS n_resolved, count(*) FILTER (contains(s.sequence, r.peptide)) AS n_hits, count(*) FILTER (contains(s.sequence, r.peptide)) / count(s.sequence) >= 0.8 AS is_shared
FROM r JOIN s ON s.source = r.representative GROUP BY ALL""")
def shared_peptides(spark, sf):
    own = sequences(spark, sf)
    rescued = own.select(F.upper("lang").alias("peptide"), F.col("source").alias("representative")).distinct()
    return network.shared_peptides(rescued, own.select(F.col("source").alias("representative"), F.col("doc_id").alias("member")), own.select(F.col("doc_id").alias("member"), "sequence"))


@query("header_fields", """
WITH h AS (SELECT page_id, 'sp|P' || page_id || '|X_TEST Some protein ' || page_id || ' OS=Homo sapiens OX=9606 GN=G' || page_id || ' PE=1 SV=1' AS h FROM pages)
SELECT page_id, 'P' || page_id AS accession, 'G' || page_id AS gene, 'Some protein ' || page_id AS description, 'Homo sapiens' AS organism, 'reviewed' AS source FROM h""")
def header_fields(spark, sf):
    p = F.col("page_id").cast("string")
    header = F.concat(F.lit("sp|P"), p, F.lit("|X_TEST Some protein "), p, F.lit(" OS=Homo sapiens OX=9606 GN=G"), p, F.lit(" PE=1 SV=1"))
    return table(spark, sf, "pages").select("page_id", S.header_fields(header).alias("f")).select("page_id", "f.*")


@query("json_props", "SELECT event_type, count(*) AS n, count(DISTINCT props) AS n_props, max(length(props)) AS longest FROM events GROUP BY 1")
def json_props(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("props").alias("n_props"), F.max(F.length("props")).cast("bigint").alias("longest"))


@query("level_rollup", """
SELECT p_brand, p_type, round(sum(l_extendedprice), 2) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY GROUPING SETS ((p_brand), (p_type), (p_brand, p_type), ())""")
def level_rollup(spark, sf):
    own = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_extendedprice").join(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), "p_partkey")
    return own.cube("p_brand", "p_type").agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query("decoys", f"""
WITH {SEQ} SELECT CAST(doc_id AS VARCHAR) AS accession, sha256(sequence) AS h FROM s UNION ALL SELECT 'rev_' || doc_id, sha256(reverse(sequence)) FROM s""")
def decoys(spark, sf):
    own = sequences(spark, sf).select(F.col("doc_id").cast("string").alias("accession"), "sequence")
    return control.decoys(own).select("accession", F.sha2("sequence", 256).alias("h"))
