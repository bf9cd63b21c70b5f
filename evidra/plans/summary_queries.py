"""Queries on quality filters and on summaries over samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import quality, study
from evidra.plans.evidence_queries import SEQ, sequences, table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


FILTERS = quality.Filters(noncanonical=0.12, clean=True, shortest=150, longest=20_000, poly_run=4, entropy=0.86, fragment=400)
_RUNS = "|".join(f"{chr(65 + k)}{{4}}" for k in range(26))
_QUALITY = f"""{SEQ}, c AS (SELECT doc_id, sequence, translate(sequence, 'BJZ', 'XXX') AS cleaned, length(sequence) AS n FROM s),
k AS (SELECT doc_id, any_value(n) AS n, ch, count(*) AS f FROM (SELECT doc_id, n, unnest(string_split(cleaned, '')) AS ch FROM c WHERE n >= 2) WHERE ch <> '' GROUP BY doc_id, ch),
h AS (SELECT doc_id, -sum((f / n) * log2(f / n)) / log2(20.0) AS entropy FROM k GROUP BY doc_id),
q AS (SELECT c.doc_id, cleaned, n, coalesce(entropy, 0.0) AS entropy, length(sequence) - length(regexp_replace(sequence, '[BJZ]', '', 'g')) AS replaced,
  CASE WHEN n > 0 AND length(regexp_replace(sequence, '[ACDEFGHIKLMNPQRSTVWYUO]', '', 'g')) / n > 0.12 THEN 'noncanonical' WHEN n < 150 OR n > 20000 THEN 'length' WHEN regexp_matches(cleaned, '{_RUNS}') THEN 'poly_run'
  WHEN coalesce(entropy, 0.0) < 0.86 THEN 'low_complexity' WHEN NOT starts_with(cleaned, 'M') AND n < 400 THEN 'fragment' END AS reason FROM c LEFT JOIN h ON h.doc_id = c.doc_id)"""


def _filtered(spark, sf):
    return quality.filtered(sequences(spark, sf), FILTERS)


@query("quality_filter", f"""WITH {_QUALITY} SELECT doc_id, reason, CASE WHEN reason IS NULL THEN sha256(cleaned) END AS h, CASE WHEN reason = 'length' THEN CASE WHEN n < 150 THEN 'too_short:' || n || '<150' ELSE 'too_long:' || n || '>20000' END
  WHEN reason = 'poly_run' THEN 'poly_run:>=4' WHEN reason = 'fragment' THEN 'fragment:no_M_start,len=' || n || '<400' WHEN reason = 'low_complexity' THEN 'low_complexity' WHEN reason = 'noncanonical' THEN 'noncanonical' END AS detail FROM q""")
def quality_filter(spark, sf):
    """All filters in their order over whole sequences; the first rejection counts. Printed figures are left out."""
    made = _filtered(spark, sf)
    detail = F.when(F.col("reason").isin("low_complexity", "noncanonical"), F.col("reason")).otherwise(F.col("detail"))
    return made.select("doc_id", "reason", F.when(F.col("reason").isNull(), F.sha2("cleaned", 256)).alias("h"), detail.alias("detail"))


@query("quality_report", f"""WITH {_QUALITY} SELECT count(*) AS total_input, count(*) FILTER (reason IS NULL) AS passed, CAST(sum(CASE WHEN reason = 'noncanonical' THEN 0 ELSE replaced END) AS BIGINT) AS residues_normalised,
  {', '.join(f"count(*) FILTER (reason = '{r}') AS rejected_{r}" for r in quality.REASONS)} FROM q""")
def quality_report(spark, sf):
    return quality.report(_filtered(spark, sf))


@query("cross_sample_summary", """
WITH v AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS v FROM lineitem WHERE l_quantity > 0 GROUP BY ALL), f AS (SELECT l_partkey, count(*) AS k, CASE WHEN count(*) >= 2 THEN stddev_samp(v) / avg(v) * 100 END AS cv FROM v GROUP BY 1),
n AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem), c AS (SELECT list_sort(list(cv)) AS cvs FROM f WHERE cv IS NOT NULL)
SELECT n AS n_samples, count(*) AS n_features, round(sum(k) * 100.0 / (count(*) * n), 8) AS completeness_pct, round(any_value(cvs[len(cvs) // 2 + 1]), 8) AS median_cv_pct, count(*) FILTER (k = n) AS features_in_all_samples, count(*) FILTER (k = 1) AS features_in_one_sample FROM f, n, c GROUP BY n""")
def cross_sample_summary(spark, sf):
    own = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("v"))
    got = study.cross_sample_summary(own, "l_suppkey", "l_partkey", "v")
    return got.withColumns({c: F.round(c, 8) for c in ("completeness_pct", "median_cv_pct")})
