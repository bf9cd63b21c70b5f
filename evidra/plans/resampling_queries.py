"""Permutation tests, bootstrap intervals and components: suppliers are samples or measurements, brands features.

A supplier's condition is whether its account is above the mean of all; its block is whether its nation's number is
even.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import control, resampling
from evidra.plans.evidence_queries import table

QUERIES, ORACLES = {}, {}
PERMUTATIONS, SEED, DRAWS = 99, 5, 200


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def brand_sums(spark, sf):
    """sample, feature, value: quantities by supplier and brand."""
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("feature"))
    own = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return own.groupBy(F.col("l_suppkey").alias("sample"), "feature").agg(F.sum("l_quantity").alias("value"))


def design(spark, sf):
    own = table(spark, sf, "supplier")
    mean = own.agg(F.avg("s_acctbal").alias("mean"))
    return own.crossJoin(F.broadcast(mean)).select(F.col("s_suppkey").alias("sample"), F.when(F.col("s_acctbal") > F.col("mean"), "high").otherwise("low").alias("label"), (F.col("s_nationkey") % 2 == 0).alias("block"))


_DISTANCES = """v AS (SELECT l_suppkey AS sample, p_brand AS feature, sum(l_quantity) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
t AS (SELECT sample, sum(value) AS t FROM v GROUP BY sample),
m AS (SELECT a.sample AS x, b.sample AS y, sum(least(a.value, b.value)) AS m FROM v a JOIN v b ON a.feature = b.feature AND a.sample < b.sample GROUP BY ALL),
d AS (SELECT a.sample AS x, b.sample AS y, 1 - 2 * coalesce(m, 0) / (a.t + b.t) AS distance FROM t a JOIN t b ON a.sample < b.sample LEFT JOIN m ON m.x = a.sample AND m.y = b.sample)"""
_DESIGN = "g AS (SELECT s_suppkey AS sample, CASE WHEN s_acctbal > (SELECT avg(s_acctbal) FROM supplier) THEN 'high' ELSE 'low' END AS label, s_nationkey % 2 = 0 AS block FROM supplier)"
_PERMUTED = f"""slots AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY sample) AS slot FROM g),
moved AS (SELECT permutation, sample, block, row_number() OVER (PARTITION BY permutation, block ORDER BY sha256('{SEED}:' || permutation || ':' || sample), sample) AS slot FROM g, range(1, {PERMUTATIONS + 1}) r(permutation)),
labels AS (SELECT 0 AS permutation, sample, label FROM g UNION ALL SELECT permutation, moved.sample, slots.label FROM moved JOIN slots USING (block, slot))"""


@query("permuted_labels", f"WITH {_DESIGN}, {_PERMUTED} SELECT permutation::INTEGER AS permutation, sample, label FROM labels")
def permuted_labels(spark, sf):
    return resampling.permutations(design(spark, sf), PERMUTATIONS, SEED)


@query("permanova", f"""WITH {_DISTANCES}, {_DESIGN}, {_PERMUTED},
n AS (SELECT label, count(*) AS n FROM g GROUP BY label), k AS (SELECT count(*) AS samples, (SELECT count(*) FROM n) AS groups, (SELECT sum(distance * distance) FROM d) AS squares FROM g),
w AS (SELECT a.permutation, sum(distance * distance / n.n) AS within FROM d JOIN labels a ON a.sample = d.x JOIN labels b ON b.sample = d.y AND b.permutation = a.permutation AND b.label = a.label JOIN n ON n.label = a.label GROUP BY a.permutation),
f AS (SELECT permutation, within, squares / samples AS total, samples, groups, ((squares / samples - within) / (groups - 1)) / (within / (samples - groups)) AS f FROM w, k)
SELECT round(o.f, 8) AS pseudo_f, round((o.total - o.within) / o.total, 8) AS r_squared, (1.0 + (SELECT count(*) FROM f WHERE permutation > 0 AND f.f >= o.f - 1e-12 * greatest(1.0, abs(o.f)))) / {PERMUTATIONS + 1}::DOUBLE AS p_value,
  {PERMUTATIONS}::BIGINT AS permutations, o.samples, o.groups FROM f o WHERE permutation = 0""")
def permanova(spark, sf):
    """Do suppliers of high and low accounts sell other brands? Labels move within blocks."""
    got = resampling.table_permanova(brand_sums(spark, sf), "sample", "feature", "value", design(spark, sf), PERMUTATIONS, SEED)
    return got.select(F.round("pseudo_f", 8).alias("pseudo_f"), F.round("r_squared", 8).alias("r_squared"), "p_value", "permutations", F.col("samples").cast("bigint").alias("samples"), F.col("groups").cast("bigint").alias("groups"))


_FINISH = lambda x: f"xor({x}, ({x}) >> 16)"


def _scramble_sql(x):
    """The 32-bit finaliser of `resampling.scramble` on a BIGINT."""
    a = f"((xor({x}, ({x}) >> 16)::HUGEINT * 2246822507) % 4294967296)::BIGINT"
    b = f"((xor({a}, ({a}) >> 13)::HUGEINT * 3266489909) % 4294967296)::BIGINT"
    return _FINISH(b)


@query("bootstrap_summary", f"""WITH v AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
r AS (SELECT l_returnflag, v, row_number() OVER (PARTITION BY l_returnflag ORDER BY v) - 1 AS place, count(*) OVER (PARTITION BY l_returnflag) AS n FROM v),
s0 AS (SELECT {_scramble_sql(f'{SEED}::BIGINT')} AS s), draws AS (SELECT draw, s, xor(draw, s) AS x FROM range({DRAWS}) d(draw), s0),
bases AS (SELECT draw, {_scramble_sql('x')} AS base FROM draws),
mixed AS (SELECT l_returnflag, n, draw, xor(j, base) AS x FROM (SELECT DISTINCT l_returnflag, n FROM r), LATERAL (SELECT unnest(range(n)) AS j), bases WHERE n > 5),
picked AS (SELECT l_returnflag, n, draw, ({_scramble_sql('x')} * n) >> 32 AS place FROM mixed),
medians AS (SELECT l_returnflag, draw, median(v) AS m FROM picked JOIN r USING (l_returnflag, place) GROUP BY ALL),
ends AS (SELECT l_returnflag, list_sort(list(m)) AS ms FROM medians GROUP BY 1),
own AS (SELECT l_returnflag, count(*) AS n, median(v) AS median, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY 1)
SELECT own.l_returnflag, n, round(median, 6) AS median, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(ms[{int(0.025 * DRAWS) + 1}], 6) AS ci_lo, round(ms[{min(int(0.975 * DRAWS), DRAWS - 1) + 1}], 6) AS ci_hi
FROM own LEFT JOIN ends ON ends.l_returnflag = own.l_returnflag""")
def bootstrap_summary(spark, sf):
    """Median, quartiles and a bootstrap interval of the suppliers' mean quantities by return flag."""
    own = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("v"))
    ends = resampling.bootstrap_median(own, "v", ["l_returnflag"], DRAWS, SEED)
    got = control.summary(own, "v", ["l_returnflag"]).join(ends.drop("n"), "l_returnflag", "left")
    return got.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("median", "q1", "q3", "iqr", "ci_lo", "ci_hi")])


def month_sums(spark, sf):
    """sample, feature, value: prices by line number and month, and supplier."""
    own = table(spark, sf, "lineitem").select(F.concat_ws("/", F.col("l_linenumber").cast("string"), "l_returnflag").alias("sample"), F.col("l_suppkey").alias("feature"), "l_extendedprice")
    return own.groupBy("sample", "feature").agg(F.sum("l_extendedprice").alias("value"))


_MATRIX = "v AS (SELECT l_linenumber || '/' || l_returnflag AS sample, l_suppkey AS feature, log2(sum(l_extendedprice)) AS x FROM lineitem GROUP BY ALL HAVING sum(l_extendedprice) > 0), k AS (SELECT count(DISTINCT sample) AS k FROM v)"
_ELIGIBLE = "e AS (SELECT feature, avg(x) AS mean FROM v, k GROUP BY feature, k HAVING count(*) = k AND max(x) > min(x))"


@query("component_features", f"WITH {_MATRIX}, o AS (SELECT feature, count(*) AS n, max(x) > min(x) AS varies FROM v GROUP BY feature) SELECT DISTINCT l_suppkey AS feature, coalesce(n = k, false) AS complete, coalesce(n = k AND varies, false) AS eligible FROM lineitem LEFT JOIN o ON feature = l_suppkey, k")
def component_features(spark, sf):
    return resampling.principal_components(month_sums(spark, sf)).features


@query("component_variance")
def component_variance(spark, sf):
    got = resampling.principal_components(month_sums(spark, sf)).variance
    return got.select("component", F.round("variance", 6).alias("variance"), F.round("ratio", 6).alias("ratio"))


@query("component_scores")
def component_scores(spark, sf):
    return resampling.principal_components(month_sums(spark, sf)).scores.withColumn("score", F.round("score", 6))


@query("component_loadings")
def component_loadings(spark, sf):
    return resampling.principal_components(month_sums(spark, sf)).loadings.withColumn("loading", F.round("loading", 6))


@query("sample_gram", f"""WITH {_MATRIX}, {_ELIGIBLE}, c AS (SELECT sample, feature, x - mean AS x FROM v JOIN e USING (feature)), o AS (SELECT sample, row_number() OVER (ORDER BY sample) - 1 AS i FROM (SELECT DISTINCT sample FROM v))
SELECT oa.i::INTEGER AS i, ob.i::INTEGER AS j, round(sum(a.x * b.x), 6) AS value FROM c a JOIN c b ON a.feature = b.feature JOIN o oa ON oa.sample = a.sample JOIN o ob ON ob.sample = b.sample GROUP BY ALL""")
def sample_gram(spark, sf):
    """The matrix behind the components, by sums of outer products over features."""
    own = month_sums(spark, sf).where("value > 0").select("sample", "feature", F.log2("value").alias("x"))
    order = sorted(r.sample for r in own.select("sample").distinct().collect())
    full = own.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), (F.max("x") > F.min("x")).alias("varies")).where((F.col("n") == len(order)) & F.col("varies")).select("feature")
    return resampling.gram(own.join(full, "feature", "left_semi"), order).withColumn("value", F.round("value", 6))
