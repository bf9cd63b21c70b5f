"""Importance resampling towards a target distribution, over hashed runs of words.

1. A streaming ring of checksums hashes all runs of 1 to `order` words in one scan of a text: it keeps the zlib state
   of the last `order` starts; each word extends every state by a space and itself and opens a state of its own, and
   each state is then the checksum of the run from its start up to this word. Nothing is ever joined into strings.
2. Bucket counts of the corpus and of the target are summed up, already in map tasks, to one number for each bucket.
3. A bucket's gain is the log ratio of its shares in the target and the corpus; a document's weight is the mean gain of
   its features. With Gumbel noise from the document's id, the documents of highest score are a sample drawn in
   proportion to the weights without replacement. Ranks are taken by ranges of the score, never in one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sqltext import crc32_sql, lower_sql
from .storage import Workspace, bounded_batches, partitions_for, release

#: The contract's figures: words in a run, buckets, scale of gains, least words and share of drawn documents, seed.
ORDER, BUCKETS, SCALE, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 1000, 20, 25, 7
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` in UTF-8 after lower-casing A-Z."""
    return (text or "").encode().translate(_WORD_BYTES).split()


def ring_checksums(words: list[bytes], order: int) -> list[int]:
    """The crc32 of every run of 1 to `order` consecutive words, joined by one space."""
    ring: list[int] = []
    found: list[int] = []
    older = order - 1
    for word in words:
        step = b" " + word
        ring = [crc32(word), *[crc32(step, state) for state in ring[:older]]]
        found += ring
    return found


def bucket_counts(texts: DataFrame, text_col: str, order: int, buckets: int) -> DataFrame:
    """bucket, n over all texts; each map task sends its own sums, `buckets` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = ring_checksums(words_of(text.as_py()), order)
                total += np.bincount(np.array(found, np.int64) % buckets, minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["bucket", "n"])
        release()

    return texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket, in doubles."""
    whole, aimed, size = float(corpus.sum()), float(target.sum()), float(len(corpus))
    ratio = [(t + 1.0) * (whole + size) / ((s + 1.0) * (aimed + size)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(scale * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: int | None, seed: int, scale: int) -> int:
    """Gumbel noise from the first 32 bits of sha256(`<seed>:<doc_id>`); a null id is written as nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, work: Workspace, order: list, name: str = "ordered") -> DataFrame:
    """`rows` with a column `rank` from 1 in the total order given: ranges in tasks, numbers within them, then one
    count for each range."""
    spark = work.spark
    inside = (1 << 33) - 1
    # a row's number: its range in the high bits, its place there in the low ones
    placed = work.save(rows.repartitionByRange(partitions_for(spark, rows.count(), 1_000_000), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), name)
    sizes = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("k"))
    before, total = {}, 0
    for part, k in sorted(sizes.collect()):  # as many rows as there are ranges
        before[part] = total
        total += k
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "part bigint, before bigint")
    return placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(offsets), "part").withColumn("rank", F.expr(f"before + (at & {inside}L) + 1")).drop("part", "before", "at")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", order: int = ORDER, buckets: int = BUCKETS, scale: int = SCALE, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """id, n_features, weight, score and rank (null for rows that aren't drawn) for each row of `docs`.

    Of the rows with at least `least_words` words, the `percent` in a hundred (rounded down) of highest score are
    drawn; ties go to the smaller id, null ids come last, repeated rows take consecutive ranks. Null and empty texts
    have no features and weight 0. Very long texts are scanned whole. An empty corpus gives an empty result; an empty
    target counts as no occurrences. Other columns, whatever their names, are not read. The driver holds one number
    for each bucket.
    """
    work = Workspace(spark, "resample")
    bounded_batches(spark)

    def histogram(texts: DataFrame, column: str) -> np.ndarray:
        got = bucket_counts(texts, column, order, buckets).toArrow()
        out = np.zeros(buckets, np.int64)
        out[got["bucket"].to_numpy()] = got["n"].to_numpy()
        return out

    gain = spark.sparkContext.broadcast(gains(histogram(docs, text_col), histogram(target, target_text), scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, weights, scores, long = batch.column(0).to_pylist(), [], [], [], []
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                words = words_of(text.as_py())
                found = ring_checksums(words, order)
                n.append(len(found))
                weights.append(int(gain.value[np.array(found, np.int64) % buckets].sum()) // len(found) if found else 0)
                scores.append(weights[-1] + noise(doc_id, seed, scale))
                long.append(len(words) >= least_words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, weights, scores)), pa.array(long, pa.bool_())], names=["id", "n_features", "weight", "score", "long"])
        release()

    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    scored = work.save(own.mapInArrow(run, "id bigint, n_features bigint, weight bigint, score bigint, long boolean"), "scored")
    drawn = scored.where("long").count() * percent // 100
    order_by = [F.col("score").desc(), F.col("id").asc_nulls_last(), "n_features", "weight"]
    fit = ranked(scored.where("long"), work, order_by).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ["id", "n_features", "weight", "score", "rank"]
    return fit.select(*columns).unionByName(scored.where("not long").withColumn("rank", F.lit(None).cast("bigint")).select(*columns))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(spark, docs, target).withColumnRenamed("id", "doc_id")


def _features_sql(table: str, key: str) -> str:
    words = rf"regexp_extract_all({lower_sql('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = " UNION ALL ".join(f"SELECT {key}, unnest([array_to_string(w[i:i + {k}], ' ') FOR i IN range(1, len(w) - {k} + 1)]) AS g FROM split" for k in range(ORDER))
    return f"WITH split AS (SELECT {key}, {words} AS w FROM {table}) {runs}"


OP11_SQL = f"""
WITH own AS ({_features_sql("documents", "doc_id")}), aim AS ({_features_sql("benchmark", "item_id")}),
coded AS (SELECT g, {crc32_sql("g")} % {BUCKETS} AS bucket FROM (SELECT g FROM own UNION SELECT g FROM aim)),
placed AS (SELECT doc_id, bucket FROM own JOIN coded USING (g)),
s AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS s FROM placed GROUP BY bucket),
t AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS t FROM aim JOIN coded USING (g) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
gain AS (SELECT s.bucket, floor({SCALE} * ln((coalesce(t, 0) + 1) * (ss + {BUCKETS}) / ((s + 1) * (tt + {BUCKETS})))) AS gain FROM s LEFT JOIN t ON t.bucket = s.bucket, sums),
weights AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM placed JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-{SCALE} * ln(-ln((CAST('0x' || left(sha256('{SEED}:' || d.doc_id), 8) AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score,
    coalesce(n_features, 0) >= 2 * {LEAST_WORDS} - 1 AS long
  FROM documents d LEFT JOIN weights w ON w.doc_id = d.doc_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY long ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY long) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN long AND r <= {PERCENT} * n // 100 THEN r END AS rank FROM ranked
"""
