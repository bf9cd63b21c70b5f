"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each, the mean and the deviation are kept. By Cauchy and Schwarz, the inner product
of two segments of n components is at most n * (mean * mean + deviation * deviation), which is the same as a lower
bound of their distance. Bounds are taken coarse to fine; what still can be among the k best gets its exact score.

1. Vectors are dealt to blocks by a sign code of fixed random directions, so that like vectors are neighbours.
2. Each query is searched in its own block. There the candidates with the highest bounds are scored first, so that a
   threshold stands before any candidate is let through; the k-th best score found goes along with the query.
3. A block's summary (range of means, greatest deviation of each segment) bounds all its vectors at once. A query goes
   on to those blocks only whose bound reaches its threshold, and is searched there, level by level, from that
   threshold on.

No task holds more than a block of candidates and a chunk of queries; summaries are broadcast, of at most MAX_BLOCKS
blocks, as blocks grow with the table beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Workspace

#: Segments by level; SUMMARY is that of block summaries and of the first choice of candidates.
SEGMENTS, SUMMARY = (1, 4, 16, 32), 16
BLOCK, TILE, QUERIES, MAX_BLOCKS = 16_384, 1_024, 4_096, 32_768
#: Bits of the sign code.
BITS = 12


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Scaled segment means and deviations: the inner product of two rows is an upper bound of that of the vectors."""
    parts = np.array_split(vectors, min(segments, max(1, vectors.shape[1])), axis=1)
    columns = []
    for part in parts:
        root = np.sqrt(part.shape[1])
        columns += [part.mean(1) * root, part.std(1) * root] if part.shape[1] else []
    return np.stack(columns, 1) if columns else np.zeros((len(vectors), 1))


def exact_scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products. Doubles are exact while no sum can reach 2**53; beyond that, Python's integers are used.

    Scores outside the range of a long are set to its ends.
    """
    if float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1]) < 2**52:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    wide = queries.astype(object) @ candidates.astype(object).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores.astype(object) if scores.min(initial=0) == -(2**63) else -scores))[:k]


def _pair_scores(queries: np.ndarray, candidates: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs (rows[i], columns[i])."""
    if float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1]) >= 2**52:
        return np.array([exact_scores(queries[[r]], candidates[[c]])[0, 0] for r, c in zip(rows.tolist(), columns.tolist(), strict=True)], np.int64)
    parts = [np.einsum("ij,ij->i", queries[rows[a : a + 65_536]].astype(np.float64), candidates[columns[a : a + 65_536]].astype(np.float64)) for a in range(0, len(rows), 65_536)]
    return np.concatenate([np.zeros(0), *parts]).astype(np.int64)


def first_thresholds(keys: np.ndarray, queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the 4 * k candidates of one tile with the highest bounds; -inf, if fewer than k."""
    bound = statistics(queries.astype(np.float64), SUMMARY) @ statistics(vectors.astype(np.float64), SUMMARY).T
    bound[keys[:, None] == own[None, :]] = -np.inf
    n = min(4 * k, bound.shape[1])
    if not len(keys) or n < k:
        return np.full(len(keys), -np.inf)
    chosen = np.argpartition(-bound, n - 1, axis=1)[:, :n]
    scores = _pair_scores(queries, vectors, np.repeat(np.arange(len(keys)), n), chosen.ravel()).reshape(len(keys), n).astype(np.float64)
    scores[np.isneginf(np.take_along_axis(bound, chosen, 1))] = -np.inf
    return np.sort(scores, 1)[:, -k]


def search_block(query_keys: np.ndarray, queries: np.ndarray, keys: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None = None, counts: dict | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best in one block of candidates; a query is not its own candidate.

    least: scores below these are of no use to a query; by default they come from the first tile. counts, if given,
    gets the number of pairs alive after each level (by its segments) and of exact scores (`scored`).
    """
    order = np.argsort(-np.linalg.norm(vectors.astype(np.float64), axis=1), kind="stable")  # long vectors first: high scores early
    keys, ids, vectors = keys[order], ids[order], vectors[order]
    least = first_thresholds(query_keys, queries, keys[:TILE], vectors[:TILE], k) if least is None else least.astype(np.float64)
    levels = [s for s in SEGMENTS if s < max(2, vectors.shape[1])]
    asked = [statistics(queries.astype(np.float64), s) for s in levels]
    given = [statistics(vectors.astype(np.float64), s) for s in levels]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_keys]
    for start in range(0, len(keys), TILE):
        tile = slice(start, start + TILE)
        alive = query_keys[:, None] != keys[tile][None, :]
        for level, q, c in zip(levels, asked, given, strict=True):
            rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if not len(rows):
                break
            bound = q[rows] @ c[tile][columns].T
            alive[np.ix_(rows, columns)] &= bound * (1 + 1e-9 * np.sign(bound)) + 1 >= least[rows][:, None]
            if counts is not None:
                counts[level] = counts.get(level, 0) + int(alive.sum())
        rows, columns = np.nonzero(alive)
        if counts is not None:
            counts["scored"] = counts.get("scored", 0) + len(rows)
        if not len(rows):
            continue
        if len(rows) * 4 > alive.size:  # most are left: one product is cheaper than pairs
            scores = exact_scores(queries, vectors[tile])[rows, columns]
        else:
            scores = _pair_scores(queries, vectors[tile], rows, columns)
        good = scores >= least[rows]
        rows, columns, scores = rows[good], columns[good], scores[good]
        bounds = np.searchsorted(rows, np.arange(len(query_keys) + 1))
        for r in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[r], bounds[r + 1])
            all_ids, all_scores = np.concatenate([found[r][0], ids[tile][columns[part]]]), np.concatenate([found[r][1], scores[part]])
            top = best(all_ids, all_scores, k)
            found[r] = all_ids[top], all_scores[top]
            if len(top) == k:
                least[r] = max(least[r], float(all_scores[top[-1]]))
    return found


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and floor(scale * x) of each component; vectors that are null or hold a null or non-finite one are left out."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
    return whole.select(F.col(id_col).cast("bigint").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _rows(batch: pa.RecordBatch) -> list[np.ndarray]:
    values = batch.column("v")
    flat, offsets = values.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def sign_codes(v: np.ndarray) -> np.ndarray:
    """BITS signs of a vector's products with fixed directions."""
    directions = np.random.default_rng(11).normal(size=(v.shape[1], BITS))
    return ((v.astype(np.float64) @ directions > 0) @ (1 << np.arange(BITS))).astype(np.int64)


def _coded(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _rows(batch)
            code, size = np.zeros(len(own), np.int64), np.array([len(v) for v in own], np.int64)
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                code[at] = sign_codes(np.stack([own[i] for i in at.tolist()]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(size), pa.array(code)], names=["id", "v", "size", "code"])

    return rows.mapInArrow(run, "id bigint, v array<bigint>, size bigint, code bigint")


def summaries(dealt: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Of each block and vector size: least and greatest mean and greatest deviation of each segment, as three rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, block = _rows(batch), batch.column("block").to_numpy()
            size = np.array([len(v) for v in own], np.int64)
            out = []
            for b, n in sorted(set(zip(block.tolist(), size.tolist(), strict=True))):
                values = statistics(np.stack([own[i] for i in np.flatnonzero((block == b) & (size == n)).tolist()]).astype(np.float64), SUMMARY)
                means, spread = values[:, ::2], values[:, 1::2]
                spread = spread if spread.shape[1] else np.zeros_like(means)
                out += [(b, n, s, float(lo), float(hi), float(d)) for s, (lo, hi, d) in enumerate(zip(means.min(0), means.max(0), spread.max(0), strict=True))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["block", "size", "segment", "lo", "hi", "spread"])

    parts = dealt.select("block", "v").mapInArrow(run, "block bigint, size bigint, segment bigint, lo double, hi double, spread double")
    got = parts.groupBy("block", "size", "segment").agg(F.min("lo"), F.max("hi"), F.max("spread")).orderBy("block", "size", "segment").toArrow()
    columns = [c.to_numpy() for c in got.columns]
    made: dict[tuple[int, int], list] = {}
    for b, n, _, *values in zip(*(c.tolist() for c in columns), strict=True):
        made.setdefault((b, n), []).append(values)
    return {key: np.array(v).T for key, v in made.items()}


def block_bounds(queries: np.ndarray, summary: np.ndarray) -> np.ndarray:
    """An upper bound of each query's inner products with all vectors of a block."""
    own = statistics(queries.astype(np.float64), SUMMARY)
    means, spread = own[:, ::2], own[:, 1::2]
    low, high, most = summary
    bound = np.maximum(means * low, means * high).sum(1)
    return bound + (spread @ most if spread.shape[1] else 0)


def _searched(rows: DataFrame, k: int) -> DataFrame:
    """rows: pair, key, id, v, least, query, candidate; all of a pair in one partition. Hits of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list, list]] = {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("pair", "key", "id", "least", "query", "candidate"))
            for v, pair, key, own, least, query, candidate in zip(_rows(batch), *columns, strict=True):
                queries, candidates = held.setdefault((pair, len(v)), ([], []))
                if query:
                    queries.append((key, own, v, least))
                if candidate:
                    candidates.append((key, own, v))
        while held:
            _, (queries, candidates) = held.popitem()
            if not queries or not candidates:
                continue
            asked, ids, vs, least = zip(*queries, strict=True)
            keys, given, vectors = zip(*candidates, strict=True)
            own = np.array([-np.inf if x is None else x for x in least])
            found = search_block(np.array(asked), np.stack(vs), np.array(keys), np.array(given), np.stack(vectors), k, None if np.isneginf(own).all() else own)
            lengths = [len(i) for i, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(asked, np.int64), lengths)), pa.array(np.repeat(np.array(ids, np.int64), lengths)), pa.array(np.concatenate([i for i, _ in found]), pa.int64()), pa.array(np.concatenate([s for _, s in found]), pa.int64())], names=["key", "query_id", "id", "score"])

    return rows.select("pair", "key", "id", "v", "least", "query", "candidate").mapInArrow(run, "key bigint, query_id bigint, id bigint, score bigint")


def top_k(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024, block: int = BLOCK) -> DataFrame:
    """query_id, rank, id, score of the k best candidates of each query: rows whose id is divisible by `every`.

    Candidates are all rows but the query's own row: repeated rows and rows of one id are candidates, and queries, of
    their own, so that the query_id of two rows has ranks twice. Score: inner product of floor(scale * x); ties go to
    smaller ids; vectors of different lengths are not compared. Vectors that are null or hold a null or non-finite
    component, and rows without an id, take no part. An empty table gives an empty result. Other columns are not read.
    """
    work = Workspace(spark, "top-k")
    rows = work.save(_coded(scaled(vectors, id_col, vector_col, scale)).withColumn("key", F.monotonically_increasing_id()), "vectors")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(F.col("id") % every == 0)).first()
    block = max(block, -(-n // MAX_BLOCKS))
    dealt = rows.repartitionByRange(max(1, -(-n // block)), "size", "code", "key").withColumn("block", F.spark_partition_id().cast("bigint"))
    dealt = work.save(dealt.drop("size", "code"), "dealt")
    work.drop("vectors")
    asked = F.col("id") % every == 0
    blocks, chunks = max(1, -(-n // block)), max(1, -(-n_queries // QUERIES))
    known = spark.sparkContext.broadcast(summaries(dealt))

    home = dealt.select(F.col("block").alias("pair"), "key", "id", "v", F.lit(None).cast("double").alias("least"), asked.alias("query"), F.lit(True).alias("candidate"))
    first = work.save(_searched(home.repartition(blocks, "pair"), k), "home")
    least = first.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).select("key", F.when(F.col("n") >= k, F.col("score").cast("double")).alias("least"))

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[int, np.ndarray]]] = {}
        for (b, size), summary in known.value.items():
            parts.setdefault(size, []).append((b, summary))
        for batch in batches:
            own, at_home = _rows(batch), batch.column("block").to_numpy()
            wanted = np.array([-np.inf if x is None else x for x in batch.column("least").to_pylist()])
            size = np.array([len(v) for v in own], np.int64)
            for n_components in np.unique(size).tolist():
                at = np.flatnonzero(size == n_components)
                queries = np.stack([own[i] for i in at.tolist()])
                for b, summary in parts.get(n_components, []):
                    bound = block_bounds(queries, summary)
                    go = at[(bound * (1 + 1e-9 * np.sign(bound)) + 1 >= wanted[at]) & (at_home[at] != b)]
                    if len(go):
                        take = pa.array(go)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(go), b)), *(batch.column(c).take(take) for c in ("key", "id", "v", "least", "chunk"))], names=["block", "key", "id", "v", "least", "chunk"])

    queries = dealt.where(asked).join(least, "key", "left").withColumn("chunk", F.expr(f"pmod(xxhash64(key), {chunks})").cast("bigint"))
    asking = work.save(queries.select("block", "key", "id", "v", "least", "chunk").mapInArrow(onward, "block bigint, key bigint, id bigint, v array<bigint>, least double, chunk bigint"), "asking")
    wanted = asking.groupBy("block").agg(F.collect_set("chunk").alias("wanted"))  # a row for each block, `chunks` values at most
    given = dealt.join(wanted, "block").select("block", "key", "id", "v", F.lit(None).cast("double").alias("least"), F.explode("wanted").alias("chunk"), F.lit(False).alias("query"), F.lit(True).alias("candidate"))
    both = given.unionByName(asking.withColumns({"query": F.lit(True), "candidate": F.lit(False)})).withColumn("pair", F.col("block") * chunks + F.col("chunk"))
    hits = first.unionByName(_searched(both.repartition(blocks * chunks, "pair"), k))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


OP8_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS key, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.key, q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.key <> q.key
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
