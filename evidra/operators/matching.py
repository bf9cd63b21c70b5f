"""Substring and mass joins of patterns with sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators import massindex
from evidra.operators.lineage import cut


#: Most bits of the bitmap of pattern keys: 8 MiB are broadcast at most, whatever the number of patterns.
MOST_BITS = 1 << 26
#: Characters looked at at once in a task; arrays of so many numbers stay in a core's cache.
BLOCK = 1 << 17
#: Patterns of up to so many characters are searched together; longer ones by powers of four, each with its own scan.
SHORT = 64
#: Sequences of more characters go to the workers in parts of so many.
PART = 1 << 22
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _STEP
    return x ^ (x >> np.uint64(29))


def window_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of each n consecutive code points, by doubling; int64, len(codes) - n + 1 of them."""
    made, size, whole, done = _stir(codes.astype(np.uint64) + np.uint64(1)), 1, None, 0
    count = len(codes) - n + 1
    while done < n:
        if n & size:
            whole = made[:count] if whole is None else _stir(whole * _ODD + made[done : done + count])
            done += size
        if done < n:
            made = _stir(made[:-size] * _ODD + made[size:])
            size <<= 1
    return whole.view(np.int64)


def _some_rows(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """A column's texts some BLOCK bytes at a time, one at least, with the number of the first: no batch is a list."""
    ends, first, before = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, before + BLOCK, side="right")))
        yield first, [t or "" for t in column.slice(first, last - first).to_pylist()]
        first, before = last, ends[last - 1]


def _blocks(texts: list[str], n: int, passes: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, place and key of every window of n characters whose key passes, BLOCK windows at a time, of a long row too."""
    first = 0
    while first < len(texts):
        last, total = first, 0
        while last < len(texts) and (last == first or total + len(texts[last]) <= BLOCK):
            total += len(texts[last])
            last += 1
        joined, sizes = "".join(texts[first:last]), np.array([len(t) for t in texts[first:last]])
        ends = np.cumsum(sizes)
        for part in range(0, total - n + 1, BLOCK):
            keys = window_keys(np.frombuffer(joined[part : part + BLOCK + n - 1].encode("utf-32-le", "surrogatepass"), "<u4"), n)
            at = np.arange(len(keys)) if passes is None else np.flatnonzero(passes(keys))
            row = np.searchsorted(ends, at + part, side="right")
            inside = at + part + n <= ends[row]
            at, row = at[inside], row[inside]
            yield row + first, at + part - (ends - sizes)[row], keys[at]
        first = last


def _keyed(patterns: DataFrame, n: int) -> DataFrame:
    """patterns: __p, of n characters or more. Adds __key, the key of the first n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer("".join(t[:n] for t in batch.column(0).to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
            keys = window_keys(codes, n)[::n] if len(codes) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys)], names=["__p", "__key"])

    return patterns.select("__p").mapInArrow(run, "__p string, __key bigint")


def _parts(sequences: DataFrame, sequence: str, longest: int) -> tuple[DataFrame, int]:
    """The other columns, __from and __part, and the step: longer sequences in a part from every step on, null in none.

    A part goes on for `longest` - 1 characters after its step, so that it holds whole what begins in the step.
    """
    step, text, rest = max(PART, longest), F.col(sequence), [c for c in sequences.columns if c != sequence]

    def part(begin: Column, own: Column) -> Column:
        return F.struct(begin.cast("int").alias("__from"), own.alias("__part"))

    several = F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)), lambda k: part(k, F.substring(text, k + 1, F.lit(step + longest - 1))))
    made = F.when(F.length(text) <= step, F.array(part(F.lit(0), text))).when(F.length(text) > step, several)
    return sequences.select(*rest, F.inline(made)), step


def _candidates(sequences: DataFrame, sequence: str, keyed: DataFrame, n: int, longest: int) -> DataFrame:
    """The other columns, __key, __at and __text (up to `longest` characters) of places whose key may be a pattern's."""
    spark, bits = sequences.sparkSession, 1 << 12
    count = keyed.count()
    while bits < MOST_BITS and bits < 64 * count:
        bits <<= 1
    word = F.expr(f"cast(shiftright(__key, 6) & {(bits >> 6) - 1}L as int)")
    rows = keyed.groupBy(word.alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(__key & 63 as int)))").alias("b")).toArrow()  # bits / 64 rows at most
    bitmap = np.zeros(bits >> 6, np.int64)
    bitmap[rows["w"].to_numpy()] = rows["b"].to_numpy()
    shared = spark.sparkContext.broadcast(bitmap)
    rest, some = [c for c in sequences.columns if c != sequence], 50_000
    parts, step = _parts(sequences, sequence, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value

        def passes(key: np.ndarray) -> np.ndarray:
            return (bitmap[(key >> 6) & (len(bitmap) - 1)].view(np.uint64) >> (key & 63).view(np.uint64)) & np.uint64(1)

        for batch in batches:
            begins = batch.column("__from").to_numpy()
            for first, texts in _some_rows(batch.column("__part")):
                for row, place, key in _blocks(texts, n, passes):
                    inside = place < step
                    row, place, key = row[inside], place[inside], key[inside]
                    for part in range(0, len(row), some):
                        own = slice(part, part + some)
                        shown = [texts[r][p : p + longest] for r, p in zip(row[own].tolist(), place[own].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row[own] + first)) for c in rest), pa.array(key[own]), pa.array(place[own] + begins[row[own] + first], pa.int32()), pa.array(shown, pa.string())], names=[*rest, "__key", "__at", "__text"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sequences.schema if f.name != sequence)
    return parts.mapInArrow(run, f"{kinds}__key bigint, __at int, __text string")


def substring_join(patterns: DataFrame, sequences: DataFrame, pattern: str = "peptide", sequence: str = "sequence", seed: int = 9) -> DataFrame:
    """All places, overlapping ones too, where a pattern of `seed` characters or more stands in a sequence.

    Tasks key every window of `seed` characters in arrays and test it against a bitmap of the patterns' keys before
    anything becomes a row; what passes meets the patterns in a join by key and is verified letter by letter. The
    bitmap's size is fixed: with more patterns it lets more places through to the join and loses none. Places carry no
    more characters than the longest pattern of their class has, so one long pattern costs a scan of its own only. Null
    patterns and sequences match nothing. Long sequences are searched in parts of PART characters, so a worker holds an
    Arrow batch and a part, whatever a sequence's length. Adds `position`, from 0.
    """
    own = cut(patterns.select(F.col(pattern).alias("__p")).where(F.length("__p") >= seed).distinct())
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.length("__p") / SHORT) / 2)).cast("int")
    classes = own.groupBy(level.alias("k")).agg(F.max(F.length("__p")).alias("longest")).orderBy("k").collect()  # one for each power of four
    rest = [c for c in sequences.columns if c != sequence]
    hits = None
    for k, longest in classes:
        keyed = cut(_keyed(own.where(level == k), seed))
        found = _candidates(sequences, sequence, keyed, seed, longest).join(keyed, "__key").where(F.startswith("__text", "__p"))
        found = found.select(*rest, F.col("__p").alias(pattern), F.col("__at").alias("position"))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = sequences.limit(0).select(*rest, F.lit(None).cast("string").alias(pattern), F.lit(0).alias("position"))
    return patterns.join(hits, pattern)


def mass_vote_join(queries: DataFrame, targets: DataFrame, k: int = 5, least: int = 1, ppm: float = 20.0) -> DataFrame:
    """Mass-tolerant matches of sequences: k-mer mass bins with a band of one, votes for (target, start), then masses.

    queries: query, sequence (50 residues at most), mass. targets: target, sequence. The best start of each query by
    votes, error, target and start: query, target, start, length, votes, error_ppm. See `massindex` for an index that
    is used more than once.
    """
    got = massindex.anchored(massindex.write_index(targets, k, "nearest"), queries, least, ppm)
    return got.select("query", "target", "start", "length", "votes", "error_ppm")


def evidence(hits: DataFrame, scores: DataFrame, samples: int | Column) -> DataFrame:
    """hits: peptide, protein, position. scores: peptide, sample, score. Evidence for each protein.

    Support: min(1, log2(peptides + 1) * sqrt(share of samples) * mean score).
    """
    edges = hits.groupBy("protein", "peptide").agg(F.count(F.lit(1)).alias("n"))
    per_peptide = scores.groupBy("peptide").agg(F.max("score").alias("score"), F.collect_set("sample").alias("samples"))
    joined = edges.join(per_peptide, "peptide")
    own = joined.groupBy("protein").agg(F.sum("n").alias("n_hits"), F.count(F.lit(1)).alias("n_peptides"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.size(F.array_distinct(F.flatten(F.collect_set("samples")))).cast("bigint").alias("n_samples"))
    total = F.lit(samples) if isinstance(samples, int) else samples
    support = F.least(F.lit(1.0), F.log2(F.col("n_peptides") + 1.0) * F.sqrt(F.col("n_samples") / total) * F.col("mean_score"))
    return own.withColumn("support", support)
