"""Suffix-array dedup: bytes of long strings that occur more than once.

Method: a sparse enhanced suffix array over the anchors of super-windows (see superwindows). All anchors of one gram
meet in one task; there their suffixes are sorted, and a stack scan over the array of longest common prefixes walks
the tree of common-prefix intervals. Within an interval the left contexts are compared in the same way: members whose
left contexts differ before the window begins are left-diverse, so that the interval yields maximal repeats with all
their occurrences, not just pairs of neighbours.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Workspace, join_hot
from .superwindows import Tokens, by_key, find, one_by_one, prepared, split
from .textops import text_blocks, word_spans

WIDTH, GRAM = 400, 32
#: Passages of so many words that repeat are marked (and cut in the pipeline), whatever their length in bytes.
PASSAGE, PASSAGE_GRAM = 50, 8


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    low = 0
    while low < high - 1:
        middle = (low + high) >> 1
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def intervals(suffixes: list[bytes], least: int) -> Iterator[tuple[int, list[list[int]]]]:
    """Common-prefix intervals of sorted suffixes, inner ones first: (length, members of each child).

    A stack scan over the common-prefix array; intervals of fewer than `least` bytes are left out.
    """
    stack: list[tuple[int, list[list[int]]]] = [(-1, [])]
    for i, suffix in enumerate(suffixes):
        child = [i]
        length = common_prefix(suffix, suffixes[i + 1]) if i + 1 < len(suffixes) else -1
        while stack[-1][0] > length:
            own, children = stack.pop()
            children.append(child)
            if own >= least:
                yield own, children
            child = list(itertools.chain.from_iterable(children)) if length >= least or stack[-1][0] >= least else []
        if length < least:
            stack = [(-1, [])]
        elif stack[-1][0] == length:
            stack[-1][1].append(child)
        else:
            stack.append((length, [child]))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], width: int, least: int) -> Iterator[tuple[int, int, list[int]]]:
    """Repeats of `width` bytes or more around anchors: (bytes before the anchor, bytes from it on, members).

    lefts: what stands before each anchor, reversed; rights: what stands from it on, sorted.
    """
    for length, children in intervals(rights, least):
        child_of = {m: c for c, members in enumerate(children) for m in members}
        order = sorted(child_of, key=lefts.__getitem__)
        need = max(0, width - length)
        for before, groups in intervals([lefts[m] for m in order], need):
            members = [order[i] for group in groups for i in group]
            if len({child_of[m] for m in members}) > 1:  # else an inner interval has them with a longer right side
                yield before, length, members


def compare(rows: list[tuple], width: int = WIDTH, gram: int = GRAM, unit: int = 1) -> Iterator[tuple[int, int, int, int, int]]:
    """Repeated windows of each content: (key, cls, first, last window, 0), by maximal repeats.

    width and gram count tokens of `unit` bytes. Common prefixes are taken by bytes; what reaches into a token without
    filling it does not count.
    """
    rows.sort(key=lambda r: (r[0], r[4][r[2] * unit :]))
    for _, group in itertools.groupby(rows, key=lambda r: r[0]):
        own = list(group)
        if len(own) < 2:
            continue
        found: list[set[tuple[int, int]]] = [set() for _ in own]
        lefts = [_reversed(r[4][: r[2] * unit], unit) for r in own]
        for before, after, members in maximal_repeats(lefts, [r[4][r[2] * unit :] for r in own], width * unit, gram * unit):
            for m in members:
                _, _, anchor, windows, _ = own[m]
                lo, hi = max(0, anchor - before // unit), min(windows - 1, anchor + after // unit - width)
                if lo <= hi:
                    found[m].add((lo, hi))
        for (key, cls, *_), ranges in zip(own, found, strict=True):
            end = -1
            for lo, hi in sorted(ranges):
                if hi > end:
                    yield key, cls, max(lo, end + 1), hi, 0
                    end = hi


def _reversed(tokens: bytes, unit: int) -> bytes:
    return tokens[::-1] if unit == 1 else np.frombuffer(tokens, np.uint64)[::-1].tobytes()


def covered(size: int, lows: np.ndarray, highs: np.ndarray, width: int) -> np.ndarray:
    """A mask of the tokens covered by windows lows[i] .. highs[i], both included."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, lows, 1)
    np.add.at(steps, highs + width, -1)
    return np.cumsum(steps[:-1]) > 0


def _compared(work: Workspace, name: str, rows: DataFrame, tokens: Tokens, width: int, gram: int, hot: int, partitions: int) -> DataFrame:
    """rows: contents of keys with more than `hot` of them. Their repeated ranges, by the same method on smaller groups."""
    parts = work.save(split(rows.dropDuplicates(["key", "cls"]), tokens, width, gram), name)
    counted = parts.groupBy("sub_key", "sub_cls").agg(F.count(F.lit(1)).alias("n"))
    sizes = work.save(counted.withColumn("more", F.col("n") > 1), f"{name}-classes")
    many = sizes.groupBy("sub_key").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    many = work.save(many, f"{name}-keys")
    total = parts.count()
    # a sub-window that stands in two contents repeats as a whole
    found = join_hot(parts.drop("content", "anchor"), sizes.where("more").select("sub_key", "sub_cls", "n"), ["sub_key", "sub_cls"], "n", total).select("key", "cls", F.col("first").alias("lo"), (F.col("first") + F.col("windows") - 1).alias("hi"))
    if many.isEmpty():
        return found
    held = join_hot(parts, many.withColumnRenamed("contents", "n"), ["sub_key"], "n", total)
    shape = [F.col("sub_key").alias("key"), F.col("sub_cls").alias("cls"), "anchor", "windows", "content"]
    inner = by_key(held.where(f"n <= {hot}").select(*shape), lambda own: compare(own, width, gram, tokens.unit), partitions)
    windows = one_by_one(held.where(f"n > {hot}").dropDuplicates(["sub_key", "sub_cls"]).select(*shape), tokens, width)
    twice = windows.groupBy("key", "node").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("key", "node")
    inner = inner.drop("node").unionByName(windows.join(twice, ["key", "node"]).select("key", "cls", "lo", "hi"))
    inner = work.save(inner.select(F.col("key").alias("sub_key"), F.col("cls").alias("sub_cls"), F.col("lo").alias("x"), F.col("hi").alias("y")), f"{name}-inner")
    placed = parts.select("key", "cls", "first", "sub_key", "sub_cls").join(inner, ["sub_key", "sub_cls"])
    return found.unionByName(placed.select("key", "cls", (F.col("first") + F.col("x")).alias("lo"), (F.col("first") + F.col("y")).alias("hi")))


def repeated_ranges(spark: SparkSession, docs: DataFrame, work: Workspace, width: int, gram: int, hot: int, words: bool = False) -> DataFrame:
    """docs: id, rid, text. Ranges of windows of bytes (or words) that also start elsewhere: id, rid, lo, hi, both included."""
    tokens = Tokens(words)
    found = find(spark, docs, work, tokens, width, gram, hot)
    ranges = found.kept.groupBy("key", "cls").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("last") - F.col("first")).alias("hi")).where("n > 1").select("key", "cls", F.lit(0).alias("lo"), "hi")
    if found.hot is not None:
        ranges = ranges.unionByName(_compared(work, "split", found.hot, tokens, width, gram, hot, found.partitions).distinct())
    if found.mild is not None:
        ranges = ranges.unionByName(by_key(found.mild, lambda rows: compare(rows, width, gram, tokens.unit), found.partitions).drop("node"))
    ranges = work.save(ranges, "ranges")
    work.drop("keys", "contents", "split", "split-classes", "split-keys", "split-inner")
    made = work.save(found.kept.join(ranges, ["key", "cls"]).select("id", "rid", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi")), "repeated")
    work.drop("kept", "ranges")
    return made


def _cut(own: np.ndarray, lo: list[int], hi: list[int], width: int, words: bool) -> tuple[int, int, np.ndarray]:
    """Tokens removed, runs of them, and the bytes that are left; between cut words their white space goes too."""
    if not words:
        gone = covered(len(own), np.array(lo), np.array(hi), width)
    else:
        starts, ends, _ = word_spans(np.array([0, len(own)]), own)
        gone = covered(len(starts), np.array(lo), np.array(hi), width)
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    kept = np.ones(len(own), bool)
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        kept[starts[a] if words else a : ends[b - 1] if words else b] = False
    return int(gone.sum()), len(edges) // 2, own[kept]


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, carry: tuple[str, ...] = (), hot: int = 16_384, words: bool = False, passage: int | None = None) -> DataFrame:
    """Removes each byte covered by a `width`-byte string that also starts anywhere else in the table.

    With `words`, width and gram count words `[^\\x20\\x09-\\x0D]+` instead: each word covered by a `width`-word
    sequence that also starts elsewhere goes, with the white space between such words.

    Returns one row for each row of `docs`: id, n_bytes, n_removed (bytes, or words), n_spans, kept (binary: what is
    left), n_passage_words and, in the struct `rest`, the columns named in `carry`. n_passage_words counts the words
    covered by a sequence of `passage` words that also starts elsewhere, by the same method over words; it is null
    without `passage`. A null text counts as empty. Overlapping occurrences in one document count, matches never cross
    documents, equal rows count as occurrences of each other. An empty table gives an empty result; texts shorter than
    `width` stay whole. Other columns, whatever their names, are not read.
    """
    if not gram < width:
        raise ValueError("gram must be less than width")
    work = Workspace(spark, "suffix-dedup")
    own = prepared(docs, id_col, text_col)
    found = repeated_ranges(spark, own, work, width, gram, hot, words).withColumn("passage", F.lit(False))
    if passage:
        found = found.unionByName(repeated_ranges(spark, own, Workspace(spark, "suffix-passages"), passage, PASSAGE_GRAM, hot, True).withColumn("passage", F.lit(True)))
    own_kind = lambda c, kind: F.collect_list(F.when(F.col("passage") == kind, F.col(c)))
    spans = found.distinct().groupBy("id", "rid").agg(own_kind("lo", False).alias("lo"), own_kind("hi", False).alias("hi"), own_kind("lo", True).alias("plo"), own_kind("hi", True).alias("phi"))
    rest = F.struct(*[docs[c] for c in carry]) if carry else F.lit(0)
    whole = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col)).alias("rid"), F.col(text_col).alias("text"), rest.alias("rest"))
    joined = whole.alias("d").join(spans.alias("s"), F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.rid") == F.col("s.rid")), "left").select("d.id", "d.text", "s.lo", "s.hi", "s.plo", "s.phi", "d.rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi, plo, phi = (batch.column(c).to_pylist() for c in ("lo", "hi", "plo", "phi"))
            for begin, offsets, data in text_blocks(batch.column("text")):
                removed, spans, kept, marked = [], [], [], []
                for i in range(len(offsets) - 1):
                    own, at = data[offsets[i] : offsets[i + 1]], begin + i
                    gone, runs, left = _cut(own, lo[at], hi[at], width, words) if lo[at] else (0, 0, own)
                    removed.append(gone)
                    spans.append(runs)
                    kept.append(left.tobytes())
                    marked.append(int(covered(max(phi[at]) + passage, np.array(plo[at]), np.array(phi[at]), passage).sum()) if plo[at] else 0 if passage else None)
                rows = slice(begin, begin + len(kept))
                yield pa.RecordBatch.from_arrays([batch.column("id")[rows], pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(marked, pa.int64()), batch.column("rest")[rows]], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "n_passage_words", "rest"])

    rest_type = joined.schema["rest"].dataType.simpleString()
    return joined.mapInArrow(run, f"id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, n_passage_words bigint, rest {rest_type}")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), passage=PASSAGE)
    return got.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")
