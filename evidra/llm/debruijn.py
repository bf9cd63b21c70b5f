"""Substring dedup by De Bruijn compaction over words.

Edges of the graph are windows of `width` words, nodes the `width - 1` words that two consecutive windows share.
Super-windows (see superwindows) are the super-k-mers of minimiser-partitioned De Bruijn construction: all edges that
can be equal meet in one task. There, non-branching runs of edges become *fragments*, so that each edge lies in one
fragment, wherever it occurs. Spark joins then compact the graph: repeated fragments are glued where each occurrence
of the one is followed by the other and each occurrence of the other preceded by the one. Each occurrence of a glued
path is a span in source coordinates; at the end the words at those coordinates are read again, and a span counts as
repeated only where another occurrence of its path has the same words. Which words go is settled by the counts of
fragments; gluing makes the spans that are read again few and long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Workspace, join_hot
from .suffix_dedup import covered
from .superwindows import Tokens, by_key, find, one_by_one, prepared
from .textops import gram_hashes, text_blocks

WIDTH, GRAM = 35, 8


def fragments_of(rows: list[tuple], width: int = WIDTH) -> Iterator[tuple[int, int, int, int, int]]:
    """Non-branching runs of edges in the contents of some keys: (key, cls, first, last edge, hash of the words).

    Two consecutive edges stay together if each occurrence of the first is followed by the second, and each occurrence
    of the second preceded by the first; ends of contents count as other neighbours.
    """
    if not rows:
        return
    words = [np.frombuffer(r[4], np.uint64) for r in rows]
    sizes = np.array([len(w) - width + 1 for w in words])
    at = np.cumsum([0, *sizes])
    all_words = np.cumsum([0, *map(len, words)])
    edges = gram_hashes(np.concatenate(words), width)[np.arange(at[-1]) + np.repeat(all_words[:-1] - at[:-1], sizes)]
    edges = edges ^ np.repeat(np.array([r[0] for r in rows], np.int64).view(np.uint64), sizes)
    _, code = np.unique(edges, return_inverse=True)
    after = np.append(code[1:], -1)
    after[at[1:] - 1] = -1
    before = np.insert(code[:-1], 0, -1)
    before[at[:-1]] = -1
    order = np.argsort(code, kind="stable")
    begins = np.flatnonzero(np.diff(code[order], prepend=-1))
    one_after = np.minimum.reduceat(after[order], begins) == np.maximum.reduceat(after[order], begins)
    one_before = np.minimum.reduceat(before[order], begins) == np.maximum.reduceat(before[order], begins)
    glued = one_after[code[:-1]] & one_before[code[1:]]
    glued[at[1:-1] - 1] = False
    first = np.concatenate([[0], np.flatnonzero(~glued) + 1])
    last = np.append(first[1:] - 1, at[-1] - 1)
    owner = np.searchsorted(at, first, "right") - 1
    for lo, hi, i in zip((first - at[owner]).tolist(), (last - at[owner]).tolist(), owner.tolist(), strict=True):
        node = xxhash.xxh3_64_intdigest(rows[i][4][lo * 8 : (hi + width) * 8])
        yield rows[i][0], rows[i][1], lo, hi, node - (node >> 63 << 64)


def fragments(spark: SparkSession, docs: DataFrame, work: Workspace, width: int, gram: int, hot: int) -> DataFrame:
    """docs: id, rid, text. Occurrences of repeated fragments: id, rid, lo, hi (edges, both included), node, n."""
    tokens = Tokens(words=True)
    found = find(spark, docs, work, tokens, width, gram, hot)
    runs = found.kept
    whole = runs.select("id", "rid", F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("cls").alias("node"))
    if found.mild is not None:
        inner = by_key(found.mild, lambda rows: fragments_of(rows, width), found.partitions)
        if found.hot is not None:
            inner = inner.unionByName(one_by_one(found.hot, tokens, width).distinct())
        inner = inner.withColumn("inner", F.lit(True))
        whole = runs.join(inner, ["key", "cls"], "left").select("id", "rid", (F.col("first") + F.coalesce("lo", F.lit(0))).alias("lo"), F.when(F.col("inner"), F.col("first") + F.col("hi")).otherwise(F.col("last")).alias("hi"), F.coalesce("node", "cls").alias("node"))
    occurrences = work.save(whole, "occurrences")
    counts = work.save(occurrences.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    return join_hot(occurrences, counts, ["node"], "n", occurrences.count())


def compact(found: DataFrame, work: Workspace) -> DataFrame:
    """found: id, rid, lo, hi, node, n. Occurrences of glued paths: id, rid, lo, hi, path.

    Successors are those in source coordinates. One aggregation counts links; a link as frequent as both its ends is
    glued, and a window over each document joins the fragments that glued links connect.
    """
    place = Window.partitionBy("id", "rid").orderBy("lo", "hi")
    follows = F.lead("lo").over(place) == F.col("hi") + 1
    linked = found.withColumns({"next": F.when(follows, F.lead("node").over(place)), "next_n": F.when(follows, F.lead("n").over(place))})
    linked = work.save(linked, "linked")
    links = linked.where("n = next_n").groupBy("node", "next").agg(F.count(F.lit(1)).alias("times"), F.first("n").alias("n"))
    glue = work.save(links.where("times = n").select("node", "next", "times", F.lit(True).alias("glued")), "glue")
    marked = join_hot(linked.drop("n", "next_n"), glue, ["node", "next"], "times", linked.count(), "left").drop("times")
    start = F.when(F.lag("glued").over(place), 0).otherwise(1)
    parts = marked.withColumn("start", start).withColumn("part", F.sum("start").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("id", "rid", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("node", "lo").alias("path")).drop("part")


def _apply(docs: DataFrame, paths: DataFrame, width: int) -> DataFrame:
    """docs: id, rid, text; paths: those of compact(). Adds what is left and a digest of each span's words."""
    spans = paths.groupBy("id", "rid").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"), F.collect_list("path").alias("path"))
    joined = docs.alias("d").join(spans.alias("s"), F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.rid") == F.col("s.rid")), "left").select("d.id", "d.rid", "d.text", "s.lo", "s.hi", "s.path")
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("path", pa.int64()), ("digest", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs, paths = (batch.column(c).to_pylist() for c in ("lo", "hi", "path"))
            for begin, offsets, data in text_blocks(batch.column("text")):
                memory = data.tobytes()
                n_words, removed, kept, proofs = [], [], [], []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    words, own, gone = memory[a:b].split(), [], 0
                    n_words.append(len(words))
                    if lo := lows[begin + i]:
                        hi = highs[begin + i]
                        for x, y, p in zip(lo, hi, paths[begin + i], strict=True):
                            own.append({"lo": x, "hi": y, "path": p, "digest": hashlib.blake2b(b" ".join(words[x : y + width]), digest_size=16).digest()})
                        mask = covered(len(words), np.array(lo), np.array(hi), width)
                        gone = int(mask.sum())
                        words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                    removed.append(gone)
                    kept.append(b" ".join(words))
                    proofs.append(own)
                rows = slice(begin, begin + len(kept))
                yield pa.RecordBatch.from_arrays([batch.column("id")[rows], batch.column("rid")[rows], pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(proofs, span)], names=["id", "rid", "n_words", "n_removed", "kept", "spans"])

    return joined.mapInArrow(run, "id bigint, rid bigint, n_words bigint, n_removed bigint, kept binary, spans array<struct<lo: int, hi: int, path: bigint, digest: binary>>")


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = 16_384) -> DataFrame:
    """Removes each word covered by a window of `width` words that also starts anywhere else in the table.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Returns one row for each row of `docs`: id, n_words, n_removed, kept
    (binary: the words left, joined by one space) and spans (lo, hi: first and last window, path, digest). A null text
    has no words. Overlapping occurrences in one document count, windows never cross documents, equal rows count as
    occurrences of each other. An empty table gives an empty result. Other columns are not read.
    """
    if not gram < width:
        raise ValueError("gram must be less than width")
    work = Workspace(spark, "debruijn")
    own = prepared(docs, id_col, text_col)
    found = work.save(fragments(spark, own, work, width, gram, hot), "fragments")
    work.drop("keys", "contents", "kept", "occurrences", "counts")
    # equal rows (same id and text) have the same coordinates; one of them stands for all
    paths = work.save(compact(found.distinct(), work), "paths")
    work.drop("fragments", "linked", "glue")
    applied = work.save(_apply(own, paths, width), "applied")
    proofs = applied.select("id", "rid", F.explode("spans").alias("s")).select("id", "rid", "s.*")
    mixed = proofs.groupBy("path").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("path")
    if mixed.isEmpty():
        return applied.drop("rid")
    # a hash stood for different words: keep the spans whose words another occurrence shares, and apply again
    kinds = proofs.join(mixed, "path", "left_semi").groupBy("path", "digest").agg(F.count(F.lit(1)).alias("n")).where("n < 2")
    proved = work.save(proofs.join(kinds.select("path", "digest"), ["path", "digest"], "left_anti").select("id", "rid", "lo", "hi", "path").distinct(), "proved")
    return _apply(own, proved, width).drop("rid")


def op10_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
