"""Finding all windows of a corpus that occur more than once, without listing each window.

Every window of `width` tokens holds `width - gram + 1` grams; the leftmost least gram hash is its anchor. Equal
windows have equal anchors at equal offsets. Consecutive windows with one anchor form a *super-window*: one row for
many windows (about 2 rows for each `width - gram + 1` tokens). Two windows can only be equal if their super-windows
have the same anchor gram, so

1. `scan` writes one row for each super-window: document, place, anchor gram hash (`key`) and content hash (`cls`);
2. super-windows whose (key, cls) occurs twice hold repeated windows only;
3. of keys with several contents, one copy of each content goes, by key, to a task that looks inside: the caller
   compares contents there by its own method. Keys with more than `hot` contents, which could overfill a task,
   are split further: by a second anchor (`split`), so that the same method works on smaller groups, or, where that
   does not part them either, by counting their windows one by one by hash, with partial sums before the shuffle.

Nothing is sampled or capped: each window is decided by exactly one of these three ways.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import KeyFilter, Workspace, partitions_for, release
from .textops import byte_gram_hashes, gram_hashes, mix, text_blocks, window_minima, word_hashes, word_spans

_PLACE = np.uint64((1 << 32) - 1)
_SECOND = np.uint64(0x5851F42D4C957F2D)
RUN_SCHEMA = "id bigint, rid bigint, first int, last int, key bigint, cls bigint"
CLASS_SCHEMA = "key bigint, cls bigint, anchor int, windows int, content binary"
RANGE_SCHEMA = "key bigint, cls bigint, lo int, hi int, node bigint"


@dataclass(frozen=True)
class Tokens:
    """What a window counts: bytes (unit 1) or words (unit 8, their 64-bit hashes)."""

    words: bool

    def read(self, offsets: np.ndarray, data: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of rows in tokens, the tokens, the hash of each gram of tokens."""
        if not self.words:
            return offsets, data, byte_gram_hashes(data, gram)
        starts, ends, counts = word_spans(offsets, data)
        tokens = word_hashes(data, starts, ends)
        return counts, tokens, gram_hashes(tokens, gram)

    def windows(self, content: bytes, width: int) -> np.ndarray:
        """A hash of each window of a super-window's content."""
        if self.words:
            return gram_hashes(np.frombuffer(content, np.uint64), width)
        return byte_gram_hashes(np.frombuffer(content, np.uint8), width)

    @property
    def unit(self) -> int:
        return 8 if self.words else 1


def super_windows(offsets: np.ndarray, grams: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, last window, anchor of each super-window; places are counted over the whole block."""
    none = np.zeros(0, np.int64)
    count = int(offsets[-1]) - width + 1
    if count <= 0:
        return none, none, none, none
    least = window_minima((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
    bad = np.zeros(count + 1, np.int32)
    ends = offsets[1:]
    np.add.at(bad, np.minimum(np.maximum(offsets[:-1], ends - width + 1), count), 1)
    np.add.at(bad, np.minimum(ends, count), -1)
    at = np.flatnonzero(np.cumsum(bad[:-1]) == 0)
    if not len(at):
        return none, none, none, none
    anchor = (least[at] & _PLACE).astype(np.int64)
    new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new - 1, [len(at) - 1]])
    rows = np.searchsorted(offsets, at[first], "right") - 1
    return rows, at[first], at[last], anchor[first]


def _runs(column: pa.Array, tokens: Tokens, width: int, gram: int, kept: KeyFilter | None) -> Iterator[tuple]:
    for begin, offsets, data in text_blocks(column):
        places, units, grams = tokens.read(offsets, data, gram)
        rows, first, last, anchor = super_windows(places, grams, width, gram)
        keys = grams[anchor].view(np.int64) if len(anchor) else np.zeros(0, np.int64)
        if kept is not None and len(keys):
            hit = kept.hits(keys)
            rows, first, last, anchor, keys = rows[hit], first[hit], last[hit], anchor[hit], keys[hit]
        if not len(keys):
            continue
        memory, unit = memoryview(np.ascontiguousarray(units)).cast("B"), tokens.unit
        parts = [memory[a * unit : (b + width) * unit] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        cls = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts)).view(np.int64)
        yield begin + rows, first - places[rows], last - places[rows], anchor - first, keys, cls, parts


def scan(docs: DataFrame, tokens: Tokens, width: int, gram: int) -> DataFrame:
    """docs: id, rid, text; one row for each super-window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, first, last, _, keys, cls, _ in _runs(batch.column("text"), tokens, width, gram, None):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("rid").take(at), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(keys), pa.array(cls)], names=["id", "rid", "first", "last", "key", "cls"])

    return docs.mapInArrow(run, RUN_SCHEMA)


def contents(docs: DataFrame, tokens: Tokens, width: int, gram: int, keys) -> DataFrame:
    """One row for each content of super-windows that `keys` (a broadcast KeyFilter) lets through, once a task or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, first, last, anchor, key, cls, parts in _runs(batch.column("text"), tokens, width, gram, keys.value):
                if len(seen) > 200_000:
                    seen.clear()
                new = [i for i, c in enumerate(cls.tolist()) if c not in seen and not seen.add(c)]
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(cls[new]), pa.array(anchor[new].astype(np.int32)), pa.array((last - first + 1)[new].astype(np.int32)), pa.array([bytes(parts[i]) for i in new], pa.binary())], names=["key", "cls", "anchor", "windows", "content"])
        release()

    return docs.select("text").mapInArrow(run, CLASS_SCHEMA)


def _filtered(runs: DataFrame, keys) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keys.value.hits(batch.column("key").to_numpy())))

    return runs.mapInArrow(run, RUN_SCHEMA)


def by_key(rows: DataFrame, compare: Callable[[list[tuple]], Iterator[tuple[int, int, int, int, int]]], partitions: int) -> DataFrame:
    """Runs `compare` over the contents of some keys, all of a key together: it yields rows of RANGE_SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.setdefault(row[:2], row)
        found = compare(list(own.values()))
        while part := list(itertools.islice(found, 50_000)):
            yield _ranges(*zip(*part, strict=True))
        del own, found
        release()

    return rows.repartition(partitions, "key").mapInArrow(run, RANGE_SCHEMA)


SPLIT_SCHEMA = "key bigint, cls bigint, first int, sub_key bigint, sub_cls bigint, anchor int, windows int, content binary"


def split(rows: DataFrame, tokens: Tokens, width: int, gram: int) -> DataFrame:
    """Contents of frequent keys (CLASS_SCHEMA, distinct) cut into super-windows by another order of their grams.

    Windows that are equal have equal second anchors too, so they meet under one sub_key; `first` is the place of the
    cut in the content it is from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = tokens.unit
        for batch in batches:
            found = []
            for key, cls, _, _, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                units = np.frombuffer(content, np.uint64 if tokens.words else np.uint8)
                grams = mix((gram_hashes if tokens.words else byte_gram_hashes)(units, gram) ^ _SECOND)
                _, first, last, anchor = super_windows(np.array([0, len(units)]), grams, width, gram)
                for lo, hi, at in zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True):
                    part = content[lo * unit : (hi + width) * unit]
                    found.append((key, cls, lo, int(mix(grams[at : at + 1] ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)).view(np.int64)[0]), _signed(xxhash.xxh3_64_intdigest(part)), at - lo, hi - lo + 1, part))
            if found:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=[f.split()[0] for f in SPLIT_SCHEMA.split(", ")])

    return rows.mapInArrow(run, SPLIT_SCHEMA)


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _ranges(*columns) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "cls", "lo", "hi", "node"])


def one_by_one(rows: DataFrame, tokens: Tokens, width: int) -> DataFrame:
    """The windows of keys with very many contents, each as a range of its own; node is the window's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, cls, _, _, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = tokens.windows(content, width).view(np.int64)
                at = np.arange(len(hashes), dtype=np.int32)
                yield _ranges(np.full(len(at), key), np.full(len(at), cls), at, at, hashes)

    return rows.mapInArrow(run, RANGE_SCHEMA)


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, and rid, which tells documents of one id apart: rows with the same id and text are interchangeable."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(id_col).cast("bigint"), text).alias("rid"), text.alias("text"))


@dataclass
class Found:
    """Super-windows whose key occurs twice (`kept`), and the contents of keys with several."""

    kept: DataFrame
    mild: DataFrame | None
    hot: DataFrame | None
    partitions: int


def find(spark: SparkSession, docs: DataFrame, work: Workspace, tokens: Tokens, width: int, gram: int, hot: int) -> Found:
    """docs: id, rid, text. Super-windows that can hold repeated windows; see the module's description."""
    runs = work.save(scan(docs, tokens, width, gram), "runs")
    keys = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("cls") != F.max("cls")).alias("several")).where("n > 1")
    keys = work.save(keys, "keys")
    n_keys, n_several, n_rows, n_hot = keys.agg(F.count(F.lit(1)), F.count_if("several"), F.sum(F.when(F.col("several"), F.col("n"))), F.count_if(F.col("several") & (F.col("n") > hot))).first()
    context = spark.sparkContext
    kept = work.save(_filtered(runs, context.broadcast(KeyFilter.build(keys.select("key"), n_keys))), "kept")
    work.drop("runs")
    if not n_several:
        return Found(kept, None, None, 1)
    rows = contents(docs, tokens, width, gram, context.broadcast(KeyFilter.build(keys.where("several").select("key"), n_several)))
    partitions = partitions_for(spark, n_rows, 30_000)
    if n_hot:  # of those with many super-windows, the keys with many contents
        many = kept.join(keys.where(F.col("several") & (F.col("n") > hot)).select("key"), "key").groupBy("key", "cls").agg(F.lit(1)).groupBy("key").agg(F.count(F.lit(1)).alias("many")).where(f"many > {hot}")
        many = work.save(many, "many")
        n_hot = many.count()
    if not n_hot:
        return Found(kept, rows, None, partitions)
    rows = work.save(rows.join(many, "key", "left"), "contents")
    return Found(kept, rows.where("many is null").drop("many"), rows.where("many is not null").drop("many").repartition(partitions), partitions)
