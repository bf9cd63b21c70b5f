"""Packing by shortest-pack-first over the length histogram.

Documents become token sequences, cut into pieces of at most `room` tokens. The histogram of piece lengths, at most
`room` rows, goes to the driver, where lengths are placed longest first into the pattern with most space left; counts
of packing patterns are updated, documents are not looked at. Then the patterns are joined back: pieces of one length
are ranked by document, and ranges of ranks belong to patterns.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Workspace, bounded_batches, release

ROOM, END = 4096, 2
#: Encoded words that a worker remembers at most.
MEMORY = 500_000
#: A word between words that are encoded in one text, and how many of them are.
MARK, TOGETHER = "\x01", 256


class WordEncoder:
    """Ids of texts by a tokenizer that never looks across ASCII white space: each distinct word is encoded once."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.lower = '"Lowercase"' in tokenizer_json
        self.number: dict[str, int] = {}
        alone = [self._each([w])[0] for w in ("a", MARK, "b")]
        together = self.tokenizer.encode(f"a {MARK} b", add_special_tokens=False).ids
        self.mark = alone[1][0] if len(alone[1]) == 1 and together == [i for ids in alone for i in ids] else None
        self.clear()

    def _each(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has: encoded together, with a mark behind each.

        Only a mark gives the mark's id in words that don't hold it; words that do are encoded one by one.
        """
        if self.mark is None or any(MARK in w for w in words):
            got = self._each(words)
            lengths = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(lengths.sum())), lengths
        texts = [f" {MARK} ".join([*words[i : i + TOGETHER], ""]) for i in range(0, len(words), TOGETHER)]
        ids = np.concatenate([np.fromiter(x, np.uint32, len(x)) for x in self._each(texts)])
        marks = ids == self.mark
        return ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1) - 1

    def clear(self) -> None:
        self.number.clear()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.number]
        if not new:
            return
        if len(self.number) + len(new) > MEMORY:
            self.clear()
            new = words
        base = len(self.number)
        self.number.update(zip(new, range(base, base + len(new)), strict=True))
        flat, lengths = self._ids(new)
        used = int(self.ends[-1])
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[used : used + len(flat)] = flat
        self.ends = np.concatenate([self.ends, used + np.cumsum(lengths)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts (no nulls), and the offsets of each text in them."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten()
        if self.lower:
            lowered = pc.ascii_lower(words)
            if not pc.any(pc.match_substring(lowered, "<|")).as_py():  # what could be a special token keeps its case
                words = lowered
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn(distinct)
        number = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))
        own = number[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        starts, lengths = self.ends[own], self.ends[own + 1] - self.ends[own]
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(total[-1]) + np.repeat(starts - total[:-1], lengths)
        return self.ids[at], total[bounds]


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer_json: str) -> WordEncoder:
    return WordEncoder(tokenizer_json)


def token_pieces(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, room: int, end: int) -> DataFrame:
    """One row for each piece: id, rid, start, length, ids_crc32, doc_tokens. Null texts are empty: `end` alone."""
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for begin in range(0, len(texts), 1024):
                ids, bounds = encoder.encode(texts[begin : begin + 1024])
                owners, starts, lengths, sums, wholes = [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    whole = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                    for start in range(0, len(whole), room):
                        piece = whole[start : start + room]
                        owners.append(begin + i)
                        starts.append(start)
                        lengths.append(len(piece))
                        sums.append(zlib.crc32(piece.tobytes()))
                        wholes.append(len(whole))
                at = pa.array(owners, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("rid").take(at), *(pa.array(c, pa.int64()) for c in (starts, lengths, sums, wholes))], names=["id", "rid", "start", "length", "ids_crc32", "doc_tokens"])
        release()

    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col)).alias("rid"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id bigint, rid bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack_histogram(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, dict[int, int]]]:
    """Packing patterns for a histogram of lengths: (times, {length: number in the pattern}), with little space left.

    Shortest pack first: lengths are placed longest first; each goes, as many times as both last, to the open pattern
    with most space left, if it fits there, or else begins a new one. Patterns of one filling and content are split
    only where counts differ, so there are about as many patterns as distinct lengths, not as sequences.
    """
    open_packs: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            space = max(open_packs, default=0)
            if space >= length:
                packs = open_packs[space]
                times, content = packs.pop()
                if not packs:
                    del open_packs[space]
                each = 1 if times > left else min(space // length, left // times)
                used = min(times, left)
                if times > used:
                    open_packs.setdefault(space, []).append((times - used, content))
                grown = dict(content)
                grown[length] = grown.get(length, 0) + each
                open_packs.setdefault(space - each * length, []).append((used, grown))
                left -= used * each
            else:
                each = min(room // length, left)
                times = left // each
                open_packs.setdefault(room - each * length, []).append((times, {length: each}))
                left -= times * each
    return [pack for _, packs in sorted(open_packs.items()) for pack in packs]


def allocation(patterns: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks and where they lie: rank r of a length is in the row with first <= r, the last."""
    rows, base, used = [], 0, {}
    for times, content in patterns:
        offset = 0
        for length, each in content.items():
            rows.append((length, used.get(length, 0), base, each, offset))
            used[length] = used.get(length, 0) + times * each
            offset += length * each
        base += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "base", "each", "offset"), columns, strict=True))


def pack(spark: SparkSession, pieces: DataFrame, room: int = ROOM, rows_per_salt: int = 500_000) -> DataFrame:
    """pieces: a table (read again several times) with id, rid, start, length. Adds sequence_id and offset.

    Pieces of one length are ranked by salt, id, rid and start; each length is dealt out over salts, as many as there
    are shuffle partitions or more, whose counts give each salt its first rank.
    """
    total = pieces.count()
    salts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // rows_per_salt))
    salted = pieces.withColumn("salt", F.expr(f"pmod(xxhash64(id, rid, start), {salts})"))
    sums = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `room` rows at most
    bases = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("id", "rid", "start")
    ranked = salted.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1).drop("salt", "base")
    table = spark.sparkContext.broadcast(allocation(pack_histogram(histogram, room)))
    names = [c for c in ranked.columns if c != "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        starts = np.searchsorted(rows["length"], np.arange(room + 2))
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.zeros(len(rank), np.int64)
            for own in np.unique(length).tolist():
                here = length == own
                a, b = starts[own], starts[own + 1]
                at[here] = a + np.searchsorted(rows["first"][a:b], rank[here], "right") - 1
            nth = rank - rows["first"][at]
            sequence = rows["base"][at] + nth // rows["each"][at]
            offset = rows["offset"][at] + nth % rows["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, end: int = END) -> DataFrame:
    """Tokenises, cuts and packs all documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each row of `docs`, also a null (empty) text or a repeated row, ends with the id `end` and lies in sequences as a
    whole; texts longer than a sequence are cut into full pieces and a rest. An empty table gives an empty result.
    Other columns are not read. Of equal rows it is not defined which takes which place.
    """
    work = Workspace(spark, "packing")
    pieces = work.save(token_pieces(spark, docs, tokenizer_path, id_col, text_col, room, end), "pieces")
    return pack(spark, pieces, room).drop("rid")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
