"""N-gram Jaccard self-join of documents by T-occurrence search.

1. `sets` hashes each document's distinct shingles; equal sets are one *class* from here on.
2. Blocking without loss: for a size range, the universe of shingles is split into twice as many parts as two linked
   sets can differ in. Parts have one order for all sets, those with most rare shingles first; by the prefix principle
   linked sets agree in one of their first d + 1 parts, where d is the greatest difference, so only these are sent.
   Which shingles are frequent is counted over all documents; it changes the order, never the result. Classes that
   agree in a part are joined to the least of them, already within a map task; connected components of these links are
   *blocks*, and linked classes are always in one block.
3. In a block, T-occurrence search by DivideSkip finds links: a query's short inverted lists are merged, candidates
   seen often enough there are probed by binary search in the long lists, and those that reach the required overlap
   are links. Candidates that are connected with the query already are not probed again, so copies cost no pairs.
4. Blocks of more than `block_limit` classes are dealt out: classes first meet a few pivots; what isn't connected with
   the block's main part then searches all of the block, chunk by chunk. All blocks are searched completely.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected
from .exact_dedup import PLACE, in_files
from .sqltext import similarity_sql
from .storage import KeyFilter, Workspace, join_hot, partitions_for, release
from .textops import gram_hashes, lower_ascii, mix, text_blocks, word_hashes, word_spans

SHINGLE, PERCENT = 4, 85
#: Of the stage that drops near copies: five words, similarity of 0.8.
STAGE_SHINGLE, STAGE_PERCENT = 5, 80
BROADCAST_ROWS = 4_000_000
#: A shingle of more classes than this is frequent: parts of frequent shingles alone come last.
FREQUENT = 8


#: From offsets and values of sets: row and 64-bit signature of each signature that a set has.
Signer = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Sizes:
    """Size ranges and numbers of parts. Linked sets are in one range or in neighbouring ones."""

    percent: int

    @functools.lru_cache(maxsize=8)  # noqa: B019
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each range: its start, its number of parts, how many of them can differ at most."""
        starts, differ = [1], []
        while starts[-1] < 1 << 40:
            low = starts[-1]
            starts.append(max(low + 1, (low - 1) * 100 // self.percent + 1))
        for _, end in itertools.pairwise(starts):
            most = end - 1 + (end - 1) * 100 // self.percent
            differ.append(most * (100 - self.percent) // (100 + self.percent))
        return np.array(starts[:-1]), 2 * np.array(differ) + 1, np.array(differ)


def required(x: np.ndarray | int, y: np.ndarray | int, percent: int):
    """The least overlap that makes sets of these sizes linked: 100 * overlap >= percent * union."""
    return -((-percent * (x + y)) // (100 + percent))


def shingle_sets(column: pa.Array, size: int, target: int = 1 << 17, most: int = 1024) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, offsets and sorted distinct shingle hashes of runs of rows.

    A row with fewer than `size` words has its whole sequence as one shingle; a row without words has none.
    """
    for begin, offsets, data in text_blocks(column, target, most):
        data = lower_ascii(data)
        starts, ends, counts = word_spans(offsets, data)
        words = word_hashes(data, starts, ends)
        grams = gram_hashes(words, size)
        n = np.diff(counts)
        own = np.where(n >= size, n - size + 1, n > 0)
        begins = np.cumsum(own) - own
        values = np.zeros(int(own.sum()), np.uint64)
        rows = np.repeat(np.arange(len(n)), own)
        at = np.arange(len(values)) - begins[rows] + counts[:-1][rows]
        long = (n >= size)[rows]
        values[long] = grams[at[long]] if len(grams) else 0
        for i in np.flatnonzero((n > 0) & (n < size)).tolist():
            values[begins[i]] = mix(gram_hashes(words[counts[i] : counts[i + 1]], int(n[i])) + np.uint64(n[i]))[0]
        for i in np.flatnonzero(own > 1).tolist():  # rows are sorted one by one, which is faster than all by two keys
            values[begins[i] : begins[i] + own[i]].sort()
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        values, rows = values[new], rows[new]
        yield begin, np.searchsorted(rows, np.arange(len(n) + 1)), values


def class_ids(offsets: np.ndarray, values: np.ndarray) -> list[bytes]:
    """A 128-bit hash of each set; empty for empty sets."""
    memory = memoryview(values).cast("B")
    return [xxhash.xxh3_128_digest(memory[a * 8 : b * 8]) if a < b else b"" for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def short_ids(ids: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(i[:8] for i in ids), np.int64)


def df_keys(values: np.ndarray) -> np.ndarray:
    """Keys by which shingles are counted: 32 bits of the hash, placed for KeyFilter."""
    return ((values >> np.uint64(32)) << np.uint64(20)).view(np.int64)


def signatures(offsets: np.ndarray, values: np.ndarray, percent: int, frequent: KeyFilter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the first parts of each set, for the set's size range and the one below it.

    The order of parts, the same for all sets, is by rare shingles (most first), shingles, hash; empty parts are last.
    """
    starts, parts, differ = Sizes(percent).table()
    n = np.diff(offsets)
    rows = np.repeat(np.arange(len(n)), n)
    rare = np.ones(len(values), np.int64) if frequent is None or not len(values) else (~frequent.hits(df_keys(values))).astype(np.int64)
    own = np.searchsorted(starts, n, "right") - 1
    found_rows, found = [], []
    for level in (own, own - 1):
        ok = (n > 0) & (level >= 0)
        m = np.where(ok, parts[level], 0)
        held = ok[rows]
        r, v = rows[held], values[held]
        if not len(r):
            continue
        part = ((v >> np.uint64(32)) * m[r].astype(np.uint64)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (part[1:] != part[:-1])]))
        owner, size = r[first], np.diff(np.append(first, len(r)))
        label = level[owner].astype(np.uint64) * np.uint64(1 << 32) + part[first]
        content = mix(np.add.reduceat(mix(v.copy()), first) + mix(label + np.uint64(1)))
        order = np.lexsort((content, -size, -np.add.reduceat(rare[held], first), owner))
        owner, content = owner[order], content[order]
        full = np.bincount(owner, minlength=len(n))
        rank = np.arange(len(owner)) - (np.cumsum(full) - full)[owner]
        sent = rank <= differ[level[owner]]
        found.append(content[sent])
        found_rows.append(owner[sent])
        for i in np.flatnonzero(ok & (full <= differ[level])).tolist():
            empty = np.setdiff1d(np.arange(m[i]), part[r == i])[: differ[level[i]] + 1 - full[i]]
            found.append(mix(mix(np.uint64(level[i]) * np.uint64(1 << 32) + empty.astype(np.uint64) + np.uint64(1))))
            found_rows.append(np.full(len(empty), i))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(found_rows), np.concatenate(found)


def frequent_shingles(docs: DataFrame, partitions: int, size: int, least: int = FREQUENT, flush: int = 1_000_000) -> DataFrame:
    """docs: text. Keys (see df_keys) of shingles of more than `least` classes, counted over all documents."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, seen = [], 0, set()

        def done() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            return _packed(0, keys, counts, partitions * 4)

        for batch in batches:
            for _, offsets, values in shingle_sets(batch.column("text"), size):
                ids = class_ids(offsets, values)
                new = np.array([bool(i) and i not in seen and not seen.add(i) for i in ids], bool)
                if len(seen) > 200_000:
                    seen.clear()
                kept.append(df_keys(values[np.repeat(new, np.diff(offsets))]))
                held += len(kept[-1])
                if held > flush:
                    yield done()
                    held = 0
        if kept:
            yield done()
        release()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _unpacked(batches)
        while held:
            _, (keys, counts) = held.popitem()
            keys, place = np.unique(keys, return_inverse=True)
            total = np.bincount(place, weights=counts)
            yield pa.RecordBatch.from_arrays([pa.array(keys[total > least])], names=["key"])
        release()

    return docs.mapInArrow(emit, PACKED_SCHEMA).repartition(partitions, "part").mapInArrow(gather, "key bigint")


def star(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with one key, the least node, and links of all others to it: keys, least nodes, links from, links to."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    least = nodes[np.flatnonzero(first)][np.cumsum(first) - 1]
    far = nodes != least
    links = np.unique(np.stack([nodes[far], least[far]], 1), axis=0)
    return keys[first], nodes[first], links[:, 0], links[:, 1]


PACKED_SCHEMA = "part int, kind tinyint, a binary, b binary"


def _packed(kind: int, a: np.ndarray, b: np.ndarray, partitions: int) -> pa.RecordBatch:
    """Pairs as one row for each partition that they belong to by `a`, so that Spark moves few rows."""
    a, b = a.view(np.int64), b.view(np.int64)
    part = (mix(a.view(np.uint64).copy()) % np.uint64(partitions)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    a, b, part = a[order], b[order], part[order]
    names, first = np.unique(part, return_index=True)
    ends = np.append(first[1:], len(part))[: len(first)]
    cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(np.full(len(names), kind, np.int8)), cut(a), cut(b)], names=["part", "kind", "a", "b"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """All pairs by partition and kind."""
    held: dict[tuple[int, int], tuple[list, list]] = {}
    for batch in batches:
        for part, kind, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = held.setdefault((part, kind), ([], []))
            own[0].append(np.frombuffer(a, np.int64))
            own[1].append(np.frombuffer(b, np.int64))
    whole = {}
    while held:  # parts are freed one by one
        k, (a, b) = held.popitem()
        whole[k] = np.concatenate(a), np.concatenate(b)
    return whole


def part_signatures(percent: int, frequent=None) -> Signer:
    """The first parts of each set; frequent: a broadcast KeyFilter."""
    return lambda offsets, values: signatures(offsets, values, percent, frequent and frequent.value)


def blocking_links(docs: DataFrame, partitions: int, size: int, sign: Signer, flush: int = 400_000, target: int = 1 << 17) -> DataFrame:
    """docs: text. Links a, b between (short ids of) classes that agree in a signature of those that `sign` gives."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held, seen = [], [], 0, set()

        def done() -> Iterator[pa.RecordBatch]:
            if keys:
                k, n, a, b = star(np.concatenate(keys).view(np.int64), np.concatenate(nodes))
                yield _packed(0, k, n, partitions * 4)
                yield _packed(1, a, b, partitions * 4)
                keys.clear()
                nodes.clear()

        for batch in batches:
            for _, offsets, values in shingle_sets(batch.column("text"), size, target):
                ids = class_ids(offsets, values)
                new = np.array([bool(i) and i not in seen and not seen.add(i) for i in ids], bool)
                if len(seen) > 200_000:
                    seen.clear()
                n = np.diff(offsets)
                kept = np.concatenate([[0], np.cumsum(n[new])])
                rows, sigs = sign(kept, values[np.repeat(new, n)])
                keys.append(sigs)
                nodes.append(short_ids([i for i, own in zip(ids, new.tolist(), strict=True) if own])[rows])
                held += len(sigs)
                if held > flush:
                    yield from done()
                    held = 0
        yield from done()
        release()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _unpacked(batches)
        for part in sorted({p for p, _ in held}):
            none = np.zeros(0, np.int64)
            _, _, x, y = star(*held.pop((part, 0), (none, none)))
            a, b = held.pop((part, 1), (none, none))
            links = np.unique(np.stack([np.concatenate([x, a]), np.concatenate([y, b])], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])
        release()

    return docs.mapInArrow(emit, PACKED_SCHEMA).repartition(partitions, "part").mapInArrow(gather, "a bigint, b bigint")


class Forest:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def divide_skip(sets: list[np.ndarray], queries: list[int], indexed: list[int], percent: int, forest: Forest) -> Iterator[tuple[int, int]]:
    """T-occurrence search of `queries` in an inverted index of `indexed`: links that connect more than was connected.

    A linked set shares at least T of the query's tokens. The L longest lists of the query are left out of the merge;
    a result then occurs at least T - L times in the others. Each candidate is probed in the long lists.
    """
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate([sets[i] for i in indexed])
    owners = np.repeat(np.arange(len(indexed)), sizes[indexed])
    order = np.lexsort((owners, tokens))
    owners = owners[order]
    names, begins = np.unique(tokens[order], return_index=True)
    ends = np.append(begins[1:], len(owners))
    place = np.repeat(np.arange(len(names)), ends - begins) * len(indexed) + owners
    own_sizes = sizes[indexed]
    position = {s: k for k, s in enumerate(indexed)}
    for q in queries:
        n = int(sizes[q])
        least = -(-percent * n // 100)
        at = np.searchsorted(names, sets[q])
        at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == sets[q])]
        if len(at) < least:
            continue
        lengths = ends[at] - begins[at]
        by_length = np.argsort(-lengths, kind="stable")
        longest = int(lengths[by_length[0]])
        n_long = min(least - 1, int(least / (0.01 * np.log2(longest + 1) + 1)))
        long, short = at[by_length[:n_long]], at[by_length[n_long:]]
        merged = np.concatenate([owners[b:e] for b, e in zip(begins[short].tolist(), ends[short].tolist(), strict=True)])
        if len(merged) * 8 < len(indexed):  # few entries against the block: sorted runs are merged
            candidates, seen = np.unique(merged, return_counts=True)
        else:
            seen = np.bincount(merged, minlength=len(indexed))
            candidates = np.flatnonzero(seen >= least - n_long)
            seen = seen[candidates]
        fit = (seen >= least - n_long) & (own_sizes[candidates] * 100 >= percent * n) & (n * 100 >= percent * own_sizes[candidates]) & (candidates != position.get(q, -1))
        candidates, seen = candidates[fit], seen[fit]
        order = np.argsort(-seen, kind="stable")
        candidates, seen = candidates[order], seen[order]
        step = 4
        while len(candidates):
            now, candidates, count, seen = candidates[:step], candidates[step:], seen[:step], seen[step:]
            apart = np.array([forest.root(indexed[c]) != forest.root(q) for c in now.tolist()], bool)
            now, count = now[apart], count[apart]
            if len(now):
                probes = (long[:, None] * len(indexed) + now[None, :]).ravel()
                hit = np.searchsorted(place, probes)
                found = (place[np.minimum(hit, len(place) - 1)] == probes).reshape(len(long), len(now)).sum(0) + count
                for c in now[found >= required(n, own_sizes[now], percent)].tolist():
                    if forest.join(q, indexed[c]):
                        yield q, indexed[c]
            step = min(step * 4, 256)


def _shipped_sets(docs: DataFrame, wanted, size: int) -> DataFrame:
    """docs: text. short, cls, tokens of classes whose short id `wanted` (a broadcast KeyFilter) lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, offsets, values in shingle_sets(batch.column("text"), size):
                memory = memoryview(values).cast("B")
                ids = class_ids(offsets, values)
                full = [i for i, c in enumerate(ids) if c]
                short = short_ids([ids[i] for i in full])
                hit = wanted.value.hits(short) if len(short) else []
                own = [(i, s) for i, s, h in zip(full, short.tolist(), hit, strict=True) if h and ids[i] not in seen and not seen.add(ids[i])]
                if len(seen) > 200_000:
                    seen.clear()
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([s for _, s in own], pa.int64()), pa.array([ids[i] for i, _ in own], pa.binary()), pa.array([bytes(memory[offsets[i] * 8 : offsets[i + 1] * 8]) for i, _ in own], pa.binary())], names=["short", "cls", "tokens"])

    return docs.mapInArrow(run, "short bigint, cls binary, tokens binary")


def _search(rows: DataFrame, partitions: int, percent: int) -> DataFrame:
    """rows: block, cls, tokens, query, index. Links a, b (classes).

    A block's rows come one after the other, so that a worker holds one block at a time.
    """

    def links(own: dict[bytes, tuple]) -> Iterator[pa.RecordBatch]:
        names = sorted(own)
        sets = [np.frombuffer(own[c][0], np.uint64) for c in names]
        queries, indexed = ([i for i, c in enumerate(names) if own[c][k]] for k in (1, 2))
        if queries and indexed and len(names) > 1:
            found = list(divide_skip(sets, queries, indexed, percent, Forest(len(names))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in found], pa.binary()), pa.array([names[j] for _, j in found], pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = {}, None
        for batch in batches:
            for block, cls, tokens, query, index in zip(*batch.columns, strict=True):
                if block.as_py() != now:
                    yield from links(own)
                    own, now = {}, block.as_py()
                name = cls.as_py()
                old = own.get(name)
                own[name] = (old[0] if old else tokens.as_py(), query.as_py() or bool(old and old[1]), index.as_py() or bool(old and old[2]))
        yield from links(own)
        release()

    return rows.select("block", "cls", "tokens", "query", "index").repartition(partitions, "block").sortWithinPartitions("block").mapInArrow(run, "a binary, b binary")


def _large_blocks(members: DataFrame, work: Workspace, percent: int, chunk: int, chunk_tokens: int) -> DataFrame:
    """members: block, k, size, cls, tokens of blocks with many classes (k) or many shingles (size).

    Links a, b that connect what is connected there.
    """
    spark = work.spark
    chunks = F.greatest(F.ceil(F.col("k") / chunk), F.ceil(F.col("size") / chunk_tokens)).cast("int")
    dealt = work.save(members.withColumn("chunks", chunks).withColumn("chunk", F.expr("pmod(xxhash64(cls), chunks)").cast("int")), "dealt")
    pivots = dealt.where(F.expr("pmod(xxhash64(cls, 1), greatest(1, k div 16)) = 0"))
    everywhere = pivots.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    first = dealt.withColumns({"query": F.lit(True), "index": F.lit(False)}).unionByName(everywhere.withColumns({"query": F.lit(False), "index": F.lit(True)}))
    units = dealt.select("block", "chunks").distinct().agg(F.sum("chunks")).first()[0] or 0
    links = work.save(_search(first.withColumn("block", F.xxhash64("block", "chunk")), partitions_for(spark, units, 1), percent), "pivot-links")
    roots = connected(links, work, "pivot-components")
    labelled = dealt.select("block", "cls", "chunk", "chunks").distinct().join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    labelled = work.save(labelled, "labelled")
    main = labelled.where("root is not null").groupBy("block", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("block").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    apart = work.save(labelled.join(main, "block", "left").where("root is null or root <> main").drop("root", "main"), "apart")
    groups = work.save(apart.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("groups"), F.first("chunks").alias("chunks")), "groups")
    units = groups.agg(F.sum(F.expr("groups * chunks"))).first()[0] or 0
    groups = groups.select("block", "groups")
    index = dealt.join(groups, "block").withColumn("group", F.explode(F.expr("sequence(0, groups - 1)"))).withColumns({"query": F.lit(False), "index": F.lit(True)})
    asking = apart.join(groups, "block").select("cls", F.expr("pmod(xxhash64(cls, 2), groups)").cast("int").alias("group"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"))
    query = dealt.drop("chunk").join(asking, "cls").withColumns({"query": F.lit(True), "index": F.lit(False)})
    index = index.select("block", "cls", "tokens", "chunk", "group", "query", "index")
    second = index.unionByName(query.select(*index.columns)).withColumn("block", F.xxhash64("block", "chunk", "group"))
    return links.unionByName(_search(second, partitions_for(spark, units, 1), percent))


def sized_rows(work: Workspace, docs: DataFrame, id_col: str, text_col: str, size: int, carry: str | None) -> tuple[DataFrame, DataFrame]:
    """`docs` as id, text, carried, and a table of id, n (shingles), cls, short (the class in 64 bits), carried."""
    carried = F.col(carry) if carry else F.lit(0)
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), carried.alias("carried"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, offsets, values in shingle_sets(batch.column("text"), size):
                rows = slice(begin, begin + len(offsets) - 1)
                ids = class_ids(offsets, values)
                short = short_ids([i or bytes(8) for i in ids])
                yield pa.RecordBatch.from_arrays([batch.column("id")[rows], pa.array(np.diff(offsets)), pa.array(ids, pa.binary()), pa.array(short), batch.column("carried")[rows]], names=["id", "n", "cls", "short", "carried"])

    return own, work.save(own.mapInArrow(run, f"id bigint, n bigint, cls binary, short bigint, carried {own.schema['carried'].dataType.simpleString()}"), "sizes")


def confirmed(work: Workspace, own: DataFrame, sized: DataFrame, candidates: DataFrame, size: int, percent: int, block_limit: int, block_tokens: int, carry: str | None) -> DataFrame:
    """Groups of linked rows; candidates: links a, b between short ids of classes, each link of sets being inside a
    connected component of them. Such components are blocks, searched whole on full sets; see `join` for the rest.
    """
    spark = work.spark
    texts = own.select("text")
    blocks = work.save(connected(candidates, work, "blocks"), "members")
    wanted = spark.sparkContext.broadcast(KeyFilter.build(blocks.select("node"), blocks.count()))
    shingles = sized.where("n > 0").groupBy("short").agg(F.max("n").alias("n"))
    weighed = work.save(blocks.join(shingles, F.col("node") == F.col("short")).select("short", F.col("root").alias("block"), "n"), "weighed")
    counts = weighed.groupBy("block").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("size"))
    is_large = F.expr(f"k > {block_limit} or size > {block_tokens}")
    counts = work.save(counts.withColumn("large", is_large), "counts")
    n_small, tokens, large = counts.agg(F.sum(F.expr("if(large, 0, k)")), F.sum(F.expr("if(large, 0, size)")), F.count_if("large")).first()
    known = weighed.drop("n").join(counts, "block")
    members = _shipped_sets(texts, wanted, size).join(known, "short").drop("short")
    if large:
        members = work.save(members, "sets")
    small = members.where("not large").withColumns({"query": F.lit(True), "index": F.lit(True)})
    partitions = max(partitions_for(spark, n_small or 0, 4_000), partitions_for(spark, tokens or 0, 2_000_000))
    exact = _search(small, partitions, percent)
    if large:
        exact = exact.unionByName(_large_blocks(members.where("large").drop("large"), work, percent, max(1, block_limit // 2), max(1, block_tokens // 2)))
    roots = connected(exact, work, "links")
    counts = work.save(sized.groupBy("cls").agg(F.count(F.lit(1)).alias("k")).join(roots, F.col("cls") == F.col("node")).select("cls", "root", "k"), "class-roots")
    tagged = join_hot(sized.drop("short"), counts, ["cls"], "k", sized.count(), "left").drop("k").withColumn("root", F.coalesce("root", "cls"))
    tagged = work.save(tagged, "tagged")
    work.drop("sizes", "frequent", "sets", "dealt", "pivot-links", "labelled", "apart", "groups", "weighed", "counts", "class-roots")
    least = tagged.where("n > 0").groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1")
    joined = join_hot(tagged, least, ["root"], "k", tagged.count(), "left")
    component = F.when((F.col("n") > 0) & F.col("k").isNotNull(), F.col("least")).otherwise(F.col("id"))
    return joined.select("id", F.col("n").alias("n_shingles"), "cls", component.alias("component_id"), *(["carried", "root"] if carry else []))


def join(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, block_limit: int = 2000, block_tokens: int = 2_000_000, carry: str | None = None) -> DataFrame:
    """Links documents whose sets of distinct `size`-word shingles have a Jaccard similarity of `percent` / 100 or more.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; fewer than `size` words make one shingle. Returns one row
    for each row of `docs`: id, n_shingles, cls (16 bytes, the same for equal sets, empty for none), component_id (the
    least id reachable by links; a row without words, null text included, is linked with nothing and has its own id;
    null ids count only where there is no other). With `carry`, that column comes along as `carried`, and `root` tells
    the group. An empty table gives an empty result. Very long texts are read whole; a block of more than `block_tokens`
    shingles is dealt out like one of many classes. Other columns are not read.
    """
    work = Workspace(spark, "ngram-join")
    own, sized = sized_rows(work, docs, id_col, text_col, size, carry)
    total = sized.agg(F.sum("n")).first()[0] or 0
    texts = own.select("text")
    many = work.save(frequent_shingles(texts, partitions_for(spark, total, 1_000_000), size), "frequent")
    frequent = spark.sparkContext.broadcast(KeyFilter.build(many, many.count()))
    links = blocking_links(texts, partitions_for(spark, int(total * 0.4), 500_000), size, part_signatures(percent, frequent))
    return confirmed(work, own, sized, links, size, percent, block_limit, block_tokens, carry)


def drop_near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = STAGE_SHINGLE, percent: int = STAGE_PERCENT) -> DataFrame:
    """`docs` with one row of each group of linked rows: of those with the least id, the first by file and row.

    Rows without words stay. Rows are told apart by their place, not by their id, so that repeated ids and rows lose
    nothing that isn't linked; null ids come last. Places to drop are broadcast up to BROADCAST_ROWS of them; more are
    joined by a shuffle.
    """
    work = Workspace(spark, "drop-near-copies")
    docs = in_files(docs, work)
    place = F.struct(F.xxhash64("file"), F.xxhash64("file", "row"), F.col("row"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *map(F.expr, PLACE)).select("doc", "id", "text", place.alias("place"))
    linked = work.save(join(spark, whole.select("id", "text", "place"), "id", "text", size, percent, carry="place").where("n_shingles > 0").select("carried", "id", "root"), "linked")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("carried"))
    first = linked.groupBy("root").agg(F.min_by("carried", order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = join_hot(linked, first, ["root"], "n", linked.count()).where("carried <> first").select(F.col("carried").alias("place"))
    gone = work.save(gone, "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return whole.select("doc", "place").join(gone, "place", "left_anti").select("doc.*")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = join(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), size=SHINGLE, percent=PERCENT)
    return got.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP9_SQL = similarity_sql(SHINGLE, PERCENT)
