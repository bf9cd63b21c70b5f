"""Selection over peptide-protein edges: degrees, razor, budgets, scores, expectation maximisation, set cover."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from evidra.functions.sequence import fnv1a64
from evidra.operators.lineage import cut, parts
from evidra.operators.ranking import best_per_key
from evidra.session import shared_dir


def degrees(edges: DataFrame) -> DataFrame:
    """edges: peptide, protein, distinct. Adds the peptide's degree by an aggregation that a join brings back."""
    return edges.join(edges.groupBy("peptide").agg(F.count(F.lit(1)).alias("degree")), "peptide")


def protein_counts(edges: DataFrame) -> DataFrame:
    """protein, n_unique (peptides of degree 1), n_total."""
    return degrees(edges).groupBy("protein").agg(F.count_if(F.col("degree") == 1).alias("n_unique"), F.count(F.lit(1)).alias("n_total"))


def razor(edges: DataFrame, tie: str = "alpha") -> DataFrame:
    """peptide, protein: each peptide's protein with most unique, then most total peptides. Ties: alpha, hash, hash_acc."""
    key = {"alpha": [], "hash": [fnv1a64(F.concat(F.col("peptide").cast("string"), F.lit("\0"), F.col("protein").cast("string")))], "hash_acc": [fnv1a64(F.col("protein").cast("string"))]}[tie]
    ranked = edges.join(protein_counts(edges), "protein")
    return best_per_key(ranked, ["peptide"], -F.col("n_unique"), -F.col("n_total"), *key, F.col("protein")).select("peptide", "protein")


def razor_scored(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """The variant that ranks by the summed score of unique peptides first. scores: peptide, score."""
    known = degrees(edges).join(scores, "peptide", "left")
    counts = known.groupBy("protein").agg(F.sum(F.when(F.col("degree") == 1, F.coalesce("score", F.lit(0.0))).otherwise(0.0)).alias("s"), F.count_if(F.col("degree") == 1).alias("u"), F.count(F.lit(1)).alias("t"))
    return best_per_key(edges.join(counts, "protein"), ["peptide"], -F.round("s", 9), -F.col("u"), -F.col("t"), F.col("protein")).select("peptide", "protein")


def uniform(edges: DataFrame, least: int = 1) -> DataFrame:
    """Proteins with at least `least` peptides."""
    return edges.groupBy("protein").agg(F.count(F.lit(1)).alias("n_peptides")).where(F.col("n_peptides") >= least)


def info_score(edges: DataFrame, scores: DataFrame, least: float = 0.1, weight: Column | None = None) -> DataFrame:
    """Sum of score * weight / degree over a protein's peptides. Sums are rounded to 9 places before the comparison."""
    weight = F.lit(1.0) if weight is None else weight
    part = degrees(edges).join(scores, "peptide").withColumn("part", F.col("score") * weight / F.col("degree"))
    return part.groupBy("protein").agg(F.round(F.sum("part"), 9).alias("info")).where(F.col("info") >= least)


def credit_budget(edges: DataFrame, scores: DataFrame, lengths: Column, ceiling: int = 10, pair_rule: Column | None = None) -> DataFrame:
    """Each peptide credits its first proteins in hash order: max(1, ceil(min(degree, ceiling) * score * (length - 6) / 24)).

    Proteins that meet `pair_rule` need a unique peptide or two credits.
    """
    known = degrees(edges).join(scores, "peptide").withColumn("budget", F.greatest(F.lit(1), F.ceil(F.least("degree", F.lit(ceiling)) * F.col("score") * (lengths - 6) / 24.0)))
    order = Window.partitionBy("peptide").orderBy(fnv1a64(F.col("protein").cast("string")), "protein")
    credited = known.withColumn("rn", F.row_number().over(order)).where("rn <= budget")
    found = credited.groupBy("protein").agg(F.count(F.lit(1)).alias("credits"), F.count_if(F.col("degree") == 1).alias("n_unique"))
    return found if pair_rule is None else found.where(~pair_rule | (F.col("n_unique") > 0) | (F.col("credits") >= 2))


def species_budget(edges: DataFrame, species: DataFrame, prune: float | None = None) -> DataFrame:
    """species: protein, species. Unique peptides go to their owner, shared ones to the best protein of each species.

    With `prune`, species with less than that share of the dominant one's proteins go. A protein without species is an
    error.
    """
    known = edges.join(species, "protein", "left").withColumn("species", F.coalesce("species", F.raise_error(F.lit("protein without species"))))
    ranked = known.join(protein_counts(edges), "protein")
    best = best_per_key(ranked, ["peptide", "species"], -F.col("n_unique"), -F.col("n_total"), F.col("protein"))
    chosen = best.select("protein", "species").distinct()
    if prune is None:
        return chosen
    sizes = chosen.groupBy("species").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n").alias("most"))
    kept = sizes.crossJoin(F.broadcast(most)).where(F.col("n") >= F.greatest(F.lit(1.0), F.col("most") * prune)).select("species")
    return chosen.join(kept, "species", "left_semi")


def _dealt_out(edges: DataFrame, scores: DataFrame, size: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """Edges with their degree and what `scores` has by peptide, in blocks, and protein, block of what blocks hold.

    A block is a range of peptides, some `size` edges; the first table is bucketed by block, so that a round moves
    abundances and partial sums of (protein, block) only and no edge.
    """
    spark = edges.sparkSession
    known = cut(degrees(edges).join(scores, "peptide"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-known.count() // size))
    name = f"evidra_blocks_{uuid.uuid4().hex}"
    ranged = known.repartitionByRange(parts, "peptide").withColumn("block", F.spark_partition_id())
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(ranged)
    ranged.repartition(buckets, "block").write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/evidra/{name}").saveAsTable(name)
    return spark.table(name), cut(ranged.select("protein", "block").distinct())


def _sums(blocks: DataFrame, held: DataFrame, now: DataFrame, part, keep) -> DataFrame:
    """protein, b: sums of part(columns, a, total) over edges of proteins in `now` (protein, a).

    total is the sum of `a` over a peptide's edges. part: a function of the block's columns as arrays, a and total;
    keep: likewise which edges count.
    """
    kind = blocks.schema["protein"].dataType.simpleString()
    sent = held.join(now, "protein").select("block", "protein", "a")

    def run(edges: pa.Table, sent: pa.Table) -> pa.Table:
        sent, edges = sent.combine_chunks(), edges.combine_chunks()
        at = pc.index_in(edges.column("protein"), value_set=sent.column("protein").combine_chunks()).combine_chunks() if len(sent) else pa.nulls(len(edges), pa.int32())
        edges, at = edges.filter(at.is_valid()), at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        a = sent.column("a").to_numpy()[at]
        peptide = edges.column("peptide").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.bincount(peptide, weights=a)[peptide] if len(peptide) else a
        columns = {c: edges.column(c).to_numpy() for c in edges.column_names if c not in ("peptide", "protein", "block")}
        kept = keep(columns, a, total)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = part(columns, a, total)[kept]
        seen = np.bincount(at[kept], minlength=len(sent)) > 0
        return pa.table({"protein": sent.column("protein"), "b": np.bincount(at[kept], weights=value, minlength=len(sent))}).filter(pa.array(seen))

    made = blocks.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(run, f"protein {kind}, b double")
    return made.groupBy("protein").agg(F.sum("b").alias("b"))


def expectation(edges: DataFrame, scores: DataFrame, lengths: DataFrame, rounds: int = 10, stop: float = 1e-8, threshold: float = 0.01, delta_before: bool = False) -> DataFrame:
    """Abundances by expectation maximisation, scaled by the largest: protein, abundance at or above the threshold.

    Peptides share their score over proteins by abundance; sums are by sqrt(max(length, 50)). The loop ends when the
    total change is under `stop`, measured before or after scaling. Edges stay in their blocks, see `_dealt_out`.
    """
    blocks, held = _dealt_out(edges, scores.select("peptide", F.col("score").cast("double").alias("score")).where("score is not null"))
    size = F.sqrt(F.greatest(F.col("length").cast("double"), F.lit(50.0)))
    norm = cut(lengths.select("protein", size.alias("norm")))
    first = blocks.groupBy("protein").agg(F.sum(F.col("score") / F.col("degree")).alias("a"))
    now = _scaled(cut(first.join(norm, "protein").select("protein", (F.col("a") / F.col("norm")).alias("a"))))
    for _ in range(rounds):
        summed = _sums(blocks, held, now, lambda c, a, total: c["score"] * a / total, lambda c, a, total: total > 0)
        raw = cut(summed.join(norm, "protein").select("protein", (F.col("b") / F.col("norm")).alias("a")))
        new = _scaled(raw)
        other = (raw if delta_before else new).withColumnRenamed("a", "b")
        change = now.join(other, "protein", "full").agg(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))))).first()[0] or 0.0
        now = new
        if change < stop:
            break
    return now.where(F.col("a") >= threshold).select("protein", F.col("a").alias("abundance"))


def lake_expectation(edges: DataFrame, sightings: DataFrame, lengths: DataFrame, rounds: int = 10, stop: float = 1e-8) -> DataFrame:
    """Abundances over all samples, scaled by the largest. sightings: sample, peptide, score. lengths: protein, length.

    A unique peptide gives its best score times the root of the number of samples that see it; a shared one deals its
    score out by the present abundances. Each protein's sum is times the root of its number of samples, by the root of
    max(length, 50). Edges stay in their blocks, see `_dealt_out`.
    """
    seen = sightings.groupBy("peptide").agg(F.max("score").cast("double").alias("score"), F.count_distinct("sample").alias("k"))
    blocks, held = _dealt_out(edges, seen.where("score is not null"))
    samples = edges.join(sightings.select("peptide", "sample").distinct(), "peptide").groupBy("protein").agg(F.count_distinct("sample").alias("samples"))
    weight = samples.join(lengths, "protein").select("protein", (F.sqrt("samples") / F.sqrt(F.greatest(F.col("length").cast("double"), F.lit(50.0)))).alias("norm"))
    weight = cut(weight)
    first = blocks.groupBy("protein").agg(F.sum(F.col("score") / F.col("degree")).alias("a")).join(weight, "protein").select("protein", (F.col("a") * F.col("norm")).alias("a"))
    now = _shared_out(cut(first))

    def part(c: dict, a: np.ndarray, total: np.ndarray) -> np.ndarray:
        shared = np.where(total > 0, c["score"] * a / total, c["score"] / c["degree"])
        return np.where(c["degree"] == 1, c["score"] * np.sqrt(c["k"]), shared)

    for _ in range(rounds):
        summed = _sums(blocks, held, now, part, lambda c, a, total: np.ones(len(a), bool))
        raw = summed.join(weight, "protein").select("protein", (F.col("b") * F.col("norm")).alias("a"))
        new = _shared_out(cut(raw))
        change = now.join(new.withColumnRenamed("a", "b"), "protein").agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] or 0.0
        now = new
        if change < stop:
            break
    return _scaled(now).select("protein", F.col("a").alias("abundance"))


def _shared_out(df: DataFrame) -> DataFrame:
    total = df.agg(F.sum("a").alias("total"))  # one row
    return df.crossJoin(F.broadcast(total)).select("protein", F.try_divide("a", "total").alias("a"))


def _scaled(df: DataFrame) -> DataFrame:
    most = df.agg(F.max("a").alias("most"))
    return df.crossJoin(F.broadcast(most)).select("protein", F.try_divide("a", "most").alias("a"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """peptide, protein, component of an edge list, by minima passed over edges with pointer jumping."""
    nodes = edges.select(F.concat(F.lit("e"), F.col("peptide").cast("string")).alias("a"), F.concat(F.lit("r"), F.col("protein").cast("string")).alias("b"))
    both = cut(nodes.unionByName(nodes.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")))
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        new = label.join(near, "a").select("a", F.least("root", "near").alias("root"))
        jump = new.alias("x").join(new.alias("y"), F.col("x.root") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.root").alias("root"))
        jump = cut(jump)
        moved = jump.join(label.withColumnRenamed("root", "old"), "a").where("root <> old").limit(1).count()
        label = jump
        if not moved:
            break
    else:
        raise RuntimeError("components did not converge")
    own = label.where(F.startswith("a", F.lit("e"))).select(F.substring("a", 2, 1 << 20).alias("key"), F.col("root").alias("component"))
    return edges.join(own, F.col("peptide").cast("string") == F.col("key")).drop("key")


def greedy_cover(pairs: Iterator[tuple]) -> list[tuple]:
    """Lazy greedy set cover of (peptide, protein) pairs: (protein, gain) in order of selection; ties to smaller proteins."""
    own: dict = {}
    for peptide, protein in pairs:
        own.setdefault(protein, set()).add(peptide)
    left, out = set().union(*own.values()) if own else set(), []
    heap = [(-len(s), p) for p, s in own.items()]
    heapq.heapify(heap)
    while left and heap:
        _, protein = heapq.heappop(heap)
        gain = len(own[protein] & left)
        if not gain:
            continue
        if heap and (-gain, protein) > heap[0]:
            heapq.heappush(heap, (-gain, protein))
            continue
        out.append((protein, gain))
        left -= own[protein]
    return out


def linked(edges: DataFrame, size: int = 1_000_000) -> DataFrame:
    """Edges with `component`, a protein of theirs: equal for edges that are connected over peptides and proteins.

    Ranges of some `size` edges by peptide are connected within tasks first. Of what they find, only proteins that
    several ranges hold connect further, so that what is passed on between tasks is small against the edges.
    """
    kinds = {c: edges.schema[c].dataType.simpleString() for c in ("peptide", "protein")}
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        own = pa.Table.from_batches(found).combine_chunks()
        peptide, protein = (own.column(c).combine_chunks().dictionary_encode("encode") for c in ("peptide", "protein"))
        a, b = peptide.indices.to_numpy(), protein.indices.to_numpy()
        label, before = np.arange(len(protein.dictionary)), None
        while before is None or (label != before).any():
            before, least = label.copy(), np.full(len(peptide.dictionary), len(label))
            np.minimum.at(least, a, label[b])
            np.minimum.at(label, b, least[a])
            label = label[label]
        yield from own.append_column("label", protein.dictionary.take(pa.array(label[b]))).to_batches(65_536)

    ranged = edges.select("peptide", "protein").repartitionByRange(parts, "peptide")
    local = cut(ranged.mapInArrow(run, f"peptide {kinds['peptide']}, protein {kinds['protein']}, label {kinds['protein']}"))
    # a label of one range is a label of another where they share a protein; a range's label is one of its proteins
    held = local.select("protein", "label").distinct()
    least = held.groupBy("protein").agg(F.min("label").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    links = held.join(least, "protein").where("label <> least").select("label", "least").distinct()
    both = cut(links.unionByName(links.select(F.col("least").alias("label"), F.col("label").alias("least"))))
    root = cut(both.groupBy("label").agg(F.least(F.min("least"), F.col("label")).alias("root")))
    moved = 1
    while moved:  # minima passed over links, with pointer jumping
        near = both.join(root.withColumnRenamed("label", "least"), "least").groupBy("label").agg(F.min("root").alias("near"))
        new = root.join(near, "label").select("label", F.least("root", "near").alias("root"))
        jump = cut(new.alias("x").join(new.alias("y"), F.col("x.root") == F.col("y.label")).select(F.col("x.label").alias("label"), F.col("y.root").alias("root")))
        moved = jump.join(root.withColumnRenamed("root", "old"), "label").where("root <> old").limit(1).count()
        root = jump
    return local.join(root, "label", "left").select("peptide", "protein", F.coalesce("root", "label").alias("component"))


def _choose(gain: np.ndarray, row: np.ndarray, member: np.ndarray, least: int, bound: int, most: int = 4_096) -> tuple[np.ndarray, np.ndarray]:
    """Places and gains of what the greedy cover selects of a window before it comes to a gain of `least` at place `bound`.

    gain: of the window's proteins in order of their names. row, member: in order of `row`, the peptides that several of
    them hold, and by which. Each step selects all that are best on each of their peptides; where a step over more than
    `most` of these rows a protein would select few, a heap goes on one by one.
    """
    n, gain, out = len(gain), gain.astype(np.int64), []
    place = np.arange(n)
    while True:
        key = gain * (n + 1) - place
        open_ = (gain > least) | ((gain == least) & (place < bound)) if least > 0 else gain > 0
        kept = open_[member]
        row, member = row[kept], member[kept]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        lengths = np.diff(np.append(starts, len(row)))
        won = open_.copy()
        if len(row):
            won[member[np.repeat(np.maximum.reduceat(key[member], starts), lengths) != key[member]]] = False
        found = np.flatnonzero(won)
        if not len(found):
            break
        if len(found) * most < len(row):
            return _choose_one_by_one(gain, open_, row, member, least, bound, out)
        out.append((found, gain[found]))
        gain[found] = 0
        if len(row):
            covered = np.repeat(np.logical_or.reduceat(won[member], starts), lengths)
            lost = np.bincount(member[covered], minlength=n)
            lost[found] = 0
            gain -= lost
            row, member = row[~covered], member[~covered]
    return tuple(np.concatenate([np.empty(0, np.int64), *(o[k] for o in out)]) for k in (0, 1))


def _choose_one_by_one(gain: np.ndarray, open_: np.ndarray, row: np.ndarray, member: np.ndarray, least: int, bound: int, out: list) -> tuple[np.ndarray, np.ndarray]:
    """The rest of `_choose` by a lazy heap."""
    order = np.argsort(member, kind="stable")
    ends = np.searchsorted(member[order], np.arange(len(gain) + 1))
    row = np.unique(row, return_inverse=True)[1][order] if len(row) else row
    left, alone, places, gains = np.ones(len(row), bool), gain - np.diff(ends), [], []
    heap = [(-int(gain[p]), int(p)) for p in np.flatnonzero(open_)]
    heapq.heapify(heap)
    while heap:
        known, p = heap[0]
        own = row[ends[p] : ends[p + 1]]
        now = int(alone[p]) + int(np.count_nonzero(left[own]))
        if now == -known:
            heapq.heappop(heap)
            places.append(p)
            gains.append(now)
            left[own] = False
        elif now > 0 and (-now, p) < (-least, bound):
            heapq.heapreplace(heap, (-now, p))
        else:
            heapq.heappop(heap)
    return tuple(np.concatenate([*(o[k] for o in out), np.array(found, np.int64)]) for k, found in enumerate((places, gains)))


def _flags(ids: DataFrame, size: int) -> np.ndarray:
    """One bit for each number under `size`: whether it is an `id`."""
    made = np.zeros(size, bool)
    made[ids.select("id").toArrow()["id"].to_numpy()] = True
    return np.packbits(made)


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and lengths of the first column, lists that are not empty."""
    lengths = np.diff(batch.column(0).offsets.to_numpy())
    return batch.column(0).flatten().to_numpy(), np.append(0, np.cumsum(lengths)[:-1]), lengths


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """peptide, id; protein, id; a number over all ids, which are in order of the proteins. Without the second, ids are the proteins."""
    if isinstance(edges.schema["protein"].dataType, IntegralType):
        least, most = edges.agg(F.min("protein"), F.max("protein")).first()
        if 0 <= least and most < 1 << 24:
            return edges.select("peptide", F.col("protein").cast("int").alias("id")), None, most + 1
    names = cut(in_order(edges.select("protein").distinct(), ["protein"], "id").select("protein", F.col("id").cast("int").alias("id")))
    return edges.join(names, "protein").select("peptide", "id"), names, names.count()


def _by_peptide(own: DataFrame, tasks: int, size: int) -> DataFrame:
    """ids: the distinct ids under `size` of each peptide, as one row. own: peptide, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (found := list(batches)):
            return
        table = pa.Table.from_batches(found)
        peptide = table.column("peptide").combine_chunks().dictionary_encode("encode").indices.to_numpy().astype(np.int64)
        key = np.unique(peptide * size + table.column("id").to_numpy())
        starts = np.append(np.flatnonzero(np.diff(key // size, prepend=-1)), len(key))
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(key % size, pa.int32()))
        yield from pa.table({"ids": lists}).to_batches(65_536)

    return own.repartition(tasks, "peptide").mapInArrow(run, "ids array<int>")


def set_cover(edges: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """protein, gain, selection_rank of the greedy cover: most uncovered peptides first, ties to smaller proteins.

    At most `limit` edges are covered one by one in a task. Of more, a round takes a window, the first proteins by gain
    and name, and those peptides only that several of them hold: one task selects of it until a protein outside could
    come first, as gains never rise. Then all tasks take the edges of covered peptides off the gains. Windows are such
    that a task gets some 8 * `limit` edges at most. A bit for each protein goes out to the tasks; edges are shuffled
    once, by peptide. Gain and name give the rank. Results are the same for any limit. Rows without a peptide or a
    protein are no edges.
    """
    edges = edges.select("peptide", "protein").where("peptide is not null and protein is not null")
    kind, total = edges.schema["protein"].dataType, edges.count()
    if total <= limit:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(greedy_cover(zip(pdf.peptide, pdf.protein, strict=True)), columns=["protein", "gain"])

        one = edges.distinct().groupBy(F.lit(0).alias("one"))
        return _ranked(cut(one.applyInPandas(run, f"protein {kind.simpleString()}, gain bigint")))  # `limit` rows at most
    own, names, size = _numbered(edges)
    rows = cut(_by_peptide(own, parts(edges, 500_000), size))
    gains = cut(_covered(rows, None, None, size).withColumnRenamed("n", "gain"))
    near = rows.agg(F.sum(F.size("ids") * F.size("ids")) / F.sum(F.size("ids")) - 1).first()[0]  # others on the peptide of an edge
    gone, most, written, share, chosen = np.zeros(-(-size // 8), np.uint8), max(8 * limit, 32), total, 1.0, []
    while levels := sorted(((r.gain, r.n) for r in gains.groupBy("gain").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):  # one row for each gain
        total = sum(g * n for g, n in levels)
        if 2 * total < written:
            rows, written = cut(_uncovered(rows, gone, size)), total
        wanted = max(most, share * (most * total / max(near, 1.0)) ** 0.5)
        least, bound = _window(gains, levels, wanted, size)
        window = gains.where((F.col("gain") > least) | ((F.col("gain") == least) & (F.col("id") < bound)))
        shared = cut(_shared(rows, gone, _flags(window, size), size))
        if wanted > most and (shared.agg(F.sum(F.size("ids"))).first()[0] or 0) > most:
            share *= most / wanted if share * 2 * most < wanted else 0.5
            continue
        won = cut(_selected(window, shared, least, bound))
        chosen.append(won)
        new = _flags(won, size)
        gains = cut(gains.join(_covered(rows, gone, new, size), "id", "left").select("id", (F.col("gain") - F.coalesce("n", F.lit(0))).alias("gain")).where("gain > 0"))
        gone |= new
    found = reduce(DataFrame.unionByName, chosen)
    return _ranked(cut(found.select(F.col("id").cast(kind).alias("protein"), "gain") if names is None else found.join(names, "id").select("protein", "gain")))


def _window(gains: DataFrame, levels: list, wanted: float, size: int) -> tuple[int, int]:
    """The gain and the id that come after the first proteins by gain and id, of some `wanted` edges."""
    for gain, n in levels:
        if gain * n > wanted:
            step = max(1, size // 1024)
            sizes = gains.where(F.col("gain") == gain).groupBy(F.expr(f"id div {step}").alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # 1,025 rows at most
            ends = np.cumsum([r.n for r in sizes]) * gain
            last = int(np.searchsorted(ends, wanted, "right")) - 1
            if last >= 0 or (gain, n) == levels[0]:
                return gain, (sizes[max(last, 0)].part + 1) * step
            return gain, 0
        wanted -= gain * n
    return 0, 0


def _shared(rows: DataFrame, gone: np.ndarray, window: np.ndarray, size: int) -> DataFrame:
    """ids: what uncovered peptides hold of the window, if two or more."""
    sent = rows.sparkSession.sparkContext.broadcast((gone, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, inside = (np.unpackbits(v, count=size).astype(bool) for v in sent.value)
        for batch in batches:
            if batch.num_rows:
                values, starts, lengths = _lists(batch)
                held = inside[values] & ~np.repeat(np.logical_or.reduceat(old[values], starts), lengths)
                n = np.add.reduceat(held, starts, dtype=np.int32)
                kept = values[held & np.repeat(n > 1, lengths)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[n > 1])), pa.int32()), pa.array(kept))], names=["ids"])

    return rows.mapInArrow(run, "ids array<int>")


def _uncovered(rows: DataFrame, gone: np.ndarray, size: int) -> DataFrame:
    """The peptides without a selected protein."""
    sent = rows.sparkSession.sparkContext.broadcast(gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = np.unpackbits(sent.value, count=size).astype(bool)
        for batch in batches:
            if batch.num_rows:
                values, starts, _ = _lists(batch)
                yield batch.filter(pa.array(~np.logical_or.reduceat(old[values], starts)))

    return rows.mapInArrow(run, "ids array<int>")


def _covered(rows: DataFrame, gone: np.ndarray | None, new: np.ndarray | None, size: int) -> DataFrame:
    """id, n: its peptides that `new` covers and `gone` did not; without them all its peptides."""
    sent = rows.sparkSession.sparkContext.broadcast((gone, new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, now = (v if v is None else np.unpackbits(v, count=size).astype(bool) for v in sent.value)
        found = []
        for batch in batches:
            if batch.num_rows:
                values, starts, lengths = _lists(batch)
                if now is not None:
                    hit = np.logical_or.reduceat(now[values], starts) & ~np.logical_or.reduceat(old[values], starts)
                    values = values[np.repeat(hit, lengths)]
                found.append(values)
        if found:
            ids, n = np.unique(np.concatenate(found), return_counts=True)
            yield from pa.table({"id": pa.array(ids, pa.int32()), "n": pa.array(n, pa.int64())}).to_batches(65_536)

    return rows.mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def _selected(window: DataFrame, shared: DataFrame, least: int, bound: int) -> DataFrame:
    """id, gain of what the greedy cover selects before it comes to a gain of `least` at `bound`, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, gains, members, sizes = [], [], [], []
        for batch in batches:
            if batch.num_rows:
                values, _, lengths = _lists(batch)
                gain = batch.column(1).to_numpy()
                own = np.repeat(gain > 0, lengths)
                ids.append(values[own])
                gains.append(gain[gain > 0])
                members.append(values[~own])
                sizes.append(lengths[gain == 0])
        if not ids:
            return
        ids, gains, members, sizes = (np.concatenate(v) for v in (ids, gains, members, sizes))
        order = np.argsort(ids)
        ids, gains = ids[order], gains[order]
        place = np.zeros(ids[-1] + 1, np.int32)
        place[ids] = np.arange(len(ids))
        member = place[members]
        places, found = _choose(gains, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), member, least, int(np.searchsorted(ids, bound)))
        yield from pa.table({"id": pa.array(ids[places], pa.int32()), "gain": pa.array(found, pa.int64())}).to_batches(65_536)

    both = window.select(F.array("id").alias("ids"), "gain").unionByName(shared.select("ids", F.lit(0).cast("bigint").alias("gain")))
    return both.coalesce(1).mapInArrow(run, "id int, gain bigint")  # some 8 * `limit` edges


def _ranked(chosen: DataFrame) -> DataFrame:
    """Adds selection_rank, by gain and name. chosen: protein, gain."""
    salt = chosen.withColumn("bucket", -F.col("gain"))
    sizes = salt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each gain
    rank = F.col("base") + F.row_number().over(Window.partitionBy("bucket").orderBy("protein"))
    return salt.join(F.broadcast(base.select("bucket", "base")), "bucket").select("protein", "gain", rank.alias("selection_rank"))


def outside(edges: DataFrame, searched: DataFrame) -> DataFrame:
    """The edges; an error if a protein is not among those searched. searched: protein."""
    known = searched.select("protein").distinct().withColumn("__in", F.lit(True))
    joined = edges.join(known, "protein", "left")
    checked = F.when(F.col("__in"), F.col("protein")).otherwise(F.raise_error(F.concat(F.lit("outside the searched universe: "), F.col("protein").cast("string"))).cast(edges.schema["protein"].dataType))
    return joined.withColumn("protein", checked).select(*edges.columns)


def dictionary(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """peptide, protein: the first selected protein that explains it. selected: protein, selection_rank."""
    return edges.join(selected, "protein").groupBy("peptide").agg(F.min_by("protein", "selection_rank").alias("protein"))


def _before(events: DataFrame, block: int) -> DataFrame:
    """events: protein, seq, taken (0 or 1). Adds done and open: rows of the protein with a lesser seq, taken or not.

    Running sums are by blocks of `seq` first, so that a protein of many rows is no task of its own.
    """
    own = events.withColumn("block", F.expr(f"seq div {block}"))
    inner = Window.partitionBy("protein", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("protein").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("protein", "block").agg(F.sum("taken").alias("t"), F.count(F.lit(1)).alias("k"))
    sums = sums.select("protein", "block", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("t0"), F.coalesce(F.sum("k").over(outer), F.lit(0)).alias("k0"))
    own = own.withColumns({"t1": F.coalesce(F.sum("taken").over(inner), F.lit(0)), "k1": F.coalesce(F.count(F.lit(1)).over(inner), F.lit(0))})
    own = own.join(sums, ["protein", "block"])
    done = F.col("t0") + F.col("t1")
    return own.withColumns({"done": done, "open": F.col("k0") + F.col("k1") - done}).drop("block", "t0", "k0", "t1", "k1")


def razor_greedy(edges: DataFrame, block: int = 100_000, rounds: int = 10_000) -> DataFrame:
    """Razor whose ties go to the protein with most peptides assigned so far; peptides of most proteins choose first.

    The sequential choice is replayed in rounds. Of each undecided peptide and candidate, the peptides that were
    assigned to it before are at least those decided so far and at most these and the undecided ones before; where the
    best candidate's least number beats the greatest number of all others (equal numbers: the lesser name), the choice
    stands, whatever the undecided ones do. The first undecided peptide always can be decided, and a protein in the lead
    decides for twice as many each round. No component is gathered in a task. Rounds hold rows of proteins that an
    undecided peptide may choose; what is decided is not written again.
    """
    own, by = cut(degrees(edges)), Window.partitionBy("peptide")
    counts = own.groupBy("protein").agg(F.count_if(F.col("degree") == 1).alias("n_unique"), F.count(F.lit(1)).alias("n_total"))
    ranked = own.join(counts, "protein").withColumn("rank", F.struct("n_unique", "n_total")).withColumn("top", F.max("rank").over(by))
    tied = cut(ranked.where("rank = top").withColumn("n", F.count(F.lit(1)).over(by)).select("peptide", "protein", "degree", "n"))
    decided = [tied.where("n = 1").select("peptide", "protein")]
    # rows of proteins that an undecided peptide may choose; all others are out of the rounds
    held = cut(tied.join(tied.where("n > 1").select("protein").distinct(), "protein", "left_semi"))
    order = in_order(held.select("peptide", "degree").distinct(), [F.desc("degree"), "peptide"], "seq").select("peptide", "seq")
    state = cut(held.join(order, "peptide").select("peptide", "protein", "seq", (F.col("n") == 1).cast("int").alias("taken")))
    for _ in range(rounds):
        if state.isEmpty():
            return reduce(DataFrame.unionByName, decided)
        bounds = _before(state, block).where("taken = 0").withColumn("best", F.min(F.struct((-F.col("done")).alias("done"), "protein")).over(by))
        least, most = -F.col("best.done"), F.col("done") + F.col("open")
        beaten = (F.col("protein") == F.col("best.protein")) | (most < least) | ((most == least) & (F.col("protein") > F.col("best.protein")))
        won = bounds.groupBy("peptide").agg(F.bool_and(beaten).alias("sure"), F.first("best.protein").alias("protein")).where("sure")
        won = cut(won.select("peptide", "protein"))
        decided.append(won)
        now = state.join(won.withColumnRenamed("protein", "winner"), "peptide", "left").where("winner is null or winner = protein")
        now = now.select("peptide", "protein", "seq", F.when(F.col("winner").isNotNull(), 1).otherwise(F.col("taken")).alias("taken"))
        state = cut(now.join(now.where("taken = 0").select("protein").distinct(), "protein", "left_semi"))
    raise RuntimeError("choices did not settle")


def in_order(df: DataFrame, order: list, name: str) -> DataFrame:
    """Numbers rows from 0 in a total order: ranges in tasks, places within them, one count for each range."""
    spark = df.sparkSession
    placed = cut(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))  # one row for each range
    numbered = placed.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(base), "__part")
    return numbered.withColumn(name, F.expr(f"__base + (__at & {(1 << 33) - 1}L)")).drop("__part", "__base", "__at")


#: The strategies by name: (edges, scores) to a table with the column protein.
STRATEGIES = {
    "razor": lambda edges, scores=None: razor(edges).select("protein").distinct(),
    "razor_scored": lambda edges, scores: razor_scored(edges, scores).select("protein").distinct(),
    "uniform": lambda edges, scores=None: uniform(edges),
    "uniform_2pep": lambda edges, scores=None: uniform(edges, 2),
    "info_score": lambda edges, scores: info_score(edges, scores),
}
