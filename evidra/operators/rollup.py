"""Functional roll-ups, diversity and distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.lineage import cut
from evidra.operators.ranking import best_per_key


def plurality(members: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """The value of most members of each group, a member voting once for each of its values; ties to the lesser value."""
    votes = members.groupBy(group, value).agg(F.count_distinct(member).alias("votes"))
    return best_per_key(votes, [group], -F.col("votes"), F.col(value))


def gene_vote(votes: DataFrame, key: str, value: str, size: str, share: float = 0.5) -> DataFrame:
    """The winner by votes, then by size of its index, then by name; ambiguous if the second has `share` of its votes."""
    order = Window.partitionBy(key).orderBy(F.desc("votes"), F.desc(size), value)
    ranked = votes.withColumns({"rn": F.row_number().over(order), "second": F.lead("votes").over(order)})
    return ranked.where("rn = 1").select(key, value, "votes", (F.coalesce("second", F.lit(0)) >= F.col("votes") * share).alias("ambiguous"))


def equal_split(values: DataFrame, keys: list[str], terms: str, amount: str) -> DataFrame:
    """Deals each amount out equally over the row's distinct terms; rows without terms are left out."""
    own = values.withColumn("__t", F.array_distinct(terms)).where(F.size("__t") > 0)
    return own.select(*keys, F.explode("__t").alias("term"), (F.col(amount) / F.size("__t")).alias("__a")).groupBy(*keys, "term").agg(F.sum("__a").alias("amount"))


def unannotated_names(groups: DataFrame, group: str) -> DataFrame:
    """Numbers groups in byte order as Unannotated_000001 and on. Ranks are by range, so that no task sorts all rows."""
    spark = groups.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(groups.select(group).distinct().repartitionByRange(parts, group).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    number = F.col("base") + F.row_number().over(Window.partitionBy("__part").orderBy(group))
    return dealt.join(F.broadcast(base), "__part").select(group, F.concat(F.lit("Unannotated_"), F.lpad(number.cast("string"), 6, "0")).alias("name"))


def relative(df: DataFrame, sample: str, value: str) -> DataFrame:
    """Adds each row's share of its sample; null if the sample is empty."""
    totals = df.groupBy(sample).agg(F.sum(value).alias("__total"))
    return df.join(totals, sample).withColumn("share", F.try_divide(value, "__total")).drop("__total")


def diversity(df: DataFrame, sample: str, value: str) -> DataFrame:
    """Richness, Shannon entropy (natural), its exponential and Simpson's concentration, the sum of squared shares.

    A sample without signal has NaN for all of them.
    """
    p = F.col("share")
    log = F.when(p > 0, p * F.ln(p))
    got = relative(df, sample, value).groupBy(sample).agg(F.count_if(p > 0).cast("double").alias("r"), (-F.sum(log)).alias("h"), F.sum(p * p).alias("c"))
    some = lambda c: F.when(F.col("r") > 0, c).otherwise(F.lit(float("nan")))
    return got.select(sample, some(F.col("r")).alias("richness"), some(F.col("h")).alias("shannon"), some(F.exp("h")).alias("effective"), some(F.col("c")).alias("simpson"))


#: Samples in a tile of distances; tiles on either side of a task.
TILE, SIDE = 512, 4


def _tile_minima(own: tuple, other: tuple) -> np.ndarray:
    """Sums of lesser values over the features that two tiles share; a tile is (number of samples, rows, features, values)."""
    made, room = np.zeros((own[0], other[0])), np.empty((own[0], other[0]))
    features = pa.concat_arrays([own[2], other[2]]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    sides = []
    for (n, row, _, value), code in zip((own, other), np.split(features, [len(own[1])]), strict=True):
        order = np.argsort(code, kind="stable")
        names, starts = np.unique(code[order], return_index=True)
        sides.append({k: (row[at], value[at]) for k, at in zip(names.tolist(), np.split(order, starts[1:]), strict=True)})
    for name in sides[0].keys() & sides[1].keys():
        (i, v), (j, w) = sides[0][name], sides[1][name]
        if 8 * len(v) * len(w) >= made.size and v.min() >= 0 and w.min() >= 0 and len(np.unique(i)) == len(i) and len(np.unique(j)) == len(j):
            x, y = np.zeros(own[0]), np.zeros(other[0])  # a feature that a sample lacks adds nothing, as 0 does
            x[i], y[j] = v, w
            made += np.minimum.outer(x, y, out=room)
        else:
            made[np.ix_(i, j)] += np.minimum.outer(v, w)
    return made


def tile_pairs(df: DataFrame, sample: str, feature: str, value: str, codes: DataFrame | None = None) -> DataFrame:
    """tile, r, tb, rb: each two tiles of samples once. r and rb hold s, t (sum), cells (f, v) of each sample, and codes
    if those are given: s, codes; samples without are left out then.

    df: one row for each sample and feature. A task meets a few tiles with a few others.
    """
    rows = df.where(F.col(sample).isNotNull()).groupBy(F.col(sample).alias("s")).agg(F.coalesce(F.sum(value), F.lit(0.0)).cast("double").alias("t"), F.collect_list(F.when(F.col(feature).isNotNull() & F.col(value).isNotNull(), F.struct(F.col(feature).alias("f"), F.col(value).cast("double").alias("v")))).alias("cells"))
    rows = cut(rows if codes is None else rows.join(codes, "s"))
    tiles = max(1, -(-rows.count() // TILE))
    tiled = rows.groupBy(F.expr(f"pmod(xxhash64(s), {tiles})").cast("int").alias("tile")).agg(F.collect_list(F.struct(*rows.columns)).alias("r"))  # some TILE samples
    tiled = tiled.repartitionByRange(-(-tiles // SIDE), "tile")
    return tiled.hint("shuffle_replicate_nl").join(tiled.select(F.col("tile").alias("tb"), F.col("r").alias("rb")), F.col("tile") <= F.col("tb"))


def tile_distances(r: pa.Scalar, rb: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the samples of two tiles, and where both sums are 0."""

    def tile(r: pa.Scalar) -> tuple:
        cells = r.values.field("cells")
        row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
        flat = cells.flatten()
        return r.values.field("t").to_numpy(zero_copy_only=False), (len(cells), row, flat.field("f"), flat.field("v").to_numpy(zero_copy_only=False))

    (ta, x), (tb, y) = tile(r), tile(rb)
    total = np.add.outer(ta, tb)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - 2 * _tile_minima(x, y) / total, total == 0


def bray_curtis(df: DataFrame, sample: str, feature: str, value: str) -> DataFrame:
    """Distances of samples: 1 - 2 * sum(min) / (sum a + sum b), over shared features; null where both sums are 0.

    df: one row for each sample and feature. Samples are dealt out over tiles, so that a pair of samples is a row of
    the result only and in no shuffle.
    """
    kind = df.schema[sample].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                sa, sb = batch.column(1)[at].values.field("s"), batch.column(3)[at].values.field("s")
                both = pa.concat_arrays([sa, sb])
                place = np.empty(len(both), np.int64)
                place[pc.sort_indices(both).to_numpy()] = np.arange(len(both))
                one = batch.column(0)[at] == batch.column(2)[at]
                i, j = (v.ravel() for v in np.indices((len(sa), len(sb))))
                distance, empty = (v.ravel() for v in tile_distances(batch.column(1)[at], batch.column(3)[at]))
                if one:
                    rank = np.empty(len(sa), np.int64)
                    rank[pc.sort_indices(sa).to_numpy()] = np.arange(len(sa))
                    kept = rank[i] < rank[j]
                    i, j, distance, empty = i[kept], j[kept], distance[kept], empty[kept]
                    first, second = i, j + len(sa)
                else:
                    less = place[i] < place[j + len(sa)]
                    first, second = np.where(less, i, j + len(sa)), np.where(less, j + len(sa), i)
                yield pa.RecordBatch.from_arrays([both.take(pa.array(first)), both.take(pa.array(second)), pa.array(distance, pa.float64(), mask=empty)], names=["sample_a", "sample_b", "distance"])

    return tile_pairs(df, sample, feature, value).mapInArrow(run, f"sample_a {kind}, sample_b {kind}, distance double")


def centred_log_ratio(df: DataFrame, sample: str, feature: str, value: str, samples: int) -> DataFrame:
    """ln(x) minus the sample's mean of it, over the features that are positive in all samples."""
    core = df.where(F.col(value) > 0).groupBy(feature).agg(F.count_distinct(sample).alias("n")).where(F.col("n") == samples).select(feature)
    own = df.join(core, feature, "left_semi").withColumn("ln", F.ln(value))
    means = own.groupBy(sample).agg(F.avg("ln").alias("mean"))
    return own.join(means, sample).select(sample, feature, (F.col("ln") - F.col("mean")).alias("clr"))


def lineage_tree(df: DataFrame, lineage: str, weight: str) -> DataFrame:
    """count and self_count of each prefix of a lineage array: path (joined by /), depth."""
    own = df.where(F.size(lineage) > 0).groupBy(F.col(lineage).alias("l")).agg(F.sum(weight).alias("w"))
    prefixes = own.select("w", F.size("l").alias("n"), "l", F.explode(F.sequence(F.lit(1), F.size("l"))).alias("depth"))
    path: Column = F.array_join(F.slice("l", F.lit(1), F.col("depth")), "/")
    return prefixes.groupBy(path.alias("path"), "depth").agg(F.sum("w").alias("count"), F.sum(F.when(F.col("depth") == F.col("n"), F.col("w")).otherwise(0)).alias("self_count"))


def resolve_level(groups: DataFrame, annotations: DataFrame, separator: str = ";") -> DataFrame:
    """groups: protein_group. annotations: accession, value. For each group plurality_value, values, weight.

    A member votes once for each of its distinct values; the most frequent value wins, ties to the lesser. `values` are
    the distinct values, each with 1 / n of the signal. Groups without a value are named Unannotated_000001 and on, in
    byte order.
    """
    own = groups.select("protein_group").distinct()
    members = own.select("protein_group", F.explode(F.split("protein_group", separator)).alias("accession"))
    votes = members.distinct().join(annotations.select("accession", "value").distinct(), "accession").groupBy("protein_group", "value").agg(F.count(F.lit(1)).alias("votes"))
    known = votes.groupBy("protein_group").agg(F.min_by("value", F.struct(-F.col("votes"), "value")).alias("plurality_value"), F.array_sort(F.collect_set("value")).alias("values"))
    names = unannotated_names(own.join(known, "protein_group", "left_anti"), "protein_group")
    rest = names.select("protein_group", F.col("name").alias("plurality_value"), F.array("name").alias("values"))
    return known.unionByName(rest).withColumn("weight", 1.0 / F.size("values"))


def level_map(resolved: DataFrame) -> DataFrame:
    """protein_group, plurality_value, n_unique_values, split_values as `value:weight` joined by `;`."""
    parts = F.transform("values", lambda v: F.concat(v, F.lit(":"), F.format_string("%.6f", F.col("weight"))))
    return resolved.select("protein_group", "plurality_value", F.size("values").alias("n_unique_values"), F.array_join(parts, ";").alias("split_values"))


def functional_matrix(values: DataFrame, resolved: DataFrame, keys: list[str], amount: str, mode: str = "plurality") -> DataFrame:
    """values: protein_group, the keys, an amount. Sums by value and keys; keys may hold the peptide for the finer matrix.

    plurality: a group's whole amount goes to its winner; split: 1 / n of it to each of its values. Missing amounts
    stay missing: they make no row.
    """
    joined = values.where(F.col(amount).isNotNull()).join(resolved, "protein_group")
    if mode == "plurality":
        spread = joined.withColumn("value", F.col("plurality_value")).withColumn("__a", F.col(amount))
    elif mode == "split":
        spread = joined.withColumn("value", F.explode("values")).withColumn("__a", F.col(amount) * F.col("weight"))
    else:
        raise ValueError("mode is plurality or split")
    return spread.groupBy("value", *keys).agg(F.sum("__a").alias("amount"))


def group_metadata(groups: DataFrame, hosts: DataFrame, separator: str = ";") -> DataFrame:
    """groups: protein_group. hosts: accession, class. protein_group, representative, n_members, classification.

    A member that is listed is host, one that is not is microbial; a listed class Mixed makes the group Mixed.
    """
    own = groups.select("protein_group").distinct()
    listed = own.select("protein_group", F.explode(F.split("protein_group", separator)).alias("accession")).join(hosts.select("accession", "class"), "accession", "left")
    mixed, host, other = F.bool_or(F.col("class") == "Mixed"), F.bool_or(F.col("class").isNotNull()), F.bool_or(F.col("class").isNull())
    kind = F.when(F.coalesce(mixed, F.lit(False)) | (host & other), "Mixed").when(host, "Human").otherwise("Microbial")
    return listed.groupBy("protein_group").agg(F.min("accession").alias("representative"), F.count(F.lit(1)).alias("n_members"), kind.alias("classification"))


def term_coverage(values: DataFrame, sample: str, group: str, amount: str, terms: str) -> DataFrame:
    """Of each sample: observed_signal, measured_groups, unannotated_signal, annotation_fraction (null if empty)."""
    positive = F.when(F.col(amount) > 0, F.col(amount))
    bare = F.size(F.coalesce(terms, F.array().cast("array<string>"))) == 0
    got = values.groupBy(sample).agg(F.coalesce(F.sum(positive), F.lit(0.0)).alias("observed_signal"), F.count_distinct(F.when(F.col(amount) > 0, F.col(group))).alias("measured_groups"), F.coalesce(F.sum(F.when(bare, positive)), F.lit(0.0)).alias("unannotated_signal"))
    return got.withColumn("annotation_fraction", F.try_divide(F.col("observed_signal") - F.col("unannotated_signal"), F.col("observed_signal")))
