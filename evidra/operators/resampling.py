"""Permutation tests, bootstrap intervals and principal components of samples.

Random choices are functions of a seed and of counters, so that they don't depend on partitions or on the order of
rows, and a task that runs again makes them again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators import rollup
from evidra.operators.lineage import cut

#: Samples in a tile of the distance matrix.
TILE = 256


def permutations(design: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """design: sample, label, block. permutation, sample, label for 0 (as it is) to `count`.

    Within a block, samples are ordered by sha256(`<seed>:<permutation>:<sample>`) and take the labels of the block's
    samples in order of their names.
    """
    every = design.withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(count))))
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("permutation"), F.col("sample").cast("string")), 256)
    shuffled = every.withColumn("slot", F.row_number().over(Window.partitionBy("permutation", "block").orderBy(key, "sample"))).drop("label")
    slots = design.withColumn("slot", F.row_number().over(Window.partitionBy("block").orderBy("sample"))).select("block", "slot", "label")
    moved = shuffled.join(slots, ["block", "slot"]).select("permutation", "sample", "label")
    return design.select(F.lit(0).alias("permutation"), "sample", "label").unionByName(moved)


def _groups(design: DataFrame) -> list[tuple]:
    """Labels and numbers of their samples, after a check of the design."""
    groups = [(r.label, r.n) for r in design.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()]  # the conditions of a study
    n = sum(k for _, k in groups)
    moving = design.groupBy("block").agg(F.count_distinct("label").alias("k")).agg(F.max("k")).first()[0]
    bad = design.agg(F.count_if(F.col("label").isNull() | F.col("block").isNull() | F.col("sample").isNull()), F.count_distinct("sample")).first()
    if bad[0] or bad[1] != n:
        raise ValueError("each sample needs one label and one block")
    if len(groups) < 2 or min(k for _, k in groups) < 2:
        raise ValueError("at least two groups of at least two samples are needed")
    if moving < 2:
        raise ValueError("no label can move within the blocks")
    return groups


def _codes(design: DataFrame, groups: list[tuple], count: int, seed: int) -> DataFrame:
    """permutation, sample, label, code (number of the label), share."""
    code = design.sparkSession.createDataFrame([(label, i, 1.0 / k) for i, (label, k) in enumerate(groups)], design.select("label").schema.add("code", "integer").add("share", "double"))
    return permutations(design, count, seed).join(F.broadcast(code), "label")


def _statistics(within: DataFrame, squares: float, groups: list[tuple]) -> DataFrame:
    """within: permutation, within."""
    n, k = sum(size for _, size in groups), len(groups)
    total = squares / n
    statistic = F.when(F.col("within") > 0, ((F.lit(total) - F.col("within")) / (k - 1)) / (F.col("within") / (n - k))).otherwise(float("inf"))
    return within.select("permutation", "within", F.lit(total).alias("total"), F.lit(n).alias("samples"), F.lit(k).alias("groups"), statistic.alias("pseudo_f"))


def table_statistics(df: DataFrame, sample: str, feature: str, value: str, design: DataFrame, count: int = 999, seed: int = 0) -> DataFrame:
    """The columns of `permanova_statistics` for the Bray-Curtis distances of `df`, a row for each sample and feature.

    A task makes the distances of two tiles of samples, meets them with the labels in all permutations, and hands on
    one sum for each permutation. No pair of samples is a row.
    """
    groups = _groups(design)
    n, shares = sum(k for _, k in groups), [1.0 / k for _, k in groups]
    moved = _codes(design, groups, count, seed).groupBy(F.col("sample").alias("s")).agg(F.array_sort(F.collect_list(F.struct("permutation", "code"))).alias("c"))  # the permutations of one sample
    codes = moved.select("s", F.transform("c", lambda r: r["code"].cast("smallint")).alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within, squares, pairs, bad = np.zeros(count + 1), 0.0, 0, 0
        for batch in batches:
            for at in range(batch.num_rows):
                r, rb = batch.column(1)[at], batch.column(3)[at]
                distance, empty = rollup.tile_distances(r, rb)
                own = np.ones(distance.shape, bool)
                if batch.column(0)[at] == batch.column(2)[at]:
                    own = np.triu(own, 1)
                wrong = own & (empty | ~(distance >= 0) | np.isinf(distance))
                pairs, bad = pairs + int(own.sum()), bad + int(wrong.sum())
                d = np.where(own & ~wrong, distance, 0.0) ** 2
                squares += float(d.sum())
                la, lb = (x.values.field("codes").flatten().to_numpy().reshape(-1, count + 1) for x in (r, rb))
                for g, share in enumerate(shares):
                    within += share * ((la == g) * (d @ (lb == g).astype(np.float64))).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count + 1), pa.int32()), pa.array(within), *(pa.array([x] * (count + 1), kind) for x, kind in ((squares, pa.float64()), (pairs, pa.int64()), (bad, pa.int64())))], names=["permutation", "within", "squares", "pairs", "bad"])

    tiles = rollup.tile_pairs(df, sample, feature, value, codes)
    sums = tiles.mapInArrow(run, "permutation int, within double, squares double, pairs bigint, bad bigint").groupBy("permutation")
    summed = cut(sums.agg(*[F.sum(c).alias(c) for c in ("within", "squares", "pairs", "bad")]))
    checked = summed.where("permutation = 0").first()
    if checked is None or checked.pairs != n * (n - 1) // 2 or checked.bad:
        raise ValueError("distances must be finite, not negative, and one for each pair of samples")
    if not checked.squares > 0:
        raise ValueError("all distances are 0")
    return _statistics(summed.select("permutation", "within"), checked.squares, groups)


def permanova_statistics(distances: DataFrame, design: DataFrame, count: int = 999, seed: int = 0, tile: int = TILE) -> DataFrame:
    """permutation, within, total, samples, groups, pseudo_f; see `permanova`.

    The matrix of squared distances is cut into tiles of `tile` samples squared. A tile meets the labels that its rows
    and columns have in all permutations and gives one sum for each permutation.
    """
    groups = _groups(design)
    n = sum(k for _, k in groups)
    tiles = -(-n // tile)
    place = design.select("sample", F.expr(f"pmod(xxhash64(sample), {tiles})").cast("int").alias("tile"))
    place = cut(place.withColumn("at", F.row_number().over(Window.partitionBy("tile").orderBy("sample")) - 1))
    x, y = place.select(F.col("sample").alias("sample_a"), F.col("tile").alias("ta"), F.col("at").alias("ia")), place.select(F.col("sample").alias("sample_b"), F.col("tile").alias("tb"), F.col("at").alias("ib"))
    pairs = distances.join(x, "sample_a").join(y, "sample_b")
    checked = pairs.agg(F.count(F.lit(1)), F.count_if(F.col("distance").isNull() | F.isnan("distance") | (F.col("distance") < 0) | (F.col("distance") == float("inf"))), F.count_if(F.col("sample_a") == F.col("sample_b")), F.count_distinct(F.least("sample_a", "sample_b"), F.greatest("sample_a", "sample_b")), F.sum(F.col("distance") * F.col("distance"))).first()
    if checked[0] != n * (n - 1) // 2 or checked[1] or checked[2] or checked[3] != checked[0]:
        raise ValueError("distances must be finite, not negative, and one for each pair of samples")
    if not checked[4] > 0:
        raise ValueError("all distances are 0")
    moved = _codes(design, groups, count, seed).join(place, "sample")
    # one row for each tile and permutation: codes by place; `tile` samples or some more
    packed = moved.groupBy("tile", "permutation").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda r: r["code"]).alias("codes"))
    packed = packed.groupBy("tile", F.expr("permutation div 128").alias("part")).agg(F.array_sort(F.collect_list(F.struct("permutation", "codes"))).alias("labels"))
    packed = cut(packed)
    squares = pairs.groupBy("ta", "tb").agg(F.collect_list(F.struct("ia", "ib", (F.col("distance") * F.col("distance")).alias("d"))).alias("cells"))  # tile * tile cells
    rows = squares.join(packed.select(F.col("tile").alias("ta"), "part", F.col("labels").alias("la")), "ta").join(packed.select(F.col("tile").alias("tb"), "part", F.col("labels").alias("lb")), ["tb", "part"])
    shares = np.array([1.0 / k for _, k in groups])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells, la, lb in zip(*batch.columns, strict=True):
                ia, ib, d = (cells.values.field(k).to_numpy(zero_copy_only=False) for k in ("ia", "ib", "d"))
                numbers, within = [], []
                for a, b in zip(la.as_py(), lb.as_py(), strict=True):
                    own, other = np.array(a["codes"])[ia], np.array(b["codes"])[ib]
                    same = own == other
                    numbers.append(a["permutation"])
                    within.append(float((d[same] * shares[own[same]]).sum()))
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(within, pa.float64())], names=["permutation", "within"])

    summed = rows.select("cells", "la", "lb").mapInArrow(run, "permutation int, within double").groupBy("permutation").agg(F.sum("within").alias("within"))
    return _statistics(summed, checked[4], groups)


def permanova(distances: DataFrame, design: DataFrame, count: int = 999, seed: int = 0, tile: int = TILE) -> DataFrame:
    """One row: pseudo_f, r_squared, p_value, permutations, samples, groups of a one-way permutational analysis.

    distances: sample_a, sample_b, distance, a row for each unordered pair. design: sample, label, block (one value
    for free permutations). The p-value is (1 + permutations with a statistic as large) / (1 + permutations); equality
    is up to 1e-12 of the observed one. Missing labels, groups of one sample, incomplete distances, a sum of 0 and
    labels that can't move are errors.
    """
    return _tested(cut(permanova_statistics(distances, design, count, seed, tile)))


def table_permanova(df: DataFrame, sample: str, feature: str, value: str, design: DataFrame, count: int = 999, seed: int = 0) -> DataFrame:
    """`permanova` of the Bray-Curtis distances of a table, see `table_statistics`."""
    return _tested(table_statistics(df, sample, feature, value, design, count, seed))


def _tested(made: DataFrame) -> DataFrame:
    observed = F.broadcast(made.where("permutation = 0").select(F.col("pseudo_f").alias("f"), ((F.col("total") - F.col("within")) / F.col("total")).alias("r_squared"), "samples", "groups"))
    checked = F.when(F.col("f") == float("inf"), F.raise_error(F.lit("no dispersion within groups")).cast("double")).otherwise(F.col("f"))
    joined = made.where("permutation > 0").select(F.col("pseudo_f").alias("own")).crossJoin(observed)  # one row
    reached = F.count_if(F.col("own") >= F.col("f") - 1e-12 * F.greatest(F.lit(1.0), F.abs("f")))
    return joined.groupBy(checked.alias("pseudo_f"), "r_squared", "samples", "groups").agg(((1 + reached) / (1 + F.count(F.lit(1)))).alias("p_value"), F.count(F.lit(1)).alias("permutations"))


def scramble(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser over uint32 arrays."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def picks(seed: int, draw: int, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Places 0 to n - 1 that a draw with replacement takes: one for each counter from `first` to `last` (n)."""
    base = scramble(np.array([draw], np.uint32) ^ scramble(np.array([seed & 0xFFFFFFFF], np.uint32)))[0]
    at = scramble(np.arange(first, n if last is None else last, dtype=np.uint32) ^ base)
    return (at.astype(np.uint64) * np.uint64(n)) >> np.uint64(32)


def bootstrap_median(df: DataFrame, value: str, keys: list[str] = (), draws: int = 2000, seed: int = 42, alpha: float = 0.05, chunk: int = 1 << 20) -> DataFrame:
    """keys, n, ci_lo, ci_hi: percentile interval of the median of each group from `draws` resamples.

    A resample is a count for each place in the sorted group; its median comes from running sums of the counts, so
    only places move, never values. Nulls and NaN don't count; five values or less have no interval (null). Groups of
    fewer than 2**32 values. A task holds 8 bytes for each value of one group; draws are dealt out over tasks.
    """
    named, keys = list(keys), [f"__{i}" for i in range(max(1, len(list(keys))))]
    groups = [F.col(c).alias(k) for c, k in zip(named, keys, strict=False)] or [F.lit(0).alias("__0")]
    own = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*groups, F.col(value).cast("double").alias("__v"))
    ranked = cut(own.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("__v")) - 1))
    sizes = cut(ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    parts = max(1, draws // 64)
    wanted = sizes.where("n > 5").select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sizes.schema if f.name in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, low, high = [], [], []
            for i, (n, part) in enumerate(zip(batch.column("n").to_pylist(), batch.column("part").to_pylist(), strict=True)):
                for draw in range(part, draws, parts):
                    counts = np.zeros(n, np.int64)
                    for first in range(0, n, chunk):
                        counts += np.bincount(picks(seed, draw, n, first, min(n, first + chunk)).astype(np.int64), minlength=n)
                    running = np.cumsum(counts)
                    row.append(i)
                    low.append(int(np.searchsorted(running, (n - 1) // 2 + 1)))
                    high.append(int(np.searchsorted(running, n // 2 + 1)))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=[*keys, "low", "high"])

    drawn = wanted.mapInArrow(run, f"{kinds}, low int, high int")
    # places are few against draws * values: how often each pair of them came is enough
    drawn = drawn.groupBy(*keys, "low", "high").agg(F.count(F.lit(1)).alias("k"))
    a, b = (ranked.select(*keys, F.col("place").alias(p), F.col("__v").alias(v)) for p, v in (("low", "__a"), ("high", "__b")))
    medians = drawn.join(a, [*keys, "low"]).join(b, [*keys, "high"]).select(*keys, ((F.col("__a") + F.col("__b")) / 2).alias("m"), "k")
    below = F.sum("k").over(Window.partitionBy(*keys).orderBy("m", F.monotonically_increasing_id()).rowsBetween(Window.unboundedPreceding, 0))
    first, last = int((alpha / 2) * draws), min(int((1 - alpha / 2) * draws), draws - 1)
    ends = medians.withColumn("below", below).groupBy(*keys).agg(F.min(F.when(F.col("below") > first, F.col("m"))).alias("ci_lo"), F.min(F.when(F.col("below") > last, F.col("m"))).alias("ci_hi"))
    return sizes.join(ends, keys, "left").select(*[F.col(k).alias(c) for k, c in zip(keys, named, strict=False)], "n", "ci_lo", "ci_hi")


@dataclass(frozen=True)
class Components:
    """status: PASS or why not. scores: sample, component, score. loadings: feature, component, loading.
    variance: component, variance, ratio. samples: those included. features: feature, complete, eligible."""

    status: str
    scores: DataFrame
    loadings: DataFrame
    variance: DataFrame
    samples: list
    features: DataFrame


def gram(logs: DataFrame, order: list) -> DataFrame:
    """logs: feature, sample, x (complete). i, j, value: sums over features of products of centred values.

    Each task sums up outer products of its features in one matrix of samples squared.
    """
    place = {s: i for i, s in enumerate(order)}
    n = len(order)
    at = logs.sparkSession.createDataFrame(list(place.items()), logs.select("sample").schema.add("i", "integer"))
    rows = logs.join(F.broadcast(at), "sample").groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("x"))  # one for each sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                x = x - x.mean(1, keepdims=True)
                total += x.T @ x
        i, j = np.divmod(np.arange(n * n), n)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.reshape(-1))], names=["i", "j", "value"])

    return rows.select("x").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def principal_components(matrix: DataFrame, most: int = 10, chosen: list | None = None, most_samples: int = 4096) -> Components:
    """Components of samples from log2 of the features that all included samples have; nothing is imputed.

    matrix: sample, feature, value. Only values above 0 are measured. Included are samples with a measured value (of
    `chosen`, if given); complete features are measured in all of them, eligible ones also vary. Three samples and two
    eligible features are needed. Features are centred, not scaled. A component's sign makes its score of largest size
    positive (the first of equal ones by sample). The driver holds the matrix of samples squared, so more than
    `most_samples` of them are an error.
    """
    spark = matrix.sparkSession
    own = matrix.where(F.col("value") > 0).select("sample", "feature", F.log2("value").alias("x"))
    if chosen is not None:
        own = own.where(F.col("sample").isin(chosen))
    own = cut(own)
    order = sorted(r.sample for r in own.select("sample").distinct().limit(most_samples + 1).collect())
    n = len(order)
    if n > most_samples:
        raise ValueError(f"more than {most_samples} samples")
    seen = own.groupBy("feature").agg(F.count_distinct("sample").alias("k"), F.min("x").alias("low"), F.max("x").alias("high"))
    marks = matrix.select("feature").distinct().join(seen, "feature", "left")
    complete = F.coalesce((F.col("k") == n) & F.lit(n > 0), F.lit(False))
    marks = cut(marks.select("feature", complete.alias("complete"), (complete & F.coalesce(F.col("high") > F.col("low"), F.lit(False)) & F.lit(n >= 2)).alias("eligible")))
    eligible = marks.where("eligible").select("feature")
    n_features = eligible.count()
    kinds = {f.name: f.dataType for f in own.schema}
    empty = lambda text: spark.createDataFrame([], text)
    if n < 3 or n_features < 2:
        none = "sample {}, component int, score double", "feature {}, component int, loading double", "component int, variance double, ratio double"
        return Components("SKIPPED: three samples and two complete varying features are needed", empty(none[0].format(kinds["sample"].simpleString())), empty(none[1].format(kinds["feature"].simpleString())), empty(none[2]), order, marks)
    logs = cut(own.join(eligible, "feature", "left_semi"))
    # centring by feature, over samples: the Gram matrix of x - mean(x)
    got = gram(logs, order).toArrow()
    g = np.zeros((n, n))
    g[got["i"].to_numpy(), got["j"].to_numpy()] = got["value"].to_numpy()
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    count = min(most, n - 1, n_features)
    values, vectors = np.maximum(values[::-1][:count], 0), vectors[:, ::-1][:, :count]
    signs = np.sign(vectors[np.abs(vectors).round(12).argmax(0), np.arange(count)])
    vectors = vectors * np.where(signs == 0, 1, signs)
    whole = float(np.trace(g))
    scores = vectors * np.sqrt(values)
    component = range(1, count + 1)
    score_rows = spark.createDataFrame([(s, c, float(scores[i, c - 1])) for i, s in enumerate(order) for c in component], own.select("sample").schema.add("component", "integer").add("score", "double"))
    variance = spark.createDataFrame([(c, float(values[c - 1] / (n - 1)), float(values[c - 1] / whole)) for c in component], "component int, variance double, ratio double")
    # a loading is the product of the feature's centred values with the unit score vector; centring drops out, as those sum to 0
    unit = spark.createDataFrame([(s, c, float(vectors[i, c - 1] / np.sqrt(values[c - 1])) if values[c - 1] > 0 else 0.0) for i, s in enumerate(order) for c in component], own.select("sample").schema.add("component", "integer").add("u", "double"))
    loadings = logs.join(F.broadcast(unit), "sample").groupBy("feature", "component").agg(F.sum(F.col("x") * F.col("u")).alias("loading"))
    return Components("PASS", score_rows, loadings, variance, order, marks)
