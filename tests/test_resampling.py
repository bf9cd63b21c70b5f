"""Permutation tests, bootstrap and components against NumPy loops; the greedy razor on one large component."""

import hashlib
import math
import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.operators import graph, resampling, rollup


def study(n, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1, (n // 2, 3)), rng.normal(1.5, 1, (n - n // 2, 3))])
    labels = ["a"] * (n // 2) + ["b"] * (n - n // 2)
    return np.linalg.norm(x[:, None] - x[None], axis=-1), labels, [i % 3 for i in range(n)]


def frames(spark, d, labels, blocks):
    n = len(labels)
    pairs = [(i, j, float(d[i, j])) for i in range(n) for j in range(i + 1, n)]
    return spark.createDataFrame(pairs, "sample_a int, sample_b int, distance double"), spark.createDataFrame(list(zip(range(n), labels, blocks)), "sample int, label string, block int")


def loop(d, labels, blocks, count, seed):
    n, names = len(labels), sorted(set(labels))
    sizes = Counter(labels)
    total = sum(d[i, j] ** 2 for i in range(n) for j in range(i)) / n

    def statistic(own):
        within = sum(d[i, j] ** 2 / sizes[own[i]] for i in range(n) for j in range(i) if own[i] == own[j])
        return ((total - within) / (len(names) - 1)) / (within / (n - len(names))), (total - within) / total

    observed, share = statistic(labels)
    reached = 0
    for p in range(1, count + 1):
        own = list(labels)
        for b in set(blocks):
            members = [i for i in range(n) if blocks[i] == b]
            mixed = sorted(members, key=lambda i: (hashlib.sha256(f"{seed}:{p}:{i}".encode()).hexdigest(), i))
            for slot, i in enumerate(mixed):
                own[i] = labels[members[slot]]
        reached += statistic(own)[0] >= observed - 1e-12 * max(1, abs(observed))
    return observed, share, (1 + reached) / (1 + count)


@pytest.mark.parametrize(("blocked", "tile"), [(False, 256), (True, 5)])
def test_permanova_equals_a_loop(spark, blocked, tile):
    d, labels, blocks = study(17, 3)
    blocks = blocks if blocked else [0] * 17
    row, = resampling.permanova(*frames(spark, d, labels, blocks), count=19, seed=4, tile=tile).collect()
    f, share, p = loop(d, labels, blocks, 19, 4)
    assert (row.pseudo_f, row.r_squared, row.p_value) == (pytest.approx(f), pytest.approx(share), p)
    assert (row.permutations, row.samples, row.groups) == (19, 17, 2)


def test_permanova_refuses(spark):
    d, labels, blocks = study(8, 1)
    pairs, design = frames(spark, d, labels, [0] * 8)
    for bad in (design.where("sample > 0").unionByName(design.where("sample = 0").selectExpr("sample", "CAST(NULL AS STRING) AS label", "block")), design.selectExpr("sample", "'x' AS label", "block"), design.selectExpr("sample", "if(sample = 0, 'z', label) AS label", "block"), design.selectExpr("sample", "label", "sample AS block")):
        with pytest.raises(ValueError):
            resampling.permanova(pairs, bad, 9)
    for bad in (pairs.where("sample_a > 0"), pairs.selectExpr("sample_a", "sample_b", "0D AS distance"), pairs.selectExpr("sample_a", "sample_b", "-distance AS distance"), pairs.unionByName(pairs.limit(1))):
        with pytest.raises(ValueError):
            resampling.permanova(bad, design, 9)


def test_a_table_is_tested_without_a_row_for_a_pair(spark, monkeypatch):
    """Tiles of 6 samples; the plan has no column of pairs, and its result is that of the distances."""
    rng = random.Random(6)
    labels, blocks = ["a"] * 12 + ["b"] * 13, [i % 2 for i in range(25)]
    cells = [(i, f, rng.random() + (f == 2 and labels[i] == "a")) for i in range(25) for f in range(4) if rng.random() < 0.8 or f == 0]
    df = spark.createDataFrame(cells, "s int, f int, v double")
    design = spark.createDataFrame(list(zip(range(25), labels, blocks)), "sample int, label string, block int")
    monkeypatch.setattr(rollup, "TILE", 6)
    want, = resampling.permanova(rollup.bray_curtis(df, "s", "f", "v"), design, 19, 4).collect()
    schemas = []
    monkeypatch.setattr(resampling, "cut", lambda x, f=resampling.cut: schemas.append(x.columns) or f(x))
    got, = resampling.table_permanova(df, "s", "f", "v", design, 19, 4).collect()
    assert got.asDict() == pytest.approx(want.asDict()) and schemas == [["permutation", "within", "squares", "pairs", "bad"]]
    for bad in (df.where("s > 0"), df.withColumn("v", F.when(F.col("s") > 1, F.col("v")).otherwise(0.0)), df.withColumn("v", F.lit(1.0)).where("f = 0")):
        with pytest.raises(ValueError):
            resampling.table_permanova(bad, "s", "f", "v", design, 19, 4)


def test_bootstrap_equals_a_loop(spark):
    rng = random.Random(1)
    groups = {"a": [rng.choice([1.0, 2.0, 3.5, rng.random()]) for _ in range(40)], "b": [rng.random() for _ in range(41)], "c": [1.0] * 5, "d": [2.0] * 9}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.n, r.ci_lo, r.ci_hi) for r in resampling.bootstrap_median(df, "v", ["k"], draws=150, seed=9, chunk=16).collect()}
    for k, values in groups.items():
        own, n = sorted(values), len(values)
        if n <= 5:
            assert got[k] == (n, None, None)
            continue
        medians = sorted(statistics.median(own[int(i)] for i in resampling.picks(9, d, n)) for d in range(150))
        assert got[k] == (n, medians[int(0.025 * 150)], medians[int(0.975 * 150)])
    whole, = resampling.bootstrap_median(df.where("k = 'd'"), "v", draws=70).collect()
    assert tuple(whole) == (9, 2.0, 2.0)


def test_picks_are_uniform():
    counts = np.bincount(np.concatenate([resampling.picks(3, d, 10).astype(int) for d in range(4000)]), minlength=10)
    assert counts.sum() == 40_000 and abs(counts - 4000).max() < 6 * math.sqrt(4000)


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.exp2(rng.normal(size=(7, 30)) * [3] * 1 + rng.normal(size=(1, 30)))
    rows = [(f"s{i}", f"f{j}", float(x[i, j])) for i in range(7) for j in range(30) if not (j == 4 and i == 2)]
    rows += [("empty", "f0", 0.0), ("empty", "f1", None)] + [(f"s{i}", "flat", 2.0) for i in range(7)]
    got = resampling.principal_components(spark.createDataFrame(rows, "sample string, feature string, value double"))
    keep = [j for j in range(30) if j != 4]
    logs = np.log2(x[:, keep])
    logs -= logs.mean(0)
    u, s, vt = np.linalg.svd(logs, full_matrices=False)
    signs = np.sign(u[np.abs(u).argmax(0), np.arange(7)])
    u, vt = u * signs, vt * signs[:, None]
    assert got.status == "PASS" and got.samples == [f"s{i}" for i in range(7)]
    assert {(r.sample, r.component): r.score for r in got.scores.collect()} == {(f"s{i}", c + 1): pytest.approx(u[i, c] * s[c], abs=1e-8) for i in range(7) for c in range(6)}
    assert {(r.feature, r.component): r.loading for r in got.loadings.collect()} == {(f"f{j}", c + 1): pytest.approx(vt[c, k], abs=1e-8) for k, j in enumerate(keep) for c in range(6)}
    assert {r.component: (r.variance, r.ratio) for r in got.variance.collect()} == {c + 1: (pytest.approx(s[c] ** 2 / 6), pytest.approx(s[c] ** 2 / (s**2).sum())) for c in range(6)}
    marks = {r.feature: (r.complete, r.eligible) for r in got.features.collect()}
    assert marks["f4"] == (False, False) and marks["flat"] == (True, False) and marks["f0"] == (True, True)


def test_components_need_three_samples(spark):
    df = spark.createDataFrame([(f"s{i}", f"f{j}", float(i + j + 1)) for i in range(2) for j in range(4)], "sample string, feature string, value double")
    got = resampling.principal_components(df)
    assert got.status.startswith("SKIPPED") and got.scores.count() == got.loadings.count() == got.variance.count() == 0
    with pytest.raises(ValueError):
        resampling.principal_components(df, most_samples=1)


@pytest.mark.parametrize("block", [100_000, 7])
def test_greedy_razor_on_one_component(spark, block):
    """Proteins of equal numbers of peptides, so that nearly every choice depends on the ones before."""
    rng = random.Random(block)
    proteins = [f"P{i:02}" for i in range(12)]
    pairs = set()
    for p in range(0, 360, 3):
        for k in range(3):
            a, b = rng.sample(proteins, 2)
            pairs |= {(p + k, a), (p + k, b)}
    most = max(Counter(r for _, r in pairs).values())
    for r in proteins:  # fill up, so that all are level
        have = sum(x == r for _, x in pairs)
        pairs |= {(1000 + 100 * proteins.index(r) + i, r) for i in range(most - have)}
        pairs |= {(5000 + 100 * proteins.index(r) + i, r) for i in range(have)}
    degree, total, unique, assigned, want = Counter(p for p, _ in pairs), Counter(r for _, r in pairs), Counter(), Counter(), {}
    own = {}
    for p, r in pairs:
        unique[r] += degree[p] == 1
        own.setdefault(p, []).append(r)
    for p in sorted(degree, key=lambda p: (-degree[p], p)):
        want[p] = min(own[p], key=lambda r: (-unique[r], -total[r], -assigned[r], r))
        assigned[want[p]] += 1
    got = graph.razor_greedy(spark.createDataFrame(sorted(pairs), "peptide int, protein string"), block=block)
    assert {r.peptide: r.protein for r in got.collect()} == want and len(set(unique.values())) < 12


def test_greedy_rounds_leave_decided_rows_alone(spark, monkeypatch):
    """Rounds write rows of proteins that are still open only, not all that is decided."""
    pairs = [(k, r) for k in range(8) for r in ("A", "B")] + [(100 + k, f"C{k % 50}") for k in range(2000)]
    written, cut = [], graph.cut

    def counted(df):
        got = cut(df)
        written.append(got.count())
        return got

    monkeypatch.setattr(graph, "cut", counted)
    got = {r.peptide: r.protein for r in graph.razor_greedy(spark.createDataFrame(pairs, "peptide int, protein string")).collect()}
    assert got == {p: r for p, r in pairs if p >= 8} | dict.fromkeys(range(8), "A")
    assert sum(written) < 3 * len(pairs), written
