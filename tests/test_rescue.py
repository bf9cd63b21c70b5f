"""The mass index, its three phases and anchors against loops over all places."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evidra.functions import sequence as S
from evidra.operators import massindex as M

MASS = {r: round(m * M.UNIT) for r, m in S.RESIDUE_MASS.items()}


def bin_of(mer, rule):
    mass = sum(MASS.get(r, 0) for r in mer)
    return (mass + 500) // 1000 if rule == "nearest" else max(0, mass - 280_000_000) // 1000


def brute_votes(query, target, rule, k=5):
    own = [bin_of(query[i : i + k], rule) for i in range(len(query) - k + 1)]
    votes = Counter()
    for at in range(len(target) - k + 1):
        b = bin_of(target[at : at + k], rule)
        for i, q in enumerate(own):
            if abs(q - b) <= 1 and at >= i:
                votes[at - i] += 1
    return votes


def world(rng):
    alphabet = "AGILKNQSTV"
    targets = {f"t{i}": "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 5, 60, 1500]))) for i in range(12)}
    targets |= {"common": "AG" * 600, "odd": "ABXZ*LLKKVV" * 5}
    peptides = []
    for name in list(targets):
        text = targets[name]
        for _ in range(4):
            n = rng.randint(8, 20)
            if len(text) > n:
                at = rng.randrange(len(text) - n)
                p = list(text[at : at + n])
                x = rng.randrange(n - 1)
                if rng.random() < 0.6:
                    p[x], p[x + 1] = p[x + 1], p[x]
                peptides.append("".join(p))
    return targets, [p for p in peptides if M.SHORTEST <= len(p) and all(r in MASS for r in p)]


@pytest.mark.parametrize(("rule", "hot"), [("nearest", 1_000_000), ("from_least", 40)])
def test_votes_equal_a_loop_over_all_places(spark, rule, hot):
    targets, peptides = world(random.Random(hot))
    rows = spark.createDataFrame(list(targets.items()) + [("none", None)], "target string, sequence string")
    queries = spark.createDataFrame([(f"q{i}", p) for i, p in enumerate(peptides)], "query string, sequence string")
    index = M.write_index(rows, rule=rule, buckets=3, hot=hot)
    for least in (1, 4):
        got = {(r.query, r.target, r.start): r.votes for r in M.voted(index, queries, least).collect()}
        want = {(f"q{i}", t, at): v for i, p in enumerate(peptides) for t, text in targets.items() for at, v in brute_votes(p, text, rule).items() if v >= least}
        assert got == want


def test_the_index_is_joined_without_a_shuffle(spark):
    targets, peptides = world(random.Random(2))
    index = M.write_index(spark.createDataFrame(list(targets.items()), "target string, sequence string"), buckets=4)
    queries = spark.createDataFrame([(f"q{i}", p) for i, p in enumerate(peptides)], "query string, sequence string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = M.places(index, queries, 3)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    at = next(i for i, line in enumerate(plan) if index.name in line and "Scan" in line)
    above, level = [], depth(plan[at])
    for line in reversed(plan[:at]):
        if depth(line) < level:
            level = depth(line)
            above.append(line)
    join = next(i for i, line in enumerate(above) if "Join" in line)
    assert not any("Exchange" in line for line in above[:join]) and "Bucketed: true" in plan[at]


def test_phases_equal_a_loop(spark):
    rng = random.Random(5)
    targets, peptides = world(rng)
    samples = [(f"s{k}", rng.choice(peptides), rng.choice([0.1, 0.5, 0.5, 0.9])) for k in range(4) for _ in range(20)]
    samples += [("s0", "AAAAAAAA", 0.9), ("s0", "SHORT", 0.9), ("s0", "KLBNMQSTVA", 0.9), ("s1", None, 0.5), ("s2", " " + peptides[0].lower() + " ", None)]
    own = targets_frame = spark.createDataFrame(list(targets.items()), "target string, sequence string")
    made = M.prepare(spark.createDataFrame(samples, "sample string, peptide string, score double"), targets_frame, 0.5)
    good = [(s, p.strip().upper(), v or 0.0) for s, p, v in samples if p and M.SHORTEST <= len(p.strip()) and all(r in MASS for r in p.strip().upper()) and max(Counter(p.strip().upper()).values()) * 2 <= len(p.strip())]
    assert {r.sample: r.n_peptides for r in made.manifest.collect()} == Counter(s for s, _, _ in good)
    kept = {}
    for s in {s for s, _, _ in good}:
        ranked = sorted(((p, v) for x, p, v in good if x == s), key=lambda r: (-r[1], r[0]))
        for p, v in ranked[: -(-len(ranked) // 2)]:
            kept[s, p] = max(v, kept.get((s, p), 0))
    assert {(r.sample, r.peptide): r.score for r in made.samples.collect()} == kept
    fold = lambda text: text.replace("I", "L")
    matched = {p for _, p in kept if any(fold(p) in fold(t) for t in targets.values())}
    assert {r.peptide for r in made.matched.collect()} == matched
    evidence = {t for t, text in targets.items() if any(fold(p) in fold(text) for _, p in kept)}
    assert {r.target for r in made.evidence.collect()} == evidence
    best = {}
    for p in {p for _, p in kept} - matched:
        found = [(-v, t) for t, text in targets.items() for v in brute_votes(p, text, "from_least").values() if v >= 2]
        if found:
            best[p] = (min(found)[1], -min(found)[0])
    index = M.write_index(own, buckets=3)
    rescued = M.rescue(index, made, 2)
    assert {(r.sample, r.peptide): (r.target, r.votes, r.n_kmers, r.score) for r in rescued.collect()} == {(s, p): (*best[p], len(p) - 4, v) for (s, p), v in kept.items() if p in best}
    halves = [M.rescue(M.write_index(own.where(f"hash(target) % 2 {c} 0"), buckets=2), made, 2) for c in ("=", "<>")]
    union = M.merged(*halves)
    assert {r.peptide: (r.target, r.votes) for r in union.collect()} == best
    got = {r.target: r.origin for r in M.enhanced(made, union).collect()}
    found = {t for t, _ in best.values()}
    assert got == {t: "both" if t in evidence & found else "exact" if t in evidence else "rescued" for t in evidence | found}


def test_anchors_by_mass(spark):
    rows = [("ACDEFGHIK", 0.5, 500.0, 2.0), ("ACDEFGHIK", 0.9, None, None), (" acdefghik ", 0.9, 501.0, 2.0), ("AAAAAAAAK", 1.0, None, None), ("ACDEFGH", 1.0, None, None), ("ACDEFGHIKX", 1.0, None, None), ("LMNPQRSTV", None, 0.0, 2.0)]
    got = {r.query: r for r in M.anchors(spark.createDataFrame(rows, "sequence string, score double, mz double, charge double")).collect()}
    assert set(got) == {"ACDEFGHIK", "LMNPQRSTV"}
    assert got["ACDEFGHIK"].mass == pytest.approx(1002 - 2 * M.PROTON) and got["ACDEFGHIK"].mass_source == "measured" and got["ACDEFGHIK"].score == 0.9
    assert got["LMNPQRSTV"].mass == pytest.approx(sum(S.RESIDUE_MASS[r] for r in "LMNPQRSTV") + M.WATER) and got["LMNPQRSTV"].mass_source == "theoretical"


def test_anchored_windows_may_be_longer(spark):
    """GG weighs as much as N, so the window has a residue more than the query."""
    text = "MKTAYIAKQRGGFVKSHFSRQLEE"
    query = "KQRNFVKSHF"
    mass = sum(S.RESIDUE_MASS[r] for r in query) + M.WATER
    index = M.write_index(spark.createDataFrame([("t", text), ("u", "GASPGASPGASPGASP")], "target string, sequence string"), rule="nearest", buckets=2)
    row, = M.anchored(index, spark.createDataFrame([("q", query, mass)], "query string, sequence string, mass double"), 1).collect()
    assert (row.target, row.start, row.length) == ("t", text.index("KQRGG"), len(query) + 1) and row.error_ppm < 20


def test_a_search_writes_and_hands_on_little(spark):
    """No k-mer and no place is a row: of texts that are all alike, each query gets one row from a group of pieces."""
    from evidra.session import shared_dir

    text = "".join(random.Random(8).choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(300))
    index = M.write_index(spark.createDataFrame([(i, text) for i in range(400)], "target int, sequence string"), rule="nearest", buckets=2)
    folder = os.path.join(shared_dir(spark).removeprefix("file://"), "evidra", os.path.basename(index.root))
    assert sorted(os.listdir(folder)) == ["counts", "pieces"] and not spark.catalog.tableExists(index.name)
    peptides = [text[k : k + 12] for k in range(0, 288, 4)]
    queries = spark.createDataFrame([(p, p, sum(S.RESIDUE_MASS[r] for r in p) + M.WATER) for p in peptides], "query string, sequence string, mass double")
    groups = index.pieces.rdd.getNumPartitions()
    assert len(peptides) <= M._search(index, queries, 4, M.PPM, True).count() <= len(peptides) * groups
    assert {(r.query, r.target, r.start) for r in M.anchored(index, queries, 4).collect()} == {(p, 0, text.index(p)) for p in peptides}


@pytest.mark.parametrize("ppm", [None, 50.0])
def test_meetings_a_few_at_a_time(monkeypatch, ppm):
    rng = random.Random(4)
    texts = ["".join(rng.choice("AGNQ") for _ in range(rng.choice([3, 20, 90]))) for _ in range(9)]
    peptides = [t[2:12] for t in texts if len(t) > 12]
    block = pa.array([{"query": p, "sequence": p, "mass": sum(MASS[r] for r in p) / M.UNIT + M.WATER, "asked": [0, 3, 5]} for p in peptides])
    for one in (False, True):
        runs = []
        for count in (1, 7, 1 << 20):
            monkeypatch.setattr(M, "MEETINGS", count)
            found = M._meet(pa.array(texts), np.zeros(9, int), np.arange(9), block, 10, 5, "nearest", 2, ppm, one)
            runs.append(sorted(zip(*[c.tolist() for c in found], strict=True)))
        assert runs[0] == runs[1] == runs[2] and runs[0] and len(set(runs[0])) == len(runs[0])
