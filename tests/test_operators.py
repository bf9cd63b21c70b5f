import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.functions import sequence as S
from evidra.operators import compare, control, graph, lake, lineage, matching, network, quality, ranking, rollup, samples, study


def values(spark, items, expression, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x")).alias("v")).collect()]


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_fnv(spark):
    words = ["", "a", "foobar", "é漢", "x" * 200]
    assert [int(v) for v in values(spark, words, S.fnv1a64)] == [fnv(w.encode()) for w in words]


def test_sequence_functions(spark):
    assert values(spark, ["AC[+57.02]-IK", "P[x]EP"], S.canonical_peptide) == ["ACLK", "PEP"]
    assert values(spark, ["MSKAAAAAAAAAAAGELFT", "MSKA"], lambda x: S.has_poly_run(x, 10)) == [True, False]
    assert values(spark, ["A", "AAAA", "ACDEFGHIKLMNPQRSTVWY"], S.sequence_entropy) == pytest.approx([0.0, 0.0, 1.0])
    assert values(spark, ["AAAAAAAC", "ACACACACACAC", "ABABABABAB", "ACDEFGHIK"], S.is_low_complexity) == [True, True, True, False]
    assert values(spark, ["AB*C**", "acz"], lambda x: S.normalise_residues(x)) == [("AXXC", 2), ("ACX", 1)]
    assert values(spark, ["B; A ;B"], S.member_set_key) == ["A;B"]
    assert values(spark, ["MAKPEPTIDERWAYR", "GLAYERSEEK"], S.tryptic) == [["MAKPEPTIDER", "WAYR"], ["GLAYER", "SEEK"]]
    assert values(spark, ["AAAAAAKLLLLLLLR"], S.digest_folded) == [["AAAAAAK", "IIIIIIIR", "AAAAAAKIIIIIIIR"]]
    assert values(spark, ["G", "GX"], S.theoretical_mass) == [pytest.approx(75.03202), None]
    assert values(spark, ["0.5", "nan", "2", "x", None], lambda x: S.q_value(x.try_cast("double"))) == [0.5] + [math.inf] * 4
    assert values(spark, ["K00001,ko:K00002;x"], lambda x: S.function_terms(x, "KO")) == [["K00001", "K00002"]]
    assert values(spark, ["sp|P1|A_HUMAN", "MGYG001_2", "ZZ|9|MGYG7_1", "x"], S.species_of) == ["HUMAN", "MGYG001", "MGYG7", None]
    assert values(spark, ["abcdefg"], lambda x: S.wrap_fasta(F.lit("h"), x, 3)) == [">h\nabc\ndef\ng"]
    assert values(spark, ["abcdefg", ""], lambda x: S.windows(x, 3)) == [["abc", "def", "g"], []]
    assert values(spark, [["H1", "B"], ["B"], ["H1"], []], lambda x: S.classify_group(x, lambda m: m.startswith("H")), "array<string>") == ["Mixed", "Microbial", "Human", "Unknown"]


def test_abundance_rules(spark):
    df = spark.createDataFrame([("1.5",), ("",), ("NA",), (None,)], "x string")
    assert [r[0] for r in df.select(S.tpm("x")).collect()] == [1.5, None, None, None]
    with pytest.raises(Exception, match="not an abundance"):
        spark.createDataFrame([("-1",)], "x string").select(S.tpm("x")).collect()


def test_substring_join_overlaps_and_chunks(spark):
    rng = random.Random(2)
    seqs = [(i, "".join(rng.choice("AB") for _ in range(rng.choice([0, 3, 40, 700])))) for i in range(30)]
    pats = {"".join(rng.choice("AB") for _ in range(rng.choice([5, 6, 9]))) for _ in range(12)} | {"AAAAA"}
    got = matching.substring_join(spark.createDataFrame([(p,) for p in pats], "peptide string"), spark.createDataFrame(seqs, "protein int, sequence string"), seed=5)
    want = {(p, i, k) for p in pats for i, s in seqs for k in range(len(s)) if s.startswith(p, k)}
    rows = [(r.peptide, r.protein, r.position) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_mass_votes_find_an_isobaric_start(spark):
    target = "MKTAYIAKQRQISFVKSHFSRQ"
    query = target[5:16]
    mass = sum(S.RESIDUE_MASS[c] for c in query) + S.WATER
    queries = spark.createDataFrame([("q", query.replace("I", "L"), mass)], "query string, sequence string, mass double")
    targets = spark.createDataFrame([("t", target), ("u", "GGGGGGGGGGGGGGGG")], "target string, sequence string")
    row = matching.mass_vote_join(queries, targets).first()
    assert (row.target, row.start, row.length) == ("t", 5, len(query)) and row.error_ppm < 1


@pytest.mark.parametrize("seed", range(3))
def test_set_cover_rank_equals_global_greedy(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(40), rng.randrange(25)) for _ in range(60)})
    df = spark.createDataFrame(pairs, "peptide int, protein int")
    own, left, want = {}, {p for p, _ in pairs}, []
    for a, b in pairs:
        own.setdefault(b, set()).add(a)
    while left:
        best = min(own, key=lambda p: (-len(own[p] & left), p))
        want.append((best, len(own[best] & left)))
        left -= own[best]
    got = [(r.protein, r.gain) for r in graph.set_cover(df).orderBy("selection_rank").collect()]
    assert got == want
    first = {p: k for k, (p, _) in enumerate(want)}
    expect = {a: min((q for x, q in pairs if x == a and q in first), key=first.get) for a, _ in pairs}
    assert {r.peptide: r.protein for r in graph.dictionary(df, graph.set_cover(df)).collect()} == expect


def test_razor_greedy_prefers_the_assigned(spark):
    df = spark.createDataFrame([(1, "B"), (1, "A"), (2, "A"), (2, "B"), (3, "C")], "peptide int, protein string")
    assert sorted((r.peptide, r.protein) for r in graph.razor_greedy(df).collect()) == [(1, "A"), (2, "A"), (3, "C")]


def test_razor_greedy_equals_loop(spark):
    rng = random.Random(8)
    pairs = sorted({(rng.randrange(60), f"P{rng.randrange(25):02}") for _ in range(170)})
    degree, total, unique, assigned, want = Counter(p for p, _ in pairs), Counter(r for _, r in pairs), Counter(), Counter(), {}
    for p, r in pairs:
        unique[r] += degree[p] == 1
    for p in sorted(degree, key=lambda p: (-degree[p], p)):
        want[p] = min((r for q, r in pairs if q == p), key=lambda r: (-unique[r], -total[r], -assigned[r], r))
        assigned[want[p]] += 1
    got = graph.razor_greedy(spark.createDataFrame(pairs, "peptide int, protein string"))
    assert {r.peptide: r.protein for r in got.collect()} == want


def test_razor_ties_by_hash(spark):
    df = spark.createDataFrame([(1, "A"), (1, "B"), (1, "C")], "peptide int, protein string")
    assert graph.razor(df, "hash_acc").first().protein == min("ABC", key=lambda p: fnv(p.encode()))
    assert graph.razor(df).first().protein == "A"


@pytest.mark.parametrize("before", [False, True])
def test_expectation_equals_loop(spark, before):
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(12), rng.randrange(6)) for _ in range(30)})
    scores, lengths = {p: rng.random() for p, _ in pairs}, {q: rng.choice([30, 90, 300]) for _, q in pairs}
    own = {q: [p for p, x in pairs if x == q] for q in lengths}
    deg = {p: sum(1 for x, _ in pairs if x == p) for p in scores}
    norm = {q: max(n, 50) ** 0.5 for q, n in lengths.items()}

    def scale(a):
        return {q: v / max(a.values()) for q, v in a.items()}

    a = scale({q: sum(scores[p] / deg[p] for p in own[q]) / norm[q] for q in own})
    for _ in range(5):
        total = {p: sum(a[q] for x, q in pairs if x == p) for p in scores}
        a = scale({q: sum(scores[p] * a[q] / total[p] for p in own[q]) / norm[q] for q in own})
    got = graph.expectation(spark.createDataFrame(pairs, "peptide int, protein int"), spark.createDataFrame(list(scores.items()), "peptide int, score double"), spark.createDataFrame(list(lengths.items()), "protein int, length int"), rounds=5, threshold=0.0, delta_before=before)
    assert {r.protein: r.abundance for r in got.collect()} == pytest.approx(a)


def test_credit_budget(spark):
    df = spark.createDataFrame([(1, c) for c in "ABCD"] + [(2, "A")], "peptide int, protein string")
    scores = spark.createDataFrame([(1, 0.5), (2, 0.5)], "peptide int, score double")
    order = sorted("ABCD", key=lambda p: fnv(p.encode()))
    budget = math.ceil(4 * 0.5 * (18 - 6) / 24)
    got = {r.protein for r in graph.credit_budget(df, scores, F.lit(18)).collect()}
    assert got == set(order[:budget]) | {"A"}


def test_top_fraction_keeps_ties(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([5.0, 4.0, 4.0, 4.0, 1.0])], "s string, i int, v double")
    assert sorted(r.i for r in ranking.top_fraction(df, ["s"], "v", 0.4).collect()) == [0, 1, 2, 3]
    zero = spark.createDataFrame([("s", 0.0), ("s", 3.0), ("s", None)], "s string, v double")
    assert [r.v for r in ranking.top_percent_positive(zero, ["s"], "v", 1.0).collect()] == [3.0]


def test_matrices_and_corrections(spark):
    rows = spark.createDataFrame([("a", "g", 0.01, 5.0), ("a", "g", 0.5, 7.0), ("b", "g", 0.01, 0.0)], "s string, g string, q double, v double")
    assert [tuple(r) for r in study.group_matrix(rows, ["s", "g"], "q", 0.05, "v").collect()] == [("a", "g", 5.0)]
    p = [0.01, 0.04, 0.03, 0.04]
    got = sorted((r.p, r.adjusted) for r in study.step_up(spark.createDataFrame([(x,) for x in p], "p double"), "p").collect())
    assert [round(a, 6) for _, a in got] == [0.04, 0.04, 0.04, 0.04]


def test_rollups(spark):
    rows = spark.createDataFrame([("s", ["a", "b"], 4.0), ("s", ["a"], 1.0), ("s", [], 9.0)], "s string, t array<string>, v double")
    assert {r.term: r.amount for r in rollup.equal_split(rows, ["s"], "t", "v").collect()} == {"a": 3.0, "b": 2.0}
    tree = spark.createDataFrame([(["r", "x"], 2), (["r"], 1)], "l array<string>, w int")
    assert {r.path: (r["count"], r.self_count) for r in rollup.lineage_tree(tree, "l", "w").collect()} == {"r": (3, 1), "r/x": (2, 2)}


def test_error_control(spark):
    df = spark.createDataFrame([(8, 2), (0, 0)], "t int, e int")
    made = control.fdp(F.col("t"), F.col("e"))
    got = df.select(made["combined"], made["lower_bound"], made["sample"], control.verdict(made["combined"], 0.4)).collect()
    assert tuple(got[0]) == (0.4, 0.2, 0.25, "PASS") and tuple(got[1]) == (None, None, None, "UNDEFINED")
    assert tuple(df.select(*control.fdp(F.col("t"), F.col("e"), empty="zero").values()).collect()[1]) == (0.0, 0.0, 0.0)
    made = control.shuffle_keeping("AKCDRE", "x")
    assert made[1] == "K" and made[4] == "R" and sorted(made) == sorted("AKCDRE") and made == control.shuffle_keeping("AKCDRE", "x")


def test_comparison(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 4.0)], "k string, v double")
    b = spark.createDataFrame([("y", 8.0), ("z", 1.0)], "k string, v double")
    assert {r.k: r.status for r in compare.universe(a, b, spark.createDataFrame([("w",), ("x",), ("y",), ("z",)], "k string"), "k").collect()} == {"w": "neither", "x": "left_only", "y": "both", "z": "right_only"}
    assert tuple(compare.arm_metrics(a, b, "k", "v").first()) == (1, 1, 1, 1.0, 1.0)


def test_lake(spark):
    rows = spark.createDataFrame([("h", 1, "B", None, "hypothetical protein", "x", 9, 2, 1, False), ("h", 2, "A", "g", "a kinase", "y", 8, 1, 3, True)], "seq_hash string, priority int, accession string, gene string, description string, organism string, tax_id int, evidence int, version int, reviewed boolean")
    r = lake.merge_annotations(rows, "seq_hash").first()
    assert (r.accession, r.gene, r.description, r.organism, r.tax_ids, r.evidence, r.version, r.reviewed, r.n_sources) == ("B", "g", "a kinase", "ambiguous", [8, 9], 1, 3, True, 2)
    with pytest.raises(Exception, match="two sequences"):
        lake.consistent(spark.createDataFrame([("A", "X"), ("A", "Y")], "a string, s string"), "a", "s").collect()


def test_network_gate(spark):
    df = spark.createDataFrame([(1, 5), (9, 0), (0, 0)], "a int, b int")
    got = network.gate(df, {"b": F.col("b") > 1, "a": F.col("a") > 0}).collect()
    assert [(r.a, r.passed) for r in got] == [(1, ["a", "b"]), (9, ["a"])]


def test_results_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(list(itertools.product(range(30), range(7))), "peptide int, protein int").where("(peptide * 7 + protein) % 3 = 0")
    once = sorted(map(tuple, graph.razor(df).collect()))
    assert once == sorted(map(tuple, graph.razor(df.repartition(9)).collect()))


def written(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_header_ladder_is_written_once(spark):
    """Nested patterns stand in the plan once, so that it does not grow to megabytes."""
    df = spark.createDataFrame([("sp|P1|A_HUMAN Alpha OS=Homo sapiens GN=AA1",)], "h string")
    assert len(written(df.select(S.ladder_fields("h").alias("f")))) < 50_000


def test_digest_splits_once(spark):
    df = spark.createDataFrame([("AAAKCCCRGGGK",), ("K",), ("",), (None,)], "s string")
    made = df.select(S.digest_folded("s", 1).alias("d"))
    assert written(made).count("split(") == 1
    assert [r.d for r in made.collect()] == [["AAAK", "CCCR", "GGGK", "AAAKCCCR", "CCCRGGGK"], ["K"], [], None]


def test_fnv_in_longs(spark):
    texts = ["", "abc", "\u00e9\0x\u6f22", "\U0001d11ez", "12345"]
    made = spark.createDataFrame([(t,) for t in texts], "s string").select("s", S.fnv1a64("s").alias("h"))
    assert "decimal(38" not in written(made)

    def fnv(data):
        h = 14695981039346656037
        for b in data:
            h = (h ^ b) * 1099511628211 % (1 << 64)
        return h

    assert {r.s: int(r.h) for r in made.collect()} == {t: fnv(t.encode()) for t in texts}


def test_windows_in_one_pass(spark):
    """Windows don't count from the start of the text again; entropy is formed once for its test and its detail."""
    df = spark.createDataFrame([("ABCDEFG",), ("AB\nD",), ("\U0001d11ezab",), ("",), (None,)], "s string")
    made = df.select(S.windows("s", 3).alias("w"))
    assert "substring" not in written(made)
    assert [r.w for r in made.collect()] == [["ABC", "DEF", "G"], ["AB\n", "D"], ["\U0001d11eza", "b"], [], []]
    kept = quality.filtered(df.withColumnRenamed("s", "sequence"), quality.Filters(entropy=0.5))
    assert written(kept).count("LOG2") <= 2 and kept.count() == 5


def test_gene_quantities_in_tasks_of_bounded_size(spark, monkeypatch):
    """The number of tasks follows the rows; a frequent gene and nulls are summed as by a plain grouping."""
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(2)}", rng.choice([None, *range(90)]), rng.choice([None, "G", "G", "G", f"g{rng.randrange(40)}"]), rng.choice([None, 1.0, 2.0, 7.0])) for _ in range(400)]
    best, want = {}, {}
    for s, p, g, v in rows:
        best[s, p, g] = max((x for x in (v, best.get((s, p, g))) if x is not None), default=None)
    for (s, _, g), v in best.items():
        n, total = want.get((s, g), (0, None))
        want[s, g] = n + 1, total if v is None else v + (total or 0)
    monkeypatch.setattr(samples, "parts", lambda df: lineage.parts(df, 50))
    got = samples.gene_quantities(spark.createDataFrame(rows, "s string, p int, g string, v double"), "s", "p", "g", "v")
    assert {(r.s, r.g): (r.n_peptides, r.quantity) for r in got.collect()} == want
    assert got.rdd.getNumPartitions() == 8
