"""Studies, covers, abundances, genes, refinement and taxonomy against plain Python."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.operators import compare, contaminants, control, genes, graph, network, refine, rollup, study, taxonomy
from evidra.plans import study_queries
from evidra.functions import sequence as S


def greedy(edges):
    own = collections.defaultdict(set)
    for peptide, protein in edges:
        own[protein].add(peptide)
    left, out = {p for p, _ in edges}, []
    while left:
        gain, name = min((-len(s & left), p) for p, s in own.items())
        out.append((name, -gain))
        left -= own[name]
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [0, 25, 1_000_000])
def test_set_cover_in_rounds_equals_the_sequential_one(spark, seed, limit):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(40), f"p{rng.randrange(25)}") for _ in range(110)})
    got = graph.set_cover(spark.createDataFrame(edges, "peptide int, protein string"), limit).orderBy("selection_rank").collect()
    assert [(r.protein, r.gain) for r in got] == greedy(edges) and [r.selection_rank for r in got] == list(range(1, len(got) + 1))


def test_study_composition(spark):
    rng = random.Random(3)
    psms, features = [], []
    for s in ("a", "b"):
        for k in range(60):
            peptide = "".join(rng.choice("ACDIL") for _ in range(3))
            proteins = sorted({f"P{rng.randrange(9)}" for _ in range(rng.randint(1, 3))}) + (["rev_P1"] if k % 7 == 0 else [])
            psms.append((s, f"[+1]-{peptide[0]}[x]{peptide[1:]}" if k % 3 == 0 else peptide, proteins, 1 if k % 5 else -1, 1 + (k % 11 == 0), rng.choice([0.001, 0.01, 0.02, float("nan")])))
        for k in range(80):
            peptide = "".join(rng.choice("ACDIL") for _ in range(3))
            features.append((s, f"{peptide}[{k}]", k % 4, [f"P{rng.randrange(9)}"], rng.choice([0.0, 1.5, 2.5, float("inf"), -1.0])))
    searched = [(s, f"P{i}") for s in ("a", "b") for i in range(9) if (s, i) != ("b", 0)]
    p = spark.createDataFrame(psms, "sample string, peptide string, proteins array<string>, label int, rank int, peptide_q double")
    f = spark.createDataFrame(features, "sample string, peptide string, charge int, proteins array<string>, intensity double")
    found = study.compose(p, f, spark.createDataFrame(searched, "sample string, protein string"))
    bare = lambda x: __import__("re").sub(r"\[[^\]]*\]", "", x).replace("-", "").replace("I", "L")
    evidence = {(s, bare(x), y) for s, x, ys, label, rank, q in psms if label == 1 and rank == 1 and q <= 0.01 for y in ys if not y.startswith("rev_")}
    edges = sorted({(x, y) for _, x, y in evidence})
    cover = greedy(edges)
    owner = {}
    for name, _ in cover:
        for x in sorted(x for x, y in edges if y == name):
            owner.setdefault(x, name)
    sizes = collections.Counter(owner.values())
    assert sorted(map(tuple, found["study_groups"].collect())) == sorted((n, i, sum(y == n for _, y in edges), sizes[n]) for i, (n, _) in enumerate(cover))
    assert {r.peptide: r.protein for r in found["dictionary"].collect()} == owner
    gates = {(s, x) for s, x, _ in evidence}
    rows = [(s, bare(x), z, v) for s, x, _, z, v in features if (s, bare(x)) in gates and 0 < v < math.inf]
    want = sorted((s, x, owner[x], (s, owner[x]) in set(searched), owner[x] in z, v) for s, x, z, v in rows)
    assert sorted((r["sample"], r.canonical, r.study_group, r.in_local_fasta, r.in_local_members, r.intensity) for r in found["ledger"].collect()) == want
    total = found["balance"].first()
    assert total.intensity_in == total.intensity_out == sum(r[-1] for r in rows)
    assert sum(r.lfq_features for r in found["acquisitions"].collect()) == len(rows)
    with pytest.raises(Exception, match="outside the searched"):
        study.compose(p, f, spark.createDataFrame([("a", "P1")], "sample string, protein string"))
    twice = spark.createDataFrame([("a", "X", 1, ["P1"], 1.0)] * 2, f.schema)
    with pytest.raises(Exception, match="duplicate feature"):
        study.unique_features(twice).collect()


def test_lake_expectation_equals_loop(spark):
    rng = random.Random(5)
    edges = sorted({(f"e{rng.randrange(20)}", f"p{rng.randrange(8)}") for _ in range(40)})
    sightings = sorted({(f"s{rng.randrange(3)}", e): rng.random() for e, _ in edges for _ in range(2)}.items())
    sightings = [(s, e, v) for (s, e), v in sightings]
    lengths = {f"p{i}": 20 * i for i in range(8)}
    to, by = collections.defaultdict(set), collections.defaultdict(set)
    for e, p in edges:
        to[e].add(p)
        by[p].add(e)
    best, seen = {}, collections.defaultdict(set)
    for s, e, v in sightings:
        best[e] = max(best.get(e, 0), v)
        seen[e].add(s)
    norm = {p: math.sqrt(len(set().union(*(seen[e] for e in own)))) / math.sqrt(max(lengths[p], 50)) for p, own in by.items()}
    share = lambda d: {p: v / sum(d.values()) for p, v in d.items()}
    a = share({p: sum(best[e] / len(to[e]) for e in own) * norm[p] for p, own in by.items()})
    for _ in range(10):
        new = collections.defaultdict(float)
        for e, own in to.items():
            for p in own:
                new[p] += best[e] * math.sqrt(len(seen[e])) if len(own) == 1 else best[e] * a[p] / sum(a[q] for q in own)
        a = share({p: v * norm[p] for p, v in new.items()})
    got = graph.lake_expectation(spark.createDataFrame(edges, "peptide string, protein string"), spark.createDataFrame(sightings, "sample string, peptide string, score double"), spark.createDataFrame(list(lengths.items()), "protein string, length int"))
    assert {r.protein: r.abundance for r in got.collect()} == pytest.approx({p: v / max(a.values()) for p, v in a.items()})


def test_ranks_by_range(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0.001, 0.01, 0.02, 0.2, 0.9, 1.0]) * rng.choice([1, 0.5])) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, p double").repartition(5)
    order, n, least, want = sorted(v for _, v in rows), len(rows), 1.0, {}
    for k in range(n, 0, -1):
        least = min(least, order[k - 1] * n / k)
        want[order[k - 1]] = min(want.get(order[k - 1], 1.0), least)
    assert {r.i: r.adjusted for r in study.step_up(df, "p").collect()} == pytest.approx({i: want[v] for i, v in rows})
    ranks = {v: sum(u < v for _, u in rows) + (sum(u == v for _, u in rows) + 1) / 2 for _, v in rows}
    assert {r.i: r.r for r in compare.average_rank(df, "p", "r").collect()} == {i: ranks[v] for i, v in rows}


CANONICAL = [
    ("a1", "sp|P1|A_HUMAN Alpha protein OS=x GN=AAA PE=1", "MAAAAAAK" + "CCCCCCCR" + "DDDDDDDK" + "EEEEEEEK"),
    ("b1", "sp|P2|B_HUMAN Beta (Fragment) OS=x GN=BBB PE=1", "FFFFFFFK" + "GGGGGGGR" + "EEEEEEEK"),
    ("c1", "sp|Q8IZF2|C_HUMAN Gamma OS=x GN=Q8IZF2", "HHHHHHHK"),
]


def test_genes_by_votes(spark):
    records = [
        ("t1", "tr|T1|T1_X Thing GN=A0A024CIM4", "MAAAAAAK" + "CCCCCCCR"), ("t2", "tr|T2|T2_X Other", "DDDDDDDK" + "FFFFFFFK"), ("t3", "tr|T3|T3_X Ig heavy chain V", "NNNNNNNK"),
        ("t4", "tr|T4|T4_X beta OS=x", "PPPPPPPK"), ("t5", "tr|T5|T5_X new GN=REAL1", "QQQQQQQK"), ("t6", "tr|T6|T6_X new GN=P02768", "SSSSSSSK"), ("ens1", "ens|E1_A|AAA x", "MAAAAAAK"), ("t7", "tr|T7|T7_X iso", "MAAAAAAK" + "CCCCCCCR" + "YYYYYYYK"),
    ]
    kind = "accession string, header string, sequence string"
    canonical, own = spark.createDataFrame(CANONICAL, kind), spark.createDataFrame(records, kind)
    got = {r.accession: (r.gene, r.method) for r in genes.assigned(own, canonical).collect()}
    assert got == {
        "t1": ("AAA", "peptide_vote"), "t2": ("AAA", "peptide_vote_ambiguous"), "t3": (None, "ig_repertoire"), "t4": ("BBB", "name_match"), "t5": ("REAL1", "kept_existing"), "t6": (None, "unmapped"),
        "ens1": ("AAA", "peptide_vote"), "t7": ("AAA", "peptide_vote"),
    }
    healed = {r.accession: r.header for r in genes.healed(own, canonical).collect()}
    assert healed["t1"] == "tr|T1|T1_X Thing GN=AAA" and healed["t2"] == "tr|T2|T2_X Other GN=AAA" and healed["t6"].endswith("GN=P02768")
    tier = {r.sequence: r["class"] for r in genes.smart_tier(canonical, own).collect()}
    assert tier == {s: "canonical" for _, _, s in CANONICAL} | {records[1][2]: "smart_isoform", records[2][2]: "ig_repertoire", records[3][2]: "smart_isoform", records[4][2]: "smart_isoform", records[6][2]: "variant", records[7][2]: "smart_isoform"}


def test_header_ladder(spark):
    df = spark.createDataFrame(list(enumerate(study_queries.HEADERS)), "i int, h string")
    got = [tuple(r.f) for r in df.orderBy("i").select(S.ladder_fields("h").alias("f")).collect()]
    assert got == study_queries.FIELDS


def test_refinement(spark):
    proteins = spark.createDataFrame([("p1", "MKPEPTLDEAA"), ("p2", "GGG"), ("p3", "AIAC")], "protein string, sequence string")
    found = spark.createDataFrame([("PEPTIDE", "p1"), ("GGG", "p2"), ("XYZ", "p3")], "peptide string, protein string")
    got = {r.protein: (r.sequence, r.changed, r.notation, r.score) for r in refine.proposals(proteins, found, refine.confusions(spark)).collect()}
    assert got == {"p1__VAR": ("MKPEPTIDEAA", True, "L7I", 10), "p2__VAR": ("AGG", True, "G1A", 2), "p3": ("AIAC", False, None, None)}
    options = {r.residue: [(o.target, o.score) for o in r.options] for r in refine.substitutions(refine.confusions(spark)).collect()}
    assert options["A"] == [("G", 2), ("W", 2), ("S", 1)] and options["W"] == [("A", 2), ("D", 2)] and "C" not in options
    psms = spark.createDataFrame([("AC[x]DE", "p;q", 0.01, 2, 5.0), ("AC[x]DE", "r", 0.01, 2, 7.0), ("ACDEF", "p", 0.5, 0, 9.0), ("ACDEFG", "p", 0.0, 9, 9.0)], "peptide string, proteins string, spectrum_q double, matched_peaks int, hyperscore double")
    assert [(r.peptide, r.protein, r.ics, r.hyperscore) for r in refine.candidates(psms, tie="proteins").collect()] == [("ACDE", "r", pytest.approx(2 / 6), 7.0)]


def test_contaminants(spark):
    ids = ["sp|P00761|TRYP_BOVIN", "CON_X", "rev_P02769", "P04264", "P04265", "tr|Q1|x", None]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r.id: r.contaminant for r in contaminants.marked(df, "id", contaminants.table(spark)).collect()}
    assert got == dict(zip(ids, [True, True, True, True, False, False, False]))
    assert {r.id for r in contaminants.tagged(df, "id", contaminants.table(spark)).collect()} == {"CON_sp|P00761|TRYP_BOVIN", "CON_X", "CON_rev_P02769", "CON_P04264", "P04265", "tr|Q1|x", None}
    psms = spark.createDataFrame([("P00761,X",), ("X;P00761",), (None,)], "proteins string")
    assert {r.proteins for r in contaminants.excluded(psms, contaminants.table(spark)).collect()} == {"X;P00761", None}


def test_undefined_estimates_are_null(spark):
    df = spark.createDataFrame([(0, 0, 0), (2, 8, 1)], "n_entrap int, n_target int, n_shared int")
    a, b = control.fdp_report(df, 100, 50).orderBy("n_entrap").collect()
    assert a.lower_bound is None and a.verdict == "UNDEFINED" and b.lower_bound == 0.2 and b.combined_upper == pytest.approx(0.6) and b.elias_gygi == pytest.approx(0.4) and b.size_scaled == pytest.approx(4 / 12)
    assert control.fdp_report(df, 100, 0).orderBy("n_entrap").collect()[1].elias_gygi is None


def test_diversity_of_an_empty_sample(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 0.0)], "s string, f string, v double")
    got = {r.s: r for r in rollup.diversity(df, "s", "v").collect()}
    assert got["a"].simpson == pytest.approx(10 / 16) and got["a"].richness == 2.0 and all(math.isnan(x) for x in got["b"][1:])


def test_trees_conserve_weights(spark):
    node = "array<struct<id: bigint, name: string>>"
    rows = [("a", [(2, "B"), (5, "C")], "assigned", 2.0), ("b", [(2, "B")], "assigned", 1.0), ("c", [], "unresolved", 4.0), ("d", [(2, "B"), (6, "D")], "assigned", 0.0)]
    got = {r.path: (r.depth, r.name, r["count"], r.self_count) for r in taxonomy.tree(spark.createDataFrame(rows, f"peptide string, lineage {node}, status string, weight double")).collect()}
    assert got == {"": (0, None, 7.0, 0.0), "2": (1, "B", 3.0, 1.0), "2/5": (2, "C", 2.0, 2.0), "?unresolved": (1, "unresolved", 4.0, 4.0)}


def test_bounded_view(spark):
    edges = [(f"e{i}", f"p{j}", i == j) for i in range(6) for j in range(6) if (i + j) % 3 == 0]
    degree = collections.Counter(e for e, _, _ in edges)
    for nodes, most in ((4, 10), (7, 5), (100, 100)):
        seen, chosen = set(), []
        for e, p, a in sorted(edges, key=lambda x: (-degree[x[0]], x[0], not x[2], x[1])):
            if len(chosen) < most and len(seen | {e, p}) <= nodes:
                seen |= {e, p}
                chosen.append((e, p))
        got = network.view(spark.createDataFrame(edges, "peptide string, protein string, assigned boolean"), spark.createDataFrame(list(degree.items()), "peptide string, degree int"), nodes, most)
        assert sorted((r.peptide, r.protein) for r in got.collect()) == sorted(chosen)


def test_symbols_and_sentinels(spark):
    words = ["ALB", "MGYG000000001_00001", "P02768", "A0A024CIM4", "C3", "sp|P1|X", "ENSG0001", "x" * 21, "", None]
    df = spark.createDataFrame(list(enumerate(words)), "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(S.is_gene_symbol("x")).collect()] == [True, True, False, False, True, False, False, False, False, False]
    cell = spark.createDataFrame([("a; --,a,NA;null,b",)], "x string")
    assert cell.select(S.functional_values("x").alias("v")).first().v == ["a", "a", "b"]
    assert cell.select(F.transform(F.array(*[F.lit(x) for x in ("sp|a", "MGYG1", "GMGC1", "MuPr_Assembly_1", "q")]), lambda x: S.catalogue(x)).alias("v")).first().v == ["Human", "UHGG", "GMGC", "Assembly", "smORF"]


def test_values_formed_anew_keep_their_rows(spark):
    """A value that comes out differently each time it is formed, as sums of floats over a shuffle can, loses no row."""
    noise = F.udf(lambda i: random.random(), "double").asNondeterministic()
    df = spark.range(200, numPartitions=4).select("id", noise("id").alias("p"), noise("id").alias("y"))
    assert study.step_up(df, "p").count() == 200
    assert compare.spearman(df, "p", "y").first().n == 200


def test_distances_by_tiles(spark, monkeypatch):
    """Every pair of samples once, across tiles and within them; no shuffle carries a row for each pair."""
    rng = random.Random(9)
    v = {(s, f): rng.uniform(0, 5) for s in "abcdefghijk" for f in "wxyz" if rng.random() < 0.6}
    v |= {("n", "w"): 0.0, ("m", "w"): 0.0}
    monkeypatch.setattr(rollup, "TILE", 3)
    monkeypatch.setattr(rollup, "SIDE", 2)
    made = rollup.bray_curtis(spark.createDataFrame([(*k, x) for k, x in v.items()], "s string, f string, v double"), "s", "f", "v")
    above, below = made._jdf.queryExecution().executedPlan().toString().split("CartesianProduct", 1)
    assert "Exchange" not in above and "Exchange" in below
    got = {(r.sample_a, r.sample_b): r.distance for r in made.collect()}
    total, names = collections.Counter(), sorted({s for s, _ in v})
    for (s, _), x in v.items():
        total[s] += x
    want = {}
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            both = sum(min(v[a, f], v[b, f]) for f in "wxyz" if (a, f) in v and (b, f) in v)
            want[a, b] = 1 - 2 * both / (total[a] + total[b]) if total[a] + total[b] else None
    assert len(got) == len(want) and {k: x if x is None else round(x, 9) for k, x in got.items()} == {k: x if x is None else round(x, 9) for k, x in want.items()}


def test_cover_of_components(spark):
    """Components within the limit are covered on their own, without a round over all edges; larger ones as before."""
    rng = random.Random(4)
    edges = [(f"e{c}-{rng.randrange(12)}", f"p{c}-{rng.randrange(9)}") for c in range(25) for _ in range(30)]
    edges += [(f"big{rng.randrange(60)}", f"q{rng.randrange(20)}") for _ in range(150)]
    edges = sorted(set(edges))
    df = spark.createDataFrame(edges, "peptide string, protein string")
    for limit in (60, 40, 10_000):
        got = graph.set_cover(df, limit).orderBy("selection_rank").collect()
        assert [r.protein for r in got] == [p for p, _ in greedy(edges)], limit
    made = graph.linked(df, 40).collect()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for e, p in edges:
        parent[find(e)] = find(p)
    roots = collections.defaultdict(set)
    for r in made:
        roots[find(r.protein)].add(r.component)
    assert len(made) == len(edges) and all(len(v) == 1 for v in roots.values()) and len(set().union(*roots.values())) == len(roots)


def test_cover_of_a_chain_takes_few_rounds(spark, monkeypatch):
    """Each protein waits for the one before it; a window settles many of them, so that rounds are few."""
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df, f=graph.cut: cuts.append(1) or f(df))
    edges = [(i + k, i) for i in range(160) for k in (0, 1)]
    got = graph.set_cover(spark.createDataFrame(edges, "peptide int, protein int"), 10).orderBy("selection_rank").collect()
    assert [(r.protein, r.gain) for r in got] == greedy(edges) and len(cuts) < 60


def test_dictionary_of_a_chain_takes_few_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df, f=graph.cut: cuts.append(1) or f(df))
    edges = [(f"e{i + k}", f"p{i:03d}") for i in range(120) for k in (0, 1)]
    df = spark.createDataFrame(edges, "peptide string, protein string")
    owner = {}
    for name, _ in greedy(edges):
        for x, y in edges:
            if y == name:
                owner.setdefault(x, name)
    assert {r.peptide: r.protein for r in graph.dictionary(df, graph.set_cover(df, 10)).collect()} == owner and len(cuts) < 60


def test_cover_by_windows_of_any_names(spark):
    """Several windows, parts of a level among them; names that are no small numbers, repeated rows, rows without a key."""
    rng = random.Random(8)
    pairs = [(f"e{rng.randrange(70)}", rng.randrange(-30, 30)) for _ in range(240)]
    for name in (lambda x: x, lambda x: f"é{x}"):
        edges = [(e, name(p)) for e, p in pairs]
        kind = "int" if name(1) == 1 else "string"
        df = spark.createDataFrame([*edges, *edges[:40], ("e1", None), (None, name(3))], f"peptide string, protein {kind}")
        assert [(r.protein, r.gain) for r in graph.set_cover(df, 8).orderBy("selection_rank").collect()] == greedy(edges)
    assert graph.set_cover(df.where("protein is null"), 0).count() == 0


@pytest.mark.parametrize("most", [0, 1 << 40])
def test_choices_of_a_window(most):
    """All steps at once and the heap select what the whole greedy cover selects before it leaves the window."""
    rng = random.Random(5)
    for _ in range(40):
        edges = sorted({(rng.randrange(30), rng.randrange(20)) for _ in range(rng.randrange(1, 120))})
        gains = collections.Counter(p for _, p in edges)
        order = sorted(gains, key=lambda p: (-gains[p], p))
        size = rng.randint(1, len(order))
        window, after = sorted(order[:size]), order[size] if size < len(order) else None
        least, bound = (gains[after], sum(p < after for p in window)) if after is not None else (0, 0)
        held = [(e, [window.index(p) for x, p in edges if x == e and p in window]) for e in sorted({e for e, _ in edges})]
        shared = [(e, p) for e, ps in held if len(ps) > 1 for p in ps]
        row, member = (np.array([x[k] for x in shared], np.int32) for k in (0, 1))
        places, found = graph._choose(np.array([gains[p] for p in window]), row, member, least, bound, most)
        got = sorted(zip((-found).tolist(), [window[k] for k in places], strict=True))
        want = [(-g, p) for p, g in greedy(edges)]
        assert got == want[: len(got)]
        assert len(got) == len(want) or after is not None and want[len(got)] >= (-least, after)


def test_rounds_move_no_edges(spark):
    """Edges are dealt out over blocks once; a round shuffles abundances and partial sums only."""
    edges = spark.createDataFrame([(i, i * 7 % 10) for i in range(40)], "peptide int, protein int")
    blocks, held = graph._dealt_out(edges, edges.select("peptide", F.lit(1.0).alias("score")), 8)
    now = edges.select("protein").distinct().withColumn("a", F.lit(1.0))
    made = graph._sums(blocks, held, now, lambda c, a, total: c["score"] * a / total, lambda c, a, total: total > 0)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(block") == 1
    assert sum(r.b for r in made.collect()) == pytest.approx(40)
