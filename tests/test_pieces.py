"""Pieces with a ledger, sampled controls, sorted files, lineages and search arms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evidra.operators import arms, graph, matching, pieces, sampling
from evidra.sources import readers, sinks


def test_pieces_equal_the_whole_and_go_on_after_a_failure(spark, tmp_path):
    rng = random.Random(1)
    texts = spark.createDataFrame([(i, "".join(rng.choice("ACDE") for _ in range(60))) for i in range(40)], "protein int, sequence string")
    patterns = spark.createDataFrame([("".join(rng.choice("ACDE") for _ in range(4)),) for _ in range(60)], "peptide string").distinct()
    calls = []

    def step(part):
        calls.append(1)
        if len(calls) == 4:  # the schema, two pieces, then a lost one
            raise RuntimeError("killed")
        return matching.substring_join(patterns, part, seed=4)

    path = f"file://{tmp_path}/run"
    with pytest.raises(RuntimeError):
        pieces.run(spark, path, texts, "protein", step, patterns, 5)
    assert sorted(pieces.ledger(spark, path)) == [0, 1]
    # the killed piece has left rows behind
    spark.createDataFrame([("X", 1, 1)], "peptide string, protein int, position int").write.parquet(f"{path}/pieces/000002")
    got, summary = pieces.run(spark, path, texts, "protein", step, patterns, 5)
    whole = matching.substring_join(patterns, texts, seed=4)
    assert sorted(got.select(*whole.columns).collect()) == sorted(whole.collect()) and summary.records == 40 and summary.rows == whole.count()
    assert len(calls) == 4 + 1 + 3  # pieces with a receipt are not done again
    edges = whole.select("peptide", "protein").distinct()
    assert sorted(graph.razor(got.select("peptide", "protein").distinct()).collect()) == sorted(graph.razor(edges).collect())
    with pytest.raises(ValueError, match="another run"):
        pieces.run(spark, path, texts, "protein", step, patterns, 4)
    with pytest.raises(ValueError, match="another run"):
        pieces.run(spark, path, texts, "protein", step, patterns.where("peptide > 'B'"), 5)
    with pytest.raises(ValueError, match="add up"):
        pieces.run(spark, path, texts.where("protein > 3"), "protein", step, patterns, 5)


def test_inputs_that_change_are_noticed(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("x\ny\n")
    (source / "b.txt").write_text("z\n")
    before = spark.createDataFrame(pieces.fingerprints(spark, f"file://{source}").collect())
    pieces.unchanged(spark, f"file://{source}", before)
    lines = spark.read.text(f"file://{source}")

    def step(part):
        if (source / "b.txt").read_text() == "z\n" and part.schema and step.armed:
            (source / "b.txt").write_text("q\n")
        return part

    step.armed = False
    got, _ = pieces.run(spark, f"file://{tmp_path}/one", lines, "value", step, lines.limit(0), 2, inputs=f"file://{source}")
    assert got.count() == 3
    step.armed = True
    with pytest.raises(ValueError):
        pieces.run(spark, f"file://{tmp_path}/two", lines, "value", step, lines.limit(0), 2, inputs=f"file://{source}")
    with pytest.raises(ValueError, match="b.txt"):
        pieces.unchanged(spark, f"file://{source}", before)


def sequential(total, count, seed):
    """The generator run through all places."""
    state, places = seed, list(range(total))
    for i in range(min(count, total)):
        state = sampling.step(state)
        j = i + state % (total - i)
        places[i], places[j] = places[j], places[i]
    return places[: min(count, total)], state


@pytest.mark.parametrize(("total", "count", "seed"), [(10, 10, 1), (1000, 7, 42), (5, 9, (1 << 64) - 1), (300, 299, 12345)])
def test_sparse_shuffle_equals_the_sequential_one(total, count, seed):
    assert sampling.partial_shuffle(total, count, seed) == sequential(total, count, seed)
    with pytest.raises(ValueError):
        sampling.partial_shuffle(total, count, 0)


def test_jumps_equal_steps():
    jumps, state = sampling.Jumps(), 987654321
    for k in range(300):
        assert jumps.ahead(987654321, k) == state
        state = sampling.step(state)


def test_shuffled_sample_equals_one_generator(spark):
    rng = random.Random(3)
    rows = [(f"p{i:03}", "".join(rng.choice("ACDEFG") for _ in range(rng.choice([0, 1, 2, 30])))) for i in range(50)] + [("p900", None)]
    df = spark.createDataFrame(rows, "accession string, sequence string").repartition(5)
    got = {r.control: (r.accession, r.sequence) for r in sampling.shuffled_sample(df, ["accession"], 20, 77).collect()}
    places, state = sequential(51, 20, 77)
    for draw, place in enumerate(places):
        name, letters = rows[place][0], list(rows[place][1] or "")
        for i in range(len(letters) - 1, 0, -1):
            state = sampling.step(state)
            j = state % (i + 1)
            letters[i], letters[j] = letters[j], letters[i]
        assert got[f"ENTRAP_SHUFFLED_{draw:05}"] == (name, "".join(letters))
    assert len(got) == 20


def test_controls_with_matches(spark):
    controls = spark.createDataFrame([("c1", "MKLLIAVGAAAAAAAAAA"), ("c2", "GGGG"), ("c3", "")], "control string, sequence string")
    patterns = spark.createDataFrame([("KIILAVGA",), ("AAAAAAAA",)], "peptide string")
    row, = sampling.control_rate(patterns, controls).collect()
    assert (row.n_controls, row.n_matched, row.n_hits, row.rate) == (2, 1, 4, 0.5)
    with pytest.raises(Exception, match="no control"):
        sampling.control_rate(patterns, controls.where("control = 'c3'")).collect()


def test_sorted_fasta_and_its_index(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"T{rng.random():.9f}", f"é name {i}", "".join(rng.choice("ACDEFG") for _ in range(rng.choice([0, 1, 60, 61, 130])))) for i in range(200)]
    df = spark.createDataFrame(rows, "accession string, name string, sequence string").withColumn("header", F.concat_ws(" ", "accession", "name")).repartition(7)
    index = sinks.write_sorted_fasta(df, f"file://{tmp_path}/out", header="header").collect()
    want = {a: f">{a} {n}\n" + "".join(s[k : k + 60] + "\n" for k in range(0, max(1, len(s)), 60)) for a, n, s in rows}
    files = {p.name: b"".join(f.read_bytes() for f in sorted(p.glob("part-*"))) for p in (tmp_path / "out" / "parts").iterdir() if p.is_dir()}
    assert {r.accession: files[r.part][r.offset : r.offset + r.bytes].decode() for r in index} == want
    ranges = sorted(files, key=lambda n: int(n.split("=")[1]))
    assert b"".join(files[n] for n in ranges).decode() == "".join(want[a] for a in sorted(want))
    assert {(r.accession, r.sequence) for r in readers.fasta(spark, f"file://{tmp_path}/out/parts").collect()} == {(a, s) for a, _, s in rows if s}
    twice = df.unionByName(df.limit(1))
    with pytest.raises(ValueError, match="not unique"):
        sinks.write_sorted_fasta(twice, f"file://{tmp_path}/twice")
    assert sinks.write_sorted_fasta(twice, f"file://{tmp_path}/allowed", allow_duplicates=True).count() == 201
    with pytest.raises(ValueError, match="no records"):
        sinks.write_sorted_fasta(df.limit(0), f"file://{tmp_path}/none")


def answer(peptide, taxon, rank, cutoff=False, **lineage):
    row = {"peptide": peptide, "taxon_id": taxon, "taxon_name": "T", "taxon_rank": rank, "genus_id": None, "species_id": None, "phylum_id": None, "superkingdom_id": None, "superkingdom_name": None, "phylum_name": None, "genus_name": None}
    row |= {f"{k}_id": v for k, v in lineage.items()} | {f"{k}_name": f"n{v}" for k, v in lineage.items()}
    return row | ({} if cutoff is None else {"cutoff_used": cutoff})


def read_answers(spark, tmp_path, rows, asked):
    path = tmp_path / f"a{random.random()}.json"
    path.write_text(json.dumps(rows))
    return {r.peptide: (r.status, r.taxon_id, [(e.id, e["name"], e["rank"]) for e in r.lineage]) for r in readers.lineage_answers(spark, f"file://{path}", spark.createDataFrame([(p,) for p in asked], "peptide string")).collect()}


def test_lineages_of_answers(spark, tmp_path):
    rows = [answer("AAIK", 7, "genus", superkingdom=2, phylum=5, genus=7), answer("CCK", 5, "phylum", True, superkingdom=2, phylum=5), answer("DDK", 99, "clade", superkingdom=2), answer("EEK", 1, "no rank"), answer("FFK", None, None), answer("HHK", 2, "superkingdom", None, superkingdom=2)]
    got = read_answers(spark, tmp_path, rows, ["AALK", "CCK", "DDK", "EEK", "FFK", "GGK", "HHK"])
    assert got == {
        "AALK": ("assigned", 7, [(2, "n2", "domain"), (5, "n5", "phylum"), (7, "n7", "genus")]),
        "CCK": ("lookup_cutoff", 5, [(2, "n2", "domain"), (5, "n5", "phylum")]),
        "DDK": ("assigned", 99, [(2, "n2", "domain"), (99, "T", "clade")]),
        "EEK": ("unresolved", 1, []),
        "FFK": ("unresolved", None, []),
        "GGK": ("not_returned", None, []),
        "HHK": ("cutoff_not_reported", 2, [(2, "n2", "domain")]),
    }


@pytest.mark.parametrize(
    ("rows", "message"),
    [
        ([answer("AAK", 5, "phylum", superkingdom=2, phylum=5, genus=7)], "descendants"),
        ([answer("AAK", 2, "clade", superkingdom=2, phylum=5)], "descendants"),
        ([answer("AAK", 6, "phylum", superkingdom=2, phylum=5)], "differs"),
        ([answer("AAK", 5, "phylum", phylum=5), answer("AAK", 5, "phylum", phylum=5)], "twice"),
        ([answer("XX1", 5, "phylum", phylum=5)], "plain"),
        ([answer("CCK", 5, "phylum", phylum=5)], "asked"),
        ([answer("AAK", 5.5, "phylum", phylum=5.5)], "whole number"),
        ([answer("AAK", 5, "phylum", "maybe", phylum=5)], "flag"),
        ([answer("AAK", 5, "phylum", phylum=5) | {"phylum_name": ""}], "no name"),
    ],
)
def test_lineages_that_contradict(spark, tmp_path, rows, message):
    with pytest.raises(Exception, match=message):
        read_answers(spark, tmp_path, rows, ["AAK"])


def arm(spark, psms, features=(), records=None, **options):
    records = records or [("P1", "MAIKCCK"), ("P2", "MALKCCK"), ("P3", "DDKAIK"), ("rev_P1", "KCCKIAM")]
    return arms.load_arm(
        spark.createDataFrame(psms, "peptide string, proteins string, label string, peptide_q string, filename string"),
        spark.createDataFrame(list(features), "peptide string, charge string, proteins string, intensity string"),
        spark.createDataFrame(records, "accession string, sequence string"), "run.mzML", 0.01, **options,
    )


def test_an_arm_keeps_every_row_with_its_reason(spark):
    run = "C:\\raw\\run.mzML"
    psms = [("A[+1.5]IK", "P1;P2", "1", "0.01", run), ("CCK", "P1", "1", "0", run), ("DDK", "P1", "1", "0", run), ("DDK", "P9", "1", "0", run), ("DDK", "rev_P1", "1", "0", run), ("DDK", "P3", "-1", "0", run), ("DDK", "P3", "1", "0.02", run), ("DDK", "P3", "1", "x", run), ("D1K", "P3", "1", "0", run), ("DDK", "P3", "1", "0", "other.mzML"), (None, "P3", "1", "0", run)]
    features = [("A[+1.5]IK", "2", "P1", "5.5"), ("AIK", "2", "P1", "NA"), ("AIK", "3", "P1", "0"), ("CCK", "2", "P1", "1"), ("CCK", "2", "P1", "2"), ("CCK", "0", "P1", "2"), ("DDK", "2", "P3", "2"), ("CCK", "3", "P3", "2"), ("AIK", "4", "P1", "inf")]
    got = arm(spark, psms, features, strict=False)
    assert sorted(map(str, (r.reason for r in got.psms.collect()))) == sorted(map(str, [None, None, "not_contained", "unknown_accession", "decoy_accession", "not_target", "above_q", "invalid_q", "invalid_peptide", "other_acquisition", "malformed"]))
    assert sorted(map(str, ((r.peptide, r.charge, r.reason) for r in got.features.collect()))) == sorted(map(str, [("A[+1.5]IK", "2", None), ("AIK", "2", "missing"), ("AIK", "3", "nonpositive"), ("CCK", "2", "repeated_feature"), ("CCK", "2", "repeated_feature"), ("CCK", "0", "invalid_charge"), ("DDK", "2", "not_accepted"), ("CCK", "3", "not_contained"), ("AIK", "4", "invalid_intensity")]))
    assert {r.peptide for r in got.peptides.collect()} == {"ALK", "CCK"} and got.charge_mode == "separate"
    assert sorted((r.peptide, r.unique) for r in got.support.collect()) == [("ALK", False), ("ALK", False), ("CCK", True)]
    assert sum(r.n for r in arms.conserved(got.psms).collect()) == len(psms)
    assert sorted(r.accessions for r in got.aliases.collect()) == [["P1"], ["P2"], ["P3"]]


def test_only_rows_of_several_accessions_are_numbered(spark, monkeypatch):
    numbered = []
    monkeypatch.setattr(arms, "cut", lambda df, f=arms.cut: (made := f(df), "__id" in df.columns and numbered.append(made.count()))[0])
    run = "run.mzML"
    psms = [("AIK", "P1;P2", "1", "0", run), ("CCK", "P1", "1", "0", run), ("CCK", "P2", "-1", "0", run), ("DDK", "P1;P9", "1", "0", run), ("DDK", "P9;rev_P1", "1", "0", run), ("DDK", "P3", "1", "0", run), ("EEK", "P3", "1", "0", run)]
    got = arm(spark, psms, [("CCK", "2", "P1", "1"), ("AIK", "2", "P1;P3", "1")], records=[("P1", "MAIKCCK"), ("P2", "MALKCCK"), ("P3", "DDKAIK"), ("P3", "EEK"), ("rev_P1", "KCCKIAM")], strict=False)
    assert numbered == [3, 1]
    assert sorted((r.peptide, r.proteins, r.reason or "") for r in got.psms.collect()) == sorted((p, n, w) for (p, n, *_), w in zip(psms, ["", "", "not_target", "unknown_accession", "decoy_accession", "not_contained", "not_contained"], strict=True))
    assert {(r.peptide, r.reason) for r in got.features.collect()} == {("CCK", None), ("AIK", "not_contained")}
    assert sorted((r.peptide, r.unique) for r in got.support.collect()) == [("ALK", False), ("ALK", False), ("CCK", True)]


def test_an_arm_refuses_faults_and_mixed_charges(spark):
    good = ("AIK", "P1", "1", "0", "run.mzML")
    assert arm(spark, [good]).peptides.count() == 1
    for bad in (("DDK", "P1", "1", "0", "run.mzML"), ("AIK", "P1", "1", "2", "run.mzML"), ("AIK", "P1", "1", "0", "x")):
        with pytest.raises(ValueError):
            arm(spark, [good, bad])
    with pytest.raises(ValueError, match="mix"):
        arm(spark, [good], [("AIK", "-1", "P1", "2"), ("AIK", "2", "P1", "2")], strict=False)
    assert arm(spark, [good], [("AIK", "-1", "P1", "2")]).charge_mode == "combined"
