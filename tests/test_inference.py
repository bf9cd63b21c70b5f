"""The inference run, quality filters, summaries over samples, bundles and the substring join's array path."""

import math
import random
import statistics
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from evidra.operators import inference, matching, quality, study
from evidra.sources import readers, sinks


def test_inference_with_rescue(spark, tmp_path):
    proteins = {"A": "MKTAYIAKQRQISFVKSHFSR", "B": "GGPEPTIDEKAAASAMPLERGG", "C": "WWWWWWWWWWWWWWW"}
    more = {"A": proteins["A"], "D": "MMLVNERGYDHKQWCTSAPLGG"}
    rows = [("AKQRQLSFVK", 0.9), ("AKQRQISFVK", 0.4), ("PEPTIDEKAAA", 0.8), ("NERGYHDKQWC", 0.7), ("SHORT", 0.9), ("YIAKQRQIS", 0.2)]
    peptides = spark.createDataFrame(rows, "peptide string, score double")
    frame = lambda d: spark.createDataFrame(list(d.items()), "protein string, sequence string")
    plain = inference.infer(peptides, frame(proteins))
    assert {(r.peptide, r.protein) for r in plain.edges.collect()} == {("AKQRQLSFVK", "A"), ("PEPTLDEKAAA", "B"), ("YLAKQRQLS", "A")}
    assert {r.protein for r in plain.selected.collect()} == {"A", "B"}
    row = plain.stats.first()
    assert (row.n_proteins, row.n_peptides, row.n_matched, row.n_candidates, row.n_selected, row.reduction_factor, row.n_rescued) == (3, 4, 3, 2, 2, 1.5, None)
    got = inference.infer(peptides, frame(proteins), rescue=frame(more), least_votes=3)
    row = got.stats.first()
    assert (row.n_proteins, row.n_rescued, row.n_rescued_new) == (4, 1, 1)
    # the exchanged residues give no exact edge, so the new protein is a candidate without peptides
    assert {r.protein for r in got.selected.collect()} == {"A", "B"}
    strict = inference.infer(peptides, frame(proteins), "uniform_2pep", least_score=0.3)
    assert {r.protein for r in strict.selected.collect()} == set() and strict.stats.first().reduction_factor == 0
    inference.write(plain, f"file://{tmp_path}/run")
    assert {r.accession: r.sequence for r in readers.fasta(spark, f"file://{tmp_path}/run/selected/parts").collect()} == {k: proteins[k] for k in "AB"}
    assert {r.protein: r.n_peptides for r in spark.read.json(f"file://{tmp_path}/run/provenance").collect()} == {"A": 2, "B": 1}
    with pytest.raises(ValueError):
        inference.infer(peptides, frame(proteins), "guess")
    with pytest.raises(ValueError):
        inference.infer(peptides, frame(proteins), "species_budget")


def test_quality_filters_in_order(spark):
    rows = [("ok", "MKTAYIAKQRQISFVK"), ("noncanonical", "XXXXXMKT"), ("length", "MKT"), ("poly_run", "MKAAAAAAAAAATRVS"), ("low_complexity", "MKMKMKMKMKMK"), ("fragment", "KTAYIAKQRQIS"), ("empty", None), ("clean", "mktayiaBkqrqisfv")]
    df = spark.createDataFrame(rows, "accession string, sequence string")
    made = quality.filtered(df, quality.Filters(0.2, True, 5, 100, 8, 0.5, 14))
    got = {r.accession: (r.reason, r.detail, r.cleaned, r.n_replaced) for r in made.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: {"ok": None, "clean": None, "empty": "length"}.get(k, k) for k, _ in rows}
    assert got["clean"][2:] == ("MKTAYIAXKQRQISFV", 1) and got["noncanonical"][1] == "noncanonical:frac=62.50%>20.00%" and got["length"][1] == "too_short:3<5" and got["fragment"][1] == "fragment:no_M_start,len=12<14" and got["low_complexity"][1] == "low_complexity:entropy=0.231<0.5"
    row = quality.report(made).first()
    assert (row.total_input, row.passed, row.rejected_length, row.rejected_poly_run, row.residues_normalised) == (8, 2, 2, 1, 1)
    assert quality.report(quality.filtered(df, quality.Filters(shortest=0))).first().passed == 8


def test_cross_sample_summary_equals_a_loop(spark):
    rng = random.Random(3)
    cells = {(s, f): rng.choice([0.0, rng.random(), None]) for s in "abcd" for f in range(30)} | {(s, 99): 1.0 for s in "abcd"}
    df = spark.createDataFrame([(s, f, v) for (s, f), v in cells.items()], "s string, f int, v double")
    values = {f: [v for (_, g), v in cells.items() if g == f and v] for f in {f for _, f in cells}}
    cvs = sorted(statistics.stdev(v) / statistics.mean(v) * 100 for v in values.values() if len(v) >= 2)
    row = study.cross_sample_summary(df, "s", "f", "v").first()
    assert (row.n_samples, row.n_features, row.features_in_all_samples, row.features_in_one_sample) == (4, 31, sum(len(v) == 4 for v in values.values()), sum(len(v) == 1 for v in values.values()))
    assert math.isclose(row.median_cv_pct, cvs[len(cvs) // 2]) and math.isclose(row.completeness_pct, sum(map(len, values.values())) * 100 / 124)
    assert study.cross_sample_summary(df.limit(0), "s", "f", "v").first().median_cv_pct == 0


def test_a_bundle_appears_whole_and_is_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    path = f"file://{tmp_path}/bundle"
    sinks.write_bundle({"one": df, "two": df.limit(0)}, path, {"q": 0.01})
    got = readers.bundle(spark, path)
    assert sorted(got["one"].collect()) == sorted(df.collect()) and got["two"].count() == 0
    assert [p.name for p in tmp_path.iterdir()] == ["bundle"]
    with pytest.raises(FileExistsError):
        sinks.write_bundle({"one": df}, path)
    df.write.mode("append").parquet(f"{path}/one")
    with pytest.raises(ValueError, match="one differs"):
        readers.bundle(spark, path)


@pytest.mark.parametrize("seed", [1, 7])
def test_substring_join_over_classes(spark, seed):
    """Long and short patterns, letters outside ASCII, rows of every length."""
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abé😀") for _ in range(rng.choice([0, 1, seed, 30, 400]))) for _ in range(40)] + [None, "a" * 60]
    patterns = {t[i : i + n] for t in texts if t for n in (seed, seed + 1, 20, 70, 300) for i in [rng.randrange(max(1, len(t) - n))] if len(t) >= n} | {"a" * max(seed, 2), "zz", "a" * (seed - 1)}
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, sequence string, other string").repartition(3)
    got = matching.substring_join(spark.createDataFrame([(p,) for p in sorted(patterns)] + [(None,)], "peptide string"), df, seed=seed)
    want = sorted((p, i, "x", k) for p in patterns if len(p) >= seed for i, t in enumerate(texts) if t for k in range(len(t)) if t.startswith(p, k))
    assert sorted((r.peptide, r.id, r.other, r.position) for r in got.collect()) == want
    assert matching.substring_join(spark.createDataFrame([], "peptide string"), df, seed=seed).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_windows_are_keyed_within_rows(n, monkeypatch):
    """Blocks of few characters; equal windows have equal keys, others differ, none crosses a row."""
    monkeypatch.setattr(matching, "BLOCK", 20)
    rng = random.Random(n)
    texts = ["".join(rng.choice("ab\u00e9\U0001f600") for _ in range(rng.choice([0, 1, n, 9, 40]))) for _ in range(30)]
    got = {}
    for rows, places, keys in matching._blocks(texts, n):
        for r, p, k in zip(rows.tolist(), places.tolist(), keys.tolist(), strict=True):
            assert (r, p) not in got
            got[r, p] = k
    want = {(r, p): t[p : p + n] for r, t in enumerate(texts) for p in range(len(t) - n + 1)}
    assert set(got) == set(want) and len({(got[k], want[k]) for k in got}) == len(set(got.values())) == len(set(want.values()))


def test_windows_of_large_batches_take_little_memory():
    """A batch of many texts and one long text: what a task holds besides them is bounded by BLOCK."""
    rng = random.Random(5)
    long = "".join(rng.choices("ABCDEFGH", k=3_000_000))
    column = pa.array([long, None, ""] + [long[k : k + 3000] for k in range(1000)])
    wanted = set(matching.window_keys(np.frombuffer(long[1_500_000:1_500_012].encode("utf-32-le"), "<u4"), 12).tolist())
    found = []
    tracemalloc.start()
    for first, texts in matching._some_rows(column):
        for row, place, _ in matching._blocks(texts, 12, lambda key: np.isin(key, list(wanted))):
            found += zip((row + first).tolist(), place.tolist(), strict=True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 1_500_000)] and most < 30e6, most


@pytest.mark.parametrize("part", [30, 64, 1000])
def test_long_sequences_reach_workers_in_parts(spark, monkeypatch, part):
    """No row that a worker gets is a whole long text; each place is found once, across parts and beyond ASCII too."""
    monkeypatch.setattr(matching, "PART", part)
    rng = random.Random(part)
    texts = ["".join(rng.choices("ABé\U0001f9ea", k=k)) for k in (0, 5, 29, 30, 31, 63, 64, 65, 128, 1000, 2500)] + [None, "AB" * 300]
    patterns = {t[p : p + n] for t in texts if t for n in (6, 9, 40, 300) for p in rng.sample(range(len(t)), min(4, len(t))) if p + n <= len(t)}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    sent, step = matching._parts(df, "t", 40)
    assert step == max(part, 40) and {r.id: r.n for r in sent.groupBy("id").agg({"__part": "count"}).toDF("id", "n").collect()} == {k: max(1, -(-len(t) // step)) for k, t in enumerate(texts) if t is not None}
    assert all(len(r["__part"]) <= step + 39 and texts[r.id].startswith(r["__part"], r["__from"]) for r in sent.collect())
    got = matching.substring_join(spark.createDataFrame([(p,) for p in sorted(patterns)], "peptide string"), df, sequence="t", seed=6)
    found = [(r.id, r.peptide, r.position) for r in got.collect()]
    want = {(k, q, p) for k, t in enumerate(texts) if t for q in patterns for p in range(len(t)) if t.startswith(q, p)}
    assert len(found) == len(set(found)) and set(found) == want
