import pytest
from pyspark.sql import functions as F

from evidra.sources import readers, sinks
from evidra.streaming import ingest


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">sp|P1|X_HUMAN Kinase OS=Homo sapiens GN=K\nACD\nEFG\n>b second\nKLM\n>c\n")
    got = {r.accession: (r.header, r.sequence) for r in readers.fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {"sp|P1|X_HUMAN": ("sp|P1|X_HUMAN Kinase OS=Homo sapiens GN=K", "ACDEFG"), "b": ("b second", "KLM")}
    with pytest.raises(Exception, match="empty sequence"):
        readers.fasta(spark, str(tmp_path / "a.fasta"), strict=True).collect()
    df = spark.createDataFrame([("z", "A" * 130), ("y", "C")], "accession string, sequence string")
    sinks.write_fasta(df, str(tmp_path / "out"), single=True)
    assert {r.accession: r.sequence for r in readers.fasta(spark, str(tmp_path / "out"), True).collect()} == {"z": "A" * 130, "y": "C"}


def test_predictions_and_vectors(spark, tmp_path):
    (tmp_path / "s1.csv").write_text("sequence,score\nACDEFGHIK,0.5\nAAAAAAAAA,0.9\nACDEFGHIK,-1\nacACDEFGHIK,0.7\n")
    assert [(r["sample"], r.peptide, r.score) for r in readers.predictions(spark, str(tmp_path)).orderBy("score").collect()] == [("s1", "ACDEFGHIK", 0.5), ("s1", "ACDEFGHIK", 0.7)]
    rows = [("PEP", "[0.5, 1, 0]", ("PEP", 0.5)), ("P E P", "0 0.5 0.5 0.5", ("PEP", 0.5)), ("PEP", "0.5,0.5", None), ("PEP", "1 1 2", None)]
    df = spark.createDataFrame([(i, s, p) for i, (s, p, _) in enumerate(rows)], "i int, s string, p string")
    got = [r[0] for r in df.orderBy("i").select(readers.vector_prediction(F.col("s"), F.col("p"))).collect()]
    assert [tuple(g) if g else None for g in got] == [w for _, _, w in rows]


def test_tables(spark, tmp_path):
    (tmp_path / "psm.tsv").write_text("peptide\tproteins\tlabel\trank\tpeptide_q\nA[+1]IK\tB;A;B\t1\t1\t0.01\nX\tA\t-1\t1\t0\nY\tA\t1\t2\t0\n")
    r = readers.psms(spark, str(tmp_path / "psm.tsv")).collect()
    assert [(x.canonical, x.proteins, x.peptide_q) for x in r] == [("ALK", ["A", "B"], 0.01)]
    (tmp_path / "lfq.tsv").write_text("peptide\tcharge\tproteins\tq_value\tscore\tspectral_angle\trun 1.raw\nAK\t2\tA\tx\t1\t1\t5\nCK\t-1\tB\t0.1\t1\t1\tnan\n")
    r = readers.lfq(spark, str(tmp_path / "lfq.tsv")).collect()
    assert [(x.peptide, x.q_value, x.intensity) for x in r] == [("AK", float("inf"), 5.0), ("CK", 0.1, 0.0)]
    with pytest.raises(ValueError, match="missing columns"):
        readers.table(spark, str(tmp_path / "psm.tsv"), ["nothing"])
    (tmp_path / "egg.tsv").write_text("## made\n#query\tEC\tGOs\nq1\t1.1.1.1\t-\n## end\n")
    assert [tuple(x) for x in readers.annotations(spark, str(tmp_path / "egg.tsv")).collect()] == [("q1", "1.1.1.1", "-")]
    assert readers.source_spec("UP:3:/data:*.fasta") == ("UP", 3, "/data/*.fasta")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 2.0), ("h", "a", 3.0)], "g string, s string, v double")
    out = sinks.write_matrix(df, str(tmp_path / "m"), "g", "s", "v", ["a", "b"])
    assert out.endswith("m_2x2")
    assert sorted(tuple(r) for r in readers.table(spark, out, ["g", "a", "b"]).collect()) == [("g", "1.0", "2.0"), ("h", "3.0", None)]
    sinks.write_bundle({"t": df}, str(tmp_path / "bundle"))
    assert spark.read.json(str(tmp_path / "bundle/_bundle")).first().name == "t"


def test_stream_matches_arrivals(spark, tmp_path):
    spark.createDataFrame([("s", "ACDEFGHIK", 0.5)], "sample string, peptide string, score double").write.parquet(str(tmp_path / "in"))
    lake = spark.createDataFrame([("p", "MMACDEFGHIKMM")], "protein string, sequence string")
    ingest.match_arrivals(spark, str(tmp_path / "in"), lake, str(tmp_path / "hits"), str(tmp_path / "state")).awaitTermination()
    assert [(r.protein, r.position) for r in spark.read.parquet(str(tmp_path / "hits")).collect()] == [("p", 2)]


def test_a_matrix_from_text(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("# scores\n   A  R  N\nA  5 -2 -1\nR -2  6  0\nN -1  0  6\n")
    got = {(r.residue, r.target): r.score for r in readers.substitution_matrix(spark, str(path)).collect()}
    assert got == {("A", "R"): -2, ("A", "N"): -1, ("R", "A"): -2, ("R", "N"): 0, ("N", "A"): -1, ("N", "R"): 0}
    path.write_text("A R\nA 1\n")
    with pytest.raises(Exception, match="does not fit"):
        readers.substitution_matrix(spark, str(path)).collect()


def test_ordered_hits_evidence_and_statistics(spark, tmp_path):
    hits = spark.createDataFrame([("B", 2, 5, 0), ("A", 2, 5, 0), ("C", 1, 9, 1), ("D", 2, 0, 0)], "peptide string, protein int, position int, k int")
    sinks.write_hits(hits, str(tmp_path / "hits"), order="k")
    lines = [x for f in sorted((tmp_path / "hits").glob("part-*")) for x in f.read_text().splitlines() if not x.startswith("peptide")]
    assert lines == ["D\t2\t0", "A\t2\t5", "B\t2\t5", "C\t1\t9"]
    own = spark.createDataFrame([("P1", 2, 1, 1, 0.5, 0.25, 1.0)], "protein_id string, n_peptides int, n_unique_peptides int, n_samples int, mean_score double, max_score double, support_score double")
    sinks.write_evidence(own, str(tmp_path / "ev"))
    assert tuple(readers.table(spark, str(tmp_path / "ev"), list(sinks.EVIDENCE)).first()) == ("P1", "2", "1", "1", "0.5000", "0.2500", "1.0000")
    with pytest.raises(ValueError, match="missing"):
        sinks.write_evidence(own.drop("max_score"), str(tmp_path / "ev2"))
    sinks.write_statistics(own.select("n_peptides"), str(tmp_path / "stats"), {"q": 0.5})
    row = spark.read.json(str(tmp_path / "stats")).first()
    assert (row.q, row.n_peptides) == (0.5, 2)
    with pytest.raises(ValueError, match="several"):
        sinks.write_statistics(hits, str(tmp_path / "stats2"))


def test_a_vector_is_read_once(spark, tmp_path):
    """Each part of a prediction stands in the plan once, not once for each condition that uses it."""
    from evidra.sources import readers

    (tmp_path / "a.csv").write_text('pred_seq,pred_prob\nACDEFGHK,"[0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 1.0]"\nACDEFGHK,0 1 1 1 1 1 1 1 1\nACDEFGHK,0.5 0.5\n,\n')
    got = readers.predictions(spark, str(tmp_path))
    assert sorted((r.sample, r.peptide, r.score) for r in got.collect()) == [("a", "ACDEFGHK", 0.5625), ("a", "ACDEFGHK", 1.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_cast") <= 1 and plan.count("regexp_replace(pred_prob") <= 1 and plan.count("[^A-Z]") == 1


def test_predictions_by_folder_are_read_once(spark, tmp_path):
    """The sample is the folder where that is asked for, so no second reading has to find it."""
    path = f"file://{tmp_path}/runs"
    rows = [("run1", "PEPTIDEK", 0.5), ("run1", "PEPTIDEK", 0.5), ("run2", "PEPTIDEK", 0.5), ("run2", "SHORT", 0.5), ("run2", "MAGICSTER", 0.0)]
    spark.createDataFrame(rows, "run string, sequence string, score double").write.option("header", True).partitionBy("run").csv(path)
    got = readers.predictions(spark, path, 8, 30, r"run=(\w+)")
    assert sorted(map(tuple, got.collect())) == [("run1", "PEPTIDEK", 0.5)] * 2 + [("run2", "PEPTIDEK", 0.5)]
