"""Names, prefixes and search targets on small tables with odd values."""

import pytest

from evidra.operators import naming, targets


def test_described_orders_values_and_leaves_out_identifiers(spark):
    rows = [("A", "h1", 1, "A", "n1", None, "unknown"), ("A", "h2", 2, "G2", "n1", "o", "S"), ("A", "h1", 3, "G1", "", "o", "S"), ("B", "h", 4, None, None, None, None)]
    got = naming.described(spark.createDataFrame(rows, "accession string, header string, place int, gene string, protein_name string, organism string, source string")).orderBy("accession").collect()
    assert [tuple(r) for r in got] == [("A", "G2; G1", "n1", "o", "S", 2), ("B", "", "", "", "", 1)]


def test_classes_by_hosts_with_two_rows_and_a_group_of_nothing(spark):
    hosts = spark.createDataFrame([("h", None), ("m", "Human"), ("m", "Mixed")], "accession string, class string")
    groups = spark.createDataFrame([("h",), ("h;x",), ("x",), ("m",), ("",), ("h",)], "protein_group string")
    got = sorted(tuple(r) for r in naming.classify_with_hosts(groups, hosts).collect())
    assert got == [("", "Microbial"), ("h", "Human"), ("h", "Human"), ("h;x", "Mixed"), ("m", "Mixed"), ("x", "Microbial")]


def test_level_names_keep_letters_of_any_script(spark):
    df = spark.createDataFrame([("GO:βx 1",)], "level string")
    assert df.select(naming.level_file_name("level")).first()[0] == "GO_βx_1"


@pytest.mark.parametrize("target, control", [("ENTRAP_a", "ENTRAP_b"), ("a", "b")])
def test_controls_on_the_wrong_side_are_errors(spark, target, control):
    one = lambda x: spark.createDataFrame([(x,)], "header string")
    with pytest.raises(Exception, match="control"):
        targets.injected(one(target), one(control), "ENTRAP_").collect()


def test_union_keeps_the_baseline_whole_and_each_added_sequence_once(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "accession string, sequence string, seq_hash string")
    got = targets.selected_union(rows(("a", "X", "x"), ("b", "X", "x")), rows(("c", "X", "x"), ("e", "Y", "y"), ("d", "Y", "y")), rows(("f", "Y", "y"), ("g", "Z", "z"), ("h", "Z", "z")))
    assert sorted((r.accession, r.seq_hash, r.layer) for r in got.collect()) == [("SHA256_z", "z", 2), ("a", "x", 0), ("b", "x", 0), ("d", "y", 1)]
    assert got.where("layer = 0 AND appended IS NOT NULL").count() == 0


def test_observed_prefixes_known_first_then_up_to_the_mark(spark):
    headers = spark.createDataFrame([("ENTRAPHUMAN-1 x",), ("sp|entrap_9_z",), ("xEntrap7",), ("plain",), ("",), (None,)], "header string")
    got = {tuple(r) for r in targets.observed_prefixes(headers, "ENTRAP", ["ENTRAPHUMAN-"]).collect()}
    assert got == {("ENTRAPHUMAN-", 1, True), ("entrap_", 1, False), ("Entrap", 1, False)}


def test_coverage_and_lift_of_nothing(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    got = targets.source_coverage(none("gene string, dna double, rna double"), none("gene string"), none("gene string, term string"), none("compound string, value double")).collect()
    assert len(got) == 1 and not any(got[0])
    lift = targets.median_lift(none("arm string, depth int"), "arm", "a", "b").first()
    assert lift.lift_pct == 0 and lift.base_median is None
