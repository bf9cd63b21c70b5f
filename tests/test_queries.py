"""Each registered query with SQL against DuckDB on the smallest tables."""

import hashlib
import math
import os
import random

import duckdb
import pytest

from evidra.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    rows = want.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_sequences_are_judged_and_folded(spark, tmp_path):
    text = "ACDEFGHIKLMN" * 30 + "A" * 12 + "ACDEFGHIKLMN" + "AAAAI"
    rows = [(1, "src1", "en", text), (2, "src1", "en", ""), (3, "src2", "en", "AI")]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.k): r.low for r in registry.QUERIES["low_complexity"](spark, str(tmp_path)).collect()}
    assert got == {(1, k): k in (30, 32) for k in range(33)} | {(3, 0): False}
    folded = {r.doc_id: (r.length, r.folded_hash) for r in registry.QUERIES["sequence_scalars"](spark, str(tmp_path)).collect()}
    assert folded == {i: (len(t), hashlib.sha256(t.replace("I", "L").encode()).hexdigest()) for i, _, _, t in rows}


def test_whole_benchmark_texts_are_searched(spark, tmp_path):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    texts = {1: letters(605), 2: letters(50), 3: letters(11)}
    docs = {7: letters(30) + texts[1][400:505] + letters(9), 8: letters(300), 50: texts[1][-15:], 51: letters(5) + texts[2][::-1]}
    spark.createDataFrame(list(texts.items()), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, "src1", "en", t) for i, t in docs.items()], "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()

    def windows(t, n):
        return {t[k : k + n] for k in range(0, len(t) - n + 1, n)} | {t[-n:]} if len(t) >= n else set()

    patterns = set().union(*[windows(t, 12) for t in texts.values()])
    places = {(p, i, k) for p in patterns for i, d in docs.items() for k in range(len(d)) if d.startswith(p, k)}
    assert {(r.peptide, r.doc_id, r.position) for r in run("substring_join")} == places and {i for _, i, _ in places} == {7, 50}
    assert {(r.doc_id, r.included) for r in run("include_unmatched")} == {(i, i not in (7, 50)) for i in docs}
    assert {r.peptide for r in run("unmatched_patterns")} == patterns - {p for p, _, _ in places}
    both = {(p, False) for p in patterns} | {(p[::-1], True) for p in patterns}
    want = {(p, back): [str(i) for i, d in sorted(docs.items()) if p in d] for p, back in both}
    assert {(r.peptide, r.reversed): r.proteins.split(",") for r in run("conserved_scan")} == {k: v for k, v in want.items() if v}
    kept = set()
    for t in texts.values():
        own = sorted(windows(t, 20), key=lambda p: -len(set(p)))
        kept |= {p for p in own if len(set(p)) >= len(set(own[math.ceil(0.6 * len(own)) - 1]))} if own else set()
    hits = {i: (sum(d.startswith(p, k) for p in kept for k in range(len(d))), sum(p in d for p in kept)) for i, d in docs.items()}
    assert {r.protein: (r.n_hits, r.n_peptides) for r in run("evidence")} == {i: h for i, h in hits.items() if h[0]} and 7 in {r.protein for r in run("evidence")}


def test_expectation_query_runs_the_default_rounds(spark, monkeypatch):
    from evidra.operators import graph

    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df, f=graph.cut: cuts.append(1) or f(df))
    got = {r.protein: r.abundance for r in registry.QUERIES["expectation"](spark, SF).collect()}
    assert len(cuts) == 11 and got and max(got.values()) == 1.0


def test_halves_leave_no_sold_part_out(spark, duck):
    sold = duck.sql("SELECT count(DISTINCT l_partkey) FROM lineitem JOIN part ON p_partkey = l_partkey").fetchall()[0][0]
    assert registry.QUERIES["universe"](spark, SF).where("status <> 'neither'").count() == sold
