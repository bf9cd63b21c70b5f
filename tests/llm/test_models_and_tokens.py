"""Held-out accuracy, exact round trips and brute-force versions of the other operators."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidra.llm import byte_bpe, language_id, packing, queries, topk_search, toxicity, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.select(", ".join(columns)).fetchall()))


def test_urls(spark):
    urls = ["https://A.Example.NET/en/x?y", "http://example.net/de", "http://badexample.com/de/", "http://x.example.com/de/a#b", "http://a.org", "http://a.org/fr/", "nothing", None, "://?q", "ftp://net/", "http://net", "a://b://net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule", "3 AS h")
    rules = spark.createDataFrame(url_filter.RULES, "action string, host string, path string")
    got = {r.doc.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(spark, df, rules).collect()}
    want = {0: ("example.net/en/", "allow"), 1: ("net/", "block"), 3: ("example.com/de/", "block"), 5: ("org/fr/", "allow"), 9: ("net/", "block")}
    assert got == {i: want.get(i, (None, "allow")) for i in range(len(urls))}
    assert url_filter.filter_urls(spark, df.limit(0), rules).count() == 0


def test_url_query_is_native(spark):
    plan = queries.QUERIES["op2_url_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_byte_bpe_equals_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(open(path, "rb").read())
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = [None, "", " ", "a  b", " a ", "a\n b", "<|endoftext|>", "a" * 3000, " " * 300 + "x", "!" * 999]
    texts += ["".join(rng.choice("abcdefgeriontheINGxyz'sst éüß漢😀\n\t  ,.!0123") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS ids")
    for r in byte_bpe.encode(spark, df, path, public_tokenizers.PATTERN).collect():
        text = texts[r.id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode() and r.n_tokens == len(r.ids) // 4


def test_words_encoded_together_are_words_encoded_alone():
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/word_bpe_49k.json"
    with open(path, encoding="utf-8") as file:
        text = file.read()
    encoder, plain = packing.WordEncoder(text), Tokenizer.from_str(text)
    assert encoder.mark is not None
    rng = random.Random(5)
    parts = ["don't", "42", "e\u0301te\u0301", "\u0301x", "a\u00a0b", "<|endoftext|>", "<|ENDOFTEXT|>x", "\x00", "\x02", "\U0001f600", "--", "\u2028", "\uac00", "\u1100\u1161", "ABC"]
    for odd in ([], ["\x01", "x\x01y"]):  # the mark itself in a text
        texts = ["".join(rng.choice(parts + odd + [" ", "\n", " "]) for _ in range(rng.randrange(60))) for _ in range(400)] + ["", " ", "\t\n"]
        ids, bounds = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = [None, "", "<|endoftext|> a<|STARTOFTEXT|>b", "I'll don't É é Σας\xa0ΣΑΣ 漢字\u3000x İ ½ 12a3", "ab cd " * 4000, "x"]
    texts += [" ".join(rng.choice(["the", "Heat", "nation,", "ß"]) for _ in range(rng.randint(0, 900))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS rank")
    rows = packing.pack_documents(spark, df, path).collect()
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
    pieces, sequences = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.id])
        pieces.setdefault(r.id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in pieces.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == len(ids[i])
    assert len(pieces) == len(texts) and sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(spark, df.limit(0), path).count() == 0


def test_patterns_hold_the_histogram():
    rng = random.Random(3)
    counts = {rng.randint(1, 4096): rng.randint(1, 5000) for _ in range(400)}
    patterns = packing.pack_histogram(counts)
    placed = dict.fromkeys(counts, 0)
    for times, content in patterns:
        assert sum(n * k for n, k in content.items()) <= 4096
        for n, k in content.items():
            placed[n] += times * k
    assert placed == counts and len(patterns) < 4000


@pytest.mark.parametrize("common", [False, True])
def test_top_k_equals_brute_force(spark, common):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    if common:
        x[::3] = x[0]
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(401, None), (500, [float("nan")] * 24), (402, [None] * 24), (None, x[1].tolist()), (403, [1.0]), (600, []), (5, x[5].tolist()), (7, x[8].tolist()), (200, x[9].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).selectExpr("*", "1 AS id", "2 AS v", "3 AS key", "4 AS block")
    own = np.concatenate([np.arange(400), [5, 7, 200]])
    v = np.floor(np.concatenate([x, x[[5, 8, 9]]]).astype(np.float64) * 1024).astype(np.int64)
    want = []
    for q in np.flatnonzero(own % 100 == 0).tolist():
        scores = v @ v[q]
        best = sorted((i for i in range(len(own)) if i != q), key=lambda i: (-scores[i], own[i]))[:10]
        want += [(int(own[q]), k + 1, int(own[i]), int(scores[i])) for k, i in enumerate(best)]
    for block in (16_384, 64):
        got = topk_search.top_k(spark, df, block=block).collect()
        assert sorted((r.query_id, r["rank"], r.id, r.score) for r in got) == sorted(want)
    assert topk_search.top_k(spark, df.limit(0)).collect() == []


def test_bounds_discard_candidates():
    """On clustered vectors most candidates go before they are scored, in small blocks too, and whole blocks go by their summary."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 64)) * 200
    v = np.floor(centres[np.arange(480) % 8] + rng.normal(size=(480, 64)) * 20).astype(np.int64)
    keys, counts = np.arange(480), {}
    found = topk_search.search_block(keys[:40], v[:40], keys, keys, v, 10, counts=counts)
    scores = v[:40] @ v.T
    for q, (ids, own) in enumerate(found):
        best = sorted((i for i in range(480) if i != q), key=lambda i: (-scores[q, i], i))[:10]
        assert sorted(zip((-own).tolist(), ids.tolist())) == [(-int(scores[q, i]), i) for i in best]
    assert counts["scored"] < 0.25 * 40 * 479 and counts[32] <= counts[16] <= counts[4] <= counts[1]
    least = np.array([float(np.sort(scores[0])[-11])])
    stats = topk_search.statistics(v.astype(float), topk_search.SUMMARY)
    gone = 0
    for c in range(8):
        own = stats[np.arange(480) % 8 == c]
        bound = topk_search.block_bounds(v[:1], np.stack([own[:, ::2].min(0), own[:, ::2].max(0), own[:, 1::2].max(0)]))
        assert bound[0] >= scores[0, np.arange(480) % 8 == c].max() - 1e-6
        gone += bound[0] < least[0]
    assert gone >= 4


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.predict(spark, docs, language_id.train(spark, docs))
    both = got.where("held_out").join(docs.select(F.col("doc_id").alias("id"), "lang"), "id")
    assert both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    first = {r.id: r.held_out for r in got.collect()}
    assert all(held == (zlib.crc32(str(i).encode()) % 3 == 1) for i, held in first.items())
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 !", "en"), (None, "the and", None), (4, "", "de")], "doc_id long, text string, lang string")
    model = language_id.train(spark, docs)
    rows = {r.id: (r.lang_pred, r.score) for r in language_id.predict(spark, odd, model).collect()}
    assert rows[1] == rows[2] == rows[4] == ("und", 0.0) and rows[None][0] == "en"
    assert language_id.train(spark, odd.limit(0)) is None and {r.lang_pred for r in language_id.predict(spark, odd, None).collect()} == {"und"}


def test_codewords_are_apart():
    for n in (2, 3, 5, 12):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n and code.shape[0] == n


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.train(spark, docs, labels.where("doc_id % 4 <> 0"))
    got = toxicity.score(spark, docs, chain).select(F.col("doc.doc_id").alias("doc_id"), "rejected").join(labels.where("doc_id % 4 = 0"), "doc_id")
    hit, false = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("rejected").cast("int"))), F.avg(F.when(F.col("toxic") == 0, F.col("rejected").cast("int")))).first()
    assert hit > 0.9 and false < 0.01
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2)], "doc_id long, text string, p int")
    assert [r.rejected for r in toxicity.score(spark, odd, chain).collect()] == [False, False]
    assert toxicity.train(spark, docs, labels.limit(0)) is None
    assert [r.rejected for r in toxicity.score(spark, odd, None).collect()] == [False, False]


def test_stem_features_meet_inflected_words():
    from evidra.llm.textops import text_blocks

    (_, offsets, data), = text_blocks(pa.array(["Loweient!", "loweischaft"]))
    rows, hashes = toxicity.letter_words(offsets, data)
    assert set(hashes[rows == 0].tolist()) & set(hashes[rows == 1].tolist())


def test_pipeline_equals_its_parts(spark):
    """The stages' decisions by brute force, given the first stage's verdicts."""
    import corpus_pipeline as c

    from tests.llm.test_text_dedup import WORD, brute_groups, brute_words, lower, sha

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text for r in c.reject_toxic(spark, docs, SF).collect()}
    last = {lower(t): i for i, t in sorted(kept.items())}
    kept = {i: kept[i] for i in last.values()}
    groups = brute_groups(sorted(kept.items()), 5, 80)
    kept = {i: t for i, t in sorted(kept.items()) if groups[i][1] == i}
    want = {i: row[2] for i, row in zip(kept, brute_words(list(kept.values()), 50), strict=True)}
    rows = c.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(kept)
    near = docs
    for _, stage in c.STAGES[:4]:
        near = stage(spark, near, SF)
    left = {r.doc_id: r for r in near.collect()}
    assert near.columns == docs.columns and all(want[i] == sha(" ".join(WORD.findall(r.text)).encode()) and r.n_chars == len(r.text) for i, r in left.items())
    assert sum(r.text != kept[i] for i, r in left.items()) > 3
