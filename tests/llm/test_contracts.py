"""Registered queries at their contracts' parameters against brute force, and odd tables through stages and operators."""

import itertools
import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from evidra.llm import debruijn, exact_dedup, language_id, ngram_join, queries, suffix_dedup, topk_search, toxicity, url_filter
from evidra.llm.storage import Workspace, join_hot
from evidra.llm.components import connected
from tests.llm.test_text_dedup import WORD, brute_bytes, brute_groups, brute_words, frame, sha

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def passages(texts, width):
    """Words of each text that are covered by a sequence of `width` words that also starts elsewhere."""
    return [row[1] for row in brute_words(texts, width)]


def test_op1_at_its_contract(spark, documents):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op1_suffix_array_dedup"](spark, SF).collect()}
    rows, marked = brute_bytes(list(documents.values()), 400), passages(list(documents.values()), 50)
    assert got == {i: (*row, n) for i, row, n in zip(documents, rows, marked, strict=True)} and sum(marked) > 0


def test_op9_at_its_contract(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op9_ngram_jaccard_join"](spark, SF).collect()}
    assert got == brute_groups(sorted(documents.items()))


def test_op10_at_its_contract(spark, documents):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op10_debruijn_dedup"](spark, SF).collect()}
    assert got == dict(zip(documents, brute_words(list(documents.values()), 35), strict=True))


@pytest.mark.parametrize("hot", [16_384, 2])
def test_suffix_dedup_over_words(spark, hot):
    """Also with frequent keys, which are split by a second anchor."""
    rng = random.Random(hot)
    pool = [" ".join(rng.choice("abcd") + str(rng.randrange(9)) for _ in range(rng.randint(4, 30))) for _ in range(10)]
    texts = [None, "", " ", "x y", "a b " * 40, "a b " * 41]
    texts += [rng.choice([" ", "\n\t"]).join(rng.choice(pool) if rng.random() < 0.6 else f"w{rng.randrange(99)} é" for _ in range(rng.randint(0, 8))) for _ in range(60)]
    texts += texts[8:12]
    got = suffix_dedup.remove_repeats(spark, frame(spark, texts, clash=True), width=8, gram=3, words=True, hot=hot).collect()
    want = {None if i == 7 else i: row[1:] for i, row in enumerate(brute_words(texts, 8))}
    assert {r.id: (r.n_removed, sha(" ".join(WORD.findall(r.kept.decode())).encode())) for r in got} == want and len(got) == len(texts)


def test_one_very_long_text(spark):
    """A text of over a megabyte meets every operator over documents whole."""
    rng = random.Random(4)
    body = " ".join(f"w{rng.randrange(60_000)}" for _ in range(180_000))
    tail = body[-3000:]
    rows = [(1, body, "en"), (2, f"intro {tail}", "en"), (3, "short", "de"), (4, "the short", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    cut = {r.id: r for r in suffix_dedup.remove_repeats(spark, df).collect()}
    assert len(body) > 1_000_000 and cut[1].n_removed >= 3000 and cut[2].n_bytes - cut[2].n_removed < 20 and cut[1].n_bytes == len(body)
    words = {r.id: r.n_removed for r in debruijn.remove_repeats(spark, df).collect()}
    assert words[1] == words[2] > 300 and words[3] == 0
    sizes = {r.id: r.n_shingles for r in ngram_join.join(spark, df).collect()}
    assert sizes[1] > 150_000 and sizes[3] == 1
    assert [r.kept for r in exact_dedup.dedup(spark, df).collect()] == [True] * 4
    model = language_id.train(spark, df)
    assert {r.id for r in language_id.predict(spark, df, model).collect()} == {1, 2, 3, 4}
    labels = spark.createDataFrame([(i, 1, i % 2) for i in (1, 2, 3, 4)], "doc_id long, quality int, toxic int")
    assert toxicity.score(spark, df, toxicity.train(spark, df, labels)).count() == 4


def odd_documents(spark):
    texts = [None, "", " \n", "same words here", "Same words here", "½ ² ①", "long text " * 300, None, "same words here"]
    rows = [(None if i in (2, 5) else i % 7, t, "en", "s", 0, 1, 2, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, rid int, rest string")
    return df.selectExpr("*", "3 AS doc", "4 AS lo", "5 AS path", "6 AS place", "7 AS carried", "8 AS cls", "9 AS root").repartition(3)


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_and_empty_tables(spark, tmp_path, stage):
    import corpus_pipeline as c

    df = odd_documents(spark)
    for labels in ([], [(6, 1, 1), (3, 0, 0), (None, 1, 1), (0, None, 1)]):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        got = c.STAGES[stage][1](spark, df, str(tmp_path))
        if stage == 4:
            assert got.count() == df.count() and got.groupBy("sequence_id").count().count() >= 1
        else:
            assert got.columns == df.columns and got.schema["n_chars"].dataType == df.schema["n_chars"].dataType
        rows = got.collect()
        if stage == 0 and not labels:
            assert sorted(map(str, rows)) == sorted(map(str, df.collect()))
        if stage == 1:
            # null and empty texts are one; of equal texts the row with the largest id stays
            assert sorted((str(r.doc_id), r.text or "") for r in rows) == sorted([("1", ""), ("4", "Same words here"), ("None", " \n"), ("None", "½ ² ①"), ("6", "long text " * 300)], key=lambda x: x)
        if stage == 2:
            assert len(rows) == 7 and sum((r.text or "").lower() == "same words here" for r in rows) == 1
        if stage == 3:
            assert len(rows) == df.count() and sum(r.text is None for r in rows) == 2
        assert c.STAGES[stage][1](spark, df.limit(0), str(tmp_path)).collect() == []


def test_near_copies_are_told_apart_by_row(spark):
    words = [f"w{k}" for k in range(60)]
    near = " ".join(words[:59] + ["other"])
    rows = [(1, " ".join(words)), (2, near), (2, "a text of its own that is linked with nothing at all"), (None, near)]
    kept = ngram_join.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text[:4]) for r in kept) == [(1, "w0 w"), (2, "a te")]


def test_languages_letters_and_rare_ones(spark):
    rng = random.Random(2)
    voc = {"aa": "lorem ipsum dolor", "bb": "zwei drei vier", "cc": "uno dos tres", "dd": "kuku vava"}
    rows = [(i, " ".join(rng.choice(voc[l].split()) for _ in range(30)), l) for i, l in enumerate(["aa"] * 400 + ["bb"] * 200 + ["cc"] * 100 + ["dd"] * 6)]
    df = spark.createDataFrame(rows + [(9, "½ ² ① 12", "aa"), (9, "½ ² ① 12", "aa")], "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "2 AS held_out", "'q' AS score").repartition(3)
    model = language_id.train(spark, df, max_rows=80)
    assert model.languages == ["aa", "bb", "cc", "dd"]
    got = language_id.predict(spark, df, model).collect()
    truth = {i: l for i, _, l in rows}
    assert all(r.lang_pred == truth[r.id] for r in got if r.lang_pred != "und") and sum(r.lang_pred == "und" for r in got) == 2
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got) and language_id.predict(spark, df.limit(0), model).collect() == []


def test_decoding_equals_a_loop():
    """Loss-weighted decoding of each row, one language and one bit at a time."""
    rng = np.random.default_rng(3)
    code = language_id.codewords(4)
    model = language_id.Model(list("abcd"), code, rng.normal(size=(6, code.shape[1])), rng.normal(size=code.shape[1]), rng.random(code.shape))
    x = rng.normal(size=(20, 6))
    best, score, _ = model.decode(x)
    for i in range(20):
        margins = [sum(x[i, k] * model.weights[k, b] for k in range(6)) + model.bias[b] for b in range(code.shape[1])]
        loss = [sum(np.log1p(np.exp(-m * c)) * t for m, c, t in zip(margins, code[l], model.trust[l])) for l in range(4)]
        assert best[i] == int(np.argmin(loss)) and 0 <= score[i] <= 1


def test_chain_scoring_equals_a_loop(spark):
    """Each category's probability by hand from words and earlier probabilities; equal texts tie."""
    docs = spark.createDataFrame([(i, "bad awful words" if i % 2 else "good kind words") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(spark, docs, labels)
    texts = ["bad words", "good good awful", "", None, "nothing known", "bad words"]
    got = {r.doc.doc_id: r for r in toxicity.score(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS p", "2 AS rejected"), chain).collect()}
    for i, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        _, hashes = toxicity.letter_words(np.array([0, len(raw)]), raw)
        x = [np.log1p(int((hashes == w).sum())) for w in chain.words]
        p = []
        for weights, bias in chain.models:
            p.append(1 / (1 + np.exp(-(sum(a * b for a, b in zip(x + p, weights)) + bias))))
        assert got[i].p == pytest.approx(p, abs=1e-4) and got[i].rejected == (got[i].p[-1] >= toxicity.REJECT)
    assert got[0].p == got[5].p and got[0].rejected and not got[1].p == got[0].p
    assert toxicity.score(spark, docs.limit(0), chain).collect() == []


def test_long_and_odd_hosts(spark):
    hosts = ["a." * 60_000 + "net", "." * 5000, "x..net", "net.", "example.net.", "a.example.com", "EXAMPLE.com", "n" * 300_000]
    urls = [f"http://{h}/de/x" for h in hosts] + [f"http://a.example.com/de/{'p' * 200_000}", None, "://"] + ["http://hot.net/"] * 500
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "action string, host string, path string")
    got = {r.doc.page_id: r.rule for r in url_filter.filter_urls(spark, df, rules).collect()}

    def fits(url, host, path):
        if url is None or "://" not in url:
            return False
        h, _, p = url.split("://", 1)[1].partition("/")
        return (h.lower() == host or h.lower().endswith("." + host)) and ("/" + p).startswith(path)

    for i, url in enumerate(urls):
        own = [h + p for _, h, p in url_filter.RULES if fits(url, h, p)]
        assert got[i] == (max(own, key=len) if own else None)


def test_joins_of_frequent_keys(spark):
    left = spark.createDataFrame([(1 if i < 900 else i, i) for i in range(1000)], "k int, v int")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").where("k % 3 <> 0")
    for how in ("inner", "left"):
        got = join_hot(left, right, ["k"], "n", 1000, how, most=8)
        assert sorted(map(str, got.select("k", "v", "n").collect())) == sorted(map(str, left.join(right, "k", how).select("k", "v", "n").collect()))


@pytest.mark.parametrize("per_task", [200_000, 60])
def test_components_of_hubs_and_chains(spark, per_task):
    rng = random.Random(1)
    links = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(200)] + [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(120)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "test"), per_task=per_task).collect()}
    assert got == {x: root(x) for x in up}


def test_first_parts_are_shared_with_frequent_shingles():
    """The prefix of parts meets for linked sets, whichever shingles count as frequent."""
    rng = np.random.default_rng(2)

    class Some:
        def hits(self, keys):
            return (keys >> 20) % 3 == 0

    for n, percent in itertools.product((1, 4, 9, 30, 90, 400), (80, 85)):
        for _ in range(6):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            cut, more = int(rng.integers(0, n // 5 + 1)), int(rng.integers(0, n // 5 + 1))
            y = np.unique(np.concatenate([x[cut:], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both):
                rows, found = ngram_join.signatures(np.array([0, len(x), len(x) + len(y)]), np.concatenate([x, y]), percent, Some())
                assert set(found[rows == 0].tolist()) & set(found[rows == 1].tolist())


def test_blocks_meet_across_summaries(spark):
    """Several blocks, so that queries go on to other blocks with their thresholds."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(6, 32))[np.arange(900) % 6] + rng.normal(size=(900, 32)) * 0.2).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    v = np.floor(x.astype(np.float64) * 1024).astype(np.int64)
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in topk_search.top_k(spark, df, block=100).collect()}
    for q in range(0, 900, 100):
        s = v @ v[q]
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-s[i], i))[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, int(s[i])) for i in best]


def test_a_session_without_a_checkpoint_folder(tmp_path):
    """Queries run where spark.checkpoint.dir is unset on one machine; elsewhere that is an error."""
    code = (
        "from evidra.session import local_session, shared_dir, ship\n"
        "spark = ship(local_session(2, 2, '1g'))\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "from evidra.llm import queries\nfrom evidra.plans import registry\n"
        f"assert queries.QUERIES['op8_exact_topk'](spark, '{SF}').count() > 0\n"
        f"assert registry.QUERIES['unannotated_names'](spark, '{SF}').count() > 0\n"
        "class Far:\n    conf, sparkContext = spark.conf, type('C', (), {'master': 'spark://x:7077'})()\n"
        "try:\n    shared_dir(Far())\nexcept ValueError as e:\n    print('error:', e)\n"
    )
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "error: spark.checkpoint.dir" in done.stdout, done.stderr[-2000:]


def test_null_column_of_text():
    from evidra.llm.textops import text_blocks

    assert [len(o) - 1 for _, o, _ in text_blocks(pa.array([None, None], pa.string()))] == [2]
