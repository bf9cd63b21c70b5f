"""Importance resampling, spelling variants and sketched near copies against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from evidra.llm import importance, near_dedup, ngram_join, spelling, suffix_dedup
from tests.llm.test_text_dedup import brute_groups, lower

TARGET_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_resample(rows, target, order, buckets, least, percent):
    def features(text):
        w = TARGET_WORD.findall(lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1)]

    corpus = collections.Counter(b for _, t in rows for b in features(t)[1])
    aim = collections.Counter(b for t in target for b in features(t)[1])
    s, t = sum(corpus.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((n + 1) * (t + buckets)))) for b, n in corpus.items()}
    out = []
    for i, text in rows:
        n, own = features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def odd_rows(rng):
    voc = [f"w{i}" for i in range(40)] + ["É", "naïve", "ÀB", "x_y", "Don't", "日本"]
    rows = [(i, " ".join(rng.choice(voc) for _ in range(rng.choice([0, 1, 3, 19, 20, 25, 60])))) for i in range(120)]
    return rows + [(None, None), (None, " ".join(voc)), (500, None), (501, ""), (502, "_ ,"), (7, rows[7][1]), (7, rows[7][1])]


@pytest.mark.parametrize("order", [2, 3])
def test_resample_equals_brute_force(spark, order):
    rows, target = odd_rows(random.Random(order)), [None, "w1 w2 w3 É w1 w2", "w1 w2 naïve"]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS id", "2 AS score", "3 AS part", "4 AS long", "5 AS n")
    aim = spark.createDataFrame([(t,) for t in target], "text string").selectExpr("*", "1 AS bucket")
    got = importance.resample(spark, df, aim, order=order, buckets=97, percent=40)
    want = brute_resample(rows, target, order, 97, 20, 40)
    assert sorted(map(tuple, got.collect()), key=str) == want and got.columns == ["id", "n_features", "weight", "score", "rank"]


def test_resample_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    assert importance.resample(spark, none, some).collect() == []
    got = {r.id: (r.n_features, r["rank"]) for r in importance.resample(spark, some, none, percent=100).collect()}
    assert got == {1: (79, 1), 2: (0, None)}


def test_the_ring_gives_checksums_of_joined_words():
    words = ["a", "bc", "é", "def" * 1000, "z"]
    want = collections.Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    assert collections.Counter(importance.ring_checksums([w.encode() for w in words], 3)) == want


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, least, least_count, every, ratio=10):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= least_count}
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= ratio * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


@pytest.mark.parametrize(("least", "per_unit", "hot"), [(7, 40_000, 50_000), (2, 20, 3)])
def test_variants_equal_brute_force(spark, least, per_unit, hot):
    rng = random.Random(least)
    syllables = ["an", "en", "é", "ou", "Th", "Ö", "a", "ti"]
    base = ["".join(rng.choice(syllables) for _ in range(rng.choice([2, 3, 4, 5, 6]))) for _ in range(60)] + ["Aaaaaaaa", "a" * 7, "b" * 300]
    rows = []
    for i in range(150):
        words = [rng.choice(base[: 1 + int(60 * rng.random() ** 3)]) for _ in range(rng.randint(0, 40))] + rng.sample(base[-3:], 1)
        for _ in range(2):
            at = rng.randrange(len(words))
            w, p = words[at], rng.randrange(len(words[at]) + 1)
            words[at] = w[:p] + rng.choice(["", "e", "x", "é"]) + w[p + rng.randint(0, 1) :]
        rows.append((None if i == 9 else i, rng.choice([" ", "1", "日"]).join(words)))
    rows += [(3, rows[3][1]), (None, None), (400, ""), (401, "12 ½")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS id", "2 AS word", "3 AS n", "4 AS unit", "5 AS root")
    got = spelling.variants(spark, df, least=least, every=5, per_unit=per_unit, hot=hot).collect()
    want = brute_variants(rows, least, 2, 5)
    assert sorted(map(tuple, got), key=lambda r: r[0]) == want and sum(r[1] is not None for r in want) > 5
    assert spelling.variants(spark, df.limit(0), least=least).collect() == []


def test_numbers_of_the_automaton_are_places_in_order():
    words = sorted({"".join(p) for p in ["ab", "abc", "abcd", "b", "bc", "xbc", "xbcd", "é"]})
    alphabet = np.unique([ord(c) for w in words for c in w])
    codes, sizes = spelling.code_matrix(words, alphabet)
    made = spelling.Automaton.build(codes, sizes, len(alphabet))
    for k, (row, size) in enumerate(zip(codes, sizes, strict=True)):
        state, number = made.start, 0
        for symbol in row[:size]:
            arc = made.table[state, symbol]
            state, number = made.target[arc], number + made.skip[arc]
        assert made.final[state] and number == k
    assert len(made.final) < sum(map(len, words))  # "bc" and what follows is shared


@pytest.mark.parametrize(("limit", "tokens"), [(2000, 2_000_000), (20, 300)])
def test_near_copies_equal_brute_force(spark, limit, tokens):
    rng = random.Random(limit + tokens)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20, 50, 120, 300]))] for _ in range(40)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "A b"), (4, "a B"), (5, "a")]
    for k in range(300):
        words = list(rng.choice(base[:5] if k % 3 == 0 else base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 9])):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)]
        rows.append((len(rows) * 7 % 10007 + 10, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("*", "1 AS cls", "2 AS n", "3 AS root", "4 AS short")
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dedup.join(spark, df, block_limit=limit, block_tokens=tokens).collect()}
    assert got == brute_groups(rows, 2, 80)
    assert near_dedup.join(spark, df.limit(0)).collect() == []


def test_sketches_are_full_and_concentrated():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 30, 1000):
        both = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64))
        more = np.unique(rng.integers(0, 1 << 63, -(-n // 4), dtype=np.int64).view(np.uint64))
        whole = np.union1d(both, more)
        got = near_dedup.sketches(np.array([0, len(both), len(both) + len(whole), len(both) + len(whole)]), np.concatenate([both, whole]), 640)
        assert (got[:2] != near_dedup._EMPTY).all() and (got[2] == near_dedup._EMPTY).all()
        true = len(both) / len(whole)
        assert abs((got[0] == got[1]).mean() - true) < 5 * (true * (1 - true) / 640) ** 0.5 + 1e-9


def parity_words(n=4096):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_built_to_collide_stay_apart(spark):
    """Words whose polynomial hashes modulo 2**64 are equal."""
    import corpus_pipeline

    one, two = parity_words()
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert {r.id: r.component_id for r in ngram_join.join(spark, df).collect()} == {1: 1, 2: 2}
    assert {r.id: r.component_id for r in near_dedup.join(spark, df).collect()} == {1: 1, 2: 2}
    tail = [f"t{k}" for k in range(60)]
    rows = [(k, " ".join([*(f"{k}-{i}" for i in range(30)), word, *(f"{k}+{i}" for i in range(30))])) for k, word in enumerate((one, two))]
    rows += [(k + 2, " ".join([word if i % 2 else f"s{i}" for i in range(80)])) for k, word in enumerate((one, two))]
    df = spark.createDataFrame(rows + [(9, " ".join(tail))], "doc_id long, text string")
    assert {r.id: r.n_removed for r in suffix_dedup.remove_repeats(spark, df, width=8, gram=3, words=True).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 0}
    own = df.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    assert {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, own, "").collect()} == {r.doc_id: r.text for r in own.collect()}


def test_hashes_of_words_depend_on_every_byte():
    from evidra.llm.textops import word_hashes

    rng = random.Random(8)
    words = {bytes(rng.choice(b"ab\xc3\xa9") for _ in range(n)) for n in (1, 7, 8, 9, 15, 16, 17, 31, 32, 33, 90) for _ in range(40)}
    words = sorted(words)
    for order in (words, words[::-1]):
        data = np.frombuffer(b" ".join(order), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in order]) - 1
        found = dict(zip(order, word_hashes(data, ends - [len(w) for w in order], ends).tolist(), strict=True))
        assert len(set(found.values())) == len(words)
        before = found if order is words else before
    assert before == found


def test_one_very_long_text_in_the_new_operators(spark):
    rng = random.Random(4)
    body = " ".join(f"w{rng.randrange(60_000)}" for _ in range(180_000))
    rows = [(1, body), (2, body[:-20]), (3, "short"), (4, "wwwwwwwwww" * 20_000 + " " + "wwwwwwwwww" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component_id for r in near_dedup.join(spark, df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.id: r.n_features for r in importance.resample(spark, df, df).collect()} == {1: 359_999, 2: len(body[:-20].split()) * 2 - 1, 3: 1, 4: 3}
    assert sorted(len(r.word) for r in spelling.variants(spark, df).collect()) in ([200_000], [199_999])


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_a_very_long_text(spark, tmp_path, stage):
    import corpus_pipeline as c

    rng = random.Random(6)
    body = " ".join(f"w{rng.randrange(60_000)}" for _ in range(180_000))
    df = spark.createDataFrame([(1, body, "en", "s", len(body)), (2, "a short one", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = c.STAGES[stage][1](spark, df, str(tmp_path)).collect()
    if stage < 4:
        assert sorted((r.doc_id, r.text) for r in got) == [(1, body), (2, "a short one")]
    else:
        own = sorted((r.start, r.length) for r in got if r.doc_id == 1)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) == next(r.doc_tokens for r in got if r.doc_id == 1) > 180_000
