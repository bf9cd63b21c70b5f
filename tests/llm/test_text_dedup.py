"""Brute-force versions of the operators that look for repeats and copies."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from evidra.llm import debruijn, exact_dedup, ngram_join, suffix_dedup
from evidra.llm.textops import text_blocks, word_hashes, word_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, texts, clash=False):
    """Documents with a null id, repeated rows and, if asked for, columns whose names the operators use themselves."""
    rows = [(None if i == 7 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.selectExpr("*", "1 AS id", "'x' AS rid", "2 AS key", "3 AS kept", "4 AS rest", "5 AS file", "6 AS place") if clash else df


def sha(data):
    return hashlib.sha256(bytes(data)).hexdigest()


def brute_bytes(texts, width):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        runs = sum(g and not p for p, g in zip(b"\0" + gone, gone))
        out.append((len(b), sum(gone), runs, sha(x for x, g in zip(b, gone) if not g)))
    return out


def brute_words(texts, width):
    data = [WORD.findall(t or "") for t in texts]
    count = collections.Counter(tuple(w[i : i + width]) for w in data for i in range(len(w) - width + 1))
    out = []
    for w in data:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def byte_texts(rng):
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(10, 120))) for _ in range(12)]
    texts = [None, "", "a" * 200, "ab" * 100, "a" * 199]
    texts += ["".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(0, 8))) for _ in range(60)]
    return texts + texts[10:15]


@pytest.mark.parametrize(("width", "gram", "hot"), [(40, 8, 16_384), (24, 6, 3)])
def test_suffix_dedup_equals_brute_force(spark, width, gram, hot):
    texts = byte_texts(random.Random(width))
    got = suffix_dedup.remove_repeats(spark, frame(spark, texts, clash=True), width=width, gram=gram, hot=hot).collect()
    want = {None if i == 7 else i: row for i, row in enumerate(brute_bytes(texts, width))}
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, sha(r.kept)) for r in got} == want and len(got) == len(texts)


def test_maximal_repeats_have_all_occurrences():
    rows = [b"xabcde1", b"yabcde2", b"xabcdf3", b"zabczz4"]
    pairs = sorted((r[1:], r[:1]) for r in rows)
    found = {(after, before, tuple(sorted(m))) for before, after, m in suffix_dedup.maximal_repeats([left for _, left in pairs], [right for right, _ in pairs], 3, 3)}
    assert (3, 0, (0, 1, 2, 3)) in found and (5, 0, (0, 1)) in found and (4, 1, (0, 2)) in found


@pytest.mark.parametrize(("width", "gram", "hot"), [(35, 8, 16_384), (8, 3, 3)])
def test_debruijn_equals_brute_force(spark, width, gram, hot):
    rng = random.Random(width)
    words = [f"w{i} é" for i in range(30)]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    texts = [None, "", " \t\n", "a " * 100, "ab cd\n" * 60, "x"]
    texts += [rng.choice([" ", "\n", "  "]).join(rng.choice(pool) if rng.random() < 0.6 else rng.choice(words) * 3 for _ in range(rng.randint(0, 8))) for _ in range(60)]
    texts += texts[10:15]
    got = debruijn.remove_repeats(spark, frame(spark, texts, clash=True), width=width, gram=gram, hot=hot).collect()
    want = {None if i == 7 else i: row for i, row in enumerate(brute_words(texts, width))}
    assert {r.id: (r.n_words, r.n_removed, sha(r.kept)) for r in got} == want and len(got) == len(texts)


def brute_groups(rows, size=4, percent=85):
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: (len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)}


@pytest.mark.parametrize("limit", [2000, 20])
def test_ngram_join_equals_brute_force(spark, limit):
    rng = random.Random(limit)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 10, 12, 20, 50, 120, 300]))] for _ in range(40)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "A b c"), (4, "a B c")]
    for k in range(300):
        words = list(rng.choice(base[:5] if k % 3 == 0 else base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)]
        rows.append((len(rows) * 7 % 10007 + 10, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("*", "1 AS cls", "2 AS n", "3 AS root")
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark, df, block_limit=limit).collect()}
    assert got == brute_groups(rows)


def test_near_copy_stage_takes_five_words_and_eighty_percent(spark):
    import corpus_pipeline

    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 5, 9, 30, 100, 250]))] for _ in range(30)]
    base[0] = [f"x{k}" for k in range(100)]
    rows = [(0, " ".join(base[0])), (1, " ".join(base[0] + [f"y{k}" for k in range(22)])), (2, None), (3, " ")]
    for k in range(4, 160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"z{k}"
        rows.append((k, " ".join(w + [f"t{k}-{i}" for i in range(int(len(w) * rng.choice([0, 0.1, 0.2, 0.24, 0.27])))])))
    groups, old = brute_groups(rows, 5, 80), brute_groups(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert got == {i for i, _ in rows if groups[i][1] == i} and 1 not in got
    assert got != {i for i, _ in rows if old[i][1] == i}


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for n in (1, 5, 6, 7, 8, 12, 20, 40, 80, 150, 400, 1000) * 12:
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        cut, more = int(rng.integers(0, n // 6 + 1)), int(rng.integers(0, n // 6 + 1))
        y = np.unique(np.concatenate([x[cut:], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            rows, found = ngram_join.signatures(np.array([0, len(x), len(x) + len(y)]), np.concatenate([x, y]), 85)
            assert set(found[rows == 0].tolist()) & set(found[rows == 1].tolist())


def test_exact_dedup_with_short_digests_and_many_batches(spark):
    texts = ["A b", "a B", "a b", None, "", "x", "X", "long " * 5000, "é", "É"]
    df = frame(spark, texts, clash=True)
    want = {}
    for i, t in enumerate(texts):
        same = [(k != 7, k) for k, u in enumerate(texts) if lower(u) == lower(t)]
        keep = max(same)[1]
        want[None if i == 7 else i] = (None if keep == 7 else keep, len(same), keep == i, sha(lower(t).encode()))
    for options in ({}, {"digest_bits": 8, "bytes_per_batch": 1024, "batch_files": 3}):
        got = exact_dedup.dedup(spark, df, **options).collect()
        assert {r.id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want and len(got) == len(texts)
    kept = exact_dedup.drop_copies(spark, df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, row in want.items() if row[2]}


def test_equal_rows_keep_one(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r.id is None, r.kept) for r in exact_dedup.dedup(spark, df).collect()) == [(False, False), (False, True), (True, False), (True, True)]


@pytest.mark.parametrize("run", [suffix_dedup.remove_repeats, debruijn.remove_repeats, ngram_join.join, exact_dedup.dedup])
def test_empty_table(spark, run):
    assert run(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_by_ascii_white_space():
    import pyarrow as pa

    (_, offsets, data), = text_blocks(pa.array(["Hello\u00a0x  a", None, "\x0bb\x1cc"]))
    starts, ends, counts = word_spans(offsets, data)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["Hello\u00a0x", "a", "b\x1cc"] and counts.tolist() == [0, 2, 2, 3]
    assert len(set(word_hashes(data, starts, ends).tolist())) == 3
