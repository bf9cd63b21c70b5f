"""Toxicity by a classifier chain: each category's linear model also reads the probabilities of the earlier ones.

Later models are trained with out-of-fold probabilities of the earlier ones, so that they meet in training what they
meet in use. Words are lower-cased runs of letters; a feature is log(1 + count) of a word or of a word's beginning, as inflected
words of one stem share a beginning.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import fit_logistic, sigmoid
from .storage import Workspace, bounded_batches, release
from .textops import lower_ascii, mix, text_blocks, word_hashes

#: Labelled rows and words that a fit reads at most. The bounds do not depend on the table.
MAX_ROWS, MAX_WORDS = 8_000, 2_048
#: Words of a lesser chi-square say nothing about any category.
LEAST_CHI2 = 20.0
#: The order of the chain: category, column of `labels`, value that makes it positive.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
FOLDS, REJECT = 3, 0.3
#: Steps of the fits that give out-of-fold probabilities.
FOLD_STEPS = 200
STEMS = (4, 5, 6)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class Chain:
    """Sorted word hashes, their scales, and for each category its weights (words, then earlier categories), bias."""

    words: np.ndarray
    scales: np.ndarray
    models: list[tuple[np.ndarray, float]]

    def predict(self, features: np.ndarray) -> np.ndarray:
        """Probabilities, a column for each category."""
        x = features * self.scales
        for weights, bias in self.models:
            x = np.concatenate([x, sigmoid(x @ weights + bias)[:, None]], 1)
        return x[:, len(self.words) :]


def letter_words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of letters, and of the first 4, 5 and 6 bytes of longer ones."""
    low = lower_ascii(data)
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = _LETTER[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    found = [(rows, word_hashes(low, starts, ends))]
    for n in STEMS:
        longer = ends - starts > n
        found.append((rows[longer], mix(word_hashes(low, starts[longer], starts[longer] + n) + np.uint64(n))))
    return np.concatenate([r for r, _ in found]), np.concatenate([h for _, h in found])


def _found(rows: np.ndarray, hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place among the known words and log(1 + count) of each known word of each row."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    hit = words[at] == hashes
    cells, counts = np.unique(rows[hit] * len(words) + at[hit], return_counts=True)
    return cells // len(words), cells % len(words), np.log1p(counts).astype(np.float32)


def _features(rows: np.ndarray, hashes: np.ndarray, n: int, words: np.ndarray) -> np.ndarray:
    out = np.zeros((n, len(words)), np.float32)
    r, at, value = _found(rows, hashes, words)
    out[r, at] = value
    return out


def fit_chain(features: np.ndarray, labels: np.ndarray, words: np.ndarray, folds: int = FOLDS) -> Chain:
    """labels: a column for each category, in the chain's order; rows are dealt to folds in turn.

    features: float32, a column for each word and, after those, one to be filled for each category but the last.
    """
    fold = np.arange(len(features)) % folds
    models = []
    for k in range(labels.shape[1]):
        x = features[:, : len(words) + k]
        y = labels[:, k : k + 1].astype(np.float32)
        weights, bias = fit_logistic(x, y)
        models.append((weights[:, 0], float(bias[0])))
        if k == labels.shape[1] - 1:
            break
        for f in range(folds):
            w, b = fit_logistic(x, y, steps=FOLD_STEPS, held=fold == f)
            features[fold == f, len(words) + k] = sigmoid(x[fold == f] @ w[:, 0] + b[0])
    return Chain(words, np.ones(len(words), np.float32), models)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, chain=CHAIN, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, id_col: str = "doc_id", text_col: str = "text") -> Chain | None:
    """Fits a chain on at most `max_rows` labelled documents, those with the least hash of their id, and whole texts.

    `labels` has `id_col` too. Rows without an id or with a null label are left out; of an id's labels the largest
    count; of documents with one id, the `max_rows` rows with the least hash of id and text. None if nothing is
    labelled. Other columns are not read.
    """
    work = Workspace(spark, "toxicity")
    ids = labels.dropna(subset=[id_col, *(c for _, c, _ in chain)]).groupBy(F.col(id_col).alias("doc_id")).agg(*[F.max((F.col(c) == v).cast("int")).alias(f"y{k}") for k, (_, c, v) in enumerate(chain)])
    sample = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # bounded: may be broadcast
    ys = [f"y{k}" for k in range(len(chain))]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.orderBy(F.xxhash64("doc_id", "text")).limit(max_rows)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.stack([batch.column(c).to_numpy() for c in ys], 1)
            for begin, offsets, data in text_blocks(batch.column("text")):
                rows, hashes = letter_words(offsets, data)
                order = np.lexsort((hashes, rows))
                rows, hashes = rows[order], hashes[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
                own = y[begin + rows[new]]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[new].view(np.int64)), *(pa.array(own[:, k]) for k in range(len(ys)))], names=["word", *ys])

    texts = work.save(texts, "sample")
    types = ", ".join(f"{y} int" for y in ys)
    counted = texts.select("text", *ys).mapInArrow(words, f"word bigint, {types}").groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys])
    total = texts.agg(F.count(F.lit(1)), *[F.sum(y) for y in ys]).first()
    if not total[0]:
        return None
    # chi-square of a word's presence against each category; the largest counts
    scores = []
    for k, y in enumerate(ys):
        share = (total[k + 1] or 0) / total[0]
        spread = F.col("n") * F.lit(share * (1 - share)) * (1 - F.col("n") / F.lit(total[0] + 1.0)) + 0.5
        scores.append(F.pow(F.col(y) - F.col("n") * F.lit(share), 2) / spread)
    top = counted.where("n >= 3").withColumn("score", F.greatest(*scores) if len(scores) > 1 else scores[0]).where(F.col("score") >= LEAST_CHI2).orderBy(F.desc("score"), "word").limit(max_words).select("word").toArrow()
    known = np.sort(top["word"].to_numpy().view(np.uint64))
    shipped = spark.sparkContext.broadcast(known)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, offsets, data in text_blocks(batch.column("text")):
                n = len(offsets) - 1
                r, at, value = _found(*letter_words(offsets, data), shipped.value)
                ends = np.searchsorted(r, np.arange(n + 1))
                at, value = at.astype("<u2"), value.astype("<f2")
                rows = [at[a:b].tobytes() + value[a:b].tobytes() for a, b in itertools.pairwise(ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[begin : begin + n], *(batch.column(c)[begin : begin + n] for c in ys), pa.array(rows, pa.binary())], names=["doc_id", *ys, "x"])

    got = texts.mapInArrow(features, f"doc_id bigint, {types}, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "x").toArrow()
    x = np.zeros((got.num_rows, len(known) + len(ys) - 1), np.float32)
    for i, row in enumerate(got["x"]):
        own = row.as_buffer()
        half = own.size // 2
        x[i, np.frombuffer(own, "<u2", half // 2)] = np.frombuffer(own, "<f2", half // 2, half)
    y = np.stack([got[c].to_numpy() for c in ys], 1)
    del got
    work.drop("sample")
    chain_made = fit_chain(x, y, known)
    del x
    release()
    return chain_made


def score(spark: SparkSession, docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text", categories=CHAIN, reject: float = REJECT) -> DataFrame:
    """All columns of `docs` in the struct `doc`, p (a probability for each category) and rejected (the last's >= reject).

    Each row of `docs` is scored by its whole text, null as empty; rows without a known word have the probability of
    the bias; equal texts, ties and repeated rows included, have equal probabilities. Without a chain nothing is
    rejected and p is null. An empty table gives an empty result; columns of other names are carried and not read.
    """
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(chain)
    n_categories = len(categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for begin, offsets, data in text_blocks(batch.column("text")):
                n = len(offsets) - 1
                if model is None:
                    p, out = pa.nulls(n, pa.list_(pa.float64())), pa.array([False] * n)
                else:
                    values = np.concatenate([model.predict(_features(*letter_words(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]), b - a, model.words)) for a, b in ((a, min(n, a + 512)) for a in range(0, n, 512))])
                    p = pa.array(list(values.astype(np.float64)), pa.list_(pa.float64()))
                    out = pa.array(values[:, n_categories - 1] >= reject)
                yield pa.RecordBatch.from_arrays([batch.column("doc")[begin : begin + n], p, out], names=["doc", "p", "rejected"])

    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col(text_col).alias("text"))
    return whole.mapInArrow(run, f"doc {whole.schema['doc'].dataType.simpleString()}, p array<double>, rejected boolean")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chain = train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = score(spark, docs, chain)
    return got.select(F.col("doc.doc_id").alias("doc_id"), *[F.col("p")[k].alias(f"p_{name}") for k, (name, _, _) in enumerate(CHAIN)], "rejected")
