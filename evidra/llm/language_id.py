"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; a binary linear classifier for each bit is trained on hashed byte trigrams. A document's
bits are decoded by weighted losses: for each language the losses of the classifiers at the language's bits, weighted
by how well each classifier does on that language in training. The least loss wins; a small distance to the second
flags the document as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .linear import fit_logistic
from .storage import bounded_batches
from .textops import lower_ascii, text_blocks

#: Labelled documents that a fit reads, in equal parts for each language (one at least), and hash buckets of n-grams.
MAX_ROWS, BUCKETS = 3_000, 4_096
AMBIGUOUS = 0.2
_LETTER = regex.compile(r"\p{L}").search


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows sum to 1

    def decode(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score (0 to 1) and margin of each row."""
        if len(self.languages) == 1:
            n = len(features)
            return np.zeros(n, int), np.ones(n), np.full(n, np.inf)
        margins = features @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margins * word) * trust).sum(1) for word, trust in zip(self.code, self.trust, strict=True)], 1)
        best = loss.argmin(1)
        ordered = np.sort(loss, 1)
        share = np.exp(-len(self.code[0]) * (loss - ordered[:, :1]))
        return best, 1 / share.sum(1), ordered[:, 1] - ordered[:, 0]


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n x bits of -1 and 1: all non-trivial splits of up to five languages; else the best of some random dense codes."""
    if n <= 5:
        columns = [c for c in itertools.product((-1, 1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).reshape(-1, n).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    tries = [rng.choice(np.array([-1, 1], np.int8), (n, bits)) for _ in range(50 if n <= 300 else 3)]
    tries = [t for t in tries if not (np.abs(t.sum(0)) == n).any()] or tries

    def closest(t: np.ndarray) -> float:  # the least distance of two codewords, by their inner products
        alike = t.astype(np.float32) @ t.T.astype(np.float32)
        np.fill_diagonal(alike, -bits)
        return -float(alike.max())

    return max(tries, key=closest)


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Square roots of trigram shares of each row; digits and repeated spaces count as other bytes do."""
    low = lower_ascii(data).astype(np.uint32)
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    if len(low) < 3:
        return out
    code = ((low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA6B)) ^ (low[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
    bucket = (code >> np.uint32(20)).astype(np.int64)
    for i, (a, b) in enumerate(itertools.pairwise(offsets.tolist())):
        if b - a >= 3:
            out[i] = np.sqrt(np.bincount(bucket[a : b - 2], minlength=BUCKETS) / np.float32(b - a - 2))
    return out


def fit(x: np.ndarray, languages: list[str]) -> Model | None:
    """x is scaled in place."""
    if not languages:
        return None
    names = sorted(set(languages))
    place = {name: i for i, name in enumerate(names)}
    y = np.array([place[l] for l in languages])
    code = codewords(len(names))
    if len(names) == 1:
        return Model(names, code, np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros((1, 0)))
    x *= 8
    weights, bias = fit_logistic(x, (code[y] > 0).astype(np.float32), penalty=1e-4, steps=200)
    right = (x @ weights + bias) * code[y] > 0
    trust = np.stack([right[y == k].mean(0) for k in range(len(names))])
    trust = np.maximum(trust, 1e-3)
    return Model(names, code, weights * 8, bias, trust / trust.sum(1, keepdims=True))


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def train(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Model | None:
    """Learns from text and non-null language of documents that aren't held out.

    Of each language the same number of documents is read, max_rows by the number of languages and one at least: those
    with the least hash of their id. So no language is left out, however rare, and frequent ones don't fill the
    sample. Repeated ids and rows count as others do, up to that number. None if there is no such document.
    """
    bounded_batches(spark)
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    own = usable.select(F.xxhash64(F.col(id_col).cast("bigint")).alias("key"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    n_languages = own.agg(F.count_distinct("lang")).first()[0]
    if not n_languages:
        return None
    each = max(1, max_rows // n_languages)
    salt = F.expr(f"pmod(key, {int(spark.conf.get('spark.sql.shuffle.partitions'))})")
    first = lambda df, *keys: df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("key"))).where(F.col("n") <= each).drop("n")
    keys = own.select("lang", "key").withColumn("salt", salt)
    edges = first(first(keys, "lang", "salt"), "lang").groupBy("lang").agg(F.max("key").alias("edge"))
    sample = own.join(F.broadcast(edges), "lang").where("key <= edge")  # a row for each language, as in the model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, offsets, data in text_blocks(batch.column("text")):
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column("id")[begin : begin + n], batch.column("lang")[begin : begin + n], pa.array([r.astype(np.float16).tobytes() for r in features(offsets, data)], pa.binary())], names=["id", "lang", "x"])

    made = sample.mapInArrow(run, "id bigint, lang string, x binary").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "x")))
    got = made.where(F.col("n") <= each).orderBy(F.xxhash64("id"), "id", "lang", "x").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(got.num_rows, BUCKETS).astype(np.float32)
    return fit(x, got["lang"].to_pylist())


def predict(spark: SparkSession, docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score (0 to 1), ambiguous of each row of `docs`, by its whole text alone.

    `und` with score 0 where the text is null or has no letter (\\p{L}), and everywhere if there is no model. An empty table
    gives an empty result; a null id is not held out. Other columns are not read.
    """
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            for begin, offsets, data in text_blocks(batch.column("text")):
                n = len(offsets) - 1
                memory = data.tobytes()
                letters = np.array([bool(_LETTER(memory[a:b].decode())) for a, b in itertools.pairwise(offsets.tolist())])
                names, scores, unsure = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
                if known is not None and letters.any():
                    best, score, margin = known.decode(features(offsets, data))
                    names[letters] = np.array(known.languages, object)[best[letters]]
                    scores[letters], unsure[letters] = score[letters], margin[letters] < AMBIGUOUS
                part = slice(begin, begin + n)
                yield pa.RecordBatch.from_arrays([batch.column("id")[part], batch.column("held_out")[part], pa.array(names.tolist(), pa.string()), pa.array(scores), pa.array(unsure)], names=["id", "held_out", "lang_pred", "score", "ambiguous"])

    own = docs.select(F.col(id_col).cast("bigint").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(spark, docs, train(spark, docs)).withColumnRenamed("id", "doc_id")
