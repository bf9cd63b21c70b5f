"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, suffix-array dedup, packing.

Each stage reads all that its predecessor kept. All but the last return the columns of `documents`; the last returns
the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import exact_dedup, ngram_join, packing, suffix_dedup, toxicity
from evidra.llm.storage import Workspace


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a chain trained on `labels` rejects.

    Each row is judged by its whole text, so repeated rows and ties go or stay together. Null and empty texts are
    scored by the bias alone and stay; null ids stay or go by their text and are never trained on. Without documents
    the result is empty; without labels all stay. Extra columns, whatever their names, are kept and not read.
    """
    chain = toxicity.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(spark, docs, chain).where("not rejected").select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for the case of A-Z, the one with the largest id stays.

    Null texts count as empty, so one row of all null and empty texts stays; null ids are less than all others; of
    repeated rows the last by file and row stays. Long texts are compared whole. An empty table gives an empty one.
    Extra columns, whatever their names, are kept and not read.
    """
    return exact_dedup.drop_copies(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by their 5-word shingles at a similarity of 0.8, one row with the least id stays.

    Rows without words, null texts included, stay, and so do rows without an id that are linked with nothing. Repeated
    rows are copies of each other: one stays. An empty table gives an empty one. Extra columns, whatever their names,
    are kept and not read.
    """
    return ngram_join.drop_near_copies(spark, docs, size=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words or more that also start elsewhere out of the texts, wherever they stand.

    n_chars follows the text. Null texts stay null and empty ones empty; texts under 50 words stay as they are, and of
    repeated rows all repeated passages go. A row stays even if nothing is left of its text. An empty table gives an
    empty one. Extra columns, whatever their names, are kept and not read.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "n_chars"))
    got = suffix_dedup.remove_repeats(spark, docs, width=suffix_dedup.PASSAGE, gram=suffix_dedup.PASSAGE_GRAM, words=True, carry=rest)
    text = F.when(F.col("rest.text").isNotNull(), F.col("kept").cast("string"))
    new = {"doc_id": F.col("id"), "text": text, "n_chars": F.length(text).cast("bigint")}
    return got.select(*[new.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens: one row for each piece of a document.

    Null and empty texts are the end token alone; texts over 4096 tokens are cut into several pieces. Repeated rows
    each have pieces of their own. An empty table gives an empty result. Extra columns are not read.
    """
    import public_tokenizers

    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", reject_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("suffix-array dedup", cut_repeats), ("packing", pack)]
#: A trained model and a tokenizer are no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what each stage keeps is written and read again by the next."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.save(docs, f"stage-{k}")
    return docs
