"""From raw documents to packed sequences: toxic documents go, of near copies one stays, secrets are blotted out, and what is
left is packed.  Each stage reads what the one before it has written."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from llm import near, packing, secrets, toxicity
from llm.common import prepare, scratch_path, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a model, fitted on the labelled ones among them, takes for toxic."""
    prepare(spark)
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect, that of the smallest doc_id.  Candidates come from the keys of the SimHash
    operator and from MinHash bands, and are links if their five-word shingles have a Jaccard likeness of 0.8 or more."""
    prepare(spark)
    return near.keep_one(docs)


def blotted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret, encoded ones too; n_chars follows the text."""
    prepare(spark)
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("simhash_dedup", near_copies), ("secret_scan", blotted), ("packing", packed)]

#: String kernels, SimHash and tokenizers are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
