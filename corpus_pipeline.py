"""A training-data pipeline over ``documents``: quality rules, toxicity, near duplicates, benchmark decontamination and
byte-level BPE. Each stage reads all that its predecessor kept, written as Parquet and read again. An empty table stays
empty in every stage; columns that ``documents`` has besides its own are kept by all but the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import bpe, decontaminate, jaccard, quality, toxicity
from ledgerline.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail a base rule or are outliers of their language and source: null, empty and short texts go;
    repeated rows stay or go together; a null language or source is a value of its own."""
    return quality.keep_good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents predicted toxic; the model learns from labelled documents among ``docs``. Null and empty texts are
    scored as texts without words, repeated rows alike; without labels nothing is toxic."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold=~toxicity.held_out())
    return toxicity.drop_toxic(docs, net)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group linked by shingle similarity. Rows without an id or without words
    stay; of rows equal in id and shingles one stays."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a test item; null and empty texts hold none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left, one row for each; a null text is
    empty."""
    return bpe.digests(bpe.encode_documents(docs, decode=True))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level bpe", byte_bpe),
]

#: Trained models and token merges are beyond SQL; a test compares the run with plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
