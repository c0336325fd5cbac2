"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontamination, secrets, sentencepiece_codec, simhash, toxicity
from strandline.llm.common import materialise, table, tune, unused_name

#: Rounds of the toxicity verdict: a document goes from this score on.
TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score stays below TOXIC_FROM.

    The model is fitted on the labelled rows of the documents given that are not held out; a null text scores as an empty one.
    """
    tune(spark)
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    column = unused_name(docs, "score")
    return toxicity.score(docs, lexicon, column).where(F.col(column) < TOXIC_FROM).drop(column)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates by SimHash: the one with the least doc_id (of rows that share it, one of the least text hash)."""
    tune(spark)
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark table."""
    tune(spark)
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark."""
    tune(spark)
    return secrets.redact_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document: its token ids, their number and check sums, and whether they give the normalised text back."""
    tune(spark)
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("sentencepiece", encode_tokens),
]

#: No SQL has SimHash, Aho-Corasick scores or the tokenizer; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
