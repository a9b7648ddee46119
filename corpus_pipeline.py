"""A corpus pipeline of the training-data operators, each stage written as Parquet and read again by the next.

Toxic documents go, of equal texts one stays, of each near-duplicate group one stays, sources are mixed to their target weights
(a document taken twice is there twice), and what is left is encoded and decoded. Rows keep the columns of ``documents`` up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestor.llm import byte_bpe, dedup, mixing, near_copies, toxicity
from attestor.llm.common import new_folder, only_rows, read, with_row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, does not reject."""
    return toxicity.keep_clean(docs, toxicity.fit(toxicity.labelled_documents(docs, read(spark, sf_dir, "labels"))))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    tagged = with_row(docs)
    return only_rows(tagged, dedup.exact_groups(tagged).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles, among candidates of op7's SimHash fingerprints and of minimum hashes."""
    return near_copies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.sample_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, their number, and whether decoding gives the text's bytes back."""
    return byte_bpe.coded(docs.select("doc_id", "lang", "source", "n_chars", "text"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("source_mix", mix_sources), ("byte_bpe", encode)]
# A fitted model, fingerprints with components, and a tokenizer are not expressible in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
