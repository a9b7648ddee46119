"""The driver's tables seen as the engine's tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


TEXT_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. A text table that arrives in fewer splits than there are cores is spread first, because its
    rows are expensive to tokenise; on a large input the scan has enough splits and nothing is shuffled."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if name in TEXT_KEYS:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            keys = ["conv_id", "turn"] if name == "conversations" else [TEXT_KEYS[name]]
            return df.repartition(cores, *keys)
    return df


def document_rows(spark, sf_dir) -> DataFrame:
    """Whole documents as chunks; ``kb_id`` is the source."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("kb_id"), "lang",
        F.col("text").alias("source_text"), F.col("text").alias("search_text"),
    )


def line_chunks(spark, sf_dir) -> DataFrame:
    """Non-empty lines of the documents as chunks."""
    return (
        table(spark, sf_dir, "documents")
        .select(F.col("doc_id").alias("document_id"), F.col("source").alias("kb_id"), "lang",
                F.posexplode(F.split("text", "\n")).alias("ordinal", "source_text"))
        .where(F.trim("source_text") != "")
        .select((F.col("document_id") * 100000 + F.col("ordinal")).alias("chunk_id"), "document_id", "kb_id", "lang",
                F.col("ordinal").cast("long").alias("ordinal"), "source_text", F.col("source_text").alias("search_text"))
    )


def requests(spark, sf_dir) -> DataFrame:
    """Benchmark texts as questions over every knowledge base."""
    kbs = table(spark, sf_dir, "documents").groupBy().agg(F.array_sort(F.collect_set("source")).alias("kb_ids"))
    return (
        table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.col("text").alias("query"))
        .join(F.broadcast(kbs), F.lit(True))  # one aggregated row
        .withColumn("mode", F.lit(None).cast("string"))
    )
