"""Stored projections: the search projection, the document tree, and their checks."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.sources.stored import commit_tables, read_committed

TREE_BUCKETS = 64


def check_dataset(chunks: DataFrame, publications: DataFrame, cases: DataFrame, gold: DataFrame, dimension: int | None = None) -> DataFrame:
    """A3: integrity violations ``code, key`` of a loaded bundle."""
    def many(df: DataFrame, key: str, parent: str, code: str) -> DataFrame:
        return df.groupBy(key).agg(F.count_distinct(parent).alias("n")).where("n > 1").select(F.lit(code).alias("code"), F.col(key).cast("string").alias("key"))

    repeated = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_chunk_id").alias("code"), F.col("chunk_id").cast("string").alias("key"))
    cases_twice = cases.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_query_ids").alias("code"), F.col("query_id").cast("string").alias("key"))
    published = publications.join(chunks.select("document_id", F.col("version_id").alias("active_version_id")).distinct(), ["document_id", "active_version_id"], "left_anti").select(
        F.lit("publication_not_in_snapshot").alias("code"), F.col("document_id").cast("string").alias("key"))
    lost = gold.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select(F.lit("gold_chunk_not_in_snapshot").alias("code"), F.col("chunk_id").cast("string").alias("key"))
    out = repeated.unionByName(cases_twice).unionByName(published).unionByName(lost).unionByName(many(chunks, "document_id", "kb_id", "document_knowledge_base_mismatch")) \
        .unionByName(many(chunks, "version_id", "document_id", "version_document_mismatch")).unionByName(many(cases, "family", "split", "query_family_split_leakage"))
    if dimension is not None and "vector" in chunks.columns:
        out = out.unionByName(chunks.where(F.col("vector").isNotNull() & (F.size("vector") != dimension)).select(
            F.lit("corpus_vector_dimension_mismatch").alias("code"), F.col("chunk_id").cast("string").alias("key")))
    return out.distinct()


def write_projection(chunks: DataFrame, path: str, vectors: DataFrame | None = None) -> None:
    """The derived search rows, one folder per knowledge base.

    Rows are spread by knowledge base and a hash of the chunk before the write, so one large base becomes many files
    written by many tasks.
    """
    rows = chunks if vectors is None else chunks.join(vectors, "chunk_id", "left")
    spread = F.pmod(F.xxhash64("chunk_id"), F.lit(32))
    rows.repartition("kb_id", spread).write.mode("errorifexists").partitionBy("kb_id").parquet(path)


def verify_projection(expected: DataFrame, actual: DataFrame, columns=("version_id", "source_text", "search_text")) -> DataFrame:
    """Rows that are missing, extra or different; empty means the projection is proven."""
    fingerprint = F.xxhash64(*columns)
    left = expected.select("chunk_id", fingerprint.alias("want"))
    right = actual.select("chunk_id", fingerprint.alias("have"))
    return left.join(right, "chunk_id", "full_outer").where(~F.col("want").eqNullSafe(F.col("have"))).select(
        "chunk_id", F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").otherwise("changed").alias("problem"))


def delete_from_projection(projection: DataFrame, tombstones: DataFrame) -> DataFrame:
    """What is left after removing deleted documents, and only explicitly retired versions.

    ``tombstones(document_id, version_id)``; a null version removes the document.
    """
    whole = tombstones.where("version_id is null").select("document_id").distinct()
    versions = tombstones.where("version_id is not null").select("document_id", "version_id").distinct()
    return projection.join(whole, "document_id", "left_anti").join(versions, ["document_id", "version_id"], "left_anti")


def rebuild_generation(chunks: DataFrame, embed: Callable, path: str, batch_rows: int = 32) -> DataFrame:
    """Embed every chunk with an injected model and commit a new generation of the projection; the one before stays as it is.

    ``embed`` takes a list of texts and returns as many vectors; batches stay in order and a wrong count or a value that is
    not finite fails the task. The written rows are proven against what was asked before the generation becomes visible
    (``read_generation``). Returns the rows that differ; if there are any, the generation before is still the visible one.
    """
    def run(batches):
        import numpy as np

        for batch in batches:
            vectors = []
            for start in range(0, len(batch), batch_rows):
                texts = batch["search_text"].iloc[start:start + batch_rows].tolist()
                found = embed(texts)
                if len(found) != len(texts) or not np.isfinite(np.asarray(found, dtype="float64")).all():
                    raise ValueError("embedding_incomplete_or_not_finite")
                vectors.extend([list(map(float, v)) for v in found])
            yield batch[["chunk_id"]].assign(vector=vectors)

    id_type = chunks.schema["chunk_id"].dataType.simpleString()
    vectors = chunks.select("chunk_id", "search_text").mapInPandas(run, f"chunk_id {id_type}, vector array<float>")
    rows = chunks.join(vectors, "chunk_id", "left").repartition("kb_id", F.pmod(F.xxhash64("chunk_id"), F.lit(32)))
    problems = []

    def proven(table) -> bool:
        problems.append(verify_projection(chunks, table("projection")))
        return problems[0].isEmpty()

    commit_tables({"projection": rows}, path, {"projection": ["kb_id"]}, proven)
    return problems[0]


def read_generation(spark: SparkSession, path: str, commit: int | None = None) -> DataFrame:
    """Rows of the visible generation, or of an earlier commit."""
    return read_committed(spark, path, "projection", commit)


def graph_refusals(tables: dict[str, DataFrame], chunks: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """``version_id, code`` of trees that may not be stored.

    Units and chunks of a version must be the same; with ``graphs(version_id, source_hash, source_version_id)`` among the tables and
    ``versions(version_id, document_id, content_sha256)`` given, a tree must be of the content that its version has, and of the lineage of its document.
    """
    units = tables["units"].select("version_id", "chunk_id").withColumn("u", F.lit(1))
    have = chunks.select("version_id", "chunk_id").withColumn("c", F.lit(1))
    refused = units.join(have, ["version_id", "chunk_id"], "full_outer").where("u is null or c is null").select("version_id", F.lit("document_graph_units_mismatch").alias("code"))
    if "graphs" in tables and versions is not None:
        own = versions.select("version_id", "document_id", "content_sha256")
        source = versions.select(F.col("version_id").alias("source_version_id"), F.col("document_id").alias("source_document"))
        graphs = tables["graphs"].select("version_id", "source_hash", "source_version_id").join(own, "version_id", "left").join(source, "source_version_id", "left")
        lineage = F.col("source_version_id").isNotNull() & ~F.coalesce(F.col("source_document") == F.col("document_id"), F.lit(False))
        code = F.when(lineage, "document_graph_lineage_must_stay_in_document").when(~F.coalesce(F.col("source_hash") == F.col("content_sha256"), F.lit(False)), "document_graph_source_hash_mismatch")
        refused = refused.unionByName(graphs.select("version_id", code.alias("code")).where("code is not null"))
    return refused.distinct()


def write_graph(tables: dict[str, DataFrame], chunks: DataFrame, path: str, versions: DataFrame | None = None) -> DataFrame:
    """Commit the tree tables of versions as one set, behind one pointer.

    Returns the refused versions (``graph_refusals``); nothing is visible if there are any. ``tables``: nodes, edges, units, graphs, each with ``version_id``.
    """
    refused = graph_refusals(tables, chunks, versions)
    if refused.isEmpty():
        bucketed = {name: df.withColumn("version_bucket", F.pmod(F.xxhash64("version_id"), F.lit(TREE_BUCKETS))) for name, df in tables.items()}
        commit_tables(bucketed, path, dict.fromkeys(tables, ["version_bucket"]))
    return refused


def read_graph(spark: SparkSession, path: str, version_id: str, name: str = "nodes", commit: int | None = None) -> DataFrame:
    """One version of a tree table of the visible set in ordinal order; the bucket prunes to one folder."""
    rows = read_committed(spark, path, name, commit)
    bucket = F.pmod(F.xxhash64(F.lit(version_id)), F.lit(TREE_BUCKETS))
    found = rows.where((F.col("version_bucket") == bucket) & (F.col("version_id") == version_id)).drop("version_bucket")
    return found.orderBy("ordinal") if "ordinal" in found.columns else found
