"""Lexical and vector search for a whole table of requests at once.

Lexical search reads stored postings (``postings``), vectors are compared in blocks (``ann``); only the best ``k`` per request and
block travel.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as tx
from attestor.functions.vectors import usable
from attestor.operators import ann, postings
from attestor.session import broadcast_bounded, fits_broadcast

# The identifier route and field boosts.
EXACT_PATTERN = r"^(?:[A-Za-z][A-Za-z0-9_.:/+-]*\d[A-Za-z0-9_.:/+-]*|[A-Z][A-Z0-9_./:-]{2,})$"
FIELD_BOOSTS = {"source_text": 3.0, "title": 1.0, "scope": 1.5, "table_labels": 1.0, "document_name": 0.25}

# Scores are rounded before ranking, so the order of a distributed sum cannot change a rank.
RANK_DIGITS = 6


def route(requests: DataFrame, pattern: str = EXACT_PATTERN) -> DataFrame:
    """the caller's mode wins; otherwise an identifier goes the exact way."""
    mode = F.coalesce(F.col("mode"), F.lit("auto"))
    identifier = F.trim("query").rlike(pattern)
    return requests.withColumn(
        "path",
        F.when(mode != "auto", mode).when(identifier, "exact").otherwise("hybrid"),
    ).withColumn(
        "route_reason",
        F.when(mode != "auto", F.concat(F.lit("caller_requested_"), mode))
        .when(identifier, "auto_exact_identifier").otherwise("auto_natural_language"),
    )


def top_k(scored: DataFrame, k: int, score: str = "score", id_col: str = "chunk_id",
          digits: int = RANK_DIGITS) -> DataFrame:
    """Rank by score descending, id ascending. Spark keeps only ``k`` rows per task before the shuffle."""
    order = Window.partitionBy("request_id").orderBy(F.round(score, digits).desc(), F.col(id_col).asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(requests: DataFrame, index: postings.PostingIndex, k: int = 50) -> DataFrame:
    """``requests(request_id, query, kb_ids)`` against a stored index of one field; N, df and average length over the request's bases."""
    return postings.ranked(requests, index, k)


def bm25_fields(requests: DataFrame, index: postings.PostingIndex, boosts: dict[str, float] | None = None, k: int = 50) -> DataFrame:
    """the best boosted field gives the score."""
    return postings.ranked(requests, index, k, boosts=boosts or FIELD_BOOSTS)


def keyword_logtf(requests: DataFrame, index: postings.PostingIndex, k: int = 50) -> DataFrame:
    """sum of (1 + ln tf) times the term's count in the query; no idf. The index has the token rule of this score (``dev``)."""
    return postings.ranked(requests, index, k, kind="logtf")


def exact_search(requests: DataFrame, chunks: DataFrame, index: postings.PostingIndex, k: int = 50) -> DataFrame:
    """phrase or exact identifier search.

    ``chunks(chunk_id, kb_id, identifiers, models, versions)``. A query that is one identifier matches identifier terms
    only. Other queries match an exact model or version (score 5), or the phrase, token behind token in a field of ``index`` (score 1).
    """
    scoped, kbs = postings.scopes(requests)  # bases are checked by scope after the term join, so no request is repeated per base
    asked = scoped.select("request_id", "scope_id", F.trim("query").alias("query"), "kb_ids").withColumn("lowered", F.lower("query"))
    own = tx.identifier_terms(F.col("query"))
    asked = asked.withColumn("single", (F.size(own) == 1) & (F.get(own, F.lit(0)) == tx.fold(F.col("query"))))
    bases = broadcast_bounded(kbs, kbs)  # one row per scope and base, however many requests share a scope

    def by_term(terms: Column, wanted: DataFrame, score: float) -> DataFrame:
        found = chunks.select("chunk_id", "kb_id", F.explode(terms).alias("term")).join(broadcast_bounded(wanted, requests), "term")
        return found.join(bases, ["scope_id", "kb_id"]).select("request_id", "chunk_id", F.lit(score).alias("score"))

    by_identifier = by_term(F.col("identifiers"), asked.where("single").select("request_id", "scope_id", F.col("lowered").alias("term")), 1.0)
    by_field = by_term(F.array_distinct(F.concat("models", "versions")), asked.where("not single").select("request_id", "scope_id", F.col("query").alias("term")), 5.0)
    by_phrase = postings.phrases(asked.where("not single").select("request_id", "query", "kb_ids"), index).withColumn("score", F.lit(1.0))
    hits = (
        by_identifier.unionByName(by_field).unionByName(by_phrase)
        .groupBy("request_id", "chunk_id").agg(F.sum("score").alias("score"))
    )
    return top_k(hits, k).select("request_id", "chunk_id", "rank", "score")


# --- vectors -------------------------------------------------------------------------

KNN_BATCH_REQUESTS = 4096


def check_vectors(df: DataFrame, column: str, dimension: int) -> DataFrame:
    """F8/F9 guard: a vector that is not finite, zero or of another dimension is an error, not a miss."""
    return df.withColumn(
        column,
        F.when(usable(F.col(column), dimension), F.col(column)).otherwise(F.raise_error(F.lit("invalid_vector"))),
    )


def knn(requests: DataFrame, vectors: DataFrame | None, k: int = 20, dimension: int | None = None, method: str = "exact",
        index: ann.CentroidIndex | None = None) -> DataFrame:
    """F8: cosine top-k. ``requests(request_id, vector)``, ``vectors(vec_id, vector)``.

    ``method="exact"``: up to ``KNN_BATCH_REQUESTS`` requests travel to the vectors: each Arrow batch is one
    matrix product and yields at most ``k`` rows per request, so vectors never move. More requests are compared in blocks
    of bounded size. ``method="centroids"``: only the lists of ``index`` that a request probes are compared; scores are exact,
    neighbours in other lists are missed (``index.probes`` sets how many). With a ``kb_id`` column on both sides only vectors of the
    request's knowledge base count.
    """
    if method not in ("exact", "centroids"):
        raise ValueError(f"unknown_method {method}")
    scoped = "kb_id" in requests.columns and (vectors is None or "kb_id" in vectors.columns)
    if not scoped:
        requests = requests.withColumn("kb_id", F.lit(""))
    if dimension is not None:
        requests = check_vectors(requests, "vector", dimension)
    asked = requests.select(F.col("request_id").cast("string").alias("request_id"), "vector", F.col("kb_id").cast("string"))
    if method == "centroids":
        asked = asked.withColumn("vector", F.col("vector").cast("array<double>"))
        return top_k(index.candidates(asked, k), k, id_col="vec_id").select("request_id", "vec_id", "rank", "score")
    if not scoped:
        vectors = vectors.withColumn("kb_id", F.lit(""))
    if dimension is not None:
        vectors = check_vectors(vectors, "vector", dimension)
    vectors = vectors.select(F.col("vec_id").cast("long"), "vector", F.col("kb_id").cast("string"))
    if fits_broadcast(asked, KNN_BATCH_REQUESTS):
        rows = asked.orderBy("request_id").collect()  # bounded by the check above
        request_ids = [r["request_id"] for r in rows]
        if not rows:
            return vectors.sparkSession.createDataFrame([], "request_id string, vec_id long, rank int, score double")
        handle = vectors.sparkSession.sparkContext.broadcast((ann.unit([r["vector"] for r in rows]), np.asarray([r["kb_id"] for r in rows])))

        def score(batches):
            unit_requests, kbs = handle.value
            for batch in batches:
                if len(batch):
                    similarity = np.clip(unit_requests @ ann.unit(batch["vector"]).T, -1.0, 1.0)
                    similarity[kbs[:, None] != batch["kb_id"].to_numpy()[None, :]] = np.nan
                    yield ann.best(batch["vec_id"].to_numpy(), similarity, k, request_ids)

        local = vectors.mapInPandas(score, ann.SCORED)
    else:
        local = ann.in_blocks(asked, vectors, k, ["kb_id"])
    return top_k(local, k, id_col="vec_id").select("request_id", "vec_id", "rank", "score")


def valid_candidates(rows: DataFrame, limit: int) -> DataFrame:
    """finite scores only, first occurrence per id, at most ``limit``; a bad score is an error.

    ``rows(request_id, chunk_id, position, score)``.
    """
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    checked = rows.withColumn(
        "score", F.when(finite, F.col("score")).otherwise(F.raise_error(F.lit("candidate_score_not_finite"))))
    first = checked.groupBy("request_id", "chunk_id").agg(F.min_by("score", "position").alias("score"), F.min("position").alias("position"))
    order = Window.partitionBy("request_id").orderBy("position", "chunk_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("position")
