"""Delivered hits, diagnostics, status, ranking version and request checks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def render_hits(selected: DataFrame, rankings: DataFrame, bodies: DataFrame, context: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """one nested row per hit. Texts are joined here, after selection, so rankings never carry them.

    ``selected(request_id, chunk_id, hit_rank, score, rerank_score)``; ``rankings(request_id, source, chunk_id, score)``;
    ``context(request_id, chunk_id, required_parts, context_state, context_omissions)``.
    """
    stages = rankings.groupBy("request_id", "chunk_id").agg(
        F.array_sort(F.collect_set("source")).alias("retrieval_sources"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("source", "score")))).alias("stage_scores"))
    rows = selected.join(stages, ["request_id", "chunk_id"], "left").join(context, ["request_id", "chunk_id"], "left").join(bodies, "chunk_id")
    rows = rows.withColumn("score_type", F.when(F.col("rerank_score").isNotNull(), "rerank").otherwise("rrf")).withColumn("score", F.coalesce("rerank_score", "score"))
    if relations is not None:
        found = relations.groupBy("request_id", "chunk_id").agg(F.array_sort(F.collect_set(F.struct("relation_id", "subject_id", "object_id", "relation_type", "stance"))).alias("relations"))
        rows = rows.join(found, ["request_id", "chunk_id"], "left")
    return rows.drop("rerank_score")


def diagnostics(stages: DataFrame, hits: DataFrame) -> DataFrame:
    """candidate counts per stage and delivered sizes per request.

    ``stages(request_id, stage, chunk_id)``; ``hits(request_id, source_text, context)``.
    """
    counts = stages.groupBy("request_id").agg(*[F.count_if(F.col("stage") == s).alias(s) for s in (
        "keyword", "vector", "relation", "union", "authoritative", "duplicate_removed", "reranked")])
    sizes = hits.groupBy("request_id").agg(
        F.count("*").alias("returned"), F.sum(F.length("source_text")).alias("source_text_chars"), F.sum(F.octet_length("source_text")).alias("source_text_bytes"),
        F.sum(F.length(F.coalesce("context", F.lit("")))).alias("context_chars"), F.sum(F.octet_length(F.coalesce("context", F.lit("")))).alias("context_bytes"))
    return counts.join(sizes, "request_id", "left").fillna(0)


def status(requests: DataFrame) -> DataFrame:
    """``requests(request_id, path, degraded boolean, hits, reranked, related, vector_ok)``."""
    return requests.withColumn("retrieval_status", F.when(F.col("degraded"), "degraded").when(F.col("hits") > 0, "ok").otherwise("not_found")).withColumn(
        "ranking_method", F.when(F.col("reranked"), "rrf_then_rerank").when((F.col("path") == "related") & F.col("related"), "rrf_related").when(
            (F.col("path") == "exact") | ~F.col("vector_ok"), "keyword_rrf").otherwise("rrf"))


def ranking_version(config: dict) -> Column:
    """hash of the ranking inputs that are not secret."""
    body = json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return F.concat(F.lit("sha256:"), F.sha2(F.lit(body), 256))


def check_requests(requests: DataFrame) -> DataFrame:
    """Violations ``request_id, code``.

    ``requests(request_id, question, kb_ids, entity_filter, entity_filters, selection_mode, selection_query, facet_texts,
    facet_starts, facet_ends, facet_ids, binding_ids, at_zoned, valid_from, valid_until)``.
    """
    distinct = lambda c: F.size(F.array_distinct(c)) == F.size(c)
    span_ok = F.forall(F.arrays_zip("facet_texts", "facet_starts", "facet_ends"), lambda x: (x["facet_ends"] <= F.length("question")) & (
        F.substring("question", x["facet_starts"] + 1, x["facet_ends"] - x["facet_starts"]) == x["facet_texts"]))
    rules = {
        "evidence_query_must_not_be_blank": F.length(F.trim("question")) > 0,
        "kb_ids_must_not_contain_duplicates": distinct("kb_ids"),
        "product_entity_filters_are_mutually_exclusive": F.col("entity_filter").isNull() | (F.size("entity_filters") == 0),
        "product_entity_ids_must_not_contain_duplicates": distinct("entity_filters"),
        "selection_inputs_require_adaptive_mode": (F.col("selection_mode") == "adaptive") | (F.col("selection_query").isNull() & (F.size("facet_texts") == 0)),
        "selection_inputs_must_not_be_blank": F.forall("facet_texts", lambda x: F.length(F.trim(x)) > 0),
        "facet_text_must_match_question_span": span_ok,
        "facet_ids_must_not_contain_duplicates": distinct("facet_ids"),
        "context_bindings_must_not_contain_duplicates": distinct("binding_ids"),
        "context_binding_conflicts_with_product_filter": (F.size("binding_ids") == 0) | F.col("entity_filter").isNull() | F.coalesce(
            (F.size("binding_ids") == 1) & (F.get("binding_ids", F.lit(0)) == F.col("entity_filter")), F.lit(True)),
        "relation_time_requires_timezone": F.coalesce("at_zoned", F.lit(True)),
        "relation_interval_must_be_ordered": F.coalesce(F.col("valid_until") > F.col("valid_from"), F.lit(True)),
    }
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return requests.select("request_id", F.explode(broken).alias("code"))
