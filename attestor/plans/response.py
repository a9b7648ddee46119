"""Registered queries: the response path from request filters to delivered hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import fusion, render
from attestor.plans.bindings import document_rows, requests, table
from attestor.plans.retrieval import NO_STRINGS, SUBJECTS, AT, fused_hits, keyword_ranking, relation_tables, second_ranking, supplier_seeds, three_rankings


def request_filter(spark, d):
    """Every benchmark text as a request with its own filters; documents under 300 characters stand for headings."""
    chunks = table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("kb_id"), F.col("source").alias("document_id"), F.col("lang").alias("category"),
        F.when(F.col("n_chars") < 300, "heading").otherwise("text").alias("block_kind"), F.lit("resolved").alias("scope_status"),
        F.expr(SUBJECTS.format("lang")).alias("subjects"), F.expr(NO_STRINGS).alias("identifiers"))
    item = F.col("request_id")
    asked = requests(spark, d).select(
        "request_id", "kb_ids", F.when(item % 3 == 0, F.array(F.lit("src1"), F.lit("src7"))).alias("document_ids"), F.when(item % 2 == 0, "en").alias("category"),
        F.lit(None).cast("string").alias("product_model"), F.lit(None).cast("string").alias("software_version"), F.lit(None).cast("array<string>").alias("entity_ids"),
        F.lit(None).cast("array<string>").alias("query_identifiers"))
    allowed = fusion.request_filter(asked, chunks)
    return allowed.groupBy("request_id").agg(F.count("*").alias("allowed"), F.sum("chunk_id").alias("id_sum"))


def relation_ranking(spark, d):
    """Relations of each nation's suppliers, ordered by the overlap of a question with the order's priority and status."""
    relations, evidence = relation_tables(spark, d)
    rows = fusion.expand_relations(supplier_seeds(spark, d), relations, evidence, "outgoing", 30, F.expr(AT))
    asked = rows.select("request_id").distinct().withColumn("query", F.lit("1-URGENT order in state F"))
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("source_text"), F.col("o_orderstatus").alias("title_text"))
    return fusion.rank_relations(rows, asked, chunks).select("request_id", "chunk_id", "overlap", "rank")


def _fused_texts(spark, d, lists=None):
    return fused_hits(spark, d, lists=lists).join(document_rows(spark, d).select("chunk_id", "search_text", "lang"), "chunk_id").join(requests(spark, d).select("request_id", "query"), "request_id")


def rerank_order(spark, d):
    """A scorer that stands for a model: text length modulo 97."""
    out = fusion.rerank(_fused_texts(spark, d).drop("sources"), lambda batch: (batch["search_text"].str.len() % 97).astype(float), top_k=8, window=30)
    return out.select("request_id", "chunk_id", "position", "rerank_score")


def refill_cutoff(spark, d):
    """Spanish documents count as filtered out; every fourth request misses a facet."""
    counts = _fused_texts(spark, d).groupBy("request_id").agg(F.count_if(F.col("lang") == "es").alias("filtered"), F.count_if((F.col("lang") != "es") & (F.col("position") <= 12)).alias("kept"))
    asked = counts.select("request_id", F.lit(8).alias("top_k"), "filtered", "kept", (F.col("request_id") % 4 == 0).alias("missing_facets"))
    return fusion.refill_cutoff(asked).select("request_id", "refilled", "limit")


def final_revalidation(spark, d):
    """French documents and all relation hits are gone after the model calls; even requests were reranked."""
    lists = three_rankings(spark, d)
    rows = _fused_texts(spark, d, lists).where("position <= 20").select("request_id", "chunk_id", "score", F.when(
        F.col("request_id") % 2 == 0, (F.length("search_text") % 97).cast("double")).alias("rerank_score"))
    current = document_rows(spark, d).where("lang <> 'fr'")
    out = fusion.revalidate(rows, lists.where("source <> 'relation'"), current)
    return out.select("request_id", "chunk_id", "position", F.round("score", 8).alias("score"))


def delivered_hits(spark, d):
    """The best eight documents of each question with their sources, scores and context state."""
    lists = three_rankings(spark, d)
    fused = fused_hits(spark, d, 8, lists)
    selected = fused.select("request_id", "chunk_id", F.col("position").alias("hit_rank"), "score", F.when(F.col("request_id") % 2 == 0, F.col("position") / 10.0).alias("rerank_score"))
    rankings = lists.withColumn("score", F.col("rank").cast("double"))
    context = selected.select("request_id", "chunk_id", F.array("chunk_id").alias("required_parts"), F.when(F.col("chunk_id") % 3 == 0, "complete").otherwise("disabled").alias("context_state"),
                              F.expr(NO_STRINGS).alias("context_omissions"))
    out = render.render_hits(selected, rankings, document_rows(spark, d).select("chunk_id", "source_text"), context)
    return out.select("request_id", "chunk_id", "hit_rank", F.array_join("retrieval_sources", ",").alias("sources"), F.coalesce(F.element_at("stage_scores", F.lit("keyword")), F.lit(-1.0)).alias("keyword_rank"),
                      "score_type", F.round("score", 8).alias("score"), "context_state", F.md5("source_text").alias("text_digest"))


def response_diagnostics(spark, d):
    """Candidates per stage and delivered sizes of each question."""
    lists = three_rankings(spark, d)
    stages = lists.select("request_id", F.col("source").alias("stage"), "chunk_id").unionByName(lists.select("request_id", F.lit("union").alias("stage"), "chunk_id").distinct())
    hits = fused_hits(spark, d, 8, lists).join(document_rows(spark, d), "chunk_id").select("request_id", "source_text", F.when(F.col("chunk_id") % 2 == 0, F.col("lang")).alias("context"))
    return render.diagnostics(stages, hits).select("request_id", "keyword", "vector", "relation", "union", "reranked", "returned", "source_text_chars", "source_text_bytes", "context_chars", "context_bytes")


def response_status(spark, d):
    """Status and ranking method of each question; whether a stage failed follows from the question's number."""
    hits = keyword_ranking(spark, d, 8).unionByName(second_ranking(spark, d, 8)).groupBy("request_id").agg(F.count("*").alias("hits"))
    item = F.col("request_id")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("request_id")).join(hits, "request_id", "left").fillna(0, ["hits"]).select(
        "request_id", "hits", F.when(item % 5 == 0, "exact").when(item % 5 == 1, "related").otherwise("hybrid").alias("path"), (item % 7 == 0).alias("degraded"), (item % 2 == 0).alias("reranked"),
        (item % 4 == 1).alias("related"), (item % 3 != 0).alias("vector_ok"))
    return render.status(asked).select("request_id", "retrieval_status", "ranking_method")


QUERIES = {f.__name__: f for f in (
    request_filter, relation_ranking, rerank_order, refill_cutoff, final_revalidation, delivered_hits, response_diagnostics, response_status)}
