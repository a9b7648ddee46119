"""Registered queries: search, fusion, selection, relations and context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions import text as tx
from attestor.operators import ann, decision, evaluation, fusion, postings, search, selection
from attestor.plans.bindings import document_rows, line_chunks, requests, table
from attestor.sources.stored import cut, stored

SUBJECTS = ("array(named_struct('entity_id', {0}, 'display_name', {0}, 'product_model', cast(null as string), "
            "'software_version', cast(null as string), 'source_kind', 'curated'))")
NO_STRINGS = "cast(array() as array<string>)"
LINK = ("struct<chunk_id:bigint,role:string,required:boolean,provenance:struct<kind:string,source_unit_id:string,"
        "target_unit_id:string,provenance_id:string,reference_text:string>>")


def guided_documents(spark, d) -> DataFrame:
    """Documents that begin with the name of their language's guide; every seventh refers to it."""
    guide = F.concat("lang", F.lit("-guide"))
    text = F.concat(F.when(F.col("doc_id") % 7 == 0, F.lit("See ")).otherwise(F.lit("")), guide, F.lit(". "), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("kb_id"), F.col("doc_id").alias("document_id"), "lang",
                                              text.alias("source_text"), text.alias("search_text"))


def index_of(spark, d, kind="documents") -> postings.PostingIndex:
    """A stored index of the documents or their lines; built once for a state of the table."""
    title = F.get(F.split("source_text", "\n"), F.lit(0))
    labels = F.array_join(F.filter(F.split("source_text", "\n"), lambda x: F.contains(x, F.lit("|"))), " ")
    fields = {"source_text": F.col("source_text"), "title": title, "scope": F.col("lang"), "table_labels": labels, "document_name": F.col("kb_id")}
    chunks = {"lines": line_chunks, "guided": guided_documents}.get(kind, document_rows)
    path = stored(spark, kind, [f"{d}/documents.parquet"], lambda path: postings.build_index(
        chunks(spark, d), path, fields if kind == "fields" else None, "dev" if kind == "dev" else "corpus"))
    return postings.open_index(spark, path)


def keyword_ranking(spark, d, k=50) -> DataFrame:
    return search.bm25(requests(spark, d), index_of(spark, d), k)


def second_ranking(spark, d, k=50) -> DataFrame:
    return search.keyword_logtf(requests(spark, d), index_of(spark, d, "dev"), k)


def bm25_topk(spark, d):
    hits = search.bm25(requests(spark, d), index_of(spark, d, "lines"), 50)
    return hits.select("request_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


def bm25_fields_topk(spark, d):
    hits = search.bm25_fields(requests(spark, d), index_of(spark, d, "fields"), k=20)
    return hits.select("request_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


def keyword_logtf_topk(spark, d):
    return second_ranking(spark, d).select("request_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


def identified_documents(spark, d):
    """``chunk_id, kb_id, identifiers`` of the documents, found once and written, since requests and search both read them."""
    return cut(document_rows(spark, d).select("chunk_id", "kb_id", tx.identifier_terms(F.col("source_text")).alias("identifiers")))


def identifier_requests(spark, d, found=None):
    """Every identifier term of the documents as an exact question, and every benchmark text as a phrase."""
    base = requests(spark, d)
    kbs = base.select("kb_ids").limit(1)
    found = identified_documents(spark, d) if found is None else found
    terms = found.select(F.explode("identifiers").alias("query")).distinct()
    return terms.join(F.broadcast(kbs), F.lit(True)).select(F.col("query").alias("request_id"), "query", "kb_ids").unionByName(
        base.select(F.concat(F.lit("item-"), "request_id").alias("request_id"), "query", "kb_ids"))


def exact_identifier_search(spark, d):
    found = identified_documents(spark, d)
    chunks = found.withColumns({"models": F.expr(NO_STRINGS), "versions": F.expr(NO_STRINGS)})
    hits = search.exact_search(cut(identifier_requests(spark, d, found)), chunks, index_of(spark, d), 50)
    return hits.select("request_id", "chunk_id", "rank", "score")


def query_route(spark, d):
    asked = identifier_requests(spark, d).withColumn("mode", F.lit(None).cast("string"))
    return search.route(asked).groupBy("path", "route_reason").agg(F.count("*").alias("requests"))


def knn_cosine_topk(spark, d):
    """Every label's mean vector asks for its nearest vectors."""
    vectors = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    places = vectors.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    asked = places.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    hits = search.knn(asked.select(F.col("label").cast("string").alias("request_id"), "vector"), vectors, 20, dimension=64)
    rows = search.valid_candidates(hits.select("request_id", F.col("vec_id").alias("chunk_id"), F.col("rank").alias("position"), "score"), 20)
    return rows.select(F.col("request_id").cast("int").alias("request_id"), F.col("chunk_id").alias("vec_id"), "rank", F.round("score", 4).alias("score"))


def knn_recall(spark, d):
    """Vectors whose id is divisible by 20 ask a centroid index of all vectors, keyed by label: neighbours that the exact search finds, whether nine in ten are reached, and hits without an exact score."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("kb_id"), F.col("embedding").cast("array<double>").alias("vector"))
    path = stored(spark, "centroids", [f"{d}/embeddings.parquet"], lambda path: ann.build_centroid_index(vectors, path, target=0.99))
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("request_id"), "kb_id", "vector")
    exact = search.knn(asked, vectors, 20, dimension=64).select("request_id", "vec_id", F.round("score", 6).alias("wanted"))
    found = search.knn(asked, None, 20, dimension=64, method="centroids", index=ann.load_centroid_index(spark, path)).select("request_id", "vec_id", F.round("score", 6).alias("score"))
    both = exact.join(found, ["request_id", "vec_id"], "full").join(asked.select(F.col("request_id").cast("string").alias("request_id"), "kb_id"), "request_id")
    return both.groupBy("kb_id").agg(
        F.count_distinct("request_id").alias("requests"), F.count("wanted").alias("neighbours"), (F.count_if(F.col("score").isNotNull() & F.col("wanted").isNotNull()) >= 0.9 * F.count("wanted")).alias("reached"),
        F.count_if(F.col("score") != F.col("wanted")).alias("wrong"))


def rrf_hybrid(spark, d):
    """Flagship: BM25 and log-TF rankings of the documents, fused; best eight per question."""
    both = keyword_ranking(spark, d).select("request_id", "chunk_id", "rank").unionByName(
        second_ranking(spark, d).select("request_id", "chunk_id", "rank"))
    fused = fusion.rank_fused(fusion.rrf(both)).where("position <= 8")
    return fused.select("request_id", "chunk_id", "position", F.round("score", 8).alias("score"))


def gold_documents(spark, d):
    """Documents that contain a benchmark text as a phrase."""
    return postings.phrases(requests(spark, d), index_of(spark, d))


def three_rankings(spark, d):
    """The rankings of the three sources, at most fifty rows each and the phrase hits; written once, since queries read them several times."""
    from pyspark.sql import Window

    order = Window.partitionBy("request_id").orderBy("chunk_id")
    relation = gold_documents(spark, d).withColumn("rank", F.row_number().over(order))
    return cut(
        keyword_ranking(spark, d).select("request_id", F.lit("keyword").alias("source"), "chunk_id", "rank")
        .unionByName(second_ranking(spark, d).select("request_id", F.lit("vector").alias("source"), "chunk_id", "rank"))
        .unionByName(relation.select("request_id", F.lit("relation").alias("source"), "chunk_id", "rank"))
    )


def weighted_fusion(spark, d):
    fused = fusion.rank_fused(fusion.fuse(three_rankings(spark, d))).where("position <= 20")
    return fused.select("request_id", "chunk_id", "position", F.round("score", 8).alias("score"), F.array_join("sources", ",").alias("sources"))


def fused_hits(spark, d, k=50, lists=None):
    """The best ``k`` of the three rankings, or of ``lists`` where the caller has them already."""
    return fusion.rank_fused(fusion.fuse(three_rankings(spark, d) if lists is None else lists)).where(F.col("position") <= k)


def literal_coverage(spark, d):
    hits = keyword_ranking(spark, d, 20).join(document_rows(spark, d), "chunk_id").join(requests(spark, d).select("request_id", "query"), "request_id")
    return hits.select("request_id", "chunk_id", F.round(selection.literal_coverage(F.col("query"), F.col("source_text"), F.col("kb_id"), F.col("lang")), 6).alias("coverage"))


def scoped_documents(spark, d):
    """Documents as chunks of one version per source, with the language as the resolved subject."""
    return document_rows(spark, d).select(
        "chunk_id", "kb_id", F.col("kb_id").alias("document_id"), F.col("kb_id").alias("version_id"), "source_text", "search_text",
        F.lit("text").alias("block_kind"), F.lit("resolved").alias("scope_status"), F.expr(SUBJECTS.format("lang")).alias("subjects"),
        F.expr(NO_STRINGS).alias("conditions"), F.lit(None).cast("string").alias("source_unit_id"), F.lit(False).alias("dependency_unresolved"),
        F.expr(NO_STRINGS).alias("dependency_issues"), F.expr(f"cast(array() as array<{LINK}>)").alias("context_links"),
        F.struct(F.expr(SUBJECTS.format("lang")).alias("subjects")).alias("applicability"), F.lit(None).cast("string").alias("business_version"), "lang")


def evidence_dedup(spark, d):
    """All documents of a language as candidates in id order; copies inside one source collapse."""
    rows = scoped_documents(spark, d).withColumn("request_id", F.col("lang")).withColumn("position", F.col("chunk_id"))
    return fusion.dedup_evidence(rows).select("request_id", "chunk_id")


def ranked_budget_fill(spark, d):
    rows = fused_hits(spark, d).join(document_rows(spark, d).select(
        "chunk_id", F.octet_length("source_text").alias("bytes"), F.length("source_text").alias("context_chars")), "chunk_id")
    return selection.select_ranked(rows, top_k=8, max_bytes=24000, max_chars=12000).select("request_id", "hit_rank", "chunk_id")


def questions_with_facets(asked):
    """``request_id``, ``query`` and ``facets``: its sentences as parts of the question; more than eight parts are one facet, as in ``decisions``."""
    parts = decision.split_facets(asked.select("request_id", F.regexp_replace("query", r"\. ", "? ").alias("question")))
    facets = parts.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("facet_no", "facet"))), lambda x: x["facet"]).alias("facets"))
    return asked.select("request_id", "query").join(facets, "request_id", "left")


def adaptive_selection(spark, d):
    hits = fused_hits(spark, d).select("request_id", "chunk_id", "position")
    chunks = scoped_documents(spark, d)
    asked = questions_with_facets(requests(spark, d))
    candidates = hits.join(chunks, "chunk_id").withColumn("required_text", F.lit("")).withColumns({
        "bytes": F.octet_length("source_text"), "context_chars": F.length("source_text"),
        "required_parts": F.expr("cast(array() as array<bigint>)")})
    features = selection.information_features(candidates, asked)
    return selection.select_adaptive(features).select("request_id", "chunk_id", "hit_rank", "stop_reason")


def linked_lines(spark, d):
    """Lines as chunks of one version per document; each line needs the document's first line."""
    lines = line_chunks(spark, d)
    first = (F.col("document_id") * 100000)
    link = F.struct(first.alias("chunk_id"), F.lit("condition").alias("role"), F.lit(True).alias("required"), F.struct(
        F.lit("curated").alias("kind"), F.col("chunk_id").cast("string").alias("source_unit_id"), first.cast("string").alias("target_unit_id"),
        F.lit("review").alias("provenance_id"), F.lit(None).cast("string").alias("reference_text")).alias("provenance"))
    return lines.select(
        "chunk_id", "kb_id", "document_id", F.col("document_id").alias("version_id"), F.col("document_id").alias("section_id"), "ordinal",
        "source_text", F.col("chunk_id").cast("string").alias("source_unit_id"), F.lit("resolved").alias("scope_status"),
        F.expr(SUBJECTS.format("lang")).alias("subjects"), F.expr(NO_STRINGS).alias("conditions"), F.lit(False).alias("dependency_unresolved"),
        F.when(F.col("ordinal") > 0, F.array(link)).otherwise(F.expr(f"cast(array() as array<{LINK}>)")).alias("context_links"))


def line_hits(spark, d, k=8):
    return search.bm25(requests(spark, d), index_of(spark, d, "lines"), k).select("request_id", "chunk_id")


def required_context(spark, d):
    out = selection.required_context(line_hits(spark, d), linked_lines(spark, d), budget=1200)
    return out.select("request_id", "chunk_id", F.array_join(F.transform("required_parts", lambda x: x.cast("string")), ",").alias("parts"),
                      "context_chars", "context_state", F.array_join("context_omissions", ",").alias("omissions"))


def optional_neighbours(spark, d):
    chunks = linked_lines(spark, d).withColumn("context_links", F.expr(f"cast(array() as array<{LINK}>)"))
    out = selection.optional_context(line_hits(spark, d), chunks, budget=1200)
    return out.select("request_id", "chunk_id", F.array_join(F.transform("optional_parts", lambda x: x.cast("string")), ",").alias("parts"))


# --- relations ---------------------------------------------------------------------------


def relation_tables(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("relation_id"),
        F.col("l_suppkey").alias("subject_id"), F.col("l_partkey").alias("object_id"), F.col("l_linestatus").alias("relation_type"),
        F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("valid_from"), F.col("l_orderkey").alias("chunk_id"),
    ).dropDuplicates(["relation_id"])
    relations = rows.select("relation_id", "subject_id", "object_id", "relation_type", "flag", "valid_from",
                            (F.col("valid_from") + F.expr("interval 365 days")).alias("valid_until"),
                            F.expr("cast(map() as map<string,string>)").alias("conditions"))
    return relations, rows.select("relation_id", "chunk_id", F.lit("supports").alias("stance"))


def supplier_seeds(spark, d):
    """A question per nation; its suppliers are the named entities (the first 20 by id count)."""
    suppliers = table(spark, d, "supplier")
    asked = suppliers.groupBy("s_nationkey").agg(F.collect_list("s_suppkey").alias("entity_ids")).select(
        F.col("s_nationkey").alias("request_id"), F.lit("").alias("query"), F.array(F.lit("tpch")).alias("kb_ids"), "entity_ids")
    entities = suppliers.select(F.col("s_suppkey").alias("entity_id"), F.lit("tpch").alias("kb_id"), F.col("s_name").alias("name"))
    aliases = entities.select("entity_id", F.col("name").alias("alias"))
    mentions = entities.select("entity_id", F.col("entity_id").alias("chunk_id"))
    seed_chunks = asked.select("request_id", F.lit(None).cast("long").alias("chunk_id"))
    return fusion.relation_seeds(asked, entities, aliases, mentions, seed_chunks)


AT = "timestamp'2000-01-01 00:00:00'"


def _expand(direction):
    def run(spark, d):
        relations, evidence = relation_tables(spark, d)
        rows = fusion.expand_relations(supplier_seeds(spark, d), relations, evidence, direction, 30, F.expr(AT))
        return rows.select("request_id", "relation_id", "subject_id", "object_id", "chunk_id")
    return run


def relation_revalidate(spark, d):
    relations, evidence = relation_tables(spark, d)
    found = fusion.expand_relations(supplier_seeds(spark, d), relations, evidence, "outgoing", 30, F.expr(AT))
    current = relations.where("flag <> 'R'")
    visible = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("chunk_id"))
    kept = fusion.revalidate_relations(found, current, evidence, visible, F.expr("timestamp'2000-07-01 00:00:00'"))
    return kept.select("request_id", "relation_id", "chunk_id")


def calibration_scores(spark, d):
    words = tx.tokens(F.col("text"), "corpus")
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(
        F.col("doc_id").alias("sample_id"), F.col("source").alias("family"),
        F.when(F.substring("source", 4, 9).cast("int") < 10, "calibration").otherwise("test").alias("split"), F.lit("lexical").alias("channel"),
        F.round(F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)), 3).alias("score"), (F.col("quality") == 1).alias("relevant"),
        F.lit("binding-1").alias("binding"))


def fit_thresholds(spark, d):
    return evaluation.fit_thresholds(calibration_scores(spark, d), 0.4).select(
        "channel", "threshold", "positives", "negatives", "families", F.round("recall", 6).alias("recall"), F.round("false_positive_rate", 6).alias("fpr"))


def split_leakage(spark, d):
    languages = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("family"))
    scores = calibration_scores(spark, d).drop("family").join(languages, "sample_id")
    return evaluation.leakage(scores).groupBy("code").agg(F.count("*").alias("n"))


def relevance_gate(spark, d):
    limits = evaluation.fit_thresholds(calibration_scores(spark, d), 0.4).select(
        F.lit("binding-1").alias("binding"), F.lit(None).cast("double").alias("vector_min"), F.lit(None).cast("double").alias("rerank_min"),
        F.col("threshold").alias("lexical_min"))
    rows = calibration_scores(spark, d).select(
        "sample_id", F.when(F.col("split") == "test", "binding-1").otherwise("binding-0").alias("binding"), F.lit(None).cast("double").alias("vector_score"),
        F.lit(None).cast("double").alias("rerank_score"), F.col("score").alias("lexical_score"), F.lit(True).alias("has_keyword"), F.lit(False).alias("has_relation"))
    return selection.relevance_gate(rows, limits).select("sample_id", "accepted")


QUERIES = {
    "bm25_topk": bm25_topk,
    "bm25_fields_topk": bm25_fields_topk,
    "keyword_logtf_topk": keyword_logtf_topk,
    "exact_identifier_search": exact_identifier_search,
    "query_route": query_route,
    "knn_cosine_topk": knn_cosine_topk,
    "knn_recall": knn_recall,
    "rrf_hybrid": rrf_hybrid,
    "weighted_fusion": weighted_fusion,
    "literal_coverage": literal_coverage,
    "evidence_dedup": evidence_dedup,
    "ranked_budget_fill": ranked_budget_fill,
    "adaptive_selection": adaptive_selection,
    "required_context": required_context,
    "optional_neighbours": optional_neighbours,
    "relation_expand_outgoing": _expand("outgoing"),
    "relation_expand_incoming": _expand("incoming"),
    "relation_expand_both": _expand("both"),
    "relation_revalidate": relation_revalidate,
    "fit_thresholds": fit_thresholds,
    "split_leakage": split_leakage,
    "relevance_gate": relevance_gate,
}
