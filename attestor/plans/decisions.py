"""Registered queries: question decisions, associations, and quality measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import text as tx
from attestor.operators import associations, decision, entities, evaluation, fusion, search
from attestor.plans.bindings import document_rows, requests, table
from attestor.plans.retrieval import NO_STRINGS, SUBJECTS, fused_hits, gold_documents, guided_documents, index_of, keyword_ranking, second_ranking
from attestor.plans.structuring import part_sentences
from attestor.sources.stored import cut

REQUIRED = "array<struct<chunk_id:bigint,role:string,text:string>>"


def question_pairs(spark, d):
    """Two benchmark texts joined to one question."""
    rows = table(spark, d, "benchmark")
    nxt = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("second"))
    return rows.join(nxt, "item_id").select(F.col("item_id").alias("request_id"), F.concat("text", F.lit("? "), "second", F.lit("; ")).alias("question"))


def facet_split(spark, d):
    return decision.split_facets(question_pairs(spark, d)).select("request_id", "facet_id", "start", "end", F.md5("facet").alias("digest"))


def values_qualifiers(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.size(tx.qualifier_sentences(F.col("text"))).alias("qualifiers"), F.md5(F.array_join(tx.qualifier_sentences(F.col("text")), "|")).alias("qualifier_digest"),
                       F.size(tx.condition_clauses(F.col("text"))).alias("clauses"))


def literal_values(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(tx.literal_values(F.col("text"))).alias("value_no", "value"))


def masked_qualifiers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(tx.masked_qualifiers(F.col("text"))).alias("qualifier"))


def document_lexemes(spark, d):
    words = tx.lexemes(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(words).alias("lexemes"), F.md5(F.array_join(F.array_sort(words), " ")).alias("digest"))


def _facets(spark, d):
    """Sentences of the benchmark texts as parts of the question; more than eight parts are one facet, as everywhere."""
    rows = table(spark, d, "benchmark")
    asked = rows.select(F.col("item_id").alias("request_id"), F.regexp_replace("text", r"\. ", "? ").alias("question"))
    return decision.split_facets(asked).select("request_id", "facet_no", "facet_id", "facet")


def _candidates(spark, d):
    hits = keyword_ranking(spark, d, 20).select("request_id", "chunk_id", F.col("rank").alias("hit_rank"))
    rows = hits.join(table(spark, d, "documents"), F.col("doc_id") == F.col("chunk_id")).select(
        "request_id", "chunk_id", "hit_rank", F.col("text").alias("source_text"), F.array("source").alias("title_path"), F.lit("statement").alias("fact_kind"),
        F.when(F.col("lang") == "es", "ambiguous").otherwise("resolved").alias("scope_status"), F.expr(SUBJECTS.format("lang")).alias("subjects"), F.expr(NO_STRINGS).alias("conditions"),
        F.lit("complete").alias("context_state"), F.expr(NO_STRINGS).alias("dependency_issues"), F.expr(f"cast(array() as {REQUIRED})").alias("required"))
    nodes = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("node_id"))
    bound = table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), F.array(F.lit("en")).alias("binding_ids"))
    return cut(decision.candidates(rows, nodes, bound))  # read by matching and by rendering; a cut leaves a short plan behind


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), F.col("text").alias("question"))


def _matches(spark, d, cands=None):
    return decision.facet_matches(_facets(spark, d), _candidates(spark, d) if cands is None else cands, _questions(spark, d))


def _support(spark, d, cands=None):
    matches = cut(_matches(spark, d, cands))  # read by the conflict, support and cover steps
    found = decision.conflicts(matches)
    return decision.facet_support(_facets(spark, d), matches, found), matches


def facet_support(spark, d):
    return _support(spark, d)[0].select("request_id", "facet_id", "support")


def decide(spark, d):
    out = decision.decide(_support(spark, d)[0])
    return out.select("request_id", "decision", F.array_join("missing", ",").alias("missing"))


def evidence_cover(spark, d):
    support, matches = _support(spark, d)
    return decision.select_cover(support, matches).select("request_id", "chunk_id", "group_no", F.array_join("facet_ids", ",").alias("facets"))


def fit_budget(spark, d):
    cands = _candidates(spark, d)
    support, matches = _support(spark, d, cands)
    support = cut(support)
    groups = cut(decision.render_groups(decision.select_cover(support, matches), cands))
    return decision.fit_budget(support, groups, 1200)[1]


def conflicts(spark, d):
    """Order lines as direct evidence: same supplier and flag, different status or quantity."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("request_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("hit_rank")).agg(
        F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"), F.min("l_quantity").cast("int").cast("string").alias("quantity"))
    matches = rows.select("request_id", F.lit("f1").alias("facet_id"), F.lit("direct").alias("way"), F.lit("one").alias("subject_key"), F.array("flag").alias("qualifiers"),
                          (F.col("status") == "F").alias("negative"), F.array("quantity").alias("values"), "hit_rank")
    return decision.conflicts(matches)


def package_status(spark, d):
    rows = table(spark, d, "events")
    maps = lambda k, v: F.create_map(F.lit("kb"), F.when(F.col("event_type") == k, v).otherwise(F.lit(1)))
    packages = rows.select(F.col("event_id").alias("package_id"), (F.col("ts") + F.expr("interval 30 seconds")).alias("expires_at"), maps("none", F.lit(2)).alias("content"),
                           maps("click", F.lit(2)).alias("content_now"), maps("none", F.lit(2)).alias("access"), maps("error", F.lit(2)).alias("access_now"))
    return decision.package_status(packages, F.expr("timestamp'2024-01-15 00:00:00'"))


def changed_hits(spark, d):
    docs = document_rows(spark, d)
    now = docs.where("lang <> 'fr'").withColumn("source_text", F.when(F.col("lang") == "de", F.concat("source_text", F.lit("."))).otherwise(F.col("source_text")))
    hits = keyword_ranking(spark, d, 20).join(docs, "chunk_id")
    return decision.changed_hits(hits, now, ["document_id", "source_text"])


def decision_integrity(spark, d):
    """Orders as decided responses with lines as facets; some references are broken."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("n")).agg(
        F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    decisions = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderstatus") == "F", "answer").otherwise("insufficient").alias("decision"))
    on = F.col("status") == "O"
    facets = rows.select("request_id", F.concat(F.lit("f"), "n").alias("facet_id"), F.when(F.col("flag") == "N", "direct").otherwise("absent").alias("support"),
                         F.when(on, F.array(F.concat(F.lit("E"), "n"))).otherwise(F.expr(NO_STRINGS)).alias("evidence_ids"))
    groups = rows.where(on).select("request_id", F.concat(F.lit("E"), "n").alias("group_id"), F.array(F.concat(F.lit("f"), F.when(F.col("flag") == "A", F.lit(1)).otherwise(F.col("n")))).alias("facet_ids"),
                                   F.array(F.concat(F.lit("S"), "n")).alias("source_ids"))
    sources = rows.where(on & (F.col("flag") != "R")).select("request_id", F.concat(F.lit("S"), "n").alias("source_id"))
    return decision.check_response(decisions, facets, groups, sources).groupBy("code").agg(F.count("*").alias("n"))


# --- associations ------------------------------------------------------------------------


def discover_links(spark, d):
    """Every document asks with its whole text and, where it has one, its vector for its 20 nearest of the same source; guides are the entities. Cosine floor zero for this data."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    none = F.lit(None).cast("string")
    chunks = guided_documents(spark, d).join(vectors, "chunk_id", "left").withColumns({"family": none, "model": none})
    asked = chunks.select(F.col("chunk_id").alias("request_id"), F.col("source_text").alias("query"), F.array("kb_id").alias("kb_ids"))
    lexical = search.bm25(asked, index_of(spark, d, "guided"), 20).select(F.col("request_id").alias("source"), F.col("chunk_id").alias("target"), "rank")
    placed = chunks.where("vector is not null").select(F.col("chunk_id").alias("vec_id"), "vector", "kb_id")
    near = search.knn(placed.select(F.col("vec_id").alias("request_id"), "vector", "kb_id"), placed, 20)
    pairs = associations.link_candidates(lexical.unionByName(near.select(F.col("request_id").cast("long").alias("source"), F.col("vec_id").alias("target"), "rank")))
    guides = table(spark, d, "documents").select("lang").distinct().select(
        F.col("lang").alias("entity_id"), F.concat("lang", F.lit("-guide")).alias("name"), F.lit("product").alias("kind"), none.alias("product_model"))
    found = entities.mentions(chunks, entities.catalog(guides, guides.select("entity_id", none.alias("alias")).where("false")))
    links = associations.discover_links(chunks, pairs, found.select("chunk_id", "entity_id").distinct(), associations.referenced_entities(chunks, found), {"semantic_floor": 0.0})
    return links.select("source", "target", "kind", F.round("score", 4).alias("score"))


def _claim_sentences(spark, d):
    rows = part_sentences(spark, d).select("chunk_id", "p_name", "p_type")
    nxt = rows.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("p_name").alias("other"))
    text = (
        F.when(F.col("p_type") == "ECONOMY", F.concat("p_name", F.lit(" requires "), "other", F.lit(". Nothing else.")))
        .when(F.col("p_type") == "STANDARD", F.concat("p_name", F.lit(" is compatible with "), "other", F.lit(" only with "), "other", F.lit(" firmware 2.1 or later.")))
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("Intro. "), "p_name", F.lit(" does not support "), "other", F.lit("!")))
        .when(F.col("p_type") == "MEDIUM", F.concat("p_name", F.lit(" depends on "), "other", F.lit(" in most rooms.")))
        .otherwise(F.concat(F.lit("The "), "p_name", F.lit(" requires "), "other", F.lit("."))))
    return rows.join(nxt, "chunk_id").select("chunk_id", F.lit("tpch").alias("kb_id"), text.alias("source_text"))


def _claims(spark, d):
    sentence_rows = associations.sentences(_claim_sentences(spark, d))
    names = table(spark, d, "part").select(F.col("p_name").alias("entity_id")).distinct().withColumn("kind", F.when(F.col("entity_id").endswith("ring"), "protocol").otherwise("product"))
    surfaces = names.select("entity_id", F.col("entity_id").alias("surface"))
    keyed = sentence_rows.select(F.concat_ws(":", "chunk_id", "sentence_no").alias("chunk_id"), F.col("sentence").alias("source_text"))
    found = entities.resolve_overlaps(entities.mentions(keyed, surfaces)).select(
        F.split_part("chunk_id", F.lit(":"), F.lit(1)).cast("long").alias("chunk_id"), F.split_part("chunk_id", F.lit(":"), F.lit(2)).cast("int").alias("sentence_no"), "entity_id", "start", "end")
    return associations.extract_claims(sentence_rows, found, names, surfaces)


def extract_claims(spark, d):
    out = _claims(spark, d)
    return out.select("chunk_id", "subject", "predicate", "object", "polarity", "state", F.size("conditions").alias("conditions"), "start", "end")


def merge_claims(spark, d):
    out = associations.merge_claims(_claims(spark, d))
    return out.select("subject", "predicate", "object", "polarity", "state", F.size("support_sets").alias("proofs"), "truncated", F.col("support_sets")[0]["chunk_id"].alias("first_chunk"))


def condition_match(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    version = F.concat_ws(".", F.floor(F.col("k") / 10), F.col("k") % 10)
    conditions = rows.select("event_id", F.lit("e").alias("entity_id"), F.lit("firmware").alias("field"), F.when(F.col("event_type") == "click", "eq").otherwise("gte").alias("op"), F.lit("4.5").alias("value"))
    known = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("event_type") == "view", F.concat(version, F.lit("-beta"))).when(
        F.col("event_type") == "purchase", F.concat(version, F.lit(".0"))).otherwise(version)
    context = rows.select("event_id", F.lit("e").alias("entity_id"), F.lit("firmware").alias("field"), known.alias("known"))
    return associations.condition_match(conditions, context, ["event_id"])


def seed_pick(spark, d):
    ranking = fused_hits(spark, d).join(document_rows(spark, d).select("chunk_id", F.col("kb_id").alias("document_id")), "chunk_id")
    return associations.seeds(ranking.select("request_id", "chunk_id", "document_id", "position")).select("request_id", "chunk_id", "seed_no")


def _expansions(spark, d):
    navigation = second_ranking(spark, d, 10).select("request_id", F.lit("navigation").alias("kind"), "chunk_id", "rank")
    from pyspark.sql import Window

    order = Window.partitionBy("request_id").orderBy("chunk_id")
    claims = gold_documents(spark, d).withColumn("rank", F.row_number().over(order)).select("request_id", F.lit("claim").alias("kind"), "chunk_id", "rank")
    return navigation.unionByName(claims)


def association_fusion(spark, d):
    base = fusion.rrf(keyword_ranking(spark, d).select("request_id", "chunk_id", "rank"))
    out = associations.fuse_associations(base, _expansions(spark, d))
    return out.select("request_id", "chunk_id", F.round("score", 8).alias("score"), "protected", "position")


def association_paths(spark, d):
    """Seeds of every question expanded over links between documents of equal first words, with shared budgets."""
    docs = table(spark, d, "documents")
    words = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.array_distinct(tx.tokens(F.col("text"), "corpus")).alias("words"))
    first = docs.select("doc_id", "source", F.get(F.split("text", " "), F.lit(0)).alias("w"))
    heads = first.groupBy("source", "w").agg(F.min("doc_id").alias("head"))
    links = first.join(heads, ["source", "w"]).where("doc_id <> head").select(
        F.concat_ws("-", "doc_id", "head").alias("association_id"), F.col("doc_id").alias("source"), F.col("head").alias("target"), F.lit("semantic_neighbor").alias("kind"), F.lit(0.5).alias("score"))
    base = cut(fused_hits(spark, d).select("request_id", "chunk_id", "position").join(words.select("chunk_id", "document_id"), "chunk_id"))
    asked = requests(spark, d).select("request_id", F.array_except(F.array_distinct(tx.tokens(F.col("query"), "corpus")), tx.string_array(tx.ASSOCIATION_STOP)).alias("words"))
    edges = associations.link_edges(associations.seeds(base), links, words, asked, base)
    return associations.spend_budgets(edges).select("request_id", "kind", "association_id", "chunk_id", "rank")


def variant_runs(spark, d):
    asked = search.route(requests(spark, d)).select("request_id", "query", "path", F.lit(1).alias("query_entities"))
    return associations.with_variants(asked, "auto").groupBy("variant", "candidates", "expands", "gate_reason").agg(F.count("*").alias("requests"))


def proof_validity(spark, d):
    """Quotes of the documents' first 40 characters; changed, moved and cut quotes fail."""
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("version_id"), F.lit("p").alias("fingerprint"), F.col("text").alias("source_text"))
    quote = F.when(F.col("lang") == "es", F.lit("other")).otherwise(F.substring("text", 1, 4))
    proofs = docs.select(F.col("doc_id").alias("claim_id"), F.lit(0).alias("set_no"), F.col("doc_id").alias("chunk_id"), F.when(F.col("lang") == "de", "old").otherwise(F.col("source")).alias("version_id"),
                         F.lit("p").alias("fingerprint"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.sha2(quote, 256).alias("quote_sha256"))
    return associations.valid_proofs(proofs, chunks).select("claim_id")


# --- evaluation --------------------------------------------------------------------------


def _gold(spark, d):
    gold = cut(gold_documents(spark, d))  # read by units, plans and cases
    units = gold.select(F.col("request_id").alias("query_id"), F.lit("gold").alias("unit"), "chunk_id")
    plans = gold.groupBy(F.col("request_id").alias("query_id")).agg(F.array(F.min("chunk_id")).alias("document_ids")).withColumn("plan_id", F.lit(1)).withColumn("units", F.array(F.lit("gold")))
    cases = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 1).alias("family")).join(
        units.select("query_id").distinct().withColumn("has", F.lit(True)), "query_id", "left").select(
        "query_id", "family", F.coalesce("has", F.lit(False)).alias("answerable"), F.when(F.col("has"), "simple").otherwise("unanswerable").alias("category"))
    return cases, units, plans


def _scores(spark, d):
    cases, units, plans = _gold(spark, d)
    out = None
    for name, ranking in (("H", keyword_ranking(spark, d, 8)), ("L", second_ranking(spark, d, 8))):
        hits = cut(ranking.select(F.col("request_id").alias("query_id"), "rank", "chunk_id", F.col("chunk_id").alias("document_id")))
        rows = evaluation.score(cases, hits, units, plans, units.select("query_id", "chunk_id").where("false"), 8).withColumn("variant", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def query_scores(spark, d):
    return _scores(spark, d).select("variant", "query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "complete", "returned")


def macro_summary(spark, d):
    out = evaluation.summarize(_scores(spark, d))
    return out.select("variant", "category", "queries", F.round("precision_mean", 6).alias("precision_mean"), "precision_n", F.round("recall_mean", 6).alias("recall_mean"))


def paired_bootstrap(spark, d):
    rows = cut(_scores(spark, d))
    return evaluation.paired_bootstrap(rows.where("variant = 'H'"), rows.where("variant = 'L'"), "recall", iterations=200)


def retrieval_metrics(spark, d):
    cases, units, _ = _gold(spark, d)
    hits = fused_hits(spark, d, 8).join(document_rows(spark, d), "chunk_id").select(
        F.col("request_id").alias("query_id"), F.col("position").alias("rank"), F.array("chunk_id").alias("chunk_ids"), F.col("chunk_id").alias("document_id"),
        F.when(F.col("lang") == "es", "unresolved").otherwise("complete").alias("context_state"), F.octet_length("source_text").alias("bytes"))
    out = evaluation.retrieval_metrics(cases.select("query_id", "answerable"), hits, units, units.select("query_id", "chunk_id").where("false"))
    return out.select("query_id", "recall", "complete", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.round("precision_returned", 6).alias("precision_returned"),
                      "no_answer_false_positive", "answerable_empty", "returned", "hits_bytes")


def percentiles(spark, d):
    out = evaluation.percentiles(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", *[F.round(c, 4).alias(c) for c in out.columns if c.startswith("p")], *[c for c in out.columns if c.startswith("nearest")])


def wilson(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").groupBy("source").agg(F.sum("quality").alias("correct"), F.count("*").alias("total"))
    low, high = evaluation.wilson(F.col("correct"), F.col("total"))
    return rows.select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def association_scores(spark, d):
    """Claims judged by a rule on the part number, some of them unjudged."""
    claims = _claims(spark, d).select(F.col("chunk_id").alias("claim_id"), "state")
    labels = table(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("claim_id"), (F.col("p_size") > 5).alias("correct"))
    paths = table(spark, d, "events").select(F.col("event_type").alias("variant"), F.col("user_id").alias("query_id"), F.get_json_object("props", "$.k").alias("path_digest"))
    judged = paths.where("path_digest < '50'").select("query_id", "path_digest").distinct().withColumn("correct", F.col("path_digest") > "20")
    out = evaluation.association_scores(claims, labels, paths, judged)
    return out.select("measure", "variant", F.round("measured", 6).alias("measured"), "correct", "n", "unlabelled", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def run_summary(spark, d):
    records = table(spark, d, "events").select(
        F.col("event_type").alias("status"), F.when(F.col("value") > 50, "ok").otherwise("slow").alias("outcome"), F.col("value").alias("latency_ms"), F.when(F.col("value") > 20, 1.0).alias("recall"),
        F.when(F.col("value") > 20, 0.5).alias("reciprocal_rank"), (F.col("value") > 30).alias("complete"), F.lit(0.25).alias("precision_returned"), F.lit(None).cast("boolean").alias("no_answer_false_positive"),
        (F.col("value") < 1).alias("answerable_empty"), F.col("user_id").alias("returned"), F.lit(10).alias("hits_bytes"), F.lit(0).alias("forbidden_count"), (F.col("event_type") == "view").alias("expected_status_matches"))
    out = evaluation.run_summary(records)
    return out.select("requests", "p50_ms", "p95_ms", "p99_ms", F.round("complete_evidence_rate", 6).alias("complete_evidence_rate"), F.round("mean_returned", 4).alias("mean_returned"),
                      "expected_status_checked", "expected_status_matched")


def gold_check(spark, d):
    rows = table(spark, d, "orders")
    facets = lambda c: F.create_map(F.lit("f1"), c)
    results = rows.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("decision"), facets(F.col("o_orderpriority")).alias("facets"), F.expr(NO_STRINGS).alias("missing"),
                          F.array(F.col("o_custkey").cast("string")).alias("entity_ids"), (F.col("o_totalprice") / 1000).cast("int").alias("token_count"), F.lit(400).alias("token_budget"),
                          F.lit(3).alias("groups"), F.lit(5).alias("max_groups"), F.lit("valid").alias("package_status"))
    gold = rows.select(F.col("o_orderkey").alias("case_id"), F.lit("F").alias("expected_decision"), facets(F.lit("5-LOW")).alias("expected_facets"), F.lit(None).cast("array<string>").alias("expected_missing"),
                       F.array(F.lit("1"), F.lit("2")).alias("forbidden_entity_ids"))
    return evaluation.check_decisions(results, gold).groupBy("passed", F.size("failures").alias("failures")).agg(F.count("*").alias("cases"))


QUERIES = {f.__name__: f for f in (
    facet_split, values_qualifiers, literal_values, masked_qualifiers, document_lexemes, facet_support, decide, evidence_cover, fit_budget, conflicts, package_status, changed_hits,
    decision_integrity, discover_links, extract_claims, merge_claims, condition_match, seed_pick, association_fusion, association_paths, variant_runs, proof_validity, query_scores,
    macro_summary, paired_bootstrap, retrieval_metrics, percentiles, wilson, association_scores, run_summary, gold_check)}
