"""Registered queries: restoring, catalog writes, review opening, state promotion, and associations after the first search."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import associations, entities, review, search, tree, versions
from attestor.plans.bindings import document_rows, requests, table
from attestor.plans.retrieval import NO_STRINGS, SUBJECTS, index_of, keyword_ranking


def restored_lines(spark, d):
    """Lines of pending orders under the ids of a new version; each line is linked to the one before it."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select("l_orderkey", "l_linenumber").distinct()
    name = F.concat(F.lit("00000000-0000-5000-8000-"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"))
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    chunks = lines.select(number.alias("chunk_id"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("ordinal"), name.alias("new_version"))
    links = lines.where("l_linenumber > 1").select(number.alias("chunk_id"), (number - 1).alias("target_id"), F.lit("condition").alias("role"))
    rows, moved = versions.restore_version(chunks, links, F.col("new_version"))
    targets = moved.select("chunk_id", "target_id")
    return rows.join(targets, "chunk_id", "left").select("order_key", "ordinal", "chunk_id", "target_id")


def generation_freshness(spark, d):
    """Whether a projection built before the purchases is still fresh, per type of event as the change that moved a base."""
    changes = table(spark, d, "events").select("event_type", F.col("user_id").alias("kb_id"), F.lit("content").alias("kind"))
    built, now = versions.revisions(changes.where("event_type <> 'purchase'")), versions.revisions(changes)
    moved = versions.revision_differences(built, now)
    return versions.generation_is_fresh(built, now).join(moved.agg(F.count("*").alias("moved")), F.lit(True))


def catalog_upsert(spark, d):
    """Large parts get another name and a second size; the rest of the catalog stays."""
    target = table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("name"), F.col("p_size").cast("long").alias("size"))
    large = target.where("size > 45")
    changes = large.select("entity_id", F.upper(F.concat("name", F.lit("-large"))).alias("name"), "size").unionByName(large.select((F.col("entity_id") + 10_000_000).alias("entity_id"), "name", (F.col("size") * 2).alias("size")))
    return entities.upsert(target, changes, ["entity_id"])


def catalog_delete(spark, d):
    """Suppliers in debt leave the catalog and everything that names them; evidence of other bases is refused."""
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").cast("string").alias("kb_id"), "s_acctbal")
    mentions = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("chunk_id"))
    left = entities.cascade_delete({"catalog": suppliers, "mentions": mentions}, suppliers.where("s_acctbal < 0"), "entity_id")
    refused = entities.check_evidence(suppliers.select(F.lit("7").alias("kb_id"), F.col("entity_id").alias("chunk_id")), suppliers.select("kb_id", F.col("entity_id").alias("chunk_id")))
    counts = [rows.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, rows in [*left.items(), ("refused", refused)]]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def review_choices(spark, d):
    """Suppliers as entities of orders: those of lines of the text (every fourth line), else of the deepest title."""
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), (F.col("l_linenumber") % 4).alias("level"), F.col("l_suppkey").alias("entity_id"))
    chunks = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("chunk_id"))
    return review.review_candidates(chunks, found).select("chunk_id", "entity_id")


def opened_reviews(spark, d):
    """Frozen and editable facts of every finished order that has no plan yet."""
    orders = table(spark, d, "orders")
    finished = orders.select(F.col("o_orderkey").alias("version_id"), F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "published").otherwise("uploaded").alias("status"))
    plans = orders.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("version_id"), F.lit("scope-rules-1").alias("rule_revision"))
    facts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("chunk_id"), F.col("l_returnflag").alias("review_state"))
    rows = review.open_review(finished, facts, plans)
    return rows.select("version_id", "plan_id", "fact_id", F.col("original.review_state").alias("original"), F.col("current.review_state").alias("current"))


def scope_states(spark, d):
    """Scope assertions of all documents, counted per source: German ones are general, English ones resolved, French ones ambiguous."""
    lang = F.col("lang")
    chunks = document_rows(spark, d).select(
        F.col("kb_id").alias("version_id"), "chunk_id", F.when(lang == "de", "general").otherwise("product").alias("fact_kind"),
        F.when(lang == "en", "resolved").when(lang == "fr", "ambiguous").otherwise("unknown").alias("scope_status"), F.expr(SUBJECTS.format("lang")).alias("subjects"), F.expr(NO_STRINGS).alias("conditions"))
    return tree.scope_counts(tree.scope_assertions(chunks))


def promoted_states(spark, d):
    """Long documents require the next one as a condition or refer to it; one source is declared to be about no product."""
    docs = table(spark, d, "documents")
    no_subjects = F.filter(F.expr(SUBJECTS.format("lang")), lambda s: F.col("lang") == "es")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.when(F.col("doc_id") % 5 == 0, "bundle").otherwise("product").alias("fact_kind"),
                         F.when(F.col("doc_id") % 2 == 0, "unknown").otherwise("resolved").alias("scope_status"), F.when(F.col("doc_id") % 3 == 0, "excluded").otherwise("pending").alias("review_state"),
                         F.lit("").alias("review_reason"), no_subjects.alias("subjects"))
    links = docs.where("n_chars > 1000").select((F.col("doc_id") + 1).alias("target_id"), F.when(F.col("lang") == "en", "condition").otherwise("see_also").alias("role"), (F.col("n_chars") % 2 == 0).alias("required"))
    out = tree.promote_states(chunks, links, docs.where("lang = 'fr'").select(F.col("doc_id").alias("chunk_id")), docs.where("source in ('src3', 'src4')").select(F.col("source").alias("document_id")).distinct())
    return out.select("chunk_id", "fact_kind", "review_state", "review_reason")


def cue_search(spark, d):
    """Each question asks again with the language names of its four best documents, at most two, for twelve hits each."""
    asked = requests(spark, d)
    names = keyword_ranking(spark, d, 4).join(document_rows(spark, d).select("chunk_id", "lang"), "chunk_id").select("request_id", F.col("lang").alias("name"))
    cues = associations.cue_requests(asked.select("request_id", "query", "kb_ids"), names).select(F.concat_ws(":", "request_id", "cue_no").alias("request_id"), "query", "kb_ids")
    return search.bm25(cues, index_of(spark, d), 12).select("request_id", "chunk_id", "rank")


def claim_coverage(spark, d):
    """Orders as requests, their suppliers as claims and parts as proofs; small parts are delivered."""
    lines = table(spark, d, "lineitem")
    packages = lines.select(F.col("l_orderkey").alias("request_id"), F.col("l_suppkey").alias("claim_id"), F.col("l_partkey").alias("chunk_id")).distinct()
    small = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("chunk_id"))
    return associations.group_coverage(packages, packages.join(small, "chunk_id").select("request_id", "chunk_id"))


def held_paths(spark, d):
    """Lines as paths from a part to a supplier's order; parts that changed their price and links of returned lines drop out."""
    lines = table(spark, d, "lineitem")
    paths = lines.select(F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("chunk_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("association_id"))
    marks = lambda key, name, low: table(spark, d, name).select(F.col(key).alias("chunk_id"), F.when(low, "old").otherwise("same").alias("fingerprint"))
    before = marks("p_partkey", "part", F.lit(False)).unionByName(marks("s_suppkey", "supplier", F.lit(False))).distinct()
    changed = table(spark, d, "part").where("p_size % 4 = 0").select(F.col("p_partkey").alias("chunk_id"))
    valid = lines.where("l_returnflag <> 'R'").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("association_id")).distinct()
    return associations.revalidate_paths(paths, before, before.join(changed, "chunk_id", "left_anti"), valid).groupBy("source").agg(F.count("*").alias("paths"))


def artifact_check(spark, d):
    """Violations of the links from parts to their suppliers, with the orders as claims."""
    lines = table(spark, d, "lineitem")
    links = lines.select(F.col("l_partkey").alias("source"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("association_id")).distinct()
    claims = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_id"))
    return associations.validate_artifact(links, claims)


QUERIES = {f.__name__: f for f in (restored_lines, generation_freshness, catalog_upsert, catalog_delete, review_choices, opened_reviews, scope_states, promoted_states, cue_search, claim_coverage, held_paths, artifact_check)}
