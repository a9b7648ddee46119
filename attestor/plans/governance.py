"""Registered queries: document trees, review, versions, access, projections, and the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import entities, render, review, structure, tree, versions
from attestor.plans.bindings import line_chunks, table
from attestor.plans.retrieval import LINK, NO_STRINGS, SUBJECTS
from attestor.plans.structuring import marked, part_entities, part_sentences, pipe_tables, reference_chunks
from attestor.sources import projection
from attestor.streaming import jobs


# --- trees -------------------------------------------------------------------------------


def turn_tree(spark, d):
    """Conversations as trees: a root per conversation, each turn below the turn before it."""
    rows = table(spark, d, "conversations")
    turns = rows.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("t"), "turn").alias("node_key"), F.when(F.col("turn") > 0, F.concat(
        F.lit("t"), F.col("turn") - 1)).otherwise("root").alias("parent_key"), F.lit("paragraph").alias("kind"), "text")
    roots = rows.select(F.col("conv_id").alias("doc_id")).distinct().select("doc_id", F.lit("root").alias("node_key"), F.lit(None).cast("string").alias("parent_key"),
                                                                        F.lit("document").alias("kind"), F.lit("").alias("text"))
    nodes = roots.unionByName(turns)
    edges = turns.select("doc_id", F.col("parent_key").alias("source_key"), F.col("node_key").alias("target_key"), F.lit("parent_of").alias("type"), F.lit(False).alias("required"))
    return nodes, edges


def document_nodes(spark, d):
    nodes = tree.block_nodes(structure.blocks(marked(spark, d))).persist()
    edges = tree.structure_edges(nodes)
    return nodes.select(F.lit("node").alias("item"), "kind").unionByName(edges.select(F.lit("edge").alias("item"), F.col("type").alias("kind"))).groupBy("item", "kind").agg(F.count("*").alias("n"))


def header_edges(spark, d):
    cells = structure.table_cells(pipe_tables(spark, d), ["doc_id"])
    return tree.header_edges(cells, ["doc_id"]).groupBy("doc_id", "column_index").agg(F.count("*").alias("cells"), F.max("header_text").alias("header_text"))


def list_nesting(spark, d):
    """Lines of a document as list items indented by their length class; each item's parent is the nearest shallower one."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    items = F.transform(lines, lambda x: F.concat(F.repeat(F.lit("  "), F.least(F.lit(3), F.floor(F.length(x) / 100).cast("int"))), F.lit("- "), x))
    rows = table(spark, d, "documents").select("doc_id", F.array_join(items, "\n").alias("text"))
    return tree.list_items(rows, ["doc_id"])


def footnote_nodes(spark, d):
    long = F.col("n_chars") > 5000
    return table(spark, d, "documents").select(
        F.col("source").alias("doc_id"), F.col("doc_id").cast("string").alias("node_key"), F.when(long, "footnote").otherwise("paragraph").alias("kind"),
        F.when(long, F.concat(F.lit("[^"), "lang", F.lit("]: "), "text")).otherwise(F.concat("text", F.lit(" [^"), "lang", F.lit("]"))).alias("text"))


def footnotes(spark, d):
    bound, issues = tree.footnote_links(footnote_nodes(spark, d))
    return bound.select("doc_id", F.col("target_key").alias("node_key"), F.col("source_key").alias("result")).unionByName(issues.select("doc_id", "node_key", F.col("code").alias("result")))


def graph_check(spark, d):
    """Conversation trees with broken parts: turns of a system role lose their parent, first turns get a self edge."""
    nodes, edges = turn_tree(spark, d)
    roles = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("t"), "turn").alias("node_key"), "role")
    nodes = nodes.join(roles, ["doc_id", "node_key"], "left").withColumn("parent_key", F.when(F.col("role") == "system", "nowhere").otherwise(F.col("parent_key"))).drop("role")
    broken = edges.where("target_key = 't0'").withColumn("source_key", F.col("target_key"))
    units = nodes.where("kind = 'paragraph'").select("doc_id", F.concat_ws(":", "doc_id", "node_key").alias("chunk_id"), "node_key")
    return tree.validate_graph(nodes, edges.unionByName(broken), units).groupBy("code").agg(F.count("*").alias("n"))


def graph_digest(spark, d):
    return tree.graph_digest(*turn_tree(spark, d))


def required_closure(spark, d):
    """Each turn requires the one before it; in conversations with a system turn the first turn also requires the second."""
    rows = table(spark, d, "conversations")
    chain = rows.where("turn > 0").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("source_key"), (F.col("turn") - 1).alias("target_key"))
    loops = rows.where("role = 'system' and turn = 0").select(F.col("conv_id").alias("doc_id"), F.lit(0).cast("long").alias("source_key"), F.lit(1).cast("long").alias("target_key"))
    edges = chain.unionByName(loops).withColumn("type", F.lit("governed_by")).withColumn("required", F.lit(True))
    out = tree.required_closure(edges)
    return out.select("doc_id", "main", F.array_join(F.transform("node_keys", lambda x: x.cast("string")), ",").alias("nodes"), "issue")


def unit_binding(spark, d):
    """Turns bound to their nodes by parser key; every fifth key is wrong and falls back to the text."""
    nodes, _ = turn_tree(spark, d)
    nodes = nodes.withColumn("title_path", F.expr(NO_STRINGS))
    chunks = nodes.where("kind = 'paragraph'").select(
        "doc_id", F.concat_ws(":", "doc_id", "node_key").alias("chunk_id"), F.when(F.length("text") > 150, F.concat("node_key", F.lit(":piece:0"))).otherwise("lost").alias("parser_key"),
        "title_path", F.col("text").alias("source_text"))
    return tree.bind_units(chunks, nodes).select("chunk_id", "node_key")


def dependency_edges(spark, d):
    chunks = reference_chunks(spark, d)
    units = chunks.select("chunk_id", F.col("section_id").alias("node_key"), F.col("version_id").alias("doc_id"))
    bound = chunks.where("ordinal > 0").select("chunk_id", (F.col("chunk_id") - 1).alias("target_id"), F.when(F.col("ordinal") == 1, "exception").when(
        F.col("ordinal") == 2, "continuation").otherwise("condition").alias("role"), F.lit(True).alias("required"))
    return tree.dependency_edges(bound, units).groupBy("type").agg(F.count("*").alias("n"))


def chunk_rows(spark, d):
    """Line facts as chunk rows: name-based ids, search texts of at most 400 characters (a bound that lines pass), and what that leaves out."""
    facts = line_chunks(spark, d).select(
        F.concat(F.lit("00000000-0000-5000-8000-"), F.lpad(F.col("document_id").cast("string"), 12, "0")).alias("version_id"), "kb_id", "document_id", F.col("kb_id").alias("document_name"),
        F.col("ordinal").alias("position"), "source_text", F.array("lang").alias("title_path"), F.when(F.col("lang") == "en", "resolved").otherwise("unknown").alias("scope_status"),
        F.expr(SUBJECTS.format("lang")).alias("subjects"), F.array(F.lit("bound")).alias("conditions"))
    return tree.materialize_chunks(facts, 400).select("document_id", "ordinal", "chunk_id", F.md5("search_text").alias("search_digest"), F.col("search_cut").cast("long").alias("search_cut"))


# --- review ------------------------------------------------------------------------------


def review_facts(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    state = F.when(F.col("quality").isNull(), "excluded").when(F.col("toxic") == 1, "pending").otherwise("rule_confirmed")
    link = F.expr("named_struct('chunk_id', doc_id + 1, 'role', 'condition', 'required', true, 'provenance', "
                  "cast(null as struct<kind:string,source_unit_id:string,target_unit_id:string,provenance_id:string,reference_text:string>))")
    return rows.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("kb_id"), F.col("source").alias("document_id"), F.col("source").alias("version_id"), F.col("source").alias("plan_id"),
        F.col("lang").alias("section_id"), F.col("doc_id").alias("ordinal"), F.col("text").alias("source_text"), F.col("doc_id").cast("string").alias("source_unit_id"),
        F.when(F.col("lang") == "en", "resolved").otherwise("unknown").alias("scope_status"), F.expr(SUBJECTS.format("lang")).alias("subjects"), F.expr(NO_STRINGS).alias("conditions"),
        F.when(F.col("lang") == "fr", "general").otherwise("statement").alias("fact_kind"), state.alias("review_state"), F.lit(None).cast("string").alias("review_reason"),
        (F.col("n_chars") > 20000).alias("dependency_unresolved"), F.when(F.col("lang") == "de", F.array(link)).otherwise(F.expr(f"cast(array() as array<{LINK}>)")).alias("context_links"),
        F.when(F.col("lang") == "es", F.array(F.lit("structure_missing"), F.lit("no_reviewed_match"))).otherwise(F.expr(NO_STRINGS)).alias("reason_codes"))


def publish_blockers(spark, d):
    return review.blockers(review_facts(spark, d))


def review_summary(spark, d):
    facts = review_facts(spark, d)
    out = review.review_summary(facts, review.blockers(facts))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select("plan_id", "total", "blocking", "confirmed_general", "sections", "publish_eligible", text("counts").alias("counts"), text("reason_counts").alias("reason_counts"))


def review_page(spark, d):
    facts = review_facts(spark, d)
    return review.review_page(facts, review.blockers(facts), issues=True, limit=25, offset=50).select("chunk_id", "ordinal")


def processing_stats(spark, d):
    counts, reasons = review.processing_review(review_facts(spark, d))
    return counts.select("version_id", F.lit("total").alias("measure"), F.col("total").alias("n")).unionByName(
        counts.select("version_id", F.lit("unknown").alias("measure"), F.col("unknown").alias("n"))).unionByName(reasons.select("version_id", F.col("reason").alias("measure"), "n"))


def review_options(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").fillna(0, ["quality", "toxic"])
    kind = F.when(F.col("lang") == "en", "specification").when(F.col("lang") == "de", "bundle").when(F.col("lang") == "es", "comparison").otherwise("general")
    mentions = F.col("quality") + F.col("toxic")
    facts = rows.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("source_text"), kind.alias("fact_kind"), F.lit("pending").alias("review_state"),
                        F.when(F.col("quality") == 1, "resolved").otherwise("unknown").alias("scope_status"), (F.col("source") == "src1").alias("dependency_unresolved"),
                        F.lit(0).alias("link_count"), mentions.alias("mentions"), (mentions == 2).alias("overlapping"), (F.col("n_chars") > 3000).alias("separate"))
    out = review.review_options(facts)
    return out.select("chunk_id", "category", F.array_join("allowed_actions", ",").alias("actions"), "recommended_action")


def separate_values(spark, d):
    """Part sentences: which carry values of their own per product."""
    chunks = part_sentences(spark, d).withColumn("source_text", F.concat("source_text", F.lit(" price 10 and 20")))
    names = part_entities(spark, d)
    found = entities.mentions(chunks, names.select("entity_id", F.col("entity_id").alias("surface")))
    return review.separate_values(chunks, found).groupBy("separate").agg(F.count("*").alias("n"))


def decision_replay(spark, d):
    """Events as decisions on one fact per user and type: exclude, defer, general, reset, and an assign without a choice."""
    events = table(spark, d, "events")
    fact_id = F.concat_ws(":", "user_id", "event_type")
    none = F.expr(NO_STRINGS)
    facts = events.select("user_id", "event_type").distinct().select(
        F.col("user_id").alias("plan_id"), fact_id.alias("fact_id"), F.lit("text").alias("source_text"), F.lit("statement").alias("fact_kind"), F.lit("pending").alias("review_state"),
        F.lit(None).cast("string").alias("review_reason"), F.lit("unknown").alias("scope_status"), none.alias("subject_ids"), none.alias("original_subject_ids"), F.lit(False).alias("original_explicit"),
        none.alias("mentioned"), F.lit(False).alias("overlapping"), F.lit(False).alias("separate"), F.lit(False).alias("compares"), F.lit(False).alias("has_property"),
        F.lit(False).alias("dependency_unresolved"), none.alias("dependency_issues"), F.lit(0).alias("reference_count"), none.alias("link_ids"), F.lit(None).cast("string").alias("parent_id"))
    action = F.when(F.col("event_type") == "signup", "exclude").when(F.col("event_type") == "click", "defer").when(F.col("event_type") == "view", "general").when(
        F.col("event_type") == "purchase", "reset").otherwise("assign")
    ints = F.expr("cast(array() as array<int>)")
    decisions = events.select(F.col("user_id").alias("plan_id"), F.col("event_id").alias("revision"), fact_id.alias("fact_id"), action.alias("action"), none.alias("entity_ids"),
                              F.lit(None).cast("string").alias("target_fact_id"), F.lit(None).cast("string").alias("role"), ints.alias("starts"), ints.alias("ends"))
    kinds = spark.createDataFrame([], "entity_id string, kind string")
    state, rejects = review.apply_decisions(facts, decisions, kinds)
    return state.select("plan_id", "fact_id", F.col("review_state").alias("result"), F.col("fact_kind").alias("detail")).unionByName(
        rejects.groupBy("plan_id", "code").agg(F.count("*").alias("n")).select("plan_id", F.lit("rejects").alias("fact_id"), F.col("code").alias("result"), F.col("n").cast("string").alias("detail")))


def dependency_candidates(spark, d):
    chunks = reference_chunks(spark, d)
    facts = chunks.withColumn("dependency_unresolved", F.col("ordinal") > 0).withColumn("scope_status", F.lit("unknown")).withColumn("review_state", F.lit("pending"))
    return review.dependency_candidates(facts)


def frozen_selection(spark, d):
    facts = review_facts(spark, d)
    _, digests = review.freeze_selection(facts, F.col("review_state") == "pending")
    return digests


# --- versions ----------------------------------------------------------------------------


def _order_versions(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("created_at"),
                                            F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "published").otherwise("uploaded").alias("status"))


def document_summary(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.lit(None).cast("timestamp").alias("deleted_at"))
    rows = _order_versions(spark, d)
    active = rows.where("status = 'published'").groupBy("document_id").agg(F.max("version_id").alias("active_version_id")).withColumn("scope_key", F.lit("default"))
    return versions.document_summary(docs, rows, active).drop("deleted_at")


def publish_pointer(spark, d):
    rows = _order_versions(spark, d)
    lines = table(spark, d, "lineitem")
    facts = lines.select(F.col("l_orderkey").alias("version_id"), F.when(F.col("l_returnflag") == "R", "excluded").otherwise("rule_confirmed").alias("review_state"))
    blocked = lines.where("l_quantity > 45").select(F.col("l_orderkey").alias("version_id"))
    drafts = lines.where("l_discount = 0.1").select(F.col("l_orderkey").alias("version_id"))
    gate, pointer = versions.publish(rows.select("document_id", "version_id", F.col("created_at").alias("requested_at")), rows, facts, blocked, drafts)
    return pointer.select("document_id", F.col("active_version_id").cast("string").alias("result")).unionByName(gate.where("error_code is not null").groupBy("error_code").agg(
        F.count("*").alias("n")).select(F.lit(-1).cast("long").alias("document_id"), F.concat_ws(":", "error_code", "n").alias("result")))


def idempotent_ingest(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("principal_id"), F.col("o_orderpriority").alias("kb_id"), F.col("o_orderstatus").alias("idempotency_key"),
        F.year("o_orderdate").alias("payload"), F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("content_sha256"), F.lit("p").alias("profile"),
        F.when(F.col("o_orderstatus") == "P", "restore").otherwise("ingest").alias("derivation"), F.col("o_orderkey").alias("seq"))
    return versions.dedupe_ingest(rows)


def access_filter(spark, d):
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    asked = people.select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("principal_id"), F.col("c_custkey").alias("key_id"),
                          F.array_distinct(F.array("n_regionkey", F.lit(0))).alias("kb_ids"))
    grants = people.where("c_acctbal > 0").select(F.col("c_custkey").alias("principal_id"), F.col("n_regionkey").alias("kb_id"), F.lit("read").alias("role")).unionByName(
        people.where("c_acctbal > 5000").select(F.col("c_custkey").alias("principal_id"), F.lit(0).alias("kb_id"), F.lit("write").alias("role")))
    keys = people.select(F.col("c_custkey").alias("key_id"), (F.col("c_acctbal") < 9000).alias("active"), (F.col("c_mktsegment") == "MACHINERY").alias("is_admin"))
    return versions.authorize(asked, grants, keys)


def visible_documents(spark, d):
    rows = _order_versions(spark, d)
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version_id"), "l_linenumber").join(rows.select("version_id", "document_id"), "version_id").withColumn("kb_id", F.lit("tpch"))
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"))
    active = rows.where("status = 'published'").groupBy("document_id").agg(F.max("version_id").alias("active_version_id")).withColumn("scope_key", F.lit("default"))
    seen = versions.visible_chunks(chunks, docs, active).groupBy("document_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("visible"))
    scan = versions.rebuild_scan(chunks, rows, docs).groupBy("document_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("rebuild"))
    return seen.unionByName(scan)


def profile_inventory(spark, d):
    counts, _ = versions.profile_inventory(table(spark, d, "documents").withColumn("processing_profile", F.col("lang")))
    return counts


def revision_check(spark, d):
    changes = table(spark, d, "events").select(F.col("user_id").alias("kb_id"), F.when(F.col("event_type") == "error", "acl").otherwise("content").alias("kind"))
    now, before = versions.revisions(changes), versions.revisions(changes.where("kind = 'content'"))
    return versions.revision_differences(before, now, "acl_revision")


def evidence_snapshot(spark, d):
    """Orders as requests for their lines; lines of status F are visible, parts are nodes and suppliers are entities."""
    lines = table(spark, d, "lineitem")
    asked = lines.groupBy(F.col("l_orderkey").alias("request_id")).agg(F.collect_set("l_partkey").alias("chunk_ids"), F.collect_set("l_suppkey").alias("entity_ids")).withColumn(
        "kb_ids", F.array(F.lit("tpch")))
    visible = table(spark, d, "part").where("p_size < 48").select(F.col("p_partkey").alias("chunk_id"), F.lit("tpch").alias("kb_id"))
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("node_id"))
    known = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("entity_id"), F.lit("tpch").alias("kb_id"))
    bases = lines.agg(F.lit("tpch").alias("kb_id"), F.count("*").alias("content_revision"), F.lit(1).cast("long").alias("acl_revision"))
    out = versions.evidence_snapshot(asked, visible, nodes, known, bases)
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return out.select("request_id", "chunks", "entities", "nodes", "failure", joined("chunk_rows", lambda x: x["chunk_id"].cast("string")).alias("chunk_list"),
                      joined("node_rows", lambda x: F.concat_ws(":", x["chunk_id"], x["node_id"])).alias("node_list"), joined("entity_rows", lambda x: x["entity_id"].cast("string")).alias("entity_list"),
                      joined("revisions", lambda x: F.concat_ws(":", x["kb_id"], x["content_revision"], x["acl_revision"])).alias("revisions"))


KIND = ("case event_type when 'signup' then '{0}' when 'click' then '{1}' when 'view' then '{2}' when 'purchase' then '{3}' else '{4}' end")


def generation_state(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("generation_id"), F.col("event_id").alias("seq"), F.expr(KIND.format("queued", "building", "ready", "active", "failed")).alias("event"))
    return versions.generation_state(events, max_attempts=15)


def projection_verify(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("version_id"), F.col("text").alias("source_text"), F.col("text").alias("search_text"), "lang")
    actual = docs.where("lang <> 'es'").withColumn("search_text", F.when(F.col("lang") == "en", F.concat("search_text", F.lit("!"))).otherwise(F.col("search_text")))
    return projection.verify_projection(docs, actual)


def tombstone_delete(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("document_id"), F.col("lang").alias("version_id"), "doc_id")
    stones = rows.where("document_id = 'src1'").select("document_id", F.lit(None).cast("string").alias("version_id")).unionByName(
        rows.where("version_id = 'de' and document_id < 'src15'").select("document_id", "version_id")).distinct()
    return projection.delete_from_projection(rows, stones).groupBy("document_id", "version_id").agg(F.count("*").alias("n"))


def publication_state(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"), F.expr(KIND.format("publish", "publish", "switch", "publish", "delete")).alias("kind"),
                                              F.col("event_id").alias("version_id"))
    return jobs.publication_state(events)


def job_state(spark, d):
    events = table(spark, d, "events").select(
        F.concat_ws(":", "user_id", F.date_format("ts", "yyyyMMddHH")).alias("job_id"), F.col("event_id").alias("seq"), "ts", F.expr(KIND.format("queued", "claimed", "succeeded", "claimed", "error")).alias("kind"))
    return jobs.job_state(events).select("job_id", "status", "attempts", F.date_format("next_attempt_at", "yyyy-MM-dd HH:mm:ss").alias("next_attempt"))


def stale_versions(spark, d):
    """Tombstones after events: deleted documents whole, switched documents only in their superseded versions."""
    events = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.expr(KIND.format("document_deleted", "publication_switched", "x", "x", "x")).alias("kind"), "event_id")
    state = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), F.when(F.col("o_orderstatus") == "P", "superseded").otherwise("ready").alias("status"))
    last = events.groupBy("document_id").agg(F.max_by("kind", "event_id").alias("kind"))
    return jobs.tombstones(last, state)


def check_requests(spark, d):
    rows = table(spark, d, "benchmark")
    end = F.when(F.length("text") > 150, 11).otherwise(10)
    asked = rows.select(
        F.col("item_id").alias("request_id"), F.col("text").alias("question"), F.array(F.lit("a"), F.when(F.col("text").startswith("T"), "a").otherwise("b")).alias("kb_ids"),
        F.when(F.length("text") > 200, "e1").alias("entity_filter"), F.when(F.length("text") > 250, F.array(F.lit("e1"))).otherwise(F.expr(NO_STRINGS)).alias("entity_filters"),
        F.when(F.contains("text", F.lit("the")), "adaptive").otherwise("ranked").alias("selection_mode"), F.lit(None).cast("string").alias("selection_query"),
        F.array(F.substring("text", 1, 10)).alias("facet_texts"), F.array(F.lit(0)).alias("facet_starts"), F.array(end).alias("facet_ends"), F.array(F.lit("f1")).alias("facet_ids"),
        F.array(F.lit("e2")).alias("binding_ids"), F.lit(True).alias("at_zoned"), F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"))
    return render.check_requests(asked)


def profile_names(spark, d):
    """Processing profile of every source from its frozen inputs; equal inputs give one name."""
    from attestor.operators.links import processing_profile

    rows = table(spark, d, "documents").groupBy(F.col("source").alias("document_id")).agg(F.array_sort(F.collect_set("lang")).alias("languages"))
    return processing_profile(rows).groupBy("processing_profile").agg(F.count("*").alias("documents")).select("documents")


QUERIES = {f.__name__: f for f in (
    document_nodes, header_edges, list_nesting, footnotes, graph_check, graph_digest, required_closure, unit_binding, dependency_edges, chunk_rows, publish_blockers, review_summary,
    review_page, processing_stats, review_options, separate_values, decision_replay, dependency_candidates, frozen_selection, document_summary, publish_pointer, idempotent_ingest,
    access_filter, visible_documents, profile_inventory, revision_check, evidence_snapshot, generation_state, projection_verify, tombstone_delete, publication_state, job_state,
    stale_versions, check_requests, profile_names)}
