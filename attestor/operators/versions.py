"""Visibility, versions, revisions, access and generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.digests import multiset_digest, uuid5

ROLE_LEVELS = {"read": 1, "write": 2, "admin": 3}


def visible_chunks(chunks: DataFrame, documents: DataFrame, publications: DataFrame, kb_ids: list[str] | None = None) -> DataFrame:
    """A4: chunks of live documents whose version is the active publication; ``kb_ids`` prune partitions."""
    rows = chunks.where(F.col("kb_id").isin(kb_ids)) if kb_ids else chunks
    active = publications.where("scope_key = 'default'").select("document_id", F.col("active_version_id").alias("version_id"))
    live = documents.where("deleted_at is null").select("document_id")
    return rows.join(active, ["document_id", "version_id"], "left_semi").join(live, "document_id", "left_semi")


def rebuild_scan(chunks: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """A5: all chunks of ready or published versions of live documents."""
    usable = versions.where(F.col("status").isin("ready", "published")).select("version_id")
    return chunks.join(usable, "version_id", "left_semi").join(documents.where("deleted_at is null").select("document_id"), "document_id", "left_semi")


def page(df: DataFrame, order: list, limit: int, offset: int = 0, after: dict | None = None) -> DataFrame:
    """One page. ``after`` (key column and last value) reads forward without counting skipped rows."""
    for column, value in (after or {}).items():
        df = df.where(F.col(column) > F.lit(value))
    ordered = df.orderBy(*order)
    return (ordered if after else ordered.offset(offset)).limit(limit)


def document_summary(documents: DataFrame, versions: DataFrame, publications: DataFrame) -> DataFrame:
    """Version count, latest and active version per live document. One aggregation, no sort of versions."""
    latest = versions.groupBy("document_id").agg(
        F.count("*").alias("version_count"), F.max_by(F.struct("version_id", "status"), F.struct("created_at", "version_id")).alias("latest"))
    active = publications.where("scope_key = 'default'").select("document_id", "active_version_id")
    return documents.where("deleted_at is null").join(latest, "document_id", "left").join(active, "document_id", "left").select(
        *documents.columns, F.coalesce("version_count", F.lit(0)).alias("version_count"), F.col("latest.version_id").alias("latest_version_id"),
        F.col("latest.status").alias("latest_status"), "active_version_id")


def dedupe_ingest(requests: DataFrame) -> DataFrame:
    """Outcome per request: first, replay (same key and payload), conflict (same key, other payload), or duplicate
    (same content and profile already ingested for the document; a restore is exempt).

    ``requests(request_id, principal_id, kb_id, idempotency_key, payload, document_id, content_sha256, profile, derivation, seq)``.
    First rows come from pre-aggregated minima, so a hot key is reduced before it is shuffled.
    """
    key = ["principal_id", "kb_id", "idempotency_key"]
    first = requests.groupBy(*key).agg(F.min(F.struct("seq", "payload")).alias("f"))
    rows = requests.join(first, key).withColumn("is_first", F.col("seq") == F.col("f.seq"))
    content = ["document_id", "content_sha256", "profile"]
    earliest = rows.where("is_first and derivation in ('ingest', 'reprocess')").groupBy(*content).agg(F.min("seq").alias("earliest"))
    rows = rows.join(earliest, content, "left")
    outcome = (
        F.when(~F.col("is_first") & (F.col("payload") == F.col("f.payload")), "replay").when(~F.col("is_first"), "idempotency_key_payload_mismatch")
        .when((F.col("derivation") != "restore") & (F.col("seq") > F.col("earliest")), "duplicate_document_version").otherwise("first"))
    return rows.select("request_id", outcome.alias("outcome"))


def restore_version(chunks: DataFrame, links: DataFrame, new_version: Column) -> tuple[DataFrame, DataFrame]:
    """Facts of an old version under new ids, with links moved along."""
    rows = chunks.withColumn("old_id", F.col("chunk_id")).withColumn("version_id", new_version).withColumn(
        "chunk_id", uuid5(new_version, F.col("old_id").cast("string")))
    ids = rows.select("old_id", F.col("chunk_id").alias("new_id"))
    moved = links.join(ids.select(F.col("old_id").alias("chunk_id"), F.col("new_id").alias("source_id")), "chunk_id").join(
        ids.select(F.col("old_id").alias("target_id"), F.col("new_id").alias("new_target")), "target_id")
    return rows.drop("old_id"), moved.select(F.col("source_id").alias("chunk_id"), F.col("new_target").alias("target_id"),
                                             *[c for c in links.columns if c not in ("chunk_id", "target_id")])


def revisions(changes: DataFrame) -> DataFrame:
    """Revision counters per knowledge base: one step per change. ``changes(kb_id, kind)``."""
    return changes.groupBy("kb_id").agg(F.count_if(F.col("kind") == "content").alias("content_revision"), F.count_if(F.col("kind") == "acl").alias("acl_revision"))


def revision_differences(left: DataFrame, right: DataFrame, column: str = "content_revision") -> DataFrame:
    """Knowledge bases whose revision differs or is missing on one side."""
    return left.select("kb_id", F.col(column).alias("left_revision")).join(right.select("kb_id", F.col(column).alias("right_revision")), "kb_id", "full_outer").where(
        ~F.col("left_revision").eqNullSafe(F.col("right_revision")))


def authorize(requests: DataFrame, grants: DataFrame, keys: DataFrame, need: str = "read") -> DataFrame:
    """E5: ``request_id, allowed``. The key must be active and the role high enough on every requested knowledge base;
    admins pass; one missing grant denies the whole request.

    ``requests(request_id, principal_id, key_id, kb_ids)``; ``grants(principal_id, kb_id, role)``; ``keys(key_id, active, is_admin)``.
    """
    level = F.create_map(*[F.lit(x) for pair in ROLE_LEVELS.items() for x in pair])
    asked = requests.select("request_id", "principal_id", "key_id", F.explode("kb_ids").alias("kb_id"))
    held = grants.groupBy("principal_id", "kb_id").agg(F.max(level[F.col("role")]).alias("level"))
    rows = asked.join(held, ["principal_id", "kb_id"], "left").join(keys, "key_id", "left")
    enough = F.coalesce("is_admin", F.lit(False)) | (F.coalesce("level", F.lit(0)) >= ROLE_LEVELS[need])
    return rows.groupBy("request_id").agg(F.bool_and(F.coalesce("active", F.lit(False)) & enough).alias("allowed"))


def profile_inventory(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(chunks per profile, one-row name)``: the profile if there is one, else a hash of the mix."""
    counts = chunks.groupBy("processing_profile").agg(F.count("*").alias("chunks"))
    name = counts.agg(F.when(F.count("*") == 1, F.min("processing_profile")).otherwise(F.concat(F.lit("mixed:"), multiset_digest(
        F.sha2(F.concat_ws(":", "processing_profile", F.col("chunks").cast("string")), 256)))).alias("chunking_version"))
    return counts, name


def generation_is_fresh(built: DataFrame, current: DataFrame) -> DataFrame:
    """One row ``fresh``: no knowledge base moved since the build."""
    return revision_differences(built, current).agg((F.count("*") == 0).alias("fresh"))


def evidence_snapshot(requests: DataFrame, visible: DataFrame, unit_nodes: DataFrame, entities: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """Per request: its visible chunks, their nodes, its entities and the revisions of its bases, or why there is no package.

    ``requests(request_id, kb_ids, chunk_ids, entity_ids)``; ``visible(chunk_id, kb_id, ...)`` of one state (``read_committed``);
    ``unit_nodes(chunk_id, node_id)``; ``entities(entity_id, kb_id, ...)``; ``bases(kb_id, content_revision, acl_revision)``. Any missing chunk, entity or
    base fails the request. ``chunk_rows``, ``node_rows``, ``entity_rows`` and ``revisions`` hold all given columns, in order of
    ids; they are null where the request fails. A package is as long as the request's own lists.
    """
    asked = requests.select("request_id", "kb_ids", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"))
    found = asked.join(visible, "chunk_id").where(F.array_contains("kb_ids", F.col("kb_id")))
    rows_of = lambda df, first: F.sort_array(F.collect_list(F.struct(first, *[c for c in df.columns if c != first])))
    chunks = found.groupBy("request_id").agg(F.count("*").alias("chunks"), rows_of(visible, "chunk_id").alias("chunk_rows"))
    nodes = found.select("request_id", "chunk_id").join(unit_nodes, "chunk_id").groupBy("request_id").agg(
        F.count_distinct("node_id").alias("nodes"), F.sort_array(F.collect_set(F.struct("chunk_id", "node_id"))).alias("node_rows"))
    known = requests.select("request_id", "kb_ids", F.explode(F.array_distinct("entity_ids")).alias("entity_id")).join(entities, "entity_id").where(
        F.array_contains("kb_ids", F.col("kb_id"))).groupBy("request_id").agg(F.count("*").alias("entities"), rows_of(entities, "entity_id").alias("entity_rows"))
    rows = requests.join(chunks, "request_id", "left").join(known, "request_id", "left").join(nodes, "request_id", "left")
    if bases is not None:
        held = requests.select("request_id", F.explode(F.array_distinct("kb_ids")).alias("kb_id")).join(bases, "kb_id").groupBy("request_id").agg(
            F.count("*").alias("bases"), F.sort_array(F.collect_list(F.struct("kb_id", "content_revision", "acl_revision"))).alias("revisions"))
        rows = rows.join(held, "request_id", "left")
    else:
        rows = rows.withColumns({"bases": F.size(F.array_distinct("kb_ids")), "revisions": F.lit(None).cast("array<struct<kb_id:string,content_revision:bigint,acl_revision:bigint>>")})
    rows = rows.fillna(0, ["chunks", "entities", "nodes", "bases"])
    failure = F.when(F.col("bases") < F.size(F.array_distinct("kb_ids")), "knowledge_base_not_found").when(
        F.col("entities") < F.size(F.array_distinct("entity_ids")), "context_binding_not_found_in_authorized_scope").when(
        F.col("chunks") < F.size(F.array_distinct("chunk_ids")), "evidence_snapshot_changed")
    rows = rows.withColumn("failure", failure)
    payload = [F.when(F.col("failure").isNull(), F.col(c)).alias(c) for c in ("chunk_rows", "node_rows", "entity_rows", "revisions")]
    return rows.select("request_id", "chunks", "entities", "nodes", "failure", *payload)


def generation_state(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Current state per generation from its events ``generation_id, seq, event``.

    queued, building, ready, active, retired or failed. A failed build is queued again until its attempts run out;
    activating one generation retires the one active before it.
    """
    terminal = events.groupBy("generation_id").agg(
        F.max_by("event", "seq").alias("event"), F.max("seq").alias("seq"), F.count_if(F.col("event") == "building").alias("attempts"),
        F.max(F.when(F.col("event") == "active", F.col("seq"))).alias("activated"))
    newest = events.where("event = 'active'").agg(F.max("seq").alias("newest"))
    rows = terminal.join(F.broadcast(newest), F.lit(True), "left")  # one row
    status = (
        F.when((F.col("event") == "active") & (F.col("activated") < F.col("newest")), "retired")
        .when((F.col("event") == "failed") & (F.col("attempts") < max_attempts), "queued").otherwise(F.col("event")))
    return rows.select("generation_id", status.alias("status"), "attempts", "seq")


def generation_invariants(state: DataFrame) -> DataFrame:
    """At most one active and one pending generation; any row is a violation."""
    return state.agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status").isin("queued", "building", "ready")).alias("pending")).where(
        "active > 1 or pending > 1")


def publish(requests: DataFrame, versions: DataFrame, facts: DataFrame, blocked: DataFrame, open_drafts: DataFrame, limit: int = 10000) -> tuple[DataFrame, DataFrame]:
    """``(gate result per request, new pointer per document)``.

    ``requests(document_id, version_id, requested_at)``; ``versions(version_id, status)``; ``facts(version_id, review_state)``;
    ``blocked(version_id)``; ``open_drafts(version_id)``. The pointer goes to the latest request that passes.
    """
    sizes = facts.groupBy("version_id").agg(F.count("*").alias("facts"), F.count_if(F.col("review_state") != "excluded").alias("kept"))
    stops = blocked.groupBy("version_id").agg(F.count("*").alias("blocking"))
    drafts = open_drafts.select("version_id").distinct().withColumn("draft", F.lit(True))
    rows = requests.join(versions.select("version_id", "status"), "version_id", "left").join(sizes, "version_id", "left").join(stops, "version_id", "left").join(drafts, "version_id", "left")
    code = (
        F.when(F.col("status").isNull(), "document_version_not_found").when(~F.col("status").isin("ready", "published"), "version_not_ready")
        .when((F.col("status") == "ready") & F.coalesce("draft", F.lit(False)), "review_changes_not_applied")
        .when((F.coalesce("facts", F.lit(0)) == 0) | (F.col("facts") > limit) | (F.coalesce("blocking", F.lit(0)) > 0) | (F.col("kept") == 0), "review_required_before_publish"))
    gate = rows.select("document_id", "version_id", "requested_at", code.alias("error_code"))
    pointer = gate.where("error_code is null").groupBy("document_id").agg(F.max_by("version_id", F.struct("requested_at", "version_id")).alias("active_version_id"))
    return gate, pointer
