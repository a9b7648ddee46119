"""Rank fusion, relation expansion, deduplication, reranking and revalidation."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions import text as tx
from attestor.functions.digests import canonical
from attestor.operators.scope import scope_matches
from attestor.session import broadcast_bounded

# Rank constant and source weights of the reference.
RANK_CONSTANT = 60
SOURCE_WEIGHTS = {"keyword": 1.0, "vector": 1.0, "relation": 0.5}
FUSION_DIGITS = 12


def rrf(rankings: DataFrame, constant: int = RANK_CONSTANT) -> DataFrame:
    """``rankings(request_id, chunk_id, rank)`` of all sources, stacked; raw ranks are kept."""
    return rankings.groupBy("request_id", "chunk_id").agg(
        F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("score")
    )


def fuse(rankings: DataFrame, weights: dict[str, float] | None = None, constant: int = RANK_CONSTANT) -> DataFrame:
    """``rankings(request_id, source, chunk_id, rank)``, each source with its own weight."""
    weights = weights or SOURCE_WEIGHTS
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    weight = F.coalesce(table[F.col("source")], F.lit(1.0))
    return rankings.groupBy("request_id", "chunk_id").agg(
        F.sum(weight / (F.lit(constant) + F.col("rank"))).alias("score"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def rank_fused(fused: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    order = Window.partitionBy("request_id").orderBy(F.round("score", FUSION_DIGITS).desc(), F.col(id_col).asc())
    return fused.withColumn("position", F.row_number().over(order))


def request_filter(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """rows ``request_id, chunk_id`` a request may use.

    ``requests`` carries ``kb_ids`` and optional filters ``document_ids, category, product_model,
    software_version, entity_ids, query_identifiers``; ``chunks`` carries ``kb_id, document_id,
    category, block_kind, scope_status, subjects, identifiers``. The knowledge base is the join key.
    """
    asked = requests.withColumn("kb_id", F.explode("kb_ids"))
    asked = broadcast_bounded(asked, requests.select(F.explode("kb_ids")))
    r, c = asked.alias("r"), chunks.alias("c")

    def unset_or(column: str, test: Column) -> Column:
        return F.col(column).isNull() | test

    def empty_or(column: str, test: Column) -> Column:
        return F.col(column).isNull() | (F.size(column) == 0) | test

    return (
        r.join(c, F.col("r.kb_id") == F.col("c.kb_id"))
        .where(F.col("c.block_kind") != "heading")
        .where(empty_or("r.document_ids", F.array_contains("r.document_ids", F.col("c.document_id"))))
        .where(unset_or("r.category", F.col("r.category").eqNullSafe(F.col("c.category"))))
        .where(scope_matches(F.col("c.scope_status"), F.col("c.subjects"), F.col("r.product_model"),
                             F.col("r.software_version"), F.col("r.entity_ids")))
        .where(empty_or("r.query_identifiers", F.arrays_overlap("r.query_identifiers", "c.identifiers")))
        .select("r.request_id", "c.chunk_id")
    )


# --- relations -----------------------------------------------------------------------


def relation_seeds(requests: DataFrame, entities: DataFrame, aliases: DataFrame, mentions: DataFrame,
                   seed_chunks: DataFrame, limit: int = 20) -> DataFrame:
    """Seed entities of a request: named ids, a name or alias equal to the query, or mentioned in seed chunks.

    The three sources are separate equi-joins, not one join with OR.
    """
    named = requests.select("request_id", "kb_ids", F.explode("entity_ids").alias("entity_id")).join(entities, "entity_id")
    by_name = requests.withColumn("name", F.lower(F.trim("query"))).join(entities.withColumn("name", F.lower("name")), "name")
    by_alias = (
        requests.withColumn("alias", F.lower(F.trim("query")))
        .join(aliases.withColumn("alias", F.lower("alias")), "alias").join(entities, "entity_id")
    )
    mentioned = (
        seed_chunks.select("request_id", "chunk_id").join(mentions, "chunk_id").join(entities, "entity_id")
        .join(requests.select("request_id", "kb_ids"), "request_id")
    )
    columns = ["request_id", "kb_ids", "entity_id", "kb_id"]
    found = (
        named.select(columns).unionByName(by_name.select(columns)).unionByName(by_alias.select(columns))
        .unionByName(mentioned.select(columns))
        .where(F.array_contains("kb_ids", F.col("kb_id"))).select("request_id", "entity_id").distinct()
    )
    order = Window.partitionBy("request_id").orderBy("entity_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


def expand_relations(seeds: DataFrame, relations: DataFrame, evidence: DataFrame, direction: str = "both",
                     limit: int = 30, at: Column | None = None, types: list[str] | None = None,
                     conditions: dict[str, str] | None = None) -> DataFrame:
    """one hop from the seeds, valid at ``at``, with the chunk that supports each relation.

    ``relations(relation_id, subject_id, object_id, relation_type, conditions map, valid_from, valid_until)``;
    ``evidence(relation_id, chunk_id, stance)``. Filters run before the join, and "both" is a union of
    two equi-joins.
    """
    valid = relations
    if at is not None:
        valid = valid.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at))
                            & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))
    if types:
        valid = valid.where(F.col("relation_type").isin(types))
    for key in ("product_model", "software_version"):
        wanted = (conditions or {}).get(key)
        given = F.try_element_at("conditions", F.lit(key))
        valid = valid.where(given.isNull() | (given == F.lit(wanted)) if wanted is not None else given.isNull())
    ways = []
    if direction in ("outgoing", "both"):
        ways.append(seeds.withColumnRenamed("entity_id", "subject_id").join(valid, "subject_id"))
    if direction in ("incoming", "both"):
        ways.append(seeds.withColumnRenamed("entity_id", "object_id").join(valid, "object_id"))
    columns = ["request_id", "relation_id", "subject_id", "object_id", "relation_type"]
    found = ways[0].select(columns)
    for other in ways[1:]:
        found = found.unionByName(other.select(columns))
    found = found.dropDuplicates(["request_id", "relation_id"]) if len(ways) > 1 else found
    rows = found.join(evidence, "relation_id")
    order = Window.partitionBy("request_id").orderBy("relation_id", "chunk_id", "stance")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


def revalidate_relations(found: DataFrame, relations: DataFrame, evidence: DataFrame, visible: DataFrame,
                         at: Column | None = None) -> DataFrame:
    """keep found rows that are still identical, conditions included, still in their interval and still visible. Never expands.

    Rows found with their ``conditions`` (a map) are dropped when these have changed since.
    """
    current = relations
    if at is not None:
        current = current.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at))
                                & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))
    identity = [c for c in ("subject_id", "object_id", "relation_type", "conditions") if c in found.columns and c in relations.columns]
    plain = lambda c, df: F.to_json(F.array_sort(F.map_entries(c))) if c == "conditions" else F.col(c)
    now = current.select("relation_id", *[plain(c, current).alias(f"now_{c}") for c in identity])
    same = F.lit(True)
    for c in identity:
        same = same & plain(c, found).eqNullSafe(F.col(f"now_{c}"))
    return (
        found.join(now, "relation_id").where(same).select(found.columns)
        .join(evidence.select("relation_id", "chunk_id", "stance"), ["relation_id", "chunk_id", "stance"], "left_semi")
        .join(visible.select("chunk_id"), "chunk_id", "left_semi")
    )


def rank_relations(rows: DataFrame, requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """order relation rows by query-word overlap, keep the first row per chunk, rank from 1."""
    words = requests.select("request_id", tx.word_set(F.col("query")).alias("query_words"))
    scored = (
        rows.join(words, "request_id")
        .join(chunks.select("chunk_id", tx.word_set(F.concat_ws(" ", "source_text", "title_text")).alias("chunk_words")), "chunk_id")
        .withColumn("overlap", F.size(F.array_intersect("query_words", "chunk_words")))
    )
    first = scored.groupBy("request_id", "chunk_id").agg(
        F.min(F.struct((-F.col("overlap")).alias("neg"), "relation_id", "stance")).alias("best"))
    order = Window.partitionBy("request_id").orderBy("best.neg", "best.relation_id", "chunk_id", "best.stance")
    return first.select("request_id", "chunk_id", (-F.col("best.neg")).alias("overlap"), F.row_number().over(order).alias("rank"))


# --- after fusion --------------------------------------------------------------------


def dedup_evidence(candidates: DataFrame) -> DataFrame:
    """F16: drop headings, and drop repeats of the same fact in rank order.

    A fact repeats only inside one knowledge base, document and version, with the same scope,
    links and issues; unresolved scope repeats only inside one source unit.
    """
    text = F.regexp_replace(tx.strip(F.col("source_text")), r"\r\n|\r", "\n")
    unit = F.when(F.col("scope_status") != "resolved", F.coalesce("source_unit_id", F.col("chunk_id").cast("string")))
    key = canonical("kb_id", "document_id", "version_id", unit, text, F.to_json("applicability"), F.to_json("context_links"),
                    "dependency_unresolved", F.to_json("dependency_issues"))
    body = candidates.where(F.col("block_kind") != "heading").withColumn("fact_key", F.sha2(key, 256))
    first = Window.partitionBy("request_id", "fact_key").orderBy("position")
    return body.withColumn("n", F.row_number().over(first)).where(F.col("n") == 1).drop("n", "fact_key")


def rerank(candidates: DataFrame, score_fn: Callable | None, top_k: int = 8, window: int = 30) -> DataFrame:
    """score the first ``max(top_k, window)`` (at most 100) candidates of every request with a model.

    ``score_fn`` takes pandas batches with ``query`` and ``search_text`` and returns scores. A request is
    reranked only if all its scores are finite numbers; then everything beyond the window is dropped.
    Otherwise the fused order stays. One candidate alone is never sent.
    """
    size = min(100, max(top_k, window))
    if score_fn is None:
        return candidates.withColumn("rerank_score", F.lit(None).cast("double"))
    per_request = Window.partitionBy("request_id")
    sized = candidates.withColumn("n", F.count("*").over(per_request))
    inside = sized.where((F.col("position") <= size) & (F.col("n") >= 2))
    schema = T.StructType(inside.select("request_id", "chunk_id").schema.fields + [T.StructField("rerank_score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            yield batch[["request_id", "chunk_id"]].assign(rerank_score=score_fn(batch))

    scores = inside.select("request_id", "chunk_id", "query", "search_text").mapInPandas(run, schema)
    joined = candidates.join(scores, ["request_id", "chunk_id"], "left")
    good = F.col("rerank_score").isNotNull() & ~F.isnan("rerank_score") & (F.abs("rerank_score") != float("inf"))
    expected = F.count_if(F.col("position") <= size).over(per_request)
    complete = (F.count_if(good & (F.col("position") <= size)).over(per_request) == expected) & (expected >= 2)
    kept = joined.withColumn("complete", complete).where(~F.col("complete") | (F.col("position") <= size))
    kept = kept.withColumn("rerank_score", F.when(F.col("complete"), F.col("rerank_score")))
    order = Window.partitionBy("request_id").orderBy(
        F.when(F.col("complete"), F.col("rerank_score")).desc_nulls_last(),
        F.when(~F.col("complete"), F.col("position")).asc_nulls_last(), "chunk_id")
    return kept.withColumn("position", F.row_number().over(order)).drop("complete")


def refill_cutoff(requests: DataFrame, first_limit: int = 50, ceiling: int = 100) -> DataFrame:
    """double the candidate limit once where filtering left too few rows or a facet has no literal match.

    Rankings are computed once at ``ceiling``; this only chooses where each request cuts.
    ``requests(request_id, top_k, filtered, kept, missing_facets)``.
    """
    short = ((F.col("filtered") > 0) & (F.col("kept") < F.col("top_k"))) | F.col("missing_facets")
    return requests.withColumn("refilled", short & F.lit(first_limit < ceiling)).withColumn(
        "limit", F.when(F.col("refilled"), F.lit(min(ceiling, 2 * first_limit))).otherwise(F.lit(first_limit)))


def revalidate(candidates: DataFrame, rankings: DataFrame, current: DataFrame) -> DataFrame:
    """after the model calls, keep rows still visible that still have a source, and fuse again.

    ``rankings`` are the direct lists plus the surviving relation list; a row whose only source was a
    removed relation has no ranking row left and goes.
    """
    alive = candidates.join(current.select("chunk_id"), "chunk_id", "left_semi")
    fused = fuse(rankings).select("request_id", "chunk_id", F.col("score").alias("fused_again"))
    kept = alive.join(fused, ["request_id", "chunk_id"])
    score = F.when(F.col("rerank_score").isNull(), F.col("fused_again")).otherwise(F.col("score"))
    order = Window.partitionBy("request_id").orderBy(
        F.col("rerank_score").desc_nulls_last(), F.round("score", FUSION_DIGITS).desc(), "chunk_id")
    return kept.withColumn("score", score).drop("fused_again").withColumn("position", F.row_number().over(order))
