"""Registered queries: texts to headings, blocks, tables, sections and facts; entities, scope and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import text as tx
from attestor.operators import entities, links, scope, structure
from attestor.plans.bindings import document_rows, line_chunks, table
from attestor.plans.retrieval import NO_STRINGS, SUBJECTS, linked_lines

MARKDOWN = (
    "# Conversation {c}\n\n## {r}\n\n{t}\n\n#### Turn {n}\n\nSummary of turn\n-------\n\nNotes:\n\n- role {r}\n- turn {n}\n\n"
    "```\n# not a heading\n\ncode\n```\n\n1. First part\nclosing text\n\n| ignored\n---\n\nlast line"
)


def markdown(spark, d):
    """Every conversation turn as one small Markdown document."""
    rows = table(spark, d, "conversations")
    parts = {"c": F.col("conv_id").cast("string"), "r": F.col("role"), "t": F.col("text"), "n": F.col("turn").cast("string")}
    pieces, rest = [], MARKDOWN
    while "{" in rest:
        at = rest.index("{")
        pieces += [F.lit(rest[:at]), parts[rest[at + 1]]]
        rest = rest[at + 3:]
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat(*pieces, F.lit(rest)).alias("text"))


def marked(spark, d):
    return structure.mark_lines(structure.lines(markdown(spark, d)))


def quality_gate(spark, d):
    return structure.quality_gate(table(spark, d, "documents"))


def detect_markup(spark, d):
    texts = table(spark, d, "documents").select(F.lit("document").alias("kind"), "text").unionByName(
        table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("html").alias("text"))).unionByName(
        markdown(spark, d).select(F.lit("turn").alias("kind"), "text"))
    return texts.groupBy("kind", structure.is_markdown(F.col("text")).alias("markdown")).agg(F.count("*").alias("texts"))


def headings(spark, d):
    return structure.headings(marked(spark, d))


def heading_limit(spark, d):
    """Headings below the first level, as a limit of one level would report them; the default limit is 16."""
    return structure.deep_headings(marked(spark, d), 1)


def title_path(spark, d):
    paths = structure.heading_paths(marked(spark, d))
    return paths.select("doc_id", "line_no", "depth", "level", F.array_join("path", " / ").alias("path"))


def blocks(spark, d):
    rows = structure.blocks(marked(spark, d))
    return rows.select("doc_id", "block_no", "start", "end", F.md5("text").alias("digest"), F.array_join("title_path", " / ").alias("path"),
                       structure.block_kind(F.col("text")).alias("kind"))


def chunk_ranges(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text")
    return structure.chunk_ranges(rows).select("doc_id", "piece_no", "piece_start", "piece_end", "partial")


def fact_limit(spark, d):
    facts = line_chunks(spark, d).select(F.col("kb_id").alias("version_id"))
    return structure.fact_limit(facts, 400)


def pipe_tables(spark, d):
    """The lines with a pipe of each document as one table; the first of them is the header."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("|")))
    rows = table(spark, d, "documents").where(F.contains("text", F.lit("|"))).select("doc_id", lines.alias("l"))
    return rows.select("doc_id", F.concat_ws("\n", F.get("l", F.lit(0)), F.lit("---|---"), F.array_join("l", "\n")).alias("text"))


def pipe_table_cells(spark, d):
    cells = structure.table_cells(pipe_tables(spark, d), ["doc_id"])
    return cells.select("doc_id", "row_index", "column_index", "label", "text")


def pipe_table_rows(spark, d):
    rows = structure.table_rows(pipe_tables(spark, d), ["doc_id"])
    return rows.groupBy("doc_id", "row_index", "continuation").agg(
        F.count("*").alias("pieces"), F.sum(F.length("row_piece")).alias("chars"))


def brand_tables(spark, d):
    """A table per part type: row labels are sizes, product columns are two brands, cells are prices."""
    parts = table(spark, d, "part").groupBy("p_type", "p_size", "p_brand").agg(F.max("p_retailprice").cast("int").alias("price"))
    brands = parts.select("p_type", "p_brand").distinct()
    shape = brands.groupBy("p_type").agg(F.min("p_brand").alias("a"), F.max("p_brand").alias("b"))
    left = shape.join(parts, "p_type").groupBy("p_type", "a", "b", "p_size").agg(
        F.max(F.when(F.col("p_brand") == F.col("a"), F.col("price"))).alias("pa"), F.max(F.when(F.col("p_brand") == F.col("b"), F.col("price"))).alias("pb"))
    row = F.concat_ws("|", F.concat(F.lit("size "), "p_size"), F.coalesce(F.col("pa").cast("string"), F.lit(" ")), F.coalesce(F.col("pb").cast("string"), F.lit(" ")))
    rows = left.groupBy("p_type", "a", "b").agg(F.array_sort(F.collect_list(F.struct("p_size", row.alias("row")))).alias("r"))
    return rows.select("p_type", "a", "b", F.concat_ws("\n", F.concat_ws("|", F.lit("size"), "a", "b"), F.lit("---|---|---"),
                                                       F.array_join(F.transform("r", lambda x: x["row"]), "\n")).alias("text"))


def product_columns(spark, d):
    tables = brand_tables(spark, d)
    cells = structure.table_cells(tables, ["p_type"])
    named = tables.select("p_type", F.posexplode(F.array("a", "b")).alias("i", "entity_id")).select(
        "p_type", (F.col("i") + 1).alias("column_index"), "entity_id")
    facts, review = structure.unpivot_product_columns(cells, named, ["p_type"])
    return facts.select("p_type", "row_index", "entity_id", "text").unionByName(review.select(
        "p_type", "row_index", F.lit("").alias("entity_id"), F.col("review_reason").alias("text")))


def list_clause_split(spark, d):
    """Every document as a list of its lines, split into one fact per item."""
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("- "), F.array_join(F.filter(
        F.split("text", "\n"), lambda x: F.trim(x) != ""), "\n- ")).alias("text"))
    return structure.split_facts(rows, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("facts"), F.sum(F.length("text")).alias("chars"))


def sections(spark, d):
    rows = structure.blocks(marked(spark, d))
    chunks = rows.select(
        F.concat(F.lit("00000000-0000-5000-8000-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("version_id"),
        (F.col("block_no") - 1).alias("ordinal"), "title_path", F.expr(NO_STRINGS).alias("heading_marks"), F.col("text").alias("source_text"))
    tree, _ = structure.sections(chunks)
    return tree.select("version_id", "ordinal", "level", F.array_join("title_path", " / ").alias("path"), F.length("content").alias("chars"),
                       F.col("parent_id").isNull().alias("is_root"))


# --- entities ----------------------------------------------------------------------------


def benchmark_catalog(spark, d):
    """Long words of the benchmark texts, and each with the word behind it, as catalog surfaces."""
    words = table(spark, d, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+"), F.lit(0)).alias("w"))
    pairs = words.select("w", F.posexplode("w").alias("i", "word")).where(F.length("word") >= 8)
    single = pairs.select(F.col("word").alias("entity_id"), F.col("word").alias("surface"))
    double = pairs.where(F.get("w", F.col("i") + 1).isNotNull()).select(
        F.col("word").alias("entity_id"), F.concat_ws(" ", "word", F.get("w", F.col("i") + 1)).alias("surface"))
    return single.unionByName(double).distinct()


def entity_mentions(spark, d):
    return entities.mentions(line_chunks(spark, d), benchmark_catalog(spark, d))


def longest_mentions(spark, d):
    return entities.resolve_overlaps(entity_mentions(spark, d))


def part_sentences(spark, d):
    """One fact per part, phrased by its type, that may name one or two product names."""
    rows = table(spark, d, "part")
    nxt = rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    price = F.col("p_retailprice").cast("int").cast("string")
    text = (
        F.when(F.col("p_type") == "ECONOMY", F.concat("p_name", F.lit(" weight "), F.col("p_size").cast("string"), F.lit(" kg.")))
        .when(F.col("p_type") == "STANDARD", F.concat(F.lit("Note: the "), "p_name", F.lit(" ships with care.")))
        .when(F.col("p_type") == "PROMO", F.concat("p_name", F.lit(" compared with "), F.coalesce("next_name", F.lit("others")), F.lit(" costs "), price))
        .when(F.col("p_type") == "MEDIUM", F.concat(F.lit("This kit contains "), "p_name", F.lit(" and "), F.coalesce("next_name", F.lit("more"))))
        .otherwise(F.concat(F.lit("Disclaimer for size "), F.col("p_size").cast("string"))))
    return rows.join(nxt, "p_partkey", "left").select(F.col("p_partkey").alias("chunk_id"), text.alias("source_text"), "p_type", "p_name", "p_brand")


def part_entities(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("entity_id")).distinct().withColumn(
        "kind", F.when(F.col("entity_id").endswith("ring"), "bundle").otherwise("product"))


def classify_facts(spark, d):
    chunks = part_sentences(spark, d)
    names = part_entities(spark, d)
    found = entities.mentions(chunks, names.select("entity_id", F.col("entity_id").alias("surface")))
    rows = chunks.select("chunk_id", "source_text", F.expr(NO_STRINGS).alias("title_path"), F.lit("unknown").alias("scope_status"),
                         F.expr(NO_STRINGS).alias("subject_ids"), F.expr(NO_STRINGS).alias("curated_ids"))
    out = entities.classify(rows, entities.mention_summary(chunks, found), names)
    return out.select("chunk_id", "fact_kind", "scope_status", F.array_join("subject_ids", ",").alias("subjects"), "review_state", "review_reason")


def resolve_scope(spark, d):
    """Documents whose source binds the language, whose first line may name an entity, and whose source has a default."""
    docs = table(spark, d, "documents")
    first = F.get(F.split("text", "\n"), F.lit(0))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.array(F.col("lang"), first).alias("title_path"),
                         F.col("doc_id").cast("string").alias("source_unit_id"), F.expr(NO_STRINGS).alias("unit_aliases"), F.lit(False).alias("has_row_label"))
    pairs = docs.select("source", "lang").distinct()
    bindings = pairs.where("lang in ('en', 'de')").select(
        F.col("source").alias("document_id"), F.array("lang").alias("title_path"), F.lit(None).cast("string").alias("source_unit_id"),
        F.expr(SUBJECTS.format("lang")).alias("subjects"), F.array(F.lit("bound")).alias("conditions"))
    defaults = pairs.where("lang = 'en' and source < 'src15'").select(
        F.col("source").alias("document_id"), F.expr(SUBJECTS.format("lang")).alias("subjects"), F.expr(NO_STRINGS).alias("conditions"))
    mentioned = docs.where(F.length(first) < 60).select(
        F.col("doc_id").alias("chunk_id"), F.lit(2).alias("label_no"), F.col("lang").alias("entity_id"), F.col("lang").alias("display_name"),
        F.lit(None).cast("string").alias("product_model"), F.lit(None).cast("string").alias("software_version"))
    out = scope.resolve_scope(chunks, bindings, mentioned, defaults)
    return out.select("chunk_id", "scope_status", F.array_join(F.transform("subjects", lambda s: s["display_name"]), ",").alias("subjects"),
                      F.array_join("conditions", ",").alias("conditions"), F.array_join("reason_codes", ",").alias("reasons"))


def scope_filter(spark, d):
    from attestor.plans.retrieval import scoped_documents

    none = F.lit(None).cast("string")
    ok = scope.scope_matches(F.col("scope_status"), F.col("subjects"), none, none, F.array(F.lit("en"), F.lit("fr")))
    return scoped_documents(spark, d).where(ok).groupBy("kb_id").agg(F.count("*").alias("chunks"))


def scope_compatible_pairs(spark, d):
    """Adjacent questions: each document's first line with every line of the document."""
    chunks = linked_lines(spark, d)
    out = scope.scope_compatible_join(chunks.where("ordinal = 0"), chunks)
    return out.groupBy("hit_id").agg(F.count("*").alias("candidates"))


def reference_chunks(spark, d):
    """Turns of a conversation as sections; a turn refers to the one before it by its title."""
    rows = table(spark, d, "conversations")
    title = F.concat(F.lit("Conditions "), F.col("turn").cast("string"))
    body = F.when(F.col("turn") > 0, F.concat(F.lit("See section \"Conditions "), (F.col("turn") - 1).cast("string"), F.lit("\". "), "text")).otherwise(
        F.concat(F.lit("See section \"Missing conditions\". "), "text"))
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("version_id"), F.col("turn").cast("int").alias("ordinal"),
        F.array(title).alias("title_path"), F.concat_ws(":", "conv_id", "turn").alias("section_id"), body.alias("source_text"))


def reference_binding(spark, d):
    chunks = reference_chunks(spark, d)
    bound, issues = links.bind_references(chunks, chunks)
    return bound.select("chunk_id", F.col("target_id").cast("string").alias("target"), "role").unionByName(
        issues.select("chunk_id", F.lit("").alias("target"), F.col("code").alias("role")))


def link_validation(spark, d):
    """Lines linked to their document's first line, plus broken links of several kinds."""
    base = linked_lines(spark, d)
    extra = lambda target: F.expr(f"array(named_struct('chunk_id', cast({target} as bigint), 'role', 'condition', 'required', true, 'provenance', "
                                  "cast(null as struct<kind:string,source_unit_id:string,target_unit_id:string,provenance_id:string,reference_text:string>)))")
    changed = base.withColumn("context_links", F.when(F.col("ordinal") == 1, F.concat("context_links", extra("chunk_id")))
                              .when(F.col("ordinal") == 2, F.concat("context_links", extra("chunk_id + 1")))
                              .when(F.col("ordinal") == 3, F.concat("context_links", extra("chunk_id - 1"))).otherwise(F.col("context_links")))
    return links.validate_links(changed).groupBy("code").agg(F.count("*").alias("n"))


def continuation_star(spark, d):
    chunks = line_chunks(spark, d).select("chunk_id", F.col("document_id").alias("version_id"), "ordinal",
                                          F.col("document_id").cast("string").alias("source_unit_id"), (F.length("source_text") > 200).alias("dependency_unresolved"))
    return links.bind_continuations(chunks).groupBy("target_id").agg(F.count("*").alias("pieces"))


def curated_dependencies(spark, d):
    chunks = reference_chunks(spark, d).select(
        "chunk_id", F.col("version_id").alias("document_id"), "version_id", "section_id", "title_path", "source_text", F.col("section_id").alias("source_unit_id"))
    ids = chunks.select("document_id").distinct()
    bindings = ids.select(
        F.col("document_id").alias("binding_id"), "document_id", F.array(F.lit("Conditions 1")).alias("source_path"), F.lit(None).cast("string").alias("source_unit"),
        F.array(F.lit("Conditions 2")).alias("target_path"), F.lit(None).cast("string").alias("target_unit"), F.lit("condition").alias("role"),
        F.lit("See section").alias("reference_text"))
    bound, errors = links.bind_curated(chunks, bindings)
    return bound.select("binding_id", F.col("target_id").cast("string").alias("result")).unionByName(errors.select("binding_id", F.col("code").alias("result")))


def ambiguous_aliases(spark, d):
    rows = table(spark, d, "part").select(F.col("p_type").alias("kb_id"), F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), "p_brand")
    return entities.ambiguous_aliases(rows, rows.select("entity_id", F.col("p_brand").alias("alias")))


def unmatched_bindings(spark, d):
    docs = table(spark, d, "documents")
    bindings = docs.select(F.col("source").alias("document_id")).distinct().withColumn("title_path", F.explode(F.array(
        *[F.array(F.lit(x)) for x in ("en", "fr", "de", "es", "zh")]))).withColumn("source_unit_id", F.lit(None).cast("string")).withColumn(
        "binding_id", F.concat_ws(":", "document_id", F.get("title_path", F.lit(0))))
    chunks = docs.select(F.col("source").alias("document_id"), F.array("lang").alias("title_path"), F.col("doc_id").cast("string").alias("source_unit_id"),
                         F.expr(NO_STRINGS).alias("unit_aliases"))
    return links.unmatched_bindings(bindings, chunks).select("binding_id")


def relocate_selectors(spark, d):
    """Suppliers move from old to new unit names; part of the old units have several new ones."""
    rows = table(spark, d, "lineitem")
    chunks = rows.select(F.col("l_returnflag").alias("version_id"), F.col("l_suppkey").cast("string").alias("origin_source_unit_id"),
                         F.concat(F.lit("unit-"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey").cast("string")).otherwise(
                             F.concat_ws("-", "l_suppkey", "l_linenumber"))).alias("source_unit_id"))
    bindings = rows.select(F.col("l_returnflag").alias("version_id"), F.col("l_suppkey").cast("string").alias("source_unit_id")).distinct().withColumn(
        "binding_id", F.concat_ws(":", "version_id", "source_unit_id"))
    return links.relocate_selectors(bindings, chunks).select("binding_id", "source_unit_id", "requires_reprocess")


def identifier_terms(spark, d):
    out = document_rows(spark, d).select(F.col("chunk_id").alias("doc_id"), F.explode(tx.identifiers(F.col("source_text"))).alias("identifier"))
    return out


QUERIES = {
    "quality_gate": quality_gate, "detect_markup": detect_markup, "headings": headings, "title_path": title_path, "blocks": blocks,
    "chunk_ranges": chunk_ranges, "fact_limit": fact_limit, "pipe_table_cells": pipe_table_cells, "pipe_table_rows": pipe_table_rows,
    "heading_limit": heading_limit, "product_columns": product_columns, "list_clause_split": list_clause_split, "sections": sections, "entity_mentions": entity_mentions,
    "longest_mentions": longest_mentions, "classify_facts": classify_facts, "resolve_scope": resolve_scope, "scope_filter": scope_filter,
    "scope_compatible_pairs": scope_compatible_pairs, "reference_binding": reference_binding, "link_validation": link_validation,
    "continuation_star": continuation_star, "curated_dependencies": curated_dependencies, "ambiguous_aliases": ambiguous_aliases,
    "unmatched_bindings": unmatched_bindings, "relocate_selectors": relocate_selectors, "identifier_terms": identifier_terms,
}
