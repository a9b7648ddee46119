"""Document tree, edges, closure, digest, and chunk rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as tx
from attestor.functions.digests import multiset_digest, row_digest, uuid5
from attestor.operators.scope import STRUCTURAL_ROLES
from attestor.operators.structure import MAX_DEPTH, block_kind

# Limits of the document tree and the search text template.
MAX_TREE_DEPTH, CLOSURE_DEPTH, CLOSURE_NODES = 32, 3, 16
SEARCH_TEXT, SEARCH_PREFIX = 16000, 2000
LIST_MARK = r"(?m)^([ \t]*)(?:[·•*+\-]\s+|\d+[.)]\s+)"
FOOTNOTE = r"\[\^([^]]+)\]"


def block_nodes(block_rows: DataFrame) -> DataFrame:
    """Document, section and block nodes with parents.

    ``block_rows(doc_id, block_no, text, title_path)``. Node keys are readable paths; a section is keyed by the
    block that opens it, so repeated equal headings stay separate.
    """
    order = Window.partitionBy("doc_id").orderBy("block_no")
    none = F.expr("cast(array() as array<string>)")
    rows = block_rows.withColumn("last_path", F.coalesce(F.lag("title_path").over(order), none))
    differs = F.transform("title_path", lambda p, i: ~F.coalesce(F.get("last_path", i) == p, F.lit(False)))
    opened = F.array_position(differs, F.lit(True))
    rows = rows.withColumn("common", F.when(opened > 0, opened - 1).otherwise(F.size("title_path")).cast("int"))
    # block that opened the current section of each level; one window serves all levels
    slots = [F.last(F.when((F.col("common") < k) & (F.size("title_path") >= k), F.col("block_no")), ignorenulls=True).over(order) for k in range(1, MAX_DEPTH + 1)]
    rows = rows.withColumn("opened", F.array(*slots)).withColumn("first", F.lag("block_no").over(order).isNull())
    key = lambda level: F.when(level < 1, F.lit("root")).otherwise(F.concat_ws(":", F.lit("section"), F.get("opened", level - 1), level))

    def node(node_key, parent_key, kind, text, at, depth) -> Column:
        return F.struct(node_key.alias("node_key"), parent_key.alias("parent_key"), kind.alias("kind"), text.alias("text"), at.cast("int").alias("at"), depth.cast("int").alias("depth"))

    depth = F.size("title_path")
    here = F.filter(F.transform("title_path", lambda title, i: F.struct(title.alias("title"), (i + 1).alias("level"))),
                    lambda s: F.get("opened", s["level"] - 1) == F.col("block_no"))
    sections_here = F.transform(here, lambda s: node(key(s["level"]), key(s["level"] - 1), F.lit("section"), s["title"], F.col("block_no"), s["level"]))
    leaf = node(F.concat(F.lit("block:"), "block_no"), key(depth), block_kind(F.col("text")), F.col("text"), F.col("block_no"), F.lit(100))
    root = node(F.lit("root"), F.lit(None).cast("string"), F.lit("document"), F.lit(""), F.lit(0), F.lit(0))
    nodes = F.concat(F.when(F.col("first"), F.array(root)).otherwise(F.slice(F.array(root), 1, 0)), sections_here, F.array(leaf))
    number = Window.partitionBy("doc_id").orderBy("at", "depth", "node_key")
    return rows.select("doc_id", F.explode(nodes).alias("n")).select("doc_id", "n.*").withColumn("ordinal", F.row_number().over(number) - 1).drop("at", "depth")


def structure_edges(nodes: DataFrame) -> DataFrame:
    """``parent_of`` for every node and ``next_in_structure`` between blocks of one parent."""
    parent = nodes.where("parent_key is not null").select(
        "doc_id", F.col("parent_key").alias("source_key"), F.col("node_key").alias("target_key"), F.lit("parent_of").alias("type"), F.lit(False).alias("required"))
    order = Window.partitionBy("doc_id", "parent_key").orderBy("ordinal")
    following = nodes.where(~F.col("kind").isin("document", "section", "row", "cell", "list_item")).withColumn("before", F.lag("node_key").over(order)).where("before is not null").select(
        "doc_id", F.col("before").alias("source_key"), F.col("node_key").alias("target_key"), F.lit("next_in_structure").alias("type"), F.lit(False).alias("required"))
    return parent.unionByName(following)


def header_edges(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The header cell of a column governs every body cell of it: ``keys, column_index, row_index``.

    The header row is one row per table, so the join on table and column cannot fan out.
    """
    header = cells.select(*keys, F.posexplode(F.regexp_extract_all("header_line", F.lit(r"(?:\\.|[^|])+"), F.lit(0))).alias("column_index", "header_text")).distinct()
    return cells.select(*keys, "row_index", "column_index").join(header, [*keys, "column_index"]).select(
        *keys, "column_index", "row_index", F.trim("header_text").alias("header_text"), F.lit("header_for").alias("type"), F.lit(True).alias("required"))


def list_items(block_rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, item_no, indent, parent_no``: the parent is the nearest earlier item with a smaller indent.

    Only the indents of a block's items leave the row, and each is looked at once.
    """
    # marks at the line start; tabs count as four columns
    marks = F.regexp_extract_all("text", F.lit(LIST_MARK), F.lit(1))
    indents = F.transform(marks, lambda m: F.length(F.replace(m, F.lit("\t"), F.lit("    "))))
    rows = block_rows.where(block_kind(F.col("text")) == "list").select(*keys, indents.alias("indents")).withColumn("parents", F.pandas_udf(_nearest_smaller, "array<int>")("indents"))
    return rows.select(*keys, F.posexplode(F.arrays_zip("indents", "parents")).alias("item_no", "s")).select(
        *keys, "item_no", F.col("s.indents").alias("indent"), F.col("s.parents").alias("parent_no"))


def _nearest_smaller(lists: pd.Series) -> pd.Series:
    """Per list of numbers, the place of the nearest smaller one to the left of each: a stack of the places that can still be one."""
    def places(values):
        out, stack = [], []
        for i, value in enumerate(values):
            while stack and values[stack[-1]] >= value:
                stack.pop()
            out.append(stack[-1] if stack else None)
            stack.append(i)
        return out

    return lists.map(places)


def footnote_links(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(links, issues)``: a marker links to its only definition in the document; none or several is an issue."""
    definitions = nodes.where("kind = 'footnote'").select("doc_id", F.col("node_key").alias("definition_key"), F.regexp_extract("text", r"^\s*\[\^([^]]+)\]:", 1).alias("label"))
    counted = definitions.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.min("definition_key").alias("definition_key"))
    markers = nodes.where(F.col("kind").isin("paragraph", "list", "table")).select(
        "doc_id", "node_key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(FOOTNOTE), F.lit(1)))).alias("label"))
    joined = markers.join(counted, ["doc_id", "label"], "left")
    links = joined.where("n = 1").select("doc_id", F.col("definition_key").alias("source_key"), F.col("node_key").alias("target_key"),
                                         F.lit("footnote_for").alias("type"), F.lit(True).alias("required"))
    issues = joined.where("n is null or n > 1").select("doc_id", "node_key", "label", F.lit("unresolved_footnote").alias("code"))
    return links, issues


def validate_graph(nodes: DataFrame, edges: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Violations ``doc_id, code, key``.

    One root of kind document, known parents, depth at most 32, known endpoints, no self or repeated edge, and
    units that point to known nodes. Depth is found by doubling: after five joins every node knows its ancestor
    32 levels up.
    """
    ids = nodes.select("doc_id", "node_key")
    roots = nodes.where("parent_key is null").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and(F.col("kind") == "document").alias("fine"))
    bad_root = ids.select("doc_id").distinct().join(roots, "doc_id", "left").where("n is null or n <> 1 or not fine").select(
        "doc_id", F.lit("document_tree_requires_one_root").alias("code"), F.lit("").alias("key"))
    repeated = ids.groupBy("doc_id", "node_key").agg(F.count("*").alias("n")).where("n > 1").select(
        "doc_id", F.lit("invalid_document_tree_parent_or_duplicate").alias("code"), F.col("node_key").alias("key"))
    orphan = nodes.where("parent_key is not null").select("doc_id", "node_key", F.col("parent_key")).join(
        ids.withColumnRenamed("node_key", "parent_key"), ["doc_id", "parent_key"], "left_anti").select(
        "doc_id", F.lit("invalid_document_tree_parent_or_duplicate").alias("code"), F.col("node_key").alias("key"))
    up = nodes.where("parent_key is not null").select("doc_id", "node_key", F.col("parent_key").alias("up"))
    for _ in range(5):
        up = up.join(up.select("doc_id", F.col("node_key").alias("up"), F.col("up").alias("further")), ["doc_id", "up"]).select("doc_id", "node_key", F.col("further").alias("up"))
    deep = up.join(nodes.where("parent_key is not null").select("doc_id", F.col("node_key").alias("up")), ["doc_id", "up"], "left_semi").select(
        "doc_id", F.lit("document_tree_depth_limit").alias("code"), F.col("node_key").alias("key"))
    self_edge = edges.where("source_key = target_key").select("doc_id", F.lit("document_edge_endpoint_invalid").alias("code"), F.col("source_key").alias("key"))
    ends = edges.select("doc_id", F.explode(F.array("source_key", "target_key")).alias("node_key")).join(ids, ["doc_id", "node_key"], "left_anti").select(
        "doc_id", F.lit("document_edge_endpoint_invalid").alias("code"), F.col("node_key").alias("key"))
    twice = edges.groupBy("doc_id", "source_key", "target_key", "type").agg(F.count("*").alias("n")).where("n > 1").select(
        "doc_id", F.lit("duplicate_document_edge").alias("code"), F.col("source_key").alias("key"))
    found = bad_root.unionByName(repeated).unionByName(orphan).unionByName(deep).unionByName(self_edge).unionByName(ends).unionByName(twice)
    if units is not None:
        again = units.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("n")).where("n > 1").select(
            "doc_id", F.lit("duplicate_retrieval_unit").alias("code"), F.col("chunk_id").cast("string").alias("key"))
        lost = units.where("node_key is not null").join(ids, ["doc_id", "node_key"], "left_anti").select(
            "doc_id", F.lit("retrieval_unit_source_missing").alias("code"), F.col("chunk_id").cast("string").alias("key"))
        found = found.unionByName(again).unionByName(lost)
    return found.distinct()


def bind_units(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id, chunk_id, node_key``: longest prefix of the parser key that is a node; else the only node of
    the same title path that contains the text; else null.

    ``chunks(doc_id, chunk_id, parser_key, title_path, source_text)``; ``nodes(doc_id, node_key, kind, title_path, text)``.
    """
    leaves = nodes.where(F.col("kind").isin("paragraph", "table", "list", "code", "footnote"))
    parts = F.split(F.coalesce("parser_key", F.lit("")), ":")
    prefixes = chunks.select("doc_id", "chunk_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ":"))).alias("node_key"))
    by_key = prefixes.join(leaves.select("doc_id", "node_key"), ["doc_id", "node_key"]).groupBy("doc_id", "chunk_id").agg(
        F.max_by("node_key", F.length("node_key")).alias("node_key"))
    rest = chunks.join(by_key, ["doc_id", "chunk_id"], "left_anti")
    by_text = rest.join(leaves.select("doc_id", "node_key", "title_path", F.col("text").alias("node_text")), ["doc_id", "title_path"]).where(
        F.contains("node_text", F.col("source_text"))).groupBy("doc_id", "chunk_id").agg(F.count("*").alias("n"), F.min("node_key").alias("node_key")).where("n = 1").drop("n")
    return chunks.select("doc_id", "chunk_id").join(by_key.unionByName(by_text), ["doc_id", "chunk_id"], "left")


def scope_assertions(chunks: DataFrame) -> DataFrame:
    """One assertion per unit: known, unknown, ambiguous or not_applicable."""
    status = F.when(F.col("fact_kind") == "general", "not_applicable").when(F.col("scope_status") == "resolved", "known").otherwise(F.col("scope_status"))
    return chunks.select("version_id", "chunk_id", status.alias("status"), "subjects", "conditions")


def scope_counts(assertions: DataFrame) -> DataFrame:
    return assertions.groupBy("version_id", "status").agg(F.count("*").alias("n"))


def dependency_edges(links: DataFrame, units: DataFrame) -> DataFrame:
    """Links of chunks as edges of their nodes. ``links(chunk_id, target_id, role, required)``."""
    source = units.select("chunk_id", F.col("node_key").alias("source_key"), "doc_id")
    target = units.select(F.col("chunk_id").alias("target_id"), F.col("node_key").alias("target_key"))
    kind = F.when(F.col("role") == "exception", "exception_to").when(F.col("role") == "continuation", "continuation_of").otherwise("governed_by")
    return links.join(source, "chunk_id").join(target, "target_id").where("source_key is not null and target_key is not null and source_key <> target_key").select(
        "doc_id", "source_key", "target_key", kind.alias("type"), "required").dropDuplicates(["doc_id", "source_key", "target_key", "type"])


def required_closure(edges: DataFrame, max_depth: int = CLOSURE_DEPTH, max_nodes: int = CLOSURE_NODES) -> DataFrame:
    """Required nodes within ``max_depth`` steps: ``doc_id, main, node_keys, issue``.

    Header and footnote edges point from the dependency to the dependent and are turned round first. A node's state is one
    row: the nodes seen and those of the last step, each with a way there. Every step is one join on the edge table, where a node counts
    with its ``max_nodes + 1`` smallest targets, and keeps as many new nodes at most; what has more than ``max_nodes`` is not followed
    further. A cycle, a longer path or more nodes is reported; with more targets than the limit it may be reported as the limit.
    """
    fan = max_nodes + 1
    turned = F.col("type").isin("header_for", "footnote_for")
    direct = edges.where("required").select("doc_id", F.when(turned, F.col("target_key")).otherwise(F.col("source_key")).alias("main"),
                                            F.when(turned, F.col("source_key")).otherwise(F.col("target_key")).alias("node")).distinct()
    smallest = Window.partitionBy("doc_id", "main").orderBy("node")
    direct = direct.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= fan).drop("place")
    step = direct.select("doc_id", F.col("main").alias("last"), F.col("node").alias("next"))
    state = direct.groupBy("doc_id", "main").agg(F.bool_or(F.col("main") == F.col("node")).alias("cycle"), F.collect_list(F.struct("node", F.array("main", "node").alias("path"))).alias("front"))
    state = state.withColumn("front", F.filter(F.sort_array("front"), lambda x: x["node"] != F.col("main"))) \
        .withColumn("seen", F.transform("front", lambda x: x["node"])).withColumn("deep", F.lit(False))
    for depth in range(2, max_depth + 2):
        grown = state.where(F.size("seen") <= max_nodes).select("doc_id", "main", F.explode("front").alias("f")).withColumn("last", F.col("f.node")).join(step, ["doc_id", "last"])
        ways = grown.groupBy("doc_id", "main", "next").agg(F.min(F.when(~F.array_contains("f.path", F.col("next")), F.concat("f.path", F.array("next")))).alias("path"), F.bool_or(F.array_contains("f.path", F.col("next"))).alias("back"))
        found = ways.groupBy("doc_id", "main").agg(F.bool_or("back").alias("back"), F.sort_array(F.collect_list(F.when(F.col("path").isNotNull(), F.struct(F.col("next").alias("node"), "path")))).alias("found"))
        fresh = F.slice(F.filter("found", lambda x: ~F.array_contains("seen", x["node"])), 1, fan)
        state = state.join(found, ["doc_id", "main"], "left").withColumn("front", F.coalesce(fresh, F.slice("front", 1, 0))).withColumn("cycle", F.col("cycle") | F.coalesce("back", F.lit(False))).drop("found", "back")
        if depth <= max_depth:
            state = state.withColumn("seen", F.concat("seen", F.transform("front", lambda x: x["node"])))
        else:
            state = state.withColumn("deep", F.size("front") > 0)
    issue = F.when(F.col("cycle"), "dependency_cycle").when(F.col("deep") | (F.size("seen") > max_nodes), "dependency_closure_limit")
    return state.select("doc_id", "main", F.slice(F.array_sort("seen"), 1, max_nodes).alias("node_keys"), issue.alias("issue"))


def graph_digest(nodes: DataFrame, edges: DataFrame, key: str = "doc_id", units: DataFrame | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """Digest of all nodes, edges, units and scopes of a version, independent of row order.

    ``units`` and ``scopes`` have ``key`` and any other columns; all of them count.
    """
    rows = nodes.select(key, row_digest(F.lit("n"), "node_key", "parent_key", "kind", "text").alias("h")).unionByName(
        edges.select(key, row_digest(F.lit("e"), "source_key", "target_key", "type").alias("h")))
    for mark, part in (("u", units), ("s", scopes)):
        if part is not None:
            rows = rows.unionByName(part.select(key, row_digest(F.lit(mark), F.to_json(F.struct(*sorted(c for c in part.columns if c != key)))).alias("h")))
    return rows.groupBy(key).agg(multiset_digest(F.col("h")).alias("digest"))


def _search_context(document_name: Column, title_path: Column, status: Column, subjects: Column, conditions: Column) -> Column:
    none = F.expr("cast(array() as array<string>)")
    known = F.when(status == "resolved", F.concat(F.transform(subjects, lambda s: s["display_name"]), conditions)).otherwise(none)
    return F.array_join(F.filter(F.concat(F.array(document_name, F.array_join(title_path, " / ")), known), lambda x: x.isNotNull() & (x != "")), "\n")


def search_text(document_name: Column, title_path: Column, status: Column, subjects: Column, conditions: Column, text: Column,
                max_chars: int = SEARCH_TEXT) -> Column:
    """Model input: document name, titles, resolved subjects and conditions, then the fact; the prefix is bounded apart."""
    prefix = F.substring(_search_context(document_name, title_path, status, subjects, conditions), 1, min(SEARCH_PREFIX, max_chars // 4))
    return F.when(F.length(prefix) > 0, F.concat(prefix, F.lit("\n"), F.substring(text, F.lit(1), F.lit(max_chars) - F.length(prefix) - 1))).otherwise(
        F.substring(text, 1, max_chars))


def search_cut(document_name: Column, title_path: Column, status: Column, subjects: Column, conditions: Column, text: Column, max_chars: int = SEARCH_TEXT) -> Column:
    """Characters of the context and the fact that ``search_text`` leaves out."""
    size, bound = F.length(_search_context(document_name, title_path, status, subjects, conditions)), min(SEARCH_PREFIX, max_chars // 4)
    room = F.lit(max_chars) - F.when(size > 0, F.least(size, F.lit(bound)) + 1).otherwise(0)
    return F.greatest(size - bound, F.lit(0)) + F.greatest(F.length(text) - room, F.lit(0))


def materialize_chunks(facts: DataFrame, max_chars: int = SEARCH_TEXT) -> DataFrame:
    """Facts to chunk rows with a name-based id from version and ordinal; ``search_cut`` counts what the bounded search text leaves out.

    ``facts(version_id, kb_id, document_id, document_name, position, source_text, title_path, scope_status, subjects, conditions)``.
    """
    order = Window.partitionBy("version_id").orderBy("position")
    rows = facts.withColumn("ordinal", F.row_number().over(order) - 1)
    parts = [F.col(c) for c in ("document_name", "title_path", "scope_status", "subjects", "conditions", "source_text")]
    return rows.withColumns({"chunk_id": uuid5(F.col("version_id"), F.col("ordinal").cast("string")), "search_text": search_text(*parts, max_chars), "search_cut": search_cut(*parts, max_chars)})


def promote_states(chunks: DataFrame, trusted_links: DataFrame, mentioned: DataFrame, general_documents: DataFrame) -> DataFrame:
    """Targets of trusted required links become confirmed general conditions; in a declared non-product
    document, facts without subject or mention become general.

    ``trusted_links(target_id, role, required)``; ``mentioned(chunk_id)``; ``general_documents(document_id)``.
    """
    targets = trusted_links.where(F.col("required") & F.col("role").isin(STRUCTURAL_ROLES)).select(F.col("target_id").alias("chunk_id")).distinct().withColumn("is_target", F.lit(True))
    named = mentioned.select("chunk_id").distinct().withColumn("is_named", F.lit(True))
    declared = general_documents.select("document_id").distinct().withColumn("is_declared", F.lit(True))
    rows = chunks.join(targets, "chunk_id", "left").join(named, "chunk_id", "left").join(declared, "document_id", "left").fillna(False, ["is_target", "is_named", "is_declared"])
    free = F.size("subjects") == 0
    by_link = F.col("is_target") & (F.col("scope_status") == "unknown") & free
    by_document = F.col("is_declared") & F.col("review_state").isin("pending", "rule_confirmed") & free & (F.col("fact_kind") != "bundle") & ~F.col("is_named")
    either = by_link | by_document
    return rows.withColumn("review_reason", F.when(by_document, "declared_non_product_document").when(by_link, "audited_required_condition").otherwise(F.col("review_reason"))) \
        .withColumn("fact_kind", F.when(either, "general").otherwise(F.col("fact_kind"))) \
        .withColumn("review_state", F.when(either, "rule_confirmed").otherwise(F.col("review_state"))).drop("is_target", "is_named", "is_declared")
