"""Context links: validation, continuation stars, section references, curated dependencies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions import text as tx
from attestor.functions.digests import row_digest
from attestor.operators import graphs
from attestor.operators.scope import scope_compatible, trusted_link
from attestor.sources.stored import cut

# The reference phrase pattern and the words that give a section a structural role.
REFERENCE = (
    r"(?i)(?:\bsee\s+(?:section\s+)?|\bsubject\s+to\s+(?:section\s+)?|参见|详见|见章节|见)"
    r"\s*[:：]?\s*(?:[\"“「《]([^\"”」》\n]{1,200})[\"”」》]|"
    r"(\d+(?:\.\d+)*(?=\s|[.;。；，,()（）]|$)|[^\n.;。；，,()（）]{1,200}))"
)
SECTION_NUMBER = r"^(?:第\s*)?(\d+(?:\.\d+)*)(?:[\s.、章]|$)"
MAX_LINKS, MAX_REFERENCES, MAX_FACTS = 20, 20, 10000


def structural_role(title: Column) -> Column:
    """Exception, attribution or condition by title words."""
    low = tx.fold(title)
    return (
        F.when(low.rlike(r"(?U)\bexceptions?\b|例外|除外"), "exception")
        .when(low.rlike(r"(?U)\b(?:applicability|scope of application)\b|适用范围"), "attribution")
        .when(low.rlike(r"(?U)\b(?:conditions?|limitations?)\b|条件|限制"), "condition")
    )


def validate_links(chunks: DataFrame) -> DataFrame:
    """Violations ``version_id, chunk_id, code`` of the link graph.

    Cycles: links into chunks without links, or out of chunks that nothing links to, are stripped until none is left (``graphs``),
    in rounds over all versions at once.
    """
    ids = chunks.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("version_id").alias("version_id"))
    repeated = ids.where("n > 1").select("version_id", "chunk_id", F.lit("duplicate_chunk_id").alias("code"))
    links = chunks.select("kb_id", "document_id", "version_id", "chunk_id", "source_unit_id", "source_text",
                          F.posexplode("context_links").alias("link_no", "link")).withColumn("target_id", F.col("link.chunk_id"))
    own = links.where("target_id = chunk_id").select("version_id", "chunk_id", F.lit("context_self_link").alias("code"))
    again = links.groupBy("version_id", "chunk_id", "target_id").agg(F.count("*").alias("n")).where("n > 1").select(
        "version_id", "chunk_id", F.lit("duplicate_context_link").alias("code"))
    s, t = links.alias("s"), chunks.select("kb_id", "document_id", "version_id", F.col("chunk_id").alias("target_id"), "source_unit_id").alias("t")
    pairs = s.join(t, F.col("s.target_id") == F.col("t.target_id"), "left")
    other = (F.col("s.kb_id") != F.col("t.kb_id")) | (F.col("s.document_id") != F.col("t.document_id")) | (F.col("s.version_id") != F.col("t.version_id"))
    proof_bad = F.col("s.link.provenance").isNotNull() & ~trusted_link(
        F.col("s.link"), F.col("s.source_unit_id"), F.col("s.source_text"), F.col("t.source_unit_id"))
    code = (F.when(F.col("t.target_id").isNull(), "context_target_missing").when(other, "context_scope_mismatch")
            .when(proof_bad, "invalid_context_provenance"))
    bad = pairs.select(F.col("s.version_id").alias("version_id"), F.col("s.chunk_id").alias("chunk_id"), code.alias("code")).where("code is not null")
    edges = links.select(_node("version_id", "chunk_id").alias("a"), _node("version_id", "target_id").alias("b"))
    cyclic = _named(graphs.between_cycles(edges), chunks).select("version_id", "chunk_id", F.lit("context_reference_cycle").alias("code"))
    return repeated.unionByName(own).unionByName(again).unionByName(bad).unionByName(cyclic).distinct()


def _node(version: str, chunk: str) -> Column:
    """A chunk of a version as one name that groups in Python can hold."""
    return F.to_json(F.struct(F.col(version).alias("v"), F.col(chunk).alias("c")))


def _named(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """``version_id, chunk_id`` of ``nodes(node, ...)`` again."""
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in ("version_id", "chunk_id")}
    parts = nodes.withColumn("_n", F.from_json("node", f"v {kinds['version_id']}, c {kinds['chunk_id']}"))
    return parts.select("*", F.col("_n.v").alias("version_id"), F.col("_n.c").alias("chunk_id")).drop("_n", "node")


def _closing(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one strong component whose target already leads back to their source, taking links in order."""
    if len(pdf) > MAX_FACTS * MAX_LINKS:
        raise ValueError(f"more than {MAX_FACTS} facts with {MAX_LINKS} links refer to each other")
    ahead: dict = {}
    found = []
    for row in pdf.sort_values(["place", "link_no"]).itertuples():
        front, seen = [row.b], {row.b}
        while front and row.a not in seen:
            front = [n for c in front for n in ahead.get(c, ()) if n not in seen and not seen.add(n)]
        if row.a in seen:
            found.append((row.version_id, row.a, row.b))
        else:
            ahead.setdefault(row.a, []).append(row.b)
    return pd.DataFrame(found, columns=["version_id", "chunk_id", "target_id"])


def bind_continuations(chunks: DataFrame) -> DataFrame:
    """Unresolved pieces of one unit link to its first piece: ``chunk_id, target_id``."""
    open_pieces = chunks.where(F.col("dependency_unresolved") & F.col("source_unit_id").isNotNull())
    heads = open_pieces.groupBy("version_id", "source_unit_id").agg(
        F.count("*").alias("n"), F.min_by("chunk_id", F.struct("ordinal", "chunk_id")).alias("target_id")).where("n >= 2")
    return open_pieces.join(heads, ["version_id", "source_unit_id"]).where("chunk_id <> target_id").select(
        "version_id", "chunk_id", "target_id", F.lit("continuation").alias("role"))


def references(chunks: DataFrame) -> DataFrame:
    """Section references of each text in order: ``version_id, chunk_id, reference_no, reference_text, label``."""
    found = F.regexp_extract_all("source_text", F.lit(REFERENCE), F.lit(0))
    rows = chunks.select("version_id", "chunk_id", F.size(found).alias("total"), F.posexplode(found).alias("reference_no", "reference_text"))
    label = F.coalesce(F.nullif(F.regexp_extract("reference_text", REFERENCE, 1), F.lit("")), F.regexp_extract("reference_text", REFERENCE, 2))
    return rows.withColumn("label", tx.fold(tx.strip(label)))


def bind_references(chunks: DataFrame, section_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C11: ``(links, issues)`` from explicit section references.

    A label names a section by its folded title or its number, inside the version. It must name exactly one
    section with a structural role; every chunk of that section becomes a required target, in chunk order, up to
    20 per source. ``section_of(version_id, chunk_id, section_id, title_path, ordinal)``.
    """
    title = tx.fold(tx.strip(F.element_at("title_path", -1)))
    places = section_of.where(F.size("title_path") > 0).withColumn("title", title)
    number = F.regexp_extract("title", SECTION_NUMBER, 1)
    labels = places.select("version_id", "section_id", F.explode(F.array_distinct(F.filter(
        F.array("title", number), lambda x: x != ""))).alias("label"), F.element_at("title_path", -1).alias("section_title"), "ordinal")
    named = labels.groupBy("version_id", "label").agg(
        F.count_distinct("section_id").alias("n"), F.min_by("section_id", "ordinal").alias("section_id"),
        F.min_by("section_title", "ordinal").alias("section_title"))
    refs = references(chunks)
    over = refs.where((F.col("total") > MAX_REFERENCES) | (F.length("reference_text") > 500)).select(
        "version_id", "chunk_id", F.lit("dependency_limit_exceeded").alias("code"))
    usable = refs.where((F.col("reference_no") < MAX_REFERENCES) & (F.length("reference_text") <= 500))
    joined = usable.join(named, ["version_id", "label"], "left")
    joined = joined.withColumn("role", structural_role(F.coalesce("section_title", "label"))).where("role is not null")
    issues = joined.select("version_id", "chunk_id", F.when(F.col("n").isNull(), "unmatched_reference").when(
        F.col("n") > 1, "ambiguous_reference").alias("code")).where("code is not null")
    members = section_of.select("version_id", "section_id", F.col("chunk_id").alias("target_id"), "ordinal")
    targets = joined.where("n = 1").join(members, ["version_id", "section_id"]).where("target_id <> chunk_id")
    first = targets.groupBy("version_id", "chunk_id", "target_id").agg(F.min(F.struct("reference_no", "ordinal", "role", "reference_text")).alias("m"))
    order = Window.partitionBy("chunk_id").orderBy("m.reference_no", "m.ordinal", "target_id")
    numbered = first.withColumn("link_no", F.row_number().over(order))
    limit = numbered.where(F.col("link_no") > MAX_LINKS).select("version_id", "chunk_id", F.lit("dependency_limit_exceeded").alias("code"))
    links = numbered.where(F.col("link_no") <= MAX_LINKS).select("version_id", "chunk_id", "target_id", "link_no", "m.role", "m.reference_text")
    # A reference that closes a loop of any length is an issue, not a link; links are taken in chunk order. Only links inside a strong component can.
    places = section_of.groupBy("version_id", "chunk_id").agg(F.min("ordinal").alias("place"))
    strong = graphs.strong_components(links.select(_node("version_id", "chunk_id").alias("a"), _node("version_id", "target_id").alias("b")))
    strong = cut(_named(strong, chunks).select("version_id", F.col("chunk_id").alias("id"), "strong"))
    inside = links.select("version_id", F.col("chunk_id").alias("a"), F.col("target_id").alias("b"), "link_no") \
        .join(strong.withColumnRenamed("id", "a"), ["version_id", "a"]).join(strong.withColumnRenamed("id", "b"), ["version_id", "b", "strong"])
    types = links.schema
    loops = inside.join(places.withColumnRenamed("chunk_id", "a"), ["version_id", "a"]).select("version_id", "a", "b", "link_no", "place", "strong").groupBy("strong").applyInPandas(
        _closing, T.StructType([types[c] for c in ("version_id", "chunk_id", "target_id")]))
    cycle = loops.select("version_id", "chunk_id", F.lit("dependency_cycle").alias("code"))
    links = links.join(loops, ["version_id", "chunk_id", "target_id"], "left_anti")
    return links, over.unionByName(issues).unionByName(limit).unionByName(cycle).distinct()


def unsafe_links(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """C7 over bound links: targets that may not be read with their source (``unsafe_dependency``)."""
    s, t = chunks.alias("s"), chunks.alias("t")
    role = F.col("l.role")
    ok = scope_compatible("s", "t", F.lit(True), role, F.lit(True))
    return (
        links.alias("l").join(s, F.col("l.chunk_id") == F.col("s.chunk_id")).join(t, F.col("l.target_id") == F.col("t.chunk_id"))
        .where(~F.coalesce(ok, F.lit(False)))
        .select(F.col("l.version_id").alias("version_id"), F.col("l.chunk_id").alias("chunk_id"), F.lit("unsafe_dependency").alias("code"))
    )


def bind_curated(chunks: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(links, errors)`` from reviewed source and target selectors.

    ``bindings(binding_id, document_id, source_path, source_unit, target_path, target_unit, role, reference_text)``.
    A selector must match exactly one section; a quoted text must occur in a selected source.
    """
    def selected(side: str) -> DataFrame:
        path, unit = f"{side}_path", f"{side}_unit"
        return chunks.join(bindings.select("binding_id", "document_id", path, unit, "role", "reference_text"), "document_id").where(
            (F.col(unit).isNull() | F.coalesce(F.col("source_unit_id") == F.col(unit), F.lit(False)))
            & (F.col(path).isNull() | (F.col("title_path") == F.col(path)))
            & (F.col(unit).isNotNull() | F.col(path).isNotNull()))

    sources, targets = selected("source"), selected("target")
    counts = []
    for rows in (sources, targets):
        n = rows.groupBy("binding_id").agg(F.count_distinct("section_id").alias("n"))
        counts.append(bindings.select("binding_id").join(n, "binding_id", "left").where(F.coalesce("n", F.lit(0)) != 1).select(
            "binding_id", F.when(F.col("n").isNull(), "dependency_selector_not_found").otherwise("ambiguous_dependency_selector").alias("code")))
    quoted = sources.where(F.col("reference_text").isNull() | F.contains("source_text", F.col("reference_text")))
    missing = sources.select("binding_id").distinct().join(quoted.select("binding_id"), "binding_id", "left_anti").withColumn(
        "code", F.lit("dependency_reference_not_in_source"))
    links = quoted.select("binding_id", "version_id", "chunk_id", "role", "reference_text").join(
        targets.select("binding_id", F.col("chunk_id").alias("target_id")), "binding_id")
    own = links.where("chunk_id = target_id").select("binding_id", F.lit("context_self_link").alias("code"))
    errors = counts[0].unionByName(counts[1]).unionByName(missing).unionByName(own).distinct()
    return links.join(errors.select("binding_id"), "binding_id", "left_anti"), errors


def processing_profile(inputs: DataFrame, prefix: str = "evidence-v2") -> DataFrame:
    """C14: name frozen inputs by the hash of their canonical form: ``document_id, processing_profile``."""
    others = [c for c in sorted(inputs.columns) if c != "document_id"]
    return inputs.select("document_id", F.concat(F.lit(prefix + ":"), row_digest(*[F.to_json(F.struct(c)) for c in others])).alias("processing_profile"))


def unmatched_bindings(bindings: DataFrame, block_rows: DataFrame) -> DataFrame:
    """C17: scope bindings that match no block of their document (``binding_id, document_id``)."""
    b, c = bindings.alias("b"), block_rows.alias("c")
    hit = (
        (F.col("b.document_id") == F.col("c.document_id"))
        & (F.col("b.title_path").isNull() | ((F.size("b.title_path") > 0) & (
            F.slice("c.title_path", F.lit(1), F.greatest(F.lit(1), F.size("b.title_path"))) == F.col("b.title_path"))))
        & (F.col("b.source_unit_id").isNull() | (F.col("b.source_unit_id") == F.col("c.source_unit_id"))
           | F.array_contains("c.unit_aliases", F.col("b.source_unit_id")))
    )
    return b.join(c, hit, "left_anti")


def relocate_selectors(bindings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Move unit selectors to the unit of the new version; more than one destination means reprocess."""
    moves = chunks.where("origin_source_unit_id is not null").groupBy("version_id", "origin_source_unit_id").agg(
        F.count_distinct("source_unit_id").alias("destinations"), F.min("source_unit_id").alias("unit"))
    joined = bindings.join(moves, (bindings["version_id"] == moves["version_id"]) & (
        bindings["source_unit_id"] == moves["origin_source_unit_id"]), "left").select(
        *[bindings[c] for c in bindings.columns if c != "source_unit_id"],
        F.when(F.col("destinations") == 1, F.col("unit")).otherwise(bindings["source_unit_id"]).alias("source_unit_id"),
        (F.coalesce("destinations", F.lit(0)) > 1).alias("requires_reprocess"))
    return joined
