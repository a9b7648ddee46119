"""Applicability: which subject a fact belongs to, and when two facts may be read together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as tx

SUBJECT_DDL = "struct<entity_id:string,display_name:string,product_model:string,software_version:string,source_kind:string>"
STRUCTURAL_ROLES = ["attribution", "table_header", "condition", "exception"]


def scope_matches(status: Column, subjects: Column, model: Column, version: Column, entity_ids: Column) -> Column:
    """All requested values must hold on one resolved subject; null means not requested."""
    nothing = model.isNull() & version.isNull() & (entity_ids.isNull() | (F.size(entity_ids) == 0))
    one = F.exists(
        subjects,
        lambda s: (model.isNull() | s["product_model"].eqNullSafe(model))
        & (version.isNull() | s["software_version"].eqNullSafe(version))
        & (entity_ids.isNull() | (F.size(entity_ids) == 0) | F.coalesce(F.array_contains(entity_ids, s["entity_id"]), F.lit(False))),
    )
    return nothing | ((status == "resolved") & F.coalesce(one, F.lit(False)))


def subject_keys(subjects: Column) -> Column:
    """Comparable identities: entity id, or the folded name where there is none, with model and version."""
    return F.array_sort(F.array_distinct(F.transform(subjects, lambda s: F.concat_ws(
        "\u0001", F.coalesce(s["entity_id"], tx.fold(s["display_name"])),
        F.coalesce(s["product_model"], F.lit("\u0002")), F.coalesce(s["software_version"], F.lit("\u0002"))))))


def trusted_link(link: Column, source_unit: Column, source_text: Column, target_unit: Column) -> Column:
    """The proof names both units, and any quoted text occurs in the source."""
    proof = link["provenance"]
    quote = proof["reference_text"]
    units = (
        proof.isNotNull() & source_unit.isNotNull() & target_unit.isNotNull()
        & (proof["source_unit_id"] == source_unit) & (proof["target_unit_id"] == target_unit)
    )
    quoted = F.contains(source_text, quote)
    kind = (
        F.when(proof["kind"] == "curated", quote.isNull() | quoted)
        .when(proof["kind"] == "parser_reference",
              quote.isNotNull() & (F.length(quote) > 0) & quoted & link["role"].isin(STRUCTURAL_ROLES))
        .otherwise((link["role"] == "continuation") & (proof["source_unit_id"] == proof["target_unit_id"]))
    )
    return F.coalesce(units & kind, F.lit(False))


def scope_compatible(hit: str, other: str, required: Column, role: Column, linked_trusted: Column) -> Column:
    """C7 predicate between two aliased chunk rows of the same version.

    Equal subject sets (a subset is enough for structural roles) and equal conditions (or one side empty
    for those roles). Unresolved scope passes only through a trusted required link.
    """
    a, b = (lambda c: F.col(f"{hit}.{c}")), (lambda c: F.col(f"{other}.{c}"))
    same_version = (a("kb_id") == b("kb_id")) & (a("document_id") == b("document_id")) & (a("version_id") == b("version_id"))
    both = (a("scope_status") == "resolved") & (b("scope_status") == "resolved")
    left, right = subject_keys(a("subjects")), subject_keys(b("subjects"))
    ca, cb = F.array_sort(F.array_distinct(a("conditions"))), F.array_sort(F.array_distinct(b("conditions")))
    shared = required & F.coalesce(role.isin(STRUCTURAL_ROLES), F.lit(False))
    subjects_ok = (left == right) | (shared & (F.size(F.array_except(left, right)) == 0))
    conditions_ok = (ca == cb) | (shared & ((F.size(ca) == 0) | (F.size(cb) == 0)))
    bad_unknown = (
        (a("scope_status") == "ambiguous") | (b("scope_status") == "ambiguous")
        | ((a("scope_status") == "unknown") & (F.size(a("subjects")) > 0))
        | ((b("scope_status") == "unknown") & (F.size(b("subjects")) > 0))
    )
    clash = (F.size(ca) > 0) & (F.size(cb) > 0) & (ca != cb)
    unresolved_ok = required & ~bad_unknown & ~clash & linked_trusted
    return same_version & ((a("chunk_id") == b("chunk_id")) | F.when(both, subjects_ok & conditions_ok).otherwise(unresolved_ok))


def scope_compatible_join(hits: DataFrame, candidates: DataFrame, required: bool = False, role: str | None = None) -> DataFrame:
    """Pairs of hit and candidate that may be read together; equi-join on the version, then the predicate."""
    h, c = hits.alias("h"), candidates.alias("c")
    keys = [F.col(f"h.{k}") == F.col(f"c.{k}") for k in ("kb_id", "document_id", "version_id")]
    ok = scope_compatible("h", "c", F.lit(required), F.lit(role).cast("string"), F.lit(False))
    return h.join(c, keys).where(ok).select(F.col("h.chunk_id").alias("hit_id"), F.col("c.chunk_id").alias("candidate_id"))


def resolve_scope(chunks: DataFrame, bindings: DataFrame, heading_mentions: DataFrame, defaults: DataFrame) -> DataFrame:
    """C4: applicability of every chunk from frozen declarations.

    ``chunks(chunk_id, document_id, title_path, source_unit_id, unit_aliases, has_row_label)``;
    ``bindings(document_id, title_path, source_unit_id, subjects, conditions)`` with null selectors meaning "any";
    ``heading_mentions(chunk_id, label_no, entity_id, display_name, product_model, software_version)`` for every
    catalog entity found in a heading or row label (the nearest label that names any entity counts);
    ``defaults(document_id, subjects, conditions)``.

    Entity sets must agree between declarations; a missing model or version is incomplete, not different.
    """
    subjects_type = f"array<{SUBJECT_DDL}>"
    empty_conditions = F.expr("cast(array() as array<string>)")
    by_path = (
        chunks.alias("c").join(bindings.alias("b"), "document_id")
        .where((F.col("b.title_path").isNotNull() | F.col("b.source_unit_id").isNotNull())
               & (F.col("b.title_path").isNull()
                  | ((F.size("b.title_path") > 0)
                     & (F.slice("c.title_path", F.lit(1), F.greatest(F.lit(1), F.size("b.title_path"))) == F.col("b.title_path"))))
               & (F.col("b.source_unit_id").isNull() | F.array_contains(
                   F.array_union(F.array(F.col("c.source_unit_id")), F.coalesce("c.unit_aliases", empty_conditions)),
                   F.col("b.source_unit_id"))))
        .select("c.chunk_id", F.lit(1).alias("priority"), F.col("b.subjects").cast(subjects_type).alias("subjects"),
                F.coalesce("b.conditions", empty_conditions).alias("conditions"), F.lit(False).alias("split"))
    )
    nearest = heading_mentions.groupBy("chunk_id", "label_no").agg(
        F.array_sort(F.collect_set(F.struct("entity_id", "display_name", "product_model", "software_version",
                                            F.lit("reviewed_alias").alias("source_kind")))).alias("subjects"))
    last = nearest.groupBy("chunk_id").agg(F.max_by("subjects", "label_no").alias("subjects"))
    by_heading = last.select(
        "chunk_id", F.lit(2).alias("priority"), F.slice("subjects", 1, 8).cast(subjects_type).alias("subjects"),
        empty_conditions.alias("conditions"), (F.size("subjects") > 1).alias("split"))
    by_default = chunks.join(defaults, "document_id").select(
        "chunk_id", F.lit(3).alias("priority"), F.col("subjects").cast(subjects_type).alias("subjects"),
        F.coalesce("conditions", empty_conditions).alias("conditions"), F.lit(False).alias("split"))
    declarations = by_path.unionByName(by_heading).unionByName(by_default)

    entity = lambda s: F.coalesce(s["entity_id"], tx.fold(s["display_name"]))
    gathered = declarations.groupBy("chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("priority", "subjects", "conditions"))).alias("declared"),
        F.bool_or("split").alias("split"))
    keys = F.array_distinct(F.transform("declared", lambda d: F.array_sort(F.array_distinct(F.transform(d["subjects"], entity)))))
    every = F.flatten(F.transform("declared", lambda d: d["subjects"]))
    conditions = F.array_distinct(F.flatten(F.transform("declared", lambda d: d["conditions"])))
    agrees = lambda x, y: (
        (x["product_model"].isNull() | y["product_model"].isNull() | (x["product_model"] == y["product_model"]))
        & (x["software_version"].isNull() | y["software_version"].isNull() | (x["software_version"] == y["software_version"])))
    # a variant conflicts when another declaration has variants of its entity, none of which agrees
    conflict = F.exists("declared", lambda d: F.exists(d["subjects"], lambda s: F.exists("declared", lambda o: (
        F.exists(o["subjects"], lambda t: entity(t) == entity(s))
        & ~F.exists(o["subjects"], lambda t: (entity(t) == entity(s)) & agrees(s, t))))))
    fill = lambda s, name: F.coalesce(s[name], F.get(F.filter(F.transform(F.filter(
        every, lambda t: (entity(t) == entity(s)) & agrees(s, t)), lambda t: t[name]), lambda v: v.isNotNull()), F.lit(0)))
    merged = F.transform(every, lambda s: F.struct(
        entity(s).alias("key"), s["entity_id"].alias("entity_id"), s["display_name"].alias("display_name"),
        F.when(F.col("conflict"), s["product_model"]).otherwise(fill(s, "product_model")).alias("product_model"),
        F.when(F.col("conflict"), s["software_version"]).otherwise(fill(s, "software_version")).alias("software_version"),
        s["source_kind"].alias("source_kind")))
    # one subject per identity; the curated declaration sorts first and wins
    single = F.filter("merged", lambda s, i: ~F.exists(F.slice("merged", F.lit(1), i), lambda t: (
        (t["key"] == s["key"]) & t["product_model"].eqNullSafe(s["product_model"])
        & t["software_version"].eqNullSafe(s["software_version"]))))
    resolved = (
        gathered.withColumn("conflict", conflict).withColumn("keys", keys).withColumn("every", every)
        .withColumn("conditions", conditions).withColumn("merged", merged).withColumn("single", single)
        .withColumn("ambiguous", F.col("conflict") | (F.size("keys") > 1) | F.col("split")
                    | (F.size("single") > 8) | (F.size("conditions") > 20))
    )
    known = resolved.select(
        "chunk_id", F.when(F.col("ambiguous"), "ambiguous").otherwise("resolved").alias("scope_status"),
        F.transform(F.slice("single", 1, 8), lambda s: F.struct(
            s["entity_id"].alias("entity_id"), s["display_name"].alias("display_name"), s["product_model"].alias("product_model"),
            s["software_version"].alias("software_version"), s["source_kind"].alias("source_kind"))).alias("subjects"),
        F.slice("conditions", 1, 20).alias("conditions"),
        F.when(F.col("ambiguous"), F.array(F.lit("scope_conflict"))).otherwise(empty_conditions).alias("reason_codes"))
    has_inputs = bindings.select("document_id").unionByName(defaults.select("document_id")).distinct().withColumn("declared_inputs", F.lit(True))
    catalog_used = F.lit(True) if heading_mentions is not None else F.lit(False)
    missing = (
        chunks.join(known.select("chunk_id"), "chunk_id", "left_anti").join(has_inputs, "document_id", "left")
        .select("chunk_id", F.lit("unknown").alias("scope_status"), F.expr(f"cast(array() as {subjects_type})").alias("subjects"),
                empty_conditions.alias("conditions"),
                F.concat(
                    F.array(F.when(F.col("declared_inputs") | catalog_used, "no_reviewed_match").otherwise("missing_binding")),
                    F.when((F.size("title_path") == 0) & ~F.col("has_row_label"), F.array(F.lit("structure_missing"))).otherwise(empty_conditions),
                ).alias("reason_codes"))
    )
    return known.unionByName(missing)
