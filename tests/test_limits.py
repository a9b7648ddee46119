"""Cases at and beyond limits: loops, deep headings, many links, contained labels, late events, changed conditions."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestor.operators import decision, evaluation, fusion, links, review, selection, structure, tree
from attestor.streaming import jobs

AT = datetime.datetime(2024, 1, 1)


def referring(spark, pairs):
    """Chunks named by number that refer to others by section number."""
    rows = [(i, "v", i, [f"{i} Conditions"], f"s{i}", " ".join(f"See section {j}." for a, j in pairs if a == i)) for i in sorted({x for p in pairs for x in p})]
    return spark.createDataFrame(rows, "chunk_id int, version_id string, ordinal int, title_path array<string>, section_id string, source_text string")


@pytest.mark.parametrize("pairs,kept", [
    ([(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 3)]), ([(1, 2), (2, 1)], [(1, 2)]), ([(3, 1), (1, 2), (2, 3), (2, 1)], [(1, 2), (2, 3)]), ([(2, 1), (3, 2), (4, 1)], [(2, 1), (3, 2), (4, 1)])])
def test_references_never_close_a_loop(spark, pairs, kept):
    chunks = referring(spark, pairs)
    bound, issues = links.bind_references(chunks, chunks)
    assert sorted((r.chunk_id, r.target_id) for r in bound.collect()) == kept
    assert {r.code for r in issues.collect()} == ({"dependency_cycle"} if len(kept) < len(pairs) else set())


def test_a_label_inside_a_word_is_found(spark):
    rows = [(1, "v", 0, ["Intro"], 'See "safety cond".', True, "unknown", "pending"), (2, "v", 1, ["Unsafety condensed notes"], "x", False, "unknown", "pending"),
            (3, "w", 2, ["Unsafety condensed notes"], "x", False, "unknown", "pending")]
    facts = spark.createDataFrame(rows, "chunk_id int, version_id string, ordinal int, title_path array<string>, source_text string, dependency_unresolved boolean, scope_status string, review_state string")
    assert [tuple(r) for r in review.dependency_candidates(facts).collect()] == [(1, 2)]


def test_labels_meet_titles_on_their_rarest_run(spark):
    titles, labels = ["Safety conditions", "a", "ab", "abc", "Ünsafety", "aaa", "x" * 300 + "needle" + "y" * 300], ["a", "ab", "safety", "Safety", "needle", "aaaa", "ü", "conditions", "zzz", "b"]
    held = review.labels_in_titles(spark.createDataFrame([(v, x) for v in "vw" for x in labels], "version_id string, label string"),
                                   spark.createDataFrame([("v", t) for t in titles], "version_id string, title string"))
    assert {tuple(r) for r in held.collect()} == {("v", x, t) for x in labels for t in titles if x in t}


def test_search_text_says_what_it_leaves_out(spark):
    rows = [("v", "k", 1, "n" * 300, 0, "t" * 90, ["T"], "unknown", [], []), ("v", "k", 1, "", 1, "short", [], "unknown", [], [])]
    facts = spark.createDataFrame(rows, "version_id string, kb_id string, document_id int, document_name string, position int, source_text string, title_path array<string>, scope_status string, subjects array<struct<display_name:string>>, conditions array<string>")
    got = tree.materialize_chunks(facts.withColumn("version_id", F.lit("00000000-0000-5000-8000-000000000001")), 100).orderBy("ordinal").collect()
    assert [(len(r.search_text), r.search_cut) for r in got] == [(100, 302 - 25 + 90 - 74), (5, 0)]


def test_levels_beyond_the_limit_are_reported(spark):
    text = "\n\n".join("#" * min(i, 6) + f" H{i}" for i in range(1, 7))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    marked = structure.mark_lines(structure.lines(rows))
    assert [r.line_no for r in structure.deep_headings(marked, 4).orderBy("line_no").collect()] == sorted(r.line_no for r in structure.headings(marked).where("depth > 4").collect())
    assert structure.deep_headings(marked).count() == 0


def test_success_is_final_in_the_batch_as_in_the_stream(spark):
    rows = [("j", 1, AT, "claimed"), ("j", 2, AT, "succeeded"), ("j", 3, AT, "claimed"), ("j", 4, AT, "error")]
    got = jobs.job_state(spark.createDataFrame(rows, "job_id string, seq long, ts timestamp, kind string")).first()
    assert (got.status, got.attempts, got.seq) == ("succeeded", 1, 2)


def test_changed_conditions_drop_a_found_relation(spark):
    make = lambda c: spark.createDataFrame([("r1", "a", "b", "t", {"m": "1"}), ("r2", "a", "b", "t", c)], "relation_id string, subject_id string, object_id string, relation_type string, conditions map<string,string>")
    evidence = spark.createDataFrame([("r1", 1, "supports"), ("r2", 1, "supports")], "relation_id string, chunk_id int, stance string")
    found = make({"m": "1"}).join(evidence, "relation_id").withColumn("request_id", F.lit("q"))
    kept = fusion.revalidate_relations(found, make({"m": "2"}), evidence, spark.createDataFrame([(1,)], "chunk_id int"))
    assert [r.relation_id for r in kept.collect()] == ["r1"]


def test_units_and_scopes_change_the_digest(spark):
    nodes = spark.createDataFrame([(1, "n", None, "text", "x")], "doc_id int, node_key string, parent_key string, kind string, text string")
    edges = spark.createDataFrame([], "doc_id int, source_key string, target_key string, type string")
    units = lambda x: spark.createDataFrame([(1, "u", x)], "doc_id int, unit string, value string")
    digests = {tree.graph_digest(nodes, edges, units=u, scopes=s).first().digest for u in (None, units("kg"), units("g")) for s in (None, units("kg"))}
    assert len(digests) == 6


def test_too_many_candidates_fail_the_request():
    with pytest.raises(ValueError):
        selection._select_request(pd.DataFrame({"request_id": [1] * (selection.MAX_CANDIDATES + 1)}))


def test_cover_takes_new_facets_first_then_rank(spark):
    support = spark.createDataFrame([("q", i, f"f{i}", "direct", "direct") for i in (1, 2, 3)], "request_id string, facet_no int, facet_id string, support string, basis string")
    rows = [("q", "f1", 10, 1, "direct"), ("q", "f2", 20, 2, "direct"), ("q", "f3", 20, 2, "direct"), ("q", "f1", 30, 3, "direct"), ("q", "f2", 40, 4, "partial")]
    matches = spark.createDataFrame(rows, "request_id string, facet_id string, chunk_id int, hit_rank int, way string")
    got = decision.select_cover(support, matches).orderBy("group_no").collect()
    assert [(r.chunk_id, r.group_no, r.facet_ids) for r in got] == [(20, 1, ["f2", "f3"]), (10, 2, ["f1"])]


def closure_of(spark, pairs):
    edges = spark.createDataFrame([(1, a, b, "governed_by", True) for a, b in pairs], "doc_id int, source_key string, target_key string, type string, required boolean")
    return {r.main: (list(r.node_keys), r.issue) for r in tree.required_closure(edges).collect()}


def test_a_hub_keeps_as_many_targets_as_the_limit_needs(spark):
    hub = [("hub", f"n{i:05}") for i in range(20_000)] + [("before", "hub"), ("first", "before")]
    got = closure_of(spark, hub)
    assert got["hub"] == ([f"n{i:05}" for i in range(16)], "dependency_closure_limit")
    assert got["before"][1] == got["first"][1] == "dependency_closure_limit" and all(len(nodes) == 16 for nodes, _ in got.values())


def test_closures_of_small_graphs(spark):
    got = closure_of(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "x"), ("y", "z"), ("z", "y")])
    assert got["a"] == (["b", "c", "d", "e"], "dependency_closure_limit")  # f is four steps away
    assert got["b"] == (["d", "e", "f"], None) and got["e"] == (["f"], None)
    assert got["x"] == ([], "dependency_cycle") and got["y"] == (["z"], "dependency_cycle")


def test_running_totals_in_parts(spark):
    rows = [(k, i % 50, i) for k in "ab" for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, score int, id int").groupBy("k", "score").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    got = {(r.k, r.score): (r.n, r.s) for r in evaluation.running_totals(frame, ["k"], F.col("score").desc(), ["n", "s"]).collect()}
    assert got == {(k, v): (sum(s >= v for _, s, _ in rows) // 2, sum(i for kk, s, i in rows if kk == k and s >= v)) for k in "ab" for v in range(50)}


def test_nesting_of_a_long_list_is_found_in_one_pass(spark):
    indents = [(i * 7919) % 13 for i in range(30_000)]
    rows = spark.createDataFrame([(1, "\n".join(" " * n + f"- point {i}" for i, n in enumerate(indents)))], "doc_id int, text string")
    got = {r.item_no: r.parent_no for r in tree.list_items(rows, ["doc_id"]).collect()}
    last, want = {}, {}
    for i, n in enumerate(indents):
        want[i] = max((last[m] for m in last if m < n), default=None)
        last[n] = i
    assert got == want
