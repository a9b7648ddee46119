from pyspark.sql import functions as F

from attestor.operators import entities, links, review, scope

SUBJECT = scope.SUBJECT_DDL


def test_names_need_word_boundaries_and_the_longest_wins(spark):
    chunks = spark.createDataFrame([(1, "A1 Pro and A1, not A100 or xA1. 产品甲型好 a1"), (2, "A-100 input")], "chunk_id int, source_text string")
    forms = spark.createDataFrame([("a1", "A1"), ("pro", "A1 Pro"), ("cn", "产品甲"), ("m", "A-100")], "entity_id string, surface string")
    found = entities.mentions(chunks, forms)
    assert sorted((r["chunk_id"], r["entity_id"], r["start"]) for r in found.collect()) == [(1, "a1", 0), (1, "a1", 11), (1, "a1", 38), (1, "cn", 32), (1, "pro", 0), (2, "m", 0)]
    kept = entities.resolve_overlaps(found.where("chunk_id = 1"))
    assert sorted((r["entity_id"], r["start"]) for r in kept.collect()) == [("a1", 11), ("a1", 38), ("cn", 32), ("pro", 0)]


def test_mentions_match_brute_force(spark):
    import random
    import re

    rng = random.Random(3)
    words = ["ab", "cd", "ab-cd", "ef", "a", "b1"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", ","]) for _ in range(12)) for _ in range(30)]
    names = ["ab", "ab cd", "ab-cd", "ef a", "b1"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, source_text string")
    forms = spark.createDataFrame([(n, n) for n in names], "entity_id string, surface string")
    want = {(i, n, m.start()) for i, t in enumerate(texts) for n in names for m in re.finditer(r"(?<![\w-])" + re.escape(n) + r"(?![\w-])", t, re.I)}
    assert {(r["chunk_id"], r["entity_id"], r["start"]) for r in entities.mentions(chunks, forms).collect()} == want


def resolve(spark, bindings, mentions, defaults):
    chunks = spark.createDataFrame([(1, "d", ["A"], "u", None, False)], "chunk_id int, document_id string, title_path array<string>, source_unit_id string, unit_aliases array<string>, has_row_label boolean")
    b = spark.createDataFrame(bindings, f"document_id string, title_path array<string>, source_unit_id string, subjects array<{SUBJECT}>, conditions array<string>")
    m = spark.createDataFrame(mentions, "chunk_id int, label_no int, entity_id string, display_name string, product_model string, software_version string")
    d = spark.createDataFrame(defaults, f"document_id string, subjects array<{SUBJECT}>, conditions array<string>")
    return scope.resolve_scope(chunks, b, m, d).first()


def subject(entity, model=None, version=None):
    return (entity, entity, model, version, "curated")


def test_missing_model_merges_but_different_model_conflicts(spark):
    merged = resolve(spark, [("d", ["A"], None, [subject("e")], ["c"])], [(1, 1, "e", "e", "M", None)], [])
    assert merged["scope_status"] == "resolved" and [s["product_model"] for s in merged["subjects"]] == ["M"] and merged["conditions"] == ["c"]
    clash = resolve(spark, [("d", ["A"], None, [subject("e", "M")], [])], [(1, 1, "e", "e", "N", None)], [])
    assert clash["scope_status"] == "ambiguous" and clash["reason_codes"] == ["scope_conflict"]
    other = resolve(spark, [("d", ["A"], None, [subject("e")], [])], [], [("d", [subject("f")], [])])
    assert other["scope_status"] == "ambiguous"


def test_only_the_nearest_named_heading_counts(spark):
    near = resolve(spark, [], [(1, 1, "e", "e", None, None), (1, 2, "f", "f", None, None)], [])
    assert near["scope_status"] == "resolved" and near["subjects"][0]["entity_id"] == "f"


def test_numbered_reference_binds_the_exact_section(spark):
    rows = [(1, "v", 0, ["Product A"], "s1", "Fact. See section 1.2."), (2, "v", 1, ["1 Conditions"], "s2", "Parent"), (3, "v", 2, ["1 Conditions", "1.2 Exceptions"], "s3", "Actual"),
            (4, "v", 3, ["Air conditioning"], "s4", 'See section "Air conditioning". See section "Missing conditions".')]
    chunks = spark.createDataFrame(rows, "chunk_id int, version_id string, ordinal int, title_path array<string>, section_id string, source_text string")
    bound, issues = links.bind_references(chunks, chunks)
    assert [(r["chunk_id"], r["target_id"], r["role"]) for r in bound.collect()] == [(1, 3, "exception")]
    assert [(r["chunk_id"], r["code"]) for r in issues.collect()] == [(4, "unmatched_reference")]


def test_split_suggestions_follow_the_end_of_text_rule(spark):
    rows = spark.createDataFrame([("a; b; c",), ("only one",), ("x\ny; z",), ("p;\nq\n",)], "t string")
    got = [list(r["s"]) for r in rows.select(review.split_suggestions(F.col("t")).alias("s")).collect()]
    import re

    want = []
    for t in ("a; b; c", "only one", "x\ny; z", "p;\nq\n"):
        pieces = [m[0] for m in re.finditer(r"[^;；\n]+(?:[;；]|$)", t)]
        want.append(pieces if 1 < len(pieces) <= 50 else [])
    assert got == want


def fact(i, **kw):
    base = dict(plan_id="p", fact_id=i, source_text="A1 is red; B2 is blue", fact_kind="statement", review_state="pending", review_reason=None, scope_status="unknown", subject_ids=[],
                original_subject_ids=[], original_explicit=False, mentioned=[], overlapping=False, separate=False, compares=False, has_property=False, dependency_unresolved=False,
                dependency_issues=[], reference_count=0, link_ids=[], parent_id=None)
    return {**base, **kw}


FACT_DDL = ("plan_id string, fact_id string, source_text string, fact_kind string, review_state string, review_reason string, scope_status string, subject_ids array<string>, "
            "original_subject_ids array<string>, original_explicit boolean, mentioned array<string>, overlapping boolean, separate boolean, compares boolean, has_property boolean, "
            "dependency_unresolved boolean, dependency_issues array<string>, reference_count int, link_ids array<string>, parent_id string")
DECISION_DDL = "plan_id string, revision long, fact_id string, action string, entity_ids array<string>, target_fact_id string, role string, starts array<int>, ends array<int>"


def test_replay_split_reset_and_atomic_batches(spark):
    facts = spark.createDataFrame([fact("a"), fact("b", mentioned=["e1", "e2"])], FACT_DDL)
    steps = [("p", 1, "a", "split", [], None, None, [0, 10], [10, 21]), ("p", 2, "a", "general", [], None, None, [], []), ("p", 3, "a/0", "assign", ["e1"], None, None, [], []),
             ("p", 4, "a", "defer", [], None, None, [], []), ("p", 4, "b", "assign", ["e1"], None, None, [], []), ("p", 5, "b", "shared", ["e1", "e2"], None, None, [], [])]
    kinds = spark.createDataFrame([("e1", "product"), ("e2", "model")], "entity_id string, kind string")
    state, rejects = review.apply_decisions(facts, spark.createDataFrame(steps, DECISION_DDL), kinds)
    got = {r["fact_id"]: (r["review_state"], list(r["subject_ids"])) for r in state.collect()}
    assert got == {"a": ("excluded", []), "a/0": ("human_confirmed", ["e1"]), "a/1": ("pending", []), "b": ("human_confirmed", ["e1", "e2"])}
    assert {(r["revision"], r["code"]) for r in rejects.collect()} == {(2, "split_parent_requires_reset"), (4, "split_parent_requires_reset")}
    again, _ = review.apply_decisions(facts, spark.createDataFrame(steps[:1] + [("p", 2, "a", "reset", [], None, None, [], [])], DECISION_DDL), kinds)
    assert {r["fact_id"]: r["review_state"] for r in again.collect()} == {"a": "pending", "a/0": "excluded", "a/1": "excluded", "b": "pending"}


def test_plans_that_share_a_call_are_replayed_apart(spark, monkeypatch):
    plans = [f"p{i}" for i in range(40)] + [None]
    facts = spark.createDataFrame([fact("a", plan_id=p) for p in plans], FACT_DDL)
    steps = [(p, 1, "a", "exclude" if p in ("p3", None) else "defer", [], None, None, [], []) for p in plans]
    steps += [("p5", 2, "b", "defer", [], None, None, [], []), ("absent", 1, "a", "defer", [], None, None, [], [])]
    kinds = spark.createDataFrame([], "entity_id string, kind string")
    calls, replay = spark.sparkContext.accumulator(0), review._replay_slot
    monkeypatch.setattr(review, "_replay_slot", lambda own, theirs: calls.add(1) or replay(own, theirs), raising=False)
    state, rejects = review.apply_decisions(facts, spark.createDataFrame(steps, DECISION_DDL), kinds)
    assert {r["plan_id"]: r["review_state"] for r in state.collect()} == {p: "excluded" if p in ("p3", None) else "deferred" for p in plans}
    assert [tuple(r) for r in rejects.collect()] == [("p5", 2, "b", "review_fact_not_in_plan")]
    assert calls.value == 1
