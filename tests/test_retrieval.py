import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from attestor.operators import fusion, postings, search, selection


def test_bm25_equals_brute_force_inside_the_visible_bases(spark, tmp_path):
    rng = random.Random(5)
    words = ["red", "blue", "hub", "bulb", "zig-bee", "a1"]
    docs = [(i, "ab"[i % 2], " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(40)]
    asked = [("q1", "red hub", ["a"]), ("q2", "zig-bee a1 red red", ["a", "b"])]
    index = postings.build_index(spark.createDataFrame(docs, "chunk_id int, kb_id string, search_text string"), str(tmp_path / "index"))
    got = {}
    for r in search.bm25(spark.createDataFrame(asked, "request_id string, query string, kb_ids array<string>"), index, 5).collect():
        got.setdefault(r["request_id"], {})[r["rank"]] = (r["chunk_id"], round(r["score"], 6))
    for name, query, kbs in asked:
        rows = {i: Counter(t.split()) for i, k, t in docs if k in kbs}
        average = sum(sum(c.values()) for c in rows.values()) / len(rows)
        scores = {}
        for i, c in rows.items():
            total = 0.0
            for t in set(query.split()):
                df = sum(t in o for o in rows.values())
                if c[t]:
                    total += math.log(1 + (len(rows) - df + .5) / (df + .5)) * c[t] * 2.2 / (c[t] + 1.2 * (.25 + .75 * sum(c.values()) / average))
            if total:
                scores[i] = round(total, 6)
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [got[name][k + 1][0] for k in range(len(want))] == [i for i, _ in want]
        assert all(abs(got[name][k + 1][1] - s) < 1e-5 for k, (_, s) in enumerate(want))


def test_knn_small_and_large_way_agree_with_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 4))
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, vector array<float>")
    asked = table.where("vec_id < 7").select(F.col("vec_id").alias("request_id"), "vector")
    unit = vectors.astype("float32").astype("float64")
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {str(i): list(np.lexsort((np.arange(60), -np.round(unit[i] @ unit.T, 6)))[:5]) for i in range(7)}
    for limit in (4096, 0):
        monkeypatch.setattr(search, "KNN_BATCH_REQUESTS", limit)
        rows = search.knn(asked, table, 5, 4).orderBy("request_id", "rank").collect()
        got = {}
        for r in rows:
            got.setdefault(r["request_id"], []).append(r["vec_id"])
        assert got == want


def test_fusion_keeps_raw_ranks_and_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([("q", "keyword", 2, 1), ("q", "vector", 1, 1), ("q", "keyword", 3, 7), ("q", "relation", 3, 1)], "request_id string, source string, chunk_id int, rank int")
    got = [(r["chunk_id"], round(r["score"], 10)) for r in fusion.rank_fused(fusion.fuse(rows)).orderBy("position").collect()]
    assert got == [(3, round(1 / 67 + .5 / 61, 10)), (1, round(1 / 61, 10)), (2, round(1 / 61, 10))]
    assert fusion.fuse(rows.orderBy(F.desc("rank"))).count() == 3


def candidates(spark, n, scores):
    rows = [("q", i, i, 1.0 / i, "query", "text") for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "request_id string, chunk_id int, position int, score double, query string, search_text string")
    table = dict(scores)
    return fusion.rerank(df, lambda batch: [table.get(int(i), 0.0) for i in batch["chunk_id"]], top_k=2, window=3).orderBy("position").collect()


def test_rerank_drops_beyond_the_window_and_a_bad_score_keeps_the_fused_order(spark):
    assert [r["chunk_id"] for r in candidates(spark, 5, {1: .1, 2: .3, 3: .2})] == [2, 3, 1]
    assert [r["chunk_id"] for r in candidates(spark, 5, {1: .1, 2: float("nan"), 3: .2})] == [1, 2, 3, 4, 5]


def test_relation_hop_respects_interval_direction_and_conditions(spark):
    relations = spark.sql("""select * from values ('r1', 'a', 'b', 't', map('product_model', 'M'), null, null), ('r2', 'a', 'c', 't', map(), timestamp'2024-01-01', timestamp'2025-01-01'),
      ('r3', 'd', 'a', 't', map(), null, null) as v(relation_id, subject_id, object_id, relation_type, conditions, valid_from, valid_until)""")
    evidence = spark.createDataFrame([("r1", 1, "supports"), ("r2", 2, "supports"), ("r3", 3, "supports")], "relation_id string, chunk_id int, stance string")
    seeds = spark.createDataFrame([("q", "a")], "request_id string, entity_id string")
    ids = lambda **kw: sorted(r["relation_id"] for r in fusion.expand_relations(seeds, relations, evidence, **kw).collect())
    at = F.expr("timestamp'2025-01-01'")
    assert ids() == ["r2", "r3"] and ids(direction="outgoing", conditions={"product_model": "M"}) == ["r1", "r2"]
    assert ids(at=at) == ["r3"] and ids(direction="incoming") == ["r3"]


def adaptive(spark, texts, query, facets, top_k=8, max_bytes=48000, scopes=None):
    none = "cast(array() as array<string>)"
    rows = [("q", i, i, t, (scopes or {}).get(i, "P")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "request_id string, chunk_id int, position int, source_text string, owner string").selectExpr(
        "*", "'' as required_text", "'k' as kb_id", "'d' as document_id", "'v' as version_id", "'resolved' as scope_status",
        "array(named_struct('entity_id', cast(null as string), 'display_name', owner, 'product_model', cast(null as string), 'software_version', cast(null as string), 'source_kind', 'curated')) as subjects",
        f"{none} as conditions", "cast(null as string) as source_unit_id", "cast(null as string) as business_version", "octet_length(source_text) as bytes", "0 as context_chars",
        "cast(array() as array<int>) as required_parts")
    asked = spark.createDataFrame([("q", query, facets)], "request_id string, query string, facets array<string>")
    out = selection.select_adaptive(selection.information_features(df, asked), top_k, max_bytes).orderBy("hit_rank").collect()
    return [r["chunk_id"] for r in out], out[0]["stop_reason"] if out else None


def test_adaptive_selection_covers_facets_and_keeps_differences(spark):
    intro = ["Product overview: exceptional craftsmanship.", "Product overview: exceptional craftsmanship and care."]
    got = adaptive(spark, intro + ["Weight: 500 g.", "Price: 20 USD.", "Storage: 3 days after opening."], "price weight storage", ["price", "weight", "storage"], 20)
    assert got == ([2, 3, 4], "no_information_gain")
    texts = ["Storage: 45 days.", "Storage: 3 days after opening.", "Storage: not permitted when opened.", "Storage: 45 days.", "Storage: 45 days if refrigerated."]
    assert adaptive(spark, texts, "storage", ["storage"], scopes={3: "Other Product"})[0] == [0, 1, 2, 3, 4]
    assert adaptive(spark, ["Ratio: 2:1", "Ratio: 1:2", "Ratio: -20 °C", "Ratio: 20 °C"], "ratio", ["ratio"])[0] == [0, 1, 2, 3]
    assert adaptive(spark, ["x" * 8000, "Input: 12 V."], "input", [], 1, 4096)[0] == [1]


def test_ranked_fill_equals_the_loop_and_never_exceeds_the_budget(spark):
    rng = random.Random(9)
    rows = [(f"q{q}", i, i + 1, rng.randint(5, 60), rng.randint(0, 30)) for q in range(20) for i in range(15)]
    got = {}
    for r in selection.select_ranked(spark.createDataFrame(rows, "request_id string, chunk_id int, position int, bytes int, context_chars int"), 5, 120, 70).orderBy("hit_rank").collect():
        got.setdefault(r["request_id"], []).append(r["chunk_id"])
    for q in range(20):
        taken, total, chars = [], 0, 0
        for _, i, _, b, c in [r for r in rows if r[0] == f"q{q}"]:
            n = len(taken) + 1
            if len(taken) < 5 and 2 + total + b + n - 1 + max(0, n - 9) <= 120 and chars + c <= 70:
                taken.append(i)
                total, chars = total + b, chars + c
        assert got.get(f"q{q}", []) == taken


def test_a_question_of_more_than_eight_sentences_is_one_facet(spark):
    from attestor.plans.retrieval import questions_with_facets

    nine, eight = ("".join(f"Part{i} of it. " for i in range(n)).strip() for n in (9, 8))
    asked = spark.createDataFrame([("a", nine), ("b", eight), ("c", "One. Two? Three."), ("d", None)], "request_id string, query string")
    got = {r["request_id"]: r["facets"] for r in questions_with_facets(asked).collect()}
    assert got == {"a": [nine.replace(". ", "? ")], "b": [f"Part{i} of it?" for i in range(7)] + ["Part7 of it."], "c": ["One?", "Two?", "Three."], "d": None}
