"""Stored postings, vector lists and link graphs: against brute force, with few and many requests, whole and bounded."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestor.operators import ann, graphs, postings, search
from attestor.sources.stored import file_state, stored

WORDS = [f"w{i}" for i in range(40)]


def corpus(n=300, seed=5):
    """Chunks whose topics drift with their ids, so that neighbours are alike and bounds differ between ranges; one base holds a third."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        topic = WORDS[i * 30 // n: i * 30 // n + 5]
        rows.append((i, "hot" if i % 3 == 0 else f"kb{i % 4}", " ".join(rng.choice(topic if rng.random() < 0.7 else WORDS) for _ in range(rng.randrange(0, 30)))))
    return rows


def asked_rows(seed=2, n=25):
    rng = random.Random(seed)
    return [(f"q{i}", " ".join(rng.sample(WORDS, rng.randrange(1, 5))), rng.choice([["hot"], ["hot", "kb1"], ["kb0", "kb1", "kb2", "kb3", "hot"], ["none"]])) for i in range(n)]


def plain_ranking(rows, asked, k, kind="bm25"):
    out = {}
    for request, query, kbs in asked:
        seen = {i: t.split() for i, kb, t in rows if kb in kbs}
        average = max(1.0, sum(map(len, seen.values())) / len(seen)) if seen else 1.0
        scores = {}
        for i, words in seen.items():
            count, total = Counter(words), 0.0
            for t, n in Counter(query.split()).items():
                if count[t]:
                    df = sum(t in w for w in seen.values())
                    total += (1 + math.log(count[t])) * n if kind == "logtf" else \
                        math.log(1 + (len(seen) - df + .5) / (df + .5)) * count[t] * 2.2 / (count[t] + 1.2 * (.25 + .75 * len(words) / average))
            if total:
                scores[i] = total
        out[request] = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
    return {q: v for q, v in out.items() if v}


def ranking_of(frame):
    out = defaultdict(list)
    for r in frame.orderBy("request_id", "rank").collect():
        out[r.request_id].append((r.chunk_id, r.score))
    return dict(out)


def same(got, want):
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a - b) < 1e-9 for q in want for (_, a), (_, b) in zip(got[q], want[q]))


@pytest.fixture(scope="module")
def small_ranges():
    patch = pytest.MonkeyPatch()
    patch.setattr(postings, "RANGE", 10)
    yield patch
    patch.undo()


@pytest.fixture(scope="module")
def index(spark, small_ranges, tmp_path_factory):
    chunks = spark.createDataFrame(corpus(), "chunk_id long, kb_id string, search_text string")
    return postings.build_index(chunks, str(tmp_path_factory.mktemp("postings") / "index"))


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(asked_rows(), "request_id string, query string, kb_ids array<string>")


@pytest.mark.parametrize("kind, direct", [("bm25", 0), ("bm25", 10_000), ("logtf", 0)])
def test_rankings_are_exact_whole_and_bounded(index, requests, kind, direct):
    same(ranking_of(postings.ranked(requests, index, 5, kind, direct=direct)), plain_ranking(corpus(), asked_rows(), 5, kind))


@pytest.mark.parametrize("direct", [0])
def test_many_requests_take_the_shuffled_way(index, requests, monkeypatch, direct):
    monkeypatch.setattr(postings, "LOCAL_ROWS", 3)
    same(ranking_of(postings.ranked(requests, index, 5, direct=direct)), plain_ranking(corpus(), asked_rows(), 5))


@pytest.mark.parametrize("kind", ["bm25", "logtf"])
def test_many_requests_over_a_whole_index_take_the_shuffled_way(index, requests, monkeypatch, kind):
    monkeypatch.setattr(postings, "LOCAL_ROWS", 20)  # the bases are at hand, the terms are not
    same(ranking_of(postings.ranked(requests, index, 5, kind, direct=10_000)), plain_ranking(corpus(), asked_rows(), 5, kind))


def test_ranges_below_the_kth_score_are_not_read(index, requests):
    asked = postings.ask(requests, index, "bm25")
    bounds, (first, rest) = postings.range_bounds(asked), postings.ranges_to_read(asked, 3)
    every, further = bounds.count(), rest.count()
    assert further < 0.7 * every  # at most SEEDS per request besides
    assert first.count() > 0


def test_a_search_reads_the_files_of_its_terms_only(spark, index):
    one = spark.createDataFrame([("q", "w3 w4", ["hot"])], "request_id string, query string, kb_ids array<string>")
    asked = postings.ask(one, index, "bm25")
    plan = asked.postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "IN (w3,w4)" in plan or "In(term, [w3,w4])" in plan
    assert {r.term for r in asked.postings.select("term").distinct().collect()} == {"w3", "w4"}


def test_a_task_writes_whole_ranges_and_equal_ids_share_one(spark, tmp_path, small_ranges):
    rows = corpus() + [(5, corpus()[5][1], "again w3")] * 15
    index = postings.build_index(spark.createDataFrame(rows, "chunk_id long, kb_id string, search_text string"), str(tmp_path / "w"))
    placed = index.postings.select("kb_id", "range", F.regexp_extract(F.input_file_name(), r"part-(\d+)-", 1).alias("task"))
    assert placed.groupBy("kb_id", "range").agg(F.count_distinct("task").alias("n")).where("n > 1").count() == 0
    assert index.postings.groupBy("kb_id", "chunk_id").agg(F.count_distinct("range").alias("n")).where("n > 1").count() == 0
    assert index.ranges > 3


def test_a_block_is_one_row(spark, index):
    """Postings of one term, base and range are stored together, and the files of all buckets fit under the limit above which Spark sorts the rows to write them."""
    keys = ["term", "kb_id", "field", "range"]
    assert index.packed.groupBy(*keys).count().where("count > 1").count() == 0
    rows = {(r.term, r.chunk_id): (r.tf, r.dl, list(r.positions)) for r in index.postings.collect()}
    want = {(t, i): (n, len(text.split()), [p for p, w in enumerate(text.split()) if w == t]) for i, _, text in corpus() for t, n in Counter(text.split()).items()}
    assert rows == want
    assert index.packed.where("n <> size(chunk_ids) or total <> aggregate(tfs, 0, (a, x) -> a + x) or max_tf <> array_max(tfs) or min_dl <> array_min(dls)").count() == 0


def test_columns_of_few_repeats_are_written_without_a_dictionary(spark, index):
    import pyarrow.parquet as pq

    file = next(f for f in index.packed.inputFiles() if pq.ParquetFile(f.removeprefix("file://")).metadata.num_rows)
    group = pq.ParquetFile(file.removeprefix("file://")).metadata.row_group(0)
    columns = [group.column(i) for i in range(group.num_columns)]
    coded = {c.path_in_schema.split(".")[0] for c in columns if c.has_dictionary_page}
    assert not coded & {"term", "range", "chunk_ids", "positions"} and {"kb_id", "tfs"} <= coded
    totals = {(r.kb_id, r.field): r.total_dl for r in index.stats.collect()}
    assert totals == {(kb, "text"): sum(len(t.split()) for _, own, t in corpus() if own == kb) for kb in {kb for _, kb, _ in corpus()}}


def test_many_requests_read_each_range_once(index, requests, monkeypatch):
    monkeypatch.setattr(postings, "FEW_REQUESTS", 0)
    monkeypatch.setattr(postings, "ranges_to_read", None)
    same(ranking_of(postings.ranked(requests, index, 5, direct=0)), plain_ranking(corpus(), asked_rows(), 5))


def test_best_field_counts(spark, tmp_path, small_ranges):
    rows = [(1, "k", "alpha beta", "gamma"), (2, "k", "gamma", "alpha alpha"), (3, "k", "delta", None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, kb_id string, source_text string, title string")
    index = postings.build_index(chunks, str(tmp_path / "f"), {"source_text": F.col("source_text"), "title": F.col("title")})
    asked = spark.createDataFrame([("q", "alpha", ["k"])], "request_id string, query string, kb_ids array<string>")
    got = {r.chunk_id: r.score for r in search.bm25_fields(asked, index, {"source_text": 3.0, "title": 1.0}, 5).collect()}
    idf = math.log(1 + (3 - 1 + .5) / 1.5)
    assert got[1] == pytest.approx(3 * idf * 2.2 / (1 + 1.2 * (.25 + .75 * 2 / (4 / 3)))) and got[2] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (.25 + .75 * 2 / 1.0)))


def test_restricted_index_counts_its_own_rows_only(index, requests):
    kept = index.postings.sparkSession.createDataFrame([(i, kb) for i, kb, _ in corpus() if i % 2], "chunk_id long, kb_id string")
    same(ranking_of(postings.ranked(requests, index.restricted(kept), 5)), plain_ranking([r for r in corpus() if r[0] % 2], asked_rows(), 5))


def test_phrases_are_tokens_in_order(spark, tmp_path, small_ranges):
    rows = [(1, "k", "cat all cat"), (2, "k", "all cats"), (3, "k", "ALL, cat!"), (4, "k", "cat cat cat"), (5, "other", "all cat"), (6, "k", "a b a b c"), (7, "k", ""), (8, "k", None), (9, "k", "all the cat")]
    index = postings.build_index(spark.createDataFrame(rows, "chunk_id long, kb_id string, search_text string"), str(tmp_path / "p"))
    asked = [("all ca", []), ("all cat", [1, 3]), ("cat", [1, 3, 4, 9]), ("cat cat", [4]), ("cat cat cat", [4]), ("cat cat cat cat", []), ("a b c", [6]), ("a b a b c", [6]), ("b a b c", [6]), ("", []), ("zebra cat", [])]
    requests = spark.createDataFrame([(q, q, ["k"]) for q, _ in asked], "request_id string, query string, kb_ids array<string>")
    for limit in (200_000, 0):
        patch = pytest.MonkeyPatch()
        patch.setattr(postings, "LOCAL_ROWS", limit)
        got = defaultdict(list)
        for r in postings.phrases(requests, index).collect():
            got[r.request_id].append(r.chunk_id)
        patch.undo()
        assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in asked if v}


def test_places_of_a_phrase_stay_off_the_driver(spark, tmp_path, small_ranges, monkeypatch):
    """What comes to the driver is a row per token of the queries, without lists, however many chunks hold the rarest token."""
    query = "rare next " + " ".join(f"other{i}" for i in range(8))
    rows = [(i, "k", query if i < 60 else "rare next other1") for i in range(120)]
    index = postings.build_index(spark.createDataFrame(rows, "chunk_id long, kb_id string, search_text string"), str(tmp_path / "many"))
    requests = spark.createDataFrame([("q", query, ["k"]), (None, query, ["k"])], "request_id string, query string, kb_ids array<string>")
    for limit in (200_000, 30):  # the places are broadcast, or they meet by shuffle
        monkeypatch.setattr(postings, "LOCAL_ROWS", limit)
        taken, of = [], postings.at_hand
        monkeypatch.setattr(postings, "at_hand", lambda df: taken.append(of(df)) or taken[-1])
        got = sorted((r.request_id or "", r.chunk_id) for r in postings.phrases(requests, index).collect())
        monkeypatch.setattr(postings, "at_hand", of)
        assert got == [(q, i) for q in ("", "q") for i in range(60)]
        assert all(rows is not None and len(rows) <= 20 and not any("array" in kind for _, kind in df.dtypes) for df, rows in taken)


def test_an_index_follows_its_input(spark, tmp_path):
    path, built = str(tmp_path / "t"), []
    for n in (3, 3, 4):
        if n == 4 or not built:
            spark.range(n).write.mode("overwrite").parquet(path)
        stored(spark, "test", [path], built.append)
    assert len(built) == 2 and file_state(spark, path)


# --- vectors ----------------------------------------------------------------------------------------------------------

def clustered(n=2000, groups=40, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 16))
    return centres[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, 16))


def test_centroid_lists_reach_nine_of_ten_neighbours_in_few_lists(spark, tmp_path):
    vectors = clustered()
    vectors[:600] = vectors[0]  # a third are one vector
    table = spark.createDataFrame([(i, f"k{i % 2}", [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, kb_id string, vector array<double>")
    index = ann.build_centroid_index(table, str(tmp_path / "c"), k=10)
    assert index.lists.count() == len(vectors) and index.probes < len(index.centroids) / 3
    asked = table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("request_id"), "kb_id", "vector")
    exact = {(r.request_id, r.vec_id): r.score for r in search.knn(asked, table, 10).collect()}
    found = {(r.request_id, r.vec_id): r.score for r in search.knn(asked, None, 10, method="centroids", index=index).collect()}
    shared = set(exact) & set(found)
    assert len(shared) >= 0.9 * len(exact) and all(abs(exact[p] - found[p]) < 1e-9 for p in shared)


def test_blocks_split_a_hot_base(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 50)
    monkeypatch.setattr(ann, "BLOCK_REQUESTS", 20)
    monkeypatch.setattr(search, "KNN_BATCH_REQUESTS", 0)
    vectors = clustered(400)
    table = spark.createDataFrame([(i, "hot" if i % 3 else "cold", [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, kb_id string, vector array<double>")
    asked = table.where("vec_id < 90").select(F.col("vec_id").alias("request_id"), "kb_id", "vector")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in search.knn(asked, table, 5).orderBy("rank").collect():
        got[int(r.request_id)].append(r.vec_id)
    for i in range(90):
        own = [j for j in range(400) if bool(j % 3) == bool(i % 3)]
        assert got[i] == sorted(own, key=lambda j: (-round(float(unit[i] @ unit[j]), 6), j))[:5]


# --- graphs -----------------------------------------------------------------------------------------------------------

def reach(edges, start):
    seen, front = set(), [start]
    while front:
        front = [b for a in front for b in edges.get(a, ()) if b not in seen and not seen.add(b)]
    return seen


@pytest.mark.parametrize("limit, seed", [(graphs.GROUP_EDGES, 1), (0, 2)])
def test_cycles_against_reachability(spark, limit, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(45)} | {(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (104, 105), (105, 104)}
    ahead, back = defaultdict(set), defaultdict(set)
    for a, b in pairs:
        if a != b:
            ahead[a].add(b)
            back[b].add(a)
    nodes = {x for p in pairs for x in p}
    after, before = ({n: reach(g, n) for n in nodes} for g in (ahead, back))
    on_cycle = {n for n in nodes if n in after[n]}
    strong = {n: max(m for m in nodes if m in after[n] and n in after[m]) for n in on_cycle}
    between = {n for n in nodes if (on_cycle & (after[n] | {n})) and (on_cycle & (before[n] | {n}))}
    frame = spark.createDataFrame([(f"{a:03}", f"{b:03}") for a, b in pairs], "a string, b string")
    assert {int(r.node): int(r.strong) for r in graphs.strong_components(frame, limit).collect()} == strong
    assert {int(r.node) for r in graphs.between_cycles(frame, limit).collect()} == between


def test_small_components_share_a_call(spark):
    frame = spark.createDataFrame([(f"{x}{i}", f"{y}{i}") for i in range(300) for x, y in ("ab", "ba")], "a string, b string")
    slots = graphs.by_component(frame, lambda e: e.groupBy("slot").agg(F.count("*").alias("n")), None)
    assert [r.n for r in slots.collect()] == [600]
    assert graphs.strong_components(frame).count() == 600 and graphs.between_cycles(frame).count() == 600


def test_no_edges_and_long_chains(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert graphs.strong_components(none).count() == 0 and graphs.between_cycles(none).count() == 0
    chain = pd.DataFrame({"a": list(range(30_000)), "b": list(range(1, 30_000)) + [0]})
    assert len(graphs.strong_of_group(chain)) == 30_000
