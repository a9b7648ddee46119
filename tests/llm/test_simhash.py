import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attestor.llm import simhash
from attestor.llm.common import ROW, with_row


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, distance):
    values = np.array(sorted(values), dtype=np.int64)
    near = np.bitwise_count((values[:, None] ^ values[None, :]).view(np.uint64)) <= distance
    label = np.arange(len(values))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return {frozenset(values[label == x].tolist()) for x in set(label.tolist())}
        label = new


def clustered(seed, centres=25, each=30):
    rng = np.random.default_rng(seed)
    out = set()
    for c in rng.integers(-2**63, 2**63, centres):
        x = int(c)
        for _ in range(int(rng.integers(1, each))):
            out.add(x)
            for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(bit)
            x = (x + 2**63) % 2**64 - 2**63
            out.add(x)
    return out


def found_components(spark, values, **options):
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(fps, **options)).collect()}
    groups = {}
    for v in values:
        groups.setdefault(roots.get(v, v), set()).add(v)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("text", ["", None, "a", "One two\tthree", "x " * 9, "Äpfel UND birnen und Äpfel und Birnen", "a b c d e f g", "w%d " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_fingerprint_of_long_text_spans_blocks():
    text = " ".join(f"w{i % 977}" for i in range(100_500))
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


@pytest.mark.parametrize("groups", [
    None, [(list(range(g * 16, g * 16 + 16)), t) for g, t in enumerate((1, 0, 0, 0))], [(list(range(0, 21)), 1), (list(range(21, 42)), 1), (list(range(42, 64)), 0)]])
def test_links_match_brute_force(spark, groups):
    values = clustered(1)
    assert found_components(spark, values, groups=groups) == plain_components(values, 4)


def test_large_buckets_go_through_midpoints(spark):
    values = clustered(2, centres=4, each=12)
    assert found_components(spark, values, bucket=3) == plain_components(values, 4)


def test_thresholds_cover_the_distance():
    for parts in range(1, 6):
        costs = [[float(3 ** t) * (g + 1) for t in range(5)] for g in range(parts)]
        _, thresholds = simhash.allocate(costs, 4)
        assert sum(t + 1 for t in thresholds) == 5


def test_edge_rows(spark):
    rows = [(5, None, 1), (3, "", 1), (3, "", 1), (None, " \n", 1), (7, "one two three four five", 1), (None, "one two three four five", 2)]
    docs = with_row(spark.createDataFrame(rows, "doc_id long, text string, fp int"))
    got = simhash.near_groups(docs).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 2
    assert {(r.fingerprint == "0" * 16, r.component_id) for r in got} == {(True, 3), (False, 7)}
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp int"))
    assert kept.columns == ["doc_id", "text", "fp"] and sorted(r.doc_id for r in kept.collect()) == [3, 7]
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_query_matches_brute_force_over_the_table(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in simhash.op7_simhash_near_dedup(spark, d).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert all(got[i].fingerprint == f"{fps[i]:016x}" for i in texts)
    signed = {v - 2**64 if v >= 2**63 else v for v in fps.values()}
    for group in plain_components(signed, 4):
        ids = [i for i, v in fps.items() if (v - 2**64 if v >= 2**63 else v) in group]
        assert {got[i].component_id for i in ids} == {min(ids)}


def test_rounds_of_few_pairs_have_few_tasks(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "a long, b long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = simhash.components(edges)
        assert found.rdd.getNumPartitions() <= simhash.LEAST_TASKS
        assert {(r.node, r.root) for r in found.collect()} == {(i, 0 if i <= 20 else 21) for i in range(1, 41) if i != 21}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
