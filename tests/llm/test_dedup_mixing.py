import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from attestor.llm import dedup, mixing
from attestor.llm.common import ROW, only_rows, with_row

ROWS = [(4, "a b\nc", "s1"), (2, "abc", "s1"), (9, "a  b c", None), (9, "a  b c", None), (None, "abc", "s2"), (1, None, "s2"), (6, " \t", "s2"), (8, "Abc", ""), (3, "x " * 70_000, "s3")]
SCHEMA = "doc_id long, text string, source string"


def frame(spark, rows=ROWS):
    return with_row(spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit(1)).withColumn("size", F.lit("x")).withColumn("h", F.lit(2)))


def check_groups(got, rows):
    classes = defaultdict(list)
    for i, text, *_ in rows:
        classes[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((i, len(text or "")))
    found = defaultdict(list)
    for r in got:
        found[r.text_sha256].append(r)
    assert len(found) == len(classes)
    for norm, members in classes.items():
        best = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        mine = found[hashlib.sha256(norm.encode()).hexdigest()]
        assert sorted(str(r.doc_id) for r in mine) == sorted(str(m[0]) for m in members)
        assert all(r.keep_id == best and r.group_size == len(members) for r in mine)
        assert [r.doc_id for r in mine if r.kept] == [best]


def test_exact_groups(spark):
    check_groups(dedup.exact_groups(frame(spark)).collect(), ROWS)
    assert dedup.exact_groups(frame(spark).limit(0)).count() == 0


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    check_groups(dedup.exact_groups(frame(spark), hash_of=lambda c: F.lit("00")).collect(), ROWS)


def test_kept_rows_carry_all_columns(spark):
    docs = frame(spark)
    kept = only_rows(docs, dedup.exact_groups(docs).where(F.col("kept")))
    assert kept.columns == ["doc_id", "text", "source", "kept", "size", "h"] and kept.count() == 4


def water(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def test_mix_meets_targets(spark):
    docs = [(i, "w " * (i % 37 + (4000 if i == 5 else 0)), None if i % 9 == 8 else f"s{min(i % 9, 4)}") for i in range(3000)]
    table = frame(spark, docs)
    for bins in (1, 64, 1 << 16):
        got = mixing.mix(table, bins=bins).collect()
        assert len(got) == 3000 and {r.doc_id for r in got} == set(range(3000))
        sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
        for r in got:
            assert r.size == len(docs[r.doc_id][1].split()) and r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r.size)
        want = water(sizes)
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
        rows = sorted((r.doc_id, r.taken) for r in got)
        assert rows == sorted((r.doc_id, r.taken) for r in mixing.mix(table.repartition(5), bins=bins).collect())


def test_inclusion_grows_with_size(spark):
    docs = [(i, "w " * (2 if i % 2 else 200), "a" if i < 4000 else "b") for i in range(8000)]
    got = mixing.mix(frame(spark, docs), weights=(1, 3), total_share=1.0).where("source = 'a'").collect()
    small, large = ([r.copies for r in got if (r.size == s)] for s in (2, 200))
    assert sum(large) / len(large) > sum(small) / len(small) and abs(sum(r.taken for r in got) - got[0].target) <= 200


def test_edge_rows(spark):
    got = mixing.mix(frame(spark)).collect()
    assert len(got) == len(ROWS) and {r.size for r in got if r.doc_id in (1, 6)} == {0}
    assert mixing.mix(frame(spark).limit(0)).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect())
