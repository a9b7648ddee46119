import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [r[1:] for r in sorted(v, key=lambda r: r[0])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def plain_trie(paths):
    """Nodes of {id: list of (role, text)} by prefixes as tuples."""
    members = defaultdict(list)
    for c, turns in sorted(paths.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * words
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in m if len(paths[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def rows_of(frame):
    assert frame.columns == COLUMNS
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: r[:2])


def frame_of(spark, paths):
    rows = [(c, t, r, x) for c, turns in paths.items() for t, (r, x) in enumerate(turns)]
    return prefix_trie.conversation_paths(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("block", [2, 5, 512])
def test_find_close_and_ranks(block):
    rng = random.Random(block)
    for size in (1, 2, 3, 10, 700):
        bits, open_now = [True], 1
        while open_now:
            up = len(bits) < 2 * size and rng.random() < 0.55
            bits.append(up)
            open_now += 1 if up else -1
        paren = prefix_trie.Parens(np.array(bits), block)
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        opens = np.flatnonzero(paren.bits)
        assert paren.find_close(opens).tolist() == [close[i] for i in opens.tolist()]
        rank = paren.leaf_rank(np.array([], np.int64))
        assert rank[len(bits)] == sum(a and not b for a, b in zip(bits, bits[1:]))


def test_query_against_brute_force_and_sql(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{d}/conversations.parquet")
    got = rows_of(prefix_trie.op12_prefix_trie(spark, d))
    assert got == plain_trie(plain_rebuilt([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    assert got == sorted(con.execute(f"select {', '.join(COLUMNS)} from ({prefix_trie.ORACLES['op12_prefix_trie']})").fetchall(), key=lambda r: r[:2])


@pytest.mark.parametrize("shards, size", [(1, 1 << 18), (7, 1 << 18), (40, 1 << 18), (1, 6), (3, 1)])
def test_shared_spines_merge(spark, monkeypatch, shards, size):
    """Many shards of few conversations: nearly every node is shared."""
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", size)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rng = random.Random(shards + size)
    paths = {c: [(rng.choice("ua"), "w " * rng.choice([1, 1, 1, 3])) for _ in range(rng.randrange(1, 5))] for c in rng.sample(range(10_000), 120)}
    paths |= {c: [("u", "hot first turn"), ("a", "same")] for c in range(20_000, 20_060)}  # a hot conversation
    assert rows_of(prefix_trie.trie(frame_of(spark, paths), shards)) == plain_trie(paths)


def test_odd_rows(spark, tmp_path):
    rows = [(0, None, None, "null turn first"), (0, 0, "user", None), (1, 0, "", ""), (1, 1, "user", "x " * 200_000), (2, 0, "user", "alone"), (21, 3, "user", "no donor"), (None, 0, "user", "no conversation"),
            (40, 0, "a:", "b"), (60, 0, "a", ":b"), (80, 0, "é", "é é "), (100, 5, "user", " \t\r\n")]
    rows += [(200 + i, t, "user", f"same {t}") for i in range(45) for t in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("path"), F.lit("x").alias("words"), F.lit("y").alias("key"), F.lit(0).alias("_row"))
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    assert rows_of(prefix_trie.op12_prefix_trie(spark, str(tmp_path))) == plain_trie(plain_rebuilt(rows))


def test_turnless_conversations_end_at_the_root(spark, tmp_path):
    short = [c for c in range(1, 3000) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:5]
    rows = [(c, 0, "user", "taken away") for c in short]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = rows_of(prefix_trie.op12_prefix_trie(spark, str(tmp_path)))
    assert got == [(short[0], 0, None, 5, 0, 1, 0, hashlib.sha256(",".join(map(str, short)).encode()).hexdigest())]


def test_repeated_rows_are_turns_and_ties_have_one_order(spark, tmp_path):
    rows = [(20, 0, "user", "a b"), (20, 0, "user", "a b"), (20, 1, "assistant", "y"), (20, 1, "assistant", "x"), (41, 0, "user", "z")]
    for name, given in (("a", rows), ("b", rows[::-1])):
        spark.createDataFrame(given, SCHEMA).write.parquet(str(tmp_path / name / "conversations.parquet"))
    first, second = (rows_of(prefix_trie.op12_prefix_trie(spark, str(tmp_path / n))) for n in "ab")
    assert first == second and max(r[1] for r in first) == 4


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert rows_of(prefix_trie.op12_prefix_trie(spark, str(tmp_path))) == []
