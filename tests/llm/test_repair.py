import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from attestor.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_cheapest(rows):
    """Least (cost, audit) by exhaustive shortest path over (rows used, roles given out), the order checked by the pattern itself."""
    longest = 2 * len(rows) + 2
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if (i, out) in done:
            continue
        done.add((i, out))
        if i == len(rows) and LEGAL.fullmatch(out):
            return cost, audit
        if i < len(rows):
            initial, bad, truncated = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, out))
            if not bad:
                if initial:  # an empty role is none that may stand
                    heapq.heappush(heap, (cost + truncated, audit + "K", i + 1, out + initial))
                for to in "ua":
                    heapq.heappush(heap, (cost + 2 + truncated, audit + "R", i + 1, out + to))
        if len(out) < longest:
            for to in "ua":
                heapq.heappush(heap, (cost + 2, audit + "I", i, out + to))
        heap = [h for h in heap if re.fullmatch(r"s?(ua)*u?", h[3])]
        heapq.heapify(heap)


def plain_rows(conv_rows):
    """Faults of damaged rows (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in conv_rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def plain_query(rows):
    """The contract by plain Python, for rows (conv_id, turn, role, text)."""
    kept = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        group = kept.setdefault(conv, [])
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            group += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, group in kept.items():
        faults = plain_rows(group)
        numbers = [t for t, _, _ in group if t is not None]
        initials = [r[:1] for _, r, _ in group]
        items = [(a, f in ("blank", "duplicate"), f == "truncated") for a, f in zip(initials, faults)]
        cost, audit = plain_cheapest(items)
        lines, at, last = [], 0, ""
        for edit in audit:
            made = "assistant" if last == "u" else "user"
            if edit == "I":
                lines.append(f"{made}:")
                last = made[0]
                continue
            _, role, text = group[at]
            at += 1
            if edit != "D":
                role = made if edit == "R" else role
                lines.append(f"{role}:{text}")
                last = role[0]
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, tmp_path, frame):
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    out = repair.op13_structure_repair(spark, str(tmp_path))
    rows = out.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def known(items):
    rows = repair.Rows()
    for item in items:
        rows.add(*item)
    return rows


def test_search_is_exact_with_either_bound():
    rng = random.Random(13)
    for _ in range(250):
        items = [(rng.choice("ssuuuaaaat "), rng.random() < 0.15, rng.random() < 0.3) for _ in range(rng.randrange(7))]
        wanted = plain_cheapest(items)
        for bounds in (repair.row_bounds, repair.state_bounds):
            assert repair.cheapest(known(items), bounds) == wanted, items


def test_bounds_never_exceed_what_is_left():
    rng = random.Random(7)
    for _ in range(60):
        items = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(6)]
        for bounds in (repair.row_bounds, repair.state_bounds):
            for i in range(7):
                assert bounds(known(items))(i, 0) <= plain_cheapest(items[i:])[0]


def test_long_conversations_take_linear_time():
    rng = random.Random(3)
    items = [(rng.choice("sua"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(60_000)]
    cost, audit = repair.cheapest(known(items))
    assert cost > 0 and sum(e != "I" for e in audit) == len(items)


def test_query_against_brute_force_on_the_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in repair.op13_structure_repair(spark, "/root/testdata/sf0.01").collect()}
    assert got == plain_query([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    assert len({r[6] for r in got.values()}) > 5


def test_odd_rows(spark, tmp_path):
    rows = [
        (1, None, "user", "Hello."), (1, 0, None, "Spaces."), (1, 1, "assistant", None), (1, 2, "user", ""), (1, 3, "assistant", "Ends open"),
        (2, None, None, None), (3, 7, "tool", "é !"), (3, 9, "assistant", "x" * 300_000 + "."), (4, 0, "User", "Capital."), (4, 1, "", "No role."),
        (5, 0, "assistant", "Same."), (5, 1, "user", "Same."), (5, 2, "assistant", "Same."), (5, 4, "assistant", "a\n.\n"), (6, 1, "system", "Only."),
    ] + [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 5}.") for c in range(100, 160) for t in range(6)]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("x").alias("tie"), F.lit("y").alias("audit"), F.lit(1).alias("gone"), F.lit(2).alias("_row"))
    assert run(spark, tmp_path, frame) == plain_query(rows)


def test_repeated_rows_and_ties_have_one_result(spark, tmp_path):
    rows = [(1, 0, "user", "Again."), (1, 0, "user", "Again."), (1, 1, "assistant", "B."), (1, 1, "assistant", "A."), (None, 0, "user", "No number.")]
    first = run(spark, tmp_path / "a", spark.createDataFrame(rows, SCHEMA))
    second = run(spark, tmp_path / "b", spark.createDataFrame(rows[::-1], SCHEMA).repartition(3))
    assert first == second and set(first) == {1, None}


def test_dropped_conversations_are_returned(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = run(spark, tmp_path, spark.createDataFrame([(gone, 0, "user", "Gone.")], SCHEMA))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, spark.createDataFrame([], SCHEMA)) == {}


def test_repaired_rows_are_legal(spark):
    turns = repair.damaged(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    rows = repair.repaired(turns, repair.audits(turns)).orderBy("conv_id", "place").collect()
    by = {}
    for r in rows:
        assert r.place == len(by.setdefault(r.conv_id, []))
        by[r.conv_id].append(r.role[0])
    assert by and all(LEGAL.fullmatch("".join(x)) for x in by.values())


@pytest.mark.parametrize("initials, audit", [("", ""), ("ua", "KK"), ("s", "D"), ("su", "KKI"), ("a", "IK"), ("uu", "KIKI"), ("t", "D")])
def test_small_cases(initials, audit):
    items = [(x, False, False) for x in initials]
    cost, found = repair.cheapest(known(items))
    assert (cost, found) == plain_cheapest(items)
    assert found == audit or cost <= sum(repair.COST[e] for e in audit)
