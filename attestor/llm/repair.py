"""Conversation structure repair (operator 13): the cheapest edits that give each conversation a legal order of roles.

Legal orders of role initials are ``(s?(ua)+)?``. The edits of a conversation are found by depth-first branch and bound over nodes
(rows used, last role given out): an explicit stack, lower bounds for what is left, an incumbent (cost, audit), and per node the best prefix
seen. Rows are judged by DataFrame functions; the search sees a few bytes a row, never a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import cut, read

# Fixed values of the contract: edits by initial, their costs, and the roles that may follow the last one given out.
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
TRUNCATED = 1
STATES = ("", "s", "u", "a")
MADE = (2, 2, 3, 2)  # per state, the state behind a user or assistant turn made by Insert or Rerole
ENDS = (True, False, False, True)
NAMES = {2: "user", 3: "assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}
BATCH = 4096


# --- search -----------------------------------------------------------------------------------------------------------

class Rows:
    """What the search knows of a conversation: per row the state its role leads to (0: none), whether it must go, whether it is truncated."""

    def __init__(self):
        self.state, self.bad, self.truncated = bytearray(), bytearray(), bytearray()

    def add(self, initial: str, bad: bool, truncated: bool) -> None:
        self.state.append(STATES.index(initial) if initial in ("s", "u", "a") else 0)
        self.bad.append(bad)
        self.truncated.append(truncated and not bad)

    def __len__(self):
        return len(self.state)


def steps(rows: Rows, i: int, state: int) -> list[tuple[str, int, int, int]]:
    """Edits open at a node as (initial, rows used, state, cost), in ASCII order."""
    made, found = MADE[state], []
    if i < len(rows):
        found.append(("D", i + 1, state, COST["D"]))
    found.append(("I", i, made, COST["I"]))
    if i < len(rows) and not rows.bad[i]:
        own, extra = rows.state[i], TRUNCATED * rows.truncated[i]
        if own == made or (own == 1 and state == 0):
            found.append(("K", i + 1, own, COST["K"] + extra))
        if own != made:
            found.append(("R", i + 1, made, COST["R"] + extra))
    return found


def row_bounds(rows: Rows) -> Callable[[int, int], int]:
    """Lower bound of each suffix: the cheapest edit of every row by itself. Quick and weak."""
    left = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        alone = COST["D"] if rows.bad[i] else rows.truncated[i] * TRUNCATED + (0 if rows.state[i] else COST["R"])
        left[i] = left[i + 1] + min(COST["D"], alone)
    return lambda i, state: left[i]


def state_bounds(rows: Rows) -> Callable[[int, int], int]:
    """Lower bound of each suffix behind each last role, by one pass from the end. What is left costs the same behind every prefix,
    so the bound is tight: the search goes straight to a best end and has only ties to settle, in time linear in the rows."""
    n = len(rows)
    left = [(0, 2 * COST["I"], COST["I"], 0)] * (n + 1)
    for i in range(n - 1, -1, -1):
        after = left[i + 1]
        now = [min([cost + after[to] for _, at, to, cost in steps(rows, i, s) if at > i]) for s in range(4)]
        for _ in range(3):  # rows may be inserted before row i, one role after the other
            now = [min(now[s], COST["I"] + now[MADE[s]]) for s in range(4)]
        left[i] = tuple(now)
    return lambda i, state: left[i][state]


def audit_of(link) -> str:
    out = []
    while link is not None:
        out.append(link[1])
        link = link[0]
    return "".join(reversed(out))


def cheapest(rows: Rows, bounds: Callable[[Rows], Callable[[int, int], int]] = state_bounds) -> tuple[int, str]:
    """Least cost and its ASCII-least audit; exact with any lower bounds.

    Prefixes are linked lists (parent, initial, length), so a stack entry takes constant memory. At a node, a prefix is dropped if one with less
    (cost, audit) has been there: neither can be the beginning of the other at equal cost, because edits that use no row cost something.
    """
    bound = bounds(rows)
    best_cost, best, chain = None, "", []
    seen: dict[int, tuple[int, tuple | None]] = {}
    stack: list[tuple[int, int, int, tuple | None]] = [(0, 0, 0, None)]
    while stack:
        i, state, cost, link = stack.pop()
        if best_cost is not None:
            least = cost + bound(i, state)
            if least > best_cost or (least == best_cost and link is not None and _behind(link, chain, best)):
                continue
        key = 4 * i + state
        known = seen.get(key)
        if known is not None and (known[0] < cost or (known[0] == cost and audit_of(known[1]) <= audit_of(link))):
            continue
        seen[key] = (cost, link)
        if i == len(rows) and ENDS[state]:
            audit = audit_of(link)
            if best_cost is None or (cost, audit) < (best_cost, best):
                best_cost, best, chain = cost, audit, _chain(link)
            continue
        length = (link[2] if link else 0) + 1
        ahead = [(cost + more + bound(at, to), op, at, to, cost + more) for op, at, to, more in steps(rows, i, state)]
        for _, op, at, to, total in sorted(ahead, key=lambda x: x[:2], reverse=True):  # the most promising one is on top
            stack.append((at, to, total, (link, op, length)))
    return best_cost, best


def _chain(link) -> list:
    out = [None]
    while link is not None:
        out.append(link)
        link = link[0]
    return [None, *reversed(out[1:])]


def _behind(link, chain: list, best: str) -> bool:
    """Whether every audit that begins as ``link`` says comes after the incumbent's."""
    at = link[2]
    if at < len(chain) and chain[at - 1] is link[0]:  # it leaves the incumbent's path here
        return link[1] > chain[at][1]
    return audit_of(link) > best[:at]


# --- rows -------------------------------------------------------------------------------------------------------------

def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` (nulls are one space) and ``tie``, which with ``copy`` orders rows of one turn; ``gone`` marks rows that only name their conversation."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.struct(role.alias("role"), F.xxhash64(text).alias("text")).alias("tie"),
                        F.lit(0).alias("copy"), F.lit(False).alias("gone"))


ORDER = ["turn", "tie", "copy"]


def judged(turns: DataFrame) -> DataFrame:
    """Per row of ``ordered_turns``: the role's initial, blank, truncated and a digest of role and text; no text."""
    body = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text"), 256))
    return turns.select("conv_id", *ORDER, "gone", F.substring("role", 1, 1).alias("initial"), (body == "").alias("blank"),
                        (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated"), digest.alias("digest"))


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``ordered_turns``: counts of faults, least cost and audit.

    Only initials, flags and digests are shuffled. A conversation's rows arrive sorted and are forgotten one by one; what
    stays of each is three bytes and its digest. A null ``conv_id`` is a conversation of its own; a role that does not begin with s, u or a
    (also an empty one) cannot be kept. Rows of one turn are ordered by role, then by a hash of the text. An empty table gives no rows.
    """
    def run(batches):
        out = []
        for conv, rows in conversations(batches):
            out.append((conv, *judge(rows)))
            if len(out) == BATCH:
                yield as_batch(out, AUDIT)
                out = []
        if out:
            yield as_batch(out, AUDIT)

    rows = judged(turns).repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return rows.select("conv_id", "turn", "gone", "initial", "blank", "truncated", "digest").mapInArrow(run, AUDIT)


def conversations(batches) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Splits sorted Arrow batches into (first column, iterator of the other columns), as itertools.groupby does."""
    from itertools import groupby
    from operator import itemgetter

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for conv, group in groupby(rows, itemgetter(0)):
        yield conv, (row[1:] for row in group)


def judge(rows: Iterator[tuple]) -> tuple:
    found, seen = Rows(), set()
    blanks = duplicates = truncateds = illegal = distinct = 0
    least = most = last = before = None
    for turn, gone, initial, blank, truncated, digest in rows:
        if gone:
            continue
        if turn is not None:
            distinct += turn != last
            least, most, last = turn if least is None else least, turn, turn
        duplicate = not blank and digest in seen
        truncated = truncated and not blank and not duplicate
        seen.add(digest)
        blanks, duplicates, truncateds = blanks + blank, duplicates + duplicate, truncateds + truncated
        illegal += before is not None and before + initial not in LEGAL_PAIRS
        before = initial
        found.add(initial, blank or duplicate, truncated)
    gaps = 0 if least is None else most - least + 1 - distinct
    return (gaps, blanks, duplicates, truncateds, illegal, *cheapest(found))


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(values, kinds[kind]) for values, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields])


REPAIRED = "conv_id long, place long, role string, text string, edit string"


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations' rows, in order: ``conv_id``, ``place``, ``role``, ``text`` and the ``edit`` that gave the row (K, R or I).

    Each audit travels ahead of its conversation's rows in the same shuffle, and rows pass one by one, so no conversation's texts are held together.
    """
    def edited(rows):
        audit, at, state, place = "", 0, 0, 0
        for ahead, role, text, gone in rows:
            if ahead is not None:
                audit = ahead
                continue
            if gone:
                continue
            while audit[at] == "I":
                at, state, place = at + 1, MADE[state], place + 1
                yield place - 1, NAMES[state], "", "I"
            edit, at = audit[at], at + 1
            if edit != "D":
                state = MADE[state] if edit == "R" else STATES.index(role[:1])
                place += 1
                yield place - 1, NAMES[state] if edit == "R" else role, text, edit
        for _ in audit[at:]:
            state, place = MADE[state], place + 1
            yield place - 1, NAMES[state], "", "I"

    def run(batches):
        out, held = [], 0
        for conv, rows in conversations(batches):
            for row in edited(rows):
                out.append((conv, *row))
                held += len(row[2])
                if len(out) == BATCH or held > 1 << 22:
                    yield as_batch(out, REPAIRED)
                    out, held = [], 0
        if out:
            yield as_batch(out, REPAIRED)

    kinds = dict(turns.dtypes)
    ahead = found.select("conv_id", F.lit(0).alias("part"), *[F.lit(None).cast(kinds[c]).alias(c) for c in ORDER], "audit", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("role", "text", "gone")])
    rows = turns.select("conv_id", F.lit(1).alias("part"), *ORDER, F.lit(None).cast("string").alias("audit"), "role", F.when(~F.col("gone"), F.col("text")).alias("text"), "gone")
    stream = ahead.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "part", *ORDER)
    return stream.select("conv_id", "audit", "role", "text", "gone").mapInArrow(run, REPAIRED)


def digests(rows: DataFrame) -> DataFrame:
    """``repaired_sha256`` per conversation of ``repaired`` rows, as they stand in their partitions."""
    def run(batches):
        out = []
        for conv, group in conversations(batches):
            sha, gap = hashlib.sha256(), ""
            for role, text in group:
                sha.update(f"{gap}{role}:{text}".encode("utf-8", "surrogatepass"))
                gap = "\n"
            out.append((conv, sha.hexdigest()))
            if len(out) == BATCH:
                yield as_batch(out, "conv_id long, repaired_sha256 string")
                out = []
        if out:
            yield as_batch(out, "conv_id long, repaired_sha256 string")

    return rows.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``ordered_turns`` damaged as the query states, by the checksum of ``conv_id:turn`` (a null is one space there too)."""
    rows = ordered_turns(turns)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("fault", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20)
    fault = F.col("fault")
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "tie",
                       F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), (fault == 0).alias("gone"))


def op13_structure_repair(spark, d):
    turns = damaged(read(spark, d, "conversations"))
    found = cut(audits(turns))
    hashed = digests(repaired(turns, found)).withColumnRenamed("conv_id", "hashed_id")
    return found.join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed_id")), "left").select(
        *found.columns, F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


QUERIES = {"op13_structure_repair": op13_structure_repair}
ORACLES: dict[str, str] = {}
