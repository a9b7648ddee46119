"""SimHash near-duplicates (operator 7): fingerprints, generalised pigeonhole search, connected components.

The search finds every link between different fingerprints without listing the links of a dense group: inside a bucket only
a spanning set of links is returned, which has the same components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import ROW, cut, only_rows, read, whole, with_row

BITS = 64
MAX_DISTANCE = 4
SHINGLE = 4
# A bucket up to this size is compared in blocks by one task; a larger one is linked through common midpoints, without pairs.
BUCKET = 8192
PARTITION_COUNTS = (3, 4, 5)
# Pairs that one task of a round of components takes at least, and its least number of tasks.
PAIRS_A_TASK, LEAST_TASKS = 50_000, 8


# --- fingerprints -----------------------------------------------------------------------------------------------------

def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles (repeats count), as a signed integer; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases A-Z and splits at [\x20\x09-\x0D] only
    if not tokens:
        return 0
    ones, total = np.zeros(BITS, np.int64), 0
    for at in range(0, max(1, len(tokens) - shingle + 1), 50_000):
        part = tokens[at: at + 50_000 + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle))) if len(tokens) >= shingle else [part]
        hashes = np.array([xxh64_intdigest(b" ".join(g), 42) for g in grams], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``_row``, ``id`` and ``fp`` (long) per row of ``docs``; a null text is empty."""
    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=[ROW, "id", "fp"])

    rows = docs.select(ROW, F.col(id_col).alias("id"), whole(text_col).alias("text"))
    return rows.mapInArrow(run, f"{ROW} long, id {dict(rows.dtypes)['id']}, fp long")


# --- plan: bit groups and thresholds ----------------------------------------------------------------------------------

def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 matrix of bits set together, over all fingerprints; one matrix per task is returned."""
    def run(batches):
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), 1 << 16):  # float32 counts exactly below 2 ** 24
                part = bits[at: at + (1 << 16)]
                both += (part.T @ part).astype(np.int64)
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([both.tobytes()], pa.binary())], names=["n", "both"])

    rows = fps.select("fp").coalesce(64).mapInArrow(run, "n long, both binary").collect()
    return sum(r.n for r in rows), sum((np.frombuffer(bytes(r.both), np.int64).reshape(BITS, BITS) for r in rows), np.zeros((BITS, BITS), np.int64))


def bit_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Splits the 64 bits into ``parts`` groups of nearly equal size, putting correlated bits together (greedy on absolute correlation)."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    strength = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    free, groups = list(range(BITS)), []
    for g in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - g)
        first = max(free, key=lambda b: strength[b, free].sum())
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = max(free, key=lambda b: strength[b, group].sum())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def key_of(values: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for i, bit in enumerate(group):
        out |= ((values >> np.int64(bit)) & np.int64(1)) << np.int64(i)
    return out


def equal_pairs(fps: DataFrame, layouts: list[list[list[int]]]) -> dict[tuple[int, int], float]:
    """Pairs of fingerprints with equal bits per layout and group, counted over all fingerprints."""
    columns = [F.struct(F.lit(a).alias("layout"), F.lit(g).alias("part"), _key_column(group).alias("key")) for a, layout in enumerate(layouts) for g, group in enumerate(layout)]
    if not columns:
        return {}
    sizes = fps.select(F.explode(F.array(*columns)).alias("k")).groupBy("k.layout", "k.part", "k.key").agg(F.count(F.lit(1)).cast("double").alias("c"))
    found = sizes.groupBy("layout", "part").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")).collect()
    return {(r["layout"], r["part"]): r["pairs"] for r in found}


def _key_column(group: list[int]):
    key = F.lit(0).cast("long")
    for i, bit in enumerate(group):
        key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", bit).bitwiseAND(F.lit(1)), i))
    return key


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds per group, -1 for an unused group, with ``sum(t + 1) = distance + 1`` and least total cost, by dynamic programming.

    Two fingerprints that differ by more than ``t`` bits in every group differ by at least ``sum(t + 1)`` bits in all, so
    every pair within ``distance`` is within the threshold of some group. ``costs[g][t]`` is the cost of threshold t.
    """
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * (distance + 1)
    for cost in costs:
        best = [min(((best[s - used][0] + (cost[used - 1] if used else 0.0), best[s - used][1] + [used - 1]) for used in range(min(s, len(cost)) + 1)), key=lambda x: x[0])
                for s in range(distance + 2)]
    return best[distance + 1]


def plan(fps: DataFrame, distance: int = MAX_DISTANCE, counts=PARTITION_COUNTS, probe_cost: float = 40.0) -> list[tuple[list[int], int]]:
    """Bit groups with their thresholds for this corpus: the cheapest of the given numbers of groups.

    The candidates of threshold t in a group are estimated from the exact number of pairs with equal bits there and the odds
    of each bit to differ, taken as independent; each probe costs ``probe_cost`` comparisons.
    """
    n, both = bit_statistics(fps)
    share = np.diag(both) / max(n, 1)
    agree = share ** 2 + (1 - share) ** 2
    layouts = [bit_groups(n, both, parts) for parts in counts]
    pairs = equal_pairs(fps, layouts)
    options = []
    for a, layout in enumerate(layouts):
        costs = []
        for g, group in enumerate(layout):
            sums = np.zeros(distance + 1)
            sums[0] = 1.0
            for bit in group:  # elementary symmetric sums of the odds
                sums[1:] += sums[:-1] * (1 - agree[bit]) / agree[bit]
            probes = np.cumsum([_choose(len(group), t) for t in range(distance + 1)])
            costs.append([max(pairs.get((a, g), 0.0), 1.0) * float(sums[: t + 1].sum()) + probe_cost * n * float(probes[t]) for t in range(min(2, distance) + 1)])
        cost, thresholds = allocate(costs, distance)
        options.append((cost, [(group, t) for group, t in zip(layout, thresholds) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


def _choose(n: int, k: int) -> int:
    from math import comb

    return comb(n, k)


# --- search -----------------------------------------------------------------------------------------------------------

def popcount(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values.view(np.uint64))


def spanning_links(own: np.ndarray, probing: np.ndarray, distance: int, block: int = 1024) -> list[tuple[int, int]]:
    """Links that connect whatever is linked in one bucket: ``own`` among themselves, and ``probing`` to ``own``.

    Every pair is compared, in blocks; a link is returned only where it joins two sets that were apart, so at most one per member.
    """
    nodes = np.concatenate([own, probing])
    root = list(range(len(nodes)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for at in range(0, len(nodes), block):
        rows = nodes[at: at + block]
        for to in range(0, min(len(own), at + block) if at < len(own) else len(own), block):
            near = popcount(rows[:, None] ^ own[None, to: to + block]) <= distance
            left, right = np.nonzero(near)
            for i, j in zip(left + at, right + to):
                if i != j and nodes[i] != nodes[j]:
                    a, b = top(int(i)), top(int(j))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        links.append((int(nodes[i]), int(nodes[j])))
    return links


def links(fps: DataFrame, distance: int = MAX_DISTANCE, groups: list[tuple[list[int], int]] | None = None, bucket: int = BUCKET) -> DataFrame:
    """Links ``a``, ``b`` between different fingerprints (column ``fp``, distinct) with the components of all pairs within ``distance``.

    Each fingerprint is indexed under its bits of every group and probes all values within the group's threshold. Buckets of
    at most ``bucket`` rows are compared and verified by one task each. In larger buckets, each fingerprint is sent to all
    points within half the distance: members of one point are within the distance of each other, and any two within the distance
    share a point, so linking each to the least member of its points is complete, exact and linear in the bucket.
    """
    groups = plan(fps, distance) if groups is None else groups
    layout = [(bits, t) for bits, t in groups]

    def spread(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for part, (bits, t) in enumerate(layout):
                key = key_of(fp, bits)
                flips = [0] + [1 << i for i in range(len(bits))] * (t >= 1) + [(1 << i) | (1 << j) for i in range(len(bits)) for j in range(i)] * (t >= 2)
                for flip in flips:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), part, np.int32)), pa.array(key ^ flip), pa.array(fp), pa.array(np.full(len(fp), flip == 0))], names=["part", "key", "fp", "own"])

    entries = cut(fps.select("fp").mapInArrow(spread, "part int, key long, fp long, own boolean"))
    sizes = entries.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("n_own")).where("n > 1 and n_own > 0")
    hot = cut(sizes.where(F.col("n") > bucket).select("part", "key"))
    if hot.isEmpty():
        cool, warm = entries, None
    else:
        joined = entries.join(hot.withColumn("hot", F.lit(True)), ["part", "key"], "left")
        cool, warm = joined.where("hot is null").drop("hot"), joined.where("hot")

    def compare(frames):
        rows = pd.concat(list(frames), ignore_index=True)
        out = []
        start = np.flatnonzero(np.r_[True, np.diff(rows["key"].to_numpy()) != 0]) if len(rows) else []
        fp, own = rows["fp"].to_numpy(), rows["own"].to_numpy()
        for at, to in zip(start, [*start[1:], len(rows)]):
            if to - at > 1:
                mine = own[at:to]
                out += spanning_links(fp[at:to][mine], fp[at:to][~mine], distance)
        yield pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    # Buckets are bounded; several small ones share a group so that Python is called per thousand buckets, not per bucket.
    slots = F.shiftright("key", 4)
    found = cool.withColumn("slot", slots).groupBy("part", "slot").applyInPandas(_sorted_compare(compare), "a long, b long")
    if warm is not None:
        found = found.unionByName(midpoint_links(warm.select("part", "key", "fp").distinct(), layout, distance))
    return found


def _sorted_compare(compare):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(compare(iter([frame.sort_values("key", kind="stable")]))), ignore_index=True)

    return run


def midpoint_links(members: DataFrame, layout, distance: int) -> DataFrame:
    """Links inside large buckets through common points; see ``links``."""
    from itertools import combinations

    flips = np.array([sum(1 << b for b in c) for k in range(distance // 2 + 1) for c in combinations(range(BITS), k)], dtype=np.uint64).view(np.int64)
    if distance % 2:
        raise ValueError("midpoints need an even distance")

    def points(batches):
        for batch in batches:
            part, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for at in range(0, len(fp), 256):
                n = len(fp[at: at + 256])
                point = (fp[at: at + 256, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(np.repeat(fp[at: at + 256], len(flips)))], names=["point", "fp"])
                assert len(point) == n * len(flips)

    at_points = members.select("part", "key", "fp").mapInArrow(points, "point long, fp long").select("point", "fp").distinct()
    least = at_points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return at_points.join(least, "point").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


# --- components -------------------------------------------------------------------------------------------------------

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of ``edges`` (``a``, ``b``; any direction, repeats allowed).

    Alternating large-star and small-star steps: each is one aggregation and one join on the node, and every round is cut on
    shared storage. It ends when a round changes nothing; the number of rounds is logarithmic in the longest path.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    count = pairs.count()
    for _ in range(max_rounds):
        # A round's tables are no larger than its pairs. Each task of a shuffle and of a stored table leaves files, so few pairs get few tasks.
        tasks = max(LEAST_TASKS, count // PAIRS_A_TASK)
        pairs = pairs.coalesce(tasks)
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").coalesce(tasks).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").coalesce(tasks).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        after = cut(small.coalesce(tasks))
        before, count = count, after.count()
        changed = count != before or not after.exceptAll(pairs).isEmpty()
        pairs = after
        if not changed:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")


def fingerprint_roots(fps: DataFrame, distance: int = MAX_DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """``fp``, ``root`` of distinct fingerprints: the least one reachable over links of at most ``distance`` bits."""
    roots = components(links(fps.select("fp"), distance, bucket=bucket))
    return fps.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = MAX_DISTANCE, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs`` (which carries ``_row``): ``_row``, the id, ``fingerprint`` (hex), ``component_id`` and ``kept``.

    Documents whose fingerprints differ by at most ``distance`` bits are linked; ``component_id`` is the smallest id
    reachable (null ids last). ``kept`` holds for one row of each component: the smallest id's, the first of repeated rows.
    Texts without words (null, empty, white space) have fingerprint 0 and are linked like any other. Equal fingerprints are
    reduced to one before the search, so exact copies cost nothing. An empty table gives no rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col(ROW).alias("row"))
    distinct = cut(rows.groupBy("fp").agg(F.min(rank).alias("first")))
    rooted = fingerprint_roots(distinct, distance, bucket)
    firsts = rooted.groupBy("root").agg(F.min("first").alias("least"))
    classes = rooted.select("fp", "root").join(firsts, "root").select("fp", "least")
    return rows.join(classes, "fp").select(
        ROW, F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.id").alias("component_id"),
        (F.col(ROW) == F.col("least.row")).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: one document of each component stays."""
    tagged = with_row(docs)
    return only_rows(tagged, near_groups(tagged, **options).where("kept"))


def op7_simhash_near_dedup(spark, d):
    return near_groups(with_row(read(spark, d, "documents"))).drop(ROW, "kept")


QUERIES = {"op7_simhash_near_dedup": op7_simhash_near_dedup}
ORACLES: dict[str, str] = {}
